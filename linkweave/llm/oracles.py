"""SQL for the queries of this subpackage that SQL can express: near-duplicate classes, benchmark passages, licence notices, quality rules.

Each statement is exact where the operator finds its candidates by signatures, so it also measures that none is missed."""

from __future__ import annotations

from linkweave.llm.licenses import TEMPLATES
from linkweave.llm.licenses import THRESHOLD as LICENSED
from linkweave.llm.minhash import THRESHOLD as NEAR
from linkweave.llm.rules import BASE, MAX_REPEATED, MIN_WORDS, ROUNDS, RULES, WINDOW

_WORD, _TERM = r"[^\x20\x09-\x0D]+", r"[\p{L}\p{N}]+"


def _shingles(words: str, width: str = "5") -> str:
    """List of the shingles of a list of words; a shorter list is one shingle, an empty one none."""
    return f"CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) < {width} THEN [array_to_string({words}, ' ')] ELSE list_transform(range(1, len({words}) - {width} + 2), lambda i: array_to_string({words}[i:i + {width} - 1], ' ')) END"


NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, md5(coalesce(text, '')) AS k, coalesce(text, '') AS t FROM documents), w AS (SELECT k, regexp_extract_all(any_value(t), '{_WORD}') AS ws FROM d GROUP BY k),
 c AS (SELECT k, g, count(*) AS n FROM (SELECT k, unnest({_shingles('ws')}) AS g FROM w) GROUP BY 1, 2), s AS (SELECT k, sum(n) AS n FROM c GROUP BY 1),
 p AS (SELECT x.k AS a, y.k AS b, sum(least(x.n, y.n)) AS common FROM c x JOIN c y ON x.g = y.g AND x.k < y.k GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN s x ON x.k = a JOIN s y ON y.k = b WHERE CAST(common AS DOUBLE) / (x.n + y.n - common) >= CAST({NEAR} AS DOUBLE)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT k AS a, k AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), m AS (SELECT a, min(b) AS part FROM r GROUP BY 1)
SELECT doc_id, min(doc_id) OVER (PARTITION BY part) AS class_id FROM d JOIN m ON a = k"""


_TEMPLATE_ROWS = ", ".join("('" + "', '".join(x.replace("'", "''") for x in t) + "')" for t in TEMPLATES)
LICENSES = f"""WITH t AS (SELECT l, name, regexp_extract_all(lower(body), '{_TERM}') AS ws FROM (VALUES {_TEMPLATE_ROWS}) AS v(l, name, body)), g AS (SELECT DISTINCT l, name, CAST(power(2, ceil(log2(len(ws) - 4))) AS BIGINT) AS w, unnest({_shingles('ws')}) AS g FROM t),
 z AS (SELECT name, count(*) AS n FROM g GROUP BY 1), d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_TERM}') AS ws FROM documents), s AS (SELECT doc_id, unnest(range(len(ws) - 4)) AS p, unnest({_shingles('ws')}) AS g FROM d WHERE len(ws) >= 5),
 h AS (SELECT doc_id, l, name, w, p, s.g FROM s JOIN g ON g.g = s.g), x AS (SELECT doc_id, l, name, p, g, p // w AS i FROM h UNION ALL SELECT doc_id, l, name, p, g, p // w - 1 FROM h WHERE p // w > 0),
 y AS (SELECT doc_id, l, name, i, CAST(count(DISTINCT g) AS DOUBLE) / any_value(n) AS share, min(p) AS a, max(p) AS b FROM x JOIN z USING (name) GROUP BY 1, 2, 3, 4),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY share DESC, i) AS r FROM y WHERE share >= CAST({LICENSED} AS DOUBLE))
SELECT doc_id, l AS license_id, name AS template, share AS containment, a AS start_word, b - a + 5 AS n_words FROM k WHERE r = 1"""


BENCHMARK_PASSAGES = f"""WITH b AS (SELECT DISTINCT item_id, text, regexp_extract_all(lower(text), '{_TERM}') AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL), i AS (SELECT item_id, md5(text) AS k, ws, least(5, len(ws)) AS width FROM b WHERE len(ws) > 0),
 ig AS (SELECT item_id, k, width, g, count(*) AS n FROM (SELECT item_id, k, width, unnest(list_transform(range(1, len(ws) - width + 2), lambda j: array_to_string(ws[j:j + width - 1], ' '))) AS g FROM i) GROUP BY ALL), m AS (SELECT item_id, k, CAST(sum(n) AS BIGINT) AS m FROM ig GROUP BY 1, 2),
 d AS (SELECT doc_id, width, ws, len(ws) - width + 1 AS l FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_TERM}') AS ws FROM documents) CROSS JOIN (SELECT DISTINCT width FROM i) WHERE len(ws) >= width),
 s AS (SELECT doc_id, width, l, unnest(range(l)) AS p, unnest(list_transform(range(1, len(ws) - width + 2), lambda j: array_to_string(ws[j:j + width - 1], ' '))) AS g FROM d),
 h AS (SELECT doc_id, item_id, k, l, p, s.g, ig.n FROM s JOIN ig ON ig.g = s.g AND ig.width = s.width), q AS (SELECT h.*, m, least(m, l) AS span FROM h JOIN m USING (item_id, k) WHERE l >= CAST(0.8 AS DOUBLE) * m),
 u AS (SELECT doc_id, item_id, k FROM q GROUP BY 1, 2, 3 HAVING count(*) >= CAST(0.8 AS DOUBLE) * (any_value(span) + any_value(m)) / CAST(1.8 AS DOUBLE) - 1e-6),
 o AS (SELECT doc_id, item_id, k, g, n, m, span, unnest(range(greatest(0, p - span + 1), least(p, l - span) + 1)) AS start FROM q SEMI JOIN u USING (doc_id, item_id, k)),
 c AS (SELECT doc_id, item_id, k, m, span, start, sum(least(c, n)) AS common FROM (SELECT doc_id, item_id, k, m, span, start, g, n, count(*) AS c FROM o GROUP BY ALL) GROUP BY ALL),
 y AS (SELECT c.doc_id, c.item_id, start, CAST(common AS DOUBLE) / (m + span - common) AS similarity, span + width - 1 AS n_words FROM c JOIN i USING (item_id, k)),
 z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM y WHERE similarity >= CAST(0.8 AS DOUBLE))
SELECT doc_id, item_id, similarity, start AS start_word, n_words FROM z WHERE r = 1"""


def _rules() -> str:
    k = range(len(RULES))
    votes = ", ".join(f"CASE WHEN {r.bad} THEN 0 WHEN {r.good} THEN 1 END AS v{j}" for j, r in enumerate(RULES))

    def posterior(e: str) -> str:
        good = " * ".join([f"{e}.prior", *(f"CASE WHEN v{j} IS NULL THEN 1.0::DOUBLE WHEN v{j} = 1 THEN {e}.g{j} ELSE 1 - {e}.g{j} END" for j in k)])
        bad = " * ".join([f"(1 - {e}.prior)", *(f"CASE WHEN v{j} IS NULL THEN 1.0::DOUBLE WHEN v{j} = 0 THEN {e}.b{j} ELSE 1 - {e}.b{j} END" for j in k)])
        return f"({good}) / (({good}) + ({bad}))"

    ratio = lambda right, of: f"least(0.999::DOUBLE, greatest(0.5::DOUBLE, (coalesce({right}, 0) + 4.0::DOUBLE) / (coalesce({of}, 0) + 5.0::DOUBLE)))"
    start = ", ".join(["0.8::DOUBLE AS prior", *(f"0.8::DOUBLE AS g{j}, 0.8::DOUBLE AS b{j}" for j in k)])
    rounds = [f"e0 AS (SELECT {start})"]
    for i in range(1, ROUNDS + 1):
        new = ["least(0.99::DOUBLE, greatest(0.01::DOUBLE, sum(n * p) / sum(n))) AS prior"]
        for j in k:
            new.append(ratio(f"sum(n * p) FILTER (v{j} = 1)", f"sum(n * p) FILTER (v{j} IS NOT NULL)") + f" AS g{j}")
            new.append(ratio(f"sum(n * (1 - p)) FILTER (v{j} = 0)", f"sum(n * (1 - p)) FILTER (v{j} IS NOT NULL)") + f" AS b{j}")
        rounds.append(f"e{i} AS MATERIALIZED (SELECT {', '.join(new)} FROM (SELECT pattern.*, {posterior(f'e{i - 1}')} AS p FROM pattern, e{i - 1}))")
    v = ", ".join(f"v{j}" for j in k)
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT row, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
 s AS (SELECT row, unnest(range(1, len(ws) - {WINDOW} + 2)) AS p, unnest(list_transform(range(1, len(ws) - {WINDOW} + 2), lambda i: array_to_string(ws[i:i + {WINDOW - 1}], ' '))) AS g FROM w WHERE len(ws) >= {WINDOW}),
 f AS (SELECT row, p FROM (SELECT row, p, count(*) OVER (PARTITION BY row, g) AS n FROM s) WHERE n > 1), rw AS (SELECT row, count(DISTINCT p + o) AS n FROM f CROSS JOIN range({WINDOW}) AS r(o) GROUP BY 1),
 c AS (SELECT w.row, doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words,
  len(list_distinct(ws)) AS n_distinct_words, len(ls) AS n_lines, length(regexp_replace(t, '\\P{{Lu}}+', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS n_alnum FROM w LEFT JOIN rw ON rw.row = w.row),
 x AS (SELECT *, {votes} FROM c), pattern AS MATERIALIZED (SELECT {v}, count(*) AS n FROM x GROUP BY ALL), {', '.join(rounds)},
 y AS (SELECT doc_id, {', '.join(BASE)}, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed, {posterior(f'e{ROUNDS}')} AS p FROM x, e{ROUNDS})
SELECT doc_id, {', '.join(f'CAST({b} AS BIGINT) AS {b}' for b in BASE)}, base_failed, NOT base_failed AND p >= 0.5 AS kept, round(p, 6) AS posterior FROM y"""


ORACLE_SQL = {"op3_minhash": NEAR_DUPLICATES, "op4_decontaminate": BENCHMARK_PASSAGES, "op9_licenses": LICENSES, "op10_rules": _rules()}
