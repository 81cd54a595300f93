import tracemalloc

from pyspark.sql import functions as F

from linkweave.llm import licenses
from linkweave.llm._text import TermHashes, shingles

FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def brute(text, threshold=licenses.THRESHOLD):
    """The best window for every template that any window holds: containment, first word, words."""
    hashes, found = TermHashes(), {}
    words = hashes.of(text)
    if len(words) < 5:
        return found
    s = shingles(words).tolist()
    for _, name, template in licenses.TEMPLATES:
        t = shingles(hashes.of(template)).tolist()
        width = 1
        while width < len(t):
            width *= 2
        for i in range(0, len(s), width):
            inside = [k for k in range(i, min(i + 2 * width, len(s))) if s[k] in set(t)]
            share = len({s[k] for k in inside}) / len(set(t))
            if share >= threshold and share > found.get(name, (0,))[0]:
                found[name] = (share, inside[0], inside[-1] - inside[0] + 5)
    return found


def texts():
    out = [None, "", "...", "one two", "five words are not enough", " ".join(FILLER * 60)]
    for k, (_, _, t) in enumerate(licenses.TEMPLATES):
        words = t.split()
        out.append(t)
        out.append(" ".join(FILLER[: k % 19]) + f" {t.upper()} " + " ".join(FILLER * (k % 5)))
        cut = words[: max(5, len(words) * 9 // 10)]
        out.append(" ".join([*FILLER * 3, *cut, *FILLER * 3]))
        out.append(" ".join(words[: len(words) // 2] + FILLER))
    out.append("\n".join(t for _, _, t in licenses.TEMPLATES))
    return out


def test_equals_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in licenses.annotate(df).collect():
        assert {x.template: (x.containment, x.start_word, x.n_words) for x in r.licenses} == brute(rows[r.doc_id]), rows[r.doc_id]
    whole = [r for r in licenses.annotate(df.filter(f"doc_id = {len(rows) - 1}")).collect()][0]
    assert [x.template for x in whole.licenses] == sorted(t[1] for t in licenses.TEMPLATES)


def test_clean_texts_repeated_rows_clashing_name_empty_table(spark):
    df = spark.createDataFrame([(1, "a licensed doctor under general public care", "x"), (2, "Released under the MIT License.", None), (2, "Released under the MIT License.", None)], "doc_id long, text string, licenses string")
    got = sorted((r.doc_id, len(r.licenses)) for r in licenses.annotate(df).collect())
    assert got == [(1, 0), (2, 1), (2, 1)]
    assert licenses.annotate(df.limit(0)).collect() == []


def test_query_finds_all_notices(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for template, phrase in (("mit-line", "Released under the MIT License."), ("gpl3-line", "licensed under the GNU General Public License, version 3."), ("cc-by-nc-line", "Licensed under CC BY-NC 4.0.")):
        want = {r.doc_id for r in docs.filter(F.col("text").contains(phrase)).collect()}
        assert want and {r.doc_id for r in licenses.query(spark, path).filter(F.col("template") == template).collect()} >= want


def test_pieces_of_a_long_text_give_the_same():
    index, hashes = licenses.Index(licenses.TEMPLATES), TermHashes()
    text = " ".join([*FILLER * 300, "\n".join(t for _, _, t in licenses.TEMPLATES), *FILLER * 40, licenses.TEMPLATES[2][2]])
    words = hashes.of(text)
    want = index.scan(words)
    assert len(want) == len(licenses.TEMPLATES)
    for piece in (1, 128, 256, 1 << 20):
        assert index.scan(words, piece=piece) == want


def test_memory_for_a_very_long_text():
    index, words = licenses.Index(licenses.TEMPLATES), TermHashes().of(" ".join([*FILLER * 60_000, licenses.TEMPLATES[2][2]]))
    tracemalloc.start()
    assert [x["template"] for x in index.scan(words)] == ["mit-grant"]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words) > 1_000_000 and most < 100 << 20
