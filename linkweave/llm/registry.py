"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from linkweave.llm import alignment, bpe, decontaminate, html, langid, licenses, lm, minhash, neighbours, oracles, quality, records, rules, runs
from linkweave.session import shipped

_QUERIES = {
    "op1_bpe": bpe.query,
    "op2_html": html.query,
    "op3_minhash": minhash.query,
    "op4_decontaminate": decontaminate.query,
    "op5_quality": quality.query,
    "op6_records": records.query,
    "op7_lm": lm.query,
    "op8_langid": langid.query,
    "op9_licenses": licenses.query,
    "op10_rules": rules.query,
    "op11_neighbours": neighbours.query,
    "op12_alignment": alignment.query,
    "op13_runs": runs.query,
}

#: Python workers of any cluster get the package before a query runs.
QUERIES = {name: shipped(query) for name, query in _QUERIES.items()}

ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
