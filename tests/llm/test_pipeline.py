import re

import corpus_pipeline
from test_minhash import bag, similarity

from linkweave.session import materialize, table

PATH = "/root/testdata/sf0.001"


def test_stages_keep_and_reject(spark):
    docs = table(spark, PATH, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, PATH, "labels").collect()}
    items = [r.text for r in table(spark, PATH, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = materialize(stage(spark, docs, PATH), name)
        after = docs.collect()
        ids = {r.doc_id for r in after}
        gone = [r for r in before if r.doc_id not in ids]
        assert len(after) <= len(before)
        if name != "bpe":
            assert docs.columns == table(spark, PATH, "documents").columns
        if name == "quality_classifier":
            assert sum(labels.get(r.doc_id) == 1 for r in gone) <= 2 and sum(labels.get(r.doc_id) == 0 for r in after) <= 2
        elif name == "near_duplicates":
            assert len({r.text for r in after}) == len(after) and {r.text for r in before if r.doc_id == min(x.doc_id for x in before)} <= {r.text for r in after}
        elif name == "decontamination":
            assert not any(i in r.text for r in after for i in items)
            assert len(gone) == sum(any(i in r.text for i in items) for r in before)
        else:
            assert not gone
    assert corpus_pipeline.run(spark, PATH).select("doc_id", "ids_sha256").exceptAll(docs.select("doc_id", "ids_sha256")).isEmpty()


def test_texts_without_a_known_language_go(spark):
    rows = [(1, "the cat and the dog are in the house with the other", "en"), (2, None, "en"), (3, "12 34 !!", "en"), (4, "", None), (5, "漢字だけの文章です。日本語の文。" * 3, None)]
    rows += [(100 + i, "the cat and the dog went to the house and it was there with them", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, PATH).collect()}
    assert kept == {1, *range(100, 140)}


def test_empty_documents_pass_through(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, PATH, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stage_names_are_plain():
    assert all(re.fullmatch(r"\w+", name) for name, _ in corpus_pipeline.STAGES) and len(corpus_pipeline.STAGES) == 5


def test_near_copies_repeated_rows_null_ids_and_clashing_columns(spark):
    """Every stage but the last keeps all columns, whatever their names; of near copies and repeated rows the one with the least id stays."""
    base = [r for r in table(spark, PATH, "documents").collect() if r.text and len(r.text.split()) > 150 and r.lang == "en"][:30]
    words = base[0].text.split()
    near = [" ".join([*words[:60], "changed", *words[61:]]), " ".join([*words[:-1], "end"])]
    extra = ("label", "key", "class_id", "score", "matches", "bands", "component", "item_id", "stats", "words")
    made = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in base]
    made += [(100_001, near[0], "en", "s", 1), (100_002, near[1], "en", "s", 1), (100_002, near[1], "en", "s", 1), (None, base[1].text, "en", None, None), (100_003, "", "en", "s", 0), (100_004, None, None, None, None)]
    docs = spark.createDataFrame([(*r, *[f"x{k}" for k in range(len(extra))]) for r in made], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = materialize(stage(spark, docs, PATH), name)
        assert after.columns == docs.columns, name
        if name == "near_duplicates":
            kept = after.collect()
            twins = [r for r in kept if r.text and similarity(bag(r.text), bag(base[0].text)) >= 0.8]
            assert [r.doc_id for r in twins] == [base[0].doc_id]
            assert sum(r.text == base[1].text for r in kept) == 1
            for i, a in enumerate(kept):
                assert not any((a.text or "") == (b.text or "") or similarity(bag(a.text), bag(b.text)) >= 0.8 for b in kept[:i])
        docs = after
    assert 0 < docs.count() <= len(base) + 1
