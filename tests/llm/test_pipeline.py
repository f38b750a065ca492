"""The pipeline as a whole over planted rows, stage by stage and through ``run``."""

import collections

import pytest

from staffloom.llm import toxicity
from tests.llm.test_llm import prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder of the three tables, and the rows by what should become of them."""
    folder = str(tmp_path_factory.mktemp("sf"))
    clean = {i: prose(60 + i % 9, 5000 + i) for i in range(300)}
    toxic = {1000 + i: prose(50, 7000 + i) + "\n" + " ".join(["vilescum", "scumlord", "vilest"][k % 3] for k in range(i, i + 6)) for i in range(150)}
    item = prose(30, 9999)
    shared = "This notice stands at the end of many a page and says nothing new."
    more = {
        2000: prose(80, 1), 2001: prose(80, 1),  # equal texts
        2002: prose(240, 2), 2003: prose(240, 2).replace("\n", " ", 1) + " more",  # near copies
        2004: prose(80, 3) + "\n" + shared, 2005: prose(80, 4) + "\n" + shared,  # one line twice
        2006: prose(40, 5) + "\n" + item,  # holds a benchmark item
        2007: None, 2008: "", 2009: shared,  # nothing to judge; nothing left after the first line
    }
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in {**clean, **toxic, **more}.items()] + [(None, prose(70, 6), None, None, None)]
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in clean] + [(i, 1, 1) for i in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, clean, toxic


def test_every_stage_takes_what_it_should_and_no_more(spark, planted):
    import corpus_pipeline

    folder, clean, toxic = planted
    documents = docs = spark.read.parquet(f"{folder}/documents.parquet")
    left, texts = {}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == documents.columns
        rows = docs.collect()
        left[name], texts[name] = {r.doc_id for r in rows}, {r.doc_id: r.text for r in rows}
        docs = spark.createDataFrame(rows, documents.schema)
    every = {r.doc_id for r in documents.collect()}
    assert left["toxicity"] == every - set(toxic)
    assert every - set(toxic) - left["line_dedup"] == {2001, 2009}  # all their lines stand before
    assert texts["line_dedup"][2005] == prose(80, 4) and texts["line_dedup"][2004].endswith("nothing new.")
    assert left["line_dedup"] - left["jaccard_join"] <= {2003}
    assert left["jaccard_join"] - left["decontamination"] == {2006}
    assert set(clean) | {2007, 2008, None} <= left["decontamination"]


def test_run_packs_what_is_left(spark, planted):
    import corpus_pipeline

    folder, clean, toxic = planted
    pieces = corpus_pipeline.run(spark, folder).collect()
    kept = {p.doc_id for p in pieces}
    assert set(clean) | {None, 2000, 2002, 2004, 2005, 2007, 2008} <= kept and not kept & {*toxic, 2001, 2006, 2009}
    tokens = collections.Counter()
    for p in pieces:
        tokens[p.doc_id] += p.length
    assert all(tokens[p.doc_id] == p.doc_tokens for p in pieces)
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_of_empty_tables(spark, planted, tmp_path):
    import corpus_pipeline

    folder = planted[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_toxic_rows_of_the_pipeline_are_those_scored(spark, planted):
    folder = planted[0]
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    kept = {r.doc_id for r in toxicity.keep_ordinary(docs, labels).collect()}
    assert kept == {r.doc_id for r in scored if r.score < 0.5}
