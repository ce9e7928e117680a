"""The pipeline against its operators applied one after the other in plain Python."""

import importlib.util
import random
import sys

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tomeworks.llm import langid, neardup, packing, pii, toxicity


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "personal_data", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    got = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    dicts = langid.fit(docs)
    names, coders = list(dicts), langid.coders_of(dicts)
    rows = {i: r for i, r in rows.items() if langid.classify(r["text"], names, coders)[2]}
    assert len(rows) > 0.95 * docs.count()
    kept = spark.createDataFrame(list(rows.values()), docs.schema)
    model = toxicity.fit(kept, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {i: r for i, r in rows.items() if model.score(r["text"], {})[0] <= 0}
    kept = spark.createDataFrame(list(rows.values()), docs.schema)
    gone = {r.doc_id for r in neardup.duplicates(kept).collect()}
    assert gone and set(rows) - gone == got
    placed = packing.best_fit(kept).select("doc_id", "piece")
    order = {(r.doc_id, r.piece): (r.h, r.doc_id, r.piece) for r in placed.select("doc_id", "piece", F.xxhash64("doc_id", F.col("piece").cast("bigint")).alias("h")).collect()}
    field = pii.fit()
    out = corpus_pipeline.personal_data(spark, kept, sf).collect()
    for r in out:
        assert r.text == pii.redact(rows[r.doc_id]["text"], pii.decode_all(field, [rows[r.doc_id]["text"]])[0])[0] and r.n_chars == len(r.text)
    # the last stage as the rule says, shard by shard
    placed = corpus_pipeline.packed(spark, kept, sf).collect()
    words = {i: len(r["text"].split()) for i, r in rows.items()}
    by: dict = {}
    for r in placed:
        by[r.doc_id] = by.get(r.doc_id, 0) + r.length
    assert by == words
    part = sorted((r for r in placed if 0 < r.length < packing.CAPACITY), key=lambda r: order[r.doc_id, r.piece])
    bins, offsets, _ = packing.pack([r.length for r in part], packing.CAPACITY)
    assert [r.bin_id for r in part] == bins.tolist() and [r.offset for r in part] == offsets.tolist()


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _keep int, _maybe int, _gone int, _again int, _n int, _row int, _pii string, score int, part int, `a.b` string, words array<string>"


def test_edges_of_stages(spark, sf):
    """Nulls, empty and long texts, ties, repeated rows, clashing names and an empty table, through every stage in order."""
    texts = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60").collect()}
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in texts.values()]
    some = rows[1]
    odd = [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, " \n ", "en", "s", 3), (None, some[1], "en", None, None), (None, None, None, None, None), some, some, (1003, some[1], "xx", "s", 1), (1004, " ".join(random.Random(4).choices(some[1].split(), k=30_000)), "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, "p", 7, 8, "d", ["w"]) for r in rows + odd], COLUMNS)
    for table in (docs.limit(0), docs):
        empty = table is not docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = spark.createDataFrame(stage(spark, table, sf).collect(), docs.schema)
            assert table.columns == docs.columns
        assert empty == (table.count() == 0)
        packed = corpus_pipeline.packed(spark, table, sf).collect()
        assert empty or {r.doc_id for r in packed} == {r.doc_id for r in table.collect()}
    left = [r.doc_id for r in table.collect()]
    assert not {1000, 1001, 1002, 1003} & set(left) and left.count(some[0]) == 1 and 1004 in left and None in left
    assert all(r._keep == 1 and r["a.b"] == "d" and r.words == ["w"] and (r.text is None or r.n_chars == len(r.text)) for r in table.collect())
    later = spark.createDataFrame([(*odd[i], 1, 2, 3, 4, 5, 6, "p", 7, 8, "d", ["w"]) for i in (0, 1, 2, 4)], COLUMNS)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert sorted(r.doc_id or 0 for r in stage(spark, later, sf).collect()) == [0, 1000, 1001, 1002], name


def test_a_rare_label_costs_no_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.unionByName(spark.createDataFrame([(10**6, "hello hello", "xx", "s", 11)], docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, more, sf).select("doc_id").collect()}
    assert len(kept) >= 0.98 * docs.count()


def test_registered():
    names = list(__spark_entry__.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 11)] and "pipeline" in names
    assert importlib.util.find_spec("tomeworks.llm") and sys.modules["corpus_pipeline"]
