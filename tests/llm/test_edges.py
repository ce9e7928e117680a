"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names, for every operator."""

import random

import pytest
from pyspark.sql import functions as F

from tomeworks.llm import ann, bpe, langid, lattice, neardup, packing, pii, toxicity, urls, winnow

LONG = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta", "x1"]) for _ in range(60_000)) + " " + "z" * 30_000
SCHEMA = "doc_id bigint, text string, lang string, score string, _id int, _r int, id string, `a.b` string, _keep string, _maybe int, words string, DOC string"
ROWS = [(1, "one two three four"), (2, None), (3, ""), (4, " \n\t"), (5, LONG), (6, "one two three four"), (7, "é 𝄞 ẞ"), (8, "no idiot here 555-0100"), (8, "no idiot here 555-0100"), (None, "no id at all"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "s", 0, 0, "i", "d", "k", 1, "w", "D") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df):
    return df.collect()


def per_row(docs, none, f, ids=None):
    """f gives one row for each row, none for an empty table; texts that are the same give the same."""
    got = rows(f(docs))
    assert sorted((r[0] is None, r[0] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in ROWS)
    assert rows(f(none)) == []
    first = {i: r[1:] for r in got for i in [r[0]] if i in (1, 6)}
    assert first[1] == first[6]
    return {r[0]: r for r in got if r[0] is not None}


def test_packing(docs, none):
    got = rows(packing.best_fit(docs, capacity=1000))
    long = sorted((r for r in got if r.doc_id == 5), key=lambda r: r.piece)
    assert sum(r.length for r in long) == 60_001 and [r.start for r in long] == [1000 * i for i in range(61)]
    assert all(r.bin_id is None and r.length == 0 and r.offset == 0 for r in got if r.doc_id in (2, 3, 4))
    assert len([r for r in got if r.doc_id == 8]) == 2 and len([r for r in got if r.doc_id is None]) == 2
    assert rows(packing.best_fit(none)) == []


def test_langid(docs, none):
    dicts = langid.dictionaries({"en": ["one two three four here " * 50], "de": ["eins zwei drei vier hier " * 50]})
    got = per_row(docs, none, lambda d: langid.identify(d, dicts))
    assert all(tuple(got[i][1:]) == ("und", 0.0, False) for i in (2, 3, 4)) and got[1].lang_pred == "en" and got[1].accepted
    kept = langid.keep(docs, dicts)
    assert kept.columns == docs.columns and {r.doc_id for r in rows(kept)} >= {1, 6}
    assert tuple(rows(langid.identify(docs.filter("doc_id = 1"), {}))[0])[1:] == ("und", 0.0, False)
    assert langid.fit(none) == {} and set(langid.fit(docs)) == {"en"}
    same = langid.dictionaries({"b": ["abc " * 50], "a": ["abc " * 50]})
    tie = rows(langid.identify(docs.filter("doc_id = 1"), same))[0]
    assert (tie.lang_pred, tie.margin, tie.accepted) == ("a", 0.0, False)


def test_toxicity(docs, none):
    characters = toxicity.Characters({"^^^i": 1.0, "^^id": 1.0, "^idi": 1.0, "idio": 1.0, "diot": 1.0, "iot$": 1.0})
    model = toxicity.Model({"idiot": 3.0}, -1.0, characters, "t")
    got = per_row(docs, none, lambda d: toxicity.score(d, model))
    assert got[2].score is None and got[2].toxic_words is None and not got[2].is_toxic and got[3].score == -1.0 and got[8].is_toxic and got[8].toxic_words == ["idiot"]
    kept = toxicity.keep(docs, model)
    assert kept.columns == docs.columns and len(rows(kept)) == len(ROWS) - 2
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    assert not any(r.is_toxic for r in rows(toxicity.score(docs, toxicity.fit(docs, labels))))
    assert toxicity.fit(none, labels.limit(0)).weights == {}


def test_pii(docs, none):
    got = per_row(docs, none, lambda d: pii.redacted(d, pii.fit()))
    assert got[2].text is None and got[2].labels is None and got[2].n_found == 0 and got[3].text == "" and got[3].labels == [] and got[5].text == LONG
    done = pii.clean(docs, pii.fit())
    assert done.columns == docs.columns and len(rows(done)) == len(ROWS)


def test_lattice(docs, none):
    got = per_row(docs, none, lattice.score)
    assert tuple(got[2][1:]) == (None,) * 5 and got[3].log_prob == 0.0 and got[4].bits_per_char is None and got[5].n_words == 60_001 and got[1].rank == got[6].rank


def test_bpe(docs, none):
    got = per_row(docs, none, bpe.encode)
    assert tuple(got[2][1:]) == (None,) * 5 and got[3].ids == [] and got[3].n_tokens == 0 and all(got[i].round_trip for i in (1, 3, 4, 5, 7, 8))


def test_winnowing(docs, none):
    got = per_row(docs, none, winnow.fingerprints)
    assert got[2].hashes is None and got[3].hashes == [] and got[4].hashes == [] and got[7].hashes == [] and len(got[5].hashes) > 1000


def test_neardup(docs, none):
    assert {(r.doc_id, r.duplicate_of) for r in rows(neardup.duplicates(docs))} == {(6, 1)}
    assert rows(neardup.duplicates(none)) == []
    kept = neardup.keep(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in rows(kept)) == [0, 0, 1, 2, 3, 4, 5, 7, 8]
    assert rows(neardup.keep(none)) == []
    clash = docs.withColumns({c: F.col("_id") for c in ("_gone", "_again", "_n", "_row", "n", "key", "sig", "bucket", "component", "node", "part", "head")})
    kept = neardup.keep(clash)
    assert kept.columns == clash.columns and len(rows(kept)) == 9
    twice = docs.filter("doc_id = 8").withColumn("_id", F.lit(7)).unionByName(docs.filter("doc_id = 8"))
    assert [r["_id"] for r in rows(neardup.keep(twice))] == [0]


def test_urls(spark, docs):
    long = "http://www." + "cheappills" * 200 + ".com/" + "a/" * 5000
    table = [(1, None, None, "h"), (2, "", "<p>pages</p>", "h"), (3, long, None, "h"), (4, "http://1.2.3.4:80/x", "", "h"), (5, "http://cheap-pills.com", None, "h"), (5, "http://cheap-pills.com", None, "h"), (None, "%%%\x00", None, "h")]
    pages = spark.createDataFrame(table, "page_id bigint, url string, html string, host string")
    model = urls.fit(pages)
    got = rows(urls.classify(pages, model))
    by = {r.page_id: r for r in got}
    assert len(got) == 7 and by[1].host is None and not by[1].blocked and not by[2].blocked and by[3].blocked and not by[4].blocked and by[4].host_words == [] and by[5].blocked
    kept = urls.keep(pages, model)
    assert kept.columns == pages.columns and len(rows(kept.filter("page_id = 5"))) == 0
    assert rows(urls.classify(pages.limit(0), urls.fit(pages.limit(0)))) == []
    clash = pages.withColumns({c: F.lit(1) for c in ("_blocked", "_maybe", "key", "run", "words", "category")})
    kept = urls.keep(clash, urls.fit(clash))
    assert kept.columns == clash.columns and sorted((r.page_id or 0) for r in rows(kept)) == [0, 1, 2, 4]
    nobody = urls.fit(pages, table=spark.createDataFrame([], "url string, category string"))
    assert not any(r.blocked for r in rows(urls.classify(pages, nobody)))


def test_ann(spark):
    nan = float("nan")
    table = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [1.0]), (8, []), (None, [1.0, 0.0]), (9, [None, 1.0])]
    v = spark.createDataFrame([(i, e, 0) for i, e in table], "vec_id bigint, embedding array<float>, part int")
    by = {r.vec_id: r for r in rows(ann.neighbours(v, k=2, every=1))}
    assert sorted(by) == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert by[1].neighbours == [6, 2] and by[6].neighbours == [1, 2] and by[2].neighbours == [1, 6] and by[4].neighbours == [1, 2]
    assert all(by[i].neighbours is None for i in (3, 5, 7, 8, 9))
    assert rows(ann.neighbours(v.limit(0), every=1)) == []
    assert rows(ann.neighbours(v.filter("vec_id = 1"), every=1))[0].neighbours == []
    # many parts, with nulls, ties and copies
    rnd = random.Random(3)
    table = [(i, [rnd.random() for _ in range(4)] if i % 3 else [1.0, 0.0, 0.0, 0.0]) for i in range(400)] + [(i, None) for i in range(400, 420)] + [(5, [0.0, 1.0, 0.0, 0.0])]
    v = spark.createDataFrame(table, "vec_id bigint, embedding array<float>")
    by = {r.vec_id: r for r in rows(ann.neighbours(v, k=3, every=10))}
    assert sorted(by) == list(range(0, 420, 10)) and by[400].neighbours is None and len(by[390].neighbours) == 3
    assert all(s == pytest.approx(1.0) for s in by[300].similarities)
