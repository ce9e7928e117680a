"""Queries that once put whole corpora or archives into one value of the heap, on odd inputs."""

import pytest

from tomeworks.operators import chunk, parse, render
from tomeworks.plans import queries

DIR, FILE = render.DIRECTORY, render.STANDARD


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


ODD = [
    ("a", "a/1.md", f"x{FILE}in.md\n---\ninner{FILE}no rule"), ("a", "a/2.md", f"--{FILE}z\n---\n{DIR}other\n---\ntext{FILE}o\\\\p//q.md\n---\nend"), ("a", "a/3.md", f"{DIR}open"), ("a", "a/4.md", f"eaten{FILE}k.md\n---\nkept"), ("a", "a/5.md", None),
    ("b\n---\nb", "b/1.md", ""), ("b\n---\nb", "b/1.md", "again"), ("b\n---\nb", "b/2.md", f"last{DIR}"), ("c", "c/1.md", "é \r\n---\n---\n"), (None, "n.md", "none"), ("d", "d.md", None), ("e---\nFilename: q", "e.md", f"{DIR}{DIR}x"), ("", "f.md", "-"),
]


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame(ODD, "archive_id string, rel_path string, content string")


def expected() -> str:
    """The text by hand: sections of each directory, those without content left out."""
    text = ""
    for a in sorted({a for a, _, _ in ODD if a is not None}):
        text += f"{DIR}{a}\n---\n" + "".join(f"{FILE}{p}\n---\n{c}\n\n" for x, p, c in sorted(ODD, key=lambda r: (r[1], r[2] or "")) if x == a and c is not None) + "\n\n"
    return text


def test_combined_of_odd_files(spark, odd):
    assert [r.text for r in render.combined_files(odd).collect()] == [expected()] == [r.text for r in render.combined(render.concatenated(odd)).collect()]
    assert [r.text for r in render.combined_files(odd.limit(0)).collect()] == [""]


def test_combined_is_not_collected(spark, sf):
    assert "collect_list" not in plan(queries.combined_archives(spark, sf))


def test_combined_is_bounded(spark, odd, monkeypatch):
    monkeypatch.setattr(render, "MOST_BYTES", 10)
    batch = odd.select(odd.content.alias("section")).toArrow().to_batches()
    with pytest.raises(ValueError, match="can't be one value"):
        list(render._joined(batch))


def test_unpacked_rows_are_those_of_the_text(spark, odd):
    key = lambda df: sorted(tuple(r) for r in df.select("archive_id", "pos", "rel_path", "content").collect())
    want = key(parse.combined(spark.createDataFrame([(expected(),)], "text string")))
    assert key(parse.combined_rows(render.combined_rows(odd))) == want and len(want) > 8 and {"a", "b", "c", "other", "open\n"} <= {w[0] for w in want}


def test_unpacked_in_bits_of_rows(spark, odd):
    """Sections stay whole when their rows come in batches of one."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        test_unpacked_rows_are_those_of_the_text(spark, odd)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_unpack_makes_no_text(spark, sf):
    assert "collect_list" not in plan(queries.unpack_combined(spark, sf))


MARK = render.LLM
SPLIT = [
    ("a", "1.md", f"one two#{MARK}7: in.md\nthree{MARK}"), ("a", "2.md", None), ("a", "3.md", "x " * 30 + MARK + MARK), ("a", "4.md", ""), *[("a", f"n{i:02d}.md", "w " * i + "\u00a0\x1c") for i in range(12)],
    ("b", f"q{MARK}.md", "path"), ("b", "r.md", "s " * 9), ("c", "c.md", None), ("c", "d e f g.md", None), (None, "n.md", "none"), ("d", "d.md", "few"), ("d", "d.md", "few"), (f"e{MARK}", "e.md", "name"), ("f", None, "no path"), ("f", "f.md", "t " * 40), ("g", None, "t"),
]


@pytest.mark.parametrize("most", [1, 20, 45, 70, 10**6])
def test_split_sizes_are_those_of_the_texts(spark, most):
    """Marks in contents, in paths and in names, words that go on over a mark, files without content or path."""
    files = spark.createDataFrame(SPLIT, "archive_id string, rel_path string, content string")
    texts = chunk.split(render.archives(files, True, "S").select("archive_id", "text"), most).collect()
    got = chunk.split_sizes(files, most, "S")
    assert sorted(tuple(r) for r in got.collect()) == sorted((r.archive_id, r.part, r.name, r.words, len(r.text)) for r in texts)
    assert got.columns == ["archive_id", "part", "name", "words", "chars"]


def test_split_makes_no_archives(spark, sf):
    assert "collect_list" not in plan(queries.split_archives(spark, sf))


def test_pages_are_converted_once(spark, sf):
    """Beside line ends and names of files, as many replacements as in the query that converts the same pages without a reader."""
    count = lambda name: plan(queries.queries()[name](spark, sf)).count("regexp_replace(")
    assert count("converted_pages") <= 1.2 * count("html_markdown")


@pytest.mark.parametrize("code_only", [False, True])
def test_converted_odd_files(spark, code_only):
    """Files without content and malformed notebooks are left out, but a page has content even if it has none; root files are taken as they are."""
    files = [("a.html", b"<p>x</p>\r\n", False), ("b.html", None, False), ("c.html", b"", False), ("r.html", b"<p>x</p>", True), ("d.ipynb", b"{", False), ("e.ipynb", None, False), ("r.ipynb", b"{", True), ("f.md", None, False), ("g.md", b"x\r\xff", False), ("h.qmd", None, False), ("i.Rmd", b"text", None)]
    got = {r.rel_path: r.content for r in render.converted(spark.createDataFrame(files, "rel_path string, content binary, root boolean"), code_only).collect()}
    quarto = got.pop("i.Rmd")
    assert got == {"a.html": "x", "b.html": "", "c.html": "", "r.html": "<p>x</p>", "r.ipynb": "{", "g.md": "x\n�"} and ("# Markdown Cell 1" in quarto if code_only else quarto == "text")
