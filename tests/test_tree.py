"""Folders to archives and back, on real files."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tomeworks import api, cli
from tomeworks.operators import ingest, select, write
from tomeworks.sources.tree import read_archive, scan


@pytest.fixture
def tree(tmp_path):
    d = tmp_path / "proj"
    for name, text in {
        "main.py": "print('x')\n", "_hidden/__init__.py": "a = 1\n", ".gitignore": "*.x", ".secret.py": "no", "#tmp.py": "no", "sub/helper.py": "---\nFilename: trick\n", "README.md": "# hi", "build/out.py": "no",
        "nb.ipynb": json.dumps({"cells": [{"cell_type": "code", "source": ["x = 1"], "outputs": [1]}, {"cell_type": "markdown", "source": "note"}]}), "doc.qmd": "---\ntitle: t\n---\n\n```{r}\n1\n```\n", "UP.R": "1",
        "bad.ipynb": "{", "crlf.py": "a\r\nb\r",
    }.items():
        (d / name).parent.mkdir(parents=True, exist_ok=True)
        (d / name).write_bytes(text.encode())
    (d / "broken.py").write_bytes(b"ok \xff\xfe")
    return str(d)


def paths(df):
    return sorted(r.rel_path for r in df.select("rel_path").collect())


def test_scan(spark, tree):
    assert paths(scan(spark, tree)) == [".gitignore", "_hidden/__init__.py", "bad.ipynb", "broken.py", "crlf.py", "doc.qmd", "main.py", "nb.ipynb", "sub/helper.py"]
    assert paths(scan(spark, tree, recurse=False, file_types=[".py"])) == [".gitignore", "broken.py", "crlf.py", "main.py"]
    assert paths(scan(spark, tree, subdirs=["sub"], file_types=[".py"])) == [".gitignore", "broken.py", "crlf.py", "main.py", "sub/helper.py"]
    assert paths(scan(spark, tree, prefixes=["ma"])) == [".gitignore", "main.py"]
    assert paths(scan(spark, tree, roots=["README.md", "main.py", ".secret.py"], file_types=[".py"], exclude=["sub"])) == [".gitignore", "README.md", "_hidden/__init__.py", "broken.py", "crlf.py", "main.py"]
    assert paths(scan(spark, tree, explicit=["README.md", "README.md", "missing", "build/out.py"])) == ["README.md", "README.md", "build/out.py"]
    with pytest.raises(Exception, match="no directory"):
        scan(spark, tree + "/missing").count()


def test_native_selection_equals_reader(spark, tree):
    every = scan(spark, tree, everything=True, exclude=[]).select("rel_path")
    assert paths(select.select(every)) == paths(scan(spark, tree))
    for p in ("a.py", ".x", "a.b.py", "Makefile", "d/.git/x.py", "#a.py", "x/.gitignore"):
        row = spark.createDataFrame([(p,)], "rel_path string")
        assert (select.select(row).count() == 1) == select.wanted(p, exclude=select.EXCLUDED), p


def test_round_trip(spark, tree, tmp_path):
    out, back = str(tmp_path / "a.txt"), str(tmp_path / "back")
    got = api.archive(spark, tree, out, stamp="S")
    assert got["files"] == 8  # a malformed notebook is left out
    text = open(out).read()
    assert text.startswith("# Archive created on: S\n\n# Standard Archive Format\n\n# TABLE OF CONTENTS\n1. .gitignore\n") and "---\\nFilename: trick" in text
    api.unpack(spark, out, back)
    assert open(f"{back}/main.py").read() == "print('x')\n\n\n" and open(f"{back}/crlf.py").read() == "a\nb\n\n\n" and open(f"{back}/broken.py").read() == "ok ��\n\n"
    api.unpack(spark, out, back)
    assert os.path.exists(f"{back}/main.py_copy") and os.path.exists(f"{back}/.gitignore_copy")


def test_llm_archive(spark, tree, tmp_path):
    out = str(tmp_path / "l.txt")
    api.archive(spark, tree, out, llm=True, extract_code_only=True, split=True, max_words=60)
    text = open(out).read()
    assert "# LLM-FRIENDLY CODE ARCHIVE\n# Generated from: proj\n" in text and "# Cell 1\nx = 1\n\n# Markdown Cell 2\n" in text
    with pytest.raises(SystemExit):
        api.unpack(spark, out, str(tmp_path / "no"))
    api.unpack(spark, out, str(tmp_path / "yes"), force=True)
    assert json.load(open(tmp_path / "yes/nb.ipynb"))["cells"][0]["source"] == ["x = 1\n"]
    assert read_archive(spark, str(tmp_path / "split_l")).count("# FILE ") == text.count("# FILE ")
    made = api.extract_notebooks(spark, out, str(tmp_path / "nb"))
    assert sorted(map(os.path.basename, made)) == ["doc.ipynb", "nb.ipynb"]
    made = api.extract_notebooks(spark, out, str(tmp_path / "nbq"), quarto=True)
    assert "```{r}\n1\n```" in open(tmp_path / "nbq/doc.qmd").read() and len(made) == 2


def test_update_touches_only_changes(spark, tree, tmp_path):
    out = str(tmp_path / "u.txt")
    args = dict(llm=True, split=True, max_words=40, update=True)
    first = api.archive(spark, tree, out, stamp="A", **args)
    os.utime(first["parts"][1], (1, 1))
    again = api.archive(spark, tree, out, stamp="B", **args)
    assert first["written"] and not again["written"] and os.path.getmtime(first["parts"][1]) == 1
    os.unlink(os.path.join(tree, "doc.qmd"))
    third = api.archive(spark, tree, out, stamp="C", **args)
    assert third["written"] and sorted(os.listdir(os.path.dirname(third["parts"][0]))) == sorted(map(os.path.basename, third["parts"]))


def test_dry_run(spark, tree, tmp_path):
    got = api.archive(spark, tree, str(tmp_path / "d.txt"), dry_run=True, roots=["nothing.txt"])
    assert got["files"] == 8 and got["est_tokens"] == got["chars"] // 4 and got["issues"] == ["root file not found: nothing.txt"] and not os.path.exists(tmp_path / "d.txt")


def test_parts_in_order_of_number(spark, tmp_path):
    for n in range(1, 12):
        (tmp_path / f"a_part{n}.txt").write_text(f"TABLE OF CONTENTS {n}\n# Part {n}\n<DOCUMENT>\n")
    got = read_archive(spark, str(tmp_path))
    assert got.index("CONTENTS 2\n") < got.index("CONTENTS 10\n") and "<DOCUMENT>" not in got and "# Part" not in got
    assert (t := read_archive(spark, str(tmp_path), numeric=False)) and t.index("CONTENTS 10\n") < t.index("CONTENTS 2\n")


def test_combined(spark, tree, tmp_path):
    path = api.archive_subdirectories(spark, tree, ["sub", "_hidden", "absent"], str(tmp_path / "c"), file_types=[".py"])
    made = api.unpack_combined(spark, path, str(tmp_path / "un"))
    assert sorted(os.path.relpath(m, tmp_path / "un") for m in made) == ["_hidden/__init__.py", "sub/helper.py"] or len(made) == 3


def test_older_form(spark, tree, tmp_path):
    text = open(api.concatenate(spark, tree, str(tmp_path / "o.txt"))).read()
    assert text.startswith("---\nFilename: ") and "Filename: build/out.py\n" in text and "nb.ipynb" in text and "broken.py" not in text and "doc.qmd" not in text
    api.strip_outputs(spark, os.path.join(tree, "nb.ipynb"))
    assert json.load(open(os.path.join(tree, "nb.ipynb")))["cells"][0]["outputs"] == [] and not api.validate(str(tmp_path / "o.txt"))


def test_targets(spark):
    assert write.inside("../x") is None and write.inside("/x") is None and write.inside("a/../../x") is None and write.inside("a/../b") == "b" and write.inside("..a") == "..a" and write.inside("a\\b") == "a/b"
    rows = spark.createDataFrame([("d/a.py", True), ("Makefile", True), (".gitignore", True), ("b.py", False)], "p string, e boolean")
    by = {rule: [r.t for r in rows.select(write.target(F.col("p"), F.col("e"), rule).alias("t")).collect()] for rule in write.RULES}
    assert by["suffix"] == ["d/a.py_copy", "Makefile_copy", ".gitignore_copy", "b.py"] and by["stem"][0] == "d/a_copy.py" and by["skip"] == [None, None, None, "b.py"]


def test_word_and_html(spark, tmp_path):
    def tag(name, inner=""):
        return f"<w:{name}>{inner}</w:{name}>"

    paragraphs = [tag("p", "".join(tag("r", tag("t", t)) for t in texts)) for texts in ([" Head"], [], ["a", "b"])]
    space = "/".join(["http:/", "schemas.openxmlformats.org", "wordprocessingml", "2006", "main"])
    with zipfile.ZipFile(tmp_path / "w.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}">{tag("body", "".join(paragraphs))}</w:document>')
    assert api.convert_word(spark, str(tmp_path / "w.docx")) == [str(tmp_path / "w.md")] and (tmp_path / "w.md").read_text() == "Head\n\nab"
    with pytest.raises(ValueError):
        api.convert_word(spark, str(tmp_path / "w.md"))
    (tmp_path / "p.html").write_text('<body><h1>T</h1><img src="data:image/png;base64,QUJD" alt="z"></body>')
    api.convert_html(spark, str(tmp_path / "p.html"), replace=True)
    assert "# T" in (tmp_path / "p.md").read_text() and (tmp_path / "images/p_image_001.png").read_bytes() == b"ABC"
    api.convert_html(spark, str(tmp_path / "p.html"), str(tmp_path / "q.md"), extract_images=False)
    assert "[Image 1" in (tmp_path / "q.md").read_text()


def test_ingest(spark, tree, tmp_path, monkeypatch):
    monkeypatch.setenv("ACCESS_TOKEN", "t")

    def transport(url, headers, payload, timeout):
        return (200, '{"embedding": 1}') if "print" in str(payload) else (500, "bad")

    got = api.archive_and_ingest(spark, tree, str(tmp_path / "i.txt"), "http://x", transport=transport, file_types=[".py"])
    assert got["method"] == "directory" and got["ok"] == 1 and got["sent"] == 6
    got = api.archive_and_ingest(spark, tree, str(tmp_path / "i.txt"), "http://x", method="archive", remove=True, transport=transport, file_types=[".py"])
    assert got["ok"] == 1 and not os.path.exists(tmp_path / "i.txt")
    assert {k: v["success"] for k, v in ingest.try_endpoints("x", "http://x", transport).items()} == dict.fromkeys(ingest.ENDPOINTS, False)
    answers = ["", "{}", None, '{"embedding": 0}', '{"response": "fine"}', '{"response": "An Error"}', '{"embedding": null}', "no json"]
    rows = spark.createDataFrame([(a,) for a in answers], "a string").select(ingest.accepted(F.col("a")).alias("ok")).collect()
    assert [r.ok for r in rows] == [False, False, False, True, True, False, True, False]


def test_cli(spark, tree, tmp_path, capsys):
    assert cli.run(["describe"]) == 0
    assert len(json.loads(capsys.readouterr().out)["commands"]) == 12
    assert cli.run(["archive", tree, str(tmp_path / "c.txt"), "--file_types", ".py", "--llm-friendly"], spark) == 0 and (tmp_path / "c.txt").exists()
    (tmp_path / "r.html").write_text("<title>t</title>")
    assert cli.run(["extract-report", str(tmp_path / "r.html"), "--format", "json"]) == 0
    assert cli.run(["extract-report", str(tmp_path / "r.html"), "--sections", "x"]) == 1
    (tmp_path / "plan.md").write_text("p")
    assert cli.run(["generate", "--study-plan", str(tmp_path / "plan.md"), "--library-archive", str(tmp_path / "c.txt"), "--output-archive", str(tmp_path / "g.txt")]) == 0
    assert "# FILE 2" in (tmp_path / "g.txt").read_text()


def test_sql_functions(spark):
    from tomeworks.functions import sql

    sql.register(spark)
    assert spark.sql("SELECT tw_safe_path('a/../b') AS p").first().p == "b"
    assert [r.rel_path for r in spark.sql("SELECT * FROM tw_sections('x---\nFilename: a\n---\n1---\nFilename: b\n---\n2')").collect()] == ["a", "b"]


def test_stream(spark, tmp_path):
    from tomeworks.streaming import watch

    src, seen = str(tmp_path / "src"), []
    schema = "archive_id string, rel_path string, content string"
    sink = lambda df: seen.append(sorted(r.archive_id for r in df.collect()))
    for rows in ([("a", "x", "1"), ("b", "y", "2")], [("a", "z", "3")], [("b", "y", "2")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        watch.keep_current(spark.readStream.schema(schema).parquet(src), str(tmp_path / "w"), sink, "S").awaitTermination()
    assert seen == [["a", "b"], ["a"], []]
