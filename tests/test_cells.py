"""Notebooks, Quarto and Databricks, on models written for the test."""

import json

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomeworks.functions import cells

TEXT = '# Raw Cell 1\n"""\n---\ntitle: x\njupyter: r_env\n---\n"""\n\n# Markdown Cell 2\n"""\n# Head\n"""\n\n# Cell 3\nx = 1\n\ny = 2\n\n'


def test_notebook_cells_and_kernel():
    nb = cells.notebook(TEXT)
    assert [c["cell_type"] for c in nb["cells"]] == ["raw", "markdown", "code"]
    assert nb["cells"][2]["source"] == ["x = 1\n", "\n", "y = 2\n"] and nb["cells"][2]["outputs"] == []
    assert nb["metadata"]["kernelspec"] == {"display_name": "r_env", "language": "R", "name": "r_env"}
    assert cells.notebook(TEXT, "python3")["metadata"]["kernelspec"]["name"] == "python3"
    assert list(cells.detect_kernel("library(x)")["kernelspec"].values()) == ["R", "R", "ir"]
    assert cells.detect_kernel("x")["kernelspec"]["display_name"] == "Python 3"


def test_markers_by_first_words_only():
    assert cells.scan("# Cell 1\na\n# Cell phones\nb\n") == [("code", ["a"]), ("code", ["b"])]
    assert cells.scan("# Markdown Cell 1\nno quotes\n# Cell 2\nx\n") == [("code", ["x"])]
    assert cells.scan('# Markdown Cell 1\n"""\nopen') == [("markdown", ["open"])]
    assert cells.scan("# Cell 1\n\n\n") == []


def test_json_text_passes():
    assert cells.notebook('{"cells": []}') == {"cells": []}
    assert cells.notebook("{broken") is None


def test_databricks():
    got = cells.databricks('# Markdown Cell 1\n"""\nhi\n"""\n\n# Cell 2\nx = 1\n\n')
    assert got == "# Databricks notebook source\n# MAGIC %md\n# MAGIC hi\n\n# COMMAND ----------\n\nx = 1"
    assert cells.databricks("# MAGIC %sql", compat=False) == "# MAGIC %sql"
    assert cells.databricks("# MAGIC %sql") == "# Databricks notebook source"


def test_chunk_headers():
    assert cells.chunk_header("r setup, include=FALSE, fig.cap='a, b'") == ("r", "setup", list({"include": "FALSE", "fig.cap": "'a, b'"}.items()))
    assert cells.chunk_header("python") == ("python", None, [])
    assert cells.option_lines("s", [("fig.width", "7"), ("eval", "T")]) == ["#| label: s", "#| fig-width: 7", "#| eval: true"]
    assert cells.split_options("c(1,2), x=[3,4],, 'a,b'") == ["c(1,2)", "x=[3,4]", "'a,b'"]


def test_quarto():
    q = "---\ntitle: T\n---\n\nText\n\n```{r setup, include=FALSE}\nx <- 1\n```\n\nMore\n\n````{python}\n```\n````\n"
    kinds = cells.quarto_cells(q)
    assert [k for k, _ in kinds] == ["raw", "markdown", "code", "markdown", "code"]
    assert kinds[2][1] == "#| label: setup\n#| include: false\nx <- 1" and kinds[4][1] == "```"
    # chunks are written with three backticks, so only code without them is stable
    once = cells.quarto(cells.quarto_text(q.replace("````{python}\n```\n````", "```{python}\ny = 1\n```")))
    assert cells.quarto(cells.quarto_text(once)) == once
    assert cells.quarto_cells("```{r}\n```") == [("code", "")]


@given(st.lists(st.tuples(st.sampled_from(["code", "markdown", "raw"]), st.text("ab \n", min_size=1, max_size=12)), max_size=6))
def test_text_form_round_trip(made):
    made = [(k, s.strip() or "x") for k, s in made]
    text = cells.render([(i, k, s) for i, (k, s) in enumerate(made, 1)])
    assert [(k, "\n".join(b)) for k, b in cells.scan(text)] == made


def test_native_equals_python(spark):
    books = [
        json.dumps({"cells": [{"cell_type": "code", "source": ["a\n", "b"]}, {"cell_type": "markdown", "source": " "}, {"cell_type": "raw", "source": "[1]"}, {"cell_type": "odd", "source": "z"}, {"cell_type": "markdown", "source": "m\n"}]}),
        json.dumps({"cells": []}),
    ]
    rows = spark.createDataFrame([(b,) for b in books], "c string").select(cells.render_cells(cells.read_cells(F.col("c"))).alias("t"), cells.from_notebook(F.col("c")).alias("p"), "c").collect()
    for r in rows:
        assert r.t == r.p == cells.notebook_text(r.c)
    assert cells.notebook_text("{bad") is None and cells.notebook_text("{}") is None
    assert json.loads(cells.without_outputs('{"cells": [{"cell_type": "code", "outputs": [1]}]}'))["cells"][0]["outputs"] == []


def test_kernel_column(spark):
    got = spark.createDataFrame([("ir",), ("r_x",), ("python3",)], "k string").select(cells.kernel_metadata(F.col("k")).alias("m"), "k").collect()
    for r in got:
        assert r.m.kernelspec.language == cells.kernel(r.k)["kernelspec"]["language"]
