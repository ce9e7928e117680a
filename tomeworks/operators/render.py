"""Rendering corpora as archives: numbered sections, tables of contents, whole texts and their summaries.

Section rows are the primary form: they need no shuffle beyond the numbering. A whole archive is one string and has its limits.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeworks.functions import cells, html, images
from tomeworks.functions.text import as_text, estimated_tokens, words
from tomeworks.operators import select
from tomeworks.session import stored

RULE = "#" * 80
STANDARD = "---\nFilename: "
LLM = f"{RULE}\n# FILE "
DIRECTORY = "---\nDirectory: "
CONTENTS = "# TABLE OF CONTENTS\n"
#: Bytes of one value, at most, in the JVM with what its row needs besides.
MOST_BYTES = 2**31 - 64
#: Kinds of files that are converted when they are read.
_PAGES, _NOTEBOOKS, _QUARTO = ".html", ".ipynb", r"(?i)\.(qmd|rmd)$"


def converted(files: DataFrame, extract_code_only: bool = False) -> DataFrame:
    """(rel_path, content STRING) of (rel_path, content BINARY, root): each file as an archive holds it. Malformed notebooks are left out."""
    path = F.col("rel_path")
    ext = F.when(F.col("root") if "root" in files.columns else F.lit(False), "").otherwise(select.extension(path))
    read = files.select("rel_path", as_text(F.col("content")).alias("text"), ext.alias("ext"))
    # pages pass through the UDF whether they hold images or not, so their text is stripped once
    of = lambda when: F.when(when, F.col("text"))
    page, notebook, quarto = F.col("ext") == _PAGES, F.col("ext") == _NOTEBOOKS, F.col("ext").rlike(_QUARTO) & F.lit(extract_code_only)
    made = {"noted": images.with_placeholders(F.when(page, html.without_boilerplate(F.col("text")))), "cells": (cells.from_notebook if extract_code_only else cells.strip_outputs)(of(notebook))}
    if extract_code_only:
        made["chunks"] = cells.from_quarto(of(quarto))
    read = read.withColumns(made)
    chosen = lambda of_page: F.when(notebook, F.col("cells")).when(page, of_page).when(quarto, F.col("chunks" if extract_code_only else "text")).otherwise(F.col("text"))
    # a page always has content; a filter on it would make it twice
    kept = read.filter(chosen(F.lit("")).isNotNull())
    return kept.select("rel_path", chosen(html.markdown(F.col("noted"))).alias("content"))


def numbered(files: DataFrame, archive: str = "archive_id") -> DataFrame:
    """Rows with `pos`, from 1 in the order of rel_path within each archive; paths that repeat have numbers one after the other.

    Only (archive, path) is put in order, by ranges, so neither contents nor an archive's paths meet in one task; numbers are joined back.
    """
    spark = files.sparkSession
    keys = files.groupBy(archive, "rel_path").agg(F.count("*").alias("many_"))
    ranged, _ = stored(keys.repartitionByRange(archive, "rel_path").withColumn("range_", F.spark_partition_id()), "paths")
    sizes = ranged.groupBy(archive, "range_").agg(F.sum("many_").alias("size_"))
    before = sizes.withColumn("before_", F.coalesce(F.sum("size_").over(Window.partitionBy(archive).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size_")
    inside = F.sum("many_").over(Window.partitionBy(archive, "range_").orderBy("rel_path").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.withColumn("last_", inside).join(before, [archive, "range_"]).select(F.col(archive).alias("a_"), F.col("rel_path").alias("p_"), "many_", (F.col("last_") + F.col("before_")).cast("int").alias("pos"))
    joined = files.join(placed, files[archive].eqNullSafe(F.col("a_")) & files["rel_path"].eqNullSafe(F.col("p_"))).drop("a_", "p_")
    if not ranged.filter("many_ > 1").limit(1).count():
        return joined.drop("many_")
    again = F.col("pos") + 1 - F.row_number().over(Window.partitionBy(archive, "rel_path").orderBy(F.lit(0)))
    return joined.filter("many_ = 1").unionByName(joined.filter("many_ > 1").withColumn("pos", again.cast("int"))).drop("many_")


def escape(content: Column) -> Column:
    """Content in which no standard section begins."""
    return F.replace(content, F.lit(STANDARD), F.lit("---\\nFilename: "))


def section(pos: Column, path: Column, content: Column, llm: bool) -> Column:
    if llm:
        return F.concat(F.lit(LLM), pos.cast("string"), F.lit(": "), path, F.lit(f"\n{RULE}\n\n"), content, F.lit("\n\n"))
    return F.concat(F.lit(STANDARD), path, F.lit("\n---\n"), escape(content), F.lit("\n\n"))


def header(stamp: Column, name: Column, llm: bool) -> Column:
    """Head of an archive; the stamp is text, so that results don't depend on the clock."""
    first = F.concat(F.lit("# Archive created on: "), stamp, F.lit("\n\n"))
    if not llm:
        return F.concat(first, F.lit("# Standard Archive Format\n\n"))
    return F.concat(first, F.lit("# LLM-FRIENDLY CODE ARCHIVE\n# Generated from: "), name, F.lit("\n# Date: "), stamp, F.lit("\n\n"))


def contents(entries: Column) -> Column:
    """Table of contents from the sorted array of structs with pos and rel_path."""
    lines = F.transform(entries, lambda e: F.concat(e["pos"].cast("string"), F.lit(". "), e["rel_path"]))
    return F.concat(F.lit(CONTENTS), F.array_join(lines, "\n"), F.lit("\n\n"))


def sections(files: DataFrame, llm: bool = False) -> DataFrame:
    """(archive_id, pos, rel_path, section) of (archive_id, rel_path, content)."""
    return numbered(files).select("archive_id", "pos", "rel_path", section(F.col("pos"), F.col("rel_path"), F.col("content"), llm).alias("section"))


def archives(files: DataFrame, llm: bool = False, stamp: str | Column = "", name: Column | None = None) -> DataFrame:
    """(archive_id, n_files, text): one row for each archive."""
    rows = sections(files, llm).groupBy("archive_id").agg(F.array_sort(F.collect_list(F.struct("pos", "rel_path", "section"))).alias("s"))
    head = header(F.lit(stamp) if isinstance(stamp, str) else stamp, name if name is not None else F.col("archive_id"), llm)
    return rows.select("archive_id", F.size("s").alias("n_files"), F.concat(head, contents(F.col("s")), F.array_join(F.col("s.section"), "")).alias("text"))


def summary(files: DataFrame) -> DataFrame:
    """(archive_id, n_files, chars, est_tokens, words): what rendering would take. Texts are measured where they are read."""
    measured = files.select("archive_id", F.length("content").cast("bigint").alias("chars"), words(F.col("content")).alias("words"))
    total = measured.groupBy("archive_id").agg(F.count("*").alias("n_files"), F.sum("chars").alias("chars"), F.sum("words").alias("words"))
    return total.select("archive_id", "n_files", "chars", F.floor(F.col("chars") / 4).cast("bigint").alias("est_tokens"), "words")


def manifest(files: DataFrame) -> DataFrame:
    """(archive_id, pos, rel_path, chars, est_tokens, words) of each file."""
    content = F.col("content")
    measured = files.select("archive_id", "rel_path", F.length(content).cast("bigint").alias("chars"), estimated_tokens(content).alias("est_tokens"), words(content).alias("words"))
    return numbered(measured).select("archive_id", "pos", "rel_path", "chars", "est_tokens", "words")


def concatenated(files: DataFrame) -> DataFrame:
    """(archive_id, text) in the older form: sections alone, neither head nor table of contents, content as it is."""
    part = F.concat(F.lit(STANDARD), F.col("rel_path"), F.lit("\n---\n"), F.col("content"), F.lit("\n\n"))
    rows = files.groupBy("archive_id").agg(F.array_sort(F.collect_list(F.struct("rel_path", part.alias("section")))).alias("s"))
    return rows.select("archive_id", F.array_join(F.col("s.section"), "").alias("text"))


def combined(archives_: DataFrame) -> DataFrame:
    """(text): all archives (archive_id, text) in one, each under its directory's name."""
    part = F.concat(F.lit(DIRECTORY), F.col("archive_id"), F.lit("\n---\n"), F.col("text"), F.lit("\n\n"))
    return _one_text(archives_.select("archive_id", part.alias("section")), ["archive_id", "section"])


def combined_rows(files: DataFrame) -> DataFrame:
    """(archive_id, kind, rel_path, section): a combined archive of (archive_id, rel_path, content) as rows, which in the order of the four columns are its text.

    Kind 0 is a directory's name, 1 are its sections in the older form, 2 is its end. No mark begins in one row and ends in another.
    """
    named = files.filter("archive_id IS NOT NULL")
    part = F.concat(F.lit(STANDARD), F.col("rel_path"), F.lit("\n---\n"), F.col("content"), F.lit("\n\n"))
    ids, nothing = named.select("archive_id").distinct(), F.lit(None).cast("string").alias("rel_path")
    begin = ids.select("archive_id", F.lit(0).alias("kind"), nothing, F.concat(F.lit(DIRECTORY), "archive_id", F.lit("\n---\n")).alias("section"))
    end = ids.select("archive_id", F.lit(2).alias("kind"), nothing, F.lit("\n\n").alias("section"))
    return begin.unionByName(named.select("archive_id", F.lit(1).alias("kind"), "rel_path", part.alias("section"))).unionByName(end)


def combined_files(files: DataFrame) -> DataFrame:
    """combined(concatenated(files)), without making the archives' texts first."""
    return _one_text(combined_rows(files), ["archive_id", "kind", "rel_path", "section"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All sections in one text, which is built once and handed over without a copy."""
    text = bytearray()
    for b in batches:
        for section in b["section"].cast(pa.binary()).to_pylist():
            text += section or b""
        if len(text) > MOST_BYTES:
            raise ValueError(f"a combined archive of more than {MOST_BYTES} bytes can't be one value; combined_rows() has it as rows")
    sizes = pa.py_buffer(np.array([0, len(text)], np.int32))
    yield pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(1, sizes, pa.py_buffer(text))], names=["text"])


def _one_text(rows: DataFrame, order: list[str]) -> DataFrame:
    """(text): one row, of all sections in order; empty if there are none.

    Rows are sorted on disk if need be, and joined outside the heap: there the text is one value, and the row that holds it.
    """
    # a row without a section, so that there is a task
    seed = rows.sparkSession.range(1).select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    return rows.unionByName(seed).repartition(1).sortWithinPartitions(*order).mapInArrow(_joined, "text string")


def now() -> str:
    return datetime.datetime.now().isoformat(" ", "seconds")
