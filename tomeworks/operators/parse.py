"""Taking archives apart again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeworks.functions import cells
from tomeworks.functions.text import strip
from tomeworks.operators.render import DIRECTORY, LLM, STANDARD
from tomeworks.operators.select import extension, quarto_or_notebook

#: Characters that the format is told by.
WINDOW = 2000
#: What ends the name of a section or a directory.
RULE = "\n---\n"


def literal(s: str) -> str:
    return "\\Q" + s + "\\E"


def after(text: Column, mark: str) -> Column:
    """What follows the first occurrence of the mark; null without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def _pieces(archives: DataFrame, mark: str) -> DataFrame:
    parts = archives.select("archive_id", F.posexplode(F.split("text", literal(mark), -1)).alias("pos", "piece"))
    return parts.filter("pos > 0")


def standard(archives: DataFrame) -> DataFrame:
    """(archive_id, pos, rel_path, content) of the standard sections of (archive_id, text); malformed ones are left out.

    The content keeps its trailing newlines and its escapes.
    """
    body = _pieces(archives, STANDARD).withColumn("content", after(F.col("piece"), RULE)).filter("content IS NOT NULL")
    return body.select("archive_id", "pos", _cleaned(F.substring_index("piece", RULE, 1)).alias("rel_path"), "content")


def _cleaned(path: Column) -> Column:
    return F.regexp_replace(F.translate(strip(path), "\\", "/"), "/+", "/")


def llm(archives: DataFrame) -> DataFrame:
    """Like standard(), of LLM sections; newlines before the content are dropped."""
    body = _pieces(archives, LLM).withColumn("content", after(after(F.col("piece"), "\n"), "\n")).filter("content IS NOT NULL")
    first = F.substring_index("piece", "\n", 1)
    path = strip(after(first, ": "))
    return body.select("archive_id", "pos", path.alias("rel_path"), F.regexp_replace("content", r"\A\n+", "").alias("content")).filter("rel_path IS NOT NULL")


def sections(archives: DataFrame) -> DataFrame:
    """(archive_id, pos, rel_path, content, is_llm): LLM sections where an archive holds any, else standard ones."""
    has = F.col("text").contains(LLM)
    one = llm(archives.filter(has)).withColumn("is_llm", F.lit(True))
    return one.unionByName(standard(archives.filter(~has)).withColumn("is_llm", F.lit(False)))


def detected(text: Column, window: int | None = WINDOW) -> Column:
    """`llm-friendly` or `standard`, told by the first characters; by the whole text if window is None, as long tables of contents need."""
    seen = text if window is None else F.substring(text, 1, window)
    return F.when(seen.contains(LLM), "llm-friendly").otherwise("standard")


def valid(text: Column) -> Column:
    """Whether there is a table of contents and an LLM section."""
    return text.contains("TABLE OF CONTENTS") & text.contains(LLM)


def combined(archive: DataFrame) -> DataFrame:
    """(archive_id, pos, rel_path, content): both levels of a combined archive (text)."""
    outer = archive.select(F.posexplode(F.split("text", literal(DIRECTORY), -1)).alias("n", "piece")).filter("n > 0")
    inner = outer.select(F.substring_index("piece", RULE, 1).alias("archive_id"), after(F.col("piece"), RULE).alias("text")).filter("text IS NOT NULL")
    return standard(inner)


class _Reader:
    """A combined archive read bit by bit: what is open goes on in the next bit, but no mark does."""

    def __init__(self) -> None:
        self.found: list[tuple[str, int, str, str]] = []
        self.directory: str | None = None
        self.naming, self.pos, self.open = False, 0, ""

    def read(self, text: str) -> None:
        first, *others = text.split(DIRECTORY)
        self._inside(first)
        for piece in others:
            self.close()
            self.directory, self.naming, self.open = None, True, ""
            self._inside(piece)

    def _inside(self, text: str) -> None:
        if self.naming:
            name, there, text = (self.open + text).partition(RULE)
            if not there:
                self.open = name
                return
            self.directory, self.naming, self.pos, self.open = name, False, 0, ""
        first, *others = text.split(STANDARD)
        self.open += first
        for piece in others:
            self.close()
            self.pos, self.open = self.pos + 1, piece

    def close(self) -> None:
        """What is open is over: a section if it stands in a directory behind a mark and has a name."""
        if self.directory is not None and self.pos:
            path, there, content = self.open.partition(RULE)
            if there:
                self.found.append((self.directory, self.pos, path, content))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sections of rows sorted by archive and in its order."""
    reader = _Reader()

    def done() -> Iterator[pa.RecordBatch]:
        if reader.found:
            columns = [pa.array(c, t) for c, t in zip(zip(*reader.found), (pa.string(), pa.int32(), pa.string(), pa.string()))]
            reader.found = []
            yield pa.RecordBatch.from_arrays(columns, names=["archive_id", "pos", "path", "content"])

    for b in batches:
        for section in b["section"].to_pylist():
            if section is not None:
                reader.read(section)
        yield from done()
    reader.close()
    yield from done()


def combined_rows(rows: DataFrame) -> DataFrame:
    """combined() of render.combined_rows(): the same sections, and no text of a whole archive is made.

    Directories are read in order, each in one task, of which no more than a batch is in memory.
    """
    order = ["archive_id", "kind", "rel_path", "section"]
    valid = rows.withColumn("section", F.make_valid_utf8("section"))
    found = valid.repartition("archive_id").sortWithinPartitions(*order).select("section").mapInArrow(_read, "archive_id string, pos int, path string, content string")
    return found.select("archive_id", "pos", _cleaned(F.col("path")).alias("rel_path"), "content")


def restored(rows: DataFrame, kernel: str | None = None) -> DataFrame:
    """Rows of sections() as files: notebooks and Databricks sources of LLM archives are put together again."""
    path, content = F.col("rel_path"), F.col("content")
    notebook = F.col("is_llm") & (extension(path) == ".ipynb")
    bricks = F.col("is_llm") & (extension(path) == ".py") & cells.is_databricks(content)
    args = (F.lit(kernel),) if kernel else ()
    out = F.when(notebook, cells.to_notebook(F.when(notebook, content), *args)).when(bricks, cells.to_databricks(F.when(bricks, content))).otherwise(content)
    return rows.withColumn("content", out).filter("content IS NOT NULL")


def notebooks(rows: DataFrame, kernel: str | None = None, quarto: bool = False) -> DataFrame:
    """(archive_id, rel_path, content) of the notebooks among sections(); Quarto documents in cell form become notebooks too.

    With `quarto`, they become Quarto documents again, those without cells stay as they are.
    """
    path, content = F.col("rel_path"), F.col("content")
    args = (F.lit(kernel),) if kernel else ()
    if not quarto:
        found = rows.filter(quarto_or_notebook(path, content))
        return found.select("archive_id", F.regexp_replace(path, r"(?i)\.(qmd|rmd)$", ".ipynb").alias("rel_path"), cells.to_notebook(content, *args).alias("content")).filter("content IS NOT NULL")
    found = rows.filter(path.endswith(".ipynb") | path.endswith(".qmd"))
    is_nb = path.endswith(".ipynb")
    language = "python" if kernel and cells.kernel(kernel)["language_info"]["name"] == "python" else "r"
    form = F.col("is_llm") & ~is_nb & cells.has_markers(content)
    out = F.when(is_nb, cells.to_notebook(F.when(is_nb, content), *args)).when(form, cells.to_quarto(F.when(form, content), F.lit(language))).otherwise(content)
    return found.select("archive_id", "rel_path", out.alias("content")).filter("content IS NOT NULL")
