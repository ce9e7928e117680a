"""A data source for directory trees.

Spark's file sources leave out names that begin with a dot or an underscore, which here are often the point; this one
lists what it is told to. Excluded folders aren't entered, files that the options rule out are never opened, and each
partition reads a batch of files of about PARTITION_BYTES.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tomeworks.functions.text import as_text
from tomeworks.operators import select

PARTITION_BYTES = 32 << 20
SCHEMA = "rel_path string, content binary, size bigint, root boolean"


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, bool]]):
        self.files = files


def _list(value: str | None) -> list[str] | None:
    return [x for x in value.split("\n") if x] if value else None


def relative(path: str, base: str) -> str:
    """Path below base with forward slashes; the bare name if it lies elsewhere."""
    rel = os.path.relpath(os.path.abspath(path), os.path.abspath(base))
    return os.path.basename(path) if rel.split(os.sep)[0] == ".." else rel.replace(os.sep, "/")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.base = options["path"]
        self.types = _list(options.get("file_types"))
        self.prefixes = _list(options.get("prefixes"))
        self.subdirs = _list(options.get("subdirs"))
        self.explicit = _list(options.get("explicit"))
        self.roots = _list(options.get("roots")) or []
        self.exclude = set(_list(options.get("exclude")) or ()) | set(select.EXCLUDED)
        self.recurse = options.get("recurse", "true").lower() == "true"
        self.everything = options.get("everything", "false").lower() == "true"

    def _found(self):
        """(path, relative path, whether it is a root file) of the files to read."""
        if self.explicit is not None:
            for f in self.explicit:
                path = f if os.path.isabs(f) else os.path.join(self.base, f)
                if os.path.isfile(path):
                    yield path, relative(path, self.base), False
            return
        seen = set()
        for f in self.roots:
            path = f if os.path.isabs(f) else os.path.join(self.base, f)
            name = os.path.basename(path)
            if os.path.isfile(path) and not (name[:1] in ".#" and name != ".gitignore"):
                seen.add(os.path.realpath(path))
                yield path, relative(path, self.base), True
        for folder, dirs, files in os.walk(self.base):
            dirs[:] = sorted(d for d in dirs if self.everything or d not in self.exclude) if self.recurse else []
            for name in sorted(files):
                path = os.path.join(folder, name)
                rel = relative(path, self.base)
                if os.path.isfile(path) and os.path.realpath(path) not in seen and (self.everything or select.wanted(rel, self.types, self.prefixes, self.subdirs, self.exclude, self.recurse)):
                    yield path, rel, False

    def partitions(self):
        if not os.path.isdir(self.base):
            raise FileNotFoundError(f"no directory: {self.base}")
        out, size = [[]], 0
        for entry in self._found():
            n = os.path.getsize(entry[0])
            if out[-1] and size + n > PARTITION_BYTES:
                out.append([])
                size = 0
            out[-1].append(entry)
            size += n
        return [_Files(files) for files in out]

    def read(self, partition):
        for path, rel, root in partition.files:
            try:
                with open(path, "rb") as f:
                    data = f.read()
            except OSError as e:
                data = b"# Error reading file: " + str(e).encode() + b"\n\n"
            yield rel, data, len(data), root


class TreeSource(DataSource):
    """Format `tree`: (rel_path, content, size, root) of the files below `path`."""

    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def scan(spark: SparkSession, path: str, file_types=None, recurse: bool = True, prefixes=None, subdirs=None, exclude=None, roots=None, explicit=None, everything: bool = False) -> DataFrame:
    """Files of a directory that all executors can read. `explicit` bypasses every filter and keeps repeated entries."""
    from tomeworks.session import attach

    attach(spark).dataSource.register(TreeSource)
    reader = spark.read.format("tree").option("path", path).option("recurse", str(recurse).lower()).option("everything", str(everything).lower())
    for name, value in (("file_types", select.FILE_TYPES if file_types is None else file_types), ("prefixes", prefixes), ("subdirs", subdirs), ("exclude", exclude), ("roots", roots), ("explicit", explicit)):
        if value:
            reader = reader.option(name, "\n".join(value))
    return reader.load()


def read_archive(spark: SparkSession, path: str, numeric: bool = True) -> str | None:
    """Text of an archive: one file, or a folder of parts. None if it holds no table of contents.

    Parts are put together in the order of their numbers; numeric=False takes names as text, so that part 10 comes before 2.
    """
    if os.path.isdir(path):
        names = [n for n in os.listdir(path) if n.endswith(".txt")]
        number = lambda n: int((re.findall(r"_part(\d+)", n) or ["0"])[-1])
        names.sort(key=(lambda n: (re.sub(r"_part\d+", "", n), number(n))) if numeric else None)
        got = scan(spark, path, explicit=names).select("rel_path", as_text(F.col("content")).alias("t")) if names else None
        by = {r.rel_path: r.t for r in got.collect()} if got is not None else {}
        lines = [line for n in names for line in by[n].split("\n") if line.strip() not in ("<DOCUMENT>", "</DOCUMENT>") and not line.startswith("# Part ")]
        text = "\n".join(lines)
    else:
        rows = scan(spark, os.path.dirname(os.path.abspath(path)), explicit=[os.path.basename(path)]).select(as_text(F.col("content")).alias("t")).collect()
        if not rows:
            raise FileNotFoundError(path)
        text = rows[0].t
    return text if "TABLE OF CONTENTS" in text else None
