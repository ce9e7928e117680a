"""Writing files: names are settled in the plan, executors write to a folder that all of them see."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeworks.functions.arrow import udf

RULES = ("suffix", "stem", "skip", "replace")


def inside(rel_path: str) -> str | None:
    """The path with its dots resolved; None if it is absolute or leads out of the folder."""
    path = posixpath.normpath(rel_path.replace("\\", "/"))
    if path.startswith(("/", "..")) and (path[:3] in ("..", "../") or path[0] == "/") or path == "." or re.match(r"[A-Za-z]:", path):
        return None
    return path


safe_path = udf(inside, "string")


def target(path: Column, exists: Column, rule: str) -> Column:
    """Where a file goes if its name may be taken: `a.py_copy`, `a_copy.py`, nowhere (null), or over what is there."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    if rule == "replace":
        return path
    if rule == "skip":
        return F.when(~exists, path)
    other = F.concat(path, F.lit("_copy")) if rule == "suffix" else F.regexp_replace(path, r"^((?:.*/)?[^/]+?)(\.[^./]+)?$", "$1_copy$2")
    return F.when(exists, other).otherwise(path)


def write(files: DataFrame, folder: str, rule: str = "suffix", changed_only: bool = False) -> list[str]:
    """Write (rel_path, content) below folder; the paths written. Paths that lead out are left out; taken names follow the rule.

    With changed_only, files whose content is the same but for date lines aren't touched.
    """
    os.makedirs(folder, exist_ok=True)
    rows = files.select(safe_path(F.col("rel_path")).alias("rel_path"), F.col("content").cast("binary").alias("content")).filter("rel_path IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for rel, content in zip(b["rel_path"].to_pylist(), b["content"].to_pylist()):
                path = os.path.join(folder, rel)
                if os.path.exists(path) and not changed_only:
                    if rule == "skip":
                        continue
                    if rule == "suffix":
                        path += "_copy"
                    elif rule == "stem":
                        stem, ext = os.path.splitext(path)
                        path = f"{stem}_copy{ext}"
                if changed_only and os.path.exists(path):
                    with open(path, "rb") as f:
                        if undated(f.read()) == undated(content):
                            continue
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, path)  # a task that is run again leaves no half files
                done.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["path"])

    return [r.path for r in rows.mapInArrow(run, "path string").collect()]


def undated(content: bytes) -> bytes:
    return b"\n".join(line for line in content.split(b"\n") if not line.startswith((b"# Archive created on:", b"# Date:")))


def remove_stale(folder: str, stem: str, ext: str, keep: list[str]) -> list[str]:
    """Delete parts of an archive that weren't written now, and a part without number that others took the place of; what is to keep never is one."""
    gone = []
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        if re.fullmatch(re.escape(stem) + r"(?:_part\d+)?" + re.escape(ext), name) and os.path.abspath(path) not in {os.path.abspath(k) for k in keep}:
            os.unlink(path)
            gone.append(path)
    return gone
