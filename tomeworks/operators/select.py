"""Which files go into a corpus."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN_TYPES = (".yaml", ".py", ".r")
FILE_TYPES = (*PLAIN_TYPES, ".ipynb", ".qmd")
EXCLUDED = (".git", ".venv", "build", "__pycache__", ".ipynb_checkpoints", ".pytest_cache")
KEPT = ".gitignore"


def wanted(rel_path: str, types=FILE_TYPES, prefixes=None, subdirs=None, exclude=(), recurse: bool = True) -> bool:
    """The conditions below for one path, so that a reader needn't open what isn't wanted."""
    parts = rel_path.split("/")
    name = parts[-1]
    if recurse and set(parts) & set(exclude):
        return False
    if subdirs and len(parts) > 1 and not any(rel_path.startswith(s.replace("\\", "/").rstrip("/") + "/") for s in subdirs):
        return False
    if name == KEPT:
        return True
    m = re.search(r"^.+(\.[^.]+)$", name)
    return not re.match(r"[.#]", name) and (m[1] if m else "") in (types or ()) and (not prefixes or name.startswith(tuple(prefixes)))


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """From the last dot, which isn't the first character; empty without one. Case counts."""
    return F.regexp_extract(name(path), r"(?s)^.+(\.[^.]+)$", 1)


def of_type(path: Column, types=FILE_TYPES) -> Column:
    return extension(path).isin(*types)


def shown(path: Column) -> Column:
    """Neither hidden nor a lock file."""
    return ~name(path).rlike(r"^[.#]")


def excluded(path: Column, more=()) -> Column:
    """Whether a part of the path, the name included, is an excluded one."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in dict.fromkeys([*EXCLUDED, *more])]))


def below(path: Column, subdirs) -> Column:
    """Below one of the folders, or at the top."""
    if not subdirs:
        return F.lit(True)
    hit = [path.startswith(s.replace("\\", "/").rstrip("/") + "/") for s in subdirs]
    for h in hit[1:]:
        hit[0] = hit[0] | h
    return ~path.contains("/") | hit[0]


def prefixed(path: Column, prefixes) -> Column:
    if not prefixes:
        return F.lit(True)
    hit = [name(path).startswith(p) for p in prefixes]
    for h in hit[1:]:
        hit[0] = hit[0] | h
    return hit[0]


def select(files: DataFrame, types=FILE_TYPES, prefixes=None, subdirs=None, exclude=(), recurse: bool = True) -> DataFrame:
    """Rows of (rel_path, ...) that go into a corpus."""
    path = F.col("rel_path")
    plain = shown(path) & of_type(path, types) & prefixed(path, prefixes)
    out = files.filter((name(path) == KEPT) | plain).filter(below(path, subdirs))
    return out.filter(~excluded(path, exclude)) if recurse else out.filter(~path.contains("/"))


def without_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files that aren't among the root files."""
    return files.join(roots.select("rel_path"), "rel_path", "left_anti")


def quarto_or_notebook(path: Column, content: Column) -> Column:
    """Notebooks, and Quarto documents in cell form."""
    from tomeworks.functions.cells import has_markers

    return path.endswith(".ipynb") | (F.lower(path).rlike(r"\.(qmd|rmd)$") & has_markers(content))
