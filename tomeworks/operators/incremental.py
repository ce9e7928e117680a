"""Doing again only what has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeworks.functions.text import content_key


def keyed(rows: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """(name, key) of each output; the key doesn't depend on the date lines."""
    return rows.select(F.col(name).alias("name"), content_key(F.col(text)).alias("key"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of `now` (name, key, ...) that `before` (name, key) doesn't have in the same form."""
    return now.join(before.select("name", "key"), ["name", "key"], "left_anti")


def stale(now: DataFrame, before: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(name) of outputs before that aren't made any more. Names to `keep`, such as the archive's own, never are stale."""
    gone = before.select("name").join(now.select("name"), "name", "left_anti").distinct()
    return gone.filter(~F.col("name").isin(*keep)) if keep else gone
