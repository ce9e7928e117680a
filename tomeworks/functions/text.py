"""Text expressions whose results equal those of Python's str methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.split() and str.strip() see it, for use in Java patterns with (?U).
WS = r"[\s\x1c-\x1f]"
#: Where str.splitlines() breaks.
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def as_text(content: Column) -> Column:
    """Text of UTF-8 bytes: malformed sequences become U+FFFD, line ends become newlines."""
    valid = F.make_valid_utf8(content.cast("string"))
    return F.regexp_replace(valid, r"\r\n?", "\n")


def words(text: Column) -> Column:
    """Number of words, runs of characters other than white space; null for null."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"), 0)).cast("bigint") + F.when(text.isNull(), F.lit(None).cast("bigint")).otherwise(F.lit(0))


def estimated_tokens(text: Column) -> Column:
    """Characters divided by four, rounded down."""
    return F.floor(F.length(text) / 4).cast("bigint")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{WS}+|{WS}+\z", "")


def lines(text: Column) -> Column:
    """Lines as str.splitlines() gives them: no empty one after a final break, none for an empty text."""
    body = F.regexp_replace(text, rf"(?:{BREAK})\z", "")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(body, BREAK, -1))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often use names it. No Python UDF may be inside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def replace_each(text: Column, pattern: str, change, group: int = 0) -> Column:
    """text with each match of the pattern replaced by change(match), a column; matches aren't read again."""

    def put(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), group)
        return let(found, lambda f: F.array_join(F.transform(F.split(t, pattern, -1), lambda part, i: F.concat(part, F.coalesce(change(F.get(f, i)), F.lit("")))), ""))

    return let(text, lambda t: F.when(t.rlike(pattern), put(t)).otherwise(t))


def content_key(text: Column) -> Column:
    """SHA-256 of the text without lines that carry the date of a run."""
    rest = F.filter(F.split(text, "\n", -1), lambda line: ~(line.startswith("# Archive created on:") | line.startswith("# Date:")))
    return F.sha2(F.array_join(rest, "\n").cast("binary"), 256)
