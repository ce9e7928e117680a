"""Cutting archives into parts of bounded size, in words, along sections or lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeworks.functions.text import lines, words
from tomeworks.operators.parse import literal
from tomeworks.operators.render import CONTENTS, LLM, STANDARD, archives, header, numbered, section
from tomeworks.session import stored

MAX_WORDS = 10_000
ARCHIVE_WORDS, INGEST_WORDS = 100_000, 75_000


#: What an open part is: its number, the words in it, and whether it holds something.
State = tuple[int, int, bool]


def next_fit(sizes: np.ndarray, most: int, head: int = 0, blank_starts: bool = True) -> np.ndarray:
    """Part, from 1, of each item in order: a part is closed when the next item doesn't fit and it holds something.

    `head` words open part 1. Without blank_starts, an item of no words doesn't count as something.
    """
    return resumed(sizes, most, (1, int(head), head > 0), blank_starts)[0]


def resumed(sizes: np.ndarray, most: int, state: State, blank_starts: bool = True) -> tuple[np.ndarray, State]:
    """next_fit() from an open part on: (parts, the part that is open afterwards)."""
    total = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = np.empty(len(sizes), np.int64)
    part, size, held = state
    at, base = 0, -size
    while at < len(sizes):
        begin = at
        if not held:  # the first item goes in whatever its size; blank ones too, until there is something
            at += 1
            while not blank_starts and at < len(sizes) and total[at] == total[begin]:
                at += 1
        end = max(at, int(np.searchsorted(total, base + most, "right")) - 1)
        out[begin:end] = part
        at = end
        if at < len(sizes):
            part, base, held = part + 1, int(total[at]), False
    size = int(total[-1] - base)
    return out, (part, size, blank_starts and (held or len(sizes) > 0) or size > 0)


def _parts(most: int, blank_starts: bool):
    """Parts of rows sorted by archive and position; an archive may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple[str, State] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            names, words, heads = b["archive_id"].to_pylist(), b["words"].to_numpy(), b["head"].to_numpy()
            code = b["archive_id"].dictionary_encode().indices.fill_null(-1).to_numpy()
            begins = np.flatnonzero(np.append(True, code[1:] != code[:-1])).tolist()
            out = np.empty(b.num_rows, np.int64)
            for s, e in zip(begins, [*begins[1:], b.num_rows]):
                state = open_[1] if open_ and open_[0] == names[s] else (1, int(heads[s]), heads[s] > 0)
                out[s:e], state = resumed(words[s:e], most, state, blank_starts)
                open_ = (names[s], state)
            yield pa.RecordBatch.from_arrays([b["archive_id"], b["pos"], pa.array(out)], names=["archive_id", "pos", "part"])

    return run


def assign(rows: DataFrame, most: int, blank_starts: bool = False) -> DataFrame:
    """(archive_id, pos, part) of (archive_id, pos, words, head): numbers alone are shuffled, and an archive's are read once, in order."""
    flat = rows.select(F.col("archive_id").cast("string").alias("archive_id"), *[F.col(c).cast("bigint").alias(c) for c in ("pos", "words", "head")])
    return flat.repartition("archive_id").sortWithinPartitions("archive_id", "pos").mapInArrow(_parts(most, blank_starts), "archive_id string, pos bigint, part bigint")


def split(archives: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """(archive_id, part, name, text, words) of (archive_id, text): along LLM sections, else standard ones, else lines.

    Texts of at most `most` words are one part without a number. A section that is larger by itself stays whole.
    """
    total = archives.withColumn("total", words(F.col("text")))
    small = total.filter(F.col("total") <= most).select("archive_id", F.lit(0).cast("bigint").alias("part"), "text")
    big = total.filter(F.col("total") > most).withColumn("mark", F.when(F.col("text").contains(LLM), LLM).when(F.col("text").contains(STANDARD), STANDARD))
    made = []
    for mark in (LLM, STANDARD):
        pieces = big.filter(F.col("mark") == mark).select("archive_id", F.posexplode(F.split("text", literal(mark), -1)).alias("pos", "piece"))
        made.append(pieces.select("archive_id", "pos", F.when(F.col("pos") == 0, F.col("piece")).otherwise(F.concat(F.lit(mark), "piece")).alias("piece"), F.lit("").alias("glue")))
    by_line = big.filter("mark IS NULL").select("archive_id", F.posexplode(lines(F.col("text"))).alias("pos", "piece")).withColumn("glue", F.lit("\n"))
    pieces = made[0].unionByName(made[1])
    sized = pieces.withColumn("words", words(F.col("piece"))).withColumn("head", F.lit(0))
    along = assign(sized, most)
    of_lines = assign(by_line.withColumn("words", words(F.col("piece"))).withColumn("head", F.lit(0)), most, True)
    placed = pieces.join(along, ["archive_id", "pos"]).unionByName(by_line.join(of_lines, ["archive_id", "pos"]))
    rows = placed.groupBy("archive_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("s"), F.first("glue").alias("glue"))
    parts = rows.select("archive_id", "part", F.when(F.col("glue") == "\n", F.array_join("s.piece", "\n")).otherwise(F.array_join("s.piece", "")).alias("text"))
    parts = parts.filter((F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]")))
    return small.unionByName(parts).select("archive_id", "part", _name(F.col("part")).alias("name"), "text", words(F.col("text")).alias("words"))


def _name(part: Column) -> Column:
    return F.when(part == 0, F.col("archive_id")).otherwise(F.concat("archive_id", F.lit("_part"), part.cast("string")))


def _measured(text: Column) -> Column:
    """Each piece of a section along LLM marks: words, characters, whether its last word goes on in the next piece."""
    size = lambda p: F.struct(words(p).alias("words"), F.length(p).cast("bigint").alias("chars"), F.substring(p, -1, 1).rlike(r"(?U)[^\s\x1c-\x1f]").cast("bigint").alias("goes_on"))
    pieces = F.split(text, literal(LLM), -1)
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: size(F.concat(F.lit(LLM), p)))


def split_sizes(files: DataFrame, most: int = MAX_WORDS, stamp: str = "") -> DataFrame:
    """(archive_id, part, name, words, chars) of split() of the LLM archives of (archive_id, rel_path, content), without making these.

    Files are measured where they are read, and numbers alone are shuffled. Archives whose head holds a mark, and those without sections, are cut as texts.
    """
    path, head = F.col("rel_path"), F.concat(header(F.lit(stamp), F.col("archive_id"), True), F.lit(CONTENTS))
    named = files.filter("archive_id IS NOT NULL")
    # a section has as many words whatever its number, and a character for each digit
    rows = named.select("archive_id", "rel_path", _measured(section(F.lit(1), path, F.col("content"), True)).alias("pieces"))
    rows, _ = stored(numbered(rows), "sections")
    entry = F.concat(F.col("pos").cast("string"), F.lit(". "), path)
    heads = rows.groupBy("archive_id").agg(
        F.sum(words(entry)).alias("words"), F.sum(F.length(entry) + 1).alias("chars"), F.max(F.coalesce(path.contains(LLM), F.lit(False))).alias("marked"), F.max(F.col("pieces").isNotNull()).alias("any"),
    )
    heads, _ = stored(heads.select("archive_id", (head.contains(LLM) | F.col("marked") | ~F.col("any")).alias("odd"), (words(head) + F.col("words")).alias("words"), (F.length(head) + F.col("chars") + 1).alias("chars")), "heads")
    odd = heads.filter("odd").select("archive_id")
    first, zero = heads.filter("NOT odd").select("archive_id", F.lit(0).cast("bigint").alias("pos"), "words", "chars", F.lit(0).cast("bigint").alias("inside")), F.lit(0).cast("bigint")
    each = rows.select("archive_id", "pos", "pieces", F.posexplode("pieces").alias("i", "p"))
    at = F.col("pos").cast("bigint") * 2**31 + F.col("i")
    digits = F.when(F.col("i") == 0, F.length(F.col("pos").cast("string")) - 1).otherwise(0)
    # a piece begins inside a word if the one before it in its section ends so; sections end in newlines
    inside = F.when(F.col("i") > 0, F.get("pieces", F.col("i") - 1)["goes_on"]).otherwise(zero)
    pieces = first.unionByName(each.select("archive_id", at.alias("pos"), F.col("p.words").alias("words"), (F.col("p.chars") + digits).alias("chars"), inside.alias("inside")).join(odd, "archive_id", "left_anti"))
    whole = pieces.groupBy("archive_id").agg(F.sum(F.col("words") - F.col("inside")).alias("words"), F.sum("chars").alias("chars"))
    small = whole.filter(F.col("words") <= most).select("archive_id", zero.alias("part"), "words", "chars")
    placed = pieces.join(assign(pieces.withColumn("head", F.lit(0)), most), ["archive_id", "pos"]).groupBy("archive_id", "part")
    parts = placed.agg((F.sum(F.col("words") - F.col("inside")) + F.min_by("inside", "pos")).alias("words"), F.sum("chars").alias("chars"))
    parts = parts.filter("words > 0").join(small.select("archive_id"), "archive_id", "left_anti")
    out = small.unionByName(parts).select("archive_id", "part", _name(F.col("part")).alias("name"), "words", "chars")
    if not odd.limit(1).count():
        return out
    texts = split(archives(named.join(odd, "archive_id", "left_semi"), True, stamp).select("archive_id", "text"), most)
    return out.unionByName(texts.select("archive_id", "part", "name", "words", F.length("text").cast("bigint").alias("chars")))
