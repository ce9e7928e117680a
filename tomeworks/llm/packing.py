"""Sum-of-squares packing of documents into sequences of fixed length.

A document longer than a sequence is cut; its full pieces are sequences by themselves, its rest is packed. Every
other piece goes where the sum over residual gaps g of N(g)**2 becomes smallest, N(g) being the number of open bins
whose gap is g (full bins don't count). Ties go to the smallest gap, a new bin last.

The rule is sequential, so pieces are spread by a hash over shards of about `shard_docs` documents and each shard is packed by
itself: the number of shards follows the input, the open bins that a shard leaves are few beside it. Rows of the same id and
length are counted first and cut into RUN at a time, as is a long document's row of pieces, so no id fills a shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeworks.llm.common import col

CAPACITY = 2048
SHARD_DOCS = 50_000
#: Rows of one id and length, or pieces of one document, that stay together.
RUN = 1000
FIELDS = ["piece", "start", "length", "bin_id", "offset"]
SCHEMA = "doc_id bigint, piece int, start bigint, length int, bin_id bigint, offset int"


def word_count(text: Column) -> Column:
    """Number of words, runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def pack(sizes, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it) of each item, in the order given, and each bin's final gap."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, np.float64)  # open bins by gap; n[0] and n[capacity] stay 0
    closed = np.full(capacity + 1, np.inf)
    closed[capacity] = 0  # inf where no bin has that gap; a new bin can always be had
    bins, offsets, gaps = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for i, s in enumerate(sizes):
        s = int(s)
        cost = n[: capacity - s + 1] - n[s:]  # half the change, less 1/2 or 1
        cost += closed[s:]
        cost[0] -= 0.5  # a bin filled to the brim leaves the sum
        cost[-1] -= 0.5  # a new bin takes nothing out of it
        g = s + int(cost.argmin())
        if g == capacity:
            b = len(gaps)
            gaps.append(capacity)
        else:
            b = open_bins[g].pop()
            n[g] -= 1
            if not n[g]:
                closed[g] = np.inf
        bins[i], offsets[i] = b, capacity - g
        left = g - s
        gaps[b] = left
        if left:
            open_bins[left].append(b)
            n[left] += 1
            closed[left] = 0
    return bins, offsets, np.array(gaps, np.int64)


def _shard(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        times = table["times"].to_numpy()
        if (times > 1).any():
            table = table.take(pa.array(np.repeat(np.arange(len(times)), times)))
        table = table.sort_by([(c, "ascending") for c in ("order", "doc_id", "piece", "start", "length")])
        size = table["length"].to_numpy().astype(np.int64)
        b, off = np.full(len(size), -1, np.int64), np.zeros(len(size), np.int32)
        part, full = np.flatnonzero((size > 0) & (size < capacity)), np.flatnonzero(size == capacity)
        got, where, gaps = pack(size[part], capacity)
        b[part], off[part] = got, where
        b[full] = len(gaps) + np.arange(len(full))
        ids = pa.array((table["shard"].to_numpy() << 36) | b, pa.int64(), mask=b < 0)
        return pa.table({**{c: table[c] for c in ("doc_id", "piece", "start", "length")}, "bin_id": ids, "offset": pa.array(off)})

    return run


def best_fit(docs: DataFrame, id_col="doc_id", text_col="text", length_col: str | None = None, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, offset): where each piece of each document lies.

    Lengths are words, or the column length_col. `start` is the piece's first unit in its document, `offset` in its bin.
    Null, empty or blank texts and lengths below 1: one row of length 0 without bin, offset 0. Documents longer than
    capacity: consecutive pieces, none left out. Repeated rows are each packed. Null ids are packed like others. Ties between
    gaps: the smallest. An empty table gives no rows; other columns are ignored.
    """
    if capacity < 2:
        raise ValueError("capacity must be at least 2")
    length = F.coalesce(col(docs, length_col).cast("bigint"), F.lit(0)) if length_col else word_count(col(docs, text_col)).cast("bigint")
    shards = max(1, -(-docs.count() // shard_docs))
    rows = docs.select(col(docs, id_col).cast("bigint").alias("doc_id"), F.greatest(length, F.lit(0)).alias("n")).groupBy("doc_id", "n").agg(F.count("*").alias("all"))
    steps = lambda n, k: F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.ceil(n / k).cast("bigint") - 1))
    runs = rows.select("doc_id", "n", "all", F.explode(steps(F.col("all"), RUN)).alias("copy")).select("doc_id", "n", "copy", F.least(F.lit(RUN), F.col("all") - F.col("copy") * RUN).alias("times"))
    pieces = runs.select("*", F.explode(steps(F.col("n"), capacity)).alias("piece"))
    start = F.col("piece") * capacity
    pieces = pieces.select(
        "doc_id", F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.lit(capacity), F.col("n") - start).cast("int").alias("length"), F.col("times").cast("int").alias("times"),
        F.xxhash64("doc_id", "piece").alias("order"), F.pmod(F.xxhash64("doc_id", "n", "copy", F.floor(F.col("piece") / RUN)), F.lit(shards)).alias("shard"),
    )
    return pieces.groupBy("shard").applyInArrow(_shard(capacity), SCHEMA)
