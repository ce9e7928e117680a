"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEPT: dict[str, dict] = {}


def worker_cache(name: str, most: int = 400_000) -> dict:
    """A dict that lives as long as the Python worker; with more than `most` keys, the later half of them leaves.

    It only saves repeated work: what is asked for and missing is computed again. Frequent keys come early, so they stay. A
    worker that goes on to another operator keeps the two dicts that were used last.
    """
    kept = _KEPT.pop(name, {})
    _KEPT[name] = kept
    while len(_KEPT) > 2:
        _KEPT.pop(next(iter(_KEPT)))
    if len(kept) > most:
        for key in list(kept)[most // 2 :]:
            del kept[key]
    return kept


def row_udf(function, returns: str):
    """An Arrow UDF of one column that Catalyst neither duplicates nor moves across its consumer's filter.

    After each batch, memory that isn't used any more goes back to the system: workers live on, and executors count it.
    """

    def run(array: pa.Array) -> pa.Array:
        try:
            return function(array)
        finally:
            release()

    return F.arrow_udf(run, returnType=returns).asNondeterministic()


def release() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have (names compare without case, as Spark's do)."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def col(df: DataFrame, name: str) -> Column:
    """Column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def expand(df: DataFrame, id_col: str, call: Column, fields: list[str], id_as: str = "doc_id") -> DataFrame:
    """id and the fields of the struct that `call` returns, evaluated once per row."""
    flat = df.select(col(df, id_col).alias("_id"), call.alias("_r"))
    return flat.select(F.col("_id").alias(id_as), *[F.col("_r")[f].alias(f) for f in fields])


def filter_by(df: DataFrame, call: Column) -> DataFrame:
    """Rows of df, all columns kept, for which the boolean `call` is true."""
    name = free_name(df, "_keep")
    return df.withColumn(name, call).filter(F.col(name)).select(*[col(df, c) for c in df.columns])


def texts(array: pa.Array) -> list[str]:
    """Python strings of an Arrow array, null as the empty text."""
    return pc.fill_null(array, "").to_pylist()


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, offsets with one more entry than rows); null as empty."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.empty(0, np.uint8)
    return raw, off - (off[0] if len(off) else 0)


#: Bytes of text that are hashed at once; temporary arrays are some forty times as large.
SLICE_BYTES = 1 << 20


def slices(array: pa.Array, most: int = SLICE_BYTES) -> list[pa.Array]:
    """The array in runs of whole texts of at most `most` bytes; a longer text is a run by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, first = [], 0
    while first < len(array):
        begin = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begin + most, "right")))
        out.append(array.slice(first, last - first))
        first = last
    return out or [array]


def sliced(call):
    """call, applied to slices of its array one after the other."""

    def run(array: pa.Array) -> pa.Array:
        got = [call(a) for a in slices(array)]
        return got[0] if len(got) == 1 else pa.concat_arrays(got)

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType, valid: np.ndarray | None = None) -> pa.Array:
    """An Arrow list array from concatenated values and the number of values in each row; null where not valid."""
    off = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=off[1:])
    where = pa.array(off.astype(np.int32), pa.int32(), mask=None if valid is None else np.append(~valid, False))
    return pa.ListArray.from_arrays(where, pa.array(flat, kind))


def is_text(array: pa.Array) -> np.ndarray:
    return array.is_valid().to_numpy(zero_copy_only=False)


def struct(**columns: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


#: ASCII white space; words are maximal runs of other bytes.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
    return out


def word_hashes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each lower-cased word of all texts, number of words of each text), without Python strings.

    A word's hash is its polynomial over bytes mod 2**64, then mixed; positions cancel, so equal words hash alike.
    """
    raw, off = utf8(pc.utf8_lower(array))
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(array), np.int64)
    word = ~SPACE[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    before[off[:-1][off[:-1] < n]] = False  # a text's first byte begins a word of its own
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:] & before[1:]
    ends = np.flatnonzero(word & ~after) + 1
    key, inv = worker_cache("powers"), None
    if len(key.get("r", ())) < n + 1:
        key["r"], key["inv"] = _powers(_R, n + 1), _powers(_R_INV, n + 1)
    r, inv = key["r"], key["inv"]
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * r[:n], out=total[1:])
        h = (total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64)
    counts = np.searchsorted(starts, off[1:]) - np.searchsorted(starts, off[:-1])
    return mix64(h), counts


#: Bits of a Maybe for each key, and the most bits it has (16 MB), however many keys there are.
BITS_A_KEY, MOST_BITS = 16, 1 << 27


class Maybe:
    """A Bloom filter over ids. With more keys than it has room for it lets more through, which costs time and nothing else."""

    def __init__(self, ids: DataFrame, name: str):
        """ids must be cheap to read again. Bits are set in Spark, word by word; at most MOST_BITS come to the driver."""
        n = ids.count()
        self.bits = 64
        while self.bits < min(MOST_BITS, BITS_A_KEY * n):
            self.bits *= 2
        key = F.xxhash64(col(ids, name), F.lit(99))
        # two positions from one hash, so both sides only need its halves
        spots = ids.select(F.explode(F.array(key, F.shiftrightunsigned(key, 32))).alias("h")).select(F.pmod("h", F.lit(self.bits)).alias("at"))
        words = spots.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("mask")).toArrow()
        table = np.zeros(self.bits // 64, np.int64)
        if words.num_rows:
            table[words["word"].to_numpy()] = words["mask"].to_numpy()
        self.table = ids.sparkSession.sparkContext.broadcast(table.view(np.uint64))  # at most MOST_BITS / 8 bytes

    def has(self, column: Column) -> Column:
        """Whether the id may be one of the keys; false for null."""
        table, bits = self.table, self.bits

        def call(array: pa.Array) -> pa.Array:
            key = pc.fill_null(array, 0).to_numpy(zero_copy_only=False)
            ok = np.ones(len(key), bool)
            for h in (key, (key.view(np.uint64) >> np.uint64(32)).astype(np.int64)):
                at = np.mod(h, bits)
                ok &= (table.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            return pa.array(ok & array.is_valid().to_numpy(zero_copy_only=False))

        return row_udf(call, "boolean")(F.when(column.isNotNull(), F.xxhash64(column, F.lit(99))))
