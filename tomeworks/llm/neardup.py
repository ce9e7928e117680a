"""Near-duplicate documents by SetSketch.

A document is the set of its shingles of SHINGLE lower-cased words. Register i of its sketch is the smallest of the
exponentials with rate A that hash function i gives to its shingles, put on the scale floor(1 - log_B(.)) and cut to
0 .. Q + 1: registers of a union are the larger ones of each pair, and equal registers become likelier the more alike two
sets are. Bands of registers name buckets; within a bucket similarity is estimated from all registers by maximum
likelihood together with the estimated sizes; what may be alike is then verified on the shingle sets themselves.

Documents with the same words in the same order are joined first, by a 128-bit hash, so that a thousand copies are one
document to all that follows. Groups are the connected components of pairs with Jaccard similarity of at least THRESHOLD.

Buckets and components of any size are cut into blocks of bounded size, so that none is one task's: each block is held against
the first member of all, and what isn't alike to that one, mostly little, against every other block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeworks.llm.common import Maybe, col, free_name, lists, mix64, row_udf, sliced, struct, word_hashes
from tomeworks.llm.graph import components
from tomeworks.session import discard, stored

SHINGLE = 3
REGISTERS, ROWS = 144, 4
B, A, Q = 1.001, 20.0, 65_534
THRESHOLD = 0.5
#: A pair whose estimate is lower than the threshold by more than this isn't verified (about 3 standard errors).
MARGIN = 0.12
#: Members of a block, and bytes of their sets, at most (a larger set is a block by itself).
BLOCK_ROWS, BLOCK_BYTES = 4096, 32 << 20
_SEED = np.random.default_rng(20_210_101)
_X = _SEED.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_M = _SEED.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)


def shingles(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each shingle of all texts, their number by text, word hashes, number of words by text).

    A text of fewer than SHINGLE words has one shingle, all of its words; a text without words has none.
    """
    words, count = word_hashes(array)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64), count.copy(), words, count
    end = np.repeat(np.cumsum(count), count)
    at = np.arange(n)
    h = words.copy()
    with np.errstate(over="ignore"):
        for j in range(1, SHINGLE):
            inside = at + j < end
            h = h * np.uint64(0xD6E8FEB86659FD93) + np.where(inside, words[np.minimum(at + j, n - 1)], np.uint64(j))
    begin = end - np.repeat(count, count)
    take = (at + SHINGLE <= end) | ((at == begin) & (end - begin < SHINGLE))
    return mix64(h[take]), np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0), words, count


def smallest(hashes: np.ndarray, count: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """[rows, registers]: the smallest 32-bit value of each hash function over each row's shingles (rows without any: all ones)."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(count), registers), 0xFFFFFFFF, np.uint32)
    rows = np.flatnonzero(count)
    ends = np.cumsum(count[rows])
    first = 0
    while first < len(rows):  # blocks that stay in the cache; a long document is a block of its own
        begin = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begin + 32_768, "right")))
        part, starts = x[begin : ends[last - 1]], (ends[first:last] - count[rows[first:last]] - begin)
        for i in range(registers):
            h = (part ^ _X[i]) * _M[i]
            h ^= h >> np.uint32(16)
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            out[rows[first:last], i] = np.minimum.reduceat(h, starts)
        first = last
    return out


def registers_of(low: np.ndarray) -> np.ndarray:
    """Register values of the smallest hash values: exponentials of rate A on a logarithmic scale with base B, cut to 0 .. Q + 1."""
    exponential = -np.log1p(-(low.astype(np.float64) + 0.5) / 2**32) / A
    return np.clip(np.floor(1 - np.log(exponential) / np.log(B)), 0, Q + 1).astype(np.uint16)


def merged(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(one, other)


def size_of(sketch: np.ndarray) -> np.ndarray:
    """Estimated number of elements, along the last axis."""
    m = sketch.shape[-1]
    return m * (1 - 1 / B) / (A * np.log(B) * np.sum(np.power(B, -sketch.astype(np.float64)), -1))


def similarity(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Maximum-likelihood estimate of the Jaccard similarity of each pair of sketches, rows of [pairs, registers].

    How often the first register is the larger, the smaller or an equal one has a probability that depends on the similarity
    and the sets' sizes alone; its logarithm is concave in the similarity, so golden section search finds the largest.
    """
    if not len(one):
        return np.empty(0)
    up, down = (one > other).sum(-1), (one < other).sum(-1)
    same = one.shape[-1] - up - down
    n, k = size_of(one), size_of(other)
    u, v = n / (n + k), k / (n + k)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    tiny = 1e-300

    def likelihood(j):
        a, b = p(u - v * j), p(v - u * j)
        return up * np.log(a + tiny) + down * np.log(b + tiny) + same * np.log(np.maximum(1 - a - b, 0) + tiny)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    golden = (5**0.5 - 1) / 2
    for _ in range(24):
        a, b = high - golden * (high - low), low + golden * (high - low)
        left = likelihood(a) >= likelihood(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


@sliced
def _sketch(array: pa.Array) -> pa.Array:
    h, count, words, n_words = shingles(array)
    sig = registers_of(smallest(h, count))
    ends = np.cumsum(n_words)
    raw = words.view(np.uint8)
    key = [xxhash.xxh128_digest(raw[8 * (e - n) : 8 * e]) if n else None for e, n in zip(ends.tolist(), n_words.tolist())]
    rows = sig.astype("<u2").tobytes()
    width = 2 * REGISTERS
    sigs = [rows[i * width : (i + 1) * width] if k else None for i, k in enumerate(key)]
    return struct(key=pa.array(key, pa.binary()), sig=pa.array(sigs, pa.binary()), n=pa.array(count, pa.int64()))


def _bands(array: pa.Array) -> pa.Array:
    sig = np.frombuffer(b"".join(array.to_pylist()), "<u2").reshape(len(array), REGISTERS)
    h = np.zeros((len(sig), REGISTERS // ROWS), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS].astype(np.uint64) + np.uint64(1))
        h = mix64(h + np.arange(h.shape[1], dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return lists(h.ravel().view(np.int64), np.full(len(sig), h.shape[1]), pa.int64())


@sliced
def _sets(array: pa.Array) -> pa.Array:
    h, count, _, _ = shingles(array)
    out, end = [], np.cumsum(count)
    for e, n in zip(end, count):
        out.append(np.unique(h[e - n : e]).tobytes())
    return pa.array(out, pa.binary())


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys of batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        change = np.flatnonzero(values[1:] != values[:-1])
        if held and held[-1].column(key)[-1].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), REGISTERS)


def _linked(least: float):
    """Spanning edges of each bucket's pairs whose estimate is at least `least`."""

    def bucket(ids: np.ndarray, sig: np.ndarray, loose: np.ndarray) -> list[tuple[int, int]]:
        """Edges of those that aren't alike to the first of the bucket; each is held against all, until joined."""
        group = np.arange(len(ids))
        group[1:][~loose[1:]] = 0
        out = []
        for x in np.flatnonzero(loose):
            others = np.flatnonzero(group != group[x])
            if not len(others):
                continue
            alike = others[similarity(np.broadcast_to(sig[x], (len(others), REGISTERS)), sig[others]) >= least]
            for g in np.unique(group[alike]):
                if g != group[x]:
                    y = alike[group[alike] == g][0]
                    out.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
                    group[group == g] = group[x]
        return out

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "bucket"):
            b, ids, sig = t["bucket"].to_numpy(), t["id"].to_numpy(), _matrix(t["sig"])
            start = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            size = np.diff(np.append(start, len(b)))
            head = np.repeat(start, size)
            rest = np.flatnonzero(head != np.arange(len(b)))
            alike = similarity(sig[head[rest]], sig[rest]) >= least
            loose = np.zeros(len(b), bool)
            loose[rest] = ~alike
            edges = [np.stack([ids[head[rest[alike]]], ids[rest[alike]]], 1)]
            for s, n in zip(start, size):
                if n > 2 and loose[s : s + n].any():
                    edges.append(np.array(bucket(ids[s : s + n], sig[s : s + n], loose[s : s + n]), np.int64).reshape(-1, 2))
            e = np.unique(np.concatenate(edges), axis=0)
            e = e[e[:, 0] != e[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    return call


def _sets_of(column) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in column.to_pylist()]


def by_sets(sets: list[np.ndarray], threshold: float):
    """alike(one): which of the sets have a Jaccard similarity of at least the threshold to one."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets) if n else np.empty(0, np.uint64), np.repeat(np.arange(n), size)

    def alike(one: np.ndarray) -> np.ndarray:
        if n <= 2:
            common = np.array([len(one) if s is one else len(np.intersect1d(one, s, assume_unique=True)) for s in sets], np.int64)
        else:
            at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
            common = np.bincount(owner[one[at] == flat], minlength=n)
        return common >= threshold * (size + len(one) - common)

    return alike


def by_sketches(sig: np.ndarray, least: float):
    """The same for the estimate from sketches."""
    return lambda one: similarity(np.broadcast_to(one, sig.shape), sig) >= least


def verified_groups(ids: np.ndarray, sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Smallest id of each one's connected component under exact Jaccard similarity of at least the threshold.

    The first set is compared with all, then each set outside its group with all: two sets that are both in one group
    need no comparison, so every pair that could join groups is compared.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    alike = by_sets(sets, threshold)
    group = np.arange(n)
    for x in order:
        if x != order[0] and group[x] == group[order[0]]:
            continue
        for g in np.unique(group[alike(sets[x])]):
            group[group == g] = group[x]
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    return least[group]


def _resolved(threshold: float):
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "part"):
            c, ids = t["part"].to_numpy(), t["id"].to_numpy()
            sets = _sets_of(t["words"])
            start = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            out = [verified_groups(ids[s:e], sets[s:e], threshold) for s, e in zip(start, np.append(start[1:], len(c)))]
            yield pa.RecordBatch.from_arrays([t["component"].combine_chunks(), pa.array(ids), pa.array(np.concatenate(out))], names=["component", "id", "first"])

    return call


def _crossed(data: str, read, alike_to):
    """Spanning edges between a block's members and what isn't alike to the first of all: each of the latter is held against all members.

    Members that are alike to the first count as one group, as edges join them already.
    """

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "part"):
            c = table["part"].to_numpy()
            start = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            for s, e in zip(start, np.append(start[1:], len(c))):
                t = table.slice(s, e - s)
                asks = t["loose"].to_numpy()
                rows, members = t.filter(pa.array(asks)), t.filter(pa.array(~asks))
                if not rows.num_rows or not members.num_rows:
                    continue
                ids, star = members["id"].to_numpy(), members["star"].to_numpy()
                alike = alike_to(read(members[data]))
                edges = []
                for i, one in zip(rows["id"].to_pylist(), read(rows[data])):
                    hit = alike(one)
                    near = ids[hit & ~star].tolist() + ids[hit & star][:1].tolist()
                    edges += [(min(i, j), max(i, j)) for j in near if i != j]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])

    return call


def blocks(members: DataFrame, group: str) -> DataFrame:
    """Rows of `members` with `part`, a number for each block of each group; the group's first member is in all of its blocks.

    members has the group, `id`, `head` (the group's smallest id) and `nb`, the number of its blocks.
    """
    own = F.when(F.col("id") == F.col("head"), F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), "nb").cast("int")))
    return members.withColumn("b_", F.explode(own)).withColumn("part", F.xxhash64(group, "b_")).drop("b_")


def crossed(members: DataFrame, loose: DataFrame, group: str, data: str, block: int, call) -> DataFrame:
    """(a, b): edges between members and loose members of other blocks. loose has the group and `id`, once; members as for blocks()."""
    ask = members.join(loose, [group, "id"])
    many = loose.groupBy(group).agg(F.count("*").alias("many"))
    counted = many.select(group, F.ceil(F.col("many") / block).cast("int").alias("nl"))
    here = members.join(counted, group).join(loose.withColumn("not_", F.lit(True)), [group, "id"], "left")
    here = here.select(group, "id", data, F.pmod(F.xxhash64("id"), "nb").cast("int").alias("b_"), F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("l_"), F.col("not_").isNull().alias("star"), F.lit(False).alias("loose"))
    there = ask.join(counted, group).select(group, "id", data, F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b_"), F.pmod(F.xxhash64("id", F.lit(5)), "nl").cast("int").alias("l_"), F.lit(False).alias("star"), F.lit(True).alias("loose"))
    both = here.unionByName(there).select(F.xxhash64(group, "b_", "l_").alias("part"), "id", data, "star", "loose")
    return both.repartition(F.col("part")).sortWithinPartitions("part").mapInArrow(call, "a bigint, b bigint")


def candidates(firsts: DataFrame, least: float, block: int) -> tuple[DataFrame, str]:
    """((a, b), path): edges of a graph whose components are those of all pairs that share a bucket and have an estimate of at least `least`."""
    spark = firsts.sparkSession
    bands = firsts.select("id", F.explode(row_udf(_bands, "array<bigint>")("sig")).alias("bucket"))
    sizes, sizes_at = stored(bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("head")).filter("n > 1").select("bucket", "head", F.ceil(F.col("n") / block).cast("int").alias("nb")), "buckets")
    members = bands.join(sizes, "bucket").join(firsts.select("id", "sig"), "id")
    cut = blocks(members, "bucket").select(F.col("part").alias("bucket"), "id", "sig")
    cut = cut.repartition(F.col("bucket")).sortWithinPartitions("bucket", "id")
    edges, at = stored(cut.mapInArrow(_linked(least), "a bigint, b bigint").distinct(), "pairs")
    if sizes.filter("nb > 1").limit(1).count():
        hot = members.filter("nb > 1")
        star = edges.select(F.col("a").alias("head"), F.col("b").alias("id"))
        loose, loose_at = stored(hot.select("bucket", "id", "head").filter("id <> head").join(star, ["head", "id"], "left_anti").select("bucket", "id").distinct(), "loose")
        more = crossed(hot, loose, "bucket", "sig", block, _crossed("sig", _matrix, lambda sig: by_sketches(sig, least)))
        every, every_at = stored(edges.unionByName(more).distinct(), "pairs")
        for path in (at, loose_at):
            discard(spark, path)
        edges, at = every, every_at
    discard(spark, sizes_at)
    return edges, at


def verified(rows: DataFrame, firsts: DataFrame, linked: DataFrame, threshold: float, block: int, block_bytes: int) -> tuple[DataFrame, str]:
    """((id, first), path): the smallest id of each document's group, for documents of candidate components (node, component)."""
    spark = rows.sparkSession
    known = linked.withColumnRenamed("node", "id")
    size = firsts.select("id", "n").join(known, "id").groupBy("component").agg(F.count("*").alias("many"), F.sum(8 * F.col("n")).alias("bytes"), F.min("id").alias("head"))
    size, size_at = stored(size.select("component", "head", F.ceil(F.greatest(F.col("many") / block, F.col("bytes") / block_bytes)).cast("int").alias("nb")), "components")
    known = known.join(size, "component")
    # an id may stand for several texts; each text that names it is compared. Texts of others aren't moved
    there = Maybe(linked, "node")
    texts = rows.withColumn("_maybe", there.has(F.col("id"))).filter("_maybe").drop("_maybe").join(known, "id")
    sets = texts.select("component", "id", "head", "nb", row_udf(_sets, "binary")("text").alias("words")).filter(F.length("words") > 0).dropDuplicates(["id", "words"])
    hot = bool(size.filter("nb > 1").limit(1).count())
    if hot:
        sets, sets_at = stored(sets, "sets")
    cut = blocks(sets, "component").select("part", "component", "id", "words").repartition(F.col("part")).sortWithinPartitions("part", "id")
    first, first_at = stored(cut.mapInArrow(_resolved(threshold), "component bigint, id bigint, first bigint"), "firsts")
    done = [size_at, first_at]
    if hot:
        own = first.join(size.filter("nb > 1"), "component")
        members = sets.filter("nb > 1")
        loose, loose_at = stored(own.groupBy("component", "id").agg(F.min(F.col("first") == F.col("head")).alias("star")).filter("NOT star").select("component", "id"), "loose")
        more = crossed(members, loose, "component", "words", block, _crossed("words", _sets_of, lambda sets: by_sets(sets, threshold)))
        inside = own.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
        edges, edges_at = stored(inside.unionByName(more).distinct(), "verified")
        joined, joined_at = components(edges)
        small = first.join(size.filter("nb = 1").select("component"), "component", "left_semi").select("id", "first")
        got = small.unionByName(joined.select(F.col("node").alias("id"), F.col("component").alias("first")))
        done += [sets_at, loose_at, edges_at, joined_at]
    else:
        got = first.select("id", "first")
    groups, groups_at = stored(got.groupBy("id").agg(F.min("first").alias("first")), "groups")
    for path in done:
        discard(spark, path)
    return groups, groups_at


def duplicates(docs: DataFrame, id_col="doc_id", text_col="text", threshold: float = THRESHOLD, block: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, duplicate_of): every document that isn't the one with the smallest id of its group, and that one's id.

    Null texts and texts without words are nobody's duplicate, nor are rows with a null id. Texts are compared whole, of any
    length. Rows with the same words and different ids are duplicates; rows that repeat an id with the same words are
    one document and aren't listed for that. An empty table gives no rows; other columns are ignored. A pair at the threshold
    shares a band with a probability of about 0.9, one of 0.7 with more than 0.999; what shares none isn't found, unless others join it.
    """
    spark = docs.sparkSession
    rows = docs.select(col(docs, id_col).cast("bigint").alias("id"), col(docs, text_col).alias("text")).filter("id IS NOT NULL")
    sketch = row_udf(_sketch, "key binary, sig binary, n bigint")
    all_, all_at = stored(rows.select("id", sketch("text").alias("s")).select("id", "s.key", "s.sig", "s.n").filter("key IS NOT NULL"), "sketches")
    # one row for all documents with the same words
    firsts, firsts_at = stored(all_.groupBy("key").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("n").alias("n")), "firsts")
    edges, edges_at = candidates(firsts, threshold - MARGIN, block)
    linked, linked_at = components(edges)
    groups, groups_at = verified(rows, firsts, linked, threshold, block, block_bytes)
    own = firsts.select("key", "id").join(groups, "id", "left").select("key", F.coalesce("first", "id").alias("duplicate_of"))
    found = all_.select("key", F.col("id").alias("doc_id")).join(own, "key").filter("doc_id <> duplicate_of").select("doc_id", "duplicate_of").distinct()
    out, _ = stored(found, "duplicates")
    for path in (all_at, firsts_at, edges_at, linked_at, groups_at):
        discard(spark, path)
    return out


def keep(docs: DataFrame, id_col="doc_id", text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, unchanged, that stand for their group: one document of each, and one row of each repeated one.

    Rows with a null id and texts without words stay. Of rows with the same id and text the one that is first as JSON stays.
    Extra columns may have any names. An empty table gives no rows. Texts are compared whole.
    """
    spark = docs.sparkSession
    gone_, again_, n_, maybe_, row_ = (free_name(docs, x) for x in ("_gone", "_again", "_n", "_maybe", "_row"))
    gone = duplicates(docs, id_col, text_col, threshold).select(F.col("doc_id").alias(gone_)).distinct()
    ids = docs.filter(col(docs, id_col).isNotNull()).groupBy(col(docs, id_col).alias(again_)).agg(F.count("*").alias(n_))
    again, _ = stored(ids.filter(F.col(n_) > 1).select(again_), "again")

    def apart(df: DataFrame, keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Rows whose id surely isn't among the keys, and the others; only those move."""
        mark = df.withColumn(maybe_, Maybe(keys, name).has(col(df, id_col).cast("bigint")))
        return mark.filter(~F.col(maybe_)).drop(maybe_), mark.filter(F.col(maybe_)).drop(maybe_)

    sure, rest = apart(docs, gone, gone_)
    left = sure.unionByName(rest.join(gone, col(rest, id_col).cast("bigint") == F.col(gone_), "left_anti"))
    if not again.limit(1).count():
        return left
    sure, rest = apart(left, again.select(F.col(again_).cast("bigint")), again_)
    single = rest.join(again, col(rest, id_col) == F.col(again_), "left_anti")
    whole = F.struct(*[col(rest, c) for c in rest.columns])
    twice = rest.join(again, col(rest, id_col) == F.col(again_), "left_semi").groupBy(col(rest, id_col).alias(again_), col(rest, text_col).alias(n_)).agg(F.min_by(whole, F.to_json(whole)).alias(row_))
    twice = twice.select(*[F.col(row_)[c].alias(c) for c in rest.columns])
    return sure.unionByName(single).unionByName(twice)
