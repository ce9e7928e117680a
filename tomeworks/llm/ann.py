"""Approximate nearest neighbours with learned partitions.

All vectors are cut into cells by a tree: each node is cut across its main direction where its parts are shared out in
proportion, until a cell has at most CELL vectors. In each cell the neighbour graph of all its vectors is cut into balanced parts
of few crossing edges, by recursive bisection along the second eigenvector and swaps over the cut. So every vector lies in a part by
these cuts, and the number of parts follows that of vectors. A small network with one hidden layer learns from each vector which
parts its neighbours are in. A query visits its own part and then the likeliest others, until the probability of those visited
reaches a confidence, and is compared with every vector there: where the network is unsure, it visits more. The confidence is measured:
the least at which some queries of every part, held against all vectors, get TARGET of their true neighbours.

The network goes to every task, so it has MOST_PARTS outputs at most. Beyond MOST_PARTS x PART_ROWS vectors the index is fitted on so many
of them, those whose ids hash lowest, and the network puts the others into parts; all are indexed. Parts are cut into blocks of
bounded size on both sides, vectors and queries, so a crowded part costs time and no memory.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeworks.llm.common import col, row_udf, struct
from tomeworks.session import discard, stored

K = 10
#: Vectors of a cell, whose neighbour graph is made in one task, at most.
CELL = 12_288
#: Vectors a part, so the number of parts follows the input; small tables have up to FEW_PARTS of PER_PART on average at least.
PART_ROWS, PER_PART, FEW_PARTS, MOST_PARTS = 4096, 48, 16, 4096
GRAPH = 12
#: Queries that the confidence is measured with, as many from each part, and one at least; the share of true neighbours that is asked for.
TRIALS, TARGET = 512, 0.95
#: Rows whose id is divisible by this are queries.
EVERY = 100
#: Vectors that one task trains the network on; with more of them, weights are averaged after each of ROUNDS.
BUCKET, ROUNDS = 65_536, 4
BASE_BLOCK, QUERY_BLOCK = 8192, 8192
HIDDEN = 128


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; null vectors stay null."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def best(sim: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, the largest first; ties: the column first in order."""
    k = min(k, sim.shape[1])
    if not k:
        return np.empty((len(sim), 0), np.int64)
    edge = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
    out = np.empty((len(sim), k), np.int64)
    for i, row in enumerate(sim):
        at = np.flatnonzero(row >= edge[i])
        out[i] = at[np.argsort(-row[at], kind="stable")[:k]]
    return out


def neighbour_graph(x: np.ndarray, k: int = GRAPH) -> np.ndarray:
    """[rows, k]: the nearest others of each row, by cosine."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), max(k, 0)), np.int64)
    for i in range(0, len(x), 1024):
        sim = x[i : i + 1024] @ x.T
        sim[np.arange(len(sim)), np.arange(i, i + len(sim))] = -np.inf
        if k > 0:
            out[i : i + 1024] = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return out


def _bisect(nodes: np.ndarray, u: np.ndarray, v: np.ndarray, left: int, rnd: np.random.Generator) -> np.ndarray:
    """Which of the nodes (0 .. n - 1, edges u - v both ways) go left; exactly `left` of them."""
    n = len(nodes)
    degree = np.maximum(np.bincount(u, minlength=n), 1).astype(float)
    x = rnd.standard_normal(n)
    root = np.sqrt(degree)
    first = root / np.linalg.norm(root)
    for _ in range(60):  # second eigenvector of the normalised adjacency, shifted to be positive
        x -= first * (first @ x)
        x = x + np.bincount(u, (x / root)[v], n) / root
        x /= max(np.linalg.norm(x), 1e-300)
    order = np.argsort(x / root, kind="stable")
    side = np.ones(n, np.int8)
    side[order[:left]] = 0
    for _ in range(12):  # swap pairs across the cut while that cuts fewer edges
        other = np.bincount(u, side[v] != side[u], n)
        gain = 2 * other - np.bincount(u, minlength=n)
        a, b = np.flatnonzero((side == 0) & (gain > 0)), np.flatnonzero((side == 1) & (gain > 0))
        m = min(len(a), len(b))
        if not m:
            break
        a, b = a[np.argsort(-gain[a], kind="stable")[: max(1, m // 2)]], b[np.argsort(-gain[b], kind="stable")[: max(1, m // 2)]]
        before = (side[u] != side[v]).sum()
        side[a], side[b] = 1, 0
        if (side[u] != side[v]).sum() >= before:
            side[a], side[b] = 0, 1
            break
    return side == 0


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """Part of each node of a neighbour graph; sizes differ by rounding only."""
    n = len(graph)
    rnd = np.random.default_rng(seed)
    u = np.repeat(np.arange(n), graph.shape[1])
    v = graph.ravel()
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    out = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        nodes, first, k = todo.pop()
        if k <= 1 or not len(nodes):
            out[nodes] = first
            continue
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        inside = (place[u] >= 0) & (place[v] >= 0)
        half = k // 2
        left = _bisect(nodes, place[u[inside]], place[v[inside]], round(len(nodes) * half / k), rnd)
        todo += [(nodes[left], first, half), (nodes[~left], first + half, k - half)]
    return out


class Router:
    """A network with one hidden layer that gives each vector's log odds of parts."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum(x @ a + b, 0) @ c + d

    def order(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts of each vector: its own, then the likeliest; the probability of all that come before each). Ties: the part first in order."""
        z = self.scores(x)
        p = np.exp((z - z.max(1, keepdims=True)).astype(np.float64))
        p /= p.sum(1, keepdims=True)
        z[np.arange(len(x)), home] = np.inf
        order = np.argsort(-z, axis=1, kind="stable")
        own = np.take_along_axis(p, order, 1)
        return order.astype(np.int32), np.cumsum(own, 1) - own


def start(dim: int, parts: int, hidden: int = HIDDEN, seed: int = 1) -> list[np.ndarray]:
    """Weights to begin with."""
    rnd = np.random.default_rng(seed)
    shape = [(dim, hidden), (hidden,), (hidden, parts), (parts,)]
    w = [(rnd.standard_normal(s) * (2 / s[0]) ** 0.5 if len(s) == 2 else np.zeros(s)).astype(np.float32) for s in shape]
    w[0] *= dim**0.5  # inputs have length 1
    return w


def train(x: np.ndarray, near: np.ndarray, weights: list[np.ndarray], epochs: int, rate: float = 3e-3, seed: int = 1) -> list[np.ndarray]:
    """Weights after training by Adam on cross entropy with the share of each vector's neighbours in each part; near: their parts, a row a vector."""
    rnd = np.random.default_rng(seed)
    w, parts = [p.copy() for p in weights], weights[3].shape[0]
    m1, m2, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(epochs):
        for rows in np.array_split(rnd.permutation(len(x)), max(1, len(x) // 256)):
            t += 1
            h = np.maximum(x[rows] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            np.subtract.at(z, (np.repeat(np.arange(len(rows)), near.shape[1]), near[rows].ravel()), np.float32(1 / near.shape[1]))
            d = z / len(rows)
            dh = (d @ w[2].T) * (h > 0)
            for p, g, a, b in zip(w, (x[rows].T @ dh, dh.sum(0), h.T @ d, d.sum(0)), m1, m2):
                g = g + 1e-4 * p
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return w


def matrix(array: pa.Array, dim: int) -> np.ndarray:
    """[rows, dim] of an Arrow list array without nulls."""
    return pc.list_flatten(array).to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(array), dim)


class Tree:
    """Cuts of the space into nodes; each node that isn't cut is a cell, and has a number of parts from a first one on."""

    def __init__(self, dim: int, parts: int):
        self.direction, self.edge = np.zeros((1, dim)), np.zeros(1)
        self.child, self.first, self.parts = np.full((1, 2), -1), np.zeros(1, int), np.array([parts])

    def cut(self, node: np.ndarray, direction: np.ndarray, edge: np.ndarray) -> None:
        """Cut nodes at the edge of each along its direction; the left one has half of the parts, rounded down."""
        self.direction[node], self.edge[node], k, half = direction, edge, self.parts[node], self.parts[node] // 2
        self.child[node] = len(self.edge) + np.arange(2 * len(node)).reshape(-1, 2)
        more = 2 * len(node)
        self.first = np.append(self.first, np.stack([self.first[node], self.first[node] + half], 1).ravel())
        self.parts = np.append(self.parts, np.stack([half, k - half], 1).ravel())
        self.direction, self.edge = np.concatenate([self.direction, np.zeros((more, self.direction.shape[1]))]), np.append(self.edge, np.zeros(more))
        self.child = np.concatenate([self.child, np.full((more, 2), -1)])

    def along(self, node: np.ndarray, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Where vectors lie along their node's direction; a little by id, so that vectors that are the same don't stay together at all costs."""
        return np.einsum("ij,ij->i", x, self.direction[node]) + 1e-9 * ((ids * 0x9E3779B1 & 0xFFFFF) / 0x100000)

    def node(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        todo = np.arange(len(x) if self.child[0, 0] >= 0 else 0)
        while len(todo):
            n = at[todo]
            at[todo] = self.child[n, (self.along(n, x[todo], ids[todo]) > self.edge[n]).astype(int)]
            todo = todo[self.child[at[todo], 0] >= 0]
        return at


def _moments(tree, dim: int, wanted: np.ndarray):
    """Per partition: number, sum and products of the vectors of each wanted node."""

    def call(batches):
        kept: dict[int, np.ndarray] = {}
        for b in batches:
            x = _bytes(b.column("x"), dim)
            node = tree.value.node(x, b.column("id").to_numpy())
            for k in np.intersect1d(node, wanted):
                own = np.concatenate([np.ones(((node == k).sum(), 1)), x[node == k]], 1)
                kept[int(k)] = kept.get(int(k), 0) + own.T @ own
            if len(kept) > 1024:
                yield from rows(kept)
                kept = {}
        yield from rows(kept)

    def rows(kept):
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int32()), pa.array([m.tobytes() for m in kept.values()], pa.binary())], names=["node", "m"])

    return call


def _main(dim: int):
    """The direction of the largest variance, from sums of moments."""

    def call(table: pa.Table) -> pa.Table:
        m = np.sum([np.frombuffer(r).reshape(dim + 1, dim + 1) for r in table["m"].to_pylist()], 0)
        mean = m[0, 1:] / m[0, 0]
        v = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))[1][:, -1]
        return pa.table({"node": table["node"][:1], "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    return call


def grow(vectors: DataFrame, n: int, dim: int, parts: int, cell: int) -> Tree:
    """The tree over all vectors (id, x), cut until no cell has more than about `cell` of them or it has one part."""
    tree = Tree(dim, parts)
    spark = vectors.sparkSession
    while True:
        leaf = np.flatnonzero(tree.child[:, 0] < 0)
        wanted = leaf[(tree.parts[leaf] > 1) & (n / parts * tree.parts[leaf] > cell)]
        if not len(wanted):
            return tree
        sent = spark.sparkContext.broadcast(tree)
        got = vectors.mapInArrow(_moments(sent, dim, wanted), "node int, m binary").groupBy("node").applyInArrow(_main(dim), "node int, v array<double>").toArrow()
        at, v = got["node"].to_numpy(), np.array(got["v"].to_pylist())
        tree.direction[at] = v
        sent = spark.sparkContext.broadcast(tree)

        def along(array: pa.Array, sent=sent) -> pa.Array:
            x, ids = _bytes(array.field("x"), dim), array.field("id").to_numpy()
            node = sent.value.node(x, ids)
            return struct(node=pa.array(node, pa.int32()), at=pa.array(sent.value.along(node, x, ids)))

        # at one depth, numbers of parts differ by one at most, so there are few fractions
        share = {k: k // 2 / k for k in set(tree.parts[at].tolist())}
        fractions = sorted(set(share.values()))
        placed = vectors.select(row_udf(along, "node int, at double")(F.struct("id", "x")).alias("r")).select("r.node", "r.at")
        edges = {r.node: r.e for r in placed.groupBy("node").agg(F.percentile_approx("at", fractions, 10_000).alias("e")).collect()}
        tree.cut(at, v, np.array([edges[k][fractions.index(share[tree.parts[k]])] for k in at.tolist()]))


def _parts(tree, dim: int):
    """The part of each vector of a cell, and the parts of its neighbours and itself."""

    def call(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x, node = _bytes(table["x"], dim), table["node"][0].as_py()
        k, first = int(tree.value.parts[node]), int(tree.value.first[node])
        graph = neighbour_graph(x)
        part = balanced_parts(graph, k) + first
        near = np.concatenate([part[graph].reshape(len(x), -1), np.repeat(part[:, None], GRAPH + 1 - graph.shape[1], 1)], 1).astype(np.int32)
        off = np.arange(len(x) + 1, dtype=np.int32) * near.shape[1]
        return pa.table({"id": table["id"], "x": table["x"], "part": pa.array(part, pa.int32()), "near": pa.ListArray.from_arrays(pa.array(off), pa.array(near.ravel()))})

    return call


PIECE = 1 << 18


def _trained(sent, dim: int, epochs: int, seed: int):
    """One bucket's weights after training from those that were sent, in pieces."""

    def call(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        near = pc.list_flatten(table["near"].combine_chunks()).to_numpy().reshape(table.num_rows, -1)
        flat = np.concatenate([p.ravel() for p in train(_bytes(table["x"], dim), near, sent.value, epochs, seed=seed)])
        pieces = [flat[i : i + PIECE].tobytes() for i in range(0, len(flat), PIECE)]
        return pa.table({"piece": pa.array(range(len(pieces)), pa.int32()), "n": pa.array([table.num_rows] * len(pieces), pa.int64()), "w": pa.array(pieces, pa.binary())})

    return call


def _mean(table: pa.Table) -> pa.Table:
    n = table["n"].to_numpy()
    w = sum(k * np.frombuffer(b, np.float32).astype(float) for k, b in zip(n, table["w"].to_pylist())) / n.sum()
    return pa.table({"piece": table["piece"][:1], "w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})


def fit(base: DataFrame, n: int, dim: int, parts: int, bucket: int = BUCKET) -> Router:
    """A router trained on all vectors (id, x, near), in buckets of about `bucket`."""
    w, spark = start(dim, parts), base.sparkSession
    buckets = -(-n // bucket)
    rounds = ROUNDS if buckets > 1 else 1
    epochs = min(40, max(8, -(-40 * CELL // n)))
    spread = base.select("id", "x", "near", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(buckets)).alias("bucket"))
    for k in range(rounds):
        done = spread.groupBy("bucket").applyInArrow(_trained(spark.sparkContext.broadcast(w), dim, -(-epochs // rounds), k), "piece int, n bigint, w binary")
        got = done.groupBy("piece").applyInArrow(_mean, "piece int, w binary").toArrow().sort_by("piece")
        flat, at = np.frombuffer(b"".join(got["w"].to_pylist()), np.float32), np.cumsum([p.size for p in w])[:-1]
        w = [f.reshape(p.shape) for f, p in zip(np.split(flat, at), w)]
    return Router(w)


def _bytes(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _unit():
    """Bytes of each list at length 1, lists of any lengths; null for null."""
    return row_udf(_units, "binary")


def _units(array: pa.Array) -> pa.Array:
    out: list = [None] * len(array)
    size = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == dim)
        for i, r in zip(at.tolist(), unit(matrix(array.take(pa.array(at)), dim))):
            out[i] = r.tobytes()
    return pa.array(out, pa.binary())


def _visits(sent, confidence: float, dim: int):
    """The parts that each vector visits as a query."""

    def call(array: pa.Array) -> pa.Array:
        x, home, got = _bytes(array.field("x"), dim), array.field("part").to_numpy(), []
        for i in range(0, len(x), 512):
            order, before = sent.value.order(x[i : i + 512], home[i : i + 512])
            got += [o[: max(1, int((b < confidence).sum()))] for o, b in zip(order, before)]
        return pa.array(got, pa.list_(pa.int32()))

    return row_udf(call, "array<int>")


def _places(sent, dim: int):
    """The probability of all parts before the one that each true neighbour of a query lies in."""

    def call(array: pa.Array) -> pa.Array:
        x, home, near, got = _bytes(array.field("x"), dim), array.field("part").to_numpy(), array.field("near").to_pylist(), []
        for i in range(0, len(x), 512):
            order, before = sent.value.order(x[i : i + 512], home[i : i + 512])
            got += [b[np.argsort(o)[p]].tolist() for o, b, p in zip(order, before, near[i : i + 512])]
        return pa.array(got, pa.list_(pa.float64()))

    return row_udf(call, "array<double>")


def _home(sent, dim: int):
    def call(array: pa.Array) -> pa.Array:
        x = _bytes(array, dim)
        got = [sent.value.scores(x[i : i + 4096]).argmax(1) for i in range(0, len(x), 4096)]
        return pa.array(np.concatenate(got) if got else np.empty(0, int), pa.int32())

    return row_udf(call, "int")


def _trial(sent, dim: int, k: int):
    """For some thousand vectors at a time: the k nearest of each trial query, with their parts."""

    def call(batches):
        ids, queries = sent.value
        held: list = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= 16_384:
                yield from nearest(held, ids, queries)
                held = []
        if held:
            yield from nearest(held, ids, queries)

    def nearest(held, ids, queries):
        table = pa.Table.from_batches(held)
        x, own, part = _bytes(table["x"], dim), table["id"].to_numpy(), table["part"].to_numpy()
        for i in range(0, len(ids) if len(own) else 0, 512):
            sim = queries[i : i + 512] @ x.T
            sim[ids[i : i + 512, None] == own[None, :]] = -np.inf
            at = best(sim, k)
            q, flat = np.repeat(np.arange(len(at)), at.shape[1]), at.ravel()
            s = sim[q, flat]
            ok = np.isfinite(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i + q[ok]]), pa.array(own[flat[ok]]), pa.array(s[ok].astype(np.float64)), pa.array(part[flat[ok]])], names=["q", "id", "sim", "near"])

    return call


def confidence_needed(base: DataFrame, router, dim: int, k: int, parts: int, trials: int = TRIALS, target: float = TARGET) -> float:
    """The least confidence at which queries of every part, `trials` in all or one of each, get at least `target` of their true k nearest of all vectors."""
    order = Window.partitionBy("part").orderBy(F.xxhash64("id", F.lit(1)), "id")
    chosen = base.select("id", "part").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max(1, -(-trials // parts))).select("id")
    asked = base.join(chosen, "id", "left_semi").select("id", "x", "part")
    got = asked.toArrow()  # some `trials` or `parts`, both bounded
    sent = base.sparkSession.sparkContext.broadcast((got["id"].to_numpy(), _bytes(got["x"], dim)))
    near = base.select("id", "x", "part").mapInArrow(_trial(sent, dim, k), "q bigint, id bigint, sim double, near int")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))).filter(F.col("n") <= k).groupBy("q").agg(F.collect_list("near").alias("near"))
    places = asked.join(near.withColumnRenamed("q", "id"), "id").select(F.explode(_places(router, dim)(F.struct("x", "part", "near"))).alias("at")).toArrow()["at"].to_numpy()
    places = np.sort(places)
    return float(np.nextafter(places[min(len(places) - 1, math.ceil(target * len(places)) - 1)], 2.0)) if len(places) else 1.0


def partition(vectors: DataFrame, n: int, dim: int, parts: int, cell: int = CELL) -> DataFrame:
    """(id, x, part, near) of all vectors (id, x): their parts and those of their neighbours."""
    tree = vectors.sparkSession.sparkContext.broadcast(grow(vectors, n, dim, parts, cell))

    def node(array: pa.Array) -> pa.Array:
        return pa.array(tree.value.node(_bytes(array.field("x"), dim), array.field("id").to_numpy()), pa.int32())

    return vectors.select("id", "x", row_udf(node, "int")(F.struct("id", "x")).alias("node")).groupBy("node").applyInArrow(_parts(tree, dim), "id bigint, x binary, part int, near array<int>")


def _search(dim: int, k: int):
    """One block of vectors (role 0) against one of queries (role 1): the k nearest of each query, packed."""

    def call(table: pa.Table) -> pa.Table:
        role = table["role"].to_numpy()
        ids, x = table["id"].to_numpy(), _bytes(table["x"], dim)
        base, ask = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        base = base[np.argsort(ids[base], kind="stable")]  # ties: the smaller id
        out_id, out_near, out_sim = [], [], []
        y, own = x[base].T, ids[base]
        for i in range(0, len(ask) if len(base) else 0, 512):
            rows = ask[i : i + 512]
            sim = x[rows] @ y
            sim[ids[rows][:, None] == own[None, :]] = -np.inf
            at = best(sim, k)
            for r, a in enumerate(at):
                s = sim[r, a]
                a, s = a[np.isfinite(s)], s[np.isfinite(s)]
                out_id.append(ids[rows[r]])
                out_near.append(own[a])
                out_sim.append(s)
        return pa.table({"id": pa.array(out_id, pa.int64()), "near": pa.array(out_near, pa.list_(pa.int64())), "sim": pa.array(out_sim, pa.list_(pa.float32()))})

    return call


def number_of_parts(n: int, part_rows: int = PART_ROWS) -> int:
    """Parts of n vectors."""
    return max(1, min(MOST_PARTS, n // PER_PART, max(-(-n // part_rows), FEW_PARTS)))


def neighbours(
    vectors: DataFrame, id_col="vec_id", vec_col="embedding", k: int = K, every: int = EVERY, target: float = TARGET, cell: int = CELL, part_rows: int = PART_ROWS, most: int = MOST_PARTS * PART_ROWS
) -> DataFrame:
    """(vec_id, neighbours, similarities): for every id divisible by `every`, the ids of its k nearest others of all rows by cosine, the nearest first.

    With every=1 each row is a query. Fewer than k others: all of them. Ties: the smaller id. Rows that repeat an id are one vector,
    the smallest in order of its numbers. Null ids aren't listed. Null vectors, those with a null or no finite number and
    those whose length isn't the commonest: null lists, and nobody's neighbour. Vectors of zeros are as far from all. An empty
    table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    flat = vectors.select(col(vectors, id_col).cast("bigint").alias("id"), col(vectors, vec_col).cast("array<float>").alias("v")).filter("id IS NOT NULL")
    size = F.when(F.col("v").isNotNull() & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & (F.size("v") > 0), F.size("v"))
    once = flat.withColumn("dim", size).groupBy("id").agg(F.min(F.when(F.col("dim").isNotNull(), F.struct("dim", "v"))).alias("s"))
    rows, rows_at = stored(once.select("id", "s.dim", _unit()(F.col("s.v")).alias("x")), "vectors")
    asks = F.pmod("id", F.lit(every)) == 0
    sizes = rows.filter("dim IS NOT NULL").groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    empty = F.lit(None).cast("array<bigint>").alias("neighbours"), F.lit(None).cast("array<float>").alias("similarities")
    if not sizes:
        return rows.filter(asks).select(F.col("id").alias("vec_id"), *empty)
    dim, n = sizes[0]
    even = rows.filter(F.col("dim") == dim).select("id", "x")
    fitted, m = even, n
    if n > most:
        low = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(most / n * (1 << 30))
        fitted = even.filter(low)
        m = fitted.count()
    parts, paths = number_of_parts(m, part_rows), []
    if parts > 1:
        base, at = stored(partition(fitted, m, dim, parts, cell), "parts")
        paths.append(at)
        router = spark.sparkContext.broadcast(fit(base, m, dim, parts))
        if n > most:
            base, at = stored(base.select("id", "x", "part").unionByName(even.filter(~low).select("id", "x", _home(router, dim)("x").alias("part"))), "parts")
            paths.append(at)
        order = _visits(router, confidence_needed(base, router, dim, k, parts, target=target), dim)(F.struct("x", "part"))
    else:
        base, order = even.withColumn("part", F.lit(0)), F.array(F.lit(0))
    asked, at = stored(base.filter(asks).select("id", "x", order.alias("order")), "queries")
    paths.append(at)
    visits = asked.select("id", "x", F.explode("order").alias("part"))
    # one row for each part that is visited: into how many blocks its vectors and its queries are cut
    there, wanted = base.groupBy("part").agg(F.count("*").alias("nb")), visits.groupBy("part").agg(F.count("*").alias("nq"))
    blocks = there.join(wanted, "part").select("part", F.ceil(F.col("nb") / BASE_BLOCK).cast("int").alias("nb"), F.ceil(F.col("nq") / QUERY_BLOCK).cast("int").alias("nq"))
    blocks = F.broadcast(spark.createDataFrame([tuple(r) for r in blocks.collect()], "part int, nb int, nq int"))  # MOST_PARTS rows at most
    split = lambda by: F.sequence(F.lit(0), F.col(by) - 1)
    left = base.select("id", "x", "part").join(blocks, "part").select("id", "x", "part", F.pmod(F.xxhash64("id"), "nb").cast("int").alias("b"), F.explode(split("nq")).alias("q"), F.lit(0).alias("role"))
    right = visits.join(blocks, "part").select("id", "x", "part", F.explode(split("nb")).alias("b"), F.pmod(F.xxhash64("id", F.lit(2)), "nq").cast("int").alias("q"), F.lit(1).alias("role"))
    found = left.unionByName(right).groupBy("part", "b", "q").applyInArrow(_search(dim, k), "id bigint, near array<bigint>, sim array<float>")
    packed = F.transform(F.arrays_zip("near", "sim"), lambda z: F.struct((-z["sim"]).alias("far"), z["near"].alias("near")))
    merged = found.select("id", packed.alias("c")).groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("c"))), 1, k).alias("c"))
    nearest = merged.select(F.col("id").alias("vec_id"), F.col("c.near").alias("neighbours"), F.transform("c.far", lambda s: -s).alias("similarities"))
    bad = rows.filter(asks & (F.col("dim").isNull() | (F.col("dim") != dim))).select(F.col("id").alias("vec_id"), *empty)
    none = F.array().cast("array<bigint>"), F.array().cast("array<float>")
    good = asked.select(F.col("id").alias("vec_id")).join(nearest, "vec_id", "left").select("vec_id", *[F.coalesce(c, e).alias(c) for c, e in zip(("neighbours", "similarities"), none)])
    final, _ = stored(good.unionByName(bad), "neighbours")
    for path in (*paths, rows_at):
        discard(spark, path)
    return final
