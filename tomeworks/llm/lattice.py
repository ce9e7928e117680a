"""Document likelihood over all segmentations into subwords.

A word, with the mark that stands for the white space before it, is the end of many paths through the lattice of
vocabulary pieces; its probability is the sum over all of them, by the forward recursion in log space. Pieces never reach
over white space, so a document's log probability is the sum of its words'. Words are looked up once per worker; those that are
new are decoded together, in numpy batches.

The vocabulary is taken as it is. If its scores are log probabilities, they are used; if they are merge ranks, as in a BPE
model, Zipf's law with Mandelbrot's shift gives each rank its probability.

From the corpus come the ranks: every document's bits per character are held against those of all others, exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeworks.llm.common import col, free_name, row_udf, struct, worker_cache
from tomeworks.session import stored

VOCAB = "/opt/tokenizers/piece_bpe_32k.model"
SHIFT = 2.7
MARK = "▁"
FIELDS = ["n_words", "log_prob", "bits_per_char"]
#: Cells (words x letters) decoded at once.
CELLS = 400_000
_BASE = 0x100000001B3


def piece_scores(path: str) -> tuple[dict[str, float], np.ndarray]:
    """(log probability of each piece, log probability of each byte)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw: dict[str, float] = {}
    names: dict[int, str] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            names[int(piece[3:5], 16)] = piece
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and model.get_score(i) > -1e8:
            raw[piece] = model.get_score(i)
    if raw and min(raw.values()) < -1000:  # ranks
        weight = {p: 1.0 / (SHIFT - s) for p, s in raw.items()}
    else:
        weight = {p: math.exp(s) for p, s in raw.items()}
    least = min(weight.values(), default=1.0)
    total = sum(weight.values()) + 256 * least  # a byte is as likely as the rarest piece
    return {p: math.log(w / total) for p, w in weight.items()}, np.full(256, math.log(least / total))


class Lattice:
    """Pieces by the hashes of their prefixes, length by length."""

    def __init__(self, scores: dict[str, float], byte: np.ndarray):
        self.byte = byte
        self.longest = max(map(len, scores), default=1)
        prefixes: list[dict[int, float]] = [{} for _ in range(self.longest)]
        for p, s in scores.items():
            h = 0
            for k, c in enumerate(p):
                h = (h * _BASE + ord(c) + 1) % (1 << 64)
                if k + 1 == len(p):
                    prefixes[k][h] = s
                else:
                    prefixes[k].setdefault(h, -math.inf)
        self.keys = [np.array(sorted(d), np.uint64) for d in prefixes]
        self.values = [np.array([d[k] for k in sorted(d)]) for d in prefixes]

    def edges(self, codes: np.ndarray, room: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1: (starts, log probabilities) of the pieces in the text; room is what is left of the word at each start."""
        out = []
        alive, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        base = np.uint64(_BASE)
        with np.errstate(over="ignore"):
            for k in range(self.longest):
                inside = room[alive] > k
                alive, h = alive[inside], h[inside]
                h = h * base + codes[alive + k].astype(np.uint64) + np.uint64(1)
                at = np.minimum(np.searchsorted(self.keys[k], h), max(len(self.keys[k]) - 1, 0))
                hit = self.keys[k][at] == h if len(self.keys[k]) else np.zeros(len(h), bool)
                score = self.values[k][at] if len(self.keys[k]) else np.zeros(len(h))
                if k == 0:  # letters that are no piece are spelt in bytes
                    single = np.where(hit, score, -np.inf)
                    bare = np.flatnonzero(~np.isfinite(single))
                    if len(bare):
                        kinds, which = np.unique(codes[bare], return_inverse=True)
                        spelt = np.array([self.byte[list(chr(c).encode("utf-8", "replace"))].sum() for c in kinds.tolist()])
                        single[bare] = spelt[which]
                    out.append((alive, single))
                else:
                    whole = hit & (score > -np.inf)
                    out.append((alive[whole], score[whole]))
                alive, h = alive[hit], h[hit]
                if not len(alive):
                    break
        return out

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Marginal log probability of each word, MARK put before it."""
        out = np.empty(len(words))
        order = np.argsort([len(w) for w in words], kind="stable")
        first = 0
        while first < len(order):
            last, T = first, 0
            while last < len(order) and (last == first or (last + 1 - first) * (len(words[order[last]]) + 1) <= CELLS):
                T = len(words[order[last]]) + 1
                last += 1
            out[order[first:last]] = self._forward([MARK + words[i] for i in order[first:last]], T)
            first = last
        return out

    def _forward(self, words: list[str], T: int) -> np.ndarray:
        n = len(words)
        size = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
        begin = np.cumsum(size) - size
        row = np.repeat(np.arange(n), size)
        place = np.arange(len(codes)) - begin[row]
        edges = self.edges(codes, size[row] - place)
        depth = len(edges)
        if n == 1 and T > 64:  # a long word by itself: edges are kept as lists, not as a table
            return np.array([self._long(edges, T)])
        step = np.full((depth, T, n), -np.inf)  # by length, start, word
        for k, (at, score) in enumerate(edges):
            step[k, place[at], row[at]] = score
        alpha = np.full((T + 1, n), -np.inf)
        alpha[0] = 0
        for t in range(1, T + 1):
            ways = np.stack([alpha[t - 1 - k] + step[k, t - 1 - k] for k in range(min(depth, t))])
            top = ways.max(0)
            live = np.isfinite(top)
            alpha[t, live] = top[live] + np.log(np.exp(ways[:, live] - top[live]).sum(0))
        return alpha[size, np.arange(n)]

    @staticmethod
    def _long(edges, T: int) -> float:
        by: list[list[tuple[int, float]]] = [[] for _ in range(T + 1)]
        for k, (at, score) in enumerate(edges):
            for a, s in zip(at.tolist(), score.tolist()):
                by[a + k + 1].append((a, s))
        alpha = [0.0] * (T + 1)
        for t in range(1, T + 1):
            ways = [alpha[a] + s for a, s in by[t]]
            top = max(ways)
            alpha[t] = top + math.log(sum(math.exp(w - top) for w in ways))
        return alpha[T]


def load(path: str = VOCAB) -> Lattice:
    kept = worker_cache("lattice-" + path)
    if "lattice" not in kept:
        kept["lattice"] = Lattice(*piece_scores(path))
    return kept["lattice"]


def udf(path: str = VOCAB):
    def call(array: pa.Array) -> pa.Array:
        lattice, known = load(path), worker_cache("lattice-words-" + path, 800_000)
        number, log_prob, bits = [], [], []
        for t in array.to_pylist():
            if t is None:
                number.append(None)
                log_prob.append(None)
                bits.append(None)
                continue
            words = t.split()
            number.append(len(words))
            got = list(map(known.get, words))
            if None in got:
                new = list({w for w, g in zip(words, got) if g is None})
                known.update(zip(new, lattice.log_probs(new).tolist()))
                got = list(map(known.__getitem__, words))
            total = math.fsum(got)
            log_prob.append(total)
            bits.append(-total / math.log(2) / len(t) if words else None)
        return struct(n_words=pa.array(number, pa.int64()), log_prob=pa.array(log_prob, pa.float64()), bits_per_char=pa.array(bits, pa.float64()))

    return row_udf(call, "n_words bigint, log_prob double, bits_per_char double")


def ranked(scores: DataFrame, by: str = "bits_per_char") -> DataFrame:
    """scores with `rank`, 1 for the smallest value (ties share the first), and `percentile`, its share of the way from first to last.

    Rows are spread by ranges of the value, so no task sees more than its range; one row a range comes to the driver.
    """
    spark = scores.sparkSession
    ranged, _ = stored(scores.filter(col(scores, by).isNotNull()).repartitionByRange(by).withColumn("range_", F.spark_partition_id()), "ranges")
    sizes = {r.range_: r.n for r in ranged.groupBy("range_").agg(F.count("*").alias("n")).collect()}
    total, before, offsets = sum(sizes.values()), 0, []
    for k in sorted(sizes):
        offsets.append((k, before))
        before += sizes[k]
    starts = spark.createDataFrame(offsets, "range_ int, before_ bigint")
    place = F.rank().over(Window.partitionBy("range_").orderBy(by)) + F.col("before_")
    done = ranged.join(F.broadcast(starts), "range_").withColumn("rank", place.cast("bigint")).drop("range_", "before_")  # a row for each range
    rest = scores.filter(col(scores, by).isNull()).withColumn("rank", F.lit(None).cast("bigint"))
    return done.unionByName(rest).withColumn("percentile", (F.col("rank") - 1) / F.lit(float(max(total - 1, 1))))


def score(docs: DataFrame, id_col="doc_id", text_col="text", path: str = VOCAB) -> DataFrame:
    """(doc_id, n_words, log_prob, bits_per_char, rank, percentile) for every row.

    Natural logarithms; characters count white space. Null text: null results. Empty and blank texts: no words, log
    probability 0, null bits, rank and percentile. Texts are read whole, of any length, very long words included. Ties share a
    rank. Repeated rows are each scored and ranked. An empty table gives no rows; other columns are ignored.
    """
    name = free_name(docs, "_lm")
    flat = docs.select(col(docs, id_col).alias("doc_id"), udf(path)(col(docs, text_col)).alias(name))
    scores, _ = stored(flat.select("doc_id", *[F.col(name)[f].alias(f) for f in FIELDS]), "likelihood")
    return ranked(scores)
