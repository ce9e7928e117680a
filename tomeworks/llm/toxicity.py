"""Toxicity behind obfuscation: a noisy channel restores words, a linear model scores what they say.

Tokens that may hide something (signs or digits among letters, letters three times over, single letters in a row) become
character lattices: a sign may stand for letters, a repeated letter for one or two, a gap for nothing. Viterbi decoding under a
character model finds the likeliest reading. All other tokens have one reading, themselves.

The model is logistic regression on words and word beginnings that are found in toxic documents far more often than in
others. It is fitted on all labelled rows; texts are scored whole, each distinct token once per worker.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeworks.llm.common import Maybe, col, expand, filter_by, release, row_udf, struct, texts, worker_cache
from tomeworks.session import discard, stored

#: Numbers in distinct sets of features up to which the regression runs on the driver, some 40 bytes each; with more it runs in tasks.
LOCAL_ENTRIES = 4_000_000
ORDER = 4
STEMS = (4, 5, 6)
#: A feature is considered if its odds are at least this many times higher in toxic documents.
MIN_ODDS = 8.0
FIELDS = ["score", "toxic_words", "is_toxic"]
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
_LETTERS = re.compile(r"[^\W\d_]+")
_ONE, _GAP = r"(?:[^\W_]|[@$!|+*€£(])", r"[.\-_~·]"
_HIDDEN = re.compile(rf"[^\W\d_][0-9@$!|+*€£(]+[^\W\d_]|^[0-9@$!|+€£(]+[^\W\d_]|[^\W\d_][0-9]+$|([^\W\d_])\1\1|^(?:{_ONE}{_GAP}+){{2,}}{_ONE}$")
_GAPS = re.compile(rf"(?<=[^\W_]){_GAP}+(?=[^\W_])")
_DOUBLE = re.compile(r"([^\W\d_])\1")
#: Single characters apart by white space, with or without separators; each may have quotes before and punctuation after it.
_BEFORE, _AFTER = r"[\"'`\[{]*", r"[\"'`.,;:?!)\]}…]*"
_SPACED = re.compile(rf"(?<!\S){_BEFORE}{_ONE}(?:{_AFTER}\s+(?:{_GAP}+\s+)*{_BEFORE}{_ONE}){{2,}}{_AFTER}(?!\S)")
_AROUND = re.compile(rf"(?<!\S){_BEFORE}({_ONE}){_AFTER}(?!\S)|\S+")
_SINGLE = re.compile(rf"(?:{_ONE}(?: |{_GAP})+)+{_ONE}")
_SIGNS = "!$@+|"
_LAST = re.compile(r"[^\W\d_]*\Z")
_TRIM = "\"'`.,;:?#%&=<>[]{}()*~^-_/\\"


class Characters:
    """Interpolated character n-gram model of words, from counts of n-grams of words between ^ and $."""

    def __init__(self, grams: dict[str, float]):
        self.count: list[dict[str, float]] = [defaultdict(float) for _ in range(ORDER + 1)]
        self.follow: list[dict[str, float]] = [defaultdict(float) for _ in range(ORDER)]
        for g, n in grams.items():
            for k in range(1, ORDER + 1):
                self.count[k][g[-k:]] += n
                self.follow[k - 1][g[-k:-1]] += n
        self.kinds = max(len(self.count[1]), 30)
        self.known: dict[str, float] = {}

    def log(self, history: str, c: str) -> float:
        """log P(c | history), history being the ORDER - 1 characters before."""
        got = self.known.get(history + c)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            p = 1.0 / self.kinds / 10
            for k in range(1, ORDER + 1):
                h = history[len(history) - k + 1 :]
                p = (self.count[k].get(h + c, 0.0) + 4 * p) / (self.follow[k - 1].get(h, 0.0) + 4)
            got = self.known[history + c] = float(np.log(p))
        return got


def lattice(piece: str) -> list[list[tuple[str, float]]]:
    """For each run of the same character, what it may stand for and the channel's log probability of that."""
    out = []
    letters = sum(c.isalpha() for c in piece)
    single = len(piece) > 4 and _SINGLE.fullmatch(piece) is not None
    for m in re.finditer(r"(.)\1*", piece, re.S):
        c, n = m[1], len(m[0])
        if single and not c.isalnum() and c not in LEET:
            out.append([("", -0.3), (" ", -1.5)])
        elif c.isalpha():
            if n == 1:
                out.append([(c, 0.0)])
            elif n == 2:
                out.append([(c * 2, 0.0), (c, -1.5)])
            else:
                out.append([(c, -0.5), (c * 2, -0.5)])
        elif c in LEET and letters:
            out.append([(x * k, -1.0 - (k > 1)) for x in LEET[c] for k in {1, min(n, 2)}] + [(" ", -4.0)])
        elif c in ".-_~·" and letters and 0 < m.start() and m.end() < len(piece):
            out.append([(" ", 0.0), ("", -2.0)])
        else:
            out.append([(" ", 0.0)])
    return out


def runs(text: str) -> set[str]:
    """Runs of single characters in a text, in lower case, a space between two; without the signs at their ends as well, which may be decoration."""
    out = set()
    for m in _SPACED.finditer(text):
        one = " ".join(c for c in _AROUND.findall(m[0].lower()) if c)
        if any(c.isalpha() for c in one):
            signs = "".join(LEET).strip("0123456789") + " "
            out |= {one, one.rstrip(signs), one.strip(signs)}
    return out


def decode(piece: str, model: Characters) -> str:
    """The likeliest reading of a piece in lower case; words apart by spaces. Exact Viterbi over the lattice; ties: the reading first in order."""
    start = "^" * (ORDER - 1)
    paths: dict[str, tuple[float, tuple | None]] = {start: (0.0, None)}
    for options in lattice(piece):
        new: dict[str, tuple[float, tuple | None]] = {}
        for history, (score, path) in paths.items():
            for text, cost in options:
                h, s = history, score + cost
                for c in text:
                    if c == " ":
                        s, h = s + (model.log(h, "$") if h[-1] != "^" else 0.0), start
                    else:
                        s, h = s + model.log(h, c), (h + c)[1:]
                if h not in new or s > new[h][0]:
                    new[h] = (s, (path, text))
        paths = new
    best = max(((s + (model.log(h, "$") if h[-1] != "^" else 0.0), -i, path) for i, (h, (s, path)) in enumerate(paths.items())), key=lambda x: x[:2])[2]
    parts = []
    while best is not None:
        best, text = best
        parts.append(text)
    return "".join(reversed(parts))


class Model:
    """Weights of features (words, and ^stems of words), a bias, and the character model."""

    def __init__(self, weights: dict[str, float], bias: float, characters: Characters, key: str):
        self.weights, self.bias, self.characters, self.key = weights, bias, characters, key
        #: Words, and stems as words, in order.
        self.stems = sorted({f.lstrip("^") for f in weights})

    def features(self, word: str) -> list[str]:
        w = self.weights
        return [f for f in (word, *("^" + word[:k] for k in STEMS if len(word) >= k)) if f in w]

    def token(self, token: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """(restored word, its features) of each word of a token that has any."""
        core = token.lower()
        tail = head = ""
        if not core.isalpha():
            whole = core.strip(_TRIM)
            core = whole.rstrip(_TRIM + _SIGNS)
            tail = whole[len(core) :]
            bare = core.lstrip(_SIGNS)
            head = core[: len(core) - len(bare)]
        forms = {core, core[len(head) :]} if len(head) > 2 else {core}  # many signs may be decoration, or letters
        readings, out = set(), []
        for form in forms:
            hidden = _HIDDEN.search(form)
            if not hidden and _DOUBLE.search(form) and any(self.features(w) for w in _LETTERS.findall(_DOUBLE.sub(r"\1", form))):
                hidden = True
            if not hidden and _GAPS.search(form) and any(self.features(w) for w in _LETTERS.findall(_GAPS.sub("", form))):
                hidden = True
            readings |= {form, decode(form, self.characters)} if hidden else {form}
        if tail and core:  # signs at the end are decoration, unless they finish a word that counts
            readings |= {r[: len(r) - len(last)] + w for r in readings for last in [_LAST.search(r)[0]] if last for w in self.finished(last, tail)}
        for r in sorted(readings):
            for w in _LETTERS.findall(r):
                f = self.features(w)
                if f:
                    out.append((w, tuple(f)))
        return tuple(out)

    def finished(self, begun: str, tail: str) -> list[str]:
        """Words or stems that count and that the signs of a tail, from its first on, finish: each run of one sign stands for a letter or several, at most as many as it has signs."""
        runs_ = [(m[1], len(m[0])) for m in re.finditer(r"(.)\1*", tail, re.S)]
        out = []
        at = bisect.bisect_left(self.stems, begun)
        while at < len(self.stems) and self.stems[at].startswith(begun):
            word = self.stems[at]
            at += 1
            if len(word) == len(begun):
                continue
            ways = {len(begun)}
            for sign, n in runs_:
                new = set()
                for i in ways:
                    for letter in LEET.get(sign, ""):
                        k = 0
                        while k < n and word[i + k : i + k + 1] == letter:
                            k += 1
                            new.add(i + k)
                ways = new
                if not ways or len(word) in ways:
                    break
            if len(word) in ways:
                out.append(word)
        return out

    def score(self, text: str, known: dict) -> tuple[float, list[str]]:
        found, words = set(), set()
        tokens = text.split()
        hits = set(map(known.get, tokens))
        if None in hits:
            for t in {t for t in tokens if t not in known}:
                known[t] = self.token(t)
            hits = set(map(known.__getitem__, tokens))
        for run in runs(text):
            hit = known.get(" " + run)  # no token begins with a space
            if hit is None:
                hit = tuple((w, tuple(self.features(w))) for w in decode(run, self.characters).split() if self.features(w))
                if len(run) <= 64:
                    known[" " + run] = hit
            hits.add(hit)
        for hit in hits:
            for w, features in hit:
                words.add(w)
                found.update(features)
        return self.bias + sum(self.weights[f] for f in sorted(found)), sorted(words)


def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, distinct words of the text in lower case, as tokens are read when texts are scored)."""
    for batch in batches:
        words = [sorted(set(_LETTERS.findall(t.lower()))) for t in texts(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["y"], pa.array(words, pa.list_(pa.string()))], ["y", "words"])
        release()


def named(words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple[pa.Array, np.ndarray]]]:
    """Rows and codes of all words of lists, and for words and stems of each length: (features, the feature's number for each code or -1)."""
    flat = words.flatten().dictionary_encode()
    known = flat.dictionary
    size = pc.utf8_length(known).to_numpy(zero_copy_only=False)
    kinds = [(known, np.arange(len(known)))]
    for k in STEMS:
        stems = pc.binary_join_element_wise("^", pc.utf8_slice_codeunits(known, 0, k), "").dictionary_encode()
        kinds.append((stems.dictionary, np.where(size >= k, stems.indices.to_numpy(zero_copy_only=False), -1)))
    return np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False)), flat.indices.to_numpy(zero_copy_only=False), kinds


def feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic documents, documents) of each batch of (y, words)."""
    for batch in batches:
        y, rows = batch["y"].to_numpy(zero_copy_only=False), max(1, len(batch))
        row, code, kinds = named(batch["words"])
        for features, number in kinds:
            f = number[code]
            pairs = np.unique((f * rows + row)[f >= 0])  # a document counts once, however many of its words share a stem
            f, r = pairs // rows, pairs % rows
            n, t = np.bincount(f, minlength=len(features)), np.bincount(f, y[r], len(features)).astype(np.int64)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([features.take(pa.array(some)), pa.array(t[some]), pa.array(n[some].astype(np.int64))], ["f", "t", "n"])
        release()


def feature_sets(names):
    """For mapInArrow: (numbers of a document's features among the broadcast names, as 32-bit integers in order; other, toxic documents with them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, kinds = named(batch["words"])
            n, found = max(1, len(names.value)), []
            for features, number in kinds:
                there = pc.fill_null(pc.index_in(features, value_set=names.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                f = np.append(there, -1)[number][code]
                found.append((row * n + f)[f >= 0])
            pairs = np.unique(np.concatenate(found))
            ends = np.searchsorted(pairs // n, np.arange(len(batch) + 1))
            numbers, by = (pairs % n).astype(np.int32), {}
            for i, y in enumerate(batch["y"].to_pylist()):
                by.setdefault(numbers[ends[i] : ends[i + 1]].tobytes(), [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.binary()), pa.array([c[0] for c in by.values()], pa.int64()), pa.array([c[1] for c in by.values()], pa.int64())], ["s", "other", "toxic"])
            release()

    return run


class Sets:
    """Distinct sets of features, with the numbers of toxic and other documents that have each; of a whole table, or a part of it."""

    def __init__(self, table: pa.Table | pa.RecordBatch, neg: int, pos: int):
        """Both classes weigh alike: their documents, neg and pos in all, share a half each."""
        numbers = table["s"].to_pylist()
        self.flat = np.frombuffer(b"".join(numbers), np.int32)
        self.owner = np.repeat(np.arange(len(numbers)), [len(s) // 4 for s in numbers])
        self.other, self.toxic = (table[c].to_numpy().astype(np.int64) if isinstance(table, pa.Table) else table[c].to_numpy(zero_copy_only=False) for c in ("other", "toxic"))
        self.up, self.all = self.toxic * (0.5 / pos), self.toxic * (0.5 / pos) + self.other * (0.5 / neg)

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        return b + np.bincount(self.owner, w[self.flat], len(self.other))

    def slope(self, w: np.ndarray, b: float) -> np.ndarray:
        """The derivative of the log likelihood by each weight, and by the bias."""
        d = self.up - self.all / (1 + np.exp(-self.scores(w, b)))
        return np.append(np.bincount(self.flat, d[self.owner], len(w)), d.sum())

    def cut(self, w: np.ndarray, b: float) -> float:
        return cut(self.scores(w, b), self.other, self.toxic)


class SpreadSets:
    """The same of a table of any size: each call is a job, of which derivatives or one row come to the driver."""

    def __init__(self, table: DataFrame, neg: int, pos: int):
        self.table, self.neg, self.pos = table, neg, pos

    def mapped(self, w: np.ndarray, b: float, each, returns: str) -> DataFrame:
        neg, pos, sent = self.neg, self.pos, self.table.sparkSession.sparkContext.broadcast((w, b))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield each(Sets(batch, neg, pos), *sent.value)

        return self.table.mapInArrow(run, returns)

    def slope(self, w: np.ndarray, b: float) -> np.ndarray:
        def each(sets: Sets, w: np.ndarray, b: float) -> pa.RecordBatch:
            g = sets.slope(w, b)
            at = np.flatnonzero(g)
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(g[at])], ["i", "g"])

        got = self.mapped(w, b, each, "i bigint, g double").groupBy("i").agg(F.sum("g").alias("g")).toArrow()  # at most one row a feature
        out = np.zeros(len(w) + 1)
        out[got["i"].to_numpy()] = got["g"].to_numpy()
        return out

    def cut(self, w: np.ndarray, b: float) -> float:
        def each(sets: Sets, w: np.ndarray, b: float) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sets.scores(w, b)), pa.array(sets.other), pa.array(sets.toxic)], ["z", "other", "toxic"])

        by = self.mapped(w, b, each, "z double, other bigint, toxic bigint").groupBy("z").agg((F.sum("other") * F.lit(self.pos) - F.sum("toxic") * F.lit(self.neg)).alias("step"))
        order = Window.orderBy("z")  # one task, which sorts distinct scores alone, on disk if need be
        edges = by.select("z", F.sum("step").over(order).alias("gain"), F.lag("z").over(order).alias("before"), F.coalesce(F.lead("z").over(order), F.col("z") + 1).alias("next"))
        spots = edges.select("gain", (F.col("next") - F.col("z")).alias("gap"), ((F.col("next") + F.col("z")) / 2).alias("at"))
        first = edges.filter("before IS NULL").select(F.lit(0).cast("bigint"), F.lit(1.0), F.col("z") - 0.5)
        return spots.union(first).orderBy(F.desc("gain"), F.desc("gap"), "at").first()["at"]


def regression(sets: Sets | SpreadSets, n: int, rounds: int = 300, rate: float = 0.1, penalty: float = 0.002) -> tuple[np.ndarray, float]:
    """Weights, none of them negative, and bias of a logistic regression on binary features."""
    w, b = np.zeros(n), -1.0
    m1, m2 = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        g = sets.slope(w, b)
        g[:-1] -= penalty * w / max(1, n) ** 0.5
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = np.maximum(w + step[:-1], 0), min(b + step[-1], -0.5)
    return w, float(b)


def cut(z: np.ndarray, other: np.ndarray, toxic: np.ndarray) -> float:
    """Where to cut scores so that the share of toxic documents above it less that of others is largest; the middle of the widest such gap."""
    z, which = np.unique(z, return_inverse=True)
    step = np.zeros(len(z), np.int64)
    np.add.at(step, which, other * toxic.sum() - toxic * other.sum())
    gain = np.append(0, np.cumsum(step))
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    best = np.flatnonzero(gain == gain.max())
    k = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", local_entries: int = LOCAL_ENTRIES) -> Model:
    """The model from all labelled rows: counts, weights and the cut.

    Rows without text, id or label don't count. Documents that repeat an id count once, by the first of their texts in order; an id
    that is labelled both ways counts in both classes. Without toxic rows, or without others, nothing is toxic to the model. To the
    driver come character n-grams, names of features, and the distinct sets of features that documents have if these hold at most
    local_entries numbers; else the regression's rounds run in tasks.
    """
    spark = docs.sparkSession
    lab = labels.select(col(labels, id_col).alias("id"), col(labels, label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").distinct()
    rows = docs.select(col(docs, id_col).alias("id"), col(docs, text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    kinds = {t.schema["id"].dataType.simpleString() for t in (lab, rows)}
    if kinds in ({"bigint"}, {"string"}):  # only texts that may be labelled move
        rows = filter_by(rows, Maybe(lab, "id").has(F.col("id")))
    labelled = rows.join(lab, "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("y", "text")
    places = []
    try:
        found, at = stored(labelled.mapInArrow(distinct_words, "y int, words array<string>"), "words")
        places.append(at)
        total = {r.y: r.n for r in found.groupBy("y").agg(F.count("*").alias("n")).collect()}
        pos, neg = total.get(1, 0), total.get(0, 0)
        counts, at = stored(found.mapInArrow(feature_counts, "f string, t bigint, n bigint").groupBy("f").agg(F.sum("t").alias("t"), F.sum("n").alias("n")), "counts")
        places.append(at)
        # character n-grams of distinct words by the number of documents with the word
        edges = F.concat(F.lit("^" * (ORDER - 1)), F.col("f"), F.lit("$"))
        grams = counts.filter(~F.col("f").startswith("^")).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("f") + 1), lambda i: edges.substr(i, F.lit(ORDER)))).alias("g"), "n")
        grams = {r.g: float(r.n) for r in grams.groupBy("g").agg(F.sum("n").alias("n")).collect()}
        characters = Characters(grams)
        if not pos or not neg:
            return Model({}, -1.0, characters, "none")
        odds = ((F.col("t") + 0.5) / (pos + 1)) / ((F.col("n") - F.col("t") + 0.5) / (neg + 1))
        names = sorted(counts.filter((F.col("t") >= 2) & (odds >= MIN_ODDS)).select("f").toArrow()["f"].to_pylist())
        every = found.mapInArrow(feature_sets(spark.sparkContext.broadcast(pa.array(names, pa.string()))), "s binary, other bigint, toxic bigint")
        sets, at = stored(every.groupBy("s").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")), "sets")
        places.append(at)
        entries = sets.agg(F.sum(F.length("s") / 4 + 1)).first()[0]
        table = Sets(sets.toArrow().sort_by("s"), neg, pos) if entries <= local_entries else SpreadSets(sets, neg, pos)
        w, b = regression(table, len(names))
        w[w <= 0.05] = 0
        b -= table.cut(w, b)
    finally:
        for at in places:
            discard(spark, at)
    weights = {f: float(x) for f, x in zip(names, w) if x}
    return Model(weights, float(b), characters, f"{hash((tuple(sorted(weights.items())), b, tuple(sorted(grams.items()))))}")


def udf(model: Model):
    def call(array: pa.Array) -> pa.Array:
        known = worker_cache("toxicity-" + model.key, 150_000)
        got = [model.score(t, known) for t in texts(array)]
        ok = array.is_valid().to_pylist()
        return struct(
            score=pa.array([s if v else None for (s, _), v in zip(got, ok)], pa.float64()), toxic_words=pa.array([w if v else None for (_, w), v in zip(got, ok)], pa.list_(pa.string())),
            is_toxic=pa.array([bool(v and s > 0) for (s, _), v in zip(got, ok)], pa.bool_()),
        )

    return row_udf(call, "score double, toxic_words array<string>, is_toxic boolean")


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, score, toxic_words, is_toxic) for every row; toxic if the score, a log odds, is above 0.

    toxic_words are the restored words that count, each once, in order. Null text: null score and words, not toxic. Empty
    texts: the bias, not toxic. Texts are read whole, of any length. Repeated rows give repeated results, an empty table none;
    other columns are ignored.
    """
    return expand(docs, id_col, udf(model)(col(docs, text_col)), FIELDS)


def keep(docs: DataFrame, model: Model, text_col="text") -> DataFrame:
    """The rows of docs, unchanged, that aren't toxic.

    Null and empty texts stay; texts count whole; rows that repeat stay or go together; a score of 0 stays; an empty table gives no
    rows; extra columns may have any names.
    """
    return filter_by(docs, ~udf(model)(col(docs, text_col))["is_toxic"])
