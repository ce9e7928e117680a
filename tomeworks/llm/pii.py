"""Personal data by a linear-chain conditional random field over word shapes.

Tokens are runs of characters other than white space. A token's own features are its shape (runs of digits, lower and
upper case letters, each other sign), lengths of its digit runs and what it holds; its neighbours give their coarse class.
The field is trained by gradient ascent on the conditional likelihood of a small labelled table and decoded by Viterbi.

Decoding is exact but skips what can't matter. A token for which "no personal data" beats every other label by more than all
that neighbours and transitions could add is decided on the spot, and splits its text in two independent chains. Words without digit, @
or = that have only such words beside them and no cue before them are mostly so; whether they are is computed from the weights, for
each look of a word, and where they aren't, all tokens are decoded with their neighbours. A word behind a cue such as
"password =" or "pwd:" has a feature of its own and is always decoded. Neighbours count however far they are. Shapes are features of
bounded length: the first 16 runs of a token's form, its first six runs of digits. Chains are decoded together, in numpy batches.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tomeworks.llm.common import col, expand, free_name, row_udf, struct, texts, worker_cache

LABELS = ["O", "EMAIL", "PHONE", "IP", "CARD", "KEY", "PASSWORD", "ID"]
TOKEN = re.compile(r"\S+")
FIELDS = ["text", "n_found", "labels", "starts", "ends"]
_EDGE = "\"'()[]{}<>.,;:!?*#%$&|`"
_RUNS = re.compile(r"([0-9]+)|([a-z]+)|([A-Z]+)|([^\W\d_]+)|(.)", re.S)
_HEX = re.compile(r"[0-9a-f]{12,}|[0-9A-F]{12,}")
_MIXED = re.compile(r"(?=[A-Za-z0-9_+/\-]*[0-9])(?=[A-Za-z0-9_+/\-]*[A-Za-z])[A-Za-z0-9_+/\-]{12,}={0,2}")
#: A token without any of these is a word to the model, whatever its letters.
_SIGNS = re.compile(r"[0-9@=]")
#: What a token holds that has to be looked at, or that a value may follow; words of LONG letters or more may be keys.
LONG = 24
_LOOK = re.compile(rf"[0-9@=]|:(?!\S)|(?<!\S)\S{{{LONG}}}")
_CUES = ("password", "passwd", "pwd", "passphrase")
_SECRET = ("token", "secret", "api_key", "apikey", "key", "auth")


_CUE = re.compile(rf"(?:.*[_\-.])?(?:({'|'.join(_CUES)})|({'|'.join(_SECRET)}))", re.S)
_IS = ("=", ":=", ":", "==", "=>")
#: What may stand in the place of such a sign before a value that isn't a plain word.
_SAID = ("is", "was", "ist", "es", "est")


def behind(before: str, last: str, said: tuple[str, ...] = _IS) -> str:
    """Whether a token that these two precede is the value of a password ("pw") or of a key ("secret"), or of neither ("")."""
    name = before if last in said else last if last[-1:] in (":", "=") else ""
    m = _CUE.fullmatch(name.strip(_EDGE + "=").lower()) if name else None
    return "" if m is None else "pw" if m[1] else "secret"


def contextual(tokens: list[str], i: int) -> tuple[str, ...]:
    """Names of the features that a token has from the two before it."""
    if not i or tokens[i] in _IS:
        return ()
    before, last = tokens[i - 2] if i > 1 else "", tokens[i - 1]
    if _SIGNS.search(tokens[i]):
        cue = behind(before, last, _IS + _SAID)
        return (f"said={cue}",) if cue else ()
    cue = behind(before, last)
    return (f"behind={cue}", f"behind={cue}-{min(len(tokens[i]) // 12, 3)}") if cue else ()


def core(token: str) -> tuple[int, int]:
    """Where the token begins and ends without quotes, brackets and punctuation around it."""
    left, right = len(token) - len(token.lstrip(_EDGE)), len(token.rstrip(_EDGE))
    return (left, right) if left < right else (0, len(token))


def features(token: str) -> tuple[str, ...]:
    """Names of a token's own features."""
    if not _SIGNS.search(token):
        low = token.strip(_EDGE).lower()
        cue = "pw" if low in _CUES else "secret" if low in _SECRET else "word"
        return ("word", f"cue={cue}", f"long={min(len(token) // 12, 3)}")
    a, b = core(token)
    inner = token[a:b]
    parts = ["9" * min(len(m[1]), 4) + ("+" if len(m[1]) > 4 else "") if m[1] else "a" if m[2] else "A" if m[3] else "x" if m[4] else m[5] for m in _RUNS.finditer(inner)]
    short = []
    for p in parts:
        if not short or short[-1] != p:
            short.append(p)
    digits = re.findall(r"[0-9]+", inner)
    n = sum(map(len, digits))
    out = ["signs", "shape=" + "".join(short)[:16], f"digits={n if n < 20 else 20}", "runs=" + "-".join(str(min(len(d), 5)) for d in digits[:6])]
    if "@" in inner:
        user, _, host = inner.partition("@")
        out.append("at=" + ("mail" if user and "." in host.strip(".") and "@" not in host else "other"))
    if n and not re.search(r"[^\W\d_]", inner):
        out.append("numeric")
        if re.fullmatch(r"(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}(:\d+)?", inner):
            out.append("quad")
        if 13 <= n <= 19 and re.fullmatch(r"\d+(?:[ -]\d+)*", inner):
            out.append("cardlike")
        if re.fullmatch(r"\d{3}-\d{2}-\d{4}", inner):
            out.append("three-two-four")
        if re.fullmatch(r"\+?\(?\d[\d().\-]{6,}\d", inner) and re.search(r"[-()+]", inner):
            out.append("dashed")
    if token[:1] == "+" and digits:
        out.append("plus")
    if token[:1] == "(" and re.match(r"\(\d{2,4}\)", token):
        out.append("area")
    if _HEX.fullmatch(inner):
        out.append("hex")
    if _MIXED.fullmatch(inner):
        out.append("mixed")
    if re.match(r"(AKIA|ASIA)[A-Z0-9]{16}$", inner):
        out.append("access")
    if re.match(r"(sk|pk|ghp|gho|xox[abp])[-_]", inner):
        out.append("prefixed")
    if "=" in inner:
        left = inner.partition("=")[0].lower().rstrip(":")
        out.append("assign=" + ("pw" if left.endswith(_CUES) else "secret" if left.endswith(_SECRET) else "empty" if not left else "other"))
    return tuple(out)


def classes(token: str) -> str:
    """Coarse class of a token as its neighbours see it."""
    if not _SIGNS.search(token):
        low = token.strip(_EDGE).lower()
        return "pw" if low in _CUES else "secret" if low in _SECRET else "word"
    inner = token.strip(_EDGE)
    if token[:1] == "+":
        return "plus"
    if token[:1] == "(":
        return "area"
    if token in ("=", ":="):
        return "equals"
    if "@" in token:
        return "at"
    digits = sum(c.isdigit() for c in inner)
    return "digits3" if digits == 3 == len(inner) else "dashed" if "-" in inner and digits else "number" if digits == len(inner) else "other"


CLASSES = ["edge", "word", "pw", "secret", "plus", "area", "equals", "at", "digits3", "dashed", "number", "other"]


def training_rows(n: int = 500, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """A small labelled table, (tokens, labels): invented sentences with invented personal data of common formats.

    A good part of the rows holds numbers, codes and signs that aren't personal data.
    """
    rnd = random.Random(seed)
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    low = lambda a, b: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(a, b)))
    hexa = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    code = lambda k: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567890") for _ in range(k))

    def word():
        w = low(1, 11)
        w = rnd.choice([w, w, w, w.capitalize(), w.upper()])
        return w + rnd.choice(["", "", "", "", "", ",", ".", "!", "###", "$$$", "%%%", "***", "&&&", "!!", "?", ";", ":", " |"]).strip()

    def email():
        user = rnd.choice([lambda: f"{low(2, 9)}.{d(2)}", lambda: f"{low(2, 8)}.{low(2, 9)}", lambda: low(3, 10), lambda: f"{low(3, 8)}{d(rnd.randint(1, 4))}", lambda: f"{low(2, 6)}_{low(2, 6)}", lambda: f"{low(2, 6)}+{low(2, 5)}", lambda: f"{low(1, 1).upper()}{low(3, 6)}"])()
        host = rnd.choice([lambda: f"mail{d(1)}.{low(4, 8)}.com", lambda: f"{low(3, 9)}.{rnd.choice(['com', 'org', 'net', 'de', 'fr', 'io'])}", lambda: f"{low(3, 6)}-{low(2, 5)}.co.uk", lambda: f"{low(3, 6)}{d(1)}.net"])()
        return [(f"{user}@{host}", "EMAIL")]

    def phone():
        kind = rnd.randrange(8)
        if kind < 3:
            return [("+" + rnd.choice(["1", "1", "44", "49", "33", "34"]), "PHONE"), (f"({d(3)})", "PHONE"), (f"{d(3)}-{d(4)}", "PHONE")]
        if kind == 3:
            return [(f"({d(3)})", "PHONE"), (f"{d(3)}-{d(4)}", "PHONE")]
        if kind == 4:
            return [(f"{d(3)}-{d(3)}-{d(4)}", "PHONE")]
        if kind == 5:
            return [(f"+{d(rnd.choice([1, 2]))}-{d(3)}-{d(3)}-{d(4)}", "PHONE")]
        if kind == 6:
            return [(f"+{d(2)}", "PHONE"), (d(3), "PHONE"), (d(rnd.choice([7, 8])), "PHONE")]
        return [(f"+{d(rnd.choice([11, 12]))}", "PHONE")]

    octet = lambda: str(rnd.randint(0, 255))
    secret = lambda: rnd.choice([hexa(40), hexa(40), hexa(32), hexa(64), code(24) + d(2), low(6, 9) + d(6) + code(8)])
    quoted = lambda s: rnd.choice([f'"{s}"', f'"{s}"', f"'{s}'", s])
    makers = [
        email, email, phone, phone,
        lambda: [(".".join(octet() for _ in range(4)) + rnd.choice(["", "", "", ":" + d(4)]), "IP")],
        lambda: [(rnd.choice("3456") + d(rnd.choice([15, 15, 15, 14, 12])), "CARD")],
        lambda: [(rnd.choice([f"{rnd.choice('345')}{d(3)}-{d(4)}-{d(4)}-{d(4)}"]), "CARD")],
        lambda: [(rnd.choice("345") + d(3), "CARD"), (d(4), "CARD"), (d(4), "CARD"), (d(4), "CARD")],
        lambda: [(rnd.choice(["AKIA", "AKIA", "ASIA"]) + code(16), "KEY")],
        lambda: [(rnd.choice(["token", "secret", "api_key", "key"]), "O"), ("=", "O"), (quoted(secret()), "KEY")],
        lambda: [(f"{rnd.choice(['token', 'secret', 'api_key', 'key'])}={secret()}", "KEY")],
        lambda: [(rnd.choice(["sk-", "ghp_", "xoxb-"]) + low(4, 6) + d(8) + low(8, 14), "KEY")],
        lambda: [(secret(), "KEY")],
        lambda: [(f"{rnd.choice(['password', 'password', 'passwd', 'pwd'])}={rnd.choice([hexa(18), hexa(12), low(4, 7) + d(4), low(3, 5) + '!' + d(3)])}", "PASSWORD")],
        lambda: [(rnd.choice(["password", "pwd"]), "O"), ("=", "O"), (quoted(rnd.choice([hexa(18), low(4, 7) + d(4)])), "PASSWORD")],
        lambda: [(f"{d(3)}-{d(2)}-{d(4)}", "ID")],
        lambda: [(rnd.choice(["DE", "FR", "ES", "GB"]) + d(20), "ID")],
    ]
    plain = [
        lambda: d(rnd.randint(1, 7)), lambda: f"{d(rnd.randint(1, 3))}.", lambda: f"{d(1)}.{d(1)}", lambda: f"v{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(1)}.{d(1)}.", lambda: f"{d(2)}%", lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"${d(3)}.{d(2)}", lambda: f"{d(2)}/{d(2)}/{d(4)}",
        lambda: f"{low(1, 3)}{d(2)}", lambda: f"{low(2, 6)}={d(rnd.randint(1, 3))}", lambda: f"@{low(3, 9)}", lambda: "=", lambda: f"({d(4)})", lambda: f"({d(1)})", lambda: f"[{d(2)}]", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"+{d(1)}", lambda: f"{low(2, 5)}={low(2, 5)}", lambda: f"{d(3)}", lambda: f"{d(2)}-{d(2)}", lambda: f"#{d(4)}", lambda: f"{low(1, 2)}@", lambda: f"{low(2, 4).upper()}-{d(3)}", lambda: f"{d(4)}–{d(4)}", lambda: f"==", lambda: f"{low(2, 4)}==",
    ]
    rows = []
    for _ in range(n):
        row: list[tuple[str, str]] = []
        for _ in range(rnd.randint(1, 4)):
            row += [(word(), "O") for _ in range(rnd.randint(0, 5))]
            row += rnd.choice(makers)() if rnd.random() < 0.6 else [(rnd.choice(plain)(), "O")]
            if rnd.random() < 0.15:
                row[-1] = (row[-1][0] + rnd.choice([".", ",", ";"]), row[-1][1])
        row += [(word(), "O") for _ in range(rnd.randint(0, 4))]
        row += [(rnd.choice([*_CUES, *_SECRET]), "O")] if rnd.random() < 0.15 else []
        rows.append(([t for t, _ in row], [k for _, k in row]))
    return rows


def value_rows(n: int = 250, seed: int = 12) -> list[tuple[list[str], list[str]]]:
    """More labelled rows, of values of letters only behind cues. Behind "key" and the like only long ones are keys; short ones are words."""
    rnd = random.Random(seed)
    low = lambda a, b: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(a, b)))
    case = lambda w: rnd.choice([w, w, w.capitalize(), w.upper()])
    rows = []
    for i in range(n):
        cue, label = (rnd.choice(_CUES), "PASSWORD") if i % 2 else (rnd.choice(_SECRET), "KEY")
        short = label == "KEY" and rnd.random() < 0.4
        value = low(4, 20) if label == "PASSWORD" else low(2, 9) if short else low(24, 48)
        value = rnd.choice(["{}", "{}", '"{}"', "'{}'", "{}.", "{},"]).format(case(value))
        label, name = "O" if short else label, case(cue)
        said = rnd.choice([[(name, "O"), ("=", "O"), (value, label)], [(name, "O"), ("=", "O"), (value, label)], [(name, "O"), (":", "O"), (value, label)], [(name + ":", "O"), (value, label)], [(name + ":", "O"), (value, label)], [(name + "=", "O"), (value, label)], [(f"{name}={value}", label)], [(name, "O"), (low(2, 9), "O")]])
        row = [*[(case(low(1, 11)), "O") for _ in range(rnd.randint(0, 3))], *said, *[(case(low(1, 11)), "O") for _ in range(rnd.randint(0, 3))]]
        rows.append(([t for t, _ in row], [k for _, k in row]))
    return rows


def said_rows(n: int = 200, seed: int = 13) -> list[tuple[list[str], list[str]]]:
    """More labelled rows, of values with digits that follow a cue without a sign, and of short numbers after one, which are none."""
    rnd = random.Random(seed)
    pick = lambda letters, k: "".join(rnd.choice(letters) for _ in range(k))
    low = lambda a, b: pick("abcdefghijklmnopqrstuvwxyz", rnd.randint(a, b))
    case = lambda w: rnd.choice([w, w, w.capitalize(), w.upper()])
    rows = []
    for i in range(n):
        value = rnd.choice([lambda: low(4, 9) + pick("0123456789", rnd.randint(1, 4)), lambda: low(1, 2) + "".join(pick("0123456789", 1) + low(1, 1) for _ in range(rnd.randint(2, 5))), lambda: pick("0123456789", rnd.randint(6, 10)), lambda: case(low(2, 5)) + pick("0123456789", 2) + low(1, 4)])()
        label = "PASSWORD"
        if i % 3 == 2:
            value, label = rnd.choice([pick("0123456789", rnd.randint(1, 3)), f"{pick('0123456789', 4)}-{pick('0123456789', 2)}-{pick('0123456789', 2)}", f"{pick('0123456789', 2)}%", f"{pick('0123456789', 1)}.{pick('0123456789', 1)}"]), "O"
        row = [(case(low(1, 11)), "O") for _ in range(rnd.randint(0, 3))] + [(case(rnd.choice(_CUES)), "O")]
        row += [(rnd.choice(_SAID), "O")] if rnd.random() < 0.4 else []
        row += [(value, label)] + [(case(low(1, 11)), "O") for _ in range(rnd.randint(0, 3))]
        rows.append(([t for t, _ in row], [k for _, k in row]))
    return rows


def training_table(spark: SparkSession, n: int = 500, seed: int = 11) -> DataFrame:
    """training_rows() as a table (row_id, tokens, labels)."""
    return spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(training_rows(n, seed))], "row_id int, tokens array<string>, labels array<string>")


class Field:
    """A linear-chain CRF: weights of a token's own features, its neighbours' classes, and transitions."""

    def __init__(self, names: dict[str, int], own: np.ndarray, before: np.ndarray, after: np.ndarray, move: np.ndarray):
        self.names, self.own, self.before, self.after, self.move = names, own, before, after, move
        self.key = hashlib.sha1(b"".join(w.tobytes() for w in (own, before, after, move)) + repr(names).encode()).hexdigest()
        #: What neighbours and transitions can add to each label's lead over O, at most.
        self.bound = (before - before[:, :1]).max(0) + (after - after[:, :1]).max(0) + np.maximum((move - move[:, :1]).max(0), 0) + np.maximum((move - move[:1]).max(1), 0)

        plain = [CLASSES.index(c) for c in ("edge", "word", "pw", "secret")]
        #: The same where only words are beside the token.
        self.near = (before - before[:, :1])[plain].max(0) + (after - after[:, :1])[plain].max(0) + np.maximum((move - move[:, :1]).max(0), 0) + np.maximum((move - move[:1]).max(1), 0)

    def more(self, names: tuple[str, ...]) -> np.ndarray:
        """What contextual features add to a token's score."""
        at = [self.names[f] for f in names if f in self.names]
        return self.own[at].sum(0) if at else np.zeros(len(LABELS))

    def score(self, token: str) -> np.ndarray:
        at = [self.names[f] for f in features(token) if f in self.names]
        return self.own[at].sum(0) if at else np.zeros(len(LABELS))

    def certain(self, score: np.ndarray, bound: np.ndarray | None = None) -> bool:
        """Whether O is this token's label in every context, or in those of another bound."""
        return bool((score[0] - score[1:] > (self.bound if bound is None else bound)[1:]).all())


def train(rows: Iterable[tuple[list[str], list[str]]], steps: int = 150, rate: float = 0.2, penalty: float = 2e-4) -> Field:
    """Weights that maximise the conditional likelihood, with an L2 penalty, by Adam on all rows at once.

    Rows without tokens don't count; without any rows the field labels everything O.
    """
    rows = [(t, k) for t, k in rows if t]
    names: dict[str, int] = {"word": 0}
    index = {c: i for i, c in enumerate(CLASSES)}
    count: dict[str, int] = {}
    feats = [[features(t) + contextual(tokens, i) for i, t in enumerate(tokens)] for tokens, _ in rows]
    for row in feats:
        for fs in row:
            for f in fs:
                count[f] = count.get(f, 0) + 1
    for f, c in count.items():
        if c > 1:
            names.setdefault(f, len(names))
    L, n = len(LABELS), len(rows)
    own = np.zeros((len(names), L))
    before, after, move = np.zeros((len(CLASSES), L)), np.zeros((len(CLASSES), L)), np.zeros((L, L))
    if not n:
        own[0, 0] = 100.0
        return Field(names, own, before, after, move)
    T = max(len(t) for t, _ in rows)
    gold, mask = np.zeros((n, T), int), np.zeros((n, T), bool)
    prev, nxt = np.zeros((n, T), int), np.zeros((n, T), int)
    for i, (tokens, labels) in enumerate(rows):
        k, m = [index[classes(t)] for t in tokens], len(tokens)
        mask[i, :m] = True
        gold[i, :m] = [LABELS.index(y) for y in labels]
        prev[i, 1:m], nxt[i, : m - 1] = k[:-1], k[1:]
    flat = np.flatnonzero(mask.ravel())
    x = np.zeros((n * T, len(names)), np.float32)
    for i, row in enumerate(feats):
        for t, fs in enumerate(row):
            x[i * T + t, [names[f] for f in fs if f in names]] = 1
    x = x[flat]
    near = np.concatenate([np.eye(len(CLASSES), dtype=np.float32)[prev.ravel()[flat]], np.eye(len(CLASSES), dtype=np.float32)[nxt.ravel()[flat]]], 1)
    x = np.concatenate([x, near], 1)
    onehot = np.eye(L)[gold] * mask[..., None]
    pairs = np.einsum("ita,itb->ab", onehot[:, :-1], onehot[:, 1:])
    weights = [np.concatenate([own, before, after]), move]
    moment = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, steps + 1):
        e = np.zeros((n * T, L))
        e[flat] = x @ weights[0].astype(np.float32)
        e = e.reshape(n, T, L)
        e = np.exp(e - e.max(2, keepdims=True))
        go = np.exp(weights[1])
        alpha, beta = np.empty((n, T, L)), np.ones((n, T, L)) / L
        alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for t in range(1, T):
            new = e[:, t] * (alpha[:, t - 1] @ go)
            alpha[:, t] = np.where(mask[:, t, None], new / new.sum(1, keepdims=True), alpha[:, t - 1])
        for t in range(T - 2, -1, -1):
            new = (e[:, t + 1] * beta[:, t + 1]) @ go.T
            beta[:, t] = np.where(mask[:, t + 1, None], new / new.sum(1, keepdims=True), 1 / L)
        prob = alpha * beta * mask[..., None]
        prob /= np.maximum(prob.sum(2, keepdims=True), 1e-300)
        joint = alpha[:, :-1, :, None] * go * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
        joint /= joint.sum((2, 3), keepdims=True)
        expected = (joint * mask[:, 1:, None, None]).sum((0, 1))
        diff = (onehot - prob).reshape(n * T, L)[flat] / n
        grads = [x.T @ diff.astype(np.float32), (pairs - expected) / n]
        for w, g, (m1, m2) in zip(weights, grads, moment):
            g = g - penalty * w
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.999
            m2 += 0.001 * g * g
            w += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    f, c = len(names), len(CLASSES)
    return Field(names, weights[0][:f], weights[0][f : f + c], weights[0][f + c :], weights[1])


def viterbi(chains: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """Best labels of each chain of emission scores [tokens, labels]; chains of like length are decoded together. Ties: the label first in order."""
    out: list = [None] * len(chains)
    by = np.argsort([len(c) for c in chains], kind="stable")
    for first in range(0, len(by), 4096):
        part = by[first : first + 4096]
        length = np.array([len(chains[i]) for i in part])
        T, L = int(length.max()), move.shape[0]
        e = np.zeros((len(part), T, L))
        for r, i in enumerate(part):
            e[r, : length[r]] = chains[i]
        best, back = e[:, 0], np.zeros((len(part), T, L), np.int8)
        for t in range(1, T):
            s = best[:, :, None] + move
            back[:, t] = s.argmax(1)
            best = np.where((t < length)[:, None], s.max(1) + e[:, t], best)
        label = best.argmax(1)
        got = np.zeros((len(part), T), np.int8)
        for t in range(T - 1, -1, -1):
            inside = t < length
            got[inside, t] = label[inside]
            label = np.where(inside, back[np.arange(len(part)), t, label], label)
        for r, i in enumerate(part):
            out[i] = got[r, : length[r]]
    return out


def decode_all(field: Field, strings: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, end, label) of every token of every text whose label isn't O, found by exact Viterbi decoding."""
    known = worker_cache(f"pii-{field.key}")
    index = {c: i for i, c in enumerate(CLASSES)}
    plain = worker_cache(f"pii-plain-{field.key}")
    if not plain:  # all that shorter tokens without signs can look like
        plain["all"] = all(field.certain(field.score(w), field.near) for w in ("a", "a" * 12, *_CUES, *_SECRET, *(c + "." * 12 for c in (*_CUES, *_SECRET))))

    def look(token: str) -> tuple[np.ndarray, int, bool]:
        got = known.get(token)
        if got is None:
            s = field.score(token)
            got = known[token] = (s, index[classes(token)], field.certain(s))
        return got

    chains, where = [], []
    for row, text in enumerate(strings):
        if plain["all"]:  # only tokens with signs, those beside them and values need to be looked at
            seen, end = {}, 0
            for m in _LOOK.finditer(text):
                if m.start() < end:
                    continue
                a = m.start()
                while a > end and not text[a - 1].isspace():
                    a -= 1
                stop = TOKEN.match(text, a).end()
                left, right = _left(text, a), TOKEN.search(text, stop)
                if _SIGNS.search(text, a, stop):
                    seen.update({left[0]: left[1]} if left else {})
                    seen[a] = stop
                    seen.update({right.start(): right.end()} if right else {})
                else:
                    if stop - a >= LONG:
                        seen[a] = stop
                    if right and behind(text[left[0] : left[1]] if left else "", text[a:stop]):
                        seen[right.start()] = right.end()
                end = stop
            spans = sorted(seen.items())
        else:
            spans = [m.span() for m in TOKEN.finditer(text)]
        if not spans:
            continue
        chain: list[np.ndarray] = []
        at: list[tuple[int, int]] = []
        for k, (a, b) in enumerate(spans):
            token = text[a:b]
            score, _, sure = look(token) if b - a < 200 else (field.score(token), 0, False)
            joined = bool(at) and TOKEN.search(text, at[-1][1]).start() == a
            if chain and not joined:
                chains.append(_fenced(chain, field.move, True, at, text))
                where.append((row, at))
                chain, at = [], []
            left = text[max(0, a - 200) : a].split()
            if len(left) < 3 and a > 200:  # the window may have cut them
                left = _before(text, a, 2)
            context = contextual([*left[-2:], token], len(left[-2:]))
            if context:
                score = score + field.more(context)
                sure = field.certain(score)
            if sure and not chain:
                continue
            right = TOKEN.search(text, b)
            e = score + field.before[index[classes(left[-1])] if left else 0] + field.after[index[classes(right.group())] if right else 0]
            if not chain:
                e = e + (field.move[0] if left else 0)  # the token before is O for sure, or there is none
            chain.append(e)
            at.append((a, b))
            if sure:
                chains.append(_fenced(chain, field.move, False, at, text))
                where.append((row, at))
                chain, at = [], []
        if chain:
            chains.append(_fenced(chain, field.move, True, at, text))
            where.append((row, at))
    out: list[list[tuple[int, int, int]]] = [[] for _ in strings]
    for (row, at), labels in zip(where, viterbi(chains, field.move) if chains else []):
        out[row] += [(a, b, int(k)) for (a, b), k in zip(at, labels) if k]
    return out


def _left(text: str, a: int) -> tuple[int, int] | None:
    """Where the token before position a, at which another begins, is; None if there is none."""
    most = 64
    while True:
        low = max(0, a - most)
        part = text[low:a].rstrip()
        if part:
            start, stop = low + len(part) - len(part.split()[-1]), low + len(part)
            if start > low or not low:
                return start, stop
        elif not low:
            return None
        most *= 4


def _before(text: str, a: int, n: int) -> list[str]:
    """The last n tokens before position a, fewer if there are none."""
    out: list[str] = []
    at = _left(text, a)
    while at and len(out) < n:
        out.append(text[at[0] : at[1]])
        at = _left(text, at[0])
    return out[::-1]


def _fenced(chain: list[np.ndarray], move: np.ndarray, ends: bool, at: list, text: str) -> np.ndarray:
    """The chain's scores, its last token's with the move to the sure O that follows, if the chain ends before one."""
    e = np.array(chain)
    if ends and TOKEN.search(text, at[-1][1]):
        e[-1] = e[-1] + move[:, 0]
    return e


def redact(text: str, found: list[tuple[int, int, int]]) -> tuple[str, list[tuple[str, int, int]]]:
    """Text with each span replaced by its label in brackets, and (label, start, end) of the spans in the text as it was.

    Adjacent tokens of one phone or card number are one span; quotes and punctuation around a token stay.
    """
    spans: list[list] = []
    for a, b, k in found:
        name = LABELS[k]
        left, right = core(text[a:b])
        token = text[a:b]
        if token[left - 1 : left] == "(" and name == "PHONE":
            left = 0
        start, end = a + left, a + right
        if "=" in token and name in ("PASSWORD", "KEY") and token[left:right].partition("=")[2]:
            start = a + token.index("=", left) + 1
        if spans and spans[-1][0] == name and name in ("PHONE", "CARD") and not text[spans[-1][2] : start].strip("() \t\n\r"):
            spans[-1][2] = end
        else:
            spans.append([name, start, end])
    out, done = [], 0
    for name, a, b in spans:
        out += [text[done:a], f"[{name}]"]
        done = b
    return "".join([*out, text[done:]]), [tuple(s) for s in spans]


def udf(field: Field):
    def call(array: pa.Array) -> pa.Array:
        strings = texts(array)
        ok = array.is_valid().to_pylist()
        got = [redact(t, f) if f else (t, []) for t, f in zip(strings, decode_all(field, strings))]
        pick = lambda i, kind: pa.array([[s[i] for s in spans] if v else None for (_, spans), v in zip(got, ok)], pa.list_(kind))
        return struct(
            text=pa.array([t if v else None for (t, _), v in zip(got, ok)], pa.string()), n_found=pa.array([len(s) if v else 0 for (_, s), v in zip(got, ok)], pa.int32()),
            labels=pick(0, pa.string()), starts=pick(1, pa.int32()), ends=pick(2, pa.int32()),
        )

    return row_udf(call, "text string, n_found int, labels array<string>, starts array<int>, ends array<int>")


@functools.cache
def _default() -> Field:
    return train([*training_rows(), *value_rows(), *said_rows()])


def fit(table: DataFrame | None = None) -> Field:
    """The field trained on a labelled table (tokens, labels), by default training_rows(), value_rows() and said_rows(). The table must be small: it is collected.

    Rows without tokens or labels don't count, nor do tokens or labels that are null or a label that isn't known; other columns are ignored.
    """
    if table is None:
        return _default()
    rows = []
    for r in table.select("tokens", "labels").collect():
        pairs = [(t, k) for t, k in zip(r.tokens or (), r.labels or ()) if t and t.strip() and k in LABELS]
        rows.append(([t for t, _ in pairs], [k for _, k in pairs]))
    return train(rows)


def redacted(docs: DataFrame, field: Field, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, text, n_found, labels, starts, ends) for every row: the redacted text and where what was.

    Null text: null text and lists, n_found 0. Empty texts and those without findings come back as they are, with empty lists.
    Texts are read whole, of any length. Repeated rows give repeated results, an empty table none; other columns are ignored.
    """
    return expand(docs, id_col, udf(field)(col(docs, text_col)), FIELDS)


def clean(docs: DataFrame, field: Field, text_col="text") -> DataFrame:
    """docs with redacted texts; rows, other columns and their order stay.

    Null and empty texts stay as they are; texts count whole; rows that repeat are redacted alike; an empty table gives no rows;
    extra columns may have any names.
    """
    name = free_name(docs, "_pii")
    done = docs.withColumn(name, udf(field)(col(docs, text_col)))
    return done.select(*[col(done, name)["text"].alias(c) if c == text_col else col(done, c) for c in docs.columns])
