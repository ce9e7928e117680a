"""Document fingerprints by winnowing.

White space is dropped and case folded; every k-gram of what is left gets a rolling hash; of each window of w
consecutive hashes the smallest is kept, the rightmost one on ties, with its position in the original text. Two
texts that share at least w + k - 1 consecutive such characters share a fingerprint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tomeworks.llm.common import col, expand, is_text, lists, mix64, row_udf, struct

K, W = 25, 40
BASE = 0x100000001B3
FIELDS = ["hashes", "positions"]
_BLANK = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_DROP = np.zeros(0x3001, bool)
_DROP[_BLANK] = True


def _fold(c: np.ndarray) -> np.ndarray:
    """Simple case folding that maps one character to one: ASCII, Latin-1, Greek and Cyrillic capitals."""
    up = ((c >= 65) & (c <= 90)) | ((c >= 0xC0) & (c <= 0xDE) & (c != 0xD7)) | ((c >= 0x391) & (c <= 0x3A9)) | ((c >= 0x410) & (c <= 0x42F))
    return c + up.astype(np.uint32) * np.uint32(32)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-gram: its polynomial over BASE mod 2**64, mixed. Made by doubling, so log2 k passes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        part, size, out, done = codes.astype(np.uint64), 1, None, 0
        for bit in range(k.bit_length()):
            if k >> bit & 1:  # append the block of this size to what is there
                if out is None:
                    out = part
                else:
                    m = len(codes) - done - size + 1
                    out = out[:m] * np.uint64(pow(BASE, size, 1 << 64)) + part[done : done + m]
                done += size
            if k >> (bit + 1):
                part = part[: len(part) - size] * np.uint64(pow(BASE, size, 1 << 64)) + part[size:]
                size *= 2
        return mix64(out[:n])


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Index of the smallest hash of each window of w, rightmost on ties; one window if there are fewer than w hashes."""
    if not len(h):
        return np.empty(0, np.int64)
    w = min(w, len(h))
    low, at, size = h, np.arange(len(h)), 1
    while size < w:
        step = min(size, w - size)
        left, right = low[: len(low) - step], low[step:]
        right_wins = right <= left
        at = np.where(right_wins, at[step:], at[: len(at) - step])
        low = np.where(right_wins, right, left)
        size += step
    return at


def fingerprint(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the fingerprints, in order of position."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    there = np.flatnonzero(~_DROP[np.minimum(codes, 0x3000)] | (codes > 0x3000))
    h = gram_hashes(_fold(codes[there]), k)
    at = window_minima(h, w)
    if len(at):
        at = at[np.append(True, at[1:] != at[:-1])]
    return h[at].view(np.int64), there[at]


def udf(k: int = K, w: int = W):
    def call(array: pa.Array) -> pa.Array:
        ok = is_text(array)
        got = [fingerprint(t, k, w) if t else (np.empty(0, np.int64), np.empty(0, np.int64)) for t in array.to_pylist()]
        n = np.array([len(p) for _, p in got], np.int64)
        flat = [np.concatenate([g[i] for g in got]) if got else np.empty(0, np.int64) for i in (0, 1)]
        return struct(hashes=lists(flat[0], n, pa.int64(), ok), positions=lists(flat[1].astype(np.int32), n, pa.int32(), ok))

    return row_udf(call, "hashes array<bigint>, positions array<int>")


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", k: int = K, w: int = W) -> DataFrame:
    """(doc_id, hashes, positions) for every row; positions count characters of the original text from 0.

    Null text: null lists. Empty texts and those with fewer than k characters besides white space: empty lists.
    Texts with at least one k-gram but fewer than w: one fingerprint, their smallest. Ties: rightmost. Repeated rows
    give repeated results, an empty table none; other columns are ignored. Texts are hashed whole, of any length.
    """
    if k < 1 or w < 1:
        raise ValueError("k and w must be positive")
    return expand(docs, id_col, udf(k, w)(col(docs, text_col)), FIELDS)
