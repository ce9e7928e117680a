"""Byte-level BPE over Arrow batches with the tokenizers library, and its inverse.

Merges never cross the pre-tokenizer's boundaries, and every text may be cut before a space that isn't part of a longer
run of white space. So each distinct piece between such cuts is encoded once per worker, and a text is the pieces'
ids one after the other: exactly what encoding the whole text gives.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from tomeworks.llm.common import col, expand, is_text, lists, row_udf, slices, struct, utf8, worker_cache

VOCAB = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of text that are encoded at once.
SLICE = 4 << 20
FIELDS = ["ids", "char_start", "char_end", "n_tokens", "round_trip"]
#: A space after white space that isn't followed by something else: there the pieces can't be told apart by spaces.
_RUN = re.compile(r"\s (?!\S)")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _load(path: str) -> dict:
    """Tokenizer, each id's bytes and their number; kept by the worker."""
    kept = worker_cache("bpe-" + path)
    if not kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        alphabet = byte_alphabet()
        table: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in data["model"]["vocab"].items()}
        table |= {a["id"]: a["content"].encode() for a in data.get("added_tokens", [])}
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        size = np.zeros(max(table) + 1, np.int64)
        for i, b in table.items():
            size[i] = len(b)
        kept.update(tokenizer=tokenizer, table=table, size=size, begin=np.cumsum(size) - size, flat=np.frombuffer(b"".join(table.get(i, b"") for i in range(len(size))), np.uint8))
    return kept


def encode_pieces(pieces: list[str], path: str = VOCAB) -> list[bytes]:
    """Token ids of each piece, encoded by itself, as 32-bit integers.

    Words after a space are encoded many at once as one text, which is cut again where their bytes end: no token reaches over
    the space before a word, unless white space is beside it.
    """
    model = _load(path)
    encode = lambda texts: model["tokenizer"].encode_batch_fast(texts, add_special_tokens=False)
    out: list = [b""] * len(pieces)
    plain, rest = [], []
    for i, p in enumerate(pieces):
        (plain if p[:1] == " " and len(p) > 1 and not p[1].isspace() and not p[-1].isspace() else rest).append(i)
    for first in range(0, len(plain), 1000):
        part = plain[first : first + 1000]
        ids = np.array(encode(["".join([pieces[i] for i in part])])[0].ids, np.int32)
        cuts = 4 + 4 * np.searchsorted(np.cumsum(model["size"][ids]), np.cumsum([len(pieces[i].encode()) for i in part]), "left")
        data, begin = ids.tobytes(), 0
        for i, end in zip(part, cuts.tolist()):
            out[i] = data[begin:end]
            begin = end
    for first in range(0, len(rest), 1000):
        part = rest[first : first + 1000]
        for i, e in zip(part, encode([pieces[i] for i in part])):
            out[i] = np.array(e.ids, np.int32).tobytes()
    return out


def encode_array(array: pa.Array, path: str = VOCAB) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all texts one after the other, number of tokens of each text); null as the empty text."""
    known = worker_cache("bpe-pieces-" + path)
    array = pc.fill_null(array, "")
    if not len(array):
        return np.empty(0, np.int32), np.empty(0, np.int64)
    whole = np.array([_RUN.search(t) is not None for t in array.to_pylist()], bool)
    words = pc.split_pattern(array, " ")
    n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(words).dictionary_encode()
    kind, values = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    head = np.cumsum(n) - n
    inner = np.ones(len(kind), bool)
    inner[head] = False
    inner[np.repeat(whole, n)] = False
    # pieces by number: words behind a space, then each text's head or, where it isn't cut, all of it
    used, number = np.unique(kind[inner], return_inverse=True)
    behind = [" " + w for w in values.take(pa.array(used)).to_pylist()]
    first = [t if w else f for t, w, f in zip(array.to_pylist(), whole.tolist(), values.take(pa.array(kind[head])).to_pylist())]
    pieces = [*behind, *first]
    got = list(map(known.get, pieces))
    missing = [i for i, g in enumerate(got) if g is None]
    for i, ids in zip(missing, encode_pieces([pieces[i] for i in missing], path)):
        got[i] = ids
        if len(ids) <= 64:  # long ones aren't worth keeping
            known[pieces[i]] = ids
    at = np.zeros(len(kind), np.int64)
    at[inner] = number
    at[head] = len(behind) + np.arange(len(array))
    there = inner.copy()
    there[head] = True
    size = np.fromiter(map(len, got), np.int64, len(got)) // 4
    begin = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(got), np.int32)
    count = np.where(there, size[at], 0)
    ids = flat[np.repeat(begin[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    return ids, np.add.reduceat(count, head)


def encode_texts(strings: list[str], path: str = VOCAB) -> list[np.ndarray]:
    """Token ids of each text."""
    ids, n = encode_array(pa.array(strings, pa.string()), path)
    return np.split(ids, np.cumsum(n)[:-1]) if len(n) else []


def offsets(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first character, one past the last) that each token's bytes touch; tokens of one split character overlap."""
    end = np.cumsum(sizes)
    char = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1  # the character each byte belongs to
    return char[end - sizes].astype(np.int32), (char[end - 1] + 1).astype(np.int32)


def decode_ids(ids, path: str = VOCAB, pending: bytes = b"", final: bool = True) -> tuple[str, bytes]:
    """(text, bytes of a character that isn't complete yet). Give those as `pending` with the ids that follow.

    With `final`, an incomplete or malformed character becomes U+FFFD. An unknown id raises KeyError.
    """
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    table = _load(path)["table"]
    text = decoder.decode(pending + b"".join(map(table.__getitem__, ids)), final)
    return text, decoder.getstate()[0]


def _encoded_slice(array: pa.Array, path: str) -> pa.Array:
    ok = is_text(array)
    ids, n = encode_array(array, path)
    model = _load(path)
    raw, off = utf8(array)
    size = model["size"][ids]
    end = np.cumsum(size)
    stop = np.append(0, np.cumsum(n))
    back = decode_flat(ids, n, path)
    same = np.array([a == b for a, b in zip(back, pc.fill_null(array, "").to_pylist())], bool)
    if end[-1:].sum() != len(raw):
        raise ValueError("tokens and text differ in length")
    char = np.append(np.cumsum((raw & 0xC0) != 0x80), 0)  # the character that each byte belongs to, from 1
    before = np.repeat(np.where(off[:-1] > 0, char[off[:-1] - 1], 0), n)
    starts, ends = char[end - size] - before - 1, char[end - 1] - before
    return struct(
        ids=lists(ids, n, pa.int32(), ok), char_start=lists(starts.astype(np.int32), n, pa.int32(), ok), char_end=lists(ends.astype(np.int32), n, pa.int32(), ok),
        n_tokens=pa.array(np.diff(stop).astype(np.int32), pa.int32(), mask=~ok), round_trip=pa.array(same, pa.bool_(), mask=~ok),
    )


def decode_flat(ids: np.ndarray, n: np.ndarray, path: str = VOCAB) -> list[str]:
    """Text of each of the runs of n ids: their bytes by table, then characters, split ones put together; U+FFFD for bytes that are no character."""
    model = _load(path)
    size = model["size"][ids]
    ends = np.cumsum(size)
    data = model["flat"][np.repeat(model["begin"][ids] - (ends - size), size) + np.arange(size.sum())].tobytes()
    stop = np.append(0, ends)[np.append(0, np.cumsum(n))].tolist()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(stop, stop[1:])]


def encode_udf(path: str = VOCAB):
    def call(array: pa.Array) -> pa.Array:
        got = [_encoded_slice(a, path) for a in slices(array, SLICE)]
        return got[0] if len(got) == 1 else pa.concat_arrays(got)

    return row_udf(call, "ids array<int>, char_start array<int>, char_end array<int>, n_tokens int, round_trip boolean")


def decode_udf(path: str = VOCAB):
    def call(array: pa.Array) -> pa.Array:
        model, got = _load(path), []
        ends = np.cumsum(pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False))
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1:].sum() + 1, SLICE // 4), "left"), [0, len(array)]))
        for first, last in zip(cuts, cuts[1:]):
            a = array.slice(first, last - first)
            ids, n = pc.list_flatten(a).to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
            unknown = [i for i in np.unique(ids).tolist() if i not in model["table"]]
            if unknown:
                raise KeyError(unknown[0])
            got.append(pa.array(decode_flat(ids, n, path), pa.string(), mask=~is_text(a)))
        return pa.concat_arrays(got) if got else pa.array([], pa.string())

    return row_udf(call, "string")


def encode(docs: DataFrame, id_col="doc_id", text_col="text", path: str = VOCAB) -> DataFrame:
    """(doc_id, ids, char_start, char_end, n_tokens, round_trip) for every row.

    Token j covers characters char_start[j] to char_end[j] of the text; tokens that split a character all name it.
    round_trip says that decoding the ids gives the text. Null text: null results. Empty text: empty lists, 0 tokens.
    Names of special tokens in a text are ordinary text. Texts are encoded whole, of any length; repeated rows give
    repeated results, an empty table none; other columns are ignored.
    """
    return expand(docs, id_col, encode_udf(path)(col(docs, text_col)), FIELDS)


def decode(ids: Column, path: str = VOCAB) -> Column:
    """Text of a list of ids; null for null, U+FFFD for bytes that are no character."""
    return decode_udf(path)(ids)
