"""Language identification by compression.

Each language has a raw-content zstandard dictionary of the words that save most in all its labelled texts; a text belongs to the
language whose dictionary encodes it in the fewest bytes. Texts are cut into blocks so that a dictionary's advantage
doesn't fade in long texts, which soon serve as their own dictionary; every block of every text counts. A block
follows a few bytes that always compress, as zstandard stores what it can't shrink, and short texts would all cost the same.

Where two languages come close, the text is coded again with more effort and shorter matches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeworks.llm.common import col, expand, filter_by, release, row_udf, struct, texts, worker_cache
from tomeworks.session import discard, stored

#: Bytes of a dictionary, at most; each language has as many as its words fill.
DICT_BYTES = 112_000
#: Labels that are told, those with the most rows, at most; so the chosen ids are bounded, and may be sent to all tasks.
LANGUAGES = 256
#: A label with fewer bytes of text is no language to be told, unless none has that many.
MIN_BYTES = 4096
#: Longer runs, as of scripts without spaces, count by their overlapping pieces of PIECE characters.
LONGEST, PIECE = 20, 4
BLOCK = 2048
#: Effort, and shortest match if one is set; the second is for texts whose margin is under RECHECK.
EFFORT, MORE_EFFORT = (6, None), (12, 3)
RECHECK = 0.1
CARRIER = bytes(64)
#: A text is rejected if the second best language needs less than this share more bytes than the best.
MIN_MARGIN = 0.01
FIELDS = ["lang_pred", "margin", "accepted"]


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", rows: int | None = None, dict_bytes=DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries from all labelled rows, or from slices of at most `rows` a language, as sampled() says.

    At most LANGUAGES labels count. Rows without a label, text or id don't count; rows that repeat each count. Words are counted by the
    rows that have them, and those with the largest product of rows and bytes fill the dictionary, the largest last, ties in order of
    words. Counts alone are shuffled, each language's dictionary is made in a task of its own, and the driver gets dictionaries alone.
    """
    all_ = docs.select(col(docs, id_col).alias("id"), col(docs, lang_col).cast("string").alias("lang"), col(docs, text_col).alias("text")).filter("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    if rows is not None:
        return sampled(all_, rows, dict_bytes)
    size = all_.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.least(F.octet_length("text"), F.lit(dict_bytes))).alias("bytes")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    names = [r.lang for r in size if r.bytes >= min(MIN_BYTES, dict_bytes)] or [r.lang for r in size]
    if not names:
        return {}
    counts = all_.filter(F.col("lang").isin(names)).select("lang", "text").mapInArrow(piece_counts, "lang string, piece string, n bigint").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    gain = counts.select("lang", "piece", (F.col("n") * (F.octet_length("piece") + 1)).alias("gain"))
    # a piece and its space have two bytes at least, so no more than these fit
    best = gain.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("gain"), "piece"))).filter(F.col("k") <= dict_bytes // 2)

    def make(table: pa.Table) -> pa.Table:
        chosen, room = [], dict_bytes
        for piece in table.sort_by("k")["piece"].to_pylist():
            room -= len(piece.encode()) + 1
            if room < 0:
                break
            chosen.append(piece)
        return pa.table({"lang": table["lang"][:1], "raw": pa.array([" ".join(["", *reversed(chosen)]).encode()], pa.binary())})

    made, at = stored(best.groupBy("lang").applyInArrow(make, "lang string, raw binary"), "dictionaries")
    raw = {r.lang: bytes(r.raw) for r in made.collect()}
    discard(docs.sparkSession, at)
    return {k: v for k, v in sorted(raw.items()) if len(v) >= 8}


def pieces(text: str) -> set[str]:
    """Distinct words of a text, case folded; those of more than LONGEST characters by all their pieces of PIECE."""
    out = set(text.casefold().split())
    for w in [w for w in out if len(w) > LONGEST]:
        out.remove(w)
        out.update(w[i : i + PIECE] for i in range(len(w) - PIECE + 1))
    return out


def piece_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            by.setdefault(lang, Counter()).update(pieces(text))
        for lang, n in by.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["lang", "piece", "n"])
        by.clear()
        release()


def sampled(all_: DataFrame, rows: int, dict_bytes: int) -> dict[str, bytes]:
    """Dictionaries from (id, lang, text) by slices of at most `rows` rows a language, those whose id hashes lowest.

    Rows that repeat an id and label count once, by the first of their texts in order. Ids are chosen first, over id and label alone;
    of the chosen texts no more leaves the scan than a dictionary holds.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    told_ = all_.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    chosen = all_.select("id", "lang").join(F.broadcast(told_), "lang", "left_semi").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows).select("id", "lang")
    texts = all_.withColumn("text", F.substring("text", 1, dict_bytes)).join(F.broadcast(chosen), ["id", "lang"], "left_semi").groupBy("id", "lang").agg(F.min("text").alias("text"))

    def make(table: pa.Table) -> pa.Table:
        sample = sorted({(hash_of(t), t) for t in table["text"].to_pylist()})
        return pa.table({"lang": table["lang"][:1], "raw": pa.array([joined([t for _, t in sample], dict_bytes)], pa.binary())})

    made, at = stored(texts.groupBy("lang").applyInArrow(make, "lang string, raw binary"), "dictionaries")
    big = made.filter(F.length("raw") >= min(MIN_BYTES, dict_bytes))
    raw = {r.lang: bytes(r.raw) for r in (big.collect() or made.collect())}
    discard(all_.sparkSession, at)
    return told(raw, dict_bytes)


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode())


def dictionaries(by: dict[str, list[str]], dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """One dictionary per language from slices of its sample texts, in the order given; languages without text have none.

    Every text gives its beginning, as many bytes as any other has room for, so none fills a dictionary alone. No language's
    dictionary depends on how much another has. Labels with less than MIN_BYTES are left out, as rare or mistyped ones would draw
    single documents, unless all are so small.
    """
    return told({k: joined(v, dict_bytes) for k, v in by.items()}, dict_bytes)


def joined(texts: list[str], dict_bytes: int) -> bytes:
    return slices([t.casefold().encode() for t in texts], dict_bytes)


def told(raw: dict[str, bytes], dict_bytes: int) -> dict[str, bytes]:
    """The dictionaries that count, in order of their names."""
    least = min(MIN_BYTES, dict_bytes) if any(len(v) >= min(MIN_BYTES, dict_bytes) for v in raw.values()) else 8
    return {k: v for k, v in sorted(raw.items()) if len(v) >= max(8, least)}


def slices(rows: list[bytes], most: int) -> bytes:
    """The beginnings of all rows, joined by line ends, `most` bytes at most: short rows whole, all others to the same length."""
    room, each = max(0, most - len(rows) + 1), 0
    for k, n in enumerate(sorted(map(len, rows))):
        each = max(each, room // (len(rows) - k))
        if n > each:
            break
        room -= n
    return b"\n".join(x[:each].decode(errors="ignore").encode() for x in rows)[:most]


def sizes(data: bytes, compressors: list, block: int = BLOCK) -> list[int]:
    out = [0] * len(compressors)
    for i in range(0, len(data), block):
        piece = CARRIER + data[i : i + block]
        for k, c in enumerate(compressors):
            out[k] += len(c.compress(piece))
    return out


def compressors(dicts: dict[str, bytes], level: int, shortest: int | None) -> list:
    out = []
    for raw in dicts.values():
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own = {"min_match": shortest} if shortest else {}
        p = zstandard.ZstdCompressionParameters.from_level(level, source_size=BLOCK, dict_size=len(raw), write_content_size=False, write_checksum=False, write_dict_id=False, **own)
        d.precompute_compress(compression_params=p)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
    return out


def coders_of(dicts: dict[str, bytes]) -> list[list]:
    """Compressors of each language, for each effort."""
    return [compressors(dicts, *e) for e in (EFFORT, MORE_EFFORT)]


def classify(text: str | None, names: list[str], coders: list[list], min_margin: float = MIN_MARGIN, block: int = BLOCK) -> tuple[str, float, bool]:
    """(language, margin, accepted); ("und", 0, False) for null, empty or blank text or without languages.

    With one language only, the margin is 1: there is no other. A tie goes to the name first in order, with margin 0.
    """
    words = (text or "").strip()
    if not words or not names:
        return "und", 0.0, False
    if len(names) == 1:
        return names[0], 1.0, True
    data = f" {words} ".casefold().encode()
    for coder in coders:
        got = sizes(data, coder, block)
        order = sorted(range(len(names)), key=lambda k: (got[k], k))
        best, second = got[order[0]], got[order[1]]
        margin = (second - best) / second
        if margin >= RECHECK:
            break
    return names[order[0]], margin, margin >= min_margin


def udf(dicts: dict[str, bytes], min_margin: float = MIN_MARGIN, block: int = BLOCK):
    names = list(dicts)
    key = f"langid-{hash(tuple(dicts.items()))}"

    def call(array: pa.Array) -> pa.Array:
        kept = worker_cache(key)
        if "coders" not in kept:
            kept["coders"] = coders_of(dicts)
        coders = kept["coders"]
        rows = [classify(t, names, coders, min_margin, block) for t in texts(array)]
        lang, margin, ok = zip(*rows) if rows else ((), (), ())
        return struct(lang_pred=pa.array(lang, pa.string()), margin=pa.array(margin, pa.float64()), accepted=pa.array(ok, pa.bool_()))

    return row_udf(call, "lang_pred string, margin double, accepted boolean")


def identify(docs: DataFrame, dicts: dict[str, bytes], id_col="doc_id", text_col="text", min_margin=MIN_MARGIN) -> DataFrame:
    """(doc_id, lang_pred, margin, accepted) for every row.

    Null, empty and blank texts: "und", margin 0, rejected. Very long texts are coded block by block, whole.
    Ties: the language first by name, margin 0, so rejected. Repeated rows are each classified. An empty table gives
    no rows; other columns are ignored, whatever their names.
    """
    return expand(docs, id_col, udf(dicts, min_margin)(col(docs, text_col)), FIELDS)


def keep(docs: DataFrame, dicts: dict[str, bytes], text_col="text", min_margin=MIN_MARGIN) -> DataFrame:
    """The rows of docs, unchanged, whose language isn't rejected: null, empty and blank texts and ties go, as identify() says.

    Rows that repeat stay or go together; texts count whole; an empty table gives no rows; extra columns may have any names.
    """
    return filter_by(docs, udf(dicts, min_margin)(col(docs, text_col))["accepted"])
