"""Line dedup with two Bloom filters, one of lines seen once and one of lines seen
twice; only suspected repeats shuffle, for an exact count and the choice of the
occurrence that stays.

1. Each task reads its documents, takes the distinct keys of each document and
   puts their hashes into its own pair of filters (a hash that the first filter
   already has goes into the second).  Pairs are merged in a tree of bounded
   fan-in, piece by piece: what both first filters have joins the second.  A key
   of two documents is always in the merged second filter; others may be, too.
2. Documents are read again; only keys that the second filter may have are
   shuffled.  Their documents are counted exactly, by the whole key.
3. A key of enough documents keeps its lines in the largest id that holds it and
   loses them elsewhere.
4. The ids of documents that lose lines go into a Bloom filter of their own.  Documents
   that it does not have are finished where they are read; only the others meet the
   keys that they lose, in a join.

The filters' size follows the number of lines up to ``max_filter_bits``; a filter
that is too full only lets more keys through to the exact count.  The merged
second filter and that of the ids (at most ``max_filter_bits / 8`` bytes each) are all that
is broadcast.

Defined cases: a null or empty text is one empty line; documents that share an id
are one document for the count, and the id keeps the line in each of them; null
ids are one document, smaller than any id; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import own_columns, packed
from corpusloom.session import stage_table

MIN_CHARS = 40
MIN_DOCS = 5
BITS_PER_LINE = 8
MAX_FILTER_BITS = 1 << 28
HASHES = 3
PIECE_BITS = 1 << 21
FAN_IN = 64
STRIP = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """A key for each line of the text, None where the line is too short."""
    out = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(STRIP).lower()  # bytes: A-Z only
        long = len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)
        out.append(key if long else None)
    return out


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit positions for each 64-bit hash, by double hashing."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)


class SeenFilters:
    """Two bit arrays: hashes seen, and hashes seen more than once."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    @staticmethod
    def _set(filter_: np.ndarray, pos: np.ndarray) -> None:
        np.bitwise_or.at(filter_, (pos >> np.uint64(3)).ravel(), (1 << (pos & np.uint64(7))).astype(np.uint8).ravel())

    @staticmethod
    def has(filter_: np.ndarray, pos: np.ndarray) -> np.ndarray:
        return ((filter_[pos >> np.uint64(3)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def add(self, hashes: np.ndarray) -> None:
        values, n = np.unique(hashes, return_counts=True)
        pos = _positions(values, self.bits)
        self._set(self.twice, pos[(n > 1) | self.has(self.once, pos)])
        self._set(self.once, pos)


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), np.uint8)


def _twice_filter(texts: DataFrame, bits: int, min_chars: int) -> bytes:
    """The merged filter of keys that two documents may share."""
    piece = min(bits, PIECE_BITS) // 8

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        filters = SeenFilters(bits)
        some = False
        for batch in batches:
            hashes = [xxhash.xxh64_intdigest(k) for text in batch["text"]
                      for k in {k for k in line_keys(text, min_chars) if k is not None}]
            if hashes:
                some = True
                filters.add(np.array(hashes, np.uint64))
        for k in range(bits // 8 // piece) if some else ():
            part = slice(k * piece, (k + 1) * piece)
            if filters.once[part].any():
                yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "piece": [k],
                                    "once": [_pack(filters.once[part])], "twice": [_pack(filters.twice[part])]})

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(piece, np.uint8), np.zeros(piece, np.uint8)
        for a, b in zip(rows["once"], rows["twice"], strict=True):
            a = _unpack(a)
            twice |= (once & a) | _unpack(b)
            once |= a
        return pd.DataFrame({"task": [key[0]], "piece": [key[1]], "once": [_pack(once)], "twice": [_pack(twice)]})

    schema = "task long, piece int, once binary, twice binary"
    parts = stage_table(texts.mapInPandas(build, schema), "filters")
    left = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        # at most FAN_IN pieces meet in one call
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("task", "piece").applyInPandas(
            merge, schema)
        left = -(-left // FAN_IN)
        if left == 1:
            break
        parts = stage_table(parts, "filters")
    twice = bytearray(bits // 8)
    for row in parts.select("piece", "twice").collect():  # bits / 8 bytes in all
        twice[row.piece * piece:(row.piece + 1) * piece] = zlib.decompress(row.twice)
    return bytes(twice)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                   min_docs: int = MIN_DOCS, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``(doc_id, keys)``: for each document, the line keys that it loses."""
    spark = docs.sparkSession
    texts = own_columns(docs, id_col, text_col).toDF("doc_id", "text")
    n_lines = texts.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0]
    bits = 1 << 16
    while bits < min(max_filter_bits, BITS_PER_LINE * (n_lines or 0)):
        bits *= 2
    twice = spark.sparkContext.broadcast(_twice_filter(texts.select("text"), bits, min_chars))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.frombuffer(twice.value, np.uint8)
        for batch in batches:
            own = [[k for k in {*line_keys(text.as_py(), min_chars)} if k is not None] for text in batch.column("text")]
            keys = [k for ks in own for k in ks]
            if keys:
                hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
                hit = np.flatnonzero(SeenFilters.has(filter_, _positions(hashes, bits)))
                row = np.repeat(np.arange(len(own)), [len(ks) for ks in own])[hit]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)),
                                                  pa.array([keys[i] for i in hit], pa.binary())], ["doc_id", "key"])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    found = stage_table(texts.mapInArrow(suspects, f"doc_id {id_type}, key binary").distinct(), "suspects")
    # a table of its own, so that the join's sides are plain shuffles that Spark may split at a hot key
    repeated = stage_table(found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
                           .where(F.col("n") >= min_docs).drop("n"), "repeated")
    lost = found.join(repeated, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))  # of one document


def _id_filter(lost: DataFrame, max_filter_bits: int):
    """A column function that tells, of a document's id hash, whether the document may lose lines."""
    spark, bits = lost.sparkSession, 1 << 16
    while bits < min(max_filter_bits, BITS_PER_LINE * lost.count()):
        bits *= 2
    h, mask = F.xxhash64("doc_id"), F.lit(bits - 1).cast("long")  # (as _positions, in the low bits alone)
    step = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long")).bitwiseAND(mask)
    places = F.array(*[(h.bitwiseAND(mask) + k * step).bitwiseAND(mask) for k in range(HASHES)])
    cells = (lost.select(F.explode(places).alias("p")).groupBy((F.shiftright("p", 5)).alias("cell"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("v")))
    found = cells.toPandas()  # at most bits / 32 rows
    words = np.zeros(bits // 32, np.uint32)
    words[found["cell"].to_numpy(np.int64)] = found["v"].to_numpy(np.int64).astype(np.uint32)
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def has(hashes: pd.Series) -> pd.Series:
        h = hashes.to_numpy(np.int64).view(np.uint64)
        pos = _positions(h, bits)
        return pd.Series(((shared.value[pos >> np.uint64(5)] >> (pos & np.uint64(31)).astype(np.uint32)) & np.uint32(1)).all(axis=1))

    return has


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               min_docs: int = MIN_DOCS, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``row`` (a struct of ``docs``' columns), ``text`` (without the repeated lines; as it is, if none
    is dropped, null too), ``n_lines`` (before dropping) and ``n_dropped``.  The input's columns stay in a
    struct, so no name can clash."""
    lost = stage_table(repeated_lines(docs, id_col, text_col, min_chars, min_docs, max_filter_bits).toDF("doc_id", "keys"), "lost-lines")
    may_lose = _id_filter(lost.select("doc_id"), max_filter_bits)

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def cut(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out, n, gone = [], [], []
        for text, own in zip(texts, keys, strict=True):
            lines = (text or "").split("\n")
            if own is None or not len(own):
                kept = lines
            else:
                drop = {bytes(k) for k in own}
                kept = [line for line, key in zip(lines, line_keys(text, min_chars), strict=True) if key not in drop]
            out.append(text if len(kept) == len(lines) else "\n".join(kept))
            n.append(len(lines))
            gone.append(len(lines) - len(kept))
        return pd.DataFrame({"text": out, "n_lines": n, "n_dropped": gone})

    rows = packed(docs).withColumn("_may", may_lose(F.xxhash64(F.col("row")[id_col])))
    text = F.col("row")[text_col]
    n_lines = F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long")
    untouched = rows.where(~F.col("_may")).select("row", text.alias("text"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    suspects = rows.where("_may").join(lost, F.col("row")[id_col].eqNullSafe(F.col("doc_id")), "left")
    changed = suspects.withColumn("_cut", cut(text, F.col("keys"))).select("row", "_cut.text", "_cut.n_lines", "_cut.n_dropped")
    return untouched.unionByName(changed)
