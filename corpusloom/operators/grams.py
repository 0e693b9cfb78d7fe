"""Document counts of word n-grams without a shuffle of n-grams (L1).

Documents are dealt into hash blocks of about ``BLOCK_CHARS`` characters.  A block finds its distinct phrases and
sends of each only 80 bits of a hash, with the block's own counts, in sorted runs by hash range (``bucket``), packed
byte plane by byte plane.  A bucket adds the counts of equal hashes and sends them back in the order they came in, as
what other blocks have more: mostly zeros.  The block then ranks the phrases of its documents and returns the best.
What is shuffled are the texts, once and compressed, and about eight bytes for each phrase of a block; a frequent phrase is
one entry of each block, so no task holds its documents.  Among 10^9 different phrases two have the same 80 bits with a
probability of 4 * 10^-7 (10^10: 4 * 10^-5), and would count as one.

A block, that is its texts and the phrases of its documents, is held by one task; a document is never split.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.partitioning import default_parallelism

#: characters of the texts of a block
BLOCK_CHARS = 8_000_000
#: phrases with scores this near to the last of the best are all handed on: the exact order is found by the caller
NEAR = 1e-9


def best_grams(docs: DataFrame, k: int, max_words: int, min_len: int, stop_words: Sequence[str], n: int, chars: int) -> DataFrame:
    """``(_id, top)`` with one row for each id that has phrases: the ``k`` phrases of the highest
    ``tf * ln(n / df)``, ties by phrase (and phrases whose scores are as good as equal to the last one's), as an
    unordered array of ``(phrase, tf, df, cf)``.  ``docs`` are ``(_id, _t)``, ``_t`` being words with a space between
    them, or two where a phrase may not go on, ``chars`` characters in all; rows of one id are one document."""
    blocks = max(default_parallelism(docs), math.ceil(chars / BLOCK_CHARS))
    bits = max(1, (blocks - 1).bit_length())
    make = partial(_Block, max_words=max_words, min_len=min_len, stop_words=tuple(stop_words))
    rows = docs.select(F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int").alias("_b"), "_id", "_t")
    # read twice, shuffled once: both readers ask for the same rows by the same key
    dealt = rows.mapInArrow(_packed_texts, "_b int, data binary").repartition(blocks, "_b")
    sent = dealt.groupBy("_b").applyInArrow(lambda t: _send(make, bits, t), "_b int, bucket int, n int, data binary")
    back = sent.groupBy("bucket").applyInArrow(_count, "_b int, bucket int, n int, data binary")
    item = T.ArrayType(T.StructType.fromDDL("phrase string, tf long, df long, cf long"))
    schema = T.StructType([T.StructField("_id", docs.schema["_id"].dataType), T.StructField("top", item)])
    return dealt.groupBy("_b").cogroup(back.groupBy("_b")).applyInArrow(lambda t, back: _rank(make, k, n, t, back), schema)


# --------------------------------------------------------------------------- packed columns

def _pack(*columns: np.ndarray) -> bytes:
    """Byte planes of the columns, compressed."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)
    return pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpack(data: bytes, n: int, *types: str) -> list[np.ndarray]:
    size = n * sum(np.dtype(t).itemsize for t in types)
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(data, size, asbytes=True), np.uint8)
    out, at = [], 0
    for t in map(np.dtype, types):
        out.append(np.ascontiguousarray(planes[at:at + n * t.itemsize].reshape(t.itemsize, n).T).view(t).ravel())
        at += n * t.itemsize
    return out


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids and texts of each block, compressed together."""
    how = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))
    for batch in batches:
        block = batch.column("_b").to_numpy()
        order = np.argsort(block, kind="stable")
        rows, cuts = batch.take(pa.array(order)), np.flatnonzero(np.diff(block[order], prepend=-1))
        packed = []
        for lo, hi in zip(cuts, [*cuts[1:], len(block)]):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, rows.schema, options=how) as w:
                w.write_batch(rows.slice(lo, hi - lo))
            packed.append(out.getvalue().to_pybytes())
        yield pa.record_batch({"_b": pa.array(block[order][cuts], pa.int32()), "data": pa.array(packed, pa.binary())})


def _texts(t: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(data.as_buffer()).read_all() for data in t.column("data")])


# --------------------------------------------------------------------------- phrases of a block

def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class _Words:
    """Words in the order of the texts as places in the sorted ``names``; ``row`` is the text of each, ``at`` its
    place, which a gap in a text lets go on by two."""

    names: pa.Array
    word: np.ndarray
    row: np.ndarray
    at: np.ndarray


def _words(texts: pa.ChunkedArray) -> _Words:
    lists = pc.split_pattern(texts.combine_chunks().cast(pa.large_string()), " ")
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    some = pc.not_equal(flat, "")
    at, coded = np.flatnonzero(some.to_numpy(zero_copy_only=False)), flat.filter(some).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()  # by bytes, like Spark
    place = np.empty(len(order), "int32")
    place[order] = np.arange(len(order))
    return _Words(coded.dictionary.take(order), place[coded.indices.to_numpy()], row[at], at)


def _coded(ids: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct ids, a null one included, and the place of each row's id in them."""
    try:
        coded = ids.dictionary_encode(null_encoding="encode")
    except pa.ArrowNotImplementedError:  # nested ids
        seen: dict[str, int] = {}
        place = np.array([seen.setdefault(repr(x), len(seen)) for x in ids.to_pylist()], "int64")
        return ids.take(pa.array(np.unique(place, return_index=True)[1])), place
    return coded.dictionary, coded.indices.to_numpy().astype("int64")


class _Block:
    """The phrases of a block's documents.  ``words`` are a phrase's words as places in ``names`` plus one, zero
    where it has no more; phrases are in ascending order.  ``tf[i]`` is the count of phrase ``of[i]`` in document
    ``doc[i]``, in ascending order of phrase and document; ``df`` and ``cf`` are the block's counts."""

    def __init__(self, t: pa.Table, max_words: int, min_len: int, stop_words: tuple[str, ...]):
        self.ids, doc_of = _coded(t.column("_id").combine_chunks())
        w = _words(t.column("_t"))
        self.names = w.names
        ok = pc.and_(pc.greater_equal(pc.utf8_length(w.names), min_len),
                     pc.invert(pc.is_in(w.names, pa.array(stop_words, w.names.type)))).to_numpy(zero_copy_only=False)
        run, columns, docs = ok[w.word], [], []
        for n in range(1, max_words + 1):
            m = len(w.word) - n + 1
            if m <= 0:
                break
            if n > 1:  # of n words of one text: n - 1 words, and one more
                run = run[:m] & ok[w.word[n - 1:]] & (w.row[:m] == w.row[n - 1:]) & (w.at[n - 1:] - w.at[:m] == n - 1)
            at = np.flatnonzero(run)
            columns.append([w.word[at + i] + 1 if i < n else np.zeros(len(at), "int32") for i in range(max_words)])
            docs.append(doc_of[w.row[at]])
        doc = np.concatenate(docs) if docs else np.zeros(0, "int64")
        columns = [np.concatenate([c[i] for c in columns]) if columns else doc for i in range(max_words)]
        size, code = len(self.names) + 1, columns[0].astype("int64")
        for c in columns[1:]:
            if len(code) and int(code.max()) >= 2 ** 62 // size:
                code = np.unique(code, return_inverse=True)[1]
            code = code * size + c
        _, first, of = np.unique(code, return_index=True, return_inverse=True)
        self.words = [c[first] for c in columns]
        n_docs = max(1, len(self.ids))
        pair, self.tf = np.unique(of * n_docs + doc, return_counts=True)
        self.of, self.doc = pair // n_docs, pair % n_docs
        self.df = np.bincount(self.of, minlength=len(first))
        self.cf = np.bincount(of, minlength=len(first))

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(order, a, b)``: the phrases in ascending order of ``a``, and the hash, 64 and 16 bits."""
        raw = b"".join(hashlib.blake2b(x.encode(), digest_size=16).digest() for x in self.names.to_pylist())
        of_word = np.frombuffer(raw, "<u8").reshape(-1, 2)
        lanes = []
        for lane, factor in enumerate((0x9E3779B97F4A7C15, 0xD1342543DE82EF95)):
            code = np.concatenate([np.zeros(1, "uint64"), of_word[:, lane]])
            h = _mixed(code[self.words[0]])
            for c in self.words[1:]:
                h = np.where(c > 0, _mixed(h * np.uint64(factor) + code[c]), h)
            lanes.append(h)
        order = np.argsort(lanes[0], kind="stable")
        return order, lanes[0][order], (lanes[1][order] >> np.uint64(48)).astype("uint16")

    def names_of(self, phrases: np.ndarray) -> pa.Array:
        parts = []
        for c in self.words:
            at = c[phrases]
            parts.append(self.names.take(pa.array(at - 1, pa.int64(), mask=at == 0)))
        return pc.binary_join_element_wise(*parts, pa.scalar(" ", self.names.type), null_handling="skip").cast(pa.string())


def _send(make, bits: int, t: pa.Table) -> pa.Table:
    block = make(_texts(t))
    order, a, b = block.hashes()
    df, cf = block.df[order], block.cf[order]
    cuts = np.searchsorted(a >> np.uint64(64 - bits), np.arange(2 ** bits + 1, dtype="uint64"))
    some = np.flatnonzero(np.diff(cuts))
    rows = []
    for i in some:
        s = slice(cuts[i], cuts[i + 1])
        rows.append(_pack(np.diff(a[s], prepend=np.uint64(i << (64 - bits))), b[s], df[s], cf[s]))
    return pa.table({"_b": pa.array(np.full(len(some), t.column("_b")[0].as_py()), pa.int32()), "bucket": pa.array(some, pa.int32()),
                     "n": pa.array(np.diff(cuts)[some], pa.int32()), "data": pa.array(rows, pa.binary())})


def _count(t: pa.Table) -> pa.Table:
    """What the other blocks have more of each phrase, in the order of each block."""
    sizes = t.column("n").to_numpy()
    parts = [_unpack(data.as_py(), n, "u8", "u2", "i8", "i8") for data, n in zip(t.column("data"), sizes.tolist())]
    first = np.concatenate([np.cumsum(p[0]) for p in parts])
    second, df, cf = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    # the range of hashes is the bucket's: its first bits are in the first difference of each run
    order = np.argsort(first, kind="stable")
    new = first[order][1:] != first[order][:-1]
    if (~new & (second[order][1:] != second[order][:-1])).any():
        order = np.lexsort((second, first))
        new = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    starts = np.concatenate([[0], np.flatnonzero(new) + 1])
    group = np.empty(len(order), "int64")
    group[order] = np.concatenate([[0], np.cumsum(new)])
    more = [np.add.reduceat(x[order], starts)[group] - x for x in (df, cf)]
    ends = np.cumsum(sizes)
    rows = [_pack(*(x[e - n:e] for x in more)) for e, n in zip(ends, sizes)]
    return pa.table({"_b": t.column("_b"), "bucket": t.column("bucket"), "n": t.column("n"), "data": pa.array(rows, pa.binary())})


def _rank(make, k: int, n: int, t: pa.Table, back: pa.Table) -> pa.Table:
    block = make(_texts(t))
    if not len(block.of):
        empty = pa.struct([("phrase", pa.string()), ("tf", pa.int64()), ("df", pa.int64()), ("cf", pa.int64())])
        return pa.table({"_id": block.ids.slice(0, 0), "top": pa.array([], pa.list_(empty))})
    order = block.hashes()[0]
    back = back.sort_by("bucket")
    parts = [_unpack(data.as_py(), m, "i8", "i8") for data, m in zip(back.column("data"), back.column("n").to_pylist())]
    if sum(len(p[0]) for p in parts) != len(order):
        raise RuntimeError("the documents of a block changed between two reads")
    df, cf = block.df.copy(), block.cf.copy()
    df[order] += np.concatenate([p[0] for p in parts])
    cf[order] += np.concatenate([p[1] for p in parts])
    top = _best(block, df, k, n)
    of, doc = block.of[top], block.doc[top]
    items = pa.StructArray.from_arrays([block.names_of(of), pa.array(block.tf[top], pa.int64()), pa.array(df[of], pa.int64()),
                                        pa.array(cf[of], pa.int64())], ["phrase", "tf", "df", "cf"])
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    return pa.table({"_id": block.ids.take(pa.array(doc[starts])),
                     "top": pa.ListArray.from_arrays(pa.array(np.append(starts, len(doc)), pa.int32()), items)})


def _best(block: _Block, df: np.ndarray, k: int, n: int) -> np.ndarray:
    """Entries of the block that may be among the best ``k`` of their document, by document."""
    score = block.tf * np.log(n / df)[block.of]
    # entries of one document and score stay in the order of phrases
    order = np.argsort(-score, kind="stable")
    by = block.doc.astype(np.min_scalar_type(len(block.ids)))
    order = order[np.argsort(by[order], kind="stable")]
    doc, score, tf, df = block.doc[order], score[order], block.tf[order], df[block.of[order]]
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    size = np.diff(np.append(starts, len(doc)))
    place = np.arange(len(doc)) - np.repeat(starts, size)
    last = np.repeat(starts + np.minimum(k, size) - 1, size)
    near = np.abs(score - score[last]) <= NEAR * (1.0 + np.abs(score[last]))
    # beyond the last place only what ties with it by other counts: how such scores are rounded, the caller says
    other = near & ((tf != tf[last]) | (df != df[last]))
    unsure = np.zeros(int(doc[-1]) + 1, bool)
    unsure[doc[other]] = True
    return order[(place < k) | (near & unsure[doc])]
