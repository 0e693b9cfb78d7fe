"""SimHash near-dedup by Golay-code fuzzy hashing.

A document's fingerprint has 64 bits; bit i is 1 if it is set in over half of the
hashes of its word shingles.  Two fingerprints link at ``MAX_DISTANCE`` (3) or
fewer differing bits; near-duplicate groups are the connected components.

Finding the links: a fingerprint is cut into four blocks of 16 bits.  Of at most
three differing bits, none falls into at least one of the blocks, and of the other
48 bits (two segments of 24) at least one segment has at most one.  The perfect
Golay code (23, 12, 7) decodes every 23-bit word to the one codeword within
distance 3; the codewords of a word and of its 23 neighbours at distance one are
one or six, and two words at distance two or less share at least one of them.
So for each block and each segment of the rest a fingerprint gets the keys
(block, its bits, segment, codeword index), and any two fingerprints that link
share a key.  Rows of equal keys meet in a task, which verifies the distance of every
pair and hands on the edges of a spanning tree for each set that hangs together, so what
leaves a key grows with its rows and not with their pairs.

Only distinct fingerprints meet, so exact copies cost nothing; their
documents are joined to their fingerprint's component at the end.

Defined cases: null, empty and blank texts have fingerprint zero and link like any
other; fewer words than a shingle has make one shingle; rows that repeat an id are
documents of their own; ``component_id`` is the smallest id that can be reached
(null only if all ids in the group are null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import connected_components, own_columns, packed
from corpusloom.session import stage_table

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
#: Fixed value: generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the Golay code.
GOLAY = 0b110001110101
HASHES_AT_ONCE = 1 << 16
#: Rows of one key that one task compares with each other, and links it holds at a time.
MAX_GROUP = 1 << 12
LINKS_AT_ONCE = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The text's fingerprint as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), SEED)
                           for i in range(at, min(n, at + HASHES_AT_ONCE))], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, text_hash)`` of every document; ``fp`` is the fingerprint as a signed long."""
    rows = own_columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text_hash", _text_hash(F.col("text")))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64)), batch.column("text_hash")],
                                             ["doc_id", "fp", "text_hash"])

    return rows.mapInArrow(compute, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long, text_hash long")


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and the error pattern of each syndrome."""
    def remainder(v: np.ndarray) -> np.ndarray:
        for bit in range(22, 10, -1):
            v = np.where(v >> bit & 1, v ^ (GOLAY << (bit - 11)), v)
        return v

    one = 1 << np.arange(23)
    patterns = {0} | {a | b | c for a in one.tolist() for b in one.tolist() for c in one.tolist()}
    errors = np.zeros(2048, np.int64)
    patterns = np.array(sorted(patterns))
    errors[remainder(patterns)] = patterns
    return remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11) << 12), errors


def golay_index(v: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    low, high, errors = _golay()
    return (v ^ errors[low[v & 0xFFF] ^ high[v >> 12]]) >> 11


def golay_keys(v: np.ndarray) -> np.ndarray:
    """For each 23-bit word the sorted codeword indices of itself and its 23
    neighbours, repeats set to -1 (24 columns)."""
    near = np.sort(np.column_stack([golay_index(v)] + [golay_index(v ^ (1 << i)) for i in range(23)]), axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    return near


def _fuzzy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        blocks = [(fp.view(np.uint64) >> np.uint64(16 * b)).astype(np.int64) & 0xFFFF for b in range(4)]
        for b in range(4):
            for segment, v in enumerate(_segments(fp, b)):
                index = golay_keys(v & 0x7FFFFF)
                key = ((2 * b + segment) << 28 | blocks[b] << 12)[:, None] | index
                row, col = np.nonzero(index >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(key[row, col]), pa.array(fp[row])], ["key", "fp"])


def _segments(fp: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The two segments of 24 bits that lie outside block ``b``."""
    x, y, z = ((fp.view(np.uint64) >> np.uint64(16 * i)).astype(np.int64) & 0xFFFF for i in range(4) if i != b)
    return x | (y & 0xFF) << 16, (y >> 8) | z << 8


def _finer_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Eight keys in place of one: of the key's own segment, with one differing bit at most, one
    half agrees, and of the other segment, with three at most, one quarter does."""
    for batch in batches:
        key, fp = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "fp"))
        for b in range(4):
            for segment in range(2):
                at = np.flatnonzero(key >> 28 == 2 * b + segment)
                pair = _segments(fp[at], b)
                own, other = pair[segment], pair[1 - segment]
                for half in range(2):
                    for quarter in range(4):
                        part = (half << 2 | quarter) << 18 | (own >> 12 * half & 0xFFF) << 6 | (other >> 6 * quarter & 0x3F)
                        yield pa.RecordBatch.from_arrays([pa.array(key[at] << 21 | part), pa.array(fp[at])], ["key", "fp"])


def _trees(key: np.ndarray, fp: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by key: every fingerprint that hangs together by links within its key
    with others, beside the least row it hangs together with."""
    n = len(key)
    label, at, step = np.arange(n), np.arange(n - 1), 1
    held: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        at = at[at + step < n]
        at = at[key[at] == key[at + step]]  # rows that far from the end of their key are done
        if len(at):
            near = at[np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64)) <= max_distance]
            held.append((near, near + step))
        if not len(at) or sum(len(a) for a, _ in held) > LINKS_AT_ONCE:
            a, b = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (at, at)
            while True:  # lower labels along links and their own until nothing changes
                least = np.minimum(label[a], label[b])
                before = label.copy()
                for x in (label[a], label[b], a, b):
                    np.minimum.at(label, x, least)
                label = label[label]
                if (label == before).all():
                    break
            held = []
        if not len(at):
            break
        step += 1
    member = np.flatnonzero(label != np.arange(n))
    return fp[label[member]], fp[member]


def _connect(max_distance: int, ends_cut: bool, max_group: int):
    """A task over rows sorted by key and fingerprint: ``(a, b, cut, n)`` connects two
    fingerprints, or names a key (in ``cut``) whose rows were not all compared with each
    other, as they are more than ``max_group`` or (with ``ends_cut``) may go on in another
    partition, and how many rows it has here."""
    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut: dict[int, int] = {}
        first, n_first, last, n_last = None, 0, None, 0

        def result(upto: int) -> pa.RecordBatch:
            a, b = _trees(key[:upto], fp[:upto], max_distance)
            pairs = np.unique(np.column_stack([a, b]), axis=0)
            none = pa.nulls(len(pairs), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none], ["a", "b", "cut", "n"])

        for batch in batches:
            more, more_fp = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "fp"))
            if not len(more):
                continue
            first = int(more[0]) if first is None else first
            n_first += int(np.searchsorted(more, first, "right"))
            before, last = last, int(more[-1])
            n_last = len(more) - int(np.searchsorted(more, last)) + (n_last if before == last else 0)
            key, fp = np.concatenate([key, more]), np.concatenate([fp, more_fp])
            while len(key) > 2 * max_group:
                upto = int(np.searchsorted(key[:2 * max_group], key[2 * max_group]))  # whole keys
                if upto:
                    yield result(upto)
                    key, fp = key[upto:], fp[upto:]
                else:  # one key fills the buffer: its last row meets the next ones
                    cut[int(key[0])] = 2 * max_group + 1
                    yield result(2 * max_group)
                    key, fp = key[2 * max_group - 1:], fp[2 * max_group - 1:]
        if len(key):
            yield result(len(key))
        if ends_cut and first is not None:
            cut |= {first: n_first, last: n_last}
        named, none = pa.array(list(cut), pa.int64()), pa.nulls(len(cut), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, named, pa.array(list(cut.values()), pa.int64())], ["a", "b", "cut", "n"])

    return connect


def connections(distinct: DataFrame, max_distance: int = MAX_DISTANCE, max_group: int = MAX_GROUP) -> DataFrame:
    """``(a, b)``: edges between distinct fingerprints (column ``fp``) that join the same
    fingerprints into components as all pairs at ``max_distance`` or fewer differing bits
    do, at most one edge for each fingerprint and key.

    Rows are compared in ranges of (key, fingerprint), so no task gets a hot key whole.
    Keys that a range boundary cuts are compared again, alone.  Of keys with more than
    ``max_group`` rows only those stay whose fingerprints do not yet hang together; they get
    finer keys, and at last their blocks of rows are compared pair by pair of blocks."""
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError(f"the keys hold for at most {MAX_DISTANCE} differing bits")
    spark = distinct.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compared(rows: DataFrame, ends_cut: bool) -> DataFrame:
        dealt = rows.repartitionByRange(n, "key", "fp") if ends_cut else rows.repartition(n, "key")
        task = _connect(max_distance, ends_cut, max_group)
        return stage_table(dealt.sortWithinPartitions("key", "fp").mapInArrow(task, "a long, b long, cut long, n long"), "connections")

    rows = distinct.select("fp").mapInArrow(_fuzzy_keys, "key long, fp long")
    done: list[DataFrame] = []
    for finer in (True, False):
        found = compared(rows, True)
        done.append(found.where(F.col("cut").isNull()).select("a", "b"))
        cut = found.where(F.col("cut").isNotNull()).groupBy(F.col("cut").alias("key")).agg(F.sum("n").alias("n"))
        small, large = (cut.where(c).select("key") for c in (F.col("n") <= max_group, F.col("n") > max_group))
        done.append(compared(rows.join(small, "key"), False).select("a", "b").where(F.col("a").isNotNull()))
        if large.isEmpty():
            break
        done, large_rows = _apart(done, rows.join(large, "key"))
        if finer:
            rows = stage_table(large_rows.mapInArrow(_finer_keys, "key long, fp long"), "finer-keys")
        else:
            done.append(compared(_tiles(large_rows, max_group), False).select("a", "b").where(F.col("a").isNotNull()))
    return reduce(DataFrame.unionByName, done)


def _apart(done: list[DataFrame], rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The edges so far, shortened to one for each fingerprint, and the rows of keys whose
    fingerprints do not all hang together by them."""
    roots = connected_components(reduce(DataFrame.unionByName, done))
    rooted = stage_table(rows.join(roots.toDF("fp", "root"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root")), "rooted")
    apart = stage_table(rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
                        .where(F.col("low") != F.col("high")).select("key"), "apart")
    return [roots.where(F.col("root") != F.col("node")).toDF("a", "b")], rooted.join(apart, "key").select("key", "fp")


def _tiles(rows: DataFrame, max_group: int) -> DataFrame:
    """Rows of large keys under keys of pairs of blocks, each block about half of ``max_group``."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) * 2 / max_group).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    blocked = rows.join(stage_table(sizes, "tile-blocks"), "key").select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return blocked.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``(doc_id, fp, root, component_id, text_hash)`` of every document; ``root`` is the
    smallest fingerprint of its group."""
    prints = stage_table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stage_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(connections(distinct, max_distance)).toDF("fp", "root")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # a table of its own, so that the join's sides are plain shuffles that Spark may split at a hot fingerprint
    groups = stage_table(rooted.join(least, "root").select("fp", "root", "component_id"), "groups")
    return prints.join(groups, "fp").select("doc_id", "fp", "root", "component_id", "text_hash")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                     max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one whose id is
    the group's ``component_id``.  Of rows that repeat this id within the group the first in
    the order of the texts' hashes stays; a group without any id keeps one such row."""
    found = components(docs, id_col, text_col, shingle, max_distance)
    # what stays, by id and hash of the text, and how many rows are the same in both
    same = (found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")))
    stay = stage_table(same.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("stay"))
                       .select(F.col("stay.doc_id").alias("_id"), F.col("stay.text_hash").alias("_hash"), F.col("stay.n").alias("_n")), "stay")
    row = packed(docs).withColumn("_own", _text_hash(F.col("row")[text_col]))

    def joined(ids: DataFrame) -> DataFrame:
        return row.join(ids, F.col("row")[id_col].eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")))

    once = joined(stay.where(F.col("_n") == 1)).select("row")
    if not stay.where(F.col("_n") > 1).isEmpty():  # repeated rows: any one of them
        nth = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.lit(0)))
        more = joined(stay.where(F.col("_n") > 1)).withColumn("_nth", nth)
        once = once.unionByName(more.where(F.col("_nth") == 1).select("row"))
    return once.select("row.*")
