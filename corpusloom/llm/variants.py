"""Spelling variants: words that differ by exactly one inserted, deleted or replaced code
point, grouped under the spelling that is far more frequent.

1. ``count_words``: runs of letters of whole texts, counted in each task before they are
   shuffled.
2. ``near_words``: two words are near if their common prefix and suffix together reach the
   longer length minus one.  A pair is sought by the length p of its common prefix: with a
   shorter word of length L and p in an interval [i, k) of 0..L, at least the first i and the
   last L - k code points agree.  Each word has a key for both halves of 0..L, as the shorter
   word and as the longer one, so a pair meets under exactly one key, the one whose interval
   has its p.
   A key with more than ``max_group`` words is halved again and again: its words get the
   keys of both halves of its interval instead.  An interval of one p holds words that
   differ in that place alone, so a group is bounded by the alphabet.
3. Within a partition, sorted by key, words are padded code-point matrices (one filled from
   the left, one from the right); blocks of them are compared pair by pair of blocks, as far
   as their keys meet.  Pairs are not emitted: a word keeps the number of its near words and
   the best of them.
4. ``variants``: a word's form is its most frequent near word if that is at least
   ``ratio`` times as frequent; forms of forms are followed by pointer doubling (counts grow
   ``ratio`` times a step, so there is no cycle).

Defined cases: a null text has no words; a null id hashes as the empty text; rows that repeat
an id are texts of their own; very long runs are words like any other; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import own_columns
from corpusloom.session import stage_table

MIN_CHARS = 7
MIN_COUNT = 2
RATIO = 10
DELETE_EVERY = 31
MAX_GROUP = 2048
BLOCK_ROWS = 128
WORDS_AT_ONCE = 1 << 17
#: Cells of a block's matrix and of one comparison: long words come in smaller blocks.
BLOCK_CELLS, CELLS = 1 << 20, 1 << 22


def word_counts(doc_id: object, text: str | None, min_chars: int = MIN_CHARS) -> Counter:
    """The counted words of one text.  Lower-casing takes A-Z only; a run whose crc32
    (of ``<doc_id>:<run>``) is a multiple of 31 loses the code point at the crc32 modulo
    its length."""
    lowered = (text or "").encode().lower().decode()  # bytes: A-Z only
    start, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in Counter(re.findall(f"[a-zÀ-ÿ]{{{max(1, min_chars)},}}", lowered)).items():
        h = zlib.crc32(run.encode(), start)
        if h % DELETE_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= min_chars:
            out[run] += n
    return out


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` over all texts."""
    rows = own_columns(docs, id_col, text_col).toDF("doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                held.update(word_counts(doc_id.as_py(), text.as_py(), min_chars))
                if len(held) > WORDS_AT_ONCE:
                    yield flush()
        if held:
            yield flush()

    found = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _key(length: Column, low: Column, high: Column, word: Column) -> Column:
    """Of words whose shorter one has ``length`` code points and whose common prefix is in
    [low, high): the agreeing ends, hashed (equal hashes of other ends only cost comparisons,
    as words are compared whole)."""
    tail = F.greatest(length - high, F.lit(0))
    ends = F.substr(word, F.lit(1), low), F.substr(word, F.length(word) - tail + 1, tail)
    return F.xxhash64(length, low, high, *ends)


def _with_keys(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", _key(F.col("len"), F.col("low"), F.col("high"), F.col("word")))


def keyed_words(words: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """``(key, len, low, high, word, n)``: the keys under which words meet."""
    own = F.length("word")
    cuts = F.array(*[F.struct(length.alias("len"), low.cast("int").alias("low"), high.cast("int").alias("high"))
                     for length in (own, own - 1)
                     for low, high in ((F.lit(0), F.floor(length / 2)), (F.floor(length / 2), length + 1))])
    rows = _with_keys(words.select("word", "n", F.inline(cuts)).where(F.col("low") < F.col("high")))
    done = []
    while True:
        rows = stage_table(rows, "variant-keys")
        large = (rows.where(F.col("high") - F.col("low") > 1).groupBy("key", "len", "low", "high").count()
                 .where(F.col("count") > max_group).select("key", "len", "low", "high"))
        large = stage_table(large, "variant-large")
        if large.isEmpty():
            break
        # both sides are tables, so that the join can be split at a hot key
        at = ["key", "len", "low", "high"]
        done.append(rows.join(large, at, "left_anti"))
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))
        rows = _with_keys(rows.join(large, at).select("word", "n", "len", F.inline(halves)))
    for part in done:
        rows = rows.unionByName(part)
    return rows


def _padded(words: list[str], width: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points from the left and, read backwards, from the right; the last column is
    filling, which differs between the two sides of a comparison."""
    left = np.full((len(words), width + 1), fill, np.int32)
    right = left.copy()
    for i, w in enumerate(words):
        points = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.int32)
        left[i, :len(points)], right[i, :len(points)] = points, points[::-1]
    return left, right


class _Block:
    """Rows of consecutive keys with their matrices and what is known of their near words."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        key, length, low, high, self.words, n = zip(*rows, strict=True)
        self.first, self.last = rows[0][:4], rows[-1][:4]
        self.keys = np.array(key, np.int64)
        self.length, self.low, self.high = (np.array(c, np.int64) for c in (length, low, high))
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.n = np.array(n, np.int64)
        self.width = int(self.size.max())
        self.near = np.zeros(len(rows), np.int64)
        self.best: list[tuple[int, str] | None] = [None] * len(rows)

    def matrices(self, width: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
        return _padded(list(self.words), width, fill)

    def learn(self, row: np.ndarray, other: _Block, col: np.ndarray) -> None:
        np.add.at(self.near, row, 1)
        for i, j in zip(row.tolist(), col.tolist(), strict=True):
            found, known = (-int(other.n[j]), other.words[j]), self.best[i]
            if known is None or found < known:
                self.best[i] = found


def compare(a: _Block, b: _Block) -> None:
    """All rows of one block against all of the other, or of one block among themselves."""
    width = max(a.width, b.width)
    step = max(1, CELLS // (len(b.rows) * (width + 1)))
    b_left, b_right = b.matrices(width, -1)
    a_left, a_right = a.matrices(width, -2)
    for at in range(0, len(a.rows), step):
        part = slice(at, at + step)
        same = ((a.keys[part, None] == b.keys) & (a.length[part, None] == b.length)
                & (a.low[part, None] == b.low) & (a.high[part, None] == b.high))
        prefix = (a_left[part, None] != b_left).argmax(axis=2)
        suffix = (a_right[part, None] != b_right).argmax(axis=2)
        small, large = np.minimum(a.size[part, None], b.size), np.maximum(a.size[part, None], b.size)
        near = (same & (small == a.length[part, None]) & (large <= small + 1) & (prefix < large) & (prefix + suffix >= large - 1)
                & (prefix >= a.low[part, None]) & (prefix < a.high[part, None]))
        row, col = np.nonzero(near)
        row += at
        if a is b:
            row, col = row[row < col], col[row < col]
        a.learn(row, b, col)
        b.learn(col, a, row)


def _tiles(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key.  A block stays as long as rows of its last key may come."""
    open_blocks: list[_Block] = []
    waiting: list[tuple] = []

    def result(blocks: list[_Block]) -> pa.RecordBatch:
        out = [(w, int(c), best[1], -best[0]) for b in blocks for w, c, best in zip(b.words, b.near, b.best, strict=True) if best]
        columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)],
                                          ["word", "near", "best", "best_n"])

    def add(block: _Block) -> list[_Block]:
        nonlocal open_blocks
        closed = [b for b in open_blocks if b.last != block.first]
        open_blocks = [b for b in open_blocks if b.last == block.first]
        for b in open_blocks:
            compare(b, block)
        compare(block, block)
        open_blocks.append(block)
        return closed

    width = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "len", "low", "high", "word", "n")), strict=True):
            width = max(width, len(row[4]))
            if len(waiting) == block_rows or waiting and (len(waiting) + 1) * width > BLOCK_CELLS:
                yield result(add(_Block(waiting)))
                waiting, width = [], len(row[4])
            waiting.append(row)
    if waiting:
        yield result(add(_Block(waiting)))
    yield result(open_blocks)


def near_words(words: DataFrame, max_group: int = MAX_GROUP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(word, n_near, best, best_n)`` of the words of ``words(word, n)`` (distinct) that
    have near words: how many, and the one of largest n (ties: smallest in code-point order)."""
    keyed = keyed_words(words, max_group)
    at = ["key", "len", "low", "high"]
    # under a key there is no pair without a second word and one of the shorter length
    groups = (keyed.groupBy(*at).agg(F.count(F.lit(1)).alias("_c"), F.min(F.length("word")).alias("_least"))
              .where((F.col("_c") > 1) & (F.col("_least") == F.col("len"))).select(*at))
    met = keyed.join(stage_table(groups, "variant-groups"), at)
    n = max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = met.select(*at, "word", "n").repartition(n, "key").sortWithinPartitions(*at)
    found = dealt.mapInArrow(partial(_tiles, block_rows=block_rows), "word string, near long, best string, best_n long")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("top")
                                     ).select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``forms(word, form)``: the last form that forms lead to."""
    links = stage_table(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stage_table(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "variant-roots")
        links = step.drop("next")
        if step.where(F.col("next").isNotNull()).isEmpty():
            return links


def variants(words: DataFrame, ratio: int = RATIO, max_group: int = MAX_GROUP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``words(word, n)``."""
    words = stage_table(words.select("word", "n"), "variant-words")
    has_form = F.col("best_n") >= ratio * F.col("n")
    found = words.join(near_words(words, max_group, block_rows), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n"))
    found = stage_table(found, "variant-forms")
    last = roots(found.where(F.col("form").isNotNull()))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
