"""Language-model scores by Katz backoff.

A bigram that the training texts have gets its Good-Turing discounted relative
frequency; another backs off to the unigram, times a weight of its history; an
unknown word gets the mass that the unigrams' discount leaves:

    P(w | h) = d2(c) c(h w) / c(h)   if c(h w) > 0,   else a(h) P(w)
    P(w)     = d1(c) c(w) / N        if c(w) > 0,     else 1 - sum of all d1(c) c / N
    a(h)     = (1 - sum of P(w | h)) / (1 - sum of P(w)),   sums over w seen after h

so that the probabilities after every history sum to one.  ``h`` is the word before,
or the start; each text ends with an end token.  Counts up to ``TURING`` are
discounted by Turing's ratio of the counts of counts, greater ones (and where the
ratio is no discount) by a log-linear fit of them (Simple Good-Turing), so every
history keeps some mass.

Words and word pairs are told apart by 64-bit hashes.  The tables are:

* blocks: the tokenised texts, about ``BLOCK_TOKENS`` tokens in a row of packed arrays;
* n-gram counts, in partitions by hash range: each block sends its distinct n-grams
  with its own counts (so the most frequent n-gram comes once from each block) and gets
  the corpus counts back; each n-gram is also given to one of its blocks to account for;
* backoff weights by history, summed over the blocks that account for its n-grams.

Seen tokens are scored in their block; the histories of unseen ones are joined to the
table of weights and summed by document.  Partitions are sized by the number of
tokens, and no step holds more than one block or one hash range.

Defined cases: a null or empty text is its end token alone; without training texts
every probability is that of the unknown word, one; rows that repeat an id are
documents of their own; a null flag or id is used as any other; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stage_table

BLOCK_TOKENS = 1 << 20
BUCKET_TOKENS = 1 << 21
TURING = 5
FITTED = 32
#: Hashes of the end and the start of a text; no word has a blank.
END, START = (xxhash.xxh64_intdigest(x) for x in (b" end", b" start"))


def _pack(a: np.ndarray, ascending: bool = False) -> bytes:
    """The array's bytes, plane by plane (its differences, if ascending), compressed."""
    if ascending:
        a = np.diff(a, prepend=a.dtype.type(0))
    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def _unpack(data: bytes, kind: str, ascending: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    a = np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(a, dtype=a.dtype) if ascending else a


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def discounts(n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Good-Turing discount of each count, from ``n[c]``, the number of n-grams that
    occur c times (c up to FITTED + 1)."""
    c = np.arange(1, FITTED + 1)
    some = c[n[c] > 0]
    slope = -2.0
    if len(some) > 1:
        slope = min(-1.1, float(np.polyfit(np.log(some), np.log(n[some].astype(float)), 1)[0]))
    out = (1 + 1 / np.maximum(counts, 1)) ** (slope + 1)
    for k in range(1, TURING + 1):
        if n[k] > 0 and 0 < (k + 1) * n[k + 1] < k * n[k]:
            out[counts == k] = (k + 1) * n[k + 1] / (k * n[k])
    return np.where(counts > 0, out, 0.0)


def _blocks(rows: DataFrame) -> DataFrame:
    """Tokenised blocks: ids, flags and lengths of the documents, the sorted hashes of
    the block's distinct words, and each token's place among them."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        number: dict[bytes, int] = {}
        ids, held, tokens, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            hashes = np.fromiter((END if w == b" end" else xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())),
                 pa.array([[len(t) for t in tokens]], pa.list_(pa.int64())),
                 pa.array([_pack(hashes[order], True)], pa.binary()),
                 pa.array([_pack(place[np.concatenate(tokens)])], pa.binary())],
                ["block", "ids", "held", "sizes", "words", "tokens"])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text, out in zip(*(batch.column(c) for c in ("doc_id", "text", "held")), strict=True):
                words = (text.as_py() or "").encode().lower().split()  # bytes: A-Z and ASCII white space
                words.append(b" end")
                tokens.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
                ids.append(doc_id.as_py())
                held.append(bool(out.as_py()))
                size += len(words)
                if size >= BLOCK_TOKENS:
                    yield flush()
                    block, number, ids, held, tokens, size = block + 1, {}, [], [], [], 0
        if tokens:
            yield flush()

    return stage_table(rows.mapInArrow(build, f"block long, ids array<{kind}>, held array<boolean>, sizes array<long>, "
                                              "words binary, tokens binary"), "blocks")


class _Block:
    """A block's tokens and its distinct words and word pairs."""

    def __init__(self, row: dict):
        self.ids, self.held = row["ids"], np.array(row["held"], bool)
        self.sizes = np.array(row["sizes"], np.int64)
        self.words = _unpack(row["words"], "u8", True)
        self.tokens = _unpack(row["tokens"], "i4").astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        n = len(self.words)  # n stands for the start
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = n
        pairs, self.pair = np.unique(before * (n + 1) + self.tokens, return_inverse=True)
        self.first, self.second = np.divmod(pairs, n + 1)
        self.history = np.append(self.words, np.uint64(START))
        keys = _pair_hash(self.history[self.first], self.words[self.second])
        self.order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.order]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in training texts, of the words and of the pairs (in key order)."""
        weight = (~self.held[self.doc]).astype(float)
        pairs = np.bincount(self.pair, weight, len(self.first)).astype(np.int64)
        return np.bincount(self.tokens, weight, len(self.words)).astype(np.int64), pairs[self.order]


def _count_tables(blocks: DataFrame, bits: int) -> DataFrame:
    """Corpus counts for each block's n-grams, and (rows without a block) the counts of
    counts of each hash range."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                for level, keys, n in zip((1, 2), (b.words, b.pair_keys), b.counts(), strict=True):
                    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                    ends = np.append(starts[1:], len(keys))
                    yield pa.RecordBatch.from_pydict({
                        "level": pa.array([level] * len(starts), pa.int32()), "bucket": pa.array(bucket[starts]),
                        "block": pa.array([row["block"]] * len(starts), pa.int64()),
                        "keys": pa.array([_pack(keys[s:e], True) for s, e in zip(starts, ends, strict=True)], pa.binary()),
                        "n": pa.array([_pack(n[s:e]) for s, e in zip(starts, ends, strict=True)], pa.binary())})

    def count(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        keys = [_unpack(k.as_py(), "u8", True) for k in rows["keys"]]
        every, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(which, np.concatenate([_unpack(n.as_py(), "i8") for n in rows["n"]]), len(every)).astype(np.int64)
        own = np.zeros(len(which), bool)
        own[first] = total > 0
        at = np.cumsum([0, *map(len, keys)])
        hist = np.bincount(np.minimum(total, FITTED + 2), minlength=FITTED + 3)
        size, level, bucket = len(keys), rows["level"][0].as_py(), rows["bucket"][0].as_py()
        spans = list(zip(at, at[1:], strict=False))
        return pa.table({
            "level": pa.array([level] * (size + 1), pa.int32()), "bucket": pa.array([bucket] * (size + 1), pa.int64()),
            "block": pa.concat_arrays([rows["block"].combine_chunks(), pa.array([None], pa.int64())]),
            "n": pa.array([_pack(total[which[s:e]]) for s, e in spans] + [None], pa.binary()),
            "own": pa.array([np.packbits(own[s:e]).tobytes() for s, e in spans] + [None], pa.binary()),
            "hist": pa.array([None] * size + [[*hist.tolist(), int(total.sum())]], pa.list_(pa.int64()))})

    sent = blocks.mapInArrow(send, "level int, bucket long, block long, keys binary, n binary")
    return stage_table(sent.groupBy("level", "bucket").applyInArrow(
        count, "level int, bucket long, block long, n binary, own binary, hist array<long>"), "ngram-counts", ["level"])


class _Model:
    """What every block needs of the whole corpus: counts of counts, N and V."""

    def __init__(self, hist: dict[int, np.ndarray]):
        none = np.zeros(FITTED + 4, np.int64)
        self.one, self.two = hist.get(1, none), hist.get(2, none)
        self.train_tokens = int(self.one[-1])
        self.train_words = int(self.one[1:-1].sum())
        self.ends, self.unknown = 0, 1.0  # training texts; mass of the unknown word

    def word_probability(self, c: np.ndarray) -> np.ndarray:
        p = discounts(self.one, c) * c / max(1, self.train_tokens)
        return np.where(c > 0, p, self.unknown)


def _answers(rows: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts and ownership of a block's n-grams, in key order."""
    own = sorted((r for r in rows.to_pylist() if r["level"] == level), key=lambda r: r["bucket"])
    n = [_unpack(r["n"], "i8") for r in own]
    mine = [np.unpackbits(np.frombuffer(r["own"], np.uint8), count=len(x)) for r, x in zip(own, n, strict=True)]
    return np.concatenate(n), np.concatenate(mine).astype(bool)


def _known(block: _Block, rows: pa.Table, model: _Model) -> dict[str, np.ndarray]:
    """Counts and probabilities of a block's words, histories and pairs."""
    c1, _ = _answers(rows, 1)
    sorted_c2, sorted_own = _answers(rows, 2)
    c2, own = np.empty_like(sorted_c2), np.empty_like(sorted_own)
    c2[block.order], own[block.order] = sorted_c2, sorted_own
    before = np.append(c1, model.ends)  # a text starts as often as one ends
    return {"c1": c1, "c2": c2, "own": own, "p1": model.word_probability(c1),
            "seen": discounts(model.two, c2) * c2, "before": before[block.first]}


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows by a model of the rows where ``held_out`` (an expression on
    the columns of ``docs``) is false.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1
    unigram), score (log10 probability of the text)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held_out.alias("held"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks = _blocks(rows)
    tokens = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, tokens) / BUCKET_TOKENS))))
    tables = _count_tables(blocks, bits)
    sums = (tables.where(F.col("block").isNull()).select("level", F.posexplode("hist").alias("c", "n"))
            .groupBy("level", "c").agg(F.sum("n").alias("n")).collect())  # two short histograms
    hist: dict[int, np.ndarray] = {}
    for r in sums:
        hist.setdefault(r.level, np.zeros(FITTED + 4, np.int64))[r.c] = r.n
    model = _Model(hist)
    model.ends = int(blocks.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0)
    model.unknown = _unknown_mass(tables, model)
    answers = tables.where(F.col("block").isNotNull()).select("level", "bucket", "block", "n", "own")
    pairs = blocks.groupBy("block").cogroup(answers.groupBy("block"))

    def documents(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        b = _Block(row)
        k = _known(b, right, model)
        p = np.where(k["c2"] > 0, k["seen"] / np.maximum(k["before"], 1), k["p1"][b.second])
        base = np.log10((k["c1"] + 0.1) / (model.train_tokens + 0.1 * (model.train_words + 1)))
        n = len(b.sizes)
        return pa.table({
            "block": pa.array([row["block"]] * n, pa.int64()), "place": pa.array(np.arange(n)),
            "doc_id": left["ids"].combine_chunks().flatten(), "held_out": pa.array(b.held), "n_tokens": pa.array(b.sizes),
            "n_known": pa.array(np.bincount(b.doc, k["c1"][b.tokens] > 0, n).astype(np.int64)),
            "base_score": pa.array(np.bincount(b.doc, base[b.tokens], n)),
            "direct": pa.array(np.bincount(b.doc, np.log10(p)[b.pair], n))})

    def unseen(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        b = _Block(row)
        k = _known(b, right, model)
        back = ((k["c2"] == 0) & (k["before"] > 0))[b.pair]
        key = b.doc[back] * (len(b.words) + 1) + b.first[b.pair[back]]
        key, times = np.unique(key, return_counts=True)
        place, history = np.divmod(key, len(b.words) + 1)
        return pa.table({"block": pa.array([row["block"]] * len(key), pa.int64()), "place": pa.array(place),
                         "history": pa.array(b.history[history].view(np.int64)), "times": pa.array(times)})

    def masses(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _Block(left.to_pylist()[0])
        k = _known(b, right, model)
        own = k["own"]
        n = len(b.history)
        lower = np.bincount(b.first[own], k["p1"][b.second[own]], n)
        seen = np.bincount(b.first[own], (k["seen"] / np.maximum(k["before"], 1))[own], n)
        some = np.bincount(b.first[own], minlength=n) > 0
        return pa.table({"history": pa.array(b.history[some].view(np.int64)), "lower": pa.array(lower[some], pa.float64()),
                         "seen": pa.array(seen[some], pa.float64())})

    found = pairs.applyInArrow(documents, f"block long, place long, doc_id {kind}, held_out boolean, n_tokens long, "
                                          "n_known long, base_score double, direct double")
    weights = (pairs.applyInArrow(masses, "history long, lower double, seen double").groupBy("history")
               .agg(F.sum("lower").alias("lower"), F.sum("seen").alias("seen"))
               .select("history", F.log10((1 - F.col("seen")) / (1 - F.col("lower"))).alias("weight")))
    backed = (pairs.applyInArrow(unseen, "block long, place long, history long, times long").join(weights, "history")
              .groupBy("block", "place").agg(F.sum(F.col("times") * F.col("weight")).alias("backed")))
    return found.join(backed, ["block", "place"], "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score", (F.col("direct") + F.coalesce("backed", F.lit(0.0))).alias("score"))


def _unknown_mass(tables: DataFrame, model: _Model) -> float:
    """What the unigrams' discounts leave: one less the sum of d1(c) c / N."""
    if not model.train_tokens:
        return 1.0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for data, own in zip(batch.column("n"), batch.column("own"), strict=True):
                c = _unpack(data.as_py(), "i8")
                c = c[np.unpackbits(np.frombuffer(own.as_py(), np.uint8), count=len(c)).astype(bool)]
                total += float((discounts(model.one, c) * c).sum())
        yield pa.RecordBatch.from_pydict({"s": [total]})

    words = tables.where((F.col("level") == 1) & F.col("block").isNotNull()).select("n", "own")
    return 1 - words.mapInArrow(add, "s double").agg(F.sum("s")).first()[0] / model.train_tokens
