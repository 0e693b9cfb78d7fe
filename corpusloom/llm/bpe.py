"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus's frequent words (pieces of the pre-tokenizer's pattern) are compiled,
with their token ids, into a minimal acyclic automaton: words share prefixes and
suffixes, and the numbers on the arcs of a word's path add up to the word's place in
sorted order, which leads to its ids.  The automaton, the vocabulary and the merges
are one file of flat arrays in the shared checkpoint folder; Spark hands it to the
executors, where all Python workers memory-map the same copy.  Words that the
automaton does not have are merged exactly, pair by pair in the order of ranks, so
the result does not depend on the lexicon.

Frequent words come from counters of bounded size, one for each task, over all whole
texts; their size and the lexicon's are parameters and only bear on speed.

Defined cases: a null or empty text has no ids and decodes to the empty text; the
tokenizer's special tokens are recognised where they stand in a text, as its own
library does; rows that repeat an id are documents of their own; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import own_columns
from corpusloom.session import stage_path, stage_table

LEXICON_WORDS = 1 << 17
WORDS_PER_TASK = 1 << 16
MEMO_CHUNKS = 1 << 19
DOCS_AT_ONCE = 256
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the pre-tokenizer's pattern (white space spelled out).
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
                     rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: White space other than the space and the line feed.
RARE = re.compile(r"[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words of up to so many bytes are merged together, longer ones one by one.
TOGETHER = 48


def _wide(text: str) -> bool:
    """Whether white space may stand beside a space: only then can a word reach over one."""
    return "  " in text or " \n" in text or "\n " in text or RARE.search(text) is not None


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def read_tokenizer(path: str) -> dict[str, np.ndarray]:
    """The arrays of a byte-level BPE tokenizer file: token bytes, merges by rank, and
    special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
        raise ValueError("not a byte-level BPE tokenizer")
    chars, vocab = _byte_chars(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in vocab.items():
        tokens[i] = bytes(chars[c] for c in token)
    for token, i in special.items():
        tokens[i] = token.encode()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return {"token_at": np.cumsum([0, *map(len, tokens)]).astype(np.int64),
            "token_bytes": np.frombuffer(b"".join(tokens), np.uint8),
            "merges": np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int32).reshape(-1, 3),
            "byte_ids": np.array([vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])], np.int32),
            "special": np.frombuffer(json.dumps(special).encode(), np.uint8)}


class Merger:
    """Exact merging of words by ranks."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        merges = arrays["merges"].astype(np.int64)
        self.byte_ids = arrays["byte_ids"].astype(np.int64)
        self.rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(merges.tolist())}
        # the same as arrays: pairs in order, with rank and result; the last rank is none
        self.none = len(merges)
        pairs = merges[:, 0] << 32 | merges[:, 1]
        order = np.argsort(pairs)
        self.pairs, self.ranks = np.append(pairs[order], np.int64(1) << 62), np.append(order, self.none)
        self.results = np.append(merges[:, 2], -1)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], self.none)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, one word after another, and how many each word has.

        Words of like length are merged together: each round merges, in every word, the
        first pair of the lowest rank."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        text, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        out, length = [np.zeros(0, np.int64)] * n, np.zeros(n, np.int64)
        for low, high in ((0, 6), (6, 12), (12, 24), (24, TOGETHER)):
            some = np.flatnonzero((size > low) & (size <= high))
            for part in np.array_split(some, len(some) // 16384 + 1) if len(some) else ():
                ids, left = self._together(text, at[part], size[part])
                length[part] = left
                for i, row, k in zip(part.tolist(), ids, left.tolist(), strict=True):
                    out[i] = row[:k]
        for i in np.flatnonzero(size > TOGETHER).tolist():
            out[i] = np.array(self._long(self.byte_ids[text[at[i]:at[i] + size[i]]].tolist()))
            length[i] = len(out[i])
        return np.concatenate(out) if n else np.zeros(0, np.int64), length

    def _together(self, text: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = int(size.max())
        col = np.arange(width)
        inside = col < size[:, None]
        ids = np.where(inside, self.byte_ids[text[np.where(inside, at[:, None] + col, 0)]], -1)
        left = size.copy()
        if width < 2:
            return ids, left
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(ids))
        while len(live):
            j = rank[live].argmin(axis=1)
            best = rank[live, j]
            live, j, best = live[best < self.none], j[best < self.none], best[best < self.none]
            if not len(live):
                break
            # close the gap after j, then rank the two pairs that the merged token is in
            source = np.minimum(col + (col > j[:, None]), width - 1)
            moved = np.take_along_axis(ids[live], source, axis=1)
            moved[:, -1] = -1
            moved[np.arange(len(live)), j] = self.results[best]
            ids[live] = moved
            left[live] -= 1
            ranks = np.take_along_axis(rank[live], np.minimum(source[:, :-1], width - 2), axis=1)
            ranks[:, -1] = self.none
            row = np.arange(len(live))
            right = np.minimum(j + 1, width - 1)
            k = np.minimum(j, width - 2)
            ranks[row, k] = np.where(j < width - 1, self._ranks(moved[row, j], moved[row, right]), ranks[row, k])
            before = np.flatnonzero(j > 0)
            ranks[before, j[before] - 1] = self._ranks(moved[before, j[before] - 1], moved[before, j[before]])
            rank[live] = ranks
        return ids, left

    def _long(self, ids: list[int]) -> list[int]:
        """The same merges for a long word, by a heap over a linked list."""
        n, rank = len(ids), self.rank
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rank[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else -1
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = rank[pair][1], None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (ids[k], ids[after[k]])) in rank:
                    heapq.heappush(heap, (rank[p][0], k, p))
        return [i for i in ids if i is not None]


def compile_lexicon(words: list[bytes], merger: Merger) -> dict[str, np.ndarray]:
    """A minimal acyclic automaton of the words, with their token ids.

    Words are added in sorted order; when a word leaves the last word's path, the
    states behind the branch are final in form and are replaced by equal ones."""
    words = sorted(set(words) - {b""})
    arcs: list[list[list[int]]] = [[]]  # of each state: [byte, target], ascending
    ends = [False]
    known: dict[tuple, int] = {}
    path, last = [0], b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            form = (ends[state], *(x for arc in arcs[state] for x in arc))
            same = known.setdefault(form, state)
            arcs[path[-1]][-1][1] = same

    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        settle(shared)
        for byte in word[shared:]:
            arcs[path[-1]].append([byte, len(arcs)])
            path.append(len(arcs))
            arcs.append([])
            ends.append(False)
        ends[path[-1]] = True
        last = word
    settle(0)
    # states in use, children before parents, and how many words end behind each
    number, count, stack, order = {}, {}, [(0, False)], []
    while stack:
        state, done = stack.pop()
        if done:
            if state not in count:
                count[state] = ends[state] + sum(count[t] for _, t in arcs[state])
                number[state] = len(order)
                order.append(state)
        elif state not in count:
            stack.append((state, True))
            stack += [(t, False) for _, t in arcs[state]]
    keys, target, skip = [], [], []
    for state in order:
        before = int(ends[state])
        for byte, t in arcs[state]:
            keys.append(number[state] << 8 | byte)
            target.append(number[t])
            skip.append(before)
            before += count[t]
    ids, size = merger.encode(words)
    return {"arc_key": np.array(keys, np.int64), "arc_target": np.array(target, np.int64),
            "arc_skip": np.array(skip, np.int64), "ends": np.array([ends[s] for s in order], np.uint8),
            "start": np.array([number[0]], np.int64), "word_at": np.concatenate([[0], np.cumsum(size)]).astype(np.int64), "word_ids": ids.astype(np.int32)}


def to_file(arrays: dict[str, np.ndarray]) -> bytes:
    """One file of flat arrays: a header, then each array at a multiple of 64 bytes."""
    at, places, parts = 0, {}, []
    for name, a in arrays.items():
        data = np.ascontiguousarray(a).tobytes()
        places[name] = [a.dtype.str, list(a.shape), at]
        parts.append(data + b"\0" * (-len(data) % 64))
        at += len(parts[-1])
    header = json.dumps(places).encode()
    header += b" " * (-(len(header) + 8) % 64)
    return len(header).to_bytes(8, "little") + header + b"".join(parts)


def from_file(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped."""
    data = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(data[:8].tobytes(), "little")
    out = {}
    for name, (kind, shape, at) in json.loads(data[8:8 + size].tobytes()).items():
        n = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = data[8 + size + at:8 + size + at + n].view(kind).reshape(shape)
    return out


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length], one after another."""
    ends = np.cumsum(length)
    return flat[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


class Codec:
    """Encodes and decodes texts from the arrays of a lexicon file."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a, self.merger = arrays, Merger(arrays)
        self.special: dict[str, int] = json.loads(arrays["special"].tobytes())
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._forget()

    def _forget(self) -> None:
        #: place of a chunk's run; a chunk is what follows a space, or (after a space as mark) a text by itself
        self.memo: dict[str, int] = {}
        self.start, self.length, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(
            4096, np.int32), 0

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the lexicon, -1 where it has none; all words walk the
        automaton together, byte by byte."""
        a, n = self.a, len(words)
        state, place = np.full(n, int(a["start"][0])), np.zeros(n, np.int64)
        size = np.fromiter(map(len, words), np.int64, n)
        text, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        live = np.flatnonzero(size > 0)
        state[size == 0] = -1
        if not len(a["arc_key"]):
            state[:] = -1
            live = live[:0]
        for k in range(int(size.max(initial=0))):
            live = live[size[live] > k]
            if not len(live):
                break
            key = state[live] << 8 | text[at[live] + k]
            arc = np.minimum(np.searchsorted(a["arc_key"], key), len(a["arc_key"]) - 1)
            hit = a["arc_key"][arc] == key
            state[live[~hit]] = -1
            live, arc = live[hit], arc[hit]
            state[live] = a["arc_target"][arc]
            place[live] += a["arc_skip"][arc]
        found = state >= 0
        found[found] = a["ends"][state[found]] == 1
        return np.where(found, place, -1)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and each word's start and length in them: from the lexicon, else merged."""
        place = self.lookup(words)
        at, known, new = self.a["word_at"], np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        ids, size = self.merger.encode([words[i] for i in new])
        length = np.zeros(len(words), np.int64)
        length[known], length[new] = at[place[known] + 1] - at[place[known]], size
        start = np.zeros(len(words), np.int64)
        start[new] = np.cumsum(size) - size
        start[known] = len(ids) + np.cumsum(length[known]) - length[known]
        return np.concatenate([ids, _gather(self.a["word_ids"], at[place[known]], length[known])]), start, length

    def _resolve(self, chunks: list[str]) -> None:
        """Put the ids of new chunks (texts that are cut apart on their own) in the memo."""
        pieces = [WORD.findall(c[1:] if c[:1] == " " else " " + c) for c in chunks]
        number: dict[str, int] = {}
        which = np.array([number.setdefault(w, len(number)) for ws in pieces for w in ws], np.int64)
        ids, start, length = self._words([w.encode() for w in number])
        flat = _gather(ids, start[which], length[which])
        ends = np.cumsum([len(ws) for ws in pieces])
        total = np.concatenate([[0], np.cumsum(length[which])])
        stop = total[ends]
        first, used = len(self.memo), self.used + len(flat)
        for name, need in (("start", first + len(chunks)), ("length", first + len(chunks)), ("flat", used)):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(need, old.dtype)]))
        begin = np.concatenate([[0], stop[:-1]])
        self.start[first:first + len(chunks)] = self.used + begin
        self.length[first:first + len(chunks)] = stop - begin
        self.flat[self.used:used] = flat
        self.used = used
        self.memo.update(zip(chunks, range(first, first + len(chunks)), strict=True))

    def _chunks(self, text: str) -> list[str]:
        """Keys of the parts of a text without special tokens that are cut on their own."""
        if _wide(text):
            return [" " + w for w in WORD.findall(text)]
        out = text.split(" ")
        if out[0]:
            out[0] = " " + out[0]
            return out
        return out[1:]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self.memo) > MEMO_CHUNKS:
            self._forget()
        parts = []  # (text, special token or None, keys)
        for k, text in enumerate(texts):
            if self.special and any(s in text for s in self.special):
                for part in filter(None, self.split.split(text)):
                    parts.append((k, self.special.get(part), [] if part in self.special else self._chunks(part)))
            else:
                parts.append((k, None, self._chunks(text)))
        found = [list(map(self.memo.get, keys)) for _, _, keys in parts]
        holes = [[i for i, x in enumerate(slots) if x is None] for slots in found]
        new = {keys[i] for (_, _, keys), at in zip(parts, holes, strict=True) for i in at}
        if new:
            self._resolve(list(new))
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for (k, special, keys), slots, at in zip(parts, found, holes, strict=True):
            if special is not None:
                out[k].append(np.array([special], np.int32))
                continue
            for i in at:
                slots[i] = self.memo[keys[i]]
            slot = np.array(slots, np.int64)
            out[k].append(_gather(self.flat, self.start[slot], self.length[slot]))
        return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.int32), *x]) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        at = self.a["token_at"]
        return _gather(self.a["token_bytes"], at[ids], at[ids + 1] - at[ids]).tobytes().decode("utf-8", "replace")


@lru_cache(2)
def _codec(name: str) -> Codec:
    return Codec(from_file(SparkFiles.get(name)))


def frequent_words(docs: DataFrame, text_col: str = "text", lexicon_words: int = LEXICON_WORDS,
                   words_per_task: int = WORDS_PER_TASK) -> list[bytes]:
    """The words that the tasks' counters found most often, at most ``lexicon_words``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                chunks.update((text.as_py() or "").split(" "))
                if len(chunks) > 8 * words_per_task:
                    chunks = Counter(dict(chunks.most_common(4 * words_per_task)))
        words: Counter[str] = Counter()
        for chunk, n in chunks.most_common(2 * words_per_task):
            for w in WORD.findall(" " + chunk):
                words[w] += n
        top = words.most_common(words_per_task)
        yield pa.RecordBatch.from_arrays([pa.array([w.encode() for w, _ in top], pa.binary()),
                                          pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    found = own_columns(docs, text_col).mapInArrow(count, "word binary, n long")
    totals = stage_table(found.groupBy("word").agg(F.sum("n").alias("n")), "words")
    # the least frequency with at most lexicon_words words above it, from a histogram of
    # frequencies on a log scale (a few hundred rows)
    step = F.floor(F.log2("n") * 8)
    sizes = totals.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()
    kept, least = 0, None
    for row in sizes:
        kept += row.words
        if kept > lexicon_words:
            break
        least = row.step
    if least is None:
        return []
    return [bytes(r.word) for r in totals.where(step >= least).select("word").collect()]


def publish(spark: SparkSession, arrays: dict[str, np.ndarray]) -> str:
    """Write the arrays as a file in the shared folder and have Spark hand it to every
    executor; returns the name by which they find it."""
    path = stage_path(spark, "lexicon")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    try:
        out.write(bytearray(to_file(arrays)))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def build_lexicon(docs: DataFrame, tokenizer_path: str, text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> str:
    """Compile the lexicon of the documents' frequent words; returns its name."""
    arrays = read_tokenizer(tokenizer_path)
    return publish(docs.sparkSession, arrays | compile_lexicon(
        frequent_words(docs, text_col, lexicon_words), Merger(arrays)))


def encode(docs: DataFrame, lexicon: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every document: the ids as little-endian
    unsigned 32-bit integers, and the text that they decode to."""
    rows = own_columns(docs, id_col, text_col).toDF("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(lexicon)
        for batch in batches:
            for at in range(0, len(batch), DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                ids = codec.encode([t.as_py() or "" for t in part.column("text")])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                     pa.array([codec.decode(x) for x in ids], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def decode(tokens: DataFrame, lexicon: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded`` from ids as ``encode`` returns them (null: empty)."""
    rows = own_columns(tokens, id_col, ids_col).toDF("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(lexicon)
        for batch in batches:
            texts = [codec.decode(np.frombuffer(x.as_py() or b"", "<u4").astype(np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded string")


def default_tokenizer() -> str:
    """Where the public byte-level tokenizer file lies that the queries use."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def digests(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    coded = encode(docs, build_lexicon(docs, tokenizer_path or default_tokenizer()))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
