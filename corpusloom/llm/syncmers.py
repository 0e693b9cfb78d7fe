"""Document fingerprints by closed syncmers.

A text is cut into words (blank-separated, A-Z lower-cased); a k-mer is K words in
a row, and its inner substrings are the S-word runs inside it.  A k-mer is a closed
syncmer if the smallest hash among its inner substrings stands at its first or last
place.  Whether it is one depends on its own words only, not on its neighbours, so
an edit changes no anchor outside the words it touches, and of any
K - S + 1 neighbouring k-mers at least one is an anchor.

The anchors of a text are its syncmers' hashes with their positions; positions are
what ``aligned`` uses to place one text on another.  The fingerprint is the sha-256 of
all distinct anchor hashes in ascending order, and the likeness of two texts is the
Jaccard likeness of their whole anchor sets: it is 1 if and only if the fingerprints
are equal.  For comparing texts that do not stand side by side there is a bottom-``SKETCH``
sketch besides (hexadecimal, 16 digits each, ascending); nothing else is derived from it.

All of it is DataFrame expressions.  A text of fewer than K words has one anchor: all
its words (with none: all its characters, so blank texts differ by their blanks).  A text
whose k-mers are none of them closed (its only one is not) has its first as the anchor.

Defined cases: a null text is an empty one; the likeness of two empty texts is 1;
rows that repeat an id stand next to each other in the order of the text's
hash; a null id comes last in descending order; the next of a table's only row is
the row itself; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import let, lower_ascii, own_columns, words
from corpusloom.session import stage_table

K = 3
S = 1
SKETCH = 128


def _anchor_positions(inner: Column) -> Column:
    """Positions of the closed syncmers (if there is none: of the first k-mer), from the hashes of the S-word runs."""
    span = K - S

    def closed(i: Column) -> Column:
        least = F.least(*[inner[i + j] for j in range(span + 1)])
        return (inner[i] == least) | (inner[i + span] == least)

    # one k-mer alone may not be closed: it then is the anchor itself, so no set is empty
    found = F.filter(F.sequence(F.lit(0), F.size(inner) - span - 1), closed)
    return let(found, lambda at: F.when(F.size(at) > 0, at).otherwise(F.array(F.lit(0))))


def _inner_hashes(tokens: Column) -> Column:
    one = F.transform(tokens, lambda w: F.xxhash64(w))
    if S == 1:
        return one
    return let(one, lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(*[h[i + j] for j in range(S)])))


def _mer_hash(inner: Column, i: Column) -> Column:
    """Hash of the k-mer at i, from the inner hashes that cover its words."""
    starts = sorted({min(j, K - S) for j in range(0, K, S)} | {K - S})
    return F.xxhash64(*[inner[i + j] for j in starts])


def anchors(text: Column) -> Column:
    """Array of ``(hash, pos)``, in the order of the positions."""
    def of_words(tokens: Column) -> Column:
        many = let(_inner_hashes(tokens), lambda inner: F.transform(_anchor_positions(inner), lambda i: F.struct(
            _mer_hash(inner, i).alias("hash"), i.alias("pos"))))
        few = F.when(F.size(tokens) > 0, F.xxhash64(F.concat_ws(" ", tokens))).otherwise(F.xxhash64(text))
        return F.when(F.size(tokens) >= K, many).otherwise(F.array(F.struct(few.alias("hash"), F.lit(0).alias("pos"))))

    return let(words(lower_ascii(text)), of_words)


def anchor_set(text: Column) -> Column:
    """All distinct anchor hashes of the text, ascending."""
    def of_words(tokens: Column) -> Column:
        many = let(_inner_hashes(tokens), lambda inner: F.transform(
            _anchor_positions(inner), lambda i: _mer_hash(inner, i)))
        few = F.when(F.size(tokens) > 0, F.xxhash64(F.concat_ws(" ", tokens))).otherwise(F.xxhash64(text))
        return F.when(F.size(tokens) >= K, many).otherwise(F.array(few))

    return F.sort_array(F.array_distinct(let(words(lower_ascii(text)), of_words)))


def digest(hashes: Column) -> Column:
    """sha-256 of an anchor set."""
    return F.sha2(F.concat_ws(",", hashes.cast("array<string>")), 256)


def sketch(hashes: Column) -> Column:
    """The SKETCH smallest hashes of an anchor set."""
    return F.slice(hashes, 1, SKETCH)


def hex_sketch(hashes: Column) -> Column:
    return F.concat_ws("", F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two anchor sets."""
    return let(F.size(F.array_intersect(a, b)), lambda met: met / (F.size(a) + F.size(b) - met)).cast("double")


def aligned(a: Column, b: Column) -> Column:
    """Array of ``(a_pos, b_pos)`` by position in the first text: the anchors (see
    ``anchors``) that each of the two texts has exactly once, for placing a passage of
    one text on the other."""
    def tagged(xs: Column, tag: int) -> Column:
        return F.transform(xs, lambda x: F.struct(x["hash"].alias("h"), F.lit(tag).alias("tag"), x["pos"].alias("pos")))

    def met(xs: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda j: (
            F.coalesce(F.get(xs, j + 1)["h"] == xs[j]["h"], F.lit(False)) & (xs[j]["tag"] == 0)
            & (F.get(xs, j + 1)["tag"] == 1) & F.coalesce(F.get(xs, j - 1)["h"] != xs[j]["h"], F.lit(True))
            & F.coalesce(F.get(xs, j + 2)["h"] != xs[j]["h"], F.lit(True))))
        return F.sort_array(F.transform(at, lambda j: F.struct(xs[j]["pos"].alias("a_pos"),
                                                               F.get(xs, j + 1)["pos"].alias("b_pos"))))

    return let(F.sort_array(F.concat(tagged(a, 0), tagged(b, 1))), met)


#: Ranges of ids for each shuffle partition.
RANGES = 4


def _ranges(ids: DataFrame) -> DataFrame:
    """``(range, first_id, first_tie, before)``: one row for each range of ids that has
    rows, its first row in descending order, and the range whose rows come before
    (for the first range, cyclically, the last)."""
    first = ids.groupBy("range").agg(F.max_by(F.struct("doc_id", "tie"), F.struct("known", "doc_id", "order")).alias("f"))
    around = Window.orderBy("range")  # as many rows as there are ranges
    last = F.max("range").over(Window.partitionBy())
    return first.select("range", F.col("f.doc_id").alias("first_id"), F.col("f.tie").alias("first_tie"),
                        F.coalesce(F.lag("range").over(around), last).alias("before"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """Every document in its range of ids, with ``next_text``, the text that follows in
    descending id order (after the last: the first), and the window of this order.

    Ids are cut at approximate quantiles into many ranges (ids that are no numbers where sorted
    ranges of them end); each range is one window group.  The first row of a range is also sent, marked ``extra``, behind the last
    row of the range before it, so no window needs more than its range."""
    spark = docs.sparkSession
    rows = own_columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["doc_id"].dataType
    if isinstance(kind, T.NumericType):
        cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0]
    else:
        known = rows.select("doc_id").where(F.col("doc_id").isNotNull())
        ends = known.repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id()).agg(F.max("doc_id").alias("c"))
        cuts = [r.c for r in ends.collect()]  # one for each range
    cuts = sorted(set(cuts or []), reverse=True)
    cut_array = F.array(*[F.lit(c) for c in cuts]).cast(T.ArrayType(kind))
    placed = rows.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(
        F.size(F.filter(cut_array, lambda c: c > F.col("doc_id")))))
    tie = F.xxhash64("text")
    firsts = stage_table(_ranges(placed.select("range", "doc_id", tie.alias("tie"), F.col("doc_id").isNotNull().alias("known"),
                                               (-tie).alias("order"))), "ranges")
    met = placed.join(F.broadcast(firsts), "range")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (tie == F.col("first_tie"))
    here = F.struct(F.col("range"), F.lit(False).alias("extra"))
    behind = F.struct(F.col("before").alias("range"), F.lit(True).alias("extra"))
    sent = met.select("doc_id", "text", tie.alias("tie"), F.explode(
        F.when(is_first, F.array(here, behind)).otherwise(F.array(here))).alias("at"))
    sent = sent.select("doc_id", "text", "tie", "at.range", "at.extra")
    order = Window.partitionBy("range").orderBy("extra", F.col("doc_id").desc_nulls_last(), "tie")
    return sent.withColumn("next_text", F.lead("text").over(order)), order


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form (the last third replaced by as
    many code points from the start of the next document), with likenesses."""
    rows, order = with_next(docs, id_col, text_col)
    n_chars = F.length("text")
    cut = F.floor(n_chars / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n_chars - cut),
                      F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    own = rows.withColumn("edited", edited).select(
        "doc_id", "tie", "range", "extra", n_chars.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), anchor_set(F.col("text")).alias("own"),
        F.when(~F.col("extra"), anchor_set(F.col("edited"))).alias("changed"))
    # all that needs the edited text's anchors comes before the window, whose rows then hold one set each
    made = own.select("doc_id", "tie", "range", "extra", "n_chars", "edited_sha256", "own",
                      digest(F.col("own")).alias("fingerprint"), digest(F.col("changed")).alias("edited_fingerprint"),
                      hex_sketch(sketch(F.col("own"))).alias("sketch"),
                      hex_sketch(sketch(F.col("changed"))).alias("edited_sketch"),
                      likeness(F.col("own"), F.col("changed")).alias("near_edited"))
    beside = made.withColumn("beside", F.lead("own").over(order)).where(~F.col("extra"))
    return beside.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                         likeness(F.col("own"), F.col("beside")).alias("near_next"), "sketch", "edited_sketch")
