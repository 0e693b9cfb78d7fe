"""Column functions for model responses, score maps and probability vectors
(P12-P15, P19, P22, P23, T3).  All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import strip_ws

# The error label and the code-fence markers of model answers.
ERROR_LABEL = "ERROR"
FENCE_JSON = "```json"
FENCE = "```"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_response(col) -> Column:
    """Drop JSON code fences and bare fences (literal replaces), then strip
    surrounding whitespace including line breaks."""
    return strip_ws(F.replace(F.replace(_c(col), F.lit(FENCE_JSON), F.lit("")), F.lit(FENCE), F.lit("")))


def parse_scores(col) -> Column:
    """``struct<ok boolean, empty boolean, scores map<string,double>>``.

    * ``ok`` — the text is exactly one JSON object (``[`` + text + ``]`` parses
      as a one-element array holding an object; rejects trailing text,
      ``{..},{..}``, lists, malformed text, duplicate keys and NaN);
    * ``empty`` — ``scores`` is missing or falsy (null, {}, [], '', 0, false):
      the reference then yields (null, 0.0, null, 0.0);
    * ``scores`` — the score object as an insertion-ordered map when every value
      is a number; null otherwise (then the row is an error row).
    """
    r = _c(col)
    return scores_struct(parse_inputs(r)["v"], parse_inputs(r)["m"])


def parse_inputs(r: Column) -> Column:
    """The two parses of one response: ``v`` the VARIANT of ``[`` + text + ``]``
    (validity, key presence), ``m`` the insertion-ordered score map."""
    return F.struct(F.try_parse_json(F.concat(F.lit("["), r, F.lit("]"))).alias("v"),
                    F.from_json(r, "scores map<string,double>").getField("scores").alias("m"))


def scores_struct(v: Column, m: Column) -> Column:
    """P13 from the two parses (see ``parse_scores``)."""
    arr = F.try_variant_get(v, "$", "array<variant>")
    first = F.try_variant_get(v, "$[0]", "variant")
    ok = v.isNotNull() & (F.size(arr) == 1) & F.schema_of_variant(first).startswith("OBJECT")
    sc = F.try_variant_get(v, "$[0].scores", "variant")
    sj = F.to_json(sc)
    empty = sc.isNull() | F.is_variant_null(sc) | sj.isin("{}", "[]", '""', "0", "false", "-0")
    # by the values' own types: "NaN" and "Infinity" are strings, though a cast takes them
    values = F.map_values(F.try_variant_get(sc, "$", "map<string,variant>"))
    numeric = (F.schema_of_variant(sc).startswith("OBJECT<") & m.isNotNull()
               & F.forall(values, lambda x: F.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))
               & F.forall(F.map_values(m), lambda x: x.isNotNull()))
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.coalesce(ok & empty, F.lit(False)).alias("empty"),
                    F.when(ok & ~empty & numeric, m).alias("scores"))


def top_two(map_col) -> Column:
    """Top-2 of a score map by a stable descending sort (the first key wins
    a tie).  ``struct<k1, v1, k2, v2>``; a missing second entry gives
    (null, 0.0); an empty/null map gives (null, 0.0, null, 0.0)."""
    m = _c(map_col)
    ranked = F.sort_array(F.transform(F.map_entries(m), lambda e, i: F.struct(
        e["value"].alias("v"), (-i).alias("ni"), e["key"].alias("k"))), asc=False)
    one, two = F.try_element_at(ranked, F.lit(1)), F.try_element_at(ranked, F.lit(2))
    return F.struct(one["k"].alias("k1"), F.coalesce(one["v"], F.lit(0.0)).alias("v1"),
                    two["k"].alias("k2"), F.coalesce(two["v"], F.lit(0.0)).alias("v2"))


def result_columns(parsed, top) -> list[Column]:
    """Prediction columns of a result row — on any failure both
    predictions are 'ERROR' and both confidences 0.0."""
    p, t = _c(parsed), _c(top)
    good = p["ok"] & (p["empty"] | p["scores"].isNotNull())
    err = F.lit(ERROR_LABEL)
    return [F.when(good, t["k1"]).otherwise(err).alias("predicted_one"),
            F.when(good, t["v1"]).otherwise(F.lit(0.0)).alias("confidence_one"),
            F.when(good, t["k2"]).otherwise(err).alias("predicted_two"),
            F.when(good, t["v2"]).otherwise(F.lit(0.0)).alias("confidence_two")]


def content_key(text, embedder: str | Column) -> Column:
    """First 16 hex digits of md5(text) + '_' + embedder, per text (the
    reference hashes a whole batch; a per-text key makes reuse exact)."""
    e = embedder if isinstance(embedder, Column) else F.lit(embedder)
    return F.concat(F.substring(F.md5(_c(text)), 1, 16), F.lit("_"), e)


def store_key(text, embedder: str | Column) -> Column:
    """Identity of a text in the embedding store: the whole sha-256 of the text (a null
    text is an empty one) + '_' + embedder.  ``content_key`` is its short form for show."""
    e = embedder if isinstance(embedder, Column) else F.lit(embedder)
    return F.concat(F.sha2(F.coalesce(_c(text), F.lit("")), 256), F.lit("_"), e)


def argmax_label(arr) -> Column:
    """0-based index of the first maximum."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def bind_sum(arr: Column, fn) -> Column:
    """``fn(s)`` with ``s`` = the array's sum bound once per row: the sum is
    the finish value of an ``aggregate`` (a lambda variable), so ``fn`` may use
    it inside per-element lambdas without re-summing the array per element."""
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x, fn)


def softmax(arr) -> Column:
    """Numerically stable row softmax; the maximum and the sum are each
    bound once per row (linear in the width)."""
    a = _c(arr)
    e = F.aggregate(a, F.lit(float("-inf")), lambda m, x: F.greatest(m, x),
                    lambda m: F.transform(a, lambda x: F.exp(x - m)))
    return bind_sum(e, lambda s: F.transform(e, lambda x: x / s))


def top_two_from_vector(probs, classes) -> Column:
    """Top-2 (class, probability) of a probability vector; an exact tie
    favours the later class (descending argsort of the reference); second is
    (null, 0.0) with one class."""
    ranked = F.sort_array(F.transform(_c(probs), lambda p, i: F.struct(p.alias("v"), i.alias("i"))), asc=False)
    one, two = F.try_element_at(ranked, F.lit(1)), F.try_element_at(ranked, F.lit(2))
    cls = _c(classes)
    return F.struct(F.element_at(cls, one["i"] + 1).alias("k1"), one["v"].alias("v1"),
                    F.when(two.isNotNull(), F.element_at(cls, two["i"] + 1)).alias("k2"),
                    F.coalesce(two["v"], F.lit(0.0)).alias("v2"))
