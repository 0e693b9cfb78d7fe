"""Column functions for record text, class codes and keyphrases.

All of them are built-in Spark expressions (whole-stage codegen, no Python).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators of the packed multi-valued strings.
CODE_SEP = ";;"      # between class codes inside one source column
KEY_SEP = "|"        # between feature keys after re-delimiting
LEVEL_SEP = "/"      # between main part and sub part of a class code

_WS_EDGES = r"^\s+|\s+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def combined_text(title, abstract) -> Column:
    """``title + ' ' + (abstract or '')``; a null title gives null."""
    return F.concat(_c(title), F.lit(" "), F.coalesce(_c(abstract), F.lit("")))


def merge_codes(cpc, ipcr) -> Column:
    """``(cpc or '') + ';;' + (ipcr or '')``; both empty gives ';;'."""
    return F.concat(F.coalesce(_c(cpc), F.lit("")), F.lit(CODE_SEP), F.coalesce(_c(ipcr), F.lit("")))


def clean_records(df: DataFrame, label: str | Column, id_col: str = "lens_id",
                  title: str = "title", abstract: str = "abstract",
                  cpc: str = "cpc", ipcr: str = "ipcr") -> DataFrame:
    """The cleaned label table ``(lens_id, combined, keyphrases, classifications,
    category)``.  ``keyphrases`` starts empty (null, as after the reference's CSV
    round trip) and ``category`` is the constant label."""
    lab = label if isinstance(label, Column) else F.lit(label)
    return df.select(F.col(id_col).alias("lens_id"),
                     combined_text(title, abstract).alias("combined"),
                     F.lit(None).cast("string").alias("keyphrases"),
                     merge_codes(cpc, ipcr).alias("classifications"),
                     lab.alias("category"))


def document_text(title, abstract) -> Column:
    """P5: ``'Title: ' + title + '\\n' + 'Abstract: ' + abstract``, nulls as ''."""
    return F.concat(F.lit("Title: "), F.coalesce(_c(title), F.lit("")), F.lit("\nAbstract: "),
                    F.coalesce(_c(abstract), F.lit("")))


def normalise_codes(col) -> Column:
    """Every literal ';;' becomes '|'."""
    return F.replace(_c(col), F.lit(CODE_SEP), F.lit(KEY_SEP))


def merge_feature_keys(codes, keyphrases) -> Column:
    """Codes + '|' + keyphrases (null when keyphrases is null)."""
    return F.concat(_c(codes), F.lit(KEY_SEP), _c(keyphrases))


def split_keys(col, sep: str = KEY_SEP) -> Column:
    """Literal split that keeps empty strings, like Python's ``str.split``."""
    return F.split(_c(col), re.escape(sep), -1)


def explode_keys(df: DataFrame, col: str, sep: str = KEY_SEP, key_col: str = "key",
                 drop_empty: bool = False, distinct: bool = False) -> DataFrame:
    """One row per key of the packed string.  Empty keys and repeats inside
    one record are kept unless asked otherwise (the reference keeps both)."""
    out = df.withColumn(key_col, F.explode(split_keys(col, sep)))
    if drop_empty:
        out = out.filter(F.col(key_col) != "")
    if distinct:
        out = out.dropDuplicates([c for c in out.columns if c != col])
    return out


# Level names of the hierarchical class code, coarse to fine.
LEVELS = ("section", "class", "subclass", "group")


def code_levels(col, levels=("group",)) -> Column:
    """Hierarchical levels of one class code, as an array.

    ``group`` (the only live level in the reference) is ``main/sub`` when the
    part after the first '/' is non-empty (anything after a second '/' is cut);
    ``section``/``class``/``subclass`` are the 1/3/4-character prefixes of the
    main part (documented but disabled in the reference).  An empty code has no
    levels.
    """
    code = _c(col)
    parts = F.split(code, re.escape(LEVEL_SEP), -1)
    main = F.get(parts, 0)
    sub = F.coalesce(F.get(parts, 1), F.lit(""))
    ok = (code != "") & (main != "")
    exprs = []
    for lv in levels:
        if lv == "section":
            exprs.append(F.when(ok, F.substring(main, 1, 1)))
        elif lv == "class":
            exprs.append(F.when(ok & (F.length(main) > 1), F.substring(main, 1, 3)))
        elif lv == "subclass":
            exprs.append(F.when(ok & (F.length(main) > 3), F.substring(main, 1, 4)))
        elif lv == "group":
            exprs.append(F.when((code != "") & (sub != ""), F.concat(main, F.lit(LEVEL_SEP), sub)))
        else:
            raise ValueError(f"unknown level {lv!r}; expected one of {LEVELS}")
    return F.array_compact(F.array(*exprs))


def pack_keyphrases(col, split_words: bool = False, casefold: bool = True) -> Column:
    """P10: keyphrase array -> stored '|'-packed string.

    Default keeps phrases whole and lower-cased.  ``split_words=True,
    casefold=False`` packs as the reference does from a printed list: commas,
    single quotes and brackets are removed, every space becomes a separator (a two-word
    phrase becomes two keys) and case is kept; an empty array gives ''.
    """
    arr = _c(col)
    if casefold:
        arr = F.transform(arr, lambda p: F.lower(p))
    if split_words:
        arr = F.flatten(F.transform(arr, lambda p: F.split(F.translate(p, ",'[]", ""), " ", -1)))
    return F.coalesce(F.array_join(arr, KEY_SEP), F.lit(""))


def strip_ws(col) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(_c(col), _WS_EDGES, "")


def distinct_phrases(col) -> Column:
    """Trimmed, distinct and sorted phrases of one record."""
    return F.array_sort(F.array_distinct(F.transform(_c(col), lambda p: strip_ws(p))))
