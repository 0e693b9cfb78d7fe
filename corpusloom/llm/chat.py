"""Chat formatting from reply trees.

Messages form trees by their parent.  Root-to-leaf paths are enumerated by iterative
self-joins, branches are ranked by score, and each chosen path is formatted as one
conversation with a loss mask over the assistant's texts.

1. Climbing: each round joins a message's pointer with that of the message it points
   to, so pointers reach twice as far (1, 2, 4, ... ancestors) and carry depth and score
   along; a message is settled when it has reached its root.  A tree of depth d takes
   log2(d) rounds, and only messages that have not settled take part.
2. Leaves are the messages without a reply.  A branch's score is the mean of its
   messages' scores; of each tree the ``top`` best branches stay (ties: the longer one,
   then the smaller leaf).
3. The chosen paths are spelt out by the pointers of all rounds, the farthest first:
   each join at most doubles the members that are known.  Only ids take part up to
   here; texts join the members of chosen paths alone.
4. A path's messages are put together in order.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  A control string
(``CONTROL``) inside a text gets a backslash after its first character, one that has
backslashes there already gets one more, so no text can be taken for a mark and
``unescape`` gives every text back.  ``loss_spans`` marks the escaped text of each
assistant turn: ``start`` and ``length`` in code points of the whole conversation,
``turn`` and ``at`` its place within the turn.

Everything is made of DataFrame functions.

Defined cases: a null role or text is empty; a null tree or conversation is one like any
other; a message whose parent is null or not in the tree is a root; rows that
repeat a message's id are one message with the smallest role and text; messages on or
below a cycle of replies have no root and are left out; a null score counts as 0; rows of
a thread that tie in turn follow the order of role and of the text's md5, repeated
rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import let, own_columns
from corpusloom.operators.ranking import ordered_rank
from corpusloom.session import stage_table

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates: none may stand in a formatted text.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
ASSISTANT = "assistant"
TOP = 1
_REST = "|".join(re.sub(r"([|\]])", r"\\\1", c[1:]) for c in CONTROL)
ESCAPE, UNESCAPE = rf"([<\[])(\\*)({_REST})", rf"([<\[])\\(\\*)({_REST})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role ends at the first line break, so its own are written as ``%0A``."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _climb(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Of ``links(tree, node, parent, score)``: the settled messages ``(tree, node, depth,
    total)``, and for each k the pointers ``(tree, node, up)`` to the ancestor 2^k above."""
    above = links.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    first = links.join(above, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_n")), "left")
    state = stage_table(first.select("tree", "node", F.col("_n").alias("up"), F.lit(1).cast("long").alias("depth"),
                                     F.coalesce("score", F.lit(0.0)).cast("double").alias("total")), "climb")
    n = state.count()
    settled, pointers = [state.where(F.col("up").isNull())], []
    while 1 << len(pointers) <= n:  # a pointer that goes farther runs in a cycle
        live = state.where(F.col("up").isNotNull())
        if live.isEmpty():
            break
        pointers.append(live.select("tree", "node", "up"))
        reached = reduce(DataFrame.unionByName, [*settled, live]).toDF("_t", "_n", "_up", "_depth", "_total")
        state = stage_table(
            live.join(reached, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("up") == F.col("_n")))
            .select("tree", "node", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"),
                    (F.col("total") + F.col("_total")).alias("total")), "climb")
        settled.append(state.where(F.col("up").isNull()))
    return reduce(DataFrame.unionByName, settled).drop("up"), pointers


def paths(links: DataFrame, top: int = TOP) -> DataFrame:
    """``(tree, leaf, branch, score, pos, node)``: the messages of each tree's ``top``
    best root-to-leaf paths (``branch`` counts from 1, ``pos`` from 1 at the root).
    ``links`` holds ``tree, node, parent, score``, one row a message."""
    if top < 1:
        raise ValueError("top must be at least 1")
    settled, pointers = _climb(links)
    leaves = settled
    if pointers:
        replied = pointers[0].select(F.col("tree").alias("_t"), F.col("up").alias("_n"))
        leaves = settled.join(replied, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "node")
    members = (leaves.withColumn("score", F.col("total") / F.col("depth"))
               .withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= top)
               .select("tree", F.col("node").alias("leaf"), "branch", "score", F.col("depth").alias("pos"), "node"))
    for k in reversed(range(len(pointers))):
        up = pointers[k].toDF("_t", "_n", "_up")
        members = (members.join(up, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")), "left")
                   .select("tree", "leaf", "branch", "score", F.inline(F.filter(F.array(
                       F.struct("pos", "node"), F.struct((F.col("pos") - (1 << k)).alias("pos"), F.col("_up").alias("node"))),
                       lambda m: m["node"].isNotNull()))))
    return members


def format_paths(members: DataFrame, messages: DataFrame) -> DataFrame:
    """``(tree, leaf, branch, score, formatted, loss_spans)``, one row a path.
    ``members`` are as given by ``paths``, with a column ``message`` that names the row of
    ``messages(tree, message, role, text)`` (unique)."""
    texts = messages.select(F.col("tree").alias("_t"), F.col("message").alias("_m"), "role", "text")
    said = members.join(texts, F.col("tree").eqNullSafe(F.col("_t")) & F.col("message").eqNullSafe(F.col("_m")))
    path = ["tree", "leaf", "branch", "score"]
    turns = said.select(*path, "pos", (F.col("role") == ASSISTANT).alias("loss"),
                        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
                        escape(F.col("text")).alias("body"))
    before = Window.partitionBy(*path).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    turns = turns.withColumn("before", F.coalesce(F.sum(size).over(before), F.lit(0)))
    turn = F.struct("pos", "before", "loss", F.length("head").alias("at"), F.length("body").alias("length"),
                    F.concat("head", "body", F.lit(END)).alias("piece"))
    whole = turns.groupBy(*path).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(
        (t["pos"] - 1).cast("int").alias("turn"), (t["before"] + t["at"]).cast("long").alias("start"),
        t["at"].alias("at"), t["length"].alias("length")))
    return whole.select(*path, F.concat_ws("", F.col("turns.piece")).alias("formatted"), spans.alias("loss_spans"))


def format_trees(rows: DataFrame, tree_col: str = "tree", node_col: str = "node", parent_col: str = "parent",
                 role_col: str = "role", text_col: str = "text", score_col: str | None = "score",
                 top: int = TOP) -> DataFrame:
    """The ``top`` best root-to-leaf paths of every reply tree, each as one conversation:
    ``(tree, leaf, branch, score, formatted, loss_spans)``."""
    named = own_columns(rows, tree_col, node_col, parent_col, role_col, text_col).toDF("tree", "node", "parent", "role", "text")
    if score_col is None:
        own = own_columns(rows, tree_col, node_col, parent_col).toDF("tree", "node", "parent").withColumn("score", F.lit(0.0))
    else:
        own = own_columns(rows, tree_col, node_col, parent_col, score_col).toDF("tree", "node", "parent", "score")
    links = (own.where(F.col("node").isNotNull()).groupBy("tree", "node")
             .agg(F.min("parent").alias("parent"), F.min(F.coalesce("score", F.lit(0.0)).cast("double")).alias("score")))
    messages = _texts(named.where(F.col("node").isNotNull()), F.col("node"))
    return format_paths(paths(links, top).withColumn("message", F.col("node")), messages)


def _texts(rows: DataFrame, message: Column) -> DataFrame:
    filled = rows.select("tree", message.alias("message"), F.struct(
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"))
    return filled.groupBy("tree", "message").agg(F.min("said").alias("said")).select("tree", "message", "said.role", "said.text")


def format_threads(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """Conversations given as rows by turn: each is a reply tree in which every message
    answers the one before.  Returns ``(tree, formatted, loss_spans, ...)`` as
    ``format_trees``.

    Rows are numbered in one order over all conversations, held in ranges of it, so no task
    sorts a whole conversation for its links; texts are told apart by their md5 until a
    message joins its path."""
    named = own_columns(rows, conv_col, turn_col, role_col, text_col).toDF("tree", "turn", "role", "text")
    message = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                       F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    ids = named.select("tree", message.alias("message"))
    ranked = ordered_rank(ids, [F.col("tree").asc_nulls_first(), F.col("message").asc_nulls_first()], "node")
    ranked = stage_table(ranked, "thread")
    before = ranked.select(F.col("tree").alias("_t"), (F.col("node") + 1).alias("_n"))
    links = ranked.join(before, F.col("node") == F.col("_n"), "left").select(
        "tree", "node", F.when(F.col("tree").eqNullSafe(F.col("_t")), F.col("_n") - 1).alias("parent"),
        F.lit(0.0).alias("score"))
    members = paths(links).join(ranked.select(F.col("node").alias("_node"), "message"), F.col("node") == F.col("_node")).drop("_node")
    return format_paths(members, _texts(named, message))


def read_back(formatted: Column, loss_spans: Column) -> Column:
    """What a conversation says, read from its formatted text and mask: a struct of
    ``turns`` (array of role and text) and ``loss`` (the unescaped text under the mask)."""
    def parts(pieces: Column) -> Column:
        def turn(piece: Column) -> Column:
            rest = F.substr(piece, F.lit(len(START) + 1))
            role = F.substring_index(rest, "\n", 1)
            return F.struct(unescape_role(role).alias("role"), unescape(F.substr(rest, F.length(role) + 2)).alias("text"))

        masked = F.transform(loss_spans, lambda s: unescape(F.substr(pieces[s["turn"]], s["at"] + 1, s["length"])))
        return F.struct(F.transform(pieces, turn).alias("turns"), F.concat_ws("", masked).alias("loss"))

    return let(F.filter(F.split(formatted, re.sub(r"([|])", r"\\\1", END), -1), lambda p: p != ""), parts)
