"""Chat formatting of reply trees, in DataFrame functions.

Messages (tree, id, parent, role, text, score) form trees. Self-joins double the reach of each message's pointer to
an ancestor, so a path of n messages takes about log2(n) rounds; they add up scores and depths on the way. Leaves
are ranked by the mean score of their path, ties by id, and the best `branches` of each tree are formatted, one
conversation per path. The same pointers, taken again from each chosen leaf, enumerate its path.

A turn is written <s>role[INST]text</s>. Inside roles and texts a backslash follows each of [ ] < and backslash, so
no control string can stand there, and taking it away gives them back. loss_spans are the assistants' texts as byte
ranges of the formatted UTF-8.

Null roles and texts are empty, a null score 0. A parent that isn't among the tree's messages makes its message a
root. Messages on a cycle of parents have no root and no conversation. Of messages that repeat a (tree, id) the
first by (parent, role, text, score) counts. A null tree is a tree of its own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

_CONTROL = r"([\[\]<\\])"
SALTS = 16
_COLUMNS = ("tree", "id", "parent", "role", "text", "score")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _CONTROL, r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _CONTROL + r"\\", "$1")


def _pointers(nodes: DataFrame) -> list[DataFrame]:
    """Levels (tree, id, above, total, depth): above is the ancestor 2**level steps up, total and depth the way there."""
    level = shared.materialize(nodes.select("tree", "id", F.col("parent").alias("above"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")), "pointers")
    levels = [level]
    most = level.count().bit_length()
    while len(levels) <= most and not level.where("above is not null").isEmpty():
        # Messages that have reached their root wait; the join is the same at every size.
        a, b = level.where("above is not null").alias("a"), level.hint("merge").alias("b")
        further = a.join(b, F.expr("a.tree <=> b.tree and a.above = b.id"), "left").select(
            "a.tree",
            "a.id",
            "b.above",
            F.expr("a.total + coalesce(b.total, 0)").alias("total"),
            F.expr("a.depth + coalesce(b.depth, 0)").alias("depth"),
        )
        level = shared.materialize(level.where("above is null").unionByName(further), "pointers")
        levels.append(level)
    return levels


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, branch, score, id, depth) of the messages on each tree's best paths, depth 1 at the root."""
    shared.prepare(messages.sparkSession)
    messages = messages.select(*_COLUMNS)
    order = W.partitionBy("tree", "id").orderBy("parent", "role", "text", "score")
    nodes = messages.withColumn("_first", F.row_number().over(order)).where("_first = 1").select(
        "tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    )
    known = nodes.select("tree", F.col("id").alias("_id"))
    nodes = nodes.alias("n").join(known.alias("k"), F.expr("n.tree <=> k.tree and n.parent = k._id"), "left").select(
        "n.tree", "n.id", F.col("k._id").alias("parent"), "n.score"
    )
    levels = _pointers(nodes)
    rooted = levels[-1].where("above is null").select("tree", "id", "total", "depth")
    parents = levels[0].where("above is not null").select("tree", F.col("above").alias("_id")).distinct()
    leaves = rooted.alias("n").join(parents.alias("p"), F.expr("n.tree <=> p.tree and n.id = p._id"), "left_anti")
    leaves = leaves.withColumn("score", F.col("total") / F.col("depth"))
    # The best of each salt's best: a tree's leaves never meet in one task.
    salted = W.partitionBy("tree", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy(F.desc("score"), "id")
    best = leaves.withColumn("branch", F.row_number().over(salted)).where(F.col("branch") <= branches)
    best = best.withColumn("branch", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "id")))
    best = best.where(F.col("branch") <= branches).select("tree", F.col("id").alias("leaf"), "branch", "score")
    paths = best.withColumn("id", F.col("leaf"))
    for level in levels[:-1]:
        up = level.where("above is not null").select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), "above")
        further = paths.join(up.hint("merge"), F.expr("tree <=> _tree and id = _id")).select("tree", "leaf", "branch", "score", F.col("above").alias("id"))
        paths = shared.materialize(paths.unionByName(further), "paths")
    return paths.join(rooted.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), "depth"), F.expr("tree <=> _tree and id = _id")).drop("_tree", "_id")


def format_chats(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, branch, score, formatted and loss_spans (array of start, length in bytes): a row per chosen path."""
    shared.prepare(messages.sparkSession)
    messages = messages.select(*_COLUMNS)
    paths = best_paths(messages, branches)
    first = W.partitionBy("tree", "id").orderBy("parent", "role", "text", "score")
    said = messages.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(
        F.col("tree").alias("_tree"),
        F.col("id").alias("_id"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = paths.join(said, F.expr("tree <=> _tree and id = _id"))
    turns = turns.withColumn("head", F.concat(F.lit("<s>"), escape(F.col("role")), F.lit("[INST]"))).withColumn("body", escape(F.col("text")))
    size = F.octet_length("head") + F.octet_length("body") + F.lit(4)
    before = W.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.octet_length("head"))
    span = F.when(F.col("role") == "assistant", F.struct("start", F.octet_length("body").cast("long").alias("length")))
    grouped = turns.groupBy("tree", "leaf", "branch", "score").agg(
        F.array_sort(F.collect_list(F.struct("depth", F.concat("head", "body", F.lit("</s>")).alias("turn")))).alias("turns"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
    )
    return grouped.select("tree", "branch", "score", F.array_join("turns.turn", "").alias("formatted"), "loss_spans")


def read_chats(formatted: DataFrame) -> DataFrame:
    """tree, branch, turns (array of role, text) and loss (its texts, in order), read from the formatted strings."""
    pieces = F.filter(F.split("formatted", "</s>", -1), lambda p: p != "")
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(F.substring_index(p, "[INST]", 1), 4, 1 << 30)).alias("role"),
            unescape(F.substring_index(p, "[INST]", -1)).alias("text"),
        ),
    )
    # A one-element array binds the bytes, so that they are made once.
    spans = F.flatten(
        F.transform(
            F.array(F.col("formatted").cast("binary")),
            lambda b: F.transform("loss_spans", lambda s: F.substring(b, (s["start"] + 1).cast("int"), s["length"].cast("int"))),
        )
    )
    loss = F.transform(spans, lambda b: unescape(F.decode(b, "UTF-8")))
    return formatted.select("tree", "branch", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"), loss.alias("loss"))


def conversations_as_messages(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages: each answers the one before it by (turn, role, text)."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "turn", "role", "text")
    return rows.withColumn("id", F.row_number().over(order).cast("long")).select(
        F.col("conv_id").alias("tree"),
        "id",
        F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r, text as t from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, r nulls first, t nulls first)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, r nulls first, t nulls first) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(13 + length(regexp_replace(role, '([\[\]<\\])', '\1\\', 'g')) + length(regexp_replace(text, '([\[\]<\\])', '\1\\', 'g'))) as bigint) as formatted_chars
from rows group by conv_id
"""
