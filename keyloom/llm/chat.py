"""Chat formatting of reply trees, in DataFrame operations only.

Messages (conv_id, message_id, parent_id, role, text, score) form trees. Pointer-doubling self-joins give each message
its ancestors at distances 1, 2, 4, ...; joined from the leaves downwards in powers of two they enumerate all
root-to-leaf paths in as many joins as the longest path's length has bits. Paths are ranked by the mean score of
their messages, and each chosen path is formatted as one conversation.

Template: `<|im_start|>` role newline text `<|im_end|>` newline, for each turn. A `<|` inside a text, with any number
of backslashes between its signs, gets one backslash more, which is taken off on reading, so no text can forge a
mark and every text can be restored. In roles, %, newline and < are percent-encoded. `spans` has for each turn the place of
its text in the formatted string, in code points, and whether it is under the loss mask (assistant turns are).

Defined results: a null role or text is empty; a null score counts as 0. A message whose parent is null,
absent from its conversation, or itself is a root; a message on or behind a circle of parents is a tree of its own, so
no message is lost; one without a message_id is a message of its own, its id below all others. Of rows with one conv_id and message_id the one with the smallest parent_id, then the smallest digest of role and text, counts.
Ties between paths go to the smallest leaf. Flat conversations are ordered by turn, then role and text; repeated rows are
repeated turns. A null conv_id is a conversation of its own. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

START, END = "<|im_start|>", "<|im_end|>\n"
OPENING = r"<(\\*)\|"
#: Messages of a conversation, and its share of all, beyond which it isn't gathered in one task.
HOT, MOST_HOT = 10_000, 10_000


def escape(text: Column) -> Column:
    return F.regexp_replace(text, OPENING, r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _key() -> Column:
    """The conversation's key, never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c")


def _contents(messages: DataFrame, *more: str | Column) -> DataFrame:
    """Messages with key, role and text, never null, and `ref`: 128 bits of the SHA-256 of role and text, which stand for both."""
    rows = messages.select(_key(), "conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), *more)
    whole = F.concat(escape_role(F.col("role")), F.lit("\n"), F.col("text"))
    return rows.withColumn("ref", F.unhex(F.substring(F.sha2(whole, 256), 1, 32)))


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ...: (c, node, up) with the ancestor 2^k above; the last one is not empty unless all are.

    nodes has c, node and up (null for a root). A message on or behind a circle never runs out of ancestors;
    once the distance exceeds the number of messages such ones are all that is left.
    """
    levels = [nodes.where("up IS NOT NULL")]
    limit = nodes.count()
    while True:
        last = levels[-1]
        higher = last.alias("a").join(last.alias("b"), (F.col("a.c") == F.col("b.c")) & (F.col("a.up") == F.col("b.node")))
        higher = durable(higher.select("a.c", "a.node", F.col("b.up").alias("up")))
        if higher.isEmpty():
            return levels
        if 1 << len(levels) > limit:
            raise RecursionError
        levels.append(higher)


def _levels(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    try:
        return nodes, _jumps(nodes)
    except RecursionError:
        # follow the parents for as many steps as there are messages: who still has one is on or behind a circle
        reach, steps, limit = durable(nodes.where("up IS NOT NULL")), 1, nodes.count()
        while steps <= limit:
            reach = durable(reach.alias("a").join(reach.alias("b"), (F.col("a.c") == F.col("b.c")) & (F.col("a.up") == F.col("b.node"))).select("a.c", "a.node", F.col("b.up").alias("up")))
            steps *= 2
        stuck = reach.select("c", "node", F.lit(True).alias("stuck"))
        nodes = durable(nodes.join(stuck, ["c", "node"], "left").withColumn("up", F.when(F.col("stuck").isNull(), F.col("up"))).drop("stuck"))
        return nodes, _jumps(nodes)


def paths(messages: DataFrame) -> DataFrame:
    """(c, leaf, above, node): every message on every root-to-leaf path, `above` counting from the leaf."""
    nodes, levels = _levels(messages)
    inner = levels[0].select("c", F.col("up").alias("node")).distinct()
    found = nodes.join(inner, ["c", "node"], "left_anti").select("c", F.col("node").alias("leaf"), F.lit(0).cast("long").alias("above"), "node")
    for k in range(len(levels) - 1, -1, -1):
        jump = levels[k].select("c", "node", "up")
        higher = found.join(jump, ["c", "node"]).select("c", "leaf", (F.col("above") + (1 << k)).alias("above"), F.col("up").alias("node"))
        found = durable(found.unionByName(higher))
    return found


def _identified(rows: DataFrame) -> DataFrame:
    """Messages (c, node, parent, ref, score) without a node get one each, below all ids that occur in their conversation."""
    lowest = rows.groupBy("c").agg(F.least(F.min("node"), F.min("parent"), F.lit(0)).alias("low"))
    nth = F.row_number().over(Window.partitionBy("c").orderBy("parent", "ref", "score"))
    own = rows.where("node IS NULL").withColumn("nth", nth).join(lowest, "c").withColumn("node", F.col("low") - F.col("nth"))
    return rows.where("node IS NOT NULL").unionByName(own.select(*rows.columns))


def format_trees(messages: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """The best `branches` paths of each tree, as (conv_id, leaf_id, rank, score, n_turns, formatted, spans).

    A tree is a root message with all that answers it; a conversation with several roots has several trees.
    """
    told = _contents(messages, F.col("message_id").alias("node"), F.col("parent_id").alias("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    rows = told.select("c", "node", "parent", "ref", "score")
    rows = _identified(durable(rows)) if messages.schema["message_id"].nullable else rows
    once = durable(rows.groupBy("c", "node").agg(F.min(F.struct("parent", "ref", "score")).alias("m")).select("c", "node", "m.*"))
    known = once.select("c", F.col("node").alias("parent"), F.lit(True).alias("known"))
    up = F.when(F.col("known") & (F.col("parent") != F.col("node")), F.col("parent"))
    return _format(once.join(known, ["c", "parent"], "left").select("c", "node", up.alias("up"), "score", "ref"), told, branches, loss_role)


def format_chains(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """`format_trees` of flat conversations (conv_id, turn, role, text): trees of one branch, each turn answering the one before."""
    told = _contents(conversations, "turn")
    rows = durable(told.select("c", "turn", "role", "ref"))
    same = ["c", "turn", "role"]
    tied = durable(rows.groupBy(*same).agg(F.min("ref").alias("low"), F.max("ref").alias("high")).where("low <> high").select(*same))
    if tied.isEmpty():
        rows = rows.withColumn("place", F.lit(0))
    else:
        # only where turn and role tie do the texts decide
        texts = told.select(*same, "ref", "text").join(tied, same, "left_semi").distinct()
        place = F.row_number().over(Window.partitionBy(*same).orderBy("text")).alias("place")
        rows = rows.join(durable(texts.select(*same, "ref", place)), [*same, "ref"], "left")
    nth = F.row_number().over(Window.partitionBy("c").orderBy("turn", "role", "place")).cast("long")
    nodes = rows.select("c", nth.alias("node"), "ref")
    return _format(nodes.select("c", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("up"), F.lit(0.0).alias("score"), "ref"), told, 1, loss_role)


def _format(nodes: DataFrame, told: DataFrame, branches: int, loss_role: str) -> DataFrame:
    """Ranks the paths of the nodes (c, node, up, score, ref) and formats the best.

    Texts stay out of all this until the chosen paths are known; then they are shuffled once, by conversation. Conversations
    of over `HOT` messages and a `MOST_HOT`th of all are shuffled by text and by path instead, so none is gathered in one task.
    """
    nodes = durable(nodes)
    found = paths(nodes.select("c", "node", "up"))
    ends = found.join(nodes.select("c", "node", "score"), ["c", "node"]).groupBy("c", "leaf").agg(F.avg("score").alias("mean"), F.max_by("node", "above").alias("root"))
    order = Window.partitionBy("c", "root").orderBy(F.desc("mean"), "leaf")
    best = ends.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches).drop("root")
    chosen = durable(found.join(best, ["c", "leaf"]).join(nodes.select("c", "node", "ref"), ["c", "node"]).select("c", "ref", "leaf", "rank", "mean", "above"))
    limit = max(HOT, nodes.count() // MOST_HOT)
    hot = durable(nodes.groupBy("c").count().where(F.col("count") > limit).select("c"))
    told = told.select("c", "ref", "conv_id", "role", "text")
    if hot.isEmpty():
        return _assemble(told, chosen, ["c"], loss_role)
    # at most MOST_HOT keys
    parts = [[df.join(F.broadcast(hot), "c", how) for df in (told, chosen)] for how in ("left_anti", "left_semi")]
    return _assemble(*parts[0], ["c"], loss_role).unionByName(_assemble(*parts[1], ["c", "ref"], loss_role))


def _assemble(told: DataFrame, chosen: DataFrame, by: list[str], loss_role: str) -> DataFrame:
    """The chosen paths (c, ref, leaf, rank, mean, above) formatted, with the texts of told (c, ref, conv_id, role, text)."""
    both = told.unionByName(chosen, allowMissingColumns=True).repartition(*by)
    # the texts of a ref come before its places on paths, which all take the first
    spoken = F.first(F.struct("conv_id", "role", "text")).over(Window.partitionBy("c", "ref").orderBy(F.col("rank").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    turn = both.withColumn("m", spoken).where("rank IS NOT NULL").select("c", "leaf", "rank", "mean", "above", "m.*")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turn = turn.select("c", "leaf", "rank", "mean", "conv_id", "above", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == loss_role).alias("loss"))
    size = F.length("head") + F.length("body") + len(END)
    before = F.coalesce(F.sum(size.cast("long")).over(Window.partitionBy("c", "leaf").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turn = turn.withColumn("start", before + F.length("head")).withColumn("end", F.col("start") + F.length("body"))
    turns = F.array_sort(F.collect_list(F.struct((-F.col("above")).alias("at"), "head", "body", "start", "end", "loss")))
    whole = turn.groupBy("c", "leaf").agg(F.first("conv_id").alias("conv_id"), F.first("rank").alias("rank"), F.first("mean").alias("score"), turns.alias("turns"))
    return whole.select(
        "conv_id",
        F.col("leaf").alias("leaf_id"),
        "rank",
        "score",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["loss"].alias("loss"))).alias("spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    segments = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turn(segment: Column) -> Column:
        at = F.instr(segment, "\n")
        body = F.substring(segment, at + 1, F.length(segment) - at - len(END))
        return F.struct(unescape_role(F.substring(segment, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(segments, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, as an array in order.

    A span's place is counted from the end of the span before, so that each turn is looked at alone.
    """
    segments = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def masked(segment: Column, i: Column) -> Column:
        span = F.get(spans, i)
        begun = F.coalesce(F.get(spans, i - 1)["end"] + len(END), F.lit(0)) + len(START)
        inside = F.substring(segment, (span["start"] - begun + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
        return F.when(span["loss"], unescape(inside))

    return F.filter(F.transform(segments, masked), lambda x: x.isNotNull())
