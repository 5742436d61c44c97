"""Reply trees as conversations: every root-to-leaf path is one branch, ranked by score and formatted.

Paths come from iterative self-joins by pointer doubling: round k knows every message's ancestor 2 ** k
replies up, so a tree of depth d takes log2(d) rounds, and the path rows double with them. Only ids are
joined; texts join the chosen paths once, at the end.

Template: an assistant message is ``<s>role\\ntext</s>``, any other ``[INST]role\\ntext[/INST]``. Inside
roles and texts a backslash goes into each of these four control strings after its first character (and
one more into a string that has some already), so none is left and taking one out gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bound, stored

CONTROL = r"(/?s>|/?INST\])"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    """``text`` without control strings."""
    return F.regexp_replace(text, F.lit(rf"([<\[])(\\*){CONTROL}"), F.lit(r"$1\\$2$3"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"([<\[])\\(\\*){CONTROL}"), F.lit("$1$2$3"))


def _role_line(role: Column) -> Column:
    """The role in one line: backslash and line end become two characters."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_of(line: Column) -> Column:
    parts = F.split(unescaped(line), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def branches(messages: DataFrame) -> DataFrame:
    """Rows (conv, leaf, message, depth, root) of all root-to-leaf paths of ``messages`` (conv, message, parent).

    A message without a parent, or whose parent is not there, is a root. Messages on a circle, and those
    that reply into one, have no root and are in no path. Repeated messages count once. A null
    conversation is one of its own; null messages are left out.
    """
    nodes = messages.where(F.col("message").isNotNull()).groupBy(F.struct("conv").alias("tree"), "message").agg(
        F.min("parent").alias("parent"),
    )
    there = nodes.select("tree", F.col("message").alias("parent"), F.lit(True).alias("known"))
    nodes = nodes.join(there, ["tree", "parent"], "left").select(
        "tree", "message", F.when(F.col("known"), F.col("parent")).alias("parent"),
    )
    nodes = stored(nodes, "replies")
    most = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parent = F.col("parent")
    state = nodes.select(
        "tree", "message", parent.alias("up"), parent.isNotNull().cast("long").alias("hops"),
        F.coalesce("parent", "message").alias("top"),
    )
    done, open_ = state.where("up is null"), state.where("up is not null")
    jumps = []
    for _ in range(most.bit_length() + 1):
        if open_.isEmpty():
            break
        jumps.append(open_.select("tree", "message", "up"))
        # only messages that have not met their root go on; what they jump to may have
        above = done.unionByName(open_).select(
            "tree", F.col("message").alias("up"), F.col("up").alias("next"), F.col("hops").alias("more"),
            F.col("top").alias("next_top"),
        )
        state = stored(open_.join(above, ["tree", "up"]).select(
            "tree", "message", F.col("next").alias("up"), (F.col("hops") + F.col("more")).alias("hops"),
            F.col("next_top").alias("top"),
        ), "reply-jumps")
        done, open_ = done.unionByName(state.where("up is null")), state.where("up is not null")
    rooted = done.select("tree", "message", F.col("top").alias("root"), "hops")
    replied = nodes.select("tree", F.col("parent").alias("message")).where(F.col("message").isNotNull()).distinct()
    leaves = rooted.join(replied, ["tree", "message"], "left_anti")
    paths = stored(
        leaves.select("tree", "root", F.col("message").alias("leaf"), "message", F.col("hops").alias("depth")), "reply-paths",
    )
    for k, jump in enumerate(jumps):
        higher = paths.where(F.col("depth") >= 2**k).join(jump, ["tree", "message"]).select(
            "tree", "root", "leaf", F.col("up").alias("message"), (F.col("depth") - 2**k).alias("depth"),
        )
        paths = paths.unionByName(stored(higher, "reply-paths"))
    return paths.select(F.col("tree.conv").alias("conv"), "root", "leaf", "message", "depth")


def conversations(messages: DataFrame, best: int | None = None) -> DataFrame:
    """Each chosen branch as one row: conv, root, leaf, score, branch_rank, formatted.

    ``messages``: conv, message, parent, role, text, score. A branch scores the mean of its messages
    (null counts as 0); branches of a root rank by score, ties by leaf. ``best`` keeps that many per root
    (a top-k report), None keeps all. Null roles and texts are empty.
    """
    content = messages.where(F.col("message").isNotNull()).groupBy(F.struct("conv").alias("tree"), "message").agg(
        F.min(F.struct(
            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
            F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        )).alias("m"),
    ).select("tree", "message", "m.role", "m.text", "m.score")
    paths = stored(branches(messages).withColumn("tree", F.struct("conv")).drop("conv"), "reply-branches")
    ranked = (
        paths.join(content.select("tree", "message", "score"), ["tree", "message"])
        .groupBy("tree", "root", "leaf").agg(F.avg("score").alias("score"))
        .withColumn("branch_rank", F.row_number().over(W.partitionBy("tree", "root").orderBy(F.desc("score"), "leaf")))
    )
    if best is not None:
        ranked = ranked.where(F.col("branch_rank") <= best)
    turn = F.struct("depth", "role", "text")
    rows = paths.join(ranked.select("tree", "root", "leaf"), ["tree", "root", "leaf"]).join(
        content.select("tree", "message", "role", "text"), ["tree", "message"],
    ).groupBy("tree", "root", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    text = F.array_join(F.transform("turns", _formatted_turn), "")
    return rows.join(ranked, ["tree", "root", "leaf"]).select(
        F.col("tree.conv").alias("conv"), "root", "leaf", "score", "branch_rank", text.alias("formatted"),
    )


def _formatted_turn(turn: Column) -> Column:
    inner = F.concat(_role_line(turn["role"]), F.lit("\n"), escaped(turn["text"]))
    return F.when(turn["role"] == ASSISTANT, F.concat(F.lit("<s>"), inner, F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST]"), inner, F.lit("[/INST]")),
    )


def read_back(formatted: str) -> Column:
    """The turns of a formatted conversation: array of (role, text, loss), the last true for trained text."""
    marked = F.regexp_extract_all(formatted, F.lit(r"(?s)(?:<s>|\[INST\]).*?(?:</s>|\[/INST\])"), F.lit(0))

    def turn(piece: Column) -> Column:
        loss = F.startswith(piece, F.lit("<s>"))
        skip = F.when(loss, 3).otherwise(6)
        inner = F.substring(piece, skip + 1, F.length(piece) - skip - F.when(loss, 4).otherwise(7))
        return bound(inner, lambda text: F.struct(
            _role_of(F.substring_index(text, "\n", 1)).alias("role"),
            unescaped(F.substring(text, F.locate("\n", text) + 1, F.length(text))).alias("text"), loss.alias("loss"),
        ))

    return F.transform(marked, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the ``formatted`` column back gives: counts and SHA-256 digests of turns and trained text."""
    turns = formatted.withColumn("turns", read_back("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return turns.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def linear(turns: DataFrame) -> DataFrame:
    """Messages of conversations given as numbered turns: each replies to the one before it (ties by role, text)."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.withColumn("message", F.row_number().over(order).cast("long")).select(
        F.col("conv_id").alias("conv"), "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"),
        "role", "text", F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"),
    )
