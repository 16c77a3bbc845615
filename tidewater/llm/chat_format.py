"""Chat formatting of reply trees, in DataFrame functions only.

Messages name the message they answer. Self-joins on pointers that double in length list, for every
leaf, the messages from it up to its root; branches are ranked by the sum of their messages' scores,
and each chosen path becomes one conversation text with a loss mask over the assistant's texts.

Template: each turn is ``### role: text</turn>`` and a line feed. Inside roles and texts a backslash is
written twice, ``###`` as ``\\h`` and ``</turn>`` as ``\\e``; in roles a colon as ``\\c``. So a control
string stands for itself only, and the texts can be read back.

Defined results: a null role or text is empty; a message whose parent is missing or null is a root;
messages in a cycle are in no path; equal scores are ranked by the leaf's identifier; a repeated
message (equal tree and node) counts once, the smallest row of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("###"), F.lit("\\h")), F.lit("</turn>"), F.lit("\\e"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescaped(text: Column, role: bool = False) -> Column:
    def plain(piece: Column) -> Column:
        out = F.replace(F.replace(piece, F.lit("\\h"), F.lit("###")), F.lit("\\e"), F.lit("</turn>"))
        return F.replace(out, F.lit("\\c"), F.lit(":")) if role else out

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def root_to_leaf(messages: DataFrame) -> DataFrame:
    """tree, leaf, node, up: each leaf's messages, ``up`` steps above it. messages: tree, node, parent."""
    nodes = stored(messages.select("tree", "node", "parent"), "chat-nodes")
    known = nodes.select(F.col("tree").alias("k_tree"), F.col("node").alias("k_node"))
    on = F.col("tree").eqNullSafe(F.col("k_tree")) & (F.col("parent") == F.col("k_node"))
    links = nodes.join(known, on, "left_semi").select("tree", "node", F.col("parent").alias("above"))
    jump = stored(links, "chat-jump")
    answered = jump.select(F.col("tree").alias("k_tree"), F.col("above").alias("k_node")).distinct()
    leaf_on = F.col("tree").eqNullSafe(F.col("k_tree")) & (F.col("node") == F.col("k_node"))
    paths = stored(nodes.join(answered, leaf_on, "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "chat-paths")
    step, most = 1, max(1, nodes.count())
    while step <= most and not jump.isEmpty():
        by = jump.select(F.col("tree").alias("k_tree"), F.col("node").alias("k_node"), F.col("above").alias("k_above"))
        longer = paths.join(by, leaf_on).select("tree", "leaf", F.col("k_above").alias("node"), (F.col("up") + step).alias("up"))
        paths = stored(paths.unionByName(longer), "chat-paths")
        twice = F.col("tree").eqNullSafe(F.col("k_tree")) & (F.col("above") == F.col("k_node"))
        jump = stored(jump.join(by, twice).select("tree", "node", F.col("k_above").alias("above")), "chat-jump")
        step *= 2
    return paths


def format_reply_trees(messages: DataFrame, best: int = 1, loss_role: str = "assistant") -> DataFrame:
    """tree, leaf, rank, formatted, loss_spans array<struct<start, length>> (code points, from 1) of the best paths.

    messages: tree, node, parent, role, text, score.
    """
    whole = F.struct("parent", "role", "text", "score")
    once = messages.groupBy("tree", "node").agg(F.min(whole).alias("m")).select("tree", "node", "m.*")
    once = stored(once, "chat-messages")
    paths = root_to_leaf(once).withColumnsRenamed({"tree": "p_tree", "node": "p_node"})
    on = F.col("p_tree").eqNullSafe(F.col("tree")) & (F.col("p_node") == F.col("node"))
    told = paths.join(once, on)
    head = F.concat(F.lit(OPEN), escaped(F.coalesce("role", F.lit("")), role=True), F.lit(SEP))
    turn = F.struct(
        (-F.col("up")).alias("at"),
        F.concat(head, escaped(F.coalesce("text", F.lit(""))), F.lit(CLOSE)).alias("text"),
        F.length(head).alias("head"),
        (F.coalesce("role", F.lit("")) == loss_role).alias("loss"),
    )
    branches = told.groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    ranked = branches.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf"))).filter(F.col("rank") <= best)
    lengths = F.transform("turns", lambda t: F.length(t["text"]))
    starts = F.transform(F.sequence(F.lit(1), F.size("turns")), lambda i: F.aggregate(F.slice(lengths, 1, i - 1), F.lit(0), lambda a, n: a + n))
    spans = F.filter(
        F.zip_with("turns", starts, lambda t, s: F.struct((s + t["head"] + 1).alias("start"), (F.length(t["text"]) - t["head"] - len(CLOSE)).alias("length"), t["loss"].alias("loss"))),
        lambda x: x["loss"],
    )
    return ranked.select("tree", "leaf", "rank", F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"), F.transform(spans, lambda x: F.struct(x["start"], x["length"])).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with the turns (role, text) of its text and the texts under its loss mask."""
    segments = F.slice(F.split("formatted", CLOSE), 1, F.greatest(F.size(F.split("formatted", CLOSE)) - 1, F.lit(0)))

    def turn(segment: Column) -> Column:
        role = F.substring_index(F.substring(segment, F.lit(len(OPEN) + 1), F.length(segment)), SEP, 1)
        return F.struct(unescaped(role, role=True).alias("role"), unescaped(F.substring(segment, F.length(role) + len(OPEN) + len(SEP) + 1, F.length(segment))).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"], s["length"])))
    return formatted.withColumn("turns", F.transform(segments, turn)).withColumn("loss_texts", masked)


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees: each turn answers the one before it; rows of equal turns follow by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def chat_report(conversations: DataFrame) -> DataFrame:
    out = read_back(format_reply_trees(conversation_messages(conversations)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
