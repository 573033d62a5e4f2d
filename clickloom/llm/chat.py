"""Chat formatting of reply trees: root-to-leaf paths by iterative self-joins, ranked by score, one text per path.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts, ``<|`` gets a backslash between its
two characters (after any that are there), so no control string can arise from content and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch, query, table

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<$1\\|")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\\\|", "<$1|")


def escape_role(x: Column) -> Column:
    """As ``escape``; a new line, which ends a role, is written as a backslash and n."""
    return escape(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(x: Column) -> Column:
    parts = F.split(unescape(x), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def reply_paths(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, leaf, node, up) for every node on the way from each leaf to its root, ``up`` steps above the leaf.

    ``nodes(tree, node, parent)``, ids unique in their tree; a parent that is null or missing makes a root. The jump
    table doubles its reach in every round (node -> ancestor 2**k above), and each round extends all paths by as much,
    so a path of d turns takes log2(d) self-joins. Nodes on a cycle have no leaf and give no path; a leaf whose way
    leads into a cycle has no root, and its path ends where it would enter the cycle's second round.
    """
    own = nodes.select("tree", "node")
    jump = scratch.write(
        nodes.where("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("to"))
        .join(own.select("tree", F.col("node").alias("to")), ["tree", "to"])
        .select("tree", "node", "to")
    )
    parents = jump.select("tree", F.col("to").alias("node")).distinct()
    paths = scratch.write(
        own.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up"))
    )
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach <= most and jump.limit(1).count():
        further = paths.join(jump, ["tree", "node"]).select(
            "tree", "leaf", F.col("to").alias("node"), (F.col("up") + reach).alias("up")
        )
        longer = scratch.write(paths.union(further))
        twice = scratch.write(
            jump.join(jump.select("tree", F.col("node").alias("to"), F.col("to").alias("next")), ["tree", "to"])
            .select("tree", "node", F.col("next").alias("to"))
        )
        scratch.drop(paths, jump)
        paths, jump, reach = longer, twice, 2 * reach
    return paths.groupBy("tree", "leaf", "node").agg(F.min("up").alias("up"))


def best_paths(nodes: DataFrame, scratch: Scratch, best: int | None = 1) -> DataFrame:
    """The ``best`` paths of each tree (all, if None) with their rank: mean score of the nodes, ties to the smaller leaf.

    ``nodes`` also has ``score``; a null score counts as 0.
    """
    paths = scratch.write(reply_paths(nodes, scratch).join(nodes.select("tree", "node", "score"), ["tree", "node"]))
    ranked = paths.groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"))
    order = Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf")
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    return paths.select("tree", "leaf", "node", "up").join(scratch.write(ranked), ["tree", "leaf"])


def format_paths(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, loss): one text per chosen path, and the spans (code points, end exclusive) that
    training looks at: the assistant's texts.

    ``nodes(tree, node, parent, score, role, text)``; null roles and texts are empty. An empty table gives no rows.
    """
    scratch = Scratch(nodes.sparkSession, "chat")
    nodes = scratch.write(nodes.select("tree", "node", "parent", F.col("score").cast("double").alias("score"), "role", "text"))
    chosen = best_paths(nodes, scratch, best)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = chosen.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree", "leaf", "rank", (-F.col("up")).alias("at"), F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"),
        F.concat(escape(text), F.lit("")).alias("body"), (role == "assistant").alias("learn"),
    )
    turn = F.struct("at", "head", "body", "learn")
    lined = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(END))), "")
    n_end = len(END)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        start = state.getField("at") + F.length(t.head)
        end = start + F.length(t.body)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + n_end).alias("at"),
            F.when(t.learn, F.concat(state.spans, span)).otherwise(state.spans).alias("spans"),
        )

    return lined.select(
        "tree", "leaf", "rank", whole.alias("formatted"), F.aggregate("turns", zero, add, lambda s: s.spans).alias("loss")
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(x: Column) -> Column:
        cut = F.locate("\n", x)
        return F.struct(
            unescape_role(F.substring(x, F.lit(len(START) + 1), cut - len(START) - 1)).alias("role"),
            unescape(F.substring(x, cut + 1, F.length(x))).alias("text"),
        )

    return F.transform(pieces, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    part = lambda s: unescape(F.substring(formatted, s.start + 1, s.end - s.start))
    return F.array_join(F.transform(loss, part), "")


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """Turns as a reply chain: each row answers the row before it (by turn, ties by role and text; nulls first)."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    return rows.withColumn("node", F.row_number().over(order)).withColumn(
        "parent", F.when(F.col("node") > 1, F.col("node") - 1)
    ).withColumn("score", F.length("text"))


@query("op10_chat")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("tree"), "conv_id", "turn", "role", "text"
    )
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    extra = spark.range(2).select(
        F.lit("extra").alias("tree"), F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    out = format_paths(conversation_nodes(rows.union(extra)), best=1)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    conv = F.when(F.col("tree") == "extra", F.lit(-1).cast("long")).otherwise(F.expr("try_cast(tree AS BIGINT)"))
    return out.select(
        conv.alias("conv_id"), read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss")).alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars",
    )
