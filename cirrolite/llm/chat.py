"""Reply trees to training conversations. DataFrame functions only.

Messages point to the message that they answer. Ancestors are found by self-joins that double the distance each round,
so a thread of d messages takes log2(d) rounds; only ids and scores travel in them, texts are joined once for
the chosen paths.

Defined results: a message whose parent is null, missing or itself is a root; a message that repeats an id of its tree counts
once (the one smallest by role and text); a null tree is a tree of its own; messages on a reply cycle, or below one, have no
path from a root and give no conversation. Null roles and texts are empty, null scores 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

OPEN, CLOSE = "<turn ", "</turn>\n"


def escaped(text: Column) -> Column:
    """Reversible, and free of `<` and `>`: no text can hold a control string of the template."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def reply_paths(messages: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent", score: str = "score", keep: int = 1) -> DataFrame:
    """(t, leaf, rank, path_score, node, depth): the messages of the `keep` root-to-leaf paths of each tree with the largest sum of scores.

    rank starts at 1; equal sums rank by leaf. depth counts down to 0 at the leaf.
    """
    nodes = messages.select(F.coalesce(F.concat(F.lit("v"), F.col(tree).cast("string")), F.lit("n")).alias("t"), F.col(node).alias("node"), F.col(parent).alias("parent"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("s"))
    nodes = written(nodes.filter("node is not null").groupBy("t", "node").agg(F.min("parent").alias("parent"), F.max("s").alias("s")))
    known = nodes.select("t", F.col("node").alias("anc"))
    jump = nodes.filter("parent <> node").withColumnRenamed("parent", "anc").join(known, ["t", "anc"], "left_semi")
    jump = written(nodes.select("t", "node", "s").join(jump.select("t", "node", "anc"), ["t", "node"], "left"))
    count = jump.count()
    done, jumps = jump.filter("anc is null"), [jump.filter("anc is not null")]
    while 2 ** (len(jumps) - 1) <= count and not jumps[-1].isEmpty():
        # only messages that have not reached their root go on
        far = done.unionByName(jumps[-1]).select("t", F.col("node").alias("anc"), F.col("anc").alias("next"), F.col("s").alias("more"))
        moved = written(jumps[-1].join(far, ["t", "anc"]).select("t", "node", (F.col("s") + F.col("more")).alias("s"), F.col("next").alias("anc")))
        done = done.unionByName(moved.filter("anc is null"))
        jumps.append(moved.filter("anc is not null"))
    answered = jumps[0].select("t", F.col("anc").alias("node")).distinct()
    leaves = done.join(answered, ["t", "node"], "left_anti")
    order = Window.partitionBy("t").orderBy(F.desc("s"), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
    paths = written(leaves.select("t", F.col("node").alias("leaf"), "rank", F.col("s").alias("path_score"), "node", F.lit(0).cast("bigint").alias("depth")))
    for k, jump in enumerate(jumps[:-1]):  # each round is written: the plan of the next one stays small
        step = jump.select("t", "node", "anc")
        new = paths.join(step, ["t", "node"]).select("t", "leaf", "rank", "path_score", F.col("anc").alias("node"), (F.col("depth") + 2**k).alias("depth"))
        paths = paths.unionByName(written(new))
    return paths


def format_conversations(messages: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent", score: str = "score", role: str = "role", text: str = "text", keep: int = 1, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per chosen path: tree, rank, path_score, n_turns, formatted, loss_spans.

    formatted: for each turn from the root `<turn ROLE>TEXT</turn>` and a newline, role and text escaped. loss_spans: (start, length) in
    code points of formatted, from 0, of the texts whose role is in `learn`.
    """
    paths = reply_paths(messages, tree, node, parent, score, keep)
    said = messages.select(F.coalesce(F.concat(F.lit("v"), F.col(tree).cast("string")), F.lit("n")).alias("t"), F.col(tree).alias("tree_id"), F.col(node).alias("node"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    said = said.groupBy("t", "tree_id", "node").agg(F.min(F.struct("role", "text")).alias("m"))
    turn = paths.join(said, ["t", "node"]).select(
        "t", "tree_id", "leaf", "rank", "path_score", (-F.col("depth")).alias("seq"),
        F.concat(F.lit(OPEN), escaped(F.col("m.role")), F.lit(">")).alias("head"), escaped(F.col("m.text")).alias("body"), F.col("m.role").isin(*learn).alias("learn"))
    turns = turn.groupBy("t", "tree_id", "leaf", "rank", "path_score").agg(F.array_sort(F.collect_list(F.struct("seq", "head", "body", "learn"))).alias("turns"))
    long = lambda c: F.length(c).cast("bigint")
    walk = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, x: F.struct(
            (a.at + long(x.head) + long(x.body) + len(CLOSE)).alias("at"),
            F.when(x.learn, F.concat(a.spans, F.array(F.struct((a.at + long(x.head)).alias("start"), long(x.body).alias("length"))))).otherwise(a.spans).alias("spans"),
        ),
        lambda a: a.spans,
    )
    return turns.select(
        F.col("tree_id").alias("tree"), "rank", "path_score", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: F.concat(x.head, x.body)), CLOSE).alias("joined"), walk.alias("loss_spans"),
    ).select("tree", "rank", "path_score", "n_turns", F.concat("joined", F.lit(CLOSE)).alias("formatted"), "loss_spans")


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and loss_text, both read back from formatted and loss_spans alone."""
    cell = lambda x: F.struct(
        unescaped(F.substring(x, F.lit(len(OPEN) + 1), F.instr(x, ">") - F.lit(len(OPEN) + 1))).alias("role"),
        unescaped(F.substring(x, F.instr(x, ">") + F.lit(1), F.length(x))).alias("text"),
    )
    pieces = F.split("formatted", CLOSE, -1)
    return formatted.withColumn("turns", F.transform(F.slice(pieces, 1, F.size(pieces) - 1), cell)).withColumn(
        "loss_text", F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", (s.start + 1).cast("int"), s.length.cast("int")))), "")
    )
