"""Chat formatting of reply trees with DataFrame operations only.

Messages point at the message they answer.  Ancestor lists are found by
iterative self-joins that double the reach each time (log2 of the depth joins,
not depth), so each leaf gets its root-to-leaf path.  Branches of a tree are
ranked by the sum of their messages' scores and the chosen paths are formatted,
one conversation each, with the spans that a loss mask covers.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Control strings
inside roles and texts are broken by a backslash after their first character and
backslashes are doubled, so formatting is reversible and no text can forge a turn.

Nulls: a null text or role is empty; a null score is 0.  A message whose parent
does not exist is a root.  Messages on or below a cycle have no path and yield
no conversation.  Tree and message ids compare null-safely; repeated message ids
in a tree are one message (the smallest by role, then text).  Ties in rank go to
the smallest leaf id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.storage import Scratch

#: Control strings of common chat templates that may not appear unescaped inside a text.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """tree, leaf, path (message ids from root to leaf) for each leaf of messages (tree, message, parent)."""
    ids = messages.select("tree", "message", "parent").dropDuplicates(["tree", "message"])
    known = ids.select(F.col("tree").alias("_t"), F.col("message").alias("_m"))
    up = ids.join(known, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_m")), "left").select(
        "tree", "message", F.col("_m").alias("up"), F.array("message").alias("path"), F.col("_m").isNotNull().alias("open")
    )
    up = scratch.save(up, "reach1")
    total, reach = None, 1
    while not up.where("open").isEmpty():
        if reach > 64:
            total = up.count() if total is None else total
            if reach > 2 * total:
                break
        above = up.select(F.col("tree").alias("_t"), F.col("message").alias("_m"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        done, todo = up.where("not open"), up.where("open")
        moved = todo.join(above, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("up") == F.col("_m"))).select(
            "tree", "message", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"), F.col("_up").isNotNull().alias("open")
        )
        after = scratch.save(done.unionByName(moved), "reach")
        scratch.drop(up)
        up, reach = after, reach * 2
    has_reply = ids.where("parent is not null").select(F.col("tree").alias("_t"), F.col("parent").alias("_p")).distinct()
    return up.where("not open").join(has_reply, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("message") == F.col("_p")), "left_anti").select("tree", F.col("message").alias("leaf"), "path")


def format_trees(messages: DataFrame, branches: int | None = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages (tree, message, parent, role, text, score) to one row per chosen branch.

    Result: tree, leaf, branch (rank from 1), score, n_turns, formatted, loss_spans (array of start, end in
    code points of ``formatted``, end exclusive).  ``branches`` best branches of each tree, or all if None.
    """
    s = Scratch(messages.sparkSession, "reply-trees")
    one = messages.withColumn("_n", F.row_number().over(Window.partitionBy("tree", "message").orderBy("role", "text"))).where("_n = 1").drop("_n")
    steps = paths(one, s).select("tree", "leaf", F.posexplode("path").alias("pos", "message"))
    texts = one.select(F.col("tree").alias("_t"), F.col("message").alias("_m"), "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    turns = steps.join(texts, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("message") == F.col("_m")))
    if branches is not None:
        ranks = turns.groupBy("tree", "leaf").agg(F.sum("score").alias("total"))
        ranks = ranks.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))).where(F.col("branch") <= branches)
        ranks = ranks.select(F.col("tree").alias("_rt"), F.col("leaf").alias("_rl"), "branch")
        turns = turns.join(ranks, F.col("tree").eqNullSafe(F.col("_rt")) & (F.col("leaf") == F.col("_rl")))
    else:
        turns = turns.withColumn("branch", F.lit(None).cast("int"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    piece = turns.select("tree", "leaf", "branch", "pos", "score", F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("loss"), head.alias("head"), body.alias("body"))
    upto = F.sum(F.length("head") + F.length("body") + len(END)).over(Window.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    piece = piece.withColumn("stop", upto - len(END))
    rows = piece.groupBy("tree", "leaf").agg(
        F.max("branch").alias("branch"), F.sum("score").alias("score"), F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("pos", F.concat("head", "body", F.lit(END)).alias("t"), (F.col("stop") - F.length("body")).alias("start"), F.col("stop").alias("end"), "loss"))).alias("p"),
    )
    return rows.select(
        "tree", "leaf", "branch", "score", "n_turns", F.array_join(F.col("p.t"), "").alias("formatted"),
        F.transform(F.filter("p", lambda x: x.loss), lambda x: F.struct(x.start.alias("start"), x.end.alias("end"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    def turn(t):
        raw = F.regexp_extract(t, r"(?s)^((?:[^\\\n]++|\\.)*+)\n", 1)
        return F.struct(unescape(raw).alias("role"), unescape(F.substring(t, F.length(raw) + 2, F.length(t) - F.length(raw) - 1 - len(END))).alias("text"))

    return F.transform(F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 1 << 30), turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")
