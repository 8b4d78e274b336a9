"""Chat formatting of reply trees: iterative self-joins find the root-to-leaf paths, the best branches become conversations. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize

#: The template's control strings: a turn is BEGIN + OPEN + role + CLOSE + text + END.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST] ", " [/INST]", "</s>"
_MARKED = r"([<\[])(&*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])&(&*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    """A text in which no control string is left: each gets one more & after its first character. Other texts stay as they are."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _MARKED, "$1&$2$3")


def unescape(text: Column) -> Column:
    """The text that escape() got."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def linear_tree(rows: DataFrame) -> DataFrame:
    """Conversations of numbered turns as reply trees: each row answers the row before it.

    Rows go by turn (null last), then role and text, so that ties and repeated rows have one order
    and each stays a turn of its own. Null conversation ids are one conversation.
    """
    key = [F.coalesce("conv_id", F.lit(0)).cast("long").alias("tree"), F.col("conv_id").isNull().alias("no_tree")]
    slim = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), *key)
    order = Window.partitionBy("tree", "no_tree").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    node = F.row_number().over(order).cast("long")
    return slim.withColumn("node", node).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Nodes of the best `branches` root-to-leaf paths of each tree: tree, no_tree, branch (from 1), node, depth (root: 0).

    messages: tree, no_tree, node, parent (null or unknown: a root), score (null: 0). A branch's score is the mean
    over its nodes; ties go to the longer branch, then to the smaller leaf. Self-joins double the distance
    that a row knows of its ancestors, so a chain of n nodes takes log2(n) joins keyed by node, never one
    task a tree; a node that knows its root takes part no longer. Nodes of a cycle have no root and are on no path.
    """
    key = ["tree", "no_tree"]
    own = messages.select(*key, "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = messages.select(*key, F.col("node").alias("parent"), F.lit(True).alias("known"))
    up = own.join(known, [*key, "parent"], "left").select(*key, "node", F.when(F.col("known"), F.col("parent")).alias("above"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("sum"))
    step, done, jumps = materialize(up, "jump"), [], []
    while True:
        done.append(step.where("above IS NULL"))
        active = step.where("above IS NOT NULL")
        if len(jumps) == 48 or active.isEmpty():
            break
        jumps.append(active)
        known = reduce(DataFrame.unionByName, [active, *done])
        high = known.select(*key, F.col("node").alias("above"), F.col("above").alias("next"), F.col("steps").alias("more"), F.col("sum").alias("plus"))
        joined = active.join(high, [*key, "above"])
        step = materialize(joined.select(*key, "node", F.col("next").alias("above"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("sum") + F.col("plus")).alias("sum")), "jump")
    leaves = reduce(DataFrame.unionByName, done)
    if jumps:
        leaves = leaves.join(jumps[0].select(*key, F.col("above").alias("node")), [*key, "node"], "left_anti")
    best = Window.partitionBy(*key).orderBy((F.col("sum") / F.col("steps")).desc(), F.col("steps").desc(), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    found = materialize(chosen.select(*key, "branch", "node", F.col("steps").alias("length"), F.lit(0).cast("long").alias("from_leaf")), "path")
    for k, jump in enumerate(jumps):
        further = found.join(jump.select(*key, "node", "above"), [*key, "node"]).where("above IS NOT NULL")
        further = further.select(*key, "branch", F.col("above").alias("node"), "length", (F.col("from_leaf") + (1 << k)).alias("from_leaf"))
        grown = materialize(found.unionByName(further), "path")
        discard(found)
        found = grown
    return found.select(*key, "branch", "node", (F.col("length") - 1 - F.col("from_leaf")).alias("depth"))


def format_paths(messages: DataFrame, chosen: DataFrame, trained: str = "assistant") -> DataFrame:
    """One conversation a path: tree, no_tree, branch, formatted, loss_turns and loss_spans.

    formatted is every turn's BEGIN, OPEN, role, CLOSE, text and END with control strings in role and text escaped.
    loss_turns has for each turn whether it is under the loss mask, loss_spans the (start, length) of those
    texts in code points of formatted.
    """
    key = ["tree", "no_tree", "branch"]
    piece = F.concat(F.lit(BEGIN + OPEN), escape(F.col("role")), F.lit(CLOSE), escape(F.col("text")), F.lit(END))
    before = Window.partitionBy(*key).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = (
        messages.join(chosen, ["tree", "no_tree", "node"])
        .withColumn("piece", piece)
        .withColumn("loss", F.col("role") == trained)
        .withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + len(BEGIN + OPEN + CLOSE) + F.length(escape(F.col("role"))))
    )
    ordered = F.array_sort(F.collect_list(F.struct("depth", "piece", "loss", "start", F.length(escape(F.col("text"))).alias("length"))))
    return (
        turns.groupBy(*key)
        .agg(ordered.alias("t"))
        .select(
            *key,
            F.array_join("t.piece", "").alias("formatted"),
            F.col("t.loss").alias("loss_turns"),
            F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
        )
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, unescaped: array of (role, text)."""
    pieces = F.split(formatted, END)
    head = F.lit(len(BEGIN + OPEN))

    def turn(x: Column) -> Column:
        at = F.locate(CLOSE, x)
        return F.struct(unescape(F.substring(x, head + 1, at - head - 1)).alias("role"), unescape(F.substring(x, at + len(CLOSE), F.length(x))).alias("text"))

    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def format_conversations(rows: DataFrame) -> DataFrame:
    """Conversations of numbered turns, formatted: conv_id, formatted, loss_turns, loss_spans. Null texts and roles are empty."""
    messages = materialize(linear_tree(rows), "turns")
    out = format_paths(messages, paths(messages))
    return out.select(F.when(~F.col("no_tree"), F.col("tree")).alias("conv_id"), "formatted", "loss_turns", "loss_spans")


def digests(formatted: DataFrame) -> DataFrame:
    """What op3 returns, read back from formatted conversations: turns from the text, what is taught from the text under the loss mask."""
    back = formatted.withColumn("turns", parse(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    taught = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    return back.withColumn("taught", taught).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("taught").cast("long").alias("loss_chars"),
        F.sha2("taught", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS bigint) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS LAST, role, text)) AS loss_sha256,
  cast(sum(22 + length(regexp_replace(role, '([<\[])(&*)(/?s>|/?INST\])', '\1&\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(&*)(/?s>|/?INST\])', '\1&\2\3', 'g'))) AS bigint) AS formatted_chars
FROM rows GROUP BY conv_id
"""
