"""Chat formatting: reply trees, their root-to-leaf paths by iterative self-joins, and a reversible template with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stage

#: What a text may not show to a tokenizer, with the form it takes there (a backslash after its first character).
CONTROLS = ["<|", "|>", "</s>", "<s>", "[INST]", "[/INST]"]
#: A conversation is START, then for each turn "<|", role, HEAD_END, text, TURN_END.
START, HEAD_END, TURN_END = "<s>", "|>\n", "</s>\n"


def escape(text: Column) -> Column:
    """Null is empty. Backslashes are doubled first, so unescape() brings back every text."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees: tree, leaf, node, height (replies from node down to leaf), for the top paths of each tree.

    nodes: tree, node (long, unique), parent (null or unknown: a root), score (null: 0). Paths rank by the mean score of
    their nodes, then by leaf. Self-joins double the reach of parent links (1, 2, 4, ... replies) and carry the scores on
    the way, until every node has reached its root; leaves are ranked by that, and only the chosen ones then walk up by
    the links, in falling order, so a path has a row for each of its nodes and a tree of depth d takes log2(d) rounds.
    Nodes on a cycle, and those whose replies lead into one, reach no root and are left out. Nothing is gathered per tree."""
    nodes = stage(nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "nodes")
    up = nodes.join(nodes.select(F.col("node").alias("up")), nodes["parent"] == F.col("up"), "left")
    walks = [stage(up.select("node", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("n")), "walk")]
    most = max(1, nodes.count()).bit_length()
    while not walks[-1].where("up IS NOT NULL").isEmpty() and len(walks) <= most:
        last = walks[-1]
        on = last.where("up IS NOT NULL").select("node", "up", "total", "n")
        far = last.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("total").alias("more"), F.col("n").alias("m"))
        on = on.join(far, "up").select("node", F.col("far").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("n") + F.col("m")).alias("n"))
        walks.append(stage(on.unionByName(last.where("up IS NULL")), "walk"))
    rooted = walks[-1].where("up IS NULL").select("node", (F.col("total") / F.col("n")).alias("mean"))
    parents = walks[0].where("up IS NOT NULL").select(F.col("up").alias("node"))
    leaves = nodes.select("tree", "node").join(parents, "node", "left_anti").join(rooted, "node")
    if top == 1:
        chosen = leaves.groupBy("tree").agg(F.min_by("node", F.struct(-F.col("mean"), F.col("node"))).alias("leaf"))
    else:
        order = Window.partitionBy("tree").orderBy(F.desc("mean"), "node")
        chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("tree", F.col("node").alias("leaf"))
    paths = stage(chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).alias("height")), "paths")
    for k in reversed(range(len(walks) - 1)):
        jump = walks[k].where("up IS NOT NULL" if not k else f"up IS NOT NULL AND n = {1 << k}").select("node", "up")
        higher = paths.join(jump, "node").select("tree", "leaf", F.col("up").alias("node"), (F.col("height") + F.lit(1 << k)).alias("height"))
        paths = stage(paths.unionByName(higher), "paths")
    return paths


def format_paths(paths: DataFrame, nodes: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One conversation per path: tree, leaf, formatted, mask (array of start from 0 and length, in code points, of learn_role's texts).

    nodes: node, role, text. A null role or text is empty; an empty learned text has no place in the mask."""
    turns = paths.join(nodes.select("node", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("body")), "node")
    turns = turns.withColumn("head", F.concat(F.lit("<|"), "role", F.lit(HEAD_END)))
    before = Window.partitionBy("leaf").orderBy(F.desc("height")).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.length("head") + F.length("body") + len(TURN_END)
    turns = turns.withColumn("start", F.coalesce(F.sum(whole).over(before), F.lit(0)) + len(START) + F.length("head"))
    learned = (F.col("role") == learn_role) & (F.col("body") != "")
    held = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct(
        "start", F.concat("head", "body", F.lit(TURN_END)).alias("turn"), F.length("body").alias("length"), learned.alias("learned")
    ))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].cast("int").alias("start"), t["length"].alias("length")))
    return held.select("tree", "leaf", F.concat(F.lit(START), F.array_join(F.transform("turns", lambda t: t["turn"]), "")).alias("formatted"), spans.alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    turns = F.split(F.substring(formatted, len(START) + 1, 2**31 - 1), TURN_END, -1)
    turns = F.slice(turns, 1, F.size(turns) - 1)
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substring(F.substring_index(t, HEAD_END, 1), 3, 2**31 - 1)).alias("role"),
        unescape(t.substr(F.length(F.substring_index(t, HEAD_END, 1)) + len(HEAD_END) + 1, F.length(t))).alias("text"),
    ))


def learned_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(formatted.substr(m["start"] + 1, m["length"]))), "")


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Linear conversations as reply trees in which every turn answers the one before: conv_id, formatted, mask.

    Order within a conversation: turn (null first), then role, then text; repeated rows all stay. A null conv_id is a
    conversation. Other columns of df are left out. An empty table gives no conversation."""
    rows = df.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    nodes = stage(rows.withColumn("node", F.monotonically_increasing_id()), "turns")
    before = Window.partitionBy("tree").orderBy("turn", "role", "text", "node")
    linked = nodes.withColumn("parent", F.lag("node").over(before)).withColumn("score", F.lit(0.0))
    found = format_paths(reply_paths(linked), nodes)
    return found.select(F.col("tree").alias(conv_col), "formatted", "mask")


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    shared_dir(spark)
    extra = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = format_conversations(rows.unionByName(extra))
    turns = found.withColumn("turns", read_turns(F.col("formatted"))).withColumn("learned", learned_text(F.col("formatted"), F.col("mask")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS o1, text AS o2 FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(ESC_ROLE) + length(ESC_TEXT) + 10 AS chars FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, o1 NULLS FIRST, o2 NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, o1 NULLS FIRST, o2 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) + 3 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _escaped_sql(column: str) -> str:
    out = rf"replace({column}, '\', '\\')"
    for control in CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


OP8_SQL = OP8_SQL.replace("ESC_ROLE", _escaped_sql("role")).replace("ESC_TEXT", _escaped_sql("text"))
