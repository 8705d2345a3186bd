"""Problem 3: lines that a site repeats across its chapters.

Method: the lines of a source are the nodes of a graph, weighted by the number of rows that hold
them; two lines of which one follows the other in a text, with nothing between, are joined by
an edge, weighted alike. Nodes and edges of high support are kept, connected components, single nodes among
them, are the boilerplate blocks, and every occurrence of a block's line is deleted.

One pass over the texts makes an array of 128-bit keys per row, which is checkpointed; all else reads
keys. An edge has no more support than either of its nodes, so edges are counted only
between occurrences of kept nodes. Lines meet the kept nodes in a join on (source, line) that
holds hot lines apart (``session.join_hot``), so that neither a source nor a line gathers in one task.

Two lines are the same when their letters (with marks) are the same, ignoring case.
A kept node stands in at least ``min_share`` of its source's rows, so a source keeps at
most (mean distinct lines per row) / ``min_share`` nodes: grouping the kept nodes and edges
by source is bounded whatever the number of rows.

Defined results: null and empty texts count among the rows of their source and hold
no line; rows of a null source form a source of their own; lines without a
letter are never found and part the lines round them; repeated rows each count. Ids are unique.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.session import cut, fits, join_hot, table

MIN_ROWS, MIN_SHARE = 5, 0.04
_NODE = ["_source", "a", "b"]


def _line_keys(text):
    """128-bit key of each line of a text column, null where the line has no letter."""
    letters = F.transform(F.split(text, "\n", -1), lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{M}]+", "")))
    return F.transform(letters, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(7)).alias("b"))))


def _source(source_col: str):
    return F.when(F.col(source_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source_col))).alias("_source")


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one source: rows without a partner are nodes, rows with one are edges."""
    parent: dict[tuple, tuple] = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    nodes = pdf[pdf["a2"].isna()]
    own = list(zip(nodes["a"], nodes["b"]))
    parent.update((x, x) for x in own)
    edges = pdf[pdf["a2"].notna()]
    for a, b, a2, b2 in zip(edges["a"], edges["b"], edges["a2"], edges["b2"]):
        x, y = find((a, b)), find((int(a2), int(b2)))  # partners travel as text
        parent[max(x, y)] = min(x, y)
    return pd.DataFrame({"_source": nodes["_source"], "a": nodes["a"], "b": nodes["b"], "block": [find(x)[0] for x in own], "support": nodes["support"]})


class Graph:
    """The kept lines of every source.

    nodes: _source, a, b, support; edges: the same with a2, b2; blocks: _source, a, b, block, support;
    lines: id, _source, line_no, a, b of every occurrence of a kept line. All checkpointed.
    """

    def __init__(self, df: DataFrame, id_col: str = "row_id", text_col: str = "text", source_col: str = "source", min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> None:
        keyed = cut(df.select(F.col(id_col).alias("_id"), _source(source_col), _line_keys(F.col(text_col)).alias("_keys")))
        needed = keyed.groupBy("_source").agg(F.greatest(F.lit(min_rows), F.ceil(F.count(F.lit(1)) * F.lit(min_share) - F.lit(1e-9))).alias("needed"))
        needed = cut(needed.withColumn("rows", F.col("needed")))

        def supported(rows: DataFrame, keys: list[str]) -> DataFrame:
            counted = rows.groupBy("_source", *keys).agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_rows)
            return cut(join_hot(counted, needed, ["_source"], "rows").where("support >= needed").drop("needed"))

        self.nodes = supported(keyed.select("_source", F.explode_outer(F.array_distinct("_keys")).alias("k")).where("k IS NOT NULL").select("_source", "k.a", "k.b"), ["a", "b"])
        at = F.transform("_keys", lambda k, i: F.struct((i + 1).cast("int").alias("line_no"), k.a.alias("a"), k.b.alias("b"), F.get("_keys", i + 1).alias("next")))
        lines = keyed.select("_id", "_source", F.explode_outer(at).alias("x")).where("x.a IS NOT NULL").select("_id", "_source", "x.line_no", "x.a", "x.b", "x.next")
        self.lines = cut(join_hot(lines, self.nodes, _NODE, "support"))
        ends = self.nodes.select("_source", F.col("a").alias("a2"), F.col("b").alias("b2"), "support")
        follows = self.lines.where("next IS NOT NULL").select("_id", *_NODE, F.col("next.a").alias("a2"), F.col("next.b").alias("b2")).distinct()
        self.edges = supported(join_hot(follows, ends, ["_source", "a2", "b2"], "support"), ["a", "b", "a2", "b2"])
        none = F.lit(None).cast("bigint")
        graph = self.nodes.select(*_NODE, none.alias("a2"), none.alias("b2"), "support").unionByName(self.edges)
        # Keys are wider than what pandas keeps exactly beside nulls, so partners travel as text.
        graph = graph.withColumns({c: F.col(c).cast("string") for c in ("a2", "b2")})
        self.blocks = cut(graph.groupBy("_source").applyInPandas(_components, "_source string, a bigint, b bigint, block bigint, support bigint"))
        self.id_col = id_col

    def found(self) -> DataFrame:
        """id, line_no, block of every occurrence of a line of a block."""
        rows = join_hot(self.lines.drop("next"), self.blocks, _NODE, "support")
        return rows.select(F.col("_id").alias(self.id_col), "line_no", "block")


def boilerplate_blocks(df: DataFrame, *args, **kw) -> DataFrame:
    """Kept lines: _source, a, b (the line's key), block, support."""
    return Graph(df, *args, **kw).blocks


def boilerplate_lines(df: DataFrame, *args, **kw) -> DataFrame:
    """id, line_no (from 1), block of every line to delete."""
    return Graph(df, *args, **kw).found()


def remove_boilerplate(df: DataFrame, id_col: str = "row_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """Every row with ``clean``, its text without the found lines, and ``removed``, their number; null stays null.

    Where the blocks are few enough to be broadcast, the texts stay where they are; else each text is sent to its lines' numbers.
    """
    graph = Graph(df, id_col, text_col, source_col, **kw)
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"), _source(source_col))
    lines = F.split("_text", "\n", -1)
    held = graph.blocks.groupBy("_source").agg(F.collect_set(F.struct("a", "b")).alias("held"))
    if fits(graph.blocks):
        joined = rows.join(F.broadcast(held), "_source", "left").withColumn("_keys", _line_keys(F.col("_text")))
        kept = F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains("held", F.element_at("_keys", i + 1)), F.lit(False)))
    else:
        numbers = graph.found().groupBy(id_col).agg(F.collect_set("line_no").alias("_numbers"))
        joined = rows.join(numbers, id_col, "left")
        kept = F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains("_numbers", (i + 1).cast("int")), F.lit(False)))
    return joined.select(id_col, F.array_join(kept, "\n").alias("clean"), (F.size(lines) - F.size(kept)).alias("removed"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate_lines(table(spark, sf_dir, "chapters", "row_id", "source", "text")).select("row_id", "line_no")


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(table(spark, sf_dir, "chapters", "row_id", "source", "text"))


def p3_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each source with their number of lines and the support of the strongest."""
    blocks = boilerplate_blocks(table(spark, sf_dir, "chapters", "row_id", "source", "text"))
    source = F.when(F.substring("_source", 1, 1) == "1", F.expr("substring(_source, 2)")).alias("source")
    return blocks.groupBy(source, "block").agg(F.count(F.lit(1)).alias("n_lines"), F.max("support").alias("max_support"))


QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean, "p3_blocks": p3_blocks}
SQL = {
    "p3_found": r"""
WITH c AS (SELECT row_id, coalesce('1' || source, '0') AS src, string_split(text, chr(10)) AS ls FROM chapters),
l AS (SELECT row_id, src, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) AS INTEGER) AS line_no FROM c),
k AS (SELECT row_id, src, line_no, lower(regexp_replace(line, '[^\p{L}\p{M}]+', '', 'g')) AS letters FROM l),
n AS (SELECT src, count(*) AS total FROM c GROUP BY src),
d AS (SELECT src, letters, count(DISTINCT row_id) AS support FROM k WHERE letters <> '' GROUP BY src, letters)
SELECT DISTINCT k.row_id, k.line_no FROM k JOIN d ON k.src = d.src AND k.letters = d.letters JOIN n ON n.src = k.src
WHERE d.support >= 5 AND d.support >= 0.04 * n.total""",
}
