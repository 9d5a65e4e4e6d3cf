"""Object graphs as tables: nodes (graph, node, ...) and edges (graph, src, dst, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.functions.session import Appended, cut


def _kind(df: DataFrame, *names: str) -> str:
    """The types of columns, for a schema."""
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(graph, node): nodes reachable from the roots (graph, node), themselves included. Each round follows the newest nodes' edges and writes those alone."""
    edges = cut(edges.select("graph", "src", "dst").distinct())
    seen = Appended(roots.sparkSession, _kind(roots, "graph", "node"))
    frontier = seen.add(roots.select("graph", "node").distinct())
    while not frontier.isEmpty():
        step = edges.join(frontier.withColumnRenamed("node", "src"), ["graph", "src"]).select("graph", F.col("dst").alias("node")).distinct()
        frontier = seen.add(step.join(seen.read(), ["graph", "node"], "left_anti"))
    return seen.read()


def orphans(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(graph, node): nodes that no root reaches."""
    return nodes.select("graph", "node").join(reachable(edges, roots), ["graph", "node"], "left_anti")


def tree_audit(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, node, problem): children whose declared parent (node.parent) isn't the one that lists them ("parent"), nodes that more than one
    lists ("shared"), nodes whose declared number of leaves (node.declared) is wrong ("count"), and nodes on or below a cycle ("cycle").

    Leaves are counted from the bottom up: each round hands the counts of finished nodes to their parents, so it takes as many rounds
    as the tree is deep, and what never finishes hangs on a cycle.
    """
    e = cut(edges.select("graph", "src", "dst").distinct())
    parent = nodes.join(e, (nodes["graph"] == e["graph"]) & (nodes["node"] == e["dst"])).filter(F.col("parent").isNull() | (F.col("parent") != F.col("src"))).select(nodes["graph"], "node", F.lit("parent").alias("problem"))
    shared = e.groupBy("graph", F.col("dst").alias("node")).agg(F.count("*").alias("n")).filter("n > 1").select("graph", "node", F.lit("shared").alias("problem"))
    kids = e.groupBy("graph", F.col("src").alias("node")).agg(F.count("*").alias("kids"))
    state = cut(nodes.join(kids, ["graph", "node"], "left").select("graph", "node", "declared", F.coalesce("kids", F.lit(0)).alias("kids")))
    names = _kind(nodes, "graph", "node")
    finished, counts = (Appended(nodes.sparkSession, f"{names}, leaves long") for _ in range(2))
    new = finished.add(state.filter("kids = 0").select("graph", "node", F.lit(1).cast("long").alias("leaves")))
    while not new.isEmpty():
        # each child counts for its parents once, so a parent is complete in the round of its last child and in no other
        up = e.join(new.withColumnRenamed("node", "dst"), ["graph", "dst"]).select("graph", F.col("src").alias("node"), "leaves")
        touched = counts.add(up).select("graph", "node").distinct()
        so_far = counts.read().join(touched, ["graph", "node"], "left_semi").groupBy("graph", "node").agg(F.count("*").alias("ready"), F.sum("leaves").alias("leaves"))
        new = finished.add(state.join(so_far, ["graph", "node"]).filter("ready = kids").select("graph", "node", "leaves"))
    done = finished.read()
    wrong = state.join(done, ["graph", "node"]).filter("kids > 0 and declared is not null and declared != leaves").select("graph", "node", F.lit("count").alias("problem"))
    cycle = state.join(done, ["graph", "node"], "left_anti").select("graph", "node", F.lit("cycle").alias("problem"))
    return parent.union(shared).union(wrong).union(cycle).distinct()


def dangling_refs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, src, dst, generation): references to a node, or a generation of it, that isn't there."""
    there = nodes.select("graph", F.col("node").alias("dst"), "generation")
    return edges.join(there, ["graph", "dst", "generation"], "left_anti").select("graph", "src", "dst", "generation")


def key_conflicts(entries: DataFrame, node: str, key: str, value: str) -> DataFrame:
    """(node, key, n_values): keys that one node holds with different values."""
    return entries.groupBy(node, key).agg(F.countDistinct(value).alias("n_values")).filter("n_values > 1")


def graph_role_hash(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, role_hash): the hash of the sorted role-to-role edges with their numbers, which node names don't change."""
    src = nodes.select("graph", F.col("node").alias("src"), F.col("role").alias("a"))
    dst = nodes.select("graph", F.col("node").alias("dst"), F.col("role").alias("b"))
    kinds = edges.join(src, ["graph", "src"]).join(dst, ["graph", "dst"]).groupBy("graph", "a", "b").agg(F.count("*").alias("n"))
    return kinds.groupBy("graph").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("a", F.lit(">"), "b", F.lit("x"), "n"))), ","), 256).alias("role_hash"))
