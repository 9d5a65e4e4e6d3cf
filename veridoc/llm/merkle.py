"""Merkle manifest of a dataset with a proof for every row, by pointer jumping.

Rows are the leaves of one tree for each partition; the partitions' roots are the leaves of one more tree. Leaves
are numbered in order without a task that sees a whole tree: ranges are sorted alone and offset by those before.
Trees grow LEVELS levels at a time: 2**LEVELS neighbours are one small group, whatever the size of the tree.

Each node then holds the sibling on its way to its parent. A round joins the nodes with themselves: a node whose
segment ends at an ancestor takes over that ancestor's segment, so the distance doubles and the segments are put
together, until every leaf's segment ends at the root. Only nodes at multiples of the distance are asked again, so
a round moves the leaves and hardly more. A segment is the hashes of the siblings from below, 32 bytes each; which
levels lack a sibling, and on which side the others stand, follows from the leaf's number and the tree's size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.llm.common import cut, fresh

#: Levels that one group of neighbours grows at once.
LEVELS = 8
#: Every TAMPERED-th row by its id's CRC is checked in a changed form.
TAMPERED = 7


def framed(col: Column) -> Column:
    """A value as its UTF-8 bytes' number, a colon and itself; null as a hyphen."""
    text = col.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(cols: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(framed, cols)), 256))


def as_hex(h: Column) -> Column:
    return F.lower(F.hex(h))


def _parent(left: Column, right: Column) -> Column:
    """The hash of a run of one or two nodes, whose digests enter as lowercase hex; no second one: null or empty."""
    return F.unhex(F.sha2(F.concat(as_hex(left), F.coalesce(as_hex(right), F.lit(""))), 256))


def numbered(leaves: DataFrame, tree: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(`leaves` with `idx`, (tree, n)): each leaf's number in its tree by `order`, from 0, and the trees' sizes. Both are tables.

    Ranges of (tree, order) are sorted and written, which fixes each row's place; the place less the first of the
    tree in its range, and the tree's leaves in the ranges before, give the number.
    """
    at, part, first, before, size = fresh(leaves, "at", "part", "first", "before", "size")
    by = [tree, *order]
    placed = cut(leaves.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()))
    parts = placed.withColumn(part, F.shiftright(at, 33)).groupBy(tree, part).agg(F.min(at).alias(first), F.count("*").alias(size))
    above = F.coalesce(F.sum(size).over(Window.partitionBy(tree).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = cut(parts.withColumn(before, above))  # a row for each range and each further tree in it
    sizes = parts.groupBy(tree).agg(F.sum(size).alias("n"))
    of = parts.select(F.col(tree).alias(f"{tree}_"), F.col(part).alias(f"{part}_"), first, before)
    out = placed.join(of, (placed[tree] == of[f"{tree}_"]) & (F.shiftright(placed[at], 33) == of[f"{part}_"]))
    return out.select(*leaves.columns, (F.col(at) - F.col(first) + F.col(before)).alias("idx")), sizes


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree of n: the least d with 2**d >= n."""
    return F.length(F.bin(n - 1)) - F.when(n == 1, 1).otherwise(0)


def _grown(group: Column, levels: int) -> Column:
    """The levels above a group of neighbours, its own first: an array of arrays."""
    def up(nodes: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, 1))
        return F.transform(pairs, lambda i: _parent(F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1)))

    rounds = F.sequence(F.lit(1), F.lit(levels))
    return F.aggregate(rounds, F.array(group), lambda made, _: F.concat(made, F.array(up(F.element_at(made, -1)))))


def nodes(leaves: DataFrame, sizes: DataFrame, tree: str) -> tuple[DataFrame, DataFrame, int]:
    """((tree, level, idx, seg), (tree, root), depth): all nodes but the roots with their sibling's hash, empty where there is none, each tree's root, and the levels of the tallest.

    `leaves` has (tree, idx, h), `sizes` (tree, n). A tree of one leaf has no nodes; the leaf is its root.
    """
    now = leaves.select(tree, "idx", "h")
    depths = sizes.select(tree, _depth(F.col("n")).alias("depth"))
    deepest = depths.agg(F.max("depth")).head()[0] or 0
    made, roots, base = [], [], 0
    while True:
        left = depths.select(tree, (F.col("depth") - base).alias("left"))
        tops = now.join(left.filter("left = 0").select(tree), tree).select(tree, F.col("h").alias("root"))
        roots.append(tops)
        if base >= deepest:
            break
        members = F.transform(F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda x: x["h"])
        groups = now.withColumn("g", F.shiftright("idx", LEVELS)).groupBy(tree, "g").agg(members.alias("own")).join(left.filter("left > 0"), tree)
        # a tree that ends within these levels ends where one node is left
        grown = cut(groups.select(tree, "g", F.least("left", F.lit(LEVELS)).alias("many"), _grown(F.col("own"), LEVELS).alias("levels")))
        pair = F.col("nodes")
        up = grown.select(tree, "g", "many", F.posexplode("levels").alias("level", "nodes")).filter("level < many")
        up = up.select(tree, "g", "level", pair, F.posexplode("nodes").alias("i", "own"))
        sibling = F.coalesce(F.get(pair, F.col("i").bitwiseXOR(F.lit(1))), F.lit(b""))
        made.append(up.select(tree, (F.col("level") + base).alias("level"), (F.expr(f"shiftleft(g, {LEVELS} - level)") + F.col("i")).alias("idx"), sibling.alias("seg")))
        now = grown.select(tree, F.col("g").alias("idx_"), F.get(F.expr("levels[many]"), F.lit(0)).alias("h"), "many")
        base += LEVELS
        # trees that have ended keep their root in this round's table
        roots.append(now.filter(F.col("many") < LEVELS).select(tree, F.col("h").alias("root")))
        now = now.filter(F.col("many") == LEVELS).select(tree, F.col("idx_").alias("idx"), "h")
    every = made[0] if made else now.select(tree, F.lit(0).alias("level"), "idx", F.col("h").alias("seg")).limit(0)
    for more in made[1:]:
        every = every.union(more)
    top = roots[0]
    for more in roots[1:]:
        top = top.union(more)
    return every, top, deepest


def proofs(every: DataFrame, tree: str, deepest: int) -> DataFrame:
    """(tree, idx, seg): for each leaf the hashes of its siblings from below to the root, by pointer jumping over `nodes`."""
    state, reach = cut(every), 1
    while reach < deepest:
        asks = state.filter(F.col("level") % (2 * reach) == 0)
        told = state.filter(F.col("level") % (2 * reach) == reach)
        told = told.select(F.col(tree).alias("t"), (F.col("level") - reach).alias("l"), F.col("idx").alias("i"), F.col("seg").alias("more"))
        meets = (asks[tree] == told["t"]) & (asks["level"] == told["l"]) & (F.shiftright(asks["idx"], reach) == told["i"])
        state = cut(asks.join(told, meets, "left").select(tree, "level", "idx", F.concat("seg", F.coalesce("more", F.lit(b""))).alias("seg")))
        reach *= 2
    return state.filter("level = 0").select(tree, "idx", "seg")


def folded(leaf: Column, idx: Column, n: Column, seg: Column) -> Column:
    """The root that a leaf and its siblings give."""
    start = F.struct(leaf.alias("h"), idx.cast("long").alias("i"), (n - 1).cast("long").alias("last"), F.lit(1).alias("at"))

    def step(s: Column, _: Column) -> Column:
        sibling = F.substring(seg, s["at"], F.lit(32))
        odd = F.pmod(s["i"], F.lit(2)) == 1
        alone = ~odd & (s["i"] == s["last"])
        up = F.when(alone, _parent(s["h"], F.lit(None).cast("binary"))).when(odd, _parent(sibling, s["h"])).otherwise(_parent(s["h"], sibling))
        half = F.shiftright(s["i"], 1), F.shiftright(s["last"], 1)
        return F.struct(up.alias("h"), half[0].alias("i"), half[1].alias("last"), (s["at"] + F.when(alone, 0).otherwise(32)).alias("at"))

    levels = F.when(n > 1, F.sequence(F.lit(1), _depth(n))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, start, step, lambda s: s["h"])


def manifest(docs: DataFrame, *, columns: Sequence[str], id_col: str, tree_col: str, checked: Sequence[Column] | None = None) -> DataFrame:
    """One row for each row of `docs`: its id, its place, its proof, and whether the proof leads from the row to the root.

    (doc_id, tree, idx, n, leaf, subroot, root, proof, top_idx, top_n, top_proof, folded_root, verified): hashes and
    proofs are binary, a proof being the siblings' hashes from below. `columns` are hashed; `checked` are the columns as
    they are found when the proofs are checked, as a rule the same. Leaves of a tree ascend by id, null first, equal ids
    by their hash; rows that repeat are leaves of their own. Trees ascend by the UTF-8 bytes of their name, null first.
    An empty table gives no rows.
    """
    name = F.col(tree_col).cast("string")
    key = F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name))  # joins as a value, and stands first for null
    own = [F.col(c) for c in columns]
    found = own if checked is None else list(checked)
    changed = ~reduce(and_, (a.eqNullSafe(b) for a, b in zip(own, found, strict=True)))
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), key.alias("tree"), leaf_hash(own).alias("h"), F.when(changed, leaf_hash(found)).alias("seen")))
    leaves, sizes = numbered(rows, "tree", ["doc_id", "h"])
    leaves, sizes = cut(leaves), cut(sizes)
    every, roots, deepest = nodes(leaves, sizes, "tree")
    proof = proofs(every, "tree", deepest) if deepest else None

    # the top tree: the trees' roots in order
    tops, _ = numbered(roots.select(F.lit(0).alias("all"), "tree", F.col("root").alias("h")), "all", ["tree"])
    tops = cut(tops)
    top_sizes = cut(tops.groupBy("all").agg(F.count("*").alias("n")))
    upper, top, height = nodes(tops, top_sizes, "all")
    above = tops.join(top_sizes.withColumnRenamed("n", "top_n"), "all").join(top, "all").select("all", "tree", F.col("idx").alias("top_idx"), "top_n", F.col("h").alias("subroot"), "root")
    none = F.lit(b"")
    if height:
        above = above.join(proofs(upper, "all", height).select("all", F.col("idx").alias("top_idx"), F.col("seg").alias("top_proof")), ["all", "top_idx"])
    else:
        above = above.withColumn("top_proof", none)
    above = cut(above.join(sizes, "tree").drop("all"))  # a row for each tree

    out = leaves.join(proof, ["tree", "idx"], "left") if proof is not None else leaves.withColumn("seg", none)
    out = out.join(above, "tree")
    out = out.withColumn("proof", F.coalesce("seg", none))
    out = out.withColumn("folded_root", folded(folded(F.coalesce("seen", "h"), F.col("idx"), F.col("n"), F.col("proof")), F.col("top_idx"), F.col("top_n"), F.col("top_proof")))
    tree = F.when(F.col("tree") == "", F.lit(None)).otherwise(F.substring("tree", 2, 1 << 30))
    return out.select("doc_id", tree.alias("tree"), "idx", "n", F.col("h").alias("leaf"), "subroot", "root", "proof", "top_idx", "top_n", "top_proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: What is hashed of a document, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def checked_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of `documents`, in which one row of TAMPERED, chosen by the CRC of its id, is found with n_chars one too high."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    seen = [F.when(tampered, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in FIELDS]
    rows = manifest(docs, columns=FIELDS, id_col="doc_id", tree_col="lang", checked=seen)
    proof = F.sha2(as_hex(F.concat("proof", "top_proof")), 256)
    return rows.select("doc_id", *[as_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], proof.alias("proof_sha256"), as_hex(F.col("folded_root")).alias("folded_root"), "verified")
