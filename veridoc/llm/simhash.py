"""SimHash near-duplicates: a binary trie of fingerprints joined with itself.

Fingerprints are seen as paths of a binary trie. A pair of nodes is walked through together, bit by bit:
its children are the pairs of their children, a pair carries the bits that differ so far, and goes as soon
as they exceed the budget. A node of a sorted array of fingerprints is a range of it, so a level of the
walk is a few array operations over all its node pairs. The walk's top levels depend on the differing bits
alone, so they are done once; each node below them is a group that Spark deals out, with the fingerprints
of the nodes that the budget lets it meet, and is walked to the leaves in one task.

`simhash_groups` links fingerprints of 64 bits within a budget. `similar_groups` links texts by
similarity: a wide fingerprint is cut into words, each with a trie of its own; two texts of the wanted
similarity come within the budget in one of the words at least with a probability that `WORD_BITS`,
`WORD_BUDGET` and the number of words set, and what the tries find is held against the bits of the whole
fingerprint and then against the exact similarity. What chance leaves out is looked for exactly after that:
with shingles in order of rising frequency, two texts of the similarity share one among the first few of
each, so texts of different components that do are compared too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.llm.common import cut, small_batches, whole

SHINGLE, SEED, BUDGET = 3, 42, 2
#: Fingerprints below a node that is dealt out, about, and levels walked before dealing at least, with one trie and with one for each word.
NODE_ROWS, LEAST_DEPTH, WORD_DEPTH = 1 << 16, 5, 3
#: Fingerprints dealt to a node from which its part is dealt again further down, levels further down, and ways to differ up to which that goes on.
CELL_ROWS, DEEPER, MOST_WAYS = 1 << 19, 4, 4096
#: Node pairs of a step of the walk at once, and pairs of fingerprints below a node pair from which it is walked on.
STEP_PAIRS, LEAF_PAIRS = 1 << 17, 64
#: The stage's rule: words of a shingle, and the least Jaccard similarity as a fraction.
SIMILAR_SHINGLE, SIMILAR = 5, (4, 5)
#: A wide fingerprint has this many words, each joined in a trie of its own within the budget.
WORDS, WORD_BITS, WORD_BUDGET = 24, 32, 2
#: Bits that may differ in the two words after the one that met, and in the whole fingerprint. A similarity of 0.8 leaves
#: 0.152 of the bits apart on average, 9.7 and 116; the rest is room for chance (2.2 and 2 standard deviations).
NEXT_BUDGET, WIDE_BUDGET = 16, 136
#: A link with at most so many bits apart in the three words is a strong one.
STRONG = 10
#: Rows of a cell with one word from which they are put together around leaders, and the bits that a member is apart from its leader at most.
CROWD, RADIUS = 64, STRONG // 2
#: Pairs of two clusters' members compared at once.
CLUSTER_PAIRS = 1 << 22
#: Texts from which a shingle counts as a common one, and how many of the commonest are told. They decide in which order a text's shingles are looked up, not which pairs are found.
COMMON_TEXTS, COMMON = 8, 1 << 18
#: Shingles counted and rows met at once.
COUNT_SLAB, MEET_ROWS = 1 << 20, 1 << 18

_OFFSET = np.arange(8 * WORDS, dtype=np.int64) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def shingle_hashes(text: bytes, shingle: int, seed: int = SEED) -> np.ndarray:
    """The XXH64 of each shingle, in order, repeats included.

    Words are what ASCII white space parts, after A-Z are lowered. Fewer words than a shingle: the whole
    sequence is the shingle. No word: none.
    """
    words = text.lower().split()
    if len(words) < shingle:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))


def majority(h: np.ndarray) -> bytes:
    """The bits that are set in over half the rows of `h`, numbers of 64 bits; no row: all zero."""
    ones = np.zeros(64 * h.shape[1])
    for at in range(0, len(h), 8192):
        part = np.ascontiguousarray(h[at : at + 8192]).astype(">u8").view(np.uint8).reshape(-1, 8 * h.shape[1])
        if len(part) < 48:
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        else:  # counts of byte values are fewer than bits
            n = part.shape[1]
            counts = np.bincount((part + _OFFSET[:n]).ravel(), minlength=256 * n).reshape(n, 256)
            ones += (counts.astype(np.float64) @ _BITS).ravel()
    return np.packbits(2 * ones > len(h)).tobytes()


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of one text as an unsigned number of 64 bits; 0 where it has no word."""
    return int.from_bytes(majority(shingle_hashes(text, shingle, seed)[:, None]), "big")


def spread(h: np.ndarray, words: int) -> np.ndarray:
    """For each hash as many others of 64 bits as asked for."""
    z = h[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def wide(hashes: np.ndarray) -> bytes:
    """The SimHash of one text's shingles with WORDS words of WORD_BITS bits."""
    return majority(spread(hashes, WORDS * WORD_BITS // 64))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long): one row for each row of `docs`; fp holds the 64 bits."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


class Trie:
    """A binary trie over sorted fingerprints of `bits` bits: a node is a range of them."""

    def __init__(self, sorted_fps: np.ndarray, bits: int):
        self.fps, self.bits, self._ones = sorted_fps, bits, {}

    def split(self, level: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the second children of the nodes begin: below them, the bit at `level` is 0 before and 1 from there."""
        if level not in self._ones:
            bit = (self.fps >> np.uint64(self.bits - 1 - level)) & np.uint64(1)
            self._ones[level] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        ones = self._ones[level]
        return high - (ones[high] - ones[low])


def walk(a: Trie, b: Trie, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bits apart): places in `a` and `b` of all fingerprints within the budget. `b` may be `a`: then each pair once, i < j."""
    start = [np.array([x], np.int64) for x in (0, len(a.fps), 0, len(b.fps), 0)]
    stack = [(0, start)] if len(a.fps) and len(b.fps) else []
    while stack:
        level, (a0, a1, b0, b1, apart) = stack.pop()
        few = (a1 - a0) * (b1 - b0) <= LEAF_PAIRS if level < a.bits else np.ones(len(a0), bool)
        if few.any():
            yield from _leaves(a, b, budget, *(x[few] for x in (a0, a1, b0, b1)))
            a0, a1, b0, b1, apart = (x[~few] for x in (a0, a1, b0, b1, apart))
        if not len(a0):
            continue
        am, bm = a.split(level, a0, a1), b.split(level, b0, b1)
        same = (a0 == b0) & (a1 == b1) if a is b else np.zeros(len(a0), bool)
        children = [(a0, am, b0, bm, apart), (am, a1, bm, b1, apart), (a0, am, bm, b1, apart + 1)]
        other = ~same  # of a node with itself, one of the two mixed pairs is enough
        children.append((am[other], a1[other], b0[other], bm[other], apart[other] + 1))
        made = [np.concatenate(x) for x in zip(*children, strict=True)]
        keep = (made[0] < made[1]) & (made[2] < made[3]) & (made[4] <= budget)
        made = [x[keep] for x in made]
        stack += [(level + 1, [x[at : at + STEP_PAIRS] for x in made]) for at in range(0, len(made[0]), STEP_PAIRS)]


def _leaves(a: Trie, b: Trie, budget: int, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of fingerprints below node pairs, a bounded number at a time."""
    rows = a1 - a0
    of = np.repeat(np.arange(len(rows)), rows)
    i = a0[of] + np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)
    low, many = b0[of], (b1 - b0)[of]
    while len(i):
        some = max(1, int(np.searchsorted(np.cumsum(many), 16 * STEP_PAIRS, "right")))
        n = many[:some]
        left = np.repeat(i[:some], n)
        right = np.repeat(low[:some] - (np.cumsum(n) - n), n) + np.arange(len(left))
        apart = np.bitwise_count(a.fps[left] ^ b.fps[right])
        keep = apart <= budget
        if a is b:
            keep &= left < right
        if keep.any():
            yield left[keep], right[keep], apart[keep].astype(np.int64)
        i, low, many = i[some:], low[some:], many[some:]


def _masks(depth: int, budget: int) -> list[int]:
    """The top levels of the walk: the bits by which two nodes at `depth` may differ, as masks, 0 left out."""
    pairs = [(0, 0)]
    for _ in range(depth):
        pairs = [(mask << 1 | bit, apart + bit) for mask, apart in pairs for bit in (0, 1) if apart + bit <= budget]
    return [mask for mask, _ in pairs if mask]


CELL = "cell long, other boolean, word long, next long, node long"


def _dealt(batch: tuple[np.ndarray, np.ndarray, np.ndarray, int], bits: int, depth: int, budget: int) -> pa.RecordBatch:
    """The fingerprints (word, next, node) of one trie, each in its own node's cell and those of the smaller nodes it can meet."""
    word, after, node, trie = batch
    own = (word >> np.uint64(bits - depth)).astype(np.int64)
    cells, at = [own], [np.arange(len(word))]
    for mask in _masks(depth, budget):
        larger = np.flatnonzero(own & (1 << mask.bit_length() - 1))  # the first bit that differs is set in the larger one
        cells.append(own[larger] ^ mask)
        at.append(larger)
    cell, at = np.concatenate(cells) | trie << depth, np.concatenate(at)
    other = np.arange(len(at)) >= len(word)
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(other), *(pa.array(x.view(np.int64)[at]) for x in (word, after, node))], names=["cell", "other", "word", "next", "node"])


def _depth(n: int, bits: int, least: int) -> int:
    return min(bits, max(least, (-(-n // NODE_ROWS)).bit_length()))


def _sides(cell: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, next, node) of the cell's own fingerprints and of the others, by word."""
    other, word, after, node = (cell.column(c).to_numpy() for c in ("other", "word", "next", "node"))
    out = []
    for side in (~other, other):
        order = np.argsort(word[side].view(np.uint64), kind="stable")
        out.append((word[side].view(np.uint64)[order], after[side].view(np.uint64)[order], node[side][order]))
    return out


def _crowded(fps: DataFrame, depth: int, budget: int, most: int) -> DataFrame:
    """(cell): the nodes at `depth` that would be dealt more than `most` fingerprints, from a count of each node's own."""
    own = fps.groupBy(F.expr(f"shiftrightunsigned(fp, {64 - depth})").alias("at")).agg(F.count("*").alias("n"))
    cells = F.lit(None).cast("array<long>")
    if masks := _masks(depth, budget):
        each = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(1 << m.bit_length() - 1).cast("long").alias("top")) for m in masks])
        cells = F.transform(F.filter(each, lambda x: F.col("at").bitwiseAND(x["top"]) != 0), lambda x: F.col("at").bitwiseXOR(x["m"]))
    dealt = own.select(F.explode(F.concat(F.array("at"), F.coalesce(cells, F.array().cast("array<long>")))).alias("cell"), "n").groupBy("cell").agg(F.sum("n").alias("n"))
    # a node without fingerprints of its own meets nobody
    return cut(dealt.join(own.select(F.col("at").alias("cell")), "cell", "left_semi").filter(F.col("n") > most).select("cell"))


def near_pairs(fps: DataFrame, *, budget: int = BUDGET, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(fa, fb): every pair of the distinct fingerprints `fps(fp)` with 1 to `budget` differing bits, once.

    A node that more than `cell_rows` fingerprints would be dealt to isn't walked as one group: its part of the trie is
    dealt again DEEPER levels further down, so crowds of near fingerprints are split over as many tasks as they need. That
    ends at the level where two nodes could differ in MOST_WAYS ways: with a budget of 2 below any crowd, with 4 at level 17.
    """

    def meet(cell: pa.Table) -> pa.Table:
        (own, _, a), (others, _, b) = _sides(cell)
        tries = Trie(own, 64), Trie(others, 64)
        found = [(a[i], to[j]) for t, to in ((tries[0], a), (tries[1], b)) for i, j, _ in walk(tries[0], t, budget)]
        return pa.table({"fa": np.concatenate([x for x, _ in found] or [a[:0]]), "fb": np.concatenate([x for _, x in found] or [a[:0]])})

    def dealer(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fp = b.column(0).to_numpy()
                yield _dealt((fp.view(np.uint64), np.zeros(len(fp), np.uint64), fp, 0), 64, depth, budget)

        return deal

    depth, above, out = _depth(fps.count(), 64, LEAST_DEPTH), None, []
    while True:
        dealt = fps.select("fp").mapInArrow(dealer(depth), CELL)
        if above is not None:  # what the walk of the crowded nodes comes down to
            dealt = dealt.withColumn("above", F.shiftright("cell", DEEPER)).join(above.withColumnRenamed("cell", "above"), "above", "left_semi").drop("above")
        below = depth + DEEPER
        go_on = below < 60 and sum(comb(below, k) for k in range(1, budget + 1)) <= MOST_WAYS
        crowded = _crowded(fps, depth, budget, cell_rows) if go_on else None
        if crowded is not None and above is not None:
            crowded = cut(crowded.withColumn("above", F.shiftright("cell", DEEPER)).join(above.withColumnRenamed("cell", "above"), "above", "left_semi").select("cell"))
        last = crowded is None or crowded.isEmpty()
        out.append((dealt if last else dealt.join(crowded, "cell", "left_anti")).groupBy("cell").applyInArrow(meet, "fa long, fb long"))
        if last:
            return reduce(DataFrame.union, out)
        depth, above = below, crowded


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of `links(fa, fb)` the smallest node that it can reach.

    Each round takes for a node the smallest parent of a neighbour's or its own parent, hands it on to the
    parent, and so follows pointers of doubling length; parents only fall, so it ends. The number of rounds
    grows with the logarithm of the longest path. Each round's state is kept in the shared folder. New values
    come out of aggregations alone: least() of columns would make Catalyst carry a constraint from round to round.
    """
    both = cut(links.select("fa", "fb").union(links.select("fb", "fa")).toDF("u", "v"))
    state = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.explode(F.array("u", "v")).alias("f")).groupBy("node").agg(F.min("f").alias("f")))
    none = F.lit(None).cast("long").alias("f")
    while True:
        grand = state.join(state.select(F.col("node").alias("f"), F.col("f").alias("g")), "f").select("node", "f", "g")
        heard = both.join(grand.select(F.col("node").alias("v"), "g"), "v").select(F.col("u").alias("node"), none, "g")
        near = cut(grand.union(heard).groupBy("node").agg(F.max("f").alias("f"), F.min("g").alias("g")))
        hooks = near.select("node", "f", "g").union(near.select(F.col("f").alias("node"), none, "g"))
        after = cut(hooks.groupBy("node").agg(F.max("f").alias("old"), F.min("g").alias("f")))
        state = after.select("node", "f")
        if after.filter("f < old").isEmpty():
            return state.withColumnRenamed("f", "root")


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, fp, component_id, n_links): a row for each row of `docs`.

    `component_id` is the smallest id reachable over links of at most `budget` bits, the document's own
    included; `n_links` counts the other fingerprints linked to its own. Documents with one fingerprint
    are linked, texts without words (fingerprint 0) like any other. Null ids never win as smallest and
    rows that repeat stay; an empty table gives no rows. The work of the walk grows with the number of ways
    in which `budget` of the first log2(fingerprints) bits can differ.
    """
    marked = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    own = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = cut(near_pairs(own.select("fp"), budget=budget, cell_rows=cell_rows))
    degree = links.select("fa").union(links.select("fb")).groupBy(F.col("fa").alias("fp")).agg(F.count("*").alias("n_links"))
    tree = components(links)
    linked = tree.join(own, tree["node"] == own["fp"]).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("reach"))
    linked = linked.join(least, "root").join(degree, "fp").select("fp", "reach", "n_links")
    every = cut(own.join(linked, "fp", "left").select("fp", F.coalesce("reach", "least").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    return marked.join(every, "fp").select("doc_id", "fp", "component_id", "n_links")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class Forest:
    """Links of a cell of which each joins two sets that weren't joined; labels are brought up to date now and then."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def _root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def apart(self, x: int, y: int) -> bool:
        return self._root(x) != self._root(y)

    def add(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of these links, taken in order, join something."""
        while not np.array_equal(flat := self.up[self.up], self.up):
            self.up = flat
        new = np.zeros(len(i), bool)
        for k in np.flatnonzero(self.up[i] != self.up[j]).tolist():
            x, y = self._root(int(i[k])), self._root(int(j[k]))
            if x != y:
                self.up[max(x, y)] = min(x, y)
                new[k] = True
        return new


def _leaders(word: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each row, sorted by word, the row that leads it: of rows with one word, crowded ones join the first that is within RADIUS."""
    lead = np.arange(len(word))
    begin = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1, [len(word)]])
    for k in np.flatnonzero(np.diff(begin) > CROWD).tolist():
        left = np.arange(begin[k], begin[k + 1])
        while len(left):
            near = np.bitwise_count(after[left] ^ after[left[0]]) <= RADIUS
            lead[left[near]] = left[0]
            left = left[~near]
    return lead


class Clusters:
    """One side of a cell: its rows by word, and the leaders among them."""

    def __init__(self, word: np.ndarray, after: np.ndarray, node: np.ndarray):
        self.after, self.node, self.lead = after, node, _leaders(word, after)
        self.leaders, sizes = np.unique(self.lead, return_counts=True)
        self.by_lead, self.ends = np.argsort(self.lead, kind="stable"), np.cumsum(sizes)
        self.sizes, self.trie = sizes, Trie(word[self.leaders], WORD_BITS)

    def members(self, k: int) -> np.ndarray:
        """The rows of the k-th leader."""
        return self.by_lead[self.ends[k] - self.sizes[k] : self.ends[k]]


def _nearest(a: Clusters, i: int, b: Clusters, j: int) -> tuple[int, int, int]:
    """(bits apart in the words after, row, row): the nearest members of two clusters."""
    x, y = a.members(i), b.members(j)
    best = (1 << 30, -1, -1)
    step = max(1, CLUSTER_PAIRS // len(y))
    for at in range(0, len(x), step):
        apart = np.bitwise_count(a.after[x[at : at + step], None] ^ b.after[y])
        k = int(apart.argmin())
        best = min(best, (int(apart.flat[k]), int(x[at + k // len(y)]), int(y[k % len(y)])))
    return best


def _meet_words(cell: pa.Table) -> pa.Table:
    """(fa, fb): of the fingerprints that meet in the cell and are near in the words after, links that join all that are joined.

    A crowd of copies gives as many links as it has members, and takes as many comparisons as it has members and
    leaders: a member is near its leader, so two clusters are compared member by member only where their leaders'
    distance leaves it open whether a link joins them, and nothing has joined them yet. Strong links are chosen for
    themselves, so that no weak one stands for them.
    """
    sides = _sides(cell)
    nodes, place = np.unique(np.concatenate([sides[0][2], sides[1][2]]), return_inverse=True)
    of = place[: len(sides[0][2])], place[len(sides[0][2]) :]
    any_link, strong_link, found = Forest(len(nodes)), Forest(len(nodes)), []

    def add(x: np.ndarray, y: np.ndarray, strong: np.ndarray) -> None:
        joins = any_link.add(x, y)
        joins[strong] |= strong_link.add(x[strong], y[strong])
        found.append((nodes[np.minimum(x, y)[joins]], nodes[np.maximum(x, y)[joins]]))

    own, others = (Clusters(word, after, at) for (word, after, _), at in zip(sides, of, strict=True))
    for side in (own, others):
        led = np.flatnonzero(side.lead != np.arange(len(side.lead)))
        add(side.node[side.lead[led]], side.node[led], np.ones(len(led), bool))
    for side in (own, others):
        for i, j, apart in walk(own.trie, side.trie, WORD_BUDGET):
            x, y = own.leaders[i], side.leaders[j]
            more = np.bitwise_count(own.after[x] ^ side.after[y]).astype(np.int64)
            keep = np.flatnonzero(more <= NEXT_BUDGET)
            keep = keep[np.argsort((apart + more)[keep], kind="stable")]
            add(own.node[x[keep]], side.node[y[keep]], (apart + more)[keep] <= STRONG)
            slack = RADIUS * ((own.sizes[i] > 1).astype(np.int64) + (side.sizes[j] > 1))
            for k in np.flatnonzero((slack > 0) & (more <= NEXT_BUDGET + slack)).tolist():
                a, b = int(own.node[x[k]]), int(side.node[y[k]])
                open_ = any_link.apart(a, b), apart[k] + more[k] <= STRONG + slack[k] and strong_link.apart(a, b)
                if any(open_):
                    bits, p, q = _nearest(own, int(i[k]), side, int(j[k]))
                    if bits <= NEXT_BUDGET:
                        add(own.node[[p]], side.node[[q]], np.array([apart[k] + bits <= STRONG]))
    return pa.table({c: np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k, c in enumerate(("fa", "fb"))})


WORD = "trie int, word long, next long, node long"


def word_links(own: DataFrame) -> DataFrame:
    """(fa, fb): links between the `own(node, fp)` that meet in the trie of some word, as `_meet_words` chooses them, once.

    Fingerprints that are alike in a word and the two after it are one class: each is linked to the class's least node,
    and only that one is dealt to the trie. So a page with a million near copies is a few rows in each cell.
    """
    depth = _depth(own.count(), WORD_BITS, WORD_DEPTH)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column(0).to_numpy()
            words = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u4").reshape(-1, WORDS).astype(np.uint64)
            after = np.roll(words, -1, axis=1) << np.uint64(32) | np.roll(words, -2, axis=1)
            trie = np.tile(np.arange(WORDS, dtype=np.int32), len(node))
            yield pa.RecordBatch.from_arrays([pa.array(trie), pa.array(words.ravel().view(np.int64)), pa.array(after.ravel().view(np.int64)), pa.array(np.repeat(node, WORDS))], names=["trie", "word", "next", "node"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trie, word, after, node = (b.column(c).to_numpy() for c in range(4))
            for k in np.unique(trie).tolist():
                at = trie == k
                yield _dealt((word[at].view(np.uint64), after[at].view(np.uint64), node[at], k), WORD_BITS, depth, WORD_BUDGET)

    key = ["trie", "word", "next"]
    rows = own.select("node", "fp").mapInArrow(words, WORD)
    classes = cut(rows.groupBy(*key).agg(F.min("node").alias("node"), F.count("*").alias("n")))
    alike = classes.filter("n > 1").select(*key, F.col("node").alias("fa"))
    stars = rows.join(alike, key).filter("fa != node").select("fa", F.col("node").alias("fb"))
    met = classes.select(*key, "node").mapInArrow(deal, CELL).groupBy("cell").applyInArrow(_meet_words, "fa long, fb long")
    return stars.union(met).distinct()


def _apart(links: DataFrame, own: DataFrame, budget: int) -> DataFrame:
    """(fa, fb, apart): the links whose whole fingerprints differ in at most `budget` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(len(b), -1) for k in (2, 3))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32)
            keep = pa.array(apart <= budget)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(apart)], names=["fa", "fb", "apart"]).filter(keep)

    fp = own.select("node", "fp")
    return links.join(fp.toDF("fa", "x"), "fa").join(fp.toDF("fb", "y"), "fb").select("fa", "fb", "x", "y").mapInArrow(run, "fa long, fb long, apart int")


def _verified(links: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(fa, fb): the links whose `sets(node, hashes)` have the Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared * sum(similar) >= similar[0] * (len(x) + len(y)))
            yield b.select(["fa", "fb"]).filter(pa.array(keep, pa.bool_()))

    both = links.join(sets.toDF("fa", "x"), "fa").join(sets.toDF("fb", "y"), "fb").select("fa", "fb", "x", "y")
    return both.mapInArrow(run, "fa long, fb long")


def shingle_set(text: bytes, shingle: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(digest as a long, distinct shingles in order of their hash, all shingles)."""
    every = shingle_hashes(text, shingle)
    own = np.unique(every)
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64)), own, every


def _sets(rows: DataFrame, own: DataFrame, links: DataFrame, shingle: int, had: DataFrame | None = None) -> DataFrame:
    """(node, hashes): the distinct shingles of the nodes in `links` that aren't in `had`, from one text each."""
    met = links.select("fa").union(links.select("fb")).distinct().toDF("node")
    if had is not None:
        met = met.join(had.select("node"), "node", "left_anti")
    need = cut(own.join(met, "node", "left_semi").select("h", "node"))  # a table, so that few nodes are known to be few
    texts = rows.join(need, "h").select("node", "text").dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t.as_py(), shingle)[1].tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes binary")


def _across(links: DataFrame, tree: DataFrame | None) -> DataFrame:
    """`links` with the roots of both ends; those within one component go."""
    if tree is None:
        return links.withColumn("ra", F.col("fa")).withColumn("rb", F.col("fb"))
    out = links.join(tree.toDF("fa", "ra"), "fa", "left").join(tree.toDF("fb", "rb"), "fb", "left")
    return out.withColumn("ra", F.coalesce("ra", "fa")).withColumn("rb", F.coalesce("rb", "fb")).filter("ra != rb")


def _texts_once(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(digest, shingles): the different sets of a task's texts."""
    seen = set()
    for b in batches:
        for t in b.column(0):
            node, own, _ = shingle_set(t.as_py(), shingle)
            if node not in seen:
                seen.add(node)
                yield node, own


def _key(h: np.ndarray, parts: int) -> np.ndarray:
    """What a shingle is counted by: the upper half of its hash and its part, the lowest bits."""
    return h >> np.uint64(32) << np.uint64(parts.bit_length() - 1) | h & np.uint64(parts - 1)


def common_shingles(rows: DataFrame, *, shingle: int, parts: int, least: int = COMMON_TEXTS, most: int = COMMON) -> np.ndarray:
    """Keys of the commonest shingles of `rows(text)`, `most` of them at most, that stand in `least` texts or more, rarer ones first."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            h = np.concatenate(held)
            part = (h & np.uint64(parts - 1)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            some, begin = np.unique(part[order], return_index=True)
            upper = (h[order] >> np.uint64(32)).astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array(some), pa.array([x.tobytes() for x in np.split(upper, begin[1:])], pa.binary())], names=["part", "upper"])

        held, n = [], 0
        for _, own in _texts_once(batches, shingle):
            held.append(own)
            n += len(own)
            if n >= COUNT_SLAB:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def count(part: pa.Table) -> pa.Table:
        upper, n = np.unique(np.frombuffer(b"".join(part.column("upper").to_pylist()), np.uint32), return_counts=True)
        often = n >= least
        key = upper[often].astype(np.uint64) << np.uint64(32) | np.uint64(part.column("part")[0].as_py())
        return pa.table({"key": _key(key, parts).view(np.int64), "n": n[often]})

    counts = cut(rows.select("text").mapInArrow(keys, "part int, upper binary").groupBy("part").applyInArrow(count, "key long, n long"))
    told = 0
    for bits, n in sorted(map(tuple, counts.groupBy(F.length(F.bin("n"))).count().collect()), reverse=True):
        told += n
        if told > most:  # whole levels of commonness, as many as there is room for
            counts = counts.filter(F.col("n") >= 1 << bits)
            break
    top = counts.toArrow()
    return top.column("key").to_numpy().view(np.uint64)[np.lexsort((top.column("key").to_numpy(), top.column("n").to_numpy()))]


PREFIX = "s long, node long, size int, at int"


def _prefixes(rows: DataFrame, common: np.ndarray, *, shingle: int, parts: int, similar: tuple[int, int]) -> DataFrame:
    """PREFIX: the first shingles of each text of `rows(text)`, rare ones before common ones, as many as a similar text could lack and one more."""
    num, both = similar[0], sum(similar)
    order = np.argsort(common)
    keys, rank = common[order], order + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for node, own in _texts_once(batches, shingle):
            first = own
            if len(keys):
                key = _key(own, parts)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                first = own[np.argsort(np.where(keys[at] == key, rank[at], 0), kind="stable")]
            first = first[: len(own) * (both - 2 * num) // (both - num) + 1]
            held.append((first, np.full(len(first), node), np.full(len(first), len(own)), np.arange(len(first))))
            n += len(first)
            if n >= MEET_ROWS:
                yield _prefix_batch(held)
                held, n = [], 0
        if n:
            yield _prefix_batch(held)

    return rows.select("text").mapInArrow(run, PREFIX)


def _prefix_batch(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    s, node, size, at = (np.concatenate(x) for x in zip(*held, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(node), pa.array(size.astype(np.int32)), pa.array(at.astype(np.int32))], names=["s", "node", "size", "at"])


def _several(rows: DataFrame, what: str) -> DataFrame:
    """The `rows` of the shingles that have different values of a column."""
    same = Window.partitionBy("s")
    return rows.withColumn("low", F.min(what).over(same)).withColumn("high", F.max(what).over(same)).filter("low != high").drop("low", "high")


def _meet_prefixes(s: np.ndarray, node: np.ndarray, size: np.ndarray, at: np.ndarray, root: np.ndarray, similar: tuple[int, int]) -> Iterator[tuple[np.ndarray, ...]]:
    """(fa, fb, ra, rb, room): the pairs of nodes that have a shingle in common, different roots, and enough shingles from this one on to be similar.

    Rows with the most frequent root of a shingle are only met by those with others, so one large component takes no pairs of its own.
    """
    num, both = similar[0], sum(similar)
    order = np.lexsort((size, s))
    s, node, size, at, root = (x[order] for x in (s, node, size, at, root))
    group = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
    by_root = np.lexsort((root, group))
    new = np.concatenate([[True], (np.diff(group[by_root]) != 0) | (np.diff(root[by_root]) != 0)])
    begin = np.flatnonzero(new)
    many = np.diff(np.append(begin, len(s)))
    by_size = np.lexsort((many, group[by_root[begin]]))
    last = by_size[np.append(np.diff(group[by_root[begin]][by_size]) != 0, True)]
    main = np.zeros(len(begin), bool)
    main[last] = True
    inside = np.zeros(len(s), bool)
    inside[by_root] = main[np.cumsum(new) - 1]

    place = group << 32 | size
    i = np.flatnonzero(~inside)
    low = np.searchsorted(place, group[i] << 32 | -(-num * size[i] // (both - num)))
    high = np.searchsorted(place, group[i] << 32 | np.maximum(both * (size[i] - at[i]) // num - size[i], 0), "right")
    n = np.maximum(high - low, 0)
    while len(i):
        some = max(1, int(np.searchsorted(np.cumsum(n), CLUSTER_PAIRS, "right")))
        k = n[:some]
        x = np.repeat(i[:some], k)
        y = np.repeat(low[:some] - (np.cumsum(k) - k), k) + np.arange(len(x))
        room = both * np.minimum(size[x] - at[x], size[y] - at[y]) - num * (size[x] + size[y])
        keep = (room >= 0) & (root[x] != root[y]) & (inside[y] | (node[x] < node[y]))
        x, y, room = x[keep], y[keep], room[keep]
        swap = node[x] > node[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        if len(x):
            yield node[x], node[y], root[x], root[y], room
        i, low, n = i[some:], low[some:], n[some:]


MET = "fa long, fb long, ra long, rb long, room long"


def _prefix_pairs(entries: DataFrame, tree: DataFrame, similar: tuple[int, int], *, each: bool) -> DataFrame:
    """(fa, fb): the pairs between components of `tree` that meet in the `entries`; all of them, or else one for each two components, the one with most room."""
    rooted = entries.join(tree.withColumnRenamed("root", "found"), "node", "left").withColumn("root", F.coalesce("found", "node")).drop("found")
    rooted = _several(rooted, "root").select("s", "node", "size", "at", "root")

    def met(held: list[pa.RecordBatch], end: bool) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
        """What the whole shingles of the held rows give, and the rows of the last one, which may go on."""
        rows = pa.Table.from_batches(held)
        s = rows.column("s").to_numpy()
        done = len(s) if end else int(np.searchsorted(s, s[-1]))
        out = []
        if done:
            for found in _meet_prefixes(*(c.to_numpy()[:done].astype(np.int64) for c in rows.columns), similar):
                fa, fb, ra, rb, room = found
                order = np.lexsort((-room, rb, ra) if not each else (fb, fa))
                one = (ra, rb) if not each else (fa, fb)
                first = order[np.concatenate([[True], (np.diff(one[0][order]) != 0) | (np.diff(one[1][order]) != 0)])]
                out.append(pa.RecordBatch.from_arrays([pa.array(x[first]) for x in found], names=[c.split()[0] for c in MET.split(", ")]))
        return out, rows.slice(done).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, step = [], 0, MEET_ROWS
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= step:
                out, held = met(held, False)
                yield from out
                n = sum(map(len, held))
                step = max(MEET_ROWS, 2 * n)
        if n:
            yield from met(held, True)[0]

    pairs = rooted.repartition("s").sortWithinPartitions("s").mapInArrow(run, MET)
    if each:
        return pairs.select("fa", "fb").distinct()
    ends = pairs.select(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb"), F.struct("room", "fa", "fb").alias("m"))
    return ends.groupBy("ra", "rb").agg(F.max("m").alias("m")).select("m.fa", "m.fb")


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(doc_id, component_id): for each row the smallest id reachable over texts of at least the similarity.

    Links hold exactly, and none that joins anything is left out. Most come from the tries. Verification goes the way
    of a spanning forest: twice each component tries its nearest link to another, then all that are left between
    components are tried. What the tries have missed comes from the first shingles of texts in different components, one
    pair for each two components first, then all. A node is a set of shingles. Texts without words are copies of
    each other. Null ids never win as smallest, rows that repeat stay, an empty table gives no rows; names of other
    columns don't matter.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = whole(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("h"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(node, wide(every)) for node, _, every in (shingle_set(t.as_py(), shingle) for t in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["doc_id", "h", "node", "fp"])

    marked = cut(rows.mapInArrow(mark, f"doc_id {kind}, h long, node long, fp binary"))
    own = cut(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("h", "fp")).alias("one")).select("node", "least", "one.h", "one.fp"))
    left = cut(_apart(word_links(own), own, WIDE_BUDGET))
    sets = cut(_sets(rows, own, left, shingle))
    links = tree = None
    for last in (False, False, True):
        between = cut(_across(left, tree))
        tried = between.select("fa", "fb")
        if not last:
            ends = between.select("apart", "fa", "fb", F.explode(F.array("ra", "rb")).alias("r"))
            tried = cut(ends.groupBy("r").agg(F.min(F.struct("apart", "fa", "fb")).alias("m")).select("m.fa", "m.fb").distinct())
        found = _verified(tried, sets, similar)
        links = cut(found if links is None else links.union(found))
        tree = cut(components(links))
        if not last:
            left = between.select("fa", "fb", "apart").join(tried, ["fa", "fb"], "left_anti")

    parts = 1 << max(8, (own.count() >> 14).bit_length())
    common = common_shingles(rows, shingle=shingle, parts=parts)
    entries = cut(_several(_prefixes(rows, common, shingle=shingle, parts=parts, similar=similar), "node"))
    before = None
    for each in (False, True):
        tried = _prefix_pairs(entries, tree, similar, each=each)
        tried = before = cut(tried if before is None else tried.join(before, ["fa", "fb"], "left_anti"))
        if tried.isEmpty():
            break
        sets = sets.union(cut(_sets(rows, own, tried, shingle, sets)))
        found = cut(_verified(tried, sets, similar))
        if not found.isEmpty():
            links = links.union(found)
            tree = cut(components(links))

    placed = cut(own.join(tree, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    reach = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(placed.join(reach, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """`docs` with the smallest id of each of `similar_groups`. Rows without an id stay; rows with one id are one document."""
    groups = similar_groups(docs, id_col=id_col, text_col=text_col, shingle=shingle, similar=similar)
    gone = groups.filter("doc_id != component_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
