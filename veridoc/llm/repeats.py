"""Passages that stand in more than one place, by suffix arrays with their common-prefix interval trees.

A string of `length` bytes has an anchor: of its grams the one with the least hash, the leftmost of several. Equal
strings have equal anchors in equal places, so the suffix array of the corpus may be cut into buckets by anchor, and
an anchor that stands in one place only has no repeat around it. A run of strings with one anchor is a piece: the
bytes from the first string's start to the last one's end, with the anchor at a known place inside.

Pieces are counted by hash first. A piece that stands in several places is a repeat as a whole; it needs no bytes. In
buckets that hold different pieces, some of them in one place only, the suffixes from the anchor on are sorted, a stack
scan over their common prefixes gives the interval tree, and each interval of depth R is tested for the diversity of
its left extensions: what its members have in common to the left of the anchor is scanned in the same way, and every
L with L + R >= `length` that no deeper interval holds is a maximal repeat with all its occurrences. Repeats longer
than a piece are told in the overlapping pieces of their anchors.

Buckets with more than CROWD different pieces are split, as often as it takes: strings are dealt by cells of their
distance to the anchor and by the bytes that all strings of a cell share, until a piece is one string and its bucket
too. So no task holds an unbounded bucket, and nothing is left out.

`repeat_groups` tells the groups with their members, whose number can grow with the depth of the tree for each place.
`repeat_spans` tells which bytes they cover: of a piece in one place the largest groups alone, for what lies in others
lies in them. `drop_repeats` takes those bytes out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import cut, small_batches, whole

#: Bytes of a repeat, and of the grams that anchors are chosen from.
LENGTH, GRAM = 400, 100
#: Different pieces of a bucket that one task sorts, and parts into which the cells of a larger one are split.
CROWD, SPLIT = 512, 4
#: Bytes hashed at once.
SLAB = 1 << 20

_PLACE = np.uint64((1 << 24) - 1)  # the low bits of a gram's order: its place in the slab
_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """Finds the anchors of all strings of `length` bytes in a batch of texts."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.up, self.down = _powers(_BASE, SLAB + length), _powers(pow(_BASE, -1, 1 << 64), SLAB + length)

    def _grams(self, data: np.ndarray) -> np.ndarray:
        """The hash of each gram of the bytes."""
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.down[: len(data) + 1 - self.gram]
        h = (h ^ (h >> np.uint64(31))) * _MIX
        return h ^ (h >> np.uint64(29))

    def _least(self, order: np.ndarray) -> np.ndarray:
        """The least of each `length - gram + 1` neighbours."""
        width, held = self.length - self.gram + 1, 1
        while 2 * held <= width:
            order, held = np.minimum(order[:-held], order[held:]), 2 * held
        return np.minimum(order[: len(order) - (width - held)], order[width - held :]) if held < width else order

    def runs(self, data: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first start, last start, anchor, anchor's hash) of the strings with one anchor; whole strings of one text start from each `low` to below each `high`."""
        parts = []
        for at in range(0, len(data) - self.length + 1, SLAB - self.length):
            size = min(SLAB - self.length, len(data) - self.length + 1 - at)
            some = slice(np.searchsorted(high, at, "right"), np.searchsorted(low, at + size))
            edges = np.zeros(size + 1, np.int64)
            np.add.at(edges, np.maximum(low[some] - at, 0), 1)
            np.add.at(edges, np.minimum(high[some] - at, size), -1)
            ok = np.cumsum(edges[:-1]) > 0
            if not ok.any():
                continue
            h = self._grams(data[at : at + size + self.length - 1])
            order = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
            anchor = (self._least(order) & _PLACE).astype(np.int64)
            new = ok.copy()
            new[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
            ends = ok.copy()
            ends[:-1] &= ~ok[1:] | (anchor[1:] != anchor[:-1])
            first, last = np.flatnonzero(new), np.flatnonzero(ends)
            parts.append((first + at, last + at, anchor[first] + at, h[anchor[first]]))
        if not parts:
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(np.uint64)
        first, last, anchor, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        # a run that a slab's end has cut
        joined = np.zeros(len(first), bool)
        joined[1:] = (anchor[1:] == anchor[:-1]) & (first[1:] == last[:-1] + 1)
        keep = np.flatnonzero(~joined)
        return first[keep], last[np.append(keep[1:], len(first)) - 1], anchor[keep], h[keep]


def piece_id(piece: bytes | memoryview) -> bytes:
    return xxhash.xxh3_128_digest(piece)


def _longs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def pieces_of(texts: list[bytes], finder: Anchors) -> tuple[np.ndarray, ...]:
    """(text's number, b, v1, v2, at, o, n): the pieces of a batch: bucket, hash, start in the text, the anchor's place inside, bytes."""
    data = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    some = sizes >= finder.length
    first, last, anchor, h = finder.runs(np.frombuffer(data, np.uint8), begins[some], (begins + sizes)[some] - finder.length + 1)
    size = last - first + finder.length
    view = memoryview(data)
    v1, v2 = _longs([piece_id(view[s : s + n]) for s, n in zip(first.tolist(), size.tolist(), strict=True)])
    text = np.searchsorted(begins, first, "right") - 1
    return text, h.view(np.int64), v1, v2, first - begins[text], anchor - first, size


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """(depth, low, high, borders): the nodes of the common-prefix interval tree with at least that depth, deeper ones first.

    `lcp[i]` is what the sorted strings i and i + 1 have in common; a node holds the strings low to high, and
    `borders` are the places where one of its children ends.
    """
    stack: list[tuple[int, int, list[int]]] = []
    for i in range(len(lcp) + 1):
        now, low = lcp[i] if i < len(lcp) else -1, i
        while stack and stack[-1][0] > now:
            depth, low, borders = stack.pop()
            if depth >= least:
                yield depth, low, i, borders
        if stack and stack[-1][0] == now:
            stack[-1][2].append(i)
        elif now >= 0:
            stack.append((now, low, [i]))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(L, R, members): the maximal repeats around an anchor: L bytes before it and R from it on, L + R >= `length`, in two pieces at least.

    `lefts` hold the bytes before the anchor backwards. A node of the tree over the right sides gives R; the tree over its
    members' left sides gives each L. A group whose members all lie below one child is a repeat of that child.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [common_prefix(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
    rank = {k: n for n, k in enumerate(sorted(order, key=lefts.__getitem__))} if len(order) > 2 else None
    most = max(map(len, lefts))
    for depth, low, high, borders in intervals(lcp, length - most):
        members = range(low, high + 1)
        by_left = sorted(members, key=lambda p: rank[order[p]]) if rank else sorted(members, key=lambda p: lefts[order[p]])
        shared = [common_prefix(lefts[order[a]], lefts[order[b]]) for a, b in zip(by_left, by_left[1:], strict=False)]
        for left, lo, hi, _ in intervals(shared, max(0, length - depth)):
            group = by_left[lo : hi + 1]
            least, last = min(group), max(group)
            if any(least <= x < last for x in borders):  # in several children: nothing more in common to the right
                yield left, depth, [order[p] for p in group]


PIECE = "b long, v1 long, v2 long, times long, d1 long, d2 long, at int, o int, piece binary"
FOUND = "b long, v1 long, v2 long, d1 long, d2 long, at int, o int, n int"
KEY = ["b", "v1", "v2"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, d1, d2, text): rows with one id and one text are one document in several places, and share their key."""
    text, doc = whole(F.col(text_col)), F.col(id_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(doc, doc.isNull()).alias("d1"), F.xxhash64(text, doc).alias("d2"), text.cast("binary").alias("text"))


def found_pieces(rows: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The pieces of all `rows(d1, d2, text)`: bucket, hash, document, start, the anchor's place and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(length, gram)
        for b in batches:
            text, k, v1, v2, at, o, n = pieces_of([t.as_py() for t in b.column(2)], finder)
            docs = (b.column(c).to_numpy()[text] for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, v1, v2, *docs, at.astype(np.int32), o.astype(np.int32), n.astype(np.int32))], names=["b", "v1", "v2", "d1", "d2", "at", "o", "n"])

    return rows.filter(F.octet_length("text") >= length).mapInArrow(run, FOUND)


def _open(per_piece: DataFrame) -> DataFrame:
    """(b, kinds): the buckets of `per_piece(b, v1, v2, times)` that hold different pieces, some of them in one place only."""
    return cut(per_piece.groupBy("b").agg(F.count("*").alias("kinds"), F.bool_or(F.col("times") == 1).alias("lone")).filter("kinds > 1 and lone").select("b", "kinds"))


def _batch(out: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    columns = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[k]) for i, (_, k) in enumerate(columns)], names=[c for c, _ in columns])


def _texts_cut(need: DataFrame, rows: DataFrame) -> DataFrame:
    """The pieces `need(b, v1, v2, times, one)` with their bytes, cut out of the documents; `one` is where one of their places is."""
    by_doc = need.select("one.d1", "one.d2", F.struct(*KEY, "times", "one.at", "one.o", "one.n").alias("w")).groupBy("d1", "d2").agg(F.collect_list("w").alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column(2), batch.column(3)
            flat, of = wanted.flatten(), np.repeat(np.arange(len(batch)), np.diff(wanted.offsets.to_numpy()))
            views = [memoryview(t.as_buffer()) for t in texts]
            out = [bytes(views[t][s : s + m]) for t, s, m in zip(of.tolist(), *(flat.field(c).to_pylist() for c in ("at", "n")), strict=True)]
            docs = [pa.array(batch.column(c).to_numpy()[of]) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in (*KEY, "times")), *docs, flat.field("at"), flat.field("o"), pa.array(out, pa.binary())], names=[c.split()[0] for c in PIECE.split(", ")])

    # repeated rows of a document give the same pieces again
    return rows.join(by_doc, ["d1", "d2"]).select("d1", "d2", "text", "wanted").mapInArrow(run, PIECE)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The pieces of each bucket, out of rows sorted by bucket; a piece that comes again is left out."""
    bucket: dict[tuple, dict] = {}
    now = None
    for batch in batches:
        for x in batch.to_pylist():
            if x["b"] != now:
                if len(bucket) > 1:
                    yield list(bucket.values())
                bucket, now = {}, x["b"]
            bucket.setdefault((x["v1"], x["v2"]), x)
    if len(bucket) > 1:
        yield list(bucket.values())


def _in_order(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("b").sortWithinPartitions("b")


def _repeats(bucket: list[dict], length: int) -> Iterator[tuple[int, int, list[int]]]:
    return maximal_repeats([x["piece"][: x["o"]][::-1] for x in bucket], [x["piece"][x["o"] :] for x in bucket], length)


def _grouped(pieces: DataFrame, length: int) -> DataFrame:
    """(b, v1, v2, shift, m, g): the repeats in each bucket of `pieces`, as groups g of parts of pieces: m bytes from `shift` on."""
    schema = "b long, v1 long, v2 long, shift int, m int, g long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _buckets(batches):
            out = []
            for left, right, members in _repeats(bucket, length):
                x = bucket[members[0]]
                group = int.from_bytes(xxhash.xxh3_64_digest(x["piece"][x["o"] - left : x["o"] + right]), "big", signed=True)
                out += [(*(bucket[k][c] for c in KEY), bucket[k]["o"] - left, left + right, group) for k in members]
            yield _batch(out, schema)

    return _in_order(pieces).mapInArrow(run, schema)


def largest(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs (L, R) those that no other holds: R falls as L rises."""
    out: list[tuple[int, int]] = []
    for left, right in sorted(spans, reverse=True):
        if not out or right > out[-1][1]:
            out.append((left, right))
    return out


SPAN = "d1 long, d2 long, start int, m int"


def _covered(pieces: DataFrame, length: int) -> DataFrame:
    """(d1, d2, start, m): what the repeats in each bucket of `pieces` cover of those with one place. The others are repeats as wholes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for bucket in _buckets(batches):
            reach: dict[int, set[tuple[int, int]]] = {k: set() for k, x in enumerate(bucket) if x["times"] == 1}
            for left, right, members in _repeats(bucket, length):
                for k in members:
                    if k in reach:
                        reach[k].add((left, right))
            for k, found in reach.items():
                x = bucket[k]
                out += [(x["d1"], x["d2"], x["at"] + x["o"] - left, left + right) for left, right in largest(found)]
            if len(out) > 10_000:
                yield _batch(out, SPAN)
                out = []
        yield _batch(out, SPAN)

    return _in_order(pieces).mapInArrow(run, SPAN)


PART = "b long, v1 long, v2 long, times long, d1 long, d2 long, at int, o int, piece binary, pb long, p1 long, p2 long, shift int"


def _split(pieces: DataFrame, cell: int, length: int) -> DataFrame:
    """PART: the pieces by cells of so many distances to the anchor, and by the bytes that all strings of a cell share; with the piece (pb, p1, p2) that a part begins at `shift` of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                o, piece = x["o"], x["piece"]
                far, near = o, o - (len(piece) - length)  # distances of the first and the last string to the anchor
                for c in range(near // cell, far // cell + 1):
                    low, high = c * cell, (c + 1) * cell - 1
                    shared = piece[max(0, o - low) : max(0, o - high + length)]
                    begin, end = o - min(far, high), o - max(near, low) + length
                    key = int.from_bytes(xxhash.xxh3_64_digest(shared, (c << 20 | cell) & (1 << 63) - 1), "big", signed=True)
                    w1, w2 = np.frombuffer(piece_id(piece[begin:end]), np.int64).tolist()
                    out.append((key, w1, w2, x["times"], x["d1"], x["d2"], x["at"] + begin, o - begin, piece[begin:end], *(x[k] for k in KEY), begin))
            yield _batch(out, PART)

    return pieces.mapInArrow(run, PART)


def _met(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """FOUND and `same`: the pieces of buckets with several places, and whether all of a bucket's are the same piece."""
    found = cut(found_pieces(rows, length=length, gram=gram))
    same = (F.min("v1") == F.max("v1")) & (F.min("v2") == F.max("v2"))
    # a table, so that the join below deals both its sides itself and can split an anchor that stands in every text
    shared = cut(found.groupBy("b").agg(F.count("*").alias("places"), same.alias("same")).filter("places > 1").select("b", "same"))
    return cut(found.join(shared, "b"))


def _per_piece(holds: DataFrame) -> DataFrame:
    """(b, v1, v2, times, one): how often each piece stands, and one of its places."""
    return cut(holds.groupBy(*KEY).agg(F.count("*").alias("times"), F.min(F.struct("d1", "d2", "at", "o", "n")).alias("one")))


def repeat_spans(rows: DataFrame, *, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(d1, d2, start, m): runs of m bytes of `rows(d1, d2, text)` that cover every string of `length` bytes which also starts elsewhere, and no other byte."""
    small_batches(rows.sparkSession)
    met = _met(rows, length, gram)
    span = ["d1", "d2", F.col("at").alias("start"), F.col("n").alias("m")]
    mixed = met.filter("not same")
    per_piece = _per_piece(mixed)
    out = [met.filter("same").select(*span), mixed.join(per_piece.filter("times > 1").select(*KEY), KEY).select(*span)]
    buckets, cell = _open(per_piece), length - gram + 1
    pieces = _texts_cut(per_piece.join(buckets.select("b"), "b"), rows)
    while True:
        pieces = cut(pieces.join(buckets, "b"))
        out.append(_covered(pieces.filter(F.col("kinds") <= crowd).drop("kinds"), length))
        many = pieces.filter(F.col("kinds") > crowd).drop("kinds")
        if many.isEmpty():
            return reduce(DataFrame.union, out)
        cell = -(-cell // SPLIT)
        parts = cut(_split(many, cell, length).drop("pb", "p1", "p2", "shift"))
        sums = cut(parts.groupBy(*KEY).agg(F.sum("times").alias("sum")))
        often = sums.filter("sum > 1").select(*KEY)
        out.append(parts.filter("times = 1").join(often, KEY).select("d1", "d2", F.col("at").alias("start"), F.octet_length("piece").alias("m")))
        buckets = _open(sums.withColumnRenamed("sum", "times"))
        pieces = parts.dropDuplicates(KEY).drop("times").join(sums, KEY).select(*KEY, F.col("sum").alias("times"), "d1", "d2", "at", "o", "piece")


def repeat_groups(rows: DataFrame, *, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(g, d1, d2, start, m): the repeats of `rows(d1, d2, text)` as groups of all their places; m bytes from `start` on.

    Every string of `length` bytes that stands in more than one place lies in a group, and a group's strings are equal.
    Pieces that are all repeats as wholes aren't held against each other.
    """
    small_batches(rows.sparkSession)
    met = _met(rows, length, gram)
    group = F.xxhash64(*KEY).alias("g")
    out = [met.filter("same").select(group, "d1", "d2", F.col("at").alias("start"), F.col("n").alias("m"))]
    holds, pieces, cell = met.filter("not same").drop("same"), None, length - gram + 1
    while True:
        per_piece = _per_piece(holds)
        buckets, often = _open(per_piece), per_piece.filter("times > 1").select(*KEY)
        out.append(holds.join(often, KEY).select(group, "d1", "d2", F.col("at").alias("start"), F.col("n").alias("m")))
        if pieces is None:
            pieces = _texts_cut(per_piece.join(buckets.select("b"), "b"), rows)
        pieces = cut(pieces.join(buckets, "b"))
        told = _grouped(pieces.filter(F.col("kinds") <= crowd).drop("kinds"), length)
        out.append(holds.join(told, KEY).select("g", "d1", "d2", (F.col("at") + F.col("shift")).alias("start"), "m"))
        many = pieces.filter(F.col("kinds") > crowd).drop("kinds")
        if many.isEmpty():
            return reduce(DataFrame.union, out)
        cell = -(-cell // SPLIT)
        parts = cut(_split(many, cell, length))
        to = parts.select(F.col("pb").alias("b"), F.col("p1").alias("v1"), F.col("p2").alias("v2"), F.col("b").alias("b2"), F.col("v1").alias("w1"), F.col("v2").alias("w2"), "shift", F.col("o").alias("o2"), F.octet_length("piece").alias("n2"))
        holds = cut(holds.join(to, KEY).select(F.col("b2").alias("b"), F.col("w1").alias("v1"), F.col("w2").alias("v2"), "d1", "d2", (F.col("at") + F.col("shift")).alias("at"), F.col("o2").alias("o"), F.col("n2").alias("n")))
        pieces = parts.select("b", "v1", "v2", "times", "d1", "d2", "at", "o", "piece").dropDuplicates(KEY)


def _runs(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of what spans cover."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return list(zip(start[first].tolist(), end[np.append(first[1:], len(start)) - 1].tolist(), strict=True))


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, kept binary, removed array<start, end>): each row's text as UTF-8 bytes without its repeats of at least `length` bytes.

    Every byte of a string of `length` bytes that also starts anywhere else, in the same document or another, goes, the
    first place included; what is left may split a character, hence binary. Matches never cross documents. Null texts are
    empty ones, rows that repeat are repeats of each other, ids may be null, an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    all_rows = _keyed(docs, id_col, text_col)
    spans = repeat_spans(all_rows.drop("doc_id"), length=length, gram=gram, crowd=crowd)
    spans = spans.groupBy("d1", "d2").agg(F.collect_list(F.struct("start", "m")).alias("spans"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, kept, removed = [], [], []
            for t, s in zip(b.column(1), b.column(2), strict=True):
                text, runs = memoryview(t.as_buffer()), []
                if s.is_valid:
                    start, m = (s.values.field(c).to_numpy().astype(np.int64) for c in ("start", "m"))
                    runs = _runs(start, start + m)
                at = [0, *(x for run in runs for x in run), len(text)]
                kept.append(b"".join(text[at[k] : at[k + 1]] for k in range(0, len(at), 2)))
                removed.append([{"start": x, "end": y} for x, y in runs])
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, span)], names=["doc_id", "n_bytes", "kept", "removed"])

    joined = all_rows.join(spans, ["d1", "d2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, kept binary, removed array<struct<start: long, end: long>>")


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of what `drop_repeats` gives."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return rows.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
