"""Ranked lexical search the other way round: the items stay, the documents stream by.

An inverted index over the items' terms is broadcast, block by block of bounded size. A first pass counts the
documents, their terms, and in how many documents each of the items' terms stands. A second pass sends every
document's term counts through the index, which gives its scores for all items that share a term, and keeps for
each item a heap of its k best documents in the task. The heaps of all tasks are merged by rank. No document is
shuffled: what leaves a task is k rows for each item at most, and a count for each term of the block.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridoc.llm.common import small_batches, whole

K = 20
#: Bytes of items' terms sent to the executors at once.
BLOCK_BYTES = 4_000_000

#: Bytes to bytes: A-Z lower, every other ASCII character than letters and digits a space. Bytes of other characters stay.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: Numbers up to here are exact in floating point.
_EXACT = 1 << 53


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order, repeats included."""
    return text.translate(_FOLD).split()


@dataclass
class Index:
    """A block of items: for each term the items that hold it, and how often."""

    ids: list  # of the items
    number: dict[bytes, int]  # of each term
    starts: np.ndarray  # of each term's postings, and their end
    item: np.ndarray
    often: np.ndarray


def index(items: list[tuple[object, Counter]]) -> Index:
    number: dict[bytes, int] = {}
    postings = sorted((number.setdefault(t, len(number)), k, n) for k, (_, counts) in enumerate(items) for t, n in counts.items())
    term, item, often = (np.array(x, np.int64) for x in (zip(*postings, strict=True) if postings else ([], [], [])))
    return Index([i for i, _ in items], number, np.searchsorted(term, np.arange(len(number) + 1)), item, often)


def blocks(items: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[object, Counter]]]:
    """The items' terms in lists of at most `most` bytes of distinct terms, or of one larger item. Rows with one id are one item; one without terms matches nothing."""
    block: list[tuple[object, Counter]] = []
    held = 0
    rows = items.select(F.col(item_col).alias("i"), whole(F.col(text_col)).cast("binary").alias("t")).orderBy("i")
    for item, raw in rows.toLocalIterator():
        counts = Counter(terms(bytes(raw)))
        size = sum(map(len, counts))
        if block and block[-1][0] == item:
            block[-1][1].update(counts)
        else:
            if block and held + size > most:
                yield block
                block, held = [], 0
            block.append((item, counts))
        held += size
    if block:
        yield block


def _counted(docs: DataFrame, known: Index) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms of all documents, documents that hold each of the block's terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, all_terms, holds = 0, 0, np.zeros(len(known.number), np.int64)
        for b in batches:
            for t in b.column(0):
                words = terms(t.as_py())
                docs += bool(words)
                all_terms += len(words)
                holds[[known.number[w] for w in known.number.keys() & set(words)]] += 1
        some = np.flatnonzero(holds)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[docs, all_terms], holds[some]]))], names=["term", "n"])

    sums = docs.select("t").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of a block
    by = dict(zip(sums.column(0).to_pylist(), sums.column(1).to_pylist(), strict=True))
    return by.get(-2, 0), by.get(-1, 0), np.array([by.get(t, 0) for t in range(len(known.number))], np.int64)


class Heaps:
    """The k best documents of each item: (score, id), the smaller id first among equals, an unknown one last."""

    def __init__(self, items: int, k: int):
        self.k, self.kept, self.least = k, [[] for _ in range(items)], np.zeros(items, np.int64)

    def add(self, doc: int | None, items: np.ndarray, scores: np.ndarray) -> None:
        """`least` is the score of the worst of a full heap, 0 before: scores below it, and 0, can't enter."""
        good = np.flatnonzero((scores > 0) & (scores >= self.least[items]))
        for item, score in zip(items[good].tolist(), scores[good].tolist(), strict=True):
            heap, entry = self.kept[item], (score, doc is not None, -(doc or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[item] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        return ((item, -doc if known else None, score) for item, heap in enumerate(self.kept) for score, known, doc in heap)


def weights(n_docs: int, holds: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holds.tolist()], np.int64)


def scored(counts: Counter, n: int, known: Index, weight: np.ndarray, n_docs: int, all_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(items, scores): the items that share a term with a document of n terms."""
    shared = counts.keys() & known.number.keys()
    term, tf = np.array([known.number[t] for t in shared], np.int64), np.array([counts[t] for t in shared], np.int64)
    m = 100 - 25 + (25 * n * n_docs) // all_terms
    gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
    low, many = known.starts[term], known.starts[term + 1] - known.starts[term]
    of = np.repeat(np.arange(len(term)), many)
    at = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + low[of]
    if not len(at):
        return at, at
    part = gain[of] * known.often[at]
    if int(gain.sum()) * int(known.often.max()) < _EXACT:
        sums = np.bincount(known.item[at], part, len(known.ids)).astype(np.int64)
    else:
        sums = np.zeros(len(known.ids), np.int64)
        np.add.at(sums, known.item[at], part)
    items = np.flatnonzero(sums)
    return items, sums[items]


def ranked(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, all where there are fewer; equal scores by ascending id.

    Null and empty texts have no terms. Rows that repeat in `docs` are documents of their own; ids may be null, those
    come last among equals and must be whole numbers otherwise. Items that share an id are one item. Empty tables give
    no rows, and other columns are ignored whatever their names. The items are read by the driver block by block; each
    block of `block_bytes` adds two passes over the documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(whole(F.col(text_col)).cast("binary").alias("t"), F.col(id_col).cast("long").alias("d"))
    kind = items.schema[item_col].dataType.simpleString()
    item_arrow = items.select(item_col).limit(0).toArrow().schema.types[0]

    def search(block: list[tuple[object, Counter]]) -> DataFrame:
        known = index(block)
        n_docs, all_terms, holds = _counted(rows, known)
        weight = weights(n_docs, holds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Heaps(len(known.ids), k)
            for b in batches:
                for t, d in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    words = terms(t.as_py())
                    if words:
                        best.add(d, *scored(Counter(words), len(words), known, weight, n_docs, all_terms))
            out = list(best.rows())
            yield pa.RecordBatch.from_arrays([pa.array([known.ids[i] for i, *_ in out], item_arrow), *(pa.array([x[c] for x in out], pa.int64()) for c in (1, 2))], names=["item_id", "doc_id", "score"])

        return rows.mapInArrow(run, f"item_id {kind}, doc_id long, score long")

    found = reduce(DataFrame.union, map(search, blocks(items, item_col, item_text_col, block_bytes)), spark.createDataFrame([], f"item_id {kind}, doc_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int"), "doc_id", "score")
