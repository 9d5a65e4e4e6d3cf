"""Benchmark decontamination by the q-gram lemma.

An item of m characters within `e` edits of a region shares at least m - q + 1 - q * e of its q-grams with
it, and their diagonals (place in the text less place in the item) lie within e of each other. So each
text's q-grams that some item has are counted by item in diagonal bands of width 2e that overlap by half;
bands with fewer than the bound are dropped, and what is left is verified by banded alignment: the edit
distance of the whole item to its best substring of the region. q is 8, and less for items so short that
the bound would be nothing: the largest that asks for one shared q-gram at least.

Texts and items are compared in lower case with every run of other characters than letters and digits as
one space. The items are cut into blocks of at most BLOCK_CHARS characters, and each block is sent to the
executors by itself, so nothing that grows with the input is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import small_batches, whole

Q = 8
#: Edits allowed for each character of an item.
EDIT_RATE = 0.1
#: Places of shared q-grams in a text and an item held at once while they are counted, but for those of one place in the text.
STEP_PLACES = 1 << 19
#: Characters of items sent to the executors at once.
BLOCK_CHARS = 4_000_000
TABLE_BITS = 20
MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _folded() -> np.ndarray:
    """For each code point its lower case where it is a letter or digit, else a space."""
    out = np.full(0x110000, 32, np.uint64)
    for c in filter(str.isalnum, map(chr, range(0x110000))):
        out[ord(c)] = ord(c.lower()[0])
    return out


def normalize(text: str) -> np.ndarray:
    """The code points compared: lower case, every run of other characters than letters and digits as one space, none at the ends."""
    chars = _folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = chars == 32
    if not len(chars):
        return chars
    space[1:] &= space[:-1].copy()  # what goes: further spaces of a run, the first character if it is one
    chars = chars[~space]
    return chars[:-1] if len(chars) and chars[-1] == 32 else chars


def as_text(chars: np.ndarray) -> str:
    return chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def grams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """The hash of each q-gram of a text of code points."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(q):
        out *= np.uint64(0x100000001B3)
        out += chars[i : i + n]
    return out * MIX


def allowed(m: int, rate: float) -> int:
    """Edits allowed for an item of m characters."""
    return int(rate * m + 1e-9)


@dataclass
class Items:
    """A block of items of one q with an index of their q-grams."""

    q: int
    ids: list
    chars: list[np.ndarray]
    edits: np.ndarray
    keys: np.ndarray  # sorted hashes
    item: np.ndarray
    place: np.ndarray
    need: np.ndarray  # shared q-grams that the lemma asks for, by item
    table: np.ndarray  # whether some key has these leading bits


def index(items: list[tuple[object, np.ndarray]], rate: float) -> list[Items]:
    """A block of items, by their q."""
    by_q: dict[int, list] = {}
    for i, c in items:
        if len(c):
            e = allowed(len(c), rate)
            by_q.setdefault(max(1, min(Q, len(c) // (e + 1))), []).append((i, c, e))
    return [_items(q, rows) for q, rows in by_q.items()]


def _items(q: int, rows: list[tuple[object, np.ndarray, int]]) -> Items:
    chars, edits = [c for _, c, _ in rows], np.array([e for *_, e in rows], np.int64)
    keys = [grams(c, q) for c in chars]
    flat = np.concatenate(keys)
    item, place = np.repeat(np.arange(len(rows)), [len(k) for k in keys]), np.concatenate([np.arange(len(k)) for k in keys])
    order = np.argsort(flat, kind="stable")
    table = np.zeros(1 << TABLE_BITS, bool)
    table[flat >> np.uint64(64 - TABLE_BITS)] = True
    need = np.maximum(1, np.array([len(c) for c in chars]) - q + 1 - q * edits)
    return Items(q, [i for i, *_ in rows], chars, edits, flat[order], item[order], place[order], need, table)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """(edits, end): the least edits that turn the item into a substring of `text` on the diagonals low to high.

    None where more than `most` are needed; of equal ends the first counts. A row of the alignment holds the
    diagonals of the band only.
    """
    m, d = len(item), np.arange(low, high + 1)
    held = np.concatenate([np.full(max(0, -low), 1 << 40, np.uint64), text[max(0, low) : max(0, high + m)], np.full(max(0, high + m - max(len(text), low, 0)), 1 << 40, np.uint64)])
    far = most + 1
    ends = low + m > len(text) - (high - low) or low < 0  # some diagonals leave the text
    row = np.where((d >= 0) & (d <= len(text)), 0, far)  # the substring starts anywhere
    for i in range(m):
        new = row + (held[i : i + len(d)] != item[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - d) + d  # each further character of the text costs one
        if ends:
            row[(d + i + 1 < 0) | (d + i + 1 > len(text))] = far
        if i % 8 == 7 and row.min() > most:
            return None
    if row.min() > most:
        return None
    at = int(row.argmin())
    return int(row[at]), int(d[at]) + m


def find(chars: np.ndarray, block: list[Items]) -> list[tuple[object, int, int, int]]:
    """(item id, start, end, edits) of the regions of a normalized text that match an item.

    Wherever an item matches within its edits, a region of that item is told that begins no more than six
    times the edits away, or four characters for an item of few or no edits. `start` and `end` are places in the
    normalized text; a region is told as long as its item is, and an item may stand inside a word.
    """
    return [hit for items in block for hit in _found(chars, items)]


def _found(chars: np.ndarray, items: Items) -> list[tuple[object, int, int, int]]:
    hashed = grams(chars, items.q)
    at = np.flatnonzero(items.table[hashed >> np.uint64(64 - TABLE_BITS)])
    lo, hi = np.searchsorted(items.keys, hashed[at], "left"), np.searchsorted(items.keys, hashed[at], "right")
    at, lo, times = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    if not len(at):
        return []
    # each place of an item whose q-gram stands in the text counts once; items with too few go
    first = np.unique(lo, return_index=True)[1]
    shared = np.zeros(len(items.need), np.int64)
    for entry, _ in _entries(lo[first], times[first]):
        shared += np.bincount(items.item[entry], minlength=len(shared))
    enough = shared >= items.need
    if not enough.any():
        return []
    # bands [j * width, (j + 2) * width]: any two diagonals within e of each other share one
    widths = np.maximum(1, items.edits)
    span = int(len(chars) + max(map(len, items.chars)) + 4)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for entry, of in _entries(lo, times):
        some = enough[items.item[entry]]
        entry, of = entry[some], of[some]
        item = items.item[entry]
        band = (at[of] - items.place[entry]) // widths[item] + item * (2 * span) + span
        new, n = np.unique(np.concatenate([band, band - 1]), return_counts=True)
        keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
    item = keys // (2 * span)
    full = counts >= items.need[item]
    out, last, taken = [], -1, 0
    for k, band in zip(item[full].tolist(), (keys - item * (2 * span) - span)[full].tolist(), strict=True):
        m, e, width = len(items.chars[k]), int(items.edits[k]), int(widths[k])
        if k != last:
            last, taken = k, -len(chars) - m
        # an item is longer than the band is wide, so a band holds one place of it
        got = align(items.chars[k], chars, band * width - e, (band + 2) * width + e, e)
        if got and got[1] - m > taken:
            edits, end = got
            out.append((items.ids[k], max(0, end - m), end, edits))
            taken = end - m + width * 2
    return out


def _entries(lo: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in the index, row) for each of `times` places from `lo` on of each row; a bounded number at a time."""
    sums, begin = np.cumsum(times), 0
    while begin < len(lo):
        end = max(begin + 1, int(np.searchsorted(sums, STEP_PLACES + (sums[begin - 1] if begin else 0), "right")))
        n = times[begin:end]
        of = np.repeat(np.arange(begin, end), n)
        yield np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of], of
        begin = end


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edit_rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, edits): the regions of the documents' normalized texts that match an item.

    An item matches within `edit_rate` edits for each of its characters, wherever it stands. Null or empty texts and items match nothing, rows repeated in `docs` are
    told again, ids may be null, and other columns are ignored whatever their names. The items are read by
    the driver block by block.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_arrow = benchmark.select(item_col).limit(0).toArrow().schema.types[0]
    schema = f"doc_id {id_kind}, item_id {item_kind}, start long, end long, edits long"
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text"))

    def search(items: list[tuple[object, np.ndarray]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = index(items, edit_rate)
            for b in batches:
                found = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for hit in find(normalize(t), known)]
                kinds = (b.schema.types[0], item_arrow, pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], names=["doc_id", "item_id", "start", "end", "edits"])

        return rows.mapInArrow(run, schema)

    parts = map(search, blocks(benchmark, item_col, item_text_col, block_chars))
    return reduce(DataFrame.union, parts, spark.createDataFrame([], schema))


def blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[object, np.ndarray]]]:
    """The normalized items in lists of at most `most` characters, or of one longer item; empty ones are left out."""
    block: list[tuple[object, np.ndarray]] = []
    chars = 0
    for item, raw in benchmark.select(item_col, whole(F.col(text_col))).toLocalIterator():
        if not len(text := normalize(raw)):
            continue
        if block and chars + len(text) > most:
            yield block
            block, chars = [], 0
        block.append((item, text))
        chars += len(text)
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edit_rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`docs` without the rows that have a region matching an item; nothing is shuffled, rows without an id are judged like others."""
    small_batches(docs.sparkSession)
    for items in blocks(benchmark, item_col, item_text_col, block_chars):
        docs = docs.mapInArrow(_keeps(items, docs.columns.index(text_col), edit_rate), docs.schema)
    return docs


def _keeps(items: list[tuple[object, np.ndarray]], column: int, edit_rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index(items, edit_rate)
        for b in batches:
            yield b.filter(pa.array([not (t and find(normalize(t), known)) for t in b.column(column).to_pylist()], pa.bool_()))

    return run
