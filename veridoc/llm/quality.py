"""Quality classifier: a byte-level convolutional network in numpy.

Every byte of a text is embedded; learned filters slide over it. Filter answers are max-pooled over
chunks of 64 places that overlap by half and cover the whole text; a hidden layer sees each chunk, its
units are max-pooled over all chunks, and a logistic unit turns them into one probability.

The network is fitted in one Spark task on a bounded sample of labelled rows (SAMPLE of each class, chosen
by a hash of the id); weights of a few kilobytes then score every text where it is.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import small_batches, whole

EMBED, WIDTH, FILTERS, HIDDEN = 4, 6, 24, 24
#: A block of filter answers; a chunk is two blocks that follow each other.
BLOCK = 32
TILE = BLOCK * 1024
#: Labelled documents of each class that the fit reads at most.
SAMPLE = 1500
STEPS, BATCH, RATE = 1000, 24, 0.004
THRESHOLD = 0.3
FOLDS = 5

Weights = dict[str, np.ndarray]


def start(seed: int = 7) -> Weights:
    r = np.random.default_rng(seed)
    return {
        "embed": r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "filters": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "filter_bias": np.zeros(FILTERS, np.float32),
        "hidden": r.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(np.float32),
        "hidden_bias": np.full(HIDDEN, 0.1, np.float32),
        "out": r.normal(0, 0.3, HIDDEN).astype(np.float32),
        "out_bias": np.zeros(1, np.float32),
    }


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end, each filled with zero bytes to whole blocks, two at least; the block where each begins, and the number of blocks."""
    sizes = [max(2, -(-(len(t) + WIDTH) // BLOCK)) for t in texts]
    begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = np.zeros(int(begins[-1]) * BLOCK + WIDTH, np.uint8)
    for t, b in zip(texts, begins, strict=False):
        flat[b * BLOCK : b * BLOCK + len(t)] = np.frombuffer(t, np.uint8)
    return flat, begins


def _windows(flat: np.ndarray, at: int, n: int, w: Weights) -> np.ndarray:
    """The embedded bytes under the filters at n places from `at`."""
    e = w["embed"][flat[at : at + n + WIDTH - 1]]
    return np.lib.stride_tricks.as_strided(e, (n, WIDTH * EMBED), (e.strides[0], e.strides[1]))


def pooled(texts: list[bytes], w: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks by filter, the first chunk of each text with their number last, the laid out bytes)."""
    flat, begins = lay_out(texts)
    blocks = np.empty((int(begins[-1]), FILTERS), np.float32)
    over = (begins[1:] * BLOCK)[:, None] - np.arange(1, WIDTH)  # places whose window reaches into the next text
    over = np.sort(over.ravel())
    for at in range(0, len(blocks) * BLOCK, TILE):
        n = min(TILE, len(blocks) * BLOCK - at)
        answers = np.ascontiguousarray(_windows(flat, at, n, w)) @ w["filters"]
        lo, hi = np.searchsorted(over, [at, at + n])
        answers[over[lo:hi] - at] = -np.inf
        blocks[at // BLOCK : (at + n) // BLOCK] = answers.reshape(-1, BLOCK, FILTERS).max(axis=1)
    blocks = np.maximum(blocks + w["filter_bias"], 0)
    chunks = np.maximum(blocks[:-1], blocks[1:])
    inside = np.ones(len(chunks), bool)
    inside[begins[1:-1] - 1] = False  # a text's last block and the next text's first
    return chunks[inside], begins - np.arange(len(begins)), flat


def logits(texts: list[bytes], w: Weights) -> np.ndarray:
    chunks, firsts, _ = pooled(texts, w)
    hidden = np.maximum(chunks @ w["hidden"] + w["hidden_bias"], 0)
    top = np.maximum.reduceat(hidden, firsts[:-1], axis=0)
    return top @ w["out"] + w["out_bias"][0]


def scores(texts: list[bytes], w: Weights) -> np.ndarray:
    """The probability of label 1 of each text. An empty one is scored as zero bytes."""
    return np.round(1 / (1 + np.exp(-logits(texts, w).astype(np.float64))), 6) if texts else np.zeros(0)


def gradients(texts: list[bytes], labels: np.ndarray, w: Weights) -> Weights:
    """Of the mean cross entropy. Max pooling passes each gradient to one chunk and one place."""
    chunks, firsts, flat = pooled(texts, w)
    hidden = np.maximum(chunks @ w["hidden"] + w["hidden_bias"], 0)
    n = len(texts)
    best = np.stack([a + hidden[a:b].argmax(axis=0) for a, b in zip(firsts[:-1], firsts[1:], strict=True)])  # text by unit: its chunk
    top = np.take_along_axis(hidden, best, axis=0)
    d = ((1 / (1 + np.exp(-(top @ w["out"] + w["out_bias"][0])))) - labels).astype(np.float32) / n
    g = {"out": top.T @ d, "out_bias": np.array([d.sum()], np.float32)}
    d_top = d[:, None] * w["out"] * (top > 0)
    used, where = np.unique(best, return_inverse=True)
    where = where.reshape(best.shape)
    d_hidden = np.zeros((len(used), HIDDEN), np.float32)
    np.add.at(d_hidden, (where, np.arange(HIDDEN)[None, :]), d_top)
    g["hidden"], g["hidden_bias"] = chunks[used].T @ d_hidden, d_hidden.sum(axis=0)
    d_chunks = (d_hidden @ w["hidden"].T) * (chunks[used] > 0)
    text_of = np.searchsorted(firsts, used, "right") - 1
    places = ((used + text_of) * BLOCK)[:, None] + np.arange(2 * BLOCK)  # chunk number to block number
    # windows over the end of a text are never the best of a chunk: the text ends in zero bytes that the masks leave out
    last = ((firsts[1:] + np.arange(1, n + 1)) * BLOCK)[text_of][:, None] - WIDTH
    places = np.minimum(places, last)
    windows = w["embed"][flat[places[:, :, None] + np.arange(WIDTH)]].reshape(len(used), 2 * BLOCK, WIDTH * EMBED)
    at = (windows @ w["filters"]).argmax(axis=1)  # chunk by filter: its place
    chosen = np.take_along_axis(places, at, axis=1)
    seen = np.take_along_axis(windows, at[:, :, None], axis=1)  # chunk, filter, width * embed
    g["filters"] = np.einsum("cf,cfk->kf", d_chunks, seen)
    g["filter_bias"] = d_chunks.sum(axis=0)
    d_seen = (d_chunks[:, :, None] * w["filters"].T[None]).reshape(-1, WIDTH, EMBED)
    g["embed"] = np.zeros_like(w["embed"])
    np.add.at(g["embed"], flat[chosen.reshape(-1)[:, None] + np.arange(WIDTH)], d_seen)
    return g


def fit(texts: list[bytes], labels: list[int], *, steps: int = STEPS, seed: int = 7) -> Weights:
    """Weights fitted with Adam. Without rows of both labels, those that score every text the same."""
    w, y = start(seed), np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        w["out"][:] = 0
        w["out_bias"][:] = 0 if not len(y) else (4 if y[0] else -4)
        return w
    r = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for step in range(1, steps + 1):
        # classes are drawn alike, so a rare one counts as much
        rows = r.choice(len(y), min(BATCH, len(y)), replace=len(y) < BATCH, p=weight / weight.sum())
        rate = RATE * min(1, step / 20) * (1 - 0.9 * step / steps)
        for k, d in gradients([texts[i] for i in rows], y[rows], w).items():
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return w


def dump(w: Weights) -> bytes:
    out = io.BytesIO()
    np.savez(out, **w)
    return out.getvalue()


def undump(data: bytes) -> Weights:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def fold(doc: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> bytes:
    """Weights fitted to at most `sample` labelled documents of each class outside fold 0, chosen by a hash of their id.

    Rows with a null id or a null label, and ids whose labels disagree, take no part.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna()
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).filter("_y = _z").filter(fold(F.col("_id")) != 0)
    order = (F.xxhash64("_id"), F.col("_id"))
    chosen = known.filter("_y = 1").orderBy(*order).limit(sample).unionByName(known.filter("_y = 0").orderBy(*order).limit(sample))
    rows = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).cast("binary").alias("_text"))
    rows = rows.join(F.broadcast(chosen.select("_id", "_y")), "_id")  # at most 2 * sample rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted({(h, t, y) for b in batches for h, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True)})
        w = fit([t for _, t, _ in got], [y for *_, y in got])
        yield pa.RecordBatch.from_arrays([pa.array([dump(w)], pa.binary())], names=["weights"])

    made = rows.select(F.xxhash64("_id").alias("h"), "_text", "_y").repartition(1).mapInArrow(run, "weights binary").head()
    return made["weights"] if made else dump(fit([], []))


def score(docs: DataFrame, weights: bytes, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): a row for each row of `docs`; null and empty texts are scored like others."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = undump(weights)
        for b in batches:
            s = scores(b.column(2).to_pylist(), w)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col)) == 0).alias("held_out"), whole(F.col(text_col)).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, weights: bytes, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows that score below the threshold; all columns stay and nothing is shuffled."""
    small_batches(docs.sparkSession)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = undump(weights)
        for b in batches:
            texts = [(t or "").encode() for t in b.column(column).to_pylist()]
            yield b.filter(pa.array(scores(texts, w) >= threshold))

    return docs.mapInArrow(run, docs.schema)
