"""Exact top-k search by distributed histogram selection.

Components are turned into whole numbers, so scores are whole and exact. Queries and candidates are laid
out as a grid of blocks; every cell scores its queries against its candidates with one matrix product.
Each round cuts every query's score range into BINS bins, counts its scores in them, and adds the counts
of all cells up; the bin that holds the k-th best score is the next round's range, until it is one score
wide. A last round keeps the scores at or above the k-th, and ties go to the smaller id.

A cell sends at most k counts for each query: below its own k best scores there is nothing that could
decide where the k-th best of all lies. Of the scores equal to the k-th it sends the k smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridoc.llm.common import cut

SCALE, K, BINS = 64, 20, 1024
#: Rows of a block; a cell's memory is bounded by their product.
QUERY_ROWS, CANDIDATE_ROWS = 1024, 4096


def whole_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): each component x as floor(scale * x). Rows without an id, without a vector or with a component that is null or not finite are left out."""
    v = F.col(vector_col)
    good = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(good).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products, exact: in floating point where no sum can pass 2**53, else in whole numbers; where one could pass 2**63, an error."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most >= 1 << 63:
        raise OverflowError("scores of these vectors may pass 64 bits; take a smaller scale")
    return q @ c.T


def _cell(q: pd.DataFrame, c: pd.DataFrame) -> Iterator[tuple[pd.Series, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of a cell's queries; a query's own row is no candidate."""
    if not len(q) or not len(c):
        return
    width = max(q["v"].map(len).max(), c["v"].map(len).max())
    scores = _products(_matrix(q["v"], width), _matrix(c["v"], width))
    ids = c["vec_id"].to_numpy()
    for (_, query), s in zip(q.iterrows(), scores, strict=True):
        other = ids != query["vec_id"]
        yield query, ids[other], s[other]


def top_k(queries: DataFrame, candidates: DataFrame, *, k: int = K, bins: int = BINS, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, all where there are fewer.

    Both tables hold (vec_id, v) as `whole_vectors` makes them. A shorter vector counts as filled with
    zeros. Candidates with the query's own id are left out. Ids that repeat: each row is a candidate of its
    own, ties among them are broken by the vector; queries that repeat are asked once. Empty tables give
    no rows.
    """
    spark = queries.sparkSession
    queries = cut(queries.dropDuplicates(["vec_id"]))
    candidates = cut(candidates)
    n_q, n_c = queries.count(), candidates.count()
    if not n_q or not n_c:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q_blocks, c_blocks = -(-n_q // query_rows), -(-n_c // candidate_rows)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    longest = [df.agg(F.max(length)).head()[0] for df in (queries, candidates)]
    # by Cauchy and Schwarz no score is further from zero than the product of the longest vectors' lengths
    reach = int(longest[0] * longest[1] * (1 + 1e-9)) + 1
    reach = min(reach, (1 << 63) - 2)

    # salted by id, so that rows that are alike spread as well
    grid = F.sequence(F.lit(0), F.lit(c_blocks - 1))
    c = candidates.withColumn("cb", F.pmod(F.xxhash64("vec_id"), F.lit(c_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    state = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("qb"), F.lit(-reach).cast("long").alias("low"), F.lit(reach + 1).cast("long").alias("high"), F.lit(k).cast("long").alias("left"))

    def count(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        for query, _, s in _cell(q, c):
            low, high, left = int(query["low"]), int(query["high"]), int(query["left"])
            inside = s[(s >= low) & (s < high)]
            if len(inside) > left:
                inside = np.partition(inside, len(inside) - left)[len(inside) - left :]
            step = -(-(high - low) // bins)
            found, n = np.unique((inside - low) // step, return_counts=True)
            out += [(query["vec_id"], int(b), int(m)) for b, m in zip(found, n, strict=True)]
        return pd.DataFrame(out, columns=["vec_id", "bin", "n"])

    def keep(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        for query, ids, s in _cell(q, c):
            least = int(query["low"])
            over, ties = s > least, s == least
            at = np.concatenate([np.flatnonzero(over), np.flatnonzero(ties)[np.argsort(ids[ties], kind="stable")[:k]]])
            out += [(query["vec_id"], int(i), int(x)) for i, x in zip(ids[at], s[at], strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def cells(state: DataFrame):
        q = state.withColumn("cb", F.explode(grid))
        return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb"))

    width = 2 * reach + 1
    while width > 1:
        step = -(-width // bins)  # all ranges are equally wide
        counts = cells(state).applyInPandas(count, "vec_id long, bin long, n long").groupBy("vec_id", "bin").agg(F.sum("n").alias("n"))
        # a query has at most k counts from each cell; what lies above a bin is the sum of those before it
        above = F.sum("n").over(Window.partitionBy("vec_id").orderBy(F.desc("bin")))
        found = counts.withColumn("upto", above).join(state.select("vec_id", F.col("left").alias("_left")), "vec_id")
        # the bin with the k-th; a query with fewer candidates ends in its lowest bin
        found = found.filter(F.col("upto") - F.col("n") < F.col("_left")).groupBy("vec_id").agg(F.min(F.struct("bin", (F.col("upto") - F.col("n")).alias("before"))).alias("at"))
        state = cut(
            state.join(found, "vec_id").select(
                "vec_id", "v", "qb",
                (F.col("low") + F.col("at.bin") * step).alias("low"),
                (F.col("low") + (F.col("at.bin") + 1) * step).alias("high"),
                (F.col("left") - F.col("at.before")).alias("left"),
            )
        )
        width = step
    hits = cells(state).applyInPandas(keep, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
