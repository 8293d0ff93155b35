"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its ``prefix`` nearest pivots in order of distance. In
an inverted file, each pivot posts the vectors that have it, with its place in their
order. A query reads the postings of its own nearest pivots, which gives the footrule
distance of the truncated orders to every vector that shares a pivot; the nearest
share of them by footrule is reranked by Euclidean distance on the original vectors.

The inverted file is built once, in blocks of about ``block`` vectors, and stored: a row
per block, with its postings and vectors as arrays of bytes. Queries are sent to the
blocks, which stay where they are; a task holds one block and ``chunk`` queries at a
time. A query meets every block: the work is that of the stated query set against all
rows. How large a share is reranked is fitted on a bounded sample (``fitted_share``):
on clustered vectors it is small, while directions without clusters, which footrule
orders in bulk only, take nearly half. A share, not a fixed number, keeps the recall
at every size.

Pivots and blocks follow from the rows' ids and vectors, not from where they lie, so
the result does not depend on the table's files or partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import one_thread, stored, table, tidied

FOUND = "query_id long, query_uid long, vec_id long, score double"
#: The parts of a block's index and their types.
PARTS = {"ids": "<i8", "uids": "<i8", "vectors": "<f8", "rows": "<i4", "places": "<i4", "begins": "<i4"}


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T


def nearest_pivots(rows: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The places of the prefix nearest pivots, nearest first; ties by place."""
    made = [np.argsort(squared(rows[at : at + 4096], pivots), axis=1, kind="stable")[:, :prefix] for at in range(0, len(rows), 4096)]
    return np.concatenate(made) if made else np.zeros((0, prefix), np.int64)


class Block:
    """Vectors and the inverted file over them: for each pivot the vectors that have it in their prefix, and its place there."""

    def __init__(self, parts: dict[str, np.ndarray], prefix: int):
        self.ids, self.uids, self.rows, self.places, self.begins = (parts[k] for k in ("ids", "uids", "rows", "places", "begins"))
        self.vectors, self.prefix = parts["vectors"].reshape(len(self.ids), -1), prefix

    @classmethod
    def of(cls, ids: np.ndarray, uids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> Block:
        order = np.lexsort((uids, *vectors.T[::-1], ids))
        ids, uids, vectors = ids[order], uids[order], vectors[order]
        orders = nearest_pivots(vectors, pivots, prefix)
        by_pivot = np.argsort(orders, axis=None, kind="stable")
        begins = np.searchsorted(orders.reshape(-1)[by_pivot], np.arange(len(pivots) + 1))
        return cls({"ids": ids, "uids": uids, "vectors": vectors, "rows": by_pivot // prefix, "places": by_pivot % prefix, "begins": begins}, prefix)

    def parts(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, k), kind).tobytes() for k, kind in PARTS.items()]

    def closeness(self, order: np.ndarray) -> np.ndarray:
        """What the footrule distance falls short of its largest value, for each vector; an absent pivot has the place ``prefix``."""
        gain = np.zeros(len(self.ids), np.int32)
        for place, pivot in enumerate(order):
            at = slice(self.begins[pivot], self.begins[pivot + 1])
            gain[self.rows[at]] += 2 * (self.prefix - np.maximum(self.places[at], place)).astype(np.int32)
        return gain

    def search(self, asked: np.ndarray, uids: list[int], pivots: np.ndarray, k: int, share: float):
        """For each query: the ids and distances of the k nearest found in this block, ties to the smaller id."""
        most = min(len(self.ids), max(int(np.ceil(share * len(self.ids))), 8 * k + 1))
        for vector, uid, order in zip(asked, uids, nearest_pivots(asked, pivots, self.prefix), strict=True):
            gain = self.closeness(order)
            if most < len(gain):
                least = np.partition(gain, len(gain) - most)[len(gain) - most]
                above, level = np.flatnonzero(gain > least), np.flatnonzero(gain == least)
                some = np.concatenate([above, level[: most - len(above)]])
            else:
                some = np.arange(len(gain))
            some = some[self.uids[some] != uid]
            apart = self.vectors[some] - vector
            score = np.sqrt((apart * apart).sum(1))
            best = np.lexsort((self.ids[some], score))[:k]
            yield self.ids[some][best], score[best]


def fitted_share(vectors: np.ndarray, pivots: np.ndarray, prefix: int, k: int, recall: float, asked: int = 200) -> float:
    """The share of a sample that must be reranked by footrule to hold ``recall`` of the true k nearest of some of its vectors.

    In a larger table the k nearest are nearer, so their orders are more alike and the
    share errs on the side of recall.
    """
    n = len(vectors)
    if n <= 4 * k:
        return 1.0
    block, orders, at = Block.of(np.arange(n), np.arange(n), vectors, pivots, prefix), nearest_pivots(vectors, pivots, prefix), []
    place = np.argsort(block.uids)
    for q in range(min(asked, n)):
        far = ((vectors - vectors[q]) ** 2).sum(1)
        far[q] = np.inf
        near = np.argpartition(far, k)[:k]
        gain = block.closeness(orders[q])
        at += [(gain >= gain[place[x]]).sum() / n for x in near]
    return float(min(1.0, max(0.01, np.quantile(at, recall))))


def nearest(df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 10, pivots: int = 256, prefix: int = 20, share: float | None = None, recall: float = 0.92, block: int = 16384, chunk: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row for which is_query holds.

    A query's own row is no candidate; other rows of the same id or vector are.
    Vectors that are null, zero, or hold a null or non-finite component, rows
    without an id, and vectors not of the table's most usual length take no part.
    With no query or no candidate the result is empty. What reaches the driver is a
    sample that the order of a hash draws, of 8 * ``pivots`` rows: its first different
    vectors are the pivots, and on the others the share to rerank is fitted unless it is given.
    """
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    slim = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    slim = slim.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    slim = stored(slim.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    sizes = slim.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if("asks").alias("q"))
    usual = sizes.orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if usual is None or not usual["q"]:
        return df.sparkSession.createDataFrame([], schema)
    slim = slim.where(F.size("v") == usual["dim"])
    drawn = slim.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(8 * pivots).select("v").collect()
    sample = np.array(list(dict.fromkeys(tuple(r["v"]) for r in drawn)), np.float64)
    at = sample[:pivots]
    prefix = min(prefix, len(at))
    with one_thread():
        share = share or fitted_share(sample[pivots:], at, prefix, k, recall)  # pivots are no fair examples
    blocks = -(-usual["n"] // block)

    def build(rows: pa.Table) -> pa.Table:
        with one_thread():
            made = Block.of(rows["vec_id"].to_numpy(), rows["uid"].to_numpy(), matrix(rows["v"]), at, prefix)
        return pa.table([pa.array([rows["block"][0].as_py()], pa.int32()), *[pa.array([x], pa.binary()) for x in made.parts()]], names=["block", *PARTS])

    dealt = slim.select("vec_id", "uid", "v", F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    index = stored(dealt.groupBy("block").applyInArrow(build, "block int, " + ", ".join(f"{x} binary" for x in PARTS)), "permutation-index")
    # Each block's row comes before the queries sent to it.
    asked = slim.where("asks").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("vec_id").alias("query_id"), F.col("uid").alias("query_uid"), F.col("v").alias("asked"))
    both = index.unionByName(asked, allowMissingColumns=True).select("block", *PARTS, "query_id", "query_uid", "asked")
    routed = both.repartition(blocks, "block").sortWithinPartitions("block", F.col("query_id").asc_nulls_first())

    @tidied
    def meet(batches):
        held, number = None, None

        def answers(part):
            ids, uids = part.column("query_id").to_pylist(), part.column("query_uid").to_pylist()
            rows = [(qid, quid, i, s) for qid, quid, found in zip(ids, uids, held.search(matrix(part.column("asked")), uids, at, k, share), strict=True) for i, s in zip(*found, strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["query_id", "query_uid", "vec_id", "score"])

        for batch in batches:
            of, is_index = batch.column("block").to_numpy(), batch.column("query_uid").is_null().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0]) | is_index).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if is_index[a]:
                    held = Block({name: np.frombuffer(batch.column(name)[a].as_py(), kind) for name, kind in PARTS.items()}, prefix)
                    number, a = int(of[a]), a + 1
                if held is not None and number == of[min(a, b - 1)]:  # a block without vectors has no row, and its queries find nothing there
                    for lo in range(a, b, chunk):
                        yield answers(batch.slice(lo, min(chunk, b - lo)))

    found = routed.mapInArrow(meet, FOUND)
    order = Window.partitionBy("query_uid").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_permutation_ann(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
