"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is centred on its list's centroid, normalised, padded to the
code's length, rotated by one random rotation and cut to its signs: packed bits,
the residual's length and its product with its own code are what is kept.  The
inner product with a query, itself cut to four bits a component, is estimated by
counting common bits of packed words, with an error bound of ``eps`` standard deviations; what may be among the nearest by its lower bound is
measured exactly on the original vectors.

Rows and queries meet in cells: a block of rows of a list with a block of
queries that probe the list.  Blocks have a bounded size, however many rows a
list holds or how often one vector repeats, and a cell returns ``k`` rows per
query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows and queries of a cell; queries turned at once; rows that centroids and rotation are fitted on at most.
ROWS, QUERIES, AT_ONCE, SAMPLE = 16384, 2048, 128, 16384
#: Steps that a query's turned components are cut to: four bit planes.
LEVELS = 16


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation of ``dim`` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Centres of ``lists`` groups of the sample, by Lloyd's rounds; the mean for one list."""
    if lists <= 1 or len(sample) <= lists:
        return sample.mean(0, keepdims=True)
    at = sample[np.random.default_rng(seed).choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = _nearest(sample, at, 1)[:, 0]
        sums, n = np.zeros_like(at), np.bincount(near, minlength=lists)
        np.add.at(sums, near, sample)
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
    return at


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    d = (centres**2).sum(1) - 2 * x @ centres.T
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def encode(residuals: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths and the product of each unit residual with its code (1 where the length is 0)."""
    length = np.linalg.norm(residuals, axis=1)
    unit = residuals / np.where(length > 0, length, 1)[:, None] @ turn[: residuals.shape[1]]
    own = np.abs(unit).sum(1) / np.sqrt(unit.shape[1])
    return np.packbits(unit > 0, axis=1), length, np.where(length > 0, own, 1.0)


class Asked:
    """Queries against one list's codes: turned, cut to LEVELS steps of a scale of their own, as packed bit planes."""

    def __init__(self, queries: np.ndarray, turn: np.ndarray):
        turned = queries @ turn[: queries.shape[1]]
        self.far = np.linalg.norm(queries, axis=1)
        self.low = turned.min(1)
        step = (turned.max(1) - self.low) / (LEVELS - 1)
        self.step = np.where(step > 0, step, 1.0)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        kept = self.low[:, None] + self.step[:, None] * levels
        self.sum, self.lost = kept.sum(1), np.linalg.norm(turned - kept, axis=1)
        self.planes = [words_of(np.packbits(levels >> k & 1, axis=1)) for k in range(LEVELS.bit_length() - 1)]


def words_of(codes: np.ndarray) -> np.ndarray:
    """Packed bytes as 64-bit words."""
    return np.ascontiguousarray(codes).view(np.uint64)


def estimate(codes: np.ndarray, length: np.ndarray, own: np.ndarray, asked: Asked, j: int, bits: int, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated squared distances of query ``j`` to the rows of ``codes`` (64-bit words), and how far the truth may lie below or above.

    The inner product of a code with the query takes one AND and one count of bits per word and plane.
    """
    held = np.zeros(len(codes), np.int32)
    for k, plane in enumerate(asked.planes):
        for w in range(codes.shape[1]):
            held += np.bitwise_count(codes[:, w] & plane[j, w]).astype(np.int32) << k
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int32)
    inner = (2 * (asked.low[j] * ones + asked.step[j] * held) - asked.sum[j]) / np.sqrt(bits) / own
    far = asked.far[j]
    spread = np.sqrt(np.maximum(0, 1 - own**2)) / own / np.sqrt(bits - 1)
    slack = 2 * eps * length * (far * spread + asked.lost[j] / np.sqrt(bits) / own)
    return length**2 + far**2 - 2 * length * inner, slack


def cell_search(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, length: np.ndarray, own: np.ndarray, qids: np.ndarray, q: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, eps: float) -> tuple:
    """``(query ids, row ids, distances, reranked)``: of each query the ``k`` nearest rows that the bounds let through, and how many rows were measured."""
    out_q, out_i, out_d, out_n = [], [], [], []
    words, bits = words_of(codes), turn.shape[1]
    for at in range(0, len(q), AT_ONCE):
        part = q[at : at + AT_ONCE].astype(float)
        asked = Asked(part - centre, turn)
        for j in range(len(part)):
            guess, slack = estimate(words, length, own, asked, j, bits, eps)
            low = guess - slack
            low[ids == qids[at + j]] = np.inf
            first = np.argpartition(guess, min(4 * k, len(ids) - 1))[: 4 * k]
            first = first[low[first] < np.inf]
            exact = ((x[first] - part[j]) ** 2).sum(1)
            limit = np.partition(exact, k - 1)[k - 1] if len(first) >= k else np.inf
            chosen = np.nonzero((low <= limit * (1 + 1e-9)) & (low < np.inf))[0]
            chosen = np.union1d(chosen, first)
            exact = np.sqrt(((x[chosen] - part[j]) ** 2).sum(1))
            best = np.lexsort((ids[chosen], exact))[:k]
            out_q.append(np.full(len(best), qids[at + j]))
            out_i.append(ids[chosen][best])
            out_d.append(exact[best])
            out_n.append(np.full(len(best), len(chosen)))
    return tuple(np.concatenate(o) for o in (out_q, out_i, out_d, out_n))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, x)`` of the rows that can take part, ``x`` an array of floats if it is one, else of doubles."""
    x = F.col(vec_col)
    if vectors.schema[vec_col].dataType.simpleString() != "array<float>":  # floats travel as they are and are measured as doubles
        x = x.cast("array<double>")
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    some = F.exists("x", lambda v: v != 0)
    return vectors.select(F.col(id_col).alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine & some)


def search(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, bits: int = 256, eps: float = 1.9, lists: int = 1, probes: int = 1, seed: int = 11
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of every query its ``k`` nearest found by Euclidean distance.

    ``is_query``: a condition on ``vec_id``.  Candidates are all rows but those
    of the query's own id; fewer than ``k`` of them are all returned.  Ties go
    to the smaller id.  Vectors that are null or zero or hold nulls or
    non-finite numbers take no part, nor do null ids and vectors whose
    dimension is not the commonest one.  A query id that repeats is asked once,
    with its smallest vector; repeated candidates stay.  An empty table gives
    no rows; other columns are ignored.  ``lists`` and ``probes`` restrict a
    query to the lists of the nearest centroids, which pays where vectors form
    groups; one list scans all codes.  Centroids are fitted on SAMPLE rows at
    most, picked by a hash of the id.
    """
    spark, result = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vec_col)
    kinds = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not kinds:
        return spark.createDataFrame([], result)
    dim, total = kinds[0]
    bits = -(-max(bits, dim) // 64) * 64
    rows = rows.where(F.size("x") == dim)
    every = max(1, 2 * total // SAMPLE)
    picked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).select("x").limit(SAMPLE).toArrow()["x"].combine_chunks()
    sample = picked.flatten().to_numpy().reshape(-1, dim).astype(float) if len(picked) else np.zeros((1, dim))
    centres, seeds = centroids(sample, lists, seed), (bits, seed)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(*seeds)
        for b in batches:
            if len(b):
                x = b.column(1).flatten().to_numpy().reshape(len(b), dim).astype(float)
                near = _nearest(x, centres, 1)[:, 0]
                codes, length, own = encode(x - centres[near], turn)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int32()), packed, pa.array(length), pa.array(own)], ["vec_id", "x", "list", "code", "length", "own"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                near = _nearest(b.column(1).flatten().to_numpy().reshape(len(b), dim).astype(float), centres, probes)
                at = pa.array(np.repeat(np.arange(len(b)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(near.ravel(), pa.int32())], ["query_id", "q", "list"])

    kind = rows.schema["x"].dataType.simpleString()
    coded = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(code, f"vec_id long, x {kind}, list int, code binary, length double, own double")
    asked = rows.where(is_query).groupBy(F.col("vec_id").cast("long").alias("query_id")).agg(F.min("x").alias("q"))
    asked = cut(asked.mapInArrow(probe, f"query_id long, q {kind}, list int"))
    coded = cut(coded)
    # One row per list: as many as there are centroids.
    held = dict(coded.groupBy("list").count().collect())
    wanted = dict(asked.groupBy("list").count().collect())
    plan = [(int(i), -(-n // ROWS), -(-wanted[i] // QUERIES)) for i, n in held.items() if i in wanted]
    if not plan:
        return spark.createDataFrame([], result)
    plan = F.broadcast(spark.createDataFrame(plan, "list int, nr int, nq int"))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spread = F.struct("vec_id", F.monotonically_increasing_id())  # repeated ids over all blocks
    left = coded.join(plan, "list").withColumn("r", deal(spread, "nr")).withColumn("c", copies("nq")).drop("nr", "nq")
    right = asked.join(plan, "list").withColumn("r", copies("nr")).withColumn("c", deal("query_id", "nq")).drop("nr", "nq")

    def cell(t: pa.Table, u: pa.Table) -> pa.Table:
        found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        if t.num_rows and u.num_rows:
            flat = lambda c, n: c.combine_chunks().flatten().to_numpy().reshape(n, dim).astype(float)
            codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            found = cell_search(
                t.column("vec_id").to_numpy(), flat(t.column("x"), t.num_rows), codes, t.column("length").to_numpy(), t.column("own").to_numpy(),
                u.column("query_id").to_numpy(), flat(u.column("q"), u.num_rows), centres[t.column("list")[0].as_py()], rotation(*seeds), k, eps,
            )
        return pa.table(dict(zip(("query_id", "vec_id", "score", "reranked"), map(pa.array, found))))

    keys = ["list", "r", "c"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score double, reranked long").drop("reranked")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
