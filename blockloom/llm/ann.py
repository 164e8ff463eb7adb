"""Approximate nearest neighbours by cosine: inverted lists scanned with adaptive numbers of dimensions.

Vectors are scaled to length 1 and turned by a random rotation, so that the partial squared distance over the first
``d`` of ``D`` dimensions, times ``D / d``, estimates the whole distance with an error that shrinks as ``1 / sqrt(d)``.
Within each probed list, distances grow by one block of columns at a time, and a candidate whose estimate exceeds
the query's bound by more than ``(1 + eps / sqrt(d))`` is abandoned: the hypothesis that it is a neighbour is
rejected. What survives is scored exactly, in double precision, on the original vectors.

The bound is the distance of the k-th nearest of the different ids found so far: none at first, then tightened after
each chunk of a list, and from the query's own list to its other lists. All answers come from the lists. A query that
finds fewer than k ids in its probed lists goes on through the others.

Centroids and the number of probes are fitted on a bounded sample (``sample`` vectors); every row is indexed. Lists
are cut into blocks of at most ``block`` rows, as are the queries of a list, so that no task grows with a list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import table, written


@dataclass
class Index:
    """Bounded: at most 4096 centroids."""

    rotation: np.ndarray
    centroids: np.ndarray
    probes: int


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v array<double>) of vectors that have a cosine, and their dimension: the commonest one."""
    v = F.col(vector_col).cast("array<double>")
    fine = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))  # noqa: E731  NaN sorts above infinity
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0)
    )
    sizes = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes.d if sizes else 0
    return kept.where(F.size("v") == dim), dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosines(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, in double precision. A row's value depends on that row alone, so equal vectors tie exactly."""
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))


def fit(sample: np.ndarray, n_lists: int, k: int, target: float, seed: int = 7) -> Index:
    """Spherical k-means, and the probes that cover ``target`` of the sample's own k nearest neighbours."""
    rng = np.random.default_rng(seed)
    x = unit(sample)
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    x = x @ rotation
    n_lists = min(n_lists, len(x))
    c = x[rng.choice(len(x), n_lists, replace=False)]
    for _ in range(12):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    c = c[np.sort(np.unique(np.round(c, 9), axis=0, return_index=True)[1])]  # copies may have taken several
    n_lists = len(c)
    own = (x @ c.T).argmax(axis=1)
    asked = rng.choice(len(x), min(500, len(x)), replace=False)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    order = np.argsort(np.argsort(-(x[asked] @ c.T), axis=1), axis=1)  # the place of each list in each query's order
    places = np.sort(np.take_along_axis(order, own[near], axis=1).ravel())
    probes = int(places[min(len(places) - 1, int(target * len(places)))]) + 1 if len(places) else n_lists
    return Index(rotation, c, min(n_lists, probes + 1))


def scan(q: np.ndarray, v: np.ndarray, bound: np.ndarray, step: int, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no test abandons; an infinite bound abandons none. All are rotated unit vectors."""
    dim, slack = q.shape[1], 1e-9
    first = slice(0, min(step, dim))
    part = (q[:, first] ** 2).sum(1)[:, None] + (v[:, first] ** 2).sum(1)[None, :] - 2 * (q[:, first] @ v[:, first].T)
    limit = lambda d: 1.0 if d >= dim else max(1e-300, (1 + eps / np.sqrt(d)) ** 2 * d / dim)
    i, j = np.nonzero(part <= bound[:, None] * limit(first.stop) + slack)
    part = part[i, j]
    for at in range(first.stop, dim, step):
        end = min(at + step, dim)
        part = part + ((q[i, at:end] - v[j, at:end]) ** 2).sum(axis=1)
        keep = part <= bound[i] * limit(end) + slack
        i, j, part = i[keep], j[keep], part[keep]
    return i, j


def first_k(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query ``i``, its k best different ids, each with its best score; ties to the smaller id."""
    order = np.lexsort((-score, ids, i))
    i, ids, score = i[order], ids[order], score[order]
    once = np.ones(len(i), bool)
    once[1:] = (i[1:] != i[:-1]) | (ids[1:] != ids[:-1])
    i, ids, score = i[once], ids[once], score[once]
    order = np.lexsort((ids, -score, i))
    i, ids, score = i[order], ids[order], score[order]
    top = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[top], ids[top], score[top]


def distance_bound(score: np.ndarray | Column) -> np.ndarray | Column:
    """The squared distance of unit vectors with this cosine."""
    return 2 - 2 * score


def search_block(
    q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, ids: np.ndarray, v: np.ndarray, rotation: np.ndarray, k: int, step: int, eps: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of the k best of a block for each query, none beyond its bound. The block is scanned in
    growing chunks, after each of which the bounds are those of the k-th best so far."""
    turned, asked, bound = unit(v) @ rotation, unit(q) @ rotation, bound.copy()
    i, found, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    at, size = 0, 64
    while at < len(v):
        a, b = scan(asked, turned[at : at + size], bound, step, eps)
        b += at
        other = q_ids[a] != ids[b]
        a, b = a[other], b[other]
        exact = [cosines(v[b[s : s + 65_536]], q[a[s : s + 65_536]]) for s in range(0, len(a), 65_536)]
        i, found, score = first_k(np.append(i, a), np.append(found, ids[b]), np.concatenate([score, *exact]), k)
        last = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) == k - 1)
        bound[i[last]] = np.minimum(bound[i[last]], distance_bound(score[last]))
        at, size = at + size, min(1_024, 2 * size)
    return i, found, score


HITS = "query_id long, vec_id long, score double"


def search(
    vectors: DataFrame,
    query_every: int = 50,
    k: int = 5,
    sample: int = 20_000,
    target: float = 0.98,
    step: int = 16,
    eps: float = 2.1,
    block: int = 65_536,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest ids found for each id divisible by ``query_every``.

    Returns query_id, rank (from 1), vec_id, score (the cosine), nearest first, ties to the smaller vec_id; all
    candidates, if fewer than ``k`` exist. A query's candidates are the rows with another vec_id.

    Defined results: rows with a null id, and vectors that are null, empty, zero, hold a null or non-finite component
    or have another than the commonest dimension (ties: the smaller) take no part. A repeated id is one query, and is
    listed once for a query however often it occurs; where its rows hold different vectors, the query asks with the
    one whose bytes come first, and as a candidate it has the best score of them. An empty table gives no row; other
    columns are not read.
    """
    spark = vectors.sparkSession
    kept, dim = usable(vectors, id_col, vector_col)
    n = kept.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share, scale = min(1.0, 2 * sample / n), 10**12
    few = kept.select("v", F.xxhash64("v").alias("h")).where(F.pmod("h", F.lit(scale)) < max(1, int(share * scale)))
    some = few.dropDuplicates(["v"]).orderBy("h", "v").limit(sample).select("v").toArrow()  # copies count once
    if not some.num_rows:
        some = kept.limit(sample).select("v").toArrow()
    n_lists = int(min(4_096, max(16, 2 ** round(np.log2(np.sqrt(n) / 2)))))
    index = fit(matrix(some["v"].combine_chunks(), dim), n_lists, k, target)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("v"), dim)
            near = unit(v) @ index.rotation @ index.centroids.T
            raw = np.ascontiguousarray(v).astype("<f8")
            own = pa.array(near.argmax(axis=1).astype("int32"))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), pa.array([r.tobytes() for r in raw], pa.binary()), own], names=["row", "vec_id", "raw", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = np.stack([np.frombuffer(x.as_py(), "<f8") for x in b.column("raw")])
            lists = np.argsort(-(unit(v) @ index.rotation @ index.centroids.T), axis=1, kind="stable")[:, : index.probes].astype("int32")
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("raw"), pa.array(list(lists), pa.list_(pa.int32()))], names=["vec_id", "raw", "lists"])

    def best(_, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})]
        if len(mine) and len(theirs):
            mine = mine.drop_duplicates(["raw", "vec_id"]).sort_values("vec_id")
            mine = mine[mine.groupby("raw").cumcount() <= k]  # equal vectors tie, so larger ids than these never rank
            ids, v = mine.vec_id.to_numpy(), np.frombuffer(b"".join(mine.raw), "<f8").reshape(-1, dim)
            for at in range(0, len(theirs), 512):
                part = theirs.iloc[at : at + 512]
                q_ids, q = part.vec_id.to_numpy(), np.frombuffer(b"".join(part.raw), "<f8").reshape(-1, dim)
                i, found, score = search_block(q_ids, q, part.bound.to_numpy(), ids, v, index.rotation, k, step, eps)
                out.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": found, "score": score}))
        return pd.concat(out[1:] or out)

    tagged = kept.withColumn("row", F.monotonically_increasing_id())
    members = written(tagged.mapInArrow(place, "row long, vec_id long, raw binary, list int"), "ann-members")
    asked = members.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("raw").alias("raw"))
    queries = written(asked.mapInArrow(probe, "vec_id long, raw binary, lists array<int>"), "ann-queries")
    block = min(block, max(1_024, 4 * n // len(index.centroids)))  # a list above four times the mean is several blocks
    sizes = written(members.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("m_cuts")), "ann-sizes")

    def visit(pairs: DataFrame, label: str) -> DataFrame:
        """The hits of (vec_id, raw, bound, list) rows. Blocks of members meet blocks of queries of their list."""
        cuts = F.broadcast(sizes.join(pairs.groupBy("list").agg(F.ceil(F.count("*") / 4_096).cast("int").alias("q_cuts")), "list"))
        held = (
            members.join(cuts, "list")  # at most 4096 rows
            .withColumn("mb", F.pmod(F.xxhash64("row"), F.col("m_cuts")).cast("int"))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q_cuts") - 1)))
        )
        wanted = (
            pairs.join(cuts, "list")
            .withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.col("q_cuts")).cast("int"))
            .withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("m_cuts") - 1)))
        )
        key = ["list", "mb", "qb"]
        sides = held.select(*key, "vec_id", "raw").groupBy(*key).cogroup(wanted.select(*key, "vec_id", "raw", "bound").groupBy(*key))
        return written(sides.applyInPandas(best, HITS), label)

    by_rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(hits: DataFrame) -> DataFrame:
        once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)

    def bounded(hits: DataFrame) -> DataFrame:
        """The queries with the distance of their k-th best so far, infinite where they have fewer."""
        kth = ranked(hits).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), distance_bound(F.col("score")).alias("bound"))
        return queries.join(kth, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    hits = visit(queries.select("vec_id", "raw", F.lit(float("inf")).alias("bound"), F.col("lists")[0].alias("list")), "ann-own")
    if index.probes > 1:
        others = F.explode(F.slice("lists", 2, index.probes)).alias("list")
        hits = hits.unionByName(visit(bounded(hits).select("vec_id", "raw", "bound", others), "ann-probed"))
    short = bounded(hits).where(F.col("bound") == float("inf"))
    if index.probes < len(index.centroids) and not short.isEmpty():
        everything = F.sequence(F.lit(0), F.lit(len(index.centroids) - 1))
        hits = hits.unionByName(visit(short.select("vec_id", "raw", "bound", F.explode(F.array_except(everything, "lists")).alias("list")), "ann-more"))
    return ranked(hits).select("query_id", "rank", "vec_id", "score")


def op1_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest neighbours of every 50th vector among all others."""
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
