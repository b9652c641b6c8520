"""Centroid clustering by ball k-means on whole numbers (operator 12).

A cluster is a ball: its centroid and the distance of its farthest member. Of
the other centroids only those nearer than twice that radius can take a member
away: these are the ball's neighbours. Members nearer to their centroid than
half the way to the nearest neighbour are the stable core and are compared
with nothing. The others lie in annuli, between half the way to one neighbour
and half the way to the next, and are compared exactly with those neighbours
whose half way they lie beyond.

Components become whole numbers, so sums, distances and ties are exact and a
result does not depend on how Spark deals the rows. Which ball a vector is
known to be in is a hint only: any hint gives the nearest centroid. Hints are
written with the vectors after rounds 1, 2, 4, 8 ..., since they settle;
other rounds read, and send k rows of sums for each task.

Free style: numpy on Arrow batches. Only centroids, a fixed number, pass
through the driver.

Defined results: vectors with another number of components, or with a null or
non-finite one, are left out; a null vec_id is hashed as an empty one; starts
with equal hashes are ordered by vec_id and components; with fewer vectors than
k there are as many centroids as vectors; whole components are held within
plus and minus 2^26, so that distances fit a long; repeated rows count as often
as they come; an empty table gives an empty result; columns of any name but
those of the result are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE = 1024
BOUND = 1 << 26


def whole_vectors(df: DataFrame, size: int, scale: int = SCALE) -> DataFrame:
    """vec_id, x array<int>: the vectors with `size` finite components, as floor(scale * component)."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    number = lambda v: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(v.cast("double") * scale))).cast("int")
    return df.where((F.size("embedding") == size) & finite).select("vec_id", F.transform("embedding", number).alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, hint: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), its squared distance, and how many distances were taken."""
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    best, least, taken = hint.astype(np.int64).copy(), np.zeros(len(x), np.int64), 0
    for i in np.unique(hint):
        members = np.flatnonzero(hint == i)
        own = x[members]
        d = squared(own, centroids[i])
        taken += len(members)
        order = np.argsort(between[i], kind="stable")
        order = order[order != i]
        # beyond half the way to how many of the neighbours, ascending
        ring = np.searchsorted(between[i][order], 4 * d, side="right")
        to, near = np.full(len(members), i, np.int64), d.copy()
        for k in range(int(ring.max(initial=0))):
            at = np.flatnonzero(ring > k)
            j = int(order[k])
            e = squared(own[at], centroids[j])
            taken += len(at)
            closer = (e < near[at]) | ((e == near[at]) & (j < to[at]))
            near[at[closer]], to[at[closer]] = e[closer], j
        best[members], least[members] = to, near
    return best, least, taken


def batch_of(b: pa.RecordBatch, size: int) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, x, cluster, distance: each vector in its nearest centroid's ball; table's cluster is the hint."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to, d, _ = nearest(batch_of(b, size), b.column("cluster").to_numpy(zero_copy_only=False), centroids)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(to.astype(np.int32)), pa.array(d)], ["vec_id", "x", "cluster", "distance"])

    kind = table.schema["vec_id"].dataType.simpleString()
    return table.select("vec_id", "x", "cluster").mapInArrow(run, f"vec_id {kind}, x array<int>, cluster int, distance bigint")


def sums(table: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """Centroids after a round, and the distances it took. Tasks send a row for each ball they met."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, taken = np.zeros((k, size), np.int64), np.zeros(k, np.int64), 0
        for b in batches:
            x = batch_of(b, size)
            to, _, n = nearest(x, b.column("cluster").to_numpy(zero_copy_only=False), centroids)
            taken += n
            for i in np.unique(to):
                total[i] += x[to == i].sum(0)
                count[i] += int((to == i).sum())
        met = np.flatnonzero(count)
        tests = np.where(np.arange(len(met)) == 0, taken, 0)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met].tolist(), pa.list_(pa.int64())), pa.array(count[met]), pa.array(tests)], ["cluster", "total", "n", "tests"])

    parts = table.select("x", "cluster").mapInArrow(run, "cluster int, total array<bigint>, n bigint, tests bigint")
    wide = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("tests").alias("tests"), *[F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"c{i}") for i in range(size)])
    out, tests = centroids.copy(), 0
    # a row for each centroid
    for r in wide.collect():
        tests += r["tests"]
        out[r["cluster"]] = [int(r[f"c{i}"]) // int(r["n"]) for i in range(size)]
    return out, tests


def starts(table: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least hash of seed and vec_id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r["x"] for r in table.select("x", "vec_id", key.alias("key")).orderBy("key", "vec_id", "x").limit(k).collect()], np.int64)


def ball_kmeans(df: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, seed: int = 3, scale: int = SCALE) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, x, cluster, distance), the final centroids, and the distances taken in each round."""
    common.narrow_batches(df.sparkSession)
    table = common.cut(whole_vectors(df, size, scale).withColumn("cluster", F.lit(0)))
    centroids, taken = starts(table, k, seed), []
    if not len(centroids):
        return table.withColumn("distance", F.lit(0).cast("bigint")), np.zeros((0, size), np.int64), []
    for n in range(1, rounds + 1):
        if n & (n - 1) == 0:
            before, table = table, common.cut(assigned(table, centroids).drop("distance"))
            common.drop(before)
        centroids, tests = sums(table, centroids)
        taken.append(tests)
    out = common.cut(assigned(table, centroids))
    common.drop(table)
    return out, centroids, taken


def op12(spark, sf_dir: str) -> DataFrame:
    vectors, centroids, _ = ball_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    inertia = {r["cluster"]: int(r["d"]) for r in vectors.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    rows = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    # a row for each centroid
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return vectors.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sql(k: int = 8, rounds: int = 10, size: int = 64, seed: int = 3) -> str:
    """The rounds written out one after another, every vector compared with every centroid."""
    number = f"greatest(-{BOUND}, least({BOUND}, floor({SCALE} * v::DOUBLE)))::BIGINT"
    steps = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: {number}) AS x FROM embeddings WHERE len(embedding) = {size} "
        "AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding))",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY key, vec_id, x) - 1)::INT AS c, x FROM (SELECT *, sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS key FROM v) ORDER BY key, vec_id, x LIMIT {k})",
    ]
    for n in range(rounds + 1):
        d = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min({{'c': c.c, 'd': {d}}}, {{'d': {d}, 'c': c.c}}) AS best FROM v CROSS JOIN c{n} AS c GROUP BY r)")
        if n < rounds:
            below = "((sum(x[i])::HUGEINT - (((sum(x[i])::HUGEINT % count(*)) + count(*)) % count(*))) // count(*))::BIGINT"
            exact = f"SELECT best.c AS c, i, {below} AS m FROM cells GROUP BY 1, 2"
            steps.append(
                f"c{n + 1} AS MATERIALIZED (WITH cells AS (SELECT best, x, unnest(range(1, {size + 1})) AS i FROM a{n} JOIN v USING (r)), means AS ({exact}), "
                f"new AS (SELECT c, list(m ORDER BY i) AS x FROM means GROUP BY c) SELECT o.c, coalesce(new.x, o.x) AS x FROM c{n} AS o LEFT JOIN new USING (c))"
            )
    return (
        "WITH " + ", ".join(steps) + f" SELECT v.vec_id, best.c::INT AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, "
        f"sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} AS c ON c.c = best.c"
    )


OP12_SQL = op12_sql()
