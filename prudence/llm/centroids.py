"""Clustering by Lloyd's rounds that only follow what changed.

Vectors lie once in a bucketed table; every round writes a narrow table of assignments, bucketed alike, so that the
next round joins both without an exchange. A round compares a vector with the centroids that changed, or with all of
them if its own one did. The vectors that changed hands leave one signed sum a task and centroid; global sums are
carried from round to round by these transfers. All arithmetic is on integers and exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudence.llm.features import released
from prudence.llm.scratch import bucketed, stored

#: Components beyond this size could make a squared distance overflow; they raise.
LARGEST = 2**27
#: Vectors of one bucket at most, and as many as make a bucket of their own worth while.
BUCKET_ROWS, LEAST_ROWS = 500_000, 8_000


def sound(vector: Column, size: int) -> Column:
    """Whether a vector has so many components, none null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    return F.coalesce((F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))


def quantized(vectors: DataFrame, size: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v, the integers floor(scale * component), of the sound vectors."""

    def whole(x: Column) -> Column:
        q = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < LARGEST, q.cast("int")).otherwise(F.raise_error(F.lit(f"a component is over {LARGEST // scale}")).cast("int"))

    kept = vectors.where(sound(F.col(vector_col), size))
    return kept.select(F.col(id_col).alias("vec_id"), F.transform(vector_col, whole).alias("v"))


def assigner(centroids: np.ndarray, changed: np.ndarray):
    """A step for mapInArrow: the nearest centroid of each vector, and at a task's end the signed sums of those that moved.

    A row of vectors has row, vec_id, v, cluster (-1: none yet) and distance. Rows of sums have no row number; their
    transfer holds the sum of each component and the number of vectors.
    """
    k, size = centroids.shape
    fresh = np.flatnonzero(changed)

    def nearest(x: np.ndarray, own: np.ndarray, dist: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least of (distance, number) among the given centroids and the vector's own one, if it has any."""
        own, dist = own.copy(), dist.copy()
        for j in among:
            step = x - centroids[j]
            d = np.einsum("ij,ij->i", step, step)
            better = (own < 0) | (d < dist) | ((d == dist) & (j < own))
            own[better], dist[better] = j, d[better]
        return own, dist

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, size + 1), np.int64)
        kind = None
        for batch in batches:
            kind = batch.schema.field("vec_id").type
            n = batch.num_rows
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, size)
            was, dist = batch.column("cluster").to_numpy().astype(np.int64), batch.column("distance").to_numpy().astype(np.int64)
            now, far = was.copy(), dist.copy()
            lost = (was < 0) | changed[np.maximum(was, 0)]
            now[lost], far[lost] = nearest(x[lost], np.full(lost.sum(), -1), dist[lost], np.arange(k))
            now[~lost], far[~lost] = nearest(x[~lost], was[~lost], dist[~lost], fresh)
            moved = now != was
            for j in range(k):
                came, went = x[moved & (now == j)], x[moved & (was == j)]
                sums[j, :size] += came.sum(0) - went.sum(0)
                sums[j, size] += len(came) - len(went)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array(now, pa.int32()), pa.array(far), pa.nulls(n, pa.list_(pa.int64()))], ["row", "vec_id", "cluster", "distance", "transfer"])
        if sums.any():
            none = pa.nulls(k)
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(kind), pa.array(np.arange(k), pa.int32()), none.cast(pa.int64()), pa.array(list(sums), pa.list_(pa.int64()))], ["row", "vec_id", "cluster", "distance", "transfer"])

    return released(run)


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """Vectors of the k smallest hashes of seed and vec_id; equal hashes by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r["v"]) for r in vectors.select("v", key.alias("h")).orderBy("h", "v").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Cluster vectors around k centroids.

    Returns one row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.
    Left out are null vectors, those of another size, and those with a null or non-finite component. A null vec_id
    counts as the empty text where first centroids are chosen; rows repeated with one id each count, and may each be
    a first centroid. With fewer than k vectors there are as many centroids as vectors; without any, or with an empty
    table, no rows. Components of 131,072 and more raise, since squared distances could overflow. Further columns are
    ignored. Rounds end early when no centroid changes any more, since later rounds would repeat the last.
    """
    base = stored(quantized(vectors, size, scale, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    start = first_centroids(base, k, seed)
    spark, kind = vectors.sparkSession, dict(base.dtypes)["vec_id"]
    schema = f"row bigint, vec_id {kind}, cluster int, distance bigint, transfer array<bigint>"
    if not start:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    n = base.count()
    buckets = max(min(spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)), -(-n // BUCKET_ROWS))
    rows = bucketed(base.repartition(buckets, "row"), "vectors", "row", buckets)
    centroids, changed = np.array(start, np.int64), np.ones(len(start), bool)
    sums = [[0] * (size + 1) for _ in start]
    owned = rows.withColumns({"cluster": F.lit(-1), "distance": F.lit(0).cast("long")})
    for turn in range(rounds + 1):
        found = owned.select("row", "vec_id", "v", "cluster", "distance").mapInArrow(assigner(centroids, changed), schema)
        last = turn == rounds or not changed.any()
        held = stored(found, "assigned") if last else bucketed(found, "assigned", "row", buckets)
        if last:
            break
        transfers = held.where("row IS NULL").select("cluster", F.posexplode("transfer").alias("i", "s"))
        for r in transfers.groupBy("cluster", "i").agg(F.sum("s").alias("s")).collect():
            sums[r["cluster"]][r["i"]] += r["s"]
        after = np.array([[x // s[size] for x in s[:size]] if s[size] else list(map(int, c)) for s, c in zip(sums, centroids, strict=True)], np.int64)
        centroids, changed = after, (after != centroids).any(1)
        own = held.where("row IS NOT NULL").select("row", "cluster", "distance").hint("shuffle_hash")
        owned = rows.join(own, "row")
    final = held.where("row IS NOT NULL").select("vec_id", "cluster", "distance")
    inertia = {r["cluster"]: r["d"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    number = F.col("cluster")
    by = lambda values, t: F.element_at(F.array(*(F.lit(v).cast(t) for v in values)), number + 1)
    return final.select("vec_id", "cluster", "distance", by([inertia.get(j, 0) for j in range(len(start))], "long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), by(digest, "string").alias("centroid_sha256"))


def oracle(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """DuckDB SQL with the same rows: every round compares every vector with every centroid."""
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, embedding AS e, row_number() OVER () AS row FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        f"x AS MATERIALIZED (SELECT row, unnest(range({size})) AS i, floor({scale} * unnest(e)::DOUBLE)::BIGINT AS x FROM kept)",
        f"first AS (SELECT row, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS j FROM kept QUALIFY j < {k})",
        "c0 AS MATERIALIZED (SELECT j, i, x AS c FROM first JOIN x USING (row))",
    ]
    for t in range(rounds + 1):
        parts.append(f"d{t} AS (SELECT row, j, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN c{t} USING (i) GROUP BY row, j)")
        parts.append(f"a{t} AS MATERIALIZED (SELECT row, arg_min(j, (d, j)) AS j, min(d) AS d FROM d{t} GROUP BY row)")
        if t < rounds:
            parts.append(f"m{t} AS (SELECT j, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{t} JOIN x USING (row) GROUP BY j, i)")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c{t}.j, c{t}.i, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{t} LEFT JOIN m{t} ON m{t}.j = c{t}.j AND m{t}.i = c{t}.i)")
    return (
        "WITH " + ",\n".join(parts) + f",\nh AS (SELECT j, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY j)\n"
        f"SELECT vec_id, a.j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} a JOIN kept USING (row) JOIN h ON h.j = a.j"
    )
