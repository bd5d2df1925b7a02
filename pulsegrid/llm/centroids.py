"""Exact integer k-means from JVM expressions: distances by zip_with and aggregate, centroids by column sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, stored

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
LIMIT = 1 << 27           # integer components stay below this, so that 64 squared differences fit a long


def _kept(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors of `dims` finite components, as integers floor(scale * x)."""
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    sound = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float(LIMIT // scale), F.lit(False)))
    rows = columns_of(vectors, "vec_id", "embedding").where((F.size("embedding") == dims) & sound)
    return rows.select("vec_id", F.transform("embedding", whole).alias("v"))


def _nearest(centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid; the smaller number wins a tie."""
    def squared(centroid: list[int]) -> Column:
        literal = F.array(*[F.lit(c).cast("bigint") for c in centroid])
        return F.aggregate(F.zip_with("v", literal, lambda x, c: (x - c) * (x - c)), F.lit(0).cast("bigint"), lambda a, b: a + b)

    return F.array_min(F.array(*[F.struct(squared(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def _of_cluster(values: dict[int, object], kind: str) -> Column:
    """The value of a row's cluster, from at most K literals."""
    return reduce(lambda done, kv: done.when(F.col("cluster") == kv[0], F.lit(kv[1])), values.items(), F.when(F.lit(False), F.lit(None))).cast(kind)


def centroid_clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are the rows of `vectors` (vec_id, embedding) with exactly `dims` components, none null, NaN, infinite or as large as
    LIMIT / scale (131072), beyond which a long could not hold a distance. Rows that repeat an id are vectors of their own. The
    first centroids are the `k` kept vectors with the least sha256 of "seed:vec_id"; null ids come last, equal ones go by their
    components. With fewer vectors there are fewer centroids, without any the result is empty. In each round every vector goes
    to the nearest centroid and every centroid that has vectors moves to the floor of their mean; one more assignment follows.

    A round is one pass over the vectors, stored once as integers, and one aggregation that combines into `k` rows before its
    shuffle. The driver holds k * dims numbers. Sums of a component fit a long up to 2^36 vectors; an inertia that does not is null.
    """
    kept = stored(_kept(vectors, dims, scale), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    centroids = [row["v"] for row in kept.orderBy(order, "v").limit(k).collect()]
    if not centroids:
        return kept.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (
            ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))])
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)]
    for _ in range(rounds):
        for row in kept.select(_nearest(centroids)["cluster"].alias("cluster"), "v").groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
            centroids[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    placed = stored(kept.select("vec_id", _nearest(centroids).alias("nearest")).select("vec_id", "nearest.cluster", "nearest.distance"), "placed")
    inertia = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda total: total if total < 1 << 63 else None
    named = F.array(*[F.sha2(F.lit(",".join(map(str, c))), 256) for c in centroids])
    return placed.select("vec_id", "cluster", "distance", _of_cluster({c: fits(s) for c, s in inertia.items()}, "bigint").alias("cluster_inertia"),
                         F.lit(fits(sum(inertia.values()))).cast("bigint").alias("inertia"), named[F.col("cluster")].alias("centroid_sha256"))


def _twin() -> str:
    """The same rounds as SQL: a chain of assignments and means."""
    assign = """SELECT id, vec_id, v, min(struct_pack(distance := d, cluster := k)) AS near FROM (SELECT p.*, c.k, list_sum(list_transform(
        list_zip(p.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint AS d FROM p, c{i} c) GROUP BY ALL"""
    mean = """SELECT k, list(((s - ((s % n) + n) % n) // n)::bigint ORDER BY j) AS c FROM (SELECT near.cluster AS k, j, sum(v[j])::bigint AS s, count(*) AS n
        FROM a{i}, (SELECT unnest(range(1, {dims} + 1)) AS j) GROUP BY 1, 2) GROUP BY k"""
    steps = []
    for i in range(ROUNDS):
        moved = mean.format(i=i, dims=DIMS)
        steps += [f"a{i} AS MATERIALIZED ({assign.format(i=i)})",
                  f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN ({moved}) m ON m.k = c.k)"]
    chain = ", ".join([*steps, f"a AS MATERIALIZED ({assign.format(i=ROUNDS)})"])
    return f"""
WITH p AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) AS v FROM embeddings
    WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1)::int AS k, v AS c FROM p QUALIFY k < {K}), {chain}
SELECT a.vec_id, a.near.cluster AS cluster, a.near.distance AS distance, (sum(a.near.distance) OVER (PARTITION BY a.near.cluster))::bigint AS cluster_inertia,
    (sum(a.near.distance) OVER ())::bigint AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a JOIN c{ROUNDS} c ON c.k = a.near.cluster"""


ORACLE = _twin()
