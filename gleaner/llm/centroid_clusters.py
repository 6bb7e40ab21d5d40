"""Centroid clustering in JVM expressions (operator 13): no Python runs over the rows.

A vector becomes an array of integers once (``quantized``, written to the shared folder).
In each round the centroids are literal arrays of the plan: ``zip_with`` and ``aggregate``
give a vector's squared integer distance to every centroid, ``array_min`` over structs
(distance, number) chooses the cluster, and sums of the array's components by cluster,
combined before the shuffle, are all that is moved: ``k`` rows a task, ``k`` rows to the
driver, whatever the table's size. The driver divides those sums exactly and puts the new
centroids into the next round's plan, so no lineage grows. Once no centroid changes, later
rounds would change nothing and are not run.

All arithmetic is in integers: partitions, their order and retried tasks cannot change a result.

Defined cases: vectors that are null, of another length, or with a null or non-finite
component are left out; a component beyond +-2**27 after scaling counts as that bound, as
its square would leave 64 bits; repeated rows are vectors of their own; rows with one
vec_id are ordered by their components where the first centroids are drawn; a null vec_id
hashes as the empty text; fewer vectors than ``k`` give as many centroids; an empty table
gives no rows; a sum of distances beyond 64 bits is null; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut

K = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SEED = 3
BOUND = 1 << 27


def quantized(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """(vec_id, q): the kept vectors' components as integers floor(scale * x)."""
    x = F.col(f"`{column}`")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    scaled = lambda v: F.greatest(F.least(F.floor(F.lit(float(scale)) * v.cast("double")), F.lit(BOUND)), F.lit(-BOUND))
    bounded = lambda v: F.greatest(F.least(v.cast("double"), F.lit(float(BOUND))), F.lit(-float(BOUND)))
    return vectors.filter((F.size(x) == dimensions) & finite).select("vec_id", F.transform(x, lambda v: scaled(bounded(v)).cast("long")).alias("q"))


def first_centroids(q: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The ``k`` vectors with the smallest hashes of their ids: at most ``k`` rows come to the driver."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["q"]) for r in q.select("q", h.alias("h")).orderBy("h", "q").limit(k).collect()]


def nearest(q: Column, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid; the smaller number on a tie."""

    def distance(centroid: list[int]) -> Column:
        literal = F.expr("array(" + ",".join(f"{c}L" for c in centroid) + ")")
        gap = F.zip_with(q, literal, lambda a, b: a - b)
        return F.aggregate(gap, F.lit(0).cast("long"), lambda total, g: total + g * g)

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def moved(q: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round; those without vectors stay."""
    sums = [F.expr(f"sum(get(q, {i})) AS s{i}") for i in range(len(centroids[0]))]
    rows = q.select("q", nearest(F.col("q"), centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()
    new = list(centroids)
    for r in rows:
        new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(len(centroids[0]))]
    return new


def fit(q: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """Centroids after ``rounds`` rounds from the seeded start; an empty list for an empty table."""
    centroids = first_centroids(q, k, seed)
    for _ in range(rounds if centroids else 0):
        new = moved(q, centroids)
        if new == centroids:
            break
        centroids = new
    return centroids


def assign(q: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``q`` with cluster and distance."""
    best = q.withColumn("best", nearest(F.col("q"), centroids))
    return best.select(*q.columns, F.col("best.cluster").alias("cluster"), F.col("best.distance").alias("distance"))


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE, column: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, q, cluster, distance) of every kept vector, and the final centroids."""
    q = cut(quantized(vectors, dimensions, scale, column))
    centroids = fit(q, k, rounds, seed)
    if not centroids:
        return q.select("*", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), centroids
    return assign(q, centroids), centroids


def digest(vectors: DataFrame) -> DataFrame:
    """The query's columns. The clusters' sums of distances are ``K`` rows, attached as literals."""
    assigned, centroids = cluster(vectors)
    total = F.try_sum("distance")
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(total.alias("s")).collect()}
    known = [s for s in sums.values() if s is not None]
    whole = sum(known) if len(known) == len(sums) and sum(known) < 1 << 63 else None
    of = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values] or [F.lit(None).cast(kind)]), F.col("cluster"))
    text = [",".join(map(str, c)) for c in centroids]
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        of([sums.get(i) for i in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(whole).cast("long").alias("inertia"),
        F.sha2(of(text, "string"), 256).alias("centroid_sha256"),
    )


def _oracle() -> str:
    """DuckDB SQL: the same rounds, each a materialised step over rows of single components."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS rid, vec_id, q FROM (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}))""",
        f"c0 AS MATERIALIZED (SELECT rid AS cluster, q AS c FROM v WHERE rid < {K})",
    ]
    assigned = """a{r} AS MATERIALIZED (SELECT rid, min(struct_pack(distance := list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, cluster := cluster)) AS best FROM v, c{r} GROUP BY rid)"""
    for r in range(ROUNDS):
        steps += [
            assigned.format(r=r),
            f"""m{r} AS MATERIALIZED (SELECT cluster, list(m ORDER BY i) AS c FROM (
  SELECT best.cluster AS cluster, i, CAST((sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*) AS BIGINT) AS m
  FROM (SELECT rid, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM v) JOIN a{r} USING (rid) GROUP BY ALL) GROUP BY cluster)""",
            f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))",
        ]
    steps.append(assigned.format(r=ROUNDS))
    return f"""WITH {", ".join(steps)}
SELECT vec_id, cluster::INTEGER AS cluster, best.distance AS distance, sum(best.distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(best.distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} USING (rid) JOIN c{ROUNDS} ON cluster = best.cluster"""


ORACLE = _oracle()
