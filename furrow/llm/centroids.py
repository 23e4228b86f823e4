"""Centroid clustering of integer vectors by scalar look-up tables.

Components become whole numbers, so sums, means and distances are exact in any order.
In every round a task tabulates, for each dimension, the squared difference of every
integer that occurs there to every centroid; a vector's distances are then sums of
table entries gathered by its integers.  A task sends one row a centroid (count,
component sums), Spark adds them up, and only these few rows reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.vectors import finite, large_pieces, matrix
from furrow.session import cut_lineage

#: Vectors that one set of tables serves.
PIECE_ROWS = 16_384
#: Squared distances must fit a 64-bit integer.
MOST_DISTANCE = 1 << 62


class Tally(NamedTuple):
    """What a pass over all vectors tells about one centroid."""

    count: int
    sums: list[int]
    distance: int


def integers(vectors: DataFrame, dim: int = 64, scale: int = 1024, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id`` and ``ints``, floor(scale * x), of the rows with exactly ``dim`` finite components.

    Rows that are null, of another length, or hold null, NaN or infinite components are left out;
    null and repeated ids stay, each row a vector of its own.  A component so large that a squared
    distance would not fit a long is an error.
    """
    most = math.isqrt(MOST_DISTANCE // dim) // 2
    value = lambda x: F.when(F.abs(x.cast("double") * scale) < most, F.floor(x.cast("double") * scale)).otherwise(
        F.raise_error(F.concat(F.lit("component too large for whole distances: "), x.cast("string"))).cast("long"))
    kept = vectors.select(F.col(key).alias("vec_id"), F.col(column).alias("vector")).filter((F.size("vector") == dim) & finite(F.col("vector")))
    return kept.select("vec_id", F.transform("vector", value).alias("ints"))


def first_centroids(ints: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """Vectors of the smallest sha256 of ``seed:vec_id``; equal ids by their components, null ids last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    return np.array([r["ints"] for r in ints.orderBy(order, "ints").limit(clusters).collect()], dtype=np.int64)


def assign(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number) and squared distance of each vector."""
    distance = np.zeros((len(vectors), len(centres)), np.int64)
    for d in range(vectors.shape[1]):
        occurring, code = np.unique(vectors[:, d], return_inverse=True)
        table = (occurring[:, None] - centres[:, d]) ** 2
        distance += table[code]
    nearest = distance.argmin(axis=1)
    return nearest, distance[np.arange(len(vectors)), nearest]


def tally(ints: DataFrame, centres: np.ndarray) -> list[Tally]:
    """Count, component sums and summed distance of the vectors nearest to each centroid."""
    clusters, dim = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(clusters, np.int64), np.zeros((clusters, dim), np.int64)
        # The distances' upper and lower halves are added apart, so that neither sum overflows.
        high, low = np.zeros(clusters, np.int64), np.zeros(clusters, np.int64)
        for piece in large_pieces(batches, PIECE_ROWS):
            vectors = matrix(piece.column("ints"), dim, np.int64)
            nearest, distance = assign(vectors, centres)
            for c in range(clusters):
                own = nearest == c
                count[c] += own.sum()
                sums[c] += vectors[own].sum(axis=0)
                high[c] += (distance[own] >> 32).sum()
                low[c] += (distance[own] & 0xFFFFFFFF).sum()
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(clusters), pa.int32()), "count": count, "sums": pa.array(sums.tolist(), pa.list_(pa.int64())), "high": high, "low": low})

    whole = lambda c: F.sum(c.cast("decimal(38,0)"))
    parts = ints.select("ints").mapInArrow(run, "cluster int, count long, sums array<long>, high long, low long")
    total = parts.groupBy("cluster").agg(F.sum("count").alias("count"), F.array(*[whole(F.col("sums")[d]) for d in range(dim)]).alias("sums"), whole(F.col("high")).alias("high"), whole(F.col("low")).alias("low"))
    out = [Tally(0, [0] * dim, 0)] * clusters
    for r in total.collect():
        out[r["cluster"]] = Tally(r["count"], [int(x) for x in r["sums"]], (int(r["high"]) << 32) + int(r["low"]))
    return out


def clustered(vectors: DataFrame, clusters: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Cluster of every vector after ``rounds`` rounds: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A round assigns every vector to the nearest centroid and moves each centroid with vectors to
    their floored mean; centroids without vectors stay.  Fewer vectors than clusters make as many
    centroids as there are vectors; no vectors, no rows.  Repeated vectors count each; ties go to
    the smaller centroid.  Other columns of the input are not read.
    """
    ints = cut_lineage(integers(vectors, dim, scale, key, column), "integers")
    centres = first_centroids(ints, clusters, seed).reshape(-1, dim)
    for _ in range(rounds if len(centres) else 0):
        centres = np.array([[s // t.count for s in t.sums] if t.count else c.tolist() for t, c in zip(tally(ints, centres), centres, strict=True)], dtype=np.int64)
    inertia = [t.distance for t in tally(ints, centres)] if len(centres) else []
    if sum(inertia) >= 1 << 63:
        raise ValueError("the summed distances do not fit a long")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in large_pieces(batches, PIECE_ROWS):
            nearest, distance = assign(matrix(piece.column("ints"), dim, np.int64), centres)
            ids = pa.concat_arrays(piece.column("vec_id").chunks)
            yield pa.RecordBatch.from_arrays([ids, pa.array(nearest, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = ints.schema["vec_id"].dataType.simpleString()
    found = ints.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")
    of = lambda values, type_: F.element_at(F.array(*[F.lit(v) for v in values] or [F.lit(None)]).cast(f"array<{type_}>"), F.col("cluster") + 1)
    return found.select("vec_id", "cluster", "distance", of(inertia, "bigint").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"))


def cluster_sql(clusters: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same clusters as one DuckDB statement, a few common table expressions a round."""
    steps = [
        f"""whole AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS ints,
            row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, embedding) AS place
            FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"centres_0 AS MATERIALIZED (SELECT place - 1 AS cluster, ints FROM whole WHERE place <= {clusters})",
    ]
    for i in range(rounds + 1):
        steps.append(f"""near_{i} AS MATERIALIZED (SELECT place, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM (
            SELECT w.place, c.cluster, list_sum(list_transform(list_zip(w.ints, c.ints), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS HUGEINT))) AS distance
            FROM whole w, centres_{i} c) GROUP BY place)""")
        if i < rounds:
            steps.append(f"""centres_{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.ints, c.ints) AS ints FROM centres_{i} c LEFT JOIN (
                SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS ints FROM (
                    SELECT cluster, d, sum(x) AS s, CAST(count(*) AS HUGEINT) AS n FROM (
                        SELECT cluster, unnest(ints) AS x, generate_subscripts(ints, 1) AS d FROM near_{i} JOIN whole USING (place)) GROUP BY cluster, d)
                GROUP BY cluster) m USING (cluster))""")
    return "WITH " + ",\n".join(steps) + f"""
        SELECT w.vec_id, CAST(n.cluster AS INTEGER) AS cluster, CAST(n.distance AS BIGINT) AS distance, CAST(sum(n.distance) OVER (PARTITION BY n.cluster) AS BIGINT) AS cluster_inertia,
        CAST(sum(n.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.ints, ',')) AS centroid_sha256
        FROM whole w JOIN near_{rounds} n USING (place) JOIN centres_{rounds} c ON c.cluster = n.cluster"""
