import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import centroids, multi_index
from furrow.llm import queries as Q

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, ints string, i string, score string"


def table(spark, rows):
    """Vectors (vec_id, embedding) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x", "x") for i, v in rows], SCHEMA)


def wide(*head):
    return [float(x) for x in head] + [0.0] * (64 - len(head))


AWKWARD = [
    (0, wide(1, 2)), (50, wide(1, 2)), (50, wide(1, 2)), (100, wide(3, -1)), (100, wide(1, 1)), (None, wide(1, 5)), (7, None), (8, []), (9, wide()), (10, wide(NAN, 1)),
    (11, wide(INF)), (12, [None] + [1.0] * 63), (13, wide(-1, -2)), (14, wide(2, 4)), (15, [1.0, 2.0]), (150, wide(-3, 7)),
]


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def plain_clusters(rows, clusters=8, rounds=10, dim=64):
    """Lloyd's rounds on Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(centres)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            if members:
                centres[n] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    total = sum(d for *_, d in found)
    inertia = {n: sum(d for _, o, d in found if o == n) for n in range(len(centres))}
    return sorted(((i, n, d, inertia[n], total, hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, n, d in found), key=str)


def test_clusters_agree_with_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    df = Q.op11_centroids(spark, sf)
    cur = con.execute(centroids.cluster_sql())
    assert df.columns == [d[0] for d in cur.description]
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())


def test_clusters_agree_with_plain_rounds(spark, vectors):
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    assert sorted(map(tuple, centroids.clustered(vectors).collect()), key=str) == plain_clusters(rows)


def test_clusters_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(centroids, "PIECE_ROWS", 2)
    got = centroids.clustered(table(spark, AWKWARD))
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(AWKWARD)


def test_clusters_of_few_or_no_vectors(spark):
    few = [(5, wide(1)), (5, wide(1)), (6, wide(2))]
    assert sorted(map(tuple, centroids.clustered(table(spark, few)).collect()), key=str) == plain_clusters(few)
    assert centroids.clustered(table(spark, [])).collect() == [] and centroids.clustered(table(spark, [(1, None)])).collect() == []


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="component too large"):
        centroids.clustered(table(spark, [(1, wide(1e30))])).collect()


def test_tables_serve_any_integers():
    rng = np.random.default_rng(4)
    points, centres = rng.integers(-3000, 3000, (500, 5)), rng.integers(-3000, 3000, (4, 5))
    nearest, distance = centroids.assign(points, centres)
    plain = ((points[:, None] - centres) ** 2).sum(axis=2)
    assert (nearest == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()


def plain_nearest(rows, k=5, step=50):
    """Exact cosine neighbours of every ``step``-th id: {query: [(id, score)]}."""
    best = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or not all(x is not None and math.isfinite(x) for x in v) or not any(v):
            continue
        best[i] = min(best.get(i, v), v)
    ids = sorted(best)
    dim = max((len(v) for v in best.values()), default=0)
    m = np.array([best[i] + [0.0] * (dim - len(best[i])) for i in ids], dtype=np.float64).reshape(len(ids), dim)
    out = {}
    for at, q in enumerate(ids):
        if q % step == 0:
            score = (m * m[at]).sum(axis=1) / (np.sqrt((m * m).sum(axis=1)) * np.sqrt((m[at] * m[at]).sum()))
            order = sorted((-s, i) for s, i in zip(score.tolist(), ids, strict=True) if i != q)[:k]
            out[q] = [(i, -s) for s, i in order]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_of_neighbours(spark, sf, vectors):
    got = by_query(Q.op13_multi_index(spark, sf))
    want = plain_nearest([(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    assert got.keys() == want.keys() and all(len(got[q]) == 5 for q in want)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 5 * len(want)
    scores = {(q, i): s for q, row in plain_nearest([(r["vec_id"], r["embedding"]) for r in vectors.collect()], k=500).items() for i, s in row}
    assert all(s == pytest.approx(scores[q, i], abs=1e-12) for q, row in got.items() for i, s in row)
    assert all(row == sorted(row, key=lambda x: (-x[1], x[0])) for row in got.values())


def test_whole_budget_is_exact_also_in_small_blocks(spark, vectors):
    """With recall 1 of all queries as the sample every true neighbour is visited."""
    want = plain_nearest([(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    got = by_query(multi_index.nearest(vectors, F.col("id") % 50 == 0, recall=1.0, block_rows=3))
    assert {q: [i for i, _ in row] for q, row in got.items()} == {q: [i for i, _ in row] for q, row in want.items()}


def test_copies_leave_room_for_the_smallest_ids(spark):
    """A vector that a third of the rows share: its copies are ranked by id, and each query leaves itself out."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(120)]
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    got = by_query(multi_index.nearest(table(spark, rows), F.col("id") % 50 == 0, recall=1.0))
    assert [i for i, _ in got[0]] == [3, 6, 9, 12, 15] and len({s for _, s in got[0]}) == 1
    want = plain_nearest(rows)
    assert {q: [i for i, _ in row] for q, row in got.items()} == {q: [i for i, _ in row] for q, row in want.items()}


def test_neighbours_of_awkward_rows(spark):
    got = by_query(multi_index.nearest(table(spark, AWKWARD), F.col("id") % 50 == 0, recall=1.0))
    want = plain_nearest(AWKWARD)
    assert sorted(want) == [0, 50, 100, 150] and {q: [i for i, _ in row] for q, row in got.items()} == {q: [i for i, _ in row] for q, row in want.items()}


def test_neighbours_of_few_or_no_rows(spark):
    assert by_query(multi_index.nearest(table(spark, []), F.col("id") % 50 == 0)) == {}
    assert by_query(multi_index.nearest(table(spark, [(0, wide(1))]), F.col("id") % 50 == 0)) == {}
    assert by_query(multi_index.nearest(table(spark, [(1, wide(1)), (2, wide(2))]), F.col("id") % 50 == 0)) == {}
    assert [i for i, _ in by_query(multi_index.nearest(table(spark, [(0, wide(1)), (2, wide(1, 1)), (1, wide(5))]), F.col("id") % 50 == 0))[0]] == [1, 2]


def test_cells_come_by_summed_distance():
    rng = np.random.default_rng(1)
    first, second, cells = rng.random(9), rng.random(7), rng.integers(0, 4, (9, 7))
    total = first[:, None] + second
    i, j = multi_index.traverse(first, second, cells, 40)
    order = [x for x in np.argsort(total, axis=None) if cells.ravel()[x]]
    stop = int(np.searchsorted(np.cumsum(cells.ravel()[order]), 40)) + 1
    assert [a * 7 + b for a, b in zip(i, j, strict=True)] == order[:stop]
    assert len(multi_index.traverse(first, second, cells, 10**6)[0]) == (cells > 0).sum()
