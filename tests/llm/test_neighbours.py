import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.llm import learned_partitions as m
from tally.llm import queries as q


def brute(rows, k=10):
    """Nearest ids and distances by query id, of (id, vector) rows."""
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    out = {}
    for row in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[row]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[row]][:k]
        out[int(ids[row])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[k]} & {i for i, _ in v}) / len(v) for k, v in want.items()])


def check_distances(got, rows):
    x = dict(rows)
    for k, found in got.items():
        assert found == sorted(found, key=lambda f: (f[1], f[0])) and k not in {i for i, _ in found}
        for i, d in found:
            assert abs(d - np.sqrt(((np.array(x[k], float) - np.array(x[i], float)) ** 2).sum())) < 1e-12


def counted(monkeypatch):
    """Parts of each fit."""
    parts, fit = [], m.fit
    monkeypatch.setattr(m, "fit", lambda x, p, k: parts.append(p) or fit(x, p, k))
    return parts


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_query_over_learned_parts(spark, monkeypatch, sf):
    parts, folder = counted(monkeypatch), f"/root/testdata/{sf}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = answers(q.op2_learned_partitions(spark, folder)), brute(rows)
    assert parts and parts[0] >= 8
    assert got.keys() == want.keys() and all(len(got[k]) == 10 for k in want)
    assert recall(got, want) >= 0.9
    check_distances(got, rows)


def test_parts_of_vectors_in_clusters(spark, monkeypatch):
    """Where vectors lie in clusters, few parts are searched."""
    parts, probed, probes = counted(monkeypatch), [], m.probes
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 16)).repeat(100, axis=0) * 3 + rng.standard_normal((6000, 16)) * 0.5
    rows = list(enumerate(x[rng.permutation(len(x))].tolist()))

    def seen(p, level, sizes, least):
        out = probes(p, level, sizes, least)
        probed.append(sizes[out[1]].sum() / len(p) / max(1, sizes.sum()))
        return out

    monkeypatch.setattr(m, "probes", seen)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = answers(m.nearest_neighbours(df, F.col("vec_id") % 100 == 0)), brute(rows)
    assert parts == [32] and probed[-1] < 0.5
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    check_distances(got, rows)


def test_one_part_is_exact(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got, want = answers(m.nearest_neighbours(table, F.col("vec_id") % 100 == 0, parts=1)), brute(rows)
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items()}


def test_many_copies(spark):
    rng = np.random.default_rng(0)
    one = rng.standard_normal(8).tolist()
    rows = [(i, one if i % 3 else rng.standard_normal(8).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = answers(m.nearest_neighbours(df, F.col("vec_id") % 100 == 0)), brute(rows)
    same = [k for k in want if want[k][0][1] == 0]
    assert same and all(got[k] == want[k] for k in same)
    assert recall(got, want) >= 0.9


def test_ties_between_different_vectors(spark):
    """Many different vectors tie around the k-th distance; the smallest ids count."""
    rng = np.random.default_rng(0)
    grid = [v for v in itertools.product(range(4), repeat=5) if any(v)]
    for vectors in (np.eye(300), np.array(grid)):
        ids = rng.permutation(len(vectors))
        rows = [(int(i), v.tolist()) for i, v in zip(ids, vectors.astype(float))]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert answers(m.nearest_neighbours(df, F.col("vec_id") % 100 == 0, parts=1)) == brute(rows)


def test_parts_are_balanced():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((8, 16)).repeat(100, axis=0) * 4 + rng.standard_normal((800, 16))
    near = m._nearest(x, x, 11)[:, 1:]
    part = m.balanced_parts(near, 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(800 / 8 * 1.1)
    assert (part[near] == part[:, None]).mean() > 0.8


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [1.0, 2.5]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (None, [1.0, 2.0]), (6, []), (7, [1.0]), (8, [1.0, 2.0]), (9, [9.0, 9.0])]
    df = spark.createDataFrame([r + (1, 2) for r in rows], "vec_id long, embedding array<float>, part int, Vec_ID2 int")
    got = answers(m.nearest_neighbours(df, F.col("vec_id") % 100 == 0))
    assert {k: [i for i, _ in v] for k, v in got.items()} == {0: [8, 100, 9], 100: [0, 8, 9]}
    assert got[0][0][1] == 0.0 and got[0][1][1] == 0.5
    assert m.nearest_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    alone = df.where("vec_id = 9").withColumn("vec_id", F.lit(100).cast("long"))
    assert m.nearest_neighbours(alone, F.col("vec_id") % 100 == 0).collect() == []
