import numpy as np
import pytest

from pagewright.operators import keywords


@pytest.mark.parametrize("n,k", [(2, 2), (3, 2), (6, 2), (9, 3), (15, 5)])
def test_cluster_count(spark, n, k):
    df = spark.createDataFrame([("D", 0, i, f"t{i}", 1.0) for i in range(n)], "doc_id string, chunk_index int, ord int, term string, score double")
    assert keywords.cluster_count(df).first().n_clusters == max(k, 1)


def brute_linkage(v, k):
    u = v / np.where((n := np.linalg.norm(v, axis=1)) > 0, n, 1)[:, None]
    d = np.clip(1 - u @ u.T, 0, None)
    groups = [{i} for i in range(len(v))]
    while len(groups) > k:
        best = min(((round(float(np.mean([d[a, b] for a in x for b in y])), 12), min(x), min(y)) for i, x in enumerate(groups) for y in groups[i + 1:]))
        x = next(g for g in groups if min(g) == best[1])
        y = next(g for g in groups if min(g) == best[2])
        groups = sorted([g for g in groups if g is not x and g is not y] + [x | y], key=min)
    return {frozenset(g) for g in groups}


def test_average_linkage():
    rng = np.random.default_rng(3)
    for n in (2, 5, 12):
        v = rng.integers(0, 3, (n, 6)).astype(float)
        got = keywords.average_linkage(v, max(2, n // 3))
        assert {frozenset(i for i in range(n) if got[i] == k) for k in set(got)} == brute_linkage(v, max(2, n // 3))


def test_coherence(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 1.0]), ("c", [2.0, 0.0]), ("c", [1.0, 0.0]), ("d", None)]
    df = spark.createDataFrame(rows, "label string, embedding array<float>")
    got = {r.label: r.coherence for r in keywords.cluster_coherence(df).collect()}
    assert got == {"a": 0.5, "b": 0.0, "c": 1.0}


def test_clusters_edge_cases(spark):
    schema = "doc_id string, chunk_index int, ord int, term string, score double"
    two = spark.createDataFrame([("D", 0, 0, "nets", 0.5), ("D", 0, 1, "cubes", None), ("E", 0, 0, "nets", 0.1), ("E", 0, 1, None, 0.1)], schema)
    assert keywords.keyword_clusters(two).count() == 0
    three = spark.createDataFrame([("D", 0, 0, "unit nets", 0.5), ("D", 0, 1, "Unit  Nets", 0.4), ("D", 0, 2, "nets", 0.5), ("D", 0, 3, "zebra", 0.9)], schema)
    got = keywords.keyword_clusters(three).collect()
    assert [(r.name, list(r.terms)) for r in got] == [("nets", ["nets", "unit nets"])]
    assert keywords.keyword_clusters(spark.createDataFrame([], schema)).count() == 0
