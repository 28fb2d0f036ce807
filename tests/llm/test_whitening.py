import math
import os

import numpy as np
import pytest

from tablefit.llm.whitening import ONE, whiten

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "vec_id long, embedding array<double>, label int, x string, n string, white string, width string"


def plain(rows, most=32, distinct=False):
    """{id: [(deviation, {component: (whitened, explained)})]} of vectors of one length, and n."""
    xs = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows
          if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = list({tuple(x): x for _, x in xs}.values()) if distinct else [x for _, x in xs]
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    z = np.array(fit, float) - np.array(sums) / n
    covariance = z.T @ z / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in xs:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        projected = (np.array(x) - np.array(sums) / n) @ vectors
        out.setdefault(i, []).append((deviation, {
            k + 1: (projected[k] / math.sqrt(values[k]), values[k] / values.sum())
            for k in range(min(most, len(values))) if values[k] > 1e-9
        }))
    return out, n


def agree(df, rows, **how):
    expected, n = plain(rows, **how)
    got = {}
    for r in df.collect():
        assert r.n == n and r.identity_error <= 1e-6
        got.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append((r.whitened, r.explained))
    signs = {}
    for i, each in expected.items():
        for deviation, entries in each:
            found = got[i, deviation]
            assert set(found) == set(entries)
            for c, (white, explained) in entries.items():
                assert len(found[c]) >= 1
                if c not in signs and abs(white) > 1e-3:
                    signs[c] = np.sign(found[c][0][0] * white)
                best = min(abs(w * signs.get(c, 1) - white) for w, _ in found[c])
                assert best < 1e-6 * max(1, abs(white)) and abs(found[c][0][1] - explained) < 1e-9
    assert sum(len(v) for g in got.values() for v in g.values()) == sum(len(e[1]) for v in expected.values() for e in v)


def test_table_against_numpy(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    found = whiten(table)
    agree(found, rows)
    assert dict(found.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
        "explained": "double", "identity_error": "double",
    }
    assert {r.component for r in found.select("component").distinct().collect()} == set(range(1, 33))


def _made(spark, rows):
    return spark.createDataFrame([(i, v, 0, "", "", "", "") for i, v in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("weights", ["counts", ONE])
def test_multiplicities(spark, weights):
    """A third of the rows are one vector; the weights change the fit."""
    rng = np.random.default_rng(5)
    some = [rng.normal(0, 2, 5).round(3).tolist() for _ in range(60)]
    rows = [(i, some[0] if i % 3 == 0 else some[i % 60]) for i in range(300)]
    agree(whiten(_made(spark, rows), weights=weights), rows, distinct=weights == ONE)


def test_fewer_components(spark):
    """A constant entry and one that repeats another have no component of their own."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(a), 1.0, float(b), float(a)]) for i, (a, b) in enumerate(rng.integers(-9, 9, (80, 2)))]
    found = whiten(_made(spark, rows))
    agree(found, rows)
    assert {r.component for r in found.collect()} == {1, 2}
    assert {r.component for r in whiten(_made(spark, rows), most=1).collect()} == {1}


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, []), (102, [1.0, None]), (103, [nan, 1.0]), (104, [1.0, -inf]), (105, [1e300, 0.0])]
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-0.0, 0.3]), (3, [0.0, 0.3]), (None, [5.0, -1.0]), (4, [-7.5, 2.25])]
    found = whiten(_made(spark, [*bad, *good])).collect()
    agree(whiten(_made(spark, [*bad, *good])), good)
    assert len(found) == 12 and sum(r.vec_id == 1 for r in found) == 4 and sum(r.vec_id is None for r in found) == 2
    assert whiten(_made(spark, bad)).count() == 0
    assert whiten(_made(spark, good).limit(0)).count() == 0
    assert whiten(_made(spark, [(1, [1.0]), (2, [1.0])])).count() == 0


def test_lengths_are_apart(spark):
    two, three = [(i, [float(i), float(i * i % 7)]) for i in range(9)], [(i + 50, [float(i), float(-i), float(i % 2)]) for i in range(9)]
    found = whiten(_made(spark, [*two, *three]))
    agree(found.where("vec_id < 50"), two)
    agree(found.where("vec_id >= 50"), three)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**30 + 17 * i), float(i % 3)]) for i in range(50)]
    expected, _ = plain(rows)
    for r in whiten(_made(spark, rows)).collect():
        assert r.deviation == expected[r.vec_id][0][0]
