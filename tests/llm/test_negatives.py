"""Hard negatives against brute force on integers, with ties, odd rows, small blocks; the search against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, x string, rank long, is_anchor int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, c, "x", 1, 0) for i, v, c in rows], SCHEMA)


def query(rows):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(rows, F.col("vec_id") % 100 == 0, label)


def brute(rows):
    good = [(i, (c + 1) % 10 if i % 7 == 0 else c, [math.floor(256 * float(np.float32(e))) for e in v]) for i, v, c in rows if None not in (i, v, c) and all(e is not None and math.isfinite(e) for e in v)]
    out = []
    for i, c, v in {(i, c, tuple(v)) for i, c, v in good if i % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, d) for j, d, w in good)
        for s, p, _ in [x for x in scored if x[2] == c and x[1] != i][:5]:
            below = [x for x in scored if x[2] != c and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(below)]
    return sorted(out)


def clusters(n, width, seed, spread=0.3):
    r = np.random.default_rng(seed)
    middles = r.standard_normal((6, width)) * np.linspace(1, 0.05, width)
    return (middles[r.integers(0, 6, n)] + spread * r.standard_normal((n, width)) * np.linspace(1, 0.05, width)).astype(np.float32).tolist()


@pytest.mark.parametrize(("width", "spread"), [(24, 0.3), (5, 0.05), (1, 1.0)])
def test_against_brute_force(spark, monkeypatch, width, spread):
    """Ties (few distinct vectors), copies of one vector under many labels, repeated rows, rows that take no part."""
    monkeypatch.setattr(negatives, "BLOCK", 4)
    monkeypatch.setattr(negatives, "CELLS", 200)
    r, made = random.Random(width), clusters(900, width, width, spread)
    rows = [(i, made[i // 2] if i % 3 else made[0], r.randrange(4)) for i in range(900)]
    rows += [(100, None, 1), (200, [*made[0][:-1], None], 1), (300, [math.nan] * width, 1), (None, made[1], 1), (5000, made[1], None), (5100, made[3], 9), (901, [*made[1][:-1], math.inf], 2)]
    rows += [rows[7], rows[7], rows[100], rows[100]]
    got = [tuple(x) for x in query(table(spark, rows).repartition(4)).collect()]
    assert sorted(got) == brute(rows) and len(got) > 100


def test_search_loses_nothing():
    """All pairs at or above the bounds survive, and most others are left early where components differ in size."""
    made = (np.array(clusters(400, 32, 8)) * 256).astype(np.int64)
    rotation = negatives.Rotation(np.ascontiguousarray(np.linalg.eigh((made.T @ made).astype(float))[1][:, ::-1]))
    rows = rotation.vectors(np.arange(400), np.arange(400) % 3, made)
    anchors, exact = rows.take(np.arange(40)), made @ made[:40].T
    low = np.sort(exact, axis=0)[-9].astype(float)
    a, r = negatives.survivors(rotation, anchors, rows, low, np.full(40, np.inf), False)
    assert set(zip(a.tolist(), r.tolist(), strict=True)) >= {(j, i) for i, j in np.argwhere(exact >= low).tolist()}
    assert len(a) < 0.2 * exact.size
    a, r = negatives.survivors(rotation, anchors, rows, low, low, True)
    pairs = set(zip(a.tolist(), r.tolist(), strict=True))
    assert pairs >= {(j, i) for i, j in np.argwhere(exact == low).tolist() if i % 3 != j % 3} and all(i % 3 != j % 3 for j, i in pairs)


def test_empty(spark):
    for rows in ([], [(1, [1.0], 2)], [(100, [1.0], 2)], [(100, None, 2)], [(100, [], 1), (1, [], 1), (2, [], 2)]):
        assert sorted(tuple(x) for x in query(table(spark, rows)).collect()) == brute(rows)


def test_query(spark):
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(x) for x in entry.queries()["op12_pca_negatives"](spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(entry.oracle_sql()["op12_pca_negatives"]).fetchall()) and len(got) > 20
