"""Whitening against NumPy on exact integers, with odd rows."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from corpusloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)


def brute(rows, most=16):
    """{row index: (deviation, whitened up to sign, explained)} with the fit list, in exact integers where these are asked for."""
    good = [(k, i, v) for k, (i, v) in enumerate(rows) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, _, v in good)
    x = {k: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]) for k, _, v in good}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in fit])
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    dev = {k: sum((n * c - s) ** 2 for c, s in zip(w, sums, strict=True)) for k, w in x.items()}
    white = {k: np.array([float(Fraction(n * c - s, n)) for c, s in zip(w, sums, strict=True)]) @ q / np.sqrt(np.maximum(e, 1e-300)) for k, w in x.items()}
    return n, dev, white, e / np.trace(v)


def vectors(n, width, seed):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, width)) @ np.diag(np.linspace(1, 0.1, width)) * 0.4 + 0.2).astype(np.float32).tolist()


def test_against_numpy(spark):
    made = vectors(400, 24, 1)
    rows = [(i, v) for i, v in enumerate(made)] + [(1000 + i, made[0]) for i in range(200)] + [(3, made[3]), (None, made[4]), (5000, None), (5001, [float("nan"), *made[0][1:]]), (5002, [None, *made[0][1:]]), (5003, [float("-inf"), *made[0][1:]]), (5004, made[5][:20])]
    n, dev, white, share = brute(rows)
    got = whitening.whiten(table(spark, rows).repartition(5)).collect()
    assert len(got) == 16 * len(dev) and {x.n for x in got} == {n}
    by = {}
    for x in got:
        by.setdefault((x.vec_id, int(x.deviation)), {}).setdefault(x.component, []).append(x)
    signs = None
    for k, d in dev.items():
        mine = by[(rows[k][0], d)]
        assert sorted(mine) == list(range(1, 17))
        values = np.array([mine[c][0].whitened for c in range(1, 17)])
        if signs is None:
            signs = np.sign(values * white[k])
        assert np.allclose(values * signs, white[k], rtol=1e-8, atol=1e-8)
        assert np.allclose([mine[c][0].explained for c in range(1, 17)], share, rtol=1e-9)
    assert len({x.identity_error for x in got}) == 1 and got[0].identity_error < 1e-9


def test_flat_and_few(spark):
    """One distinct vector: nothing varies. Two: one component varies."""
    one = whitening.whiten(table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(x.component, x.whitened, x.explained, x.identity_error, x.deviation) for x in one] == [(c, None, None, None, 0) for c in (1, 2)] * 2
    two = {(x.vec_id, x.component): x for x in whitening.whiten(table(spark, [(1, [0.5, 0.25]), (2, [-0.5, 0.25])])).collect()}
    assert abs(two[1, 1].whitened) == pytest.approx(1) and two[1, 1].explained == pytest.approx(1) and two[1, 2].whitened is None and two[1, 2].explained == 0
    assert two[1, 1].whitened == -two[2, 1].whitened and two[1, 1].deviation == 2 * 2 * 32 * 32


def test_empty(spark):
    for rows in ([], [(1, None), (2, [None])]):
        assert whitening.whiten(table(spark, rows)).collect() == []
    assert {x.whitened for x in whitening.whiten(table(spark, [(1, []), (2, [1.0])])).collect()} == {1.0, -1.0}


def test_large_entries(spark):
    """Sums and deviations beyond 2**53 stay exact."""
    r = random.Random(2)
    rows = [(i, [float(r.choice((-1, 1)) * 2 ** r.randrange(20, 34)) for _ in range(3)]) for i in range(20)]
    _, dev, _, _ = brute(rows)
    assert {x.vec_id: int(x.deviation) for x in whitening.whiten(table(spark, rows)).collect()} == dev


def test_query(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    rows = [(x.vec_id, x.embedding) for x in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, dev, white, share = brute(rows)
    got = {(x.vec_id, x.component): x for x in entry.queries()["op11_two_pass_whitening"](spark, sf).collect()}
    assert len(got) == 16 * len(rows)
    signs = np.sign([got[rows[0][0], c].whitened * white[0][c - 1] for c in range(1, 17)])
    for k, (i, _) in enumerate(rows):
        assert got[i, 1].deviation == dev[k] and got[i, 1].n == n
        assert np.allclose(signs * [got[i, c].whitened for c in range(1, 17)], white[k], rtol=1e-6, atol=1e-8)
    assert np.allclose([got[rows[0][0], c].explained for c in range(1, 17)], share, rtol=1e-9) and got[0, 1].identity_error < 1e-9
