import numpy as np
import pytest

from wayline.llm import whitening as W

KIND = "vec_id long, embedding array<float>, label int"


def check(rows, found, components=16):
    """rows: (vec_id, vector), all valid. Against numpy over the distinct whole-number vectors."""
    x = {i: np.array([int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v], object) for i, v in rows}
    fit = [np.array(v, object) for v in {tuple(v) for v in x.values()}]
    n, s = len(fit), sum(fit)
    d = np.array([n * v - s for v in fit]).astype(float) / n
    values, vectors = np.linalg.eigh(d.T @ d / n)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order].T
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert by.keys() == x.keys()
    k = max(len(v) for v in by.values())
    assert k <= components and all(sorted(v) == list(range(1, k + 1)) for v in by.values())
    signs = None
    for i, v in x.items():
        exact = n * v - s
        wanted = (exact.astype(float) / n) @ vectors[:k].T / np.sqrt(values[:k])
        got = np.array([by[i][c]["whitened"] for c in range(1, k + 1)])
        if signs is None and (np.abs(wanted) > 1e-3).all():
            signs = np.sign(wanted * got)
        if signs is not None:
            assert np.allclose(got * signs, wanted, atol=1e-7)
        for c in range(1, k + 1):
            r = by[i][c]
            assert r["n"] == n and r["deviation"] == sum(exact**2)
            assert abs(r["explained"] / (values[c - 1] / values.sum()) - 1) < 1e-9 and r["identity_error"] <= 1e-9
    return k


def test_the_table(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    assert check(rows, W.op11_whitening(spark, data).collect()) == 16


def test_repeats_count_once_and_invalid_rows_go(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(v) for v in rng.normal(size=5) * [3, 2, 1, 0.5, 0.2]]) for i in range(200)]
    good += [(1000 + i, good[0][1]) for i in range(300)]
    bad = [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 5), (2004, [float("inf")] + [0.0] * 4), (2005, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in good + bad], KIND)
    assert check(good, W.whiten_vectors(df).collect()) == 5
    assert {r["component"] for r in W.whiten_vectors(df, 2).collect()} == {1, 2}


def test_no_direction_is_made_up(spark):
    """A dimension that follows another, and one that never varies, add no component."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(a), float(a), 7.0, float(b)]) for i, (a, b) in enumerate(rng.integers(-20, 20, (80, 2)))]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], KIND)
    assert check(rows, W.whiten_vectors(df).collect()) == 2


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], [(1, None), (2, [])]])
def test_nothing_varies(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], KIND)
    found = W.whiten_vectors(df)
    assert found.count() == 0 and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], "a"), (5, [0.0, 3.0], "b"), (5, [2.0, 2.0], "c")], "vec_id long, embedding array<double>, x string")
    assert sorted((r["vec_id"] or 0, r["component"]) for r in W.whiten_vectors(df).collect()) == [(0, 1), (0, 2), (5, 1), (5, 1), (5, 2), (5, 2)]


def test_a_deviation_beyond_a_long_fails(spark):
    df = spark.createDataFrame([(i, [float(v)], 0) for i, v in enumerate((0.0, 1e8))], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="long"):
        W.whiten_vectors(df).collect()
