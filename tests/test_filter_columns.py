import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import matrix as M
from wayline.functions import quat as Q
from wayline.operators import filter_columns as FC
from wayline.operators.filter_core import Filter


def evaluated(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def as_rows(m):
    return M.rows(*[M.vector(*[float(x) for x in row]) for row in m])


def test_matrix_algebra(spark):
    rng = np.random.default_rng(1)
    a, b, v = rng.normal(size=(3, 4)), rng.normal(size=(4, 2)), rng.normal(size=4)
    got = evaluated(spark, product=M.product(as_rows(a), as_rows(b)), turned=M.transpose(as_rows(a)), times=M.times(as_rows(a), M.vector(*v.tolist())), twice=M.plus(as_rows(a), as_rows(a)), none=M.minus(as_rows(a), as_rows(a)), skew=M.skew(M.vector(1.0, 2.0, 3.0)))
    assert np.allclose(got["product"], a @ b) and np.allclose(got["turned"], a.T) and np.allclose(got["times"], a @ v) and np.allclose(got["twice"], 2 * a) and not np.any(got["none"])
    assert got["skew"] == [[0.0, -3.0, 2.0], [3.0, 0.0, -1.0], [-2.0, 1.0, 0.0]]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_inverse(spark, n):
    m = np.random.default_rng(n).normal(size=(n, n)) + 3 * np.eye(n)
    got = evaluated(spark, good=M.inverse(as_rows(m)), bad=M.inverse(as_rows(np.zeros((n, n)))))
    assert np.allclose(got["good"], np.linalg.inv(m)) and got["bad"] is None


def test_no_inverse_beyond_three(spark):
    assert evaluated(spark, big=M.inverse(as_rows(np.eye(4))))["big"] is None


def both(spark, seed):
    """The same random state for the columns and for the numpy filter, after a prediction."""
    rng = np.random.default_rng(seed)
    p, v, q, f, w = rng.normal(size=3) * 5, rng.normal(size=3) * 4, rng.normal(size=4), rng.normal(size=3) * 3, rng.normal(size=3)
    q = q / np.linalg.norm(q) * np.sign(q[0])
    quat = Q.quat(*[F.lit(float(x)) for x in q])
    df = spark.range(1).select(M.vector(*p.tolist()).alias("position"), M.vector(*v.tolist()).alias("velocity"), quat.alias("attitude"), FC.start_covariance().alias("covariance"))
    one = Filter(p, v, q)
    one.predict(0.4, f, w)
    return FC.predict(df, F.lit(0.4), M.vector(*f.tolist()), M.vector(*w.tolist())), one, rng


def assert_same(df, one):
    row = df.first()
    assert df.columns == list(FC.STATE)
    assert np.allclose(row["position"], one.position) and np.allclose(row["velocity"], one.velocity)
    assert np.allclose(list(row["attitude"]), one.attitude) and np.allclose(row["covariance"], one.covariance, atol=1e-12)


@pytest.mark.parametrize("seed", range(3))
def test_steps_equal_the_numpy_kernel(spark, seed):
    df, one, rng = both(spark, seed)
    assert_same(df, one)
    one.hold_to_track(0.05**2)
    assert_same(df := FC.hold_to_track(df).checkpoint(), one)
    one.take_speed(6.5, 0.25**2)
    assert_same(df := FC.take_speed(df, F.lit(6.5)).checkpoint(), one)
    place = rng.normal(size=3)
    one.take_position(place, 1.0)
    assert_same(df := FC.take_position(df, M.vector(*place.tolist())).checkpoint(), one)
    relative, start = (x / np.linalg.norm(x) for x in (np.array([0.9, 0.1, -0.2, 0.3]), np.array([0.8, 0.3, 0.1, -0.4])))
    one.take_turn(relative, start, np.radians(5.0) ** 2)
    as_quat = lambda x: Q.quat(*[F.lit(float(y)) for y in x])
    assert_same(FC.take_turn(df, as_quat(relative), as_quat(start)), one)


def test_no_time_moves_nothing_and_no_inverse_keeps_the_state(spark):
    df, one, _ = both(spark, 9)
    df = df.checkpoint()
    assert_same(FC.predict(df, F.lit(-1.0), M.vector(1.0, 2.0, 3.0), M.vector(1.0, 0.0, 0.0)), one)
    flat = M.rows(M.vector(*[0.0] * 9))
    assert_same(FC.measure(df, M.vector(1.0), flat, M.rows(M.vector(0.0))), one)


def test_rows_without_a_measurement_keep_their_state(spark):
    df, one, _ = both(spark, 4)
    rows = df.crossJoin(spark.createDataFrame([(0, 6.5), (1, None), (2, 2.0)], "n int, speed double")).checkpoint()
    found = {r["n"]: r for r in FC.take_speed(rows, F.col("speed")).collect()}
    assert found[1]["velocity"] == one.velocity.tolist() and np.allclose(found[1]["covariance"], one.covariance, atol=1e-12)
    for n, speed in ((0, 6.5), (2, 2.0)):
        other = Filter(one.position, one.velocity, one.attitude, one.covariance)
        other.take_speed(speed, 0.25**2)
        assert np.allclose(found[n]["velocity"], other.velocity) and np.allclose(found[n]["covariance"], other.covariance, atol=1e-12)
