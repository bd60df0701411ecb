import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayline.functions import geo, quat, text
from wayline.operators import filter_core as K


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_speeds_and_angles(spark):
    row = one(spark, a=geo.kmh_to_ms(F.lit(117.911)), b=geo.wrap_degrees(F.lit(-10.0)), d=geo.haversine_m(*[F.lit(x) for x in (51.4778, 0.0, 51.4878, 0.0)]))
    assert round(row["a"], 3) == 32.753 and row["b"] == 350 and 1100 < row["d"] < 1120


def test_heading_differences(spark):
    pairs = [(45, 45, 0), (0, 180, 0), (0, 90, 90), (350, 10, 20)]
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in pairs], "a double, b double, c double")
    assert all(r["d"] == r["c"] for r in df.select("c", geo.heading_difference_deg(F.col("a"), F.col("b")).alias("d")).collect())


def test_quaternions(spark):
    yaw = quat.from_euler_deg(F.lit(90.0), F.lit(0.0), F.lit(0.0))
    row = one(spark, q=yaw, same=quat.angular_error_deg(yaw, quat.multiply(quat.identity(), yaw)), turn=quat.angular_error_deg(quat.identity(), yaw), zero=quat.normalize(quat.quat(*[F.lit(0.0)] * 4)))
    assert abs(row["q"]["w"] - math.sqrt(0.5)) < 1e-12 and abs(row["q"]["z"] - math.sqrt(0.5)) < 1e-12
    assert row["same"] < 1e-5 and abs(row["turn"] - 90) < 1e-9 and row["zero"]["w"] == 1


def test_heading_with_pitch_matches_its_matrix(spark):
    q = quat.from_heading_deg(F.lit(30.0), F.lit(10.0), F.lit(-5.0))
    row = one(spark, m=quat.to_rotmat(q), h=quat.to_heading_deg(q))
    assert abs(row["h"] - 30) < 1e-9 and abs(row["m"][6] + math.sin(math.radians(10))) < 1e-12


vectors = st.lists(st.floats(-3, 3), min_size=3, max_size=3)


@settings(max_examples=60, deadline=None)
@given(vectors, vectors)
def test_filter_algebra(a, b):
    import numpy as np

    p, q = K.exp(np.array(a)), K.exp(np.array(b))
    assert np.allclose(K.product(p, K.conjugate(p)), [1, 0, 0, 0], atol=1e-9)
    assert np.allclose(K.matrix(K.product(p, q)), K.matrix(p) @ K.matrix(q), atol=1e-9)
    if np.linalg.norm(a) < math.pi - 1e-6:
        assert np.allclose(K.log(p), a, atol=1e-7)


def test_texts(spark):
    row = one(spark, a=text.distance_text(F.lit(1250.0)), b=text.distance_text(F.lit(999.9)), c=text.duration_text(F.lit(3725.0)), d=text.duration_text(F.lit(125.0)))
    assert (row["b"], row["c"], row["d"]) == ("999 m", "1h 2m", "2 mins") and row["a"].endswith(" km")
