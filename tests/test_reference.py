"""Plain Python versions of shared rules."""

import math

M = (1 << 64) - 1


def _mix(z):
    z = (z + 0x9E3779B97F4A7C15) & M
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & M
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & M
    return z ^ (z >> 31)


def pixel_hash(seed, x, y, k):
    return _mix(seed ^ _mix((y << 32) | x) ^ ((k * 0xD1B54A32D192ED03) & M))


def unit(h):
    return (h >> 11) * 2.0**-53


def test_hash(spark):
    from mosaiq.functions.rules import pixel_hash as column
    from mosaiq.functions.rules import wrapping
    from mosaiq.plans.relation import spine

    with wrapping(spark):
        df = column(spine(spark, 64, 32), 2**53 - 1, {"a": 0, "b": 5})
    assert all(r["a"] & M == pixel_hash(2**53 - 1, r["x"], r["y"], 0) and r["b"] & M == pixel_hash(2**53 - 1, r["x"], r["y"], 5) for r in df.collect())


def test_encoder(spark):
    from pyspark.sql import functions as F

    from mosaiq.functions.rules import half_up, q

    values = [0.0, 1.0, -3.0, 2.0, 0.5, 0.5 / 255, 127.5 / 255, 0.1, 0.49999999999999994 / 255]
    exact = lambda y: math.floor(y) + (y - math.floor(y) >= 0.5)
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", q(F.col("v")).alias("q")).collect()
    assert all(r["q"] == exact(min(max(r["v"], 0.0), 1.0) * 255.0) for r in got)
    ties = spark.createDataFrame([(0.49999999999999994, 0), (0.5, 1), (1.5, 2), (2.5, 3), (254.49999999999997, 254)], "v double, want int").select(half_up(F.col("v")).alias("h"), "want").collect()
    assert all(r["h"] == r["want"] for r in ties)
