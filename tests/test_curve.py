"""The Hilbert key runs over whole batches: neighbours on the curve are neighbours in space, odd coordinates have a key."""

from pyspark.sql import functions as F

from tessella.operators.order import curve_key


def test_the_curve_visits_each_cell_once_and_steps_to_neighbours(spark):
    for dim in (2, 3):
        names = list("xyz"[:dim])
        cells = spark.range(8**dim).select(*[F.floor(F.col("id") / 8**k % 8).cast("double").alias(a) for k, a in enumerate(names)])
        keyed = cells.withColumn("curve", curve_key(names, [0.0] * dim, [7.0] * dim, 3))
        assert "lambda" not in keyed._jdf.queryExecution().toString()
        rows = sorted(keyed.collect(), key=lambda r: r.curve)
        assert [r.curve for r in rows] == list(range(8**dim))
        assert all(sum(abs(a[n] - b[n]) for n in names) == 1 for a, b in zip(rows, rows[1:]))


def test_odd_coordinates(spark):
    odd = spark.createDataFrame([(None, 0.0), (0.0, 0.0), (float("nan"), 1.0), (1.0, 1.0), (float("inf"), 1.0)], "x double, y double")
    a, b, c, d, e = (r[0] for r in odd.select(curve_key(["x", "y"], [0.0, 0.0], [1.0, 1.0])).collect())
    assert a == b and c == d == e
