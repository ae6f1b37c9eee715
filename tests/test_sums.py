"""Sums that groups of equal values share, in whatever order their rows come."""

from pyspark.sql import functions as F

from graticule.operators import counts


def test_equal_values_have_equal_sums_in_any_order(spark):
    values = [0.1 * k + 1e-3 for k in range(1, 60)]
    rows = [(g, v) for g in range(40) for v in (values[g:] + values[:g])]
    df = spark.createDataFrame(rows, "doc int, value double").repartition(7)
    assert df.groupBy("doc").agg(F.sum("value").alias("s")).select("s").distinct().count() > 1
    sums = [r.s for r in df.groupBy("doc").agg(counts.steady_sum("value").alias("s")).select("s").distinct().collect()]
    assert len(sums) == 1 and abs(sums[0] - sum(values)) < 1e-10
    odd = spark.createDataFrame([(1, 1e300), (1, 2.0), (2, float("inf")), (2, 1.0), (3, None), (4, float("nan")), (5, None), (5, 0.25)], "doc int, value double")
    got = {r.doc: r.s for r in odd.groupBy("doc").agg(counts.steady_sum("value").alias("s")).collect()}
    assert got[1] == 1e300 and got[2] == float("inf") and got[3] is None and got[4] != got[4] and got[5] == 0.25
