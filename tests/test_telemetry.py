import numpy as np

from ranksmith.operators.telemetry import exact_percentiles


def test_exact_percentiles_skewed_groups(spark):
    rng = np.random.default_rng(1)
    big = rng.exponential(10, 3000).round(2)
    rows = [("hot", float(x)) for x in big] + [("one", 5.0)] + [("two", 1.0), ("two", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in exact_percentiles(df, "g", "v", [50, 95, 99], buckets=16).collect()}
    for g, vals in (("hot", big), ("one", [5.0]), ("two", [1.0, 4.0])):
        for p in (50, 95, 99):
            assert abs(getattr(got[g], f"p{p}") - np.percentile(vals, p)) < 1e-9
