"""Property tests (hypothesis) of the exact distributed quantiles."""
import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from giftrisk.operators.quantiles import exact_quantiles


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=300),
       p=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.945, 1.0]))
def test_exact_quantile_equals_numpy(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)
    got = exact_quantiles(df, {"q": (F.col("x"), p)})["q"]
    srt = np.sort(np.array(values, dtype=float))
    h = (len(srt) - 1) * p
    lo, hi = int(np.floor(h)), int(np.ceil(h))
    want = srt[lo] + (srt[hi] - srt[lo]) * (h - lo)
    assert abs(got - want) < 1e-9
