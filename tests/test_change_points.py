import random

from tests.test_engine import series
from tideline.functions.times import DAY
from tideline.operators import checks, kernels, normalize


def test_a_long_series_keeps_its_change_points(spark):
    r = random.Random(8)
    norm = normalize.normalized(series(spark, [(20.0 if i < 1300 else 30.0) + r.gauss(0, 0.3) for i in range(2600)], step=DAY // 4))
    medians = checks.bucket_medians(norm, DAY // 4)
    assert medians.count() <= 2000
    (x,) = kernels.change_points(medians).collect()
    assert abs(x.bucket - 1300) <= 2
