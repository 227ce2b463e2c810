"""Bounds of intervals held within the signal's range, against the statements of the reference's engine (forecast/engine.py:366-372)."""

import pytest

from tidegauge.operators import reports
from tidegauge.plans import telemetry


def by_reference(lo, hi, s_lo, s_hi):
    if s_lo is not None:
        lo, hi = max(lo, s_lo), max(hi, s_lo)
    if s_hi is not None:
        hi, lo = min(hi, s_hi), min(lo, s_hi)
    return lo, hi


@pytest.mark.parametrize(("s_lo", "s_hi"), [(telemetry.LO, telemetry.HI), (telemetry.LO, None), (None, telemetry.HI), (None, None)])
def test_both_bounds_are_held_within_the_range(spark, s_lo, s_hi):
    # Within, across either end, across both, and forecasts beyond either end by less and by more than the width.
    cases = [(100.0, 30.0), (10.0, 30.0), (180.0, 30.0), (100.0, 300.0), (-10.0, 30.0), (-50.0, 30.0), (220.0, 30.0), (327.53, 106.0), (0.0, 0.0), (200.0, 0.0)]
    df = spark.createDataFrame([*cases, (100.0, None)], "predicted double, width double")
    lo, hi = reports.clipped_interval(df.predicted, df.width, s_lo, s_hi)
    got = {(r.predicted, r.width): (r.lo, r.hi) for r in df.select("predicted", "width", lo.alias("lo"), hi.alias("hi")).collect()}
    without = got.pop((100.0, None))
    assert got == {(p, w): by_reference(p - w, p + w, s_lo, s_hi) for p, w in cases}
    assert without == (None, None)
