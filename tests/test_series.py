from datetime import date, timedelta

import numpy as np
import pytest
from builders import rows

from tallywing.operators import series


def daily(spark, values, start=date(2024, 1, 1), key=None):
    data = [(start + timedelta(days=n), float(v), key) for n, v in enumerate(values) if v is not None]
    return spark.createDataFrame(data, "date date, y double, key string")


def test_forecast_equals_polyfit(spark):
    rng = np.random.default_rng(1)
    y = 50 + 2 * np.arange(40) - 0.1 * np.arange(40) ** 2 + rng.normal(0, 3, 40)
    got = rows(series.forecast(daily(spark, y), "y", days=5))
    b = np.polyfit(np.arange(40), y, 2)
    fit = np.polyval(b, np.arange(45))
    assert [r["predicted"] for r in got] == pytest.approx(list(fit), abs=1e-8)
    sigma = np.std(y - fit[:40])
    last = got[-1]
    assert last["is_forecast"] and last["date"] == date(2024, 1, 1) + timedelta(days=44)
    assert last["upper_95"] == pytest.approx(fit[-1] + 1.96 * sigma)
    assert all(r["lower_95"] >= 0 for r in got if r["is_forecast"])
    assert sum(r["y"] - r["predicted"] for r in got[:40]) == pytest.approx(0, abs=1e-7)
    assert got[0]["lower_95"] is None


def test_forecast_with_gaps_uses_calendar_days(spark):
    got = rows(series.forecast(daily(spark, [1, None, 9, 16, None, 36]), "y", days=1))
    assert [r["day_num"] for r in got] == [0, 2, 3, 5, 6]
    assert got[-1]["predicted"] == pytest.approx(49)


def test_short_series_have_no_forecast(spark):
    for values in ([], [1], [1, 2]):
        got = rows(series.forecast(daily(spark, values), "y", days=2))
        assert all(r["predicted"] is None for r in got)
        assert len(got) == (len(values) + 2 if values else 0)


def test_series_by_key_are_independent(spark):
    a, b = daily(spark, [1, 4, 9, 16], key="a"), daily(spark, [5, 5, 5, 5], date(2024, 3, 1), "b")
    both = rows(series.forecast(a.unionByName(b), "y", 1, ["key"]))
    last = {r["key"]: r["predicted"] for r in both if r["is_forecast"]}
    assert last["a"] == pytest.approx(25) and last["b"] == pytest.approx(5)


def test_default_window_cannot_flag_but_the_other_does(spark):
    spiky = daily(spark, [1, 1, 1, 1, 1, 1, 1, 1e6])
    default = rows(series.rolling_anomalies(spiky, "y"))
    assert not any(r["is_anomaly"] for r in default)
    assert default[-1]["z_score"] == pytest.approx(6 / 7 ** 0.5, abs=1e-4)
    assert default[0]["anomaly_direction"] == "Dip" and default[0]["z_score"] is None
    other = rows(series.rolling_anomalies(spiky, "y", exclude_current=True))
    assert [r["is_anomaly"] for r in other] == [False] * 7 + [True]
    assert other[-1]["anomaly_direction"] == "Spike"


def test_parts_add_up(spark):
    y = [10 + (n % 7) * 3 + n * 0.5 for n in range(42)]
    parts = series.decompose(daily(spark, y), "y")
    for r in rows(parts):
        assert r["actual"] == pytest.approx(r["trend"] + r["seasonal"] + r["residual"])
    (strength,) = rows(series.decomposition_strength(parts))
    assert strength["trend_strength"] > 0.9 and strength["seasonal_strength"] > 0.9


def test_decompose_short_series(spark):
    assert [r["trend"] for r in rows(series.decompose(daily(spark, [1, 2, 3]), "y"))] == [None] * 3
