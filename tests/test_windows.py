"""Windowed features against a plain restatement of the definitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.stat_keys import KEY_LABELS
from tidemark.operators import windows as win


def statistic(values, key):
    s = pd.Series(values, dtype=float)
    v = s.dropna().to_numpy()
    n = len(v)
    if key == "unique":
        return len(set(v))
    if key == "missing_count":
        return len(s) - n
    if key == "missing_pct":
        return (len(s) - n) / len(s) * 100
    if key == "freq":
        return 0 if not n else pd.Series(v).value_counts().max()
    if not n:
        return None
    if key == "top":
        return pd.Series(v).mode().iloc[0]
    m = v.mean()
    m2 = ((v - m) ** 2).mean()
    flat = m2 <= (1e-15 * m) ** 2
    return {
        "mean": m, "median": np.median(v), "std": v.std(ddof=1) if n > 1 else 0, "variance": v.var(), "min": v.min(), "max": v.max(),
        "range": np.ptp(v), "p2p": np.ptp(v), "rms": np.sqrt((v**2).mean()), "energy": (v**2).sum(),
        "skew": 0 if n <= 2 or flat else ((v - m) ** 3).mean() / m2**1.5, "kurtosis": 0 if n <= 3 or flat else ((v - m) ** 4).mean() / m2**2 - 3,
        "zcr": 0 if n < 2 else np.count_nonzero(np.diff(np.signbit(v))) / (n - 1),
    }[key]


def layout_of(n, size, step, partial):
    out, start = [], 0
    while start < n:
        if start + size <= n:
            out.append((start, start + size))
            start += step
            continue
        if partial:
            out.append((start, n))
        break
    return out


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(0)
    rows = []
    for e, n in (("a", 57), ("b", 9), ("c", 130)):
        x = np.round(rng.normal(0, 2, n), 1)
        for i in range(n):
            known = rng.random() >= 0.15 and not (e == "c" and 40 <= i < 75)  # one stretch without any value
            rows.append((e, i, float(x[i]) if known else None, 5.0 if i % 2 else -0.0))
    return spark.createDataFrame(rows, "e string, t long, x double, y double"), pd.DataFrame(rows, columns=["e", "t", "x", "y"])


@pytest.mark.parametrize(
    "size,overlap,kind,partial",
    [(10, 50, "Sliding", True), (10, 50, "Fixed", True), (16, 0, "Fixed", False), (20, 90, "Sliding", False), (7, 35, "Sliding", True), (200, 10, "Sliding", True)],
)
def test_features(signal, size, overlap, kind, partial, monkeypatch):
    monkeypatch.setattr(win, "SUB_PANE_ROWS", 16)
    df, pdf = signal
    keys = list(KEY_LABELS)
    got = win.windowed_features(df, ["x", "y"], keys, size, ["t"], ["e"], overlap_pct=overlap, window_type=kind, keep_partial=partial).toPandas().set_index(["e", "Window Number"])
    layout = win.window_layout(size, "samples", overlap, kind, partial)
    seen = 0
    for e, part in pdf.groupby("e"):
        for number, (lo, hi) in enumerate(layout_of(len(part), layout.size, layout.step, partial), start=1):
            row = got.loc[(e, number)]
            seen += 1
            assert (row["Start Sample"], row["End Sample"]) == (lo, hi - 1)
            for name in "xy":
                for key in keys:
                    want, value = statistic(list(part[name][lo:hi]), key), row[f"{KEY_LABELS[key]} {name}"]
                    assert (want is None and pd.isna(value)) or value == pytest.approx(want, abs=1e-9), (e, number, name, key)
    assert seen == len(got)


def test_step_truncates_and_size_rounds_half_to_even():
    assert win.window_layout(100, "samples", 90, "Sliding").step == 9
    assert win.window_layout(50, "samples", 90, "Sliding").step == 4
    assert win.window_layout(2.5).size == 2
    assert win.window_layout(1.5, "seconds", 0, "Fixed", False, 3.0).size == 4
    assert win.window_layout(10, "samples", 50, "Fixed").step == 10


@pytest.mark.parametrize("n,size,overlap,partial", [(10, 4, 50, True), (3, 4, 0, True), (3, 4, 0, False), (100, 100, 90, True), (0, 4, 0, True)])
def test_window_table(spark, n, size, overlap, partial):
    layout = win.window_layout(size, "samples", overlap, "Sliding", partial)
    rows = win.window_table(spark.createDataFrame([(n,)], "n long"), "n", layout).orderBy("Window Number").collect()
    assert [(r["Start Sample"], r["End Sample"] + 1) for r in rows] == layout_of(n, size, layout.step, partial)


def test_trailing_window(signal):
    df, pdf = signal
    out = win.trailing_window(df, ["x"], 4, "t", ["e"]).toPandas()
    for _, row in out.iterrows():
        part = pdf[(pdf.e == row.e) & (pdf.t <= row.t) & (pdf.t >= row.t - 4)]
        assert [None if pd.isna(v) else v for v in part.x] == [s["x"] for s in row.signal_window]


@pytest.mark.parametrize(
    "kwargs,text",
    [({"window_size": 0}, "greater than zero"), ({"overlap_pct": 95}, "between 0 and 90"), ({"columns": []}, "numeric column"), ({"keys": []}, "feature"),
     ({"keys": ["missing_count"]}, "statistical"), ({"unit": "seconds", "sample_rate_hz": 0}, "Sample rate"), ({"order_by": []}, "order")],
)
def test_refusals(signal, kwargs, text):
    args = {"columns": ["x"], "keys": ["mean"], "window_size": 5, "order_by": ["t"], **kwargs}
    with pytest.raises(ValueError, match=text):
        win.windowed_features(signal[0], **args)


def test_text_is_read_as_numbers(spark):
    df = spark.createDataFrame([(0, "1"), (1, "x"), (2, "3")], "t long, s string")
    row = win.windowed_features(df, ["s"], ["mean", "missing_count"], 3, ["t"]).first()
    assert (row["Mean s"], row["Missing Count s"]) == (2.0, 1)


def test_count_is_no_windowed_statistic(spark):
    df = spark.range(4).withColumn("v", F.col("id") * 1.0)
    row = win.windowed_features(df, ["v"], ["mean", "count"], 4, ["id"]).first()
    assert row["Mean v"] == 1.5 and row["count v"] is None
