import math
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adtide.functions import quantiles
from adtide.functions.quantiles import percentiles
from adtide.functions.ratios import pct_change, trend_label, with_ratio_metrics
from adtide.functions.text import clean_campaign_name


def test_ratios_are_null_on_zero_denominator(spark):
    df = spark.createDataFrame([(0.0, 0, 0, 0, 100.0), (50.0, 1000, 20, 4, -50.0)], "spend double, impressions long, clicks long, purchases long, revenue double")
    zero, other = with_ratio_metrics(df).collect()
    assert [zero[c] for c in ("ctr", "roas", "cvr", "cpc", "cpm")] == [None] * 5
    assert (other.ctr, other.roas, other.cvr, other.cpc, other.cpm) == (0.02, -1.0, 0.2, 2.5, 50.0)


def test_pct_change_and_label(spark):
    df = spark.createDataFrame([(6.0, 4.0), (3.0, 0.0), (1.0, None), (-1.0, -2.0)], "r double, p double")
    change = pct_change(F.col("r"), F.col("p"))
    rows = df.select(change.alias("c"), trend_label(change > 0).alias("t")).collect()
    assert [r.c for r in rows] == [50.0, 0.0, None, -50.0]
    assert [r.t for r in rows] == ["increasing", "decreasing", "decreasing", "decreasing"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("  men   comfortmax\tLAUNCH ", "Men Comfortmax Launch"),
        ("Men-ATHLEISURE cooli-g", "Men-Athleisure Cooli-G"),
        ("o'neil", "O'Neil"),
        ("3d shirt", "3D Shirt"),
        ("m n | athleisure", "M N | Athleisure"),
        ("élan ÀB", "Élan Àb"),
        ("a  b", "A B"),
        ("", ""),
    ],
)
def test_clean_campaign_name(spark, raw, clean):
    out = spark.createDataFrame([(raw,)], "n string").select(clean_campaign_name(F.col("n")).alias("n"))
    assert out.first().n == clean


def _check(spark, groups, probs, few):
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r for r in percentiles(df, "v", probs, ["k"], few_groups=few).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k].n == len(vs)
        for i, p in enumerate(probs):
            assert math.isclose(got[k][f"q{i}"], np.quantile(np.array(vs, float), p), rel_tol=1e-12, abs_tol=1e-300)


@pytest.mark.parametrize("few", [True, False])
def test_percentiles_match_brute_force(spark, few):
    rng = random.Random(1)
    groups = {
        "a": [rng.gauss(0, 1) for _ in range(700)],
        "hot": [0.0] * 900 + [rng.expovariate(1.0) for _ in range(301)],
        "one": [-3.25],
        "near": [1 + i * 1e-13 for i in range(400)],
        "wide": [10.0**e * s for e in range(-300, 300, 7) for s in (1, -1)],
        "tied": [1.0, 2.0, 4.0, 8.0],
    }
    _check(spark, groups, [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0], few)


def test_percentile_interpolates(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 4.0, 8.0)], "k int, v double")
    row = percentiles(df, "v", [0.25, 0.5], ["k"]).first()
    assert (row.q0, row.q1) == (1.75, 3.0)
    assert percentiles(df, "v", [0.25], ["k"], approx=True).first().q0 == 1.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=60), st.floats(0, 1))
def test_percentiles_property(spark, values, p):
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    got = percentiles(df, "v", [p], ["k"], few_groups=True).first()
    ordered = sorted(values)
    pos = (len(values) - 1) * p
    lo, hi = ordered[math.floor(pos)], ordered[math.ceil(pos)]
    want = lo if lo == hi else lo + (hi - lo) * (pos - math.floor(pos))
    assert got.n == len(values)
    assert got.q0 == want or math.isclose(got.q0, want, rel_tol=1e-9) or math.isinf(want)


def test_order_key_is_the_bits_of_the_double(spark):
    rng = random.Random(9)
    edges = [2.0**e for e in range(-1074, 1024, 3)]
    values = [0.0, -0.0, 5e-324, 2.2250738585072014e-308, math.nextafter(2.2250738585072014e-308, 0), 1.7976931348623157e308, math.inf]
    values += edges + [math.nextafter(v, 0) for v in edges] + [math.nextafter(v, math.inf) for v in edges]
    values += [v for _ in range(3000) if math.isfinite(v := struct.unpack("<d", rng.randbytes(8))[0])]
    values += [1.7e12 + k for k in range(50)] + [1000 / k for k in range(1, 500)] + [math.exp(rng.uniform(-700, 700)) for _ in range(500)]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in quantiles.with_order_key(df, "v", "k").collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.k == (-bits if r.v < 0 else bits), r


def test_windows_stay_small_whatever_the_values(spark, monkeypatch):
    """Values near 1.7e12 lie in one cell of the first pass and in many of the next ones."""
    values = [1.7e12 + k / 8 for k in range(30000)]
    df = spark.createDataFrame([("m", v) for v in values], "k string, v double").repartition(4)
    seen = []
    plain = quantiles._running

    def watched(cells, group, cell, carried):
        seen.append(cells.groupBy(*group).count().agg(F.max("count")).first()[0])
        return plain(cells, group, cell, carried)

    monkeypatch.setattr(quantiles, "_running", watched)
    got = percentiles(df, "v", [0.25, 0.5], ["k"], few_groups=True).first()
    assert (got.q0, got.q1) == tuple(np.quantile(values, [0.25, 0.5]))
    assert len(seen) == 6 and max(seen) <= 2048 <= quantiles.CELLS


def test_percentiles_beyond_the_broadcast_bound(spark, monkeypatch):
    rng = random.Random(2)
    groups = {f"g{k}": [rng.gauss(0, 1) for _ in range(20)] for k in range(30)}
    monkeypatch.setattr(quantiles, "COLLECTED_CELLS", 0)
    _check(spark, groups, [0.3, 0.5], False)
    monkeypatch.setattr(quantiles, "BROADCAST_CELLS", 0)
    _check(spark, groups, [0.3, 0.5], False)
