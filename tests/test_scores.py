"""Scoring formulas on literal rows at their boundaries."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import evaluate
from tidemark.functions import scores as S
from tidemark.semantics import js_round, nz


def test_js_round_goes_up_at_half(spark):
    assert evaluate(spark, js_round("x"), [-2.5, -0.5, 0.5, 2.5, None], "x double") == [-2.0, 0.0, 1.0, 3.0, None]
    assert evaluate(spark, js_round("x", 2), [1.005, 12.345], "x double") == [1.0, 12.35]


def test_nz(spark):
    assert evaluate(spark, nz("x"), [None, float("nan"), 0.0, 2.0], "x double") == [0.0, 0.0, 0.0, 2.0]


def test_label_cuts(spark):
    got = evaluate(spark, S.signal_label("x"), [80.0, 79.99, 60.0, 40.0, 20.0, 19.9], "x double")
    assert got == ["extremely_hot", "hot", "hot", "warm", "cool", "cold"]


def test_dampening(spark):
    got = evaluate(spark, S.market_cap_dampening("r", "c"), [(None, 5e7), (None, 1e9), (1, None), (200, 0.0), (None, None)], "r int, c double")
    assert got == pytest.approx([1.0, 0.05**0.3, 0.15, 1.0, 1.0])


def test_multipliers(spark):
    assert evaluate(spark, S.z_multiplier("x"), [2.0, 3.0, 9.0], "x double") == [1.0, 1.25, 1.5]
    assert evaluate(spark, S.platform_multiplier("x"), [0, 1, 2, 3], "x int") == [0.7, 0.7, 1.0, 1.3]


def test_contrarian(spark):
    rows = [(4, 4), (5, 5), (10, 1), (10, 5)]
    assert evaluate(spark, S.contrarian_warning("n", "b"), rows, "n int, b int") == [None, "potential_reversal", "potential_bounce", None]
    assert evaluate(spark, S.sentiment_skew("n", "b"), rows, "n int, b int") == [50.0, 100.0, 10.0, 50.0]


def test_delisting_also_counts_as_listing(spark):
    assert evaluate(spark, S.phrase_class("x", "exchange_listing"), ["Delisting soon", "listed"]) == [True, False]


def test_event_modifier_is_clamped(spark):
    flags = {n: F.lit(v[0] < 0) for n, v in S.EVENT_CLASSES.items()}
    assert evaluate(spark, S.event_modifier(flags), ["a"]) == [-30.0]


def test_hit(spark):
    rows = [("hot", 1.0, "fomo"), ("hot", 1.0, "fud"), ("cold", -1.0, "fomo"), ("cold", -1.0, "fud"), ("warm", 1.9, "fud"), ("warm", -2.0, "fomo")]
    assert evaluate(spark, S.evaluate_hit("l", "p", "k"), rows, "l string, p double, k string") == [True, False, True, False, True, False]


def test_graph_boost(spark):
    e = S.graph_boost(F.lit(0.5), F.array(F.lit(20.0), F.lit(5.0), F.lit(1.0), F.lit(9.0)), F.lit(0.5), F.lit(75.0), F.lit(1), F.lit(0), F.lit(2))
    r = evaluate(spark, e, ["a"])[0]
    assert r.boost == pytest.approx((5 + 2.5 + 0.5 + 2 + 3) * 0.5)
    assert r.multiplier == pytest.approx(1.075)
    assert r.details == ["influencer_recommends(0.50)", "correlated_hot×3(w)", "narrative_momentum(75)", "event_impacts×2", "entity_conf(0.50)"]


def test_onchain_events(spark):
    e = S.onchain_events(F.lit(60.0), F.lit(60.0), F.lit(300.0), F.lit(100.0), F.lit(2), F.lit(7), F.lit(True))
    r = evaluate(spark, e, ["a"])[0]
    assert [(x.type, x.modifier) for x in r] == [("volume_spike", 7.0), ("liquidity_drain", -12.0), ("sell_pressure", -5.0), ("token_boosted", -3.0)]
    assert [x.detail for x in r[:3]] == ["h1 vol 6x vs h6 avg", "liq $100 < 50% of 24h vol", "sell/buy ratio 3.5x"]


def test_decay(spark):
    assert evaluate(spark, S.decayed_confidence(F.lit(0.6), "d"), [7.0, 8.0, 100.0], "d double") == pytest.approx([0.6, 0.51, 0.05])
