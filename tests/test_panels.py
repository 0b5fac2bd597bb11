"""Month panels, thresholds, leads, roster rules and shock windows against hand-made rows and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import events, graphs, panels, stats, turns

SPINE = [("2020-01-01",), ("2020-02-01",), ("2020-03-01",)]


@pytest.fixture(scope="module")
def spine(spark):
    return spark.createDataFrame(SPINE, "month string")


def mentions(spark, rows):
    kinds = "month string, speech_id int, speaker string, party string, mention_count bigint, score double, label string, salience double, category string, concept string"
    return spark.createDataFrame(rows, kinds)


def test_monthly_panel(spark, spine):
    m = mentions(spark, [
        ("2020-01-01", 1, "a", "G", 2, 0.5, "positive", 2.0, "c", "X"), ("2020-01-01", 1, "a", "G", 4, -0.5, "negative", 4.0, "c", "X"), ("2020-01-01", 2, "b", "O", 6, 0.0, "mixed", 6.0, "c", "X"),
        ("2020-03-01", 3, None, None, 5, 0.0, "mixed", 5.0, None, None), ("2019-12-01", 4, "z", "G", 9, 0.0, "mixed", 9.0, "c", "X"),
    ])
    got = {r.month: r for r in panels.monthly_panel(m, spine, F.col("party"), ["G", "O"]).collect()}
    assert sorted(got) == [x for (x,) in SPINE]  # months outside the spine go, months without speeches stay
    one = got["2020-01-01"]
    assert (one.speeches, one.speakers, one.words, one.mean_words) == (2, 2, 12, 4.0)
    assert (one.G_speeches, one.G_words, one.G_speeches_per_speaker, one.G_speech_share, one.O_speech_share) == (1, 6, 1.0, 0.5, 0.5)
    assert got["2020-02-01"].speeches is None and got["2020-02-01"].G_speech_share is None
    assert got["2020-03-01"].speeches == 1 and got["2020-03-01"].G_speeches is None and got["2020-03-01"].speakers == 0
    assert panels.monthly_panel(m.where("false"), spine, F.col("party"), ["G", "O"]).where("speeches is null").count() == 3


def test_layer_features(spark, spine):
    m = mentions(spark, [
        ("2020-01-01", 1, "a", "G", 2, 0.5, "positive", 4.0, "reform", "X"), ("2020-01-01", 1, "a", "G", 4, -0.25, "negative", 8.0, "war", "Y"),
        ("2020-01-01", 2, "b", "O", 6, -1.0, "negative", 4.0, "court", "Y"), ("2020-02-01", 3, "b", "O", 6, -1.0, "negative", 2.0, "court", "Y"),
    ])
    got = {r.month: r for r in panels.layer_features(m, spine, ["reform", "war", "court"], ["X", "Y"], "reform", ["war", "court"]).collect()}
    one, two, three = (got[x] for (x,) in SPINE)
    assert (one.total_layer_weight, one.positive_layer_weight, one.negative_layer_weight) == (16.0, 2.0, 6.0)
    assert (one.reform_positive_share, one.crisis_negative_share, one.positive_negative_ratio) == (2 / 16, 6 / 16, 2 / 6)
    assert (one.y_negative_weight, one.y_total_share, one.war_total_share) == (6.0, 12 / 16, 0.5)
    assert (two.reform_positive_share, two.crisis_negative_share, two.x_total_weight, two.court_negative_share) == (0.0, None, None, 1.0)
    assert three.total_layer_weight is None and three.reform_positive_share is None


def test_thresholds_and_leads(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=24), rng.normal(size=24)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(24, None, 2.0), (25, 9.0, None)]
    p = spark.createDataFrame(rows, "t int, x double, y double")
    driver = np.array([*x, 9.0])
    for r in stats.threshold_tests(p, "x", "y").collect():
        cut = np.quantile(driver, r.quantile)
        one = np.array([b for _, a, b in rows if a is not None and a >= cut and b is not None])
        two = np.array([b for _, a, b in rows if b is not None and not (a is not None and a >= cut)])
        assert (r.crisis_months, r.other_months) == (len(one), len(two)) and math.isclose(r.cutoff, cut)
        assert math.isclose(r.welch_t, (one.mean() - two.mean()) / math.sqrt(one.var(ddof=1) / len(one) + two.var(ddof=1) / len(two)))
    assert stats.threshold_tests(p.where("t < 2"), "x", "y").where("welch_t is not null").count() == 0
    assert {r.lead: (r.n, round(r.pearson, 9)) for r in stats.lead_correlations(p.where("t < 24"), "t", [("x", "y")]).collect()} == {k: (24 - k, round(np.corrcoef(x[:-k], y[k:])[0, 1], 9)) for k in (1, 2, 3)}
    assert stats.lead_correlations(p.where("t < 8"), "t", [("x", "y")]).count() == 0  # seven pairs are too few
    line = stats.fitted_pairs(p, [("x", "y")]).first()
    assert line.n == 24 and np.allclose([line.slope, line.intercept], np.polyfit(x, y, 1))


def test_roster_rules(spark):
    rows = [
        ("22", "Ali Kara", 1, "Cumhuriyet Halk Partisi", None), ("22", "Veli Can", 2, "12", None), ("22", "ALİ KARA", 3, "a · b", ""), ("23", "Ali Kara", 4, "Own", "NaN"),
        ("23", "Can Su", 5, "x" * 81, " Doğru Yol Partisi "), ("23", "Nur Ay", 6, None, None), ("23", "Nur Ay", 6, "Z", None), (None, None, 7, "Q", None),
    ]
    r = spark.createDataFrame(rows, "term string, name string, row int, party string, changed string")
    index = turns.roster_index(r, "term", "name", "row", "party", "changed")
    got = {(x.term, x.name_key): (x.row, x.place, x.party) for x in index.collect()}
    assert got[("22", "ali kara")] == (3, 1, "Bilinmeyen") and got[("22", "veli can")] == (2, 2, "Bilinmeyen") and got[("23", "ali kara")] == (4, 4, "Own")
    assert got[("23", "can su")] == (5, 5, "Doğru Yol Partisi") and got[("23", "nur ay")] == (6, 6, "Z") and len(got) == 6
    assert {x.name_key: x.party for x in turns.name_index(index).collect()}["ali kara"] == "Own"
    assert turns.roster_index(r.where("false"), "term", "name", "row").count() == 0


def test_first_place_with_last_value(spark):
    rows = [("22", "Ali Kara Demir", 1, "A"), ("22", "Demir Ali Su", 2, "B"), ("22", "Ali Kara Demir", 3, "C")]
    index = turns.roster_index(spark.createDataFrame(rows, "term string, clean_name string, row int, party string"), "term", "clean_name", "row")
    said = spark.createDataFrame([("Ali Demir", "22")], "speaker string, term string")  # both names hold its two words
    assert turns.resolve_speakers(said, index).first().party == "C"


def test_shock_windows(spark):
    w = spark.createDataFrame([("e", "pre", "m1"), ("e", "shock", "m2"), ("e", "post", "m3"), ("f", "pre", "m9")], "event string, stage string, month string")
    rows = spark.createDataFrame([("m1", "A", 1.0), ("m1", "B", 3.0), ("m2", "A", 2.0), ("m3", "A", 6.0)], "month string, party string, v double")
    side = events.sides(w)
    got = {r.party: (r.v_pre, r.v_post, r.v_delta) for r in events.prepost(side, rows, ["party"], ["v"]).collect()}
    assert got == {"A": (1.0, 4.0, 3.0), "B": (3.0, None, None)}
    assert tuple(events.top_share(side, rows, [], "party", "v").first())[1:] == ("B", "A")
    p = rows.withColumnRenamed("v", "position")
    assert {r.month: (r.spread, r.gap) for r in events.monthly_spread(p, "A", "B").collect()} == {"m1": (2.0, 2.0), "m2": (0.0, None), "m3": (0.0, None)}


def test_stage_turnover(spark):
    rows = [("e", "pre", "s1", "A", 3.0), ("e", "pre", "s2", "B", 1.0), ("e", "shock", "s2", "B", 2.0), ("e", "shock", "s1", "A", -1.0), ("e", "post", "s3", "B", 1.0), ("f", "pre", "s1", "A", 1.0)]
    d = spark.createDataFrame(rows, "event string, stage string, speaker string, party string, gatekeeper_score double")
    got = {r.event: r for r in graphs.stage_turnover(d, "party").collect()}
    e, f = got["e"], got["f"]
    assert (e.speaker_pre, e.speaker_shock, e.party_shock, e.speaker_turnover, e.party_turnover, e.party_persists) == ("s1", "s2", "B", True, True, True)
    assert math.isclose(e.score_delta, -1.0) and math.isclose(e.hhi_delta, 1.0 - 10 / 16)
    assert f.speaker_turnover and f.party_persists and f.hhi_delta is None


def test_layer_distances(spark, spine):
    rows = [("2020-01-01", "total", "g", "A", "x", 1.0), ("2020-01-01", "total", "o", "B", "y", 2.0), ("2020-01-01", "total", "g", "C", "y", 1.0), ("2020-01-01", "negative", "g", "A", "x", 1.0)]
    e = spark.createDataFrame(rows, "month string, layer string, bloc string, party string, concept string, weight double")
    got = {r.month: r for r in graphs.layer_distances(e, spine, ("g", "o"), ("A", "B")).collect()}
    one = got["2020-01-01"]
    assert math.isclose(one.bloc_distance_total, 1 - 1 / math.sqrt(2)) and one.pair_distance_total == 1.0
    assert one.bloc_distance_negative is None and one.bloc_distance_positive is None and got["2020-03-01"].pair_distance_total is None


def test_directed_panel(spark, spine):
    rows = [
        ("2020-01-01", 1, "A", "B", "x", 4.0, 1.0, 3.0), ("2020-01-01", 1, "B", "A", "x", 2.0, 0.0, 2.0), ("2020-01-01", 2, "A", "C", "y", 6.0, 1.0, 5.0),
        ("2020-02-01", 3, "A", "C", "y", 5.0, 2.0, 0.0),
    ]
    d = spark.createDataFrame(rows, "month string, speech_id int, source string, target string, topic string, total double, positive double, negative double")
    cross = (F.col("source") == "A") != (F.col("target") == "A")
    got = {r.month: r for r in graphs.directed_panel(d, spine, cross, ["x"], ("A", "B"), 3).collect()}
    one, two, three = (got[m] for (m,) in SPINE)
    assert (one.total, one.negative, one.speeches, one.mentions) == (12.0, 10.0, 2, 3)
    assert (one.negative_share, one.x_negative_share, one.pair_negative_share, one.first_in_negative_share) == (10 / 12, 0.5, 0.5, 0.2)
    assert (one.negative_reciprocity, one.negative_density, one.positive_reciprocity, one.positive_density) == (0.2, 0.5, 0.0, 2 / 6)
    assert two.negative_density == 0.0 and two.negative_reciprocity is None and two.negative_cross_share is None and two.pair_negative_share_lag1 == 0.5
    assert three.total is None and three.negative_density == 0.0 and three.positive_cross_share_lag1 == 1.0


def test_speaker_tops(spark):
    rows = [("t", "a", "P")] * 3 + [("t", "a", "Q")] * 3 + [("t", "b", "Q")] * 4 + [("t", "c", "R")]
    m = spark.createDataFrame(rows, "term string, speaker string, party string")
    assert {r.speaker: (r.party, r.n) for r in panels.main_party(m, ["term"]).collect()} == {"a": ("P", 3), "b": ("Q", 4), "c": ("R", 1)}
    got = sorted((r.list, r["rank"], r.speaker, r.party, r.n) for r in panels.speaker_tops(m, "term", n=2, parties=2, each=1, least=3).collect())
    assert got == [("P", 1, "a", "P", 3), ("Q", 1, "b", "Q", 4), ("all", 1, "a", "P", 6), ("all", 2, "b", "Q", 4)]
