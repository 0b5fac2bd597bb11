import pytest
from pyspark.sql import functions as F

from parlance.operators import graphs, joins, panels, sampling, series, stats


def test_null_keys_stay_in_edges_and_go_from_features(spark):
    m = spark.createDataFrame([(1, None, "c", "k", 2, 1, 0, 2.35, 0.5, "positive"), (1, "p", "c", "k", 2, 0, 1, 2.35, -0.5, "negative")], "speech_id int, party string, concept string, category string, mention_count long, pos long, neg long, salience double, score double, label string")
    edges = panels.layer_edges(m).collect()
    assert {(r.layer, r.party) for r in edges} == {("total", None), ("total", "p"), ("positive", None), ("negative", "p")}
    f = panels.signed_agenda_feature(m, ["party", "concept"]).collect()
    assert [(r.party, r.agenda, r.feature) for r in f] == [("p", 1.0, -0.5)]


def test_interpolation_keeps_outer_gaps_unless_told(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0), (3, None), (4, None), (5, 4.0), (6, None)], "t int, v double")
    inner = [r.filled for r in series.interpolate(df, "v", "t").orderBy("t").collect()]
    assert inner == [None, 1.0, 2.0, 3.0, 4.0, None]
    assert [r.filled for r in series.interpolate(df, "v", "t", ends=True).orderBy("t").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_shortest_paths_and_closeness(spark):
    edges = spark.createDataFrame([("g", "a", "b", 1.0), ("g", "b", "c", 1.0), ("g", "a", "c", 5.0)], "graph string, a string, b string, distance double")
    nodes = spark.createDataFrame([("g", x) for x in "abcd"], "graph string, node string")
    d = graphs.shortest_paths(edges, ["graph"])
    assert {(r.a, r.b): r.distance for r in d.collect()}[("a", "c")] == 2.0
    close = {r.node: r.closeness for r in graphs.closeness(d, nodes, ["graph"]).collect()}
    assert close["d"] == 0 and close["b"] == pytest.approx((2 / 2) * (2 / 3))


def test_single_bloc_has_no_assortativity(spark):
    e = spark.createDataFrame([("g", "a", "b")], "graph string, a string, b string")
    assert graphs.assortativity(e, ["graph"], F.lit("x"), F.lit("x")).first().assortativity is None


def test_missing_event_month_takes_the_next_one(spark):
    months = spark.createDataFrame([("2000-01-01",), ("2000-04-01",)], "month string").select(F.to_date("month").alias("month"))
    ev = spark.createDataFrame([("a", "2000-02-01"), ("b", "2001-01-01")], "event string, target string").withColumn("target", F.to_date("target"))
    assert {r.event: str(r.event_month) for r in joins.resolve_month(ev, months).collect()} == {"a": "2000-04-01", "b": "2000-04-01"}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 3)
    one, other = sampling.per_group(df.repartition(7), ["g"], "id", 5, 1), sampling.per_group(df.coalesce(1), ["g"], "id", 5, 1)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in other.collect()} and one.count() == 15


def test_empty_class_counts_as_zero(spark):
    c = spark.createDataFrame([("a", "b", 3), ("b", "b", 1)], "truth string, prediction string, n long")
    by = {r.label: (r.precision, r.recall, r.f1) for r in stats.class_metrics(c).collect()}
    assert by["a"] == (0.0, 0.0, 0.0) and by["b"] == (0.25, 1.0, 0.4)
