from pyspark.sql import functions as F

from parlance.operators import turns
from parlance.plans import source_queries
from parlance.sources import readers


def test_forward_fill_carries_over_range_partitions(spark):
    rows = [(i, i % 3, f" v{i}" if i % 50 == 7 else (None if i % 2 else " ")) for i in range(600)]
    df = spark.createDataFrame(rows, "i long, g long, city string").repartition(5)

    def brute(keyed):
        last, out = {}, {}
        for i, g, c in rows:
            k = g if keyed else 0
            last[k] = (c or "").strip() or last.get(k)
            out[i] = last[k]
        return out

    for keys in (None, ["g"]):
        got = turns.forward_fill(df, "i", ["city"], keys)
        assert got.columns == df.columns and {r.i: r.city for r in got.collect()} == brute(keys is not None)
    assert turns.forward_fill(df.limit(0), "i", ["city"]).count() == 0


def test_chart_documents_are_bounded(spark, tmp_path, monkeypatch):
    n = 5000
    e = spark.range(n).select(F.lit(1).cast("bigint").alias("user_id"), F.when(F.col("id") % 10 > 0, F.concat(F.lit('{"k": '), "id", F.lit("}"))).alias("props"), (F.col("id") % 50).cast("double").alias("value"))
    e.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    sizes = []
    real = readers.chart_rows

    def seen(json):
        sizes.append(json)
        return real(json)

    monkeypatch.setattr(readers, "chart_rows", seen)
    got = source_queries.scan_json_chart(spark, str(tmp_path))
    want = sorted((i if i % 10 else -1, float(i % 50)) for i in range(n) if i % 50 > 20)
    assert sorted((-1 if r.k is None else r.k, r.value) for r in got.collect()) == want
    assert "block" in got._jdf.queryExecution().analyzed().toString() and source_queries.CHART_ROWS <= 1000
