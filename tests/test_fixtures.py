from parlance.operators import mentions, panels
from parlance.plans import fixtures as X

SF = "/root/testdata/sf0.001"


def test_tasks_of_mentions_grow_with_the_line_items(spark, monkeypatch):
    small, few = [sorted(mentions.speech_labels(X.mentions(spark, SF)).collect())], X.directed(spark, SF).count()
    monkeypatch.setattr(X, "TASK_ROWS", 200)
    m, d = X.mentions(spark, SF), X.directed(spark, SF)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert m.rdd.getNumPartitions() == d.rdd.getNumPartitions() == -(-lines // 200)
    assert sorted(mentions.speech_labels(m).collect()) == small[0] and d.count() == few
    # distinct speeches are counted where the join has put them
    plan = panels.layer_edges(m)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(layer" in plan and "speech_id#" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
