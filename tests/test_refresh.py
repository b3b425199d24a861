"""Only months that changed are written again."""

from pathlib import Path

from pyspark.sql import functions as F

from tallybook.sources import sinks


def files(path):
    return {m.parent.name if m.parent.name.startswith("month_num") else "": None for m in Path(path).rglob("*.parquet")}, {
        str(f.relative_to(path)) for f in Path(path).rglob("part-*.parquet") if "_months" not in str(f)}


def rows_of(spark, path):
    return sorted(map(str, sinks.read_index(spark, path).drop("embedding").toJSON().collect()))


def actions(done):
    return {(r["year"], r["month_num"]): r["action"] for r in done.collect()}


def test_a_change_rewrites_one_folder(spark, statement, tmp_path):
    path, anew = str(tmp_path / "index"), str(tmp_path / "anew")
    ledger = statement.drop("txn_id")
    assert actions(sinks.refresh_index(ledger, path)) == {(2026, m): "added" for m in (1, 2, 3)}
    first = files(path)[1]
    assert set(actions(sinks.refresh_index(ledger, path)).values()) == {"kept"}
    assert files(path)[1] == first
    # Two amounts trade places: count, sum and dates stay as they are.
    feb = (F.month("date") == 2) & F.col("amount").isin(-180.0, -20.0)
    traded = ledger.withColumn("amount", F.when(feb, -200.0 - F.col("amount")).otherwise(F.col("amount")))
    assert actions(sinks.refresh_index(traded, path)) == {(2026, 1): "kept", (2026, 2): "changed", (2026, 3): "kept"}
    second = files(path)[1]
    assert {f for f in first if "month_num=2" not in f} == {f for f in second if "month_num=2" not in f}
    assert not {f for f in first & second if "month_num=2" in f}
    sinks.write_index(sinks.build_index(traded), anew)
    columns = sinks.read_index(spark, anew).columns
    assert sorted(sinks.read_index(spark, path).select(columns).toJSON().collect()) == sorted(sinks.read_index(spark, anew).toJSON().collect())


def test_vectors_and_texts_are_made_where_they_are_written(spark, statement, tmp_path):
    """Ledger columns alone move to their month's task; whole rows are not sorted by folder."""
    ledger = statement.drop("txn_id")
    index = sinks.build_index(spark.createDataFrame(ledger.collect(), ledger.schema))
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("ArrowEvalPython") < plan.index("RebalancePartitions")
    moved = plan[plan.index("RebalancePartitions"):]
    assert "txn_" not in moved and "EEEE" not in moved
    sinks.write_index(index, str(tmp_path / "index"))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert sinks.read_index(spark, str(tmp_path / "index")).count() == statement.count()


def test_months_that_are_gone(spark, statement, tmp_path):
    path = str(tmp_path / "index")
    ledger = statement.drop("txn_id")
    sinks.refresh_index(ledger, path, embed=False)
    done = sinks.refresh_index(ledger.where("month(date) <> 2"), path, embed=False)
    assert actions(done) == {(2026, 1): "kept", (2026, 2): "removed", (2026, 3): "kept"}
    assert {r["month_num"] for r in sinks.read_index(spark, path).select("month_num").distinct().collect()} == {1, 3}
    assert not [f for f in files(path)[1] if "month_num=2" in f]
    assert actions(sinks.refresh_index(ledger, path, embed=False))[2026, 2] == "added"


def test_one_copy_less_shows(spark, statement, tmp_path):
    path = str(tmp_path / "index")
    ledger = statement.drop("txn_id")
    sinks.refresh_index(ledger, path, embed=False)
    less = ledger.where("month(date) = 1").dropDuplicates().unionByName(ledger.where("month(date) <> 1"))
    assert actions(sinks.refresh_index(less, path, embed=False)) == {(2026, 1): "changed", (2026, 2): "kept", (2026, 3): "kept"}
