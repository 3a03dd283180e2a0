"""Views over small tables deal their rows to all tasks."""

import pytest
from pyspark.sql import functions as F

from siftwork.plans import queries
from siftwork.plans import views as v


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.range(0, 200, 1, 1)
    parts = rows.select(F.col("id").alias("p_partkey"), F.lit("a b").alias("p_name"), F.lit("x").alias("p_brand"), F.lit(3).alias("p_size"))
    parts.write.parquet(str(tmp_path / "part.parquet"))
    state = F.element_at(F.array(*map(F.lit, "FOP")), (F.col("id") % 3 + 1).cast("int"))
    orders = rows.select(F.col("id").alias("o_orderkey"), (F.col("id") % 40).alias("o_custkey"), state.alias("o_orderstatus"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("view", [v.manifests, v.run_sources, v.rename_files, v.source_files, v.key_files, v.csharp_files])
def test_files_of_one_split_are_made_by_all_tasks(spark, folder, view):
    counts = view(spark, folder).groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) == v.tasks(spark)


def test_every_micro_batch_has_files_for_all_tasks(spark, folder, monkeypatch):
    write, newest = queries.materialize, queries.newest_config
    places = []
    monkeypatch.setattr(queries, "materialize", lambda df, name: places.append(write(df, name)) or places[-1])
    ledgers = []
    monkeypatch.setattr(queries, "newest_config", lambda spark, ledger: ledgers.append(ledger) or newest(spark, ledger))
    found = queries.last_good_config_stream(spark, folder)
    assert sorted(found.collect()) == sorted(queries.last_good_config_table(spark, folder).collect())
    assert len(places[0].inputFiles()) == 3 * v.tasks(spark)
    assert sorted(r["batch_id"] for r in spark.read.parquet(ledgers[0]).select("batch_id").distinct().collect()) == [0, 1, 2]

