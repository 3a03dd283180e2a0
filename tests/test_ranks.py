import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftwork.operators import lines, ranks, repo
from siftwork.operators.ranks import ranked_within
from siftwork.sources.checkpoints import materialize


def brute_force(rows, key, order):
    groups, out = defaultdict(list), []
    for row in rows:
        groups[key(row)].append(row)
    for group in groups.values():
        out += [(*row, k + 1) for k, row in enumerate(sorted(group, key=order))]
    return sorted(out, key=repr)


@pytest.mark.parametrize("task_rows", [10, 1000, 2000, 10**6])
def test_ranks_of_hot_and_null_keys(spark, task_rows):
    rng = random.Random(5)
    keys = ["hot"] * 4000 + [None] * 1500 + [f"k{k % 700}" for k in range(3000)]
    rows = [(key, rng.randrange(50), place) for place, key in enumerate(keys)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, n int, place int")
    found = ranked_within(df, ["run"], [F.desc("n"), "place"], task_rows=task_rows)
    assert found.columns == ["run", "n", "place", "rank"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_force(rows, lambda r: r[0], lambda r: (-r[1], r[2]))


def test_several_key_columns_and_nulls_in_each(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, None]), rng.choice(["a", None]), place) for place in range(2000)]
    found = ranked_within(spark.createDataFrame(rows, "run int, class string, place int"), ["run", "class"], ["place"], "at", task_rows=300)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_force(rows, lambda r: r[:2], lambda r: r[2])


def test_ties_take_each_rank_once_and_empty_tables_none(spark):
    rows = [("a", 1)] * 500 + [("a", 0)] + [("b", 1)] * 3
    found = ranked_within(spark.createDataFrame(rows, "key string, n int"), ["key"], ["n"], task_rows=100).collect()
    assert sorted(r["rank"] for r in found if r["key"] == "a") == list(range(1, 502))
    assert [r["rank"] for r in found if r["n"] == 0] == [1]
    assert ranked_within(spark.createDataFrame([], "key string, n int"), ["key"], ["n"]).collect() == []


def test_a_hot_key_is_dealt_to_several_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20000).select(F.lit("hot").alias("key"), F.xxhash64("id").alias("v"))
        found = ranked_within(df, ["key"], ["v"], task_rows=5000)
        tasks = materialize(found.withColumn("_task", F.spark_partition_id()), "by-task").groupBy("_task").count()
        assert tasks.agg(F.max("count")).first()[0] < 10000
        ordered = [(r["rank"], r["v"]) for r in found.orderBy("rank").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ordered == list(enumerate(sorted(v for _, v in ordered), 1)) and len(ordered) == 20000


@pytest.mark.parametrize("limit", [None, 3])
def test_one_run_with_many_patterns(spark, limit):
    words = ["".join(chr(97 + int(d)) for d in str(k)) for k in range(600)]
    rows = [("r", k + 1, words[k * 7 % 600] if k < 600 else words[k % 5]) for k in range(900)]
    patterns = lines.dedupe_lines(spark.createDataFrame(rows, "run string, line_no bigint, line string"), ["run"])
    found = lines.top_patterns(patterns, ["run"], limit).orderBy("rank").collect()
    counts, first = defaultdict(int), {}
    for _, no, line in rows:
        counts[line] += 1
        first.setdefault(line, no)
    expected = sorted(counts, key=lambda x: (-counts[x], first[x]))
    assert [r["line"] for r in found] == (expected if limit is None else expected[:limit])


def test_symbols_of_one_large_diff(spark, monkeypatch):
    monkeypatch.setattr(ranks.ranked_within, "__defaults__", ("rank", 100))
    patch = "\n".join(f"@@ -{k},1 +{k},1 @@ def f{k % 400}():" for k in range(1000))
    found = repo.diff_symbols(spark.createDataFrame([("a", patch), (None, patch)], "repo string, patch string"))
    expected = sorted({f"def f{k}():" for k in range(400)})
    for name in ("a", None):
        assert [r["symbol"] for r in sorted(found.collect(), key=lambda r: r["rank"]) if r["repo"] == name] == expected
