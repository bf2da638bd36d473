"""The seed alone decides which documents of a length are taken."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import mixing


def test_choice_depends_on_the_seed_not_on_files(spark, tmp_path):
    rows = [(i % 900 if i % 7 else None, f"a b c d{i}", "s") for i in range(1000)]
    taken = []
    for n, seed in ((1, 7), (3, 7), (3, 8)):
        path = f"{tmp_path}/{n}-{seed}"
        spark.createDataFrame(rows[n:] + rows[:n], "doc_id long, text string, source string").repartition(n).write.parquet(path)
        mixed = mixing.mix(spark.read.parquet(path), share=0.4, seed=seed)
        taken.append(Counter(r.text for r in mixed.select("text").collect()))
    assert taken[0] == taken[1] and taken[0].total() == 400
    assert taken[2].total() == 400 and taken[2] != taken[0]


def test_few_long_documents_meet_the_budget():
    for lengths, counts, budget in (([75_000, 90_000], [2, 1], 150_000), ([40_000, 50_000, 66_000], [3, 2, 1], 130_000), ([300_000, 500_001], [40, 40], 20 * 300_000 + 7 * 500_001)):
        take = mixing.fit_budget(lengths, counts, budget)
        assert sum(n * t for n, t in zip(lengths, take)) == budget
    assert mixing.fit_budget([70_000, 100_000], [2, 1], 140_000).tolist() == [2, 0]
    rng = random.Random(2)
    for _ in range(40):
        lengths = sorted(rng.sample(range(66_000, 200_000), 7))
        counts = [rng.randint(1, 2) for _ in lengths]
        budget = rng.randint(60_000, 900_000)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        take = mixing.fit_budget(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        assert sum(n * t for n, t in zip(lengths, take)) == max(s for s in sums if s <= budget)


def test_plan_moves_no_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mixed = mixing.mix(docs)
    assert mixed.count() > 0
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_extra_columns_and_equal_rows(spark):
    rows = [(1, "a b", "s", i % 2) for i in range(40)] + [(None, "a b", None, 5)] * 30 + [(i, None, "t", 9) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").withColumn("last", F.lit(1)).withColumn("__row", F.lit("r")).withColumn("copies", F.lit(2))
    got = mixing.mixture(df)
    taken = {r[0]: r[1] for r in got.groupBy("source").agg(F.sum("taken")).collect()}
    target = {r.source: r.target for r in got.select("source", "target").distinct().collect()}
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == got.agg(F.sum("copies")).first()[0]
