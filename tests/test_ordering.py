import pytest
from pyspark.sql import functions as F

from cinderlog.functions.ordering import column_order, first_n, hash_order, mark_first_n, number_rows
from cinderlog.operators import prep


def table(spark, partitions):
    """A third of the rows share one group; some rows have none."""
    group = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(
        (F.col("id") % 5).cast("string")
    )
    return spark.range(2000).withColumn("g", group).repartition(partitions, F.rand(partitions))


def expected(n):
    seen, out = {}, {}
    for i in range(2000):
        g = "hot" if i % 3 == 0 else None if i % 7 == 0 else str(i % 5)
        seen[g] = seen.get(g, 0) + 1
        out[i] = seen[g]
    return out


@pytest.mark.parametrize("partitions", [1, 8])
@pytest.mark.parametrize("chunk", [1, 37, 5000])
def test_number_rows(spark, partitions, chunk):
    numbered = number_rows(table(spark, partitions), column_order("id", chunk), ("g",))
    assert {r["id"]: r["row_no"] for r in numbered.collect()} == expected(2000)


@pytest.mark.parametrize("partitions", [1, 8])
def test_first_n_is_exact_in_every_group(spark, partitions):
    kept = first_n(table(spark, partitions), column_order("id", 50), 40, ("g",))
    wanted = {i for i, n in expected(2000).items() if n <= 40}
    assert {r["id"] for r in kept.collect()} == wanted
    marked = mark_first_n(table(spark, partitions), column_order("id", 50), 40, "m", ("g",))
    assert {r["id"] for r in marked.where("m").collect()} == wanted
    assert marked.count() == 2000


def test_ungrouped_first_n(spark):
    kept = first_n(table(spark, 8), column_order("id", 64), 777)
    assert {r["id"] for r in kept.collect()} == set(range(777))


def test_samples_do_not_depend_on_partitions(spark):
    samples = [
        {r["id"] for r in prep.sample_rows(table(spark, p), "id", n=123).collect()} for p in (1, 8)
    ]
    assert samples[0] == samples[1] and len(samples[0]) == 123


def test_split_is_exact_and_stratified(spark):
    rows = table(spark, 8).withColumn("label", F.coalesce("g", F.lit("none")))
    split = prep.split_rows(rows, "id")
    counts = {r["label"]: (r["t"], r["n"]) for r in split.groupBy("label").agg(
        F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect()}
    assert sum(t for t, _ in counts.values()) == 400
    assert all(abs(t - 0.2 * n) < 1 for t, n in counts.values())


def test_split_with_a_single_row_label_is_not_stratified(spark):
    rows = spark.range(11).withColumn("label", F.when(F.col("id") == 0, "a").otherwise("b"))
    split = prep.split_rows(rows, "id")
    assert split.count() == 11
    assert split.where("is_test").count() == 3


def test_seeded_shuffle(spark):
    one = [r["id"] for r in prep.shuffle_rows(table(spark, 1), "id").collect()]
    assert one == [r["id"] for r in prep.shuffle_rows(table(spark, 8), "id").collect()]
    assert one != sorted(one)
    placed = number_rows(table(spark, 8), hash_order(prep.SEED, "id"), name="place")
    assert one == [r["id"] for r in placed.orderBy("place").collect()]


def test_tables_of_chunks_are_never_broadcast(spark):
    """They grow with the rows, so no broadcast may collect them on the driver."""
    rows, order = table(spark, 4), column_order("id", 3)
    for numbered in (number_rows(rows, order, ("g",)), first_n(rows, order, 40, ("g",)), mark_first_n(rows, order, 40, "m", ("g",))):
        assert "Broadcast" not in numbered._jdf.queryExecution().executedPlan().toString()
        numbered.collect()
        assert "Broadcast" not in numbered._jdf.queryExecution().executedPlan().toString()
