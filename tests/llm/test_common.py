"""The shared folder."""

import os

from tessera.llm import _common


def test_intermediates_lie_in_the_shared_folder_and_go(spark):
    df = _common.written(spark.range(10), "numbers")
    assert df.count() == 10
    root = _common.shared_dir(spark)
    assert root == spark.conf.get("spark.checkpoint.dir")
    assert all(f.startswith(root) for f in df.inputFiles())
    # In a session of other tests their tables are still read: only look, don't drop.
    folder = df.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file:").replace("//", "/")
    assert spark.sparkContext.applicationId in folder and os.path.isdir(folder)


def test_written_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_common, "_app_dir", lambda spark: f"file://{tmp_path}/app")
    df = _common.written(spark.range(3), "numbers")
    assert df.count() == 3 and os.path.isdir(tmp_path / "app")
    _common.drop_written(spark)
    assert not os.path.exists(tmp_path / "app")


def test_batches_are_cut_inside_and_settings_stay(spark):
    from pyspark.sql import types as T

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "77000000")  # a session's own bound stays
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    df = spark.range(5000).selectExpr("id", "repeat('x', 3000) as t").coalesce(1)

    def sizes(batch):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    got = [r.n for r in _common.map_arrow(df, sizes, T.StructType([T.StructField("n", T.LongType())])).collect()]
    assert sum(got) == 5000 and max(got) <= 1000 and len(got) >= 5
    long = spark.range(40).selectExpr("repeat('x', 1000000) as t").coalesce(1)
    got = [r.n for r in _common.map_arrow(long, sizes, T.StructType([T.StructField("n", T.LongType())])).collect()]
    assert sum(got) == 40 and max(got) <= 5
    assert before == {k: spark.conf.get(k, None) for k in before}
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    _common.map_arrow(df, sizes, T.StructType([T.StructField("n", T.LongType())]))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(_common.BATCH_BYTES)


def test_rows_are_left_out_by_broadcast_or_join(spark, monkeypatch):
    df = spark.range(100).withColumnRenamed("id", "row")
    gone = _common.written(df.where("row % 3 = 0").select("row"), "gone")
    for bound in (1000, 0):
        monkeypatch.setattr(_common, "BROADCAST_ROWS", bound)
        left = _common.without(df, gone, "row")
        assert left.count() == 66 and left.where("row % 3 = 0").count() == 0


def test_names_of_our_own_give_way(spark):
    df = spark.createDataFrame([(1, 2)], "__ROW int, ___row int")
    assert _common.fresh(df, "__row") == "____row" and _common.fresh(df, "x") == "x"


def test_texts_of_nulls():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["é", None, ""])], names=["t"])
    assert _common.texts(batch, "t") == ["é".encode(), b"", b""]


def test_output_columns_replace_their_namesakes(spark):
    from pyspark.sql import types as T

    schema = _common.appended(spark.createDataFrame([], "a int, Score string"), T.StructField("score", T.DoubleType()))
    assert schema.simpleString() == "struct<a:int,score:double>"


def test_rows_have_places_of_their_own(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(f"{tmp_path}/a")
    scan = spark.read.parquet(f"{tmp_path}/a")
    a = _common.numbered(scan.where("id > 10"), "a")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        b = _common.numbered(scan.select("id"), "b")
        assert b.toDF("k", "__row").join(a, "__row").where("k = id").count() == 989
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert not a.inputFiles()[0].startswith(_common.shared_dir(spark) + "/tessera")
    for other in (spark.range(5), scan.union(scan), scan.join(scan.withColumnRenamed("id", "k")), scan.groupBy("id").count()):
        c = _common.numbered(other.limit(50), "c")
        assert c.select("__row").distinct().count() == c.count()
