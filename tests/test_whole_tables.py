import duckdb
import pytest
from pyspark.sql import functions as F

from gridlume.functions import geometry, kernels
from gridlume.operators import catalog, frames, scans
from gridlume.queries import ORACLES, QUERIES
from oracle import DATA, assert_same, connect


def test_ordered_subset_of_all_orders(spark):
    assert spark.read.parquet(f"{DATA}/orders.parquet").where("o_orderkey > 200").count() > 0
    found = QUERIES["ordered_subset"](spark, DATA)
    assert found.where("place > 200").count() > 0
    assert_same(found, connect(), ORACLES["ordered_subset"])


def test_ordered_subset_of_uneven_places(spark):
    places = [None, -5, *range(0, 40, 3), 10**6, 10**6 + 1, 10**15]
    rows = [(p, (k * 7) % 11) for k, p in enumerate(places)]
    found = frames.ordered_subset_problem(spark.createDataFrame(rows, "place long, frame_index long").repartition(3), spark.range(9).withColumnRenamed("id", "frame_index"))
    expected = {(p, "missing" if f > 8 else "not_ascending") for k, (p, f) in enumerate(rows) if f > 8 or k and f <= rows[k - 1][1]}
    assert {(r.place, r.problem) for r in found.collect()} == expected


def test_ordered_subset_of_nothing(spark):
    empty = spark.createDataFrame([], "place long, frame_index long")
    assert frames.ordered_subset_problem(empty, empty.select("frame_index")).count() == 0


@pytest.mark.parametrize("name", ["identity_match", "desynchronised"])
def test_all_streams_are_matched(spark, name):
    found = QUERIES[name](spark, DATA)
    assert found.select("stream").distinct().count() > 10
    assert_same(found, connect(), ORACLES[name])


def test_streams_do_not_meet(spark):
    ddl = "stream long, {} long, pts long, best_effort long, dts long, duration long"
    decoded = spark.createDataFrame([(1, 10, 5, None, 5, 1), (2, 20, 7, None, 7, 1), (3, 30, 5, None, 5, 1)], ddl.format("decoded_id"))
    index = spark.createDataFrame([(1, 0, 5, None, 5, 1), (2, 0, 5, None, 5, 1), (2, 1, 7, None, 7, 1)], ddl.format("frame_index"))
    found = frames.matched(decoded, index, ("stream",)).collect()
    assert {(r.stream, r.decoded_id, r.frame_index, r.score) for r in found} == {(1, 10, 0, 23), (2, 20, 1, 23)}
    shown = decoded.withColumnRenamed("decoded_id", "frame_index").withColumn("frame_index", F.lit(0).cast("long"))
    assert [tuple(r) for r in frames.presentation_mismatches(shown, index, ("stream",)).collect()] == [(2, 0)]


def test_every_kernel_row_has_its_number(spark):
    found = QUERIES["kernel_row_order"](spark, DATA)
    assert found.count() == spark.read.parquet(f"{DATA}/part.parquet").count() > 50
    assert_same(found, connect(), ORACLES["kernel_row_order"])


def test_numbers_of_kernel_rows_with_nulls(spark):
    rows = [(k, ("lanczos", "bicubic", None, "zz")[k % 4], (None, 0.5, 0.25)[k % 3], None, (None, 3)[k % 2], (None, "s", "t")[k // 4 % 3]) for k in range(60)]
    df = spark.createDataFrame(rows, "run_id long, kernel_id string, b double, c double, taps int, sample_label string").repartition(5)
    found = catalog.numbered_kernel_rows(df).orderBy("row_number").collect()
    assert [r.row_number for r in found] == list(range(1, 61))
    assert [r.run_id for r in found] == [r.run_id for r in catalog.sorted_kernel_rows(df).collect()]


def test_kernel_lists_are_whole(spark):
    image = [float(v % 7) / 7 for v in range(48 * 48)]
    images = spark.createDataFrame([(1, 48, 48, image), (2, 48, 48, image)], scans.FRAME_DDL)
    shape = geometry.plain_geometry(*geometry.active_lengths(F.col("width"), F.col("height"), F.lit("h_only"), F.lit("40")))
    listed = spark.createDataFrame([(0, ("bilinear", None, None, None)), (1, ("nearest", None, None, None)), (5000, ("lanczos", None, None, 3))], "ordinal int, kernel struct<id: string, b: double, c: double, taps: int>")
    found = {(r.frame_id, r.ordinal): r for r in scans.kernel_scan(images, listed, shape, "h_only").collect()}
    assert len(found) == 6 and all(found[f, 1].problem == "unknown_kernel" and found[f, 1].error is None for f in (1, 2))
    assert all(found[f, k].problem is None and found[f, k].error is not None for f in (1, 2) for k in (0, 5000))
    with pytest.raises(ValueError, match="4096"):
        scans.kernel_scan(images, spark.range(4097).select(F.col("id").cast("int").alias("ordinal"), F.struct(F.lit("bilinear").alias("id"), F.lit(None).cast("double").alias("b"), F.lit(None).cast("double").alias("c"), F.lit(None).cast("int").alias("taps")).alias("kernel")), shape, "h_only")


@pytest.mark.parametrize("name", ["height_scan", "height_scan_bilinear", "kernel_scan", "verification", "width_scan"])
def test_last_frame_of_few_lines(spark, tmp_path, name):
    """A crop of 5 on each side takes all of the last frame's 3 lines."""
    spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id < 96 + 3").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = QUERIES[name](spark, str(tmp_path))
    assert found.where("frame_id = 1 AND error IS NULL").count() > 0
    assert_same(found, con, ORACLES[name])


def test_crop_of_a_whole_frame_is_a_problem_of_that_frame(spark):
    large, small = ([float(v % 7) / 7 for v in range(48 * h)] for h in (48, 8))
    images = spark.createDataFrame([(1, 48, 48, large), (2, 48, 8, small)], scans.FRAME_DDL)
    shape = geometry.plain_geometry(*geometry.active_lengths(F.col("width"), F.col("height"), F.lit("w_only"), F.lit("40")))
    metric = {"crop": (5, 5, 4, 4), "threshold": 0.0, "norm": 1}
    kernel = kernels.kernel("bilinear")
    found = {r.frame_id: r for r in scans.verify(images, shape, kernel, "w_only", metric).collect()}
    assert found[1].problem is None and found[1].error is not None
    assert found[2].problem == "crop_leaves_no_pixel" and found[2].error is None
    with pytest.raises(Exception, match="frame 2: crop_leaves_no_pixel"):
        scans.verify(images, shape, kernel, "w_only", metric, strict=True).collect()
