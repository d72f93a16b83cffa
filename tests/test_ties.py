import math
import random

import duckdb
from pyspark.sql import functions as F

from gridlume.functions import numbers
from gridlume.operators import curves
from gridlume.queries import ORACLES, QUERIES
from oracle import DATA, assert_same, connect


def _smooth(errors):
    level = [math.log10(max(e, 1e-12)) for e in errors]
    half = 2 if len(errors) >= 5 else 1
    out = []
    for i in range(len(level)):
        total, near = 0.0, level[max(0, i - half) : i + half + 1]
        for v in near:
            total += v
        out.append(total / len(near))
    return out


def _curves():
    """Errors of a few values, so that means of the same ones in another order meet."""
    draw = random.Random(7)
    return {run: [draw.choice((0.17, 0.58, 0.68, 1.09, 1.23, 4.4)) for _ in range(400)] for run in range(30)}


def _points(spark, runs):
    rows = [(run, float(i), e, str(i)) for run, errors in runs.items() for i, e in enumerate(errors)]
    return spark.createDataFrame(rows, "run_id long, x double, metric double, key string").repartition(3)


def _lows(y):
    return [i for i in range(1, len(y) - 1) if y[i] < y[i - 1] and y[i] <= y[i + 1]]


def _prominence(y, at, reach):
    """The same as by the reference: shoulders are sought up to the first point that is no higher."""
    tops = []
    for side in (range(at - 1, max(0, at - reach) - 1, -1), range(at + 1, min(len(y), at + reach + 1))):
        top = -math.inf
        for j in side:
            if y[j] <= y[at]:
                break
            top = max(top, y[j])
        tops.append(top)
    return min(tops) - y[at] if math.isfinite(min(tops)) else 0.0


def test_minima_of_tied_means(spark):
    runs = _curves()
    found = {(r.run_id, r.i) for r in curves.local_minima(curves.smoothed(_points(spark, runs))).collect()}
    assert found == {(run, i) for run, errors in runs.items() for i in _lows(_smooth(errors))}


def test_prominences_of_tied_means(spark):
    runs = _curves()
    found = {(r.run_id, r.i): r.prominence for r in curves.prominences(curves.smoothed(_points(spark, runs))).collect()}
    assert found == {(run, i): _prominence(y, i, 10) for run, errors in runs.items() for y in [_smooth(errors)] for i in _lows(y)}


def test_rounding_goes_by_the_double(spark):
    values = [0.03695, 0.12345, 0.00005, -0.00005, 1.00005, -2.5, 0.0, 123456.7, None]
    found = [r.y for r in spark.createDataFrame([(v,) for v in values], "x double").select(numbers.round_scaled(F.col("x"), 4).alias("y")).collect()]
    expected = [r[0] for v in values for r in duckdb.execute("SELECT round(CAST(? AS DOUBLE), 4)", [v]).fetchall()]
    assert found == expected and found[0] == 0.0369


def _changed(spark, folder, table, change):
    """A connection to the small tables and a folder of them, in which one table is another."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("customer", "events"):
        con.execute(f"CREATE VIEW source_{name} AS SELECT * FROM '{DATA}/{name}.parquet'")
        con.execute(f"COPY ({change if name == table else f'SELECT * FROM source_{name}'}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def test_nearest_frame_of_targets_at_a_half(spark, tmp_path):
    con = _changed(spark, tmp_path, "customer", "SELECT * REPLACE (184.75 + 0.5 * (c_custkey // 150) AS c_acctbal) FROM source_customer")
    assert_same(QUERIES["nearest_frame"](spark, str(tmp_path)), con, ORACLES["nearest_frame"])


def test_step_of_nothing(spark):
    rows = spark.createDataFrame([(0.0,), (-0.0,), (0.03,), (2.2,), (None,)], "x double")
    assert [r.s for r in rows.select(F.round(numbers.nice_step(F.col("x")), 9).alias("s")).collect()] == [0.0, 0.0, 0.05, 2.5, None]


def test_scalar_math_of_zeros(spark, tmp_path):
    con = _changed(spark, tmp_path, "events", "SELECT * REPLACE (CASE WHEN event_id % 5 > 0 THEN value ELSE 0 END AS value) FROM source_events")
    assert_same(QUERIES["scalar_math"](spark, str(tmp_path)), con, ORACLES["scalar_math"])


def test_throughput_over_fractions_of_milliseconds(spark, tmp_path):
    """An event every 3 ms or so, also before 1970, where halves go away from zero."""
    con = _changed(spark, tmp_path, "events", "SELECT * REPLACE (make_timestamp(event_id * 3062 + event_id % 8 * 250 - 5000500) AS ts, event_id % 7 AS user_id) FROM source_events")
    assert con.execute("SELECT count(*) FROM events WHERE epoch_ms(ts) <> epoch_us(ts) // 1000").fetchall()[0][0] > 100
    assert_same(QUERIES["throughput"](spark, str(tmp_path)), con, ORACLES["throughput"])


def test_throughput_of_a_larger_table(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    assert_same(QUERIES["throughput"](spark, folder), connect(folder), ORACLES["throughput"])


def test_valleys_of_tied_means(spark):
    runs = _curves()
    found = {(r.run_id, r.key): r.prominence for r in curves.valleys(_points(spark, runs)).collect()}
    deep = {(run, str(i)): _prominence(y, i, 10) for run, errors in runs.items() for y in [_smooth(errors)] for i in _lows(y)}
    assert found == {k: p for k, p in deep.items() if p >= 0.1}


def test_clusters_of_tied_means(spark):
    runs = _curves()
    found = curves.clusters(curves.valleys(_points(spark, runs)), 0.2).groupBy("cluster").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("n")).collect()
    members = [i for errors in runs.values() for y in [_smooth(errors)] for i in _lows(y) if _prominence(y, i, 10) >= 0.1]
    assert {(r.x, r.n) for r in found} == {(float(i), members.count(i)) for i in members}
