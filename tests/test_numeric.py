import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlume.functions import geometry as g
from gridlume.functions import grids, kernels, labels, numbers
from gridlume.operators import metrics
from gridlume.plans import axis


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rounding(spark):
    row = one(spark, *(numbers.half_even(F.lit(x)) for x in (2.5, 3.5, -2.5, -3.5)), numbers.toward_zero(F.lit(-1.9)), numbers.grid_round(F.lit(0.49999999999999994)))
    assert tuple(row) == (2, 4, -2, -4, -1, 0)


@pytest.mark.parametrize("semantics, inclusive, n", [("repeated_addition", True, 18), ("index_multiplication", True, 19), ("decimal_fixed_point", True, 19), ("decimal_fixed_point", False, 18)])
def test_grid_sizes(spark, semantics, inclusive, n):
    rows = grids.candidate_range(spark, "0.01", "0.19", "0.01", inclusive, semantics).orderBy("ordinal").collect()
    assert len(rows) == n and rows[9].candidate_id == "0.1"


def test_grid_errors(spark):
    for arguments in (("5", "1", "1"), ("0", "1", "0"), ("0", "1000", "0.001")):
        with pytest.raises(ValueError):
            grids.candidate_range(spark, *arguments)
    assert grids.candidate_count(spark, "1", "0.25", 4).count() == 4
    assert grids.preset_grid(spark, "fractional_refine", "810", "1").count() == 21


def test_geometry_literals(spark):
    none = F.lit(None).cast("long")
    long = lambda x: F.lit(x).cast("long")
    double = lambda x: F.lit(float(x))
    a = one(spark, g.standard_geometry(double(1488), double(837), double(1488), double(837), long(838)).alias("g")).g
    assert (a.height, a.src_top) == (838, 0.5)
    b = one(spark, g.independent_geometry(double(1488), double(837), long(1001), none).alias("g")).g
    assert (b.height, b.src_top) == (837, 0.0)
    c = one(spark, g.independent_geometry(double(1488), double(837), none, long(1489)).alias("g")).g
    assert (c.width, c.src_left) == (1489, 0.5)
    d = one(spark, g.standard_geometry(double(1920), double(1080), double(100.5), double(101.5), none).alias("g")).g
    assert (d.width, d.height, d.src_width) == (100, 102, 100.0)
    for candidate, base, height, top in ((837.25, 838, 838, 0.375), (843.8, 1081, 845, None)):
        e = one(spark, g.candidate_geometry(double(1920), double(1080), F.lit("h_only"), double(candidate), long(base), none).alias("g")).g
        assert e.height == height and top in (None, e.src_top)
    f = one(spark, g.candidate_geometry(double(1920), double(1080), F.lit("h_plus_w"), double(810), none, none).alias("g")).g
    assert (f.width, f.height) == (1440, 810)
    h = one(spark, g.candidate_geometry(double(1920), double(1080), F.lit("h_plus_w"), double(810.5), long(1001), long(2001)).alias("g")).g
    assert (h.width, h.height, h.src_top) == (1441, 811, 0.25)
    assert one(spark, g.candidate_geometry(double(1920), double(1080), F.lit("h_only"), double(-1), none, none).alias("g")).g is None


def test_geometry_problems_and_migration(spark):
    old = spark.sql("SELECT named_struct('canvas_width', 100D, 'canvas_height', 50D, 'src_width', 120D, 'src_height', 50D, 'active_width', 1D, 'active_height', 1D, 'src_left', CAST(NULL AS DOUBLE), 'src_top', CAST(NULL AS DOUBLE)) AS old")
    new = old.select(g.migrated_geometry("old").alias("n")).first().n
    assert new.needs_review and new.src_left == -10
    df = spark.range(1).select(g._struct(F.lit(10), F.lit(10), F.lit(0.0), F.lit(0.0), F.lit(11.0), F.lit(5.0)).alias("g"))
    assert df.select(g.geometry_problem("g")).first()[0] == "outside_canvas"


@pytest.mark.parametrize("k, x, expected", [("bilinear", 0.25, 0.75), ("bicubic", 0.0, 1.0), ("lanczos", 1.0, 0.0), ("spline16", 0.0, 1.0), ("spline36", 1.0, 0.0), ("spline64", 4.0, 0.0)])
def test_kernels_agree_with_numpy(spark, k, x, expected):
    assert axis.weigh(k, np.array([x]), 0.0, 0.5, 3)[0] == pytest.approx(expected, abs=1e-12)
    xs = np.linspace(-5, 5, 101)
    column = kernels.weight(kernels.kernel(k, 0.2, 0.4, 3), F.col("x"))
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in xs], "x double").select(column).collect()]
    assert np.allclose(got, axis.weigh(k, xs, 0.2, 0.4, 3), atol=1e-12)


def test_kernel_rules(spark):
    k = kernels.kernel
    row = one(spark, kernels.problem(k("lanczos", taps=16)), kernels.problem(k("bicubic", 0.0)), kernels.problem(k("x")), kernels.problem(k("spline36")), kernels.signature(k("bicubic", 0.5, 0.25, 9)), kernels.label(k("lanczos", taps=4)), kernels.echo(k("lanczos")))
    assert tuple(row) == ("lanczos_taps_out_of_range", "bicubic_needs_b_and_c", "unknown_kernel", None, "bicubic|0.5|0.25", "lanczos(taps=4)", '{"id":"lanczos","taps":3}')


def dense(r):
    columns, weights = axis.matrix(r, False)
    out = np.zeros((r.source_size, r.destination_size))
    np.add.at(out, (np.repeat(np.arange(r.source_size), columns.shape[1]), columns.ravel()), weights.ravel())
    return out


def test_inverse_is_dense_least_squares():
    for request in (axis.Request(17, 11, 11.4, 0.2, "spline36"), axis.Request(96, 64, 64.0, 0.0, "lanczos", taps=4), axis.Request(20, 2, 2.0, 0.0, "bicubic")):
        plan, matrix = axis.build(request), dense(request)
        signal = (0.3 * np.sin(0.7 * np.arange(request.source_size)) + 0.02 * np.arange(request.source_size)).astype(np.float32)[:, None]
        x = axis.inverse(plan, signal)
        assert np.abs(x - np.linalg.lstsq(matrix, signal, rcond=None)[0]).max() < 2e-5
        assert np.abs(axis.forward(plan, x) - matrix @ x).max() < 1e-5
        assert plan.valid() and axis.Plan.from_bytes(plan.to_bytes()).valid()


def test_round_trip():
    plan = axis.build(axis.Request(23, 15, 15.0, 0.0, "bicubic"))
    native = np.cos(0.31 * np.arange(15)).astype(np.float32)[:, None]
    assert np.abs(axis.inverse(plan, axis.forward(plan, native)) - native).max() < 3e-5


@settings(max_examples=25, deadline=None)
@given(st.integers(6, 40), st.integers(2, 39), st.sampled_from(["bilinear", "bicubic", "spline16"]), st.floats(-0.5, 0.5))
def test_factors_rebuild_the_normal_matrix(size, native, kernel, shift):
    request = axis.Request(size, native, float(native), shift, kernel)
    if request.problem():
        return
    columns, weights = axis.matrix(request, False)
    half = min(2 * axis.reach(kernel) - 1, native - 1)
    lower, pivots = axis.factor(axis.normal_bands(columns, weights, native, half))
    full = np.eye(native)
    for k in range(half):
        full += np.diag(lower[k + 1 :, k], -k - 1)
    a = dense(request)
    assert np.abs(full @ np.diag(pivots) @ full.T - a.T @ a).max() < 1e-9


def test_metric_literals():
    difference = np.zeros((5, 5), np.float32)
    difference[1, 1], difference[2, 2], difference[3, 3] = 0.5, 1.0, 2.0
    assert metrics.p_norm(difference[1:4, 1:4], 1.0, 1) == pytest.approx(2 / 9)
    pair = np.array([[3, 4], [0, 0]], np.float32)
    assert metrics.p_norm(pair, 0.0, 2) == 2.5
    half = np.array([[0.5, 0.25], [0, 0]], np.float32)
    for p in (256, 2**32 - 1):
        assert metrics.p_norm(half, 0.0, p) == pytest.approx(0.5 * ((1 + 0.5**p) / 4) ** (1 / p), rel=1e-15)
    with pytest.raises(ValueError):
        metrics.bounds(10, 10, (5, 5, 0, 0))


def test_labels(spark):
    row = one(
        spark,
        labels.file_name(F.lit(r"C:\a\b.png")),
        labels.csv_cell(F.lit('a"b')),
        labels.snake_case_keys(F.lit('{"aB":"cD","eF":{"gH":1}}')),
        labels.source_label(F.lit("/x/y.mkv"), F.lit("quick-sha256-v1:abcdef99")),
        numbers.digits17(F.lit(0.1)),
        numbers.decimal_text(F.lit("12.500").cast("decimal(10,3)")),
        labels.recipe_name(F.lit(1280), F.lit(720), F.lit("bilinear")),
    )
    assert tuple(row) == ("b.png", '"a""b"', '{"a_b":"cD","e_f":{"g_h":1}}', "y.mkv (#abcdef)", "0.10000000000000001", "12.5", "1280x720-bilinear")
