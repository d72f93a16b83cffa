import struct
import time
import zlib
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlume.functions import geometry, grids, kernels
from gridlume.operators import catalog, curves, frames, fusion, metrics, requests, scans, session
from gridlume.plans import axis, store
from gridlume.sources import files, index, project
from gridlume.streaming import verify

METRIC = {"crop": (5, 5, 5, 5), "threshold": 0.0, "norm": 1}


def enlarged(native, kernel="bicubic", width=48, height=96):
    """An image of that native height, made larger."""
    random = np.random.default_rng(3)
    x = random.random((native, width)).astype(np.float32)
    return axis.forward(axis.build(axis.Request(height, native, float(native), 0.0, kernel)), x)


@pytest.fixture(scope="module")
def images(spark):
    rows = [(1, 48, 96, [float(v) for v in enlarged(60).ravel()]), (2, 48, 96, [float(v) for v in enlarged(72, "bilinear").ravel()]), (3, 48, 96, [1.0]), (4, 48, 96, None)]
    return spark.createDataFrame(rows, scans.FRAME_DDL)


def test_height_scan_finds_the_native_height(spark, images, tmp_path):
    grid = grids.candidate_range(spark, "50", "80", "1")
    found = scans.height_scan(images, grid, kernels.kernel("bicubic", 0.0, 0.5), "h_only", METRIC).toPandas()
    first = found[found.frame_id == 1]
    assert len(first) == 31 and first.loc[first.error.idxmin()].candidate_id == "60" and first.error.min() < 1e-5
    assert set(found[found.frame_id == 3].problem) == set(found[found.frame_id == 4].problem) == {"frame_missing"}
    stored = scans.height_scan(images, grid, kernels.kernel("bicubic", 0.0, 0.5), "h_only", METRIC, plan_path=str(tmp_path / "plans")).toPandas()
    merged = found.merge(stored, on=["frame_id", "ordinal"])
    assert np.allclose(merged.error_x.dropna(), merged.error_y.dropna())
    works = scans.height_works(images, grid, kernels.kernel("bicubic", 0.0, 0.5), "h_only")
    assert scans.with_plans(works, "h_only", str(tmp_path / "plans"))[1] == 0


def test_order_and_partitions_do_not_matter(spark, images):
    grid = grids.candidate_range(spark, "58", "62", "1")
    run = lambda f, b: sorted(scans.analyse(f, scans.height_works(f, grid, kernels.kernel("spline36"), "h_only"), "h_only", METRIC, batch=b).where("error IS NOT NULL").collect())
    assert run(images, 32) == run(images.repartition(3).orderBy(F.desc("frame_id")), 2)


def test_kernel_scan_and_verify(spark, images):
    shape = geometry.independent_geometry(F.lit(48.0), F.lit(72.0), F.lit(None).cast("long"), F.lit(None).cast("long"))
    listed = spark.createDataFrame([(0, "bicubic", 0.0, 0.5), (1, "bilinear", None, None), (2, "bilinear", None, None)], "ordinal INT, id STRING, b DOUBLE, c DOUBLE").select("ordinal", F.struct("id", "b", "c", F.lit(None).cast("int").alias("taps")).alias("kernel"))
    found = scans.kernel_scan(images.where("frame_id = 2"), listed, shape, "h_only", METRIC).orderBy("ordinal").collect()
    assert found[1].error < 1e-5 < found[0].error and found[1].error == found[2].error
    assert {r.frame_id: r.problem for r in scans.verify(images, shape, kernels.kernel("bilinear"), "h_only", METRIC).collect()} == {1: None, 2: None, 3: "frame_missing", 4: "frame_missing"}
    with pytest.raises(Exception, match="frame_missing"):
        scans.verify(images, shape, kernels.kernel("bilinear"), "h_only", METRIC, strict=True).collect()


def test_two_axes(spark):
    native = np.random.default_rng(1).random((40, 30)).astype(np.float32)
    h, v = axis.build(axis.Request(50, 30, 30.0, 0.0, "bicubic")), axis.build(axis.Request(64, 40, 40.0, 0.0, "bicubic"))
    image = scans.reconstruct(native, h, v)
    assert np.abs(scans.descale(image, h, v) - native).max() < 1e-4
    assert scans.candidate_error(image, h, v, (5, 5, 5, 5), 0.0, 2) < 1e-5


def test_plan_table_holds_each_request_once(spark):
    rows = spark.createDataFrame([(96, 60, 60.0, 0.0, "bicubic", 0.0, 0.5, 3)] * 3 + [(96, 96, 96.0, 0.0, "bicubic", 0.0, 0.5, 3)], store.KEY_DDL)
    plans = store.build_plans(rows)
    assert plans.count() == 2 and {r.problem for r in plans.collect()} == {None, "destination_out_of_range"}
    assert store.attach_plans(rows, plans).count() == 4
    assert store.grid_hash(rows).first() == store.grid_hash(rows.orderBy(F.desc("destination_size"))).first()


def dip(n=501, at=870.0, depth=0.5, run="a"):
    x = 500 + np.arange(n)
    noise = np.random.default_rng(5).normal(0, 0.003, n)
    y = -2 - 0.004 * (x - 500) + noise - depth * np.exp(-((x - at) ** 2) / 8)
    return [(run, float(a), float(10**b), str(a)) for a, b in zip(x, y)]


def test_valley_literals(spark):
    points = spark.createDataFrame(dip(), "run_id string, x double, metric double, key string")
    found = curves.valleys(points).collect()
    assert [r.x for r in found] == [870.0] and found[0].prominence > 0.3
    trend = spark.createDataFrame(dip(depth=0.0), points.schema)
    assert curves.valleys(trend).count() == 0
    straight = spark.createDataFrame([("a", float(x), float(10 ** (-2 - 0.004 * x)), str(x)) for x in range(500, 1001)], points.schema)
    assert curves.fallback_minimum(straight).first().x == 1000
    two = spark.createDataFrame([("a", 870.0, 0.1, "a", 0.5), ("b", 870.4, 0.2, "b", 0.6)], "run_id string, x double, metric double, key string, prominence double")
    assert curves.consensus(two, 1.0).count() == 1 and curves.consensus(two, 0.2).count() == 2
    assert curves.consensus(two, 1.0).first().height == 870.0
    assert curves.valleys(points.limit(2)).count() == 0 and curves.valleys(points.limit(0)).count() == 0


def test_partial_timestamps_keep_their_slots(spark):
    rows = spark.createDataFrame([(0, 5), (1, None), (2, 1), (3, 3)], "decode_index long, pts long").withColumns({"best_effort": F.lit(None).cast("long"), "dts": F.lit(None).cast("long")})
    assert {r.decode_index: r.frame_index for r in frames.presented(rows).collect()} == {0: 3, 1: 1, 2: 0, 3: 2}


def test_scope_falls_back_to_the_key_flag(spark):
    rows = spark.createDataFrame([(0, "I", False), (1, "P", True), (2, None, True), (3, None, None)], "frame_index long, picture_type string, key_frame boolean")
    assert [r.frame_index for r in frames.select_frames(rows, "decoded_i_picture").orderBy("frame_index").collect()] == [0, 2]
    with pytest.raises(ValueError):
        frames.select_frames(rows, "all", 1, 10)


def test_fusion_literals(spark):
    rows = spark.createDataFrame([("ra", 3, 0.4), ("ra", 1, 0.3), ("rb", 3, 0.2), ("rb", 2, 0.5), ("rb", 9, None)], "run_id string, frame_index long, error double")
    runs = spark.createDataFrame([("ra", "a"), ("rb", "b")], "run_id string, recipe_id string")
    recipes = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "recipe_id string, created_at string")
    fused = fusion.fused(fusion.candidates(rows, runs, recipes)).orderBy("frame_index").collect()
    assert [r.frame_index for r in fused] == [1, 2, 3] and (fused[2].fused_error, fused[2].candidate_count) == (0.2, 2)
    assert sum(r.candidate_count == 1 for r in fused) == 2
    tie = fusion.fused(fusion.candidates(rows.withColumn("error", F.lit(0.1)), runs, recipes)).where("frame_index = 3").first()
    assert tie.tied and tie.winner_recipe_id == "a"


def test_throughput_halves(spark):
    rows = spark.createDataFrame([("j", 0, 0), ("j", 1000, 10), ("j", 2000, 40), ("j", 3000, 5)], "job_id string, at_ms long, completed long")
    assert tuple(catalog.throughput(rows).first()) == ("j", None, 40, 20.0, pytest.approx(40 / 3))


def test_throughput_starts_again_with_a_phase(spark):
    """Decoding isn't measured; a new phase counts from 0, from the time of the event before it, and keeps the current rate."""
    rows = [("j", 0, 0, "candidates"), ("j", 1000, 10, "candidates"), ("j", 1500, 99, "decode"), ("j", 2000, 3, "verify"), ("j", 4000, 7, "verify"), ("k", 5, 9, "decode")]
    found = {r.job_id: tuple(r)[1:] for r in catalog.throughput(spark.createDataFrame(rows, "job_id string, at_ms long, completed long, phase string")).collect()}
    assert found == {"j": ("verify", 7, 10.0 * 0.5 + 2.0 * 0.5, pytest.approx(7 / 2.5)), "k": ("decode", 0, None, None)}


def test_equal_matches_are_ambiguous(spark):
    ddl = "{} long, pts long, best_effort long, dts long, duration long"
    decoded = spark.createDataFrame([(1, 5, None, None, 1), (2, 6, None, 6, 1)], ddl.format("decoded_id"))
    index = spark.createDataFrame([(0, 5, None, None, 1), (1, 5, None, None, 1), (2, 6, None, None, 1), (3, 6, None, 6, 1)], ddl.format("frame_index"))
    assert {tuple(r) for r in frames.matched(decoded, index).collect()} == {(1, None, 17, "ambiguous_timestamps"), (2, 3, 23, None)}


def test_kernel_runs_are_guarded(spark):
    samples = spark.createDataFrame([("a", True, None), ("b", True, "f"), ("b", True, "g"), ("c", True, None), ("d", True, "f"), ("e", True, "f"), ("z", True, None), ("b", False, "g")], "source_id string, included boolean, sample_fingerprint string")
    rows = [("a", "indexing", None, 10, 10, 1), ("b", "ready", "f", 10, 10, 1), ("c", "ready", "f", 0, 10, 1), ("d", "ready", None, 10, 10, 9), ("e", "ready", None, 10, 10, 1)]
    sources = spark.createDataFrame(rows, "source_id string, state string, fingerprint string, width int, height int, geometry_key int")
    planned = catalog.plan_kernel_runs(samples, sources, spark.createDataFrame([(1, "g")], "geometry_key int, geometry string"))
    found = sorted((r.source_id, r.problem or "") for r in planned.collect())
    assert found == [("a", "sample_source_unavailable"), ("b", ""), ("b", "sample_fingerprint_stale"), ("c", "source_dims_missing"), ("d", "geometry_unresolved"), ("e", ""), ("z", "sample_source_unavailable")]


def test_ready_ids(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "source_id string")
    pick = lambda a, b: sorted(r[0] for r in catalog.ready_ids(a, b).collect())
    assert pick(ids("a", "b"), ids("b", "c")) == ["b"]
    assert pick(ids("a"), ids("c")) == ["c"]
    assert pick(ids("a"), ids("c", "d")) == []


def test_files(spark, tmp_path):
    image = np.linspace(0, 1, 12).reshape(3, 4)
    (tmp_path / "a.png").write_bytes(files.png_bytes(image))
    (tmp_path / "b.f32").write_bytes(files.f32_bytes(image))
    (tmp_path / "c.f32").write_bytes(b"123")
    found = files.binary_files(spark, str(tmp_path))
    luma = files.still_luma(found.where("path LIKE '%png'")).first()
    assert (luma.width, luma.height) == (4, 3) and np.allclose(luma.pixels, np.rint(image.ravel() * 255) / 255, atol=1e-6)
    raw = {r.path[-5:]: r for r in files.read_f32(found.where("path LIKE '%f32'"), 4, 3).collect()}
    assert raw["b.f32"].problem is None and raw["c.f32"].problem == "byte_length"
    probe = files.probe(found.where("path LIKE '%png'")).first()
    assert (probe.kind, probe.width, probe.height) == ("still", 4, 3)
    large = spark.createDataFrame([(bytes(200_000),)], "content binary").select(files.fingerprint(F.col("content"))).first()[0]
    import hashlib

    assert large == "quick-sha256-v1:" + hashlib.sha256((200_000).to_bytes(8, "little") + bytes(1 << 17)).hexdigest()


def test_index_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(k, 0, k * 100, k if k else None, k, 0, int(k == 0), 1, k, 1, 0) for k in range(5)], "decode_index long, stream long, file_position long, pts long, dts long, extradata long, key long, picture long, poc long, repeat long, field long")
    index.write_text_index(rows, str(tmp_path / "text"))
    back = index.read_text_index(spark, str(tmp_path / "text" / "*.txt")).orderBy("line").collect()
    assert [(r.file_position, r.pts) for r in back] == [(0, None), (100, 1), (200, 2), (300, 3), (400, 4)]
    guards = {"path": "v.mkv", "size": 9, "modified": 1, "fingerprint": "f"}
    first = index.ensure_index(spark, str(tmp_path / "table"), lambda: rows, **guards)
    again = index.ensure_index(spark, str(tmp_path / "table"), lambda: rows, **guards)
    assert (first[1], again[1], again[0].count()) == (True, False, 5)
    assert index.valid_rows(spark.read.parquet(str(tmp_path / "table")), rows.columns, "v.mkv", 10, 1).count() == 0


def test_manifests(spark, tmp_path):
    (tmp_path / "old.json").write_text('{"id": "p", "name": "n", "sources": [{"id": "s", "path": "/a", "kind": "video"}]}')
    (tmp_path / "new.json").write_text('{"schema_version": 9, "id": "q"}')
    rows = {r.id: r for r in project.read_manifests(spark, str(tmp_path)).collect()}
    assert rows["p"].migrated and rows["p"].runs == [] and rows["q"].read_only
    manifests = project.read_manifests(spark, str(tmp_path))
    assert project.collection(manifests, "sources").first().path == "/a"
    with pytest.raises(ValueError):
        project.write_manifest(manifests, str(tmp_path / "out"))


def test_streams(spark, tmp_path):
    ddl = "stream_id STRING, seq BIGINT, slot INT, generation BIGINT"
    spark.createDataFrame([("a", 0, 0, 1), ("a", 1, 0, 2), ("a", 3, 0, 2), ("b", 0, 1, 5)], ddl).coalesce(1).write.parquet(str(tmp_path / "in"))

    def drained(stream, name):
        query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    source = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
    assert {(r.stream_id, r.seq): r.problem for r in drained(verify.contiguous(source), "checked")} == {("a", 0): None, ("a", 1): None, ("a", 3): "gap", ("b", 0): None}
    assert sum(r.accepted for r in drained(verify.slot_reuse(source), "slots")) == 3
    problems = verify.sequence_problems(spark.read.schema(ddl).parquet(str(tmp_path / "in")))
    assert [tuple(r) for r in problems.collect()] == [("a", "gap")]


def test_verify_stream_is_ordered_and_restartable(spark, tmp_path):
    pixels = [float(v) for v in enlarged(72).ravel()]
    spark.createDataFrame([("a", 1, 1, 48, 96, pixels), ("a", 0, 0, 48, 96, pixels), ("a", 2, 2, 48, 96, [0.0])], verify.FRAME_STREAM_DDL).write.parquet(str(tmp_path / "in"))
    shape = geometry.independent_geometry(F.lit(48.0), F.lit(72.0), F.lit(None).cast("long"), F.lit(None).cast("long"))
    for _ in range(2):  # the second run finds nothing new
        found = verify.verify_stream(verify.read_frames(spark, str(tmp_path / "in")), shape, kernels.kernel("bicubic", 0.0, 0.5), 48, 96, "h_only", METRIC)
        verify.write_in_order(found, str(tmp_path / "out"), str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 1, 2] and rows[0].error < 1e-5 and rows[2].error is None


def test_events_reduce_alike(spark, tmp_path):
    rows = spark.createDataFrame([("j", 0, "started", 0, 10), ("j", 1, "progress", 4, 10), ("j", 2, "cancelled", 4, 10), ("j", 3, "result", 10, 10), ("k", 0, "progress", 1, 2)], verify.EVENT_DDL)
    assert sorted(tuple(r) for r in verify.reduced(rows).collect()) == [("j", "cancelled", 4, 10), ("k", "running", 1, 2)]
    rows.coalesce(1).write.parquet(str(tmp_path / "events"))
    query = verify.reduce_events(spark.readStream.schema(verify.EVENT_DDL).parquet(str(tmp_path / "events"))).writeStream.format("memory").queryName("jobs").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("jobs").collect()) == [("j", "cancelled", 4, 10), ("k", "running", 1, 2)]


def _png(width, height, depth, kind, lines, *chunks):
    body = b"\x89PNG\r\n\x1a\n"
    for name, data in ((b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0)), *chunks, (b"IDAT", zlib.compress(lines)), (b"IEND", b"")):
        body += struct.pack(">I", len(data)) + name + data + bytes(4)
    return body


def _gif(width, height, colours, indexes):
    """Nine-bit codes, cleared before each 250, so that their width never changes."""
    codes = [c for k in range(0, len(indexes), 250) for c in [256, *indexes[k : k + 250]]] + [257]
    bits = sum(c << 9 * k for k, c in enumerate(codes)).to_bytes(-(-9 * len(codes) // 8), "little")
    blocks = b"".join(bytes([len(bits[k : k + 255])]) + bits[k : k + 255] for k in range(0, len(bits), 255))
    image = b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + b"\x08" + blocks + b"\0"
    return b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | len(colours).bit_length() - 2, 0, 0) + b"".join(bytes(c) for c in colours), image


def test_stills_of_other_formats(spark):
    colours = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)]
    luma = [0.2126, 0.7152, 0.0722, 1.0]
    indexes = [(3 * y + x) % 4 for y in range(20) for x in range(30)]
    head, image = _gif(30, 20, colours, indexes)
    rows = [indexes[30 * y : 30 * y + 30] for y in range(20)]
    packed = b"".join(b"\0" + bytes(sum(v << 6 - 2 * k for k, v in enumerate((r + [0, 0])[x : x + 4])) for x in range(0, 30, 4)) for r in rows)
    bmp = b"".join(b"".join(bytes(colours[v][::-1]) for v in r) + bytes(2) for r in rows[::-1])
    deep = b"".join(b"\0" + b"".join(struct.pack(">H", v * 21845) for v in r) for r in rows)
    contents = {
        "gif": head + b"\x21\xf9\x04" + bytes(5) + image + b";",
        "palette": _png(30, 20, 2, 3, packed, (b"PLTE", b"".join(bytes(c) for c in colours))),
        "bmp": b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(bmp), 0, 54, 40, 30, 20, 1, 24, 0, 0, 0, 0, 0, 0) + bmp,
        "deep": _png(30, 20, 16, 0, deep),
        "broken": _png(30, 20, 2, 3, packed[:9], (b"PLTE", bytes(12))),
        "cut": (head + image)[:60],
        "other": b"\xff\xd8\xff\xe0",
        "none": None,
    }
    df = spark.createDataFrame(list(contents.items()), "path string, content binary")
    found = {r.path: r for r in files.still_luma(df).collect()}
    for name in ("gif", "palette", "bmp"):
        assert (found[name].width, found[name].height) == (30, 20) and found[name].pixels == pytest.approx([luma[v] for v in indexes], abs=1e-6)
    assert found["deep"].pixels == pytest.approx([v / 3 for v in indexes], abs=1e-6)
    assert {found[n].problem for n in ("broken", "cut", "other", "none")} == {"unsupported_image"}
    assert files.has_animation(head + image + image, "gif") and not files.has_animation(head + image, "gif")
    assert not files.has_animation(head + b"\x21\xfe\x04" + image[:4] + b"\0" + image, "gif")


def test_plans_used_last_are_kept(spark, tmp_path):
    cache = axis.PlanCache(10_000)
    plans = [axis.build(axis.Request(64, n, float(n), 0.0, "bilinear")) for n in range(30, 60)]
    for k, plan in enumerate(plans):
        cache.get(k, lambda plan=plan: plan)
        cache.get(0, lambda: plans[0])
    assert 0 in cache.plans and 1 not in cache.plans and cache.bytes == sum(p.nbytes() for p in cache.plans.values()) <= 10_000
    path = f"file://{tmp_path}/store"
    ask = lambda low, high: spark.range(low, high).select(*(c.cast(t).alias(n) for n, (c, t) in {"source_size": (F.lit(64), "int"), "destination_size": (F.col("id"), "int"), "active_length": (F.col("id"), "double"), "shift": (F.lit(0), "double"), "kernel_id": (F.lit("bilinear"), "string"), "b": (F.lit(0), "double"), "c": (F.lit(0), "double"), "taps": (F.lit(3), "int")}.items())).coalesce(1)
    assert store.ensure_plans(ask(30, 34), path)[1] == 4 and store.ensure_plans(ask(34, 38), path)[1] == 4
    time.sleep(1.1)
    assert store.ensure_plans(ask(30, 34), path, 1 << 30)[1] == 0
    sizes = sorted(p.stat().st_size for p in (tmp_path / "store").rglob("*.parquet"))
    assert store.evict(spark, path, max(sizes) * len(sizes)) == 0
    assert store.evict(spark, path, sum(sizes) - 1) >= 1
    assert store.ensure_plans(ask(30, 34), path)[1] < 4 and store.evict(spark, f"{path}-none") == 0


def test_sessions(spark):
    uses = spark.createDataFrame([("s", k, key) for k, key in enumerate(["a", "b", None, "a", "c", "d", "b", None])], "session_id string, seq int, frame_key string")
    found = [r.hit for r in session.cache_hits(uses, 3).orderBy("seq").collect()]
    assert found == [False, False, False, True, False, False, False, False]
    requests = spark.createDataFrame([(1, 5, "x"), (2, 4, "x"), (3, 9, None), (4, 9, None)], "request_id int, at int, path string")
    assert {(r.request_id, r.job_id, r.starts) for r in session.shared_jobs(requests, ("path",)).collect()} == {(1, 2, False), (2, 2, True), (3, 3, True), (4, 3, False)}
    events = spark.createDataFrame([(1, None), (2, 7), (3, 7), (4, 8)], "seq int, request_id int")
    assert [r.target for r in session.routed(events, spark.createDataFrame([(7,), (7,)], "request_id int")).orderBy("seq").collect()] == ["event", "answer", "event", "event"]
    assert session.cache_hits(uses.limit(0)).count() == session.routed(events.limit(0), requests).count() == 0


def test_ordered_norm_is_the_same_however_rows_are_dealt(spark):
    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(k % 2, k, float(v)) for k, v in enumerate(r.normal(size=3000))], "key int, place int, d double")
    one, two = (sorted(map(tuple, metrics.p_norm_in_order(df, "key", "place", "d", 0.1, 3, 64).collect())) for df in (rows.coalesce(1), rows.repartition(9)))
    assert one == two
    values = np.array([x.d for x in rows.where("key = 0").collect()])
    assert one[0][1] == pytest.approx((np.where(np.abs(values) > 0.1, np.abs(values) ** 3, 0).sum() / len(values)) ** (1 / 3))


def test_media_verification_fails_as_a_whole(spark):
    pixels = [float(v % 7) / 7 for v in range(48 * 48)]
    rows = [(k, k, (5, 3, 4, None)[k], None, k, 48, 48, pixels if k != 2 else pixels[:5]) for k in range(4)]
    media = spark.createDataFrame(rows, "frame_id long, decode_index long, pts long, best_effort long, dts long, width int, height int, pixels array<float>")
    shape = geometry.plain_geometry(*geometry.active_lengths(F.lit(48), F.lit(48), F.lit("h_only"), F.lit(40.0)))
    run = lambda scope: scans.verify_media(media, scope, shape, kernels.kernel("bilinear"), "h_only")
    bad = run(F.lit(True))[0]
    with pytest.raises(Exception, match="frame_missing"):
        bad.collect()
    index = {r.frame_id: r.frame_index for r in frames.presented(media.drop("pixels")).collect()}
    found, covered = run(F.col("frame_index") != index[2])
    assert {r.frame_id: r.frame_index for r in found.collect()} == {k: v for k, v in index.items() if k != 2}
    assert covered.first().asDict() == {"eligible": 4, "selected": 3, "processed": 3, "failed": 0}


def test_commands_and_manifests_as_json(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"request_id": "r1", "type": "height"}\n{"request_id": "r2"}\n')
    commands = verify.read_commands(spark, str(tmp_path / "in"), "request_id STRING, type STRING")
    query = commands.writeStream.format("memory").queryName("commands").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("commands").collect()), key=str) == [("r1", "height"), ("r2", None)]
    (tmp_path / "p.json").write_text('{"schema_version": 1, "id": "p", "sources": [{"id": "s", "path": "/x", "kind": "video"}]}')
    (tmp_path / "q.json").write_text('{"schema_version": 9, "id": "q"}')
    opened = project.read_manifests(spark, str(tmp_path / "*.json"))
    assert {(r.id, r.read_only, r.migrated) for r in opened.collect()} == {("p", False, True), ("q", True, False)}
    written = project.manifest_json(opened).collect()
    again = spark.createDataFrame(written).select("id", F.from_json("json", project.MANIFEST_DDL).alias("m")).first()
    assert len(written) == 1 and again.m.schema_version == project.SCHEMA_VERSION and again.m.sources[0].path == "/x" and again.m.runs == []


def test_cheaper_axis_goes_first():
    small, large = axis.build(axis.Request(64, 20, 20.0, 0.0, "bilinear")), axis.build(axis.Request(64, 60, 60.0, 0.0, "bicubic"))
    taps = lambda p: p.forward_columns.shape
    for h, v in ((small, large), (large, small), (small, small)):
        (w, tw), (t, th), nw, nh = taps(h), taps(v), len(h.pivots), len(v.pivots)
        horizontal, vertical = nh * w * tw + w * t * th, nw * t * th + w * t * tw
        assert axis.forward_order(h, v) == ("horizontal" if horizontal <= vertical else "vertical")
    assert axis.grid_period(axis.Request(1080, 720, 720.0, 0.0, "bilinear")) == 3 and axis.grid_period(axis.Request(1080, 720, 720.5, 0.0, "bilinear")) is None


def test_cancelling_counts_between_queueing_and_the_end(spark):
    rows = [("a", 1, "queue", 5), ("a", 2, "cancel", None), ("a", 3, "completed", None), ("b", 1, "queue", -5), ("b", 2, "completed", None), ("b", 3, "cancel", None)]
    rows += [("c", 1, "cancel", None), ("c", 2, "queue", 7), ("d", 1, "cancel", None), ("e", 1, "queue", 1), ("e", 2, "completed", None), ("e", 3, "queue", None), ("e", 4, "cancel", None)]
    found = requests.job_requests(spark.createDataFrame(rows, "job_id string, seq int, event string, total int"))
    assert sorted(map(tuple, found.collect())) == [("a", 5, True, True), ("b", 0, True, False), ("c", 7, False, False), ("e", 0, False, True)]
    with pytest.raises(ValueError, match="direction"):
        requests.by_metric("up")
