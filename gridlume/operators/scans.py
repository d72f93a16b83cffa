"""Height scans, kernel scans and verification: frames against candidates.

Work items are small by contract and go to the frames, which stay where they are read; only where
frames are fewer than tasks are they dealt out in as many copies as there are idle tasks. Each
worker decodes or builds a plan once, and solves all frames of a shape that it holds in one call, in
which every column is computed by itself, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import kernels
from ..plans import axis, store
from . import frames as frame_ops
from . import metrics

FRAME_DDL = "frame_id BIGINT, width INT, height INT, pixels ARRAY<FLOAT>"
BATCH = 32  #: candidates of a batch
MOST_KERNELS = 4096
MOST_BROADCAST, MOST_PLAN_BYTES = 200_000, 1 << 27  #: work items, and bytes of their plans, that are broadcast instead of shuffled
STACK = 1 << 21  #: pixels that are solved in one call, about
DEFAULT_METRIC = {"crop": (10, 10, 10, 10), "threshold": 0.015, "norm": 1}


def _along_rows(lines: np.ndarray, n: int) -> np.ndarray:
    """(a, n * b) of n images' (a, b) to (b, n * a)."""
    return np.ascontiguousarray(lines.reshape(lines.shape[0], n, -1).transpose(2, 1, 0)).reshape(-1, n * lines.shape[0])


def _reconstructed(lines: np.ndarray, n: int, horizontal: axis.Plan | None, vertical: axis.Plan | None) -> np.ndarray:
    """The observed lines of n native images, (height, n * width), along the cheaper axis first."""
    order = ("horizontal", "vertical")
    if horizontal is not None and vertical is not None and axis.forward_order(horizontal, vertical) == "vertical":
        order = order[::-1]
    for name in order:
        if name == "vertical" and vertical is not None:
            lines = axis.forward(vertical, lines)
        if name == "horizontal" and horizontal is not None:
            lines = _along_rows(axis.forward(horizontal, _along_rows(lines, n)), n)
    return lines


def descale(image: np.ndarray, horizontal: axis.Plan | None, vertical: axis.Plan | None) -> np.ndarray:
    """The native image: inverse along the axes that have a plan, width first."""
    if horizontal is not None:
        image = np.ascontiguousarray(axis.inverse(horizontal, image.T).T)
    return axis.inverse(vertical, image) if vertical is not None else image


def reconstruct(native: np.ndarray, horizontal: axis.Plan | None, vertical: axis.Plan | None) -> np.ndarray:
    """The observed image of a native one."""
    return _reconstructed(native, 1, horizontal, vertical)


class Stack:
    """Images of one shape, side by side in both directions: all of them are one call for a candidate."""

    def __init__(self, images: list[np.ndarray], metric: dict) -> None:
        self.n, self.metric = len(images), metric
        self.height, self.width = images[0].shape
        self.left, self.right, self.top, self.bottom = metrics.bounds(self.width, self.height, metric["crop"])
        self.images = images
        self.made: dict[str, np.ndarray] = {}

    def _lines(self, which: str) -> np.ndarray:
        """The images' whole columns (height, n * width), whole rows (width, n * height), or of these what one axis alone needs."""
        if which not in self.made:
            cut = {"columns": np.s_[:, :], "rows": np.s_[:, :], "columns within": np.s_[:, self.left : self.right], "rows within": np.s_[self.top : self.bottom]}[which]
            parts = [i[cut] if which.startswith("columns") else i[cut].T for i in self.images]
            self.made[which] = np.ascontiguousarray(np.concatenate(parts, axis=1))
        return self.made[which]

    def errors(self, horizontal: axis.Plan | None, vertical: axis.Plan | None) -> list[float]:
        """The metric of each image's reconstruction. With one axis, lines outside the crop are never computed."""
        if horizontal is None or vertical is None:
            name, plan, low, high = ("columns within", vertical, self.top, self.bottom) if horizontal is None else ("rows within", horizontal, self.left, self.right)
            lines = self._lines(name)
            difference = (lines[low:high] - axis.forward(plan, axis.inverse(plan, lines), low, high)).reshape(high - low, self.n, -1)
        else:
            native = axis.inverse(vertical, _along_rows(axis.inverse(horizontal, self._lines("rows")), self.n))
            made = _reconstructed(native, self.n, horizontal, vertical)
            difference = (self._lines("columns") - made).reshape(self.height, self.n, self.width)[self.top : self.bottom, :, self.left : self.right]
        return [metrics.p_norm(np.ascontiguousarray(difference[:, k]), self.metric["threshold"], self.metric["norm"]) for k in range(self.n)]


def candidate_error(image: np.ndarray, horizontal: axis.Plan | None, vertical: axis.Plan | None, crop: tuple[int, int, int, int], threshold: float, norm: int) -> float:
    return Stack([image], {"crop": crop, "threshold": threshold, "norm": norm}).errors(horizontal, vertical)[0]


def _plan(work: dict, side: str, size: int) -> axis.Plan:
    if work.get(f"{side}_plan") is not None:
        data = bytes(work[f"{side}_plan"])
        return axis.CACHE.get(data, lambda: axis.Plan.from_bytes(data))
    geometry = work["geometry"]
    names = ("width", "src_width", "src_left") if side == "h" else ("height", "src_height", "src_top")
    k = work["kernel"]
    cubic, lanczos = k["id"] == "bicubic", k["id"] == "lanczos"
    given = lambda v, default: default if v is None else v
    request = axis.Request(size, int(geometry[names[0]]), geometry[names[1]], geometry[names[2]], k["id"], given(k["b"], 0.0) if cubic else 0.0, given(k["c"], 0.5) if cubic else 0.5, int(given(k["taps"], 3)) if lanczos else 3)
    return axis.build(request)


def _problem(work: dict, width: int, height: int, modes: str, crop: tuple[int, int, int, int]) -> str | None:
    geometry, k = work["geometry"], work["kernel"]
    if geometry is None:
        return "geometry_missing"
    for side, size, name, length in (("w", width, "width", "src_width"), ("h", height, "height", "src_height")):
        if side in modes and axis.Request(size, int(geometry[name]), geometry[length], 0.0, k["id"]).problem():
            return "destination_out_of_range"
    return "crop_leaves_no_pixel" if metrics.empty(width, height, crop) else None


_SIDES = {"h_only": "h", "w_only": "w", "h_plus_w": "hw"}


def _as_dict(work) -> dict:
    work = work.asDict(True) if hasattr(work, "asDict") else dict(work)
    return {k: (v.asDict() if hasattr(v, "asDict") else v) for k, v in work.items()}


def _run(axis_mode: str, metric: dict, strict: bool, shared=None, parts: int = 1):
    """Frames to their errors with the work items of their own ``works`` column or, of their shape and part, of ``shared``; a frame's rows are together and in order."""
    sides = _SIDES[axis_mode]

    def stacks(batch: pd.DataFrame) -> Iterator[tuple[list[int], list[np.ndarray], list[str | None]]]:
        """(rows, images, problems) of consecutive frames that have the same shape and, with a column of their own, are alone."""
        rows, images, problems, shape = [], [], [], None
        most = 1 if shared is None else max(1, STACK // max(1, int(batch["width"].iloc[0] or 1) * int(batch["height"].iloc[0] or 1)))
        for row, frame in enumerate(batch.itertuples(index=False)):
            image, wrong = None, "frame_missing"
            if frame.pixels is not None and len(frame.pixels) == frame.width * frame.height:
                image = np.asarray(frame.pixels, np.float32).reshape(int(frame.height), int(frame.width))
                wrong = None if np.isfinite(image).all() else "frame_not_finite"
            now = (frame.width, frame.height, getattr(frame, "part", 0))
            if rows and (now != shape or len(rows) >= most):
                yield rows, images, problems
                rows, images, problems = [], [], []
            rows.append(row)
            images.append(image)
            problems.append(wrong)
            shape = now
        if rows:
            yield rows, images, problems

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rows, images, problems in stacks(batch):
                first = batch.iloc[rows[0]]
                width, height = int(first["width"]), int(first["height"])
                works = [_as_dict(w) for w in first["works"]] if shared is None else shared.value.get((width, height), ())
                if parts > 1:
                    works = works[int(first["part"]) :: parts]
                good = [k for k, wrong in enumerate(problems) if wrong is None]
                stack = Stack([images[k] for k in good], metric) if good and not metrics.empty(width, height, metric["crop"]) else None
                found = []
                for work in works:
                    problem = _problem(work, width, height, sides, metric["crop"])
                    errors: list[float | None] = [None] * len(good)
                    if stack is not None and not problem:
                        errors = stack.errors(_plan(work, "h", width) if "w" in sides else None, _plan(work, "v", height) if "h" in sides else None)
                    found.append((work["ordinal"], problem, dict(zip(good, errors))))
                for k, row in enumerate(rows):
                    for ordinal, problem, errors in found:
                        problem = problems[k] or problem
                        if problem and strict:
                            raise ValueError(f"frame {batch['frame_id'].iloc[row]}: {problem}")
                        out.append((batch["frame_id"].iloc[row], ordinal, errors.get(k), problem))
            yield pd.DataFrame(out, columns=["frame_id", "ordinal", "error", "problem"])

    return run


def analyse(frames: DataFrame, works: DataFrame, axis_mode: str, metric: dict, strict: bool = False, batch: int = BATCH, spread: bool = True) -> DataFrame:
    """(frame_id, ordinal, error, problem) of every frame with every work item of its shape.

    ``works`` is (width, height, ordinal, geometry, kernel) and, from a store, h_plan and v_plan:
    small, one row per candidate and frame shape. A problem, such as a frame whose pixels aren't
    width times height, a canvas that isn't smaller than the frame or a crop that takes all of it,
    gives a null error; with ``strict`` it is an error of the job. ``spread`` lets frames that are fewer than the tasks be
    dealt out in copies; works or plans too many to broadcast meet the frames in batches.
    """
    spark = frames.sparkSession
    metrics.bounds(1 << 30, 1 << 30, metric["crop"])
    plans = [c for c in ("h_plan", "v_plan") if c in works.columns]
    schema = "frame_id BIGINT, ordinal INT, error DOUBLE, problem STRING"
    frames = frames.select("frame_id", "width", "height", "pixels")
    works = works.persist()  # asked for its size and then for its rows
    size = works.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in plans), F.lit(0).cast("long"))), F.lit(0)).alias("bytes")).first()
    if size.n > MOST_BROADCAST or size.bytes > MOST_PLAN_BYTES:
        item = F.struct("ordinal", "geometry", "kernel", *plans)
        batches = works.withColumn("batch", F.floor(F.col("ordinal") / batch)).groupBy("width", "height", "batch").agg(F.collect_list(item).alias("works"))
        pairs = frames.join(batches, ["width", "height"])
        if spread:
            pairs = pairs.repartition("frame_id", "batch")
        return pairs.drop("batch").mapInPandas(_run(axis_mode, metric, strict), schema)
    shapes: dict[tuple[int, int], list[dict]] = {}
    for r in works.collect():
        shapes.setdefault((r.width, r.height), []).append(_as_dict(r))
    for items in shapes.values():
        items.sort(key=lambda w: w["ordinal"])
    works.unpersist()
    shared = spark.sparkContext.broadcast(shapes)
    tasks = 2 * spark.sparkContext.defaultParallelism
    parts = 1
    if spread and size.n:
        parts = min(-(-tasks // max(1, frames.select("frame_id").limit(tasks).count())), max(map(len, shapes.values())))
    if parts > 1:
        frames = frames.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, "frame_id", "part")
    return frames.mapInPandas(_run(axis_mode, metric, strict, shared, parts), schema)


def with_plans(works: DataFrame, axis_mode: str, path: str) -> tuple[DataFrame, int]:
    """The work items with plans from the store at ``path``, and how many were built for it."""
    built = 0
    for side, size, horizontal in (("h_plan", "width", True), ("v_plan", "height", False)):
        if ("w" if horizontal else "h") in _SIDES[axis_mode]:
            asked = works.withColumns(store.axis_requests("geometry", "kernel", F.col(size), horizontal)).where("geometry IS NOT NULL")
            plans, count = store.ensure_plans(asked, path)
            built += count
            works = works.withColumns({f"_{k}": v for k, v in store.axis_requests("geometry", "kernel", F.col(size), horizontal).items()})
            plans = plans.select(*(F.col(k).alias(f"_{k}") for k in store.KEY), F.col("plan").alias(side))
            works = works.join(plans, [f"_{k}" for k in store.KEY], "left").drop(*(f"_{k}" for k in store.KEY))
    return works, built


def height_works(frames: DataFrame, grid: DataFrame, kernel: Column, axis_mode: str, base_height: int | None = None, base_width: int | None = None, profiled: bool = True) -> DataFrame:
    shapes = frames.select("width", "height").distinct()
    base = [F.lit(b).cast("long") for b in (base_height, base_width)]
    if profiled:
        geometry = g.candidate_geometry(F.col("width"), F.col("height"), F.lit(axis_mode), F.col("value"), *base)
    else:
        geometry = g.plain_geometry(*g.active_lengths(F.col("width"), F.col("height"), F.lit(axis_mode), F.col("value")))
    return shapes.crossJoin(F.broadcast(grid.select("ordinal", "value"))).select("width", "height", "ordinal", geometry.alias("geometry"), kernel.alias("kernel"))


def height_scan(frames: DataFrame, grid: DataFrame, kernel: Column, axis_mode: str = "h_plus_w", metric: dict | None = None, base_height: int | None = None, base_width: int | None = None, profiled: bool = True, plan_path: str | None = None) -> DataFrame:
    """(frame_id, ordinal, candidate_id, value, error, problem): one kernel, a grid of candidates, at most MOST_CANDIDATES."""
    works = height_works(frames, grid, kernel, axis_mode, base_height, base_width, profiled)
    if plan_path:
        works, _ = with_plans(works, axis_mode, plan_path)
    found = analyse(frames, works, axis_mode, metric or DEFAULT_METRIC)
    return found.join(F.broadcast(grid), "ordinal").select("frame_id", "ordinal", "candidate_id", "value", "error", "problem")


def kernel_scan(frames: DataFrame, kernel_list: DataFrame, geometry: Column, axis_mode: str = "h_plus_w", metric: dict | None = None) -> DataFrame:
    """(frame_id, ordinal, kernel, error, problem): one geometry, a list (ordinal, kernel) of at most MOST_KERNELS; repeats are allowed.

    A longer list is an error; a kernel that can't be used has its problem and no error of a frame.
    """
    if kernel_list.limit(MOST_KERNELS + 1).count() > MOST_KERNELS:
        raise ValueError(f"kernels exceed the {MOST_KERNELS}-entry cap")
    wrong = kernels.problem(F.col("kernel"))
    shapes = frames.select("width", "height").distinct()
    works = shapes.crossJoin(F.broadcast(kernel_list.where(wrong.isNull()))).select("width", "height", "ordinal", geometry.alias("geometry"), "kernel")
    found = analyse(frames, works, axis_mode, metric or DEFAULT_METRIC).join(F.broadcast(kernel_list), "ordinal").select("frame_id", "ordinal", "kernel", "error", "problem")
    refused = frames.select("frame_id").crossJoin(F.broadcast(kernel_list.withColumn("problem", wrong).where("problem IS NOT NULL")))
    return found.unionByName(refused.select("frame_id", "ordinal", "kernel", F.lit(None).cast("double").alias("error"), "problem"))


def verify(frames: DataFrame, geometry: Column, kernel: Column, axis_mode: str = "h_plus_w", metric: dict | None = None, strict: bool = False) -> DataFrame:
    """(frame_id, error, problem): one recipe over all frames. A bad frame has a null error, or with ``strict`` ends the job."""
    works = frames.select("width", "height").distinct().select("width", "height", F.lit(0).alias("ordinal"), geometry.alias("geometry"), kernel.alias("kernel"))
    return analyse(frames, works, axis_mode, metric or DEFAULT_METRIC, strict, spread=False).drop("ordinal")


def verify_media(media: DataFrame, scope: Column, geometry: Column, kernel: Column, axis_mode: str = "h_plus_w", metric: dict | None = None, stream: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(stream, frame_id, frame_index, error) of the frames of a media table that are in scope, and their coverage by stream.

    ``media`` holds a row a decoded frame: frame_id, decode_index, pts, best_effort, dts, width,
    height and pixels. Frames are numbered in presentation order before the scope picks them. Unlike
    a stream's, a media table's frame that can't be analysed is an error of the job, when it runs.
    """
    shown = frame_ops.presented(media.drop("pixels", "width", "height"), stream)
    picked = shown.where(F.coalesce(scope, F.lit(False))).select(*stream, "frame_id", "frame_index")
    wanted = media.select("frame_id", "width", "height", "pixels").join(picked.select("frame_id"), "frame_id", "left_semi")
    errors = verify(wanted, geometry, kernel, axis_mode, metric, strict=True).select("frame_id", "error")
    found = picked.join(errors, "frame_id").select(*stream, "frame_id", "frame_index", "error")
    return found, frame_ops.coverage(shown.join(errors, "frame_id", "left"), scope, stream=stream)


def capabilities(spark) -> DataFrame:
    """What this engine can do, as a relation of (kernel_id, parameters)."""
    rows = [(f, {"bicubic": "b,c", "lanczos": "taps"}.get(f, "")) for f in kernels.FAMILIES]
    return spark.createDataFrame(rows, "kernel_id STRING, parameters STRING")
