"""Mixing sources to target weights by entropy balancing.

Each document has a rate between 0 and a cap. Among all rates that give every source its target of
words, those that stay closest to half the cap in the (bounded) entropy are exponentially tilted:
the odds rate / (cap - rate) are exp(lambda * size / mean size of the source). The dual is convex
with one lambda a source; Newton steps over the histogram of (source, size), which has the whole
corpus in it, solve it. Rates become whole copies by systematic rounding along the sizes; what is
left of a source's target is made up by the cells that fit it best. DataFrame functions only.
Rates that are themselves exponentially tilted, without a bound, can't do: to reach a target of
twice its source's words every document would have to give two copies, while exp(lambda * size)
gives the largest more than that and the smallest less. With the bound in the entropy the same
tilt acts on the odds, and the dual stays convex.
All sums that decide something are sums of integers, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)  #: repeating, over the sources by code point, null last
SHARE = 1.5  #: words of the mix against those of all sources
CAP = 2  #: copies of a document, and words of a target against those of its source
SPREAD = 1024  #: parts of a histogram cell, so that no cell is one task's: of a cell with a third of all rows a part has a three thousandth
MAX_STEPS = 60
MENDINGS = 4  #: passes that fit what rounding left of the targets
SCALE = 1000  #: sums are of thousandths of words


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: str) -> Column:
    """Orders as the source by code point, null last, and is never null."""
    return F.coalesce(F.concat(F.lit("+"), F.col(source).cast("string")), F.lit("~"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(key, source_size, docs, target) of the sources of (key, size, n).

    Targets are proportional to the weights but stop at ``cap`` times the source's size, the excess
    going to the others by weight: a common level times the weight, or the cap. The level is found
    along the sources in the order in which they reach their caps; there is one row a source.
    """
    everything = Window.orderBy("key")
    sources = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    turn = (F.row_number().over(everything) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn.cast("int") + 1)
    sources = sources.withColumns({"weight": weight, "top": cap * F.col("source_size").cast("double")}).withColumn("filled_at", F.col("top") / F.col("weight"))
    order = Window.orderBy("filled_at", "key")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    level = (share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    sources = sources.withColumns({"level": level, "place": F.row_number().over(order)})
    common = F.min(F.when(F.col("level") < F.col("filled_at"), F.struct("place", "level"))).over(all_rows)["level"]
    return sources.withColumn("common", common).select("key", "source_size", "docs", F.least("top", F.coalesce(F.col("common") * F.col("weight"), F.col("top"))).alias("target"))


def _rate(cap: float) -> Column:
    """The tilted rate at ``lam``; the cap itself where the target is all that can be taken."""
    return F.when(F.col("target") >= cap * F.col("source_size"), F.lit(float(cap))).otherwise(cap / (1 + F.exp(-F.col("lam") * F.col("size") * F.col("docs") / F.col("source_size"))))


def solve(scratch: Scratch, cells: DataFrame, plan: DataFrame, cap: float = CAP) -> DataFrame:
    """(key, lam): Newton's steps on the dual of each source, kept within a shrinking bracket and at most doubling.

    ``cells`` is (key, size, n). A step is one pass over the cells with one pre-aggregated row a
    source; only the number of open sources comes to the driver.
    """
    state = scratch.save(plan.select("key", "source_size", "docs", "target", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("done")), "dual-0")
    for step in range(1, MAX_STEPS + 1):
        share = _rate(cap) / cap
        taken = F.col("n") * F.col("size") * cap * share
        slope = taken * (1 - share) * F.col("size") * F.col("docs") / F.col("source_size")
        whole = lambda x: F.sum(F.rint(x * SCALE).cast("decimal(38,0)")).cast("double") / SCALE
        sums = cells.where("size > 0").join(state.where(~F.col("done")), "key").groupBy("key").agg(whole(taken).alias("taken"), whole(slope).alias("slope"))
        over = F.col("taken") - F.col("target")
        done = F.col("taken").isNull() | (F.abs(over) <= 0.5) | (F.col("target") >= cap * F.col("source_size"))
        low = F.when(over < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(over > 0, F.col("lam")).otherwise(F.col("high"))
        most = 2 * F.greatest(F.lit(1.0), F.abs("lam"))
        newton = F.col("lam") + F.greatest(-most, F.least(most, F.coalesce(-over / F.nullif(F.col("slope"), F.lit(0.0)), F.when(over < 0, most).otherwise(-most))))
        kept = F.when((newton <= F.col("low2")) | (newton >= F.col("high2")), F.coalesce((F.col("low2") + F.col("high2")) / 2, newton)).otherwise(newton)
        state = scratch.save(
            state.join(sums, "key", "left")
            .withColumns({"low2": low, "high2": high, "stop": F.col("done") | done})
            .select("key", "source_size", "docs", "target", F.when(F.col("stop"), F.col("lam")).otherwise(kept).alias("lam"), F.col("low2").alias("low"), F.col("high2").alias("high"), F.col("stop").alias("done")),
            f"dual-{step}",
        )
        scratch.drop(f"dual-{step - 1}")
        if not state.where(~F.col("done")).limit(1).count():
            break
    return state


def round_cells(cells: DataFrame, state: DataFrame, cap: int = CAP) -> DataFrame:
    """(key, size, n, copies, source_size, target): whole copies of each cell, at most ``cap`` a document."""
    by_size, source = Window.partitionBy("key").orderBy("size"), Window.partitionBy("key")
    rows = cells.join(state.select("key", "source_size", "docs", "target", "lam"), "key").withColumn("want", F.when(F.col("size") > 0, F.col("n") * _rate(cap)).otherwise(F.col("n").cast("double")))
    rows = rows.withColumn("sum", F.sum("want").over(by_size))
    rows = rows.withColumn("copies", (F.floor(F.col("sum") + 0.5) - F.coalesce(F.lag(F.floor(F.col("sum") + 0.5)).over(by_size), F.lit(0))).cast("long"))
    rows = rows.withColumn("copies", F.greatest(F.lit(0), F.least(cap * F.col("n"), F.col("copies"))))
    for _ in range(MENDINGS):
        left = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(source)
        rows = rows.withColumn("left", left)
        more = F.greatest(-F.col("copies"), F.least(cap * F.col("n") - F.col("copies"), F.rint(F.col("left") / F.col("size")).cast("long")))
        rows = rows.withColumn("more", F.when(F.col("size") > 0, more).otherwise(0))
        best = F.min(F.struct(F.abs(F.col("left") - F.col("more") * F.col("size")), "size")).over(source)["size"]
        rows = rows.withColumn("best", best).withColumn("copies", F.col("copies") + F.when(F.col("size") == F.col("best"), F.col("more")).otherwise(0))
    return rows.select("key", "size", "n", "copies", "source_size", "target")


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """All columns and ``size`` (words), ``source_size``, ``target`` (its source's), ``copies``, ``taken`` (words).

    Columns of those names are replaced. A null or empty text has size 0 and changes nothing; a null
    source is a source of its own, the last; repeated rows and null ids are documents like others,
    and a tie between equal rows changes no result. A table without words has targets of 0.
    """
    if int(cap) != cap or cap < share:
        raise ValueError("cap is a whole number of copies, no less than share")
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    own = {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    keyed = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in own.items()), word_count(text_col).alias("size"), _source_key(source_col).alias("key"), F.xxhash64(id_col, text_col).alias("tie"), F.col(id_col).alias("id"))
    keyed = keyed.withColumn("part", F.pmod("tie", F.lit(SPREAD)))
    parts = scratch.save(keyed.groupBy("key", "size", "part").agg(F.count(F.lit(1)).alias("n")), "parts")
    cells = scratch.save(parts.groupBy("key", "size").agg(F.sum("n").alias("n")), "cells")
    plan = scratch.save(targets(cells, weights, share, cap), "plan")
    rounded = scratch.save(round_cells(cells, solve(scratch, cells, plan, cap), cap), "rounded")
    before = F.sum("n").over(Window.partitionBy("key", "size").orderBy("part")) - F.col("n")
    dealt = parts.withColumn("before", before).drop("n").join(rounded, ["key", "size"])
    dealt = scratch.save(dealt.select("key", "size", "part", "before", "n", "copies", "source_size", "target"), "dealt")
    turn = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("tie", "id")) - 1
    out = keyed.withColumn("turn", turn).join(dealt, ["key", "size", "part"])
    copies = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("before") + F.col("turn") < F.col("copies") % F.col("n"), 1).otherwise(0)
    out = out.withColumn("each", copies.cast("int"))
    new = {"size", "source_size", "target", "copies", "taken"}
    return out.select(
        *(F.col(o).alias(c) for c, o in own.items() if c not in new),
        "size",
        "source_size",
        "target",
        F.col("each").alias("copies"),
        (F.col("each") * F.col("size")).cast("long").alias("taken"),
    )
