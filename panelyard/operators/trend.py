"""Trend facts of yearly series, for all entities at once.

Two semantics stand side by side: ``indicator_facts`` (three points at least, relative thresholds, median
smoothing and a two-part fit) and ``trend_evidence`` (two points at least, a dead band of a thousandth).  Each is
one chain of windows over the series and one aggregation on the same keys: one shuffle in all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class TrendSettings:
    """Thresholds of the fact semantics."""

    minimum_years: int = 3
    epsilon: float = 1e-12
    long_term: float = 0.10
    stable_range: float = 0.10
    recent: float = 0.03
    dead_band: float = 0.001
    #: Relative numbers are rounded to so many places, so that one on a threshold is classed alike in whatever order sums were taken.
    digits: int = 12


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def unpivot_panel(wide: DataFrame, keys: Sequence[str], indicators: Sequence[str]) -> DataFrame:
    """Wide rows to (keys, indicator, value); indicators of an entity without any value are left to the facts' count."""
    return wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in indicators]).unpivot(list(keys), list(indicators), "indicator", "value")


def median_of_three(series: DataFrame, keys: Sequence[str], time: str = "year", value: str = "value", out: str = "smooth") -> DataFrame:
    """Each point's median with its neighbours; ends stay."""
    w = Window.partitionBy(*keys).orderBy(time)
    v, a, b = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    return series.withColumn(out, F.when(a.isNull() | b.isNull(), v).otherwise(F.greatest(F.least(a, v), F.least(F.greatest(a, v), b))))


def _fit(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column, syy: Column) -> tuple[Column, Column, Column]:
    """(slope, mean, squared error) of a line from running sums."""
    n = F.greatest(n, F.lit(1.0))  # rows without a value have none
    cxx, cxy, cyy = sxx - sx * sx / n, sxy - sx * sy / n, syy - sy * sy / n
    slope = F.try_divide(cxy, F.nullif(cxx, F.lit(0.0)))
    return slope, sy / n, cyy - slope * cxy


def indicator_facts(series: DataFrame, keys: Sequence[str], time: str = "year", value: str = "value", settings: TrendSettings | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """One row a series (*keys*): counts, extremes with their earliest years, long-term and recent class, turning years.

    Values that are null or not finite don't count; null ones are listed as missing.  A two-part fit is tried at every
    inner point from running sums, so a long series costs no more a point than a short one.  *by*: some of the keys to
    deal the rows out by, so that what is grouped by these later needs no shuffle.
    """
    c = settings or TrendSettings()
    rows = series.select(*keys, F.col(time).alias("t"), F.when(finite(F.col(value)), F.col(value)).alias("v"), F.col(value).isNull().alias("gone")).repartition(*(by or keys))
    rows = rows.withColumn("ok", F.col("v").isNotNull())
    w = Window.partitionBy(*keys, "ok")
    o = w.orderBy("t")
    run = o.rowsBetween(Window.unboundedPreceding, 0)
    before = o.rowsBetween(Window.unboundedPreceding, -1)
    x = rows.withColumns(
        {
            "n": F.count("v").over(w), "mean": F.avg("v").over(w), "slope": F.regr_slope("v", F.col("t").cast("double")).over(w), "hi": F.max("v").over(w), "lo": F.min("v").over(w),
            "t0": F.min("t").over(w), "i": F.row_number().over(o), "pv": F.lag("v").over(o), "nv": F.lead("v").over(o), "pt": F.lag("t").over(o),
        }
    )
    tolerance = F.greatest(F.abs("mean"), F.lit(c.epsilon)) * c.dead_band
    delta = F.col("v") - F.col("pv")
    smooth = F.when(F.col("pv").isNull() | F.col("nv").isNull(), F.col("v")).otherwise(F.greatest(F.least("pv", "v"), F.least(F.greatest("pv", "v"), F.col("nv"))))
    x = x.withColumns({"sign": F.when(delta > tolerance, 1).when(delta < -tolerance, -1).when(delta.isNotNull(), 0), "y": smooth - F.col("mean"), "x": (F.col("t") - F.col("t0")).cast("double")})
    sums = {"sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "sxy": F.col("x") * F.col("y"), "syy": F.col("y") * F.col("y")}
    x = x.withColumns({k: F.sum(v).over(run) for k, v in sums.items()} | {f"t{k}": F.sum(v).over(w) for k, v in sums.items()} | {"psign": F.lag("sign").over(o), "last_sign": F.last(F.nullif("sign", F.lit(0)), ignorenulls=True).over(before)})
    i, n = F.col("i").cast("double"), F.col("n").cast("double")
    right = [F.col(f"t{k}") - F.col(k) + v for k, v in sums.items()]  # both parts share the point between them
    (ls, lm, le), (rs, rm, re) = _fit(i, *[F.col(k) for k in sums]), _fit(n - i + 1, *right)
    change = lambda s, m, k: F.round(s * k / F.greatest(F.abs(m + F.col("mean")), F.lit(c.epsilon)), c.digits)
    lc, rc = change(ls, lm, i - 1), change(rs, rm, n - i)
    split = (F.col("i") >= 2) & (F.col("i") <= F.col("n") - 2) & (F.abs(lc) >= c.long_term) & (F.abs(rc) >= c.long_term) & (lc * rc < 0)
    x = x.withColumns({"shape": F.when(split, F.when(lc > 0, "rise_then_fall").otherwise("fall_then_rise")), "error": F.when(split, le + re)})
    ok = F.col("ok")
    facts = x.groupBy(*keys).agg(
        F.count("v").alias("valid_years"),
        F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("t")))).alias("missing_years"),
        F.max_by("v", F.when(ok, F.col("t"))).alias("current_value"),
        F.max(F.when(ok, F.col("t"))).alias("current_year"),
        F.min_by("t", F.when(ok, F.struct("v", "t"))).alias("min_year"),
        F.min("v").alias("min_value"),
        F.max_by("t", F.when(ok, F.struct(F.col("v"), -F.col("t")))).alias("max_year"),
        F.max("v").alias("max_value"),
        F.max(F.when(ok, F.col("mean"))).alias("mean"),
        F.max(F.when(ok, F.col("slope"))).alias("slope"),
        F.max_by("pv", F.when(ok, F.col("t"))).alias("previous"),
        F.count_if((F.col("sign") != 0) & (F.col("sign") != F.col("last_sign"))).alias("reversals"),
        F.array_sort(F.collect_list(F.when((F.col("sign") * F.col("psign")) == -1, F.col("pt")))).alias("turning_years"),
        F.min_by("shape", F.when(F.col("shape").isNotNull(), F.struct("error", "i"))).alias("shape"),
    )
    enough = F.col("valid_years") >= c.minimum_years
    scale = F.greatest(F.abs("mean"), F.lit(c.epsilon))
    facts = facts.withColumns(
        {
            "valid": enough,
            "relative_slope": F.when(enough, F.round(F.col("slope") * (F.col("valid_years") - 1) / scale, c.digits)),
            "relative_range": F.when(enough, F.round((F.col("max_value") - F.col("min_value")) / scale, c.digits)),
            "recent_change": F.when(enough, F.round((F.col("current_value") - F.col("previous")) / F.greatest(F.abs("previous"), F.lit(c.epsilon)), c.digits)),
        }
    )
    s, wild = F.col("relative_slope"), F.col("reversals") >= 2
    long_term = (
        F.when(~enough, "unknown").when((F.abs(s) < c.long_term) & (F.col("relative_range") < c.stable_range), "stable").when(F.col("shape").isNotNull(), F.col("shape"))
        .when(s >= c.long_term, F.when(wild, "fluctuating_upward").otherwise("overall_up")).when(s <= -c.long_term, F.when(wild, "fluctuating_downward").otherwise("overall_down")).otherwise("stable")
    )
    recent = F.when(~enough, "unknown").when(F.col("recent_change") >= c.recent, "up").when(F.col("recent_change") <= -c.recent, "down").otherwise("stable")
    turning = F.when(enough, F.col("turning_years")).otherwise(F.array().cast("array<int>"))
    return facts.select(
        *keys, "valid", "valid_years", "missing_years", "current_year", "current_value", "min_year", "min_value", "max_year", "max_value",
        long_term.alias("long_term"), recent.alias("recent"), turning.alias("turning_years"), "relative_slope", "relative_range", "recent_change", "reversals",
    )


def with_lineage(facts: DataFrame, series: DataFrame, keys: Sequence[str], time: str = "year", value: str = "value", row: str = "source_row", file: str = "source_file") -> DataFrame:
    """*facts* with ``time_series``: each one's points (null ones, too) in order, with the file and row that they came from."""
    points = F.array_sort(F.collect_list(F.struct(F.col(time).alias("year"), F.col(value).alias("value"), F.col(row).alias("source_row"), F.col(file).alias("source_file"))))
    return facts.join(series.groupBy(*keys).agg(points.alias("time_series")), list(keys), "left")


def with_values(facts: DataFrame) -> DataFrame:
    """Facts of series that have any value; the others say nothing of their entity."""
    return facts.where("valid_years > 0")


def trend_evidence(series: DataFrame, keys: Sequence[str], time: str = "year", value: str = "value", dead_band: float = 0.001) -> DataFrame:
    """One row a series of two or more values: ends, slope, direction, pattern, recent direction, turning years
    (the year after the pivot), extremes with their earliest years.  NaN counts as no value."""
    rows = series.select(*keys, F.col(time).alias("t"), F.col(value).alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    w = Window.partitionBy(*keys)
    o = w.orderBy("t")
    x = rows.withColumns({"band": F.greatest(F.max(F.abs("v")).over(w), F.lit(1e-12)) * dead_band, "pv": F.lag("v").over(o)})
    delta = F.col("v") - F.col("pv")
    x = x.withColumn("sign", F.when(delta.isNull(), None).when(F.abs(delta) <= F.col("band"), 0).otherwise(F.signum(delta).cast("int")))
    before = o.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({"psign": F.lag("sign").over(o), "last_sign": F.last(F.nullif("sign", F.lit(0)), ignorenulls=True).over(before)})
    e = x.groupBy(*keys).agg(
        F.count("v").alias("observations"),
        F.min("t").alias("start_year"), F.max("t").alias("end_year"), F.min_by("v", "t").alias("start_value"), F.max_by("v", "t").alias("end_value"),
        F.regr_slope("v", F.col("t").cast("double")).alias("slope_per_year"), F.max("band").alias("band"),
        F.min("v").alias("minimum_value"), F.min_by("t", F.struct("v", "t")).alias("minimum_year"),
        F.max("v").alias("maximum_value"), F.max_by("t", F.struct(F.col("v"), -F.col("t"))).alias("maximum_year"),
        F.max_by("sign", "t").alias("recent_sign"), F.count_if(F.col("sign") > 0).alias("ups"), F.count_if(F.col("sign") < 0).alias("downs"),
        F.count_if((F.col("sign") != 0) & (F.col("sign") != F.col("last_sign"))).alias("reversals"),
        F.min_by("sign", F.when(F.col("sign") != 0, F.col("t"))).alias("first_sign"),
        F.array_sort(F.collect_list(F.when(F.col("sign") * F.col("psign") == -1, F.col("t")))).alias("turning_years"),
    ).where("observations >= 2")
    flat = F.col("maximum_value") - F.col("minimum_value") <= F.col("band")
    direction = F.when(flat | (F.abs(F.col("slope_per_year") * (F.col("end_year") - F.col("start_year"))) <= F.col("band")), "stable").when(F.col("slope_per_year") > 0, "increase").otherwise("decrease")
    e = e.withColumn("direction", direction)
    pattern = (
        F.when(flat, "stable").when((F.col("ups") > 0) & (F.col("downs") == 0), "overall_increase").when((F.col("downs") > 0) & (F.col("ups") == 0), "overall_decrease")
        .when((F.col("reversals") == 1) & (F.col("first_sign") < 0), "decrease_then_increase").when((F.col("reversals") == 1) & (F.col("first_sign") > 0), "increase_then_decrease")
        .when(F.col("direction") == "increase", "fluctuating_increase").when(F.col("direction") == "decrease", "fluctuating_decrease").otherwise("stable")
    )
    recent = F.when(F.col("recent_sign") > 0, "increase").when(F.col("recent_sign") < 0, "decrease").otherwise("stable")
    return e.select(
        *keys, "observations", "start_year", "end_year", "start_value", "end_value", (F.col("end_value") - F.col("start_value")).alias("delta"), "slope_per_year", "direction",
        pattern.alias("pattern"), recent.alias("recent_direction"), "turning_years", "minimum_value", "minimum_year", "maximum_value", "maximum_year",
    )


def year_over_year(series: DataFrame, keys: Sequence[str], time: str = "year", value: str = "value") -> DataFrame:
    """Adds ``delta`` and ``relative_change`` to the point before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(time))
    return series.withColumns({"delta": F.col(value) - before, "relative_change": (F.col(value) - before) / F.greatest(F.abs(before), F.lit(1e-12))})


def index_to_first(series: DataFrame, keys: Sequence[str], time: str = "year", value: str = "value") -> DataFrame:
    """Adds ``indexed``: the first value is 100; series without a first value or with zero there are left out."""
    points = series.where(F.col(value).isNotNull())
    first = F.first(value).over(Window.partitionBy(*keys).orderBy(time))
    return points.withColumn("base", first).where("base <> 0").withColumn("indexed", F.col(value) * 100 / F.col("base")).drop("base")


def min_max_scale(series: DataFrame, keys: Sequence[str], value: str = "value", out: str = "scaled") -> DataFrame:
    """Adds each value's place between its series' extremes, 0 to 100; a flat series is 0, null stays null."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return series.withColumn(out, F.when(F.col(value).isNotNull(), F.when(hi == lo, F.lit(0.0)).otherwise((F.col(value) - lo) / (hi - lo) * 100)))


def carbon_stock(npp: Column, tau: Column, fraction: float = 0.45) -> tuple[Column, Column]:
    """Carbon and its CO2 equivalent."""
    carbon = npp * tau * fraction
    return carbon, carbon * 44.0 / 12.0


def coincident(series: DataFrame, entity: Sequence[str], name: str = "indicator", time: str = "year", value: str = "value", within: float = 1e-9) -> DataFrame:
    """Pairs of an entity's series (first, second by name) of equal length whose values agree in every year."""
    a = series.select(*entity, F.col(name).alias("first"), time, F.col(value).alias("va"), F.count("*").over(Window.partitionBy(*entity, name)).alias("na"))
    b = a.select(*entity, F.col("first").alias("second"), time, F.col("va").alias("vb"), F.col("na").alias("nb"))
    pairs = a.join(b, [*entity, time]).where("first < second and na = nb")
    return pairs.groupBy(*entity, "first", "second", "na").agg(F.max(F.abs(F.col("va") - F.col("vb"))).alias("gap"), F.count("*").alias("n")).where((F.col("gap") < within) & (F.col("n") == F.col("na"))).select(*entity, "first", "second")
