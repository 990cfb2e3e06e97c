"""Many short monthly series at once.

A series is one row holding its values in month order, at most one per calendar
month, so fitting is a fold over an array and series scale out as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.calendar import month_range
from ledgerloom.params import Params

BASELINES = ["naive_last_value", "drift", "seasonal_naive"]


def fill_months(df: DataFrame, series: str, values: list[str], last_month: Column) -> DataFrame:
    """Gap-free months per series up to `last_month`; a missing month reads 0 or NULL."""
    by_month = Window.partitionBy(series).orderBy("month")
    until = F.coalesce(F.lead("month").over(by_month), F.add_months(last_month, 1))
    stretched = (df.select(series, F.col("month").alias("_seen"), *values, until.alias("_until"))
                 .withColumn("month", F.explode(month_range(F.col("_seen"), F.add_months("_until", -1)))))
    live = F.col("month") == F.col("_seen")
    return stretched.select(series, "month", *[F.when(live, F.col(v)).alias(v) for v in values])


def holdout_split(panel: DataFrame, series: str, months: int) -> DataFrame:
    """Marks the last `months` months of each series; `step` counts into the holdout."""
    back = Window.partitionBy(series).orderBy(F.col("month").desc())
    rn = F.row_number().over(back)
    n = F.count("*").over(Window.partitionBy(series))
    return panel.select(
        "*", (rn <= months).alias("is_test"),
        (F.lit(months) - rn + 1).cast("bigint").alias("_step"), n.alias("n_months"),
    ).withColumn("step", F.when(F.col("is_test"), F.col("_step"))).drop("_step")


def low_rate_dummy(rate: Column, threshold: float) -> Column:
    """1 where the success rate sat below the healthy band; a missing rate is healthy."""
    return F.when(F.coalesce(rate, F.lit(1.0)) < threshold, 1).otherwise(0)


def as_arrays(panel: DataFrame, series: str, holdout: int, horizon: int = 0,
              partitions: int | None = None, origins: int = 1) -> DataFrame:
    """One row per series: history `ys` and dummies `xs` up to `origin`.

    The rows are few bytes but each is fitted on many grid points, so they are
    spread over `partitions` tasks rather than merged by their size.

    With a holdout the last values move to `actuals` and their dummies to
    `x_future`; without one the future is assumed free of interventions. With more `origins` there is a row for each of
    that many months before the holdout, its actuals being the months next to it.
    """
    rows = F.sort_array(F.collect_list(F.struct("month", "y", "x")))
    spread = panel.repartition(partitions, series) if partitions else panel
    full = spread.groupBy(series).agg(rows.alias("_rows"), F.max("month").alias("_last")).select(
        series, "_last",
        F.transform("_rows", lambda r: r["y"].cast("double")).alias("_y"),
        F.transform("_rows", lambda r: r["x"].cast("double")).alias("_x"))
    if not holdout:
        return full.select(series, F.col("_last").alias("origin"), F.lit(None).cast("array<double>").alias("actuals"),
                           F.col("_y").alias("ys"), F.col("_x").alias("xs"),
                           F.array_repeat(F.lit(0.0), horizon).alias("x_future"))
    back = F.explode(F.sequence(F.lit(0), F.lit(origins - 1))) if origins > 1 else F.lit(0)
    cut = full.withColumn("_back", back)
    n = F.size("_y") - holdout - F.col("_back")
    return cut.filter(n > 0).select(
        series, F.add_months("_last", -holdout - F.col("_back")).alias("origin"),
        F.slice("_y", n + 1, F.lit(holdout)).alias("actuals"),
        F.slice("_y", F.lit(1), n).alias("ys"), F.slice("_x", F.lit(1), n).alias("xs"),
        F.slice("_x", n + 1, F.lit(holdout)).alias("x_future"))


def carried(arrays: DataFrame) -> list[str]:
    return [c for c in arrays.columns if c not in ("ys", "xs", "x_future")]


def with_grid(df: DataFrame, **axes: Sequence[float]) -> DataFrame:
    """Each row once per grid point, the point as struct `g`."""
    for name, values in axes.items():
        df = df.withColumn(f"_{name}", F.explode(F.lit([float(v) for v in values])))
    point = F.struct(*[F.col(f"_{n}").alias(n) for n in axes]).alias("g")
    return df.select(*[c for c in df.columns if c[1:] not in axes or c[0] != "_"], point)


def _steps(h: int) -> Column:
    return F.sequence(F.lit(1), F.lit(h))


def _diffs(arr: Column) -> Column:
    """Month-on-month changes."""
    tail, head = F.slice(arr, F.lit(2), F.size(arr) - 1), F.slice(arr, F.lit(1), F.size(arr) - 1)
    return F.zip_with(tail, head, lambda a, b: a - b)


def _rms(errors: Column) -> Column:
    sse = F.aggregate(errors, F.lit(0.0), lambda acc, e: acc + e * e)
    return F.sqrt(sse / F.nullif(F.size(errors), F.lit(0)))


def spreads(h: int, weight: Callable[[Column], Column]) -> Column:
    """Deviation of the error after 1 .. h steps, in deviations of one step.

    A model in moving-average form passes a one-step error on to the value `j` steps later by `weight(j)`, and by 1 to its
    own; the errors of the steps are independent, so their squared weights add up.
    """
    return F.transform(_steps(h), lambda s: F.sqrt(F.aggregate(
        F.sequence(F.lit(0), s - 1), F.lit(0.0), lambda acc, j: acc + F.when(j == 0, 1.0).otherwise(F.pow(weight(j), 2.0)))))


def baseline_paths(arrays: DataFrame, h: int, season: int) -> DataFrame:
    """Last value, straight-line drift, and the same month last year (needs more than a year)."""
    ys, n = F.col("ys"), F.size("ys")
    first, last = F.element_at(ys, 1), F.element_at(ys, -1)
    slope = (last - first) / F.nullif(n - 1, F.lit(0))
    changes = _diffs(ys)
    yearly = F.zip_with(F.slice(ys, F.lit(season + 1), F.greatest(n - season, F.lit(0))),
                        F.slice(ys, F.lit(1), F.greatest(n - season, F.lit(0))), lambda a, b: a - b)
    models = F.array(
        F.struct(F.lit("naive_last_value").alias("model"),
                 F.transform(_steps(h), lambda s: last).alias("path"), _rms(changes).alias("sigma"),
                 F.transform(_steps(h), lambda s: F.sqrt(s.cast("double"))).alias("spread")),
        F.struct(F.lit("drift").alias("model"),
                 F.transform(_steps(h), lambda s: last + slope * s).alias("path"),
                 _rms(F.transform(changes, lambda c: c - slope)).alias("sigma"),
                 # the slope is estimated too, from n - 1 changes
                 F.transform(_steps(h), lambda s: F.sqrt(s * (1 + s / F.nullif(n - 1, F.lit(0))))).alias("spread")),
        F.struct(F.lit("seasonal_naive").alias("model"),
                 F.when(n > season, F.transform(
                     _steps(h), lambda s: F.try_element_at(ys, n - season + (s - 1) % season + 1))).alias("path"),
                 F.when(n > season, _rms(yearly)).alias("sigma"),
                 F.transform(_steps(h), lambda s: F.sqrt(F.floor((s - 1) / season) + 1.0)).alias("spread")),
    )
    return arrays.select(*carried(arrays), F.inline(models)).filter(F.col("path").isNotNull())


def holt_paths(arrays: DataFrame, h: int, params: Params) -> DataFrame:
    """Damped trend, smoothing weights picked on a grid by one-step squared error."""
    state = "struct<level:double,trend:double,sse:double>"
    keys = carried(arrays)
    tried = with_grid(arrays.filter(F.size("ys") >= 2).select(*keys, "ys"),
                      a=params.holt_grid, b=params.holt_grid, p=params.damping_grid)
    ys = F.col("ys")
    a, b, p = F.col("g.a"), F.col("g.b"), F.col("g.p")
    start = F.struct(F.element_at(ys, 1).alias("level"),
                     (F.element_at(ys, 2) - F.element_at(ys, 1)).alias("trend"),
                     F.lit(0.0).alias("sse")).cast(state)

    def step(s: Column, y: Column) -> Column:
        damped = p * s["trend"]
        ahead = s["level"] + damped
        miss = y - ahead
        return F.struct((ahead + a * miss).alias("level"), (damped + a * b * miss).alias("trend"),
                        (s["sse"] + miss * miss).alias("sse")).cast(state)

    fits = tried.withColumn("fit", F.aggregate(F.slice(ys, F.lit(2), F.size(ys) - 1), start, step))
    best = fits.groupBy(*keys).agg(
        F.min_by(F.struct("g", "fit", F.size("ys").alias("n")), F.struct("fit.sse", "g.a", "g.b", "g.p")).alias("w"))
    damp, a, b = F.col("w.g.p"), F.col("w.g.a"), F.col("w.g.b")

    def reached(s: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), s), F.lit(0.0), lambda acc, i: acc + F.pow(damp, i.cast("double")))

    reach = F.transform(_steps(h), reached)
    return best.select(
        *keys, F.lit("holt_damped").alias("model"),
        F.transform(reach, lambda r: F.col("w.fit.level") + r * F.col("w.fit.trend")).alias("path"),
        F.sqrt(F.col("w.fit.sse") / (F.col("w.n") - 1)).alias("sigma"),
        # an error moves the level by a and the trend by a b, which is damped from then on
        spreads(h, lambda j: a + a * b * reached(j)).alias("spread"))


def arima_paths(arrays: DataFrame, h: int, params: Params, intervention: bool = False) -> DataFrame:
    """ARIMA(1,1,1) by conditional sum of squares on a grid.

    With an intervention the level shift of the dummy is estimated on the
    differences first and added back over `x_future`.
    """
    state = "struct<w:double,e:double,css:double>"
    ys, xs = F.col("ys"), F.col("xs")
    dx, dy = _diffs(xs), _diffs(ys)
    cross = F.aggregate(F.zip_with(dx, dy, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.aggregate(dx, F.lit(0.0), lambda acc, v: acc + v * v)
    shift = F.coalesce(cross / F.nullif(norm, F.lit(0.0)), F.lit(0.0)) if intervention else F.lit(0.0)
    keys = carried(arrays)
    based = arrays.filter(F.size("ys") >= 3).select("*", shift.alias("beta"))
    based = based.select(*keys, "x_future", "beta", F.zip_with(ys, xs, lambda y, x: y - F.col("beta") * x).alias("zs"))
    based = based.select("*", _diffs(F.col("zs")).alias("ws"))
    f, t = F.col("g.f"), F.col("g.t")
    start = F.struct(F.element_at("ws", 1).alias("w"), F.lit(0.0).alias("e"), F.lit(0.0).alias("css")).cast(state)

    def step(s: Column, w: Column) -> Column:
        e = w - f * s["w"] - t * s["e"]
        return F.struct(w.alias("w"), e.alias("e"), (s["css"] + e * e).alias("css")).cast(state)

    fits = with_grid(based, f=params.arma_grid, t=params.arma_grid).withColumn(
        "fit", F.aggregate(F.slice("ws", F.lit(2), F.size("ws") - 1), start, step))
    best = fits.groupBy(*keys).agg(F.min_by(
        F.struct("g", "fit", "beta", "x_future", F.element_at("zs", -1).alias("z"), F.size("ws").alias("n")),
        F.struct("fit.css", "g.f", "g.t")).alias("m"))
    # First step uses both terms; later changes decay by phi.
    phi, theta = F.col("m.g.f"), F.col("m.g.t")
    w1 = phi * F.col("m.fit.w") + theta * F.col("m.fit.e")

    def decayed(s: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), s), F.lit(0.0), lambda acc, i: acc + F.pow(phi, (i - 1).cast("double")))

    levels = F.transform(_steps(h), lambda s: F.col("m.z") + w1 * decayed(s))
    if intervention:
        levels = F.zip_with(levels, F.col("m.x_future"), lambda y, x: y + F.col("m.beta") * x)
    name = "arima_with_intervention" if intervention else "arima"
    return best.select(*keys, F.lit(name).alias("model"), levels.alias("path"),
                       F.sqrt(F.col("m.fit.css") / F.greatest(F.col("m.n") - 1, F.lit(1))).alias("sigma"),
                       # an error changes the next month by phi + theta, which decays by phi; changes add up to the level
                       spreads(h, lambda j: 1 + (phi + theta) * decayed(j)).alias("spread"))
