"""Seasonal decomposition of many series, of any length, in one job.

Positions come from range-partitioned chunks; the moving average runs in blocks of consecutive
positions that borrow half a period of rows from their neighbours; everything per series (end lines,
phase means, strengths) is a plain aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plantlake.functions.columns import number, present
from plantlake.joins import join_sized
from plantlake.ordered import UNLIMITED, WINDOW_ROWS, chunks_for, window_plan, with_position
from plantlake.session import settle

MODELS = ("additive", "multiplicative")
BLOCK = 65536


def moving_average(
    df: DataFrame, period: int, value: str = "value", pos: str = "pos", *, series_cols: Sequence[str] = (),
    out: str = "trend", blocks: bool = True,
) -> DataFrame:
    """Centred moving average over ``period`` rows; an even period weighs both ends by one half.

    Null within half a period of either end of the series. Without ``blocks`` each series is one window,
    which suits series known to be short.
    """
    series = list(series_cols)
    half = period // 2
    if half == 0:
        return df.withColumn(out, F.col(value))
    if blocks:
        block = max(BLOCK, 8 * period)
        home = F.floor(F.col(pos) / block)
        reach = F.sequence(
            F.greatest(F.floor((F.col(pos) - half) / block), F.lit(0)), F.floor((F.col(pos) + half) / block)
        )
        df = df.withColumn("_block", F.explode(reach))
    frame = W.partitionBy(*series, *(["_block"] if blocks else [])).orderBy(pos).rowsBetween(-half, half)
    total = F.sum(value).over(frame)
    if period % 2 == 0:
        total = total - (F.first(value).over(frame) + F.last(value).over(frame)) / 2
    full = F.count(F.lit(1)).over(frame) == 2 * half + 1
    averaged = df.withColumn(out, F.when(full, total / period))
    return averaged.where(F.col("_block") == home).drop("_block") if blocks else averaged


def _line(y: Column, x: Column, shift: int, inside: Column) -> tuple[Column, Column]:
    """Least-squares slope and intercept over ``x``, which is the position less ``shift``.

    A single point gives the line of smallest norm through it, in terms of the position itself.
    """
    y, x = F.when(inside, y), F.when(inside, x)
    at, one = F.max(x) + shift, F.max(y)
    single = F.count(y) == 1
    flat = one * at / (at * at + 1)
    slope = F.when(single, flat).otherwise(F.regr_slope(y, x))
    icept = F.when(single, one / (at * at + 1) + flat * shift).otherwise(F.regr_intercept(y, x))
    return slope, icept


def end_lines(df: DataFrame, period: int, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """Lines through the ``period`` trend points next to either end, the last valid point left out at the tail.

    x is the position minus the first valid position.
    """
    half = period // 2
    back = F.col("_n") - 1 - half
    x = (F.col("pos") - half).cast("double")
    head = (F.col("pos") >= half) & (F.col("pos") < F.least(F.lit(half + period), back))
    tail = (F.col("pos") >= F.greatest(F.lit(half), back - period)) & (F.col("pos") < back)
    hs, hi = _line(F.col("trend"), x, half, head)
    ts_, ti = _line(F.col("trend"), x, half, tail)
    return df.where(head | tail).groupBy(*series_cols).agg(
        hs.alias("_hs"), hi.alias("_hi"), ts_.alias("_ts"), ti.alias("_ti")
    )


def phase_means(df: DataFrame, detrended: Column, period: int, model: str, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """One array of ``period`` seasonal values per series, centred to mean 0 or scaled to mean 1."""
    series = list(series_cols)
    per = df.groupBy(*series, F.pmod("pos", F.lit(period)).cast("int").alias("_phase")).agg(F.avg(detrended).alias("_m"))
    packed = per.groupBy(*series).agg(
        F.avg("_m").alias("_mid"), F.sort_array(F.collect_list(F.struct("_phase", "_m"))).alias("_p")
    )
    mid = F.col("_mid")
    centred = F.transform("_p", lambda s: s["_m"] - mid if model == "additive" else F.try_divide(s["_m"], mid))
    return packed.select(*series, centred.alias("_season"))


def positions(
    df: DataFrame, ts: str, value: str, *, series_cols: Sequence[str] = (), tie_cols: Sequence[str] = (),
    window_rows: int = WINDOW_ROWS, chunks: int | None = None,
) -> DataFrame:
    """(series, ts, value, pos, _n): nulls dropped, 0-based position in time order, rows per series."""
    series = list(series_cols)
    rows = present(df, value).select(*series, *tie_cols, F.col(ts).alias("ts"), number(value).alias("value"))
    numbered = with_position(rows, series, ["ts", *tie_cols], total="_n", window_rows=window_rows, chunks=chunks)
    return numbered.select(*series, "ts", "value", "pos", "_n")


def decompose(
    df: DataFrame, ts: str, value: str, period: int, model: str = "additive", *,
    series_cols: Sequence[str] = (), tie_cols: Sequence[str] = (), window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """(series, ts, pos, observed, trend, seasonal, resid) of every series with two full periods.

    ``tie_cols`` order rows of equal time. Series that are too short, or not positive under the
    multiplicative model, are left out; ``season_strength`` reports why. Series longer than
    ``window_rows`` are worked on in chunks.
    """
    _check(period, model)
    short, chunks = window_plan(present(df, value), series_cols, window_rows)
    rows = positions(df, ts, value, series_cols=series_cols, tie_cols=tie_cols, window_rows=UNLIMITED if short else 0, chunks=chunks)
    return _decompose(rows, period, model, list(series_cols), short)


def _check(period: int, model: str) -> None:
    if model not in MODELS:
        raise ValueError(f"model must be one of {MODELS}")
    if period < 1:
        raise ValueError("period must be positive")


def _decompose(rows: DataFrame, period: int, model: str, series: list[str], short: bool) -> DataFrame:
    if model == "multiplicative":
        lowest = rows.groupBy(*series).agg(F.min("value").alias("_lowest"))
        rows = join_sized(rows, lowest, series, "inner").where(F.col("_lowest") > 0).drop("_lowest")
    rows = rows.where(F.col("_n") >= 2 * period)
    averaged = settle(moving_average(rows, period, series_cols=series, blocks=not short), "averaged")
    if period >= 2:
        half = period // 2
        x = F.col("pos") - half
        trend = (
            F.when(F.col("pos") < half, F.col("_hi") + F.col("_hs") * x)
            .when(F.col("pos") > F.col("_n") - 1 - half, F.col("_ti") + F.col("_ts") * x)
            .otherwise(F.col("trend"))
        )
        lined = join_sized(averaged, end_lines(averaged, period, series_cols=series), series, "left")
        lined = lined.withColumn("trend", trend).drop("_hs", "_hi", "_ts", "_ti")
    else:
        lined = averaged
    additive = model == "additive"
    detrended = F.col("value") - F.col("trend") if additive else F.try_divide("value", "trend")
    season = phase_means(lined, detrended, period, model, series_cols=series)
    seasonal = F.col("_season")[F.pmod("pos", F.lit(period)).cast("int")]
    out = join_sized(lined, season, series, "left").withColumn("seasonal", seasonal)
    resid = (
        F.col("value") - F.col("trend") - F.col("seasonal") if additive
        else F.try_divide(F.try_divide("value", "seasonal"), F.col("trend"))
    )
    return out.select(
        *series, "ts", "pos", F.col("value").alias("observed"), "trend", "seasonal", resid.alias("resid")
    )


def strengths(parts: DataFrame, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """Trend and season strength per series; null for fewer than two rows or a flat denominator."""
    r = F.col("resid")

    def strength(part: str) -> Column:
        whole = F.var_pop(F.col(part) + r)
        return F.when((F.count(r) > 1) & (whole > 0), F.greatest(F.lit(0.0), 1 - F.var_pop(r) / whole))

    return parts.groupBy(*series_cols).agg(
        F.count(F.lit(1)).alias("n"),
        strength("trend").alias("trend_strength"),
        strength("seasonal").alias("season_strength"),
    )


def season_strength(
    df: DataFrame, ts: str, value: str, period: int, model: str = "additive", *,
    series_cols: Sequence[str] = (), tie_cols: Sequence[str] = (), window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """One row per series: n, status and the two strengths (null unless the status is ``ok``).

    Rows without a series key belong to no series and are left out, as in ``decompose``.
    """
    _check(period, model)
    series = list(series_cols)
    df = df.dropna(subset=series) if series else df
    facts = settle(
        present(df, value).groupBy(*series).agg(F.count(F.lit(1)).alias("n"), F.min(number(value)).alias("_lowest")), "facts"
    )
    longest, total = facts.agg(F.max("n"), F.sum("n")).first()
    short = window_rows > 0 and (longest or 0) <= window_rows
    rows = positions(
        df, ts, value, series_cols=series, tie_cols=tie_cols, window_rows=UNLIMITED if short else 0, chunks=chunks_for(df, total or 0)
    )
    status = F.when(F.col("n") < 2 * period, F.format_string(f"need at least {2 * period} rows, found %d", "n"))
    if model == "multiplicative":
        status = status.when(F.col("_lowest") <= 0, F.lit("multiplicative model needs positive values"))
    facts = facts.select(*series, "n", status.otherwise(F.lit("ok")).alias("status"))
    found = strengths(_decompose(rows, period, model, series, short), series_cols=series).drop("n")
    if not series:
        return facts.join(F.broadcast(found), how="left", on=F.lit(True))
    return facts.join(found, series, "left")


# fixed values: seasonal period by sampling step
PERIODS = {"hour": 24, "day": 7, "business day": 5, "week": 52, "month": 12}


def infer_period(df: DataFrame, ts: str, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """(series, n, frequency, period) from the actual sampling step; null where no common step fits.

    A series fits a step when its timestamps are distinct, all at the same place inside the step, and
    their step numbers run without a hole. At least three timestamps are needed.
    """
    series = list(series_cols)
    stamp = F.col(ts).cast("timestamp")
    distinct = df.where(F.col(ts).isNotNull()).groupBy(*series, stamp.alias("_t")).agg(F.count(F.lit(1)).alias("_m"))
    t = F.col("_t")
    micros = F.unix_micros(t)
    day = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date"))
    week_day = F.weekday(t)
    month_no = F.year(t) * 12 + F.month(t)

    def even(step_micros: int) -> Column:
        off = F.pmod(micros, F.lit(step_micros))
        no = F.floor(micros / step_micros)
        return (F.min(off) == F.max(off)) & (F.max(no) - F.min(no) + 1 == F.count(F.lit(1)))

    micros_per_day = 86_400_000_000
    clock = F.pmod(micros, F.lit(micros_per_day))
    same_clock = F.min(clock) == F.max(clock)
    business_no = F.floor((day + 3) / 7) * 5 + week_day
    week_off = F.pmod(day, F.lit(7))
    gap_weeks = (F.max(day) - F.min(day)) / (7 * (F.count(F.lit(1)) - 1))
    facts = distinct.groupBy(*series).agg(
        F.sum("_m").alias("n"), F.count(F.lit(1)).alias("_d"),
        even(3_600_000_000).alias("_hour"), even(micros_per_day).alias("_day"),
        (same_clock & (F.max(week_day) <= 4) & (F.max(business_no) - F.min(business_no) + 1 == F.count(F.lit(1)))).alias("_business"),
        (same_clock & (F.min(week_off) == F.max(week_off))).alias("_week"),
        gap_weeks.alias("_gap"), F.min(day).alias("_from"),
        (same_clock & (F.bool_and(F.dayofmonth(t) == 1) | F.bool_and(F.last_day(t) == t.cast("date")))
         & (F.max(month_no) - F.min(month_no) + 1 == F.count(F.lit(1)))).alias("_month"),
    )
    # weekly series may step by several weeks: every stamp must then sit on that longer step
    facts = settle(facts, "steps")
    weekly = facts.where("_week and _d > 1 and not (_hour or _day or _business)").select(*series, "_gap", "_from")
    if weekly.isEmpty():
        facts = facts.withColumn("_weeks", F.lit(False))
    else:
        on_step = (F.col("_gap") == F.floor("_gap")) & (F.pmod(day - F.col("_from"), F.col("_gap") * 7) == 0)
        steady = join_sized(distinct, weekly, series, "inner").groupBy(*series).agg(F.bool_and(on_step).alias("_weeks"))
        facts = facts.join(steady, series, "left") if series else facts.join(F.broadcast(steady), how="left", on=F.lit(True))
    usable = (F.col("n") == F.col("_d")) & (F.col("n") >= 3)
    frequency = (
        F.when(~usable, F.lit(None))
        .when(F.col("_hour"), "hour").when(F.col("_day"), "day").when(F.col("_business"), "business day")
        .when(F.col("_weeks"), "week").when(F.col("_month"), "month")
    )
    table = F.create_map(*[x for k, v in PERIODS.items() for x in (F.lit(k), F.lit(v))])
    period = F.when(frequency == "week", F.floor(F.lit(PERIODS["week"]) / F.col("_gap")).cast("int")).otherwise(table[frequency])
    return facts.select(*series, "n", frequency.alias("frequency"), period.alias("period"))
