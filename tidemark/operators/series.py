"""Series, rolling backtest, model choice, measured bands and projection.

Methods are expressions over the values of a (series, cut) row, and every
judgement on their rows (errors, weights, choice, bands) is one too; only a
caller's own functions run in a grouped Python call.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.forecasters import ENSEMBLE, METHODS, REFERENCE, Method, finite
from ..functions.scalars import date_key, safe_div
from ..functions.scale import landed
from .joins import period_spine

Custom = Callable[[np.ndarray, int, int], np.ndarray]

# Cycle length, calendar step and nominal days of each frequency.
CYCLE = {"daily": 7, "weekly": 52, "monthly": 12, "quarterly": 4, "yearly": 1}
STEP = {"daily": "1 day", "weekly": "7 days", "monthly": "1 month", "quarterly": "3 months", "yearly": "1 year"}
STEP_DAYS = {"daily": 1, "weekly": 7, "monthly": 30, "quarterly": 90, "yearly": 365}
UNIT = {"monthly": "month", "quarterly": "quarter", "yearly": "year"}
MINIMUM_PERIODS = 24
NO_LABEL = ["", "nan", "n/a", "none"]


def period_of(day: Column, frequency: str) -> Column:
    """Start of the period; a week is labelled by the Sunday that ends it."""
    if frequency == "daily":
        return day.cast("date")
    if frequency == "weekly":
        return F.date_add(day.cast("date"), 6 - F.weekday(day))
    return F.trunc(day, UNIT[frequency])


def series(df: DataFrame, day: str, value: str, frequency: str = "monthly", aggregation: str = "sum",
           keys: Sequence[str] = ()) -> DataFrame:
    """Facts to a regular series; a period without data is a zero, not a gap."""
    combine = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[aggregation]
    grouped = (
        df.where(F.col(day).isNotNull())
        .groupBy(*keys, period_of(F.col(day), frequency).alias("period"))
        .agg(combine(F.col(value).cast("double")).cast("double").alias("value"))
    )
    return period_spine(grouped, "period", "value", keys, STEP[frequency])


def segment_label(columns: Sequence[str]) -> Column:
    parts = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    named = F.filter(parts, lambda x: ~F.lower(x).isin(NO_LABEL))
    return F.when(F.size(named) > 0, F.array_join(named, " · ")).otherwise(F.lit("—"))


def segment_series(df: DataFrame, day: str, value: str, segments: Sequence[str], frequency: str = "monthly",
                   aggregation: str = "sum", total: str = "TOTAL") -> DataFrame:
    """One regular series per segment label plus the total, in one aggregation."""
    combine = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[aggregation]
    rows = df.where(F.col(day).isNotNull()).select(
        segment_label(segments).alias("__label"),
        period_of(F.col(day), frequency).alias("period"),
        F.col(value).cast("double").alias("__v"),
    )
    label, period = F.col("__label"), F.col("period")
    grouped = (
        rows.groupingSets([[label, period], [period]], label, period)
        .agg(combine("__v").cast("double").alias("value"), F.grouping("__label").alias("__all"))
        .select(
            F.when(F.col("__all") == 1, F.lit(total)).otherwise(F.col("__label")).alias("segment"),
            "period", "value",
        )
    )
    return period_spine(grouped, "period", "value", ["segment"], STEP[frequency])


def long_enough(s: DataFrame, minimum: int = MINIMUM_PERIODS, total: str = "TOTAL") -> DataFrame:
    sizes = s.groupBy("segment").agg(F.count(F.lit(1)).alias("periods"))
    kept = sizes.where((F.col("periods") >= minimum) | (F.col("segment") == total))
    return s.join(kept.select("segment"), "segment", "left_semi")


def omitted_segments(s: DataFrame, minimum: int = MINIMUM_PERIODS, total: str = "TOTAL") -> DataFrame:
    sizes = s.groupBy("segment").agg(F.count(F.lit(1)).alias("periods"))
    return sizes.where((F.col("periods") < minimum) & (F.col("segment") != total))


def cuts_for(n: int, horizon: int, cycle: int, origins: int, minimum: int | None = None) -> list[int]:
    """Backtest cut positions, oldest first; empty when history is too short."""
    least = minimum if minimum is not None else max(2 * cycle, horizon + 2)
    usable = max(0, n - horizon - least + 1)
    return [n - horizon - k for k in range(min(origins, usable) - 1, -1, -1)]


TRIAL = (
    "segment string, method string, kind string, cut bigint, step bigint, "
    "position bigint, period date, actual double, predicted double, error string"
)


def run_methods(s: DataFrame, horizon: int = 3, cycle: int = 12, origins: int = 6,
                methods: Mapping[str, Method] | None = None, minimum: int | None = None,
                custom: Mapping[str, Custom] | None = None) -> DataFrame:
    """Rolling-origin trials and full-history forecasts of every method.

    A trial trains on the periods before its cut only.  Methods are expressions
    over the values up to a cut; a caller's own numpy functions (`custom`) run in
    one grouped call per series.  A method that fails or returns unusable numbers
    leaves an error row and costs nobody else.  Segments too short for one cut
    yield no rows.
    """
    table = dict(METHODS if methods is None and not custom else methods or {})
    least = minimum if minimum is not None else max(2 * cycle, horizon + 2)
    rows = s.select("segment", "period", F.col("value").cast("double").alias("value")).groupBy("segment").agg(
        F.array_sort(F.collect_list(F.struct("period", "value"))).alias("__h"))
    n = F.size("__h")
    usable = F.least(F.lit(origins), n - horizon - least + 1)
    cuts = F.concat(F.transform(F.sequence(F.lit(1), usable), lambda k: n - horizon - usable + k), F.array(n))
    rows = rows.where(usable > 0).select("segment", "__h", F.explode(cuts).alias("__cut"))
    # a cut is much work on few bytes, which adaptive execution would put into one task
    tasks = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "segment", "__cut")
    rows = rows.withColumn("__y", F.transform(F.slice("__h", F.lit(1), F.col("__cut")), lambda x: x["value"]))
    outcomes = F.array(*[F.struct(F.lit(name).alias("method"), fn(F.col("__y"), horizon, cycle).alias("out"))
                         for name, fn in table.items()])
    pieces = []
    if table:
        pieces.append(rows.select("segment", "__h", "__cut", F.inline(outcomes)).select(*_trial_rows(horizon)))
    if custom:
        pieces.append(_custom_trials(s, horizon, cycle, origins, custom, minimum))
    return pieces[0] if len(pieces) == 1 else pieces[0].unionByName(pieces[1])


def _trial_rows(horizon: int) -> list[Column]:
    """Columns of TRIAL from (segment, __h, __cut, method, out)."""
    n, cut = F.size("__h"), F.col("__cut")
    good = F.coalesce((F.size("out") == horizon) & F.forall("out", finite), F.lit(False))
    at = lambda h, name: F.get("__h", cut + h - 1)[name]
    told = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.struct(
        h.cast("long").alias("step"), (cut + h - 1).cast("long").alias("position"), at(h, "period").alias("period"),
        at(h, "value").alias("actual"), F.get("out", h - 1).alias("predicted"), F.lit(None).cast("string").alias("error")))
    nothing = F.array(F.struct(
        *[F.lit(None).cast(t).alias(c) for c, t in (("step", "long"), ("position", "long"), ("period", "date"), ("actual", "double"), ("predicted", "double"))],
        F.lit("ValueError: unusable forecast").alias("error")))
    kind = F.when(cut == n, "future").otherwise("backtest").alias("kind")
    return [F.col("segment"), F.col("method"), kind, cut.cast("long").alias("cut"), F.inline(F.when(good, told).otherwise(nothing))]


def _custom_trials(s: DataFrame, horizon: int, cycle: int, origins: int, custom: Mapping[str, Custom], minimum: int | None) -> DataFrame:
    table = dict(custom)

    def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        y, periods = pdf["value"].to_numpy(float), pdf["period"].to_numpy()
        name, n = pdf["segment"].iloc[0], len(pdf)
        cuts = cuts_for(n, horizon, cycle, origins, minimum)
        rows = []
        for method, fn in table.items() if cuts else ():
            for cut in [*cuts, n]:
                kind = "future" if cut == n else "backtest"
                try:
                    out = np.asarray(fn(y[:cut].copy(), horizon, cycle), dtype=float)
                    if out.shape != (horizon,) or not np.isfinite(out).all():
                        raise ValueError("unusable forecast")
                except Exception as error:  # a broken method must not stop the rest
                    rows.append((name, method, kind, cut, None, None, None, None, None, f"{type(error).__name__}: {error}"))
                    continue
                for h in range(horizon):
                    at = cut + h
                    known = at < n
                    rows.append((name, method, kind, cut, h + 1, at, periods[at] if known else None,
                                 y[at] if known else None, out[h], None))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in TRIAL.split(", ")])

    return s.select("segment", "period", "value").groupBy("segment").applyInPandas(per_series, TRIAL)


def trial_metrics(trials: DataFrame) -> DataFrame:
    """MAE, RMSE, sMAPE, MAPE per (segment, method, cut)."""
    err = F.col("predicted") - F.col("actual")
    half = (F.abs("actual") + F.abs("predicted")) / 2
    symmetric = F.when(half == 0, 0.0).otherwise(safe_div(F.abs(err), half))
    relative = F.abs(safe_div(err, "actual"))
    return trials.groupBy("segment", "method", "cut").agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(symmetric) * 100).alias("smape"),
        F.when(F.count_if(F.col("actual") == 0) == 0, F.avg(relative) * 100).alias("mape"),
    )


def method_metrics(trials: DataFrame) -> DataFrame:
    """Mean of the per-cut metrics and the gain over the reference method."""
    means = trial_metrics(trials).groupBy("segment", "method").agg(
        F.count(F.lit(1)).alias("origins"),
        *[F.avg(c).alias(c) for c in ("mae", "rmse", "smape", "mape")],
    )
    rivals = Window.partitionBy("segment")  # one row per method
    reference = F.max(F.when(F.col("method") == REFERENCE, F.col("mae"))).over(rivals)
    return means.withColumn(
        "gain_vs_reference_pct", F.when(reference > 0, (1 - safe_div(F.col("mae"), reference)) * 100)
    )


def inverse_error_weights(metrics: DataFrame, keys: Sequence[str] = ("segment",), error: str = "mae") -> DataFrame:
    """Weights proportional to 1 / error, summing to one per group.

    A group holds one row per method, so the window stays tiny.
    """
    inverse = 1 / F.greatest(F.col(error), F.lit(1e-9))
    whole = Window.partitionBy(*keys)
    return metrics.where(F.col(error).isNotNull()).withColumn("weight", inverse / F.sum(inverse).over(whole))


def ensemble_trials(trials: DataFrame) -> DataFrame:
    """The weighted blend judged without looking: the weights of a cut come
    from EARLIER cuts only, so the first cut cannot be scored."""
    past = Window.partitionBy("segment", "method").orderBy("cut").rangeBetween(Window.unboundedPreceding, -1)
    rivals = Window.partitionBy("segment", "cut", "step")
    missed = F.abs(F.col("predicted") - F.col("actual"))
    inverse = 1 / F.greatest(F.col("__past"), F.lit(1e-9))
    return (
        trials.withColumn("__past", F.avg(missed).over(past))
        .where("__past is not null")
        .withColumn("__weight", inverse / F.sum(inverse).over(rivals))
        .groupBy("segment", "cut", "step", "position")
        .agg(
            F.first("period").alias("period"),
            F.first("actual").alias("actual"),
            F.sum(F.col("__weight") * F.col("predicted")).alias("predicted"),
        )
        .withColumn("method", F.lit(ENSEMBLE))
    )


def choose_model(metrics: DataFrame, metric: str = "mae") -> DataFrame:
    """Least error per segment, and whether it beats the reference at all."""
    best = F.min_by(F.struct("method", metric, "origins", "gain_vs_reference_pct"), F.struct(metric, "method"))
    reference = F.max(F.when(F.col("method") == REFERENCE, F.col(metric)))
    return (
        metrics.where(F.col(metric).isNotNull())
        .groupBy("segment")
        .agg(best.alias("b"), reference.alias("reference_error"))
        .select(
            "segment",
            F.col("b.method").alias("method"),
            F.col(f"b.{metric}").alias("error"),
            F.col("b.origins").alias("origins"),
            "reference_error",
            F.col("b.gain_vs_reference_pct").alias("gain_pct"),
            F.coalesce(
                (F.col("b.method") != REFERENCE) & (F.col(f"b.{metric}") < F.col("reference_error")), F.lit(False)
            ).alias("beats_reference"),
        )
    )


def error_bands(trials: DataFrame, level: float = 0.8) -> DataFrame:
    """Measured relative-error quantiles per step; no bell curve is assumed.

    A group holds at most one error per cut.
    """
    low, high = (1 - level) / 2, 1 - (1 - level) / 2
    relative = F.when(F.col("actual") != 0, (F.col("predicted") - F.col("actual")) / F.abs("actual"))
    enough = F.count(relative) >= 2
    q = F.percentile(relative, F.array(F.lit(low), F.lit(high), F.lit(0.5)))
    return trials.groupBy("segment", "method", "step").agg(
        F.count(relative).alias("errors"),
        F.when(enough, q[0]).alias("low_error"),
        F.when(enough, q[1]).alias("high_error"),
        F.when(enough, q[2]).alias("bias"),
        F.when(enough, F.avg(F.abs(relative))).alias("mean_abs_error"),
    )


def apply_bands(future: DataFrame, bands: DataFrame) -> DataFrame:
    """Floor and ceiling of a forecast: a method that runs high is cut down."""
    joined = future.join(bands, ["segment", "method", "step"], "left")

    def bounded(error):
        scale = 1 + F.col(error)
        return F.when(scale > 0, safe_div("predicted", scale))

    return joined.select(
        *future.columns, bounded("high_error").alias("low"), bounded("low_error").alias("high")
    )


def future_periods(s: DataFrame, horizon: int, frequency: str = "monthly") -> DataFrame:
    """The next period starts per segment, with their nominal day counts."""
    count, unit = STEP[frequency].split()
    last = s.groupBy("segment").agg(F.max("period").alias("__last"))
    rows = F.array(
        *[
            F.struct(
                F.lit(h).cast("bigint").alias("step"),
                F.expr(f"cast(__last + interval {int(count) * h} {unit} as date)").alias("period"),
                F.lit(h * STEP_DAYS[frequency]).cast("bigint").alias("days"),
            )
            for h in range(1, horizon + 1)
        ]
    )
    return last.select("segment", F.inline(rows))


def ensemble_future(future: DataFrame, metrics: DataFrame) -> DataFrame:
    """Blend of the full-history forecasts, weighted by all measured errors."""
    weights = inverse_error_weights(metrics.where(F.col("method") != ENSEMBLE)).select("segment", "method", "weight")
    return (
        future.join(weights, ["segment", "method"])
        .groupBy("segment", "cut", "step", "position")
        .agg(
            F.first("period").alias("period"),
            F.first("actual").alias("actual"),
            (F.sum(F.col("weight") * F.col("predicted")) / F.sum("weight")).alias("predicted"),
        )
        .withColumn("method", F.lit(ENSEMBLE))
    )


COMMON = ["segment", "method", "cut", "step", "position", "period", "actual", "predicted"]


class Projection:
    """The tables of one projection run, all derived from one trial table."""

    def __init__(self, s: DataFrame, frequency: str = "monthly", horizon: int = 3, origins: int = 6,
                 cycle: int | None = None, level: float = 0.8, metric: str = "mae",
                 methods: Mapping[str, Method] | None = None, minimum: int | None = None,
                 custom: Mapping[str, Custom] | None = None):
        self.series, self.frequency, self.horizon = s, frequency, horizon
        cycle = cycle or CYCLE[frequency]
        # Trial rows are read by every table below and are small beside the facts: written once.
        self.raw = landed(run_methods(s, horizon, cycle, origins, methods, minimum, custom))
        good = self.raw.where("error is null")
        base = good.where("kind = 'backtest'").select(*COMMON)
        self.trials = base.unionByName(ensemble_trials(base).select(*COMMON))
        self.metrics = method_metrics(self.trials)
        self.choice = choose_model(self.metrics, metric)
        self.bands = error_bands(self.trials, level)
        base_future = good.where("kind = 'future'").select(*COMMON)
        self.future = base_future.unionByName(ensemble_future(base_future, self.metrics).select(*COMMON))

    def errors(self) -> DataFrame:
        return self.raw.where("error is not null").select("segment", "method", "kind", "cut", "error")

    def forecast(self) -> DataFrame:
        picked = self.future.join(self.choice.select("segment", "method"), ["segment", "method"])
        dated = picked.drop("period", "actual", "cut", "position").join(
            future_periods(self.series, self.horizon, self.frequency), ["segment", "step"]
        )
        return apply_bands(dated, self.bands)

    def table(self) -> DataFrame:
        """History and projection in one table, ready for the star model."""
        history = self.series.select(
            "segment", "period", "value", F.lit("history").alias("kind"), F.lit("").alias("method"),
            F.lit(None).cast("bigint").alias("step"), F.lit(None).cast("bigint").alias("days"),
            F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        )
        ahead = self.forecast().select(
            "segment", "period", F.col("predicted").alias("value"), F.lit("projection").alias("kind"),
            "method", "step", "days", "low", "high",
        )
        return history.unionByName(ahead).withColumn("date_key", date_key("period"))

    def actual_vs_projected(self) -> DataFrame:
        """What the chosen method would have said at each cut, against facts."""
        rows = self.trials.join(self.choice.select("segment", "method"), ["segment", "method"])
        return deviations(rows)


def deviations(trials: DataFrame) -> DataFrame:
    gap = F.col("predicted") - F.col("actual")
    return trials.select(
        "segment", "method", "cut", "step", "period", "actual", "predicted",
        gap.alias("deviation"), (safe_div(gap, "actual") * 100).alias("deviation_pct"),
    )


def projection_measures(table: DataFrame) -> DataFrame:
    """Historical, projected, low, high, band width and the full line."""
    history, ahead = F.col("kind") == "history", F.col("kind") == "projection"
    out = table.groupBy("segment", "period").agg(
        F.sum(F.when(history, F.col("value"))).alias("historical"),
        F.sum(F.when(ahead, F.col("value"))).alias("projected"),
        F.sum(F.when(ahead, F.col("low"))).alias("low"),
        F.sum(F.when(ahead, F.col("high"))).alias("high"),
        F.sum("value").alias("line"),
    )
    return out.withColumn("band_width_pct", safe_div(F.col("high") - F.col("low"), "projected") * 100)


def backtest_measures(compared: DataFrame) -> DataFrame:
    """Real, projected and deviation per segment; mean absolute % per cut."""
    per_cut = compared.groupBy("segment", "cut").agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted")
    )
    gap = F.sum("predicted") - F.sum("actual")
    return per_cut.groupBy("segment").agg(
        F.sum("actual").alias("actual"),
        F.sum("predicted").alias("predicted"),
        gap.alias("deviation"),
        (safe_div(gap, F.sum("actual")) * 100).alias("deviation_pct"),
        (F.avg(F.abs(safe_div(F.col("predicted") - F.col("actual"), "actual"))) * 100).alias("mean_abs_deviation_pct"),
    )


def deviation_by_step(compared: DataFrame) -> DataFrame:
    return compared.groupBy("segment", "step").agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg("deviation_pct").alias("mean_deviation_pct"),
        F.avg(F.abs("deviation_pct")).alias("mean_abs_deviation_pct"),
    )


# --- the elementary forecasters as set operations, for many short series -----

def last_value(s: DataFrame) -> DataFrame:
    return s.groupBy("segment").agg(F.max_by("value", "period").alias("predicted"))


def trailing_mean(s: DataFrame, cycle: int = 12) -> DataFrame:
    span = Window.partitionBy("segment").orderBy(F.desc("period"))
    recent = s.withColumn("__r", F.row_number().over(span)).where(F.col("__r") <= max(3, cycle))
    return recent.groupBy("segment").agg(F.avg("value").alias("predicted"))


def drift_line(s: DataFrame, horizon: int = 3) -> DataFrame:
    edges = s.groupBy("segment").agg(
        F.max_by("value", "period").alias("b"), F.min_by("value", "period").alias("a"), F.count(F.lit(1)).alias("n")
    )
    slope = F.coalesce(safe_div(F.col("b") - F.col("a"), F.col("n") - 1), F.lit(0.0))
    steps = F.array(*[F.struct(F.lit(h).cast("bigint").alias("step"), (F.col("b") + slope * h).alias("predicted")) for h in range(1, horizon + 1)])
    return edges.select("segment", F.inline(steps))


def same_position(s: DataFrame, horizon: int = 3, cycle: int = 12) -> DataFrame:
    """Seasonal naive: the value one cycle before each future step."""
    span = Window.partitionBy("segment").orderBy(F.desc("period"))
    back = s.withColumn("__r", F.row_number().over(span)).where(F.col("__r") <= cycle)
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    ahead = s.select("segment").distinct().select("segment", steps)
    wanted = ahead.withColumn("__r", F.lit(cycle) - (F.col("step") - 1) % cycle)
    return wanted.join(back, ["segment", "__r"]).select(
        "segment", F.col("step").cast("bigint").alias("step"), F.col("value").alias("predicted")
    )
