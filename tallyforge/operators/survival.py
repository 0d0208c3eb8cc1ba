"""Retention: how long a mention lasts, with censoring, as windows over event times.

Durations are small integers, so every curve is built from counts by (arm, time):
the rows are aggregated once and the windows run over the distinct times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.dist import normal_quantile
from tallyforge.operators.paired import SEED
from tallyforge.operators.rates import GROUP
from tallyforge.operators.resample import resampled

AT_RISK = 0.10
MIN_HORIZON = 3
REFERENCE = ("d1", "d2", "d3")


def retention_dataset(df: DataFrame, *, pre_use_only: bool = True) -> DataFrame:
    """run_id, task_id, condition_id, duration, event, censor_reason of rows with a mention."""
    rows = df.where(F.coalesce("ever_mention", F.lit(False)))
    span = F.col("first_use_probe_index") - F.col("first_mention_probe_index")
    lapsed = F.col("lapse").isNotNull()
    rows = rows.select("run_id", "task_id", GROUP, F.coalesce("lapse", "horizon").cast("long").alias("duration"), lapsed.cast("int").alias("event"), F.when(~lapsed, F.coalesce("censor_reason", F.lit("administrative"))).alias("censor_reason"), span.cast("long").alias("span")).where("duration is not null")
    if pre_use_only:
        rows = rows.where("span is null or span >= 0")
        cut = F.coalesce(F.col("duration") > F.col("span"), F.lit(False))
        rows = rows.select("run_id", "task_id", GROUP, F.when(cut, F.col("span")).otherwise(F.col("duration")).alias("duration"), F.when(cut, 0).otherwise(F.col("event")).alias("event"), F.when(cut, "post_discharge").otherwise(F.col("censor_reason")).alias("censor_reason"))
    return rows.where("duration >= 0").select("run_id", "task_id", GROUP, "duration", "event", "censor_reason")


def life_table(data: DataFrame, by: tuple[str, ...] = (GROUP,)) -> DataFrame:
    """By group and time: events, all that end there, and all still at risk."""
    times = data.groupBy(*by, "duration").agg(F.sum("event").cast("long").alias("events"), F.count("*").alias("ending"))
    return times.withColumn("at_risk", F.sum("ending").over(Window.partitionBy(*by).orderBy(F.desc("duration"))))


def common_horizon(data: DataFrame, fraction: float = AT_RISK) -> DataFrame:
    """Each arm's last time with enough at risk, and the least of these over arms."""
    table = life_table(data)
    whole = Window.partitionBy(GROUP)
    table = table.withColumn("n", F.sum("ending").over(whole))
    arms = table.groupBy(GROUP).agg(F.max("n").alias("n"), F.coalesce(F.max(F.when(F.col("at_risk") / F.col("n") >= fraction, F.col("duration"))), F.lit(0)).alias("j_arm"))
    least = arms.agg(F.min("j_arm").alias("j"))
    return arms.crossJoin(least)  # one row


def km_curve(data: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Survival by arm and time with the log-log (exponential Greenwood) band."""
    order = Window.partitionBy(GROUP).orderBy("duration")
    d, n = F.col("events").cast("double"), F.col("at_risk").cast("double")
    t = life_table(data).select("*", F.sum(F.ln(F.nullif(1 - d / n, F.lit(0.0)))).over(order).alias("log_s"), F.max((F.col("events") == F.col("at_risk")).cast("int")).over(order).alias("ended"), F.sum(F.try_divide(d, n * (n - d))).over(order).alias("green"))
    s = F.when(F.col("ended") == 1, 0.0).otherwise(F.exp(F.coalesce("log_s", F.lit(0.0))))
    z = normal_quantile(1 - alpha / 2)
    t = t.withColumn("survival", s)
    inner = (F.col("survival") > 0) & (F.col("survival") < 1)
    v = F.ln(-F.ln(F.when(inner, F.col("survival"))))
    spread = z * F.sqrt("green") / F.abs(F.ln(F.when(inner, F.col("survival"))))
    edge = F.when(F.col("survival") >= 1, 1.0).when(F.col("survival") <= 0, 0.0)
    return t.select(GROUP, "duration", "events", "at_risk", "survival", F.coalesce(F.exp(-F.exp(v + spread)), edge).alias("band_low"), F.coalesce(F.exp(-F.exp(v - spread)), edge).alias("band_high"))


def rmst(data: DataFrame, horizon: DataFrame | None = None) -> DataFrame:
    """Restricted mean survival time to the common horizon, by arm: the area of steps under the curve."""
    horizon = horizon if horizon is not None else common_horizon(data)
    curve = km_curve(data).select(GROUP, "duration", "survival", "events")
    j = horizon.select(F.col(GROUP).alias("arm"), "j", "n", "j_arm")
    steps = curve.join(j, F.col(GROUP).eqNullSafe(F.col("arm"))).where("events > 0 and duration <= j")
    order = Window.partitionBy(GROUP).orderBy("duration")
    steps = steps.withColumn("until", F.coalesce(F.lead("duration").over(order), F.col("j")))
    later = steps.groupBy(GROUP).agg(F.sum(F.col("survival") * (F.col("until") - F.col("duration"))).alias("area"), F.min("duration").alias("first"))
    out = j.join(later, F.col("arm").eqNullSafe(F.col(GROUP)), "left")
    area = F.coalesce(F.col("area") + F.col("first"), F.col("j").cast("double"))
    spread = data.groupBy(F.col(GROUP).alias("of_arm")).agg(F.stddev_samp(F.col("duration").cast("double")).alias("duration_sd"), F.sum("event").cast("long").alias("n_events"))
    out = out.select(F.col("arm").alias(GROUP), "n", "j_arm", "j", area.alias("rmst"))
    return out.join(spread, F.col(GROUP).eqNullSafe(F.col("of_arm")), "left").drop("of_arm")


def rmst_contrast(data: DataFrame, *, reference: str, draws: int = 1000, seed: int = SEED, alpha: float = 0.05) -> DataFrame:
    """RMST difference to a reference arm with intervals from resampled tasks, one draw for all arms.

    What a draw sends is counts by arm, time and event; curves of draws are windows over those small tables.
    """
    counts = data.where(F.col(GROUP).isNotNull()).groupBy("task_id", F.col(GROUP).alias("arm"), "duration", "event").agg(F.count("*").alias("w"))
    drawn = resampled(counts, "task_id", ["w"], cell=["arm", "duration", "event"], draws=draws, seed=seed)
    j = common_horizon(data).agg(F.min("j").alias("j"))  # one row
    times = drawn.groupBy("draw", "arm", "duration").agg(F.sum("w").alias("n"), F.sum(F.when(F.col("event").cast("int") == 1, F.col("w")).otherwise(0.0)).alias("e"))
    own = Window.partitionBy("draw", "arm")
    later = own.orderBy(F.desc("duration")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = own.orderBy("duration").rowsBetween(Window.unboundedPreceding, -1)
    rows = times.withColumn("at_risk", F.sum("n").over(later)).crossJoin(F.broadcast(j)).withColumn("t", F.least(F.col("duration").cast("double"), F.col("j").cast("double")))
    stay = F.when((F.col("e") > 0) & (F.col("duration") <= F.col("j")), 1 - F.col("e") / F.col("at_risk")).otherwise(1.0)
    rows = rows.withColumn("stay", stay).withColumn("s", F.coalesce(F.product("stay").over(before), F.lit(1.0))).withColumn("from", F.coalesce(F.max("t").over(before), F.lit(0.0)))
    # the last time's curve goes on to the horizon
    one = rows.groupBy("draw", "arm").agg((F.sum(F.col("s") * (F.col("t") - F.col("from"))) + F.max_by(F.col("s") * F.col("stay"), "duration") * (F.max("j") - F.max("t"))).alias("own"))
    base = one.where(F.col("arm") == reference).select(F.col("draw").alias("_draw"), F.col("own").alias("reference"))
    both = one.join(base, F.col("draw") == F.col("_draw"), "left").withColumn("delta", F.when(F.col("arm") == reference, F.lit(0.0)).otherwise(F.col("own") - F.col("reference")))
    point, drawing = F.col("draw") == 0, F.col("draw") > 0
    ends = lambda x: F.percentile(F.when(drawing, F.col(x)), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    by = both.groupBy("arm").agg(F.max(F.when(point, F.col("own"))).alias("rmst"), F.stddev_samp(F.when(drawing, F.col("own"))).alias("rmst_se"), ends("own").alias("q"), F.max(F.when(point, F.col("delta"))).alias("delta_rmst"), ends("delta").alias("dq"))
    return by.select("arm", "rmst", "rmst_se", F.col("q")[0].alias("rmst_low"), F.col("q")[1].alias("rmst_high"), "delta_rmst", F.col("dq")[0].alias("delta_low"), F.col("dq")[1].alias("delta_high"))


def reference_arm(data: DataFrame, preferred: tuple[str, ...] = REFERENCE) -> DataFrame:
    """The first preferred arm that has rows, else the least."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(a) for a in preferred)), F.col(GROUP)), F.lit(0))
    return data.where(F.col(GROUP).isNotNull()).agg(F.min_by(GROUP, F.struct((rank == 0), rank, F.col(GROUP))).alias("reference"))


def retention_table(df: DataFrame) -> DataFrame:
    data = retention_dataset(df)
    return rmst(data).withColumn("exploratory", F.col("j") < MIN_HORIZON)


def post_discharge_persistence(df: DataFrame) -> DataFrame:
    """Mentions followed past first use, against those inside the primary window."""
    every, within = retention_dataset(df, pre_use_only=False), retention_dataset(df).select(F.col("run_id").alias("r"), F.col(GROUP).alias("c")).distinct()
    rows = every.join(within, F.col("run_id").eqNullSafe(F.col("r")) & F.col(GROUP).eqNullSafe(F.col("c")), "left")
    inside = F.count("c")
    return rows.groupBy(GROUP).agg(F.count("*").alias("n_ever_mention"), inside.alias("n_in_primary_window"), (F.count("*") - inside).alias("n_post_discharge_only"), F.avg(F.col("duration").cast("double")).alias("mean_duration_unrestricted"), F.avg(F.col("event").cast("double")).alias("event_rate_unrestricted"))
