"""Rates over nullable outcomes: null is unknown, never false.

Every table is one wide conditional aggregate: partial sums meet in one shuffle
whose rows are the groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.dist import t_critical, wilson

GROUP = "condition_id"


def rate(x: Column) -> Column:
    """Mean of a nullable flag over its known values."""
    return F.avg(x.cast("int"))


def count_true(x: Column) -> Column:
    return F.count_if(F.coalesce(x, F.lit(False)))


def any_true(x: Column) -> Column:
    """Three-valued OR over rows: true, else false if any is false, else null."""
    return F.bool_or(x)


def any_true_of(values: Column) -> Column:
    """Three-valued OR over an array; empty is null."""
    return F.when(F.exists(values, lambda v: v.eqNullSafe(F.lit(True))), True).when(F.exists(values, lambda v: v.eqNullSafe(F.lit(False))), False)


def drop_reason() -> Column:
    """Why the primary analysis leaves a row out; the first that holds. Unknown analyzable drops, unknown quarantine keeps."""
    return F.when(~F.coalesce(F.col("analyzable"), F.lit(False)), "not_analyzable").when(F.coalesce(F.col("quarantined"), F.lit(False)), "quarantined").when(F.coalesce(F.col("prior_check_status") == "weak", F.lit(False)), "weak_fact_prior_check")


def analysis_frame(df: DataFrame) -> DataFrame:
    return df.where(drop_reason().isNull())


def exclusion_report(df: DataFrame) -> DataFrame:
    """(reason, n), with the rows kept as _kept."""
    return df.groupBy(F.coalesce(drop_reason(), F.lit("_kept")).alias("reason")).agg(F.count("*").alias("n"))


def alarm_frame(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("analyzable", F.lit(False)))


def in_gate_frame(*, keep_quarantined: bool = False, keep_weak: bool = False) -> Column:
    """Rows for gates: unknown analyzable is kept here."""
    out = ~F.col("analyzable").eqNullSafe(F.lit(False))
    if not keep_quarantined:
        out = out & ~F.col("quarantined").eqNullSafe(F.lit(True))
    return out if keep_weak else out & ~F.col("prior_check_status").eqNullSafe(F.lit("weak"))


def gate_frame(df: DataFrame, **keep: bool) -> DataFrame:
    return df.where(in_gate_frame(**keep))


def trust_of(basis: Column) -> Column:
    """Whether exposure was asserted by a manifest, measured, or both."""
    asserted, other = F.max((basis == "manifest_canary").cast("int")), F.max((basis != "manifest_canary").cast("int"))
    return F.when(asserted.eqNullSafe(F.lit(1)) & ~other.eqNullSafe(F.lit(1)), "asserted").when(asserted.eqNullSafe(F.lit(1)), "mixed").otherwise("measured")


def rate_by_condition(df: DataFrame, outcome: str, *, denominator: str | None = None, group: str = GROUP, alpha: float = 0.05) -> DataFrame:
    """Known rows, successes, rate with Wilson interval, and the rates if all unknowns failed or succeeded."""
    if denominator:
        df = df.where(F.coalesce(F.col(denominator), F.lit(False)))
    x = F.col(outcome)
    basis = trust_of(F.col("exposure_basis")) if "exposure_basis" in df.columns else F.lit("measured")
    out = df.groupBy(group).agg(F.count(x).alias("n"), count_true(x).alias("k"), (F.count("*") - F.count(x)).alias("n_unknown"), basis.alias("trust"))
    n, k, u = F.col("n"), F.col("k"), F.col("n_unknown")
    low, high = wilson(k, n, alpha)
    return out.select(group, "n", "k", F.try_divide(k, n).alias("rate"), low.alias("ci_low"), high.alias("ci_high"), "n_unknown", F.try_divide(k, n + u).alias("rate_lower"), F.try_divide(k + u, n + u).alias("rate_upper"), "trust")


def per_task_rates(df: DataFrame, outcome: str, *, denominator: str | None = None, group: str = GROUP) -> DataFrame:
    if denominator:
        df = df.where(F.coalesce(F.col(denominator), F.lit(False)))
    x = F.col(outcome)
    return df.groupBy("task_id", group).agg(F.count(x).alias("n"), count_true(x).alias("k"), rate(x).alias("rate"), (F.count("*") - F.count(x)).alias("n_unknown"))


def read_rate_table(df: DataFrame, definitions: tuple[str, ...] = ("read", "read_inbound_only")) -> DataFrame:
    """Rates of several definitions, stacked, from one pass over the rows."""
    wide = df.select("*", F.explode(F.array(*(F.struct(F.lit(d).alias("definition"), F.col(d).alias("outcome")) for d in definitions))).alias("pair"))
    wide = wide.withColumn("arm", F.struct(F.col(GROUP), F.col("pair.definition"))).withColumn("outcome", F.col("pair.outcome"))
    out = rate_by_condition(wide, "outcome", group="arm")
    return out.select(f"arm.{GROUP}", "arm.definition", *(c for c in out.columns if c != "arm"))


def incidental_exposure(df: DataFrame, read: str = "read", opened: str = "opened") -> DataFrame:
    """Read but not opened: as a difference of rates and as a share of what was read."""
    r, o = F.col(read), F.col(opened)
    seen = F.coalesce(r, F.lit(False))
    out = df.groupBy(GROUP).agg(F.count("*").alias("n"), rate(r).alias("read_rate"), rate(o).alias("opened_rate"), F.count(F.when(seen, o)).alias("n_read"), F.count_if(seen & ~F.coalesce(o, F.lit(True))).alias("k_read_not_opened"))
    low, high = wilson(F.col("k_read_not_opened"), F.col("n_read"))
    return out.select("*", (F.col("read_rate") - F.col("opened_rate")).alias("incidental_rate"), F.try_divide("k_read_not_opened", "n_read").alias("incidental_share"), low.alias("share_ci_low"), high.alias("share_ci_high"))


def mention_rate(df: DataFrame, read: str = "read") -> DataFrame:
    """Mentions among the exposed and among all, where there were probes; arms on either side are kept."""
    df = df.where(F.coalesce("factor_probe", F.lit(True)))
    given = rate_by_condition(df, "ever_mention", denominator=read).select(F.col(GROUP), F.col("n").alias("n_exposed"), F.col("k").alias("k_mentioned"), F.col("rate").alias("mention_rate_cond"), F.col("ci_low").alias("cond_ci_low"), F.col("ci_high").alias("cond_ci_high"), "trust")
    every = rate_by_condition(df, "ever_mention").select(F.col(GROUP), F.col("n").alias("n_all"), F.col("k").alias("k_all"), F.col("rate").alias("mention_rate_uncond"))
    return given.join(every, GROUP, "full_outer")


def use_rate_table(df: DataFrame) -> DataFrame:
    """Use among all and among the eligible, and how many were eligible."""
    every = rate_by_condition(df, "used").select(F.col(GROUP), F.col("n").alias("n_uncond"), F.col("k").alias("k_uncond"), F.col("rate").alias("use_rate_uncond"), F.col("ci_low").alias("uncond_ci_low"), F.col("ci_high").alias("uncond_ci_high"))
    given = rate_by_condition(df, "used", denominator="eligible").select(F.col(GROUP), F.col("n").alias("n_eligible"), F.col("k").alias("k_cond"), F.col("rate").alias("use_rate_cond"), F.col("ci_low").alias("cond_ci_low"), F.col("ci_high").alias("cond_ci_high"))
    return every.join(given, GROUP, "full_outer").withColumn("eligibility_rate", F.try_divide("n_eligible", "n_uncond")).withColumn("appendix_only", F.lit(True))


def funnel_table(df: DataFrame) -> DataFrame:
    """Available, read, used, kept: ten rates an arm."""

    def given(x: str, when: str) -> Column:
        return rate(F.when(F.coalesce(F.col(when), F.lit(False)), F.col(x)))

    return df.groupBy(GROUP).agg(
        F.count("*").alias("n_runs"), rate(F.col("available")).alias("available"), rate(F.col("read")).alias("read"), rate(F.col("read_inbound_only")).alias("read_inbound_only"),
        (F.count("*") - F.count("read")).alias("n_read_unknown"), rate(F.col("opened")).alias("opened"), rate(F.col("ever_mention")).alias("ever_mention"), given("ever_mention", "read").alias("mention_given_read"),
        rate(F.col("used")).alias("used"), given("used", "read").alias("used_given_read"), given("used", "eligible").alias("used_given_eligible"), rate(F.col("success")).alias("success"), trust_of(F.col("exposure_basis")).alias("trust"),
    )


def slot_precision_table(df: DataFrame) -> DataFrame:
    return df.groupBy(GROUP).agg(F.count("*").alias("n"), F.count("wrong_value_in_slot").alias("n_scored"), rate(F.col("wrong_value_in_slot")).alias("wrong_value_rate"), F.avg("slot_precision").alias("slot_precision_mean"), F.max("factor_distractors").alias("distractors"))


def probe_quality(probes: DataFrame) -> DataFrame:
    tiers, outcomes = ("strict", "lenient", "failed"), ("answered", "superseded", "unanswered", "refused")
    return probes.groupBy(GROUP).agg(
        F.count("*").alias("n_probes"), F.avg(F.coalesce("parse_ok", F.lit(False)).cast("int")).alias("parse_ok_rate"),
        *(count_true(F.col("parse_tier") == t).alias(f"n_{t}") for t in tiers), *(count_true(F.col("outcome") == o).alias(f"n_{o}") for o in outcomes),
        F.avg(F.coalesce("retry_sent", F.lit(False)).cast("int")).alias("retry_rate"),
    )


SLOT_CLASSES = ("critical_fact", "task_restatement", "generic_workspace", "filler", "empty", "distrusted")


def slot_class_distribution(probes: DataFrame) -> DataFrame:
    """Slots of each class and their share of all slots of the arm."""
    out = probes.groupBy(GROUP).agg(*(F.sum(f"n_{c}_slots").alias(f"n_{c}_slots") for c in SLOT_CLASSES), F.count("*").alias("n_probes"))
    total = sum((F.coalesce(F.col(f"n_{c}_slots"), F.lit(0)) for c in SLOT_CLASSES), F.lit(0))
    return out.select("*", *(F.try_divide(F.col(f"n_{c}_slots"), F.nullif(total, F.lit(0))).alias(f"share_{c}_slots") for c in SLOT_CLASSES))


def probe_fidelity(probes: DataFrame, *, min_tasks: int = 2, alpha: float = 0.05, interval: bool = True) -> DataFrame:
    """Agreement of what was announced with what came next, by probe and by task."""
    known = probes.where(F.col("fidelity_agree").isNotNull())
    tasks = known.groupBy(GROUP, "task_id").agg(F.count("*").alias("n"), count_true(F.col("fidelity_agree")).alias("k"))
    out = tasks.groupBy(GROUP).agg(F.sum("n").alias("n_probes"), F.sum("k").alias("k"), F.count_if(F.col("task_id").isNotNull()).alias("n_tasks"), F.avg(F.when(F.col("task_id").isNotNull(), F.col("k") / F.col("n"))).alias("fidelity_task_mean"), F.stddev_samp(F.when(F.col("task_id").isNotNull(), F.col("k") / F.col("n"))).alias("sd"))
    low, high = wilson(F.col("k"), F.col("n_probes"), alpha)
    out = out.select(GROUP, "n_probes", F.try_divide("k", "n_probes").alias("fidelity_probe_level"), low.alias("probe_ci_low"), high.alias("probe_ci_high"), "n_tasks", "fidelity_task_mean", "sd")
    if not interval:
        return out
    half = F.when(F.col("n_tasks") >= min_tasks, t_critical(F.lit(1 - alpha / 2), F.col("n_tasks") - 1) * F.col("sd") / F.sqrt("n_tasks"))
    return out.withColumn("ci_low", F.col("fidelity_task_mean") - half).withColumn("ci_high", F.col("fidelity_task_mean") + half).drop("sd")


def phi(a: Column, b: Column) -> Column:
    """Correlation of two nullable flags from their 2x2 table; null without two rows or with an empty margin."""
    n11, n00, n10, n01 = (F.count_if(F.coalesce(x, F.lit(False))).cast("double") for x in (a & b, ~a & ~b, a & ~b, ~a & b))
    return F.when(n11 + n00 + n10 + n01 >= 2, F.try_divide(n11 * n00 - n10 * n01, F.sqrt((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00))))


def orthogonality_phi(df: DataFrame, *, a: str = "used", b: str = "success", limit: float = 0.8) -> DataFrame:
    out = df.groupBy("task_id").agg(F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"), phi(F.col(a), F.col(b)).alias("phi"))
    return out.withColumn("breach", F.coalesce(F.abs("phi") > limit, F.lit(False)))


def backfill_orthogonality(df: DataFrame, *, a: str = "used", b: str = "success") -> DataFrame:
    """Every row with its task's phi; rows without a task are one group. The tasks' table is joined, so no task's rows meet in one window."""
    by = df.groupBy(F.col("task_id").alias("of_task")).agg(phi(F.col(a), F.col(b)).alias("orthogonality_phi"))
    return df.join(by, F.col("task_id").eqNullSafe(F.col("of_task"))).drop("of_task")


def confabulation_rate(df: DataFrame, read: str = "read", threshold: float = 0.05) -> DataFrame:
    """Mentions among the surely unread of the alarm frame; and among those of them without an echo."""
    unread = alarm_frame(df).where(~F.coalesce(F.col(read), F.lit(True)))
    clear = ~F.coalesce(F.col("echoed"), F.lit(False))
    out = unread.agg(F.count("*").alias("n"), count_true(F.col("ever_mention")).alias("k"), F.count_if(clear).alias("gate_n"), F.count_if(clear & F.coalesce("ever_mention", F.lit(False))).alias("gate_k"))
    (low, high), (glow, ghigh) = wilson(F.col("k"), F.col("n")), wilson(F.col("gate_k"), F.col("gate_n"))
    return out.select("n", "k", F.try_divide("k", "n").alias("rate"), low.alias("ci_low"), high.alias("ci_high"), "gate_n", "gate_k", F.try_divide("gate_k", "gate_n").alias("gate_rate"), glow.alias("gate_ci_low"), ghigh.alias("gate_ci_high"), F.coalesce(F.try_divide("k", "n") > threshold, F.lit(False)).alias("breach"))


def unexplained_possession_rate(df: DataFrame, threshold: float = 0.05) -> DataFrame:
    x = F.col("unexplained_possession")
    out = alarm_frame(df).agg(F.count(x).alias("n"), count_true(x).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return out.select("n", "k", F.try_divide("k", "n").alias("rate"), low.alias("ci_low"), high.alias("ci_high"), F.coalesce(F.try_divide("k", "n") > threshold, F.lit(False)).alias("breach"))


def accounting_census(df: DataFrame, version: str = "accounting_version") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(version), F.lit("unset")).alias("version")).agg(F.count("*").alias("n"))


def summarize(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every headline table, as plans; none runs until it is used."""
    from tallyforge.operators import paired, survival

    trace = tables["fact_trace"]
    df = analysis_frame(trace)
    out = {
        "exclusions": exclusion_report(trace), "funnel": funnel_table(df), "read_rate": read_rate_table(df), "incidental_exposure": incidental_exposure(df), "mention_rate": mention_rate(df),
        "use_rate_appendix": use_rate_table(df), "use_lift": paired.use_lift(df), "use_lift_conditional": paired.use_lift(df, denominator="eligible"), "confab_rate": confabulation_rate(trace),
        "unexplained_possession": unexplained_possession_rate(trace), "orthogonality_phi": orthogonality_phi(df), "slot_precision": slot_precision_table(df), "retention": survival.retention_table(df),
        "depth": paired.depth_slopes(df), "counts": df.agg(F.countDistinct("run_id").alias("n_runs"), F.countDistinct("task_id").alias("n_tasks"), F.countDistinct(GROUP).alias("n_arms")),
    }
    if "probes" in tables:
        p = tables["probes"]
        out |= {"probe_fidelity": probe_fidelity(p), "probe_quality": probe_quality(p), "slot_classes": slot_class_distribution(p)}
    return out
