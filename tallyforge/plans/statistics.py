"""Queries of the statistical layer and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import mixed, paired, rates, resample, survival
from tallyforge.plans import frames

Z = "1.959963984540054"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c).cast("string").alias(c) if t in ("date", "timestamp", "timestamp_ntz") else F.col(c) for c, t in df.dtypes))


def on_trace(f):
    return lambda spark, sf_dir: rounded(f(frames.trace(spark, sf_dir)))


def primary(f):
    return lambda spark, sf_dir: rounded(f(rates.analysis_frame(frames.trace(spark, sf_dir))))


def on_probes(f):
    return lambda spark, sf_dir: rounded(f(frames.probes(spark, sf_dir)))


def pairs_of(df: DataFrame) -> DataFrame:
    return paired.task_pairs(df, "used", "ctrl")


def _summary(spark, sf_dir):
    """Row counts of every headline table, so that the whole bundle runs."""
    out = None
    for name, df in rates.summarize({"fact_trace": frames.trace(spark, sf_dir), "probes": frames.probes(spark, sf_dir)}).items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "rate_by_condition": primary(lambda df: rates.rate_by_condition(df, "used")),
    "rate_by_condition_given": primary(lambda df: rates.rate_by_condition(df, "used", denominator="eligible")),
    "per_task_rates": primary(lambda df: rates.per_task_rates(df, "used")),
    "read_rate_table": primary(rates.read_rate_table),
    "incidental_exposure": primary(rates.incidental_exposure),
    "mention_rate": primary(rates.mention_rate),
    "use_rate_table": primary(rates.use_rate_table),
    "funnel_table": primary(rates.funnel_table),
    "slot_precision_table": primary(rates.slot_precision_table),
    "exclusion_report": on_trace(rates.exclusion_report),
    "alarm_frame_size": on_trace(lambda df: rates.alarm_frame(df).groupBy("condition_id").agg(F.count("*").alias("n"))),
    "gate_frame_size": on_trace(lambda df: rates.gate_frame(df).groupBy("condition_id").agg(F.count("*").alias("n"))),
    "orthogonality_phi": primary(rates.orthogonality_phi),
    "backfill_orthogonality": on_trace(lambda df: rates.backfill_orthogonality(df).select("run_id", "task_id", "orthogonality_phi")),
    "confabulation_rate": on_trace(rates.confabulation_rate),
    "unexplained_possession_rate": on_trace(rates.unexplained_possession_rate),
    "accounting_census": on_trace(rates.accounting_census),
    "any_true_three_valued": on_trace(lambda df: df.groupBy("task_id").agg(rates.any_true(F.col("success")).alias("any_success"))),
    "probe_quality": on_probes(rates.probe_quality),
    "slot_class_distribution": on_probes(rates.slot_class_distribution),
    "probe_fidelity": on_probes(lambda p: rates.probe_fidelity(p, interval=False)),
    "probe_fidelity_interval": on_probes(rates.probe_fidelity),
    "paired_difference": primary(lambda df: paired.paired_difference(pairs_of(df))),
    "paired_interval": primary(lambda df: paired.with_interval(paired.paired_difference(pairs_of(df)))),
    "heterogeneity": primary(lambda df: paired.heterogeneity(pairs_of(df))),
    "cmh": primary(lambda df: paired.cmh(pairs_of(df))),
    "cmh_test": primary(lambda df: paired.cmh_test(pairs_of(df))),
    "bootstrap_mean": primary(lambda df: paired.bootstrap_mean(pairs_of(df))),
    "permutation_within_task": primary(lambda df: paired.permutation_within_task(pairs_of(df))),
    "use_lift": primary(paired.use_lift),
    "use_lift_conditional": primary(lambda df: paired.use_lift(df, denominator="eligible")),
    "depth_slopes": primary(paired.depth_slopes),
    "depth_rates_wide": primary(lambda df: rates.per_task_rates(df, "read").where("n > 0").groupBy("task_id").pivot("condition_id", ["d1", "d2", "d3"]).agg(F.first("rate"))),
    "reactivity_contrasts": primary(lambda df: paired.contrasts(df, [("d1", "d2"), ("d3", "d2-dist")], ["used", "read"])),
    "friedman": primary(lambda df: paired.friedman(df, ["d1", "d2", "d3"])),
    "calibration": primary(lambda df: paired.calibration(pairs_of(df))),
    "retention_dataset": primary(survival.retention_dataset),
    "common_horizon": primary(lambda df: survival.common_horizon(survival.retention_dataset(df))),
    "life_table": primary(lambda df: survival.life_table(survival.retention_dataset(df))),
    "km_curve": primary(lambda df: survival.km_curve(survival.retention_dataset(df))),
    "retention_table": primary(survival.retention_table),
    "mean_intervals": primary(lambda df: resample.mean_interval(df, "task_id", F.col("horizon"), by=["condition_id"], draws=500, seed=paired.SEED)),
    "uptake_models": primary(lambda df: mixed.models(df.withColumn("depth", F.when(F.col("condition_id") == "d1", 1).when(F.col("condition_id") == "d2", 2).when(F.col("condition_id") == "d3", 3)), "read", "depth")),
    "rmst_contrast": primary(lambda df: survival.rmst_contrast(survival.retention_dataset(df), reference="d1", draws=200)),
    "reference_arm": primary(lambda df: survival.reference_arm(survival.retention_dataset(df))),
    "post_discharge_persistence": primary(survival.post_discharge_persistence),
    "summarize": _summary,
}

_PRIMARY = f"WITH trace AS ({frames.TRACE}), df AS (SELECT * FROM trace WHERE coalesce(analyzable, false) AND NOT coalesce(quarantined, false) AND coalesce(prior_check_status, '') <> 'weak')"
_PROBE = f"WITH p AS ({frames.PROBES})"


def _wilson(k: str, n: str, low: str, high: str, digits: int = 6) -> str:
    mid = f"({k}::DOUBLE / {n} + {Z} * {Z} / (2.0 * {n})) / (1 + {Z} * {Z} / {n})"
    half = f"{Z} * sqrt(greatest({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) / {n} + {Z} * {Z} / (4.0 * {n} * {n}), 0)) / (1 + {Z} * {Z} / {n})"
    return f"round(CASE WHEN {n} > 0 THEN greatest(0, {mid} - {half}) END, {digits}) AS {low}, round(CASE WHEN {n} > 0 THEN least(1, {mid} + {half}) END, {digits}) AS {high}"


_TRUST = "CASE WHEN coalesce(bool_or(exposure_basis = 'manifest_canary'), false) AND NOT coalesce(bool_or(exposure_basis <> 'manifest_canary'), false) THEN 'asserted' WHEN coalesce(bool_or(exposure_basis = 'manifest_canary'), false) THEN 'mixed' ELSE 'measured' END"


def _rate(outcome: str, source: str, where: str = "true", keys: str = "condition_id") -> str:
    return f"SELECT {keys}, count({outcome}) AS n, count(*) FILTER ({outcome}) AS k, count(*) - count({outcome}) AS u, {_TRUST} AS trust FROM {source} WHERE {where} GROUP BY {keys}"


_RATE_COLUMNS = f"n, k, round(k / nullif(n, 0), 6) AS rate, {_wilson('k', 'n', 'ci_low', 'ci_high')}, u AS n_unknown, round(k / nullif(n + u, 0), 6) AS rate_lower, round((k + u) / nullif(n + u, 0), 6) AS rate_upper, trust"
_MEAN = "round(avg({0}::INT), 6)"
_GIVEN = "round(avg({0}::INT) FILTER ({1}), 6)"
_PAIRS = """tr AS (SELECT task_id, condition_id, count(used) AS n, count(*) FILTER (used) AS k FROM df GROUP BY ALL),
pairs AS (SELECT a.condition_id AS arm, a.task_id, a.n AS n1, a.k AS k1, b.n AS n0, b.k AS k0, a.k / a.n - b.k / b.n AS d FROM tr a JOIN tr b ON a.task_id = b.task_id AND b.condition_id = 'ctrl' WHERE a.condition_id <> 'ctrl' AND a.n > 0 AND b.n > 0)"""
_DIFF = "n_tasks, round(CASE WHEN n_tasks >= 2 THEN m END, 6) AS mean_diff, {sd}round(sd / sqrt(n_tasks), 6) AS se, round(CASE WHEN sd > 0 AND n_tasks >= 2 THEN m / (sd / sqrt(n_tasks)) END, 6) AS t, CASE WHEN n_tasks >= 2 THEN n_tasks - 1 END AS dof"
_DATA = """, data AS (
  SELECT run_id, task_id, condition_id, CASE WHEN cut THEN span ELSE duration END AS duration, CASE WHEN cut THEN 0 ELSE event END AS event, CASE WHEN cut THEN 'post_discharge' ELSE censor_reason END AS censor_reason FROM (
    SELECT *, coalesce(duration > span, false) AS cut FROM (
      SELECT run_id, task_id, condition_id, coalesce(lapse, horizon)::BIGINT AS duration, (lapse IS NOT NULL)::BIGINT AS event, CASE WHEN lapse IS NULL THEN coalesce(censor_reason, 'administrative') END AS censor_reason, (first_use_probe_index - first_mention_probe_index)::BIGINT AS span
      FROM df WHERE ever_mention) WHERE duration IS NOT NULL AND coalesce(span, 0) >= 0) WHERE CASE WHEN cut THEN span ELSE duration END >= 0
), times AS (SELECT condition_id, duration, sum(event)::BIGINT AS events, count(*) AS ending FROM data GROUP BY ALL),
lt AS (SELECT a.condition_id, a.duration, a.events, a.ending, sum(b.ending)::BIGINT AS at_risk FROM times a JOIN times b ON a.condition_id = b.condition_id AND b.duration >= a.duration GROUP BY ALL),
arms AS (SELECT condition_id, sum(ending)::BIGINT AS n FROM lt GROUP BY 1),
hor AS (SELECT condition_id, any_value(n) AS n, coalesce(max(duration) FILTER (at_risk / n >= 0.1), 0) AS j_arm FROM lt JOIN arms USING (condition_id) GROUP BY 1),
km AS (SELECT a.condition_id, a.duration, a.events, a.at_risk, product(1 - b.events::DOUBLE / b.at_risk) AS s, sum(CASE WHEN b.at_risk > b.events THEN b.events::DOUBLE / (b.at_risk * (b.at_risk - b.events)) END) AS green FROM lt a JOIN lt b ON a.condition_id = b.condition_id AND b.duration <= a.duration GROUP BY ALL)"""

ORACLE_SQL = {
    "rate_by_condition": f"{_PRIMARY}, r AS ({_rate('used', 'df')}) SELECT condition_id, {_RATE_COLUMNS} FROM r",
    "rate_by_condition_given": f"{_PRIMARY}, r AS ({_rate('used', 'df', 'eligible')}) SELECT condition_id, {_RATE_COLUMNS} FROM r",
    "per_task_rates": f"{_PRIMARY} SELECT task_id, condition_id, count(used) AS n, count(*) FILTER (used) AS k, {_MEAN.format('used')} AS rate, count(*) - count(used) AS n_unknown FROM df GROUP BY ALL",
    "read_rate_table": f"{_PRIMARY}, r AS (SELECT 'read' AS definition, * FROM ({_rate('read', 'df')}) UNION ALL SELECT 'read_inbound_only', * FROM ({_rate('read_inbound_only', 'df')})) SELECT condition_id, definition, {_RATE_COLUMNS} FROM r",
    "incidental_exposure": f"{_PRIMARY}, r AS (SELECT condition_id, count(*) AS n, avg(read::INT) AS rr, avg(opened::INT) AS oo, count(opened) FILTER (read) AS n_read, count(*) FILTER (read AND NOT opened) AS k FROM df GROUP BY 1) SELECT condition_id, n, round(rr, 6) AS read_rate, round(oo, 6) AS opened_rate, n_read, k AS k_read_not_opened, round(rr - oo, 6) AS incidental_rate, round(k / nullif(n_read, 0), 6) AS incidental_share, {_wilson('k', 'n_read', 'share_ci_low', 'share_ci_high')} FROM r",
    "mention_rate": f"{_PRIMARY}, q AS (SELECT * FROM df WHERE coalesce(factor_probe, true)), a AS ({_rate('ever_mention', 'q', 'read')}), b AS ({_rate('ever_mention', 'q')}) SELECT coalesce(a.condition_id, b.condition_id) AS condition_id, a.n AS n_exposed, a.k AS k_mentioned, round(a.k / nullif(a.n, 0), 6) AS mention_rate_cond, {_wilson('a.k', 'a.n', 'cond_ci_low', 'cond_ci_high')}, a.trust, b.n AS n_all, b.k AS k_all, round(b.k / nullif(b.n, 0), 6) AS mention_rate_uncond FROM a FULL JOIN b ON a.condition_id = b.condition_id",
    "use_rate_table": f"{_PRIMARY}, a AS ({_rate('used', 'df')}), b AS ({_rate('used', 'df', 'eligible')}) SELECT coalesce(a.condition_id, b.condition_id) AS condition_id, a.n AS n_uncond, a.k AS k_uncond, round(a.k / nullif(a.n, 0), 6) AS use_rate_uncond, {_wilson('a.k', 'a.n', 'uncond_ci_low', 'uncond_ci_high')}, b.n AS n_eligible, b.k AS k_cond, round(b.k / nullif(b.n, 0), 6) AS use_rate_cond, {_wilson('b.k', 'b.n', 'cond_ci_low', 'cond_ci_high')}, round(b.n / nullif(a.n, 0), 6) AS eligibility_rate, true AS appendix_only FROM a FULL JOIN b ON a.condition_id = b.condition_id",
    "funnel_table": f"{_PRIMARY} SELECT condition_id, count(*) AS n_runs, {_MEAN.format('available')} AS available, {_MEAN.format('read')} AS read, {_MEAN.format('read_inbound_only')} AS read_inbound_only, count(*) - count(read) AS n_read_unknown, {_MEAN.format('opened')} AS opened, {_MEAN.format('ever_mention')} AS ever_mention, {_GIVEN.format('ever_mention', 'read')} AS mention_given_read, {_MEAN.format('used')} AS used, {_GIVEN.format('used', 'read')} AS used_given_read, {_GIVEN.format('used', 'eligible')} AS used_given_eligible, {_MEAN.format('success')} AS success, {_TRUST} AS trust FROM df GROUP BY 1",
    "slot_precision_table": f"{_PRIMARY} SELECT condition_id, count(*) AS n, count(wrong_value_in_slot) AS n_scored, {_MEAN.format('wrong_value_in_slot')} AS wrong_value_rate, round(avg(slot_precision::DOUBLE), 6) AS slot_precision_mean, max(factor_distractors)::BIGINT AS distractors FROM df GROUP BY 1",
    "exclusion_report": f"WITH trace AS ({frames.TRACE}) SELECT CASE WHEN analyzable IS NOT TRUE THEN 'not_analyzable' WHEN quarantined THEN 'quarantined' WHEN prior_check_status = 'weak' THEN 'weak_fact_prior_check' ELSE '_kept' END AS reason, count(*) AS n FROM trace GROUP BY 1",
    "alarm_frame_size": f"WITH trace AS ({frames.TRACE}) SELECT condition_id, count(*) AS n FROM trace WHERE analyzable GROUP BY 1",
    "gate_frame_size": f"WITH trace AS ({frames.TRACE}) SELECT condition_id, count(*) AS n FROM trace WHERE analyzable IS NOT FALSE AND quarantined IS NOT TRUE AND coalesce(prior_check_status, '') <> 'weak' GROUP BY 1",
    "orthogonality_phi": f"{_PRIMARY}, q AS (SELECT task_id, count(*) FILTER (used IS NOT NULL AND success IS NOT NULL) AS n, round(corr(used::INT, success::INT) FILTER (used IS NOT NULL AND success IS NOT NULL), 6) + 0.0 AS phi FROM df GROUP BY 1) SELECT task_id, n, CASE WHEN isnan(phi) THEN NULL ELSE phi END AS phi, coalesce(abs(CASE WHEN isnan(phi) THEN NULL ELSE phi END) > 0.8, false) AS breach FROM q",
    "backfill_orthogonality": f"WITH trace AS ({frames.TRACE}) SELECT run_id, task_id, round(corr(used::INT, success::INT) FILTER (used IS NOT NULL AND success IS NOT NULL) OVER (PARTITION BY task_id), 6) + 0.0 AS orthogonality_phi FROM trace",
    "confabulation_rate": f"WITH trace AS ({frames.TRACE}), a AS (SELECT count(*) AS n, count(*) FILTER (ever_mention) AS k, count(*) FILTER (echoed IS NOT TRUE) AS gn, count(*) FILTER (echoed IS NOT TRUE AND ever_mention) AS gk FROM trace WHERE analyzable AND read = false) SELECT n, k, round(k / nullif(n, 0), 6) AS rate, {_wilson('k', 'n', 'ci_low', 'ci_high')}, gn AS gate_n, gk AS gate_k, round(gk / nullif(gn, 0), 6) AS gate_rate, {_wilson('gk', 'gn', 'gate_ci_low', 'gate_ci_high')}, coalesce(k / nullif(n, 0) > 0.05, false) AS breach FROM a",
    "unexplained_possession_rate": f"WITH trace AS ({frames.TRACE}), a AS (SELECT count(unexplained_possession) AS n, count(*) FILTER (unexplained_possession) AS k FROM trace WHERE analyzable) SELECT n, k, round(k / nullif(n, 0), 6) AS rate, {_wilson('k', 'n', 'ci_low', 'ci_high')}, coalesce(k / nullif(n, 0) > 0.05, false) AS breach FROM a",
    "accounting_census": f"WITH trace AS ({frames.TRACE}) SELECT coalesce(accounting_version, 'unset') AS version, count(*) AS n FROM trace GROUP BY 1",
    "any_true_three_valued": f"WITH trace AS ({frames.TRACE}) SELECT task_id, bool_or(success) AS any_success FROM trace GROUP BY 1",
    "probe_quality": f"{_PROBE} SELECT condition_id, count(*) AS n_probes, round(avg(coalesce(parse_ok, false)::INT), 6) AS parse_ok_rate, {', '.join(f'count(*) FILTER (parse_tier = {t!r}) AS n_{t}' for t in ('strict', 'lenient', 'failed'))}, {', '.join(f'count(*) FILTER (outcome = {o!r}) AS n_{o}' for o in ('answered', 'superseded', 'unanswered', 'refused'))}, round(avg(coalesce(retry_sent, false)::INT), 6) AS retry_rate FROM p GROUP BY 1",
    "slot_class_distribution": f"{_PROBE}, s AS (SELECT condition_id, count(*) AS n_probes, {', '.join(f'sum(n_{c}_slots)::BIGINT AS n_{c}_slots' for c in rates.SLOT_CLASSES)} FROM p GROUP BY 1), t AS (SELECT *, {' + '.join(f'coalesce(n_{c}_slots, 0)' for c in rates.SLOT_CLASSES)} AS total FROM s) SELECT * EXCLUDE (total), {', '.join(f'round(n_{c}_slots / nullif(total, 0), 6) AS share_{c}_slots' for c in rates.SLOT_CLASSES)} FROM t",
    "probe_fidelity": f"{_PROBE}, t AS (SELECT condition_id, task_id, count(*) AS n, count(*) FILTER (fidelity_agree) AS k FROM p WHERE fidelity_agree IS NOT NULL GROUP BY ALL), a AS (SELECT condition_id, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k, count(*) AS n_tasks, avg(k / n) AS m, stddev_samp(k / n) AS s FROM t GROUP BY 1) SELECT condition_id, n AS n_probes, round(k / n, 6) AS fidelity_probe_level, {_wilson('k', 'n', 'probe_ci_low', 'probe_ci_high')}, n_tasks, round(m, 6) AS fidelity_task_mean, round(s, 6) AS sd FROM a",
    "paired_difference": f"{_PRIMARY}, {_PAIRS}, a AS (SELECT arm, count(*) AS n_tasks, avg(d) AS m, stddev_samp(d) AS sd FROM pairs GROUP BY 1) SELECT arm, {_DIFF.format(sd='round(sd, 6) AS sd, ')} FROM a",
    "heterogeneity": f"{_PRIMARY}, {_PAIRS}, y AS (SELECT arm, ln((k1 + .5) * (n0 - k0 + .5) / ((n1 - k1 + .5) * (k0 + .5)))::DOUBLE AS y, 1.0::DOUBLE / (1 / (k1 + .5)::DOUBLE + 1 / (n1 - k1 + .5)::DOUBLE + 1 / (k0 + .5)::DOUBLE + 1 / (n0 - k0 + .5)::DOUBLE) AS w FROM pairs), m AS (SELECT arm, sum(w * y) / sum(w) AS mu FROM y GROUP BY 1), q AS (SELECT arm, count(*) AS k, sum(w * (y - mu) * (y - mu)) AS q, sum(w) - sum(w * w) / sum(w) AS c FROM y JOIN m USING (arm) GROUP BY 1) SELECT arm, k AS n_tasks, round(sqrt(greatest(0, q - (k - 1)) / c), 6) AS gamma_hat, round(q, 6) AS q, round(greatest(0, q - (k - 1)) / q, 6) AS i2 FROM q",
    "cmh": f"{_PRIMARY}, {_PAIRS}, s AS (SELECT arm, k1::DOUBLE AS a, (n1 - k1)::DOUBLE AS b, k0::DOUBLE AS c, (n0 - k0)::DOUBLE AS d, (n1 + n0)::DOUBLE AS n FROM pairs WHERE n1 + n0 >= 2), g AS (SELECT arm, count(*) AS n_strata, sum(a - (a + b) * (a + c) / n) AS num, sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))) AS den, sum(a * d / n) AS ad, sum(b * c / n) AS bc FROM s GROUP BY 1) SELECT arm, n_strata, round(CASE WHEN den > 0 THEN CASE WHEN abs(num) > 0.5 THEN (abs(num) - 0.5) * (abs(num) - 0.5) / den ELSE 0 END END, 6) AS chi2, round(ad / nullif(bc, 0), 6) AS odds_ratio FROM g",
    "depth_slopes": f"{_PRIMARY}, r AS (SELECT task_id, CASE condition_id WHEN 'd1' THEN 1 WHEN 'd2' THEN 2 ELSE 3 END AS x, avg(read::INT) AS y FROM df WHERE condition_id IN ('d1', 'd2', 'd3') AND read IS NOT NULL GROUP BY ALL), s AS (SELECT task_id, regr_slope(y, x) AS d FROM r GROUP BY 1 HAVING count(DISTINCT x) >= 2), a AS (SELECT count(d) AS n_tasks, avg(d) AS m, stddev_samp(d) AS sd FROM s) SELECT {_DIFF.format(sd='round(sd, 6) AS sd, ')} FROM a",
    "depth_rates_wide": f"{_PRIMARY} SELECT task_id, {', '.join(f'round(avg(read::INT) FILTER (condition_id = {a!r}), 6) AS {a}' for a in ('d1', 'd2', 'd3'))} FROM df WHERE read IS NOT NULL GROUP BY 1",
    "friedman": f"""{_PRIMARY}, r AS (SELECT task_id, condition_id, round(avg(used::INT), 12) AS y FROM df WHERE condition_id IN ('d1', 'd2', 'd3') AND used IS NOT NULL GROUP BY ALL), f AS (SELECT * FROM r WHERE task_id IN (SELECT task_id FROM r GROUP BY 1 HAVING count(*) = 3)),
k AS (SELECT a.task_id, a.condition_id, (SELECT count(*) FILTER (b.y < a.y) + (count(*) FILTER (b.y = a.y) + 1) / 2.0 FROM f b WHERE b.task_id = a.task_id) AS r, (SELECT count(*) FILTER (b.y = a.y) FROM f b WHERE b.task_id = a.task_id) AS ties FROM f a),
s AS (SELECT condition_id, sum(r)::DOUBLE AS s, count(*) AS n, sum(ties * ties - 1)::DOUBLE AS tied FROM k GROUP BY 1)
SELECT max(n) AS n_tasks, round((12.0::DOUBLE / (max(n) * 12) * sum(s * s) - 12 * max(n)) / (1 - sum(tied) / (max(n) * 24.0)), 6) AS statistic, 2::BIGINT AS dof FROM s""",
    "calibration": f"{_PRIMARY}, {_PAIRS} SELECT arm, round(sum(k0) / sum(n0), 6) AS p0, round(stddev_samp(ln(((k0 + .5) / (n0 - k0 + .5))::DOUBLE)), 6) AS tau, count(*) AS n_tasks FROM pairs GROUP BY 1",
    "retention_dataset": f"{_PRIMARY}{_DATA} SELECT * FROM data",
    "common_horizon": f"{_PRIMARY}{_DATA} SELECT condition_id, n, j_arm, (SELECT min(j_arm) FROM hor) AS j FROM hor",
    "life_table": f"{_PRIMARY}{_DATA} SELECT * FROM lt",
    "km_curve": f"{_PRIMARY}{_DATA} SELECT condition_id, duration, events, at_risk, round(s, 6) AS survival, round(CASE WHEN s >= 1 THEN 1 WHEN s <= 0 THEN 0 ELSE exp(-exp(ln(-ln(s)) + {Z} * sqrt(green) / abs(ln(s)))) END, 6) AS band_low, round(CASE WHEN s >= 1 THEN 1 WHEN s <= 0 THEN 0 ELSE exp(-exp(ln(-ln(s)) - {Z} * sqrt(green) / abs(ln(s)))) END, 6) AS band_high FROM km",
    "retention_table": f"""{_PRIMARY}{_DATA}, j AS (SELECT min(j_arm) AS j FROM hor), steps AS (SELECT condition_id, duration, s, coalesce(lead(duration) OVER (PARTITION BY condition_id ORDER BY duration), (SELECT j FROM j)) AS until FROM km WHERE events > 0 AND duration <= (SELECT j FROM j)),
area AS (SELECT condition_id, sum(s * (until - duration)) + min(duration) AS a FROM steps GROUP BY 1), sp AS (SELECT condition_id, stddev_samp(duration::DOUBLE) AS sd, sum(event)::BIGINT AS ne FROM data GROUP BY 1)
SELECT condition_id, n, j_arm, (SELECT j FROM j) AS j, round(coalesce(a, (SELECT j FROM j)::DOUBLE), 6) AS rmst, round(sd, 6) AS duration_sd, ne AS n_events, (SELECT j FROM j) < 3 AS exploratory FROM hor LEFT JOIN area USING (condition_id) LEFT JOIN sp USING (condition_id)""",
    "reference_arm": f"{_PRIMARY}{_DATA} SELECT coalesce(min(condition_id) FILTER (condition_id IN ('d1', 'd2', 'd3')), min(condition_id)) AS reference FROM data",
    "post_discharge_persistence": f"""{_PRIMARY}{_DATA}, every AS (SELECT run_id, condition_id, coalesce(lapse, horizon) AS duration, (lapse IS NOT NULL)::INT AS event FROM df WHERE ever_mention AND coalesce(lapse, horizon) >= 0)
SELECT condition_id, count(*) AS n_ever_mention, count(*) FILTER (EXISTS (SELECT 1 FROM data d WHERE d.run_id = every.run_id AND d.condition_id = every.condition_id)) AS n_in_primary_window, count(*) FILTER (NOT EXISTS (SELECT 1 FROM data d WHERE d.run_id = every.run_id AND d.condition_id = every.condition_id)) AS n_post_discharge_only, round(avg(duration::DOUBLE), 6) AS mean_duration_unrestricted, round(avg(event::DOUBLE), 6) AS event_rate_unrestricted FROM every GROUP BY 1""",
}


def _contrast(arm: str, reference: str, outcome: str) -> str:
    rates_ = f"tr AS (SELECT task_id, condition_id, count({outcome}) AS n, count(*) FILTER ({outcome}) AS k FROM df GROUP BY ALL)"
    pairs = f"pairs AS (SELECT a.k / a.n - b.k / b.n AS d FROM tr a JOIN tr b ON a.task_id = b.task_id AND b.condition_id = '{reference}' WHERE a.condition_id = '{arm}' AND a.n > 0 AND b.n > 0)"
    return f"SELECT '{arm}' AS arm, '{reference}' AS reference, '{outcome}' AS outcome, {_DIFF.format(sd='')} FROM ({_PRIMARY}, {rates_}, {pairs} SELECT count(*) AS n_tasks, avg(d) AS m, stddev_samp(d) AS sd FROM pairs)"


ORACLE_SQL["reactivity_contrasts"] = " UNION ALL ".join(_contrast(a, r, o) for a, r in (("d1", "d2"), ("d3", "d2-dist")) for o in ("used", "read"))
_BUNDLE = {"exclusions": "exclusion_report", "funnel": "funnel_table", "read_rate": "read_rate_table", "incidental_exposure": "incidental_exposure", "mention_rate": "mention_rate", "use_rate_appendix": "use_rate_table", "use_lift": "paired_difference", "confab_rate": "confabulation_rate", "unexplained_possession": "unexplained_possession_rate", "orthogonality_phi": "orthogonality_phi", "slot_precision": "slot_precision_table", "retention": "retention_table", "depth": "depth_slopes", "probe_fidelity": "probe_fidelity", "probe_quality": "probe_quality", "slot_classes": "slot_class_distribution"}
_CONDITIONAL = _PAIRS.replace("FROM df GROUP", "FROM df WHERE eligible GROUP")
ORACLE_SQL["summarize"] = " UNION ALL ".join([*(f"SELECT '{n}' AS name, count(*) AS n FROM ({ORACLE_SQL[q]})" for n, q in _BUNDLE.items()), f"SELECT 'use_lift_conditional', count(*) FROM ({_PRIMARY}, {_CONDITIONAL} SELECT DISTINCT arm FROM pairs)", "SELECT 'counts', 1"])
