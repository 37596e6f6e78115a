"""Forecasts, anomalies, tests, distributions, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywing.operators import behavior, isolation, people, prompts, segments, series, stats, usage
from tallywing.plans.people_queries import ENGAGEMENT, GAPS
from tallywing.plans.registry import EMP, Catalogue, Inputs, M, R
from tallywing.plans.usage_queries import DAILY

CASES = Catalogue()


def _shorten(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- series -----------------------------------------------------------------------


def _forecast_sql(value: str, source: str, keys: str = "", null: str = "NULL::double") -> str:
    """Closed-form quadratic fit, written over raw moments of the day number."""
    part = f"PARTITION BY {keys}" if keys else ""
    group, lead = (f"GROUP BY {keys}", f"{keys},") if keys else ("", "")
    on = f"USING ({keys})" if keys else "ON true"
    return f"""
    WITH src AS ({source}),
    d0 AS (SELECT {lead} date, {value}, {value}::double AS y,
                  (date - min(date) OVER ({part}))::bigint AS t FROM src),
    c AS (SELECT {lead} avg(t) AS c FROM d0 {group}),
    d AS (SELECT d0.*, t - c.c AS u, (t - c.c) * (t - c.c) AS q FROM d0 JOIN c {on}),
    f AS (SELECT {lead} var_pop(u) AS su, var_pop(q) AS sq, covar_pop(u, q) AS suq,
                 covar_pop(u, y) AS suy, covar_pop(q, y) AS sqy, avg(u) AS mu, avg(q) AS mq,
                 avg(y) AS my, max(date) AS last, max(t) AS tail FROM d {group}),
    b AS (SELECT *, (suy * sq - sqy * suq) / (su * sq - suq * suq) AS b1,
                 (sqy * su - suy * suq) / (su * sq - suq * suq) AS b2 FROM f),
    k AS (SELECT *, my - b1 * mu - b2 * mq AS b0 FROM b),
    h AS (SELECT d.*, k.b0 + k.b1 * d.u + k.b2 * d.q AS predicted FROM d JOIN k {on}),
    s AS (SELECT {lead} stddev_pop(y - predicted) AS sigma FROM h {group}),
    g AS (SELECT k.*, s.sigma, c.c, i.i,
                 k.b0 + k.b1 * (k.tail + i.i - c.c) + k.b2 * (k.tail + i.i - c.c) ** 2 AS p
          FROM k JOIN s {on} JOIN c {on}, range(1, 15) i(i))
    SELECT {lead} date, {value}, round(predicted, 4) AS predicted, CAST(t AS int) AS day_num,
           false AS is_forecast, NULL::double AS lower_95, NULL::double AS upper_95 FROM h
    UNION ALL
    SELECT {lead} CAST(last + CAST(i AS int) AS date), {null}, round(p, 4),
           CAST(tail + i AS int), true, round(greatest(0, p - 1.96 * sigma), 4),
           round(p + 1.96 * sigma, 4) FROM g"""


FIT = ["predicted", "lower_95", "upper_95"]

CASES.add("forecast_daily_cost",
          lambda i: _shorten(series.forecast(usage.daily_activity(i.wh), "cost_usd"), *FIT),
          _forecast_sql("cost_usd", DAILY))
CASES.add("forecast_daily_sessions",
          lambda i: _shorten(series.forecast(usage.daily_activity(i.wh), "sessions"), *FIT),
          _forecast_sql("sessions", DAILY, null="NULL::bigint"))


def _order_days(i: Inputs) -> DataFrame:
    return i.parquet("orders").groupBy(
        "o_orderpriority", F.to_date("o_orderdate").alias("date")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("sales"))


ORDER_DAYS = """SELECT o_orderpriority, CAST(o_orderdate AS date) AS date,
    CAST(sum(CAST(o_totalprice AS decimal(18,2))) AS double) AS sales FROM orders GROUP BY 1, 2"""

# Totals per priority are large, so the band of this one is compared to whole units.
CASES.add("forecast_by_key",
          lambda i: _shorten(series.forecast(_order_days(i), "sales", keys=["o_orderpriority"]),
                             *FIT, digits=1),
          plain=_forecast_sql("sales", ORDER_DAYS, "o_orderpriority").replace(", 4)", ", 1)"))


def _anomaly_sql(source: str, value: str, frame: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""
    WITH src AS ({source}),
    w AS (SELECT *, count({value}) OVER f AS n, avg({value}::double) OVER f AS m,
                 stddev_samp({value}::double) OVER f AS s
          FROM src WINDOW f AS ({part} ORDER BY date ROWS BETWEEN {frame})),
    z AS (SELECT * EXCLUDE (n, m, s), CASE WHEN n >= 3 THEN m END AS rolling_mean,
                 CASE WHEN n >= 3 THEN s END AS rolling_std FROM w),
    q AS (SELECT *, ({value} - rolling_mean) / (rolling_std + 1e-9) AS z_score FROM z)
    SELECT * REPLACE (round(rolling_mean, 4) AS rolling_mean, round(rolling_std, 4) AS rolling_std,
                      round(z_score, 4) AS z_score),
           coalesce(abs(z_score) > 2.5, false) AS is_anomaly,
           CASE WHEN z_score > 0 THEN 'Spike' ELSE 'Dip' END AS anomaly_direction FROM q"""


ROLLING = ["rolling_mean", "rolling_std", "z_score"]

CASES.add("detect_daily_cost_anomalies",
          lambda i: _shorten(series.rolling_anomalies(usage.daily_activity(i.wh), "cost_usd"),
                             *ROLLING),
          _anomaly_sql(DAILY, "cost_usd", "6 PRECEDING AND CURRENT ROW"))
CASES.add("detect_daily_cost_anomalies_excluding_today",
          lambda i: _shorten(series.rolling_anomalies(
              usage.daily_activity(i.wh), "cost_usd", exclude_current=True), *ROLLING),
          _anomaly_sql(DAILY, "cost_usd", "7 PRECEDING AND 1 PRECEDING"))
CASES.add("rolling_anomalies_by_key",
          lambda i: _shorten(series.rolling_anomalies(
              _order_days(i), "sales", ["o_orderpriority"], exclude_current=True), *ROLLING,
              digits=2),
          plain=_anomaly_sql(ORDER_DAYS, "sales", "7 PRECEDING AND 1 PRECEDING",
                             "o_orderpriority").replace(", 4)", ", 2)"))

PARTS = f"""
    src AS ({DAILY}),
    t AS (SELECT date, cost_usd AS actual, CASE WHEN count(*) OVER f >= 4
            THEN avg(cost_usd) OVER f END AS trend
          FROM src WINDOW f AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    s AS (SELECT *, avg(actual - trend) OVER (PARTITION BY extract(dow FROM date)) AS seasonal
          FROM t),
    r AS (SELECT *, actual - trend - seasonal AS residual FROM s)"""

CASES.add("decompose_daily_cost",
          lambda i: _shorten(series.decompose(usage.daily_activity(i.wh), "cost_usd"),
                             "trend", "seasonal", "residual"), f"""
    WITH {PARTS},
    z AS (SELECT *, {R("residual / stddev_samp(residual) OVER ()", 3)} AS residual_zscore FROM r)
    SELECT date, actual, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal,
           round(residual, 4) AS residual, residual_zscore,
           coalesce(abs(residual_zscore) > 2.5, false) AS is_outlier FROM z""")


def _strength_sql(component: str) -> str:
    var = "var_samp(residual)"
    return R(f"1 - {var} / greatest(var_samp({component}) + {var}, 1e-9)", 4)


CASES.add("decomposition_strength", lambda i: series.decomposition_strength(
    series.decompose(usage.daily_activity(i.wh), "cost_usd")), f"""
    WITH {PARTS}
    SELECT {_strength_sql("trend")} AS trend_strength, {_strength_sql("seasonal")}
      AS seasonal_strength FROM r""")

# --- tests and distributions ------------------------------------------------------


def _anova_sql(source: str) -> str:
    return f"""
    WITH x AS ({source}),
    g AS (SELECT grp, count(*) AS n, avg(v) AS m, var_pop(v) AS var FROM x GROUP BY 1),
    a AS (SELECT count(*) AS k, sum(n) AS n, sum(n * var) AS w,
                 sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b FROM g)
    SELECT {R("(b / (k - 1)) / (w / (n - k))", 4)} AS f_statistic,
           CAST(k - 1 AS bigint) AS df_between, CAST(n - k AS bigint) AS df_within FROM a"""


CASES.add("cost_anova_by_practice",
          lambda i: stats.cost_anova_by_practice(i.wh).drop("p_value", "significant"),
          _anova_sql(f"SELECT e.practice AS grp, s.total_cost_usd::double AS v FROM sessions s "
                     f"{EMP('s')} WHERE s.total_cost_usd > 0"))


def _tail_sql(stat: str) -> str:
    """P(F > f) of a row (f, df1, df2), by Simpson's rule on the incomplete beta integral.

    With t = x·exp(−v²/a) the integral is x^a / a · ∫ 2v exp(−v²) (1 − x·exp(−v²/a))^(b−1) dv,
    which is smooth also for one numerator degree of freedom and a small f.
    """
    return f"""
    st AS ({stat}),
    c AS (SELECT *, df2::double / 2 AS a, df1::double / 2 AS b, df2 / (df2 + df1 * f) AS x FROM st),
    v AS (SELECT i * 0.0002::double AS v, i * 0.0002::double * i * 0.0002::double AS vv,
                 CASE WHEN i IN (0, 32000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w
          FROM range(0, 32001) r(i)),
    su AS (SELECT sum(w * 2 * v * exp(-vv) * power(1 - x * exp(-vv / a), b - 1)) * 0.0002 / 3
             AS area FROM c, v),
    tail AS (SELECT c.*, su.area / a * exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x)) AS p
             FROM c, su)"""


_ANOVA = _anova_sql(f"SELECT e.practice AS grp, s.total_cost_usd::double AS v FROM sessions s "
                    f"{EMP('s')} WHERE s.total_cost_usd > 0")
_EXACT_F = _ANOVA.replace(R("(b / (k - 1)) / (w / (n - k))", 4), "(b / (k - 1)) / (w / (n - k))")
CASES.add("cost_anova_significance", lambda i: stats.cost_anova_by_practice(i.wh), f"""
    WITH {_tail_sql("SELECT f_statistic AS f, df_between AS df1, df_within AS df2 "
                    f"FROM ({_EXACT_F})")}
    SELECT {R("f", 4)} AS f_statistic, df1 AS df_between, df2 AS df_within,
           {R("p", 6)} AS p_value, p < 0.05 AS significant FROM tail""")
CASES.add("anova", lambda i: stats.anova(
    i.parquet("lineitem"), "l_linenumber", "l_extendedprice").select(
    F.round("f", 4).alias("f_statistic"), "df_between", "df_within"),
    plain=_anova_sql("SELECT l_linenumber AS grp, l_extendedprice AS v FROM lineitem"))

RANKS = f"""
    WITH x AS (SELECT e.level_num AS a, s.total_cost_usd::double AS b FROM sessions s {EMP("s")}
               WHERE s.total_cost_usd > 0),
    k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra,
                 rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM x)
    SELECT {R("corr(ra, rb)", 4)} AS spearman_rho, count(*) AS n,
           CASE WHEN corr(ra, rb) > 0 THEN 'positive' ELSE 'negative' END AS direction FROM k"""

CASES.add("level_cost_correlation",
          lambda i: stats.level_cost_correlation(i.wh).drop("p_value", "significant"), RANKS)
_EXACT_RHO = RANKS.replace(R("corr(ra, rb)", 4), "corr(ra, rb)")
CASES.add("level_cost_significance", lambda i: stats.level_cost_correlation(i.wh), f"""
    WITH {_tail_sql("SELECT *, spearman_rho ** 2 * (n - 2) / (1 - spearman_rho ** 2) AS f, "
                    f"1 AS df1, n - 2 AS df2 FROM ({_EXACT_RHO})")}
    SELECT {R("spearman_rho", 4)} AS spearman_rho, n, direction, {R("p", 6)} AS p_value,
           p < 0.05 AS significant FROM tail""")

CASES.add("session_duration_stats", lambda i: stats.session_duration_stats(i.wh), f"""
    WITH x AS (SELECT e.practice, s.duration_min AS d FROM sessions s {EMP("s")}
               WHERE s.duration_min > 0 AND s.duration_min < 480),
    c AS (SELECT *, avg(d) OVER (PARTITION BY practice) AS m,
                 var_pop(d) OVER (PARTITION BY practice) AS v FROM x)
    SELECT practice, count(*) AS n, {R("avg(d)", 2)} AS mean,
           {R("quantile_cont(d, 0.5)", 2)} AS median, {R("stddev_samp(d)", 2)} AS std,
           {R("quantile_cont(d, 0.1)", 2)} AS p10, {R("quantile_cont(d, 0.9)", 2)} AS p90,
           {R("avg((d - m) ** 3) / nullif(any_value(v), 0) ** 1.5", 3)} AS skewness,
           {R("avg((d - m) ** 4) / (nullif(any_value(v), 0) ** 2) - 3", 3)} AS kurtosis
    FROM c GROUP BY practice""")

# --- normalisers ------------------------------------------------------------------

_MINMAX = ("CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w)::double"
           " / (max({c}) OVER w - min({c}) OVER w) ELSE 0.5 END")

CASES.add("minmax_normalize", lambda i: _shorten(stats.minmax_normalize(
    i.parquet("part").select("p_partkey", "p_size", "p_retailprice"),
    ["p_size", "p_retailprice"]), "p_size_n", "p_retailprice_n", digits=9), plain=f"""
    SELECT p_partkey, p_size, p_retailprice, round({_MINMAX.format(c="p_size")}, 9) AS p_size_n,
           round({_MINMAX.format(c="p_retailprice")}, 9) AS p_retailprice_n
    FROM part WINDOW w AS ()""")
CASES.add("max_normalize", lambda i: _shorten(stats.max_normalize(
    i.parquet("customer").select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_acctbal"],
    ["c_mktsegment"]), "c_acctbal_n", digits=9), plain="""
    SELECT c_custkey, c_mktsegment, c_acctbal,
           round(c_acctbal / max(c_acctbal) OVER (PARTITION BY c_mktsegment), 9) AS c_acctbal_n
    FROM customer""")
CASES.add("standardize", lambda i: _shorten(stats.standardize(
    i.parquet("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice"),
    ["l_extendedprice"], ["l_returnflag"]), "l_extendedprice_z", digits=6), plain="""
    SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice,
           round((l_extendedprice - avg(l_extendedprice) OVER w)
                 / stddev_pop(l_extendedprice) OVER w, 6) AS l_extendedprice_z
    FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)""")

# --- chart bins -------------------------------------------------------------------


def _histogram_sql(source: str, column: str, bins: int, by: str = "") -> str:
    lead = f"{by}," if by else ""
    return f"""
    WITH x AS ({source}),
    e AS (SELECT min({column})::double AS low,
                 (max({column})::double - min({column})::double) / {bins} AS step FROM x),
    b AS (SELECT {lead} e.low, e.step, CASE WHEN e.step > 0
            THEN least({bins}, CAST(floor(({column}::double - e.low) / e.step) AS int) + 1)
            ELSE 1 END AS bin FROM x, e WHERE {column} IS NOT NULL)
    SELECT {lead} bin, round(low + (bin - 1) * step, 6) AS bin_start,
           round(low + bin * step, 6) AS bin_end, count(*) AS count
    FROM b GROUP BY {lead} bin, low, step"""


def _histogram(df: DataFrame, column: str, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    return _shorten(stats.histogram(df, column, bins, by), "bin_start", "bin_end", digits=6)


DEPTH = "SELECT num_turns, duration_min FROM sessions WHERE duration_min < 480 AND num_turns > 0"
PEAKS = """SELECT e.practice, p.hour AS peak_hour FROM (
        SELECT user_email, CAST(extract(hour FROM start_time) AS int) AS hour,
               row_number() OVER (PARTITION BY user_email
                 ORDER BY count(*) DESC, CAST(extract(hour FROM start_time) AS int)) AS rn
        FROM sessions GROUP BY 1, 2) p
    LEFT JOIN employees e ON e.email = p.user_email WHERE rn = 1"""

CASES.add("histogram", lambda i: _histogram(
    i.parquet("lineitem"), "l_extendedprice", 30, ("l_returnflag",)),
    plain=_histogram_sql("SELECT l_returnflag, l_extendedprice FROM lineitem", "l_extendedprice",
                         30, "l_returnflag"))
CASES.add("histogram_turns", lambda i: _histogram(
    people.session_depth_distribution(i.wh), "num_turns", 40),
    _histogram_sql(DEPTH, "num_turns", 40))
CASES.add("histogram_duration", lambda i: _histogram(
    people.session_depth_distribution(i.wh), "duration_min", 40),
    _histogram_sql(DEPTH, "duration_min", 40))
CASES.add("histogram_scores", lambda i: _histogram(
    people.user_engagement_scores(i.wh), "engagement_score", 25, ("practice",)),
    _histogram_sql(ENGAGEMENT, "engagement_score", 25, "practice"))
CASES.add("histogram_gaps", lambda i: _histogram(
    behavior.inter_session_gaps(i.wh), "gap_hours", 50, ("practice",)),
    _histogram_sql(f"WITH {GAPS} SELECT * FROM gaps", "gap_hours", 50, "practice"))
CASES.add("histogram_peak_hours", lambda i: _histogram(
    people.user_activity_profiles(i.wh), "peak_hour", 24, ("practice",)),
    _histogram_sql(PEAKS, "peak_hour", 24, "practice"))


def _box_sql(source: str, column: str, by: str) -> str:
    return f"""
    WITH x AS ({source}),
    q AS (SELECT {by}, quantile_cont({column}::double, 0.25) AS q1,
                 quantile_cont({column}::double, 0.5) AS median,
                 quantile_cont({column}::double, 0.75) AS q3 FROM x GROUP BY 1),
    f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
    SELECT x.{by}, count(*) AS n, {R(f"min(x.{column})", 4)} AS min, {R("any_value(q1)", 4)} AS q1,
           {R("any_value(median)", 4)} AS median, {R("any_value(q3)", 4)} AS q3,
           {R("any_value(lo)", 4)} AS lower_fence, {R("any_value(hi)", 4)} AS upper_fence,
           {R(f"max(x.{column})", 4)} AS max,
           count(*) FILTER (WHERE x.{column}::double < lo OR x.{column}::double > hi) AS outliers
    FROM x JOIN f ON f.{by} = x.{by} GROUP BY 1"""


COSTS = f"SELECT e.practice, total_cost_usd FROM sessions s {EMP('s')} WHERE total_cost_usd > 0"
LENGTHS = (f"SELECT e.practice, p.prompt_length FROM user_prompts p {EMP('p')} "
           "WHERE p.prompt_length BETWEEN 1 AND 10000")

CASES.add("box_costs", lambda i: stats.box_stats(
    people.session_costs_by_practice(i.wh), "total_cost_usd", ["practice"]),
    _box_sql(COSTS, "total_cost_usd", "practice"))
CASES.add("box_gaps", lambda i: stats.box_stats(
    behavior.inter_session_gaps(i.wh), "gap_hours", ["practice"]),
    _box_sql(f"WITH {GAPS} SELECT * FROM gaps", "gap_hours", "practice"))
CASES.add("box_prompt_lengths", lambda i: stats.box_stats(
    prompts.prompt_lengths_by_practice(i.wh), "prompt_length", ["practice"]),
    _box_sql(LENGTHS, "prompt_length", "practice"))
CASES.add("box_stats", lambda i: stats.box_stats(
    i.parquet("lineitem"), "l_extendedprice", ["l_returnflag"]),
    plain=_box_sql("SELECT l_returnflag, l_extendedprice FROM lineitem", "l_extendedprice",
                   "l_returnflag"))

# --- usage vectors, segments, outliers --------------------------------------------

CASES.add("user_usage_features", lambda i: isolation.user_usage_features(i.wh), f"""
    SELECT s.user_email, count(DISTINCT s.session_id) AS sessions,
           CAST(sum(s.num_api_calls) AS bigint) AS api_calls,
           {R("sum(s.total_cost_usd)", 4)} AS total_cost, {R(M("s.num_turns"), 2)} AS avg_turns,
           {R(M("s.duration_min"), 2)} AS avg_duration,
           coalesce(any_value(c.errors), 0) AS errors
    FROM sessions s LEFT JOIN (SELECT user_email, count(*) AS errors FROM api_errors GROUP BY 1) c
      ON c.user_email = s.user_email GROUP BY 1""")

CASES.add("detect_user_anomalies", lambda i: isolation.detect_user_anomalies(i.wh))
CASES.add("anomaly_share",
          lambda i: isolation.anomaly_share(isolation.detect_user_anomalies(i.wh)))
CASES.add("cluster_users", lambda i: segments.cluster_users(i.wh))
CASES.add("cluster_profile", lambda i: segments.cluster_profile(segments.cluster_users(i.wh)))
CASES.add("box_segments", lambda i: stats.box_stats(
    segments.cluster_users(i.wh), "total_cost", ["cluster_label"]))
CASES.add("rolling_sessions_by_cluster",
          lambda i: behavior.rolling_sessions_by_cluster(i.wh, segments.cluster_users(i.wh)))


# --- what has to hold for segments and outliers, whatever the random draws ----------


def segment_violations(clusters: DataFrame) -> DataFrame:
    """One row: sizes, and counts of what must not occur in the result of ``cluster_users``.

    Users nearer to the mean of another segment (in units of the spread, beyond the tolerance
    of the fit), distances that are not those to the own mean, labels against the
    order of mean cost. Means are one row a segment.
    """
    features = segments.FEATURES
    spread = clusters.agg(F.struct(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in features])).scalar()
    means = clusters.groupBy("cluster", "cluster_label").agg(*[F.avg(c).cast("double").alias(c) for c in features])
    listed = means.agg(F.sort_array(F.collect_list(F.struct("cluster", "cluster_label", *features)))).scalar()
    users = clusters.withColumns({"_means": listed, "_spread": spread})

    def away(mean, scaled: bool):
        def part(c):
            size = F.when(F.col("_spread")[c] > 0, F.col("_spread")[c]).otherwise(1.0) if scaled else F.lit(1.0)
            return F.pow((F.col(c).cast("double") - mean[c]) / size, F.lit(2.0))
        return F.sqrt(sum((part(c) for c in features[1:]), part(features[0])))

    own = F.get(F.filter("_means", lambda m: m["cluster"] == F.col("cluster")), F.lit(0))
    nearest = F.array_min(F.transform("_means", lambda m: away(m, True)))
    ordered = F.forall(F.sequence(F.lit(0), F.size("_means") - 2), lambda n: F.get("_means", n)["total_cost"]
                       >= F.get("_means", n + 1)["total_cost"])
    return users.agg(
        F.count(F.lit(1)).alias("users"), F.countDistinct("cluster_label").alias("labels"),
        F.sum("sessions").cast("bigint").alias("held_sessions"),
        F.count_if(away(own, True) > nearest + 1e-3).alias("nearer_elsewhere"),
        F.count_if(F.abs(away(own, False) - F.col("dist_to_centroid")) > 2e-3).alias("wrong_distance"),
        F.count_if(~ordered).alias("out_of_order"))


def anomaly_violations(anomalies: DataFrame, contamination: float = 0.1) -> DataFrame:
    """One row: users, and counts of what must not occur in the result of ``detect_user_anomalies``.

    With n users the linear quantile lies at place p = contamination * (n - 1). So at most
    ceil(p) are flagged, and with the users that tie at the least unflagged score at least so many.
    """
    score, flagged = F.col("anomaly_score"), F.col("is_anomaly")
    ends = anomalies.agg(F.struct(F.min(score).alias("low"), F.max(score).alias("high"),
                                  F.min(F.when(~flagged, score)).alias("first_kept"))).scalar()
    third = (F.col("_ends.high") - F.col("_ends.low")) / 3
    grade = (F.when(score < F.col("_ends.low") + third, "High")
             .when(score < F.col("_ends.low") + 2 * third, "Medium").otherwise("Low"))
    row = anomalies.withColumn("_ends", ends).agg(
        F.count(F.lit(1)).alias("users"), F.count_if(flagged).alias("_flagged"),
        F.count_if(score == F.col("_ends.first_kept")).alias("_tied"),
        F.count_if(flagged & (score >= F.col("_ends.first_kept"))).alias("flagged_above_kept"),
        F.count_if(F.col("anomaly_severity") != grade).alias("wrong_severity"),
        F.count_if((F.col("anomaly_label") == -1) != flagged).alias("wrong_label"))
    most = F.ceil(F.lit(contamination) * (F.col("users") - 1))
    wrong = (F.col("_flagged") > most) | (F.col("_flagged") + F.col("_tied") < most)
    return row.withColumn("wrong_number", wrong.cast("bigint")).drop("_flagged", "_tied")


CASES.add("cluster_users_holds", lambda i: segment_violations(segments.cluster_users(i.wh)), f"""
    SELECT count(*) AS users, 4::bigint AS labels, CAST(sum(sessions) AS bigint) AS held_sessions,
           0::bigint AS nearer_elsewhere, 0::bigint AS wrong_distance, 0::bigint AS out_of_order
    FROM ({ENGAGEMENT})""")
CASES.add("user_anomalies_hold", lambda i: anomaly_violations(isolation.detect_user_anomalies(i.wh)), """
    SELECT count(DISTINCT user_email) AS users, 0::bigint AS flagged_above_kept, 0::bigint AS wrong_severity,
           0::bigint AS wrong_label, 0::bigint AS wrong_number FROM sessions""")
CASES.add("rolling_segments_total", lambda i: behavior.rolling_sessions_by_cluster(
    i.wh, segments.cluster_users(i.wh)).groupBy(
        "date", (F.col("cluster_label") != behavior.UNKNOWN_SEGMENT).alias("placed")).agg(
        F.sum("sessions").cast("bigint").alias("sessions")), f"""
    SELECT CAST(start_time AS date) AS date, user_email IN (SELECT user_email FROM ({ENGAGEMENT})) AS placed,
           count(*) AS sessions FROM sessions GROUP BY 1, 2""")
