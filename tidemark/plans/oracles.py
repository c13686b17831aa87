"""The same queries as SQL for an independent engine (DuckDB dialect)."""

from __future__ import annotations

TICKS = "t AS (SELECT event_type AS pair, ts, value AS close, event_id FROM events)"
BARS = (
    TICKS + ", b AS (SELECT pair, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(close, ts) AS open, max(close) AS high,"
    " min(close) AS low, arg_max(close, ts) AS close, count(*) AS volume FROM t GROUP BY 1, 2)"
)
W = "OVER (PARTITION BY pair ORDER BY ts)"
PAIRS = ["click", "error", "purchase", "signup", "view"]
SESSION = (
    "CASE WHEN hour(ts) < 7 THEN 'Asia' WHEN hour(ts) < 13 THEN 'London' WHEN hour(ts) < 17 THEN 'Overlap' ELSE 'New_York' END"
)


def over(n: int, end: str = "CURRENT ROW") -> str:
    return f"OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN {n} PRECEDING AND {end})"


def full(agg: str, x: str, n: int) -> str:
    f = over(n - 1)
    return f"CASE WHEN count({x}) {f} >= {n} THEN {agg}({x}) {f} END"


def ret(k: int) -> str:
    return f"close / nullif(lag(close, {k}) {W}, 0) - 1"


def q(body: str, *ctes: str, base: str = BARS) -> str:
    return f"WITH {', '.join([base, *ctes])} {body}"


DIRTY = (
    f"n AS (SELECT *, row_number() {W} AS n FROM b),"
    " d AS (SELECT pair, ts, CASE WHEN n % 17 = 0 THEN low - 1 ELSE high END AS high, low, volume, n,"
    " CASE WHEN n % 23 = 0 THEN high + 1 ELSE open END AS open, CASE WHEN n % 29 = 0 THEN NULL ELSE close END AS close FROM n)"
)
BAD = (
    "(coalesce(high < low, false) OR coalesce(open > high, false) OR coalesce(open < low, false)"
    " OR coalesce(close > high, false) OR coalesce(close < low, false))"
)
RET = f"r AS (SELECT *, {ret(1)} AS ret FROM b)"
LOGR = f"r AS (SELECT *, ln(close) - ln(lag(close) {W}) AS ret FROM (SELECT * REPLACE (nullif(close, 0) AS close) FROM b))"
LABELLED = (
    f"f AS (SELECT *, {SESSION} AS session, lead(close, 5) {W} / nullif(close, 0) - 1 AS f FROM b),"
    " l AS (SELECT *, CASE WHEN f > 0.25 THEN 1 WHEN f < -0.25 THEN -1 WHEN f IS NOT NULL THEN 0 END::INT AS label FROM f)"
)
WIDE = (
    RET + ", a AS (SELECT ts, " + ", ".join(f"max(ret) FILTER (pair = '{p}') AS \"{p}\"" for p in PAIRS)
    + ", count(ret) AS n FROM r GROUP BY ts), wide AS (SELECT * EXCLUDE n FROM a WHERE n = 5)"
)


def momentum(n: int, src: str = "b", part: str = "pair") -> str:
    f = f"OVER (PARTITION BY {part} ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    w = f"OVER (PARTITION BY {part} ORDER BY ts)"
    return (
        f"m0 AS (SELECT *, max(close) {f} AS hi, min(close) {f} AS lo, row_number() {w} AS rn FROM {src}),"
        f" sig AS (SELECT * EXCLUDE (hi, lo), CASE WHEN rn <= {n} THEN 0 WHEN close > hi THEN 1 WHEN close < lo THEN -1 ELSE 0 END::INT AS signal FROM m0)"
    )


def positions(src: str = "sig", part: str = "pair") -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY ts)"
    return (
        f"p0 AS (SELECT *, coalesce(last_value(nullif(signal, 0) IGNORE NULLS) {w}, 0) AS held FROM {src}),"
        f" pos AS (SELECT * EXCLUDE held, lag(held, 1, 0) {w}::INT AS position FROM p0)"
    )


NUMBERED = f"s AS (SELECT *, row_number() {W} AS i FROM b)"


def recursive(cols: str, first: str, step: str, *ctes: str, base: str = BARS, body: str) -> str:
    """A fold over each instrument's rows: state columns by row number."""
    return (
        f"WITH RECURSIVE {', '.join([base, *ctes])}, z({cols}) AS ({first} UNION ALL {step}) {body}"
    )


def ewm_sql(spans: list[int], z: str = "z") -> str:
    """z(pair, i, e0, e1...): averages of close by span."""
    names = ", ".join(f"e{k}" for k in range(len(spans)))
    first = "SELECT pair, i, " + ", ".join("close" for _ in spans) + " FROM s WHERE i = 1"
    terms = ", ".join(f"{z}.e{k} + (s.close - {z}.e{k}) * (2.0::DOUBLE / {n + 1})" for k, n in enumerate(spans))
    step = f"SELECT s.pair, s.i, {terms} FROM {z} JOIN s ON s.pair = {z}.pair AND s.i = {z}.i + 1"
    return f"{z}(pair, i, {names}) AS ({first} UNION ALL {step})"


WILDER = (
    "g AS (SELECT *, greatest(close - lag(close) OVER (PARTITION BY pair ORDER BY ts), 0) AS up,"
    " greatest(lag(close) OVER (PARTITION BY pair ORDER BY ts) - close, 0) AS dn FROM s),"
    " wz(pair, i, u, d) AS (SELECT pair, i, up, dn FROM g WHERE i = 2 UNION ALL"
    " SELECT g.pair, g.i, wz.u + (g.up - wz.u) / 14.0::DOUBLE, wz.d + (g.dn - wz.d) / 14.0::DOUBLE FROM wz JOIN g ON g.pair = wz.pair AND g.i = wz.i + 1),"
    " rs AS (SELECT s.pair, s.ts, s.i, 100 - 100 / (1 + wz.u / nullif(wz.d, 0)) AS rsi FROM s LEFT JOIN wz USING (pair, i))"
)

SPLIT = (
    "s0 AS (SELECT *, CASE WHEN ts <= TIMESTAMP '2024-01-15 23:59:59' THEN 'train' WHEN ts <= TIMESTAMP '2024-01-22 23:59:59' THEN 'val' ELSE 'test' END AS split FROM {src}),"
    " s1 AS (SELECT *, row_number() OVER (PARTITION BY pair, split ORDER BY ts DESC) AS e, count(*) OVER (PARTITION BY pair, split) AS c FROM s0),"
    " sp AS (SELECT * EXCLUDE (e, c) FROM s1 WHERE split = 'test' OR e > 15 OR c <= 15)"
)
FOLDS = (
    "fd(fold, te, vs, ve) AS (VALUES (0, TIMESTAMP '2024-01-08 23:59:59', TIMESTAMP '2024-01-09', TIMESTAMP '2024-01-12 23:59:59'),"
    " (1, TIMESTAMP '2024-01-12 23:59:59', TIMESTAMP '2024-01-13', TIMESTAMP '2024-01-16 23:59:59'),"
    " (2, TIMESTAMP '2024-01-16 23:59:59', TIMESTAMP '2024-01-17', TIMESTAMP '2024-01-20 23:59:59')),"
    " k0 AS (SELECT b.*, fold, CASE WHEN ts <= te THEN 'train' WHEN ts >= vs AND ts <= ve THEN 'val' END AS kind FROM b, fd),"
    " k1 AS (SELECT *, row_number() OVER (PARTITION BY pair, fold, kind ORDER BY ts DESC) AS e, count(*) OVER (PARTITION BY pair, fold, kind) AS c FROM k0 WHERE kind IS NOT NULL),"
    " k AS (SELECT * EXCLUDE (e, c) FROM k1 WHERE kind = 'val' OR e > 15 OR c <= 15)"
)

OUTCOMES = (
    "o AS (SELECT 'P' || (l_suppkey % 5) AS pair, 'S' || lpad((l_partkey % 13)::VARCHAR, 2, '0') AS strategy,"
    " CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN 'london' ELSE 'ny' END AS session, (l_orderkey % 3)::INT AS direction,"
    " count(*) AS n_trades, round(avg(l_quantity - 25), 4) AS net_sharpe, round(avg(l_discount - 0.05) * 100, 4) AS sortino,"
    " round(avg(l_tax) * 50, 4) AS calmar, round(-avg(l_tax) * 10, 4) AS max_drawdown FROM lineitem GROUP BY 1, 2, 3, 4),"
    " sc AS (SELECT *, CASE WHEN n_trades < 10 OR max_drawdown < -0.95 THEN 0.0 ELSE round(35 * greatest(0, least(1, net_sharpe / 5))"
    " + 25 * greatest(0, least(1, sortino / 5)) + 25 * greatest(0, least(1, calmar / 3)) + 15 * greatest(0, 1 + max_drawdown), 2) END AS composite FROM o)"
)
STRAT = OUTCOMES + (
    ", st AS (SELECT pair, strategy, round(avg(net_sharpe), 4) AS score, 'F' || (substr(strategy, 2, 2)::INT % 4) AS family FROM sc GROUP BY pair, strategy)"
)
FOLD_RUNS = (
    "fr AS (SELECT 'P' || (l_suppkey % 5) AS pair, 'S' || (l_partkey % 7) AS strategy, (l_orderkey % 5)::INT AS fold, round(avg(l_quantity) - 25.3, 4) AS net_sharpe,"
    " round(avg(l_discount) - 0.05, 6) AS total_return, count(*) AS n_trades, round(sum(l_quantity), 2) AS capital_final, round(-avg(l_tax), 6) AS max_drawdown, round(avg(l_tax) * 30, 6) AS calmar,"
    " round(avg(l_discount) * 7, 6) AS win_rate, round(avg(l_quantity) / 20, 6) AS profit_factor, round(avg(l_linenumber), 6) AS avg_trade_bars, round(avg(l_discount), 6) AS turnover, round(avg(l_tax) - 0.04, 6) AS sortino,"
    " round(max(l_quantity) / 10, 6) AS gross_sharpe, count(*) FILTER (l_linenumber = 1) AS n_long, count(*) FILTER (l_linenumber = 2) AS n_short, count(*) FILTER (l_linenumber > 2) AS n_flat FROM lineitem GROUP BY 1, 2, 3),"
    " fa AS (SELECT pair, strategy, round(avg(net_sharpe), 6) AS fold_mean, round(stddev_pop(net_sharpe), 6) AS fold_std,"
    + ", ".join(f" round(avg({c}), 6) AS {c}" for c in ("total_return", "max_drawdown", "calmar", "win_rate", "profit_factor", "avg_trade_bars", "turnover", "sortino"))
    + ", " + ", ".join(f"arg_max({c}, fold) AS {c}" for c in ("capital_final", "gross_sharpe", "n_long", "n_short", "n_flat"))
    + ", sum(n_trades)::BIGINT AS n_trades, count(*) FILTER (net_sharpe < 0) AS negative_folds FROM fr GROUP BY 1, 2),"
    " fs AS (SELECT *, round(fold_mean - 0.5 * fold_std, 3) AS stability FROM fa)"
)
SESSIONS = "['asia', 'global', 'london', 'ny']"
TRANSFERS = (
    f"tr AS (SELECT {SESSIONS}[(l_suppkey % 4 + 1)::INT] AS train_session, {SESSIONS}[(l_partkey % 4 + 1)::INT] AS eval_session,"
    " CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE 2.0 END AS spread_mult, round(avg(l_quantity) - 25, 4) AS net_sharpe"
    " FROM lineitem GROUP BY 1, 2, 3)"
)

SQL: dict[str, str] = {
    "ohlcv_resample": q("SELECT * FROM b"),
    "ohlcv_resample_daily": q(
        "SELECT pair, time_bucket(INTERVAL '1 day', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,"
        " arg_max(close, ts) AS close, sum(volume)::BIGINT AS volume FROM b GROUP BY 1, 2"
    ),
    "ohlc_validity": q(f"SELECT pair, {BAD} AS bad, count(*) AS n, min(ts) AS first_ts FROM d GROUP BY 1, 2", DIRTY),
    "clean_bars": q(
        "SELECT pair, ts, open, high, low, close, volume FROM (SELECT *, count(*) OVER (PARTITION BY pair, ts::DATE) AS c FROM d"
        f" WHERE close IS NOT NULL AND NOT {BAD}) WHERE c >= 18",
        DIRTY,
    ),
    "cleaning_summary": q(
        "SELECT pair, rows_before, missing_ohlc_rows_before, duplicate_timestamps_before, invalid_ohlc_rows_before, volume_all_zero, start_before, end_before,"
        " coalesce(rows_after, 0)::BIGINT AS rows_after, start_after, end_after, coalesce(dd, 0)::BIGINT AS days_dropped_low_coverage, coalesce(dr, 0)::BIGINT AS rows_removed_low_coverage_days,"
        " rows_before - coalesce(rows_after, 0)::BIGINT AS rows_removed_total, (rows_before - coalesce(rows_after, 0)) / rows_before AS pct_rows_removed_total, 18 AS min_obs_day_threshold FROM h LEFT JOIN k USING (pair) LEFT JOIN p USING (pair)",
        DIRTY,
        "x AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE n % 50 = 0)",
        "h AS (SELECT pair, count(*) AS rows_before, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS missing_ohlc_rows_before, count(*) - count(DISTINCT ts) AS duplicate_timestamps_before,"
        f" count(*) FILTER ({BAD}) AS invalid_ohlc_rows_before, bool_and(volume = 0) AS volume_all_zero, min(ts) AS start_before, max(ts) AS end_before FROM x GROUP BY 1)",
        f"u AS (SELECT DISTINCT ON (pair, ts) * FROM x WHERE close IS NOT NULL), g AS (SELECT *, count(*) OVER (PARTITION BY pair, ts::DATE) AS c FROM u WHERE NOT {BAD})",
        "k AS (SELECT pair, count(*) AS rows_after, min(ts) AS start_after, max(ts) AS end_after FROM g WHERE c >= 18 GROUP BY 1), p AS (SELECT pair, count(DISTINCT ts::DATE) AS dd, count(*) AS dr FROM g WHERE c < 18 GROUP BY 1)",
    ),
    "dedupe_first": q(
        "SELECT pair, ts, close, event_id FROM (SELECT *, row_number() OVER (PARTITION BY pair, floor(epoch(ts) / 1800) ORDER BY ts, event_id) AS n FROM t) WHERE n = 1"
    ),
    "sparse_days": q(
        "SELECT pair, count(*) AS n, count(DISTINCT ts::DATE) AS days FROM (SELECT *, count(*) OVER (PARTITION BY pair, ts::DATE) AS c FROM b) WHERE c >= 23 GROUP BY 1"
    ),
    "tz_normalise": (
        "WITH l AS (SELECT event_id, date_trunc('second', ts + INTERVAL 54 DAY) AS t FROM events),"
        " u AS (SELECT event_id, CASE WHEN t < TIMESTAMP '2024-03-10 02:00:00' THEN t + INTERVAL 5 HOUR ELSE t + INTERVAL 4 HOUR END AS ts FROM l"
        " WHERE NOT (t >= TIMESTAMP '2024-03-10 02:00:00' AND t < TIMESTAMP '2024-03-10 03:00:00'))"
        f" SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS utc, {SESSION} AS session FROM u"
    ),
    "daily_coverage": q("SELECT pair, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) / 24 AS ratio FROM b GROUP BY 1, 2"),
    "monthly_coverage": q(
        "SELECT pair, strftime(day, '%Y-%m') AS month, sum(n)::BIGINT AS n_rows, round(avg(n / 24), 6) AS mean_ratio, round(min(n / 24), 6) AS min_ratio,"
        " round(max(n / 24), 6) AS max_ratio, count(*) AS days FROM dd GROUP BY 1, 2",
        "dd AS (SELECT pair, ts::DATE AS day, count(*) AS n FROM b GROUP BY 1, 2)",
    ),
    "year_month_counts": q("SELECT pair, year(ts)::INT AS year, month(ts)::INT AS month, count(*) AS n FROM b GROUP BY 1, 2, 3"),
    "session_stats": q(
        f"SELECT pair, {SESSION} AS session, round(avg(high - low), 6) AS mean_range, round(median(high - low), 6) AS median_range,"
        " round(avg(abs(ret)), 6) AS mean_abs_ret, round(avg(volume), 6) AS mean_volume, count(*) AS n FROM r GROUP BY 1, 2",
        RET,
    ),
    "hourly_stats": q(
        "SELECT pair, hour(ts)::INT AS hour, round(avg(high - low), 6) AS mean_range, round(median(high - low), 6) AS median_range,"
        " round(avg(abs(ret)), 6) AS mean_abs_ret, round(avg(volume), 6) AS mean_volume, count(*) AS n FROM r GROUP BY 1, 2",
        RET,
    ),
    "overview": q(
        f"SELECT pair, count(*) AS n_rows, count(*) - count(DISTINCT ts) AS duplicate_ts, {', '.join(f'count(*) FILTER ({c} IS NULL) AS missing_{c}' for c in ('open', 'high', 'low', 'close', 'volume'))},"
        f" count(*) FILTER ({BAD}) AS invalid_ohlc, count(*) FILTER (volume = 0) AS zero_volume, min(ts) AS first_ts, max(ts) AS last_ts FROM d GROUP BY 1",
        DIRTY,
    ),
    "distribution_summary": q(
        "SELECT pair, metric, count(*) AS n, " + ", ".join(
            f"round({e}, 6) AS \"{n}\"" for n, e in [
                ("mean", "avg(x)"), ("std", "stddev_samp(x)"), ("min", "min(x)"), ("p1", "quantile_cont(x, 0.01)"), ("p5", "quantile_cont(x, 0.05)"),
                ("p50", "quantile_cont(x, 0.5)"), ("p95", "quantile_cont(x, 0.95)"), ("p99", "quantile_cont(x, 0.99)"), ("max", "max(x)"),
                ("skew", "skewness(x)"), ("kurt", "kurtosis(x)")]
        ) + " FROM u WHERE x IS NOT NULL GROUP BY 1, 2",
        RET, "u AS (SELECT pair, 'ret' AS metric, ret AS x FROM r UNION ALL SELECT pair, 'rng', high - low FROM r)",
    ),
    "acf": q(
        "SELECT pair, lag, round(sum(CASE WHEN y.x IS NOT NULL THEN c.x * y.x END) / max(ss), 6) AS acf FROM c CROSS JOIN range(21) g(lag)"
        " LEFT JOIN (SELECT pair AS p2, i AS i2, x FROM c) y ON y.p2 = c.pair AND y.i2 = c.i - g.lag JOIN (SELECT pair AS p3, sum(x * x) AS ss FROM c GROUP BY 1) ON p3 = pair GROUP BY 1, 2",
        LOGR, f"v AS (SELECT pair, ts, ret FROM r WHERE ret IS NOT NULL), c AS (SELECT pair, row_number() {W} AS i, ret - avg(ret) OVER (PARTITION BY pair) AS x FROM v)",
    ).replace("SELECT pair, lag, round", "SELECT pair, lag::INT AS lag, round"),
    "correlation_matrix": q(
        " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, round(corr(\"{a}\", \"{b}\"), 6) AS corr FROM wide" for i, a in enumerate(PAIRS) for b in PAIRS[i:]
        ),
        WIDE,
    ),
    "quality_summary": q(
        "SELECT pair, duplicate_timestamps, missing_core_ohlc_rows, invalid_ohlc_rows, extreme_jump_rows, low_coverage_days, 3.0::DOUBLE AS extreme_jump_std_multiplier, 0.5::DOUBLE AS low_coverage_threshold FROM"
        " (SELECT pair, count(*) - count(DISTINCT ts) AS duplicate_timestamps, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS missing_core_ohlc_rows,"
        f" count(*) FILTER ({BAD}) AS invalid_ohlc_rows, count(*) FILTER (sd > 0 AND abs(ret) > 3 * sd) AS extreme_jump_rows FROM r JOIN (SELECT pair, stddev_samp(ret) AS sd FROM r GROUP BY 1) USING (pair) GROUP BY 1)"
        " JOIN (SELECT pair, count(*) FILTER (n / 24 < 0.5) AS low_coverage_days FROM (SELECT pair, ts::DATE AS d, count(*) AS n FROM d GROUP BY 1, 2) GROUP BY 1) USING (pair)",
        DIRTY, f"r AS (SELECT *, {ret(1)} AS ret FROM d)",
    ),
    "inspect_days": q(
        "SELECT * FROM (SELECT pair, count(*) AS n_rows, count(*) FILTER (ts IS NULL) AS null_ts, count(*) FILTER (open IS NULL) AS null_open, count(*) FILTER (close IS NULL) AS null_close,"
        f" count(*) - count(DISTINCT ts) AS duplicate_ts, count(*) FILTER ({BAD}) AS invalid_ohlc, count(*) FILTER (volume = 0) AS zero_volume FROM d GROUP BY 1)"
        " JOIN (SELECT pair, min(n) AS min_per_day, max(n) AS max_per_day, median(n) AS median_per_day, count(*) FILTER (n < 24) AS short_days"
        " FROM (SELECT pair, ts::DATE AS d, count(*) AS n FROM d GROUP BY 1, 2) GROUP BY 1) USING (pair)",
        DIRTY,
    ),
    "histogram": q(
        "SELECT pair, CASE WHEN hi > lo THEN least(floor((close - lo) * 64 / (hi - lo)), 63) ELSE 0 END::INT AS bin, count(*) AS n FROM t JOIN (SELECT pair, min(close) AS lo, max(close) AS hi FROM t GROUP BY 1) USING (pair) GROUP BY 1, 2",
        base=TICKS,
    ),
    "time_features": q(
        "SELECT pair, ts, hour(ts)::INT AS hour, ((dayofweek(ts) + 6) % 7)::INT AS day_of_week, (hour(ts) * 60 + minute(ts))::INT AS minute_of_day,"
        " (hour(ts) BETWEEN 13 AND 15)::TINYINT AS is_overlap_session, (ts::DATE = last_day(ts))::TINYINT AS is_month_end,"
        " round(sin(hour(ts) * 2 * pi() / 24), 6) + 0.0 AS hour_sin, round(cos(hour(ts) * 2 * pi() / 24), 6) + 0.0 AS hour_cos FROM b"
    ),
    "session_flags": q(
        "SELECT pair, ts, session, (session = 'Asia')::TINYINT AS session_asia, (session = 'London')::TINYINT AS session_london,"
        f" (session = 'Overlap')::TINYINT AS session_overlap, (session = 'New_York')::TINYINT AS session_ny FROM (SELECT *, {SESSION} AS session FROM b)"
    ),
    "simple_returns": q(f"SELECT pair, ts, {', '.join(f'{ret(k)} AS ret_{k}' for k in (1, 5, 15))} FROM b"),
    "log_returns": q("SELECT pair, ts, round(ret, 6) AS log_ret_1 FROM r", LOGR),
    "rolling_vol": q("SELECT pair, ts, " + ", ".join(f"round({full('stddev_samp', 'ret', k)}, 6) AS rv_{k}" for k in (10, 30, 60)) + " FROM r", LOGR),
    "rolling_sma": q("SELECT pair, ts, " + ", ".join(f"round({full('avg', 'close', k)}, 6) AS sma_{k}" for k in (10, 30, 60, 120)) + " FROM b"),
    "price_to_sma": q(
        f"SELECT pair, ts, round(close / nullif(sma, 0) - 1, 6) AS price_to_sma_30, round(rma, 6) AS range_ma_10, round((high - low) / nullif(close, 0), 6) AS range_pct, round({ret(15)}, 6) AS mom_15 FROM x",
        f"y AS (SELECT *, high - low AS rng FROM b), x AS (SELECT *, {full('avg', 'close', 30)} AS sma, {full('avg', 'rng', 10)} AS rma FROM y)",
    ),
    "volume_zscore": q(
        "SELECT pair, ts, round((close - m) / nullif(s, 0), 6) AS z FROM x",
        f"x AS (SELECT *, {full('avg', 'close', 60)} AS m, {full('stddev_samp', 'close', 60)} AS s FROM b)",
    ),
    "expanding_quantile": q(
        "SELECT pair, ts, round(q, 6) AS q80, coalesce(r > q, false)::INT AS regime_high FROM x",
        f"y AS (SELECT *, high - low AS r, row_number() {W} AS i FROM b), x AS (SELECT *, CASE WHEN i >= 30 THEN quantile_cont(r, 0.8)"
        " OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS q FROM y)",
    ),
    "same_slot_lag": q(
        "SELECT pair, ts, round(lag(ln(high / nullif(low, 0))) OVER (PARTITION BY pair, strftime(ts, '%H:%M') ORDER BY ts), 6) AS prev_range FROM b"
    ),
    "spread_features": q(
        "SELECT pair, ts, round((high - low) / p, 6) AS bar_range_pips, round((high - low) / p / s, 6) AS bar_range_to_spread_ratio FROM"
        " (SELECT *, CASE pair WHEN 'click' THEN 0.01 WHEN 'view' THEN 0.1 ELSE 0.0001 END::DOUBLE AS p, CASE pair WHEN 'click' THEN 0.7 WHEN 'view' THEN 1.4 ELSE 1.0 END::DOUBLE AS s FROM b)"
    ),
    "cross_instrument_join": q(
        "SELECT b.pair, b.ts, " + ", ".join(f"CASE WHEN b.pair != '{p}' THEN x.\"{p}\" END AS {p}_ret_1_xpair" for p in PAIRS) + " FROM b LEFT JOIN a x USING (ts)",
        WIDE,
    ),
    "aligned_returns": q("SELECT * FROM wide", WIDE),
    "forward_label": q("SELECT pair, ts, f AS future_ret_5, label::TINYINT AS label FROM l", LABELLED),
    "label_distribution": q("SELECT pair, label, count(*) AS n FROM l GROUP BY 1, 2", LABELLED),
    "label_summary": q(
        "SELECT pair, count(*) AS rows_before, count(f15) AS rows_after, count(*) - count(f15) AS rows_removed_tail, 5 AS horizon_primary, 0.25::DOUBLE AS threshold_primary, 15 AS horizon_secondary, 0.5::DOUBLE AS threshold_secondary, "
        + ", ".join(
            f"count(*) FILTER (f15 IS NOT NULL AND {x}) AS {n}_{k}_count"
            for n, f, t in (("primary", "f5", 0.25), ("secondary", "f15", 0.5))
            for k, x in (("long", f"{f} > {t}"), ("short", f"{f} < -{t}"), ("no_trade", f"{f} BETWEEN -{t} AND {t}"), ("nan", f"{f} IS NULL"))
        )
        + " FROM x GROUP BY 1",
        f"x AS (SELECT *, lead(close, 5) {W} / nullif(close, 0) - 1 AS f5, lead(close, 15) {W} / nullif(close, 0) - 1 AS f15 FROM b)",
    ),
    "feature_summary": q(
        "SELECT pair, count(*) AS rows_before, greatest(count(*) - 29, 0) AS rows_after, least(count(*), 29) AS rows_removed, 9 AS num_total_columns, 2 AS num_feature_columns FROM b GROUP BY 1"
    ),
    "session_label_distribution": q("SELECT session, label, count(*) AS n FROM l GROUP BY 1, 2", LABELLED),
    "class_weights": q(
        "SELECT pair, label, n, round(sum(n) OVER (PARTITION BY pair) / (3 * n + 1e-8), 6) AS weight FROM (SELECT pair, label, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY 1, 2)",
        LABELLED,
    ),
    "split_purge": q("SELECT pair, ts, split, close FROM sp", SPLIT.format(src="b")),
    "fold_boundaries": q("SELECT pair, fold, kind, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM k GROUP BY 1, 2, 3", FOLDS),
    "split_label_stats": q(
        "SELECT pair, split, count(*) AS n, " + ", ".join(f"round(avg((label = {v})::INT) * 100, 6) AS pct_{n}" for n, v in (("long", 1), ("short", -1), ("flat", 0)))
        + ", round(avg((session = 'Asia')::INT) * 100, 6) AS pct_asia, min(ts) AS first_ts, max(ts) AS last_ts FROM sp GROUP BY 1, 2",
        LABELLED, SPLIT.format(src="l"),
    ),
    "split_manifest": q(
        "SELECT pair, count(*) AS total_rows, "
        + ", ".join(
            f"count(*) FILTER (split = '{s}') AS {s}_rows, min(ts) FILTER (split = '{s}') AS {s}_start, max(ts) FILTER (split = '{s}') AS {s}_end, "
            + ", ".join(f"round(avg((label = {v})::INT) FILTER (split = '{s}') * 100, 6) AS {s}_{n}_pct" for n, v in (("long", 1), ("flat", 0), ("short", -1)))
            for s in ("train", "val", "test")
        )
        + ", '2024-01-15 23:59:59' AS configured_train_end, '2024-01-22 23:59:59' AS configured_val_end, 15 AS purge_rows FROM sp GROUP BY 1",
        LABELLED, SPLIT.format(src="l"),
    ),
    "session_training": q(
        "SELECT pair, train_set, count(*) AS n FROM sp, (VALUES ('global', ['Asia', 'London', 'Overlap', 'New_York']), ('london', ['London', 'Overlap']), ('ny', ['New_York', 'Overlap']), ('asia', ['Asia'])) v(train_set, labels)"
        " WHERE split = 'train' AND list_contains(labels, session) GROUP BY 1, 2",
        LABELLED, SPLIT.format(src="l"),
    ),
    "date_window": q("SELECT pair, ts, close FROM b WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09 23:59:59'"),
    "scaler_stats": q(
        " UNION ALL ".join(
            f"SELECT pair, {k}::INT AS pos, '{c}' AS feature, round(avg(coalesce({c}, 0)), 6) AS mean, round(CASE WHEN stddev_pop(coalesce({c}, 0)) = 0 THEN 1 ELSE stddev_pop(coalesce({c}, 0)) END, 6) AS scale FROM r GROUP BY 1"
            for k, c in enumerate(("close", "volume", "ret"))
        ),
        RET,
    ),
    "ma_cross_sma": q(
        f"SELECT pair, ts, signal FROM (SELECT *, CASE WHEN rn <= 19 THEN 0 WHEN above AND NOT lag(above, 1, false) {W} THEN 1 WHEN NOT above AND lag(above, 1, true) {W} THEN -1 ELSE 0 END::INT AS signal FROM y) WHERE signal != 0",
        f"x AS (SELECT *, {full('avg', 'close', 5)} AS f, {full('avg', 'close', 20)} AS s, row_number() {W} AS rn FROM b), y AS (SELECT *, coalesce(f > s, false) AS above FROM x)",
    ),
    "ma_cross_ema": f"WITH RECURSIVE {BARS}, {NUMBERED}, {ewm_sql([5, 20])}, y AS (SELECT s.pair, s.ts, i, e0 > e1 AS above FROM s JOIN z USING (pair, i))"
    f" SELECT pair, ts, signal FROM (SELECT *, CASE WHEN i <= 19 THEN 0 WHEN above AND NOT lag(above, 1, false) {W} THEN 1 WHEN NOT above AND lag(above, 1, true) {W} THEN -1 ELSE 0 END::INT AS signal FROM y) WHERE signal != 0",
    "macd_cross": f"WITH RECURSIVE {BARS}, {NUMBERED}, {ewm_sql([6, 13])}, m AS (SELECT pair, i, e0 - e1 AS line FROM z),"
    " zz(pair, i, e) AS (SELECT pair, i, line FROM m WHERE i = 1 UNION ALL SELECT m.pair, m.i, zz.e + (m.line - zz.e) * (2.0::DOUBLE / 6) FROM zz JOIN m ON m.pair = zz.pair AND m.i = zz.i + 1),"
    " y AS (SELECT s.pair, s.ts, s.i, line > e AS above FROM s JOIN m USING (pair, i) JOIN zz USING (pair, i))"
    f" SELECT pair, ts, signal FROM (SELECT *, CASE WHEN i <= 17 THEN 0 WHEN above AND NOT lag(above, 1, false) {W} THEN 1 WHEN NOT above AND lag(above, 1, true) {W} THEN -1 ELSE 0 END::INT AS signal FROM y) WHERE signal != 0",
    "momentum": q("SELECT pair, ts, signal FROM sig WHERE signal != 0", momentum(24)),
    "donchian": q(
        f"SELECT pair, ts, signal FROM (SELECT *, CASE WHEN rn <= 20 THEN 0 WHEN o AND NOT lag(o, 1, false) {W} THEN 1 WHEN u AND NOT lag(u, 1, false) {W} THEN -1 ELSE 0 END::INT AS signal FROM y) WHERE signal != 0",
        f"x AS (SELECT *, max(high) {over(20, '1 PRECEDING')} AS hi, min(low) {over(20, '1 PRECEDING')} AS lo, row_number() {W} AS rn FROM b),"
        " y AS (SELECT *, rn > 20 AND close > hi AS o, rn > 20 AND close < lo AS u FROM x)",
    ),
    "bollinger": q(
        f"SELECT pair, ts, signal FROM (SELECT *, CASE WHEN rn <= 20 THEN 0 WHEN o AND NOT lag(o, 1, false) {W} THEN 1 WHEN u AND NOT lag(u, 1, false) {W} THEN -1 ELSE 0 END::INT AS signal FROM y) WHERE signal != 0",
        f"x AS (SELECT *, {full('avg', 'close', 20)} AS m, {full('stddev_samp', 'close', 20)} AS sd, row_number() {W} AS rn FROM b),"
        " y AS (SELECT *, coalesce(close > m + 2 * sd, false) AS o, coalesce(close < m - 2 * sd, false) AS u FROM x)",
    ),
    "rsi": f"WITH RECURSIVE {BARS}, {NUMBERED}, {WILDER} SELECT pair, ts, round(rsi, 6) AS rsi_14 FROM rs",
    "rsi_reversion": f"WITH RECURSIVE {BARS}, {NUMBERED}, {WILDER}, y AS (SELECT pair, ts, i, coalesce(rsi, 50) AS r, lag(coalesce(rsi, 50)) {W} AS l FROM rs)"
    " SELECT pair, ts, signal FROM (SELECT *, CASE WHEN i <= 14 THEN 0 WHEN l <= 40 AND r > 40 THEN 1 WHEN l >= 60 AND r < 60 THEN -1 ELSE 0 END::INT AS signal FROM y) WHERE signal != 0",
    "ewm": f"WITH RECURSIVE {BARS}, {NUMBERED}, {ewm_sql([20])} SELECT pair, ts, round(e0, 6) AS ema_20 FROM s JOIN z USING (pair, i)",
    "cooldown": f"WITH RECURSIVE {BARS}, {momentum(12)}, z(pair, rn, signal, free) AS (SELECT pair, rn, signal, CASE WHEN signal != 0 THEN rn + 11 ELSE 0 END FROM sig WHERE rn = 1 UNION ALL"
    " SELECT s.pair, s.rn, CASE WHEN s.rn >= z.free THEN s.signal ELSE 0 END, CASE WHEN s.signal != 0 AND s.rn >= z.free THEN s.rn + 11 ELSE z.free END FROM z JOIN sig s ON s.pair = z.pair AND s.rn = z.rn + 1)"
    " SELECT pair, ts, z.signal FROM z JOIN sig USING (pair, rn) WHERE z.signal != 0",
    "signal_distribution": q(
        "SELECT pair, count(*) FILTER (signal = 1) AS n_long, count(*) FILTER (signal = -1) AS n_short, count(*) FILTER (signal = 0) AS n_flat FROM sig GROUP BY 1",
        momentum(24),
    ),
    "position_ffill": q("SELECT pair, ts, signal, position FROM pos", momentum(24), positions()),
    "session_mask": q(
        "SELECT pair, ts, CASE WHEN hour(ts) >= 7 AND hour(ts) < 16 THEN signal ELSE 0 END AS s_london, CASE WHEN hour(ts) >= 23 OR hour(ts) < 8 THEN greatest(signal, 0) ELSE 0 END AS s_asia,"
        " CASE WHEN hour(ts) >= 13 AND hour(ts) < 22 THEN least(signal, 0) ELSE 0 END AS s_ny, CASE WHEN hour(ts) * 60 + minute(ts) >= 810 THEN signal ELSE 0 END AS s_late FROM sig",
        momentum(24),
    ),
    "drawdown": q(f"SELECT pair, ts, (close - p) / nullif(p, 0) AS dd FROM (SELECT *, max(close) {W} AS p FROM b)"),
    "rolling_sharpe": q(
        f"SELECT pair, ts, round(CASE WHEN count(x) {over(47)} >= 2 AND max(x) {over(47)} != min(x) {over(47)} THEN avg(x) {over(47)} / stddev_pop(x) {over(47)} * sqrt(98280) ELSE 0 END, 4) AS sharpe FROM y",
        RET, "y AS (SELECT *, coalesce(ret, 0) AS x FROM r)",
    ),
    "buy_and_hold": q("SELECT pair, (arg_max(close, ts) - arg_min(close, ts)) / nullif(arg_min(close, ts), 0) AS bah_return FROM b GROUP BY 1"),
    "signal_returns": q(f"SELECT pair, ts, coalesce(signal * (lead(close) {W} / nullif(close, 0) - 1), 0) AS signal_return FROM sig", momentum(24)),
    "price_diff_returns": q(f"SELECT pair, ts, coalesce((close - lag(close) {W}) * position, 0) AS pnl FROM pos", momentum(24), positions()),
    "walk_forward": q(
        "SELECT pair, fold, count(*) AS n, sum(position)::BIGINT AS net_position, count(*) FILTER (signal != 0) AS n_signals FROM pos GROUP BY 1, 2",
        FOLDS, "kt AS (SELECT * FROM k WHERE kind = 'train')", momentum(24, "kt", "pair, fold"), positions("sig", "pair, fold"),
    ),
    "trade_metrics": (
        "WITH t AS (SELECT l_suppkey % 5 AS run, round((l_discount - 0.05) * l_quantity, 6) AS p, l_linenumber AS h FROM lineitem),"
        " x AS (SELECT *, p / 100 AS r, round(p * 3, 4) AS d FROM t),"
        " y AS (SELECT run, count(*) AS n_trades, floor(greatest(1.0, 98280 / greatest(avg(h), 1.0))) AS tpy, avg(r) AS m, stddev_pop(r) AS s, stddev_pop(r) FILTER (r < 0) AS sl,"
        " avg(r) FILTER (r > 0) AS mw, stddev_pop(r) FILTER (r > 0) AS sw, avg((r >= 0)::INT) AS wr, sum(r) FILTER (r > 0) AS w, abs(sum(r) FILTER (r < 0)) AS l, avg(h) AS ah, 10000 + sum(d) AS cf FROM x GROUP BY 1)"
        " SELECT run, n_trades, round(m / s * sqrt(tpy), 6) AS net_sharpe, round(m / sl * sqrt(tpy), 6) AS sortino, round(mw / sw * sqrt(tpy), 6) AS gross_sharpe, round(wr, 6) AS win_rate,"
        " round(least(w / l, 999), 6) AS profit_factor, round(ah, 6) AS avg_trade_bars, round(cf, 6) AS capital_final FROM y"
    ),
    "composite_score": q(
        "SELECT pair, strategy, session, direction, round(composite, 6) AS composite, CASE WHEN composite >= 80 THEN 'A' WHEN composite >= 60 THEN 'B' WHEN composite >= 40 THEN 'C' WHEN composite >= 20 THEN 'D' ELSE 'F' END AS grade FROM sc",
        base=OUTCOMES,
    ),
    "topk_per_group": q(
        "SELECT pair, strategy, score, family FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY score DESC, strategy) AS r, count(*) OVER (PARTITION BY pair) AS c FROM st WHERE score > -0.05) WHERE r <= greatest(1, floor(0.4 * c))",
        base=STRAT,
    ),
    "family_floor": q(
        "SELECT * FROM kept UNION ALL SELECT pair, strategy, score, family FROM (SELECT st.*, row_number() OVER (PARTITION BY st.pair, st.family ORDER BY score DESC, strategy) AS n FROM st"
        " WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.pair = st.pair AND kept.family = st.family)) WHERE n = 1",
        "kept AS (SELECT pair, strategy, score, family FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY score DESC, strategy) AS r, count(*) OVER (PARTITION BY pair) AS c FROM st WHERE score > 0) WHERE r <= greatest(1, floor(0.2 * c)))",
        base=STRAT,
    ),
    "group_argmax": q(
        "SELECT pair, strategy, session, direction, round(composite, 6) AS composite FROM (SELECT *, row_number() OVER (PARTITION BY pair, strategy ORDER BY composite DESC, session NULLS FIRST, direction) AS n FROM sc) WHERE n = 1",
        base=OUTCOMES,
    ),
    "argmax_or_baseline": q(
        "SELECT a.pair, a.strategy, a.session, round(CASE WHEN coalesce(b.composite > a.composite, false) THEN b.composite ELSE a.composite END, 6) AS composite, coalesce(b.composite > a.composite, false) AS tuned"
        " FROM (SELECT * FROM sc WHERE direction = 0) a LEFT JOIN (SELECT * FROM sc WHERE direction = 1) b ON a.pair = b.pair AND a.strategy = b.strategy AND a.session IS NOT DISTINCT FROM b.session",
        base=OUTCOMES,
    ),
    "fold_aggregate": q("SELECT * FROM fs", base=FOLD_RUNS),
    "final_rank": q(
        "SELECT pair, strategy, stability, row_number() OVER (ORDER BY stability DESC, pair, strategy)::INT AS rank FROM fs WHERE n_trades >= 10 AND negative_folds <= 3",
        base=FOLD_RUNS,
    ),
    "transfer_pivot": q(
        "SELECT t.train_session, " + ", ".join(f"avg(net_sharpe) FILTER (eval_session = '{s}') AS {s}" for s in ("asia", "global", "london", "ny"))
        + f" FROM (SELECT unnest({SESSIONS}) AS train_session) t LEFT JOIN (SELECT * FROM tr WHERE spread_mult = 1.0) USING (train_session) GROUP BY 1",
        base=TRANSFERS,
    ),
    "generalisability": q(
        "SELECT train_session, count(*) FILTER (train_session != eval_session) AS n_out, round(avg(net_sharpe) FILTER (train_session = eval_session), 6) AS in_domain,"
        " round(avg(net_sharpe) FILTER (train_session != eval_session), 6) AS out_of_domain,"
        " round(avg(net_sharpe) FILTER (train_session = eval_session) - avg(net_sharpe) FILTER (train_session != eval_session), 6) AS gap FROM tr WHERE spread_mult = 1.0 GROUP BY 1",
        base=TRANSFERS,
    ),
    "breakeven": (
        "WITH r AS (SELECT l_partkey % 40 AS run, CASE l_linenumber WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 2.0 END::DOUBLE AS m, round(avg(CASE WHEN l_partkey % 20 = 3 AND l_linenumber <= 2 OR l_partkey % 20 = 4 AND l_linenumber > 1 THEN 0.0 ELSE l_quantity - 25.5 END), 4) AS v FROM lineitem GROUP BY 1, 2),"
        " d AS (SELECT *, lead(m) OVER w AS m2, lead(v) OVER w AS v2 FROM r WINDOW w AS (PARTITION BY run ORDER BY m)),"
        " g AS (SELECT run, count(*) AS n, arg_min(round(m - v * (m2 - m) / CASE WHEN v2 = v THEN 1 ELSE v2 - v END, 2), m) FILTER (v * v2 <= 0) AS z, min(v) AS lo, max(v) FILTER (m = 1.0) AS at_one FROM d GROUP BY 1)"
        " SELECT run, CASE WHEN z IS NOT NULL THEN printf('%.2f', z) WHEN lo >= 0 THEN '>2.0' ELSE '<0.5' END AS breakeven, at_one FROM g WHERE n >= 2"
    ),
    "dm_test": q(
        "SELECT count(d) AS n, round(avg(d), 6) AS mean, round(var_samp(d), 6) AS var, round(avg(d) / sqrt(var_samp(d) / count(d)), 3) AS stat FROM (SELECT click - \"view\" AS d FROM wide) HAVING count(d) > 0",
        WIDE,
    ),
    "classification_report": q(
        "SELECT pair, sum(have)::BIGINT AS n, round(sum(tp) / sum(have), 6) AS accuracy, round(avg(2 * tp / (have + said)), 6) AS macro_f1 FROM (SELECT coalesce(y.pair, p.pair) AS pair, coalesce(tp, 0) AS tp, coalesce(have, 0) AS have, coalesce(said, 0) AS said"
        " FROM (SELECT pair, label AS c, count(*) FILTER (label = pred) AS tp, count(*) AS have FROM x GROUP BY 1, 2) y FULL JOIN (SELECT pair, pred AS c, count(*) AS said FROM x GROUP BY 1, 2) p ON y.pair = p.pair AND y.c = p.c) GROUP BY 1",
        LABELLED,
        f"h AS (SELECT *, {ret(5)} AS past FROM l WHERE label IS NOT NULL), x AS (SELECT pair, label, -CASE WHEN past > 0.25 THEN 1 WHEN past < -0.25 THEN -1 ELSE 0 END AS pred FROM h)",
    ),
    "family_performance": q(
        "SELECT family, round(avg(m), 6) AS mean_score, arg_max(pair, (m, pair)) AS best_pair, arg_min(pair, (m, pair)) AS worst_pair FROM (SELECT family, pair, round(avg(score), 6) AS m FROM st GROUP BY 1, 2) GROUP BY 1",
        base=STRAT,
    ),
    "strategy_summary": q(
        "SELECT s AS strategy, coalesce(runs, 0) AS runs, coalesce(mean_sharpe, 0) AS mean_sharpe FROM (SELECT 'S' || lpad(i::VARCHAR, 2, '0') AS s FROM range(15) g(i)) LEFT JOIN (SELECT strategy, count(*) AS runs, round(avg(net_sharpe), 6) AS mean_sharpe FROM sc WHERE composite > 0 GROUP BY 1) ON s = strategy",
        base=OUTCOMES,
    ),
    "best_and_worst": q(
        "SELECT pair, arg_max(w, (composite, strategy, coalesce(session, '-'), direction)) AS best_run, arg_min(w, (net_sharpe, strategy, coalesce(session, '-'), direction)) AS worst_run FROM (SELECT *, strategy || '/' || coalesce(session, '-') || '/' || direction AS w FROM sc) GROUP BY 1",
        base=OUTCOMES,
    ),
    "champion_runner_up": q(
        "SELECT row_number() OVER (ORDER BY score DESC, strategy)::INT AS place, strategy, pair, score FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY score DESC, pair) AS n FROM st) WHERE n = 1 ORDER BY score DESC, strategy LIMIT 2",
        base=STRAT,
    ),
    "legacy_top_n": q(
        "SELECT strategy, mean, std FROM (SELECT strategy, round(avg(net_sharpe), 6) AS mean, round(stddev_pop(net_sharpe), 6) AS std FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY net_sharpe DESC, pair) AS k FROM"
        " (SELECT *, row_number() OVER (PARTITION BY strategy, pair ORDER BY net_sharpe DESC, session NULLS FIRST, direction) AS n FROM sc) WHERE n = 1) WHERE k <= 3 GROUP BY 1) WHERE std <= 1.5 ORDER BY mean DESC, std, strategy LIMIT 10",
        base=OUTCOMES,
    ),
    "run_status": (
        "WITH x AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_custkey % 100 END AS nb FROM orders)"
        " SELECT CASE WHEN nb IS NULL THEN 'MISSING_FILE' WHEN nb = 0 THEN 'NO_DATA_IN_WINDOW' WHEN 20 >= nb THEN 'SKIP_WARMUP_GT_DATA' WHEN o_orderkey % 5 = 0 THEN 'ZERO_SIGNALS' WHEN o_custkey % 3 = 0 THEN 'ZERO_TRADES' ELSE 'OK' END AS status, count(*) AS n FROM x GROUP BY 1"
    ),
    "spec_flags": (
        "WITH x AS (SELECT CASE WHEN l_linenumber % 3 != 0 THEN l_quantity END AS tp, CASE WHEN l_linenumber % 4 != 0 THEN l_quantity / 2 END AS sl FROM lineitem)"
        " SELECT concat_ws('|', CASE WHEN (tp IS NULL) != (sl IS NULL) THEN 'PARTIAL_TP_SL' END, CASE WHEN tp <= 10 THEN 'TP_LE_SPREAD' END, CASE WHEN sl <= 10 THEN 'SL_LE_SPREAD' END) AS flags, count(*) AS n FROM x GROUP BY 1"
    ),
    "model_codes": (
        "WITH x AS (SELECT c_custkey AS k, ['eurusd', 'USDJPY', 'gbpusd', 'abcdef'][c_custkey % 4 + 1] AS p, ['lr', 'LSTM', 'xx'][(c_custkey + c_nationkey) % 3 + 1] AS t, ['gl', 'ldn', 'NY', 'as', 'lo'][c_nationkey % 5 + 1] AS s FROM customer),"
        " y AS (SELECT *, k % 17 > 0 AND k % 11 > 0 AND k % 13 > 0 AS whole, CASE WHEN k % 17 = 0 THEN '' WHEN k % 11 = 0 THEN p || '-' || t WHEN k % 13 = 0 THEN p || '-' || t || '-' || s || '-d' ELSE p || '-' || t || '-' || s END AS code FROM x)"
        " SELECT code, count(*) AS n, CASE WHEN whole AND p != 'abcdef' THEN upper(p) END AS pair, CASE WHEN whole AND t != 'xx' THEN upper(t) END AS type,"
        " CASE WHEN whole THEN CASE s WHEN 'gl' THEN 'global' WHEN 'ldn' THEN 'london' WHEN 'NY' THEN 'ny' WHEN 'as' THEN 'asia' END END AS session FROM y GROUP BY 1, 3, 4, 5"
    ),
    "in_domain_vs_rest": q(
        "SELECT ts, max(ret) FILTER (pair = 'click') AS own, round(avg(ret) FILTER (pair != 'click'), 6) AS rest FROM r WHERE ret IS NOT NULL GROUP BY 1", RET
    ),
    "sequence_windows": q(
        f"SELECT pair, ts, CASE WHEN count(*) {over(14)} = 15 THEN 15 END::INT AS steps, round(CASE WHEN count(*) {over(14)} = 15 THEN sum(close::FLOAT::DOUBLE) {over(14)} END, 6) AS total FROM b"
    ),
    "config_grid": (
        "SELECT pair, strategy, session, direction FROM (SELECT DISTINCT event_type AS pair FROM events), (SELECT unnest(['MACrossover_f20_s50_EMA', 'MACrossover_f50_s200_EMA', 'MACrossover_f20_s50_SMA',"
        " 'Momentum_lb60', 'Momentum_lb120', 'Donchian_p20', 'Donchian_p55', 'RSI_p14_os30_ob70', 'RSI_p14_os20_ob80', 'BB_p20_std2_0', 'BB_p60_std2_0', 'MACD_f26_s65_sig9', 'MACD_f78_s195_sig13']) AS strategy),"
        " (SELECT unnest([NULL, 'london', 'ny']) AS session), (SELECT unnest(['both', 'long_only', 'short_only']) AS direction)"
    ),
}

# The trade simulator: a fold over rows that carries the open trade.  ``pos`` holds bars
# with position and row number rn per key, ``v`` the settings.
def simulator(keys: str) -> str:
    k, same = keys.split(", "), " AND ".join(f"s.{x} = z.{x}" for x in keys.split(", "))
    mine = ", ".join(f"z.{x}" for x in k)
    return (
        f"z({keys}, variant, i, side, entry, since, xs, xe, xa, why) AS (SELECT {keys}, variant, 1::BIGINT, 0, 0.0::DOUBLE, 0::BIGINT, 0, 0.0::DOUBLE, 0::BIGINT, NULL::VARCHAR FROM (SELECT DISTINCT {keys} FROM pos), v"
        f" UNION ALL SELECT {keys}, variant, i, CASE WHEN why IS NOT NULL OR side = 0 THEN p ELSE side END, CASE WHEN (why IS NOT NULL OR side = 0) AND p != 0 THEN c ELSE entry END,"
        " CASE WHEN (why IS NOT NULL OR side = 0) AND p != 0 THEN i - 1 ELSE since END, side, entry, since, why FROM ("
        f" SELECT {mine}, z.variant, s.rn AS i, z.side, z.entry, z.since, s.position AS p, s.close AS c,"
        " CASE WHEN z.side = 0 THEN NULL WHEN tp IS NOT NULL AND z.side * (s.close - z.entry) >= tp THEN 'TP' WHEN sl IS NOT NULL AND z.side * (s.close - z.entry) <= -sl THEN 'SL'"
        " WHEN mh IS NOT NULL AND s.rn - 1 - z.since >= mh THEN 'MAX_HOLD' WHEN s.position = -z.side THEN 'SIGNAL_FLIP' END AS why"
        f" FROM z JOIN pos s ON {same} AND s.rn = z.i + 1 JOIN v ON v.variant = z.variant)),"
        # a trade that is open after the last row closes there
        f" ended AS (SELECT {keys}, max(rn) AS n FROM pos GROUP BY {keys}),"
        f" closed AS (SELECT {keys}, variant, i, xs, xe, xa, why FROM z WHERE why IS NOT NULL UNION ALL"
        f" SELECT {keys}, variant, i, side, entry, since, 'END_OF_DATA' FROM z JOIN ended USING ({keys}) WHERE i = n AND side != 0),"
        f" trades AS (SELECT {mine}, z.variant::INT AS variant, i, xa::INT AS entry_bar, (i - 1)::INT AS exit_bar, (i - 1 - xa)::INT AS bars_held, xs::INT AS direction, round(xe, 6) AS entry_price, round(s.close, 6) AS exit_price,"
        " xs * (s.close - xe) / nullif(xe, 0) - 0.5 / nullif(xe, 0) AS net, why AS exit_reason FROM closed z"
        f" JOIN pos s ON {same} AND s.rn = z.i)"
    )


SIMULATED = f"WITH RECURSIVE {BARS}, {momentum(24)}, {positions()}, v(variant, tp, sl, mh) AS (VALUES (0, 20.0, 10.0, 24), (1, NULL, NULL, NULL)), {simulator('pair')}"
SQL["trade_sim"] = SIMULATED + (
    " SELECT pair, variant, entry_bar, exit_bar, bars_held, direction, entry_price, exit_price, round(round(net * 100, 6) + 1e-9, 4) AS pnl_pct, exit_reason FROM trades"
)

# Events one by one: numbered in time order, the number standing for the clock.
TICKED = "t AS (SELECT event_type AS pair, value AS close, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS ts FROM events)"
SQL["trade_sim_ticks"] = (
    f"WITH RECURSIVE {TICKED}, {momentum(24, 't')}, {positions()}, v(variant, tp, sl, mh) AS (VALUES (0, 20.0, 10.0, 24), (1, NULL, NULL, NULL)), {simulator('pair')}"
    " SELECT pair, variant, entry_bar, exit_bar, bars_held, direction, entry_price, exit_price, round(round(net * 100, 6) + 1e-9, 4) AS pnl_pct, exit_reason FROM trades"
)
SQL["regime"] = (
    f"WITH {TICKED}, v AS (SELECT *, {full('stddev_samp', 'close', 30)} AS rv FROM t),"
    f" x AS (SELECT *, CASE WHEN count(rv) {W} >= 30 THEN quantile_cont(rv, 0.8) OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS q FROM v)"
    " SELECT pair, event_id, round(q, 6) AS q80, coalesce(rv > q, false)::INT AS high FROM x"
)

# Stages: dense days, nothing lost by features and labels, purged splits.
SQL["stage_manifest"] = q(
    "SELECT stage, pair, 'DONE' AS status, n AS rows, 'PRESENT' AS second_run FROM (SELECT pair, count(*) AS n FROM dense GROUP BY 1), (VALUES ('clean'), ('features'), ('labels')) v(stage)"
    " UNION ALL SELECT 'splits', pair, 'DONE', count(*), 'PRESENT' FROM sp GROUP BY 2",
    "dense AS (SELECT * EXCLUDE c FROM (SELECT *, count(*) OVER (PARTITION BY pair, ts::DATE) AS c FROM b) WHERE c >= 18)",
    SPLIT.format(src="dense"),
)

SQL["set_operations"] = (
    "WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 150000)"
    + " UNION ALL ".join(
        f" SELECT '{n}' AS op, count(*) AS n, coalesce(sum(k), 0)::BIGINT AS total FROM ({sql})"
        for n, sql in (
            ("union_all", "SELECT k FROM a UNION ALL SELECT k FROM b"),
            ("union", "SELECT k FROM a UNION SELECT k FROM b"),
            ("intersect", "SELECT k FROM a INTERSECT SELECT k FROM b"),
            ("except", "SELECT k FROM a EXCEPT SELECT k FROM b"),
        )
    )
)

SQL["deterministic_sample"] = "SELECT o_orderkey, o_custkey FROM orders WHERE substr(md5(o_orderkey::VARCHAR), 1, 2) = '00'"

# Realised equity: the running product over closed trades, in the order of their exits.
SQL["curve_metrics"] = SIMULATED + (
    ", eq AS (SELECT pair, i, product(1 + net) OVER (PARTITION BY pair ORDER BY i) AS e FROM trades WHERE variant = 0 AND exit_reason != 'END_OF_DATA' UNION ALL SELECT DISTINCT pair, 0, 1.0 FROM pos),"
    " pk AS (SELECT *, max(e) OVER (PARTITION BY pair ORDER BY i) AS p FROM eq),"
    " m AS (SELECT pair, arg_max(e, i) - 1 AS total, min((e - p) / p) AS dd FROM pk GROUP BY 1)"
    " SELECT m.pair, round(turnover, 6) AS turnover, sign(total) * round(log10(1 + abs(total)), 6) AS log_total_return, sign(dd) * round(log10(1 + abs(dd)), 6) AS log_max_drawdown,"
    " coalesce(sign(CASE WHEN dd < 0 THEN total / abs(dd) END) * round(log10(1 + abs(CASE WHEN dd < 0 THEN total / abs(dd) END)), 6), 0) AS log_calmar"
    " FROM m JOIN (SELECT pair, avg((position != 0)::INT) AS turnover FROM pos GROUP BY 1) USING (pair)"
)

# Diebold-Mariano of all pairs of instruments; p by Simpson's rule.
SQL["dm_p_value"] = q(
    "SELECT comparison, a, b, n, round(stat, 3) AS stat, round(CASE WHEN stat IS NULL THEN 1 ELSE greatest(0, 1 - 2 * exp(lgamma((d + 1) / 2) - lgamma(d / 2)) / sqrt(d * pi()) * area) END, 3) AS p FROM"
    " (SELECT x.*, (SELECT sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(k * t / 2000, 2) / d, -(d + 1) / 2)) * t / 2000 / 3 FROM range(2001) g(k)) AS area FROM x)",
    RET,
    "y AS (SELECT l.pair || '_vs_' || r2.pair AS comparison, l.pair AS a, r2.pair AS b, -l.ret + r2.ret AS v FROM r l JOIN r r2 USING (ts) WHERE l.pair < r2.pair AND l.ret IS NOT NULL AND r2.ret IS NOT NULL),"
    " x0 AS (SELECT comparison, a, b, count(*) AS n, CASE WHEN count(*) >= 10 AND var_samp(v) > 0 THEN round(avg(v) / sqrt(var_samp(v) / count(*)), 4) END AS stat FROM y GROUP BY 1, 2, 3),"
    " x AS (SELECT *, (n - 1)::DOUBLE AS d, least(abs(stat), 40) AS t FROM x0)",
)

# The same by position: returns numbered within each series.
SQL["dm_by_position"] = SQL["dm_p_value"].replace("FROM r l JOIN r r2 USING (ts)", "FROM rn l JOIN rn r2 USING (place)").replace(
    "y AS (", "rn AS (SELECT pair, ret, row_number() OVER (PARTITION BY pair ORDER BY ts) AS place FROM r WHERE ret IS NOT NULL), y AS (", 1
)
SQL["trade_log"] = SQL["trade_sim"]
SQL["worst_fall"] = (
    "SELECT event_type AS pair, round(min((value - p) / p), 6) AS worst_fall FROM"
    " (SELECT *, max(value) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS p FROM events WHERE value > 0) GROUP BY 1"
)
_IN_SESSION = f"ss AS (SELECT * FROM (SELECT *, {SESSION} AS session FROM b) WHERE session IN ('London', 'Overlap'))"
_CLOSES = (
    "SELECT pair, ts, CASE WHEN count(*) OVER w = 3 THEN array_to_string(list(round(close::FLOAT::DOUBLE * 100)::BIGINT) OVER w, ',') END AS closes"
    " FROM {src} WINDOW w AS (PARTITION BY pair{island} ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
)
SQL["session_windows"] = q(_CLOSES.format(src="ss", island=""), _IN_SESSION)
SQL["gap_aware_windows"] = q(
    _CLOSES.format(src="isl", island=", island"),
    _IN_SESSION,
    f"gp AS (SELECT *, coalesce(ts > lag(ts) {W} + INTERVAL 1 HOUR, true) AS gap FROM ss), isl AS (SELECT *, sum(gap::INT) {W} AS island FROM gp)",
)
SQL["sample_rows"] = (
    "SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('7|' || o_orderkey), o_orderkey) AS n FROM orders) WHERE n <= 40"
)
SQL["sample_fraction"] = (
    "SELECT l_orderkey, l_linenumber, l_returnflag FROM (SELECT *, count(*) OVER (PARTITION BY l_returnflag) AS c,"
    " row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('0|' || l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= floor(0.01::DOUBLE * c + 0.5)"
)
SQL["numbered_rows"] = (
    "SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders"
)
SQL["archive_round_trip"] = q("SELECT pair, ts, open, high, low, close, volume, year(ts)::INT AS year FROM b")

# All registered strategies: averages by recursion, crossings, cooldown, masks, trades.
_EDGE = (
    "CASE WHEN i <= warm THEN 0 WHEN {o} AND NOT lag({o}, 1, false) OVER w THEN 1 WHEN {u} AND {was} THEN -1 ELSE 0 END::INT"
)
_REGISTERED = [  # name, family, warm-up, cooldown
    ("MACrossover_f20_s50_EMA", "trend", 50, 60), ("MACrossover_f50_s200_EMA", "trend", 200, 30), ("MACrossover_f20_s50_SMA", "trend", 50, 60),
    ("Momentum_lb60", "momentum", 60, 60), ("Momentum_lb120", "momentum", 120, 30), ("Donchian_p20", "breakout", 20, 60), ("Donchian_p55", "breakout", 55, 30),
    ("RSI_p14_os30_ob70", "mean_reversion", 14, 60), ("RSI_p14_os20_ob80", "mean_reversion", 14, 30), ("BB_p20_std2_0", "mean_reversion", 20, 60),
    ("BB_p60_std2_0", "mean_reversion", 60, 30), ("MACD_f26_s65_sig9", "trend", 73, 60), ("MACD_f78_s195_sig13", "trend", 207, 30),
]


_HOURS = {None: "true", "london": "hour(ts) >= 7 AND hour(ts) < 16", "ny": "hour(ts) >= 13 AND hour(ts) < 22"}
_ONLY = {"both": "signal", "long_only": "greatest(signal, 0)", "short_only": "least(signal, 0)"}


def _above(name: str, src: str, cond: str, warm: int) -> str:
    return f"SELECT '{name}' AS strategy, pair, ts, i, coalesce({cond}, false) AS o, {warm} AS warm FROM {src}"


def _channel(name: str, n: int, top: str, bottom: str, since: int) -> str:
    return (
        f"SELECT '{name}' AS strategy, pair, ts, i, i > {since} AND coalesce(close > {top}, false) AS o, i > {since} AND coalesce(close < {bottom}, false) AS u, {n} AS warm FROM"
        f" (SELECT *, max(high) {over(n, '1 PRECEDING')} AS hi, min(low) {over(n, '1 PRECEDING')} AS lo, {full('avg', 'close', n)} AS m, {full('stddev_samp', 'close', n)} AS sd FROM s)"
    )


def sweep_sql(sessions: list[str | None], directions: list[str], body: str) -> str:
    of = "PARTITION BY strategy, pair ORDER BY ts"
    known = ", ".join(f"('{n}', '{f}', {k}, {wu}, {cd})" for k, (n, f, wu, cd) in enumerate(_REGISTERED))
    above = " UNION ALL ".join([
        _above("MACrossover_f20_s50_EMA", "z1", "e0 > e1", 49), _above("MACrossover_f50_s200_EMA", "z1", "e1 > e2", 199),
        _above("MACrossover_f20_s50_SMA", f"(SELECT *, {full('avg', 'close', 20)} AS f, {full('avg', 'close', 50)} AS sl FROM s)", "f > sl", 49),
        _above("MACD_f26_s65_sig9", "z2", "e3 - e4 > a", 73), _above("MACD_f78_s195_sig13", "z2", "e5 - e6 > b", 207),
    ])
    channels = " UNION ALL ".join([
        _channel("Donchian_p20", 20, "hi", "lo", 20), _channel("Donchian_p55", 55, "hi", "lo", 55),
        _channel("BB_p20_std2_0", 20, "m + 2 * sd", "m - 2 * sd", 0), _channel("BB_p60_std2_0", 60, "m + 2 * sd", "m - 2 * sd", 0),
    ])
    level = " UNION ALL ".join(
        f"SELECT 'Momentum_lb{n}' AS strategy, pair, ts, i, CASE WHEN i <= {n} THEN 0 WHEN close > max(close) {over(n, '1 PRECEDING')} THEN 1 WHEN close < min(close) {over(n, '1 PRECEDING')} THEN -1 ELSE 0 END::INT AS raw FROM s"
        for n in (60, 120)
    )
    rsi = " UNION ALL ".join(
        f"SELECT 'RSI_p14_os{lo}_ob{hi}' AS strategy, pair, ts, i, CASE WHEN i <= 14 THEN 0 WHEN l <= {lo} AND r > {lo} THEN 1 WHEN l >= {hi} AND r < {hi} THEN -1 ELSE 0 END::INT AS raw"
        f" FROM (SELECT *, coalesce(rsi, 50) AS r, lag(coalesce(rsi, 50)) {W} AS l FROM rs)"
        for lo, hi in ((30, 70), (20, 80))
    )
    masks = " UNION ALL ".join(
        f"SELECT strategy, pair, {'NULL' if s is None else repr(s)}::VARCHAR AS session, '{d}' AS direction, ts, i, close, "
        + f"CASE WHEN {_HOURS[s]} THEN {_ONLY[d]} ELSE 0 END::INT AS signal FROM sig"
        for s in sessions
        for d in directions
    )
    return (
        f"WITH RECURSIVE {BARS}, {NUMBERED}, {ewm_sql([20, 50, 200, 26, 65, 78, 195], 'e7')},"
        " zz(pair, i, a, b) AS (SELECT pair, i, e3 - e4, e5 - e6 FROM e7 WHERE i = 1 UNION ALL SELECT e7.pair, e7.i, zz.a + (e3 - e4 - zz.a) * (2.0::DOUBLE / 10), zz.b + (e5 - e6 - zz.b) * (2.0::DOUBLE / 14)"
        " FROM zz JOIN e7 ON e7.pair = zz.pair AND e7.i = zz.i + 1),"
        f" z1 AS (SELECT s.ts, e7.* FROM s JOIN e7 USING (pair, i)), z2 AS (SELECT z1.*, zz.a, zz.b FROM z1 JOIN zz USING (pair, i)),"
        f" {WILDER},"
        f" known(strategy, family, ordinal, warmup, cooldown) AS (VALUES {known}), up AS ({above}), ch AS ({channels}),"
        f" raw AS (SELECT strategy, pair, ts, i, {_EDGE.format(o='o', u='NOT o', was='lag(o, 1, true) OVER w')} AS raw FROM up WINDOW w AS ({of})"
        f" UNION ALL SELECT strategy, pair, ts, i, {_EDGE.format(o='o', u='u', was='NOT lag(u, 1, false) OVER w')} FROM ch WINDOW w AS ({of}) UNION ALL {level} UNION ALL {rsi}),"
        " cd(strategy, pair, i, signal, free) AS (SELECT strategy, pair, i, raw, CASE WHEN raw != 0 THEN i + cooldown + 1 ELSE 0 END FROM raw JOIN known USING (strategy) WHERE i = 1 UNION ALL"
        " SELECT r.strategy, r.pair, r.i, CASE WHEN r.i >= cd.free THEN r.raw ELSE 0 END, CASE WHEN r.raw != 0 AND r.i >= cd.free THEN r.i + cooldown + 1 ELSE cd.free END"
        " FROM cd JOIN raw r ON r.strategy = cd.strategy AND r.pair = cd.pair AND r.i = cd.i + 1 JOIN known k ON k.strategy = r.strategy),"
        " sig AS (SELECT cd.strategy, cd.pair, s.ts, cd.i, s.close, cd.signal FROM cd JOIN s USING (pair, i)),"
        f" masked AS (SELECT *, concat_ws('|', strategy, pair, coalesce(session, '-'), direction) AS run FROM ({masks})),"
        " p0 AS (SELECT *, coalesce(last_value(nullif(signal, 0) IGNORE NULLS) OVER (PARTITION BY run ORDER BY i), 0) AS held FROM masked),"
        " pos AS (SELECT run, i AS rn, close, signal, lag(held, 1, 0) OVER (PARTITION BY run ORDER BY i)::INT AS position FROM p0),"
        f" v(variant, tp, sl, mh) AS (VALUES (0, NULL, NULL, 24)), {simulator('run')},"
        " pnl AS (SELECT run, round(net * 100, 6) / 100 AS r, bars_held AS h FROM trades),"
        " m AS (SELECT run, count(*) AS n_trades, avg(h) AS held, CASE WHEN count(*) >= 2 AND max(r) != min(r) THEN avg(r) / stddev_pop(r) * sqrt(floor(greatest(1.0, 98280 / greatest(avg(h), 1.0)))) ELSE 0 END AS sharpe,"
        " CASE WHEN bool_or(r < 0) THEN coalesce(sum(r) FILTER (r > 0), 0) / abs(sum(r) FILTER (r < 0)) ELSE 999 END AS pf FROM pnl GROUP BY 1),"
        " d AS (SELECT run, strategy, pair, session, direction, count(*) AS n, count(*) FILTER (signal = 1) AS n_long, count(*) FILTER (signal = -1) AS n_short, count(*) FILTER (signal = 0) AS n_flat FROM masked GROUP BY ALL),"
        " any_signal AS (SELECT strategy, pair, bool_or(signal != 0) AS signals FROM sig GROUP BY 1, 2),"
        " runs AS (SELECT d.*, family, ordinal, CASE WHEN d.n <= warmup THEN 'SKIP_WARMUP_GT_DATA' WHEN NOT signals THEN 'ZERO_SIGNALS' WHEN m.n_trades IS NULL THEN 'ZERO_TRADES' ELSE 'OK' END AS status,"
        " coalesce(m.n_trades, 0) AS n_trades, coalesce(held, 0) AS held, coalesce(sharpe, 0) AS net_sharpe, coalesce(pf, 999) AS pf FROM d JOIN known USING (strategy) JOIN any_signal USING (strategy, pair) LEFT JOIN m USING (run))"
        f" {body}"
    )


_RAN = "status IN ('OK', 'ZERO_TRADES')"
SQL["variant_sweep"] = sweep_sql(
    [None, "london", "ny"], ["both", "long_only", "short_only"],
    "SELECT pair, strategy, session, direction, status, " + ", ".join(f"CASE WHEN {_RAN} THEN {c} END AS {c}" for c in ("n_trades", "n_long", "n_short", "n_flat"))
    + f", CASE WHEN {_RAN} THEN round(net_sharpe, 4) END AS net_sharpe, CASE WHEN {_RAN} THEN round(held, 6) END AS avg_trade_bars FROM runs",
)
SQL["flat_outcomes"] = sweep_sql(
    [None], ["both"],
    f"SELECT 'T1' AS tier, pair, strategy, 'val' AS split, direction, {_RAN} AS ok, status, n_trades, CASE WHEN {_RAN} THEN n_long ELSE 0 END AS signal_long, CASE WHEN {_RAN} THEN n_short ELSE 0 END AS signal_short,"
    " concat_ws(',', CASE WHEN status = 'SKIP_WARMUP_GT_DATA' THEN 'WARMUP_GT_DATA' END, CASE WHEN status IN ('ZERO_SIGNALS', 'ZERO_TRADES') THEN status END,"
    f" CASE WHEN {_RAN} AND pf >= 998 THEN 'PF_CAPPED' END) AS warning_flags FROM runs",
)
SQL["tier1_survivors"] = sweep_sql(
    [None], ["both"],
    f", sc AS (SELECT * FROM runs WHERE {_RAN}), k AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY net_sharpe DESC, ordinal) AS r, count(*) OVER (PARTITION BY pair) AS c FROM sc WHERE net_sharpe > 0),"
    " kept AS (SELECT pair, strategy, family FROM k WHERE r <= greatest(1, floor(0.4 * c))),"
    " lacking AS (SELECT sc.* FROM sc LEFT JOIN (SELECT DISTINCT pair, family, true AS there FROM kept) USING (pair, family) WHERE there IS NULL)"
    " SELECT pair, strategy FROM kept UNION ALL SELECT pair, strategy FROM (SELECT *, row_number() OVER (PARTITION BY pair, family ORDER BY net_sharpe DESC, ordinal) AS place FROM lacking) WHERE place = 1",
)

# Walk-forward: all folds of four lookbacks, those without trades as zeros.
_LOOKBACKS = (12, 24, 120, 240)
SQL["tier4_ranking"] = (
    f"WITH RECURSIVE {BARS}, {FOLDS}, kt AS (SELECT * FROM k WHERE kind = 'train'),"
    " sig AS ("
    + " UNION ALL ".join(
        f"SELECT concat_ws('|', pair, '{n}', fold) AS run, pair, 'Momentum_{n}' AS strategy, fold, ts, close, CASE WHEN row_number() OVER (PARTITION BY pair, fold ORDER BY ts) <= {n} THEN 0"
        f" WHEN close > max(close) OVER w THEN 1 WHEN close < min(close) OVER w THEN -1 ELSE 0 END::INT AS signal FROM kt WINDOW w AS (PARTITION BY pair, fold ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        for n in _LOOKBACKS
    )
    + "), sn AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts) AS rn FROM sig),"
    f" {positions('sn', 'run')}, v(variant, tp, sl, mh) AS (VALUES (0, NULL, NULL, 24)), {simulator('run')},"
    " pnl AS (SELECT run, round(net * 100, 6) / 100 AS r, bars_held AS h FROM trades),"
    " m AS (SELECT run, count(*) AS n, CASE WHEN count(*) >= 2 AND max(r) != min(r) THEN avg(r) / stddev_pop(r) * sqrt(floor(greatest(1.0, 98280 / greatest(avg(h), 1.0)))) ELSE 0 END AS sharpe FROM pnl GROUP BY 1),"
    " runs AS (SELECT pair, strategy, coalesce(n, 0) AS n, coalesce(sharpe, 0) AS sharpe FROM (SELECT DISTINCT run, pair, strategy FROM sig) LEFT JOIN m USING (run)),"
    " g AS (SELECT pair, strategy, sum(n)::BIGINT AS n_trades, count(*) FILTER (sharpe < 0) AS negative_folds, avg(sharpe) AS fm, stddev_pop(sharpe) AS fs FROM runs GROUP BY 1, 2)"
    " SELECT pair, strategy, n_trades, negative_folds, round(fm, 4) AS fold_mean, round(fs, 4) AS fold_std, row_number() OVER (ORDER BY round(fm - 0.5 * fs, 4) DESC, pair, strategy)::INT AS rank FROM g WHERE n_trades >= 10 AND negative_folds <= 3"
)

# One back-test: long signals of the London session, metrics of the trade log.
SQL["run_backtest"] = (
    f"WITH RECURSIVE {BARS.replace(', b AS (', ', b_all AS (')}, b AS (SELECT * FROM b_all WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-28 23:59:59'), {momentum(24)},"
    " mine AS (SELECT * REPLACE (CASE WHEN hour(ts) >= 7 AND hour(ts) < 16 THEN greatest(signal, 0) ELSE 0 END::INT AS signal) FROM sig),"
    f" {positions('mine')}, v(variant, tp, sl, mh) AS (VALUES (0, 20.0, 10.0, 24)), {simulator('pair')},"
    " x AS (SELECT pair, round(net * 100, 6) / 100 AS r, bars_held AS h FROM trades),"
    " y AS (SELECT pair, count(*) AS n_trades, floor(greatest(1.0, 98280 / greatest(avg(h), 1.0))) AS tpy, avg(r) AS m, CASE WHEN count(*) >= 2 AND max(r) != min(r) THEN stddev_pop(r) END AS s,"
    " CASE WHEN count(*) FILTER (r < 0) >= 2 AND max(r) FILTER (r < 0) != min(r) FILTER (r < 0) THEN stddev_pop(r) FILTER (r < 0) END AS sl, avg(r) FILTER (r > 0) AS mw,"
    " CASE WHEN count(*) FILTER (r > 0) >= 2 AND max(r) FILTER (r > 0) != min(r) FILTER (r > 0) THEN stddev_pop(r) FILTER (r > 0) END AS sw, avg((r >= 0)::INT) AS wr,"
    " coalesce(sum(r) FILTER (r > 0), 0) AS w, abs(sum(r) FILTER (r < 0)) AS l, avg(h) AS ah FROM x GROUP BY 1),"
    " c AS (SELECT pair, count(*) AS n, count(*) FILTER (signal = 1) AS n_long, count(*) FILTER (signal = -1) AS n_short, count(*) FILTER (signal = 0) AS n_flat, avg((position != 0)::INT) AS turnover FROM pos GROUP BY 1),"
    " raw AS (SELECT pair, count(*) FILTER (signal != 0) AS n_raw FROM sig GROUP BY 1)"
    " SELECT pair, CASE WHEN n <= 24 THEN 'SKIP_WARMUP_GT_DATA' WHEN n_raw = 0 THEN 'ZERO_SIGNALS' WHEN n_trades IS NULL THEN 'ZERO_TRADES' ELSE 'OK' END AS status, coalesce(n_trades, 0) AS n_trades, n_long, n_short, n_flat,"
    " round(coalesce(m / s * sqrt(tpy), 0), 4) AS net_sharpe, round(coalesce(m / sl * sqrt(tpy), 0), 4) AS sortino, round(coalesce(mw / sw * sqrt(tpy), 0), 4) AS gross_sharpe, round(coalesce(wr, 0), 4) AS win_rate,"
    " round(CASE WHEN l > 0 THEN least(w / l, 999) ELSE 999 END, 4) AS profit_factor, round(coalesce(ah, 0), 4) AS avg_trade_bars, round(turnover, 4) AS turnover"
    " FROM c JOIN raw USING (pair) LEFT JOIN y USING (pair)"
)

# Summary tables of outcomes.
SQL["run_summary"] = q(
    "SELECT fold, count(*) AS runs, round(avg(net_sharpe), 6) AS mean_sharpe, round(avg(total_return), 6) AS mean_return, round(avg(max_drawdown), 6) AS mean_drawdown, count(*) FILTER (net_sharpe >= 0) AS positive_runs, "
    + ", ".join(f"arg_min({c}, ({'-' if s == 'best' else ''}net_sharpe, pair, strategy)) AS {s}_{n}" for s in ("best", "worst") for c, n in (("pair", "pair"), ("strategy", "strategy"), ("net_sharpe", "sharpe"), ("total_return", "return")))
    + " FROM fr GROUP BY 1",
    base=FOLD_RUNS,
)
SQL["strategy_table"] = q(
    "SELECT strategy, coalesce(runs, 0) AS runs, coalesce(a, 0) AS mean_sharpe, coalesce(b, 0) AS mean_return, coalesce(c, 0) AS mean_dd, coalesce(d, 0) AS mean_trades FROM (SELECT DISTINCT 'S' || (p_partkey % 9) AS strategy FROM part)"
    " LEFT JOIN (SELECT strategy, count(*) AS runs, round(avg(net_sharpe), 6) AS a, round(avg(total_return), 6) AS b, round(avg(max_drawdown), 6) AS c, round(avg(n_trades), 6) AS d FROM fr GROUP BY 1) USING (strategy)",
    base=FOLD_RUNS,
)
SQL["family_table"] = sweep_sql(
    [None], ["both"],
    ", so AS (SELECT run, CASE WHEN count(*) FILTER (r < 0) >= 2 AND stddev_pop(r) FILTER (r < 0) > 0 THEN avg(r) / stddev_pop(r) FILTER (r < 0) * sqrt(floor(greatest(1.0, 98280 / greatest(avg(h), 1.0)))) ELSE 0 END AS sortino FROM pnl GROUP BY 1),"
    f" x AS (SELECT family, pair, net_sharpe, coalesce(sortino, 0) AS sortino FROM runs LEFT JOIN so USING (run) WHERE {_RAN}),"
    " y AS (SELECT family, pair, round(avg(net_sharpe), 6) AS m FROM x GROUP BY 1, 2),"
    " e AS (SELECT family, arg_min(pair, (-m, pair)) AS best_pair, arg_min(pair, (m, pair)) AS worst_pair FROM y GROUP BY 1)"
    " SELECT family, count(*) AS runs, round(avg(net_sharpe), 4) AS mean_sharpe, round(avg(sortino), 4) AS mean_sortino, best_pair, worst_pair FROM x JOIN e USING (family) GROUP BY ALL",
)
SQL["report_meta"] = q(
    "SELECT fold, array_to_string(list_sort(list(DISTINCT pair)), ',') AS pairs, array_to_string(list_sort(list(DISTINCT strategy)), ',') AS strategies, round(avg(capital_final) FILTER (capital_final > 0), 2) AS capital_final_avg FROM fr GROUP BY 1",
    base=FOLD_RUNS,
)
_RANKED = (
    "SELECT pair, strategy, coalesce(session, '-') AS session, direction, round(composite, 6) AS composite,"
    " row_number() OVER (ORDER BY round(composite, 6) DESC, pair, strategy, coalesce(session, '-'), direction) AS rank FROM sc"
)
SQL["ranked_results"] = q(_RANKED, base=OUTCOMES)
SQL["top_results"] = q(f"SELECT * REPLACE (rank::INT AS rank) FROM ({_RANKED}) WHERE rank <= 50", base=OUTCOMES)
SQL["session_shares"] = q(
    "SELECT pair, split, " + ", ".join(f"round(avg((session = '{s}')::INT) * 100, 2) AS {n}_pct" for s, n in (("Asia", "asia"), ("London", "london"), ("Overlap", "overlap"), ("New_York", "ny")))
    + " FROM sp GROUP BY 1, 2",
    LABELLED, SPLIT.format(src="l"),
)
SQL["prediction_histogram"] = q(
    "SELECT pair, class, count(*) FILTER (label = class) AS actual, count(*) FILTER (pred = class) AS predicted, count(*) FILTER (label = class AND pred = class) AS hits FROM x, (VALUES (-1), (0), (1)) c(class) GROUP BY 1, 2",
    LABELLED,
    f"h AS (SELECT *, {ret(5)} AS past FROM l WHERE label IS NOT NULL), x AS (SELECT pair, label, -CASE WHEN past > 0.25 THEN 1 WHEN past < -0.25 THEN -1 ELSE 0 END AS pred FROM h)",
)
SQL["daily_range_correlation"] = q(
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(\"{a}\", \"{b}\"), 6) AS corr FROM dr" for i, a in enumerate(PAIRS) for b in PAIRS[i:]),
    "dm AS (SELECT ts::DATE AS day, pair, avg(high - low) AS m FROM b GROUP BY 1, 2),"
    f" dr AS (SELECT day, {', '.join(f'max(m) FILTER (pair = {p!r}) AS {p}' for p in PAIRS)} FROM dm GROUP BY 1 HAVING count(m) = 5)",
)
SQL["legacy_selection"] = q(
    "SELECT row_number() OVER (ORDER BY fold_mean DESC, fold_std, strategy, pair)::INT AS rank, strategy, pair, session, direction, fold_mean, fold_std, negative_folds, folds FROM"
    " (SELECT strategy, pair, session, direction, round(avg(v), 6) AS fold_mean, round(stddev_pop(v), 6) AS fold_std, count(*) FILTER (v < 0) AS negative_folds, count(*) AS folds FROM places JOIN lf USING (strategy, pair) GROUP BY ALL)"
    " WHERE negative_folds <= 3 AND fold_std <= 1.5 ORDER BY fold_mean DESC, fold_std, strategy, pair LIMIT 10",
    "su AS (SELECT strategy FROM (SELECT strategy, round(avg(net_sharpe), 6) AS m FROM sc GROUP BY 1) WHERE m > -0.2 ORDER BY m DESC, strategy LIMIT 8),"
    " one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, pair ORDER BY net_sharpe DESC, session NULLS FIRST, direction) AS n FROM sc JOIN su USING (strategy)) WHERE n = 1),"
    " places AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY net_sharpe DESC, pair) AS k FROM one) WHERE k <= 3),"
    " lf AS (SELECT 'S' || lpad((l_partkey % 13)::VARCHAR, 2, '0') AS strategy, 'P' || (l_suppkey % 5) AS pair, (l_orderkey % 5)::INT AS fold, round(avg(l_quantity) - 25.3, 4) AS v FROM lineitem GROUP BY 1, 2, 3)",
    base=OUTCOMES,
)
SQL["fold_outcomes"] = SQL["tier4_ranking"][: SQL["tier4_ranking"].index(" pnl AS (")] + (
    " pnl AS (SELECT run, round(net * 100, 6) / 100 AS r, bars_held AS h FROM trades),"
    " m AS (SELECT run, count(*) AS n, avg(h) AS held, CASE WHEN count(*) >= 2 AND max(r) != min(r) THEN avg(r) / stddev_pop(r) * sqrt(floor(greatest(1.0, 98280 / greatest(avg(h), 1.0)))) ELSE 0 END AS sharpe FROM pnl GROUP BY 1),"
    " d AS (SELECT run, pair, strategy, fold, count(*) FILTER (signal = 1) AS n_long, count(*) FILTER (signal = -1) AS n_short FROM sig GROUP BY ALL)"
    " SELECT pair, strategy, fold, coalesce(n, 0) AS n_trades, n_long, n_short, round(coalesce(sharpe, 0), 4) AS net_sharpe, round(coalesce(held, 0), 4) AS avg_trade_bars FROM d LEFT JOIN m USING (run)"
)

# A price-like series: from 100 by thousandths.
PRICED = BARS.replace(", b AS (", ", b_all AS (") + (
    f", b AS (SELECT * REPLACE (100 + (sum((floor(close * 100)::BIGINT % 101) - 50) {W[:-1]} ROWS UNBOUNDED PRECEDING))::DOUBLE / 1000.0::DOUBLE AS close) FROM b_all)"
)
PRICED_RUN = (
    f"WITH RECURSIVE {PRICED}, {momentum(24)}, {positions()}, v(variant, tp, sl, mh) AS (VALUES (0, 0.2::DOUBLE, 0.15::DOUBLE, 48)),"
    f" {simulator('pair').replace('- 0.5 / nullif(xe, 0)', '- 0.01::DOUBLE / nullif(xe, 0)')}"
)
_DOLLARS = "round(10000 * coalesce(product(1 + net) OVER (PARTITION BY pair ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) * net, 4)"
SQL["trade_dollars"] = PRICED_RUN + (
    f" SELECT pair, entry_bar, exit_bar, exit_reason, round(round(net * 100, 6) + 1e-9, 5) AS pnl_pct, round({_DOLLARS} + 1e-9, 3) AS pnl_dollars FROM trades"
)
SQL["trade_curves"] = PRICED_RUN + (
    ", ev AS (SELECT p.pair, p.ts, p.rn, p.close, lag(p.close) OVER (PARTITION BY p.pair ORDER BY p.rn) AS before, t.direction, t.net, t.exit_reason, t.i FROM pos p LEFT JOIN trades t ON t.pair = p.pair AND p.rn - 1 > t.entry_bar AND p.rn - 1 <= t.exit_bar),"
    " er AS (SELECT *, CASE WHEN i = rn AND exit_reason != 'END_OF_DATA' THEN net END AS realised FROM ev),"
    " eq AS (SELECT *, product(1 + coalesce(realised, 0)) OVER (PARTITION BY pair ORDER BY rn) AS e FROM er)"
    " SELECT pair, ts, round(e, 6) AS equity, round(e * 10000, 3) AS dollars, round(CASE WHEN direction IS NULL THEN 0 WHEN realised IS NOT NULL THEN realised ELSE direction * (close - before) / before END, 6) + 0.0::DOUBLE AS bar_return FROM eq"
)
_TAIL = SQL["run_backtest"][SQL["run_backtest"].index(" x AS (SELECT pair, round(net") :]
SQL["priced_backtest"] = PRICED_RUN + "," + _TAIL.replace(
    " SELECT pair, CASE WHEN n <= 24",
    f", dl AS (SELECT pair, {_DOLLARS} AS d FROM trades), cf AS (SELECT pair, sum(d) AS gained FROM dl GROUP BY 1),"
    " eq AS (SELECT pair, i, product(1 + net) OVER (PARTITION BY pair ORDER BY i) AS e FROM trades WHERE exit_reason != 'END_OF_DATA' UNION ALL SELECT DISTINCT pair, 0, 1.0 FROM pos),"
    " pk AS (SELECT *, max(e) OVER (PARTITION BY pair ORDER BY i) AS p FROM eq), g AS (SELECT pair, arg_max(e, i) - 1 AS total, min((e - p) / p) AS dd FROM pk GROUP BY 1)"
    " SELECT pair, round(total, 6) AS total_return, round(dd, 6) AS max_drawdown, round(CASE WHEN dd < 0 THEN total / abs(dd) ELSE 0 END, 4) AS calmar, round(10000 + coalesce(gained, 0), 2) AS capital_final, CASE WHEN n <= 24",
).replace("FROM c JOIN raw USING (pair)", "FROM c JOIN raw USING (pair) JOIN g USING (pair) LEFT JOIN cf USING (pair)")


# Comparisons of an evaluation: rules on validation bars, models on test bars.
_RULES, _MODELS = {f"Rule_{n}": n for n in (6, 12, 24)}, {"LR_global": 8, "LR_london": 10, "LSTM_global": 16, "LSTM_asia": 20, "LSTM_ny": 12}
_INSIDE = {"london": "session IN ('London', 'Overlap')", "ny": "session IN ('New_York', 'Overlap')", "asia": "session = 'Asia'"}


def _runs_of(src: str, lookbacks: dict[str, int]) -> str:
    return " UNION ALL ".join(
        f"SELECT pair, ts, close, session, '{name}' AS strategy, CASE WHEN row_number() OVER (PARTITION BY pair ORDER BY ts) <= {n} THEN 0 WHEN close > max(close) OVER w THEN 1 WHEN close < min(close) OVER w THEN -1 ELSE 0 END::INT AS signal"
        f" FROM {src} WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        for name, n in lookbacks.items()
    )


def _moves(src: str, keys: str) -> str:
    move = f"(lead(close) OVER (PARTITION BY {keys} ORDER BY ts) - close) / CASE WHEN close = 0 THEN 1 ELSE close END"
    return f"(SELECT * FROM (SELECT *, {move} AS mv FROM {src}) WHERE mv IS NOT NULL)"


_SIDES = (
    f"{SPLIT.format(src='b')}, ses AS (SELECT *, {SESSION} AS session FROM sp), vb AS (SELECT * FROM ses WHERE split = 'val'), tb AS (SELECT * FROM ses WHERE split = 'test'),"
    f" vg AS ({_runs_of('vb', _RULES)}), tg AS ({_runs_of('tb', _MODELS)})"
)
_OWN = "CASE split_part(strategy, '_', 2) " + " ".join(f"WHEN '{n}' THEN CASE WHEN {c} THEN signal ELSE 0 END" for n, c in _INSIDE.items()) + " ELSE signal END"
_LABEL = "'LR/LSTM_' || s || '_{}_domain'"
_STAT = "CASE WHEN count(*) >= 10 AND var_samp(v) > 0 THEN round(avg(v) / sqrt(var_samp(v) / count(*)), 4) END AS stat"
SQL["comparison_set"] = q(
    f"SELECT pair, comparison, sa AS strategy_a, sb AS strategy_b, count(*) AS n, {_STAT} FROM"
    " (SELECT ps.*, x.value - y.value AS v FROM ps JOIN se x ON x.part = ps.part AND x.pair = ps.pair AND x.name = a JOIN se y ON y.part = ps.part AND y.pair = ps.pair AND y.name = b AND y.ts = x.ts) GROUP BY ALL",
    _SIDES,
    f"vr AS (SELECT pair, strategy, ts, signal * mv AS value FROM {_moves('vg', 'pair, strategy')}), t0 AS (SELECT *, signal * mv AS value FROM {_moves('tg', 'pair, strategy')}),"
    f" te AS (SELECT pair, strategy, split_part(strategy, '_', 2) AS s, es, strategy || '/eval=' || es AS run, ts, CASE WHEN es = 'global' {' '.join(f'OR es = {n!r} AND {c}' for n, c in _INSIDE.items())} THEN value ELSE 0 END AS value FROM t0, (VALUES ('global'), ('london'), ('ny'), ('asia')) v(es)),"
    " rb AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY c DESC, strategy) AS k FROM (SELECT pair, strategy, round(avg(value), 6) AS c FROM vr GROUP BY 1, 2 HAVING count(*) >= 10)),"
    " ml AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY c DESC, strategy, es) AS k FROM (SELECT pair, strategy, es, run, round(avg(value), 6) AS c FROM te GROUP BY ALL HAVING count(*) >= 10)),"
    " hm AS (SELECT pair, s, min(run) FILTER (es = s) AS run, count(*) FILTER (es != s) AS away FROM te WHERE s != 'global' GROUP BY 1, 2),"
    " ps AS (SELECT 'val' AS part, pair, 'best_RB_vs_BAH' AS comparison, strategy AS a, 'buy_and_hold' AS b, strategy AS sa, 'buy_and_hold' AS sb FROM rb WHERE k = 1"
    " UNION ALL SELECT 'test', pair, 'best_ML_vs_BAH', run, 'buy_and_hold', strategy, 'buy_and_hold' FROM ml WHERE k = 1"
    " UNION ALL SELECT 'val', f.pair, 'RB_champion_vs_runner_up', f.strategy, g.strategy, f.strategy, g.strategy FROM rb f JOIN rb g ON f.pair = g.pair AND f.k = 1 AND g.k = 2"
    " UNION ALL SELECT 'test', f.pair, 'ML_champion_vs_runner_up', f.run, g.run, f.run, g.run FROM ml f JOIN ml g ON f.pair = g.pair AND f.k = 1 AND g.k = 2"
    f" UNION ALL SELECT 'test', pair, 'in_domain_' || s || '_vs_transfer', run, 'transfer/' || s, {_LABEL.format('in')}, {_LABEL.format('out_of')} FROM hm WHERE run IS NOT NULL AND away > 0),"
    " se AS (SELECT 'val' AS part, pair, strategy AS name, ts, value FROM vr UNION ALL SELECT 'test', pair, run, ts, value FROM te"
    " UNION ALL SELECT 'test', pair, 'transfer/' || s, ts, avg(value) FROM te WHERE s != 'global' AND es != s GROUP BY pair, s, ts"
    f" UNION ALL SELECT 'val', pair, 'buy_and_hold', ts, mv FROM {_moves('vb', 'pair')} UNION ALL SELECT 'test', pair, 'buy_and_hold', ts, mv FROM {_moves('tb', 'pair')})",
)
SQL["model_evaluation"] = (
    f"WITH RECURSIVE {BARS}, {_SIDES}, sn AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts) AS rn FROM (SELECT * REPLACE ({_OWN} AS signal), pair || '|' || strategy AS run FROM tg)),"
    f" {positions('sn', 'run')}, v(variant, tp, sl, mh) AS (VALUES (0, NULL::DOUBLE, NULL::DOUBLE, NULL::INT), (1, NULL, NULL, NULL), (2, NULL, NULL, NULL)),"
    f" {simulator('run').replace('- 0.5 / nullif(xe, 0)', '- [0.25, 0.5, 1.0][z.variant + 1]::DOUBLE / nullif(xe, 0)')},"
    " pnl AS (SELECT run, variant, round(net * 100, 6) / 100 AS r, bars_held AS h FROM trades),"
    " m AS (SELECT run, variant, count(*) AS n, avg((r >= 0)::INT) AS wr, CASE WHEN count(*) >= 2 AND max(r) != min(r) THEN avg(r) / stddev_pop(r) * sqrt(floor(greatest(1.0, 98280 / greatest(avg(h), 1.0)))) ELSE 0 END AS sharpe FROM pnl GROUP BY 1, 2)"
    " SELECT pair, strategy, [0.5, 1.0, 2.0][variant + 1]::DOUBLE AS spread_multiplier, coalesce(n, 0) AS n_trades, CASE WHEN n IS NULL THEN 'ZERO_TRADES' ELSE 'OK' END AS status, round(coalesce(sharpe, 0), 4) AS net_sharpe, round(coalesce(wr, 0), 4) AS win_rate"
    " FROM (SELECT DISTINCT pair, strategy, run FROM sn) CROSS JOIN (SELECT variant FROM v) LEFT JOIN m USING (run, variant)"
)
SQL["model_test"] = q(
    f"SELECT pair, 'LSTM_global_vs_LR_global' AS comparison, count(*) AS n, {_STAT} FROM (SELECT x.pair, x.g - y.g AS v FROM gn x JOIN gn y ON x.pair = y.pair AND x.ts = y.ts AND x.strategy = 'LSTM_global' AND y.strategy = 'LR_global') GROUP BY 1",
    _SIDES,
    f"sn AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts) AS rn FROM (SELECT * REPLACE ({_OWN} AS signal), pair || '|' || strategy AS run FROM tg)), {positions('sn', 'run')},"
    " gn AS (SELECT pair, strategy, ts, position * coalesce(close - lag(close) OVER (PARTITION BY run ORDER BY ts), 0) AS g FROM pos)",
)
