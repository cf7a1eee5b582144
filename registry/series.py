"""Window transforms, fills, time grids (F10-F17, F20-F23, F26, F27, F30, F34, F35) and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import EV_NULLS, EVENTS_SQL, ORDER, events, query, read, rounded
from seriesmill.operators import align, fills
from seriesmill.operators import windows as W
from seriesmill.plans import plan as P

O = "ORDER BY ts, event_id"  # noqa: E741
U = f"PARTITION BY user_id {O}"
POS = f"WITH {EVENTS_SQL}, p AS (SELECT *, row_number() OVER ({O}) - 1 AS x FROM ev)"


def _line(v: str, over: str = "") -> str:
    part = f"PARTITION BY {over}" if over else ""
    return (
        f"WITH {EVENTS_SQL}, p AS (SELECT *, row_number() OVER ({part} {O}) - 1 AS x, "
        f"coalesce({v}, avg({v}) OVER ({part})) AS y FROM ev), "
        f"s AS (SELECT {over + ',' if over else ''} avg(y) AS my, avg(x) AS mx, regr_slope(y, x) AS b, count(*) AS n FROM p "
        f"{'GROUP BY ' + over if over else ''})"
    )


@query("f10_detrend_linear", f"{_line('v')} SELECT event_id, round(y - my - b * (x - mx), 4) AS v FROM p, s")
def f10(spark, d):
    return rounded(W.detrend(events(spark, d), ["v"], ORDER), ["event_id"], ["v"])


@query(
    "f10_detrend_linear_by_series",
    f"{_line('v', 'user_id')} SELECT event_id, round(CASE WHEN n < 2 THEN v ELSE y - my - coalesce(b, 0) * (x - mx) END, 4) AS v "
    "FROM p JOIN s USING (user_id)",
)
def f10s(spark, d):
    return rounded(W.detrend(events(spark, d), ["v"], ORDER, "linear", "user_id"), ["event_id"], ["v"])


@query("f11_detrend_constant", f"WITH {EVENTS_SQL}, s AS (SELECT avg(v) AS m FROM ev) SELECT event_id, round(coalesce(v, m) - m, 4) AS v FROM ev, s")
def f11(spark, d):
    return rounded(W.detrend(events(spark, d), ["v"], ORDER, "constant"), ["event_id"], ["v"])


@query("f30_detrend_all_numeric", f"{_line('value')} SELECT event_id, round(y - my - b * (x - mx), 4) AS value FROM p, s")
def f30(spark, d):
    return rounded(W.detrend(events(spark, d), ["value"], ORDER), ["event_id"], ["value"])


@query(
    "f12_difference",
    f"{POS} SELECT event_id, round(d, 4) AS v FROM (SELECT event_id, x, v - lag(v) OVER ({O}) AS d FROM p) WHERE x > 0",
)
def f12(spark, d):
    return rounded(W.difference(events(spark, d), ["v"], ORDER), ["event_id"], ["v"])


@query(
    "f12_difference_by_series",
    f"WITH {EVENTS_SQL} SELECT event_id, round(d, 4) AS v FROM (SELECT event_id, v - lag(v) OVER ({U}) AS d, "
    f"row_number() OVER ({U}) AS r FROM ev) WHERE r > 1",
)
def f12s(spark, d):
    return rounded(W.difference(events(spark, d), ["v"], ORDER, "user_id"), ["event_id"], ["v"])


@query(
    "f13_smooth",
    f"WITH {EVENTS_SQL} SELECT event_id, round(avg(v) OVER ({O} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS v FROM ev",
)
def f13(spark, d):
    return rounded(W.smooth(events(spark, d), ["v"], 3, ORDER), ["event_id"], ["v"], 6)


_LAGS = [1, 2, 3, 6, 24]


@query(
    "f14_lag_features",
    f"{POS} SELECT * EXCLUDE (x) FROM (SELECT event_id, x, "
    + ", ".join(f"lag(v, {k}) OVER ({O}) AS v_lag_{k}" for k in _LAGS)
    + " FROM p) WHERE x >= 24",
)
def f14(spark, d):
    return W.lag_features(events(spark, d).select("event_id", "ts", "v"), ["v"], _LAGS, ORDER).drop("ts", "v")


@query(
    "f14_lag_features_by_series",
    f"WITH {EVENTS_SQL} SELECT event_id, a AS v_lag_1, b AS v_lag_3 FROM (SELECT event_id, lag(v, 1) OVER ({U}) AS a, "
    f"lag(v, 3) OVER ({U}) AS b, row_number() OVER ({U}) AS r FROM ev) WHERE r > 3",
)
def f14s(spark, d):
    df = events(spark, d).select("event_id", "ts", "user_id", "v")
    return W.lag_features(df, ["v"], [1, 3], ORDER, "user_id").select("event_id", "v_lag_1", "v_lag_3")


@query(
    "f15_target_lags",
    f"{POS} SELECT event_id, value, a AS v_lag_1, b AS v_lag_2, c AS value_lag_1, e AS value_lag_2 FROM (SELECT event_id, x, value, "
    f"lag(v, 1) OVER ({O}) AS a, lag(v, 2) OVER ({O}) AS b, lag(value, 1) OVER ({O}) AS c, lag(value, 2) OVER ({O}) AS e FROM p) WHERE x >= 2",
)
def f15(spark, d):
    df = events(spark, d).select("event_id", "ts", "value", "v")
    return W.lag_features(df, ["v"], [1, 2], ORDER, target="value").drop("ts", "v")


def _roll(col: str, frame: str, over: str = O) -> str:
    w = f"OVER ({over} ROWS BETWEEN {frame})"
    return f"round(avg({col}) {w}, 6) AS {col}_rolling_mean_24, round(coalesce(stddev_pop({col}) {w}, 0), 6) AS {col}_rolling_std_24"


@query("f16_rolling_stats", f"WITH {EVENTS_SQL} SELECT event_id, {_roll('v', '23 PRECEDING AND CURRENT ROW')} FROM ev")
def f16(spark, d):
    df = W.rolling_stats(events(spark, d), ["v"], 24, ORDER)
    return rounded(df, ["event_id"], ["v_rolling_mean_24", "v_rolling_std_24"], 6)


@query(
    "f16_rolling_stats_by_series",
    f"WITH {EVENTS_SQL} SELECT event_id, {_roll('v', '23 PRECEDING AND CURRENT ROW', U)} FROM ev",
)
def f16s(spark, d):
    df = W.rolling_stats(events(spark, d), ["v"], 24, ORDER, "user_id")
    return rounded(df, ["event_id"], ["v_rolling_mean_24", "v_rolling_std_24"], 6)


@query("f17_target_rolling", f"WITH {EVENTS_SQL} SELECT event_id, {_roll('value', '24 PRECEDING AND 1 PRECEDING')} FROM ev")
def f17(spark, d):
    df = W.rolling_stats(events(spark, d), [], 24, ORDER, target="value")
    return rounded(df, ["event_id"], ["value_rolling_mean_24", "value_rolling_std_24"], 6)


@query(
    "f20_ffill",
    f"WITH {EVENTS_SQL} SELECT event_id, last_value(v IGNORE NULLS) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM ev",
)
def f20(spark, d):
    return fills.ffill(events(spark, d), ["v"], ORDER).select("event_id", "v")


def _gap(over: str) -> str:
    prev = f"OVER ({over} {O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    nxt = f"OVER ({over} {O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return (
        f"WITH {EVENTS_SQL}, p AS (SELECT *, row_number() OVER ({over} {O}) - 1 AS x FROM ev), "
        f"g AS (SELECT event_id, x, v, last_value(v IGNORE NULLS) {prev} AS a, first_value(v IGNORE NULLS) {nxt} AS b, "
        f"max(CASE WHEN v IS NOT NULL THEN x END) {prev} AS xa, min(CASE WHEN v IS NOT NULL THEN x END) {nxt} AS xb FROM p)"
    )


_BLEND = "CASE WHEN v IS NOT NULL THEN v ELSE coalesce(a + (b - a) * (x - xa) / nullif(xb - xa, 0), a) END"


@query("f21_interpolate_forward", f"{_gap('')} SELECT event_id, round({_BLEND}, 4) AS v FROM g")
def f21(spark, d):
    return rounded(fills.interpolate(events(spark, d), ["v"], ORDER), ["event_id"], ["v"])


@query("f21_interpolate_forward_by_series", f"{_gap('PARTITION BY user_id')} SELECT event_id, round({_BLEND}, 4) AS v FROM g")
def f21s(spark, d):
    return rounded(fills.interpolate(events(spark, d), ["v"], ORDER, "forward", "user_id"), ["event_id"], ["v"])


@query("f22_interpolate_both", f"{_gap('')} SELECT event_id, round(coalesce({_BLEND}, b), 4) AS v FROM g")
def f22(spark, d):
    return rounded(fills.interpolate(events(spark, d), ["v"], ORDER, "both"), ["event_id"], ["v"])


@query(
    "f23_ffill_bfill_text",
    f"WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS t FROM events) SELECT event_id, "
    f"coalesce(last_value(t IGNORE NULLS) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    f"first_value(t IGNORE NULLS) OVER ({O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS t FROM e",
)
def f23(spark, d):
    e = read(spark, d, "events").selectExpr("event_id", "ts", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS t")
    return fills.ffill_bfill(e, ["t"], ORDER).select("event_id", "t")


@query(
    "f26_smooth_centered",
    f"WITH a AS (SELECT event_id, ts, CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END AS v FROM events "
    f"WINDOW w AS ({O} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT event_id, round(coalesce("
    f"first_value(v IGNORE NULLS) OVER ({O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
    f"last_value(v IGNORE NULLS) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS value FROM a",
)
def f26(spark, d):
    df = events(spark, d).select("event_id", "ts", "value")
    return rounded(W.smooth(df, ["value"], 5, ORDER, center=True), ["event_id"], ["value"], 6)


@query(
    "f27_difference_zero_first",
    f"WITH {EVENTS_SQL} SELECT event_id, round(coalesce(v - lag(v) OVER ({O}), 0), 4) AS v FROM ev",
)
def f27(spark, d):
    return rounded(W.difference(events(spark, d), ["v"], ORDER, first="zero"), ["event_id"], ["v"])


_GRID = """
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2),
gaps AS (SELECT epoch_us(hour) - epoch_us(lag(hour) OVER (PARTITION BY event_type ORDER BY hour)) AS us FROM h),
step AS (SELECT us FROM gaps WHERE us > 0 GROUP BY us ORDER BY count(*) DESC, us LIMIT 1),
span AS (SELECT event_type, min(hour) AS a, max(hour) AS b FROM h GROUP BY 1),
grid AS (SELECT event_type, unnest(generate_series(a, b, to_microseconds(us))) AS hour FROM span, step)
SELECT event_type, CAST(hour AS TIMESTAMP) AS hour, n FROM grid LEFT JOIN h USING (event_type, hour)
"""


@query("f34_align_time", _GRID)
def f34(spark, d):
    h = read(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    return align.align_time(h.agg(F.count(F.lit(1)).alias("n")), "hour", None, "event_type")


@query("f35_time_column_probe", "SELECT 'ts' AS time_col, count(*) AS n, min(ts) AS first_ts FROM events")
def f35(spark, d):
    df = read(spark, d, "events")
    col = align.detect_time_col_by_probe(df, ["event_id"])
    return df.agg(F.lit(col).alias("time_col"), F.count(F.lit(1)).alias("n"), F.min(col).alias("first_ts"))


_TAB = (
    "WITH li AS (SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS q, "
    "l_discount, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS f FROM lineitem), "
    "m AS (SELECT avg(q) AS mq, (SELECT f FROM li WHERE f IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1) AS mf FROM li), "
    "a AS (SELECT l_orderkey, l_linenumber, l_extendedprice, coalesce(q, mq) AS q, l_discount, coalesce(f, mf) AS f FROM li, m), "
    "s AS (SELECT avg(q) AS aq, stddev_pop(q) AS sq, avg(l_discount) AS ad, stddev_pop(l_discount) AS sd FROM a) "
    "SELECT l_orderkey, l_linenumber, l_extendedprice, f, round((q - aq) / sq, 4) AS q, round((l_discount - ad) / sd, 4) AS l_discount FROM a, s"
)


def _tab(spark, d):
    return read(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount",
        "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS q",
        "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS f",
    )


_TASK = P.Task("l_extendedprice", keep=("l_orderkey", "l_linenumber"))


@query("e4_default_plan_tabular", _TAB)
def e4(spark, d):
    out, _ = P.apply_plan(_tab(spark, d), P.default_plan(_TASK), _TASK)
    return rounded(out, ["l_orderkey", "l_linenumber", "l_extendedprice", "f"], ["q", "l_discount"])


@query("e2_validated_plan", _TAB)
def e2(spark, d):
    raw = [
        {"order": 9, "method": "z_norm", "applies_to": ["q", "l_discount", "l_extendedprice"]},
        {"order": 2, "method": "imputation", "applies_to": "features_only", "parameters": {"strategy": "mean"}},
        {"order": 3, "method": "teleport"},
        {"order": 4, "method": "detrend"},
        {"order": "5", "method": "min_max"},
        {"order": 6, "method": "min_max", "applies_to": ["l_extendedprice"]},
    ]
    out, _ = P.apply_plan(_tab(spark, d), P.validate_plan(raw, _TASK), _TASK)
    return rounded(out, ["l_orderkey", "l_linenumber", "l_extendedprice", "f"], ["q", "l_discount"])


@query("e5_plan_tolerates_failures", _TAB)
def e5(spark, d):
    steps = [P.Step(0, "teleport"), *P.default_plan(_TASK), P.Step(9, "smoothing")]
    out, _ = P.apply_plan(_tab(spark, d), steps, _TASK)
    return rounded(out, ["l_orderkey", "l_linenumber", "l_extendedprice", "f"], ["q", "l_discount"])


@query(
    "e4_plan_audit",
    "SELECT 1 AS \"order\", 'imputation' AS method, count(*) AS rows_before, count(*) AS rows_after, 'f,q' AS columns_affected FROM lineitem "
    "UNION ALL SELECT 2, 'z_norm', count(*), count(*), 'l_discount,q' FROM lineitem",
)
def e4_audit(spark, d):
    _, audit = P.apply_plan(_tab(spark, d), P.default_plan(_TASK), _TASK)
    return audit.table(spark).select(
        "order", "method", "rows_before", "rows_after", F.array_join(F.array_sort("columns_affected"), ",").alias("columns_affected")
    )


_HOURS = "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, avg(value) AS m FROM events GROUP BY 1"
_HL = [1, 2, 3, 6, 24]
_HCOLS = ["m", "m_rolling_mean_24", "m_rolling_std_24", *[f"m_lag_{k}" for k in _HL], *[f"n_lag_{k}" for k in _HL]]


@query(
    "e1_default_plan_series",
    f"WITH h AS ({_HOURS}), w AS (SELECT hour, n, m, row_number() OVER (ORDER BY hour) - 1 AS x, "
    "avg(m) OVER (ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS m_rolling_mean_24, "
    "coalesce(stddev_pop(m) OVER (ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 0) AS m_rolling_std_24, "
    + ", ".join(f"lag({c}, {k}) OVER (ORDER BY hour) AS {c}_lag_{k}" for c in "mn" for k in _HL)
    + " FROM h), f AS (SELECT * FROM w WHERE x >= 24) SELECT CAST(hour AS TIMESTAMP) AS hour, n, "
    + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 4) AS {c}" for c in _HCOLS)
    + " FROM f",
)
def e1(spark, d):
    h = read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    h = h.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    task = P.Task("n", "time_series", "hour")
    out, _ = P.apply_plan(h, P.default_plan(task, ["m"]), task)
    return rounded(out, ["hour", "n"], _HCOLS)


@query(
    "f38_metadata_plan",
    f"WITH e AS (SELECT event_id, ts, {EV_NULLS} AS v FROM events), a AS (SELECT event_id, ts, coalesce(v, (SELECT avg(v) FROM e)) AS v FROM e), "
    f"b AS (SELECT event_id, ts, coalesce(v - lag(v) OVER ({O}), 0) AS v FROM a) "
    "SELECT event_id, round((v - avg(v) OVER ()) / stddev_samp(v) OVER (), 4) AS v FROM b",
)
def f38(spark, d):
    df = events(spark, d).select("event_id", "ts", "v")
    steps = [
        {"order": 3, "method": "z_normalization"},
        {"order": 1, "method": "impute_missing", "parameters": {"strategy": "mean"}},
        {"order": 2, "method": "differencing"},
    ]
    return rounded(P.run_metadata_plan(df, steps, ORDER), ["event_id"], ["v"])
