"""The flagship query: raw events to a ranked comparison of two models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registry.base import query, read
from seriesmill.functions.metrics import compute_metrics
from seriesmill.operators.models import dummy_value, fit_model, FittedModel, score_all
from seriesmill.operators.report import comparison_table
from seriesmill.operators.scalar import z_norm
from seriesmill.operators.split import split_chronological
from seriesmill.operators.windows import lag_step, rolling_step, run_windows

_FEATURES = ["m_lag_1", "m_rolling_mean_24"]

SQL = """
WITH h AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS m, count(*) AS n FROM events GROUP BY 1),
w AS (SELECT hour, n, row_number() OVER (ORDER BY hour) - 1 AS x, lag(m, 1) OVER (ORDER BY hour) AS a0,
      avg(m) OVER (ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS b0 FROM h),
r AS (SELECT *, row_number() OVER (ORDER BY hour) - 1 AS p, count(*) OVER () AS c FROM w WHERE x >= 1),
s AS (SELECT *, CASE WHEN p < floor(c * 0.7::DOUBLE) THEN 'train' WHEN p < floor(c * 0.7::DOUBLE) + floor(c * 0.1::DOUBLE) THEN 'val'
      ELSE 'test' END AS split FROM r),
z AS (SELECT avg(a0) AS ma, stddev_pop(a0) AS sa, avg(b0) AS mb, stddev_pop(b0) AS sb FROM s WHERE split = 'train'),
x AS (SELECT split, CAST(n AS DOUBLE) AS y, (a0 - ma) / sa AS a, (b0 - mb) / sb AS b FROM s, z),
t AS (SELECT * FROM x WHERE split = 'train'),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM t),
c AS (SELECT sum((a - ma) * (a - ma)) + 1 AS saa, sum((b - mb) * (b - mb)) + 1 AS sbb, sum((a - ma) * (b - mb)) AS sab,
      sum((a - ma) * (y - my)) AS say, sum((b - mb) * (y - my)) AS sby, any_value(ma) AS ma, any_value(mb) AS mb, any_value(my) AS my FROM t, m),
k AS (SELECT (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS wa, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS wb, ma, mb, my FROM c),
p AS (SELECT 'DummyRegressor' AS model, y, my AS q FROM x, k WHERE split = 'test' UNION ALL
      SELECT 'LinearModel', y, my + wa * (a - ma) + wb * (b - mb) FROM x, k WHERE split = 'test'),
e AS (SELECT model, avg(abs(y - q)) AS v FROM p GROUP BY 1)
SELECT 'flagship' AS run_id, CAST(row_number() OVER (ORDER BY v, model) AS INTEGER) AS rank, model, round(v, 6) AS value,
       row_number() OVER (ORDER BY v, model) = 1 AS is_best FROM e
"""


@query("flagship_events_to_ranking", SQL)
def flagship(spark, d) -> DataFrame:
    hours = read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    hours = hours.agg(F.avg("value").alias("m"), F.count(F.lit(1)).cast("double").alias("n"))
    step = rolling_step(hours, ["m"], 24) + lag_step(hours, ["m"], [1])
    parts = split_chronological(run_windows(hours, step, ["hour"]), "hour", [])
    parts = z_norm(parts, _FEATURES, fit_on="train")
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    models = {
        "DummyRegressor": FittedModel("DummyRegressor", "n", _FEATURES, None, dummy_value(train, "n")),
        "LinearModel": fit_model(train, _FEATURES, "n", "LinearModel", {"alpha": 1.0}),
    }
    predictions = score_all(models, test, "hour", "n", "flagship")
    ranked = comparison_table(compute_metrics(predictions, ["run_id", "model"], ["mae"]), "mae")
    return ranked.withColumn("value", F.round("value", 6))
