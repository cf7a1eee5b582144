"""Models, forecasts and search (H, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import ORDER, query, read, rounded
from registry.splits import _RANDOM
from seriesmill.functions import metrics as J
from seriesmill.operators import arima as A
from seriesmill.operators import forecast as X
from seriesmill.operators import models as H
from seriesmill.operators import search as I
from seriesmill.operators.split import split_random, split_stratified
from seriesmill.session import materialize

_TRAINED = f"{_RANDOM}, t AS (SELECT o.*, s.split FROM orders o JOIN s USING (o_orderkey))"


def _orders(spark, d):
    return split_random(read(spark, d, "orders"), "o_orderkey")


@query(
    "h1_dummy_regressor",
    f"WITH {_TRAINED} SELECT o_orderkey, round((SELECT avg(o_totalprice) FROM t WHERE split = 'train'), 4) AS y_pred FROM t WHERE split = 'test'",
)
def h1(spark, d):
    out = H.dummy_regressor(_orders(spark, d), "o_totalprice").filter("split = 'test'")
    return rounded(out, ["o_orderkey"], ["y_pred"])


@query(
    "h1_dummy_regressor_median",
    f"WITH {_TRAINED} SELECT o_orderkey, round((SELECT median(o_totalprice) FROM t WHERE split = 'train'), 4) AS y_pred FROM t WHERE split = 'test'",
)
def h1_median(spark, d):
    out = H.dummy_regressor(_orders(spark, d), "o_totalprice", "median").filter("split = 'test'")
    return rounded(out, ["o_orderkey"], ["y_pred"])


@query(
    "h2_dummy_classifier",
    f"WITH {_TRAINED} SELECT o_orderkey, o_orderpriority, (SELECT o_orderpriority FROM t WHERE split = 'train' GROUP BY 1 "
    "ORDER BY count(*) DESC, o_orderpriority LIMIT 1) AS y_pred FROM t WHERE split = 'test'",
)
def h2(spark, d):
    out = H.dummy_classifier(_orders(spark, d), "o_orderpriority").filter("split = 'test'")
    return out.select("o_orderkey", "o_orderpriority", "y_pred")


_S2 = (
    "m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x), "
    "c AS (SELECT sum((a - ma) * (a - ma)) + 1.0 AS saa, sum((b - mb) * (b - mb)) + 1.0 AS sbb, sum((a - ma) * (b - mb)) AS sab, "
    "sum((a - ma) * (y - my)) AS say, sum((b - mb) * (y - my)) AS sby, any_value(ma) AS ma, any_value(mb) AS mb, any_value(my) AS my FROM x, m), "
    "w AS (SELECT (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS wa, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS wb, ma, mb, my FROM c)"
)


@query(
    "h3_ridge_coefficients",
    f"WITH x AS (SELECT l_quantity AS a, l_discount AS b, l_extendedprice AS y FROM lineitem), {_S2} "
    "SELECT 'intercept' AS term, round(my - wa * ma - wb * mb, 3) AS value FROM w UNION ALL SELECT 'l_quantity', round(wa, 3) FROM w "
    "UNION ALL SELECT 'l_discount', round(wb, 3) FROM w",
)
def h3(spark, d):
    df = read(spark, d, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    fit = H.ridge(df, ["l_quantity", "l_discount"], "l_extendedprice", 1.0)
    return H.linear_coefficients(fit, spark).withColumn("value", F.round("value", 3))


@query(
    "h3_ridge_one_feature",
    f"WITH {_TRAINED}, m AS (SELECT avg(o_custkey) AS mx, avg(o_totalprice) AS my FROM t WHERE split = 'train'), "
    "w AS (SELECT sum((o_custkey - mx) * (o_totalprice - my)) / (sum((o_custkey - mx) * (o_custkey - mx)) + 1.0) AS b, any_value(mx) AS mx, any_value(my) AS my FROM t, m WHERE split = 'train') "
    "SELECT o_orderkey, round(my + b * (o_custkey - mx), 2) AS y_pred FROM t, w WHERE split = 'test'",
)
def h3_one(spark, d):
    df = _orders(spark, d)
    fit = H.ridge(df.filter("split = 'train'"), ["o_custkey"], "o_totalprice", 1.0)
    return rounded(fit.predict(df.filter("split = 'test'")), ["o_orderkey"], ["y_pred"], 2)


# ---------------------------------------------------------------- MLlib models: rows only

_FEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _lines(spark, d):
    df = read(spark, d, "lineitem").withColumn("returned", F.col("l_returnflag").eqNullSafe("R").cast("int"))
    return split_random(df, _KEY)


def _train(df):
    return H.stable_partitions(df.filter("split = 'train'").select(*_KEY, *_FEATS[:3], "l_extendedprice", "returned"), _KEY)


def _mae(fit, df):
    scored = fit.predict(df.filter("split = 'test'")).withColumnRenamed("l_extendedprice", "y_true")
    return J.compute_metrics(scored.withColumn("model", F.lit(fit.name)), ["model"], ["mae", "rmse", "r2"])


@query("h4_logistic")
def h4(spark, d):
    df = _lines(spark, d)
    fit = H.logistic(_train(df), _FEATS, "returned", 1.0)
    scored = fit.predict(df.filter("split = 'test'"), "y_pred", "y_score").withColumnRenamed("returned", "y_true")
    return J.compute_metrics(scored.withColumn("model", F.lit("logistic")), ["model"], ["accuracy", "f1_weighted", "roc_auc"])


@query("h5_random_forest")
def h5(spark, d):
    df = _lines(spark, d)
    fit = H.random_forest(_train(df), _FEATS, "l_extendedprice")
    return _mae(fit, df)


@query("h6_gradient_boosted_trees")
def h6(spark, d):
    df = _lines(spark, d)
    return _mae(H.gbt(_train(df), _FEATS, "l_extendedprice"), df)


@query("h7_gbt_history")
def h7(spark, d):
    df = _lines(spark, d)
    train = _train(df)
    fit = H.gbt(train, _FEATS, "l_extendedprice")
    return H.gbt_history(fit, train, df.filter("split = 'val'"))


@query("h8_feature_importance")
def h8(spark, d):
    fit = H.random_forest(_train(_lines(spark, d)), _FEATS, "l_extendedprice")
    return H.feature_importance(fit, spark)


@query("h9_kernel_regression")
def h9(spark, d):
    df = _lines(spark, d)
    return _mae(H.kernel_regression(_train(df), _FEATS, "l_extendedprice"), df)


@query("h16_score_all")
def h16(spark, d):
    df = _lines(spark, d)
    models = {"DummyRegressor": None, "LinearModel": None, "RandomForest": None}
    report = H.fit_all(_train(df), _FEATS, "l_extendedprice", models)
    return H.score_all(report.models, df.filter("split = 'test'"), _KEY, "l_extendedprice")


@query("h6_multiclass_document_labels")
def h6_doc(spark, d):
    docs = read(spark, d, "documents").filter("lang IS NOT NULL")
    langs = sorted(r["lang"] for r in docs.select("lang").distinct().collect())  # class targets are numbers
    number = (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int")
    words = F.size(F.split("text", r"\s+")).cast("double")
    df = docs.select("doc_id", number.alias("lang"), F.col("n_chars").cast("double").alias("chars"), words.alias("words"))
    df = split_stratified(df, "doc_id", "lang")
    train = H.stable_partitions(df.filter("split = 'train'"), "doc_id")
    fit = H.gbt(train, ["chars", "words"], "lang", H.CLASSIFICATION)
    scored = fit.predict(df.filter("split = 'test'")).withColumnRenamed("lang", "y_true")
    return J.compute_metrics(scored.withColumn("model", F.lit("boosted")), ["model"], ["accuracy", "f1_weighted"])


_LRANDOM = (
    f"r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '42', {', '.join(f'CAST({k} AS VARCHAR)' for k in _KEY)})), {', '.join(_KEY)}) AS r, count(*) OVER () AS n FROM lineitem), "
    "s AS (SELECT *, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' WHEN r <= ceil(n * 0.2::DOUBLE) + "
    "ceil((n - ceil(n * 0.2::DOUBLE)) * (0.1::DOUBLE / (0.7::DOUBLE + 0.1::DOUBLE))) THEN 'val' ELSE 'train' END AS split FROM r)"
)
_MEAN_RMSE = "(SELECT round(sqrt(avg(pow(l_extendedprice - (SELECT avg(l_extendedprice) FROM s WHERE split = 'train'), 2))), 2) FROM s WHERE split = 'val')"


@query(
    "i1_tune",
    f"WITH {_LRANDOM} SELECT m AS model, 20 AS trials, 0 AS failed, TRUE AS best_is_least, {_MEAN_RMSE} AS mean_rmse, TRUE AS near_mean "
    "FROM (SELECT unnest(['LinearModel', 'RandomForest']) AS m)",
)
def i1(spark, d):
    """20 trials of each model over its full space; the best is within 5 % of the mean's error or better (these features tell little)."""
    df, need = _lines(spark, d), [*_FEATS, "l_extendedprice"]
    # both parts in one pass; the training rows lie in the partitions and the order that they have by themselves
    # (of a generated column, as a condition on the digest itself would work it out several times a row)
    df = df.select(*dict.fromkeys([*_KEY, *need]), F.explode(F.array("split")).alias("split"))
    kept = H.stable_partitions(df.filter("split IN ('train', 'val')"), _KEY)
    kept = materialize(kept.select(*need, "split"))
    train, val = (kept.filter(F.col("split") == part).select(*need) for part in ("train", "val"))
    val = materialize(val)  # few of the rows, passed over by every trial
    mean = H.dummy_value(train, "l_extendedprice")
    base = val.agg(F.sqrt(F.avg((F.col("l_extendedprice") - mean) * (F.col("l_extendedprice") - mean)))).first()[0]
    rows = []
    for m in ("LinearModel", "RandomForest"):
        found = I.tune(m, train, val, _FEATS, "l_extendedprice", "rmse", written=True)
        scores = [t["score"] for t in found.trials]
        rows.append((m, len(scores), sum(t["error"] is not None for t in found.trials), found.best_score == min(scores), round(base, 2), (found.best_score or 1e300) <= 1.05 * base))
    return spark.createDataFrame(rows, "model string, trials int, failed int, best_is_least boolean, mean_rmse double, near_mean boolean")


_MARGIN = "CAST(l_quantity AS DOUBLE)", "CAST(l_discount AS DOUBLE)"


def _boosted_sql(rounds: int, rate: float) -> str:
    """Exact greedy trees of depth 2 over two features: squared error, lambda 1, every value a cut."""
    ctes = [f"p0 AS (SELECT {_MARGIN[0]} AS a, {_MARGIN[1]} AS b, CAST(l_extendedprice AS DOUBLE) AS y, (SELECT avg(l_extendedprice) FROM lineitem) AS m FROM lineitem)"]
    for r in range(rounds):
        ctes.append(f"q{r}_0 AS (SELECT *, m - y AS g, 0 AS node FROM p{r})")
        for level in range(2):
            src = f"q{r}_{level}"
            ctes.append(
                f"h{r}_{level} AS (SELECT node, 0 AS f, a AS v, sum(g) AS g, count(*) AS h FROM {src} GROUP BY 1, 3 UNION ALL SELECT node, 1, b, sum(g), count(*) FROM {src} GROUP BY 1, 3)"
            )
            ctes.append(
                f"c{r}_{level} AS (SELECT node, f, v, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(g) OVER w AS gt, sum(h) OVER w AS ht FROM h{r}_{level} "
                "WINDOW u AS (PARTITION BY node, f ORDER BY v), w AS (PARTITION BY node, f))"
            )
            gain = "gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)"
            ctes.append(f"s{r}_{level} AS (SELECT node, f, v FROM c{r}_{level} WHERE ht > hl QUALIFY row_number() OVER (PARTITION BY node ORDER BY {gain} DESC, f, v) = 1)")
            ctes.append(f"q{r}_{level + 1} AS (SELECT x.* EXCLUDE (node), 2 * x.node + (CASE WHEN s.f = 0 THEN x.a ELSE x.b END > s.v)::INT AS node FROM {src} x JOIN s{r}_{level} s USING (node))")
        ctes.append(f"l{r} AS (SELECT node, -{rate} * sum(g) / (count(*) + 1) AS leaf FROM q{r}_2 GROUP BY 1)")
        ctes.append(f"p{r + 1} AS (SELECT a, b, y, m + leaf AS m FROM q{r}_2 JOIN l{r} USING (node))")
    return f"WITH {', '.join(ctes)} SELECT DISTINCT a AS l_quantity, b AS l_discount, round(m, 3) AS y_pred FROM p{rounds}"


@query("h6_boosted_exact", _boosted_sql(2, 0.3))
def h6_exact(spark, d):
    """Two rounds of depth 2 without sampling: every cut of the exact greedy trees."""
    df = read(spark, d, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    fit = H.gbt(df, ["l_quantity", "l_discount"], "l_extendedprice", n_estimators=2, max_depth=2, learning_rate=0.3, subsample=1.0, colsample_bytree=1.0)
    seen = df.selectExpr("CAST(l_quantity AS DOUBLE) AS l_quantity", "CAST(l_discount AS DOUBLE) AS l_discount").distinct()
    return rounded(fit.predict(seen), ["l_quantity", "l_discount"], ["y_pred"], 3)


@query("h6_multiclass_scores", "SELECT source, count(*) AS n, CAST(count(*) AS DOUBLE) AS total_score, count(*) AS named FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1")
def h6_scores(spark, d):
    """Text classes: the scores of every row sum to 1 and every row gets a class that exists."""
    docs = read(spark, d, "documents").filter("lang IS NOT NULL AND source IS NOT NULL")
    df = docs.select("source", "lang", F.col("n_chars").cast("double").alias("chars"), F.size(F.split("text", r"\s+")).cast("double").alias("words"))
    fit = H.gbt(df, ["chars", "words"], "lang", H.CLASSIFICATION, n_estimators=10)
    out = fit.probabilities(fit.predict(df))
    total = F.aggregate("y_scores", F.lit(0.0), lambda a, x: a + x)
    return out.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(total), 6).alias("total_score"), F.count_if(F.col("y_pred").isin(fit.labels)).alias("named")
    )


@query("h4_logistic_mean_score", f"WITH {_LRANDOM} SELECT count(*) AS n, round(avg((l_returnflag = 'R')::INT), 4) AS mean_score FROM s WHERE split = 'train'")
def h4_mean(spark, d):
    """At the optimum the mean score of the training rows is the share of the positive class."""
    train = _train(_lines(spark, d))
    fit = H.logistic(train, _FEATS, "returned", 1.0)
    return fit.predict(train, "y_pred", "y_score").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y_score"), 4).alias("mean_score"))


@query(
    "h9_kernel_beats_mean",
    "WITH x AS (SELECT abs(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) AS e FROM orders) "
    "SELECT count(*) AS n, round(avg(e), 2) AS mean_error, TRUE AS better FROM x",
)
def h9_beats(spark, d):
    """Order totals from the sums of their lines."""
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"), F.sum("l_quantity").alias("quantity"))
    df = read(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").fillna(0.0, ["total", "quantity"])
    df = df.select("o_orderkey", "o_totalprice", (F.col("total") / 1e5).alias("total"), (F.col("quantity") / 1e2).alias("quantity"))
    fit = H.kernel_regression(df, ["total", "quantity"], "o_totalprice", gamma=0.5, C=1.0, epsilon=0.1)
    mean = df.agg(F.avg("o_totalprice")).first()[0]
    error = F.abs(F.col("o_totalprice") - mean)
    mine = F.avg(F.abs(F.col("o_totalprice") - F.col("y_pred")))
    return fit.predict(df).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(error), 2).alias("mean_error"), (mine <= F.avg(error)).alias("better"))


@query(
    "h16_scored_rows",
    f"WITH {_LRANDOM} SELECT m AS model, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys, round(sum(l_extendedprice), 2) AS truth, count(*) AS scored FROM s, "
    "(SELECT unnest(['ARIMA', 'DummyRegressor', 'LinearModel', 'SVR', 'XGBoost']) AS m) WHERE split = 'test' GROUP BY 1",
)
def h16_rows(spark, d):
    """Every model of five kinds scores every row of the test part once."""
    df = _lines(spark, d)
    models = {"DummyRegressor": None, "LinearModel": None, "XGBoost": {"n_estimators": 10}, "SVR": {"n_features": 16}, "ARIMA": {"p": 1, "d": 0, "q": 0}}
    report = H.fit_all(_train(df), _FEATS, "l_extendedprice", models, order_by=_KEY)
    long = H.score_all(report.models, df.filter("split = 'test'"), _KEY, "l_extendedprice")
    return long.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").cast("bigint").alias("keys"), F.round(F.sum("y_true"), 2).alias("truth"), F.count("y_pred").alias("scored")
    )


@query(
    "i4_val_score",
    f"WITH {_TRAINED} SELECT 'DummyRegressor' AS model, round(avg(abs(o_totalprice - (SELECT avg(o_totalprice) FROM t WHERE split = 'train'))), 4) AS mae FROM t WHERE split = 'val'",
)
def i4(spark, d):
    df = _orders(spark, d)
    fit = H.fit_model(df.filter("split = 'train'"), ["o_custkey"], "o_totalprice", "DummyRegressor")
    score = I.val_score(fit, df.filter("split = 'val'"), "mae")
    return spark.createDataFrame([(fit.name, score)], "model string, mae double").withColumn("mae", F.round("mae", 4))


# ---------------------------------------------------------------- forecasts

_LAG = ", ".join(f"lag(value, {k}) OVER w AS y{k}" for k in range(1, 5))
ARIMA = (
    f"l AS (SELECT user_id, ts, event_id, value AS y0, {_LAG} FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "x AS (SELECT *, y0 - y1 AS d0, y1 - y2 AS d1, y2 - y3 AS d2, y3 - y4 AS d3 FROM l), "
    "s1 AS (SELECT user_id, count(*) AS n, sum(d1 * d1) FILTER (d2 IS NOT NULL) AS p11, sum(d2 * d2) FILTER (d2 IS NOT NULL) AS p22, "
    "sum(d1 * d2) AS p12, sum(d0 * d1) FILTER (d2 IS NOT NULL) AS p01, sum(d0 * d2) AS p02 FROM x GROUP BY 1), "
    "c1 AS (SELECT user_id, n, (p01 * p22 - p02 * p12) / nullif(p11 * p22 - p12 * p12, 0) AS a1, (p02 * p11 - p01 * p12) / nullif(p11 * p22 - p12 * p12, 0) AS a2 FROM s1), "
    "u AS (SELECT x.*, n, a1, a2, d1 - a1 * d2 - a2 * d3 AS u1 FROM x JOIN c1 USING (user_id)), "
    "s2 AS (SELECT user_id, sum(d1 * d1) FILTER (u1 IS NOT NULL) AS s11, sum(u1 * u1) AS s22, sum(d1 * u1) AS s12, sum(d0 * d1) FILTER (u1 IS NOT NULL) AS b1, sum(d0 * u1) AS b2 FROM u GROUP BY 1), "
    "c2 AS (SELECT user_id, greatest(least((b1 * s22 - b2 * s12) / nullif(s11 * s22 - s12 * s12, 0), 0.99), -0.99) AS phi, "
    "(b2 * s11 - b1 * s12) / nullif(s11 * s22 - s12 * s12, 0) AS theta FROM s2), "
    "la AS (SELECT user_id, y0, d0, d1, u1, n FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1), "
    "fit AS (SELECT user_id, n, CASE WHEN n >= 30 THEN phi END AS phi, CASE WHEN n >= 30 THEN theta END AS theta, y0, d0, d1, u1 FROM la JOIN c2 USING (user_id))"
)


def _fit(spark, d):
    return X.arima_fit(read(spark, d, "events").select(*ORDER, "user_id", "value"), "value", ORDER, "user_id")


@query("h10_arima_fit", f"WITH {ARIMA} SELECT user_id, n, round(phi, 4) AS phi, round(theta, 4) AS theta FROM fit")
def h10(spark, d):
    return rounded(_fit(spark, d), ["user_id", "n"], ["phi", "theta"])


@query(
    "h10_arima_forecast",
    f"WITH {ARIMA}, f AS (SELECT *, phi * d0 + theta * (d0 - phi * d1 - theta * u1) AS s, CAST(unnest(range(1, 11)) AS INTEGER) AS step FROM fit) "
    "SELECT user_id, step, round(y0 + s * (1 - pow(phi, step)) / (1 - phi), 4) AS y_pred FROM f",
)
def h10_forecast(spark, d):
    return rounded(X.arima_forecast(_fit(spark, d), 10, "user_id"), ["user_id", "step"], ["y_pred"])


def _arima(spark, d, order):
    return A.fit(read(spark, d, "events").select(*ORDER, "user_id", "value"), "value", ORDER, "user_id", order)


_DIFF = (
    "l AS (SELECT user_id, value AS y0, lag(value, 1) OVER w AS y1, lag(value, 2) OVER w AS y2, lag(value, 3) OVER w AS y3, lag(value, 4) OVER w AS y4, "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
)
_D1 = _DIFF + "x AS (SELECT *, y0 - y1 AS w0, y1 - y2 AS w1, y2 - y3 AS w2 FROM l), "
_D2 = _DIFF + "x AS (SELECT *, y0 - 2 * y1 + y2 AS w0, y1 - 2 * y2 + y3 AS w1, y2 - 2 * y3 + y4 AS w2 FROM l), "


@query(
    "h10_arima_210",
    f"WITH {_D1} s AS (SELECT user_id, count(*) AS n, sum(w1 * w1) FILTER (w2 IS NOT NULL) AS a, sum(w1 * w2) AS b, sum(w2 * w2) AS c, "
    "sum(w0 * w1) FILTER (w2 IS NOT NULL) AS e, sum(w0 * w2) AS f FROM x GROUP BY 1), "
    "t AS (SELECT user_id, n, (e * c - f * b) / nullif(a * c - b * b, 0) AS p1, (f * a - e * b) / nullif(a * c - b * b, 0) AS p2 FROM s), "
    "r AS (SELECT *, greatest(least(p2, 0.99), -0.99) AS r2, greatest(least(p1 / (1 - p2), 0.99), -0.99) AS r1 FROM t) "
    "SELECT user_id, n, CASE WHEN n >= 30 THEN round(r1 * (1 - r2), 4) END AS phi1, CASE WHEN n >= 30 THEN round(r2, 4) END AS phi2 FROM r",
)
def h10_210(spark, d):
    fit = _arima(spark, d, (2, 1, 0))
    return rounded(fit.select("user_id", "n", F.col("phi")[0].alias("phi1"), F.col("phi")[1].alias("phi2")), ["user_id", "n"], ["phi1", "phi2"])


_MA1 = (
    "s AS (SELECT user_id, count(*) AS n, sum(w0 * w1) / nullif(sum(w1 * w1) FILTER (w0 IS NOT NULL AND w1 IS NOT NULL), 0) AS a FROM x GROUP BY 1), "
    "u AS (SELECT x.*, n, a, w1 - a * w2 AS u1 FROM x JOIN s USING (user_id)), "
    "t AS (SELECT user_id, sum(w0 * u1) / nullif(sum(u1 * u1), 0) AS theta FROM u GROUP BY 1), "
    "f AS (SELECT u.*, theta FROM u JOIN t USING (user_id) WHERE back = 1 AND n >= 30), "
    "g AS (SELECT *, theta * (w0 - theta * u1) AS first, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM f) "
)


@query("h10_arima_011_forecast", f"WITH {_D1} {_MA1} SELECT user_id, step, round(y0 + first, 4) AS y_pred FROM g")
def h10_011(spark, d):
    fit = _arima(spark, d, (0, 1, 1)).filter("sigma2 IS NOT NULL")
    return rounded(A.forecast(fit, 5, "user_id"), ["user_id", "step"], ["y_pred"])


@query("h10_arima_021_forecast", f"WITH {_D2} {_MA1} SELECT user_id, step, round(y0 + step * (y0 - y1 + first), 3) AS y_pred FROM g")
def h10_021(spark, d):
    fit = _arima(spark, d, (0, 2, 1)).filter("sigma2 IS NOT NULL")
    return rounded(A.forecast(fit, 5, "user_id"), ["user_id", "step"], ["y_pred"], 3)


@query(
    "h10_arima_100_interval",
    "WITH l AS (SELECT user_id, value AS y0, lag(value) OVER w AS y1, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "s AS (SELECT user_id, count(*) + 1 AS n, greatest(least(covar_pop(y0, y1) / nullif(var_pop(y1), 0), 0.99), -0.99) AS phi, avg(y0) AS m0, avg(y1) AS m1, "
    "var_pop(y0) - covar_pop(y0, y1) * covar_pop(y0, y1) / nullif(var_pop(y1), 0) AS sigma2 FROM l WHERE y1 IS NOT NULL GROUP BY 1), "
    "f AS (SELECT user_id, y0, phi, m0 - phi * m1 AS c, sigma2 FROM l JOIN s USING (user_id) WHERE back = 1 AND n >= 30), "
    "g AS (SELECT *, c + phi * y0 AS f1 FROM f), h AS (SELECT *, c + phi * f1 AS f2 FROM g) "
    "SELECT user_id, 1 AS step, round(f1, 4) AS y_pred, round(f1 - 1.2815515655446004 * sqrt(sigma2), 4) AS lower, round(f1 + 1.2815515655446004 * sqrt(sigma2), 4) AS upper FROM h "
    "UNION ALL SELECT user_id, 2, round(f2, 4), round(f2 - 1.2815515655446004 * sqrt(sigma2 * (1 + phi * phi)), 4), round(f2 + 1.2815515655446004 * sqrt(sigma2 * (1 + phi * phi)), 4) FROM h",
)
def h10_100(spark, d):
    fit = _arima(spark, d, (1, 0, 0)).filter("sigma2 IS NOT NULL")
    return rounded(A.forecast(fit, 2, "user_id", 0.8), ["user_id", "step"], ["y_pred", "lower", "upper"])


@query("h10_arima_select")
def h10_select(spark, d):
    ev = read(spark, d, "events").select(*ORDER, "user_id", "value")
    return A.select(ev, "value", ORDER, "user_id").select("user_id", "n", "p", "d", "q", "aic")


# the events of a type on a day are the sample paths of that step
_PATHS = "SELECT event_type AS series, CAST(day(ts) AS INTEGER) AS step, event_id AS sample, value FROM events"


def _paths(spark, d):
    return read(spark, d, "events").selectExpr("event_type AS series", "day(ts) AS step", "event_id AS sample", "value")


@query(
    "h11_quantile_forecast",
    f"SELECT series, step, round(quantile_cont(value, 0.1), 4) AS q10, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.9), 4) AS q90 FROM ({_PATHS}) GROUP BY 1, 2",
)
def h11(spark, d):
    return rounded(X.quantile_forecast(_paths(spark, d)), ["series", "step"], ["q10", "q50", "q90"])


@query("h11_point_forecast", f"SELECT series, step, round(median(value), 4) AS y_pred FROM ({_PATHS}) GROUP BY 1, 2")
def h11_point(spark, d):
    return rounded(X.point_forecast(_paths(spark, d)), ["series", "step"], ["y_pred"])


@query("h11_bootstrap_quantiles")
def h11_boot(spark, d):
    ev = read(spark, d, "events").select(*ORDER, "user_id", "value")
    fit = _fit(spark, d)
    shocks = X.arima_residuals(ev, fit, "value", ORDER, "user_id")
    paths = X.bootstrap_paths(fit, shocks, ORDER, "user_id", 10)
    return X.quantile_forecast(paths, keys=("user_id", "step"), largest=X.SAMPLES)


_LASTN = "SELECT event_id, ts, user_id, value FROM {src} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= {n}"


@query("h12_recent_context", _LASTN.format(src="events", n=20))
def h12(spark, d):
    df = read(spark, d, "events").select("event_id", "ts", "user_id", "value")
    return X.recent_context(df, "user_id", ORDER, 20)


@query(
    "h13_update_context",
    "WITH o AS (" + _LASTN.format(src="events WHERE ts < TIMESTAMP '2024-01-20'", n=12) + "), "
    "al AS (SELECT * FROM o UNION ALL SELECT event_id, ts, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-20') "
    + _LASTN.format(src="al", n=12),
)
def h13(spark, d):
    df = read(spark, d, "events").select("event_id", "ts", "user_id", "value")
    old = X.recent_context(df.filter("ts < timestamp_ntz'2024-01-20'"), "user_id", ORDER, 12)
    return X.update_context(old, df.filter("ts >= timestamp_ntz'2024-01-20'"), "user_id", ORDER, 12)
