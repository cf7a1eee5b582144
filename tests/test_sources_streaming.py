"""Files, documents and streams."""

import json

import pytest
from pyspark.sql import functions as F

from seriesmill.operators import scalar as S
from seriesmill.plans.plan import changed_targets
from seriesmill.sources import tables as A
from seriesmill.streaming.online import transform_stream, update_context_stream


def test_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Month,#Passengers\r1949-01,112\r1949-02,118\r")
    (tmp_path / "b.json").write_text(json.dumps([{"x": 1, "y": "a"}, {"x": 2, "y": None}]))
    spark.range(3).write.parquet(str(tmp_path / "c.parquet"))
    csv = A.load_table(spark, str(tmp_path / "a.csv"))
    assert csv.columns == ["Month", "#Passengers"] and csv.agg(F.sum("#Passengers")).first()[0] == 230
    assert A.load_table(spark, str(tmp_path / "b.json")).filter("y IS NULL").first().x == 2
    assert A.load_table(spark, str(tmp_path / "c.parquet")).count() == 3
    with pytest.raises(ValueError):
        A.detect_format("table.xlsx")
    with pytest.raises(ValueError):
        A.load_table(spark, "x", "xlsx")
    with pytest.raises(ValueError, match="EMPTY"):
        A.require_shape(spark.range(1))


def test_write_processed(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "IF(id < 7, 'train', 'test') AS split")
    A.write_processed(df, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.filter("split = 'train'").count() == 7
    assert (tmp_path / "p" / "split=test").exists()
    A.write_processed(df.drop("split"), str(tmp_path / "q"), "csv")
    assert spark.read.csv(str(tmp_path / "q"), header=True).count() == 10


def test_documents(spark, tmp_path):
    for run in ("r1", "r2"):
        (tmp_path / run).mkdir()
    (tmp_path / "r1" / "task_spec.json").write_text(json.dumps({"run_id": "r1", "task_type": "x", "target_col": "y"}))
    (tmp_path / "r2" / "task_spec.json").write_text(json.dumps({"run_id": "r2", "target_col": None}, indent=2))
    (tmp_path / "r2" / "run_summary.json").write_text("not json")
    (tmp_path / "r2" / "other.json").write_text("{}")
    got = {r.path.split("/")[-2] + "/" + r.schema_name: (r.missing_fields, r.valid) for r in A.artifact_contract_check(spark, str(tmp_path)).collect()}
    assert got == {
        "r1/task_spec": ([], True),
        "r2/task_spec": (["task_type"], False),
        "r2/run_summary": (["assembled_at", "run_id", "stages"], False),
    }
    out = spark.createDataFrame([("r1", None)], "run_id string, ranking string")
    A.write_artifact(out, str(tmp_path / "doc"))
    assert "ranking" in spark.read.text(str(tmp_path / "doc")).first().value


def test_fitted_transforms_on_a_stream(spark, sf_dir, tmp_path):
    src = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", "CASE WHEN event_id % 7 > 0 THEN value END AS v", "event_type"
    )
    src.repartition(4).write.parquet(str(tmp_path / "in"))
    fill = S.fit_impute(src, ["v"])
    scale = S.fit_z_norm(S.apply_impute(src, fill), ["v"])
    names = S.fit_onehot(src, ["event_type"])
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        transform_stream(stream, fill, scale, names)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = transform_stream(src, fill, scale, names)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_context_on_a_stream(spark, sf_dir, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "CAST(ts AS TIMESTAMP) AS ts", "event_id", "value")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}

    def keep(batch, _):
        rows = {}
        for r in batch.collect():
            rows.setdefault(r.user_id, []).append(r.event_id)
        seen.update(rows)

    query = (
        update_context_stream(stream, "user_id", ["ts", "event_id"], 5)
        .writeStream.foreachBatch(keep)
        .outputMode("update")
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(240)
    want = {}
    for r in src.orderBy("ts", "event_id").collect():
        want.setdefault(r.user_id, []).append(r.event_id)
    assert {u: sorted(v) for u, v in seen.items()} == {u: sorted(v[-5:]) for u, v in want.items()}


def test_parts_are_replaced_and_recorded(spark, tmp_path):
    df = spark.range(30).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS split")
    path = str(tmp_path / "t")
    assert A.write_parts(df, path, "one").first().rows == 30
    record = A.write_parts(df.filter("split = 'a' AND id > 8"), path, "two").first()
    assert (record.partitions, record.rows) == (["a"], 7)
    A.write_parts(df.filter("split = 'a' AND id > 8"), path, "two")
    back = spark.read.parquet(path)
    assert back.filter("split = 'a'").count() == 7 and back.filter("split = 'b'").count() == 20
    assert sorted(r.run_id for r in A.commits(spark, path).collect()) == ["one", "two"]


def test_changed_targets(spark):
    before = spark.createDataFrame([(i, "k", float(i) if i % 5 else None) for i in range(400)], "id int, k string, y double")
    after = before.filter("id < 390").selectExpr("id", "k", "CASE WHEN id = 7 THEN 0 WHEN id = 10 THEN 1 WHEN id = 11 THEN NULL ELSE y END AS y")
    after = after.unionByName(spark.createDataFrame([(900, "k", None)], before.schema)).repartition(5)
    for limit in (1 << 16, 1):
        rows = {r.id: (r.old, r.new, r.change) for r in changed_targets(before, after, ["id", "k"], "y", max_ranges=limit).collect()}
        want = {7: (7.0, 0.0, "changed"), 10: (None, 1.0, "changed"), 11: (11.0, None, "changed"), 900: (None, None, "added")}
        assert rows == want | {i: (float(i) if i % 5 else None, None, "removed") for i in range(390, 400)}
    assert changed_targets(before, before.repartition(3), "id", "y").count() == 0


def test_idle_series_expire(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema, source, seen = "s string, t timestamp, v int", str(tmp_path / "in"), []
    for step, rows in enumerate([[("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 00:00:00", 2)], [("b", "2024-01-03 00:00:00", 3)], [("b", "2024-01-03 01:00:00", 4)], [("a", "2024-01-03 02:00:00", 5)]]):
        spark.createDataFrame(rows, "s string, t string, v int").selectExpr("s", "CAST(t AS TIMESTAMP) AS t", "v").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        run = update_context_stream(stream, "s", ["t"], 5, "t", "1 hour", 3_600_000).writeStream.outputMode("update")
        run = run.foreachBatch(lambda b, n, step=step: seen.extend((step, r.s, r.v) for r in b.collect()))
        run.option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination(120)
    assert {v for step, s, v in seen if s == "b" and step == 2} == {2, 3, 4} or {v for step, s, v in seen if s == "b" and step == 2} == {3, 4}
    assert [v for step, s, v in seen if s == "a" and step == 3] == [5]  # its first row went with the state


def test_stream_is_written_in_parallel(spark, sf_dir, tmp_path, monkeypatch):
    from registry import writes as W

    real = W.read
    monkeypatch.setattr(W, "read", lambda *a: real(*a).repartition(4))
    monkeypatch.setattr(W, "_folder", lambda spark, name: str(tmp_path / name))
    rows = W.l2(spark, sf_dir).count()
    assert len(list((tmp_path / "stream" / "in").glob("*.parquet"))) == 8  # two runs of four tasks
    assert sorted(p.name for p in (tmp_path / "stream" / "out").iterdir()) == ["0", "1"]  # each run is one batch
    events = real(spark, sf_dir, "events")
    assert rows == events.groupBy("user_id").count().agg(F.sum(F.least("count", F.lit(8)))).first()[0]
