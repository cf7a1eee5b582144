"""Chronological cuts in any zone of session and process; quotas over very many classes."""

import os
import random
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from seriesmill.operators import split as G


@pytest.fixture
def zones(spark):
    """Sets the session's zone and this process's."""
    before, own = spark.conf.get("spark.sql.session.timeZone"), os.environ.get("TZ")

    def of(session, process):
        spark.conf.set("spark.sql.session.timeZone", session)
        os.environ["TZ"] = process
        time.tzset()

    yield of
    spark.conf.set("spark.sql.session.timeZone", before)
    os.environ.pop("TZ") if own is None else os.environ.update(TZ=own)
    time.tzset()


@pytest.mark.parametrize("session,process", [("America/New_York", "UTC"), ("UTC", "America/New_York"), ("Europe/Berlin", "Asia/Kolkata")])
@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_boundaries(spark, zones, monkeypatch, session, process, kind):
    zones(session, process)
    monkeypatch.setattr("seriesmill.operators.ranks.TAKE_ROWS", 50)
    for first in ("2024-03-09 12:00:00", "2024-11-02 12:00:00"):  # both changes of the clock lie in the middle
        start = int(spark.sql(f"SELECT unix_seconds(timestamp'{first}')").first()[0]) if kind == "timestamp" else None
        rows = spark.range(384)
        t = F.timestamp_seconds(F.lit(start) + F.col("id") * 300) if start else F.expr(f"timestamp_ntz'{first}' + make_dt_interval(0, 0, int(id * 5))")
        df = rows.select("id", t.cast(kind).alias("t")).repartition(3)
        for mode, want in (("standard", (268, 38, 78)), ("nested", (276, 31, 77)), ("cumulative", (268, 39, 77))):
            out = {r.split: (r.n, r.lo, r.hi) for r in G.split_chronological(df, "t", [], mode=mode).groupBy("split").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}
            a, b, _ = want
            assert out == {"train": (a, 0, a - 1), "val": (b, a, a + b - 1), "test": (384 - a - b, a + b, 383)}


def remainders(sizes, want):
    total = sum(sizes.values())
    exact = {c: Fraction(want * n, total) for c, n in sizes.items()}
    base = {c: int(x) for c, x in exact.items()}
    order = sorted(sizes, key=lambda c: (base[c] - exact[c], c is None, c or ""))
    for c in order[: want - sum(base.values())]:
        base[c] += 1
    return base


def test_quotas_of_many_classes(spark, monkeypatch):
    monkeypatch.setattr("seriesmill.operators.ranks.TAKE_ROWS", 40)
    rng = random.Random(4)
    sizes = {f"class {i:04d}": rng.choice([1, 1, 2, 3, 50]) for i in range(700)} | {None: 7}
    strata = spark.createDataFrame(list(sizes.items()), "__c string, __n bigint").repartition(4)
    for want in (0, 1, 333, 1000, sum(sizes.values())):
        out = G._quotas(strata, "__n", want, "q")
        assert {r["__c"]: r.q for r in out.collect()} == remainders(sizes, want)
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.q for r in G._quotas(strata.withColumn("__n", F.lit(0)), "__n", 0, "q").select("q").distinct().collect()] == [0]
