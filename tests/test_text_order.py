"""Text orders with common heads fall into blocks of similar size and keep the order."""

import pytest
from pyspark.sql import functions as F

from seriesmill.functions.columns import common_head
from seriesmill.operators.ordering import BLK, Sizing, fit_layout, with_position

SIZING = Sizing(100, 20, 50)


def heads(spark, kind):
    n = F.lpad(F.col("id").cast("string"), 6, "0")
    if kind == "one":
        text = F.concat(F.lit("https://www.example.org/very/long/common/head/"), n)
    elif kind == "many":  # three hosts, each with a long head of its own
        text = F.concat(F.element_at(F.array(F.lit("https://a.example/x/y/z/"), F.lit("https://a.example.net/longer/head/"), F.lit("ümlaut/über/alles/")), (F.col("id") % 3 + 1).cast("int")), n)
    elif kind == "hot":  # one value holds a third of the rows
        text = F.when(F.col("id") % 3 == 0, F.lit("https://hot.example/")).otherwise(F.concat(F.lit("https://hot.example/"), n))
    else:
        text = F.when(F.col("id") % 10 > 0, F.concat(F.lit("k"), n))
    return spark.range(4000).select("id", text.alias("s")).repartition(3)


@pytest.mark.parametrize("kind", ["one", "many", "hot", "nulls"])
def test_blocks(spark, kind):
    df = heads(spark, kind)
    layout = fit_layout(df, ["s", "id"], None, 0, SIZING)
    sizes = [r["count"] for r in layout.bind(df).groupBy(BLK).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 2 * 4000 / 20 and len(sizes) >= 15
    want = [(r.s, r.id) for r in df.orderBy(F.col("s").asc_nulls_last(), "id").collect()]
    got = {r.pos: (r.s, r.id) for r in with_position(df, ["s", "id"], sizing=SIZING).collect()}
    assert [got[i] for i in range(4000)] == want


def test_common_head():
    assert common_head("abc", "abd") == 2 and common_head("", "x") == 0 and common_head("aé", "aè") == 2 and common_head("ab", "abc") == 2
