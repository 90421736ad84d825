import pytest
from pyspark.sql import functions as F

from waymark.functions import pricing, scalars
from waymark.operators import analytics


def value(spark, sql):
    return spark.range(1).select(F.expr(sql).alias("v")).first()["v"]


def test_pricing(spark):
    assert value(spark, pricing.min_amount_out("10001L", "50L")) == 9950
    assert value(spark, pricing.min_amount_out("0L", "50L")) is None
    assert value(spark, pricing.log2_floor("1023L")) == 9
    assert value(spark, pricing.log2_floor("0L")) == 0
    assert value(spark, pricing.multiplier("1000L")) == 997
    assert value(spark, pricing.profit("10L", "9L")) is None
    assert value(spark, pricing.gap_bps("400L", "300L")) == 2500.0


def test_scalars(spark):
    assert value(spark, scalars.format_units("1234500L", "4")) == "123.45"
    assert value(spark, scalars.format_units("5L", "3")) == "0.005"
    assert value(spark, scalars.format_units("7L", "0")) == "7"
    assert value(spark, scalars.normalized_protocol("' Uni-Swap_V3 '")) == "uniswapv3"
    assert value(spark, scalars.sanitize_symbol("'$$'")) is None
    assert value(spark, scalars.deadline("100L", "601", 600)) is None
    word = f"0x{456:0>32x}{0:0>4x}{123:0>28x}"[:66]
    word = "0x" + f"{(456 << 112) | 123:064x}"
    assert int(value(spark, scalars.low_112(f"'{word}'"))) == 123
    assert int(value(spark, scalars.high_112(f"'{word}'"))) == 456
    assert scalars.parse_units("1.50", 6) == 1_500_000
    assert scalars.parse_integer("0xff") == 255
    for bad in ("", "1.2345", "x"):
        with pytest.raises(ValueError):
            scalars.parse_units(bad, 3)


def test_analytics(spark):
    s = spark.createDataFrame([("a", v) for v in (5, 1, 3, 2, 4)] + [("b", 7)], "g string, v long")
    got = {r["g"]: (r["n"], r["p50"], r["p95"], r["worst"]) for r in analytics.nearest_rank(s, "g", "v", [50, 95]).collect()}
    assert got == {"a": (5, 3, 4, 5), "b": (1, 7, 7, 7)}
    assert analytics.quotas(10, 4) == [3, 3, 2, 2]
