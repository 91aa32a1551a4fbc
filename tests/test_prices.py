"""Prices of orders: every row once, and one after the other of the places that a price may come from."""

from pyspark.sql import functions as F

from docsluice.operators import policy
from tests.oracle import compare, connect


def test_a_repeated_order_has_a_row_for_each(spark, tmp_path):
    rows = [(1, "5-LOW", "F", 250.5), (1, "5-LOW", "F", 250.5), (1, "1-URGENT", "O", 9900.0), (2, "2-HIGH", "P", 3.0), (3, "3-MEDIUM", "O", 123456.0)]
    schema = "o_orderkey long, o_orderpriority string, o_orderstatus string, o_totalprice double"
    spark.createDataFrame(rows, schema).toPandas().to_parquet(tmp_path / "orders.parquet", index=False)
    same, note = compare(spark, connect(str(tmp_path)), "price_analysis", str(tmp_path))
    assert same, note


def test_the_first_usable_price_counts(spark):
    rows = [(" 2 млн BYN ", "цена 5 руб", 2e6, "2 млн BYN"), ("по запросу", "цена 1 200,50 руб.", 1200.5, "1 200,50 руб."), (None, "НМЦК: 700", 700.0, "700"),
            ("0", "цена 0 руб, НМЦК: 40", 40.0, "40"), (" ", "без цены", None, None), (None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, estimate string, corpus string, price double, raw string")
    got = policy.price_analysis(df).where(~(F.col("reference_price").eqNullSafe(F.col("price")) & F.col("reference_raw").eqNullSafe(F.col("raw"))))
    assert got.collect() == []
