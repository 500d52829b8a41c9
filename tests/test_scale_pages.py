from litsieve.plans import views as V


def page_plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def orders(spark, tmp_path):
    spark.sql("SELECT id AS o_orderkey, id % 3 AS o_custkey, 'O' AS o_orderstatus, '1-URGENT' AS o_orderpriority, date'1996-01-02' AS o_orderdate FROM range(9)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT id AS c_custkey, concat('Customer#', id) AS c_name, 'BUILDING' AS c_mktsegment FROM range(3)").write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_pages_are_dealt_out_after_their_join(spark, tmp_path):
    d = orders(spark, tmp_path)
    for pages in (V.nested_result_pages(spark, d), V.order_result_pages(spark, d)):
        plan = page_plan(pages)
        assert "Repartition" in plan.split("Join")[0]
