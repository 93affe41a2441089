from pyspark.sql import functions as F

from docloom.llm import runtime as rt


def test_hot_keys_join_like_others(spark):
    rows = spark.range(12_000).select(F.when(F.col("id") < 7000, 0).otherwise(F.col("id") % 900).alias("k"), "id")
    table = rt.cut(rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 5"))
    want = sorted(tuple(r) for r in rows.join(table, "k").collect())
    found = rt.join_counted(rows, table, ["k"], "n")
    assert "Union" in found._jdf.queryExecution().toString() and sorted(tuple(r) for r in found.collect()) == want
    few = rt.cut(table.where("n < 100"))
    assert rt.join_counted(rows, few, ["k"], "n").count() == rows.join(few, "k").count()
    assert rt.join_counted(rows, table.where("false"), ["k"], "n").count() == 0
