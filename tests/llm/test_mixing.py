import math

from helpers import edge_frame, empty, oracle, same_rows
from pyspark.sql import functions as F

from giftrisk.llm import mixing as M


def test_edge_cases_match_sql(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    i = F.col("doc_id")
    docs = docs.select(F.when(i != 7, i).alias("doc_id"), F.when(i == 6, "").when(i != 5, F.col("text")).alias("text"), "lang",
                       F.when(i % 20 == 3, None).when(i % 20 == 4, "unnamed").otherwise(F.col("source")).alias("source"), "n_chars")
    docs.union(docs.where("doc_id in (1, 2)")).write.parquet(f"{tmp_path}/documents.parquet")
    got = M.op6(spark, str(tmp_path)).toPandas()
    assert same_rows(got, oracle(M.SQL, documents=spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text", "source")))


def test_edge_rows_have_defined_copies(spark):
    out = M.mix(edge_frame(spark)).groupBy("doc_id", "text", "n_copies").agg(F.count("*").alias("rows"), F.max("copy").alias("last")).collect()
    assert all(r.rows in (r.n_copies, 2 * r.n_copies) and r.last == r.n_copies for r in out)


def test_columns_and_empty_table(spark):
    df = edge_frame(spark).withColumns({"_key": F.lit("k"), "rate": F.lit("own"), "n_copies": F.lit(-1), "shuffle_key": F.lit(2.5)})
    out = M.mix(df)
    assert out.columns == [*[c for c in df.columns if c not in M.ADDED], "rate", "n_copies", "copy", "shuffle_key"]
    own = M.replicated(df)
    assert own.schema == df.schema and own.count() == out.count() and own.distinct().exceptAll(df.distinct()).count() == 0
    assert M.mix(empty(spark)).count() == M.replicated(empty(spark)).count() == 0


def test_repeated_rows_are_spread(spark):
    df = spark.range(0, 20_000, 1, 4).selectExpr("cast(null as long) AS doc_id", "'one text' AS text", "'s' AS source")
    sizes = [r["count"] for r in M.mix(df, {"s": 1.0}).groupBy(F.spark_partition_id()).count().collect()]
    plan = M.mix(df, {"s": 1.0})
    assert plan.select("shuffle_key").distinct().count() < 10
    assert sum(sizes) == plan.count()
    with_parts = plan.rdd.getNumPartitions()
    assert with_parts == 1 or max(sizes) < 0.75 * sum(sizes)


def test_inversion_follows_the_distribution(spark):
    for rate in (0.3, 1.0, 4.5, 650.0):
        r = spark.range(20_000).select(M.copies(F.lit(rate), F.col("id").cast("string")).alias("k")).agg(
            F.avg("k"), F.var_samp("k")).first()
        assert abs(r[0] - rate) < 5 * math.sqrt(rate / 20_000) and abs(r[1] / rate - 1) < 0.08


def test_sources_reach_their_weights(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "repeat('x', cast(id % 50 AS int)) AS text",
                                          "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 30 = 1 THEN 'b' ELSE 'c' END AS source")
    out = M.mix(docs, {"a": 0.1, "b": 0.5}, rest=0.4, epochs=1.0)
    share = {r[0]: r[1] for r in out.groupBy("source").agg(F.sum(F.length("text"))).collect()}
    whole = docs.agg(F.sum(F.length("text"))).first()[0]
    for g, w in (("a", 0.1), ("b", 0.5), ("c", 0.4)):
        assert abs(share[g] / whole - w) < 0.02
    again = M.mix(docs.repartition(7), {"a": 0.1, "b": 0.5}, rest=0.4, epochs=1.0)
    assert out.count() == again.count() and out.exceptAll(again).count() == 0
