"""The paged source: parallel reads, missing columns, and a stream that is stopped and started again."""

from pyspark.sql import functions as F

from oddsmith.sources import paged


def write(spark, path, pages):
    rows = [(n, 10 * n + k, f"http://a/{n}", f"<p>é\n{k}") for n in pages for k in range(3)]
    spark.createDataFrame(rows, paged.SCHEMA).write.mode("append").partitionBy("page").json(path)


def test_batch(spark, tmp_path):
    path = str(tmp_path / "pages")
    load = lambda: spark.read.format(paged.register(spark)).option("path", path).load()
    assert load().collect() == []
    write(spark, path, [0, 1, 12])
    spark.createDataFrame([(3, 99)], "page long, page_id long").write.mode("append").partitionBy("page").json(path)  # no url, no html
    (tmp_path / "pages" / "page=x").mkdir()
    got = {tuple(r) for r in load().collect()}
    assert got == {(n, 10 * n + k, f"http://a/{n}", f"<p>é\n{k}") for n in (0, 1, 12) for k in range(3)} | {(3, 99, None, None)}
    assert load().rdd.getNumPartitions() == 4 and load().where("html is null").count() == 1


def test_stream_goes_on_after_the_last_page(spark, tmp_path):
    path, out = str(tmp_path / "pages"), str(tmp_path / "out")
    paged.register(spark)
    write(spark, path, [0, 1])

    def run():
        x = spark.readStream.format("stored_pages").option("path", path).load().withColumn("run", F.lit(runs))
        q = x.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    for runs, more in ((1, [2, 5]), (2, []), (3, [7])):
        run()
        if more:
            write(spark, path, more)
    runs = 4
    run()
    got = {r["page"]: (r["run"], r["n"]) for r in spark.read.parquet(out).groupBy("page", "run").agg(F.count("*").alias("n")).collect()}
    assert got == {0: (1, 3), 1: (1, 3), 2: (2, 3), 5: (2, 3), 7: (4, 3)}
