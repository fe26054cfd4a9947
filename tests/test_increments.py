"""Streams of increments: stopped, replayed and started anew they give what one batch gives."""

from pyspark.sql import functions as F

from foliospark.operators import terms
from foliospark.streaming import increments

STORE = "src_lang string, tgt_lang string, source string, target string, status string, aliases array<string>, note string, book string, ord long"


def merge(store, batch):
    out = terms.merged_store(store, batch)
    # what comes out is a store again: an entry keeps its first book
    return out.select("src_lang", "tgt_lang", "source", "target", "status", "aliases", "note", F.col("books")[0].alias("book"), F.monotonically_increasing_id().alias("ord"))


def entries(df):
    return sorted((r["source"], r["target"], r["status"], tuple(sorted(r["aliases"]))) for r in df.collect())


def test_a_stream_that_is_stopped_and_replayed(spark, tmp_path):
    rows = [("en", "zh", f"t{i % 7}", f"g{i % 3}", "confirmed" if i % 5 == 0 else "seed", [f"a{i % 2}"], "", f"b{i}", i) for i in range(40)]
    folder, store, log = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "log")
    parts = [rows[:15], rows[15:22], rows[22:]]
    upsert, add = increments.merged(store, STORE, merge), increments.appended(log)

    def run(checkpoint):
        both = lambda batch, number: (upsert(batch, number), add(batch, number))
        source = spark.readStream.schema(STORE).option("maxFilesPerTrigger", 1).parquet(folder)
        query = source.writeStream.foreachBatch(both).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination()

    want = spark.createDataFrame([], STORE)
    for i, part in enumerate(parts):
        frame = spark.createDataFrame(part, STORE)
        frame.coalesce(1).write.mode("append").parquet(folder)
        run("one")  # stopped after each file and started again
        want = spark.createDataFrame(merge(want, frame).collect(), STORE)
        assert entries(increments.latest(spark, store, STORE)) == entries(want)
    # the same batches handed over again, and a stream without memory of them
    for i, part in enumerate(parts):
        upsert(spark.createDataFrame(part, STORE), i)
        add(spark.createDataFrame(part, STORE), i)
    assert entries(increments.latest(spark, store, STORE)) == entries(want)
    assert spark.read.parquet(log).count() == len(rows) and increments.versions(spark, store) == [1, 2]


def test_a_version_that_broke_off_is_made_again(spark, tmp_path):
    store = str(tmp_path / "store")
    upsert = increments.merged(store, "x long", lambda old, new: old.union(new))
    upsert(spark.range(3).toDF("x"), 0)
    spark.range(9).toDF("x").write.parquet(f"{store}/version=1")
    (tmp_path / "store" / "version=1" / "_SUCCESS").unlink()
    assert increments.versions(spark, store) == [0]
    upsert(spark.range(3, 5).toDF("x"), 1)
    assert sorted(r["x"] for r in increments.latest(spark, store, "x long").collect()) == [0, 1, 2, 3, 4]
