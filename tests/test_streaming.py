from pyspark.sql import functions as F

from lorewright.operators.incremental import last_states, save_changed
from lorewright.streaming import incremental


def test_states_stream_like_batch(spark, small_tables, tmp_path):
    events = spark.read.parquet(f"{small_tables}/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = incremental.transitions(stream).writeStream.format("memory").queryName("turns").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {r["key"]: r["state"] for r in spark.table("turns").groupBy("key").agg(F.max_by("state", F.struct("at", "events")).alias("state")).collect()}
    wanted = {r["user_id"]: r["state"] for r in last_states(events, "user_id", ["ts", "event_id"]).collect()}
    assert got == wanted


def test_chapters_arriving(spark, tmp_path):
    spark.createDataFrame([(1, 1, "—Hola —dijo Ana.\nEra tarde.")], "book_id bigint, chapter int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("book_id bigint, chapter int, text string").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        incremental.analyze_arriving(stream, str(tmp_path / "out"), str(tmp_path / "cp")).start().awaitTermination(120)
    assert [r["speaker"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seg_order").collect()] == ["Ana", "Narrator", "Narrator"]


def test_unchanged_partitions_are_not_written(spark, tmp_path):
    import os

    path = str(tmp_path / "saved")
    rows = [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 1, "c"), (3, 1, None)]
    df = spark.createDataFrame(rows, "book_id int, chapter int, text string")
    assert save_changed(df, path, "book_id") == 3
    before = {p: sorted(os.listdir(os.path.join(path, p))) for p in os.listdir(path) if p.startswith("book_id")}
    assert save_changed(df.orderBy("text"), path, "book_id") == 0
    assert save_changed(spark.createDataFrame([(1, 1, "a"), (1, 2, "B"), (2, 1, "c"), (4, 1, "d")], df.schema), path, "book_id") == 3
    after = {p: sorted(os.listdir(os.path.join(path, p))) for p in os.listdir(path) if p.startswith("book_id")}
    assert after["book_id=3"] == before["book_id=3"] and after["book_id=1"] != before["book_id=1"] and set(after) == {f"book_id={i}" for i in (1, 2, 3, 4)}
    assert {tuple(r) for r in spark.read.parquet(path).select("book_id", "chapter", "text").collect()} == {(1, 1, "a"), (1, 2, "B"), (2, 1, "c"), (3, 1, None), (4, 1, "d")}
