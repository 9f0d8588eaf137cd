import datetime as dt

from paperloom.streaming import ingest

ROWS = [("h1", "PDF", dt.datetime(2024, 1, 1, 1)), ("h1", "pdf", dt.datetime(2024, 1, 1, 2)), ("h2", "docx", dt.datetime(2024, 1, 2, 1)), (None, None, dt.datetime(2024, 1, 2, 3)), ("h3", "pdf", dt.datetime(2024, 1, 9, 1))]


def stream(spark, path, rows):
    spark.createDataFrame(rows, "content_hash string, file_type string, loaded_at timestamp").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("content_hash string, file_type string, loaded_at timestamp").parquet(path)


def run(spark, df, name, state, mode):
    df.writeStream.format("memory").queryName(name).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_first_of_content(spark, tmp_path):
    s = stream(spark, str(tmp_path / "in"), ROWS)
    got = run(spark, ingest.first_of_content(s, "loaded_at"), "firsts", str(tmp_path / "c1"), "append")
    assert sorted(str(r.content_hash) for r in got) == ["None", "h1", "h2", "h3"]


def test_windows_count_late_rows(spark, tmp_path):
    s = stream(spark, str(tmp_path / "in"), ROWS)
    got = run(spark, ingest.loads_by_window(s, "loaded_at"), "loads", str(tmp_path / "c2"), "complete")
    n = {(r.window_start.day, r.file_type): r.n for r in got}
    assert n == {(1, "pdf"): 2, (2, "docx"): 1, (2, None): 1, (9, "pdf"): 1}
