"""Streams over several batches: state that outlives a restart, late events, batches that run again."""

from terrace.streaming import windows

FEED = "game int, seq long, type string, team string"


def feed(spark, path, rows):
    spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(path)


def test_possession_goes_on_over_batches_and_restarts(spark, tmp_path):
    source, out = f"{tmp_path}/feed", f"{tmp_path}/out"
    feed(spark, source, [(1, 2, "CHALLENGE", "away"), (1, 1, "PASS", "home"), (2, 1, "BALL OUT", "home")])
    run = lambda: windows.run_to_table(windows.live_possession(spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(source)), out, "append")
    run()
    feed(spark, source, [(1, 3, "CHALLENGE", "away"), (2, 2, "RECOVERY", "away")])
    run()  # anew, from the checkpoint
    feed(spark, source, [(1, 4, "BALL OUT", "away"), (1, 5, "SHOT", "home")])
    feed(spark, source, [(1, 6, "CHALLENGE", "away")])
    run()
    run()  # nothing new
    got = sorted((r["game"], r["seq"], r["holder"]) for r in windows.result_of(spark, out).collect())
    assert got == [(1, 1, "home"), (1, 2, "home"), (1, 3, "home"), (1, 4, ""), (1, 5, "home"), (1, 6, "home"), (2, 1, ""), (2, 2, "away")]


def test_late_events_are_left_out(spark, tmp_path):
    source, out = f"{tmp_path}/events", f"{tmp_path}/out"

    def come(*times):
        spark.createDataFrame([(t, "view") for t in times], "ts string, event_type string").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type").coalesce(1).write.mode("append").parquet(source)

    def run():
        windows.run_to_table(windows.counts_by_window(spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(source)), out, "append")

    come("2024-01-01 10:00:00", "2024-01-01 11:00:00", "2024-01-02 10:00:00")
    run()
    come("2024-01-01 12:00:00", "2024-01-10 10:00:00")  # two hours late: counted
    run()
    come("2024-01-01 13:00:00", "2024-01-20 10:00:00")  # nine days late: not
    run()
    got = {(str(r["start"])[:10], r["n"]) for r in windows.result_of(spark, out).collect()}
    assert got == {("2024-01-01", 3), ("2024-01-02", 1), ("2024-01-10", 1)}
