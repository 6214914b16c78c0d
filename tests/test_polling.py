"""Issues followed to their end, over a restart."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from weftwise.streaming.polling import _Issue, follow_issues, state_store

BATCHES = [
    [("a", "UNPROCESSED", "00:00"), ("b", "PROCESSING", "00:00"), ("c", "WAITING", "00:10"), (None, "RESOLVED", "00:11"), ("a", None, "00:12"), ("e", "STOPPED", "00:20"), ("g", "WAITING", "00:24")],
    [("a", "RESOLVED", "00:30"), ("a", "RESOLVED", "00:31"), ("e", "PROCESSING", "00:40"), ("b", "RESOLVED", "03:00"), ("f", "STOPPED", "03:30"), ("f", "WAITING", "03:29")],
    [("d", "WAITING", "05:00"), ("a", "PROCESSING", "05:01"), ("c", "RESOLVED", "05:02")],
]


def test_issues_over_a_restart(spark, tmp_path):
    schema = "issue_id string, status string, at timestamp"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = follow_issues(stream, "1 hour", "10 minutes").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
        return {r["issue_id"]: (r["status"], r["outcome"], r["seen"], r["last_at"].strftime("%H:%M")) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with state_store(spark):
        for k, rows in enumerate(BATCHES):
            df = spark.createDataFrame(rows, "issue_id string, status string, at string").withColumn("at", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "at")))
            df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            got = run()  # each time a new start from the checkpoint
            if k == 0:
                assert got == {"e": ("STOPPED", "ended", 1, "00:20")}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert got == {
        "a": ("RESOLVED", "ended", 2, "00:30"), "b": ("PROCESSING", "timed out", 1, "00:00"), "c": ("WAITING", "timed out", 1, "00:10"), "e": ("STOPPED", "ended", 1, "00:20"),
        "f": ("STOPPED", "ended", 2, "03:30"), "g": ("WAITING", "timed out", 1, "00:24"),
    }
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(got)


def test_state_is_asked_only_as_needed():
    """An issue that is over at once takes one read and one write of its state, an open one a timer more; none lists timers."""

    class Handle:
        def __init__(self):
            self.value, self.timers, self.calls = None, set(), []

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def registerTimer(self, at):
            self.calls.append("timer")
            self.timers.add(at)

        def deleteTimer(self, at):
            self.calls.append("no timer")
            self.timers.remove(at)

    def issue(*batches):
        handle, made, out = Handle(), _Issue(100), []
        made.init(handle)
        for rows in batches:
            out += made.handleInputRows(("x",), iter([Row(ms=ms, status=s) for ms, s in rows]), None)
        return handle, [tuple(r)[1:] for r in out]

    handle, out = issue([(5, "RESOLVED"), (3, "WAITING")])
    assert handle.calls == ["get", "update"] and out == [("RESOLVED", "ended", 2, 3, 5)] and not handle.timers
    handle, out = issue([(5, "WAITING")], [(4, "PROCESSING")], [(50, "WAITING")])
    assert handle.calls == ["get", "update", "timer", "get", "update", "get", "no timer", "update", "timer"] and handle.timers == {150} and not out
    handle, out = issue([(5, "WAITING")], [(106, "RESOLVED")], [(107, "WAITING")])
    assert handle.calls == ["get", "update", "timer", "get", "no timer", "update", "get"] and out == [("WAITING", "timed out", 1, 5, 5)] and not handle.timers
