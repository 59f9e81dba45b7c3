"""Pairs of two streams against all pairs, with rows that come too late."""

from datetime import datetime, timedelta

from sonograin.streaming.plays import late_rows, paired

KIND = "record_id long, listener long, artist_key string, track_key string, start timestamp"
T = datetime(2024, 1, 1)


def test_streams_pair_like_tables_and_count_late_rows(spark, tmp_path):
    at = lambda s: T + timedelta(seconds=s)
    plays = [(i, i % 2, "a", "t" if i % 3 else None, at(600 * i)) for i in range(30)]
    scrobbles = [(100 + i, i % 2, "a", "t", at(600 * i + (i % 5) * 10 - 20)) for i in range(30)] + [(200 + i, i % 2, "b", "t", at(600 * i)) for i in range(30)]
    late = [(300, 0, "a", "t", at(600 * 2))]  # comes when the watermark has passed
    for n in range(3):
        for name, rows in (("plays", plays[10 * n : 10 * n + 10]), ("scrobbles", [*scrobbles[10 * n : 10 * n + 10], *scrobbles[30 + 10 * n : 40 + 10 * n], *(late if n == 2 else [])])):
            spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/{n}")
    read = lambda name: spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")
    q = paired(read("plays"), read("scrobbles"), delay="10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.play_id, r.scrobble_id, r.delta_ms) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(p[0], s[0], int((s[4] - p[4]).total_seconds() * 1000)) for p in plays for s in scrobbles if p[1:3] == s[1:3] and p[3] == s[3] and abs(s[4] - p[4]) <= timedelta(seconds=30)}
    assert got == want and late_rows(q) >= 1
