import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from lodestrata.streaming import sessions

GAP, DELAY = 600, 300
START = datetime(2024, 5, 1, tzinfo=timezone.utc)


def replayed(spark, tmp_path, batches):
    sessions.prepared(spark)
    for rows in batches:
        spark.createDataFrame(rows, "key long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = sessions.of_stream(stream, GAP, DELAY).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    run = told.trigger(availableNow=True).start()
    run.awaitTermination()
    late = sum(op.numRowsDroppedByWatermark for p in run.recentProgress for op in p.stateOperators)
    return sorted(map(tuple, spark.read.schema(sessions.SESSION).parquet(str(tmp_path / "out")).collect()), key=str), late


def test_a_replayed_stream_tells_what_the_table_does(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted((START + timedelta(seconds=rng.randrange(20000)), rng.randrange(4), float(i)) for i in range(150))
    rows = [(k, t, v) for t, k, v in rows] + [(None, START, 1.0), (1, None, 1.0)]
    late = [(0, START + timedelta(seconds=5), 99.0)]
    cut = [rows[:40], rows[40:90], rows[90:] + []]
    cut[1], cut[2] = cut[1] + [], cut[2]
    moved = next(r for r in reversed(cut[0]) if r[1] > cut[0][-1][1] - timedelta(seconds=DELAY))  # comes a batch late, within the delay
    cut[0].remove(moved)
    got, dropped = replayed(spark, tmp_path, [cut[0], [*cut[1], moved], cut[2], late])
    want = sessions.of_table(spark.createDataFrame(rows, "key long, ts timestamp, value double"), GAP, DELAY).select("key", "start", "last", "n", "total")
    assert got == sorted(map(tuple, want.collect()), key=str) and dropped == 1
    assert sum(r[3] for r in got) < 150 and len(got) > 20


def test_sums_of_one_key_meet_in_any_order():
    rng = random.Random(5)
    spans = [(t, t, 1, 1.0) for t in rng.sample(range(4000), 60)]
    whole = sessions.merged(spans, 50)
    for _ in range(10):
        rng.shuffle(spans)
        assert sessions.merged(sessions.merged(spans[:30], 50) + spans[30:], 50) == whole
    assert all(b[0] - a[1] >= 50 for a, b in zip(whole, whole[1:], strict=False)) and sum(s[2] for s in whole) == 60
