"""Streams of state, replayed in micro-batches, against the same rules over all events at once and against batch queries."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sightline.streaming import gates, state

BEGIN = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    for k, v in state.OPTIONS.items():
        spark.conf.set(k, v)
    yield
    for k in state.OPTIONS:
        spark.conf.unset(k)


def replay(spark, tmp_path, rows, schema, make, batches, mode):
    """The rows in so many files, read one a micro-batch; what each batch gave, in order."""
    step = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    make(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, _: got.append(df.collect())).trigger(availableNow=True).start().awaitTermination(120)
    return got


@pytest.mark.parametrize("events, now, want", [
    ([(0, "start")], 499, None), ([(0, "start")], 500, (500, "OPTIMAL", 0)), ([(0, "start"), (100, "noise")], 600, (500, "STABLE", 1)),
    ([(0, "start"), (300, "visual")], 700, None), ([(0, "start"), (300, "visual"), (310, "noise")], 800, (800, "STABLE", 1)),
    ([(0, "start"), (300, "visual"), (700, "visual")], 1000, (1000, "DEGRADED", 0)), ([(0, "start"), (10, "blocked")], 999, None),
    ([(0, "start"), (10, "blocked"), (600, "unblocked")], 1000, (1000, "DEGRADED", 0)), ([(0, "start"), (10, "blocked"), (400, "unblocked")], 600, (500, "OPTIMAL", 0)),
    ([(0, "start"), (10, "blocked"), (100, "visual"), (550, "unblocked")], 700, (600, "OPTIMAL", 0)),
])
def test_rules_of_readiness(events, now, want):
    assert state.settled(events, now) == want


def test_readiness_stream(spark, tmp_path):
    r, rows = random.Random(7), []
    for k in range(40):
        begin = k * 700
        own = [(begin, "start"), *[(begin + r.randint(1, 1500), r.choice(["visual", "noise", "noise", "blocked", "unblocked"])) for _ in range(r.randint(0, 8))]]
        rows += [(f"p{k}", at, kind) for at, kind in own]
    rows.sort(key=lambda x: x[1] + r.randint(0, 300))  # a little out of order
    want = {(k, *state.settled([(at, kind) for key, at, kind in rows if key == k], 10**9)) for k in {x[0] for x in rows}}
    rows.append(("end", 10**7, "start"))  # lets the watermark pass all others
    timed = [(k, BEGIN + dt.timedelta(milliseconds=at), kind) for k, at, kind in rows]
    got = replay(spark, tmp_path, timed, "key string, ts timestamp, kind string", lambda s: state.readiness(s, "2 seconds"), 6, "append")
    zero = round(BEGIN.timestamp() * 1000)
    assert sorted((x.key, x.settled_ms - zero, x.quality, x.noise) for b in got for x in b) == sorted(want)


def test_error_stream_keeps_a_hundred(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"s{r.randint(0, 2)}", BEGIN + dt.timedelta(seconds=i), i, f"E:{r.randint(0, 140)}") for i in range(1500)]
    plain = {}
    for k, ts, _, e in rows:
        plain.setdefault(k, state.ErrorMap()).track(e, round(ts.timestamp() * 1000))
    got = {}
    for batch in replay(spark, tmp_path, rows, "key string, ts timestamp, seq long, error string", state.errors, 5, "update"):
        for x in batch:
            got[x.key, x.error] = [x.n, x.first_ms, x.last_ms]
    for k, errors in plain.items():
        assert len(errors.held) == 100 and all(got[k, e] == v for e, v in errors.held.items())


def test_sample_stream_equals_the_batch_query(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value is not null").select(F.col("event_type").alias("key"), F.col("event_id").cast("long").alias("seq"), F.col("value").cast("double").alias("value"))
    rows = [tuple(x) for x in events.orderBy("seq").collect()]
    last = {}
    for batch in replay(spark, tmp_path, rows, "key string, seq long, value double", state.samples, 4, "update"):
        last |= {x.key: x for x in batch}
    want = gates.performance(events, "key", "value", "seq").collect()
    assert len(want) == len(last) > 0
    for w in want:
        assert [last[w.key][c] for c in ("n", "least", "most", "p50", "p95", "p99")] == [w[c] for c in ("n", "least", "most", "p50", "p95", "p99")]
        assert last[w.key].spread == pytest.approx(w.spread) and last[w.key].total == pytest.approx(w.total)
