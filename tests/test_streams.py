"""Streams in several batches, with restarts, late and repeated events, against their batch twins; tables that commit together."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelweave.operators import filters as fl
from reelweave.operators import merge as mg
from reelweave.operators import ranking as rk
from reelweave.sources.store import ConflictingCommit, Store
from reelweave.streaming import jobs, stateful

START = datetime(2024, 1, 1)


def drop_file(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def source(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def state_rows(spark, checkpoint, variable):
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


def test_rate_limit_in_three_batches(spark, tmp_path):
    rnd = random.Random(1)
    schema = "event_id bigint, user_id bigint, ts timestamp"
    events = [(i if i else None, rnd.choice([0, 1, 2, None]), START + timedelta(seconds=rnd.random() * 900)) for i in range(300)]
    events.sort(key=lambda e: e[2])
    batches = [[], [], []]
    for i, e in enumerate(events):
        batches[min(2, max(0, int(3 * i / len(events) + rnd.uniform(-0.06, 0.06))))].append(e)
    batches[1] += batches[0][-8:]  # these come again
    for batch in batches:
        rnd.shuffle(batch)
        drop_file(spark, batch, schema, f"{tmp_path}/in")
        out = stateful.stream_rate_limit(source(spark, schema, f"{tmp_path}/in"), "user_id", "ts", "event_id", 8, 60, late="5 minutes")
        jobs.run_to_table(out, f"{tmp_path}/out")  # a new query each time: it goes on from its checkpoint
    drop_file(spark, [(-1, 9, START + timedelta(days=9))], schema, f"{tmp_path}/in")
    got = jobs.run_to_table(out, f"{tmp_path}/out").collect()
    once = spark.createDataFrame(events, schema)
    want = rk.flag_rate_limited(once.filter("user_id IS NOT NULL"), "user_id", "ts", "event_id", 8, 60).collect()
    nobody = rk.flag_rate_limited(once.filter("user_id IS NULL").withColumn("user_id", F.lit(-7).cast("bigint")), "user_id", "ts", "event_id", 8, 60).collect()
    assert sorted(map(str, got)) == sorted(map(str, [*want, *[r.__class__(user_id=None, event_id=r.event_id, admitted=r.admitted) for r in nobody]]))
    checkpoint = f"{tmp_path}/out-checkpoint"
    assert state_rows(spark, checkpoint, "admitted").count() == 0
    assert state_rows(spark, checkpoint, "waiting").count() == 1  # the last event


class _List:
    """A list state in memory."""

    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(list(self.rows))

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows += rows

    def clear(self):
        self.rows = []


class _Handle:
    def __init__(self):
        self.timers, self.states = set(), {}

    def getListState(self, name, schema):
        return self.states.setdefault(name, _List())

    def registerTimer(self, at):
        self.timers.add(at)


class _Now:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at

    getCurrentWatermarkInMs = getExpiryTimeInMs


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_passed_slots_of_a_key_are_decided_at_one_timer(chunk):
    handle = _Handle()
    admission = stateful._Admission(3, 60_000_000, 1000)
    admission.CHUNK = chunk
    admission.init(handle)
    rnd = random.Random(2)
    times = rnd.sample(range(400_000_000), 200)
    rows = pd.DataFrame({"at_us": times + times[:20], "row_json": [f'{{"event_id":{i}}}' for i in [*range(200), *range(20)]]})
    list(admission.handleInputRows(("k",), iter([rows.iloc[:110], rows.iloc[110:]]), _Now(0)))
    fired, got = 0, []
    for watermark in (200_000, 500_000, 600_000):
        due = sorted(t for t in handle.timers if t <= watermark)
        handle.timers -= set(due)
        for at in due:
            fired += 1
            for frame in admission.handleExpiredTimer(("k",), _Now(watermark), _Now(at)):
                got += frame.itertuples(index=False)
    assert fired <= 3  # one for each watermark, not one a slot
    want, kept = [], []
    for i, us in sorted(enumerate(times), key=lambda e: e[1]):
        kept = [t for t in kept if t > us - 60_000_000]
        want.append(("k", f'{{"event_id":{i}}}', len(kept) < 3))
        kept += [us] if want[-1][2] else []
    assert [tuple(r) for r in got] == want
    assert not handle.timers and not any(s.rows for s in handle.states.values())


def test_inactivity_equals_the_batch_job_after_every_batch(spark, tmp_path):
    schema = "thread_hash string, status string, last_updated timestamp"
    store = Store(spark, f"{tmp_path}/store")
    rnd = random.Random(4)
    seen = []
    for round_ in range(4):
        rows = [(f"h{rnd.randrange(12)}", rnd.choice(["active", "active", "paused"]), START + timedelta(days=20 * round_ + rnd.random() * 20)) for _ in range(8)]
        seen += rows
        drop_file(spark, rows, schema, f"{tmp_path}/in")
        out = stateful.stream_inactivity(source(spark, schema, f"{tmp_path}/in"), late="0 seconds").withColumn("timer", F.col("status") == "archived")
        table = jobs.run_keyed(out, store, "watch", ["thread_hash"], ["last_updated", "timer"], "append")
        watermark = max(r[2] for r in seen).replace(microsecond=max(r[2] for r in seen).microsecond // 1000 * 1000)
        latest = rk.latest_by_key(spark.createDataFrame(seen, schema), ["thread_hash"], ["last_updated"])
        want = mg.archive_inactive(latest, F.lit(watermark)).select("thread_hash", "status", "last_updated")
        assert sorted(map(tuple, table.select("thread_hash", "status", "last_updated").collect())) == sorted(map(tuple, want.collect())), round_
        live = want.filter("status = 'active'").count()
        assert state_rows(spark, f"{tmp_path}/store/checkpoints/watch", "latest").count() == live


def test_expiry_equals_the_batch_job(spark, tmp_path):
    schema = "table_name string, k string, ts timestamp"
    rnd = random.Random(6)
    rows = [(t, f"k{rnd.randrange(5)}", START + timedelta(days=rnd.random() * 20)) for t in (*stateful.LIFE_MS, "other") for _ in range(9)]
    rows.sort(key=lambda r: r[2])
    for part in (rows[:20], rows[20:], [("other", "end", START + timedelta(days=24))]):
        drop_file(spark, part, schema, f"{tmp_path}/in")
    got = jobs.run_to_table(stateful.stream_expiry(source(spark, schema, f"{tmp_path}/in"), "k", "ts", late="1 hour"), f"{tmp_path}/out")
    now = START + timedelta(days=24) - timedelta(hours=1)
    latest = rk.latest_by_key(spark.createDataFrame(rows, schema), ["table_name", "k"], ["ts"])
    left = set()
    for name, ms in stateful.LIFE_MS.items():
        gone = fl.expire(latest.filter(F.col("table_name") == name), "ts", F.lit(now), hours=ms // 3_600_000)[1]
        left |= {tuple(r) for r in gone.select("table_name", "k", "ts").collect()}
    last = rk.latest_by_key(got, ["table_name", "k"], ["ts"])  # a key may run out, come back and run out again
    assert {tuple(r) for r in last.select("table_name", "k", "ts").collect()} >= left
    assert state_rows(spark, f"{tmp_path}/out-checkpoint", "latest").count() == latest.filter("table_name <> 'other'").count() - len(left)


def test_counts_in_update_mode(spark, tmp_path):
    schema = "ts timestamp, kind string"
    store = Store(spark, f"{tmp_path}/store")
    rows = [(START + timedelta(hours=7 * i), "ab"[i % 2]) for i in range(30)]
    for part in (rows[:10], rows[8:20], rows[20:]):
        drop_file(spark, part, schema, f"{tmp_path}/in")
        table = jobs.run_keyed(jobs.stream_status_counts(source(spark, schema, f"{tmp_path}/in"), "ts", "kind", "1 day", "3 days"), store, "n", ["day", "kind"])
    want = spark.createDataFrame(rows + rows[8:10], schema).groupBy(F.date_trunc("day", "ts").alias("day"), "kind").agg(F.count("*").alias("n"))
    assert sorted(map(str, table.collect())) == sorted(map(str, want.collect()))


# --- tables that change together -------------------------------------------------

def test_readers_see_whole_commits(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one, two = spark.range(3), spark.range(5)
    assert store.commit({"a": one, "b": one}, ("s", 0)) == 1
    before = store.read("a")
    broken = spark.range(2).select(F.raise_error(F.lit("lost")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"a": two, "b": broken}, ("s", 1))
    assert (store.read("a").count(), store.read("b").count(), store.versions()) == (3, 3, [1])
    assert store.commit({"a": two, "b": two}, ("s", 1)) == 2  # the batch runs again
    assert store.commit({"a": one}, ("s", 1)) == 2  # and once more: nothing happens
    assert (store.read("a").count(), store.read("b").count()) == (5, 5)
    assert before.count() == 3 and store.read("a", 1).count() == 3
    gone = store.vacuum()
    assert len(gone) >= 2 and store.versions() == [2] and store.read("a").count() == 5
    with pytest.raises(ConflictingCommit):
        store.commit({"a": one}, base=1)
    with pytest.raises(ConflictingCommit):
        store._publish(2, "{}")
    assert store.read("threads").columns[0] == "id"  # never written: empty, with its schema
