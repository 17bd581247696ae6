"""Streams that go on from where they stopped, take events in any order, and forget what time has ended."""

import os
import shutil

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kbspark.plans import streams
from kbspark.session import new_dir
from kbspark.streaming import jobs, ordered, rules
from kbspark.streaming.versions import Layered, Versioned


def said(rule, events):
    state, out = None, []
    for i, at, kind in events:
        state, x = rules.fold(rule, state, {"id": i, "at": at, "kind": kind})
        out += x
    return [o for _, _, o in out] + ([] if state is None else [x[2] for x in rules.lapsed(rule, state)])


def test_throttle_window_does_not_move_and_success_clears():
    fails = [(i, i, "failure") for i in range(5)]
    assert said(rules.Throttle(), [*fails, (5, 900, "failure"), (6, 901, "check")]) == ["allowed"] * 5 + ["locked", "allowed"]
    assert said(rules.Throttle(), [*fails[:4], (4, 5, "success"), *((i, 6 + i, "failure") for i in range(4)), (9, 11, "check")]) == ["allowed"] * 10


def test_tasks_renew_their_lease_and_stay_ended():
    run = [(1, 0, "enqueue"), (2, 10, "claim"), (3, 300, "progress"), (4, 600, "enqueue"), (5, 600, "progress")]
    assert said(rules.Tasks(), run) == ["queued", "running", "running", "reuse 1", "running", "failed: lost"]
    assert said(rules.Tasks(), [*run, (6, 900, "finish"), (7, 901, "fail"), (8, 902, "enqueue")])[5:] == ["done", "ignored", "queued", "failed: never started"]
    assert said(rules.Tasks(), [(1, 0, "enqueue"), (2, 301, "claim"), (3, 302, "finish")]) == ["queued", "failed: never started", "ignored", "ignored"]
    # Progress before a claim renews nothing; a claim after a claim changes nothing; a failure frees the question.
    assert said(rules.Tasks(), [(1, 0, "enqueue"), (2, 200, "progress"), (3, 301, "enqueue")])[:4] == ["queued", "ignored", "failed: never started", "queued"]
    assert said(rules.Tasks(), [(1, 0, "enqueue"), (2, 5, "fail"), (3, 6, "enqueue")])[:3] == ["queued", "failed", "queued"]


def test_repeats_count_from_the_one_logged():
    assert said(rules.Repeats(), [(1, 0, ""), (2, 59, ""), (3, 60, ""), (4, 119.9, "")]) == ["logged", "repeat", "logged", "repeat"]


SCHEMA = "key string, sub string, id long, at long, kind string"


def put(spark, rows, path, number):
    """One file of events at ``at`` seconds."""
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("at")).drop("at").coalesce(1)
    df.write.parquet(f"{path}/tmp-{number}")
    os.makedirs(f"{path}/in", exist_ok=True)
    (name,) = [f for f in os.listdir(f"{path}/tmp-{number}") if f.endswith(".parquet")]
    shutil.move(f"{path}/tmp-{number}/{name}", f"{path}/in/{number:03}.parquet")


def live(spark, path, files=1):
    return spark.readStream.schema("key string, sub string, id long, kind string, ts timestamp").option("maxFilesPerTrigger", files).parquet(f"{path}/in")


def outputs(df):
    return sorted(((r.key, r.sub, r.id, r.at, r.output) for r in df.collect()), key=repr)


def test_a_lease_runs_out_without_a_later_event_over_triggers_and_a_restart(spark, tmp_path):
    path, root = str(tmp_path), new_dir(spark, "tasks")
    first = [("o", "q1", 2, 90, "claim"), ("o", "q2", 3, 50, "enqueue"), ("other", "q1", 9, 100, "enqueue")]
    # The second file goes back behind the first one's end: the task was enqueued before it was claimed.
    second = [("o", "q1", 1, 10, "enqueue"), ("o", "q1", 4, 350, "progress"), ("o", "q1", 5, 360, "enqueue")]
    put(spark, first, path, 0)
    put(spark, second, path, 1)
    rule = rules.Tasks()
    got = outputs(jobs.drained(ordered.stateful(live(spark, path), rule, "2 minutes"), "tasks", root=root))
    # The watermark stands at 360 - 120: nothing later is said yet, and q2 and the other's task are still in time.
    assert got == [("o", "q1", 1, 10.0, "queued"), ("o", "q1", 2, 90.0, "running"), ("o", "q2", 3, 50.0, "queued"), ("other", "q1", 9, 100.0, "queued")]
    # Another run goes on; only a third owner says anything, and its time ends the others' leases.
    put(spark, [("third", "q", 20, 1000, "enqueue"), ("third", "q", 21, 1001, "fail")], path, 2)
    got = outputs(jobs.drained(ordered.stateful(live(spark, path), rule, "2 minutes"), "tasks", root=root))
    want = [("o", "q1", 4, 350.0, "running"), ("o", "q1", 5, 360.0, "reuse 1"), ("o", "q1", None, 650.0, "failed: lost"), ("o", "q2", None, 350.0, "failed: never started"), ("other", "q1", None, 400.0, "failed: never started")]
    assert [x for x in got if x[3] > 240] == sorted(want, key=repr) and len(got) == 9
    # What the replay in one go says up to the watermark is the same.
    events = spark.read.parquet(f"{path}/in")
    assert outputs(ordered.replayed(events, rule, until=1001 - 120)) == got
    # Ended tasks are forgotten: the state that is left holds the third owner's waiting events only.
    held = spark.read.format("statestore").option("stateVarName", "live").load(f"{root}/state")
    assert held.count() == 0


def test_a_restart_between_all_files_changes_nothing(spark, sf_dir, tmp_path):
    """Events in files out of order within the lateness allowed, one run a file, against one replay."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for name, hours in (("s_inflight_dedup", 72), ("s_login_throttle", 9)):
        rule, root, path = streams.RULES[name][0], new_dir(spark, name), str(tmp_path / name)
        rows = streams.keyed(events, name).withColumn("ts", F.timestamp_millis(F.unix_millis("ts")))
        # Neighbours in time are dealt to the files before and behind their own.
        place = F.greatest(F.lit(0), F.least(F.lit(3), F.floor(F.percent_rank().over(Window.orderBy("ts")) * 4 + (F.col("id") % 3 - 1) * 0.05)))
        rows.withColumn("place", place).repartition(4, "place").write.partitionBy("place").parquet(f"{path}/cut")
        for i in range(4):
            os.makedirs(f"{path}/in", exist_ok=True)
            for n, f in enumerate(f for f in os.listdir(f"{path}/cut/place={i}") if f.endswith(".parquet")):
                shutil.copy(f"{path}/cut/place={i}/{f}", f"{path}/in/{i}-{n}.parquet")
            got = jobs.drained(ordered.stateful(live(spark, path, 100), rule, f"{hours} hours"), name, root=root)
        most = rows.agg(F.max(F.unix_millis("ts"))).first()[0]
        want = outputs(ordered.replayed(rows, rule, until=most / 1000 - hours * 3600))
        assert len(want) > 500 and outputs(got) == want


def test_streams_do_not_depend_on_files(spark, sf_dir):
    """Events in 20 files without order give what one file gives."""
    folder = new_dir(spark, "cut")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(20, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
    assert len(spark.read.parquet(f"{folder}/events.parquet").inputFiles()) > 8
    runs = {"s_traffic": streams.s_traffic, "s_call_rate": streams.s_call_rate} | {name: streams._ruled(name) for name in streams.RULES}
    for name, run in runs.items():
        one, many = (sorted(map(str, run(spark, d).collect())) for d in (sf_dir, folder))
        assert one and one == many, name


def undo_last_commit(root):
    """As if the stream had stopped before it noted its last batch as done."""
    folder = f"{root.removeprefix('file://')}/state/commits"
    last = max(int(f) for f in os.listdir(folder) if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{folder}/{f}"):
            os.remove(f"{folder}/{f}")


def hit_files(spark, path, lists):
    for i, ids in enumerate(lists):
        put(spark, [("k", "", x, 0, "hit") for x in ids], path, i)


def test_retrieval_counts_each_batch_once(spark, tmp_path):
    path, root = str(tmp_path), new_dir(spark, "counters")
    start = spark.createDataFrame([(1, 10), (2, None)], "id long, n long")
    hit_files(spark, path, [[1, 1, 3], [2, 3]])
    read = lambda: sorted(map(tuple, jobs.retrieval(live(spark, path), start, root=root).collect()))
    want = [(1, 12), (2, 1), (3, 2)]
    assert read() == want and read() == want
    # The last batch is replayed: its version is there already.
    undo_last_commit(root)
    assert read() == want
    put(spark, [("k", "", 3, 0, "hit")], path, 7)
    assert read() == [(1, 12), (2, 1), (3, 3)]
    # A version written without a commit is written again.
    table = Versioned(spark, f"{root}/table")
    last = table.last()
    os.remove(f"{root.removeprefix('file://')}/table/commits/{last}")
    undo_last_commit(root)
    assert read() == [(1, 12), (2, 1), (3, 3)] and table.last() == last


def test_a_stream_that_fails_between_version_and_commit_goes_on(spark, tmp_path, monkeypatch):
    path, root = str(tmp_path), new_dir(spark, "counters")
    start = spark.createDataFrame([(1, 0)], "id long, n long")
    hit_files(spark, path, [[1], [1, 1], [1, 1, 1]])
    commit = Versioned.commit

    def failing(self, rows, batch):
        if batch == 1:
            rows.write.mode("overwrite").parquet(f"{self.root}/v={batch}")
            raise RuntimeError("stopped")
        commit(self, rows, batch)

    monkeypatch.setattr(Versioned, "commit", failing)
    with pytest.raises(Exception, match="stopped"):
        jobs.retrieval(live(spark, path), start, root=root)
    assert Versioned(spark, f"{root}/table").last() == 0
    monkeypatch.setattr(Versioned, "commit", commit)
    assert [tuple(r) for r in jobs.retrieval(live(spark, path), start, root=root).collect()] == [(1, 6)]
    # Old versions are removed, the newest are kept.
    kept = sorted(f for f in os.listdir(f"{root.removeprefix('file://')}/table") if f.startswith("v="))
    assert kept == ["v=0", "v=1", "v=2"]


def test_retention_replays_a_batch_without_doubling_rows(spark, tmp_path):
    path, root = str(tmp_path), new_dir(spark, "log")
    day = 86_400
    put(spark, [("k", "", i, i * day, "x") for i in range(10)], path, 0)
    put(spark, [("k", "", 100 + i, i * day, "x") for i in range(10)], path, 1)
    read = lambda: sorted(r.id for r in jobs.retention(live(spark, path), "1970-01-10", 4, root=root).collect())
    want = [5, 6, 7, 8, 9, 105, 106, 107, 108, 109]
    assert read() == want
    undo_last_commit(root)
    assert read() == want


def test_chunk_refresh_goes_on_from_its_table(spark, tmp_path):
    root = new_dir(spark, "chunks")
    saves = "id long, seq int, content_hash string, body string"
    stored = spark.createDataFrame([(1, 0, "a", "one"), (2, 0, "b", "two"), (2, 1, "b", "two, too")], "id long, ordinal int, content_hash string, text string")

    def read(rows=None, number=0):
        if rows:
            spark.createDataFrame(rows, saves).coalesce(1).write.parquet(str(tmp_path / f"in-{number}"))
        source = spark.readStream.schema(saves).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in-*"))
        return sorted((r.id, r.ordinal, r.content_hash, r.text) for r in jobs.chunk_refresh(source, stored, root=root).collect())

    want = [(1, 0, "a", "one"), (2, 0, "c", "new")]
    assert read([(1, 1, "a", "one"), (2, 1, "x", "old"), (2, 2, "c", "new")]) == want
    undo_last_commit(root)
    assert read() == want
    assert read([(3, 1, "d", "three")], 1) == [*want, (3, 0, "d", "three")]


def test_chunk_refresh_writes_only_what_a_batch_has_cut(spark, tmp_path):
    """Layers on one another, merged now and then; before, each batch wrote the whole table again."""
    root = new_dir(spark, "chunks")
    saves = "id long, seq int, content_hash string, body string"
    stored = spark.range(40).selectExpr("id", "0 AS ordinal", "'a' AS content_hash", "'old' AS text").union(spark.sql("SELECT NULL, 0, 'a', 'of none'"))
    want = {i: ("a", "old") for i in range(40)} | {None: ("a", "of none")}
    batches = [[(1, "b", "one")], [(1, "c", "two"), (2, "b", ""), (3, "a", "the same")], [(None, "x", "no id"), (4, None, "no hash")], [(i, "m", f"text {i}") for i in range(40)], [(i, "n", "again") for i in range(39)] + [(50, "n", None)], [(1, "z", "end")]]
    wrote, bases = [], []
    for number, rows in enumerate(batches):
        spark.createDataFrame([(i, 1, h, b) for i, h, b in rows], saves).coalesce(1).write.parquet(str(tmp_path / f"in-{number}"))
        source = spark.readStream.schema(saves).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in-*"))
        found = jobs.chunk_refresh(source, stored, root=root)
        want |= {i: (h, b or "") for i, h, b in rows if i is not None and h is not None and want.get(i, ("",))[0] != h}
        assert {r.id: (r.content_hash, r.text) for r in found.collect()} == want and found.count() == len(want)
        wrote.append(spark.read.parquet(f"{root}/table/v={number}").count())
        bases.append(Layered(spark, f"{root}/table", "id", "id long")._bases()[-1])
    assert wrote == [1, 2, 0, 40, 40, 1] and bases == [-1, -1, -1, -1, 4, 4]


def test_limits_over_all_actors(spark, tmp_path):
    """Three actors stay below their own limit and together exceed the one over all; the calls come in two triggers."""
    rows = [(f"2024-01-01 10:00:{s:02d}", actor, 100, None if s % 2 else 50) for s in range(0, 30, 5) for actor in (1, 2, 3)] + [("2024-01-01 12:00:00", 1, 1, None)]
    calls = spark.createDataFrame(rows, "at string, actor long, reserved long, actual long").select(F.to_timestamp("at").alias("ts"), "actor", "reserved", "actual")
    path = f"{tmp_path}/calls"
    calls.where("actor < 3 AND ts < '2024-01-01 11:00:00'").coalesce(1).write.parquet(path)
    calls.where("actor = 3 OR ts > '2024-01-01 11:00:00'").coalesce(1).write.mode("append").parquet(path)
    live = lambda: jobs.stream(spark, path, None)
    found = jobs.drained(jobs.call_rate(live(), 6, 17), "call-rate").collect()
    assert found and {(r.scope, r.actor) for r in found} == {("all", None)} and {r.n for r in found} == {18}
    assert {r.scope for r in jobs.drained(jobs.call_rate(live(), 5, 18), "call-rate").collect()} == {"actor"}
    one_by_one = jobs.stream(spark, path, 1)
    budget = jobs.latest(jobs.token_budget(one_by_one, 1000, 1000), ["scope", "actor", "day"], "token-budget").collect()
    assert {(r.scope, r.actor): (r.tokens, r.over) for r in budget} == {("actor", 1): (451, False), ("actor", 2): (450, False), ("actor", 3): (450, False), ("all", None): (1351, True)}


def test_keys_share_calls_and_state(spark, tmp_path):
    """Keys that share a bucket are folded each by itself, and state is called for once a bucket, not once a key."""
    rows = spark.createDataFrame([(f"task-{i}", "", 2 * i + k, 1000.0 + i % 7 + k, kind) for i in range(300) for k, kind in enumerate(("enqueue", "claim"))] + [("end", "", 9999, 9000.0, "enqueue")], "key string, sub string, id long, at double, kind string")
    path = str(tmp_path / "in")
    rows.select("key", "sub", "id", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("ts"), "kind").coalesce(1).write.parquet(path)
    events = spark.read.parquet(path)
    live_rows = spark.readStream.schema(events.schema).parquet(path)
    held, ordered.BUCKETS = ordered.BUCKETS, 3
    try:
        got = outputs(jobs.drained(ordered.stateful(live_rows, rules.Tasks(), "2 minutes"), "buckets"))
    finally:
        ordered.BUCKETS = held
    assert got == outputs(ordered.replayed(events, rules.Tasks(), until=9000 - 120)) and len(got) == 900
