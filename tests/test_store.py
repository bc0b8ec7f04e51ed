"""A store's behaviour: reads, flush, compaction, recovery and faults."""

import os
import random
import signal
import subprocess
import sys
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runstore import NOT_FOUND, CommitConflict, RunStore
from runstore.sources.oplog import encode_record


@pytest.fixture
def at(tmp_path):
    return str(tmp_path / "store")


def scanned(store, *bounds, **more):
    return [(bytes(r.key), bytes(r.value)) for r in store.scan(*bounds, **more).collect()]


def test_put_get_overwrite_delete(spark, at):
    with RunStore(spark, at) as s:
        assert s.get(b"a") is NOT_FOUND
        s.put(b"a", b"1")
        s.put(b"a", b"2")
        assert s.get(b"a") == b"2"
        s.delete(b"a")
        s.delete(b"never")
        assert s.get(b"a") is NOT_FOUND and s.get(b"never") is NOT_FOUND
        s.put(b"a", b"")
        assert s.get(b"a") == b""  # an empty value is a value


def test_flush_merges_with_tail(spark, at):
    with RunStore(spark, at) as s:
        assert s.flush() is None
        s.put(b"oslo", b"rain")
        s.put(b"pisa", b"sun")
        meta = s.flush()
        assert (meta["num_entries"], meta["min_key"], meta["max_key"]) == (2, b"oslo", b"pisa") and meta["size_bytes"] > 0
        s.put(b"oslo", b"snow")
        s.put(b"rome", b"wind")
        assert scanned(s) == [(b"oslo", b"snow"), (b"pisa", b"sun"), (b"rome", b"wind")]
        assert s.get(b"oslo") == b"snow" and s.get(b"pisa") == b"sun"
        assert s.stats()["memtable_entries"] == 2 and s.stats()["memtable_size_bytes"] == len(b"oslosnowromewind")
        s.delete(b"pisa")
        s.flush()
        assert s.get(b"pisa") is NOT_FOUND and scanned(s, b"oslo", b"pisa") == [(b"oslo", b"snow")]
        assert scanned(s, as_of=2) == [(b"oslo", b"rain"), (b"pisa", b"sun")]


def test_range_bounds_and_byte_order(spark, at):
    keys = [b"", b"\x00", b"a", b"ab", b"b", b"\x7f", b"\x80", b"\xff"]
    with RunStore(spark, at) as s:
        for k in random.Random(1).sample(keys, len(keys)):
            s.put(k, b"v" + k)
        for _ in range(2):
            assert [k for k, _ in scanned(s)] == sorted(keys)
            assert [k for k, _ in scanned(s, b"a", b"b")] == [b"a", b"ab", b"b"]
            assert [k for k, _ in scanned(s, None, b"a")] == [b"", b"\x00", b"a"]
            assert [k for k, _ in scanned(s, b"\x7f", None)] == [b"\x7f", b"\x80", b"\xff"]
            assert scanned(s, b"z", b"a") == []
            s.flush()


def test_threshold_flush_and_compaction(spark, at):
    with RunStore(spark, at, flush_bytes=1, compact_runs=4) as s:
        for i in range(3):
            s.put(b"k%d" % i, b"x")
        assert s.stats()["num_runs"] == 3
        s.put(b"k3", b"x")
        assert s.stats()["num_runs"] == 1 and len(scanned(s)) == 4


def test_compaction_drops_tombstones_only_with_all_runs(spark, at):
    with RunStore(spark, at) as s:
        s.put(b"gone", b"1")
        s.put(b"x", b"old")
        assert s.compact() is None
        s.flush()
        assert s.compact() is None  # one run
        s.delete(b"gone")
        s.put(b"x", b"new")
        assert s.flush()["num_entries"] == 2  # a tombstone counts
        s.put(b"tail", b"t")
        assert s.compact()["num_entries"] == 1
        assert scanned(s) == [(b"tail", b"t"), (b"x", b"new")]
        s.delete(b"x")
        s.flush()
        s.compact()
        s.delete(b"tail")
        s.flush()
        assert s.compact()["num_entries"] == 0 and scanned(s) == []


def test_reopen_replays_the_log(spark, at):
    s = RunStore(spark, at)
    s.put(b"a", b"1")
    s.flush()
    s.put(b"b", b"2")
    s.delete(b"a")
    s.close()
    s.close()
    for call in (lambda: s.put(b"x", b"y"), lambda: s.get(b"a"), s.scan, s.flush, s.compact, s.stats):
        with pytest.raises(RuntimeError):
            call()
    with RunStore(spark, at) as t:
        assert t.get(b"a") is NOT_FOUND and t.get(b"b") == b"2"


def test_torn_log_keeps_prefix_and_later_writes(spark, at):
    s = RunStore(spark, at)
    s.put(b"a", b"1")
    s.put(b"b", b"2")
    s.close()
    log = os.path.join(at, "oplog", os.listdir(os.path.join(at, "oplog"))[0])
    with open(log, "ab") as f:
        f.write(encode_record("P", b"c", b"3")[:-5])
    for i in range(2):  # what is written after a torn end must outlive another crash
        t = RunStore(spark, at)
        t.put(b"later%d" % i, b"x")
        t.close()
    with RunStore(spark, at) as t:
        assert [k for k, _ in scanned(t)] == [b"a", b"b", b"later0", b"later1"]


def test_flipped_byte_ends_replay(spark, at):
    s = RunStore(spark, at)
    s.put(b"good", b"1")
    s.put(b"bad", b"2")
    s.close()
    log = os.path.join(at, "oplog", os.listdir(os.path.join(at, "oplog"))[0])
    raw = bytearray(open(log, "rb").read())
    raw[len(encode_record("P", b"good", b"1")) + 10] ^= 1
    open(log, "wb").write(raw)
    with RunStore(spark, at) as t:
        assert [k for k, _ in scanned(t)] == [b"good"]


def test_batches(spark, at):
    with RunStore(spark, at, flush_bytes=1 << 30) as s:
        df = spark.range(200).select(F.format_string("key%03d", "id").cast("binary").alias("key"), F.col("id").cast("string").cast("binary").alias("value"))
        s.put_many(df)
        s.put(b"key005", b"single")
        s.delete_many(df.where("value in ('1', '2')"))
        assert s.stats()["memtable_entries"] == 200
        for _ in range(2):
            got = dict(scanned(s))
            assert len(got) == 198 and got[b"key005"] == b"single" and got[b"key199"] == b"199"
            asked = spark.createDataFrame([(bytearray(b"key001"),), (bytearray(b"key003"),), (bytearray(b"no"),), (bytearray(b"no"),)], "key binary")
            assert {(bytes(r.key), r.found, r.value and bytes(r.value)) for r in s.multi_get(asked).collect()} == {(b"key001", False, None), (b"key003", True, b"3"), (b"no", False, None)}
            assert s.get(b"key002") is NOT_FOUND and s.get(b"key004") == b"4"
            s.flush()
        with pytest.raises(ValueError):
            s.put_many(df.limit(2).withColumn("seq", F.lit(10**15)))
    with RunStore(spark, at) as t:
        assert len(scanned(t)) == 198


def test_crash_between_manifest_and_cleanup(spark, at, monkeypatch):
    s = RunStore(spark, at)
    s.put(b"a", b"1")
    s.put(b"dead", b"1")
    s.flush()
    s.delete(b"dead")
    monkeypatch.setattr(s.files, "delete", lambda name: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        s.flush()
    s._log.close()
    with RunStore(spark, at) as t:  # the log is still there, and is known to be in a run
        assert t.stats()["memtable_entries"] == 0 and t.get(b"dead") is NOT_FOUND
        monkeypatch.setattr(t.files, "delete", lambda name: (_ for _ in ()).throw(OSError("crash")))
        t.compact()  # deletes nothing
        with pytest.raises(OSError):
            t.vacuum(0)
    with RunStore(spark, at) as t:  # no deleted key comes back, whatever old runs are left
        assert scanned(t) == [(b"a", b"1")]
        assert t.vacuum() == []  # nothing is old enough
        assert len(t.vacuum(0)) >= 3 and scanned(t) == [(b"a", b"1")] and t.vacuum(0) == []


def test_reads_keep_their_version(spark, at):
    pairs = lambda rows: {(bytes(r.key), bytes(r.value)) for r in rows.collect()}
    with RunStore(spark, at, flush_bytes=1 << 30) as s:
        s.put_many(spark.createDataFrame([(b"a", b"1"), (b"b", b"1")], "key binary, value binary"))
        s.put(b"c", b"1")
        tail = s.scan()
        s.flush()
        s.put(b"a", b"2")
        s.delete(b"b")
        mixed = s.scan(b"a", b"c")
        s.flush()
        runs = s.scan()
        s.compact()
        assert pairs(tail) == {(b"a", b"1"), (b"b", b"1"), (b"c", b"1")}
        assert pairs(mixed) == pairs(runs) == pairs(s.scan()) == {(b"a", b"2"), (b"c", b"1")}
        assert s.vacuum(3600) == [] and len(pairs(tail)) == 3
        gone = s.vacuum(0)
        assert sum(n.startswith("runs/") for n in gone) == 2 and sum(n.startswith("oplog/") for n in gone) == 1
        assert pairs(s.scan()) == {(b"a", b"2"), (b"c", b"1")}


def test_vacuum_keeps_what_was_current_lately(spark, at):
    with RunStore(spark, at, flush_bytes=1, compact_runs=99) as s:
        for k in range(3):
            s.put(b"k%d" % k, b"x")
        old = s.scan()
        s.compact()  # version 4
        hour_ago = time.time() - 3600
        for n in (1, 2, 3):
            os.utime(f"{at}/_manifest/{n:010d}.json", (hour_ago + n, hour_ago + n))
        for n in os.listdir(f"{at}/runs"):
            os.utime(f"{at}/runs/{n}", (hour_ago, hour_ago))
        # version 3 was current until now, so its runs stay; versions 1 and 2 aren't needed
        assert sorted(s.vacuum(60)) == [f"_manifest/{n:010d}.json" for n in (1, 2)]
        assert old.count() == 3
        assert len(s.vacuum(0)) == 4 and s.scan().count() == 3


def test_own_seq_must_be_above_all_before(spark, at):
    rows = lambda *seqs: spark.createDataFrame([(n, bytearray(b"k"), bytearray(b"%d" % n)) for n in seqs], "seq long, key binary, value binary")
    with RunStore(spark, at) as s:
        s.put(b"k", b"single")  # operation 1
        for bad in ((1,), (0, 5), (7, 7)):
            with pytest.raises(ValueError):
                s.put_many(rows(*bad))
        assert s.get(b"k") == b"single"
        s.put_many(rows(4, 9))
        with pytest.raises(ValueError):  # a segment that isn't in a run yet counts too
            s.put_many(rows(9))
        assert s.get(b"k") == b"9" and scanned(s) == [(b"k", b"9")]


def test_compaction_by_tiers(spark, at):
    with RunStore(spark, at, flush_bytes=1 << 40, compact_runs=3) as s:
        big = spark.range(20_000).select(F.format_string("key%06d", "id").cast("binary").alias("key"), F.sha2(F.col("id").cast("string"), 512).cast("binary").alias("value"))
        s.put_many(big)
        s.flush()
        old = s.manifest.runs[0].folder
        for k in range(6):
            s.put(b"new%d" % k, b"x")
            s.delete(b"key%06d" % k)
            s.flush()
            assert len(s.manifest.runs) < 3
        # small runs were merged with each other only, and keep their tombstones
        assert [r.folder for r in s.manifest.runs][-1] == old and s.manifest.runs[0].num_entries == 12 - 2 * (len(s.manifest.runs) - 2)
        assert s.scan().count() == 20_000 and s.get(b"key000003") is NOT_FOUND and s.get(b"new3") == b"x"
        assert s.compact()["num_entries"] == 20_000 and s.get(b"key000003") is NOT_FOUND


def test_batches_are_split_by_size(spark, at, monkeypatch):
    monkeypatch.setattr("runstore.store.RUN_FILE_BYTES", 100_000)
    ops = spark.range(1, 20_001).select(F.col("id").alias("seq"), F.lit("P").alias("op"), F.format_string("key%06d", "id").cast("binary").alias("key"), F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("value"))
    with RunStore(spark, at) as s:
        s.put_batch(ops, ("ops", 0))
        files = [n for n in os.listdir(f"{at}/{s.manifest.runs[0].folder}") if n.endswith(".parquet")]
        assert len(files) == 14 and s.manifest.runs[0].num_entries == 20_000  # of 73 bytes each
        got = {r.i: (bytes(r.key), r.offset) for r in s.sparse_index().collect()}
        assert len(got) == 1250 and all(got[i] == (b"key%06d" % (i + 1), i * 81) for i in got)


def test_lookups_read_only_runs_that_may_hold_the_keys(spark, at, monkeypatch):
    with RunStore(spark, at, compact_runs=99) as s:
        for k, name in enumerate((b"a", b"m", b"z")):
            s.put_many(spark.createDataFrame([(bytearray(name + b"%d" % i), bytearray(b"%d" % k)) for i in range(5)], "key binary, value binary"))
            s.flush()
        s.put(b"a1", b"new")
        s.flush()
        read = []
        runs = RunStore._runs
        monkeypatch.setattr(RunStore, "_runs", lambda self, r: read.append([x.id for x in r]) or runs(self, r))
        asked = spark.createDataFrame([(bytearray(b"m1"),), (bytearray(b"m4"),), (bytearray(b"m9"),), (None,)], "key binary")
        got = s.multi_get(asked)
        assert {(bytes(r.key), r.found, r.value and bytes(r.value)) for r in got.collect()} == {(b"m1", True, b"1"), (b"m4", True, b"1"), (b"m9", False, None)}
        assert read == [[2]]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "In(key" in plan[plan.index("PushedFilters") :]
        monkeypatch.setattr("runstore.store.PUSHED_KEYS", 2)
        assert {(bytes(r.key), r.found) for r in s.multi_get(asked).collect()} == {(b"m1", True), (b"m4", True), (b"m9", False)}
        assert s.multi_get(asked.limit(0)).count() == 0
        del read[:]
        assert s.get(b"a1") == b"new" and read == [[4]]  # newer than all the others: the search ends
        assert s.get(b"a2") == b"0" and s.get(b"zz") is NOT_FOUND


def test_crash_before_manifest(spark, at, monkeypatch):
    s = RunStore(spark, at)
    s.put(b"a", b"1")
    monkeypatch.setattr(s, "_publish", lambda new: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        s.flush()
    s.close()
    with RunStore(spark, at) as t:
        assert t.get(b"a") == b"1" and t.stats()["num_runs"] == 0 and t.flush()["num_entries"] == 1


def test_second_writer_conflicts(spark, at):
    a, b = RunStore(spark, at), RunStore(spark, at)
    a.put(b"a", b"1")
    with pytest.raises(FileExistsError):
        b.put(b"b", b"1")
    b.put(b"b", b"1")
    a.flush()
    with pytest.raises(CommitConflict):
        b.flush()
    a.close(), b.close()


def test_empty_store(spark, at):
    with RunStore(spark, at) as s:
        assert scanned(s) == [] and s.stats() == {"memtable_entries": 0, "memtable_size_bytes": 0, "num_runs": 0, "run_files": [], "num_sstables": 0, "sstable_files": []}


OPS = st.lists(st.one_of(st.tuples(st.just("put"), st.sampled_from([b"", b"a", b"ab", b"b", b"\xff"]), st.binary(max_size=3)), st.tuples(st.just("delete"), st.sampled_from([b"", b"a", b"ab", b"b"]), st.none()), st.tuples(st.sampled_from(["flush", "compact", "reopen"]), st.none(), st.none())), max_size=14)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(OPS)
def test_like_a_dict(spark, tmp_path_factory, ops):
    at, model = str(tmp_path_factory.mktemp("model")), {}
    s = RunStore(spark, at)
    for what, key, value in ops:
        if what == "put":
            s.put(key, value)
            model[key] = value
        elif what == "delete":
            s.delete(key)
            model.pop(key, None)
        elif what == "reopen":
            s.close()
            s = RunStore(spark, at)
        else:
            getattr(s, what)()
    assert scanned(s) == sorted(model.items())
    assert all(s.get(k) == model.get(k, NOT_FOUND) for k in (b"a", b""))
    s.close()


WRITER = """
import sys
from runstore.plans.storage import Local
from runstore.sources.oplog import encode_record
log = Local(sys.argv[1]).log("oplog")
with open(sys.argv[2], "w", buffering=1) as acked:
    for i in range(4000):
        log.append(i + 1, encode_record("P", b"key-%06d" % i, b"value-%06d" % i))
        acked.write(f"{i}\\n")
"""


@pytest.mark.parametrize("delay", [0.01, 0.05, 0.2])
def test_killed_writer_keeps_what_it_acknowledged(spark, tmp_path, delay):
    at, acked = str(tmp_path / "store"), tmp_path / "acked"
    p = subprocess.Popen([sys.executable, "-c", WRITER, at, str(acked)], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    while not (acked.exists() and acked.read_text()):
        time.sleep(0.005)
    time.sleep(delay)
    p.send_signal(signal.SIGKILL)
    p.wait()
    n = acked.read_text().count("\n")
    with RunStore(spark, at) as s:
        assert all(s.get(b"key-%06d" % i) == b"value-%06d" % i for i in range(n))
        assert all(s.get(b"key-%06d" % i) is NOT_FOUND for i in range(n + 1, n + 50))
        s.put(b"after", b"1")
        s.flush()
    with RunStore(spark, at) as s:
        assert s.get(b"after") == b"1" and s.get(b"key-000000") == b"value-000000"


def test_hadoop_file_systems(spark, at, monkeypatch):
    from runstore.plans.storage import Hadoop

    monkeypatch.setattr("runstore.store.storage", lambda spark, path: Hadoop(spark, "file://" + path))
    with RunStore(spark, at) as s:
        s.put(b"a", b"\x00\xff")
        s.delete(b"b")
    s, t = RunStore(spark, at), RunStore(spark, at)
    assert s.get(b"a") == b"\x00\xff" and s.stats()["memtable_entries"] == 2
    s.put_many(spark.createDataFrame([(bytearray(b"c"), bytearray(b"3"))], "key binary, value binary"))
    assert s.flush()["size_bytes"] > 0
    with pytest.raises(CommitConflict):
        t.flush()
    s.put(b"d", b"4")
    s.flush()
    s.compact()
    assert scanned(s) == [(b"a", b"\x00\xff"), (b"c", b"3"), (b"d", b"4")] and len(s.vacuum(0)) >= 1
    s.close(), t.close()
