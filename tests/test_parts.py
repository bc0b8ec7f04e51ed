"""Operators, layout functions, binary sources, filters, streaming and the command line."""

import struct
import subprocess
import sys
import os

import pytest
from pyspark.sql import functions as F

from runstore import RunStore
from runstore.functions import bloom, layout
from runstore.functions.scalar import bloom_places, decode, encode, run_name
from runstore.operators import merge
from runstore.schema import ENTRY, OPLOG
from runstore.sources import oplog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ops(spark, *rows):
    return spark.createDataFrame([(i + 1, op, k, v) for i, (op, k, v) in enumerate(rows)], OPLOG)


def test_newest_wins_and_tombstones(spark):
    rows = merge.entries(ops(spark, ("P", b"a", b"1"), ("P", b"b", b"2"), ("D", b"a", None), ("D", b"c", None), ("P", b"c", b"")))
    assert {(bytes(r.key), bytes(r.value)) for r in merge.newest_wins(rows).collect()} == {(b"b", b"2"), (b"c", b"")}
    assert {(bytes(r.key), r.tomb) for r in merge.newest_wins(rows, True).collect()} == {(b"a", True), (b"b", False), (b"c", False)}
    keys = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"z"),)], "key binary")
    assert [bytes(r.key) for r in merge.contains(rows, keys).collect()] == [b"a"]  # a tombstone is an entry
    assert {bytes(r.key) for r in merge.remove(rows, keys).collect()} == {b"b", b"c"}
    assert tuple(merge.tail_size(rows).first()) == (3, 4)
    empty = spark.createDataFrame([], ENTRY)
    assert merge.newest_wins(empty).count() == 0 and tuple(merge.tail_size(empty).first()) == (0, 0)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_filter_reaches_the_scan_and_tombstones_do_not(spark, tmp_path):
    at = str(tmp_path / "run")
    merge.entries(ops(spark, ("P", b"a", b"1"), ("D", b"a", None))).write.parquet(at)
    p = plan(merge.scan(spark.read.parquet(at), b"a", b"b"))
    pushed = p[p.index("PushedFilters") :].split("]")[0]
    assert "GreaterThanOrEqual(key" in pushed and "LessThanOrEqual(key" in pushed and "tomb" not in pushed


def test_valid_prefix(spark):
    rows = spark.createDataFrame([("a", 0, True), ("a", 1, False), ("a", 2, True), ("b", 0, True), ("b", 1, True)], "log string, pos long, ok boolean")
    assert {(r.log, r.pos) for r in merge.valid_prefix(rows, log="log").collect()} == {("a", 0), ("b", 0), ("b", 1)}
    assert merge.valid_prefix(rows.where("log = 'b'")).count() == 2


def test_logs_from_files(spark, tmp_path):
    good = oplog.encode_record("P", b"k", b"v") + oplog.encode_record("D", b"gone") + oplog.encode_record("P", b"", b"")
    bad = bytearray(oplog.encode_record("P", b"x", b"y"))
    bad[10] ^= 1
    (tmp_path / "a.log").write_bytes(good + bytes(bad) + good)
    (tmp_path / "b.log").write_bytes(good[:-3])
    (tmp_path / "c.log").write_bytes(b"")
    rows = oplog.read_logs(spark, *[f"file://{tmp_path}/{n}.log" for n in "abc"], f"file://{tmp_path}/none.log").collect()
    assert sorted((r.path[-5], r.pos, r.op, bytes(r.key), r.value and bytes(r.value)) for r in rows) == [("a", 0, "P", b"k", b"v"), ("a", 1, "D", b"gone", None), ("a", 2, "P", b"", b""), ("b", 0, "P", b"k", b"v"), ("b", 1, "D", b"gone", None)]
    assert oplog.read_logs(spark, f"file://{tmp_path}/none.log").count() == 0


def table_file(rows):
    data = b"".join(struct.pack("<I", len(k)) + k + (struct.pack("<I", 0xFFFFFFFF) if v is None else struct.pack("<I", len(v)) + v) for k, v in rows)
    low, high = (rows[0][0], rows[-1][0]) if rows else (b"", b"")
    return b"LSST" + data + low + high + struct.pack("<QQQQQQII", len(data), 4 + len(data), 0, 4 + len(data), 0, len(rows), len(low), len(high)) + b"LSST"


def test_tables_from_files(spark, tmp_path):
    rows = [(b"key%03d" % i, None if i % 7 == 0 else b"" if i % 5 == 0 else b"v%d" % i) for i in range(50)]
    (tmp_path / "1.sst").write_bytes(table_file(rows))
    got = oplog.read_tables(spark, f"file://{tmp_path}/1.sst").orderBy("key").collect()
    assert [(bytes(r.key), None if r.tomb else bytes(r.value)) for r in got] == rows
    meta, _ = oplog.decode_table(table_file(rows))
    assert meta == {"num_entries": 50, "min_key": b"key000", "max_key": b"key049"}
    assert oplog.decode_table(table_file([]))[0]["min_key"] is None
    for raw in (b"nothing like a table, though long enough to hold a footer", table_file(rows)[:-1], b"LSSTLSST"):
        with pytest.raises(ValueError):
            oplog.decode_table(raw)


def full_table(spark, rows, interval=16):
    """A table file with an index and a filter, as other writers make them."""
    data, index = b"", b""
    for i, (k, v) in enumerate(rows):
        index += struct.pack("<I", len(k)) + k + struct.pack("<Q", len(data)) if i % interval == 0 else b""
        data += struct.pack("<I", len(k)) + k + (struct.pack("<I", 0xFFFFFFFF) if v is None else struct.pack("<I", len(v)) + v)
    keys = spark.createDataFrame([(bytearray(k),) for k, _ in rows], "key binary")
    probe = bloom.build(keys, len(rows), portable=True).to_bytes()
    at = 4 + len(data)
    foot = struct.pack("<QQQQQQII", len(data), at, len(index), at + len(index), len(probe), len(rows), len(rows[0][0]), len(rows[-1][0]))
    return b"LSST" + data + index + probe + rows[0][0] + rows[-1][0] + foot + b"LSST"


def test_lookups_in_table_files(spark, tmp_path):
    rows = [(b"key%03d" % (2 * i), None if i % 7 == 0 else b"v%d" % i) for i in range(500)]
    raw = full_table(spark, rows)
    (tmp_path / "1.sst").write_bytes(raw)
    (tmp_path / "2.sst").write_bytes(table_file(rows[:100]))
    t = oplog.TableFile(raw)
    assert len(t.index_keys) == 32 and list(t.entries()) == rows and t.seek(b"key") == 4
    assert all(t.get(k) == (True, v) for k, v in rows)
    absent = [b"key%03d" % (2 * i + 1) for i in range(500)] + [b"", b"zzz"]
    assert all(t.get(k) == (False, None) for k in absent) and not t.may_hold(b"zzz")
    assert sum(t.may_hold(k) for k in absent) < 0.04 * len(absent)  # the filter, sized for 1 %
    assert next(t.entries(t.seek(b"key401")))[0] == b"key384"  # entry 192 of 500, the last indexed below
    assert list(t.range(b"key101", b"key111")) == rows[51:56] and list(t.range(None, b"key002")) == rows[:2] and not list(t.range(b"x", None))
    got = oplog.lookup_tables(spark, [b"key000", b"key008", b"key500", b"nope"], f"file://{tmp_path}/*.sst").collect()
    assert sorted((r.path[-5], bytes(r.key), r.tomb, r.value and bytes(r.value)) for r in got) == [("1", b"key000", True, None), ("1", b"key008", False, b"v4"), ("1", b"key500", False, b"v250"), ("2", b"key000", True, None), ("2", b"key008", False, b"v4")]
    part = oplog.read_tables(spark, f"file://{tmp_path}/1.sst", start=b"key101", end=b"key111")
    assert sorted((bytes(r.key), r.value and bytes(r.value)) for r in part.collect()) == rows[51:56]


def test_filters_as_bytes(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).cast("binary").alias("key"))
    built = bloom.build(keys, 3000, 0.02, portable=True)
    raw = built.to_bytes()
    bits, hashes, n = struct.unpack_from("<III", raw)
    assert (bits, hashes) == bloom.sizes(3000, 0.02) and n == len(raw) - 12 == -(-bits // 8)
    plain = bytearray(n)
    for i in range(3000):
        for p in bloom.places(b"k%d" % i, bits, hashes):
            plain[p // 8] |= 1 << p % 8
    assert raw[12:] == bytes(plain)
    again = bloom.from_bytes(spark, raw)
    assert again.to_bytes() == raw and again.might_contain(keys).where("not maybe").count() == 0
    some = spark.range(2000).select(F.concat(F.lit("absent"), F.col("id")).cast("binary").alias("key"))
    maybe = {bytes(r.key) for r in again.might_contain(some).where("maybe").collect()}
    own = bloom.Bits(raw)
    assert maybe == {b"absent%d" % i for i in range(2000) if own.may_hold(b"absent%d" % i)} and len(maybe) < 160
    assert not bloom.Bits(bloom.build(keys.limit(0), 0, portable=True).to_bytes()).may_hold(b"x")
    for bad in (b"", raw[:100]):
        with pytest.raises(ValueError):
            bloom.Bits(bad)


def test_sparse_index_by_blocks(spark):
    rows = merge.entries(ops(spark, *[("P", b"k%03d" % i, b"v" * (i % 9)) for i in range(200)])).withColumn("run", F.col("seq") % 2)
    whole = sorted(map(tuple, layout.sparse_index(rows).collect()))
    assert len(whole) == 14 and whole == sorted(map(tuple, layout.sparse_index(rows, block=F.substring("key", 1, 3)).collect()))


def test_candidate_runs_makes_no_row_for_a_key_and_run(spark):
    meta = spark.createDataFrame([(1, b"a", b"m"), (2, b"c", b"z"), (3, None, None)], "run long, min_key binary, max_key binary")
    keys = spark.createDataFrame([(b"a",), (b"d",), (b"d",), (b"zz",)], "key binary")
    out = layout.candidate_runs(meta, keys)
    assert {(bytes(r.key), r.candidates) for r in out.collect()} == {(b"a", 1), (b"d", 2), (b"zz", 0)}
    assert "Join" not in plan(out)
    assert {r.candidates for r in layout.candidate_runs(meta.limit(0), keys).collect()} == {0}


def test_scalar_functions(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"), "é")], "b binary, s string")
    r = df.select(decode(F.col("b")).alias("d"), encode(F.col("s")).alias("e"), run_name(F.lit(7)).alias("n")).first()
    assert (r.d, bytes(r.e), r.n) == ("a�b", "é".encode(), "0000000007")


def test_bloom(spark):
    import hashlib

    key = lambda n, at=0: spark.range(at, at + n).select(F.concat(F.lit("key-"), F.col("id")).cast("binary").alias("key"))
    b = bloom.build(key(2000), 2000, 0.02)
    assert b.might_contain(key(2000)).where("not maybe").count() == 0
    assert b.might_contain(key(5000, 10_000)).where("maybe").count() < 0.08 * 5000
    assert bloom.build(key(0), 0).might_contain(key(5)).where("maybe").count() == 0 and bloom.sizes(0) == (10, 7)
    d = hashlib.blake2b(b"key-0", digest_size=16).digest()
    h1, h2 = (int.from_bytes(d[i : i + 8], "little") for i in (0, 8))
    assert key(1).select(bloom_places(F.col("key"), 1000, 3).alias("p")).first().p == [(h1 + i * (h2 + (h2 % 2 == 0))) % 1000 for i in range(3)]


def test_log_offsets_across_blocks(spark):
    rows = ops(spark, *[("P", b"k" * (i % 5), b"v" * i) for i in range(40)])
    got = [tuple(r) for r in layout.log_offsets(rows, block=7).orderBy("seq").collect()]
    end, want = 0, []
    for i in range(40):
        n = 13 + i % 5 + i
        end += n
        want.append((i + 1, n, end))
    assert got == want


def test_stream_ingest(spark, tmp_path):
    from runstore.streaming.ingest import ingest

    source, at, state = (str(tmp_path / n) for n in ("source", "store", "state"))
    rows = ops(spark, *[("D" if i % 11 == 0 else "P", b"k%02d" % (i % 20), b"%d" % i) for i in range(90)])
    want = {bytes(r.key): bytes(r.value) for r in merge.newest_wins(merge.entries(rows)).collect()}
    for part in range(3):  # later operations first: the newest seq wins whatever the order of batches
        rows.where(F.col("seq") % 3 == 2 - part).write.mode("append").parquet(source)
        with RunStore(spark, at, compact_runs=99) as s:
            q = ingest(spark.readStream.schema(OPLOG).parquet(source), s, "ops", state)
            q.processAllAvailable()
            q.stop()
            assert s.manifest.batches == {"ops": part} and s.stats()["num_runs"] == part + 1
    with RunStore(spark, at) as s:
        assert {bytes(r.key): bytes(r.value) for r in s.scan().collect()} == want
        s.compact()
        assert {bytes(r.key): bytes(r.value) for r in s.scan().collect()} == want


def test_command_line(spark, tmp_path, capsys):
    from runstore import cli

    db = str(tmp_path / "data")

    def run(*args):
        parsed = cli.parser().parse_args(["--db", db, *args])
        code = parsed.run(store, parsed)
        out = capsys.readouterr()
        return code, out.out, out.err

    with RunStore(spark, db) as store:
        for k in "abcde":
            assert run("put", k, k.upper()) == (0, f"OK put '{k}'\n", "")
        assert run("get", "a") == (0, "A\n", "") and run("get", "zz") == (1, "(not found) 'zz'\n", "")
        assert run("delete", "c") == (0, "OK delete 'c'\n", "")
        assert run("scan", "--start", "b", "--end", "d") == (0, "b\tB\nd\tD\n", "(2 entries)\n")
        assert "memtable_entries: 5" in run("stats")[1] and "Nothing to compact" in run("compact")[1]
        store.flush()
        store.put(b"f", b"F")
        store.flush()
        assert "Merged 2 runs, which leaves 5 entries" in run("compact")[1]
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["unknown"])


def test_command_line_process(tmp_path):
    run = lambda *a: subprocess.run([sys.executable, "-m", "runstore.cli", "--db", str(tmp_path / "d"), *a], capture_output=True, text=True, cwd=ROOT, timeout=120)
    assert run("put", "foo", "bar").stdout == "OK put 'foo'\n"
    r = run("get", "foo")
    assert (r.returncode, r.stdout) == (0, "bar\n")


def test_bucketed_merge_needs_no_exchange(spark, tmp_path):
    from runstore.plans.bucketed import merged, write_bucketed

    rows = merge.entries(ops(spark, *[("D" if i % 9 == 0 else "P", b"k%02d" % (i % 30), b"%d" % i) for i in range(200)]))
    spark.sql("DROP TABLE IF EXISTS bucketed_entries")
    write_bucketed(rows.where("seq <= 120"), "bucketed_entries", 4, str(tmp_path / "t"))
    write_bucketed(rows.where("seq > 120"), "bucketed_entries", 4, str(tmp_path / "t"))
    out = merged(spark, "bucketed_entries")
    assert "Exchange" not in plan(out)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, merge.newest_wins(rows).collect()))
    spark.sql("DROP TABLE bucketed_entries")


def test_lookup_merges_only_what_is_asked(spark, tmp_path):
    at = str(tmp_path / "run")
    merge.entries(ops(spark, *[("P", b"k%03d" % i, b"v") for i in range(50)])).write.parquet(at)
    keys = spark.createDataFrame([(bytearray(b"k001"),)], "key binary")
    p = plan(merge.multi_get(spark.read.parquet(at), keys))
    assert p.index("LeftSemi") > p.index("Aggregate")  # below the merge
