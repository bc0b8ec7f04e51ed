"""The engine's operators as queries over the table ``events``, with the same in SQL.

The operation log is made from events: seq is event_id, the key is the user, errors are deletes,
and a run holds a thousand operations.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bloom, layout
from .functions.scalar import checksum, decode, encode, record_body, run_name
from .operators import merge
from .plans.storage import shared_folder
from .schema import FALSE_POSITIVES
from .sources import oplog
from .store import RunStore

START, END, KEY = "u000010", "u000050", "u000042"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, op, key, value) of events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_type") == "error", "D").otherwise("P")
    key = F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    return oplog.from_frame(e, F.col("event_id"), op, encode(key), F.concat_ws(":", "event_type", "props"))


def _last(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] or 0


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.entries(log(spark, sf_dir))


def _by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.by_run(_rows(spark, sf_dir).withColumn("run", F.floor(F.col("seq") / 1000).cast("long")))


def _shown(df: DataFrame) -> DataFrame:
    return df.select(decode(F.col("key")).alias("k"), decode(F.col("value")).alias("v"))


def kv_scan_all(spark, sf_dir):
    return _shown(merge.scan(_rows(spark, sf_dir)))


def kv_scan_range(spark, sf_dir):
    return _shown(merge.scan(_rows(spark, sf_dir), START.encode(), END.encode()))


def kv_scan_as_of(spark, sf_dir):
    return _shown(merge.scan(_rows(spark, sf_dir), as_of=_last(spark, sf_dir) // 2))


def kv_get(spark, sf_dir):
    return _shown(merge.scan(_rows(spark, sf_dir), KEY.encode(), KEY.encode()))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of which about half are there: twice the number of every user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(encode(F.concat(F.lit("u"), F.lpad((F.col("user_id") * 2).cast("string"), 6, "0"))).alias("key"))


def kv_multi_get(spark, sf_dir):
    got = merge.multi_get(_rows(spark, sf_dir), _asked(spark, sf_dir))
    return got.select(decode(F.col("key")).alias("k"), "found", decode(F.col("value")).alias("v"))


def kv_contains(spark, sf_dir):
    return merge.contains(_rows(spark, sf_dir), _asked(spark, sf_dir)).select(decode(F.col("key")).alias("k"))


def kv_remove(spark, sf_dir):
    gone = _asked(spark, sf_dir).where(F.col("key") >= encode(F.lit(END)))
    return _shown(merge.scan(merge.remove(_rows(spark, sf_dir), gone)))


def _meta(df: DataFrame, *by: str) -> DataFrame:
    return merge.run_meta(df, *by).select(*by, "num_entries", decode(F.col("min_key")).alias("min_k"), decode(F.col("max_key")).alias("max_k"), "tombstones")


def kv_flush_meta(spark, sf_dir):
    return _meta(_by_run(spark, sf_dir), "run").withColumn("file", run_name(F.col("run")))


def kv_memtable(spark, sf_dir):
    rows = merge.newest_wins(_rows(spark, sf_dir), keep_tombstones=True)
    return rows.select(decode(F.col("key")).alias("k"), "tomb", decode(F.col("value")).alias("v"))


def kv_compact(spark, sf_dir):
    return _shown(merge.newest_wins(_by_run(spark, sf_dir)))


def kv_compact_meta(spark, sf_dir):
    return _meta(merge.newest_wins(_by_run(spark, sf_dir)))


def kv_sparse_index(spark, sf_dir):
    # keys of a run are summed by their first five bytes, and these sums then
    out = layout.sparse_index(_by_run(spark, sf_dir), block=F.substring("key", 1, 5))
    return out.select("run", "i", decode(F.col("key")).alias("k"), F.col("offset").alias("byte_offset"))


def kv_wal_offsets(spark, sf_dir):
    return layout.log_offsets(log(spark, sf_dir))


def kv_wal_crc(spark, sf_dir):
    """The checksum of each whole log record: header, key and value."""
    body = record_body(F.col("op"), F.col("key"), F.col("value"))
    return log(spark, sf_dir).select("seq", checksum(body).alias("crc"))


def kv_wal_replay_prefix(spark, sf_dir):
    good = oplog.replayed(log(spark, sf_dir).withColumn("ok", F.col("seq") != _last(spark, sf_dir) * 3 // 4))
    return _shown(merge.scan(merge.entries(good)))


def kv_run_prune(spark, sf_dir):
    meta = merge.run_meta(_by_run(spark, sf_dir), "run")
    return layout.candidate_runs(meta, log(spark, sf_dir)).select(decode(F.col("key")).alias("k"), "candidates")


def kv_bloom_sizing(spark, sf_dir):
    return layout.bloom_sizing(merge.run_meta(_by_run(spark, sf_dir), "run"))


def _bloom(spark, sf_dir) -> tuple[DataFrame, bloom.Bloom]:
    keys = log(spark, sf_dir).select("key").distinct()
    return keys, bloom.build(keys, keys.count())


def kv_bloom_probe(spark, sf_dir):
    """No key that is in the filter is ever said to be absent."""
    keys, built = _bloom(spark, sf_dir)
    return built.might_contain(keys).agg(F.count("*").alias("probed"), F.count_if(~F.col("maybe")).alias("missed"))


def kv_bloom_absent(spark, sf_dir):
    """Of absent keys, twenty for each that is there, at most four times the stated rate pass the filter."""
    keys, built = _bloom(spark, sf_dir)
    absent = keys.select(F.explode(F.array(*[F.concat("key", F.lit(f"-{i}".encode())) for i in range(20)])).alias("key"))
    passed = built.might_contain(absent).agg(F.count("*").alias("probed"), F.count_if("maybe").alias("maybe"))
    return passed.select("probed", (F.col("maybe") <= 4 * FALSE_POSITIVES * F.col("probed")).alias("few_pass"))


def kv_serving_run(spark, sf_dir):
    return merge.serving_run(_by_run(spark, sf_dir)).select(decode(F.col("key")).alias("k"), "run", "tomb")


def kv_stats(spark, sf_dir):
    runs = _by_run(spark, sf_dir)
    last, n = runs.agg(F.max("run")).scalar(), runs.agg(F.count_distinct("run")).scalar()
    return merge.tail_size(runs.where(F.col("run") == last)).select("entries", "size_bytes", (n - 1).alias("num_runs"))


def _forget(store: RunStore) -> None:
    try:
        store.files.delete("")
    except Exception:  # the session has ended, and with it its file systems
        pass


def _store(spark: SparkSession, sf_dir: str, flushed: int) -> RunStore:
    """A new store with the log of events, a third of it at a time; the first ``flushed`` thirds are runs."""
    store = RunStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", flush_bytes=1 << 60, compact_runs=1 << 30)
    atexit.register(_forget, store)  # results are read later than the query returns
    part = (_last(spark, sf_dir) + 1) / 3
    # operations of a store count from 1
    ops = log(spark, sf_dir).withColumn("_third", F.floor(F.col("seq") / part)).withColumn("seq", F.col("seq") + 1)
    for k in range(3):
        store.put_many(ops.where(F.col("_third") == k).drop("_third"))
        if k < flushed:
            store.flush()
    return store


def kv_store_flush(spark, sf_dir):
    """The state of a store with two runs and a tail, opened again after it was closed."""
    store = _store(spark, sf_dir, 2)
    store.close()
    return _shown(RunStore(spark, store.files.url).scan())


def kv_store_compact(spark, sf_dir):
    """The state before and after keys from END on are deleted and all runs merged; the first is read last, from old runs."""
    store = _store(spark, sf_dir, 3)
    before = store.scan()
    store.delete_many(before.where(merge.between(END.encode(), None)).select("key"))
    store.flush()
    store.compact()
    state = lambda name, df: _shown(df).withColumn("state", F.lit(name))
    return state("before", before).unionByName(state("after", store.scan()))


def kv_store_get(spark, sf_dir):
    """A batch of lookups in a store, of keys that are there and keys that aren't."""
    got = _store(spark, sf_dir, 2).multi_get(_asked(spark, sf_dir))
    return got.select(decode(F.col("key")).alias("k"), "found", decode(F.col("value")).alias("v"))


def kv_store_prune(spark, sf_dir):
    """A store's runs by its manifest, and whether a lookup of keys from START to END reads them."""
    runs = _store(spark, sf_dir, 3).manifest.runs
    rows = [(r.id, r.num_entries, *(bytes.fromhex(k).decode() for k in (r.min_key, r.max_key)), r.min_seq, r.max_seq, r.may_hold(START.encode(), END.encode())) for r in runs if r.num_entries]
    return spark.createDataFrame(rows, "run long, num_entries long, min_k string, max_k string, min_seq long, max_seq long, may_hold boolean")


QUERIES = {f.__name__: f for f in (kv_scan_all, kv_scan_range, kv_scan_as_of, kv_get, kv_multi_get, kv_contains, kv_remove, kv_memtable, kv_flush_meta, kv_compact, kv_compact_meta, kv_sparse_index, kv_wal_offsets, kv_wal_crc, kv_wal_replay_prefix, kv_run_prune, kv_bloom_sizing, kv_bloom_probe, kv_bloom_absent, kv_serving_run, kv_stats, kv_store_flush, kv_store_compact, kv_store_get, kv_store_prune)}

_LOG = """WITH oplog AS (SELECT event_id AS seq, concat('u', lpad(cast(user_id AS varchar(10)),6,'0')) AS k,
  CASE WHEN event_type='error' THEN 'D' ELSE 'P' END AS op,
  CASE WHEN event_type='error' THEN cast(NULL AS varchar(100)) ELSE concat(event_type,':',props) END AS v,
  cast(floor(event_id/1000) AS bigint) AS run FROM events),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM oplog) x WHERE rn=1),
runs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run,k ORDER BY seq DESC) AS rn FROM oplog) x WHERE rn=1),
newest AS (SELECT * FROM (SELECT run,k,op,v, row_number() OVER (PARTITION BY k ORDER BY run DESC) AS rn FROM runs) x WHERE rn=1),
asked AS (SELECT DISTINCT concat('u', lpad(cast(user_id*2 AS varchar(10)),6,'0')) AS k FROM events),
thirds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY third,k ORDER BY seq DESC) AS rn FROM
  (SELECT *, cast(floor(seq/((SELECT max(seq)+1 FROM oplog)/3.0)) AS bigint) AS third FROM oplog) y) x WHERE rn=1),
meta AS (SELECT run, count(*) AS n, min(k) AS min_k, max(k) AS max_k FROM runs GROUP BY run)
"""
_AS_OF = "(SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn2 FROM oplog WHERE {}) y WHERE rn2=1 AND op='P'"
ORACLES = {
    "kv_scan_all": _LOG + "SELECT k, v FROM latest WHERE op='P'",
    "kv_scan_range": _LOG + f"SELECT k, v FROM latest WHERE op='P' AND k BETWEEN '{START}' AND '{END}'",
    "kv_scan_as_of": _LOG + "SELECT k, v FROM " + _AS_OF.format("seq <= (SELECT max(seq)//2 FROM oplog)"),
    "kv_get": _LOG + f"SELECT k, v FROM latest WHERE op='P' AND k = '{KEY}'",
    "kv_multi_get": _LOG + "SELECT a.k AS k, l.k IS NOT NULL AS found, l.v AS v FROM asked a LEFT JOIN (SELECT * FROM latest WHERE op='P') l ON a.k=l.k",
    "kv_contains": _LOG + "SELECT k FROM asked WHERE k IN (SELECT k FROM oplog)",
    "kv_remove": _LOG + f"SELECT k, v FROM latest WHERE op='P' AND k NOT IN (SELECT k FROM asked WHERE k >= '{END}')",
    "kv_memtable": _LOG + "SELECT k, op='D' AS tomb, v FROM latest",
    "kv_flush_meta": _LOG + "SELECT run, count(*) AS num_entries, min(k) AS min_k, max(k) AS max_k, cast(sum(CASE WHEN op='D' THEN 1 ELSE 0 END) AS bigint) AS tombstones, lpad(cast(run AS varchar(20)),10,'0') AS file FROM runs GROUP BY run",
    "kv_compact": _LOG + "SELECT k, v FROM newest WHERE op='P'",
    "kv_compact_meta": _LOG + "SELECT count(*) AS num_entries, min(k) AS min_k, max(k) AS max_k, cast(0 AS bigint) AS tombstones FROM newest WHERE op='P'",
    "kv_sparse_index": _LOG
    + """SELECT run, i, k, byte_offset FROM (SELECT run, k, row_number() OVER (PARTITION BY run ORDER BY k)-1 AS i,
  cast(coalesce(sum(8+length(k)+coalesce(length(v),0)) OVER (PARTITION BY run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS bigint) AS byte_offset FROM runs) x WHERE i%16=0""",
    "kv_wal_offsets": _LOG + "SELECT seq, rec_len, cast(sum(rec_len) OVER (ORDER BY seq) AS bigint) AS end_offset FROM (SELECT seq, cast(13+length(k)+coalesce(length(v),0) AS bigint) AS rec_len FROM oplog) x",
    "kv_wal_replay_prefix": _LOG + "SELECT k, v FROM " + _AS_OF.format("seq < (SELECT max(seq)*3//4 FROM oplog)"),
    "kv_run_prune": _LOG + "SELECT p.k AS k, count(m.run) AS candidates FROM (SELECT DISTINCT k FROM oplog) p LEFT JOIN meta m ON p.k BETWEEN m.min_k AND m.max_k GROUP BY p.k",
    "kv_bloom_sizing": _LOG + "SELECT run, num_bits, cast(greatest(1, round(num_bits/cast(n AS double)*ln(2))) AS bigint) AS num_hashes FROM (SELECT run, n, cast(greatest(8, ceil(-(n*ln(0.01))/(ln(2)*ln(2)))) AS bigint) AS num_bits FROM meta) x",
    "kv_bloom_probe": _LOG + "SELECT count(DISTINCT k) AS probed, cast(0 AS bigint) AS missed FROM oplog",
    "kv_bloom_absent": _LOG + "SELECT 20*count(DISTINCT k) AS probed, true AS few_pass FROM oplog",
    "kv_wal_crc": _LOG
    + """, crc_table AS (SELECT list(c ORDER BY b) AS crcs FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) t(b)) x),
lengths AS (SELECT seq, op, k, coalesce(v,'') AS v, octet_length(encode(k)) AS nk, octet_length(encode(coalesce(v,''))) AS nv FROM oplog),
hexed AS (SELECT seq, CASE op WHEN 'P' THEN '01' ELSE '02' END || printf('%02x%02x%02x%02x%02x%02x%02x%02x', nk&255, (nk>>8)&255, (nk>>16)&255, nk>>24, nv&255, (nv>>8)&255, (nv>>16)&255, nv>>24) || hex(encode(k)) || hex(encode(v)) AS h FROM lengths),
bytes AS (SELECT seq, list_transform(range(0, length(h)//2), lambda i: cast('0x' || substring(h, 2*i+1, 2) AS bigint)) AS raw FROM hexed)
SELECT seq, xor(list_reduce(list_prepend(4294967295, raw), lambda c, b: xor(c >> 8, crcs[cast(xor(c, b) & 255 AS bigint)+1])), 4294967295) AS crc FROM bytes, crc_table""",
    "kv_store_flush": _LOG + "SELECT k, v FROM latest WHERE op='P'",
    "kv_store_compact": _LOG + f"SELECT 'before' AS state, k, v FROM latest WHERE op='P' UNION ALL SELECT 'after', k, v FROM latest WHERE op='P' AND k < '{END}'",
    "kv_store_get": _LOG + "SELECT a.k AS k, l.k IS NOT NULL AS found, l.v AS v FROM asked a LEFT JOIN (SELECT * FROM latest WHERE op='P') l ON a.k=l.k",
    "kv_store_prune": _LOG + f"SELECT third+1 AS run, count(*) AS num_entries, min(k) AS min_k, max(k) AS max_k, min(seq)+1 AS min_seq, max(seq)+1 AS max_seq, min(k) <= '{END}' AND max(k) >= '{START}' AS may_hold FROM thirds GROUP BY third",
    "kv_serving_run": _LOG + "SELECT k, run, op='D' AS tomb FROM newest",
    "kv_stats": _LOG + "SELECT count(*) AS entries, cast(sum(length(k)+coalesce(length(v),0)) AS bigint) AS size_bytes, (SELECT count(*)-1 FROM meta) AS num_runs FROM runs WHERE run=(SELECT max(run) FROM meta)",
}
