"""A store: immutable sorted runs under a manifest, and a log of operations not yet in a run."""

from __future__ import annotations

import copy
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.layout import sparse_index
from .operators import merge
from .plans import manifest as M
from .plans.manifest import CommitConflict, Run
from .plans.storage import storage
from .schema import COMPACT_RUNS, DELETE, ENTRY, FALSE_POSITIVES, FLUSH_BYTES, OPLOG, PUT
from .sources.oplog import decode_log, encode_record

__all__ = ["NOT_FOUND", "CommitConflict", "RunStore"]


class _NotFound:
    def __repr__(self) -> str:
        return "NOT_FOUND"


NOT_FOUND = _NotFound()
RUN_FILE_BYTES = 128 << 20
#: A run joins a tier's merge if it is at most so many times as large as the newer ones in it together.
TIER_RATIO = 2
#: Lookups of up to so many keys are pushed into the scan as a list.
PUSHED_KEYS = 1000
#: What a reader may still need is kept for so many seconds (``vacuum``).
KEEP_SECONDS = 86_400.0
SEGMENT = re.compile(r"(\d{20})-(\d{20})\.parquet")


class RunStore:
    """A directory of Parquet runs, served by DataFrame plans.

    Single operations go to a log, forced to disk one by one, and to a dictionary in the driver,
    bounded by ``flush_bytes``. Batches are written as log segments and are visible as a whole or
    not at all. A flush turns what isn't in a run yet into a new run; where that makes
    ``compact_runs`` runs or more, the newest of similar size are merged into one (``compact`` merges
    all). Reads see one version of the manifest: a DataFrame made before a flush or a compaction
    gives the old state after it, since files that a version named stay until ``vacuum``. A second
    writer isn't locked out, but its commit fails with CommitConflict. A batch of ``put_many``
    without a column seq is ordered as Spark numbers its rows; with one, seq must be unique and
    above that of every operation before it.
    """

    def __init__(self, spark: SparkSession, path: str, flush_bytes: int = FLUSH_BYTES, compact_runs: int = COMPACT_RUNS):
        self.spark, self.files = spark, storage(spark, path)
        self.flush_bytes, self.compact_runs = flush_bytes, compact_runs
        self.manifest = M.load(self.files)
        self._memory: dict[bytes, tuple[int, bytes | None]] = {}  # newest single operation of each key
        self._memory_bytes = 0
        self._segments: list[str] = []
        self._next = self.manifest.committed_seq + 1
        self._recover()
        self._log = self.files.log("oplog")
        self._closed = False

    def _recover(self) -> None:
        """Take in what was logged and isn't in a run: the valid prefix of each log file, and whole segments."""
        for name in self.files.names("oplog"):
            if m := re.fullmatch(r"(\d{20})\.log", name):
                for k, (op, key, value) in enumerate(decode_log(self.files.read(f"oplog/{name}"))):
                    self._next = max(self._next, int(m[1]) + k + 1)
                    if int(m[1]) + k > self.manifest.committed_seq:
                        self._remember(int(m[1]) + k, key, value if op == PUT else None)
                self._next = max(self._next, int(m[1]) + 1)  # its name is taken, even if nothing in it is whole
            elif m := SEGMENT.fullmatch(name):
                if int(m[2]) > self.manifest.committed_seq:
                    self._segments.append(name)
                self._next = max(self._next, int(m[2]) + 1)

    def _remember(self, seq: int, key: bytes, value: bytes | None) -> None:
        if key in self._memory:
            self._memory_bytes -= len(key) + len(self._memory[key][1] or b"")
        self._memory[key] = (seq, value)
        self._memory_bytes += len(key) + len(value or b"")

    def _check_open(self) -> None:
        if self._closed:
            raise RuntimeError("the store is closed")

    # -- writes -------------------------------------------------------------------------------

    def put(self, key: bytes, value: bytes) -> None:
        self._write(PUT, key, value)

    def delete(self, key: bytes) -> None:
        """Record a tombstone; the key needn't exist."""
        self._write(DELETE, key, None)

    def _write(self, op: str, key: bytes, value: bytes | None) -> None:
        self._check_open()
        seq, self._next = self._next, self._next + 1
        self._log.append(seq, encode_record(op, key, value or b""))
        self._remember(seq, key, value)
        if self._memory_bytes >= self.flush_bytes:
            self.flush()

    def put_many(self, df: DataFrame) -> None:
        """Operations from a DataFrame with key and value, and maybe op ('P' or 'D') and seq."""
        self._check_open()
        op = F.col("op") if "op" in df.columns else F.lit(PUT)
        own = "seq" in df.columns
        seq = F.col("seq").cast("long") if own else F.monotonically_increasing_id() + self._next
        rows = df.select(seq.alias("seq"), op.alias("op"), F.col("key").cast("binary").alias("key"), F.when(op == PUT, F.col("value").cast("binary")).alias("value"))
        draft = f"oplog/{uuid.uuid4().hex}.draft"
        rows.write.parquet(f"{self.files.url}/{draft}")
        written = self.spark.read.schema(OPLOG).parquet(f"{self.files.url}/{draft}")
        low, high, n, distinct = written.agg(F.min("seq"), F.max("seq"), F.count("*"), F.count_distinct("seq") if own else F.count("*")).first()
        if not n or own and (low < self._next or n != distinct):
            self.files.delete(draft)
            if n:
                raise ValueError(f"seq must be unique, and {self._next} or more: all below is taken")
            return
        name = f"{low:020d}-{high:020d}.parquet"
        self.files.move(draft, f"oplog/{name}")
        self._segments.append(name)
        self._next = max(self._next, high + 1)
        self._maybe_flush()

    def put_batch(self, ops: DataFrame, batch: tuple[str, int]) -> None:
        """A micro-batch of (seq, op, key, value) as one run, committed with its number.

        Single operations and segments before it go into the same run.
        """
        self._check_open()
        tail, rows = self.tail(), merge.entries(ops)
        new = copy.deepcopy(self.manifest)
        new.batches[batch[0]] = batch[1]
        if tail is not None or not rows.isEmpty():
            rows = merge.newest_wins(rows if tail is None else rows.unionByName(tail), keep_tombstones=True)
            size = merge.payload(ops.select("key", "value")) + self._tail_bytes()
            run = self._new_run(rows, new.next_run, size)
            new.next_run += 1
            new.runs.insert(0, run)
            new.committed_seq = max(self._next - 1, new.committed_seq, run.max_seq)
        self._publish(new)
        self._forget_tail()
        self._next = max(self._next, new.committed_seq + 1)
        self._maybe_compact()

    def delete_many(self, keys: DataFrame) -> None:
        self.put_many(keys.select("key", F.lit(DELETE).alias("op"), F.lit(None).cast("binary").alias("value")))

    def _maybe_flush(self) -> None:
        """After a batch: what is on disk of its segments stands for its size."""
        if self._tail_bytes() >= self.flush_bytes:
            self.flush()

    def _tail_bytes(self) -> int:
        return self._memory_bytes + sum(self.files.size(f"oplog/{s}") for s in self._segments)

    # -- reads --------------------------------------------------------------------------------

    def tail(self) -> DataFrame | None:
        """Entries not in a run yet, tombstones too; None if there are none."""
        parts = []
        if self._memory:
            rows = [(k, seq, v is None, v) for k, (seq, v) in self._memory.items()]
            parts.append(self.spark.createDataFrame(rows, ENTRY))
        if self._segments:
            ops = self.spark.read.schema(OPLOG).parquet(*[f"{self.files.url}/oplog/{s}" for s in self._segments])
            parts.append(merge.entries(ops.where(F.col("seq") > self.manifest.committed_seq)))
        return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None

    def _runs(self, runs: list[Run]) -> DataFrame | None:
        if not runs:
            return None
        return self.spark.read.schema(ENTRY).parquet(*[f"{self.files.url}/{r.folder}" for r in runs])

    def rows(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """All entries that may fall in start..end: of the runs whose bounds do, and of the tail."""
        parts = [p for p in (self._runs([r for r in self.manifest.runs if r.may_hold(start, end)]), self.tail()) if p is not None]
        if not parts:
            return self.spark.createDataFrame([], ENTRY)
        return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]

    def scan(self, start: bytes | None = None, end: bytes | None = None, as_of: int | None = None) -> DataFrame:
        """(key, value) with start <= key <= end in key order; ``as_of``: only operations up to that one."""
        self._check_open()
        runs = [r for r in self.manifest.runs if r.may_hold(start, end)]
        if len(runs) == 1 and not self._memory and not self._segments and as_of is None:
            # the keys of a run are unique: nothing to merge, and nothing to shuffle but for the order
            return self._runs(runs).where(merge.between(start, end)).where(~F.col("tomb")).select("key", "value").orderBy("key")
        return merge.scan(self.rows(start, end), start, end, as_of)

    def get(self, key: bytes):
        """The value, or NOT_FOUND if the key is absent or deleted."""
        self._check_open()
        if key in self._memory and not self._segments:
            value = self._memory[key][1]
            return NOT_FOUND if value is None else value
        of_key = F.col("key") == F.lit(key)
        newest = lambda rows: rows.where(of_key).agg(F.max(F.struct("seq", "tomb", "value")).alias("x")).first().x
        tail = self.tail()
        top = None if tail is None else newest(tail)
        runs = sorted((r for r in self.manifest.runs if r.may_hold(key, key)), key=lambda r: -r.max_seq)
        many = 1
        # newest first, twice as many runs each time, until nothing older can be newer than what was found
        while runs and (top is None or top.seq < runs[0].max_seq):
            found = newest(self._runs(runs[:many]))
            top = max((x for x in (top, found) if x is not None), key=lambda x: x.seq, default=None)
            runs, many = runs[many:], 2 * many
        return NOT_FOUND if top is None or top.tomb else bytes(top.value)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """(key, found, value) for each distinct key of ``keys`` (an extension).

        The keys' bounds are taken first: runs outside them aren't read, and the bounds, or the keys
        themselves if they are few, are pushed into the scan of the others.
        """
        self._check_open()
        asked = keys.select(F.col("key").cast("binary").alias("key")).where("key is not null").distinct()
        few = [bytes(r.key) for r in asked.limit(PUSHED_KEYS + 1).collect()]
        if len(few) <= PUSHED_KEYS:
            low, high = (min(few), max(few)) if few else (None, None)
            rows = self.rows(low, high).where(F.col("key").isin(few)) if few else self.spark.createDataFrame([], ENTRY)
        else:
            low, high = (bytes(x) for x in asked.agg(F.min("key"), F.max("key")).first())
            rows = self.rows(low, high).where(merge.between(low, high))
        return merge.multi_get(rows, asked)

    def stats(self) -> dict:
        self._check_open()
        tail = self.tail()
        entries, size = (len(self._memory), self._memory_bytes) if not self._segments else tuple(merge.tail_size(tail).first())
        files = [r.folder for r in self.manifest.runs]
        # the same under both names: a run is what others call a sorted table
        return {"memtable_entries": entries, "memtable_size_bytes": size, "num_runs": len(files), "run_files": files, "num_sstables": len(files), "sstable_files": files}

    def sparse_index(self) -> DataFrame:
        """(run, i, key, offset): every 16th entry of each run, summed file by file."""
        self._check_open()
        runs = self._runs(self.manifest.runs)
        if runs is None:
            return sparse_index(self.spark.createDataFrame([], ENTRY).withColumn("run", F.lit(0).cast("long")))
        run = F.regexp_extract(F.col("_metadata.file_path"), r"/runs/(\d{10})-", 1).cast("long")
        return sparse_index(runs.select("*", run.alias("run"), F.col("_metadata.file_name").alias("_file")), block=F.col("_file"))

    # -- flush and compaction -----------------------------------------------------------------

    def _new_run(self, rows: DataFrame, number: int, bytes_in: int) -> Run:
        """Write entries of unique keys as a run, sorted by key, with bounds for the manifest."""
        folder = f"runs/{number:010d}-{uuid.uuid4().hex[:8]}"
        url = f"{self.files.url}/{folder}"
        sorted_rows = rows.repartitionByRange(max(1, bytes_in // RUN_FILE_BYTES), "key").sortWithinPartitions("key")
        writer = sorted_rows.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(FALSE_POSITIVES)).option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(url)
        n, low, high, low_seq, high_seq = self.spark.read.schema(ENTRY).parquet(url).agg(F.count("*"), F.min("key"), F.max("key"), F.min("seq"), F.max("seq")).first()
        return Run(number, folder, n, None if low is None else bytes(low).hex(), None if high is None else bytes(high).hex(), low_seq, high_seq, self.files.size(folder))

    def flush(self) -> dict | None:
        """Make a run of the tail, tombstones kept; None if it is empty."""
        self._check_open()
        tail = self.tail()
        if tail is None:
            return None
        new = copy.deepcopy(self.manifest)
        run = self._new_run(merge.newest_wins(tail, keep_tombstones=True), new.next_run, self._tail_bytes())
        new.next_run += 1
        new.committed_seq = max(self._next - 1, new.committed_seq)
        new.runs.insert(0, run)
        self._publish(new)
        self._forget_tail()
        self._maybe_compact()
        return self._meta(run)

    def _forget_tail(self) -> None:
        """The tail is in a committed run: its log files go, and segments stay for readers until ``vacuum``.

        If a crash keeps log files, committed_seq tells.
        """
        self._log.close()
        self._memory, self._memory_bytes, self._segments = {}, 0, []
        for name in self.files.names("oplog"):
            if re.fullmatch(r"\d{20}\.log", name):
                self.files.delete(f"oplog/{name}")

    def _tier(self) -> int:
        """How many of the newest runs to merge, so that a large old run isn't written again for each small one."""
        sizes = [r.size_bytes for r in self.manifest.runs]
        many, total = 1, sizes[0]
        while many < len(sizes) and sizes[many] <= TIER_RATIO * total:
            total += sizes[many]
            many += 1
        return max(2, many)

    def _maybe_compact(self) -> None:
        if len(self.manifest.runs) >= self.compact_runs:
            self._merge_newest(self._tier())

    def compact(self) -> dict | None:
        """Merge all runs into one without tombstones; None if there are fewer than two."""
        self._check_open()
        return self._merge_newest(len(self.manifest.runs))

    def _merge_newest(self, many: int) -> dict | None:
        """Merge the ``many`` newest runs into one; None if there are fewer than two.

        Tombstones may go only if every run takes part, since the tail is newer. One commit swaps
        the runs; a crash leaves either all the old ones or the new one, and readers keep the old.
        """
        old, new = self.manifest.runs[:many], copy.deepcopy(self.manifest)
        if len(old) < 2:
            return None
        rest = new.runs[many:]
        run = self._new_run(merge.newest_wins(self._runs(old), keep_tombstones=bool(rest)), new.next_run, sum(r.size_bytes for r in old))
        new.next_run += 1
        new.runs = [run, *rest]
        self._publish(new)
        return self._meta(run)

    def _publish(self, new: M.Manifest) -> None:
        new.commit(self.files)
        self.manifest = new

    @staticmethod
    def _meta(run: Run) -> dict:
        key = lambda x: None if x is None else bytes.fromhex(x)
        return {"num_entries": run.num_entries, "min_key": key(run.min_key), "max_key": key(run.max_key), "size_bytes": run.size_bytes}

    def vacuum(self, min_age: float = KEEP_SECONDS) -> list[str]:
        """Delete what no manifest version needs that was current in the last ``min_age`` seconds; returns the names.

        Readers of an older version fail then. Runs and drafts that no version names (left by a
        crash, or being written) go by their own age. Ages are by the file system's clock.
        """
        self._check_open()
        cut = time.time() - min_age
        versions = [f"{M.FOLDER}/{n}" for n in self.files.names(M.FOLDER) if n.endswith(".json")]
        written = {v: self.files.modified(v) for v in versions[:-1]}
        # a version was current until the next was written
        kept = [v for v, after in zip(versions, versions[1:]) if written.get(after, float("inf")) > cut and min_age > 0] + versions[-1:]
        needed = [M.read(self.files, v) for v in kept]
        live, floor = {r.folder for m in needed for r in m.runs}, min((m.committed_seq for m in needed), default=0)
        if versions and min_age > 0 and self.files.modified(versions[0]) > cut:
            floor = 0  # the store without any version was current then
        named = {r.folder for v in versions for r in M.read(self.files, v).runs} if min_age > 0 else set()
        gone = [v for v in versions if v not in kept]
        for name in (f"runs/{n}" for n in self.files.names("runs")):
            if name not in live and (name in named or self.files.modified(name) <= cut):
                gone.append(name)
        for name in self.files.names("oplog"):
            m = SEGMENT.fullmatch(name)
            if m and int(m[2]) <= floor and name not in self._segments or name.endswith(".draft") and self.files.modified(f"oplog/{name}") <= cut:
                gone.append(f"oplog/{name}")
        gone += [f"{M.FOLDER}/{n}" for n in self.files.names(M.FOLDER) if n.endswith(".draft") and self.files.modified(f"{M.FOLDER}/{n}") <= cut]
        for name in gone:
            self.files.delete(name)
        return gone

    def close(self) -> None:
        """Let go of the log. What isn't in a run stays in it for the next opening."""
        self._log.close()
        self._closed = True

    def __enter__(self) -> "RunStore":
        return self

    def __exit__(self, *exc) -> None:
        self.close()
