"""Small files of a store: manifests and logs of single operations."""

from __future__ import annotations

import os
import shutil
import tempfile
import time
import uuid


def storage(spark, root: str) -> "Local | Hadoop":
    """Local folders are used directly, so that records can be forced to disk; all else goes through Hadoop."""
    if root.startswith("file:"):
        return Local("/" + root[5:].lstrip("/"))
    return Hadoop(spark, root) if "://" in root else Local(os.path.abspath(root))


def shared_folder(spark) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # driver and executors are one process here
        folder = "file://" + tempfile.mkdtemp(prefix="runstore-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Local:
    def __init__(self, root: str):
        self.root = root
        self.url = "file://" + root
        os.makedirs(root, exist_ok=True)

    def names(self, folder: str) -> list[str]:
        try:
            return sorted(os.listdir(os.path.join(self.root, folder)))
        except FileNotFoundError:
            return []

    def read(self, name: str) -> bytes:
        with open(os.path.join(self.root, name), "rb") as f:
            return f.read()

    def publish(self, name: str, data: bytes) -> bool:
        """Write a whole file under a name that nobody has taken; False if it is taken. Atomic."""
        path = os.path.join(self.root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        with open(draft, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)

    def move(self, old: str, new: str) -> None:
        os.rename(os.path.join(self.root, old), os.path.join(self.root, new))

    def delete(self, name: str) -> None:
        path = os.path.join(self.root, name)
        if os.path.isdir(path):
            shutil.rmtree(path)
        elif os.path.exists(path):
            os.unlink(path)

    def size(self, name: str) -> int:
        path = os.path.join(self.root, name)
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))

    def modified(self, name: str) -> float:
        """When it was last written, in seconds; now, if it is gone."""
        try:
            return os.path.getmtime(os.path.join(self.root, name))
        except FileNotFoundError:
            return time.time()

    def log(self, folder: str) -> "LocalLog":
        return LocalLog(os.path.join(self.root, folder))


class LocalLog:
    """Records appended to one file for each opening of a store, each forced to disk before it counts."""

    def __init__(self, folder: str):
        self.folder, self.file = folder, None

    def append(self, seq: int, record: bytes) -> None:
        if self.file is None:
            os.makedirs(self.folder, exist_ok=True)
            # never an old file: what a crash left at its end stays the end
            self.file = open(os.path.join(self.folder, f"{seq:020d}.log"), "xb", buffering=0)  # noqa: SIM115
        self.file.write(record)
        os.fsync(self.file.fileno())

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


class Hadoop:
    def __init__(self, spark, root: str):
        self.root = self.url = root.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.fs = self._path("").getFileSystem(self.conf)
        self.fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> bytes:
        f = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(f))
        finally:
            f.close()

    def publish(self, name: str, data: bytes) -> bool:
        """As Local.publish; atomic where the file system's rename without overwriting is."""
        draft = self._path(f"{name}.{uuid.uuid4().hex}.draft")
        f = self.fs.create(draft, False)
        f.write(bytearray(data))
        f.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.conf)
        try:
            context.rename(draft, self._path(name), self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception:
            if not self.fs.exists(self._path(name)):
                raise
            return False
        finally:
            self.fs.delete(draft, False)

    def move(self, old: str, new: str) -> None:
        if not self.fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{old} couldn't be renamed to {new}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength()

    def modified(self, name: str) -> float:
        p = self._path(name)
        return self.fs.getFileStatus(p).getModificationTime() / 1000 if self.fs.exists(p) else time.time()

    def log(self, folder: str) -> "HadoopLog":
        return HadoopLog(self, folder)


class HadoopLog:
    """A file for each record: such stores don't append and force in general."""

    def __init__(self, store: Hadoop, folder: str):
        self.store, self.folder = store, folder

    def append(self, seq: int, record: bytes) -> None:
        if not self.store.publish(f"{self.folder}/{seq:020d}.log", record):
            raise FileExistsError(f"operation {seq} is taken by another writer")

    def close(self) -> None:
        pass
