"""A keyed table in a folder that batches and streams update exactly once.

Rows lie in buckets by a hash of their first key. An update rewrites the buckets that it touches below data/, and then one small
file, the next version, takes effect by a rename that fails where that version exists: it names each bucket's folder and, for each
writer, the last batch that the version holds. So a batch that is tried again after a failure is either in the latest version, and
passed over, or has left nothing but folders that no version names. Two writers at once: the later one to rename works on the newer version again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame, DataFrame], DataFrame]
BUCKETS = 64
#: Versions whose folders stay for those that read them, and tries of a writer that others overtake.
KEPT, TRIES = 3, 20


class KeyedTable:
    """schema: DDL of the rows; keys: columns that tell rows apart, of which the first deals them to buckets."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder.rstrip("/"), schema, keys, buckets
        self.jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self._path("").getFileSystem(conf)
        self.files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self.fs.mkdirs(self._path("versions"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _versions(self) -> list[int]:
        return sorted(int(f.getPath().getName()) for f in self.fs.listStatus(self._path("versions")) if f.getPath().getName().isdigit())

    def _load(self, number: int) -> dict:
        stream = self.fs.open(self._path(f"versions/{number:012d}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def version(self, number: int | None = None) -> dict:
        """number, batches (the last of each writer) and buckets (their folders) of a version, by default the latest."""
        known = self._versions()
        if number is None and not known:
            return {"number": 0, "batches": {}, "buckets": {}}
        return self._load(known[-1] if number is None else number)

    def _publish(self, version: dict) -> bool:
        """Makes a version the latest one; false where another writer has made it."""
        draft = self._path(f"versions/draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        try:
            out.write(json.dumps(version).encode())
        finally:
            out.close()
        try:
            plain = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            self.files.rename(draft, self._path(f"versions/{version['number']:012d}"), plain)
            return True
        except Py4JJavaError as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise

    def _bucket(self):
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(self.buckets)).cast("int")

    def read(self, version: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, by default the latest; of some buckets if these are given."""
        version = version or self.version()
        places = [place for bucket, place in sorted(version["buckets"].items()) if buckets is None or int(bucket) in buckets]
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{p}" for p in places])

    def apply(self, updates: DataFrame, batch: int, merge: Merge, writer: str = "main") -> bool:
        """The table after merge(rows of the touched buckets, updates); false if the table has this batch of the writer already.

        merge returns rows of the schema, and none that lie in other buckets than the updates do."""
        # Written first, as what makes the updates may be costly; and a stream's state is only kept for batches that have run.
        came = f"incoming/{uuid.uuid4().hex}"
        updates.write.parquet(f"{self.folder}/{came}")
        updates = self.spark.read.schema(updates.schema).parquet(f"{self.folder}/{came}")
        try:
            touched = sorted(r[0] for r in updates.select(self._bucket().alias("b")).distinct().collect())
            for _ in range(TRIES):
                now = self.version()
                if now["batches"].get(writer, -1) >= batch:
                    return False
                after = {"number": now["number"] + 1, "batches": now["batches"] | {writer: batch}, "buckets": dict(now["buckets"])}
                if touched:
                    place = f"data/{after['number']:012d}-{uuid.uuid4().hex}"
                    rows = merge(self.read(now, touched), updates).withColumn("bucket", self._bucket())
                    rows.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{place}")
                    after["buckets"] |= {str(b): f"{place}/bucket={b}" for b in touched}
                if self._publish(after):
                    self._clean()
                    return True
            raise RuntimeError(f"{TRIES} times another writer of {self.folder} came first")
        finally:
            self.fs.delete(self._path(came), True)

    def _clean(self) -> None:
        """Removes versions but the latest, and folders of data that only these name."""
        known = self._versions()
        old, kept = known[:-KEPT], known[-KEPT:]
        if old:
            used = {p.split("/")[1] for n in kept for p in self._load(n)["buckets"].values()}
            gone = {p.split("/")[1] for n in old for p in self._load(n)["buckets"].values()} - used
            for name in gone:
                self.fs.delete(self._path(f"data/{name}"), True)
            for number in old:
                self.fs.delete(self._path(f"versions/{number:012d}"), False)
