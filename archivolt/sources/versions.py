"""Tables in numbered versions.  A version is a manifest that names folders of Parquet; it is there once its manifest is, which is put only
where none of that number is yet.  So of two writers on one base one wins and the other is told; readers keep to the version they began with."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Someone else has made the next version of the same base."""


class Versions:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def latest(self) -> int:
        """The newest version's number; 0 if there is none."""
        log = self._path("_log")
        if not self.fs.exists(log):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(log)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """What a version is made of; {} for 0."""
        version = self.latest() if version is None else version
        if not version:
            return {}
        stream = self.fs.open(self._path(f"_log/{version:020d}.json"))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def write(self, df: DataFrame, by: list[str] | None = None) -> str:
        """Rows as a folder of their own, which no version has yet."""
        name = f"data/{uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{self.base}/{name}")
        return name

    def commit(self, on: int, manifest: dict) -> int:
        """The version after `on`, or Conflict. A manifest is written aside and put in place as a whole."""
        target, aside = self._path(f"_log/{on + 1:020d}.json"), self._path(f"_log/.{uuid.uuid4().hex}")
        out = self.fs.create(aside, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        try:
            if self.fs.getScheme() == "file":  # a local rename replaces what is there, a link doesn't
                path = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(path(target), path(aside))
            else:
                none = self.spark._sc._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, target, none)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()) + str(e.java_exception):
                raise Conflict(f"version {on + 1} is there already") from None
            raise
        finally:
            self.fs.delete(aside, False)
        return on + 1

    def publish(self, df: DataFrame, on: int) -> int:
        """SNK2, SNK3: the whole table as the version after `on`."""
        return self.commit(on, {"parts": [self.write(df)]})

    def table(self, version: int | None = None) -> DataFrame:
        """The table that publish() wrote, pinned: later versions don't change it."""
        return self.spark.read.parquet(*[f"{self.base}/{p}" for p in self.manifest(version)["parts"]])
