"""Versioned tables: a new version is written beside the old one, then a step of a log makes it current."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

BACK = "back"


class VersionedStore:
    """Parquet tables under a folder of any file system that Spark reads.

    publish writes all tables of a version first and adds a step to the log last, so readers see the
    old version or the new one whole; rollback is a step that takes the last version back.  A step is one
    file: its number is claimed by a file that only one writer can create, and it appears whole by a rename,
    so of two publishers none loses its version and a reader always finds the steps before.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _steps(self) -> list[int]:
        """The numbers of the steps that are done."""
        folder = self._hadoop("_steps")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def versions(self) -> list[str]:
        """All published versions that were not taken back, the current one last."""
        out: list[str] = []
        for step in self._steps():
            stream = self._fs.open(self._hadoop(f"_steps/{step:08d}"))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            out = out[:-1] if text == BACK else [*out, text]
        return out

    def _step(self, text: str) -> None:
        """Add a step to the log."""
        staged = self._hadoop(f"_steps/.{uuid.uuid4().hex}")
        stream = self._fs.create(staged, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        number = max(self._steps(), default=0) + 1
        while not self._claimed(number):
            number += 1
        if not self._fs.rename(staged, self._hadoop(f"_steps/{number:08d}")):
            raise OSError(f"step {number} of {self.path} could not be written")

    def _claimed(self, number: int) -> bool:
        """Whether this writer got the number."""
        try:
            self._fs.create(self._hadoop(f"_steps/.claim-{number:08d}"), False).close()
        except Py4JJavaError as error:
            if self._fs.exists(self._hadoop(f"_steps/.claim-{number:08d}")):
                return False
            raise error
        return True

    def publish(self, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> str:
        """Write the tables as a new version and make it current."""
        version = f"v{len(self.versions()) + 1}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            writer = df.write.mode("overwrite")
            columns = (partition_by or {}).get(name)
            (writer.partitionBy(*columns) if columns else writer).parquet(f"{self.path}/{version}/{name}")
        self._step(version)
        return version

    def read(self, name: str) -> DataFrame:
        """A table of the current version."""
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(f"nothing is published under {self.path}")
        return self.spark.read.parquet(f"{self.path}/{versions[-1]}/{name}")

    def rollback(self) -> str:
        """Make the version before current again."""
        versions = self.versions()
        if len(versions) < 2:
            raise ValueError("there is no version before")
        self._step(BACK)
        return versions[-2]
