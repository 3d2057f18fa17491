"""Small files beside tables: markers and manifests in the file system the tables are in.

A manifest says which version of each partition of a table is current.  It is one file, which
appears under its name whole or not at all, so a reader sees the versions before or after a change,
never a mixture.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from veilwork.session import fresh_path

MANIFESTS = "_manifests"


class Files:
    """Files below ``path``, in whatever file system it names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, folder: str = "") -> list[str]:
        """Names in a folder, in order; none where there is no such folder."""
        if not self.exists(folder):
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(self._at(folder)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a file that appears whole: under another name first, then renamed."""
        draft = self._at(f"_draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.mkdirs(self._at(name).getParent())
        if self._fs.exists(self._at(name)):
            self._fs.delete(self._at(name), False)
        if not self._fs.rename(draft, self._at(name)):
            raise OSError(f"{name} could not be written below {self.path}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def _numbered(number: int) -> str:
    return f"{number:020d}"


class Manifests:
    """The numbered manifests of a table; the one of the highest number holds."""

    def __init__(self, files: Files):
        self.files = files

    def numbers(self) -> list[int]:
        return [int(name) for name in self.files.names(MANIFESTS) if name.isdigit()]

    def read(self, number: int) -> dict:
        return json.loads(self.files.read(f"{MANIFESTS}/{_numbered(number)}"))

    def last(self) -> tuple[int, dict]:
        """The number and the content of the current manifest; -1 and nothing at first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (-1, {})

    def publish(self, number: int, content: dict) -> None:
        self.files.put(f"{MANIFESTS}/{_numbered(number)}", json.dumps(content, sort_keys=True))

    def forget(self, number: int) -> None:
        self.files.delete(f"{MANIFESTS}/{_numbered(number)}")


def written_once(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path, for work that several outputs need.

    Nothing is cached: what follows survives the loss of executors.  Delete it with ``discard``.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        Files(spark, path).delete("")
