"""Archive manifests: one JSON object a line, PUBLISH, DELETE and OPEN records of each writer."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.catalog import files_for_range, visible_files

MANIFEST = "op string, chronicle string, story string, whole_chronicle boolean, file string, writer string, writer_start long, incarnation long, incarnation_bound long, start long, end long, events long"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """All complete records; a torn last line or other junk is passed over."""
    return spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(path).filter("op is not null")


def append_manifest(records: DataFrame, path: str) -> None:
    """Append records (columns of MANIFEST; nulls are left out) as new files."""
    records.write.mode("append").json(path)


#: Bytes of a log that are read at once.
PIECE = 4 << 20


@dataclass
class ManifestTail:
    """Incremental reader of writers' logs: each call returns the complete lines that were added since the last one.

    A log that was replaced (it is shorter, or begins otherwise) is read from
    its start again and named in ``replaced``.  Logs are metadata, a line for
    each file of the archive, and are read by the driver, PIECE bytes at a time.
    """

    spark: SparkSession
    path: str
    offsets: dict[str, int] = field(default_factory=dict)
    heads: dict[str, bytes] = field(default_factory=dict)
    replaced: list[str] = field(default_factory=list)

    def _bytes(self, fs, path, at: int, n: int) -> bytes:
        stream = fs.open(path)
        try:
            stream.seek(at)
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
        finally:
            stream.close()

    def poll(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        self.replaced, rows = [], []
        for status in fs.listStatus(root) if fs.exists(root) else []:
            path, size = status.getPath(), status.getLen()
            name = path.getName()
            if status.isDirectory() or name.startswith(("_", ".")):
                continue
            at, head = self.offsets.get(name, 0), self.heads.get(name, b"")
            if size < at or (head and self._bytes(fs, path, 0, len(head)) != head):
                self.replaced.append(name)
                at = 0
            text = b""
            for lo in range(at, size, PIECE):
                text += self._bytes(fs, path, lo, min(PIECE, size - lo))
                whole, newline, text = text.rpartition(b"\n")
                at += len(whole) + len(newline)
                rows += [r for line in whole.split(b"\n") if (r := _record(line)) is not None]
            self.offsets[name] = at
            self.heads[name] = self._bytes(fs, path, 0, min(64, at)) if at else b""
        return self.spark.createDataFrame(rows, MANIFEST)


def _record(line: bytes) -> tuple | None:
    """A record's fields; None for junk."""
    try:
        r = json.loads(line)
    except ValueError:
        return None
    return tuple(r.get(c.split(" ")[0]) for c in MANIFEST.split(", ")) if isinstance(r, dict) and r.get("op") else None


def stream_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream.  The file source follows new files, not appended ones: writers add a file for each batch."""
    return spark.readStream.schema(MANIFEST).json(path).filter("op is not null")


def files_to_read(manifest: DataFrame, chronicle: str, story: str, start: int, end: int) -> DataFrame:
    """Published, undeleted files of a story that overlap ``[start, end)``."""
    mine = manifest.filter(F.col("chronicle") == chronicle)
    gone = mine.filter("op = 'DELETE'").filter(F.coalesce("whole_chronicle", F.lit(False)) | (F.col("story") == story))
    gone = gone.select("chronicle", F.lit(story).alias("story"), "writer_start", "incarnation_bound")
    published = mine.filter((F.col("op") == "PUBLISH") & (F.col("story") == story)).withColumnsRenamed({"start": "start_time", "end": "end_time"}).drop("incarnation_bound")
    return files_for_range(visible_files(published, gone), start, end)
