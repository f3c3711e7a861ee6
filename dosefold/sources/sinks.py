"""Text files by key, written all or not at all.

Tasks write below a staging folder; when every task is done the driver moves the
files to their places, `key=value/.../<name>`. A task that is run again writes new
staged files and only those of the attempt that counts are moved; a failed job
leaves nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") and "://" not in uri:
        uri = uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


@dataclass
class Staged(WriterCommitMessage):
    """(staged file, its place below the target folder) of one task."""

    files: list[tuple[str, str]]


class KeyedTextWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.target, self.keys, self.name = options["path"].rstrip("/"), options["keys"].split(","), options["name"]
        self.overwrite = overwrite
        self.staging = f"{self.target}/_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        """Rows come sorted by the keys; each key's lines become one file."""
        system, staging = _file_system(f"{self.staging}/{uuid.uuid4().hex}")
        files, current, out = [], None, None
        try:
            for row in iterator:
                key = tuple(row[k] for k in self.keys)
                if key != current:
                    if out is not None:
                        out.close()
                    if not files:
                        system.create_dir(staging, recursive=True)
                    place = "/".join(f"{k}={quote(str(v), safe=' ')}" for k, v in zip(self.keys, key))
                    files.append((f"{staging}/{len(files)}", f"{place}/{self.name}"))
                    current, out = key, system.open_output_stream(files[-1][0])
                out.write(row["line"].encode() + b"\n")
        finally:
            if out is not None:
                out.close()
        return Staged(files)

    def _clear(self) -> None:
        system, staging = _file_system(self.staging)
        if system.get_file_info(staging).type != pafs.FileType.NotFound:
            system.delete_dir(staging)

    def commit(self, messages: list[Staged | None]) -> None:
        system, target = _file_system(self.target)
        moves = [(staged, f"{target}/{place}") for message in messages if message is not None for staged, place in message.files]
        try:
            taken = [place for _, place in moves if system.get_file_info(place).type != pafs.FileType.NotFound]
            if taken and not self.overwrite:
                raise FileExistsError(f"{len(taken)} files are there already, {taken[0]} among them")
            for staged, place in moves:
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                system.move(staged, place)
        finally:
            self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()


class KeyedText(DataSource):
    """Write-only: options path, keys (comma separated columns) and name (of each file)."""

    @classmethod
    def name(cls) -> str:
        return "keyed_text"

    def writer(self, schema, overwrite: bool) -> KeyedTextWriter:
        return KeyedTextWriter(dict(self.options), overwrite)


def write_keyed_text(lines: DataFrame, keys: list[str], path: str, name: str, overwrite: bool = False) -> None:
    """One file of `line` in order of `line_no` for each key; nothing is left where the job fails."""
    lines.sparkSession.dataSource.register(KeyedText)
    ordered = lines.repartition(*keys).sortWithinPartitions(*keys, "line_no").select(*keys, "line")
    writer = ordered.write.format("keyed_text").option("keys", ",".join(keys)).option("name", name)
    writer.mode("overwrite" if overwrite else "append").save(path)


def read_keyed_text(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The files of `write_keyed_text`: the keys (as their folders tell them), line_no from 0, line."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=name)
    keys = [c for c in files.columns if c != "value"]
    lines = F.split(F.regexp_replace("value", "\n$", ""), "\n")
    return files.select(*keys, F.posexplode(lines).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))
