"""Trees of files on folders that every node mounts, listed and read in tasks, and shards that appear whole or not at all.

Listing goes level by level: tasks expand the directories of a level, and their rows are the next one's. Links are neither
followed nor counted as files; entries that cannot be read are rows of their own kind. Prefixes are read through a
data source of its own, whose partitions are bins of about equal bytes to read.
"""

from __future__ import annotations

import json
import os
import stat
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.bytes import PREFIX
from ..operators.delta import shards
from ..operators.order import running
from ..storage import shared_folder, written

ENTRY = "kind string, path string, size long, device long, inode long"


def local(path: str) -> str:
    """The mounted folder that a path or file: URI names."""
    return path.removeprefix("file://").rstrip("/") or "/"


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(kind, path below root, size, device, inode) of what stands below a mounted folder. Kinds: file, dir, link (not followed),
    other (sockets and the like), closed (a directory that cannot be listed), unreadable (an entry without a status). A
    level of directories is one job; its rows are written, so that a lost executor costs a read."""
    base = local(root)

    def expand(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in ENTRY.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        rows = []
        for at in (p for b in batches for p in b.column(0).to_pylist()):
            try:
                with os.scandir(os.path.join(base, at)) as entries:
                    for e in entries:
                        path = f"{at}/{e.name}" if at else e.name
                        try:
                            seen = e.stat(follow_symlinks=False)
                        except OSError:
                            rows.append(("unreadable", path, None, None, None))
                            continue
                        mode = seen.st_mode
                        kind = "link" if stat.S_ISLNK(mode) else "dir" if stat.S_ISDIR(mode) else "file" if stat.S_ISREG(mode) else "other"
                        rows.append((kind, path, seen.st_size if kind == "file" else None, seen.st_dev, seen.st_ino))
                        if len(rows) >= 8192:
                            yield batch(rows)
                            rows = []
            except OSError:
                rows.append(("closed", at, None, None, None))
        if rows:
            yield batch(rows)

    level, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        levels.append(written(level.repartition("path").mapInArrow(expand, ENTRY), "level"))
        level = levels[-1].where("kind = 'dir'").select("path")
        if not level.take(1):
            break
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    # a closed directory stands once as what it is and once as what could not be done
    return out


@dataclass
class Bin(InputPartition):
    folder: str


class PrefixSource(DataSource):
    """Options: root, most (bytes of a file), listing (folder with bins of files: bin=K/*.parquet with path and size)."""

    @classmethod
    def name(cls) -> str:
        return "corpusloom_prefix"

    def schema(self) -> str:
        return "path string, size long, n_read long, content binary"

    def reader(self, schema) -> PrefixReader:
        return PrefixReader(self.options["root"], self.options["listing"], int(self.options["most"]))


class PrefixReader(DataSourceReader):
    """Reads at most so many bytes of each file; a file that cannot be read has a null content."""

    #: Bytes that a task gives at once, about.
    STEP = 16 << 20

    def __init__(self, root: str, listing: str, most: int):
        self.root, self.listing, self.most = root, listing, most

    def partitions(self) -> list[InputPartition]:
        return [Bin(os.path.join(self.listing, d)) for d in sorted(os.listdir(self.listing)) if d.startswith("bin=")] or [Bin("")]

    def read(self, partition: Bin):
        import pyarrow as pa
        import pyarrow.dataset as ds

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["path", "size", "n_read", "content"])

        rows, held = [], 0
        for some in ds.dataset(partition.folder, format="parquet").to_batches(columns=["path", "size"]) if partition.folder else ():
            for path, size in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                try:
                    with open(os.path.join(self.root, path), "rb", buffering=0) as f:
                        content = b""
                        while len(content) < self.most and (piece := f.read(self.most - len(content))):
                            content += piece
                except OSError:
                    content = None
                rows.append((path, size, len(content or b""), content))
                held += len(content or b"") + 256
                if held >= self.STEP:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)


def read_prefixes(spark: SparkSession, root: str, most: int = PREFIX, bin_bytes: int = 64 << 20) -> DataFrame:
    """(path, size, n_read, content) of the files below root, of each the first bytes only. Files are dealt to bins by what
    is read of them (and 4 KB for the opening), so that a bin of small files and one of large ones take like time."""
    files = list_tree(spark, root).where("kind = 'file'").select("path", "size")
    cost = F.least("size", F.lit(most)) + 4096
    bins = running(files, cost, ["path"]).withColumn("bin", F.floor((F.col("upto") - cost) / bin_bytes).cast("long"))
    at = f"{local(shared_folder(spark))}/corpusloom/bins-{uuid.uuid4().hex}"
    bins.select("path", "size", "bin").repartitionByRange("bin").write.partitionBy("bin").parquet(at)
    spark.dataSource.register(PrefixSource)
    return spark.read.format("corpusloom_prefix").options(root=local(root), listing=at, most=str(most)).load()


@dataclass
class Written(WriterCommitMessage):
    """A task's shards: (shard, private name, first, last, rows)."""

    shards: list[tuple[int, str, str, str, int]]


class ShardSink(DataSource):
    """Option path. Rows: shard, key, line; rows of a shard come together, in order of key."""

    @classmethod
    def name(cls) -> str:
        return "corpusloom_shards"

    def schema(self) -> str:
        return "shard long, key string, line string"

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"])


class ShardWriter(DataSourceWriter):
    """Tasks write shards under private names. The commit, which runs once and only if all tasks went well, gives them their
    names and writes the index last; readers take the index' word for what is there. Whatever fails removes its own."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> Written:
        os.makedirs(self.path, exist_ok=True)
        done, f, shard = [], None, None
        try:
            for row in rows:
                if row["shard"] != shard:
                    if f:
                        self.close(f)
                    shard, name = row["shard"], f".{uuid.uuid4().hex}"
                    done.append((shard, name, row["key"], row["key"], 0))
                    f = open(os.path.join(self.path, name), "wb")  # noqa: SIM115
                f.write((row["line"] or "").replace("\r", "").encode() + b"\n")
                done[-1] = (*done[-1][:3], row["key"], done[-1][4] + 1)
            if f:
                self.close(f)
        except BaseException:
            if f:
                f.close()
            self.remove([x[1] for x in done])
            raise
        return Written(done)

    @staticmethod
    def close(f) -> None:
        f.flush()
        os.fsync(f.fileno())
        f.close()

    def remove(self, names: list[str]) -> None:
        for name in names:
            if os.path.exists(os.path.join(self.path, name)):
                os.remove(os.path.join(self.path, name))

    def commit(self, messages) -> None:
        os.makedirs(self.path, exist_ok=True)
        found = sorted(x for m in messages if m for x in m.shards)
        index = []
        for shard, name, first, last, n in found:
            os.replace(os.path.join(self.path, name), os.path.join(self.path, f"shard-{shard:08d}.jsonl"))
            index.append(json.dumps({"shard": shard, "first": first, "last": last, "n": n}))
        private = os.path.join(self.path, f".{uuid.uuid4().hex}")
        with open(private, "wb") as f:
            f.write("".join(x + "\n" for x in index).encode())
            self.close(f)
        os.replace(private, os.path.join(self.path, "index.jsonl"))

    def abort(self, messages) -> None:
        self.remove([x[1] for m in messages if m for x in m.shards])


def write_shards(rows: DataFrame, order: str, size: int, path: str) -> None:
    """rows (a column line, and order: unique strings) in shards of at most size, in order, below a mounted folder that holds
    no shards yet. A folder without an index holds nothing; shards are then not read."""
    cut = shards(rows.select(F.col(order).alias("key"), "line"), "key", size)
    spark = rows.sparkSession
    spark.dataSource.register(ShardSink)
    cut.repartitionByRange("shard").sortWithinPartitions("shard", "key").select("shard", "key", "line").write.format("corpusloom_shards").option("path", local(path)).mode("append").save()


def read_shards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, index) of shards: lines (shard, line), index (shard, first, last, n). Without an index there is nothing."""
    at = local(path)
    if not os.path.exists(os.path.join(at, "index.jsonl")):
        return spark.createDataFrame([], "shard long, line string"), spark.createDataFrame([], "shard long, first string, last string, n long")
    index = spark.read.schema("shard long, first string, last string, n long").json(f"file://{at}/index.jsonl")
    if not index.take(1):
        return spark.createDataFrame([], "shard long, line string"), index
    lines = spark.read.text(f"file://{at}/shard-*.jsonl").select(F.regexp_extract("_metadata.file_name", r"shard-(\d+)", 1).cast("long").alias("shard"), F.col("value").alias("line"))
    return lines, index
