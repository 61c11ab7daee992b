"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import bisect
import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder, written  # noqa: F401  (used by the operators)

#: White space of the word contracts: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"

#: Rows (three numbers each) that without() sends to all tasks at most.
FEW_GONE = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once per row and hands it to body. Catalyst would otherwise copy value into every lambda that
    names it, and evaluate it once per array element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan_partitions(spark: SparkSession, at_least: int = 1) -> int:
    """How many partitions a shuffle gets: the session's setting, which the cluster sets by the size of the data."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Marks df for broadcast only when a count shows at most so many (narrow) rows; otherwise the join shuffles."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """A name for each of wanted that no column of df has, whatever its case; so that extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_marks(docs: DataFrame, *of: str) -> tuple[DataFrame, list[str]]:
    """docs with two hashes of the columns that a verdict hangs on, and the names of these columns."""
    names = free_names(docs, "_row", "_row2")
    return docs.withColumns({names[0]: F.xxhash64(*of), names[1]: F.xxhash64(F.lit(1), *of)}), names


def without(docs: DataFrame, gone: DataFrame, marks: list[str]) -> DataFrame:
    """The rows of docs that gone (doc_id and the marks of row_marks) does not hold, without the marks. With them, rows
    without a doc_id meet only those alike, and spread. gone is sent to all tasks where it is counted to be small, so that
    docs are not shuffled; else the join shuffles both."""
    out, other = docs.alias("out"), broadcast_if_small(written(gone, "gone"), FEW_GONE).alias("gone")
    same = F.col("out.doc_id").eqNullSafe(F.col("gone.doc_id"))
    for m in marks:
        same = same & (F.col(f"out.`{m}`") == F.col(f"gone.`{m}`"))
    return out.join(other, same, "left_anti").drop(*marks)


class Cover:
    """What spans (start, end) cover together, for tests in logarithmic time."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        """Whether a character from a to b (exclusive) is covered."""
        at = bisect.bisect_left(self.starts, b) - 1
        return at >= 0 and self.ends[at] > a


def slices(batch, most_bytes: int):
    """Parts of an Arrow batch of at most so many bytes each, or of one row. Bounds what a Python worker holds, also
    where a batch holds thousands of long texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if batch.nbytes <= most_bytes or batch.num_rows < 2:
        yield batch
        return
    total = None
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size = pc.fill_null(pc.binary_length(column), 0)
            total = size if total is None else pc.add(total, size)
    ends = pc.cumulative_sum(pc.add(total.cast(pa.int64()), 16)).to_numpy() if total is not None else []
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(ends.searchsorted(done + most_bytes, "right"))) if total is not None else batch.num_rows
        yield batch.slice(at, to - at)
        at, done = to, ends[to - 1] if total is not None else 0


def giving_back(run: Callable) -> Callable:
    """run, for mapInArrow, which at a task's end gives the system back what it has freed: Python workers stay for later
    tasks, and their allocators would keep the most that any task has held."""

    def with_end(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library of another kind
                ctypes.CDLL(None).malloc_trim(0)

    return with_end


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, most_bytes: int = 8 << 20) -> DataFrame:
    """Applies fn to column lists, part by part of each Arrow batch. Strings arrive as str, binary as bytes. fn gets and
    gives whole columns, so that it can hold compiled patterns and tables for a part."""
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(kinds)
        for batch in batches:
            for part in slices(batch, most_bytes) if batch.num_rows else ():
                made = fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(giving_back(run), kinds)
