"""Byte-level features that need a pass over binary content: numpy in Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: Longest part of a file that the profile reads.
PREFIX = 4 << 20

_PRINTABLE = np.array([0x20 <= b <= 0x7E or b in (9, 10, 13) for b in range(256)])
_DIGITISH = np.array([chr(b) in "0123456789abcdefABCDEFx, \n" for b in range(256)])


def thinned(raw: bytes) -> tuple[str, bool, bytes]:
    """(encoding, bom, bytes): the mark taken off, and of UTF-16 every second byte, zeros dropped."""
    if raw.startswith(b"\xef\xbb\xbf"):
        return "utf-8", True, raw[3:]
    for mark, name, offset in ((b"\xff\xfe", "utf-16le", 0), (b"\xfe\xff", "utf-16be", 1)):
        if raw.startswith(mark):
            return name, True, raw[2:][offset::2].replace(b"\0", b"")
    return "ascii", False, raw


def byte_features(data: bytes) -> tuple[float, float, float]:
    """(printable share, digit-like share, entropy in bits) of bytes that are not empty."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / len(data)
    return float(counts[_PRINTABLE].sum() / len(data)), float(counts[_DIGITISH].sum() / len(data)), float(-(p * np.log2(p)).sum())


def looks_binary(raw: bytes) -> bool:
    """A NUL in the first 8192 bytes, unless the file starts with a wide byte-order mark."""
    return not raw.startswith((b"\xff\xfe", b"\xfe\xff")) and b"\0" in raw[:8192]


def strict_text(raw: bytes) -> tuple[str, str] | None:
    """(text, encoding) of bytes that decode without loss; None for binary and for UTF-32."""
    if raw.startswith((b"\xff\xfe\0\0", b"\0\0\xfe\xff")):
        return None
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if raw.startswith(mark):
            break
    else:
        mark, name = b"", "utf-8"
        if b"\0" in raw:
            return None
    try:
        return raw[len(mark) :].decode(name), name
    except UnicodeDecodeError:
        return None


SCHEMA = "key string, encoding string, bom boolean, bytes long, printable double, digitish double, entropy double, text string"


def featured(files: DataFrame, key: str = "path", content: str = "content", with_text: bool = True, prefix: int | None = PREFIX) -> DataFrame:
    """A row for each file with the byte features of its prefix, or of all of it where prefix is None; text is what was
    read, thinned, one character per byte."""
    from pyspark.sql import functions as F

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # one file's bytes at a time
                name, bom, data = thinned(value.as_py() or b"")
                shares = byte_features(data) if data else (0.0, 0.0, 0.0)
                rows.append((k, name, bom, len(data), *shares, data.decode("latin-1") if with_text else None))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    read = F.col(content) if prefix is None else F.substring(content, 1, prefix)
    return files.select(F.col(key).cast("string"), read).mapInArrow(run, SCHEMA)


def _trigrams(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return (b[:-2] << 16) | (b[1:-1] << 8) | b[2:] if len(b) > 2 else np.empty(0, np.uint32)


#: Trigrams that a task holds of a group before it drops repeated ones.
HELD = 4 << 20


def trigram_sets(files: DataFrame, group: str, content: str) -> DataFrame:
    """(group, trigram) pairs, distinct within parts of an Arrow batch: the partial step of a distinct count. A worker holds
    one group's trigrams at a time, HELD of them or one file's."""
    from pyspark.sql import functions as F

    def run(batches):
        import pyarrow as pa

        def part(g, held):
            found = np.unique(np.concatenate(held)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([g] * len(found), pa.string()), pa.array(found)], names=["group", "trigram"])

        for batch in batches:
            groups = batch.column(0).to_pylist()
            by: dict = {}
            for i, g in enumerate(groups):
                by.setdefault(g, []).append(i)
            for g, rows in by.items():
                held, n = [], 0
                for i in rows:
                    raw = batch.column(1)[i].as_py()
                    if raw:
                        held.append(np.unique(_trigrams(raw)))
                        n += len(held[-1])
                    if n >= HELD:
                        yield part(g, held)
                        held, n = [], 0
                if held:
                    yield part(g, held)

    return files.select(F.col(group).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "group string, trigram int")


def fnv1a(units: list[np.ndarray]) -> np.ndarray:
    """64-bit FNV-1a over the 16-bit units of each array, one step for each unit, all arrays side by side."""
    out = np.full(len(units), 0xCBF29CE484222325, np.uint64)
    lengths = np.array([len(x) for x in units], np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat, starts = np.concatenate([*units, np.empty(0, np.uint16)]), np.concatenate(([0], np.cumsum(lengths)))
    with np.errstate(over="ignore"):
        for at in range(int(lengths.max(initial=0))):
            live = order[: int(np.searchsorted(-lengths[order], -at, "left"))]
            out[live] = (out[live] ^ flat[starts[live] + at].astype(np.uint64)) * np.uint64(0x100000001B3)
    return out


def line_hashes(lines: DataFrame, content: str = "content") -> DataFrame:
    """lines with hash, the FNV-1a of the content's UTF-16 units as a signed 64-bit number; null contents hash as empty."""
    from pyspark.sql.types import LongType, StructType

    schema = StructType([*lines.schema.fields]).add("hash", LongType())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            units = [np.frombuffer((x or "").encode("utf-16-le", "surrogatepass"), "<u2") for x in batch.column(content).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fnv1a(units).view(np.int64))], names=[*batch.schema.names, "hash"])

    return lines.mapInArrow(run, schema)


def made_binary(raw: bytes, flips: np.ndarray) -> bytes:
    """Bytes with those at flips changed, so that they look binary: a NUL within the first five bytes, and no wide
    byte-order mark."""
    data = np.frombuffer(raw, np.uint8).copy()
    data[flips] ^= 0x5A
    if len(data):
        data[min(4, len(data) - 1)] = 0
    out = data.tobytes()
    if out.startswith((b"\xff\xfe", b"\xfe\xff", b"\0\0\xfe\xff")):
        out = bytes([out[0] ^ 1]) + out[1:]
    return out


def decode_checks(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, binary, decodes): whether a file looks binary, and the encoding in which all of it decodes, else null."""
    from pyspark.sql import functions as F

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raws = [x or b"" for x in batch.column(1).to_pylist()]
            texts = [strict_text(x) for x in raws]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([looks_binary(x) for x in raws]), pa.array([t and t[1] for t in texts], pa.string())], names=["key", "binary", "decodes"])

    return files.select(F.col(key).cast("string").alias("key"), F.col(content).cast("binary")).mapInArrow(run, "key string, binary boolean, decodes string")
