"""ELF objects and ar archives: sections, symbols and relocations as rows."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

SCHEMA = "path string, member string, kind string, section string, name string, target string, size long"


class Malformed(ValueError):
    pass


def members(raw: bytes):
    """(name, bytes) of an ar archive's members; index members are left out."""
    if not raw.startswith(b"!<arch>\n"):
        raise Malformed("no archive")
    at, long_names = 8, b""
    while at + 60 <= len(raw):
        name, size = raw[at : at + 16].rstrip(), raw[at + 48 : at + 58].strip()
        if raw[at + 58 : at + 60] != b"`\n" or not size.isdigit():
            raise Malformed("bad member header")
        body = raw[at + 60 : at + 60 + int(size)]
        at += 60 + int(size) + int(size) % 2
        if name == b"//":
            long_names = body
        elif name.startswith(b"/") and name[1:].isdigit():
            start = int(name[1:])
            yield long_names[start : long_names.index(b"/", start)].decode("latin-1"), body
        elif name not in (b"/", b"/SYM64/"):
            yield name.removesuffix(b"/").decode("latin-1"), body


def elf_rows(raw: bytes):
    """(kind, section, name, target, size) of an ELF object: sections; symbols with the section they lie in; relocations of
    a section with the symbol they name."""
    if raw[:4] != b"\x7fELF" or len(raw) < 52:
        raise Malformed("no ELF object")
    wide, order = raw[4] == 2, "<" if raw[5] == 1 else ">"
    header = struct.unpack_from(order + ("HHIQQQIHHHHHH" if wide else "HHIIIIIHHHHHH"), raw, 16)
    at, size, count, names_at = header[5], header[10], header[11], header[12]
    layout = order + ("IIQQQQIIQQ" if wide else "IIIIIIIIII")
    heads = [struct.unpack_from(layout, raw, at + i * size) for i in range(count)]

    def string(table: int, offset: int) -> str:
        start = heads[table][4] + offset
        return raw[start : raw.index(b"\0", start)].decode("latin-1")

    titles = [string(names_at, h[0]) for h in heads] if count else []
    symbols: dict[int, list[tuple[str, int]]] = {}
    for i, h in enumerate(heads):
        yield "section", titles[i], titles[i], None, h[5]
        if h[1] == 2:
            step = 24 if wide else 16
            table = []
            for k in range(h[5] // step):
                if wide:
                    name, _, _, where, _, length = struct.unpack_from(order + "IBBHQQ", raw, h[4] + k * step)
                else:
                    name, _, length, _, _, where = struct.unpack_from(order + "IIIBBH", raw, h[4] + k * step)
                title = string(h[6], name) if name else ""
                table.append((title, where))
                if title:
                    yield "symbol", titles[where] if where < len(titles) else None, title, None, length
            symbols[i] = table
    for i, h in enumerate(heads):
        if h[1] in (4, 9):
            step = (24 if wide else 12) if h[1] == 4 else (16 if wide else 8)
            for k in range(h[5] // step):
                info = struct.unpack_from(order + ("QQ" if wide else "II"), raw, h[4] + k * step)[1]
                number = info >> 32 if wide else info >> 8
                title, where = symbols.get(h[6], [])[number]
                yield "relocation", titles[h[7]], None, title or (titles[where] if where < len(titles) else ""), None


def object_rows(files: DataFrame) -> DataFrame:
    """Rows of all objects and archive members of files (path, content); what is neither is a row of kind malformed."""

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    for member, body in members(raw) if raw.startswith(b"!<arch>") else [("", raw)]:
                        rows += [(path, member, *r) for r in elf_rows(body)]
                except (Malformed, struct.error, ValueError, IndexError) as e:
                    rows.append((path, "", "malformed", None, str(e), None, None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if n == "size" else pa.string()) for n, c in zip(names, columns, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)
