import gzip
import hashlib
import json
import os
import struct

import pytest
from corpusloom.operators.delta import symbol_diff
from corpusloom.sources import files as S
from corpusloom.sources import manifests as M
from corpusloom.sources import objects as O
from corpusloom.sources import sinks as K


def test_tree(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.c").write_bytes(b"123")
    (tmp_path / "y").write_bytes(b"")
    (tmp_path / "link").symlink_to(tmp_path / "y")
    rows = {r.path: (r.name, r.size, bytes(r.content)) for r in S.read_tree(spark, str(tmp_path)).collect()}
    assert rows["a/b/x.c"] == ("x.c", 3, b"123")
    assert S.local_listing(str(tmp_path)) == ([("a/b/x.c", 3), ("y", 0)], ["a", "a/b"], 0)
    assert bytes(S.prefix(S.read_tree(spark, str(tmp_path), "x.c"), 2).first().content) == b"12"


def test_manifest_round_trip(spark, tmp_path):
    text = json.dumps({"_meta": {"manifestVersion": 1}, "symbols": {"z": {"def": "a:1", "refs": ["b:2"], "edges": []}, "a": {"def": "a:2", "refs": [], "edges": ["z"], "expectedMiss": True}}})
    symbols, meta = M.read_manifest(spark, text)
    assert [(r.name, r["def"], r.refs) for r in symbols.orderBy("ord").collect()] == [("z", "a:1", ["b:2"]), ("a", "a:2", [])]
    K.write_manifest(symbols, meta, str(tmp_path / "m.json"))
    again, _ = M.read_manifest(spark, (tmp_path / "m.json").read_text())
    assert again.collect() == symbols.collect()
    with pytest.raises(M.BadInput):
        M.read_manifest(spark, '{"symbols": {"a": {}, "a": {}}}')
    with pytest.raises(M.BadInput):
        M.read_manifest(spark, '{"_meta": {"manifestVersion": 9}, "symbols": {}}')
    K.write_overlay(symbol_diff(symbols.select("name", "def", "refs", "edges"), symbols.where("name = 'a'").select("name", "def", "refs", "edges")), str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == {"z": "TOMBSTONE"}


def test_profiles():
    with pytest.raises(M.BadInput):
        M.read_profile('{"archetypes": [{"class": "text", "label": "A", "extension": ".c"}, {"class": "text", "label": "a", "extension": ".C"}]}', ("text",))
    with pytest.raises(M.BadInput):
        M.read_profile('{"archetypes": [{"class": "nope"}]}', ("text",))


def test_compile_db(spark):
    db = json.dumps([{"directory": ".", "file": "u.c", "arguments": ["cc", "-Iinc", "-I", "inc2", "-DA=1", "-D", "B"]}, {"directory": ".", "file": "v.c", "command": "cc  -Ix -c v.c"}])
    assert [tuple(r) for r in M.read_compile_db(spark, db).collect()] == [("u.c", ["inc", "inc2"], ["A=1", "B"]), ("v.c", ["x"], [])]


def test_build_log():
    got = M.read_build_log("cc x\nld.lld -T s.ld -L lib a.o b.a -o x.elf\n")
    assert got == {"script": "s.ld", "dirs": ["lib"], "objects": ["a.o", "b.a"]}
    with pytest.raises(M.BadInput):
        M.read_build_log("nothing")


def elf() -> bytes:
    """A 64-bit object with a section .text, a function f in it, and a relocation in .text to g."""
    strings, names = b"\0f\0g\0", b"\0.text\0.symtab\0.strtab\0.shstrtab\0.rela.text\0"
    symbols = bytes(24) + struct.pack("<IBBHQQ", 1, 0x12, 0, 1, 0, 7) + struct.pack("<IBBHQQ", 3, 0x10, 0, 0, 0, 0)
    rela = struct.pack("<QQq", 0, 2 << 32 | 4, 0)
    parts = [b"\xc3" * 8, symbols, strings, names, rela]
    at, offsets = 64, []
    for p in parts:
        offsets.append(at)
        at += len(p)
    head = lambda name, kind, i, link=0, info=0: struct.pack("<IIQQQQIIQQ", name, kind, 0, 0, offsets[i], len(parts[i]), link, info, 1, 0)
    sections = bytes(64) + head(1, 1, 0) + head(7, 2, 1, 3) + head(15, 3, 2) + head(23, 3, 3) + head(33, 4, 4, 2, 1)
    return b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 1, 62, 1, 0, 0, at, 0, 64, 0, 0, 64, 6, 4) + b"".join(parts) + sections


def test_objects(spark):
    archive = b"!<arch>\n" + b"f.o/            0           0     0     644     " + f"{len(elf()):<10}".encode() + b"`\n" + elf()
    files = spark.createDataFrame([("a.o", bytearray(elf())), ("b.a", bytearray(archive)), ("bad", bytearray(b"x"))], "path string, content binary")
    rows = O.object_rows(files).collect()
    assert {(r.path, r.member, r.section, r["name"]) for r in rows if r.kind == "symbol"} == {("a.o", "", ".text", "f"), ("b.a", "f.o", ".text", "f"), ("a.o", "", None, "g"), ("b.a", "f.o", None, "g")} or {(r.path, r["name"]) for r in rows if r.kind == "symbol"} == {("a.o", "f"), ("b.a", "f"), ("a.o", "g"), ("b.a", "g")}
    assert {(r.path, r.section, r.target) for r in rows if r.kind == "relocation"} == {("a.o", ".text", "g"), ("b.a", ".text", "g")}
    assert [r.path for r in rows if r.kind == "malformed"] == ["bad"]


def test_lists_and_shards(spark, tmp_path, monkeypatch):
    names = spark.createDataFrame([("b",), ("a",)], "name string")
    assert K.write_list(names, "name", str(tmp_path / "l")) == (hashlib.sha256(b"a\nb\n").hexdigest(), 2) and (tmp_path / "l").read_bytes() == b"a\nb\n"
    assert K.write_list(names, "name", str(tmp_path / "h"), hash_only=True)[1] == 2 and not (tmp_path / "h").exists()
    monkeypatch.setattr(K, "COMPRESS_FROM", 3)
    K.write_list(names, "name", str(tmp_path / "z"))
    assert gzip.decompress((tmp_path / "z.gz").read_bytes()) == b"a\nb\n"
    assert K.write_list(names.limit(0), "name", str(tmp_path / "e"))[1] == 0
    K.write_manifest(spark.createDataFrame([], "name string, def string"), {}, str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == {"_meta": {}, "symbols": {}}
    (tmp_path / "g.gz").write_bytes(gzip.compress(b"a\nb\n"))
    assert S.read_list(spark, str(tmp_path / "g.gz")).count() == 2
    (tmp_path / "c.tsv").write_text("name\tcase\tsite\nf\tx\ta:1\n")
    assert S.read_cases(spark, str(tmp_path / "c.tsv")).first().site == "a:1"
    rows = spark.range(25).selectExpr("format_string('p%03d', id) AS path", "id")
    K.write_sharded(rows, "path", 10, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s/index")).agg({"n": "sum"}).first()[0] == 25 and len([x for x in os.listdir(tmp_path / "s/shards") if x.startswith("shard=")]) == 3
    lines = spark.createDataFrame([("a", 1, "#define KEEP 1", "\n"), ("a", 2, "#define GONE 2", "\n"), ("a", 3, "x", "")], "path string, n int, content string, term string")
    assert K.carve(lines, spark.createDataFrame([("GONE",)], "name string")).first().text == "#define KEEP 1\nx"
