"""Deterministic corpora as tables: call graphs, indirect edges, sources, headers, populations, content by class.

Everything is a function of (seed, index): rows come from spark.range, text from column templates, so that any number of
tasks makes the same corpus. Where a draw must come from a keyed stream, an Arrow function draws it from its row's key.
Files are rows (path, content); write them with the sinks.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .literals import names_outside
from .order import weighted_picks
from .rng import CATEGORIES, Stream

FILES = "path string, content binary"


def effective(value: int, scale: float, explicit: bool = False, keep_one: bool = False) -> int:
    """A count knob: literal if given outright, else scaled, halves to even; an enabled pathology keeps one."""
    if value <= 0:
        return 0
    n = value if explicit else round(value * scale)
    return max(n, 1) if keep_one else n


# ---- call graphs ----


def chain(spark: SparkSession, n: int) -> tuple[DataFrame, int]:
    """Edges (src, dst) of a chain of n nodes, at least 2, and its root, the last."""
    n = max(2, n)
    return spark.range(1, n).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst")), n - 1


def call_tree(spark: SparkSession, live: int, fanout: int, depth: int = 0, leaves: int = 0, fraction: float = 0.0, seed: int = 0) -> tuple[DataFrame, int]:
    """(edges, node count) of a complete tree below node 0, with leaves that two nodes share, and dead chains of about four
    so that the reachable share is fraction."""
    fanout = max(1, fanout)
    if depth > 0:
        cap = sum(fanout**d for d in range(depth + 1))
        live = max(2, min(live, cap))
    edges = spark.range(1, live).select(F.floor((F.col("id") - 1) / fanout).cast("long").alias("src"), F.col("id").alias("dst"))
    total = live + leaves
    if leaves:
        draw, pairs = Stream(seed, CATEGORIES["ProfileOracle"], 1), []
        for k in range(leaves):
            a, b = draw.below(live), draw.below(live)
            pairs += [(a, live + k), ((b + 1) % live if a == b else b, live + k)]
        edges = edges.unionByName(spark.createDataFrame(pairs, "src long, dst long"))
    dead = max(0, int(total / fraction + 0.5) - total) if 0 < fraction < 1 else 0
    if dead:
        edges = edges.unionByName(spark.range(1, dead).where("id % 4 <> 0").select((F.col("id") + total).alias("src"), (F.col("id") + total - 1).alias("dst")))
    return edges, total + dead


def indirect_plan(spark: SparkSession, n: int) -> DataFrame:
    """(k, via, dispatched, resolved, want_dead, target) of n indirect edges: all four corners of reachable and dispatched
    come within four edges."""
    k = F.col("id")
    resolved = k % 3 != 2
    return spark.range(n).select(
        k.alias("k"),
        F.element_at(F.array(F.lit("fnptr"), F.lit("vector-table"), F.lit("init_array")), (k % 3).cast("int") + 1).alias("via"),
        (k % 2 == 0).alias("dispatched"),
        resolved.alias("resolved"),
        (F.floor(k / 2) % 2 == 1).alias("want_dead"),
        F.concat(F.when(resolved, "itgt_").otherwise("iext_"), k.cast("string")).alias("target"),
    )


# ---- directories and files ----


def directory(i: Column, count: int, depth: int = 4) -> Column:
    """Path of leaf directory i mod count in blocks of 3 by 3."""
    d = F.pmod(i, F.lit(max(1, count)))
    parts = [F.concat(F.lit("block"), F.floor(d / 9).cast("string")), F.concat(F.lit("sub"), (F.floor(d / 3) % 3).cast("string")), F.concat(F.lit("mod"), (d % 3).cast("string"))]
    return F.concat_ws("/", *parts, *[F.lit(f"lvl{k}") for k in range(3, min(depth, 12))])


def placed(seed: int, i: Column, dirs: int) -> Column:
    return directory(F.xxhash64(F.lit(seed), F.lit("place"), i), dirs)


def files(rows: DataFrame, path: Column, text: Column) -> DataFrame:
    return rows.select(path.alias("path"), F.encode(text, "UTF-8").alias("content"))


def sources(spark: SparkSession, n: int, seed: int, dirs: int = 9, headers: int = 0, body: int = 600) -> DataFrame:
    """n sources, func_i calling func_{i-1}; at least 2 so that there is an edge between files."""
    i = F.col("id")
    s = i.cast("string")
    includes = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.concat(F.lit('#include "hdr_'), F.pmod(F.xxhash64(F.lit(seed), i, k), F.lit(max(1, headers))).cast("string"), F.lit('.h"\n'))), "") if headers else F.lit("")
    before = F.when(i > 0, F.concat(F.lit("int func_"), (i - 1).cast("string"), F.lit("(int x);\n"))).otherwise("")
    call = F.when(i > 0, F.concat(F.lit("    acc += func_"), (i - 1).cast("string"), F.lit("(x - 1);\n"))).otherwise("")
    filler = F.repeat(F.lit("    acc = (acc * 1664525 + 1013904223) ^ (acc >> 3);\n"), F.lit(body))
    text = F.concat(F.lit("#include <stddef.h>\n"), includes, F.lit("int func_"), s, F.lit("(int x);\n"), before, F.lit("int func_"), s, F.lit("(int x) {\n    int acc = x;\n"), call, filler, F.lit("    return acc;\n}"))
    return files(spark.range(max(2, n)), F.concat(placed(seed, i, dirs), F.lit("/src_"), s, F.lit(".c")), text)


def call_sites(source_files: DataFrame) -> DataFrame:
    """(name, path, line, kind) of definitions and calls in the sources, read from their text alone."""
    from ..functions.text import lines_lf

    lines = lines_lf(source_files.select("path", F.decode("content", "UTF-8").alias("text")), "text", "path")
    name = F.regexp_extract("line", r"(func_\d+)\(", 1)
    kind = F.when(F.col("line").rlike(r"^int func_\d+\(int x\) \{$"), "def").when(F.col("line").rlike(r"acc \+= func_"), "ref")
    return lines.select(name.alias("name"), "path", F.col("n").alias("line"), kind.alias("kind")).where("kind IS NOT NULL")


def register_header(spark: SparkSession, path: str, defines: int, most_bytes: int, family: int) -> DataFrame:
    """(path, n, text): the lines of a register map header with so many defines, three a register, cut before the register
    that would pass most_bytes. Byte positions come from a running sum of lengths, which are closed-form per digit count."""
    guard = "REGMAP_" + path.rsplit("/", 1)[-1].rsplit(".", 1)[0].upper() + "_H"
    top = f"#ifndef {guard}\n#define {guard}\n/* generated hardware register map - block {family} (synthetic) */\n"
    room, fits, digits, low = most_bytes - len(top) - 7, 0, 1, 0
    stem = len(f"#define HWIO_BLK{family}_REG")
    each = lambda d: 3 * (stem + d) + len(f"_ADDR (BASE_BLOCK{family} + 0x00000000)\n_RMSK 0x000000ff\n_IN in_dword(HWIO_BLK{family}_REG_ADDR)\n") + d
    while low < -(-defines // 3) and room >= each(digits):
        step = min(10**digits - low, room // each(digits), -(-defines // 3) - low)
        fits += step
        room -= step * each(digits)
        low += step
        if low < 10**digits:
            break
        digits += 1
    r = F.col("id").cast("string")
    head = F.concat(F.lit(f"#define HWIO_BLK{family}_REG"), r)
    address = F.concat(head, F.lit(f"_ADDR (BASE_BLOCK{family} + 0x"), F.lpad(F.lower(F.hex(F.col("id") * 4)), 8, "0"), F.lit(")\n"))
    owed = F.lit(defines) - 3 * F.col("id")
    text = F.concat(address, F.when(owed >= 2, F.concat(head, F.lit("_RMSK 0x000000ff\n"))).otherwise(""), F.when(owed >= 3, F.concat(head, F.lit(f"_IN in_dword(HWIO_BLK{family}_REG"), r, F.lit("_ADDR)\n"))).otherwise(""))
    body = spark.range(fits).select(F.lit(path).alias("path"), (F.col("id") + 1).alias("n"), text.alias("text"))
    ends = spark.createDataFrame([(path, 0, top), (path, fits + 1, "#endif\n")], "path string, n long, text string")
    return body.unionByName(ends)


# ---- populations ----


def duplicates(spark: SparkSession, groups: int, copies: int, seed: int, dirs: int = 9) -> DataFrame:
    """(group, path, content, near): byte-identical copies, at least two, and one near variant of each group."""
    copies = max(2, copies)
    g, c = F.col("id").cast("string"), F.col("c")
    draw = lambda tag: (F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), "id"), F.lit(999_999)) + 1).cast("string")
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda f: F.concat(F.lit("static int dup"), g, F.lit("_op"), f.cast("string"), F.lit("(int x) { return dup"), g, F.lit("_seed(x) ^ ("), draw("b"), F.lit(" + "), f.cast("string"), F.lit("); }\n"))), "")
    text = F.concat(F.lit("// duplicate group "), g, F.lit("\nstatic int dup"), g, F.lit("_seed(int x) { return x * "), draw("a"), F.lit(" + 1; }\n"), body)
    rows = spark.range(groups).withColumn("text", text).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    near = c == copies
    path = F.concat(placed(seed, F.xxhash64("id", "c"), dirs), F.lit("/dup"), g, F.when(near, "_near").otherwise(F.concat(F.lit("_c"), c.cast("string"))), F.lit(".c"))
    content = F.encode(F.when(near, F.concat(F.expr("left(text, length(text) - 2)"), F.lit("|\n"))).otherwise(F.col("text")), "UTF-8")
    return rows.select(F.col("id").alias("group"), path.alias("path"), content.alias("content"), near.alias("near"))


def broad_token(spark: SparkSession, n: int, share: float, seed: int, lines: int = 40_000, dirs: int = 9) -> DataFrame:
    """n carriers, a share of them with a hot token at 10, 40, 70, 95 and 99 % of their lines."""
    hot = F.col("id") < round(n * max(0.0, min(1.0, share)))
    filler, token = "    acc = (acc * 1664525 + 1013904223) ^ (acc >> 3);\n", "    acc += broad_hot(acc);\n"
    gaps = [10, 30, 30, 25, 4, 1]
    parts = [F.repeat(F.lit(filler), F.lit(lines * g // 100)) for g in gaps]
    with_token = F.concat(*[x for p in parts[:-1] for x in (p, F.lit(token))], parts[-1])
    text = F.concat(F.lit("int broad_hot(int x);\nint carrier(int acc) {\n"), F.when(hot, with_token).otherwise(F.concat(*parts)), F.lit("    return acc;\n}\n"))
    return files(spark.range(n), F.concat(placed(seed, F.col("id"), dirs), F.lit("/carrier_"), F.col("id").cast("string"), F.lit(".c")), text)


def encoding_mix(spark: SparkSession, n: int, seed: int, dirs: int = 9) -> DataFrame:
    """UTF-16 both ways and UTF-8 with marks, bytes that are no text, and identifiers beyond ASCII, in turn."""
    i, s = F.col("id"), F.col("id").cast("string")
    plain = F.lit("#include <stddef.h>\nint enc_probe(int x) {\n    int total = x;\n    return total;\n}\n")
    high = F.unhex(F.repeat(F.concat(*[F.substring(F.regexp_replace(F.upper(F.hex(F.xxhash64(F.lit(seed), i, F.lit(k)))), "(.)(.)", "8$2"), 1, 16) for k in range(4)]), F.lit(128)))
    kind = F.array(F.lit("utf16le.c"), F.lit("utf16be.c"), F.lit("utf8bom.c"), F.lit("invalid.dat"), F.lit("nonascii.c"))
    content = F.when(i % 5 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(plain, "UTF-16LE"))).when(i % 5 == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode(plain, "UTF-16BE"))).when(i % 5 == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(plain, "UTF-8"))).when(i % 5 == 3, high).otherwise(F.encode(F.lit("int café = 1;\nint Ωmega(int x) { return x + 1; }\nint имя = 42;\n"), "UTF-8"))
    return spark.range(n).select(F.concat(placed(seed, i, dirs), F.lit("/enc_"), s, F.lit("_"), F.element_at(kind, (i % 5).cast("int") + 1)).alias("path"), content.alias("content"))


def long_lines(spark: SparkSession, n: int, size: int, seed: int, dirs: int = 9) -> DataFrame:
    """One line each of size bytes, every second file without a newline."""
    unit = "function(){return this;}"
    text = F.concat(F.expr(f"left(repeat('{unit}', {size // len(unit) + 1}), {size})"), F.when(F.col("id") % 2 == 0, "\n").otherwise(""))
    return files(spark.range(n), F.concat(placed(seed, F.col("id"), dirs), F.lit("/longline_"), F.col("id").cast("string"), F.lit(".min.js")), text)


def pathological_symbols(spark: SparkSession, n: int, seed: int, handlers: int = 8, length: int = 400, depth: int = 64, dirs: int = 9) -> DataFrame:
    """Names that only a paste makes, one of length characters, and one below depth nested scopes."""
    s = F.col("id").cast("string")
    pasted = F.concat(F.lit("#define CS_MK_HANDLER(id) int patho"), s, F.lit("_handler_##id(int x) { return x + (id); }\n" + "".join(f"CS_MK_HANDLER({k})\n" for k in range(handlers))))
    rest = F.concat(F.lit("int patho"), s, F.lit("_" + "z" * length + "(int a) { return a; }\nint patho"), s, F.lit("_deep(int x) {\n" + "if(x){" * depth + "x++;" + "}" * depth + "\n    return x;\n}"))
    return files(spark.range(n), F.concat(placed(seed, F.col("id"), dirs), F.lit("/patho_"), s, F.lit(".c")), F.concat(pasted, rest))


def unresolved_includes(spark: SparkSession, n: int, seed: int, dirs: int = 9) -> DataFrame:
    """Calls behind a macro that only a header defines which nowhere exists."""
    s = F.col("id").cast("string")
    text = F.concat(F.lit('#include "VENDOR_missing_'), s, F.lit('.h"\nint vendor_gated(int x);\n#ifdef VENDOR_OK\nint use_vendor_'), s, F.lit("(int x) {\n    return vendor_gated(x + "), s, F.lit(");\n}\n#endif"))
    return files(spark.range(n), F.concat(placed(seed, F.col("id"), dirs), F.lit("/unres_"), s, F.lit(".c")), text)


def tiny_files(spark: SparkSession, n: int, seed: int, dirs: int = 9) -> DataFrame:
    rows = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda r: F.concat(r.cast("string"), F.lit(",item_"), r.cast("string"), F.lit(","), F.pmod(F.xxhash64(F.lit(seed), "id", r), F.lit(1 << 31)).cast("string"), F.lit(",2026-09-24\n"))), "")
    return files(spark.range(n), F.concat(placed(seed, F.col("id"), dirs), F.lit("/data_"), F.col("id").cast("string"), F.lit(".csv")), F.concat(F.lit("id,name,value,ts\n"), rows))


def blobs(spark: SparkSession, n: int, seed: int, rows: int = 2000, dirs: int = 9) -> DataFrame:
    """Arrays of digits in C."""
    data = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(rows)), lambda r: F.concat(F.pmod(F.xxhash64(F.lit(seed), "id", r), F.lit(10**15)).cast("string"), F.lit(",\n"))), "")
    return files(spark.range(n), F.concat(placed(seed, F.col("id"), dirs), F.lit("/blob_"), F.col("id").cast("string"), F.lit(".c")), F.concat(F.lit("static const long long blob[] = {\n"), data, F.lit("};\n")))


def ordinary_headers(spark: SparkSession, n: int, seed: int, dirs: int = 9) -> DataFrame:
    s = F.col("id").cast("string")
    text = F.concat(F.lit("#ifndef HDR_"), s, F.lit("_H\n#define HDR_"), s, F.lit("_H\nextern int hdr_value_"), s, F.lit(";\n#endif\n"))
    return files(spark.range(n), F.concat(placed(seed, F.col("id"), dirs), F.lit("/hdr_"), s, F.lit(".h")), text)


# ---- content by class ----

WORDS = "the quick brown fox jumps over a lazy dog while many people watch from their windows".split()
#: Least sizes at which text of a class still reads as that class.
LEAST = {"generic-code": 300, "inline-function-heavy": 200, "minified-longline": 100_001}


def synthesized(label: str, size: int, stream: Stream) -> bytes:
    """About size bytes that classify as label; templates come out as inline functions."""
    if label == "binary":
        return bytes(stream.below(256) | (0x80 if k % 2 else 0) for k in range(size))
    size = max(size, LEAST.get(label, 0))
    unit = {
        "preprocessor-dense": lambda n: f"#define CS_R{n}_ADDR 0x{4 * n:08x}\n#define CS_R{n}_MSK 0x000000ff\n",
        "inline-function-heavy": lambda n: f"static int cs_fn{n}(int x){{int a=x;a+=x*3;return a;}}\n",
        "template-metaprogramming": lambda n: f"static int cs_fn{n}(int x){{int a=x;a+=x*3;return a;}}\n",
        "enum-struct-table": lambda n: f"enum CsE{n} {{ CS_A{n}, CS_B{n} }};\nstruct CsS{n} {{ int a; int b; }};\n",
        "x-macro": lambda n: f'CS_ITEM({n}, 0x{n:08x}, "e")\n',
        "tabular-data": lambda n: f"col_a_{n},col_b_{n},col_c_{n},val_{n}\n",
        "minified-longline": lambda n: f"a{n}=b{n};",
        "data-blob-high-entropy": lambda n: str(stream.below(10)) + ("," if n % 4 == 3 else "") + (" " if n % 8 == 7 else "") + ("\n" if n % 64 == 63 else ""),
        "data-blob-repetitive": lambda n: "0," + ("\n" if n % 64 == 63 else ""),
        "text": lambda n: WORDS[stream.below(len(WORDS))] + ("\n" if n % 12 == 11 else " "),
        "generic-code": lambda n: f"/* unit {n} */\nint compute{n}(int x){{ return x + {n}; }}\n" + "".join(f"static const int pad{n}_{k} = {k};\n" for k in range(30)),
    }[label]
    parts, total, n = [], 0, 0
    while total < size:
        parts.append(unit(n))
        total += len(parts[-1])
        n += 1
    return "".join(parts).encode() + b"\n" * (label == "minified-longline")


def from_archetypes(archetypes: DataFrame, seed: int) -> DataFrame:
    """Files (path, content) for archetypes (label, ext, count, class, p50, p90, max): sizes drawn in bands, content by
    class. Each file draws from the stream of its archetype and number."""
    numbered = archetypes.select("label", "ext", "class", "p50", "p90", "max", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("i"), F.pmod(F.xxhash64("label", "ext"), F.lit(1 << 31)).alias("a")).where("i >= 0")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                stream = Stream(seed, CATEGORIES["ProfileGen"], (r["a"] << 32) + r["i"])
                rows.append((f"{r['label']}/f{r['i']}{r['ext'] if r['ext'].startswith('.') else ''}", synthesized(r["class"], stream.size(r["p50"], r["p90"], r["max"]), stream)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.binary())], names=["path", "content"])

    return numbered.mapInArrow(run, FILES)


def directories_by_weight(dirs: DataFrame, picks: DataFrame) -> DataFrame:
    """(id, dir): picks (id, draw: 32 random bits) fall to dirs (dir, weight) in proportion to their weight."""
    return weighted_picks(picks, dirs, "id", "dir")


def class_references(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """(symbol, site) of every whole word in lines (path, n, content), outside comments and literals, that names a class (name, symbol,
    def_site), but for its definition."""
    words = names_outside(lines).select("path", "n", "name")
    site = F.concat_ws(":", "path", F.col("n").cast("string"))
    return words.join(classes, "name").select("symbol", site.alias("site"), "def_site").where("site <> def_site").select("symbol", "site").distinct()


def compile_db(units: list[str], root: str, dirs: list[str]) -> str:
    """A compile database of units with include directories below root."""
    flags = " ".join(f"-I{root}/{d}" for d in dirs)
    return json.dumps([{"directory": root, "file": u, "command": f"clang {flags} -c {u}"} for u in units], indent=1)


def rebased(text: str, old: str, new: str) -> str:
    """A compile database of a copy of the tree: its root path replaced wherever it stands as a whole path."""
    import re

    return re.sub(re.escape(old) + r'(?=["/\s]|$)', lambda _: new, text)


BARE = {"giant-headers": 0, "big-headers": 0, "med-headers": 0, "ordinary-headers": 0, "tiny-files": 0, "blob-files": 0, "cfiles": 2}
#: Presets and the knobs they stand for; knobs given outright win. Those of the include web and of firmware
#: name populations that are not generated here.
PRESETS = {
    "ci": {"scale": 0.01},
    "memory": BARE | {"giant-headers": 1, "cfiles": 5, "macro-density": 1_000_000},
    "dense-band": BARE | {"dense-headers": 40, "dense-under-mb": 127},
    "broad-token": BARE | {"broad-token-files": 200, "hot-token-share": 0.5},
    "long-lines": BARE | {"long-line-files": 8, "max-line-bytes": 8_388_608},
    "encoding-mix": BARE | {"encoding-mix": 40},
    "many-tiny": {k: v for k, v in BARE.items() if k != "tiny-files"} | {"tiny-files": 500_000},
    "pathological-symbols": BARE | {"pathological-symbols": 50},
    "dup-content": BARE | {"dup-groups": 200, "dup-copies": 4},
    "huge": {"scale": 1.0, "giant-headers": 12, "max-header-mb": 1229, "big-headers": 1375},
    "huge-lite": {"scale": 0.05, "giant-headers": 3, "max-header-mb": 32, "big-headers": 1, "med-headers": 12},
    "firmware": BARE | {"firmware": True},
    "firmware-multi": BARE | {"firmware": True, "fw-targets": 3},
    "firmware-bulk": BARE | {"firmware": True, "fw-bulk": True, "fw-families": 192, "fw-pasters": 20_000, "fw-files": 296, "fw-big-headers": 1, "fw-dense-headers": 0},
}


def expand_preset(name: str, explicit: dict | None = None) -> dict:
    return PRESETS[name.lower()] | (explicit or {})
