"""Column functions: extensions, bands, buckets, rounding, sites, globs and class predicates. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of sources, and others that are kept wherever they appear.
SOURCE_EXTENSIONS = (".c", ".cc", ".cpp", ".cxx", ".c++", ".h", ".hh", ".hpp", ".hxx", ".h++", ".inl", ".ipp")
KNOWN_EXTENSIONS = (
    *SOURCE_EXTENSIONS,
    ".txt", ".md", ".json", ".xml", ".yml", ".yaml", ".ini", ".cfg", ".cmake", ".mk", ".mak", ".in", ".py",
    ".sh", ".bat", ".cmd", ".ps1", ".pl", ".s", ".asm", ".def", ".rc", ".o", ".obj", ".a", ".lib", ".so",
    ".dll", ".exe", ".pdb", ".d", ".map", ".lst", ".bak", ".log", ".html", ".css", ".js", ".png", ".gif",
    ".jpg", ".ico", ".svg", ".pdf", ".zip", ".gz", ".tar", ".patch", ".diff", ".sln", ".vcxproj",
    ".filters", ".user", ".props", ".targets", ".csv", ".dat", ".bin", ".tmp", ".old", ".orig",
)
#: Size bands with their upper bounds, which belong to the next band.
SIZE_BANDS = (("<1KB", 1 << 10), ("1-10KB", 10 << 10), ("10-100KB", 100 << 10), ("100KB-1MB", 1 << 20), ("1-10MB", 10 << 20), ("10-100MB", 100 << 20), ("100MB-1GB", 1 << 30), (">1GB", None))
#: Bounds of the density bands.
DENSITY_BOUNDS = {"functions_per_kb": (0.5, 2.0), "calls_per_function": (1.0, 5.0), "global_refs": (100.0, 1000.0)}
#: Content classes in the order that breaks ties, with what parsing costs and whether they are source.
CLASSES = {
    "preprocessor-dense": ("cheap", False),
    "inline-function-heavy": ("heavy", True),
    "enum-struct-table": ("heavy", True),
    "x-macro": ("cheap", True),
    "template-metaprogramming": ("heavy", True),
    "tabular-data": ("cheap", False),
    "minified-longline": ("cheap", False),
    "generic-code": ("baseline", True),
    "data-blob-high-entropy": ("cheap", False),
    "data-blob-repetitive": ("cheap", False),
    "text": ("cheap", False),
    "binary": ("cheap", False),
}
#: What each posture lets leave the scan (reads content, keeps exact content statistics).
POSTURES = {"structure-only": (False, False), "class-labeled": (True, False), "content-stats": (True, True)}


def extension(name: Column) -> Column:
    """Normalised extension of a file name."""
    low = F.lower(name)
    ext = F.regexp_extract(low, r"\.[^.]+$", 0)
    return F.when(ext == "", F.lit("(none)")).when(ext == low, F.lit("(dotfile)")).when(ext.rlike(r"^\.[a-z0-9_+-]{1,16}$"), ext).otherwise(F.lit("(other)"))


def size_band(size: Column) -> Column:
    """Number of the size band, 0 to 7."""
    out = None
    for i, (_, bound) in enumerate(SIZE_BANDS[:-1]):
        out = F.when(size < bound, F.lit(i)) if out is None else out.when(size < bound, F.lit(i))
    return out.otherwise(F.lit(len(SIZE_BANDS) - 1))


def band_label(band: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x, _ in SIZE_BANDS]), band + 1)


def count_bucket(n: Column) -> Column:
    """0 to 4 as they are, then 5-16, 17-64, 65+."""
    return F.when(n <= 4, n.cast("string")).when(n <= 16, F.lit("5-16")).when(n <= 64, F.lit("17-64")).otherwise(F.lit("65+"))


def fanout_bucket(n: Column) -> Column:
    return F.when(n <= 4, F.lit("0-4")).when(n <= 16, F.lit("5-16")).when(n <= 64, F.lit("17-64")).otherwise(F.lit("65+"))


def round3(v: Column) -> Column:
    """A count to three significant digits, halves up."""
    out = F.when(v < 1000, v.cast("long"))
    for k in range(1, 16):
        scale = 10**k
        out = out.when(v < 1000 * scale, F.expr("0L") + ((v + scale // 2) - (v + scale // 2) % scale).cast("long"))
    return out.otherwise(v.cast("long"))


def density_band(v: Column, kind: str) -> Column:
    low, high = DENSITY_BOUNDS[kind]
    return F.when(v < low, F.lit("low")).when(v < high, F.lit("med")).otherwise(F.lit("high"))


def class_rank(label: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in CLASSES]), label) - 1


def parse_cost(label: Column) -> Column:
    return F.when(label.isin([c for c, x in CLASSES.items() if x[0] == "heavy"]), "heavy").when(label == "generic-code", "baseline").otherwise("cheap")


def is_parsed_source(label: Column) -> Column:
    return label.isin([c for c, x in CLASSES.items() if x[1]])


def is_target(path: Column, size: Column, target: str, giant_mb: int = 20, markers: tuple[str, ...] = ()) -> Column:
    """Whether a file belongs to a mutation target: source, headers, giant or all; bookkeeping files (the compile
    database at the root, leftovers of an edit, and names in markers) never do."""
    ext, header = F.regexp_extract(F.lower(path), r"\.[^./]+$", 0), [".h", ".hpp", ".hh", ".hxx"]
    wanted = {
        "source": ext.isin(".c", ".cc", ".cpp", ".cxx"),
        "headers": ext.isin(header),
        "giant": size >= giant_mb << 20,
        "all": F.lit(True),
    }[target]
    hidden = (path == "compile_commands.json") | F.regexp_extract(path, "[^/]*$", 0).isin(list(markers)) | path.endswith(".mut.tmp")
    return wanted & ~hidden


def contained(path: Column) -> Column:
    """Whether a relative path stays below its root: not absolute, no drive, never above the root on its way."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda s, x: F.struct((s["d"] + F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1)).alias("d"), F.least(s["low"], s["d"] + F.when(x == "..", -1).otherwise(0)).alias("low")))
    return ~path.rlike(r"^(/|\\|[A-Za-z]:)") & (depth["low"] >= 0)


def folded_path(path: Column) -> Column:
    """A relative path with its . and .. segments worked off, for paths that contained() accepts."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    start = F.array().cast("array<string>")
    kept = F.aggregate(parts, start, lambda s, x: F.when(x == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x))))
    return F.array_join(kept, "/")


def normal_path(path: Column) -> Column:
    """Sort key of a path: slashes only. Spark orders strings by their UTF-8 bytes."""
    return F.translate(path, "\\", "/")


def site_path(site: Column) -> Column:
    return F.regexp_extract(site, r"^(.*):([0-9]+)$", 1)


def site_line(site: Column) -> Column:
    return F.regexp_extract(site, r"^(.*):([0-9]+)$", 2).try_cast("int")


def is_site(site: Column) -> Column:
    """Whether a site is canonical: a relative path with slashes, then a colon and a line from 1 without leading zeros."""
    return site.rlike(r"^[^:\\/][^:\\]*:[1-9][0-9]*$")


def glob_regex(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def glob_match(value: Column, pattern: str) -> Column:
    """* is any run, slashes too; ? is any one character."""
    return value.rlike("(?s)" + glob_regex(pattern))


def spelled_class(name: Column) -> Column:
    """Class by spelling: Z...Z drop, Y...Y open, else keep."""
    wrapped = lambda c: (F.length(name) >= 2) & name.startswith(c) & name.endswith(c)
    return F.when(wrapped("Z"), "drop").when(wrapped("Y"), "open").otherwise("keep")


def spelled_class_for(name: Column, target: int, targets: int) -> Column:
    """Class by spelling in one of several targets: a last part (behind the last colon) that ends in two underscores and a
    letter for each target (K keep, D drop, O open), with something before them, has that target's letter decide; others
    are spelled as for one target."""
    bare = F.substring_index(name, ":", -1)
    letters = F.regexp_extract(bare, f"(?s)^.+__([KDO]{{{targets}}})$", 1)
    letter = F.substring(letters, target + 1, 1)
    return F.when(letter == "K", "keep").when(letter == "D", "drop").when(letter == "O", "open").otherwise(spelled_class(bare))


def include_flags(command: Column) -> Column:
    """The values of a command's -I flags in order; a value may stand apart, and in quotes."""
    found = F.regexp_extract_all(command, F.lit(r'(?<!\S)-I\s*("[^"]*"|\S+)'), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, '^"|"$', ""))


def flipped_to_binary(content: Column) -> Column:
    """Bytes that look binary: a NUL within the first five, and no wide byte-order mark."""
    digits = F.hex(content)
    at = 2 * F.least(F.lit(4), F.octet_length(content) - 1)
    nul = F.concat(F.substr(digits, F.lit(1), at), F.lit("00"), F.substr(digits, at + 3))
    first = F.lpad(F.hex(F.conv(F.substring(nul, 1, 2), 16, 10).cast("int").bitwiseXOR(1)), 2, "0")
    wide = nul.startswith("FFFE") | nul.startswith("FEFF") | nul.startswith("0000FEFF")
    return F.when(F.octet_length(content) > 0, F.unhex(F.when(wide, F.concat(first, F.substr(nul, F.lit(3)))).otherwise(nul))).otherwise(content)


def rebased_path(text: Column | str, old: str, new: str) -> Column:
    """text with the root path old replaced by new wherever it stands as a whole path: before a slash, quote, blank or the end."""
    quoted = "".join("\\" + c if not c.isalnum() and c != "/" else c for c in old)
    return F.regexp_replace(text, quoted + r'(?=["/\s]|$)', new.replace("\\", "\\\\").replace("$", "\\$"))


def effective_count(usual: Column, scale: float, given: Column | None = None, keep_one: Column | None = None) -> Column:
    """A count knob: given as it is, else usual by scale, halves to even; one that is on (above 0) stays so with keep_one."""
    value = usual if given is None else F.coalesce(given, usual)
    scaled = F.bround(usual * scale).cast("long")
    n = scaled if given is None else F.coalesce(given.cast("long"), scaled)
    n = n if keep_one is None else F.when(keep_one, F.greatest(n, F.lit(1).cast("long"))).otherwise(n)
    return F.when(value > 0, n).otherwise(F.lit(0).cast("long"))


def whole_word(text: Column, word: Column, not_after_tilde: bool = False) -> Column:
    """Whether text holds word with no identifier character on either side; not_after_tilde: nor a ~ before it."""
    before = "[A-Za-z0-9_~]" if not_after_tilde else "[A-Za-z0-9_]"
    return F.rlike(text, F.concat(F.lit(f"(?<!{before})\\Q"), word, F.lit("\\E(?![A-Za-z0-9_])")))


def owner_and_last(key: Column) -> tuple[Column, Column, Column]:
    """A qualified name without template arguments, what stands before its last ::, and what after."""
    bare = key
    for _ in range(4):  # arguments nest
        bare = F.regexp_replace(bare, "<[^<>]*>", "")
    last = F.substring_index(bare, "::", -1)
    return bare, F.when(F.instr(bare, "::") > 0, F.regexp_extract(bare, "^(.*)::[^:]*$", 1)).otherwise(""), last
