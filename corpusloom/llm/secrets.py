"""Secret scans with corpus-wide ownership frequency.

Each text gives base spans (assignments, access keys, hexadecimal runs) and further candidates: long tokens of mixed
letters and digits with high entropy. Over the whole corpus, the hash of every candidate's value is aggregated into the
number of distinct owners and repositories that hold it. A value that many owners hold is an example that was copied
about; one that only its owner holds looks live. Base spans always stay; further candidates are added as spans of kind
"token" only where they look live. The live and the copied base spans are counted apart.

Values leave the scan as hashes only. Counting goes over distinct (value, owner, repository) rows, combined before the
shuffle, so that a value that a third of all rows hold costs one row per task and owner. The join back to the documents
brings one row per distinct value; its skewed side is split by adaptive execution.

Defined edge cases: a null or empty text has no spans. A null owner counts as an owner of its own. Repeated rows are
scanned and returned row by row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cover, map_rows, table, written

#: Kinds in their order, and the base patterns with the least length of what counts.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18

#: A further candidate: so many characters of one token, with lower case, upper case and digits, of so many bits each.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
LEAST_BITS = 3.5
#: A value with more distinct owners than this is an example that was copied about.
MAX_OWNERS = 2

Found = tuple[str, int, int, str]


def base_found(text: str) -> list[Found]:
    """(kind, start, end, value) of the base matches, by start, then kind."""
    out = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def entropy(token: str) -> float:
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def further_found(text: str, base: list[Found]) -> list[Found]:
    out, covered = [], Cover((a, b) for _, a, b, _ in base)
    for m in TOKEN.finditer(text):
        t = m[0]
        if any(c.isdigit() for c in t) and t.lower() != t and t.upper() != t and entropy(t) >= LEAST_BITS and not covered.touches(m.start(), m.end()):
            out.append(("token", m.start(), m.end(), t))
    return out


def listed(found: list[Found]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found)


FOUND = "array<struct<kind:string,start:long,end:long,value:binary>>"
SCHEMA = f"doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, base_spans string, found {FOUND}"


def scan_rows(batch: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {c: batch[c] for c in ("doc_id", "owner", "repo")} | {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "base_spans", "found")}
    for text in batch["text"]:
        text = text or ""
        base = base_found(text)
        for kind in KINDS:
            out[f"n_{kind}"].append(sum(x[0] == kind for x in base))
        out["base_spans"].append(listed(base))
        out["base_sha256"].append(hashlib.sha256(out["base_spans"][-1].encode()).hexdigest())
        out["found"].append([{"kind": k, "start": a, "end": b, "value": hashlib.sha256(v.encode()).digest()[:16]} for k, a, b, v in base + further_found(text, base)])
    return out


def ownership(found: DataFrame) -> DataFrame:
    """For each value: n_owners and n_repos, over rows (value, owner, repo) of all the corpus."""
    each = found.select("value", F.coalesce("owner", F.lit("\0null")).alias("owner"), F.coalesce("repo", F.lit("\0null")).alias("repo")).distinct()
    by_owner = each.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def scan_secrets(docs: DataFrame, owner: str = "source", repo: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """A row for each row of docs (doc_id, text, and the columns named by owner and repo)."""
    source = docs.select(F.col("doc_id").cast("long"), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"), "text")
    scanned = written(map_rows(source, scan_rows, SCHEMA).withColumn("row", F.expr("uuid()")), "secrets")
    held = scanned.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("x")).select("row", "owner", "repo", "x.*")
    marked = held.join(ownership(held), "value").withColumn("live", F.col("n_owners") <= max_owners)
    order = F.when(F.col("kind") == "assign", 0).when(F.col("kind") == "access", 1).when(F.col("kind") == "hex", 2).otherwise(3)
    per_row = marked.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") != "token") | F.col("live"), F.struct("start", order.alias("rank"), "end", "kind")))).alias("all"),
        F.count_if((F.col("kind") != "token") & F.col("live")).alias("n_live"),
        F.count_if((F.col("kind") != "token") & ~F.col("live")).alias("n_copied"),
        F.count_if((F.col("kind") == "token") & F.col("live")).alias("n_token"),
        F.max("n_owners").alias("most_owners"),
    )
    spans = F.array_join(F.transform("all", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return scanned.join(per_row, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(spans, F.lit("")).alias("spans"), zero("n_live"), zero("n_copied"), zero("n_token"), zero("most_owners")
    )


def op9_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
