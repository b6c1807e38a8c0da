"""Secret scanning with corpus-wide ownership frequency.

One pass over the texts finds the base spans (kinds assign, access, hex) and, beside them, whole runs of the
credential alphabet that mix letters and digits. Values leave the task as 128-bit hashes only. The hashes
are aggregated over the corpus by distinct owners and repositories:

* ``example``: seen with at least ``example_owners`` owners or ``example_repos`` repositories; widely copied.
* ``live``: otherwise, varied enough to be a key (entropy and character mix) and not a placeholder.
* ``weak``: the rest.

The method adds spans of kind ``reuse``: bare runs, outside base spans, whose hash is that of a live base value
elsewhere in the corpus; a key pasted without its context is found through its owner's other uses. Base spans
stay whatever their class; classes are counted in further columns.

Skew: a hash copied into a third of all documents is aggregated map-side by (hash, owner) and (hash,
repository) before anything meets by hash; occurrences join the classes in a join that Spark may split.

Defined results: null and empty texts have no spans and the hash of an empty string; null owners and
repositories count as one owner or repository; repeated rows are answered one by one; positions are code
points, end exclusive, in whole texts of any length; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_batches, written

KINDS = ("assign", "access", "hex", "reuse")
# Fixed patterns of the base kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BARE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your[_-]?(key|token|secret|password)|x{6,}|0{8,}|1234567", re.IGNORECASE)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base kinds, by start then kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in sorted(spans))


def live_looking(value: str) -> bool:
    """Long and varied enough to be a key, and no placeholder."""
    if len(value) < 16 or PLACEHOLDER.search(value):
        return False
    counts = Counter(value)
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    return entropy >= 3.0 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def _hash(value: str) -> bytes:
    return hashlib.blake2b(value.encode(), digest_size=16).digest()


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.binary()), ("strong", pa.bool_())])
FOUND = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("owner", pa.string()), ("repo", pa.string()), ("spans", pa.list_(SPAN))])


def _scan(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part, spans = batch.slice(start, 1000), []
            for t in part.column(4):
                text, row, at, bare = t.as_py() or "", [], 0, []
                base = base_spans(text)
                for s, k, e, v in base:
                    row.append({"kind": k, "start": s, "end": e, "hash": _hash(v), "strong": live_looking(v)})
                if any(c.isdigit() for c in text):
                    bare = [m for m in BARE.finditer(text) if live_looking(m[0])]
                for m in bare:
                    while at < len(base) and base[at][2] <= m.start():
                        at += 1
                    if not any(s < m.end() and e > m.start() for s, _, e, _ in base[at : at + 4]):
                        row.append({"kind": 3, "start": m.start(), "end": m.end(), "hash": _hash(m[0]), "strong": True})
                spans.append(row)
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(spans, pa.list_(SPAN))], schema=FOUND)


def ownership(uses: DataFrame, example_owners: int, example_repos: int) -> DataFrame:
    """(hash, owners, repos, uses, class) over the base candidates of the corpus."""
    by_owner = uses.groupBy("hash", "owner").agg(F.count("*").alias("uses"), F.max("strong").alias("strong")).groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("uses").alias("uses"), F.max("strong").alias("strong")
    )
    by_repo = uses.groupBy("hash", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("repos"))
    kind = F.when((F.col("owners") >= example_owners) | (F.col("repos") >= example_repos), "example").when(F.col("strong"), "live").otherwise("weak")
    return by_owner.join(by_repo, "hash").select("hash", "owners", "repos", "uses", kind.alias("class"))


def _digest(batches):
    schema = pa.schema([("id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("n_live", pa.int64()), ("n_example", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
    for batch in batches:
        out = []
        for doc_id, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            spans = [(x["start"], x["kind"], x["end"], x["class"]) for x in spans or []]
            counts = Counter(x[1] for x in spans)
            classes = Counter(x[3] for x in spans)
            base = joined([x for x in spans if x[1] < 3])
            out.append(
                {"id": doc_id, **{f"n_{k}": counts[i] for i, k in enumerate(KINDS)}, "n_live": classes["live"], "n_example": classes["example"],
                 "base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": joined(spans)}
            )
        yield pa.RecordBatch.from_pylist(out, schema)


def owned_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id",
    example_owners: int = 4, example_repos: int = 12,
) -> DataFrame:
    """A row for each document: id, n_assign, n_access, n_hex, n_reuse, n_live, n_example, base_sha256, spans."""
    text_batches(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col).cast("string").alias("repo"), F.col(text_col).alias("text"),
    )
    schema = "row long, id long, owner string, repo string, spans array<struct<kind: int, start: int, end: int, hash: binary, strong: boolean>>"
    found = written(rows.mapInArrow(_scan, schema), "p4-found")
    uses = found.select("row", "id", "owner", "repo", F.explode("spans").alias("s")).select("row", "id", "owner", "repo", "s.*")
    classes = ownership(uses.where("kind < 3"), example_owners, example_repos)
    rated = uses.select("row", "kind", "start", "end", "hash").join(classes.select("hash", "class"), "hash", "left")
    rated = rated.where("kind < 3 or class = 'live'")
    by_row = rated.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "class")).alias("spans"))  # a document's own spans
    with_any = found.where(F.size("spans") > 0).select("row", "id").join(by_row, "row", "left").select("id", "spans")
    without = found.where(F.size("spans") == 0).select("id", F.lit(None).cast(with_any.schema["spans"].dataType).alias("spans"))
    out = with_any.unionByName(without).mapInArrow(
        _digest, "id long, n_assign long, n_access long, n_hex long, n_reuse long, n_live long, n_example long, base_sha256 string, spans string"
    )
    return out.withColumnRenamed("id", id_col)


def op4_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
