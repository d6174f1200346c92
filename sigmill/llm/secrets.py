"""Secret scans with corpus-wide ownership frequency.

A scan of each text finds candidates; the hash of every candidate's value is
then counted over the corpus by distinct repositories and owners. A value that
many owners share is a copied example; one that a single owner has looks live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("assign", "access", "hex", "owner")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What may be a key without saying so: long, unbroken, of letters and digits.
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIN_ENTROPY = 3.5

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())])


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def scan(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base kinds and of opaque strings outside them."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    taken = sorted((s, e) for _, s, e, _ in found)
    i = 0
    for m in OPAQUE.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i < len(taken) and taken[i][0] < m.end():
            continue
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= MIN_ENTROPY:
            found.append(("owner", m.start(), m.end(), v))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _scan_batches(batches):
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            found = scan(text.as_py() or "")
            rows.append([{"kind": k, "start": s, "end": e, "hash": hashlib.sha1(v.encode("utf-8", "replace")).hexdigest()} for k, s, e, v in found])
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("owner"), batch.column("repo"), pa.array(rows, pa.list_(SPAN))], ["row", "id", "owner", "repo", "spans"])


def ownership_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_cols: tuple[str, ...] = ("source",),
    repo_cols: tuple[str, ...] = ("source", "lang"),
    max_owners: int = 1,
    copied_owners: int = 3,
) -> DataFrame:
    """One row per input row: id, spans.

    spans: array of kind, start, end (code points, end exclusive), hash of the
    value, n_owners, n_repos, n_docs (rows of the corpus that hold the value)
    and verdict: "live" up to `max_owners` owners, "copied" from
    `copied_owners`, else "shared". Spans of kind "owner" are opaque strings
    that only their verdict "live" makes secrets; others are left out.

    Null texts count as empty; a null owner is an owner of its own; null ids
    and repeated rows are kept as they are; no rows give no rows. Other columns
    are not read. Copied values are counted per (hash, owner, repo) before they
    meet, so a value that a third of all rows hold is a few rows by then; spans
    go back to their frequency by a join whose hot values are split.
    """
    key = lambda cols: F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols]))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), key(owner_cols).alias("owner"), key(repo_cols).alias("repo")
    )
    scanned = cut(rows.mapInArrow(_scan_batches, "row long, id long, owner string, repo string, spans array<struct<kind:string,start:long,end:long,hash:string>>"))
    each = scanned.select("row", "owner", "repo", F.explode("spans").alias("s")).select("row", "owner", "repo", "s.*")
    by_repo = each.dropDuplicates(["row", "hash"]).groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    # Written before it is joined, so that the adaptive skew join can part the spans of a hot value.
    freq = cut(by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_docs")))
    verdict = F.when(F.col("n_owners") <= max_owners, "live").when(F.col("n_owners") >= copied_owners, "copied").otherwise("shared")
    judged = each.join(freq, "hash").withColumn("verdict", verdict).filter((F.col("kind") != "owner") | (F.col("verdict") == "live"))
    span = F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("order"), "kind", "end", "hash", "n_owners", "n_repos", "n_docs", "verdict")
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    joined = scanned.select("row", "id").join(spans, "row", "left")
    typed = "array<struct<start:bigint,order:bigint,kind:string,end:bigint,hash:string,n_owners:bigint,n_repos:bigint,n_docs:bigint,verdict:string>>"
    return joined.select(F.col("id").alias(id_col), F.coalesce("spans", F.array().cast(typed)).alias("spans"))


def span_text(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_secret_scans(spark, sf_dir):
    from .common import table

    found = ownership_scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "owner")

    def count(field, value):
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")

    return found.select(
        "doc_id",
        *[count("kind", k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        *[count("verdict", v).alias(f"n_{v}") for v in ("live", "shared", "copied")],
    )


def redacted(text: str, spans: list[dict]) -> str:
    """The text with [SECRET] for each span; of overlapping ones, one for all."""
    parts, at = [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        if s["end"] <= at:
            continue
        parts += [text[at : max(at, s["start"])], "[SECRET]" if s["start"] >= at else ""]
        at = s["end"]
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **scan_args) -> DataFrame:
    """`docs` with each secret that is not a widely copied example replaced by [SECRET].

    Rows meet their spans by a 64-bit hash of id and text, which alone decide
    them: repeated rows, ids of several texts and null ids are redacted like
    others, one row for one. Rows with a null text or no secret stay as they
    are; other columns, whatever their names, too; no rows give no rows.
    """
    columns = docs.columns
    at = columns.index(text_col)
    # Names of its own for the way, so that none of the columns' can clash.
    keyed = docs.toDF(*[f"c{i}" for i in range(len(columns))]).withColumn("key", F.xxhash64(F.col(f"c{columns.index(id_col)}"), F.col(f"c{at}")))
    owners = scan_args.pop("owner_cols", ("source",)), scan_args.pop("repo_cols", ("source", "lang"))
    owners = [tuple(f"c{columns.index(c)}" for c in cols) for cols in owners]
    spans = ownership_scan(keyed, "key", f"c{at}", *owners, **scan_args)
    cuts = F.transform(F.filter("spans", lambda s: s["verdict"] != "copied"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    spans = cut(spans.select("key", cuts.alias("cuts")).filter(F.size("cuts") > 0).groupBy("key").agg(F.first("cuts").alias("cuts")))

    def run(batches):
        for batch in batches:
            made = [redacted(t, c) if t and c else t for t, c in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(made, pa.string())).drop_columns(["cuts"])

    joined = keyed.join(spans, "key", "left").drop("key")
    return joined.mapInArrow(run, joined.drop("cuts").schema).toDF(*columns)
