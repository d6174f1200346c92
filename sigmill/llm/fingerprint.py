"""Document fingerprints from content-defined chunks.

A gear hash over the last 32 bytes marks places where a text may be cut. Cuts
are normalised: before the usual size a stricter mask decides, after it a
laxer one, so sizes stay near the usual one and an edit moves only the cuts
next to it. A fingerprint is the set of (digest, length) of the chunks. How far
one text is contained in another is the length of its chunks that the other has
too over the length of all its chunks; two texts are as like as the lesser of
their two containments.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import blocks_for, mix, total_bytes

LEAST, USUAL, MOST = 8, 32, 128
STRICT, LAX = np.uint32(0x7F << 25), np.uint32(0x7 << 29)
GEAR64 = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
GEAR32 = (GEAR64 >> np.uint64(32)).astype(np.uint32)
PRIME = 0x9E3779B97F4A7C15
INVERSE = pow(PRIME, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.multiply.accumulate(x)


_tables = [powers(PRIME, 1 << 12), powers(INVERSE, 1 << 12)]


def _powers(n: int):
    if n > len(_tables[0]):
        _tables[:] = [powers(PRIME, 2 * n), powers(INVERSE, 2 * n)]
    return _tables


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of some bytes."""
    n = len(data)
    h = GEAR32[data]
    for k in (1, 2, 4, 8, 16):
        if n > k:
            shifted = h.copy()
            shifted[k:] += h[:-k] << np.uint32(k)
            h = shifted
    places = np.flatnonzero((h & LAX) == 0)
    strict = ((h[places] & STRICT) == 0).tolist()
    places = (places + 1).tolist()
    out, start, i, last = [], 0, 0, len(places)
    while n - start > LEAST:
        end = min(start + MOST, n)
        while i < last and places[i] < start + LEAST:
            i += 1
        while i < last and places[i] < end:
            if strict[i] or places[i] - start >= USUAL:
                end = places[i]
                break
            i += 1
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def fingerprint(text: str) -> np.ndarray:
    """Sorted distinct chunks, each 48 bits of digest and 16 of length."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    ends = np.array(cuts(data))
    starts = np.concatenate([[0], ends[:-1]])
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(GEAR64[data] * up[: len(data)])])
        digest = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return np.unique(digest << np.uint64(16) | (ends - starts).astype(np.uint64))


def containment(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """How far a is contained in b, and b in a, by length; an empty one is contained in all."""
    low = np.uint64(0xFFFF)
    both = int((np.intersect1d(a, b, assume_unique=True) & low).sum())
    first, second = (both / size if (size := int((x & low).sum())) else 1.0 for x in (a, b))
    return first, second


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The lesser containment; 1 for two empty sets, 0 if one is empty."""
    return min(containment(a, b)) if len(a) and len(b) else float(len(a) == len(b))


def to_text(print_: np.ndarray) -> str:
    return print_.astype(">u8").tobytes().hex()


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 8 << 20) -> DataFrame:
    """(id, text, next_text): every row with the text of the next by id, the last with the first's.

    Rows are dealt into ranges of ids of about `per_bucket` bytes (of up to 16
    times that where there would be over 1024); each range
    gets a copy of the first row of the range after it, so no task sees more
    than a range. Only range borders and first ids go to the driver or through
    one task. Null ids come first; equal ids are ordered by text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = total_bytes(rows)
    n = max(blocks_for(size, 16 * per_bucket), min(blocks_for(size, per_bucket), 1024))
    places = rows.agg(F.percentile_approx("id", [i / n for i in range(n)], 5 * n)).first()[0] if n > 1 else None
    places = places or []
    # Every border is an id, and the least id is none, so no range is empty.
    borders = np.unique(np.array(places[1:], np.int64))
    borders = borders[borders > min(places, default=0)]

    @F.arrow_udf("int")
    def bucket(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(borders, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right").astype(np.int32))

    rows = rows.withColumn("bucket", F.coalesce(bucket("id"), F.lit(0)) if len(borders) else F.lit(0))
    heads = rows.groupBy("bucket").agg(F.min(F.struct("id", "text")).alias("m"))
    before = F.when(F.col("bucket") == 0, len(borders)).otherwise(F.col("bucket") - 1)
    guard = heads.select(F.lit(None).cast("long").alias("id"), "m.text", before.alias("bucket"), F.lit(1).alias("guard"))
    both = rows.withColumn("guard", F.lit(0)).unionByName(guard)
    w = Window.partitionBy("bucket").orderBy("guard", F.col("id").asc_nulls_first(), "text")
    return both.withColumn("next_text", F.lead("text").over(w)).filter(F.col("guard") == 0).select("id", "text", "next_text")


COMPARED = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_edited", "edited_in", "in_next", "next_in")


def _print_batches(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            out = [[] for _ in range(10)]
            held = (None, None)
            for text, following in zip(batch.column("text").to_pylist(), batch.column("next_text").to_pylist(), strict=True):
                own = held[1] if held[0] == text else fingerprint(text)
                held = (following, fingerprint(following))
                changed = edited(text, following)
                other = fingerprint(changed)
                values = (len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), to_text(own), to_text(other), likeness(own, other), likeness(own, held[1]), *containment(own, other), *containment(own, held[1]))
                for column, v in zip(out, values, strict=True):
                    column.append(v)
            kinds = (pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 6)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["id", *COMPARED])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with a fingerprint column added (hex of sorted chunk digests and lengths).

    Null and empty texts have the empty fingerprint; repeated rows and null ids
    are kept; no rows give no rows. A fingerprint column of `docs` is replaced.
    """
    docs = docs.drop("fingerprint")
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            made = [to_text(fingerprint(t or "")) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())]))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint, its edited text's, and likeness to that and to the next row's.

    The edited text has its last quarter replaced by the beginning of the next
    row's text. in_edited is how far the text is contained in its edited text,
    edited_in the reverse; in_next and next_in say the same of the next row's
    text. Nulls, repeated rows and no rows: see `with_next`.
    """
    kinds = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double, edited_in double, in_next double, next_in double"
    return with_next(docs, id_col, text_col).mapInArrow(_print_batches, kinds).withColumnRenamed("id", id_col)


def op9_document_fingerprints(spark, sf_dir):
    from .common import table

    return compare_with_edits(table(spark, sf_dir, "documents"))
