"""MinHash near-duplicates with b-bit signatures.

Texts with one set of word shingles are one class from the start. Classes meet
in bands of minima; pairs that meet are first compared by their signatures, the
low bits of every minimum packed into longs, whose equal lanes estimate the
similarity once chance equality is taken off. What may reach the threshold is
confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import coded, cut, gram_hashes, mix
from .graph import components

ROWS, BANDS, BITS = 4, 24, 2
HASHES = ROWS * BANDS
LONGS = HASHES * BITS // 64
ODD = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
ADD = mix(np.arange(1001, HASHES + 1001, dtype=np.uint64))
#: Buckets up to this size compare all pairs; larger ones go by leaders, and then across components.
SMALL, LEADERS = 16, 2
#: Texts on either side of one cell of the comparison across components.
CELL = 500
LANES = 0x5555555555555555


def shingle_sets(texts: pa.Array | pa.ChunkedArray, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of n words, or of the whole if it is shorter."""
    for _, counts, codes in coded(texts, lower=True):
        grams, end = gram_hashes(codes, n), np.cumsum(counts).tolist()
        for hi, size in zip(end, counts.tolist(), strict=True):
            if size >= n:
                yield np.unique(grams[hi - size : hi - n + 1])
            else:
                yield gram_hashes(codes[hi - size : hi], size) ^ np.uint64(size)


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 2048):
            x = s[at : at + 2048, None] * ODD + ADD
            np.minimum(out, x.min(0), out=out)
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """The low bits of every minimum, as signed longs."""
    lanes = (mix(m) & np.uint64((1 << BITS) - 1)).reshape(LONGS, -1)
    shift = (np.arange(lanes.shape[1]) * BITS).astype(np.uint64)
    return np.bitwise_or.reduce(lanes << shift, axis=1).view(np.int64)


def bands(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.arange(1, BANDS + 1, dtype=np.uint64)
        for column in m.reshape(BANDS, ROWS).T:
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + column)
    return x.view(np.int64)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(row, id, n_shingles, key, sig, bands) of every row of (row, id, text); key is null for empty sets."""

    def run(batches):
        for batch in batches:
            size, keys, sigs, all_bands = [], [], [], []
            for s in shingle_sets(batch.column("text"), n):
                size.append(len(s))
                if len(s):
                    m = minima(s)
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
                    sigs.append(packed(m))
                    all_bands.append(bands(m))
                else:
                    keys.append(None), sigs.append([]), all_bands.append([])
            long_list = pa.list_(pa.int64())
            columns = [batch.column("row"), batch.column("id"), pa.array(size, pa.int64()), pa.array(keys, pa.string()), pa.array(sigs, long_list), pa.array(all_bands, long_list)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "n_shingles", "key", "sig", "bands"])

    return docs.mapInArrow(run, "row long, id long, n_shingles long, key string, sig array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two signatures: the share of equal lanes less what chance makes equal."""

    def unequal(i):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LANES)))

    equal = F.lit(1.0) - reduce(lambda p, q: p + q, [unequal(i) for i in range(LONGS)]) / HASHES
    chance = 1 / 2**BITS
    return (equal - chance) / (1 - chance)


def least_estimate(percent: int, deviations: float = 4.5) -> float:
    """What a pair at the threshold falls below about once in 300,000 times."""
    chance = 1 / 2**BITS
    p = percent / 100 * (1 - chance) + chance
    return (p - deviations * math.sqrt(p * (1 - p) / HASHES) - chance) / (1 - chance)


def confirm(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 x shared shingles reach percent x all shingles."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sides = []
                for c in ("a", "b"):
                    _, first, own = np.unique(batch.column(c).to_numpy(), return_index=True, return_inverse=True)
                    sets = list(shingle_sets(batch.column(f"text_{c}").take(pa.array(first)), n))
                    sides.append([sets[i] for i in own])
                keep = []
                for x, y in zip(*sides, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    named = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def links_between(classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that connect all classes (id, sig, bands) as all links would."""
    members = cut(classes.select("id", "sig", F.explode("bands").alias("band")))
    leader = [F.min_by("id", F.xxhash64("id", F.lit(i))).alias(f"l{i}") for i in range(LEADERS)]
    buckets = members.groupBy("band").agg(F.count("*").alias("size"), *leader).filter("size > 1")
    placed = cut(members.join(buckets, "band"))
    ordered = lambda df: df.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    small = placed.filter(F.col("size") <= SMALL).select("band", "id", "sig")
    other = small.select("band", F.col("id").alias("y"), F.col("sig").alias("sig_y"))
    meets = estimate(F.col("sig"), F.col("sig_y")) >= least_estimate(percent)
    pairs = small.join(other, (small["band"] == other["band"]) & (F.col("id") < F.col("y")) & meets).select(F.col("id").alias("x"), "y")
    large = placed.filter(F.col("size") > SMALL)
    stars = large.select(F.col("id").alias("x"), F.explode(F.array(*[f"l{i}" for i in range(LEADERS)])).alias("y"))
    pairs = cut(ordered(pairs.union(stars)))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(large.select("id")).distinct()
    texts = cut(docs.select(F.col("row").alias("id"), "text").join(ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))
    links = cut(confirm(pairs, texts, n, percent))
    # Leaders may split a large bucket: what is left apart is compared with all of the bucket.
    found = components(links)
    parts = cut(large.select("band", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")))
    main = parts.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"))
    apart = cut(parts.join(main.filter("parts > 1").select("band", "main"), "band").select("main", "id", "component").distinct())
    return links.union(across(apart, texts, n, percent))


def cells(ids: DataFrame, here: str, there: str, sizes: DataFrame) -> DataFrame:
    """Each id in the cells of its part: its own row or column of the grid of its main component, all across it."""
    own = F.pmod(F.xxhash64("id"), F.ceil(F.col(f"n_{here}") / CELL)).cast("int").alias(here)
    all_across = F.explode(F.sequence(F.lit(0), F.ceil(F.col(f"n_{there}") / CELL).cast("int") - 1)).alias(there)
    return ids.join(sizes, "main").select("main", "id", "component", own, all_across)


def across(apart: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) of ids outside their bucket's main component (main, id, component) with any id met in such buckets.

    Both sides are dealt into cells of about CELL x CELL texts; a cell counts
    shared shingles by an index of one side, and gives each text one link at
    most per component of the other.
    """
    outside = apart.filter("component != main")
    sizes = apart.groupBy("main").agg(F.count("*").alias("n_y"), F.count(F.when(F.col("component") != F.col("main"), 1)).alias("n_x"))
    y = cells(apart, "y", "x", sizes).join(texts, "id").select("main", "x", "y", "id", "component", "text")
    x = cells(outside, "x", "y", sizes).join(texts, "id").select("main", "x", "y", "id", "component", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if left.num_rows and right.num_rows:
            ids, part = left.column("id").to_numpy(), left.column("component").to_numpy()
            sets = list(shingle_sets(left.column("text"), n))
            size = np.array([len(s) for s in sets])
            values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            for i, c, s in zip(right.column("id").to_pylist(), right.column("component").to_pylist(), shingle_sets(right.column("text"), n), strict=True):
                lo = np.searchsorted(values, s, "left")
                count = np.searchsorted(values, s, "right") - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                both = np.bincount(owner[at], minlength=len(sets))
                hit = np.flatnonzero((100 * both >= percent * (len(s) + size - both)) & (part != c))
                for k in np.unique(part[hit], return_index=True)[1]:
                    j = int(ids[hit[k]])
                    out_a.append(min(i, j))
                    out_b.append(max(i, j))
        return pa.table([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], schema=schema)

    keys = ["main", "x", "y"]
    x = x.select(*[F.col(c).alias(c) for c in x.columns])  # names of its own: both sides come from one table
    return y.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id reachable by links), kept.

    Two texts are linked if they share `percent` of their distinct shingles of
    `n_words` lower-cased words (Jaccard). A text shorter than that is one
    shingle; null and empty texts have none and are linked with nothing. Rows of
    one id belong together whatever their texts. Rows with a null id are a
    component of their own, null, and kept. No rows give no rows; other columns
    are not read.

    Rows are told apart by a 64-bit hash of id and text. A pair at the threshold misses all 24 bands about 3 times in a million.
    Equal sets are folded before any pairing; of a large bucket only leaders
    are paired with all members, and then only what remains apart.
    """
    rows = docs.select(F.xxhash64(F.col(id_col).cast("long"), text_col).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut(signatures(rows, n_words))
    # A class is named by one of its rows, so that every text of it is confirmed as itself, whatever ids share it.
    classes = cut(signed.filter("key is not null and id is not null").groupBy("key").agg(F.min("row").alias("id"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    links = links_between(classes.select("id", "sig", "bands"), rows, n_words, percent)
    # Rows without words are linked by their id alone.
    named = signed.join(classes.select("key", F.col("id").alias("class")), "key", "left").select("id", "n_shingles", F.coalesce("class", F.xxhash64("id", F.lit("no words"))).alias("class"))
    named = cut(named)
    owned = named.filter("id is not null").groupBy("id", "class").count().drop("count")
    several = cut(owned.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a != b").select("id", "a"))
    repeated = owned.join(several, "id").select("a", F.col("class").alias("b"))
    found = cut(components(links.union(repeated)).select(F.col("id").alias("class"), F.col("component").alias("label")))
    labelled = owned.join(found, "class", "left").withColumn("label", F.coalesce("label", "class"))
    # Counted by id and class before, so that copies of one text meet as partial least ids.
    least = cut(labelled.groupBy("label").agg(F.min("id").alias("component_id")))
    of_class = cut(found.join(least, "label").select("class", "component_id").union(least.join(found, least["label"] == found["class"], "left_anti").select(F.col("label").alias("class"), "component_id")))
    out = named.filter("id is not null").join(of_class, "class", "left").select("id", "n_shingles", "component_id")
    out = out.union(named.filter("id is null").select("id", "n_shingles", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_minhash_near_dedup(spark, sf_dir):
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"), n_words=4, percent=80)
