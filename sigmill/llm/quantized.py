"""Embedding near-duplicates by product quantisation.

Equal vectors are one class from the start. A bounded sample of the classes
fits a coarse quantiser and, on what it leaves over, one codebook for each
slice of the dimensions; then every class is put in the inverted list of its
nearest centroid with its residual codes. A class visits the lists in which a
vector at the least cosine can lie: how far down the ranking of the lists that
goes is measured on neighbours simulated at just that cosine. In a list a
table of the query's products with all codewords gives the distance to each
coded vector, and the stored coding error makes of it a bound that no linked
vector exceeds. What stays is settled by its cosine in double precision.

A crowd of near copies is an inverted list of its own, around its middle, if
all of it is so close to the middle that any two of its vectors are linked:
they needn't be compared with one another, only with vectors of other lists.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .graph import components
from .vectors import matrix, named, width

#: Bytes of doubles of the sample that the index is fitted on: 65,536 vectors of 64 dimensions.
SAMPLE_BYTES = 32 << 20
#: Dimensions of a slice, codewords of a codebook, and residuals that fit a codebook.
SLICE, WORDS, CODED = 4, 256, 16_384
#: Share of simulated neighbours at the least cosine whose list is visited.
RECALL = 0.999
#: A crowd is at least this share of the sample, and so many vectors of it.
CROWD, CROWD_LEAST = 1 / 256, 32
#: Vectors of either side of one comparison, and queries whose tables are held at once.
BLOCK, TABLES = 4096, 128
SLACK = 1e-4


@dataclass(frozen=True)
class Index:
    """Centroids of the lists, then the middles of the crowds; codebooks (slice, word, dimension in slice); how far behind its best list a query looks."""

    centroids: np.ndarray
    crowds: np.ndarray
    books: np.ndarray
    margin: float
    cosine: float

    @property
    def angle(self) -> float:
        return math.acos(self.cosine)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows divided by their length, whatever its magnitude; zero rows stay."""
    most = np.abs(v).max(1, initial=0, keepdims=True)
    v = v / np.where(most > 0, most, 1)
    size = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    return v / np.where(size > 0, size, 1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centroid."""
    half = np.einsum("ij,ij->i", centroids, centroids) / 2
    return np.concatenate([(x[at : at + 4096] @ centroids.T - half).argmax(1) for at in range(0, len(x), 4096)]) if len(x) else np.empty(0, int)


def means(x: np.ndarray, k: int, rounds: int, random: np.random.Generator) -> np.ndarray:
    """At most k centroids by Lloyd's rounds, begun at rows of `x`; one that loses all its rows stays where it is."""
    centroids = x[random.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centroids)
        order = np.argsort(own, kind="stable")
        number, first = np.unique(own[order], return_index=True)
        centroids[number] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return centroids


def sliced(x: np.ndarray) -> np.ndarray:
    """(slice, row, dimension in slice), filled up with zeros."""
    d = x.shape[1]
    return np.pad(x, ((0, 0), (0, -d % SLICE))).reshape(len(x), -1, SLICE).transpose(1, 0, 2)


def crowds(x: np.ndarray, own: np.ndarray, angle: float, random: np.random.Generator) -> np.ndarray:
    """Middles of balls of half the link angle that hold a large share of the sample, found list by list.

    Those missed are compared like all others: this only saves work.
    """
    least, reach = max(CROWD_LEAST, CROWD * len(x)), math.cos(angle / 2)
    out = []
    for number, count in zip(*np.unique(own, return_counts=True), strict=True):
        rest = x[own == number] if count >= least else x[:0]
        while len(rest) >= least:
            tried = rest[random.permutation(len(rest))[:256]]
            middle = tried[(tried @ rest.T >= reach).sum(1).argmax()]
            for _ in range(3):
                inside = rest @ middle >= reach
                if not inside.any():
                    break
                middle = unit(rest[inside].mean(0)[None])[0]
            inside = rest @ middle >= reach
            if inside.sum() < least:
                break
            out.append(middle)
            rest = rest[~inside]
    return np.array(out).reshape(-1, x.shape[1])


def fit(sample: np.ndarray, n: int, cosine: float) -> Index:
    """An index for n unit vectors from a sample of them."""
    random = np.random.default_rng(0)
    d, m = sample.shape[1], len(sample)
    lists = max(1, min(math.ceil(math.sqrt(n) / 2), m // 16))
    centroids = means(sample, lists, 8, random)
    own = nearest(sample, centroids)
    rest = sliced(sample[:CODED] - centroids[own[:CODED]])
    books = np.stack([np.pad(b, ((0, WORDS - len(b)), (0, 0)), constant_values=1e3) for b in (means(s, WORDS, 5, random) for s in rest)])
    # Neighbours at the least cosine, in directions without preference.
    q = sample[random.permutation(m)[:4096]]
    side = random.standard_normal((8, *q.shape))
    side = unit((side - np.einsum("kij,ij->ki", side, q)[:, :, None] * q).reshape(-1, d))
    q = np.tile(q, (8, 1))
    score = lambda x: x @ centroids.T - np.einsum("ij,ij->i", centroids, centroids) / 2
    gaps = []
    for at in range(0, len(q), 4096):
        s = score(q[at : at + 4096])
        there = nearest(cosine * q[at : at + 4096] + math.sqrt(1 - cosine**2) * side[at : at + 4096], centroids)
        gaps.append(s.max(1) - s[np.arange(len(s)), there])
    margin = float(np.quantile(np.concatenate(gaps), RECALL)) + 1e-9
    return Index(centroids, crowds(sample, own, math.acos(cosine), random), books, margin, cosine)


def placed(x: np.ndarray, index: Index) -> tuple[np.ndarray, list[np.ndarray]]:
    """The list of each unit vector, and the lists that it visits as a query.

    Of two vectors in different lists the one in the list of lower number
    visits, and one in no crowd visits crowds: a pair is met once. Within a
    list every vector is a query too, but not within a crowd.
    """
    k = len(index.centroids)
    score = x @ index.centroids.T - np.einsum("ij,ij->i", index.centroids, index.centroids) / 2
    best = score.argmax(1)
    near = score >= score.max(1, keepdims=True) - index.margin
    near &= np.arange(k) >= best[:, None]
    turn = np.arccos(np.clip(x @ index.crowds.T, -1, 1))
    crowd = turn.argmin(1) if len(index.crowds) else np.zeros(len(x), int)
    within = turn.min(1, initial=math.inf) <= index.angle / 2 - 1e-6
    near[within] = False
    # Any vector linked with one of a crowd is within its half angle and a whole one of the middle.
    meets = turn <= 1.5 * index.angle + 1e-6
    meets &= ~within[:, None] | (np.arange(len(index.crowds)) > crowd[:, None])
    own = np.where(within, k + crowd, best)
    return own, [np.flatnonzero(row) for row in np.concatenate([near, meets], 1)]


def encoded(x: np.ndarray, own: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Residual codes of each vector (row, slice), and the distance between it and what they say."""
    base = np.concatenate([index.centroids, index.crowds])[own]
    codes = np.stack([nearest(s, b) for s, b in zip(sliced(x - base), index.books, strict=True)], 1).astype(np.uint8)
    return codes, np.linalg.norm(x - decoded(codes, base, index), axis=1)


def decoded(codes: np.ndarray, base: np.ndarray, index: Index) -> np.ndarray:
    words = index.books[np.arange(len(index.books)), codes]  # row, slice, dimension
    return base + words.reshape(len(codes), -1)[:, : base.shape[1]]


def table_products(q: np.ndarray, codes: np.ndarray, index: Index) -> np.ndarray:
    """(coded vector, query): the products with all codewords, looked up slice by slice."""
    tables = np.einsum("swj,sqj->swq", index.books, sliced(q)).astype(np.float32)
    out = np.zeros((len(codes), len(q)), np.float32)
    for s, table in enumerate(tables):
        out += table[codes[:, s]]
    return out


def candidates(q: np.ndarray, codes: np.ndarray, error: np.ndarray, base: np.ndarray, index: Index):
    """Pairs (query, coded vector) that may reach the cosine, some queries at a time; by the triangle rule none that does is missing."""
    about = decoded(codes, base[None], index)
    size2 = np.einsum("ij,ij->i", about, about)
    far2 = (math.sqrt(2 - 2 * index.cosine) + error + SLACK) ** 2
    # |q - about|^2 = 1 + |about|^2 - 2 q.about
    least = ((1 + size2 - far2) / 2).astype(np.float32)[:, None] - np.float32(SLACK)
    for at in range(0, len(q), TABLES):
        some = q[at : at + TABLES]
        x, i = np.nonzero(table_products(some, codes, index) + (some @ base).astype(np.float32) >= least)
        yield i + at, x


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n nodes under links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def vectors_of(table: pa.Table | pa.RecordBatch, kind: np.dtype, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("vec").to_pylist()), kind).astype(float).reshape(-1, d)


def classes_of(rows: DataFrame, d: int, kind: np.dtype) -> DataFrame:
    """(id, key, vec): key names a vector other than zero, vec are its bytes; both are null for all others."""

    def run(batches):
        for batch in batches:
            places, v = matrix(batch.column("vec"), d)
            some = np.flatnonzero(v.any(1)) if d else places[:0]
            keys, raw = [None] * batch.num_rows, [None] * batch.num_rows
            for place, one in zip(places[some].tolist(), v[some].astype(kind), strict=True):
                raw[place] = one.tobytes()
                keys[place] = hashlib.blake2b(raw[place], digest_size=16).hexdigest()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.string()), pa.array(raw, pa.binary())], ["id", "key", "vec"])

    return rows.mapInArrow(run, "id long, key string, vec binary")


def indexed(classes: DataFrame, index: Index, d: int, kind: np.dtype) -> DataFrame:
    """(key, id, n, vec, node, list, codes, error, visits) of every class; all of a crowd are one node."""
    sent, k = classes.sparkSession.sparkContext.broadcast(index), len(index.centroids)

    def run(batches):
        index = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                x = unit(vectors_of(batch, kind, d))
                own, visits = placed(x, index)
                codes, error = encoded(x, own, index)
                node = [f"crowd {o - k}" if o >= k else key for o, key in zip(own.tolist(), batch.column("key").to_pylist(), strict=True)]
                more = [pa.array(node, pa.string()), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(visits, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "id", "n", "vec")), *more], ["key", "id", "n", "vec", "node", "list", "codes", "error", "visits"])

    return classes.select("key", "id", "n", "vec").mapInArrow(run, "key string, id long, n long, vec binary, node string, list int, codes binary, error double, visits array<int>")


def blocks(count) -> F.Column:
    return F.ceil(count / BLOCK).cast("int")


def links(entries: DataFrame, index: Index, d: int, kind: np.dtype) -> DataFrame:
    """(key, links, node, other): rows linked with a class in one comparison of two blocks, and a node that it is linked to there."""
    sent = entries.sparkSession.sparkContext.broadcast(index)
    visits = entries.select("key", "n", "vec", "node", F.col("list").alias("home"), F.explode("visits").alias("list"))
    # One row for each list, however many vectors there are.
    sizes = entries.groupBy("list").agg(F.count("*").alias("items")).join(entries.select(F.explode("visits").alias("list")).groupBy("list").agg(F.count("*").alias("queries")), "list")
    sizes = F.broadcast(cut(sizes.select("list", blocks(F.col("items")).alias("ni"), blocks(F.col("queries")).alias("nq"))))
    dealt = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    items = entries.join(sizes, "list").select("key", "n", "vec", "node", "codes", "error", "list", dealt("ni").alias("i"), across("nq").alias("q"))
    queries = visits.join(sizes, "list").select("key", "n", "vec", "node", "home", "list", across("ni").alias("i"), dealt("nq").alias("q"))
    schema = pa.schema([("key", pa.string()), ("links", pa.int64()), ("node", pa.string()), ("other", pa.string())])

    def compare(group, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        index, number = sent.value, group[0].as_py()
        q, x = unit(vectors_of(left, kind, d)), unit(vectors_of(right, kind, d))
        codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(right.num_rows, -1)
        base = np.concatenate([index.centroids, index.crowds])[number]
        key_q, key_x = (np.array(t.column("key").to_pylist(), "S32") for t in (left, right))
        same = left.column("home").to_numpy() == number
        a, b = [], []
        for i, j in candidates(q, codes, right.column("error").to_numpy(), base, index):
            once = ~same[i] | (key_q[i] < key_x[j])
            i, j = i[once], j[once]
            for at in range(0, len(i), 1 << 15):
                p, r = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                linked = np.einsum("ij,ij->i", q[p], x[r]) >= index.cosine
                a.append(p[linked])
                b.append(r[linked])
        a, b = np.concatenate([[], *a]).astype(int), np.concatenate([[], *b]).astype(int)
        n_q, n_x = left.column("n").to_numpy(), right.column("n").to_numpy()
        count = np.concatenate([np.bincount(a, n_x[b], len(q)), np.bincount(b, n_q[a], len(x))]).astype(np.int64)
        label = joined(len(q) + len(x), a, b + len(q))
        some = np.flatnonzero(count)
        keys, nodes = (left.column(c).to_pylist() + right.column(c).to_pylist() for c in ("key", "node"))
        return pa.table([pa.array([keys[s] for s in some], pa.string()), pa.array(count[some]), pa.array([nodes[s] for s in some], pa.string()), pa.array([nodes[label[s]] for s in some], pa.string())], schema=schema)

    by = ["list", "i", "q"]
    items = items.select(*[F.col(c).alias(c) for c in items.columns])  # names of its own: both sides come from one table
    return queries.groupBy(*by).cogroup(items.groupBy(*by)).applyInArrow(compare, "key string, links long, node string, other string")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """One row per input row: id, n_links, component_id (least id reachable by links), kept (id = component_id).

    Two rows are linked if the cosine of their vectors reaches `cosine` (above
    0), in double precision. Null vectors, zero vectors and those that hold a
    null, a NaN or an infinity are linked with nothing; shorter vectors count
    as filled up with zeros. Repeated rows are rows like others and linked with
    each other, also if they share an id. Rows of null ids are linked and
    counted; they are kept if their component has no id at all. No rows give no
    rows; other columns are not read.

    The index is fitted on at most `sample_bytes` of vectors (those of least
    hash), and holds all rows.
    """
    of = rows.schema[vec_col].dataType
    kind = np.dtype("<f4" if isinstance(getattr(of, "elementType", None), T.FloatType) else "<f8")
    rows = named(rows, id_col, vec_col)
    d = width(rows)
    keyed = classes_of(rows, d, kind)
    known = cut(keyed.select("id", "key"))
    classes = cut(keyed.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.first("vec").alias("vec")))
    out = known.filter("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    n = classes.count()
    if n:
        # Keys are hashes, so the first of them are any vectors; their number is bounded.
        taken = classes.select("key", "vec").orderBy("key").limit(max(64, sample_bytes // (8 * d))).toArrow()
        index = fit(unit(vectors_of(taken, kind, d)), n, cosine)
        entries = cut(indexed(classes, index, d, kind))
        found = cut(links(entries, index, d, kind))
        linked = found.groupBy("key").agg(F.sum("links").alias("links"))
        label = components(found.select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "node")
        crowd = F.broadcast(entries.filter(F.col("list") >= len(index.centroids)).groupBy("node").agg(F.sum("n").alias("crowd")))  # a row for each crowd, at most 1 / CROWD
        counted = entries.select("key", "id", "n", "node").join(linked, "key", "left").join(crowd, "node", "left").join(label, "node", "left")
        counted = cut(counted.select("key", "id", (F.coalesce("crowd", "n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")))
        least = cut(counted.groupBy("component").agg(F.min("id").alias("component_id")))
        of_class = cut(counted.select("key", "n_links", "component").join(least, "component").select("key", "n_links", "component_id"))
        out = out.union(known.filter("key is not null").join(of_class, "key").select("id", "n_links", "component_id"))
    kept = F.when(F.col("id").isNull(), F.col("component_id").isNull()).otherwise(F.col("id") == F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


def op12_embedding_near_dedup(spark, sf_dir):
    from .common import table

    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)
