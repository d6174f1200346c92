"""Prediction by partial matching over bytes, counted over a corpus and scored by Spark.

A text is its bytes, A-Z in lower case and white space as it stands, and one
end; ends stand before it too, so that every byte has ORDER bytes of context,
across words as within them. There is a trie for each class of training rows
(for documents, a language); a text's probability is the mixture of what the
tries give it.

The tries are never in one place. Blocks of documents send their distinct
events (context, symbol), each once, to groups of contexts and get prices back.
A group is made by the last two bytes of the context and a part of the third,
so that contexts ending in a common pair are several groups; each has all its
contexts of three bytes and more, and a copy of the nodes of two. Contexts of
no or one byte, at most 65,792 nodes a class, are a table everyone has.

Escapes follow method D: among what a context has left of `total` events and
`kinds` symbols, a symbol seen `count` times has (2 count - 1) / (2 total), the
escape kinds / (2 total). Symbols of the longer context are excluded from the
shorter one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import AT_ONCE, blocks_for, coded, cut, from_planes, mix, planes, total_bytes

ORDER = 5
#: A byte that no UTF-8 text holds: the end, and what stands before a text.
END = 0xFF
#: Into how many parts the contexts of one pair of last bytes are dealt.
PARTS = 16
U64, I64, I32, U16 = np.dtype("<u8"), np.dtype("<i8"), np.dtype("<i4"), np.dtype("<u2")
#: Prices travel in this part of a digit, at most 16 digits: a byte's price is off by 1/8192 of a digit at most, up or down.
STEPS = 4096
#: Distinct events that wait to be merged.
WAITING = 100_000
WORDS, PRICES = 0, 1
LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32


def streams(column: pa.ChunkedArray | pa.Array, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, events of each row, keys of these events) for runs of rows; a long row comes in several runs.

    A key is the last `order` bytes and the symbol. Null is empty.
    """
    before = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = chunk.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = chunk.buffers()
        if not len(chunk):
            continue
        offsets = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        row = 0
        while row < len(chunk):
            to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + AT_ONCE, "right")) - 1)
            lengths = np.diff(offsets[row : to + 1])
            if to > row + 1 or lengths[0] <= AT_ONCE:
                size = lengths + order + 1
                text = np.full(size.sum(), END, np.uint8)
                own = np.repeat(np.arange(len(lengths)), lengths)
                text[np.arange(lengths.sum()) + own * (order + 1) + order] = LOW[data[offsets[row] : offsets[to]]]
                first = np.cumsum(size) - size
                real = np.ones(len(text), bool)
                real[first[:, None] + np.arange(order)] = False
                yield before + row, lengths + 1, keys_of(text, order)[real]
            else:
                lo, hi = int(offsets[row]), int(offsets[to])
                for at in range(lo, hi + 1, AT_ONCE):
                    end = min(at + AT_ONCE, hi + 1)
                    head = LOW[data[max(lo, at - order) : at]]
                    text = np.concatenate([np.full(order - len(head), END, np.uint8), head, LOW[data[at : min(end, hi)]], np.full(int(end > hi), END, np.uint8)])
                    yield before + row, np.array([end - at]), keys_of(text, order)[order:]
            row = to
        before += len(chunk)


def keys_of(text: np.ndarray, order: int) -> np.ndarray:
    out = np.zeros(len(text), np.uint64)
    for j in range(order, -1, -1):
        out <<= np.uint64(8)
        out[j:] |= text[: len(text) - j]
    return out


def shorter(keys: np.ndarray, k: int) -> np.ndarray:
    """Events with their context cut to its last k bytes."""
    return keys & np.uint64((1 << 8 * (k + 1)) - 1)


def part_of(keys: np.ndarray) -> np.ndarray:
    """By the third byte of the context from its end."""
    return (keys >> np.uint64(24) & np.uint64(0xFF)) % np.uint64(PARTS)


def group_of(pair: np.ndarray, part: np.ndarray, groups: int) -> np.ndarray:
    return (mix(pair * np.uint64(PARTS) + part) >> np.uint64(33)).astype(np.int64) % groups


def find(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index of each value in sorted `known`, or len(known)."""
    if not len(known):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, len(known))


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts (a row each)."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first, axis=0, dtype=counts.dtype) if len(first) else counts


class Level:
    """The nodes of one class and context length: counts by event, totals by context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys
        self.counts = np.append(counts, 0).astype(float)
        self.contexts, self.of = np.unique(keys >> np.uint64(8), return_inverse=True)
        n = len(self.contexts) + 1
        self.total = np.bincount(self.of, weights=counts, minlength=n)
        self.kinds = np.bincount(self.of, minlength=n).astype(float)
        self.excluded = np.zeros(n)

    def count(self, keys: np.ndarray) -> np.ndarray:
        return self.counts[find(keys, self.keys)]

    def above(self, below: Level, k: int) -> Level:
        """Notes how much the contexts of k bytes, `below`, have of the symbols seen here."""
        self.excluded = np.bincount(self.of, weights=below.count(shorter(self.keys, k)), minlength=len(self.contexts) + 1)
        return self


def price(keys: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of each event in one trie; levels[k] has the contexts of k bytes."""
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    gone, kinds_gone = np.zeros(len(keys)), np.zeros(len(keys))
    for k in range(len(levels) - 1, -1, -1):
        level, at = levels[k], np.flatnonzero(open_)
        short = shorter(keys[at], k)
        context, seen = find(short >> np.uint64(8), level.contexts), level.count(short)
        total, kinds = level.total[context], level.kinds[context]
        left, new = 2 * (total - gone[at]), kinds - kinds_gone[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            out[at] += np.where(seen > 0, np.log10((2 * seen - 1) / left), np.where((total > 0) & (new > 0), np.log10(new / left), 0.0))
        open_[at[seen > 0]] = False
        gone[at] = level.excluded[context]
        kinds_gone[at] = np.where(total > 0, kinds, 0)
    out[open_] -= np.log10(max(256 - levels[0].kinds.sum(), 1))
    return out


def _split(groups: np.ndarray):
    """(group, rows of it) for each value of `groups`."""
    order = np.argsort(groups, kind="stable")
    values, first = np.unique(groups[order], return_index=True)
    return zip(values.tolist(), np.split(order, first[1:]), strict=True) if len(values) else ()


def _table(columns: dict, schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def event_counts(table: pa.Table | pa.RecordBatch, classes: int, order: int, only_training: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct events of (text, train, class) rows and how often each class of training rows has them."""
    train, kind = table.column("train").to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column("train").to_numpy(), np.asarray(table.column("class"))
    column = np.where(train, kind, classes)
    found, waiting = [], 0
    for row, n, keys in streams(table.column("text"), order):
        own = np.repeat(column[row : row + len(n)], n)
        keys, times = np.unique(keys << np.uint64(8) | own.astype(np.uint64), return_counts=True)
        own = (keys & np.uint64(0xFF)).astype(np.int64)
        if only_training:
            keys, times, own = keys[own < classes], times[own < classes], own[own < classes]
        counts = np.zeros((len(keys), classes + 1), I32)
        counts[np.arange(len(keys)), own] = times
        found.append(merged(keys >> np.uint64(8), counts[:, :classes]))
        waiting += len(keys)
        if waiting > WAITING + len(found[0][0]):
            found, waiting = [merged(*map(np.concatenate, zip(*found, strict=True)))], 0
    if not found:
        return np.empty(0, np.uint64), np.zeros((0, classes), I32)
    return merged(*map(np.concatenate, zip(*found, strict=True)))


def score_texts(
    docs: DataFrame,
    train,
    id_col: str = "doc_id",
    text_col: str = "text",
    class_col: str | None = "lang",
    max_classes: int = 6,
    per_block: int = 8 << 20,
) -> DataFrame:
    """One row per input row: id, n_tokens, n_known, train_tokens, base_score, score.

    `train`: boolean column, true for the rows to learn from. base_score is the
    add-one unigram log10 probability of the tokens (words and the end), score
    that of the text's bytes and end by the mixture of tries. `class_col` only
    parts the training rows into tries (its `max_classes` commonest values, and
    one trie for all others); no score looks at it. Null and empty texts are the
    end alone. Null ids and repeated rows are kept; without training rows the
    base is 0 and the tries are even over bytes; no rows give no rows; other
    columns are not read. Words are told apart by 64-bit hashes; a byte's price is
    rounded to 1/4096 of a digit.

    Broadcast are one-byte contexts, at most 65,792 nodes a class. All else that
    the corpus gives is spread over groups of words and of contexts.
    """
    kind = F.coalesce(F.col(class_col).cast("string"), F.lit("")) if class_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), kind.alias("class"))
    common = [r["class"] for r in rows.filter("train").groupBy("class").count().orderBy(F.desc("count"), "class").limit(max_classes).collect()]
    classes = len(common) + 1
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, c in enumerate(common) for x in (c, i)]), F.col("class")), F.lit(len(common))) if common else F.lit(0)
    rows = rows.withColumn("class", place.cast("int"))
    blocks = blocks_for(total_bytes(rows), per_block, least=16)
    dealt = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"), "id", "text", "train", "class")

    def pairs(batches):
        """Nodes of two context bytes, as (key, class, n)."""
        found = []
        for batch in batches:
            found.append(event_counts(batch, classes, 2, only_training=True))
            if len(found) > 16:
                found = [merged(*map(np.concatenate, zip(*found, strict=True)))]
        if found:
            keys, counts = merged(*map(np.concatenate, zip(*found, strict=True)))
            at, z = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(keys[at].astype(np.int64)), pa.array(z.astype(np.int32)), pa.array(counts[at, z], pa.int64())], ["key", "class", "n"])

    two = cut(rows.filter("train").select("text", "train", "class").mapInArrow(pairs, "key long, class int, n long").groupBy("key", "class").agg(F.sum("n").alias("n")))
    one = two.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("key"), "class").agg(F.sum("n").alias("n")).toArrow()
    key, of, n = (one.column(c).to_numpy() for c in ("key", "class", "n"))
    low = []
    ends = np.zeros(classes, np.int64)
    for z in range(classes):
        order = np.argsort(key[of == z])
        keys, counts = key[of == z][order].astype(np.uint64), n[of == z][order]
        low.append((keys, counts))
        ends[z] = counts[keys & np.uint64(0xFF) == END].sum()
    live = np.flatnonzero(ends) if ends.any() else np.array([0])
    prior = np.log10(np.maximum(ends[live], 1) / max(1, ends.sum()))

    # Words: their training counts, by groups of words.
    posting = pa.schema([("grp", pa.int32()), ("block", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())])

    def postings(left: pa.Table) -> pa.Table:
        train, found = left.column("train").to_numpy(), []
        for row, n, codes in coded(left.column("text"), lower=True):
            own = np.repeat(train[row : row + len(n)], n).astype(np.int64)
            found.append(merged(codes, own))
        codes, counts = merged(*map(np.concatenate, zip(*found, strict=True)))
        out = {c: [] for c in posting.names}
        for g, at in _split(group_of(codes, np.uint64(0), blocks)):
            for c, x in zip(posting.names, (g, left.column("block")[0].as_py(), planes(codes[at]), planes(counts[at].astype(I64))), strict=True):
                out[c].append(x)
        return _table(out, posting)

    counted = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("values", pa.binary()), ("distinct", pa.int64()), ("total", pa.int64())])

    def word_counts(table: pa.Table) -> pa.Table:
        mine = [(b, from_planes(c, U64), from_planes(n, I64)) for b, c, n in zip(*(table.column(x).to_pylist() for x in ("block", "codes", "counts")), strict=True)]
        codes, counts = merged(np.concatenate([c for _, c, _ in mine]), np.concatenate([n for *_, n in mine]))
        out = {c: [] for c in counted.names}
        for i, (block, c, _) in enumerate(mine):
            first = i == 0
            for name, x in zip(counted.names, (block, WORDS, planes(c), planes(counts[np.searchsorted(codes, c)]), int((counts > 0).sum()) if first else 0, int(counts.sum()) if first else 0), strict=True):
                out[name].append(x)
        return _table(out, counted)

    words = cut(
        dealt.groupBy("block").applyInArrow(postings, "grp int, block int, codes binary, counts binary").groupBy("grp").applyInArrow(word_counts, "block int, kind int, keys binary, values binary, distinct long, total long")
    )
    known = words.agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("v"), F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()
    n_ends = int(ends.sum())
    n_train, vocabulary = known["n"] + n_ends, known["v"] + (n_ends > 0)

    # Events: prices by groups of contexts.
    asked = pa.schema([("grp", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def ask(left: pa.Table) -> pa.Table:
        keys, counts = event_counts(left, classes, ORDER)
        out = {c: [] for c in asked.names}
        for g, at in _split(group_of(keys >> np.uint64(8) & np.uint64(0xFFFF), part_of(keys), blocks)):
            for c, x in zip(asked.names, (g, left.column("block")[0].as_py(), planes(keys[at]), planes(counts[at].astype(I32))), strict=True):
                out[c].append(x)
        return _table(out, asked)

    answer = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])

    def prices(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in answer.names}
        mine = [(b, from_planes(k, U64), from_planes(n, I32, classes).reshape(-1, classes)) for b, k, n in zip(*(left.column(x).to_pylist() for x in ("block", "keys", "counts")), strict=True)]
        if mine:
            keys, counts = merged(np.concatenate([k for _, k, _ in mine]), np.concatenate([n for *_, n in mine]).astype(I64))
            pair, pair_class, pair_n = (right.column(c).to_numpy() for c in ("key", "class", "n"))
            result = np.zeros((len(keys), len(live)), U16)
            for i, z in enumerate(live):
                one_key, one_n = low[z]
                zero = Level(*merged(shorter(one_key, 0), one_n))
                levels = [zero, Level(one_key, one_n).above(zero, 0)]
                # A pair is here once for each of its parts that are dealt here.
                two_key, first = np.unique(pair[pair_class == z].astype(np.uint64), return_index=True)
                levels.append(Level(two_key, pair_n[pair_class == z][first]).above(levels[1], 1))
                own = counts[:, z] > 0
                for k in range(3, ORDER + 1):
                    levels.append(Level(*merged(shorter(keys[own], k), counts[own, z])).above(levels[-1], k - 1))
                result[:, i] = np.minimum(np.rint(-STEPS * price(keys, levels)), 65535)
            for block, k, _ in mine:
                for c, x in zip(answer.names, (block, PRICES, planes(k), planes(result[np.searchsorted(keys, k)])), strict=True):
                    out[c].append(x)
        return _table(out, answer)

    done = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    per_token = float(np.log10(n_train + vocabulary + 1))

    def answers(right: pa.Table, kind: int, dtype, width: int):
        mine = right.filter(pc.equal(right.column("kind"), kind))
        keys = np.concatenate([np.empty(0, U64), *(from_planes(x, U64) for x in mine.column("keys").to_pylist())])
        values = np.concatenate([np.empty((0, width), dtype), *(from_planes(x, dtype, width).reshape(-1, width) for x in mine.column("values").to_pylist())])
        order = np.argsort(keys, kind="stable")
        return keys[order], values[order].astype(float)

    def totals(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table({c: [] for c in done.names}, done)
        word, count = answers(right, WORDS, I64, 1)
        event, cost = answers(right, PRICES, U16, len(live))
        cost /= -STEPS
        n_rows, texts = left.num_rows, left.column("text")
        n_tokens, n_known = np.ones(n_rows, np.int64), np.full(n_rows, int(n_ends > 0))
        base, each = np.full(n_rows, np.log10(n_ends + 1.0)), np.repeat(prior[None, :], n_rows, axis=0)
        count = count[:, 0]
        logs = np.log10(count + 1)
        for row, n, codes in coded(texts, lower=True):
            at, own = np.searchsorted(word, codes), np.repeat(np.arange(row, row + len(n)), n)
            n_tokens[row : row + len(n)] += n
            n_known += np.bincount(own, weights=count[at] > 0, minlength=n_rows).astype(np.int64)
            base += np.bincount(own, weights=logs[at], minlength=n_rows)
        for row, n, keys in streams(texts, ORDER):
            keys, at = np.unique(keys, return_inverse=True)
            each[row : row + len(n)] += np.add.reduceat(cost[np.searchsorted(event, keys)][at], np.cumsum(n) - n, axis=0)
        top = each.max(1)
        score = top + np.log10((10.0 ** (each - top[:, None])).sum(1))
        ids = left.column("id").combine_chunks()
        return _table(dict(zip(done.names, (ids, n_tokens, n_known, np.full(n_rows, n_train), base - n_tokens * per_token, score), strict=True)), done)

    @F.arrow_udf("array<int>")
    def groups_of_pair(keys: pa.Array) -> pa.Array:
        pair = keys.to_numpy(zero_copy_only=False).astype(np.uint64) >> np.uint64(8)
        every = np.stack([group_of(pair, np.uint64(p), blocks) for p in range(PARTS)], 1).astype(np.int32)
        return pa.array(list(every), pa.list_(pa.int32()))

    copies = two.select(F.explode(F.array_distinct(groups_of_pair("key"))).alias("grp"), "key", "class", "n")
    events = dealt.groupBy("block").applyInArrow(ask, "grp int, block int, keys binary, counts binary")
    priced = events.groupBy("grp").cogroup(copies.groupBy("grp")).applyInArrow(prices, "block int, kind int, keys binary, values binary")
    back = priced.union(words.select("block", "kind", "keys", "values"))
    result = dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(totals, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return result.withColumnRenamed("id", id_col)


def op1_ppm_scoring(spark, sf_dir):
    from .common import table

    fold = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 7 == 2
    scored = score_texts(table(spark, sf_dir, "documents"), ~fold("doc_id"))
    return scored.select("doc_id", fold("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
