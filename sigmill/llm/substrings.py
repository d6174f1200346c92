"""Substring dedup by prefix-partitioned suffix trees over words.

A window's anchor is the least hash of the short runs of words within it, so
equal windows have equal anchors. Neighbouring windows of one anchor are one
stretch of text, 13 to 20 words long, and every window in it begins a suffix of
it. Suffixes are dealt into groups by a prefix whose length varies: a stretch
goes, with all its suffixes, where its anchor's run of words goes; where more
suffixes share an anchor than a group should hold, each goes alone, by all of
its first 13 words.

A group sorts its suffixes into the leaves of its subtrees. Common prefixes of
neighbouring leaves are the depths of internal nodes, 13 words and deeper; each
node's least row id is who holds its text first. For a leaf the deepest node of
one holder is a repeat that can't be extended to the right; what the suffix to
its left already covers is the same maximal repeat. Repeats go back to the
blocks of documents that hold them.

Anchors that occur once can't repeat and stay out of the trees. Blocks and
groups exchange packed arrays, never a row for nothing: a block sends a group
at most as many rows as it has stretches for it, and a stretch once however
often it holds it.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, coded, cut, gram_hashes, mix, powers, total_bytes

RUN = 6
U64, I64 = np.dtype("<u8"), np.dtype("<i8")
#: Leaves sorted at once; a task sorts one such part of its group after another.
LEAVES = 200_000
ANSWER = "block int, kind int, a binary, b binary"
COPY, ANCHORS, STRETCHES, SINGLES = range(4)


def sliding_least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive values."""
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        np.minimum(out, h[i : len(h) - n + 1 + i], out=out)
    return out


def within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n - 1 for each n, one after another."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def stretches(codes: np.ndarray, counts: np.ndarray, alive: np.ndarray, window: int):
    """(start word, windows, anchor) of each run of windows with one anchor, of rows that are alive."""
    if len(codes) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    anchor = sliding_least(gram_hashes(codes, RUN), window - RUN + 1)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(codes))
    at = np.flatnonzero((left >= window)[: len(anchor)] & np.repeat(alive, counts)[: len(anchor)])
    if not len(at):
        return at, at, np.empty(0, np.uint64)
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (anchor[at[1:]] != anchor[at[:-1]])])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    # Text that repeats itself may keep one anchor for long; such runs are parted.
    most = window - RUN + 1
    parts = -(-size // most)
    k = within(parts)
    first, size = np.repeat(first, parts) + most * k, np.minimum(np.repeat(size, parts) - most * k, most)
    return at[first], size, anchor[at[first]]


def spans_hash(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64 bits of each codes[start : start + length]."""
    up, down = powers(len(codes))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)])])
        return mix((total[start + length] - total[start]) * down[start] + length.astype(np.uint64))


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where in sorted `known` each x is; -1 if it isn't."""
    if not len(known):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, -1)


def _table(columns: dict, schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _split(groups: np.ndarray):
    """(group, rows of it) for each value of `groups`."""
    order = np.argsort(groups, kind="stable")
    values, first = np.unique(groups[order], return_index=True)
    return zip(values.tolist(), np.split(order, first[1:]), strict=True) if len(values) else ()


def _group_of(hashed: np.ndarray, groups: int) -> np.ndarray:
    return (mix(hashed) >> np.uint64(33)).astype(np.int64) % groups


def _answers(right: pa.Table, kind: int, dtype_a: np.dtype, dtype_b: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The arrays a and b of all answers of a kind, by a."""
    mine = right.filter(pc.equal(right.column("kind"), kind))
    a, b = (np.frombuffer(b"".join(mine.column(c).to_pylist()), t) for c, t in (("a", dtype_a), ("b", dtype_b)))
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def _alive(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which rows' windows count: those with an id that are no later copy; and which are copies."""
    copies = np.unique(np.frombuffer(b"".join(right.filter(pc.equal(right.column("kind"), COPY)).column("a").to_pylist()), ">i8"))
    copy = np.isin(left.column("row").to_numpy(), copies)
    return left.column("id").is_valid().to_numpy() & ~copy, copy


def leaf_words(flat: np.ndarray, start: np.ndarray, length: np.ndarray, most: int) -> np.ndarray:
    """A row of `most` codes for each suffix, 0 after its end."""
    at = start[:, None] + np.arange(most)
    return np.where(np.arange(most) < length[:, None], flat[np.minimum(at, len(flat) - 1)], np.uint64(0))


def subtree(flat: np.ndarray, start: np.ndarray, length: np.ndarray, least: np.ndarray, most: np.ndarray, window: int):
    """(first holder, depth) of each leaf: its node of `window` words, and how deep that holder still shares.

    Leaves are sorted; a node of depth d is a run of leaves that share d words.
    A leaf whose node nobody but one row holds has no holder (the largest number).
    """
    width = int(length.max())
    words = leaf_words(flat, start, length, width)
    order = np.lexsort(words.T[::-1])
    words, length, least, most = words[order], length[order], least[order], most[order]
    unlike = words[1:] != words[:-1]
    common = np.where(unlike.any(1), unlike.argmax(1), width)
    common = np.minimum(common, np.minimum(length[1:], length[:-1]))
    holder, deep = None, np.full(len(length), window)
    for d in range(window, width + 1):
        first = np.flatnonzero(np.concatenate([[True], common < d]))
        node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(length))))
        held = np.minimum.reduceat(least, first)[node]
        if holder is None:
            holder = held
            alone = np.maximum.reduceat(most, first)[node] <= held
        else:
            deep[(held == holder) & (length >= d)] = d
    holder = np.where(alone, np.iinfo(np.int64).max, holder)
    out = np.empty_like(order)
    out[order] = np.arange(len(order))
    return holder[out], deep[out]


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, per_block: int = 16 << 20, group_size: int = 400_000, with_text: bool = True) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 and, `with_text`, kept (the kept words, space-joined).

    A word goes if a window of `window` words over it also starts in a row of
    smaller id; windows are judged on the input. Null and empty texts have no
    words. Rows with a null id neither lose words nor make others lose them.
    Rows of one id, repeated or not, never make each other lose words. No rows
    give no rows; other columns are not read.

    Copies of a whole text are told first, by a hash of it, and only the one of
    least id goes on. Each block of about `per_block` bytes sends a stretch once,
    so one that a third of all rows share is one row a block.

    Words are compared by 64-bit hashes, 13 and more of them in the trees; a
    block looks up its own stretches by 64 bits of the whole stretch. `window`
    is from 7 to 32,000 words: places in a stretch take 16 bits.
    """
    if not RUN < window <= 32_000:
        raise ValueError("window must be from 7 to 32,000 words")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    blocks = blocks_for(total_bytes(rows), per_block, least=32)
    row = F.xxhash64("id", "text")
    dealt = rows.select(F.pmod(row, F.lit(blocks)).cast("int").alias("block"), row.alias("row"), "id", "text")

    hashes = rows.filter("id is not null").select("id", row.alias("row"), F.md5("text").alias("key"))
    first = cut(hashes.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first != last").select("key", "first"))
    copies = hashes.join(first, "key").filter("id > first")
    copies = copies.select(F.pmod("row", F.lit(blocks)).cast("int").alias("block"), F.lit(COPY).alias("kind"), F.unhex(F.lpad(F.hex("row"), 16, "0")).alias("a"), F.lit(None).cast("binary").alias("b"))

    ask = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("anchors", pa.binary()), ("counts", pa.binary())])

    def ask_anchors(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.empty(0, np.uint64)]
        if left.num_rows:
            alive, _ = _alive(left, right)
            for at, n, codes in coded(left.column("text")):
                found.append(stretches(codes, n, alive[at : at + len(n)], window)[2])
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        out = {c: [] for c in ask.names}
        for bucket, at in _split(_group_of(values, blocks)):
            for c, x in zip(ask.names, (bucket, left.column("block")[0].as_py(), values[at].tobytes(), counts[at].astype(I64).tobytes()), strict=True):
                out[c].append(x)
        return _table(out, ask)

    answer = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])

    def repeated_anchors(asked: pa.Table) -> pa.Table:
        """To each block its anchors that occur again, and whether too often for one group."""
        mine = [(b, np.frombuffer(v, U64), np.frombuffer(n, I64)) for b, v, n in zip(*(asked.column(c).to_pylist() for c in ("block", "anchors", "counts")), strict=True)]
        values, at = np.unique(np.concatenate([v for _, v, _ in mine]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([n for *_, n in mine]))
        out = {c: [] for c in answer.names}
        for block, v, _ in mine:
            n = total[np.searchsorted(values, v)]
            if (n > 1).any():
                for c, x in zip(answer.names, (block, ANCHORS, v[n > 1].tobytes(), (n[n > 1] > group_size).astype(np.uint8).tobytes()), strict=True):
                    out[c].append(x)
        return _table(out, answer)

    leaf = pa.schema([("grp", pa.int32()), ("block", pa.int32()), ("single", pa.bool_()), *((c, pa.binary()) for c in ("prefix", "hash", "length", "codes", "least", "most"))])

    def leaves(left: pa.Table, right: pa.Table) -> pa.Table:
        out, parts = {c: [] for c in leaf.names}, []
        repeated, frequent = _answers(right, ANCHORS, U64, np.dtype(np.uint8))
        if len(repeated) and left.num_rows:
            alive, _ = _alive(left, right)
            ids = left.column("id").fill_null(0).to_numpy()
            for at, n, codes in coded(left.column("text")):
                start, size, anchor = stretches(codes, n, alive[at : at + len(n)], window)
                known = among(anchor, repeated)
                start, size, anchor, known = (x[known >= 0] for x in (start, size, anchor, known))
                often = frequent[known] > 0
                single = np.repeat(often, np.where(often, size, 1))
                times = np.where(often, size, 1)
                start = np.repeat(start, times) + within(times)
                length = np.where(single, 1, np.repeat(size, times)) + window - 1
                hashed = spans_hash(codes, start, length)
                row = ids[at + np.searchsorted(np.cumsum(n), start, "right")]
                # One of each stretch is kept, with the least and the most id that has it.
                order = np.lexsort((row, hashed))
                new = np.flatnonzero(np.concatenate([[True], hashed[order][1:] != hashed[order][:-1]])) if len(order) else order
                least, most = row[order][new], row[order][np.append(new[1:], len(order)) - 1] if len(order) else row
                keep = order[new]
                prefix = np.where(single, hashed, np.repeat(anchor, times))
                parts.append((hashed[keep], prefix[keep], single[keep], length[keep], least, most, codes[np.repeat(start[keep], length[keep]) + within(length[keep])]))
        if parts:
            hashed, prefix, single, length, least, most, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
            begin = np.cumsum(length) - length
            order = np.lexsort((least, hashed))
            new = np.flatnonzero(np.concatenate([[True], hashed[order][1:] != hashed[order][:-1]])) if len(order) else order
            if len(order):
                most = np.maximum.reduceat(most[order], new)
                least, keep = least[order][new], order[new]
                hashed, prefix, single, length, begin = hashed[keep], prefix[keep], single[keep], length[keep], begin[keep]
            block = left.column("block")[0].as_py()
            for g, at in _split(_group_of(prefix, blocks) * 2 + single):
                codes = flat[np.repeat(begin[at], length[at]) + within(length[at])]
                values = (g // 2, block, bool(g % 2), prefix[at].tobytes(), hashed[at].tobytes(), length[at].astype(np.uint16).tobytes(), codes.tobytes(), least[at].tobytes(), most[at].tobytes())
                for c, x in zip(leaf.names, values, strict=True):
                    out[c].append(x)
        return _table(out, leaf)

    def repeats(group: pa.Table) -> pa.Table:
        """The subtrees of a group, some prefixes at a time; the repeats of each stretch go back to its block."""
        types = {"prefix": U64, "hash": U64, "length": np.dtype(np.uint16), "codes": U64, "least": I64, "most": I64}
        prefix, hashed, length, flat, least, most = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in types.items())
        times = [len(x) // 2 for x in group.column("length").to_pylist()]
        block, single = (np.repeat(np.array(group.column(c).to_pylist()), times) for c in ("block", "single"))
        length = length.astype(np.int64)
        begin = np.cumsum(length) - length
        order = np.argsort(prefix, kind="stable")
        size = np.cumsum((length - window + 1)[order])
        ends = np.flatnonzero(np.append(prefix[order][1:] != prefix[order][:-1], True)) + 1
        out = {c: [] for c in answer.names}
        at = 0
        while at < len(order):
            fit = ends[(ends > at) & (size[ends - 1] - (size[at - 1] if at else 0) <= LEAVES)]
            to = int(fit[-1]) if len(fit) else int(ends[ends > at][0])
            mine = order[at:to]
            at = to
            n = length[mine] - window + 1
            stretch, offset = np.repeat(np.arange(len(mine)), n), within(n)
            whole = mine[stretch]
            holder, deep = subtree(flat, begin[whole] + offset, length[whole] - offset, least[whole], most[whole], window)
            last = int(n.max())
            holders, depths = np.full((len(mine), last), np.iinfo(np.int64).max), np.zeros((len(mine), last), np.int64)
            holders[stretch, offset], depths[stretch, offset] = holder, deep
            reach, by = np.zeros(len(mine), np.int64), np.full(len(mine), np.iinfo(np.int64).max)
            found = []
            for o in range(last):
                # Not what nobody here comes after, nor what the suffix before covers by a holder as early.
                need = np.flatnonzero((holders[:, o] < most[mine]) & ((reach < o + window) | (holders[:, o] < by)))
                reach[need], by[need] = o + depths[need, o], holders[need, o]
                found.append((mine[need], np.full(len(need), o), depths[need, o], holders[need, o]))
            which, offset, depth, first_id = (np.concatenate(x) for x in zip(*found, strict=True))
            for b, k in _split(block[which].astype(np.int64) * 2 + single[which]):
                b_of = np.stack([offset[k] << 16 | depth[k], first_id[k]], 1).astype(I64)
                for c, x in zip(answer.names, (b // 2, SINGLES if b % 2 else STRETCHES, hashed[which[k]].tobytes(), b_of.tobytes()), strict=True):
                    out[c].append(x)
        return _table(out, answer)

    done = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def lookup(codes, start, length, row, ids, known, held, cover):
        """Marks the words of the repeats of these stretches that an earlier row holds; where none is known."""
        hashed = spans_hash(codes, start, length)
        lo = np.searchsorted(known, hashed, "left")
        n = np.searchsorted(known, hashed, "right") - lo
        which, at = np.repeat(np.arange(len(start)), n), np.repeat(lo, n) + within(n)
        earlier = held[at, 1] < ids[row[which]]
        which, at = which[earlier], at[earlier]
        begin = start[which] + (held[at, 0] >> 16)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + (held[at, 0] & 0xFFFF), -1)
        return n == 0

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table({c: [] for c in done.names}, done)
        alive, copy = _alive(left, right)
        pair = np.dtype((I64, 2))
        known, held = _answers(right, STRETCHES, U64, pair)
        alone, alone_held = _answers(right, SINGLES, U64, pair)
        ids, texts = left.column("id").fill_null(0).to_numpy(), left.column("text")
        words, removed = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        sha, kept_texts = [], []
        for at, n, codes in coded(texts):
            rows = slice(at, at + len(n))
            ends = np.cumsum(n)
            cover = np.zeros(len(codes) + 1, np.int64)
            start, size, _ = stretches(codes, n, alive[rows], window)
            row = np.searchsorted(ends, start, "right")
            new = lookup(codes, start, size + window - 1, row, ids[rows], known, held, cover) if len(start) else np.empty(0, bool)
            if len(alone) and new.any():
                start, size, row = start[new], size[new], row[new]
                lookup(codes, np.repeat(start, size) + within(size), np.full(size.sum(), window), np.repeat(row, size), ids[rows], alone, alone_held, cover)
            gone = np.cumsum(cover[:-1]) > 0
            gone |= np.repeat(copy[rows] & (n >= window), n)
            total = np.concatenate([[0], np.cumsum(gone)])
            words[rows], removed[rows] = n, total[ends] - total[ends - n]
            for k in range(len(n)):
                if n[k] == removed[at + k]:
                    joined = b""
                else:
                    own = texts[at + k].as_py().encode().split()
                    joined = b" ".join(compress(own, ~gone[ends[k] - n[k] : ends[k]]) if removed[at + k] else own)
                sha.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append(joined.decode() if with_text else None)
        return _table(dict(zip(done.names, (left.column("id").combine_chunks(), words, removed, sha, kept_texts), strict=True)), done)

    def meet(answers: DataFrame, run, kind: str) -> DataFrame:
        return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, kind)

    asked = meet(copies, ask_anchors, "bucket int, block int, anchors binary, counts binary")
    found = asked.groupBy("bucket").applyInArrow(repeated_anchors, ANSWER).union(copies)
    trees = meet(found, leaves, "grp int, block int, single boolean, prefix binary, hash binary, length binary, codes binary, least binary, most binary")
    nodes = trees.groupBy("grp").applyInArrow(repeats, ANSWER).union(copies)
    return meet(nodes, remove, "id long, n_words long, n_removed long, kept_sha256 string, kept string").withColumnRenamed("id", id_col)


def op3_substring_dedup(spark, sf_dir):
    from .common import table

    return drop_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")
