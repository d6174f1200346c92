"""Alignment of two tokenizers over the same bytes.

Both tokenizers' tokens are ends in one run of bytes. Where both end, a group
closes. The ends are walked along a diagonal: at the current shift of one index
against the other, blocks of growing length are compared, so that stretches in
which each token has its partner are jumped; where a block differs, the group
is closed token by token and the shift is what it comes to. Many stretches of a
batch of texts are walked at once, each from a common end of its own.

How many documents hold a pair of ids linked is counted over the whole corpus.
Documents are written with their distinct pairs; their blocks send one row for
a pair with its number of documents, get the corpus-wide count of their own
pairs back, and add them up.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, from_planes, planes, table

#: The cache of a worker: distinct words with their tokens, some 200 bytes each.
CACHE_UNITS = 400_000
#: Bytes of text of a block, whose pairs are counted together, and of what is walked at once.
BLOCK_BYTES, AT_ONCE = 16 << 20, 1 << 20
#: Tokens of a stretch, and the longest block compared at once.
STRETCH, LONGEST = 64, 32
#: A group of more links than this is counted by its distinct ids.
LARGE_GROUP = 1 << 16
BITS = 16


def byte_level() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes are themselves, others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Growing:
    """An array that is added to at its end."""

    def __init__(self, kind):
        self.held, self.all = np.empty(1 << 16, kind), np.empty(0, kind)

    def add(self, more: np.ndarray) -> None:
        n = len(self.all)
        if n + len(more) > len(self.held):
            self.held = np.concatenate([self.all, np.empty(n + len(more) + len(self.held), self.held.dtype)])
        self.held[n : n + len(more)] = more
        self.all = self.held[: n + len(more)]


class Tokens:
    """Encodes words (with the space before them) by both tokenizers and remembers them.

    Neither tokenizer joins what a single space between two other characters
    parts, and either puts such a space at the beginning of a token, so texts
    are encoded word by word; a word is what stands between two such spaces. New
    words are encoded together and parted again where their bytes end.
    """

    def __init__(self, byte_bpe: str, pieces: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        of = byte_level()
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a, self.bytes_b = {}, {}
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = token.encode() if token in added else bytes(of[c] for c in token)
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b[i] = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
        self.len_a, self.len_b = (np.array([len(x.get(i, b"")) for i in range(max(x) + 1)]) for x in (self.bytes_a, self.bytes_b))
        self.flat_a, self.flat_b = (np.frombuffer(b"".join(x[i] for i in sorted(x)), np.uint8) for x in (self.bytes_a, self.bytes_b))
        # Every id as text with each sign that can follow it, so that groups are spelled by one join.
        self.spelled = [f"{i}{sign}" for i in range(max(len(self.len_a), len(self.len_b))) for sign in ",|;"]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = (Growing(np.uint16), Growing(np.uint16)), (Growing(np.int64), Growing(np.int64))
        for ends in self.ends:
            ends.add(np.zeros(1, np.int64))

    def _keep(self, words: list[str], ids: tuple[np.ndarray, ...], ends: tuple[np.ndarray, ...]) -> None:
        """Words that follow each other in `ids` and end at `ends`."""
        first = len(self.ends[0].all) - 1
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        for own, own_ends, i, e in zip(self.ids, self.ends, ids, ends, strict=True):
            own_ends.add(e + len(own.all))
            own.add(i)

    def _both(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, int), np.array(self.b.encode(text), int)

    def _same(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the joined bytes of both are those of the text after a space."""
        raw = np.frombuffer((" " + text).encode(), np.uint8)
        joined = (flat[ranges(np.cumsum(size)[ids] - size[ids], size[ids])] for ids, size, flat in ((a, self.len_a, self.flat_a), (b, self.len_b, self.flat_b)))
        return all(np.array_equal(x, raw) for x in joined)

    def learn(self, new: set[str], edges: set[str]) -> None:
        """`edges` begin or end with white space. A word whose tokens don't join to itself is known as -1."""
        words, alone = list(new - edges), list(new & edges)
        for at in range(0, len(words), 500):
            some = words[at : at + 500]
            text = " ".join(some)
            a, b = self._both(text)
            if not self._same(text, a, b):
                alone += some
                continue
            ends = np.cumsum([1 + len(w.encode()) for w in some])
            self._keep(some, (a, b), tuple(np.searchsorted(np.cumsum(size[ids]), ends) + 1 for size, ids in ((self.len_a, a), (self.len_b, b))))
        for w in alone:
            a, b = self._both(w)
            if self._same(w, a, b):
                self._keep([w], (a, b), (np.array([len(a)]), np.array([len(b)])))
            else:
                self.known[w] = -1

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each tokenizer (ids of all texts, how many of each text); none for texts that are empty or don't come back."""
        split = [words_of(t) if t else [] for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > CACHE_UNITS:
            self.forget()
            new = set().union(*split).difference(self.known)
        if new:
            self.learn(new, {w for words in split if words for w in (words[0], words[-1]) if w[:1].isspace() or w[-1:].isspace()})
        numbers = [list(map(self.known.__getitem__, words)) for words in split]
        numbers = [x if -1 not in x else [] for x in numbers]
        count = np.array([len(x) for x in numbers])
        flat = np.fromiter(chain.from_iterable(numbers), int, count.sum())
        row = np.repeat(np.arange(len(texts)), count)
        out_ids, out_n = [], []
        for ids, ends in zip(self.ids, self.ends, strict=True):
            start = ends.all[flat]
            size = ends.all[flat + 1] - start
            out_ids.append(ids.all[ranges(start, size)].astype(int))
            out_n.append(np.bincount(row, size, len(texts)).astype(int))
        return out_ids, out_n


SINGLE = re.compile(r"(?<=\S) (?=\S)")
DOUBLE = re.compile(r"\s\s")


def words_of(text: str) -> list[str]:
    """The text parted at single spaces between two characters that are no white space."""
    if text[0].isspace() or text[-1].isspace() or DOUBLE.search(text):
        return SINGLE.split(text)
    return text.split(" ")


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, `size` numbers each."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def closed(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each pair of places on, the next at which both have the same end; the nearer end goes on first."""
    i, j = i.copy(), j.copy()
    open_ = np.flatnonzero(a[i] != b[j])
    while len(open_):
        less = a[i[open_]] < b[j[open_]]
        i[open_] += less
        j[open_] += ~less
        open_ = open_[a[i[open_]] != b[j[open_]]]
    return i, j


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in two rising arrays with one last number at which they have the same number."""
    if not len(a):
        return np.empty(0, int), np.empty(0, int)
    # Stretches begin at the first common end from every STRETCH-th token on.
    start = np.arange(STRETCH - 1, len(a), STRETCH)
    i, j = closed(a, b, start, np.searchsorted(b, a[start]))
    i, first = np.unique(np.append(-1, i), return_index=True)
    j = np.append(-1, j)[first]
    i, j = i + 1, j + 1
    stop = np.append(i[1:], len(a))
    alive = i < stop
    i, j, stop = i[alive], j[alive], stop[alive]
    width = np.ones(len(i), int)
    runs = []
    while len(i):
        jumped = np.zeros(len(i), int)
        for w in np.unique(width):
            lane = np.flatnonzero(width == w)
            if w == 1:
                jumped[lane] = a[i[lane]] == b[j[lane]]
                continue
            ahead = np.arange(w)
            # Behind the end the last numbers stand again; they are cut off below.
            same = a[np.minimum(i[lane, None] + ahead, len(a) - 1)] == b[np.minimum(j[lane, None] + ahead, len(b) - 1)]
            jumped[lane] = np.where(same.all(1), w, same.argmin(1))
        length = np.minimum(jumped, stop - i)
        runs.append((i, j, length))
        i, j = i + length, j + length
        width = np.where(jumped == width, np.minimum(2 * width, LONGEST), 1)
        irregular = np.flatnonzero((width == 1) & (i < stop))
        if len(irregular):
            at_i, at_j = closed(a, b, i[irregular], j[irregular])
            runs.append((at_i, at_j, np.ones(len(irregular), int)))
            i[irregular], j[irregular] = at_i + 1, at_j + 1
        alive = i < stop
        i, j, stop, width = i[alive], j[alive], stop[alive], width[alive]
    i, j, length = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(i, kind="stable")
    i, j, length = i[order], j[order], length[order]
    return ranges(i, length), ranges(j, length)


def pairs(ids_a: np.ndarray, ids_b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, times) of the links of groups that end behind `to_a` and `to_b`; a pair is a << 16 | b."""
    from_a, from_b = np.append(0, to_a[:-1]), np.append(0, to_b[:-1])
    n_a, n_b = to_a - from_a, to_b - from_b
    large = n_a * n_b > LARGE_GROUP
    rows, found, times = [], [], []
    for g in np.flatnonzero(large):
        a, times_a = np.unique(ids_a[from_a[g] : to_a[g]], return_counts=True)
        b, times_b = np.unique(ids_b[from_b[g] : to_b[g]], return_counts=True)
        found.append((a[:, None] << BITS | b).ravel())
        times.append((times_a[:, None] * times_b).ravel())
        rows.append(np.full(len(found[-1]), row[g]))
    from_a, from_b, n_a, n_b, row = (x[~large] for x in (from_a, from_b, n_a, n_b, row))
    each_a = np.repeat(n_b, n_a)  # links of every token of the first
    a = np.repeat(ranges(from_a, n_a), each_a)
    b = ranges(np.repeat(from_b, n_a), each_a)
    found.append(ids_a[a] << BITS | ids_b[b])
    rows.append(np.repeat(row, n_a * n_b))
    times.append(np.ones(len(a), int))
    rows, found, times = np.concatenate(rows), np.concatenate(found), np.concatenate(times)
    key = rows << 2 * BITS | found
    if not any(large):
        key, times = np.unique(key, return_counts=True)
    else:
        key, inverse = np.unique(key, return_inverse=True)
        times = np.bincount(inverse, times, len(key)).astype(int)
    return key >> 2 * BITS, key & ((1 << 2 * BITS) - 1), times


_tokens: dict[tuple[str, str], Tokens] = {}


def tokens_of(byte_bpe: str, pieces: str) -> Tokens:
    if (byte_bpe, pieces) not in _tokens:
        _tokens[byte_bpe, pieces] = Tokens(byte_bpe, pieces)
    return _tokens[byte_bpe, pieces]


def aligned(texts: list[str], tokens: Tokens) -> dict:
    """Of each text n_a, n_b, n_groups, groups (its groups spelled out); row, pair and times of its distinct links."""
    (ids_a, ids_b), (n_a, n_b) = tokens.encode(texts)
    to_a, to_b = common_ends(np.cumsum(tokens.len_a[ids_a]), np.cumsum(tokens.len_b[ids_b]))
    # The end of a text is an end for both tokenizers, so no group lies in two texts.
    row = np.searchsorted(np.cumsum(n_a), to_a, "right")
    n_groups = np.bincount(row, minlength=len(texts))
    to_a, to_b = to_a + 1, to_b + 1
    # Items in the order of the groups: the ids of the first, then those of the second, each with the sign after it.
    group_a = np.searchsorted(to_a, np.arange(len(ids_a)), "right")
    group_b = np.searchsorted(to_b, np.arange(len(ids_b)), "right")
    items = np.empty(len(ids_a) + len(ids_b), int)
    place_a = np.arange(len(ids_a)) + np.append(0, to_b[:-1])[group_a] if len(to_b) else np.empty(0, int)
    place_b = np.arange(len(ids_b)) + to_a[group_b] if len(to_a) else np.empty(0, int)
    items[place_a], items[place_b] = 3 * ids_a, 3 * ids_b
    items[place_a[to_a - 1]] += 1
    items[place_b[to_b - 1]] += 2
    spelled = list(map(tokens.spelled.__getitem__, items.tolist()))
    ends = np.cumsum(n_a + n_b).tolist()
    groups = ["".join(spelled[end - n : end])[:-1] for n, end in zip((n_a + n_b).tolist(), ends, strict=True)]
    where, pair, times = pairs(ids_a, ids_b, to_a, to_b, row)
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "groups": groups, "row": where, "pair": pair, "times": times}


TIMES = np.dtype("<u4")
PAIR = np.dtype("<u4")
COUNT = np.dtype("<i8")


def written(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """Rows of documents (block, id, n_a ... times) and one row of each block (block, pairs, holding): how many of its documents hold a pair."""

    def run(batches):
        tokens = tokens_of(byte_bpe, pieces)
        block, size, held = uuid.uuid4().hex, 0, []
        names = ["block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "holding"]

        def closing():
            pair, count = [], []
            if held:
                pair, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
                count = np.bincount(at, np.concatenate([c for _, c in held])).astype(COUNT)
            row = [block, None, None, None, None, None, None, planes(np.asarray(pair, PAIR)), None, planes(np.asarray(count, COUNT))]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), *[pa.binary()] * 3]
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            lengths = np.cumsum(texts.cast(pa.large_string()).fill_null("").value_lengths().to_numpy() if hasattr(texts, "value_lengths") else [len((t or "").encode()) for t in texts.to_pylist()])
            at = 0
            while at < batch.num_rows:
                before = int(lengths[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(lengths, before + AT_ONCE, "right")))
                some = [t or "" for t in texts.slice(at, to - at).to_pylist()]
                got = aligned(some, tokens)
                border = np.searchsorted(got["row"], np.arange(1, len(some)))
                own_pairs, own_times = np.split(got["pair"].astype(PAIR), border), np.split(got["times"].astype(TIMES), border)
                n_links = np.bincount(got["row"], got["times"], len(some)).astype(np.int64)
                sha = [hashlib.sha256(g.encode()).hexdigest() if n else "" for g, n in zip(got["groups"], got["n_a"].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(some)), ids.slice(at, to - at), *(pa.array(np.asarray(got[c], np.int64)) for c in ("n_a", "n_b", "n_groups")), pa.array(n_links), pa.array(sha, pa.string())]
                    + [pa.array([planes(x) for x in own_pairs], pa.binary()), pa.array([planes(x) for x in own_times], pa.binary()), pa.nulls(len(some), pa.binary())],
                    names,
                )
                held.append(np.unique(got["pair"], return_counts=True))
                size += int(lengths[to - 1]) - before
                if size >= BLOCK_BYTES:
                    yield closing()
                    block, size, held = uuid.uuid4().hex, 0, []
                at = to
        if held:
            yield closing()

    return docs.mapInArrow(run, "block string, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, holding binary")


def opened(blocks: DataFrame) -> DataFrame:
    """(block, pair, holding): one row for each pair of each block."""

    def run(batches):
        for batch in batches:
            for block, pair, holding in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "holding")), strict=True):
                pair = from_planes(pair, PAIR).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(pair), pa.string()), "pair": pair, "holding": from_planes(holding, COUNT)})

    return blocks.select("block", "pairs", "holding").mapInArrow(run, "block string, pair long, holding long")


def align(docs: DataFrame, byte_bpe: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those that either tokenizer changes (its joined
    tokens aren't the text after a space), have no tokens: zeros and an empty
    groups_sha256. Repeated rows are documents of their own and count as such;
    null ids stay null; ties for an id's best partner are all best; no rows
    give no rows; other columns are not read.

    Within a group every token of one side is linked with every token of the
    other, so a text without common ends costs the product of its distinct ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = cut(written(rows, byte_bpe, pieces))
    asked = opened(made.filter("holding is not null"))
    counts = asked.groupBy("pair").agg(F.sum("holding").alias("count"))
    counts = cut(counts.withColumn("a", F.shiftright("pair", BITS)))
    best = counts.groupBy("a").agg(F.max("count").alias("best"))
    counts = counts.join(best, "a").select("pair", "count", (F.col("count") == F.col("best")).alias("best"))
    answers = asked.select("block", "pair").join(counts, "pair").select("block", "pair", "count", "best")
    schema = pa.schema([("id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])

    def add(held: pa.Table, known: pa.Table) -> pa.Table:
        pair, count, best = (known.column(c).to_numpy() for c in ("pair", "count", "best"))
        order = np.argsort(pair)
        pair, count, best = pair[order], count[order], best[order]
        n_best, count_sum = [], []
        for own, times in zip(held.column("pairs").to_pylist(), held.column("times").to_pylist(), strict=True):
            at = np.searchsorted(pair, from_planes(own, PAIR))
            times = from_planes(times, TIMES).astype(np.int64)
            n_best.append(int(times[best[at].astype(bool)].sum()))
            count_sum.append(int(times @ count[at]))
        columns = {c: held.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        columns |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
        return pa.table({c: columns[c] for c in schema.names}, schema=schema)

    out = made.filter("holding is null").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add, "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op11_cross_tokenizer_alignment(spark, sf_dir):
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
