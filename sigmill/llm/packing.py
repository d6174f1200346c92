"""Best-fit packing by a configuration linear program over the length histogram.

Documents become pieces of at most `capacity` tokens. Only the histogram of
their lengths, `capacity` counts whatever the corpus, goes to the driver. There
a covering program over configurations (multisets of lengths that fit one
sequence) is solved by multiplicative weights: a length's
price is its size and a premium whose weight falls with the share of it that is
covered; an unbounded-knapsack dynamic program finds configurations of most
price, and these are used until one of their lengths is covered by a step more.
The fractional solution is rounded, and what is left is filled greedily, best
fit first. Pieces then take their places by rank within their length, ranked
without any task seeing a whole length; full ones are sequences by themselves.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: The cache of a worker: distinct space-delimited units and their ids, some 200 bytes each.
CACHE_UNITS = 1_000_000
#: Pieces of one length that are ranked together.
RANKED = 1_000_000
#: (premium, rate, step) of the programs that are solved. The premium is what a long piece may be worth above its
#: tokens: little where many lengths fit each other, much where few do.
PROGRAMS = ((0.001, 1.0, 0.5), (0.3, 1.0, 0.5), (0.3, 0.3, 1.0))
#: Shares of the program's sequences that are tried beside best fit for the rest.
KEPT = (1, 0.98, 0.95, 0.9, 0.8, 0.6, 0.3, 0)


class Encoder:
    """ids of whole texts, as little-endian 32-bit bytes, by a byte-level BPE file.

    The pre-tokenizer never joins what a single space between two other
    characters parts, so such a unit (with its leading space) is encoded once
    and remembered. New units are encoded as one text and parted again at the
    ids that begin with a space, of which each unit has one. Texts with other
    white space beside a space, or with an added token, are encoded whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.begins[i] = token.startswith("\u0120")
        # What a text begins with, and what follows a space.
        self.first: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, first: set[str], inner: set[str]) -> None:
        """Encodes new units; those beside other white space can't be parted and stay unknown."""
        starts, others = ([u for u in new if u and not u[0].isspace() and not u[-1].isspace()] for new in (first, inner))
        self.first.update(zip(starts, (ids.tobytes() for ids in self._ids(starts)), strict=True))
        for at in range(0, len(others), 500):
            part = others[at : at + 500]
            ids = self._ids([" " + " ".join(part)])[0]
            begins = (4 * np.flatnonzero(self.begins[ids])).tolist()
            raw, ends = ids.tobytes(), [*begins[1:], 4 * len(ids)]
            self.inner.update(zip(part, [raw[x:y] for x, y in zip(begins, ends, strict=True)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = {k: t.split(" ") for k, t in enumerate(texts) if not any(x in t for x in self.special)}
        ids: dict[int, list] = {}
        first, inner = set(), set()
        if len(self.first) + len(self.inner) > CACHE_UNITS:
            self.first.clear(), self.inner.clear()
        for k, parts in plain.items():
            ids[k] = found = [self.first.get(parts[0]), *map(self.inner.get, parts[1:])]
            if None in found:
                first.add(parts[0])
                inner.update(u for u, x in zip(parts, found, strict=True) if x is None)
        self._learn(first, inner)
        out = []
        for k, t in enumerate(texts):
            found = ids.get(k, [None])
            if None in found and k in plain:
                found[0] = self.first.get(plain[k][0])
                for i in [i for i, x in enumerate(found) if x is None and i]:
                    found[i] = self.inner.get(plain[k][i])
            out.append(self._ids([t])[0].tobytes() if None in found else b"".join(found))
        return out


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones after a shorter first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    ends = [(0, first)] if first else []
    return ends + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every row of `docs`."""

    def run(batches):
        encoder = _encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                out = []
                for i, ids in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    ids += end
                    for k, (s, n) in enumerate(cut_points(len(ids) // 4, capacity)):
                        out.append((i, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])))
                cols = list(zip(*out, strict=True)) or [[]] * 5
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


Configuration = tuple[tuple[int, int], ...]


def best_configurations(price: np.ndarray, capacity: int, most: int) -> tuple[list[Configuration], float]:
    """Up to `most` configurations ((length, how many), ...) of most price, best first, and the price of the best.

    price[l - 1] is that of length l; lengths without a price are left out. One
    table of the dynamic program gives, for each length, the best that holds it.
    """
    live = np.flatnonzero(price > 0) + 1
    value = np.where(price > 0, price, -np.inf)
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(int(live[0]), capacity + 1):
        gain = value[:c] + best[c - 1 :: -1]
        i = int(gain.argmax())
        if gain[i] > best[c - 1]:
            best[c], took[c] = gain[i], i + 1
        else:
            best[c] = best[c - 1]
    top, out = price[live - 1] + best[capacity - live], []
    for i in np.argsort(-top, kind="stable")[:most]:
        used, c = Counter({int(live[i]): 1}), capacity - int(live[i])
        while c > 0:
            l = int(took[c])
            used[l] += l > 0
            c -= l or 1
        out.append(tuple(sorted((+used).items(), reverse=True)))
    return out, float(top.max())


def best_fit(left: np.ndarray, capacity: int) -> Counter:
    """Sequences filled best fit first, equal ones together, for counts by length."""
    left, out = left.copy(), Counter()
    while left.any():
        room, used, free = capacity, Counter(), left.copy()
        while room and len(fit := np.flatnonzero(free[:room])):
            l = int(fit[-1]) + 1
            n = min(room // l, int(free[l - 1]))
            used[l] += n
            free[l - 1] -= n
            room -= n * l
        times = min(int(left[l - 1]) // n for l, n in used.items())
        for l, n in used.items():
            left[l - 1] -= n * times
        out[tuple(sorted(used.items(), reverse=True))] += times
    return out


def covering(counts: np.ndarray, capacity: int, premium: float = 0.001, rate: float = 1.0, step: float = 0.5, most: int = 64) -> dict[Configuration, float]:
    """How often each configuration is used, in fractions that cover every count exactly.

    Multiplicative weights for min sum x_C with sum_C a_Cl x_C >= counts_l. A
    price is the share s of a sequence that the length takes, and on top of it
    premium * s^2 times the length's weight, which is multiplied by
    e^(-rate * the share of the count just covered); 0 once it is covered. s
    alone is the dual solution of the bound "tokens / capacity"; the premium
    uses long pieces, which few others fit, while short ones are at hand.
    Configurations found before serve as long as one is near the best price at
    the last pricing, which no later price exceeds.
    """
    need, size, slack = counts.astype(float), np.arange(1, capacity + 1) / capacity, min(1e-3, premium / 10)
    share, weight = np.zeros(capacity), np.ones(capacity)
    price = np.append(np.where(counts > 0, size * (1 + premium * size), -np.inf), 0.0)
    found: dict[Configuration, int] = {}
    lengths, times, used = np.full((most, 4), capacity), np.zeros((most, 4)), []
    best = 0.0
    while (price[:-1] > 0).any():
        with np.errstate(invalid="ignore"):
            worth = np.where(times > 0, price[lengths] * times, 0.0).sum(1)
        j = int(worth.argmax())
        if not used or worth[j] <= 0 or worth[j] < (1 - slack) * best:
            new, best = best_configurations(price[:-1], capacity, most)
            for conf in new:
                if conf in found:
                    continue
                found[conf] = len(used)
                used.append(0.0)
                if len(used) > len(lengths) or len(conf) > lengths.shape[1]:
                    more = (len(lengths) if len(used) > len(lengths) else 0, max(0, len(conf) - lengths.shape[1]))
                    lengths = np.pad(lengths, ((0, more[0]), (0, more[1])), constant_values=capacity)
                    times = np.pad(times, ((0, more[0]), (0, more[1])))
                at = found[conf]
                lengths[at, : len(conf)], times[at, : len(conf)] = np.array(conf).T - [[1], [0]]
            j = found[new[0]]
        mine = times[j] > 0
        l, a = lengths[j][mine], times[j][mine]
        x = min(step * (need[l] / a).min(), ((1 - share[l]) * need[l] / a).min())
        used[j] += x
        share[l] += a * x / need[l]
        weight[l] *= np.exp(-rate * a * x / need[l])
        price[l] = np.where(share[l] > 1 - 1e-9, -np.inf, size[l] * (1 + premium * size[l] * weight[l]))
    return {conf: used[j] for conf, j in found.items() if used[j] > 0}


def rounded(solution: dict[Configuration, float], counts: np.ndarray) -> tuple[Counter, np.ndarray]:
    """Whole uses of configurations, and the counts they leave: rounded down, then one more of each that still fits, largest fraction first."""
    left, out = counts.copy(), Counter()
    for wanted, order in ((int, lambda u: (-u[1], u[0])), (lambda x: 1, lambda u: (-(u[1] % 1), u[0]))):
        for conf, x in sorted(solution.items(), key=order):
            n = min(wanted(x), *(int(left[l - 1]) // a for l, a in conf))
            if n > 0:
                out[conf] += n
                for l, a in conf:
                    left[l - 1] -= a * n
    return out, left


def configurations(counts: np.ndarray, capacity: int) -> tuple[list[tuple[Configuration, int]], int]:
    """(configuration, how many sequences use it), covering `counts` exactly; and how many of them the program and full pieces gave.

    Pieces of full length are sequences as they are. The rest
    is solved for each of PROGRAMS and rounded; what rounding leaves, and with
    it as small a share of the program's sequences as makes the fewest in all,
    is filled by best fit. So they are never more than best fit alone needs.
    """
    whole, counts = int(counts[-1]), np.append(counts[:-1], 0)
    plan, by_program = Counter(), 0
    if counts.any():
        plan, by_program = min((p for how in PROGRAMS for p in finished(covering(counts, capacity, *how), counts, capacity)), key=lambda p: (p[0].total(), -p[1]))
    full = [(((capacity, 1),), whole)] if whole else []
    return full + sorted(plan.items(), reverse=True), by_program + whole


def finished(solution: dict[Configuration, float], counts: np.ndarray, capacity: int):
    """(all sequences, how many are the program's) for each of KEPT, those with least room kept longest."""
    out, left = rounded(solution, counts)
    room = sorted(out, key=lambda c: (capacity - sum(l * a for l, a in c), c))
    for share in KEPT:
        kept, rest, n = Counter(), left.copy(), int(share * out.total())
        for conf in room:
            kept[conf] = min(out[conf], n)
            n -= kept[conf]
            for l, a in conf:
                rest[l - 1] += a * (out[conf] - kept[conf])
        yield +kept + best_fit(rest, capacity), kept.total()


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A row's ids are those of its text and then `end_id`, so null and empty texts
    are one piece of one id. Null ids and repeated rows are packed like others;
    no rows give no rows; other columns are not read. Texts longer than
    `capacity` are cut into full pieces after a shorter first one.

    The driver sees `capacity` counts and solves the program there; the places
    it hands back are a table of (length, configuration), at most a few
    thousand rows whatever the corpus. A full piece is a sequence by itself,
    with a number below 0, and needs no rank. Shorter ones are ranked by at most
    about a million of a length in a task; the table of the counts of these
    parts, one row each, is broadcast.
    """
    ps = cut(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    counts = np.zeros(capacity, np.int64)
    for r in ps.filter(F.col("length") < capacity).groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"] - 1] = r["n"]
    parts = F.get(F.lit((-(-counts // RANKED)).tolist()), (F.col("length") - 1).cast("int"))
    bucket = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.greatest(parts, F.lit(1))).cast("int")
    short = ps.filter(F.col("length") < capacity).withColumn("bucket", bucket)
    by_bucket = short.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots: dict[int, list] = {}
    taken = np.zeros(capacity, np.int64)
    base = 0
    for conf, times in configurations(counts, capacity)[0]:
        at = 0
        for l, n in conf:
            slots.setdefault(l, []).append((taken[l - 1], n, base, at))
            taken[l - 1] += n * times
            at += l * n
        base += times
    places = {l: np.array(s, np.int64) for l, s in slots.items()}

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for l in np.unique(length):
                mine = np.flatnonzero(length == l)
                table = places[int(l)]
                row = table[np.searchsorted(table[:, 0], rank[mine], "right") - 1]
                k = rank[mine] - row[:, 0]
                seq[mine] = row[:, 2] + k // row[:, 1]
                off[mine] = row[:, 3] + k % row[:, 1] * l
            kept = batch.select(["id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(seq), pa.array(off)], [*kept.schema.names, "sequence_id", "offset"])

    first = by_bucket.select("length", "bucket", before.alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = short.withColumn("r", F.row_number().over(order) - 1).join(F.broadcast(first), ["length", "bucket"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("r") + F.col("before")).cast("long").alias("rank"))
    out = ranked.mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    full = ps.filter(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return out.union(full).withColumnRenamed("id", id_col)


def op7_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    from .common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
