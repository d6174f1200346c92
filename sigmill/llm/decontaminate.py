"""Benchmark decontamination by the CGK embedding.

A benchmark item and a window of its size are walked through at random, each
symbol read deciding by a hash whether the reader moves on. Two sequences at a
small edit distance fall into step again and again, so the walks agree in most
places: edit distance has become Hamming distance. Sampled places of several
walks are keys; windows and items that share a key are compared by their exact
edit distance. How many walks it takes follows from the size of the items and
the recall asked for: for each size, made-up pairs at the most edits allowed
are walked, and walks are added until keys meet often enough.

Symbols are lower-cased words. Windows that no item can be close to are left
out first: by the q-gram lemma a close window shares many runs of `q` words
with its item.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded, codes_of, cut, gram_hashes, mix

Q = 3
#: The map of the items' q-grams has 2^this bits at least and at most: half a megabyte to eight. A full map lets more
#: windows through and loses none.
MAP_BITS = 22, 26
#: Windows embedded at once, and words of theirs.
AT_ONCE, WORDS_AT_ONCE = 4096, 1 << 19
#: Beyond this share of edits an item and its copy need not have a word in common at any place that a window keeps.
MOST_SHARE = 0.45
SAMPLED = 3
#: Made-up pairs of each size, and walks of each, that tell how many walks a recall takes.
TRIALS, TRIAL_WALKS = 96, 24
RATIO = 1.05


def size_class(n: int) -> int:
    """The window size for items of n words: sizes grow by a ratio, so there are few."""
    size = 1
    while size < n:
        size = max(size + 1, int(size * RATIO))
    return size


def allowed(n: int, share: float) -> int:
    return int(n * share)


def run_of(size: int, fewest: int, edits: int) -> tuple[int, int]:
    """(q, n): a window must share n runs of q words with an item of `fewest` words and more; the longest runs of which it must share any.

    An edit destroys at most q runs and shifts at most one out of the window.
    """
    for q in range(min(Q, size), 0, -1):
        n = fewest - q + 1 - (q + 1) * edits
        if n > 0 or q == 1:
            return q, n
    raise AssertionError


def walk(windows: np.ndarray, walks: int):
    """For each step the symbols read by all walks (rows x walks) over each row of word codes (0 pads a row)."""
    n, w = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
    rows = np.arange(n)[:, None]
    at = np.zeros((n, walks), np.int64)
    salt = salts(walks)
    for j in range(3 * w):
        x = padded[rows, np.minimum(at, w)]
        yield x
        at += (mix(x ^ (salt + np.uint64(j * 1_000_003))) & np.uint64(1)).astype(np.int64)


def salts(walks: int) -> np.ndarray:
    return mix(np.arange(1, walks + 1, dtype=np.uint64) * np.uint64(7919))


def embed_keys(windows: np.ndarray, walks: int) -> np.ndarray:
    """A key of each walk for each row of word codes (0 pads a row)."""
    n, w = windows.shape
    salt = salts(walks)
    chosen = (mix(salt[:, None] + np.arange(SAMPLED, dtype=np.uint64)) % np.uint64(3 * w)).astype(np.int64)
    key = np.repeat(salt[None, :] ^ np.uint64(w), n, axis=0)
    with np.errstate(over="ignore"):
        for j, x in enumerate(walk(windows, walks)):
            hit = (chosen == j).any(1)
            if hit.any():
                key[:, hit] = mix(key[:, hit] * np.uint64(0x9E3779B97F4A7C15) + x[:, hit] + np.uint64(j))
    return key.view(np.int64)


@lru_cache(maxsize=1024)
def walks_for(size: int, share: float, recall: float) -> int:
    """How many walks find a pair of this size at the most edits, of the kind that is hardest, with a chance of `recall`.

    Deletions are hardest: they part the walks as others do and let strange
    words into the window. The pairs are made up from a fixed seed, so every
    task and every run comes to the same number.
    """
    edits = allowed(size, share)
    if not edits:
        return 1
    r = np.random.default_rng(size)
    items = r.integers(1, 1 << 62, (TRIALS, size)).astype(np.uint64)
    worn = np.zeros_like(items)
    for item, row in zip(items, worn, strict=True):
        left = np.delete(item, r.choice(size, edits, replace=False))
        row[: len(left)] = left
        row[len(left) :] = r.integers(1, 1 << 62, edits).astype(np.uint64)
    same = np.zeros((TRIALS, TRIAL_WALKS))
    for x, y in zip(walk(items, TRIAL_WALKS), walk(worn, TRIAL_WALKS), strict=True):
        same += x == y
    meets = ((same / (3 * size)) ** SAMPLED).mean(1)
    walks = 1
    while (1 - (1 - meets) ** walks).mean() < recall:
        walks += 1
    return walks


def edit_distance_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of `item` to any part of `text`, and where that part ends."""
    row = np.zeros(len(text) + 1, np.int64)
    places = np.arange(len(text) + 1)
    for i, x in enumerate(item, 1):
        new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (text != x)]))
        row = np.minimum.accumulate(new - places) + places
    end = int(row.argmin())
    return int(row[end]), end


def windows_of(grams: dict[int, np.ndarray], bitmap: np.ndarray, sizes: list[tuple[int, int, int]]):
    """(starts, size) of the windows worth embedding: all that share enough q-grams with items of their size.

    grams: hashes of a text's runs, by their number of words. sizes: (size,
    q, fewest shared q-grams) of each class of items.
    """
    hits = {}
    for q in {q for _, q, _ in sizes}:
        mine = [(size, least) for size, own, least in sizes if own == q]
        at = np.flatnonzero(is_set(bitmap, grams[q]))
        if dense(at, min(least for _, least in mine), max(size for size, _ in mine) - q + 1):
            hits[q] = at
    for size, q, least in sizes:
        if q not in hits:
            continue
        span = size - q + 1
        own = hits[q][is_set(bitmap, of_class(grams[q][hits[q]], size))]
        if not dense(own, least, span):
            continue
        reach = np.arange(max(0, own[0] - span + 1), own[-1] + 1)
        count = np.searchsorted(own, reach + span) - np.searchsorted(own, reach)
        yield reach[count >= least], size


def dense(places: np.ndarray, least: int, span: int) -> bool:
    """Whether any `span` neighbouring places hold `least` of these."""
    return len(places) >= least and bool((places[least - 1 :] - places[: len(places) - least + 1] < span).any())


def of_class(grams: np.ndarray, size: int) -> np.ndarray:
    """The q-grams as those of items of one size class."""
    return mix(grams ^ np.uint64(size << 32))


def is_set(bitmap: np.ndarray, grams: np.ndarray) -> np.ndarray:
    place = grams & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def gram_map(items: DataFrame, run_words: dict[int, int]) -> np.ndarray:
    """Bits of the items' q-grams, alone and with their size class, a sixteenth of all at most while the map can grow.

    At most 2^26 numbers reach the driver.
    """
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n_bits = min(max((32 * words).bit_length(), MAP_BITS[0]), MAP_BITS[1])

    def run(batches):
        for batch in batches:
            found = [np.empty(0, np.uint64)]
            for t in batch.column("text").to_pylist():
                c = codes_of(t, lower=True)
                size = size_class(len(c))
                g = gram_hashes(c, run_words.get(size, 1))
                found += [g, of_class(g, size)]
            bits = np.unique(np.concatenate(found) & np.uint64((1 << n_bits) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(bits.astype(np.int32))], ["bit"])

    bits = np.zeros(1 << n_bits, np.uint8)
    for part in items.select("text").mapInArrow(run, "bit int").distinct().toArrow().column("bit").chunks:
        bits[part.to_numpy()] = 1
    return np.packbits(bits, bitorder="little")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    share: float = 0.15,
    recall: float = 0.95,
) -> DataFrame:
    """(id, item, distance, item_words, start_word): items that a text holds within share x words edits.

    One row per pair of text row and item that match, with the least distance
    and the first place found. Null texts, null items and empty ones match nothing; rows with null ids and
    repeated ids are matched like others, repeated rows once per id; no rows on
    either side give no rows; other columns are not read.

    A pair at the largest allowed distance is found with a chance of `recall`,
    nearer ones with more, equal ones always; items too short for an edit are
    found by equality. The number of walks follows from the item's size. Shares
    from MOST_SHARE on are refused.
    """
    if not 0 <= share < MOST_SHARE:
        raise ValueError(f"share must be below {MOST_SHARE}")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(item_text_col, F.lit("")).alias("text"))
    def item_rows(batches):
        for batch in batches:
            out = []
            for i, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                c = codes_of(t, lower=True)
                if len(c):
                    out.append((i, c.tobytes(), size_class(len(c))))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int32()), strict=True)], ["item", "item_codes", "size"])

    known = cut(items.mapInArrow(item_rows, "item long, item_codes binary, size int"))
    words = F.octet_length("item_codes") / 8
    spans = known.groupBy("size").agg(F.min(words).alias("lo"), F.max(words).alias("hi")).collect()
    sizes = sorted((r["size"], *run_of(r["size"], int(r["lo"]), allowed(int(r["hi"]), share))) for r in spans)
    bitmap = gram_map(items, {size: q for size, q, _ in sizes})
    runs = {q for _, q, _ in sizes}
    walks = {size: walks_for(size, share, recall) for size, *_ in sizes}

    def item_keys(batches):
        for batch in batches:
            out = []
            for codes, size in zip(batch.column("item_codes").to_pylist(), batch.column("size").to_pylist(), strict=True):
                row = np.zeros((1, size), np.uint64)
                row[0, : len(codes) // 8] = np.frombuffer(codes, np.uint64)
                out.append(embed_keys(row, walks[size])[0])
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(out, pa.list_(pa.int64()))], ["item", "keys"])

    keyed = known.mapInArrow(item_keys, "item long, keys array<long>")

    def regions(size, found):
        """A row per part of a text: what all windows that start in it can match, and their keys."""
        places = [(c, start) for _, starts, c in found for start in starts]
        step, keys, slack = max(1, min(AT_ONCE, WORDS_AT_ONCE // size)), [], max(size // 3, int(size * share)) + 1
        for at in range(0, len(places), step):
            w = np.zeros((len(places[at : at + step]), size), np.uint64)
            for row, (c, start) in zip(w, places[at : at + step], strict=True):
                part = c[start : start + size]
                row[: len(part)] = part
            keys.append(embed_keys(w, walks[size]))
        keys = np.concatenate(keys)
        out, at = [], 0
        for i, starts, c in found:
            lo = max(0, int(starts[0]) - slack)
            out.append((i, lo, c[lo : int(starts[-1]) + size + slack].tobytes(), np.unique(keys[at : at + len(starts)])))
            at += len(starts)
        ids, los, texts, all_keys = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(los, pa.int64()), pa.array(texts, pa.binary()), pa.array(all_keys, pa.list_(pa.int64()))], ["id", "start", "codes", "keys"])

    def doc_windows(batches):
        found: dict[int, list] = {}
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for row, counts, codes in coded(batch.column("text"), lower=True) if sizes else ():
                grams = {q: gram_hashes(codes, q) for q in runs}
                # Only texts with a run of some item are looked at one by one.
                touched = np.zeros(len(codes), np.int64)
                for q in runs:
                    touched[: len(grams[q])] |= is_set(bitmap, grams[q])
                ends, total = np.cumsum(counts), np.concatenate([[0], np.cumsum(touched)])
                for k in np.flatnonzero(total[ends] > total[ends - counts]).tolist():
                    lo, hi, i = int(ends[k] - counts[k]), int(ends[k]), ids[row + k]
                    c = codes[lo:hi]
                    for starts, size in windows_of({q: grams[q][lo : max(lo, hi - q + 1)] for q in runs}, bitmap, sizes):
                        mine = found.setdefault(size, [])
                        for part in np.split(starts, np.flatnonzero(np.diff(starts // size)) + 1):
                            if len(part):
                                mine.append((i, part, c))
                            if sum(len(x) for _, x, _ in mine) >= AT_ONCE:
                                yield regions(size, mine)
                                mine.clear()
            for size, mine in found.items():
                if mine:
                    yield regions(size, mine)
                    mine.clear()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    windows = rows.mapInArrow(doc_windows, "id long, start long, codes binary, keys array<long>")
    windows = cut(windows.withColumn("window", F.xxhash64("id", "start", "codes", "keys")).dropDuplicates(["window"]))
    met = windows.select("window", F.explode("keys").alias("key")).join(keyed.select("item", F.explode("keys").alias("key")), "key").select("window", "item").distinct()

    def verify(batches):
        for batch in batches:
            out = []
            for i, item, start, codes, want in zip(*(batch.column(c).to_pylist() for c in ("id", "item", "start", "codes", "item_codes")), strict=True):
                want = np.frombuffer(want, np.uint64)
                d, end = edit_distance_within(want, np.frombuffer(codes, np.uint64))
                if d <= allowed(len(want), share):
                    out.append((i, item, d, len(want), max(0, start + end - len(want))))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "item", "distance", "item_words", "start_word"])

    checked = met.join(windows.select("window", "id", "start", "codes"), "window").join(known.select("item", "item_codes"), "item")
    hits = checked.mapInArrow(verify, "id long, item long, distance long, item_words long, start_word long")
    best = hits.groupBy("id", "item").agg(F.min(F.struct("distance", "start_word", "item_words")).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col if item_col != id_col else "item"), "m.distance", "m.item_words", "m.start_word")


def op6_benchmark_decontamination(spark, sf_dir):
    from .common import table

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
