"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are its own and those of its
neighbours; adjacent labels depend on each other. Forward-backward marginals,
weighted by line length, make a document's quality, which a two-parameter
calibration turns into the probability of label 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGIT = bytes(range(48, 58))
SPACE = b" \t\n\r\x0b\x0c"
HIGH = bytes(range(128, 256))
OTHER = bytes(c for c in range(128) if bytes([c]) not in {bytes([x]) for x in UPPER + LOWER + DIGIT + SPACE})
OWN = 16
WIDTH = 3 * OWN + 5


def own_features(line: str, seen: int) -> list[float]:
    """Of one line alone; `seen`: earlier equal lines of its document."""
    b = line.encode("utf-8", "surrogatepass")
    n = len(b) or 1
    words = b.split()
    k = len(words)
    m = k or 1
    count = lambda drop: (len(b) - len(b.translate(None, drop))) / n
    low = b.lower().split()
    follow = sum(map(bytes.__eq__, low, low[1:]))
    symbols = count(OTHER)
    return [
        math.log1p(len(b)),
        math.log1p(k),
        (len(b) - k) / m / 8,
        count(UPPER),
        count(DIGIT),
        symbols,
        min(1.0, 4 * symbols),
        count(HIGH),
        len(set(low)) / m,
        follow / m,
        sum(len(w) <= 3 for w in words) / m,
        sum(len(w) == 1 for w in words) / m,
        sum(len(w) > 14 for w in words) / m,
        1.0 if b.rstrip().endswith((b".", b"!", b"?", b":")) else 0.0,
        min(seen, 5) / 5,
        1.0 if k == 0 else 0.0,
    ]


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) of the lines of a text; an empty text is one empty line."""
    lines = text.split("\n")
    seen: dict[str, int] = {}
    own = np.empty((len(lines), OWN))
    for i, line in enumerate(lines):
        k = seen.get(line, 0)
        seen[line] = k + 1
        own[i] = own_features(line, k)
    out = np.zeros((len(lines), WIDTH))
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[0, 3 * OWN] = out[-1, 3 * OWN + 1] = 1
    out[:, 3 * OWN + 2] = math.log1p(len(lines))
    out[:, 3 * OWN + 3] = math.log1p(len(text))
    out[:, 3 * OWN + 4] = 1
    return out, np.array([len(x) + 1.0 for x in lines])


def _steps(lengths: np.ndarray):
    """Sequences longest first; for each step, how many reach it and where its rows are."""
    order = np.argsort(-lengths, kind="stable")
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
    size = lengths[order]
    return first, [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]))]


def _log_add(a, b):
    top = np.maximum(a, b)
    return top + np.log1p(np.exp(-np.abs(a - b)))


def marginals(score: np.ndarray, trans: np.ndarray, lengths: np.ndarray):
    """(P(good) of each line, expected transitions, log normaliser summed) of many sequences at once.

    score: log-odds of good for each line; trans: 2 x 2 scores of (label, next).
    """
    first, alive = _steps(lengths)
    n = len(score)
    u = np.stack([np.zeros(n), score], 1)
    a, z = np.empty((n, 2)), np.zeros((n, 2))
    a[first] = u[first]
    for t in range(1, len(alive)):
        at = first[: alive[t]] + t
        p = a[at - 1]
        for y in (0, 1):
            a[at, y] = u[at, y] + _log_add(p[:, 0] + trans[0, y], p[:, 1] + trans[1, y])
    total = 0.0
    pair = np.zeros((2, 2))
    logz = np.empty(n)
    last = np.concatenate([[0], np.cumsum(lengths)[:-1]]) + lengths - 1
    norm = _log_add(a[last, 0], a[last, 1])
    logz = np.repeat(norm, lengths)
    total = norm.sum()
    for t in range(len(alive) - 1, 0, -1):
        at = first[: alive[t]] + t
        ahead = u[at] + z[at]
        for x in (0, 1):
            for y in (0, 1):
                pair[x, y] += np.exp(np.minimum(a[at - 1, x] + trans[x, y] + ahead[:, y] - logz[at], 0)).sum()
            z[at - 1, x] = _log_add(trans[x, 0] + ahead[:, 0], trans[x, 1] + ahead[:, 1])
    return np.exp(np.minimum(a[:, 1] + z[:, 1] - logz, 0)), pair, total


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    offset: float

    def quality(self, x: np.ndarray, lengths: np.ndarray, line_weights: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each document."""
        p, _, _ = marginals(((x - self.mean) / self.scale) @ self.weights, self.trans, lengths)
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return np.add.reduceat(p * line_weights, at) / np.add.reduceat(line_weights, at)

    def score(self, x, lengths, line_weights) -> np.ndarray:
        q = np.clip(self.quality(x, lengths, line_weights), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(q / (1 - q)) + self.offset)))


def fit(x: np.ndarray, lengths: np.ndarray, line_weights: np.ndarray, labels: np.ndarray, steps: int = 250, rate: float = 0.05, ridge: float = 1e-3) -> Model:
    """Maximum likelihood by full-batch Adam; every line of a labelled document carries its label.

    Each document counts once however many lines it has.
    """
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    z = (x - mean) / scale
    y = np.repeat(labels, lengths).astype(float)
    each = np.repeat(1 / lengths, lengths)
    n = len(lengths)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    gold = np.zeros((2, 2))
    for k in (0, 1):
        gold[k, k] = (lengths - 1)[labels == k].sum()
    m = [np.zeros_like(w), np.zeros_like(trans)]
    v = [np.zeros_like(w), np.zeros_like(trans)]
    for i in range(1, steps + 1):
        p, pair, _ = marginals(z @ w, trans, lengths)
        grads = [z.T @ ((y - p) * each) / n - ridge * w, (gold - pair) / max(1, len(x)) - 0.05 * trans]
        for k, (g, target) in enumerate(zip(grads, (w, trans), strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            target += rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
    model = Model(mean, scale, w, trans, 1.0, 0.0)
    q = np.clip(model.quality(x, lengths, line_weights), 1e-6, 1 - 1e-6)
    t = np.log(q / (1 - q))
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab[0] * t + ab[1], -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(s * t * t).sum(), (s * t).sum()], [(s * t).sum(), s.sum()]]) + np.eye(2)
        ab = ab + np.linalg.solve(h, np.array([((labels - p) * t).sum() - ab[0] + 1, (labels - p).sum() - ab[1]]))
    model.slope, model.offset = max(float(ab[0]), 0.05), float(ab[1])
    return model


def held_out(id_col: str, folds: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", folds=5, max_docs=4000, max_chars=20_000) -> Model | None:
    """Fits on a bounded sample of the labelled rows outside the held-out fold.

    The sample: the `max_docs` labelled ids of smallest hash, of texts of at
    most `max_chars` characters, so the driver gets at most their product.
    Returns None when there is nothing to learn from.
    """
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().filter(~held_out("id", folds))
    ids = ids.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_docs)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).filter(F.char_length("text") <= max_chars)
    got = rows.join(F.broadcast(ids), "id").select("id", "text", "y").toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    if not got.num_rows:
        return None
    parts = [line_features(t) for t in got.column("text").to_pylist()]
    lengths = np.array([len(x) for x, _ in parts])
    return fit(np.concatenate([x for x, _ in parts]), lengths, np.concatenate([w for _, w in parts]), got.column("y").to_numpy())


def score_texts(model: Model | None, texts: list[str | None], at_once: int = 20_000) -> np.ndarray:
    """Scores of texts, in groups of about `at_once` lines."""
    if model is None:
        return np.full(len(texts), 0.5)
    out, x, w, lengths, lines = [], [], [], [], 0

    def flush():
        if lengths:
            out.append(model.score(np.concatenate(x), np.array(lengths), np.concatenate(w)))
            x.clear(), w.clear(), lengths.clear()

    for text in texts:
        f, g = line_features(text or "")
        x.append(f), w.append(g), lengths.append(len(f))
        lines += len(f)
        if lines >= at_once:
            flush()
            lines = 0
    flush()
    return np.concatenate(out) if out else np.empty(0)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col="doc_id", text_col="text", label_col="quality", folds=5, **sample) -> DataFrame:
    """`docs` with score (probability of label 1) and predicted (score >= threshold) added.

    Null and empty texts are one empty line and get that line's score; null ids
    and repeated rows are kept; without labels every score is 0.5; no rows give
    no rows. Columns of `docs` named score or predicted are replaced.
    """
    model = train(docs, labels, id_col, text_col, label_col, folds, **sample)
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            s = score_texts(model, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype("int32"))], [*batch.schema.names, "score", "predicted"])

    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def op10_quality_classifier(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id", 5).alias("held_out"), "score", "predicted")
