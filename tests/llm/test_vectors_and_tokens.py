"""Alignment of tokenizers, near-duplicate vectors and whitening against brute force, odd rows and no rows."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from sigmill.llm import align, quantized, queries, whitening

from .conftest import make

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "<|endoftext|> x", "a  b", "  lead", "trail  ", "\n\n", "\t", " ", "x \n y", "a  b", "日本語 テスト", "\U0001f600 \U0001f600\U0001f600", "<s> <unk> <0x0A>", "ﬁ Å é",
    "a▁b ▁", "\x00 \x1c a", "x​ y", "naïve " * 50, "0" * 3000, "z9" * 2000, "﻿hi", "a\u0085 b", "don't  'll 's", None, "", "\r\n a", "a b 　 c",
]
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


# 11: alignment
def brute_alignment(texts):
    """Whole texts by both libraries, groups by sets of ends, counts by dictionaries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_model.encode_special_tokens = True
    of = align.byte_level()
    bytes_a = {i: bytes(of[c] for c in t) for t, i in a_model.get_vocab().items() if all(c in of for c in t)}

    def bytes_b(i):
        p = b_model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()

    found, held = [], Counter()
    for t in texts:
        raw = (" " + (t or "")).encode()
        a, b = (a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)) if t else ([], [])
        if not t or b"".join(bytes_a[i] for i in a) != raw or b"".join(map(bytes_b, b)) != raw:
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(bytes_a[i]) for i in a]).tolist(), np.cumsum([len(bytes_b(i)) for i in b]).tolist()
        groups, i, j = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            to_i, to_j = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append((a[i:to_i], b[j:to_j]))
            i, j = to_i, to_j
        links = Counter((p, q) for x, y in groups for p in x for q in y)
        held.update(set(links))
        found.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    out = []
    for f in found:
        if f is None:
            out.append((0,) * 6 + ("",))
            continue
        n_a, n_b, groups, links = f
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), links.total(), sum(n for k, n in links.items() if held[k] == best[k[0]]), sum(n * held[k] for k, n in links.items()), hashlib.sha256(spelled.encode()).hexdigest()))
    return out


def test_common_ends_equal_set_intersection(monkeypatch):
    r = np.random.default_rng(0)
    for k in range(400):
        monkeypatch.setattr(align, "STRETCH", int(r.choice([1, 2, 7, 64])))
        monkeypatch.setattr(align, "LONGEST", int(r.choice([1, 2, 32])))
        n, keep = int(r.integers(1, 1500)), r.uniform(0.1, 1, 2)
        both = np.flatnonzero(r.random(n) < (0.9 if k % 2 else 0))
        a, b = (np.union1d(np.append(both, n), np.flatnonzero(r.random(n) < p)) for p in keep)
        i, j = align.common_ends(a, b)
        _, want_i, want_j = np.intersect1d(a, b, return_indices=True)
        assert i.tolist() == want_i.tolist() and j.tolist() == want_j.tolist()


def test_alignment_equals_brute_force_on_odd_texts(spark, words, monkeypatch):
    texts = [*ODD, *ODD, " ".join(words[:300]), "x\n".join(words[:90]), "one"]
    rows = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    want = {i if i else None: w for i, w in enumerate(brute_alignment(texts))}
    for large in (1 << 16, 0):
        monkeypatch.setattr(align, "LARGE_GROUP", large)
        got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.align(rows, BYTE_BPE, PIECES).collect()}
        assert got == want


def test_large_groups_and_forgotten_words_change_nothing(words, monkeypatch):
    texts = [t or "" for t in ODD] + [" ".join(words[i : i + 60]) for i in range(0, 300, 20)]
    tokens = align.Tokens(BYTE_BPE, PIECES)
    want = align.aligned(texts, tokens)
    monkeypatch.setattr(align, "LARGE_GROUP", 0)
    by_ids = align.aligned(texts, tokens)
    monkeypatch.setattr(align, "CACHE_UNITS", 5)
    again = align.aligned(texts, align.Tokens(BYTE_BPE, PIECES))
    for got in (by_ids, again):
        assert got["groups"] == want["groups"] and all(np.array_equal(got[c], want[c]) for c in ("n_a", "n_b", "n_groups", "row", "pair", "times"))


def test_blocks_of_one_document_count_as_one_corpus(spark, docs, corpus, monkeypatch):
    """Repeated rows are documents of their own; blocks of any size give the same counts."""
    texts = [t for _, t, *_ in corpus]
    want = sorted(zip((i for i, *_ in corpus), brute_alignment(texts), strict=True), key=str)
    got = sorted(((r.doc_id, tuple(r[c] for c in COLUMNS)) for r in align.align(docs, BYTE_BPE, PIECES).collect()), key=str)
    assert got == want
    small = list(align.written(docs.limit(3).select(docs["doc_id"].alias("id"), "text"), BYTE_BPE, PIECES).collect())
    assert sum(r.holding is not None for r in small) >= 1 and sum(r.holding is None for r in small) == 3


# 12: near-duplicate vectors
def brute_links(vectors, cosine):
    """(links, least row number reachable) by all pairs; None vectors are linked with nothing."""
    n = len(vectors)
    v = [None if x is None or any(e is None or not math.isfinite(e) for e in x) or not any(x) else np.array(x, float) for x in vectors]
    d = max((len(x) for x in v if x is not None), default=0)
    unit = np.zeros((n, d))
    for i, x in enumerate(v):
        if x is not None:
            x = x / np.abs(x).max()
            unit[i, : len(x)] = x / np.linalg.norm(x)
    hit = unit @ unit.T >= cosine
    np.fill_diagonal(hit, False)
    label = list(range(n))
    for i, j in zip(*np.nonzero(hit), strict=True):
        a, b = label[i], label[j]
        if a != b:
            label = [min(a, b) if x in (a, b) else x for x in label]
    return hit.sum(1).tolist(), label


def near_rows(r, d=24):
    """Pairs just above and just below the cosine in every direction, a tight crowd, a loose one, a chain and copies."""
    rows = [r.standard_normal(d) for _ in range(150)]
    for c in (0.9001, 0.9002, 0.8999, 0.8998, 0.95):
        for x in rows[:60]:
            x = x / np.linalg.norm(x)
            w = r.standard_normal(d)
            w -= (w @ x) * x
            rows.append(3 * (c * x + math.sqrt(1 - c * c) * w / np.linalg.norm(w)))
    crowd, loose = r.standard_normal(d), r.standard_normal(d)
    rows += [crowd + 0.1 * r.standard_normal(d) for _ in range(120)]
    rows += [loose / np.linalg.norm(loose) + 0.085 * r.standard_normal(d) for _ in range(60)]
    rows += [np.append([math.cos(0.3 * k), math.sin(0.3 * k)], np.zeros(d - 2)) for k in range(6)]
    return [x.tolist() for x in rows] + [rows[0].tolist()] * 4


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    rows = near_rows(np.random.default_rng(4))
    rows += [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] * 24, [1e-200] * 24, [1e200] * 24, [2.0] * 3]
    order = np.random.default_rng(1).permutation(len(rows)).tolist()
    table = [(i, rows[k], k % 5, "x") for i, k in enumerate(order)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int, key string").repartition(5)
    links, label = brute_links([t[1] for t in table], 0.9)
    monkeypatch.setattr(quantized, "BLOCK", 64)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in quantized.near_vectors(df, cosine=0.9).collect()}
    assert len(got) == len(rows)
    found, wanted = sum(g[0] for g in got.values()), sum(links)
    assert all(got[i][0] <= n for i, n in enumerate(links))  # no pair below the cosine
    assert found >= 0.995 * wanted, (found, wanted)
    whole = {i for i, n in enumerate(links) if got[i][0] == n}
    parts = defaultdict(set)
    for i, x in enumerate(label):
        parts[x].add(i)
    for x, members in parts.items():
        if members <= whole:
            assert all(got[i][1:] == (x, i == x) for i in members)


def test_crowds_lose_no_link(spark):
    """A third of all rows around one middle, others at its edge, and copies of one vector."""
    r = np.random.default_rng(8)
    middle = r.standard_normal(16)
    rows = [(middle + s * r.standard_normal(16)).tolist() for s in (0.05, 0.3, 0.45) for _ in range(150)] + [r.standard_normal(16).tolist() for _ in range(300)] + [middle.tolist()] * 100
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "vec_id long, embedding array<float>")
    rows = [np.array(x, np.float32).tolist() for x in rows]
    links, label = brute_links(rows, 0.9)
    index = quantized.fit(quantized.unit(np.array(rows)), len(rows), 0.9)
    assert len(index.crowds)
    got = {r.vec_id: (r.n_links, r.component_id) for r in quantized.near_vectors(df, cosine=0.9).collect()}
    assert sum(g[0] for g in got.values()) >= 0.995 * sum(links) and all(got[i][0] <= n for i, n in enumerate(links))
    big = max(Counter(label).items(), key=lambda x: x[1])[0]
    assert got[big][0] == links[big] and sum(got[i][1] == big for i, x in enumerate(label) if x == big) >= 0.99 * label.count(big)


def test_codes_bound_the_distance_and_lists_hold_neighbours():
    r = np.random.default_rng(2)
    x = quantized.unit(r.standard_normal((3000, 30)))
    index = quantized.fit(x[:2000], 3000, 0.9)
    own, visits = quantized.placed(x, index)
    codes, error = quantized.encoded(x, own, index)
    base = np.concatenate([index.centroids, index.crowds])
    assert np.allclose(np.linalg.norm(x - quantized.decoded(codes, base[own], index), axis=1), error)
    # Table look-ups give the products with the decoded vectors.
    one = own == own[0]
    about = quantized.decoded(codes[one], base[own[one]], index)
    assert np.allclose(quantized.table_products(x[:9], codes[one], index) + (x[:9] @ base[own[0]]), about @ x[:9].T, atol=1e-4)
    # Neighbours at the least cosine: the share whose list is visited, either way round.
    w = r.standard_normal(x.shape)
    w = quantized.unit(w - np.einsum("ij,ij->i", w, x)[:, None] * x)
    there, back = quantized.placed(0.9 * x + math.sqrt(0.19) * w, index)
    met = [a == b or (a < b and b in va) or (b < a and a in vb) for a, b, va, vb in zip(own, there, visits, back, strict=True)]
    assert np.mean(met) >= 0.99


@pytest.mark.parametrize("d", [1, 2, 5])
def test_narrow_and_few_vectors(spark, d):
    rows = [[1.0] * d, [-1.0] * d, [2.0] * d, [1.0] + [0.0] * (d - 1)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)] + [(None, [5.0] * d)], "vec_id long, embedding array<double>")
    links, _ = brute_links([*rows, [5.0] * d], 0.9)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in quantized.near_vectors(df).collect()), key=str)
    assert [g[1] for g in got] == [*links[:4], links[4]]
    assert got[-1] == (None, links[4], 0, False) and got[0][2:] == (0, True) and got[2][2:] == (0, False)


# 13: whitening
def brute_whitening(vectors, k=8):
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    dev = [int(sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True))) for row in x]
    c = np.array((n * x - s), float) / n
    values, vectors_ = np.linalg.eigh(c.T @ c / n)
    values, vectors_ = values[::-1][:k], vectors_[:, ::-1][:, :k]
    return n, dev, values, c @ vectors_ / np.sqrt(values), np.trace(c.T @ c / n)


def test_whitening_equals_a_plain_eigensolver(spark):
    r = np.random.default_rng(3)
    vectors = (r.standard_normal((300, 20)) * np.linspace(3, 0.2, 20)).astype(np.float32).tolist()
    bad = [None, [None] + [1.0] * 19, [float("nan")] * 20, [1.0] * 19 + [float("-inf")]]
    table = [(i, v, 0, "x") for i, v in enumerate(vectors)] + [(1000 + i, v, 0, "y") for i, v in enumerate(bad)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, component int, whitened string").repartition(5)
    n, dev, values, want, trace = brute_whitening(vectors)
    got = whitening.whiten(df.withColumnRenamed("embedding", "embedding")).collect()
    assert sorted(g.vec_id for g in got) == list(range(300))
    signs = None
    for g in sorted(got, key=lambda g: g.vec_id):
        signs = np.sign(np.array(g.whitened) * want[g.vec_id]) if signs is None else signs
        assert (g.n, g.deviation) == (n, dev[g.vec_id]) and np.abs(np.array(g.whitened) - signs * want[g.vec_id]).max() < 1e-9
        assert np.allclose(g.explained, values / trace, rtol=1e-9) and g.identity_error < 1e-9


def test_components_of_matrices_with_equal_and_zero_eigenvalues():
    r = np.random.default_rng(1)
    for t in range(200):
        d = int(r.integers(1, 25))
        if t % 3 == 0:
            q = np.linalg.qr(r.standard_normal((d, d)))[0]
            m = q * r.choice([1.0, 1.0, 2.0, 5.0, 5.0, 1e-3, 0.0], d) @ q.T
        elif t % 3 == 1:
            a = r.standard_normal((d, int(r.integers(1, 40))))
            m = a @ a.T
        else:
            m = np.diag(r.choice([1.0, 2.0, 3.0, 3.0, 0.0], d))
        m = (m + m.T) / 2
        values, vectors = whitening.principal(m, 8)
        want = np.linalg.eigvalsh(m)[::-1]
        if not len(values):
            assert want[0] < 1e-12
            continue
        assert np.abs(values - want[: len(values)]).max() < 1e-13 * want[0] * d
        assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
        assert np.abs(m @ vectors.T - vectors.T * values).max() < 1e-13 * want[0] * d


def test_large_numbers_stay_exact():
    x = whitening.whole(np.array([[2.0**50, -3.5], [2.0**50 + 1, 7.25], [-(2.0**51), 0.0]]))
    sums = tuple(whitening.total(x))
    assert sums == tuple(sum(int(v) for v in c) for c in x.T)
    want = [sum((3 * int(a) - b) ** 2 for a, b in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(x, 3, sums) == [w if w < 1 << 63 else None for w in want] and None in whitening.deviations(x, 3, sums)
    small = whitening.whole(np.array([[1.0], [2.0]]))
    assert whitening.deviations(small, 2, tuple(whitening.total(small))) == [1024**2, 1024**2]


# all three
def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n long, id string, vec string, explained int")


def test_odd_rows_of_all_three(spark, messy):
    got = align.align(messy, BYTE_BPE, PIECES).collect()
    assert len(got) == messy.count() and all((r.n_a == 0) == (r.groups_sha256 == "") for r in got)
    texts = [r.text for r in messy.collect()]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(brute_alignment(texts))
    odd = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (1, [2.0, -1.0], 0), (None, [1.0, 2.0], 1), (None, [-1.0, -2.0], 1), (2, None, None), (None, None, None), (3, [], 0)]
    df = vectors_frame(spark, [(*o, 0, "a", "b", 0) for o in odd])
    near = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in quantized.near_vectors(df).collect()), key=str)
    assert near == sorted([(1, 2, 1, True), (1, 2, 1, True), (1, 0, 1, True), (None, 2, 1, False), (None, 0, None, True), (2, 0, 2, True), (None, 0, None, True), (3, 0, 3, True)], key=str)
    white = whitening.whiten(df).collect()
    assert len(white) == 6 and {r.n for r in white} == {6} and all(len(r.whitened) == len(r.explained) for r in white)
    same = whitening.whiten(vectors_frame(spark, [(i, [1.0, 2.0], 0, 0, "a", "b", 0) for i in range(3)])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(3, 0, [], [], 0.0)] * 3


def test_no_rows_of_all_three(spark, empty):
    none = vectors_frame(spark, [])
    assert align.align(empty, BYTE_BPE, PIECES).count() == 0
    assert quantized.near_vectors(none).count() == 0 and whitening.whiten(none).count() == 0
    nulls = vectors_frame(spark, [(1, None, 0, 0, "a", "b", 0)])
    assert whitening.whiten(nulls).count() == 0 and [tuple(r) for r in quantized.near_vectors(nulls).collect()] == [(1, 0, 1, True)]


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    make(spark, corpus[:-1]).write.parquet(f"{where}/documents.parquet")
    r = np.random.default_rng(6)
    vectors = r.standard_normal((80, 12))
    vectors[40:60] = vectors[:20] + 0.05 * r.standard_normal((20, 12))
    vectors = vectors.astype(np.float32).astype(float).tolist()
    vectors_frame(spark, [(i, v, 0, 0, "a", "b", 0) for i, v in enumerate(vectors)] + [(900, None, 0, 0, "a", "b", 0)]).write.parquet(f"{where}/embeddings.parquet")
    return str(where), corpus[:-1], vectors


def test_registered_queries(spark, folder):
    where, rows, vectors = folder
    known = queries.queries()
    got = known["op11_cross_tokenizer_alignment"](spark, where)
    assert got.columns[0] == "doc_id" and set(COLUMNS) <= set(got.columns)
    want = dict(zip((i for i, *_ in rows), brute_alignment([t for _, t, *_ in rows]), strict=True))
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got.collect()} == want
    links, label = brute_links([*vectors, None], 0.9)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in known["op12_embedding_near_dedup"](spark, where).collect()}
    assert found == {**{i: (links[i], label[i], label[i] == i) for i in range(80)}, 900: (0, 900, True)}
    white = known["op13_embedding_whitening"](spark, where)
    assert dict(white.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    n, dev, values, want, trace = brute_whitening(vectors)
    signs = {}
    for r in sorted(white.collect(), key=lambda r: (r.component, r.vec_id)):
        w = want[r.vec_id, r.component - 1]
        sign = signs.setdefault(r.component, np.sign(w * r.whitened))
        assert (r.n, r.deviation) == (n, dev[r.vec_id]) and abs(r.whitened - sign * w) < 1e-9
        assert math.isclose(r.explained, values[r.component - 1] / trace, rel_tol=1e-9) and r.identity_error < 1e-4
    assert set(signs) == set(range(1, 9))
