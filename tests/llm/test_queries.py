"""The registered queries over small tables, all contract columns against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sigmill.llm import chat, queries

from .conftest import make
from .test_operators import brute_components, brute_pii, brute_removed


@pytest.fixture(scope="module")
def folder(spark, corpus, words, tmp_path_factory):
    r = random.Random(17)
    odd = ["password = 'hunter22x' end", "AKIA" + "Z9" * 9, "api_key:abcdef.123", "0123456789abcdef0123456789", "a.b@c.de", "10.0.0.7", "4111 1111 1111 1111", "+49 (151) 234-5678", "\U0001f600 secret=Zk81xQ7bTr", "token=ab"]
    rows = corpus[:-1] + [(600 + i, " ".join(r.choice(odd + words[:5]) for _ in range(12)), "en", f"s{i % 4}") for i in range(25)]
    where = tmp_path_factory.mktemp("tables")
    make(spark, rows).write.parquet(f"{where}/documents.parquet")
    talk = [(c, t, r.choice(["user", "assistant", "system", "us<er"]), r.choice([None, "", "a\\b </turn> <next>", "\\l", "hello \U0001f600"])) for c in range(12) for t in range(r.randint(1, 6))]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{where}/conversations.parquet")
    bench = [(1, " ".join(corpus[0][1].split()[3:25])), (2, "not there " * 9), (3, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    labels = [(i, int(i % 4 > 0), 0) for i in range(0, 40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where), rows, talk


def result(spark, folder, name):
    return queries.queries()[name](spark, folder[0]).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def spell(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_op1_columns(spark, folder):
    train, rows = Counter(), folder[1]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t, *_ in rows}
    for i in tokens:
        if not held(i):
            train.update(tokens[i])
    n, v = sum(train.values()), len(train)
    got = result(spark, folder, "op1_ppm_scoring")
    assert len(got) == len(rows)
    for r in got:
        w = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(x in train for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0


def test_op2_columns(spark, folder):
    kinds = ("assign", "access", "hex")
    got = {r.doc_id: r for r in result(spark, folder, "op2_secret_scans")}
    assert len(got) == len(folder[1])
    for i, t, *_ in folder[1]:
        t = t or ""
        base = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[1]) >= 6]
        base += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        base.sort(key=lambda s: (s[1], kinds.index(s[0])))
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in kinds)
        assert r.base_sha256 == sha(spell(base))
        assert set(spell(base).split(",")) - {""} <= set(r.spans.split(","))


def test_op3_columns(spark, folder):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in result(spark, folder, "op3_substring_dedup")), key=str)
    assert got == brute_removed(folder[1], 13)


def test_op4_columns(spark, folder):
    names = ("email", "ip", "card", "phone")
    got = {r.doc_id: r for r in result(spark, folder, "op4_personal_data")}
    assert len(got) == len(folder[1])
    for i, t, *_ in folder[1]:
        base = brute_pii(t or "")
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in range(4))
        assert r.base_sha256 == sha(spell((names[k], s, e) for k, s, e in base))
        assert set(spell((names[k], s, e) for k, s, e in base).split(",")) - {""} <= set(r.spans.split(","))


def test_op5_columns_and_sql(spark, folder):
    import duckdb

    talk = [*folder[2], (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    by = defaultdict(list)
    for c, t, role, text in sorted(talk, key=lambda x: (x[0], x[1], x[2], x[3] or "")):
        by[c].append((role, text or ""))
    got = {r.conv_id: r for r in result(spark, folder, "op5_chat_formatting")}
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{folder[0]}/conversations.parquet/*.parquet')")
    want = {r[0]: r[1:] for r in con.execute(chat.OP5_SQL).fetchall()}
    assert want == {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for c, r in got.items()}


def test_op6_finds_the_passage(spark, folder):
    got = {(r.doc_id, r.item_id): r.distance for r in result(spark, folder, "op6_benchmark_decontamination")}
    assert got == {(0, 1): 0}


def test_op7_columns(spark, folder):
    got = result(spark, folder, "op7_best_fit_packing")
    whole, places = defaultdict(list), defaultdict(list)
    for r in got:
        whole[r.doc_id].append((r.piece, r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    assert set(whole) == {i for i, *_ in folder[1]}
    for parts in whole.values():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (k, at) and 0 < length <= 1024 and (length == 1024 or k == 0)
            at += length
    for parts in places.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 1024


def test_op8_columns(spark, folder):
    want = brute_components(folder[1], 4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in result(spark, folder, "op8_minhash_near_dedup")}
    assert got == {i: (n, root, root == i) for i, (n, root) in want.items()}


def test_op9_columns(spark, folder):
    order = sorted(folder[1], key=lambda x: x[0])
    got = {r.doc_id: r for r in result(spark, folder, "op9_document_fingerprints")}
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 4
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(t[: len(t) - n] + after[:n]))
        assert all(0 <= x <= 1 for x in (r.near_edited, r.near_next, r.in_edited, r.edited_in, r.in_next, r.next_in))
        assert (r.fingerprint == r.edited_fingerprint) <= (r.near_edited == 1)


def test_op10_columns(spark, folder):
    got = result(spark, folder, "op10_quality_classifier")
    assert {r.doc_id for r in got} == {i for i, *_ in folder[1]} and len(got) == len(folder[1])
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
