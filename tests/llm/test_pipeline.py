"""The pipeline's own stages against brute force on repeated rows, ids of several texts and null ids."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def expected(rows, items, secret):
    """Links at 80 %, then whole items, then the secret, row by row."""
    sets, label = [grams(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    best = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            best[label[i]] = min(best.get(label[i], (True, float("inf"), i)), (d is None, float("inf") if d is None else d, i))
    left = [r for i, r in enumerate(rows) if not sets[i] or best[label[i]][2] == i]
    left = [(d, t) for d, t in left if not any(x in (t or "") for x in items)]
    return Counter((d, t if t is None else t.replace(f"password={secret}", "[SECRET]")) for d, t in left)


def test_run_equals_brute_force(spark, words, tmp_path, monkeypatch):
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    item, secret, copy = say(20), "Zk81xQ7bTr", say(60)
    hidden = lambda: f"{say(r.randint(5, 40))} password={secret} {say(30)}"
    rows = [(i, say(50)) for i in range(20)]
    twice, none_secret = hidden(), hidden()
    rows += [(30, twice), (30, twice), (31, hidden()), (31, hidden()), (None, none_secret), (None, hidden()), (32, hidden())]
    rows += [(40, copy), (None, copy), (None, copy + " more"), (None, say(45)), (41, copy), (41, say(40)), (2, rows[5][1]), (40, copy)]
    rows += [(50, f"{say(30)} {item} {say(30)}"), (None, f"{say(30)} {item} {say(30)}"), (51, say(44)), (51, f"{say(25)} {item} {say(35)}")]
    rows += [(60, None), (60, None), (None, None), (None, ""), (61, " \n")]
    spark.createDataFrame([(d, t, "en", "s1", None if t is None else len(t)) for d, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = [s for s in corpus_pipeline.STAGES if s[0] in ("near_dedup", "decontaminate", "secrets")]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*own, ("all", lambda spark, docs, sf_dir: docs)])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((x.doc_id, x.text) for x in got) == expected(rows, [item], secret)
    assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in got)


def odd_tables(spark, words, where, rows):
    r = random.Random(8)
    cols = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, cuts string, key string, spans string, component string"
    spark.createDataFrame([(d, t, None, "s", None if t is None else len(t), 0.5, 7, "c", "k", "s", "m") for d, t in rows], cols).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0, "x", "y") for i in range(40)], "doc_id long, quality int, toxic int, text string, score string").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, " ".join(r.choice(words) for _ in range(20)), "x"), (None, None, "y")], "item_id long, text string, doc_id string").write.parquet(f"{where}/benchmark.parquet")
    return spark.read.parquet(f"{where}/documents.parquet")


def test_stages_take_odd_rows_and_names(spark, words, tmp_path):
    """Nulls, repeats, ties, a long text and columns whose names the stages use: nothing is lost but what a stage drops."""
    r = random.Random(9)
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, say(30) + ".") for i in range(40)] + [(1, say(20)), (2, None), (None, say(9)), (None, None), (3, ""), (50, say(20_000)), (51, "password=Zk81xQ7bTr " + say(30))]
    docs = odd_tables(spark, words, str(tmp_path), [*rows, rows[0]])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).collect()
        if name == "packing":
            assert {x.doc_id for x in out} == {d for d, _ in rows}
            continue
        assert [*out[0].asDict()] == docs.columns, name
        before = Counter((x.doc_id, x.text) for x in docs.collect())
        after = Counter((x.doc_id, x.text) for x in out)
        assert all((x.score, x.predicted, x.cuts, x.key, x.spans, x.component) == (0.5, 7, "c", "k", "s", "m") for x in out), name
        if name == "secrets":
            assert after.total() == before.total() and sum("[SECRET]" in (x.text or "") for x in out) == 1
        else:
            assert not after - before, name
        if name == "near_dedup":
            assert after == before - Counter([rows[0]])
        if name == "decontaminate":
            assert after == before


def test_stages_take_no_rows(spark, words, tmp_path):
    docs = odd_tables(spark, words, str(tmp_path), [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def test_quality_stage_keeps_what_the_classifier_keeps(spark, words, tmp_path):
    from sigmill.llm.quality import classify

    r = random.Random(10)
    rows = [(i, "\n".join(" ".join(r.choice(words) for _ in range(12)) + "." if i % 2 else " | ".join([r.choice(words)] * 6) for _ in range(4))) for i in range(80)]
    docs = odd_tables(spark, words, str(tmp_path), rows)
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet").select("doc_id", "quality")
    want = {x.doc_id for x in classify(docs.select("doc_id", "text"), labels).filter("predicted = 1").collect()}
    got = {x.doc_id for x in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    assert got == want and 20 < len(got) < 60
