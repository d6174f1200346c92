"""Parameters other than those of production: shares of edits, long items, windows."""

from __future__ import annotations

import random

import pytest

from sigmill.llm import decontaminate, substrings

from .conftest import make
from .test_operators import brute_removed


@pytest.mark.parametrize(("share", "size", "edits"), [(0.3, 10, (3, 6, 9)), (0.3, 20, (1, 5, 9, 13, 17, 19)), (0.44, 9, (1, 4, 7)), (0.44, 16, (0, 2, 4, 6, 8, 10, 12))])
def test_spread_edits_hide_no_item(spark, words, share, size, edits):
    """Edits at places that leave no run of three words whole."""
    r = random.Random(size)
    items = [(i, " ".join(r.choice(words) for _ in range(size))) for i in range(60)]
    rows = []
    for i, t in items:
        w = t.split()
        for k in edits:
            w[k] = f"new{i}x{k}"
        rows.append((i, " ".join([*(r.choice(words) for _ in range(30)), *w, *(r.choice(words) for _ in range(30))]), "en", "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.contaminated(make(spark, rows), bench, share=share).collect()}
    found = [got.get((i, i)) for i in range(60)]
    assert all(d is None or d <= len(edits) for d in found) and sum(d is not None for d in found) >= 54
    assert all(d <= decontaminate.allowed(size, share) for d in got.values())


def test_shares_beyond_the_bound_are_refused(spark, docs):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    with pytest.raises(ValueError):
        decontaminate.contaminated(docs, bench, share=0.5)


def test_items_of_many_words_in_few_windows_at_once(spark, words, monkeypatch):
    r = random.Random(3)
    item = " ".join(r.choice(words) for _ in range(1500))
    w = item.split()
    for k in range(7, 1500, 70):
        w[k] = f"new{k}"
    rows = [(1, "before it " * 20 + " ".join(w) + " after it" * 20, "en", "s"), (2, item[: len(item) // 2], "en", "s")]
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    want = [(1, 5, len(range(7, 1500, 70)))]
    monkeypatch.setattr(decontaminate, "WORDS_AT_ONCE", 4000)
    assert [(x.doc_id, x.item_id, x.distance) for x in decontaminate.contaminated(make(spark, rows), bench).collect()] == want


@pytest.mark.parametrize("window", [7, 20, 140, 500])
def test_repeats_of_windows_of_any_size(spark, words, window):
    r = random.Random(window)
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    long, short = say(3 * window), say(window)
    rows = [(i, " ".join([say(r.randint(5, 60)), r.choice([long, short, say(window - 1)]), say(r.randint(5, 60))]), "en", "s") for i in range(14)]
    rows += [(20, " ".join(long.split()[: window - 1]), "en", "s"), (21, "a b " * window, "en", "s"), (22, "a b " * window + "c", "en", "s"), (None, long, "en", "s")]
    got = sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substrings.drop_repeats(make(spark, rows), window=window).collect()), key=str)
    assert got == brute_removed(rows, window)


@pytest.mark.parametrize("window", [6, 40_000])
def test_windows_out_of_range_are_refused(docs, window):
    with pytest.raises(ValueError):
        substrings.drop_repeats(docs, window=window)
