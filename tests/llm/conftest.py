import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, id string, key string, block string, class int, component string"
EXTRA = ("x", 1, "y", "k", "b", 2, "c")


def make(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), *EXTRA) for i, t, lang, source in rows], SCHEMA)


@pytest.fixture(scope="session")
def words():
    r = random.Random(7)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(words):
    """(doc_id, text, lang, source): prose, exact and near copies, a shared passage, odd rows."""
    r = random.Random(3)
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = say(120), say(30)
    rows = [(i, say(r.randint(20, 90)), "en" if i % 3 else "de", f"s{i % 4}") for i in range(40)]
    rows += [(100 + i, base, "en", "s0") for i in range(6)]
    for i in range(20):
        w = base.split()
        w[r.randrange(len(w))] = "edited%d" % i
        rows.append((200 + i, " ".join(w), "en", "s1"))
    rows += [(300 + i, say(15) + " " + passage + "  \n" + say(10), "de", "s2") for i in range(5)]
    rows += [(400, "", "en", "s0"), (401, None, None, None), (402, "one", "en", "s0"), (403, " \t\n ", "en", "s0"), (404, "ein Wort: naïve ça \U0001f600 ok", "de", "s3")]
    rows += [(405, say(4000), "en", "s1"), (5, rows[5][1], rows[5][2], rows[5][3])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return make(spark, corpus).cache()


@pytest.fixture(scope="session")
def messy(spark, corpus):
    """The corpus with null ids and an id that two texts share."""
    return make(spark, [*corpus, (None, corpus[0][1], None, None), (None, None, None, None), (7, "another text of row seven", None, "s1")])


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
