"""Bootstrapped contextual extraction of personal data, in Spark expressions only.

Strict patterns find seed entities. The words before a seed are lexical
patterns; a graph of patterns and the values seen after them is scored in
rounds: a pattern is worth the share of known values among its distinct values,
a value is known as far as any of its patterns is trusted. Values that trusted
patterns introduce are found although no strict pattern knows their shape. A
value is a strict match, or a token with a digit or with a mark between letters
(`jane(at)host`); words of letters alone, such as names, are never values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

KINDS = ("email", "ip", "card", "phone", "context")
#: Possessive forms of the strict patterns: the same matches without backtracking.
REGEX = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "context": r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D0-9]*+[0-9]|[\p{L}\p{M}]++[^\p{L}\p{M}\p{N}\x20\x09-\x0D]++\p{L})[^\x20\x09-\x0D]*+",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": lambda t: F.contains(t, F.lit("@")), "phone": lambda t: F.contains(t, F.lit("+")), "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "context": lambda t: t.rlike(r"[0-9]|[\p{L}\p{M}][^\p{L}\p{M}\p{N}\x20\x09-\x0D]++\p{L}")}


def luhn(digits: Column) -> Column:
    """True where a string of digits passes the Luhn check."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x: x.try_cast("int"))
    d = F.filter(d, lambda x: x.isNotNull())
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def matches(text: Column, kind: str) -> Column:
    """array of (i, gap, value, before): each match with the length and end of what precedes it."""
    found = F.regexp_extract_all(text, F.lit(REGEX[kind]), F.lit(0))
    gaps = F.split(text, REGEX[kind], -1)
    # Zipped first: inside the function of `transform` the split would be done again for every match.
    both = F.slice(F.arrays_zip(gaps, found), 1, F.size(found))
    each = F.transform(both, lambda x, i: F.struct(i.alias("i"), F.char_length(x["0"]).cast("long").alias("gap"), x["1"].alias("value"), F.right(x["0"], F.lit(80)).alias("before")))
    none = F.array().cast("array<struct<i:int,gap:bigint,value:string,before:string>>")
    return F.when(NEEDS[kind](text), each).otherwise(none)


def located(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per row of (id, text): its key, and every match of every kind with its place."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "id", F.coalesce("text", F.lit("")).alias("text"))
    scanned = cut(rows.select("row", "id", *[matches(F.col("text"), k).alias(k) for k in KINDS]))
    each = scanned.select("row", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("order"), F.col(k).alias("m")) for n, k in enumerate(KINDS)])).alias("x"))
    each = each.select("row", "x.kind", "x.order", F.explode("x.m").alias("m")).select("row", "kind", "order", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.char_length("value")).over(upto)
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("value"))
    ok = reduce(lambda a, k: a.when(F.col("kind") == k, valid(k, F.col("value"))), KINDS[:4], F.when(F.lit(False), True)).otherwise(True)
    return scanned.select("row", "id"), each.filter(ok)


def contextual(each: DataFrame, rounds: int, min_seeds: int, min_confidence: float) -> DataFrame:
    """(row, start, end) of values that trusted patterns introduce and no strict pattern covers."""
    strict = each.filter(F.col("kind") != "context")
    marks = strict.groupBy("row").agg(F.collect_set(F.struct(F.col("start").alias("s"), F.col("end").alias("e"))).alias("spans"))
    tokens = each.filter(F.col("kind") == "context").join(marks, "row", "left")
    free = ~F.coalesce(F.exists("spans", lambda x: (F.col("start") < x["e"]) & (F.col("end") > x["s"])), F.lit(False))
    place = ("row", "start", "end", "value", "before")
    cands = strict.select(*place, F.lit(True).alias("seed")).union(tokens.filter(free).select(*place, F.lit(False)))
    words = F.filter(F.split(F.lower(F.when(F.char_length("before") < 80, F.col("before")).otherwise(F.regexp_replace("before", r"^\S*\s", ""))), r"\s+"), lambda w: w != "")
    one = F.element_at(words, -1)
    patterns = F.when(F.size(words) >= 2, F.array(F.concat_ws(" ", F.element_at(words, -2), one), one)).when(F.size(words) == 1, F.array(one)).otherwise(F.array().cast("array<string>"))
    seen = cut(cands.select("row", "start", "end", F.lower("value").alias("value"), "seed", patterns.alias("patterns")))
    edges = cut(seen.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    # Each side is written before it is joined, so that the share of a hot word or value can be split.
    value = cut(edges.groupBy("value").agg(F.max("seed").cast("double").alias("score")))
    pattern = None
    for _ in range(rounds):
        graded = edges.join(value, "value")
        pattern = graded.groupBy("pattern").agg(F.sum("score").alias("known"), F.count("*").alias("n"))
        pattern = cut(pattern.filter((F.col("known") >= min_seeds) & (F.col("known") / F.col("n") >= min_confidence)).select("pattern", (F.col("known") / F.col("n")).alias("trust")))
        heard = edges.join(pattern, "pattern", "left")
        value = cut(heard.groupBy("value").agg(F.greatest(F.max("seed").cast("double"), F.coalesce(F.max("trust"), F.lit(0.0))).alias("score")))
    trusted = seen.filter(~F.col("seed")).select("row", "start", "end", F.explode("patterns").alias("pattern")).join(pattern, "pattern", "left_semi")
    return trusted.select("row", "start", "end").distinct()


def extract_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, min_seeds: int = 5, min_confidence: float = 0.6) -> DataFrame:
    """One row per input row: id, spans (array of order, kind, start, end in code points).

    The strict kinds come first, in their listed order; "context" spans are
    added by the bootstrapping and overlap none of them. A pattern is trusted
    once at least `min_seeds` distinct known values follow it and they are
    `min_confidence` of all values after it. Null texts are empty; null ids and
    repeated rows are kept; no rows give no rows; other columns are not read.
    Patterns and values meet as a graph of distinct pairs, counted before any
    exchange, so a word that introduces half the corpus is one edge per value;
    what is left of a hot word the adaptive skew join parts.
    """
    rows, each = located(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    each = cut(each)
    more = contextual(each, rounds, min_seeds, min_confidence).select("row", F.lit(len(KINDS) - 1).alias("order"), "start", "end")
    spans = each.filter(F.col("kind") != "context").select("row", "order", "start", "end").union(more)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("order") + 1)
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("order", "start", "end", kind.alias("kind")))).alias("spans"))
    none = F.array().cast("array<struct<order:int,start:bigint,end:bigint,kind:string>>")
    return rows.join(spans, "row", "left").select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def op4_personal_data(spark, sf_dir):
    from .common import table
    from .secrets import span_text

    found = extract_personal(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "context")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:4]], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), count("context").alias("n_context"))
