"""From documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; every stage but the last returns the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.llm.common import cut, table
from sigmill.llm.decontaminate import contaminated
from sigmill.llm.near import near_duplicates
from sigmill.llm.packing import pack
from sigmill.llm.quality import classify
from sigmill.llm.secrets import redact

#: Trained models and exact search have no SQL form.
ORACLE_SQL = None


#: Names a row by id and text in each stage, so that null ids and ids of several texts are told apart; 64 bits, which
#: two different rows among 100 million share with a chance of 1 in 3,000.
KEY = "__key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    return keyed.join(keys.select(KEY).distinct(), KEY, "left_anti").drop(KEY)


def quality(spark, docs, sf_dir):
    """Documents that the line classifier rejects go.

    Null and empty texts are judged as one empty line; null ids and repeated
    rows are judged like others; ties at the threshold stay; no rows give no rows.
    """
    # Only ids and texts go in, under names that none of the result's can clash with.
    text, others = docs.columns.index("text"), [c for c in docs.columns if c != "text"]
    named = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.col(docs.columns[text]).alias("text"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias(f"c{others.index('doc_id')}"), "quality")
    kept = classify(named, labels, id_col=f"c{others.index('doc_id')}").filter("predicted = 1")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], "text").select(docs.columns)


def near_dedup(spark, docs, sf_dir):
    """Of each group of texts linked at 80 % of their five-word shingles one row stays: of least id, null ids last.

    Rows of one id are linked by their texts alone; of repeated rows one stays. Rows without words all stay.
    """
    keyed = _keyed(docs)
    found = near_duplicates(keyed, KEY, n_words=5, percent=80).filter("n_shingles > 0").groupBy(KEY).agg(F.first("component_id").alias("component"), F.count("*").alias("n"))
    found = cut(found.join(keyed.select(KEY, "doc_id").distinct(), KEY))
    best = cut(found.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", KEY)).alias("m")).select(f"m.{KEY}"))
    gone = found.join(best, KEY, "left_anti").select(KEY)
    again = cut(found.filter("n > 1").join(best, KEY, "left_semi").select(KEY))
    once = keyed.join(again, KEY, "left_semi").dropDuplicates([KEY]).drop(KEY)
    return _without(keyed, gone.union(again)).unionByName(once).select(docs.columns)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold a benchmark item within 15 % of its words in edits go.

    Null and empty texts hold none; null ids and repeated rows go like others; no rows give no rows.
    """
    keyed = _keyed(docs)
    return _without(keyed, contaminated(keyed, table(spark, sf_dir, "benchmark"), KEY)).select(docs.columns)


def secrets(spark, docs, sf_dir):
    """Secrets become [SECRET], but for widely copied examples; n_chars follows the text.

    No row goes, repeated ones and those of null ids included; null texts stay null; no rows give no rows.
    """
    clean = redact(docs)
    changed = F.contains("text", F.lit("[SECRET]"))
    return clean.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def packing(spark, docs, sf_dir):
    """Pieces of at most 1024 tokens and the place of each in a sequence; null and empty texts are their end alone; no rows give no rows."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
