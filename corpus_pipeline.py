"""Corpus pipeline over ``documents``: rules, near-duplicates, benchmark passages, private data, packing.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
one's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accuracast.llm.bitfilter import bit_filter, may_be_filed
from accuracast.llm.minmax import near_duplicates
from accuracast.llm.packing import retrieval_pack
from accuracast.llm.pii import mask_private
from accuracast.llm.quality import keep_passing
from accuracast.llm.winnow import benchmark_spans
from accuracast.session import prepare, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _digest():
    """What tells texts apart; a NULL text is empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), 1, 16)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep all rules.

    NULL and empty texts fail for want of words; repeated rows are judged alike, whatever their doc_id;
    an empty table stays empty; columns besides those of ``documents`` go.
    """
    return keep_passing(docs.select(COLUMNS))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more): the smallest doc_id.

    Texts are grouped, not identifiers, so rows that share a doc_id but not their text are told apart, and
    of equal rows one stays. A NULL doc_id comes after all others. Texts without words are linked with
    nothing and all stay; so do the rows of an empty table, of which there are none.
    """
    marked = docs.select(*COLUMNS, _digest().alias("digest"))
    groups = near_duplicates(marked.select("digest", "text"), key="digest", threshold=80)
    groups = written(groups.where("n_shingles > 0").select("digest", "component_id").distinct(), "groups")
    rows = marked.select("digest", "doc_id").join(groups, "digest")
    choice = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("first")
    crowd = written(rows.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), choice).where("n > 1").select("component_id", "first.doc_id", "first.digest"), "crowds")
    first = crowd.select(F.col("digest").alias("first"), F.col("doc_id").alias("id"), "component_id")
    crowded = groups.join(first, "component_id").select("digest", (F.col("digest") == F.col("first")).alias("leads"), "id")
    crowded = written(crowded, "crowded")
    # rows that surely stand alone stay where they are; only the others are exchanged with their text
    marked = marked.withColumn("crowd", may_be_filed(bit_filter(crowded.select(F.xxhash64("digest").alias("hash"))), F.col("digest")))
    unsure = marked.where("crowd").join(crowded, "digest", "left")
    one = unsure.where("leads and doc_id <=> id").dropDuplicates(["digest"])
    return marked.where("not crowd").select(COLUMNS).union(unsure.where("leads is null").select(COLUMNS)).union(one.select(COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Whether a text holds one depends on the text alone, so rows are matched by it: a row without a doc_id
    is judged like any other, and a clean row stays whatever shares its doc_id. NULL and empty texts hold
    nothing; repeated rows are judged alike; an empty table stays empty.
    """
    marked = docs.select(*COLUMNS, _digest().alias("digest"))
    found = benchmark_spans(marked.select("digest", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="digest")
    return marked.join(written(found.where("n_hit > 0").select("digest").distinct(), "hits"), "digest", "left_anti").select(COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with private spans masked, and their length as it is then.

    Rows and their doc_id stay as they are, NULL texts too; equal texts are masked alike.
    """
    masked = mask_private(docs.select(COLUMNS))
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 ids.

    Every row is packed, repeated ones and those without a doc_id too; NULL and empty texts are their end
    id alone, and an empty table gives no piece.
    """
    return retrieval_pack(docs, key="doc_id").select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("dedup", dedup), ("decontaminate", decontaminate), ("private", private), ("packing", packing)]

#: Tokenizers and the span classifier are beyond SQL; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
