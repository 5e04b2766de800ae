"""The corpus pipeline: from raw documents to packed training sequences.

Stages, each on what the one before kept:

1. language ID: documents without letters, or whose language is unclear
   (score under ``MIN_SCORE``), go;
2. quality rules: documents that fail themselves or by their host go;
3. n-gram Jaccard join: of each group of near copies (five-word shingles,
   similarity 0.8) the document with the lowest id stays;
4. suffix-array dedup: passages of 50 bytes or more that a document with a
   smaller id has are cut from the text; a document with nothing left goes;
5. best-fit packing: the rest becomes token pieces in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm import common, idfilter, op1_quality, op2_repeats, op4_packing, op6_jaccard, op7_language

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SCORE = 0.3
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _ready(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents; further columns don't take part in the pipeline."""
    common.importable(spark)
    return docs.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is clear.

    A null or empty text, or one without letters, goes.  Rows are judged one by
    one: ties and repeated rows share their fate, null ids, languages and sources
    don't matter; without any labelled row no language is known and all go; an
    empty table stays empty.
    """
    found = op7_language.identify(_ready(spark, docs), with_spans=False, carry=True)
    return found.where((F.col("lang_pred") != op7_language.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules themselves and whose host passes.

    A null or empty text fails; a null source has no host verdict; rows are
    judged one by one, repeated ones count for their host as often as they occur;
    an empty table stays empty.
    """
    return op1_quality.judge(_ready(spark, docs), carry=True).where("kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the row of the lowest id.

    Rows that share an id are one document, whatever their texts; of them the row
    with the lowest text stays (then by language, source and length; null first),
    the others go with the rest of the group.  Rows with a null id stay, as do
    those with a null text or without words.  An empty table stays empty.
    """
    docs = _ready(spark, docs)
    groups = common.settle(op6_jaccard.near_groups(docs, SHINGLE_WORDS, SIMILAR_PERCENT))
    others = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    repeated = groups.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").select("doc_id")  # rows of one id
    bits = idfilter.id_filter(others.unionByName(repeated), lambda batch: idfilter.ids_of(batch.column("doc_id")))
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = rows.schema
    clear = rows.mapInArrow(idfilter.having(bits, "doc_id", keep=False), schema)  # surely neither: they needn't travel
    kept = rows.mapInArrow(idfilter.having(bits, "doc_id"), schema).join(others, "doc_id", "left_anti")
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars"))
    first = kept.withColumn("_again", again).where("doc_id IS NULL OR _again = 1")
    return clear.select(*COLUMNS).unionByName(first.select(*COLUMNS))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that a smaller id has; ``n_chars`` is counted anew.

    A null or empty text is empty and stays; a document of which nothing is left
    goes; rows of one id don't cut each other, a null id is larger than all; a
    character of which a byte is cut goes as a whole; an empty table stays empty.
    """
    cut = op2_repeats.remove_repeats(_ready(spark, docs), with_text=True, carry=True)
    kept = cut.where("n_removed < n_bytes OR n_bytes = 0")
    return kept.select("row.doc_id", F.col("kept_text").alias("text"), "row.lang", "row.source", F.length("kept_text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, each with its sequence and offset.

    A null or empty text is one piece with the end id; repeated rows and null ids
    have their own places; an empty table gives no pieces.
    """
    return op4_packing.pack_documents(_ready(spark, docs))


STAGES = [("language", language), ("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("packing", packing)]

#: Tokens, suffixes and trained models can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.settle_table(docs)
            if before is not None:
                common.drop_table(before)
            before = docs
    return docs
