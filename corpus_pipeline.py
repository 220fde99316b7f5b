"""From raw documents to packed training sequences: quality, lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage reads it back from Parquet.  All but the last return
the columns of ``documents``.

Defined cases: every row is decided by its own text, so rows that repeat an id with another text are documents of their own; of rows with the same text,
one stays (the near-duplicate stage), that of the least id, and of several rows with the same id and text the one whose other columns hash lowest.
A null text is an empty one, which the quality rules reject; a null id is larger than every other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from aeroquilt.llm.common import materialise, table
from aeroquilt.llm.decontaminate import without_leaks
from aeroquilt.llm.line_dedup import dedup_lines
from aeroquilt.llm.near_dup import LAST_ID, near_duplicates
from aeroquilt.llm.packing import pack_documents
from aeroquilt.llm.quality import quality


def _carried(docs: DataFrame) -> DataFrame:
    """Id, text, and all other columns in one, so that no column of a table clashes with one that an operator adds."""
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None)).alias("__rest"))


def _restored(df: DataFrame, columns: list[str], **new) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else F.col(c) if c in ("doc_id", "text") else F.col(f"__rest.{c}") for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _restored(quality(_carried(docs)).where("kept"), docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a smaller document holds; the character count follows the text, which is empty where it was null."""
    out = dedup_lines(_carried(docs))
    if "n_chars" not in docs.columns:
        return _restored(out, docs.columns)
    return _restored(out, docs.columns, n_chars=F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("__rest.n_chars")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class: that of the smallest id."""
    known = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(LAST_ID)).alias("__doc")
    stay = near_duplicates(docs).where("stays").select(known("doc_id"), F.col("digest").alias("__digest"))
    keyed = docs.select(*docs.columns, known("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("__digest"))
    order = F.xxhash64(*[f.name for f in docs.schema.fields if not isinstance(f.dataType, MapType)])
    equal = Window.partitionBy("__doc", "__digest").orderBy(order)
    kept = keyed.join(stay, ["__doc", "__digest"], "left_semi").withColumn("__nth", F.row_number().over(equal))
    return kept.where("__nth = 1").select(*docs.columns)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their place in the sequences."""
    return pack_documents(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("leaks", leak_stage), ("packing", packing_stage)]

#: Expectation-maximisation, sampling and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
