"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes it as Parquet in the shared folder and reads it again as the next
stage's documents.  All stages but the last return the columns of documents
(``n_chars`` follows the text); repeated rows, null texts and empty tables
are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bpe, line_dedup, quality_rules, simhash, source_mix
from tallyframe.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed quality rules keep.  Null and empty texts
    have no words and go; repeated rows and rows that differ in other columns
    alone stay or go alike; an empty table stays empty."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one, nearly or fully;
    a document that loses all its lines stays, empty.  A null text stays
    null; rows alike in id and text lose the same lines; of rows of one id
    with different texts the order is by a hash; an empty table stays empty."""
    out, name = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.drop(name)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash neighbours.  Texts without
    words (null, empty) have fingerprint zero and are one group; of repeated
    rows one stays; an empty table stays empty."""
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, repeats as
    repeated rows.  A null source is a source; a text without words has
    nothing to take and goes; an empty table stays empty."""
    return source_mix.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with hashes of the ids and of the text that
    they decode to.  A null text is empty and has no ids; every row comes
    out, repeated ones too; an empty table stays empty."""
    import public_tokenizers
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near_copies),
          ("source mix", mix), ("BPE encoding", tokens)]

#: Fuzzy lines and pre-token merges aren't expressible; tests compare with a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
