"""Registered queries of the thirteen operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule votes, estimated accuracies, posterior quality of documents."""
    from tallyframe.llm import quality_rules as Q
    out = Q.score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", F.round("quality", 4).alias("quality"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of documents, linked at two bits or fewer."""
    from tallyframe.llm import simhash as S
    found = S.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"),
                        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of documents by a model of the labels outside fold 0."""
    from tallyframe.llm import quality_classifier as C
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    weights = C.fit(docs, labels.where(fold != 0))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return C.score(docs, weights).select("doc_id", held.alias("held_out"), "score",
                                         (F.col("score") >= C.THRESHOLD).cast("int").alias("predicted"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings of one label at cosine 0.93."""
    from tallyframe.llm import embedding_dedup as E
    out = E.near_vectors(table(spark, sf_dir, "embeddings"))
    return out.withColumn("component_id", F.col("component_id").cast("long"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of sources at weights 1, 2, 3 takes of documents."""
    from tallyframe.llm import source_mix as X
    out, sources = X.shares(table(spark, sf_dir, "documents"))
    out = out.select(F.col("id").alias("doc_id"), F.element_at("sources", 1).alias("source"), "size",
                     (F.col("size") * F.col("copies")).alias("taken"))
    return (out.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
            .select("doc_id", "size", "source_size", "target", "taken"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents covered by repeated strings of 400 bytes."""
    from tallyframe.llm import suffix_dedup as D
    out = D.repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), "kept_sha256",
                      (F.col("n_bytes") - F.col("n_removed")).alias("kept_bytes"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in documents, by Dice coefficient with templates."""
    from tallyframe.llm import license_scan as S
    out = S.scan(table(spark, sf_dir, "documents"))
    lines = F.array_join(F.transform(F.array_sort(F.transform("notices", lambda x: x["line"])), lambda x: x.cast("string")), ",")
    return out.select("doc_id", "licence", F.round("dice", 9).alias("dice"), "n_notices", "licences", lines.alias("lines"))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of documents under the 32k piece vocabulary."""
    import public_tokenizers
    from tallyframe.llm import token_count as T
    out = T.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one, nearly or fully."""
    from tallyframe.llm import line_dedup as L
    out, name = L.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", f"{name}.*", "text")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents under the 50k byte-level vocabulary, and back."""
    import public_tokenizers
    from tallyframe.llm import bpe as B
    return B.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for each benchmark item."""
    from tallyframe.llm import lexical_search as L
    return L.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest products of every 50th vector with other rows."""
    from tallyframe.llm import vector_topk as V
    return V.top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far sources of a language are apart, and by which terms."""
    from tallyframe.llm import source_audit as A
    return A.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_source_mix": op4_source_mix,
    "op5_simhash": op5_simhash,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_token_count": op8_token_count,
    "op9_line_dedup": op9_line_dedup,
    "op10_bpe": op10_bpe,
    "op11_lexical_search": op11_lexical_search,
    "op12_vector_topk": op12_vector_topk,
    "op13_source_audit": op13_source_audit,
}
