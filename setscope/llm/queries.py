"""The queries of the operators of this package, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from setscope.functions.tables import materialise
from setscope.llm import decontaminate, hmm, importance, licenses, phrases, pieces, quality, secrets, simhash, suffixes, topk, warc, weak_rules
from setscope.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(read(spark, sf_dir, "documents"), piece_model())


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_summary(read(spark, sf_dir, "documents"))


ORACLES["op6_secret_scan"] = secrets.oracle()


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_summary(licenses.scan_licenses(read(spark, sf_dir, "documents")))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_summary(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLES["op10_decontamination"] = decontaminate.ORACLE


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicate_classes(read(spark, sf_dir, "documents"), width=3, distance=3)
    return classes.select("doc_id", simhash.fingerprint_text("fp").alias("fingerprint"), "component_id")


@query
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialise(topk.whole_vectors(read(spark, sf_dir, "embeddings")), "top-k-vectors")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


ORACLES["op3_exact_top_k"] = topk.ORACLE


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read(spark, sf_dir, "pages")).drop("url")


ORACLES["op7_warc"] = warc.ORACLE


@query
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(read(spark, sf_dir, "documents"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(read(spark, sf_dir, "documents")).drop("text_hash")


@query
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.rule_summary(read(spark, sf_dir, "documents"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = phrases.ORACLE


@query
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
