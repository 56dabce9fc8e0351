"""From raw documents to a training corpus: five stages, each a whole pass over what the one before kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns documents with the columns of the ``documents`` table, the last one with what
the encoded corpus needs. ``run`` writes every stage's rows as Parquet in the folder that ``spark.checkpoint.dir`` names and reads
them again for the next one. Models and benchmark come from the tables ``labels`` and ``benchmark`` beside ``documents``.

Stages keep all other columns as they are. A stage that changes texts sets ``n_chars`` anew. Rows with null ids or texts go through
as the operators say; an empty table gives an empty corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setscope.functions.tables import materialise
from setscope.llm import decontaminate, pieces, quality, secrets, simhash
from setscope.llm.common import read
from setscope.llm.queries import piece_model

#: Near-duplicates have fingerprints of three-word shingles that differ by three bits or fewer.
SHINGLE, DISTANCE = 3, 3


def _as_rows(docs: DataFrame) -> DataFrame:
    """``(row, id, hash)``: the table as one struct beside its key, so that its columns may have any names."""
    whole = F.struct(*[docs[c] for c in docs.columns])
    return docs.select(whole.alias("row"), docs["doc_id"].cast("bigint").alias("id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("hash"))


def _as_table(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("accepted").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the smallest id; of several texts or equal rows of it, one by a fixed order.
    Documents without an id have no place in a class; they stay."""
    classes = simhash.near_duplicate_classes(docs, SHINGLE, DISTANCE)
    first = classes.filter("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept"))
    kept = first.select(F.col("kept.doc_id").alias("of_id"), F.col("kept.text_hash").alias("of_hash")).distinct()
    rows = _as_rows(docs).withColumn("rest", F.to_json(F.struct(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "text"])))
    named = rows.join(kept, (F.col("id") == F.col("of_id")) & (F.col("hash") == F.col("of_hash")), "left_semi")
    once = named.groupBy("id", "hash").agg(F.min_by("row", "rest").alias("row"))
    return _as_table(once.select("row").unionByName(rows.filter("id is null").select("row")), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark")).filter("n_hit > 0")
    hit = found.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).distinct()
    on = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash"))
    return _as_table(_as_rows(docs).join(hit, on, "left_anti"), docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a placeholder for every secret; ``n_chars`` is set anew where a text changed."""
    return secrets.redact(docs, size_column="n_chars")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: its id, the number of ids, digests of the ids and of the text decoded from them."""
    return pieces.piece_digests(docs, piece_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: The classifier, the fingerprints and the encoder cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
