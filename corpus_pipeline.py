"""A training-corpus pipeline over the documents table: identify, deduplicate, decontaminate, redact, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's result as Parquet in the shared checkpoint folder and reads it again as the next one's docs.

The near-duplicate and decontamination stages judge rows, not ids: a row's key is its place in the files that the stage
reads, which is the same in every scan and retry. Where docs isn't a scan of files, the stage writes it to the checkpoint
folder first.

Defined cases: a document without a letter, or with null text, is rejected by the language stage; one in a language that
was not learned gets the nearest of those that were, and stays. Different texts that share an id, and rows without an id,
are documents of their own; equal rows are copies, of which one stays. Very long texts go through every stage whole.
Columns beyond those of documents are dropped by the first stage. Empty tables give empty results at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talliq.llm import bpe, common, decontamination, jaccard, langid, pii

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Keys of leaked rows, of 8 bytes each, that are broadcast at most; their count decides.
BROADCAST_KEYS = 200_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told. The machines are fitted on the rows whose ids are not held out."""
    model = langid.fit(docs.filter(~langid.held_out()))
    told = docs.select(*COLUMNS, langid.predicted(model, spark).alias("told"))
    return told.filter(F.col("told.lang") != langid.UNDETERMINED).select(*COLUMNS)


def keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents and row_key, a long that no two rows share and every scan finds again."""
    if not _is_scan(docs):
        path = f"{common.shared_folder(spark)}/corpus-rows-{uuid.uuid4().hex}"
        docs.select(*COLUMNS).write.parquet(path)
        docs = spark.read.parquet(path)
    place = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_index"))
    # one row a file: a window over all of them stays small
    number = F.row_number().over(Window.orderBy("row_file")).cast("long")
    files = common.checkpointed(place.select("row_file").distinct().withColumn("file_number", number))
    key = F.shiftleft("file_number", 40) + F.col("row_index")
    return place.join(F.broadcast(files), "row_file").select(*COLUMNS, key.alias("row_key"))


def _is_scan(docs: DataFrame) -> bool:
    """Whether the rows are those of files as they stand, so that they have a place in them."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that similarity links join: that of the smallest id, rows without one last."""
    rows = keyed(spark, docs)
    groups = common.checkpointed(jaccard.similar(rows, id_col="row_key").select(F.col("doc_id").alias("row_key"), "class_id"))
    ranked = rows.select("row_key", "doc_id").join(groups, "row_key")
    kept = ranked.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "row_key")).alias("least"))
    return rows.join(kept.select("least.row_key"), "row_key", "left_semi").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    rows = keyed(spark, docs)
    found = decontamination.leaks(rows, common.table(spark, sf_dir, "benchmark"), id_col="row_key")
    leaked = common.checkpointed(found.select(F.col("doc_id").alias("row_key")).distinct())
    # leaks are few: their keys go to the texts while they are, and not the texts to them
    few = leaked.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(leaked) if few else leaked, "row_key", "left_anti").select(*COLUMNS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in square brackets; n_chars follows the text."""
    return docs.select(*COLUMNS).withColumn("text", pii.cleaned(spark)).withColumn("n_chars", F.length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return bpe.encode_digests(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", redacted),
    ("byte_bpe", encoded),
]

#: Machines, fields, forests and merges are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. A stage's rows are deleted when the next one's are written; the last ones stay."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            common.delete(spark, before)
        before = path
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
