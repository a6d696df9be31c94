"""A corpus made ready for training: STAGES one after another, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents (the last: doc_id,
position in training, ids), which is written as Parquet and read again as the next one's docs.

The mix puts documents in training order; Parquet files have none, so the last stage works the order out again from the rows (a pass
over a source is all its documents, by the MD5 of doc_id) and gives it as a column.

Cases. Null texts and empty ones have no words, so the first stage drops them; later stages handle them all the same. Repeated rows
and near copies leave one document of each group. An empty table stays empty through all stages. Extra columns are
dropped by the first stage. The mix repeats documents, so doc_id may repeat from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import fertility, mixing, pieces, pii, simhash
from lacuna.llm.common import stored, sweep, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands of their script accept."""
    return fertility.keep(docs.select(*COLUMNS))


#: At most so many rows that are taken out go to the executors as a broadcast (16 bytes each); beyond that they are joined.
BROADCAST = 1_000_000


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that are alike by 0.8 or more in their sets of five-word shingles, found by SimHash balls, the document
    with the smallest doc_id; of rows that share that doc_id, the one whose row hash is smallest. Rows without a doc_id stay."""
    row = F.xxhash64(*COLUMNS)
    own = docs.select("doc_id", F.xxhash64("text").alias("h"), row.alias("row"))
    groups = simhash.similar(docs).where("doc_id is not null").select("doc_id", "h", "component_id").distinct()
    rows = stored(own.join(groups, ["doc_id", "h"]).groupBy("component_id", "doc_id", "row").agg(F.count(F.lit(1)).alias("n")), "rows")
    first = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("x")).select("x.doc_id", "x.row")
    gone = stored(rows.join(first, ["doc_id", "row"], "left_anti").select("doc_id", "row"), "gone")
    few = gone.limit(BROADCAST + 1).count() <= BROADCAST
    kept = docs.select(*COLUMNS).withColumn("row", row).join(F.broadcast(gone) if few else gone, ["doc_id", "row"], "left_anti").select(*COLUMNS)
    # rows alike in every column: one of them
    twice = rows.where("n > 1").join(first, ["doc_id", "row"], "left_semi").select("doc_id").distinct()
    if twice.limit(1).count() == 0:
        return kept
    again = kept.join(twice, "doc_id", "left_semi").dropDuplicates()
    return kept.join(twice, "doc_id", "left_anti").select(*COLUMNS).union(again.select(*COLUMNS))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.mask(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated or left out so that each source has its target of words."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, position (in training, as the mix has set it) and the ids of the text. Rows come in no order: whoever trains sorts by position."""
    return pieces.encode(mixing.positions(docs), carry="position")


STAGES = [("quality", quality), ("near_duplicates", deduplicate), ("private", private), ("mix", mix), ("encode", encode)]

#: Tokenisers, fingerprints and the tagger have no SQL form; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents. Each stage's table is deleted when the next one's is written, and so is what a stage
    has written on its way."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = written()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
            sweep(spark, mark, docs)
    return docs
