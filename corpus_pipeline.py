"""The corpus pipeline: documents through quality, exact dedup, near dedup, mixing and encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet in the shared folder and reads it again for the next stage. All
but the last return the columns that came in; run()'s rows are in the order of the mix,
and their column position keeps it.

The dedup stages find the rows that go on narrow tables of ids and hashes. Texts are then
filtered where they are, if those rows are few enough to broadcast, and shuffled otherwise.

Defined results, for every stage: a decision holds for a doc_id and a text, so rows that
share a doc_id and differ in text are decided apart; a null text counts as empty; rows
without doc_id take part like others, are kept by the dedup stages only if no row of their
group has one, and then one of them is; of rows equal in doc_id and text the dedup stages
keep one, the others treat them alike; an empty table gives an empty result; further
columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import exact, mixing, pieces, quality, simhash
from pageloom.llm.common import new_path, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Stands for a null doc_id in joins.
_NO_ID = -(1 << 63)
#: Keys (a long and a hash, about 100 bytes in a hash table) that are broadcast; more are joined by shuffles.
BROADCAST_KEYS = 1 << 18


def _first_of_each(docs: DataFrame, rows: DataFrame, text_hash: Column) -> DataFrame:
    """docs without the rows that aren't kept: rows has (id, text_h, kept) for each, and of equal kept rows one stays."""
    by = ["__doc", "__text_h"]
    keys = stored(rows.groupBy(F.coalesce("id", F.lit(_NO_ID)).alias("__doc"), F.col("text_h").alias("__text_h")).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("n > 1 OR NOT kept"), "stage-keys")
    marked = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID))).withColumn("__text_h", text_hash)
    n, n_kept = keys.agg(F.count("*"), F.count(F.when(F.col("kept"), 1))).first()
    side = F.broadcast if n <= BROADCAST_KEYS else lambda df: df
    left = marked.join(side(keys.select(by)), by, "left_anti").select(*docs.columns)
    if n_kept:
        again = marked.join(side(keys.filter("kept").select(by)), by, "left_semi")
        left = left.unionByName(again.dropDuplicates(by).select(*docs.columns))
    return left


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; those without n-grams (null and empty texts) never are."""
    return quality.selected_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id; of several such rows, one."""
    found = exact.exact_groups(docs, keep="max")
    return _first_of_each(docs, found.select("id", F.col("digest").alias("text_h"), (F.col("kept") | F.col("keep_id").isNull()).alias("kept")), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard similarity of 0.8 or more), the one with the smallest doc_id."""
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    roots = simhash.similar_texts(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), text_hash.alias("node")).join(roots, "node", "left")
    rows = stored(rows.select("id", "node", F.coalesce("root", "node").alias("root")), "stage-groups")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    firsts = rows.groupBy("root").agg(F.min(first).alias("first"), F.count("*").alias("n")).filter("n > 1").select("root", "first")
    rows = rows.join(firsts, "root")  # rows of their own group have nothing to lose
    kept = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("node") == F.col("first.node"))
    return _first_of_each(docs, rows.select("id", F.col("node").alias("text_h"), kept.alias("kept")), text_hash)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix: file by file, sources at their target weights."""
    mixed = mixing.mix(docs, tie_cols=("text",))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = docs.count()  # positions lie close to their rows' numbers: blocks are of one size but for the sources' last ones
    file = F.least(F.lit(files - 1), F.floor(F.col("__mix_position") * files / max(1, last))).cast("int")
    return mixed.repartitionById(files, file).sortWithinPartitions("__mix_position").select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, position in the mix and ids, whose decoding was held against the text.

    Rereading loses the order of files, so the position is computed again: it follows
    from ids, sources and texts alone.
    """
    keep = ("doc_id", "source", "lang", "position")
    mixed = mixing.mix(docs, tie_cols=("text",)).withColumnRenamed("__mix_position", "position")
    coded = pieces.encode(mixed.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)), keep=(*keep, "sha"), decoded=True)
    return stored(coded.select(*keep, "ids", "n_pieces", (F.sha2("text", 256) == F.col("sha")).alias("lossless")), "stage-pieces")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]

#: Hashed models, fingerprints and sampled pieces have no SQL; tests/llm hold the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs.orderBy("position")
