"""Queries of this subpackage over the driver's tables, and their SQL where it can be told."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, lines, lm_score, media, mixing, pieces, quality, simhash, toxicity, warc
from .common import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)), keep=("doc_id", "sha"), decoded=True)
    coded = coded.withColumn("text_sha256", F.sha2("text", 256))
    return coded.select("doc_id", "n_pieces", F.xxhash64("ids").alias("ids_hash"), "text_sha256", (F.col("text_sha256") == F.col("sha")).alias("lossless"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(media.encode(table(spark, sf_dir, "documents"), "text", "doc_id"), "media")
    return media.features(files, "media", "doc_id", "n_bytes").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "spans", "tensors")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_groups(table(spark, sf_dir, "documents"), keep="max")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.duplicate_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", (F.col("n_lines") - F.size("removed")).alias("kept_lines"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", *[F.col(f"__mix_{c}").alias(c) for c in ("weight", "block", "release", "deadline", "slot", "position")])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).drop("url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lm_score, op2_quality, op3_simhash, op4_pieces, op5_media, op6_toxicity, op7_exact, op8_lines, op9_mix, op10_warc)}

_DIGIT = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_BASE32 = " || ".join(
    f"substr({_DIGIT}, 1 + (((('0x' || substr(d, {1 + 5 * i}, 5))::BIGINT) >> {20 - 5 * (j + 1)}) & 31)::INT, 1)" for i in range(8) for j in range(4)
)

SQL: dict[str, str] = {
    "op7_exact": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op8_lines": """
        WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
        lines AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM docs),
        sets AS (SELECT doc_id, i, list_sort(list_distinct(list_filter(regexp_split_to_array(s, '[ \t\x0b\f\r]+'), lambda w: w <> ''))) AS w FROM lines),
        full_sets AS (SELECT * FROM sets WHERE len(w) > 0),
        firsts AS (SELECT w, len(w) AS n, min((doc_id, i)) AS place, row_number() OVER () AS k FROM full_sets GROUP BY w),
        words AS (SELECT k, n, place, unnest(w) AS t FROM firsts),
        rare AS (SELECT t, count(*) AS f FROM words GROUP BY t),
        ranked AS (SELECT k, n, place, t, row_number() OVER (PARTITION BY k ORDER BY f, t) AS r FROM words JOIN rare USING (t)),
        prefixes AS (SELECT k, n, place, t FROM ranked WHERE r <= n - (4 * n + 4) // 5 + 1),
        pairs AS (SELECT DISTINCT x.k AS a, y.k AS b FROM prefixes x JOIN prefixes y ON x.t = y.t AND y.place < x.place
                  AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
        gone AS (SELECT DISTINCT a AS k FROM pairs JOIN firsts x ON x.k = a JOIN firsts y ON y.k = b
                 WHERE 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n)),
        removed AS (SELECT s.doc_id, s.i FROM full_sets s JOIN firsts f ON s.w = f.w LEFT JOIN gone g ON g.k = f.k
                    WHERE g.k IS NOT NULL OR f.place <> (s.doc_id, s.i)),
        per_doc AS (SELECT doc_id, count(*) AS c, string_agg(i::VARCHAR, ',' ORDER BY i) AS removed FROM removed GROUP BY doc_id)
        SELECT doc_id, len(l)::INT AS n_lines, (len(l) - coalesce(c, 0))::INT AS kept_lines, coalesce(removed, '') AS removed
        FROM docs LEFT JOIN per_doc USING (doc_id)""",
    "op10_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        q AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS d,
                     max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM q""",
}
