"""WARC archives: written and read by Spark's own readers and writers, with boundary-chain verification.

Writing: one record per page, as bytes through Spark's text writer with CRLF CRLF
as the separator, in files that no other tool needs help to read. Equal payloads
(by SHA-256, SHA-1 and length) are stored once, by the page with the largest id;
the others are revisit records. Revisits need no payload, so only pages whose
digest passes a filter of repeated digests are shuffled with their html.

Reading: Spark's splittable text reader cuts the files at every occurrence of the
magic WARC/1.0 CRLF, inside payloads too, so each piece is only a candidate record.
Tasks emit for each candidate its offset and its successor's (header + content +
separator). Pointer jumping from the start of each file keeps the candidates that
the chain reaches; a magic inside a payload is not reached. Payloads that hold a
magic are put together again from their pieces. The chain of a file is narrow (a
few numbers for each candidate) and bounded by the file, which the writer rolls at
MAX_RECORDS records. Chain and payloads come from two scans, in a session of their own
whose settings fix how files are cut, whatever executors come and go in between.

Defined results: null html counts as empty, null urls and ids are left out of the
header and read back as null; pages without an id are never referred to unless
their whole group has none; rows that share the kept id are all responses; control
characters in urls are percent-encoded; an empty table gives no archive and an
empty result; further columns are ignored, whatever their names; payloads of any length
are kept whole. A file whose chain breaks (truncated,
or bytes between records) keeps its records up to the break.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILTER_BROADCAST_BYTES, bit_filter, filter_bit, filter_slot, filter_slots, has_bit, new_path, stored

MAGIC = "WARC/1.0\r\n"
GAP = "\r\n\r\n"
MAX_RECORDS = 20_000
DATE = "2020-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four digits to base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("?")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line; nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def decide(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, digest, n_bytes, refers_to): refers_to is null for responses; payload is null for revisits."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    read = pages.select(F.col(id_col).cast("bigint").alias("id"), url.alias("url"), payload.alias("payload"))
    read = read.select("*", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("bigint").alias("n_bytes"), F.sha2("payload", 256).alias("strong"))
    groups = read.filter(F.col("n_bytes") >= min_bytes).groupBy("strong", "digest", "n_bytes").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
    repeated = stored(groups.filter("n > 1").select("strong", "keeper"), "repeated-payloads")
    count = repeated.count()
    columns = ["id", "url", "payload", "digest", "n_bytes"]
    single = lambda rows: rows.select(*columns, F.lit(None).cast("bigint").alias("refers_to"))
    if not count:
        return single(read)
    hashed = F.xxhash64("strong")
    tested = _with_filter(read, repeated.select(hashed.alias("h")), count, hashed, "repeats")
    # on narrow rows: which pages of repeated payloads are revisits; the filter's false hits are responses
    keepers = repeated.select(F.col("strong").alias("strong_"), "keeper")
    revisit = F.col("strong_").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("id"))
    narrow = tested.filter("repeats").select("id", "url", "digest", "n_bytes", "strong").join(keepers, F.col("strong") == F.col("strong_"), "left")
    narrow = stored(narrow.withColumn("revisit", revisit), "repeated-pages")
    revisits = narrow.filter("revisit").select("id", "url", F.lit(None).cast("string").alias("payload"), "digest", "n_bytes", F.col("keeper").alias("refers_to"))
    movers = narrow.filter("NOT revisit").select("strong", "id").distinct()
    both = F.xxhash64("strong", "id")
    kept = _with_filter(tested.filter("repeats"), movers.select(both.alias("h")), movers.count(), both, "moves").filter("moves")
    movers = movers.select(F.col("strong").alias("strong_"), F.col("id").alias("id_"))
    kept = kept.join(movers, (F.col("strong") == F.col("strong_")) & F.col("id").eqNullSafe(F.col("id_")), "left_semi")
    return single(tested.filter("NOT repeats")).unionByName(single(kept)).unionByName(revisits)


def _with_filter(rows: DataFrame, keys: DataFrame, n_keys: int, hashed: Column, name: str) -> DataFrame:
    """rows with a boolean: false only if the row's hash is not among the keys' h; true for all if the filter would be large."""
    slots = filter_slots(n_keys, 16)
    if slots is None:
        return rows.withColumn(name, F.lit(True))
    bits = bit_filter(keys, slots).withColumnRenamed("bits", f"{name}_bits")
    tested = rows.withColumn("h", hashed).withColumn("slot", filter_slot(F.col("h"), slots)).join(F.broadcast(bits), "slot", "left")
    return tested.withColumn(name, has_bit(F.col(f"{name}_bits"), filter_bit(F.col("h")))).drop("h", "slot", f"{name}_bits")


def record(row: DataFrame) -> DataFrame:
    """One string column: the WARC record of each row of decide(), without the separator after it."""
    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace("url", r"[\x00-\x1F\x7F]", "%20")
    body = F.coalesce(F.col("payload"), F.lit(""))
    head = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _uuid(F.col("id"), F.col("digest"))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Refers-To", F.when(revisit, _uuid(F.col("refers_to"), F.col("digest")))),
        _header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        _header("X-Page-Id", F.col("id")),
        _header("X-Refers-To-Page-Id", F.col("refers_to")),
        _header("X-Payload-Length", F.when(revisit, F.col("n_bytes"))),
        _header("Content-Type", F.lit("text/html")),
        _header("Content-Length", F.octet_length(body)),
        F.lit("\r\n"),
    )
    return row.select(F.concat(head, body).alias("value"))


def write(rows: DataFrame, path: str, max_records: int = MAX_RECORDS) -> str:
    record(rows).write.option("lineSep", GAP).option("maxRecordsPerFile", max_records).text(path)
    return path


def _chain(pieces: pd.DataFrame) -> pd.DataFrame:
    """For the pieces of one file: offset of each, and the record that it belongs to (-1: none)."""
    pieces = pieces.sort_values(["block", "seq"], kind="stable").reset_index(drop=True)
    before = np.concatenate(([0], np.cumsum(pieces["n"].to_numpy() + len(MAGIC))))
    end = before[-1] - len(MAGIC)  # there is no magic after the last piece
    offset = before[:-1] - len(MAGIC)  # of the magic before the piece; the first piece has none
    n = len(pieces)
    reach = pieces["head"].to_numpy() + pieces["content"].to_numpy()
    target = offset + len(MAGIC) + reach + len(GAP)
    jump = np.searchsorted(offset, target)
    jump = np.where((pieces["head"].to_numpy() > 0) & (jump < n) & (offset[np.minimum(jump, n - 1)] == target), jump, n)
    whole = (pieces["head"].to_numpy() > 0) & (target <= end)
    jump = np.concatenate((np.where(whole, jump, n), [n]))
    reached = np.zeros(n + 1, bool)
    if n > 1 and pieces["n"].iloc[0] == 0:
        reached[1] = whole[1]
    while True:  # after k rounds `jump` leads 2^k records on, and the first 2^k are reached
        now = reached.copy()
        now[jump[reached]] = True
        now[n] = False
        if np.array_equal(now, reached):
            break
        reached, jump = now, jump[jump]
    reached = reached[:n] & whole
    owner = np.maximum.accumulate(np.where(reached, np.arange(n), -1))
    inside = (owner >= 0) & (offset < np.where(owner >= 0, target[owner], 0))
    return pd.DataFrame({"file": pieces["file"], "block": pieces["block"], "seq": pieces["seq"], "record": np.where(inside, offset[owner], -1), "starts": reached, "like_one": pieces["head"] > 0})


def _steady(spark: SparkSession) -> SparkSession:
    """A session like this one in which files are always cut alike: by size, not by how many executors there are now."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    return own


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Candidates: what stands between two magics, with its place, and header and content length if it has them.

    The places of two scans are the same if files are cut alike: spark is a _steady() session.
    """
    read = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    body = F.locate("\r\n\r\n", F.col("value"))
    head = F.when(body > 0, F.substring_index("value", "\r\n\r\n", 1))
    content = F.regexp_extract(head, r"(?i)(?:^|\r\n)content-length:[ \t]*([0-9]{1,15})[ \t]*(?:\r\n|$)", 1)
    head_bytes = F.when(F.length(content) > 0, F.octet_length(head) + 4).otherwise(0).cast("bigint")
    return read.select("*", F.octet_length("value").cast("bigint").alias("n"), head_bytes.alias("head"), F.when(F.length(content) > 0, content.cast("bigint")).otherwise(0).alias("content"), head.alias("headers"))


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce("headers", F.lit("")), rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _fields(payload: Column) -> list[Column]:
    return [
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Target-URI").alias("url"),
        _field("X-Page-Id").cast("bigint").alias("page_id"),
        _field("X-Refers-To-Page-Id").cast("bigint").alias("refers_to"),
        _field("X-Payload-Length").cast("bigint").alias("referred_bytes"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("declared_digest"),
        payload.alias("payload"),
    ]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives: record_type, url, page_id, refers_to, referred_bytes, declared_digest, payload (binary)."""
    pieces = _pieces(_steady(spark), path)
    chain = pieces.select("file", "block", "seq", "n", "head", "content").groupBy("file").applyInPandas(_chain, "file string, block bigint, seq bigint, record bigint, starts boolean, like_one boolean")
    chain = stored(chain, "warc-chain")
    # a record in one piece is read where it stands: its length says so, and the chain that it starts a record
    in_one = (F.col("head") > 0) & (F.col("n") >= F.col("head") + F.col("content"))
    payload = lambda raw, head, content: F.substring(raw, (head + 1).cast("int"), content.cast("int"))
    narrow = pieces.filter(in_one).select("file", "block", "seq", *_fields(payload(F.col("value").cast("binary"), F.col("head"), F.col("content"))))
    place = ["file", "block", "seq"]
    # what only looks like a record is rare, so as a rule payloads needn't move to leave it out
    fakes = chain.filter("like_one AND NOT starts").select(place)
    if fakes.count() * 256 <= FILTER_BROADCAST_BYTES:
        whole = narrow.join(F.broadcast(fakes), place, "left_anti").drop(*place)
    else:
        whole = narrow.join(chain.filter("starts").select(place), place, "left_semi").drop(*place)
    many = chain.filter("record >= 0").groupBy("file", "record").agg(F.count("*").alias("parts")).filter("parts > 1")
    if many.isEmpty():
        return whole
    parts = pieces.join(chain.join(many, ["file", "record"], "left_semi"), ["file", "block", "seq"])
    parts = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "seq", F.col("value").cast("binary").alias("raw")))).alias("p"), F.max(F.when(F.col("starts"), F.col("headers"))).alias("headers"), F.max(F.when(F.col("starts"), F.col("head"))).alias("head"), F.max(F.when(F.col("starts"), F.col("content"))).alias("content"))
    raw = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.col("p")[0]["raw"], lambda acc, x: F.concat(acc, F.lit(MAGIC).cast("binary"), x["raw"]))
    joined = parts.select("headers", "head", "content", raw.alias("raw")).filter(F.octet_length("raw") >= F.col("head") + F.col("content"))
    return whole.unionByName(joined.select(*_fields(payload(F.col("raw"), F.col("head"), F.col("content")))))


def archive(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", min_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    path = write(decide(pages, id_col, payload_col, url_col, min_bytes), new_path(pages.sparkSession, "warc"))
    back = read(pages.sparkSession, path)
    revisit = F.col("record_type") == "revisit"
    return back.select(
        "page_id",
        F.when(revisit, F.col("referred_bytes")).otherwise(F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(base32_sha1(F.col("payload"))).alias("payload_digest"),
        "record_type",
        "refers_to",
        "url",
    )
