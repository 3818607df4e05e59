"""Messages delivered more than once: exactly one copy of each is kept.

Identifiers are split by aggregated frequency. One map-side-combined aggregate counts each identifier and holds its
first delivery; identifiers seen once pass straight out of that aggregate, and only the rows of identifiers seen
more often are brought together and ranked, in two salted steps, so that a message delivered a billion times is
never sorted by one task. The two parts are united. A store keeps the identifiers of earlier messages, so that a new
batch is held against them without reading the old deliveries again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webwarden.functions.skew import lookup_join, salted_rank
from webwarden.session import materialize, path_exists

_PREFIX = r"(?i)^sha-?256\s*[:_/=\-]?\s*"


def sha256_digest(text: Column) -> Column:
    """The 32 bytes of a SHA-256 fingerprint however written: hexadecimal with or without separators, in either
    case, base64 or base64url, with or without an algorithm prefix. Null for null, blank and anything else."""
    bare = F.regexp_replace(F.trim(text), _PREFIX, "")
    packed = F.regexp_replace(bare, r"[:\s\-]", "")
    b64 = F.translate(bare, "-_", "+/")
    return F.when(packed.rlike("^[0-9a-fA-F]{64}$"), F.unhex(packed)).when(b64.rlike("^[A-Za-z0-9+/]{43}=?$"), F.unbase64(F.rpad(b64, 44, "=")))


def serial_value(text: Column) -> Column:
    """A hexadecimal serial number as lower-case digits without prefix, separators and leading zeros ("0" for zero).
    Text that is no hexadecimal number is kept, trimmed and in lower case; null and blank give null."""
    low = F.lower(F.trim(text))
    digits = F.regexp_replace(F.regexp_replace(low, "^0x", ""), r"[:\s\-]", "")
    value = F.when(digits.rlike("^[0-9a-f]+$"), F.coalesce(F.nullif(F.regexp_replace(digits, "^0+", ""), F.lit("")), F.lit("0"))).otherwise(low)
    return F.nullif(value, F.lit(""))


def _prepared(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    c = {k: F.col(f"`{v}`") for k, v in cols.items()}
    names = F.concat_ws("\u0001", c["issuer"], serial_value(c["serial"]), F.lower(c["domain"]))
    whole = c["issuer"].isNotNull() & serial_value(c["serial"]).isNotNull() & c["domain"].isNotNull()
    return df.select(
        c["id"].alias("row_id"),
        c["time"].alias("at"),
        sha256_digest(c["fingerprint"]).alias("digest"),
        F.when(whole, F.unhex(F.md5(names))).alias("link"),
    )


#: The columns of a delivery by their part in the operator.
CT_COLUMNS = {"id": "delivery_id", "time": "received_at", "fingerprint": "fingerprint_sha256", "serial": "serial_number", "issuer": "issuer", "domain": "domain"}


def keyed_deliveries(df: DataFrame, cols: dict[str, str] = CT_COLUMNS, stored: DataFrame | None = None) -> DataFrame:
    """(row_id, at, key): the message that each delivery belongs to.

    The key is the fingerprint's digest. A row without a readable fingerprint takes the digest of the rows that
    agree with it in issuer, serial value and domain (of several digests the one delivered first), else these three
    together; where one of the three is null it agrees with nothing and is a message of its own. `stored` holds
    deliveries of earlier batches with the same columns.
    """
    base = _prepared(df, cols)
    if stored is not None:
        base = base.unionAll(_prepared(stored, cols))
    return _keyed(materialize(base, "deliveries"))


def _keyed(base: DataFrame) -> DataFrame:
    named = base.filter(F.col("digest").isNotNull())
    bare = base.filter(F.col("digest").isNull())
    linked = bare.filter(F.col("link").isNotNull()).select("row_id", "at", "link")
    asked = linked.groupBy("link").agg(F.count(F.lit(1)).alias("asking"))
    leads = lookup_join(named, asked, "link", "asking").groupBy("link").agg(F.min(F.struct("at", "row_id", "digest")).alias("lead"))
    keys = asked.join(leads, "link", "left").select("link", "asking", F.coalesce("lead.digest", "link").alias("key"))
    found = lookup_join(linked, materialize(keys, "links"), "link", "asking")
    own = F.encode(F.concat(F.lit("row:"), F.col("row_id").cast("string")), "utf-8")
    keyed = (
        named.select("row_id", "at", F.col("digest").alias("key"))
        .unionAll(found.select("row_id", "at", "key"))
        .unionAll(bare.filter(F.col("link").isNull()).select("row_id", "at", own.alias("key")))
    )
    # Counted, and read twice more by a join: written once, so that the links are not joined each time.
    return materialize(keyed, "keyed")


def split_by_frequency(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(singles, repeated): singles (row_id) come out of the aggregate; repeated (key, copies) has the rest's keys."""
    freq = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("row_id").alias("only"))
    return freq.filter("copies = 1").select(F.col("only").alias("row_id"), F.lit(1).alias("_rank")), freq.filter("copies > 1").select("key", "copies")


def ranked_repeats(keyed: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of repeated messages with `_rank`, 1 for the first by time, then by id (null times last)."""
    rows = lookup_join(keyed, materialize(repeated, "repeated"), "key", "copies")
    return salted_rank(rows, "key", [F.col("at").asc_nulls_last(), F.col("row_id")], "row_id")


def repeated_deliveries(df: DataFrame, cols: dict[str, str] = CT_COLUMNS, stored: DataFrame | None = None) -> DataFrame:
    """(row_id) of every delivery that is not the first of its message; empty input gives an empty result.

    Rows with equal time are ordered by id; a repeated id counts as a delivery of its own each time.
    """
    keyed = keyed_deliveries(df, cols, stored)
    _, repeated = split_by_frequency(keyed)
    return ranked_repeats(keyed, repeated).filter("_rank > 1").select("row_id")


def kept_deliveries(df: DataFrame, cols: dict[str, str] = CT_COLUMNS, stored: DataFrame | None = None) -> DataFrame:
    """(row_id) of exactly one delivery of each message: the singles, united with the leaders of the rest."""
    keyed = keyed_deliveries(df, cols, stored)
    singles, repeated = split_by_frequency(keyed)
    first = ranked_repeats(keyed, repeated).filter("_rank = 1")
    return singles.select("row_id").unionAll(first.select("row_id"))


def message_sizes(df: DataFrame, cols: dict[str, str] = CT_COLUMNS) -> DataFrame:
    """(copies, messages): how many messages were delivered how often."""
    keyed = keyed_deliveries(df, cols)
    per_key = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    return per_key.groupBy("copies").agg(F.count(F.lit(1)).alias("messages"))


class MessageStore:
    """The identifiers of all messages kept so far, a table (ident, linked) in the shared folder: a fingerprint's
    digest, or the digest of issuer, serial value and domain. linked is false for the latter while no fingerprint is
    known for them, so that the first fingerprint that agrees is a repeat and not a message of its own.

    Every batch is written into a folder of its own, which appears as a whole or not at all; an identifier that several
    batches have is read once.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.schema = spark, path, "ident binary, linked boolean"

    def read(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        batches = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
        return batches.groupBy("ident").agg(F.bool_or("linked").alias("linked"))

    def accept(self, df: DataFrame, cols: dict[str, str] = CT_COLUMNS) -> DataFrame:
        """(row_id) of the deliveries of a new batch that are the first of messages that the store does not have; their
        identifiers are added. Only the batch is keyed and ranked; of the store the identifiers are read."""
        base = materialize(_prepared(df, cols), "deliveries")
        keyed = _keyed(base)
        # What a row asks for: its digest; as a row without one its link; as a row with one a link that no digest has yet.
        bare = F.col("digest").isNull()
        asks = F.array_compact(F.array(F.struct(F.col("digest").alias("ident"), F.lit(False).alias("unlinked")), F.struct(F.col("link").alias("ident"), (~bare).alias("unlinked"))))
        asked = base.select("row_id", F.explode(asks).alias("a")).select("row_id", "a.ident", "a.unlinked").filter("ident is not null")
        wanted = asked.groupBy("ident").agg(F.count(F.lit(1)).alias("uses"))
        stored = materialize(wanted.join(self.read(), "ident").select("ident", "uses", "linked"), "stored")
        known_rows = lookup_join(asked, stored, "ident", "uses").filter(~(F.col("unlinked") & F.col("linked"))).select("row_id").distinct()
        known = keyed.join(known_rows, "row_id", "left_semi").select("key").distinct()
        singles, repeated = split_by_frequency(keyed)
        first = singles.select("row_id").unionAll(ranked_repeats(keyed, repeated).filter("_rank = 1").select("row_id"))
        new = materialize(keyed.join(first, "row_id", "left_semi").join(known, "key", "left_anti").select("row_id"), "new")
        digests = base.filter(~bare).select(F.col("digest").alias("ident"), F.lit(True).alias("linked"))
        links = base.filter(F.col("link").isNotNull()).select(F.col("link").alias("ident"), (~bare).alias("linked"))
        digests.unionAll(links).groupBy("ident").agg(F.bool_or("linked").alias("linked")).write.parquet(f"{self.path}/batch-{uuid.uuid4().hex}")
        return new
