"""Times in mixed formats, precisions and zones, brought to microseconds since 1970-01-01 UTC.

Raw strings are deduplicated together with the zone of their source into a dictionary of distinct values. Each
distinct value is parsed once, by trying every known notation, and the dictionary is a table in the shared folder to
which later calls append only the strings they bring new. The instants are then joined back to the rows.
Everything runs as built-in expressions inside the JVM.
"""

from __future__ import annotations

import uuid
from hashlib import md5

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webwarden.functions.skew import lookup_join
from webwarden.session import materialize, path_exists, shared_dir

# Offsets in minutes of the zone abbreviations that certificate tools and mail headers write.
ZONE_MINUTES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"\s*([A-Za-z]{1,5}|[+-]\d{2}(?::?\d{2})?|\[?[A-Z][A-Za-z]+(?:/[A-Z][A-Za-z0-9_+\-]*){1,2}\]?)?(?:\[[A-Za-z0-9_+\-/]+\])?"
#: Each notation: a pattern, and the groups of year, month, day, hour, minute, second, fraction, half of day, zone (0: none).
NOTATIONS = [
    (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})[Tt ]\s*{_CLOCK}{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    (r"^(\d{4})(\d{2})(\d{2})[Tt ]?(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?([Zz]|[+-]\d{2}:?\d{2})$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    (r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})(?:[.,](\d+))?$", (1, 2, 3, 4, 5, 6, 7, 0, 0)),
    (r"^(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})?([Zz]|[+-]\d{4})$", (1, 2, 3, 4, 5, 6, 0, 0, 7)),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}),?\s+{_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 0, 8)),
    (rf"^([A-Za-z]{{3}})[a-z]*\.?\s+(\d{{1,2}})\s+{_CLOCK}\s+(\d{{4}}){_ZONE}$", (7, 1, 2, 3, 4, 5, 6, 0, 8)),
    (rf"^([A-Za-z]{{3}})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_CLOCK}\s*([AaPp])\.?[Mm]\.?{_ZONE}$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    (rf"^([A-Za-z]{{3}})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_CLOCK}{_ZONE}$", (3, 1, 2, 4, 5, 6, 7, 0, 8)),
    (rf"^(\d{{1,2}})/([A-Za-z]{{3}})/(\d{{4}}):{_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 0, 8)),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[\s-]([A-Za-z]{{3}})[a-z]*[\s-](\d{{4}}|\d{{2}})\s+{_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 0, 8)),
    (rf"^[A-Za-z]{{3,9}},?\s+([A-Za-z]{{3}})[a-z]*\s+(\d{{1,2}})\s+{_CLOCK}\s+(\d{{4}}){_ZONE}$", (7, 1, 2, 3, 4, 5, 6, 0, 8)),
]
#: A bare number: its digits before the point tell the unit that gives a present-day time (years 1973 to 2286).
UNITS = [(9, 10, 6), (12, 13, 3), (15, 16, 0), (18, 19, -3)]
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def _known_zones() -> list[str]:
    """The zone names of the JVM's time zone data (about 600)."""
    return sorted(str(z) for z in SparkContext._active_spark_context._jvm.java.time.ZoneId.getAvailableZoneIds())


def _utc_micros(wall_micros: Column, zone: Column) -> Column:
    """Microseconds UTC of a wall-clock time in a named zone: the first of two occurrences, and the offset before the
    change where the time is skipped (both are what java.time gives). Unknown zone names count as UTC."""
    known = F.when(zone.isin(_known_zones()) | zone.rlike(r"^[+-](0\d|1[0-8]):[0-5]\d$"), zone).otherwise("UTC")
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall_micros), known))


def _parts(text: Column) -> Column:
    """The nine parts (year, month, day, hour, minute, second, fraction, half of day, zone) of the first notation
    that a string matches, as an array with nulls for what is not there; null if it matches none."""
    parts = F.lit(None).cast("array<string>")
    for pattern, groups in reversed(NOTATIONS):
        found = F.array(*[F.nullif(F.regexp_extract(text, pattern, i), F.lit("")) if i else F.lit(None).cast("string") for i in groups])
        parts = F.when(text.rlike(pattern), found).otherwise(parts)
    return parts


def _composed(part: Column, zone: Column) -> Column:
    """The instant of nine parts; null where the date, the clock time or the zone does not exist."""
    year, month, day, hour, minute, second, fraction, half, mark = [part[i] for i in range(9)]
    y = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year).cast("int")
    by_name = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(i))])
    mo = F.coalesce(F.try_element_at(by_name, F.lower(month)), month.try_cast("int"))
    h24, mi, s = hour.cast("int"), minute.cast("int"), F.coalesce(second, F.lit("0")).cast("int")
    h12 = F.when(h24.between(1, 12), h24 % 12 + F.when(F.lower(half) == "p", 12).otherwise(0))
    h = F.when(half.isNull(), h24).otherwise(h12)
    midnight = F.unix_micros(F.try_make_timestamp(y, mo, day.cast("int"), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")))
    clock = (h.cast("long") * 3600 + mi * 60 + s) * 1000000 + F.coalesce(F.rpad(F.substring(fraction, 1, 6), 6, "0").cast("long"), F.lit(0))
    # A leap second is the first of the next minute, 24:00 the midnight that ends the day.
    wall = F.when(((h < 24) & (mi < 60) & (s <= 60)) | ((h == 24) & (mi == 0) & (s == 0)), midnight + clock)
    place = F.when(F.contains(mark, F.lit("/")), F.regexp_replace(mark, r"[\[\]]", ""))
    names = F.create_map(*[x for k, v in ZONE_MINUTES.items() for x in (F.lit(k), F.lit(v))])
    digits = F.regexp_replace(mark, ":", "")
    size = F.substring(digits, 2, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 4, 2).try_cast("int"), F.lit(0))
    minutes = F.when(mark.rlike(r"^[+-]"), F.when(F.startswith(mark, F.lit("-")), -size).otherwise(size)).otherwise(F.try_element_at(names, F.upper(mark)))
    return F.when(mark.isNull(), _utc_micros(wall, zone)).when(place.isin(_known_zones()), _utc_micros(wall, place)).otherwise(wall - minutes.cast("long") * 60000000)


def _number(raw: Column) -> Column:
    whole = F.regexp_extract(raw, r"^(\d{9,19})(?:[.,](\d*))?$", 1)
    part = F.regexp_extract(raw, r"^(\d{9,19})(?:[.,](\d*))?$", 2)
    value = F.lit(None).cast("long")
    for low, high, power in UNITS:
        shifted = F.substring(F.concat(whole, F.rpad(part, 6, "0")), F.lit(1), F.length(whole) + power)
        value = F.when(F.length(whole).between(low, high), shifted.cast("long")).otherwise(value)
    return value


def instant_micros(raw: Column, zone: Column) -> Column:
    """Microseconds since 1970 UTC that a string names, cut off below the microsecond; null where it names none
    (null, blank, words, dates that do not exist, dates alone, which name a day). Times without zone are local to `zone` (UTC if null)."""
    text = F.regexp_replace(F.trim(raw), r"[  ]", " ")
    # The lambda binds the parts once: written out, each of their thirty uses would match the patterns again.
    by_notation = F.transform(F.array(_parts(text)), lambda part: _composed(part, zone))[0]
    return F.when(text.rlike(r"^\d{9,19}([.,]\d*)?$"), _number(text)).otherwise(by_notation)


#: Names the state of the notations above: a dictionary that was parsed by others is not used.
PARSER = md5(repr((NOTATIONS, sorted(ZONE_MINUTES.items()), MONTHS, UNITS, 2)).encode()).hexdigest()[:12]


class InstantDictionary:
    """A table (lookup, micros) of distinct strings with their zones in the shared folder, which grows by the strings
    that each call brings new. micros is null for those that name no instant, so that they are not tried again.

    Every call writes one batch into a folder of its own, which appears as a whole or not at all. Two writers may bring
    the same string, and a call may be repeated: a string is read once, however many batches have it.
    """

    def __init__(self, spark, path: str | None = None):
        """Without a path it is the one dictionary of the shared folder, kept for later sessions."""
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/webwarden-instants/{PARSER}"
        self.schema = "lookup string, micros bigint"

    def exists(self) -> bool:
        return path_exists(self.spark, self.path)

    def read(self) -> DataFrame:
        """(lookup, micros), one row per string."""
        if not self.exists():
            return self.spark.createDataFrame([], self.schema)
        batches = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
        return batches.groupBy("lookup").agg(F.max("micros").alias("micros"))

    def append(self, parsed: DataFrame) -> None:
        parsed.select("lookup", "micros").write.parquet(f"{self.path}/batch-{uuid.uuid4().hex}")


def time_values(df: DataFrame, id_col: str, zone_col: str, fields: dict[str, str]) -> DataFrame:
    """(field_name, row_id, raw, zone) of the non-null values of several string columns of one table."""
    pairs = F.array(*[F.struct(F.lit(name).alias("field_name"), F.col(f"`{c}`").alias("raw")) for c, name in fields.items()])
    return df.select(F.col(f"`{id_col}`").alias("row_id"), F.col(f"`{zone_col}`").alias("zone"), F.explode(pairs).alias("v")).select("v.field_name", "row_id", "v.raw", "zone").filter(F.col("raw").isNotNull())


def normalise_instants(values: DataFrame, dictionary: InstantDictionary | None = None) -> DataFrame:
    """(field_name, row_id, utc_micros) for each value that names an instant.

    Takes (field_name, row_id, raw, zone). Null and unreadable values give no row; repeated rows give a row each;
    an empty table gives an empty result. A string that says its own zone is parsed under that zone only. With a
    dictionary only the strings that it lacks are parsed, and they are added to it.
    """
    packed = values.withColumn("lookup", F.concat_ws("\u0001", F.coalesce("zone", F.lit("")), "raw"))
    distinct = packed.groupBy("lookup").agg(F.first("raw").alias("raw"), F.first("zone").alias("zone"), F.count(F.lit(1)).alias("uses"))
    parsed = instant_micros(F.col("raw"), F.col("zone"))
    if dictionary is None or not dictionary.exists():
        table = materialize(distinct.select("lookup", "uses", parsed.alias("micros"), F.lit(True).alias("is_new")), "instants")
    else:
        known = dictionary.read().select("lookup", F.col("micros").alias("k_micros"), F.lit(True).alias("is_known"))
        new = F.col("is_known").isNull()
        table = materialize(distinct.join(known, "lookup", "left").select("lookup", "uses", F.when(new, parsed).otherwise(F.col("k_micros")).alias("micros"), new.alias("is_new")), "instants")
    if dictionary is not None:
        new = table.filter("is_new")
        if new.limit(1).count():
            dictionary.append(new)
    named = table.filter(F.col("micros").isNotNull()).select("lookup", "uses", F.col("micros").alias("utc_micros"))
    return lookup_join(packed.select("field_name", "row_id", "lookup"), named, "lookup", "uses").select("field_name", "row_id", "utc_micros")


def found_instants(values: DataFrame, dictionary: InstantDictionary | None = None) -> DataFrame:
    """As normalise_instants, for the values that are not already written YYYY-MM-DDTHH:MM:SSZ."""
    return normalise_instants(values.filter(~F.col("raw").rlike(CANONICAL)), dictionary)
