"""Queries of the general training-data operators: repeated deliveries, instants, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webwarden.operators import deliveries, instants, shredding
from webwarden.session import materialize, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries.repeated_deliveries(table(spark, sf_dir, "ct_events")).select(F.col("row_id").alias("delivery_id"))


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries.kept_deliveries(table(spark, sf_dir, "ct_events")).select(F.col("row_id").alias("delivery_id"))


def p1_message_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries.message_sizes(table(spark, sf_dir, "ct_events"))


def validity_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validity times of certificate messages and TLS probes as (field_name, row_id, raw, zone)."""
    ct = instants.time_values(table(spark, sf_dir, "ct_events"), "delivery_id", "collector_zone", {c: f"ct_events.{c}" for c in ("not_before", "not_after")})
    tls = instants.time_values(table(spark, sf_dir, "tls_info"), "probe_id", "probe_zone", {c: f"tls_info.{c}" for c in ("valid_from", "valid_to")})
    return ct.unionAll(tls)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants.found_instants(validity_times(spark, sf_dir), instants.InstantDictionary(spark))


def p4_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw, uses): the strings that name no instant, with the number of values that have them."""
    values = validity_times(spark, sf_dir)
    bare = values.filter(~F.col("raw").rlike(instants.CANONICAL))
    distinct = bare.groupBy("raw", "zone").agg(F.count(F.lit(1)).alias("uses"))
    return distinct.filter(instants.instant_micros(F.col("raw"), F.col("zone")).isNull()).groupBy("raw").agg(F.sum("uses").alias("uses"))


def report_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(shredding.adjacency(table(spark, sf_dir, "scan_reports"), "report_id", "payload"), "nodes")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredding.child_rows(report_nodes(spark, sf_dir)).withColumnRenamed("record_id", "report_id")


def _entity(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    return shredding.entity_table(report_nodes(spark, sf_dir), entity).drop("node").withColumnRenamed("record_id", "report_id")


def p6_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entity(spark, sf_dir, "hops")


def p6_form_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entity(spark, sf_dir, "form_actions")


def p6_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entity(spark, sf_dir, "mitre_attack_techniques")


def p6_input_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entity(spark, sf_dir, "input_fields")


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p1_message_sizes, p4_found, p4_unreadable, p6_found, p6_hops, p6_form_actions, p6_techniques, p6_input_fields)}

_DIGEST = r"""
  CASE WHEN regexp_matches(regexp_replace(bare, '[:\s\-]', '', 'g'), '^[0-9a-fA-F]{64}$') THEN lower(regexp_replace(bare, '[:\s\-]', '', 'g'))
       WHEN regexp_matches(bare, '^[A-Za-z0-9+/_\-]{43}=?$') THEN lower(hex(from_base64(rpad(translate(bare, '-_', '+/'), 44, '=')))) END
"""
_MESSAGES = rf"""
WITH a AS (
  SELECT delivery_id, received_at, issuer, lower(domain) AS dom, regexp_replace(trim(fingerprint_sha256), '^sha-?256\s*[:_/=\-]?\s*', '', 'i') AS bare,
         regexp_replace(regexp_replace(lower(trim(serial_number)), '^0x', ''), '[:\s\-]', '', 'g') AS hx FROM ct_events),
b AS (SELECT delivery_id, received_at, {_DIGEST} AS fp, issuer || chr(1) || coalesce(nullif(ltrim(hx, '0'), ''), '0') || chr(1) || dom AS link FROM a),
m AS (SELECT link, arg_min(fp, (received_at, delivery_id)) AS fp FROM b WHERE fp IS NOT NULL AND link IS NOT NULL GROUP BY link),
k AS (SELECT b.delivery_id, b.received_at, coalesce(b.fp, m.fp, b.link, 'row:' || b.delivery_id) AS key FROM b LEFT JOIN m ON b.link = m.link),
r AS (SELECT delivery_id, key, row_number() OVER (PARTITION BY key ORDER BY received_at NULLS LAST, delivery_id) AS rn FROM k)
"""
# The oracle of the instants goes another way: strings are brought to a few shapes and read by format.
_TZ = "coalesce(zone, 'UTC')"
_OFFSETS = ", ".join(f"('{k}', {v})" for k, v in instants.ZONE_MINUTES.items())
_INSTANTS = rf"""
WITH v AS (SELECT 'ct_events.not_before' AS field_name, delivery_id AS row_id, not_before AS raw, collector_zone AS zone FROM ct_events UNION ALL SELECT 'ct_events.not_after', delivery_id, not_after, collector_zone FROM ct_events
 UNION ALL SELECT 'tls_info.valid_from', probe_id, valid_from, probe_zone FROM tls_info UNION ALL SELECT 'tls_info.valid_to', probe_id, valid_to, probe_zone FROM tls_info),
u AS (SELECT *, trim(raw) AS t FROM v WHERE raw IS NOT NULL AND NOT regexp_matches(raw, '{instants.CANONICAL}')),
n AS (SELECT *, CASE WHEN regexp_matches(t, '^\d{{9,19}}(\.\d*)?$') THEN CASE length(split_part(t, '.', 1)) WHEN 9 THEN 1000000 WHEN 10 THEN 1000000 WHEN 12 THEN 1000 WHEN 13 THEN 1000 WHEN 15 THEN 1 WHEN 16 THEN 1 ELSE 0 END END AS f FROM u),
i AS (SELECT *, regexp_extract(t, '^(\d{{4}}-\d\d-\d\d)[Tt ](\d\d:\d\d)(:\d\d)?(?:[.,](\d+))? ?([A-Za-z]{{1,5}}|[+-]\d\d(?::?\d\d)?)?$', ['d', 'm', 's', 'f', 'z']) AS p FROM n),
j AS (SELECT *, CASE WHEN f IS NOT NULL THEN NULL WHEN p.d <> '' THEN try_strptime(p.d || ' ' || p.m || CASE WHEN p.s = '' THEN ':00' ELSE p.s END, '%Y-%m-%d %H:%M:%S')
 ELSE coalesce(try_strptime(regexp_replace(t, ' (GMT|[+-]\d{{4}})$', ''), ['%b %d %H:%M:%S %Y', '%d/%b/%Y:%H:%M:%S', '%a, %d %b %Y %H:%M:%S', '%b %d, %Y %I:%M:%S %p', '%d.%m.%Y %H:%M:%S', '%Y%m%dT%H%M%SZ', '%Y%m%d%H%M%SZ']), CASE WHEN regexp_matches(t, '^\d{{12}}Z$') THEN try_strptime('20' || t, '%Y%m%d%H%M%SZ') END) END AS wall,
 CASE WHEN p.d <> '' THEN p.z WHEN regexp_matches(t, '(GMT|\dZ)$') THEN 'Z' ELSE regexp_extract(t, ' ([+-]\d{{4}})$', 1) END AS mark FROM i),
o(name, minutes) AS (VALUES {_OFFSETS}),
k AS (SELECT j.*, CASE WHEN mark = '' THEN NULL WHEN regexp_matches(mark, '^[+-]') THEN (CASE WHEN mark[1] = '-' THEN -1 ELSE 1 END) * (mark[2:3]::INT * 60 + coalesce(nullif(replace(mark, ':', '')[4:5], '')::INT, 0)) ELSE minutes END AS minutes FROM j LEFT JOIN o ON upper(mark) = o.name),
r AS (SELECT field_name, row_id, raw, CASE WHEN f = 0 THEN (t::HUGEINT // 1000)::BIGINT WHEN f IS NOT NULL THEN split_part(t, '.', 1)::BIGINT * f + coalesce(nullif(rpad(split_part(t, '.', 2), 6, '0'), '000000')::BIGINT, 0) * f // 1000000
 WHEN wall IS NULL THEN NULL WHEN mark = '' THEN least(epoch_us(timezone({_TZ}, wall)), epoch_us(timezone({_TZ}, wall - INTERVAL 1 HOUR)) + 3600000000) + coalesce(nullif(rpad(left(p.f, 6), 6, '0'), '000000')::BIGINT, 0)
 ELSE epoch_us(wall) - minutes::BIGINT * 60000000 + coalesce(nullif(rpad(left(p.f, 6), 6, '0'), '000000')::BIGINT, 0) END AS utc_micros FROM k)
"""
#: The same with the values that are written in the usual form already.
INSTANTS_OF_ALL = _INSTANTS.replace(f" AND NOT regexp_matches(raw, '{instants.CANONICAL}')", "")
_UNTEXT = "CASE WHEN json_type({0}) = 'VARCHAR' AND regexp_matches(trim({0} ->> '$'), '^[\\[{{]') AND json_valid({0} ->> '$') THEN ({0} ->> '$')::JSON ELSE {0} END"
_LISTED = "CASE WHEN json_type({0}) = 'ARRAY' THEN {0} ELSE json_array({0}) END"
# Every list of an entity by its path; a place is an element's index, and the parent of an input field is the form
# whose list holds it. Forms are opened first, since a list that came as text hides its fields.
_SHREDDED = f"""
WITH d AS (SELECT report_id, payload::JSON AS j FROM scan_reports WHERE json_valid(payload)),
t AS (SELECT report_id, coalesce(nullif(regexp_extract(x.fullkey, 'results\\[(\\d+)\\]', 1), '')::INT, 0) AS result_pos, x.key AS child, {_UNTEXT.format('x.value')} AS v FROM d, json_tree(d.j) x WHERE x.key IN ('hops', 'form_actions', 'mitre_attack_techniques')),
l AS (SELECT report_id, result_pos, child, {_LISTED.format('v')} AS v FROM t WHERE json_type(v) NOT IN ('NULL', 'VARCHAR')),
e AS (SELECT report_id, result_pos, child, i::INT AS pos, json_extract(v, '$[' || i || ']') AS o FROM l, range(0, 10000) r(i) WHERE i < json_array_length(v)),
k AS (SELECT * FROM e WHERE json_type(o) = 'OBJECT'),
g AS (SELECT report_id, result_pos, pos, {_UNTEXT.format("json_extract(o, '$.input_fields')")} AS v FROM k WHERE child = 'form_actions' AND json_extract(o, '$.input_fields') IS NOT NULL),
h AS (SELECT report_id, result_pos, pos, {_LISTED.format('v')} AS v FROM g WHERE json_type(v) <> 'NULL'),
f AS (SELECT report_id, result_pos, pos, i::INT AS place, json_extract(v, '$[' || i || ']') AS o FROM h, range(0, 10000) r(i) WHERE i < json_array_length(v))
"""
SQL = {
    "p4_found": _INSTANTS + "SELECT field_name, row_id, utc_micros FROM r WHERE utc_micros IS NOT NULL",
    "p4_unreadable": _INSTANTS + "SELECT raw, count(*) AS uses FROM r WHERE utc_micros IS NULL GROUP BY raw",
    "p6_found": _SHREDDED + """SELECT report_id, result_pos, child, -1 AS parent_pos, pos AS child_pos, CASE child WHEN 'hops' THEN o ->> '$.url' WHEN 'form_actions' THEN o ->> '$.action_url' ELSE o ->> '$.id' END AS child_key FROM k
UNION ALL SELECT report_id, result_pos, 'input_fields', pos, place, CASE WHEN json_type(o) = 'VARCHAR' THEN o ->> '$' ELSE coalesce(o ->> '$.name', '') || ':' || coalesce(o ->> '$.type', '') END FROM f WHERE json_type(o) IN ('OBJECT', 'VARCHAR') AND (o ->> '$') <> ''""",
    "p1_found": _MESSAGES + "SELECT delivery_id FROM r WHERE rn > 1",
    "p1_kept": _MESSAGES + "SELECT delivery_id FROM r WHERE rn = 1",
    "p1_message_sizes": _MESSAGES + "SELECT copies, count(*) AS messages FROM (SELECT key, count(*) AS copies FROM r GROUP BY key) GROUP BY copies",
}


def _entity_sql(entity: str) -> str:
    """The flat table of an entity of _SHREDDED, in the columns of shredding.ENTITIES: scalars as the JSON spells them."""
    value = lambda c: f"CASE WHEN json_type(json_extract(o, '$.{c}')) IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL ELSE o ->> '$.{c}' END AS {c}"
    columns = ", ".join(value(c) for c in shredding.ENTITIES[entity])
    if entity == "input_fields":
        return _SHREDDED + f"SELECT report_id, result_pos, pos AS parent_pos, place AS child_pos, CASE WHEN json_type(o) = 'VARCHAR' THEN o ->> '$' END AS text, {columns} FROM f WHERE json_type(o) IN ('OBJECT', 'VARCHAR') AND (o ->> '$') <> ''"
    return _SHREDDED + f"SELECT report_id, result_pos, -1 AS parent_pos, pos AS child_pos, {columns} FROM k WHERE child = '{entity}'"


SQL |= {f"p6_{name}": _entity_sql(entity) for name, entity in (("hops", "hops"), ("form_actions", "form_actions"), ("techniques", "mitre_attack_techniques"), ("input_fields", "input_fields"))}
