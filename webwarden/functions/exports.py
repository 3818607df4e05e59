"""Texts and records for other systems: indicators, block rules, evidence digests, notices, packages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_host(url: Column) -> Column:
    return F.split_part(F.split_part(F.regexp_replace(url, r"^.*?://", ""), F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))


def identifier(text: Column) -> Column:
    """A name that rule languages accept."""
    return F.regexp_replace(text, "[^A-Za-z0-9_]", "_")


def indicator(url: Column, score: Column, brand: Column) -> Column:
    """JSON of one indicator; null below the export threshold of 0.35."""
    label = F.when(score >= 0.65, "malicious-activity").otherwise("anomalous-activity")
    body = F.struct(F.lit("indicator").alias("type"), F.concat(F.lit("[url:value = '"), F.replace(url, F.lit("'"), F.lit("\\'")), F.lit("']")).alias("pattern"), F.array(label).alias("labels"), F.floor(score * 100).cast("int").alias("confidence"), brand.alias("target"))
    return F.when(score >= 0.35, F.to_json(body))


def siem_rule(host: Column, score: Column) -> Column:
    level = F.when(score >= 0.65, "high").otherwise("medium")
    return F.concat_ws("\n", F.concat(F.lit("title: contact with "), host), F.lit("logsource:\n  category: proxy"), F.concat(F.lit("detection:\n  selection:\n    c-uri|contains: '"), host, F.lit("'\n  condition: selection")), F.concat(F.lit("level: "), level))


def content_rule(host: Column) -> Column:
    return F.concat(F.lit("rule host_"), identifier(host), F.lit(' { strings: $h = "'), host, F.lit('" nocase condition: $h }'))


def firewall_rules(host: Column, ip: Column) -> dict[str, Column]:
    """Block rules of five kinds; an unknown host is "invalid", an unknown address 0.0.0.0. The signature id comes
    from the host's checksum."""
    h = F.when(F.coalesce(host, F.lit("")) == "", "invalid").otherwise(host)
    a = F.when(F.coalesce(ip, F.lit("")) == "", "0.0.0.0").otherwise(ip)
    sid = (F.crc32(h) % 9_000_000 + 1_000_000).cast("string")
    return {
        "dns_zone": F.concat(h, F.lit(" CNAME .")), "packet_filter": F.concat(F.lit("iptables -A OUTPUT -d "), a, F.lit(" -j REJECT")), "proxy": F.concat(F.lit("acl blocked dstdomain ."), h),
        "ids": F.concat(F.lit('alert tls any any -> any any (msg:"blocked host"; tls.sni; content:"'), h, F.lit('"; sid:'), sid, F.lit(";)")), "hosts_file": F.concat(F.lit("0.0.0.0 "), h),
    }


def blocklist(scans: DataFrame, host: str, score: str, order: str) -> DataFrame:
    """(host, first): distinct hosts at or above the threshold, without local ones, with the place of their first scan."""
    keep = (F.col(score) >= 0.35) & (F.col(host) != "") & ~F.startswith(F.col(host), F.lit("127.")) & ~F.startswith(F.col(host), F.lit("localhost"))
    return scans.filter(keep).groupBy(F.col(host).alias("host")).agg(F.min(order).alias("first"))


def evidence_root(*leaves: tuple[Column, str]) -> Column:
    """Digest over the digests of the parts of a case, joined by pipes; a missing part counts as its default."""
    return F.sha2(F.concat_ws("|", *[F.sha2(F.coalesce(c, F.lit(d)), 256) for c, d in leaves]), 256)


def severity(score: Column, relay: Column) -> Column:
    return F.when((score >= 0.70) | relay, "CRITICAL").when(score >= 0.35, "HIGH").when(score >= 0.15, "MEDIUM").otherwise("LOW")


def narrative(host: Column, brand: Column, score: Column, relay: Column, cloak: Column) -> Column:
    """A few sentences about a scan, each only where it applies."""
    parts = [
        F.concat(F.lit("Host "), host, F.lit(" was rated "), severity(score, relay), F.lit(".")), F.when(F.coalesce(brand, F.lit("")) != "", F.concat(F.lit("It imitates "), brand, F.lit("."))),
        F.when(relay, F.lit("It relays a sign-in.")), F.when(cloak.isNotNull(), F.concat(F.lit("It hides behind "), cloak, F.lit("."))),
    ]
    return F.array_join(F.array_compact(F.array(*parts)), " ")


def takedown(url: Column, host: Column, ip: Column, brand: Column, contacts: dict[str, str]) -> Column:
    """Struct (report_id, contact, digest) of a notice; the contact follows from the longest suffix that fits."""
    digest = F.sha2(F.concat_ws("|", url, F.coalesce(host, F.lit("")), F.coalesce(ip, F.lit("")), F.coalesce(brand, F.lit(""))), 256)
    contact = F.coalesce(*[F.when(F.endswith(host, F.lit("." + s)), F.lit(c)) for s, c in sorted(contacts.items(), key=lambda x: (-len(x[0]), x[0]))], F.lit("abuse@registry.invalid"))
    return F.struct(F.upper(F.substring(digest, 1, 12)).alias("report_id"), contact.alias("contact"), digest.alias("digest"))


def packages(cases: DataFrame, id_col: str, members: list[str]) -> DataFrame:
    """(id, archive): a ZIP of the named text columns of each case, with their checksums; nulls are left out. Times
    inside are fixed, so equal cases give equal archives."""
    import hashlib

    schema = pa.schema([("id", pa.int64()), ("archive", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            out = []
            for row in zip(*cols[1:]):
                buffer, sums = io.BytesIO(), []
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, value in zip(members, row):
                        if value is not None:
                            raw = value.encode()
                            z.writestr(zipfile.ZipInfo(name + ".txt", (1980, 1, 1, 0, 0, 0)), raw)
                            sums.append(f"{hashlib.sha256(raw).hexdigest()}  {name}.txt")
                    z.writestr(zipfile.ZipInfo("checksums.txt", (1980, 1, 1, 0, 0, 0)), "\n".join(sums))
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(out, pa.binary())], schema=schema)

    return cases.select(F.col(id_col).cast("bigint").alias("id"), *members).mapInArrow(run, "id bigint, archive binary")
