"""Queries over certificates, TLS probes, headers, DNS observations and redirect chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webwarden.functions import network as n
from webwarden.functions.urls import host
from webwarden.operators import instants
from webwarden.plans.training import INSTANTS_OF_ALL, report_nodes, table
from webwarden.plans.training import SQL as TRAINING_SQL
from webwarden.plans.urls import brand_ids
from webwarden.operators.shredding import entity_table


def signatures(spark, sf_dir) -> dict[str, list[str]]:
    """Words of each brand: its name, and the name with digits in place of letters."""
    return {b: [b, b.replace("l", "1").replace("o", "0")] for b in brand_ids(spark, sf_dir)}


def cert_risk(spark, sf_dir):
    r = n.certificate_risk(F.col("domain"), F.col("issuer"), signatures(spark, sf_dir))
    return table(spark, sf_dir, "ct_events").filter("domain is not null").select("delivery_id", r.alias("r")).select("delivery_id", "r.brand", "r.score", "r.verdict")


def cert_risk_by_issuer(spark, sf_dir):
    return table(spark, sf_dir, "ct_events").groupBy("issuer", "risk_verdict").agg(F.count(F.lit(1)).alias("events"), F.round(F.avg("risk_score"), 4).alias("mean_score"), F.countDistinct("matched_brand").alias("brands"))


def cert_lookalike(spark, sf_dir):
    r = n.lookalike(F.col("domain"), brand_ids(spark, sf_dir))
    rows = table(spark, sf_dir, "certstream_events").select("event_id", F.explode(F.array(r)).alias("r"))
    return rows.filter("r.keep").select("event_id", "r.brand", F.array_join("r.triggers", ",").alias("triggers"), "r.level")


def ct_recent(spark, sf_dir):
    """The twenty newest certificate messages."""
    return table(spark, sf_dir, "ct_events").select("delivery_id", "event_epoch", "domain", "risk_verdict").orderBy(F.col("event_epoch").desc(), "delivery_id").limit(20)


def tls_flags(spark, sf_dir):
    t = table(spark, sf_dir, "tls_info")
    low = F.lower("issuer")
    free = F.coalesce(F.contains(low, F.lit("free")) | F.contains(low, F.lit("acme")), F.lit(False))
    return t.select("probe_id", F.coalesce(F.col("issuer") == F.col("subject"), F.lit(False)).alias("self_signed"), free.alias("free_issuer"), F.coalesce(F.size(F.slice("san_list", 1, 10)), F.lit(0)).alias("names"), F.coalesce(F.size(F.array_distinct("san_list")), F.lit(0)).alias("distinct_names"))


def tls_days_to_expiry(spark, sf_dir):
    """Whole days from each probe to the end of validity, whatever the notation of the latter."""
    t = table(spark, sf_dir, "tls_info")
    ends = instants.normalise_instants(instants.time_values(t, "probe_id", "probe_zone", {"valid_to": "tls_info.valid_to"})).select(F.col("row_id").alias("probe_id"), "utc_micros")
    days = F.floor((F.col("utc_micros") - F.unix_micros(F.col("probed_at").cast("timestamp"))) / 86_400_000_000)
    return t.select("probe_id", "probed_at").join(ends, "probe_id").select("probe_id", days.alias("days_left"))


def header_blocks(spark, sf_dir) -> DataFrame:
    """(c_custkey, raw): a header block for each customer; its headers follow from the key's bits."""
    k = F.col("c_custkey")
    line = lambda bit, text: F.when(F.shiftright(k, bit).bitwiseAND(1) == 1, text)
    banner = F.element_at(F.array(*[F.lit(b) for b in ("Apache/2.2.15", "nginx/1.24.0", "Microsoft-IIS/6.0", "nginx/1.1.0", "")]), (k % 5 + 1).cast("int"))
    lines = F.array(
        F.when(k % 3 == 0, "HTTP/1.1 302 Found\r\nLocation: /a\r\n"), F.when(k % 6 == 0, "HTTP/1.1 302 Found\r\nLocation: /b\r\n"), F.lit("HTTP/1.1 200 OK"), F.concat(F.lit("Server: "), banner),
        line(0, "Strict-Transport-Security: max-age=1"), line(1, "Content-Security-Policy: default-src 'self'"), line(2, "X-Frame-Options: DENY"), line(3, "X-Content-Type-Options: nosniff"), line(4, "Referrer-Policy: no-referrer"), line(5, "Permissions-Policy: x"),
        line(6, "Set-Cookie: a=1; HttpOnly"), line(7, "set-cookie: b=2; Secure; SameSite=Lax"), F.when(k % 4 == 0, "Cache-Control: no-store"), F.when(k % 7 == 0, "Content-Type: Text/HTML; charset=utf-8"),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_compact(lines), "\r\n").alias("raw"))


def header_risk(spark, sf_dir):
    return header_blocks(spark, sf_dir).select("c_custkey", n.header_risk(n.parse_header_block(F.col("raw"))).alias("r")).select("c_custkey", "r.*")


def dns_observations(spark, sf_dir) -> DataFrame:
    """(name, asn, reputation, ttl): a resolution for each order line, its network the supplier's nation."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return table(spark, sf_dir, "lineitem").join(s, "l_suppkey").select(F.col("l_orderkey").alias("name"), F.col("s_nationkey").alias("asn"), (F.col("s_nationkey") % 10 / 10).alias("reputation"), (F.col("l_quantity") * 10).alias("ttl"))


def dns_fastflux(spark, sf_dir):
    return n.fast_flux(dns_observations(spark, sf_dir), "name", "asn", "reputation", "ttl").withColumnRenamed("name", "order_key")


def dns_verdicts(spark, sf_dir):
    return dns_fastflux(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("names"), F.round(F.avg("flux_index"), 4).alias("mean_index"))


def dns_networks(spark, sf_dir):
    """Probes by the network of the address that they resolved."""
    return table(spark, sf_dir, "tls_info").select(n.network_of(F.col("resolved_ip")).alias("a")).groupBy("a.asn", "a.reputation").agg(F.count(F.lit(1)).alias("probes"))


def redirect_graph(spark, sf_dir):
    """Chains of four consecutive scans."""
    hops = table(spark, sf_dir, "lexical_features").select(F.floor(F.col("feature_id") / 4).alias("chain"), (F.col("feature_id") % 4).alias("hop"), "url").filter("url is not null")
    return n.redirect_chains(hops, ["chain"], "hop", "url")


def redirect_report_chains(spark, sf_dir):
    """The chains that scan reports nest, whatever their depth."""
    hops = entity_table(report_nodes(spark, sf_dir), "hops").filter("url is not null")
    return n.redirect_chains(hops, ["record_id", "result_pos"], "child_pos", "url").withColumnRenamed("record_id", "report_id")


def latest(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last row of each key by time, then by id: an aggregate with the row in its buffer, no sort of a hot key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(at, tie)).alias("r")).select(key, "r.*")


def relay_suspects(spark, sf_dir):
    tls = latest(table(spark, sf_dir, "tls_info").select("scan_id", "probe_id", "probed_at", "has_tls", "is_free_ca", "is_self_signed"), "scan_id", "probed_at", "probe_id")
    pages = table(spark, sf_dir, "page_captures").select("capture_id", "scan_id", "url", "dom_html", "matched_brand", "s_phish")
    r = n.relay_suspicion(F.col("url"), F.col("s_phish"), F.col("matched_brand"), F.lit(False), F.col("has_tls"), F.col("is_free_ca"), F.col("is_self_signed"), F.col("dom_html"))
    return pages.join(tls, "scan_id", "left").select("capture_id", r.alias("r")).select("capture_id", "r.suspect", "r.level", "r.boost")


QUERIES = {
    f.__name__: f
    for f in (cert_risk, cert_risk_by_issuer, cert_lookalike, ct_recent, tls_flags, tls_days_to_expiry, header_risk, dns_fastflux, dns_verdicts, dns_networks, redirect_graph, redirect_report_chains, relay_suspects)
}

_words = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in ws) + ")"
_in = lambda ws: ", ".join(f"'{w}'" for w in ws)
_BR = "br AS (SELECT brand_id AS b, row_number() OVER () AS o FROM protected_brands)"
_FLUX = """WITH o AS (SELECT l_orderkey AS k, s_nationkey AS asn, s_nationkey % 10 / 10 AS rep, l_quantity * 10 AS ttl FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
a AS (SELECT k, count(*) AS addresses, count(DISTINCT asn) AS networks, min(ttl) AS min_ttl, max(rep)::DOUBLE AS max_reputation, CASE WHEN count(DISTINCT asn) > 1 THEN entropy(asn) ELSE 0 END AS e FROM o GROUP BY k),
b AS (SELECT *, round(e, 4) AS entropy, round(CASE WHEN networks > 1 THEN e / log2(networks) ELSE 0 END, 4) AS diversity, CASE WHEN min_ttl <= 0 THEN 0 WHEN min_ttl <= 60 THEN 1 WHEN min_ttl <= 300 THEN round(1 - (min_ttl - 60) / 240, 4) ELSE 0 END::DOUBLE AS ttl_score FROM a),
c AS (SELECT *, least(1.0, 0.35 * ttl_score + 0.35 * diversity + 0.3 * max_reputation) AS i FROM b),
d AS (SELECT k AS order_key, addresses, networks, min_ttl, max_reputation, entropy, diversity, ttl_score, round(i + 1e-9, 4) AS flux_index, CASE WHEN i >= 0.6 THEN 'suspect' WHEN i >= 0.3 THEN 'moderate' ELSE 'stable' END AS verdict FROM c) """
_NET = " ".join("WHEN " + " OR ".join(f"starts_with(resolved_ip, '{p}')" for p in ps) + f" THEN ('{a}', {r}::DOUBLE)" for ps, a, r in n.NETWORKS)
SQL = {
    "cert_risk": f"""WITH {_BR}, d AS (SELECT delivery_id, lower(trim(domain)) AS d, lower(issuer) AS i FROM ct_events WHERE domain IS NOT NULL),
m AS (SELECT delivery_id, arg_min(b, o) AS brand FROM d JOIN br ON contains(d, b) OR contains(d, replace(replace(b, 'l', '1'), 'o', '0')) GROUP BY ALL),
s AS (SELECT delivery_id, brand, CASE WHEN brand IS NULL OR ends_with(d, brand || '.com') OR ends_with(d, brand || '.co.uk') THEN 0.02 ELSE round(least(1.0, 0.55 + CASE WHEN {_words('i', n.FREE_ISSUERS)} THEN 0.25 ELSE 0 END
 + least(0.3, 0.15 * ({' + '.join(f"contains(d, '{w}')::INT" for w in n.CERT_WORDS)})) + CASE WHEN contains(d, '.') AND string_split(d, '.')[-1] IN ({_in(n.CERT_TLDS)}) THEN 0.15 ELSE 0 END), 4) END::DOUBLE AS score FROM d LEFT JOIN m USING (delivery_id))
SELECT *, CASE WHEN score >= 0.7 THEN 'HIGH_RISK_PHISHING' WHEN score >= 0.4 THEN 'SUSPICIOUS_LOOKALIKE' ELSE 'BENIGN_OFFICIAL' END AS verdict FROM s""",
    "cert_risk_by_issuer": "SELECT issuer, risk_verdict, count(*) AS events, round(avg(risk_score), 4) AS mean_score, count(DISTINCT matched_brand) AS brands FROM ct_events GROUP BY ALL",
    "cert_lookalike": f"""WITH {_BR}, d AS (SELECT event_id, lower(trim(domain)) AS d, translate(lower(trim(domain)), '1053@8', 'loseab') AS f FROM certstream_events),
m AS (SELECT event_id, arg_min(b, o) AS brand FROM d JOIN br ON contains(d, b) OR contains(f, b) GROUP BY ALL),
t AS (SELECT d.*, brand, list_filter([CASE WHEN contains(d, '.') AND string_split(d, '.')[-1] IN ({_in(n.STREAM_TLDS)}) THEN 'abuse_tld' END, CASE WHEN contains(f, brand) AND NOT contains(d, brand) THEN 'homoglyph' END, CASE WHEN brand IS NOT NULL AND contains(d, '-') THEN 'hyphen' END,
 CASE WHEN brand IS NOT NULL AND {_words('d', n.STREAM_WORDS)} THEN 'lure_word' END, CASE WHEN brand IS NOT NULL AND length(regexp_replace(d, '[^.]', '', 'g')) > 2 THEN 'deep_subdomain' END], lambda x: x IS NOT NULL) AS tr FROM d LEFT JOIN m USING (event_id))
SELECT event_id, brand, CASE WHEN len(tr) > 0 THEN array_to_string(tr, ',') ELSE 'brand_pattern' END AS triggers, CASE WHEN len(tr) >= 2 THEN 'CRITICAL' WHEN brand IS NOT NULL THEN 'HIGH' ELSE 'SUSPICIOUS' END AS level FROM t
WHERE (brand IS NOT NULL OR len(tr) > 0) AND NOT coalesce(d = brand || '.com' OR ends_with(d, '.' || brand || '.com'), false)""",
    "ct_recent": "SELECT delivery_id, event_epoch, domain, risk_verdict FROM ct_events ORDER BY event_epoch DESC, delivery_id LIMIT 20",
    "tls_flags": "SELECT probe_id, coalesce(issuer = subject, false) AS self_signed, coalesce(contains(lower(issuer), 'free') OR contains(lower(issuer), 'acme'), false) AS free_issuer, least(10, coalesce(len(san_list), 0))::INT AS names, coalesce(len(list_distinct(san_list)) + (list_position(san_list, NULL) IS NOT NULL)::INT, 0)::INT AS distinct_names FROM tls_info",
    "header_risk": """WITH k AS (SELECT c_custkey AS k, ['Apache/2.2.15', 'nginx/1.24.0', 'Microsoft-IIS/6.0', 'nginx/1.1.0', ''][c_custkey % 5 + 1] AS b FROM customer),
f AS (SELECT *, bit_count(k & 63)::INT AS s, (k >> 6) & 1 = 1 AS h, (k >> 7) & 1 = 1 AS c, CASE WHEN k % 6 = 0 THEN 2 WHEN k % 3 = 0 THEN 1 ELSE 0 END::INT AS r, k % 5 IN (0, 2, 3) AS old FROM k)
SELECT k AS c_custkey, CASE WHEN b = '' THEN 'Unadvertised' ELSE b END AS banner, s AS security_headers, round(s / 6, 4) AS coverage, old AS outdated, (h OR c) AND NOT (h AND c) AS insecure_cookie, k % 4 = 0 AS no_cache, r AS redirects,
 round(least(1.0, CASE WHEN s = 0 THEN 0.35 WHEN s <= 2 THEN 0.15 ELSE 0 END + 0.25 * old::INT + 0.2 * ((h OR c) AND NOT (h AND c))::INT + 0.1 * (k % 4 = 0)::INT + 0.15 * (r >= 2)::INT)::DOUBLE, 4) AS risk,
 """ + ", ".join(f"(k >> {i}) & 1 = 1 AS has_{x.replace('-', '_')}" for i, x in enumerate(n.SECURITY_HEADERS)) + ", h OR c AS has_cookie, h AS cookie_httponly, c AS cookie_secure, c AS cookie_samesite, k % 7 = 0 AS has_text_html FROM f",
    "dns_fastflux": _FLUX + "SELECT * FROM d",
    "dns_verdicts": _FLUX + "SELECT verdict, count(*) AS names, round(avg(flux_index), 4) AS mean_index FROM d GROUP BY verdict",
    "dns_networks": f"WITH a AS (SELECT CASE WHEN resolved_ip IS NULL OR resolved_ip IN ('', '127.0.0.1', 'localhost') THEN ('AS13335', 0.05::DOUBLE) {_NET} END AS a FROM tls_info) SELECT a[1] AS asn, a[2] AS reputation, count(*) AS probes FROM a GROUP BY ALL",
    "redirect_graph": f"""WITH h AS (SELECT feature_id // 4 AS chain, feature_id % 4 AS hop, url, lower(regexp_extract(trim(url), '^(?:https?://)?([^/?#:]*)', 1)) AS host, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, '&' || regexp_extract(trim(url), '^[^?#]*\\?([^#]*)', 1) AS q FROM lexical_features WHERE url IS NOT NULL),
w AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY hop) AS rn, lead(s) OVER (PARTITION BY chain ORDER BY hop) AS nx FROM h),
a AS (SELECT chain, count(*) AS hops, count(DISTINCT host) AS hosts, bool_or({_words('host', n.CHAIN_SHORTENERS)}) AS has_shortener, bool_or(rn > 1 AND regexp_matches(q, '&({'|'.join(n.CHAIN_PARAMS)})=[^&]')) AS has_open_redirect, coalesce(bool_or(s = 'https' AND nx = 'http'), false) AS has_downgrade FROM w GROUP BY chain)
SELECT *, round(least(1.0, 0.35 * (hops >= 3)::INT + 0.25 * has_shortener::INT + 0.3 * has_open_redirect::INT + 0.2 * has_downgrade::INT + 0.2 * (hosts >= 3)::INT)::DOUBLE, 4) AS risk FROM a""",
    "relay_suspects": """WITH t AS (SELECT scan_id, arg_max(has_tls, (probed_at, probe_id)) AS ht, arg_max(is_free_ca, (probed_at, probe_id)) AS fc, arg_max(is_self_signed, (probed_at, probe_id)) AS ss FROM tls_info GROUP BY scan_id),
p AS (SELECT capture_id, coalesce(s_phish >= 0.6 AND matched_brand <> '', false) AS alike, coalesce(ht AND fc, false) AS f0, coalesce(ht AND NOT fc AND ss, false) AS o0, coalesce(regexp_matches(lower(url), '(login|signin|auth|sso|portal|account)\\.'), false) AS s0,
 coalesce(contains(lower(dom_html), 'type="password"') AND regexp_matches(lower(dom_html), 'evilginx|proxy|xhr'), false) AS d0 FROM page_captures LEFT JOIN t USING (scan_id)),
q AS (SELECT capture_id, alike AND f0 AS f, alike AND o0 AS o, alike AND s0 AS s, alike AND d0 AS d FROM p)
SELECT capture_id, f OR o OR s OR d AS suspect, CASE WHEN d OR o THEN 'CRITICAL' WHEN f THEN 'HIGH' WHEN s THEN 'MEDIUM' ELSE 'NONE' END AS level, round(least(0.4, CASE WHEN f THEN 0.35 WHEN o THEN 0.4 WHEN s THEN 0.2 ELSE 0 END + 0.3 * d::INT)::DOUBLE, 4) AS boost FROM q""",
}
SQL["tls_days_to_expiry"] = INSTANTS_OF_ALL + "SELECT r.row_id AS probe_id, floor((r.utc_micros - epoch_us(t.probed_at)) / 86400000000.0)::BIGINT AS days_left FROM r JOIN tls_info t ON t.probe_id = r.row_id WHERE field_name = 'tls_info.valid_to' AND r.utc_micros IS NOT NULL"


def _of_reports(sql: str) -> str:
    """The SQL of redirect_graph over the hops that reports nest, a chain being a result of a report."""
    for a, b in (
        ("feature_id // 4 AS chain, feature_id % 4 AS hop,", "report_id, result_pos, child_pos AS hop,"), ("FROM lexical_features WHERE", f"FROM ({TRAINING_SQL['p6_hops']}) WHERE"),
        ("PARTITION BY chain", "PARTITION BY report_id, result_pos"), ("SELECT chain,", "SELECT report_id, result_pos,"), ("GROUP BY chain", "GROUP BY report_id, result_pos"),
    ):
        sql = sql.replace(a, b)
    return sql


SQL["redirect_report_chains"] = _of_reports(SQL["redirect_graph"])
