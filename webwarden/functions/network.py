"""Certificates, TLS records, response headers, DNS and redirect chains as column expressions and aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webwarden.functions.urls import entropy_of, homoglyph_fold, host, query

# Words, issuers and endings that the certificate rules weigh.
FREE_ISSUERS = ["let's encrypt", "zerossl", "cpanel", "certum", "buypass"]
CERT_WORDS = ["security", "login", "signin", "verify", "auth", "account", "update", "kyc", "wallet", "support"]
CERT_TLDS = ["xyz", "tk", "top", "buzz", "online", "site", "info", "net"]
STREAM_TLDS = ["tk", "ml", "ga", "cf", "gq", "xyz", "top", "buzz", "work", "live", "icu", "site", "online", "ru", "cn"]
STREAM_WORDS = ["login", "signin", "verify", "secure", "auth", "update", "account"]
# Security headers, server banners past their support, shorteners and redirect parameters.
SECURITY_HEADERS = ["strict-transport-security", "content-security-policy", "x-frame-options", "x-content-type-options", "referrer-policy", "permissions-policy"]
OLD_SERVERS = [r"apache/1\.", r"apache/2\.0", r"apache/2\.2", r"microsoft-iis/[56]\.", r"php/[45]\.[0-4]", r"nginx/0\.", r"nginx/1\.[0-2]\."]
CHAIN_SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "rebrand.ly", "cutt.ly", "shorturl.at", "trib.al", "linktr.ee"]
CHAIN_PARAMS = ["redirect", "url", "next", "target", "dest", "r", "u", "return", "link", "goto", "out"]
# Address prefixes with network and reputation, the first that fits; the last row is for all others.
NETWORKS = [(("185.", "194.", "91."), "AS204957", 0.95), (("45.", "193."), "AS44477", 0.95), (("104.", "172."), "AS13335", 0.05), (("13.", "52.", "54."), "AS16509", 0.10), (("20.", "40."), "AS8075", 0.10), (("",), "AS200019", 0.75)]


def _any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


def _first(text: Column, signatures: Mapping[str, Sequence[str]]) -> Column:
    """The first key of which any word is in the text; null if none is."""
    return F.coalesce(*[F.when(_any(text, words), F.lit(k)) for k, words in signatures.items()])


def certificate_risk(domain: Column, issuer: Column, signatures: Mapping[str, Sequence[str]], official: Column | None = None) -> Column:
    """Struct (brand, score, verdict) of a certificate. A host that ends in brand.com or brand.co.uk is official, as
    evilbrand.com is; pass `official`, a boolean of (brand) on real canonical hosts, for the strict form."""
    d = F.lower(F.trim(domain))

    def rated(brand: Column) -> Column:
        own = (F.endswith(d, F.concat(brand, F.lit(".com"))) | F.endswith(d, F.concat(brand, F.lit(".co.uk")))) if official is None else official
        words = reduce(lambda a, w: a + F.contains(d, F.lit(w)).cast("int"), CERT_WORDS, F.lit(0))
        free = F.when(_any(F.lower(issuer), FREE_ISSUERS), 0.25).otherwise(0.0)
        tld = F.when(F.element_at(F.split(d, r"\."), -1).isin(CERT_TLDS) & F.contains(d, F.lit(".")), 0.15).otherwise(0.0)
        raw = 0.55 + free + F.least(F.lit(0.30), words * 0.15) + tld
        score = F.when(brand.isNull() | F.coalesce(own, F.lit(False)), 0.02).otherwise(F.round(F.least(F.lit(1.0), raw), 4))
        return F.struct(brand.alias("brand"), score.alias("score"))

    def judged(x: Column) -> Column:
        return F.struct(x["brand"].alias("brand"), x["score"].alias("score"), F.when(x["score"] >= 0.70, "HIGH_RISK_PHISHING").when(x["score"] >= 0.40, "SUSPICIOUS_LOOKALIKE").otherwise("BENIGN_OFFICIAL").alias("verdict"))

    bound = F.transform(F.array(_first(d, signatures)), rated)
    return F.transform(bound, judged)[0]


def lookalike(domain: Column, brands: Sequence[str]) -> Column:
    """Struct (keep, brand, triggers, level) of a host from a certificate stream. keep is false for a brand's own
    hosts and for hosts without brand or trigger."""
    d = F.lower(F.trim(domain))
    folded = homoglyph_fold(d)
    brand = F.coalesce(*[F.when(F.contains(d, F.lit(b)) | F.contains(folded, F.lit(b)), F.lit(b)) for b in brands]) if brands else F.lit(None).cast("string")

    def rated(b: Column) -> Column:
        com = F.concat(b, F.lit(".com"))
        own = F.coalesce((d == com) | F.endswith(d, F.concat(F.lit("."), com)), F.lit(False))
        tld = F.element_at(F.split(d, r"\."), -1).isin(STREAM_TLDS) & F.contains(d, F.lit("."))
        known = b.isNotNull()
        triggers = F.array_compact(
            F.array(
                F.when(tld, "abuse_tld"), F.when(known & F.contains(folded, b) & ~F.contains(d, b), "homoglyph"), F.when(known & F.contains(d, F.lit("-")), "hyphen"),
                F.when(known & _any(d, STREAM_WORDS), "lure_word"), F.when(known & (F.length(F.regexp_replace(d, "[^.]", "")) > 2), "deep_subdomain"),
            )
        )
        return F.struct(b.alias("brand"), own.alias("own"), triggers.alias("triggers"))

    def judged(x: Column) -> Column:
        n = F.size(x["triggers"])
        level = F.when(n >= 2, "CRITICAL").when(x["brand"].isNotNull(), "HIGH").otherwise("SUSPICIOUS")
        return F.struct((~x["own"] & (x["brand"].isNotNull() | (n > 0))).alias("keep"), x["brand"].alias("brand"), F.when(n > 0, x["triggers"]).otherwise(F.array(F.lit("brand_pattern"))).alias("triggers"), level.alias("level"))

    return F.transform(F.transform(F.array(brand), rated), judged)[0]


def parse_header_block(text: Column) -> Column:
    """Array of maps, one per response of a raw header block: a blank line or a status line starts the next; keys in
    lower case; repeated headers joined by " ; "; the status line under ":status_line"."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), F.trim)
    empty = F.array().cast("array<struct<hop:int,k:string,v:string>>")
    zero = F.struct(F.lit(0).alias("hop"), F.lit(False).alias("used"), empty.alias("rows"))

    def step(acc: Column, line: Column) -> Column:
        status = line.rlike("^HTTP/[123]")
        moves = ((line == "") | status) & acc["used"]
        hop = acc["hop"] + F.when(moves, 1).otherwise(0)
        pair = (F.contains(line, F.lit(":")) & ~status) | status
        k = F.when(status, ":status_line").otherwise(F.lower(F.trim(F.regexp_extract(line, "^([^:]*):", 1))))
        v = F.when(status, line).otherwise(F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1)))
        rows = F.when(pair, F.concat(acc["rows"], F.array(F.struct(hop.alias("hop"), k.alias("k"), v.alias("v"))))).otherwise(acc["rows"])
        used = F.when(pair, True).when(moves, False).otherwise(acc["used"])
        return F.struct(hop.alias("hop"), used.alias("used"), rows.alias("rows"))

    def hops(rows: Column) -> Column:
        def one(h: Column) -> Column:
            own = F.filter(rows, lambda r: r["hop"] == h)
            keys = F.array_distinct(F.transform(own, lambda r: r["k"]))
            return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_join(F.transform(F.filter(own, lambda r: r["k"] == k), lambda r: r["v"]), " ; ")))

        return F.transform(F.array_sort(F.array_distinct(F.transform(rows, lambda r: r["hop"]))), one)

    return F.aggregate(lines, zero, step, lambda acc: hops(acc["rows"]))


def header_risk(hops: Column) -> Column:
    """Struct of the header features and risk of the last response in an array of header maps: banner, security headers
    one by one and in all, outdated server, cookie flags, caching, redirects, type of content."""

    def of(h: Column, n: Column) -> Column:
        get = lambda k: F.coalesce(F.try_element_at(h, F.lit(k)), F.lit(""))
        secure = reduce(lambda a, k: a + F.map_contains_key(h, k).cast("int"), SECURITY_HEADERS, F.lit(0))
        old = reduce(lambda a, p: a | F.lower(get("server")).rlike(p), OLD_SERVERS, F.lit(False))
        cookie, c, p = F.lower(get("set-cookie")), F.lower(get("cache-control")), F.lower(get("pragma"))
        has = cookie != ""
        flags = [F.contains(cookie, F.lit(k)) for k in ("httponly", "secure", "samesite")]
        no_cache = F.contains(c, F.lit("no-store")) | (F.contains(c, F.lit("no-cache")) & F.contains(c, F.lit("must-revalidate"))) | F.contains(p, F.lit("no-cache"))
        redirects = F.greatest(F.lit(0), n - 1)
        risk = (
            F.when(secure == 0, 0.35).when(secure <= 2, 0.15).otherwise(0.0) + F.when(old, 0.25).otherwise(0.0) + F.when(has & ~(flags[0] & flags[1] & flags[2]), 0.20).otherwise(0.0)
            + F.when(no_cache, 0.10).otherwise(0.0) + F.when(redirects >= 2, 0.15).otherwise(0.0)
        )
        return F.struct(
            F.when(get("server") == "", "Unadvertised").otherwise(get("server")).alias("banner"), secure.alias("security_headers"), F.round(secure / 6, 4).alias("coverage"), old.alias("outdated"),
            (has & ~(flags[0] & flags[1])).alias("insecure_cookie"), no_cache.alias("no_cache"), redirects.alias("redirects"), F.round(F.least(F.lit(1.0), risk), 4).alias("risk"),
            *[F.map_contains_key(h, k).alias("has_" + k.replace("-", "_")) for k in SECURITY_HEADERS], has.alias("has_cookie"), *[f.alias(f"cookie_{k}") for f, k in zip(flags, ("httponly", "secure", "samesite"))],
            F.contains(F.lower(get("content-type")), F.lit("text/html")).alias("has_text_html"),
        )

    last = F.coalesce(F.try_element_at(hops, F.lit(-1)), F.create_map().cast("map<string,string>"))
    return F.transform(F.array(F.struct(last.alias("h"), F.size(hops).alias("n"))), lambda x: of(x["h"], x["n"]))[0]


def ttl_anomaly(ttl: Column) -> Column:
    return F.when(ttl <= 0, 0.0).when(ttl <= 60, 1.0).when(ttl <= 300, F.round(1 - (ttl - 60) / 240, 4)).otherwise(0.0)


def network_of(ip: Column) -> Column:
    """Struct (asn, reputation) of an address by its prefix."""
    out = F.when(ip.isNull() | ip.isin("", "127.0.0.1", "localhost"), F.struct(F.lit("AS13335").alias("asn"), F.lit(0.05).alias("reputation")))
    for prefixes, asn, rep in NETWORKS:
        out = out.when(reduce(lambda a, p: a | F.startswith(ip, F.lit(p)), prefixes, F.lit(False)), F.struct(F.lit(asn).alias("asn"), F.lit(rep).alias("reputation")))
    return out


def fast_flux(observations: DataFrame, key: str, asn: str, reputation: str, ttl: str) -> DataFrame:
    """One row per key: entropy and diversity of its networks, least TTL, index and verdict, from rows of (key, asn,
    reputation, ttl). Counts per (key, network) come first, so a key with many addresses is combined map-side."""
    per = observations.groupBy(key, asn).agg(F.count(F.lit(1)).alias("n"), F.max(reputation).alias("rep"), F.min(ttl).alias("ttl"))
    total = per.groupBy(key).agg(
        F.sum("n").alias("addresses"), F.count(F.lit(1)).alias("networks"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("nlogn"), F.max("rep").alias("max_reputation"), F.min("ttl").alias("min_ttl")
    )
    entropy = F.when(F.col("networks") > 1, F.log2(F.col("addresses").cast("double")) - F.col("nlogn") / F.col("addresses")).otherwise(0.0)
    diversity = F.when(F.col("networks") > 1, entropy / F.log2(F.col("networks").cast("double"))).otherwise(0.0)
    out = total.select(key, "addresses", "networks", "min_ttl", "max_reputation", F.round(entropy, 4).alias("entropy"), F.round(diversity, 4).alias("diversity"), ttl_anomaly(F.col("min_ttl")).alias("ttl_score"))
    index = F.least(F.lit(1.0), 0.35 * F.col("ttl_score") + 0.35 * F.col("diversity") + 0.30 * F.col("max_reputation"))
    return out.withColumn("flux_index", F.round(index + 1e-9, 4)).withColumn("verdict", F.when(index >= 0.60, "suspect").when(index >= 0.30, "moderate").otherwise("stable"))


def network_entropy(asns: Column) -> Column:
    """Entropy of an array of networks, rounded; 0 for one network or none."""
    return F.when(F.size(F.array_distinct(asns)) > 1, F.round(entropy_of(asns), 4)).otherwise(0.0)


def redirect_chains(hops: DataFrame, key: list[str], order: str, url: str) -> DataFrame:
    """One row per chain: hops, hosts, flags and risk. An open redirect counts after the first hop only."""
    u, h = F.col(url), F.lower(host(F.col(url)))
    w = Window.partitionBy(*key).orderBy(order)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z]+)://", 1))
    q = F.concat(F.lit("&"), query(u))
    opens = reduce(lambda a, p: a | q.rlike(f"&{p}=[^&]"), CHAIN_PARAMS, F.lit(False))
    rows = hops.select(*key, h.alias("host"), _any(h, CHAIN_SHORTENERS).alias("short"), (opens & (F.row_number().over(w) > 1)).alias("opens"), ((scheme == "https") & (F.lead(scheme).over(w) == "http")).alias("down"))
    agg = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("hops"), F.countDistinct("host").alias("hosts"), F.bool_or("short").alias("has_shortener"), F.bool_or("opens").alias("has_open_redirect"), F.coalesce(F.bool_or("down"), F.lit(False)).alias("has_downgrade"))
    add = lambda c, v: F.when(c, v).otherwise(0.0)
    risk = add(F.col("hops") >= 3, 0.35) + add(F.col("has_shortener"), 0.25) + add(F.col("has_open_redirect"), 0.30) + add(F.col("has_downgrade"), 0.20) + add(F.col("hosts") >= 3, 0.20)
    return agg.withColumn("risk", F.round(F.least(F.lit(1.0), risk), 4))


def relay_suspicion(url: Column, similarity: Column, brand: Column, canonical: Column, has_tls: Column, free_ca: Column, self_signed: Column, dom: Column) -> Column:
    """Struct (suspect, level, boost) of an adversary in the middle: resemblance to a brand behind a certificate, host
    or page that a relay would have."""
    low = F.lower(F.coalesce(dom, F.lit("")))
    alike = F.coalesce(~canonical & (similarity >= 0.60) & (brand != ""), F.lit(False))
    free = alike & F.coalesce(has_tls & free_ca, F.lit(False))
    own = alike & F.coalesce(has_tls & ~free_ca & self_signed, F.lit(False))
    stacked = alike & F.coalesce(_any(F.lower(url), ["login.", "signin.", "auth.", "sso.", "portal.", "account."]), F.lit(False))
    page = alike & F.contains(low, F.lit('type="password"')) & _any(low, ["evilginx", "proxy", "xhr"])
    boost = F.when(free, 0.35).when(own, 0.40).when(stacked, 0.20).otherwise(0.0) + F.when(page, 0.30).otherwise(0.0)
    level = F.when(page | own, "CRITICAL").when(free, "HIGH").when(stacked, "MEDIUM").otherwise("NONE")
    return F.struct((free | own | stacked | page).alias("suspect"), level.alias("level"), F.round(F.least(F.lit(0.40), boost), 4).alias("boost"))
