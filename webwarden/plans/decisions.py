"""Queries over vectors, fused scores, exports and labelled data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webwarden.functions import decide as d
from webwarden.functions import exports as x
from webwarden.functions import vectors as v
from webwarden.functions.urls import host
from webwarden.operators import registry
from webwarden.plans.network import latest
from webwarden.plans.training import table

CONTACTS = {"example": "abuse@example.invalid", "co.example": "abuse@co.example.invalid", "test": "abuse@test.invalid"}
PATHS = ["/login", "/signin", "/account/verify", "/secure"]


def vec_normalise(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(v.normalised(F.col("embedding"))).alias("i", "x"))
    return e.select("vec_id", "i", (F.round("x", 4) + F.lit(0.0)).alias("x"))


def vec_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return v.nearest(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)


def vec_centroid_match(spark, sf_dir):
    """Each vector against its own label's centroid."""
    e = table(spark, sf_dir, "embeddings")
    c = v.centroids(e, "label", "embedding")
    return e.join(F.broadcast(c), "label").select("vec_id", v.cosine(F.col("embedding"), F.col("centroid")).alias("similarity"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per scan: the last lexical features, with what the last capture shows. The page score stands for the
    structure's similarity, and is null where the scan has no page; the visual one follows from the capture's id."""
    lex = latest(table(spark, sf_dir, "lexical_features").drop("registered_domain"), "scan_id", "computed_at", "feature_id")
    page = latest(table(spark, sf_dir, "page_captures").select("scan_id", "capture_id", "stored_at", F.col("matched_brand").alias("page_brand"), "s_phish"), "scan_id", "stored_at", "capture_id")
    vis = F.when(F.col("capture_id") % 5 != 0, F.col("capture_id") * 37 % 100 / 100)
    return lex.join(page, "scan_id", "left").select("*", F.col("s_phish").alias("s_dom"), vis.alias("s_vis"), F.lower(host(F.col("url"))).alias("host"))


def _lex() -> dict:
    c = lambda n, zero: F.coalesce(F.col(n), F.lit(zero))
    low = F.col("url")
    return {
        "s_lex": c("s_lex", 0.0), "entropy": c("shannon_entropy", 0.0), "url_length": c("url_length", 0), "domain_length": F.length(F.coalesce("host", F.lit(""))), "subdomain_depth": c("subdomain_count", 0), "digit_ratio": c("digit_ratio", 0.0),
        "symbol_count": F.coalesce(F.length(low) - F.length(F.translate(low, "@-_~%?=&", "")), F.lit(0)), "is_ip": c("is_ip", False), "is_punycode": c("is_punycode", False), "is_suspicious_tld": c("is_suspicious_tld", False),
        "brand_distance": c("min_levenshtein_dist", 0), "brand_similarity": c("levenshtein_sim", 0.0), "is_canonical": c("is_canonical_domain", False),
    }


def fusion_vector(spark, sf_dir):
    f = d.fusion_vector(_lex(), F.col("s_dom"), F.col("s_vis"))
    return signals(spark, sf_dir).select("scan_id", *[F.round(c + 1e-9, 4).alias(k) for k, c in f.items()])


def scores(spark, sf_dir) -> DataFrame:
    lex = _lex()
    dns = d.dns_group(lex["s_lex"], lex["is_canonical"], lex["is_suspicious_tld"])[0]
    return signals(spark, sf_dir).withColumn("score", d.closed_form(lex["s_lex"], F.col("s_dom"), F.col("s_vis"), dns, lex["is_canonical"]))


def fusion_score(spark, sf_dir):
    return scores(spark, sf_dir).select("scan_id", "score", F.when(F.col("s_dom").isNull() | F.col("s_vis").isNull(), "reduced").otherwise("full").alias("confidence"))


def fusion_verdicts(spark, sf_dir):
    s = F.col("score")
    return scores(spark, sf_dir).agg(F.count_if(s >= 0.65).alias("phishing"), F.count_if((s >= 0.35) & (s < 0.65)).alias("suspicious"), F.count_if(s < 0.35).alias("safe"))


def brand_consistency(spark, sf_dir):
    b = table(spark, sf_dir, "protected_brands").select(F.col("brand_id").alias("page_brand"), F.col("canonical_domains").alias("official"))
    j = signals(spark, sf_dir).filter("capture_id is not null").join(F.broadcast(b), "page_brand", "left")
    dom, vis, _ = d.sims(F.col("s_dom"), F.col("s_vis"))
    return j.select("scan_id", d.consistency(F.col("host"), F.coalesce("page_brand", F.lit("")), vis, dom, F.col("official")).alias("c")).select("scan_id", "c.*")


def attribution_groups(spark, sf_dir):
    """Shares of the feature groups, the vector's values standing for impacts."""
    f = d.fusion_vector(_lex(), F.col("s_dom"), F.col("s_vis"))
    return signals(spark, sf_dir).select("scan_id", d.group_attribution(F.array(*[f[k] for k in d.VECTOR])).alias("g")).select("scan_id", "g.*")


def confusion(spark, sf_dir):
    """The score against the recorded verdict: a page with a brand on a host that is not the brand's."""
    s = scores(spark, sf_dir).filter("capture_id is not null")
    label, hit = F.coalesce("page_brand", F.lit("")) != "", F.col("score") >= 0.35
    c = s.agg(F.count_if(label & hit).alias("tp"), F.count_if(~label & hit).alias("fp"), F.count_if(label & ~hit).alias("fn"), F.count_if(~label & ~hit).alias("tn"))
    part = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    return c.select("tp", "fp", "fn", "tn", part(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), part(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), part(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"))


def export_indicators(spark, sf_dir):
    s = scores(spark, sf_dir).select("scan_id", x.indicator(F.col("url"), F.col("score"), F.col("page_brand")).alias("indicator"), F.floor(F.col("score") * 100 + 1e-9).cast("int").alias("confidence"), (F.col("score") >= 0.65).alias("malicious"), "score")
    return s.filter("score >= 0.35").select("scan_id", "confidence", "malicious", F.get_json_object("indicator", "$.labels[0]").alias("label"))


def export_blocklist(spark, sf_dir):
    return x.blocklist(scores(spark, sf_dir).withColumn("host", F.coalesce("host", F.lit(""))), "host", "score", "feature_id")


def export_rules(spark, sf_dir):
    s = scores(spark, sf_dir).filter("score >= 0.35 and host <> ''")
    return s.select("scan_id", F.md5(x.siem_rule(F.col("host"), F.col("score"))).alias("siem_md5"), x.content_rule(F.col("host")).alias("content_rule"))


def export_firewall(spark, sf_dir):
    t = latest(table(spark, sf_dir, "tls_info").select("scan_id", "probe_id", "probed_at", "resolved_ip"), "scan_id", "probed_at", "probe_id").select("scan_id", "resolved_ip")
    s = scores(spark, sf_dir).join(t, "scan_id", "left")
    rules = x.firewall_rules(F.col("host"), F.col("resolved_ip"))
    return s.filter("score >= 0.35").select("scan_id", *[rules[k].alias(k) for k in ("dns_zone", "packet_filter", "proxy", "hosts_file")])


def evidence_digest(spark, sf_dir):
    p = table(spark, sf_dir, "page_captures")
    return p.select("capture_id", x.evidence_root((F.col("dom_html"), ""), (F.lit(None).cast("string"), ""), (F.col("url"), "{}"), (F.lit(None).cast("string"), "{}")).alias("root"))


def takedown_notices(spark, sf_dir):
    s = scores(spark, sf_dir).filter("score >= 0.65")
    return s.select("scan_id", x.takedown(F.col("url"), F.col("host"), F.lit(None).cast("string"), F.col("page_brand"), CONTACTS).alias("n")).select("scan_id", "n.report_id", "n.contact")


def incident_narratives(spark, sf_dir):
    return scores(spark, sf_dir).filter("host is not null").select("scan_id", x.narrative(F.col("host"), F.col("page_brand"), F.col("score"), F.lit(False), F.lit(None).cast("string")).alias("text"))


def evidence_packages(spark, sf_dir):
    """Archives of all captures, as their sizes."""
    p = table(spark, sf_dir, "page_captures").select("capture_id", "url", "dom_html", "confidence")
    return x.packages(p, "capture_id", ["url", "dom_html", "confidence"]).select(F.col("id").alias("capture_id"), F.length("archive").alias("bytes"))


def brand_upsert(spark, sf_dir):
    b = table(spark, sf_dir, "protected_brands").select("brand_id", "display_name")
    changed = b.filter("brand_id < 'm'").select(F.concat(F.lit(" "), F.upper("brand_id")).alias("brand_id"), F.lit("changed").alias("display_name"))
    return registry.upsert(b, changed.unionByName(spark.createDataFrame([("newbrand", "New Brand")], "brand_id string, display_name string")), "brand_id")


def brand_delete(spark, sf_dir):
    b = table(spark, sf_dir, "protected_brands").select("brand_id", "display_name")
    return registry.remove(b, b.filter("brand_id >= 'm'").select(F.upper("brand_id").alias("brand_id")), "brand_id")


def labelled_urls(spark, sf_dir) -> DataFrame:
    """(url, label): scans of hosts that imitate a brand, and the brands' own pages and plain scans."""
    s = table(spark, sf_dir, "lexical_features").select("url", F.when(F.coalesce("matched_brand", F.lit("")) != "", 1).otherwise(0).alias("label"))
    own = table(spark, sf_dir, "protected_brands").select(F.col("official_login_url").alias("url"), F.lit(0).alias("label"))
    return s.unionByName(own).filter("url is not null").distinct()


def dataset_balance(spark, sf_dir):
    return registry.balanced(labelled_urls(spark, sf_dir), "label", "url")


def dataset_split(spark, sf_dir):
    return registry.stratified_split(labelled_urls(spark, sf_dir), "url", 0.8).groupBy("label", "is_train").agg(F.count(F.lit(1)).alias("urls"))


def seed_expansion(spark, sf_dir):
    return registry.expanded(table(spark, sf_dir, "protected_brands").filter("official_login_url is not null"), "official_login_url", PATHS)


QUERIES = {
    f.__name__: f
    for f in (
        vec_normalise, vec_topk, vec_centroid_match, fusion_vector, fusion_score, fusion_verdicts, brand_consistency, attribution_groups, confusion, export_indicators, export_blocklist, export_rules, export_firewall,
        evidence_digest, takedown_notices, incident_narratives, evidence_packages, brand_upsert, brand_delete, dataset_balance, dataset_split, seed_expansion,
    )
}

_S = """WITH l AS (SELECT scan_id, unnest(arg_max(f, (computed_at, feature_id))) FROM (SELECT scan_id, computed_at, feature_id, {'feature_id': feature_id, 'url': url, 's_lex': s_lex, 'shannon_entropy': shannon_entropy, 'url_length': url_length, 'subdomain_count': subdomain_count, 'digit_ratio': digit_ratio, 'is_ip': is_ip, 'is_punycode': is_punycode, 'is_suspicious_tld': is_suspicious_tld, 'min_levenshtein_dist': min_levenshtein_dist, 'levenshtein_sim': levenshtein_sim, 'is_canonical_domain': is_canonical_domain} AS f FROM lexical_features) GROUP BY scan_id),
p AS (SELECT scan_id, arg_max({'c': capture_id, 'b': matched_brand, 's': s_phish}, (stored_at, capture_id)) AS r FROM page_captures GROUP BY scan_id),
j AS (SELECT l.*, lower(regexp_extract(trim(url), '^(?:https?://)?([^/?#:]*)', 1)) AS host, r.c AS capture_id, r.b AS page_brand, r.s AS s_dom, CASE WHEN r.c % 5 <> 0 THEN r.c * 37 % 100 / 100 END AS s_vis FROM l LEFT JOIN p USING (scan_id)),
s AS (SELECT *, coalesce(s_lex, 0) AS lx, coalesce(is_canonical_domain, false) AS can, coalesce(is_suspicious_tld, false) AS sus, s_dom IS NULL OR s_vis IS NULL AS gone, CASE WHEN s_dom IS NULL OR s_vis IS NULL THEN 0 ELSE s_dom END::DOUBLE AS dm, CASE WHEN s_dom IS NULL OR s_vis IS NULL THEN 0 ELSE s_vis END::DOUBLE AS vs FROM j),
t AS (SELECT *, sus OR lx >= 0.6 AS hot FROM s),
v AS (SELECT *, CASE WHEN can THEN 0.02 WHEN hot THEN least(1, 0.7 * lx) ELSE 0.05 END::DOUBLE AS dns, CASE WHEN can OR NOT hot THEN 0 WHEN lx >= 0.7 THEN 1 ELSE 0.5 END::DOUBLE AS ttl, CASE WHEN can OR NOT hot THEN 0 ELSE least(1, 0.6 * lx) END::DOUBLE AS asn, CASE WHEN can THEN 0.02 WHEN hot THEN least(1, 0.65 * lx) ELSE 0.05 END::DOUBLE AS rep FROM t),
c AS (SELECT *, CASE WHEN can THEN 0.02 WHEN dm = 0 AND vs = 0 AND lx <= 0.05 THEN round(lx, 4) ELSE round(0.4 * lx + 0.3 * vs + 0.18 * dm + 0.12 * dns + 1e-9, 4) END::DOUBLE AS score FROM v) """
_V = dict(zip(d.VECTOR, ["lx", "coalesce(shannon_entropy, 0)", "coalesce(url_length, 0)", "length(coalesce(host, ''))", "coalesce(subdomain_count, 0)", "coalesce(digit_ratio, 0)", "coalesce(length(regexp_replace(url, '[^@\\-_~%?=&]', '', 'g')), 0)", "coalesce(is_ip, false)::INT", "coalesce(is_punycode, false)::INT", "sus::INT", "coalesce(min_levenshtein_dist, 0)", "coalesce(levenshtein_sim, 0)", "can::INT", "dm", "vs", "gone::INT", "greatest(dm, vs)", "abs(dm - vs)", "CASE WHEN can THEN 0 ELSE least(1, 0.35 * lx + 0.4 * vs + 0.25 * dm) END", "dns", "ttl", "asn", "rep"]))
_E = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e) "
_lab = "SELECT DISTINCT url, label FROM (SELECT url, CASE WHEN matched_brand <> '' THEN 1 ELSE 0 END AS label FROM lexical_features UNION ALL SELECT official_login_url, 0 FROM protected_brands) WHERE url IS NOT NULL"
_con = " ".join(f"WHEN ends_with(host, '.{s}') THEN '{c}'" for s, c in sorted(CONTACTS.items(), key=lambda z: (-len(z[0]), z[0])))
SQL = {
    "vec_normalise": _E + "SELECT vec_id, i::INT AS i, round(v[i + 1] / n, 4) + 0 AS x FROM n, range(64) r(i)",
    "vec_topk": _E + ", p AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_dot_product(list_transform(q.v, lambda a: a / q.n), list_transform(r.v, lambda a: a / r.n)), 4) AS similarity FROM n q JOIN n r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p) SELECT query_id, rank::INT AS rank, id, similarity FROM k WHERE rank <= 5",
    "vec_centroid_match": _E + ", m AS (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) r(i) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label) SELECT vec_id, round(greatest(0, least(1, list_dot_product(v, c) / sqrt(list_dot_product(v, v) * list_dot_product(c, c)))), 4) AS similarity FROM e JOIN c USING (label)",
    "fusion_vector": _S + "SELECT scan_id, " + ", ".join(f"round(({e})::DOUBLE + 1e-9, 4) AS {k}" for k, e in _V.items()) + " FROM v",
    "fusion_score": _S + "SELECT scan_id, score, CASE WHEN gone THEN 'reduced' ELSE 'full' END AS confidence FROM c",
    "fusion_verdicts": _S + "SELECT count(*) FILTER (score >= 0.65) AS phishing, count(*) FILTER (score >= 0.35 AND score < 0.65) AS suspicious, count(*) FILTER (score < 0.35) AS safe FROM c",
    "brand_consistency": _S + """, q AS (SELECT v.*, coalesce(page_brand <> '' AND vs >= 0.25, false) AS shown, coalesce(canonical_domains, [page_brand || '.com']) AS o FROM v LEFT JOIN protected_brands ON brand_id = page_brand WHERE capture_id IS NOT NULL),
w AS (SELECT *, coalesce(len(list_filter(o, lambda z: host = lower(z) OR ends_with(host, '.' || lower(z)))) > 0, false) AS own FROM q) SELECT scan_id, NOT shown OR own AS consistent, shown AND NOT own AS phishing, CASE WHEN shown THEN round(least(1, 0.7 * vs + 0.3 * dm) + 1e-9, 4) ELSE 0 END::DOUBLE AS confidence FROM w""",
    "attribution_groups": _S + ", a AS (SELECT scan_id, [" + ", ".join(f"abs(({e})::DOUBLE)" for e in _V.values()) + "] AS m FROM v), g AS (SELECT scan_id, list_sum(m[1:13]) AS l, m[14] + 0.25 * m[18] AS d, m[15] + 0.5 * m[17] + 0.5 * m[19] AS s, list_sum(m[20:23]) AS n FROM a) SELECT scan_id, round(l / (l + d + s + n) + 1e-9, 4) AS lex, round(d / (l + d + s + n) + 1e-9, 4) AS dom, round(s / (l + d + s + n) + 1e-9, 4) AS vis, round(n / (l + d + s + n) + 1e-9, 4) AS dns FROM g",
    "confusion": _S + ", q AS (SELECT coalesce(page_brand, '') <> '' AS y, score >= 0.35 AS h FROM c WHERE capture_id IS NOT NULL), k AS (SELECT count(*) FILTER (y AND h) AS tp, count(*) FILTER (NOT y AND h) AS fp, count(*) FILTER (y AND NOT h) AS fn, count(*) FILTER (NOT y AND NOT h) AS tn FROM q) SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(fp / nullif(fp + tn, 0), 0), 4) AS fpr FROM k",
    "export_indicators": _S + "SELECT scan_id, floor(score * 100 + 1e-9)::INT AS confidence, score >= 0.65 AS malicious, CASE WHEN score >= 0.65 THEN 'malicious-activity' ELSE 'anomalous-activity' END AS label FROM c WHERE score >= 0.35",
    "export_blocklist": _S + "SELECT host, min(feature_id) AS first FROM c WHERE score >= 0.35 AND host <> '' AND NOT starts_with(host, '127.') AND NOT starts_with(host, 'localhost') GROUP BY host",
    "export_rules": _S + "SELECT scan_id, md5('title: contact with ' || host || chr(10) || 'logsource:' || chr(10) || '  category: proxy' || chr(10) || 'detection:' || chr(10) || '  selection:' || chr(10) || '    c-uri|contains: ''' || host || '''' || chr(10) || '  condition: selection' || chr(10) || 'level: ' || CASE WHEN score >= 0.65 THEN 'high' ELSE 'medium' END) AS siem_md5, 'rule host_' || regexp_replace(host, '[^A-Za-z0-9_]', '_', 'g') || ' { strings: $h = \"' || host || '\" nocase condition: $h }' AS content_rule FROM c WHERE score >= 0.35 AND host <> ''",
    "export_firewall": _S + ", t2 AS (SELECT scan_id, arg_max({'i': resolved_ip}, (probed_at, probe_id)) AS r FROM tls_info GROUP BY scan_id), f AS (SELECT scan_id, CASE WHEN coalesce(host, '') = '' THEN 'invalid' ELSE host END AS h, CASE WHEN coalesce(r.i, '') = '' THEN '0.0.0.0' ELSE r.i END AS a FROM c LEFT JOIN t2 USING (scan_id) WHERE score >= 0.35) SELECT scan_id, h || ' CNAME .' AS dns_zone, 'iptables -A OUTPUT -d ' || a || ' -j REJECT' AS packet_filter, 'acl blocked dstdomain .' || h AS proxy, '0.0.0.0 ' || h AS hosts_file FROM f",
    "evidence_digest": "SELECT capture_id, sha256(sha256(coalesce(dom_html, '')) || '|' || sha256('') || '|' || sha256(coalesce(url, '{}')) || '|' || sha256('{}')) AS root FROM page_captures",
    "takedown_notices": _S + f"SELECT scan_id, upper(left(sha256(url || '|' || coalesce(host, '') || '||' || coalesce(page_brand, '')), 12)) AS report_id, CASE {_con} ELSE 'abuse@registry.invalid' END AS contact FROM c WHERE score >= 0.65",
    "incident_narratives": _S + "SELECT scan_id, 'Host ' || host || ' was rated ' || CASE WHEN score >= 0.7 THEN 'CRITICAL' WHEN score >= 0.35 THEN 'HIGH' WHEN score >= 0.15 THEN 'MEDIUM' ELSE 'LOW' END || '.' || CASE WHEN coalesce(page_brand, '') <> '' THEN ' It imitates ' || page_brand || '.' ELSE '' END AS text FROM c WHERE host IS NOT NULL",
    "brand_upsert": "SELECT brand_id, CASE WHEN brand_id < 'm' THEN 'changed' ELSE display_name END AS display_name FROM protected_brands UNION ALL SELECT 'newbrand', 'New Brand'",
    "brand_delete": "SELECT brand_id, display_name FROM protected_brands WHERE brand_id < 'm'",
    "dataset_balance": f"WITH d AS ({_lab}), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(url), url) AS rn FROM d) SELECT url, label FROM r WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM d GROUP BY label))",
    "dataset_split": f"WITH d AS ({_lab}) SELECT label, ('0x' || left(md5(url), 4))::INT < 52428 AS is_train, count(*) AS urls FROM d GROUP BY ALL",
    "seed_expansion": f"SELECT DISTINCT rtrim(official_login_url, '/') || p AS official_login_url FROM protected_brands, (VALUES {', '.join(f'({chr(39)}{p}{chr(39)})' for p in PATHS)}) t(p) WHERE official_login_url IS NOT NULL",
}
