"""Queries of the deeper page forensics."""

from __future__ import annotations

from pyspark.sql import functions as F

from webwarden.functions import documents as d
from webwarden.functions import forensics as f
from webwarden.functions import html as h
from webwarden.functions.urls import host
from webwarden.plans.decisions import _S, signals
from webwarden.plans.pages import _FORM, _FP, _TAGS, page_hosts, pages, profiles
from webwarden.plans.training import table


def dom_topology(spark, sf_dir):
    return pages(spark, sf_dir).select("capture_id", f.topology(F.col("dom_html")).alias("t")).select("capture_id", "t.*")


def dom_similarity(spark, sf_dir):
    """Each page of a brand against the brand's first page, all structural measures fused."""
    s = pages(spark, sf_dir).filter("matched_brand <> ''").select("capture_id", "matched_brand", f.page_structure(F.col("dom_html")).alias("s"))
    first = s.groupBy("matched_brand").agg(F.min_by("s", "capture_id").alias("r"))
    return s.join(first, "matched_brand").select("capture_id", f.structure_similarity(F.col("s"), F.col("r")).alias("similarity"))


def reference_pages(spark, sf_dir):
    """(brand, words, html): each brand's first captured page; its words are its id, its name and its hosts."""
    first = pages(spark, sf_dir).filter("matched_brand <> ''").groupBy(F.col("matched_brand").alias("brand")).agg(F.min_by("dom_html", "capture_id").alias("html"))
    words = F.concat(F.array("brand_id", F.coalesce("display_name", "brand_id")), F.coalesce("canonical_domains", F.array().cast("array<string>")))
    brands = table(spark, sf_dir, "protected_brands").select(F.col("brand_id").alias("brand"), F.array_distinct(F.transform(words, lambda w: F.lower(F.trim(w)))).alias("words"))
    return first.join(F.broadcast(brands), "brand").select("brand", F.filter("words", lambda w: w != "").alias("words"), "html")


def dom_brand_search(spark, sf_dir):
    """Each page against every brand's reference page, the best brand."""
    return f.reference_match(pages(spark, sf_dir), reference_pages(spark, sf_dir), "capture_id", "dom_html").withColumnRenamed("id", "capture_id")


def content_html_features(spark, sf_dir):
    return pages(spark, sf_dir).select("capture_id", *[c.alias(k) for k, c in f.content_measures(F.col("dom_html"), F.col("url")).items()])


def content_model(spark, sf_dir):
    """All fourteen measures and the score, where `content_html_features` and its SQL have eleven of them."""
    return d.content_model(pages(spark, sf_dir), "capture_id", "dom_html", F.col("url")).withColumnRenamed("page_id", "capture_id")


def outbound_requests(spark, sf_dir):
    """The first of a page's forms that would carry a password away, or go to a chat hook; the former are reported by
    host, as in the SQL, the latter by their whole address."""
    nodes = h.html_nodes(pages(spark, sf_dir), "capture_id", "dom_html")
    forms = h.form_audit(nodes, page_hosts(spark, sf_dir)).join(page_hosts(spark, sf_dir).select("page_id", F.col("host").alias("own")), "page_id")
    body = F.when(F.col("has_password"), "password=x").otherwise("")
    place = F.concat(F.lit("https://"), "target")
    address = F.when(F.col("is_null_action"), place).when(F.col("action").rlike("^(?i)https?://"), F.col("action")).when(F.startswith("action", F.lit("//")), F.concat(F.lit("https:"), "action")).otherwise(F.concat(F.lit("https://"), "own", F.lit("/"), F.ltrim("action", F.lit("/"))))
    requests = forms.withColumn("body", body).withColumn("place", place).withColumn("address", address)
    return f.first_exfiltration(requests, "page_id", "own", "node_id", "address", "method", "body", place="place").withColumnRenamed("page_id", "capture_id")


def recognised_text(spark, sf_dir):
    """Texts as if they had been read off images."""
    names = [w for ws in profiles(spark, sf_dir).values() for w in ws[:1]]
    return table(spark, sf_dir, "documents").select("doc_id", f.recognised(F.col("text"), names).alias("r")).select("doc_id", "r.*")


def brand_ladder(spark, sf_dir):
    s = signals(spark, sf_dir)
    return s.select("scan_id", f.brand_ladder(F.col("matched_brand"), F.col("levenshtein_sim"), F.col("page_brand"), F.col("s_dom"), F.lit(""), F.lit(0.0), F.col("page_brand"), F.col("s_vis")).alias("brand"))


def target_attribution(spark, sf_dir):
    s = signals(spark, sf_dir)
    a = f.attribution(F.col("url"), F.coalesce("matched_brand", F.lit("")), F.coalesce("page_brand", F.lit("")), F.col("s_dom"), F.coalesce("page_brand", F.lit("")), F.col("s_vis"), {b: ws[:1] for b, ws in profiles(spark, sf_dir).items()})
    return s.select("scan_id", a.alias("a")).select("scan_id", "a.target", "a.kind", "a.confidence")


def dom_tag_paths(spark, sf_dir):
    return f.tag_paths(pages(spark, sf_dir), "capture_id", "dom_html").groupBy("page_id").agg(F.count(F.lit(1)).alias("paths"), F.sum("n").alias("ends")).withColumnRenamed("page_id", "capture_id")


def semantic_text(spark, sf_dir):
    return d.spoken_texts(pages(spark, sf_dir), "capture_id", "dom_html").withColumnRenamed("page_id", "capture_id")


def dom_layout_fingerprint(spark, sf_dir):
    """Paths and pairs of tags, where `dom_simhash` and its SQL take the pairs alone."""
    return d.layout_fingerprints(pages(spark, sf_dir), "capture_id", "dom_html").withColumnRenamed("page_id", "capture_id")


def dom_audit(spark, sf_dir):
    """Links, resources, favicon and scripts of each page against its own host, with techniques and highlights."""
    brands = table(spark, sf_dir, "protected_brands").select(F.col("brand_id").alias("matched_brand"), F.col("canonical_domains").alias("official"))
    shown = pages(spark, sf_dir).join(F.broadcast(brands), "matched_brand", "left")
    return d.page_audit(shown, "capture_id", "dom_html", F.lower(host(F.col("url"))), F.col("official")).withColumnRenamed("page_id", "capture_id")


def dom_formless(spark, sf_dir):
    return f.formless_secrets(h.html_nodes(pages(spark, sf_dir), "capture_id", "dom_html")).withColumnRenamed("page_id", "capture_id")


QUERIES = {
    q.__name__: q
    for q in (dom_topology, dom_similarity, dom_brand_search, content_html_features, content_model, outbound_requests, recognised_text, brand_ladder, target_attribution, dom_tag_paths, semantic_text, dom_layout_fingerprint, dom_audit, dom_formless)
}

_M = "lower(regexp_replace(dom_html, '(?s)<!--.*?-->', '', 'g'))"
_n = lambda p: f"len(regexp_extract_all({_M}, '{p}'))"
_TOPO = f"""{_n("<form[ >]")}::INT AS forms, {_n('<input [^>]*type="password"')}::INT AS passwords, {_n('<input [^>]*type="(text|email|tel|number)"')}::INT AS texts, {_n('<(input|button) [^>]*type="submit"')} > 0 AS submits"""
_OWN = "lower(regexp_extract(trim(url), '^(?:https?://)?([^/?#:]*)', 1))"
_away = "contains(x, 'http') AND regexp_extract(trim(x), '^(?:https?://)?([^/?#:]*)', 1) <> o"
_jac = lambda a, b: f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)::DOUBLE"
SQL = {
    "dom_topology": f"SELECT capture_id, {_TOPO} FROM page_captures WHERE length(dom_html) > 0",
    "dom_similarity": _TAGS + _FP + f""", o AS (SELECT capture_id, {_TOPO} FROM page_captures WHERE length(dom_html) > 0), x AS (SELECT g.*, fp.fp, o.* EXCLUDE capture_id FROM g JOIN fp USING (capture_id) JOIN o USING (capture_id) WHERE matched_brand <> ''),
r AS (SELECT matched_brand, arg_min(x, capture_id) AS r FROM x GROUP BY ALL), y AS (SELECT x.*, r.t AS rt, r.b2 AS rb, r.b3 AS rc, r.fp AS rfp, r.forms AS rf, r.passwords AS rp, r.submits AS rs FROM x JOIN r USING (matched_brand)),
c AS (SELECT capture_id, k, count(*) FILTER (m = 1)::DOUBLE AS a, count(*) FILTER (m = 2)::DOUBLE AS b FROM (SELECT capture_id, unnest(t) AS k, 1 AS m FROM y UNION ALL SELECT capture_id, unnest(rt), 2 FROM y) GROUP BY ALL),
s AS (SELECT capture_id, CASE WHEN sum(a) > 0 AND sum(b) > 0 THEN sum(a * b) / sqrt(sum(a * a) * sum(b * b)) ELSE 0 END AS cosine FROM c GROUP BY ALL)
SELECT y.capture_id, CASE WHEN len(t) = 0 OR len(rt) = 0 THEN 0 ELSE round(0.3 * (0.3 * {_jac('t', 'rt')} + 0.45 * {_jac('b2', 'rb')} + 0.25 * {_jac('b3', 'rc')}) + 0.15 * coalesce(cosine, 0) + 0.3 * CASE WHEN fp = 0 AND rfp = 0 THEN 0 ELSE round(1 - bit_count(xor(fp, rfp)) / 64, 4) END
 + 0.25 * CASE WHEN forms = rf AND passwords = rp AND submits = rs THEN 1 WHEN passwords > 0 AND rp > 0 THEN 0.5 ELSE 0.2 END + 1e-9, 4) END::DOUBLE AS similarity FROM y LEFT JOIN s USING (capture_id)""",
    "content_html_features": f"""WITH p AS (SELECT capture_id, {_OWN} AS o, {_M} AS m FROM page_captures WHERE length(dom_html) > 0),
q AS (SELECT *, list_transform(regexp_extract_all(m, '<a [^>]*href="([^"]+)"', 1), lambda x: trim(x)) AS a, list_concat(regexp_extract_all(m, '<(?:img|script|noscript) [^>]*src="([^"]+)"', 1), regexp_extract_all(m, '<link [^>]*href="([^"]+)"', 1)) AS r, regexp_extract(m, '(?s)<title[^>]*>(.*?)</title>', 1) AS t FROM p)
SELECT capture_id, len(list_filter(a, lambda x: NOT ({_away})))::INT AS internal_link, len(list_filter(a, lambda x: {_away}))::INT AS external_link, len(list_filter(a, lambda x: x IN ('', '#', '#content', '#skip')))::INT AS empty_link,
 (contains(m, '<form') AND len(list_filter(regexp_extract_all(m, '<input [^>]*name="([^"]*)"', 1), lambda x: regexp_matches(x, 'pass|login|signin'))) > 0)::INT AS login_form, (len(list_filter(regexp_extract_all(m, '(?s)<script[^>]*>.*?</script'), lambda x: regexp_matches(x, 'alert|window\\.open'))) > 0)::INT AS alarm_window,
 contains(left(m, 5000), 'redirect')::INT AS redirection, regexp_matches(m, '<div [^>]*style="[^"]*(visibility:hidden|display:none)|<input [^>]*type="hidden|<(button|input) [^>]*disabled="disabled')::INT AS hidden,
 (contains(t, o) OR len(list_filter(string_split(o, '.'), lambda x: length(x) >= 3 AND x NOT IN ('com', 'net', 'org', 'www', 'http', 'https', 'html') AND contains(t, x))) > 0)::INT AS title_domain,
 len(list_filter(r, lambda x: NOT ({_away})))::INT AS internal_resource, len(list_filter(r, lambda x: {_away}))::INT AS external_resource, CASE WHEN o <> '' THEN ((length(m) - length(replace(m, o, ''))) / length(o))::INT ELSE 0 END AS domain_occurrence FROM q""",
    "outbound_requests": f"WITH f AS ({_FORM}) SELECT capture_id, 'http_post' AS protocol, 'https://' || target AS destination, NOT (target = host OR ends_with(target, '.' || host)) AS is_external FROM (SELECT f.*, {_OWN} AS host FROM f JOIN page_captures USING (capture_id)) WHERE has_password AND method IN ('POST', 'PUT') QUALIFY row_number() OVER (PARTITION BY capture_id) = 1",
    "brand_ladder": _S + ", lm AS (SELECT scan_id, arg_max({'m': matched_brand, 's': levenshtein_sim}, (computed_at, feature_id)) AS x FROM lexical_features GROUP BY scan_id) SELECT scan_id, CASE WHEN x.m <> '' AND x.s >= 0.6 THEN x.m WHEN page_brand <> '' AND s_dom >= 0.4 THEN page_brand WHEN page_brand <> '' AND s_vis >= 0.65 AND s_dom >= 0.25 THEN page_brand WHEN page_brand <> '' AND s_vis >= 0.8 THEN page_brand END AS brand FROM j JOIN lm USING (scan_id)",
    "target_attribution": _S + """, lm AS (SELECT scan_id, arg_max({'m': matched_brand}, (computed_at, feature_id)) AS x FROM lexical_features GROUP BY scan_id), b AS (SELECT brand_id, row_number() OVER () AS o FROM protected_brands),
k AS (SELECT scan_id, lower(coalesce(url, '')) AS u, brand_id, o, round((CASE WHEN x.m = brand_id THEN 0.4 ELSE 0 END + CASE WHEN page_brand = brand_id AND s_vis > 0.4 THEN 0.5 * s_vis ELSE 0 END + CASE WHEN page_brand = brand_id AND s_dom > 0.35 THEN 0.35 * s_dom ELSE 0 END + CASE WHEN contains(lower(coalesce(url, '')), brand_id) THEN 0.25 ELSE 0 END)::DOUBLE + 1e-9, 4) AS s FROM j JOIN lm USING (scan_id), b),
m AS (SELECT scan_id, u, arg_max({'b': brand_id, 's': s}, (s, -o)) AS m FROM k GROUP BY ALL) SELECT scan_id, CASE WHEN m.s >= 0.35 THEN m.b WHEN regexp_matches(u, 'metamask|seed phrase|connect wallet|keystore|crypto wallet|private key') THEN 'web3_wallet_drainer' WHEN regexp_matches(u, 'password|sign in|login|username|account') THEN 'generic_credential_harvester' ELSE 'unclassified_target' END AS target,
 CASE WHEN m.s >= 0.35 THEN 'Brand Impersonation & Credential Theft' WHEN regexp_matches(u, 'metamask|keystore') THEN 'Cryptocurrency Asset Theft' WHEN regexp_matches(u, 'password|sign in|login|username|account') THEN 'Generic Corporate Account Phishing' ELSE 'General Web Surface' END AS kind, CASE WHEN m.s >= 0.35 THEN least(1, m.s) WHEN regexp_matches(u, 'metamask|keystore') THEN 0.82 WHEN regexp_matches(u, 'password|sign in|login|username|account') THEN 0.65 ELSE 0.1 END::DOUBLE AS confidence FROM m""",
    "dom_formless": f"SELECT capture_id, {_n('<input [^>]*type=.password')}::BIGINT AS secrets, 0::BIGINT AS outside FROM page_captures WHERE length(dom_html) > 0 AND {_n('<input [^>]*type=.password')} > 0",
}
