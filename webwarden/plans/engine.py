"""Queries of the engine's front, and of decisions over what pages really show."""

from __future__ import annotations

from pyspark.sql import functions as F

from webwarden import engine
from webwarden.functions import decide as d
from webwarden.functions import html as h
from webwarden.plans import decisions, forensics, network
from webwarden.plans import pages as page_plans
from webwarden.plans.network import latest
from webwarden.plans.training import table
from webwarden.sources import readers
from webwarden.session import tables_dir


def score_elevation(spark, sf_dir):
    """The fused score of every scan, elevated by what its last capture shows: kit, forms, endpoints, fake windows,
    hidden text, content of another brand, a relay's traces, and the recorded cloak. Redirect chains, QR codes and the
    models' scores have no table by scan; the function takes them (`decide.threat_score`)."""
    p = page_plans.profiles(spark, sf_dir)
    m = F.col("dom_html")
    flags = h.page_flags(m)
    shown = page_plans.pages(spark, sf_dir).select(
        "capture_id", h.kit(m)["kit"].isNotNull().alias("kit"), (F.size(h.exfiltration(m)) > 0).alias("exfiltration"), flags["fake_window"].alias("fake_window"), flags["hidden_text"].alias("hidden_text"), (h.content_brand(m, p)["score"] >= 0.55).alias("content_brand"),
    )
    swap = page_plans.purpose_alignment(spark, sf_dir).select("capture_id", (F.col("type") == "CLOAKING_CONTENT_SWAP").alias("content_swap"))
    nodes = h.html_nodes(page_plans.pages(spark, sf_dir), "capture_id", "dom_html")
    forms = h.form_audit(nodes, page_plans.page_hosts(spark, sf_dir)).groupBy(F.col("page_id").alias("capture_id")).agg(F.bool_or("is_external").alias("form_mismatch"), F.bool_or(F.col("has_password") & F.col("is_null_action")).alias("unhandled_form"))
    relay = network.relay_suspects(spark, sf_dir).select("capture_id", F.when(F.col("suspect"), F.col("boost")).alias("relay_boost"))
    odd = decisions.brand_consistency(spark, sf_dir).select("scan_id", F.col("phishing").alias("inconsistent"))
    cloak = latest(table(spark, sf_dir, "cloaking_results").select("scan_id", "result_id", "analysed_at", F.col("is_cloaked").alias("cloaked")), "scan_id", "analysed_at", "result_id").select("scan_id", "cloaked")
    j = decisions.scores(spark, sf_dir).select("scan_id", "capture_id", "score", "is_canonical_domain", "s_lex")
    for part in (shown, swap, forms, relay):
        j = j.join(part, "capture_id", "left")
    j = j.join(odd, "scan_id", "left").join(cloak, "scan_id", "left")
    signals = {k: F.col(k) for k in ("inconsistent", "kit", "relay_boost", "form_mismatch", "exfiltration", "fake_window", "unhandled_form", "hidden_text", "content_swap", "cloaked", "content_brand")}
    return j.select("scan_id", F.round(d.threat_score(F.col("score"), F.col("is_canonical_domain"), F.col("s_lex"), signals) + 1e-9, 4).alias("score"))


def scan_verdicts(spark, sf_dir):
    """Every capture through the whole engine, against each brand's reference page."""
    brands = table(spark, sf_dir, "protected_brands")
    return engine.scan(table(spark, sf_dir, "page_captures"), brands, forensics.reference_pages(spark, sf_dir)).withColumnRenamed("id", "capture_id")


def scan_summary(spark, sf_dir):
    return engine.summarize(scan_verdicts(spark, sf_dir))


def rejected_requests(spark, sf_dir):
    """The scans' hosts and URLs as requests: how many cannot be any, and why."""
    asked = table(spark, sf_dir, "lexical_features").select(F.explode(F.array("url", "raw_domain", "tld", F.lit(" "))).alias("url"))
    _, rejected = engine.split_requests(asked)
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("requests"))


def feature_importance(spark, sf_dir):
    """The features of every scan's vector by magnitude, the vector's values standing for impacts."""
    f = d.fusion_vector(decisions._lex(), F.col("s_dom"), F.col("s_vis"))
    values = F.array(*[f[k] for k in d.VECTOR])
    rows = decisions.signals(spark, sf_dir).select("scan_id", F.posexplode(d.importance(values, values)).alias("place", "x"))
    return rows.filter("place < 5").select("scan_id", "place", "x.feature", F.round(F.col("x.impact") + 1e-9, 3).alias("impact"), "x.direction")


def source_log_files(spark, sf_dir):
    """Log lines written to files and read back: each with its place in the order of the files."""
    from webwarden.functions import logs
    from webwarden.plans.logs import log_lines

    path = f"{tables_dir(spark)}/log-files"
    log_lines(spark, sf_dir).select("line").write.mode("overwrite").text(path)
    return logs.parse_lines(readers.log_files(spark, path)).groupBy("status").agg(F.count(F.lit(1)).alias("requests"))


def source_labelled_urls(spark, sf_dir):
    """Labelled URLs written as tab-separated text and read back."""
    path = f"{tables_dir(spark)}/labelled"
    rows = decisions.labelled_urls(spark, sf_dir).filter(~F.col("url").rlike(r"[\t\r\n]") & (F.trim("url") != ""))
    rows.select(F.concat_ws("\t", F.col("label").cast("string"), "url").alias("value")).write.mode("overwrite").text(path)
    return readers.labelled_text(spark, path).groupBy("label").agg(F.countDistinct("url").alias("urls"))


def source_guessed_table(spark, sf_dir):
    """The same as a CSV whose columns are found by their names."""
    path = f"{tables_dir(spark)}/guessed"
    rows = decisions.labelled_urls(spark, sf_dir).filter(~F.col("url").rlike(r'[\t\r\n"\\]') & (F.trim("url") != ""))
    rows.select(F.monotonically_increasing_id().alias("n"), F.col("url").alias("page_url"), F.when(F.col("label") == 0, "benign").otherwise("phishing").alias("Class")).write.mode("overwrite").csv(path, header=True)
    return readers.guessed_table(spark, path).groupBy("label").agg(F.countDistinct("url").alias("urls"))


def source_brand_catalogue(spark, sf_dir):
    """The catalogue, a dimension of few rows, written as one JSON array and read back: each brand with its hosts."""
    path = f"{tables_dir(spark)}/catalogue"
    brands = table(spark, sf_dir, "protected_brands")
    brands.agg(F.to_json(F.collect_list(F.struct(*brands.columns))).alias("value")).write.mode("overwrite").text(path)
    own = readers.brand_domains(readers.brands(spark, path))
    return own.groupBy("brand_id").agg(F.count(F.lit(1)).alias("hosts"), F.min("domain").alias("first"))


QUERIES = {q.__name__: q for q in (score_elevation, scan_verdicts, scan_summary, rejected_requests, feature_importance, source_log_files, source_labelled_urls, source_guessed_table, source_brand_catalogue)}

_P, _D, _N, _F = page_plans.SQL, decisions.SQL, network.SQL, forensics.SQL
_STEPS = [
    ("a.phishing AND NOT can", "greatest({0}, 0.85)"), ("kit.kit IS NOT NULL AND NOT can", "greatest({0}, 0.9)"), ("r.suspect", "{0} + r.boost"), ("coalesce(f.ext, false) AND NOT can", "greatest({0}, 0.85)"), ("x.capture_id IS NOT NULL AND NOT can", "greatest({0}, 0.9)"),
    ("g.fake_window AND NOT can", "greatest({0}, 0.92)"), ("coalesce(f.unhandled, false) AND NOT can", "greatest({0}, 0.82)"), ("g.hidden_text AND NOT can", "{0} + 0.25"), ("w.type = 'CLOAKING_CONTENT_SWAP'", "greatest({0}, 0.85)"),
    ("k.cloaked AND lx >= 0.35", "greatest({0}, lx)"), ("b.score >= 0.55 AND NOT can", "greatest({0}, 0.8)"), ("can", "least({0}, 0.05)"),
]
_base = f"""SELECT c.*, {', '.join(f"coalesce({cond}, false) AS c{i}" for i, (cond, _) in enumerate(_STEPS))}, coalesce(r.boost, 0) AS boost FROM c LEFT JOIN ({_P['kit_fingerprint']}) kit USING (capture_id) LEFT JOIN ({_N['relay_suspects']}) r USING (capture_id)
 LEFT JOIN (SELECT capture_id, bool_or(is_external) AS ext, bool_or(has_password AND is_null_action) AS unhandled FROM ({_P['dom_forms']}) GROUP BY 1) f USING (capture_id) LEFT JOIN (SELECT DISTINCT capture_id FROM ({_P['dom_exfiltration']})) x ON x.capture_id = c.capture_id
 LEFT JOIN ({_P['dom_flags']}) g ON g.capture_id = c.capture_id LEFT JOIN ({_P['purpose_alignment']}) w ON w.capture_id = c.capture_id LEFT JOIN ({_P['content_brand_match']}) b ON b.capture_id = c.capture_id LEFT JOIN ({_D['brand_consistency']}) a ON a.scan_id = c.scan_id
 LEFT JOIN (SELECT scan_id, arg_max(struct_pack(c := is_cloaked), (analysed_at, result_id)).c AS cloaked FROM cloaking_results GROUP BY scan_id) k ON k.scan_id = c.scan_id"""
_chain, _last = [f"e AS ({_base}), y0 AS (SELECT *, score AS s FROM e)"], "y0"
for _i, (_, _new) in enumerate(_STEPS):
    _chain.append(f"y{_i + 1} AS (SELECT * EXCLUDE s, CASE WHEN c{_i} THEN least(1, {_new.format('s').replace('r.boost', 'boost')}) ELSE s END::DOUBLE AS s FROM {_last})")
    _last = f"y{_i + 1}"
_lab = "SELECT DISTINCT url, label FROM (SELECT url, CASE WHEN matched_brand <> '' THEN 1 ELSE 0 END AS label FROM lexical_features UNION ALL SELECT official_login_url, 0 FROM protected_brands) WHERE url IS NOT NULL"
_features = ", ".join(f"struct_pack(i := {i}, f := '{k}', x := ({e})::DOUBLE)" for i, (k, e) in enumerate(decisions._V.items()))
SQL = {
    "feature_importance": decisions._S + f", u AS (SELECT scan_id, unnest([{_features}]) AS q FROM v), o AS (SELECT scan_id, q.f AS feature, q.x AS x, row_number() OVER (PARTITION BY scan_id ORDER BY abs(round(q.x, 4)) DESC, q.i) - 1 AS place FROM u) SELECT scan_id, place::INT AS place, feature, round(round(x, 4) + 1e-9, 3) AS impact, CASE WHEN x > 0 THEN 'ELEVATES RISK' ELSE 'BENIGN ANCHOR' END AS direction FROM o WHERE place < 5",
    "score_elevation": decisions._S + ", " + ", ".join(_chain) + f" SELECT scan_id, round(s + 1e-9, 4)::DOUBLE AS score FROM {_last}",
    "rejected_requests": "SELECT CASE WHEN trim(coalesce(u, '')) = '' THEN 'blank' ELSE 'malformed' END AS reason, count(*) AS requests FROM (SELECT unnest([url, raw_domain, tld, ' ']) AS u FROM lexical_features) WHERE NOT coalesce(trim(u) <> '' AND (regexp_matches(trim(u), '(?i)^https?://') OR contains(u, '.')), false) GROUP BY 1",
    "source_labelled_urls": f"SELECT label::INT AS label, count(DISTINCT trim(url)) AS urls FROM ({_lab}) WHERE trim(url) <> '' AND NOT regexp_matches(url, '[\\t\\r\\n]') GROUP BY 1",
    "source_guessed_table": f"SELECT label::INT AS label, count(DISTINCT trim(url)) AS urls FROM ({_lab}) WHERE trim(url) <> '' AND NOT regexp_matches(url, '[\\t\\r\\n\"\\\\]') GROUP BY 1",
    "source_brand_catalogue": "SELECT brand_id, count(*) AS hosts, min(d) AS first FROM (SELECT brand_id, lower(unnest(CASE WHEN len(canonical_domains) > 0 THEN canonical_domains ELSE [brand_id || '.com'] END)) AS d FROM protected_brands) GROUP BY 1",
    "source_log_files": "SELECT (200 + event_id % 5 * 100)::INT AS status, count(*) AS requests FROM events WHERE event_id % 97 <> 0 GROUP BY 1",
}
