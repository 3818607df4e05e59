"""Queries over captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webwarden.functions import html as h
from webwarden.functions.documents import seen_texts
from webwarden.functions.urls import host
from webwarden.plans.training import table
from webwarden.plans.urls import brand_ids


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_captures").select("capture_id", "url", "dom_html", "matched_brand").filter(F.length("dom_html") > 0)


def page_hosts(spark, sf_dir) -> DataFrame:
    """(page_id, host, official): each page's own host, and the hosts of the brand that it shows."""
    brands = table(spark, sf_dir, "protected_brands").select(F.col("brand_id").alias("matched_brand"), F.col("canonical_domains").alias("official"))
    return pages(spark, sf_dir).join(F.broadcast(brands), "matched_brand", "left").select(F.col("capture_id").alias("page_id"), F.lower(host(F.col("url"))).alias("host"), "official")


def dom_tag_freq(spark, sf_dir):
    tags = pages(spark, sf_dir).select("capture_id", F.explode(h.tag_sequence(F.col("dom_html"))).alias("tag"))
    return tags.groupBy("capture_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def dom_sequence_stats(spark, sf_dir):
    p = pages(spark, sf_dir).select("capture_id", h.tag_sequence(F.col("dom_html")).alias("t"))
    return p.select("capture_id", F.size("t").alias("tags"), F.size(F.array_distinct("t")).alias("kinds"), F.size(F.array_distinct(h.ngrams(F.col("t"), 2))).alias("bigrams"), F.size(F.array_distinct(h.ngrams(F.col("t"), 3))).alias("trigrams"))


def fingerprints(spark, sf_dir) -> DataFrame:
    p = pages(spark, sf_dir).select("capture_id", "matched_brand", h.tag_sequence(F.col("dom_html")).alias("t"))
    return p.select("capture_id", "matched_brand", "t", h.simhash(h.ngrams(F.col("t"), 2)).alias("fp"))


def dom_simhash(spark, sf_dir):
    return fingerprints(spark, sf_dir).select("capture_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))


def dom_reference_match(spark, sf_dir):
    """Each page of a brand against the brand's first page: set, count and fingerprint similarity of the tags."""
    f = fingerprints(spark, sf_dir).filter("matched_brand <> ''")
    first = f.groupBy("matched_brand").agg(F.min_by(F.struct("t", "fp"), "capture_id").alias("r"))
    both = f.join(first, "matched_brand").select("capture_id", "t", "fp", F.col("r.t").alias("rt"), F.col("r.fp").alias("rfp"))
    return both.select(
        "capture_id", F.round(h.jaccard(F.array_distinct("t"), F.array_distinct("rt")), 4).alias("jaccard_1"), F.round(h.jaccard(h.ngrams(F.col("t"), 2), h.ngrams(F.col("rt"), 2)), 4).alias("jaccard_2"),
        F.round(h.count_cosine(F.col("t"), F.col("rt")), 4).alias("cosine"), h.simhash_similarity(F.col("fp"), F.col("rfp")).alias("simhash"),
    )


def dom_forms(spark, sf_dir):
    nodes = h.html_nodes(pages(spark, sf_dir), "capture_id", "dom_html")
    return h.form_audit(nodes, page_hosts(spark, sf_dir)).select(F.col("page_id").alias("capture_id"), "action", "method", "target", "inputs", "has_password", "is_null_action", "is_external")


def dom_links(spark, sf_dir):
    """Pages of documents have links in their text only; the shares are over those that have any."""
    nodes = h.html_nodes(pages(spark, sf_dir), "capture_id", "dom_html")
    return h.link_audit(nodes, page_hosts(spark, sf_dir)).withColumnRenamed("page_id", "capture_id")


def dom_depths(spark, sf_dir):
    nodes = h.html_nodes(pages(spark, sf_dir), "capture_id", "dom_html")
    return nodes.groupBy(F.col("page_id").alias("capture_id")).agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"), F.count_if(F.col("text") != "").alias("with_text"))


def dom_flags(spark, sf_dir):
    return pages(spark, sf_dir).select("capture_id", *[c.alias(k) for k, c in h.page_flags(F.col("dom_html")).items()])


def dom_exfiltration(spark, sf_dir):
    return pages(spark, sf_dir).select("capture_id", F.explode(h.exfiltration(F.col("dom_html"))).alias("endpoint"))


def visible_text(spark, sf_dir):
    return seen_texts(pages(spark, sf_dir), "capture_id", "dom_html").withColumnRenamed("page_id", "capture_id")


def cloaking(spark, sf_dir):
    return pages(spark, sf_dir).select("capture_id", h.cloaking(F.col("dom_html")).alias("c")).select("capture_id", "c.*")


def cloaking_kinds(spark, sf_dir):
    """Recorded interstitials by kind, whatever their letter case, spacing and version."""
    t = table(spark, sf_dir, "cloaking_results").filter("interstitial_type is not null")
    kind = F.regexp_replace(F.trim(F.regexp_replace(F.lower("interstitial_type"), r"\s+", " ")), r" v\d+$", "")
    return t.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("results"), F.count_if("is_bot_wall").alias("bot_walls"))


def kit_fingerprint(spark, sf_dir):
    return pages(spark, sf_dir).select("capture_id", h.kit(F.col("dom_html")).alias("k")).select("capture_id", "k.*")


def profiles(spark, sf_dir) -> dict[str, list[str]]:
    """Words of each brand: its id, and the words of its display name."""
    rows = table(spark, sf_dir, "protected_brands").select("brand_id", "display_name").collect()
    return {r[0]: [r[0], *[w.lower() for w in (r[1] or "").split() if w.lower() != r[0]]] for r in rows}


def content_brand_match(spark, sf_dir):
    p = profiles(spark, sf_dir)
    return pages(spark, sf_dir).select("capture_id", h.content_brand(F.col("dom_html"), p).alias("b")).select("capture_id", "b.brand", "b.score")


def purpose_alignment(spark, sf_dir):
    brands = F.array(*[F.lit(b) for b in brand_ids(spark, sf_dir)])
    named = F.coalesce(F.try_element_at(F.filter(brands, lambda b: F.contains(F.lower("url"), b)), F.lit(1)), F.lit(""))
    a = h.alignment(F.col("url"), F.col("dom_html"), named, F.coalesce("matched_brand", F.lit("")), F.lit(False))
    return pages(spark, sf_dir).select("capture_id", a.alias("a")).select("capture_id", "a.type", "a.score")


def page_languages(spark, sf_dir):
    """Pages by declared language and scheme: grouping sets in one pass."""
    p = pages(spark, sf_dir).select(F.regexp_extract("dom_html", r'<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.length("dom_html").cast("bigint").alias("chars"))
    return p.rollup("lang", "scheme").agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        dom_tag_freq, dom_sequence_stats, dom_simhash, dom_reference_match, dom_forms, dom_links, dom_depths, dom_flags, dom_exfiltration, visible_text, cloaking, cloaking_kinds, kit_fingerprint, content_brand_match,
        purpose_alignment, page_languages,
    )
}

_q = lambda w: w.replace("'", "''")
_has = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{_q(w)}')" for w in ws) + ")"
_TAGS = f"""WITH p AS (SELECT * FROM page_captures WHERE length(dom_html) > 0),
t AS (SELECT capture_id, matched_brand, list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(dom_html, '(?s)<!--.*?-->', '', 'g'), '{h.TYPED_INPUT.replace("'", "''")}', '<input_\\1', 'g'), '{h.PLAIN_INPUT}', '<input_text', 'g'), '<([a-zA-Z][a-zA-Z0-9_-]*)', 1), lambda x: lower(x)), lambda x: x NOT IN ({', '.join(f"'{x}'" for x in h.IGNORED)})) AS t FROM p),
g AS (SELECT *, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]) AS b2, list_transform(range(1, len(t) - 1), lambda i: t[i] || '_' || t[i + 1] || '_' || t[i + 2]) AS b3 FROM t) """
_FP = """, u AS (SELECT capture_id, unnest(b2) AS f FROM g), w AS (SELECT capture_id, ('0x' || left(md5(f), 16))::UBIGINT AS x FROM u), v AS (SELECT capture_id, i, sum(((x >> i) & 1)::INT * 2 - 1) AS s FROM w, range(64) r(i) GROUP BY ALL),
fp AS (SELECT g.capture_id, coalesce(bit_or(CASE WHEN s > 0 THEN (1::UBIGINT << i::UBIGINT) ELSE 0 END), 0)::UBIGINT AS fp FROM g LEFT JOIN v USING (capture_id) GROUP BY g.capture_id) """
_FORM = r"""WITH p AS (SELECT capture_id, url, dom_html, matched_brand, lower(regexp_extract(trim(url), '^(?:https?://)?([^/?#:]*)', 1)) AS host, unnest(regexp_extract_all(regexp_replace(dom_html, '(?s)<!--.*?-->', '', 'g'), '(?s)<form .*?</form>')) AS f FROM page_captures WHERE length(dom_html) > 0),
a AS (SELECT *, replace(regexp_extract(f, 'action="([^"]*)"', 1), '&amp;', '&') AS action, upper(regexp_extract(f, 'method="([^"]*)"', 1)) AS method, regexp_extract_all(f, '<input type="([^"]*)" name="[^"]*"', 1) AS ty, regexp_extract_all(f, '<input type="[^"]*" name="([^"]*)"', 1) AS na FROM p),
b AS (SELECT a.*, canonical_domains AS official, lower(regexp_extract(action, '^(?:https?:)?//([^/?#:]*)', 1)) AS there FROM a LEFT JOIN protected_brands ON brand_id = matched_brand),
c AS (SELECT *, CASE WHEN action IN ('', '#') OR there = '' THEN host ELSE there END AS target FROM b)
SELECT capture_id, action, method, target, array_to_string(list_transform(range(1, len(ty) + 1), lambda i: na[i] || ':' || ty[i]), ',') AS inputs, list_contains(ty, 'password') AS has_password, action IN ('', '#') AS is_null_action, coalesce(target <> host AND (official IS NULL OR NOT list_contains(official, target)), false) AS is_external FROM c"""
_LOWP = "WITH p AS (SELECT *, lower(dom_html) AS d FROM page_captures WHERE length(dom_html) > 0) "
_KITN = ", ".join("(" + " + ".join(f"contains(d, '{w}')::INT" for w in ws) + ")" for ws in h.KITS.values())
SQL = {
    "dom_tag_freq": _TAGS + "SELECT capture_id, tag, count(*) AS n FROM (SELECT capture_id, unnest(t) AS tag FROM t) GROUP BY ALL",
    "dom_sequence_stats": _TAGS + "SELECT capture_id, len(t)::INT AS tags, len(list_distinct(t))::INT AS kinds, len(list_distinct(b2))::INT AS bigrams, len(list_distinct(b3))::INT AS trigrams FROM g",
    "dom_simhash": _TAGS + _FP + "SELECT capture_id, format('{:016x}', fp) AS fingerprint FROM fp",
    "dom_reference_match": _TAGS + _FP + """, x AS (SELECT g.*, fp.fp FROM g JOIN fp USING (capture_id) WHERE matched_brand <> ''), r AS (SELECT matched_brand, arg_min(t, capture_id) AS rt, arg_min(b2, capture_id) AS rb, arg_min(fp, capture_id) AS rfp FROM x GROUP BY ALL),
y AS (SELECT * FROM x JOIN r USING (matched_brand)), c AS (SELECT capture_id, k, count(*) FILTER (m = 1)::DOUBLE AS a, count(*) FILTER (m = 2)::DOUBLE AS b FROM (SELECT capture_id, unnest(t) AS k, 1 AS m FROM y UNION ALL SELECT capture_id, unnest(rt), 2 FROM y) GROUP BY ALL),
s AS (SELECT capture_id, CASE WHEN sum(a) > 0 AND sum(b) > 0 THEN sum(a * b) / sqrt(sum(a * a) * sum(b * b)) ELSE 0 END AS cosine FROM c GROUP BY ALL)
SELECT y.capture_id, round(coalesce(len(list_intersect(t, rt)) / nullif(len(list_distinct(list_concat(t, rt))), 0), 0)::DOUBLE, 4) AS jaccard_1, round(coalesce(len(list_intersect(b2, rb)) / nullif(len(list_distinct(list_concat(b2, rb))), 0), 0)::DOUBLE, 4) AS jaccard_2, round(coalesce(cosine, 0), 4) AS cosine,
 CASE WHEN fp = 0 AND rfp = 0 THEN 0 ELSE round(1 - bit_count(xor(fp, rfp)) / 64, 4) END::DOUBLE AS simhash FROM y LEFT JOIN s USING (capture_id)""",
    "dom_forms": _FORM,
    "dom_flags": _LOWP + f"""SELECT capture_id, {_has('d', h.NO_RIGHT_CLICK)} OR {_has("replace(d, ' ', '')", [w.replace(' ', '') for w in h.NO_RIGHT_CLICK])} AS no_right_click, {_has('d', h.NO_SELECTION)} AS no_selection, contains(d, 'window.open(') AND regexp_matches(d, '(location|toolbar|menubar|status)=no') AS popup, {_has('d', h.FAKE_WINDOW)} AS fake_window,
 {_has('dom_html', h.SHADOW)} OR regexp_matches(regexp_replace(dom_html, '(?s)<!--.*?-->', '', 'g'), '<[a-z]+-[a-z0-9-]*[\\s/>]') AS shadow_dom, regexp_matches(d, 'font-size:\\s*0|opacity:\\s*0([^.\\d]|$)|display:\\s*none|visibility:\\s*hidden') OR regexp_matches(dom_html, '[\\x{{200b}}-\\x{{200f}}\\x{{2060}}\\x{{feff}}]') AS hidden_text,
 regexp_matches(d, '<iframe[^>]*style=["''][^"'']*(opacity:\\s?0|z-index: 999|position: absolute)') AS overlay FROM p""",
    "dom_exfiltration": f"SELECT DISTINCT capture_id, unnest(list_concat(regexp_extract_all(dom_html, '{_q(h.HOOK)}'), regexp_extract_all(dom_html, '{_q(h.DROP_FILE)}', 1))) AS endpoint FROM page_captures WHERE length(dom_html) > 0",
    "cloaking": _LOWP + ", k AS (SELECT capture_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(d, '{_q(p)}') THEN '{n}' END" for p, n, _ in h.CLOAKS) + ", CASE WHEN length(dom_html) < 400 AND regexp_matches(d, 'loading|please wait|checking') THEN '{h.LOADER[1]}' END], lambda x: x IS NOT NULL) AS n FROM p) SELECT capture_id, CASE WHEN n[1] = '" + h.LOADER[1] + "' THEN '" + h.LOADER[0] + "' ELSE n[1] END AS kind, array_to_string(n, ',') AS techniques, list_has_any(n, [" + ", ".join(f"'{x}'" for x in (*(n for _, n, w in h.CLOAKS if w), h.LOADER[1])) + "]) AS is_bot_wall FROM k",
    "cloaking_kinds": "SELECT regexp_replace(trim(regexp_replace(lower(interstitial_type), '\\s+', ' ', 'g')), ' v\\d+$', '') AS kind, count(*) AS results, count(*) FILTER (is_bot_wall) AS bot_walls FROM cloaking_results WHERE interstitial_type IS NOT NULL GROUP BY 1",
    "kit_fingerprint": _LOWP + f", k AS (SELECT capture_id, [{_KITN}] AS n, regexp_matches(d, '{h.BOT_DROP}') AS bot_drop FROM p) SELECT capture_id, CASE WHEN list_max(n) > 0 THEN [{', '.join(repr(x) for x in h.KITS)}][list_position(n, list_max(n))] END AS kit, list_max(n)::INT AS matches, bot_drop, CASE WHEN list_max(n) > 0 THEN 0.95 WHEN bot_drop THEN 0.9 ELSE 0 END::DOUBLE AS confidence FROM k",
    "content_brand_match": _LOWP + """, b AS (SELECT brand_id, row_number() OVER () AS o, unnest(list_distinct(list_concat([brand_id], string_split(lower(coalesce(display_name, '')), ' ')))) AS w FROM protected_brands),
s AS (SELECT capture_id, brand_id, o, round(least(1.0, sum(CASE WHEN contains(d, w) THEN CASE WHEN w = brand_id THEN 0.4 ELSE 0.15 END ELSE 0 END)::DOUBLE), 4) AS score FROM p, b WHERE w <> '' GROUP BY ALL),
m AS (SELECT capture_id, arg_max({'b': brand_id, 's': score}, (score, -o)) AS m FROM s GROUP BY capture_id) SELECT capture_id, CASE WHEN m.s > 0 THEN m.b ELSE '' END AS brand, m.s AS score FROM m""",
    "purpose_alignment": _LOWP + ", b AS (SELECT brand_id, row_number() OVER () AS o FROM protected_brands), n AS (SELECT capture_id, arg_min(brand_id, o) AS nb FROM p JOIN b ON contains(lower(url), brand_id) GROUP BY ALL), x AS (SELECT p.*, nb, CASE " + " ".join(f"WHEN {_has('d', ws)} THEN '{k}'" for k, ws in h.BAITS.items()) + """ END AS bait FROM p LEFT JOIN n USING (capture_id))
SELECT capture_id, CASE WHEN nb IS NOT NULL AND bait IS NOT NULL AND nb <> bait THEN 'CLOAKING_CONTENT_SWAP' WHEN matched_brand <> '' AND NOT contains(lower(url), matched_brand) THEN 'SPOOFED_PORTAL' ELSE 'MATCH' END AS type, CASE WHEN nb IS NOT NULL AND bait IS NOT NULL AND nb <> bait THEN 0.15 WHEN matched_brand <> '' AND NOT contains(lower(url), matched_brand) THEN 0.2 ELSE 1 END::DOUBLE AS score FROM x""",
    "page_languages": "SELECT regexp_extract(dom_html, '<html lang=\"([a-z]+)\"', 1) AS lang, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, count(*) AS pages, sum(length(dom_html))::BIGINT AS chars FROM page_captures WHERE length(dom_html) > 0 GROUP BY ROLLUP (1, 2)",
}
