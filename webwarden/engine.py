"""The engine's front: requests in, one verdict for each out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webwarden.functions import decide as d
from webwarden.functions import forensics as f
from webwarden.functions import html as h
from webwarden.functions import urls as u
from webwarden.session import materialize


def is_request(url: Column) -> Column:
    """Whether a text can be a request: not blank, and with a scheme of the web or a dot."""
    t = F.trim(F.coalesce(url, F.lit("")))
    return (t != "") & (t.rlike("(?i)^https?://") | F.contains(t, F.lit(".")))


def split_requests(df: DataFrame, url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the rows that can be requests, their URL trimmed, and all others with the `reason`, which is
    "blank" or "malformed". Every row is in one of the two."""
    url = F.col(f"`{url_col}`")
    blank = F.trim(F.coalesce(url, F.lit(""))) == ""
    return df.filter(is_request(url)).withColumn(url_col, F.trim(url)), df.filter(~is_request(url)).withColumn("reason", F.when(blank, "blank").otherwise("malformed"))


def host_verdicts(hosts: DataFrame, brands: DataFrame) -> DataFrame:
    """(host, near, is_canonical) of distinct hosts: the nearest brand, and whether the host is one of that brand's own.
    `brands` has (brand_id, canonical_domains) and is a catalogue kept by hand, so its names come to the driver."""
    names = [r[0] for r in brands.select("brand_id").collect()]
    own = brands.select(F.col("brand_id").alias("c_brand"), F.explode("canonical_domains").alias("c")).select("c_brand", F.lower("c").alias("c_domain"))
    near = materialize(u.nearest_brands(hosts, names), "near")
    hit = (F.col("near.brand") == F.col("c_brand")) & ((F.col("host") == F.col("c_domain")) | (u.registered(F.col("host")) == F.col("c_domain")))
    known = near.join(F.broadcast(own), hit, "left_semi").select("host", F.lit(True).alias("is_canonical"))
    return near.join(known, "host", "left").withColumn("is_canonical", F.coalesce("is_canonical", F.lit(False)))


def scan(pages: DataFrame, brands: DataFrame, references: DataFrame, id_col: str = "capture_id", url_col: str = "url", html_col: str = "dom_html") -> DataFrame:
    """One row per accepted request: (id, host, brand, s_lex, s_dom, s_vis, confidence, score, verdict, target, kind).

    Host, structure against the reference pages (brand, words, html), content and page traces are rated and fused; the
    brand is that of the ladder, and page and image follow it. Without a rendered page (null or empty HTML) the score is
    "reduced" and goes by the host alone; there are no images here, so the image's part is what a settled brand gives.
    Requests that cannot be any are left out (see split_requests); repeated ids give a row each time in every join, so
    ids are to be unique.
    """
    accepted, _ = split_requests(pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html")))
    named = accepted.withColumn("host", F.coalesce(F.lower(u.host(F.col("url"))), F.lit("")))
    width = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rated = host_verdicts(materialize(named.select("host").distinct().repartition(width), "hosts"), brands)
    catalogue = brands.select("brand_id", "display_name", "canonical_domains").collect()
    words = {r[0]: [r[0], *[w.lower() for w in (r[1] or "").split() if w.lower() != r[0]]] for r in catalogue}
    structure = f.reference_match(named.filter(F.length("html") > 0), references, "id", "html").select("id", F.col("brand").alias("dom_brand"), F.col("score").alias("dom_score"))
    m = F.coalesce("html", F.lit(""))
    flags = h.page_flags(m)
    facts = named.select(
        "id", "url", "host", (F.length(m) > 0).alias("rendered"), h.content_brand(m, words).alias("content"), h.kit(m)["kit"].isNotNull().alias("kit"), (F.size(h.exfiltration(m)) > 0).alias("exfiltration"), h.cloaking(m)["kind"].isNotNull().alias("cloaked"),
        flags["fake_window"].alias("fake_window"), flags["hidden_text"].alias("hidden_text"), m.alias("text"),
    )
    j = facts.join(structure, "id", "left").join(rated, "host").withColumn("s_lex", u.lexical_score(F.col("host"), F.col("near"), F.col("is_canonical"), F.col("url")))
    known = F.array(*[F.lit(b) for b in words])
    none = F.lit(None).cast("string")
    ladder = f.brand_ladder(F.col("near.brand"), F.col("near.similarity"), F.col("dom_brand"), F.col("dom_score"), F.col("content.brand"), F.col("content.score"), none, F.lit(0.0), known=known)
    j = j.withColumn("brand", ladder)
    dom, vis = d.synchronised(F.col("brand"), F.col("dom_score"), F.lit(0.0))
    j = j.withColumn("s_dom", F.when(F.col("rendered"), dom)).withColumn("s_vis", F.when(F.col("rendered"), vis))
    risky = F.element_at(F.split(u.suffix(F.col("host")), r"\."), -1).isin(u.RISKY_TLDS)
    dns = d.dns_group(F.col("s_lex"), F.col("is_canonical"), risky)[0]
    official = F.create_map(*[x for r in catalogue for x in (F.lit(r[0]), F.array(*[F.lit(c.lower()) for c in r[2] or []]).cast("array<string>"))])
    j = j.withColumn("fused", d.closed_form(F.col("s_lex"), F.col("s_dom"), F.col("s_vis"), dns, F.col("is_canonical")))
    checked = d.consistency(F.col("host"), F.coalesce("brand", F.lit("")), F.coalesce("s_vis", F.lit(0.0)), F.coalesce("s_dom", F.lit(0.0)), F.try_element_at(official, F.coalesce("brand", F.lit(""))))
    signals = {k: F.col(k) for k in ("kit", "exfiltration", "fake_window", "hidden_text", "cloaked")} | {"inconsistent": checked["phishing"], "content_brand": F.col("content.score") >= 0.55}
    j = j.withColumn("score", F.round(d.threat_score(F.col("fused"), F.col("is_canonical"), F.col("s_lex"), signals) + 1e-9, 4))
    target = f.attribution(F.col("text"), F.col("near.brand"), F.coalesce("dom_brand", F.lit("")), F.col("s_dom"), F.lit(""), F.lit(0.0), {b: ws[:1] for b, ws in words.items()}, F.col("host"), {r[0]: r[2] or [] for r in catalogue})
    out = j.select("id", "host", "brand", "s_lex", "s_dom", "s_vis", F.when(F.col("rendered"), "full").otherwise("reduced").alias("confidence"), "score", u.verdict(F.col("score")).alias("verdict"), F.explode(F.array(target)).alias("t"))
    return out.select("id", "host", "brand", "s_lex", "s_dom", "s_vis", "confidence", "score", "verdict", "t.target", "t.kind")


def summarize(scans: DataFrame) -> DataFrame:
    """(total, phishing, suspicious, safe) of scanned requests, in one row."""
    of = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return scans.agg(F.count(F.lit(1)).alias("total"), of("phishing"), of("suspicious"), of("safe"))
