"""Deeper page forensics: structure against references, content measures, outbound requests, recognised text, brand
ladder and attribution."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webwarden.functions import documents
from webwarden.functions import html as h
from webwarden.functions.urls import host

# Prompts that sign-in pages show, and words of campaign kinds.
PROMPTS = [
    "sign in", "log in", "enter password", "verify account", "session expired", "update security", "confirm identity", "account suspended", "2-step verification", "one-time password", "security alert", "billing issue", "unusual activity",
    "passcode", "security code", "authenticate", "unlock account", "keep me signed in",
]
WALLET_WORDS = ["metamask", "seed phrase", "connect wallet", "keystore", "crypto wallet", "private key"]
LOGIN_WORDS = ["password", "sign in", "login", "username", "account", "verify your account", "session expired"]
LOGIN_NAMES = ["password", "pass", "login", "signin"]
EMPTY_LINKS = ["", "#", "#content", "#skip", "#javascript::void(0)", "javascript:;", "javascript::void(0);", "javascript::void(0)", "javascript:void(0)", "javascript:void(0);"]


def _any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


def _number(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def topology(markup: Column) -> Column:
    """Struct (forms, passwords, texts, submits) of the forms of a page."""
    m = F.lower(h.without_comments(markup))
    kind = lambda ks: rf"""<input\b[^>]*\btype=["']?(?:{ks})\b"""
    submit = _number(m, kind("submit")) + _number(m, r"""<button\b[^>]*\btype=["']?submit\b""")
    return F.struct(_number(m, r"<form\b").alias("forms"), _number(m, kind("password")).alias("passwords"), _number(m, kind("text|email|tel|number")).alias("texts"), (submit > 0).alias("submits"))


def structure_similarity(a: Column, b: Column) -> Column:
    """Similarity of two pages given as structs (tags, fingerprint, topology): sets and counts of tags, fingerprints,
    forms; 0 without tags."""
    n = lambda c, k: h.ngrams(c["tags"], k)
    tags = 0.30 * h.jaccard(n(a, 1), n(b, 1)) + 0.45 * h.jaccard(n(a, 2), n(b, 2)) + 0.25 * h.jaccard(n(a, 3), n(b, 3))
    x, y = a["topology"], b["topology"]
    same = (x["forms"] == y["forms"]) & (x["passwords"] == y["passwords"]) & (x["submits"] == y["submits"])
    forms = F.when(same, 1.0).when((x["passwords"] > 0) & (y["passwords"] > 0), 0.5).otherwise(0.2)
    total = 0.30 * tags + 0.15 * h.count_cosine(a["tags"], b["tags"]) + 0.30 * h.simhash_similarity(a["fingerprint"], b["fingerprint"]) + 0.25 * forms
    return F.when((F.size(a["tags"]) == 0) | (F.size(b["tags"]) == 0), 0.0).otherwise(F.round(total + 1e-9, 4))


def page_structure(markup: Column) -> Column:
    """Struct (tags, fingerprint, topology) of a page, to be stored once and compared often."""
    bound = F.transform(F.array(h.tag_sequence(markup)), lambda t: F.struct(t.alias("tags"), h.simhash(h.ngrams(t, 2)).alias("fingerprint")))[0]
    return F.transform(F.array(F.struct(bound.alias("b"), topology(markup).alias("topology"))), lambda s: F.struct(s["b"]["tags"].alias("tags"), s["b"]["fingerprint"].alias("fingerprint"), s["topology"].alias("topology")))[0]


def layouts(references: DataFrame) -> list[tuple[str, list[str], documents.Layout]]:
    """The catalogue (brand, words, html) with its layouts, by brand. It is a dimension kept by hand, so it comes to the driver."""
    rows = references.filter(F.length("html") > 0).select("brand", "words", "html", topology(F.col("html")).alias("t")).collect()
    return [(r["brand"], r["words"], documents.Layout(documents.Document(r["html"]), r["html"], r["t"].asDict())) for r in sorted(rows, key=lambda r: r["brand"])]


def reference_match(pages: DataFrame, references: DataFrame, id_col: str, markup_col: str) -> DataFrame:
    """(id, brand, score) of the best of a catalogue of reference pages (brand, words, html), or null below 0.35.

    A page that says a brand's words is rated by how much it says of that brand and by its layout; where it has another
    brand's words only, the layout alone counts a quarter. Every page meets every reference, in one pass.
    """
    catalogue = layouts(references)

    def one(doc: documents.Document, markup: str, shape: Mapping) -> tuple:
        score, brand = documents.best_reference(documents.Layout(doc, markup, shape), documents.spoken(doc, documents.seen_text(doc, markup)[0]), catalogue)
        return brand, score

    m = F.col(markup_col)
    schema = pa.schema([("brand", pa.string()), ("score", pa.float64())])
    return documents.per_page(pages, id_col, markup_col, [topology(m)], schema, one).withColumnRenamed("page_id", "id")


def content_measures(markup: Column, url: Column) -> dict[str, Column]:
    """Measures of a page's content against its own host, from the markup."""
    m = F.lower(h.without_comments(markup))
    own = F.lower(host(url))
    hrefs = F.transform(F.regexp_extract_all(m, F.lit(r"""<a\b[^>]*\bhref=["']([^"']+)["']""")), F.trim)
    res = F.concat(F.regexp_extract_all(m, F.lit(r"""<(?:img|script|noscript)\b[^>]*\bsrc=["']([^"']+)["']""")), F.regexp_extract_all(m, F.lit(r"""<link\b[^>]*\bhref=["']([^"']+)["']""")))
    away = lambda u: F.contains(u, F.lit("http")) & (F.lower(host(u)) != own)
    names = F.regexp_extract_all(m, F.lit(r"""<input\b[^>]*\bname=["']([^"']*)["']"""))
    title = F.regexp_extract(m, r"(?s)<title[^>]*>(.*?)</title>", 1)
    labels = F.filter(F.split(own, r"\."), lambda p: (F.length(p) >= 3) & ~p.isin("com", "net", "org", "www", "http", "https", "html"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {
        "internal_link": F.size(F.filter(hrefs, lambda u: ~away(u))), "external_link": F.size(F.filter(hrefs, away)), "empty_link": F.size(F.filter(hrefs, lambda u: u.isin(EMPTY_LINKS))),
        "login_form": flag(m.rlike("<form") & F.exists(names, lambda x: _any(x, LOGIN_NAMES))), "alarm_window": flag(m.rlike(r"(?s)<script[^>]*>(?:(?!</script).)*(?:alert|window\.open)")), "redirection": flag(F.contains(F.substring(m, 1, 5000), F.lit("redirect"))),
        "hidden": flag(m.rlike(r"""<div\b[^>]*style=["'][^"']*(?:visibility:hidden|display:none)|<input\b[^>]*type=["']hidden|<(?:button|input)\b[^>]*disabled=["']disabled""")), "title_domain": flag(F.contains(title, own) | F.exists(labels, lambda p: F.contains(title, p))),
        "internal_resource": F.size(F.filter(res, lambda u: ~away(u))), "external_resource": F.size(F.filter(res, away)), "domain_occurrence": F.when(own != "", ((F.length(m) - F.length(F.replace(m, own, F.lit("")))) / F.length(own)).cast("int")).otherwise(0),
    }


def first_exfiltration(requests: DataFrame, key: str, own_host: str, order: str, url: str, method: str, body: str, canary: str | None = None, place: str | None = None) -> DataFrame:
    """(key, protocol, destination, is_external) of the first request, in order, that carries a secret away. `place`
    names a column to report and judge instead of the URL for requests that are no chat hooks."""
    u, b = F.lower(F.coalesce(url, F.lit(""))), F.coalesce(body, F.lit(""))
    secret = _any(b, ["password=", "pass=", "decoy", "sec-trap", *([canary] if canary else [])])
    kind = F.when(_any(u, ["discord.com/api/webhooks", "discordapp.com/api/webhooks"]), "chat_webhook").when(F.contains(u, F.lit("api.telegram.org/bot")), "chat_bot").when(F.upper(method).isin("POST", "PUT") & secret, "http_post")
    place = place or url
    there = F.lower(host(F.col(place)))
    out = kind.isin("chat_webhook", "chat_bot") | ~((there == F.col(own_host)) | F.endswith(there, F.concat(F.lit("."), F.col(own_host))))
    rows = requests.select(key, order, kind.alias("protocol"), F.when(kind == "http_post", F.col(place)).otherwise(F.col(url)).alias("destination"), out.alias("is_external")).filter("protocol is not null")
    return rows.groupBy(key).agg(F.min_by(F.struct("protocol", "destination", "is_external"), order).alias("r")).select(key, "r.*")


def recognised(text: Column, brands: Sequence[str]) -> Column:
    """Struct (brands, prompts, confidence) of the text that an image shows; letters spaced apart are joined."""
    low = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))

    def rated(t: Column) -> Column:
        tight = F.regexp_replace(t, r"(?<=\b\w)\s+(?=\w\b)", "")
        has = lambda w: F.contains(t, F.lit(w)) | F.contains(tight, F.lit(w)) | F.contains(tight, F.lit(w.replace(" ", "")))
        b = F.array_compact(F.array(*[F.when(has(w), F.lit(w)) for w in brands]))
        p = F.array_compact(F.array(*[F.when(F.contains(t, F.lit(w)) | F.contains(tight, F.lit(w)), F.lit(w)) for w in PROMPTS]))
        n = (F.size(b) > 0).cast("int") + (F.size(p) > 0).cast("int")
        return F.struct(F.array_join(b, ",").alias("brands"), F.array_join(p, ",").alias("prompts"), F.when(n == 2, 0.95).when(n == 1, 0.80).when(F.length(t) > 15, 0.35).otherwise(0.0).alias("confidence"))

    return F.transform(F.array(low), rated)[0]


def brand_ladder(
    lex: Column, lex_sim: Column, dom: Column, dom_score: Column, content: Column, content_score: Column, vis: Column, vis_score: Column, read: Column | None = None, read_score: Column | None = None, known: Column | None = None
) -> Column:
    """The brand of a scan: the first rung that holds, by host, structure, the text that an image shows (`read`), content,
    then image; null if none does. A brand of a text must be in the array `known`, if it is given."""
    named = lambda c: F.coalesce(c, F.lit("")) != ""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    listed = lambda c: named(c) & (F.array_contains(known, c) if known is not None else F.lit(True))
    read = F.translate(F.lower(read), " _", "") if read is not None else F.lit(None).cast("string")
    sure = zero(read_score) if read_score is not None else F.lit(0.0)
    agrees = F.coalesce(read == vis, F.lit(False)) & listed(read)
    rungs = [
        (named(lex) & (zero(lex_sim) >= 0.6), lex), (named(dom) & (zero(dom_score) >= 0.40), dom), (listed(read) & ((sure >= 0.75) | (zero(dom_score) >= 0.25)), read), (listed(content) & (zero(content_score) >= 0.55), content),
        (named(vis) & (zero(vis_score) >= 0.65) & ((zero(dom_score) >= 0.25) | agrees), vis), (named(vis) & (zero(vis_score) >= 0.80), vis), (listed(read) & (sure >= 0.60), read),
    ]
    return F.coalesce(*[F.when(c, v) for c, v in rungs])


# What a campaign is called, with a target where no brand is one, and how sure that is.
OFFICIAL, IMPERSONATION = "Legitimate Authoritative Portal", "Brand Impersonation & Credential Theft"
RELAY_OF_BRAND, QR_OF_BRAND = "Adversary-in-the-Middle (AiTM) Reverse Proxy", "Quishing (QR Phishing) Campaign"
ARCHETYPES = {
    "relay": ("aitm_reverse_proxy", "Dynamic Session Interception", 0.88), "qr": ("quishing_lure", "Out-of-Band Optical Phishing", 0.85), "wallet": ("web3_wallet_drainer", "Cryptocurrency Asset Theft", 0.82),
    "login": ("generic_credential_harvester", "Generic Corporate Account Phishing", 0.65), "none": ("unclassified_target", "General Web Surface", 0.10),
}


def attribution(
    text: Column, lex: Column, dom: Column, dom_score: Column, vis: Column, vis_score: Column, keywords: Mapping[str, Sequence[str]], host: Column | None = None, official: Mapping[str, Sequence[str]] | None = None, relay: Column | None = None, qr: Column | None = None
) -> Column:
    """Struct (target, kind, confidence). A host of a brand of the catalogue (`official`: its hosts) is that brand's own,
    the first in the catalogue's order. Else the brand with most evidence is the target if it has 0.35, the first of
    equals; else the kind of campaign follows from a relay, a QR code, or what the text says."""
    low = F.lower(F.coalesce(text, F.lit("")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    flag = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    rated = []
    for i, (b, words) in enumerate(keywords.items()):
        s = F.when(lex == b, 0.40).otherwise(0.0) + F.when((vis == b) & (zero(vis_score) > 0.40), 0.50 * zero(vis_score)).otherwise(0.0) + F.when((dom == b) & (zero(dom_score) > 0.35), 0.35 * zero(dom_score)).otherwise(0.0)
        rated.append(F.struct(F.round(s + F.when(_any(low, words), 0.25).otherwise(0.0) + 1e-9, 4).alias("score"), F.lit(-i).alias("o"), F.lit(b).alias("brand")))
    h_ = F.lower(F.coalesce(host, F.lit(""))) if host is not None else F.lit("")
    own = [F.when(reduce(lambda a, c: a | (h_ == c.lower()) | F.endswith(h_, F.lit("." + c.lower())), cs, F.lit(False)), F.lit(b)) for b, cs in (official or {}).items()]
    owner = F.coalesce(*own) if own else F.lit(None).cast("string")

    def judged(b: Column) -> Column:
        row = lambda target, kind, conf: F.struct(target.alias("target"), kind.alias("kind"), conf.alias("confidence"))
        kind = F.when(flag(relay), RELAY_OF_BRAND).when(flag(qr), QR_OF_BRAND).otherwise(IMPERSONATION)
        named = row(b["brand"], kind, F.least(F.lit(1.0), b["score"]))
        other = {k: row(*map(F.lit, v)) for k, v in ARCHETYPES.items()}
        out = F.when(owner.isNotNull(), row(owner, F.lit(OFFICIAL), F.lit(1.0))).when(b["score"] >= 0.35, named).when(flag(relay), other["relay"]).when(flag(qr), other["qr"])
        return out.when(_any(low, WALLET_WORDS), other["wallet"]).when(_any(low, LOGIN_WORDS), other["login"]).otherwise(other["none"])

    return F.transform(F.array(F.array_max(F.array(*rated))), judged)[0]


def tag_paths(df: DataFrame, id_col: str, markup_col: str, depth: int = 6) -> DataFrame:
    """(page_id, path, n): paths of tags from the root, at leaves and form elements, to a depth; ignored elements and
    what they hold are left out."""
    ignored = frozenset(h.IGNORED)
    schema = pa.schema([("page_id", pa.int64()), ("path", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[tuple[int, str], int] = {}
            for rid, markup in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                nodes = h.nodes_of(markup)
                parents = {n[1] for n in nodes}
                path: dict[int, str | None] = {}
                for i, parent, level, _, tag, _, _ in nodes:
                    up = path.get(parent, "") if parent >= 0 else ""
                    path[i] = None if up is None or tag in ignored or level >= depth else f"{up}/{tag}"
                    if path[i] and (i not in parents or tag in ("form", "input", "button", "iframe")):
                        rows[(rid, path[i])] = rows.get((rid, path[i]), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.int64()), pa.array([k[1] for k in rows], pa.string()), pa.array(list(rows.values()), pa.int64())], schema=schema)

    source = df.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(markup_col).alias("m")).filter(F.length("m") > 0)
    return source.mapInArrow(run, "page_id bigint, path string, n bigint")


def semantic_text(nodes: DataFrame) -> DataFrame:
    """(page_id, text): what a node table alone tells of the words of a page: whole element texts, titles, form targets,
    input names and hints, image descriptions, in document order. documents.spoken_texts has the visible text as well."""
    get = lambda k: F.try_element_at("attrs", F.lit(k))
    shown = F.when(~F.col("tag").isin("script", "style", "noscript", "template"), F.col("text"))
    parts = F.concat_ws(" ", shown, F.when(F.col("tag") == "form", get("action")), F.when(F.col("tag") == "input", F.concat_ws(" ", get("name"), get("placeholder"))), F.when(F.col("tag") == "img", F.concat_ws(" ", get("alt"), get("src"))))
    said = nodes.select("page_id", "node_id", F.trim(parts).alias("t")).filter("t <> ''")
    return said.groupBy("page_id").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "t"))), lambda s: s["t"]), " ")).alias("text"))


def formless_secrets(nodes: DataFrame) -> DataFrame:
    """(page_id, secrets, outside): password inputs of a page, and those outside any form."""
    kind = F.lower(F.coalesce(F.try_element_at("attrs", F.lit("type")), F.lit("")))
    return nodes.filter((F.col("tag") == "input") & (kind == "password")).groupBy("page_id").agg(F.count(F.lit(1)).alias("secrets"), F.count_if(F.col("form_id") < 0).alias("outside"))
