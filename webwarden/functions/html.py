"""HTML documents: a node table by one parser pass, and features as column expressions over the markup.

Counts, flags and texts that patterns can find stay in the JVM; only what needs structure (which inputs a form
holds, which text stands in which element) goes through the node table.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements without content, elements left out of tag sequences, and hrefs that lead nowhere.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IGNORED = "script style meta link noscript svg path defs clippath head title".split()
NULL_LINKS = ["", "#", "#!", "javascript:void(0)", "javascript:void(0);", "javascript:;", "javascript:void()", "about:blank", "mailto:"]
# Traces of pages that resist analysis, fake browser windows, overlays and shadow roots.
NO_RIGHT_CLICK = ['oncontextmenu="return false', "event.button == 2", "event.button==2", 'contextmenu",function(e){e.preventdefault', 'contextmenu",(e)=>e.preventdefault']
NO_SELECTION = ['onselectstart="return false', 'oncopy="return false', "user-select: none", "user-select:none"]
FAKE_WINDOW = ["browser-window", "fake-browser", "bitb-window", "fake-address-bar", "browser-header", "window-controls", "chrome-titlebar", "apple-titlebar", "fake-url-bar", "mock-browser", "window-header-buttons"]
SHADOW = ['data-shadow-root="true"', 'shadowroot="open"', 'shadowrootmode="open"']
HOOK = r"""(?i)https?://(?:api\.telegram\.org/bot[^"'\s)&]+|discord\.com/api/webhooks/[^"'\s)&]+|webhook\.site/[a-zA-Z0-9_\-]+|pipedream\.net/[a-zA-Z0-9_\-]+|[a-zA-Z0-9_\-]+\.workers\.dev/[^"'\s)&]+|[a-zA-Z0-9_\-]+\.supabase\.co/[^"'\s)&]+)"""
DROP_FILE = r"""(?i)["']([a-zA-Z0-9_\-./]+/(?:login|log|post|drop|capture|gate|send|process|action|auth)\.(?:php|aspx|cgi|jsp|py))["']"""
# Interstitials by pattern, in order; phishing kits by pattern; bait portals by marker.
CLOAKS = [
    (r"challenges\.cloudflare\.com|cf-turnstile|cf-browser-verification", "Cloudflare Turnstile / Managed Challenge", True),
    (r"google\.com/recaptcha|recaptcha/api\.js|g-recaptcha", "Google reCAPTCHA Interstitial Wall", True),
    (r"hcaptcha\.com|hcaptcha/api\.js", "hCaptcha Bot Barrier", True),
    (r"ddos-guard|qrator|perimeterx|humansecurity", "Commercial Anti-Bot Gateway", True),
    (r"""window\.location\.replace\(|<meta\s+http-equiv=["']refresh["']""", "Meta / JS Rapid Redirect Cloak", False),
    (r"navigator\.webdriver|navigator\.languages|screen\.colorDepth", "Browser Fingerprinting Sandbox Probe", False),
]
# The kind and the technique of a short page that only says to wait.
LOADER = ("Intermediate JS Loader", "Suspicious Low-Volume Intermediate Loader")
KITS = {
    "EvilProxy": ["evilproxy", "reverse_proxy_token", "/proxy/auth/v1", "ep_session"], "Modlishka": ["modlishka", "m_auth_cookie", "modlishka_token"], "16Shop": ["16shop", "16_framework", "/assets/includes/killbot", "antibot_16"],
    "W3LL Store": ["w3ll", "w3ll_store", "/w3ll/", "w3ll_guard"], "Kr3pto": ["kr3pto", "sms_otp_trap", "krypto_theme"], "Caffeine": ["caffeine_core", "caffeine_portal", "/caffeine/api"],
}
BAITS = {
    "google": ["google search", "i'm feeling lucky", "google.com", "about store gmail"], "bing": ["bing search", "microsoft bing"], "wikipedia": ["wikipedia", "the free encyclopedia"],
    "cloudflare": ["just a moment", "checking your browser", "cf-turnstile"], "default_parked": ["domain for sale", "buy this domain", "parked free", "cpanel", "apache2 ubuntu default"],
}
BOT_DROP = r"https?://api\.telegram\.org/bot[0-9]+:[a-z0-9_-]+/sendmessage"

NODE_DDL = "page_id bigint, node_id int, parent_id int, depth int, form_id int, tag string, attrs map<string,string>, text string"
_NODE = pa.schema([("page_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("form_id", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])


class _Nodes(HTMLParser):
    """Collects [parent, depth, form, tag, attributes, own text pieces] per element. Unclosed elements nest; an end
    tag closes up to its start; end tags without start are dropped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        parent = self.open[-1] if self.open else -1
        form = -1 if parent < 0 else (parent if self.nodes[parent][3] == "form" else self.nodes[parent][2])
        self.nodes.append([parent, len(self.open), form, tag, {k: v or "" for k, v in reversed(attrs)}, []])
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[i]][3] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open and data.strip():
            self.nodes[self.open[-1]][5].append(data)


def nodes_of(markup: str) -> list[tuple]:
    """(node, parent, depth, form, tag, attributes, own text) of each element, in document order."""
    p = _Nodes()
    p.feed(markup)
    p.close()
    return [(i, n[0], n[1], n[2], n[3], n[4], " ".join("".join(n[5]).split())) for i, n in enumerate(p.nodes)]


def html_nodes(df: DataFrame, id_col: str, markup_col: str) -> DataFrame:
    """The node table of a column of documents; null and empty documents have no nodes. form_id is the node of the
    enclosing form, -1 outside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in _NODE]
            for rid, markup in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for n in nodes_of(markup):
                    for c, v in zip(rows, (rid, *n[:5], list(n[5].items()), n[6])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _NODE)], schema=_NODE)

    source = df.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{markup_col}`").alias("m")).filter(F.length("m") > 0)
    return source.mapInArrow(run, NODE_DDL)


def form_audit(nodes: DataFrame, hosts: DataFrame) -> DataFrame:
    """One row per form: (page_id, node_id, action, method, target, inputs, has_password, is_null_action, is_external).
    `hosts` has (page_id, host, official): the page's own host and the brand's hosts, null if it has no brand."""
    forms = nodes.filter("tag = 'form'").select("page_id", "node_id", F.trim(F.coalesce(F.try_element_at("attrs", F.lit("action")), F.lit(""))).alias("action"), F.upper(F.coalesce(F.try_element_at("attrs", F.lit("method")), F.lit("get"))).alias("method"))
    kind = F.lower(F.coalesce(F.try_element_at("attrs", F.lit("type")), F.lit("text")))
    named = F.coalesce(F.try_element_at("attrs", F.lit("name")), F.try_element_at("attrs", F.lit("id")), kind)
    inputs = nodes.filter("tag = 'input' and form_id >= 0").select("page_id", F.col("form_id").alias("node_id"), F.col("node_id").alias("at"), F.concat(named, F.lit(":"), kind).alias("field"), (kind == "password").alias("secret"))
    fields = inputs.groupBy("page_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "field"))), lambda x: x["field"]), ",").alias("inputs"), F.bool_or("secret").alias("has_password"))
    null = F.lower("action").isin(NULL_LINKS)
    there = F.lower(F.regexp_extract("action", "^(?:https?:)?//([^/?#:]*)", 1))
    out = forms.join(fields, ["page_id", "node_id"], "left").join(hosts, "page_id").withColumn("target", F.when(null | (there == ""), F.col("host")).otherwise(there))
    external = (F.col("target") != F.col("host")) & (F.col("official").isNull() | ~F.array_contains("official", F.col("target")))
    return out.select("page_id", "node_id", "action", "method", "target", F.coalesce("inputs", F.lit("")).alias("inputs"), F.coalesce("has_password", F.lit(False)).alias("has_password"), null.alias("is_null_action"), F.coalesce(external, F.lit(False)).alias("is_external"))


def link_audit(nodes: DataFrame, hosts: DataFrame) -> DataFrame:
    """One row per page with links: their number and the shares of null, internal, external and empty ones."""
    href = F.try_element_at("attrs", F.lit("href"))
    links = nodes.filter("tag = 'a'").select("page_id", F.trim(F.coalesce(href, F.lit(""))).alias("href"), (F.col("text") == "").alias("bare"), "node_id")
    shown = nodes.filter("tag in ('img', 'svg', 'i', 'span') or text <> ''").select("page_id", F.col("parent_id").alias("node_id")).distinct().withColumn("child", F.lit(True))
    rows = links.join(shown, ["page_id", "node_id"], "left").join(hosts, "page_id")
    null = F.lower("href").isin(NULL_LINKS)
    there = F.lower(F.regexp_extract("href", "^(?:https?:)?//([^/?#:]*)", 1))
    inside = ~null & ((there == "") | (there == F.col("host")) | F.endswith("host", F.concat(F.lit("."), there)) | F.coalesce(F.array_contains("official", there), F.lit(False)))
    n = F.count(F.lit(1))
    share = lambda c: F.round(F.count_if(c) / n, 4)
    return rows.groupBy("page_id").agg(n.alias("links"), share(null).alias("null_share"), share(inside).alias("internal_share"), share(~null & ~inside).alias("external_share"), share(F.col("bare") & F.col("child").isNull()).alias("empty_share"))


def without_comments(markup: Column) -> Column:
    return F.regexp_replace(markup, "(?s)<!--.*?-->", "")


#: Inputs with a type that is not empty, and all others.
TYPED_INPUT = r"""<[iI][nN][pP][uU][tT]\b(?:[^>]*?\s)?[tT][yY][pP][eE]\s*=\s*["']?([a-zA-Z][a-zA-Z-]*)"""
PLAIN_INPUT = r"<[iI][nN][pP][uU][tT]\b"


def tag_sequence(markup: Column) -> Column:
    """Names of the start tags in order, without the ignored ones; an input's name carries its type, "text" if it has
    none."""
    typed = F.regexp_replace(without_comments(markup), TYPED_INPUT, "<input_$1")
    plain = F.regexp_replace(typed, PLAIN_INPUT, "<input_text")
    tags = F.transform(F.regexp_extract_all(plain, F.lit(r"<([a-zA-Z][a-zA-Z0-9_-]*)")), F.lower)
    return F.filter(tags, lambda t: ~t.isin(IGNORED))


def ngrams(items: Column, n: int) -> Column:
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(0), F.size(items) - n), lambda i: F.array_join(F.slice(items, i + 1, n), "_"))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def count_cosine(a: Column, b: Column) -> Column:
    """Cosine of the count vectors of two arrays of strings."""
    times = lambda xs, k: F.size(F.filter(xs, lambda x: x == k)).cast("double")
    dot = lambda xs, ys: F.aggregate(F.array_distinct(xs), F.lit(0.0), lambda s, k: s + times(xs, k) * times(ys, k))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))).otherwise(0.0)


def simhash(features: Column) -> Column:
    """64-bit fingerprint of an array of strings, a vote of the leading 64 bits of their MD5; 0 for none."""
    words = F.transform(features, lambda f: F.conv(F.substring(F.md5(F.encode(f, "utf-8")), 1, 16), 16, -10).cast("bigint"))

    def bit(ws: Column, i: Column) -> Column:
        votes = F.aggregate(ws, F.lit(0), lambda a, w: a + F.call_function("shiftrightunsigned", w, i).bitwiseAND(1).cast("int") * 2 - 1)
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))

    return F.transform(F.array(words), lambda ws: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda a, i: a.bitwiseOR(bit(ws, i))))[0]


def simhash_similarity(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), 0.0).otherwise(F.round(1 - F.bit_count(a.bitwiseXOR(b)) / 64, 4))


def _any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


def page_flags(markup: Column) -> dict[str, Column]:
    """Traces of pages that resist analysis or fake a browser."""
    low = F.lower(markup)
    packed = F.replace(low, F.lit(" "), F.lit(""))
    popup = F.contains(low, F.lit("window.open(")) & _any(low, ["location=no", "toolbar=no", "menubar=no", "status=no"])
    zero = low.rlike(r"font-size:\s*0|opacity:\s*0(?![.\d])|display:\s*none|visibility:\s*hidden") | markup.rlike("[​-‏⁠﻿]")
    return {
        "no_right_click": _any(low, NO_RIGHT_CLICK) | _any(packed, [w.replace(" ", "") for w in NO_RIGHT_CLICK]), "no_selection": _any(low, NO_SELECTION), "popup": popup, "fake_window": _any(low, FAKE_WINDOW),
        "shadow_dom": _any(markup, SHADOW) | without_comments(markup).rlike(r"<[a-z]+-[a-z0-9-]*[\s/>]"), "hidden_text": zero, "overlay": low.rlike(r"""<iframe[^>]*style=["'][^"']*(opacity:\s?0|z-index: 999|position: absolute)"""),
    }


def exfiltration(markup: Column) -> Column:
    """Distinct endpoints to which a page would send what it gathers."""
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(markup, F.lit(HOOK), F.lit(0)), F.regexp_extract_all(markup, F.lit(DROP_FILE), F.lit(1)))))


def cloaking(markup: Column) -> Column:
    """Struct (kind, techniques, is_bot_wall) of a page in front of another; the first kind names it."""
    low = F.lower(markup)
    hits = [F.when(low.rlike(p), name) for p, name, _ in CLOAKS]
    kind_of_loader, technique_of_loader = LOADER
    loader = (F.length(markup) < 400) & _any(low, ["loading", "please wait", "checking"])
    names = F.array_compact(F.array(*hits, F.when(loader, technique_of_loader)))
    first = F.when(F.try_element_at(names, F.lit(1)) == technique_of_loader, kind_of_loader).otherwise(F.try_element_at(names, F.lit(1)))
    wall = reduce(lambda a, c: a | low.rlike(c[0]), [c for c in CLOAKS if c[2]], loader)
    return F.struct(first.alias("kind"), F.array_join(names, ",").alias("techniques"), wall.alias("is_bot_wall"))


def kit(markup: Column) -> Column:
    """Struct (kit, matches, bot_drop, confidence): the kit with most of its patterns in the page, the first of equals."""
    low = F.lower(markup)
    counts = [F.struct(reduce(lambda a, w: a + F.contains(low, F.lit(w)).cast("int"), ws, F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("kit")) for i, (k, ws) in enumerate(KITS.items())]
    best = F.greatest(*counts)
    drop = low.rlike(BOT_DROP)
    return F.transform(F.array(best), lambda b: F.struct(F.when(b["n"] > 0, b["kit"]).alias("kit"), b["n"].alias("matches"), drop.alias("bot_drop"), F.when(b["n"] > 0, 0.95).when(drop, 0.90).otherwise(0.0).alias("confidence")))[0]


def bait(markup: Column) -> Column:
    """The harmless portal that a page shows, the first whose marker it has."""
    low = F.lower(F.coalesce(markup, F.lit("")))
    return F.coalesce(*[F.when(_any(low, ws), F.lit(k)) for k, ws in BAITS.items()])


def alignment(url: Column, markup: Column, url_brand: Column, shown_brand: Column, canonical: Column) -> Column:
    """Struct (type, score): whether what a page shows fits the purpose of its host."""
    swap = (url_brand != "") & bait(markup).isNotNull() & (url_brand != bait(markup)) & ~canonical
    spoof = (shown_brand != "") & ~canonical & ~F.contains(F.lower(url), shown_brand)
    return F.when(swap, F.struct(F.lit("CLOAKING_CONTENT_SWAP").alias("type"), F.lit(0.15).alias("score"))).when(spoof, F.struct(F.lit("SPOOFED_PORTAL").alias("type"), F.lit(0.20).alias("score"))).otherwise(F.struct(F.lit("MATCH").alias("type"), F.lit(1.0).alias("score")))


def content_brand(text: Column, profiles: Mapping[str, Sequence[str]]) -> Column:
    """Struct (brand, score): the profile with most of its words inside the text's tokens; the brand's own name
    counts 0.4, other words 0.15, at most 1; the first of equals; '' and 0 for none."""
    low = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    rated = []
    for i, (brand, words) in enumerate(profiles.items()):
        score = reduce(lambda a, w: a + F.when(F.contains(low, F.lit(w)), 0.4 if w == brand else 0.15).otherwise(0.0), words, F.lit(0.0))
        rated.append(F.struct(F.round(F.least(F.lit(1.0), score), 4).alias("score"), F.lit(-i).alias("o"), F.lit(brand).alias("brand")))
    best = F.greatest(*rated) if len(rated) > 1 else rated[0]
    return F.transform(F.array(best), lambda b: F.struct(F.when(b["score"] > 0, b["brand"]).otherwise("").alias("brand"), b["score"].alias("score")))[0]
