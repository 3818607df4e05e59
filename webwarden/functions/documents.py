"""Whole documents in one parser pass: texts of elements with all they hold, fingerprints of the layout, one row a page."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from webwarden.functions import html as h
from webwarden.functions.urls import content_url_measures

# Elements whose text is no text of the elements around them, what makes a link visible without text,
# and elements whose blank text is kept as it is.
QUIET = frozenset("script style template rt rp".split())
GRAPHICS = frozenset("img svg i span".split())
VERBATIM = frozenset(("pre", "textarea"))
# Elements that add their text to the semantic text, if it has at most so many characters.
SPEAKING = frozenset("button a h1 h2 h3 p span div".split())
SHORT = 120
# Elements that are no part of a layout, and elements that end a path though they hold others.
UNSEEN = frozenset("script style meta link noscript svg path defs clippath head title".split())
ENDS = frozenset("form input button iframe".split())

# Names that deceptive links show, endings of hosts of abused scripts, sign-in hosts that fake windows
# show, styles that hide text, and elements whose insides are no visible text.
LURES = "paypal google microsoft apple amazon netflix chase bankofamerica wellsfargo citibank dhl fedex ups usps adobe docusign dropbox facebook instagram linkedin coinbase binance metamask steam spotify ebay".split()
ABUSED = tuple(".tk .xyz .top .ru .buzz .live .cc .icu .cfd .monster .work .shop .fit .rest".split())
SIGN_IN_HOSTS = ["login.microsoftonline.com", "accounts.google.com", "appleid.apple.com", "auth.paypal.com", "id.sonyentertainmentnetwork.com"]
HIDING = re.compile(r"(?i)font-size\s*:\s*0|display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0|(?:left|top|text-indent)\s*:\s*-[0-9]{3,}|transform\s*:\s*scale\(0\)|max-(?:height|width)\s*:\s*0")
INVISIBLE = frozenset("script style noscript svg defs clippath template".split())
ZERO_WIDTH = re.compile("[\u200b-\u200f\ufeff\u00ad\u2060\u180e]")
HOST_TEXT = re.compile(r"[a-z0-9_\-.]\.(?:com|org|net|gov|edu|io|co|uk|de|xyz|top)")
RESOURCES = {"img": "src", "script": "src", "link": "href", "source": "src", "iframe": "src"}


class Document(h._Nodes):
    """The nodes of a page, and for each its begin and end as (texts, characters, graphics, passwords) seen until then.
    `said` has the stripped texts in order; text between two tags or comments is one."""

    def __init__(self, markup: str) -> None:
        super().__init__()
        self.said: list[str] = []
        self.owners: list[int] = []
        self.begin: list[tuple[int, ...]] = []
        self.end: list[tuple[int, ...]] = []
        self.quiet: list[bool] = []
        self.coded = self.commented = 0
        self.alarms = False
        self._seen = [0, 0, 0]
        self._data: list[str] = []
        self.feed(markup)
        self.close()
        self._flush()
        self._ends(self.open)

    def _at(self) -> tuple[int, ...]:
        return (len(self.said), *self._seen)

    def _ends(self, closed: Sequence[int]) -> None:
        for i in closed:
            self.end[i] = self._at()

    def _flush(self) -> None:
        if not self._data:
            return
        data, self._data = "".join(self._data), []
        inside = self.open[-1] if self.open else -1
        if not data.strip() and not any(self.nodes[i][3] in VERBATIM for i in self.open):
            data = "\n" if "\n" in data else " "
        if inside >= 0 and self.nodes[inside][3] in ("script", "style"):
            self.coded += len(data)
            self.alarms |= self.nodes[inside][3] == "script" and ("alert" in data or "window.open" in data)
        if inside < 0 or not self.quiet[inside]:
            self._seen[0] += len(data)
            if data.strip():
                self.said.append(data.strip())
                self.owners.append(inside)

    def handle_starttag(self, tag, attrs):
        self._flush()
        parent = self.open[-1] if self.open else -1
        self.quiet.append(tag in QUIET or (parent >= 0 and self.quiet[parent]))
        self.begin.append(self._at())
        super().handle_starttag(tag, attrs)
        self._seen[1] += tag in GRAPHICS
        self._seen[2] += tag == "input" and self.nodes[-1][4].get("type", "").lower() == "password"
        self.end.append(self._at())

    def handle_endtag(self, tag):
        self._flush()
        before = list(self.open) if any(self.nodes[i][3] == tag for i in self.open) else self.open
        super().handle_endtag(tag)
        self._ends(before[len(self.open) :])

    def handle_data(self, data):
        self._data.append(data)

    def handle_comment(self, data):
        self._flush()
        self.commented += len(data)

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()

    @property
    def characters(self) -> int:
        return self._seen[0]

    def find(self, *tags: str) -> list[tuple[int, dict[str, str]]]:
        """(node, attributes) of the elements of these names, in document order."""
        return [(i, n[4]) for i, n in enumerate(self.nodes) if n[3] in tags]

    def text(self, i: int) -> str:
        return "".join(self.said[self.begin[i][0] : self.end[i][0]])

    def short_text(self, i: int) -> str:
        """The whole text of an element, or '' if it is longer than SHORT."""
        length, out = 0, []
        for s in self.said[self.begin[i][0] : min(self.end[i][0], self.begin[i][0] + SHORT + 1)]:
            length += len(s)
            if length > SHORT:
                return ""
            out.append(s)
        return "".join(out)


def per_page(df: DataFrame, id_col: str, markup_col: str, extras: Sequence[Column], schema: pa.Schema, one: Callable[..., tuple]) -> DataFrame:
    """(page_id, *schema): what `one` says of each document and its extra columns, in one pass without shuffle; null
    and empty documents give no row."""
    full = pa.schema([("page_id", pa.int64()), *schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(rid, *one(Document(m), m, *more)) for rid, m, *more in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(full)], schema=full)

    source = df.filter(F.length(markup_col) > 0).select(F.col(id_col).cast("bigint").alias("page_id"), F.col(markup_col).alias("m"), *[c.alias(f"e{i}") for i, c in enumerate(extras)])
    return source.mapInArrow(run, from_arrow_schema(full))


def seen_text(doc: Document, markup: str) -> tuple[str, bool]:
    """(text, obfuscated): what a reader sees. An element that is invisible by its name, the attributes hidden or
    aria-hidden, or its style hides all that it holds; zero-width characters go, and spaces are collapsed. obfuscated
    tells whether the page has a zero-width character anywhere, or a style that hides."""
    hidden: list[bool] = []
    styled = False
    for parent, _, _, tag, attrs, _ in doc.nodes:
        above = parent >= 0 and hidden[parent]
        by_style = not above and tag not in INVISIBLE and bool(HIDING.search(attrs.get("style", "")))
        styled |= by_style
        hidden.append(above or by_style or tag in INVISIBLE or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true")
    text = " ".join(t for t, i in zip(doc.said, doc.owners) if i < 0 or not hidden[i])
    return " ".join(ZERO_WIDTH.sub("", text).split()), styled or bool(ZERO_WIDTH.search(markup))


def seen_texts(df: DataFrame, id_col: str, markup_col: str) -> DataFrame:
    """(page_id, text, obfuscated) of each page: see seen_text."""
    return per_page(df, id_col, markup_col, [], pa.schema([("text", pa.string()), ("obfuscated", pa.bool_())]), seen_text)


def spoken(doc: Document, visible: str) -> str:
    """What a page says and names: its whole visible text, then title, form targets, input names and hints, image
    descriptions, and once more the elements with short texts, in lower case."""
    title = [doc.text(i) for i, _ in doc.find("title")[:1]]
    parts = [visible or "", *title, *[a.get("action", "") for _, a in doc.find("form")]]
    for names, keys in (("input", ("name", "placeholder")), ("img", ("alt", "src"))):
        parts += [" ".join(a.get(k, "") for k in keys) for _, a in doc.find(names)]
    parts += [doc.short_text(i) for i, _ in doc.find(*SPEAKING)]
    return " ".join(p for p in map(str.strip, parts) if p).lower()


def spoken_texts(df: DataFrame, id_col: str, markup_col: str) -> DataFrame:
    """(page_id, text) of the pages that say anything."""
    out = per_page(df, id_col, markup_col, [], pa.schema([("text", pa.string())]), lambda doc, m: (spoken(doc, seen_text(doc, m)[0]),))
    return out.filter("text <> ''")


def layout_tags(doc: Document) -> list[str]:
    """Names of the elements of the layout in order; an input's name carries its type."""
    return [f"input_{(n[4].get('type') or 'text').lower()}" if n[3] == "input" else n[3] for n in doc.nodes if n[3] not in UNSEEN]


def layout_paths(doc: Document, depth: int = 6) -> list[str]:
    """Paths of the layout from the body, or from the document if it has none, at leaves and form elements."""
    body = next((i for i, n in enumerate(doc.nodes) if n[3] == "body"), -1)
    holding = {n[0] for n in doc.nodes}
    at: dict[int, tuple[str, int] | None] = {} if body >= 0 else {-1: ("html>[document]", 1)}
    out = [] if body >= 0 or -1 in holding else ["html>[document]"]
    for i, (parent, _, _, tag, attrs, _) in enumerate(doc.nodes):
        up = ("html", 0) if i == body else at.get(parent)
        if up is None or tag in UNSEEN or up[1] >= depth:
            continue
        name = f"input_{attrs.get('type', 'text').lower()}" if tag == "input" else tag
        at[i] = (f"{up[0]}>{name}", up[1] + 1)
        if i not in holding or tag in ENDS:
            out.append(at[i][0])
    return out


@lru_cache(maxsize=1 << 15)
def _votes(feature: str) -> np.ndarray:
    """A vote of +1 or -1 for each of the leading 64 bits of the MD5, the highest first."""
    return np.unpackbits(np.frombuffer(hashlib.md5(feature.encode("utf-8", "replace")).digest()[:8], np.uint8)).astype(np.int64) * 2 - 1


def layout_fingerprint(paths: Sequence[str], tags: Sequence[str]) -> int:
    """64-bit vote of the paths, three times as heavy if they hold a form or an input, and of the pairs of tags; 0 for none."""
    weights: Counter[str] = Counter()
    for p in paths:
        weights[p] += 3 if "form" in p or "input" in p else 1
    weights.update(f"{a}_{b}" for a, b in zip(tags, tags[1:]))
    if not weights:
        return 0
    total = sum(_votes(f) * w for f, w in weights.items())
    return int.from_bytes(np.packbits(total > 0).tobytes(), "big")


def layout_fingerprints(df: DataFrame, id_col: str, markup_col: str) -> DataFrame:
    """(page_id, fingerprint): sixteen hexadecimal digits; zeros for a blank page."""
    one = lambda doc, m: (f"{layout_fingerprint(layout_paths(doc), layout_tags(doc)) if m.strip() else 0:016x}",)
    return per_page(df, id_col, markup_col, [], pa.schema([("fingerprint", pa.string())]), one)


class Layout:
    """What one page is compared by: tags, their sets and counts, fingerprint, and the topology of its forms."""

    def __init__(self, doc: Document, markup: str, topology: Mapping) -> None:
        self.markup, self.tags = markup, layout_tags(doc)
        self.sets = [set(zip(*(self.tags[i:] for i in range(n)))) for n in (1, 2, 3)]
        self.counts = Counter(self.tags)
        self.norm = sum(v * v for v in self.counts.values())
        self.fingerprint = layout_fingerprint(layout_paths(doc), self.tags)
        self.forms = tuple(topology[k] for k in ("forms", "passwords", "submits"))

    def similarity(self, other: Layout) -> float:
        """1 for equal pages, 0 if one is blank or has no tags, else the fused similarity of tags, counts, fingerprints and forms."""
        if not self.markup.strip() or not other.markup.strip():
            return 0.0
        if self.markup == other.markup:
            return 1.0
        if not self.tags or not other.tags:
            return 0.0
        tags = sum(w * (len(a & b) / len(a | b) if a or b else 0.0) for w, a, b in zip((0.30, 0.45, 0.25), self.sets, other.sets))
        cosine = sum(v * other.counts[k] for k, v in self.counts.items()) / (self.norm**0.5 * other.norm**0.5)
        bits = round(1 - (self.fingerprint ^ other.fingerprint).bit_count() / 64, 4) if self.fingerprint and other.fingerprint else 0.0
        forms = 1.0 if self.forms == other.forms else 0.5 if self.forms[1] > 0 and other.forms[1] > 0 else 0.2
        return round(0.30 * tags + 0.15 * cosine + 0.30 * bits + 0.25 * forms, 4)


def signature_score(text: str, signatures: Sequence[str]) -> float:
    """What a text says of a brand: 0.45 for each signature of several words or a host, 0.25 for others; from 0.5 to 1 if any is there."""
    found = [0.45 if " " in s or "." in s else 0.25 for s in signatures if s in text]
    return min(1.0, max(0.50, sum(found))) if found else 0.0


def best_reference(layout: Layout, text: str, references: Sequence[tuple[str, Sequence[str], Layout]]) -> tuple[float, str | None]:
    """(score, brand) of the best reference, the first of equals; 0 and null below 0.35."""
    said = [signature_score(text, signatures) for _, signatures, _ in references]
    named, best, brand = sum(s > 0 for s in said), 0.0, None
    for s, (name, _, reference) in zip(said, references):
        alike = layout.similarity(reference)
        score = min(1.0, round(0.55 * s + 0.45 * alike, 4) + 0.20) if s > 0 else round(alike * 0.25, 4) if named else alike
        if score > best:
            best, brand = score, name
    return (best, brand) if best >= 0.35 else (0.0, None)


def _host_of(url: str) -> str:
    """Host of an absolute URL or one without scheme, '' for others."""
    m = re.match(r"(?:https?:)?//([^/?#]*)", url)
    return m[1].split(":")[0].lower() if m else ""


def audit(doc: Document, markup: str, own: str | None, official: Sequence[str] | None) -> tuple:
    """(links, null, internal, external, empty shares, discrepancies, external resource share, favicon mismatch,
    foreign scripts, techniques, highlights) of a page on the host `own` that shows a brand of the official hosts."""
    own, canon, low = own or "", {x.lower() for x in official or ()}, markup.lower()
    foreign = lambda there: bool(there) and there != own and there not in canon
    count = {"null": 0, "internal": 0, "external": 0, "empty": 0}
    links, deceptive, examples = doc.find("a"), 0, []
    for i, attrs in links:
        href, said = attrs.get("href", "").strip(), doc.begin[i][0] < doc.end[i][0]
        count["empty"] += not said and doc.begin[i][2] == doc.end[i][2]
        if href.lower() in h.NULL_LINKS:
            count["null"] += 1
            continue
        there = _host_of(href)
        count["internal" if not there or there == own or own.endswith("." + there) or there in canon else "external"] += 1
        if foreign(there) and not there.endswith(tuple(LURES)):
            text = doc.text(i).lower()
            if HOST_TEXT.search(text) or any(b in text for b in LURES):
                deceptive += 1
                if len(examples) < 3:
                    examples.append(f"  • Anchor text '{text[:40]}' deceptively routes to external host '{there}'")
    shares = {k: round(v / len(links), 4) if links else 0.0 for k, v in count.items()}
    sources = [v for tag, key in RESOURCES.items() for _, a in doc.find(tag) if (v := a.get(key, "")) and not v.startswith(("data:", "blob:", "#"))]
    away = round(sum(foreign(_host_of(v.strip())) for v in sources) / len(sources), 4) if sources else 0.0
    favicon = any("icon" in a.get("rel", "").lower() and foreign(_host_of(a.get("href", "").strip())) for _, a in doc.find("link"))
    scripts = [v for _, a in doc.find("script") if (v := a.get("src", "")).startswith(("http://", "https://")) and canon and (there := _host_of(v)) not in canon and own not in there and there.endswith(ABUSED)]

    actions = [(a.get("action", "").strip(), doc.begin[i][3] < doc.end[i][3]) for i, a in doc.find("form")]
    mismatch = any(foreign(_host_of(x)) for x, _ in actions if x.lower() not in h.NULL_LINKS)
    unhandled = any(secret and x.lower() in h.NULL_LINKS for x, secret in actions)
    outside = sum(a.get("type", "").lower() == "password" and doc.nodes[i][2] < 0 for i, a in doc.find("input"))
    shown = [((a.get("value") or doc.text(i)).lower(), "lock" in a.get("class", "").split()) for i, a in doc.find("input", "div", "span", "p")] if any(x in low for x in SIGN_IN_HOSTS) else []
    window = any(w in low for w in h.FAKE_WINDOW) or any(x in t and (lock or "http://" in t or "https://" in t) for t, lock in shown for x in SIGN_IN_HOSTS)
    packed = low.replace(" ", "")
    no_click = any(w in low or w.replace(" ", "") in packed for w in h.NO_RIGHT_CLICK)
    hooks = list(dict.fromkeys([m[0] for m in re.finditer(h.HOOK, markup)] + [m[1] for m in re.finditer(h.DROP_FILE, markup)]))
    unseen: list[bool] = []
    for n in doc.nodes:
        unseen.append(n[3] in INVISIBLE or (n[0] >= 0 and unseen[n[0]]))
    hidden = {(n[3], style.strip()) for n, u in zip(doc.nodes, unseen) if not u and HIDING.search(style := n[4].get("style", ""))}
    decoys = len(hidden) + bool(ZERO_WIDTH.search(markup))
    shadow = any(w in markup for w in h.SHADOW) or any("-" in n[3] and n[3] != "annotation-xml" for n in doc.nodes)
    overlay = any(w in a.get("style", "").lower() for _, a in doc.find("iframe") for w in ("opacity: 0", "opacity:0", "z-index: 999", "position: absolute"))
    findings = [
        (mismatch, "T1056.001 (Credential Harvester Action Mismatch)", ["Credential Exfiltration Vector: Form action submits authentication payloads to mismatched external host."]),
        (unhandled, "T1056.001 (Server Form Handler Mismatch)", ["Server Form Handler (SFH) Anomaly: Credential input form lacks a valid server action handler (empty/placeholder destination)."]),
        (outside, "T1056.004 (Input Capture: Formless Credential Interception)", [f"Formless Credential Harvesting: Detected {outside} password input(s) rendered outside standard <form> wrappers."]),
        (window, "T1185 (Browser-in-the-Browser False Authentication Window)", ["Browser-in-the-Browser (BiTB): Simulated desktop browser UI / OAuth modal detected mimicking legitimate SSO providers."]),
        (deceptive, "T1566.002 (Spearphishing Link: Anchor Text Discrepancy)", [f"Anchor Text Deception: Detected {deceptive} hyperlink(s) displaying legitimate brand names that route to external target hosts.", *examples]),
        (shares["null"] > 0.40 and len(links) >= 3, "T1566.002 (Dead Navigation Template)", [f"Null Hyperlink Density: {shares['null'] * 100:.0f}% of anchor tags are dead/placeholder links (#, javascript:void(0)), characteristic of cloned phishing kits."]),
        (away > 0.60, None, [f"External Resource Dependency: {away * 100:.0f}% of images/scripts/stylesheets are hotlinked from external origins (CANTINA+ heuristic)."]),
        (favicon, None, ["Favicon Origin Mismatch: Site favicon is loaded from an external third-party domain."]),
        (no_click, "T1027 (Defense Evasion: Disabled Right-Click)", ["Anti-Analysis Evasion: Right-click / context menu has been programmatically disabled to obstruct source code review."]),
        (any(w in low for w in h.NO_SELECTION), None, ["Anti-Analysis Evasion: Text selection / copy has been disabled via inline events or CSS user-select."]),
        (hooks, "T1020 (Automated Exfiltration: Webhook / C2 Drop)", [f"Direct Exfiltration Hooks: Discovered {len(hooks[:3])} C2/Webhook endpoints ({', '.join(hooks[:3])})."]),
        (decoys, "T1027.006 (HTML Steganography / Zero-Font Evasion)", [f"Zero-Font / CSS Text Obfuscation: Stripped {decoys} hidden zero-pixel/off-screen decoy spans."]),
        (shadow, "T1027 (Defense Evasion: Encapsulated Shadow DOM)", ["Shadow DOM / Custom Components: Nested web components traversed to expose encapsulated authentication nodes."]),
        (overlay, "T1204.001 (User Execution: Clickjacking Overlay)", ["Clickjacking Overlay: Hidden or zero-opacity iframe structure detected over viewport."]),
        (scripts, "T1059.007 (JavaScript Execution from Untrusted Source)", [f"External Script Ingestion: Detected {len(scripts)} script(s) loaded from suspicious abuse TLDs."]),
    ]
    techniques = dict.fromkeys(t for hit, t, _ in findings if hit and t)
    highlights = [x for hit, _, xs in findings if hit for x in xs] or ["DOM structures and form action endpoints exhibit normal layout patterns."]
    return len(links), *shares.values(), deceptive, away, favicon, scripts, " / ".join(techniques) or "N/A", highlights


AUDIT = pa.schema([
    ("links", pa.int32()), *[(f"{k}_share", pa.float64()) for k in ("null", "internal", "external", "empty")], ("anchor_discrepancies", pa.int32()), ("external_resource_share", pa.float64()), ("favicon_mismatch", pa.bool_()),
    ("foreign_scripts", pa.list_(pa.string())), ("techniques", pa.string()), ("highlights", pa.list_(pa.string())),
])


def page_audit(df: DataFrame, id_col: str, markup_col: str, own: Column, official: Column) -> DataFrame:
    """One row per page, with links or without: see audit."""
    return per_page(df, id_col, markup_col, [own, official], AUDIT, audit)


EMPTY_LINKS = frozenset(["", "#", "#javascript::void(0)", "#content", "#skip", "javascript:;", "javascript::void(0);", "javascript::void(0)", "javascript:void(0)", "javascript:void(0);"])
COMMON_LABELS = frozenset("com net org www http https html".split())
CONTENT = ["internal_link", "external_link", "empty_link", "login_form", "html_len_tag", "html_len", "alarm_window", "redirection", "hidden", "title_domain", "brand_domain", "internal_resource", "external_resource", "domain_occurrence"]


def _content_host(url: str) -> str:
    """Host of a URL; what has no scheme is taken as one that begins with its host."""
    m = re.match(r"(?:https?://)?([^/?#]*)", url)
    return m[1].split(":")[0].lower() if m else ""


def content_features(doc: Document, markup: str, url: str | None) -> dict[str, int]:
    """Fourteen measures of a page's content against its own host."""
    own, low = _content_host(url or ""), markup.lower()
    hrefs = [v for _, a in doc.find("a") if (v := a.get("href", ""))]
    away = lambda u: "http" in u and _content_host(u) != own
    outer = sum(map(away, hrefs))
    resources = [v for tag, key in (("link", "href"), ("img", "src"), ("script", "src"), ("noscript", "src")) for _, a in doc.find(tag) if (v := a.get(key, ""))]
    foreign = sum(map(away, resources))
    login = any(a.get("name") and doc.nodes[i][2] >= 0 and any(w in a["name"].lower() for w in ("pass", "login", "signin")) for i, a in doc.find("input"))
    hidden = any("visibility:hidden" in a.get("style", "") or "display:none" in a.get("style", "") for _, a in doc.find("div")) or any(a.get("disabled") == "disabled" for _, a in doc.find("button", "input")) or any(a.get("type") == "hidden" for _, a in doc.find("input"))
    title = " ".join(doc.text(i) for i, _ in doc.find("title")[:1]).lower()
    labels = [x for x in own.split(".") if len(x) >= 3 and x not in COMMON_LABELS]
    linked = Counter(_content_host(u) if "http" in u else own for u in hrefs)
    forms = sum(doc.end[i][1] - doc.begin[i][1] for i, _ in doc.find("form"))
    values = (
        len(hrefs) - outer, outer, sum(u.strip().lower() in EMPTY_LINKS for u in hrefs), login, doc.coded + forms + doc.commented, doc.characters, doc.alarms, "redirect" in low[:5000], hidden, bool(own) and (own in title or any(x in title for x in labels)),
        not linked or linked.most_common(1)[0][0] == own, len(resources) - foreign, foreign, low.count(own) if own else 0,
    )
    return dict(zip(CONTENT, map(int, values)))


def content_score(markup: str, page: Mapping[str, int], url: Mapping[str, int]) -> float:
    """Share of the weighted signals of a URL (of 11), and of a page of more than 50 characters too (of 23)."""
    hits = 2 * url["domain_is_ip"] + url["sensitive_word"] + (not url["https"]) + (url["domain_len"] > 30) + (url["url_len"] > 75) + (url["num_dot_hostname"] > 3) + 2 * url["tld_in_domain"] + url["tld_in_path"] + (url["symbol_count"] > 2)
    if len(markup) <= 50:
        return round(hits / 11, 4)
    hits += 2 * (page["external_link"] > max(3, page["internal_link"])) + 2 * (page["empty_link"] > 3) + page["login_form"] + page["alarm_window"] + page["redirection"] + page["hidden"]
    hits += (not page["title_domain"]) + 2 * (not page["brand_domain"]) + (page["external_resource"] > page["internal_resource"])
    return round(hits / 23, 4)


def content_model(df: DataFrame, id_col: str, markup_col: str, url: Column) -> DataFrame:
    """(page_id, fourteen measures, score) of each page."""

    def one(doc: Document, markup: str, address: str | None, measures: Mapping) -> tuple:
        page = content_features(doc, markup, address)
        if len(markup) <= 50:
            page = dict.fromkeys(CONTENT, 0) | {"brand_domain": 1}
        return *page.values(), content_score(markup, page, measures)

    measures = F.struct(*[F.coalesce(c, F.lit(0)).alias(k) for k, c in content_url_measures(url).items()])
    return per_page(df, id_col, markup_col, [url, measures], pa.schema([*[(k, pa.int32()) for k in CONTENT], ("score", pa.float64())]), one)
