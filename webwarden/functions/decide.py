"""Fusing the signals of a scan: feature vector, closed-form score, brand, consistency, attribution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

VECTOR = (
    "s_lex entropy url_length domain_length subdomain_depth digit_ratio symbol_count is_ip is_punycode is_suspicious_tld brand_distance brand_similarity is_canonical s_dom s_vis visual_unavailable max_similarity "
    "discrepancy impersonation dns_score ttl_anomaly asn_entropy asn_reputation"
).split()


def sims(s_dom: Column, s_vis: Column) -> tuple[Column, Column, Column]:
    """(dom, vis, unavailable): where either is null the rendering failed, and both count as 0."""
    gone = s_dom.isNull() | s_vis.isNull()
    return F.when(gone, 0.0).otherwise(s_dom), F.when(gone, 0.0).otherwise(s_vis), gone


def dns_group(s_lex: Column, canonical: Column, risky: Column) -> list[Column]:
    """The four DNS features where nothing was observed."""
    hot = risky | (s_lex >= 0.60)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return [
        F.when(canonical, 0.02).when(hot, clip(0.70 * s_lex)).otherwise(0.05), F.when(canonical | ~hot, 0.0).when(s_lex >= 0.70, 1.0).otherwise(0.5), F.when(canonical | ~hot, 0.0).otherwise(clip(0.60 * s_lex)),
        F.when(canonical, 0.02).when(hot, clip(0.65 * s_lex)).otherwise(0.05),
    ]


def fusion_vector(lex: dict[str, Column], s_dom: Column, s_vis: Column) -> dict[str, Column]:
    """The 23 features by name. `lex` gives the thirteen lexical ones, of which is_canonical and is_suspicious_tld are
    booleans."""
    dom, vis, gone = sims(s_dom, s_vis)
    number = lambda c: c.cast("double")
    out = {k: number(lex[k]) for k in VECTOR[:13]}
    impersonation = F.when(lex["is_canonical"], 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.35 * out["s_lex"] + 0.40 * vis + 0.25 * dom)))
    rest = [dom, vis, number(gone), F.greatest(dom, vis), F.abs(dom - vis), impersonation, *dns_group(out["s_lex"], lex["is_canonical"], lex["is_suspicious_tld"])]
    return out | dict(zip(VECTOR[13:], rest))


def closed_form(s_lex: Column, s_dom: Column, s_vis: Column, dns: Column, canonical: Column) -> Column:
    """Score without a model: the guards for official hosts and plain pages, else a weighted sum."""
    dom, vis, _ = sims(s_dom, s_vis)
    return F.when(canonical, 0.02).when((dom == 0) & (vis == 0) & (s_lex <= 0.05), F.round(s_lex, 4)).otherwise(F.round(0.40 * s_lex + 0.30 * vis + 0.18 * dom + 0.12 * dns + 1e-9, 4))


def calibrated(score: Column, s_lex: Column, dom: Column, vis: Column, dns: Column) -> Column:
    """Bounds on a model's score: at most 0.20 where every signal is low, at least 0.85 where two are high."""
    low = (s_lex < 0.05) & (dom < 0.15) & (vis < 0.15) & (dns < 0.20)
    high = (s_lex >= 0.70) & (F.greatest(dom, vis, dns) >= 0.70)
    return F.round(F.when(low, F.least(score, F.lit(0.20))).when(high, F.greatest(score, F.lit(0.85))).otherwise(score), 4)


def group_attribution(impacts: Column) -> Column:
    """Struct (lex, dom, vis, dns): shares of the feature groups in an array of 23 signed impacts."""
    mag = F.transform(impacts, F.abs)
    total = lambda a, n: F.aggregate(F.slice(mag, a + 1, n), F.lit(0.0), lambda s, x: s + x)
    raw = F.struct(total(0, 13).alias("lex"), (mag[13] + 0.25 * mag[17]).alias("dom"), (mag[14] + 0.5 * mag[16] + 0.5 * mag[18]).alias("vis"), total(19, 4).alias("dns"))

    def shares(g: Column) -> Column:
        s = g["lex"] + g["dom"] + g["vis"] + g["dns"]
        part = lambda k: F.when(s > 1e-6, F.round(g[k] / s + 1e-9, 4)).otherwise({"lex": 0.28, "dom": 0.28, "vis": 0.28, "dns": 0.16}[k])
        return F.struct(*[part(k).alias(k) for k in ("lex", "dom", "vis", "dns")])

    return F.transform(F.array(raw), shares)[0]


def consistency(host: Column, brand: Column, vis: Column, dom: Column, official: Column) -> Column:
    """Struct (consistent, phishing, confidence): whether a page that shows a brand stands on one of its hosts.
    `official` is the array of the brand's hosts, null for an unknown brand."""
    shown = F.coalesce((brand != "") & (vis >= 0.25), F.lit(False))
    hosts = F.coalesce(official, F.array(F.concat(brand, F.lit(".com"))))
    own = F.exists(hosts, lambda c: (host == F.lower(c)) | F.endswith(host, F.concat(F.lit("."), F.lower(c))))
    return F.struct(
        (~shown | own).alias("consistent"), (shown & ~own).alias("phishing"), F.when(shown, F.round(F.least(F.lit(1.0), 0.7 * vis + 0.3 * dom) + 1e-9, 4)).otherwise(0.0).alias("confidence")
    )


def elevated(score: Column, steps: Sequence[tuple[Column, str, Column]]) -> Column:
    """A score after ordered steps (condition, kind, value); order matters, since sums do not commute with floors. "floor"
    raises to the value, "add" adds it, "cap" lowers to it, and "blend" takes the value and 0.30 of the score if that is
    more. The result stays in [0, 1]. The steps are folded as data, so the expression grows with their number only."""
    kinds = ["floor", "add", "cap", "blend"]
    items = F.array(*[F.struct(F.coalesce(c, F.lit(False)).alias("c"), F.lit(kinds.index(k)).alias("k"), F.coalesce(v, F.lit(0.0)).cast("double").alias("v")) for c, k, v in steps])

    def step(s: Column, x: Column) -> Column:
        new = F.when(x["k"] == 0, F.greatest(s, x["v"])).when(x["k"] == 1, s + x["v"]).when(x["k"] == 2, F.least(s, x["v"])).otherwise(F.greatest(s, 0.30 * s + x["v"]))
        return F.when(x["c"], F.least(F.lit(1.0), new)).otherwise(s)

    return F.aggregate(items, score.cast("double"), step)


# The elevations of a score in their order: signal, kind, value, and whether official hosts get it too. "floor" raises
# to the value, "add" adds the value, "scale" adds that part of the signal, "gain" adds the signal, "blend" mixes it in with that weight,
# "lex" raises to the lexical score if that reaches the value.
ELEVATIONS = [
    ("inconsistent", "floor", 0.85, False),
    ("kit", "floor", 0.90, False),
    ("redirect_boost", "gain", 1.0, False),
    ("relay_boost", "gain", 1.0, True),
    ("qr_lure", "add", 0.30, False),
    ("form_mismatch", "floor", 0.85, False),
    ("formless_secret", "floor", 0.85, False),
    ("exfiltration", "floor", 0.90, False),
    ("fake_window", "floor", 0.92, False),
    ("anchor_discrepancy", "floor", 0.88, False),
    ("unhandled_form", "floor", 0.82, False),
    ("dead_links", "add", 0.20, False),
    ("hidden_text", "add", 0.25, False),
    ("content_swap", "floor", 0.85, True),
    ("cloaked", "lex", 0.35, True),
    ("url_ensemble", "blend", 0.70, False),
    ("content_risk", "scale", 0.15, False),
    ("content_brand", "floor", 0.80, False),
]
#: What the two model scores must reach to count, and what an official host's score is held below.
ENSEMBLE_FROM, CONTENT_FROM, OFFICIAL_MOST = 0.70, 0.60, 0.05


def threat_score(score: Column, canonical: Column, s_lex: Column, signals: Mapping[str, Column]) -> Column:
    """A score after the elevations of ELEVATIONS, in their order. Signals are flags, or numbers for the two boosts and
    the two model scores; one that is not given, or null, is not there. The result stays in [0, 1]; that of an official
    host stays at OFFICIAL_MOST or below."""
    unknown = set(signals) - {name for name, *_ in ELEVATIONS}
    if unknown:
        raise ValueError(f"no such signals: {sorted(unknown)}")
    canonical, s_lex = F.coalesce(canonical, F.lit(False)), F.coalesce(s_lex, F.lit(0.0))
    steps = []
    for name, kind, value, official_too in ELEVATIONS:
        if name not in signals:
            continue
        signal = signals[name]
        if kind in ("gain", "scale", "blend"):
            number = F.coalesce(signal, F.lit(0.0))
            there = (number > 0) & (number >= {"gain": 0.0, "scale": CONTENT_FROM, "blend": ENSEMBLE_FROM}[kind])
            step = ("blend" if kind == "blend" else "add", value * number)
        else:
            there = F.coalesce(signal, F.lit(False)) & ((s_lex >= value) if kind == "lex" else F.lit(True))
            step = ("add", F.lit(value)) if kind == "add" else ("floor", s_lex if kind == "lex" else F.lit(value))
        steps.append((there if official_too else there & ~canonical, *step))
    return elevated(score, [*steps, (canonical, "cap", F.lit(OFFICIAL_MOST))])


def synchronised(brand: Column, dom: Column, vis: Column) -> tuple[Column, Column]:
    """(dom, vis): what page and image say once the brand is settled. Without a brand they say nothing; with one, a score
    that is missing is 0.40 for the page and 0.50 for the image."""
    none = F.coalesce(brand, F.lit("")) == ""
    own = lambda c, usual: F.when(none, 0.0).when(F.coalesce(c, F.lit(0.0)) > 0, c).otherwise(usual)
    return own(dom, 0.40), own(vis, 0.50)


def importance(values: Column, impacts: Column, names: Sequence[str] = VECTOR) -> Column:
    """Array of structs (feature, value, impact, direction) of the signed impacts of a vector's features, the greatest
    magnitude first and of equals the earlier feature."""
    listed = F.array(*[F.lit(n) for n in names])
    rows = F.transform(F.arrays_zip(values.alias("v"), impacts.alias("x"), listed.alias("n")), lambda r, i: F.struct((-F.abs(F.round(r["x"], 4))).alias("o"), i.alias("i"), r.alias("r")))
    return F.transform(
        F.array_sort(rows),
        lambda s: F.struct(s["r"]["n"].alias("feature"), F.round(s["r"]["v"], 4).alias("value"), F.round(s["r"]["x"], 4).alias("impact"), F.when(s["r"]["x"] > 0, "ELEVATES RISK").otherwise("BENIGN ANCHOR").alias("direction")),
    )
