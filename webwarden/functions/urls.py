"""URL features as column expressions: parts, entropy, brand proximity, lexical score, 79 lexical measures.

Functions take and return columns, so they run inside whole-stage projections over the scan; brand proximity alone
goes by way of a table of distinct tokens. Null URLs give null or zero features and never fail.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webwarden.functions.skew import lookup_join
from webwarden.session import materialize

# Top-level names with much abuse, and second-level names under which registries sell.
RISKY_TLDS = (
    "tk ml ga cf gq xyz top work buzz online site icu monster club info cfd sbs rest fit cc ws country stream gdn mom cam kim vip click link surf casa bar lat live space support".split()
)
SECOND_LEVEL = "com co net org gov edu ac info xyz top shop online live site".split()
# Stems of security words with their weights, in the order in which they are tried.
STEM_WEIGHTS = {
    "verif": 0.35, "secur": 0.30, "login": 0.35, "signin": 0.35, "updat": 0.25, "auth": 0.30, "servic": 0.20, "protect": 0.25, "bank": 0.35, "portal": 0.20, "account": 0.30, "confirm": 0.30, "session": 0.25,
    "support": 0.20, "recover": 0.25, "pass": 0.25, "token": 0.30, "webscr": 0.40, "ebayisapi": 0.40, "wallet": 0.35, "billing": 0.30, "unlock": 0.35, "alert": 0.25, "valid": 0.25, "help": 0.15,
}
# Endings that the stemmer removes, the first that fits.
STEM_ENDINGS = "ication action ization ement ities ingly ating ation ments ness ity ous ing ers ies ied ed es ly er or al s".split()
# Words, extensions and marks that the 79 measures count.
SENSITIVE_14 = "login signin update secure bank account verify password confirm auth admin wallet support billing".split()
SENSITIVE_8 = "secure account webscr login signin ebayisapi banking confirm".split()
EXECUTABLE = "exe bat cmd sh vbs js msi".split()
SPECIAL_MARKS = r"""!@#$%^&*()_+=-[]{}|;:'",.<>?/\\"""
COMMON_TLDS = (
    "com net org info biz xyz top club online site store live tech space fun icu buzz shop work pro cloud host website press cc tk ml ga cf gq co io me us de uk ru cn br in au ca fr it nl jp es se no fi".split()
)
# Link shorteners and parameters that carry a redirect target.
SHORTENERS = "bit.ly tinyurl.com t.co is.gd buff.ly ow.ly rebrand.ly cutt.ly shorturl.at linktr.ee qr.ae v.gd t.me".split()
TARGET_PARAMS = "q url target redirect dest next link".split()


def authority(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^(?:https?://)?([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Host without port; case as written."""
    return F.split_part(authority(url), F.lit(":"), F.lit(1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^(?:https?://)?[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: written out, each use would repeat its expression, and expressions
    that build on each other would grow with every step."""
    return F.transform(F.array(value), use)[0]


def suffix(name: Column) -> Column:
    """Public suffix by rule: the last label, with the one before it if registries sell under that; '' for bare
    names and addresses."""
    two = F.regexp_extract(name, rf"\.((?:{'|'.join(SECOND_LEVEL)})\.[^.]+)$", 1)
    return F.when(is_ipv4(name), "").otherwise(bound(two, lambda t: F.when(t != "", t).otherwise(F.regexp_extract(name, r"\.([^.]+)$", 1))))


def registered(name: Column) -> Column:
    """Suffix and the label before it; the name itself where there is no suffix."""

    def joined(s: Column) -> Column:
        rest = F.substring(name, F.lit(1), F.length(name) - F.length(s) - 1)
        return F.when(s == "", name).otherwise(F.concat(F.regexp_extract(rest, r"([^.]*)$", 1), F.lit("."), s))

    return bound(suffix(name), joined)


def subdomain(name: Column) -> Column:
    return bound(registered(name), lambda r: F.when(F.length(name) > F.length(r), F.substring(name, F.lit(1), F.length(name) - F.length(r) - 1)).otherwise(""))


def is_ipv4(text: Column) -> Column:
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return text.rlike(rf"^{octet}(?:\.{octet}){{3}}$")


def is_ip(text: Column) -> Column:
    """IPv4 or IPv6 address, bracketed or with a port."""
    t = F.trim(text)
    bare = F.regexp_replace(F.regexp_replace(t, r"^\[(.*)\]:\d+$", "$1"), r"^\[|\]$", "")
    v4 = F.when(bare.rlike(r"^[^:]+:\d+$"), F.split_part(bare, F.lit(":"), F.lit(1))).otherwise(bare)
    group = r"[0-9A-Fa-f]{1,4}"
    full = bare.rlike(rf"^{group}(?::{group}){{7}}$")
    short = bare.rlike(rf"^(?:{group}(?::{group}){{0,6}})?::(?:{group}(?::{group}){{0,6}})?$") & (F.size(F.split(bare, ":")) <= 9)
    return F.coalesce(is_ipv4(v4) | full | short, F.lit(False))


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"))


def _entropy_of_parts(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p)) + F.lit(0.0)


def entropy_of(items: Column) -> Column:
    """Shannon entropy, in bits, of the elements of an array; 0 for an empty one."""
    parts = lambda xs: F.transform(F.array_distinct(xs), lambda c: F.size(F.filter(xs, lambda x: x == c)) / F.size(xs))
    return F.when(F.size(items) > 0, _entropy_of_parts(bound(items, parts))).otherwise(F.lit(0.0))


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters: each distinct one is counted by what its removal takes away."""
    t = F.coalesce(text, F.lit(""))
    parts = lambda x: F.transform(F.array_distinct(characters(x)), lambda c: (F.length(x) - F.length(F.replace(x, c, F.lit("")))) / F.length(x))
    return F.when(F.length(t) > 0, _entropy_of_parts(bound(t, parts))).otherwise(F.lit(0.0))


def bigram_entropy(text: Column) -> Column:
    """Entropy of the distribution of adjacent character pairs; 0 below two characters."""
    t = F.coalesce(text, F.lit(""))
    pairs = F.when(F.length(t) >= 2, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return entropy_of(pairs)


def stem(word: Column) -> Column:
    out = F.when(F.length(word) <= 3, word)
    for e in STEM_ENDINGS:
        out = out.when(F.endswith(word, F.lit(e)) & (F.length(word) >= len(e) + 3), F.substring(word, F.lit(1), F.length(word) - len(e)))
    return out.otherwise(word)


def nlp_risk(url: Column) -> Column:
    """Logistic risk of the security words among a URL's tokens."""
    tokens = F.regexp_extract_all(F.lower(url), F.lit("([a-z0-9]+)"))
    weight = lambda t: reduce(lambda w, k: w.when(F.contains(t, F.lit(k)), STEM_WEIGHTS[k]), STEM_WEIGHTS, F.when(F.lit(False), 0.0)).otherwise(0.0)
    hits = F.filter(F.transform(F.transform(tokens, stem), weight), lambda w: w > 0)
    z = F.aggregate(hits, F.lit(-2.5), lambda a, w: a + 2.0 * w) + F.when(F.size(hits) >= 2, 0.8 * (F.size(hits) - 1)).otherwise(0.0)
    return F.when(F.size(tokens) > 0, F.round(1 / (1 + F.exp(-F.greatest(F.lit(-10.0), F.least(F.lit(10.0), z)))), 4)).otherwise(F.lit(0.0))


def brand_tokens(name: Column) -> Column:
    """The parts of a host that may spell a brand: domain body, subdomain, their pieces, and the whole host."""
    n = F.lower(name)
    base = F.struct(n.alias("n"), F.split_part(registered(n), F.lit("."), F.lit(1)).alias("body"), subdomain(n).alias("sub"))
    pieces = lambda b: F.concat(F.array(b["body"]), F.split(b["body"], "[-._0-9]"), F.array(b["sub"]), F.split(b["sub"], "[-._0-9]"), F.array(b["n"]))
    return F.array_distinct(F.filter(bound(base, pieces), lambda t: t != ""))


#: Bits of each part of a candidate's code.
_PART = 20


def _near_or_far(code: Column, brands: Sequence[str]) -> Column:
    """Struct (distance, similarity, brand) of a candidate's code; '' and 0 if it is far, or if there is none."""
    distance = F.coalesce(F.shiftright(code, 2 * _PART).cast("int"), F.lit(0))
    longer = (1 << _PART) - 1 - F.shiftright(code, _PART).bitwiseAND((1 << _PART) - 1)
    similarity = F.when(distance == 0, 1.0).otherwise(1 - distance / longer)
    far = ((similarity < 0.6) & (distance > 2)) | code.isNull()
    brand = F.element_at(F.array(*[F.lit(b) for b in brands]), (code.bitwiseAND((1 << _PART) - 1) + 1).cast("int"))
    return F.struct(distance.alias("distance"), F.when(far, 0.0).otherwise(F.round(similarity, 4)).alias("similarity"), F.when(far, "").otherwise(brand).alias("brand"))


def nearest_brands(hosts: DataFrame, brands: Sequence[str]) -> DataFrame:
    """(host, near) of distinct hosts: the struct (distance, similarity, brand) of the brand with the least edit
    distance to any of the host's tokens; then the greatest similarity, then the first brand. The brand is '' and the
    similarity 0 if nothing is near, or the host has no tokens.

    Hosts share tokens, so each distinct token is held against the brands once, in flat rows that run as compiled code.
    A token that a large part of the hosts has is joined by broadcast. `hosts` is read three times: give a table.
    """
    items = F.array(*[F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(b).alias("brand")) for i, b in enumerate(brands)])
    tokens = hosts.select("host", F.explode(brand_tokens(F.col("host"))).alias("token"))
    # Few bytes, but much work for each: adaptive execution would put them into one partition.
    width = int(hosts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("uses")).repartition(width).select("token", "uses", F.explode(items).alias("b"))
    # A candidate is one number, which hash aggregates can take the least of: the distance, then among equal ones the
    # greatest similarity, which is that of the longest, then the place of the brand.
    most = (1 << _PART) - 1
    distance, longer = F.levenshtein("token", "b.brand").cast("bigint"), F.least(F.lit(most), F.greatest(F.length("token"), F.length("b.brand")))
    rated = pairs.select("token", "uses", "b.ord", distance.alias("d"), longer.cast("bigint").alias("longer"))
    code = F.shiftleft("d", 2 * _PART) + F.when(F.col("d") == 0, F.lit(0).cast("bigint")).otherwise(F.shiftleft(most - F.col("longer"), _PART)) + F.col("ord")
    nearest = materialize(rated.groupBy("token", "uses").agg(F.min(code).alias("best")), "tokens")
    of_hosts = lookup_join(tokens, nearest, "token", "uses").groupBy("host").agg(F.min("best").alias("best"))
    return hosts.join(of_hosts, "host", "left").select("host", _near_or_far(F.col("best"), brands).alias("near"))


def lexical_score(name: Column, near: Column, canonical: Column, url: Column) -> Column:
    """Composite score in [0, 1] of a host (lower case) with its nearest brand."""
    parts = F.struct(
        name.alias("name"), subdomain(name).alias("sub"), F.element_at(F.split(suffix(name), r"\."), -1).isin(RISKY_TLDS).alias("risky"), entropy(name).alias("entropy"), near["brand"].alias("brand"), near["distance"].alias("distance"), near["similarity"].alias("similarity"),
        is_ip(name).alias("is_ip"), F.contains(F.lower(url), F.lit("xn--")).alias("puny"),
    )
    add = lambda cond, v: F.when(cond, v).otherwise(0.0)

    def total(p: Column) -> Column:
        sub, brand, risky = p["sub"], p["brand"], p["risky"]
        known = brand != ""
        exact = known & (p["distance"] == 0)
        levels = F.when(sub == "", 0).otherwise(F.size(F.split(sub, r"\.")))
        hyphen = F.contains(p["name"], F.lit("-"))
        masks = known & (F.contains(sub, F.concat(brand, F.lit("."))) | F.startswith(sub, F.concat(brand, F.lit("-"))) | F.endswith(sub, F.concat(F.lit("-"), brand)))
        near_miss = ~exact & p["distance"].between(1, 2) & (F.length(brand) >= 3)
        loose = ~exact & ~near_miss & p["distance"].between(3, 4) & (p["similarity"] >= 0.6)
        digits = F.length(F.regexp_replace(p["name"], "[^0-9]", "")) / F.greatest(F.lit(1), F.length(p["name"]))
        parts = [
            (masks, 0.70), (exact, 0.55), (exact & risky, 0.20), (exact & (hyphen | (levels > 0)), 0.15), (near_miss, 0.60), (near_miss & risky, 0.20), (loose, 0.35), (p["puny"], 0.50), (risky, 0.25), (p["is_ip"], 0.55),
            (p["entropy"] > 3.8, 0.15), (hyphen & ~exact, 0.10), (levels >= 2, 0.15), (digits > 0.15, 0.15),
        ]
        return F.round(F.least(F.lit(1.0), reduce(lambda a, c: a + add(*c), parts, F.lit(0.0))), 4)

    return F.when(canonical, 0.02).otherwise(bound(parts, total))


def verdict(score: Column) -> Column:
    return F.when(score >= 0.65, "phishing").when(score >= 0.35, "suspicious").otherwise("safe")


def url_struct(url: Column) -> Column:
    """The parts that the 79 measures are taken of: url, host, path, query, directory, file and extension, with the
    tokens of host and path and the values of the query."""
    h = F.lower(host(url))
    p = F.regexp_replace(path(url), r";[^/]*$", "")
    p = F.when(p == "", "/").otherwise(p)
    last = F.regexp_extract(p, r"([^/]+)/*$", 1)
    file = F.when(F.contains(last, F.lit(".")), last).otherwise("")
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    folder = F.when(file != "", F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)), "/")).otherwise(p)
    q = query(url)
    pairs = F.when(q == "", F.array().cast("array<string>")).otherwise(F.split(q, "&"))
    return F.struct(
        url.alias("url"), h.alias("host"), p.alias("path"), q.alias("query"), folder.alias("folder"), file.alias("file"), F.regexp_extract(file, r"([^.]*)$", 1).alias("ext"),
        F.filter(F.split(h, r"[.\-_]"), lambda t: t != "").alias("host_tokens"), F.filter(F.split(p, r"[/.\-_]"), lambda t: t != "").alias("path_tokens"), pairs.alias("pairs"),
        F.regexp_extract(authority(url), r":(\d+)$", 1).alias("port"),
    )


def _count(text: Column, keep: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(F.regexp_replace(text, f"[^{keep}]", "")).cast("double")


def _longest(text: Column, keep: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"([{keep}]+)")), F.length)), F.lit(0)).cast("double")


def _longest_item(items: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(items, F.length)), F.lit(0)).cast("double")


def _mean_item(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.aggregate(items, F.lit(0.0), lambda a, t: a + F.length(t)) / F.size(items)).otherwise(0.0)


def _per(a: Column, b: Column) -> Column:
    return a / F.greatest(F.lit(1.0), b)


def lexical_measures(s: Column) -> dict[str, Column]:
    """The 79 measures of a URL by name, in the contract's order, from url_struct."""
    part = {k: s[k] for k in ("url", "host", "path", "query", "folder", "file", "ext")}
    size = {k: F.length(v).cast("double") for k, v in part.items()}
    digits = {k: _count(v, r"\p{Nd}") for k, v in part.items()}
    letters = {k: _count(v, r"\p{L}") for k, v in part.items()}
    symbols = {k: F.length(F.regexp_replace(v, r"[\p{L}\p{N}]", "")).cast("double") for k, v in part.items()}
    low = F.lower(s["url"])
    dots_host, dots_path = _count(s["host"], r".\-_"), _count(s["path"], r"/.\-_")
    values = F.transform(F.filter(s["pairs"], lambda v: F.contains(v, F.lit("="))), lambda v: F.regexp_extract(v, r"([^=]*)$", 1))
    run = F.greatest(_longest(s["url"], "a-zA-Z"), _longest(s["url"], "0-9"))
    sensitive = sum((F.contains(low, F.lit(w)).cast("double") for w in SENSITIVE_14), F.lit(0.0))
    special = F.length(s["url"]).cast("double") - F.length(F.translate(s["url"], SPECIAL_MARKS, "")).cast("double")
    ent = {k: F.round(entropy(v), 4) for k, v in part.items()}
    m = {
        "Querylength": size["query"], "domain_token_count": F.size(s["host_tokens"]).cast("double"), "path_token_count": F.size(s["path_tokens"]).cast("double"), "avgdomaintokenlen": _mean_item(s["host_tokens"]),
        "longdomaintokenlen": _longest_item(s["host_tokens"]), "avgpathtokenlen": _mean_item(s["path_tokens"]), "tld": F.when(F.contains(s["host"], F.lit(".")), F.length(F.regexp_extract(s["host"], r"([^.]*)$", 1))).otherwise(0).cast("double"),
        "charcompvowels": _count(low, "aeiou"), "charcompace": _count(low, "ace"),
    }
    for name, k in (("url", "url"), ("domain", "host"), ("path", "path"), ("filename", "file"), ("getArg", "query")):
        m[f"ldl_{name}"] = _longest(part[k], "a-zA-Z")
    for name, k in (("url", "url"), ("domain", "host"), ("path", "path"), ("filename", "file"), ("getArg", "query")):
        m[f"dld_{name}"] = _longest(part[k], "0-9")
    m |= {
        "urlLen": size["url"], "domainlength": size["host"], "pathLength": size["path"], "subDirLen": size["folder"], "fileNameLen": size["file"], "this.fileExtLen": size["ext"], "ArgLen": size["query"],
        "pathurlRatio": _per(size["path"], size["url"]), "ArgUrlRatio": _per(size["query"], size["url"]), "argDomanRatio": _per(size["query"], size["host"]), "domainUrlRatio": _per(size["host"], size["url"]),
        "pathDomainRatio": _per(size["path"], size["host"]), "argPathRatio": _per(size["query"], size["path"]), "executable": F.lower(s["ext"]).isin(EXECUTABLE).cast("double"), "isPortEighty": (s["port"] == "80").cast("double"),
        "NumberofDotsinURL": _count(s["url"], "."), "ISIpAddressInDomainName": s["host"].rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$").cast("double"), "CharacterContinuityRate": F.round(_per(run, size["url"]), 4), "LongestVariableValue": _longest_item(values),
    }
    for name, k in (("URL", "url"), ("host", "host"), ("Directory", "folder"), ("File_name", "file"), ("Extension", "ext"), ("Query", "query")):
        m[f"{name}_DigitCount"] = digits[k]
    m |= {"URL_Letter_Count": letters["url"], "host_letter_count": letters["host"], "Directory_LetterCount": letters["folder"], "Filename_LetterCount": letters["file"], "Extension_LetterCount": letters["ext"], "Query_LetterCount": letters["query"]}
    m |= {
        "LongestPathTokenLength": _longest_item(s["path_tokens"]), "Domain_LongestWordLength": _longest(s["host"], "a-zA-Z0-9"), "Path_LongestWordLength": _longest(s["path"], "a-zA-Z0-9"), "sub-Directory_LongestWordLength": _longest(s["folder"], "a-zA-Z0-9"),
        "Arguments_LongestWordLength": _longest(s["query"], "a-zA-Z0-9"), "URL_sensitiveWord": sensitive, "URLQueries_variable": F.size(s["pairs"]).cast("double"), "spcharUrl": special, "delimeter_Domain": dots_host, "delimeter_path": dots_path,
        "delimeter_Count": dots_host + dots_path, "NumberRate_URL": _per(digits["url"], size["url"]), "NumberRate_Domain": _per(digits["host"], size["host"]), "NumberRate_DirectoryName": _per(digits["folder"], size["folder"]),
        "NumberRate_FileName": _per(digits["file"], size["file"]), "NumberRate_Extension": _per(digits["ext"], size["ext"]), "NumberRate_AfterPath": _per(digits["ext"] + digits["query"], size["file"] + size["query"]),
    }
    for name, k in (("URL", "url"), ("Domain", "host"), ("Directoryname", "folder"), ("FileName", "file"), ("Extension", "ext"), ("Afterpath", "query")):
        m[f"SymbolCount_{name}"] = symbols[k]
    for name, k in (("URL", "url"), ("Domain", "host"), ("DirectoryName", "folder"), ("Filename", "file"), ("Extension", "ext"), ("Afterpath", "query")):
        m[f"Entropy_{name}"] = ent[k]
    return m


def content_url_measures(url: Column) -> dict[str, Column]:
    """Nine measures of a URL in lower case."""
    u = F.lower(url)
    h = host(u)
    labels = F.split(h, r"\.")
    inner = F.slice(labels, 1, F.greatest(F.lit(0), F.size(labels) - 1))
    p, q = path(u), query(u)
    params = F.regexp_extract(p, r";([^/]*)$", 1)
    rests = [F.regexp_replace(p, r";[^/]*$", ""), params, q, F.regexp_extract(u, r"#(.*)$", 1)]
    flag = lambda c: c.cast("int")
    return {
        "domain_is_ip": flag(h.rlike(r"^\d+\.\d+\.\d+\.\d+$")), "symbol_count": F.length(F.regexp_replace(u, r"[^@\-~]", "")), "https": flag(F.startswith(u, F.lit("https://"))), "domain_len": F.length(h), "url_len": F.length(u),
        "num_dot_hostname": F.length(F.regexp_replace(h, "[^.]", "")), "sensitive_word": flag(reduce(lambda a, w: a | F.contains(u, F.lit(w)), SENSITIVE_8, F.lit(False))),
        "tld_in_domain": flag(F.arrays_overlap(inner, F.array(*[F.lit(t) for t in COMMON_TLDS]))), "tld_in_path": flag(reduce(lambda a, r: a | F.regexp_replace(r, "^/+|/+$", "").isin(COMMON_TLDS), rests, F.lit(False))),
    }


def redirect_target(url: Column) -> Column:
    """The target that a URL carries in a parameter, decoded: of the first parameter, in the order of TARGET_PARAMS,
    whose first value is an http(s) URL; null if there is none."""
    q = query(url)
    found = []
    for p in TARGET_PARAMS:
        raw = F.regexp_extract(q, rf"(?:^|&){p}=([^&]+)", 1)
        v = F.coalesce(F.try_url_decode(raw), raw)
        found.append(F.when(v.rlike("^https?://"), v))
    return F.coalesce(*found)


def c2_endpoint(url: Column) -> Column:
    """Struct (is_c2, family, technique) of a request's destination; the first rule that fits."""
    u = F.lower(url)
    has = lambda *ws: reduce(lambda a, w: a | F.contains(u, F.lit(w)), ws, F.lit(False))
    rules = [
        (has("api.telegram.org") & has("sendmessage", "senddocument"), "Telegram Bot API Exfiltration Drop", "T1020"),
        (has("discord.com/api/webhooks", "discordapp.com/api/webhooks"), "Discord Webhook Exfiltration Drop", "T1020"),
        (u.rlike(r"/(log|gate|drop|grabber|save|post|login|auth|dump|pass|cred|collect)\.(php|asp|aspx|jsp|cgi|pl|py)"), "Automated Script Credential Harvester (.php/.asp gate)", "T1056.001"),
        (u.rlike(r"https?://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d{2,5})?"), "Direct IP C2 Exfiltration Endpoint", "T1071.001"),
        (has("webhook.site", "pipedream.net", "requestbin", "postb.in"), "Third-Party Webhook Data Harvester", "T1020"),
    ]
    out = F.when(F.coalesce(u, F.lit("")) == "", F.struct(F.lit(False).alias("is_c2"), F.lit("None").alias("family"), F.lit("None").alias("technique")))
    for cond, family, technique in rules:
        out = out.when(cond, F.struct(F.lit(True).alias("is_c2"), F.lit(family).alias("family"), F.lit(technique).alias("technique")))
    return out.otherwise(F.struct(F.lit(False).alias("is_c2"), F.lit("Standard Web Resource").alias("family"), F.lit("None").alias("technique")))


def homoglyph_fold(name: Column) -> Column:
    """Digits and signs that imitate letters, replaced by the letters."""
    return F.translate(name, "1053@8", "loseab")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text as lower-case hexadecimal digits, from the built-in digest."""
    block = key.ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytearray(b ^ 0x36 for b in block)), F.encode(message, "utf-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(b ^ 0x5C for b in block)), inner), 256)


def canary_id(url: Column, hour: Column, key: bytes, salt: str = "std") -> Column:
    """Twelve digits that name a planted credential for one URL and hour."""
    return F.upper(F.substring(hmac_sha256(key, F.concat_ws("|", F.lower(F.trim(url)), hour.cast("string"), F.lit(salt))), 1, 12))
