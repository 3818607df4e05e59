"""Queries over URLs: parts, entropy, risk of words, brand proximity, lexical score and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webwarden.functions import urls as u
from webwarden.session import materialize, spread

#: Key and hour of the planted credentials in the query; an engine's user passes their own.
CANARY_KEY, CANARY_HOUR = b"webwarden-canary", 485000


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/lexical_features.parquet").select("feature_id", "url"))


def brand_ids(spark: SparkSession, sf_dir: str) -> list[str]:
    """The brand dimension's keys in order: a catalogue kept by hand, read once by the driver."""
    return [r[0] for r in spark.read.parquet(f"{sf_dir}/protected_brands.parquet").select("brand_id").collect()]


def canonical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/protected_brands.parquet").select(F.col("brand_id").alias("c_brand"), F.explode("canonical_domains").alias("c_domain")).select("c_brand", F.lower("c_domain").alias("c_domain"))


def url_parts(spark, sf_dir):
    h = u.host(F.col("url"))
    return scans(spark, sf_dir).select("feature_id", h.alias("host"), u.registered(h).alias("registered_domain"), u.subdomain(h).alias("subdomain"), u.suffix(h).alias("suffix"), u.path(F.col("url")).alias("path"), u.query(F.col("url")).alias("query"))


def url_flags(spark, sf_dir):
    h = F.lower(u.host(F.col("url")))
    sub = u.subdomain(h)
    return scans(spark, sf_dir).select(
        "feature_id", u.is_ip(h).alias("is_ip"), F.contains(F.lower("url"), F.lit("xn--")).alias("is_punycode"), F.element_at(F.split(u.suffix(h), r"\."), -1).isin(u.RISKY_TLDS).alias("is_risky_tld"),
        F.when(sub == "", 0).otherwise(F.size(F.split(sub, r"\."))).alias("subdomain_count"), F.contains(h, F.lit("-")).alias("has_hyphen"), F.length("url").alias("url_length"),
        (F.length("url") - F.length(F.translate("url", "@-_~%?=&", ""))).alias("symbol_count"), F.round(F.length(F.regexp_replace(h, "[^0-9]", "")) / F.greatest(F.lit(1), F.length(h)), 4).alias("digit_ratio"),
    )


def url_nlp_risk(spark, sf_dir):
    return scans(spark, sf_dir).select("feature_id", u.nlp_risk(F.col("url")).alias("nlp_risk"))


def url_entropy(spark, sf_dir):
    h = F.lower(u.host(F.col("url")))
    return scans(spark, sf_dir).select("feature_id", F.round(u.entropy(h), 4).alias("host_entropy"), F.round(u.entropy(F.col("url")), 4).alias("url_entropy"))


def url_bigram_entropy(spark, sf_dir):
    return scans(spark, sf_dir).select("feature_id", F.round(u.bigram_entropy(F.lower(u.host(F.col("url")))), 4).alias("bigram_entropy"))


def _near(spark, sf_dir) -> DataFrame:
    """Each distinct host once with its nearest brand, written down: proximity is costly, hosts repeat, and a join's
    condition on the brand would have the optimizer spell the expression out again in every branch."""
    named = scans(spark, sf_dir).withColumn("host", F.lower(u.host(F.col("url"))))
    # Hosts are few bytes with much work for each: adaptive execution would put them into one partition.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hosts = materialize(named.select("host").distinct().repartition(width), "hosts")
    return materialize(u.nearest_brands(hosts, brand_ids(spark, sf_dir)), "near")


def url_brand_distance(spark, sf_dir):
    return _near(spark, sf_dir).select("host", F.col("near.distance").alias("distance"), F.col("near.similarity").alias("similarity"), F.col("near.brand").alias("brand"))


def scored(spark, sf_dir) -> DataFrame:
    """(feature_id, url, host, near, is_canonical, s_lex): the lexical verdict of every scan."""
    near = _near(spark, sf_dir)
    official = F.broadcast(canonical_pairs(spark, sf_dir))
    hit = (F.col("near.brand") == F.col("c_brand")) & ((F.col("host") == F.col("c_domain")) | (u.registered(F.col("host")) == F.col("c_domain")))
    known = near.join(official, hit, "left_semi").select(F.col("host").alias("k_host"))
    per_host = near.join(known, F.col("host") == F.col("k_host"), "left").withColumn("is_canonical", F.col("k_host").isNotNull()).drop("k_host")
    named = scans(spark, sf_dir).withColumn("host", F.lower(u.host(F.col("url"))))
    return named.join(per_host, "host").withColumn("s_lex", u.lexical_score(F.col("host"), F.col("near"), F.col("is_canonical"), F.col("url")))


def url_lexical_score(spark, sf_dir):
    return scored(spark, sf_dir).select("feature_id", F.col("near.brand").alias("brand"), "is_canonical", "s_lex", u.verdict(F.col("s_lex")).alias("verdict"))


def url_verdict_counts(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(u.verdict(F.col("s_lex")).alias("verdict")).agg(F.count(F.lit(1)).alias("scans"))


def _measures(spark, sf_dir, names: list[str]) -> DataFrame:
    parsed = scans(spark, sf_dir).select("feature_id", u.url_struct(F.col("url")).alias("s"))
    m = u.lexical_measures(F.col("s"))
    return parsed.select("feature_id", *[F.round(m[n], 4).alias(n) for n in names])


LENGTHS = ["Querylength", "urlLen", "domainlength", "pathLength", "subDirLen", "fileNameLen", "this.fileExtLen", "ArgLen", "executable", "isPortEighty", "ISIpAddressInDomainName"]
TOKENS = ["domain_token_count", "path_token_count", "avgdomaintokenlen", "longdomaintokenlen", "avgpathtokenlen", "tld", "LongestPathTokenLength", "LongestVariableValue", "URLQueries_variable", "URL_sensitiveWord"]
RUNS = [f"{a}_{b}" for a in ("ldl", "dld") for b in ("url", "domain", "path", "filename", "getArg")] + ["CharacterContinuityRate", "Domain_LongestWordLength", "Path_LongestWordLength", "sub-Directory_LongestWordLength", "Arguments_LongestWordLength"]
COUNTS = (
    ["charcompvowels", "charcompace", "NumberofDotsinURL", "spcharUrl", "delimeter_Domain", "delimeter_path", "delimeter_Count"] + [f"{k}_DigitCount" for k in ("URL", "host", "Directory", "File_name", "Extension", "Query")]
    + ["URL_Letter_Count", "host_letter_count", "Directory_LetterCount", "Filename_LetterCount", "Extension_LetterCount", "Query_LetterCount"] + [f"SymbolCount_{k}" for k in ("URL", "Domain", "Directoryname", "FileName", "Extension", "Afterpath")]
)
RATIOS = ["pathurlRatio", "ArgUrlRatio", "argDomanRatio", "domainUrlRatio", "pathDomainRatio", "argPathRatio"] + [f"NumberRate_{k}" for k in ("URL", "Domain", "DirectoryName", "FileName", "Extension", "AfterPath")]
ENTROPIES = [f"Entropy_{k}" for k in ("URL", "Domain", "DirectoryName", "Filename", "Extension", "Afterpath")]


def iscx_lengths(spark, sf_dir):
    return _measures(spark, sf_dir, LENGTHS)


def iscx_tokens(spark, sf_dir):
    return _measures(spark, sf_dir, TOKENS)


def iscx_runs(spark, sf_dir):
    return _measures(spark, sf_dir, RUNS)


def iscx_counts(spark, sf_dir):
    return _measures(spark, sf_dir, COUNTS)


def iscx_ratios(spark, sf_dir):
    return _measures(spark, sf_dir, RATIOS)


def iscx_entropy(spark, sf_dir):
    return _measures(spark, sf_dir, ENTROPIES)


def content_url_features(spark, sf_dir):
    return scans(spark, sf_dir).select("feature_id", *[c.alias(n) for n, c in u.content_url_measures(F.col("url")).items()])


def redirect_unmask(spark, sf_dir):
    h = F.lower(u.host(F.col("url")))
    short = h.isin(u.SHORTENERS)
    target = u.redirect_target(F.col("url"))
    return scans(spark, sf_dir).select("feature_id", short.alias("is_shortened"), target.alias("target"), F.when(short | target.isNotNull(), 2).otherwise(1).alias("hops"), F.when(short | target.isNotNull(), 0.2).otherwise(0.0).alias("boost"))


def c2_classify(spark, sf_dir):
    return scans(spark, sf_dir).select("feature_id", u.c2_endpoint(F.col("url")).alias("c")).select("feature_id", "c.is_c2", "c.family", "c.technique")


def homoglyph_match(spark, sf_dir):
    """Hosts that spell a brand only once digits that imitate letters are folded back."""
    h = F.lower(u.host(F.col("url")))
    folded = u.homoglyph_fold(h)
    brands = F.array(*[F.lit(b) for b in brand_ids(spark, sf_dir)])
    only = F.filter(brands, lambda b: F.contains(folded, b) & ~F.contains(h, b))
    return scans(spark, sf_dir).select("feature_id", folded.alias("folded"), F.try_element_at(only, F.lit(1)).alias("brand")).filter("brand is not null")


def canary_credentials(spark, sf_dir):
    return scans(spark, sf_dir).select("feature_id", u.canary_id(F.col("url"), F.lit(CANARY_HOUR), CANARY_KEY).alias("canary_id"))


QUERIES = {
    f.__name__: f
    for f in (
        url_parts, url_flags, url_nlp_risk, url_entropy, url_bigram_entropy, url_brand_distance, url_lexical_score, url_verdict_counts, iscx_lengths, iscx_tokens, iscx_runs, iscx_counts, iscx_ratios, iscx_entropy,
        content_url_features, redirect_unmask, c2_classify, homoglyph_match, canary_credentials,
    )
}

_IN = lambda words: ", ".join(f"'{w}'" for w in words)
_SECOND = "|".join(u.SECOND_LEVEL)
_IP4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"
_HOSTS = rf"""
WITH a AS (SELECT feature_id, url, regexp_extract(trim(url), '^(?:https?://)?([^/?#]*)', 1) AS auth FROM lexical_features),
b AS (SELECT *, split_part(auth, ':', 1) AS host FROM a),
c AS (SELECT *, string_split(host, '.') AS l FROM b),
d AS (SELECT *, CASE WHEN regexp_matches(host, '{_IP4}') OR len(l) < 2 THEN '' WHEN len(l) > 2 AND l[-2] IN ({_IN(u.SECOND_LEVEL)}) AND l[-1] <> '' THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS suffix FROM c),
h AS (SELECT *, CASE WHEN suffix = '' THEN host ELSE l[-1 - len(string_split(suffix, '.'))] || '.' || suffix END AS registered FROM d)
"""
_LOW = _HOSTS.replace("split_part(auth, ':', 1) AS host", "lower(split_part(auth, ':', 1)) AS host")
_SUB = "CASE WHEN length(host) > length(registered) THEN left(host, length(host) - length(registered) - 1) ELSE '' END"
_PARTS = r"""
WITH a AS (SELECT feature_id, url, regexp_extract(trim(url), '^(?:https?://)?([^/?#]*)', 1) AS auth, regexp_replace(regexp_extract(trim(url), '^(?:https?://)?[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS p0, regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1) AS query FROM lexical_features),
b AS (SELECT *, lower(split_part(auth, ':', 1)) AS host, CASE WHEN p0 = '' THEN '/' ELSE p0 END AS path FROM a),
c AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM b),
d AS (SELECT *, CASE WHEN len(segs) > 0 AND contains(segs[-1], '.') THEN segs[-1] ELSE '' END AS file FROM c),
s AS (SELECT *, CASE WHEN file <> '' THEN array_to_string(segs[1:len(segs) - 1], '/') ELSE path END AS folder, CASE WHEN file <> '' THEN string_split(file, '.')[-1] ELSE '' END AS ext,
  list_filter(regexp_split_to_array(host, '[.\-_]'), lambda x: x <> '') AS ht, list_filter(regexp_split_to_array(path, '[/.\-_]'), lambda x: x <> '') AS pt, CASE WHEN query = '' THEN [] ELSE string_split(query, '&') END AS pairs FROM d)
"""
_P = {"url": "url", "host": "host", "path": "path", "query": "query", "folder": "folder", "file": "file", "ext": "ext"}
_cnt = lambda c, k: f"length(regexp_replace({c}, '[^{k}]', '', 'g'))::DOUBLE"
_run = lambda c, k: f"coalesce(list_max(list_transform(regexp_extract_all({c}, '[{k}]+'), lambda x: length(x))), 0)::DOUBLE"
_max = lambda xs: f"coalesce(list_max(list_transform({xs}, lambda x: length(x))), 0)::DOUBLE"
_avg = lambda xs: f"round(coalesce(list_avg(list_transform({xs}, lambda x: length(x))), 0), 4)"
_len = lambda c: f"length({c})::DOUBLE"
_per = lambda a, b: f"round({a} / greatest(1, {b}), 4)"
_ent = lambda c: f"round(coalesce(list_entropy(regexp_extract_all({c}, '(?s).')), 0), 4)"
_sensitive = " + ".join(f"contains(lower(url), '{w}')::INT" for w in u.SENSITIVE_14)
_marks = u.SPECIAL_MARKS.replace("'", "''")


def _select(columns: dict[str, str]) -> str:
    return _PARTS + "SELECT feature_id, " + ", ".join(f'{e} AS "{n}"' for n, e in columns.items()) + " FROM s"


_L = dict(zip(LENGTHS, [_len("query"), _len("url"), _len("host"), _len("path"), _len("folder"), _len("file"), _len("ext"), _len("query"), f"(lower(ext) IN ({_IN(u.EXECUTABLE)}))::DOUBLE", r"(regexp_extract(auth, ':(\d+)$', 1) = '80')::DOUBLE", r"regexp_matches(host, '^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$')::DOUBLE"]))
_T = dict(zip(TOKENS, ["len(ht)::DOUBLE", "len(pt)::DOUBLE", _avg("ht"), _max("ht"), _avg("pt"), "CASE WHEN contains(host, '.') THEN length(string_split(host, '.')[-1]) ELSE 0 END::DOUBLE", _max("pt"), _max("list_transform(list_filter(pairs, lambda x: contains(x, '=')), lambda x: string_split(x, '=')[-1])"), "len(pairs)::DOUBLE", f"({_sensitive})::DOUBLE"]))
_R = {f"{a}_{n}": _run(c, k) for a, k in (("ldl", "a-zA-Z"), ("dld", "0-9")) for n, c in (("url", "url"), ("domain", "host"), ("path", "path"), ("filename", "file"), ("getArg", "query"))}
_R |= {"CharacterContinuityRate": _per(f"greatest({_run('url', 'a-zA-Z')}, {_run('url', '0-9')})", "length(url)"), "Domain_LongestWordLength": _run("host", "a-zA-Z0-9"), "Path_LongestWordLength": _run("path", "a-zA-Z0-9"), "sub-Directory_LongestWordLength": _run("folder", "a-zA-Z0-9"), "Arguments_LongestWordLength": _run("query", "a-zA-Z0-9")}
_C = {"charcompvowels": _cnt("lower(url)", "aeiou"), "charcompace": _cnt("lower(url)", "ace"), "NumberofDotsinURL": _cnt("url", "."), "spcharUrl": f"(length(url) - length(translate(url, '{_marks}', '')))::DOUBLE", "delimeter_Domain": _cnt("host", r".\-_"), "delimeter_path": _cnt("path", r"/.\-_"), "delimeter_Count": _cnt("host", r".\-_") + " + " + _cnt("path", r"/.\-_")}
for _names, _k in ((["URL_DigitCount", "host_DigitCount", "Directory_DigitCount", "File_name_DigitCount", "Extension_DigitCount", "Query_DigitCount"], r"\p{Nd}"), (["URL_Letter_Count", "host_letter_count", "Directory_LetterCount", "Filename_LetterCount", "Extension_LetterCount", "Query_LetterCount"], r"\p{L}")):
    _C |= {n: _cnt(c, _k) for n, c in zip(_names, ("url", "host", "folder", "file", "ext", "query"))}
_C |= {f"SymbolCount_{n}": f"length(regexp_replace({c}, '[\\p{{L}}\\p{{N}}]', '', 'g'))::DOUBLE" for n, c in (("URL", "url"), ("Domain", "host"), ("Directoryname", "folder"), ("FileName", "file"), ("Extension", "ext"), ("Afterpath", "query"))}
_Q = {n: _per(f"length({a})", f"length({b})") for n, a, b in (("pathurlRatio", "path", "url"), ("ArgUrlRatio", "query", "url"), ("argDomanRatio", "query", "host"), ("domainUrlRatio", "host", "url"), ("pathDomainRatio", "path", "host"), ("argPathRatio", "query", "path"))}
_Q |= {f"NumberRate_{n}": _per(_cnt(c, r"\p{Nd}"), f"length({c})") for n, c in (("URL", "url"), ("Domain", "host"), ("DirectoryName", "folder"), ("FileName", "file"), ("Extension", "ext"))}
_Q["NumberRate_AfterPath"] = _per(f"({_cnt('ext', chr(92) + 'p{Nd}')} + {_cnt('query', chr(92) + 'p{Nd}')})", "length(file) + length(query)")
_E = {f"Entropy_{n}": _ent(c) for n, c in (("URL", "url"), ("Domain", "host"), ("DirectoryName", "folder"), ("Filename", "file"), ("Extension", "ext"), ("Afterpath", "query"))}

_STEM = "CASE WHEN length(t) <= 3 THEN t " + " ".join(f"WHEN ends_with(t, '{e}') AND length(t) >= {len(e) + 3} THEN left(t, length(t) - {len(e)})" for e in u.STEM_ENDINGS) + " ELSE t END"
_STEMS = ", ".join(f"({i}, '{k}', {w})" for i, (k, w) in enumerate(u.STEM_WEIGHTS.items()))
_NEAR = (
    _LOW
    + f""", hosts AS (SELECT DISTINCT host, registered, {_SUB} AS sub FROM h),
raw AS (SELECT host, unnest(list_concat([split_part(registered, '.', 1), sub, host], regexp_split_to_array(split_part(registered, '.', 1), '[-._0-9]'), regexp_split_to_array(sub, '[-._0-9]'))) AS t FROM hosts),
tok AS (SELECT DISTINCT host, t, regexp_replace(t, '[^\\x00-\\x7F]', '?', 'g') AS f FROM raw WHERE t <> ''),
br AS (SELECT brand_id, row_number() OVER () AS o FROM protected_brands),
x AS (SELECT host, brand_id, o, levenshtein(f, brand_id) AS d, 1 - levenshtein(f, brand_id) / greatest(length(t), length(brand_id)) AS s FROM tok, br),
y AS (SELECT host, arg_min({{'b': brand_id, 'd': d, 's': s}}, (d, -s, o)) AS m FROM x GROUP BY host),
n AS (SELECT host, m.d AS distance, CASE WHEN m.s < 0.6 AND m.d > 2 THEN 0 ELSE round(m.s, 4) END AS similarity, CASE WHEN m.s < 0.6 AND m.d > 2 THEN '' ELSE m.b END AS brand FROM y)"""
)
_SCORED = (
    _NEAR
    + f""", can AS (SELECT brand_id AS cb, unnest(canonical_domains) AS cd FROM protected_brands),
z AS (SELECT h.*, {_SUB} AS sub, n.distance AS dist, n.similarity AS sim, n.brand, EXISTS (SELECT 1 FROM can WHERE cb = n.brand AND (cd = h.host OR cd = h.registered)) AS is_canonical FROM h JOIN n USING (host)),
f AS (SELECT *, coalesce(string_split(suffix, '.')[-1] IN ({_IN(u.RISKY_TLDS)}), false) AS risky, brand <> '' AND dist = 0 AS exact, brand <> '' AND dist BETWEEN 1 AND 2 AND length(brand) >= 3 AS miss, contains(host, '-') AS hy, CASE WHEN sub = '' THEN 0 ELSE len(string_split(sub, '.')) END AS lv FROM z),
g AS (SELECT feature_id, brand, is_canonical, CASE WHEN is_canonical THEN 0.02 ELSE round(least(1.0,
  (CASE WHEN brand <> '' AND (contains(sub, brand || '.') OR starts_with(sub, brand || '-') OR ends_with(sub, '-' || brand)) THEN 0.7 ELSE 0 END)
  + (CASE WHEN exact THEN 0.55 + 0.2 * risky::INT + 0.15 * (hy OR lv > 0)::INT WHEN miss THEN 0.6 + 0.2 * risky::INT WHEN dist BETWEEN 3 AND 4 AND sim >= 0.6 THEN 0.35 ELSE 0 END)
  + 0.5 * contains(lower(url), 'xn--')::INT + 0.25 * risky::INT + 0.55 * regexp_matches(host, '{_IP4}')::INT + 0.15 * (list_entropy(regexp_extract_all(host, '(?s).')) > 3.8)::INT
  + 0.1 * (hy AND NOT exact)::INT + 0.15 * (lv >= 2)::INT + 0.15 * (length(regexp_replace(host, '[^0-9]', '', 'g')) / greatest(1, length(host)) > 0.15)::INT)::DOUBLE, 4) END::DOUBLE AS s_lex FROM f)"""
)
_VERDICT = "CASE WHEN s_lex >= 0.65 THEN 'phishing' WHEN s_lex >= 0.35 THEN 'suspicious' ELSE 'safe' END"
_TARGET = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(url_decode(replace(regexp_extract(q, '(?:^|&){p}=([^&]+)', 1), '+', ' ')), '^https?://') THEN url_decode(replace(regexp_extract(q, '(?:^|&){p}=([^&]+)', 1), '+', ' ')) END" for p in u.TARGET_PARAMS) + ")"
_XOR = lambda v: "".join(f"\\x{b ^ v:02X}" for b in CANARY_KEY.ljust(64, b"\0"))
SQL = {
    "url_parts": _HOSTS + f"SELECT feature_id, host, registered AS registered_domain, {_SUB} AS subdomain, suffix, regexp_extract(trim(url), '^(?:https?://)?[^/?#]*([^?#]*)', 1) AS path, regexp_extract(trim(url), '^[^?#]*\\?([^#]*)', 1) AS query FROM h",
    "url_flags": _LOW + f"SELECT feature_id, regexp_matches(host, '{_IP4}') AS is_ip, contains(lower(url), 'xn--') AS is_punycode, string_split(suffix, '.')[-1] IN ({_IN(u.RISKY_TLDS)}) AS is_risky_tld, CASE WHEN {_SUB} = '' THEN 0 ELSE len(string_split({_SUB}, '.')) END::INT AS subdomain_count, contains(host, '-') AS has_hyphen, length(url)::INT AS url_length, length(regexp_replace(url, '[^@\\-_~%?=&]', '', 'g'))::INT AS symbol_count, round(length(regexp_replace(host, '[^0-9]', '', 'g')) / greatest(1, length(host)), 4) AS digit_ratio FROM h",
    "url_nlp_risk": f"""WITH t AS (SELECT feature_id, unnest(regexp_extract_all(lower(url), '[a-z0-9]+')) AS t, generate_subscripts(regexp_extract_all(lower(url), '[a-z0-9]+'), 1) AS i FROM lexical_features),
s AS (SELECT feature_id, i, {_STEM} AS st FROM t), k(o, stem, w) AS (VALUES {_STEMS}),
m AS (SELECT feature_id, i, arg_min(w, o) AS w FROM s JOIN k ON contains(st, stem) GROUP BY ALL),
z AS (SELECT feature_id, -2.5 + 2 * sum(w) + CASE WHEN count(*) >= 2 THEN 0.8 * (count(*) - 1) ELSE 0 END AS z FROM m GROUP BY feature_id)
SELECT feature_id, round(1 / (1 + exp(-greatest(-10, least(10, coalesce(z, -2.5)::DOUBLE)))), 4) AS nlp_risk FROM lexical_features LEFT JOIN z USING (feature_id)""",
    "url_entropy": _LOW + f"SELECT feature_id, {_ent('host')} AS host_entropy, {_ent('url')} AS url_entropy FROM h",
    "url_bigram_entropy": _LOW + """, g AS (SELECT feature_id, substr(host, i::BIGINT, 2) AS g FROM h, range(1, 400) r(i) WHERE i < length(host)), ge AS (SELECT feature_id, entropy(g) AS e FROM g GROUP BY feature_id)
SELECT feature_id, round(coalesce(e, 0), 4) AS bigram_entropy FROM h LEFT JOIN ge USING (feature_id)""",
    "url_brand_distance": _NEAR + " SELECT host, distance::INT AS distance, similarity::DOUBLE AS similarity, brand FROM n",
    "url_lexical_score": _SCORED + f" SELECT feature_id, brand, is_canonical, s_lex, {_VERDICT} AS verdict FROM g",
    "url_verdict_counts": _SCORED + f" SELECT {_VERDICT} AS verdict, count(*) AS scans FROM g GROUP BY ALL",
    "iscx_lengths": _select(_L), "iscx_tokens": _select(_T), "iscx_runs": _select(_R), "iscx_counts": _select(_C), "iscx_ratios": _select(_Q), "iscx_entropy": _select(_E),
    "content_url_features": f"""WITH a AS (SELECT feature_id, lower(url) AS u, lower(regexp_extract(trim(lower(url)), '^(?:https?://)?([^/?#:]*)', 1)) AS h, regexp_extract(trim(lower(url)), '^(?:https?://)?[^/?#]*([^?#]*)', 1) AS p, regexp_extract(trim(lower(url)), '^[^?#]*\\?([^#]*)', 1) AS q FROM lexical_features)
SELECT feature_id, regexp_matches(h, '^\\d+\\.\\d+\\.\\d+\\.\\d+$')::INT AS domain_is_ip, length(regexp_replace(u, '[^@\\-~]', '', 'g'))::INT AS symbol_count, starts_with(u, 'https://')::INT AS https, length(h)::INT AS domain_len, length(u)::INT AS url_len, length(regexp_replace(h, '[^.]', '', 'g'))::INT AS num_dot_hostname,
 regexp_matches(u, '{'|'.join(u.SENSITIVE_8)}')::INT AS sensitive_word, list_has_any(string_split(h, '.')[1:len(string_split(h, '.')) - 1], [{_IN(u.COMMON_TLDS)}])::INT AS tld_in_domain,
 (trim(regexp_replace(p, ';[^/]*$', ''), '/') IN ({_IN(u.COMMON_TLDS)}) OR trim(regexp_extract(p, ';([^/]*)$', 1), '/') IN ({_IN(u.COMMON_TLDS)}) OR trim(q, '/') IN ({_IN(u.COMMON_TLDS)}) OR trim(regexp_extract(u, '#(.*)$', 1), '/') IN ({_IN(u.COMMON_TLDS)}))::INT AS tld_in_path FROM a""",
    "redirect_unmask": f"""WITH a AS (SELECT feature_id, lower(regexp_extract(trim(url), '^(?:https?://)?([^/?#:]*)', 1)) AS h, regexp_extract(trim(url), '^[^?#]*\\?([^#]*)', 1) AS q FROM lexical_features),
b AS (SELECT feature_id, h IN ({_IN(u.SHORTENERS)}) AS is_shortened, {_TARGET} AS target FROM a) SELECT *, CASE WHEN is_shortened OR target IS NOT NULL THEN 2 ELSE 1 END::INT AS hops, CASE WHEN is_shortened OR target IS NOT NULL THEN 0.2 ELSE 0 END::DOUBLE AS boost FROM b""",
    "c2_classify": r"""WITH a AS (SELECT feature_id, lower(url) AS u FROM lexical_features), b AS (SELECT feature_id, CASE WHEN contains(u, 'api.telegram.org') AND (contains(u, 'sendmessage') OR contains(u, 'senddocument')) THEN 1 WHEN contains(u, 'discord.com/api/webhooks') OR contains(u, 'discordapp.com/api/webhooks') THEN 2
WHEN regexp_matches(u, '/(log|gate|drop|grabber|save|post|login|auth|dump|pass|cred|collect)\.(php|asp|aspx|jsp|cgi|pl|py)') THEN 3 WHEN regexp_matches(u, 'https?://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d{2,5})?') THEN 4 WHEN regexp_matches(u, 'webhook\.site|pipedream\.net|requestbin|postb\.in') THEN 5 ELSE 6 END AS k FROM a)
SELECT feature_id, k < 6 AS is_c2, ['Telegram Bot API Exfiltration Drop', 'Discord Webhook Exfiltration Drop', 'Automated Script Credential Harvester (.php/.asp gate)', 'Direct IP C2 Exfiltration Endpoint', 'Third-Party Webhook Data Harvester', 'Standard Web Resource'][k] AS family, ['T1020', 'T1020', 'T1056.001', 'T1071.001', 'T1020', 'None'][k] AS technique FROM b""",
    "homoglyph_match": _LOW + """, f AS (SELECT feature_id, host, translate(host, '1053@8', 'loseab') AS folded FROM h), br AS (SELECT brand_id, row_number() OVER () AS o FROM protected_brands)
SELECT feature_id, folded, arg_min(brand_id, o) AS brand FROM f JOIN br ON contains(folded, brand_id) AND NOT contains(host, brand_id) GROUP BY feature_id, folded""",
    "canary_credentials": f"""SELECT feature_id, upper(left(sha256('{_XOR(0x5C)}'::BLOB || unhex(sha256('{_XOR(0x36)}'::BLOB || encode(lower(trim(url)) || '|{CANARY_HOUR}|std')))), 12)) AS canary_id FROM lexical_features""",
}
