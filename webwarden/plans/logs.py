"""Queries over access logs. The lines are spelt from the events table by one deterministic recipe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webwarden.functions import logs as g
from webwarden.session import spread

_PAYLOADS = [
    "/index.html", "/item?id=1+UNION+SELECT+name", "/a/../../etc/passwd", "/q?x=%3Cscript%3Ealert(1)%3C/script%3E", "/run?c=/bin/sh", "/item?id=1%27%20or%20%271%27=%271", "/page?f=php://filter/x", "/p?u=javascript:alert", "/assets/app.js", "/q?s=information_schema", "/x?y=%00",
]
_AGENTS = ["Mozilla/5.0", "sqlmap/1.7", "Mozilla/5.0 (X11)", "curl/8.0", "Nikto/2.5", "Mozilla/5.0 (iPad)", "gobuster/3"]


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, line): a line in the combined format for each event; every 97th is malformed, every 13th sizeless."""
    return spelt(spread(spark.read.parquet(f"{sf_dir}/events.parquet")))


def spelt(e: DataFrame) -> DataFrame:
    """The log lines of a table or stream of events."""
    pick = lambda items, by: F.element_at(F.array(*[F.lit(x) for x in items]), (F.col("event_id") % by + 1).cast("int"))
    kind = F.col("event_type")
    p = pick(_PAYLOADS, 11)
    request = F.when(kind == "error", "POST /api/auth/login").when(kind == "signup", F.concat(F.lit("POST "), p)).when(kind == "click", p).otherwise(F.concat(F.lit("GET "), p))
    request = F.when(kind == "click", request).otherwise(F.concat(request, F.lit(" HTTP/1.1")))
    size = F.when(F.col("event_id") % 13 == 0, "-").otherwise((F.col("event_id") % 5000).cast("string"))
    line = F.concat(
        F.lit("10.0.0."), (F.col("user_id") % 40).cast("string"), F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "'), request, F.lit('" '),
        (F.lit(200) + F.col("event_id") % 5 * 100).cast("string"), F.lit(" "), size, F.lit(' "-" "'), pick(_AGENTS, 7), F.lit('"'),
    )
    return e.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 97 == 0, "malformed").otherwise(line).alias("line"))


def parsed(spark, sf_dir) -> DataFrame:
    return g.parse_lines(log_lines(spark, sf_dir)).drop("line")


def log_parse(spark, sf_dir):
    return parsed(spark, sf_dir)


def log_findings(spark, sf_dir):
    return g.finding_rows(parsed(spark, sf_dir))


def log_category_hist(spark, sf_dir):
    return g.category_counts(parsed(spark, sf_dir))


def log_category_share(spark, sf_dir):
    """Each category's part of all events; a scalar total beside a histogram of a few rows."""
    counted = g.category_counts(parsed(spark, sf_dir))
    total = F.sum("events").over(Window.partitionBy(F.lit(0)))  # of at most six rows
    return counted.select("category", F.round(F.least(F.lit(1.0), F.col("events") / F.greatest(F.lit(1), total)), 4).alias("share"))


def log_severity_hist(spark, sf_dir):
    return g.severity_counts(parsed(spark, sf_dir))


def log_brute_force(spark, sf_dir):
    return g.brute_force(parsed(spark, sf_dir)).select("ip", "post_count", F.size("endpoints").alias("endpoints"), "severity")


def log_top_attackers(spark, sf_dir):
    return g.top_attackers(parsed(spark, sf_dir)).select("ip", "events")


def log_blocklist(spark, sf_dir):
    return g.blocklist(parsed(spark, sf_dir))


def log_first_findings(spark, sf_dir):
    """The first 50 findings in the order of the log."""
    return g.findings(parsed(spark, sf_dir)).select("line_no", "ip", "status", F.size("attacks").alias("attacks")).orderBy("line_no").limit(50)


def log_totals(spark, sf_dir):
    """One pass: what the addresses sum up to."""
    per_ip = g.per_address(parsed(spark, sf_dir), every=True)
    return per_ip.agg(F.sum("requests").alias("requests"), F.count(F.lit(1)).alias("addresses"), (F.sum("lines") + F.count_if("forced")).alias("suspicious"))


def log_rollup(spark, sf_dir):
    """Cube of category, severity and day."""
    rows = g.findings(parsed(spark, sf_dir)).select(F.date_format(g.event_time(F.col("time")), "yyyy-MM-dd").alias("day"), F.explode("attacks").alias("a"))
    return rows.cube(F.col("a.category").alias("category"), F.col("a.severity").alias("severity"), "day").agg(F.count(F.lit(1)).alias("events"))


def log_hourly_window(spark, sf_dir):
    """Login posts per address in sliding windows of an hour, every half hour."""
    posts = g.login_posts(parsed(spark, sf_dir)).withColumn("ts", g.event_time(F.col("time")))
    return posts.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "ip").agg(F.count(F.lit(1)).alias("posts")).select(F.unix_timestamp("w.start").alias("window_start"), "ip", "posts")


def log_sessions(spark, sf_dir):
    """Sessions of an address: a gap of half an hour ends one."""
    seen = parsed(spark, sf_dir).withColumn("ts", g.event_time(F.col("time")))
    return seen.groupBy(F.session_window("ts", "30 minutes").alias("s"), "ip").agg(F.count(F.lit(1)).alias("requests")).select("ip", F.unix_timestamp("s.start").alias("session_start"), "requests")


QUERIES = {
    f.__name__: f
    for f in (log_parse, log_findings, log_category_hist, log_category_share, log_severity_hist, log_brute_force, log_top_attackers, log_blocklist, log_first_findings, log_totals, log_rollup, log_hourly_window, log_sessions)
}

_list = lambda items: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"
_P = f"{_list(_PAYLOADS)}[event_id % 11 + 1]"
_RULES = ", ".join(f"({i}, '{c}', '{n}', '{s}', '{t}', '{p.replace(chr(39), chr(39) * 2)}')" for i, (c, (p, n, s, t)) in enumerate((c, r) for c, rs in g.RULES.items() for r in rs))
_BASE = f"""WITH v AS (SELECT event_id AS line_no, CASE WHEN event_id % 97 = 0 THEN 'malformed' ELSE '10.0.0.' || (user_id % 40) || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "' ||
 CASE event_type WHEN 'error' THEN 'POST /api/auth/login HTTP/1.1' WHEN 'signup' THEN 'POST ' || {_P} || ' HTTP/1.1' WHEN 'click' THEN {_P} ELSE 'GET ' || {_P} || ' HTTP/1.1' END || '" ' || (200 + event_id % 5 * 100) || ' ' ||
 CASE WHEN event_id % 13 = 0 THEN '-' ELSE (event_id % 5000)::VARCHAR END || ' "-" "' || {_list(_AGENTS)}[event_id % 7 + 1] || '"' END AS line FROM events),
m AS (SELECT line_no, regexp_extract(line, '{g.LINE}', ['ip', 'time', 'request', 'status', 'size', 'referer', 'ua']) AS r FROM v WHERE regexp_matches(line, '{g.LINE}')),
w AS (SELECT line_no, r, string_split(r.request, ' ') AS w FROM m),
p AS (SELECT line_no, r.ip AS ip, r.time AS time, CASE WHEN len(w) >= 2 THEN w[1] ELSE 'GET' END AS method, CASE WHEN len(w) = 1 THEN w[1] WHEN len(w) >= 3 AND starts_with(w[-1], 'HTTP/') THEN array_to_string(w[2:-2], ' ') ELSE array_to_string(w[2:], ' ') END AS uri,
 CASE WHEN len(w) >= 3 AND starts_with(w[-1], 'HTTP/') THEN w[-1] ELSE 'HTTP/1.1' END AS proto, r.status::INT AS status, coalesce(try_cast(r.size AS INT), 0) AS size, r.referer AS referer, r.ua AS ua FROM w),
q AS (SELECT *, url_decode(replace(uri, '+', ' ')) AS decoded_uri FROM p),
rule(o, category, rule, severity, technique, pattern) AS (VALUES {_RULES}),
f AS (SELECT q.*, o, category, rule, severity, technique FROM q JOIN rule ON CASE WHEN category = '{g.AGENT_ONLY}' THEN regexp_matches(ua, pattern) WHEN category = '{g.AGENT_TOO}' THEN regexp_matches(uri || ' ' || decoded_uri, pattern) OR regexp_matches(ua, pattern) ELSE regexp_matches(uri || ' ' || decoded_uri, pattern) END),
lp AS (SELECT * FROM q WHERE method = 'POST' AND regexp_matches(lower(uri), '{'|'.join(g.LOGIN_PATHS)}')),
bf AS (SELECT ip, count(*) AS post_count, count(DISTINCT left(uri, 80)) AS endpoints, min(line_no) AS first_line, CASE WHEN count(*) > 50 THEN 'critical' ELSE 'high' END AS severity FROM lp GROUP BY ip HAVING count(*) >= 15),
ev AS (SELECT ip, sum(n) AS events, min((late, first_line)) AS o FROM (SELECT ip, count(*) AS n, min(line_no) AS first_line, 0 AS late FROM f GROUP BY ip UNION ALL SELECT ip, post_count, first_line, 1 FROM bf) GROUP BY ip),
top AS (SELECT * FROM ev ORDER BY events DESC, o LIMIT 10),
cat AS (SELECT category, count(*) AS events FROM (SELECT category FROM f UNION ALL SELECT '{g.BRUTE_FORCE}' FROM bf) GROUP BY category)
"""
_TS = "strptime(time, '%d/%b/%Y:%H:%M:%S %z')"
SQL = {
    "log_parse": _BASE + "SELECT * FROM q",
    "log_findings": _BASE + "SELECT line_no, ip, time, method, left(uri, 250) AS uri, status, left(ua, 150) AS ua, category, rule, upper(severity) AS severity, technique FROM f",
    "log_category_hist": _BASE + "SELECT * FROM cat",
    "log_category_share": _BASE + "SELECT category, round(least(1.0, events / greatest(1, (SELECT sum(events) FROM cat))), 4) AS share FROM cat",
    "log_severity_hist": _BASE + "SELECT s.severity, count(x.severity) AS events FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) s(severity) LEFT JOIN (SELECT severity FROM f UNION ALL SELECT 'high' FROM bf) x USING (severity) GROUP BY s.severity",
    "log_brute_force": _BASE + "SELECT ip, post_count, endpoints::INT AS endpoints, severity FROM bf",
    "log_top_attackers": _BASE + "SELECT ip, events::BIGINT AS events FROM top",
    "log_blocklist": _BASE + "SELECT ip, 'iptables -A INPUT -s ' || ip || ' -j DROP' AS iptables, 'deny ' || ip || ';' AS nginx FROM top WHERE events >= 3",
    "log_first_findings": _BASE + "SELECT line_no, ip, status, count(*)::INT AS attacks FROM f GROUP BY line_no, ip, status ORDER BY line_no LIMIT 50",
    "log_totals": _BASE + "SELECT (SELECT count(*) FROM q) AS requests, (SELECT count(DISTINCT ip) FROM q) AS addresses, (SELECT count(DISTINCT line_no) FROM f) + (SELECT count(*) FROM bf) AS suspicious",
    "log_rollup": _BASE + f"SELECT category, severity, strftime({_TS}, '%Y-%m-%d') AS day, count(*) AS events FROM f GROUP BY CUBE (category, severity, strftime({_TS}, '%Y-%m-%d'))",
    "log_hourly_window": _BASE + f"SELECT (floor(epoch({_TS}) / 1800) * 1800 - k * 1800)::BIGINT AS window_start, ip, count(*) AS posts FROM lp, (VALUES (0), (1)) t(k) GROUP BY ALL",
    "log_sessions": _BASE + f""", t AS (SELECT ip, epoch({_TS})::BIGINT AS s FROM q), d AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY ip ORDER BY s) <= 1800 THEN 0 ELSE 1 END AS b FROM t),
c AS (SELECT *, sum(b) OVER (PARTITION BY ip ORDER BY s ROWS UNBOUNDED PRECEDING) AS n FROM d) SELECT ip, min(s) AS session_start, count(*) AS requests FROM c GROUP BY ip, n""",
}


def closed_windows(late: int = 600) -> str:
    """The windows of log_hourly_window that end `late` seconds before the last login post, or earlier."""
    return SQL["log_hourly_window"].replace("FROM lp, (VALUES (0), (1)) t(k) GROUP BY ALL", f"FROM lp, (VALUES (0), (1)) t(k) WHERE floor(epoch({_TS}) / 1800) * 1800 - k * 1800 + 3600 <= (SELECT max(epoch({_TS})) FROM lp) - {late} GROUP BY ALL")
