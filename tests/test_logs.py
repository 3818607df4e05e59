from webwarden.functions import logs as g
from webwarden.plans import logs as plans

AUTH = '10.0.0.9 - - [10/Oct/2025:13:55:{:02d} +0000] "POST /auth/login HTTP/1.1" 401 512 "-" "Mozilla/5.0"'
LINES = [
    '192.0.2.1 - - [10/Oct/2025:13:55:36 +0000] "GET /index.html HTTP/1.1" 200 2326 "-" "Mozilla/5.0"',
    '192.0.2.2 - - [10/Oct/2025:13:55:37 +0000] "GET /i?id=1+UNION+SELECT+x HTTP/1.1" 200 - "-" "Mozilla/5.0"',
    '192.0.2.3 - - [10/Oct/2025:13:55:38 +0000] "GET /../../etc/passwd HTTP/1.1" 404 0 "-" "Nikto/2.1"',
    '192.0.2.4 - - [10/Oct/2025:13:55:39 +0000] "GET /q?x=%3Cscript%3E HTTP/1.1" 200 1 "-" "Mozilla/5.0"',
    '192.0.2.5 - - [10/Oct/2025:13:55:40 +0000] "GET /r?c=/bin/sh HTTP/1.1" 200 1 "-" "curl/8.0"',
]


def parsed(spark, lines):
    return g.parse_lines(spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string"))


def test_fields(spark):
    odd = ['1.1.1.1 - - [x] "" 200 5 "-" "a"', '1.1.1.1 - - [x] "/only" 200 5 "-" "a"', '1.1.1.1 - - [x] "GET /a b%2" 200 5 "-" "a"', "garbage", "", None]
    got = {r["line_no"]: (r["method"], r["uri"], r["proto"], r["size"]) for r in parsed(spark, LINES[:2] + odd).collect()}
    assert got == {
        0: ("GET", "/index.html", "HTTP/1.1", 2326), 1: ("GET", "/i?id=1+UNION+SELECT+x", "HTTP/1.1", 0), 2: ("GET", "/", "HTTP/1.1", 5), 3: ("GET", "/only", "HTTP/1.1", 5), 4: ("GET", "/a b%2", "HTTP/1.1", 5),
    }


def test_report(spark):
    p = parsed(spark, LINES + [AUTH.format(i) for i in range(25)])
    assert p.count() == 30 and p.select("ip").distinct().count() == 6
    found = {r["ip"]: [a["category"] for a in r["attacks"]] for r in g.findings(p).collect()}
    assert found["192.0.2.2"] == ["SQL Injection"] and found["192.0.2.3"][-1] == "Automated Scanner" and found["192.0.2.4"] == ["Cross-Site Scripting"] and "Command Injection / Webshell" in found["192.0.2.5"]
    (b,) = g.brute_force(p).collect()
    assert (b["ip"], b["post_count"], b["severity"]) == ("10.0.0.9", 25, "high")
    assert {r["severity"]: r["events"] for r in g.severity_counts(p).collect()}["medium"] == 1
    assert g.top_attackers(p).first()["ip"] == "10.0.0.9"
    assert [r["ip"] for r in g.blocklist(p).collect()][0] == "10.0.0.9"


def test_thresholds(spark):
    for n, want in ((14, None), (15, "high"), (50, "high"), (51, "critical")):
        got = g.brute_force(parsed(spark, [AUTH.format(i % 60) for i in range(n)])).collect()
        assert [r["severity"] for r in got] == ([want] if want else [])


def test_findings_do_not_repeat_the_parsing(spark):
    plan = g.findings(parsed(spark, LINES))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") < 40


def test_stream_equals_batch(spark):
    from webwarden.plans import streams

    sf = "/root/testdata/sf0.001"
    last = g.login_posts(plans.parsed(spark, sf)).agg(g.F.unix_timestamp(g.F.max(g.event_time(g.F.col("time"))))).first()[0]
    batch = sorted(tuple(r) for r in plans.log_hourly_window(spark, sf).collect() if r["window_start"] + 3600 <= last - 600)
    assert len(batch) > 100 and sorted(map(tuple, streams.stream_login_windows(spark, sf).collect())) == batch
