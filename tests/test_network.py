import pytest
from pyspark.sql import functions as F

from webwarden.functions import network as n

OLD = "HTTP/1.1 302 Found\r\nLocation: /a\r\n\r\nHTTP/1.1 200 OK\r\nServer: Apache/2.2.15\r\nSet-Cookie: a=1\r\nCache-Control: no-store\r\n"
HARD = "HTTP/1.1 200 OK\r\n" + "\r\n".join(f"{h}: x" for h in n.SECURITY_HEADERS)


def test_headers(spark):
    df = spark.createDataFrame([(1, OLD), (2, HARD), (3, ""), (4, None), (5, "a: 1\nA: 2\nnocolon\n\nb:3")], "i int, raw string")
    h = n.parse_header_block(F.col("raw"))
    got = {r["i"]: r for r in df.select("i", h.alias("h"), n.header_risk(h).alias("r")).collect()}
    assert len(got[1]["h"]) == 2 and got[1]["r"]["outdated"] and got[1]["r"]["risk"] == 0.90 and got[1]["r"]["coverage"] == 0.0
    assert got[2]["r"]["coverage"] == 1.0 and got[2]["r"]["risk"] == 0.0
    assert got[3]["r"]["banner"] == "Unadvertised" and got[3]["r"]["risk"] == 0.35 and got[4]["r"]["risk"] == 0.35
    assert got[5]["h"] == [{"a": "1 ; 2"}, {"b": "3"}]


def test_ttl_and_entropy(spark):
    df = spark.createDataFrame([(x,) for x in (30, 60, 180, 3600, 0)], "t int")
    assert [r[0] for r in df.select(n.ttl_anomaly(F.col("t"))).collect()] == [1.0, 1.0, 0.5, 0.0, 0.0]
    e = spark.createDataFrame([(["a", "a"],), (["a", "b", "c", "d"],), ([],)], "x array<string>")
    assert [r[0] for r in e.select(n.network_entropy(F.col("x"))).collect()] == [0.0, 2.0, 0.0]


def test_fast_flux(spark):
    df = spark.createDataFrame([("d", ip) for ip in ("185.1.1.1", "194.1.1.1", "45.1.1.1")], "k string, ip string").select("k", n.network_of(F.col("ip")).alias("a"), F.lit(45).alias("ttl")).select("k", "a.asn", "a.reputation", "ttl")
    (r,) = n.fast_flux(df, "k", "asn", "reputation", "ttl").collect()
    assert (r["entropy"], r["diversity"], r["max_reputation"], r["flux_index"], r["verdict"]) == (0.9183, 0.9183, 0.95, 0.9564, "suspect")


@pytest.mark.parametrize("domain,issuer,want", [("paypal-security-auth-check.xyz", "Let's Encrypt", ("paypal", 1.0, "HIGH_RISK_PHISHING")), ("www.paypal.com", "DigiCert", ("paypal", 0.02, "BENIGN_OFFICIAL")), ("other.test", "X", (None, 0.02, "BENIGN_OFFICIAL"))])
def test_certificates(spark, domain, issuer, want):
    r = spark.createDataFrame([(domain, issuer)], "d string, i string").select(n.certificate_risk(F.col("d"), F.col("i"), {"paypal": ["paypal", "paypa1"]}).alias("r")).first()["r"]
    assert tuple(r) == want


def test_lookalikes(spark):
    df = spark.createDataFrame([("paypa1-login.tk",), ("www.paypal.com",), ("plain.test",), ("evil.xyz",)], "d string")
    got = [r[0] for r in df.select(n.lookalike(F.col("d"), ["paypal"])).collect()]
    assert [g["keep"] for g in got] == [True, False, False, True]
    assert got[0]["triggers"] == ["abuse_tld", "homoglyph", "hyphen", "lure_word"] and got[0]["level"] == "CRITICAL" and got[3]["level"] == "SUSPICIOUS"


def test_chains(spark):
    rows = [(1, 0, "https://a.test/"), (1, 1, "http://bit.ly/x?url=y"), (1, 2, "http://c.test/"), (2, 0, "https://a.test/?next=z")]
    got = {r["c"]: r for r in n.redirect_chains(spark.createDataFrame(rows, "c int, h int, u string"), ["c"], "h", "u").collect()}
    assert (got[1]["hops"], got[1]["hosts"], got[1]["has_shortener"], got[1]["has_open_redirect"], got[1]["has_downgrade"], got[1]["risk"]) == (3, 3, True, True, True, 1.0)
    assert got[2]["risk"] == 0.0


def test_relays(spark):
    cols = [F.col(c) for c in ("url", "s", "b", "c", "t", "f", "o", "d")]
    df = spark.createDataFrame([("https://login.x.test", 0.9, "paypal", False, True, True, False, None), ("https://x.test", 0.9, "paypal", True, True, True, False, None), ("https://login.x.test", 0.7, "paypal", False, False, False, False, "")], "url string, s double, b string, c boolean, t boolean, f boolean, o boolean, d string")
    assert [tuple(r[0]) for r in df.select(n.relay_suspicion(*cols)).collect()] == [(True, "HIGH", 0.35), (False, "NONE", 0.0), (True, "MEDIUM", 0.2)]
