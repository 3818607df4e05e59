import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webwarden.functions import urls as u

BRANDS = ["paypal", "google", "github", "microsoft", "amazon", "bankofamerica", "chase", "dhl"]


def rows(spark, urls):
    return spark.createDataFrame([(i, x) for i, x in enumerate(urls)], "i int, url string")


def lexical(spark, url, canonical=False):
    h = F.lower(u.host(F.col("url")))
    df = rows(spark, [url]).withColumn("host", h)
    df = df.join(u.nearest_brands(df.select("host").distinct(), BRANDS), "host", "left")
    return df.select("near.*", u.lexical_score(F.col("host"), F.col("near"), F.lit(canonical), F.col("url")).alias("s")).first()


def test_known_scores(spark):
    r = lexical(spark, "http://paypa1-secure.tk/login")
    assert (r["distance"], r["similarity"], r["brand"], r["s"]) == (1, 0.8333, "paypal", 1.0)
    assert lexical(spark, "https://paypal.com", True)["s"] == 0.02
    assert lexical(spark, "http://paypal-update-account.com/auth")["s"] >= 0.55
    assert lexical(spark, "http://xn--80ak6aa92e.com")["s"] >= 0.4
    assert lexical(spark, "http://192.168.1.1:8080/login")["s"] >= 0.55
    r = lexical(spark, "http://paypal.com.account-update-security.tk/login")
    assert r["brand"] == "paypal" and r["s"] >= 0.70


def test_nlp_risk(spark):
    got = [r[0] for r in rows(spark, ["https://example.com/about/company", "http://auth-verify-account-update-login.xyz/session", "", None]).orderBy("i").select(u.nlp_risk(F.col("url"))).collect()]
    assert got[:3] == [0.0759, 0.9939, 0.0] and got[3] in (None, 0.0)


def test_measures_keep_the_contract(spark):
    df = rows(spark, ["http://paypal-security-update.xyz/login?id=99283"]).select(u.url_struct(F.col("url")).alias("s"))
    m = u.lexical_measures(F.col("s"))
    assert len(m) == 79 and list(m)[:3] == ["Querylength", "domain_token_count", "path_token_count"] and list(m)[-1] == "Entropy_Afterpath"
    r = df.select(*[c.alias(k.replace(".", "_")) for k, c in m.items()]).first()
    assert r["urlLen"] == 48 and r["Entropy_URL"] > 3 and r["URL_sensitiveWord"] >= 1


@pytest.mark.parametrize("host,want", [("192.168.1.1", True), ("192.168.1.1:8080", True), ("::1", True), ("[::1]:80", True), ("2001:db8::7", True), ("256.1.1.1", False), ("example.com", False), ("", False)])
def test_addresses(spark, host, want):
    assert rows(spark, [host]).select(u.is_ip(F.col("url"))).first()[0] is want


def test_parts(spark):
    h = u.host(F.col("url"))
    df = rows(spark, ["https://a.b.shop.co.example:81/p/q.html;x?y=1#z", "shop.test", "http://1.2.3.4/", None])
    got = [tuple(r) for r in df.orderBy("i").select(h, u.registered(h), u.subdomain(h), u.suffix(h), u.path(F.col("url")), u.query(F.col("url"))).collect()]
    assert got[0] == ("a.b.shop.co.example", "shop.co.example", "a.b", "co.example", "/p/q.html;x", "y=1")
    assert got[1][:4] == ("shop.test", "shop.test", "", "test") and got[2][:4] == ("1.2.3.4", "1.2.3.4", "", "")


def test_targets_and_endpoints(spark):
    df = rows(spark, ["https://g.test/url?x=1&next=https%3A%2F%2Fa.test%2F&q=no", "https://api.telegram.org/bot1:a/sendMessage", "http://1.2.3.4:8080/x", "https://a.test/gate.php", "https://a.test/"]).orderBy("i")
    assert df.select(u.redirect_target(F.col("url"))).first()[0] == "https://a.test/"
    assert [r[0] for r in df.select(u.c2_endpoint(F.col("url")).family).collect()] == ["Standard Web Resource", "Telegram Bot API Exfiltration Drop", "Direct IP C2 Exfiltration Endpoint", "Automated Script Credential Harvester (.php/.asp gate)", "Standard Web Resource"]


def test_hmac_equals_the_library(spark):
    import hashlib
    import hmac

    got = rows(spark, ["https://a.test/é"]).select(u.hmac_sha256(b"key", F.col("url"))).first()[0]
    assert got == hmac.new(b"key", "https://a.test/é".encode(), hashlib.sha256).hexdigest()


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cc"]), max_size=20))
def test_entropy(spark, text):
    df = spark.createDataFrame([(text, text[::-1])], "a string, b string")
    a, b = df.select(u.entropy(F.col("a")), u.entropy(F.col("b"))).first()
    want = -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text)) if text else 0.0
    assert a == pytest.approx(want, abs=1e-9) and b == pytest.approx(want, abs=1e-9)
