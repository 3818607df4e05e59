from pyspark.sql import functions as F

from webwarden import engine

BRANDS = "brand_id string, display_name string, canonical_domains array<string>"
LOGIN = "<html><body><h1>Acme Bank</h1><form action='/in'><input name=user><input type=password name=pw><button>Sign in</button></form><p>Welcome to acmebank, your acme bank.</p></body></html>"


def test_requests_are_accepted_or_rejected(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate([" https://a ", "a.test", "HTTP://b", "word", "", "  ", None])], "id int, url string, reason_before string")
    accepted, rejected = engine.split_requests(df)
    assert sorted((r["id"], r["url"]) for r in accepted.collect()) == [(0, "https://a"), (1, "a.test"), (2, "HTTP://b")]
    assert sorted((r["id"], r["reason"]) for r in rejected.collect()) == [(3, "malformed"), (4, "blank"), (5, "blank"), (6, "blank")]


def test_scan(spark):
    brands = spark.createDataFrame([("acmebank", "Acme Bank", ["acmebank.test"]), ("other", None, None)], BRANDS)
    references = spark.createDataFrame([("acmebank", ["acmebank", "acme bank"], LOGIN)], "brand string, words array<string>, html string")
    rows = [
        (1, "https://acmebank.test/login", LOGIN, 0), (2, "https://acmebank-login.xyz/in", LOGIN, 0), (3, "https://garden.test/", "<p>roses and tulips</p>", 0), (4, "https://acmebank-verify.xyz/", None, 0), (5, "word", LOGIN, 0), (6, None, LOGIN, 0),
        (7, "https://garden.test/x", LOGIN.replace("Welcome", "<script>send('gate/post.php')</script>evilproxy Welcome"), 0),
    ]
    pages = spark.createDataFrame(rows, "capture_id bigint, url string, dom_html string, host int")
    got = {r["id"]: r for r in engine.scan(pages, brands, references).collect()}
    assert set(got) == {1, 2, 3, 4, 7}
    assert (got[1]["brand"], got[1]["verdict"], got[1]["kind"]) == ("acmebank", "safe", "Legitimate Authoritative Portal") and got[1]["score"] <= 0.05
    assert (got[2]["brand"], got[2]["verdict"], got[2]["target"]) == ("acmebank", "phishing", "acmebank") and got[2]["score"] >= 0.85
    assert (got[3]["brand"], got[3]["verdict"], got[3]["s_dom"]) == (None, "safe", 0.0)
    assert (got[4]["confidence"], got[4]["s_dom"]) == ("reduced", None)
    assert got[7]["score"] >= 0.90
    assert engine.summarize(engine.scan(pages, brands, references)).select("total", F.col("phishing") + F.col("suspicious") + F.col("safe")).first() == (5, 5)
    assert engine.scan(pages.limit(0), brands, references).count() == 0
