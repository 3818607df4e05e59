import hashlib

from pyspark.sql import functions as F

from webwarden.functions import documents as d
from webwarden.functions import forensics as f
from webwarden.functions import html as h


def test_semantic_text_is_whole(spark):
    words = " ".join(f"w{i}" for i in range(200))
    page = f'<html><head><title>Acme</title></head><body><p>{words} <b>sign in</b> to acme</p><form action="/In"><input name="User" placeholder="Mail"></form><span>Go <i>on</i></span><script>no()</script></body></html>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "<p></p>")], "id bigint, html string")
    (r,) = d.spoken_texts(df, "id", "html").collect()
    assert r["page_id"] == 1 and r["text"] == f"acme {words} sign in to acme go on acme /in user mail goon"
    (n,) = f.semantic_text(h.html_nodes(df, "id", "html")).collect()
    assert words in n["text"]


def test_document_is_linear_on_unclosed_elements():
    doc = d.Document("<div>x" * 5000)
    assert [doc.short_text(i) == "" for i in (0, 4880, 4999)] == [True, False, False] and len(doc.said) == 5000


def brute_fingerprint(paths, tags):
    features = [(p, 3 if "form" in p or "input" in p else 1) for p in paths] + [(f"{a}_{b}", 1) for a, b in zip(tags, tags[1:])]
    bits = [sum(w if int(hashlib.md5(t.encode()).hexdigest()[:16], 16) >> i & 1 else -w for t, w in features) > 0 for i in range(64)]
    return f"{sum(1 << i for i, b in enumerate(bits) if b):016x}"


def test_layout_fingerprint(spark):
    nested = "<html><head><title>t</title></head><body><div><p>a</p><p>b</p></div><form><input type='Password'><input></form></body></html>"
    flat = nested.replace("<div>", "<div></div>").replace("</p></div>", "</p>")
    text = nested.replace("Password", "text")
    df = spark.createDataFrame([(1, nested), (2, flat), (3, text), (4, "  "), (5, "a")], "id bigint, html string")
    got = {r["page_id"]: r["fingerprint"] for r in d.layout_fingerprints(df, "id", "html").collect()}
    form = lambda kind: ["html>body>form", f"html>body>form>input_{kind}", "html>body>form>input_text"]
    tags = lambda kind: ["html", "body", "div", "p", "p", "form", f"input_{kind}", "input_text"]
    deep, wide = ["html>body>div>p"] * 2, ["html>body>div", "html>body>p", "html>body>p"]
    assert got == {1: brute_fingerprint(deep + form("password"), tags("password")), 2: brute_fingerprint(wide + form("password"), tags("password")), 3: brute_fingerprint(deep + form("text"), tags("text")), 4: "0" * 16, 5: brute_fingerprint(["html>[document]"], [])}
    assert len({got[1], got[2], got[3]}) == 3


def test_brand_search_rates_what_a_page_says(spark):
    page = lambda words: f"<html><body><h1>{words}</h1><form><input type='password'></form></body></html>"
    other = "<html><body><ul>" + "<li>text</li>" * 30 + "</ul></body></html>"
    refs = spark.createDataFrame([("acme", ["acme", "acme bank", "acme.test"], page("x")), ("zeta", ["zeta"], page("y"))], "brand string, words array<string>, html string")
    df = spark.createDataFrame([(1, page("zeta, like acme bank at acme.test")), (2, page("nobody")), (3, other + "zeta"), (4, other), (5, "")], "id bigint, html string")
    got = {r["id"]: (r["brand"], r["score"]) for r in f.reference_match(df, refs, "id", "html").collect()}
    assert got[1] == ("acme", 1.0) and got[2] == ("acme", 1.0) and got[3][0] == "zeta" and got[4] == (None, 0.0) and 5 not in got
    shape = {"forms": 0, "passwords": 0, "submits": False}
    a, b = (d.Layout(d.Document(m), m, shape) for m in (other, page("y")))
    assert got[3][1] == min(1.0, round(0.55 * 0.5 + 0.45 * round(a.similarity(b) - 0.25 * 0.8, 4), 4) + 0.20)
    assert d.signature_score("acme bank", ["acme", "acme bank", "acme.test"]) == 0.7 and d.signature_score("x", ["acme"]) == 0.0


def test_page_audit(spark):
    bad = """<html><head><link rel="Shortcut Icon" href="//cdn.test/i.ico"><script src="https://x.evil.top/a.js"></script><script src="https://acme.test/b.js"></script></head><body>
    <a href="https://evil.test/p">Sign in at <b>paypal</b></a><a href="https://evil.test/q"><img src="data:x"></a><a href="#"></a><a href="javascript:void(0)">x</a><a href="/in">in</a><img src="https://cdn.test/1.png"></body></html>"""
    plain = '<html><body><a href="https://acme.test/">acme.com</a><img src="/a.png"></body></html>'
    df = spark.createDataFrame([(1, bad, ["acme.test"]), (2, plain, ["acme.test"]), (3, bad, None), (4, "<p>x</p>", None)], "id bigint, html string, official array<string>")
    got = {r["page_id"]: r for r in d.page_audit(df, "id", "html", F.lit("www.own.test"), F.col("official")).collect()}
    r = got[1]
    assert (r["links"], r["null_share"], r["internal_share"], r["external_share"], r["empty_share"], r["anchor_discrepancies"]) == (5, 0.4, 0.2, 0.4, 0.2, 1)
    assert (r["external_resource_share"], r["favicon_mismatch"], r["foreign_scripts"]) == (0.75, True, ["https://x.evil.top/a.js"])
    assert r["techniques"] == "T1566.002 (Spearphishing Link: Anchor Text Discrepancy) / T1059.007 (JavaScript Execution from Untrusted Source)"
    assert len(r["highlights"]) == 5 and "'sign in atpaypal'" in r["highlights"][1]
    assert (got[2]["external_share"], got[2]["external_resource_share"], got[2]["favicon_mismatch"], got[2]["techniques"]) == (0.0, 0.0, False, "N/A")
    assert got[3]["foreign_scripts"] == [] and got[3]["external_resource_share"] == 1.0 and got[4]["links"] == 0


def test_content_model(spark):
    page = "<html><head><title>Own</title><style>abc</style><script>alert(1)</script><!--note--></head><body><form>\n<input name='Pass'>Go &amp; on</form><a href='https://b.test/'>b</a><a href='https://own.test/'>o</a></body></html>"
    df = spark.createDataFrame([(1, page, "https://own.test/"), (2, "<p>x</p>", "http://1.2.3.4/login")], "id bigint, html string, url string")
    got = {r["page_id"]: r for r in d.content_model(df, "id", "html", F.col("url")).collect()}
    r = got[1]
    assert (r["html_len_tag"], r["html_len"], r["brand_domain"]) == (3 + 8 + 4 + 8, 3 + 8 + 2, 0)
    assert (r["internal_link"], r["external_link"], r["login_form"], r["alarm_window"], r["title_domain"], r["domain_occurrence"]) == (1, 1, 1, 1, 1, 1)
    assert r["score"] == round((1 + 1 + 2) / 23, 4)
    assert (got[2]["score"], got[2]["brand_domain"], got[2]["html_len"]) == (round(4 / 11, 4), 1, 0)


def test_seen_text_hides_whole_subtrees(spark):
    hiding = ["display : none", "VISIBILITY:hidden", "opacity:0", "font-size:0", "left:-9999px", "text-indent: -500px", "transform:scale(0)", "max-height:0"]
    page = "<p>Hi\u200bdden <b>t</b>ext</p><div style='display:none'>no <p>no <b>no</b></p></div><section hidden><p>no</p></section><div aria-hidden='TRUE'><span>no</span></div><noscript>no</noscript>" + "".join(f'<div style="{h}"><i>no</i></div>' for h in hiding) + "<!-- no --><p>seen</p> tail"
    rows = [(1, page), (2, "<p>plain</p>"), (3, "<p hidden>x</p><p>y</p>"), (4, "a\u00adb"), (5, None)]
    got = {r["page_id"]: (r["text"], r["obfuscated"]) for r in d.seen_texts(spark.createDataFrame(rows, "id bigint, html string"), "id", "html").collect()}
    assert got == {1: ("Hidden t ext seen tail", True), 2: ("plain", False), 3: ("y", False), 4: ("ab", True)}
