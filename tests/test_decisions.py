import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from webwarden.functions import decide as d
from webwarden.functions import exports as x
from webwarden.functions import vectors as v
from webwarden.operators import models, registry


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_closed_form(spark):
    s = lambda lex, dom, vis, dns, canon: d.closed_form(F.lit(lex), F.lit(dom).cast("double"), F.lit(vis).cast("double"), F.lit(dns), F.lit(canon))
    assert tuple(one(spark, s(0.85, 0.80, 0.92, 0.595, False), s(0.9, 0.9, 0.9, 0.9, True), s(0.03, 0.0, 0.0, 0.5, False), s(0.5, None, 0.9, 0.05, False))) == (0.8314, 0.02, 0.03, 0.206)


def test_vector_positions(spark):
    lex = {k: F.lit(0.0) for k in d.VECTOR[:13]} | {"s_lex": F.lit(0.85), "is_canonical": F.lit(False), "is_suspicious_tld": F.lit(False)}
    f = d.fusion_vector(lex, F.lit(0.8), F.lit(0.92))
    assert list(f) == d.VECTOR and len(f) == 23
    r = one(spark, *[f[k].alias(k) for k in d.VECTOR])
    assert round(r["dns_score"], 4) == 0.595 and r["max_similarity"] == 0.92 and r["visual_unavailable"] == 0.0


def test_attribution_sums_to_one(spark):
    r = one(spark, d.group_attribution(F.array(*[F.lit(float(i)) for i in range(-11, 12)])).alias("g"))["g"]
    assert sum(r) == pytest.approx(1, abs=2e-4)
    assert tuple(one(spark, d.group_attribution(F.array(*[F.lit(0.0)] * 23)).alias("g"))["g"]) == (0.28, 0.28, 0.28, 0.16)


def test_consistency_and_order_of_steps(spark):
    c = lambda host, brand, vis: d.consistency(F.lit(host), F.lit(brand), F.lit(vis), F.lit(0.5), F.array(F.lit("pay.test")))
    assert tuple(one(spark, c("a.pay.test", "pay", 0.9), c("evilpay.test", "pay", 0.9), c("x.test", "", 0.9))) == ((True, False, 0.78), (False, True, 0.78), (True, False, 0.0))
    up, floor, cap = (F.lit(True), "add", F.lit(0.3)), (F.lit(True), "floor", F.lit(0.5)), (F.lit(True), "cap", F.lit(0.05))
    assert [round(e, 4) for e in one(spark, d.elevated(F.lit(0.3), [up, floor]), d.elevated(F.lit(0.3), [floor, up]), d.elevated(F.lit(0.9), [up, cap]))] == [0.6, 0.8, 0.05]


def test_exports(spark):
    rules = x.firewall_rules(F.lit(None).cast("string"), F.lit(None).cast("string"))
    r = one(spark, rules["packet_filter"], rules["dns_zone"], x.indicator(F.lit("http://a'b"), F.lit(0.7), F.lit("p")), x.indicator(F.lit("u"), F.lit(0.2), F.lit("p")), x.takedown(F.lit("u"), F.lit("a.co.test"), F.lit(None).cast("string"), F.lit("p"), {"test": "t", "co.test": "c"}).contact)
    assert "0.0.0.0" in r[0] and r[1] == "invalid CNAME ." and "malicious-activity" in r[2] and r[3] is None and r[4] == "c"
    df = spark.createDataFrame([(1, "h", 0.9), (2, "h", 0.5), (3, "127.0.0.1", 0.9), (4, "", 0.9), (5, "low", 0.1)], "o int, host string, s double")
    assert [tuple(r) for r in x.blocklist(df, "host", "s", "o").collect()] == [("h", 1)]


def test_packages(spark):
    df = spark.createDataFrame([(1, "dom", None), (2, "", "tls")], "id bigint, dom string, tls string")
    rows = {r["id"]: zipfile.ZipFile(io.BytesIO(r["archive"])) for r in x.packages(df, "id", ["dom", "tls"]).collect()}
    assert rows[1].namelist() == ["dom.txt", "checksums.txt"] and rows[2].read("tls.txt") == b"tls"


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(120, 8)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vecs)] + [(500, [0.0] * 8)], "id bigint, v array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in v.nearest(df.filter("id % 40 = 0"), df, "id", "v", 3, 4).collect()}
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for q in (0, 40, 80):
        s = np.round(unit @ unit[q], 4)
        s[q] = -9
        assert [got[(q, k)] for k in (1, 2, 3)] == sorted(range(120), key=lambda i: (-s[i], i))[:3]


def test_images():
    a = np.tile(np.arange(9), (8, 1))
    assert v.grey_fingerprint(a) == 0 and v.grey_fingerprint(a[:, ::-1]) == 2**64 - 1
    assert v.shrunk(np.ones((80, 120)), 8, 9).shape == (8, 9)
    code = np.full((80, 120), 255)
    code[::2] = 0
    assert v.code_likelihood(code) == (0.95, True) and v.code_likelihood(np.full((4, 4), 128)) == (0.0, False)
    (first, *_), = [v.colour_signature(np.zeros((4, 6, 3)))]
    assert first == ((0, 0, 0), (2.5, 1.5), 24)


def test_registry(spark):
    b = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    up = registry.upsert(b, spark.createDataFrame([(" A ", 5, 1), ("a", 6, 2), ("c", 7, 1), (None, 8, 1)], "k string, v int, o int"), "k", "o")
    assert sorted(map(tuple, up.collect())) == [("a", 6), ("b", 2), ("c", 7)]
    assert [tuple(r) for r in registry.remove(b, spark.createDataFrame([("B",)], "k string"), "k").collect()] == [("a", 1)]
    rows = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    for cap, want in ((None, 100), (30, 30)):
        got = {r["label"]: r["count"] for r in registry.balanced(rows, "label", "id", cap).groupBy("label").count().collect()}
        assert got == {0: want, 1: want}
    assert registry.balanced(rows.limit(0), "label", "id").count() == 0


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1)], "y int, s double")
    r = models.metrics(df, "y", "s").first()
    assert (r["rows"], r["accuracy"], r["precision"], r["recall"], r["fpr"], r["auc"]) == (4, 0.5, 0.5, 0.5, 0.5, 0.75)


def test_each_elevation(spark):
    t = lambda start=0.3, canonical=False, lex=0.2, **k: d.threat_score(F.lit(start), F.lit(canonical), F.lit(lex), {n: F.lit(v) for n, v in k.items()})
    flags = {"inconsistent": 0.85, "kit": 0.9, "qr_lure": 0.6, "form_mismatch": 0.85, "formless_secret": 0.85, "exfiltration": 0.9, "fake_window": 0.92, "anchor_discrepancy": 0.88, "unhandled_form": 0.82, "dead_links": 0.5, "hidden_text": 0.55, "content_swap": 0.85, "content_brand": 0.8}
    assert [round(x, 4) for x in one(spark, *[t(**{k: True}) for k in flags])] == list(flags.values())
    assert set(flags) | {"redirect_boost", "relay_boost", "cloaked", "url_ensemble", "content_risk"} == {e[0] for e in d.ELEVATIONS} and len(d.ELEVATIONS) == 18
    got = one(spark, t(redirect_boost=0.25), t(relay_boost=0.4), t(cloaked=True, lex=0.34), t(cloaked=True, lex=0.4), t(url_ensemble=0.69), t(url_ensemble=0.8), t(0.95, url_ensemble=0.7), t(content_risk=0.59), t(content_risk=0.6))
    assert [round(x, 4) for x in got] == [0.55, 0.7, 0.3, 0.4, 0.3, 0.65, 0.95, 0.3, 0.39]
    every = {k: True for k in flags} | {"redirect_boost": 0.25, "relay_boost": 0.4, "cloaked": True, "url_ensemble": 0.9, "content_risk": 0.9}
    order = one(spark, t(0.0, hidden_text=True, unhandled_form=True), t(0.0, hidden_text=True, content_brand=True), t(**every), t(canonical=True, **every), t(0.01, canonical=True, kit=True), t(0.01, canonical=True, relay_boost=0.02), t(kit=None))
    assert [round(x, 4) for x in order] == [1.0, 0.8, 1.0, 0.05, 0.01, 0.03, 0.3]
    with pytest.raises(ValueError):
        t(other=True)


def test_synchronised_and_importance(spark):
    s = lambda b, x, y: F.struct(*d.synchronised(F.lit(b), F.lit(x), F.lit(y)))
    assert [tuple(r) for r in one(spark, s(None, 0.9, 0.9), s("a", 0.0, 0.0), s("a", 0.2, None), s("", 0.1, 0.1))] == [(0.0, 0.0), (0.4, 0.5), (0.2, 0.5), (0.0, 0.0)]
    (r,) = one(spark, d.importance(F.array(*[F.lit(float(x)) for x in range(4)]), F.array(*[F.lit(x) for x in (0.1, -0.5, 0.5, 0.0)]), ["a", "b", "c", "d"]))
    assert [tuple(x) for x in r] == [("b", 1.0, -0.5, "BENIGN ANCHOR"), ("c", 2.0, 0.5, "ELEVATES RISK"), ("a", 0.0, 0.1, "ELEVATES RISK"), ("d", 3.0, 0.0, "BENIGN ANCHOR")]


def test_models_are_saved_and_fall_back(spark, tmp_path):
    rows = spark.range(200).select("id", (F.col("id") % 2).cast("int").alias("y"), ((F.col("id") % 2) * 3 + F.rand(1)).alias("a"))
    path, trained = f"file://{tmp_path}/model", []

    def train():
        trained.append(1)
        return models.ensemble(rows, ["a"], "y", "id")

    first = models.loaded(spark, path, train)
    again = models.loaded(spark, path, train)
    assert len(trained) == 1
    scores = lambda m: [r["score"] for r in models.ensemble_score(m, rows).orderBy("id").limit(6).collect()]
    assert scores(first) == scores(again) and scores(first)[0] < 0.5 < scores(first)[1]
    without = again.copy()
    without.stages = [s for s in again.stages if type(s).__name__ != "RandomForestClassificationModel"]
    assert scores(without)[0] < 0.5 < scores(without)[1]
    for f in (tmp_path / "model" / "metadata").iterdir():
        f.unlink()
    models.loaded(spark, path, train)
    assert len(trained) == 2
