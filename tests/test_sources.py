import json

from pyspark.sql import functions as F

from webwarden.sources import readers as r
from webwarden.sources import sinks
from webwarden.streaming import feeds


def test_brands_and_snapshots(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"brand_id": "a", "canonical_domains": ["A.test"]}, {"brand_id": "b"}]))
    got = sorted(map(tuple, r.brand_domains(r.brands(spark, str(tmp_path / "b.json"))).collect()))
    assert got == [("a", "a.test"), ("b", "b.com")]
    (tmp_path / "ref/acme").mkdir(parents=True)
    (tmp_path / "ref/acme/dom.html").write_text("<p>é</p>")
    (tmp_path / "ref/acme/b.png").write_bytes(b"2")
    (tmp_path / "ref/acme/a.png").write_bytes(b"1")
    assert [tuple(x) for x in r.snapshots(spark, str(tmp_path / "ref")).collect()] == [("acme", "<p>é</p>")]
    assert [(x[0], bytes(x[1])) for x in r.reference_images(spark, str(tmp_path / "ref")).collect()] == [("acme", b"1")]


def test_labelled_files(spark, tmp_path):
    (tmp_path / "phish.txt").write_text("http://a.test\n1\thttp://b.test\nhttp://c.test\t-1\n\n")
    assert sorted(map(tuple, r.labelled_text(spark, str(tmp_path / "phish.txt")).collect())) == [("http://a.test", 1), ("http://b.test", 1), ("http://c.test", 0)]
    (tmp_path / "feed.txt").write_text("# c\n! x\n[Adblock]\nbad.test\nhttps://x.test/a\nnodots\nbad.test\n")
    assert sorted(x[0] for x in r.blocklist_feed(spark, str(tmp_path / "feed.txt")).collect()) == ["http://bad.test", "https://x.test/a"]
    (tmp_path / "t.csv").write_text("Id,Site_URL,Class\n1,http://a.test,benign\n2,http://b.test,bad\n3,,bad\n")
    assert sorted(map(tuple, r.guessed_table(spark, str(tmp_path / "t.csv")).collect())) == [("http://a.test", 0), ("http://b.test", 1)]
    (tmp_path / "u.csv").write_text("x\n1\n")
    assert r.guessed_table(spark, str(tmp_path / "u.csv")).count() == 0
    (tmp_path / "names").mkdir()
    (tmp_path / "names/shot-a.test_01.png").write_bytes(b"x")
    assert [x[0] for x in r.urls_in_names(spark, str(tmp_path / "names"), "shot-").collect()] == ["http://a.test"]
    assert [tuple(x) for x in r.urls_in_cells(spark.createDataFrame([("http://a.test", 1), (None, 2)], "a string, b int")).collect()] == [("http://a.test", 1)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.7, None), ("b", 0.1, 0.5)], "line string, score double, s_dom double")
    sinks.write_lines(df, "line", str(tmp_path / "l"))
    assert sorted(x[0] for x in spark.read.text(str(tmp_path / "l")).collect()) == ["a", "b"]
    sinks.write_verdicts(df, str(tmp_path / "v"))
    assert sorted(x["verdict"] for x in spark.read.csv(str(tmp_path / "v"), header=True).collect()) == ["phishing", "safe"]
    target = str(tmp_path / "sent.txt")

    def send(text):
        with open(target, "a") as f:
            f.write(text)

    sinks.dispatcher("line", send)(df, 0)
    assert sorted(open(target).read()) == ["a", "b"]
    assert [x[0] for x in spark.createDataFrame([("ftp://x",), ("https://x/y",)], "u string").select(sinks.valid_hook(F.col("u"))).collect()] == [False, True]


def test_stream_drops_repeats(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    spark.createDataFrame([("k", t, 1), ("k", t, 2), ("j", t, 3)], "k string, at timestamp, i int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, at timestamp, i int").parquet(str(tmp_path / "in"))
    assert sorted(x["k"] for x in feeds.run_to_end(feeds.first_deliveries(stream, "k", "at")).collect()) == ["j", "k"]


def test_stream_lookalikes_equal_batch(spark):
    from webwarden.plans import network, streams

    sf = "/root/testdata/sf0.001"
    assert sorted(map(str, streams.stream_lookalikes(spark, sf).collect())) == sorted(map(str, network.cert_lookalike(spark, sf).collect()))
