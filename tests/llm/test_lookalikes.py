import unicodedata

from hypothesis import given
from hypothesis import strategies as st

from webwarden.llm import lookalikes as m

CASES = [
    ("nimbusfold.example", None),
    ("NimbusFold.Example", None),
    ("café-lumen.test", None),
    ("CAFÉ-lumen.test", None),
    ("café-lumen.test", "café-lumen.test"),
    ("nіmbusfоld.exаmple", "nimbusfold.example"),
    ("νеlоrapay.test", "velorapay.test"),
    ("ｎｉｍｂｕｓｆｏｌｄ．example", "nimbusfold.example"),
    ("𝚗imbusfold.example", "nimbusfold.example"),
    ("nimbus​fo­ld️.exam͏ple", "nimbusfold.example"),
    (" nimbusfold.example　", "nimbusfold.example"),
    (" nimbusfold.example ", "nimbusfold.example"),
    ("norvexgov‐id.test", "norvexgov-id.test"),
    ("ﬁloﬂora.test", "filoflora.test"),
    ("почта-двор.example", None),
    ("почта-​двор.example", "почта-двор.example"),
    ("데이터.test", None),
    (unicodedata.normalize("NFD", "데이터") + ".test", "데이터.test"),
    ("データ庫.example", None),
    ("ve10rapay.test", None),
    ("ɡildencɑrd.test", "gildencard.test"),
    ("", None),
    ("a" * 5000 + "і.test", "a" * 5000 + "i.test"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, h, "x") for i, (h, _) in enumerate(CASES)] + [(99, None, "x")], "id bigint, host string, raw string")
    got = {r["row_id"]: r["clean_form"] for r in m.consistent_hosts(m.host_values(df, "f", "id", "host")).collect()}
    assert got == {i: c for i, (_, c) in enumerate(CASES) if c is not None}


def test_lists_keep_positions_and_repeats(spark):
    odd = "nіmbusfold.example"
    df = spark.createDataFrame([(1, [None, "a.test", odd]), (1, [odd]), (2, None), (3, [])], "id bigint, san array<string>")
    got = sorted((r["row_id"], r["pos"], r["clean_form"]) for r in m.consistent_hosts(m.host_values(df, "f", "id", "san")).collect())
    assert got == [(1, 0, "nimbusfold.example"), (1, 2, "nimbusfold.example")]
    assert m.consistent_hosts(m.host_values(df.limit(0), "f", "id", "san")).count() == 0


def clean(spark, hosts, **more):
    df = spark.createDataFrame(list(enumerate(hosts)), "id bigint, host string")
    return {hosts[r["row_id"]]: r["clean_form"] for r in m.consistent_hosts(m.host_values(df, "f", "id", "host"), **more).collect()}


def test_public_confusables_and_capitals(spark):
    pairs = {"ɢildencard.test": "gildencard.test", "ʀelʙank.test": "relbank.test", "velοraραу.test": "velorapay.test", "bankηet.test": "banknet.test", "paτh.test": "path.test", "ѡallet.test": "wallet.test", "ԍift.test": "gift.test",
             "НОТeL.test": "hotel.test", "ВАNk.test": "bank.test", "Ꮤeb.test": "web.test", "ΜIRA.test": "mira.test", "МОСКВА.test": None, "straße-süd.test": None, "smørrebrød.test": None}
    assert clean(spark, list(pairs)) == {k: v for k, v in pairs.items() if v}


def test_vocabulary_decides_where_the_table_is_wrong(spark):
    # A palochka looks like l and like i, an Armenian vo like n and like u: the table has one letter for each.
    odd = ["vӏsta-bank.test", "veӏora.test", "ոimbus.test", "aոto.test", "ɪota.test", "ɪake.test"]
    plain = ["vista-bank.test", "velora.test", "nimbus.test", "auto.test", "iota.test", "lake.test"] * 2
    by_table = [m.table_form(h.split(".")[0]) + ".test" for h in odd]
    assert by_table != plain[:6] and sum(a != b for a, b in zip(by_table, plain)) == 3
    assert clean(spark, odd + plain) == dict(zip(odd, plain))
    assert clean(spark, odd[:1] + ["vlsta-bank.test", "vista-bank.test", "vista-bank.test"])[odd[0]] == "vista-bank.test"  # both are known: the more frequent
    assert clean(spark, odd) == dict(zip(odd, by_table))  # without a vocabulary the table decides


def test_budget_finds_spellings_in_any_shard(spark):
    odd = ["nіmbusfld.test", "nіmbusfoldd.test", "nіmbuxfold.test", "xnіmbusfold.test", "nіmbusxxfold.test", "rаre.test"]
    plain = ["nimbusfold.test"] * m.EDIT_RATIO + ["rarer.test"]
    assert clean(spark, odd + plain, budget=1.0) == {**dict.fromkeys(odd[:4], "nimbusfold.test"), odd[4]: "nimbusxxfold.test", odd[5]: "rare.test"}
    assert clean(spark, odd + plain)[odd[0]] == "nimbusfld.test"


LETTERS = "abcdeilnouv-" + "асеорхνοӏոυ" + "ａｂ" + "​­️" + "é"


@given(st.lists(st.text(alphabet=LETTERS, max_size=8), min_size=1, max_size=12), st.text(alphabet=LETTERS, min_size=1, max_size=8))
def test_walk_reaches_only_the_classes_of_the_table(vocabulary, label):
    trie = m.Trie()
    forms = [m.table_form(v) for v in vocabulary]
    for f in forms:
        if f == m.table_form(f):
            trie.add(f, 1)
    walked = trie.walk(label)
    assert walked is None or m.FIXED.route(walked) == m.FIXED.route(m.table_form(label))
    if m.table_form(label) in forms:
        assert walked is not None


def test_edits_cost():
    trie = m.Trie()
    trie.add("paypoint", 3)
    trie.add("paypaint", 1)
    assert trie.walk("paypant") is None
    assert trie.walk("paypant", 1.0) == "paypaint"
    assert trie.walk("paypint", 1.0) == "paypoint"  # equals go to the more frequent
    assert trie.walk("pаyxoint", 1.0) == "paypoint"
