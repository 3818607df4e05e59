import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from webwarden.llm import nearcopies as m


def words(markup):
    text = re.sub(r"(?s)<!--.*?-->", "", markup)
    text = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "", text)
    return [w.lower() for w in re.findall(r"[^\W_]+", re.sub(r"<[^>]*>", " ", text))]


def brute(rows, least=60, similarity=0.6):
    sets = {i: set(zip(w, w[1:], w[2:])) for i, h in rows if h and len(w := words(h)) >= least}
    return sorted((a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity)


def corpus(seed, n):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Überall", "naïve", "x_y"]
    rows, kept = [], []
    for i in range(n):
        if kept and rnd.random() < 0.6:
            w = list(rnd.choice(kept))
            for _ in range(rnd.randint(0, 25)):
                k = rnd.randrange(len(w))
                rnd.choice([lambda: w.__setitem__(k, rnd.choice(vocab)), lambda: w.insert(k, rnd.choice(vocab)), lambda: w.pop(k)])()
        else:
            w = [rnd.choice(vocab) for _ in range(rnd.randint(55, 140))]
        kept.append(w)
        tag = rnd.choice(["p", "div"])
        rows.append((i, f"<!-- {i} --><script>var a={i}</script><{tag}>" + f"</{tag}><{tag}>".join(" ".join(w[j : j + 9]) for j in range(0, len(w), 9)) + f"</{tag}>"))
    return rows + [(n, None), (n + 1, ""), (n + 2, "short page"), (n + 3, "same " * 400), (n + 4, "same " * 500)]


def test_pairs_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed, 150)
        rows += [(1000 + i, rows[5][1]) for i in range(3)]
        df = spark.createDataFrame([(i, h, 1, 2) for i, h in rows], "capture_id bigint, dom_html string, size int, bits int")
        got = sorted(map(tuple, m.NearCopies(df, "capture_id", "dom_html").pairs().collect()))
        assert got == brute(rows) and len(got) > 50


def test_groups_and_empty(spark):
    rows = corpus(3, 80)
    df = spark.createDataFrame(rows, "capture_id bigint, dom_html string")
    near = m.NearCopies(df, "capture_id", "dom_html")
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in brute(rows):
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["id"]: r["group_id"] for r in near.groups().collect()}
    assert got == {i: root(i) for i in got}
    empty = m.NearCopies(df.limit(0), "capture_id", "dom_html")
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=3), min_size=1, max_size=4), st.data())
def test_allocation_is_optimal(groups, data):
    costs = [np.cumsum(sorted(g)).astype(float) for g in groups]
    units = data.draw(st.integers(1, sum(map(len, groups))))
    price = lambda ts: sum(c[t - 1] for c, t in zip(costs, ts) if t)
    for taken in m.allocate([costs, costs[:1] + costs], [units, units]):
        assert sum(taken) == units
    taken = m.allocate([costs, costs[:1]], [units, 1])[0]
    assert price(taken) == min(price(ts) for ts in itertools.product(*[range(len(c) + 1) for c in costs]) if sum(ts) == units)


def test_probes_are_enough_for_pages_of_any_length():
    rnd = np.random.default_rng(1)
    pages = [(rnd.integers(0, 40, n), rnd.integers(0, 4, n)) for n in (1, 5, 60, 200, 3000)]
    for (_, others), places in zip(pages, m.chosen_probes(pages, 0.6)):
        k, w = m.probe_budget(len(others), 0.6)
        assert len(set(places.tolist())) == len(places) == max(0, k + w - int((others == 0).sum()))
        assert (others[places] > 0).all()


def test_budget_covers_every_similar_page():
    for a in range(1, 120):
        k, w = m.probe_budget(a, 0.6)
        assert k + w <= a
        for b in range(a, int(a / 0.6) + 1):
            assert a - m.required_overlap(a, b, 0.6) <= k


def test_connected(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r["id"]: r["group_id"] for r in m.connected(spark.createDataFrame(edges, "id_a bigint, id_b bigint")).collect()}
    want = {x: x for e in edges for x in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_long_broken_markup_is_quick():
    import time

    start = time.time()
    for text in ("<" * 300_000, "<!--" * 100_000, "<b " * 100_000, "<script>" * 3_000 + " a", "a" * 300_000, "<p>" + "w " * 200_000):
        assert m.page_words(text) is not None
    assert time.time() - start < 20
    assert m.page_words("a<!-- x -->b <p>c</p> <d <!-- e") == ["ab", "c", "d", "e"]


def test_programs_in_blocks_cost_hardly_more(monkeypatch):
    rnd = np.random.default_rng(3)
    pages = [(rnd.integers(0, n // 3, n), rnd.zipf(1.6, n).clip(0, 4000)) for n in (1500, 5000)]

    def cost(found):
        total = 0.0
        for (anchors, others), places in zip(pages, found):
            for a in np.unique(anchors[places]):
                c = np.sort(others[places][anchors[places] == a]).astype(float)
                total += c[-1] + m.GROUP_OVERLAP * c[:-1].sum()
        return total

    blocks = m.chosen_probes(pages, 0.6)
    monkeypatch.setattr(m, "PROGRAM_CELLS", 1 << 40)
    whole = m.chosen_probes(pages, 0.6)
    assert [len(x) for x in blocks] == [len(x) for x in whole]
    assert cost(whole) <= cost(blocks) <= 1.03 * cost(whole)
    cheapest = [np.argsort(o, kind="stable")[: len(x)] for (_, o), x in zip(pages, whole)]
    assert cost(blocks) < cost(cheapest)  # what a page would get without the program


def test_long_pages_equal_brute_force(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(4000)]
    base = [rnd.choice(vocab) for _ in range(5200)]
    rows = []
    for i in range(10):
        w = list(base)
        for _ in range(rnd.choice([20, 300, 500, 700, 900])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((i, "<p>" + " ".join(w) + "</p>"))
    rows += [(50 + i, "<p>" + " ".join(rnd.choice(vocab) for _ in range(5000)) + "</p>") for i in range(4)]
    df = spark.createDataFrame(rows, "capture_id bigint, dom_html string")
    got = sorted(map(tuple, m.NearCopies(df, "capture_id", "dom_html").pairs().collect()))
    want = brute(rows)
    assert got == want and 3 <= len(want) < 45


def test_hot_bits_copies_and_many_ids(spark, monkeypatch):
    rows = corpus(4, 60)
    rows += [(2000 + i, rows[7][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "capture_id bigint, dom_html string")
    monkeypatch.setattr(m, "HOT", 3)  # nearly every shared bit and the group of copies are spread
    monkeypatch.setattr(m, "BROADCAST_IDS", 5)  # and the copies are taken out by a shuffled join
    assert sorted(map(tuple, m.NearCopies(df, "capture_id", "dom_html").pairs().collect())) == brute(rows)
