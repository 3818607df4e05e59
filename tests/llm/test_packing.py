from hypothesis import given, settings
from hypothesis import strategies as st

from webwarden.llm import packing as m


def one_at_a_time(sizes, capacity):
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= s]
        if fits:
            left[min(fits)[1]] -= s
        else:
            left.append(capacity - s)
    return sorted(left)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_plan_is_best_fit_decreasing(case):
    capacity, sizes = case
    hist = {s: sizes.count(s) for s in set(sizes)}
    runs, used = m.best_fit_plan(hist, capacity)
    left, seen = [capacity] * used, {}
    for size, rank, items, first, per in runs:
        assert seen.get(size, 0) == rank
        seen[size] = rank + items
        for j in range(items):
            left[first + j // per] -= size
    assert seen == hist and sorted(left) == one_at_a_time(sizes, capacity)


def test_tree_finds_the_tightest():
    t = m.CapacityTree(10)
    assert t.tightest(0) is None
    t.add(3, 2), t.add(7, 1)
    assert [t.tightest(i) for i in (0, 3, 4, 7, 8, 10)] == [3, 3, 7, 7, None, None]
    t.add(7, -1)
    assert t.tightest(4) is None


def test_frames(spark):
    sizes = [0, 0, 3, 3, 3, 7, 10, 25, 1, 1, 4]
    docs = spark.createDataFrame([(i, "t", n) for i, n in enumerate(sizes)], "doc_id bigint, tokenizer string, size bigint")
    specs = spark.createDataFrame([(1, "t", 10), (2, "t", 4), (3, "other", 5)], "spec_id int, tokenizer string, capacity int")
    rows = m.pack(m.sized_items(docs, specs), {1: 10, 2: 4}).collect()
    for spec, cap in ((1, 10), (2, 4)):
        own = [r for r in rows if r["spec_id"] == spec]
        fill, tokens = {}, {}
        for r in own:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
            tokens.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
        assert max(fill.values()) <= cap and sorted(fill) == list(range(len(fill)))
        for i, n in enumerate(sizes):
            parts = sorted(tokens[i])
            assert sum(p[1] for p in parts) == n and [p[0] for p in parts] == [k * cap for k in range(len(parts))]
            assert len(parts) == max(1, -(-n // cap))
        pieces = [s for n in sizes for s in ([cap] * (n // cap) + ([n % cap] if n % cap else []))]
        assert len(fill) == len(one_at_a_time(pieces, cap))
    assert m.pack(m.sized_items(docs.limit(0), specs), {1: 10, 2: 4}).count() == 0


def test_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 40), (4, "a"), (4, "a")], "doc_id bigint, text string")
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 16), (2, None, 5), (3, "byte_bpe_50k", 0)], "spec_id int, tokenizer string, capacity_tokens int")
    packed = m.pack_documents(docs, specs)
    assert {r["spec_id"] for r in packed.collect()} == {1}
    (fill,) = m.container_fill(packed, specs).collect()
    assert fill["tokens"] == 43 and fill["containers"] == 3
    assert m.pack_documents(docs, specs.limit(0)).count() == 0
