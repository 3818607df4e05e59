import json

from hypothesis import given
from hypothesis import strategies as st

from webwarden.operators import shredding as m


def children(spark, *payloads):
    df = spark.createDataFrame([(i, p, "n", "e") for i, p in enumerate(payloads)], "report_id bigint, payload string, node string, parent string")
    rows = m.child_rows(m.adjacency(df, "report_id", "payload")).collect()
    return sorted((r["record_id"], r["result_pos"], r["child"], r["parent_pos"], r["child_pos"], r["child_key"]) for r in rows)


def test_envelopes_and_places(spark):
    form = {"action_url": "/a", "input_fields": ["pw:password", None, {"name": "n", "type": "t"}]}
    flat = {"redirect_graph": {"hops": [None, {"url": "u1"}]}, "dom_forensics": {"form_actions": [None, form]}}
    batch = {"batch": {"results": [None, {"takedown": {"package": {"mitre_attack_techniques": {"id": "T1", "sources": [{"ref": 1}]}}}}]}}
    text = {"data": {"scan": {"hops": json.dumps([{"url": "u2"}, {"url": "u3"}]), "form_actions": json.dumps(form)}}}
    assert children(spark, json.dumps(flat), json.dumps(batch), json.dumps(text)) == sorted(
        [
            (0, 0, "hops", -1, 1, "u1"), (0, 0, "form_actions", -1, 1, "/a"), (0, 0, "input_fields", 1, 0, "pw:password"), (0, 0, "input_fields", 1, 2, "n:t"),
            (1, 1, "mitre_attack_techniques", -1, 0, "T1"),
            (2, 0, "hops", -1, 0, "u2"), (2, 0, "hops", -1, 1, "u3"), (2, 0, "form_actions", -1, 0, "/a"), (2, 0, "input_fields", 0, 0, "pw:password"), (2, 0, "input_fields", 0, 2, "n:t"),
        ]
    )


def test_broken_empty_and_odd_payloads(spark):
    deep = '{"a":' * 900 + '{"hops":[{"url":"d"}]}' + "}" * 900
    got = children(spark, None, "", "{", "[]", "null", "3", '{"hops": null, "form_actions": [], "mitre_attack_techniques": ""}', deep, '{"hops":[{"url":"\\ud800x"}]}')
    assert [(r[0], r[5]) for r in got] == [(7, "d"), (8, "?x")]
    assert children(spark) == []


def test_entity_tables_keep_links(spark):
    p = json.dumps({"form_actions": [{"action_url": None, "method": "GET", "has_password_field": True, "input_fields": [{"name": "a"}]}]})
    nodes = m.adjacency(spark.createDataFrame([(5, p)], "id bigint, p string"), "id", "p")
    (form,) = m.entity_table(nodes, "form_actions").collect()
    assert (form["action_url"], form["method"], form["has_password_field"], form["parent_pos"]) == (None, "GET", "true", -1)
    (field,) = m.entity_table(nodes, "input_fields").collect()
    assert (field["name"], field["type"], field["parent_pos"], field["record_id"]) == ("a", None, 0, 5)


def test_any_depth_any_length_and_the_standard(spark):
    depth = 100_000
    deep = '{"a":' * depth + '{"hops":[{"url":"d"}]}' + "}" * depth
    lists = "[" * depth + '{"hops":{"url":"e"}}' + "]" * depth
    text = json.dumps({"hops": " " * 100 + "\n" + json.dumps([{"url": "f"}])})
    digits = '{"hops":[{"url":"g","status_code":' + "1" * 5000 + "}]}"
    got = children(spark, deep, lists, text, digits, '{"hops":[{"url":"h","status_code":NaN}]}', '{"hops":[{"url":"i"}],"x":-Infinity}', deep[:-1])
    assert [(r[0], r[5]) for r in got] == [(0, "d"), (1, "e"), (2, "f"), (3, "g")]
    nodes = m.adjacency(spark.createDataFrame([(1, digits)], "report_id bigint, payload string"), "report_id", "payload")
    assert m.entity_table(nodes, "hops").first()["status_code"] == "1" * 5000


values = st.recursive(st.none() | st.booleans() | st.integers(-10**9, 10**9) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=3), c, max_size=4), max_leaves=20)


@given(values, st.sampled_from([None, 1]), st.text(alphabet='{}[],:" x', max_size=2), st.integers(0, 40))
def test_both_parsers_agree(value, indent, junk, at):
    text = json.dumps(value, indent=indent)
    assert m.parse_any_depth(text) == value
    broken = text[:at] + junk + text[at:]
    try:
        want = json.loads(broken)
    except ValueError:
        want = ValueError
    try:
        got = m.parse_any_depth(broken)
    except ValueError:
        got = ValueError
    assert got == want or got is want
