"""Deeply nested semi-structured records, shredded into an adjacency table and assembled into flat entity tables.

Each JSON document becomes rows (record, node, parent, label, ordinal, kind, scalar): one row per object, list or
scalar, whatever its depth. A list that was delivered as text is opened as the list itself. Object nodes are then
joined with their scalar children, and the children are pivoted into the columns of an entity table, which keeps
the link to the parent entity.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "record_id bigint, node int, parent int, label string, ordinal int, kind string, scalar string, result_pos int, entity_node int"
_ARROW = pa.schema([("record_id", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string()), ("result_pos", pa.int32()), ("entity_node", pa.int32())])

#: Entities of a scan report: the label of their list, the scalars of a child, and the entity that holds them.
ENTITIES = {
    "hops": ("hop_index", "url", "domain", "is_shortener", "is_open_redirect", "protocol", "status_code"),
    "form_actions": ("action_url", "method", "target_domain", "is_external_mismatch", "has_password_field", "form_id", "form_name"),
    "mitre_attack_techniques": ("id", "name", "tactic"),
    "input_fields": ("name", "type"),
}
#: The list whose place says which result of a record a node belongs to, and the entity that parents another.
RESULT_LIST, PARENT_OF = "results", {"input_fields": "form_actions"}


class Digits(str):
    """A whole number of more digits than the parser converts, as it was written."""


def _refused(word: str):
    raise ValueError(f"{word} is no JSON")


_DECODER = json.JSONDecoder(parse_constant=_refused)
_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_OPENING = re.compile(r"[ \t\n\r]*[\[{]")
_LITERALS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def _key_at(text: str, i: int) -> tuple[str, int]:
    if text[i : i + 1] != '"':
        raise ValueError("a key was expected")
    key, i = scanstring(text, i + 1, True)
    i = _SPACE.match(text, i).end()
    if text[i : i + 1] != ":":
        raise ValueError("a colon was expected")
    return key, i + 1


def parse_any_depth(text: str):
    """The value of a JSON text of any depth and with numbers of any length, with a stack of its own; ValueError if
    it is not valid JSON."""
    stack: list[tuple] = []
    i = 0
    while True:
        i = _SPACE.match(text, i).end()
        c = text[i : i + 1]
        if c in ("{", "["):
            value = {} if c == "{" else []
            i = _SPACE.match(text, i + 1).end()
            if text[i : i + 1] == ("}" if c == "{" else "]"):
                i += 1
            else:
                key, i = _key_at(text, i) if c == "{" else (None, i)
                stack.append((value, key))
                continue
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        elif c in _LITERALS and text.startswith(_LITERALS[c][0], i):
            word, value = _LITERALS[c]
            i += len(word)
        elif m := _NUMBER.match(text, i):
            i = m.end()
            value = float(m[0]) if m[1] or m[2] else int(m[0]) if len(m[0]) < 4000 else Digits(m[0])
        else:
            raise ValueError("a value was expected")
        while stack:
            holder, key = stack.pop()
            i = _SPACE.match(text, i).end()
            after = text[i : i + 1]
            i += 1
            if isinstance(holder, list):
                holder.append(value)
                if after == ",":
                    stack.append((holder, None))
                    break
            else:
                holder[key] = value
                if after == ",":
                    key, i = _key_at(text, _SPACE.match(text, i).end())
                    stack.append((holder, key))
                    break
            if after != ("]" if isinstance(holder, list) else "}"):
                raise ValueError("a comma or an end was expected")
            value = holder
        else:
            if _SPACE.match(text, i).end() != len(text):
                raise ValueError("more than one value")
            return value


def _parse(text: str):
    """The value of a JSON text, or None if it is not valid JSON by the standard, which has no NaN and no Infinity. What
    is nested too deep or has too many digits for the quick parser goes to the other one."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        pass
    except ValueError as e:
        if "digits" not in str(e):
            return None
    try:
        return parse_any_depth(text)
    except ValueError:
        return None


def _opened(value):
    """A list or object delivered as text is the list or object itself; everything else stays."""
    if isinstance(value, str) and _OPENING.match(value):
        inner = _parse(value)
        if isinstance(inner, (list, dict)):
            return inner
    return value


def _text(value) -> str | None:
    if not isinstance(value, str):
        return None if value is None else json.dumps(value)
    if isinstance(value, Digits):
        return str(value)
    try:
        value.encode()
    except UnicodeEncodeError:  # half of a surrogate pair, which JSON can spell but UTF-8 cannot
        return value.encode("utf-8", "replace").decode()
    return value


def shred_value(root) -> Iterator[tuple]:
    """(node, parent, label, ordinal, kind, scalar, result_pos, entity_node) of every node of one parsed document.

    label is the key under which the node hangs (list elements take their list's), ordinal its place in a list, 0
    for a lone value, -1 for the members of an object that no entity names. kind is object, list, text, number, flag
    or null. result_pos is the place in the list of results, entity_node the nearest enclosing parent entity, -1 if
    there is none. Walks with a stack of its own, so depth is bounded by memory only.
    """
    parents = set(PARENT_OF.values())
    stack = [(root, -1, "", -1, 0, -1)]
    count = 0
    while stack:
        value, parent, label, ordinal, result, owner = stack.pop()
        if label in ENTITIES or label == RESULT_LIST:
            value = _opened(value)
            if ordinal < 0 and not isinstance(value, list) and value is not None:
                ordinal = 0  # a lone object counts as a list of one
        node, count = count, count + 1
        kind = "object" if isinstance(value, dict) else "list" if isinstance(value, list) else "null" if value is None else "flag" if isinstance(value, bool) else "text" if isinstance(value, str) and not isinstance(value, Digits) else "number"
        yield node, parent, label, ordinal, kind, None if kind in ("object", "list", "null") else _text(value), result, owner
        if kind == "object":
            if label in parents:
                owner = node
            for k, v in reversed(value.items()):
                stack.append((v, node, k, -1, result, owner))
        elif kind == "list":
            for i in range(len(value) - 1, -1, -1):
                stack.append((value[i], node, label, i, i if label == RESULT_LIST else result, owner))


def adjacency(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """The adjacency table of a JSON column. Null, empty and broken payloads give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in _ARROW]
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root = _opened(_parse(text))
                if root is None:
                    continue
                for t in shred_value(root):
                    rows[0].append(rid)
                    for c, v in zip(rows[1:], t):
                        c.append(v)
                if len(rows[0]) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ARROW)], schema=_ARROW)
                    rows = [[] for _ in _ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ARROW)], schema=_ARROW)

    source = df.select(F.col(f"`{id_col}`").cast("bigint").alias("record_id"), F.col(f"`{payload_col}`").alias("payload")).filter(F.length("payload") > 0)
    return source.mapInArrow(run, NODE_SCHEMA)


def assembled(nodes: DataFrame, entities: list[str]) -> DataFrame:
    """One row per child of the lists of the named entities: (record_id, child, result_pos, parent_pos, child_pos,
    node, text, scalars...), with the columns of all of them.

    Children are objects, or texts where the entity writes its children so; null elements keep their place but give
    no row. Of a key that an object has more than once, the last value counts, as in the parser. parent_pos is the
    place of the enclosing parent entity in its own list, -1 where there is none.
    """
    columns = list(dict.fromkeys(c for e in entities for c in ENTITIES[e]))
    as_text = (F.col("kind") == "text") & F.col("label").isin(*PARENT_OF) & (F.length("scalar") > 0)
    kids = nodes.filter(F.col("label").isin(*entities) & (F.col("ordinal") >= 0) & ((F.col("kind") == "object") | as_text))
    scalars = nodes.filter((F.col("ordinal") == -1) & F.col("label").isin(*columns) & ~F.col("kind").isin("object", "list"))
    left = kids.select("record_id", "node", F.col("label").alias("child"), "result_pos", "entity_node", F.col("ordinal").alias("child_pos"), F.col("scalar").alias("text"))
    right = scalars.select(F.col("record_id"), F.col("parent").alias("node"), F.col("label"), F.col("scalar").alias("value"))
    wide = (
        left.join(right, ["record_id", "node"], "left")
        .groupBy("record_id", "node")
        .agg(*[F.first(c).alias(c) for c in ("child", "result_pos", "entity_node", "child_pos", "text")], *[F.max(F.when(F.col("label") == c, F.col("value"))).alias(c) for c in columns])
    )
    holders = [h for e, h in PARENT_OF.items() if e in entities]
    if not holders:
        return wide.select("record_id", "child", "result_pos", F.lit(-1).alias("parent_pos"), "child_pos", "node", "text", *columns)
    owners = nodes.filter(F.col("label").isin(*holders) & (F.col("kind") == "object")).select("record_id", F.col("node").alias("entity_node"), F.col("ordinal").alias("parent_pos"))
    inner = F.when(F.col("child").isin(*PARENT_OF), F.coalesce("parent_pos", F.lit(-1))).otherwise(-1)
    return wide.join(owners, ["record_id", "entity_node"], "left").select("record_id", "child", "result_pos", inner.alias("parent_pos"), "child_pos", "node", "text", *columns)


def entity_table(nodes: DataFrame, entity: str) -> DataFrame:
    """The flat table of one entity, with its own columns only."""
    return assembled(nodes, [entity]).drop("child", *([] if entity in PARENT_OF else ["text"]))


def child_rows(nodes: DataFrame) -> DataFrame:
    """(record_id, result_pos, child, parent_pos, child_pos, child_key) of all entities; an absent key is null."""
    child = F.col("child")
    pair = F.coalesce("text", F.concat(F.coalesce("name", F.lit("")), F.lit(":"), F.coalesce("type", F.lit(""))))
    key = F.when(child == "hops", F.col("url")).when(child == "form_actions", F.col("action_url")).when(child == "mitre_attack_techniques", F.col("id")).otherwise(pair)
    return assembled(nodes, list(ENTITIES)).select("record_id", "result_pos", "child", "parent_pos", "child_pos", key.alias("child_key"))
