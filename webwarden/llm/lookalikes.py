"""Visually identical hosts with different characters, brought to one consistent spelling.

Hosts are cut into labels. The labels that are already consistent form the vocabulary, which is spread over tries,
and every other label is walked through its trie by a weighted edit automaton: ignorable characters are skipped and
compatibility forms, decompositions and look-alike letters are taken at no cost, anything else costs an edit. Some
characters look like more than one letter, as a palochka like l and i: each is free, and the vocabulary tells which is
meant. Its spelling is selected where the walk ends within the budget; labels without a match are normalised by table.
Letters that one character may stand for form a class, and a label and all spellings it can reach at no cost agree in
the classes of their letters, whose checksum routes them to one trie. With a budget for an edit, the checksums with one
letter left out route them too.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from string import ascii_letters, ascii_lowercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webwarden.functions.skew import lookup_join
from webwarden.session import materialize, plan_bytes

# Letters of other scripts, and rare Latin ones, that look like an ASCII letter in lower case.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "к": "k", "ь": "b",
    # Greek
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
    # Armenian
    "ց": "g", "հ": "h", "յ": "j", "ո": "n", "օ": "o", "զ": "q", "ս": "u",
    # Latin
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ȷ": "j", "ᴄ": "c", "ᴋ": "k", "ᴏ": "o", "ꜱ": "s", "ᴜ": "u", "ʋ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ʏ": "y", "ƅ": "b",
}
# Characters that look like more than one ASCII letter, the likeliest first.
AMBIGUOUS = {"ӏ": "li", "ǀ": "li", "ɪ": "il", "ɩ": "il", "ו": "li", "ا": "li", "ո": "nu", "υ": "uv", "ʋ": "uv"}
# Marks that look like an ASCII hyphen, and full stops that separate labels.
HYPHENS = "‐‑‒–—―−⁃˗﹘﹣－"
DOTS = ".．。｡․"
_HIDDEN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0}
#: What an edit costs that is no look-alike, and the cost up to which a walk may go: hosts that differ in a letter do
#: not look the same, so the query asks for no edits.
EDIT_COST, BUDGET = 1.0, 0.0
#: With a budget for edits, how many times as frequent as a label a spelling must be that differs by one.
EDIT_RATIO = 10
#: About the size of the input, in bytes, that shares a trie.
TRIE_BYTES = 4 << 20


def invisible(ch: str) -> bool:
    """Format and control characters, variation selectors, joiners and fillers: nothing that shows."""
    o = ord(ch)
    return unicodedata.category(ch) in ("Cf", "Cc") or o in _HIDDEN or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


def plain(label: str) -> str:
    """A label in lower case, with compatibility forms resolved and nothing invisible."""
    text = "".join(c for c in label if not invisible(c))
    text = unicodedata.normalize("NFKC", text).lower()
    return unicodedata.normalize("NFKC", "".join("-" if c in HYPHENS else c for c in text if not invisible(c)))


def has_latin(label: str) -> bool:
    """Whether a plain label has any Latin letter; without one it is a word of another script."""
    return any("a" <= c <= "z" or (c > "\x7f" and unicodedata.name(c, "").startswith("LATIN")) for c in label)


class Table:
    """Which ASCII letters a character looks like, the likeliest first. Capitals go by their own shape before that of
    their small letter: a capital Cyrillic en looks like H, the small one like no letter."""

    def __init__(self, letters: dict[str, str] = LOOKALIKES, capitals: dict[str, str] | None = None) -> None:
        self.letters, self.capitals = {**letters, **AMBIGUOUS}, capitals or {}
        self.known: dict[str, str] = {}
        # Letters that some character may stand for alike are one class, named after its first letter.
        self.classes = {c: c for c in ascii_lowercase}
        for group in {self.options(c) for c in {*self.letters, *self.capitals}}:
            first = min(self.classes[c] for c in group)
            for old in {self.classes[c] for c in group}:
                self.classes.update({c: first for c, k in self.classes.items() if k == old})
        self._route = str.maketrans(self.classes)

    def options(self, c: str) -> str:
        """The letters of one character in its original case; empty for one that looks like none."""
        found = self.known.get(c)
        if found is None:
            found = self.known[c] = "".join(dict.fromkeys(self.capitals.get(c, "") + self.letters.get(c.lower(), "")))
        return found

    def form(self, label: str) -> str:
        """The consistent form of a label by table alone. Digits, true accents and labels of other scripts stay."""
        text = composed(label)
        low = unicodedata.normalize("NFKC", text.lower())
        if text.isascii() or not has_latin(low):
            return unicodedata.normalize("NFC", low)
        split = unicodedata.normalize("NFD", text)
        return unicodedata.normalize("NFC", "".join(self.options(c)[:1] or c.lower() for c in split))

    def route(self, form: str) -> str:
        """The classes of a consistent form's letters: the same for all spellings that a label reaches at no cost."""
        return form.translate(self._route)


def composed(label: str) -> str:
    """A label in its own case, with compatibility forms resolved, ASCII hyphens and nothing invisible."""
    text = unicodedata.normalize("NFKC", "".join(c for c in label if not invisible(c)))
    return unicodedata.normalize("NFKC", "".join("-" if c in HYPHENS else c for c in text if not invisible(c)))


def public_table(spark: SparkSession) -> Table:
    """The fixed look-alikes and those of the public confusables data that comes with the JVM's Unicode library: every
    letter whose skeleton is that of an ASCII letter, and the small capitals by their names. The fixed ones go first."""
    rest = (chr(o) for o in range(0x80, 0x20000) if not (0x3400 <= o <= 0x9FFF or 0xAC00 <= o <= 0xDFFF))
    chars = [c for c in rest if unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFKD", c) == c]
    try:
        checker = getattr(spark.sparkContext._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
        skeletons = checker.getSkeleton("\n".join([*ascii_letters, *chars])).split("\n")
    except Exception:  # a JVM without that library
        return FIXED
    by_skeleton: dict[str, str] = {}
    for c, k in zip(ascii_letters, skeletons):
        by_skeleton.setdefault(k, c.lower())
    own = {c: re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(c, "")) for c in chars}
    small = {c: m[1].lower() for c, m in own.items() if m}
    letters, capitals = {}, {}
    for c, k in zip(chars, skeletons[len(ascii_letters) :]):
        if not unicodedata.name(c, "").startswith("LATIN"):
            k = "".join(x for x in k if not unicodedata.combining(x)) or k
        letter = small.get(c) or by_skeleton.get(k) or small.get(k)
        if letter and c.lower() == c:
            letters[c] = letter
        elif letter:
            capitals[c] = "i" if letter == "l" and c.lower() in ("і", "ι") else letter
    return Table({**letters, **LOOKALIKES}, capitals)


FIXED = Table()


def table_form(label: str, table: Table = FIXED) -> str:
    return table.form(label)


class Trie:
    """Spellings by their decomposed characters; a leaf holds the spelling and how often it occurs."""

    def __init__(self, table: Table = FIXED) -> None:
        self.root: dict = {}
        self.table = table

    def add(self, spelling: str, count: int) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", spelling):
            node = node.setdefault(c, {})
        known = node.get("", (spelling, 0))
        node[""] = (spelling, known[1] + count)

    def walk(self, label: str, budget: float = BUDGET) -> str | None:
        """The cheapest spelling within the budget that the automaton reaches, of equals the most frequent, of those
        the one that the table would give."""
        found = self.matched(label, budget)
        return found[2] if found else None

    def matched(self, label: str, budget: float = BUDGET, least: int = 0) -> tuple[float, int, str] | None:
        """(cost, -count, spelling) of the best spelling. One that costs an edit needs a count of `least`.

        States are trie nodes with their cost. A character that does not show moves nothing and costs nothing; a
        character's compatibility form, and in labels with Latin letters each of its look-alikes, move down at no
        cost; every other substitution, insertion or omission costs EDIT_COST.
        """
        latin = has_latin(plain(label))
        states = self._inserted({id(self.root): (self.root, 0.0)}, budget)
        for ch in composed(label):
            for s in unicodedata.normalize("NFD", ch):
                take = {*s.lower(), *(self.table.options(s) if latin else "")}
                after: dict = {}
                for node, cost in states.values():
                    for t in take:
                        if t in node:
                            self._keep(after, node[t], cost)
                    if cost + EDIT_COST <= budget:
                        self._keep(after, node, cost + EDIT_COST)
                        for t, child in node.items():
                            if t and t not in take:
                                self._keep(after, child, cost + EDIT_COST)
                states = self._inserted(after, budget)
                if not states:
                    return None
        form = self.table.form(label)
        ends = [(cost, -node[""][1], node[""][0] != form, node[""][0]) for node, cost in states.values() if "" in node and (not cost or node[""][1] >= least)]
        best = min(ends, default=None)
        return (best[0], best[1], best[3]) if best else None

    @staticmethod
    def _keep(states: dict, node: dict, cost: float) -> None:
        if id(node) not in states or states[id(node)][1] > cost:
            states[id(node)] = (node, cost)

    def _inserted(self, states: dict, budget: float) -> dict:
        """Add the states that the vocabulary reaches by characters the label lacks."""
        todo = list(states.values())
        while todo:
            node, cost = todo.pop()
            if cost + EDIT_COST <= budget:
                for t, child in node.items():
                    if t and (id(child) not in states or states[id(child)][1] > cost + EDIT_COST):
                        states[id(child)] = (child, cost + EDIT_COST)
                        todo.append((child, cost + EDIT_COST))
        return states


_EDGES = r"[\s\p{Z}\p{Cf}\p{Cc}\x{FE00}-\x{FE0F}\x{034F}\x{115F}\x{1160}\x{3164}]+"


def suspicious(host: Column) -> Column:
    """Whether a host has anything but visible ASCII; all others are consistent but for letter case."""
    return host.rlike(r"[^\x21-\x7E]")


def labels_of(host: Column) -> Column:
    """The labels of a host, without what surrounds it."""
    return F.split(F.regexp_replace(host, rf"^{_EDGES}|{_EDGES}$", ""), f"[{DOTS}]")


_KINDS = pa.schema([("token", pa.string()), ("uses", pa.int64()), ("form", pa.string()), ("shard", pa.int64())])
_KINDS_DDL = "token string, uses bigint, form string, shard bigint"
_RESULT = pa.schema([("token", pa.string()), ("uses", pa.int64()), ("form", pa.string()), ("cost", pa.float64()), ("rank", pa.int64()), ("clean", pa.string())])
_RESULT_DDL = "token string, uses bigint, form string, cost double, rank bigint, clean string"


def routes(key: str, budget: float) -> list[str]:
    """The keys under which a label of this route may meet spellings: its own, and where an edit is allowed those with
    one letter left out, of which two labels that are one edit apart share one."""
    return [key] if budget < EDIT_COST else [key, *dict.fromkeys(key[:i] + key[i + 1 :] for i in range(len(key)))]


def _routed(shared, shards: int, budget: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            out: list[list] = [[], [], [], []]
            for token, uses in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                form = table.form(token)
                keys = routes(table.route(form), budget)
                for shard in {zlib.crc32(k.encode("utf-8", "surrogatepass")) % shards for k in keys}:
                    for c, v in zip(out, (token, uses, form, shard)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _KINDS)], schema=_KINDS)

    return run


def _matcher(shared, budget: float):
    def run(tokens: pa.Table, vocabulary: pa.Table) -> pa.Table:
        """Walk the tokens of one shard through the trie of its vocabulary, to which the tokens that are consistent
        themselves belong too."""
        names, uses, forms = (tokens.column(c).to_pylist() for c in ("token", "uses", "form"))
        trie = Trie(shared.value)
        if names:
            for spelling, n in zip(vocabulary.column("token").to_pylist(), vocabulary.column("uses").to_pylist()):
                trie.add(spelling, n)
            for t, n, f in zip(names, uses, forms):
                if t == f:
                    trie.add(t, n)
        found = [(0.0, 0, t) if t == f else trie.matched(t, budget, EDIT_RATIO * n) for t, n, f in zip(names, uses, forms)]
        cost, rank, clean = ([None if x is None else x[i] for x in found] for i in range(3))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((names, uses, forms, cost, rank, clean), _RESULT)], schema=_RESULT)

    return run


def label_dictionary(hosts: DataFrame, odd: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(token, uses, clean, known) of every distinct label of the distinct hosts `odd` that is not plain ASCII; known
    tells whether the vocabulary has it. The table of look-alikes, a few hundred letters, is sent by broadcast."""
    spark = hosts.sparkSession
    shared = spark.sparkContext.broadcast(public_table(spark))
    shards = max(32, plan_bytes(hosts) // TRIE_BYTES)
    tokens = odd.select(F.explode(labels_of(F.col("raw"))).alias("token")).filter(suspicious(F.col("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    plain_hosts = hosts.filter(~suspicious(F.col("raw")))
    words = plain_hosts.select(F.explode(F.split(F.lower("raw"), r"\.")).alias("token")).filter("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    classes = {k: v for k, v in shared.value.classes.items() if k != v}
    if budget < EDIT_COST:
        vocabulary = words.withColumn("shard", F.crc32(F.translate("token", "".join(classes), "".join(classes.values()))) % shards)
    else:
        vocabulary = words.mapInArrow(_routed(shared, shards, budget), _KINDS_DDL).select("token", "uses", "shard")
    routed = tokens.mapInArrow(_routed(shared, shards, budget), _KINDS_DDL)
    found = routed.groupBy("shard").cogroup(vocabulary.groupBy("shard")).applyInArrow(_matcher(shared, budget), _RESULT_DDL)
    if budget >= EDIT_COST:
        best = F.min(F.when(F.col("clean").isNotNull(), F.struct("cost", "rank", "clean")))["clean"]
        found = found.groupBy("token", "uses", "form").agg(best.alias("clean"))
    return found.select("token", "uses", F.coalesce("clean", "form").alias("clean"), F.col("clean").isNotNull().alias("known"))


def consistent_hosts(hosts: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(field_name, row_id, pos, clean_form) of each host whose spelling differs from its consistent form in more
    than letter case, from (field_name, row_id, pos, raw).

    Null hosts give no row; an empty host is consistent; repeated rows give a row each; an empty table gives an
    empty result. `hosts` is read four times, in the columns it has. A `budget` of 1 also mends one edit in labels with
    odd characters, towards spellings that are EDIT_RATIO times as frequent.
    """
    suspects = hosts.filter(suspicious(F.col("raw")))
    odd = materialize(suspects.groupBy("raw").agg(F.count(F.lit(1)).alias("rows")), "hosts")
    dictionary = materialize(label_dictionary(hosts, odd, budget).select("token", "uses", "clean"), "labels")
    labels = odd.select("raw", "rows", F.posexplode(labels_of(F.col("raw"))).alias("place", "token"))
    plain_labels = labels.filter(~suspicious(F.col("token"))).select("raw", "rows", "place", F.lower("token").alias("clean"))
    odd_labels = lookup_join(labels.filter(suspicious(F.col("token"))), dictionary, "token", "uses").select("raw", "rows", "place", "clean")
    joined = plain_labels.unionAll(odd_labels).groupBy("raw").agg(F.first("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("place", "clean"))).alias("parts"))
    whole = joined.select("raw", "rows", F.array_join(F.transform("parts", lambda p: p["clean"]), ".").alias("clean_form")).filter(F.lower("raw") != F.col("clean_form"))
    return lookup_join(suspects, materialize(whole, "clean"), "raw", "rows").select("field_name", "row_id", "pos", "clean_form")


def host_values(df: DataFrame, field: str, id_col: str, host_col: str) -> DataFrame:
    """(field_name, row_id, pos, raw) of a host column, or of each element of a column with lists of hosts."""
    column = F.col(f"`{host_col}`")
    name = F.lit(field).alias("field_name")
    row = F.col(f"`{id_col}`").cast("bigint").alias("row_id")
    if dict(df.select(column.alias("h")).dtypes)["h"].startswith("array"):
        return df.select(name, row, F.posexplode(column).alias("pos", "raw")).filter(F.col("raw").isNotNull())
    return df.select(name, row, F.lit(0).alias("pos"), column.alias("raw")).filter(F.col("raw").isNotNull())
