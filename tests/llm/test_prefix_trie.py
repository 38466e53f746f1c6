"""The prefix trie against a plain one."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docdrift.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def sequences(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, digest(role, text), role, text))
    return {c: [t[3:] for t in sorted(own)] for c, own in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20 if c >= 0 else c + -c % 20, [])[:h] + own[h:]
    return out


def plain(convs):
    members = defaultdict(list)
    for c, own in convs.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += children[node] == 0
        if node:
            saved[node] += (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1]))
            children[node[:-1]] += 1
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), parent, len(own), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def data(seed, convs=150, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        own = "shared" if rng.random() < 0.4 else f"conv {c}"
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, ("user", "assistant")[turn % 2], f"{own if rng.random() < 0.95 else c} turn {turn}\n more\x0bwords"))
    rows += [(1000 + c, turn, "user", f"copy {turn}") for c in range(80) for turn in range(4)]  # a large group of copies
    return rows


ODD = [
    (2000, None, "user", "first"), (2000, 0, None, None), (2000, 0, "", ""), (2000, 1, "a", "b"), (2000, 1, "a", "b"), (2001, 5, "user", ""),
    (None, 0, "user", "nobody"), (None, None, None, None), (-7, 0, "user", "negative"), (-20, 3, "x", "y z"), (2002, 0, "us", "er"),
    (2003, 0, "user", "word " * 20_000), (2003, 1, "user", " \t"), (2004, 0, "1:a", ""), (2005, 0, "", "1:a"),
]


@pytest.mark.parametrize(("block", "longest"), [(1024, 12), (4, 30), (2, 9), (8, 1)])
def test_against_a_plain_trie(llm, block, longest):
    rows = data(block, 60, longest) + ODD
    df = llm.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS conv", "2 AS at", "3 AS t").repartition(5)
    turns = T.place_turns(df)
    own = T.prefix_trie(turns.where("at = 0").select("conv"), turns.drop("n"), block)
    assert got(own) == plain(sequences(rows))


def test_shared_openings_and_empty(llm):
    rows = data(5) + ODD
    df = llm.createDataFrame(rows, SCHEMA)
    assert got(T.prefix_trie(*T.share_openings(T.place_turns(df)))) == plain(rebuilt(sequences(rows)))
    assert got(T.conversation_trie(df.limit(0))) == []
    assert got(T.conversation_trie(df.where("conv_id IS NULL"))) == []


def test_a_conversation_with_most_of_the_turns(llm):
    rows = [(20, i, "user", f"turn {i % 7}") for i in range(3000)] + [(c, i, "user", f"turn {i % 7}") for c in (21, 22, 40) for i in range(c * 40)]
    df = llm.createDataFrame(rows, SCHEMA).repartition(6)
    turns = T.place_turns(df)
    assert turns.where("conv = 20").agg(F.count_distinct("at"), F.max("at")).first() == (3000, 2999)
    assert got(T.prefix_trie(*T.share_openings(turns))) == plain(rebuilt(sequences(rows)))


def test_lists_are_hashed_in_pieces(llm):
    df = llm.range(3000).selectExpr("CAST(IF(id % 3 = 0, 'a', 'b') AS BINARY) AS whole", "id - 1500 AS conv").repartition(7)
    expected = {g: hashlib.sha256(",".join(str(i - 1500) for i in range(3000) if (i % 3 == 0) == (g == b"a")).encode()).hexdigest() for g in (b"a", b"b")}
    assert {bytes(r.whole): r.sha256 for r in T.list_digests(df, 100).collect()} == expected


def test_query_against_a_plain_trie(llm):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in llm.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    result = T.op11_prefix_trie(llm, sf)
    assert got(result) == plain(rebuilt(sequences(rows)))
    assert [t for _, t in result.dtypes] == ["bigint"] * 7 + ["string"]
