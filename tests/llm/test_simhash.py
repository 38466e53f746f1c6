"""SimHash near-duplicates against brute force."""

import re

import numpy as np
import pytest
import xxhash

from docdrift.llm import simhash as S
from docdrift.llm.components import components


def plain_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, k):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= k:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(prints)):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return [least.get(find(i)) for i in range(len(prints))]


def clustered(seed, groups, size, flips):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        centre = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        for _ in range(size):
            x = centre
            for b in rng.choice(64, size=int(rng.integers(0, flips + 1)), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    return out


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for text in ("a b c d e", "One TWO\tthree\x0bfour É", "x", "", None, " \n ", "w " * 70_000, "ab cd"):
        assert S.fingerprint(text) == plain_fingerprint(text), text and text[:20]


def test_spark_hash_of_a_shingle_is_the_same(llm):
    row = llm.sql("select xxhash64('a b c') as h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"a b c", seed=42)


@pytest.mark.parametrize("bits", [0, 1, 3, 5])
def test_trie_yields_exactly_the_close_pairs(bits):
    values = np.unique(np.array(clustered(bits, 12, 25, 5), dtype=np.uint64))
    found = set()
    for turned in (values, (values << np.uint64(32)) | (values >> np.uint64(32))):
        leaves = np.sort(turned)
        back = leaves if turned is values else (leaves << np.uint64(32)) | (leaves >> np.uint64(32))
        for i, j in S.trie_links(leaves, leaves, True, 0, [bits // 2] * 33 + [bits] * 32):
            found |= {tuple(sorted((int(back[a]), int(back[b])))) for a, b in zip(i, j)}
    close = {
        (int(a), int(b)) for n, a in enumerate(values) for b in values[n + 1 :] if int(a ^ b).bit_count() <= bits
    }
    assert found == close


@pytest.mark.parametrize("node_rows", [4, 40, 8192])
def test_groups_are_the_components_of_close_fingerprints(llm, node_rows):
    prints = clustered(7, 8, 40, 6) + [0, 0, 1, 2**63]
    ids = list(range(100, 100 + len(prints)))
    ids[5] = None
    rows = [(i, p - 2**64 if p >= 2**63 else p) for i, p in zip(ids, prints)]
    marked = llm.createDataFrame(rows, "doc_id long, fp long")
    groups = {r.fp % 2**64: r.component_id for r in S.simhash_groups(marked, 3, node_rows).collect()}
    assert [groups[p] for p in prints] == plain_components(prints, ids, 3)


def test_dedup_of_odd_tables(llm):
    rows = [
        (3, "A b c d", "x"), (1, "a B  c\td", "y"), (1, "a B  c\td", "y"), (7, None, None), (6, "", ""),
        (None, "a b c d", "z"), (9, "quite another text than that", None), (None, "only null here at all", None),
    ]
    df = llm.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in S.simhash_dedup(df).collect())
    abcd = f"{plain_fingerprint('a b c d'):016x}"
    assert got == sorted([
        (3, abcd, 1), (1, abcd, 1), (1, abcd, 1), (-1, abcd, 1), (7, "0" * 16, 6), (6, "0" * 16, 6),
        (9, f"{plain_fingerprint('quite another text than that'):016x}", 9),
        (-1, f"{plain_fingerprint('only null here at all'):016x}", None),
    ])
    assert S.simhash_dedup(df.limit(0)).collect() == []


def test_components_of_a_long_path_and_a_hub(llm):
    path = [(i, i + 1) for i in range(0, 60)]
    hub = [(1000, i) for i in range(1001, 1100)]
    links = llm.createDataFrame(path[::-1] + hub + [(5, 5), (2000, None)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 1000 for i in range(1001, 1100)}
