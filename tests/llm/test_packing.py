"""Packing against the tokenizers library and the rules of a packing."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from docdrift.llm import packing as P

ODD = [
    "", " ", "a  b   c", " lead", "trail ", "two  ", "tab\t x", "a\n\n the", "a \n b", "it's  we'll", "x  y  　 z",
    "<|endoftext|> in <|endoftext|>", "日本 語  é́ ß", "word " * 3000, "n" * 5000, "\x1c \x1d a \x85 b", "a \x1f \x1f b", "  \n  ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.byte_bpe_path())


def test_ids_are_those_of_the_library(library):
    rng = np.random.default_rng(3)
    texts = ODD + ["".join(rng.choice(list("ab é'.,\n\t  日1 \x1fs"), size=30)) for _ in range(3000)]
    texts += [" " * 100_000, "\n" * 50_000 + "x", "." * 50_000, "ab" * 30_000]
    tokens = [t.replace("Ġ", " ") for t in library.get_vocab() if t.isascii() or t[0] == "Ġ"]
    texts += ["".join(rng.choice(tokens, size=3)) for _ in range(5_000)]  # merges across the seams
    coder = P.TokenIds(P.byte_bpe_path())
    assert coder.ranks
    expected = library.encode_batch(texts, add_special_tokens=False)
    for t, e in zip(texts, expected, strict=True):
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == e.ids, t[:40]


def test_every_kind_of_character_is_split_alike(library):
    codes = [c for c in (*range(0x3100), *range(0xA000, 0xAC00), *range(0xF900, 0x11500, 3), *range(0x1D000, 0x1FC00, 5)) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}.{chr(c)}{chr(c)} b" for c in codes]
    coder = P.TokenIds(P.byte_bpe_path())
    for c, t, e in zip(codes, texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == e.ids, hex(c)


def test_other_kinds_of_files_go_through_the_library():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    coder = P.TokenIds(path)
    assert coder.ranks is None
    assert np.frombuffer(coder.encode("Some Words."), "<u4").tolist() == Tokenizer.from_file(path).encode("Some Words.", add_special_tokens=False).ids


@pytest.mark.parametrize("tokens,expected", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)])])
def test_only_long_documents_are_cut(tokens, expected):
    assert P.cut(tokens, 8) == expected


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_each_piece_once_and_well(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.choice([16, 64, 256]))
    histogram = np.zeros(size + 1, dtype=np.int64)
    drawn = rng.integers(1, size + 1, size=int(rng.integers(0, 5000)))
    np.add.at(histogram, np.minimum(drawn, size), 1)
    if seed % 2:
        histogram[size // 3] += 20_000  # one very frequent length
    plan = P.plan(histogram, size)
    lengths = np.repeat(np.arange(size + 1), histogram)
    ranks = np.concatenate([np.arange(n) for n in histogram])
    where, offset = plan.places(lengths, ranks)
    spans = defaultdict(list)
    for s, o, n in zip(where.tolist(), offset.tolist(), lengths.tolist()):
        spans[s].append((o, n))
    for parts in spans.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    assert len(spans) == plan.sequences
    least = -(-int(lengths.sum()) // size)
    big = int((lengths > size // 2).sum())
    assert plan.sequences <= max(1.03 * max(least, big), max(least, big) + 3)


def test_fit_reproduces_a_histogram_of_patterns():
    chosen = P.patterns(12, np.array([2, 3, 4, 5, 7]))
    assert {tuple(c) for c in chosen.tolist()} == {(7, 5, 0), (7, 3, 2), (5, 5, 2), (5, 4, 3), (4, 4, 4)}
    histogram = np.zeros(13)
    for c, n in zip(chosen, (10, 0, 30, 5, 7)):
        for x in c[c > 0]:
            histogram[x] += n
    x = P.fit(histogram, chosen, 2000)
    assert (x >= 0).all()
    made = np.bincount(chosen.ravel(), weights=np.repeat(x, 3), minlength=13)[1:]
    assert np.allclose(made, histogram[1:], atol=0.05)


def test_documents_are_packed_whole(llm, library):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(3, " lead", 1), (None, "no id", 2), (77, None, 3)]
    df = llm.createDataFrame(rows, "doc_id long, text string, piece int").repartition(5)
    got = P.pack_documents(df, P.byte_bpe_path()).collect()
    expected = defaultdict(int)
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            expected[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    found = defaultdict(int)
    sequences = defaultdict(list)
    for r in got:
        found[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert found == expected
    for parts in sequences.values():
        ends = [0]
        for o, n in sorted(parts):
            assert o == ends[-1]
            ends.append(o + n)
        assert ends[-1] <= 1024
    assert P.pack_documents(df.limit(0), P.byte_bpe_path()).collect() == []
