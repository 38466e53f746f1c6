"""The segment-tree encoder against the tokenizers library."""

import hashlib

import numpy as np
from tokenizers import Tokenizer

from docdrift.llm import bpe as B

ODD = [
    "", "  ", "Hello  World<|endoftext|> it's ÉCOLE 12  x <|startoftext|>", "héllo 日本 \U0001f600 \x00 a\x1cb c\x1f",
    "ΣΑΣ ς İstanbul é ẛ̣  x　y", "a" * 3000 + " " + "ab" * 2000, "...!!??", "<|endoftext|>" * 3,
    "don't we'll I'M", "K ; x​y", "<|endoftext|", "word. word, word; (word)", "1234 5,6",
]


def test_ids_and_text_are_those_of_the_library():
    library, own = Tokenizer.from_file(B.word_bpe_path()), B.WordBpe(B.word_bpe_path())
    rng = np.random.default_rng(1)
    letters = list("abcdeéèüñß '.,!?\n\t<|>0123456789ΣÀ日本́\xa0\x85 -_\x1d'sllre")
    texts = ODD + ["".join(rng.choice(letters, size=int(rng.integers(0, 60)))) for _ in range(3000)]
    for _ in range(2):  # the second time from memory
        for t, ids in zip(texts, own.encode(texts), strict=True):
            expected = library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == expected, t[:40]
            assert own.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_merge_order_is_leftmost_lowest_rank():
    symbols = B.byte_symbols()
    vocab = {s: i for i, s in enumerate(symbols)} | {s + "</w>": 256 + i for i, s in enumerate(symbols)}
    merges = [["a", "a"], ["aa", "aa"], ["b", "aa"], ["aa", "a</w>"]]
    for i, (x, y) in enumerate(merges):
        vocab[x + y] = 512 + i
    coder = B.Merges(vocab, merges, "</w>")

    def plain(word):
        parts = [symbols[b] for b in word[:-1]] + [symbols[word[-1]] + "</w>"]
        while True:
            ranks = [merges.index([x, y]) if [x, y] in merges else 99 for x, y in zip(parts, parts[1:])]
            if not ranks or min(ranks) == 99:
                return [vocab[p] for p in parts]
            k = ranks.index(min(ranks))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    rng = np.random.default_rng(5)
    words = [bytes(rng.choice([97, 98], size=int(rng.integers(1, 40)), p=[0.8, 0.2]).astype(np.uint8)) for _ in range(500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(words)] == [plain(w) for w in words]


def test_table(llm):
    library = Tokenizer.from_file(B.word_bpe_path())
    rows = [(i, t, b"x") for i, t in enumerate(ODD)] + [(2, ODD[2], None), (None, "no id", None), (9, None, None)]
    df = llm.createDataFrame(rows, "doc_id long, text string, ids binary")
    got = B.encode_and_decode(df, B.word_bpe_path()).collect()
    expected = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((str(i), np.array(ids, "<u4").tobytes().hex(), library.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), bytes(r.ids).hex(), r.decoded) for r in got) == sorted(expected)
    assert B.encode_and_decode(df.limit(0), B.word_bpe_path()).collect() == []


def test_query_digests(llm):
    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(B.word_bpe_path())
    texts = {r.doc_id: r.text or "" for r in llm.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = B.op8_bpe(llm, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
