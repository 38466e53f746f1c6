"""Byte-pair encoding with a segment tree over adjacent pair ranks.

A piece of text is a row of byte symbols. The leaves of its segment tree hold
the merge rank of each adjacent pair together with the pair's place, so the
root yields the leftmost pair of lowest rank. A merge changes three leaves
(the pair, the one it swallows and the one before it), each a point update of
logarithmic cost, until no mergeable pair remains. The trees of many pieces
are rows of one numpy matrix and advance together, one merge each per step.

Pieces are encoded once per batch of rows and remembered (a bounded memory per
Python worker, which changes speed and nothing else).
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

#: Remembered chunks per worker; past it the memory starts anew.
REMEMBERED = 300_000
#: Longer chunks are not remembered.
LONG_CHUNK = 48
#: Tree cells that advance together (bounds the memory of a step).
CELLS = 1 << 17
#: Output text bytes after which a batch of rows is handed on.
BATCH_BYTES = 4 << 20

_NEVER = np.int64(1) << 62
#: Separators of ``str.split`` that the tokenizer does not count as white space.
_ODD = re.compile("[\x1c-\x1f]")
#: White space of the tokenizer's patterns (fixed values).
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: itself for the visible Latin-1 bytes, the others count up
    from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Merges:
    """Vocabulary and merges of a byte-level BPE file, and the merge loop."""

    def __init__(self, vocab: dict[str, int], merges: list, word_end: str) -> None:
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.width = max(vocab.values()) + 1
        codes = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.rank = codes[order], order.astype(np.int64)
        self.made = made  # by rank
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocab[s + word_end] for s in symbols], dtype=np.int64)
        # Ranks of pairs of bytes (the second one inner or last), for the first leaves.
        pair = np.arange(256)
        ends = np.concatenate([self.inner, self.last])
        self.first = self._ranks(self.inner[pair][:, None], ends[None, :])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; -1 for pairs without a merge."""
        code = left * self.width + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.rank[at], -1)

    @staticmethod
    def _keys(rank: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
        """Leaf values: merge rank, then place."""
        return np.where(rank >= 0, (rank << bits) | place, _NEVER)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece (at least one byte long), little-endian
        unsigned 32-bit."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        leaves = 1 << np.ceil(np.log2(np.maximum(sizes - 1, 1))).astype(int)
        for n in np.unique(leaves):
            members = np.flatnonzero(leaves == n)
            step = max(1, CELLS // int(2 * n))
            for i in range(0, len(members), step):
                rows = members[i : i + step]
                flat, ends = self._merge([pieces[k] for k in rows], sizes[rows], int(n))
                start = 0
                for k, end in zip(rows.tolist(), (4 * ends).tolist(), strict=True):
                    out[k] = flat[start:end]
                    start = end
        return out

    def _merge(self, pieces: list[bytes], sizes: np.ndarray, n: int) -> tuple[bytes, np.ndarray]:
        count, bits = len(pieces), n.bit_length()
        # Places 0..n hold symbols; n + 1 stands for "none".
        none = n + 1
        symbol = np.zeros((count, n + 2), dtype=np.int64)
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        row = np.repeat(np.arange(count), sizes)
        ends = np.cumsum(sizes)
        column = np.arange(len(raw)) - np.repeat(ends - sizes, sizes)
        symbol[row, column] = self.inner[raw]
        symbol[np.arange(count), sizes - 1] = self.last[raw[ends - 1]]
        alive = np.arange(n + 2) < sizes[:, None]
        after = np.where(np.arange(n + 2) + 1 < sizes[:, None], np.arange(n + 2) + 1, none)
        before = np.tile(np.concatenate([[none], np.arange(n + 1)]), (count, 1))
        tree = np.full((count, 2 * n), _NEVER)
        if len(raw) > 1:
            second = raw[1:].astype(np.int64)
            second[column[1:] == sizes[row[1:]] - 1] += 256
            inside = row[1:] == row[:-1]
            rank = np.where(inside, self.first[raw[:-1], second], -1)
            tree[row[:-1][inside], n + column[:-1][inside]] = self._keys(rank, column[:-1], bits)[inside]
        level = n
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        rows = np.arange(count)
        while len(rows := rows[tree[rows, 1] < _NEVER]):
            root = tree[rows, 1]
            place = root & ((1 << bits) - 1)
            symbol[rows, place] = merged = self.made[root >> bits]
            swallowed = after[rows, place]
            follower = after[rows, swallowed]
            after[rows, place] = follower
            before[rows, follower] = place  # the column of "none" takes any value
            alive[rows, swallowed] = False
            previous = before[rows, place]
            here = np.where(follower == none, _NEVER, self._keys(self._ranks(merged, symbol[rows, follower]), place, bits))
            there = self._keys(self._ranks(symbol[rows, previous], merged), previous, bits)
            tree[rows, n + place] = here
            has = previous != none
            tree[rows[has], n + previous[has]] = there[has]
            gone = swallowed < n
            tree[rows[gone], n + swallowed[gone]] = _NEVER
            node = (n + np.stack([place, np.where(gone, swallowed, place), np.where(has, previous, place)])) >> 1
            while n > 1:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                if node[0, 0] == 1:
                    break
                node >>= 1
        return symbol[alive].astype("<u4").tobytes(), np.cumsum(alive.sum(axis=1))


class WordBpe:
    """The tokenizer of a JSON file of the ``word_bpe`` kind: NFC, white space
    dropped, lower case, words with an end mark, byte symbols, BPE."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split).findall
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**model["vocab"], **special}.items()}
        self.special = {t: np.array([i], dtype="<u4").tobytes() for t, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.known: dict[str, bytes] = {}

    def _normal(self, chunk: str) -> str:
        if chunk.isascii():
            return chunk.lower()
        chunk = unicodedata.normalize("NFC", chunk)
        # Character by character: no final sigma.
        return "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()

    def _split(self, chunk: str) -> tuple[str, ...]:
        """The pieces of a chunk; a word with marks after it needs no pattern."""
        normal = self._normal(chunk)
        word = normal.rstrip(".,;:!?")
        if word.isalpha():
            return (word, normal[len(word) :]) if len(word) < len(normal) else (word,)
        return tuple(self.pieces(normal))

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks (little-endian unsigned 32-bit) not yet known."""
        split = {c: self._split(c) for c in chunks}
        words = list(set().union(*split.values()))
        coded = self.merges.encode([w.encode() for w in words]) if words else []
        ids = dict(zip(words, coded, strict=True))
        return {c: ids[p[0]] if len(p) == 1 else b"".join([ids[x] for x in p]) for c, p in split.items()}

    def _parts(self, text: str) -> list[tuple[bool, list[str]]]:
        """Chunks between white space; special tokens stand by themselves."""
        parts = self.cut.split(text) if self.cut and "<|" in text else [text]
        chunks = (_SPACE.split(p) if _ODD.search(p) else p.split() for p in parts)
        return [(i % 2 == 1, [parts[i]] if i % 2 else [c for c in found if c]) for i, found in enumerate(chunks)]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each whole text, little-endian unsigned 32-bit."""
        parted = [self._parts(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        wanted: set[str] = set()
        for parts in parted:
            for special, chunks in parts:
                if not special:
                    wanted.update(chunks)
        fresh = self._learn(wanted.difference(self.known))
        self.known.update((c, ids) for c, ids in fresh.items() if len(c) <= LONG_CHUNK)
        long = {c: ids for c, ids in fresh.items() if len(c) > LONG_CHUNK}
        known, special_ids = (self.known | long) if long else self.known, self.special
        return [
            b"".join([b"".join(map((special_ids if special else known).__getitem__, chunks)) for special, chunks in parts])
            for parts in parted
        ]

    def decode(self, ids: bytes) -> str:
        """The text of ids as the library writes it, special tokens included."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """Loaded once per Python worker."""
    return WordBpe(path)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds some megabytes at most
    (or one row)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // BATCH_BYTES
        starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def encode_and_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, ids`` (binary, little-endian unsigned
    32-bit), ``decoded`` (the ids' text).

    ``path`` names a tokenizer file that every worker can read. Null text
    counts as empty; an empty text has no ids and decodes to the empty text.
    Repeated rows and null ids each give a row. Texts are encoded whole, of
    any length; other columns are ignored.
    """
    thin = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = thin.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in by_bytes(batches, "text"):
            ids = coder.encode(t or "" for t in batch.column("text").to_pylist())
            decoded = [coder.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    return thin.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def word_bpe_path() -> str:
    """The vocabulary file of the registered query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All whole ``documents``, encoded and decoded; digests of both."""
    coded = encode_and_decode(table(spark, sf_dir, "documents"), path or word_bpe_path())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
