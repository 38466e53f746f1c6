"""Best-fit packing of token pieces into sequences by patterns.

The histogram of piece lengths (one count per possible length) is all the
driver sees. Patterns of a few lengths that fill a sequence exactly are
enumerated, non-negative least squares fits how often each is to be repeated,
the counts are rounded down to what the histogram holds, and what remains is
packed best-fit by decreasing length, count by count.

Pieces get their places without meeting in one task: a piece's rank among
those of its length is its rank inside its partition plus the number of such
pieces in earlier partitions, and a plan of runs (length, first rank, count)
turns the rank into a sequence and an offset. The plan's size depends on the
sequence length alone, not on the number of documents.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import by_bytes, byte_symbols
from .tables import table

#: The query's contract: tokens in a sequence, and the id that ends a document.
SEQUENCE, END = 1024, 2
#: Steps of the least-squares fit.
STEPS = 300
# Fixed value: the pieces of byte-level pre-tokenization.
_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a tokenizer file as bytes with their ids, where the
    file is plain byte-level BPE whose ids count up in the order of the merges,
    so that ids are merge ranks; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and spec["post_processor"] is None and model["type"] == "BPE"
    plain = plain and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if not plain or any(model.get(o) for o in options):
        return None
    symbols, vocab = {s: b for b, s in enumerate(byte_symbols())}, model["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in pairwise(made)) or max(vocab[s] for s in symbols) >= made[0]:
        return None
    return {bytes(symbols[c] for c in token): i for token, i in vocab.items()}


class TokenIds:
    """Ids of whole texts by a tokenizer file of the ``tokenizers`` library.

    Plain byte-level files are read as merge ranks and encoded by ``tiktoken``,
    which gives the same ids several times faster and remembers nothing; texts
    with a special token's string, and all texts for other kinds of files, go
    through the library itself."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core only
        self.coder = Tokenizer.from_file(path)
        self.coder.no_truncation()
        self.coder.no_padding()
        self.special = [t.content for t in self.coder.get_added_tokens_decoder().values()]
        ranks = byte_ranks(path)
        self.ranks = ranks and tiktoken.Encoding(path, pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.ranks is None or any(s in text for s in self.special):
            return _packed(self.coder.encode(text, add_special_tokens=False).ids)
        return _packed(self.ranks.encode_ordinary(text))


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    """Loaded once per Python worker."""
    return TokenIds(path)


def cut(tokens: int, sequence: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: whole sequences, of which
    the first may be shorter."""
    first = tokens % sequence or sequence
    return [(0, first), *((s, sequence) for s in range(first, tokens, sequence))]


def token_pieces(
    df: DataFrame, path: str, sequence: int = SEQUENCE, end: int = END, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and each piece's ``part``
    (its partition) and ``rank`` (among the partition's pieces of its length).
    Null text counts as empty (the end token alone)."""
    thin = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = thin.schema["doc_id"].dataType.simpleString()
    last = _packed([end])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen, part = token_ids(path), Counter(), TaskContext.get().partitionId()
        for batch in by_bytes(batches, "text"):
            of, rows = [], []
            for i, text in enumerate(batch.column("text")):
                ids = memoryview(coder.encode(text.as_py() or "") + last)
                for piece, (start, length) in enumerate(cut(len(ids) // 4, sequence)):
                    of.append(i)
                    rows.append((piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(of)), columns[0].cast(pa.int32()), *columns[1:]],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    return thin.mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, rank long"
    )


def patterns(sequence: int, lengths: np.ndarray) -> np.ndarray:
    """Rows of up to three of ``lengths`` (descending, padded with 0) that add
    up to ``sequence``."""
    has = np.zeros(sequence + 1, dtype=bool)
    has[lengths] = True
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    c = sequence - a - b
    good = (a >= b) & (c >= 0) & ((c == 0) | ((b >= c) & has[np.maximum(c, 0)]))
    found = np.stack([a[good], b[good], c[good]], axis=1)
    alone = np.array([[sequence, 0, 0]] if has[sequence] else [], dtype=np.int64).reshape(-1, 3)
    return np.concatenate([alone, found])


def fit(histogram: np.ndarray, chosen: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative least squares: repeat counts of ``chosen`` patterns whose
    lengths come closest to ``histogram``, by accelerated projected gradient
    steps."""
    size = len(histogram)
    flat = chosen.ravel()

    def lengths_of(x: np.ndarray) -> np.ndarray:
        total = np.bincount(flat, weights=np.repeat(x, 3), minlength=size)
        total[0] = 0  # padding
        return total

    def slope(x: np.ndarray) -> np.ndarray:
        miss = lengths_of(x) - histogram
        miss[0] = 0
        return miss[chosen].sum(axis=1)

    # The largest eigenvalue, by power iteration, bounds the step.
    v = np.ones(len(chosen))
    for _ in range(20):
        v = lengths_of(v)[chosen].sum(axis=1)
        norm = np.linalg.norm(v)
        v /= norm
    rate = 1 / (1.05 * np.linalg.norm(lengths_of(v)[chosen].sum(axis=1)))
    x = y = np.zeros(len(chosen))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * slope(y))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(left: np.ndarray, sequence: int) -> Counter:
    """Best-fit decreasing over counts: how often each pattern (lengths in
    their order) packs the pieces counted in ``left``."""
    bins: dict[int, Counter] = defaultdict(Counter)  # free tokens -> patterns
    for length in range(sequence, 0, -1):
        count = int(left[length])
        while count:
            free = next((f for f in range(length, sequence) if bins.get(f)), sequence)
            fits = free // length
            if free == sequence:
                opened = count // fits
                if opened:
                    bins[free - fits * length][(length,) * fits] += opened
                if rest := count % fits:
                    bins[free - rest * length][(length,) * rest] += 1
                break
            pattern, many = next(iter(bins[free].items()))
            filled = min(many, count // fits)
            if filled:
                _move(bins, free, pattern, filled, length, fits)
                count -= filled * fits
            elif count:
                _move(bins, free, pattern, 1, length, count)
                count = 0
    return sum(bins.values(), Counter())


def _move(bins: dict[int, Counter], free: int, pattern: tuple, many: int, length: int, times: int) -> None:
    bins[free][pattern] -= many
    if not bins[free][pattern]:
        del bins[free][pattern]
    bins[free - length * times][pattern + (length,) * times] += many


@dataclass(frozen=True)
class Plan:
    """Runs of pieces of one length: ranks ``first[i] ..`` go to offset
    ``offset[i]`` of sequences ``sequence[i] ..``; by length."""

    first: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    sequences: int

    def places(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            run = np.searchsorted(self.first[n], ranks[rows], side="right") - 1
            where[rows] = self.sequence[n][run] + ranks[rows] - self.first[n][run]
            offset[rows] = self.offset[n][run]
        return where, offset


def plan(histogram: np.ndarray, sequence: int) -> Plan:
    """Patterns and their repeat counts for a histogram (index: length)."""
    left = histogram.astype(np.int64).copy()
    used: Counter = Counter()
    lengths = np.flatnonzero(left)
    chosen = patterns(sequence, lengths)
    if len(chosen):
        wanted = np.floor(fit(left.astype(float), chosen) + 1e-6).astype(np.int64)
        for k in np.argsort(-wanted, kind="stable"):
            if not wanted[k]:
                break
            need = Counter(int(n) for n in chosen[k] if n)
            if many := min(int(wanted[k]), *(int(left[n]) // c for n, c in need.items())):
                used[tuple(int(n) for n in chosen[k] if n)] += many
                for n, c in need.items():
                    left[n] -= many * c
    used += best_fit(left, sequence)
    runs, taken, sequences = defaultdict(list), Counter(), 0
    for pattern, many in sorted(used.items(), reverse=True):
        offset = 0
        for n in pattern:
            runs[n].append((taken[n], sequences, offset))
            taken[n] += many
            offset += n
        sequences += many
    by = {n: np.array(r, dtype=np.int64).T for n, r in runs.items()}
    return Plan(*({n: r[i] for n, r in by.items()} for i in range(3)), sequences)


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Place the stored ``token_pieces`` into sequences: ``doc_id, piece,
    start, length, ids_crc32, sequence_id, offset``."""
    spark = pieces.sparkSession
    counted = cut_lineage(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(sequence + 1, dtype=np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length
        histogram[r["length"]] = r["n"]
    made = spark.sparkContext.broadcast(plan(histogram, sequence))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = cut_lineage(counted.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    kind = ranked.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, offset = made.value.places(
                batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(where), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(
    df: DataFrame, path: str, sequence: int = SEQUENCE, end: int = END, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of every document: ``doc_id, piece`` (from 0),
    ``start`` (ids of the document before it), ``length``, ``ids_crc32`` (of
    its ids as little-endian unsigned 32-bit), ``sequence_id``, ``offset``.

    A document is the ids of its whole text followed by ``end``; only one
    longer than ``sequence`` is cut. Sequences have no gaps from 0 on and at
    most ``sequence`` ids. Null and empty texts are one piece of the end token.
    Repeated rows and null ids are packed like any other row; other columns
    are ignored. An empty table gives an empty result.
    """
    return pack(cut_lineage(token_pieces(df, path, sequence, end, id_col, text_col)), sequence)


def byte_bpe_path() -> str:
    """The vocabulary file of the registered query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), path or byte_bpe_path())
