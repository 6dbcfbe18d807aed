"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Texts and items are compared as lower-case words without punctuation. Every
``seed_words``-gram of an item is a seed (the whole item, if it is shorter).
One pass joins documents to items on all seeds, common ones too. An alignment
through a seed that reaches the threshold has a bounded number of gap words, so
the words it may lie in are known (``reach``); hits whose reaches meet make a
passage, and the item is aligned with each passage by Smith-Waterman over words.
The score is the best alignment's share of a full match (1: verbatim). A passage
that holds too few of the item's words to reach the threshold is left out
before; nothing else is. A document that shares no seed with an item is not
compared with it.

The pass is row-wise and shuffles nothing. The items are taken in slices of at
most ``slice_bytes`` of text, each a step and a broadcast of its own, so no
broadcast grows with the benchmark.

Null and empty texts match nothing; items without a word are left out; items
that share an id count as one, by their best score. Extra columns of the
documents are carried along.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import table
from quern.llm.wordhash import chunked, window_hashes, word_hashes

SEED_WORDS = 4
THRESHOLD = 0.5
SLICE_BYTES = 4 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
_U = np.uint64



def plain(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII punctuation and control characters as spaces, and the
    capitals of the Latin-1 letters, which UTF-8 writes as C3 80 to C3 9E, as small letters."""
    out = _PLAIN[data]
    if len(out) > 1:
        capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


_PLAIN = np.arange(256, dtype=np.uint8)
for _c in range(128):
    if not chr(_c).isalnum():
        _PLAIN[_c] = 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    base = int(offsets[0])
    return word_hashes(plain(data[base : int(offsets[-1])]), offsets.astype(np.int64) - base, lower=True)


class Items:
    """A slice of the benchmark: the items' words and an index of their seeds."""

    def __init__(self, ids: list[int], texts: list[str], seed_words: int = SEED_WORDS) -> None:
        self.ids, self.words = [], []
        for i, t in zip(ids, texts):
            data = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)
            words, _ = words_of(data, np.array([0, len(data)]))
            if len(words):
                self.ids.append(i)
                self.words.append(words)
        found = defaultdict(list)
        for i, words in enumerate(self.words):
            size = min(seed_words, len(words))
            for pos, h in enumerate(window_hashes(words, size, seed=size).tolist()):
                found[size, h].append((i, pos))
        self.sizes = sorted({size for size, _ in found})
        keys = sorted(found, key=lambda k: k[1])
        self.hashes = np.array([h for _, h in keys], np.uint64)
        self.places = [found[k] for k in keys]
        # A bit table for a first test of a window, 20 bits of its hash.
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.hashes >> _U(44)).astype(np.int64)] = True

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, seed) of the seeds in a run of words (over text borders too)."""
        positions, seeds = [], []
        for size in self.sizes:
            h = window_hashes(words, size, seed=size)
            maybe = np.flatnonzero(self.table[(h >> _U(44)).astype(np.int64)])
            at = np.searchsorted(self.hashes, h[maybe])
            at[at == len(self.hashes)] = 0
            right = self.hashes[at] == h[maybe]
            positions.append(maybe[right])
            seeds.append(at[right])
        if not positions:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(positions), np.concatenate(seeds)

    def seed_size(self) -> np.ndarray:
        return np.array([min(self.sizes[-1], len(self.words[p[0][0]])) for p in self.places])


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """(best local alignment as a share of a full match, where it ends in the passage)."""
    n, m = len(item), len(passage)
    drop = -GAP * np.arange(m + 1)
    above = np.zeros(m + 1, np.int64)
    best, end = 0, 0
    for i in range(n):
        row = np.zeros(m + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(passage == item[i], MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        # Gaps along the passage: a running maximum once the linear penalty is added back.
        row = np.maximum.accumulate(row + drop) - drop
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        above = row
    return best / (MATCH * n), end


def reach(n: int, threshold: float) -> int:
    """Gap words that an alignment of ``n`` words can hold and still reach the threshold."""
    return max(0, int(MATCH * n * (1 - threshold) / -GAP + 1e-6))


def align_text(words: np.ndarray, positions: np.ndarray, seeds: np.ndarray, items: Items, threshold: float = 0.0) -> dict[int, tuple[float, int, int]]:
    """item -> (score, alignment start, alignment end) of the best passage of one text, in words."""
    diagonals = defaultdict(list)
    for p, s in zip(positions.tolist(), seeds.tolist()):
        for i, pos in items.places[s]:
            diagonals[i].append(p - pos)
    out = {}
    for i, found in diagonals.items():
        item = items.words[i]
        n, beyond = len(item), reach(len(item), threshold)
        found = sorted(set(found))
        best = (0.0, 0, 0)
        start = 0
        for k in range(1, len(found) + 1):
            if k < len(found) and found[k] - found[k - 1] <= n + 2 * beyond:
                continue
            near = found[start:k]
            lo, hi = max(0, near[0] - beyond), min(len(words), near[-1] + n + beyond)
            start = k
            at = next((d for d in reversed(near) if d >= 0 and np.array_equal(words[d : d + n], item)), None)
            if at is not None:
                best = max(best, (1.0, at, at + n))
            # Each point of the score needs a word of the item.
            elif best[0] < 1 and np.isin(item, words[lo:hi]).sum() / n >= threshold:
                score, end = smith_waterman(item, words[lo:hi])
                if score >= threshold and score > best[0]:
                    _, back = smith_waterman(item[::-1], words[lo : lo + end][::-1])
                    best = (score, lo + end - back, lo + end)
        out[i] = best
    return out


def _rows(items: Items, column: pa.Array):
    """(row, words, positions, seeds) of the texts with a seed."""
    for i, data, offsets in chunked(column):
        words, at = words_of(data, offsets)
        positions, seeds = items.hits(words)
        if not len(positions):
            continue
        order = np.argsort(positions, kind="stable")
        positions, seeds = positions[order], seeds[order]
        row = np.searchsorted(at, positions, "right") - 1
        inside = positions + items.seed_size()[seeds] <= at[row + 1]
        positions, seeds, row = positions[inside], seeds[inside], row[inside]
        edge = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True]) if len(row) else np.zeros(1, int)
        for a, b in zip(edge[:-1], edge[1:]):
            r = row[a]
            yield i + int(r), words[at[r] : at[r + 1]], positions[a:b] - at[r], seeds[a:b]


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, seed_words: int = SEED_WORDS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Add ``leaks``: array<struct(item_id, score, start_word, end_word)> of the
    items with an alignment through a seed that scores at least ``threshold``, best first; [] for clean rows."""
    spark = docs.sparkSession
    bench = items.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t"))
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    slices = -(-total // slice_bytes) or 1
    rest = [c for c in docs.columns if c != "leaks"]
    out = docs.select(*rest).withColumn("leaks", F.array().cast("array<struct<item_id:bigint,score:double,start_word:bigint,end_word:bigint>>"))
    for k in range(slices):
        rows = bench.filter(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k).orderBy("i", "t").collect()
        own = Items([r["i"] for r in rows], [r["t"] for r in rows], seed_words)
        if not own.words:
            continue
        out = out.mapInArrow(_align(spark.sparkContext.broadcast(own), out.columns.index(text), out.columns.index("leaks"), threshold), out.schema)
    return out


def _align(sent, text_at: int, leaks_at: int, threshold: float):
    def run(batches):
        items = sent.value
        for batch in batches:
            found = {}
            for row, words, positions, seeds in _rows(items, batch.column(text_at)):
                leaks = [(items.ids[i], *best) for i, best in align_text(words, positions, seeds, items, threshold).items() if best[0] >= threshold]
                if leaks:
                    found[row] = leaks
            column = batch.column(leaks_at)
            if found:
                merged = column.to_pylist()
                for row, leaks in found.items():
                    best = {}
                    for x in merged[row] + [dict(zip(("item_id", "score", "start_word", "end_word"), leak)) for leak in leaks]:
                        if x["item_id"] not in best or x["score"] > best[x["item_id"]]["score"]:
                            best[x["item_id"]] = x
                    merged[row] = sorted(best.values(), key=lambda x: (-x["score"], x["item_id"]))
                column = pa.array(merged, column.type)
            columns = [column if i == leaks_at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def op7_benchmark_decontamination(spark, sf_dir):
    """One row per document and benchmark item that it leaks."""
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    leak = found.select("doc_id", F.explode("leaks").alias("leak"))
    return leak.select("doc_id", "leak.item_id", F.round("leak.score", 6).alias("score"), "leak.start_word", "leak.end_word")
