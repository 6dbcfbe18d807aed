"""Hierarchical multi-length packing of tokenised documents.

Documents become token ids plus an end id. Every whole 2048 window of a
document is a sequence by itself; the rest of it is routed to the smallest
context tier (powers of two) that holds it. Each tier is packed from the
longest: a rest opens a window of its tier, the gap is filled with the largest
rests of shorter tiers that fit, and what is then open is filled by cutting a
rest. So all windows are full but for the last open one of a partition, which
is cut into windows that are powers of two. Windows are dealt to step groups of
equally many tokens, longest first.

Tokenising and packing run in one pass over each partition: nothing is
shuffled, memory holds one batch of documents, and a task that is run again
gives the same pieces. Null texts count as empty (just the end id). Repeated
rows are packed as rows of their own. Sequence ids are unique, not dense.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import table

END_ID = 1
LONGEST = 2048
SHORTEST_TIER = 128
STEP_TOKENS = 16 * LONGEST
POOL_TOKENS = 4_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, tier int, step_group long"

#: Distinct words whose ids are kept; the table is emptied when full.
CACHED_WORDS = 500_000

# Fixed value: the contractions that the vocabulary's pre-tokenizer splits off.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


class WordTokenizer:
    """Ids of the vocabulary file's tokenizer, through a table of words.

    Texts of Latin letters and plain punctuation are split here, and each
    distinct word is encoded once; any other text goes to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.bytes = {b: chr(256 + i) for i, b in enumerate(hidden)}
        plain = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x130), *range(0x131, 0x250)]]
        kind = {c: unicodedata.category(c)[0] for c in plain}
        plain = [c for c in plain if unicodedata.normalize("NFC", c) == c and c.lower() in kind and len(c.lower()) == 1]
        group = lambda k: "".join(re.escape(c) for c in plain if kind[c] == k)
        self.odd = re.compile(f"[^{''.join(map(re.escape, plain))}]|<\\|")
        letters, numbers = group("L"), group("N")
        self.words = re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: set[str]):
        """Straight from the model, which wants a word's bytes as printable characters."""
        for w in words:
            yield w, array("I", [t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.bytes))]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [None if self.odd.search(t) else self.words.findall(t.lower()) for t in texts]
        new = {w for ws in split if ws for w in ws if w not in self.known}
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            new = {w for ws in split if ws for w in ws}
        if new:
            self.known.update(self._word_ids(new))
        get = self.known.__getitem__
        whole = iter(self._ids([t for t, ws in zip(texts, split) if ws is None]))
        return [next(whole) if ws is None else b"".join(map(get, ws)) for ws in split]


class Packer:
    """Packs rests of documents; ``emit(pieces, tokens)`` gets each closed window."""

    def __init__(self, longest: int = LONGEST, shortest: int = SHORTEST_TIER) -> None:
        self.longest, self.shortest = longest, shortest
        self.pool: list[list] = [[] for _ in range(longest + 1)]
        self.mask = 0
        self.tokens = 0

    def add(self, doc, start: int, length: int) -> None:
        if length:
            self.pool[length].append((doc, start))
            self.mask |= 1 << length
            self.tokens += length

    def _take(self, length: int):
        doc, start = self.pool[length].pop()
        if not self.pool[length]:
            self.mask &= ~(1 << length)
        self.tokens -= length
        return doc, start

    def _largest(self, most: int) -> int:
        return (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1

    def _least_over(self, length: int) -> int:
        over = self.mask >> (length + 1)
        return length + 1 + ((over & -over).bit_length() - 1) if over else 0

    def tier(self, length: int) -> int:
        size = self.shortest
        while size < length:
            size *= 2
        return size

    def pack(self, last: bool = False):
        """Yield (window size, pieces) of full windows; without ``last``, a window that stays open goes back."""
        while self.mask:
            longest = self.mask.bit_length() - 1
            size = self.tier(longest)
            pieces = [(*self._take(longest), longest)]
            gap = size - longest
            while gap and self.mask:
                fit = self._largest(gap)
                if fit > 0:
                    pieces.append((*self._take(fit), fit))
                    gap -= fit
                else:
                    length = self._least_over(gap)
                    doc, start = self._take(length)
                    pieces.append((doc, start, gap))
                    self.add(doc, start + gap, length - gap)
                    gap = 0
            if not gap:
                yield size, pieces
            elif last:
                yield from self.halves(pieces, size - gap)
            else:
                for doc, start, length in pieces:
                    self.add(doc, start, length)
                return

    @staticmethod
    def halves(pieces, total: int):
        """Cut an open window into windows that are powers of two."""
        rest = list(reversed(pieces))
        while total:
            size = 1 << (total.bit_length() - 1)
            own, gap = [], size
            while gap:
                doc, start, length = rest.pop()
                used = min(gap, length)
                own.append((doc, start, used))
                if used < length:
                    rest.append((doc, start + used, length - used))
                gap -= used
            yield size, own
            total -= size


def pack_documents(df: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST, shortest: int = SHORTEST_TIER) -> DataFrame:
    """One row per piece of a document; see SCHEMA. ``tokenizer_path`` must exist on every executor."""
    plain = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    end = array("I", [END_ID]).tobytes()
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def run(batches):
        tokenizer = _tokenizer(tokenizer_path)
        packer = Packer(longest, shortest)
        base = TaskContext.get().partitionId() << 40
        state = {"sequence": base, "group": base}

        def rows(windows):
            windows = sorted(windows, key=lambda w: -w[0])
            out = [[] for _ in names]
            filled = 0
            for size, pieces in windows:
                at = 0
                for (doc, ids), start, length in pieces:
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    for col, value in zip(out, (doc, start, length, crc, len(ids) // 4, state["sequence"], at, size, size, state["group"] + filled // STEP_TOKENS)):
                        col.append(value)
                    at += length
                state["sequence"] += 1
                filled += size
            state["group"] += -(-filled // STEP_TOKENS)
            types = [pa.int32() if n == "tier" else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

        whole: list = []
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a in range(0, len(texts), 256):
                for doc, ids in zip(docs[a : a + 256], tokenizer.encode(texts[a : a + 256])):
                    ids += end
                    n = len(ids) // 4
                    cut = n - n % longest
                    whole += [(longest, [((doc, ids), s, longest)]) for s in range(0, cut, longest)]
                    packer.add((doc, ids), cut, n - cut)
                if packer.tokens + longest * len(whole) >= POOL_TOKENS:
                    yield rows([*whole, *packer.pack()])
                    whole = []
        yield rows([*whole, *packer.pack(last=True)])

    return plain.mapInArrow(run, SCHEMA)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One per worker process; workers serve many tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def op4_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
