"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, zero-width characters dropped, Cyrillic,
Greek and full-width look-alikes and digits or signs inside words mapped to the
Latin letters they stand for, and words spelt out with dots, dashes, underscores
or stars joined. The automaton holds whole words, word beginnings
(stems) and exception phrases; what an exception phrase covers does not count,
and each word counts once, with the largest weight that matches it.

Weights are smoothed log-odds of the entry's document frequency in toxic and
clean labelled texts. A text's score is a logistic function of its matched
weight normalised by a power of its length, its heaviest match, and its length;
the function is fitted on the same texts with each text's own counts left out.

Fitted on the driver from a bounded sample of labelled rows (``toxic_rows`` and
``clean_rows``, those with the smallest hash of their id; whole texts).
Without labels of both kinds every score is 0. Null and empty texts are scored
as texts without a match. Labels that are null count as missing; a document
with several labels is used once per label.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import id_fold, last_within, table

TOXIC_ROWS = 1500
CLEAN_ROWS = 3000
SAMPLE_BYTES = 64 << 20
MOST_ENTRIES = 8192
LEAST_SUPPORT = 3
LEAST_WEIGHT = 2.0
STEMS = range(4, 9)

# Look-alikes and substitutions, character by character.
LOOKS = ("аеорсухівкмнтѕјӏԁոαβεικνορτυχωρɡıⅰl", "aeopcyxibkmhtsjidnabeiknoptuxwpgiii")
DIGITS = ("0134578", "oieastb")
SIGNS = ("@$!|+", "asiit")
#: l, 1 and i look alike and all become i, in texts and entries.
#: Harmless phrases around entries of common lexicons.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "loser bracket", "pond scum", "soap scum")

_FOLD = str.maketrans(LOOKS[0] + DIGITS[0], LOOKS[1] + DIGITS[1]) | {0xFF41 + i: 0x61 + i for i in range(26)}
_FOLD |= dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_SIGN = re.compile(r"(?<=[^\W_])[@$!|+](?=[^\W_])")
_SPELT = re.compile(r"(?<![^\W_])[^\W_](?:[.*_-][^\W_]){2,}(?![^\W_])")
_SIGN_OF = dict(zip(*SIGNS))
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The folded words of a text."""
    low = _SIGN.sub(lambda m: _SIGN_OF[m[0]], (text or "").lower().translate(_FOLD))
    return _WORD.findall(_SPELT.sub(lambda m: m[0][::2], low))


def entries_of(word: str) -> list[str]:
    """The lexicon entries that a word could match: itself, and its stems marked by ``*``."""
    return [word, *[word[:n] + "*" for n in STEMS if n < len(word)]]


@dataclass
class Model:
    weights: dict[str, float]
    coef: np.ndarray
    power: float
    exceptions: tuple[str, ...] = EXCEPTIONS
    automaton: object = field(default=None, repr=False, compare=False)

    def build(self) -> "Model":
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            stem = entry.endswith("*")
            key = f" {entry[:-1]}" if stem else f" {entry} "
            self.automaton.add_word(key, (len(key), w, False))
        for phrase in self.exceptions:
            key = f" {' '.join(words_of(phrase))} "
            self.automaton.add_word(key, (len(key), 0.0, True))
        self.automaton.make_automaton()
        return self

    def matches(self, words: list[str]) -> list[float]:
        """The weight of each matched word, best entry each, outside exception phrases."""
        if not words or not len(self.automaton):
            return []
        best: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (length, w, exempt) in self.automaton.iter(f" {' '.join(words)} "):
            start = end - length + 1
            if exempt:
                free.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        return [w for at, w in best.items() if not any(a <= at < b for a, b in free)] if free else list(best.values())

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([summary(self.matches(ws := words_of(t)), len(ws), self.power) for t in texts]).reshape(-1, 3)
        return 1 / (1 + np.exp(-(x @ self.coef[1:] + self.coef[0])))


def summary(weights: list[float], n_words: int, power: float) -> tuple[float, float, float]:
    return sum(weights) / max(1, n_words) ** power, max(weights, default=0.0), np.log1p(n_words) / 10


def _odds(ct: float, cn: float, nt: int, nn: int) -> float:
    return float(np.log((ct + 0.5) / (nt + 1)) - np.log((cn + 0.5) / (nn + 1)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> tuple[np.ndarray, float]:
    """Coefficients (bias first) by Newton steps, and the loss."""
    z = np.hstack([np.ones((len(x), 1)), x])
    coef = np.zeros(z.shape[1])
    keep = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ coef, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + keep, z.T @ (p - y) + keep @ coef)
        coef -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ coef, -30, 30))), 1e-9, 1 - 1e-9)
    return coef, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def train(texts: list[str | None], labels: list[int]) -> Model | None:
    """Fit lexicon and score function; near copies in the sample are used once."""
    rows, seen = [], set()
    for t, y in zip(texts, labels):
        ws = words_of(t)
        grams = [hash_of(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
        marks = {(k, min((g * m) & 0xFFFFFFFF for g in grams)) for k, m in enumerate((1, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))}
        if ws and len(marks & seen) < 2:
            rows.append((ws, int(y)))
            seen |= marks
    nt, nn = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    if not nt or not nn:
        return None
    entries = lambda ws: {e for w in set(ws) for e in entries_of(w)}
    toxic = Counter()
    for ws, y in rows:
        if y:
            toxic.update(entries(ws))
    toxic = {e: c for e, c in toxic.items() if c >= LEAST_SUPPORT}
    clean = Counter()
    for ws, y in rows:
        if not y:
            clean.update(entries(ws) & toxic.keys())
    odds = {e: _odds(c, clean[e], nt, nn) for e, c in toxic.items()}
    chosen = sorted((e for e, w in odds.items() if w >= LEAST_WEIGHT), key=lambda e: (-odds[e], e))[:MOST_ENTRIES]
    weights = {e: round(odds[e], 6) for e in chosen}
    y = np.array([y for _, y in rows], float)
    hits = []
    for ws, label in rows:
        # This text's own counts left out, so that chance entries earn nothing on it.
        mine = {}
        for e in entries(ws) & weights.keys():
            w = _odds(toxic[e] - label, clean[e] - 1 + label, nt - label, nn - 1 + label) if toxic[e] > label else 0.0
            mine[e] = max(0.0, w)
        found = [max((mine[e] for e in entries_of(w) if e in mine), default=0.0) for w in ws] if mine else []
        hits.append(([w for w in found if w > 0], len(ws)))
    fits = []
    for power in (0.25, 0.5, 0.75, 1.0):
        x = np.array([summary(h, n, power) for h, n in hits])
        coef, loss = _logistic(x, y)
        fits.append((loss, power, coef))
    _, power, coef = min(fits, key=lambda f: f[:2])
    return Model(weights, coef, power)


def hash_of(words: list[str]) -> int:
    import zlib

    return zlib.crc32(" ".join(words).encode("utf-8", "surrogatepass"))


def fit_from(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Train on at most ``toxic_rows`` + ``clean_rows`` labelled documents, of
    ``sample_bytes`` of text each kind. They are chosen from the labels alone, so only
    their texts are read and sent; equal texts count once."""
    kept = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).alias("__y"))
    texts, found = [], []
    for y, most in ((1, toxic_rows), (0, clean_rows)):
        chosen = kept.filter(F.col("__y") == y).distinct().orderBy(F.xxhash64("__id"), "__id").limit(most)
        rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("t")).filter("t is not null").join(F.broadcast(chosen), "__id").select("t", F.xxhash64("t").alias("h"))
        sizes = rows.groupBy("h").agg(F.max(F.octet_length("t")).alias("n")).orderBy("h").limit(most).collect()
        last = last_within([(r["h"], r["n"]) for r in sizes], sample_bytes)
        rows = [] if last is None else rows.filter(F.col("h") <= last).dropDuplicates(["h"]).collect()
        texts += sorted(r["t"] for r in rows)
        found += [y] * len(rows)
    return train(texts, found)


def score_toxicity(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add score and predicted (replacing columns of those names); row-wise, whole texts, no shuffle."""
    out = {"score": "double", "predicted": "int"}
    rest = [c for c in df.columns if c not in out]
    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # at most MOST_ENTRIES entries
    at = rest.index(text)

    def run(batches):
        own = pickle.loads(sent.value)
        own = own and own.build()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            scores = own.scores(texts) if own else np.zeros(len(texts))
            cols = [batch.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=[*rest, *out])

    plain = df.select(*rest)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields] + [f"{k} {v}" for k, v in out.items()])
    return plain.mapInArrow(run, schema)


def training_labels(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The labels outside the held-out fold."""
    return labels.filter(id_fold(doc_id, 5) != 0)


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_from(docs, training_labels(table(spark, sf_dir, "labels")))
    return score_toxicity(docs.select("doc_id", (id_fold("doc_id", 5) == 0).alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
