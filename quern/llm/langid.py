"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is the bag of the hashed 1- to 3-grams of its letters (lower case, every
run of other characters one boundary). The average of their embeddings goes
through a linear softmax. Both are trained together by stochastic gradient
descent in numpy on the driver, from a bounded sample of the labelled rows
(``sample`` rows and ``sample_bytes`` of text, those with the smallest hash of
their text; whole texts, so a text larger than that alone ends the sample).
Afterwards a temperature and a rejection threshold are fitted on a part of that
sample kept out of training: a prediction whose calibrated probability is under
the threshold is marked rejected, the prediction itself stays.

Null texts and texts without a letter are ``und`` with score 0. Without any
labelled row every text is ``und``. Repeated rows are predicted alike.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import id_fold, last_within, table

SLOT_BITS = 16
DIM = 16
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 64 << 20
CHUNK = 1 << 19


@dataclass
class Model:
    langs: list[str]
    #: embeddings times softmax weights: a row of class scores for each slot
    slot_scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, text offsets into them, letters per text) of a batch."""
    joined = [(" " + t.lower() + " ") if t else " " for t in texts]
    sizes = np.fromiter(map(len, joined), dtype=np.int64, count=len(joined))
    code = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letter = _letters()[code]
    letters = np.bincount(owner[letter], minlength=len(texts))
    # Of a run of other characters only the last stays, as a boundary.
    keep = letter.copy()
    keep[:-1] |= letter[1:] | (owner[1:] != owner[:-1])
    if len(keep):
        keep[-1] = True
    code, owner, letter = np.where(letter, code, 32)[keep].astype(np.uint32), owner[keep], letter[keep]
    mask = np.uint32((1 << SLOT_BITS) - 1)
    slots = []
    owners = []
    h = np.zeros(len(code), dtype=np.uint32)
    for n in range(1, 4):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ code[n - 1 : n - 1 + m]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        inside = owner[:m] == owner[n - 1 :][:m]
        inside &= letter[:m] if n == 1 else letter[:m] | letter[n - 1 :][:m]
        slots.append(((h ^ np.uint32(n * 0x1B873593)) & mask)[inside])
        owners.append(owner[:m][inside])
    if not slots:
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64), letters
    slot, own = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(texts)))])
    return slot[order], offsets, letters


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 8, rate: float = 1.0, seed: int = 7) -> Model | None:
    """SGD over (text, label) rows; every eighth row only calibrates."""
    rows = [(t, y) for t, y in zip(texts, labels) if t and y is not None]
    if not rows:
        return None
    langs = sorted({y for _, y in rows})
    target = np.array([langs.index(y) for _, y in rows])
    bags = []
    for t, _ in rows:
        slots, _, _ = features([t])
        used, counts = np.unique(slots, return_counts=True)
        bags.append((used, (counts / max(1, counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((1 << SLOT_BITS, DIM)) * 0.1).astype(np.float32)
    out = np.zeros((DIM, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    calibrate = [i for i in range(len(rows)) if i % 8 == 7] or [0]
    fit = [i for i in range(len(rows)) if i % 8 != 7]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            used, share = bags[i]
            mean = share @ emb[used]
            p = _softmax(mean @ out + bias)
            p[target[i]] -= 1
            back = out @ p
            out -= step * np.outer(mean, p)
            bias -= 0.1 * step * p
            emb[used] -= step * 20 * share[:, None] * back
    slot_scores = (emb @ out).astype(np.float32)
    z = np.stack([bags[i][1] @ slot_scores[bags[i][0]] + bias for i in calibrate])
    y = target[calibrate]
    losses = {t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.05, 20, 61)}
    temperature = float(min(losses, key=losses.get))
    p = _softmax(z / temperature)
    right, score = p.argmax(1) == y, p.max(1)
    # The lowest threshold at which the accepted rows are at least 99 % right; at most a tenth are rejected.
    order = np.argsort(-score)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= 0.99
    accepted = max(int(good.nonzero()[0].max()) + 1 if good.any() else 0, int(np.ceil(0.9 * len(order))))
    return Model(langs, slot_scores, bias, temperature, float(score[order[accepted - 1]]))


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    slots, offsets, letters = features(texts)
    none = letters == 0
    if model is None:
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    scores = model.slot_scores[slots]
    sums = np.zeros((len(texts), len(model.langs)))
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        sums[full] = np.add.reduceat(scores, offsets[full], axis=0, dtype=np.float64)
    z = sums / np.maximum(1, offsets[1:] - offsets[:-1])[:, None] + model.bias
    p = _softmax(z / model.temperature)
    best, score = p.argmax(1), np.where(none, 0.0, p.max(1))
    return ["und" if n else model.langs[b] for n, b in zip(none, best)], score, none | (score < model.threshold)


def fit_from(df: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Train on at most ``sample`` rows of ``df`` that have a text and a label, of ``sample_bytes`` of text together."""
    rows = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("y"), F.xxhash64(text).alias("h"))
    # First hashes and sizes alone say which texts are in the sample, then only those are sent; copies count once.
    sizes = rows.groupBy("h").agg(F.max(F.octet_length("t")).alias("n"), F.count_distinct("y").alias("k")).orderBy("h").limit(sample).collect()
    last = last_within([(r["h"], r["n"] * r["k"]) for r in sizes], sample_bytes)
    if last is None:
        return None
    rows = sorted(rows.filter(F.col("h") <= last).dropDuplicates(["h", "y"]).collect(), key=lambda r: (r["h"], r["y"]))
    return train([r["t"] for r in rows], [r["y"] for r in rows])


def chunks(texts: list[str | None], size: int = CHUNK):
    """Slices of a list holding about ``size`` characters each."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def identify(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add lang_pred, score and rejected (replacing columns of those names); row-wise, whole texts, no shuffle."""
    out = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    rest = [c for c in df.columns if c not in out]
    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # at most 2^16 slots x languages

    def run(batches):
        own = pickle.loads(sent.value)
        for batch in batches:
            texts = batch.column(rest.index(text)).to_pylist()
            langs, scores, rejected = [], [], []
            for a, b in chunks(texts):
                x, y, z = predict(own, texts[a:b])
                langs += x
                scores.append(y)
                rejected.append(z)
            cols = [batch.column(i) for i in range(len(rest))]
            cols += [pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(np.concatenate(rejected) if rejected else [], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=rest + list(out))

    plain = df.select(*rest)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields] + [f"{k} {v}" for k, v in out.items()])
    return plain.mapInArrow(run, schema)


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_fold("doc_id", 3) == 1
    model = fit_from(docs.filter(~held_out))
    found = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
