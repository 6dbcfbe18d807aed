"""Substring deduplication by level-wise doubling.

A word is removed if a window of ``window`` consecutive words that covers it
also starts in a document with a smaller id. Windows are found level by level:

* The first level takes windows of half the length, rounded up, and of those
  just one in each full window (the one with the smallest hash): equal windows
  hold equal ones. Hashes that several documents share survive.
* The second level takes the windows of full length that hold a survivor. Those
  that also start in a smaller document are removed from the texts.
* From there each level doubles the length (26, 52, ... words for 13): what is
  repeated at one length alone is extended to twice that length, until no
  candidate survives. ``longest_repeat`` is the greatest of these lengths at which
  a document repeats a smaller one, 0 without any.

Beyond the second level only windows that begin a repeat are followed: where the
word before differs between two places, or one has none. Any repeated window lies
in a repeat of at least its length that begins so, in both documents. They are
few, and their hashes at all lengths come from the text by one running sum.

Hashes travel packed, by block of the hash space on the way out and by group of
documents on the way back, next to the texts, which are dealt out once. Of the
documents of one batch that share a hash only the smallest goes on to the
block, so a passage in a third of all documents burdens no task. A record is
sent for a block only if it has entries.

Words are unchanged runs of non-space characters. Null texts have no words; long
texts are taken whole. Rows with a null id are neither changed nor compared with
(``longest_repeat`` 0). Rows that share an id count as one document and get a row
each. Only the id and the text are read, so other columns may have any name; ids
must be castable to bigint. Exact up to collisions of 64-bit hashes; whether the
words before differ is told by 31 bits of their hashes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import buckets_for, input_bytes, materialise, materialise_counted, table
from quern.llm.wordhash import bucket_of, chunked, inside_texts, mix, run_hashes, running_sums, window_hashes, word_hashes

WINDOW = 13
FLUSH = 2_000_000
_U = np.uint64
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Longest window that is looked for is this many doublings of the first.
DOUBLINGS = 40
BROADCAST_ROWS = 500_000

#: hash/doc: entries for the block to compare; out_hash/out_doc: entries already decided.
#: before: 31 bits for the word before a window (0: several, or none), and whether several documents of src have it.
POSTED = "bucket int, src int, hash binary, doc binary, before binary, out_hash binary, out_doc binary"
GROUPED = "part int, hash binary, doc binary, begins binary"


def _joined(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _distinct(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, doc), sorted, and where each hash begins."""
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[new], docs[new]
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    return hashes, docs, first


def _decided(first: np.ndarray, later_only: bool) -> np.ndarray:
    """Entries whose hash another document has (``later_only``: one with a smaller id)."""
    if later_only:
        return ~first
    starts = np.flatnonzero(first)
    return np.repeat(np.diff(np.r_[starts, len(first)]) > 1, np.diff(np.r_[starts, len(first)]))


def _before_of(hashes: np.ndarray, docs: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each distinct hash, ascending: its common word before (0: several, or none), and one bit for several documents."""
    order = np.argsort(hashes, kind="stable")
    hashes, docs, before = hashes[order], docs[order], before[order].astype(np.uint32)
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, int)
    if not len(starts):
        return np.zeros(0, np.uint32)
    least, most = np.minimum.reduceat(before, starts), np.maximum.reduceat(before, starts)
    several = np.minimum.reduceat(docs, starts) < np.maximum.reduceat(docs, starts)
    return (np.where(least == most, least, 0) << 1).astype(np.uint32) | several.astype(np.uint32)


def post(hashes: np.ndarray, docs: np.ndarray, buckets: int, later_only: bool, src: int = 0, before: np.ndarray | None = None) -> pa.RecordBatch:
    """Pack entries by block; a hash's smallest document stands for all of this batch."""
    mark = None if before is None else _before_of(hashes, docs, before)
    hashes, docs, first = _distinct(hashes, docs)
    done = _decided(first, later_only)
    parts = []
    for h, d, b in ((hashes[first], docs[first], bucket_of(hashes[first], buckets)), (hashes[done], docs[done], bucket_of(mix(docs[done].view(np.uint64)), buckets))):
        order = np.lexsort((d, b))
        parts.append((h[order], d[order], np.searchsorted(b[order], np.arange(buckets + 1)), b, order))
    (h, d, e, b, order), (oh, od, oe, ob, _) = parts
    if mark is not None:
        mark = mark[order]
    rows = [
        (k, src, h[e[k] : e[k + 1]].tobytes(), d[e[k] : e[k + 1]].tobytes(), None if mark is None else mark[e[k] : e[k + 1]].tobytes(), oh[oe[k] : oe[k + 1]].tobytes(), od[oe[k] : oe[k + 1]].tobytes())
        for k in np.union1d(b, ob).tolist()
    ]
    return _table(POSTED, rows)


def _begins(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(part, hash) of the shared windows with different words before, for each part that has them."""
    hashes = _joined(group.column("hash"), np.uint64)
    mark = _joined(group.column("before"), np.uint32)
    if not len(mark):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sizes = [len(x) // 8 for x in group.column("hash").to_pylist()]
    src = np.repeat(group.column("src").to_numpy(), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, mark, src = hashes[order], mark[order], src[order]
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    word = mark >> np.uint32(1)
    least, most = np.minimum.reduceat(word, starts), np.maximum.reduceat(word, starts)
    n = np.diff(np.r_[starts, len(hashes)])
    shared = (n > 1) | (np.bitwise_or.reduceat(mark, starts) & np.uint32(1) == 1)
    yes = np.repeat(shared & ((least == 0) | (least != most)), n)
    return src[yes].astype(np.int64), hashes[yes]


def _compare(parts: int, later_only: bool):
    """One block: what is decided there and before, dealt to groups of documents."""

    def run(group: pa.Table) -> pa.Table:
        hashes, docs, first = _distinct(_joined(group.column("hash"), np.uint64), _joined(group.column("doc"), np.int64))
        done = _decided(first, later_only)
        hashes = np.concatenate([hashes[done], _joined(group.column("out_hash"), np.uint64)])
        docs = np.concatenate([docs[done], _joined(group.column("out_doc"), np.int64)])
        part = part_of(docs, parts)
        order = np.lexsort((docs, part))
        hashes, docs, part = hashes[order], docs[order], part[order]
        to, begins = _begins(group)
        by = np.argsort(to, kind="stable")
        to, begins = to[by], begins[by]
        at = np.union1d(part, to)
        edges = [np.searchsorted(x, at, side) for x in (part, to) for side in ("left", "right")]
        rows = [(int(p), hashes[a:b].tobytes(), docs[a:b].tobytes(), begins[c:d].tobytes()) for p, a, b, c, d in zip(at, *edges)]
        return pa.Table.from_batches([_table(GROUPED, rows)])

    return run


def part_of(docs: np.ndarray, parts: int) -> np.ndarray:
    """The group of documents of an id; ``_part`` says the same to Spark."""
    return docs.astype(np.int64) // 64 % parts


def _part(doc_id: str, parts: int):
    # Rows without an id are compared with nothing and may go anywhere.
    return F.pmod(F.coalesce(F.shiftright(F.col(doc_id), 6), F.xxhash64("text")), F.lit(parts)).cast("int")


def anchors(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each full window: its start, and the start and hash of its anchor,
    the half-length window with the smallest hash."""
    half = -(-window // 2)
    short = window_hashes(words, half)
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, where = short[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - half + 1):
        less = short[j : j + n] < best
        best[less] = short[j : j + n][less]
        where[less] = j
    start = np.flatnonzero(inside_texts(at, window, n))
    return start, start + where[start], best[start]


def _post_anchors(window: int, buckets: int):
    def run(batches):
        held, count = [], 0
        for batch in batches:
            ids = batch.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for i, data, offsets in chunked(batch.column(1)):
                words, at = word_hashes(data, offsets)
                start, anchor, hashes = anchors(words, at, window)
                new = np.ones(len(anchor), bool)
                new[1:] = anchor[1:] != anchor[:-1]
                row = np.searchsorted(at, start[new], "right") - 1 + i
                keep = ~null[row]
                held.append((hashes[new][keep], ids[row][keep]))
                count += len(held[-1][0])
            if count >= FLUSH:
                yield post(*map(np.concatenate, zip(*held)), buckets, False)
                held, count = [], 0
        if count:
            yield post(*map(np.concatenate, zip(*held)), buckets, False)

    return run


def _tagged(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """One value for an entry of a document."""
    return mix(hashes ^ mix(docs.view(np.uint64)))


def _survivors(right: pa.Table) -> np.ndarray:
    return np.unique(_tagged(_joined(right.column("hash"), np.uint64), _joined(right.column("doc"), np.int64)))


def _member(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(values), bool)
    at = np.searchsorted(found, values)
    at[at == len(found)] = 0
    return found[at] == values


def _texts(left: pa.Table):
    """(ids, null mask, first row and texts of each chunk) of the text side of a group."""
    ids = left.column("doc_id")
    null = ids.is_null().to_numpy()
    ids = ids.fill_null(0).to_numpy()
    chunks = left.column("text").chunks
    return ids, null, list(zip(np.cumsum([0] + [len(c) for c in chunks]).tolist(), chunks))


def _runs(texts):
    """(first row, bytes, offsets) of runs of the rows of a group."""
    for base, chunk in texts:
        for i, data, offsets in chunked(chunk):
            yield base + i, data, offsets


def _starts(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every window over text borders too, starts of those inside a text)"""
    full = window_hashes(words, window)
    return full, np.flatnonzero(inside_texts(at, window, len(full))) if len(full) else np.zeros(0, np.int64)


def _extend(window: int, buckets: int):
    """Windows whose anchor survived, compared in full."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = _survivors(right)
        held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32))]
        if len(found) and left.num_rows:
            ids, null, texts = _texts(left)
            for i, data, offsets in _runs(texts):
                words, at = word_hashes(data, offsets)
                start, _, hashes = anchors(words, at, window)
                row = np.searchsorted(at, start, "right") - 1
                keep = ~null[row + i] & _member(_tagged(hashes, ids[row + i]), found)
                full = window_hashes(words, window)
                start, row = start[keep], row[keep]
                word = (words[start - 1] >> _U(33)).astype(np.uint32) | np.uint32(1)
                held.append((full[start], ids[row + i], np.where(start > at[row], word, 0).astype(np.uint32)))
        hashes, docs, before = map(np.concatenate, zip(*held))
        return pa.Table.from_batches([post(hashes, docs, buckets, True, key[0].as_py(), before)])

    return run


CLEANED = "doc_id long, n_words long, n_removed long, kept string, lengths array<array<bigint>>"


def _longer(words: np.ndarray, start: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(which start, hash) of the windows of twice, four times, ... the length at ``start`` that end by ``end``."""
    sums, which, hashes = running_sums(words), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k in range(1, DOUBLINGS):
        own = np.flatnonzero(start + (window << k) <= end)
        if not len(own):
            break
        which.append(own)
        hashes.append(run_hashes(sums, start[own], window << k))
    which, hashes = np.concatenate(which), np.concatenate(hashes)
    order = np.argsort(which, kind="stable")
    return which[order], hashes[order]


def _remove(window: int, digest: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found, begins = _survivors(right), np.unique(_joined(right.column("begins"), np.uint64))
        ids, null, texts = _texts(left)
        counts, removed, kept = [], [], []
        n_longer, per_start, longer = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for i, data, offsets in _runs(texts):
            words, at = word_hashes(data, offsets)
            covered = np.zeros(len(words) + 1, np.int32)
            starts_of = np.zeros(len(offsets) - 1, np.int64)
            if len(found) or len(begins):
                full, start = _starts(words, at, window)
                row = np.searchsorted(at, start, "right") - 1
                here = ~null[row + i]
                hit = start[here & _member(_tagged(full[start], ids[row + i]), found)]
                np.add.at(covered, hit, 1)
                np.add.at(covered, hit + window, -1)
                begin = here & _member(full[start], begins) & (start + 2 * window <= at[row + 1])
                which, hashes = _longer(words, start[begin], at[row[begin] + 1], window)
                starts_of = np.bincount(row[begin], minlength=len(starts_of))
                per_start.append(np.bincount(which, minlength=int(begin.sum())))
                longer.append(hashes)
            n_longer.append(starts_of)
            gone = np.cumsum(covered[:-1]) > 0
            for j in range(len(offsets) - 1):
                text = data[offsets[j] : offsets[j + 1]].tobytes().decode("utf-8", "surrogatepass")
                lost = gone[at[j] : at[j + 1]]
                some = _WORD.findall(text)
                if lost.any():
                    some = [w for w, g in zip(some, lost.tolist()) if not g]
                out = " ".join(some)
                counts.append(len(lost))
                removed.append(len(lost) - len(some))
                kept.append(hashlib.sha256(out.encode("utf-8", "surrogatepass")).hexdigest() if digest else out)
        edges = lambda sizes: pa.array(np.cumsum(np.r_[0, np.concatenate(sizes)]), pa.int32())
        hashes = pa.array(np.concatenate(longer).view(np.int64))
        lengths = pa.ListArray.from_arrays(edges(n_longer), pa.ListArray.from_arrays(edges(per_start), hashes))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=null), "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string()), "lengths": lengths,
        })

    return run


def _dealt(df: DataFrame, doc_id: str, text: str, per_bucket: float) -> tuple[DataFrame, int]:
    parts = max(buckets_for(input_bytes(df), per_bucket), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs, parts


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, per_part: float = 8e6, per_block: float = 64e6, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, longest_repeat) for every row; with ``digest``
    kept_sha256, the SHA-256 of the kept words joined by a space, instead of the text."""
    docs, parts = _dealt(df, doc_id, text, per_part)
    blocks = max(buckets_for(input_bytes(df), per_block), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    halves = docs.mapInArrow(_post_anchors(window, blocks), POSTED).groupBy("bucket").applyInArrow(_compare(parts, False), GROUPED)
    texts = docs.withColumn("part", _part("doc_id", parts))
    posted = texts.groupBy("part").cogroup(halves.groupBy("part")).applyInArrow(_extend(window, blocks), POSTED)
    repeats = posted.groupBy("bucket").applyInArrow(_compare(parts, True), GROUPED)
    cleaned = materialise(texts.groupBy("part").cogroup(repeats.groupBy("part")).applyInArrow(_remove(window, digest), CLEANED))
    longest, n = materialise_counted(longest_repeats(cleaned, window))
    longest = longest.select(F.col("doc_id").alias("__of"), "longest_repeat")
    joined = cleaned.join(F.broadcast(longest) if n <= BROADCAST_ROWS else longest, F.col("doc_id") == F.col("__of"), "left")
    kept = F.col("kept").alias("kept_sha256" if digest else "kept")
    return joined.select("doc_id", "n_words", "n_removed", kept, F.coalesce("longest_repeat", F.lit(0).cast("bigint")).alias("longest_repeat"))


def longest_repeats(cleaned: DataFrame, window: int) -> DataFrame:
    """(doc_id, longest_repeat): level by level, the candidates that still are in two
    documents, until none survives; documents that repeat no smaller one are left out."""
    out = cleaned.filter("doc_id is not null and n_removed > 0").select("doc_id", F.lit(window).cast("bigint").alias("size"))
    # A document's equal beginnings count once, so that a row of copies is small.
    alive = cleaned.filter("doc_id is not null and size(lengths) > 0").select("doc_id", F.explode(F.array_distinct("lengths")).alias("h"))
    n, level = 1, 0
    while n:
        at = F.get("h", F.lit(level))
        groups = alive.filter(F.size("h") > level).groupBy(at.alias("hash")).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        groups, n_groups = materialise_counted(groups.filter("least < most").select("hash", "least"))
        if not n_groups:
            break
        if n_groups <= BROADCAST_ROWS:
            groups = F.broadcast(groups)
        alive, n = materialise_counted(alive.join(groups, at == F.col("hash")).select("doc_id", "h", "least"))
        level += 1
        out = out.union(alive.filter("least < doc_id").select("doc_id", F.lit(window << level).cast("bigint").alias("size")))
        alive = alive.select("doc_id", "h")
    return out.groupBy("doc_id").agg(F.max("size").alias("longest_repeat"))


def op9_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)
), firsts AS (
  SELECT g, min(doc_id) AS d FROM windows GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM windows JOIN firsts USING (g) WHERE firsts.d < windows.doc_id
), lost AS (
  SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id
), kept AS (
  SELECT words.doc_id, len(w) AS n, CASE WHEN ks IS NULL THEN w ELSE
    list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ks, x[2])), lambda x: x[1]) END AS k
  FROM words LEFT JOIN lost USING (doc_id)
), levels AS (
  SELECT doc_id, i, 13 AS size, md5(g) AS h FROM windows
  UNION ALL SELECT a.doc_id, a.i, 2 * a.size, md5(a.h || b.h) FROM levels a JOIN levels b ON a.doc_id = b.doc_id AND b.i = a.i + a.size
), longest AS (
  SELECT doc_id, CAST(max(size) AS BIGINT) AS longest_repeat FROM levels JOIN (SELECT size, h, min(doc_id) AS d FROM levels GROUP BY size, h) USING (size, h) WHERE d < doc_id GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(k) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256, coalesce(longest_repeat, 0) AS longest_repeat FROM kept LEFT JOIN longest USING (doc_id)
"""
