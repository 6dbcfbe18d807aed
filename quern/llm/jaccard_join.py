"""Exact n-gram Jaccard join as a blocked sparse matrix product.

The incidence matrix has a row for each class of documents with equal shingle
sets and a column for each shingle. Most rows are in no link, and they leave early:

1. Each row's columns are put in the order of their hashes, and only the first
   of them (``sampled``, about 3 in 8) are sent, 32 bits each, to blocks of the
   hash space. Two linked rows share at least ``least_shared`` columns there, so
   a row with fewer repeated ones leaves. Hashes that are equal by chance let a
   row stay, no more.
2. The texts of one document of each class that stays are read again and all
   their shingles go to blocks of columns. A block counts the rows of each column
   and keeps only columns with two rows or more, as others add to no product.
3. The kept entries are gathered by row. A row that has more columns of its own
   than a linked row may lack (a quarter of them) leaves. Otherwise its rarest
   columns up to that bound are its prefix: linked rows share a column of both
   prefixes. Rows that share prefix columns, directly or over others, form a cluster.
4. Each cluster is multiplied out row by row: the overlap counts of a row with
   the later rows are accumulated from the columns' row lists, and pairs below
   the size-derived bound are discarded. Rows already known to be connected are
   skipped. A large cluster is cut into blocks: all its rows are first multiplied
   with a few pilot rows; rows so connected to its largest component need not be
   multiplied with each other, only the rest with them and within.

No pairs are emitted, only a forest of links per task. The result is exact up
to collisions of 64-bit hashes. Empty texts, null texts and texts without words
have an empty set and link with nothing; shorter texts are one shingle as a
whole; long texts are taken whole. Repeated rows get a row each, with one class;
null ids take part in classes but are nobody's component id (a component of null
ids alone has null). Only the id and the text are read, so other columns may
have any name. Ids must be castable to bigint. ``df`` is scanned twice and must
give the same rows both times (a table, not a sample).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.llm.common import buckets_for, input_bytes, materialise, table
from quern.llm.components import components
from quern.llm.wordhash import bucket_of, chunked, inside_texts, mix, window_hashes, word_hashes

SHINGLE_WORDS = 5
PERCENT = 75
FLUSH = 2_000_000
#: Rows of a block of a large cluster: at least the first, a share of the cluster up to the second.
BLOCK_ROWS, MOST_BLOCK_ROWS, CLUSTER_BLOCKS = 64, 4096, 32
BLOCK_ENTRIES = 4_000_000
PILOTS = 16
BROADCAST_ROWS = 500_000
_U = np.uint64
_LOW = _U((1 << 32) - 1)

SAMPLED = "bucket int, src long, row binary, hash binary, member_id binary, member_key binary, member_size binary"
REPEATED = "src long, row binary, member_id binary, member_key binary, member_size binary"
PACKED = "bucket int, key binary, held binary, low binary, high binary, member_key binary, member_size binary"
ROWS = "part int, key binary, held binary, column binary, rows binary, member_key binary, member_size binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes text by text, offsets of the texts into them)."""
    words, at = word_hashes(data, offsets, lower=True)
    n_texts = len(at) - 1
    windows = window_hashes(words, k)
    ok = inside_texts(at, k, len(windows))
    owner = np.repeat(np.arange(n_texts), np.diff(at))
    hashes, owner = windows[ok], owner[: len(windows)][ok]
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < k))
    if len(short):
        whole = np.array([window_hashes(words[at[i] : at[i + 1]], int(at[i + 1] - at[i]), seed=1)[0] for i in short], np.uint64)
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(n_texts + 1))


def set_keys(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit key per set."""
    total = np.concatenate([[_U(0)], np.cumsum(mix(hashes))])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))


def _record(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _joined(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)


def _bounds(sorted_values: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(sorted_values, np.arange(n + 1))


def missing(size, percent: int):
    """The most columns of a row that a linked row may lack."""
    return size - -(-percent * size // 100)


def _common(size):
    return np.maximum(1, size // 8)


def sampled(size, percent: int):
    """How many of a row's columns, in the order of their hashes, are sent first.
    Of the columns that two linked rows share, the first ``n`` lie in the first
    ``missing + n`` of each row."""
    return np.minimum(size, missing(size, percent) + _common(size))


def least_shared(size, percent: int):
    """How many of them a linked row has too; it may be smaller, so that fewer of its own are sent."""
    return _common(-(-percent * size // 100))


def _planes(values: np.ndarray) -> bytes:
    """Small integers byte by byte, which the shuffle's compression shrinks."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _send_sample(buckets: int, k: int, percent: int):
    """Texts to the first columns of each set by block of the hash space; a flush's rows are numbered."""

    def run(batches):
        held: list[tuple] = []
        count, flushes = 0, 0
        base = TaskContext.get().partitionId() << 32

        def flush():
            hashes = np.concatenate([x[0] for x in held])
            row = np.concatenate([x[1] + n for x, n in zip(held, np.cumsum([0] + [len(x[2]) for x in held]))])
            keys, sizes = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
            ids = pa.chunked_array([x[4] for x in held])
            # Equal sets of this flush are sent once.
            _, first = np.unique(keys, return_index=True)
            once = np.zeros(len(keys), bool)
            once[first] = True
            hashes, row = hashes[once[row]], row[once[row]]
            bucket = bucket_of(hashes, buckets)
            order = np.argsort(bucket, kind="stable")  # keeps the rows ascending
            hashes, row, bucket = (hashes[order] & _LOW).astype("<u4"), row[order], bucket[order]
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
            src = base + flushes
            rows = [(int(bucket[a]), src, _planes(row[a:b]), hashes[a:b].tobytes(), None, None, None) for a, b in zip(edge[:-1], edge[1:])]
            null = ids.is_null().to_numpy()
            rows.append((src % buckets, src, None, None, ids.fill_null(0).to_numpy().tobytes(), keys.tobytes(), np.where(null, -1 - sizes, sizes).tobytes()))
            held.clear()
            return _record(SAMPLED, rows)

        for batch in batches:
            for i, data, offsets in chunked(batch.column(1)):
                hashes, at = shingle_sets(data, offsets, k)
                sizes = np.diff(at)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                first = np.arange(len(hashes)) - at[owner] < sampled(sizes, percent)[owner]
                held.append((hashes[first], owner[first], set_keys(hashes, at), sizes, batch.column(0).slice(i, len(offsets) - 1).cast(pa.int64())))
                count += int(first.sum()) + len(sizes)
                if count >= FLUSH:
                    yield flush()
                    count, flushes = 0, flushes + 1
        if held:
            yield flush()

    return run


def _find_repeated(group: pa.Table) -> pa.Table:
    """One block: the rows of each flush once for every repeated column, and the flushes' members as they are."""
    out, hashes, rows, srcs = [], [], [], []
    for src, row, found, *member in zip(*(group.column(c).to_pylist() for c in ("src", "row", "hash", "member_id", "member_key", "member_size"))):
        if found is None:
            out.append((src, None, *member))
        else:
            hashes.append(np.frombuffer(found, "<u4"))
            rows.append(_from_planes(row))
            srcs.append(src)
    if hashes:
        every = np.concatenate(hashes)
        every.sort()
        again = np.unique(every[1:][every[1:] == every[:-1]])
        for src, h, r in zip(srcs, hashes, rows):
            at = np.searchsorted(again, h)
            at[at == len(again)] = 0
            r = r[again[at] == h] if len(again) else r[:0]
            if len(r):
                out.append((src, _planes(r), None, None, None))
    return pa.Table.from_batches([_record(REPEATED, out)])


def _may_link(percent: int):
    """One flush: its rows, and whether they have enough repeated columns to be in a link."""

    def run(group: pa.Table) -> pa.Table:
        ids, keys, sizes = (_joined(group.column(c), t) for c, t in (("member_id", np.int64), ("member_key", np.uint64), ("member_size", np.int64)))
        null = sizes < 0
        sizes = np.where(null, -1 - sizes, sizes)
        hits = np.zeros(len(ids), np.int64)
        for row in group.column("row").to_pylist():
            if row:
                hits += np.bincount(_from_planes(row), minlength=len(ids))
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        may = (sizes > 0) & (hits[first[inverse]] >= least_shared(sizes, percent))
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=null), "key": pa.array(keys.view(np.int64)), "size": pa.array(sizes), "may": pa.array(may)})

    return run


def _block_start(bucket: int, buckets: int) -> int:
    """The smallest upper half of a hash that ``bucket_of`` puts into a block."""
    return -(-(bucket << 32) // buckets)


def _high_bytes(buckets: int) -> int:
    """Bytes for the upper half of a hash, counted from the block's start."""
    return 4 if buckets < 257 else 3


def _pack_columns(buckets: int, k: int):
    """Texts to packed shingles by block of columns; each set's (key, size) goes along with one block."""

    def run(batches):
        held: list[tuple] = []
        count = 0

        def flush():
            hashes = np.concatenate([x[0] for x in held])
            sizes = np.concatenate([x[1] for x in held])
            keys = np.concatenate([x[2] for x in held])
            member = bucket_of(mix(keys), buckets)
            # Equal sets of this flush are sent once.
            _, first = np.unique(keys, return_index=True)
            once = np.zeros(len(keys), bool)
            once[first] = True
            owner = np.repeat(np.arange(len(keys)), sizes)
            hashes, owner = hashes[once[owner]], owner[once[owner]]
            bucket = bucket_of(hashes, buckets)
            order = np.argsort(bucket, kind="stable")  # keeps the sets together
            hashes, owner = hashes[order], owner[order]
            edge = _bounds(bucket[order], buckets)
            by_member = np.argsort(member, kind="stable")
            member_edge = _bounds(member[by_member], buckets)
            rows = []
            for b in np.union1d(bucket, member).tolist():
                h, o = hashes[edge[b] : edge[b + 1]], owner[edge[b] : edge[b + 1]]
                m = by_member[member_edge[b] : member_edge[b + 1]]
                starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.zeros(0, int)
                runs = np.diff(np.r_[starts, len(o)]).astype(np.uint32)
                # With the block's number, all 64 bits.
                high = ((h >> _U(32)) - _U(_block_start(b, buckets))).astype("<u4").view(np.uint8).reshape(-1, 4)
                rows.append((
                    b, keys[o[starts]].tobytes(), runs.tobytes(),
                    (h & _LOW).astype(np.uint32).tobytes(), high[:, : _high_bytes(buckets)].tobytes(),
                    keys[m].tobytes(), sizes[m].tobytes(),
                ))
            held.clear()
            return _record(PACKED, rows)

        for batch in batches:
            for i, data, offsets in chunked(batch.column(1)):
                hashes, at = shingle_sets(data, offsets, k)
                held.append((hashes, np.diff(at), set_keys(hashes, at)))
                count += len(hashes) + len(offsets)
                if count >= FLUSH:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    return run


def _count_columns(parts: int):
    """One block of columns, of as many as ``parts``: keep those with two rows or more, with their row counts, dealt by row."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        keys, runs = _joined(group.column("key"), np.uint64), _joined(group.column("held"), np.uint32)
        hashes = _joined(group.column("low"), np.uint32).astype(np.uint64)
        high = np.zeros((len(hashes), 4), np.uint8)
        high[:, : _high_bytes(parts)] = _joined(group.column("high"), np.uint8).reshape(len(hashes), _high_bytes(parts))
        hashes |= high.view("<u4").ravel().astype(np.uint64) + _U(_block_start(bucket, parts)) << _U(32)
        row = np.repeat(keys, runs)
        order = np.lexsort((row, hashes))
        hashes, row = hashes[order], row[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        hashes, row = hashes[new], row[new]
        starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, int)
        counts = np.diff(np.r_[starts, len(hashes)])
        each = np.repeat(counts, counts)
        keep = each > 1
        column, row, each = mix(hashes[keep]), row[keep], each[keep].astype(np.uint32)
        part = bucket_of(row, parts)
        order = np.lexsort((row, part))
        column, row, each, part = column[order], row[order], each[order], part[order]
        edge = _bounds(part, parts)
        mkeys, msizes = (_joined(group.column(c), t) for c, t in (("member_key", np.uint64), ("member_size", np.int64)))
        mpart = bucket_of(mkeys, parts)
        by = np.argsort(mpart, kind="stable")
        medge = _bounds(mpart[by], parts)
        rows = []
        for p in np.union1d(part, mpart).tolist():
            a, b, m = edge[p], edge[p + 1], by[medge[p] : medge[p + 1]]
            own = row[a:b]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if b > a else np.zeros(0, int)
            runs = np.diff(np.r_[starts, b - a]).astype(np.uint32)
            rows.append((p, own[starts].tobytes(), runs.tobytes(), column[a:b].tobytes(), each[a:b].tobytes(), mkeys[m].tobytes(), msizes[m].tobytes()))
        return pa.Table.from_batches([_record(ROWS, rows)])

    return run


CLASSES = "key long, size long, prefix int, columns binary"


def _gather_rows(percent: int):
    """One part of the rows: for those that may link, their kept columns, rarest first."""

    def run(group: pa.Table) -> pa.Table:
        keys, runs = _joined(group.column("key"), np.uint64), _joined(group.column("held"), np.uint32)
        row, column, each = np.repeat(keys, runs), _joined(group.column("column"), np.uint64), _joined(group.column("rows"), np.uint32)
        order = np.lexsort((column, each, row))
        row, column = row[order], column[order]
        mkeys, msizes = (_joined(group.column(c), t) for c, t in (("member_key", np.uint64), ("member_size", np.int64)))
        by = np.argsort(mkeys, kind="stable")
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
        ends = np.r_[starts[1:], len(row)] if len(row) else starts
        own = row[starts]
        size = msizes[by[np.searchsorted(mkeys[by], own)]]
        # A linked row shares at least percent of this one; the rest plus one is where it must share first.
        prefix = missing(size, percent) + 1 - (size - (ends - starts))
        may = np.flatnonzero(prefix > 0)
        return pa.table({
            "key": pa.array(own[may].view(np.int64)), "size": pa.array(size[may]),
            "prefix": pa.array(prefix[may].astype(np.int32)), "columns": pa.array([column[starts[i] : ends[i]].tobytes() for i in may], pa.binary()),
        })

    return run


def _prefix_columns(batches):
    """(column, key) of the prefixes, with the classes' packed columns left out."""
    for batch in batches:
        keys, prefix, columns = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        parts = [np.frombuffer(c, np.int64)[:p] for c, p in zip(columns, prefix)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)), pa.array(np.repeat(keys, [len(p) for p in parts]))], names=["column", "key"])


def multiply(keys: np.ndarray, sizes: np.ndarray, sides: np.ndarray, roots: np.ndarray, columns: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of a block of rows, as a forest: overlap counts row by row from the
    columns' row lists; ``sides`` 0 and 1 are multiplied with each other only, 2 within.
    Rows of equal ``roots`` are connected already."""
    n = len(keys)
    order = np.lexsort((keys, sizes))
    keys, sizes, sides, roots = keys[order], sizes[order], sides[order], roots[order]
    columns = [columns[i] for i in order]
    lengths = np.array([len(c) for c in columns])
    column, entry = np.unique(np.concatenate(columns), return_inverse=True)
    owner = np.repeat(np.arange(n), lengths)
    by = np.lexsort((owner, entry))
    lists, edge = owner[by], _bounds(entry[by], len(column))
    at = np.concatenate([[0], np.cumsum(lengths)])
    root = np.unique(roots, return_inverse=True)[1]
    links = []
    for i in range(n):
        # Rows are by size: linked later rows have at most size * 100 / percent shingles.
        last = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        rest = np.flatnonzero((root[i + 1 : last] != root[i]) & ((sides[i + 1 : last] != sides[i]) | (sides[i] == 2))) + i + 1
        if not len(rest):
            continue
        if len(rest) <= 4:
            mine = np.sort(columns[i])
            overlap = np.array([np.isin(columns[j], mine, assume_unique=True).sum() for j in rest])
        else:
            own = entry[at[i] : at[i + 1]]
            counts = np.bincount(np.concatenate([lists[edge[c] : edge[c + 1]] for c in own]), minlength=n) if len(own) else np.zeros(n, int)
            overlap = counts[rest]
        for j in rest[100 * overlap >= percent * (sizes[i] + sizes[rest] - overlap)]:
            if root[j] != root[i]:
                links.append((int(keys[i]), int(keys[j])))
                root[root == root[j]] = root[i]
    return links


def _multiply_clusters(percent: int):
    def run(group: pa.Table) -> pa.Table:
        columns = [np.frombuffer(c, np.int64) for c in group.column("columns").to_pylist()]
        links = multiply(*(group.column(c).to_numpy() for c in ("key", "size", "side", "root")), columns, percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def cluster_links(classes: DataFrame, percent: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) among ``classes`` (key, size, prefix, columns) that connect what is linked."""
    shared = classes.select("key", "prefix", "columns").mapInArrow(_prefix_columns, "column long, key long")
    # The smallest key of each column's rows stands for them: a star, not pairs.
    hubs = shared.groupBy("column").agg(F.min("key").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    stars = shared.join(hubs, "column").select(F.col("hub").alias("a"), F.col("key").alias("b")).filter("a <> b").distinct()
    clusters = components(stars).select(F.col("node").alias("key"), "label")
    rows = clusters.join(classes.select("key", "size", "columns"), "key")
    entries = (F.octet_length("columns") / 8).cast("long")
    sizes = materialise(rows.groupBy("label").agg(F.count("*").alias("n"), F.avg(entries).alias("mean")))
    # Few blocks for a cluster of any size, until the rows of two no longer fit a task.
    share = F.greatest(F.lit(block_rows), F.ceil(F.col("n") / F.lit(CLUSTER_BLOCKS)))
    sizes = sizes.select("label", "n", F.least(share, F.lit(max(block_rows, MOST_BLOCK_ROWS)), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_ENTRIES) / F.col("mean")))).cast("int").alias("each"))
    small = rows.join(sizes.filter("n <= each").select("label"), "label", "left_semi")
    within = small.select("label", F.lit(0).alias("i"), F.lit(0).alias("j"), "key", "size", F.lit(2).cast("long").alias("side"), F.col("key").alias("root"), "columns")
    links = within.groupBy("label", "i", "j").applyInArrow(_multiply_clusters(percent), LINKS)
    large = sizes.filter("n > each")
    if large.isEmpty():
        return links
    large = materialise(rows.join(large, "label"))
    piloted = materialise(_pilot_links(large, percent))
    return links.union(piloted).union(_rest_links(large, components(piloted), percent))


LINKS = "a long, b long"


def _block(n: Column) -> Column:
    """The block of a row, of as many as hold ``n`` rows in its cluster."""
    return F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), F.ceil(n / F.col("each")))).cast("int")


def _pilot_links(large: DataFrame, percent: int) -> DataFrame:
    """Links of the rows of large clusters with a few rows of their cluster, block by block."""
    pilot = Window.partitionBy("label").orderBy(F.xxhash64("key", F.lit(1)), "key")
    pilots = large.withColumn("r", F.row_number().over(pilot)).filter(F.col("r") <= PILOTS)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("each"))).cast("int")
    sent = pilots.withColumn("i", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("side", F.lit(0).cast("long"))
    own = large.withColumn("i", _block(F.col("n"))).withColumn("side", F.lit(1).cast("long"))
    columns = ["label", "i", "key", "size", "side", F.col("key").alias("root"), "columns"]
    return sent.select(*columns).union(own.select(*columns)).groupBy("label", "i").applyInArrow(_multiply_clusters(percent), LINKS)


def _rest_links(large: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links of the rows of large clusters outside their largest component, with all others."""
    rows = large.join(found.select(F.col("node").alias("key"), F.col("label").alias("c")), "key", "left").withColumn("root", F.coalesce("c", "key"))
    counts = materialise(rows.groupBy("label", "root").agg(F.count("*").alias("m")))
    main = counts.groupBy("label").agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("all"))
    main = main.select("label", F.col("top.root").alias("main"), F.col("top.m").alias("m"), (F.col("all") - F.col("top.m")).alias("rest")).filter("rest > 0")
    rows = rows.join(main, "label").withColumn("inside", F.col("root") == F.col("main"))
    rows = rows.withColumn("own", F.when(F.col("inside"), _block(F.col("m"))).otherwise(_block(F.col("rest"))))
    blocks = lambda c: F.sequence(F.lit(0), F.ceil(F.col(c) / F.col("each")).cast("int") - 1)
    at = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.cast("long").alias("side"))
    # Blocks of the rest are numbered from 0, those of the largest component from -1 down.
    down = lambda m: -1 - m
    to_rest = F.transform(blocks("rest"), lambda r: at(r, down(F.col("own")), F.lit(1)))
    to_main = F.transform(blocks("m"), lambda m: at(F.col("own"), down(m), F.lit(0)))
    among = F.transform(blocks("rest"), lambda r: at(F.least("own", r), F.greatest("own", r), F.when(F.col("own") == r, 2).when(F.col("own") < r, 0).otherwise(1)))
    dealt = rows.withColumn("p", F.explode(F.when(F.col("inside"), to_rest).otherwise(F.concat(to_main, among))))
    dealt = dealt.select("label", "p.i", "p.j", "key", "size", "p.side", "root", "columns")
    return dealt.groupBy("label", "i", "j").applyInArrow(_multiply_clusters(percent), LINKS)


def candidate_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) with one document of every class that may link."""
    least = materialise(members.filter("may").groupBy("key").agg(F.min("doc_id").alias("doc_id")))
    ids = least.filter("doc_id is not null").select("doc_id").distinct()
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    out = docs.join(ids, "doc_id", "left_semi")
    # A class of null ids alone has no id to be found by.
    return out if least.filter("doc_id is null").isEmpty() else out.union(docs.filter("doc_id is null"))


def jaccard_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS, percent: int = PERCENT, per_bucket: float = 32e6, bucket_entries: int = 1_500_000, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, size) for every row, and (key, label, component_id) for every
    class that is not empty: one key of its component, null where it is alone, and the smallest id there."""
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(buckets_for(input_bytes(df), per_bucket), tasks)
    sample = docs.mapInArrow(_send_sample(blocks, k, percent), SAMPLED)
    repeated = sample.groupBy("bucket").applyInArrow(_find_repeated, REPEATED)
    members = materialise(repeated.groupBy("src").applyInArrow(_may_link(percent), "doc_id long, key long, size long, may boolean"))
    total = members.filter("may").agg(F.sum("size")).first()[0] or 0
    buckets = max(buckets_for(total, bucket_entries), tasks)
    packed = candidate_texts(docs, members).mapInArrow(_pack_columns(buckets, k), PACKED)
    kept = packed.groupBy("bucket").applyInArrow(_count_columns(buckets), ROWS)
    classes = materialise(kept.groupBy("part").applyInArrow(_gather_rows(percent), CLASSES))
    links = materialise(cluster_links(classes, percent, block_rows))
    groups = components(links)
    # Sets of size 0 link with nothing: each such row is alone. Sums are made before
    # joins and written, so that a join's only hot side is one Spark can split.
    members = members.select("doc_id", "key", "size")
    firsts = materialise(members.filter("size > 0").groupBy("key").agg(F.min("doc_id").alias("first")))
    linked = groups.select(F.col("node").alias("key"), "label")
    least = materialise(linked.join(firsts, "key").groupBy("label").agg(F.min("first").alias("least")))
    linked = linked.join(least, "label").select("key", "label", "least")
    return members, materialise(firsts.join(linked, "key", "left").select("key", "label", F.coalesce("least", "first").alias("component_id")))


def jaccard_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; ``component_id`` is the
    smallest id reachable over links of Jaccard similarity >= percent / 100.
    ``options`` are those of ``jaccard_classes``."""
    members, found = jaccard_classes(df, doc_id, text, **options)
    found = found.select("key", "component_id")
    full = members.filter("size > 0").join(found, "key", "left").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return full.union(members.filter("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id")))


def with_class_keys(df: DataFrame, name: str, text: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """Add the key of each row's class as ``name``; null for rows without words."""
    text_at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            parts = [np.zeros(0, np.int64)]
            empty = [np.zeros(0, bool)]
            for _, data, offsets in chunked(batch.column(text_at)):
                hashes, at = shingle_sets(data, offsets, k)
                parts.append(set_keys(hashes, at).view(np.int64))
                empty.append(np.diff(at) == 0)
            keys = pa.array(np.concatenate(parts), pa.int64(), mask=np.concatenate(empty))
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, LongType())]))


def op6_ngram_jaccard_join(spark, sf_dir):
    return jaccard_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS o
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM pairs WHERE 100 * o >= 75 * (nx + ny - o)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT x AS doc_id, x AS seen FROM edges
  UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.seen = e.x
), least AS (
  SELECT doc_id, min(seen) AS c FROM reach GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.c, s.doc_id) AS component_id
FROM sets s LEFT JOIN least l ON s.doc_id = l.doc_id
"""
