"""Bottom-k sketches of shingle hashes (built-in functions only).

A sketch is the ascending array of the ``k`` smallest distinct 64-bit hashes of
a text's word shingles. Sketches of parts merge into the sketch of the whole by
taking the ``k`` smallest of their union. They estimate

* resemblance  |A & B| / |A | B|,
* containment  |A & B| / |A|,
* the number of distinct shingles.

Null and empty texts have the empty sketch; two empty sketches resemble each
other fully (1.0), an empty and a non-empty one not at all (0.0). Texts shorter
than one shingle are one shingle as a whole. Column names are parameters, and
columns that are not named are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quern.llm.common import SPACE_CLASS, buckets_for, input_bytes, text_or_empty

SHINGLE_WORDS = 5
SKETCH_SIZE = 128
#: Bytes of input for each task that pairs a document with the next.
TASK_BYTES = 16e6
_SPAN = float(1 << 64)


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), SPACE_CLASS), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch_of_word_hashes(hashes: Column, words: int = SHINGLE_WORDS, k: int = SKETCH_SIZE) -> Column:
    """``hashes`` should be a materialised column: it is read several times."""
    whole = F.when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    inner = F.transform(
        F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - F.lit(words - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get(hashes, i + F.lit(j)) for j in range(1, words)]),
    )
    shingles = F.when(F.size(hashes) >= words, inner).otherwise(whole)
    return F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)


def with_sketch(df: DataFrame, text: str, out: str, words: int = SHINGLE_WORDS, k: int = SKETCH_SIZE) -> DataFrame:
    """Add the sketch of column ``text`` as ``out``; row-wise, no shuffle."""
    tmp = f"__hashes_{out}"
    return (
        df.withColumn(tmp, word_hashes(text_or_empty(text)))
        .withColumn(out, sketch_of_word_hashes(F.col(tmp), words, k))
        .drop(tmp)
    )


def _bottom(a: Column, b: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    union = _bottom(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def distinct_shingles(sketch: Column, k: int = SKETCH_SIZE) -> Column:
    """Exact below ``k``; beyond, (k - 1) over the k-th hash as a share of the hash space."""
    kth = (F.element_at(sketch, -1).cast("double") + F.lit(_SPAN / 2) + 1.0) / F.lit(_SPAN)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(k - 1.0) / kth)


def containment(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Share of a's shingles that b has, through resemblance and the size estimates."""
    j = resemblance(a, b, k)
    na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1.0 + j) * na)))


def sketch_text(sketch: Column) -> Column:
    """Fixed-width hex, order kept; the empty sketch is the empty string."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def merge_sketches(df: DataFrame, keys: list[str], sketch: str, k: int = SKETCH_SIZE, salts: int = 64) -> DataFrame:
    """One merged sketch per key. Hashes are deduplicated and cut to ``k`` per
    (key, salt) before they meet per key, so a key with most of the rows is
    spread over ``salts`` tasks and no task holds more than salts * k hashes of it."""
    flat = df.select(*keys, F.explode(sketch).alias("__h")).distinct()
    part = Window.partitionBy(*keys, F.pmod("__h", F.lit(salts))).orderBy("__h")
    whole = Window.partitionBy(*keys).orderBy("__h")
    flat = flat.withColumn("__r", F.row_number().over(part)).filter(F.col("__r") <= k)
    flat = flat.withColumn("__r", F.row_number().over(whole)).filter(F.col("__r") <= k)
    merged = flat.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(sketch))
    empty = df.select(*keys).distinct()
    on = [empty[c].eqNullSafe(merged[c]) for c in keys]
    joined = empty.join(merged, on, "left")
    return joined.select(*[empty[c] for c in keys], F.coalesce(merged[sketch], F.array().cast("array<bigint>")).alias(sketch))


def id_buckets(df: DataFrame, doc_id: str, rows: int = 512, most: int = 100_000, knots: int = 256):
    """An expression that cuts ids into ascending buckets of about ``rows`` rows.

    The ids' distribution is taken as piecewise linear between ``knots``
    quantiles (one scan of the id column), so gaps and clusters of ids do not
    unbalance the buckets. At most ``most`` buckets. Null ids go first.
    """
    stats = df.agg(
        F.count("*").alias("n"),
        F.percentile_approx(F.col(doc_id).cast("bigint"), [i / knots for i in range(knots + 1)], 10_000).alias("q"),
    ).first()
    edges = sorted(set(stats["q"] or []))
    ident = F.col(doc_id).cast("bigint")
    if len(edges) < 2:
        return F.lit(0).cast("bigint")
    fine = max(1, min(most, -(-stats["n"] // rows)) // (len(edges) - 1) + 1)
    los = F.array(*[F.lit(e).cast("bigint") for e in edges])
    seg = F.greatest(F.size(F.filter(los, lambda e: e <= ident)), F.lit(1))
    seg = F.least(seg, F.lit(len(edges) - 1))
    lo, hi = F.get(los, seg - 1), F.get(los, seg)
    within = F.floor((ident - lo).cast("double") / (hi - lo).cast("double") * F.lit(fine)).cast("bigint")
    within = F.greatest(F.lit(0), F.least(within, F.lit(fine - 1)))
    return F.coalesce((seg - 1).cast("bigint") * F.lit(fine) + within, F.lit(-1).cast("bigint"))


def with_next(df: DataFrame, doc_id: str, carry: list[str], rows: int = 512) -> tuple[DataFrame, WindowSpec]:
    """Rows dealt out so that ``lead`` over the returned window is the row that
    follows in ascending (id, carried columns); after the last, the first. Rows
    with ``__copy`` 1 are there to be led to only.

    Rows are dealt to buckets of consecutive ids; the first ids of each bucket
    are also sent to the bucket before it. So each row moves once and no task
    sorts the whole table.
    """
    bucket = id_buckets(df, doc_id, rows)
    heads = df.select(bucket.alias("__b"), F.col(doc_id).alias("__id")).groupBy("__b").agg(
        F.min("__id").alias("__head"), F.count_if(F.col("__id").isNull()).alias("__nulls")
    )
    # One row per bucket, bounded by id_buckets(most=...): one small sort, then a broadcast.
    order = Window.orderBy("__b")
    every = Window.partitionBy()
    heads = heads.select(
        F.when(F.col("__nulls") > 0, F.lit(None)).otherwise(F.col("__head")).alias("__head"),
        F.coalesce(F.lag("__b").over(order), F.max("__b").over(every)).alias("__before"),
    )
    dealt = df.withColumn("__b", bucket).join(F.broadcast(heads), df[doc_id].eqNullSafe(heads["__head"]), "left")
    own = F.struct(F.lit(0).alias("copy"), F.col("__b").alias("b"))
    dealt = dealt.withColumn(
        "__to",
        F.explode(F.when(F.col("__before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.lit(1).alias("copy"), F.col("__before").alias("b"))))),
    )
    dealt = dealt.withColumns({"__copy": F.col("__to.copy"), "__b": F.col("__to.b")}).drop("__to", "__head", "__before")
    tasks = max(buckets_for(input_bytes(df), TASK_BYTES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(tasks, F.col("__b"))
    return dealt, Window.partitionBy("__b").orderBy("__copy", doc_id, *carry)


def edited_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SKETCH_SIZE) -> DataFrame:
    """Fingerprint every text and its edited text, whose last floor(n/2) code
    points give way to the first as many of the next document (ascending id,
    ties by text; the last document's next is the first).

    One row per input row; ids may be null (they come first) or repeated.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    dealt, w = with_next(docs, "doc_id", ["text"])
    dealt = with_sketch(dealt, "text", "sketch", k=k)
    near = dealt.select(
        "*",
        F.lead("text").over(w).alias("next_text"),
        F.lead("sketch").over(w).alias("next_sketch"),
    ).filter(F.col("__copy") == 0)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    near = near.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        "sketch",
        "next_sketch",
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    near = with_sketch(near, "edited", "edited_sketch", k=k)
    return near


def op1_document_fingerprints(spark, sf_dir):
    from quern.llm.common import table

    fp = edited_fingerprints(table(spark, sf_dir, "documents"))
    return fp.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch_text(F.col("sketch")).alias("fingerprint"),
        sketch_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
        distinct_shingles(F.col("sketch")).alias("n_shingles_est"),
    )
