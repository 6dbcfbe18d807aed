"""Readers of the pipeline's file formats; every schema is explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quern.functions import lists as L
from quern.functions import text as T

CONTEXT = "id string, name string, link string, passage string, _corrupt string"
QUERIES = "map<string, struct<question:string, answer:array<string>>>"
SUBMISSION = "map<string, struct<answer:array<string>>>"
QUERY_KEYS = ("query_id", "qid", "id", "question_id")
# The columns that may hold a ranking, in the order they are tried; then those of this library's own files.
DOC_KEYS = ("fused_doc_ids", "doc_ids", "document_ids", "ranked_doc_ids", "reranked_doc_ids", "top_doc_ids", "top_docs", "answer", "answers", "predictions", "docs", "candidates", "reranked_top_docs", "top20_rerank")
ID_KEYS = ("doc_id", "candidate_id", "id")


def read_json(spark: SparkSession, path: str, schema: str | ST.StructType) -> DataFrame:
    """Whole-file JSON."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | ST.StructType) -> DataFrame:
    """Line JSON; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_map(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object keyed by id, as rows (query_id, value); ids never become columns."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", schema)).alias("query_id", "value"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, question, answer) of a keyed object."""
    return read_map(spark, path, QUERIES).select("query_id", "value.question", "value.answer")


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rank) of a submission file."""
    rows = read_map(spark, path, SUBMISSION)
    return rows.select("query_id", F.posexplode("value.answer").alias("pos", "doc_id")).select("query_id", "doc_id", (F.col("pos") + 1).alias("rank"))


def read_contexts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(contexts, issues) of a folder of one-document JSON files. Ids fall back to
    the file name's digits, names to link, passage and file name; an empty passage
    becomes name and link. Unreadable files and repeated ids are issues."""
    texts = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("source_path"))
    parsed = F.from_json("value", CONTEXT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    raw = texts.select(parsed.alias("x"), "source_path").select("x.*", "source_path")
    digits = F.regexp_extract("source_path", r"(\d+)\D*$", 1)
    doc_id = F.coalesce(F.when(F.trim("id") != "", F.trim("id")), digits)
    good = raw.filter("_corrupt is null").withColumns({"doc_id": doc_id, "link": F.coalesce("link", F.lit("")), "passage": F.coalesce("passage", F.lit(""))})
    named = F.trim(F.coalesce("name", F.lit("")))
    from_link, from_text = T.name_from_link(F.col("link")), T.name_from_passage(F.col("passage"))
    name = F.when(named != "", named).when(from_link != "", from_link).when(from_text != "", from_text).otherwise(F.concat(F.lit("context_"), F.col("doc_id")))
    source = F.when(named != "", "name").when(from_link != "", "link").when(from_text != "", "passage").otherwise("id")
    empty = F.trim("passage") == ""
    good = good.select("doc_id", "source_path", "link", source.alias("name_source"), empty.alias("is_empty_passage_fallback"), "passage", name.alias("name"))
    good = good.withColumn("passage", F.when(F.col("is_empty_passage_fallback"), F.concat_ws("\n", "name", "link")).otherwise(F.col("passage")))
    bad = raw.filter("_corrupt is not null").select(F.lit("error").alias("severity"), F.lit("bad_json").alias("kind"), F.col("source_path").alias("item_id"), F.lit("file is not a JSON object").alias("message"))
    twice = good.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    twice = twice.select(F.lit("error").alias("severity"), F.lit("duplicate_id").alias("kind"), F.col("doc_id").alias("item_id"), F.concat(F.col("n").cast("string"), F.lit(" files")).alias("message"))
    return good, bad.unionByName(twice)


def read_query_ids(spark: SparkSession, path: str) -> DataFrame:
    """(query_id) of an object keyed by id, of a list of objects with id, qid or index, or of such a list under ``questions``."""
    whole = spark.read.option("wholetext", True).text(path)
    item = "array<struct<id:string,qid:string,index:string>>"
    listed = F.coalesce(
        F.when(F.trim("value").startswith("["), F.from_json("value", item)), F.from_json("value", f"questions {item}")["questions"]
    )
    ids = F.coalesce(F.transform(listed, lambda x: F.coalesce(x["id"], x["qid"], x["index"])), F.map_keys(F.from_json("value", "map<string,string>")))
    return whole.select(F.explode(ids).alias("query_id"))


def checked_split(queries: DataFrame) -> DataFrame:
    """(query_id, gold) with distinct ids in order; fails where a query has none."""
    gold = L.ordered_distinct(F.coalesce(*[F.col(c) for c in ("answer", "gold") if c in queries.columns], F.array().cast("array<string>")))
    lost = F.raise_error(F.concat(F.lit("no relevant document for query "), F.col("query_id"))).cast("array<string>")
    return queries.select("query_id", F.when(F.size(gold) > 0, gold).otherwise(lost).alias("gold"))


def doc_index(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_idxs, metadata): a document's chunks in order and its first chunk's metadata."""
    return chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list("chunk_idx")).alias("chunk_idxs"), F.min_by("metadata", "chunk_idx").alias("metadata"))


def first_present(df: DataFrame, keys: tuple[str, ...]) -> Column | None:
    """The first non-null of the columns of ``keys`` that ``df`` has."""
    found = [F.col(k) for k in keys if k in df.columns]
    return F.coalesce(*found) if found else None


def _id_of(element: Column) -> Column:
    """The id that a JSON text stands for: of an object its first id key, else the value itself."""
    held = F.coalesce(*[F.get_json_object(element, f"$.{k}") for k in ID_KEYS])
    return F.trim(F.when(element.startswith("{"), held).otherwise(element))


def _plain_ids(text: Column) -> Column:
    """Ids of a text without JSON: separated by a semicolon or comma."""
    return F.transform(F.split(text, "[;,]"), lambda x: F.trim(x))


def _text_ids(text: Column, depth: int = 3) -> Column:
    """Ids of a text: a JSON list of values or objects, a JSON object with ``answer`` (of any of
    these shapes, ``depth`` deep), one JSON value, or ids separated by a semicolon or comma."""
    text = F.trim(text)
    values = F.from_json(F.when(text.startswith("["), text), "array<string>")
    quoted = F.when(text.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v"))
    if depth:
        answer = _text_ids(F.get_json_object(text, "$.answer"), depth - 1)
        inner = _text_ids(quoted, depth - 1)
    else:
        answer, inner = _plain_ids(F.get_json_object(text, "$.answer")), _plain_ids(quoted)
    return (
        F.when(values.isNotNull(), F.transform(values, _id_of))
        .when(text.startswith("{"), F.when(F.get_json_object(text, "$.answer").isNotNull(), answer).otherwise(F.array(_id_of(text))))
        .when(quoted.isNotNull(), inner)
        .when(text != "", _plain_ids(text))
    )


def as_ids(df: DataFrame, name: str) -> Column:
    """A column of any of the shapes rankings come in, as an ordered distinct list of ids:
    a list of ids or of objects with an id, an object with ``answer`` in it, one value, or
    text (see ``_text_ids``)."""
    kind, col = df.schema[name].dataType, F.col(name)
    while isinstance(kind, ST.StructType) and "answer" in kind.names:
        col, kind = col["answer"], kind["answer"].dataType
    if isinstance(kind, ST.StructType):
        key = next(k for k in ID_KEYS if k in kind.names)
        return L.ordered_distinct(F.array(col[key]))
    if isinstance(kind, ST.ArrayType):
        if isinstance(kind.elementType, ST.StructType):
            key = next(k for k in ID_KEYS if k in kind.elementType.names)
            return L.ordered_distinct(F.transform(col, lambda x: x[key]))
        return L.ordered_distinct(col)
    return L.ordered_distinct(_text_ids(col.cast("string")))


def rankings(df: DataFrame, query_keys: tuple[str, ...] = QUERY_KEYS, doc_keys: tuple[str, ...] = DOC_KEYS) -> DataFrame:
    """(query_id, doc_id, rank) from any ranking file, by the first of the known columns that holds a value."""
    query = first_present(df, query_keys)
    lists = [as_ids(df, k) for k in doc_keys if k in df.columns]
    if query is None or not lists:
        raise ValueError(f"no query or document column among {df.columns}")
    rows = df.select(query.cast("string").alias("query_id"), F.posexplode(F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])).alias("pos", "doc_id"))
    return rows.select("query_id", "doc_id", (F.col("pos") + 1).alias("rank"))


def only_queries(df: DataFrame, queries: DataFrame) -> DataFrame:
    return df.join(queries.select("query_id"), "query_id", "left_semi")


def read_ranking_csv(spark: SparkSession, path: str, both: bool = False, submission: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, rank) of a CSV with a byte order mark and lists in JSON cells: the
    documents of ``top20_rerank``, or without any those of ``answer``; with ``both`` those
    of ``answer`` that it lacks come after; with ``submission`` (query_id, doc_id, rank)
    then its unseen documents, for its queries too."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    query = first_present(df, QUERY_KEYS).cast("string").alias("query_id")
    none = F.array().cast("array<string>")
    lists = [F.coalesce(as_ids(df, k), none) for k in ("top20_rerank", "answer") if k in df.columns]
    ids = F.array_distinct(F.concat(*lists)) if both else F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    rows = df.select(query, F.posexplode(ids).alias("pos", "doc_id"))
    found = rows.select("query_id", "doc_id", (F.col("pos") + 1).alias("rank"))
    return found if submission is None else fill_rankings(found, submission)


def fill_rankings(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Every query's ranking, then the documents of ``other``'s that it lacks, in their order."""
    both = rows.select("query_id", "doc_id", F.struct(F.lit(0).alias("o"), F.col("rank").alias("r")).alias("at")).union(
        other.select(F.col("query_id").cast("string"), F.col("doc_id").cast("string"), F.struct(F.lit(1), F.col("rank")))
    )
    first = both.groupBy("query_id", "doc_id").agg(F.min("at").alias("at"))
    return first.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "doc_id")).alias("rank"))


def eval_payload(df: DataFrame) -> DataFrame:
    """(query_id, question, answer) recovered from a ranking file that carries questions and
    relevant ids (``answer`` or ``gold``); rows without a relevant id are left out."""
    query = first_present(df, QUERY_KEYS)
    gold = [as_ids(df, k) for k in ("gold_doc_ids", "gold", "answer") if k in df.columns]
    if query is None or not gold:
        raise ValueError(f"no query or relevant ids among {df.columns}")
    question = first_present(df, ("question", "query"))
    rows = df.select(query.cast("string").alias("query_id"), (question if question is not None else F.lit(None).cast("string")).alias("question"), F.coalesce(*gold).alias("answer"))
    return rows.filter(F.size("answer") > 0)


def scored_candidates(df: DataFrame, query: tuple[str, ...] = ("qid", "query_id"), doc: tuple[str, ...] = ("candidate_id", "doc_id"), score: str = "score") -> DataFrame:
    """(query_id, doc_id, score, rank) of a scored table: columns found by exact, then by
    partial name, any case; the best row per document; fails on scores that are no numbers."""

    def column(names: tuple[str, ...]) -> str:
        low = {c.lower(): c for c in df.columns}
        for n in names:
            if n.lower() in low:
                return low[n.lower()]
        for n in names:
            for k, c in low.items():
                if n.lower() in k:
                    return c
        raise ValueError(f"none of {names} among {df.columns}")

    q, d, s = column(query), column(doc), column((score,))
    value = F.expr(f"try_cast(`{s}` as double)")
    checked = F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit(f"{s} is not a number")).cast("double")).otherwise(value)
    rows = df.select(F.col(q).cast("string").alias("query_id"), F.col(d).cast("string").alias("doc_id"), checked.alias("score"))
    best = rows.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return best.withColumn("rank", F.row_number().over(w))


def reranker_scores(df: DataFrame) -> DataFrame:
    """(query_id, doc_id, reranker_score) of rows with reranked_top_docs."""
    return df.select("query_id", F.explode("reranked_top_docs").alias("d")).select("query_id", "d.doc_id", "d.reranker_score")


def gold_of(queries: DataFrame) -> DataFrame:
    """(query_id, doc_id), distinct."""
    return queries.select("query_id", F.explode(L.ordered_distinct(F.col("answer"))).alias("doc_id"))


def read_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet parts as one frame; columns that a part lacks are null."""
    return spark.read.option("mergeSchema", True).parquet(*paths)
