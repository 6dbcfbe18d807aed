"""Cleaning, metadata, structural sections and windows of documents.

All of it is row-wise, so nothing is shuffled: a document's lines are an array,
sections are slices of it between boundary lines, and the heading stack is a
fold over the headings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed_values as V
from quern.functions import text as T

_ANY = "(?iuU)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. A column that a lambda refers to
    may be inlined there by the optimizer and computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mended(text: Column, pattern: str, to: str, where: Column | None = None) -> Column:
    """``regexp_replace`` where the pattern is found. Most texts have nothing to mend, and
    a search is cheaper than a copy. ``text`` is referred to several times: see ``let``."""
    return F.when(text.rlike(pattern) if where is None else where, F.regexp_replace(text, pattern, to)).otherwise(text)


def strip(text: Column) -> Column:
    """Without blanks at both ends, which the first and the last character tell."""
    ends = F.substring(text, 1, 1).rlike(r"(?U)\s") | F.substring(text, -1, 1).rlike(r"(?U)\s")
    return mended(text, r"(?U)^\s+|\s+$", "", ends)


def clean_text(df: DataFrame, text: str, out: str = "clean_text", stats: str | None = "cleaning") -> DataFrame:
    """Drop header and divider lines and a late footer, mend hyphens and broken
    lines, collapse blanks. ``stats`` adds a struct of the six counters."""
    header = _ANY + "|".join(f"(?:{p})" for p in V.HEADER_LINES)
    kind = lambda x: F.when(F.trim(x) == "", 0).when(F.trim(x).rlike(header), 1).when(F.trim(x).rlike("(?U)" + V.DIVIDER_LINE), 2).otherwise(0)
    plain = let(T.newlines(F.col(text)), lambda x: F.when(x.rlike("[﻿​]"), F.translate(x, "﻿​", "")).otherwise(x))
    lines = F.transform(F.split(plain, "\n"), lambda x: F.struct(mended(x, r"(?U)\s+$", "").alias("line"), kind(x).alias("kind")))
    df = df.withColumn("__lines", lines)
    kept = F.array_join(F.transform(F.filter("__lines", lambda x: x["kind"] == 0), lambda x: x["line"]), "\n")
    df = df.withColumn("__kept", kept)
    footer = F.length(F.regexp_extract("__kept", f"(?s)^(.*?)(?={_ANY}{V.FOOTER})", 1))
    found = F.col("__kept").rlike(_ANY + V.FOOTER)
    cut = F.when(found & (footer > F.length("__kept") * V.FOOTER_SHARE), footer).otherwise(F.length("__kept"))
    df = df.withColumn("__cut", cut)
    body = F.substring(F.col("__kept"), F.lit(1), F.col("__cut"))
    hyphens = f"([{V.LETTERS}])- *\n+ *([{V.LETTERS}])"
    body = let(body, lambda b: mended(b, hyphens, "$1$2", b.rlike("- *\n")))
    steps = (
        (f"(?<![.!?:;])\n[ \t]*(?=[{V.LOWER_LETTERS}])", " "),
        ("\n{3,}", "\n\n"),
        ("[ \t]{2,}", " "),
        (" +\n *|\n +", "\n"),
    )
    for pattern, to in steps:
        body = let(body, lambda b: mended(b, pattern, to))
    df = df.withColumn(out, let(body, strip))
    if stats:
        count = lambda k: F.size(F.filter("__lines", lambda x: x["kind"] == k))
        df = df.withColumn(
            stats,
            F.struct(
                F.length(text).alias("original_chars"),
                F.length(out).alias("clean_chars"),
                F.greatest(F.length(text) - F.length(out), F.lit(0)).alias("removed_chars"),
                count(1).alias("removed_header_lines"),
                count(2).alias("removed_divider_lines"),
                (F.length("__kept") - F.col("__cut")).alias("footer_removed_chars"),
            ),
        )
    return df.drop("__lines", "__kept", "__cut")


def metadata(name: Column, link: Column, text: Column, fallback: Column | None = None, compat: bool = False) -> Column:
    """Struct of document type, issue number, years and signals. ``compat`` tests
    types and signals on text whose barred d stays, as older indexes did."""
    hay = F.concat_ws("\n", F.coalesce(name, F.lit("")), F.coalesce(link, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, V.METADATA_CHARS))
    form = T.match_form(hay, map_d=not compat)
    kind = F.lit("unknown")
    for label, pattern in reversed(V.DOC_TYPES_COMPAT if compat else V.DOC_TYPES):
        kind = F.when(form.rlike("(?U)" + pattern), label).otherwise(kind)
    any_of = lambda words: F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda w: F.contains(form, w)), True)
    return F.struct(
        kind.alias("doc_type"),
        F.trim(F.regexp_extract(hay, f"(?iuU)({V.ISSUE_NUMBER})", 1)).alias("issue_number"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(hay, F.lit("(?U)" + V.YEAR), F.lit(1)))).alias("years"),
        any_of(V.AMENDMENT_SIGNALS).alias("has_amendment_signal"),
        any_of(V.REPEAL_SIGNALS).alias("has_repeal_signal"),
        (fallback if fallback is not None else F.lit(False)).alias("is_empty_passage_fallback"),
    )


def question_signals(question: Column) -> Column:
    """Struct of the years, document types and numbers a question names."""
    low = F.lower(question)
    types = [F.when(F.lit(False) | _any([F.contains(low, F.lit(p)) for p in patterns]), F.lit(label)) for label, patterns in V.QUESTION_TYPES.items()]
    return F.struct(
        F.array_distinct(F.regexp_extract_all(low, F.lit("(?U)" + V.YEAR), F.lit(1))).alias("years"),
        F.array_compact(F.array(*types)).alias("doc_types"),
        F.array_distinct(F.regexp_extract_all(question, F.lit("(?U)(" + V.QUESTION_NUMBER + ")"), F.lit(1))).alias("numbers"),
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def metadata_score(signals: Column, meta: Column, heading: Column) -> Column:
    """Two for each year in common, two for the type, one for each number found."""
    hay = F.lower(F.concat_ws(" ", meta["issue_number"], heading))
    years = F.size(F.array_intersect(signals["years"], meta["years"]))
    kind = F.array_contains(signals["doc_types"], meta["doc_type"]).cast("int")
    numbers = F.size(F.filter(signals["numbers"], lambda n: (n != "") & F.contains(hay, F.lower(n))))
    return (2.0 * years + 2.0 * kind + numbers).cast("double")


def metadata_rank(candidates: DataFrame, query: str = "query_id", position: str = "position", signals: str = "signals", meta: str = "metadata", heading: str = "heading") -> DataFrame:
    """Candidates with a positive score, ranked; ties keep the candidates' order."""
    scored = candidates.withColumn("score", metadata_score(F.col(signals), F.col(meta), F.col(heading))).filter("score > 0")
    w = Window.partitionBy(query).orderBy(F.desc("score"), F.asc(position))
    return scored.withColumn("rank", F.row_number().over(w))


def _stack(acc: Column, x: Column) -> Column:
    """One heading: it sets its level and clears those that its level resets."""
    now = []
    for name in V.LEVELS:
        value = F.when(x["level"] == name, x["heading"])
        resets = [k for k, gone in V.LEVEL_RESETS.items() if name in gone]
        if resets:
            value = value.when(x["level"].isin(resets), F.lit(""))
        now.append(value.otherwise(acc[name]).alias(name))
    return F.struct(*now, F.concat(acc["out"], F.array(F.struct(*now))).alias("out"))


def _level(heading: Column, compat: bool) -> Column:
    def of(form: Column) -> Column:
        found = F.lit(None).cast("string")
        for name in reversed(V.LEVELS):
            found = F.when(form.startswith(V.LEVEL_PREFIX[name]), name).otherwise(found)
        return found

    return let(T.match_form(heading, map_d=not compat), of)


def with_sections(df: DataFrame, text: str, out: str = "sections", compat: bool = False) -> DataFrame:
    """Add array<struct(text, heading, structure)>: the preamble and one section
    from each boundary line to the next; blank ones are left out."""
    boundary = "(?iuU)^\\s*(?:" + "|".join(V.BOUNDARIES) + ")\\s*$"
    fields = ", ".join(f"{n}: string" for n in V.LEVELS)
    first = F.struct(*[F.lit("").alias(n) for n in V.LEVELS], F.array().cast(f"array<struct<{fields}>>").alias("out"))

    def starts(lines: Column) -> Column:
        marked = F.transform(lines, lambda x, i: F.when(x.rlike(boundary), i))
        return F.array_distinct(F.concat(F.array(F.lit(0)), F.filter(marked, lambda i: i.isNotNull())))

    def cut(lines: Column, begin: Column) -> Column:
        ends = F.concat(F.slice(begin, F.lit(2), F.size(begin)), F.array(F.size(lines)))

        def one(i: Column, end: Column) -> Column:
            title = F.get(lines, i)
            return F.struct(
                let(F.array_join(F.slice(lines, i + 1, end - i), "\n"), strip).alias("text"),
                F.when(title.rlike(boundary), T.squeeze(title)).otherwise(F.lit("")).alias("heading"),
            )

        return F.zip_with(begin, ends, one)

    def stacked(parts: Column) -> Column:
        headings = F.transform(parts, lambda x: F.struct(x["heading"].alias("heading"), _level(x["heading"], compat).alias("level")))
        stack = F.aggregate(headings, first, _stack, lambda acc: acc["out"])
        full = F.zip_with(parts, stack, lambda x, s: F.struct(x["text"].alias("text"), x["heading"].alias("heading"), s.alias("structure")))
        return F.filter(full, lambda x: x["text"] != "")

    whole = let(F.split(text, "\n"), lambda lines: let(starts(lines), lambda begin: let(cut(lines, begin), stacked)))
    return df.withColumn(out, whole)


def _given(array: str) -> Column:
    """The array, to be exploded. Of a bare column the optimizer infers a filter on its
    size, moves it down to the table and computes the whole column there once more."""
    return F.when(F.col(array).isNotNull(), F.col(array))


def sections(df: DataFrame, doc_id: str, text: str, compat: bool = False) -> DataFrame:
    """(doc_id, section_idx, text, heading, structure), a row per section."""
    found = with_sections(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")), "__text", compat=compat)
    rows = found.select("doc_id", F.posexplode(_given("sections")).alias("section_idx", "s"))
    return rows.select("doc_id", "section_idx", "s.text", "s.heading", "s.structure")


def window_bounds(n: Column, window: int = V.WINDOW_WORDS, overlap: int = V.OVERLAP_WORDS) -> Column:
    """array<struct(window_idx, start, end)> of the sliding windows over ``n`` words; none for no words."""
    step = max(window - overlap, 1)
    last = F.greatest(F.ceil((n - window) / step).cast("int"), F.lit(0))
    bounds = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct(k.alias("window_idx"), (k * step).alias("start"), F.least(k * step + window, n).alias("end")),
    )
    return F.when(n > 0, bounds).otherwise(F.array().cast("array<struct<window_idx:int,start:int,end:int>>"))


def windows(df: DataFrame, text: str, window: int = V.WINDOW_WORDS, overlap: int = V.OVERLAP_WORDS) -> DataFrame:
    """A row per window: window_idx, start_word, end_word, body (words joined by a space)."""
    df = df.withColumn("__words", T.words(F.col(text)))
    df = df.withColumn("__w", F.explode(window_bounds(F.size("__words"), window, overlap)))
    body = F.array_join(F.slice("__words", F.col("__w.start") + 1, F.col("__w.end") - F.col("__w.start")), " ")
    return df.withColumns({"window_idx": F.col("__w.window_idx"), "start_word": F.col("__w.start"), "end_word": F.col("__w.end"), "body": body}).drop("__w", "__words")


def chunks(df: DataFrame, doc_id: str = "doc_id", name: str = "name", link: str = "link", passage: str = "passage", window: int = V.WINDOW_WORDS, overlap: int = V.OVERLAP_WORDS, long_section: int = V.LONG_SECTION_WORDS) -> DataFrame:
    """Clean, split into sections and cut long or untitled ones into windows."""
    base = clean_text(df.select(F.col(doc_id).alias("doc_id"), F.col(name).alias("name"), F.col(link).alias("link"), F.col(passage).alias("passage")), "passage", stats=None)
    base = base.withColumns({"metadata": metadata(F.col("name"), F.col("link"), F.col("clean_text")), "clean_checksum": T.sha1(F.col("clean_text"))})
    cut = with_sections(base, "clean_text").select("doc_id", "name", "metadata", "clean_checksum", F.posexplode(_given("sections")).alias("section_idx", "s"))
    cut = cut.select("*", "s.text", "s.heading", "s.structure").drop("s")
    cut = cut.withColumn("__words", T.words(F.col("text")))
    n = F.size("__words")
    sliding = (n > long_section) | (F.col("heading") == "")
    one = F.array(F.struct(F.lit(0).alias("window_idx"), F.lit(0).alias("start"), n.alias("end")))
    cut = cut.withColumn("__sliding", sliding).withColumn("__w", F.explode(F.when(sliding, window_bounds(n, window, overlap)).otherwise(one)))
    joined = F.array_join(F.slice("__words", F.col("__w.start") + 1, F.col("__w.end") - F.col("__w.start")), " ")
    body = F.when(F.col("__sliding"), joined).otherwise(F.col("text"))
    parts = F.array("name", *[F.col(f"structure.{x}") for x in ("appendix", "chapter", "section", "article", "clause", "point")])
    heading = F.array_join(F.filter(parts, lambda x: x != ""), " | ")
    cut = cut.withColumns({"__body": body, "heading": heading})
    text = F.when(F.col("heading") != "", F.concat_ws("\n", "heading", "__body")).otherwise(F.col("__body"))
    key = F.concat_ws(":", "doc_id", "section_idx", "__w.window_idx", "__w.start", "__w.end", "clean_checksum")
    cut = cut.withColumn("text", text)
    return cut.select(
        F.substring(T.sha1(key), 1, 20).alias("chunk_id"), "doc_id", "section_idx", F.col("__w.window_idx").alias("window_idx"),
        F.col("__w.start").alias("start_word"), F.col("__w.end").alias("end_word"), (F.col("__w.end") - F.col("__w.start")).alias("word_count"),
        "heading", "text", T.sha1(F.col("text")).alias("checksum"), "structure", "metadata",
    )
