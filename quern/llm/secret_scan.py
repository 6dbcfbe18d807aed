"""Secret scans through a trigram inverted index (built-in functions only).

From each rule's regex a Boolean query over lower-case trigrams is derived: a
text that matches the regex must satisfy the query. Documents are indexed as
posting lists (block, trigram) -> ids for just the trigrams the rules ask for,
blocks being hash groups of ids, so that lists stay short however many rows
there are. Intersecting and uniting lists gives each rule's candidates, and
only those are matched with its regex. Rules without a mandatory trigram are
matched on every text.

Spans are code point offsets, end exclusive. Null texts count as empty; rows
with a null id are candidates of every rule; repeated rows get a row each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import let, materialise, table, text_or_empty

from re import _constants as sre_c
from re import _parser as sre_p


@dataclass(frozen=True)
class Rule:
    """``group`` of each match must have ``least`` characters; others are dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.regex}" if self.any_case else self.regex


# The rules. The first three are the base kinds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hosting_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
)
RULES = BASE + MORE

_MOST_STRINGS = 32


def trigram_query(regex: str):
    """The Boolean query of a regex: None (every text), a trigram, ("and", ...) or ("or", ...)."""
    return _simplify(_sequence(list(sre_p.parse(regex))))


def _strings(item):
    """The exact strings an element stands for, or None."""
    op, arg = item
    if op is sre_c.LITERAL:
        return {chr(arg).lower()}
    if op is sre_c.IN:
        out = set()
        for kind, value in arg:
            if kind is sre_c.LITERAL:
                out.add(chr(value).lower())
            elif kind is sre_c.RANGE and value[1] - value[0] < 8:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre_c.SUBPATTERN:
        return _product(arg[-1])
    if op is sre_c.BRANCH:
        parts = [_product(x) for x in arg[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if op is sre_c.MAX_REPEAT and arg[1] <= 4:
        one = _product(arg[2])
        if one is None:
            return None
        out, last = set(), {""}
        for times in range(arg[1] + 1):
            if times >= arg[0]:
                out |= last
            last = {a + b for a in last for b in one}
            if len(last) > _MOST_STRINGS:
                return None
        return out
    return None


def _product(items):
    out = {""}
    for item in items:
        some = _strings(item)
        if some is None:
            return None
        out = {a + b for a in out for b in some}
        if len(out) > _MOST_STRINGS:
            return None
    return out


def _of_strings(strings):
    if not strings or any(len(s) < 3 for s in strings):
        return None
    return ("or", *[("and", *sorted({s[i : i + 3] for i in range(len(s) - 2)})) for s in sorted(strings)])


def _sequence(items):
    must, run = [], {""}
    for item in items:
        some = _strings(item)
        joined = None if some is None else {a + b for a in run for b in some}
        if joined is not None and len(joined) <= _MOST_STRINGS:
            run = joined
            continue
        must.append(_of_strings(run))
        run = {""}
        if some is not None:
            run = some
        elif item[0] is sre_c.SUBPATTERN:
            must.append(_sequence(list(item[1][-1])))
        elif item[0] is sre_c.BRANCH:
            parts = [_sequence(list(x)) for x in item[1][1]]
            must.append(None if None in parts else ("or", *parts))
        elif item[0] is sre_c.MAX_REPEAT and item[1][0] > 0:
            must.append(_sequence(list(item[1][2])))
    must.append(_of_strings(run))
    must = [m for m in must if m is not None]
    return ("and", *must) if must else None


def _simplify(query):
    if query is None or isinstance(query, str):
        return query
    parts = list(dict.fromkeys(_simplify(q) for q in query[1:]))
    flat = []
    for p in parts:
        flat += p[1:] if isinstance(p, tuple) and p[0] == query[0] else [p]
    flat = list(dict.fromkeys(flat))
    if query[0] == "or":  # a clause that asks for more than another adds nothing
        sets = [frozenset(p[1:]) if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in flat]
        flat = [p for p, own in zip(flat, sets) if not any(o < own for o in sets)]
    return flat[0] if len(flat) == 1 else (query[0], *flat)


def trigrams_of(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1:]))


def _lists(query, postings: Column) -> Column:
    """The ids that satisfy ``query``, from one block's trigram -> ids map."""
    if isinstance(query, str):
        return F.coalesce(F.element_at(postings, F.lit(query)), F.array().cast("array<bigint>"))
    out = _lists(query[1], postings)
    for part in query[2:]:
        out = (F.array_intersect if query[0] == "and" else F.array_union)(out, _lists(part, postings))
    return out


def build_index(docs: DataFrame, doc_id: str, text: str, rules=RULES, block_rows: int = 4096) -> DataFrame:
    """(block, postings map<trigram, array<id>>) for the trigrams of the rules' queries."""
    wanted = sorted(set().union(*(trigrams_of(trigram_query(r.regex)) for r in rules)))
    blocks = max(1, docs.count() // block_rows)
    held = let(F.lower(text_or_empty(text)), lambda low: F.filter(F.array(*map(F.lit, wanted)), lambda t: F.contains(low, t)))
    hits = docs.filter(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("bigint").alias("id"), F.pmod(F.xxhash64(F.col(doc_id).cast("bigint")), F.lit(blocks)).alias("block"), F.explode(held).alias("trigram")
    )
    lists = hits.groupBy("block", "trigram").agg(F.collect_set("id").alias("ids"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("postings"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(id, rules): bit i of rules is set where rule i may match; ids without any are left out."""
    asked = []
    for i, rule in enumerate(rules):
        query = trigram_query(rule.regex)
        if query is not None:
            asked.append(_tagged(_lists(query, F.col("postings")), 1 << i))
    if not asked:
        return index.select(F.lit(0).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("rules")).limit(0)
    found = index.select(F.explode(F.concat(*asked)).alias("c")).select("c.*")
    return found.groupBy("id").agg(F.bit_or("bit").cast("bigint").alias("rules"))


def _tagged(ids: Column, bit: int) -> Column:
    return F.transform(ids, lambda d: F.struct(d.alias("id"), F.lit(bit).cast("bigint").alias("bit")))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct(start, kind_order, end)> of the rule's matches, from the pieces between them."""
    pattern = F.lit(rule.java)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    # Zipped, so that each list is made once; the piece after the last match has no match.
    sizes = F.zip_with(matches, kept, lambda m, g: F.struct(F.length(m).alias("len"), F.length(g).alias("group")))
    steps = F.zip_with(F.split(text, rule.java, -1), sizes, lambda p, s: F.struct(F.length(p).alias("gap"), s["len"].alias("len"), s["group"].alias("group")))
    steps = F.filter(steps, lambda s: s["len"].isNotNull())
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("found"))

    def take(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        end = start + s["len"]
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s["group"] >= rule.least, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(steps, first, take, lambda acc: acc["found"])


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules=RULES, broadcast_rows: int = 500_000) -> DataFrame:
    """Add ``secret_spans``: array<struct(start, kind, end)> by start, then rule order.

    Candidates are joined back by id: broadcast while they are under
    ``broadcast_rows`` rows (16 bytes each), by a shuffle beyond.
    """
    found = materialise(candidates(build_index(docs, doc_id, text, rules), rules)).select(F.col("id").alias("__id"), F.col("rules").alias("__rules"))
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    every = (1 << len(rules)) - 1
    joined = docs.join(found, docs[doc_id].cast("bigint") == found["__id"], "left")
    mask = F.when(F.col(doc_id).isNull(), F.lit(every)).otherwise(F.coalesce("__rules", F.lit(0)))
    joined = joined.withColumns({"__mask": mask, "__text": text_or_empty(text)})
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for i, rule in enumerate(rules):
        spans = _spans(F.col("__text"), rule, i)
        parts.append(spans if trigram_query(rule.regex) is None else F.when(F.col("__mask").bitwiseAND(F.lit(1 << i)) != 0, spans).otherwise(none))
    out = joined.withColumn("secret_spans", F.sort_array(F.concat(*parts)))
    return out.drop("__id", "__rules", "__mask", "__text")


def redact_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules=RULES, mark: str = "[secret]") -> DataFrame:
    """Replace every found span (overlapping ones together) by ``mark``; other text and columns stay."""
    found = find_secrets(docs, doc_id, text, rules)
    spans = F.col("secret_spans")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        before = F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])
        apart = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate(spans, start, cut, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    clean = F.when(F.size(spans) > 0, done).otherwise(F.col(text))
    return found.withColumn(text, clean).drop("secret_spans")


def spans_text(spans: Column, rules=RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scans(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"),
    )
