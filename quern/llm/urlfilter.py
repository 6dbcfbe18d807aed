"""URL filter: logistic regression on hashed character n-grams of host and path,
under explicit host/path rules (built-in functions only).

The model is fitted on the driver from the small labelled table that
``labelled_urls`` generates by rule: unwanted urls hold an unwanted stem, ordinary
ones are of ordinary stems and invented names; zones, prefixes and paths are dealt
to both alike. Four in five names fit the model; the threshold is the least one,
0.5 or more, that blocks at most one in two hundred ordinary urls of a second part,
and ``held_out_report`` measures precision and recall on a third part.

Scoring is one row-wise expression. Null urls and urls without ``://`` have an
empty host and path, match no rule, and are allowed. Urls are scored whole,
however long. Columns host, path, score, rule and verdict are replaced; the names
beginning with two underscores are free for this module.
"""

from __future__ import annotations

import json
import math
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import let, table

SLOTS = 1 << 14
GRAMS = (3, 4, 5)
#: At most this share of the ordinary urls of the calibration part is blocked.
MOST_BLOCKED = 0.005
#: (verdict, host, path); the longest fitting rule wins, earlier ones on ties.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

# Stems of the labelled table.
UNWANTED = "casino bets betting poker jackpot lottery slots pills viagra pharma cheap payday loans xxx adult porn escort hookup sweepstakes replica crypto hotgirls clickbait adserver tracker popunder warez torrent keygen spam linkfarm phish malware botnet gambling roulette bingo forex clickfraud scam".split()
WANTED = "news docs wiki library research museum weather school garden science history recipes forum archive journal university health travel music letters atlas review institute council theatre bridge harbour village printing market sports kitchen farm farmers station railway painting mountain river software hardware support status careers press".split()
LURES = "win free best online ads track hot vip bonus deal now fast farm link links seo page site zone club hub".split()
ZONES = "com org net info io dev co.uk de fr es it nl ca com.au edu biz example.com example.org example.net".split()
PREFIXES = ("", "www.", "m.", "blog.", "en.", "shop.", "static.")
PATHS = ("/", "/index.html", "/en/{n}", "/de/{n}.html", "/fr/{n}/", "/a/{n}#top", "/p?id={n}", "/{n}?page=2&ref=x", "/2021/05/{n}-story", "/wiki/Page_{n}", "/{n}?utm_source=feed", "")
CONSONANTS = "b c d f g h k l m n p r s t v w st tr ch sh th br pl gr".split()
VOWELS = "a e i o u ai ea ou io".split()
CODAS = ("", "n", "r", "s", "l", "nd", "t", "ng")


def invented_names(n: int) -> list[str]:
    """Names of two to four invented syllables, some without vowels; deterministic."""
    state, out = 12345, []
    while len(out) < n:
        name = ""
        for _ in range(2 + len(out) % 3):
            for parts in (CONSONANTS, CONSONANTS if len(out) % 4 == 3 else VOWELS, CODAS):
                state = (state * 1103515245 + 12345) % (1 << 31)
                name += parts[(state >> 8) % len(parts)]
        out.append(name)
    return out


def labelled_urls() -> list[tuple[str, int, int]]:
    """(url, unwanted, part): part 0 fits, 1 calibrates, 2 is held out. A part has names of its own."""
    rows = []
    invented = invented_names(1200)

    def put(name: str, kind: int, i: int) -> None:
        # By a hash of the name, so that they tell nothing of the label.
        pick = lambda what, some: some[zlib.crc32(f"{what}{name}{i}".encode()) % len(some)]
        path = pick("path", PATHS).format(n=pick("n", range(100, 10_000)))
        rows.append((f"{pick('scheme', ('http', 'https'))}://{pick('prefix', PREFIXES)}{name}.{pick('zone', ZONES)}{path}", kind, (0, 0, 0, 1, 2)[zlib.crc32(name.encode()) % 5]))

    for i, stem in enumerate(UNWANTED):
        for j, lure in enumerate(LURES):
            other, name = UNWANTED[(i * 3 + j + 1) % len(UNWANTED)], invented[(i * 31 + j * 7) % len(invented)]
            for k, host in enumerate((f"{stem}-{lure}", f"{lure}{stem}", f"{stem}-{other}", f"{name}-{stem}", f"{stem}.{name}")):
                if (i + j + k) % 2 == 0:
                    put(host, 1, i * 17 + j * 5 + k)
    for i, name in enumerate([*WANTED * 6, *invented]):
        second = invented[i * 13 % len(invented)]
        for k, host in enumerate((name, f"{name}-{LURES[i % len(LURES)]}", f"{name}.{second}", f"{name}{WANTED[i % len(WANTED)]}")):
            put(host, 0, i * 3 + k)
    return rows


def split_url(url: str | None) -> tuple[str, str]:
    """The driver's copy of ``host_of`` and ``path_of``, for the labelled table."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:cut]


def slots_of(host: str, path: str) -> list[int]:
    out = []
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            out += [zlib.crc32((mark + part[i : i + n]).encode()) % SLOTS for i in range(len(part) - n + 1)]
    return out


def _probability(weights, bias: float, slots: list[int]) -> float:
    z = bias + sum(weights[s] for s in slots) / math.sqrt(len(slots))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@lru_cache(maxsize=1)
def fitted(epochs: int = 8, rate: float = 2.0, decay: float = 1e-5) -> tuple[tuple[float, ...], float, float]:
    """Weights, bias and threshold; stochastic gradient descent in a fixed order."""
    every = [(slots_of(*split_url(u)), y, part) for u, y, part in labelled_urls()]
    rows = [r for r in every if r[2] == 0]
    weights, bias = [0.0] * SLOTS, 0.0
    share = sum(y for _, y, _ in rows) / len(rows)
    for epoch in range(epochs):
        step = rate / (1 + 0.5 * epoch)
        for i in range(len(rows)):
            slots, y, _ = rows[(i * 7919 + epoch) % len(rows)]
            gradient = (_probability(weights, bias, slots) - y) * (0.5 / (share if y else 1 - share))
            norm = 1 / math.sqrt(len(slots))
            for s in slots:
                weights[s] -= step * (gradient * norm + decay * weights[s])
            bias -= 0.1 * step * gradient
    ordinary = sorted((_probability(weights, bias, slots) for slots, y, part in every if part == 1 and not y), reverse=True)
    threshold = max(0.5, ordinary[int(MOST_BLOCKED * len(ordinary))] + 1e-6)
    return tuple(round(w, 5) for w in weights), round(bias, 5), round(threshold, 6)


def held_out_report() -> dict[str, float]:
    """Precision and recall on the names that neither fitted nor calibrated the model."""
    weights, bias, threshold = fitted()
    told = [(_probability(weights, bias, slots_of(*split_url(u))) >= threshold, y) for u, y, part in labelled_urls() if part == 2]
    hits, blocked, unwanted = sum(b and y for b, y in told), sum(b for b, _ in told), sum(y for _, y in told)
    return {"precision": hits / max(1, blocked), "recall": hits / unwanted, "ordinary_blocked": (blocked - hits) / (len(told) - unwanted), "rows": len(told)}


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; nulls where none fits."""
    name = verdict = F.lit(None).cast("string")
    # What is tried later overrides, so of equally long rules the last comes first.
    for kind, rhost, rpath in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rhost) | host.endswith(f".{rhost}")) & path.startswith(rpath)
        name = F.when(fits, F.lit(rhost + rpath)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _adder(weights: Column, mark: str, chars: Column, n: int):
    def add(total: Column, start: Column) -> Column:
        gram = F.concat(F.lit(mark), *[F.get(chars, start + F.lit(j)) for j in range(n)])
        return total + F.get(weights, (F.crc32(gram.cast("binary")) % SLOTS).cast("int"))

    return add


def _weigher(weights: Column, mark: str):
    """Sum over the n-grams of an array of characters, which a long text is cut into once."""

    def weight(chars: Column) -> Column:
        total = F.lit(0.0)
        for n in GRAMS:
            last = F.size(chars) - F.lit(n)
            starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
            total = total + F.aggregate(starts, F.lit(0.0), _adder(weights, mark, chars, n))
        return total

    return weight


def score_expr(host: Column, path: Column) -> Column:
    """Probability that the url is unwanted."""
    weights, bias, _ = fitted()
    table_of = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    total, count = F.lit(0.0), F.lit(0)
    for mark, part in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$")))):
        total = total + let(F.regexp_extract_all(part, F.lit("(?s)."), F.lit(0)), _weigher(table_of, mark))
        for n in GRAMS:
            count = count + F.greatest(F.length(part) - F.lit(n - 1), F.lit(0))
    z = F.lit(bias) + total / F.sqrt(F.greatest(count, F.lit(1)).cast("double"))
    return 1.0 / (1.0 + F.exp(-z))


def judge_urls(df: DataFrame, url: str = "url", rules=RULES, threshold: float | None = None) -> DataFrame:
    """Add host, path, score, rule and verdict (replacing columns of those names);
    row-wise, so repeated rows are judged alike and nothing is shuffled.
    Without ``threshold`` the calibrated one holds."""
    threshold = fitted()[2] if threshold is None else threshold
    df = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"score": score_expr(F.col("host"), F.col("path")), "rule": rule, "__by_rule": verdict})
    learned = F.when((F.col("host") != "") & (F.col("score") >= threshold), F.lit("block")).otherwise(F.lit("allow"))
    return df.withColumn("verdict", F.coalesce("__by_rule", learned)).drop("__by_rule")


def op10_url_filters(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 9).alias("score"))
