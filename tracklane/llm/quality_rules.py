"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Null and empty texts have no words and fail the base rule. Ties and repeated rows: each row is judged alone. All columns
of the input stay; measures are appended under the prefix given, and replace an input column of the same name. The filter
returns the input's own columns, whatever their names. An empty table gives an empty result; a very long text is one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import native_words

#: Frequent function words of four languages.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or an they which you",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le",
}
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: keep a text while low <= measure <= high."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Ratios are null where there are no words; such texts fail n_words.
RULES = (
    Rule("n_words", low=20),
    Rule("repeat_ratio", high=0.30),
    Rule("mean_word_chars", low=1.5, high=20),
    Rule("symbol_ratio", high=0.20),
    Rule("shout_ratio", high=0.30),
    Rule("stop_ratio", low=0.01),
    Rule("dup_line_ratio", high=0.50),
)




def measures(df: DataFrame, text: str = "text", prefix: str = "q_") -> DataFrame:
    """Appends the base measures and ratios. One narrow projection chain; nothing shuffles and no Python runs."""
    p, names = prefix, df.columns
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.col(f"`{text}`").alias("body"))
    body = F.coalesce(F.col("body"), F.lit(""))
    df = df.withColumn(f"{p}words", native_words(F.col("body"))).withColumn(f"{p}n", F.size(f"{p}words"))
    df = df.withColumn(f"{p}wh", F.transform(f"{p}words", lambda w: F.xxhash64(w)))
    at = lambda i: F.xxhash64(*[F.get(F.col(f"{p}wh"), i + j) for j in range(WINDOW)])
    none = F.array().cast("array<bigint>")
    df = df.withColumn(f"{p}h", F.when(F.col(f"{p}n") < WINDOW, none).otherwise(F.transform(F.sequence(F.lit(0), F.col(f"{p}n") - WINDOW), at)))
    # most texts repeat no window: only the others are sorted
    twice = F.size(F.array_distinct(f"{p}h")) < F.size(f"{p}h")
    pairs = F.array_sort(F.transform(f"{p}h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(f"{p}s", F.when(twice, pairs))
    s = F.col(f"{p}s")
    same = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
    df = df.withColumn(f"{p}p", F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"])))
    pos = F.col(f"{p}p")
    gaps = F.transform(pos, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(pos, k + 1) - x, F.lit(WINDOW))))
    df = df.withColumn(f"{p}n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0)).cast("bigint"))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = sorted({w for v in STOP_WORDS.values() for w in v.split()})
    df = df.withColumn(f"{p}l", lines).withColumns({
        f"{p}n_words": F.col(f"{p}n").cast("bigint"),
        f"{p}word_chars": F.length(F.array_join(f"{p}words", "")).cast("bigint"),
        f"{p}n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint"),
        f"{p}n_shouts": F.regexp_count(body, F.lit("!")).cast("bigint"),
        f"{p}n_lines": F.size(f"{p}l").cast("bigint"),
        f"{p}n_dup_lines": (F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l"))).cast("bigint"),
        f"{p}n_stop": F.size(F.filter(f"{p}words", lambda w: F.lower(w).isin(stop))).cast("bigint"),
    })
    n = F.when(F.col(f"{p}n_words") > 0, F.col(f"{p}n_words"))
    ratios = {
        "repeat_ratio": F.col(f"{p}n_repeat_words") / n,
        "mean_word_chars": F.col(f"{p}word_chars") / n,
        "symbol_ratio": F.col(f"{p}n_symbols") / n,
        "shout_ratio": F.col(f"{p}n_shouts") / n,
        "stop_ratio": F.col(f"{p}n_stop") / n,
        "dup_line_ratio": F.when(F.col(f"{p}n_lines") > 0, F.col(f"{p}n_dup_lines") / F.col(f"{p}n_lines")),
    }
    base = [f"{p}{x}" for x in ("n_repeat_words", "n_words", "word_chars", "n_symbols", "n_dup_lines")]
    measured = {*base, *[f"{p}{k}" for k in ratios]}
    # a generated row: filters on any measure stay above it, or the optimizer would copy the chain below into them
    one = F.inline(F.array(F.struct(*[F.col(c) for c in base], *[c.alias(f"{p}{k}") for k, c in ratios.items()])))
    return df.select("r", one).select(*[F.col("r")[c].alias(c) for c in names if c not in measured], *sorted(measured))


def verdict(rules=RULES, prefix: str = "q_") -> Column:
    """The table as one boolean expression; a null measure fails its rule."""

    def one(r: Rule) -> Column:
        c = F.col(prefix + r.measure)
        tests = ([c >= F.lit(r.low)] if r.low is not None else []) + ([c <= F.lit(r.high)] if r.high is not None else [])
        return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))

    return reduce(lambda a, b: a & b, map(one, rules), F.lit(True))


def quality_filter(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Rows that pass every rule, with their own columns only."""
    names = docs.columns
    judged = measures(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("own"), F.col(f"`{text}`").alias("text")), "text")
    return judged.filter(verdict(rules)).select(*[F.col("own")[c].alias(c) for c in names])
