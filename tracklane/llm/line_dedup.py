"""Line dedup: every run of two or more lines that occurs earlier in the corpus is removed, if it isn't tiny.

Content-defined chunks carry the bulk: a rolling hash over `window` line hashes that is 0 modulo `mean_lines` ends a chunk, so
copies of a passage are cut alike inside, whatever stands around it. Every two neighbouring lines are a seed besides. A run
that occurs earlier is made of such seeds, so seeds find passages without a boundary and grow chunks line by line to the
whole run; seeds inside a chunk that is itself a later copy are left out. So the boundaries decide how much is compared, not
what is removed.

Only hashes of chunks and seeds are counted over the corpus; those that repeat are then grouped by their bytes. The first
occurrence (smallest id, then line) stays. Touching lines to remove are one run; a run of under `least_chars` characters
(blank lines, brackets) stays.

Defined cases: null texts stay null, a text of one line stays as it is; a single repeated line is never removed by itself,
blank lines are lines; rows are told apart by id and text together, so rows that share an id, null ids included, are judged
by their own text; of rows repeated with the same id and text all but one lose what they repeat (all of their lines, if
these are two or more); null ids come last; an empty table gives an empty result; all columns of the input stay, whatever
their names, and only the text changes; a text of any length is one row. A hot chunk is pre-aggregated before each shuffle;
joins may be split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import numbered, of_row, release, written


def chunk_rows(rows: DataFrame, text: str, mean_lines: int, window: int) -> DataFrame:
    """Replaces the text by (start, n, h) for each chunk of three or more lines and each two neighbouring lines."""
    keep = [c for c in rows.columns if c != text]
    rows = rows.select(*keep, F.transform(F.split(F.col(text), "\n", -1), lambda x: F.xxhash64(x)).alias("_hashes")).withColumn("_last", F.size("_hashes") - 1).filter("_last > 0")
    rolled = lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i - j) for j in range(window)])
    ends = F.filter(F.sequence(F.lit(0), F.col("_last")), lambda i: (i == F.col("_last")) | ((i >= window - 1) & (F.pmod(rolled(i), F.lit(mean_lines)) == 0)))
    rows = rows.withColumn("_ends", ends).withColumn("_starts", F.concat(F.array(F.lit(0)), F.transform("_ends", lambda e: e + 1)))
    cut = F.filter(F.transform("_ends", lambda e, k: F.struct(F.get("_starts", k).alias("start"), (e - F.get("_starts", k) + 1).alias("n"))), lambda c: c["n"] > 2)
    seeds = F.transform(F.sequence(F.lit(0), F.col("_last") - 1), lambda i: F.struct(i.alias("start"), F.lit(2).alias("n"), F.xxhash64(F.get("_hashes", i), F.get("_hashes", i + 1)).alias("h")))
    chunks = F.transform(cut, lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), F.xxhash64(F.slice("_hashes", c["start"] + 1, c["n"])).alias("h")))
    return rows.select(*keep, F.explode_outer(F.concat(chunks, seeds)).alias("c")).select(*keep, "c.*")


def _candidates(rows: DataFrame, mean_lines: int, window: int) -> DataFrame:
    """(row, id, start, n, h, body): chunks and seeds whose hash repeats, as a table."""
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "start")
    cut = chunk_rows(rows.filter("text is not null"), "text", mean_lines, window)
    often = cut.groupBy("h").agg(F.count("*").alias("times"), F.min(place).alias("first")).filter("times > 1").select("h", "first")
    hits = cut.join(often.hint("merge"), "h").select("row", F.struct("start", "n", "h", (place > F.col("first")).alias("later")).alias("hit"))
    hits = hits.groupBy("row").agg(F.collect_set("hit").alias("hits")).withColumn("wide", F.filter("hits", lambda c: c["later"] & (c["n"] > 2)))
    inside = lambda x: F.exists("wide", lambda c: (c["start"] <= x["start"]) & (x["start"] + 2 <= c["start"] + c["n"]))
    hits = hits.select("row", F.filter("hits", lambda x: (x["n"] > 2) | ~inside(x)).alias("hits"))
    body = F.array_join(F.slice("lines", F.col("c.start") + 1, F.col("c.n")), "\n")
    again = rows.join(hits.hint("merge"), "row").select("row", "id", F.split("text", "\n", -1).alias("lines"), F.explode("hits").alias("c"))
    return written(again.select("row", "id", "c.start", "c.n", "c.h", body.alias("body")), "repeated-chunks")


def repeated_chunks(rows: DataFrame, mean_lines: int = 3, window: int = 2) -> DataFrame:
    """(row, start, n): chunks and seeds to remove of the documents (row, id, text), those whose bytes occur earlier."""
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "start")
    again = _candidates(rows, mean_lines, window)
    release(rows.sparkSession)
    first = again.groupBy("h", "body").agg(F.min(place).alias("first"))
    # compared byte for byte: the body is a key of the grouping and of this join
    return again.join(first.hint("merge"), ["h", "body"]).filter(place > F.col("first")).select("row", "start", "n")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", mean_lines: int = 3, window: int = 2, least_chars: int = 20) -> DataFrame:
    """The rows of docs without runs of lines of `least_chars` characters or more that occur earlier.

    Texts are shuffled to their cuts and all joins merge, at every size: the sides to broadcast would grow with the documents.
    """
    names = docs.columns
    # two hashes of id and text: a key that any executor computes alike, without a copy of the table
    own, body = F.col(f"`{id_col}`"), F.col(f"`{text}`")
    row = F.struct(F.xxhash64(F.lit(1), own, body).alias("x"), F.xxhash64(F.lit(2), own, body).alias("y"))
    if docs.select(row.alias("row")).groupBy("row").count().filter("count > 1").isEmpty():
        docs = docs.select(row.alias("row"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"))
    else:  # rows repeated as a whole need numbers of their own
        docs = numbered(docs, "line-rows").select(F.struct(F.col("row").alias("x"), F.lit(0).cast("long").alias("y")).alias("row"), "r")
    rows = docs.select("row", of_row(id_col).alias("id"), of_row(text).alias("text"))
    cuts = repeated_chunks(rows, mean_lines, window).distinct().groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("cuts"))
    cuts = written(cuts, "line-cuts")
    release(docs.sparkSession)
    lines = F.split(of_row(text), "\n", -1)
    left = F.when(F.col("spans").isNull(), of_row(text)).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.exists("spans", lambda c: (i >= c["start"]) & (i <= c["end"]))), "\n"))
    docs = docs.join(cuts.hint("merge"), "row", "left").withColumn("spans", F.when(F.col("cuts").isNotNull(), large_runs(F.col("cuts"), lines, least_chars)))
    return docs.select(*[(left if c == text else of_row(c)).alias(c) for c in names])


def large_runs(cuts, lines, least_chars: int):
    """Array of (start, end): runs of touching lines in cuts (start, n), those of enough characters."""
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform(cuts, lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1)))))
    edge = lambda step: lambda g: F.filter(g, lambda i, k: F.coalesce(F.get(g, k + step) != i + step, F.lit(True)))
    runs = lambda g: F.zip_with(edge(-1)(g), edge(1)(g), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    spans = F.transform(F.array(gone), runs)[0]
    return F.filter(spans, lambda c: F.length(F.array_join(F.slice(lines, c["start"] + 1, c["end"] - c["start"] + 1), "")) >= least_chars)
