"""Quality rules with thresholds that follow the data of each language and source.

Method: each statistic goes into a histogram sketch with exact integer buckets (128 steps
in each power of two, so a quantile is off by at most a 128th). Sketches merge by adding
counts: those of (lang, source) are summed on the map side, merged into those of the
language, and these into that of the whole corpus; a group with fewer than
``least_rows`` documents uses the next larger sketch. A statistic is outside where it lies
more than ``reach`` interquartile ranges beyond the quartiles of its group; no value of a
statistic is a limit by itself. Statistics that measure one thing are a family (FAMILIES),
and a document is dropped where ``least_outside`` families are outside: what is rare in one
respect is common among good texts, what is rare in several is not. All of it is DataFrame
operations; the documents' texts are read once and only their numbers are kept.

Defined cases: a null text has no words; a null language or source is a group of its
own; rows with a null or repeated ``doc_id`` are each judged; a value right on a threshold
is inside; a very long text is handled whole, in one row's arrays of words; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stored

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: What the statistics measure.
FAMILIES = {"symbols": ["symbol_rate"], "repetition": ["dup_line_rate", "repeat_rate"], "word length": ["mean_chars"]}
STATISTICS = [x for family in FAMILIES.values() for x in family]
STEPS = 128


def _without(text: Column, signs: str) -> Column:
    for s in signs:
        text = F.replace(text, F.lit(s), F.lit(""))
    return text


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(words: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more."""

    def from_hashes(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def from_sorted(s: Column) -> Column:
            equal = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
            twice = F.filter(s, lambda x, i: equal(x, i - 1) | equal(x, i + 1))
            return F.sort_array(F.transform(twice, lambda x: x["p"]))

        def steps(q: Column) -> Column:
            return F.aggregate(F.transform(q, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(q, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(_let(placed, from_sorted), steps))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 4, _let(hashes, from_hashes)).otherwise(F.lit(0))


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The counts of every document, from one pass over its text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    base = docs.select(F.col(id_column).alias("doc_id"), F.col("lang").alias("lang"), F.col("source").alias("source"), text.alias("text"))
    words = F.array_remove(F.split("text", r"[ \t-\r]+"), "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(_without(x, SPACES)) > 0)
    with_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _covered(w).cast("long").alias("n_repeat_words"))
    with_lines = lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")
    return base.select(
        "doc_id", "lang", "source",
        F.inline(F.array(_let(words, with_words))),
        F.length(_without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        (F.octet_length("text") - F.octet_length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        _let(lines, with_lines).alias("n_dup_lines"),
        _let(lines, lambda x: F.size(x).cast("long")).alias("n_lines"),
    )


def rates(stats: DataFrame) -> DataFrame:
    """Per-mille rates as whole numbers, equal in every engine."""
    per_int = lambda a, b: F.expr(f"CASE WHEN {b} > 0 THEN ({a} * 1000) div {b} ELSE 0L END")
    return stats.withColumns({"symbol_rate": per_int("n_symbols", "word_chars"), "dup_line_rate": per_int("n_dup_lines", "n_lines"), "repeat_rate": per_int("n_repeat_words", "n_words"), "mean_chars": per_int("word_chars", "n_words")})


def bucket(value: Column) -> Column:
    """A whole number's bucket: itself below 2 * STEPS, else its first eight bits and their place."""
    shift = F.greatest(F.length(F.bin(value)) - F.lit(STEPS.bit_length()), F.lit(0))
    return shift * (2 * STEPS) + F.call_function("shiftright", value, shift.cast("int"))


def bucket_floor(b: Column) -> Column:
    """The least value of a bucket."""
    return F.call_function("shiftleft", F.pmod(b, F.lit(2 * STEPS)).cast("long"), F.floor(b / (2 * STEPS)).cast("int"))


def _few_files(df: DataFrame) -> DataFrame:
    """A small table, to be written by one task for each core and not by one for each shuffle partition.

    For each file and its folder an executor starts processes that set permissions, and
    until such a process runs its program, it counts with all of the executor's memory.
    """
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def thresholds(measured: DataFrame, reach: float = 1.5, least_rows: int = 50) -> DataFrame:
    """``(lang, source, <statistic>_low, <statistic>_high)``, one row for each language and source."""
    stacked = measured.select("lang", "source", F.inline(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in STATISTICS])))
    sketch = stacked.groupBy("lang", "source", "stat", bucket(F.col("value")).alias("b")).agg(F.count("*").alias("n"))
    sketch = stored(_few_files(sketch), "sketch")
    merged = {
        "own": sketch,
        "language": sketch.groupBy("lang", "stat", "b").agg(F.sum("n").alias("n")),
        "corpus": sketch.groupBy("stat", "b").agg(F.sum("n").alias("n")),
    }
    groups = sketch.select("lang", "source").distinct()
    found = {}
    for level, keys in (("own", ["lang", "source"]), ("language", ["lang"]), ("corpus", [])):
        # A quantile is the least bucket whose running count reaches its share; buckets of a group are bounded.
        listed = merged[level].groupBy(*keys, "stat").agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("s"), F.sum("n").alias("total"))

        def quantile(quarters: int) -> Column:
            state = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("at"))
            step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when((a["at"] < 0) & ((a["seen"] + x["n"]) * 4 >= F.col("total") * quarters), x["b"]).otherwise(a["at"]).alias("at"))
            return bucket_floor(F.aggregate("s", state, step, lambda a: a["at"]))

        q = listed.select(*keys, "stat", "total", quantile(1).alias("q1"), quantile(3).alias("q3"))
        found[level] = q.groupBy(*keys).agg(F.max("total").alias(f"{level}_n"), *[F.max(F.when(F.col("stat") == s, F.col(x))).alias(f"{level}_{s}_{x}") for s in STATISTICS for x in ("q1", "q3")])
    joined = groups.alias("g").join(found["own"].alias("o"), F.col("g.lang").eqNullSafe(F.col("o.lang")) & F.col("g.source").eqNullSafe(F.col("o.source"))).drop(F.col("o.lang"), F.col("o.source"))
    joined = joined.join(found["language"].alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang"))).drop(F.col("l.lang"))
    # One row of a few numbers, whatever the input: the corpus's quartiles.
    corpus = found["corpus"].first()
    pick = lambda s, x: F.when(F.col("own_n") >= least_rows, F.col(f"own_{s}_{x}")).when(F.col("language_n") >= least_rows, F.col(f"language_{s}_{x}")).otherwise(F.lit(corpus[f"corpus_{s}_{x}"]).cast("long"))
    out = []
    for s in STATISTICS:
        width = (pick(s, "q3") - pick(s, "q1")) * F.lit(float(reach))
        out += [(pick(s, "q1") - width).alias(f"{s}_low"), (pick(s, "q3") + width).alias(f"{s}_high")]
    return joined.select("lang", "source", *out)


def quality_rules(docs: DataFrame, least_words: int = 50, most_repeated_percent: int = 50, reach: float = 1.5, least_outside: int = 2, least_rows: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Statistics, ``base_failed``, the number of families outside (``n_outside``) and ``kept`` of every document."""
    measured = stored(rates(statistics(docs, id_column, text_column)), "rates")
    fences = stored(_few_files(thresholds(measured, reach, least_rows)), "thresholds")
    both = measured.alias("m").join(fences.alias("t"), F.col("m.lang").eqNullSafe(F.col("t.lang")) & F.col("m.source").eqNullSafe(F.col("t.source")), "left")
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated_percent)
    outside = F.lit(0)
    for family in FAMILIES.values():
        any_of = F.lit(False)
        for s in family:
            any_of = any_of | ~F.col(s).between(F.col(f"{s}_low"), F.col(f"{s}_high"))
        outside = outside + any_of.cast("int")
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (outside < least_outside)).alias("kept"), outside.alias("n_outside"), *STATISTICS)
