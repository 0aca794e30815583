"""Quality rules with thresholds that adapt to language and source.

Built-in expressions only. Every text gets four rates, as whole numbers; for each
language and source their distributions are kept in quantile sketches, from which the
cutoffs come, and the cutoffs are joined back to the texts.

The sketch counts values in buckets that keep the ``DIGITS`` leading binary digits
(as HDR histograms do): quantiles are right to one part in ``2 ** (DIGITS - 1)``,
sketches merge by adding counts, and the result depends neither on order nor on
partitions. A group has a few hundred buckets however many rows it has, and they are
counted before the shuffle. Groups under ``MIN_GROUP`` texts take the merged sketch of
their language, small languages that of all texts.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockyard.llm.common import free_name
from stockyard.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
RUN = 5            # words in a repeated window
MIN_WORDS = 10
MAX_REPEATED = 20  # percent of words in repeated windows

DIGITS = 7
MIN_GROUP = 50
FENCE = 3          # distance of a cutoff from the upper quartile, in median-quartile steps
# Rates by name: least distance that a cutoff keeps from the quartile, and whether
# values far below the lower quartile fail too.
RATES = {
    "letters": (3_000, True),      # characters in a thousand words
    "symbols": (100, False),       # in a thousand words
    "dup_lines": (300, False),     # in a thousand lines
    "repeats": (150, False),       # in a thousand words
}


def _let(value, body):
    """``body`` of a value that is computed once, where a lambda would repeat it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(starts):
    """Words under windows that begin at the sorted ``starts``."""
    width = F.transform(
        starts, lambda at, i: F.least(F.lit(RUN), F.coalesce(F.get(starts, i + 1) - at, F.lit(RUN)))
    )
    return F.aggregate(width, F.lit(0).cast("bigint"), lambda total, w: total + w)


def _repeated(windows):
    """Words in windows that occur twice or more."""
    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(pairs):
        same = F.filter(
            pairs,
            lambda p, k: (p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"]),
        )
        return _let(F.array_sort(F.transform(same, lambda p: p["i"])), _covered)

    return F.when(
        F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")
    ).otherwise(_let(ranked, starts))


def _measures(text):
    """Struct of the base counts of a text."""
    words = F.array_remove(F.split(text, SPACE, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))

    def windows(w):
        return F.when(
            F.size(w) >= RUN,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(w) - (RUN - 1), F.lit(1))),
                lambda i: F.xxhash64(F.slice(w, i, RUN)),
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    def counts(w):
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _let(windows(w), _repeated).alias("n_repeat_words"),
        )

    return F.struct(
        _let(words, counts).alias("w"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.struct(
            F.size(x).cast("bigint").alias("n"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"),
        )).alias("l"),
    )


def base(docs, text_col="text", others=()):
    """Base counts of every row: n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, base_failed. A null text has no words."""
    found = docs.select(*others, _measures(F.coalesce(F.col(text_col), F.lit(""))).alias("_m"))
    n, repeats = F.col("_m.w.n_words"), F.col("_m.w.n_repeat_words")
    return found.select(
        *[c if isinstance(c, str) else c for c in found.columns if c != "_m"],
        n.alias("n_words"), F.col("_m.w.word_chars").alias("word_chars"),
        F.col("_m.n_symbols").alias("n_symbols"), F.col("_m.l.n").alias("n_lines"),
        F.col("_m.l.dup").alias("n_dup_lines"), repeats.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * repeats > MAX_REPEATED * n)).alias("base_failed"),
    )


def _rates():
    words, lines = "greatest(n_words, 1)", "greatest(n_lines, 1)"
    return {
        "letters": F.expr(f"1000 * word_chars div {words}"),
        "symbols": F.expr(f"1000 * n_symbols div {words}"),
        "dup_lines": F.expr(f"1000 * n_dup_lines div {lines}"),
        "repeats": F.expr(f"1000 * n_repeat_words div {words}"),
    }


def _quantiles(sketch, keys):
    """Count and quartiles of every sketch; the sketches are added up by ``keys``."""
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    window = Window.partitionBy(*keys, "rate")
    ranked = merged.withColumn(
        "upto", F.sum("n").over(window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("total", F.sum("n").over(window))
    at = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("total") * percent, F.col("bucket")))
    return ranked.groupBy(*keys, "rate").agg(
        F.max("total").alias("total"), at(25).alias("q25"), at(50).alias("q50"), at(75).alias("q75")
    )


def cutoffs(measured, lang="lang", source="source", min_group=MIN_GROUP):
    """One row for each language and source: ``<rate>_low`` and ``<rate>_high``.

    A rate may exceed the upper quartile by ``FENCE`` times its distance from the
    median, and by the rate's least distance; the lower end is alike. Texts that fail
    the base rules don't count. A null language or source is a group like others.
    """
    rows = measured.where("NOT base_failed").select(
        F.col(lang).alias("lang"), F.col(source).alias("source"),
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("rate"), value.cast("bigint").alias("x")) for name, value in _rates().items()
        ])).alias("r"),
    ).select("lang", "source", "r.rate", "r.x")
    rows = rows.withColumn("e", F.greatest(F.length(F.bin("x")) - DIGITS, F.lit(0)))
    sketch = rows.withColumn("bucket", F.expr("shiftleft(shiftright(x, e), e)")).groupBy(
        "lang", "source", "rate", "bucket"
    ).agg(F.count("*").alias("n"))
    sketch = materialize(sketch, "rules_sketch")
    names = ["total", "q25", "q50", "q75"]
    own = _quantiles(sketch, ["lang", "source"])
    by_lang = _quantiles(sketch, ["lang"]).select(
        F.col("lang").alias("l_lang"), F.col("rate").alias("l_rate"), *[F.col(c).alias(f"l_{c}") for c in names]
    )
    overall = _quantiles(sketch, []).select(
        F.col("rate").alias("a_rate"), *[F.col(c).alias(f"a_{c}") for c in names]
    )
    joined = (
        own.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rate") == F.col("l_rate")))
        .join(overall, F.col("rate") == F.col("a_rate"))
    )
    pick = {
        c: F.when(F.col("total") >= min_group, F.col(c))
        .when(F.col("l_total") >= min_group, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
        for c in names[1:]
    }
    picked = joined.select("lang", "source", "rate", *[v.alias(c) for c, v in pick.items()])
    ends = []
    for name, (least, both) in RATES.items():
        here = lambda value, name=name: F.max(F.when(F.col("rate") == name, value))
        ends.append(here(
            F.col("q75") + F.greatest(FENCE * (F.col("q75") - F.col("q50")), F.lit(least))
        ).alias(f"{name}_high"))
        if both:
            ends.append(here(
                F.col("q25") - F.greatest(FENCE * (F.col("q50") - F.col("q25")), F.lit(least))
            ).alias(f"{name}_low"))
    return picked.groupBy("lang", "source").agg(*ends)


def _passes():
    verdict = F.lit(True)
    for name, value in _rates().items():
        verdict = verdict & (value <= F.coalesce(F.col(f"{name}_high"), value))
        if RATES[name][1]:
            verdict = verdict & (value >= F.coalesce(F.col(f"{name}_low"), value))
    return ~F.col("base_failed") & verdict


def _judged(measured, cuts, lang="lang", source="source"):
    cuts = cuts.withColumnRenamed("lang", "_c_lang").withColumnRenamed("source", "_c_source")
    return measured.join(
        cuts, F.col(lang).eqNullSafe(F.col("_c_lang")) & F.col(source).eqNullSafe(F.col("_c_source")), "left"
    ).withColumn("kept", _passes())


def judge(docs):
    """doc_id, the base counts and ``kept`` of every row; null and repeated ids are
    rows like others. ``kept`` is false where base_failed is true, else tells whether
    all rates lie within the cutoffs of the row's language and source."""
    measured = materialize(base(docs, others=["doc_id", "lang", "source"]), "rules_measured")
    return _judged(measured, cutoffs(measured)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep(docs):
    """The rows of ``docs`` that ``judge`` keeps, with their columns."""
    whole = free_name(docs.columns, "_doc")
    # written with its measures: a filter over the measuring expressions would hold a copy of
    # them for every rate
    measured = materialize(base(docs, others=[F.struct(*docs.columns).alias(whole), "lang", "source"]), "rules_measured")
    rows = _judged(measured, materialize(cutoffs(measured), "rules_cutoffs")).where("kept")
    return rows.select(*[F.col(f"{whole}.`{c}`").alias(c) for c in docs.columns])
