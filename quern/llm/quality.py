"""Quality rules whose thresholds come from quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACES, WORD_GAP, Stages, read_table, row_key

MIN_WORDS = 50
REPEAT_SHARE = 50
#: Accuracy of the quantile sketches: the rank error is 1 / ACCURACY of a group.
ACCURACY = 10_000
#: Documents are fenced among those of their size, as long texts vary less: a class holds texts of 2**k to 2**(k + 1) words.
#: A group's fence for a metric is median + SPREAD * (TAIL quantile - median) of its class, language and source. It is
#: averaged with the fence of the group above (class and language; class; all) as if that were SHRINK documents, and is at
#: most LOOSE times the fence above or the median of the source (language; all) over all classes, whichever is higher: what a
#: minority of a source does cannot lift the source's fence, what most of its documents do can. Where even the tail is zero, the share of zeros says nothing on
#: what is usual in the other documents, and the fence above holds.
TAIL, SPREAD, SHRINK, LOOSE = 0.9, 6.0, 50, 2.0
#: A document fails if its count is NOISE standard deviations of a count above what the fence lets expect for its size.
#: At least STRAY counts are expected in a document of the corpus's median size, and in proportion in others.
NOISE, STRAY = 6.0, 0.5
#: Metrics: (count, size), fenced as count / size.
METRICS = {
    "symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words"),
}
#: Groups whose fences may be broadcast.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """The words of a text: maximal runs without space and U+0009 to U+000D; none if null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, as a lambda's argument."""
    return F.transform(F.array(value), body)[0]


def repeated_words(w: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text."""
    windows = F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def flagged(s: Column) -> Column:
            last = F.size(s) - 1
            return F.filter(
                s,
                lambda e, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["x"] == e["x"]))
                | ((k < last) & (s[F.least(k + 1, last)]["x"] == e["x"])),
            )

        return bind(
            pairs,
            lambda s: F.size(F.array_distinct(F.flatten(F.transform(flagged(s), lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))))),
        )

    return bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def text_stats(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text, in one row and no shuffle."""
    value = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    dups = bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return bind(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(value, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            dups.cast("long").alias("n_dup_lines"),
            F.size(F.filter(F.split(value, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")).cast("long").alias("n_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def size_class(q: Column) -> Column:
    return F.floor(F.log2(F.greatest(q["n_words"], F.lit(1)))).cast("int")


def fences(stages: Stages, stats: DataFrame) -> DataFrame:
    """(k, lang, source, fence struct, stray struct) for each class, language and source of ``stats(lang, source, q)``,
    q from text_stats, null being a value of its own.

    The quantile sketches (approx_percentile: mergeable summaries, combined on the map side) are made of the documents that
    the fixed rules keep, per class, language and source, per class and language, per class, and for all.
    """
    base = stats.where(~base_fails(F.col("q")))
    flat = base.select(
        size_class(F.col("q")).alias("k"), F.struct("lang").alias("l"), F.struct("source").alias("s"),
        *[(F.col("q")[a] / F.greatest(F.col("q")[b], F.lit(1))).alias(m) for m, (a, b) in METRICS.items()],
        *[F.col("q")[b].alias(f"size_{m}") for m, (_, b) in METRICS.items()],
    )
    sketches = flat.rollup("k", "l", "s").agg(
        F.count("*").alias("n"), *[F.percentile_approx(m, F.array(F.lit(0.5), F.lit(TAIL)), F.lit(ACCURACY)).alias(m) for m in METRICS],
        *[F.percentile_approx(f"size_{m}", F.lit(0.5), F.lit(ACCURACY)).alias(f"size_{m}") for m in METRICS],
    )
    own = lambda m: (F.col(m)[0] + SPREAD * (F.col(m)[1] - F.col(m)[0])).alias(m)
    levels = stages.table(sketches.select("k", "l", "s", "n", *[own(m) for m in METRICS], *[f"size_{m}" for m in METRICS]))
    medians = stages.table(flat.rollup("l", "s").agg(*[F.percentile_approx(m, F.lit(0.5), F.lit(ACCURACY)).alias(m) for m in METRICS]))
    every, middle = levels.where("k is null").first(), medians.where("l is null").first()

    def below(up, mid) -> list[Column]:
        n = F.col("o.n")
        return [
            F.when(F.col(f"o.{m}") == 0, up(m)).otherwise(
                F.least((n * F.col(f"o.{m}") + SHRINK * up(m)) / (n + SHRINK), LOOSE * F.greatest(up(m), mid(m)))
            ).alias(m) for m in METRICS
        ]

    of = lambda side: lambda m: F.col(f"{side}.{m}")
    known = lambda row: lambda m: F.lit(row[m] if row else None).cast("double")
    same = lambda a, b, *keys: [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys]
    classes = levels.where("k is not null and l is null").alias("o").select("k", *below(known(every), known(middle)))
    langs = (
        levels.where("l is not null and s is null").alias("o").join(classes.alias("u"), same("o", "u", "k"))
        .join(medians.where("l is not null and s is null").alias("m"), same("o", "m", "l")).select("o.k", "o.l", *below(of("u"), of("m")))
    )
    pairs = (
        levels.where("s is not null").alias("o").join(langs.alias("u"), same("o", "u", "k", "l"))
        .join(medians.where("s is not null").alias("m"), same("o", "m", "l", "s"))
    )
    stray = F.struct(*[F.lit(STRAY / max(every[f"size_{m}"], 1) if every else None).cast("double").alias(m) for m in METRICS])
    fence = F.struct(*below(of("u"), of("m")))
    return stages.table(pairs.select(
        F.col("o.k").alias("k"), F.col("o.l.lang").alias("lang"), F.col("o.s.source").alias("source"), fence.alias("fence"), stray.alias("stray")
    ))


def base_fails(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > REPEAT_SHARE * q["n_words"])


def quality_table(docs: DataFrame, with_text: bool = False, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The columns of ``docs``, text only ``with_text``, plus the counts of text_stats, ``base_failed``, ``failed_rules`` and ``kept``.

    A document is rejected by the fixed rules, or by a metric whose count is too high for the fence of its class of sizes,
    its language and its source; ``groups`` without one of the two fences all its values together. What is allowed grows
    with the text: a rate is compared with the group's rate, with the noise that a count of that size has. The counts are
    computed once and staged; sketches and the join read the staged rows.

    Null text has no words and fails; so does empty text. Very long texts are read whole. Null language and source are
    values of their own. Repeated rows are rated each, and ties have the same verdict. An empty table gives no rows.
    Other columns pass through, whatever their names, but input columns named like a result give way.
    """
    stages = Stages(docs.sparkSession, "quality")
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed", "failed_rules", "kept")
    own = [c for c in docs.columns if c not in results and (with_text or c != "text")]
    lang, source = (F.col(c).alias(c) if c in groups else F.lit(None).cast("string").alias(c) for c in ("lang", "source"))
    rows = stages.table(docs.select(F.struct(*own).alias("doc"), lang, source, text_stats(F.col("text")).alias("q")))
    limits = fences(stages, rows.select("lang", "source", "q")).alias("f")
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_ROWS else limits
    same = F.col("d.lang").eqNullSafe(F.col("f.lang")) & F.col("d.source").eqNullSafe(F.col("f.source")) & (size_class(F.col("q")) == F.col("f.k"))
    joined = rows.alias("d").join(limits, same, "left")
    above = lambda count, allowed: count > allowed + NOISE * F.sqrt(allowed + 1)
    rate = lambda m: F.greatest(F.col("fence")[m], F.col("stray")[m])
    failed = F.filter(
        F.array(*[F.when(above(F.col("q")[a], rate(m) * F.col("q")[b]), F.lit(m)) for m, (a, b) in METRICS.items()]), lambda x: x.isNotNull()
    )
    rated = joined.select("doc", "q", base_fails(F.col("q")).alias("base_failed"), failed.alias("failed_rules"))
    return rated.select("doc.*", "q.*", "base_failed", "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns and values; odd rows as in quality_table.

    Rows are known by row_key, so that no text is staged: rows with equal keys have equal verdicts.
    """
    key = row_key(docs)
    whole = docs.select(key.alias("key"), F.col("text").cast("string").alias("text"), "lang", "source")
    stages = Stages(docs.sparkSession, "quality_filter")
    gone = stages.table(quality_table(whole).where(~F.col("kept")).select("key").distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    rows = docs.select(F.struct(*docs.columns).alias("all"), key.alias("key"))
    return rows.join(gone, "key", "left_anti").select("all.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_table(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_SHARES_SQL = ", ".join(f"{a} / greatest({b}, 1) AS {m}" for m, (a, b) in METRICS.items())
_FENCES_SQL = ", ".join(f"quantile_disc({m}, 0.5) + {SPREAD} * (quantile_disc({m}, {TAIL}) - quantile_disc({m}, 0.5)) AS {m}" for m in METRICS)
_MID_SQL = ", ".join(f"quantile_disc({m}, 0.5) AS mid_{m}" for m in METRICS)
_STRAY_SQL = ", ".join(f"{STRAY} / greatest(quantile_disc({b}, 0.5), 1) AS stray_{m}" for m, (_, b) in METRICS.items())
_BOUND_SQL = ", ".join(
    f"CASE WHEN o.{m} = 0 THEN u.{m} ELSE least((o.n * o.{m} + {SHRINK} * u.{m}) / (o.n + {SHRINK}), {LOOSE} * greatest(u.{m}, mid_{m})) END AS {m}"
    for m in METRICS
)
_ALLOWED = "greatest(g.{m}, e.stray_{m}) * {b}"
_FAILS_SQL = " OR ".join(
    f"coalesce({a} > {_ALLOWED.format(m=m, b=b)} + {NOISE} * sqrt({_ALLOWED.format(m=m, b=b)} + 1), false)" for m, (a, b) in METRICS.items()
)

OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
t AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
p AS (SELECT doc_id, count(DISTINCT j) AS k FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT * FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1)) GROUP BY 1),
s AS (
  SELECT w.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(k, 0) AS n_repeat_words
  FROM w LEFT JOIN p ON p.doc_id = w.doc_id
), m AS (SELECT *, {_SHARES_SQL}, CAST(floor(log2(greatest(n_words, 1))) AS INTEGER) AS k, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words AS base_failed FROM s),
x AS (SELECT * FROM m WHERE NOT base_failed),
e AS (SELECT {_FENCES_SQL}, {_STRAY_SQL}, {_MID_SQL} FROM x),
c AS (SELECT k, {_BOUND_SQL} FROM (SELECT k, count(*) AS n, {_FENCES_SQL} FROM x GROUP BY 1) o, e u),
l AS (SELECT o.k, o.lang, {_BOUND_SQL} FROM (SELECT k, lang, count(*) AS n, {_FENCES_SQL} FROM x GROUP BY 1, 2) o JOIN c u ON u.k = o.k
      JOIN (SELECT lang, {_MID_SQL} FROM x GROUP BY 1) h ON h.lang IS NOT DISTINCT FROM o.lang),
g AS (SELECT o.k, o.lang, o.source, {_BOUND_SQL} FROM (SELECT k, lang, source, count(*) AS n, {_FENCES_SQL} FROM x GROUP BY 1, 2, 3) o JOIN l u ON u.k = o.k AND u.lang IS NOT DISTINCT FROM o.lang
      JOIN (SELECT lang, source, {_MID_SQL} FROM x GROUP BY 1, 2) h ON h.lang IS NOT DISTINCT FROM o.lang AND h.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {_FAILS_SQL}) AS kept
FROM m LEFT JOIN g ON g.k = m.k AND g.lang IS NOT DISTINCT FROM m.lang AND g.source IS NOT DISTINCT FROM m.source LEFT JOIN e ON true
"""
