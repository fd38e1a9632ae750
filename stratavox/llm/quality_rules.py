"""Quality rules: heuristics, and a hashed n-gram log-likelihood ratio of target against raw corpus."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_or_empty, words_of

#: Buckets that word unigrams and bigrams are hashed to.
BUCKETS = 10_000
WINDOW = 5
#: N-grams of the raw corpus that the target's counts are smoothed with.
PRIOR = 1_000.0
#: Ids of trusted documents, of eight bytes each, that may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def _covered_words(words: Column, n_words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text, the first one included.

    Windows are compared by 64-bit hashes. Repeated windows are found by sorting (hash, place), so
    the work is n log n in the words of one text; the words they cover are counted by the gaps
    between their places.
    """

    def gaps(places: Column) -> Column:
        step = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1), p + WINDOW) - p))
        return F.aggregate(step, F.lit(0), lambda s, x: s + x)

    def repeated(pairs: Column) -> Column:
        same = lambda x, y: x["h"].eqNullSafe(y["h"])
        twice = F.filter(pairs, lambda x, k: same(x, F.get(pairs, k - 1)) | same(x, F.get(pairs, k + 1)))
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), gaps)

    def of(grams: Column) -> Column:
        pairs = F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(F.array_sort(pairs), repeated))

    windows = lambda h: F.transform(F.sequence(F.lit(0), n_words - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n_words < WINDOW, F.lit(0)).otherwise(let(let(hashes, windows), of))


def base_columns(words: Column, text: Column) -> dict[str, Column]:
    """The five statistics of the heuristics, from the words of a text and the text itself."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _covered_words(words, F.size(words)).cast("long"),
    }


def _features(hashes: Column) -> Column:
    """Buckets of the word unigrams and bigrams of a text, given its words' hashes."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    two = F.transform(hashes, lambda h, i: F.when(i > 0, F.pmod(F.xxhash64(F.get(hashes, i - 1), h), F.lit(BUCKETS)).cast("int")))
    return F.concat(one, F.array_compact(two))


def trusted_ids(marks: DataFrame) -> DataFrame:
    """All ids that are marked as good, each once."""
    return marks.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log p_target / p_raw of each bucket; the target is smoothed by ``PRIOR`` n-grams of the raw corpus.

    The raw multinomial counts every n-gram of every document; the target counts those of all
    trusted documents. Their ids are counted first: up to ``MOST_BROADCAST`` go to all tasks, so that
    no text moves, and more than that are joined by id. Counts meet as partial sums over
    ``BUCKETS`` keys; that many rows come to the driver.
    """
    ids = trusted.select(F.col("doc_id").alias("__trusted")).distinct()
    if ids.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    marked = docs.select("doc_id", text_or_empty().alias("text")).join(ids, F.col("doc_id") == F.col("__trusted"), "left")
    features = let(F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)), _features)
    grams = marked.select(F.explode(features).alias("bucket"), F.col("__trusted").isNotNull().cast("long").alias("target"))
    rows = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = [1e-9] * BUCKETS, [0.0] * BUCKETS
    for bucket, r, t in rows:
        raw[bucket] += r
        target[bucket] += t
    raw_sum, target_sum = sum(raw), sum(target)
    # p_target = (t + PRIOR * p_raw) / (sum + PRIOR), so the ratio needs no smoothing of its own.
    return [log((t / (r / raw_sum) + PRIOR) / (target_sum + PRIOR)) for t, r in zip(target, raw, strict=True)]


def _score(hashes: Column, ratios: Column) -> Column:
    """Mean log ratio over the n-grams of a text; 0 for a text without words."""
    n = F.size(hashes)
    at = lambda h: F.get(ratios, F.pmod(h, F.lit(BUCKETS)).cast("int"))
    pair = lambda h, i: F.when(i > 0, at(F.xxhash64(F.get(hashes, i - 1), h))).otherwise(F.lit(0.0))
    total = F.aggregate(F.transform(hashes, lambda h, i: at(h) + pair(h, i)), F.lit(0.0), lambda s, x: s + x)
    return F.when(n == 0, F.lit(0.0)).otherwise(total / (2 * n - 1))


def apply_rules(docs: DataFrame, trusted: DataFrame, threshold: float = -0.07) -> DataFrame:
    """Per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    ``trusted`` has the ids (doc_id) of the target documents (see ``trusted_ids``).
    ``score`` is the mean log-likelihood ratio of a text's hashed uni- and bigrams between the
    trusted target and the raw corpus; ``kept`` is false where the heuristics fail, and else whether
    the score reaches ``threshold``. Nothing is drawn at random: equal texts are treated alike.
    Null texts count as empty ones: all figures 0, base_failed, not kept. Repeated rows count each.
    Without trusted documents all ratios are 0. A score equal to the threshold keeps. An empty table
    gives no rows. Extra columns are ignored. Every row stays a row; no text is cut.
    """
    ratios = log_ratios(docs, trusted)
    # The list is folded into one array literal when the plan is optimised.
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("words", words_of(F.col("text")))
    rows = rows.select("doc_id", *[c.alias(k) for k, c in base_columns(F.col("words"), F.col("text")).items()], let(F.transform("words", lambda w: F.xxhash64(w)), lambda h: _score(h, table)).alias("score"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
