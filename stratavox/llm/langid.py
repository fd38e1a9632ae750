"""Language identification: known words first, backing off to shorter character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, giving_back, materialise

#: Longest to shortest character n-grams that an unseen word falls back to.
GRAMS = (5, 4, 3, 2, 1)
#: Slots of the n-gram table, and what each step to a shorter n-gram costs (natural log).
SLOT_BITS, BACKOFF = 19, 0.9
SLOTS = 1 << SLOT_BITS
UNDETERMINED = "und"
#: Words whose n-grams are counted at once, and scored at once; bytes of texts that are scored at once.
FIT_WORDS, SCORE_WORDS, SCORE_BYTES = 10_000, 2_000, 1_000_000
#: Tasks that count n-grams over the sample's words, each with one table; blocks of so many numbers move between them.
FIT_PARTS, BLOCK = 4, 1 << 16


@dataclass
class Model:
    """languages: names; words: known words, sorted; word_scores and gram_scores: log frequencies by language.

    gram_scores has ``SLOTS`` rows for hashed n-grams and is NaN where no n-gram was seen. The
    words are those of the bounded sample that ``fit`` takes.
    """

    languages: list[str]
    words: pa.Array
    word_scores: np.ndarray
    gram_scores: np.ndarray
    floor: np.ndarray


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _gram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """For words with a mark on either side: the word of each character place, and n-gram slots there.

    A slot of -1 stands where the n-gram would run over the word's end.
    """
    marked = [f" {w} " for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))
    slots, h = {}, np.zeros(len(code), np.uint64)
    rolled = code
    for n in range(1, max(GRAMS) + 1):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + rolled + np.uint64(n))
        slots[n] = np.where(left >= n, (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), -1)
        rolled = np.append(rolled[1:], np.uint64(0))
    return owner, left, slots


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """Training rows thinned to about ``per_language`` of each language by the hash of id and text."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return known
    part = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_language / r["count"]))])
    return known.filter(F.pmod(F.xxhash64(F.lit(9), F.col("doc_id"), F.col("text")), F.lit(1 << 20)) < F.element_at(part, F.col("lang")) * (1 << 20))


def gram_counts(counts: DataFrame, languages: list[str]) -> np.ndarray:
    """Square roots of the words' counts (lang, word, n) summed by n-gram slot and language, ``SLOTS`` by languages.

    At most ``FIT_PARTS`` tasks fill a table each; their blocks are summed, and the sum, of fixed
    size, comes to the driver.
    """
    k = len(languages)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS * k, np.float64)
        for batch in batches:
            column = pc.index_in(batch.column("lang"), value_set=pa.array(languages, pa.string())).to_numpy(zero_copy_only=False)
            root = np.sqrt(batch.column("n").to_numpy())
            for start in range(0, batch.num_rows, FIT_WORDS):
                owner, _, slots = _gram_slots(batch.column("word").slice(start, FIT_WORDS).to_pylist())
                for n in GRAMS:
                    ok = slots[n] >= 0
                    of = start + owner[ok]
                    table += np.bincount(slots[n][ok] * k + column[of].astype(np.int64), root[of], SLOTS * k)
        for i, own in enumerate(table.reshape(-1, BLOCK)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["block", "data"])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "data": [sum(np.frombuffer(d, np.float64) for d in rows["data"]).tobytes()]})

    schema = "block int, data binary"
    table = np.zeros(SLOTS * k)
    for i, data in counts.coalesce(FIT_PARTS).mapInArrow(lambda batches: giving_back(fill(batches)), schema).groupBy("block").applyInPandas(merge, schema).toLocalIterator():
        table[i * BLOCK : (i + 1) * BLOCK] = np.frombuffer(bytes(data), np.float64)
    return table.reshape(SLOTS, k)


def fit(docs: DataFrame, per_language: int = 5_000) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) with a language and a text.

    The fit uses a bounded sample of labelled rows, about ``per_language`` documents of each
    language chosen by the hash of id and text; languages with fewer keep all. Their words (lower
    case) are counted by language in Spark. Every word feeds the n-gram table; those met twice or
    more become known words and come to the driver with their counts, and a word met once is left to
    its n-grams. So each language that has a labelled word is learnt, however rare its words are.
    Rows of null texts or languages are left out; repeated rows count each, if they are in the
    sample; no labelled word gives a model that answers ``und`` to everything.
    """
    rows = sample(docs, per_language).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
    counts = materialise(rows.groupBy("lang", "word").agg(F.count("*").alias("n")), "language_words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], pa.array([], pa.string()), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    met = F.sum("n").over(Window.partitionBy("word"))
    top = counts.withColumn("met", met).filter("met > 1").select("lang", "word", "n").toArrow()
    words = pc.unique(top.column("word"))
    words = words.take(pc.sort_indices(words))
    table = np.zeros((len(words), len(languages)))
    row = pc.index_in(top.column("word"), value_set=words).to_numpy()
    col = pc.index_in(top.column("lang"), value_set=pa.array(languages, pa.string())).to_numpy()
    table[row, col] = top.column("n").to_numpy()
    total = np.array([totals[x] for x in languages], float)
    word_scores = np.log((table + 0.5) / (total + 0.5 * len(words)))
    grams = gram_counts(counts, languages)
    seen = grams.sum(1) > 0
    mass = grams.sum(0)
    scores = np.where(seen[:, None], np.log((grams + 0.1) / (mass + 0.1 * seen.sum())), np.nan)
    return Model(languages, words, word_scores.astype(np.float32), scores.astype(np.float32), np.log(0.1 / (mass + 0.1 * seen.sum())).astype(np.float32))


def word_table(model: Model, words: pa.Array) -> np.ndarray:
    """Scores by language of distinct lower-case words: known words by their frequency, others by backoff."""
    at = pc.index_in(words, value_set=model.words)
    known = at.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(words), len(model.languages)), np.float32)
    out[known] = model.word_scores[pc.drop_null(at).to_numpy()]
    unseen = pc.filter(words, pa.array(~known)).to_pylist()
    places = np.flatnonzero(~known)
    for start in range(0, len(unseen), SCORE_WORDS):
        part = unseen[start : start + SCORE_WORDS]
        owner, left, slots = _gram_slots(part)
        score = np.tile(model.floor - BACKOFF * len(GRAMS), (len(owner), 1))
        open_ = np.ones(len(owner), bool)
        for step, n in enumerate(GRAMS):
            try_ = np.flatnonzero(open_ & (slots[n] >= 0))
            found = model.gram_scores[slots[n][try_]]
            hit = ~np.isnan(found[:, 0])
            score[try_[hit]] = found[hit] - BACKOFF * step
            open_[try_[hit]] = False
        sums = np.stack([np.bincount(owner, score[:, j], len(part)) for j in range(score.shape[1])], 1)
        sizes = np.bincount(owner, minlength=len(part))
        # An unseen word counts as one word: the mean over its places.
        out[places[start : start + SCORE_WORDS]] = sums / sizes[:, None]
    return out


def _scored(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    cleaned = pc.fill_null(texts, "")
    letters = pc.match_substring_regex(cleaned, r"\p{L}").to_numpy(zero_copy_only=False)
    lists = pc.ascii_split_whitespace(cleaned)
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[full]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    n, k = len(texts), len(model.languages)
    if not k:
        return [UNDETERMINED] * n, np.zeros(n)
    codes = coded.indices.to_numpy()
    scores = word_table(model, coded.dictionary)
    total = np.stack([np.bincount(owner, scores[codes, j], n) for j in range(k)], 1)
    # Words of one text hang together; the square root tempers the certainty of long ones.
    words = np.maximum(1, np.bincount(owner, minlength=n))
    scaled = total / np.sqrt(words)[:, None]
    odds = np.exp(scaled - scaled.max(1, keepdims=True))
    share = odds / odds.sum(1, keepdims=True)
    best = share.argmax(1)
    names = [model.languages[i] if ok else UNDETERMINED for i, ok in zip(best, letters, strict=True)]
    return names, np.where(letters, share[np.arange(n), best], 0.0)


def _answers(model: Model, texts: pa.Array) -> pa.Array:
    """struct(lang_pred, score) of lower-case texts, scored ``SCORE_BYTES`` at a time; they stay Arrow strings."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    names, scores, start = [], [np.zeros(0)], 0
    while start < len(texts):
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + SCORE_BYTES, "right")))
        own_names, own_scores = _scored(model, texts.slice(start, end - start))
        names += own_names
        scores.append(own_scores)
        start = end
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores), pa.float64())], names=["lang_pred", "score"])


def predict(text: Column, model: Model) -> Column:
    """struct(lang_pred, score) of each whole text.

    ``und`` with score 0 if the text is null, empty or has no letter; a tie goes to the first
    language by name; equal texts are answered alike. A column expression, so rows and other columns
    stay as they are. The model's bounded tables go along with the function; each distinct word of a
    batch is scored once.
    """

    @F.arrow_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from giving_back(_answers(model, batch) for batch in batches)

    # The same lower case as in learning: that of Spark.
    return predicted(F.lower(text))
