"""Toxicity: noisy-channel restoration of disguised words, then a lexicon with lasso weights.

A disguised word is a lattice: a figure or sign may stand for a letter, a separator between letters
may be nothing, a repeated letter may be meant once or twice. A Viterbi search finds the likeliest
reading under a model of the corpus' characters, four at a time, and the channel's costs. Texts are
scored by the restored words that labelled toxic texts have more often than others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

# What a figure or sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e"}
SEPARATORS = " .-_*~'"
#: Costs of the channel, in nats: a sign for a letter, a separator meant as nothing, a pair of equal
#: letters meant once. Longer runs may be meant once or twice alike.
SIGN_COST, SEPARATOR_COST, PAIR_COST, RUN_COST = 2.0, 1.5, 3.0, 0.5
BOUNDARY, NOTHING, AGAIN = 32, -1, -2
#: Readings kept at each place, by their last characters.
STATES = 24
#: Places of a lattice that are read together; longer tokens are read piece by piece.
PLACES = 48
#: Beginnings of words, of so many characters, that the lexicon has beside whole words.
PREFIXES = (3, 4, 5, 6, 7)
#: Characters that the model looks at together, bits of one of them (the lowest of its code point), and
#: slots of the counts of one, two, ... characters.
ORDER, CODE_BITS = 4, 16
SLOT_BITS = (16, 18, 20, 21)
#: Characters of texts that are worked on together, and counted together, and readings that a task remembers.
BATCH_CHARS, COUNT_CHARS = 2_000_000, 1_000_000
REMEMBERED = 200_000

#: Signs around a token say nothing, but for one that may start a word.
_OUTSIDE = "!\"#%&'()*,-./:;<=>?[\\]^_`{}~\u00a1\u00a7\u00ab\u00b7\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u201e\u2026"
_BEHIND = _OUTSIDE + "@$|+\u20ac"
_OPEN = np.zeros(1 << 16, bool)
_OPEN[[ord(c) for c in [*LEET, *SEPARATORS]]] = True


@dataclass(frozen=True)
class CharacterModel:
    """Counts of one to ``ORDER`` characters by hash slot; characters outside words are one boundary."""

    counts: tuple[np.ndarray, ...]

    def logs(self, before: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Natural log of P(c | the last ``ORDER`` - 1 characters), each order smoothed by the one below.

        ``before`` packs those characters in ``CODE_BITS`` each, the last one lowest.
        """
        p = (self.counts[0][_slot(1, c)] + 0.1) / (max(1.0, float(self.counts[0].sum())) + 0.1 * len(self.counts[0]))
        for n in range(2, ORDER + 1):
            context = before & ((1 << CODE_BITS * (n - 1)) - 1)
            p = (self.counts[n - 1][_slot(n, context, c)] + 2 * p) / (self.counts[n - 2][_slot(n - 1, context)] + 2)
        return np.log(p)


def _slot(n: int, before: np.ndarray, c: np.ndarray | None = None) -> np.ndarray:
    """The slot of ``n`` packed characters: ``before``, and ``c`` if it is given."""
    x = before if c is None else (before << CODE_BITS) | c
    if n > 1:
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS[n - 1])
        return x.astype(np.int64)
    return x & ((1 << SLOT_BITS[0]) - 1)


_in_words: np.ndarray | None = None


def _word_characters() -> np.ndarray:
    """Whether each of the first 65,536 characters is a letter or figure."""
    global _in_words
    if _in_words is None:
        _in_words = np.fromiter((chr(i).isalnum() for i in range(1 << 16)), bool, 1 << 16)
    return _in_words


def _stream(text: str) -> np.ndarray:
    """Code points of a text in lower case, each run of what is no letter or figure as one boundary.

    Words that mix letters and figures, and three or more single characters in a row, are left out: the
    model is one of plain words, which a disguise that many texts have must not become.
    """
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    low = x & ((1 << CODE_BITS) - 1)
    inside = (x != low) | _word_characters()[low]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    keep[:1] = True
    x = np.where(inside, low, BOUNDARY)[keep]
    edge = x == BOUNDARY
    run = np.cumsum(edge)
    size = np.bincount(run[~edge], minlength=run[-1] + 1) if len(run) else run
    figures = np.bincount(run[(x >= 48) & (x <= 57)], minlength=len(size))
    alone = np.concatenate([[False] * 2, size == 1, [False] * 2])
    series = alone[2:-2] & ((alone[1:-3] & (alone[:-4] | alone[3:-1])) | (alone[3:-1] & alone[4:]))
    return x[~(series | ((figures > 0) & (figures < size)))[run]] if len(run) else x


def character_model(texts: DataFrame) -> CharacterModel:
    """Counts over every text of ``texts`` (column text); nulls and empty texts add nothing.

    Each task counts in tables of fixed size and hands on the slots it has met; their sums, at most
    3.5 million numbers whatever the corpus, come to the driver.
    """
    starts = np.cumsum([0] + [1 << b for b in SLOT_BITS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(1 << b, np.int64) for b in SLOT_BITS]
        for batch in batches:
            for part in _parts(batch.column(0).to_pylist(), COUNT_CHARS):
                packed = x = _stream(" \n".join(part) + " ")
                for n in range(1, ORDER + 1):
                    if n > 1:
                        packed = (packed[:-1] << CODE_BITS) | x[n - 1 :]
                    tables[n - 1] += np.bincount(_slot(n, packed), minlength=1 << SLOT_BITS[n - 1])
        table = np.concatenate(tables)
        met = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(table[met], pa.int64())], names=["slot", "n"])

    rows = texts.select("text").filter(F.length("text") > 0).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(starts[-1], np.float32)
    table[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return CharacterModel(tuple(np.split(table, starts[1:-1])))


def _parts(texts: list[str | None], chars: int = BATCH_CHARS) -> Iterator[list[str]]:
    """``texts`` in groups of about ``chars`` characters; nulls as empty texts."""
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def lattice(token: str) -> list[list[tuple[int, float]]]:
    """The choices (character or nothing or the same again, cost) at each place of a token."""
    out = []
    for run in re.finditer(r"(.)\1*", token, re.S):
        c, k = run[1], len(run[0])
        if c in LEET:
            choices = [(ord(c), 0.0) if c.isalnum() else (BOUNDARY, SIGN_COST)] + [(ord(x), SIGN_COST) for x in LEET[c]]
        elif c.isalnum():
            choices = [(ord(c), 0.0)]
        else:
            out.append([(BOUNDARY, 0.0), (NOTHING, SEPARATOR_COST)] if c in SEPARATORS and k == 1 else [(BOUNDARY, 0.0)])
            continue
        out.append(choices)
        if k > 1:
            again = AGAIN if c in LEET else ord(c)
            out.append([(again, 0.0), (NOTHING, PAIR_COST)] if k == 2 else [(again, RUN_COST), (NOTHING, RUN_COST)])
    return out


def _viterbi(model: CharacterModel, lattices: list[list[list[tuple[int, float]]]]) -> list[str]:
    """The best reading of each lattice; all of them a place at a time. Ties go to the earlier choice."""
    n, places = len(lattices), max(map(len, lattices))
    width = max(len(x) for l in lattices for x in l)
    emit = np.full((n, places, width), NOTHING, np.int64)
    cost = np.full((n, places, width), np.inf, np.float32)
    cost[:, :, 0] = 0
    for i, l in enumerate(lattices):
        for t, choices in enumerate(l):
            for k, (e, w) in enumerate(choices):
                emit[i, t, k], cost[i, t, k] = e, w
    mask = (1 << CODE_BITS * (ORDER - 1)) - 1
    last = np.full((n, 1), sum(BOUNDARY << CODE_BITS * i for i in range(ORDER - 1)), np.int64)
    score = np.zeros((n, 1), np.float32)
    back = []
    for t in range(places):
        before = last[:, :, None]
        b = before & ((1 << CODE_BITS) - 1)
        e = np.broadcast_to(emit[:, None, t], (n, last.shape[1], width))
        e = np.where(e == AGAIN, b, e)
        silent = (e == NOTHING) | ((e == BOUNDARY) & (b == BOUNDARY))
        code = np.maximum(e, 0) & ((1 << CODE_BITS) - 1)
        before = np.broadcast_to(before, e.shape)
        gain = np.where(silent, 0, model.logs(before, code))
        total = (score[:, :, None] + gain - cost[:, None, t]).reshape(n, -1)
        ends = np.where(silent, before, ((before << CODE_BITS) | code) & mask).reshape(n, -1)
        # Of the readings that end alike the best one is kept.
        order = np.argsort(-total, 1, kind="stable")
        ends = np.take_along_axis(ends, order, 1)
        by_end = np.argsort(ends, 1, kind="stable")
        sorted_ends = np.take_along_axis(ends, by_end, 1)
        twin = np.zeros(ends.shape, bool)
        np.put_along_axis(twin, by_end[:, 1:], sorted_ends[:, 1:] == sorted_ends[:, :-1], 1)
        first = np.argsort(twin, 1, kind="stable")[:, :STATES]
        order = np.take_along_axis(order, first, 1)
        score = np.where(np.take_along_axis(twin, first, 1), -np.inf, np.take_along_axis(total, order, 1)).astype(np.float32)
        used = int(np.isfinite(score).sum(1).max())
        score, last, order = score[:, :used], np.take_along_axis(ends, first, 1)[:, :used], order[:, :used]
        back.append((order // width, np.take_along_axis(np.where(silent, NOTHING, e).reshape(n, -1), order, 1)))
    b = last & ((1 << CODE_BITS) - 1)
    end = score + np.where(b == BOUNDARY, 0, model.logs(last, np.full_like(last, BOUNDARY)))
    at = end.argmax(1)
    out = np.full((places, n), NOTHING, np.int64)
    rows = np.arange(n)
    for t in range(places - 1, -1, -1):
        source, emitted = back[t]
        out[t] = emitted[rows, at]
        at = source[rows, at]
    return ["".join(map(chr, column[column != NOTHING])) for column in out.T]


def _lone_pairs(model: CharacterModel, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each pair x[at], x[at + 1] is better read as one letter, all else in its token being plain.

    The Viterbi search of a lattice with this one open place, without the steps that both readings share.
    """
    w = {k: x[at + k] for k in range(-2, 4)}
    pack = lambda *k: sum(w[i] << CODE_BITS * j for j, i in enumerate(reversed(k)))
    inner = np.where(w[2] == BOUNDARY, 0, 1)
    twice = model.logs(pack(-2, -1, 0), w[0]) + model.logs(pack(-1, 0, 1), w[2]) + inner * model.logs(pack(0, 1, 2), w[3])
    once = model.logs(pack(-2, -1, 0), w[2]) + inner * model.logs(pack(-1, 0, 2), w[3])
    return once - PAIR_COST > twice


def restore_tokens(model: CharacterModel, cores: list[str], remembered: dict[str, str] | None = None) -> dict[int, str]:
    """The likeliest readings that differ, by the place of their token in ``cores`` (distinct, in lower case).

    Tokens without a letter and those without a figure, sign, separator or repeated letter stay.
    ``remembered`` keeps readings from call to call.
    """
    if not cores:
        return {}
    remembered = {} if remembered is None else remembered
    x = np.frombuffer(("  " + "  ".join(cores) + "   ").encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, cores), np.int64, len(cores))
    starts = np.cumsum(sizes + 2) - sizes
    owner = np.repeat(np.arange(len(cores)), sizes)
    place = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    low = x & ((1 << CODE_BITS) - 1)
    words = _word_characters()[low] | (x != low)
    letters = words & ~((x >= 48) & (x <= 57))
    has_letter = np.bincount(owner, letters[place], len(cores)) > 0
    signs = np.bincount(owner, (_OPEN[low] & (x == low))[place], len(cores)) > 0
    same = (x[place] == x[place + 1]) & letters[place]
    pairs = np.bincount(owner, same, len(cores))
    out = {}
    lone = np.flatnonzero(same & (has_letter & ~signs & (pairs == 1))[owner])
    for i in lone[_lone_pairs(model, low, place[lone])] if len(lone) else ():
        core, k = cores[owner[i]], int(place[i] - starts[owner[i]])
        out[int(owner[i])] = core[:k] + core[k + 1 :]
    hard = np.flatnonzero(has_letter & (signs | (pairs > 1))).tolist()
    fresh = [c for c in (cores[i] for i in hard) if c not in remembered]
    lattices, whose = [], []
    for c in fresh:
        places = lattice(c)
        for start in range(0, len(places), PLACES):
            lattices.append(places[start : start + PLACES])
            whose.append(c)
    order = sorted(range(len(lattices)), key=lambda k: len(lattices[k]))
    read = [""] * len(lattices)
    for start in range(0, len(order), 2048):
        some = order[start : start + 2048]
        for k, text in zip(some, _viterbi(model, [lattices[k] for k in some]), strict=True):
            read[k] = text
    if len(remembered) + len(fresh) > REMEMBERED:
        for c in set(remembered).difference(cores):
            del remembered[c]
    remembered.update(dict.fromkeys(fresh, ""))
    for c, text in zip(whose, read, strict=True):
        remembered[c] += text
    for i in hard:
        reading = " ".join(remembered[cores[i]].split())
        if reading != cores[i]:
            out[i] = reading
    return out


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """Owner and code of each token of the texts in lower case without outer signs, and the distinct tokens.

    Three or more tokens of one character in a row are, in addition, one token with spaces.
    """
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
    flat = pc.utf8_ltrim(pc.utf8_rtrim(lists.flatten(), characters=_BEHIND), characters=_OUTSIDE)
    full = pc.not_equal(flat, "")
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[full.to_numpy(zero_copy_only=False)]
    flat = flat.filter(full)
    places = np.flatnonzero(pc.equal(pc.utf8_length(flat), 1).to_numpy(zero_copy_only=False))
    # Places in a row within one text share their place less their rank.
    runs = (places - np.arange(len(places))) * len(texts) + owner[places] if len(places) else places
    first = np.flatnonzero(np.append(True, runs[1:] != runs[:-1])) if len(places) else places
    long_ = np.diff(np.append(first, len(places))) > 2 if len(places) else np.zeros(0, bool)
    more, of = [], []
    for i, k in zip(first[long_], np.diff(np.append(first, len(places)))[long_] if len(places) else (), strict=True):
        more.append(" ".join(flat.slice(places[i], k).to_pylist()))
        of.append(owner[places[i]])
    coded = pa.concat_arrays([flat.cast(pa.large_string()), pa.array(more, pa.large_string())]).dictionary_encode()
    return np.append(owner, np.array(of, np.int64)), coded.indices.to_numpy(), coded.dictionary


def restored(text: Column, model: CharacterModel) -> Column:
    """struct(text, changed): a text's words in lower case as they are meant, joined by spaces, and how many were changed.

    Signs around words go; words of spelled-out letters follow at the end. Null texts count as empty ones.
    """
    @F.pandas_udf("text string, changed long")
    def restore(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for part in _parts(batch.tolist()):
                owner, codes, cores = _tokens(part)
                cores = cores.to_pylist()
                read = restore_tokens(model, cores)
                words: list[list[str]] = [[] for _ in part]
                changed = [0] * len(part)
                for i, c in zip(owner.tolist(), codes.tolist(), strict=True):
                    words[i].append(read.get(c, cores[c]))
                    changed[i] += c in read
                found += [(" ".join(filter(None, w)), k) for w, k in zip(words, changed, strict=True)]
            yield pd.DataFrame(found, columns=["text", "changed"])

    return restore(text)


@dataclass(frozen=True)
class Model:
    """A character model, the lexicon's words with their weights, and the bias."""

    characters: CharacterModel
    words: list[str]
    weights: np.ndarray
    bias: float


def _forms(words: pa.StringArray) -> Iterator[tuple[pa.StringArray, np.ndarray]]:
    """The words and their beginnings (marked by a star), with the places of the words they are of."""
    yield words, np.arange(len(words))
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    for k in PREFIXES:
        at = np.flatnonzero(sizes > k)
        yield pc.binary_join_element_wise(pc.utf8_slice_codeunits(words.take(pa.array(at)), 0, k), "*", ""), at


def _hits(model: CharacterModel, known: pa.StringArray, texts: list[str], remembered: dict[str, str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, form of ``known``) pairs, met as it stands or as restored, and how many tokens of each text were restored."""
    owner, codes, cores = _tokens(texts)
    read = restore_tokens(model, cores.to_pylist(), remembered)
    words = [(c, w) for c, text in read.items() for w in text.split()]
    of = np.append(np.arange(len(cores)), np.array([c for c, _ in words], np.int64))
    token, word = [], []
    for forms, at in _forms(pa.concat_arrays([cores.cast(pa.string()), pa.array([w for _, w in words], pa.string())])):
        found = pc.index_in(forms, value_set=known)
        token.append(of[at[found.is_valid().to_numpy(zero_copy_only=False)]])
        word.append(pc.drop_null(found).to_numpy().astype(np.int64))
    token, word = np.concatenate(token), np.concatenate(word)
    order = np.argsort(token, kind="stable")
    token, word = token[order], word[order]
    sizes = np.bincount(token, minlength=len(cores))
    hit = np.flatnonzero(sizes[codes] > 0)
    reps = sizes[codes[hit]]
    inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    column = word[np.repeat((np.cumsum(sizes) - sizes)[codes[hit]], reps) + inner]
    pair = np.unique(np.repeat(owner[hit], reps) * max(1, len(known)) + column)
    changed = np.zeros(len(cores), bool)
    changed[list(read)] = True
    counts = np.bincount(owner[changed[codes]], minlength=len(texts))
    return pair // max(1, len(known)), pair % max(1, len(known)), counts


def _texts_of(*words: str) -> list[str]:
    """What ``_forms`` gives for words, as texts."""
    return [*words, *[w[:k] + "*" for w in words for k in PREFIXES if len(w) > k]]


def _lasso(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, width: int, lasso: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights with an l1 penalty by proximal gradient steps with momentum; weights stay at or above 0."""
    n = len(y)
    w, v, t = np.zeros(width), np.zeros(width), 1.0
    b = vb = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    per_row = np.bincount(rows, minlength=n).max(initial=1)
    # The largest column share times the largest row bounds the curvature.
    share = np.bincount(columns, minlength=width).max(initial=1) / n
    rate = 4.0 / (1 + per_row * share)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(vb + np.bincount(rows, v[columns], n), -30, 30)))
        g = (p - y) / n
        w_new = np.maximum(0.0, v - rate * (np.bincount(columns, g[rows], width) + lasso))
        b_new = vb - rate * g.sum()
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return w, float(b)


def fit(docs: DataFrame, marks: DataFrame, max_rows: int = 20_000, max_words: int = 4_096, unexplained: float = 3.0) -> Model:
    """Learn the characters from all texts of ``docs``, the lexicon from labelled ones.

    ``marks`` has doc_id and toxic (0 or 1; null is no label; an id's labels count as their largest).
    The classifier is fitted on about ``max_rows`` labelled ids chosen by hash: the ``max_words`` words
    and beginnings of words that toxic texts have most significantly more often, then weights by lasso,
    whose penalty is as large as ``unexplained`` toxic texts that nothing else tells. Of rows that repeat
    an id the least text counts. Without labels of both kinds there is no word and the score
    is the share of label 1.
    """
    characters = character_model(docs)
    ids = hash_sample(marks.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", max_rows, 11)
    # About max_rows rows of two numbers at most.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict[str, str] = {}
        for batch in batches:
            marks_of, done = batch.column(0).to_pylist(), 0
            for part in _parts(batch.column(1).to_pylist()):
                owner, codes, cores = _tokens(part)
                cores = cores.to_pylist()
                read = restore_tokens(characters, cores, remembered)
                forms = [_texts_of(cores[c], *read.get(c, "").split()) for c in range(len(cores))]
                found: list[set[str]] = [set() for _ in part]
                for i, c in zip(owner.tolist(), codes.tolist(), strict=True):
                    found[i].update(forms[c])
                yield pa.RecordBatch.from_arrays([pa.array(marks_of[done : done + len(part)], pa.int32()), pa.array([sorted(x) for x in found], pa.list_(pa.string()))], names=["toxic", "words"])
                done += len(part)

    # Read twice, for the totals and the words: bounded by the sample.
    seen = rows.select(F.col("toxic").cast("int"), "text").mapInArrow(words, "toxic int, words array<string>")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Model(characters, [], np.zeros(0), float(np.log((n1 + 1) / (n0 + 1))))
    by_word = seen.select("toxic", F.explode("words").alias("word")).filter("word <> ''").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).filter(F.col("a") >= unexplained)
    a, b = F.col("a"), F.col("b")
    term = lambda k, m: F.when(k > 0, k * F.log(k / m)).otherwise(0.0)
    share = (a + b) / F.lit(float(n1 + n0))
    evidence = term(a, share * n1) + term(b, share * n0) + term(n1 - a, (1 - share) * n1) + term(n0 - b, (1 - share) * n0)
    top = by_word.withColumn("evidence", evidence).filter(a * n0 > b * n1).orderBy(F.desc("evidence"), "word").limit(max_words)
    lexicon = sorted(r["word"] for r in top.select("word").collect())
    known = pa.array(lexicon, pa.string())

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict[str, str] = {}
        for batch in batches:
            names, done = batch.column(0).to_pylist(), 0
            for part in _parts(batch.column(2).to_pylist()):
                of, column, _ = _hits(characters, known, part, remembered)
                lists = np.split(column, np.searchsorted(of, np.arange(1, len(part))))
                yield pa.RecordBatch.from_arrays([pa.array(names[done : done + len(part)], pa.int64()), batch.column(1).slice(done, len(part)).cast(pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "toxic", "hits"])
                done += len(part)

    got = rows.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text").mapInArrow(pairs, "doc_id long, toxic int, hits array<int>").toArrow().sort_by("doc_id")
    lists = got.column("hits").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    of, column = np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    y, penalty = got.column("toxic").to_numpy().astype(float), unexplained / max(1, len(lists))
    w, _ = _lasso(of, column, y, len(lexicon), penalty)
    # The penalty chooses; what it has chosen is weighed anew with little of it, as texts with one hit count too.
    keep = np.flatnonzero(w > 1e-6)
    place = np.full(len(lexicon), -1)
    place[keep] = np.arange(len(keep))
    inside = place[column] >= 0
    w, bias = _lasso(of[inside], place[column[inside]], y, len(keep), penalty / 50, steps=1_500)
    return Model(characters, [lexicon[i] for i in keep], w, bias)


def predict(text: Column, model: Model) -> Column:
    """struct(score, restored) of each whole text: the probability of label 1, and how many words were restored.

    The score adds the weights of the lexicon's words in the text, met as they stand or as restored,
    each once. Null texts count as empty ones and get the score of the bias. Equal texts are scored
    alike.
    """
    known = pa.array(model.words, pa.string())

    @F.pandas_udf("score double, restored long")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        remembered: dict[str, str] = {}
        for batch in batches:
            scores, counts = [], []
            for part in _parts(batch.tolist()):
                of, column, changed = _hits(model.characters, known, part, remembered)
                margin = model.bias + np.bincount(of, model.weights[column], len(part)) if len(of) else np.full(len(part), model.bias)
                scores += (1 / (1 + np.exp(-margin))).tolist()
                counts += changed.tolist()
            yield pd.DataFrame({"score": pd.Series(scores, dtype=float), "restored": pd.Series(counts, dtype="int64")})

    return predicted(text)


def classify(docs: DataFrame, marks: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted and restored of each row of ``docs`` (doc_id, text; other columns are ignored).

    Learns from the labels of ``marks`` alone, whose rows the caller chooses; ids, languages and
    sources are never inputs of a score. Repeated rows count each; an empty table gives no rows. A
    token of any length is read whole, in pieces of ``PLACES`` places.
    """
    model = fit(docs, marks)
    found = docs.select("doc_id", predict(F.col("text"), model).alias("found"))
    scored = found.select("doc_id", "found.score", "found.restored")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
