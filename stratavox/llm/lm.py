"""LM scoring by online logistic context mixing, and a smoothed unigram base score."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, materialise_parts, most_frequent, remove, small_batches

#: Slots (as powers of two) of the predictors: order 0 to 4 bytes of the word, and its whole beginning.
SLOT_BITS = (8, 16, 18, 20, 20, 20)
N_SLOTS = sum(1 << b for b in SLOT_BITS)
STARTS = np.cumsum([0, *[1 << b for b in SLOT_BITS]])[:-1]
#: Mixing weights are chosen by the bit's place in its byte and the byte's place in its word.
PLACES = 6
N_INPUTS = len(SLOT_BITS) + 1
#: Adaptive probability map: by the bits of the byte so far, over stretched probabilities.
STEPS, SPAN = 24, 12.0
#: Most frequent words whose counts go to all tasks; the counts of all others are joined.
COMMON = 1 << 17
#: Table blocks of this many slots move between tasks.
BLOCK = 1 << 14
#: Tasks that count and learn over the word table, each with one table in memory.
MAX_PARTS = 256
#: Words end with a space, texts with a line feed; neither occurs in a word.
WORD_END = 0x20
ALL = (1 << 64) - 1
#: Texts of a part at most, so that a text has a 16-bit number in its part.
PART_TEXTS = 1 << 16
#: Bytes of texts that are worked on at once, and words whose bits are: a word takes some two thousand bytes meanwhile.
PART_BYTES, BIT_WORDS = 4_000_000, 4_000
#: Tokens that share one bucket of word pairs, in the mean.
BUCKET_TOKENS = 1 << 20
#: Passes over the buckets, and over the parts of the texts, in which the counts of pairs travel.
PASSES = 3
#: Weight of a token's own probability against the counts of what followed the word before it.
STRENGTH = 40.0
#: Costs of tokens travel in this fraction of a bit.
COST_STEPS = 256


def tokenised(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of the word at each place, and the text of each place; A to Z lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[full]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), owner


def _parts(batches: Iterable[pa.RecordBatch], most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in runs whose texts have about ``most`` bytes: small batches are put together, large ones cut."""
    held, n, used = [], 0, 0
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = int(np.searchsorted(size, base + most - used, "right"))
            end = min(end if n else max(start + 1, end), start + PART_TEXTS - n)
            if end > start:
                held.append(batch.slice(start, end - start))
                n, used, start = n + end - start, used + size[end - 1] - base, end
            if start < batch.num_rows:
                yield pa.concat_batches(held)
                held, n, used = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def _stream(part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words and last the empty one, the number of each token with one end a text, and the token before it.

    Before the first token of a text stands the empty word, as after its last.
    """
    words, codes, owner = tokenised(part.column("text"))
    stream = np.full(len(codes) + part.num_rows, len(words), np.int64)
    stream[np.arange(len(codes)) + owner] = codes
    return pa.concat_arrays([words.cast(pa.string()), pa.array([""])]), stream, np.concatenate([[len(words)], stream[:-1]])


def _pair_keys(prev: np.ndarray, after: np.ndarray) -> np.ndarray:
    return _hash(_hash(prev.view(np.uint64)) + after.view(np.uint64))


def _keys(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, object), categorize=False).view(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the tokens over all texts of ``docs``; the end of a text is the empty word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            words, codes, _ = tokenised(part.column("text"))
            n = np.append(np.bincount(codes, minlength=len(words)), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.cast(pa.string()), pa.array([""])]), pa.array(n.astype(np.int64))], names=["word", "n"])

    plain = docs.select(F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers below 2^32 as compressed byte planes."""
    planes = [np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpack(data: bytes, *sizes: int) -> list[np.ndarray]:
    """The arrays of ``sizes`` that ``_pack`` was given."""
    flat = np.frombuffer(pa.decompress(data, decompressed_size=4 * sum(sizes), codec="zstd", asbytes=True), np.uint8)
    ends = 4 * np.cumsum(sizes)
    return [np.ascontiguousarray(flat[e - 4 * n : e].reshape(4, n).T).view("<u4").reshape(-1) for e, n in zip(ends, sizes)]


def _pair_totals(blocks: DataFrame) -> DataFrame:
    """part, bucket, size, data: how often each pair of an asked part stands in all learnt texts.

    ``blocks`` has a row per part and bucket: the pairs' keys, and their occurrences in the part's
    learnt texts. A bucket holds ``BUCKET_TOKENS`` tokens in the mean and a pair once for each
    part, so frequent pairs and copies make no group large.
    """

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(bytes(d), n, n) for d, n in zip(rows["data"], rows["size"])]
        _, place = np.unique(np.concatenate([np.cumsum(gaps, dtype=np.uint32) for gaps, _ in parts]), return_inverse=True)
        totals = np.bincount(place, np.concatenate([own for _, own in parts]))
        ends = np.cumsum(rows["size"].to_numpy())
        found = [_pack(np.minimum(totals[place[e - n : e]], (1 << 32) - 1)) for e, n in zip(ends, rows["size"])]
        return pd.DataFrame({"part": rows["part"], "bucket": rows["bucket"], "size": rows["size"], "data": found})[rows["asked"].to_numpy(bool)]

    return blocks.groupBy("bucket").applyInPandas(total, "part long, bucket int, size int, data binary")


def _pair_gains(states: DataFrame, totals: DataFrame) -> DataFrame:
    """row, pair_gain: the bits that the pairs of a text save. A group is one part: its state and its pairs' totals."""

    def gain(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        own, found = rows.iloc[0], rows.iloc[1:]
        n = np.concatenate([_unpack(bytes(d), k)[0] for d, k in zip(found["data"], found["size"])]).astype(float)
        cost, uses, texts = _unpack(bytes(own["data"]), own["size"], own["size"], own["items"])
        with np.errstate(divide="ignore"):
            saved = np.logaddexp2(0, np.log2(n / STRENGTH) + cost / COST_STEPS)
        sums = np.bincount(texts, np.repeat(saved, uses))
        at = np.flatnonzero(sums)
        return pd.DataFrame({"row": key[0] * PART_TEXTS + at, "pair_gain": sums[at]})

    rows = states.unionByName(totals.withColumn("items", F.lit(0)))
    return rows.groupBy("part").applyInPandas(gain, "row long, pair_gain double")


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Bits:
    """The bytes of words, each word with its end, as bits in their contexts."""

    def __init__(self, words: list[str]):
        data = [w.encode() + b" " if w else b"\n" for w in words]
        self.byte = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        self.word = np.repeat(np.arange(len(data)), sizes)
        at = np.arange(len(self.byte)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.place = np.minimum(at, PLACES - 1)
        u = self.byte.astype(np.uint64)
        # The k-th byte before, or a word end where the word has not as many.
        before = [np.where(at >= k, np.concatenate([np.zeros(k, np.uint64), u[:-k]])[: len(u)], np.uint64(WORD_END)) for k in (1, 2, 3, 4)]
        weights = _hash(np.arange(1, int(sizes.max(initial=1)) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((u + np.uint64(1)) * weights[at], dtype=np.uint64)])
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        prefix = running[:-1] - running[begin]
        packed = [before[0]]
        for b in before[1:]:
            packed.append(packed[-1] << np.uint64(8) | b)
        self.context = [None, before[0], *[_hash(c + np.uint64(k * 0x632BE59BD9B4E019 & ALL)) for k, c in enumerate([packed[1], packed[2], packed[3], prefix], 2)]]

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Place in the byte, bits so far, the bit, and the slot in each predictor."""
        node = np.ones(len(self.byte), np.int64)
        for k in range(8):
            bit = (self.byte >> (7 - k)) & 1
            u = node.astype(np.uint64)
            slots = [node + STARTS[0], ((self.context[1] << np.uint64(8)) | u).astype(np.int64) + STARTS[1]]
            for c in range(2, len(SLOT_BITS)):
                h = (self.context[c] + u * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                slots.append((h >> np.uint64(64 - SLOT_BITS[c])).astype(np.int64) + STARTS[c])
            yield k, node, bit, slots
            node = node * 2 + bit


def _stretch(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds of a one, 0 where a context was never met."""
    return np.log((np.maximum(ones, 0) + 0.3) / (np.maximum(zeros, 0) + 0.3)).astype(np.float32)


def _place(z: np.ndarray) -> np.ndarray:
    return np.clip(((z + SPAN) * (STEPS - 1) / (2 * SPAN)).round().astype(np.int64), 0, STEPS - 1)


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def count_bits(words: list[str], n: np.ndarray, table: np.ndarray) -> None:
    """Add the bits of words that occur ``n`` times to ``table`` (2 by N_SLOTS)."""
    bits = Bits(words)
    weight = n[bits.word].astype(np.float32)
    for _, _, bit, slots in bits:
        for s in slots:
            np.add.at(table.reshape(-1), bit * N_SLOTS + s, weight)


@dataclass
class Mixer:
    """weights: [bit][place][input]; refined: the map's probabilities, [bits so far][step], and their weight."""

    weights: np.ndarray
    refined: np.ndarray
    seen: np.ndarray

    @classmethod
    def fresh(cls) -> Mixer:
        weights = np.full((8, PLACES, N_INPUTS), 0.3)
        weights[:, :, -1] = 0.0
        centre = np.linspace(-SPAN, SPAN, STEPS)
        return cls(weights, np.tile(_squash(centre), (256, 1)), np.full((256, STEPS), 4.0))

    def _inputs(self, table: np.ndarray, slots: list[np.ndarray], bit: np.ndarray | None) -> np.ndarray:
        """Stretched predictions of all contexts, and a constant. With ``bit``, as if it had been met once less."""
        x = np.empty((N_INPUTS, len(slots[0])), np.float32)
        for i, s in enumerate(slots):
            if bit is None:
                x[i] = table[s]
            else:
                x[i] = _stretch(table[0][s] - (bit == 0), table[1][s] - (bit == 1))
        x[-1] = 0.3
        return x

    def learn(self, words: list[str], n: np.ndarray, counts: np.ndarray, rate: float) -> None:
        """One online step: predict each bit without this occurrence of it, then move weights and map."""
        bits = Bits(words)
        weight = (n[bits.word].astype(float)) ** 0.75
        for k, node, bit, slots in bits:
            x = self._inputs(counts, slots, bit)
            w = self.weights[k][bits.place]
            z = np.einsum("ij,ji->j", x, w)
            error = (bit - _squash(z)) * weight
            mass = np.bincount(bits.place, weight, PLACES) + 1e-9
            for i in range(N_INPUTS):
                self.weights[k, :, i] += rate * np.bincount(bits.place, error * x[i], PLACES) / mass
            at = node * STEPS + _place(z)
            self.seen += np.bincount(at, weight, 256 * STEPS).reshape(256, STEPS)
            self.refined += (np.bincount(at, weight * (bit - self.refined.reshape(-1)[at]), 256 * STEPS)).reshape(256, STEPS) / self.seen

    def bits_of(self, words: list[str], stretched: np.ndarray) -> np.ndarray:
        """Bits that each word with its end takes, ``BIT_WORDS`` at a time."""
        return np.concatenate([np.zeros(0), *[self._bits_of(words[i : i + BIT_WORDS], stretched) for i in range(0, len(words), BIT_WORDS)]])

    def _bits_of(self, words: list[str], stretched: np.ndarray) -> np.ndarray:
        bits = Bits(words)
        total = np.zeros(len(bits.byte))
        flat = self.refined.reshape(-1)
        for k, node, bit, slots in bits:
            z = np.zeros(len(node), np.float32)
            w = self.weights[k].astype(np.float32)
            for i, s in enumerate(slots):
                z += stretched[s] * w[bits.place, i]
            z += np.float32(0.3) * w[bits.place, -1]
            p = 0.5 * (_squash(z) + flat[node * STEPS + _place(z)])
            p = np.clip(np.where(bit == 1, p, 1 - p), 1e-9, 1.0)
            total -= np.log2(p)
        return np.bincount(bits.word, total, len(words))


def gather_counts(words: DataFrame) -> np.ndarray:
    """The predictors' counts over the whole word table, 2 by N_SLOTS.

    At most ``MAX_PARTS`` tasks fill one table each; their blocks are summed by block number, and
    the sum, of fixed size, comes to the driver.
    """
    schema = "block int, data binary"

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((2, N_SLOTS), np.float32)
        for batch in batches:
            for i in range(0, len(batch), BIT_WORDS):
                part = batch.iloc[i : i + BIT_WORDS]
                count_bits(part["word"].tolist(), part["n"].to_numpy(), table)
        flat = table.reshape(-1)
        for b in range(-(-len(flat) // BLOCK)):
            own = flat[b * BLOCK : (b + 1) * BLOCK]
            if own.any():
                yield pd.DataFrame({"block": [b], "data": [own.tobytes()]})

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(d, np.float32).astype(np.float64) for d in rows["data"])
        return pd.DataFrame({"block": [key[0]], "data": [total.astype(np.float32).tobytes()]})

    table = np.zeros(2 * N_SLOTS, np.float32)
    for b, data in words.coalesce(MAX_PARTS).mapInPandas(fill, schema).groupBy("block").applyInPandas(merge, schema).toLocalIterator():
        own = np.frombuffer(bytes(data), np.float32)
        table[b * BLOCK : b * BLOCK + len(own)] = own
    return table.reshape(2, N_SLOTS)


def learn_mixer(words: DataFrame, counts: np.ndarray, step: int = 1_000) -> Mixer:
    """Weights and map learnt online over the whole word table by each of at most ``MAX_PARTS`` tasks, then averaged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixer, done = Mixer.fresh(), 0
        for batch in batches:
            # The table is sorted by nothing in particular; a fixed shuffle makes steps alike.
            batch = batch.sample(frac=1.0, random_state=1)
            for i in range(0, len(batch), step):
                part = batch.iloc[i : i + step]
                mixer.learn(part["word"].tolist(), part["n"].to_numpy(), counts, max(0.02, 0.5 / (1 + done / 40)))
                done += 1
        if done:
            yield pd.DataFrame({"n": [done], "weights": [mixer.weights.tobytes()], "refined": [mixer.refined.tobytes()], "seen": [mixer.seen.tobytes()]})

    rows = words.coalesce(MAX_PARTS).mapInPandas(run, "n long, weights binary, refined binary, seen binary").collect()
    mixer = Mixer.fresh()
    if not rows:
        return mixer
    read = lambda r, k, like: np.frombuffer(bytes(r[k]), np.float64).reshape(like.shape)
    n = sum(r["n"] for r in rows)
    mixer.weights = sum(read(r, "weights", mixer.weights) * r["n"] for r in rows) / n
    seen = sum(read(r, "seen", mixer.seen) for r in rows)
    mixer.refined = sum(read(r, "refined", mixer.seen) * read(r, "seen", mixer.seen) for r in rows) / seen
    mixer.seen = seen
    return mixer


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Scores of ``docs`` by a model of the texts of ``training``; see ``score_marked``."""
    plain = lambda df, asked: df.select("doc_id", "text", F.lit(asked).alias("asked"))
    rows = plain(docs, True).unionByName(plain(training, False))
    return score_marked(rows, learnt=~F.col("asked"), asked=F.col("asked"))


def score_marked(docs: DataFrame, learnt: Column, asked: Column) -> DataFrame:
    """Per row of ``docs`` that is ``asked``: doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the ``learnt`` rows: every word of every text counts. Tokens are lower-cased
    words and one end per text. Base: add-one smoothed unigrams. Model: the bits of each token's
    bytes, predicted by contexts of 0 to 4 bytes and of the word so far in hashed tables; the
    stretched predictions are mixed by weights that the bit's place chooses, both learnt online
    (predict, then update, each bit predicted without its own occurrence), and refined by an
    adaptive probability map. That probability q of a token is mixed with the counts of the running
    text: after a word met n times a token has the probability (n(word, token) + s q) / (n + s),
    s being ``STRENGTH``. While scoring nothing moves, so a score depends on its text
    alone and the bits of each distinct word of a batch are coded once. ``score`` is the log10
    probability of the tokens.

    The bit tables, weights and map have fixed sizes; the ``COMMON`` most frequent words go to all
    tasks, and the counts of others are joined to the rare words of each text. Pairs of words are
    hashed contexts whose counts grow with the texts: each part of the texts sends its distinct pairs to buckets,
    more of them the more tokens there are, so that the share of pairs under a key of their own stays the same, and gets back
    their counts. Null texts count as empty ones: one token, the end. Repeated rows count each;
    extra columns are ignored; with no learnt rows all counts are 0.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learnt, F.lit(False)).alias("learnt"), F.coalesce(asked, F.lit(False)).alias("asked"))
    with small_batches(docs.sparkSession):
        words = materialise(word_counts(plain.filter("learnt")), "word_counts")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The end of a text is always among them, as the rare words are those that stand in the text.
    ends = words.filter(F.col("word") == "")
    top = ends.unionByName(most_frequent(words.filter(F.col("word") != ""), "n", COMMON - 1)).toPandas()
    counts = gather_counts(words)
    mixer = learn_mixer(words, counts)
    stretched = _stretch(counts[0], counts[1]).astype(np.float16)
    costs = mixer.bits_of(top["word"].tolist(), stretched.astype(np.float32))
    common = pa.array(top["word"].tolist(), pa.string())
    logs = np.log10(top["n"].to_numpy(float) + 1)
    gates = np.log2(top["n"].to_numpy(float) / STRENGTH + 1)
    offset = float(np.log10(total + distinct + 1))
    bucket_bits = max(1, int(total // BUCKET_TOKENS).bit_length())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = stretched.astype(np.float32)
        number = TaskContext.get().partitionId() << 24
        for part in _parts(batches):
            yield from one(part, table, number)
            number += 1

    def one(part: pa.RecordBatch, table: np.ndarray, number: int) -> Iterator[pa.RecordBatch]:
        n = part.num_rows
        asked = part.column("asked").to_numpy(zero_copy_only=False)
        all_words, stream, prev = _stream(part)
        m = len(all_words)
        is_end = stream == m - 1
        text = np.cumsum(is_end) - is_end
        own_pairs = pairs_of(part, all_words, stream, prev, text)
        if not asked.any():
            yield from own_pairs(None)
            return
        at = pc.index_in(all_words, value_set=common)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        place = at.fill_null(0).to_numpy()
        cost = costs[place] if len(costs) else np.zeros(m)
        new = np.flatnonzero(~known)
        cost[new] = mixer.bits_of(all_words.take(pa.array(new)).to_pylist(), table)
        own = lambda values: np.where(known, values[place] if len(values) else 0.0, 0.0)
        bits = np.bincount(text, (cost + own(gates))[stream], n)
        n_bytes = np.bincount(text, (pc.binary_length(all_words).to_numpy() + 1)[stream], n)
        n_common, sums = np.bincount(text, known[stream], n), np.bincount(text, own(logs)[stream], n)
        # Rare words by text, each once with its number of occurrences.
        rare = ~known[stream] & asked[text]
        key, times = np.unique(text[rare] * np.int64(m) + stream[rare], return_counts=True)
        items = pa.StructArray.from_arrays([all_words.take(pa.array(key % m)), pa.array(times.astype(np.int32))], names=["word", "times"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(key // m, np.arange(n + 1)).astype(np.int32)), items)
        long = lambda values: pa.array(np.asarray(values).astype(np.int64))
        columns = [part.column("doc_id"), long(np.bincount(text, minlength=n)), long(n_common), pa.array(sums), pa.array(bits), long(n_bytes), lists, long(number * PART_TEXTS + np.arange(n))]
        found = pa.RecordBatch.from_arrays(columns, names=schema_names[:8]).filter(pa.array(asked))
        yield padded(found, schema_names[8:])
        yield from own_pairs(cost, number)

    def pairs_of(part: pa.RecordBatch, all_words: pa.Array, stream: np.ndarray, prev: np.ndarray, text: np.ndarray):
        """The part's distinct pairs by bucket and, with the costs of words, what their counts will be put together with."""
        asked, learnt = (part.column(c).to_numpy(zero_copy_only=False) for c in ("asked", "learnt"))

        def blocks(cost: np.ndarray | None, number: int = -1) -> Iterator[pa.RecordBatch]:
            pair, of = np.unique(prev * len(all_words) + stream, return_inverse=True)
            word_keys = _keys(all_words.to_pylist())
            after = pair % len(all_words)
            keys = _pair_keys(word_keys[pair // len(all_words)], word_keys[after])
            order = np.argsort(keys)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            of, keys, after = rank[of], keys[order], after[order]
            own = np.bincount(of, learnt[text], len(keys))
            bucket = (keys >> np.uint64(64 - bucket_bits)).astype(np.int64)
            low = ((keys << np.uint64(bucket_bits)) >> np.uint64(32)).astype(np.uint32)
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            edges = np.append(starts, len(keys))
            data = [_pack(np.diff(low[a:b], prepend=np.uint32(0)), own[a:b]) for a, b in zip(edges, edges[1:])]
            out = {"part": [number] * len(data), "bucket": bucket[starts], "size": np.diff(edges), "items": [0] * len(data), "asked": [cost is not None] * len(data), "data": data}
            if cost is not None:
                seen = asked[text]
                place = np.argsort(of[seen], kind="stable")
                state = _pack(np.rint(cost[after] * COST_STEPS), np.bincount(of[seen], minlength=len(keys)), text[seen][place])
                last = {"part": number, "bucket": -1, "size": len(keys), "items": int(seen.sum()), "asked": True, "data": state}
                out = {c: [*v, last[c]] for c, v in out.items()}
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            found = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))
            yield padded(found, schema_names[:8])

        return blocks

    def padded(batch: pa.RecordBatch, others: list[str]) -> pa.RecordBatch:
        nulls = {c: pa.nulls(batch.num_rows, arrow_schema[c]) for c in others}
        return pa.RecordBatch.from_arrays([batch.column(c) if c not in nulls else nulls[c] for c in schema_names], names=schema_names)

    schema = "doc_id long, n_tokens long, n_common long, sums double, bits double, n_bytes long, rare array<struct<word:string,times:int>>, row long, part long, bucket int, size int, items int, asked boolean, data binary"
    arrow_schema = {c.split()[0]: {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}.get(c.split()[1]) for c in schema.replace("<word:string,times:int>", "").split(", ")}
    arrow_schema["rare"] = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int32())]))
    schema_names = list(arrow_schema)
    with small_batches(docs.sparkSession):
        stored = materialise(plain.mapInArrow(rows, schema), "scored")
    found = stored.filter(F.col("row").isNotNull()).select(*schema_names[:8])
    blocks = stored.filter(F.col("bucket") >= 0).select("part", "bucket", "size", "asked", "data")
    states = stored.filter(F.col("bucket") < 0).select("part", "bucket", "size", "items", "data")
    in_pass = lambda rows, column, k: rows.filter(F.pmod(F.xxhash64(column), F.lit(PASSES)) == k)
    totals = materialise_parts(lambda k: _pair_totals(in_pass(blocks, "bucket", k)), PASSES, "pair_totals")
    gains = materialise_parts(lambda k: _pair_gains(in_pass(states, "part", k), in_pass(totals, "part", k)), PASSES, "pair_gains")
    remove(docs.sparkSession, totals)
    rare = found.select("row", F.inline("rare")).join(words, "word").groupBy("row")
    opened = F.col("times") * F.log2(F.col("n") / F.lit(STRENGTH) + 1)
    rare = rare.agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_sums"), F.sum(opened).alias("rare_gates"))
    out = found.drop("rare").join(rare, "row", "left").join(gains, "row", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    bits = F.col("bits") + none("rare_gates") - none("pair_gain")
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_common") + none("rare_known")).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("sums") + none("rare_sums") - F.col("n_tokens") * F.lit(offset)).alias("base_score"),
        (bits * F.lit(-float(np.log10(2)))).alias("score"),
        (bits / F.col("n_bytes")).alias("bits_per_byte"),
    )
