import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from stratavox.llm import common, fingerprints, jaccard, langid, lm, mixing, quality_model, quality_rules, secrets, sp_codec, token_counts

from . import corpus

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.frame(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return corpus.frame(spark, [])


@pytest.fixture(scope="module")
def data():
    return corpus.rows()


def marks(spark):
    return spark.createDataFrame([(i, 1 if i < 20 else 0, 0) for i in range(40)] + [(41, None, 0)], "doc_id long, quality int, toxic int")


# Secrets


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_base_spans(spark, docs, data):
    more = ["password=token: abcdefghij SECRET : 'AbCdEf12'", "𝒳é AKIAABCDEFGH1234 AKIA12 AKIAAKIA1234567890", "deadbeef" * 5 + " x " + "deadbeef" * 3, "api_key==abcdefgh apikey='a.b-c_d+e/f='"]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(more, 900)), "doc_id long, text string"))
    for r in rows.join(secrets.scan(rows.dropDuplicates(["doc_id"])), "doc_id").collect():
        want = base_spans(r["text"])
        assert [tuple(x) for x in r["base_spans"]] == want
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[1] == k for x in want) for k in range(3))
        assert [tuple(x) for x in r["spans"] if x["kind"] < 3] == want


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secret = ["see " + "".join(rng.choice(alphabet) for _ in range(40)) + " here" for _ in range(20)]
    plain = ["thisIsAVeryLongIdentifierNameOfVersion2 some-long-name-of-a-thing-2024 aaaaaaaaaaaaaaaaaaaaaaaaaaaa1 releases/2024/summer/overview1", "20240101202401012024 internationalisation1"] * 20
    got = secrets.scan(spark.createDataFrame(list(enumerate(secret + plain)), "doc_id long, text string")).collect()
    found = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in got}
    assert sum(found[i] == [(4, 3, 44)] for i in range(20)) >= 19
    assert not any(found[i] for i in range(20, 60))


def test_runs_of_one_case_and_mixed_runs_are_tested(spark):
    rng = random.Random(4)
    draw = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    lower, upper = secrets.LOWER, secrets.UPPER
    both = lower + upper + secrets.DIGITS
    paths = ["a-long-path/" + draw(both, 40) for _ in range(20)]
    letters = ["key " + draw(a, 300) for a in (lower, upper) for _ in range(10)]
    plain = ["internationalisation telecommunications state-of-the-art-things ---------------- and/or-either/or-neither 1234567890123456"] * 20
    got = secrets.scan(spark.createDataFrame(list(enumerate(paths + letters + plain)), "doc_id long, text string")).collect()
    found = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in got}
    assert sum(found[i] == [(12, 3, 52)] for i in range(20)) >= 19
    assert sum(found[i] == [(4, 3, 304)] for i in range(20, 40)) >= 19
    assert not any(found[i] for i in range(40, 60))
    tested = spark.createDataFrame([("abcdefghijklmnop ABCDEFGHIJKLMNOP 1234567890123456 ab+cd-efghijklmn/op",)], "text string")
    names = tested.select(F.transform(secrets._found(F.col("text"))["tokens"], lambda x: x["encoding"]).alias("x")).first()["x"]
    assert names == ["lower", "upper", "base36", "mixed"]


def test_secret_edges(spark, docs, empty):
    assert secrets.scan(docs).count() == docs.count() and secrets.scan(empty).isEmpty()
    masked = secrets.mask(docs, F.col("text"), "masked").filter("doc_id = 110").first()["masked"]
    assert masked == '[SECRET]"'
    assert secrets.mask(empty, F.col("text"), "masked").isEmpty()
    r = spark.range(1).select(secrets.redact(F.lit("abcdefgh"), F.expr("array(struct(1 as start, 0 as kind, 4 as end), struct(2 as start, 1 as kind, 5 as end))")).alias("x")).first()
    assert r["x"] == "a[SECRET]fgh"


# Quality classifier


def test_rules_separate_and_hold_out(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randint(0, 99)) for _ in range(80)]
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learnt = spark.createDataFrame(labels, "doc_id long, quality int").filter(common.id_remainder(3) != 1)
    got = {r["doc_id"]: r for r in quality_model.classify(docs, learnt).collect()}
    assert all(got[i]["predicted"] == q for i, q in labels)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_classifier_edges(spark, docs, empty):
    got = quality_model.classify(docs, marks(spark))
    assert got.count() == docs.count() and got.filter("score is null").isEmpty()
    assert quality_model.classify(empty, marks(spark)).isEmpty()
    assert quality_model.classify(docs, marks(spark).limit(0)).select("score").distinct().count() == 1


def test_rule_columns_say_what_the_trees_said(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.random((400, len(quality_model.STATISTICS)))
    y = ((x[:, 5] > 0.7) & (x[:, 0] > 0.2)).astype(float)
    model = quality_model.fit_ensemble(x, y)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], list(quality_model.STATISTICS))
    got = [r[0] for r in df.select(model.score()).collect()]
    z = np.full(len(x), model.bias)
    for r in model.rules:
        ok = np.ones(len(x), bool)
        for name, at_most, t in r.tests:
            v = x[:, quality_model.STATISTICS.index(name)]
            ok &= (v <= t) if at_most else (v > t)
        z += ok * r.weight
    assert np.allclose(got, 1 / (1 + np.exp(-z)))
    assert ((np.array(got) >= 0.5) == (y == 1)).mean() > 0.97


# Fingerprints


def test_edited_texts(docs, data):
    seen = {}
    for r in sorted(data, key=lambda r: (-r[0], r[1] or "")):
        seen.setdefault(r[0], []).append(r[1] or "")
    order = [t for i in sorted(seen, reverse=True) for t in seen[i]]
    want = Counter()
    for k, t in enumerate(order):
        half = len(t) // 2
        want[len(t), hashlib.sha256((t[: len(t) - half] + order[(k + 1) % len(order)][:half]).encode()).hexdigest()] += 1
    got = fingerprints.edited_pairs(docs).collect()
    assert Counter((r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    texts = {r[0]: r[1] or "" for r in data}
    prints = defaultdict(set)
    for r in got:
        prints[texts[r["doc_id"]]].add(tuple(r["fingerprint"]))
    assert all(len(p) == 1 for p in prints.values())


def test_buckets_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_A_BUCKET", 3)
    rows = [(i * i * (-1) ** i, f"text {i}. more {i}") for i in range(50)] + [(None, "none"), (10**15, "far")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [t for _, t in sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -(1 << 63)))]
    want = {hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() for t, n in zip(order, order[1:] + order[:1])}
    assert {r["edited_sha256"] for r in fingerprints.edited_pairs(df).collect()} == want


def test_fingerprints_add_up(spark):
    r = spark.createDataFrame([("a b. c.\nd e.\n\nf", "f\nd e.", "a b. c.")], "x string, y string, z string")
    p = {c: fingerprints.fingerprint(F.col(c)) for c in "xyz"}
    got = r.select((fingerprints.insert(p["y"], p["z"]) == p["x"]).alias("i"), (fingerprints.delete(p["x"], p["z"]) == p["y"]).alias("d"), fingerprints.likeness(p["y"], p["z"]).alias("l")).first()
    assert got["i"] and got["d"] and got["l"] < 0.5


def test_fingerprint_edges(spark, empty):
    assert fingerprints.edited_pairs(empty).isEmpty()
    lone = fingerprints.edited_pairs(spark.createDataFrame([(7, "ab")], "doc_id long, text string")).first()
    assert lone["near_next"] == 1 and lone["edited_sha256"] == hashlib.sha256(b"aa").hexdigest()


# Quality rules


def statistics(text):
    w, text = corpus.words(text), text or ""
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if corpus.words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_heuristics(spark, docs, data):
    got = quality_rules.apply_rules(docs, spark.createDataFrame([(1,), (3,)], "doc_id long"))
    texts = {r[0]: r[1] for r in data}
    assert got.count() == len(data)
    for r in got.collect():
        want = statistics(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["kept"] is False or not r["base_failed"]


def test_ratio_tells_target_from_junk(spark):
    rng = random.Random(6)
    good = [" ".join(rng.choice(["the", "house", "stands", "by", "river", "and", "trees"]) + str(rng.randint(0, 1)) for _ in range(60)) for _ in range(80)]
    junk = [" ".join(w + "%%%" for w in g.split()) for g in good[:20]]
    df = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(df, spark.range(0, 40).select(F.col("id").alias("doc_id"))).collect()}
    assert all(got[i] for i in range(80)) and not any(got[i] for i in range(80, 100))


def test_scores_by_brute_force(spark, docs, data, monkeypatch):
    """Counts of hashed n-grams and mean log ratios, whether the trusted ids are broadcast or joined."""
    trusted = docs.filter("doc_id % 2 = 1").select("doc_id")
    got = {(r["doc_id"], r["n_words"], round(r["score"], 4)) for r in quality_rules.apply_rules(docs, trusted).collect()}
    vocab = sorted({w for r in data for w in corpus.words(r[1])})
    frame = spark.createDataFrame([(w,) for w in vocab], "w string").select("w", F.xxhash64("w").alias("h"))
    h = {r["w"]: r["h"] for r in frame.collect()}
    pairs = sorted({(h[a], h[b]) for r in data for a, b in zip(corpus.words(r[1]), corpus.words(r[1])[1:], strict=False)})
    pair = {(r["a"], r["b"]): r["p"] for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("p")).collect()}
    grams = lambda t: [h[w] % quality_rules.BUCKETS for w in corpus.words(t)] + [pair[h[a], h[b]] % quality_rules.BUCKETS for a, b in zip(corpus.words(t), corpus.words(t)[1:], strict=False)]
    raw, target = Counter(), Counter()
    for r in data:
        raw.update(grams(r[1]))
        target.update(grams(r[1]) if r[0] % 2 else [])
    n, m = sum(raw.values()), sum(target.values())
    ratio = {b: math.log((target[b] / (raw[b] / n) + quality_rules.PRIOR) / (m + quality_rules.PRIOR)) for b in raw}
    score = lambda t: sum(ratio[g] for g in grams(t)) / len(grams(t)) if grams(t) else 0.0
    want = {(r[0], len(corpus.words(r[1])), score(r[1])) for r in data}
    assert all(any(a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-4 for b in got) for a in want) and len(got) == len({(a, b, round(c, 4)) for a, b, c in want})
    monkeypatch.setattr(quality_rules, "MOST_BROADCAST", 0)
    assert {(r["doc_id"], r["n_words"], round(r["score"], 4)) for r in quality_rules.apply_rules(docs, trusted).collect()} == got


def test_quality_rules_on_nothing(spark, empty):
    assert quality_rules.apply_rules(empty, spark.createDataFrame([], "doc_id long")).isEmpty()


# Tokens


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_and_cache(spark, docs, data, processor, tmp_path):
    cache = f"file://{tmp_path}/cache"
    want = Counter((r[0], len((r[1] or "").encode()), len(processor.encode(r[1] or ""))) for r in data)
    for _ in range(2):
        got = token_counts.count_tokens(docs, MODEL, cache)
        assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens").collect()) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({r[1] or "" for r in data})
    more = corpus.frame(spark, [(1, "quite new", *[None] * 8)])
    assert token_counts.count_tokens(more, MODEL, cache).first()["n_tokens"] == len(processor.encode("quite new"))
    assert spark.read.parquet(cache).count() == len({r[1] or '' for r in data}) + 1


def test_counts_with_the_other_library(spark, docs, data, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    want = {r[0]: len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in data}
    got = token_counts.count_tokens(docs, path, f"file://{tmp_path}/c").collect()
    assert all(r["n_tokens"] == want[r["doc_id"]] for r in got)


def test_null_and_repeated_ids_meet_their_own_misses(spark, processor, tmp_path):
    rows = [(None, f"text number {i}") for i in range(60)] + [(7, "one"), (7, "two words"), (7, "one"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, len((t or "").encode()), len(processor.encode(t or ""))) for i, t in rows)
    got = token_counts.count_tokens(df, MODEL, f"file://{tmp_path}/a")
    assert Counter(map(tuple, got.collect())) == want
    assert spark.read.parquet(f"file://{tmp_path}/a").count() == len({t or "" for _, t in rows})
    assert Counter(map(tuple, token_counts.count_in_batches(df, MODEL, f"file://{tmp_path}/b", 3).collect())) == want


def test_later_batches_hit_the_cache(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"text {i % 5}") for i in range(40)], "doc_id long, text string")
    seen = []
    one = token_counts.count_tokens
    monkeypatch.setattr(token_counts, "count_tokens", lambda d, m, c: (out := one(d, m, c), seen.append(spark.read.parquet(c).count()))[0])
    assert token_counts.count_in_batches(df, MODEL, f"file://{tmp_path}/c").count() == 40
    assert seen == [5, 5]


def test_no_documents_to_count(empty, tmp_path):
    assert token_counts.count_tokens(empty, MODEL, f"file://{tmp_path}/c").isEmpty()


def odd_texts():
    rng = random.Random(7)
    p = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = [p.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    out = ["", " ", "  a", "a  b ", "▁x", "a\0b", "<s></s><unk><0x41>", "\n\n a\tb", "é漢𝒳", "a" * 3000, " " * 100, "=-" * 50]
    out += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    out += ["".join(rng.choice("aeionstr  ▁") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    out += ["".join(rng.choice(["in", "ing", "the", "an", "t", "ion", "er"]) for _ in range(rng.randint(1, 40))) for _ in range(800)]
    return out


def test_encoding_equals_the_library(processor):
    e = sp_codec.Encoder(sp_codec.model_bytes(MODEL))
    rows = odd_texts()
    got = e.batch(rows)
    assert [g.tolist() for g in got] == [x + [2] for x in processor.encode(rows)]
    assert [e.codec.decode(g.astype("int64")) for g in got] == [processor.decode(g.tolist()) for g in got]


def test_decoding_any_ids(processor):
    import numpy as np

    codec, rng = sp_codec.Codec(sp_codec.model_bytes(MODEL)), random.Random(8)
    for _ in range(3000):
        ids = [rng.choice([rng.randint(0, 258), rng.randint(3, 300), rng.randint(0, 31999), 28705]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(np.array(ids, np.int64)) == processor.decode(ids)


def test_codec_columns(docs, empty, data, processor):
    model = sp_codec.model_bytes(MODEL)
    got = sp_codec.decode(sp_codec.encode(docs, model), model, to="score")
    assert set(got.columns) == set(docs.columns)
    for r in got.collect():
        want = [*processor.encode(r["text"] or ""), 2]
        assert r["ids"] == want and r["score"] == processor.decode(want) and r["set_id"] == "q"
    assert sp_codec.encode(empty, model).isEmpty()


def test_many_segments_are_encoded_in_bounded_memory(processor):
    import tracemalloc

    encoder = sp_codec.Encoder(sp_codec.model_bytes(MODEL))
    texts = [" ".join(f"wörter{i * 30_000 + k}" for k in range(30_000)) for i in range(2)]
    tracemalloc.start()
    got = encoder.batch(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    assert [x.tolist() for x in got] == [[*processor.encode(t), processor.eos_id()] for t in texts]

# Language models


def test_unigrams_and_bits(spark, docs, data):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    got = lm.score(docs, docs.filter(common.id_remainder(7) != 2)).collect()
    tokens = lambda t: [*corpus.words((t or "").translate(corpus.LOWER)), ""]
    c = Counter(w for r in data if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    texts = {r[0]: r[1] for r in data}
    assert len(got) == len(data)
    for r in got:
        own = tokens(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_rare_words_are_joined(spark, docs, monkeypatch):
    want = {(r["doc_id"], round(r["base_score"], 6)) for r in lm.score(docs, docs).collect()}
    monkeypatch.setattr(lm, "COMMON", 3)
    assert {(r["doc_id"], round(r["base_score"], 6)) for r in lm.score(docs, docs).collect()} == want


def test_probabilities_of_next_bytes_sum_to_one():
    import numpy as np

    table = np.zeros((2, lm.N_SLOTS), np.float32)
    lm.count_bits(["abba", "abc", ""], np.array([5, 3, 2]), table)
    mixer = lm.Mixer.fresh()
    mixer.learn(["abba", "abc", ""], np.array([5, 3, 2]), table, 0.1)
    stretched = lm._stretch(table[0], table[1])
    total = 0.0
    for b in range(256):
        bits = lm.Bits(["ab"])
        bits.byte = bits.byte.copy()
        bits.byte[2] = b
        p = 1.0
        for k, node, bit, slots in bits:
            z = sum(float(stretched[s[2]]) * mixer.weights[k][2, i] for i, s in enumerate(slots)) + 0.3 * mixer.weights[k][2, -1]
            one = 0.5 * (lm._squash(np.array([z]))[0] + mixer.refined.reshape(-1)[node[2] * lm.STEPS + lm._place(np.array([z]))[0]])
            p *= one if bit[2] else 1 - one
        total += p
    assert abs(total - 1) < 1e-6


def test_learning_beats_no_learning(spark):
    rows = [(i, t) for i, (t, _) in enumerate(corpus.texts(5, 120))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learnt = lm.score(df.filter("doc_id >= 90"), df.filter("doc_id < 90")).agg(F.avg("bits_per_byte")).first()[0]
    blank = lm.score(df.filter("doc_id >= 90"), df.filter("doc_id < 0")).agg(F.avg("bits_per_byte")).first()[0]
    assert learnt < 2.5 < 7 < blank


def test_order_of_words_counts(spark, monkeypatch):
    rng = random.Random(3)
    follow = {w: rng.sample([f"w{i}" for i in range(40)], 3) for w in [f"w{i}" for i in range(40)]}
    texts = []
    for _ in range(120):
        text = [rng.choice(list(follow))]
        while len(text) < 60:
            text.append(rng.choice(follow[text[-1]]))
        texts.append(text)
    shuffled = [rng.sample(t, len(t)) for t in texts[:30]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts + shuffled)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train, asked = df.filter("doc_id between 30 and 119"), df.filter("doc_id < 30 or doc_id >= 120")
    got = {r["doc_id"]: (r["score"], r["base_score"]) for r in lm.score(asked, train).collect()}
    for i in range(30):
        assert math.isclose(got[i][1], got[120 + i][1]) and got[i][0] > got[120 + i][0] + 10
    monkeypatch.setattr(lm, "COMMON", 3)
    again = {r["doc_id"]: r["score"] for r in lm.score(asked, train).collect()}
    assert all(math.isclose(again[i], got[i][0], rel_tol=1e-4) for i in got)


def test_packed_numbers_come_back():
    import numpy as np

    arrays = [np.array([0, 1, 255, 1 << 20, (1 << 32) - 1]), np.array([], int), np.array([7])]
    assert [a.tolist() for a in lm._unpack(lm._pack(*arrays), 5, 0, 1)] == [a.tolist() for a in arrays]


def test_pairs_by_brute_force(spark, monkeypatch):
    words = ["a", "b", "cc", "dog"]
    train = ["a b a b cc", "b cc", None, "", "dog a b", "a b", "a b"]
    asked = ["", *words, "a b", "b a b cc dog", "unseen a b", "cc cc", "a b", None]
    rows = [(i, t, i < len(train)) for i, t in enumerate(train + asked)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learnt boolean").repartition(3)
    bits = lambda: {r["doc_id"]: -r["score"] / math.log10(2) for r in lm.score_marked(df, learnt=df["learnt"], asked=~df["learnt"]).collect()}
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 4)
    monkeypatch.setattr(lm, "STRENGTH", 3.0)
    got = bits()
    assert len(got) == len(asked)
    monkeypatch.setattr(lm, "STRENGTH", 1e30)
    alone = bits()
    tokens = lambda t: ["", *(t or "").split(), ""]
    pairs = Counter(p for t in train for p in zip(tokens(t), tokens(t)[1:]))
    n = Counter(p for t in train for p in tokens(t)[:-1])
    cost = {"": alone[len(train)]}
    cost |= {w: alone[len(train) + 1 + i] - cost[""] for i, w in enumerate(words)}
    cost["unseen"] = alone[len(train) + 7] - cost["a"] - cost["b"] - cost[""]
    for i, t in enumerate(asked, len(train)):
        each = [(pairs[p, w] + 3 * 2 ** -cost[w]) / (n[p] + 3) for p, w in zip(tokens(t), tokens(t)[1:])]
        assert math.isclose(got[i], -sum(map(math.log2, each)), abs_tol=0.02)


def test_pair_counts_leave_no_shuffle_to_the_result(spark, docs, monkeypatch):
    scores = {}
    for passes in (1, 3):
        monkeypatch.setattr(lm, "PASSES", passes)
        found = lm.score(docs.repartition(5), docs)
        # The counts of pairs are written, and their shuffle files gone, before the result is asked for.
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
        scores[passes] = sorted((r["n_tokens"], r["score"]) for r in found.collect())
    assert len(scores[1]) == len(scores[3]) == docs.count()
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-3) for a, b in zip(scores[1], scores[3]))


def test_texts_reach_lm_tasks_in_small_batches_and_parts(spark, docs, monkeypatch):
    import numpy as np
    import pyarrow as pa

    sizes = [3, 0, 5, 40, 2, 2, 9, 1, 1, 1]
    table = pa.table({"doc_id": range(10), "text": [None if n == 0 else "x" * n for n in sizes]})
    for rows in (1, 3, 10):
        for most in (1, 8, 1000):
            parts = list(lm._parts(table.to_batches(max_chunksize=rows), most))
            assert pa.Table.from_batches(parts).equals(table)
            held = [[sizes[i] for i in p["doc_id"].to_pylist()] for p in parts]
            assert all(sum(h) <= most or len([n for n in h if n]) == 1 for h in held)
            assert all(sum(a) + b[0] > most for a, b in zip(held, held[1:]))
    monkeypatch.setattr(lm, "PART_TEXTS", 4)
    assert [p.num_rows for p in lm._parts(table.to_batches(max_chunksize=3), 1000)] == [4, 4, 2]
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before = spark.conf.get(key)

    def kept(df, name):
        seen[name] = int(spark.conf.get(key))
        return common.materialise(df, name)

    monkeypatch.setattr(lm, "materialise", kept)
    lm.score(docs, docs).collect()
    assert seen == {"word_counts": 1_000, "scored": 1_000} and spark.conf.get(key) == before


def test_lm_codes_many_words_in_bounded_memory():
    import tracemalloc

    import numpy as np

    words = [f"some{i}word" for i in range(40_000)]
    table, mixer = np.zeros(lm.N_SLOTS, np.float32), lm.Mixer.fresh()
    tracemalloc.start()
    got = mixer.bits_of(words, table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000
    assert got[-3:].tolist() == mixer.bits_of(words[-3:], table).tolist() and len(got) == len(words)
    assert len(mixer.bits_of([], table)) == 0

def test_lm_on_nothing(empty):
    assert lm.score(empty, empty).isEmpty()


# Jaccard join


@pytest.mark.parametrize("percent, width", [(90, 3), (80, 5), (60, 2)])
def test_components(docs, data, percent, width):
    got = Counter(tuple(r) for r in jaccard.link(docs, percent, width).select("doc_id", "n_shingles", "component_id").collect())
    assert got == Counter(corpus.components([(r[0], r[1]) for r in data], percent, width))


@pytest.mark.parametrize("percent, small, large", [(70, 80, 114), (50, 60, 120), (90, 60, 62)])
def test_sizes_far_apart_and_short_ids(spark, percent, small, large):
    rows = [(1, " ".join(f"w{i}" for i in range(large))), (2, " ".join(f"w{i}" for i in range(small)))]
    got = jaccard.link(spark.createDataFrame(rows, "doc_id int, text string"), percent, 1)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, 1), (2, 1)]


@pytest.mark.parametrize("seed, percent, edits", [(1, 90, 3), (2, 80, 4), (3, 90, 5), (4, 70, 6)])
def test_near_the_threshold(spark, seed, percent, edits):
    """Copies of a few texts with edits that lie on both sides of the threshold, so groups stay split."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(60, 130))] for _ in range(3)]
    rows = []
    for i in range(150):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 2)] = [rng.choice(vocab)] * rng.randint(0, 2)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.link(df, percent, 3, rounds=rng.randint(0, 2)).collect())
    assert got == sorted(corpus.components(rows, percent, 3))


@pytest.mark.parametrize("percent", [50, 70, 80, 90, 97])
def test_linked_sets_share_a_region(percent):
    import numpy as np

    rng, regions, met = np.random.default_rng(percent), jaccard.Regions(percent), 0
    for _ in range(1500):
        n = int(rng.choice([3, 6, 12, 40, 130, 600]) * rng.uniform(1, 2))
        common = rng.integers(0, 1 << 63, n).astype(np.uint64)
        out = rng.multinomial(int(n * (100 - percent) / percent), rng.dirichlet([1, 1, 1]))
        x, y = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, k).astype(np.uint64)])) for k in out[:2])
        if 100 * n < percent * (n + out[0] + out[1]) or not out[0] + out[1]:
            continue
        keys, ends = regions.of(np.concatenate([x, y]), np.array([len(x), len(x) + len(y)]))
        assert set(keys[: ends[0]]) & set(keys[ends[0] :])
        met += 1
    assert met > 500


def test_cells_keep_linked_sets_together(spark, monkeypatch):
    """Sets around several centres: split by windows, no link lost, and cells smaller than before."""
    monkeypatch.setattr(jaccard, "PIVOTS", 4)
    rng = random.Random(4)
    rows, i = [], 0
    for c in range(6):
        base = [f"c{c}w{k}" for k in range(100)]
        for _ in range(12):
            rows.append((i, " ".join(w for w in base if rng.random() > 0.03)))
            i += 1
    data = {r[0]: corpus.shingles(r[1], 1) for r in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = jaccard.sets_of(df, df, 1)
    ids = {r["doc_id"]: r["set_id"] for r in jaccard.describe(df, 90, 1).collect()}
    back = {v: k for k, v in ids.items()}
    like = lambda a, b: len(data[a] & data[b]) / len(data[a] | data[b])
    cells = spark.createDataFrame([(1, ids[0], ids[a], 1 - like(0, a), ids[a]) for a in data if a], "cell long, q long, x long, d double, component long")
    parts, links = jaccard.split_cells(cells, sets, 90)
    by = {}
    for r in parts.collect():
        by.setdefault(r["cell"], set()).add(back[r["x"]])
    assert len(by) > 1 and max(map(len, by.values())) < len(data)
    found = {frozenset((back[r["a"]], back[r["b"]])) for r in links.collect()}
    assert all(like(*pair) >= 0.9 for pair in found)
    for a in data:
        for b in data:
            if 0 < a < b and like(a, b) >= 0.9:
                assert {a, b} in found or any({a, b} <= m for m in by.values())


def test_chains_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in jaccard.components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100


def test_join_of_nothing(spark, empty):
    assert jaccard.link(empty).isEmpty()
    lone = corpus.frame(spark, [(None, "a b c d e f", *[None] * 8), (4, None, *[None] * 8)])
    assert sorted(map(str, (r["component_id"] for r in jaccard.link(lone).collect()))) == ["4", "None"]


# Languages


def test_languages(spark, docs, data):
    model = langid.fit(docs.filter(common.id_remainder(5) != 0))
    got = docs.select("doc_id", "lang", "text", langid.predict(F.col("text"), model).alias("p")).collect()
    right = [r["p"]["lang_pred"] == r["lang"] for r in got if r["doc_id"] < 40]
    assert sum(right) / len(right) > 0.9
    for r in got:
        assert 0 <= r["p"]["score"] <= 1
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert tuple(r["p"]) == ("und", 0.0)


def test_unseen_words_back_off(spark):
    rows = [(i, "gartenhaus blumenweg steinmauer", "de") for i in range(6)] + [(i, "summerhouse flowerway stonework", "en") for i in range(6, 12)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    unseen = spark.createDataFrame([("blumenhaus",), ("flowerhouse",)], "text string")
    assert [r["p"]["lang_pred"] for r in unseen.select(langid.predict(F.col("text"), model).alias("p")).collect()] == ["de", "en"]


def test_rare_languages_and_ties(spark):
    """Every learnt language can be answered, und only to texts without letters; ties go to the first name."""
    rows = [(1, "unum duo tria", "la"), (2, "eins zwei drei", "de"), (None, "alpha", "el"), (4, None, "xx"), (5, "1 2 3", "fr")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "el", "fr", "la"]
    asked = [("tria unum",), ("zwei",), ("alpha",), ("qqq xyz",), ("12 34",), ("",), (None,)]
    got = [r["p"] for r in spark.createDataFrame(asked, "text string").coalesce(1).select(langid.predict(F.col("text"), model).alias("p")).collect()]
    assert [r["lang_pred"] for r in got[:3]] == ["la", "de", "el"] and got[3]["lang_pred"] in model.languages
    assert [tuple(r) for r in got[4:]] == [("und", 0.0)] * 3
    even = langid.fit(spark.createDataFrame([(1, "same", "b"), (2, "same", "a")], "doc_id long, text string, lang string"))
    assert spark.createDataFrame([("same",)], "text string").select(langid.predict(F.col("text"), even).alias("p")).first()["p"]["lang_pred"] == "a"


def test_language_scores_by_brute_force(spark, docs, data):
    """Known words by log frequency, others by the longest n-gram seen at each place."""
    model = langid.fit(docs)
    counts = {}
    for r in data:
        if r[2] and r[1]:
            for w in corpus.words(r[1].lower()):
                counts[r[2], w] = counts.get((r[2], w), 0) + 1
    met = Counter()
    for (_, w), n in counts.items():
        met[w] += n
    known = sorted((w for w in met if met[w] > 1), key=lambda w: w.encode())
    assert model.words.to_pylist() == known
    for lang in model.languages:
        j = model.languages.index(lang)
        total = sum(n for (a, _), n in counts.items() if a == lang)
        for w in known[::7]:
            want = math.log((counts.get((lang, w), 0) + 0.5) / (total + 0.5 * len(known)))
            assert math.isclose(model.word_scores[known.index(w), j], want, rel_tol=1e-5)


def test_language_edges(docs, empty):
    nothing = langid.fit(empty)
    assert {r["p"]["lang_pred"] for r in docs.select(langid.predict(F.col("text"), nothing).alias("p")).collect()} == {"und"}


def test_languages_are_told_in_bounded_memory(monkeypatch):
    """Long batches cost what a part of them does, and the answers do not depend on how they are cut."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    grams = np.where(rng.random((langid.SLOTS, 1)) < 0.4, np.nan, rng.random((langid.SLOTS, 3))).astype(np.float32)
    model = langid.Model(["a", "b", "c"], pa.array(["known"]), np.zeros((1, 3), np.float32), grams, np.full(3, -9, np.float32))
    texts = pa.array([None if i % 50 == 0 else "" if i % 50 == 1 else " ".join(f"unseen{i * 8 + k}word" for k in range(8)) for i in range(2_500)])
    tracemalloc.start()
    got = langid._answers(model, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000
    assert len(got) == len(texts) and len(langid._answers(model, texts.slice(0, 0))) == 0
    monkeypatch.setattr(langid, "SCORE_WORDS", 10_000)
    monkeypatch.setattr(langid, "SCORE_BYTES", 700)
    assert langid._answers(model, texts).equals(got)

# Mixing


def water(sizes, weights=(1.0, 2.0, 3.0), epochs=3.0):
    """Clamp and reshare until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        if not open_:
            return fixed
        level = (total - sum(fixed.values())) / sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] * level > epochs * sizes[s]]
        if not over:
            return fixed | {s: w[s] * level for s in open_}
        fixed |= {s: epochs * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_water_filling(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": int(rng.choice([1, 10, 1000, 50_000]) * rng.random()) for i in range(9)} | {None: rng.randint(0, 100)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.water_fill(df).collect()}
    want = water(sizes)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in sizes)


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 200, "c": 300},  # in proportion to the weights: all tie
        {"a": 100, "b": 200, "c": 900},
        {"a": 50, "b": 50, "c": 50, "d": 50},
        {"a": 1, "b": 40, "c": 79},  # a is clamped, b and c tie
        {"a": 20, "b": 40, "c": 300},  # caps of a and b lie exactly at the level
        {"a": 0, "b": 0, None: 0},
        {"a": 7},
    ],
)
def test_water_filling_with_ties(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.water_fill(df).collect()}
    want = water(sizes) if any(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) and 0 <= got[s] <= 3 * sizes[s] for s in sizes)
    assert math.isclose(sum(got.values()), sum(sizes.values()), abs_tol=1e-9)


@pytest.mark.parametrize("ids", [lambda i: i, lambda i: None, lambda i: 5])
@pytest.mark.parametrize("text", [lambda i: f"w{i} " * (3 + i % 5), lambda i: "same words here"])
def test_null_and_repeated_ids_come_near_the_target(spark, monkeypatch, ids, text):
    monkeypatch.setattr(mixing, "FEW", 4)
    rows = [(ids(i), text(i), f"s{min(i // 10, 2)}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sizes(df)
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mix_sizes(df.repartition(5)).collect()))
    sums = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect()
    assert sums and all(abs(r["taken"] / (2 if r["source_size"] < 100 and len(sums) < 3 else 1) - r["target"]) <= r["most"] for r in sums)
    assert mixing.mix_documents(df).count() == got.agg(F.sum("repeats")).first()[0]


def test_mix(docs, data):
    got = mixing.mix_sizes(docs).collect()
    again = mixing.mix_sizes(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(data)
    source = {r[0]: r[3] for r in data}
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = water(dict(sizes))
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-9)
        assert abs(taken[s] - target[s]) <= 2 * largest[s]


def test_mixed_documents(docs, empty):
    n = {r["doc_id"]: r["repeats"] for r in mixing.mix_sizes(docs).filter("doc_id not in (5)").collect()}
    got = mixing.mix_documents(docs)
    assert got.columns == docs.columns
    have = Counter(r["doc_id"] for r in got.collect())
    assert all(have[i] == k for i, k in n.items())
    assert mixing.mix_documents(empty).isEmpty() and mixing.mix_sizes(empty).isEmpty()


def test_secrets_of_one_long_text(spark):
    """Fifty thousand tokens and thousands of base spans in one text: linear work, the same spans as by brute force."""
    import time

    rng = random.Random(6)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    token = lambda: "".join(rng.choice(alphabet) for _ in range(18))
    words = [token() if i % 10 else "password=" + token() if i % 20 else "deadbeef" * 4 for i in range(50_000)]
    text = "é𝒳 " + " ".join(words)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = secrets.scan(df).first()
    assert time.time() - began < 120
    assert [tuple(x) for x in row["base_spans"]] == base_spans(text)
    added = [x for x in row["spans"] if x["kind"] == 3]
    assert len(added) > 20_000 and all(re.fullmatch("[a-zA-Z0-9]{18}", text[x["start"] : x["end"]]) for x in added)


def test_running_sums_and_overlaps(spark, monkeypatch):
    monkeypatch.setattr(secrets, "CHUNK", 4)
    rng = random.Random(8)
    for n in (0, 1, 4, 5, 16, 17, 33):
        x = [rng.randint(0, 9) for _ in range(n)]
        got = spark.createDataFrame([(x,)], "x array<int>").select(secrets._starts(F.col("x")).alias("y")).first()["y"]
        assert got == [sum(x[:i]) for i in range(n)]
    tokens, at = [], 0
    for _ in range(40):
        at += rng.randint(1, 8)
        tokens.append((at, at + rng.randint(1, 6)))
        at = tokens[-1][1]
    spans = sorted((a, a + rng.randint(1, 5)) for a in (rng.randint(0, at) for _ in range(12)))
    df = spark.createDataFrame([(tokens, spans)], "t array<struct<start:int,end:int>>, s array<struct<start:int,end:int>>")
    got = df.select(secrets._overlaps(F.col("t"), F.col("s")).alias("y")).first()["y"]
    assert got == [any(b < y and x < e for b, e in spans) for x, y in tokens]


def test_likeness_of_texts_without_sentence_marks(spark):
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    rows = [(i, " ".join(words(2000))) for i in range(6)] + [(10 + i, " ".join(words(30)) + ".") for i in range(3)]
    got = {r["doc_id"]: r for r in fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(0.3 < got[i]["near_edited"] < 0.7 and got[i]["near_next"] < 0.25 for i in range(6))


def test_words_are_lowered_alike_in_learning_and_prediction(spark):
    greek = ["ΟΔΟΣ ΛΟΓΟΣ ΝΟΜΟΣ ΤΟΠΟΣ", "ΛΟΓΟΣ ΟΔΟΣ ΤΟΠΟΣ ΝΟΜΟΣ"] * 8
    other = ["İSTANBUL İZMİR İYİ İLK", "İLK İYİ İZMİR İSTANBUL"] * 8
    docs = spark.createDataFrame([(i, t, lang) for lang, texts in (("el", greek), ("tr", other)) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    known = set(model.words.to_pylist())
    lowered = {w for r in docs.select(F.split(F.lower("text"), " ").alias("w")).collect() for w in r["w"]}
    assert lowered <= known
    got = docs.select("lang", langid.predict(F.col("text"), model)["lang_pred"].alias("p"), langid.predict(F.col("text"), model)["score"].alias("s")).collect()
    assert all(r["lang"] == r["p"] and r["s"] > 0.9 for r in got)
