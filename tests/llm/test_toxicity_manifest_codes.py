import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.llm import common, merkle, toxicity, vector_codes

from . import corpus

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.frame(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return corpus.frame(spark, [])


# Toxicity


@pytest.fixture(scope="module")
def characters(spark):
    rng = random.Random(1)
    words = ["idiot", "moron", "clown", "letter", "balloon", "river", "stone", "green", "house", "scum", "loser", "worthless"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(200)] + [(900, None), (901, ""), (902, "!!! ...")]
    return toxicity.character_model(spark.createDataFrame(rows, "doc_id long, text string"))


def readings(places):
    """All readings of a lattice with their cost, as sequences of characters."""
    for choice in itertools.product(*places):
        out, cost = [], 0.0
        for e, w in choice:
            cost += w
            e = (out[-1] if out else toxicity.BOUNDARY) if e == toxicity.AGAIN else e
            if e == toxicity.NOTHING or (e == toxicity.BOUNDARY and (not out or out[-1] == toxicity.BOUNDARY)):
                continue
            out.append(e)
        yield out, cost


def worth(model, reading, cost):
    total, line = -cost, [toxicity.BOUNDARY] * (toxicity.ORDER - 1)
    for e in [*reading, *([] if reading and reading[-1] == toxicity.BOUNDARY else [toxicity.BOUNDARY])]:
        before = sum(c << toxicity.CODE_BITS * (toxicity.ORDER - 2 - i) for i, c in enumerate(line))
        total += float(model.logs(np.array([before]), np.array([e]))[0])
        line = [*line[1:], e]
    return total


def test_viterbi_finds_the_best_of_all_readings(characters):
    tokens = ["1d10t", "m0r0n", "i.d.i.o.t", "lettter", "cl00wn", "a b c", "s$um", "riv3rr", "x", "9", "||", "b-a-11oon"]
    lattices = [toxicity.lattice(t) for t in tokens]
    for token, places, got in zip(tokens, lattices, toxicity._viterbi(characters, lattices), strict=True):
        best = max(worth(characters, r, c) for r, c in readings(places))
        same = max(worth(characters, r, c) for r, c in readings(places) if "".join(map(chr, r)) == got)
        assert same == pytest.approx(best, abs=1e-3), token


def test_disguised_words_are_restored(characters):
    tokens = ["1d10t", "i.d.i.o.t", "i d i o t", "iiidiooot", "m0r0n", "$cum", "l0$er", "iddiot", "w0rth1e$s", "house", "letter", "balloon", "12345"]
    got = toxicity.restore_tokens(characters, tokens)
    assert [got.get(i, t) for i, t in enumerate(tokens)] == ["idiot"] * 4 + ["moron", "scum", "loser", "idiot", "worthless", "house", "letter", "balloon", "12345"]


def test_lone_pairs_are_read_as_the_search_reads_them(characters):
    words = ["letter", "balloon", "green", "idiiot", "moronn", "cclown", "riiver", "ston𝒳𝒳e", "aab", "aa"]
    got = toxicity.restore_tokens(characters, words)
    assert [got.get(i, w) for i, w in enumerate(words)] == toxicity._viterbi(characters, [toxicity.lattice(w) for w in words])


def test_long_tokens_are_read_whole(characters):
    long_ = ["ab1" * 20_000, "a" * 50_000, "-" * 1_000 + "x" + "0-" * 5_000]
    got = toxicity.restore_tokens(characters, long_)
    assert len(got[0]) >= 40_000 and got[1] in ("a", "aa") and len(got[2]) > 0


def test_restored_text(spark, characters):
    df = spark.createDataFrame([(0, "You 1D10T, go!"), (1, None), (2, "an i d i o t. here"), (3, ""), (4, "clean house")], "doc_id long, text string")
    got = {r["doc_id"]: r["x"] for r in df.select("doc_id", toxicity.restored(F.col("text"), characters).alias("x")).collect()}
    assert got[0]["text"].split()[1] == "idiot" and got[0]["changed"] == 1
    assert got[2]["text"].endswith("idiot") and got[1] == got[3] == ("", 0) and got[4] == ("clean house", 0)


def test_toxic_texts_are_found_disguised_too(spark):
    rng = random.Random(7)
    plain = ["river", "stone", "green", "house", "letter", "walk", "light", "cloud", "paper", "table", "window", "garden"]
    bad = ["idiot", "moron", "scumbag", "clownish"]
    disguise = {"idiot": "1d10t", "moron": "m.o.r.o.n", "scumbag": "$cumb4g", "clownish": "c l o w n i s h"}
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(40)]
        if i % 4 == 0:
            words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    hidden = [(1000 + i, " ".join([rng.choice(plain) for _ in range(20)] + [disguise[w]] + [rng.choice(plain) for _ in range(20)])) for i, w in enumerate(bad * 3)]
    clean = [(2000 + i, " ".join(rng.choice(plain) for _ in range(40)) + " a b 12 2024-01-01") for i in range(20)]
    df = spark.createDataFrame(rows + hidden + clean, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int").filter(common.id_remainder(4) != 2)
    got = {r["doc_id"]: r for r in toxicity.classify(df, marks).collect()}
    assert all(got[i]["predicted"] == y for i, y in labels)
    assert all(got[i]["predicted"] == 1 and got[i]["restored"] > 0 for i, _ in hidden)
    assert not any(got[i]["predicted"] for i, _ in clean)
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_edges(spark, docs, empty):
    marks = spark.createDataFrame([(i, int(i < 9)) for i in range(40)] + [(5, 0), (41, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.classify(docs.withColumn("toxic", F.lit("x")).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("toxic", F.lit(None))), marks)
    assert got.count() == docs.count() + 1 and got.filter("score is null or predicted is null").isEmpty()
    assert toxicity.classify(empty, marks).isEmpty()
    assert toxicity.classify(docs, marks.limit(0)).select("score").distinct().count() == 1


def test_lexicon_forms_agree():
    import pyarrow as pa

    words = ["abc", "abcdefghij", "ñandú𝒳xyz", ""]
    got = sorted(x for forms, _ in toxicity._forms(pa.array(words)) for x in forms.to_pylist())
    assert got == sorted(toxicity._texts_of(*words))


# Manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for hashes in levels[:-1]:
        a = i // 8 * 8
        out.append((hashes[a:i], hashes[i + 1 : a + 8]))
        i //= 8
    return out


def manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        own = sorted(((r[0] is not None, r[0] or 0, sha(*map(field, r))), r) for r in groups[name])
        trees[name] = ([r for _, r in own], tree([k[2] for k, _ in own]))
    top = tree([trees[x][1][-1][0] for x in names])
    out = []
    for place, name in enumerate(names):
        own, levels = trees[name]
        for i, r in enumerate(own):
            path = siblings(levels, i) + siblings(top, place)
            h = levels[0][i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                h = sha(*map(field, (*r[:4], r[4] and r[4].translate(LOWER))))
            for left, right in path:
                h = sha(*left, h, *right)
            out.append((r[0], levels[0][i], levels[-1][0], top[-1][0], sha(*[x for a, b in path for x in a + b]), h, h == top[-1][0]))
    return out


def of_all(df):
    return [tuple(r) for r in merkle.manifest(df, common.id_remainder(3) == 0).collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def test_manifest_is_that_of_one_process(spark, docs, empty):
    more = [(i, f"Text {i}", f"l{i % 11}", "s", 3) for i in range(-40, 60)] + [(7, "Ä", "zz", None, None), (None, "n", "zz", None, 1), (None, None, None, None, None)]
    df = docs.select(*merkle.FIELDS).union(spark.createDataFrame([(a, e, c, d, b) for a, b, c, e, d in more], "doc_id long, source string, lang string, n_chars long, text string"))
    rows = [tuple(r) for r in df.collect()]
    assert order(of_all(df.withColumn("leaf", F.lit(1)).withColumn("grp", F.lit("x")))) == order(manifest(rows))
    assert of_all(empty) == []


def test_manifest_of_one_row(spark):
    df = spark.createDataFrame([(3, "s", "en", 2, "AB")], "doc_id long, source string, lang string, n_chars long, text string")
    assert of_all(df) == manifest([tuple(df.first())])


def test_crowded_cells_are_cut_further(spark, monkeypatch):
    """Ids far apart and close together, one id with many texts, one row many times: cells stay small."""
    monkeypatch.setattr(merkle, "CELL", 4)
    monkeypatch.setattr(merkle, "DIGIT_BITS", 8)
    rows = [(i, None, "en", i, f"T{i}") for i in [*range(50), -(2**63), 2**63 - 1, 2**40]] + [(5, "s", "en", k, f"T{k}") for k in range(30)] + [(9, None, "en", 1, "Same")] * 20
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert order(of_all(df)) == order(manifest(rows))


def test_ranks_need_no_global_sort(spark):
    df = spark.range(3000).select(F.col("id").alias("key"), F.lit("en").alias("grp"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.monotonically_increasing_id().alias("place"))
    groups = df.groupBy("grp").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    got = merkle.ranked(df, groups)
    assert got.filter("rank <> key").isEmpty()
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


# Vector codes


def lloyd(rows):
    """code, error by row of (vec_id, label, vector) in order of ids, and the codebooks, plainly."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    n, width = len(rows), len(rows[0][2])
    size = -(-width // 8)
    x = np.zeros((n, size * 8), np.int64)
    x[:, :width] = np.floor(np.array([r[2] for r in rows], np.float64) * 4096)
    x = x.reshape(n, 8, size)
    books = [x[:16, p].copy() for p in range(8)]
    for r in range(7):
        d = [((x[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(8)]
        own = [k.argmin(1) for k in d]
        if r < 6:
            for p, e in itertools.product(range(8), range(len(books[0]))):
                if (own[p] == e).any():
                    books[p][e] = x[own[p] == e, p].sum(0) // (own[p] == e).sum()
    error = sum(k.min(1) for k in d)
    code = ["".join(f"{own[p][i]:02x}" for p in range(8)) for i in range(n)]
    total = {}
    for r, e in zip(rows, error.tolist(), strict=True):
        total[r[1]] = total.get(r[1], 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted((r[0] is None, r[0] or 0, c, int(e), total[r[1]], digest) for r, c, e in zip(rows, code, error, strict=True))


def coded(df):
    got = vector_codes.codes(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    return sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got)


SCHEMA = "vec_id long, label int, embedding array<float>, code string"


def vectors(n, width, seed=3):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, width)) * 0.2 + rng.integers(0, 3, (n, 1))).astype(np.float32)
    return [(int(i), None if i % 5 == 0 else int(i % 3), [float(v) for v in x[i]], "c") for i in range(n)]


@pytest.mark.parametrize(("n", "width"), [(300, 64), (40, 16), (5, 8), (60, 13)])
def test_codes_are_those_of_plain_rounds(spark, n, width):
    rows = vectors(n, width)
    assert coded(spark.createDataFrame(rows, SCHEMA).repartition(3)) == lloyd(rows)


def test_code_edges(spark):
    rows = vectors(200, 16) + [(3, 1, [0.5] * 16, "c")] * 4 + [(None, None, [0.25] * 16, "c"), (77, 2, [0.1] * 16, "c")] + [(1000 + i, 1, [1.0] * 16, "c") for i in range(300)]
    bad = [(900, 1, None, "c"), (901, 1, [float("nan")] * 16, "c"), (902, 1, [float("inf")] + [0.0] * 15, "c"), (903, 1, [None] + [0.0] * 15, "c"), (904, 1, [], "c"), (905, 1, [1.0] * 8, "c")]
    df = spark.createDataFrame(rows + bad, SCHEMA)
    assert coded(df) == lloyd(rows)
    assert vector_codes.codes(df.limit(0)).isEmpty() and vector_codes.codes(df.filter("vec_id = 901")).isEmpty()
    huge = spark.createDataFrame([(1, 1, [3e38] * 8, "c"), (2, 1, [-3e38] * 8, "c")], SCHEMA)
    assert [r["error"] for r in vector_codes.codes(huge).collect()] == [0, 0]


def test_heaps_spare_parts_and_lose_nothing():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(1000, 8, 8)) * 300 + rng.integers(0, 8, (1000, 8, 1)) * 2000).astype(np.int64)
    books = x[:16].transpose(1, 0, 2).copy()
    block = vector_codes.Block(x, books)
    sums, used, scanned = block.sums.copy(), np.zeros((8, 16), np.int64), []
    for _ in range(6):
        new = vector_codes._updated(books, sums)
        used, books = used + vector_codes._drift(books, new), new
        block.sums[:] = 0
        scanned.append(block.move(books, used))
        sums += block.sums
        for p in range(8):
            d = vector_codes._distances(x[:, p], books[p])
            assert (block.entries[:, p] == d.argmin(1)).all()
            assert (sums[p, :, -1] == np.bincount(d.argmin(1), minlength=16)).all()
            assert sum(map(len, block.heaps[p])) == 1000
    assert scanned[-1] < 8000 * 0.7
