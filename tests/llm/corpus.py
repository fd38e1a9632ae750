"""A small corpus with every awkward case, and plain-Python references."""

import random
import re

BLANK = "\x20\x09-\x0d"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, words string, ids string, spans string, set_id string"


def words(text):
    return re.findall(rf"[^{BLANK}]+", text or "")


def texts(seed=11, n=40):
    rng = random.Random(seed)
    vocab = {"en": ["the", "and", "house", "river", "green", "walk", "stone", "light"], "de": ["der", "und", "haus", "fluß", "grün", "weg", "stein", "licht"]}
    out = []
    for i in range(n):
        lang = "en" if i % 2 else "de"
        out.append((" ".join(rng.choice(vocab[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(rng.randint(1, 120))) + ".\nEnde " + str(i), lang))
    return out


def rows(seed=11):
    base = texts(seed)
    out = [(i, t, lang, f"src{i % 3}" if i % 7 else None, len(t)) for i, (t, lang) in enumerate(base)]
    extra = [None, "", " \n\t", "x", "1234 5678", base[3][0], base[3][0] + " tail", "é漢𝒳 ▁ ok", "a" * 20_000, "word " * 3_000, 'token = "0123456789abcdef0123456789abcdef01234567"', "line\nline\nline with password=abcdefgh12 end"]
    out += [(100 + i, t, None if i % 2 else "en", None, None) for i, t in enumerate(extra)]
    out += [out[5], out[5]]
    return [(*r, "s", "w", "i", "p", "q") for r in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def shingles(text, width):
    x = words((text or "").translate(LOWER))
    return {tuple(x[i : i + width]) for i in range(len(x) - width + 1)} if len(x) >= width else ({tuple(x)} if x else set())


def components(docs, percent, width):
    """Least reachable id of each (id, text), by comparing all pairs."""
    sets = [(i, shingles(t, width)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a][1] & sets[b][1])
            if common and 100 * common >= percent * len(sets[a][1] | sets[b][1]):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[root(a)] = min(least.get(root(a), i), i)
    return [(i, len(s), least[root(a)]) for a, (i, s) in enumerate(sets)]
