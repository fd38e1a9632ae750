"""Secret scans: patterns, and a randomness test battery with false-discovery control."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, text_or_empty

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of 16 and of 32 characters and more are those of the open patterns that pass the length rule.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Shortest token, and maximal runs of at least that many token characters.
LEAST = 16
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}+={{0,2}}"
#: Runs that mix the signs of two encodings; their parts between slashes are tokens of their own.
MIXED = r"^(?=.*[+/])(?=.*[_-])"
KINDS = ("assign", "access", "hex", "random")

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings by the pattern that a token matches first: alphabet, collision rate of text-like tokens.
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", 0.10),
    ("base32", r"^(?=.*[2-7])[A-Z2-7]+={0,2}$", UPPER + "234567", 0.065),
    ("base36", r"^(?=.*[0-9])(?:[a-z0-9]+|[A-Z0-9]+)$", DIGITS + LOWER, 0.065),
    ("upper", r"^[A-Z]+={0,2}$", UPPER, 0.065),
    ("lower", r"^[a-z]+={0,2}$", LOWER, 0.065),
    ("base62", r"^(?=.*[A-Za-z])[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, 0.065),
    ("base64", r"^(?=.*[A-Za-z])[A-Za-z0-9+/]+={0,2}$", UPPER + LOWER + DIGITS + "+/", 0.065),
    ("base64url", r"^(?=.*[A-Za-z])[A-Za-z0-9_-]+={0,2}$", UPPER + LOWER + DIGITS + "-_", 0.065),
    ("mixed", r"", UPPER + LOWER + DIGITS + "+/-_", 0.065),
)
#: Text-like tokens change between letters of one case, digits and signs at this rate.
SWITCH_RATE = 0.2
#: Tokens whose battery against uniform randomness falls below this are not random.
UNIFORM_LEVEL = 0.001
#: Elements of an array that a fold goes over at a time.
CHUNK = 256
#: p-values are counted in bins of a tenth of a decade.
BINS = 400


def _starts(lengths: Column) -> Column:
    """What the elements before each one of an array sum up to.

    A fold that appends copies all it has; folds over chunks of ``CHUNK``, and one over the chunks'
    sums, keep that small for texts of very many matches.
    """
    def fold(values: Column, value) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, none, lambda acc, x: F.struct((acc["at"] + value(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def chunked(x: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")))
        return F.transform(places, lambda i: fold(F.slice(x, i * CHUNK + 1, F.lit(CHUNK)), lambda v: v))

    def joined(parts: Column) -> Column:
        add = lambda offsets: F.flatten(F.transform(parts, lambda part, i: F.transform(part["out"], lambda v: v + F.get(offsets, i))))
        return let(fold(parts, lambda part: part["at"])["out"], add)

    return let(let(lengths, chunked), joined)


def _spans(text: Column, pattern: str, group: int = 0, least: int = 1) -> Column:
    """start, end and token of the pattern's matches, leftmost first; group ``group`` has ``least`` characters or more.

    The pieces between the matches come from ``split``, so places are sums of lengths in code points.
    """
    def located(gaps: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        return let(F.arrays_zip(F.slice(gaps, 1, F.size(gaps) - 1).alias("gap"), found.alias("found"), kept.alias("kept")), placed)

    def placed(rows: Column) -> Column:
        def at(starts: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                start = F.get(starts, i) + F.length(x["gap"])
                return F.struct(start.alias("start"), (start + F.length(x["found"])).alias("end"), F.when(F.length(x["kept"]) >= least, x["found"]).alias("token"))

            return F.filter(F.transform(rows, span), lambda x: x["token"].isNotNull())

        return let(_starts(F.transform(rows, lambda x: F.length(x["gap"]) + F.length(x["found"]))), at)

    # One scan tells whether there is anything; most texts have none.
    none = F.array().cast("array<struct<start:int,end:int,token:string>>")
    return F.when(text.rlike(pattern), let(F.split(text, pattern, -1), located)).otherwise(none)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by the rational approximation 26.2.17 of Abramowitz and Stegun."""

    def tail(x: Column) -> Column:
        t = 1 / (1 + F.lit(0.2316419) * F.abs(x))
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        p = F.exp(-x * x / 2) * F.lit(0.3989422804014327) * poly
        return F.greatest(F.lit(1e-30), F.when(x >= 0, p).otherwise(1 - p))

    return let(z, tail)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _pairs(values: Column, f) -> Column:
    """Sum of f over neighbours."""
    return _sum(F.transform(F.slice(values, F.lit(2), F.size(values) - 1), lambda x, i: f(F.get(values, i), x)))


def _class(c: Column) -> Column:
    return F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3)


def _battery(token: Column, alphabet: Column, collision: Column) -> Column:
    """struct(p_uniform, p_text) of one token in its inferred encoding.

    Against uniform randomness: chi-squared of the alphabet's counts (upper side), runs above and
    below the alphabet's middle, lag-1 serial correlation of the symbols' values; the squares of
    their deviates are summed. Against text-like tokens: the same counts as collisions (lower side)
    and runs of character classes, combined by Fisher's rule; tokens of one case have no such runs,
    so for them collisions alone count. A short token cannot reach a small
    p_text, so its length limits what may be concluded from it.
    """

    def of(symbols: Column) -> Column:
        same = F.aggregate(F.array_distinct(symbols), F.lit(0.0), lambda s, c: s + F.pow(F.size(symbols) - F.size(F.array_remove(symbols, c)), F.lit(2)))
        k = F.length(alphabet)
        values = F.transform(symbols, lambda c: (F.position(c, alphabet) - 1).cast("double"))
        halves = let(values, lambda v: _pairs(v, lambda a, b: F.when((a < k / 2) != (b < k / 2), 1.0).otherwise(0.0)))
        serial = let(values, lambda v: _pairs(v, lambda a, b: (a - (k - 1) / 2) * (b - (k - 1) / 2)))
        switches = let(F.transform(symbols, _class), lambda v: _pairs(v, lambda a, b: F.when(a != b, 1.0).otherwise(0.0)))
        return let(F.struct(F.size(symbols).cast("double").alias("n"), k.cast("double").alias("k"), same.alias("same"), halves.alias("halves"), serial.alias("serial"), switches.alias("switches")), judge)

    def judge(x: Column) -> Column:
        n, k = x["n"], x["k"]
        chi = k / n * x["same"] - n
        z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        z_runs = (x["halves"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        z_serial = x["serial"] / F.sqrt(n - 1) / ((k * k - 1) / 12)
        total = F.pow(F.greatest(z_chi, F.lit(0.0)), F.lit(2)) + z_runs * z_runs + z_serial * z_serial
        # Wilson and Hilferty's cube root makes the sum of three squares nearly normal.
        uniform = _upper_tail((F.pow(total / 3, F.lit(1 / 3)) - (1 - 2 / 27)) / F.lit((2 / 27) ** 0.5))
        mean = n + n * (n - 1) * collision
        spread = F.sqrt(2 * n * (n - 1) * collision * (1 - collision) + F.lit(0.0048) * n * n * n)
        p_same = _upper_tail((mean - x["same"]) / spread)
        p_switch = _upper_tail((x["switches"] - (n - 1) * SWITCH_RATE) / F.sqrt((n - 1) * SWITCH_RATE * (1 - SWITCH_RATE)))
        half = -F.log(p_same) - F.log(p_switch)
        return F.struct(uniform.alias("p_uniform"), F.when(k == len(LOWER), p_same).otherwise(F.exp(-half) * (1 + half)).alias("p_text"))

    return let(F.array_remove(F.split(F.regexp_replace(token, "=+$", ""), ""), ""), of)


def _judged(tokens: Column) -> Column:
    """The candidates with encoding, p_uniform and p_text; mixed runs by their parts."""

    def parts(x: Column) -> Column:
        def cut(pieces: Column) -> Column:
            def piece(starts: Column) -> Column:
                span = lambda p, i: F.struct((x["start"] + F.get(starts, i)).alias("start"), (x["start"] + F.get(starts, i) + F.length(p)).alias("end"), p.alias("token"))
                return F.filter(F.transform(pieces, span), lambda y: F.length(y["token"]) >= LEAST)

            return let(_starts(F.transform(pieces, lambda p: F.length(p) + 1)), piece)

        return F.when(x["token"].rlike(MIXED), let(F.split(x["token"], "/"), cut)).otherwise(F.array(x))

    def of(x: Column) -> Column:
        kind = F.coalesce(*[F.when(x["token"].rlike(pattern), F.lit(name)) for name, pattern, _, _ in ENCODINGS])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["token"].alias("token"), kind.alias("encoding"))

    def tested(x: Column) -> Column:
        pick = lambda i: F.coalesce(*[F.when(x["encoding"] == e[0], F.lit(e[i])) for e in ENCODINGS])
        token = F.when(x["encoding"].isin("hex", "base36"), F.lower(x["token"])).otherwise(x["token"])
        return F.struct(*[x[c].alias(c) for c in ("start", "end", "encoding")], _battery(token, pick(2), pick(3)).alias("p"))

    return F.transform(F.transform(F.flatten(F.transform(tokens, parts)), of), tested)


def _log_bin(p: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-300)))).cast("int"))


def discovery_level(tested: DataFrame, rate: float) -> float:
    """The largest p_text that Benjamini and Hochberg's step-up rule accepts at ``rate``; -1 if none.

    ``tested`` has one row per token: p_text, random (whether uniform randomness stands). All
    tokens of the corpus count as hypotheses. They are ranked in bins of a tenth of a decade, each
    counted at its upper end, so at most ``BINS`` + 1 rows come to the driver at any corpus size.
    """
    rows = tested.groupBy(_log_bin(F.col("p_text")).alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col("random").cast("long")).alias("random")).collect()
    total, below, level = sum(r["n"] for r in rows), 0, -1.0
    for r in sorted(rows, key=lambda r: -r["bin"]):
        below += r["random"]
        p = 10 ** (-r["bin"] / 10)
        if p * total <= rate * below:
            level = p
    return level


def _found(text: Column) -> dict[str, Column]:
    """Spans of the three patterns (start, kind, end), and the judged tokens of a text."""
    of_kind = lambda spans, kind: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    return {
        "assign": of_kind(_spans(text, ASSIGN, 2, 8), 0),
        "access": of_kind(_spans(text, ACCESS), 1),
        "hex": of_kind(_spans(text, HEX), 2),
        "tokens": _judged(_spans(text, TOKEN)),
    }


def _level(tokens: DataFrame, rate: float) -> float:
    """The discovery level of rows with an array of judged tokens (``tokens``)."""
    rows = tokens.select(F.explode("tokens").alias("x"))
    return discovery_level(rows.select(F.col("x.p.p_text").alias("p_text"), (F.col("x.p.p_uniform") >= UNIFORM_LEVEL).alias("random")), rate)


def _overlaps(tokens: Column, spans: Column) -> Column:
    """Whether each of ``tokens`` overlaps one of ``spans``: the spans that start before its end less those that end by its start.

    Tokens are apart and in order. Both counts are running sums over the sorted places of both arrays.
    """
    def counted(place: str, token_place: str, span_first: int) -> Column:
        place_of = lambda x, at, flag, rank: F.struct(x[at].alias("at"), F.lit(rank).alias("rank"), F.lit(flag).alias("flag"))
        marks = F.array_sort(F.concat(F.transform(spans, lambda x: place_of(x, place, 1, 1 - span_first)), F.transform(tokens, lambda x: place_of(x, token_place, 0, span_first))))
        of_tokens = lambda m: let(_starts(F.transform(m, lambda x: x["flag"])), lambda n: F.filter(F.transform(m, lambda x, i: F.when(x["flag"] == 0, F.get(n, i))), lambda v: v.isNotNull()))
        return let(marks, of_tokens)

    return F.zip_with(counted("start", "end", 0), counted("end", "start", 1), lambda a, b: a > b)


def _with_random(base: Column, tokens: Column, level: float) -> Column:
    """All spans: the base ones, and the tokens that are discoveries at ``level`` and overlap none of them."""
    found = lambda x: (x["p"]["p_uniform"] >= UNIFORM_LEVEL) & (F.lit(10.0) ** (-_log_bin(x["p"]["p_text"]) / 10.0) <= F.lit(level * 1.0000001))
    as_span = lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end"))

    def added(chosen: Column) -> Column:
        free = F.filter(F.zip_with(chosen, _overlaps(chosen, base), lambda x, hit: F.when(~hit, as_span(x))), lambda x: x.isNotNull())
        # Most texts have no base span or no token: nothing to compare.
        return F.when((F.size(base) == 0) | (F.size(chosen) == 0), F.transform(chosen, as_span)).otherwise(free)

    return F.array_sort(F.concat(base, let(F.filter(tokens, found), added)))


def scan(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_spans, spans (arrays of start, kind, end).

    Base spans are those of the three patterns. The method adds spans of kind ``random``: maximal
    runs of ``LEAST`` token characters and more (or, where a run mixes + or / with - or _, its parts
    of that length between slashes) whose battery does not reject uniform randomness in their inferred
    encoding (``UNIFORM_LEVEL``) and whose p_text is a discovery at false-discovery ``rate`` among
    all tokens of the corpus. A random token that overlaps a base span is reported by that span
    alone. Spans are in code points, end exclusive, by start, then kind in the order of ``KINDS``.
    Null and empty texts have no spans; repeated rows count each; extra columns are ignored; an
    empty table gives no rows. Texts are read whole, once; what is kept between the two passes are
    spans and p-values, never texts.
    """
    found = docs.select("doc_id", text_or_empty().alias("text"))
    found = materialise(found.select("doc_id", *[c.alias(k) for k, c in _found(F.col("text")).items()]), "secret_spans")
    level = _level(found, rate)
    found = found.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    count = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.col("base").alias("base_spans"), _with_random(F.col("base"), F.col("tokens"), level).alias("spans"))


def mask(docs: DataFrame, text: Column, to: str, rate: float = 0.01, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the masked text as column ``to``; the secrets are those of ``scan``.

    The corpus is read twice: for the discovery level, of which a bounded histogram comes to the
    driver, and for the rewriting, which looks at one row at a time. Texts are never shuffled.
    """
    whole = F.coalesce(text, F.lit(""))
    level = _level(docs.select(_found(whole)["tokens"].alias("tokens")), rate)
    found = _found(whole)
    base = F.array_sort(F.concat(found["assign"], found["access"], found["hex"]))
    spans = let(F.struct(base.alias("base"), found["tokens"].alias("tokens")), lambda x: _with_random(x["base"], x["tokens"], level))
    return docs.withColumn(to, let(spans, lambda s: redact(whole, s, mark)))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = lambda x: F.get(F.array(*[F.lit(k) for k in KINDS]), x["kind"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span replaced by ``mark``; overlapping spans share one mark."""

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        later = x["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(later, F.concat(acc["out"], F.array(gap))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    end = lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))), mark)
    return F.when(F.size(spans) > 0, let(F.aggregate(spans, start, step), end)).otherwise(text)
