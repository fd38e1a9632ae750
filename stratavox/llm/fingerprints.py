"""Document fingerprints: a homomorphic multiset hash of paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, text_or_empty

#: Wide lanes, each a sum of 62-bit paragraph hashes modulo 2^62: equality of multisets.
WIDE, WIDE_MASK = 8, (1 << 62) - 1
#: Packed lanes: three counters modulo 2^20 in one long, each with a guard bit for its carry.
PACKED, STEP = 42, 21
ONE = 1 | 1 << STEP | 1 << 2 * STEP
LANE = (1 << 20) - 1
PACKED_MASK = LANE | LANE << STEP | LANE << 2 * STEP
#: Units longer than this are cut behind words that end in these characters: an edit moves the cuts beside it alone.
LONG_UNIT, CUT = 200, r"(?<=[dgklmrty,;:\u0400-\uFFFF])\x20"
#: At most this many buckets of neighbouring ids.
MAX_BUCKETS, ROWS_A_BUCKET, COARSE = 65_536, 1_500, 256


def _paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda p: p.rlike(r"[^\x20\x09-\x0D]"))


def _sentences(text: Column) -> Column:
    """The units of the likeness lanes: sentences, and those that are longer than ``LONG_UNIT`` cut by their content."""
    pieces = F.transform(F.split(text, r"\n|(?<=[.!?])\x20"), lambda p: F.when(F.length(p) > LONG_UNIT, F.split(p, CUT)).otherwise(F.array(p)))
    return F.filter(F.flatten(pieces), lambda p: p.rlike(r"[^\x20\x09-\x0D]"))


def fingerprint(text: Column) -> Column:
    """array<long>: WIDE sums over paragraphs, PACKED sums over their sentences, and their number.

    Each paragraph contributes one vector: 62-bit hashes of the whole paragraph in the wide lanes,
    and for each of its sentences (or parts of long ones) one bit a packed lane. The fingerprint is the sum of the
    paragraphs' vectors modulo powers of two, so it does not depend on their order, and paragraphs
    can be put in or taken out (``insert``, ``delete``) without the rest of the text. Blank
    paragraphs contribute nothing; a null or empty text has the zero vector. Two texts with equal
    multisets of paragraphs have equal fingerprints; others collide with a chance of about 2^-62 a lane.
    """
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    put = lambda acc, p: F.transform(acc, lambda a, i: (a + F.xxhash64(i, p).bitwiseAND(F.lit(WIDE_MASK))).bitwiseAND(F.lit(WIDE_MASK)))
    wide = F.aggregate(_paragraphs(text), zeros(WIDE), put)

    def tick(acc: Column, s: Column) -> Column:
        hashes = F.struct(F.xxhash64(F.lit(101), s).alias("a"), F.xxhash64(F.lit(202), s).alias("b"))

        def add(h: Column) -> Column:
            # Packed long i counts bits i, i + 21 and i + 42 of its hash.
            bits = lambda i: (F.call_function("shiftrightunsigned", F.when(i < STEP, h["a"]).otherwise(h["b"]), i % STEP)).bitwiseAND(F.lit(ONE))
            return F.transform(acc, lambda a, i: (a + bits(i)).bitwiseAND(F.lit(PACKED_MASK)))

        return let(hashes, add)

    of = lambda sentences: F.concat(F.aggregate(sentences, zeros(PACKED), tick), F.array(F.size(sentences).cast("long")))
    return F.concat(wide, let(_sentences(text), of))


def _lanewise(a: Column, b: Column, f_wide, f_packed, f_count) -> Column:
    n = WIDE + PACKED
    rows = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda r, i: F.when(i < WIDE, f_wide(r["x"], r["y"])).when(i < n, f_packed(r["x"], r["y"])).otherwise(f_count(r["x"], r["y"])))
    return rows


def insert(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of ``a`` and ``b`` together."""
    return _lanewise(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(WIDE_MASK)), lambda x, y: (x + y).bitwiseAND(F.lit(PACKED_MASK)), lambda x, y: x + y)


def delete(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` without the paragraphs of ``b``, which it must hold."""
    # Guard bits lend to the lanes that would borrow.
    guards = (1 << 20) * ONE
    return _lanewise(a, b, lambda x, y: (x + (F.lit(WIDE_MASK) - y) + 1).bitwiseAND(F.lit(WIDE_MASK)), lambda x, y: (x + (F.lit(guards) - y)).bitwiseAND(F.lit(PACKED_MASK)), lambda x, y: x - y)


def _signs(f: Column) -> Column:
    """The packed lanes as sums of +1 and -1: what each sentence adds is independent between lanes."""
    n = F.get(f, F.lit(WIDE + PACKED))
    lane = lambda a, k: 2 * F.shiftright(a, k * STEP).bitwiseAND(F.lit(LANE))
    return F.flatten(F.transform(F.slice(f, WIDE + 1, PACKED), lambda a: F.array(*[(lane(a, k) - n).cast("double") for k in range(3)])))


def likeness(a: Column, b: Column) -> Column:
    """Share of sentences (and parts of long ones) that two fingerprints have in common, 0 to 1.

    The sums of signs are a linear sketch: their scalar products estimate those of the sentence
    multisets, with a standard error of about 1 / sqrt(126). Equal fingerprints give exactly 1, as
    do two empty texts; an empty and a non-empty text give 0.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    est = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * x["c"] / (x["a"] + x["b"])))
    parts = lambda v: F.struct(dot(v["x"], v["x"]).alias("a"), dot(v["y"], v["y"]).alias("b"), dot(v["x"], v["y"]).alias("c"))
    value = let(let(F.struct(_signs(a).alias("x"), _signs(b).alias("y")), parts), lambda x: F.when(x["a"] + x["b"] > 0, est(x)).otherwise(F.lit(0.0)))
    return F.when(a == b, F.lit(1.0)).otherwise(value)


def fingerprint_text(f: Column) -> Column:
    """The lanes in hexadecimal, packed as base64 without line breaks."""
    packed = F.base64(F.unhex(F.array_join(F.transform(f, lambda x: F.lpad(F.hex(x), 16, "0")), "")))
    return F.replace(packed, F.lit("\r\n"), F.lit(""))


def _bucket(ids: DataFrame, n_rows: int) -> Column:
    """A function of ``key`` that deals neighbouring ids to buckets of about ``ROWS_A_BUCKET`` rows.

    Up to 256 quantiles of the ids, each interval cut into equal widths. A bucket number is larger
    for larger ids. There are at most ``MAX_BUCKETS``.
    """
    buckets = max(1, min(MAX_BUCKETS, n_rows // ROWS_A_BUCKET))
    coarse = min(COARSE, buckets)
    parts = -(-buckets // coarse)
    at = ids.agg(F.percentile_approx("key", [i / coarse for i in range(coarse + 1)], 10_000), F.min("key"), F.max("key")).first()
    edges = sorted({at[1], at[2], *at[0]})
    lower, upper = edges[:-1] or edges, edges[1:] or edges
    literal = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")  # noqa: E731  folded into one literal
    lows, highs = literal(lower), literal(upper)
    index = F.greatest(F.lit(1), F.size(F.filter(lows, lambda x: x <= F.col("key"))))

    def fine(i: Column) -> Column:
        lo, hi = F.get(lows, i - 1).cast("double"), F.get(highs, i - 1).cast("double")
        part = F.floor((F.col("key").cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * parts)
        return (i - 1) * parts + F.greatest(F.lit(0), F.least(F.lit(parts - 1), part))

    return let(index, fine).cast("long")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document beside the next one in descending doc_id, cyclically.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (arrays), near_edited,
    near_next. The edited text is the document with its last floor(n/2) code points replaced by
    the first as many of the next one. Texts move once, to the bucket of their ids; the first
    document of each bucket goes to the bucket before as well, found from the ids alone. A null
    text counts as empty; null ids come last; repeated rows of one id follow one another by text;
    a lone document is its own next; an empty table gives no rows; extra columns are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key")
    ids = docs.select(key)
    n_rows = ids.count()
    if not n_rows:
        return _pair_columns(docs.select("doc_id", text_or_empty().alias("text")).withColumns({"next": F.col("text"), "own": fingerprint(F.col("text")), "after": fingerprint(F.col("text"))}))
    bucket = _bucket(ids, n_rows)
    # One row per bucket, at most MAX_BUCKETS: the bucket before gets a copy of the largest id.
    first = ids.groupBy(bucket.alias("bucket")).agg(F.max("key").alias("first_key"))
    over = Window.orderBy(F.col("bucket").desc())
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = first.select("first_key", F.coalesce(F.lag("bucket").over(over), F.min("bucket").over(whole)).alias("before"))
    rows = docs.select("doc_id", key, text_or_empty().alias("text"))
    rows = rows.join(F.broadcast(first), F.col("key") == F.col("first_key"), "left")
    to = F.filter(F.array(F.struct(bucket.alias("bucket"), F.lit(0).alias("copy")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("copy"))), lambda x: x["bucket"].isNotNull())
    rows = rows.select("doc_id", "key", "text", F.inline(to))
    order = Window.partitionBy("bucket").orderBy("copy", F.col("key").desc(), "text")
    rows = rows.withColumn("next", F.lead("text").over(order)).withColumn("own", fingerprint(F.col("text")))
    rows = rows.withColumn("after", F.lead("own").over(order)).filter("copy = 0")
    return _pair_columns(rows)


def _pair_columns(rows: DataFrame) -> DataFrame:
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("own").alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "after")
    return rows.withColumns({"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("after"))}).drop("after")
