"""Document fingerprints by order MinHash, in DataFrame operations alone.

K-mers are runs of K words, numbered by occurrence, so that the second of two equal ones is another
than the first. One hash ranks the numbered k-mers on a circle, on which SLOTS points lie at equal distances; a slot takes the
TUPLE k-mers that follow its point, puts them back into the order of the text and hashes them. So every slot has a whole tuple, also
where a text has fewer k-mers than there are slots. Texts with the same k-mers in another
order agree in few slots, which makes the share of equal slots follow edit distance rather than overlap.
Words longer than LONGEST are taken as the overlapping runs of GRAM characters in them, so that an edit changes a few of these only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, in_order, let, read

K = 2
SLOTS = 64
TUPLE = 2
#: Low bits of a packed number that hold a k-mer's place.
PLACE = 24
#: Documents in a bucket of neighbours in the order of ids.
BUCKET = 500
#: Characters of the longest word that is taken whole, and of the runs in longer ones.
LONGEST, GRAM = 64, 8
_LOW = (1 << PLACE) - 1


def _at(array: str, i: Column) -> Column:
    return F.coalesce(F.get(F.col(array), i.cast("int")), F.lit(0).cast("long"))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the column `out`: an array of SLOTS longs in order, slot in the high bits and the tuple's 32-bit hash in the low.

    Null is an empty text, whose fingerprint is empty. Texts of white space or of fewer than K words have one k-mer,
    the whole. K-mers are named by 40 bits; beyond 2 ** 24 words the places of k-mers begin anew. Each step is a projection of its own, so that arrays are made once and not again for each element.
    """
    keep = df.columns
    tokens, sorted_, starts, packed = (f"__{x}" for x in "tsfp")
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.select(*keep, F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)).alias(tokens))
    long = lambda w: F.length(w) > LONGEST
    grams = lambda w: let(F.split(w, ""), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - GRAM), lambda i: F.concat(*[F.coalesce(F.get(c, (i + k).cast("int")), F.lit("")) for k in range(GRAM)])))
    cut = F.flatten(F.transform(F.col(tokens), lambda w: F.when(long(w), grams(w)).otherwise(F.array(w))))
    df = df.select(*keep, F.when(F.exists(tokens, long), cut).otherwise(F.col(tokens)).alias(tokens))
    n = F.size(tokens)
    place = lambda i: F.lit(_LOW).cast("long").bitwiseAND(i.cast("long"))
    pack = lambda h, i: h.bitwiseAND(F.lit(~_LOW).cast("long")).bitwiseOR(place(i))
    runs = F.transform(F.sequence(F.lit(0), n - K), lambda i: pack(F.xxhash64(*[F.get(F.col(tokens), (i + k).cast("int")) for k in range(K)]), i))
    single = F.array(pack(F.xxhash64(whole), F.lit(0)))
    none = F.array().cast("array<bigint>")
    df = df.select(*keep, F.sort_array(F.when(n >= K, runs).when(F.length(whole) > 0, single).otherwise(none)).alias(sorted_))
    kmer = lambda x: F.shiftright(x, PLACE)
    m = F.size(sorted_)
    new = lambda x, j: (j == 0) | (kmer(x) != kmer(_at(sorted_, j - 1)))
    begin = F.filter(F.transform(F.col(sorted_), lambda x, j: F.when(new(x, j), j).otherwise(F.lit(-1))), lambda j: j >= 0)
    df = df.select(*keep, sorted_, begin.alias(starts))
    rank = lambda x, nth: F.shiftrightunsigned(F.xxhash64(kmer(x), nth.cast("long")), 1).bitwiseAND(F.lit(~_LOW).cast("long")).bitwiseOR(x.bitwiseAND(F.lit(_LOW).cast("long")))
    end = lambda r: F.coalesce(F.get(F.col(starts), r + 1), m) - 1
    numbered = F.flatten(F.transform(F.col(starts), lambda f, r: F.transform(F.sequence(f, end(r)), lambda j: rank(_at(sorted_, j), j - f))))
    once = F.transform(F.col(sorted_), lambda x: rank(x, F.lit(0)))
    df = df.select(*keep, F.sort_array(F.when(F.size(starts) == m, once).otherwise(numbered)).alias(packed))
    return df.select(*keep, _tuples(packed).alias(out))


def _tuples(packed: str) -> Column:
    """For each slot the two k-mers that follow its point on the circle, in the order of the text, hashed. packed: ranked k-mers, sorted.

    The first k-mer after a point is found where slots change; it serves all slots that are passed there.
    """
    here, low = F.col(packed), F.lit(_LOW).cast("long")
    value = lambda x: F.shiftright(x, PLACE)
    slot = lambda x: F.shiftright(x, 63 - (SLOTS - 1).bit_length())
    before = lambda j: F.when(j == 0, F.lit(-1).cast("long")).otherwise(slot(_at(packed, j - 1)))

    def hashed(x: Column, j: Column) -> Column:
        y = _at(packed, F.when(j + 1 < F.size(here), j + 1).otherwise(F.lit(0)))
        forward = x.bitwiseAND(low) <= y.bitwiseAND(low)
        both = F.when(forward, F.xxhash64(value(x), value(y))).otherwise(F.xxhash64(value(y), value(x)))
        return both.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))

    first = lambda x, j: F.when(slot(x) != before(j), F.array_repeat(hashed(x, j), (slot(x) - before(j)).cast("int")))
    runs = F.flatten(F.filter(F.transform(here, first), lambda r: r.isNotNull()))
    # past the last k-mer the circle begins anew
    whole = let(runs, lambda r: F.concat(r, F.array_repeat(F.get(r, F.lit(0)), F.lit(SLOTS) - F.size(r))))
    return F.when(F.size(here) > 0, F.transform(whole, lambda h, s: F.shiftleft(s.cast("long"), 32).bitwiseOR(h))).otherwise(F.array().cast("array<bigint>"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal slots; 1 for two empty fingerprints, 0 where one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.lit(SLOTS))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda v: F.lpad(F.lower(F.hex(v)), 10, "0")), "")


def fingerprint_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint, and likeness to its edited text and to the next document's fingerprint, in descending order of ids.

    doc_id, n_chars, edited (the text), fingerprint, edited_fingerprint (arrays), near_edited, near_next. Ids may be of any type that has an order;
    null ids come last, rows that repeat an id in the order of their texts' first characters, then of a hash; after the last row comes the first, which
    for one row is itself. Rows are numbered in that order; BUCKET neighbours are shuffled together, with the row that follows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = in_order(rows, "doc_id", "text", descending=True)
    last = rows.agg(F.max("__doc")).first()[0] or 0
    own = F.struct(F.expr(f"__doc div {BUCKET}").alias("b"), F.col("__doc").alias("place"), F.lit(False).alias("guest"))
    # the first row of a bucket also follows the last of the bucket before, the very first the very last
    at = F.when(F.col("__doc") == 0, F.lit(last + 1)).otherwise(F.col("__doc"))
    guest = F.struct(F.floor((at - 1) / BUCKET).cast("long").alias("b"), at.cast("long").alias("place"), F.lit(True).alias("guest"))
    df = rows.select("doc_id", "text", F.inline(F.when(F.col("__doc") % BUCKET == 0, F.array(own, guest)).otherwise(F.array(own))))
    # fingerprints are taken where the neighbours have met, so that they don't move; the window finds its rows dealt and sorted
    df = with_fingerprint(df.repartition("b").sortWithinPartitions("b", "place"), "text", "fp")
    order = Window.partitionBy("b").orderBy("place")
    df = df.withColumn("next", F.lead(F.struct("text", "fp")).over(order)).filter(~F.col("guest"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next.text"), F.lit(1), half))
    df = df.select("doc_id", n.cast("long").alias("n_chars"), "fp", F.col("next.fp").alias("next_fp"), edited.alias("edited"))
    df = with_fingerprint(df, "edited", "edited_fp")
    return df.select("doc_id", "n_chars", "edited", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_with_next(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fingerprint")).alias("fingerprint"), as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
