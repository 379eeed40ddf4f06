"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text is a multiset of units: its lines, cut further after sentence ends, and what is then longer than ``LONG`` characters
cut at words that end in certain letters, or else every ``PIECE`` characters. Each unit is hashed to a wide vector, and the
vectors are summed modulo powers of two, so that the order of units does not matter and a unit can be put in or taken out
by adding or subtracting its vector. The vector has 128 lanes of 0 or 1, summed modulo 2^32, two of them in a 64-bit word;
four wide lanes of 32 random bits, summed modulo 2^62, that only serve equality; and the number of units. A text has fewer
than 2^31 characters, so that no lane of one text wraps. All lanes come from four hashes with seeds of their own. Centred,
the 0/1 lanes are random signs: the dot product of two sums estimates that of the units' multiplicities (Alon, Matias and
Szegedy, 1996), with an error of 0.09 of the norms.

Units are exploded to rows and summed by document without another shuffle, so that a text of any number of units takes the
memory of its pieces and one vector.

Nulls and edges: a null text is an empty one; a text without units has the zero fingerprint; likeness of two empty texts
is 1, of an empty and another text 0. A row without doc_id comes before all others. Rows with one doc_id follow each other
in the order of their texts; where one id has so many rows that they fill more than one range, in the order of a hash of
their texts. Repeated rows stay rows. An empty table gives no rows; other columns are ignored. A very long text is one
row: it has to fit a task, whatever the number of its units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, table

#: Lines, and sentences within them.
UNIT = r"[\r\n]+|(?<=[.!?])[ \t]+"
#: Characters above which a unit is cut into pieces; a piece ends after a word with one of these last letters.
LONG, PIECE = 200, 256
PIECES = rf"(?s).{{1,{PIECE}}}?(?:(?<=[dgklm]) |$)|.{{{PIECE}}}"
#: Words of two 0/1 lanes, wide lanes, and all words with the number of units.
WORDS, WIDE = 64, 4
SIZE = WORDS + WIDE + 1
_LOW = (1 << 32) - 1
_TWO = 1 | 1 << 32
MODULUS = (1 << 62) - 1
#: The place of rows without doc_id.
NULL_ID = -(1 << 63)
#: Ranges of ids told apart by quantiles; bytes of text that a part of a range should hold.
RANGES, RANGE_BYTES = 256, 128 << 20


def units(text: Column) -> Column:
    """A text's lines and sentences; what is too long is cut by ``pieces``."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), UNIT), lambda u: u != "")


def pieces(unit: Column) -> Column:
    return F.when(F.length(unit) > LONG, F.regexp_extract_all(unit, F.lit(PIECES), F.lit(0))).otherwise(F.array(unit))


def vectors(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``(keys..., vector)``: the fingerprint of each row's text, an array of SIZE longs. The keys must tell rows apart.

    Rows that are partitioned by one of the keys are not shuffled.
    """
    found = rows.select(*keys, F.explode_outer(F.split(F.coalesce(F.col(text), F.lit("")), UNIT)).alias("_unit"))
    found = found.select(*keys, F.explode_outer(pieces(F.col("_unit"))).alias("_unit"))
    fine = F.coalesce(F.col("_unit") != "", F.lit(False))
    hashed = found.select(*keys, fine.cast("long").alias("_n"), *[F.when(fine, F.xxhash64(F.lit(i), "_unit")).otherwise(F.lit(0)).alias(f"_h{i}") for i in range(4)])
    lanes = [F.shiftrightunsigned(f"_h{i}", j).bitwiseAND(F.lit(_TWO)) for i in (0, 1) for j in range(32)]
    wide = [x for i in (2, 3) for x in (F.col(f"_h{i}").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(f"_h{i}", 32))]
    sums = [F.sum(x).alias(f"_s{i}") for i, x in enumerate([*lanes, *wide, F.col("_n")])]
    return hashed.groupBy(*keys).agg(*sums).select(*keys, F.array(*[F.col(f"_s{i}").bitwiseAND(F.lit(MODULUS)) if WORDS <= i < WORDS + WIDE else F.col(f"_s{i}") for i in range(SIZE)]).alias("vector"))


def _lanewise(a: Column, b: Column, sign: int) -> Column:
    def of(x: Column, y: Column, i: Column) -> Column:
        low = (x.bitwiseAND(F.lit(_LOW)) + y.bitwiseAND(F.lit(_LOW)) * sign).bitwiseAND(F.lit(_LOW))
        high = (F.shiftrightunsigned(x, 32) + F.shiftrightunsigned(y, 32) * sign).bitwiseAND(F.lit(_LOW))
        return F.when(i < WORDS, F.shiftleft(high, 32).bitwiseOR(low)).otherwise((x + y * sign).bitwiseAND(F.lit(MODULUS)))

    return F.transform(F.arrays_zip(a.cast("array<long>").alias("x"), b.cast("array<long>").alias("y")), lambda p, i: of(p["x"], p["y"], i))


def combine(a: Column, b: Column) -> Column:
    """Fingerprint of two texts' units together."""
    return _lanewise(a, b, 1)


def remove(a: Column, b: Column) -> Column:
    """Fingerprint of the units of ``a`` without those of ``b``."""
    return _lanewise(a, b, -1)


def as_text(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def signs(vector: Column) -> Column:
    """The centred lanes of a fingerprint."""
    n = F.element_at(vector, SIZE)
    counts = F.flatten(F.transform(F.slice(vector, 1, WORDS), lambda x: F.array(x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32))))
    return F.transform(counts, lambda c: (c * 2 - n).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(product: Column, norm_a: Column, norm_b: Column, same: Column) -> Column:
    """2 <a,b> / (<a,a> + <b,b>), held between 0 and 1."""
    ratio = F.when(norm_a + norm_b > 0, product * 2 / (norm_a + norm_b)).otherwise(F.lit(0.0))
    return F.when(same, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))


def _ranged(rows: DataFrame, ranges: int, range_bytes: int) -> tuple[DataFrame, int]:
    """``rows(order_id, text)`` with ``bin``, ranges of ids in their order, and ``tie``, the order within one id before the
    text's, and the number of partitions that hold them.

    Quantiles give at most ``ranges`` ranges, and each is cut further into equal widths by how much text there is. An id that
    fills several ranges on its own is cut by a hash of its texts.
    """
    points = [i / ranges for i in range(1, ranges)] or [0.5]
    found = rows.agg(F.percentile_approx("order_id", points, 20 * ranges), F.sum(F.octet_length("text")), F.min("order_id"), F.max("order_id"), F.min(F.when(F.col("order_id") > NULL_ID, F.col("order_id")))).first()
    cuts, size, least, most = found[0] or [], found[1] or 0, found[2] or 0, found[3] or 0
    parts = -(-size // (ranges * range_bytes)) or 1
    starts = sorted({least, *cuts, *([] if found[4] is None else [found[4]])})  # rows without doc_id are a range of their own
    times = [max(1, cuts.count(x)) for x in starts]
    ends = [*starts[1:], most + 1]
    hot = {x for x, n in zip(starts, times, strict=True) if n > 1}
    tie = F.shiftrightunsigned(F.xxhash64("text"), 1) if hot else F.lit(0).cast("long")
    rows = rows.withColumn("tie", F.when(F.col("order_id").isin(sorted(hot)), tie).otherwise(F.lit(0)) if hot else tie)

    def leaf(i: int) -> Column:
        width, base = ends[i] - starts[i], 2 * i << 32
        if parts > 1 and width > 1:
            share = (F.col("order_id").cast("double") - F.lit(float(starts[i]))) / F.lit(float(width))
            within = F.lit((2 * i + 1) << 32) + F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(share * parts))).cast("long")
        else:
            within = F.lit((2 * i + 1) << 32)
        if starts[i] not in hot:
            return within
        own = F.lit(base) + F.floor(F.col("tie") / F.lit(float(1 << 63)) * (times[i] * parts)).cast("long")
        return F.when(F.col("order_id") == F.lit(starts[i]), own).otherwise(within)

    def tree(low: int, high: int) -> Column:
        if high - low == 1:
            return leaf(low)
        mid = (low + high) // 2
        return F.when(F.col("order_id") < F.lit(starts[mid]), tree(low, mid)).otherwise(tree(mid, high))

    return rows.withColumn("bin", tree(0, len(starts))), len(starts) * parts


def with_next(docs: DataFrame, ranges: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(bin, place, ghost, doc_id, text, next_text)``: every document beside the next one by doc_id; the first follows the last.

    Documents are dealt into ranges of ids. The first of each range is sent to the range before it as well, where it comes
    last as a ghost. So whole texts are shuffled once, nothing is broadcast but a row for each range, and no task sees more
    than its ranges.
    """
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("order_id"))
    rows, bins = _ranged(rows, ranges or min(RANGES, least), range_bytes)
    heads = cut(rows.groupBy("bin").agg(F.min(F.struct("order_id", "tie")).alias("head")))
    order = Window.orderBy("bin")  # one row for each range
    heads = cut(heads.select("bin", "head", F.lag("bin").over(order).alias("before"), F.max("bin").over(Window.partitionBy()).alias("end")))
    heads = heads.select(F.col("bin").alias("head_bin"), "head", F.coalesce("before", "end").alias("for_bin"))
    met = rows.join(F.broadcast(heads), F.col("bin") == F.col("head_bin"))
    first = F.struct("order_id", "tie") == F.col("head")
    own, copy = F.struct(F.col("bin"), F.lit(0).alias("ghost")), F.struct(F.col("for_bin").alias("bin"), F.lit(1).alias("ghost"))
    dealt = met.select(F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))).alias("to"), "doc_id", "text", "order_id", "tie")
    dealt = dealt.select("to.bin", "to.ghost", "doc_id", "text", "order_id", "tie").repartition(max(least, bins), "bin")
    within = Window.partitionBy("bin").orderBy("ghost", "order_id", "tie", "text")
    led = dealt.select("bin", "ghost", "doc_id", "text", F.lead("text").over(within).alias("next_text"), F.row_number().over(within).alias("place"))
    return led.select("bin", "place", "ghost", "doc_id", "text", F.when(F.col("ghost") == 0, F.col("next_text")).alias("next_text"))


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last half replaced by as much of the beginning of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(text.substr(F.lit(1), F.length(text) - half), other.substr(F.lit(1), half))


def compare_edited(docs: DataFrame, ranges: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The fingerprints of every text and of its edited text, and how like they are to each other and the next one's."""
    rows = with_next(docs, ranges, range_bytes)
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), edited(F.col("text"), F.col("next_text")).alias("text")))
    both = rows.select("bin", "place", "ghost", "doc_id", F.explode(F.slice(kinds, 1, F.lit(2) - F.col("ghost"))).alias("x")).select("bin", "place", "ghost", "doc_id", "x.*")
    both = both.select("bin", "place", "ghost", "doc_id", "kind", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("kind") == 1, F.sha2("text", 256)).alias("sha"))
    found = vectors(both, ["bin", "place", "ghost", "doc_id", "kind", "n_chars", "sha"])
    found = found.withColumn("signs", signs(F.col("vector"))).withColumn("norm", dot(F.col("signs"), F.col("signs")))
    # In a range: a text, its edited text, the next text, ...; at last the first one of the next range.
    order = Window.partitionBy("bin").orderBy("place", "kind")
    one, two = F.lead(F.struct("vector", "signs", "norm", "sha")).over(order), F.lead(F.struct("vector", "signs", "norm"), 2).over(order)
    met = found.select("*", one.alias("new"), two.alias("next")).where("kind = 0 and ghost = 0")
    return met.select(
        "doc_id", "n_chars", F.col("new.sha").alias("edited_sha256"), as_text(F.col("vector")).alias("fingerprint"), as_text(F.col("new.vector")).alias("edited_fingerprint"),
        likeness(dot(F.col("signs"), F.col("new.signs")), F.col("norm"), F.col("new.norm"), F.col("vector") == F.col("new.vector")).alias("near_edited"),
        likeness(dot(F.col("signs"), F.col("next.signs")), F.col("norm"), F.col("next.norm"), F.col("vector") == F.col("next.vector")).alias("near_next"),
    )


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
