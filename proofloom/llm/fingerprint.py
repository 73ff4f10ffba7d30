"""Threshold-scaled document sketches: every shingle hash below a fixed fraction is kept, the least one of a text without any. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind, bucket_bits, free_name, hash_bucket, written
from .quality import word_list

#: Production: five-word shingles, one hash in four.
WORDS, SCALE = 5, 4


def shingles(text: Column, words: int = WORDS) -> Column:
    """Shingle hashes (unsigned 32 bit range, as long) in text order.

    A text of fewer words than a shingle is one shingle of all its words; no words: no shingle.
    """

    def of(w: Column) -> Column:
        h = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 32)
        many = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: h(*[F.get(w, i + k) for k in range(words)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < words, F.array(h(F.array_join(w, " ")))).otherwise(many)

    return bind(word_list(F.lower(F.coalesce(text, F.lit("")))), of)


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """Sorted distinct shingle hashes below 2**32 / scale; the least hash where none is below: only a text without shingles has an empty sketch.

    merged() gives the sketch of several texts' shingles together from theirs.
    """
    top = (1 << 32) // scale

    def of(h: Column) -> Column:
        least = F.when(F.size(h) == 0, h).otherwise(F.array(F.array_min(h)))
        return bind(F.filter(h, lambda x: x < top), lambda low: F.when(F.size(low) == 0, least).otherwise(F.array_sort(F.array_distinct(low))))

    return bind(shingles(text, words), of)


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the shingles of two texts together, from their sketches: all hashes below the bound, or the least of all if none is.

    Any order of merges gives the same; a null sketch adds nothing.
    """
    none = F.array().cast("array<bigint>")
    both = F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))
    return bind(both, lambda x: F.when(F.get(x, 0) >= (1 << 32) // scale, F.slice(x, 1, 1)).otherwise(F.filter(x, lambda h: h < (1 << 32) // scale)))


def as_text(kept: Column) -> Column:
    """A sketch as text: eight hex digits a hash, in ascending order."""
    return F.array_join(F.transform(kept, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def jaccard(a: Column, b: Column) -> Column:
    """Estimated likeness: shared hashes over all hashes of both; 1 if both sketches are equal, as are those of two texts without shingles."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def containment(a: Column, b: Column, text_b: Column | None = None, words: int = WORDS, scale: int = SCALE) -> Column:
    """Estimated share of a's shingles that b has, however unequal the two are; 1 for an a without shingles.

    b's sketch may lack a hash from the bound on that its text has: an a of such a hash is looked up in the shingles of
    text_b; without text_b it counts as lacking.
    """
    share = F.size(F.array_intersect(a, b)) / F.size(a)
    if text_b is not None:
        above = F.array_contains(shingles(text_b, words), F.get(a, 0)).cast("double")
        share = F.when(F.get(a, 0) >= (1 << 32) // scale, above).otherwise(share)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(share)


#: Quantiles of the keys that the ranges are cut from; each is split further where it holds more rows than a range should.
CUTS, RANGE_ROWS = 1024, 256


def _ranges(docs: DataFrame, key: str, order: Column) -> Column:
    """A number of the range that a row falls into, rising with (key, order); null keys come first.

    The keys' quantiles (CUTS numbers, which come to the driver) give ranges of like counts, however the keys are spread. Each is
    split by equal widths of the key; its last key, and null, by the top bits of order: a key with many rows is the last of a range.
    """
    n = docs.count()
    cuts = min(CUTS, max(1, n // RANGE_ROWS))
    found = docs.agg(F.percentile_approx(key, [(i + 1) / cuts for i in range(cuts)], 20 * CUTS), F.min(key)).first()
    ends = sorted(set(found[0] or [0]))
    starts = [found[1] if found[1] is not None else 0, *[e + 1 for e in ends[:-1]]]
    bits = bucket_bits(-(-n // cuts), RANGE_ROWS)
    step = 32
    groups = [ends[i : i + step] for i in range(0, len(ends), step)]
    lit = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    below = lambda a, k: F.size(F.filter(a, lambda e: e < k))
    k = F.col(key).cast("long")
    coarse = F.least(below(lit([g[-1] for g in groups]), k), F.lit(len(groups) - 1))
    place = coarse * step + below(F.element_at(F.array(*[lit(g) for g in groups]), coarse + 1), k)
    place = F.least(place, F.lit(len(ends) - 1))
    low, high = F.element_at(lit(starts), place + 1), F.element_at(lit(ends), place + 1)
    share = F.greatest((k - low).cast("double") / F.greatest(high - low, F.lit(1)).cast("double"), F.lit(0.0))
    within = F.when(k < high, F.least(F.floor(share * (1 << bits)), F.lit((1 << bits) - 1))).otherwise(hash_bucket(order, bits) + (1 << bits))
    return F.when(k.isNull(), hash_bucket(order, bits) - (1 << bits)).otherwise(place.cast("long") * (2 << bits) + within)


def with_next(docs: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """Adds next_<c> for c in kept: the values of the row after, ascending key, after the last the first.

    Rows fall into ranges of about RANGE_ROWS rows, one window each; the first row of a range goes
    to the range before as well, so texts move once and no task gets more than a range. Null keys come
    first; rows with equal keys are ordered by hashes of their kept values. A single row is its own next. Columns of the added names
    are replaced.
    """
    docs = docs.drop(*[f"next_{c}" for c in kept])
    hashed, cell, head, before, at = (free_name(docs.columns, c) for c in ("order", "cell", "head", "before", "at"))
    rows = docs.withColumn(hashed, F.xxhash64(*kept))
    rows = rows.withColumn(cell, _ranges(docs.select(key), key, F.col(hashed)))
    first = F.min(F.struct(F.col(key).isNotNull().alias("some"), F.col(key).alias("key"), F.col(hashed).alias("order")))
    heads = written(rows.groupBy(cell).agg(first.alias(head)), "heads")
    parts = F.floor(F.col(cell) / 4096)  # two levels: the last range of a block of ranges, then within blocks
    blocks = heads.groupBy(parts.alias("block")).agg(F.max(cell).alias("last"))
    last = heads.agg(F.max(cell)).first()[0]
    blocks = blocks.select("block", F.coalesce(F.lag("last").over(Window.orderBy("block")), F.lit(last)).alias("wrap"))
    heads = heads.withColumn("block", parts).join(blocks, "block")
    heads = heads.select(cell, head, F.coalesce(F.lag(cell).over(Window.partitionBy("block").orderBy(cell)), F.col("wrap")).alias(before))
    joined = rows.join(heads, cell)  # broadcast by Spark where the heads' table is small
    own = F.struct(F.col(cell).alias("cell"), F.lit(0).alias("guard"))
    guard = F.struct(F.col(before).alias("cell"), F.lit(1).alias("guard"))
    is_head = F.col(key).eqNullSafe(F.col(f"{head}.key")) & (F.col(hashed) == F.col(f"{head}.order"))
    joined = joined.withColumn(at, F.explode(F.when(is_head, F.array(own, guard)).otherwise(F.array(own)))).drop(cell, head, before)
    w = Window.partitionBy(f"{at}.cell").orderBy(F.col(f"{at}.guard"), F.col(key).asc_nulls_first(), F.col(hashed))
    ahead = joined.withColumns({f"next_{c}": F.lead(c).over(w) for c in kept})
    return ahead.where(f"{at}.guard = 0").drop(at, hashed)
