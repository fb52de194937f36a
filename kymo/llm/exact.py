"""Exact document fingerprints, with DataFrame functions only.

The canonical text is NFKC composed, fully case-folded and composed again, with every run of white space one space and
none at the ends. Its fingerprint is two 64-bit xxHash values in a row (the second with another start), 32 hex digits.
Texts whose fingerprints are equal are compared byte by byte; should any differ, each further text of the bucket gets its
place in byte order behind its fingerprint. Only buckets of two or more rows are read again for that.

Cases: a null text is the empty text; equal texts have equal fingerprints; rows with equal ids are each fingerprinted, and
stand next to each other in the order of their texts' hashes; a table of one row is its own next document; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Fingerprints that are broadcast at most (32 bytes each); more of them meet the texts in a shuffle.
BROADCAST_ROWS = 500_000
#: Rows of a slice of the id order, and slices at most.
SLICE_ROWS, SLICES = 4000, 10_000


def canonical(text: Column) -> Column:
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    return F.trim(F.regexp_replace(again, r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """Two xxHash values of 64 bits; the second starts from the hash of a fixed word."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("wide"), canon)), 16, "0")))


def unequal(docs: DataFrame, text_col: str = "text", digest_of=digest) -> DataFrame:
    """(``fingerprint``, ``canon``, ``place``) of every different text of the buckets that hold more than one text."""
    marked = docs.select(canonical(F.coalesce(F.col(text_col), F.lit(""))).alias("canon")).withColumn("fingerprint", digest_of(F.col("canon")))
    many = written(marked.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint"), "buckets")
    if many.count() <= BROADCAST_ROWS:
        many = F.broadcast(many)
    ends = marked.join(many, "fingerprint", "left_semi").groupBy("fingerprint").agg(F.min("canon").alias("low"), F.max("canon").alias("high"))
    clash = written(ends.filter("low <> high").select("fingerprint"), "clashes")
    texts = marked.join(clash, "fingerprint", "left_semi").distinct()
    return written(texts.withColumn("place", F.row_number().over(Window.partitionBy("fingerprint").orderBy("canon")) - 1), "places")


def fingerprinted(docs: DataFrame, columns: dict[str, str], places: DataFrame | None, digest_of=digest) -> DataFrame:
    """``docs`` with a fingerprint column (value) for each text column (key). ``places``: what ``unequal`` gives, if it has rows."""
    for text, name in columns.items():
        docs = docs.withColumn("_canon", canonical(F.col(text))).withColumn(name, digest_of(F.col("_canon")))
        if places is not None:
            docs = docs.join(places.select(F.col("fingerprint").alias(name), F.col("canon").alias("_canon"), "place"), [name, "_canon"], "left")
            docs = docs.withColumn(name, F.when(F.col("place") > 0, F.concat_ws("-", name, "place")).otherwise(F.col(name))).drop("place")
        docs = docs.drop("_canon")
    return docs


def slice_bounds(ids: DataFrame, id_col: str, n: int) -> list:
    """The least id of each of some ``n`` ranges of about as many rows, but the first: at most ``SLICES`` values of any type that has an order."""
    ranges = ids.repartitionByRange(n, id_col).groupBy(F.spark_partition_id().alias("p")).agg(F.min(id_col).alias("least"))
    return sorted({r.least for r in ranges.collect()})[1:]


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Each row with ``next_<column>`` of the row that follows in falling order of ids; after the last comes the first.

    The ids, of any type that has an order, are cut into slices by sampled ranges. The first row of each slice is also dealt to the slice before it, so one
    shuffle brings every row and its follower together, and no task holds more than a slice.
    """
    ids = docs.filter(F.col(id_col).isNotNull()).select(id_col)
    n = min(SLICES, max(1, -(-ids.count() // SLICE_ROWS)))
    bounds = slice_bounds(ids, id_col, n) if n > 1 else []
    width = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    place = F.lit(0)
    if blocks:
        coarse = F.size(F.filter(F.array(*[F.lit(b[-1]) for b in blocks[:-1]]), lambda x: x <= F.col(id_col))) if len(blocks) > 1 else F.lit(0)
        fine = F.size(F.filter(F.element_at(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), coarse + 1), lambda x: x <= F.col(id_col)))
        place = coarse * width + fine
    tie = [F.col(id_col).desc_nulls_last(), F.xxhash64(*columns)]
    firsts = {r.p: r.m for r in docs.select(place.alias("p"), id_col).groupBy("p").agg(F.max(id_col).alias("m")).collect()}  # a row for each slice
    if not firsts:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    full = sorted(firsts)
    above = dict(zip(full, [*full[1:], full[0]], strict=True))
    most = F.array(*[F.lit(firsts.get(k)) for k in range(full[-1] + 1)])
    goes = F.array(*[F.lit(above.get(k, 0)) for k in range(full[-1] + 1)])
    p = F.col("_slice")
    row = lambda at, ghost: F.struct(at.cast("int").alias("slice"), F.lit(ghost).alias("ghost"))
    dealt = docs.withColumn("_slice", place).withColumn("_to", F.explode(F.when(F.col(id_col).eqNullSafe(F.element_at(most, p + 1)), F.array(row(p, False), row(F.element_at(goes, p + 1), True))).otherwise(F.array(row(p, False)))))
    order = Window.partitionBy("_to.slice").orderBy("_to.ghost", *tie)
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).filter(~F.col("_to.ghost")).drop("_slice", "_to")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its text, that of the next one, and its text with the last third replaced by the next one's begin."""
    named = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pairs = with_next(named, id_col, ["text"]).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    return pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)))


def op4_exact_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    places = unequal(docs)
    found = fingerprinted(edited(docs), {"text": "fingerprint", "edited": "edited_fingerprint", "next_text": "next_fingerprint"}, None if places.isEmpty() else places)
    like = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))
