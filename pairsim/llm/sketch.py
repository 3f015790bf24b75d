"""Document fingerprints that keep every shingle hash below a fixed fraction.

A sketch is the sorted array of those hashes of five-word shingles that lie in
the lowest 1 / ``FRACTION`` of all 64-bit values, whatever the text's length; so documents of
very unequal length are compared on the same part of the hash space, and sketches merge by
union. A fingerprint is the sketch as text: 16 lowercase hex digits a hash.

Likeness is estimated containment: shared hashes over those of the smaller
sketch (1 where one text holds the other, 0 without a shared shingle). Its error falls with the
number of shingles of the smaller text; the README has figures.

Everything is DataFrame functions. Defined results: null texts count as empty; a text
of fewer than five words has one shingle, all of it; likeness of equal texts is 1.0, also
of two without words; where only one of two texts has a hash in the fraction, or neither has and
they differ, it is 0.0; equal texts have equal fingerprints; a text whose hashes all lie
above the fraction has an empty one, as a text without words; rows that repeat or share an id are
fingerprinted each; rows without an id have no next document; an empty table gives no rows; other columns
are ignored; a text of any length is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsim.functions.seeded import let
from pairsim.sources.scratch import durable

SHINGLE = 5
FRACTION = 4
#: Hashes are signed longs; the lowest fraction of them lies below this.
BELOW = -(1 << 63) + (1 << 64) // FRACTION


def _shingle_hashes(words: Column) -> Column:
    def hashes(w: Column) -> Column:
        n = F.size(w)
        several = F.transform(
            F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(w, i, SHINGLE))
        )
        none = F.array().cast("array<long>")
        return F.when(n == 0, none).when(n < SHINGLE, F.array(F.xxhash64(w))).otherwise(several)

    return let(words, hashes)


def _words(text: Column) -> Column:
    spaced = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(spaced, " "), "")


def sketch(text: Column) -> Column:
    """Sorted shingle hashes of a text below the fraction; case and the kind of white space don't count."""
    low = F.filter(_shingle_hashes(_words(text)), lambda x: x < F.lit(BELOW))
    return F.sort_array(F.array_distinct(low))


def fingerprint(hashes: Column) -> Column:
    """A sketch as text."""
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def merged(a: Column, b: Column) -> Column:
    """Sketch of two texts taken together."""
    return F.sort_array(F.array_union(a, b))


def likeness(a: Column, b: Column, equal: Column | None = None) -> Column:
    """Estimated containment of the smaller sketch in the other; ``equal`` texts are alike."""
    least = F.least(F.size(a), F.size(b))
    share = F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)
    return share if equal is None else F.when(equal, 1.0).otherwise(share)


def _blank(text: Column) -> Column:
    return F.size(_words(text)) == 0


def next_ids(ids: DataFrame) -> DataFrame:
    """``(doc_id, next_id, n)`` for distinct ``ids(doc_id, n)``: the next smaller id, and
    the largest after the smallest.

    Ids are dealt by range and looked up inside their range; only the largest id of
    each range goes through one task.
    """
    placed = ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id())
    placed = durable(placed)
    inside = F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    tops = placed.groupBy("part").agg(F.max("doc_id").alias("top"))
    every = Window.partitionBy()
    edges = tops.select(
        "part",
        F.coalesce(F.lag("top").over(every.orderBy("part")), F.max("top").over(every)).alias("edge"),
    )
    return placed.withColumn("before", inside).join(edges, "part").select(
        "doc_id", F.coalesce("before", "edge").alias("next_id"), "n"
    )


def sketch_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint of every row of ``docs(doc_id, text)``, of its edited text and its neighbour.

    The edit replaces the last floor(n_chars / 2) code points by the first as many (or
    all) of the next document in descending ``doc_id``. Where rows share an id, its
    smallest text is the next document for others; rows of null id have no next one.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named, nameless = rows.where(F.col("doc_id").isNotNull()), rows.where(F.col("doc_id").isNull())
    ids = named.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    order = next_ids(ids)
    # The joins deal the rows by this key, so the texts are shuffled once for both.
    same_key = Window.partitionBy("doc_id").orderBy("text")
    single = named.withColumn("before", F.lag("doc_id").over(same_key)).where(F.col("before").isNull())
    half = F.floor(F.col("n") / 2).cast("int")
    found = (
        order.withColumnRenamed("doc_id", "id")
        .join(single, F.col("next_id") == F.col("doc_id"))
        .select(
            "id",
            F.substring("text", F.lit(1), half).alias("start"),
            F.struct(
                F.xxhash64("text").alias("hash"), _blank(F.col("text")).alias("blank"), sketch(F.col("text")).alias("sketch")
            ).alias("next"),
        )
    )
    joined = named.join(found, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "start", "next")
    # Rows without an id meet no other, so no task gathers them.
    alone = nameless.select("doc_id", "text", F.lit(None).cast("string").alias("start"))
    joined = joined.unionByName(alone, allowMissingColumns=True)
    n = F.length("text")
    own_half = F.floor(n / 2).cast("int")
    start = F.coalesce("start", F.lit(""))
    edited = F.concat(
        F.substring("text", F.lit(1), n - own_half), F.substring(start, F.lit(1), own_half)
    )
    marked = joined.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next")
    none = F.array().cast("array<long>")
    text, edited = F.col("text"), F.col("edited")
    blank = _blank(text)
    sketched = marked.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch(text).alias("own"),
        sketch(edited).alias("changed"),
        F.coalesce("next.sketch", none).alias("following"),
        ((text == edited) | (blank & _blank(edited))).alias("same_edited"),
        F.coalesce(
            (F.xxhash64("text") == F.col("next.hash")) | (blank & F.col("next.blank")), F.lit(False)
        ).alias("same_next"),
    )
    own, changed, following = F.col("own"), F.col("changed"), F.col("following")
    return sketched.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(own).alias("fingerprint"),
        fingerprint(changed).alias("edited_fingerprint"),
        likeness(own, changed, F.col("same_edited")).alias("near_edited"),
        likeness(own, following, F.col("same_next")).alias("near_next"),
    )
