"""Order MinHash fingerprints, in DataFrame functions only.

Word k-mers are numbered by occurrence, so a repeated k-mer counts each time.  The numbered k-mers' hashes fall into
``slots`` parts of one permutation; in each slot the ``keep`` smallest are put back into text order and hashed as a
tuple.  Unlike a plain MinHash, a slot changes when its k-mers change places: equality is sensitive to edits that move
text.  All work on a text is array functions within its row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Keyed, stage

SLOTS, KEEP, KMER = 32, 2, 3
#: Low bits of a packed value that hold a k-mer's place in the text.
PLACE = 30
#: What stands for a slot without a k-mer.
EMPTY = "-" * 16


def _let(value: Column, body) -> Column:
    """``body`` of a column that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text as an array."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def kmers(words: Column, k: int = KMER) -> Column:
    """Hash of each run of k words; of all words if there are fewer."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return _let(hashes, lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(
        F.size(h) <= k, F.array(F.xxhash64(h))).otherwise(F.transform(
            F.slice(h, 1, F.size(h) - (k - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))))


def numbered(hashes: Column) -> Column:
    """Packed values of all k-mers: the hash of (k-mer, occurrence number) in the high bits, the place in the low ones.

    If all k-mers differ each is number 0.  Otherwise they are sorted by (k-mer, place); in a run of equal k-mers the
    numbers count up.
    """
    low = (1 << PLACE) - 1

    def packed(h: Column, number: Column, place: Column) -> Column:
        return F.xxhash64(h, number).bitwiseAND(~low & (1 << 63) - 1).bitwiseOR(place.cast("long"))

    def by_runs(k: Column) -> Column:
        order = F.array_sort(F.transform(k, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        def number(s: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                              lambda i: (i == 0) | (F.get(s, i)["h"] != F.get(s, i - 1)["h"]))
            counts = _let(starts, lambda r: F.flatten(F.transform(
                r, lambda a, i: F.sequence(F.lit(0), F.coalesce(F.get(r, i + 1), F.size(s)) - a - 1))))
            return F.zip_with(s, counts, lambda x, n: packed(x["h"], n, x["i"]))
        return _let(order, number)

    return _let(hashes, lambda k: F.when(
        F.size(F.array_distinct(k)) == F.size(k), F.transform(k, lambda h, i: packed(h, F.lit(0), i))).otherwise(by_runs(k)))


def signature(text: Column, slots: int = SLOTS, keep: int = KEEP, k: int = KMER) -> Column:
    """Array of ``slots`` signed longs, null for a slot without a k-mer."""
    low = (1 << PLACE) - 1

    def pick(values: Column) -> Column:
        """values are sorted: the slot is in the highest bits, so a slot's k-mers lie side by side."""
        slot_of = lambda v: F.shiftright(v, 63 - (slots.bit_length() - 1))
        firsts = F.filter(F.sequence(F.lit(0), F.size(values) - 1),
                          lambda i: (i == 0) | (slot_of(F.get(values, i)) != slot_of(F.get(values, i - 1))))
        def slot(first: Column) -> Column:
            chosen = F.filter(F.slice(values, first + 1, keep), lambda v: slot_of(v) == slot_of(F.get(values, first)))
            ordered = F.transform(F.array_sort(F.transform(
                chosen, lambda v: F.struct(v.bitwiseAND(low).alias("place"), v.alias("v")))),
                lambda x: F.shiftright(x["v"], PLACE))
            return F.struct(slot_of(F.get(values, first)).cast("int").alias("slot"), F.xxhash64(ordered).alias("hash"))
        found = F.map_from_entries(F.transform(firsts, slot))
        return _let(found, lambda m: F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.element_at(m, i)))

    values = F.sort_array(numbered(kmers(words_of(text), k)))
    return _let(values, lambda v: F.when(
        F.size(v) == 0, F.array_repeat(F.lit(None).cast("bigint"), slots)).otherwise(pick(v)))


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda h: F.coalesce(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lit(EMPTY))), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal slots among those that either text fills; 1 for two texts without a word."""
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x, y)), lambda x: x.isNotNull()))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: F.coalesce(x, F.lit(False))))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used).cast("double")


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc, n_chars, following, half): each document's successor in ascending id, the first after the last.

    Ids are dealt out by range; the successor is found within a range, and over a range's end from a table of one
    row per range.
    """
    from pyspark.sql import Window

    ranged = stage(docs.select("doc", F.length("text").cast("long").alias("n_chars")).repartitionByRange("doc").select(
        "doc", "n_chars", F.spark_partition_id().alias("part")), "ids")
    ends = ranged.groupBy("part").agg(F.min("doc").alias("first"))
    # one row per partition: a window over all of them is bounded by their number
    whole = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lead("first").over(whole), F.min("first").over(
        whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inner = ranged.withColumn("following", F.lead("doc").over(Window.partitionBy("part").orderBy("doc")))
    return inner.join(ends, "part").select(
        "doc", "n_chars", F.coalesce("following", "after").alias("following"),
        F.floor(F.col("n_chars") / 2).cast("long").alias("half"))


def order_minhash(docs: DataFrame, slots: int = SLOTS, keep: int = KEEP, k: int = KMER) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, signature, edited_signature, near_edited, near_next) of every id.

    The edited text has the last floor(n_chars / 2) code points replaced by as many first ones of the next document
    (all, if that is shorter).  A null text is empty; an empty or wordless text has a signature of nulls.  Rows that
    share an id stay apart, in the order of ``Keyed``; a null id comes first.  Further columns are not read; an empty
    table gives no row; a table of one document is its own successor.
    """
    keyed = Keyed(docs)
    rows = keyed.texts.select("doc", F.coalesce("text", F.lit("")).alias("text"))
    order = stage(next_ids(rows), "successors")
    # each row once more for its predecessor, cut to what that needs
    asked = order.select(F.col("following").alias("doc"), F.col("doc").alias("before"), "half")
    parts = rows.join(asked, "doc").select(
        F.col("before").alias("doc"), F.expr("substring(text, 1, cast(half as int))").alias("lent"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - half as int))"), F.col("lent"))
    texts = rows.join(order.select("doc", "n_chars", "half", "following"), "doc").join(parts, "doc").select(
        "doc", "n_chars", "following", "text", edited.alias("edited_text"))
    made = stage(texts.select(
        "doc", "n_chars", "following", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        signature(F.col("text"), slots, keep, k).alias("signature"),
        signature(F.col("edited_text"), slots, keep, k).alias("edited_signature")), "order-minhash")
    after = made.select(F.col("doc").alias("following"), F.col("signature").alias("next_signature"))
    return keyed.with_ids(made.join(after, "following").select(
        "doc", "n_chars", "edited_sha256", "signature", "edited_signature",
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next")), doc="doc_id")
