"""Document fingerprints by Order MinHash, in SQL functions only.

The k-mers of a text are its runs of ``K`` consecutive words; a k-mer that occurs again gets the number of its occurrence, so each is
distinct. A hash deals the numbered k-mers into ``BINS`` bins; each bin keeps its two smallest, puts them in the order of the text, and
hashes the pair. Equal bins of two texts mean equal k-mers in equal order, so the share of equal bins falls with the edit
distance, moved passages included.

Numbered k-mers are packed into 63 bits: hash (its top bits are the bin), then position, so that sorting an array of numbers
finds minima and repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxfield import session

K, BINS = 5, 64
BIN_BITS, HASH_BITS, PLACE_BITS = 6, 37, 26
SPACES = " \t\n\x0b\f\r"
PLACE = (1 << PLACE_BITS) - 1


def _packed(value: Column, place: Column) -> Column:
    """63 bits: HASH_BITS of the hash, then the place."""
    return F.shiftleft(F.shiftrightunsigned(value, 64 - HASH_BITS), PLACE_BITS).bitwiseOR(place)


def _bin(x: Column) -> Column:
    return F.shiftright(x, HASH_BITS - BIN_BITS + PLACE_BITS)


def _kmer(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def with_signature(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with ``out``: an array of one number per bin in use (bin, then 24 bits of the hash of its pair), by bin.

    A text of fewer than K words is one k-mer; a text without words, or a null one, has an empty signature. Texts may have up to 2^26 words. Each step is
    a column of its own, so no step is computed once per element of the next.
    """
    keep = [F.col(c) for c in rows.columns]
    none = F.array().cast("array<bigint>")
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES))
    rows = rows.select(*keep, F.split(trimmed, r"[ \t-\r]+").alias("_words"))
    n = F.when((F.size("_words") == 1) & (F.col("_words")[0] == ""), F.lit(0)).otherwise(F.greatest(F.size("_words") - (K - 1), F.lit(1)))
    rows = rows.select(*keep, "_words", n.alias("_n"))
    kmers = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: _packed(F.xxhash64(F.slice("_words", i + 1, F.lit(K))), i.cast("bigint")))
    rows = rows.select(*keep, F.sort_array(F.when(F.col("_n") > 0, kmers).otherwise(none)).alias("_s"))

    # Starts of the runs of equal k-mers; only texts with repeats need numbers.
    run = F.filter(F.transform("_s", lambda x, i: F.when((i == 0) | (_kmer(x) != _kmer(F.get("_s", i - 1))), i)), lambda i: i.isNotNull())
    repeats = F.size(F.filter("_s", lambda x, i: (i > 0) & (_kmer(x) == _kmer(F.get("_s", i - 1))))) > 0
    rows = rows.select(*keep, "_s", F.when(repeats, run).alias("_runs"))

    def number(start: Column, j: Column) -> Column:
        end = F.coalesce(F.get("_runs", j + 1), F.size("_s"))
        again = lambda x, o: F.when(o == 0, x).otherwise(_packed(F.xxhash64(_kmer(x), o), x.bitwiseAND(F.lit(PLACE).cast("bigint"))))
        return F.transform(F.slice("_s", start + 1, end - start), again)

    numbered = F.when(F.col("_runs").isNull(), F.col("_s")).otherwise(F.sort_array(F.flatten(F.transform("_runs", number))))
    rows = rows.select(*keep, numbered.alias("_s"))
    least = F.filter("_s", lambda x, i: (i < 2) | (_bin(x) != _bin(F.get("_s", i - 2))))
    rows = rows.select(*keep, least.alias("_p"))

    def pair(x: Column, i: Column) -> Column:
        y = F.get("_p", i + 1)
        place = F.lit(PLACE).cast("bigint")
        hashed = (
            F.when(y.isNull() | (_bin(x) != _bin(y)), F.xxhash64(_kmer(x)))
            .when(x.bitwiseAND(place) < y.bitwiseAND(place), F.xxhash64(_kmer(x), _kmer(y)))
            .otherwise(F.xxhash64(_kmer(y), _kmer(x)))
        )
        entry = F.shiftleft(_bin(x), 24).bitwiseOR(F.shiftrightunsigned(hashed, 40)).cast("int")
        return F.when((i == 0) | (_bin(x) != _bin(F.get("_p", i - 1))), entry)

    return rows.select(*keep, F.filter(F.transform("_p", pair), lambda e: e.isNotNull()).alias(out))


def hexadecimal(signature: Column) -> Column:
    """Eight hex digits per bin in use."""
    return F.array_join(F.transform(signature, lambda e: F.lpad(F.lower(F.hex(e)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among the bins that either signature uses; 1 for two empty signatures, 0 if only one is empty."""
    used = F.size(F.array_union(F.transform(a, lambda e: F.shiftright(e, 24)), F.transform(b, lambda e: F.shiftright(e, 24))))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def _ranked(groups: DataFrame, *order: Column) -> DataFrame:
    """``groups`` with ``rank``, 0 to n - 1 in the given order: numbers within range partitions plus the sizes of those before."""
    placed = groups.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = session.cut(placed.withColumn("_part", F.shiftright("_m", 33)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"), F.min("_m").alias("_first"))
    # One row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return placed.join(sizes, "_part").withColumn("rank", F.col("_before") + F.col("_m") - F.col("_first")).drop("_m", "_part", "_first", "_before")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, signature, edited_signature, next_signature) of every document and of its edited text.

    The edited text replaces the last floor(n_chars / 2) characters by the first as many (or all) of the next document, in the order of
    falling doc_id, and after the last of the first. ``docs`` needs ``doc_id`` and ``text``; other columns are not read. One row per input
    row. A null text is empty. Rows of one doc_id go by a hash of the text; of equal rows each is next to the one before it. A null doc_id
    comes last. A single row is its own next. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # A key without nulls, so that joins need no other shuffle than the one that deals the texts out.
    key = ["id", "no_id", "h"]
    rows = rows.select(F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("h"), "text")
    groups = rows.groupBy(*key).agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("n_chars"))
    ranked = session.cut(_ranked(groups, F.col("no_id").asc(), F.col("id").desc(), F.col("h").asc()))
    n = ranked.count()
    follows = ranked.select(F.pmod(F.col("rank") - 1, F.lit(max(n, 1))).alias("rank"), *[F.col(c).alias(f"next_{c}") for c in key])
    asked = ranked.join(follows, "rank").select(*[F.col(c).alias(f"own_{c}") for c in key], "copies", F.floor(F.col("n_chars") / 2).cast("int").alias("half"), *[f"next_{c}" for c in key])

    # Texts by their key; the k-th of equal rows. Both uses below read the same columns, so Spark deals the texts out once.
    signed = with_signature(rows, "text", "signature").repartition(*key)
    signed = signed.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("h")))
    first = signed.where("k = 1").select(*[F.col(c).alias(f"first_{c}") for c in key], "text", "signature")
    answers = asked.join(first, [F.col(f"next_{c}") == F.col(f"first_{c}") for c in key])
    answers = answers.select(*[f"own_{c}" for c in key], "copies", "half", F.substring("text", F.lit(1), F.col("half")).alias("head"), F.col("signature").alias("next_signature"))
    met = signed.join(answers, [F.col(c) == F.col(f"own_{c}") for c in key])
    last = F.col("k") == F.col("copies")
    head = F.when(last, F.col("head")).otherwise(F.substring("text", F.lit(1), F.col("half")))
    n_chars = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n_chars - F.col("half")), head)
    met = met.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), n_chars.cast("bigint").alias("n_chars"), edited.alias("edited"), "signature",
        F.when(last, F.col("next_signature")).otherwise(F.col("signature")).alias("next_signature"),
    )
    return with_signature(met, "edited", "edited_signature")
