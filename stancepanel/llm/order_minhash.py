"""Document fingerprints by order MinHash, in DataFrame functions only.

The k-mers of a text are pairs of neighbouring words, each numbered by its occurrence, so that repeats count. Each sign
of a script that is written without spaces is a word. Hashed k-mers fall into bins; of each bin the smallest ones of the
whole text are selected, put back into text order, and hashed as a tuple. A tuple survives an edit only if its k-mers
and their order do, which follows edit distance and not just the set of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stancepanel.functions.numbering import number_rows

BINS, PER_TUPLE = 64, 2
BIN_PLACE = 64 - (BINS - 1).bit_length()  # the bin is the top bits of a hash, so sorted k-mers lie bin by bin
# Scripts that are written without spaces between words: each of their signs is a word.
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}])"
PLACE_BITS = 24
HASH = -(1 << PLACE_BITS)  # mask of a k-mer's hash; the low bits hold its place in the text
PLACE = (1 << PLACE_BITS) - 1
WIDTH = 8
NOTHING = "-" * WIDTH


def bound(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times."""
    return F.transform(F.array(value), body)[0]


def numbered_kmers(text: Column) -> Column:
    """The PER_TUPLE smallest occurrence-numbered k-mers of each bin, hash and place in one long each."""
    words = F.filter(F.split(F.regexp_replace(text, UNSPACED, " $1 "), r"\s+"), lambda w: w != "")
    kmers = bound(words, lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))),
                                              lambda a, b: F.xxhash64(a, b)))
    packed = F.sort_array(F.transform(kmers, lambda h, i: h.bitwiseAND(F.lit(HASH)).bitwiseOR(
        i.cast("long").bitwiseAND(F.lit(PLACE)))))

    def is_again(s: Column, x: Column, j: Column) -> Column:
        return (j > 0) & (x.bitwiseAND(F.lit(HASH)) == F.get(s, j - 1).bitwiseAND(F.lit(HASH)))

    def number(again: Column) -> Column:
        """Later occurrences, sorted by k-mer and place: the hash now depends on the occurrence too."""
        kinds = F.array_distinct(F.transform(again, lambda x: x.bitwiseAND(F.lit(HASH))))
        starts = F.filter(F.transform(again, lambda x, j: F.when(is_again(again, x, j), F.lit(-1)).otherwise(j)),
                          lambda v: v >= 0)
        return bound(F.struct(kinds.alias("kinds"), starts.alias("starts")), lambda k: F.transform(
            again, lambda x, j: F.xxhash64(
                x.bitwiseAND(F.lit(HASH)),
                j + 2 - F.get(k["starts"], F.array_position(k["kinds"], x.bitwiseAND(F.lit(HASH))).cast("int") - 1)
            ).bitwiseAND(F.lit(HASH)).bitwiseOR(x.bitwiseAND(F.lit(PLACE)))))

    def smallest(s: Column) -> Column:
        """Of sorted k-mers without repeats, those with fewer than PER_TUPLE before them in their bin."""
        def bin_of(x: Column) -> Column:
            return F.shiftrightunsigned(x, BIN_PLACE)
        return F.filter(s, lambda x, j: (j < PER_TUPLE) | (bin_of(F.get(s, j - PER_TUPLE)) != bin_of(x)))

    def select(s: Column) -> Column:
        first = bound(F.filter(s, lambda x, j: ~is_again(s, x, j)), smallest)
        again = F.filter(s, lambda x, j: is_again(s, x, j))
        return bound(again, lambda a: F.when(F.size(a) == 0, first).otherwise(
            bound(F.sort_array(F.concat(first, number(a))), smallest)))

    return bound(packed, select)


def tuples(text: Column) -> Column:
    """The hash of each bin's tuple as an int, null for a bin without k-mers."""
    low = 64 - PLACE_BITS

    def tuple_of(chosen: Column) -> Column:
        # place first, hash after it: sorting gives text order
        ordered = F.sort_array(F.transform(chosen, lambda x: F.shiftleft(x.bitwiseAND(F.lit(PLACE)), low).bitwiseOR(
            F.shiftrightunsigned(x, PLACE_BITS))))
        value = F.aggregate(ordered, F.lit(0).cast("long"),
                            lambda acc, y: F.xxhash64(acc, F.shiftleft(y, PLACE_BITS)))
        return F.shiftright(F.shiftleft(value, 32), 32).cast("int")

    def bins(chosen: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: bound(
            F.filter(chosen, lambda x: F.shiftrightunsigned(x, BIN_PLACE) == b),
            lambda c: F.when(F.size(c) > 0, tuple_of(c))))

    return bound(numbered_kmers(text), bins)


def written(bins: Column) -> Column:
    """BINS tuples of WIDTH hex digits each; a bin without k-mers has dashes."""
    digits = F.transform(bins, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit((1 << 32) - 1)))), WIDTH, "0"))
    return F.concat_ws("", F.transform(digits, lambda x: F.coalesce(x, F.lit(NOTHING))))


def fingerprint(text: Column) -> Column:
    return written(tuples(text))


def same_share(a: Column, b: Column) -> Column:
    """Share of equal tuples among the bins that either of two lists of tuples fills; 1 if neither fills any."""
    def counts(s: Column) -> Column:
        filled = F.size(F.filter(s, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
        same = F.size(F.filter(s, lambda p: p["a"] == p["b"]))
        return F.when(filled == 0, F.lit(1.0)).otherwise(same / filled)

    return bound(F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), counts)


def likeness(a: Column, b: Column) -> Column:
    """`same_share` of two fingerprints."""
    def parts(f: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)),
                           lambda i: F.nullif(F.substr(f, i * WIDTH + 1, F.lit(WIDTH)), F.lit(NOTHING)))
    return same_share(parts(a), parts(b))


def with_next(docs: DataFrame, columns: list[str], group_rows: int = 128,
              made: dict[str, Column] | None = None) -> DataFrame:
    """Rows with next_<column>: the row after it in ascending doc_id, after the last one the first.

    Rows with one doc_id follow each other by their text's hash. The different pairs of both are numbered, so keys of any
    type and spread, null ones too, are dealt into ranges of `group_rows` pairs, and the neighbour is found within a
    range. The first rows of each range are also sent to the range before it. The columns `made` are added to rows that
    know their place, so the first of the two shuffles does not carry them.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    numbered = number_rows(docs.select(key.alias("key")).distinct(), "key", "number")
    size = numbered.agg(F.max("number")).first()[0] or 0
    last = max(0, size - 1) // group_rows
    place = F.col("number") - 1
    dealt = numbered.select(F.col("key.doc_id").alias("key_id"), F.col("key.hash").alias("key_hash"),
                            F.floor(place / group_rows).alias("part"), (place % group_rows == 0).alias("is_first"))
    placed = docs.join(dealt, docs["doc_id"].eqNullSafe(dealt["key_id"]) & (F.xxhash64(docs["text"]) == dealt["key_hash"]))

    def seat(part: Column, guest: bool, after: Column) -> Column:
        return F.struct(part.alias("part"), F.lit(guest).alias("guest"), after.alias("after"))

    own = seat(F.col("part"), False, F.lit(False))
    visit = seat(F.when(F.col("part") == 0, F.lit(last)).otherwise(F.col("part") - 1), True, F.col("part") == 0)
    columns_out = [*docs.columns, *(made or {})]
    sent = placed.withColumns(made or {}).withColumn(
        "to", F.explode(F.when(F.col("is_first"), F.array(own, visit)).otherwise(F.array(own))))
    order = Window.partitionBy("to.part").orderBy("to.after", "to.guest", "doc_id", "key_hash", *columns)
    return (sent.select(*columns_out, "to", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
            .where("not to.guest").drop("to"))


def order_minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the code points (rounded down) replaced by as many from the start of the next
    document, or all it has. Null texts are empty; an empty text fills no bin, and two such texts have likeness 1. Rows
    with a null key come before all others; rows with one key, of any type that can be sorted, follow each other in the
    order of their texts' hashes. A text alone in the table is its own next one. Other columns are not read. Empty tables
    give empty results. Very long texts are read whole; places are kept modulo 2**24 words.
    """
    base = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    both = with_next(base, ["text", "bins"], made={"bins": tuples(F.col("text"))})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), "bins", "next_bins",
                         F.concat(F.substr("text", F.lit(1), F.length("text") - half),
                                  F.substr("next_text", F.lit(1), half)).alias("edited"))
    done = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "bins",
                         tuples(F.col("edited")).alias("edited_bins"), "next_bins")
    return done.select("doc_id", "n_chars", "edited_sha256", written(F.col("bins")).alias("fingerprint"),
                       written(F.col("edited_bins")).alias("edited_fingerprint"),
                       same_share(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
                       same_share(F.col("bins"), F.col("next_bins")).alias("near_next"))
