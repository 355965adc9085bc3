"""Benchmark decontamination by SimHash over item-sized windows [native].

For each benchmark item of n words the windows are all runs of n words of a document (the whole document, if it is shorter).
A window's similarity to the item is the weighted Jaccard of their bags of five-word shingles: sum of minima over sum of maxima
of the shingles' counts; an item of fewer words is one shingle, the whole sequence. A document is contaminated by an item if a
window reaches ``percent``.

1. Seeds: the positions of a document whose shingle is one of the benchmark's, with the items it is from. Windows of similarity s
   share shingles of weight m with 100 m >= percent * (total - m), so only windows with as many seeds of the item can reach the
   threshold; and sliding a window right until it starts at a seed (or meets the end of the text) loses none. So the windows that
   start at a seed and hold enough seeds are kept, each with its item: none that could count is lost. Seeds are counted by running
   sums over their sorted positions, so a text's work is its seeds, however they repeat.
2. SimHash: 64 bits of each distinct window and each item, from their shingles.
3. Pairs of a window and its items whose fingerprints differ in more than ``RADIUS`` bits go. At similarity 0.75 two fingerprints
   differ in 12 +- 3 bits, so the radius of 28 leaves out one in 10^7 there. Bags of few or often repeated shingles, whose
   fingerprints a few shingles decide, are not judged by them.
4. The exact similarity decides.

Blocks of a multi-index would have to be radius + 1, of 2 or 3 bits each, to guarantee the radius that 0.75 needs: two unrelated
fingerprints share one with a probability of 0.999, so a join on them is a join of all windows with all items. The seeds know the
pairs already; the fingerprints are compared on these.

Words are those of the lower-cased text between white space. Equal windows of different documents are compared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import cut, few

RADIUS = 28
#: Bags of so many shingles at least, three quarters of them distinct, are judged by their fingerprints first.
FLAT = 16
#: The benchmark's shingles are broadcast up to this many (a row is about 40 bytes), as are the kept windows' documents; beyond,
#: Spark shuffles.
BROADCAST = 1_000_000


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, size: int) -> Column:
    """The hashes of all runs of ``size`` words, from an array of word hashes; empty for fewer words."""
    last = F.size(words) - size
    run = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), run)).otherwise(F.array().cast("array<long>"))


def _once(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def _simhash(bag: Column) -> Column:
    """64 bits from an array of hashes: a bit is set if more of them have it than not. Four bits are counted at a time, in 16 bits
    of a long each."""
    lanes = F.lit(0x0001000100010001)
    sums = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda g: F.aggregate(bag, F.lit(0).cast("long"), lambda n, h: n + F.call_function("shiftrightunsigned", h, g).bitwiseAND(lanes)))
    count = lambda s, j: F.call_function("shiftrightunsigned", F.get(s, j % 16), (F.floor(j / 16) * 16).cast("int")).bitwiseAND(F.lit(0xFFFF))
    bit = lambda s, j: F.when(2 * count(s, j) > F.size(bag), F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))
    return _once(sums, lambda s: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda x, j: x.bitwiseOR(bit(s, j))))


def _flat(bag: Column) -> Column:
    return F.size(bag).between(FLAT, 65535) & (4 * F.size(F.array_distinct(bag)) >= 3 * F.size(bag))


def _numbered(bag: Column) -> Column:
    """The bag as a set: the k-th of equal hashes becomes a hash of both."""
    return _once(F.array_sort(bag), lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i - F.array_position(s, x))))


def _seeds(docs: DataFrame, shingles: DataFrame, key: str, mark: Column, size: int, width: int) -> DataFrame:
    """Each position of a document whose ``width``-word shingle is an item's, with that item."""
    small = F.broadcast if shingles.count() <= BROADCAST else (lambda x: x)
    positions = docs.select(F.col(key).alias("key"), mark.alias("row_mark"), word_hashes(F.col("text")).alias("words"))
    # the words from the first, second, ... on side by side: rows come apart and are hashed in generated code, unlike in a lambda
    runs = F.arrays_zip(*[F.slice("words", k, F.greatest(F.size("words") - (width - 1), F.lit(0))).alias(f"w{k}") for k in range(1, width + 1)])
    positions = positions.select("key", "row_mark", F.size("words").alias("length"), F.posexplode(runs).alias("at", "run"))
    positions = positions.select("key", "row_mark", "length", "at", F.xxhash64(*[f"run.w{k}" for k in range(1, width + 1)]).alias("h"))
    return positions.join(small(shingles.filter(F.col("width") == width)), "h").dropDuplicates(["row_mark", "item", "at"])


def _windows(seeds: DataFrame, percent: int) -> DataFrame:
    """(key, row_mark, item, n, width, total, start): windows that start at a seed, or end with the text, and hold enough seeds."""
    total = (F.least("n", "length") - (F.col("width") - 1)).alias("total")
    seeds = seeds.select("key", "row_mark", "item", "n", "width", "length", "at", total)
    # a seed comes in at its position; its window ends at position + total, before what comes in there
    ends = F.array(F.struct(F.col("at").alias("pos"), F.lit(1).alias("seed")), F.struct((F.col("at") + F.col("total")).alias("pos"), F.lit(0).alias("seed")))
    events = seeds.withColumn("e", F.explode(ends)).select("*", "e.*").drop("e")
    so_far = F.sum("seed").over(Window.partitionBy("row_mark", "item").orderBy("pos", "seed").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    by = ["row_mark", "item", "key", "n", "width", "length", "total"]
    counted = events.withColumn("so_far", so_far).groupBy(*by, "at").agg((F.max(F.when(F.col("seed") == 0, F.col("so_far"))) - F.max(F.when(F.col("seed") == 1, F.col("so_far"))) + 1).alias("within"))
    start = F.least("at", F.col("length") - F.col("total") - (F.col("width") - 1)).alias("start")
    needed = F.ceil((F.lit(percent) * (F.col("n") - (F.col("width") - 1) + F.col("total"))) / F.lit(100 + percent))
    kept = counted.withColumn("start", start).groupBy(*by, "start").agg(F.max("within").alias("within"))
    return kept.filter(F.col("within") >= needed).select("key", "row_mark", "item", "n", "width", "total", "start")


def contaminated(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 75, radius: int = RADIUS, key: str = "doc_id") -> DataFrame:
    """(key, row_mark, item_id, start, similarity): for each document and item, the best window that reaches the threshold (of
    equals, the last). ``row_mark`` is a hash of the document's key and text, so rows that repeat a key are told apart; rows equal in both are one.

    Null, empty and blank texts hold nothing, as do such items. Items of fewer than ``size`` words match documents that hold their whole sequence;
    a document shorter than an item is one window. Repeated items are found each, items with the same id and different texts count
    together. Empty tables give an empty result.
    """
    mark = F.xxhash64(F.col(key), F.col("text"))
    bag = shingle_hashes(F.col("words"), size)
    whole = [F.when(F.size("words") == k, shingle_hashes(F.col("words"), k)) for k in range(1, size)]
    known = items.select("item_id", word_hashes(F.col("text")).alias("words")).select("item_id", F.size("words").alias("n"), F.coalesce(*whole, bag).alias("bag"))
    known = known.filter(F.size("bag") > 0).withColumn("width", F.least("n", F.lit(size))).withColumn("item", F.xxhash64("item_id", "bag")).dropDuplicates(["item"])
    known = cut(few(known, items.count()).select("item", "item_id", "n", "width", "bag", _flat(F.col("bag")).alias("flat"), _simhash(F.col("bag")).alias("print")))
    shingles = cut(known.select("item", "n", "width", F.explode(F.array_distinct("bag")).alias("h")))
    widths = [r.width for r in shingles.select("width").distinct().collect()]  # 1 to size
    found = [_windows(_seeds(docs, shingles, key, mark, size, w), percent) for w in sorted({size, *widths})]
    starts = found[0]
    for more in found[1:]:
        starts = starts.union(more)
    starts = cut(starts)

    # the windows' shingles, from their documents alone; one of a short item is the item itself
    long = starts.filter(F.col("width") == size)
    wanted = long.select("row_mark", "n", "start", "total").distinct()
    n = wanted.count()
    least = F.broadcast if n <= BROADCAST else (lambda x: x)
    rows = docs.select(mark.alias("row_mark"), "text").join(least(wanted.select("row_mark").distinct()), "row_mark", "left_semi").dropDuplicates(["row_mark"])
    rows = rows.select("row_mark", word_hashes(F.col("text")).alias("words")).select("row_mark", bag.alias("all"))
    windows = rows.join(wanted, "row_mark").select("row_mark", "n", "start", F.slice("all", F.col("start") + 1, F.col("total")).alias("bag"))
    windows = cut(few(windows, n).withColumn("window", F.xxhash64("n", "bag")))

    distinct = cut(few(windows.dropDuplicates(["window"]), n).select("window", "bag", _flat(F.col("bag")).alias("even"), _simhash(F.col("bag")).alias("p")))
    at = ["row_mark", "n", "start"]
    hits = windows.select(*at, "window").join(long, at)
    near = ~F.col("flat") | ~F.col("even") | (F.bit_count(F.col("p").bitwiseXOR(F.col("print"))) <= radius)
    similar = (
        hits.select("window", "item").distinct().join(distinct, "window").join(known.select("item", "flat", "print", F.col("bag").alias("own")), "item").filter(near)
        .withColumn("both", F.size(F.array_intersect(_numbered(F.col("bag")), _numbered(F.col("own"))))).withColumn("united", F.size("bag") + F.size("own") - F.col("both"))
        .filter(100 * F.col("both") >= percent * F.col("united"))
        .select("window", "item", (F.col("both") / F.col("united")).alias("similarity"))
    )
    exact = starts.filter(F.col("width") < size).select("key", "row_mark", "item", "start", F.lit(1.0).alias("similarity"))
    judged = hits.join(similar, ["window", "item"]).select("key", "row_mark", "item", "start", "similarity").union(exact).join(known.select("item", "item_id"), "item")
    best = F.max(F.struct("similarity", "start"))
    found = few(judged.groupBy("key", "row_mark", "item_id").agg(best.alias("best")), starts.count())
    return found.select(F.col("key").alias(key), "row_mark", "item_id", F.col("best.start").cast("long").alias("start"), F.col("best.similarity").alias("similarity"))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that no item contaminates; columns as before, whatever their names. Null, empty and blank texts stay, rows
    without a key are judged like others, repeated rows stay or go together. Without items all rows stay; an empty table gives an empty result."""
    mark = F.xxhash64(F.col(key), F.col("text"))
    found = cut(contaminated(docs, items, key=key).select("row_mark").distinct())
    least = F.broadcast if found.count() <= BROADCAST else (lambda x: x)
    rows = docs.select(mark.alias("row_mark"), F.struct(*docs.columns).alias("row"))
    return rows.join(least(found), "row_mark", "left_anti").select("row.*")
