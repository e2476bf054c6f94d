"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

Words are runs of letters and digits in lower case, shingles are five of them (fewer: the whole sequence), and a
shingle weighs as much as it has characters. A document window is as long as the benchmark item it is compared with.

1. *Where windows lie.* A window that is ``threshold`` like an item shares shingles of at least ``threshold`` of the
   item's weight, so it has one of any subset of the item's shingles that weighs more than the rest of
   ``1 - threshold``. The rarest shingles of each item that weigh so much are its marks (prefix filtering). An equality
   join of the documents' shingles with the marks finds every place. The place of the mark in the item says nothing, since
   the passage may be reordered, longer or shorter: every window that covers a mark is looked at. The starts of these
   windows are dealt into stretches as long as the item, in which hits next to each other meet; in a stretch all starts
   are tried where the shared shingles of the window, repeats counted, weigh at least ``threshold`` of the item.
2. *SimHash.* Each bit of a fingerprint is the sign of the weighted sum of the shingles' hash bits. Windows and items
   are cut into ``RADIUS + 1`` blocks of bits; two fingerprints at most RADIUS bits apart agree in one block at least, so
   an equality join on (item, block number, block) finds all of them. At a likeness of 0.8 the expected
   distance is 10 of 64 bits with a standard deviation of 3; RADIUS is 20.
3. *Verification.* Weight of the shared shingles over the weight of all shingles of both, as sets.

The shingles of a document never leave its row: they are exploded, met with the marks and dropped in one stage when the
marks are small enough to be sent around, which Spark decides from their size. Frequent shingles are marks only where an item has no
rarer ones.

Defined cases: null and empty texts have no window and no mark; an item of no words leaks nowhere; an item of fewer
than five words is one shingle and leaks only into documents of just these words; equal items are reported each;
rows that share a doc_id are told apart by a hash of their text, and reported under their doc_id; a null doc_id or item_id
is an id like any other; columns other than these and text are ignored, whatever their names; empty tables give an empty
result; a very long text is one row and scanned whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 20
BITS = 64


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _words_at(ws: Column, i: Column, k: int) -> list[Column]:
    """k words from place i on, null beyond the end. (Inside a lambda ``slice`` would copy the whole list.)"""
    return [F.get(ws, i + F.lit(j)) for j in range(k)]


def shingles(ws: Column, k: int = SHINGLE) -> Column:
    """Of a column of words (not an expression, which would be computed for each shingle):
    array<struct<at, s, weight>> of the k-word shingles in order; the whole sequence if it is shorter."""
    last = F.greatest(F.size(ws) - F.lit(k), F.lit(0))
    starts = F.when(F.size(ws) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        part = _words_at(ws, i, k)
        weight = reduce(lambda a, b: a + b, [F.coalesce(F.length(w), F.lit(0)) for w in part])
        return F.struct(i.alias("at"), F.xxhash64(*part).alias("s"), weight.alias("weight"))

    return F.transform(starts, one)


def place_hashes(ws: Column, k: int = SHINGLE) -> Column:
    """Only the hashes of :func:`shingles`, for the pass over all documents."""
    last = F.greatest(F.size(ws) - F.lit(k), F.lit(0))
    starts = F.when(F.size(ws) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*_words_at(ws, i, k)))


def simhash(parts: Column) -> Column:
    """64 signs as a bit string: bit i is 1 if the weights of shingles with that bit outweigh the others.

    One pass over the shingles with 64 counters, so that the list is computed once wherever it comes from.
    """
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))

    def add(counters: Column, p: Column) -> Column:
        return F.zip_with(counters, bits, lambda c, i: c + p["weight"] * (
            F.call_function("shiftrightunsigned", p["s"], i).bitwiseAND(F.lit(1)).cast("int") * 2 - 1
        ))

    counters = F.aggregate(parts, F.array_repeat(F.lit(0), BITS), add)
    return F.array_join(F.transform(counters, lambda c: F.when(c > 0, F.lit("1")).otherwise(F.lit("0"))), "")


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """The radius + 1 blocks of a fingerprint, as near to equal length as they can be."""
    n = radius + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return F.array(*[F.substring(fingerprint, a + 1, b - a) for a, b in zip(edges, edges[1:])])


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two bit strings differ."""
    as_number = lambda c: F.conv(c, 2, 10).cast("decimal(20,0)")
    halves = [(1, BITS // 2), (BITS // 2 + 1, BITS // 2)]
    return reduce(
        lambda x, y: x + y,
        [
            F.bit_count(
                as_number(F.substring(a, s, n)).cast("bigint").bitwiseXOR(as_number(F.substring(b, s, n)).cast("bigint"))
            )
            for s, n in halves
        ],
    )


def weighted_likeness(a: Column, b: Column) -> Column:
    """Weight of the shared shingles over the weight of all, both as sets of (s, weight)."""
    plain = lambda x: F.array_distinct(F.transform(x, lambda p: F.struct(p["s"], p["weight"])))
    weigh = lambda x: F.aggregate(x, F.lit(0), lambda t, p: t + p["weight"])
    return weigh(F.array_intersect(plain(a), plain(b))) / weigh(F.array_union(plain(a), plain(b)))


def item_table(benchmark: DataFrame, k: int = SHINGLE) -> DataFrame:
    """item_id, size (words), parts (shingles), fingerprint of every item with words."""
    out = benchmark.select("item_id", words(F.coalesce("text", F.lit(""))).alias("ws")).filter(F.size("ws") > 0)
    out = out.select("item_id", F.size("ws").alias("size"), shingles(F.col("ws"), k).alias("parts"))
    return out.withColumn("fingerprint", simhash(F.col("parts")))


def marks(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(s, item_id, at, size): for each item its rarest shingles that together weigh more than 1 - threshold of it."""
    rows = items.select("item_id", "size", F.inline_outer("parts"))
    count = rows.groupBy("s").agg(F.count_distinct("item_id").alias("in_items"))
    once = rows.groupBy("item_id", "s", "weight").agg(F.collect_list("at").alias("ats"), F.max("size").alias("size"))
    order = Window.partitionBy("item_id").orderBy("in_items", F.col("weight").desc(), "s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("item_id")
    ranked = once.join(count, "s").select(
        "s", "item_id", "ats", "size", F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("sooner"),
        F.sum("weight").over(whole).alias("total"),
    )
    return ranked.filter(F.col("sooner") <= F.col("total") * (1 - threshold) + 1).select(
        "s", "item_id", "size", F.explode("ats").alias("at")
    )


def _never_null(df: DataFrame, name: str) -> DataFrame:
    """The id in a struct that is itself never null, so that equality joins keep a null id."""
    return df.select(F.struct(F.col(name).alias("id")).alias(name), "text")


def leaks(
    docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS
) -> DataFrame:
    """doc_id, item_id, start (word), distance, likeness: the most alike window of each document and item that leaks.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text.
    """
    ids = [(n, f.schema[f"{n}_id"].dataType) for n, f in (("doc", docs), ("item", benchmark))]
    docs, benchmark = _never_null(docs, "doc_id"), _never_null(benchmark, "item_id")
    items = item_table(benchmark, k)
    # The outer explode keeps the optimizer from filtering on the list's size below it, which would compute the words
    # again for every shingle; the join drops its nulls.
    places = docs.select("doc_id", F.xxhash64("text").alias("of"), words(F.col("text")).alias("ws")).select(
        "doc_id", "of", place_hashes(F.col("ws"), k).alias("hashes")
    ).select("doc_id", "of", F.posexplode_outer("hashes").alias("place", "s"))
    span = F.greatest(F.col("size") - F.lit(k), F.lit(0))
    first = F.greatest(F.col("place") - span, F.lit(0))
    stretches = (
        places.join(marks(items, threshold), "s")
        .select("doc_id", "of", "item_id", "size", F.explode_outer(F.sequence(
            F.floor(first / F.col("size")).cast("int"), F.floor(F.col("place") / F.col("size")).cast("int")
        )).alias("stretch"))
        .distinct()
    )
    key = ["doc_id", "of"]
    spelled = docs.withColumn("of", F.xxhash64("text")).join(
        stretches.groupBy(*key).agg(F.collect_set(F.struct("item_id", "stretch", "size")).alias("stretches")), key
    )
    cut = (
        spelled.select(*key, words(F.col("text")).alias("ws"), "stretches")
        .select(*key, "ws", F.explode_outer("stretches").alias("w"))
        .select(*key, "w.item_id", "w.size", (F.col("w.stretch") * F.col("w.size")).alias("base"),
                F.slice("ws", F.col("w.stretch") * F.col("w.size") + 1, F.col("w.size") * 2 - 1).alias("ws"))
    )
    windows = _windows(cut, items, key, k, threshold)
    found = _matched(windows, items, key, threshold, radius)
    return found.select(*[F.col(f"{n}_id.id").cast(kind).alias(f"{n}_id") for n, kind in ids], "start", "distance", "likeness")


def _windows(cut: DataFrame, items: DataFrame, key: list[str], k: int, threshold: float) -> DataFrame:
    """key, item_id, start, parts, fingerprint of the windows in stretches of words that can be ``threshold`` like the item.

    The shingles of a stretch that are the item's too are flagged once; a window in which they weigh less than ``threshold``
    of the item, repeats counted, cannot be that much like it.
    """
    sets = items.select(
        "item_id", F.array_distinct(F.transform("parts", lambda p: p["s"])).alias("own"),
        F.aggregate(
            F.array_distinct(F.transform("parts", lambda p: F.struct(p["s"], p["weight"]))), F.lit(0), lambda t, p: t + p["weight"]
        ).alias("total"),
    ).distinct()
    flagged = cut.join(sets, "item_id").select(
        *key, "item_id", "size", "base", "total",
        F.transform(shingles(F.col("ws"), k), lambda p: F.struct(
            p["s"].alias("s"), p["weight"].alias("weight"),
            F.when(F.array_contains("own", p["s"]), p["weight"]).otherwise(F.lit(0)).alias("shared"),
        )).alias("parts"),
    )
    n = F.greatest(F.col("size") - F.lit(k - 1), F.lit(1))
    enough = lambda parts: (
        F.aggregate(parts, F.lit(0), lambda t, p: t + p["shared"]) >= F.col("total") * threshold - 1e-6
    )
    local = F.sequence(F.lit(0), F.least(F.col("size"), F.size("parts")) - 1)
    fit = F.when(
        (F.size("parts") > 0) & enough(F.col("parts")),
        F.filter(local, lambda i: enough(F.slice("parts", i + 1, n))),
    )
    # Generators keep the lists above them from being computed again for each start.
    return (
        flagged.select("*", F.explode_outer(fit).alias("i"))
        .filter(F.col("i").isNotNull())
        .select(*key, "item_id", (F.col("base") + F.col("i")).alias("start"), F.slice("parts", F.col("i") + 1, n).alias("parts"))
        .withColumn("fingerprint", simhash(F.col("parts")))
    )


def _matched(windows: DataFrame, items: DataFrame, key: list[str], threshold: float, radius: int) -> DataFrame:
    print_of = items.select(
        "item_id", F.col("fingerprint").alias("item_print"), F.col("parts").alias("item_parts"),
        F.posexplode_outer(blocks(F.col("fingerprint"), radius)).alias("n", "block"),
    )
    cut = windows.select("*", F.posexplode_outer(blocks(F.col("fingerprint"), radius)).alias("n", "block"))
    near = cut.join(print_of, ["item_id", "n", "block"]).withColumn(
        "distance", hamming(F.col("fingerprint"), F.col("item_print"))
    ).filter(F.col("distance") <= radius)
    # a pair that agrees in several blocks counts at the first of them
    first = F.array_position(
        F.zip_with(blocks(F.col("fingerprint"), radius), blocks(F.col("item_print"), radius), lambda x, y: x == y), True
    ) - 1
    near = near.filter(F.col("n") == first).withColumn(
        "likeness", weighted_likeness(F.col("parts"), F.col("item_parts"))
    ).filter(F.col("likeness") >= threshold)
    best = F.max_by(
        F.struct("start", "distance", "likeness"), F.struct("likeness", (-F.col("start")).alias("earlier"))
    )
    return near.groupBy(key[0], "item_id").agg(best.alias("best")).select(key[0], "item_id", "best.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id,) of every document with a leak."""
    return leaks(docs, benchmark, **options).select("doc_id").distinct()
