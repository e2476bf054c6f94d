"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is cut into paragraphs (or, with another pattern, into finer clauses). Every paragraph is hashed to a wide
vector, and the fingerprint of the text is the sum of those vectors modulo powers of two. The sum does not depend on
the order of the paragraphs, and a paragraph is inserted or deleted by adding or subtracting its vector
(:func:`combine`), without the rest of the text.

The vector has two parts:

* ``wide``: four lanes modulo 2**56 to which every paragraph adds. Two multisets with equal lanes are equal, up to a
  chance of 2**-224.
* ``strata``: twelve levels of 21 lanes modulo 2**7. Level l takes the paragraphs whose hash ends in l zero bits, each
  in one lane. At the first level that is not crowded, the share of lanes that differ and the share of lanes that are
  empty estimate the size of the symmetric difference and of the union (linear counting), whose ratio is the Jaccard
  distance (:func:`likeness`).

Null texts are empty; an empty text has no paragraph and the all-zero fingerprint. Repeated paragraphs count as often
as they occur. Only whole rows are used: a text is one row, and all state is inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.llm.common import materialise

PARAGRAPHS = r"\R+"
#: Finer units, for likeness of texts with few line breaks: a unit ends after a line end or a sign.
CLAUSES = r"(?<=[\n.,;:!?|])"
WIDE = 4
WIDE_MASK = (1 << 56) - 1
LEVELS = 12
PACKS = 3
LANES_PER_PACK = 7
LANES = PACKS * LANES_PER_PACK
LOW7 = int("7f" * LANES_PER_PACK, 16)
HIGH = int("80" * LANES_PER_PACK, 16)


def _wide_lane(units: str, seed: int) -> Column:
    return F.aggregate(
        units, F.lit(0).cast("bigint"),
        lambda a, u: (a + F.xxhash64(u, F.lit(seed)).bitwiseAND(F.lit(WIDE_MASK))).bitwiseAND(F.lit(WIDE_MASK)),
    )


def _pack(hashes: str) -> Column:
    """Seven lanes of a level in one number, a byte each; the byte's high bit takes the carry and is cleared.

    A hash adds 1 to 127 to one of the lanes.
    """
    return F.aggregate(
        hashes, F.lit(0).cast("bigint"),
        lambda a, h: (
            a + F.call_function(
                "shiftleft", F.shiftrightunsigned(h, 16).bitwiseAND(F.lit(127)).bitwiseOR(F.lit(1)),
                (F.shiftrightunsigned(h, 40) % F.lit(LANES_PER_PACK) * F.lit(8)).cast("int"),
            )
        ).bitwiseAND(F.lit(LOW7)),
    )


def _of_pack(hashes: str, pack: int) -> Column:
    return F.filter(hashes, lambda h: F.shiftrightunsigned(h, 50) % F.lit(PACKS) == F.lit(pack))


def _thinned(hashes: str, bit: int) -> Column:
    return F.filter(hashes, lambda h: h.bitwiseAND(F.lit(bit)) == 0)


def with_fingerprint(df: DataFrame, text: str, name: str, pattern: str = PARAGRAPHS) -> DataFrame:
    """Add ``{name}_wide`` and ``{name}_strata``, arrays of bigint.

    They are columns of their own, not fields of a struct: the optimizer would copy the expressions of a struct's
    fields to each use of them.
    """
    keep = df.columns
    units, hashes = f"_{name}_units", f"_{name}_h0"
    parts = F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), pattern)
    out = df.withColumn(units, F.filter(parts, lambda u: F.length(u) > 0))
    wide = [_wide_lane(units, i) for i in range(WIDE)]
    out = out.withColumn(hashes, F.transform(units, lambda u: F.xxhash64(u, F.lit("strata"))))
    packs = []
    for p in range(PACKS):
        of_pack = f"_{name}_p{p}_"
        out = out.withColumn(f"{of_pack}0", _of_pack(hashes, p))
        for level in range(LEVELS):
            if level:
                out = out.withColumn(f"{of_pack}{level}", _thinned(f"{of_pack}{level - 1}", 1 << (level - 1)))
            packs.append((level, p, _pack(f"{of_pack}{level}")))
    packs = [x[2] for x in sorted(packs, key=lambda x: x[:2])]
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        F.array(*wide).alias(f"{name}_wide"), F.array(*packs).alias(f"{name}_strata"),
    )


def combine(df: DataFrame, a: str, b: str, name: str, delete: bool = False) -> DataFrame:
    """Add the fingerprint of the union of two multisets or, with ``delete``, of the first without the second."""

    def wide(x: Column, y: Column) -> Column:
        return (x - y + F.lit(WIDE_MASK + 1) if delete else x + y).bitwiseAND(F.lit(WIDE_MASK))

    def lanes(x: Column, y: Column) -> Column:
        return (x + (F.lit(HIGH) - y if delete else y)).bitwiseAND(F.lit(LOW7))

    return df.withColumns({
        f"{name}_wide": F.zip_with(f"{a}_wide", f"{b}_wide", wide),
        f"{name}_strata": F.zip_with(f"{a}_strata", f"{b}_strata", lanes),
    })


def _zero_lanes(level: Column) -> Column:
    """How many of a level's lanes are zero: adding 0x7f sets a lane's high bit unless it is zero."""
    full = F.lit(LOW7)
    busy = F.aggregate(
        level, F.lit(0), lambda a, x: a + F.bit_count((x + full).bitwiseAND(F.lit(HIGH))).cast("int")
    )
    return F.lit(LANES) - busy


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Add ``name``: the Jaccard likeness of two multisets as their fingerprints tell it, 1 if these are equal."""
    keep = df.columns
    left, right = F.col(f"{a}_strata"), F.col(f"{b}_strata")
    levels, best = f"_{name}_levels", f"_{name}_best"
    either, differ = f"_{name}_or", f"_{name}_xor"
    out = df.withColumns({
        either: F.zip_with(left, right, lambda x, y: x.bitwiseOR(y)),
        differ: F.zip_with(left, right, lambda x, y: x.bitwiseXOR(y)),
    })
    out = out.withColumn(levels, F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS - 1)),
        lambda i: F.struct(
            _zero_lanes(_level(F.col(either), i)).alias("empty"), _zero_lanes(_level(F.col(differ), i)).alias("same")
        ),
    ))
    # the first level whose lanes are not crowded, else the last
    out = out.withColumn(best, F.coalesce(
        F.try_element_at(F.filter(levels, lambda s: s["empty"] * 4 >= LANES), F.lit(1)), F.element_at(levels, -1)
    ))
    same, empty = F.col(best)["same"], F.col(best)["empty"]
    share = lambda n: F.least(F.greatest(n.cast("double"), F.lit(0.5)), F.lit(LANES - 0.5)) / LANES
    distance = F.when(same == LANES, F.lit(0.0)).otherwise(F.log(share(same))) / F.log(share(empty))
    equal = (left == right) & (F.col(f"{a}_wide") == F.col(f"{b}_wide"))
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        F.when(equal, F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - distance))).alias(name),
    )


def _level(strata: Column, i: Column) -> Column:
    return F.slice(strata, i * F.lit(PACKS) + F.lit(1), F.lit(PACKS))


def as_text(name: str) -> Column:
    """The fingerprint as fixed-width lower-case hex, wide lanes first."""

    def hexed(lanes: str, width: int) -> Column:
        return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), width, "0")), "")

    return F.concat(hexed(f"{name}_wide", 14), hexed(f"{name}_strata", 2 * LANES_PER_PACK))


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next smaller distinct id, the largest one after the smallest; null sorts below all.

    Ids are range-sorted; the neighbour inside a partition comes from a window per partition, the one across
    partitions from a table with one row per partition. The sorted ids are written once with their place: sorted
    twice, they might be cut into partitions differently, and ids would be lost between them.
    """
    ordered = materialise(
        ids.select("doc_id").distinct().orderBy(F.col("doc_id").desc_nulls_last())
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33)),
        "ordered",
    )
    within = Window.partitionBy("_part").orderBy("_at")
    rows = ordered.select(
        "doc_id", "_part", F.lead(F.struct("doc_id")).over(within).alias("_next"),
    )
    heads = ordered.groupBy("_part").agg(F.min_by(F.struct("doc_id"), "_at").alias("_head"))
    # one row per partition of the sort, so this window is small however many ids there are
    line = Window.partitionBy(F.lit(0)).orderBy("_part")
    ring = heads.select(
        "_part", F.coalesce(F.lead("_head").over(line), F.first("_head").over(line)).alias("_after"),
    )
    return rows.join(ring, "_part").select("doc_id", F.coalesce("_next", "_after")["doc_id"].alias("next_id"))


def _key(doc_id: str) -> Column:
    """The id as text without nulls, so that plain equality joins and groups partition alike."""
    return F.coalesce(F.concat(F.lit("d"), F.col(doc_id).cast("string")), F.lit("null"))


def with_next_edit(docs: DataFrame) -> DataFrame:
    """doc_id, text, own, edited, next: each text with its fingerprint, the text with its last floor(n_chars / 2) code
    points replaced by the first as many of the next document's (see :func:`next_ids`), and that one's fingerprint.

    Text and fingerprint are shuffled once by key; both joins read that exchange (the same columns, so it is reused).
    What travels to the neighbour is the needed head and the fingerprint. Of rows that share a doc_id the one with the
    smallest text hash is the next document.
    """
    need = docs.groupBy(_key("doc_id").alias("to_key")).agg(F.max(F.floor(F.char_length("text") / 2)).alias("need"))
    links = next_ids(docs).select(_key("next_id").alias("key"), _key("doc_id").alias("to_key"))
    back = links.join(need, "to_key")
    marked = with_fingerprint(docs.select(_key("doc_id").alias("key"), "text"), "text", "own", CLAUSES)
    sent = marked.join(back, "key").select(
        "to_key", F.expr("left(text, int(need))").alias("head"), F.xxhash64("text").alias("order"),
        F.col("own_wide").alias("next_wide"), F.col("own_strata").alias("next_strata"),
    )
    sent = sent.groupBy(F.col("to_key").alias("key")).agg(
        *[F.min_by(c, "order").alias(c) for c in ("head", "next_wide", "next_strata")]
    )
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked.join(sent, "key").select(
        F.when(F.col("key") != "null", F.substring("key", 2, 1 << 30)).cast(kind).alias("doc_id"), "text",
        "own_wide", "own_strata", "next_wide", "next_strata",
        F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("head"), F.lit(1), half)).alias(
            "edited"
        ),
    )


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness of both to it."""
    out = with_fingerprint(with_next_edit(docs), "edited", "changed", CLAUSES)
    out = with_likeness(out, "own", "changed", "near_edited")
    out = with_likeness(out, "own", "next", "near_next")
    return out.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"), as_text("changed").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
