"""Named queries over the benchmark tables, one per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kindred import schema as S
from kindred.functions.text import normalised
from kindred.functions.vectors import l2_normalise
from kindred.operators import (
    actors, blocks, clustering, cues, curation, distinct, embedding, factors, lexicon, lloyd, motion, pairs, parsing,
    quantiles, redundancy, richness, similarity, stats, tfidf,
)
from kindred.plans import tables as tb
from kindred.plans.backends import Encoder, Precomputed, Tfidf
from kindred.plans.report import analyse_once, report, similarity_compare
from kindred.sinks import write_similarity_csv
from kindred.sinks.split_lists import write_split_lists
from kindred.sources.captions import parse_lines, read_captions, rejected_lines
from kindred.sources.npy import file_system, scan_arrays
from kindred.sources.splits import read_splits
from kindred.storage import materialise, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DIM = 64
THRESHOLDS = (10.0, 0.0, 0.02, 0.05, 0.1, 0.6)
LLOYD_K, LLOYD_ROUNDS = 8, 4
TOPICS, TOPIC_ROUNDS = 3, 2
CUES = {"direction": tb.PROXY_DIRECTION, "speed": tb.PROXY_SPEED, "body": tb.PROXY_BODY}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, so that results do not depend on summation order."""
    kinds = {"float", "double"}
    return df.select(*[
        F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name) if f.dataType.typeName() in kinds
        else F.col(f"`{f.name}`").cast("bigint").alias(f.name) if f.dataType.typeName() == "integer"
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def flat_quantiles(df: DataFrame) -> DataFrame:
    probs = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    return df.select(
        *[c for c in df.columns if c != "quantiles"],
        *[F.try_element_at("quantiles", F.lit(p)).alias(n) for n, p in probs.items()],
    )


def vector_rows(df: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    return rounded(df.select(F.col(key).alias(key), F.posexplode(vec).alias("dim", "value")))


# Parsing


@query
def parse_pos(spark, sf):
    """Tagged captions to token and tag lists."""
    df = parsing.ensure_parsed(tb.conversation_captions(spark, sf))
    return df.select(
        S.CAPTION, F.array_join("tokens", " ").alias("tokens"), F.array_join("pos_list", " ").alias("tags")
    )


@query
def parse_pos_raw(spark, sf):
    """P1 on text that is not clean tag strings: only words with an inner slash survive."""
    lines = tb.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias(S.CAPTION), F.col("html").alias(S.TAGS))
    return parsing.ensure_parsed(lines).select(
        S.CAPTION,
        F.size("tokens").cast("bigint").alias("num_tokens"),
        F.array_join("tokens", " ").alias("tokens"),
        F.array_join("pos_list", " ").alias("tags"),
    )


@query
def tokens_by_pos(spark, sf):
    """Token lists per tag, in text order."""
    df = parsing.with_tokens_by_tag(tb.conversation_captions(spark, sf))
    return df.select(S.CAPTION, F.explode("tokens_by_pos").alias("pos", "_t")).select(
        S.CAPTION, "pos", F.array_join("_t", " ").alias("tokens")
    )


@query
def normalised_text(spark, sf):
    """P13."""
    df = redundancy.with_normalised(tb.document_captions(spark, sf))
    return df.select(S.CAPTION, "desc_norm")


@query
def tag_mismatch(spark, sf):
    """P20: tags made from the normalised text, whose word count differs where punctuation splits words."""
    df = tb.document_captions(spark, sf).withColumn(S.TAGS, normalised(F.col(S.TEXT)))
    return parsing.tag_mismatch(df).select(S.CAPTION, S.GROUP)


@query
def caption_lines(spark, sf):
    """Four-field lines built from document lines; those with a ``#`` of their own are rejected."""
    return parse_lines(_lines(spark, sf)).select(S.GROUP, S.CAPTION, S.TEXT, S.TAGS, "num1", "num2")


@query
def rejected_caption_lines(spark, sf):
    """What the line validation skips."""
    return rounded(rejected_lines(_lines(spark, sf)).select(S.GROUP, S.LINE, "line", "fields"))


def _lines(spark, sf):
    docs = tb.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias(S.GROUP),
        "n_chars",
        F.posexplode(F.split("text", "\n")).alias(S.LINE, "_text"),
    )
    tail = [F.col("n_chars").cast("string"), F.when(F.col("n_chars") % 2 == 0, "1.5").otherwise("n/a")]
    return docs.select(S.GROUP, S.LINE, F.concat_ws("#", "_text", F.lit("x/X"), *tail).alias("line"))


# Corpus statistics


@query
def corpus_scalars(spark, sf):
    """A1-A3, A5, A8, A9."""
    return rounded(stats.corpus_scalars(tb.document_captions(spark, sf)))


@query
def corpus_scalars_by_lang(spark, sf):
    """The same per corpus."""
    return rounded(stats.corpus_scalars(tb.document_captions(spark, sf), ["dataset"]))


@query
def vocab_table(spark, sf):
    return stats.vocab_table(tb.document_captions(spark, sf))


@query
def vocab_size(spark, sf):
    return stats.vocab_size(tb.document_captions(spark, sf))


@query
def top_words(spark, sf):
    return stats.top_words(tb.document_captions(spark, sf))


@query
def top_words_first_seen(spark, sf):
    """A6 with ties in the order of first occurrence."""
    return stats.top_words(tb.document_captions(spark, sf), 200, tie="first_seen")


@query
def pos_distribution(spark, sf):
    return stats.pos_distribution(tb.document_captions(spark, sf))


@query
def pos_means(spark, sf):
    return rounded(stats.pos_means(tb.document_captions(spark, sf)))


@query
def captions_per_group(spark, sf):
    return rounded(stats.captions_per_group(tb.conversation_captions(spark, sf)))


@query
def approximate_groups(spark, sf):
    """A2, opt-in: the estimate from stored states per corpus, united, is within 3 % of the exact count."""
    words = tb.document_captions(spark, sf).select("dataset", F.explode(F.split("description", " ")).alias("word"))
    state = materialise(distinct.distinct_state(words, "word", ["dataset"]), "distinct")
    found = distinct.estimated_count(state, ["dataset"]).unionByName(
        distinct.estimated_count(distinct.united([state])).select(F.lit("all").alias("dataset"), "estimate")
    )
    kept = words.select(F.inline(F.array(*[F.struct(c.alias("dataset"), F.col("word").alias("word")) for c in (F.col("dataset"), F.lit("all"))])))
    exact = kept.groupBy("dataset").agg(F.count_distinct("word").alias("exact"))
    return exact.join(found, "dataset").select(
        "dataset", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.03 * F.col("exact")).alias("close")
    )


# Cues and actors


@query
def lexicon_table_hits(spark, sf):
    """Captions against a lexicon table made of the benchmark's words."""
    captions = tb.conversation_captions(spark, sf)
    return rounded(lexicon.lexicon_hits(captions, _lexicon(spark, sf), [S.CAPTION], ["c0", "c1", "c2"]))


@query
def lexicon_table_counts(spark, sf):
    """Frequency of lexicon words per corpus, by the shuffled join."""
    return lexicon.lexicon_counts(tb.document_captions(spark, sf), _lexicon(spark, sf), ["dataset"], limit=0)


def _lexicon(spark, sf):
    """Every word of the benchmark items under one of three categories; c2 counts for nouns and verbs only."""
    items = tb.table(spark, sf, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    entries = items.filter("word <> ''").groupBy("word").agg((F.min("item_id") % 3).alias("_c"))
    tags = F.when(F.col("_c") == 2, F.array(F.lit("NOUN"), F.lit("VERB")))
    return entries.select("word", F.concat(F.lit("c"), F.col("_c").cast("string")).alias("category"), tags.alias("tags"))



@query
def cue_features(spark, sf):
    """P4-P8."""
    lists = list(cues.TAG_COLUMNS.values())
    df = cues.with_cues(tb.conversation_captions(spark, sf), **CUES)
    return rounded(df.select(
        S.CAPTION, *[F.array_join(c, " ").alias(c) for c in lists],
        "direction_hits", "speed_hits", "body_part_mentions",
    ))


@query
def cue_rates(spark, sf):
    return rounded(cues.cue_rates(tb.document_captions(spark, sf), **CUES))


@query
def top_by_pos(spark, sf):
    return cues.top_by_tag(tb.document_captions(spark, sf))


@query
def top_by_pos_first_seen(spark, sf):
    """A11 with ties in the order of first occurrence."""
    return cues.top_by_tag(tb.conversation_captions(spark, sf), 100, tie="first_seen")


@query
def actor_features(spark, sf):
    """P9-P12."""
    df = _addressed(tb.document_captions(spark, sf))
    return rounded(df.select(
        S.CAPTION, "noun_male", "noun_female", "noun_neutral", "pron_male", "pron_female", "pron_neutral",
        "addressing_label",
    ))


def _addressed(df):
    return actors.with_addressing(df, tb.PROXY_ACTORS, tb.PROXY_PRONOUNS)


@query
def label_rates(spark, sf):
    return rounded(actors.label_rates(_addressed(tb.document_captions(spark, sf))))


@query
def group_shares(spark, sf):
    return rounded(actors.group_shares(_addressed(tb.document_captions(spark, sf))))


@query
def top_group_shares(spark, sf):
    """T4."""
    shares = actors.group_shares(_addressed(tb.document_captions(spark, sf)))
    return rounded(actors.top_group_shares(shares))


@query
def top_actor_nouns(spark, sf):
    return actors.top_actor_nouns(tb.document_captions(spark, sf), nouns=tb.PROXY_ACTORS)


@query
def top_actor_nouns_first_seen(spark, sf):
    """A23 with ties in the order of first occurrence, per corpus."""
    return actors.top_actor_nouns(tb.document_captions(spark, sf), nouns=tb.PROXY_ACTORS, by=["dataset"], tie="first_seen")


# Redundancy and richness


@query
def duplicate_rate(spark, sf):
    return rounded(redundancy.duplicate_rate(tb.document_captions(spark, sf)))


@query
def top_ngrams(spark, sf):
    return rounded(redundancy.top_ngrams(tb.document_captions(spark, sf)))


@query
def top_ngrams_first_seen(spark, sf):
    """A14 with ties in the order of first occurrence."""
    return rounded(redundancy.top_ngrams(tb.conversation_captions(spark, sf), k=100, tie="first_seen"))


@query
def top_ngrams_by_lang(spark, sf):
    return rounded(redundancy.top_ngrams(tb.document_captions(spark, sf), by=["dataset"]))


@query
def distinct_ngrams(spark, sf):
    """A17 with its counts."""
    return rounded(richness.distinct_ngrams(parsing.ensure_parsed(tb.document_captions(spark, sf))))


@query
def lexical_richness(spark, sf):
    return _named(richness.lexical_richness(tb.document_captions(spark, sf), connectives=tb.PROXY_CONNECTIVES))


@query
def lexical_richness_by_lang(spark, sf):
    df = tb.document_captions(spark, sf)
    return _named(richness.lexical_richness(df, ["dataset"], tb.PROXY_CONNECTIVES))


def _named(df):
    return rounded(df).withColumnsRenamed({f"distinct-{n}": f"distinct_{n}" for n in (1, 2, 3)} | {"TTR": "ttr"})


# TF-IDF and similarity


@query
def tfidf_vocabulary(spark, sf):
    df = tb.document_captions(spark, sf)
    n_docs = df.agg(F.count(F.lit(1)).alias("n_docs"))
    return rounded(tfidf.vocabulary(tfidf.document_frequencies(df), n_docs))


@query
def tfidf_weights(spark, sf):
    return rounded(tfidf.tfidf_weights(tb.conversation_captions(spark, sf)))


@query
def tfidf_similarity(spark, sf):
    return rounded(similarity.tfidf_similarity(tb.conversation_captions(spark, sf)))


@query
def tfidf_similarity_documents(spark, sf):
    """Few, large groups of long texts."""
    return rounded(similarity.tfidf_similarity(tb.document_captions(spark, sf)))


@query
def tfidf_similarity_by_lang(spark, sf):
    """One model per corpus."""
    return rounded(similarity.tfidf_similarity(tb.document_captions(spark, sf), by=["dataset"]))


@query
def dense_similarity(spark, sf):
    return rounded(similarity.dense_similarity(tb.label_vectors(spark, sf), DIM))


@query
def dense_similarity_any_length(spark, sf):
    """The same without a declared dimension."""
    return rounded(similarity.dense_similarity(tb.label_vectors(spark, sf)))


@query
def dense_similarity_pairs(spark, sf):
    return rounded(blocks.pairwise_similarity(tb.octet_vectors(spark, sf)))


@query
def raw_pair_similarity(spark, sf):
    """A26 on vectors longer than 1, where clipping matters."""
    return rounded(blocks.raw_similarity(tb.octet_vectors(spark, sf, 2.5), DIM))


@query
def encoder_similarity(spark, sf):
    """V4: vectors from a user encoder (letter counts)."""

    def make_encoder():
        import numpy as np

        letters = "abcdefghijklmnopqrstuvwxyz"
        return lambda texts: np.array([[t.count(c) for c in letters] for t in texts], dtype=float)

    return rounded(Encoder(make_encoder, dim=26).similarity(tb.conversation_captions(spark, sf)))


@query
def most_consistent(spark, sf):
    return rounded(similarity.most_consistent(similarity.tfidf_similarity(tb.conversation_captions(spark, sf))))


@query
def least_consistent(spark, sf):
    return rounded(similarity.least_consistent(similarity.tfidf_similarity(tb.conversation_captions(spark, sf))))


@query
def similarity_summary(spark, sf):
    sims = similarity.tfidf_similarity(tb.conversation_captions(spark, sf))
    return rounded(flat_quantiles(similarity.similarity_summary(sims)))


@query
def backend_comparison(spark, sf):
    """TF-IDF over all documents beside vectors over those that have one, with the number of both."""
    vectors = tb.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias(S.CAPTION), F.col("embedding").alias("vec")
    )
    captions = tb.document_captions(spark, sf)
    dense = Precomputed(vectors, DIM, missing="count")
    compared = similarity_compare(captions, {"tfidf": Tfidf(), "embeddings": dense})
    found = dense.coverage(captions)
    counts = found.select(F.inline(F.array(*[
        F.struct(F.lit(b).alias("backend"), n.alias("num_captions"), m.alias("num_missing"))
        for b, n, m in (
            ("tfidf", F.col("num_with_vector") + F.col("num_missing"), F.lit(0).cast("bigint")),
            ("embeddings", F.col("num_with_vector"), F.col("num_missing")),
        )
    ])))
    return rounded(flat_quantiles(compared["summary_table"]).join(counts, "backend"))


@query
def length_quantiles(spark, sf):
    """Exact distributed quantiles of the document lengths, per language."""
    docs = tb.table(spark, sf, "documents")
    q = quantiles.exact_quantiles(docs, "n_chars", [0.1, 0.5, 0.9], ["lang"])
    return rounded(q.select(
        "lang", "n", *[F.get("quantiles", F.lit(i)).alias(c) for i, c in enumerate(["p10", "p50", "p90"])]
    ))


@query
def l2_normalize(spark, sf):
    return vector_rows(
        tb.octet_vectors(spark, sf, 3.0).withColumn("vec", l2_normalise(F.col("vec"))), S.CAPTION
    )


@query
def mean_pool(spark, sf):
    """V3: vectors as tokens of groups of eight, masked by the sign of their first value."""
    tokens = tb.octet_vectors(spark, sf).withColumn("mask", (F.get("vec", F.lit(0)) > 0).cast("int"))
    return vector_rows(embedding.mean_pool(tokens, [S.GROUP], dim=DIM), S.GROUP)


@query
def caption_distance(spark, sf):
    """E3."""
    return rounded(blocks.caption_distances(tb.octet_vectors(spark, sf)))


@query
def caption_distance_blocks(spark, sf):
    """E3 over groups of many blocks."""
    return rounded(blocks.caption_distances(tb.label_vectors(spark, sf), block=16))


@query
def caption_distance_summary(spark, sf):
    return rounded(blocks.distance_summary(blocks.caption_distances(tb.octet_vectors(spark, sf))))


@query
def most_diverse(spark, sf):
    return rounded(blocks.most_diverse(blocks.caption_distances(tb.octet_vectors(spark, sf))))


# Pairs


@query
def group_pairs(spark, sf):
    """Groups of up to 14 texts give all their pairs."""
    return pairs.same_group_pairs(tb.conversation_captions(spark, sf))


@query
def group_pairs_by_corpus(spark, sf):
    """J1 with a corpus key: conversation ids that collide between roles are different groups."""
    df = tb.conversation_captions(spark, sf).withColumn(S.GROUP, (F.col(S.GROUP).cast("int") % 50).cast("string"))
    return pairs.same_group_pairs(df, cap=1_000_000, by=["dataset"]).drop("text_a", "text_b")


@query
def group_pairs_capped(spark, sf):
    """Large groups give 100 drawn pairs."""
    return pairs.same_group_pairs(tb.document_captions(spark, sf)).drop("text_a", "text_b")


# Curation


@query
def threshold_ids(spark, sf):
    sims = similarity.tfidf_similarity(tb.conversation_captions(spark, sf))
    return curation.threshold_ids(sims, THRESHOLDS)


@query
def threshold_counts(spark, sf):
    sims = similarity.tfidf_similarity(tb.conversation_captions(spark, sf))
    return curation.threshold_counts(sims, THRESHOLDS)


@query
def group_lookup(spark, sf):
    sims = similarity.tfidf_similarity(tb.conversation_captions(spark, sf))
    return rounded(curation.lookup_group(sims, "7"))


@query
def curated_anti(spark, sf):
    df = tb.conversation_captions(spark, sf)
    bad = curation.bad_groups(similarity.tfidf_similarity(df), 0.05)
    return curation.drop_groups(df, bad).select(S.GROUP, S.CAPTION, S.TEXT)


@query
def curated_anti_by_lang(spark, sf):
    """The same source may be bad in one language and good in another."""
    df = tb.document_captions(spark, sf)
    sims = similarity.tfidf_similarity(df, by=["dataset"])
    bad = curation.bad_groups(sims, 0.05, by=["dataset"])
    return curation.drop_groups(df, bad, by=["dataset"]).select("dataset", S.GROUP, S.CAPTION)


@query
def pruned_semi(spark, sf):
    df = tb.conversation_captions(spark, sf)
    bad = curation.bad_groups(similarity.tfidf_similarity(df), 0.1)
    return curation.only_groups(df, bad).select(S.GROUP, S.CAPTION)


@query
def curated_splits(spark, sf):
    """Split lines whose stripped id is not a bad group."""
    df = tb.conversation_captions(spark, sf)
    bad = curation.bad_groups(similarity.tfidf_similarity(df), 0.05)
    lines = df.select(
        F.col("dataset").alias("split"), F.concat(F.lit(" "), F.col(S.GROUP), F.lit("\t")).alias("line")
    )
    return curation.filter_split_lines(lines, bad)


@query
def deletion_manifest(spark, sf):
    """Artefacts of bad groups; only conversations with a third turn have an animation."""
    df = tb.conversation_captions(spark, sf)
    bad = curation.bad_groups(similarity.tfidf_similarity(df), 0.1)
    artefacts = {"texts": ".txt", "animations": ".mp4"}
    listed = {"texts": F.col(S.LINE) == 0, "animations": F.col(S.LINE) == 2}
    files = reduce(
        lambda a, b: a.unionByName(b),
        [
            df.filter(listed[a]).select(F.lit(a).alias("artefact"), F.concat(S.GROUP, F.lit(s)).alias("file_name"))
            for a, s in artefacts.items()
        ],
    ).withColumn("path", F.concat_ws("/", "artefact", "file_name"))
    return curation.deletion_manifest(bad, files, artefacts)


# Motion arrays


@query
def split_frames(spark, sf):
    """V5: every value of the seven parts."""
    df = motion.with_parts(tb.feature_frames(spark, sf), tb.FRAME_JOINTS)
    nested = ["ric", "rot6d", "local_vel"]
    parts = {
        "root_rot_vel": F.array("root_rot_vel"), "root_lin_vel": F.col("root_lin_vel"), "root_y": F.array("root_y"),
        **{c: F.flatten(c) for c in nested}, "foot_contact": F.col("foot_contact"),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("part"), v.alias("_v")) for n, v in parts.items()])
    return rounded(
        df.select("frame", F.inline(rows)).select("frame", "part", F.posexplode("_v").alias("i", "value"))
    )


@query
def frame_mse(spark, sf):
    """J8, V6, A30."""
    return rounded(_mse(spark, sf), 9)


def _mse(spark, sf):
    return motion.frame_mse(tb.feature_frames(spark, sf), tb.joint_frames(spark, sf), tb.FRAME_JOINTS)


@query
def motion_extremes(spark, sf):
    return rounded(motion.file_extremes(_mse(spark, sf)), 9)


@query
def global_extremes(spark, sf):
    return rounded(motion.global_extremes(motion.file_extremes(_mse(spark, sf))), 9)


@query
def twin_status(spark, sf):
    """Label arrays against the same frames of vectors with an even id or a positive first value.

    Frames are counted and widths taken from the arrays; dropping frames by their data makes files of other lengths, and
    one width is cut where the first value of the frame is largest.
    """
    frames = tb.table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias(S.GROUP), "embedding", F.get("embedding", F.lit(0)).alias("x")
    )
    counted = Window.partitionBy(S.GROUP)
    features = frames.select(
        S.GROUP, F.lit(2).alias("ndim"), F.count(F.lit(1)).over(counted).alias("n_frames"),
        F.size(F.slice("embedding", 1, 59)).alias("width"),
    )
    kept = frames.filter((F.col(S.GROUP).cast("int") % 3 != 0) | (F.col("x") > 0))
    short = (F.col(S.GROUP).cast("int") % 5 == 1) & (F.col("x") > 0)
    joints = kept.select(
        S.GROUP, F.when(F.col(S.GROUP).cast("int") % 7 == 5, F.lit(2)).otherwise(F.lit(3)).alias("ndim"),
        F.count(F.lit(1)).over(counted).alias("n_frames"),
        F.size(F.slice("embedding", F.lit(1), F.when(short, F.lit(14)).otherwise(F.lit(15)))).alias("width"),
    )
    return rounded(motion.twin_status(features, joints, tb.FRAME_JOINTS))


@query
def array_scan(spark, sf):
    """The vectors as .npy files of 256 frames, read back by byte range."""
    folder = f"{shared_dir(spark)}/arrays-{uuid.uuid4().hex}"
    vectors = tb.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    blocks_of = vectors.withColumn(S.GROUP, F.floor(F.col("vec_id") / 256).cast("string"))

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        system, inside = file_system(folder)
        system.create_dir(inside, recursive=True)
        with system.open_output_stream(f"{inside}/{key[0].as_py()}.npy") as out:
            np.lib.format.write_array(out, np.array(rows.column("vec").to_pylist(), np.float32), allow_pickle=False)
        return pa.table({"n": pa.array([rows.num_rows], pa.int64())})

    blocks_of.groupBy(S.GROUP).applyInArrow(write, "n bigint").count()
    read = scan_arrays(spark, folder, split_bytes=16_384)
    return rounded(read.select(
        S.GROUP, "ndim", "n_frames", "frame", F.size("vec").alias("width"), F.get("vec", F.lit(0)).alias("first"),
        F.element_at("vec", -1).alias("last"),
    ))


@query
def split_lists(spark, sf):
    """Split lists written under their own names and read back."""
    df = tb.conversation_captions(spark, sf)
    order = Window.partitionBy("dataset").orderBy(S.CAPTION)
    lines = df.select(
        F.col("dataset").alias("split"), F.row_number().over(order).alias("line_no"), F.concat(F.lit(" "), S.CAPTION).alias("line")
    )
    folder = f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}"
    write_split_lists(lines, folder)
    return rounded(read_splits(spark, folder, ("system.txt", "user.txt", "assistant.txt")))


@query
def caption_files(spark, sf):
    """Caption files, one per conversation, scanned as a directory."""
    df = tb.conversation_captions(spark, sf)
    folder = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    flat = F.concat_ws("#", F.translate(S.TEXT, "#\n\r", "   "), F.lit("x/X"), F.lit("1.5"), F.col(S.LINE).cast("string"))

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        system, inside = file_system(folder)
        system.create_dir(inside, recursive=True)
        with system.open_output_stream(f"{inside}/{key[0].as_py()}.txt") as out:
            out.write("\n".join(rows.sort_by(S.LINE).column("line").to_pylist()).encode())
        return pa.table({"n": pa.array([rows.num_rows], pa.int64())})

    df.select(S.GROUP, S.LINE, flat.alias("line")).groupBy(S.GROUP).applyInArrow(write, "n bigint").count()
    return read_captions(spark, folder).select(S.GROUP, S.CAPTION, S.TEXT, "num1", "num2")


@query
def similarity_csv(spark, sf):
    """The similarity table written as CSV and read back."""
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    sims = rounded(similarity.tfidf_similarity(tb.conversation_captions(spark, sf)))
    write_similarity_csv(sims, folder)
    return spark.read.schema(sims.schema).option("header", True).csv(folder)


@query
def twin_report(spark, sf):
    """Extremes of the files that pass the shape check; joint files of every fourth label claim a frame more."""
    size = Window.partitionBy(S.GROUP)
    features = tb.feature_frames(spark, sf).select(
        S.GROUP, "frame", F.slice("vec", 1, 59).alias("vec"), F.lit(2).alias("ndim"), F.count(F.lit(1)).over(size).alias("n_frames")
    )
    odd = (F.col(S.GROUP).cast("int") % 4 == 0).cast("int")
    joints = tb.joint_frames(spark, sf).select(
        S.GROUP, "frame", F.flatten("joints").alias("vec"), F.lit(3).alias("ndim"), (F.count(F.lit(1)).over(size) + odd).alias("n_frames")
    )
    found = motion.check_twins(features, joints, tb.FRAME_JOINTS)
    return rounded(found["status"].select(S.GROUP, "status").join(found["file_extremes"], S.GROUP, "left"), 9)


# Clusters, topics, report


@query
def kmeans_sizes(spark, sf):
    """E1."""
    vectors = tb.label_vectors(spark, sf)
    return clustering.largest_clusters(clustering.cluster_captions(vectors))


@query
def kmeans_rows(spark, sf):
    """Every vector is in a cluster."""
    sizes = clustering.cluster_sizes(clustering.cluster_captions(tb.label_vectors(spark, sf)))
    return sizes.agg(F.sum("cnt").alias("n_rows"))


@query
def lloyd_sizes(spark, sf):
    """E1 with a fixed start and rounds: cluster sizes and the first value of each centre."""
    return _sized(lloyd.lloyd(tb.label_vectors(spark, sf), LLOYD_K, LLOYD_ROUNDS))


@query
def lloyd_sizes_by_label(spark, sf):
    """A model for each corpus."""
    vectors = tb.label_vectors(spark, sf).withColumn("dataset", (F.col(S.GROUP).cast("int") % 3).cast("string"))
    return _sized(lloyd.lloyd(vectors, LLOYD_K, LLOYD_ROUNDS, ["dataset"]))


def _sized(model):
    return rounded(model.withColumn("first", F.get("centre", F.lit(0))).drop("centre"))


@query
def factor_topics(spark, sf):
    """E2 with a fixed start and rounds."""
    return rounded(factors.factor_topics(tb.conversation_captions(spark, sf), TOPICS, rounds=TOPIC_ROUNDS))


@query
def topics(spark, sf):
    """E2."""
    return clustering.topics(tb.document_captions(spark, sf))


@query
def full_report(spark, sf):
    """Every section as one tidy table."""
    return rounded(report(analyse_once(tb.conversation_captions(spark, sf))))
