"""The full analysis: every section for one corpus or several, as DataFrames and as one tidy table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from kindred import schema as S
from kindred.lexicons import QUANTILES
from kindred.operators import actors, cues, redundancy, richness, similarity, stats
from kindred.operators.frames import top_k
from kindred.operators.parsing import ensure_parsed
from kindred.plans.backends import Backend, Tfidf
from kindred.plans.facts import Lexicons, parsed_captions, sections, stored_facts
from kindred.storage import materialise

REPORT_ROWS = 10
REPORT_GROUPS = 5


def similarity_compare(df: DataFrame, backends: Mapping[str, Backend], by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Group similarity under each backend, plus one summary row per backend as ``summary_table``."""
    tables = {name: backend.similarity(df, by) for name, backend in backends.items()}
    return {**tables, "summary_table": similarity.backend_comparison(tables, by=by)}


def analyse(
    df: DataFrame, backends: Mapping[str, Backend] | None = None, by: Sequence[str] = ()
) -> dict[str, dict[str, DataFrame]]:
    """``{section: {name: DataFrame}}``, all lazy.

    Tags are parsed once in the plan, but each section reads the source; :func:`analyse_once` reads it once.
    """
    missing = {S.GROUP, S.TEXT, S.TAGS} - set(df.columns)
    if missing:
        raise ValueError(f"captions need the columns motion_id, description and pos_tags; missing {sorted(missing)}")
    parsed = ensure_parsed(df)
    cue_summary, _ = cues.cue_analysis(parsed, by)
    _, actor_summary = actors.actor_analysis(parsed, by)
    return {
        "corpus_stats": stats.corpus_stats(parsed, by),
        "cues": cue_summary,
        "actors": actor_summary,
        "redundancy": redundancy.redundancy_analysis(parsed, by=by),
        "similarity": similarity_compare(parsed, backends or {"tfidf": Tfidf()}, by),
        "richness": {"richness": richness.lexical_richness(parsed, by)},
    }


def analyse_once(
    df: DataFrame, backends: Mapping[str, Backend] | None = None, by: Sequence[str] = (), lexicons: Lexicons = Lexicons()
) -> dict[str, dict[str, DataFrame]]:
    """The same sections from one scan of the captions.

    The parsed captions, the facts of all sections (see :mod:`kindred.plans.facts`) and each backend's groups are written
    to the shared folder; the frames that come back read those. Use :func:`analyse` where nothing may be written.
    """
    missing = {S.GROUP, S.TEXT, S.TAGS} - set(df.columns)
    if missing:
        raise ValueError(f"captions need the columns motion_id, description and pos_tags; missing {sorted(missing)}")
    parsed = materialise(parsed_captions(df), "captions")
    facts = stored_facts(parsed, by, lexicons)
    tables = {
        name: materialise(backend.similarity(parsed, by), "similarity")
        for name, backend in (backends or {"tfidf": Tfidf()}).items()
    }
    similar = {**tables, "summary_table": similarity.backend_comparison(tables, by=by)}
    return {**sections(facts, by, lexicons), "similarity": similar}


def report(sections: Mapping[str, Mapping[str, DataFrame]], by: Sequence[str] = ()) -> DataFrame:
    """``(by, section, place, metric, value)`` with one row per scalar and per listed top entry.

    ``place`` counts the entries of a list from 1 in its order and is 1 for scalars. Top lists are cut to the rows a
    reader sees; the full frames stay in ``sections``. Each backend lists its most and least consistent groups.
    """
    parts = [
        *_scalars("corpus_stats", sections["corpus_stats"]["scalars"], by),
        *_scalars("corpus_stats", sections["corpus_stats"]["top_20_words"], by, ["token"], REPORT_ROWS),
        *_scalars("corpus_stats", sections["corpus_stats"]["pos_distribution"], by, ["pos"]),
        *_scalars("cues", sections["cues"]["rates"], by, digits=3),
        *_scalars("cues", sections["cues"]["top_by_tag"], by, ["pos", "token"], REPORT_ROWS),
        *_scalars("actors", sections["actors"]["label_rates"].drop("cnt"), by, ["label"], digits=3),
        *_scalars("actors", sections["actors"]["top_actor_nouns"].drop("category"), by, ["token"], REPORT_ROWS),
        *_scalars("actors", actors.top_group_shares(sections["actors"]["per_motion_summary"], REPORT_GROUPS, by=by), by, [S.GROUP]),
        *_scalars("redundancy", sections["redundancy"]["duplicate_rate"], by, digits=4),
        *_scalars("redundancy", sections["redundancy"]["top_ngrams"].withColumn("n", F.col("n").cast("string")), by, ["n", "ngram"], REPORT_ROWS),
        *_scalars("similarity", _flat_summary(sections["similarity"]["summary_table"]), by, ["backend"]),
        *_consistency(sections["similarity"], by),
        *_scalars("richness", sections["richness"]["richness"], by, digits=4),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _consistency(tables: Mapping[str, DataFrame], by: Sequence[str]) -> list[DataFrame]:
    def listed(backend: str, table: DataFrame, kind: str) -> DataFrame:
        name = f"{backend}_{kind}_consistent"
        order = F.col(f"`{name}`")
        order = order.desc_nulls_last() if kind == "most" else order.asc_nulls_last()
        return _rows("similarity", table.select(*by, S.GROUP, F.col(S.SIM).alias(name)), by, [S.GROUP], order, REPORT_ROWS)

    backends = {b: t for b, t in tables.items() if b != "summary_table"}
    return [listed(b, t, kind) for b, t in backends.items() for kind in ("most", "least")]


def _flat_summary(summary: DataFrame) -> DataFrame:
    return summary.select(
        *[c for c in summary.columns if c != "quantiles"],
        *[F.try_element_at("quantiles", F.lit(float(p))).alias(f"q{round(p * 100)}") for p in QUANTILES],
    )


def _scalars(
    section: str,
    df: DataFrame,
    by: Sequence[str],
    keys: Sequence[str] = (),
    limit: int | None = None,
    digits: int | None = None,
) -> list[DataFrame]:
    """Unpivot the value columns of ``df``; ``keys`` become part of the metric name."""
    values = [c for c in df.columns if c not in {*by, *keys}]
    order = F.col(f"`{values[0]}`").desc_nulls_last() if keys else None
    return [_rows(section, df, by, keys, order, limit, digits)]


def _rows(section, df, by, keys, order, limit=None, digits=None) -> DataFrame:
    """The rows of one list; its entries are placed within all keys but the last, which names them."""
    values = [c for c in df.columns if c not in {*by, *keys}]
    within = [*by, *keys[:-1]]
    if limit is not None:
        df = top_k(df, limit, order, [keys[-1]], within)
    if order is None:
        place = F.lit(1)
    else:
        # after the cut, or over as many rows as there are labels, tags or backends: never a large partition
        place = F.row_number().over(Window.partitionBy(*within).orderBy(order, F.col(keys[-1])))
    label = [F.col(k).cast("string") for k in keys]

    def value(name: str):
        v = F.col(f"`{name}`").cast("double")
        return F.round(v, digits) if digits is not None else v

    cells = F.array(
        *[
            F.struct(F.concat_ws(": ", F.lit(c), *label).alias("metric"), value(c).alias("value"))
            for c in values
        ]
    )
    placed = df.withColumn("place", place)
    return placed.select(*by, F.lit(section).alias("section"), "place", F.inline(cells))
