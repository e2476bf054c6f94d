"""Reference SQL for the catalog, written independently of the operators (all-pairs joins, plain windows)."""

from __future__ import annotations

from kindred import lexicons as L
from kindred.plans import tables as tb
from kindred.plans.catalog import LLOYD_K, LLOYD_ROUNDS, THRESHOLDS, TOPIC_ROUNDS, TOPICS

DOCS = """captions AS (
    SELECT source AS motion_id, doc_id::VARCHAR AS caption_id, lang AS dataset, text AS description FROM documents)"""
CONVS = """captions AS (
    SELECT conv_id::VARCHAR AS motion_id, conv_id || ':' || turn AS caption_id, turn AS line_no, role AS dataset,
           text AS description FROM conversations)"""


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


# One row per token with its synthetic tag.
TOKENS = f"""words AS (SELECT *, regexp_extract_all(description, '[^\\s]+') AS w FROM captions),
tokens AS (
    SELECT motion_id, caption_id, dataset, tok, i, ([{_quoted(tb.PROXY_TAGS)}])[length(tok) % 6 + 1] AS pos
    FROM (SELECT motion_id, caption_id, dataset, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM words))"""


def _norm(column: str = "description") -> str:
    return (
        f"trim(regexp_replace(regexp_replace(lower({column}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    )


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE, {digits}) AS {name}"


# TF-IDF weights and the similarity of every group by an explicit join of caption pairs.
def _tfidf(key: str = "") -> str:
    """``key`` is an extra column that separates corpora."""
    k = f"{key}, " if key else ""
    on = f" AND a.{key} = b.{key}" if key else ""
    using = f"{key}, " if key else ""
    n_join = f"JOIN n_docs USING ({key})" if key else "CROSS JOIN n_docs"
    group_n = f"GROUP BY {key}" if key else ""
    return f"""uni AS (
    SELECT {k}motion_id, caption_id, regexp_extract_all(lower(description), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM captions),
terms AS (
    SELECT {k}motion_id, caption_id, term, count(*) AS tf FROM (
        SELECT {k}motion_id, caption_id, unnest(list_concat(t,
            list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM uni)
    GROUP BY ALL),
n_docs AS (SELECT {k}count(*) AS n FROM captions {group_n}),
vocab AS (
    SELECT {k}term, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf
    FROM (SELECT {k}term, count(*) AS df FROM terms GROUP BY ALL) {n_join}
    WHERE df >= 2 AND df <= 0.9::DOUBLE * n),
raw AS (SELECT {k}motion_id, caption_id, term, tf * idf AS w FROM terms JOIN vocab USING ({using}term)),
weights AS (
    SELECT {k}motion_id, caption_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY {k}caption_id)) AS w FROM raw),
sims AS (
    SELECT {', '.join('s.' + c for c in ([key] if key else []))}{', ' if key else ''}s.motion_id,
           CASE WHEN s.n >= 2 THEN coalesce(d.total, 0.0) / (s.n * (s.n - 1) / 2.0) END AS sim, s.n AS num
    FROM (SELECT {k}motion_id, count(*) AS n FROM captions GROUP BY ALL) s
    LEFT JOIN (
        SELECT {'a.' + key + ', ' if key else ''}a.motion_id, sum(a.w * b.w) AS total
        FROM weights a JOIN weights b
          ON a.motion_id = b.motion_id AND a.term = b.term AND a.caption_id < b.caption_id{on}
        GROUP BY ALL) d ON s.motion_id = d.motion_id{' AND s.' + key + ' = d.' + key if key else ''})"""


SIM_COLUMNS = f"motion_id, {_r('sim', 'mean_intra_caption_sim')}, num AS num_captions"


def _similarity(captions: str, rest: str, key: str = "", columns: str = SIM_COLUMNS) -> str:
    return f"WITH {captions}, {_tfidf(key)} SELECT {columns} {rest}"


def _summary(source: str, key: str = "") -> str:
    qs = [("p10", 0.1), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9)]
    cells = ", ".join(_r(f"quantile_cont(sim, {p}::DOUBLE)", n) for n, p in qs)
    head = f"{key}, " if key else ""
    tail = f" GROUP BY {key}" if key else ""
    return (
        f"SELECT {head}{_r('avg(sim)', 'mean_of_means')}, {_r('median(sim)', 'median_of_means')}, {cells} "
        f"FROM {source}{tail}"
    )


# Dense pairs: e AS (g, id, v) to the clipped dot product of every pair.
DENSE_PAIRS = """pairs AS (
    SELECT a.g, greatest(-1.0, least(1.0, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])))) AS d
    FROM e a JOIN e b ON a.g = b.g AND a.id < b.id),
sizes AS (SELECT g, count(*) AS n FROM e GROUP BY g)"""


def _dense(group: str, scale: str = "1.0") -> str:
    return f"""e AS (
    SELECT {group} AS g, vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * {scale}) AS v FROM embeddings),
{DENSE_PAIRS}"""


OCTET = "(vec_id // 8)::VARCHAR"
DENSE_SIM = (
    f"SELECT g AS motion_id, {_r('avg(d)', 'mean_intra_caption_sim')}, any_value(n) AS num_captions "
    "FROM sizes LEFT JOIN pairs USING (g) GROUP BY g"
)
DISTANCES = f"""WITH {_dense(OCTET)}, dist AS (
    SELECT g AS motion_id, any_value(n) AS n_captions, avg(1 - d) AS dist_mean, median(1 - d) AS dist_median,
           max(1 - d) AS dist_max, min(1 - d) AS dist_min
    FROM sizes JOIN pairs USING (g) GROUP BY g)"""
DISTANCE_COLUMNS = "motion_id, n_captions, " + ", ".join(
    _r(c, c) for c in ("dist_mean", "dist_median", "dist_max", "dist_min")
)


def _scalars(key: str = "") -> str:
    k = f"{key}, " if key else ""
    g = f" GROUP BY {key}" if key else ""
    join = (lambda t: f"JOIN {t} USING ({key})") if key else (lambda t: f"CROSS JOIN {t}")
    lens = ", ".join(
        _r(f"avg(len(list_filter(w, lambda x: length(x) % 6 = {i})))", f"mean_{t}")
        for i, t in enumerate(tb.PROXY_TAGS)
    )
    return f"""WITH {DOCS}, {TOKENS},
a AS (
    SELECT {k}count(*) AS num_captions, {_r('avg(len(w))', 'avg_tokens')}, {_r('stddev_samp(len(w))', 'std_tokens')},
           {_r('median(len(w))', 'median_tokens')}, {lens} FROM words{g}),
b AS (
    SELECT {k}count(*) AS num_motions, {_r('avg(n)', 'captions_per_motion_mean')},
           {_r('median(n)', 'captions_per_motion_median')}
    FROM (SELECT {k}motion_id, count(*) AS n FROM words GROUP BY ALL){g}),
c AS (SELECT {k}count(DISTINCT lower(tok)) AS vocab_size FROM tokens{g})
SELECT * FROM a {join('b')} {join('c')}"""


def _in(words, tags: str) -> str:
    return f"count(*) FILTER (lower(tok) IN ({_quoted(words)}) AND pos IN ({tags}))"


HITS = (
    f"{_in(tb.PROXY_DIRECTION, _quoted(['ADJ', 'ADV', 'NOUN']))} AS direction_hits, "
    f"{_in(tb.PROXY_SPEED, _quoted(['ADJ', 'ADV']))} AS speed_hits, "
    f"{_in(tb.PROXY_BODY, _quoted(['NOUN']))} AS body_part_mentions"
)
ACTOR_COUNTS = ", ".join(
    f"{_in(bag[c], _quoted([tag]))} AS {kind}_{c}"
    for kind, tag, bag in (("noun", "NOUN", tb.PROXY_ACTORS), ("pron", "PRON", tb.PROXY_PRONOUNS))
    for c in ("male", "female", "neutral")
)
ADDRESSED = f"""WITH {DOCS}, {TOKENS},
counted AS (SELECT motion_id, caption_id, {ACTOR_COUNTS} FROM captions LEFT JOIN tokens USING (motion_id, caption_id)
            GROUP BY ALL),
labelled AS (
    SELECT *, CASE WHEN noun_male > 0 THEN 'male_noun' WHEN noun_female > 0 THEN 'female_noun'
                   WHEN noun_neutral > 0 THEN 'neutral_noun' WHEN pron_male > 0 THEN 'male_pron'
                   WHEN pron_female > 0 THEN 'female_pron' WHEN pron_neutral > 0 THEN 'neutral_pron'
                   ELSE 'none' END AS addressing_label
    FROM counted),
shares AS (
    SELECT motion_id, avg((addressing_label IN ('male_noun', 'female_noun', 'male_pron', 'female_pron'))::INT) AS gendered,
           avg((addressing_label IN ('neutral_noun', 'neutral_pron'))::INT) AS neutral
    FROM labelled GROUP BY motion_id)"""
SHARES = f"motion_id, {_r('gendered', 'share_gendered_captions')}, {_r('neutral', 'share_neutral_captions')}"


def _grams(key: str = "") -> str:
    k = f"{key}, " if key else ""
    return f"""WITH {DOCS},
norm AS (SELECT {k}regexp_extract_all({_norm()}, '[^ ]+') AS t FROM captions),
grams AS (
    SELECT {k}2 AS n, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS ngram FROM norm
    UNION ALL
    SELECT {k}3, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM norm),
counts AS (SELECT {k}n, ngram, count(*) AS cnt FROM grams GROUP BY ALL)
SELECT {k}n::BIGINT AS n, ngram, cnt FROM counts
QUALIFY row_number() OVER (PARTITION BY {k}n ORDER BY cnt DESC, ngram) <= 30"""


DISTINCT = """raw AS (
    SELECT dataset, 1 AS n, unnest(w) AS gram FROM words
    UNION ALL SELECT dataset, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || chr(31) || w[i + 1])) FROM words
    UNION ALL SELECT dataset, 3,
        unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2])) FROM words)"""


def _richness(key: str = "") -> str:
    k = f"{key}, " if key else ""
    g = f" GROUP BY {key}" if key else ""
    using = (lambda t: f"JOIN {t} USING ({key})") if key else (lambda t: f"CROSS JOIN {t}")
    ratios = ", ".join(
        _r(f"coalesce(count(DISTINCT gram) FILTER (n = {n}) / count(gram) FILTER (n = {n}), 0)", f"distinct_{n}")
        for n in (1, 2, 3)
    )
    return f"""WITH {DOCS}, {TOKENS}, {DISTINCT},
a AS (SELECT {k}{_r('count(DISTINCT lower(tok)) / count(*)', 'ttr')},
             {_r(f"count(*) FILTER (lower(tok) IN ({_quoted(tb.PROXY_CONNECTIVES)})) / count(*)", 'conj_rate')}
      FROM tokens{g}),
b AS (SELECT {k}{ratios} FROM raw{g}),
c AS (SELECT {k}{_r('avg(len(list_filter(w, lambda x: length(x) % 6 = 1)))', 'mean_verbs_per_caption')} FROM words{g})
SELECT * FROM a {using('b')} {using('c')}"""


BAD = "bad AS (SELECT motion_id FROM sims WHERE sim < 0.05)"
WORSE = BAD.replace("0.05", "0.1")
LIMITS = "limits AS (SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in THRESHOLDS) + "]) AS threshold)"


def _pairs(captions: str, columns: str) -> str:
    """All pairs up to 100 per group, else 100 ranks drawn by Floyd's method and unranked."""
    h = "('0x' || substr(md5('42:' || motion_id || ':' || j), 1, 15))::BIGINT"
    return f"""WITH {captions},
sizes AS (SELECT motion_id, count(*) AS n, count(*) * (count(*) - 1) // 2 AS p FROM captions GROUP BY motion_id HAVING count(*) >= 2),
draws AS (
    SELECT motion_id, p, list({h} % (j + 1) ORDER BY j) AS picks
    FROM (SELECT motion_id, p, unnest(range(p - 100, p)) AS j FROM sizes WHERE p > 100) GROUP BY ALL),
ranks AS (
    SELECT motion_id, unnest(range(0, p)) AS k FROM sizes WHERE p <= 100
    UNION ALL
    SELECT motion_id, unnest(list_reduce(range(0, 100),
        lambda acc, s: list_append(acc, CASE WHEN list_contains(acc, picks[s + 1]) THEN p - 100 + s ELSE picks[s + 1] END),
        []::BIGINT[])) FROM draws),
located AS (
    SELECT motion_id, k, j, k - j * (j - 1) // 2 AS i
    FROM (SELECT motion_id, k, floor((1 + sqrt(1 + 8 * k)) / 2)::BIGINT AS j FROM ranks)),
used AS (
    SELECT motion_id, x, row_number() OVER (PARTITION BY motion_id ORDER BY x) AS r
    FROM (SELECT motion_id, i AS x FROM located UNION SELECT motion_id, j FROM located)),
ordered AS (
    SELECT motion_id, caption_id, description,
           row_number() OVER (PARTITION BY motion_id ORDER BY md5('42:' || motion_id || ':' || caption_id), caption_id) AS r
    FROM captions),
placed AS (SELECT motion_id, x, caption_id, description FROM used JOIN ordered USING (motion_id, r)),
merged AS (
    SELECT l.motion_id, a.caption_id AS ia, a.description AS ta, b.caption_id AS ib, b.description AS tb
    FROM located l JOIN placed a ON a.motion_id = l.motion_id AND a.x = l.i
                   JOIN placed b ON b.motion_id = l.motion_id AND b.x = l.j),
result AS (
    SELECT motion_id, least(ia, ib) AS caption_a, greatest(ia, ib) AS caption_b,
           CASE WHEN ia <= ib THEN ta ELSE tb END AS text_a, CASE WHEN ia <= ib THEN tb ELSE ta END AS text_b,
           1.0::DOUBLE AS label
    FROM merged)
SELECT {columns} FROM result"""


# Frame arrays with 5 joints: positions of the parts in the 1-based vector.
PARTS = {
    "root_rot_vel": (1, 1), "root_lin_vel": (2, 3), "root_y": (4, 4), "ric": (5, 16), "rot6d": (17, 40),
    "local_vel": (41, 55), "foot_contact": (56, 59),
}
MSE = """mse AS (
    SELECT label::VARCHAR AS motion_id, vec_id AS frame,
           list_avg(list_transform(range(0, 12), lambda q:
               ((e[5 + q] + e[61 + q % 3] + 0.1::DOUBLE * e[64] * (q // 3 + 1)) - e[61 + q % 3] - e[5 + q]) ** 2)) AS mse
    FROM (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)),
ext AS (SELECT motion_id, max(mse) AS hi, min(mse) AS lo FROM mse GROUP BY motion_id)"""

LINES = """lines AS (
    SELECT motion_id, line_no - 1 AS line_no, trim(part, chr(32) || chr(9) || chr(13)) || '#x/X#' || n_chars || '#' || CASE WHEN n_chars % 2 = 0 THEN '1.5' ELSE 'n/a' END AS line,
           part, n_chars
    FROM (SELECT doc_id::VARCHAR AS motion_id, n_chars, unnest(string_split(text, chr(10))) AS part,
                 generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)),
fields AS (SELECT *, len(string_split(line, '#')) AS fields FROM lines)"""

TOKEN_LISTS = ", ".join(
    f"coalesce(string_agg(lower(tok), ' ' ORDER BY i) FILTER (pos = '{t}'), '') AS {c}"
    for t, c in (("VERB", "verbs"), ("ADJ", "adjs"), ("ADV", "advs"), ("NOUN", "nouns"))
)

def _report() -> str:
    """The report over the conversations with the default lexicons: a SELECT for each list."""
    rows = []

    def scalars(section: str, source: str, names: list[str], digits: int = 6) -> None:
        rows.extend(f"SELECT '{section}' AS section, 1 AS place, '{n}' AS metric, round({source}.\"{n}\"::DOUBLE, {digits}) AS value FROM {source}" for n in names)

    def listed(section, source, metric, value, order, limit=None, within="", digits=6):
        over = f"row_number() OVER ({f'PARTITION BY {within} ' if within else ''}ORDER BY {order})"
        cut = f" QUALIFY {over} <= {limit}" if limit else ""
        rows.append(f"SELECT '{section}', {over}, {metric}, round(({value})::DOUBLE, {digits}) FROM {source}{cut}")

    means = [f"mean_{t}" for t in tb.PROXY_TAGS]
    tags = _quoted(["VERB", "ADJ", "ADV", "NOUN"])
    hits = {
        "direction": (L.DIRECTION_WORDS, ["ADJ", "ADV", "NOUN"]), "speed": (L.SPEED_WORDS, ["ADJ", "ADV"]), "body_part": (L.BODY_PARTS, ["NOUN"]),
    }
    rates = ", ".join(f"{_in(words, _quoted(kinds))} > 0 AS {name}" for name, (words, kinds) in hits.items())
    labels = [(f"{c}_{kind}", tag, bag[c]) for kind, tag, bag in (("noun", "NOUN", L.ACTOR_NOUNS), ("pron", "PRON", L.PRONOUNS)) for c in ("male", "female", "neutral")]
    case = " ".join(f"WHEN {_in(words, _quoted([tag]))} > 0 THEN '{name}'" for name, tag, words in labels)
    nouns = [w for bag in L.ACTOR_NOUNS.values() for w in bag]
    scalars("corpus_stats", "scalars", ["num_captions", "avg_tokens", "std_tokens", "median_tokens", *means, "num_motions", "captions_per_motion_mean", "captions_per_motion_median", "vocab_size"])
    listed("corpus_stats", "vocab_counts", "'cnt: ' || token", "cnt", "cnt DESC, token", 10)
    listed("corpus_stats", "pos_counts", "'cnt: ' || pos", "cnt", "cnt DESC, pos")
    scalars("cues", "rates", [f"caption_rate_with_{n}" for n in ("direction_cues", "speed_cues", "body_part_mentions")], 3)
    listed("cues", "tag_counts", "'cnt: ' || pos || ': ' || token", "cnt", "cnt DESC, token", 10, "pos")
    listed("actors", "label_counts", "'rate: ' || label", "rate", "rate DESC, label", digits=3)
    listed("actors", "noun_counts", "'cnt: ' || token", "cnt", "cnt DESC, token", 10)
    for kind in ("gendered", "neutral"):
        listed("actors", "shares", f"'share_{kind}_captions: ' || motion_id", kind, "gendered DESC, motion_id", 5)
    scalars("redundancy", "duplicates", ["duplicate_rate"], 4)
    listed("redundancy", "gram_counts", "'cnt: ' || n || ': ' || ngram", "cnt", "cnt DESC, ngram", 10, "n")
    summary = {"mean_of_means": "avg(sim)", "median_of_means": "median(sim)"} | {
        f"q{round(p * 100)}": f"quantile_cont(sim, {p}::DOUBLE)" for p in L.QUANTILES
    }
    rows.extend(f"SELECT 'similarity', 1, '{n}: tfidf', round(({e})::DOUBLE, 6) FROM sims" for n, e in summary.items())
    listed("similarity", "sims", "'tfidf_most_consistent: ' || motion_id", "sim", "sim DESC NULLS LAST, motion_id", 10)
    listed("similarity", "sims", "'tfidf_least_consistent: ' || motion_id", "sim", "sim NULLS LAST, motion_id", 10)
    scalars("richness", "richness", ["TTR", "distinct-1", "distinct-2", "distinct-3", "mean_verbs_per_caption", "conj_rate"], 4)
    ratios = ", ".join(f"coalesce(count(DISTINCT gram) FILTER (n = {n}) / count(gram) FILTER (n = {n}), 0) AS \"distinct-{n}\"" for n in (1, 2, 3))
    counted = ", ".join(f"avg(len(list_filter(w, lambda x: length(x) % 6 = {i}))) AS mean_{t}" for i, t in enumerate(tb.PROXY_TAGS))

    def gram(words: str, n: int, separator: str) -> str:
        return f"list_transform(range(1, len({words}) - {n - 2}), lambda i: {f' || {separator} || '.join(f'{words}[i + {j}]' for j in range(n))})"

    return f"""WITH {CONVS}, {TOKENS}, {_tfidf()},
raw_grams AS (
    SELECT 1 AS n, unnest(w) AS gram FROM words UNION ALL SELECT 2, unnest({gram("w", 2, "chr(31)")}) FROM words
    UNION ALL SELECT 3, unnest({gram("w", 3, "chr(31)")}) FROM words),
norm AS (SELECT regexp_extract_all({_norm()}, '[^ ]+') AS t FROM captions),
norm_grams AS (
    SELECT 2 AS n, unnest({gram("t", 2, "' '")}) AS ngram FROM norm UNION ALL SELECT 3, unnest({gram("t", 3, "' '")}) FROM norm),
scalars AS (
    SELECT * FROM (SELECT count(*) AS num_captions, avg(len(w)) AS avg_tokens, stddev_samp(len(w)) AS std_tokens,
                          median(len(w)) AS median_tokens, {counted} FROM words)
    CROSS JOIN (SELECT count(*) AS num_motions, avg(n) AS captions_per_motion_mean, median(n) AS captions_per_motion_median
                FROM (SELECT count(*) AS n FROM captions GROUP BY motion_id))
    CROSS JOIN (SELECT count(DISTINCT lower(tok)) AS vocab_size FROM tokens)),
vocab_counts AS (SELECT lower(tok) AS token, count(*) AS cnt FROM tokens GROUP BY 1),
pos_counts AS (SELECT pos, count(*) AS cnt FROM tokens GROUP BY 1),
tag_counts AS (SELECT pos, lower(tok) AS token, count(*) AS cnt FROM tokens WHERE pos IN ({tags}) GROUP BY ALL),
noun_counts AS (SELECT lower(tok) AS token, count(*) AS cnt FROM tokens WHERE pos = 'NOUN' AND lower(tok) IN ({_quoted(nouns)}) GROUP BY 1),
said AS (
    SELECT motion_id, caption_id, {rates}, CASE {case} ELSE 'none' END AS label
    FROM captions LEFT JOIN tokens USING (motion_id, caption_id) GROUP BY ALL),
rates AS (
    SELECT avg(direction::INT) AS caption_rate_with_direction_cues, avg(speed::INT) AS caption_rate_with_speed_cues,
           avg(body_part::INT) AS caption_rate_with_body_part_mentions FROM said),
label_counts AS (SELECT label, count(*) / (SELECT count(*) FROM said) AS rate FROM said GROUP BY 1),
shares AS (
    SELECT motion_id, avg((label IN ('male_noun', 'female_noun', 'male_pron', 'female_pron'))::INT) AS gendered,
           avg((label IN ('neutral_noun', 'neutral_pron'))::INT) AS neutral FROM said GROUP BY 1),
duplicates AS (SELECT 1 - count(DISTINCT {_norm()}) / count(*) AS duplicate_rate FROM captions),
gram_counts AS (SELECT n, ngram, count(*) AS cnt FROM norm_grams GROUP BY ALL),
richness AS (
    SELECT * FROM (SELECT count(DISTINCT lower(tok)) / count(*) AS "TTR", count(*) FILTER (lower(tok) IN ({_quoted(L.CONNECTIVES)})) / count(*) AS conj_rate FROM tokens)
    CROSS JOIN (SELECT {ratios} FROM raw_grams)
    CROSS JOIN (SELECT avg(len(list_filter(w, lambda x: length(x) % 6 = 1))) AS mean_verbs_per_caption FROM words)),
report AS ({" UNION ALL ".join(f"({r})" for r in rows)})
SELECT section, place::BIGINT AS place, metric, value FROM report"""


def _lloyd(key: str) -> str:
    """Lloyd's rounds over the vectors, one CTE per step."""
    ctes = [
        f"e AS (SELECT {key} AS dataset, vec_id::VARCHAR AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)",
        f"""c0 AS MATERIALIZED (
    SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY md5(id), id) - 1 AS cluster, v AS centre, 0 AS cnt FROM e
    QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY md5(id), id) <= {LLOYD_K})""",
    ]
    for r in range(1, LLOYD_ROUNDS + 1):
        ctes.append(f"""a{r} AS (
    SELECT dataset, cluster, v FROM (
        SELECT dataset, id, cluster, v, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - centre[i]) ** 2)) AS d
        FROM e JOIN c{r - 1} USING (dataset))
    QUALIFY row_number() OVER (PARTITION BY dataset, id ORDER BY d, cluster) = 1),
m{r} AS (
    SELECT dataset, cluster, list(m ORDER BY i) AS mean, any_value(n) AS n FROM (
        SELECT dataset, cluster, i, avg(x) AS m, count(*) AS n
        FROM (SELECT dataset, cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY ALL)
    GROUP BY dataset, cluster),
c{r} AS MATERIALIZED (
    SELECT dataset, cluster, coalesce(mean, centre) AS centre, coalesce(n, 0) AS cnt FROM c{r - 1} LEFT JOIN m{r} USING (dataset, cluster))""")
    return "WITH " + ", ".join(ctes) + f" SELECT dataset, cluster, cnt, {_r('centre[1]', 'first')} FROM c{LLOYD_ROUNDS}"


def _factors() -> str:
    """Multiplicative updates of both factors, one CTE per step."""
    k = TOPICS

    def first(name: str, kind: str) -> str:
        cells = ", ".join(f"0.5::DOUBLE + ('0x' || substr(md5('{kind}{j}:' || {name}), 1, 8))::BIGINT / 4294967296.0::DOUBLE" for j in range(k))
        return f"{kind}0 AS MATERIALIZED (SELECT DISTINCT {name}, [{cells}] AS f FROM counts)"

    ctes = [
        CONVS, _tfidf(),
        """counts AS MATERIALIZED (
    SELECT caption_id AS doc, term, tf::DOUBLE AS x FROM terms
    WHERE term IN (SELECT term FROM terms GROUP BY term HAVING count(*) >= 2))""",
        first("doc", "w"), first("term", "h"),
    ]
    sums = ", ".join(f"sum(x * f[{j + 1}])" for j in range(k))
    gram = ", ".join(f"sum(f[{i + 1}] * f[{j + 1}])" for i in range(k) for j in range(k))
    cells = ", ".join(
        f"f[{j + 1}] * s[{j + 1}] / ({' + '.join(f'f[{i + 1}] * g[{i * k + j + 1}]' for i in range(k))} + 1e-12::DOUBLE)" for j in range(k)
    )
    for r in range(1, TOPIC_ROUNDS + 1):
        for mine, name, other, other_name in ((f"h{r}", "term", f"w{r - 1}", "doc"), (f"w{r}", "doc", f"h{r}", "term")):
            old = f"{mine[0]}{r - 1}"
            ctes.append(f"""s_{mine} AS MATERIALIZED (SELECT {name}, [{sums}] AS s FROM counts JOIN {other} USING ({other_name}) GROUP BY {name}),
g_{mine} AS MATERIALIZED (SELECT [{gram}] AS g FROM {other}),
{mine} AS MATERIALIZED (SELECT {name}, [{cells}] AS f FROM {old} JOIN s_{mine} USING ({name}) CROSS JOIN g_{mine})""")
    return "WITH " + ", ".join(ctes) + f""",
flat AS (SELECT term, unnest(f) AS v, generate_subscripts(f, 1) - 1 AS topic FROM h{TOPIC_ROUNDS}),
topic_shares AS (SELECT topic, term, v / sum(v) OVER (PARTITION BY topic) AS weight FROM flat),
placed AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) - 1 AS rank FROM topic_shares)
SELECT topic, rank, term, {_r('weight', 'weight')} FROM placed WHERE rank < 12"""


LEXICON = """lexicon AS (
    SELECT word, 'c' || (min(item_id) % 3) AS category FROM (
        SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark)
    WHERE word <> '' GROUP BY word)"""
LEXICON_ON = "lower(tok) = word AND (category <> 'c2' OR pos IN ('NOUN', 'VERB'))"

LETTERS = ", ".join(
    f"length(description) - length(replace(description, '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz"
)

ORACLES: dict[str, str] = {
    "parse_pos": f"""WITH {CONVS}, {TOKENS}
SELECT caption_id, coalesce(string_agg(tok, ' ' ORDER BY i), '') AS tokens, coalesce(string_agg(pos, ' ' ORDER BY i), '') AS tags
FROM captions LEFT JOIN tokens USING (caption_id) GROUP BY caption_id""",
    # DuckDB upper-cases a sharp s to one letter, Unicode (and so Java and Python) to SS.
    "parse_pos_raw": """WITH items AS (
    SELECT page_id::VARCHAR AS caption_id, list_filter(regexp_extract_all(html, '[^\\s]+'), lambda w: regexp_matches(w, '^.+/[^/]*$')) AS w FROM pages)
SELECT caption_id, len(w) AS num_tokens,
       array_to_string(list_transform(w, lambda x: regexp_extract(x, '^(.+)/[^/]*$', 1)), ' ') AS tokens,
       array_to_string(list_transform(w, lambda x: upper(replace(regexp_extract(x, '/([^/]*)$', 1), 'ß', 'ss'))), ' ') AS tags
FROM items""",
    "tokens_by_pos": f"""WITH {CONVS}, {TOKENS}
SELECT caption_id, pos, string_agg(tok, ' ' ORDER BY i) AS tokens FROM tokens GROUP BY ALL""",
    "normalised_text": f"WITH {DOCS} SELECT caption_id, {_norm()} AS desc_norm FROM captions",
    "tag_mismatch": f"""WITH {DOCS}
SELECT caption_id, motion_id FROM captions
WHERE len(regexp_extract_all(description, '[^\\s]+')) <> len(regexp_extract_all({_norm()}, '[^\\s]+'))""",
    "caption_lines": f"""WITH {LINES}
SELECT motion_id, motion_id || ':' || line_no AS caption_id, string_split(line, '#')[1] AS description,
       string_split(line, '#')[2] AS pos_tags, n_chars::DOUBLE AS num1, try_cast(string_split(line, '#')[4] AS DOUBLE) AS num2
FROM fields WHERE fields = 4""",
    "rejected_caption_lines": f"WITH {LINES} SELECT motion_id, line_no, line, fields FROM fields WHERE fields <> 4",
    "corpus_scalars": _scalars(),
    "corpus_scalars_by_lang": _scalars("dataset"),
    "vocab_table": f"WITH {DOCS}, {TOKENS} SELECT lower(tok) AS token, count(*) AS cnt FROM tokens GROUP BY 1",
    "vocab_size": f"WITH {DOCS}, {TOKENS} SELECT count(DISTINCT lower(tok)) AS vocab_size FROM tokens",
    "top_words": f"""WITH {DOCS}, {TOKENS}
SELECT lower(tok) AS token, count(*) AS cnt FROM tokens GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "top_words_first_seen": f"""WITH {DOCS}, {TOKENS}
SELECT lower(tok) AS token, count(*) AS cnt FROM tokens GROUP BY 1 ORDER BY 2 DESC, min(ROW(caption_id, i)) LIMIT 200""",
    "top_by_pos_first_seen": f"""WITH {CONVS}, {TOKENS}, c AS (
    SELECT pos, lower(tok) AS token, count(*) AS cnt, min(ROW(caption_id, i)) AS seen FROM tokens
    WHERE pos IN ('VERB', 'ADJ', 'ADV', 'NOUN') GROUP BY ALL)
SELECT pos, token, cnt FROM c QUALIFY row_number() OVER (PARTITION BY pos ORDER BY cnt DESC, seen) <= 100""",
    "top_actor_nouns_first_seen": f"""WITH {DOCS}, {TOKENS}, lex(token, category) AS (VALUES {", ".join(f"('{w}', '{c}')" for c, bag in tb.PROXY_ACTORS.items() for w in bag)}),
c AS (SELECT dataset, token, count(*) AS cnt, category, min(ROW(caption_id, i)) AS seen FROM tokens JOIN lex ON lower(tok) = token WHERE pos = 'NOUN' GROUP BY ALL)
SELECT dataset, token, cnt, category FROM c QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY cnt DESC, seen) <= 20""",
    "top_ngrams_first_seen": f"""WITH {CONVS},
norm AS (SELECT caption_id, regexp_extract_all({_norm()}, '[^ ]+') AS t FROM captions),
grams AS (
    SELECT caption_id, 2 AS n, t[i] || ' ' || t[i + 1] AS ngram, i FROM (SELECT caption_id, t, unnest(range(1, len(t))) AS i FROM norm)
    UNION ALL
    SELECT caption_id, 3, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2], i FROM (SELECT caption_id, t, unnest(range(1, len(t) - 1)) AS i FROM norm)),
counts AS (SELECT n, ngram, count(*) AS cnt, min(ROW(caption_id, i)) AS seen FROM grams GROUP BY ALL)
SELECT n::BIGINT AS n, ngram, cnt FROM counts QUALIFY row_number() OVER (PARTITION BY n ORDER BY cnt DESC, seen) <= 100""",
    "pos_distribution": f"WITH {DOCS}, {TOKENS} SELECT pos, count(*) AS cnt FROM tokens GROUP BY 1",
    "pos_means": f"WITH {DOCS}, {TOKENS} SELECT "
    + ", ".join(
        _r(f"(SELECT count(*) FROM tokens WHERE pos = '{t}') / (SELECT count(*) FROM captions)", f"mean_{t}")
        for t in tb.PROXY_TAGS
    ),
    "captions_per_group": f"""WITH {CONVS}, s AS (SELECT motion_id, count(*) AS n FROM captions GROUP BY 1)
SELECT count(*) AS num_motions, {_r('avg(n)', 'captions_per_motion_mean')}, {_r('median(n)', 'captions_per_motion_median')} FROM s""",
    "cue_features": f"""WITH {CONVS}, {TOKENS}
SELECT caption_id, {TOKEN_LISTS}, {HITS} FROM captions LEFT JOIN tokens USING (caption_id) GROUP BY caption_id""",
    "cue_rates": f"""WITH {DOCS}, {TOKENS}, h AS (
    SELECT caption_id, {HITS} FROM captions LEFT JOIN tokens USING (caption_id) GROUP BY caption_id)
SELECT {_r('avg((direction_hits > 0)::INT)', 'caption_rate_with_direction_cues')},
       {_r('avg((speed_hits > 0)::INT)', 'caption_rate_with_speed_cues')},
       {_r('avg((body_part_mentions > 0)::INT)', 'caption_rate_with_body_part_mentions')} FROM h""",
    "top_by_pos": f"""WITH {DOCS}, {TOKENS}, c AS (
    SELECT pos, lower(tok) AS token, count(*) AS cnt FROM tokens WHERE pos IN ('VERB', 'ADJ', 'ADV', 'NOUN') GROUP BY ALL)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY pos ORDER BY cnt DESC, token) <= 30""",
    "actor_features": f"""{ADDRESSED} SELECT caption_id, noun_male, noun_female, noun_neutral, pron_male, pron_female,
       pron_neutral, addressing_label FROM labelled""",
    "label_rates": f"""{ADDRESSED} SELECT addressing_label AS label, count(*) AS cnt,
       {_r('count(*) / (SELECT count(*) FROM labelled)', 'rate')} FROM labelled GROUP BY 1""",
    "group_shares": f"{ADDRESSED} SELECT {SHARES} FROM shares",
    "top_group_shares": f"{ADDRESSED} SELECT {SHARES} FROM (SELECT * FROM shares ORDER BY gendered DESC, motion_id LIMIT 5)",
    "top_actor_nouns": f"""WITH {DOCS}, {TOKENS}, lex(token, category) AS (VALUES {", ".join(f"('{w}', '{c}')" for c, bag in tb.PROXY_ACTORS.items() for w in bag)})
SELECT token, count(*) AS cnt, category FROM tokens JOIN lex ON lower(tok) = token WHERE pos = 'NOUN'
GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 20""",
    "duplicate_rate": f"WITH {DOCS} SELECT {_r(f'1 - count(DISTINCT {_norm()}) / count(*)', 'duplicate_rate')} FROM captions",
    "top_ngrams": _grams(),
    "top_ngrams_by_lang": _grams("dataset"),
    "distinct_ngrams": f"""WITH {DOCS}, {TOKENS}, {DISTINCT}
SELECT n::BIGINT AS n, count(DISTINCT gram) AS distinct_cnt, count(*) AS total_cnt,
       {_r('count(DISTINCT gram) / count(*)', 'ratio')} FROM raw GROUP BY n""",
    "lexical_richness": _richness(),
    "lexical_richness_by_lang": _richness("dataset"),
    "tfidf_vocabulary": f"WITH {DOCS}, {_tfidf()} SELECT term, df, {_r('idf', 'idf')} FROM vocab",
    "tfidf_weights": f"WITH {CONVS}, {_tfidf()} SELECT motion_id, caption_id, term, {_r('w', 'w')} FROM weights",
    "tfidf_similarity": _similarity(CONVS, "FROM sims"),
    "tfidf_similarity_documents": _similarity(DOCS, "FROM sims"),
    "tfidf_similarity_by_lang": _similarity(DOCS, "FROM sims", "dataset", f"dataset, {SIM_COLUMNS}"),
    "dense_similarity": f"WITH {_dense('label::VARCHAR')} {DENSE_SIM}",
    "dense_similarity_any_length": f"WITH {_dense('label::VARCHAR')} {DENSE_SIM}",
    "dense_similarity_pairs": f"WITH {_dense(OCTET)} {DENSE_SIM}",
    "raw_pair_similarity": f"WITH {_dense(OCTET, '2.5::DOUBLE')} {DENSE_SIM}",
    "encoder_similarity": f"""WITH {CONVS}, counts AS (
    SELECT motion_id AS g, caption_id AS id, list_transform([{LETTERS}], lambda x: x::DOUBLE) AS c FROM captions),
e AS (SELECT g, id, list_transform(c, lambda x: CASE WHEN list_sum(c) = 0 THEN 0 ELSE x / sqrt(list_sum(list_transform(c, lambda y: y * y))) END) AS v FROM counts),
{DENSE_PAIRS} {DENSE_SIM}""",
    "most_consistent": _similarity(CONVS, "FROM (SELECT * FROM sims ORDER BY sim DESC NULLS LAST, motion_id LIMIT 10)"),
    "least_consistent": _similarity(CONVS, "FROM (SELECT * FROM sims ORDER BY sim NULLS LAST, motion_id LIMIT 10)"),
    "similarity_summary": f"WITH {CONVS}, {_tfidf()} {_summary('sims')}",
    "backend_comparison": f"""WITH {DOCS}, {_tfidf()}, e AS (
    SELECT motion_id AS g, vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v
    FROM captions JOIN embeddings ON vec_id::VARCHAR = caption_id),
{DENSE_PAIRS}, merged AS (
    SELECT 'tfidf' AS backend, sim FROM sims
    UNION ALL SELECT 'embeddings', avg(d) FROM sizes LEFT JOIN pairs USING (g) GROUP BY g),
found AS (SELECT count(*) AS n, count(*) FILTER (caption_id IN (SELECT vec_id::VARCHAR FROM embeddings)) AS known FROM captions)
SELECT s.*, CASE backend WHEN 'tfidf' THEN n ELSE known END AS num_captions, CASE backend WHEN 'tfidf' THEN 0 ELSE n - known END AS num_missing
FROM ({_summary('merged', 'backend')}) s CROSS JOIN found""",
    "length_quantiles": "SELECT lang, count(*) AS n, "
    + ", ".join(_r(f"quantile_cont(n_chars::DOUBLE, {p}::DOUBLE)", n) for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)))
    + " FROM documents GROUP BY lang",
    "l2_normalize": f"""WITH e AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3.0::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e)
SELECT vec_id::VARCHAR AS caption_id, dim - 1 AS dim, {_r('x / n', 'value')}
FROM (SELECT vec_id, n, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM u)""",
    "mean_pool": f"""WITH e AS (
    SELECT {OCTET} AS motion_id, (embedding[1] > 0)::INT AS mask, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT motion_id, dim, {_r('sum(mask * x) / greatest(sum(mask), 1e-6::DOUBLE)', 'value')} FROM e GROUP BY ALL""",
    "caption_distance": f"{DISTANCES} SELECT {DISTANCE_COLUMNS} FROM dist",
    "caption_distance_blocks": DISTANCES.replace(OCTET, "label::VARCHAR") + f" SELECT {DISTANCE_COLUMNS} FROM dist",
    "kmeans_rows": "SELECT count(*) AS n_rows FROM embeddings",
    "caption_distance_summary": f"{DISTANCES} SELECT "
    + ", ".join(
        _r(f"{f}({c})", f"{c}_{n}")
        for c in ("dist_mean", "dist_median")
        for n, f in (("min", "min"), ("median", "median"), ("mean", "avg"), ("max", "max"))
    )
    + " FROM dist",
    "most_diverse": f"{DISTANCES} SELECT {DISTANCE_COLUMNS} FROM (SELECT * FROM dist ORDER BY dist_mean DESC, motion_id LIMIT 10)",
    "group_pairs": f"""WITH {CONVS}
SELECT a.motion_id, a.caption_id AS caption_a, b.caption_id AS caption_b, a.description AS text_a, b.description AS text_b, 1.0::DOUBLE AS label
FROM captions a JOIN captions b ON a.motion_id = b.motion_id AND a.caption_id < b.caption_id""",
    "group_pairs_by_corpus": f"""WITH {CONVS}, grouped AS (
    SELECT (motion_id::INT % 50)::VARCHAR AS motion_id, caption_id, dataset FROM captions)
SELECT dataset, motion_id, a.caption_id AS caption_a, b.caption_id AS caption_b, 1.0::DOUBLE AS label
FROM grouped a JOIN grouped b USING (dataset, motion_id) WHERE a.caption_id < b.caption_id""",
    "group_pairs_capped": _pairs(DOCS, "motion_id, caption_a, caption_b, label"),
    "threshold_ids": f"WITH {CONVS}, {_tfidf()}, {LIMITS} SELECT threshold, motion_id FROM sims JOIN limits ON sim < threshold",
    "threshold_counts": f"""WITH {CONVS}, {_tfidf()}, {LIMITS}
SELECT threshold, count(motion_id) AS num_bad FROM limits LEFT JOIN sims ON sim < threshold GROUP BY threshold""",
    "group_lookup": _similarity(CONVS, "FROM sims WHERE motion_id = '7'"),
    "curated_anti": f"""WITH {CONVS}, {_tfidf()}, {BAD}
SELECT motion_id, caption_id, description FROM captions WHERE motion_id NOT IN (SELECT motion_id FROM bad)""",
    "curated_anti_by_lang": f"""WITH {DOCS}, {_tfidf("dataset")}
SELECT dataset, motion_id, caption_id FROM captions
WHERE (dataset, motion_id) NOT IN (SELECT (dataset, motion_id) FROM sims WHERE sim < 0.05)""",
    "pruned_semi": f"""WITH {CONVS}, {_tfidf()}, {WORSE}
SELECT motion_id, caption_id FROM captions WHERE motion_id IN (SELECT motion_id FROM bad)""",
    "curated_splits": f"""WITH {CONVS}, {_tfidf()}, {BAD}
SELECT dataset AS split, ' ' || motion_id || chr(9) AS line FROM captions WHERE motion_id NOT IN (SELECT motion_id FROM bad)""",
    "deletion_manifest": f"""WITH {CONVS}, {_tfidf()}, {WORSE},
wanted AS (
    SELECT motion_id, 'texts' AS artefact, motion_id || '.txt' AS file_name, 0 AS turn FROM bad
    UNION ALL SELECT motion_id, 'animations', motion_id || '.mp4', 2 FROM bad)
SELECT w.motion_id, artefact, file_name, CASE WHEN c.caption_id IS NOT NULL THEN artefact || '/' || file_name END AS path,
       c.caption_id IS NOT NULL AS "exists"
FROM wanted w LEFT JOIN captions c ON c.motion_id = w.motion_id AND c.line_no = w.turn""",
    "split_frames": "WITH parts(part, first, last) AS (VALUES "
    + ", ".join(f"('{n}', {a}, {b})" for n, (a, b) in PARTS.items())
    + f""")
SELECT vec_id AS frame, part, i - first AS i, {_r('embedding[i]', 'value')}
FROM embeddings, (SELECT part, first, unnest(range(first, last + 1)) AS i FROM parts)""",
    "frame_mse": f"WITH {MSE} SELECT motion_id, frame, {_r('mse', 'mse', 9)} FROM mse",
    "motion_extremes": f"WITH {MSE} SELECT motion_id, {_r('hi', 'max_mse', 9)}, {_r('lo', 'min_mse', 9)} FROM ext",
    "global_extremes": f"""WITH {MSE}
SELECT {_r('(SELECT max(hi) FROM ext)', 'max_mse', 9)}, (SELECT motion_id FROM ext ORDER BY hi DESC, motion_id LIMIT 1) AS max_file,
       {_r('(SELECT min(lo) FROM ext)', 'min_mse', 9)}, (SELECT motion_id FROM ext ORDER BY lo, motion_id LIMIT 1) AS min_file""",
    "twin_status": """WITH f AS (SELECT label, embedding, embedding[1] AS x FROM embeddings),
a AS (SELECT label::VARCHAR AS motion_id, 2::BIGINT AS ndim_vec, count(*) AS n_frames_vec FROM f GROUP BY label),
b AS (
    SELECT label::VARCHAR AS motion_id, CASE WHEN label % 7 = 5 THEN 2 ELSE 3 END::BIGINT AS ndim_joints, count(*) AS n_frames_joints,
           bool_or(label % 5 = 1 AND x > 0) AS short
    FROM f WHERE label % 3 <> 0 OR x > 0 GROUP BY label)
SELECT motion_id, ndim_vec, n_frames_vec, ndim_joints, n_frames_joints,
       CASE WHEN ndim_vec IS NULL OR ndim_joints IS NULL THEN 'missing' WHEN ndim_joints <> 3 THEN 'bad_rank'
            WHEN n_frames_vec <> n_frames_joints THEN 'frame_mismatch' WHEN short THEN 'bad_width' ELSE 'ok' END AS status
FROM a FULL JOIN b USING (motion_id)""",
    "full_report": _report(),
    "lloyd_sizes": _lloyd("'all'").replace("SELECT dataset, cluster, cnt,", "SELECT cluster, cnt,"),
    "lloyd_sizes_by_label": _lloyd("(label % 3)::VARCHAR"),
    "factor_topics": _factors(),
    "approximate_groups": """WITH words AS (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents)
SELECT lang AS dataset, count(DISTINCT word) AS exact, TRUE AS close FROM words GROUP BY lang
UNION ALL SELECT 'all', count(DISTINCT word), TRUE FROM words""",
    "lexicon_table_hits": f"""WITH {CONVS}, {TOKENS}, {LEXICON}
SELECT caption_id, count(*) FILTER (category = 'c0') AS c0, count(*) FILTER (category = 'c1') AS c1, count(*) FILTER (category = 'c2') AS c2
FROM captions LEFT JOIN (SELECT caption_id, category FROM tokens JOIN lexicon ON {LEXICON_ON}) USING (caption_id) GROUP BY caption_id""",
    "lexicon_table_counts": f"""WITH {DOCS}, {TOKENS}, {LEXICON}
SELECT dataset, word AS token, category, count(*) AS cnt FROM tokens JOIN lexicon ON {LEXICON_ON} GROUP BY ALL""",
    "array_scan": f"""SELECT (vec_id // 256)::VARCHAR AS motion_id, 2 AS ndim, count(*) OVER g AS n_frames,
       row_number() OVER (g ORDER BY vec_id) - 1 AS frame, len(embedding) AS width, {_r('embedding[1]', 'first')}, {_r('embedding[len(embedding)]', 'last')}
FROM embeddings WINDOW g AS (PARTITION BY vec_id // 256)""",
    "split_lists": f"""WITH {CONVS}
SELECT dataset AS split, row_number() OVER (PARTITION BY dataset ORDER BY caption_id) - 1 AS line_no, ' ' || caption_id AS line FROM captions""",
    "caption_files": f"""WITH {CONVS}, placed AS (
    SELECT motion_id, line_no, description, row_number() OVER (PARTITION BY motion_id ORDER BY line_no) - 1 AS place FROM captions)
SELECT motion_id, motion_id || ':' || place AS caption_id,
       regexp_replace(translate(description, '#' || chr(10) || chr(13), '   '), '^\\s+', '') AS description, 1.5::DOUBLE AS num1, line_no::DOUBLE AS num2
FROM placed""",
    "similarity_csv": _similarity(CONVS, "FROM sims"),
    "twin_report": f"""WITH {MSE}
SELECT motion_id, CASE WHEN motion_id::INT % 4 = 0 THEN 'frame_mismatch' ELSE 'ok' END AS status,
       CASE WHEN motion_id::INT % 4 <> 0 THEN {_r('hi', 'x', 9).removesuffix(' AS x')} END AS max_mse,
       CASE WHEN motion_id::INT % 4 <> 0 THEN {_r('lo', 'x', 9).removesuffix(' AS x')} END AS min_mse
FROM ext""",
}
