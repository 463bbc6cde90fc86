"""The registered queries as single DuckDB statements."""

from __future__ import annotations

import math

from plaudit.constants import HTML_ENTITIES, SIMILARITY_THRESHOLD, STOP_WORDS
from plaudit.functions.text import WHITESPACE_CLASS as WS

TARGET = "src0"
METRICS = (
    "avg_stars", "pct_positive", "pct_neutral", "pct_negative", "avg_review_words",
    "avg_title_words", "review_word_count", "wc_positive", "wc_neutral", "wc_negative",
    "review_count",
)
SHARES = ("pct_positive", "pct_neutral", "pct_negative")


# --- text --------------------------------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, ' ', 'g')"


def newlines(x: str) -> str:
    return sub(rf"replace(replace({x}, '\n', ' '), '\t', ' ')", r"[\n\r\t]")


def no_html(x: str) -> str:
    for entity, character in HTML_ENTITIES:
        x = f"replace({x}, {quoted(entity)}, {quoted(character)})"
    return sub(x, "<[^>]+>")


def no_urls(x: str) -> str:
    return sub(sub(x, f"https?://[^{WS}]+"), rf"www\.[^{WS}]+")


def no_emails(x: str) -> str:
    return sub(x, rf"[^{WS}]+@[^{WS}]+\.[^{WS}]+")


def ascii_only(x: str) -> str:
    return rf"regexp_replace(strip_accents({x}), '[^\x00-\x7f]', '', 'g')"


def no_symbols(x: str) -> str:
    return sub(x, rf"[^a-zA-Z0-9{WS}.,!?'\-]")


def squeezed(x: str) -> str:
    return f"trim({sub(x, f'[{WS}]+')})"


def clean(x: str) -> str:
    x = f"coalesce({x}, '')"
    for step in (newlines, no_html, no_urls, no_emails, ascii_only, no_symbols, squeezed):
        x = step(x)
    return x


def word_list(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '[{WS}]+'), lambda w: w <> '')"


def word_count(x: str) -> str:
    return f"CAST(len({word_list(x)}) AS INTEGER)"


def char_len(x: str) -> str:
    return f"CAST(length(coalesce({x}, '')) AS INTEGER)"


# --- shared tables -----------------------------------------------------------------------------

TABLES = {
    "raw": """
        SELECT doc_id AS review_id, lang AS category, source AS company,
               concat('Company ', source) AS description,
               split_part(text, chr(10), 1) AS title, text AS review,
               CAST(1 + (doc_id * 7 + n_chars) % 5 AS INTEGER) AS stars
        FROM documents""",
    "cleaned": f"""
        SELECT review_id, category, company, {clean("description")} AS description,
               {clean("title")} AS title, {clean("review")} AS review, stars
        FROM raw""",
    "features": f"""
        SELECT *, {char_len("title")} AS title_char_len, {word_count("title")} AS title_word_count,
               {char_len("review")} AS review_char_len, {word_count("review")} AS review_word_count
        FROM cleaned""",
}


def two(x: str) -> str:
    return f"round_even(({x}) * 100, 0) / 100"


def _stats() -> str:
    tiers = {"positive": "stars >= 4", "neutral": "stars = 3", "negative": "stars <= 2"}
    pct = ",\n".join(
        f"{two(f'avg(CASE WHEN {c} THEN 1 ELSE 0 END) * 100')} AS pct_{t}" for t, c in tiers.items()
    )
    wc = ",\n".join(
        f"{two(f'coalesce(avg(CASE WHEN {c} THEN review_word_count END), 0)')} AS wc_{t}"
        for t, c in tiers.items()
    )
    return f"""
        SELECT category, company, {two("avg(stars)")} AS avg_stars, {pct},
               {two("avg(review_word_count)")} AS avg_review_words,
               {two("avg(title_word_count)")} AS avg_title_words,
               {two("avg(review_word_count)")} AS review_word_count, {wc},
               count(review) AS review_count
        FROM features WHERE company IS NOT NULL GROUP BY category, company"""


TABLES["stats"] = _stats()
TABLES["seeds"] = """
    SELECT label AS topic_id, generate_subscripts(embedding, 1) - 1 AS pos,
           CAST(unnest(embedding) AS DOUBLE) AS v
    FROM embeddings"""
TABLES["means"] = "SELECT topic_id, pos, avg(v) AS value FROM seeds GROUP BY topic_id, pos"
TABLES["cents"] = "SELECT topic_id, list(value ORDER BY pos) AS centroid FROM means GROUP BY topic_id"
TABLES["vectors"] = """
    SELECT c.*, CAST(e.embedding AS DOUBLE[]) AS embedding
    FROM cleaned c LEFT JOIN embeddings e ON e.vec_id = c.review_id
    WHERE trim(c.review) <> ''"""
TABLES["scored"] = """
    SELECT review_id, topic_id, list_cosine_similarity(embedding, centroid) AS similarity,
           row_number() OVER (PARTITION BY review_id
                              ORDER BY list_cosine_similarity(embedding, centroid) DESC, topic_id) AS r
    FROM vectors, cents WHERE embedding IS NOT NULL"""
TABLES["assembled"] = f"""
    SELECT v.review_id, v.category, v.company, v.description, v.title, v.review, v.stars,
           v.company = '{TARGET}' AS is_target,
           CASE WHEN similarity >= {SIMILARITY_THRESHOLD} THEN topic_id ELSE -1 END AS topic_id,
           CASE WHEN similarity >= {SIMILARITY_THRESHOLD} THEN concat('topic_', topic_id)
                ELSE 'General / Other' END AS macro_topic,
           similarity AS topic_similarity,
           CASE WHEN stars >= 4 THEN 'positive' WHEN stars = 3 THEN 'neutral' ELSE 'negative' END AS sentiment,
           CAST(CASE WHEN stars = 3 THEN 0.70 ELSE 0.95 END AS DOUBLE) AS sentiment_score,
           CASE WHEN stars >= 4 THEN 1 WHEN stars = 3 THEN 0 ELSE -1 END AS sentiment_num
    FROM vectors v LEFT JOIN scored s ON s.review_id = v.review_id AND s.r = 1"""
TABLES["shares"] = """
    SELECT is_target, macro_topic, count(*) AS n_reviews,
           avg(CASE WHEN sentiment = 'positive' THEN 1 ELSE 0 END) * 100 AS pct_positive,
           avg(CASE WHEN sentiment = 'neutral' THEN 1 ELSE 0 END) * 100 AS pct_neutral,
           avg(CASE WHEN sentiment = 'negative' THEN 1 ELSE 0 END) * 100 AS pct_negative,
           avg(topic_similarity) AS avg_similarity
    FROM assembled GROUP BY is_target, macro_topic"""
TABLES["summary"] = """
    SELECT *, pct_positive - pct_negative AS net_sentiment,
           CASE WHEN pct_positive >= pct_neutral AND pct_positive >= pct_negative THEN 'positive'
                WHEN pct_neutral >= pct_negative THEN 'neutral' ELSE 'negative' END AS dominant_sentiment
    FROM shares"""
TABLES["merged"] = """
    SELECT t.macro_topic, t.net_sentiment AS net_sentiment_target, t.n_reviews AS n_reviews_target,
           c.net_sentiment AS net_sentiment_comp, c.n_reviews AS n_reviews_comp,
           t.net_sentiment - c.net_sentiment AS gap
    FROM (SELECT * FROM summary WHERE is_target) t
    JOIN (SELECT * FROM summary WHERE NOT is_target) c USING (macro_topic)
    WHERE macro_topic <> 'General / Other'"""
TABLES["weak"] = "SELECT * FROM merged WHERE gap < -5 AND n_reviews_target >= 3"


def tokens(source: str, keep: str) -> str:
    stop = ", ".join(quoted(w) for w in STOP_WORDS)
    return f"""
        SELECT {keep}, word FROM (
            SELECT {keep}, trim(unnest({word_list("lower(review)")}), '.,!?:;"''') AS word
            FROM {source})
        WHERE length(word) > 3 AND regexp_matches(word, '^\\p{{L}}+$') AND word NOT IN ({stop})"""


TABLES["negative_words"] = tokens(
    "(SELECT * FROM assembled WHERE sentiment = 'negative')", "is_target, macro_topic"
)
TABLES["weak_words"] = tokens(
    "(SELECT a.* FROM assembled a JOIN weak w USING (macro_topic) WHERE sentiment = 'negative')",
    "is_target, macro_topic",
)
TABLES["tone_words"] = tokens("assembled", "is_target, sentiment_num")
TABLES["topic_words"] = tokens(
    "(SELECT * FROM assembled WHERE macro_topic <> 'General / Other')", "macro_topic"
)

NEEDS = {
    "cleaned": ["raw"],
    "features": ["cleaned"],
    "stats": ["features"],
    "means": ["seeds"],
    "cents": ["means"],
    "vectors": ["cleaned"],
    "scored": ["vectors", "cents"],
    "assembled": ["vectors", "scored"],
    "shares": ["assembled"],
    "summary": ["shares"],
    "merged": ["summary"],
    "weak": ["merged"],
    "negative_words": ["assembled"],
    "weak_words": ["assembled", "weak"],
    "tone_words": ["assembled"],
    "topic_words": ["assembled"],
}


def statement(body: str, *names: str) -> str:
    """A statement with the named shared tables, and what they need, in front."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for needed in NEEDS.get(name, []):
            add(needed)
        ordered.append(name)

    for name in names:
        add(name)
    tables = ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n]})" for n in ordered)
    joint = "" if body.startswith(",") else "\n"  # a body that begins with a comma adds tables of its own
    return f"WITH {tables}{joint}{body}" if ordered else body


def six(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


# --- statements --------------------------------------------------------------------------------

ORACLES: dict[str, str] = {}

ORACLES["clean_text_documents"] = f"SELECT doc_id, {clean('text')} AS text FROM documents"
ORACLES["clean_text_pages"] = f"SELECT page_id, {clean('html')} AS html FROM pages"
ORACLES["clean_text_conversations"] = (
    f"SELECT conv_id, turn, {clean('text')} AS text FROM conversations"
)
ORACLES["text_steps"] = f"""
    SELECT page_id, {newlines("html")} AS newlines, {no_html("html")} AS no_html,
           {no_urls("html")} AS no_urls, {no_emails("html")} AS no_emails,
           {ascii_only("html")} AS ascii, {no_symbols("html")} AS no_symbols,
           {squeezed("html")} AS squeezed
    FROM pages"""
ORACLES["clean_sector"] = statement(
    "SELECT *, trim(review) = '' AS is_empty_review FROM cleaned WHERE category = 'en'", "cleaned"
)
_LENGTHS = "review_id, title_char_len, title_word_count, review_char_len, review_word_count"
ORACLES["length_features"] = statement(f"SELECT {_LENGTHS} FROM features", "features")
ORACLES["raw_length_features"] = statement(
    f"""SELECT review_id, {char_len("title")} AS title_char_len,
               {word_count("title")} AS title_word_count, {char_len("review")} AS review_char_len,
               {word_count("review")} AS review_word_count FROM raw""",
    "raw",
)
_TIER = (
    "CASE WHEN stars >= 4 THEN 'Positive (4-5)' WHEN stars <= 2 THEN 'Negative (1-2)' "
    "ELSE 'Neutral (3)' END"
)
ORACLES["length_tiers"] = statement(f"SELECT review_id, {_TIER} AS tier FROM raw", "raw")
ORACLES["sentiment_from_stars"] = statement(
    """SELECT review_id, stars,
              CASE WHEN stars >= 4 THEN 'positive' WHEN stars = 3 THEN 'neutral' ELSE 'negative' END AS sentiment,
              CAST(CASE WHEN stars = 3 THEN 0.70 ELSE 0.95 END AS DOUBLE) AS sentiment_score,
              CASE WHEN stars >= 4 THEN 1 WHEN stars = 3 THEN 0 ELSE -1 END AS sentiment_num
       FROM raw""",
    "raw",
)
ORACLES["prepared_reviews"] = statement(
    """SELECT review_id, review = '' AS is_empty_review, review_word_count,
              CASE WHEN stars >= 4 THEN 1 WHEN stars = 3 THEN 0 ELSE -1 END AS sentiment_num
       FROM features""",
    "features",
)

ORACLES["dataset_overview"] = statement(
    """SELECT k.column, CASE k.column WHEN 'title' THEN nt WHEN 'review' THEN nr ELSE ns END AS nulls,
              CASE k.column WHEN 'title' THEN et WHEN 'review' THEN er ELSE 0 END AS empty_strings,
              total_reviews, unique_companies, min_stars, max_stars, round(mean, 6) AS avg_stars
       FROM (SELECT count(*) AS total_reviews, count(DISTINCT company) AS unique_companies,
                    min(stars) AS min_stars, max(stars) AS max_stars, avg(stars) AS mean,
                    count(*) FILTER (title IS NULL) AS nt, count(*) FILTER (review IS NULL) AS nr,
                    count(*) FILTER (stars IS NULL) AS ns,
                    count(*) FILTER (trim(title) = '') AS et, count(*) FILTER (trim(review) = '') AS er
             FROM cleaned), (VALUES ('title'), ('review'), ('stars')) k("column")""",
    "cleaned",
)
ORACLES["star_distribution"] = statement(
    """SELECT category, stars, count(*) AS n,
              round(count(*) / sum(count(*)) OVER (PARTITION BY category) * 100, 6) AS pct
       FROM raw WHERE stars IS NOT NULL GROUP BY category, stars""",
    "raw",
)
ORACLES["category_share"] = statement(
    """SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS pct
       FROM raw WHERE category IS NOT NULL GROUP BY category""",
    "raw",
)


def described(column: str, source: str, keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    x = f"CAST({column} AS DOUBLE)"
    return f"""
        SELECT {lead}'{column}' AS metric, count({x}) AS count, round(avg({x}), 6) AS mean,
               round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min,
               round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50,
               round(quantile_cont({x}, 0.75), 6) AS p75, round(max({x}), 6) AS max
        FROM {source} {group}"""


ORACLES["describe_stars"] = statement(described("stars", "raw"), "raw")
ORACLES["describe_stats"] = statement(
    " UNION ALL ".join(described(m, "stats", "category") for m in METRICS), "stats"
)
ORACLES["company_stats"] = statement("SELECT * FROM stats", "stats")
ORACLES["companies_with_n_reviews"] = statement(
    """, sizes AS (SELECT category, company, count(*) AS n FROM raw
                  WHERE category IS NOT NULL AND company IS NOT NULL GROUP BY category, company)
       SELECT review_id, category, company FROM raw JOIN sizes USING (category, company)
       WHERE n = (SELECT n FROM sizes GROUP BY n ORDER BY count(*) DESC, n LIMIT 1)""",
    "raw",
)
ORACLES["company_descriptions"] = statement(
    "SELECT DISTINCT category, company, description FROM raw", "raw"
)
_BEST = "row_number() OVER (PARTITION BY category ORDER BY avg_stars DESC NULLS LAST, company)"
_WORST = "row_number() OVER (PARTITION BY category ORDER BY avg_stars NULLS FIRST, company DESC)"
ORACLES["top_bottom_companies"] = statement(
    f"""SELECT category, side, CAST(position AS INTEGER) AS position, company, avg_stars,
               round(avg(avg_stars) OVER (PARTITION BY category, side), 6) AS side_mean
        FROM (SELECT *, 'top' AS side, {_BEST} AS position FROM stats
              UNION ALL SELECT *, 'bottom' AS side, {_WORST} AS position FROM stats)
        WHERE position <= 10""",
    "stats",
)
ORACLES["longest_reviews_companies"] = statement(
    """SELECT category, CAST(position AS INTEGER) AS position, company, avg_review_words, avg_stars
       FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY avg_review_words DESC, company) AS position
             FROM stats) WHERE position <= 15""",
    "stats",
)
_SUMMARY = f"""(SELECT category, CAST({_BEST} AS INTEGER) AS position, company, review_count, avg_stars,
                       pct_positive, pct_negative, avg_review_words, avg_title_words FROM stats)"""
ORACLES["company_summary"] = statement(f"SELECT * FROM {_SUMMARY} WHERE position <= 8", "stats")
ORACLES["company_summary_display"] = statement(
    f"""SELECT category, position, company, review_count, printf('%.2f', avg_stars) AS avg_stars,
               printf('%.1f%%', pct_positive) AS pct_positive,
               printf('%.1f%%', pct_negative) AS pct_negative,
               printf('%.0f', avg_review_words) AS avg_review_words,
               printf('%.0f', avg_title_words) AS avg_title_words
        FROM {_SUMMARY} WHERE position <= 8""",
    "stats",
)


def boxes(source: str, keys: str, x: str) -> str:
    on = " AND ".join(f"b.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    shown = ", ".join(f"b.{k.strip()}" for k in keys.split(","))
    return f"""
        SELECT {shown}, b.n, b.q1, b.median, b.q3,
               least(min(x) FILTER (x >= q1 - 1.5 * (q3 - q1)), b.q1) AS whisker_low,
               greatest(max(x) FILTER (x <= q3 + 1.5 * (q3 - q1)), b.q3) AS whisker_high,
               count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n_outliers
        FROM (SELECT {keys}, count({x}) AS n, quantile_cont({x}, 0.25) AS q1,
                     quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.75) AS q3
              FROM {source} GROUP BY {keys}) b
        JOIN (SELECT *, CAST({x} AS DOUBLE) AS x FROM {source}) s ON {on}
        GROUP BY {shown}, b.n, b.q1, b.median, b.q3"""


_TIERED = f"(SELECT *, {_TIER} AS tier FROM features)"
ORACLES["length_by_tier_box"] = statement(
    f"""SELECT category, tier, n, {six("q1", "median", "q3")},
               CAST(round(whisker_low, 6) AS DOUBLE) AS whisker_low,
               CAST(round(whisker_high, 6) AS DOUBLE) AS whisker_high, n_outliers
        FROM ({boxes(_TIERED, "category, tier", "CAST(review_word_count AS DOUBLE)")})""",
    "features",
)


def histogram(source: str, keys: str, x: str, bins: int) -> str:
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"r.{k} = s.{k}" for k in ks)
    shown = ", ".join(f"r.{k}" for k in ks)
    return f"""
        SELECT {shown}, g.bin,
               round(lo + g.bin * (hi - lo) / {bins}, 6) AS bin_start,
               round(lo + (g.bin + 1) * (hi - lo) / {bins}, 6) AS bin_end,
               count(s.x) AS n,
               round(count(s.x) / (r.total * ((hi - lo) / {bins})), 6) AS density
        FROM (SELECT {keys}, count(x) AS total,
                     CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
                     CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
              FROM (SELECT *, CAST({x} AS DOUBLE) AS x FROM {source}) WHERE x IS NOT NULL GROUP BY {keys}) r
        CROSS JOIN (SELECT unnest(range({bins})) AS bin) g
        LEFT JOIN (SELECT *, CAST({x} AS DOUBLE) AS x FROM {source}) s
          ON {on} AND s.x >= lo + g.bin * ((hi - lo) / {bins})
             AND (s.x < lo + (g.bin + 1) * ((hi - lo) / {bins}) OR g.bin = {bins - 1})
        GROUP BY {shown}, g.bin, lo, hi, r.total"""


ORACLES["length_by_tier_hist"] = statement(
    histogram(_TIERED, "category, tier", "review_word_count", 40), "features"
)
ORACLES["length_limits"] = statement(
    """SELECT category, count(review_word_count) AS n,
              round(quantile_cont(CAST(review_word_count AS DOUBLE), 0.97), 6) AS p97,
              round(quantile_cont(CAST(review_word_count AS DOUBLE), 0.99), 6) AS p99
       FROM features GROUP BY category""",
    "features",
)

_KPIS = ("pct_positive", "pct_negative", "avg_stars")
ORACLES["percentile_ranks"] = statement(
    " UNION ALL ".join(
        f"""SELECT category, company, '{m}' AS metric, {m} AS value,
                   CASE WHEN count(*) OVER (PARTITION BY category) > 1 THEN
                   round(percent_rank() OVER (PARTITION BY category ORDER BY {m}) * 100, 6) END AS percentile
            FROM stats"""
        for m in _KPIS
    ),
    "stats",
)


def placed(metric: str, columns: str) -> str:
    """Target against the other companies of its sector for one metric."""
    return f"""
        SELECT t.category, '{metric}' AS metric, any_value(t.{metric}) AS target_value,
               count(o.{metric}) AS n_competitors,
               round(count(*) FILTER (o.{metric} < t.{metric}) / count(o.{metric}) * 100, 6) AS percentile,
               {columns}
        FROM (SELECT * FROM stats WHERE company = '{TARGET}') t
        JOIN (SELECT * FROM stats WHERE company <> '{TARGET}') o USING (category)
        GROUP BY t.category"""


ORACLES["percentile_dashboard"] = statement(
    " UNION ALL ".join(
        placed(m, f"round(quantile_cont(o.{m}, 0.5), 6) AS median") for m in _KPIS
    ),
    "stats",
)
ORACLES["stars_positioning"] = statement(
    f"""SELECT category, target_value, sector_median, percentile, n_competitors FROM (
        {placed("avg_stars", "round(quantile_cont(o.avg_stars, 0.5), 6) AS sector_median")})""",
    "stats",
)
_OTHERS = f"(SELECT * FROM stats WHERE company <> '{TARGET}')"
ORACLES["stars_histogram"] = statement(histogram(_OTHERS, "category", "avg_stars", 10), "stats")


def word_position(metric: str) -> str:
    return f"""
        SELECT p.category, p.metric, p.target_value, p.percentile, p.n_competitors,
               {", ".join(f"round(b.{c}, 6) AS {c}" for c in ("q1", "median", "q3", "whisker_low", "whisker_high"))},
               b.n_outliers
        FROM ({placed(metric, "1 AS one")}) p
        JOIN ({boxes(_OTHERS, "category", metric)}) b USING (category)"""


ORACLES["word_count_positioning"] = statement(
    " UNION ALL ".join(word_position(m) for m in ("wc_negative", "wc_neutral", "wc_positive")),
    "stats",
)


def _split() -> str:
    pct = ", ".join(SHARES)
    medians = ", ".join(f"round(quantile_cont({c}, 0.5), 6) AS {c}" for c in SHARES)
    in_sector = f"category IN (SELECT category FROM stats WHERE company = '{TARGET}')"

    def pick(line: int, name: str, order: str) -> str:
        return f"""
            SELECT category, {line} AS line, '{name.lower()}' AS position,
                   printf('{name} (★ %.2f)', avg_stars) AS label, company, avg_stars, {pct}
            FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {order}, company) AS r
                  FROM {_OTHERS} WHERE avg_stars IS NOT NULL)
            WHERE r = 1 AND {in_sector}"""

    return f"""
        SELECT category, 1 AS line, 'target' AS position, '{TARGET}' AS label, company, avg_stars, {pct}
        FROM stats WHERE company = '{TARGET}'
        UNION ALL
        SELECT category, 2, 'median', 'Sector median', NULL, NULL, {medians}
        FROM {_OTHERS} WHERE {in_sector} GROUP BY category
        UNION ALL {pick(3, "Best", "avg_stars DESC")}
        UNION ALL {pick(4, "Worst", "avg_stars")}"""


ORACLES["sentiment_split_benchmarks"] = statement(_split(), "stats")
ORACLES["kde_avg_stars"] = statement(
    f"""SELECT category, CAST(point AS INTEGER) AS point, round(x, 6) AS avg_stars,
               round(avg(exp(-0.5 * pow((x - s.v) / bw, 2)) / (bw * sqrt(2 * pi()))), 6) AS density
        FROM (SELECT category, point, bw, lo - 3 * bw + point * ((hi - lo + 6 * bw) / 199) AS x
              FROM (SELECT category, stddev_samp(avg_stars) * pow(count(avg_stars), -0.2) AS bw,
                           min(avg_stars) AS lo, max(avg_stars) AS hi
                    FROM {_OTHERS} GROUP BY category), (SELECT unnest(range(200)) AS point)
              WHERE bw > 0) g
        JOIN (SELECT category, avg_stars AS v FROM {_OTHERS} WHERE avg_stars IS NOT NULL) s USING (category)
        GROUP BY category, point, x""",
    "stats",
)

ORACLES["split_target"] = statement(
    f"SELECT review_id, company, company = '{TARGET}' AS is_target FROM raw "
    rf"WHERE trim(regexp_replace(review, '[{WS}]+', ' ', 'g')) <> ''",
    "raw",
)
ORACLES["seed_centroids"] = statement(
    """SELECT topic_id, concat('topic_', topic_id) AS macro_topic, CAST(pos AS INTEGER) AS pos,
              round(value, 6) AS value FROM means""",
    "means",
)
ORACLES["assign_topics"] = statement(
    f"SELECT review_id, topic_id, macro_topic, {six('topic_similarity')} FROM assembled", "assembled"
)
ORACLES["assembled_reviews"] = statement(
    f"""SELECT review_id, category, company, title, review, stars, is_target, topic_id, macro_topic,
               {six("topic_similarity")}, sentiment, sentiment_score, sentiment_num FROM assembled""",
    "assembled",
)
ORACLES["topic_distribution"] = statement(
    """SELECT is_target, macro_topic, count(*) AS n_reviews,
              round(count(*) / sum(count(*)) OVER (PARTITION BY is_target) * 100, 6) AS pct
       FROM assembled GROUP BY is_target, macro_topic""",
    "assembled",
)
_SUMMARY_COLUMNS = f"""is_target, macro_topic, n_reviews,
    {six(*SHARES, "avg_similarity", "net_sentiment")}, dominant_sentiment"""
ORACLES["topic_summary"] = statement(f"SELECT {_SUMMARY_COLUMNS} FROM summary", "summary")
ORACLES["topic_summary_named"] = statement(
    f"SELECT {_SUMMARY_COLUMNS} FROM summary WHERE macro_topic <> 'General / Other'", "summary"
)
ORACLES["macro_distribution"] = statement(
    f"""SELECT is_target, macro_topic, n_reviews, {six("net_sentiment")}, dominant_sentiment
        FROM summary""",
    "summary",
)
_HEAT = ", ".join(
    f"round(coalesce({side}.{c}, 0), 6) AS {c}_{name}"
    for side, name in (("t", "target"), ("c", "comp"))
    for c in SHARES
)
ORACLES["topic_heatmap"] = statement(
    f"""SELECT row_number() OVER (ORDER BY t.net_sentiment DESC NULLS LAST,
               CASE WHEN t.macro_topic IS NULL THEN c.net_sentiment END DESC, macro_topic) AS position,
               macro_topic, {_HEAT}
        FROM (SELECT * FROM summary WHERE is_target) t
        FULL JOIN (SELECT * FROM summary WHERE NOT is_target) c USING (macro_topic)""",
    "summary",
)
_MERGED = f"""macro_topic, n_reviews_target, n_reviews_comp,
    {six("net_sentiment_target", "net_sentiment_comp", "gap")}"""
ORACLES["head_to_head"] = statement(f"SELECT {_MERGED} FROM merged", "merged")


def ranked_list(name: str, key: str, where: str, flag: str = "NULL") -> str:
    return f"""
        SELECT '{name}' AS list, row_number() OVER (ORDER BY {key}, macro_topic) AS rank, macro_topic,
               {six("net_sentiment_target", "gap")}, {flag} AS flag
        FROM merged WHERE {where}"""


ORACLES["strengths_weaknesses"] = statement(
    ranked_list(
        "priority", "net_sentiment_target", "TRUE",
        "CASE WHEN net_sentiment_target < -25 THEN 'red' "
        "WHEN net_sentiment_target < 0 THEN 'amber' ELSE 'green' END",
    )
    + " UNION ALL " + ranked_list("strength", "gap DESC", "gap > 0")
    + " UNION ALL " + ranked_list("weakness", "gap", "gap < 0"),
    "merged",
)
ORACLES["comparison_merged"] = ORACLES["head_to_head"]
ORACLES["comparison_summary"] = statement(
    f"SELECT {_SUMMARY_COLUMNS.removeprefix('is_target, ')} FROM summary WHERE is_target", "summary"
)
ORACLES["sector_word_positioning"] = statement(
    f"SELECT * FROM ({' UNION ALL '.join(word_position(m) for m in ('wc_negative', 'wc_neutral', 'wc_positive'))}) "
    "WHERE category = 'en'",
    "stats",
)
ORACLES["weak_topics"] = statement(f"SELECT {_MERGED} FROM weak", "weak")
_SHOWN = f"""review_id, company, stars, macro_topic, {six("topic_similarity")},
    sentiment, sentiment_score, title, review"""
ORACLES["negative_reviews"] = statement(
    f"SELECT {_SHOWN} FROM assembled WHERE sentiment = 'negative'", "assembled"
)
_WEAK_NEGATIVE = """is_target AND sentiment = 'negative'
    AND macro_topic IN (SELECT macro_topic FROM weak)"""
ORACLES["root_cause_reviews"] = statement(
    f"SELECT {_SHOWN} FROM assembled WHERE {_WEAK_NEGATIVE}", "assembled", "weak"
)
ORACLES["root_cause_worst"] = statement(
    f"""SELECT {_SHOWN} FROM assembled WHERE {_WEAK_NEGATIVE}
        QUALIFY row_number() OVER (PARTITION BY macro_topic ORDER BY stars, review_id) <= 2""",
    "assembled", "weak",
)


def frequent(source: str, keys: str, top_n: int) -> str:
    return f"""
        SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, word) AS rank,
               word, count(*) AS n
        FROM {source} GROUP BY {keys}, word QUALIFY rank <= {top_n}"""


ORACLES["root_cause_words"] = statement(
    frequent("weak_words", "is_target, macro_topic", 15), "weak_words"
)
ORACLES["word_gap"] = statement(
    frequent("negative_words", "is_target, macro_topic", 15), "negative_words"
)
ORACLES["top_words_tone"] = statement(
    """SELECT is_target, row_number() OVER (PARTITION BY is_target ORDER BY count(*) DESC, word) AS rank,
              word, count(*) AS n, round(avg(sentiment_num), 6) AS avg_sentiment
       FROM tone_words GROUP BY is_target, word QUALIFY rank <= 20""",
    "tone_words",
)
ORACLES["topic_keywords"] = statement(
    """SELECT macro_topic, row_number() OVER (PARTITION BY macro_topic ORDER BY score DESC, word) AS rank,
              word, n, round(score, 6) AS score
       FROM (SELECT macro_topic, word, n,
                    n * ln(1 + (SELECT count(*) / count(DISTINCT macro_topic) FROM topic_words)
                               / sum(n) OVER (PARTITION BY word)) AS score
             FROM (SELECT macro_topic, word, count(*) AS n FROM topic_words GROUP BY macro_topic, word))
       QUALIFY rank <= 10""",
    "topic_words",
)


def letters(x: str, letter: str) -> str:
    return f"(length({x}) - length(replace({x}, '{letter}', '')))"


ORACLES["embed_texts"] = statement(
    f"""SELECT review_id, CAST(length(review) AS DOUBLE) AS chars,
               CAST({letters("review", " ")} AS DOUBLE) AS blanks,
               CAST({letters("review", "e")} AS DOUBLE) AS e,
               CAST({letters("review", "a")} AS DOUBLE) AS a
        FROM cleaned""",
    "cleaned",
)
ORACLES["classify_sentiment"] = statement(
    f"""SELECT review_id,
               CASE WHEN e > a THEN 'positive' WHEN a > e THEN 'negative' ELSE 'neutral' END AS sentiment,
               round(CASE WHEN e + a > 0 THEN greatest(e, a) / (e + a) ELSE 0.5 END, 6) AS sentiment_score,
               CASE WHEN e > a THEN 1 WHEN a > e THEN -1 ELSE 0 END AS sentiment_num
        FROM (SELECT review_id, {letters("t", "e")} AS e, {letters("t", "a")} AS a
              FROM (SELECT review_id, CASE WHEN review = '' THEN 'neutral' ELSE review END AS t
                    FROM cleaned))""",
    "cleaned",
)


# --- principal components and k-means ------------------------------------------------------------

TABLES["embedded"] = f"""
    SELECT review_id, coalesce(company = '{TARGET}', false) AS is_target, embedding FROM vectors
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"""
NEEDS["embedded"] = ["vectors"]


def components(prefix: str, source: str, n: int, squarings: int = 14) -> str:
    """Tables for the first principal components of ``source``; the last holds (component, i, loading).

    A matrix squared again and again becomes the projection on its leading eigenvector, which is then
    taken out of the matrix.
    """
    before = ["embedded"]

    def table(name: str, sql: str) -> str:
        TABLES[f"{prefix}_{name}"] = sql
        NEEDS[f"{prefix}_{name}"] = list(before)
        before.append(f"{prefix}_{name}")
        return f"{prefix}_{name}"

    x = table("x", f"SELECT review_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM {source}")
    centred = table("centred", f"SELECT review_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM {x}")
    matrix = table("matrix", f"SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM {centred} a JOIN {centred} b USING (review_id) GROUP BY a.i, b.i")
    found = []
    for m in range(1, n + 1):
        square = matrix
        for k in range(squarings):
            scaled = table(f"scaled{m}_{k}", f"SELECT i, j, v / max(abs(v)) OVER () AS v FROM {square}")
            square = table(f"square{m}_{k}", f"SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {scaled} a JOIN {scaled} b ON a.j = b.i GROUP BY a.i, b.j")
        column = f"(SELECT i, v FROM {square} WHERE j = (SELECT i FROM {square} WHERE i = j ORDER BY v DESC LIMIT 1))"
        axis = table(f"axis{m}", f"""
            SELECT i, v * sign(first(v) OVER (ORDER BY abs(v) DESC)) / sqrt(sum(v * v) OVER ()) AS v FROM {column}""")
        found.append(f"SELECT {m} AS component, i, v FROM {axis}")
        matrix = table(f"matrix{m}", f"""
            SELECT a.i, a.j, a.v - size * p.v * q.v AS v
            FROM {matrix} a JOIN {axis} p ON p.i = a.i JOIN {axis} q ON q.i = a.j,
                 (SELECT sum(p.v * m.v * q.v) AS size FROM {matrix} m JOIN {axis} p ON p.i = m.i JOIN {axis} q ON q.i = m.j)""")
    return table("axes", " UNION ALL ".join(found))


_TWO = components("two", "embedded", 2)
ORACLES["pca_2d"] = statement(
    f"""SELECT review_id, coalesce(company = '{TARGET}', false) AS is_target,
               round(sum(x.x * a.v) FILTER (component = 1), 6) AS pc1, round(sum(x.x * a.v) FILTER (component = 2), 6) AS pc2
        FROM vectors LEFT JOIN two_x x USING (review_id) LEFT JOIN {_TWO} a ON a.i = x.i
        GROUP BY review_id, is_target""",
    "vectors", _TWO,
)

_FIVE = components("five", "(SELECT * FROM embedded WHERE NOT is_target)", 5)
TABLES["reduced"] = f"""
    SELECT review_id, is_target, list(v ORDER BY component) AS p
    FROM (SELECT review_id, is_target, component, sum(e.x * a.v) AS v
          FROM (SELECT review_id, is_target, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embedded) e
          JOIN {_FIVE} a ON a.i = e.i GROUP BY review_id, is_target, component)
    GROUP BY review_id, is_target"""
TABLES["centres0"] = """
    SELECT row_number() OVER (ORDER BY review_id) - 1 AS k, p AS c FROM reduced WHERE NOT is_target ORDER BY review_id LIMIT 12"""
NEEDS |= {"reduced": ["embedded", _FIVE], "centres0": ["reduced"]}
for _t in range(9):
    TABLES[f"near{_t}"] = f"""
        SELECT review_id, is_target, p, k FROM reduced, centres{_t}
        QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY list_distance(p, c), k) = 1"""
    TABLES[f"centres{_t + 1}"] = f"""
        SELECT k, coalesce(m, c) AS c FROM centres{_t} LEFT JOIN (
            SELECT k, list(x ORDER BY i) AS m FROM (
                SELECT k, i, avg(p[i]) AS x FROM near{_t}, range(1, 6) t(i) WHERE NOT is_target GROUP BY k, i) GROUP BY k) USING (k)"""
    NEEDS |= {f"near{_t}": ["reduced", f"centres{_t}"], f"centres{_t + 1}": [f"near{_t}"]}
ORACLES["discover_topics"] = statement(
    f"""SELECT v.review_id, coalesce(company = '{TARGET}', false) AS is_target, CAST(k AS INTEGER) AS discovered_topic
        FROM vectors v LEFT JOIN near8 ON near8.review_id = v.review_id""",
    "vectors", "near8",
)

# --- density clusters ----------------------------------------------------------------------------

TABLES["nodes"] = """
    SELECT min(vec_id) AS node, count(*) AS copies, any_value(v) AS v
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    WHERE len(v) > 0 AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 GROUP BY v"""
TABLES["units"] = """
    SELECT node, copies, [c / CASE WHEN size = 0 THEN 1 ELSE size END FOR c IN v] AS u
    FROM (SELECT *, sqrt(list_sum([c * c FOR c IN v])) AS size FROM nodes)"""
TABLES["apart"] = """
    SELECT a.node, a.copies, b.node AS other, b.copies AS others, list_distance(a.u, b.u) AS d
    FROM units a JOIN units b ON a.node <> b.node"""
NEEDS |= {"units": ["nodes"], "apart": ["units"]}

ORACLES["vector_neighbours"] = statement(
    """SELECT node, copies, rank, other, round(d, 6) AS distance
       FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d, other) AS rank FROM apart)
       WHERE rank <= 10""",
    "apart",
)
TABLES["cores"] = """
    SELECT node, copies, CASE WHEN copies - 1 >= 2 THEN 0 ELSE core END AS core
    FROM nodes LEFT JOIN (
        SELECT node, min(d) FILTER (seen + copies - 1 >= 2) AS core
        FROM (SELECT *, sum(others) OVER (PARTITION BY node ORDER BY d, other) AS seen FROM apart)
        GROUP BY node) USING (node)"""
TABLES["radius"] = """
    SELECT quantile_cont(core, 0.1) AS r FROM (SELECT core, unnest(range(copies)) FROM cores WHERE core IS NOT NULL)"""
TABLES["near_links"] = """
    SELECT apart.node, other FROM apart JOIN cores a ON a.node = apart.node JOIN cores b ON b.node = other, radius
    WHERE d <= r AND a.core <= r AND b.core <= r"""
NEEDS |= {"cores": ["nodes", "apart"], "radius": ["cores"], "near_links": ["apart", "cores", "radius"]}

ORACLES["dense_clusters"] = statement(
    """, reach AS (
         SELECT node, node AS other FROM cores, radius WHERE core <= r
         UNION
         SELECT reach.node, near_links.other FROM reach JOIN near_links ON near_links.node = reach.other),
       roots AS (SELECT node, min(other) AS cluster FROM reach GROUP BY node),
       sizes AS (SELECT cluster, CAST(sum(copies) AS BIGINT) AS cluster_size FROM roots JOIN nodes USING (node)
                 GROUP BY cluster HAVING sum(copies) >= 3)
       SELECT e.vec_id AS review_id, round(core, 6) AS core_distance, sizes.cluster, cluster_size
       FROM embeddings e LEFT JOIN nodes ON CAST(e.embedding AS DOUBLE[]) = nodes.v LEFT JOIN cores USING (node)
       LEFT JOIN roots USING (node) LEFT JOIN sizes USING (cluster)""",
    "near_links",
).replace("WITH ", "WITH RECURSIVE ", 1)

# --- statistics that follow their reviews --------------------------------------------------------

ORACLES["stats_from_batches"] = ORACLES["company_stats"]
ORACLES["topic_summary_from_batches"] = ORACLES["topic_summary"]
TABLES["kept_features"] = "SELECT * FROM features WHERE stars <> 1"
TABLES["kept_stats"] = TABLES["stats"].replace("FROM features", "FROM kept_features")
NEEDS |= {"kept_features": ["features"], "kept_stats": ["kept_features"]}
ORACLES["stats_after_withdrawal"] = statement("SELECT * FROM kept_stats", "kept_stats")
ORACLES["describe_after_withdrawal"] = statement(
    """SELECT category, count(stars) AS count, round(avg(stars), 6) AS mean, round(stddev_samp(stars), 6) AS std,
              CAST(min(stars) AS DOUBLE) AS min, round(quantile_cont(stars, 0.25), 6) AS p25,
              round(quantile_cont(stars, 0.5), 6) AS p50, round(quantile_cont(stars, 0.75), 6) AS p75,
              CAST(max(stars) AS DOUBLE) AS max
       FROM kept_features GROUP BY category""",
    "kept_features",
)
ORACLES["length_limits_after_withdrawal"] = statement(
    """SELECT category, count(*) AS n, round(quantile_cont(review_word_count, 0.97), 6) AS p97,
              round(quantile_cont(review_word_count, 0.99), 6) AS p99
       FROM kept_features GROUP BY category""",
    "kept_features",
)

# --- how certain gaps and words are --------------------------------------------------------------

_M = 2147483647
_STEP = "((xor(x, x >> {}) * 1566083941) % 2147483647)"
TABLES["draws"] = f"""
    SELECT macro_topic, is_target, sign, r, xor(x, x >> 15) % {_M} AS h
    FROM (SELECT * REPLACE ({_STEP.format(17)} AS x)
    FROM (SELECT * REPLACE ({_STEP.format(13)} AS x)
    FROM (SELECT macro_topic, is_target, r, ((((review_id % {_M}) + {_M}) % {_M}) * 48271 + r * 630360016 + 1) % {_M} AS x,
                 CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END AS sign
          FROM assembled, range(200) t(r) WHERE macro_topic <> 'General / Other')))"""


def _poisson(h: str) -> str:
    """The weight of a hash: how many steps of the distribution function it has passed."""
    total, term, steps = 0.0, math.exp(-1), []
    for k in range(12):
        term = math.exp(-1) / math.factorial(k)
        total += term
        steps.append(f"CASE WHEN {h} >= {math.floor(total * _M)} THEN 1 ELSE 0 END")
    return " + ".join(steps)


TABLES["replicates"] = f"""
    SELECT macro_topic, r,
           sum(w * sign) FILTER (is_target) * 100.0::DOUBLE / nullif(sum(w) FILTER (is_target), 0)
           - sum(w * sign) FILTER (NOT is_target) * 100.0::DOUBLE / nullif(sum(w) FILTER (NOT is_target), 0) AS gap
    FROM (SELECT *, {_poisson("h")} AS w FROM draws) GROUP BY macro_topic, r"""
TABLES["bounded"] = """
    SELECT merged.*, gap_low, gap_high, share_below, n_replicates
    FROM merged LEFT JOIN (
        SELECT macro_topic, quantile_cont(gap, 0.025) AS gap_low, quantile_cont(gap, 0.975) AS gap_high,
               avg(CASE WHEN gap < 0 THEN 1.0 ELSE 0.0 END) AS share_below, count(*) AS n_replicates
        FROM replicates WHERE gap IS NOT NULL GROUP BY macro_topic) USING (macro_topic)"""
NEEDS |= {"draws": ["assembled"], "replicates": ["draws"], "bounded": ["merged", "replicates"]}
ORACLES["gap_bounds"] = statement(
    f"""SELECT macro_topic, n_reviews_target, n_reviews_comp, n_replicates,
               {six("net_sentiment_target", "net_sentiment_comp", "gap", "gap_low", "gap_high", "share_below")} FROM bounded""",
    "bounded",
)
ORACLES["certain_weak_topics"] = statement(
    f"""SELECT CASE WHEN gap_low > 0 THEN 'strength' WHEN gap_high < 0 THEN 'weakness' ELSE 'undecided' END AS list,
               macro_topic, {six("gap", "gap_low", "gap_high", "share_below")} FROM bounded""",
    "bounded",
)

TABLES["all_words"] = tokens("assembled", "is_target, macro_topic, sentiment")


def word_odds(picked: str) -> str:
    return f"""
        SELECT macro_topic, word, n_target, n_comp, o_target - o_comp AS log_odds,
               (o_target - o_comp) / sqrt(1 / (n_target + alpha) + 1 / (n_comp + alpha)) AS z
        FROM (SELECT *, ln((n_target + alpha) / (size_target + 500 - n_target - alpha)) AS o_target,
                     ln((n_comp + alpha) / (size_comp + 500 - n_comp - alpha)) AS o_comp
              FROM (SELECT macro_topic, word, count(*) FILTER (is_target AND {picked}) AS n_target,
                           count(*) FILTER (NOT is_target AND {picked}) AS n_comp
                    FROM all_words GROUP BY macro_topic, word)
              JOIN (SELECT word, count(*) * 500.0::DOUBLE / (SELECT count(*) FROM all_words) AS alpha
                    FROM all_words GROUP BY word) USING (word)
              JOIN (SELECT macro_topic, count(*) FILTER (is_target AND {picked}) AS size_target,
                           count(*) FILTER (NOT is_target AND {picked}) AS size_comp
                    FROM all_words GROUP BY macro_topic) USING (macro_topic)
              WHERE n_target + n_comp > 0)"""


TABLES["odds_negative"] = word_odds("sentiment = 'negative'")
TABLES["odds_all"] = word_odds("true")
NEEDS |= {"all_words": ["assembled"], "odds_negative": ["all_words"], "odds_all": ["all_words"]}
ORACLES["word_odds"] = statement(
    f"SELECT macro_topic, word, n_target, n_comp, {six('log_odds', 'z')} FROM odds_negative", "odds_negative"
)
ORACLES["distinctive_words"] = statement(
    f"""SELECT macro_topic, side, rank, word, {six("z")}
        FROM (SELECT *, row_number() OVER (PARTITION BY macro_topic, side ORDER BY abs(z) DESC, word) AS rank
              FROM (SELECT *, CASE WHEN z > 0 THEN 'target' ELSE 'competitors' END AS side FROM odds_all WHERE abs(z) >= 1))
        WHERE rank <= 15""",
    "odds_all",
)


# --- phrases and sketches ------------------------------------------------------------------------

TABLES["told"] = f"""
    SELECT macro_topic, [trim(w, '.,!?:;"\'\'') FOR w IN {word_list("lower(review)")}] AS t FROM assembled"""
TABLES["all_runs"] = " UNION ALL ".join(
    f"""SELECT macro_topic, array_to_string(r, ' ') AS run, {size} AS n_words
        FROM (SELECT macro_topic, t[i:i + {size - 1}] AS r FROM (SELECT *, unnest(range(1, len(t) - {size} + 2)) AS i FROM told))
        WHERE len(list_filter(r, lambda w: NOT regexp_matches(w, '^\\p{{L}}+$'))) = 0"""
    for size in range(1, 5)
)
TABLES["runs"] = """
    SELECT macro_topic, run, n_words, count(*) AS n FROM all_runs GROUP BY macro_topic, run, n_words
    QUALIFY sum(count(*)) OVER (PARTITION BY run) >= 10"""
_STOPS = ", ".join(quoted(w) for w in STOP_WORDS)
TABLES["phrases"] = f"""
    SELECT *, 2 * (n * ln(n / (n_all / total * size)) +
                   CASE WHEN n_all > n THEN (n_all - n) * ln((n_all - n) / (n_all / total * (total - size))) ELSE 0 END) AS g2
    FROM (SELECT *, sum(n) OVER (PARTITION BY run)::DOUBLE AS n_all, sum(n) OVER (PARTITION BY macro_topic, n_words)::DOUBLE AS size,
                 sum(n) OVER (PARTITION BY n_words)::DOUBLE AS total FROM runs)
    WHERE n * (total - size) > (n_all - n) * size
      AND split_part(run, ' ', 1) NOT IN ({_STOPS}) AND split_part(run, ' ', -1) NOT IN ({_STOPS})
      AND length(split_part(run, ' ', 1)) > 1 AND length(split_part(run, ' ', -1)) > 1"""
TABLES["best_phrases"] = """
    SELECT macro_topic, row_number() OVER (PARTITION BY macro_topic ORDER BY g2 DESC, run) AS rank, run, n, n_all::BIGINT AS n_all, g2
    FROM phrases WHERE n_words >= 2 QUALIFY rank <= 25"""
NEEDS |= {"told": ["assembled"], "all_runs": ["told"], "runs": ["all_runs"], "phrases": ["runs"], "best_phrases": ["phrases"]}
ORACLES["frequent_runs"] = statement("SELECT macro_topic, run, n_words, n FROM runs", "runs")
ORACLES["key_phrases"] = statement(f"SELECT macro_topic, rank, run, n, n_all, {six('g2')} FROM best_phrases", "best_phrases")
ORACLES["unlike_phrases"] = statement(
    f""", picked(macro_topic, rank, chosen) AS (
         SELECT macro_topic, 0::BIGINT, []::VARCHAR[][] FROM best_phrases GROUP BY macro_topic
         UNION ALL
         SELECT p.macro_topic, b.rank,
                CASE WHEN len(chosen) < 10 AND len(list_filter(chosen, lambda c:
                         len(list_intersect(c, split(b.run, ' '))) > 0.5 * len(list_distinct(c || split(b.run, ' '))))) = 0
                     THEN list_append(chosen, split(b.run, ' ')) ELSE chosen END
         FROM picked p JOIN best_phrases b ON b.macro_topic = p.macro_topic AND b.rank = p.rank + 1)
       SELECT macro_topic, row_number() OVER (PARTITION BY macro_topic ORDER BY rank) AS place, run, n, {six("g2")}
       FROM best_phrases JOIN (SELECT macro_topic, max(len(chosen)) AS many, arg_max(chosen, rank) AS chosen FROM picked GROUP BY macro_topic)
            USING (macro_topic)
       WHERE list_contains(list_transform(chosen, lambda c: array_to_string(c, ' ')), run)""",
    "best_phrases",
).replace("WITH ", "WITH RECURSIVE ", 1)
ORACLES["sketched_lengths"] = statement(
    """SELECT category, count(*) AS n, min(review_word_count)::DOUBLE AS least,
              quantile_disc(review_word_count, 0.25)::DOUBLE AS p25, quantile_disc(review_word_count, 0.5)::DOUBLE AS p50,
              quantile_disc(review_word_count, 0.97)::DOUBLE AS p97, max(review_word_count)::DOUBLE AS most
       FROM features GROUP BY category""",
    "features",
)

TABLES["fine_means"] = """
    SELECT topic_id, pos, avg(v) AS value
    FROM (SELECT label * 37 + vec_id % 37 AS topic_id, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v
          FROM embeddings) GROUP BY topic_id, pos"""
TABLES["fine_cents"] = "SELECT topic_id, list(value ORDER BY pos) AS centroid FROM fine_means GROUP BY topic_id"
TABLES["fine_scored"] = """
    SELECT review_id, topic_id, list_cosine_similarity(embedding, centroid) AS similarity
    FROM vectors, fine_cents WHERE embedding IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY similarity DESC, topic_id) = 1"""
NEEDS |= {"fine_cents": ["fine_means"], "fine_scored": ["vectors", "fine_cents"]}
ORACLES["assign_fine_topics"] = statement(
    f"""SELECT review_id, CAST(CASE WHEN similarity >= {SIMILARITY_THRESHOLD} THEN topic_id ELSE -1 END AS INTEGER) AS topic_id,
               CASE WHEN similarity >= {SIMILARITY_THRESHOLD} THEN concat('topic_', topic_id) ELSE 'General / Other' END AS macro_topic,
               round(similarity, 6) AS topic_similarity
        FROM vectors LEFT JOIN fine_scored USING (review_id)""",
    "vectors", "fine_scored",
)
