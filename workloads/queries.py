"""One query per operator, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plaudit.constants import OTHER_TOPIC
from plaudit.functions import text as X
from plaudit.functions.labels import length_tier
from plaudit.operators import (
    centroids as centroid_index,
    certainty,
    cleaning,
    companies,
    compare,
    density,
    discovery,
    models,
    phrases,
    positioning,
    rootcause,
    sketches,
    state,
    topics,
    wordodds,
)
from plaudit.plans.comparison import assemble, compare_company
from plaudit.plans.sector import explore_sector
from plaudit.plans.session import durable, durable_path
from plaudit.sources.tables import document_reviews, document_vectors, table, vector_seeds
from plaudit.streaming.rowwise import prepare_reviews
from workloads.stubs import letter_encoder, vowel_classifier

TARGET = "src0"
SECTOR = "en"
MIN_REVIEWS = 3  # keeps some weak topics of the fixture and drops others
LANGUAGES = ("en", "fr", "de", "es")

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles whose last bits depend on the order of summation."""
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else df


# --- inputs ------------------------------------------------------------------------------------


USED_TEXTS = ("title", "review")  # no query below reads the description after cleaning


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean_reviews(document_reviews(spark, folder), USED_TEXTS)


def features(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.add_length_features(cleaned(spark, folder), cleaned=True)


def stats(spark: SparkSession, folder: str) -> DataFrame:
    return companies.company_stats(features(spark, folder))


def with_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every review, with its vector where there is one."""
    vectors = document_vectors(spark, folder)
    return cleaning.clean_reviews(document_reviews(spark, folder), USED_TEXTS).join(vectors, "review_id", "left")


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    return topics.seed_centroids(vector_seeds(spark, folder))


def assembled(spark: SparkSession, folder: str) -> DataFrame:
    return assemble(with_vectors(spark, folder), TARGET, centroids(spark, folder))


def summary(spark: SparkSession, folder: str) -> DataFrame:
    return compare.topic_summary(assembled(spark, folder))


def merged(spark: SparkSession, folder: str) -> DataFrame:
    return compare.head_to_head(summary(spark, folder))


# --- text --------------------------------------------------------------------------------------


@query
def clean_text_documents(spark, folder):
    return X.clean_text(table(spark, folder, "documents").select("doc_id", "text"), ["text"])


@query
def clean_text_pages(spark, folder):
    return X.clean_text(table(spark, folder, "pages").select("page_id", "html"), ["html"])


@query
def clean_text_conversations(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return X.clean_text(rows, ["text"])


@query
def text_steps(spark, folder):
    html = F.col("html")
    return table(spark, folder, "pages").select(
        "page_id",
        X.fix_newlines(html).alias("newlines"),
        X.remove_html(html).alias("no_html"),
        X.remove_urls(html).alias("no_urls"),
        X.remove_emails(html).alias("no_emails"),
        X.to_ascii(html).alias("ascii"),
        X.blank_symbols(html).alias("no_symbols"),
        X.squeeze_spaces(html).alias("squeezed"),
    )


@query
def clean_sector(spark, folder):
    return cleaning.clean_sector(document_reviews(spark, folder), SECTOR, sectors=LANGUAGES)


@query
def length_features(spark, folder):
    return features(spark, folder).select(
        "review_id", "title_char_len", "title_word_count", "review_char_len", "review_word_count"
    )


@query
def raw_length_features(spark, folder):
    reviews = document_reviews(spark, folder)
    return cleaning.add_length_features(reviews).select(
        "review_id", "title_char_len", "title_word_count", "review_char_len", "review_word_count"
    )


@query
def length_tiers(spark, folder):
    return document_reviews(spark, folder).select(
        "review_id", length_tier(F.col("stars")).alias("tier")
    )


@query
def sentiment_from_stars(spark, folder):
    return cleaning.add_star_sentiment(document_reviews(spark, folder)).select(
        "review_id", "stars", "sentiment", "sentiment_score", "sentiment_num"
    )


@query
def prepared_reviews(spark, folder):
    return prepare_reviews(document_reviews(spark, folder)).select(
        "review_id", "is_empty_review", "review_word_count", "sentiment_num"
    )


# --- overview and company statistics -------------------------------------------------------------


@query
def dataset_overview(spark, folder):
    return rounded(companies.dataset_overview(cleaned(spark, folder)))


@query
def star_distribution(spark, folder):
    return rounded(companies.star_distribution(document_reviews(spark, folder)))


@query
def category_share(spark, folder):
    return rounded(companies.category_share(document_reviews(spark, folder)))


@query
def describe_stars(spark, folder):
    return rounded(companies.describe(document_reviews(spark, folder), ["stars"]))


@query
def describe_stats(spark, folder):
    return rounded(
        companies.describe(stats(spark, folder), companies.METRICS, ["category"])
    )


@query
def company_stats(spark, folder):
    return companies.company_stats(features(spark, folder), ordered=True)


@query
def companies_with_n_reviews(spark, folder):
    reviews, keys = document_reviews(spark, folder), ("category", "company")
    full = cleaning.companies_with_reviews(reviews, None, keys)
    return cleaning.reviews_of_companies(reviews, full, keys).select("review_id", "category", "company")


@query
def company_descriptions(spark, folder):
    return cleaning.company_values(document_reviews(spark, folder), "description")


@query
def top_bottom_companies(spark, folder):
    return rounded(companies.top_bottom_companies(stats(spark, folder), 10))


@query
def longest_reviews_companies(spark, folder):
    return companies.longest_reviews(stats(spark, folder), 15)


@query
def company_summary(spark, folder):
    return companies.company_summary(stats(spark, folder), 8)


@query
def company_summary_display(spark, folder):
    return companies.company_summary(stats(spark, folder), 8, display=True)


@query
def length_by_tier_box(spark, folder):
    return rounded(companies.length_boxes(features(spark, folder)))


@query
def length_by_tier_hist(spark, folder):
    return rounded(companies.length_histogram(features(spark, folder)))


@query
def length_limits(spark, folder):
    return rounded(companies.length_limits(features(spark, folder)))


# --- positioning -------------------------------------------------------------------------------


@query
def percentile_ranks(spark, folder):
    return rounded(positioning.percentile_ranks(stats(spark, folder)))


@query
def percentile_dashboard(spark, folder):
    return rounded(positioning.percentile_dashboard(stats(spark, folder), TARGET))


@query
def stars_positioning(spark, folder):
    return rounded(positioning.stars_positioning(stats(spark, folder), TARGET))


@query
def stars_histogram(spark, folder):
    return rounded(positioning.stars_histogram(stats(spark, folder), TARGET))


@query
def sentiment_split_benchmarks(spark, folder):
    return rounded(positioning.sentiment_split(stats(spark, folder), TARGET))


@query
def word_count_positioning(spark, folder):
    return rounded(positioning.word_count_positioning(stats(spark, folder), TARGET))


@query
def kde_avg_stars(spark, folder):
    return rounded(positioning.star_density(stats(spark, folder), TARGET))


# --- topics ------------------------------------------------------------------------------------


@query
def split_target(spark, folder):
    reviews = topics.split_target(document_reviews(spark, folder), TARGET)
    return reviews.select("review_id", "company", "is_target")


@query
def seed_centroids(spark, folder):
    return rounded(
        centroids(spark, folder).select(
            "topic_id", "macro_topic", F.posexplode("centroid").alias("pos", "value")
        )
    )


@query
def assign_topics(spark, folder):
    return rounded(
        assembled(spark, folder).select("review_id", "topic_id", "macro_topic", "topic_similarity")
    )


@query
def assembled_reviews(spark, folder):
    return rounded(
        assembled(spark, folder).select(
            "review_id", "category", "company", "title", "review", "stars", "is_target",
            "topic_id", "macro_topic", "topic_similarity",
            "sentiment", "sentiment_score", "sentiment_num",
        )
    )


def fine_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Hundreds of topics: every label in 37 parts."""
    seeds = table(spark, folder, "embeddings").withColumn("topic_id", (F.col("label") * 37 + F.col("vec_id") % 37).cast("int"))
    return seeds.select("topic_id", F.concat(F.lit("topic_"), F.col("topic_id")).alias("macro_topic"), "embedding")


@query
def assign_fine_topics(spark, folder):
    fine = topics.collect_topics(topics.seed_centroids(fine_seeds(spark, folder)))
    found = centroid_index.assign_by_index(with_vectors(spark, folder), fine)
    return rounded(found.select("review_id", "topic_id", "macro_topic", "topic_similarity"))


@query
def topic_distribution(spark, folder):
    return rounded(topics.assignment_distribution(assembled(spark, folder)))


@query
def topic_summary(spark, folder):
    return rounded(summary(spark, folder))


@query
def topic_summary_named(spark, folder):
    return rounded(compare.topic_summary(assembled(spark, folder), exclude_other=True))


@query
def macro_distribution(spark, folder):
    return rounded(compare.macro_distribution(summary(spark, folder)))


@query
def topic_heatmap(spark, folder):
    return rounded(compare.topic_heatmap(summary(spark, folder)))


@query
def head_to_head(spark, folder):
    return rounded(merged(spark, folder))


@query
def strengths_weaknesses(spark, folder):
    return rounded(compare.strengths_weaknesses(merged(spark, folder)))


@query
def weak_topics(spark, folder):
    return rounded(compare.weak_topics(merged(spark, folder), min_reviews=MIN_REVIEWS))


@query
def negative_reviews(spark, folder):
    return rounded(rootcause.extract_reviews(assembled(spark, folder)))


def _root_cause(spark, folder, max_reviews=None):
    rows = durable(assembled(spark, folder), "assembled")  # read twice below, computed once
    heads = compare.head_to_head(compare.topic_summary(rows))
    return rootcause.root_cause(rows, heads, min_reviews=MIN_REVIEWS, max_reviews=max_reviews)


@query
def root_cause_reviews(spark, folder):
    return rounded(_root_cause(spark, folder).negative_reviews)


@query
def root_cause_worst(spark, folder):
    return rounded(_root_cause(spark, folder, max_reviews=2).negative_reviews)


@query
def root_cause_words(spark, folder):
    return _root_cause(spark, folder).words


@query
def word_gap(spark, folder):
    return rootcause.word_frequencies(assembled(spark, folder))


@query
def top_words_tone(spark, folder):
    return rounded(rootcause.words_and_tone(assembled(spark, folder)))


@query
def topic_keywords(spark, folder):
    named = assembled(spark, folder).where(F.col("macro_topic") != OTHER_TOPIC)
    return rounded(discovery.topic_keywords(named))


def _comparison(spark, folder):
    reviews = with_vectors(spark, folder)
    return compare_company(reviews, TARGET, centroids=centroids(spark, folder), min_reviews=MIN_REVIEWS, keep=False)


@query
def comparison_merged(spark, folder):
    return rounded(_comparison(spark, folder).merged)


@query
def comparison_summary(spark, folder):
    return rounded(_comparison(spark, folder).summary_target)


@query
def sector_word_positioning(spark, folder):
    report = explore_sector(document_reviews(spark, folder), SECTOR, TARGET, sectors=LANGUAGES, keep=False)
    return rounded(report.word_count_positioning)


# --- models ------------------------------------------------------------------------------------


@query
def embed_texts(spark, folder):
    rows = models.embed_texts(cleaned(spark, folder), "review", letter_encoder)
    v = F.col("embedding")
    return rows.select(
        "review_id",
        *(v[i].cast("double").alias(name) for i, name in enumerate(("chars", "blanks", "e", "a"))),
    )


@query
def classify_sentiment(spark, folder):
    rows = models.score_sentiment(cleaned(spark, folder), "review", vowel_classifier)
    return rounded(rows.select("review_id", "sentiment", "sentiment_score", "sentiment_num"))


@query
def discover_topics(spark, folder):
    flagged = topics.flag_target(with_vectors(spark, folder), TARGET)
    return discovery.discover_topics(flagged, rounds=8).select("review_id", "is_target", "discovered_topic")


@query
def pca_2d(spark, folder):
    flagged = topics.flag_target(with_vectors(spark, folder), TARGET)
    return rounded(discovery.pca_coordinates(flagged).select("review_id", "is_target", "pc1", "pc2"))


# --- density clusters ----------------------------------------------------------------------------


@query
def vector_neighbours(spark, folder):
    nodes = durable(density.distinct_vectors(document_vectors(spark, folder)), "density-nodes")
    graph = density.neighbour_graph(nodes)
    near = graph.select("node", "copies", F.posexplode("near").alias("rank", "near"))
    return rounded(
        near.select("node", "copies", (F.col("rank") + 1).cast("long").alias("rank"), F.col("near.other").alias("other"), F.col("near.distance").alias("distance"))
    )


@query
def dense_clusters(spark, folder):
    vectors = document_vectors(spark, folder)
    return rounded(density.density_clusters(vectors, min_samples=2, min_cluster_size=3, core_share=0.1))


# --- statistics that follow their reviews --------------------------------------------------------


BATCHES = 3


def _followed(spark, folder, rows: DataFrame, layout: state.Layout, withdraw=None) -> DataFrame:
    """A state that took all rows in batch by batch, the last one twice, and gave some back."""
    store = state.StateStore(spark, durable_path(spark, f"state-{layout.name}"), layout)
    for k in range(BATCHES):
        store.apply(f"batch {k}", add=rows.where(F.pmod(F.col("review_id"), F.lit(BATCHES)) == k))
    store.apply(f"batch {BATCHES - 1}", add=rows.where(F.pmod(F.col("review_id"), F.lit(BATCHES)) == BATCHES - 1))
    if withdraw is not None:
        store.apply("withdrawn", withdraw=rows.where(withdraw))
    return store.current()


@query
def stats_from_batches(spark, folder):
    return state.company_stats(_followed(spark, folder, features(spark, folder), state.company_layout()))


@query
def stats_after_withdrawal(spark, folder):
    rows = features(spark, folder)
    return state.company_stats(_followed(spark, folder, rows, state.company_layout(), F.col("stars") == 1))


@query
def describe_after_withdrawal(spark, folder):
    rows = features(spark, folder)
    return rounded(state.describe_stars(_followed(spark, folder, rows, state.company_layout(), F.col("stars") == 1)))


@query
def length_limits_after_withdrawal(spark, folder):
    rows = features(spark, folder)
    return rounded(state.length_limits(_followed(spark, folder, rows, state.length_layout(), F.col("stars") == 1)))


@query
def topic_summary_from_batches(spark, folder):
    rows = durable(assembled(spark, folder), "assembled")  # read once a batch, computed once
    return rounded(state.topic_summary(_followed(spark, folder, rows, state.topic_layout())))


# --- how certain gaps and words are --------------------------------------------------------------


@query
def gap_bounds(spark, folder):
    rows = durable(assembled(spark, folder), "assembled")
    return rounded(certainty.gap_bounds(rows, compare.head_to_head(compare.topic_summary(rows))))


@query
def certain_weak_topics(spark, folder):
    rows = durable(assembled(spark, folder), "assembled")
    bounded = certainty.gap_bounds(rows, compare.head_to_head(compare.topic_summary(rows)))
    return rounded(certainty.certain_strengths_weaknesses(bounded))


@query
def word_odds(spark, folder):
    return rounded(wordodds.word_odds(assembled(spark, folder)))


@query
def distinctive_words(spark, folder):
    odds = wordodds.word_odds(assembled(spark, folder), sentiment=None)
    return rounded(wordodds.distinctive_words(odds, min_z=1.0))


# --- phrases and sketches ------------------------------------------------------------------------


@query
def frequent_runs(spark, folder):
    return phrases.frequent_runs(assembled(spark, folder))


@query
def key_phrases(spark, folder):
    scores = phrases.phrase_scores(phrases.frequent_runs(assembled(spark, folder)))
    return rounded(phrases.ranked_phrases(scores, 25).select("macro_topic", "rank", "run", "n", "n_all", "g2"))


@query
def unlike_phrases(spark, folder):
    scores = phrases.phrase_scores(phrases.frequent_runs(assembled(spark, folder)))
    return rounded(phrases.unlike_phrases(phrases.ranked_phrases(scores, 25)))


@query
def sketched_lengths(spark, folder):
    kept = durable(sketches.quantile_sketches(features(spark, folder), ["category", "company"], "review_word_count"), "sketches")
    return sketches.sketched_quantiles(
        sketches.merge_sketches(kept, ["category"]), {"least": 0, "p25": 0.25, "p50": 0.5, "p97": 0.97, "most": 1}
    ).drop("lowest", "highest")
