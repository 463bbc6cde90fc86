"""Statistics that follow their reviews: additive tables that take batches in and give them back.

A state holds whole numbers only (counts, sums, counts of values; similarities as decimals), so taking
a batch in and back again leaves exactly what was there before, in any order. Statistics are computed
from a state as they are from the reviews, and come out the same. A state has a row per key, not per
review, so a new batch costs its own reading and one aggregation over keys.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plaudit.functions.labels import dominant_sentiment, net_sentiment, round2, stats_tiers
from plaudit.operators.companies import DESCRIBE_POINTS
from plaudit.operators.distribution import quantiles, ranked
from plaudit.plans.session import remove_durable


@dataclass(frozen=True)
class Layout:
    """What a state is keyed by, and what it adds up; the first sum counts the rows."""

    name: str
    keys: tuple[str, ...]
    sums: Mapping[str, Column]


def company_layout() -> Layout:
    """Stars and lengths by sector, company and star value, from reviews with length features."""
    return Layout(
        "company", ("category", "company", "stars"),
        {
            "n": F.count(F.lit(1)), "texts": F.count("review"),
            "words": F.sum(F.col("review_word_count").cast("long")),
            "title_words": F.sum(F.col("title_word_count").cast("long")),
        },
    )


def length_layout() -> Layout:
    """How many reviews of a sector and star value have so many words."""
    return Layout("length", ("category", "stars", "review_word_count"), {"n": F.count(F.lit(1))})


def topic_layout() -> Layout:
    """Sentiments and similarities by side and topic, from assembled reviews."""
    similarity = F.col("topic_similarity").cast("decimal(20,15)")
    return Layout(
        "topic", ("is_target", "macro_topic", "sentiment"),
        {
            "n": F.count(F.lit(1)), "similar": F.count(similarity),
            "similarity": F.coalesce(F.sum(similarity), F.lit(0)).cast("decimal(38,15)"),
        },
    )


def tally(rows: DataFrame, layout: Layout) -> DataFrame:
    """The state of some reviews: one row per key, null keys included."""
    return rows.groupBy(*layout.keys).agg(*(F.coalesce(c, F.lit(0)).alias(name) for name, c in layout.sums.items()))


def merged(layout: Layout, *added: DataFrame, withdrawn: tuple[DataFrame, ...] = ()) -> DataFrame:
    """States added up, without those ``withdrawn``. Keys left without rows go."""
    names = list(layout.sums)

    parts = [s.select(*layout.keys, *names) for s in added]
    parts += [s.select(*layout.keys, *((-F.col(name)).alias(name) for name in names)) for s in withdrawn]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    kinds = {name: parts[0].schema[name].dataType for name in names}
    out = total.groupBy(*layout.keys).agg(*(F.sum(name).cast(kinds[name]).alias(name) for name in names))
    return out.where(" or ".join(f"{name} <> 0" for name in names))


def overdrawn(state: DataFrame, layout: Layout) -> DataFrame:
    """Keys from which more was withdrawn than was there; empty when all is well."""
    count = next(iter(layout.sums))
    others = [name for name in layout.sums if name != count]
    left_over = " or ".join(f"({count} = 0 and {name} <> 0)" for name in others)
    return state.where(f"{count} < 0" + (f" or {left_over}" if others else ""))


# --- a kept state ----------------------------------------------------------------------------------


class StateStore:
    """A state in a folder, in versions; a version is there once its ledger of batches is.

    A batch is applied once however often it comes (a stream may hand it over again), and a failed or
    interrupted application leaves the version before it. ``keep`` versions stay for readers. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, layout: Layout, keep: int = 2):
        if keep < 1:
            raise ValueError("keep must be 1 or more")
        self.spark, self.folder, self.layout, self.keep = spark, folder.rstrip("/"), layout, keep

    def _path(self, version: int, part: str = "") -> str:
        return f"{self.folder}/v{version:012d}" + (f"/{part}" if part else "")

    def versions(self) -> list[int]:
        """Complete versions, ascending."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        top = jvm.Path(self.folder)
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(top):
            return []
        names = [entry.getPath().getName() for entry in files.listStatus(top)]
        found = sorted(int(name[1:]) for name in names if name.startswith("v") and name[1:].isdigit())
        return [v for v in found if files.exists(jvm.Path(self._path(v, "ledger/_SUCCESS")))]

    def current(self) -> DataFrame | None:
        """The state of the last version; None before the first batch."""
        versions = self.versions()
        return self.spark.read.parquet(self._path(versions[-1], "state")) if versions else None

    def applied(self) -> list[str]:
        """The names of all batches in the last version; one row of the ledger each."""
        versions = self.versions()
        if not versions:
            return []
        return sorted(row["batch"] for row in self.spark.read.parquet(self._path(versions[-1], "ledger")).collect())

    def apply(self, batch: str, add: DataFrame | None = None, withdraw: DataFrame | None = None) -> bool:
        """Take reviews in and others back; False if a batch of that name was applied before.

        ValueError, and no new version, if more is withdrawn than was there.
        """
        done = self.applied()
        if batch in done:
            return False
        before = self.current()
        added = ([before] if before is not None else []) + ([tally(add, self.layout)] if add is not None else [])
        taken = (tally(withdraw, self.layout),) if withdraw is not None else ()
        if not added and not taken:
            raise ValueError("a first batch needs reviews")
        if not added:
            added = [taken[0].limit(0)]
        version = (self.versions() or [-1])[-1] + 1
        merged(self.layout, *added, withdrawn=taken).write.mode("overwrite").parquet(self._path(version, "state"))
        state = self.spark.read.parquet(self._path(version, "state"))
        wrong = overdrawn(state, self.layout).limit(1).collect()
        if wrong:
            remove_durable(self.spark, self._path(version))
            raise ValueError(f"more withdrawn than was there: {wrong[0].asDict()}")
        ledger = self.spark.createDataFrame([(name,) for name in [*done, batch]], "batch string")
        ledger.coalesce(1).write.mode("overwrite").parquet(self._path(version, "ledger"))
        for old in self.versions()[: -self.keep]:
            remove_durable(self.spark, self._path(old))
        return True


# --- statistics of a state -------------------------------------------------------------------------


def _ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom)


def company_stats(state: DataFrame) -> DataFrame:
    """:func:`plaudit.operators.companies.company_stats` of a company state."""
    n, words = F.col("n"), F.col("words")
    rated = F.sum(F.when(F.col("stars").isNotNull(), n))
    tiers = stats_tiers(F.col("stars"))

    def within(inside: Column, what: Column) -> Column:
        return F.coalesce(F.sum(F.when(inside, what)), F.lit(0).cast("long"))

    metrics = {
        "avg_stars": _ratio(F.sum(F.col("stars") * n), rated),
        **{f"pct_{t}": _ratio(within(c, n), F.sum(n)) * 100 for t, c in tiers.items()},
        "avg_review_words": _ratio(F.sum(words), F.sum(n)),
        "avg_title_words": _ratio(F.sum("title_words"), F.sum(n)),
        "review_word_count": _ratio(F.sum(words), F.sum(n)),
        **{f"wc_{t}": F.coalesce(_ratio(within(c, words), F.nullif(within(c, n), F.lit(0))), F.lit(0.0)) for t, c in tiers.items()},
    }
    return (
        state.where(F.col("category").isNotNull() & F.col("company").isNotNull())
        .groupBy("category", "company")
        .agg(*(round2(metric).alias(name) for name, metric in metrics.items()), F.sum("texts").alias("review_count"))
    )


def star_distribution(state: DataFrame) -> DataFrame:
    """Reviews per star value of each sector, from a company state."""
    return state.where(F.col("category").isNotNull() & F.col("stars").isNotNull()).groupBy("category", "stars").agg(F.sum("n").alias("n"))


def describe_stars(state: DataFrame, by: tuple[str, ...] = ("category",)) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of the stars, from a company state."""
    keys = list(by)
    values = state.where(F.col("stars").isNotNull()).groupBy(*keys, "stars").agg(F.sum("n").alias("n"))
    x, n = F.col("stars").cast("long"), F.col("n")
    sums = values.groupBy(*keys).agg(
        F.sum(n).alias("count"), F.sum(x * n).alias("_s"), F.sum(x * x * n).alias("_q"), F.min("stars").cast("double").alias("min"),
        F.max("stars").cast("double").alias("max"),
    )
    count, s, q = F.col("count"), F.col("_s").cast("double"), F.col("_q").cast("double")
    spread = sums.select(
        *keys, "count", (s / count).alias("mean"),
        F.sqrt(F.greatest(F.try_divide(q - s * s / count, count - 1), F.lit(0.0))).alias("std"), "min", "max",
    )
    points = quantiles(ranked(values, keys, "stars"), keys, "stars", DESCRIBE_POINTS).drop("total")
    return spread.join(points, keys).select(*keys, "count", "mean", "std", "min", *DESCRIBE_POINTS, "max")


def length_limits(state: DataFrame, points=(("p97", 0.97), ("p99", 0.99))) -> DataFrame:
    """:func:`plaudit.operators.companies.length_limits` of a length state."""
    values = (
        state.where(F.col("category").isNotNull() & F.col("review_word_count").isNotNull())
        .groupBy("category", "review_word_count").agg(F.sum("n").alias("n"))
    )
    found = quantiles(ranked(values, ["category"], "review_word_count"), ["category"], "review_word_count", dict(points))
    return found.withColumnRenamed("total", "n")


def topic_summary(state: DataFrame) -> DataFrame:
    """:func:`plaudit.operators.compare.topic_summary` of a topic state."""
    labels = ("positive", "neutral", "negative")

    def share(label: str) -> Column:
        inside = F.coalesce(F.sum(F.when(F.col("sentiment") == label, F.col("n"))), F.lit(0).cast("long"))
        return (_ratio(inside, F.sum("n")) * 100).alias(f"pct_{label}")

    return (
        state.groupBy("is_target", "macro_topic")
        .agg(
            F.sum("n").alias("n_reviews"), *(share(label) for label in labels),
            _ratio(F.sum("similarity"), F.sum("similar").cast("double")).alias("avg_similarity"),
        )
        .withColumn("net_sentiment", net_sentiment(F.col("pct_positive"), F.col("pct_negative")))
        .withColumn("dominant_sentiment", dominant_sentiment(*(F.col(f"pct_{label}") for label in labels)))
    )
