"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its three-word shingles. Shingles stand in one global order, rare ones
first. With a prefix of n - ceil(t n) + l shingles each, two sets of similarity t or more share at
least l of them. Each document picks its own l by estimated cost: a longer prefix reads more
postings, but a candidate must then match l times. Two documents are compared when they share at
least the smaller of their two l.

Rarity comes from a count table of fixed size over all documents. It only decides the order and the
cost estimate; a shingle that shares its entry looks more frequent than it is, which loses nothing.

Equal sets are one node. Candidates are settled in two rounds: in each posting list all nodes meet
the one most at its centre, then only pairs that are not yet in one component meet each other, so a
group of thousands of near copies does not meet itself pair by pair. Links inside a component that
is known already add nothing to it; no link between components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plaudit.llm import arrays as A, bloom, tables
from plaudit.llm.graph import components
from plaudit.plans.session import durable

SHINGLE = 3
PERCENT = 90
LEVELS = 4
SKETCH_BITS = 19
# Cost of a row sent, of a posting met, and of a candidate verified.
COSTS = (2.0, 1.0, 8.0)


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words = A.words_of(batch.column("text"), A.SPACED)
    found, texts, _ = A.shingles(A.word_hashes(words), words.bounds, size)
    if len(texts) and np.any(np.diff(texts) < 0):  # short texts were appended
        order = np.argsort(texts, kind="stable")
        found, texts = found[order], texts[order]
    bounds = np.searchsorted(texts, np.arange(batch.num_rows + 1))
    for i in range(batch.num_rows):
        yield np.unique(found[bounds[i] : bounds[i + 1]])


def _set_id(shingles: np.ndarray) -> int:
    """One number for a set, the same in any order."""
    total = A.mix(shingles ^ np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(A.signed(A.mix(np.array([total], np.uint64)))[0])


def _sketch(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in A.blocks(batches):
            words = A.words_of(batch.column("text"), A.SPACED)
            found, _, _ = A.shingles(A.word_hashes(words), words.bounds, size)
            total += np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        yield from tables.rows(total)

    parts = docs.select("text").mapInArrow(count, tables.SCHEMA)
    return tables.summed(parts, docs.rdd.getNumPartitions(), 1 << bits)


def _level(costs: np.ndarray, n: int, least: int, levels: int, weights: tuple) -> int:
    """The l of the cheapest prefix. ``costs``: estimated documents per shingle, in order.

    A candidate that must match l times takes l postings, so there are at most postings / l.
    """
    send, meet, verify = weights
    best, level = None, 1
    for l in range(1, min(levels, least) + 1):
        length = n - least + l
        postings = float(costs[length - 1])
        cost = send * length + meet * postings + verify * postings / l
        if best is None or cost < best:
            best, level = cost, l
    return level


def _prefixes(docs: DataFrame, sketch, size: int, percent: int, levels: int, bits: int, weights: tuple) -> DataFrame:
    """Per document: set_id, n and its prefix; copies of a set inside one task send it once."""
    schema = "doc_id long, set_id long, n int, level int, tokens array<long>, places array<int>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        usual = float(np.median(counts)) if len(counts) else 0.0
        seen: set[int] = set()
        for batch in A.blocks(batches):
            out: list[list] = [[], [], [], [], []]
            for shingles in _sets(batch, size):
                n = len(shingles)
                set_id, level, tokens, places = (_set_id(shingles) if n else None), 0, [], []
                if n and set_id not in seen:
                    seen.add(set_id)
                    frequency = counts[(shingles >> np.uint64(64 - bits)).astype(np.int64)]
                    order = np.argsort(frequency, kind="stable")  # ties stay in the order of the hash
                    least = -(-percent * n // 100)
                    expected = np.cumsum(np.maximum(frequency[order] - usual, 1.0))
                    level = _level(expected, n, least, levels, weights)
                    head = order[: n - least + level]
                    shared = frequency[head] > 1  # an entry of 1 belongs to this document alone
                    tokens, places = A.signed(shingles[head[shared]]), np.flatnonzero(shared).astype(np.int32)
                for column, value in zip(out, (set_id, n, level, tokens, places), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                    pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.list_(pa.int32())),
                ],
                ["doc_id", "set_id", "n", "level", "tokens", "places"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def _wanted_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """set_id, items: the whole sets of the wanted ids, each once."""
    chosen = docs.sparkSession.sparkContext.broadcast(bloom.build(wanted, "set_id"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in A.blocks(batches):
            sets = [s for s in _sets(batch, size) if len(s)]
            ids = np.array([_set_id(s) for s in sets], np.int64)
            keep = []
            for i in bloom.passing(chosen.value, ids.view(np.uint64)).tolist():
                if ids[i] not in seen:
                    seen.add(int(ids[i]))
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[keep], pa.int64()), pa.array([sets[i].tobytes() for i in keep], pa.binary())],
                ["set_id", "items"],
            )

    found = docs.select("text").mapInArrow(collect, "set_id long, items binary")
    return found.join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (left, right) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * common >= percent * (len(both) - common)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    x = sets.select(F.col("set_id").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("set_id").alias("b"), F.col("items").alias("y"))
    return pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _long_enough(percent: int):
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return 100 * small.cast("long") >= percent * large.cast("long")


def _central_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Each node with the leader of a posting list, where they share enough leading shingles."""
    pairs = shared.where("set_id <> leader").select(
        F.col("leader").alias("a"), F.col("set_id").alias("b"), F.col("leader_n").alias("n_a"), F.col("n").alias("n_b"),
        F.least("leader_level", "level").alias("level"),
    )
    counted = pairs.where(_long_enough(percent)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min("level").alias("level"))
    return counted.where("c >= level").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _crossing_pairs(shared: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components, by the place, length and multi-match bounds.

    The k-th shared shingle of a pair stands at places up to n - overlap + k - 1 in both sets. So a
    pair is met first by a shingle in the bounds of k = 1; only such pairs are then counted. At a
    place, a posting serves partners up to a size, its reach; and of two partners the smaller one
    must reach its own size at least, for the other is no smaller.
    """
    rows = (
        shared.select("token", "set_id", "n", "level", "place")
        .join(known.withColumnRenamed("node", "set_id"), "set_id", "left")
        .withColumn("root", F.coalesce("root", "set_id"))
        .withColumn("reach", F.floor((100 + percent) * (F.col("n") - F.col("place")) / percent).cast("int") - F.col("n"))
    )
    first = rows.where(100 * F.col("reach").cast("long") >= percent * F.col("n").cast("long"))
    mixed = first.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("token")
    first = durable(first.join(mixed, "token", "left_semi"), "jaccard-mixed")
    small, large = first.where("reach >= n"), first
    spans = [F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("reach")]
    smaller, larger = (
        side.groupBy("token", "root").agg(*spans).select(
            "token", *(F.col(c).alias(f"{c}_{name}") for c in ("root", "least", "most", "reach"))
        )
        for side, name in ((small, "a"), (large, "b"))
    )
    meeting = smaller.join(larger, "token").where(
        "root_a <> root_b AND least_a <= reach_b AND least_b <= reach_a AND most_b >= least_a"
    ).select("token", "root_a", "root_b")

    def named(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.select("token", *(F.col(c).alias(f"{c}_{name}") for c in columns))

    overlap = F.ceil(percent * (F.col("n_a").cast("long") + F.col("n_b")) / (100 + percent))

    def within(k) -> Column:
        return (F.col("place_a") < F.col("n_a") - overlap + k) & (F.col("place_b") < F.col("n_b") - overlap + k)

    columns = ("root", "set_id", "n", "place")
    met = durable(
        meeting.join(named(small, "a", *columns), ["token", "root_a"])
        .join(named(large, "b", *columns), ["token", "root_b"])
        .where("n_a < n_b OR n_a = n_b AND set_id_a < set_id_b")
        .where(_long_enough(percent))
        .where(within(1))
        .select("set_id_a", "set_id_b", "n_a", "n_b").distinct(),
        "jaccard-met",
    )
    # Per set its head in the global order, as long as its prefix at most; a pair is one row with both.
    heads = shared.groupBy("set_id").agg(
        F.first("level").alias("level"), F.sort_array(F.collect_list(F.struct("place", "token"))).alias("head")
    )

    def of(name: str) -> DataFrame:
        return heads.select(*(F.col(c).alias(f"{c}_{name}") for c in heads.columns))

    level = F.least("level_a", "level_b")

    def leading(name: str) -> Column:
        bound = F.col(f"n_{name}") - overlap + level
        return F.transform(F.filter(f"head_{name}", lambda x: x["place"] < bound), lambda x: x["token"])

    def last_place(name: str) -> Column:
        last = F.array_position(F.transform(f"head_{name}", lambda x: x["token"]), F.try_element_at("common", F.lit(-1)))
        return F.try_element_at(f"head_{name}", last.cast("int"))["place"]

    pairs = (
        met.join(of("a"), "set_id_a").join(of("b"), "set_id_b")
        .withColumn("common", F.array_intersect(leading("a"), leading("b")))
        .where(F.size("common") >= level)
    )
    # All common shingles up to the last one met are counted; the rest is bounded by what follows.
    after = F.least(*(F.col(f"n_{name}") - last_place(name) for name in "ab"))
    total = F.col("n_a").cast("long") + F.col("n_b")
    return pairs.where((100 + percent) * (F.size("common") + after - 1) >= percent * total).select(
        F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b")
    )


def jaccard_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
    levels: int = LEVELS,
    sketch_bits: int = SKETCH_BITS,
    costs: tuple[float, float, float] = COSTS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when 100 * intersection >= percent * union of their shingle sets; component_id is
    the smallest doc_id reachable by links. A text of fewer words than a shingle is one shingle; null,
    empty and blank texts have no set, link with nothing and are their own component. A null id is
    never the smallest while another id is there. Repeated rows share a component. Empty tables and
    other columns do no harm. Sets are told apart by 64-bit hashes.
    """
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = context.broadcast(_sketch(docs, size, sketch_bits))
    cut = durable(_prefixes(docs, sketch, size, percent, levels, sketch_bits, costs), "jaccard-prefixes")

    postings = cut.select("set_id", "n", "level", F.arrays_zip("tokens", "places").alias("z")).select(
        "set_id", "n", "level", F.explode("z").alias("z")
    )
    by_token = Window.partitionBy("token")
    lead = by_token.orderBy("place", "set_id")  # the earlier the shingle, the fewer rarer ones: the centre
    shared = durable(
        postings.select(F.col("z.tokens").alias("token"), "set_id", "n", "level", F.col("z.places").alias("place"))
        .withColumns(
            {
                "leader": F.first("set_id").over(lead),
                "leader_n": F.first("n").over(lead),
                "leader_level": F.first("level").over(lead),
                "low": F.min("set_id").over(by_token),
                "high": F.max("set_id").over(by_token),
            }
        )
        .where("low <> high")
        .drop("low", "high")
        .dropDuplicates(["token", "set_id"]),
        "jaccard-shared",
    )
    def links(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        return durable(_verified(pairs, durable(_wanted_sets(docs, wanted, size), "jaccard-sets"), percent), "jaccard-links")

    central = links(durable(_central_pairs(shared, percent), "jaccard-pairs"))
    known = components(central)
    crossing = links(durable(_crossing_pairs(shared, known, percent), "jaccard-pairs"))
    roots = components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).union(crossing))

    nodes = cut.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    rooted = nodes.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "root", F.coalesce("root", "set_id")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = durable(rooted.join(smallest, "root").select("set_id", "component_id"), "jaccard-named")
    return cut.join(named, "set_id", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
