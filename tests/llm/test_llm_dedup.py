"""Exact dedup, line dedup and the Jaccard join against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plaudit.llm import exact_dedup as E, jaccard_join as J, line_dedup as L

SCHEMA = "doc_id long, text string, salt string, norm string, digest string"


def table(spark, texts, ids=None):
    """Documents, with extra columns that clash with the operators' own names."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "s", "n", "d") for i, t in zip(ids, texts)], SCHEMA).repartition(3)


def squeeze(text):
    return re.sub(r"[ \t-\r]", "", text or "")


TEXTS = ["a b", "ab", " a b ", None, "", "\n", "x", "x", "x y", "xy ", "é", "long " * 3000, "long" * 3000, "b"]


@pytest.mark.parametrize("digest", [E.sha, lambda norm: F.length(norm).cast("string")])
def test_exact_groups(spark, digest):
    found = {r.doc_id: r for r in E.exact_dedup(table(spark, TEXTS), digest=digest).collect()}
    groups = {}
    for i, text in enumerate(TEXTS):
        groups.setdefault(squeeze(text), []).append(i)
    assert len(found) == len(TEXTS)
    for norm, members in groups.items():
        best = min(members, key=lambda i: (-len(TEXTS[i] or ""), i))
        for i in members:
            r = found[i]
            assert (r.keep_id, r.group_size, r.kept) == (best, len(members), i == best)
            assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()


def test_exact_dedup_of_repeated_and_null_ids(spark):
    rows = table(spark, ["t", "t", "t", "u"], [5, 5, None, None])
    found = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in E.exact_dedup(rows).collect())
    assert found == [(-1, -1, 1, True), (-1, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True)]
    assert E.exact_dedup(rows.limit(0)).count() == 0


def test_exact_dedup_runs_without_python(spark):
    plan = E.exact_dedup(table(spark, TEXTS))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Pandas" not in plan


def lines_kept(texts, limit):
    def key(line):
        return line.encode().strip(b" \t\n\r\x0b\x0c").lower().decode()

    counts = {}
    for text in texts:
        for k in {key(line) for line in (text or "").split("\n")} - {""}:
            counts[k] = counts.get(k, 0) + 1
    hot = {k for k, n in counts.items() if n >= limit}
    return [[line for line in (t or "").split("\n") if key(line) not in hot] for t in texts]


def line_texts(n=60, seed=1):
    rng = random.Random(seed)
    common = ["Menu", " menu\t", "FOOTER é", "É", "", "   "]
    return [
        "\n".join(rng.choice(common) if rng.random() < 0.5 else f"line {rng.randrange(400)}" for _ in range(rng.randrange(8)))
        for _ in range(n)
    ] + [None, "", "\n\n", "menu", "menu\nmenu"]


@pytest.mark.parametrize("shards", [None, 5])
def test_lines_found_often_are_dropped(spark, shards):
    texts = line_texts()
    docs = table(spark, texts)
    index = L.build_index(docs, limit=3, shards=shards)
    found = {r.doc_id: r for r in L.drop_repeated_lines(docs, index).collect()}
    for i, kept in enumerate(lines_kept(texts, 3)):
        total = len((texts[i] or "").split("\n"))
        assert (found[i].text, found[i].n_lines, found[i].n_dropped) == ("\n".join(kept), total, total - len(kept))
    empty = docs.limit(0)
    assert L.drop_repeated_lines(empty, L.build_index(empty)).count() == 0


def test_removing_documents_gives_back_the_state(spark):
    first, second = table(spark, line_texts(40, 2)), table(spark, line_texts(50, 3), range(100, 155))
    start = L.build_index(first, limit=3, shards=3)
    both = L.add_documents(start, second)
    back = L.remove_documents(both, second)
    counts = [sorted((bytes(r.key), r.docs) for r in index.counts.collect()) for index in (start, back)]
    assert counts[0] == counts[1]
    full = L.build_index(first.union(second), limit=3, shards=3)
    assert sorted(map(str, both.counts.collect())) == sorted(map(str, full.counts.collect()))
    for index in (start, back):
        hot = {bytes(r.key) for r in index.counts.where("docs >= 3").collect()}
        slots = sum(int((L.CuckooFilter.load(r["filter"]).slots != 0).sum()) for r in index.filters.collect())
        assert slots == len(hot)
    cleaned = [sorted(map(str, L.drop_repeated_lines(first, index).collect())) for index in (start, back)]
    assert cleaned[0] == cleaned[1]


def test_cuckoo_filter_holds_what_it_was_given():
    import numpy as np

    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(6000)]
    made = L.CuckooFilter.of(keys[:3000])
    asked = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
    held = made.holds(asked)
    assert held[:3000].all() and held[3000:].mean() < 0.01
    assert all(made.delete(k) for k in keys[:3000]) and not made.slots.any()
    assert not made.delete(keys[0])


def brute_components(texts, percent=90):
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        words = [w.decode() for w in words]
        short = [tuple(words)] if words else []
        sets.append(set(zip(words, words[1:], words[2:])) if len(words) > 2 else set(short))
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def near_copies(seed, n=25, copies=6):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(copies)):
            changed = list(base)
            for _ in range(rng.randrange(4)):
                changed[rng.randrange(len(changed))] = f"v{rng.randrange(1000)}"
            out.append(" ".join(changed))
        out.append("  ".join(base).upper())
    return out + [None, "", " \n", "one", "ONE", "one two", "é É ê", "É É ê", "x y z x y z x y z"]


@pytest.mark.parametrize("percent", [90, 80])
def test_jaccard_components(spark, percent):
    texts = near_copies(percent)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_groups(table(spark, texts), percent=percent).collect()}
    assert [found[i] for i in range(len(texts))] == brute_components(texts, percent)


def test_a_chain_of_near_copies_is_one_component(spark):
    words = [f"a{i}" for i in range(200)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 60, 2)] + ["zz yy xx ww"]
    found = {r.doc_id: r.component_id for r in J.jaccard_groups(table(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == [0] * 30 + [30]


def test_jaccard_with_null_ids_and_no_rows(spark):
    rows = table(spark, ["a b c d", "a b c d", "q"], [7, None, None])
    found = sorted((r.doc_id or -1, r.component_id or -1) for r in J.jaccard_groups(rows).collect())
    assert found == [(-1, -1), (-1, 7), (7, 7)]
    assert J.jaccard_groups(rows.limit(0)).count() == 0


def test_components_of_a_graph(spark):
    from plaudit.llm.graph import components

    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(20)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: r for x, r in root.items() if x in found}
    assert set(found) == {x for a, b in edges if a != b for x in (a, b)}
