"""Decontamination, pseudonyms, page text and license scans."""

import datetime
import random
import re

import pytest

from plaudit.llm import decontaminate as D, html_text as H, licenses as C, pseudonyms as P

SCHEMA = "doc_id long, text string, row_key string, n_words string, shingle string"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "r", "n", "s") for i, t in zip(ids, texts)], SCHEMA).repartition(3)


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(texts, items):
    out = []
    for text in texts:
        words, hit, names = words_of(text), set(), set()
        for item_id, item in items:
            own = words_of(item)
            size = min(10, len(own))
            for at in range(len(own) - size + 1) if own else ():
                window = own[at : at + size]
                for start in range(len(words) - size + 1):
                    if words[start : start + size] == window:
                        hit |= set(range(start, start + size))
                        names.add(item_id)
        out.append((len(words), len(hit), sorted(str(n) for n in names)))
    return out


def contaminated_texts(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "née", "Xy"]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 25]))) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            own = rng.choice(items).upper().split()
            start = rng.randrange(len(own))
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = own[start : start + rng.randrange(1, 26)]
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts))
    return texts + [None, "", "...", items[-1] * 50], list(enumerate(items)) + [(50, None), (51, ""), (52, items[3])]


def test_contamination_matches_brute_force(spark):
    texts, items = contaminated_texts()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in D.contamination(table(spark, texts), benchmark).collect()}
    assert [found[i] for i in range(len(texts))] == brute_hits(texts, items)


def test_a_small_filter_loses_nothing(spark):
    texts, items = contaminated_texts(6)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = D.contamination(table(spark, texts), benchmark, filter_bits=8, salts=1).collect()
    assert {r.doc_id: r.n_hit for r in found} == {i: h for i, (_, h, _) in enumerate(brute_hits(texts, items))}


def test_contamination_of_empty_tables_and_repeated_rows(spark):
    item = "one two three four five six seven eight nine ten eleven"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = table(spark, [item, item, item, "other"], [3, 3, None, 4])
    found = sorted((r.doc_id or -1, r.n_hit) for r in D.contamination(docs, benchmark).collect())
    assert found == [(-1, 11), (3, 11), (3, 11), (4, 0)]
    assert D.contamination(docs.limit(0), benchmark).count() == 0
    assert {r.n_hit for r in D.contamination(docs, benchmark.limit(0)).collect()} == {0}


KEY = P.key_of("test")
VALUES = {
    "email": "jane.doe7@mail.example.com", "card": "4539 1488 0343 6467", "phone": "+1 (555) 555-0123",
    "ip": "192.168.10.7", "date": "2001-02-28", "secret": "0a" * 20, "ssn": "123-45-6789", "iban": "DE89370400440532013000",
    "intl": "+4915112345678",
}


@pytest.mark.parametrize("kind", sorted(VALUES))
def test_pseudonyms_keep_the_format_and_can_be_undone(kind):
    value = VALUES[kind]
    text, spans = P.replace(f"ä {value}, und {value}.", KEY)
    assert [s[0] for s in spans] == [kind, kind]
    made = [text[s:e] for _, s, e in spans]
    assert made[0] == made[1] != value and value not in text
    shape = re.compile(r"[0-9a-z]", re.I)
    assert shape.sub("x", made[0]) == shape.sub("x", value) or kind == "ip"
    assert P.pseudonym(KEY, kind, made[0], back=True) == value
    assert P.replace(f"{value}", P.key_of("other"))[0] != made[0]


def test_checks_hold_afterwards():
    card = P.pseudonym(KEY, "card", VALUES["card"])
    digits = re.sub(r"\D", "", card)
    assert P.luhn_digit(digits[:-1]) == digits[-1]
    assert datetime.date.fromisoformat(P.pseudonym(KEY, "date", "1999-12-31"))
    iban = P.pseudonym(KEY, "iban", VALUES["iban"])
    assert P._iban_check(iban[:2], iban[4:]) == iban[2:4]
    assert P.pseudonym(KEY, "date", "2001-02-30") is None and P.pseudonym(KEY, "ip", "300.1.1.1") is None


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    feistel = P.Feistel(KEY, size, b"t")
    made = [feistel.permute(x) for x in range(size)]
    assert sorted(made) == list(range(size))
    assert [feistel.undo(y) for y in made] == list(range(size))


@pytest.mark.parametrize(
    "value",
    ["03/14/1985", "14.03.1985", "3/4/1985", "4.12.1999", "14-03-1985", "14 March 1985", "May 5, 1985", "05 May 1985", "1. April 2001",
     "5235551055", "555-4510", "+33 1 23 45 67 89", "01 23 45 67 89"],
)
def test_usual_dates_and_phones_are_masked_and_can_be_undone(value):
    text, spans = P.replace(f"am {value}, und {value}.", KEY)
    assert len(spans) == 2 and value not in text
    kind, start, end = spans[0]
    assert P.pseudonym(KEY, kind, text[start:end], back=True) == value
    assert P.replace(text, KEY, back=True)[0] == f"am {value}, und {value}."


def test_an_invalid_match_hides_nothing():
    text, spans = P.replace("NO12 4316522678525456 and DE00370400440532013000 jane@x.example", KEY)
    assert "4316522678525456" not in text and {s[0] for s in spans} >= {"card", "email"}
    text, spans = P.replace("300.1.1.1 and 2001-02-30 14:00", KEY)
    assert not spans


def test_pseudonymise_leaves_other_texts_alone(spark):
    texts = ["no data here, 12 of 7. version 2.0", None, "", "call +1 (555) 555-0123", "x" * 200_000]
    found = {r.doc_id: r for r in P.pseudonymise(table(spark, texts), KEY).collect()}
    assert [found[i].text for i in (0, 1, 2, 4)] == [texts[i] for i in (0, 1, 2, 4)]
    assert [len(found[i].spans) for i in range(5)] == [0, 0, 0, 1, 0]
    assert P.pseudonymise(table(spark, texts).limit(0), KEY).count() == 0


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>x='</p>'</script></head><body>"
    "<header>Site</header><nav><ul><li>Home</li></ul></nav><div class='ad'>Buy</div>"
    "<article><header><h1>A &amp; B</h1></header><p><b>One\n two &eacute;<br>three<p>Four</p>"
    "<div class='share'>Share</div><ul><li>L1<li>L2</ul><form>Mail <input></form></article>"
    "<section id=comments><p>Nice</p></section><aside>Side</aside><footer>F</footer></body></html>"
)


def test_article_text(spark):
    rows = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "x", ""), (4, "http://a.example/y", "<p>only text"), (4, "http://a.example/y", "<p>only text")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    found = sorted((r.page_id, r.text) for r in H.extract_text(pages).collect())
    assert found == [
        (1, "A & B\nOne two é three\nFour\nL1\nL2"), (2, ""), (3, ""), (4, "only text"), (4, "only text"),
    ]
    assert H.extract_text(pages.limit(0)).count() == 0


def test_the_style_tree_cuts_what_a_host_repeats(spark):
    def page(i):
        return f"<html><body><div><p>Top bar</p></div><div id=c{i % 1}><h2>Title {i}</h2><p>Own text {i}</p></div><table><tr><td>Imprint</table></body></html>"

    rows = [(i, "http://Host.example/p", page(i)) for i in range(20)] + [(99, "http://single.example/", page(99))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in H.extract_text(pages).collect()}
    assert found[3] == "Title 3\nOwn text 3"
    assert found[99] == "Top bar\nTitle 99\nOwn text 99\nImprint"
    tree = {r.node: r.importance for r in H.style_tree(H.parsed_pages(pages.withColumn("host", H.host(pages.url)))).collect()}
    assert tree[H.node_id("host.example", ("html", "body", "table"))] == 0
    assert tree[H.node_id("host.example", ("html", "body", "div.c0"))] == pytest.approx(1)


def test_copied_articles_stay(spark):
    rows = [(i, "http://h.example/p", "<article><h1>T</h1><p>Same</p></article><p>bar</p>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in H.extract_text(pages).collect()} == {"T\nSame"}


def test_loose_class_words_lose_no_article():
    def text(html):
        return "\n".join(b[3] for b in H.article(H.parse(html).blocks))

    plain = "<p>First paragraph</p><p>Second paragraph</p>"
    both = "First paragraph\nSecond paragraph"
    assert text(f"<body><p class='text-muted'>1 May</p>{plain}</body>") == f"1 May\n{both}"
    assert text(f"<body><div class='content'>1 May</div>{plain}</body>") == f"1 May\n{both}"
    assert text(f"<body><p>bar</p><div class='post-content'>{plain}</div></body>") == both
    for around in ("<div class='layout has-sidebar'>", "<div class='with-comments'>", "<div class='search widget'>", "<form id='aspnetForm'>"):
        assert text(f"<body>{around}<article>{plain}<div class='share'>Share</div></article></body>") == both, around
    assert text(f"<body>{plain}<div class='comments'><article>Nice</article></div></body>") == both
    assert text(f"<body><article>{plain}</article><aside><article>Other {'x' * 99}</article></aside></body>") == both


def test_notices_repeated_in_plain_tags_are_cut(spark):
    def page(i):
        return f"<main><p>Read our terms.</p><h1>T{i}</h1><p>Own {i}</p></main>", f"<div>Free today</div><div>Own {i}</div>"

    rows = [(100 * k + i, f"http://h{k}.example/p", page(i)[k]) for k in (0, 1) for i in range(20)]
    copied = "<main><p>Read our terms.</p><p>Same</p></main>"
    rows += [(300 + i, "http://h0.example/p", copied) for i in range(20)]
    rows += [(400 + i, "http://h4.example/p", copied) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in H.extract_text(pages).collect()}
    assert found[7] == "T7\nOwn 7" and found[107] == "Own 7" and found[300] == "Same"
    assert found[400] == "Read our terms.\nSame"


def test_headings_that_articles_share_stay(spark):
    def page(i):
        return f"<article><h1>T{i}</h1><h2>Introduction</h2><p>own {i}</p><p>A word of ours.</p><h2>Conclusion</h2><p>end {i}</p><p>Write to us.</p></article>"

    rows = [(i, "http://h.example/p", page(i)) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in H.extract_text(pages).collect()}
    # At the rim a repeated sentence is a notice, among the article's own it is text.
    assert found[7] == "T7\nIntroduction\nown 7\nA word of ours.\nConclusion\nend 7"


def test_repeated_blocks_with_a_class_go_wherever_they_stand(spark):
    def page(i):
        return f"<article><p>own {i}</p><div class='hint'>Read on below</div><p>more {i}</p></article>"

    pages = spark.createDataFrame([(i, "http://h.example/p", page(i)) for i in range(30)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in H.extract_text(pages).collect()}[3] == "own 3\nmore 3"


@pytest.mark.parametrize("html", [
    "<div>x" * 10_000, "<div>" * 10_000 + "x" + "</div>" * 10_000, "<b>" * 10_000 + "<div>x</div>" * 10_000,
    "<ul><li>x" * 5_000, "<section>" * 5_000 + "<li>x" * 5_000, "<p>x" * 20_000, "<div class=a>x</div><p>" * 10_000 + "</article>" * 10_000,
    "<table><tr><td>x" * 5_000, "</p>" * 20_000, "<article>x" * 5_000,
])
def test_nested_and_unclosed_tags_take_linear_time(html):
    import time

    start = time.process_time()
    page = H.parse(html, "h.example")
    H.article(page.blocks)
    low = {n[0] for n in page.nodes}
    H.cut_text([{"key": n[0], "parent": n[1], "kind": n[2]} for n in page.nodes], [{"node": b[0], "content": 0, "heading": b[4], "classed": b[5], "text": b[3]} for b in page.blocks], low)
    assert time.process_time() - start < 3


def test_a_large_host_and_many_low_nodes_give_the_same(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]

    def page(i, host):
        text = " ".join(rng.choice(words) for _ in range(30))
        return (i, f"http://h{host}.example/{i}", f"<html><body><div class=top>Top of {host}</div><main><p>Notice of {host}.</p><h1>T {i}</h1><p>{text}</p></main><div><p>end of {host}</p></div></body></html>", text)

    rows = [page(i, 0 if i % 3 == 0 else 1 + i % 7) for i in range(240)]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(4)
    want = {r[0]: f"T {r[0]}\n{r[3]}" for r in rows}
    for limit in (H.BROADCAST_NODES, 0):
        found = {r.page_id: r.text for r in H.extract_text(pages, broadcast_nodes=limit).collect()}
        assert found == want


def brute_longest(values):
    best = [1] * len(values)
    for i, v in enumerate(values):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < v), default=0)
    return max(best, default=0)


def test_longest_run_by_patience():
    rng = random.Random(7)
    for _ in range(200):
        values = rng.sample(range(50), rng.randrange(12))
        run = [values[i] for i in C.longest_run(values)]
        assert run == sorted(run) and len(run) == brute_longest(values)


def brute_align(text, template):
    """Patience alignment, recursively and without any shortcut."""
    once = [w for w in template if template.count(w) == 1 and text.count(w) == 1]
    places = [text.index(w) for w in once]
    if not once:
        n = 0
        while text and template and text[-1] == template[-1]:
            text, template, n = text[:-1], template[:-1], n + 1
        while text and template and text[0] == template[0]:
            text, template, n = text[1:], template[1:], n + 1
        return n
    run = C.longest_run(places)
    total, a, c = 0, 0, 0
    for k in run:
        i, j = places[k], template.index(once[k])
        total += 1 + brute_align(text[a:i], template[c:j])
        a, c = i + 1, j + 1
    return total + brute_align(text[a:], template[c:])


def test_alignment_matches_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        template = [rng.randrange(12) for _ in range(rng.randrange(1, 15))]
        text = [w for w in template if rng.random() < 0.8]
        for _ in range(rng.randrange(6)):
            text.insert(rng.randrange(len(text) + 1), rng.randrange(12))
        pairs = C.align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) == brute_align(text, template)


def test_license_scan(spark):
    texts = [
        "some words\nReleased under the MIT License.", None, "", "the license of the version",
        C.TEMPLATES["MIT-text"].upper().replace(" ", "\n* "), "x " * 50_000 + C.TEMPLATES["Apache-2.0"],
        "Licensed under the Apache License, Version 2.0. Released under the MIT License.",
    ]
    found = {r.doc_id: [x.name for x in r.licenses] for r in C.scan_licenses(table(spark, texts)).collect()}
    assert found[0] == ["MIT"] and found[1] == found[2] == found[3] == []
    assert found[4] == ["MIT-text"] and found[5] == ["Apache-2.0"] and set(found[6]) == {"MIT", "Apache-2.0"}
    assert C.scan_licenses(table(spark, texts).limit(0)).count() == 0
