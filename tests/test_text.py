import random
import re
import tracemalloc
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plaudit.functions import text as X

CASES = [
    (None, ""),
    ("", ""),
    ("   ", ""),
    ("\u00a0\u2003", ""),
    (r"  Hello!!! Visit https://example.com <br>\n  Ôla  ", "Hello!!! Visit Ola"),
    ("1 &lt; 2 and 3 &gt; 1 &amp;lt;b&amp;gt; ok", "1 1 ok"),
    ("http://x.y\u00a0z ﬁne ½ 𝐀 ™ … x", "z fine 12 A TM ... x"),
    ("a\x0bb\x1cc", "a b c"),
    ("a\u2028b", "ab"),
    ("a&nbsp;b", "a b"),
    ("say &quot;hi&quot; it&#39;s", "say hi it's"),
    ("mail me.x@y.org, now", "mail now"),
    ("a@b is no address", "a b is no address"),
    ("see www.x.org/y and WWW.x.org", "see and WWW.x.org"),
    ("www.http://x.org y", "www. y"),
    ("tab\\tand\\nline", "tab and line"),
    ("one\ttwo\r\nthree", "one two three"),
    ("x <b\nclass='c'>y</b> < z", "x y z"),
    ("<<<a>>b", "b"),
    ("5 € – naïve café №5 日本", "5 naive cafe No5"),
    ("don't-stop, it's 50% off #1!", "don't-stop, it's 50 off 1!"),
    ("nul\x00byte", "nul byte"),
]


def run(spark, texts, step):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = step(rows).orderBy("i").collect()
    return [r.t for r in found]


def test_clean_text_cases(spark):
    cleaned = run(spark, [c for c, _ in CASES], lambda df: X.clean_text(df, ["t"]))
    assert cleaned == [expected for _, expected in CASES]


def test_chain_equals_its_single_steps(spark):
    steps = (
        X.fix_newlines, X.remove_html, X.remove_urls, X.remove_emails,
        X.to_ascii, X.blank_symbols, X.squeeze_spaces,
    )

    def one_by_one(df):
        df = df.withColumn("t", F.coalesce("t", F.lit("")))
        for step in steps:
            df = df.withColumn("t", step(F.col("t")))
        return df

    rng = random.Random(7)
    pieces = ["http://", "https://", "www.", "@", ".", "<", ">", "&amp;", "&lt;", "\\n", "\n",
              " ", "\u00a0", "\u2028", "a", "B", "é", "ﬁ", "™", "!", "#", "\x1c", "\x85", "日"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(3000)]
    texts += [c for c, _ in CASES]
    assert run(spark, texts, lambda df: X.clean_text(df, ["t"])) == run(spark, texts, one_by_one)


@pytest.mark.parametrize(
    "step, pattern",
    [
        (X.remove_emails, r"\S+@\S+\.\S+"),
        (X.remove_http_urls, r"https?://\S+"),
        (X.remove_www_urls, r"www\.\S+"),
        (X.strip_tags, r"<[^>]+>"),
    ],
)
def test_guarded_patterns_equal_the_plain_ones(spark, step, pattern):
    rng = random.Random(11)
    alphabet = ["a", "@", "@", ".", ".", " ", " ", "\x1f", "<", ">", "www.", "http://", "é"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 16))) for _ in range(4000)]
    found = run(spark, texts, lambda df: df.withColumn("t", step(F.col("t"))))
    assert found == [re.sub(pattern, " ", t) for t in texts]


def test_to_ascii_is_a_map_of_code_points(spark):
    codes = [c for c in range(0x80, 0x30000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(map(chr, codes[i : i + 64])) for i in range(0, len(codes), 64)]
    single = {
        chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()
        for c in codes
    }
    found = run(spark, texts, lambda df: df.withColumn("t", X.to_ascii(F.col("t"))))
    assert found == ["".join(single[ch] for ch in t) for t in texts]


def test_blank_symbols_keeps_length_and_whitespace(spark):
    texts = ["a€b\u2003c", "x\ty#z", "𝐀𝐀", "plain"]
    found = run(spark, texts, lambda df: df.withColumn("t", X.blank_symbols(F.col("t"))))
    assert found == ["a b c", "x\ty z", "  ", "plain"]


def test_hostile_texts_stay_linear(spark):
    texts = ["<" * 200_000, ">" + "<" * 200_000, "@" * 200_000, "a" * 200_000 + "@", "x@" * 100_000]
    cleaned = run(spark, texts, lambda df: X.clean_text(df, ["t"]))
    assert cleaned[0] == "" and cleaned[3].strip() == "a" * 200_000


def test_words_and_lengths(spark):
    texts = [None, "", "  ", "one", " two\u00a0words ", "a\x1cb\x85c", "𝐀é"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", X.word_count(F.col("t")).alias("w"), X.char_length(F.col("t")).alias("c"))
    assert [r.w for r in found.orderBy("i").collect()] == [len((t or "").split()) for t in texts]
    assert [r.c for r in found.orderBy("i").collect()] == [len(t or "") for t in texts]


def test_blankness(spark):
    texts = [None, "", " \u2003\x1c", "x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.orderBy("i").select(X.is_blank(F.col("t")).alias("b")).collect()
    assert [r.b for r in found] == [True, True, True, False]


def test_tokens_are_stripped_and_filtered(spark):
    text = "\"The Delivery!! 'parcel' was late; ab1c don't naïve"
    rows = spark.createDataFrame([(text,)], "review string")
    from plaudit.operators.rootcause import tokens

    found = [r.word for r in tokens(rows, []).collect()]
    assert found == ["delivery", "parcel", "late", "naïve"]


def test_decomposing_holds_no_copies_of_a_batch():
    texts = ["caf\u00e9 \u00bd " * 4000 for _ in range(100)]
    batch = pa.array([*texts, None, ""])
    tracemalloc.start()
    try:
        found = X.decomposed(batch)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert found.to_pylist() == ["cafe 12 " * 4000] * 100 + [None, ""]
    assert peak < 1.5 * sum(map(len, texts))
