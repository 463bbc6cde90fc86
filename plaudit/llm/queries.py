"""The registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plaudit.llm import (
    codebooks, context_mixing, decontaminate, exact_dedup, html_text, jaccard_join, licenses, line_dedup, packing,
    pseudonyms, quality, token_files, whitening,
)
from plaudit.llm.rows import fold, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
# A deployment passes its own secret; this one makes results repeatable.
PASSPHRASE = "example passphrase"


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


@query
def op1_decontaminate(spark, folder):
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op2_line_dedup(spark, folder):
    docs = table(spark, folder, "documents")
    index = line_dedup.build_index(docs)
    return line_dedup.drop_repeated_lines(docs, index).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


@query
def op3_pseudonyms(spark, folder):
    found = pseudonyms.pseudonymise(table(spark, folder, "documents"), pseudonyms.key_of(PASSPHRASE))
    return found.select("doc_id", "text", F.size("spans").cast("long").alias("n_replaced"), "spans")


@query
def op4_quality(spark, folder):
    docs = table(spark, folder, "documents")
    weights = quality.train(docs, table(spark, folder, "labels"))
    scored = quality.score_quality(docs.select("doc_id", "text"), weights)
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), quality.FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op5_html_text(spark, folder):
    return html_text.extract_text(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op6_pack(spark, folder):
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op7_licenses(spark, folder):
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    best = F.try_element_at("licenses", F.lit(1))
    return found.select(
        "doc_id", best["name"].alias("license"), best["coverage"].alias("coverage"),
        F.size("licenses").cast("long").alias("n_licenses"), "licenses",
    )


@query
def op8_exact_dedup(spark, folder):
    return exact_dedup.exact_dedup(table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


@query
def op9_jaccard_groups(spark, folder):
    return jaccard_join.jaccard_groups(table(spark, folder, "documents"))


@query
def op10_context_mixing(spark, folder):
    return context_mixing.score_documents(table(spark, folder, "documents"))


@query
def op11_token_files(spark, folder):
    return token_files.token_files(table(spark, folder, "documents"), public_tokenizers.path(BYTE_TOKENIZER))


@query
def op12_vector_codes(spark, folder):
    coded, books = codebooks.compress(table(spark, folder, "embeddings"))
    return codebooks.with_label_errors(coded).select(
        "vec_id", codebooks.hex_codes().alias("code"), "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256")
    )


@query
def op13_whitening(spark, folder):
    rows = table(spark, folder, "embeddings")
    return whitening.whiten(rows, whitening.fit_whitening(rows))


ORACLES["op1_decontaminate"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') AS run
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM items WHERE len(w) > 0)),
runs AS (
  SELECT doc_id, size, i, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') AS run
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
hits AS (SELECT runs.doc_id, runs.i, runs.size, windows.item_id FROM runs JOIN windows USING (size, run)),
hit_words AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit_words.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(named.items, '')) AS items_sha256, coalesce(hit_words.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLES["op2_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
  FROM documents),
keyed AS (
  SELECT doc_id, place, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split),
hot AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (
  SELECT keyed.*, hot.key IS NOT NULL AS gone FROM keyed LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLES["op8_exact_dedup"] = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents),
best AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM rows)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM best
"""

ORACLES["op9_jaccard_groups"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
items AS (SELECT doc_id, unnest(s) AS item FROM sets),
shared AS (SELECT item FROM items GROUP BY item HAVING count(*) > 1),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM (SELECT * FROM items SEMI JOIN shared USING (item)) a
  JOIN (SELECT * FROM items SEMI JOIN shared USING (item)) b ON a.item = b.item AND a.doc_id <> b.doc_id
  GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
  WHERE 100 * n >= 90 * (len(a.s) + len(b.s) - n)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(y) FROM reach WHERE x = doc_id) AS component_id FROM sets
"""


def _codes_sql(rounds: int = codebooks.ROUNDS) -> str:
    """k-means spelled out: nearest entries, then means, round by round."""
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""
near{t} AS MATERIALIZED (
  SELECT vec_id, part, x, min(d) AS d, min(d * 256 + entry) % 256 AS entry
  FROM (SELECT p.vec_id, p.part, p.x, b.entry,
               list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.x, b.v)])::BIGINT AS d
        FROM parts p JOIN book{t} b ON p.part = b.part)
  GROUP BY vec_id, part, x)""")
        if t < rounds:
            steps.append(f"""
book{t + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v
  FROM book{t} b LEFT JOIN (
    SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY i) AS v
    FROM (SELECT part, entry, i, sum(x[i])::DOUBLE AS s, count(*) AS n
          FROM near{t}, (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM parts))) AS i) GROUP BY part, entry, i)
    GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [floor(1024 * c::DOUBLE)::BIGINT FOR c IN embedding] AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, part, x[part * (len(x) // 4) + 1:(part + 1) * (len(x) // 4)] AS x FROM kept, range(4) t(part)),
book0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS v
  FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)),
{",".join(steps)},
books AS (SELECT sha256(string_agg(c, ',' ORDER BY part, entry)) AS digest
          FROM (SELECT part, entry, array_to_string(v, ',') AS c FROM book{rounds})),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM near{rounds} JOIN kept USING (vec_id) GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256
FROM coded, books
"""


ORACLES["op12_vector_codes"] = _codes_sql()
