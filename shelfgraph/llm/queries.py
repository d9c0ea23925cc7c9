"""The registered query of each operator, over its whole table with production parameters.

A document without an id has no remainder: op1 and op5 give it a null held_out and don't learn from it, op8 learns from it (held_out false).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.llm import textbytes as tb
from shelfgraph.llm import decontaminate, language, lexical, licenses, lmscore, neardup, packing, quality, repeats, secrets, spellings, tokenfiles, toxicity


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    fold = tb.crc32_of_id() % 3
    model = toxicity.fit(docs, _table(spark, folder, "labels"), may_learn=fold != 1)
    return toxicity.score(docs, model).select(
        "doc_id",
        (fold == 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "evidence",
    )


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality.judge(docs, quality.fit(docs, _table(spark, folder, "labels")))


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = tb.crc32_of_id() % 5 == 0
    found = language.predict(docs, language.fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages", "shares")


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfiles.round_trip(_table(spark, folder, "documents")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.classes(_table(spark, folder, "documents"))


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    model, found = secrets.learn(_table(spark, folder, "documents"))
    return secrets.scan(found, model)


def op8_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(tb.crc32_of_id() % 7 == 2, F.lit(False))
    found = lmscore.score(_table(spark, folder, "documents").withColumn("held_out", held_out))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.labels(_table(spark, folder, "documents"))


def op13_spellings(spark: SparkSession, folder: str) -> DataFrame:
    return spellings.variants(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality": op3_quality,
    "op4_token_files": op4_token_files,
    "op5_language": op5_language,
    "op6_near_dedup": op6_near_dedup,
    "op7_secrets": op7_secrets,
    "op8_lm_scores": op8_lm_scores,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "op11_lexical_search": op11_lexical_search,
    "op12_licenses": op12_licenses,
    "op13_spellings": op13_spellings,
}

#: Every 50-byte string of every text, by its 64-bit hash; spans are islands of starts that lie at most 50 apart.
REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49, 500)) AS base, h FROM d WHERE length(h) >= 100),
p AS (SELECT doc_id, base, substr(h, 2 * base + 1, 1098) AS q FROM c),
w AS (SELECT doc_id, base, q, unnest(range(0, length(q) // 2 - 49)) AS j FROM p),
s AS (SELECT doc_id, base + j AS i, hash(substr(q, 2 * j + 1, 100)) AS b FROM w),
hit AS (SELECT s.doc_id, s.i FROM s JOIN (SELECT b, min(doc_id) AS m FROM s GROUP BY b) USING (b) WHERE m < s.doc_id),
cut AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, -1) AS fresh FROM hit),
numbered AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM cut),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM numbered GROUP BY doc_id, k),
piece AS (
    SELECT doc_id, coalesce(lag(z) OVER o, 0) AS a, a AS z FROM span WINDOW o AS (PARTITION BY doc_id ORDER BY a)
    UNION ALL SELECT doc_id, coalesce(max(z), 0), NULL FROM d LEFT JOIN span USING (doc_id) GROUP BY doc_id),
kept AS (
    SELECT doc_id, string_agg(substr(h, 2 * p.a + 1, coalesce(2 * (p.z - p.a), length(h))), '' ORDER BY p.a, p.z NULLS LAST) AS k
    FROM piece p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST((length(h) - length(k)) // 2 AS BIGINT) AS n_removed,
       CAST((SELECT count(*) FROM span WHERE span.doc_id = d.doc_id) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id)
"""

#: Components of pairs whose multisets of five-word shingles overlap by 0.8, by exact comparison.
NEAR_SQL = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
shingle AS (
    SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS s, count(*) AS n
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0) GROUP BY 1, 2),
size AS (SELECT doc_id, sum(n) AS total FROM shingle GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS shared FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id > b.doc_id GROUP BY 1, 2),
link AS (
    SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE shared >= 0.8 * (x.total + y.total - shared) - 1e-9
    UNION ALL SELECT a.doc_id, b.doc_id FROM words a JOIN words b ON len(a.w) = 0 AND len(b.w) = 0 AND a.doc_id > b.doc_id),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id
"""

#: Every document is scored for every item.
SEARCH_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
item AS (SELECT row_number() OVER () AS q, item_id, text FROM benchmark),
word AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM doc),
asked AS (SELECT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM item),
posting AS (SELECT r, doc_id, t, count(*) AS tf FROM word GROUP BY ALL),
size AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM posting GROUP BY r),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM posting, corpus GROUP BY t, docs),
norm AS (SELECT r, 75 + (25 * n * docs) // terms AS m FROM size, corpus),
scored AS (
    SELECT q, item_id, p.r, p.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM asked JOIN weight USING (t) JOIN posting p USING (t) JOIN norm ON norm.r = p.r GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def _licenses_sql() -> str:
    """Every block of every document is compared with every template."""
    text = lambda v: "'" + v.replace("'", "''") + "'"
    rows, phrases = [], []
    for label, notice in licenses.TEMPLATES:
        ws = licenses.split_words(notice)
        rows.append(f"({text(label)}, {1 << (len(ws) - 1).bit_length()}, [{', '.join(map(text, sorted(set(ws))))}])")
    for phrase, label in licenses.PHRASES:
        parts = phrase.split(" ")
        here = " AND ".join(f"w[i + {k + 1}] = {text(p)}" for k, p in enumerate(parts))
        phrases.append(f"SELECT r, {text(label)} AS label, unnest(list_filter(range(0, len(w)), lambda i: {here})) AS i FROM d")
    return f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents),
template(label, step, tokens) AS (VALUES {", ".join(rows)}),
place AS ({" UNION ALL ".join(phrases)}),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS l FROM place GROUP BY r),
number AS (SELECT r, w, step, unnest(range(0, len(w), step)) AS a FROM d, (SELECT DISTINCT step FROM template)),
block AS (SELECT r, step, a, list_distinct(w[a + 1 : a + 2 * step]) AS b FROM number),
pair AS (SELECT r, step, a, label, len(list_intersect(tokens, b)) / len(tokens) AS c FROM block JOIN template USING (step)),
fit AS (SELECT *, max(c) OVER (PARTITION BY r, step, a) AS top FROM pair WHERE c >= {licenses.CONTAINMENT} - 1e-9),
more AS (SELECT r, list(DISTINCT label) FILTER (WHERE c = top) AS l, max(c) AS best FROM fit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, array_to_string(list_sort(coalesce(base.l, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.l, []), coalesce(more.l, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""


#: Words by a checksum in SQL; near words by equal strings with one code point left out.
SPELLINGS_SQL = r"""
WITH RECURSIVE crc(tab) AS (
    SELECT list(list_reduce(list_concat([x], range(0, 8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) ORDER BY x)
    FROM (SELECT unnest(range(0, 256)) AS x)),
run AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS s
    FROM documents),
counted AS (SELECT id, s, count(*) AS k FROM run WHERE length(s) >= 7 GROUP BY id, s),
bytes AS (
    SELECT id, s, k, flatten(list_transform(string_split(id || ':' || s, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [(192 + (ord(c) >> 6))::BIGINT, (128 + (ord(c) & 63))::BIGINT] END)) AS b
    FROM counted),
hashed AS (
    SELECT s, k, xor(4294967295, list_reduce(list_concat([4294967295], b), lambda a, c: xor(a >> 8, tab[(xor(a, c) & 255) + 1]))) AS h
    FROM bytes, crc),
altered AS (SELECT CASE WHEN h % 31 = 0 THEN s[: h % length(s)] || s[h % length(s) + 2 :] ELSE s END AS word, k FROM hashed),
vocabulary AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM altered WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, i, word[: i] || word[i + 2 :] AS v FROM (SELECT word, unnest(range(0, length(word))) AS i FROM vocabulary)),
pair AS (
    SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word FROM cut a JOIN vocabulary b ON a.v = b.word
    UNION SELECT b.word, a.word FROM cut a JOIN vocabulary b ON a.v = b.word),
near AS (
    SELECT x AS word, count(*) AS n_near, first(y ORDER BY n DESC, encode(y)) AS best, max(n) AS best_n
    FROM pair JOIN vocabulary ON word = y GROUP BY x),
judged AS (
    SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
    FROM vocabulary v LEFT JOIN near USING (word)),
path AS (SELECT word, form AS z FROM judged WHERE form IS NOT NULL UNION ALL SELECT p.word, j.form FROM path p JOIN judged j ON j.word = p.z WHERE j.form IS NOT NULL),
ends AS (SELECT p.word, p.z FROM path p JOIN judged j ON j.word = p.z WHERE j.form IS NULL)
SELECT word, n, CAST(n_near AS BIGINT) AS n_near, form, CAST(form_n AS BIGINT) AS form_n, coalesce(z, word) AS root FROM judged LEFT JOIN ends USING (word)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": REPEATS_SQL,
    "op6_near_dedup": NEAR_SQL,
    "op11_lexical_search": SEARCH_SQL,
    "op12_licenses": _licenses_sql(),
    "op13_spellings": SPELLINGS_SQL,
}
