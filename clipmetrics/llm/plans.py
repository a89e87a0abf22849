"""Registered queries of the corpus operators, each over its whole table, with SQL counterparts where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmetrics.llm import (
    bins, collocations, exact, lexical, mixing, neighbours, quality, quotes, simhash, substrings, threshold, toxicity, variants,
)
from clipmetrics.llm.labels import fold
from clipmetrics.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("id"), 3) != 1)
    return toxicity.with_score(docs.select("doc_id", "text"), scorer).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = quality.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("id"), 5) != 0)
    return quality.with_score(docs.select("doc_id", "text"), network).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_classes(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


OP6_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.pack_binary(table(spark, sf_dir, "documents"))


def op9_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(quotes.linked_messages(table(spark, sf_dir, "conversations")))


OP9_SQL = r"""
WITH RECURSIVE m AS (
  SELECT *, row_number() OVER (ORDER BY conv_id, turn, role, text) AS mid FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), split AS (SELECT *, string_split_regex(coalesce(text, ''), '\r?\n') AS parts FROM m
), raw AS (SELECT mid, conv_id, turn, unnest(parts) AS line, generate_subscripts(parts, 1) AS no FROM split
), lines AS (
  SELECT mid, conv_id, turn, no, length(regexp_replace(regexp_extract(line, '^\s*(?:>\s?)+'), '[^>]', '', 'g')) AS level,
    regexp_replace(line, '^\s*(?:>\s?)+', '') AS body FROM raw
  WHERE regexp_matches(line, '^\s*>') OR NOT regexp_matches(line, '(?i)^\s*on\b.{1,200}\bwrote:\s*$')
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY mid ORDER BY no) - row_number() OVER (PARTITION BY mid, level ORDER BY no) AS run FROM lines
), pieces AS (
  SELECT DISTINCT mid, conv_id, turn, level, whole, trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g')) AS said FROM (
    SELECT mid, conv_id, turn, level, true AS whole, string_agg(body, chr(10) ORDER BY no) AS body FROM marked GROUP BY mid, conv_id, turn, level, run
    UNION ALL SELECT mid, conv_id, turn, level, false, body FROM lines)
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), inside AS (SELECT conv_id, said, min((turn, mid)) AS place FROM pieces WHERE level = 0 AND said <> '' GROUP BY conv_id, said
), anywhere AS (SELECT said, min((conv_id, turn, mid)) AS place FROM pieces WHERE level = 0 AND said <> '' GROUP BY said
), found AS (
  SELECT q.mid, q.said, q.whole, q.level, i.place[1] < q.turn AS near,
    CASE WHEN i.place[1] < q.turn THEN (q.conv_id, i.place[1], i.place[2]) WHEN a.place[1] < q.conv_id THEN a.place END AS original
  FROM (SELECT * FROM pieces WHERE level > 0 AND said <> '') q LEFT JOIN inside i USING (conv_id, said) LEFT JOIN anywhere a ON a.said = q.said
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY mid ORDER BY coalesce(near, false) DESC, whole DESC, level, original DESC) AS k FROM found WHERE original IS NOT NULL
), replies AS (SELECT mid, original[1] AS p_conv, original[2] AS p_turn, original[3] AS p_mid FROM ranked WHERE k = 1
), walk AS (
  SELECT mid, p_conv AS root, p_mid AS up, 1 AS depth FROM replies
  UNION ALL SELECT w.mid, r.p_conv, r.p_mid, w.depth + 1 FROM walk w JOIN replies r ON r.mid = w.up
), roots AS (SELECT mid, arg_max(root, depth) AS root FROM walk GROUP BY mid
), rows AS (
  SELECT m.*, coalesce(t.root, m.conv_id) AS thread_conv, r.p_turn,
    '[' || coalesce(role, 'unknown') || ']' || CASE WHEN r.mid IS NULL THEN '' ELSE ' @' || r.p_conv || ':' || r.p_turn END || chr(10)
      || regexp_replace(trim(coalesce((SELECT string_agg(body, chr(10) ORDER BY no) FROM lines l WHERE l.mid = m.mid AND level = 0), '')), '\n{3,}', chr(10) || chr(10), 'g') AS line
  FROM m LEFT JOIN replies r USING (mid) LEFT JOIN roots t USING (mid)
)
SELECT thread_conv, conv_id, coalesce(cast(floor(turn / 64) AS bigint), 0) AS segment, count(*) AS n_messages, count(p_turn) AS n_replies,
  string_agg(line, chr(10) || chr(10) ORDER BY turn NULLS LAST, coalesce(role, ''), line) AS chat
FROM rows GROUP BY thread_conv, conv_id, coalesce(cast(floor(turn / 64) AS bigint), 0), CASE WHEN conv_id IS NULL OR turn IS NULL THEN mid END
"""


def op10_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(lexical.pack_lexical(table(spark, sf_dir, "documents")))


def pieces(packed: DataFrame) -> DataFrame:
    """Packed pieces with a checksum in place of their ids."""
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM p
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
    FROM w, (SELECT unnest(range(1, 6)) AS k) ks WHERE len(ws) >= k)
  GROUP BY lang, k, phrase
), n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k > 1 AND f >= 100
), cuts AS (
  SELECT c.*, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:k], ' ') AS tail
  FROM c, (SELECT unnest(range(1, 5)) AS j) js WHERE j < k
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, j, h.f AS l, t.f AS r, n.n, (1000::HUGEINT * cuts.a * n.n) // (h.f::HUGEINT * t.f) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail JOIN n ON n.lang = cuts.lang
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), around AS (
  SELECT DISTINCT c.lang, array_to_string(ws[s:s + m - 1], ' ') AS inside, a
  FROM c, (SELECT unnest(range(2, 5)) AS m) ms, (SELECT unnest(range(1, 5)) AS s) ss WHERE m < k AND s + m - 1 <= k
), kept AS (SELECT * FROM lowest x WHERE NOT EXISTS (
  SELECT 1 FROM around y WHERE y.lang = x.lang AND y.inside = x.phrase AND 100 * y.a >= 100 * x.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS i))
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), seen AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
), bytes AS (
  SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda ch:
    CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [192 + unicode(ch) // 64, 128 + unicode(ch) % 64] END)) AS b FROM seen
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], b::BIGINT[]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h
  FROM bytes, t
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), cut AS (SELECT word, n, i, left(word, i - 1) AS l, substr(word, i + 1) AS r FROM places
), near AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.l = b.l AND a.r = b.r WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.l || a.r = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.l || a.r = b.word
), best AS (
  SELECT word, near, n, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, near) = 1
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 10 * w.n THEN b.near END AS form,
    CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n FROM words w LEFT JOIN best b USING (word)
), walk AS (
  SELECT word, word AS at FROM forms UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk w ON w.word = f.word JOIN forms e ON e.word = w.at WHERE e.form IS NULL
"""


def op13_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, repeats=True)


OP13_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) AS rank,
  c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_multiprobe_neighbours": op2_multiprobe_neighbours,
        "op3_source_mix": op3_source_mix,
        "op4_toxicity": op4_toxicity,
        "op5_quality": op5_quality,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_simhash": op7_simhash,
        "op8_token_packing": op8_token_packing,
        "op9_quote_linking": op9_quote_linking,
        "op10_lexical_packing": op10_lexical_packing,
        "op11_collocations": op11_collocations,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_threshold_search": op13_threshold_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": OP6_SQL,
        "op9_quote_linking": OP9_SQL,
        "op11_collocations": OP11_SQL,
        "op12_spelling_variants": OP12_SQL,
        "op13_threshold_search": OP13_SQL,
    }
