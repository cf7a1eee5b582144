"""The registered queries of the text operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import (
    alignment, bpe, fingerprints, language, lines, lm, mixing, quality_model, quality_rules, repeats, sharding, simhash, spelling,
)
from seriesmill.llm.common import held_out, read, settle

SHARDS, MIX_SEED, SHARD_SEED, ACCEPT = 40, 17, 23, 0.3


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(read(spark, sf_dir, "documents"))
    judged = [quality_rules.fails(quality_rules.BASE).alias("base_failed"), (~quality_rules.fails(quality_rules.STANDARD)).alias("kept")]
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *judged, "failed_bits")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleave(sharding.narrow(read(spark, sf_dir, "documents")), SHARDS, SHARD_SEED)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.with_edits(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.col("sketch").alias("fingerprint"), F.col("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sizes = mixing.settle(mixing.sized(docs, MIX_SEED), "mix")
    cut = mixing.cuts_of(sizes)
    taken = mixing.with_copies(sizes.drop("h"), cut, seed=MIX_SEED)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality_model.document_statistics(read(spark, sf_dir, "documents"))
    learnt = read(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    out = quality_model.scored(stats, quality_model.fit(stats, learnt))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted")
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    counts = settle(lm.word_counts(docs), "lm")
    return lm.score_documents(docs, lm.trained(docs, counts=counts), counts=counts)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = language.learn(docs.filter(~held_out(F.col("doc_id"))))
    out = language.identify(docs, held)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_shared_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    rows = alignment.align_documents(read(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    rows = settle(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"), "aligned")
    return alignment.with_counts(rows, settle(alignment.pair_counts(rows), "aligned"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_suffix_array_dedup, op3_sharding, op4_fingerprints, op5_mixing, op6_simhash_dedup, op7_bpe,
        op8_quality_classifier, op9_lm_scoring, op10_language_id, op11_line_dedup, op12_spelling_variants, op13_token_alignment,
    )
}

ORACLE = {
    "op1_quality_rules": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN c USING (doc_id)),
b AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 4 * n_words)::INT
    + 8 * (10 * n_dup_lines > 5 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 25 * n_words)::INT
    )::BIGINT AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed,
       failed_bits = 0 AS kept, failed_bits
FROM b""",
    "op3_sharding": f"""
WITH k AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h,
         ('0x' || substr(md5(concat_ws(':', '{SHARD_SEED}', doc_id::VARCHAR)), 1, 15))::BIGINT AS o
  FROM documents),
s AS (
  SELECT doc_id, source, o, strlen(text)::BIGINT + 16 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(text) + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))::BIGINT AS text_crc32
  FROM d, k),
f AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY o, doc_id NULLS LAST, size, text_crc32) - 0.5::DOUBLE)
            / count(*) OVER (PARTITION BY source) AS f, count(*) OVER () AS n FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS LAST, o, doc_id NULLS LAST, size, text_crc32) - 1 AS p FROM f),
q AS (SELECT *, p * {SHARDS} // n AS g FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, g::INT AS shard, (p - (g * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot,
       NULL::INT AS grown_shard
FROM q""",
    "op5_mixing": f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', '{MIX_SEED}', doc_id::VARCHAR)), 1, 12))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
o AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS fill FROM s),
v AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY fill, source NULLS LAST) AS rank
  FROM o),
w AS (SELECT level AS water FROM v WHERE fill >= level ORDER BY rank LIMIT 1),
t AS (SELECT source, source_size, least(cap, water * weight) AS target FROM v, w),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.*, source_size, target, whole, target - whole * source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * least(2, whole + (upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own)))::INT))::BIGINT AS taken
FROM c""",
    "op11_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
s AS (SELECT r, doc_id, i, l[i] AS line,
        translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM d)),
c AS (SELECT k, max(doc_id) AS last FROM s WHERE length(k) >= 40 GROUP BY k
      HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 5),
m AS (SELECT s.*, c.k IS NOT NULL AND s.doc_id IS DISTINCT FROM c.last AS gone FROM s LEFT JOIN c ON s.k = c.k)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r""",
    "op12_spelling_variants": r"""
WITH k AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
o AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM documents),
r AS (SELECT doc_id, w, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || w AS s FROM o GROUP BY doc_id, w),
h AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(s) + 1), lambda i: ('0x' || substr(hex(encode(s)), 2 * i - 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))::BIGINT AS h FROM r, k),
v AS (SELECT CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM h),
c AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM c)),
p AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM x a JOIN c b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM x a JOIN c b ON a.rest = b.word),
f AS (
  SELECT c.word, c.n, count(near) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n
  FROM c LEFT JOIN p ON c.word = p.word GROUP BY c.word, c.n),
g AS (SELECT word, n, n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM f),
y AS (SELECT g0.*, coalesce(g0.form, g0.word) AS r1 FROM g g0),
z AS (SELECT y.*, coalesce(g1.form, r1) AS r2 FROM y JOIN g g1 ON g1.word = r1),
u AS (SELECT z.*, coalesce(g2.form, r2) AS r3 FROM z JOIN g g2 ON g2.word = r2),
t AS (SELECT u.*, coalesce(g3.form, r3) AS r4 FROM u JOIN g g3 ON g3.word = r3),
e AS (SELECT t.*, coalesce(g4.form, r4) AS r5 FROM t JOIN g g4 ON g4.word = r4),
q AS (SELECT e.*, coalesce(g5.form, r5) AS r6 FROM e JOIN g g5 ON g5.word = r5)
SELECT word, form, r6 AS root, n, n_near::BIGINT AS n_near, form_n FROM q""",
}
