"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanforge.llm import merkle, pii, secrets
from spanforge.llm.common import documents
from spanforge.llm.decontaminate import leaks
from spanforge.llm.exact_dedup import exact_duplicates
from spanforge.llm.jaccard import similar_components
from spanforge.llm.language import identify
from spanforge.llm.line_dedup import dedup_lines
from spanforge.llm.packing import pack
from spanforge.llm.quality import quality_scores
from spanforge.llm.sharding import shard_by_bytes
from spanforge.llm.spelling import spelling_groups
from spanforge.llm.token_files import document_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_exact_dedup(spark, sf_dir):
    return exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


# A-Z by translate(), as lower() would change other letters too
ORACLES["op6_exact_dedup"] = """
  WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
  SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
         doc_id = max(doc_id) OVER g AS kept, text_sha256
  FROM d WINDOW g AS (PARTITION BY text_sha256)"""


@query
def op2_best_fit_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op8_sampled_splitters(spark, sf_dir):
    return shard_by_bytes(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op1_markov_secrets(spark, sf_dir):
    found = F.col("secrets")
    base = F.filter(found, lambda s: s["kind"] < secrets.RANDOM)
    return secrets.find_secrets(documents(spark, sf_dir)).select(
        "doc_id", *(secrets.count_of(found, k).alias(f"n_{name}") for k, name in enumerate(secrets.BASE)),
        F.sha2(secrets.spans_text(base, secrets.KINDS), 256).alias("base_sha256"),
        secrets.spans_text(found, secrets.KINDS).alias("spans"), secrets.count_of(found, secrets.RANDOM).alias("n_random"))


@query
def op3_count_vector_join(spark, sf_dir):
    return similar_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query
def op10_random_indexing_quality(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(documents(spark, sf_dir), labels).select("doc_id", "held_out", "score", "predicted")


@query
def op4_latent_decontamination(spark, sf_dir):
    found = leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.round("common", 6).alias("common"), F.round("answer", 6).alias("answer"), "word_start", "word_end")


@query
def op5_separator_scan(spark, sf_dir):
    return document_token_counts(spark, documents(spark, sf_dir))


@query
def op7_line_windows(spark, sf_dir):
    return dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", F.size("removed").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))


@query
def op9_disclosure_sanitiser(spark, sf_dir):
    found = F.col("found")
    base = F.filter(found, lambda s: s["kind"] < pii.TERM)
    return pii.find_personal_data(documents(spark, sf_dir)).select(
        "doc_id", *(secrets.count_of(found, k).alias(f"n_{name}") for k, name in enumerate(pii.BASE)),
        F.sha2(secrets.spans_text(base, pii.KINDS), 256).alias("base_sha256"),
        secrets.spans_text(found, pii.KINDS).alias("spans"), secrets.count_of(found, pii.TERM).alias("n_term"))


@query
def op11_spelling_variants(spark, sf_dir):
    return spelling_groups(documents(spark, sf_dir), dropped=97).select("word", "form", "root", "n", "n_near", "form_n")


# UTF-8 bytes of the letters are spelt out, as a crc32 is folded bit by bit; near words share a string with a letter less
ORACLES["op11_spelling_variants"] = """
  WITH RECURSIVE runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents),
  own AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
  hashed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_concat(
               list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':', ''), lambda c: unicode(c)::BIGINT),
               flatten(list_transform(string_split(run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)))),
             lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: xor(c // 2, (c % 2) * 3988292384))), 4294967295) AS h
    FROM own),
  words AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
    FROM hashed GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
  less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS part FROM words, unnest(range(0, length(word))) AS t(i)),
  near AS (
    SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM words a JOIN less b ON b.part = a.word
    UNION SELECT DISTINCT a.word, b.word, b.n FROM less a JOIN words b ON a.part = b.word
    UNION SELECT a.word, b.word, b.n FROM less a JOIN less b ON a.part = b.part AND a.i = b.i AND a.word <> b.word),
  best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
  forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word),
  chain AS (
    SELECT word, word AS at, form AS next FROM forms
    UNION ALL
    SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
  SELECT f.word, form, c.at AS root, n, n_near, form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL"""


@query
def op12_output_codes(spark, sf_dir):
    return identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", F.round("score", 6).alias("score"), "second", "ambiguous")


@query
def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest(documents(spark, sf_dir), changed=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                           altered=F.translate("text", merkle.UPPER, merkle.LOWER))


# a crc32 is folded bit by bit; sha256 gives lower-case hex; a proof is a list of (before, after), lowest first
ORACLES["op13_merkle_manifest"] = """
  WITH RECURSIVE d AS (
    SELECT doc_id, coalesce('=' || source, '') AS grp, text,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
             || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: xor(c // 2, (c % 2) * 3988292384))), 4294967295) % 5 = 0 AS changed
    FROM documents),
  h AS (
    SELECT doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           sha256(head || coalesce(strlen(text) || ':' || CASE WHEN changed
             THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS now FROM d),
  leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM h),
  low AS (
    SELECT 0 AS lvl, grp, pos, n, leaf AS digest FROM leaves
    UNION ALL
    SELECT lvl + 1, grp, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lvl, grp, pos // 16, n),
  subroots AS (SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
  high AS (
    SELECT 0 AS lvl, pos, n, subroot AS digest FROM subroots
    UNION ALL
    SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 16, n),
  steps AS (
    SELECT grp, pos, lvl, digest, coalesce(string_agg(digest, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|'
           || coalesce(string_agg(digest, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS step
    FROM low WHERE n > 1 WINDOW r AS (PARTITION BY grp, lvl, pos // 16 ORDER BY pos)),
  over_steps AS (
    SELECT pos, lvl, coalesce(string_agg(digest, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|'
           || coalesce(string_agg(digest, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS step
    FROM high WHERE n > 1 WINDOW r AS (PARTITION BY lvl, pos // 16 ORDER BY pos)),
  paths AS (
    SELECT l.grp, l.pos, s.lvl, s.step FROM leaves l JOIN steps s ON s.grp = l.grp AND s.pos = l.pos // (16 ** s.lvl)::BIGINT
    UNION ALL
    SELECT l.grp, l.pos, 1000 + s.lvl, s.step FROM leaves l JOIN subroots r ON r.grp = l.grp JOIN over_steps s ON s.pos = r.pos // (16 ** s.lvl)::BIGINT),
  proofs AS (SELECT grp, pos, list(step ORDER BY lvl) AS steps, replace(string_agg(step, '' ORDER BY lvl), '|', '') AS proof FROM paths GROUP BY grp, pos)
  SELECT l.doc_id, l.leaf, r.subroot, t.digest AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
         list_reduce(list_prepend(l.now, coalesce(p.steps, [])), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root,
         folded_root = t.digest AS verified
  FROM leaves l JOIN subroots r ON r.grp = l.grp JOIN (SELECT digest FROM high WHERE n = 1) t ON true
  LEFT JOIN proofs p ON p.grp = l.grp AND p.pos = l.pos"""
