"""The registered queries of the numbered operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _vocab(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), _vocab("byte_bpe_50k.json"), width=1024)


def op2_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score(_read(spark, sf_dir, "documents"), held_out)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfiles import read_token_files, write_token_files

    return read_token_files(spark, *write_token_files(_read(spark, sf_dir, "documents"), _vocab("word_bpe_49k.json"), end_id=1))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats

    rows = remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), width=400)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score, train

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = train(docs, _read(spark, sf_dir, "labels").where(remainder != 1))
    return score(docs, model).select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import rendezvous, shard

    seed = 17
    rows = shard(_read(spark, sf_dir, "documents"), shards=8, seed=seed)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return rows.select("doc_id", "size", crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", rendezvous(F.col("doc_id"), 9, seed).alias("grown_shard"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contained

    found = contained(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), words=5, percent=80)
    return found.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    rows = remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), width=20)
    words = F.regexp_replace(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " "), "^ | $", "")
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(words.cast("binary"), 256).alias("kept_sha256"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(_read(spark, sf_dir, "documents"), longest=3, least=10, covered=50, top=2000)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = train(docs, _read(spark, sf_dir, "labels").where(remainder != 0))
    return score(docs, model).select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filteraudit import audit, failures

    return audit(failures(_read(spark, sf_dir, "documents"), "source", _read(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_pivots": op2_pivots,
    "op3_lm": op3_lm,
    "op4_token_files": op4_token_files,
    "op5_suffixes": op5_suffixes,
    "op6_minhash": op6_minhash,
    "op7_quality": op7_quality,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_substrings": op10_substrings,
    "op11_phrases": op11_phrases,
    "op12_toxicity": op12_toxicity,
    "op13_filter_audit": op13_filter_audit,
}

_OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), spots AS (
  SELECT lang, p, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM words
), triples AS (
  SELECT lang, w1, lead(w1, 1) OVER one AS w2, lead(w1, 2) OVER one AS w3 FROM spots WINDOW one AS (PARTITION BY p ORDER BY i)
), grams AS MATERIALIZED (
  SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM triples GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM triples WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM triples WHERE w3 IS NOT NULL GROUP BY ALL
), candidates AS (
  SELECT lang, k AS words, phrase, string_split(phrase, ' ') AS w, f AS a FROM grams WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT lang, words, phrase, w, a, c FROM candidates, (SELECT unnest([1, 2]) AS c) WHERE c < words
), scored AS (
  SELECT cuts.*, x.f AS l, y.f AS r, CAST((1000000 :: HUGEINT * a * a) // (x.f :: HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN grams x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:c], ' ') JOIN grams y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[c + 1:], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inner_phrases AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer FROM candidates WHERE words = 3
), around AS (
  SELECT lang, phrase, max(longer) AS longer FROM inner_phrases GROUP BY ALL
), kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN around USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
), total AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""

_OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), said AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM d LEFT JOIN said USING (doc_id)
), grouped AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY ALL
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)
), applied AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN translate(fails, before || f, '') = fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM grouped, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM applied
"""

ORACLE_SQL: dict[str, str] = {"op11_phrases": _OP11_SQL, "op13_filter_audit": _OP13_SQL}
