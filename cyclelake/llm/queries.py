"""The registered query of each operator, with production parameters over whole tables, and its SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cyclelake.llm import bpe, collocations, decontaminate, language, periodic, pii, quality, repeats, sharding, simhash, suffix_tree, topk, toxicity
from cyclelake.llm.common import fold, stored, table

VOCABULARY = "word_bpe_49k.json"
THRESHOLD = 0.3  # of the quality and toxicity scores
REPEATED_BYTES = 400  # length of the strings whose repeats go
QUERY_STEP = 100  # vectors whose id is divisible by this are the queries


def op1_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = table(spark, folder, "documents"), fold(F.col("doc_id"), 10) == 0
    scored = suffix_tree.score(docs, suffix_tree.fit(docs, ~held_out), ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = table(spark, folder, "documents"), fold(F.col("doc_id"), 5) == 0
    weights = quality.fit(docs, table(spark, folder, "labels"), ~held_out)
    scored = quality.score(docs, weights, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shuffle_shards(table(spark, folder, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number", "position",
    )


def op4_simhash_segments(spark: SparkSession, folder: str) -> DataFrame:
    prints = stored(simhash.fingerprints(table(spark, folder, "documents"), keep=["doc_id"]))
    found = simhash.near_duplicates(prints)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op5_toxic_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 4) == 2
    model, counted = toxicity.fit(table(spark, folder, "documents"), table(spark, folder, "labels"), ~held_out)
    scored = toxicity.score(counted, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def op6_boosted_pii(spark: SparkSession, folder: str) -> DataFrame:
    scanned = stored(pii.scan(table(spark, folder, "documents"), ["doc_id"]))
    found = pii.select(scanned, pii.fit(scanned), ["doc_id"])
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op8_language_evidence(spark: SparkSession, folder: str) -> DataFrame:
    languages, logs = language.fit(table(spark, folder, "documents"))
    return language.fuse(language.read_pages(table(spark, folder, "pages"), logs), languages)


def op9_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = topk.exact_topk(table(spark, folder, "embeddings"), F.col("id") % QUERY_STEP == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_edit_matches(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.summary(table(spark, folder, "documents"), changed=periodic.planted)


def op13_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, folder, "documents"), threshold=REPEATED_BYTES)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "stops")


OP9_SQL = f"""
WITH usable AS (
    SELECT vec_id, row_number() OVER () AS row,
           list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS terms
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.row AS query_row, q.vec_id AS query_id, c.vec_id,
           CAST(list_inner_product(q.terms, c.terms) AS BIGINT) AS score
    FROM usable q JOIN usable c ON c.row <> q.row
    WHERE q.vec_id % {QUERY_STEP} = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP11_SQL = r"""
WITH pieces AS (
    SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^ \t]+') AS words
    FROM (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    )
), one AS (
    SELECT lang, word, count(*) AS f FROM (SELECT lang, unnest(words) AS word FROM pieces) GROUP BY ALL
), sizes AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang
), two AS (
    SELECT lang, p.a, p.b, count(*) AS f
    FROM (SELECT lang, unnest(list_transform(range(1, len(words)), lambda i: {'a': words[i], 'b': words[i + 1]})) AS p FROM pieces)
    GROUP BY ALL HAVING count(*) >= 10
), three AS (
    SELECT lang, p.a, p.b, p.c, count(*) AS f
    FROM (SELECT lang, unnest(list_transform(range(1, len(words) - 1), lambda i: {'a': words[i], 'b': words[i + 1], 'c': words[i + 2]})) AS p FROM pieces)
    GROUP BY ALL HAVING count(*) >= 10
), around AS (
    SELECT lang, a, b, max(f) AS f
    FROM (SELECT lang, a, b, f FROM three UNION ALL SELECT lang, b, c, f FROM three)
    GROUP BY ALL
), cuts AS (
    SELECT t.lang, t.a || ' ' || t.b AS phrase, 1 AS k, t.f AS a, x.f AS l, y.f AS r
    FROM two t JOIN one x ON x.lang = t.lang AND x.word = t.a JOIN one y ON y.lang = t.lang AND y.word = t.b
    LEFT JOIN around w ON w.lang = t.lang AND w.a = t.a AND w.b = t.b
    WHERE w.f IS NULL OR 100 * w.f < 50 * t.f
    UNION ALL
    SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, 1, t.f, x.f, y.f
    FROM three t JOIN one x ON x.lang = t.lang AND x.word = t.a JOIN two y ON y.lang = t.lang AND y.a = t.b AND y.b = t.c
    UNION ALL
    SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, 2, t.f, x.f, y.f
    FROM three t JOIN two x ON x.lang = t.lang AND x.a = t.a AND x.b = t.b JOIN one y ON y.lang = t.lang AND y.word = t.c
), scored AS (
    SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_quality": op2_quality,
    "op3_feistel_shards": op3_feistel_shards,
    "op4_simhash_segments": op4_simhash_segments,
    "op5_toxic_neighbours": op5_toxic_neighbours,
    "op6_boosted_pii": op6_boosted_pii,
    "op7_bpe": op7_bpe,
    "op8_language_evidence": op8_language_evidence,
    "op9_exact_topk": op9_exact_topk,
    "op10_edit_matches": op10_edit_matches,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_repeated_bytes": op13_repeated_bytes,
}
ORACLE_SQL: dict[str, str] = {"op9_exact_topk": OP9_SQL, "op11_collocations": OP11_SQL}
