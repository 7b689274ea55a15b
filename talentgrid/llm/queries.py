"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.llm import ann, bpe, decontaminate, langid, licenses, lm, pieces, setjoin, spellings, substrings, tokenfiles, turns, urlfilter
from talentgrid.llm.staging import new_path

WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontaminate.leaks(docs, benchmark).drop("fp")


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0, k=20)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "text"), new_path(spark, "tokens")
    width = bpe.encoder(vocabulary()).kind().itemsize
    end = b"\x01" + bytes(width - 1)
    encoded = bpe.encode(docs, vocabulary(), packed=True).select("doc_id", F.concat("ids", F.lit(end)).alias("ids"))
    manifest = tokenfiles.write_tokens(encoded, docs.select("doc_id"), folder, width)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            at, flat = x.column(2).offsets.to_numpy(), x.column(2).values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokenfiles.read_tokens(manifest, folder, finish=digest, schema="doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base, method = F.col("phrases.label"), F.col("templates.label")
    at = F.col("phrases.at")
    joined = [F.array_join(F.array_sort(F.array_distinct(x)), ",") for x in (base, F.concat(base, method))]
    score = F.when(F.size(method) > 0, 1.0).when(F.size(base) > 0, 0.5).otherwise(0.0)
    return found.select("doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"), joined[0].alias("base_labels"), joined[1].alias("labels"), score.alias("score"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    langs, products = langid.products(langid.counts(docs.where(part != 2), "lang"))
    rows = langid.predict(docs.select("doc_id", "text"), langs, products)
    return rows.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), width=50)
    words = F.array_join(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
    text = F.when(F.col("removed") > 0, F.col("text")).otherwise(words)
    return kept.select("doc_id", F.col("words").cast("long").alias("n_words"), F.col("removed").cast("long").alias("n_removed"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("kept_sha256"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.similar_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=85)


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    scored = lm.scores(table(spark, sf_dir, "documents").select("doc_id", "text"), training=part != 1)
    return scored.withColumn("held_out", F.coalesce(part == 1, F.lit(False)))


RULES = [urlfilter.Rule.parse(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.audits(turns.damaged(table(spark, sf_dir, "conversations")))


def op12_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`covered` is the number of bytes of the text that the pieces span."""
    decoded = pieces.round_trip(table(spark, sf_dir, "documents"), piece_model())
    covered = F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0), lambda s, x: s + x).cast("long")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"), covered.alias("covered"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = spellings.word_counts(table(spark, sf_dir, "documents"), damage=97)
    return spellings.variants(counted.where((F.char_length("word") >= 5) & (F.col("n") >= 3)))


QUERIES = {"op1_benchmark_leaks": op1_benchmark_leaks, "op2_nearest_vectors": op2_nearest_vectors, "op10_url_filter": op10_url_filter, "op4_license_scan": op4_license_scan, "op6_language_id": op6_language_id, "op9_lm_scores": op9_lm_scores, "op3_token_files": op3_token_files, "op5_bpe_round_trip": op5_bpe_round_trip, "op8_ngram_jaccard": op8_ngram_jaccard, "op7_substring_dedup": op7_substring_dedup, "op11_conversation_repair": op11_conversation_repair, "op12_piece_round_trip": op12_piece_round_trip, "op13_spelling_variants": op13_spelling_variants}
#: Queries that SQL can express; the others are held against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op7_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        win AS (
            SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS k
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50) AS s),
        first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (k) WHERE doc_id > m),
        g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(array_to_string(
            list_filter(w, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' ')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)""",
    "op8_ngram_jaccard": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0) AS x),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (
            SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s AS p JOIN s AS q ON p.g = q.g
            WHERE p.doc_id <> q.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM shared JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
            WHERE 100 * c >= 85 * (x.n + y.n - c)),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id""",
}
