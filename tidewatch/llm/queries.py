"""The queries opN_<name> over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from . import bpe, knn_dedup, lang_id, line_dedup, mixing, near_dup, quality, spotsigs, token_store, toxicity


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(c.documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(c.documents(spark, sf_dir, "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(c.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.documents(spark, sf_dir, "doc_id", "text", "lang")
    return lang_id.label_documents(docs, lang_id.learn(docs)).select("doc_id", c.held_out(*lang_id.HELD).alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(c.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.store_folder(spark)
    manifest = token_store.write_store(c.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_store.read_store(spark, manifest)


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edits(c.documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(c.documents(spark, sf_dir))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_gone"), "gone", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(c.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


#: The smallest node that each node of ln(a, b), links both ways, reaches: each round adds what one more link reaches.
REACH = "rc(node, other) AS (SELECT DISTINCT a, a FROM ln UNION SELECT rc.node, ln.b FROM rc JOIN ln ON ln.a = rc.other), cm AS (SELECT node, min(other) AS comp FROM rc GROUP BY node)"
SHINGLES = r"""wd AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM wd), sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id), ln AS (SELECT a, b FROM pr JOIN sz p ON p.doc_id = a JOIN sz q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k))"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that plain SQL can state (all pairs, so for small tables). The others are trained, apportioned, tokenised or near-matched; tests hold those against plain recomputations."""
    return {
        "op1_near_dup": f"WITH RECURSIVE {SHINGLES}, {REACH} SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(comp, doc_id) AS component_id, coalesce(comp, doc_id) = doc_id AS kept FROM documents LEFT JOIN sz USING (doc_id) LEFT JOIN cm ON node = doc_id",
        "op9_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), ln AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9), {REACH}
 SELECT vec_id, (SELECT count(*) FROM ln WHERE a = vec_id) AS n_links, coalesce(comp, vec_id) AS component_id, coalesce(comp, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN cm ON node = vec_id""",
    }
