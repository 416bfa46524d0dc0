"""The operators over their whole tables, one query each, and the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm import chat, jaccard, language, licenses, media, mixing, pieces, quality, records, urls
from flowgauge.llm.common import read_table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2
#: Target weights of the mixture; other sources have weight 1.
WEIGHTS = {"src0": 2.0, "src1": 1.5, "src2": 0.5}
SEED = 20240229
#: Files of the license scan: twenty documents a directory, twenty directories above, each level with a licence file.
FILES = """SELECT doc_id, CASE WHEN doc_id % 400 = 0 THEN concat('lib', {a}, '/LICENSE')
  WHEN doc_id % 20 = 0 THEN concat('lib', {a}, '/part', {b}, '/LICENSE.txt') ELSE concat('lib', {a}, '/part', {b}, '/doc', doc_id, '.txt') END AS path, text FROM {t}"""
#: Redirects for the url filter, as the pages have none: each page whose id leaves 1, 2 or 3 by five moved to the page before it.
MOVED = "SELECT a.url AS url, b.url AS target FROM {pages} a JOIN {pages} b ON a.page_id = b.page_id + 1 WHERE a.page_id % 5 IN (1, 2, 3)"
SAID = r"\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)], "conv_id long, turn long, role string, text string")
    record = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})
    turns = chat.canonical_turns(rows.unionByName(added).select("conv_id", "turn", record.alias("record")))
    return chat.digests(chat.format_turns(turns))


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mixing.mix(docs, WEIGHTS, seed=SEED).select("doc_id", "source", "copy", "order_key", "text")


def op3_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(read_table(spark, sf_dir, "documents"), BYTE_BPE, END_ID)


def op4_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``verdict`` by the links of the pages; ``moved_verdict`` with the redirects of MOVED, too."""
    pages = read_table(spark, sf_dir, "pages")
    edges = urls.alias_edges(urls.link_edges(pages))
    moved = urls.alias_edges(spark.sql(MOVED, pages=pages), edges)
    rows = urls.decide(urls.ruled(pages, urls.RULES), urls.RULES, edges)
    return urls.decide(rows, urls.RULES, moved, "moved_verdict").select("page_id", "host", "path", "rule", "verdict", "moved_verdict")


def op5_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.store_texts(read_table(spark, sf_dir, "documents")))


def op6_license_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    spark_sql = FILES.format(a="doc_id div 400", b="(doc_id div 20) % 20", t="{docs}")
    files = spark.sql(spark_sql, docs=docs)
    return licenses.scan(files, carry=["doc_id"])


def op7_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op8_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(read_table(spark, sf_dir, "documents"), PIECES)


def op9_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_components(read_table(spark, sf_dir, "documents"), 3, 90)


def op10_language_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out("doc_id")), PIECES)
    found = language.identify(docs, model, PIECES)
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_chat_formatting, op2_poisson_mixing, op3_binary_records, op4_redirect_equivalence, op5_signature_sniffing, op6_license_tfidf, op7_quality_trees, op8_nbest_pieces, op9_prefix_tree_join, op10_language_unigrams]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    said = f"(-7, 0, 'user', '{SAID}'), (-7, 1, 'assistant', '{SAID}')"
    return {
        "op1_chat_formatting": chat.oracle(f"SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES {said}"),
        "op5_signature_sniffing": media.oracle(),
        "op2_poisson_mixing": f"WITH mixed AS ({mixing.oracle(WEIGHTS, SEED)}) SELECT m.*, d.text FROM mixed m JOIN documents d USING (doc_id)",
        "op4_redirect_equivalence": urls.oracle(urls.RULES, MOVED.format(pages="pages")),
        "op6_license_tfidf": licenses.oracle(licenses.Model(), FILES.format(a="doc_id // 400", b="(doc_id // 20) % 20", t="documents")),
        "op9_prefix_tree_join": OP9_SQL,
    }


#: All pairs that share a shingle, checked in full, and a walk over the links.
OP9_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes s ON x = s.doc_id JOIN sizes t ON y = t.doc_id WHERE 100 * o >= 90 * (s.n + t.n - o)),
reach(x, y) AS (SELECT x, x FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(y) AS m FROM reach GROUP BY 1)
SELECT words.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, words.doc_id) AS component_id
FROM words LEFT JOIN sizes ON words.doc_id = sizes.doc_id LEFT JOIN least ON words.doc_id = least.x"""
