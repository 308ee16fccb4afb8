"""The queries opN_<name> over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, language, licenses, lm, media, merkle, pieces, quality, toxicity, warc, whitening
from ._store import fold_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """The path of the vocabulary; a parameter of the operator, found here for the queries."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model())


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths, so each gets one: its source, two levels of folders by doc_id, and its doc_id."""
    group = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), group(512), group(64), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.filter(fold_of("doc_id", 4) != 2))
    return language.predict(docs.select("doc_id", "text"), model)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"), keep=fold_of("doc_id", 4) != 2))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.texts_as_media(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.events_of_turns(turns.unionByName(more)), "place")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors, whitening.train(vectors))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_ngram_jaccard, op3_decontaminate, op4_sentencepiece, op5_licenses, op6_lm_score, op7_language, op8_quality, op9_media, op10_chat, op11_whitening, op12_merkle, op13_warc)}

SQL = {
    "op10_chat": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' ELSE '"' || role || '"' END || ':' || chr(10))
    + length(regexp_replace(text, '(\\*)(###|</turn>)', '\1\1\\\2', 'g')) + 9) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
""",
    "op12_merkle": r"""
WITH RECURSIVE crcs AS (
  SELECT doc_id, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS UBIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[])),
      lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS UBIGINT)) ELSE x >> 1 END), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) AS crc
  FROM documents WHERE doc_id IS NOT NULL
), marked AS (
  SELECT documents.*, crc IS NOT NULL AND crc % 7 = 0 AS hit FROM documents LEFT JOIN (SELECT DISTINCT * FROM crcs) c USING (doc_id)
), hashed AS (
  SELECT doc_id, lang, hit, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || body) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || body) AS changed
  FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body FROM marked)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed
), up AS (
  SELECT lang, 0 AS level, place, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL
  SELECT lang, any_value(level) + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, place // 2
), tops AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place FROM up WHERE n = 1
), forest AS (
  SELECT 0 AS level, place, subroot AS node, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT any_value(level) + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 1) // 2 FROM forest WHERE n > 1 GROUP BY place // 2
), steps AS (
  SELECT p.lang, p.place AS leaf_place, u.level, u.node, u.place < (p.place >> u.level) AS is_left
  FROM placed p JOIN up u ON u.lang IS NOT DISTINCT FROM p.lang AND u.place = xor(p.place >> u.level, 1)
), forest_steps AS (
  SELECT t.lang, 1000 + f.level AS level, f.node, f.place < (t.place >> f.level) AS is_left FROM tops t JOIN forest f ON f.place = xor(t.place >> f.level, 1)
), depths AS (
  SELECT lang, max(level) AS depth FROM up GROUP BY lang
), numbered AS (
  SELECT p.lang, p.place AS leaf_place, k.level AS level, s.node, s.is_left
  FROM placed p JOIN depths d ON d.lang IS NOT DISTINCT FROM p.lang, LATERAL (SELECT unnest(range(d.depth)) AS level) k
  LEFT JOIN steps s ON s.lang IS NOT DISTINCT FROM p.lang AND s.leaf_place = p.place AND s.level = k.level
  UNION ALL
  SELECT p.lang, p.place, 1000 + k.level, f.node, f.is_left
  FROM placed p, (SELECT unnest(range((SELECT max(level) FROM forest))) AS level) k
  LEFT JOIN forest_steps f ON f.lang IS NOT DISTINCT FROM p.lang AND f.level = 1000 + k.level
), paths AS (
  SELECT lang, leaf_place, sha256(coalesce(string_agg(node, '' ORDER BY level), '')) AS proof, list({'node': node, 'is_left': is_left} ORDER BY level) AS path FROM numbered GROUP BY lang, leaf_place
), whole AS (
  SELECT p.*, subroot, (SELECT node FROM forest WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256, path
  FROM placed p JOIN tops t ON t.lang IS NOT DISTINCT FROM p.lang LEFT JOIN paths s ON s.lang IS NOT DISTINCT FROM p.lang AND s.leaf_place = p.place
), fold AS (
  SELECT lang, place, 0 AS k, CASE WHEN hit THEN changed ELSE leaf END AS node, path FROM whole
  UNION ALL
  SELECT lang, place, k + 1, sha256(CASE WHEN path[k + 1].node IS NULL THEN node WHEN path[k + 1].is_left THEN path[k + 1].node || node ELSE node || path[k + 1].node END), path
  FROM fold WHERE k < coalesce(len(path), 0)
)
SELECT w.doc_id, w.leaf, w.subroot, w.root, w.proof_sha256, f.node AS folded_root, f.node = w.root AS verified
FROM whole w JOIN fold f ON f.lang IS NOT DISTINCT FROM w.lang AND f.place = w.place AND f.k = coalesce(len(w.path), 0)
""",
    "op13_warc": """
WITH bodies AS (SELECT page_id, url, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS size FROM pages),
equal AS (SELECT body, max(page_id) AS first FROM bodies WHERE size >= 1000 GROUP BY body)
SELECT page_id, size AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN first <> page_id OR (first IS NOT NULL AND page_id IS NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id OR (first IS NOT NULL AND page_id IS NULL) THEN first END AS refers_to
FROM bodies LEFT JOIN equal USING (body)
""",
}
