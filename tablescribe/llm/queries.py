"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, contamination, exact, html, language, packing, simhash, tokens, toxicity, trie, warc
from .common import crc_remainder, small, table

TOKENS_MODEL = "piece_bpe_32k.model"
PACKING_MODEL = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
LABELS = 1_000_000  # labels are broadcast up to so many, and joined by shuffling the labelled texts beyond


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html.extract(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf, "documents").select("doc_id", "text"), tokenizer(TOKENS_MODEL))


def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("held_out", F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)))
    found = language.identify(docs.select("doc_id", "held_out", "text"), language.train(docs.filter("NOT held_out")))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    found = warc.archive_round_trip(table(spark, sf, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False)))
    labels = small(table(spark, sf, "labels").select("doc_id", "toxic"), LABELS)
    labelled = docs.filter("NOT held_out").join(labels, "doc_id")
    return toxicity.score(docs, toxicity.train(labelled)).select("doc_id", "held_out", "score", "predicted")


def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op7_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    return chat.read_formatted(chat.format_conversations(chat.with_marks(table(spark, sf, "conversations"))))


def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf, "documents"))


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), tokenizer(PACKING_MODEL))


def op11_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    found = bpe.bpe_round_trip(table(spark, sf, "documents"), tokenizer(RANKS), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf, "conversations"))


def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    found = alignment.align(table(spark, sf, "documents"), tokenizer(PACKING_MODEL), tokenizer(TOKENS_MODEL))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return found.select("doc_id", *alignment.NUMBERS, digest)


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_token_counts, op3_language_id, op4_warc, op5_toxicity, op6_simhash, op7_chat_formatting, op8_exact_dedup, op9_decontamination, op10_packing, op11_byte_bpe, op12_prefix_trie, op13_token_alignment, pipeline)}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGEST = " || ".join(
    f"substr('{_BASE32}', ((('0x' || substr(sha, {5 * g + 1}, 5))::INTEGER >> {15 - 5 * i}) & 31) + 1, 1)" for g in range(8) for i in range(4)
)

_BITS = ", ".join(["-1"] * 8)
_CRC32 = f"""xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, {_BITS}]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"""

ORACLES = {
    "op4_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
s AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS sha, max(page_id) OVER (PARTITION BY body) AS owner FROM p)
SELECT page_id, payload_bytes, {_DIGEST} AS payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM s""",
    "op7_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) AS size,
  length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), chr(10), '\n')) AS role_size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size + role_size + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op8_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, sha256(norm) AS text_sha256, row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS nth FROM n WINDOW w AS (PARTITION BY norm))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM g""",
    "op9_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 10) AS k FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS phrase FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
grams AS (SELECT r, s, k, array_to_string(w[s : s + k - 1], ' ') AS phrase FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)),
m AS (SELECT r, s, grams.k, item_id FROM grams JOIN windows ON grams.k = windows.k AND grams.phrase = windows.phrase),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256 FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)""",
    "op12_prefix_trie": f"""
WITH t AS (SELECT conv_id AS c, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(said ORDER BY i) AS turns FROM t GROUP BY c),
k AS (SELECT c, turns, {_CRC32} % 9 AS h FROM own),
r AS (SELECT k.c, list_concat(coalesce(list_slice(b.turns, 1, h), []), list_slice(k.turns, h + 1, len(k.turns))) AS turns FROM k LEFT JOIN own b ON b.c = k.c - k.c % 5),
m AS (SELECT c, len(turns) AS n, d, list_slice(turns, 1, d) AS path, CASE WHEN d > 0 THEN list_slice(turns, 1, d - 1) END AS up FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT path, any_value(up) AS up, min(c) AS conv_id, d, count(*) AS n_convs, max(n) > d AS inner_node, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends,
  CASE WHEN d > 0 THEN (count(*) - 1) * octet_length(encode(any_value(path[-1].text))) ELSE 0 END AS saved FROM m GROUP BY path, d),
a AS (SELECT list_slice(path, 1, e) AS top, e, saved, inner_node, d FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM n)),
s AS (SELECT top, e, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (NOT inner_node) AS n_leaves, count(*) FILTER (d = e + 1) AS n_children FROM a GROUP BY top, e)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN s ON s.top = n.path AND s.e = n.d LEFT JOIN n p ON p.path = n.up AND p.d = n.d - 1""",
}
