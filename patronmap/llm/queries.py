"""The queries of the numbered operators over the given tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patronmap.llm import langid, lexical, mixing, packing, prefixtrie, quality, secrets, sentencepieces, simhash, suffixtree, topk, toxicity, warc
from patronmap.llm.common import table, tokenizer_path

PACKING_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("valid")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document, and whether it is a secret."""
    return secrets.scan(table(spark, sf_dir, "documents")).drop("text_key")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 2048."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(PACKING_TOKENIZER))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules and the model's verdict for every document."""
    return quality.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document by word counts and by the suffix tree."""
    return suffixtree.score_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of sources takes."""
    return mixing.mix(table(spark, sf_dir, "documents")).taken().drop("text_key")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, by inner product."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for every item of the benchmark."""
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's pieces, and digest of their decoded text."""
    return sentencepieces.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_secrets": op2_secrets,
    "op3_langid": op3_langid,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_lm": op7_lm,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_topk": op10_topk,
    "op11_trie": op11_trie,
    "op12_lexical": op12_lexical,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLE: dict[str, str] = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages),
        r AS (SELECT *, first(page_id) OVER w AS head, row_number() OVER w AS place
              FROM p WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id))
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND place > 1 THEN head END AS refers_to
        FROM r""",
    "op10_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.n, q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.n <> c.n
            WHERE q.vec_id % 20 = 0),
        r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_trie": r"""
        WITH RECURSIVE bits(n, k, c) AS (
            SELECT range, 0, range FROM range(256)
            UNION ALL
            SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
        remainders AS (SELECT n, c FROM bits WHERE k = 8),
        sums(conv_id, s, i, c) AS (
            SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT)
            FROM conversations WHERE conv_id IS NOT NULL
            UNION ALL
            SELECT conv_id, s, i + 1, xor(m.c, sums.c >> 8)
            FROM sums JOIN remainders m ON m.n = (xor(sums.c, ascii(s[i + 1])) & 255) WHERE i < length(s)),
        h AS (SELECT conv_id, xor(c, 4294967295) % 4 AS h FROM sums WHERE i = length(s)),
        t AS (
            SELECT conv_id, turn, coalesce(text, '') AS text,
                   sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
            FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM t),
        r AS (
            SELECT h.conv_id, 0 AS part, pos, text, k FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20 AND pos <= h
            UNION ALL
            SELECT h.conv_id, 1, pos, text, k FROM h JOIN o ON o.conv_id = h.conv_id AND pos > h),
        d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM r),
        p AS (
            SELECT conv_id, 0 AS depth, '' AS path, 0 AS words FROM h
            UNION ALL
            SELECT conv_id, depth, sha256(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth)),
                   len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM d),
        e AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM p),
        n AS (
            SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
            FROM e GROUP BY path),
        up AS (SELECT n.path, p.path AS parent FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
        c AS (SELECT parent AS path, count(*) AS n_children FROM up GROUP BY parent),
        m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (path)),
        a AS (
            SELECT p.path, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved
            FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.path)
        SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children,
               CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, m.ends_sha256
        FROM m JOIN a USING (path) LEFT JOIN up USING (path) LEFT JOIN n q ON q.path = up.parent""",
    "op12_lexical": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
            FROM documents),
        n AS (SELECT r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
        s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
        m AS (SELECT r, doc_id, t, 100 - 90 + (90 * n * docs) // terms AS m FROM n, s),
        p AS (SELECT r, doc_id, m, term, CAST(count(*) AS BIGINT) AS tf
              FROM (SELECT r, doc_id, m, unnest(t) AS term FROM m) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
              FROM p, s GROUP BY term),
        i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
              FROM benchmark),
        x AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
              FROM i JOIN w USING (term) JOIN p USING (term) GROUP BY ALL),
        o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
              FROM x WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
}
