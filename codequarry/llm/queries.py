"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.llm import bpe, conversations, decontam, divergence, html_extract, jaccard, langid, line_dedup, simhash, substring_dedup, token_files, topk, toxicity
from codequarry.llm.common import table


def remainder(key: str | Column, mod: int) -> Column:
    """crc32 of a key as text, modulo mod; null for a null key."""
    return F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % mod


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of byte_bpe_50k and their round trip."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, ranks, pattern, with_ids=False)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best of every 50th vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left without repeated windows of 35."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35),
k AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS k FROM s),
r AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 35)) AS p FROM k WHERE k IN (SELECT k FROM r)),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
o AS (SELECT w.doc_id, w.w, coalesce(g.gone, []) AS gone FROM w LEFT JOIN g ON w.doc_id = g.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256 FROM o
"""


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left without repeated windows of three."""
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
s AS (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM l WHERE len(l) >= 3),
k AS (SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS k FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM k),
c AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS p FROM r WHERE n > 1),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(len(l.l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(l.l, lambda x, i: NOT list_contains(coalesce(g.gone, []), i)), chr(10)), '')) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of them."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, lambda key: remainder(key, 5) != 0)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in every document."""
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP7_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, i + unnest(range(0, n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents at similarity 0.9 of three-word shingles."""
    return jaccard.groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""


@F.arrow_udf(T.LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned CRC-32 of each array's ids as little-endian unsigned 32-bit integers."""
    flat = np.asarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")
    at = ids.offsets.to_numpy()
    return pa.array([zlib.crc32(flat[at[i] : at[i + 1]].tobytes()) for i in range(len(ids))], pa.int64())


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of word_bpe_49k, read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = token_files.default_folder(spark)
    manifest = token_files.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, manifest, folder).select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), ids_crc32("ids").alias("ids_crc32"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(remainder("doc_id", 3) != 1))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source of a language strays from it and from its other sources."""
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
m AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM m GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT m.lang, m.source, m.term, count(*) AS n FROM m JOIN k ON m.lang = k.lang AND m.term = k.term GROUP BY m.lang, m.source, m.term),
g AS (SELECT DISTINCT lang, source FROM d),
party AS (SELECT lang, source, false AS whole FROM g UNION ALL SELECT DISTINCT lang, NULL, true FROM g),
cells AS (SELECT p.lang, p.source, p.whole, k.term,
                 CAST(coalesce((SELECT sum(c.n) FROM c WHERE c.lang = p.lang AND c.term = k.term AND (p.whole OR c.source = p.source)), 0) AS HUGEINT) AS n
          FROM party p JOIN k ON p.lang = k.lang),
sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, whole) AS total FROM cells),
s AS (SELECT sized.lang, source, whole, term, n, 1 + (1000000000 * (n + 2)) // (CAST(total AS HUGEINT) + 2 * v.v) AS p FROM sized JOIN v ON sized.lang = v.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND NOT a.whole AND NOT b.whole AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT a.lang, a.source, a.term AS item, CAST(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p) AS BIGINT) AS value
          FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND NOT a.whole AND b.whole WHERE a.n > 0 AND a.p > b.p),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
      UNION ALL
      SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, and groups linked by two differing bits or fewer."""
    return simhash.groups(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage that its keys decide."""
    originals = table(spark, sf_dir, "conversations")
    return conversations.summary(originals, conversations.repair(conversations.damage(originals)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_substring_dedup": op2_substring_dedup, "op3_topk": op3_topk, "op4_html_extract": op4_html_extract, "op5_line_dedup": op5_line_dedup, "op6_toxicity": op6_toxicity, "op7_decontam": op7_decontam, "op8_jaccard": op8_jaccard, "op9_token_files": op9_token_files, "op10_langid": op10_langid, "op11_source_divergence": op11_source_divergence, "op12_simhash": op12_simhash, "op13_conversation_repair": op13_conversation_repair}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op3_topk": OP3_SQL, "op5_line_dedup": OP5_SQL, "op7_decontam": OP7_SQL, "op8_jaccard": OP8_SQL, "op11_source_divergence": OP11_SQL}
