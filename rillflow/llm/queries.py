"""The registered queries of this subpackage and their SQL. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, licenses, lines, media, minhash, negatives, packing, pieces, sharding, toxicity, trie, vectors, warc
from ..scratch import scratch
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return found.select(
        "doc_id",
        F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
        F.aggregate("line_runs", F.lit(0).cast("long"), lambda s, r: s + r["lines"]).alias("n_removed"),
        F.size("line_runs").cast("long").alias("n_runs"),
        F.size("copies").cast("long").alias("n_copies"),
        F.coalesce(F.array_max(F.transform("copies", lambda c: c["lines"])), F.lit(0)).cast("long").alias("longest_copy"),
        F.length(F.coalesce("kept_text", F.lit(""))).cast("long").alias("kept_chars"),
        F.md5(F.coalesce("kept_text", F.lit(""))).alias("kept_md5"),
    )


#: Windows of every width, one line wider a step, as long as two are equal.
OP1_SQL = r"""
WITH RECURSIVE
a AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS p
  FROM documents),
l AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS i, md5(line) AS h,
         len(regexp_extract_all(line, '[^ \t\r]+')) AS n
  FROM a WHERE regexp_matches(line, '[^ \t\r]')),
r AS (
  SELECT 1 AS width, doc_id, i, h AS k, n AS words FROM l
  UNION ALL
  SELECT * FROM (
    SELECT r.width + 1 AS width, r.doc_id, r.i, md5(r.k || l.h) AS k, r.words + l.n AS words
    FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + r.width)
  QUALIFY count(*) OVER (PARTITION BY k) > 1),
f AS (
  SELECT *, first_value(doc_id) OVER o AS first_doc, first_value(i) OVER o AS first_at
  FROM r WINDOW o AS (PARTITION BY width, k ORDER BY doc_id, i)),
w AS (
  SELECT doc_id, i, max(width) AS width FROM f
  WHERE (first_doc < doc_id OR first_at + width <= i) AND (words >= 50 OR width >= 4)
  GROUP BY ALL),
c AS (
  SELECT * FROM w
  QUALIFY coalesce(max(i + width) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < i + width, true)),
g AS (
  SELECT DISTINCT c.doc_id, unnest(range(x.p, y.p + 1)) AS p
  FROM c JOIN l AS x ON x.doc_id = c.doc_id AND x.i = c.i JOIN l AS y ON y.doc_id = c.doc_id AND y.i = c.i + c.width - 1),
m AS (SELECT a.doc_id, a.p, a.line, g.p IS NOT NULL AS gone FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.p = g.p),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM m),
t AS (SELECT doc_id, count(*) AS n_copies, CAST(max(width) AS BIGINT) AS longest_copy FROM c GROUP BY 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_runs,
       coalesce(any_value(n_copies), 0) AS n_copies, coalesce(any_value(longest_copy), 0) AS longest_copy,
       coalesce(length(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone)), 0) AS kept_chars,
       md5(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_md5
FROM e LEFT JOIN t USING (doc_id) GROUP BY doc_id"""


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.examples(turns))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (
  SELECT *, length('<turn ' || replace(replace(replace(role, '\', '\\'), '<', '\<'), '>', '\>') || '> ' || replace(replace(text, '\', '\\'), '<', '\<') || '</turn>' || chr(10)) AS n,
         CASE WHEN role = 'assistant' THEN text END AS said
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(said)), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(said, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars, count(said) AS n_examples
FROM p GROUP BY conv_id"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    value, bias = toxicity.model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, value, bias)
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85, bands=24, rows=6)


#: All pairs of documents that share a shingle; least ids are passed on along links until none falls.
OP6_SQL = r"""
WITH RECURSIVE
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      ELSE [array_to_string(w, ' ')] END) AS g
  FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, least) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, r.least FROM r JOIN e ON e.a = r.doc_id AND r.least < e.b),
c AS (SELECT doc_id, min(least) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


OP7_SQL = r"""
WITH RECURSIVE
v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x, len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AS sound
  FROM embeddings),
g AS (SELECT *, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS size FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND sound),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.size > 0 AND b.size > 0 AND list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.93),
r(vec_id, least) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT e.b, r.least FROM r JOIN e ON e.a = r.vec_id AND r.least < e.b),
c AS (SELECT vec_id, min(least) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.describe(warc.read_archive(spark, path))


OP8_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
c AS (SELECT page_id, n, d, unnest(range(32)) AS i FROM h),
v AS (SELECT page_id, n, d, i, ('0x' || substr(d || '00', 1 + (5 * i) // 4, 2))::INT AS two FROM c),
e AS (SELECT page_id, n, d, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((two >> (3 - (5 * i) % 4)) & 31), 1), '' ORDER BY i) AS b32
      FROM v GROUP BY ALL),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM e)
SELECT page_id, n AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f"""


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), escape=False)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*trie.branched(trie.paths(table(spark, sf_dir, "conversations"))))


#: Totals of a node are those of all nodes on its members' paths from it on, each counted for the conversation that names it.
OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS own, conv_id - conv_id % 5 AS base,
         xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda r, b: list_reduce(list_concat([xor(r, b)], range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 9 AS h
  FROM t GROUP BY conv_id),
d AS (SELECT c.*, least(coalesce(b.own, 0), c.h) AS head FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (
  SELECT d.conv_id, t.i + 1 AS depth, role, text FROM d JOIN t ON t.conv_id = d.base AND t.i < d.h
  UNION ALL
  SELECT d.conv_id, d.head + t.i - d.h + 1, role, text FROM d JOIN t ON t.conv_id = d.conv_id AND t.i >= d.h),
p AS (
  SELECT conv_id, depth, octet_length(encode(text)) AS n_bytes, string_agg(md5(role || chr(10) || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS k FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM d),
n AS (SELECT depth, k, min(conv_id) AS node, count(*) AS n_convs, any_value(n_bytes) AS n_bytes FROM p GROUP BY ALL),
m AS (SELECT p.conv_id, p.depth, n.node, n.n_convs, n.n_bytes FROM p JOIN n USING (depth, k)),
u AS (SELECT o.node, o.depth, (o.n_convs - 1) * o.n_bytes AS saved, l.node AS parent_node FROM m o LEFT JOIN m l ON l.conv_id = o.conv_id AND l.depth = o.depth - 1 WHERE o.conv_id = o.node),
kids AS (SELECT parent_node AS node, depth - 1 AS depth, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
own AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN kids USING (node, depth)),
ends AS (
  SELECT node, depth, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
  FROM m JOIN (SELECT conv_id, max(depth) AS depth FROM p GROUP BY 1) USING (conv_id, depth) GROUP BY ALL),
totals AS (
  SELECT m.node, m.depth, count(*) FILTER (own.n_children = 0) AS n_leaves, CAST(sum(own.saved) AS BIGINT) AS saved
  FROM m JOIN own ON own.node = m.conv_id AND own.depth >= m.depth GROUP BY ALL)
SELECT own.node AS conv_id, own.depth, own.parent_node AS parent_conv_id, n.n_convs, own.n_children, n_leaves, totals.saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM own JOIN n ON n.node = own.node AND n.depth = own.depth JOIN totals ON totals.node = own.node AND totals.depth = own.depth
LEFT JOIN ends ON ends.node = own.node AND ends.depth = own.depth"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON len(a.q) = len(r.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    text = F.coalesce("row.text", F.lit(""))
    return rows.select(
        "row.doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_chat, op3_toxicity, op4_licenses, op5_sentencepiece, op6_minhash, op7_vectors, op8_warc, op9_media, op10_packing, op11_prefix_trie, op12_hard_negatives,
        op13_sharding,
    )
}
SQL = {"op1_line_dedup": OP1_SQL, "op2_chat": OP2_SQL, "op6_minhash": OP6_SQL, "op7_vectors": OP7_SQL, "op8_warc": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op12_hard_negatives": OP12_SQL}
