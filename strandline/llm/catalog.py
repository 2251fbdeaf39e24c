"""Registered queries of the operators, with DuckDB equivalents where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import (
    decontam, html, jaccard, langid, lmscore, merkle, mixing, neighbours, packing, repeats, resampling, secrets, warc
)
from strandline.llm.common import table
from strandline.session import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


# The schedule of one period slot by slot: served counts per source as a list, the released
# source with the earliest deadline next.
OP1 = """
WITH RECURSIVE sizes AS (
  SELECT coalesce(source, 'null') AS mix_source, count(*) AS n, CAST(floor(1000 * sqrt(count(*))) AS BIGINT) AS w FROM documents GROUP BY 1),
parts AS (
  SELECT mix_source, n, greatest(1, (w * 2000 + sum(w) OVER ()) // (2 * sum(w) OVER ()))::BIGINT AS p,
         row_number() OVER (ORDER BY mix_source) AS i FROM sizes),
facts AS (SELECT list(p ORDER BY i) AS p, list(n ORDER BY i) AS n, sum(p)::BIGINT AS period, count(*)::BIGINT AS k FROM parts),
slots AS (
  SELECT 0::BIGINT AS t, list_transform(p, lambda x: 0::BIGINT) AS served, p, period, k FROM facts
  UNION ALL
  SELECT t + 1, list_transform(range(1, k + 1), lambda i: served[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), p, period, k FROM (
    SELECT *, list_min(list_transform(
      list_filter(range(1, k + 1), lambda i: served[i] * period // p[i] <= t),
      lambda i: ((served[i] + 1) * period + p[i] - 1) // p[i] * 100000 + i)) % 100000 AS pick FROM slots WHERE t < period)),
picks AS (
  SELECT a.t, a.served, (SELECT list_position(list_transform(range(1, a.k + 1), lambda i: b.served[i] - a.served[i]), 1)) AS i
  FROM slots a JOIN slots b ON b.t = a.t + 1),
rows_ AS (
  SELECT doc_id, coalesce(source, 'null') AS mix_source,
         md5(concat_ws(chr(31), '0', coalesce(doc_id::VARCHAR, chr(0)), md5(coalesce(text, '')))) AS key FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY mix_source ORDER BY key) - 1 AS mix_index FROM rows_),
blocks AS (
  SELECT d.doc_id, d.mix_source, d.mix_index, d.mix_index // 64 AS b, p.p AS own, p.i, f.period, f.p AS ps, f.n AS ns, f.k
  FROM numbered d JOIN parts p USING (mix_source) CROSS JOIN facts f),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY t) - 1 AS turn FROM picks)
SELECT doc_id, b.mix_source, mix_index::BIGINT AS mix_index, b::BIGINT AS mix_block, (b * period // own)::BIGINT AS mix_release,
       (((b + 1) * period + own - 1) // own)::BIGINT AS mix_deadline, (b // own * period + s.t)::BIGINT AS mix_slot,
       (mix_index % 64 + list_sum(list_transform(range(1, k + 1), lambda j: least(ns[j], 64 * (b // own * ps[j] + s.served[j])))))::BIGINT AS position
FROM blocks b JOIN placed s ON s.i = b.i AND s.turn = b.b % b.own
"""


@register("op1_mix_sources", OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mix; weights from the sizes of the sources, softened by a square root."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    return mixing.mix(docs, key=("doc_id", "digest")).drop("source", "digest")


@register("op2_lm_scores")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out trigram scores of every document under all documents."""
    return lmscore.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3 = """
WITH RECURSIVE u AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))) AS size
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.size > 0 AND b.size > 0 AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, l.c AS component_id, e.vec_id = l.c AS kept
FROM embeddings e JOIN least l ON l.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""


@register("op3_embedding_near_dedup", OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings")).drop("recall")


# base32 by five bits of the hexadecimal digest at a time
OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
bits AS (
  SELECT *, list_aggregate(list_transform(range(1, 41), lambda i:
    ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
    [strpos('0123456789abcdef', substr(hex, i, 1))]), 'string_agg', '') AS bits FROM p),
d AS (
  SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(1, 6), lambda j: CAST(substr(bits, i * 5 + j, 1) AS INT) * [16, 8, 4, 2, 1][j]))::INT, 1)), 'string_agg', '') AS digest
  FROM bits),
w AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS head FROM d)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < head THEN head END AS refers_to
FROM w
"""


@register("op4_warc_round_trip", OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives into the shared folder and read back by byte ranges."""
    folder = warc.archive_folder(spark)
    warc.write(table(spark, sf_dir, "pages"), folder).agg(F.sum("records")).first()
    field = F.col("fields")
    return warc.read(spark, folder).select(
        F.when(field["x-page-id"] != "", field["x-page-id"].cast("long")).alias("page_id"),
        field["x-payload-length"].cast("long").alias("payload_bytes"),
        F.substring_index(field["warc-payload-digest"], ":", -1).alias("payload_digest"),
        field["warc-type"].alias("record_type"),
        field["x-refers-to-page"].cast("long").alias("refers_to"),
    )


@register("op5_html_main_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o
  FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY 1, 2),
half AS (SELECT a, b FROM pairs WHERE 100 * o >= 90 * (na + nb - o)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id FROM s JOIN least ON a = doc_id
"""


@register("op6_jaccard_classes", OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


@register("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from four fifths of the labelled documents (by a checksum of the id), predicted for all."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    profiles = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), profiles).drop("text")


OP8 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
at_ AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN ks WHERE len(w) >= k)),
hit AS (SELECT a.doc_id, a.i, a.k, win.item_id FROM at_ a JOIN win ON win.k = a.k AND win.g = a.g),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""


@register("op8_decontaminate", OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontam.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    items = F.array_join(F.array_sort(F.transform("hit_items", lambda i: i.cast("string"))), ",")
    return marked.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@register("op9_repeated_paragraphs")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated paragraph or passage to be removed, with the document that keeps its first occurrence."""
    docs = table(spark, sf_dir, "documents")
    gone = stored(repeats.repeated(docs), "gone")
    return gone.unionByName(repeats.passages(docs, gone))


@register("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("secret_spans", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans")
    )


@register("op11_best_fit_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in sequences of 2048 tokens."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.tokenized(docs, public_tokenizers.path("word_bpe_49k.json")))


# CRC-32 by half bytes: the table of its sixteen steps, and a fold over the hexadecimal digits, low half first
CRC = """list_reduce(
    list_transform(range(0, 2 * octet_length(encode({0}))), lambda i: CAST(strpos('0123456789abcdef',
      substr(lower(hex(encode({0}))), i + 2 - 2 * (i % 2), 1)) - 1 AS BIGINT)),
    lambda c, x: xor([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384,
      4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][1 + (xor(c, x) & 15)], c >> 4),
    CAST(4294967295 AS BIGINT))"""

OP12 = r"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (
  SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
b AS (SELECT f, xor(CRC_OF_F, 4294967295) % 10000 AS b FROM (SELECT DISTINCT f FROM f)),
n AS (SELECT b, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM f JOIN b USING (f) GROUP BY b),
a AS (SELECT count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM f),
g AS (
  SELECT b, CAST(floor(1000 * ln(CAST(n.t + 1 AS DOUBLE) * (a.s + 10000) / (CAST(n.s + 1 AS DOUBLE) * (a.t + 10000)))) AS BIGINT) AS g FROM n CROSS JOIN a),
d AS (SELECT id, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS w FROM f JOIN b USING (f) JOIN g USING (b) WHERE kind = 0 GROUP BY id),
s AS (
  SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(d.w, 0)::BIGINT AS weight, len(w.w) >= 20 AS long,
         coalesce(d.w, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('7:' || id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN d USING (id) WHERE kind = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY long ORDER BY score DESC, doc_id) AS r, 25 * count(*) FILTER (long) OVER () // 100 AS k FROM s)
SELECT doc_id, n_features, weight, score::BIGINT AS score, CASE WHEN long AND r <= k THEN r END::BIGINT AS rank FROM r
""".replace("CRC_OF_F", CRC.format("f"))


@register("op12_importance_resampling", OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's distribution."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resample(docs, table(spark, sf_dir, "benchmark")).drop("n_words")


OP13 = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree,
         coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
           || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS front,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS back, n_chars,
         n_chars + CASE WHEN xor(CRC_OF_ID, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS other
  FROM documents),
leaf AS (
  SELECT doc_id, tree, sha256(front || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || back) AS leaf,
         sha256(front || coalesce(length(other::VARCHAR) || ':' || other, '-') || back) AS bad FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
low AS (
  SELECT tree, 0 AS level, pos, leaf AS h, n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, level, pos // 2, n),
sub AS (SELECT tree, h, level AS height, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, pos, h, n FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY level, pos // 2, n),
walk AS (
  SELECT doc_id, tree, 0 AS level, pos, n, bad AS h, '' AS proof FROM placed
  UNION ALL
  SELECT w.doc_id, w.tree, w.level + 1, w.pos // 2, (w.n + 1) // 2,
         sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.pos % 2 = 1 THEN s.h || w.h ELSE w.h || s.h END), w.proof || coalesce(s.h, '')
  FROM walk w LEFT JOIN low s ON s.tree = w.tree AND s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1),
climb AS (
  SELECT w.doc_id, w.tree, 0 AS level, sub.pos, sub.n, w.h, w.proof FROM walk w JOIN sub USING (tree) WHERE w.n = 1
  UNION ALL
  SELECT w.doc_id, w.tree, w.level + 1, w.pos // 2, (w.n + 1) // 2,
         sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.pos % 2 = 1 THEN s.h || w.h ELSE w.h || s.h END), w.proof || coalesce(s.h, '')
  FROM climb w LEFT JOIN high s ON s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1)
SELECT p.doc_id, p.leaf, sub.h AS subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = r.h AS verified
FROM placed p JOIN climb c ON c.doc_id = p.doc_id AND c.n = 1 JOIN sub ON sub.tree = p.tree CROSS JOIN (SELECT h FROM high WHERE n = 1) r
""".replace("CRC_OF_ID", CRC.format("doc_id::VARCHAR"))


@register("op13_merkle_manifest", OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents by language; a seventh of them is checked with a changed length."""
    docs = table(spark, sf_dir, "documents")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    docs = docs.withColumn("seen", merkle.leaf_hash([changed if c == "n_chars" else F.col(c) for c in fields]))
    found = merkle.manifest(docs, fields, carry=("doc_id", "seen"))
    found = found.withColumn("folded_root", merkle.folded(F.col("seen"), F.col("proof"), F.col("sides")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
