"""The operators of this subpackage as driver queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, jaccard_join, language_model, line_dedup, nearest, quality, suffix_dedup, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Where the public word-level vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.search(vectors, vectors.where("vec_id % 20 = 0"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary()), "doc_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup_strings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rounded far below any difference that matters: sums are taken in another order elsewhere
    done = language_model.score(table(spark, sf_dir, "documents"))
    return done.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_nearest": op2_nearest,
    "op3_bpe": op3_bpe,
    "op4_url_filter": op4_url_filter,
    "op5_line_dedup": op5_line_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_language_model": op8_language_model,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": r"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, size, i AS pos, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT *, len(w) AS size, unnest(range(len(w) - 4)) AS i FROM d)),
bs AS (SELECT item_id, n, array_to_string(w[i + 1:i + 5], ' ') AS s, count(*) AS c FROM (SELECT *, len(w) AS n, unnest(range(len(w) - 4)) AS i FROM b) GROUP BY ALL),
windows AS (SELECT DISTINCT doc_id, item_id, n, size, unnest(range(greatest(0, pos - (n - 5)), least(pos, greatest(0, size - n)) + 1)) AS start FROM ds JOIN bs USING (s)),
held AS (SELECT doc_id, item_id, n, start, s, count(*) AS c FROM windows JOIN ds USING (doc_id) WHERE pos BETWEEN start AND start + n - 5 GROUP BY ALL),
met AS (SELECT h.doc_id, h.item_id, h.n, h.start, sum(h.c) AS here, sum(CASE WHEN b.c IS NULL THEN 0 ELSE least(h.c, b.c) END) AS shared
    FROM held h LEFT JOIN bs b USING (item_id, s) GROUP BY ALL),
scored AS (SELECT *, shared::DOUBLE / (here + n - 4 - shared) AS similarity FROM met)
SELECT doc_id, item_id, similarity, start::INT AS start, n::INT AS size FROM scored WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
""",
    "op6_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT *, unnest(range(greatest(len(w) - 4, least(len(w), 1)))) AS i FROM d)),
n AS (SELECT doc_id, count(s) AS n FROM d LEFT JOIN sh USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN m ON doc_id = x
""",
    "op4_url_filter": r"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
    ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
named AS (
    SELECT page_id,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages),
fits AS (
    SELECT n.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
    FROM named n JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
    GROUP BY n.page_id)
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM named n LEFT JOIN fits f USING (page_id)
""",
    "op5_line_dedup": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
raw AS (SELECT r, doc_id, i, parts[i] AS line, regexp_replace(parts[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s
    FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS parts FROM d))),
l AS (SELECT row_number() OVER () AS n, s, strlen(s) AS m, encode(s) AS b FROM (SELECT DISTINCT s FROM raw WHERE s <> '')),
long AS (SELECT * FROM l WHERE m >= 16),
-- of the shorter line (m bytes) one of three pieces stands in the longer one, at most two bytes away
piece AS (SELECT n, m, j, (m // 3) * j + greatest(0, j - (3 - m % 3)) AS p0, m // 3 + (j >= 3 - m % 3)::INT AS size, b FROM long, (SELECT unnest([0, 1, 2]) AS j)),
held AS (SELECT n, m, j, b[p0 + 1:p0 + size] AS g FROM piece),
probe AS (SELECT DISTINCT x.n, x.m - o.o AS m, j.j, x.b[p.p0 + h.h + 1:p.p0 + h.h + p.size] AS g
    FROM long x, (SELECT unnest([0, 1, 2]) AS o) o, (SELECT unnest([0, 1, 2]) AS j) j, (SELECT unnest([-2, -1, 0, 1, 2]) AS h) h,
        LATERAL (SELECT ((x.m - o.o) // 3) * j.j + greatest(0, j.j - (3 - (x.m - o.o) % 3)) AS p0, (x.m - o.o) // 3 + (j.j >= 3 - (x.m - o.o) % 3)::INT AS size) p
    WHERE x.m - o.o >= 16 AND p.p0 + h.h >= 0 AND p.p0 + h.h + p.size <= x.m),
met AS (SELECT DISTINCT held.n AS x, probe.n AS y FROM held JOIN probe USING (m, j, g) WHERE held.n <> probe.n),
near AS (SELECT x, y FROM met JOIN long a ON a.n = x JOIN long b ON b.n = y WHERE levenshtein(a.s, b.s) <= 2),
e AS (SELECT x, y FROM near UNION SELECT y, x FROM near),
reach(x, y) AS (SELECT x, x FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
class AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
told AS (SELECT raw.r, raw.doc_id, raw.i, raw.line, raw.s, coalesce(class.c, l.n) AS c FROM raw LEFT JOIN l USING (s) LEFT JOIN class ON class.x = l.n),
judged AS (SELECT *, s <> '' AND row_number() OVER (PARTITION BY s <> '', c ORDER BY doc_id, r, i) > 1 AS gone FROM told),
done AS (SELECT r, count(*) FILTER (s <> '') AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM d LEFT JOIN done USING (r)
""",
    "op7_suffix_array_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, doc_id, s, b[s + 1:s + 50] AS g FROM (SELECT *, unnest(range(octet_length(b) - 49)) AS s FROM d)),
f AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g),
gone AS (SELECT r, s, s > coalesce(lag(s) OVER (PARTITION BY r ORDER BY s) + 50, -1) AS new FROM w JOIN f USING (g) WHERE least < doc_id),
numbered AS (SELECT r, s, sum(new::INT) OVER (PARTITION BY r ORDER BY s) AS k FROM gone),
runs AS (SELECT r, min(s) AS a, max(s) + 50 AS z FROM numbered GROUP BY r, k),
pieces AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs),
cut AS (SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(hex(b[before + 1:a]), '' ORDER BY a) AS kept FROM pieces JOIN d USING (r) GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept, '') || hex(b[coalesce(last, 0) + 1:]))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
""",
    "op8_language_model": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w,
        xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
            lambda c, x: list_reduce([xor(c, x)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, (a & 1) * 3988292384))), 4294967295) % 5 = 1 AS held_out
    FROM documents),
t AS (SELECT r, held_out, i, CASE WHEN i <= len(w) THEN w[i] ELSE ' ' END AS a3,
        CASE WHEN i > 1 THEN w[i - 1] ELSE '  ' END AS a2, CASE WHEN i > 2 THEN w[i - 2] WHEN i = 2 THEN '  ' END AS a1
    FROM (SELECT *, unnest(range(1, len(w) + 2)) AS i FROM d)),
c1 AS (SELECT a3, count(*) AS c FROM t WHERE NOT held_out GROUP BY a3),
s AS (SELECT sum(c) AS n, count(*) AS v, sum(c) FILTER (a3 = ' ') AS docs FROM c1),
c2 AS (SELECT a2, a3, count(*) AS c FROM t WHERE NOT held_out GROUP BY ALL),
c3 AS (SELECT a1, a2, a3, count(*) AS c FROM t WHERE NOT held_out AND a1 IS NOT NULL GROUP BY ALL),
p AS (SELECT t.r, t.held_out, coalesce(c1.c, 0) AS n1, (coalesce(c1.c, 0) + 0.5::DOUBLE) / (s.n + 0.5::DOUBLE * (s.v + 1)) AS p1,
        coalesce(c2.c, 0) AS n2, CASE WHEN t.a2 = '  ' THEN s.docs ELSE coalesce(h.c, 0) END AS h2, coalesce(c3.c, 0) AS n3, coalesce(g.c, 0) AS h3, t.a1
    FROM t CROSS JOIN s LEFT JOIN c1 ON c1.a3 = t.a3 LEFT JOIN c1 h ON h.a3 = t.a2 LEFT JOIN c2 ON c2.a2 = t.a2 AND c2.a3 = t.a3
        LEFT JOIN c2 g ON g.a2 = t.a1 AND g.a3 = t.a2 LEFT JOIN c3 ON c3.a1 = t.a1 AND c3.a2 = t.a2 AND c3.a3 = t.a3),
q AS (SELECT *, (n2 + 500 * p1) / (h2 + 500) AS p2 FROM p),
o AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (n1 > 0) AS n_known, sum(log10(p1)) AS base_score,
        sum(log10(CASE WHEN a1 IS NULL THEN p2 ELSE (n3 + 10 * p2) / (h3 + 10) END)) AS score FROM q GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, s.n::BIGINT AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM d JOIN o USING (r) CROSS JOIN s
""",
}
