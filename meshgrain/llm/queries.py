"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshgrain.llm import decontaminate, quality, secret_scan, sharding, substring_dedup, suffix_dedup, token_alignment, toxicity
from meshgrain.llm.common import text_batches
from meshgrain.llm.embedding_dedup import embedding_links
from meshgrain.llm.lexical_search import lexical_search
from meshgrain.llm.mixing import mix_sources
from meshgrain.llm.ngram_join import ngram_join
from meshgrain.llm.url_filters import PATTERN_RULES, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"), size=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(_table(spark, sf_dir, "embeddings"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_spans(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    examples = toxicity.fit(docs, labels.where(~held_out).select("doc_id", F.col("toxic").alias("label")))
    return toxicity.toxicity(docs, examples).select("doc_id", held_out.alias("held_out"), "score", "predicted", F.to_json("evidence").alias("evidence"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    weights = quality.fit(docs, labels.where(~held_out).select("doc_id", F.col("quality").alias("label")))
    return quality.quality(docs, weights).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.array_join("patterns", ",").alias("patterns"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_counts(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOW.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, array_to_string(w, ' ') AS s FROM w WHERE len(w) BETWEEN 1 AND 3
  UNION
  SELECT doc_id, array_to_string(w[i:i+3], ' ') FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4)),
h AS (SELECT doc_id, md5_number_lower(s) AS s FROM g),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM h x JOIN h y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 85 * (x.n + y.n - both_n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT node, min(seen) AS component_id FROM c GROUP BY node) m ON m.node = d.doc_id
"""

_OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
c AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT c.node, l.b FROM c JOIN l ON l.a = c.seen),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON a = vec_id JOIN (SELECT node, min(seen) AS component_id FROM c GROUP BY node) ON node = vec_id
"""

_OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM s WINDOW f AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
u AS (SELECT *, cap * weights < rest * weight AS is_full FROM o),
v AS (SELECT rest AS r, weights AS w FROM u WHERE NOT is_full ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (weight * r)::DOUBLE / w END AS target FROM u LEFT JOIN v ON true),
b AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT // source_size END AS epochs FROM t),
r AS (SELECT d.*, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r
"""


def _op4_sql() -> str:
    q = lambda p: p.replace("'", "''")
    kinds = [("assign", secret_scan.ASSIGN), ("access", secret_scan.ACCESS), ("hex", secret_scan.HEX), ("token", secret_scan.TOKEN)]
    each = " UNION ALL ".join(
        f"""SELECT rid, doc_id, source, {k} AS k, '{name}' AS kind, ms[i] AS m, {f"regexp_extract(ms[i], '{q(p)}', 2)" if k == 0 else "ms[i]"} AS v,
        list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s
        FROM (SELECT rid, doc_id, source, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, doc_id, source, regexp_extract_all(t, '{q(p)}') AS ms, string_split_regex(t, '{q(p)}') AS ps FROM d) WHERE len(ms) > 0)"""
        for k, (name, p) in enumerate(kinds)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
f AS (SELECT *, s + length(m) AS e, sha256(v) AS sha FROM ({each}) WHERE k <> 0 OR length(v) >= 8),
o AS (SELECT sha, count(DISTINCT coalesce('o' || source, '')) AS n_owners FROM f GROUP BY sha),
g AS (SELECT f.*, n_owners < {secret_scan.EXAMPLE_OWNERS} AS live FROM f JOIN o USING (sha)),
h AS (SELECT * FROM g WHERE k < 3 OR (live AND NOT EXISTS (SELECT 1 FROM g b WHERE b.rid = g.rid AND b.k < 3 AND b.s < g.e AND g.s < b.e))),
a AS (SELECT rid, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (live) AS n_live,
  coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) FILTER (k < 3), '') AS base,
  string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) AS spans FROM h GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live FROM d LEFT JOIN a USING (rid)
"""


_OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
r AS (SELECT rid, list(DISTINCT p) AS p FROM (SELECT rid, unnest(range(s, s + 50)) AS p FROM g JOIN m USING (h) WHERE doc_id > least) GROUP BY rid),
k AS (SELECT doc_id, len(w) AS n_words, coalesce(len(p), 0) AS n_removed,
  list_filter(w, lambda x, i: p IS NULL OR NOT list_contains(p, i)) AS kept FROM d LEFT JOIN r USING (rid))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

_OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT rid, c, substr(h, 2 * c + 1, 1398) AS h FROM (SELECT rid, h, unnest(range(0, len(h) // 2 - 199, 500)) AS c FROM d WHERE len(h) >= 400)),
w AS (SELECT rid, c + s AS s, md5_number_lower(substr(h, 2 * s + 1, 400)) AS m FROM (SELECT rid, c, h, unnest(range(0, least(500, len(h) // 2 - 199))) AS s FROM c)),
r AS (SELECT rid, s FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
i AS (SELECT rid, s, CASE WHEN s - lag(s) OVER (PARTITION BY rid ORDER BY s) <= 200 THEN 0 ELSE 1 END AS fresh FROM r),
j AS (SELECT rid, s, sum(fresh) OVER (PARTITION BY rid ORDER BY s) AS k FROM i),
u AS (SELECT rid, k, min(s) AS a, max(s) + 200 AS b FROM j GROUP BY ALL),
p AS (SELECT rid, list_concat([0], list(b ORDER BY a)) AS lo, list(a ORDER BY a) AS hi, sum(b - a) AS n, count(*) AS c FROM u GROUP BY rid)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0) AS n_spans,
  sha256(unhex(CASE WHEN c IS NULL THEN h ELSE array_to_string(list_transform(range(1, c + 2), lambda x: substr(h, 2 * lo[x] + 1, 2 * (coalesce(hi[x], len(h) // 2) - lo[x]))), '') END)) AS kept_sha256
FROM d LEFT JOIN p USING (rid)
"""

_WORDS7 = r"regexp_extract_all(" + _LOW.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP7_SQL = rf"""
WITH i AS (SELECT item_id::VARCHAR AS item, {_WORDS7} AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS7} AS w FROM documents),
x AS (SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
m AS (SELECT x.rid, x.s, x.n, g.item FROM x JOIN g ON g.g = x.g AND g.n = x.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""


def _op10_sql() -> str:
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    fixed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    hits = ", ".join(f"CASE WHEN regexp_matches(host || path, '{r.pattern}') THEN '{r.name}' END" for r in PATTERN_RULES)
    return rf"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, {_LOW.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, p, v) AS (VALUES {fixed}),
b AS (SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM u JOIN r
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid),
m AS (SELECT rid, array_to_string(list_sort(list_filter([{hits}], lambda x: x IS NOT NULL)), ',') AS patterns FROM u)
SELECT page_id, host, path, rule, coalesce(b.verdict, CASE WHEN patterns <> '' THEN 'block' ELSE 'allow' END) AS verdict, patterns
FROM u JOIN m USING (rid) LEFT JOIN b USING (rid)
"""


# CRC-32: the table's entry of a byte is the byte shifted eight times; a text's value goes through it byte by byte
_OP11_SQL = """
WITH RECURSIVE t(v, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
m AS (SELECT list(c ORDER BY v) AS m FROM t WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, len(h) // 2 + 1 AS size, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM d),
c AS (SELECT doc_id, size, CASE WHEN len(b) = 0 THEN 0 ELSE xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c >> 8, m[xor(c & 255, x) + 1])), 4294967295) END AS text_crc32 FROM b, m),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM c),
s AS (SELECT *, least(7, (2 * before + size) * 8 // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size) - 1 AS slot, NULL::INT AS grown_shard FROM s
"""

_WORDS13 = r"regexp_extract_all(" + _LOW.format("text") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS13} AS w FROM documents),
s AS (SELECT count(*) AS nn, sum(len(w))::BIGINT AS ll FROM d WHERE len(w) > 0),
t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY ALL),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM (SELECT item_id, {_WORDS13} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark))) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, nn),
r AS (SELECT item_id, rid, sum(times * f.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(d.w) * nn) // ll))))::BIGINT AS score
  FROM i JOIN t USING (term) JOIN f USING (term) JOIN d USING (rid), s GROUP BY item_id, rid),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM r JOIN d USING (rid) WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_secret_scan": op4_secret_scan,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_quality": op9_quality,
    "op10_url_filter": op10_url_filter,
    "op11_sharding": op11_sharding,
    "op12_token_alignment": op12_token_alignment,
    "op13_lexical_search": op13_lexical_search,
}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": _OP1_SQL,
    "op2_embedding_near_dedup": _OP2_SQL,
    "op3_mix_sources": _OP3_SQL,
    "op4_secret_scan": _op4_sql(),
    "op5_substring_dedup": _OP5_SQL,
    "op7_benchmark_decontamination": _OP7_SQL,
    "op8_suffix_array_dedup": _OP8_SQL,
    "op10_url_filter": _op10_sql(),
    "op11_sharding": _OP11_SQL,
    "op13_lexical_search": _OP13_SQL,
}
