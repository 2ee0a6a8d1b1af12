"""The registered queries of this folder: thin contracts over the operators."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chosen_path, cross_polytope, divergence, lm_scoring, mixing, quality, resampling, sharding, suffix_dedup, toxicity, va_file, warc
from .common import read

#: Where the public vocabularies lie if the package that names them is absent.
TOKENIZERS = os.environ.get("CONEFLOW_TOKENIZERS", "/opt/tokenizers")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file; the installed package knows it, or else the folder above."""
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return f"{TOKENIZERS}/{name}"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), vocabulary_path())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read(spark, sf_dir, "pages"))


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(read(spark, sf_dir, "documents"))


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(read(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(read(spark, sf_dir, "documents"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.top_k(read(spark, sf_dir, "embeddings"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(read(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_bpe": op2_bpe,
        "op3_warc": op3_warc,
        "op4_chosen_path": op4_chosen_path,
        "op5_cross_polytope": op5_cross_polytope,
        "op6_quality": op6_quality,
        "op7_gru": op7_gru,
        "op8_suffix_array": op8_suffix_array,
        "op9_toxicity": op9_toxicity,
        "op10_va_file": op10_va_file,
        "op11_divergence": op11_divergence,
        "op12_resampling": op12_resampling,
        "op13_sharding": op13_sharding,
    }


#: Word counts, water-filled targets (a source is at its limit if its limit over its weight is small), and the
#: document at which the running sum by hash comes nearest to what is left after whole passes.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    1.5::DOUBLE * sum(source_size) OVER () AS budget,
    coalesce(sum(2 * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS used,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free
  FROM s),
r AS (
  SELECT (budget - used) / free AS rate FROM o WHERE w * ((budget - used) / free) <= cap
  ORDER BY 2.0::DOUBLE * source_size / w, w, source LIMIT 1),
t AS (
  SELECT o.source, source_size, least(w * rate, cap) AS target,
    CASE WHEN source_size > 0 THEN floor(least(w * rate, cap) / source_size)::BIGINT ELSE 1 END AS passes
  FROM o, r),
c AS (
  SELECT d.*, t.source_size, t.target, t.passes, t.target - t.passes * t.source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
    sum(size) OVER (PARTITION BY d.source, h) AS level
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (size * (passes + CASE WHEN upto <= rest OR (upto - level <= rest AND upto - rest < rest - (upto - level)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

#: Payload digests, and the smallest page of equal payloads of 100 bytes or more.
OP3_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

#: Sets of five-word shingles, all pairs that share one, links at 85 percent, and what each document reaches.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n c ON c.doc_id = x JOIN n d ON d.doc_id = y WHERE 100 * common >= 85 * (c.n + d.n - common)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(other) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""

#: floor(64 x) as integers, every pair of a query and another row, the twenty best.
OP10_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Terms of each document, those in 30 documents of a language, and integer shares of every source and language.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (
  SELECT lang, source, term, n, sum(n) OVER (PARTITION BY lang, source) AS t, sum(n) OVER (PARTITION BY lang, term) AS ln, sum(n) OVER (PARTITION BY lang) AS lt FROM a),
s AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (t + 5 * v) AS p, 1 + (1000000000::HUGEINT * (ln + 5)) // (lt + 5 * v) AS q
  FROM p JOIN v USING (lang)),
f AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(m.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) m
    ON m.lang = x.lang AND m.source = x.source AND m.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM f)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""

#: crc32 of the bytes of a list, by the usual table of 256 remainders of the reflected polynomial.
_CRC_TABLE = """
t AS (
  SELECT list(r ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce([i] || [0 FOR k IN range(8)], lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END) AS r
    FROM (SELECT unnest(range(256)) AS i)))"""


def _crc(text: str) -> str:
    """SQL of the unsigned crc32 of a text's UTF-8 bytes; ``crcs`` must be in reach."""
    each = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {each}, lambda r, b: xor(r >> 8, crcs[(xor(r, b) & 255) + 1])), 4294967295)"


#: Words by the same pattern, buckets by crc32, gains by bucket, floored means, and the draw by rank.
OP12_SQL = rf"""
WITH {_CRC_TABLE},
f AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
e AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
o AS (SELECT row, unnest(ws) AS w FROM f),
b AS (SELECT w, {_crc("w")} % 10000 AS bucket FROM (SELECT w FROM o UNION SELECT w FROM e), t),
s AS (SELECT bucket, count(*) AS s FROM o JOIN b USING (w) GROUP BY bucket),
t2 AS (SELECT bucket, count(*) AS t FROM e JOIN b USING (w) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t2) + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t2 USING (bucket)),
m AS (SELECT row, sum(gain) AS total FROM o JOIN b USING (w) JOIN g USING (bucket) GROUP BY row),
d AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / len(ws)), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM f LEFT JOIN m USING (row)),
c AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
r AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, weight DESC, n_features DESC) AS place,
    count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS wanted
  FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= wanted THEN place END AS rank FROM r
"""


def _op13_sql(shards: int = 8) -> str:
    """Groups by hash, the least capacity by dynamic programming over all edges, and the even cuts that it allows, one by one."""
    best = "b1 AS (SELECT i, upto AS best FROM e)"
    for k in range(2, shards + 1):
        best += f",\nb{k} AS (SELECT y.i, min(greatest(x.best, y.upto - z.upto)) AS best FROM b{k - 1} x JOIN e z ON z.i = x.i JOIN e y ON y.i >= x.i GROUP BY y.i)"
    late = f"l{shards} AS (SELECT sum(size) AS pos FROM d)"
    for k in range(shards - 1, 0, -1):
        late += f",\nl{k} AS (SELECT min(upto) AS pos FROM e, l{k + 1}, cap WHERE upto >= pos - c)"
    cuts = "c0 AS (SELECT 0 AS pos)"
    for k in range(1, shards):
        left = shards - k + 1
        near = f"(SELECT upto FROM e, tot ORDER BY abs(upto * {left} - (c.pos * {left} + t - c.pos)), upto LIMIT 1)"
        most = "(SELECT max(upto) FROM e WHERE upto <= c.pos + cap.c)"
        cuts += f",\nc{k} AS (SELECT greatest(least({near}, {most}), l.pos, c.pos) AS pos FROM c{k - 1} c, l{k} l, cap)"
    of = " + ".join(f"(g.upto > (SELECT pos FROM c{k}))::INTEGER" for k in range(1, shards))
    return f"""
WITH {_CRC_TABLE},
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, {_crc("coalesce(text, '')")} AS crc,
    ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS key
  FROM documents, t),
g AS (SELECT key, sum(w) OVER (ORDER BY key) AS upto FROM (SELECT key, sum(size) AS w FROM d GROUP BY key)),
e AS (SELECT row_number() OVER (ORDER BY upto) - 1 AS i, upto FROM (SELECT 0 AS upto UNION SELECT upto FROM g)),
tot AS (SELECT max(upto) AS t FROM e),
{best},
cap AS (SELECT best AS c FROM b{shards} ORDER BY i DESC LIMIT 1),
{late},
{cuts},
s AS (SELECT d.*, {of} AS shard FROM d JOIN g USING (key))
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op3_warc": OP3_SQL, "op4_chosen_path": OP4_SQL, "op10_va_file": OP10_SQL, "op11_divergence": OP11_SQL, "op12_resampling": OP12_SQL, "op13_sharding": _op13_sql()}
