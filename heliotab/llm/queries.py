"""Queries of the operators of this subpackage over the benchmark tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotab.llm.audio import media_digests
from heliotab.llm.bit_slices import top_scores
from heliotab.llm.common import table
from heliotab.llm.gnat_codes import vector_codes
from heliotab.llm.license_scan import scan_licenses
from heliotab.llm.line_templates import drop_recurring_lines
from heliotab.llm.mixing import plan_mix
from heliotab.llm.near_copies import near_copy_classes
from heliotab.llm.neighbours import nearest_neighbours
from heliotab.llm.piece_codec import piece_digests
from heliotab.llm.quality import quality
from heliotab.llm.repeats import repeat_digests
from heliotab.llm.subvector_clusters import subvector_clusters
from heliotab.llm.toxic_spans import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_sentencepiece_codec")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op2_mpeg_audio")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored in an audio column, read back and probed."""
    return media_digests(table(spark, sf_dir, "documents"))


OP3 = r"""
WITH sized AS (
  SELECT doc_id, source, text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight
  FROM totals),
-- Sources fill up in the order of limit over weight; the level is right once the next one isn't filled by it.
filled AS (
  SELECT *, 2.0::DOUBLE * source_size AS lim, 2.0::DOUBLE * source_size / weight AS fill_at,
         sum(source_size) OVER () AS everything,
         coalesce(sum(source_size) OVER w, 0) AS before, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest
  FROM weighed
  WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT CAST(1.5::DOUBLE * everything - 2.0::DOUBLE * before AS DOUBLE) / CAST(rest AS DOUBLE) AS level FROM filled
  WHERE CAST(1.5::DOUBLE * everything - 2.0::DOUBLE * before AS DOUBLE) / CAST(rest AS DOUBLE) <= fill_at
  ORDER BY fill_at, source NULLS LAST LIMIT 1),
rates AS (
  SELECT source, source_size, least(lim, level * weight) AS target,
         CASE WHEN source_size > 0 THEN least(lim, level * weight) / source_size ELSE 0.0::DOUBLE END AS rate
  FROM filled, level)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR),
         'text ' || md5(coalesce(text, '')))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE
         < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""


@query("op3_source_mix", OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document: 150 % of all words, sources weighing 5, 2, 1."""
    planned = plan_mix(table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return planned.select("doc_id", "size", "source_size", "target", taken)


@query("op4_run_index")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that strings of 100 bytes which start earlier cover."""
    return repeat_digests(table(spark, sf_dir, "documents"))


@query("op5_adaptive_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of every vector whose id is divisible by 50."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document: template, matched part and span."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_near_copies")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of every document, and whether it is the one that stays."""
    classes = near_copy_classes(table(spark, sf_dir, "documents"))
    return classes.select(F.col("k_id").alias("doc_id"), "class_id", "first")


@query("op8_toxic_spans")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with the places of its toxic spans."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_quality_network")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP10 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos
  FROM documents),
even AS (SELECT doc_id, pos, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS even FROM lines),
masked AS (
  SELECT doc_id, pos, masked, string_split(masked, ' ') AS tokens
  FROM (SELECT doc_id, pos, regexp_replace(even, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked FROM even)),
long AS (
  SELECT doc_id, pos, masked, tokens, len(tokens) AS n, array_to_string(tokens[1:2], ' ') AS lead FROM masked
  WHERE len(tokens) >= 3),
kinds AS (
  SELECT n, lead, masked, any_value(tokens) AS tokens, count(DISTINCT doc_id) AS n_docs FROM long WHERE n >= 8
  GROUP BY n, lead, masked),
seeds AS (
  SELECT n, lead, max_by(masked, (n_docs, md5(masked))) AS seed FROM kinds GROUP BY n, lead HAVING count(*) > 1),
joined AS (
  SELECT kinds.masked, seed FROM kinds JOIN seeds USING (n, lead)
  WHERE masked <> seed
    AND len(list_filter(list_zip(tokens, string_split(seed, ' ')), lambda p: p[1] = p[2])) >= 0.75 * n),
named AS (
  SELECT doc_id, pos, coalesce(seed, long.masked) AS template FROM long LEFT JOIN joined ON long.masked = joined.masked),
recurring AS (
  SELECT template, min(doc_id) AS first FROM named GROUP BY template HAVING count(DISTINCT doc_id) >= 3),
dropped AS (
  SELECT DISTINCT doc_id, pos FROM named JOIN recurring USING (template) WHERE doc_id <> first)
SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE d.pos IS NULL), '') AS text,
       count(*) AS n_lines, count(d.pos) AS n_dropped
FROM lines l LEFT JOIN dropped d ON l.doc_id = d.doc_id AND l.pos = d.pos
GROUP BY l.doc_id
"""


@query("op10_line_templates", OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs over documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_recurring_lines(docs).select("doc_id", "text", "n_lines", "n_dropped")


# Vectors without null or non-finite components, as whole numbers; r tells rows apart.
WHOLE = """
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
# floor(s / n); the operator // cuts towards 0.
FLOOR_MEAN = "(s - ((s % n) + n) % n) // n"
SQUARED = "CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"

OP11 = f"""
WITH {WHOLE.format(scale=1024)},
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM kept q JOIN kept c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op11_bit_sliced_search", OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten other vectors with the largest inner product for every vector whose id is divisible by 100."""
    return top_scores(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def _op12_sql(rounds: int = 6) -> str:
    steps = [
        WHOLE.format(scale=4096),
        """parts AS MATERIALIZED (
  SELECT r, vec_id, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS s FROM kept, range(8) t(p))""",
        """b0 AS MATERIALIZED (
  SELECT p, e, s FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, s FROM parts)
  WHERE e < 16)""",
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, p, arg_min(e, d * 16 + e) AS e, min(d) AS d
  FROM (SELECT r, p, e, {SQUARED.format(a="parts.s", b=f"b{k}.s")} AS d FROM parts JOIN b{k} USING (p))
  GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.s, b{k}.s) AS s
  FROM b{k} LEFT JOIN (
    SELECT p, e, list({FLOOR_MEAN} ORDER BY i) AS s
    FROM (SELECT p, e, i, CAST(sum(s[i]) AS BIGINT) AS s, count(*) AS n
          FROM (SELECT p, e, s, unnest(range(1, len(s) + 1)) AS i FROM a{k} JOIN parts USING (r, p)) GROUP BY p, e, i)
    GROUP BY p, e) m USING (p, e))""")
    steps.append(f"""coded AS (
  SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)""")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


@query("op12_gnat_codes", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as the codes of its eight parts, with its error and that of its label."""
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _op13_sql(rounds: int = 10) -> str:
    steps = [
        WHOLE.format(scale=1024),
        "used AS MATERIALIZED (SELECT r, vec_id, v FROM kept WHERE len(v) = 64)",
        """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS c, v FROM used QUALIFY c < 8)""",
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, arg_min(c, d * 8 + c) AS c, min(d) AS d
  FROM (SELECT r, c, {SQUARED.format(a="used.v", b=f"c{k}.v")} AS d FROM used, c{k}) GROUP BY r)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.v, c{k}.v) AS v
  FROM c{k} LEFT JOIN (
    SELECT c, list({FLOOR_MEAN} ORDER BY i) AS v
    FROM (SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
          FROM (SELECT c, v, unnest(range(1, 65)) AS i FROM a{k} JOIN used USING (r)) GROUP BY c, i)
    GROUP BY c) m USING (c))""")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN used USING (r) JOIN c{rounds} USING (c)
"""


@query("op13_subvector_clusters", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector of 64 components after ten rounds from eight hashed starts."""
    return subvector_clusters(table(spark, sf_dir, "embeddings"))
