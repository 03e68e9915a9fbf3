"""The registered corpus queries: opN_<name>(spark, sf_dir) and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collisions, crosstoken, htmltext, language, linededup, merkle, mixing, ngramlm, packing, pqdedup, simhash, suffixdedup, toxicity
from .common import read


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(read(spark, sf_dir, "documents")).drop("kept")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines its source repeats: doc_id, n_lines, n_dropped, text."""
    out = linededup.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.col("clean").alias("text"))


OP4 = r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT DISTINCT source, text, lines FROM d WHERE source IS NOT NULL),
pages AS (SELECT source, count(*) AS n FROM p GROUP BY source),
held AS (SELECT source, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))))) AS line FROM p),
bad AS (SELECT source, list(line) AS bad FROM (
  SELECT h.source, h.line FROM held h JOIN pages p ON h.source = p.source WHERE h.line <> ''
  GROUP BY h.source, h.line, p.n HAVING count(*) >= 3 AND count(*) > CAST(0.05 AS DOUBLE) * p.n) GROUP BY source)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
  CASE WHEN bad IS NULL THEN text ELSE array_to_string(kept, chr(10)) END AS text
FROM (SELECT d.*, b.bad, CASE WHEN b.bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(b.bad, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))) END AS kept
  FROM d LEFT JOIN bad b ON d.source = b.source)
"""


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pqdedup.link(read(spark, sf_dir, "embeddings"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6 = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix' || coalesce(':' || CAST(doc_id AS VARCHAR), '') || coalesce(':' || md5(text), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, CAST(3 AS DOUBLE) * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate FROM r),
t AS (SELECT source, source_size, least(cap, weight * (SELECT -min({'ratio': ratio, 'rate': -rate}).rate FROM l WHERE rate <= ratio)) AS target FROM l),
n AS (SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS rounds FROM t),
g AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source, h),
c AS (SELECT g.source, g.h, words, sum(words) OVER (PARTITION BY g.source ORDER BY g.h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM g),
x AS (SELECT c.source, c.h, n.source_size, n.target, n.rounds,
    CASE WHEN upto <= target - rounds * source_size THEN 1
         WHEN upto - words <= target - rounds * source_size AND upto - (target - rounds * source_size) < (target - rounds * source_size) - (upto - words) THEN 1 ELSE 0 END AS more
  FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source)
SELECT d.doc_id, d.size, x.source_size, x.target, CAST(d.size * (x.rounds + x.more) AS BIGINT) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
"""

def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngramlm.score(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT r, i, w, lag(w, 1) OVER (PARTITION BY r ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS u FROM t),
c1 AS (SELECT w, count(*) AS n FROM g GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM g WHERE u IS NOT NULL GROUP BY u, v, w),
s AS (SELECT g.r, CAST(a.n AS DOUBLE) / (SELECT count(*) FROM g) AS s1,
    CASE WHEN g.v IS NULL THEN NULL WHEN b.n >= 2 THEN CAST(b.n AS DOUBLE) / p.n END AS s2, g.v IS NOT NULL AS has2,
    CASE WHEN g.u IS NULL THEN NULL WHEN c.n >= 2 THEN CAST(c.n AS DOUBLE) / q.n END AS s3, g.u IS NOT NULL AS has3
  FROM g JOIN c1 a ON g.w = a.w LEFT JOIN c1 p ON g.v = p.w LEFT JOIN c2 b ON g.v = b.v AND g.w = b.w
  LEFT JOIN c2 q ON g.u = q.v AND g.v = q.w LEFT JOIN c3 c ON g.u = c.u AND g.v = c.v AND g.w = c.w),
l AS (SELECT r, ln(coalesce(s3, CASE WHEN has3 THEN 0.4::DOUBLE ELSE 1 END * coalesce(s2, CASE WHEN has2 THEN 0.4::DOUBLE ELSE 1 END * s1))) AS x FROM s),
z AS (SELECT r, count(*) AS n, sum(x) AS x FROM l GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, round(coalesce(x, 0), 6) AS log_score, round(x / n, 6) AS mean_log_score
FROM d LEFT JOIN z ON d.r = z.r
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


def _fields(*columns: str) -> str:
    return " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in columns)


def _levels(tree: str, nodes: str, walkers: str, levels: int) -> str:
    """CTEs over nodes (s, pos, digest) and walkers (r, s, pos, now, sib): the nodes of each level, and the walkers folded up to the last."""
    out = f"{tree}n0 AS ({nodes}), {tree}f0 AS ({walkers})"
    for k in range(levels):
        out += f""",
{tree}r{k} AS (SELECT s, pos // 16 AS up, list(digest ORDER BY pos) AS run, sum(count(*)) OVER (PARTITION BY s) > 1 AS more FROM {tree}n{k} GROUP BY s, pos // 16),
{tree}n{k + 1} AS (SELECT s, up AS pos, CASE WHEN more THEN sha256(array_to_string(run, '')) ELSE run[1] END AS digest FROM {tree}r{k}),
{tree}f{k + 1} AS (SELECT f.r, f.s, f.pos // 16 AS pos,
    CASE WHEN more THEN sha256(array_to_string(run[1:f.pos % 16] || [now] || run[f.pos % 16 + 2:], '')) ELSE now END AS now,
    CASE WHEN more THEN sib || array_to_string(run[1:f.pos % 16] || run[f.pos % 16 + 2:], '') ELSE sib END AS sib
  FROM {tree}f{k} f JOIN {tree}r{k} t ON f.s IS NOT DISTINCT FROM t.s AND f.pos // 16 = t.up)"""
    return out


def _half_bytes() -> list[int]:
    """What crc32 makes of each half byte, by the reversed polynomial."""
    out = list(range(16))
    for _ in range(4):
        out = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in out]
    return out


OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, sha256({_fields("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
    sha256({_fields("doc_id", "source", "lang", "n_chars", f"translate(text, '{merkle.UPPER}', '{merkle.UPPER.lower()}')")}) AS tampered,
    xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0])),
      lambda a, v: xor(({_half_bytes()}::BIGINT[])[(xor(a, v) & 15) + 1], xor(a, v) >> 4))) AS crc FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
{_levels("a", "SELECT source AS s, pos, leaf AS digest FROM p", "SELECT r, source AS s, pos, CASE WHEN crc % 5 = 0 THEN tampered ELSE leaf END AS now, '' AS sib FROM p", 7)},
u AS (SELECT s, digest, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS pos FROM an7),
{_levels("b", "SELECT 0 AS s, pos, digest FROM u", "SELECT f.r, 0 AS s, u.pos, f.now, f.sib FROM af7 f JOIN u ON f.s IS NOT DISTINCT FROM u.s", 4)}
SELECT p.doc_id, p.source, p.leaf, u.digest AS subroot, (SELECT digest FROM bn4) AS root, sha256(f.sib) AS proof_sha256, f.now AS folded_root, f.now = (SELECT digest FROM bn4) AS verified
FROM p JOIN bf4 f ON p.r = f.r JOIN u ON p.source IS NOT DISTINCT FROM u.s
"""


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return language.identify(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return crosstoken.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_simhash": op2_simhash, "op3_toxicity": op3_toxicity, "op4_line_dedup": op4_line_dedup, "op5_embedding_dedup": op5_embedding_dedup, "op6_mix_sources": op6_mix_sources, "op7_pack": op7_pack, "op8_nearest": op8_nearest, "op9_html_text": op9_html_text, "op10_lm_score": op10_lm_score, "op11_merkle_manifest": op11_merkle_manifest, "op12_language": op12_language, "op13_token_alignment": op13_token_alignment}
ORACLES = {"op4_line_dedup": OP4, "op6_mix_sources": OP6, "op10_lm_score": OP10, "op11_merkle_manifest": OP11}
