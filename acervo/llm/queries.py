"""Registered queries of the thirteen operators: ``opN_<name>(spark, sf_dir)`` and their SQL.

Each query applies its operator, with production parameters, to its whole table
and derives the contract's columns from what the operator returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm import codebooks, crosspolytope, lexicon, minhash, mixing, quality, site_lines, sst, superkmer, tiling, toxicity, url_filter, whitening

#: Fixed values of the url contract: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer file lies on this machine (the package is on every node)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sst.token_shards(docs, tokenizer_file(), end_id=2)


def op2_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return site_lines.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "text")


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_crosspolytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_superkmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexicon.bpe_encode(docs, tokenizer_file())


def op8_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.url_filter(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tiling.find_leaks(docs, table(spark, sf_dir, "benchmark"))


def op11_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component; a deviation that does not fit a long is null."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    long = rows.withColumn("deviation", F.col("deviation").try_cast("long")).select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op12_part_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = codebooks.compress(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", F.col("label_error").cast("long").alias("label_error"), "codebooks_sha256")


def op13_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def line_dedup_sql(docs: str) -> str:
    """DuckDB SQL of :func:`site_lines.line_dedup`: ``docs`` plus n_lines, n_dropped, new_text."""
    return f"""
    pages AS (SELECT *, row_number() OVER () AS row_id FROM {docs}),
    lines AS (SELECT row_id, source, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM pages),
    total AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
    bad AS (SELECT l.source, l.line FROM lines l JOIN total t ON l.source IS NOT DISTINCT FROM t.source
            WHERE trim(l.line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
            GROUP BY l.source, l.line, t.n
            HAVING count(DISTINCT l.row_id) >= 5 AND count(DISTINCT l.row_id)::DOUBLE / t.n > 0.1),
    judged AS (SELECT l.*, b.line IS NOT NULL AS drop_it FROM lines l
               LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line),
    rebuilt AS (SELECT row_id, count(*) AS n_lines, count(*) FILTER (drop_it) AS n_dropped,
                       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop_it), '') AS new_text
                FROM judged GROUP BY row_id),
    cleaned AS (SELECT p.* EXCLUDE (text), CASE WHEN p.text IS NULL THEN NULL ELSE r.new_text END AS text,
                       coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_dropped, 0) AS n_dropped
                FROM pages p LEFT JOIN rebuilt r USING (row_id))"""


OP3_SQL = f"WITH {line_dedup_sql('documents')} SELECT doc_id, n_lines, n_dropped, text FROM cleaned"

OP9_SQL = """
WITH parts AS (
    SELECT page_id,
           CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
named AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM parts),
rules(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
    SELECT n.host, n.path, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule,
           arg_max(r.rverdict, length(r.rhost || r.rpath)) AS verdict
    FROM (SELECT DISTINCT host, path FROM named) n
    JOIN rules r ON (n.host = r.rhost OR ends_with(n.host, '.' || r.rhost)) AND starts_with(n.path, r.rpath)
    GROUP BY n.host, n.path)
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM named n LEFT JOIN fits f ON n.host = f.host AND n.path = f.path"""

QUERIES = {
    "op1_token_shards": op1_token_shards,
    "op2_minhash_hamming": op2_minhash_hamming,
    "op3_site_lines": op3_site_lines,
    "op4_quality_gam": op4_quality_gam,
    "op5_crosspolytope": op5_crosspolytope,
    "op6_superkmer": op6_superkmer,
    "op7_bpe_lexicon": op7_bpe_lexicon,
    "op8_toxicity_trees": op8_toxicity_trees,
    "op9_url_filter": op9_url_filter,
    "op10_string_tiling": op10_string_tiling,
    "op11_tsqr_whitening": op11_tsqr_whitening,
    "op12_part_codebooks": op12_part_codebooks,
    "op13_fair_mixing": op13_fair_mixing,
}

OP13_SQL = r"""
WITH sized AS (
    SELECT row_number() OVER () AS row_id, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
totals AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
capped AS (SELECT *, ([3, 1, 2])[(place - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM totals),
ordered AS (
    SELECT row_number() OVER below AS k, sum(cap) OVER below AS full_caps, sum(weight) OVER () - sum(weight) OVER below AS open_weights, lead(cap::DOUBLE / weight) OVER below AS next_ratio
    FROM capped WINDOW below AS (ORDER BY cap::DOUBLE / weight, place ROWS UNBOUNDED PRECEDING)),
levels AS (
    SELECT 0 AS k, 1.5 * (SELECT sum(source_size) FROM totals) / (SELECT sum(weight) FROM capped) AS level, (SELECT min(cap::DOUBLE / weight) FROM capped) AS next_ratio
    UNION ALL
    SELECT k, (1.5 * (SELECT sum(source_size) FROM totals) - full_caps) / open_weights, next_ratio FROM ordered WHERE open_weights > 0),
level AS (SELECT arg_min(level, k)::DOUBLE AS level FROM levels WHERE level <= next_ratio),
aimed AS (SELECT source, place, source_size, least(weight * level, cap::DOUBLE) AS target FROM capped, level),
queued AS (
    SELECT s.row_id, a.place, a.target, s.size, t.turn, md5(coalesce(s.doc_id::VARCHAR, '') || '/' || t.turn) AS drawn
    FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source, (VALUES (0), (1)) t(turn) WHERE s.size > 0),
served AS (
    SELECT *, sum(size) OVER (PARTITION BY place ORDER BY turn, drawn, size, row_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM queued),
pieces AS (
    SELECT *, least(size, greatest(0, floor(target)::BIGINT - (upto - size))) AS n, floor(target) / target AS finish, true AS inside FROM served WHERE upto > floor(target) AND upto - size < floor(target)
    UNION ALL
    SELECT *, upto - floor(target)::BIGINT, upto / target, false FROM served WHERE upto > floor(target) AND upto - size < floor(target)
    UNION ALL
    SELECT *, size, upto / target, false FROM served WHERE NOT (upto > floor(target) AND upto - size < floor(target))),
mixed AS (SELECT *, sum(n) OVER (ORDER BY finish, place, turn, drawn, size, row_id ROWS UNBOUNDED PRECEDING)::BIGINT - n AS before FROM pieces),
taken AS (SELECT row_id, sum(greatest(0, least(n, (SELECT floor(1.5 * sum(source_size))::BIGINT FROM totals) - before)))::BIGINT AS taken FROM mixed GROUP BY row_id)
SELECT s.doc_id, s.size::BIGINT AS size, a.source_size, a.target, coalesce(t.taken, 0) AS taken
FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source LEFT JOIN taken t USING (row_id)"""

ORACLES = {
    "op13_fair_mixing": OP13_SQL,
    "op3_site_lines": OP3_SQL,
    "op9_url_filter": OP9_SQL,
}
