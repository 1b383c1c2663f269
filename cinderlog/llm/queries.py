"""The queries of these operators: each applies one to its whole table."""

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.llm import bpe, decontaminate, licenses, neardup, negatives, packing, quality, repacking, runs, sharding, suffixes, transcripts, warc
from cinderlog.llm.workers import with_workers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = "byte_bpe_50k.tiktoken"
SHARDS = 40
#: Free in the rank file: closes a text.
END_ID = 50256


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = with_workers(run)
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


UPPER_LOWER = f"'{licenses.UPPER}', '{licenses.LOWER}'"


def _phrase_places(phrase: str) -> str:
    here = " AND ".join(f"ws[i + {k + 1}] = '{word}'" for k, word in enumerate(phrase.split()))
    return f"list_filter(range(len(ws)), lambda i: {here})"


def _notice_rows() -> str:
    sets = [(label, sorted(set(words.split()))) for label, words in licenses.NOTICES]
    return ", ".join(f"('{label}', {words}, {licenses.needed(len(words), licenses.CONTAINMENT)})" for label, words in sets)


OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, translate(coalesce(text, ''), {UPPER_LOWER}) AS t FROM documents),
w AS (SELECT id, doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
b AS (SELECT id, doc_id, len(ws) AS n_words, {", ".join(f"{_phrase_places(p)} AS p{k}" for k, (p, _) in enumerate(licenses.PHRASES))} FROM w),
f AS (SELECT *, list_concat(p0, p1, p2) AS places,
  list_filter([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(licenses.PHRASES))}], lambda x: x IS NOT NULL) AS base FROM b),
q AS (SELECT id, ws, label, notice, need FROM w, (VALUES {_notice_rows()}) n(label, notice, need) WHERE len(list_intersect(ws, notice)) >= need),
k AS (SELECT id, label, notice, need, ws[i:i + {licenses.block_words() - 1}] AS words FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM q) e),
m AS (SELECT id, list(DISTINCT label) AS more, max(shared / len(notice)) AS best FROM (
  SELECT id, label, notice, need, len(list_intersect(words, notice)) AS shared FROM k) x WHERE shared >= need GROUP BY id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(CAST(best AS DOUBLE), CAST(0 AS DOUBLE)) END AS score
FROM f LEFT JOIN m ON f.id = m.id
"""


@query("op1_license_scan", OP1_SQL)
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op2_byte_pair_codec")
def byte_pair_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query("op3_robust_outliers")
def robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


OP4_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0) e),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.v FROM r JOIN b ON b.u = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query("op4_near_duplicates", OP4_SQL)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d) e),
m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT w.doc_id, w.i FROM w JOIN m ON w.s = m.s WHERE m.low < w.doc_id),
b AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM c) e),
n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE p > before + 1 OR before IS NULL) AS n_spans
      FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM b) e GROUP BY doc_id),
k AS (SELECT a.doc_id, string_agg(a.h, '' ORDER BY a.p) AS kept
      FROM (SELECT doc_id, p, substr(x, 2 * p + 1, 2) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2)) AS p FROM d) e) a
      LEFT JOIN b ON a.doc_id = b.doc_id AND a.p = b.p WHERE b.p IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""


@query("op5_repeated_strings", OP5_SQL)
def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS original
           FROM (SELECT page_id, coalesce(html, '') AS h FROM pages) p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM d
"""


@query("op6_warc_chunks", OP6_SQL)
def warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


#: Ways of marking a speaker, one for each transcript: what stands before a message of each role.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "Instructions: ", "user": "Human: ", "assistant": "AI: "},
    {"system": "### System:\n", "user": "### Question:\n", "assistant": "### Answer:\n"},
    {"system": "Note: ", "user": "Q: ", "assistant": "A: "},
    {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>"},
)


def transcript_parts(conversations: DataFrame) -> DataFrame:
    """The messages as raw transcripts show them: with a marker of the transcript's style, or now and then with none."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    marker = F.lit("")
    for no, names in enumerate(STYLES):
        for role, shown in names.items():
            marker = F.when((style == no) & (F.col("role") == role), F.lit(shown)).otherwise(marker)
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(16)) == 0
    text = F.when(bare, F.col("text")).otherwise(F.concat(marker, F.coalesce("text", F.lit(""))))
    return conversations.select("conv_id", "turn", "role", text.alias("text"))


@query("op7_transcript_roles")
def transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on four of five conversations; the roles of all are recovered from the text alone."""
    parts = transcript_parts(table(spark, sf_dir, "conversations"))
    held_out = F.pmod(F.xxhash64("conv_id", F.lit("fold")), F.lit(5)) == 0
    model = transcripts.fit(parts.where(~held_out))
    return transcripts.parse(parts, model).withColumn("held_out", held_out)


@query("op8_benchmark_leaks")
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_packed_rows")
def packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, END_ID)


@query("op10_jump_sharding")
def jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARDS)


def with_echo(name: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten, by the check sum of its id, repeats a part of itself to its end."""
    code = zlib.crc32(b"" if name is None else b"%d" % name)
    n = len(words)
    if code % 10 or not n:
        return words
    g = code // 10
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    part = words[at : at + period]
    return words[:at] + (part * (-(-(n - at) // period)))[: n - at]


def _by_exponent(a: Column, b: Column) -> Column:
    """Order of runs by length/period downwards, then start, then period, in whole numbers."""
    longer = F.signum(b["length"] * a["period"] - a["length"] * b["period"])
    later = F.signum(a["start"] - b["start"])
    return F.when(longer != 0, longer).when(later != 0, later).otherwise(F.signum(a["period"] - b["period"])).cast("int")


@query("op11_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), prepare=with_echo)
    best = F.get(F.array_sort("runs", _by_exponent), 0)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query("op12_hard_negatives", OP12_SQL)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


@query("op13_certified_packing")
def certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = repacking.repack(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset", "gap")
