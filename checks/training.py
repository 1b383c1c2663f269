"""Training-set preparation and feature engineering."""

from pyspark.sql import functions as F

from checks.lines import BGL, BGL_LABEL, HDFS, HDFS_LABEL, TRAINER, _g, _lines, respelled
from checks.registry import bgl_hour, check, hdfs_hour, mask
from checks.views import documents, table, view
from cinderlog.functions import text
from cinderlog.functions.ordering import RowOrder, column_order, number_rows
from cinderlog.operators import features, forest, parse, prep
from cinderlog.plans import retrain
from cinderlog.sources import corrections, staging, training

SEED = 42
CHUNK = 700


def _order():
    return column_order("line_no", CHUNK)


# Oracle pieces -----------------------------------------------------------------


def md5_of(seed: str, *key: str) -> str:
    parts = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"md5({parts} || ':{seed}')"


def unit(seed: str, *key: str) -> str:
    return (
        f"CAST(CAST('0x' || substr({md5_of(seed, *key)}, 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE"
    )


LABELLED = f"""
hdfs AS (SELECT line_no, level, message, {HDFS_LABEL} AS label, hour, 'HDFS' AS service FROM (
  SELECT line_no, {respelled(_g(HDFS, 1), TRAINER)} AS level, {mask(_g(HDFS, 2))} AS message, {hdfs_hour('raw')} AS hour
  FROM log_lines WHERE regexp_matches(raw, '{HDFS}')) h),
bgl AS (SELECT line_no, level, message, {BGL_LABEL} AS label, hour, service FROM (
  SELECT line_no, upper({_g(BGL, 1)}) AS flag, {_g(BGL, 3)} AS service, {respelled(_g(BGL, 4), TRAINER)} AS level,
    {mask(_g(BGL, 5))} AS message, {bgl_hour('raw')} AS hour FROM log_lines WHERE regexp_matches(raw, '{BGL}')) b),
marked AS (SELECT *, label = 'Normal' AND {unit('42-pick', 'line_no')} < 0.05 AS chosen FROM bgl),
rows AS (SELECT line_no, level, service, message, CASE WHEN chosen THEN 'TemporalAnomaly' ELSE label END AS label,
  CASE WHEN chosen THEN CAST(floor({unit('42-hour', 'line_no')} * 6) AS INTEGER) ELSE hour END AS hour FROM marked)
"""
WITH_ROWS = f"WITH {LABELLED}"


def _labelled(spark, d, dataset="BGL"):
    return prep.label_lines(_lines(spark, d).select("line_no", "raw"), dataset)


def rows(spark, d):
    """Augmented BGL training rows."""
    return prep.augment_temporal(_labelled(spark, d), "line_no", seed=SEED)


# Preparation -------------------------------------------------------------------


@check(
    "D1_augment_temporal",
    "log_lines",
    f"{WITH_ROWS} SELECT line_no, level, service, message, label, hour FROM rows",
)
def augmented(spark, d):
    return rows(spark, d)


@check(
    "D1_hdfs_rows",
    "log_lines",
    f"{WITH_ROWS} SELECT line_no, level, service, message, label, hour FROM hdfs",
)
def hdfs_rows(spark, d):
    return _labelled(spark, d, "HDFS")


@check(
    "D2_class_caps",
    "log_lines",
    f"""{WITH_ROWS}
    SELECT dataset, line_no, label FROM (SELECT dataset, line_no, label, row_number() OVER (PARTITION BY dataset, label = 'Normal' ORDER BY line_no) AS rn
      FROM (SELECT 'BGL' AS dataset, line_no, label FROM rows UNION ALL SELECT 'HDFS', line_no, label FROM hdfs) b) r
    WHERE rn <= CASE WHEN label = 'Normal' THEN 600 ELSE 250 END
    """,
)
def class_caps(spark, d):
    capped = _per_dataset(spark, d, lambda table: prep.cap_classes(table, _order(), 600, 250))
    return capped.select("dataset", "line_no", "label")


@check(
    "D3_limit_repeats",
    "log_lines",
    f"""{WITH_ROWS}
    SELECT line_no, label, message FROM (SELECT *, row_number() OVER (PARTITION BY label, message ORDER BY line_no) AS rn FROM rows) r
    WHERE rn <= CASE label WHEN 'Normal' THEN 500 WHEN 'SystemFailure' THEN 5000 WHEN 'AppError' THEN 5000 ELSE 50 END
    """,
)
def repeats(spark, d):
    return prep.limit_repeats(rows(spark, d), _order(), "BGL").select("line_no", "label", "message")


@check(
    "D3_limit_repeats_conversations",
    sql="""
    SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS rn FROM conversations) c
    WHERE rn <= CASE role WHEN 'user' THEN 120 ELSE 80 END
    """,
)
def conversation_repeats(spark, d):
    turns = table(spark, d, "conversations").select(
        "conv_id", "turn", "role", F.col("role").alias("label"), F.col("role").alias("message")
    )
    order = column_order("conv_id", 10)
    order = type(order)(order.chunk, F.struct("conv_id", "turn"))
    limit = F.when(F.col("label") == "user", 120).otherwise(80)
    return prep.limit_repeats(turns, order, "BGL", limit).select("conv_id", "turn", "role")


LIMITS = prep.Limits(300, 200, {"HDFS": 40, "BGL": 20}, {"SystemFailure": 30, "AppError": 25}, 7)


def _limited(dataset: str) -> str:
    """Training rows of one dataset under ``LIMITS``, from the labelled rows."""
    repeats = " ".join(f"WHEN '{k}' THEN {v}" for k, v in {"Normal": LIMITS.normal_repeats[dataset], **LIMITS.label_repeats}.items())
    return f"""SELECT '{dataset}' AS dataset, line_no, label, message FROM (
      SELECT *, row_number() OVER (PARTITION BY label, message ORDER BY line_no) AS again FROM (
        SELECT *, row_number() OVER (PARTITION BY label = 'Normal' ORDER BY line_no) AS place FROM {dataset.lower()}_rows) p
      WHERE place <= CASE WHEN label = 'Normal' THEN {LIMITS.normal} ELSE {LIMITS.anomalous} END) c
    WHERE again <= CASE label {repeats} ELSE {LIMITS.other_repeats} END"""


@check(
    "D3_prepared_with_limits",
    "log_lines",
    f"""WITH {LABELLED}, bgl_rows AS (SELECT line_no, label, message FROM rows),
    hdfs_rows AS (SELECT line_no, message, CASE WHEN label = 'Normal' AND {unit('42-pick', 'line_no')} < 0.05 THEN 'TemporalAnomaly' ELSE label END AS label FROM hdfs)
    {_limited('BGL')} UNION ALL {_limited('HDFS')}
    """,
)
def prepared(spark, d):
    """Both training tables under limits of the caller's."""
    lines = _lines(spark, d).select("line_no", "raw")
    tables = [
        prep.prepare(lines, dataset, _order(), "line_no", seed=SEED, limits=LIMITS).withColumn("dataset", F.lit(dataset))
        for dataset in ("BGL", "HDFS")
    ]
    return tables[0].unionByName(tables[1]).select("dataset", "line_no", "label", "message")


@check(
    "D4_shuffle_rows",
    "log_lines",
    f"""{WITH_ROWS}
    SELECT line_no, row_number() OVER (ORDER BY {md5_of('42', 'line_no')}) AS place FROM rows
    """,
)
def shuffled(spark, d):
    """Place of every row in the order that the shuffle gives, file by file of its stored result."""
    stored = staging.materialize(prep.shuffle_rows(rows(spark, d), "line_no", seed=SEED), "shuffled")
    placed = stored.select(
        "line_no",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    order = RowOrder(F.col("file"), F.col("row"))
    return number_rows(placed, order, name="place").select("line_no", F.col("place"))


BOTH = f"{WITH_ROWS}, labelled AS (SELECT 'BGL' AS dataset, line_no, label FROM rows UNION ALL SELECT 'HDFS', line_no, label FROM hdfs)"


def _per_dataset(spark, d, step):
    """What a step gives for the BGL rows and for the HDFS rows."""
    tables = {"BGL": rows(spark, d), "HDFS": _labelled(spark, d, "HDFS")}
    found = [step(table).withColumn("dataset", F.lit(name)) for name, table in tables.items()]
    return found[0].unionByName(found[1])


@check(
    "D5_label_distribution",
    "log_lines",
    f"{BOTH} SELECT dataset, label, count(*) AS rows FROM labelled GROUP BY dataset, label",
)
def label_distribution(spark, d):
    return _per_dataset(spark, d, prep.label_distribution)


RATIO = "avg(CASE WHEN label <> 'Normal' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


@check(
    "D6_anomaly_ratio",
    "log_lines",
    f"{BOTH} SELECT dataset, round({RATIO}, 6) AS anomaly_ratio, {RATIO} < 0.01 AS low_ratio FROM labelled GROUP BY dataset",
)
def anomaly_ratio(spark, d):
    return _per_dataset(spark, d, prep.anomaly_summary).select(
        "dataset", F.round("anomaly_ratio", 6).alias("anomaly_ratio"), "low_ratio"
    )


@check(
    "D7_contamination",
    "log_lines",
    f"""{WITH_ROWS}
    SELECT hour, round(least(greatest({RATIO}, 0.01::DOUBLE), 0.49::DOUBLE), 6) AS contamination FROM rows GROUP BY hour
    """,
)
def contaminations(spark, d):
    ratio = F.avg(F.when(F.col("label") != "Normal", 1.0).otherwise(0.0))
    return rows(spark, d).groupBy("hour").agg(
        F.round(prep.contamination(ratio), 6).alias("contamination")
    )


@check(
    "D8_merge_rare",
    "log_lines",
    f"""{WITH_ROWS}, c AS (SELECT label, count(*) AS n FROM rows GROUP BY label)
    SELECT r.line_no, CASE WHEN c.n < 200 THEN 'UnknownAnomaly' ELSE r.label END AS label FROM rows r JOIN c ON r.label = c.label
    """,
)
def rare_merged(spark, d):
    return prep.merge_rare(rows(spark, d), 200).select("line_no", "label")


@check(
    "D9_stratified_split",
    "log_lines",
    f"""{WITH_ROWS}, c AS (SELECT label, count(*) AS n FROM rows GROUP BY label),
    t AS (SELECT sum(n) AS total, ceil(sum(n) * 0.2::DOUBLE) AS test FROM c),
    q AS (SELECT label, test, floor(test * n / total) AS base, test * n / total - floor(test * n / total) AS rest FROM c, t),
    s AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= test - sum(base) OVER () THEN 1 ELSE 0 END AS n_test FROM q)
    SELECT r.line_no, r.label, row_number() OVER (PARTITION BY r.label ORDER BY {md5_of('42', 'r.line_no')}) <= s.n_test AS is_test
    FROM rows r JOIN s ON r.label = s.label
    """,
)
def stratified_split(spark, d):
    return prep.split_rows(rows(spark, d), "line_no", seed=SEED).select("line_no", "label", "is_test")


@check(
    "D9_hash_split",
    "log_lines",
    f"{WITH_ROWS} SELECT line_no, {unit('42', 'line_no')} < 0.2 AS is_test FROM rows",
)
def hash_split(spark, d):
    return prep.split_rows_by_hash(rows(spark, d), "line_no", seed=SEED).select("line_no", "is_test")


@check(
    "D10_baseline_sample",
    "log_lines",
    f"{WITH_ROWS} SELECT line_no, label FROM rows ORDER BY {md5_of('42', 'line_no')} LIMIT 500",
)
def baseline_sample(spark, d):
    return prep.sample_rows(rows(spark, d), "line_no", n=500, seed=SEED).select("line_no", "label")


CORRECTED = f"""
items AS (SELECT payload_id, unnest(CAST(payload AS JSON[])) AS item FROM corrections_json),
given AS (SELECT payload_id,
    coalesce(nullif(item->>'rawLog', ''), nullif(item->>'raw_log', ''), nullif(item->>'RawLog', '')) AS raw_log,
    coalesce(nullif(item->>'proposedLabel', ''), nullif(item->>'proposed_label', ''), nullif(item->>'ProposedLabel', ''), 'Normal') AS label
  FROM items),
corrected AS (SELECT payload_id, 'INFO' AS level, {mask('raw_log')} AS message, label,
    CASE WHEN regexp_matches(raw_log, '^[0-9]') AND (contains(raw_log, 'dfs.') OR (length(raw_log) > 20 AND substr(raw_log, 7, 1) = ' '))
      THEN {hdfs_hour('raw_log')} ELSE {bgl_hour('raw_log')} END AS hour, 'analyst_correction' AS source
  FROM given WHERE raw_log IS NOT NULL)
"""


def _corrections(spark, d):
    return corrections.read_corrections(view(spark, d, "corrections_json"))


@check(
    "D11_combined_training",
    "log_lines corrections_json",
    f"""{WITH_ROWS}, {CORRECTED}
    SELECT level, message, label, hour FROM rows UNION ALL SELECT level, message, label, hour FROM corrected
    """,
)
def combined_training(spark, d):
    return prep.combine_training(rows(spark, d), prep.correction_rows(_corrections(spark, d)))


@check(
    "D12_correction_rows",
    "corrections_json",
    f"WITH {CORRECTED} SELECT payload_id, level, message, label, hour, source FROM corrected",
)
def correction_rows(spark, d):
    return prep.correction_rows(_corrections(spark, d)).drop("item_no")


@check(
    "S5_training_table",
    "log_lines",
    f"""{WITH_ROWS}
    SELECT line_no, level, service, message, label, hour, 'BGL' AS dataset FROM rows UNION ALL
    SELECT line_no, level, service, message, label, hour, 'HDFS' FROM hdfs
    """,
)
def training_table(spark, d):
    path = staging.new_path(spark, "training")
    both = (
        rows(spark, d)
        .withColumn("dataset", F.lit("BGL"))
        .unionByName(_labelled(spark, d, "HDFS").withColumn("dataset", F.lit("HDFS")))
    )
    training.write_training_rows(both, path)
    bgl, hdfs = (training.read_baseline(spark, path, name) for name in ("BGL", "HDFS"))
    return bgl.unionByName(hdfs)


@check(
    "M11_training_frame",
    "log_lines corrections_json",
    f"""{WITH_ROWS}, {CORRECTED},
    mine AS (SELECT c.* FROM corrected c JOIN given g ON c.payload_id = g.payload_id AND g.raw_log IS NOT NULL
      WHERE NOT ((regexp_matches(g.raw_log, '^[0-9]') AND contains(g.raw_log, 'dfs.')) OR contains(g.raw_log, 'blk_')))
    SELECT level, message, label, hour FROM (SELECT * FROM rows ORDER BY {md5_of('42', 'line_no')} LIMIT 2000) b
    UNION ALL SELECT level, message, label, hour FROM mine
    """,
)
def training_frame(spark, d):
    grouped = retrain.group_corrections(_corrections(spark, d)).where("dataset = 'BGL'")
    frame = retrain.training_frame(grouped, rows(spark, d), ["payload_id", "item_no"], ["line_no"])
    return frame.drop("row_key")


@check(
    "M5_class_weights",
    "log_lines",
    f"""{WITH_ROWS}, c AS (SELECT label, count(*) AS rows FROM rows GROUP BY label)
    SELECT label, rows, round((SELECT sum(rows) FROM c) / ((SELECT count(*) FROM c) * rows), 6) AS weight FROM c
    """,
)
def class_weights(spark, d):
    return forest.class_weights(rows(spark, d)).withColumn("weight", F.round("weight", 6))


@check(
    "M8_evaluation",
    "model_out",
    """
    WITH c AS (SELECT DISTINCT true_class AS class FROM model_out UNION SELECT DISTINCT rf_class FROM model_out),
    p AS (SELECT class, count(*) FILTER (WHERE true_class = class AND rf_class = class) AS tp,
        count(*) FILTER (WHERE true_class = class) AS support, count(*) FILTER (WHERE rf_class = class) AS guessed
      FROM c JOIN model_out ON true_class = class OR rf_class = class GROUP BY class),
    m AS (SELECT class, support, tp, coalesce(tp::DOUBLE / nullif(guessed, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall,
      coalesce(2.0::DOUBLE * tp / nullif(guessed + support, 0), 0) AS f1 FROM p)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m
    UNION ALL SELECT 'accuracy', round(sum(tp)::DOUBLE / sum(support), 6), round(sum(tp)::DOUBLE / sum(support), 6),
      round(sum(tp)::DOUBLE / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
      round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m
    """,
)
def evaluation(spark, d):
    report = forest.evaluate(view(spark, d, "model_out"), "true_class", "rf_class")
    return report.select(
        "class", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")], "support"
    )


@check(
    "M6_best_class",
    "model_out",
    """
    SELECT line_no, CASE WHEN a >= b AND a >= c THEN 'AppError' WHEN b >= c THEN 'Normal' ELSE 'SystemFailure' END AS best
    FROM (SELECT line_no, round(rf_confidence, 1) AS a, round(1 - rf_confidence, 1) AS b, round(iso_decision + 0.5::DOUBLE, 1) AS c FROM model_out) p
    """,
)
def best_classes(spark, d):
    shares = F.array(
        F.round("rf_confidence", 1),
        F.round(1 - F.col("rf_confidence"), 1),
        F.round(F.col("iso_decision") + 0.5, 1),
    )
    outputs = view(spark, d, "model_out").withColumn("p", shares)
    return outputs.select(
        "line_no",
        forest.best_class(F.col("p"), ["AppError", "Normal", "SystemFailure"]).alias("best"),
    )


# Features ----------------------------------------------------------------------

WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_\p{M}]+"


def grams_sql(source: str, key: str, message: str) -> str:
    return f"""
words AS (SELECT {key} AS key, regexp_extract_all(lower({message}), '{WORD}') AS w FROM {source}),
grams AS (SELECT key, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
  ELSE [] END)) AS term FROM words),
vocab AS (SELECT term, df, idf, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx FROM (
  SELECT term, count(*) AS tf, count(DISTINCT key) AS df,
    ln((1 + (SELECT count(*) FROM words)) / (1 + count(DISTINCT key))) + 1 AS idf FROM grams GROUP BY term
  ORDER BY tf DESC, term LIMIT {{n}}) t)
"""


def top(grams: str, n: int) -> str:
    return grams.replace("{n}", str(n))


LINE_GRAMS = grams_sql("(SELECT line_no, " + mask("raw") + " AS masked FROM log_lines) m", "line_no", "masked")
DOC_GRAMS = grams_sql("documents", "doc_id", "text")


def _masked(spark, d):
    return _lines(spark, d).select("line_no", text.mask(F.col("raw")).alias("message"))


def _documents(spark, d):
    return documents(spark, d).select("doc_id", F.col("text").alias("message"))


@check(
    "F1_vocabulary",
    "log_lines",
    f"WITH {top(LINE_GRAMS, 150)} SELECT idx, term, df, round(idf, 6) AS idf FROM vocab",
)
def vocabulary(spark, d):
    fitted = features.fit_vocabulary(_masked(spark, d), max_features=150)
    return fitted.to_frame(spark).withColumn("idf", F.round("idf", 6))


@check(
    "F1_vocabulary_documents",
    sql=f"WITH {top(DOC_GRAMS, 1000)} SELECT idx, term, df, round(idf, 6) AS idf FROM vocab",
)
def document_vocabulary(spark, d):
    fitted = features.fit_vocabulary(_documents(spark, d))
    return fitted.to_frame(spark).withColumn("idf", F.round("idf", 6))


def weights_sql(grams: str, key: str) -> str:
    return f"""WITH {grams},
    w AS (SELECT key, idx, (1 + ln(count(*))) * any_value(idf) AS w FROM grams g JOIN vocab v ON g.term = v.term GROUP BY key, idx)
    SELECT key AS {key}, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY key)), 6) AS weight FROM w"""


@check("F2_tfidf", "log_lines", weights_sql(top(LINE_GRAMS, 150), "line_no"))
def tfidf(spark, d):
    messages = _masked(spark, d)
    fitted = features.fit_vocabulary(messages, max_features=150)
    return features.tfidf_entries(messages, fitted, "line_no").withColumn(
        "weight", F.round("weight", 6)
    )


@check("F2_tfidf_documents", sql=weights_sql(top(DOC_GRAMS, 300), "doc_id"))
def document_tfidf(spark, d):
    docs = _documents(spark, d)
    fitted = features.fit_vocabulary(docs, max_features=300)
    return features.tfidf_entries(docs, fitted, "doc_id").withColumn("weight", F.round("weight", 6))


def time_sql(inputs: str) -> str:
    return f"""
    SELECT line_no, round(least(greatest(coalesce(date_diff('microsecond', lag(ts) OVER w, ts) / 1e6::DOUBLE, 0), 0), 3600), 6) AS time_delta,
      CAST(coalesce(hour(ts), 0) AS INTEGER) AS ts_hour
    FROM (SELECT line_no, file, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING),
        first_value(t IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ts
      FROM ({inputs}) i) f
    WINDOW w AS (PARTITION BY file ORDER BY line_no)
    """


STANDARD_TIME = (
    "SELECT line_no, file_id AS file, TRY_CAST(regexp_extract(raw, '^\\d{4}-\\d{2}-\\d{2}\\s+\\d{2}:\\d{2}:\\d{2}') AS TIMESTAMP) AS t"
    " FROM log_lines"
)


@check("F3_time_features", "log_lines", time_sql(STANDARD_TIME))
def time_features(spark, d):
    parsed = parse.parse_generic(_lines(spark, d))
    timed = features.time_features(parsed, column_order("line_no", 333), "file_id")
    return timed.select("line_no", F.round("time_delta", 6).alias("time_delta"), "ts_hour")


@check(
    "F3_time_features_users",
    sql=time_sql(
        "SELECT event_id AS line_no, user_id AS file, CASE WHEN event_type <> 'view' THEN ts END AS t FROM events"
    ),
)
def user_time_features(spark, d):
    events = table(spark, d, "events").select(
        F.col("event_id").alias("line_no"),
        F.col("user_id").alias("file"),
        F.when(F.col("event_type") != "view", F.col("ts")).alias("timestamp"),
    )
    timed = features.time_features(events, column_order("line_no", 501))
    return timed.select("line_no", F.round("time_delta", 6).alias("time_delta"), "ts_hour")


def names_sql(shift: int, numeric: str) -> str:
    terms = f"SELECT CAST(idx + {shift} AS INTEGER) AS idx, term AS name FROM vocab"
    return f"WITH {top(LINE_GRAMS, 150)} {terms} UNION ALL {numeric}"


@check(
    "F4_served_layout",
    "log_lines",
    f"""{WITH_ROWS}, {top(grams_sql('rows', 'line_no', 'message'), 80)},
    tw AS (SELECT key, idx, (1 + ln(count(*))) * any_value(idf) AS w FROM grams g JOIN vocab v ON g.term = v.term GROUP BY key, idx)
    SELECT key AS line_no, idx + 2 AS idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY key)), 6) AS value FROM tw
    UNION ALL SELECT line_no, 0, CASE level WHEN 'CRITICAL' THEN 0 WHEN 'DEBUG' THEN 1 WHEN 'ERROR' THEN 2 WHEN 'INFO' THEN 3 WHEN 'WARNING' THEN 5 ELSE 4 END::DOUBLE FROM rows
    UNION ALL SELECT line_no, 1, round(CASE WHEN hour = -1 THEN 0.5 ELSE hour / 23.0::DOUBLE END, 6) FROM rows
    """,
)
def served_layout(spark, d):
    training_rows = rows(spark, d)
    fitted = features.fit_vocabulary(training_rows, max_features=80)
    return _cells(features.served_features(training_rows, fitted))


def _cells(featured):
    cells = F.arrays_zip("features.indices", "features.values")
    return featured.select("line_no", F.explode(cells).alias("c")).select(
        "line_no", F.col("c.indices").alias("idx"), F.round("c.values", 6).alias("value")
    )


@check(
    "F5_layered_layout",
    "log_lines",
    f"""
    WITH times AS ({time_sql(STANDARD_TIME)}), {top(grams_sql('log_lines', 'line_no', mask('raw')), 60)},
    tw AS (SELECT key, idx, (1 + ln(count(*))) * any_value(idf) AS w FROM grams g JOIN vocab v ON g.term = v.term GROUP BY key, idx)
    SELECT key AS line_no, idx + 3 AS idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY key)), 6) AS value FROM tw
    UNION ALL SELECT line_no, 0, 3::DOUBLE FROM log_lines
    UNION ALL SELECT line_no, 1, round(time_delta, 6) FROM times
    UNION ALL SELECT line_no, 2, ts_hour::DOUBLE FROM times
    """,
)
def layered_layout(spark, d):
    parsed = parse.parse_generic(_lines(spark, d)).drop("message", "level")
    timed = features.time_features(parsed, column_order("line_no", 333), "file_id")
    messages = timed.withColumns({"message": text.mask(F.col("raw")), "level": F.lit("INFO")})
    fitted = features.fit_vocabulary(messages, max_features=60)
    return _cells(features.layered_features(messages, fitted))


@check(
    "F6_feature_names",
    "log_lines",
    names_sql(
        2,
        "SELECT 0, 'level_encoded' UNION ALL SELECT 1, 'log_hour'",
    ),
)
def feature_names(spark, d):
    fitted = features.fit_vocabulary(_masked(spark, d), max_features=150)
    return features.feature_names(spark, fitted)


@check(
    "F6_layered_names",
    "log_lines",
    names_sql(
        3,
        "SELECT 0, 'level_encoded' UNION ALL SELECT 1, 'time_delta_sec' UNION ALL SELECT 2, 'hour'",
    ),
)
def layered_names(spark, d):
    fitted = features.fit_vocabulary(_masked(spark, d), max_features=150)
    return features.feature_names(spark, fitted, features.LAYERED_NUMERIC)
