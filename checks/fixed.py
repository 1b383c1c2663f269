"""A bundle whose forests follow from a rule, so that SQL can walk the same trees.

Trees are complete down to ``DEPTH`` but for some early leaves; node n has the children 2n + 1 and
2n + 2.  Features, thresholds, path lengths and class shares are arithmetic on (tree, node, salt).
"""

import math

import pandas as pd

from checks.registry import hour, mask, routed, rule
from checks.training import WORD
from cinderlog.functions import kernels
from cinderlog.operators import features, forest, iforest
from cinderlog.sources.models import NUMERIC, ModelBundle

DEPTH = 4
NODES = 2 ** (DEPTH + 1) - 1
ISO_TREES, CLASS_TREES = 6, 5
SAMPLE = 256
OFFSET = -0.8123
CLASSES = ["AppError", "HardwareFailure", "Normal", "SystemFailure"]
DOCUMENTS = 1000
# Terms of the derived log lines, by dataset.
TERMS = {
    "BGL": ("app", "info", "kernel", "ms", "num", "num num", "processed in", "r02", "ras", "ras kernel", "reading", "replica", "request"),
    "HDFS": ("blk", "block", "dfs", "fsnamesystem", "info", "ip", "missing on", "num", "packetresponder", "size num", "src"),
}
SALTS = {"BGL": 3, "HDFS": 8}


def _leaf(tree: int, node: int) -> bool:
    return node >= NODES // 2 or (node >= 7 and (tree * 3 + node) % 4 == 0)


def _reached(tree: int) -> list[int]:
    nodes = [0]
    for node in nodes:
        if not _leaf(tree, node):
            nodes += [2 * node + 1, 2 * node + 2]
    return sorted(nodes)


def _threshold(tree: int, node: int, feature: int, salt: int, dense: bool) -> float:
    """Level codes need whole steps, weights and hours lie from 0 to 1, dense vectors on both sides of 0."""
    if dense:
        return ((tree * 31 + node * 17 + salt) % 21 - 10) / 41.0
    if feature == 0:
        return (tree + node) % 5 + 0.5
    return (tree * 31 + node * 17 + salt) % 23 / 41.0


def node_rows(trees: int, size: int, salt: int, dense: bool = False) -> pd.DataFrame:
    """All nodes with both kinds of leaf values."""
    rows = []
    for tree in range(trees):
        kept = _reached(tree)
        place = {node: i for i, node in enumerate(kept)}
        for node in kept:
            feature = -1 if _leaf(tree, node) else (tree * 7 + node * 5 + salt) % size
            raw = [(tree * 5 + node * 3 + c * 7 + salt) % 11 + 1.0 for c in range(len(CLASSES))]
            inner = feature >= 0
            rows.append(
                (
                    tree,
                    place[node],
                    feature,
                    _threshold(tree, node, feature, salt, dense) if inner else 0.0,
                    place[2 * node + 1] if inner else -1,
                    place[2 * node + 2] if inner else -1,
                    1.0 + (tree * 13 + node * 7 + salt) % 29 / 8.0,
                    [x / sum(raw) for x in raw],
                    float(NODES - node),
                )
            )
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "path", "shares", "cover"])


def isolation_forest(size: int, salt: int, dense: bool = False) -> iforest.IsolationForestModel:
    nodes = node_rows(ISO_TREES, size, salt, dense).drop(columns=["shares", "cover"])
    return iforest.IsolationForestModel(nodes, SAMPLE, size, OFFSET)


def class_forest(size: int, salt: int, dense: bool = False) -> forest.ForestTable:
    return forest.ForestTable(node_rows(CLASS_TREES, size, salt, dense).drop(columns="path"), size)


def bundle(dataset: str, layout: str = "served") -> ModelBundle:
    terms = TERMS[dataset]
    size, salt = len(NUMERIC[layout]) + len(terms), SALTS[dataset]
    counts = tuple(3 + 17 * i for i in range(len(terms)))
    vocabulary = features.Vocabulary(terms, counts, DOCUMENTS)
    return ModelBundle(dataset, layout, vocabulary, isolation_forest(size, salt), class_forest(size, salt), CLASSES)


def bundles() -> dict[str, ModelBundle]:
    return {dataset: bundle(dataset) for dataset in TERMS}


# SQL ------------------------------------------------------------------------------

SHARES = ", ".join(f"(tree * 5 + node * 3 + {c * 7} + salt) % 11 + 1 AS r{c}" for c in range(len(CLASSES)))


def nodes_sql(models: list[tuple[str, int, int]], dense: bool = False) -> str:
    """Nodes of (model, size, salt): model, kind, tree, node, feature, threshold, path, s0, s1, ..."""
    values = ", ".join(f"('{m}', {size}, {salt})" for m, size, salt in models)
    step = "(tree * 31 + node * 17 + salt)"
    threshold = (
        f"({step} % 21 - 10) / 41.0::DOUBLE"
        if dense
        else f"CASE WHEN f = 0 THEN (tree + node) % 5 + 0.5::DOUBLE ELSE {step} % 23 / 41.0::DOUBLE END"
    )
    total = " + ".join(f"r{c}" for c in range(len(CLASSES)))
    shares = ", ".join(f"r{c}::DOUBLE / ({total}) AS s{c}" for c in range(len(CLASSES)))
    return f"""
    SELECT model, kind, tree, node, CASE WHEN leaf THEN -1 ELSE f END AS feature, CASE WHEN NOT leaf THEN {threshold} END AS threshold,
      1.0::DOUBLE + (tree * 13 + node * 7 + salt) % 29 / 8.0::DOUBLE AS path, {shares}
    FROM (SELECT *, (tree * 7 + node * 5 + salt) % size AS f, node >= {NODES // 2} OR (node >= 7 AND (tree * 3 + node) % 4 = 0) AS leaf, {SHARES}
      FROM (VALUES {values}) m(model, size, salt), (VALUES ('iso', {ISO_TREES}), ('class', {CLASS_TREES})) k(kind, trees),
        range({max(ISO_TREES, CLASS_TREES)}) t(tree), range({NODES}) n(node) WHERE tree < trees) x
    """


NORM = repr(float(kernels.average_path(SAMPLE)))


def best_sql(shares: list[str]) -> str:
    """First class in order with the largest share."""
    most = f"greatest({', '.join(shares)})"
    whens = " ".join(f"WHEN {s} = {most} THEN '{c}'" for s, c in zip(shares, CLASSES, strict=True))
    return f"CASE {whens} END AS rf_class, {most} AS rf_confidence"


MEANS = [f"avg(s{c})" for c in range(len(CLASSES))]


def outputs_sql(rows: str, cells: str, nodes: str) -> str:
    """CTEs ``iso`` and ``classed`` from rows (key, model), cells (key, feature, v) and nodes: trees walked by a recursive query."""
    return f"""
    nodes AS ({nodes}), cells AS ({cells}),
    walk AS (SELECT key, r.model, kind, tree, 0::BIGINT AS node FROM ({rows}) r JOIN (SELECT DISTINCT model, kind, tree FROM nodes) t ON r.model = t.model
      UNION ALL SELECT w.key, w.model, w.kind, w.tree, 2 * w.node + CASE WHEN coalesce(c.v, 0) <= n.threshold THEN 1 ELSE 2 END
      FROM walk w JOIN nodes n ON n.model = w.model AND n.kind = w.kind AND n.tree = w.tree AND n.node = w.node AND n.feature >= 0
      LEFT JOIN cells c ON c.key = w.key AND c.feature = n.feature),
    ends AS (SELECT w.key, n.* FROM walk w JOIN nodes n ON n.model = w.model AND n.kind = w.kind AND n.tree = w.tree AND n.node = w.node AND n.feature = -1),
    iso AS (SELECT key, -power(2, -avg(path) / {NORM}::DOUBLE) - ({OFFSET}::DOUBLE) AS if_decision FROM ends WHERE kind = 'iso' GROUP BY key),
    means AS (SELECT key, {", ".join(f"{m} AS m{c}" for c, m in enumerate(MEANS))} FROM ends WHERE kind = 'class' GROUP BY key),
    classed AS (SELECT *, {best_sql([f"m{c}" for c in range(len(CLASSES))])} FROM means)
    """


def weights_sql(rows: str, shift: int) -> str:
    """CTEs ``weights`` (key, feature, v): TF-IDF of rows (key, model, masked) by the fixed vocabularies."""
    values = ", ".join(
        f"('{d}', {i + shift}, '{term}', ln({1 + DOCUMENTS} / {4 + 17 * i}.0::DOUBLE) + 1)" for d in TERMS for i, term in enumerate(TERMS[d])
    )
    return f"""
    terms(model, feature, term, idf) AS (VALUES {values}),
    worded AS (SELECT key, model, regexp_extract_all(lower(masked), '{WORD}') AS w FROM ({rows}) t),
    grams AS (SELECT key, model, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
      ELSE [] END)) AS term FROM worded),
    counted AS (SELECT key, feature, (1 + ln(count(*))) * any_value(idf) AS x FROM grams g JOIN terms v ON g.model = v.model AND g.term = v.term GROUP BY key, feature),
    weights AS (SELECT key, feature, x / sqrt(sum(x * x) OVER (PARTITION BY key)) AS v FROM counted)
    """


def served_models() -> list[tuple[str, int, int]]:
    return [(d, len(NUMERIC["served"]) + len(TERMS[d]), SALTS[d]) for d in TERMS]


#: Level INFO's code.
INFO_CODE = 3
SERVED_COLUMNS = (
    "dataset_routed, extracted_hour, is_known_threat, threat_type, matched_rule, if_prediction, if_anomaly_score,"
    " predicted_class, rf_confidence, final_risk_score, risk_level"
)
SERVED_LIST = SERVED_COLUMNS.replace(" ", "").split(",")


def level_sql(risk: str) -> str:
    return f"CASE WHEN {risk} >= 0.8 THEN 'High' WHEN {risk} >= 0.5 THEN 'Medium' WHEN {risk} IS NOT NULL THEN 'Low' END"


def served_sql(source: str) -> str:
    """CTEs ending in ``served`` (key and the result columns) for rows (key, raw) of a source; raw is not null."""
    rows = "SELECT key, model, masked FROM asked WHERE NOT hit"
    cells = (
        f"SELECT key, feature, v FROM weights UNION ALL SELECT key, 0, {INFO_CODE}::DOUBLE FROM asked WHERE NOT hit"
        " UNION ALL SELECT key, 1, CASE WHEN hour = -1 THEN 0.5::DOUBLE ELSE hour / 23.0::DOUBLE END FROM asked WHERE NOT hit"
    )
    severe = "(contains(lower(raw), 'outofmemory') OR contains(lower(raw), 'corrupted'))"
    missing = "contains(lower(raw), 'missing')"
    return f"""
    asked AS (SELECT *, coalesce(score >= 0.8, false) AS hit, {hour('raw', 'model')} AS hour FROM (
      SELECT key, raw, {routed('raw')} AS model, {mask('raw')} AS masked, {rule('raw', 2)} AS threat, {rule('raw', 3)} AS score FROM ({source}) s) a),
    {weights_sql(rows, 2)}, {outputs_sql(rows, cells, nodes_sql(served_models()))},
    base AS (SELECT a.*, if_decision, rf_class, c.rf_confidence, 1 - (least(greatest(if_decision, -0.5), 0.5) + 0.5) AS p
      FROM asked a LEFT JOIN iso i ON a.key = i.key LEFT JOIN classed c ON a.key = c.key),
    risky AS (SELECT *, CASE WHEN rf_class = 'Normal' THEN p * 0.3::DOUBLE ELSE 0.4::DOUBLE * p + 0.6::DOUBLE * rf_confidence END AS r FROM base),
    raised AS (SELECT *, CASE WHEN {severe} THEN greatest(r, 0.85) WHEN {missing} THEN greatest(r, 0.65) ELSE r END AS r2,
      CASE WHEN {severe} OR ({missing} AND rf_class = 'Normal') THEN 'SystemFailure' ELSE rf_class END AS class FROM risky),
    final AS (SELECT *, CASE WHEN threat IS NOT NULL AND score IS NULL THEN least(1.0, r2 + 0.15) ELSE r2 END AS r3 FROM raised),
    served AS (SELECT key, model AS dataset_routed, hour AS extracted_hour, hit AS is_known_threat,
      CASE WHEN hit THEN threat ELSE nullif(class, 'Normal') END AS threat_type, threat AS matched_rule,
      CASE WHEN hit OR if_decision < 0 THEN -1 ELSE 1 END AS if_prediction,
      CASE WHEN hit THEN 1 ELSE round(p, 4) END::DOUBLE AS if_anomaly_score, CASE WHEN hit THEN threat ELSE class END AS predicted_class,
      CASE WHEN hit THEN 1 ELSE round(rf_confidence, 4) END::DOUBLE AS rf_confidence, CASE WHEN hit THEN score ELSE round(r3, 4) END::DOUBLE AS final_risk_score,
      CASE WHEN hit THEN {level_sql('score')} ELSE {level_sql('r3')} END AS risk_level FROM final)
    """


def layered_models() -> list[tuple[str, int, int]]:
    return [("BGL", len(NUMERIC["layered"]) + len(TERMS["BGL"]), SALTS["BGL"])]


LAYERED_COLUMNS = (
    "is_known_threat, threat_type, matched_rule, if_prediction, if_anomaly_score, predicted_class, rf_confidence, final_risk_score, risk_level"
)
LAYERED_LIST = LAYERED_COLUMNS.replace(" ", "").split(",")


def layered_sql(source: str) -> str:
    """CTEs ending in ``layered`` for parsed rows (key, raw, message, level, time_delta, ts_hour)."""
    rows = "SELECT key, 'BGL' AS model, masked FROM asked WHERE NOT hit"
    code = "CASE level WHEN 'CRITICAL' THEN 0 WHEN 'DEBUG' THEN 1 WHEN 'ERROR' THEN 2 WHEN 'INFO' THEN 3 WHEN 'WARNING' THEN 5 ELSE 4 END::DOUBLE"
    cells = (
        f"SELECT key, feature, v FROM weights UNION ALL SELECT key, 0, {code} FROM asked WHERE NOT hit"
        " UNION ALL SELECT key, 1, time_delta FROM asked WHERE NOT hit UNION ALL SELECT key, 2, ts_hour::DOUBLE FROM asked WHERE NOT hit"
    )
    return f"""
    asked AS (SELECT *, threat IS NOT NULL AS hit, {mask('message')} AS masked FROM (
      SELECT *, {rule('message', 2)} AS threat, {rule('message', 0)} AS name FROM ({source}) s) a),
    {weights_sql(rows, 3)}, {outputs_sql(rows, cells, nodes_sql(layered_models()))},
    base AS (SELECT a.*, if_decision, rf_class, c.rf_confidence, 1 - (least(greatest(if_decision, -0.5), 0.5) + 0.5) AS p, coalesce(if_decision >= 0, false) AS usual
      FROM asked a LEFT JOIN iso i ON a.key = i.key LEFT JOIN classed c ON a.key = c.key),
    risky AS (SELECT *, CASE WHEN hit THEN 1.0 WHEN usual THEN p * 0.2::DOUBLE ELSE 0.4::DOUBLE * p + 0.6::DOUBLE * rf_confidence END::DOUBLE AS r FROM base),
    layered AS (SELECT key, hit AS is_known_threat, threat AS threat_type, name AS matched_rule, CASE WHEN hit OR usual THEN 1 ELSE -1 END AS if_prediction,
      CASE WHEN hit THEN 0 ELSE round(p, 9) END::DOUBLE AS if_anomaly_score, CASE WHEN hit THEN threat WHEN usual THEN 'Normal' ELSE rf_class END AS predicted_class,
      CASE WHEN hit THEN 1 WHEN usual THEN 0 ELSE round(rf_confidence, 9) END::DOUBLE AS rf_confidence, round(r, 9) AS final_risk_score,
      CASE WHEN hit THEN 'Critical' ELSE {level_sql('r')} END AS risk_level FROM risky)
    """


STUMPS = 12


def two_level_forest() -> forest.ForestTable:
    """Trees of three splits on three neighbouring features; their attributions have a closed form."""
    rows = []
    for tree in range(STUMPS):
        first, left = tree * 5 % 60, 30.0 + tree * 7 % 41
        covers = (100.0, left, 100.0 - left)
        halves = [0.25 + (tree * 3 + side * 5) % 9 / 16.0 for side in (0, 1)]
        parts = [covers[1] * halves[0], covers[1] * (1 - halves[0]), covers[2] * halves[1], covers[2] * (1 - halves[1])]
        for node, cover in enumerate((*covers, *parts)):
            inner = node < 3
            raw = [(tree * 5 + node * 3 + c * 7) % 11 + 1.0 for c in range(len(CLASSES))]
            step = ((tree * 31 + node * 17) % 21 - 10) / 41.0
            rows.append(
                (tree, node, first + node if inner else -1, step if inner else 0.0, 2 * node + 1 if inner else -1, 2 * node + 2 if inner else -1, [x / sum(raw) for x in raw], cover)
            )
    return forest.ForestTable(pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "shares", "cover"]), 64)


def attributions_sql(top: int) -> str:
    """(vec_id, place, feature, shap, base): a leaf under splits a and b pays v (1a - ca) (1b + cb) / 2 to a, likewise to b."""
    shares = ", ".join(f"(tree * 5 + node * 3 + {c * 7}) % 11 + 1 AS r{c}" for c in range(len(CLASSES)))
    listed = ", ".join(f"r{c}" for c in range(len(CLASSES)))
    return f"""
    WITH splits AS (SELECT tree, side, leaf, 3 + 2 * side + leaf AS node, tree * 5 % 60 AS a, tree * 5 % 60 + 1 + side AS b,
        ((tree * 31) % 21 - 10) / 41.0::DOUBLE AS ta, ((tree * 31 + (1 + side) * 17) % 21 - 10) / 41.0::DOUBLE AS tb,
        (30 + tree * 7 % 41) / 100.0::DOUBLE AS wa, 0.25::DOUBLE + (tree * 3 + side * 5) % 9 / 16.0::DOUBLE AS wb
      FROM range({STUMPS}) t(tree), range(2) s(side), range(2) l(leaf)),
    shared AS (SELECT *, {shares} FROM splits),
    leaves AS (SELECT *, unnest(range({len(CLASSES)})) AS class, unnest([{listed}])::DOUBLE / list_sum([{listed}]) / {STUMPS} AS v,
      CASE WHEN side = 0 THEN wa ELSE 1 - wa END AS ca, CASE WHEN leaf = 0 THEN wb ELSE 1 - wb END AS cb FROM shared),
    passed AS (SELECT vec_id, l.*, CASE WHEN (e.embedding[a + 1] <= ta) = (side = 0) THEN 1 ELSE 0 END AS oa,
      CASE WHEN (e.embedding[b + 1] <= tb) = (leaf = 0) THEN 1 ELSE 0 END AS ob FROM embeddings e, leaves l),
    paid AS (SELECT vec_id, class, a AS feature, v * (oa - ca) * (ob + cb) / 2 AS p FROM passed UNION ALL SELECT vec_id, class, b, v * (ob - cb) * (oa + ca) / 2 FROM passed),
    phi AS (SELECT vec_id, class, feature, sum(p) AS p FROM paid GROUP BY 1, 2, 3),
    best AS (SELECT vec_id, arg_max(class, total - class * 1e-12) AS class FROM (SELECT vec_id, class, sum(abs(p)) AS total FROM phi GROUP BY 1, 2) t GROUP BY 1),
    roots AS (SELECT tree, 0 AS node FROM range({STUMPS}) t(tree)),
    bases AS (SELECT class, avg(share) AS base FROM (SELECT unnest(range({len(CLASSES)})) AS class, unnest([{listed}])::DOUBLE / list_sum([{listed}]) AS share
      FROM (SELECT {shares} FROM roots) r) s GROUP BY class)
    SELECT p.vec_id, CAST(row_number() OVER (PARTITION BY p.vec_id ORDER BY round(abs(p), 12) DESC, feature DESC) AS INTEGER) AS place,
      'd' || feature AS feature, round(p, 9) AS shap, round(base, 9) AS base
    FROM phi p JOIN best b ON p.vec_id = b.vec_id AND p.class = b.class JOIN bases s ON s.class = p.class QUALIFY place <= {top}
    """
