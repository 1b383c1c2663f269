"""Analyst workflow: queues, correction types, reports, intake and state changes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.schemas import CORRECTION_LABELS, NORMAL

# States and texts written by the workflow.
CLOSED_STATES = ("Resolved", "Closed")
QUEUE_ACTIONS = ("FalsePositive", "Correction")
CASE_OPENED_NOTE = "Auto-generated case from SOC Dashboard."
CASE_NO_RESOLUTION = "No resolution notes are found."
MIN_JUSTIFICATION = 10
NOTE_TIME = "dd MMM HH:mm"


def _prefixed(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def active_cases(
    cases: DataFrame, feedbacks: DataFrame, analysts: DataFrame, analyst_id: int
) -> DataFrame:
    """Open cases an analyst may work on: own or unassigned, newest first."""
    mine = cases.where(
        (F.col("assigned_analyst_id").isNull() | (F.col("assigned_analyst_id") == analyst_id))
        & ~F.col("status").isin(*CLOSED_STATES)
    )
    feedback = _prefixed(
        feedbacks, "feedback", "id", "log_id", "raw_log", "predicted_class", "risk_level"
    )
    assignee = _prefixed(analysts, "assignee", "id", "username")
    return (
        mine.join(feedback, "feedback_id")
        .join(assignee, F.col("assigned_analyst_id") == F.col("assignee_id"), "left")
        .drop("assignee_id")
        .orderBy(F.desc("opened_at"), F.desc("id"))
    )


def pending_corrections(feedbacks: DataFrame, analysts: DataFrame) -> DataFrame:
    """Corrections waiting for review with their author, newest first."""
    waiting = feedbacks.where(
        (F.col("status") == "Pending") & F.col("action_type").isin(*QUEUE_ACTIONS)
    )
    author = _prefixed(analysts, "author", "id", "username")
    return (
        waiting.join(author, F.col("analyst_id") == F.col("author_id"))
        .drop("author_id")
        .orderBy(F.desc("created_at"), F.desc("id"))
    )


def _or_unknown(label: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), F.lit("Unknown"))


def queue_correction_type(action: Column, predicted: Column, proposed: Column) -> Column:
    """Badge shown in the review queue."""
    model, analyst = _or_unknown(predicted), _or_unknown(proposed)
    return (
        F.when((action == "FalsePositive") | (analyst == NORMAL), "FP Claim")
        .when((model == NORMAL) & (analyst != "Unknown"), "FN Claim")
        .when((model != NORMAL) & (model != analyst), "Misclass")
        .otherwise("Review")
    )


def review_correction_type(action: Column, predicted: Column, proposed: Column) -> Column:
    """Type shown on the review page; a missing label counts as not Normal."""
    normal_before = F.coalesce(predicted == NORMAL, F.lit(False))
    normal_after = F.coalesce(proposed == NORMAL, F.lit(False))
    threat_proposed = action.isin(*QUEUE_ACTIONS) & ~normal_after
    return (
        F.when(threat_proposed & normal_before, "False Negative")
        .when(threat_proposed, "Misclassification")
        .otherwise("False Positive")
    )


def form_correction_type(predicted: Column, selected: Column) -> Column:
    """Hint shown while the form is filled in; NULL until a label is chosen."""
    threat_before, threat_after = ~predicted.eqNullSafe(NORMAL), selected != NORMAL
    return F.when(
        selected != "",
        F.when(threat_before & ~threat_after, "False Positive")
        .when(~threat_before & threat_after, "False Negative")
        .otherwise("Misclassification"),
    )


def admin_kpis(analysts: DataFrame, feedbacks: DataFrame, cases: DataFrame) -> DataFrame:
    """One row of dashboard counts over the three tables."""
    approved = (F.col("status") == "Approved") & (F.col("origin") == "feedback")
    facts = (
        analysts.select(
            F.lit("analyst").alias("origin"),
            F.col("role").alias("kind"),
            F.lit(None).cast("string").alias("status"),
            F.lit(None).cast("string").alias("label"),
        )
        .unionByName(
            feedbacks.select(
                F.lit("feedback").alias("origin"),
                F.col("action_type").alias("kind"),
                "status",
                F.col("proposed_label").alias("label"),
            )
        )
        .unionByName(
            cases.select(
                F.lit("case").alias("origin"),
                F.lit(None).cast("string").alias("kind"),
                "status",
                F.lit(None).cast("string").alias("label"),
            )
        )
    )
    is_analyst = F.col("origin") == "analyst"
    return facts.agg(
        F.count_if(is_analyst).alias("total_analysts"),
        F.count_if(is_analyst & (F.col("kind") == "Junior")).alias("junior_analysts"),
        F.count_if(is_analyst & (F.col("kind") == "Senior")).alias("senior_analysts"),
        F.count_if((F.col("origin") == "feedback") & (F.col("status") == "Pending")).alias(
            "pending_feedbacks"
        ),
        F.count_if((F.col("origin") == "case") & (F.col("status") == "Open")).alias("open_cases"),
        F.count_if(approved & F.col("label").isNotNull()).alias("corrections_ready"),
        F.count_if(
            approved & F.col("label").isNull() & (F.col("kind") == "FalsePositive")
        ).alias("approved_without_label"),
    )


def retrain_extract(feedbacks: DataFrame, analysts: DataFrame) -> DataFrame:
    """Approved, labelled feedback in the shape the retraining job reads."""
    author = _prefixed(analysts, "author", "id", "username")
    return (
        feedbacks.where((F.col("status") == "Approved") & F.col("proposed_label").isNotNull())
        .join(author, F.col("analyst_id") == F.col("author_id"), "left")
        .select(
            "log_id",
            "raw_log",
            "predicted_class",
            "proposed_label",
            "risk_level",
            "action_type",
            "analyst_notes",
            F.coalesce("author_username", F.lit("unknown")).alias("analyst_username"),
            "created_at",
        )
    )


def first_cases(cases: DataFrame) -> DataFrame:
    """The case with the lowest id of every feedback."""
    rest = [c for c in cases.columns if c not in ("id", "feedback_id")]
    return (
        cases.groupBy("feedback_id")
        .agg(F.min_by(F.struct("id", *rest), "id").alias("c"))
        .select("feedback_id", "c.*")
    )


def case_reports(feedbacks: DataFrame, cases: DataFrame, analysts: DataFrame) -> DataFrame:
    """Every feedback with its author, its case and the case's assignee."""
    case = first_cases(cases).select(
        F.col("feedback_id").alias("case_feedback_id"),
        F.col("id").alias("case_id"),
        F.col("status").alias("case_status"),
        "assigned_analyst_id",
    )
    author = _prefixed(analysts, "author", "id", "username")
    assignee = _prefixed(analysts, "assignee", "id", "username")
    return (
        feedbacks.join(author, F.col("analyst_id") == F.col("author_id"), "left")
        .join(case, F.col("id") == F.col("case_feedback_id"), "left")
        .join(assignee, F.col("assigned_analyst_id") == F.col("assignee_id"), "left")
        .drop("author_id", "assignee_id", "case_feedback_id")
    )


def intake_feedback(requests: DataFrame) -> DataFrame:
    """New feedback rows; each request already carries its id and its time."""
    return requests.select(
        "id",
        "log_id",
        "raw_log",
        "predicted_class",
        "risk_level",
        "action_type",
        F.lit("Pending").alias("status"),
        "created_at",
        "analyst_notes",
        "proposed_label",
        "analyst_id",
    )


def open_cases(feedbacks: DataFrame, analysts: DataFrame) -> DataFrame:
    """New cases for feedback asking to investigate; seniors keep their own."""
    author = _prefixed(analysts, "author", "id", "role")
    return (
        feedbacks.where(F.col("action_type") == "Investigate")
        .join(author, F.col("analyst_id") == F.col("author_id"), "left")
        .select(
            F.col("id").alias("feedback_id"),
            F.when(F.col("author_role") == "Senior", F.col("analyst_id")).alias(
                "assigned_analyst_id"
            ),
            F.lit("Open").alias("status"),
            F.lit(CASE_NO_RESOLUTION).alias("resolution_notes"),
            F.lit(CASE_OPENED_NOTE).alias("analyst_notes"),
            F.col("created_at").alias("opened_at"),
        )
    )


def valid_correction_label(label: Column) -> Column:
    return F.coalesce(label.isin(*CORRECTION_LABELS), F.lit(False))


def valid_intake(
    log_id: Column, action: Column, label: Column, custom_label: Column, notes: Column
) -> Column:
    """Whether a request passes the form: ids, labels and a justification."""

    def filled(value: Column) -> Column:
        return F.coalesce(F.regexp_replace(value, r"(?U)\s", "") != "", F.lit(False))

    trimmed = F.regexp_replace(F.coalesce(notes, F.lit("")), r"(?U)^\s+|\s+$", "")
    correction = (
        F.coalesce(label != "", F.lit(False))
        & (~label.eqNullSafe("OTHER") | filled(custom_label))
        & (F.length(trimmed) >= MIN_JUSTIFICATION)
    )
    return F.coalesce(log_id != "", F.lit(False)) & (
        ~action.eqNullSafe("Correction") | correction
    )


def valid_note(notes: Column) -> Column:
    """Resolution and case notes may not be blank."""
    return F.coalesce(F.regexp_replace(notes, r"(?U)\s", "") != "", F.lit(False))


def removable_analysts(
    analysts: DataFrame, feedbacks: DataFrame, cases: DataFrame
) -> DataFrame:
    """Analysts who wrote no feedback and hold no case, administrators excepted.

    Both big tables shrink to their distinct analysts before anything is joined.
    """
    busy = (
        feedbacks.select(F.col("analyst_id").alias("id"))
        .unionByName(cases.select(F.col("assigned_analyst_id").alias("id")))
        .where(F.col("id").isNotNull())
        .distinct()
    )
    return analysts.where(F.col("role") != "Admin").join(busy, "id", "left_anti")


def _latest(value: Column, when: Column) -> Column:
    return F.max_by(value, F.when(when, F.col("action_id")))


def fold_actions(actions: DataFrame, actions_per_chunk: int = 1 << 16) -> DataFrame:
    """Net effect of an action log on every feedback it names.

    A correction replaces the notes, so the last accepted one of every feedback is found
    first and older notes are dropped before any notes meet.  The rest folds in two steps,
    chunk by chunk and then over chunks, so the actions on one busy feedback never meet in
    a single task.
    """
    action = F.col("action")
    corrects = (action == "correct") & valid_correction_label(F.col("label"))
    settles = action.isin("approve", "reject") | corrects
    status = (
        F.when(action == "approve", "Approved")
        .when(action == "reject", "Rejected")
        .when(corrects, "Pending")
        .when(action == "resolve", "Resolved")
    )
    stamp = F.date_format("acted_at", NOTE_TIME)
    note = F.concat(
        F.lit("\n\n["), stamp, F.lit(" - Update]: "), F.coalesce("notes", F.lit(""))
    )
    replaced = actions.where(corrects).groupBy(F.col("feedback_id").alias("corrected")).agg(
        F.max("action_id").alias("replaced_at")
    )
    living = F.col("replaced_at").isNull() | (F.col("action_id") > F.col("replaced_at"))
    prepared = actions.join(
        replaced, F.col("feedback_id") == F.col("corrected"), "left"
    ).select(
        "feedback_id",
        F.floor(F.col("action_id") / actions_per_chunk).alias("chunk"),
        "action_id",
        F.when(settles, F.struct("action_id", status.alias("status"))).alias("plain"),
        F.when(
            settles | (action == "resolve"), F.struct("action_id", status.alias("status"))
        ).alias("with_case"),
        F.when(corrects, F.struct("action_id", "label", "notes")).alias("correction"),
        F.when(action == "resolve", F.struct("action_id", "acted_at", "notes")).alias("resolution"),
        F.when((action == "note") & living, F.struct("action_id", note.alias("text"))).alias("note"),
    )
    latest = ("plain", "with_case", "correction", "resolution")
    chunks = prepared.groupBy("feedback_id", "chunk").agg(
        *[F.max_by(c, F.col(f"{c}.action_id")).alias(c) for c in latest],
        F.array_sort(F.collect_list("note")).alias("notes"),
    )
    pieces = chunks.withColumn(
        "piece", F.concat_ws("", F.transform("notes", lambda n: n["text"]))
    )
    folded = pieces.groupBy("feedback_id").agg(
        *[F.max_by(c, F.col(f"{c}.action_id")).alias(c) for c in latest],
        F.array_sort(F.collect_list(F.struct("chunk", "piece"))).alias("pieces"),
    )
    return folded.select(
        "feedback_id",
        *latest,
        F.concat_ws("", F.transform("pieces", lambda p: p["piece"])).alias("appended"),
    )


def apply_actions_to_feedback(
    feedbacks: DataFrame, cases: DataFrame, actions: DataFrame
) -> DataFrame:
    """Feedback after the action log; resolving needs a case to exist."""
    effect = fold_actions(actions)
    has_case = cases.select("feedback_id").distinct().withColumn("has_case", F.lit(True))
    joined = feedbacks.join(
        effect, F.col("id") == F.col("feedback_id"), "left"
    ).drop("feedback_id").join(
        has_case, F.col("id") == F.col("feedback_id"), "left"
    )
    corrected = F.col("correction").isNotNull()
    base_notes = F.when(corrected, F.col("correction.notes")).otherwise(F.col("analyst_notes"))
    changed = {
        "status": F.coalesce(
            F.when(F.col("has_case"), F.col("with_case.status")).otherwise(
                F.col("plain.status")
            ),
            F.col("status"),
        ),
        "action_type": F.when(corrected, "Correction").otherwise(F.col("action_type")),
        "proposed_label": F.when(corrected, F.col("correction.label")).otherwise(
            F.col("proposed_label")
        ),
        "analyst_notes": F.when(
            F.coalesce(F.col("appended"), F.lit("")) != "",
            F.concat(F.coalesce(base_notes, F.lit("")), F.col("appended")),
        ).otherwise(base_notes),
    }
    return joined.withColumns(changed).select(*feedbacks.columns)


def fold_claims(cases: DataFrame, actions: DataFrame) -> DataFrame:
    """(case, actor_id): who claimed each case last.

    A claim names its case by ``case_id``; without one it means the first case of its feedback.
    """
    claims = actions.where("action = 'claim'")
    first = cases.groupBy(F.col("feedback_id").alias("of")).agg(F.min("id").alias("first_case"))
    named = F.col("case_id") if "case_id" in actions.columns else F.lit(None).cast("int")
    # Before the join: many claims on one feedback become one row.
    latest = claims.groupBy("feedback_id", named.alias("case_id")).agg(F.max(F.struct("action_id", "actor_id")).alias("claim"))
    found = latest.join(first, F.col("feedback_id") == F.col("of"), "left")
    return (
        found.groupBy(F.coalesce("case_id", "first_case").alias("case"))
        .agg(F.max("claim").alias("claim"))
        .select("case", F.col("claim.actor_id").alias("actor_id"))
    )


def apply_actions_to_cases(cases: DataFrame, actions: DataFrame) -> DataFrame:
    """Cases after the action log: resolutions reach the first case of a feedback, claims the case they name."""
    effect = fold_actions(actions).select(F.col("feedback_id").alias("__feedback_id"), "resolution")
    claims = fold_claims(cases, actions).select(F.col("case").alias("__case"), F.col("actor_id").alias("__actor"))
    first = cases.groupBy("feedback_id").agg(F.min("id").alias("__id")).select("__id")
    marked = (
        cases.join(first, F.col("id") == F.col("__id"), "left")
        .join(
            effect,
            (F.col("feedback_id") == F.col("__feedback_id")) & F.col("__id").isNotNull(),
            "left",
        )
        .join(claims, F.col("id") == F.col("__case"), "left")
    )
    resolved = F.col("resolution").isNotNull()
    changed = {
        "status": F.when(resolved, "Resolved").otherwise(F.col("status")),
        "closed_at": F.when(resolved, F.col("resolution.acted_at")).otherwise(F.col("closed_at")),
        "resolution_notes": F.when(resolved, F.col("resolution.notes")).otherwise(
            F.col("resolution_notes")
        ),
        "assigned_analyst_id": F.coalesce("__actor", "assigned_analyst_id"),
    }
    return marked.withColumns(changed).select(*cases.columns)
