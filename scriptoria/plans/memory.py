"""Project memory: the state that an append-only event table implies, and what is wrong with the table.

Every rule is a join or a window, so a ledger of any length replays without a loop: an item is superseded if a later
item lists it, retired if an event says so, and last touched by the latest of these.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.functions import vocabulary as V


def items(events: DataFrame) -> DataFrame:
    """(projectId, memoryId, type, title, content, state, evidenceState, provenance, createdRevision, updatedRevision,
    supersededBy, contradictedBy) of events (projectId, revision, type, memoryId, memory struct)."""
    made = events.where("type = 'memory_recorded'").select("projectId", F.col("revision").alias("createdRevision"), "memory.*")
    def touches(column: str, name: str) -> DataFrame:
        rows = made.select("projectId", F.col("memoryId").alias("by"), F.col("createdRevision").alias("at"), F.explode(column).alias("memoryId"))
        return rows.groupBy("projectId", "memoryId").agg(F.min_by("by", "at").alias(f"{name}First"), F.array_sort(F.collect_set("by")).alias(f"{name}All"), F.max("at").alias(f"{name}At"))

    over, against = touches("supersedes", "s"), touches("contradicts", "c")
    gone = events.where("type = 'memory_retired'").groupBy("projectId", "memoryId").agg(F.max("revision").alias("retiredAt"))
    key = ["projectId", "memoryId"]
    out = made.join(over, key, "left").join(against, key, "left").join(gone, key, "left")
    state = F.when(F.col("sAt").isNotNull(), "superseded").when(F.col("retiredAt").isNotNull(), "retired").otherwise(F.coalesce("state", F.lit("active")))
    return out.select(
        "projectId", "memoryId", "type", "title", "content", state.alias("state"), "evidenceState", "provenance", "createdRevision",
        F.greatest("createdRevision", "sAt", "cAt", "retiredAt").alias("updatedRevision"), F.col("sFirst").alias("supersededBy"),
        F.coalesce("cAll", F.array().cast("array<string>")).alias("contradictedBy"),
    )


def tasks(events: DataFrame) -> DataFrame:
    """(projectId, taskHash, status, startedRevision, completedRevision)."""
    at = lambda kind: F.min(F.when(F.col("type") == kind, F.col("revision")))
    per = events.where("type in ('task_started', 'task_completed')").groupBy("projectId", "taskHash").agg(at("task_started").alias("startedRevision"), at("task_completed").alias("completedRevision"))
    return per.withColumn("status", F.when(F.col("completedRevision").isNotNull(), "completed").otherwise("active"))


def ledger_problems(events: DataFrame) -> DataFrame:
    """(projectId, revision, code): unknown types, gaps, repeated event ids, events before the project, unknown or
    repeated targets, and steps that the state did not allow."""
    w = Window.partitionBy("projectId").orderBy("revision")
    mark = lambda df, code: df.select("projectId", "revision", F.lit(code).alias("code"))
    placed = events.withColumn("k", F.row_number().over(w)).withColumn("times", F.count("*").over(Window.partitionBy("eventId")))
    recorded = events.where("type = 'memory_recorded'")
    known = recorded.groupBy("projectId", F.col("memory.memoryId").alias("target")).agg(F.min("revision").alias("since"), F.count("*").alias("n"))
    aims = recorded.select("projectId", "revision", F.explode(F.array_union(F.coalesce("memory.supersedes", F.array().cast("array<string>")), F.coalesce("memory.contradicts", F.array().cast("array<string>")))).alias("target"))
    aims = aims.unionByName(events.where("type = 'memory_retired'").select("projectId", "revision", F.col("memoryId").alias("target")))
    met = aims.join(known, ["projectId", "target"], "left")
    ends = recorded.select("projectId", "revision", F.explode("memory.supersedes").alias("target")).unionByName(events.where("type = 'memory_retired'").select("projectId", "revision", F.col("memoryId").alias("target")))
    again = ends.withColumn("k", F.row_number().over(Window.partitionBy("projectId", "target").orderBy("revision"))).where("k > 1")
    started = events.where("type = 'task_started'").groupBy("projectId", "taskHash").agg(F.min("revision").alias("since"), F.count("*").alias("n"))
    finished = events.where("type = 'task_completed'").join(started.select("projectId", "taskHash", "since"), ["projectId", "taskHash"], "left")
    parts = [
        mark(events.where(~F.col("type").isin(*V.MEMORY_EVENTS)), "unknown_type"),
        mark(placed.where("revision <> k"), "revision_gap"),
        mark(placed.where("times > 1"), "repeated_event_id"),
        mark(placed.where("k = 1 and type <> 'project_initialized'"), "not_initialized"),
        mark(placed.where("k > 1 and type = 'project_initialized'"), "initialized_twice"),
        mark(met.where("since is null or since >= revision"), "unknown_target"),
        mark(known.where("n > 1").withColumnRenamed("since", "revision"), "repeated_memory"),
        mark(again, "target_not_active"),
        mark(finished.where("since is null or since >= revision"), "unknown_task"),
        mark(started.where("n > 1").withColumnRenamed("since", "revision"), "repeated_task"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def draft_problems(drafts: DataFrame) -> DataFrame:
    """(memoryId, code) of drafts (memoryId, type, state, provenance, evidenceState, paperEvidence int, artifact
    boolean, supersedes): the rules for kinds, provenance and evidence."""
    solid = F.col("evidenceState").isin("supported", "contradicted")
    made = F.col("type").isin("code", "experiment")
    rules = {
        "type": ~F.col("type").isin(*V.MEMORY_TYPES),
        "state": ~F.col("state").isin(*V.MEMORY_STATES) | (F.col("state") == "superseded"),
        "provenance": ~F.col("provenance").isin(*V.PROVENANCE),
        "evidence_state": ~F.col("evidenceState").isin(*V.EVIDENCE_STATES),
        "paper_evidence_missing": (F.col("provenance") == "paperEvidence") & (F.col("paperEvidence") == 0),
        "artifact_missing": ((F.col("provenance") == "computationArtifact") | made) & ~F.col("artifact"),
        "inference_not_provisional": (F.col("provenance") == "aiInference") & (F.col("evidenceState") != "provisional"),
        "made_without_artifact_provenance": made & (F.col("provenance") != "computationArtifact"),
        "evidence_missing": solid & (F.col("paperEvidence") == 0) & ~F.col("artifact"),
        "user_cannot_support": solid & (F.col("provenance") == "user"),
        "id": ~F.col("memoryId").rlike("^mem-[a-z0-9]+(?:-[a-z0-9]+)*$"),
        "inactive_supersedes": (F.col("state") != "active") & (F.size("supersedes") > 0),
    }
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(code)) for code, c in rules.items())), lambda x: x.isNotNull())
    return drafts.select("memoryId", F.explode(found).alias("code"))


def search(items_: DataFrame, query, limit: int = 20) -> DataFrame:
    """Items by score, then latest revision, then id."""
    score = T.memory_score(F.col("title"), F.col("type"), F.col("content"), T.memory_terms(query), F.col("evidenceState"), F.col("provenance"))
    return items_.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("updatedRevision"), "memoryId").limit(limit)


def status(items_: DataFrame, tasks_: DataFrame) -> DataFrame:
    """(projectId, active, superseded, retired, conflicts, open_questions, tasks_active)."""
    active = F.col("state") == "active"
    per = items_.groupBy("projectId").agg(
        F.count_if(active).alias("active"), F.count_if(F.col("state") == "superseded").alias("superseded"), F.count_if(F.col("state") == "retired").alias("retired"),
        F.count_if(active & ((F.col("evidenceState") == "contradicted") | (F.size("contradictedBy") > 0))).alias("conflicts"),
        F.count_if(active & (F.col("type") == "open_question")).alias("open_questions"),
    )
    return per.join(tasks_.groupBy("projectId").agg(F.count_if(F.col("status") == "active").alias("tasks_active")), "projectId", "left").fillna(0, ["tasks_active"])


def handoff(items_: DataFrame) -> DataFrame:
    """(projectId, part, memoryId, title): what a handoff lists, in parts."""
    active = items_.where("state = 'active'")
    part = F.array(F.lit("active"), F.when((F.col("evidenceState") == "contradicted") | (F.size("contradictedBy") > 0), F.lit("conflict")), F.when(F.col("type") == "open_question", F.lit("open_question")), F.when(F.col("type") == "next_step", F.lit("next_step")))
    return active.select("projectId", F.explode(F.filter(part, lambda p: p.isNotNull())).alias("part"), "memoryId", "title")
