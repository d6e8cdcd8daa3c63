"""Changes that name the revision they were made for: commands to a queue, commits of owned rows, match results of an
older catalog. Each is a join that lets one of several writers through and names the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import vocabulary as V


def _command_problem() -> Column:
    """What is wrong with a command by itself."""
    mark, both = F.col("action") == "mark", F.col("disposition").isin("added", "merged")
    return F.coalesce(
        F.when(~F.col("action").isin("begin", "mark", "attention") | F.col("action").isNull(), "unknown_action"),
        F.when(F.col("revision").isNull(), "no_revision"),
        F.when(mark & ~F.coalesce(F.col("disposition").isin(*V.DISPOSITIONS), F.lit(False)), "unknown_disposition"),
        F.when(mark & both & F.col("paperId").isNull(), "no_paper"),
        F.when(mark & both & F.col("refreshId").isNull(), "no_refresh"),
        F.when((F.col("action") == "attention") & F.col("reason").isNull(), "no_reason"),
    )


def _status_after(c) -> Column:
    return F.when(c["action"] == "begin", "processing").when(c["action"] == "attention", "needs_attention").when(c["disposition"].isin("added", "merged"), "ready_to_refresh").otherwise("organized")


def apply_commands(items: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items after the commands, a verdict on every command).

    items have (id, status, revision) and other columns; commands (commandId, itemId, at, action, revision, disposition,
    paperId, refreshId, reason). A command takes effect on the revision that it names and makes the next one, so commands
    for revisions one after another all take effect. Of several for one revision the first by (at, commandId) that is
    allowed wins: begin only from a waiting status, the others from any. Verdicts (commandId, itemId, verdict, winner,
    revision): accepted with the new revision; conflict with the command that won and the item's revision in the end, or
    without a winner where the item never had that revision; illegal_status; unknown_item; or what is wrong with it.

    For each item and revision two commands meet at most, the first begin and the first other, however many were sent.
    """
    judged = commands.withColumn("problem", _command_problem())
    good = judged.where("problem is null").withColumn("begins", F.col("action") == "begin")
    packed = F.struct("at", "commandId", "action", "disposition", "paperId", "refreshId", "reason")
    first = good.groupBy("itemId", "revision", "begins").agg(F.min(packed).alias("c"))
    queue = first.groupBy("itemId").agg(F.array_sort(F.collect_list(F.struct("revision", "c"))).alias("queue"))
    now = items.select(F.col("id").alias("itemId"), F.col("status").alias("was"), F.col("revision").cast("long").alias("at_revision"))
    kind = "array<struct<revision:bigint,commandId:string,status:string,disposition:string,paperId:string,refreshId:string,reason:string>>"
    start = F.struct(F.col("at_revision").alias("revision"), F.col("was").alias("status"), F.array().cast(kind).alias("done"))

    def step(s, x):
        allowed = (x["revision"] == s["revision"]) & ((x["c"]["action"] != "begin") | F.coalesce(s["status"].isin(*V.QUEUE_WAITING), F.lit(False)))
        status = _status_after(x["c"])
        one = F.struct(s["revision"].alias("revision"), x["c"]["commandId"].cast("string").alias("commandId"), status.alias("status"), x["c"]["disposition"].alias("disposition"), x["c"]["paperId"].cast("string").alias("paperId"), x["c"]["refreshId"].cast("string").alias("refreshId"), x["c"]["reason"].cast("string").alias("reason"))
        return F.struct(
            F.when(allowed, s["revision"] + 1).otherwise(s["revision"]).alias("revision"),
            F.when(allowed, status).otherwise(s["status"]).alias("status"),
            F.when(allowed, F.concat(s["done"], F.array(one).cast(kind))).otherwise(s["done"]).alias("done"),
        )

    folded = queue.join(now, "itemId").withColumn("end", F.aggregate("queue", start, step)).select("itemId", "end.*")
    won = folded.select("itemId", F.explode("done").alias("d")).select("itemId", F.col("d.revision").alias("revision"), F.col("d.commandId").alias("winner"))
    last = folded.where(F.size("done") > 0).select(F.col("itemId").alias("id"), "revision", F.element_at("done", -1).alias("d"))
    last = last.select("id", "revision", *(F.col(f"d.{c}").alias(c) for c in ("status", "disposition", "paperId", "refreshId", "reason")))
    rows = items.alias("i").join(last.alias("l"), "id", "left")
    changed = ["status", "revision", "disposition", "paperId", "refreshId", "reason"]
    # A column that the last command says nothing about keeps its value.
    after = rows.select(*(F.coalesce(f"l.{c}", f"i.{c}").alias(c) if c in changed else F.col(f"i.{c}" if c != "id" else "id") for c in items.columns))
    ends = now.join(folded.select("itemId", F.col("revision").alias("_end")), "itemId", "left").select("itemId", F.coalesce("_end", "at_revision").alias("ends"), F.col("at_revision").alias("began"))
    seen = judged.join(ends, "itemId", "left").join(won, ["itemId", "revision"], "left")
    accepted = F.col("winner") == F.col("commandId").cast("string")
    verdict = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("ends").isNull(), "unknown_item").when(accepted, "accepted").when(
        F.col("winner").isNull() & (F.col("revision") == F.col("ends")), "illegal_status").otherwise("conflict")
    named = F.when(verdict == "conflict", F.col("winner"))
    return after, seen.select("commandId", "itemId", verdict.alias("verdict"), named.alias("winner"), F.when(verdict == "accepted", F.col("revision") + 1).otherwise(F.col("ends")).alias("revision"))


def commit_items(items: DataFrame, descriptors: DataFrame, papers: DataFrame, refresh: str) -> tuple[DataFrame, DataFrame]:
    """(items after a refresh, problems (itemId, problem)): all descriptors take effect, or none if one has a problem.

    items have (id, revision, status, refreshId, graphPaperId, displayTitle, verificationStatus), descriptors (itemId,
    revision, paperId) with nulls for what they do not require, papers (id, title, verificationStatus). A descriptor's
    item must be there, have the revision that it names, belong to the refresh and be ready or organized already; then it
    is organized and takes over its paper's title and status. Organized ones stay as they are, so a commit can be
    repeated. Of problems the first of missing, revision_changed, other_owner and status_changed counts.
    """
    wanted = descriptors.select("itemId", F.col("revision").alias("_revision"), F.col("paperId").alias("_paper")).dropDuplicates(["itemId"])
    found = wanted.join(items.select(F.col("id").alias("itemId"), "revision", "status", "refreshId", F.lit(True).alias("_here")), "itemId", "left")
    problem = F.coalesce(
        F.when(F.col("_here").isNull(), "missing"),
        F.when(F.col("_revision").isNotNull() & ~F.col("_revision").eqNullSafe(F.col("revision")), "revision_changed"),
        F.when(~F.col("refreshId").eqNullSafe(F.lit(refresh)), "other_owner"),
        F.when(~F.coalesce(F.col("status").isin("ready_to_refresh", "organized"), F.lit(False)), "status_changed"),
    )
    problems = found.select("itemId", problem.alias("problem")).where("problem is not null")
    sound = problems.agg((F.count("*") == 0).alias("_sound"))  # one row
    told = papers.select(F.col("id").alias("_paper"), F.col("title").alias("_title"), F.col("verificationStatus").alias("_status"))
    rows = items.join(wanted.withColumnRenamed("itemId", "id").withColumn("_asked", F.lit(True)), "id", "left").join(told, "_paper", "left").crossJoin(F.broadcast(sound))
    takes = F.col("_sound") & F.coalesce(F.col("_asked"), F.lit(False)) & (F.col("status") == "ready_to_refresh")
    new = {"status": F.lit("organized"), "graphPaperId": F.col("_paper"), "displayTitle": F.col("_title"), "verificationStatus": F.col("_status")}
    return rows.select(*(F.when(takes, F.coalesce(new[c], F.col(c))).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in items.columns)), problems


#: Keys that a duplicate can be matched by, and the columns of a result and of the catalog that they compare.
STRICT = {"sha256": "sha256", "arxiv_id": "arxivBase", "doi": "doi"}


def reverified(results: DataFrame, catalog: DataFrame, version: int) -> DataFrame:
    """(id, paperId, verdict, reason): duplicate results looked at again where the catalog has moved since.

    results have (id, paperId, matchedBy, version, sourceSha256, sha256, arxivBase, doi, canonicalArxiv, canonicalDoi): the
    match, the catalog version that it was made with and the identities of the document; catalog has (paperId, sha256,
    arxivBase, doi). A result of the current version is valid as it is. Any other is valid if its paper is there once and
    still agrees with every key that it was matched by; stale, with a reason, if not; and a conflict where the result
    contradicts itself or a known identity of the paper differs from the document's, which a matching key must not hide.
    """
    keys = F.coalesce("matchedBy", F.array().cast("array<string>"))
    twice = F.size(F.array_distinct(keys)) != F.size(keys)
    differs = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    malformed = F.coalesce(
        F.when((F.size(keys) == 0) | twice | (F.size(F.array_except(keys, F.array(*map(F.lit, STRICT)))) > 0), "keys"),
        F.when(~F.coalesce((F.length("sourceSha256") == 64) & (F.col("sha256") == F.col("sourceSha256")), F.lit(False)), "source"),
        F.when(F.col("arxivBase").isNotNull() & ~F.col("arxivBase").eqNullSafe(F.col("canonicalArxiv")), "arxiv"),
        F.when(F.col("doi").isNotNull() & ~F.col("doi").eqNullSafe(F.col("canonicalDoi")), "doi"),
    )
    judged = results.withColumn("_malformed", malformed)
    moved = judged.where(F.col("_malformed").isNull() & ~F.coalesce(F.col("version") == version, F.lit(False)))
    now = catalog.groupBy("paperId").agg(F.count("*").alias("_n"), *(F.min(c).alias(f"_{c}") for c in STRICT.values()))
    both = moved.join(now, "paperId", "left")
    other = F.coalesce(F.when(differs("arxivBase", "_arxivBase"), "paper_arxiv"), F.when(differs("doi", "_doi"), "paper_doi"))
    lost = [F.when(F.array_contains("matchedBy", k) & ~F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False)), f"{k}_changed") for k, c in STRICT.items()]
    stale = F.coalesce(F.when(F.col("_n").isNull(), "paper_gone"), F.when(F.col("_n") > 1, "paper_repeated"), *lost)
    once = F.coalesce(F.col("_n") == 1, F.lit(False))
    again = both.select("id", "paperId", F.when(once & other.isNotNull(), "conflict").when(stale.isNotNull(), "stale").otherwise("valid").alias("verdict"), F.when(once & other.isNotNull(), other).otherwise(stale).alias("reason"))
    rest = judged.where(F.col("_malformed").isNotNull() | F.coalesce(F.col("version") == version, F.lit(False)))
    return again.unionByName(rest.select("id", "paperId", F.when(F.col("_malformed").isNotNull(), "conflict").otherwise("valid").alias("verdict"), F.col("_malformed").alias("reason")))
