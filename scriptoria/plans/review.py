"""Review batches: few papers share a character budget fairly, whole candidates first, context as room allows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T

#: Kinds that a batch covers, in the order of its rounds, and papers in a batch.
COVERAGE = ("research_question", "method", "result", "limitation", "assumption", "equation")
FEWEST, MOST = 3, 5


def batches(queue: DataFrame, size: int = MOST) -> DataFrame:
    """queue (id, number) with its batch, `size` items each in order of number and id."""
    k = F.row_number().over(Window.orderBy("number", "id")) - 1  # the open queue, not the library
    return queue.withColumn("batch", F.floor(k / size))


def select(candidates: DataFrame, budget: int) -> DataFrame:
    """(batch, paperId, candidateId, cost, previous, next) chosen for each batch.

    candidates has (batch, paperId, candidateId, kind, text, locator, previous, next, score, page, start). The choice
    is sequential inside a batch of at most MOST papers with capped candidates: each paper's best one first, then
    rounds over the kinds that start at another kind for each paper, then the rest in turns while they fit.
    """
    kind = dict(candidates.dtypes)
    schema = f"batch {kind['batch']}, paperId {kind['paperId']}, candidateId {kind['candidateId']}, cost int, previous string, next string"

    def clip(text, room: int):
        if not text or room <= 0:
            return None
        return text if len(text) <= room else "…" if room <= 1 else text[: room - 1] + "…"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        papers = sorted(pdf["paperId"].unique())
        if len(papers) > MOST:
            raise ValueError(f"a batch has {len(papers)} papers")
        rows = {p: pdf[pdf["paperId"] == p].to_dict("records") for p in papers}
        used, out, taken = 0, [], set()

        def take(row: dict, room: int) -> bool:
            nonlocal used
            base = len(row["text"]) + len(row["locator"])
            if base > room:
                return False
            previous = clip(row["previous"], (room - base) // 2)
            following = clip(row["next"], room - base - len(previous or ""))
            cost = base + len(previous or "") + len(following or "")
            out.append((row["batch"], row["paperId"], row["candidateId"], cost, previous, following))
            taken.add((row["paperId"], row["candidateId"]))
            used += cost
            return True

        best_first = lambda r: (-r["score"], len(r["text"]) + len(r["locator"]), r["candidateId"])
        usable = {p: sorted((r for r in rows[p] if r["kind"] in COVERAGE), key=best_first) for p in papers}
        for k, p in enumerate(papers):
            if usable[p]:
                first = usable[p][0]
                take(first, max(len(first["text"]) + len(first["locator"]), (budget - used) // (len(papers) - k)))
        for turn in range(len(COVERAGE)):
            for k, p in enumerate(papers):
                wanted = COVERAGE[(turn + k) % len(COVERAGE)]
                row = next((r for r in usable[p] if r["kind"] == wanted and (p, r["candidateId"]) not in taken), None)
                if row:
                    take(row, budget - used)
        waiting = {p: [r for r in usable[p] if (p, r["candidateId"]) not in taken] for p in papers}
        while any(waiting.values()):
            moved = False
            for p in papers:
                while waiting[p]:
                    if take(waiting[p].pop(0), budget - used):
                        moved = True
                        break
            if not moved:
                break
        return pd.DataFrame(out, columns=["batch", "paperId", "candidateId", "cost", "previous", "next"])

    return candidates.groupBy("batch").applyInPandas(run, schema)


def plan_options(plan: DataFrame, claims: DataFrame, old: DataFrame) -> DataFrame:
    """A compact plan (optionId, paperId, regionId) with evidence and old-region scores.

    The evidence is the paper's first verified claim, else its first that is eligible; an old region scores 82 if it
    was the paper's own and stays, 66 if it was and does not, and 18 otherwise.
    """
    rank = F.when(F.col("verificationStatus") == "evidence_verified", 0).when(F.col("verificationStatus") == "needs_attention", 1)
    best = claims.withColumn("r", rank).where("r is not null").groupBy("paperId").agg(F.min_by("claimId", F.struct("r", "claimId")).alias("claimId"))
    both = plan.join(best, "paperId", "left").join(old.select("paperId", F.col("regionId").alias("was")), "paperId", "left")
    score = F.when(F.col("was") == F.col("regionId"), 82).when(F.col("was").isNotNull(), 66).otherwise(18)
    return both.select("optionId", "paperId", "regionId", "claimId", score.alias("oldRegionScore"))


def numbered_evidence(accepted: DataFrame) -> DataFrame:
    """accepted (paperId, page, start, candidateId) with evidenceId E1, E2 ... in reading order."""
    k = F.row_number().over(Window.partitionBy("paperId").orderBy("page", "start", "candidateId"))
    return accepted.withColumn("evidenceId", F.concat(F.lit("E"), k.cast("string")))


def finalize(papers: DataFrame, cards: DataFrame, summaries: DataFrame) -> DataFrame:
    """Papers with what their cards say: status, evidence count, summary. cards has (id, status, evidenceCount)."""
    both = papers.join(cards.select("id", F.col("status").alias("_s"), F.col("evidenceCount").alias("_n")), "id", "left").join(summaries.select(F.col("card_id").alias("id"), F.col("summary").alias("_t")), "id", "left")
    return both.withColumn("verificationStatus", F.coalesce("_s", "verificationStatus")).withColumn("evidenceCount", F.coalesce("_n", F.lit(0))).withColumn("summary", F.coalesce("_t", "summary")).drop("_s", "_n", "_t")


def adopt(current: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The next catalog: reviewed rows replace those of the same id, new ones are added, with clean short titles."""
    rest = current.join(reviewed.select("id"), "id", "left_anti")
    return rest.unionByName(reviewed.withColumn("title", T.squeeze(F.col("title"))), allowMissingColumns=True)


def migrate(papers: DataFrame) -> DataFrame:
    """Schema 2 papers as schema 3: nested source and artifacts from flat paths, verified as a status."""
    pid = F.col("id").cast("string")
    return papers.select(
        "id", "title",
        F.when(F.col("verified"), "evidence_verified").otherwise("card_draft").alias("verificationStatus"),
        F.struct(F.lit("pdf").alias("kind"), F.concat(F.lit("Library/PDFs/"), pid, F.lit(".pdf")).alias("pdfPath"), F.col("sha256")).alias("source"),
        F.struct(F.concat(F.lit("Knowledge/cards/"), pid, F.lit(".md")).alias("cardPath"), F.concat(F.lit("Knowledge/fulltext/"), pid, F.lit(".md")).alias("fulltextPath")).alias("artifacts"),
        F.coalesce("useCount", F.lit(0)).alias("useCount"),
    )
