"""Contest results: rank, winner, margin, turnout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of rows that are no candidates (fixed values).
NOTA, TOTAL = "NOTA", "TOTAL"


def rank_votes(rows: DataFrame, contest: str = "contest", votes: str = "votes", pos: str = "pos") -> DataFrame:
    """Rank by votes within a contest; ties keep input order."""
    order = Window.partitionBy(contest).orderBy(F.desc_nulls_last(votes), F.asc(pos))
    return rows.withColumn("rank", F.row_number().over(order))


def percent(part: Column, whole: Column) -> Column:
    """Two decimals, half up, null when the whole is nothing.  Exact decimals."""
    ratio = part.cast("decimal(20,0)") * 100 / F.when(whole != 0, whole).cast("decimal(20,0)")
    return F.round(ratio, 2).cast("double")


def contest_results(rows: DataFrame, contest: str = "contest") -> DataFrame:
    """A1: one row per contest from rows (contest, pos, name, party, votes).

    ``polled`` is the printed total row if there is one, else the sum of votes,
    NOTA included.  A contest without two real candidates comes out with a reason
    in ``problem`` (quarantine) instead of stopping the job.  Ranking and summing
    share one exchange on the contest.
    """
    name = F.upper(F.trim("name"))
    kinds = rows.withColumn("kind", F.when(name == TOTAL, TOTAL).when(name == NOTA, NOTA).otherwise("REAL"))
    order = Window.partitionBy(contest, "kind").orderBy(F.desc_nulls_last("votes"), "pos", "name", "party")
    ranked = kinds.repartition(contest).withColumn("rank", F.row_number().over(order))

    def place(n: int, c: str) -> Column:
        return F.max(F.when((F.col("kind") == "REAL") & (F.col("rank") == n), F.col(c)))

    summed = ranked.groupBy(contest).agg(
        *(place(n, c).alias(f"{who}_{c}") for n, who in ((1, "winner"), (2, "runner_up")) for c in ("name", "party", "votes")),
        F.coalesce(
            F.max(F.when(F.col("kind") == TOTAL, F.col("votes"))), F.sum(F.when(F.col("kind") != TOTAL, F.col("votes")))
        ).alias("polled"),
        F.coalesce(F.sum(F.when(F.col("kind") == NOTA, F.col("votes"))), F.lit(0)).alias("nota_votes"),
        F.count_if(F.col("kind") == "REAL").alias("candidate_count"),
        F.count_if(F.col("kind") != TOTAL).alias("row_count"),
    )
    margin = F.col("winner_votes") - F.col("runner_up_votes")
    return summed.withColumns(
        {
            "margin": margin,
            "margin_percent": percent(margin, F.col("polled")),
            "problem": F.when(F.col("row_count") < 2, "fewer than 2 rows").when(F.col("candidate_count") < 2, "fewer than 2 candidates"),
        }
    )
