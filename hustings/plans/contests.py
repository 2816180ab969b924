"""Contest queries over the driver's tables: an order is a contest, its lines are votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.operators import contests


def vote_rows(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("contest"),
        F.col("l_linenumber").alias("pos"),
        F.when(F.col("l_linenumber") == 7, "NOTA").otherwise(F.concat(F.lit("S"), F.col("l_suppkey"))).alias("name"),
        F.col("l_returnflag").alias("party"),
        F.col("l_quantity").cast("long").alias("votes"),
    )


VOTES = """votes_ AS (SELECT l_orderkey AS contest, l_linenumber AS pos,
  CASE WHEN l_linenumber = 7 THEN 'NOTA' ELSE concat('S', l_suppkey) END AS name,
  l_returnflag AS party, CAST(l_quantity AS BIGINT) AS votes FROM lineitem)"""


def a1_contest_results(spark, sf_dir):
    return contests.contest_results(vote_rows(spark, sf_dir))


QUERIES = {"a1_contest_results": a1_contest_results}

ORACLES = {
    "a1_contest_results": f"""WITH {VOTES},
r AS (SELECT *, row_number() OVER (PARTITION BY contest, name = 'NOTA' ORDER BY votes DESC NULLS LAST, pos, name, party) AS rank FROM votes_),
g AS (SELECT contest,
  max(CASE WHEN name <> 'NOTA' AND rank = 1 THEN name END) AS winner_name,
  max(CASE WHEN name <> 'NOTA' AND rank = 1 THEN party END) AS winner_party,
  max(CASE WHEN name <> 'NOTA' AND rank = 1 THEN votes END) AS winner_votes,
  max(CASE WHEN name <> 'NOTA' AND rank = 2 THEN name END) AS runner_up_name,
  max(CASE WHEN name <> 'NOTA' AND rank = 2 THEN party END) AS runner_up_party,
  max(CASE WHEN name <> 'NOTA' AND rank = 2 THEN votes END) AS runner_up_votes,
  CAST(sum(votes) AS BIGINT) AS polled,
  CAST(coalesce(sum(CASE WHEN name = 'NOTA' THEN votes END), 0) AS BIGINT) AS nota_votes,
  count(*) FILTER (WHERE name <> 'NOTA') AS candidate_count, count(*) AS row_count
  FROM r GROUP BY contest)
SELECT *, winner_votes - runner_up_votes AS margin,
  CAST(floor((winner_votes - runner_up_votes) * 10000::DECIMAL(20,0) / nullif(polled, 0) + 0.5) / 100 AS DOUBLE) AS margin_percent,
  CASE WHEN row_count < 2 THEN 'fewer than 2 rows' WHEN candidate_count < 2 THEN 'fewer than 2 candidates' END AS problem
FROM g"""
}
