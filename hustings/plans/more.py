"""Overrides, fallbacks, lookups, gates: further operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.functions import names as N
from hustings.operators import audits, cases, contests, engagement, linkage, news
from hustings.plans.contests import VOTES, vote_rows
from hustings.plans.facts import CASES, case_rows
from hustings.plans.feeds import ARTICLES, articles
from hustings.plans.people import PEOPLE, people


def j9_overrides(spark, sf_dir):
    p = people(spark, sf_dir).select("id", "name", F.col("party").alias("profession"), F.lit("text").alias("source"))
    manual = p.where("id % 10 = 0").select(N.safe_name("name").alias("key"), F.concat(F.lit("fixed "), F.col("id").cast("string")).alias("profession"))
    return linkage.apply_overrides(p, manual, "profession", N.safe_name("name")).select("id", "profession", "source")


def j10_fallbacks(spark, sf_dir):
    p = people(spark, sf_dir).select("id", F.when(F.col("id") % 7 == 0, "patched").alias("patch"), F.when(F.col("id") % 3 == 0, "Not Found").when(F.col("id") % 3 == 1, F.col("party")).alias("existing"), F.when(F.col("id") % 2 == 0, "read").alias("text"))
    return linkage.resolve_value(p, [("patch", "manual"), ("existing", "legacy"), ("text", "local")]).select("id", "value", "method")


def a10_value_audit(spark, sf_dir):
    return audits.value_audit(j10_fallbacks(spark, sf_dir).withColumn("profession", F.when(F.col("id") % 5 != 0, F.col("value"))))


def j11_linked_files(spark, sf_dir):
    p = people(spark, sf_dir)
    files = p.select(F.concat(N.clean_key("name"), F.when(F.col("id") % 50 == 0, "_copy").otherwise(""), F.lit(".pdf")).alias("file"))
    return linkage.link_files(files, p)


def j15_closest_nation(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    options = n.select(F.col("n_nationkey").alias("pos"), F.concat("n_name", F.lit(" (state)")).alias("option")).union(n.select(F.col("n_nationkey") + 100, F.concat("n_name", F.lit(" long"))))
    return linkage.closest_option(n.select(F.lower("n_name").alias("key")), options)


def j18_seat_lookup(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return linkage.lookup_seat(n.select(F.concat(F.lower("n_name"), F.lit(" (ST)")).alias("label")), people(spark, sf_dir))


def j19_bookmark_feed(spark, sf_dir):
    a = articles(spark, sf_dir)
    marks = a.where("pos % 50 = 0").select((F.col("pos") % 4).alias("uid"), "candidate_id")
    return news.bookmark_feed(marks, a).select("uid", "candidate_id", "pos")


def j20_shown_counts(spark, sf_dir):
    a = articles(spark, sf_dir).select(F.col("pos").cast("string").alias("item_id"))
    states = a.where("item_id % 3 = 0").select("item_id", F.lit("useful").alias("reaction"))
    return engagement.attach_counts(a, engagement.reaction_counts(states))


def j21_relevance(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("title", F.concat(F.lit("News on customer "), F.lpad(F.col("pos").cast("string"), 9, "0")))
    p = people(spark, sf_dir).select(F.col("id").alias("candidate_id"), F.lpad(F.col("id").cast("string"), 9, "0").alias("name"), "constituency", "party")
    return news.relevance(a, p).select("pos", "kind")


def j22_ranked(spark, sf_dir):
    ranked = articles(spark, sf_dir).groupBy(F.col("candidate_id").cast("string").alias("item_id")).agg(F.count("*").alias("votes"))
    return engagement.rank_join(ranked, people(spark, sf_dir)).select("item_id", "votes", "name")


def a9_coverage(spark, sf_dir):
    p = people(spark, sf_dir)
    return audits.coverage(p, {"with_role": F.col("role").isNotNull(), "with_seat": F.col("constituency") != ""})


def a17_progression(spark, sf_dir):
    r = vote_rows(spark, sf_dir).groupBy((F.col("contest") % 4).alias("round")).agg(F.count_if(F.col("votes") > 25).alias("exact"))
    return audits.progression(r)


def f6_todo(spark, sf_dir):
    docs = people(spark, sf_dir).select(F.col("id").alias("doc"), (F.col("id") % 4).alias("stamp"))
    done = docs.where("doc % 2 = 0").withColumn("stamp", F.when(F.col("doc") % 3 == 0, F.col("stamp") + 1).otherwise(F.col("stamp")))
    return audits.todo(docs, done, forced=docs.where("doc % 8 = 0"))


def f8_valid_cases(spark, sf_dir):
    return cases.valid_cases(case_rows(spark, sf_dir)).select("candidate_id", "pos")


def n31_case_display(spark, sf_dir):
    raw = F.when(F.col("pos") == 5, F.concat(F.lit("FIR: 7/2020 | Desc: "), F.col("bucket"))).otherwise(F.col("raw_text"))
    rows = case_rows(spark, sf_dir).withColumns({"raw_text": raw, "fir_no": F.when(F.col("pos") != 5, F.col("fir_no"))})
    return cases.case_display(rows).select("candidate_id", "pos", "fir", "sections", "description", "status")


def f10_reaction_checks(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select("event_id", F.concat(F.lit("nr"), F.when(F.col("event_id") % 5 == 0, "/").otherwise("_"), F.col("user_id").cast("string")).alias("item_id"), (F.col("event_id") % 4 - 1).alias("useful"), F.lit(0).alias("concerned"), F.lit(1).alias("needs_investigation"))
    return engagement.valid_reactions(rows).select("event_id", "valid")


def f11_consent(spark, sf_dir):
    users = people(spark, sf_dir).select(F.col("id").alias("uid"), F.when(F.col("id") % 4 != 0, F.col("id") % 3).alias("accepted_version"))
    return engagement.needs_consent(users, 2).select("uid")


def f12_quarantine(spark, sf_dir):
    now = contests.contest_results(vote_rows(spark, sf_dir))
    pages = now.select(F.col("contest").alias("asked"), F.when(F.col("contest") % 50 != 0, F.col("contest") + F.when(F.col("contest") % 49 == 0, 1).otherwise(0)).alias("heading"), (F.col("contest") % 48 != 0).alias("has_table"), F.col("row_count").alias("n_rows"), F.col("candidate_count").alias("n_candidates"))
    return audits.quarantine_pages(pages).select("asked", "reason")


def s12_lines(spark, sf_dir):
    from hustings.sources.files import quick_reference_lines

    return quick_reference_lines(people(spark, sf_dir).withColumn("votes", F.col("id") * 1000))


QUERIES = {
    f.__name__: f
    for f in (
        j9_overrides, j10_fallbacks, a10_value_audit, j11_linked_files, j15_closest_nation, j18_seat_lookup, j19_bookmark_feed, j20_shown_counts, j21_relevance,
        j22_ranked, a9_coverage, a17_progression, f6_todo, f8_valid_cases, n31_case_display, f10_reaction_checks, f11_consent, f12_quarantine, s12_lines,
    )
}

_FALL = f"""{PEOPLE}, x AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'patched' END AS a, CASE WHEN id % 3 = 1 THEN party END AS b, CASE WHEN id % 2 = 0 THEN 'read' END AS c FROM people),
fb AS (SELECT id, coalesce(a, b, c, 'Not Found') AS value, CASE WHEN a IS NOT NULL THEN 'manual' WHEN b IS NOT NULL THEN 'legacy' WHEN c IS NOT NULL THEN 'local' ELSE 'failed' END AS method FROM x)"""

ORACLES = {
    "j9_overrides": f"WITH {PEOPLE} SELECT id, CASE WHEN id % 10 = 0 THEN concat('fixed ', id) ELSE party END AS profession, CASE WHEN id % 10 = 0 THEN 'manual' ELSE 'text' END AS source FROM people",
    "j10_fallbacks": f"WITH {_FALL} SELECT * FROM fb",
    "a10_value_audit": f"""WITH {_FALL}, l AS (SELECT CASE WHEN id % 5 = 0 THEN 'missing' WHEN value = 'Not Found' THEN 'not_found' ELSE 'verified' END AS label FROM fb),
g AS (SELECT label, count(*) AS rows FROM l GROUP BY 1)
SELECT label, rows, CAST(floor(rows * 10000::DECIMAL(20,0) / (SELECT sum(rows) FROM g) + 0.5) / 100 AS DOUBLE) AS percent FROM g""",
    "j11_linked_files": f"""WITH {PEOPLE}, k AS (SELECT id, trim(regexp_replace(lower(name), '[^a-z0-9]', '_', 'g'), '_') AS k FROM people)
SELECT concat(k, CASE WHEN id % 50 = 0 THEN '_copy' ELSE '' END, '.pdf') AS file, id, CASE WHEN id % 50 = 0 THEN 'contained' ELSE 'exact' END AS how FROM k""",
    "j18_seat_lookup": f"WITH {PEOPLE} SELECT concat(lower(seat), ' (ST)') AS label, coalesce(min(id) FILTER (WHERE id % 3 <> 0), min(id)) AS id FROM people GROUP BY seat",
    "j19_bookmark_feed": f"WITH {ARTICLES}, m AS (SELECT DISTINCT pos % 4 AS uid, candidate_id FROM art WHERE pos % 50 = 0) SELECT uid, candidate_id, pos FROM art JOIN m USING (candidate_id)",
    "j20_shown_counts": "SELECT CAST(event_id AS VARCHAR) AS item_id, CAST(event_id % 3 = 0 AS BIGINT) AS useful, CAST(0 AS BIGINT) AS concerned, CAST(0 AS BIGINT) AS needs_investigation FROM events",
    "j21_relevance": f"WITH {PEOPLE} SELECT event_id AS pos, CASE WHEN id IS NULL THEN NULL WHEN event_id = user_id THEN 'name' ELSE 'loose' END AS kind FROM events LEFT JOIN people ON id = user_id",
    "a9_coverage": f"""WITH {PEOPLE} SELECT count(*) AS total, CAST(floor(count(role) * 10000::DECIMAL(20,0) / count(*) + 0.5) / 10000 AS DOUBLE) AS with_role,
  CAST(floor(count(*) FILTER (WHERE constituency <> '') * 10000::DECIMAL(20,0) / count(*) + 0.5) / 10000 AS DOUBLE) AS with_seat FROM people""",
    "j15_closest_nation": "SELECT lower(n_name) AS key, concat(n_name, ' (state)') AS option FROM nation",
    "s12_lines": f"WITH {PEOPLE} SELECT id, concat('- [', id, '] **', name, '** (', party, ') — ', constituency, ', ', format('{{:,}}', id * 1000), ' votes') AS line FROM people",
    "j22_ranked": f"WITH {PEOPLE}, r AS (SELECT user_id, count(*) AS votes FROM events GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS item_id, votes, name FROM r JOIN people ON id = user_id",
    "a17_progression": f"""WITH {VOTES}, r AS (SELECT contest % 4 AS round, count(*) FILTER (WHERE votes > 25) AS exact FROM votes_ GROUP BY 1)
SELECT round, exact, exact - lag(exact) OVER (ORDER BY round) AS change FROM r""",
    "f6_todo": f"WITH {PEOPLE} SELECT id AS doc, id % 4 AS stamp FROM people WHERE id % 2 = 1 OR id % 3 = 0 OR id % 8 = 0",
    "f8_valid_cases": f"WITH {CASES} SELECT candidate_id, pos FROM cases WHERE pos <> 5",
    "n31_case_display": f"""WITH {CASES} SELECT candidate_id, pos, CASE WHEN pos <> 5 THEN fir_no WHEN bucket = 'pending' THEN '7/2020' ELSE 'N/A' END AS fir,
  coalesce(nullif(sections, ''), 'N/A') AS sections, CASE WHEN pos = 5 THEN '-' ELSE 'charge' END AS description, CASE WHEN bucket = 'pending' THEN 'Pending' ELSE 'Convicted' END AS status FROM cases""",
    "f10_reaction_checks": "SELECT event_id, event_id % 5 <> 0 AND event_id % 4 >= 1 AS valid FROM events",
    "f11_consent": f"WITH {PEOPLE} SELECT id AS uid FROM people WHERE id % 4 = 0 OR id % 3 < 2",
    "f12_quarantine": f"""WITH {VOTES}, n AS (SELECT contest, count(*) AS r, count(*) FILTER (WHERE name <> 'NOTA') AS c FROM votes_ GROUP BY 1)
SELECT contest AS asked, CASE WHEN contest % 50 = 0 THEN 'no heading' WHEN contest % 49 = 0 THEN 'other contest' WHEN contest % 48 = 0 THEN 'no table' WHEN r < 2 THEN 'fewer than 2 rows'
  WHEN c < 2 THEN 'fewer than 2 candidates' END AS reason FROM n""",
}
