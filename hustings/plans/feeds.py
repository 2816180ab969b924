"""News and engagement: events stand for articles and clicks."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.operators import engagement as E
from hustings.operators import news

KINDS = ("click", "view", "purchase")


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def articles(spark, sf_dir):
    return _events(spark, sf_dir).select(
        F.col("user_id").alias("candidate_id"), (F.col("event_id") % 3).alias("query_pos"), (F.col("event_id") % 2).alias("lang_pos"), F.col("event_id").alias("pos"),
        F.concat(F.lit("Title "), "event_type").alias("title"), F.concat(F.lit("HTTPS://News.example/a?utm_x=1&k="), F.regexp_extract("props", "([0-9]+)", 1)).alias("url"),
        F.col("ts").alias("published_at"), F.lit("snippet").alias("snippet"),
    )


ARTICLES = """art AS (SELECT user_id AS candidate_id, event_id % 3 AS query_pos, event_id % 2 AS lang_pos, event_id AS pos, concat('Title ', event_type) AS title,
  concat('HTTPS://News.example/a?utm_x=1&k=', regexp_extract(props, '([0-9]+)', 1)) AS url, ts AS published_at FROM events),
keyed AS (SELECT *, sha1(concat(replace(replace(url, 'HTTPS://News.example', 'https://news.example'), 'utm_x=1&', ''), '|', regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'))) AS key FROM art)"""


def w2_dedupe_cap(spark, sf_dir):
    return news.dedupe_and_cap(articles(spark, sf_dir)).select("candidate_id", "pos", "key", "rank")


def f4_recent(spark, sf_dir):
    return news.recent(articles(spark, sf_dir), F.lit("2024-01-31").cast("timestamp"), 5).select("pos")


def m1_merge(spark, sf_dir):
    a = articles(spark, sf_dir)
    old, fresh = a.where("pos % 2 = 0"), a.where("pos % 2 = 1 and candidate_id % 5 = 0")
    return news.merge_news(old, fresh, a.where("candidate_id % 5 = 0 or candidate_id % 7 = 0").select("candidate_id")).select("candidate_id", "pos")


def _members(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("candidate_id"), F.col("c_mktsegment").alias("party"), F.col("c_name").alias("name"))


def m2_party_feed(spark, sf_dir):
    return news.party_feed(articles(spark, sf_dir), _members(spark, sf_dir), ["BUILDING", "MACHINERY"]).select("url", "candidate_id", "pos")


def m3_merged_feed(spark, sf_dir):
    a = articles(spark, sf_dir)
    return news.merged_feed(a.where("candidate_id % 2 = 0"), a.where("candidate_id % 3 = 0")).select("url", "candidate_id", "pos")


def w4_append(spark, sf_dir):
    p = _members(spark, sf_dir).select("name", F.col("party").alias("constituency"), F.col("candidate_id").alias("pos"))
    return news.append_distinct(p.where("pos % 2 = 0"), p.withColumn("pos", F.col("pos") + 1_000_000)).select("name", "constituency", "pos")


def w10_page(spark, sf_dir):
    placed = news.selected_first(articles(spark, sf_dir).withColumn("uid", F.col("candidate_id") % 10), [1, 2, 3])
    return news.page_slice(placed, 2).select("uid", "pos", "place")


def clicks(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.col("user_id").cast("string").alias("uid"), (F.col("event_id") % 3).cast("string").alias("item_id"), F.col("event_type").alias("reaction"), "ts")


def r1_reaction_state(spark, sf_dir):
    return E.reaction_state(clicks(spark, sf_dir), KINDS).select("uid", "item_id", "reaction")


def r2_deltas(spark, sf_dir):
    return E.reaction_deltas(clicks(spark, sf_dir), KINDS).select("event_id", *KINDS)


def a14_tallies(spark, sf_dir):
    return E.reaction_counts(E.reaction_state(clicks(spark, sf_dir), KINDS), KINDS)


def a15_leading(spark, sf_dir):
    return E.leading_reaction(E.counter_sums(E.reaction_deltas(clicks(spark, sf_dir), KINDS), KINDS), KINDS)


def w6_top_reacted(spark, sf_dir):
    by_user = clicks(spark, sf_dir).withColumn("item_id", F.col("uid"))
    return E.top_reacted(E.reaction_counts(by_user, KINDS), 5, KINDS)


def r4_audit(spark, sf_dir):
    h = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("item_id"), "ts", *((F.col("event_id") % k).alias(r) for k, r in zip((3, 2, 5), E.REACTIONS, strict=True)))
    return E.audit_counters(h).select("item_id", "ts", "ok")


def r5_throttle(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("uid"), "event_id", "ts")
    return E.throttle(e, 6 * 3600).select("uid", "event_id", "accepted")


def r6_bookmarks(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("uid"), (F.col("event_id") % 4).alias("candidate_id"), "ts")
    return E.bookmark_state(e)


def w13_latest(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("uid"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return E.latest_by_user(e, 3).select("uid", "id", "rank")


def m6_erased(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("uid"), "event_id")
    return E.erase_users({"events": e}, e.where("uid % 10 = 3"))["events"]


QUERIES = {
    f.__name__: f
    for f in (
        w2_dedupe_cap, f4_recent, m1_merge, m2_party_feed, m3_merged_feed, w4_append, w10_page, r1_reaction_state, r2_deltas, a14_tallies, a15_leading, w6_top_reacted, r4_audit,
        r5_throttle, r6_bookmarks, w13_latest, m6_erased,
    )
}

CLICKS = """cl AS (SELECT event_id, CAST(user_id AS VARCHAR) AS uid, CAST(event_id % 3 AS VARCHAR) AS item_id, event_type AS reaction, ts FROM events WHERE event_type IN ('click', 'view', 'purchase')),
a AS (SELECT *, CASE WHEN reaction IS DISTINCT FROM lag(reaction) OVER w THEN 1 ELSE 0 END AS f FROM cl WINDOW w AS (PARTITION BY uid, item_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(f) OVER (PARTITION BY uid, item_id ORDER BY ts, event_id) AS run FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY uid, item_id, run ORDER BY ts, event_id) AS k FROM b),
d AS (SELECT *, CASE WHEN k % 2 = 1 THEN reaction END AS now_, CASE WHEN k > 1 THEN CASE WHEN k % 2 = 0 THEN reaction END
  WHEN lag(k) OVER w % 2 = 1 THEN lag(reaction) OVER w END AS prior FROM c WINDOW w AS (PARTITION BY uid, item_id ORDER BY ts, event_id)),
st AS (SELECT uid, item_id, now_ AS reaction FROM (SELECT *, row_number() OVER (PARTITION BY uid, item_id ORDER BY ts DESC, event_id DESC) AS nth FROM d) WHERE nth = 1),
dl AS (SELECT event_id, item_id, """ + ", ".join(f"CAST((coalesce(now_ = '{r}', false))::INT - (coalesce(prior = '{r}', false))::INT AS INTEGER) AS {r}" for r in KINDS) + " FROM d)"

ORACLES = {
    "w2_dedupe_cap": f"""WITH {ARTICLES}, f AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, key ORDER BY query_pos, lang_pos, pos) AS nth FROM keyed),
r AS (SELECT candidate_id, pos, key, row_number() OVER (PARTITION BY candidate_id ORDER BY published_at DESC, query_pos, lang_pos, pos) AS rank FROM f WHERE nth = 1)
SELECT candidate_id, pos, key, rank FROM r WHERE rank <= 25""",
    "f4_recent": "SELECT event_id AS pos FROM events WHERE ts >= TIMESTAMP '2024-01-26'",
    "m1_merge": f"WITH {ARTICLES} SELECT candidate_id, pos FROM art WHERE (pos % 2 = 0 AND candidate_id % 5 <> 0 AND candidate_id % 7 <> 0) OR (pos % 2 = 1 AND candidate_id % 5 = 0)",
    "m2_party_feed": f"""WITH {ARTICLES}, x AS (SELECT url, candidate_id, pos, row_number() OVER (PARTITION BY url ORDER BY candidate_id, pos) AS nth
  FROM art JOIN customer ON c_custkey = candidate_id WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) SELECT url, candidate_id, pos FROM x WHERE nth = 1""",
    "m3_merged_feed": f"""WITH {ARTICLES}, u AS (SELECT 0 AS s, * FROM art WHERE candidate_id % 2 = 0 UNION ALL SELECT 1, * FROM art WHERE candidate_id % 3 = 0),
x AS (SELECT url, candidate_id, pos, row_number() OVER (PARTITION BY url ORDER BY s, pos) AS nth FROM u) SELECT url, candidate_id, pos FROM x WHERE nth = 1""",
    "w4_append": "SELECT c_name AS name, c_mktsegment AS constituency, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1000000 END AS pos FROM customer",
    "w10_page": f"""WITH {ARTICLES}, p AS (SELECT candidate_id % 10 AS uid, pos, row_number() OVER (PARTITION BY candidate_id % 10 ORDER BY candidate_id IN (1, 2, 3) DESC, published_at DESC, pos) AS place FROM art)
SELECT uid, pos, place FROM p WHERE place BETWEEN 21 AND 40""",
    "r1_reaction_state": f"WITH {CLICKS} SELECT uid, item_id, reaction FROM st",
    "r2_deltas": f"WITH {CLICKS} SELECT event_id, click, view, purchase FROM dl",
    "a14_tallies": f"WITH {CLICKS} SELECT item_id, " + ", ".join(f"count(*) FILTER (WHERE reaction = '{r}') AS {r}" for r in KINDS) + " FROM st GROUP BY 1",
    "a15_leading": f"""WITH {CLICKS}, t AS (SELECT item_id, """ + ", ".join(f"CAST(sum({r}) AS BIGINT) AS {r}" for r in KINDS) + """ FROM dl GROUP BY 1)
SELECT *, click + view + purchase AS total, CASE WHEN click + view + purchase = 0 THEN NULL WHEN click >= view AND click >= purchase THEN 'click' WHEN view >= purchase THEN 'view' ELSE 'purchase' END AS lead FROM t""",
    "w6_top_reacted": "WITH x AS (SELECT event_type AS reaction, CAST(user_id AS VARCHAR) AS item_id, count(*) AS votes FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY reaction ORDER BY votes DESC, item_id) AS rank FROM x) SELECT reaction, item_id, votes, rank FROM r WHERE rank <= 5",
    "r4_audit": """WITH h AS (SELECT CAST(user_id AS VARCHAR) AS item_id, ts, event_id % 3 AS a, event_id % 2 AS b, event_id % 5 AS c FROM events)
SELECT item_id, ts, abs(a - coalesce(lag(a) OVER w, 0)) <= 1 AND abs(b - coalesce(lag(b) OVER w, 0)) <= 1 AND abs(c - coalesce(lag(c) OVER w, 0)) <= 1 AS ok FROM h WINDOW w AS (PARTITION BY item_id ORDER BY ts)""",
    "r6_bookmarks": "SELECT user_id AS uid, event_id % 4 AS candidate_id, max(ts) AS created_at FROM events GROUP BY 1, 2 HAVING count(*) % 2 = 1",
    "w13_latest": "SELECT uid, id, rank FROM (SELECT user_id AS uid, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 3",
    "m6_erased": "SELECT user_id AS uid, event_id FROM events WHERE user_id % 10 <> 3",
}
