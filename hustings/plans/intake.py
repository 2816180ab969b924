"""Sources, sinks and streams: files that Spark writes from the driver's tables are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.operators import engagement as E
from hustings.plans.feeds import ARTICLES, articles
from hustings.plans.messy import ORACLES as MESSY
from hustings.plans.people import PEOPLE, people
from hustings.sources import files, html
from hustings.streaming import live


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one_file_a_row(texts, path):
    """Each row of one column as a file of its own."""
    texts.write.option("maxRecordsPerFile", 1).text(path)


def _blocks(rows, block, order, before, after, text="json"):
    """Texts of each block (a stretch of ids, so of bounded size), joined by commas between ``before`` and ``after``."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return rows.groupBy(block.alias("block")).agg(F.concat(F.lit(before), F.array_join(listed, ","), F.lit(after)).alias("value")).select("value")


def s1_candidates(spark, sf_dir):
    p = people(spark, sf_dir)
    record = F.to_json(F.struct("id", "name", "constituency", "party", "criminal_cases", "dob", "role", "ministries", F.create_map(F.lit("x"), F.col("party")).alias("social_media")))
    path = files.scratch(spark)
    _one_file_a_row(_blocks(p.select("id", record.alias("json")), F.floor(F.col("id") / 500), "id", "[\n", "\n]"), path)
    read = files.read_candidates(spark, path)
    return read.select("id", "name", "constituency", "party", "criminal_cases", "dob", "role", F.get("ministries", F.lit(0))["name"].alias("ministry"), F.col("social_media")["x"].alias("link"), F.col("education"))


def s2_keyed_news(spark, sf_dir):
    a = articles(spark, sf_dir)
    item = F.struct("title", "url", F.lit("S").alias("source"), F.col("published_at").cast("string").alias("published_at"), "snippet")
    own = a.groupBy("candidate_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("pos", item.alias("item")))), lambda x: x["item"])).alias("items"))
    path = files.scratch(spark)
    pair = own.select("candidate_id", F.concat(F.lit('"'), F.col("candidate_id").cast("string"), F.lit('":'), F.col("items")).alias("json"))
    _one_file_a_row(_blocks(pair, F.floor(F.col("candidate_id") / 20), "candidate_id", '{"by_candidate": {', "}}"), f"{path}/good")
    _one_file_a_row(a.where("pos = 1").select(F.concat(F.lit("{nope "), F.col("pos").cast("string")).alias("value")), f"{path}/broken")
    return files.read_news(spark, f"{path}/*").select("candidate_id", F.col("pos").cast("long").alias("pos"), "title", "url", "source", "snippet")


def s3_electors(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 3 == 0, "2019").when(F.col("c_custkey") % 11 == 0, "").otherwise("2024").alias("Year"), (F.col("c_custkey") % 400).alias("Constituency_No"),
        F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.floor("c_acctbal").cast("string")).alias("Electors"), F.col("c_custkey").alias("Row"),
    )
    path = files.scratch(spark)
    # All rows of a constituency in one file, in order: its first row is the first of that file.
    c.repartition("Constituency_No").sortWithinPartitions("Row").write.csv(path, header=True, compression="gzip")
    return files.read_electors_csv(spark, path, 2024)


def _failures(spark, sf_dir, path):
    e = _t(spark, sf_dir, "events").where("event_type in ('error', 'click')")
    line = F.to_json(F.struct((F.col("user_id") % 97).alias("id"), F.col("event_type").alias("name"), F.concat(F.lit("reason "), F.col("event_id").cast("string")).alias("reason"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")))
    e.select(F.when(F.col("event_id") % 13 == 0, F.concat(F.lit('{"id": '), F.col("event_type"))).otherwise(line).alias("value")).write.text(path)


def s4_failures(spark, sf_dir):
    path = files.scratch(spark)
    _failures(spark, sf_dir, path)
    return files.consolidate_failures(spark, path)


def _cells(tag, *values):
    return F.concat(F.lit("<tr>"), *(x for v in values for x in (F.lit(f"<{tag}>"), v, F.lit(f"</{tag}>"))), F.lit("</tr>"))


_HEAD = "<tr><th>SN</th><th>Candidate</th><th>Party</th><th>EVM</th><th>Postal</th><th>Total Votes</th><th>%</th></tr>"


def result_pages(spark, sf_dir, before: str):
    """A page for each order: a table of its lines below a decoy; every ninth line is short, every seventh blank."""
    n = F.col("l_linenumber")
    votes = F.format_number(F.col("l_quantity").cast("long") * 1000, 0)
    full = _cells("td", n.cast("string"), F.when((n + F.col("l_orderkey")) % 7 == 0, "").otherwise(F.concat(F.lit("S&amp;"), F.col("l_suppkey").cast("string"))), F.when((n + F.col("l_orderkey")) % 7 == 0, "").otherwise(F.col("l_returnflag")), votes, F.lit("-"), F.when((n + F.col("l_orderkey")) % 7 == 0, "0").otherwise(votes), F.col("l_quantity").cast("string"))
    row = F.when((n + F.col("l_orderkey")) % 9 == 0, "<tr><td>short</td></tr>").otherwise(full)
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", row.alias("tr"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "tr"))), lambda x: x["tr"]), "\n")
    return rows.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.concat(F.lit("<script>var t = '<table>';</script><table><tr><td>decoy</td></tr></table><table>" + before + _HEAD), body, F.lit("</table><table>" + _HEAD + "</table>")).alias("html"))


def s5_result_tables(spark, sf_dir):
    return html.vote_rows(html.html_table_rows(result_pages(spark, sf_dir, ""), ["Candidate", "Total Votes"], 7)).select("contest", "name", "party", "evm_votes", "postal_votes", "votes", "percent")


def s6_nested_tables(spark, sf_dir):
    pages = result_pages(spark, sf_dir, "<tr><td>Results of the seat</td></tr>")
    return html.vote_rows(html.html_table_rows(pages, ["Candidate", "Total Votes"], 7, header_anywhere=True)).select("contest", "name", "party", "votes")


def s7_labelled_facts(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    k, big = F.col("o_orderkey"), F.format_number(F.col("o_custkey") + 100_000, 0)
    electors = F.when(k % 3 != 0, _cells("td", F.lit("Registered electors"), F.lit("12"), big)).otherwise("")
    votes = F.when(k % 5 == 0, "").otherwise(_cells("td", F.when(k % 2 == 0, "Turnout").otherwise("Total votes polled"), F.format_number(F.col("o_custkey") + 50_000, 0), (k % 100 + F.lit(0.5)).cast("string"), F.lit("120.5")))
    caption = F.concat(F.lit("<caption>"), F.when(k % 11 == 0, "2019").otherwise("2024"), F.lit(" election: <b>Seat</b> (45,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(")</caption>"))
    page = F.concat(F.lit("<table><tr><td>Registered electors</td><td>7</td></tr></table><table>"), caption, votes, electors, F.lit("</table>"))
    return html.labelled_table_facts(o.select(k.alias("page_id"), page.alias("html")), "^2024").select("page_id", "electors", "votes", "votes_source", "percent")


def s8_feed_items(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    title = F.when(F.col("event_id") % 15 == 0, " ").otherwise(F.concat(F.lit("News &amp; "), F.col("event_type")))
    link = F.when(F.col("event_id") % 35 == 0, "").otherwise(F.concat(F.lit("<link>http://n.example/"), F.col("event_id").cast("string"), F.lit("</link>")))
    date = F.when(F.col("event_id") % 25 == 0, "soon").otherwise(F.concat(F.lit("Mon, "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title>"), link, F.lit("<description>d</description><pubDate>"), date, F.lit('</pubDate><source url="u">S'), (F.col("event_id") % 3).cast("string"), F.lit("</source></item>"))
    path = files.scratch(spark)
    _one_file_a_row(_blocks(e.select("event_id", "user_id", item.alias("json")), F.floor(F.col("event_id") / 500), "event_id", '<rss version="2.0"><channel>', "</channel></rss>"), path)
    return files.read_feed_items(spark, path)


def s9_file_hashes(spark, sf_dir):
    path = files.scratch(spark)
    _one_file_a_row(_t(spark, sf_dir, "supplier").select(F.concat_ws(" ", "s_suppkey", "s_name").alias("value")), path)
    return files.file_sha1(spark, path).select("length", "sha1")


def s10_published(spark, sf_dir):
    p = people(spark, sf_dir).select("id", "name")
    path = files.scratch(spark)
    files.gated_write(p, p.where("name is null"), path, "1")
    found = files.gated_write(p, p.where("id % 2 = 0"), path, "2", dry_run=True)  # writes nothing
    return spark.read.parquet(path).select("id", "name", F.col("version").cast("string").alias("version"), F.lit(found).alias("problems"))


def s11_nested_items(spark, sf_dir):
    path = files.scratch(spark)
    files.write_keyed(articles(spark, sf_dir).select("candidate_id", "pos", "title", "url"), "candidate_id", path)
    back = spark.read.schema("candidate_id long, items array<struct<title:string,url:string>>").json(path)
    return back.select("candidate_id", F.size("items").alias("n"), F.get("items", F.lit(0))["url"].alias("first_url"), F.md5(F.array_join(F.transform("items", lambda x: x["url"]), "|")).alias("urls"))


def s13_expected_keys(spark, sf_dir):
    return files.expect_count(_t(spark, sf_dir, "nation"), "n_nationkey", 25).select("n_nationkey", "n_name")


# ---- streams


def _drain(stream, mode, path, spark, stateful=False, batch=None):
    """Run a stream over all that is there, into files (or through ``batch``)."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if stateful:
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
        query = writer.foreachBatch(batch).start() if batch else writer.format("parquet").option("path", f"{path}/out").start()
        query.awaitTermination()
    finally:
        if stateful:
            spark.conf.set(key, before) if before else spark.conf.unset(key)


def _clicks(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", E.REACTIONS[0]).when(F.col("event_type") == "view", E.REACTIONS[1]).when(F.col("event_type") == "purchase", E.REACTIONS[2]).otherwise("none")
    return _t(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("uid"), (F.col("event_id") % 3).cast("string").alias("item_id"), kind.alias("reaction"), "ts")


def _streamed(spark, df, path):
    df.write.parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{path}/in")


def r3_live_counts(spark, sf_dir):
    path = files.scratch(spark)
    counts = live.live_counts(live.live_deltas(_streamed(spark, _clicks(spark, sf_dir), path)))
    _drain(counts, "complete", path, spark, True, lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out"))
    return spark.read.parquet(f"{path}/out")


def r5_live_throttle(spark, sf_dir):
    path = files.scratch(spark)
    e = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("uid"), "event_id", "ts")
    _drain(live.live_throttle(_streamed(spark, e, path), 6 * 3600), "append", path, spark, True)
    return spark.read.parquet(f"{path}/out").select("uid", "event_id", "accepted")


def r8_failure_log(spark, sf_dir):
    path = files.scratch(spark)
    _failures(spark, sf_dir, f"{path}/in")
    _drain(live.failure_stream(spark, f"{path}/in"), "append", path, spark)
    return spark.read.parquet(f"{path}/out")


def r9_news_intake(spark, sf_dir):
    from hustings.functions import articles as A

    path = files.scratch(spark)
    a = articles(spark, sf_dir).select("candidate_id", A.dedupe_key("url", "title").alias("key"), "published_at")
    _drain(live.news_stream(_streamed(spark, a, path)), "append", path, spark)
    return spark.read.parquet(f"{path}/out").select("candidate_id", "key")


QUERIES = {
    f.__name__: f
    for f in (
        s1_candidates, s2_keyed_news, s3_electors, s4_failures, s5_result_tables, s6_nested_tables, s7_labelled_facts, s8_feed_items, s9_file_hashes, s10_published, s11_nested_items, s13_expected_keys,
        r3_live_counts, r5_live_throttle, r8_failure_log, r9_news_intake,
    )
}

_LOG = """log AS (SELECT user_id % 97 AS id, event_type AS name, 'reason ' || event_id AS reason, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp FROM events
  WHERE event_type IN ('error', 'click') AND event_id % 13 <> 0)"""
_ROWS = """r AS (SELECT l_orderkey AS contest, 'S&' || l_suppkey AS name, l_returnflag AS party, CAST(l_quantity AS BIGINT) * 1000 AS v, CAST(l_quantity AS DOUBLE) AS percent,
  (l_linenumber + l_orderkey) % 7 = 0 AS blank FROM lineitem WHERE (l_linenumber + l_orderkey) % 9 <> 0)"""
_FOLD = """cl AS (SELECT event_id, CAST(user_id AS VARCHAR) AS uid, CAST(event_id % 3 AS VARCHAR) AS item_id, event_type AS reaction, ts FROM events WHERE event_type IN ('click', 'view', 'purchase')),
a AS (SELECT *, CASE WHEN reaction IS DISTINCT FROM lag(reaction) OVER w THEN 1 ELSE 0 END AS f FROM cl WINDOW w AS (PARTITION BY uid, item_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(f) OVER (PARTITION BY uid, item_id ORDER BY ts, event_id) AS run FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY uid, item_id, run ORDER BY ts, event_id) AS k, row_number() OVER (PARTITION BY uid, item_id ORDER BY ts DESC, event_id DESC) AS nth FROM b)"""

ORACLES = {
    "s1_candidates": f"WITH {PEOPLE} SELECT CAST(id AS INTEGER) AS id, name, constituency, party, criminal_cases, dob, role, ministry, party AS link, CAST(NULL AS VARCHAR) AS education FROM people",
    "s2_keyed_news": f"WITH {ARTICLES} SELECT CAST(candidate_id AS VARCHAR) AS candidate_id, row_number() OVER (PARTITION BY candidate_id ORDER BY pos) - 1 AS pos, title, url, 'S' AS source, 'snippet' AS snippet FROM art",
    "s3_electors": """WITH c AS (SELECT c_custkey AS r, c_custkey % 400 AS contest, CAST(floor(c_acctbal) AS BIGINT) AS electors FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 7 <> 0),
x AS (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY r) AS nth FROM c WHERE contest > 0 AND electors > 0) SELECT CAST(contest AS INTEGER) AS contest, electors FROM x WHERE nth = 1""",
    "s4_failures": f"WITH {_LOG} SELECT CAST(id AS INTEGER) AS id, max_by(name, timestamp) AS name, max_by(reason, timestamp) AS reason, max(timestamp) AS timestamp FROM log GROUP BY id",
    "s5_result_tables": f"WITH {_ROWS} SELECT contest, CASE WHEN blank THEN '' ELSE name END AS name, CASE WHEN blank THEN '' ELSE party END AS party, v AS evm_votes, CAST(0 AS BIGINT) AS postal_votes, CASE WHEN blank THEN 0 ELSE v END AS votes, percent FROM r",
    "s6_nested_tables": f"WITH {_ROWS} SELECT contest, name, party, v AS votes FROM r WHERE NOT blank",
    "s7_labelled_facts": """SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey + 100000 ELSE 45000 + o_orderkey % 1000 END AS electors, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey + 50000 END AS votes,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'turnout' ELSE 'total votes polled' END AS votes_source, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 100 + 0.5 AS DOUBLE) END AS percent FROM orders WHERE o_orderkey % 11 <> 0""",
    "s8_feed_items": """SELECT 'News & ' || event_type AS title, 'http://n.example/' || event_id AS url, 'S' || (event_id % 3) AS source, CASE WHEN event_id % 25 <> 0 THEN date_trunc('second', ts) END AS published_at, 'd' AS snippet
FROM events WHERE event_id % 15 <> 0 AND event_id % 35 <> 0""",
    "s9_file_hashes": "SELECT CAST(length(s_suppkey || ' ' || s_name) + 1 AS BIGINT) AS length, sha1(s_suppkey || ' ' || s_name || chr(10)) AS sha1 FROM supplier",
    "s10_published": f"WITH {PEOPLE} SELECT id, name, '1' AS version, CAST((SELECT count(*) FROM people WHERE id % 2 = 0) AS INTEGER) AS problems FROM people",
    "s11_nested_items": f"WITH {ARTICLES} SELECT candidate_id, CAST(count(*) AS INTEGER) AS n, min_by(url, pos) AS first_url, md5(string_agg(url, '|' ORDER BY pos)) AS urls FROM art GROUP BY 1",
    "s13_expected_keys": "SELECT n_nationkey, n_name FROM nation",
    "r3_live_counts": f"WITH {_FOLD} SELECT item_id, " + ", ".join(f"count(*) FILTER (WHERE nth = 1 AND k % 2 = 1 AND reaction = '{x}') AS {y}" for x, y in zip(("click", "view", "purchase"), E.REACTIONS, strict=True)) + " FROM c GROUP BY 1",
    "r5_live_throttle": MESSY["r5_accepted"],
    "r8_failure_log": f"WITH {_LOG} SELECT CAST(id AS INTEGER) AS id, name, reason, timestamp FROM log",
    "r9_news_intake": f"WITH {ARTICLES} SELECT DISTINCT candidate_id, key FROM keyed",
}
