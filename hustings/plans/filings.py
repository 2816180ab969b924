"""Filings: model answers, form texts, links of filing rows, identity, review queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.functions import articles as A
from hustings.functions import cases as C
from hustings.operators import audits, cases, linkage, news, pages
from hustings.plans.facts import PAGES, page_rows
from hustings.plans.feeds import ARTICLES, articles
from hustings.plans.messy import _TITLES, _WORDS, FOLK, _at, _pick, folk


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answers(spark, sf_dir):
    """What a model says to a page: bare, fenced, narrated, null parts, or no JSON at all."""
    o = _t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    one = F.concat(F.lit('{"fir_no":"'), (k % 90).cast("string"), F.lit('/2020","description":"d","sections":"'), F.col("o_orderpriority"), F.lit('","confidence":0.'), (60 + k % 20).cast("string"), F.lit("}"))
    body = F.when(k % 7 == 0, F.concat(F.lit('{"pending":null,"convictions":['), one, F.lit("]}"))).otherwise(F.concat(F.lit('{"pending":['), one, F.lit(',{"description":""},{"fir_no":"","description":"only words"}],"convictions":[]}')))
    said = F.when(k % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 5 == 2, F.concat(F.lit("Here it is: "), body, F.lit(" as asked"))).when(k % 5 == 3, "no cases here").when(k % 5 == 4, F.concat(F.lit("  "), body))
    return o.select(k.alias("doc"), (F.col("o_custkey") % 30).alias("page"), said.when(k % 5 == 0, body).alias("response"))


def n21_model_answers(spark, sf_dir):
    return cases.explode_cases(answers(spark, sf_dir)).select("doc", "page", "bucket", F.col("pos").cast("long").alias("pos"), "fir_no", "description", "sections", "raw_text", "needs_review")


FORMS = (
    "9 Profession/Occupation (a) Self Farmer (own land)", "Profession / other. Profession/Occupation as told, Self Advocate\nand more", "Self Profession : N/A (x)", "Self  Profession: Trader (x) y", "nothing of it",
    "9 Profession/Occupation (a) Self nil (", "Profession/Occupation Self ab",
)
SECTIONS = (
    "(9) Details of profession or so\n(a) Self: Farmer, trader\nb) Spouse: \nTeacher. (9A) Details", "(a) Self here\nBusiness & trade\nSpouse\nMP", "(9) Details of profession\nATP\n(9A)", "none of it", "(a) Self\nSocial Worker\n",
)
SCHOOLING = (
    "completed B.A (Give details) from X University, ", "M.A NOTARY here and on", "SSC * star", "Cell: 98765 B.Com -", "", "  completed   Intermediate  College.", "Not Not Applicable at all",
)
SUMMARIES = ("Highest educational qualification: B.A of X", "Educational  Qualification - none", "has B.Com. from Y College and more", "MBBS Z University", "SSC", "My M.Sc from Q School")


def n26_professions(spark, sf_dir):
    p = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    pair = C.extract_profession_pair(_pick(SECTIONS, "id", 7))
    return p.select(
        "id", C.extract_profession(_pick(FORMS, "id")).alias("n26"), pair["self"].alias("n27_self"), pair["spouse"].alias("n27_spouse"), C.clean_education(_pick(SCHOOLING, "id", 3)).alias("n28"),
        C.extract_education(_pick(SUMMARIES, "id", 2)).alias("n30"),
    )


def n32_ages(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    now = F.lit("2024-02-15 12:00:00").cast("timestamp")
    shift = F.expr("make_dt_interval(cast((event_id * event_id) % 700 as int), 0, 0, 0)")
    at = F.when(F.col("event_id") % 6 == 0, now - F.expr("make_dt_interval(0, 0, cast(event_id % 200 as int), 0)")).otherwise(F.col("ts").cast("timestamp") - shift)
    age = A.relative_age(at, now)
    return e.select("event_id", age["amount"].cast("long").alias("amount"), age["unit"].alias("unit"), age["stale"].alias("stale"))


def f7_review_queue(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")  # noqa: E741
    case = F.struct(F.concat(F.col("l_partkey").cast("string"), F.lit("/2021")).alias("fir_no"), (F.col("l_suppkey") % 3 == 0).alias("needs_review"))
    own = lambda flag: F.transform(F.sort_array(F.collect_list(F.when(flag, F.struct("l_linenumber", case.alias("c"))))), lambda x: x["c"])
    df = l.groupBy(F.col("l_orderkey").alias("id")).agg(own(F.col("l_returnflag") != "R").alias("criminal_details_pending"), own(F.col("l_returnflag") == "R").alias("criminal_details_convictions"))
    return cases.needs_review(df).select("id", "bucket", F.col("pos").cast("long").alias("pos"), F.col("case.fir_no").alias("fir_no"))


SEATS = 60


def _filings(spark, sf_dir):
    """Filing rows and candidates of one seat: names in other order, as initials, with words too many."""
    p = folk(spark, sf_dir).withColumn("seat", F.concat(F.lit("S"), (F.col("id") % SEATS).cast("string")))
    line = F.when(F.col("id") % 3 == 0, F.concat(F.col("name"), F.lit(" Longword"))).when(F.col("id") % 3 == 1, F.regexp_replace("name", r"(\w)\w+ (\w+)$", "$1 $2")).otherwise(F.col("name"))
    said = F.when(F.col("id") % 4 != 0, F.concat(F.lit("Party : "), F.coalesce("party", F.lit("none"))))
    rows = p.select("seat", "pos", line.alias("name_line"), said.alias("party_line"), _pick(("accepted", "Rejected", "accepted", "withdrawn by own", ""), "id").alias("status"))
    cands = p.select("id", "name", F.when(F.col("id") % 5 == 0, "Gil").alias("alias"), "seat", "party")
    return rows, cands


def j12_filings(spark, sf_dir):
    return linkage.link_filings(*_filings(spark, sf_dir))


def j13_filings_weak(spark, sf_dir):
    return linkage.link_filings_weak(*_filings(spark, sf_dir))


DEPONENTS = ("I Asha Verran son of someone, do say", "whereas the deponent Bel Quill says so", "of Hart and Gil only", "no name here", "I tarn wife of x", "Verran alone is here")


def j14_identity(spark, sf_dir):
    p = folk(spark, sf_dir).withColumn("key", F.col("id"))
    docs = _t(spark, sf_dir, "orders").select((F.col("o_custkey")).alias("key"), _pick(DEPONENTS, "o_orderkey").alias("text"), "o_orderkey")
    # One document for each person: the first order.
    own = docs.groupBy("key").agg(F.min_by("text", "o_orderkey").alias("text"))
    return linkage.verify_identity(own, p).select("key", "verified", "how")


def a11_extraction(spark, sf_dir):
    p = folk(spark, sf_dir)
    counts = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("gathered"))
    failures = p.where("name is null").select("id", F.lit("no name").alias("reason"))
    return audits.extraction_audit(counts, failures)


def p11_summary_pages(spark, sf_dir):
    rows = page_rows(spark, sf_dir)
    mark = F.when((F.col("page") % 5 == 3) & (F.col("doc") % 2 == 0), "part b - summary").when(F.col("page") == 20, "Summary").otherwise("")
    return pages.summary_page(rows.select("doc", "page", F.concat("text", mark).alias("text"))).select("doc", F.col("summary_page").cast("long").alias("summary_page"))


def w11_selected_first(spark, sf_dir):
    placed = news.selected_first(articles(spark, sf_dir).withColumn("uid", F.col("pos") % 7), [2, 5, 9])
    return placed.select("uid", "pos", "place")


def m4_pages(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    span = lambda a, n: F.when(n > 0, F.sequence(a, a + n - 1)).otherwise(F.array().cast("array<bigint>"))
    df = o.select(F.col("o_orderkey").alias("doc"), span(F.col("o_custkey") % 9 + 1, F.col("o_orderkey") % 5).alias("pending_pages"), span(F.col("o_orderkey") % 11 + 1, F.col("o_custkey") % 4).alias("conviction_pages"))
    return audits.pages_to_process(df).select("doc", F.array_join("pages", ",").alias("pages"))


def m5_merged_links(spark, sf_dir):
    p = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    i = F.col("id")
    link = lambda k, s: F.struct(F.lit(k).alias("key"), F.concat(F.lit(s), i.cast("string")).alias("value"))
    some = lambda *entries: F.map_from_entries(F.filter(F.array(*(F.when(c, e) for c, e in entries)), lambda x: x.isNotNull()))
    df = p.select("id", some((i % 2 == 0, link("x", "x.a/")), (i % 3 == 0, link("web", "w.a/"))).alias("a"), some((i % 5 == 0, link("x", "x.b/")), (i % 7 == 0, link("mail", "m.b/"))).alias("b"))
    flat = lambda c: F.array_join(F.sort_array(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " ")
    both = audits.merge_maps(audits.merge_maps(df, "a", "b", out="overwritten"), "a", "b", "fill", out="filled")
    return both.select("id", flat("overwritten").alias("overwritten"), flat("filled").alias("filled"))


QUERIES = {
    f.__name__: f
    for f in (
        n21_model_answers, n26_professions, n32_ages, f7_review_queue, j12_filings, j13_filings_weak, j14_identity, a11_extraction, p11_summary_pages, w11_selected_first, m4_pages, m5_merged_links,
    )
}


_CLEAN_JOB = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''), '(?i)\(a\)|Self|\(b\)|Spouse|[:\-—–.,]', '', 'g'), '[^a-zA-Z\s,&/]', '', 'g'), '\s+', ' ', 'g'))"
_JOB = "CASE WHEN lower({0}) IN ('percy', 'not applicable', 'nil nil', 'atp', 'acquired', 's/o', 'd/o', 'not found', 'notnot') OR (length({0}) < 3 AND lower({0}) NOT IN ('mla', 'mp', 'ips', 'ias', 'ifs')) THEN 'Not Found' ELSE {0} END"


def _phrase(pattern: str) -> str:
    value = rf"trim(regexp_replace(trim(regexp_extract(f, '{pattern}', 1)), '\(.*?\)', '', 'g'))"
    return f"CASE WHEN length({value}) > 2 AND lower({value}) NOT IN ('nil', 'n/a') THEN {value} END"


def _schooling() -> str:
    text = "replace(s, 'completed ', '')"
    for junk in C.EDUCATION_JUNK:
        text = f"regexp_replace({text}, '(?is){junk}', '', 'g')"
    return rf"trim(trim(regexp_replace({text}, ' +', ' ', 'g')), ',.- ' || chr(9))"


_PERSON = r"trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''), '\(.*?\)', '', 'g'), '(?i)\b(" + _TITLES + r"|m.a|b.a|b.ed|p.hd|notary|adv)\b', '', 'g'), '[^a-zA-Z\s]', '', 'g')), '\s+', ' ', 'g'))"

_SET = "list_sort(list_distinct(" + _WORDS + "))"
_SQUASH = r"lower(regexp_replace(regexp_replace(coalesce({}, ''), '\(.*?\)', '', 'g'), '[^a-zA-Z0-9]', '', 'g'))"
_FOREIGN = f"len(list_filter(g.free, lambda x : length(x) > 3 AND x NOT IN {linkage.FILING_WORDS}))"


def _given(target: str, row: str) -> str:
    """Words of a name given away one by one: how many were, and which of the row are free."""
    fits = "list_filter(a.free, lambda r : (length(r) = 1 AND starts_with(x.w, r)) OR (length(x.w) = 1 AND starts_with(r, x.w)))[1]"
    words = f"list_transform(list_sort(list_transform({target}, lambda v : {{'n': -length(v), 'w': v}})), lambda v : {{'h': 0, 'free': []::VARCHAR[], 'w': v.w}})"
    return f"""list_reduce(list_prepend({{'h': 0, 'free': {row}, 'w': ''}}, {words}), lambda a, x : {{'h': a.h + CASE WHEN list_contains({row}, x.w) OR {fits} IS NOT NULL THEN 1 ELSE 0 END,
  'free': CASE WHEN list_contains({row}, x.w) THEN list_filter(a.free, lambda y : y <> x.w) ELSE list_filter(a.free, lambda y : y IS DISTINCT FROM {fits}) END, 'w': ''}})"""


ORACLES = {
    "n21_model_answers": r"""WITH o AS (SELECT o_orderkey AS k, o_custkey % 30 AS page, '{"fir_no":"' || (o_orderkey % 90) || '/2020","description":"d","sections":"' || o_orderpriority || '","confidence":0.' || (60 + o_orderkey % 20) || '}' AS one FROM orders),
b AS (SELECT k, page, CASE WHEN k % 7 = 0 THEN '{"pending":null,"convictions":[' || one || ']}' ELSE '{"pending":[' || one || ',{"description":""},{"fir_no":"","description":"only words"}],"convictions":[]}' END AS body FROM o),
s AS (SELECT k, page, CASE k % 5 WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 2 THEN 'Here it is: ' || body || ' as asked' WHEN 3 THEN 'no cases here' WHEN 4 THEN '  ' || body ELSE body END AS said FROM b),
t AS (SELECT k, page, trim(replace(replace(said, '```json', ''), '```', ''), ' ' || chr(10)) AS t FROM s), j AS (SELECT k, page, regexp_extract(t, '(?s)(\{.*\})', 1) AS j FROM t),
l AS (SELECT k, page, 'pending' AS bucket, CAST(json_extract(j, '$.pending') AS JSON[]) AS items FROM j WHERE j <> '' UNION ALL SELECT k, page, 'convictions', CAST(json_extract(j, '$.convictions') AS JSON[]) FROM j WHERE j <> ''),
e AS (SELECT k, page, bucket, unnest(items) AS c, generate_subscripts(items, 1) - 1 AS pos FROM l),
f AS (SELECT k AS doc, page, bucket, pos, c->>'$.fir_no' AS fir_no, c->>'$.description' AS description, c->>'$.sections' AS sections, CAST(c->>'$.confidence' AS DOUBLE) AS conf FROM e)
SELECT doc, page, bucket, pos, fir_no, description, sections, 'FIR: ' || coalesce(fir_no, '') || ' | Desc: ' || coalesce(description, '') AS raw_text, coalesce(conf < 0.7, false) AS needs_review FROM f WHERE coalesce(fir_no, '') <> '' OR coalesce(description, '') <> ''""",
    "n26_professions": rf"""WITH x AS (SELECT c_custkey AS id, replace({_at(FORMS, f'(c_custkey % {len(FORMS)})')}, chr(10), ' ') AS f, {_at(SECTIONS, f'((c_custkey // 7) % {len(SECTIONS)})')} AS b,
  {_at(SCHOOLING, f'((c_custkey // 3) % {len(SCHOOLING)})')} AS s, {_at(SUMMARIES, f'((c_custkey // 2) % {len(SUMMARIES)})')} AS q FROM customer),
k AS (SELECT *, coalesce(nullif(regexp_extract(b, '(?is)\(9\)\s*Details\s*of\s*profession.*?\n(.*?)(\(9A\)|9A|\d+\s*Details|Source\s*of\s*income|$)', 1), ''), nullif(regexp_extract(b, '(?is)\(a\)\s*Self.*?\n(.*)', 1), '')) AS block FROM x),
c AS (SELECT *, coalesce(regexp_matches(block, '(?is)^(.*?)(spouse|b\)).*?\n(.*)$'), false) AS two FROM k),
p AS (SELECT *, {_CLEAN_JOB.format("CASE WHEN two THEN regexp_extract(block, '(?is)^(.*?)(spouse|b[)]).*?[' || chr(10) || '](.*)$', 1) ELSE block END")} AS own,
  {_CLEAN_JOB.format("CASE WHEN two THEN regexp_extract(block, '(?is)^(.*?)(spouse|b[)]).*?[' || chr(10) || '](.*)$', 3) END")} AS other, {_schooling()} AS school FROM c)
SELECT id, coalesce({_phrase(r'(?i)9\s+Profession/Occupation\s+\(a\)\s+Self\s+([^(\n]+)')}, {_phrase(r'(?i)Profession/Occupation.*?Self\s+([^(\n]+)')}, {_phrase(r'(?i)Self\s+Profession\s*:\s*([^(\n]+)')}) AS n26,
  {_JOB.format('own')} AS n27_self, CASE WHEN two THEN {_JOB.format('other')} ELSE 'Not Found' END AS n27_spouse, CASE WHEN school <> '' THEN 'completed ' || school ELSE school END AS n28,
  coalesce(trim(nullif(regexp_extract(q, '(?is)(Highest\s+)?educational\s+qualification\s*[:.\-]?\s*(.*)', 2), '')),
    nullif(regexp_extract(q, '(?i)(B\.A|B\.Sc|B\.Com|B\.Tech|M\.A|M\.Sc|MBBS|SSC|Intermediate)\.?\s*.*?(University|College|School)', 0), '')) AS n30 FROM p""",
    "n32_ages": """WITH t AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN TIMESTAMP '2024-02-15 12:00:00' - to_minutes(event_id % 200) ELSE ts - to_days(CAST((event_id * event_id) % 700 AS INTEGER)) END AS t FROM events),
d AS (SELECT event_id, floor(epoch(t)) - epoch(TIMESTAMP '2024-02-15 12:00:00') AS d FROM t),
u AS (SELECT *, CASE WHEN abs(d) < 60 THEN 1 WHEN abs(d) < 3600 THEN 60 WHEN abs(d) < 86400 THEN 3600 WHEN abs(d) < 604800 THEN 86400 WHEN abs(d) < 2592000 THEN 604800 WHEN abs(d) < 31536000 THEN 2592000 ELSE 31536000 END AS s FROM d)
SELECT event_id, CAST(floor(d / s + 0.5) AS BIGINT) AS amount, CASE s WHEN 1 THEN 'second' WHEN 60 THEN 'minute' WHEN 3600 THEN 'hour' WHEN 86400 THEN 'day' WHEN 604800 THEN 'week' WHEN 2592000 THEN 'month' ELSE 'year' END AS unit, -d > 7200 AS stale FROM u""",
    "f7_review_queue": """WITH c AS (SELECT l_orderkey AS id, CASE WHEN l_returnflag = 'R' THEN 'convictions' ELSE 'pending' END AS bucket, l_linenumber AS n, l_partkey || '/2021' AS fir_no, l_suppkey % 3 = 0 AS review FROM lineitem),
p AS (SELECT *, row_number() OVER (PARTITION BY id, bucket ORDER BY n, fir_no, review) - 1 AS pos FROM c) SELECT id, bucket, pos, fir_no FROM p WHERE review""",
    "j13_filings_weak": rf"""WITH {FOLK}, p AS (SELECT *, id % {SEATS} AS seat FROM folk),
r AS (SELECT seat, id AS pos, CASE id % 3 WHEN 0 THEN name || ' Longword' WHEN 1 THEN regexp_replace(name, '(\w)\w+ (\w+)$', '\1 \2') ELSE name END AS line, CASE WHEN id % 4 <> 0 THEN lower('Party : ' || coalesce(party, 'none')) END AS said FROM p),
a AS (SELECT seat, pos, said, {_WORDS.format('line')} AS a FROM r), c AS (SELECT id, seat, lower(party) AS party, {_WORDS.format('name')} AS b FROM p)
SELECT id, 'S' || c.seat AS seat, min(pos) AS pos FROM a JOIN c ON a.seat = c.seat WHERE list_has_any(a, b) AND contains(said, party) GROUP BY id, c.seat""",
    "j12_filings": rf"""WITH {FOLK}, p AS (SELECT *, 'S' || (id % {SEATS}) AS seat FROM folk),
r AS (SELECT seat, id AS pos, CASE id % 3 WHEN 0 THEN name || ' Longword' WHEN 1 THEN regexp_replace(name, '(\w)\w+ (\w+)$', '\1 \2') ELSE name END AS line, CASE WHEN id % 4 <> 0 THEN lower('Party : ' || coalesce(party, 'none')) END AS said,
  ['accepted', 'Rejected', 'accepted', 'withdrawn by own', ''][id % 5 + 1] AS status FROM p),
a AS (SELECT seat, pos, said, {_SET.format('line')} AS own, {_SET.format('said')} AS side FROM r WHERE NOT regexp_matches(lower(status), 'rejected|withdrawn')),
c AS (SELECT id, seat, party, {_SET.format('party')} AS code, unnest(list_filter([name, CASE WHEN id % 5 = 0 THEN 'Gil' END], lambda x : x IS NOT NULL)) AS who FROM p),
w AS (SELECT *, {_SET.format('who')} AS ws FROM c),
m AS (SELECT id, w.seat, pos, party, said, ws, own, code, side, {_given('ws', 'own')} AS g FROM w JOIN a ON a.seat = w.seat),
f AS (SELECT *, g.h / len(ws) * 100 AS score FROM m WHERE len(ws) > 0 AND len(own) > 0 AND g.h / len(ws) * 100 >= 50 AND {_FOREIGN} = 0),
q AS (SELECT * REPLACE (CASE WHEN said IS NOT NULL AND len(code) > 0 AND len(side) > 0 THEN {_given('code', 'side')} END AS g), {_SQUASH.format('said')} AS sq, {_SQUASH.format('party')} AS pq FROM f),
k AS (SELECT * FROM q WHERE said IS NULL OR ((coalesce(g.h / len(code) * 100 >= 50 AND {_FOREIGN} = 0, false) OR contains(sq, pq)
    OR (pq = 'tdp' AND contains(said, 'telugu desam')) OR (pq = 'ysrcp' AND (contains(said, 'yuvajana') OR contains(said, 'ysr'))) OR (pq = 'bjp' AND contains(said, 'bharatiya janata'))
    OR (pq = 'jsp' AND contains(said, 'janasena')) OR (pq = 'inc' AND contains(said, 'indian national congress')))
  AND NOT (contains(sq, 'jatiyajanasena') AND NOT contains(pq, 'jatiya')))),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos, score DESC) AS nth FROM k) SELECT id, seat, pos, score FROM n WHERE nth = 1""",
    "j14_identity": rf"""WITH {FOLK}, d AS (SELECT o_custkey AS key, min_by({_at(DEPONENTS, f'(o_orderkey % {len(DEPONENTS)})')}, o_orderkey) AS text FROM orders GROUP BY 1),
j AS (SELECT key, {_PERSON.format('text')} AS t, list_distinct(list_filter(string_split({_PERSON.format('name')}, ' '), lambda w : w <> '')) AS ws FROM d JOIN folk ON id = key),
s AS (SELECT *, list_filter(regexp_split_to_array(coalesce(nullif(coalesce(nullif(regexp_extract(t, '^(i|l)\s+([a-z\s]{{3,100}}?)\s+(son|daughter|wife|slo|dlo|wlo)\s+of', 2), ''), regexp_extract(t, 'deponent\s+([a-z\s]{{3,100}})', 1)), ''), ''), '\s+'), lambda w : w <> '') AS said FROM j),
n AS (SELECT key, list_filter(ws, lambda p : list_contains(said, p) OR len(list_filter(said, lambda f : length(f) > 3 AND length(p) > 3 AND (contains(f, p) OR contains(p, f)))) > 0) AS near, list_filter(ws, lambda p : length(p) >= 3 AND contains(t, p)) AS anywhere FROM s),
v AS (SELECT key, len(near) >= 2 OR (len(near) = 1 AND length(near[1]) > 4) AS a, len(anywhere) >= 2 OR (len(anywhere) = 1 AND length(anywhere[1]) > 5) AS b FROM n)
SELECT key, a OR b AS verified, CASE WHEN a THEN 'deponent' WHEN b THEN 'text' ELSE 'none' END AS how FROM v""",
    "a11_extraction": f"""WITH {FOLK}, g AS (SELECT o_custkey AS id, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n FROM orders GROUP BY 1)
SELECT id, 'extracted' AS state, NULL AS reason FROM g WHERE n > 0 UNION ALL SELECT id, 'failed', 'no name' FROM folk WHERE name IS NULL""",
    "p11_summary_pages": f"""WITH {PAGES}, m AS (SELECT doc, page, upper(text || CASE WHEN page % 5 = 3 AND doc % 2 = 0 THEN 'part b - summary' WHEN page = 20 THEN 'Summary' ELSE '' END) AS t, max(page) OVER (PARTITION BY doc) AS n FROM pg)
SELECT doc, min(page) FILTER (WHERE contains(t, 'PART B') OR contains(t, 'SUMMARY')) AS summary_page FROM m WHERE page > n - 13 GROUP BY doc""",
    "w11_selected_first": f"""WITH {ARTICLES} SELECT pos % 7 AS uid, pos, row_number() OVER (PARTITION BY pos % 7 ORDER BY candidate_id IN (2, 5, 9) DESC, published_at DESC, pos) AS place FROM art""",
    "m4_pages": """WITH s AS (SELECT o_orderkey AS doc, list_concat(CASE WHEN o_orderkey % 5 > 0 THEN range(o_custkey % 9 + 1, o_custkey % 9 + 1 + o_orderkey % 5) ELSE [] END,
  CASE WHEN o_custkey % 4 > 0 THEN range(o_orderkey % 11 + 1, o_orderkey % 11 + 1 + o_custkey % 4) ELSE [] END) AS p FROM orders) SELECT doc, array_to_string(list_sort(list_distinct(p)), ',') AS pages FROM s""",
    "m5_merged_links": """SELECT c_custkey AS id, concat_ws(' ', CASE WHEN c_custkey % 7 = 0 THEN 'mail=m.b/' || c_custkey END, CASE WHEN c_custkey % 3 = 0 THEN 'web=w.a/' || c_custkey END,
  CASE WHEN c_custkey % 5 = 0 THEN 'x=x.b/' || c_custkey WHEN c_custkey % 2 = 0 THEN 'x=x.a/' || c_custkey END) AS overwritten, concat_ws(' ', CASE WHEN c_custkey % 7 = 0 THEN 'mail=m.b/' || c_custkey END,
  CASE WHEN c_custkey % 3 = 0 THEN 'web=w.a/' || c_custkey END, CASE WHEN c_custkey % 2 = 0 THEN 'x=x.a/' || c_custkey WHEN c_custkey % 5 = 0 THEN 'x=x.b/' || c_custkey END) AS filled FROM customer""",
}
