"""Case facts and pages: order lines stand for case rows, document lines for pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.functions import cases as C
from hustings.operators import audits, cases, contests, linkage, pages
from hustings.plans.contests import VOTES, vote_rows


def case_rows(spark, sf_dir, *more):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    return l.select(
        *more,
        F.col("l_orderkey").alias("candidate_id"),
        F.when(F.col("l_linenumber") % 3 == 0, "convictions").otherwise("pending").alias("bucket"),
        F.col("l_linenumber").alias("pos"),
        F.when(F.col("l_linenumber") == 5, "NIL").otherwise(F.concat(F.lit("Cr.No. 0"), (F.col("l_partkey") % 4).cast("string"), F.lit("/"), (F.year("l_shipdate") % 100).cast("string"))).alias("fir_no"),
        F.when(F.col("l_linenumber") == 4, "").otherwise(F.concat(F.lit("U/s "), (F.col("l_suppkey") % 520).cast("string"), F.lit(" IPC"))).alias("sections"),
        F.concat(F.lit("text "), F.col("l_returnflag")).alias("raw_text"),
        F.when(F.col("l_linenumber") == 5, "-").otherwise("charge").alias("description"),
    )


CASES = """cases AS (SELECT l_orderkey AS candidate_id, CASE WHEN l_linenumber % 3 = 0 THEN 'convictions' ELSE 'pending' END AS bucket, l_linenumber AS pos,
  CASE WHEN l_linenumber = 5 THEN 'NIL' ELSE concat('Cr.No. 0', l_partkey % 4, '/', year(l_shipdate) % 100) END AS fir_no,
  CASE WHEN l_linenumber = 4 THEN '' ELSE concat('U/s ', l_suppkey % 520, ' IPC') END AS sections, concat('text ', l_returnflag) AS raw_text FROM lineitem),
signed AS (SELECT *, upper(concat(fir_no, raw_text, sections)) AS j FROM cases),
sig AS (SELECT *, regexp_extract(regexp_replace(j, '[^A-Z0-9/\\-]', '', 'g'), '([0-9]+)([/\\-]|OF)([0-9]{2,4})', 1) AS num,
  regexp_extract(regexp_replace(j, '[^A-Z0-9/\\-]', '', 'g'), '([0-9]+)([/\\-]|OF)([0-9]{2,4})', 3) AS yr FROM signed),
sg AS (SELECT candidate_id, bucket, pos, fir_no, sections, raw_text, CASE WHEN num <> '' THEN concat(CAST(num AS BIGINT), '/', CASE WHEN length(yr) = 2 THEN concat('20', yr) ELSE yr END)
  ELSE substr(regexp_replace(upper(concat(fir_no, sections)), '[^A-Z0-9]+', '', 'g'), 1, 80) END AS signature FROM sig),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, bucket, signature ORDER BY pos) AS nth FROM sg) WHERE nth = 1),
cl AS (SELECT *, CASE WHEN sections = '' THEN NULL ELSE CAST(regexp_extract(sections, '([0-9]+)', 1) AS INTEGER) END AS num FROM firsts),
cat AS (SELECT *, CASE WHEN num IN """ + str(tuple(C.SERIOUS)) + """ THEN 'Serious/Violent' WHEN num IN """ + str(tuple(C.CORRUPTION)) + """ THEN 'Corruption & Fraud'
  WHEN num IN """ + str(tuple(C.ELECTION)) + """ THEN 'Election Offenses' WHEN num IN """ + str(tuple(C.POLITICAL)) + """ THEN 'Political/Protest' ELSE 'Minor/Other' END AS category FROM cl)"""


def w1_dedupe_cases(spark, sf_dir):
    return cases.dedupe_cases(case_rows(spark, sf_dir)).select("candidate_id", "bucket", "pos", "signature")


def _first_cases(spark, sf_dir):
    """The first case of each signature; of cases of one position (lines of an order can share a number) the one stored first."""
    files = spark.read.parquet(f"{sf_dir}/lineitem.parquet").inputFiles()
    stored = {"row": F.col("_metadata.row_index")} if len(files) == 1 else {"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")}
    rows = case_rows(spark, sf_dir, *(c.alias(f"stored_{k}") for k, c in stored.items()))
    return cases.dedupe_cases(rows, then=[f"stored_{k}" for k in stored])


def n23_categories(spark, sf_dir):
    d = _first_cases(spark, sf_dir)
    return d.select("candidate_id", "bucket", "pos", C.classify_sections(F.coalesce(F.nullif(F.col("sections"), F.lit("")), F.col("raw_text"))).alias("category"))


def a2_category_counts(spark, sf_dir):
    return cases.category_counts(_first_cases(spark, sf_dir))


def a3_reconcile(spark, sf_dir):
    counts = cases.dedupe_cases(case_rows(spark, sf_dir)).groupBy("candidate_id").agg(F.count("*").alias("extracted_count"))
    stated = counts.withColumns({"abstract_count": F.when(F.col("candidate_id") % 3 == 0, F.col("candidate_id") % 4), "style3_count": F.when(F.col("candidate_id") % 2 == 0, F.lit(4).cast("long"))})
    return cases.reconcile_counts(stated)


def w9_disclosure(spark, sf_dir):
    labelled = case_rows(spark, sf_dir).withColumn("category", C.classify_sections("sections"))
    return cases.disclosure_rows(labelled).select("candidate_id", "bucket", "pos", "place")


def _gaps(spark, sf_dir):
    n = cases.dedupe_cases(case_rows(spark, sf_dir)).groupBy(F.col("candidate_id").alias("id")).agg(F.count("*").alias("count"))
    return audits.validation_rows(n.withColumn("cases", F.when(F.col("id") % 11 != 0, F.col("id") % 8)))


def a5_validation_summary(spark, sf_dir):
    return audits.validation_summary(_gaps(spark, sf_dir))


def w7_top_gaps(spark, sf_dir):
    return audits.top_gaps(_gaps(spark, sf_dir)).select("id", "count", "cases", "diff", "side")


def w12_keep_best(spark, sf_dir):
    g = _gaps(spark, sf_dir).where("cases is not null")
    old, new = g.select("id", "count"), g.where("id % 2 = 0").select("id", (F.col("count") + 1).alias("count"))
    return cases.keep_best(old, new, g.select("id", F.col("cases").alias("truth")))


def a16_compare_runs(spark, sf_dir):
    g = _gaps(spark, sf_dir).where("cases is not null")
    runs = g.select("id", "count", F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("model"), (F.col("id") % 100).alias("seconds"))
    return audits.compare_runs(runs, g.select("id", F.col("cases").alias("truth")))


def page_rows(spark, sf_dir):
    """Lines of documents as pages, with headings appended by document and page number."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = d.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("page", F.col("at") + 1)
    mark = (
        F.when((F.col("page") == 1) & (F.col("doc") % 2 == 0), "(5) Pending criminal cases FIR No 12/2019 (a) (b) (c)")
        .when((F.col("page") == 2) & (F.col("doc") % 3 == 0), "Case 1 and Case 2")
        .when((F.col("page") == 3) & (F.col("doc") % 5 != 0), "(6) Cases of conviction")
        .when(F.col("page") == 4, "movable assets")
        .otherwise("")
    )
    return p.select("doc", "page", F.concat("line", F.lit("\n"), mark).alias("text"), F.when(F.col("page") % 7 == 0, "ocr").otherwise("text").alias("method"))


def p8_page_index(spark, sf_dir):
    i = pages.page_index(page_rows(spark, sf_dir))
    flat = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return i.select("doc", "s5", "s5_how", "s6", "s6_how", "s7", flat("pending_pages"), flat("conviction_pages"), "pending_style", "pending_hint", "conviction_hint", "total_pages", "extraction_method", "status")


def marked_pages(spark, sf_dir):
    """Pages of documents with headings, tables, totals and annexures strewn over them by number."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = d.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("page", F.col("at") + 1)
    return p.select("doc", "page", F.concat("line", F.lit("\n"), F.get(F.array(*map(F.lit, MARKS)), (F.col("doc") * 7 + F.col("page") * (F.col("doc") % 5 + 3)).cast("int") % len(MARKS))).alias("text"), F.when((F.col("page") + F.col("doc")) % 9 == 0, "ocr").otherwise("text").alias("method"))


MARKS = (
    "", "(5) Pending criminal cases", "( 5 ) pending: FIR No 12/2019 (a) (b) (c) u/s 420 IPC", "Pending  Criminal Cases", "Case 1\nCASE-2 case:300", "1 2 3\n text Cr.No. 7 / 2020", "(6) Cases of conviction", "no case of that kind",
    "have not been convicted", "all cases of conviction", "some cases of conviction here", "(7) That I give", "details of the deposit", "Total number of pending criminal cases: 0", "No. of pending criminal case - 3", "NOT APPLICABLE (a) (b)",
    "ANNEXURE J - Legal Cases", "as per separate as per separate as per separate annexure", "(d) (e) (f) sec 12", "5/2021 and 006/1999", "number of convicted cases 0", "| 1 | 2 |", "Case No. 45 of 18", "",
)


def p8_index_of_marked(spark, sf_dir):
    i = pages.page_index(marked_pages(spark, sf_dir))
    flat = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return i.select("doc", "s5", "s5_how", "s6", "s6_how", "s7", flat("pending_pages"), flat("conviction_pages"), "pending_style", "pending_hint", "conviction_hint", "total_pages", "extraction_method", "status")


def a7_index_summary(spark, sf_dir):
    i = pages.page_index(page_rows(spark, sf_dir)).select("status", "extraction_method", F.col("pending_style").alias("style"), (F.col("s5_how") == "fallback").alias("fallback"))
    return audits.index_summary(i)


def a4_case_headers(spark, sf_dir):
    return cases.style3_count(page_rows(spark, sf_dir))


def p9_first_pages(spark, sf_dir):
    w = pages.page_window(page_rows(spark, sf_dir), first=2, last=1)
    return w.select("doc", F.length("text").alias("chars"), F.md5("text").alias("md5"))


def p10_text_layer(spark, sf_dir):
    return pages.text_layer(page_rows(spark, sf_dir))


def a18_doc_method(spark, sf_dir):
    return audits.doc_method(page_rows(spark, sf_dir))


PAGES = """pages_ AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
pg AS (SELECT doc, page, concat(line, chr(10), CASE WHEN page = 1 AND doc % 2 = 0 THEN '(5) Pending criminal cases FIR No 12/2019 (a) (b) (c)'
  WHEN page = 2 AND doc % 3 = 0 THEN 'Case 1 and Case 2' WHEN page = 3 AND doc % 5 <> 0 THEN '(6) Cases of conviction' WHEN page = 4 THEN 'movable assets' ELSE '' END) AS text,
  CASE WHEN page % 7 = 0 THEN 'ocr' ELSE 'text' END AS method FROM pages_)"""


def w5_ranked_votes(spark, sf_dir):
    return contests.rank_votes(vote_rows(spark, sf_dir)).select("contest", "pos", "rank")


def j5_previous(spark, sf_dir):
    """The contest before (order number less 1) as the former election."""
    now = contests.contest_results(vote_rows(spark, sf_dir))
    cands = now.select("contest", F.concat(F.lit("Mr "), "winner_name", F.lit(" X")).alias("name"))
    before = now.select((F.col("contest") + 1).alias("contest"), "winner_name", "winner_party", "winner_votes", "margin")
    return linkage.attach_previous(cands, before, 2019)


def j7_electors(spark, sf_dir):
    now = contests.contest_results(vote_rows(spark, sf_dir)).select("contest", "polled")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("contest"), F.floor("c_acctbal").cast("long").alias("electors"))
    return linkage.attach_electors(now, c.where("contest % 2 = 0"), c.where("contest % 3 = 0"))


def a8_elector_sources(spark, sf_dir):
    return audits.source_counts(j7_electors(spark, sf_dir), "electors_source")


def j8_cross_validation(spark, sf_dir):
    now = contests.contest_results(vote_rows(spark, sf_dir)).select("contest", "polled", "nota_votes")
    web = now.select("contest", (F.col("polled") - F.pmod("contest", F.lit(130)) + 20).alias("votes"))
    return linkage.cross_validate(web, now)


QUERIES = {
    f.__name__: f
    for f in (
        w1_dedupe_cases, n23_categories, a2_category_counts, a3_reconcile, w9_disclosure, a5_validation_summary, w7_top_gaps, w12_keep_best, a16_compare_runs, p8_page_index, p8_index_of_marked,
        a7_index_summary, a4_case_headers, p9_first_pages, p10_text_layer, a18_doc_method, w5_ranked_votes, j5_previous, j7_electors, a8_elector_sources, j8_cross_validation,
    )
}

_GAPS = f"""{CASES}, n AS (SELECT candidate_id AS id, count(*) AS count FROM firsts GROUP BY 1),
g AS (SELECT id, count, CASE WHEN id % 11 <> 0 THEN id % 8 END AS cases FROM n), gd AS (SELECT *, count - cases AS diff FROM g)"""
_NOW = f"""{VOTES}, now_ AS (SELECT contest, CAST(sum(votes) AS BIGINT) AS polled, CAST(coalesce(sum(votes) FILTER (WHERE name = 'NOTA'), 0) AS BIGINT) AS nota_votes FROM votes_ GROUP BY contest)"""
_ELECTORS = f"""{_NOW}, c AS (SELECT c_custkey AS contest, CAST(floor(c_acctbal) AS BIGINT) AS electors FROM customer WHERE floor(c_acctbal) > 0),
el AS (SELECT n.contest, polled, coalesce(a.electors, b.electors) AS electors,
  CASE WHEN a.electors IS NOT NULL THEN 'current' WHEN b.electors IS NOT NULL THEN 'older' ELSE 'missing' END AS electors_source,
  CASE WHEN a.electors IS NOT NULL THEN CAST(floor(polled * 10000::DECIMAL(20,0) / a.electors + 0.5) / 100 AS DOUBLE) END AS turnout
  FROM now_ n LEFT JOIN (SELECT * FROM c WHERE contest % 2 = 0) a ON a.contest = n.contest LEFT JOIN (SELECT * FROM c WHERE contest % 3 = 0) b ON b.contest = n.contest)"""

MARKED = """pages_ AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
pg AS (SELECT doc, page, concat(line, chr(10), [""" + ", ".join("'" + m.replace("\n", "' || chr(10) || '") + "'" for m in MARKS) + f"""][(doc * 7 + page * (doc % 5 + 3)) % {len(MARKS)} + 1]) AS text, CASE WHEN (page + doc) % 9 = 0 THEN 'ocr' ELSE 'text' END AS method FROM pages_)"""


def _hit(pattern: str) -> str:
    return "regexp_matches(text, '" + pattern + "')"


def _all(pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(text, '{pattern}', {group})"


#: What a pattern engine without look-around makes of "not behind the word all".
_LOOSE6 = r"(?i)have\s+not\s+been\s+convicted|convicted\s+for\s+the\s+offences|(^|^(?s:.)|^(?s:..)|^(?s:...)|[^a](?s:...)|(?s:.)[^l](?s:..)|(?s:..)[^l](?s:.)|(?s:...)\S)Cases?\s+of\s+Convict"
_BARE = r"\b[0-9]{1,5}\s*/\s*(?:19|20)[0-9]{2}\b"
_INDEX = f"""{PAGES}, f AS (SELECT doc, page, method, {_hit(pages.ANCHORS['s5_strict'])} AS a5, {_hit(pages.ANCHORS['s5_loose'])} AS b5, {_hit(pages.ANCHORS['s6_strict'])} AS a6, {_hit(_LOOSE6)} AS b6,
  {_hit(pages.ANCHORS['s7_strict'])} AS a7, {_hit(pages.ANCHORS['s7_loose'])} AS b7,
  try_cast(nullif(regexp_extract(text, '{pages.TOTALS['stated_pending']}', 1), '') AS BIGINT) AS sp, try_cast(nullif(regexp_extract(text, '{pages.TOTALS['stated_convictions']}', 1), '') AS BIGINT) AS sc,
  list_distinct(list_transform(list_concat({_all(pages.QUALIFIED)}, {_all(_BARE)}), lambda x : regexp_replace(x, '\\s+', '', 'g'))) AS firs,
  list_filter(list_distinct(list_transform({_all(pages.CASE_HEADER, 1)}, lambda x : CAST(x AS INTEGER))), lambda x : x BETWEEN 1 AND 200) AS heads,
  len(regexp_split_to_array(nullif(regexp_extract(text, '{pages.TOP_ROW}', 1), ''), '\\W+')) AS top, list_distinct(list_transform({_all(pages.ROW_LETTER, 1)}, lambda x : lower(x))) AS letters,
  {_hit(pages.PENAL)} AS penal, {_hit(pages.ANNEXURE)} AS annexure, len({_all(pages.SEPARATE)}) >= 3 AND contains(lower(text), 'annexure') AS redirect,
  regexp_matches(lower(text), 'not appliciable|not applicable') AS na FROM pg WHERE page <= {pages.MAX_PAGES}),
t AS (SELECT * REPLACE (CASE WHEN top >= 2 THEN top END AS top), len(firs) > 0 OR len(heads) > 0 OR coalesce(top, 0) >= 2 OR (len(letters) >= 3 AND (len(firs) > 0 OR penal)) AS tab FROM f),
u AS (SELECT *, CASE WHEN len(heads) > 0 THEN 'style_3' WHEN top IS NOT NULL THEN 'style_2' WHEN tab THEN 'style_1' END AS style, tab OR na OR len(letters) >= 2 AS sig FROM t),
x5 AS (SELECT doc, count(*) AS n, min(page) FILTER (WHERE a5) AS s, min(page) FILTER (WHERE b5) AS l, min(page) FILTER (WHERE annexure) AS ax, arg_min(sp, page) FILTER (WHERE sp IS NOT NULL) AS sp, arg_min(sc, page) FILTER (WHERE sc IS NOT NULL) AS sc,
  CASE WHEN min(method) = max(method) THEN min(method) ELSE 'mixed' END AS extraction_method FROM u GROUP BY doc),
y5 AS (SELECT * EXCLUDE (s, l), coalesce(s, l) AS s5, CASE WHEN s IS NOT NULL THEN 'header' WHEN l IS NOT NULL THEN 'fallback' END AS s5_how FROM x5),
x6 AS (SELECT y.*, (SELECT min(page) FROM u WHERE u.doc = y.doc AND a6 AND page > coalesce(s5, 0)) AS s, (SELECT min(page) FROM u WHERE u.doc = y.doc AND b6 AND page > coalesce(s5, 0)) AS l,
  (SELECT min(page) FROM u WHERE u.doc = y.doc AND page > ax AND NOT annexure AND NOT tab) AS ax_stop FROM y5 y),
y6 AS (SELECT * EXCLUDE (s, l), coalesce(s, l) AS s6, CASE WHEN s IS NOT NULL THEN 'header' WHEN l IS NOT NULL THEN 'fallback' END AS s6_how FROM x6),
y7 AS (SELECT y.*, coalesce((SELECT min(page) FROM u WHERE u.doc = y.doc AND a7 AND page > coalesce(s6, s5, 0)), (SELECT min(page) FROM u WHERE u.doc = y.doc AND b7 AND page > coalesce(s6, s5, 0))) AS s7 FROM y6 y),
z AS (SELECT *, least(CASE WHEN coalesce(s6, s7) IS NOT NULL THEN least(coalesce(s6, s7) - 1, s5 + {pages.MAX_SPAN - 1}) ELSE s5 + {pages.NO_END_SPAN - 1} END, n) AS p_last,
  least(CASE WHEN s7 IS NOT NULL THEN least(s7 - 1, s6 + {pages.MAX_SPAN - 1}) ELSE s6 + {pages.NO_END_SPAN - 1} END, n) AS c_last, CASE WHEN ax IS NULL THEN [] ELSE range(ax, coalesce(ax_stop - 1, n) + 1)[:{pages.MAX_SPAN}] END AS ann FROM y7),
g AS (SELECT z.*, CASE WHEN s5 IS NULL OR p_last < s5 THEN [] ELSE range(s5, greatest(s5, coalesce((SELECT max(page) FROM u WHERE u.doc = z.doc AND sig AND page BETWEEN s5 AND p_last), s5)) + 1) END AS pp,
  CASE WHEN s6 IS NULL OR c_last < s6 THEN [] ELSE range(s6, greatest(s6, coalesce((SELECT max(page) FROM u WHERE u.doc = z.doc AND sig AND page BETWEEN s6 AND c_last), s6)) + 1) END AS cp FROM z),
h AS (SELECT g.* EXCLUDE (pp, cp), CASE WHEN sp = 0 THEN [] WHEN len(ann) > 0 AND (len(pp) = 0 OR EXISTS (SELECT 1 FROM u WHERE u.doc = g.doc AND redirect AND list_contains(pp, page))) THEN ann ELSE pp END AS pp, CASE WHEN sc = 0 THEN [] ELSE cp END AS cp FROM g),
k AS (SELECT h.doc, kind, bool_or(style = 'style_3') AS three, bool_or(style = 'style_2') AS two, bool_or(style IS NOT NULL) AS any_, len(list_distinct(flatten(list(heads)))) AS n_heads, CAST(sum(coalesce(top, 0)) AS INTEGER) AS tops, len(list_distinct(flatten(list(firs)))) AS n_firs
  FROM h, (SELECT unnest(['p', 'c']) AS kind), u WHERE u.doc = h.doc AND list_contains(CASE kind WHEN 'p' THEN pp ELSE cp END, page) GROUP BY h.doc, kind),
m AS (SELECT doc, kind, CASE WHEN three AND n_heads > 0 THEN 'style_3' WHEN two THEN 'style_2' WHEN any_ THEN 'style_1' END AS style, CASE WHEN three AND n_heads > 0 THEN n_heads WHEN two THEN tops WHEN any_ THEN nullif(n_firs, 0) END AS hint FROM k),
idx AS (SELECT h.doc, s5, s5_how, s6, s6_how, s7, array_to_string(pp, ',') AS pending_pages, array_to_string(cp, ',') AS conviction_pages, p.style AS pending_style, CAST(p.hint AS INTEGER) AS pending_hint, CAST(c.hint AS INTEGER) AS conviction_hint,
  CAST(n AS INTEGER) AS total_pages, extraction_method, CASE WHEN s5 IS NOT NULL OR s6 IS NOT NULL THEN 'ok' ELSE 'headers_missed' END AS status
  FROM h LEFT JOIN m p ON p.doc = h.doc AND p.kind = 'p' LEFT JOIN m c ON c.doc = h.doc AND c.kind = 'c')"""

ORACLES = {
    "p8_page_index": f"WITH {_INDEX} SELECT * FROM idx",
    "p8_index_of_marked": f"WITH {_INDEX.replace(PAGES, MARKED)} SELECT * FROM idx",
    "a7_index_summary": f"""WITH {_INDEX} SELECT 'status' AS kind, coalesce(status, 'none') AS value, count(*) AS documents, count(*) FILTER (WHERE s5_how = 'fallback') AS fallbacks FROM idx GROUP BY status
UNION ALL SELECT 'extraction_method', coalesce(extraction_method, 'none'), count(*), count(*) FILTER (WHERE s5_how = 'fallback') FROM idx GROUP BY extraction_method
UNION ALL SELECT 'style', coalesce(pending_style, 'none'), count(*), count(*) FILTER (WHERE s5_how = 'fallback') FROM idx GROUP BY pending_style""",
    "a4_case_headers": rf"""WITH {PAGES}, n AS (SELECT doc, unnest(regexp_extract_all(text, '(?i)\bcase\s+0*([0-9]{{1,6}})\b', 1)) AS n FROM pg)
SELECT doc, count(DISTINCT CAST(n AS INTEGER)) AS style3_count FROM n GROUP BY doc HAVING count(DISTINCT CAST(n AS INTEGER)) >= 2""",
    "w1_dedupe_cases": f"WITH {CASES} SELECT candidate_id, bucket, pos, signature FROM firsts",
    "n23_categories": f"WITH {CASES} SELECT candidate_id, bucket, pos, category FROM cat",
    "a2_category_counts": f"""WITH {CASES} SELECT candidate_id, count(*) FILTER (WHERE category = 'Serious/Violent') AS serious,
  count(*) FILTER (WHERE category = 'Corruption & Fraud') AS corruption, count(*) FILTER (WHERE category = 'Election Offenses') AS election,
  count(*) FILTER (WHERE category = 'Political/Protest') AS political, count(*) FILTER (WHERE category = 'Minor/Other') AS minor FROM cat GROUP BY 1""",
    "a3_reconcile": f"""WITH {CASES}, n AS (SELECT candidate_id, count(*) AS extracted_count, CASE WHEN candidate_id % 3 = 0 THEN candidate_id % 4 END AS abstract_count,
  CASE WHEN candidate_id % 2 = 0 THEN CAST(4 AS BIGINT) END AS style3_count FROM firsts GROUP BY 1)
SELECT *, CASE WHEN abstract_count > 0 THEN abstract_count WHEN style3_count >= 2 AND style3_count > extracted_count THEN style3_count ELSE extracted_count END AS num_criminal_cases,
  CASE WHEN abstract_count > 0 THEN 'stated_total' WHEN style3_count >= 2 AND style3_count > extracted_count THEN 'case_headers' ELSE 'extracted' END AS count_source FROM n""",
    "w9_disclosure": f"""WITH {CASES}, v AS (SELECT *, CASE WHEN sections = '' THEN NULL ELSE CAST(regexp_extract(sections, '([0-9]+)', 1) AS INTEGER) END AS num FROM cases WHERE fir_no <> 'NIL'),
c AS (SELECT *, CASE WHEN num IN {tuple(C.SERIOUS)} THEN 1 WHEN num IN {tuple(C.CORRUPTION)} THEN 2 WHEN num IN {tuple(C.ELECTION)} THEN 3 WHEN num IN {tuple(C.POLITICAL)} THEN 4 ELSE 5 END AS k FROM v)
SELECT candidate_id, bucket, pos, row_number() OVER (PARTITION BY candidate_id ORDER BY bucket = 'pending' DESC, CASE WHEN bucket = 'pending' THEN k END, pos) AS place FROM c""",
    "a5_validation_summary": f"""WITH {_GAPS} SELECT count(*) AS total, count(diff) AS matched, count(*) FILTER (WHERE diff = 0) AS exact, count(*) FILTER (WHERE abs(diff) <= 2) AS within_2,
  count(*) FILTER (WHERE diff <> 0) AS discrepancies, count(*) FILTER (WHERE diff > 0) AS overcounts, count(*) FILTER (WHERE diff < 0) AS undercounts,
  count(*) FILTER (WHERE diff IS NULL) AS unmatched FROM gd""",
    "w7_top_gaps": f"""WITH {_GAPS} SELECT * FROM (SELECT id, count, cases, diff, 'over' AS side FROM gd WHERE diff > 0 ORDER BY diff DESC, id LIMIT 10)
UNION ALL SELECT * FROM (SELECT id, count, cases, diff, 'under' AS side FROM gd WHERE diff < 0 ORDER BY diff, id LIMIT 10)""",
    "w12_keep_best": f"""WITH {_GAPS}, k AS (SELECT id, cases AS truth, count AS old, CASE WHEN id % 2 = 0 THEN count + 1 END AS fresh FROM gd WHERE cases IS NOT NULL)
SELECT id, truth, CASE WHEN coalesce(abs(fresh - truth) < abs(old - truth), false) THEN fresh ELSE old END AS count,
  coalesce(abs(fresh - truth) < abs(old - truth), false) AS replaced FROM k""",
    "a16_compare_runs": f"""WITH {_GAPS} SELECT concat('m', id % 3) AS model, count(*) AS candidates, count(*) FILTER (WHERE diff = 0) AS exact,
  CAST(sum(abs(diff)) AS BIGINT) AS gaps, CAST(sum(id % 100) AS BIGINT) AS seconds FROM gd WHERE cases IS NOT NULL GROUP BY 1""",
    "p9_first_pages": f"""WITH {PAGES}, m AS (SELECT *, max(page) OVER (PARTITION BY doc) AS n FROM pg), w AS (SELECT doc, string_agg(text, chr(10) ORDER BY page) AS t FROM m WHERE page <= 2 OR page = n GROUP BY doc)
SELECT doc, CAST(length(t) AS INTEGER) AS chars, md5(t) AS md5 FROM w""",
    "p10_text_layer": f"WITH {PAGES} SELECT doc, bool_or(page <= 5 AND length(trim(text)) > 0) AS has_text, count(*) FILTER (WHERE length(trim(text)) < 50) AS sparse_pages FROM pg GROUP BY doc",
    "a18_doc_method": f"WITH {PAGES} SELECT doc, CASE WHEN min(method) = max(method) THEN min(method) ELSE 'mixed' END AS extraction_method FROM pg GROUP BY doc",
    "w5_ranked_votes": f"WITH {VOTES} SELECT contest, pos, row_number() OVER (PARTITION BY contest ORDER BY votes DESC NULLS LAST, pos) AS rank FROM votes_",
    "j7_electors": f"WITH {_ELECTORS} SELECT contest, polled, electors, electors_source, turnout FROM el",
    "a8_elector_sources": f"WITH {_ELECTORS} SELECT electors_source AS source, count(*) AS rows FROM el GROUP BY 1",
    "j8_cross_validation": f"""WITH {_NOW}, w AS (SELECT contest, polled - contest % 130 + 20 AS votes, polled, nota_votes FROM now_),
d AS (SELECT *, abs(votes - polled) AS a, abs(votes - (polled - nota_votes)) AS b FROM w)
SELECT contest, votes, polled, nota_votes, a <= 50 OR b <= 50 AS valid, CASE WHEN a <= 50 THEN 'matches' WHEN b <= 50 THEN 'matches without NOTA' ELSE concat('differs by ', least(a, b)) END AS note FROM d""",
}
