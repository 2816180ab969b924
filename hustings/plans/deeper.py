"""Queries over operators that hold where a key or a name is everywhere: ratios, discovery, places, refreshes, late clicks."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.functions import articles as A
from hustings.functions.numbers import case_count
from hustings.operators import linkage, news, order
from hustings.plans.contests import ORACLES as CONTESTS
from hustings.plans.feeds import ARTICLES, articles
from hustings.plans.intake import ORACLES as INTAKE
from hustings.plans.intake import _clicks, _drain
from hustings.plans.messy import ORACLES as MESSY
from hustings.plans.messy import _HON, _SQUEEZE, FAMILY, FOLK, GIVEN, _at, _nth, _pick, folk
from hustings.plans.people import LEAD, PEOPLE, people
from hustings.sources import files
from hustings.streaming import live


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def j1_untidy_names(spark, sf_dir):
    """People against records of suppliers: names of the same parts, in other order, shortened or misspelt."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    k = F.col("c_custkey")
    given, family = _pick(GIVEN, "c_custkey", 2), _pick(FAMILY, "c_custkey", 3)
    name = F.when(k % 4 == 0, F.concat(family, F.lit(" "), given)).when(k % 4 == 1, F.concat(given, F.lit("h "), family)).when(k % 4 == 2, F.concat(F.lit("Dr. "), F.substring(given, 1, 3), F.lit(" "), family)).otherwise(F.concat(F.upper(given), F.lit(" "), family))
    truth = s.select(k.alias("pos"), name.alias("name"), F.when(k % 3 == 0, "NORTH").when(k % 3 == 1, "vale (ST)").otherwise("").alias("constituency"), (k % 5).alias("cases"))
    return linkage.match_ground_truth(folk(spark, sf_dir).select("id", "name", "constituency"), truth)


def j5_untidy_winners(spark, sf_dir):
    p = folk(spark, sf_dir)
    i = F.col("id")
    other = F.concat(_pick(GIVEN, "id", 3), F.lit(" K.R. "), F.upper(_pick(FAMILY, "id")))
    before = p.select(
        i.alias("contest"), F.when(i % 3 == 0, F.upper("name")).when(i % 3 == 1, F.concat(F.lit("MR.  "), "name")).otherwise(other).alias("winner_name"), F.col("party").alias("winner_party"), (i * 7).alias("winner_votes"), (i % 90).alias("margin"),
        other.alias("runner_up_name"), F.lit("Telugu Desam").alias("runner_up_party"), (i * 5).alias("runner_up_votes"),
    )
    return linkage.attach_previous(p.select(i.alias("contest"), "name"), before.where("contest % 11 <> 0"), 2019)


def _read(spark, sf_dir):
    """Documents as articles, and people named by four words of each, common and rare ones."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("title"), F.col("source").alias("snippet"))
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9_]+"), lambda w: (F.length(w) >= 4) & ~F.contains(w, F.lit("_")))
    # Exploded from one list, so that the filter doesn't work the words out once more.
    own = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(words)).alias("w")).where("size(w) > 1")
    at = lambda k: F.get("w", F.floor((F.size("w") - 1) * k / 3).cast("int"))
    who = own.select(F.col("doc_id").alias("candidate_id"), F.concat(F.lit("Dr "), F.concat_ws(" ", *(at(k) for k in range(4))), F.lit(" S/O Theirs")).alias("name"))
    return docs, who


def j21_discovered(spark, sf_dir):
    return news.discover_full_names(*_read(spark, sf_dir)).select("item_id", "candidate_id", F.col("words").alias("n_words"))


def j21_named_words(spark, sf_dir):
    return news.named_words(*_read(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("n_items"))


def w8_places(spark, sf_dir):
    p = people(spark, sf_dir).select("id", case_count("criminal_cases").alias("n"))
    return order.placed(p, F.desc("n"), F.asc("id")).select("id", F.col("place").cast("long").alias("place"))


def w10_listing_page(spark, sf_dir):
    p = people(spark, sf_dir).select("id", case_count("criminal_cases").alias("n"))
    return order.page_of(p, 30, 20, F.desc("n"), F.asc("id")).select("id", F.col("place").cast("long").alias("place"))


def m1_refreshed_store(spark, sf_dir):
    a = articles(spark, sf_dir).select("candidate_id", "pos", "url")
    path = files.scratch(spark)
    news.write_news(a.where("pos % 2 = 0"), path)
    news.refresh_news(a.where("pos % 2 = 1 and candidate_id % 50 = 0"), a.where("candidate_id % 50 = 0 or candidate_id % 70 = 1").select("candidate_id"), path)
    return news.read_news(spark, path).select("candidate_id", "pos")


def r3_late_counts(spark, sf_dir):
    """Clicks in three files, the newest first, read one by one."""
    path = files.scratch(spark)
    clicks = _clicks(spark, sf_dir)
    for k in (2, 0, 1):
        clicks.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(clicks.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    counts = live.live_counts(live.live_deltas(stream, "100 days"))
    _drain(counts, "complete", path, spark, True, lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out"))
    return spark.read.parquet(f"{path}/out")


LINKS = (
    "HTTP://News.Example:80/a%20b?b=2&a=1&utm_source=x#top", "https://n.example?q=a+b&q=&ref=1&x=%C3%A9%7e*", "//host.example/p?z", "mailto:A@b.example?subject=Hi%2", "n.example/x?gclid=3&&y=%zz&FBCLID=1", "http://[::1/x", "",
    "ftp:/no/host?utm_a=1", "https://H.example/é?n=ñ&m=%26+%3D", "javascript:void(0)#x", "http:///only/path?b&a", "https://u.example/?mc_x=1",
)


def n15_odd_links(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.concat(_pick(LINKS, "event_id"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("&k="), F.col("user_id").cast("string"))).otherwise("")).alias("url"))
    return e.select("event_id", A.canonical_url("url").alias("canonical"))


QUERIES = {f.__name__: f for f in (j1_untidy_names, j5_untidy_winners, j21_discovered, j21_named_words, w8_places, w10_listing_page, m1_refreshed_store, r3_late_counts, n15_odd_links)}


def _ratios(pairs: str) -> str:
    """CTEs that give ``ratio`` (a, b, r) of the distinct pairs (a, b): longest common blocks, then left and right of them."""
    return f"""pr AS (SELECT a, b, row_number() OVER () AS k FROM (SELECT DISTINCT a, b FROM {pairs})),
ia AS (SELECT k, unnest(range(1, length(a) + 1)) AS i, a, b FROM pr), ij AS (SELECT k, i, unnest(range(1, length(b) + 1)) AS j, a, b FROM ia),
eq AS (SELECT k, i, j FROM ij WHERE a[i] = b[j]), di AS (SELECT *, i - row_number() OVER (PARTITION BY k, i - j ORDER BY i) AS g FROM eq),
cell AS (SELECT k, i, j, max(i) OVER (PARTITION BY k, i - j, g) - i + 1 AS len FROM di),
seg AS (SELECT k, 1::BIGINT AS al, length(a) + 1::BIGINT AS ah, 1::BIGINT AS bl, length(b) + 1::BIGINT AS bh, 0::BIGINT AS n FROM pr UNION ALL
  SELECT k, CASE side WHEN 0 THEN al ELSE m.n - m.i END, CASE side WHEN 0 THEN -m.i ELSE ah END, CASE side WHEN 0 THEN bl ELSE m.n - m.j END, CASE side WHEN 0 THEN -m.j ELSE bh END, CASE side WHEN 0 THEN m.n ELSE 0 END
  FROM (SELECT s.k, s.al, s.ah, s.bl, s.bh, max({{'n': least(len, ah - i, bh - j), 'i': -i, 'j': -j}}) AS m FROM seg s JOIN cell c ON c.k = s.k AND i >= al AND i < ah AND j >= bl AND j < bh GROUP BY ALL), (SELECT unnest([0, 1]) AS side)),
ratio AS (SELECT a, b, 2.0::DOUBLE * sum(n) / (length(a) + length(b)) AS r FROM pr JOIN seg USING (k) GROUP BY a, b)"""


def _plain(c: str) -> str:
    return f"lower({_SQUEEZE.format(rf"replace(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '\s*\([^)]*\)\s*', ' ', 'g'), '\s*@\s*.*$', ''), '(?i)\b({_HON})\.?\s+', '', 'g'), '.', ' ')")})"


def _seat(c: str) -> str:
    return f"upper({_SQUEEZE.format(rf"regexp_replace(coalesce({c}, ''), '\s*\([^)]*\)\s*', ' ', 'g')")})"


def _matched(people_: str, truth: str) -> str:
    """People (id, name, constituency) and truth (pos, truth_name, truth_seat, cases)."""
    return rf"""WITH RECURSIVE {people_}, {truth},
l AS (SELECT id, {_plain('name')} AS a, {_seat('constituency')} AS s FROM cand), r AS (SELECT *, {_plain('truth_name')} AS b, {_seat('truth_seat')} AS t FROM truth),
st AS (SELECT s, t FROM (SELECT DISTINCT s FROM l WHERE s <> ''), (SELECT DISTINCT t FROM r) WHERE contains(s, t) OR contains(t, s)),
bl AS (SELECT id, a, b, pos, truth_name, cases FROM l JOIN st USING (s) JOIN r USING (t)), {_ratios('bl')},
sc AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r DESC, pos) AS nth FROM bl JOIN ratio USING (a, b) WHERE r > 0.7)
SELECT c.id, c.name, c.constituency, pos, truth_name, cases, round(r, 3) AS score FROM cand c LEFT JOIN sc ON sc.id = c.id AND nth = 1"""


def _titled(c: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all(trim({c}), '\s+|\S+'), lambda w : CASE WHEN regexp_matches(w, '\p{{Ll}}') THEN w WHEN contains(w, '.') AND length(w) <= 4 THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), '')"


def _words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower(regexp_replace(regexp_replace({c}, '(?i)\s+[S|D|W]/O\s+.*$', ''), '\(.*?\)|@.*$', '', 'g')), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda w : w <> '')"


_SHORT = "CASE {0} WHEN 'Telugu Desam' THEN 'TDP' WHEN 'Bharatiya Janata Party' THEN 'BJP' WHEN 'Independent' THEN 'IND' ELSE {0} END"
_NAMED = r"""it AS (SELECT doc_id AS item_id, regexp_split_to_array(lower(concat_ws(' ', text, source)), '[^a-z0-9_]+') AS held FROM documents),
ow AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda w : regexp_full_match(w, '[a-z0-9]{4,}')) AS w FROM documents),
wh AS (SELECT doc_id AS candidate_id, list_distinct([w[1 + (len(w) - 1) * 0 // 3], w[1 + (len(w) - 1) * 1 // 3], w[1 + (len(w) - 1) * 2 // 3], w[1 + (len(w) - 1) * 3 // 3]]) AS words FROM ow WHERE len(w) > 1),
wo AS (SELECT DISTINCT unnest(words) AS word FROM wh), iw AS (SELECT DISTINCT item_id, unnest(held) AS word FROM it)"""


_SLASHED = "(" + ", ".join(f"'{x}'" for x in A.SLASHED) + ")"
_PAIRS = """list_sort(list_filter(list_transform(list_filter(string_split(q[2:], '&'), lambda p : p <> ''), lambda p : CASE WHEN instr(p, '=') > 0
  THEN [url_decode(replace(split_part(p, '=', 1), '+', ' ')), url_decode(replace(p[instr(p, '=') + 1:], '+', ' '))] ELSE [url_decode(replace(p, '+', ' ')), ''] END), lambda x : NOT regexp_matches(x[1], '(?i)^(utm_|mc_|(gclid|fbclid|ref|src)$)')))"""


#: 32-bit products of UTF-16 units as remainders of exact ones.
_UNITS = "flatten(list_transform(string_split(raw, ''), lambda c : CASE WHEN unicode(c) < 65536 THEN [unicode(c)] ELSE [55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)] END))"
_HASH = f"""list_reduce(list_prepend({{'a': 3735928559::BIGINT, 'b': 1103547991::BIGINT, 'x': 0::BIGINT}}, list_transform({_UNITS}, lambda v : {{'a': 0::BIGINT, 'b': 0::BIGINT, 'x': v::BIGINT}})),
  lambda s, v : {{'a': (xor(s.a, v.x)::HUGEINT * 2654435761 % 4294967296)::BIGINT, 'b': (xor(s.b, v.x)::HUGEINT * 1597334677 % 4294967296)::BIGINT, 'x': 0::BIGINT}})"""
_FOLD = "xor((xor({a}, {a} >> 16)::HUGEINT * 2246822507 % 4294967296)::BIGINT, (xor({b}, {b} >> 13)::HUGEINT * 3266489909 % 4294967296)::BIGINT)"

ORACLES = {
    "j1_untidy_names": _matched(
        f"{FOLK}, cand AS (SELECT id, name, constituency FROM folk)",
        f"""truth AS (SELECT c_custkey AS pos, CASE c_custkey % 4 WHEN 0 THEN fa || ' ' || gi WHEN 1 THEN gi || 'h ' || fa WHEN 2 THEN 'Dr. ' || gi[1:3] || ' ' || fa ELSE upper(gi) || ' ' || fa END AS truth_name,
  CASE c_custkey % 3 WHEN 0 THEN 'NORTH' WHEN 1 THEN 'vale (ST)' ELSE '' END AS truth_seat, c_custkey % 5 AS cases FROM (SELECT s_suppkey AS c_custkey, {_nth(GIVEN, 2).replace('c_custkey', 's_suppkey')} AS gi, {_nth(FAMILY, 3).replace('c_custkey', 's_suppkey')} AS fa FROM supplier))""",
    ),
    "j1_ground_truth": _matched(
        f"{PEOPLE}, cand AS (SELECT id, name, constituency FROM people)",
        "truth AS (SELECT s_suppkey AS pos, replace(s_name, 'Supplier#', 'Customer ') AS truth_name, n_name AS truth_seat, s_suppkey % 5 AS cases FROM supplier JOIN nation ON n_nationkey = s_nationkey)",
    ),
    "j5_untidy_winners": f"""WITH {FOLK}, o AS (SELECT *, {_at(GIVEN, f'((id // 3) % {len(GIVEN)})')} || ' K.R. ' || upper({_at(FAMILY, f'(id % {len(FAMILY)})')}) AS other FROM folk),
b AS (SELECT id AS contest, CASE id % 3 WHEN 0 THEN upper(name) WHEN 1 THEN 'MR.  ' || name ELSE other END AS raw, other, party, id * 7 AS votes, id % 90 AS margin, id * 5 AS less FROM o WHERE id % 11 <> 0)
SELECT f.id AS contest, f.name, margin AS former_margin, CASE WHEN contest IS NOT NULL THEN 2019 END AS former_year, {_titled('raw')} AS former_name, {_SHORT.format('b.party')} AS former_party, votes AS former_votes,
  {_titled('other')} AS former_runner_up_name, CASE WHEN contest IS NOT NULL THEN 'TDP' END AS former_runner_up_party, less AS former_runner_up_votes,
  coalesce(len(list_intersect({_words('f.name')}, {_words('raw')})) >= 2, false) AS reelected FROM folk f LEFT JOIN b ON contest = f.id""",
    "j21_discovered": f"WITH {_NAMED}, ha AS (SELECT candidate_id, len(words) AS n_words, unnest(words) AS word FROM wh) SELECT item_id, candidate_id, CAST(n_words AS INTEGER) AS n_words FROM ha JOIN iw USING (word) GROUP BY ALL HAVING count(*) = n_words",
    "j21_named_words": f"WITH {_NAMED} SELECT word, count(*) AS n_items FROM iw JOIN wo USING (word) GROUP BY word",
    "w8_places": f"WITH {PEOPLE} SELECT id, row_number() OVER (ORDER BY {LEAD} DESC, id) AS place FROM people",
    "w10_listing_page": f"WITH {PEOPLE}, p AS (SELECT id, row_number() OVER (ORDER BY {LEAD} DESC, id) AS place FROM people) SELECT * FROM p WHERE place BETWEEN 581 AND 600",
    "m1_refreshed_store": f"WITH {ARTICLES} SELECT candidate_id, pos FROM art WHERE (pos % 2 = 0 AND candidate_id % 50 <> 0 AND candidate_id % 70 <> 1) OR (pos % 2 = 1 AND candidate_id % 50 = 0)",
    "r3_late_counts": INTAKE["r3_live_counts"],
    "n15_odd_links": rf"""WITH u AS (SELECT event_id, {_at(LINKS, f'(event_id % {len(LINKS)})')} || CASE WHEN event_id % 5 = 0 THEN '&k=' || user_id ELSE '' END AS url FROM events),
p AS (SELECT *, '^(([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?' AS re FROM u),
x AS (SELECT event_id, url, lower(regexp_extract(url, re, 2)) AS scheme, lower(regexp_extract(url, re, 3)) AS host, regexp_extract(url, re, 4) AS path, regexp_extract(url, re, 5) AS q FROM p),
y AS (SELECT *, array_to_string(list_transform({_PAIRS}, lambda x : replace(url_encode(x[1]), '%20', '+') || '=' || replace(url_encode(x[2]), '%20', '+')), '&') AS query FROM x)
SELECT event_id, CASE WHEN contains(host, '[') <> contains(host, ']') THEN url ELSE CASE WHEN scheme <> '' THEN scheme || ':' ELSE '' END
  || CASE WHEN length(host) > 2 THEN host WHEN starts_with(path, '//') THEN '//' WHEN (path = '' OR starts_with(path, '/')) AND scheme IN {_SLASHED} THEN '//' ELSE '' END || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM y""",
    "n15_canonical_links": rf"""WITH x AS ({MESSY['n15_link_keys']}),
u AS (SELECT page_id, url AS raw FROM pages),
h AS (SELECT page_id, raw, {_HASH} AS h FROM u), f AS (SELECT page_id, raw, {_FOLD.format(a='h.a', b='h.b')} AS a, h.b AS b FROM h), g AS (SELECT page_id, raw, a, {_FOLD.format(a='b', b='a')} AS b FROM f)
SELECT page_id, canonical, CASE WHEN raw <> '' THEN 'nr_' || lower(to_hex(CAST((b & 2097151) * 4294967296 + a AS BIGINT))) END AS article, sha1(canonical || '|atitle') AS key FROM g JOIN x USING (page_id)""",
    "j5_previous": f"""WITH n AS ({CONTESTS['a1_contest_results']}), w AS (SELECT *, regexp_split_to_array(lower('Mr ' || winner_name || ' X'), ' ') AS ws FROM n)
SELECT n.contest, 'Mr ' || n.winner_name || ' X' AS name, b.margin AS former_margin, CASE WHEN b.contest IS NOT NULL THEN 2019 END AS former_year, {_titled('b.winner_name')} AS former_name, {_SHORT.format('b.winner_party')} AS former_party,
  b.winner_votes AS former_votes, coalesce(len(list_intersect(n.ws, [lower(b.winner_name)])) >= 2, false) AS reelected FROM w n LEFT JOIN w b ON b.contest + 1 = n.contest""",
}
