"""Operators that have to hold where one key is everywhere, against sequential code."""

import datetime as dt
import os
import random
import time
import urllib.parse
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hustings.functions import articles as A
from hustings.operators import engagement, linkage, news, order
from hustings.operators.ratios import best_ratios
from hustings.sources import html
from hustings.streaming import live

BASE = dt.datetime(2024, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- throttle


def _throttled(rows, seconds):
    last, out = {}, {}
    for uid, event, ts in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        out[event] = uid not in last or (ts - last[uid]).total_seconds() > seconds
        if out[event]:
            last[uid] = ts
    return out | {r[1]: False for r in rows if r[2] is None}


@pytest.mark.parametrize("spread", [3, 60, 4000])
def test_throttle_over_many_ranges(spark, spread):
    """Ranges that a user crosses, that are all within one pause, and users of one event."""
    rng = random.Random(spread)
    rows = [("hot", i, BASE + dt.timedelta(seconds=rng.randrange(spread))) for i in range(900)]
    rows += [(rng.choice(["a", "b", None, "zz"]), 1000 + i, BASE + dt.timedelta(seconds=rng.randrange(300))) for i in range(200)]
    rows += [(f"u{i}", 2000 + i, BASE) for i in range(50)] + [("hot", 3000, None), (None, 3001, None)]
    df = spark.createDataFrame(rows, "uid string, event_id long, ts timestamp")
    got = engagement.throttle(df, 10)
    assert {r.event_id: r.accepted for r in got.collect()} == _throttled(rows, 10) and got.columns == ["uid", "event_id", "ts", "accepted"]
    assert engagement.throttle(df.where("false"), 10).count() == 0


def test_throttle_of_one_user_with_ten_million_events(spark):
    n, gap = 10_000_000, 10
    events = spark.range(n).select(F.lit("u").alias("uid"), F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 700_000 + F.pmod(F.xxhash64("id"), F.lit(600_000))).alias("ts"))
    got = engagement.throttle(events, gap)
    assert "Window" not in _plan(got)
    accepted = np.sort(got.where("accepted").select(F.unix_micros("ts").alias("t")).toArrow()["t"].to_numpy())
    times = np.sort(events.select(F.unix_micros("ts").alias("t")).toArrow()["t"].to_numpy())
    want, at = [], 0
    while at < n:
        want.append(times[at])
        at = np.searchsorted(times, times[at] + gap * 1_000_000, "right")
    assert np.array_equal(accepted, np.array(want))


def test_ends_follow_pointers():
    rng = np.random.default_rng(1)
    for _ in range(200):
        times = np.sort(rng.integers(0, 60, rng.integers(1, 40)))
        starts, ends = engagement._ends(times, 10)
        for before in range(-15, int(times[0]) + 1):
            found = next((e for s, e in zip(starts, ends, strict=True) if s > before + 10), before)
            assert found == engagement._accept(times, before, 10)[1]


# ---- streams


def test_late_clicks_in_later_batches(spark, tmp_path):
    """Clicks in three batches, out of order, count as in order; state older than the watermark is settled."""
    rng = random.Random(6)
    kinds = engagement.REACTIONS
    rows = [(i, f"u{rng.randrange(4)}", f"i{rng.randrange(2)}", rng.choice(kinds), BASE + dt.timedelta(seconds=rng.randrange(3000))) for i in range(300)]
    later = [(1000 + i, f"u{i % 4}", f"i{i % 2}", kinds[i % 3], BASE + dt.timedelta(days=3, seconds=i)) for i in range(12)]
    schema = "event_id long, uid string, item_id string, reaction string, ts timestamp"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, part in enumerate([rows[200:], rows[:100], rows[100:200], later]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
            q = live.live_counts(live.live_deltas(stream)).writeStream.outputMode("complete").format("memory").queryName(f"late{k}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            seen = [rows[200:], rows[200:] + rows[:100], rows, rows + later][k]
            want = engagement.counter_sums(engagement.reaction_deltas(spark.createDataFrame(seen, schema)))
            got = {r.item_id: [r[c] for c in kinds] for r in spark.table(f"late{k}").collect()}
            assert got == {r.item_id: [r[c] for c in kinds] for r in want.collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


# ---- containment and names


def test_keys_that_begin_alike_meet_few_others(spark):
    left = spark.range(20_000).select(F.format_string("cus%06d", "id").alias("t"))
    right = spark.range(20_000).select(F.format_string("file_cus%06d_x", F.col("id") * 3).alias("t"))
    began = time.time()
    pairs = linkage.containing(right, left)
    assert pairs.count() == 6667 and time.time() - began < 60
    # Partners that are looked at: those of the stretch that each key is looked up by.
    joined = linkage.containing(right.withColumn("t", F.concat("t", F.lit(""))), left.where("t < 'cus000200'"))
    assert joined.count() == 67


def test_containment_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(0, 12)))
    left, right = [(i, word()) for i in range(120)] + [(500, None), (501, "")], [(i, word()) for i in range(150)] + [(600, None), (601, "")]
    got = linkage.containment_pairs(spark.createDataFrame(left, "a int, l string"), "l", spark.createDataFrame(right, "b int, r string"), "r").collect()
    want = [(a, b) for a, x in left for b, y in right if x is not None and y is not None and (x in y or y in x)]
    assert sorted((r.a, r.b) for r in got) == sorted(want)


def test_bound_is_above_every_ratio(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("abcé 1-") for _ in range(rng.randrange(0, 14))), "".join(rng.choice("abcé 1-") for _ in range(rng.randrange(0, 14)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", linkage.ratio_bound(linkage.letter_counts(F.col("a")), linkage.letter_counts(F.col("b"))).alias("bound"))
    for r in df.collect():
        assert r.bound is None if not (r.a or r.b) else r.bound >= SequenceMatcher(None, r.a, r.b).ratio() - 1e-12


def test_ground_truth_against_all_pairs(spark):
    rng = random.Random(12)
    name = lambda: " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 6))) for _ in range(2))
    cands, truth = [(i, name(), "N") for i in range(150)], [(i, name(), "N", i) for i in range(150)]
    got = linkage.match_ground_truth(spark.createDataFrame(cands, "id long, name string, constituency string"), spark.createDataFrame(truth, "pos long, name string, constituency string, cases long"), 0.6)
    for r in got.collect():
        scored = [(-SequenceMatcher(None, r.name, t[1]).ratio(), t[0]) for t in truth]
        best = min(s for s in scored if s[0] < -0.6) if any(s[0] < -0.6 for s in scored) else None
        assert (r.pos, r.score) == ((best[1], round(-best[0], 3)) if best else (None, None))


@pytest.mark.parametrize("most", [12, 80, 300])
def test_best_ratios_against_all_pairs(most):
    """Short names, names longer than a word of bits, and names long enough for difflib to leave frequent letters out."""
    rng = random.Random(most)
    word = lambda: "".join(rng.choice("abcd é") for _ in range(rng.randrange(1, most)))
    first, second = [word() for _ in range(60)] + ["zz"], sorted({word() for _ in range(40)}, key=lambda w: (len(w) % 3, w))
    for head in ("", "mr "):  # also where all begin alike
        a, b = [head + w for w in first], [head + w for w in second]
        at, top = best_ratios(a, b, 0.5)
        for k, name in enumerate(a):
            best = max((SequenceMatcher(None, name, w).ratio(), -n) for n, w in enumerate(b))
            assert (top[k], at[k]) == ((best[0], -best[1]) if best[0] > 0.5 else (0.5, -1))


def test_ground_truth_of_one_large_seat(spark):
    """All pairs would be 120 million rows; names that repeat are searched for once."""
    cands = spark.range(40_000).select("id", F.format_string("Customer %09d", F.col("id") % 30_000 * 7).alias("name"), F.lit("N").alias("constituency"))
    truth = spark.range(4000).select(F.col("id").alias("pos"), F.format_string("Customer %09d", F.col("id") % 3999 * 5).alias("name"), F.lit("N (SC)").alias("constituency"), (F.col("id") % 5).alias("cases"))
    began = time.time()
    got = {r.id: r for r in linkage.match_ground_truth(cands, truth).collect()}
    assert time.time() - began < 60 and len(got) == 40_000
    names = [f"customer {k * 5:09d}" for k in range(3999)]
    for i in (0, 5, 17, 29_999, 30_005, 39_999):
        best = max((SequenceMatcher(None, f"customer {i % 30_000 * 7:09d}", w).ratio(), -n) for n, w in enumerate(names))
        assert (got[i].pos, got[i].score, got[i].cases) == (-best[1], round(best[0], 3), -best[1] % 5)


def test_ground_truth_searches_for_a_name_once_for_all_seats(spark):
    """2000 names of 60 seats against the 2000 records that every seat meets."""
    word = lambda k: F.concat(F.conv(k * 7919 + 46656, 10, 36), F.lit(" verran"))
    cands = spark.range(120_000).select("id", F.lower(word(F.col("id") % 2000)).alias("name"), F.concat(F.lit("S"), (F.col("id") % 60).cast("string"), F.lit("X")).alias("constituency"))
    truth = spark.range(2000).select(F.col("id").alias("pos"), F.lower(word(F.col("id") % 1990 + 3)).alias("name"), F.lit("").alias("constituency"), F.lit(1).alias("cases"))
    began = time.time()
    got = {r.id: r for r in linkage.match_ground_truth(cands, truth).collect()}
    assert time.time() - began < 60 and len(got) == 120_000
    records = [r.name for r in truth.orderBy("pos").collect()]
    for i in (0, 3, 1999, 60_007, 119_999):
        best = max((SequenceMatcher(None, got[i].name, w).ratio(), -n) for n, w in enumerate(records))
        assert (got[i].pos, got[i].score) == (-best[1], round(best[0], 3))


def _given(target, row):
    """The rule for one name and one row, word by word."""
    free, hits = sorted(row), 0
    for w in sorted(target, key=lambda w: (-len(w), w)):
        near = w if w in row else next((r for r in free if (len(r) == 1 and w.startswith(r)) or (len(w) == 1 and r.startswith(w))), None)
        hits += near is not None
        free = [r for r in free if r != near]
    return (hits / len(target) * 100, sum(len(r) > 3 and r not in linkage.FILING_WORDS for r in free)) if target and row else (0.0, 0)


def test_token_score_and_filings_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["asha", "a", "verran", "v", "k", "kumar", "rao", "r", "party", "bel", "b", "longer"]
    some = lambda: [rng.choice(words) for _ in range(rng.randrange(0, 5))]
    rows = [(sorted(set(some())), sorted(set(some()))) for _ in range(500)]
    df = spark.createDataFrame(rows, "t array<string>, r array<string>")
    for r in df.select("t", "r", linkage.token_score(F.col("t"), F.col("r")).alias("s")).collect():
        assert (r.s.score, r.s.left) == _given(r.t, r.r)
    listed = [(f"S{i % 3}", i, " ".join(some()), None, "accepted") for i in range(200)]
    cands = [(i, " ".join(some()), " ".join(some()) if i % 4 == 0 else None, f"S{i % 3}", "TDP") for i in range(200)]
    got = linkage.link_filings(spark.createDataFrame(listed, "seat string, pos int, name_line string, party_line string, status string"), spark.createDataFrame(cands, "id int, name string, alias string, seat string, party string"))
    want = {}
    for i, name, alias, seat, _ in cands:
        fits = [(pos, -s) for s_, pos, line, _, _ in listed if s_ == seat for who in (name, alias) if who is not None for s, left in [_given(sorted(set(who.split())), sorted(set(line.split())))] if s >= 50 and left == 0]
        if fits:
            want[i] = min(fits)
    assert {r.id: (r.pos, -r.score) for r in got.collect()} == want and want


# ---- links


def _reference_link(url):
    try:
        parts = urllib.parse.urlsplit(url)
    except ValueError:
        return url
    track = lambda k: k.lower().startswith(("utm_", "mc_")) or k.lower() in ("gclid", "fbclid", "ref", "src")
    pairs = sorted(p for p in urllib.parse.parse_qsl(parts.query, keep_blank_values=True) if not track(p[0]))
    return urllib.parse.urlunsplit((parts.scheme.lower(), parts.netloc.lower(), parts.path, urllib.parse.urlencode(pairs), ""))


def _hash(text):
    units = np.frombuffer(text.encode("utf-16-le"), np.uint16)
    a, b, m = 0xDEADBEEF, 0x41C6CE57, 1 << 32
    for u in map(int, units):
        a, b = (a ^ u) * 2654435761 % m, (b ^ u) * 1597334677 % m
    fold = lambda x, y: (x ^ x >> 16) * 2246822507 % m ^ (y ^ y >> 13) * 3266489909 % m
    a = fold(a, b)
    b = fold(b, a)
    return f"nr_{(b & 2097151) << 32 | a:x}"


PIECES = st.sampled_from(["http", "HTTPS", "ftp", "x+y", ":", "//", "/", "n.Example", "H:80", "?", "&", "&&", "=", "#", "a", "b b", "+", "%20", "%2", "%zz", "%C3%A9", "%c3", "é", "日", "😀", "utm_x", "ref", "REF=1", "~*-._", "1", "%26", "%3D", "@", "[", "]", "\t", " ", ";"])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=150, max_size=150))
def test_links_against_the_standard_library(spark, urls):
    urls = [u for u in urls if "[" not in u or "]" not in u]  # what stands in brackets is looked at there, not here
    df = spark.createDataFrame([(u,) for u in [*urls, None, ""]], "u string").select("u", A.canonical_url("u").alias("c"), A.article_id("u").alias("h"))
    for r in df.collect():
        assert r.c == (None if r.u is None else _reference_link(r.u)), r.u
        assert r.h == (_hash(r.u) if r.u else None)


def test_link_functions_stay_in_the_engine(spark):
    df = spark.range(3).select(F.concat(F.lit("http://n.example/?b=1&a="), "id").alias("u"))
    plan = _plan(df.select(A.canonical_url("u"), A.article_id("u")))
    assert "Python" not in plan and "Arrow" not in plan


# ---- stores, places, tables


def test_refresh_keeps_files_of_other_candidates(spark, tmp_path):
    path = str(tmp_path / "news")
    old = spark.range(400).select((F.col("id") % 50).alias("candidate_id"), F.col("id").alias("pos"), F.lit("u").alias("url"))
    news.write_news(old, path, 8)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}
    before = files()
    fresh = spark.createDataFrame([(3, 9000, "new"), (3, 9001, "new"), (77, 9002, "not fetched")], "candidate_id long, pos long, url string")
    news.refresh_news(fresh, spark.createDataFrame([(3,), (4,), (999,)], "candidate_id long"), path, 8)
    after = files()
    kept = {f for f in before if after.get(f) == before[f]}
    assert len({os.path.dirname(f) for f in kept}) >= 5 and len(kept) < len(before)
    got = Counter((r.candidate_id, r.pos) for r in news.read_news(spark, path).collect())
    assert got == Counter([(i % 50, i) for i in range(400) if i % 50 not in (3, 4)] + [(3, 9000), (3, 9001)])
    # A candidate whose folder has no other one may end up with nothing.
    news.refresh_news(fresh.where("false"), old.select("candidate_id").distinct(), path, 8)
    assert news.read_news(spark, path).count() == 0


def test_places_and_far_pages(spark):
    rows = spark.range(30_000).select("id", (F.col("id") % 3).alias("n"), F.lit(1).alias("place0"))
    placed = {r.id: r.place for r in order.placed(rows, F.desc("n"), F.asc("id")).collect()}
    want = sorted(range(30_000), key=lambda i: (-(i % 3), i))
    assert placed == {i: k + 1 for k, i in enumerate(want)}
    page = order.page_of(rows, 1200, 20, F.desc("n"), F.asc("id"))
    assert sorted((r.place, r.id) for r in page.collect()) == [(k + 1, want[k]) for k in range(1199 * 20, 1200 * 20)]
    assert "SinglePartition" not in _plan(page).split("BroadcastExchange")[0]
    assert order.placed(rows.where("false"), F.asc("id")).count() == 0 and order.page_of(rows, 9999, 20, F.asc("id")).count() == 0


def test_filings_of_names_that_many_bear(spark):
    """60,000 candidates of 40 names against 2000 rows of their seat, which all fit by half a name: 120 million pairs."""
    cands = spark.range(60_000).select("id", F.format_string("g%d Verran", F.col("id") % 40).alias("name"), F.lit(None).cast("string").alias("alias"), F.lit("N").alias("seat"), F.when(F.col("id") % 3 != 0, "TDP").alias("party"))
    rows = spark.range(2000).select(F.lit("N").alias("seat"), F.col("id").alias("pos"), F.format_string("g%d Verran", F.col("id") % 39 + 1).alias("name_line"), F.when(F.col("id") < 5, "Some Front").otherwise(F.format_string("Telugu Desam %d", F.floor(F.col("id") / 40))).alias("party_line"), F.lit("accepted").alias("status"))
    began = time.time()
    got = {r.id: (r.seat, r.pos, r.score) for r in linkage.link_filings(rows, cands).collect()}
    assert time.time() - began < 60
    first = {True: lambda k: ("N", 0, 100.0 if k == 1 else 50.0), False: lambda k: ("N", 5, 100.0 if k == 6 else 50.0)}
    assert got == {i: first[i % 3 == 0](i % 40) for i in range(60_000)}


def test_tables_are_chosen_without_an_exchange(spark):
    page = "<table><tr><td>x</td></tr></table><table><caption>2024: (1,200)</caption><tr><th>Candidate</th><th>Total Votes</th></tr><tr><td>a</td><td>1</td></tr></table>"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<table><caption>2024 (7)</caption></table>")], "page_id long, html string")
    rows = html.html_table_rows(df, ["Candidate", "Total Votes"], 2)
    facts = html.labelled_table_facts(df, "^2024")
    assert "Exchange" not in _plan(rows) and "Exchange" not in _plan(facts)
    assert [(r.page_id, r.row, r.cells) for r in rows.collect()] == [(1, 1, ["a", "1"])]
    assert {r.page_id: (r.electors, r.votes) for r in facts.collect()} == {1: (1200, None), 4: (7, None)}


def test_names_are_found_by_their_rarest_word(spark):
    items = [(i, "common words stand here " + ("Verran" if i % 10 == 0 else ""), "Asha" if i % 20 == 0 else None) for i in range(100)] + [(500, None, None)]
    cands = [(1, "Asha Verran S/O Common Words"), (2, "Common Verran"), (3, "Common Nowhere"), (4, "ab c"), (5, None), (6, "Common Words")]
    i, c = spark.createDataFrame(items, "item_id long, title string, snippet string"), spark.createDataFrame(cands, "candidate_id long, name string")
    got = {(r.item_id, r.candidate_id) for r in news.discover_full_names(i, c).collect()}
    assert got == {(k, 1) for k in range(0, 100, 20)} | {(k, 2) for k in range(0, 100, 10)} | {(k, 6) for k in range(100)}
    assert (0, 3) in {(r.item_id, r.candidate_id) for r in news.discover(i, c).collect()}


def test_names_of_common_words_are_no_rows(spark):
    """Each article lacks one of four words that 20,000 articles and 5000 names share: 75 million pairs by any one word."""
    items = spark.range(20_000).select(F.col("id").alias("item_id"), F.array_join(F.array_remove(F.array(*map(F.lit, ("alpha", "beta", "gamma", "delta"))), F.get(F.array(*map(F.lit, ("alpha", "beta", "gamma", "delta"))), (F.col("id") % 4).cast("int"))), " ").alias("title"), F.when(F.col("id") == 7, "delta").alias("snippet"))
    cands = spark.range(5000).select(F.col("id").alias("candidate_id"), F.lit("Alpha Beta Gamma Delta").alias("name")).union(spark.createDataFrame([(6000, "Beta x Gamma")], "candidate_id long, name string"))
    began = time.time()
    got = news.discover_full_names(items, cands)
    assert got.where("candidate_id < 5000").groupBy("item_id", "words").count().collect() == [(7, 4, 5000)] and time.time() - began < 40
    assert got.where("candidate_id = 6000").count() == 10_000


def test_results_of_large_seats_are_no_pairs(spark):
    """20,000 contests and 20,000 candidates of one stem: 400 million pairs; each winner holds one name, or one name holds it."""
    cands = spark.range(20_000).select("id", F.format_string("Cand %06d x", F.col("id") * 3).alias("name"), F.lit("N (SC)").alias("constituency"))
    won = F.when(F.col("id") % 2 == 0, F.format_string("Hon Cand %06d X Y", F.col("id") * 3)).otherwise(F.format_string("%06d", F.col("id") * 3))
    results = spark.range(20_000).select(F.col("id").alias("contest"), F.lit("N").alias("seat"), won.alias("winner"))
    began = time.time()
    got = linkage.link_results(cands, results.union(spark.createDataFrame([(30_000, "N", ""), (30_001, "N", "Cand"), (30_002, "M", "x")], "contest long, seat string, winner string")))
    rows = {r.contest: (r.target, r.reason) for r in got.collect()}
    assert time.time() - began < 60
    assert rows == {i: (i, None) for i in range(20_000)} | {30_000: (None, "ambiguous"), 30_001: (None, "ambiguous"), 30_002: (None, "no candidate")}


def test_weak_links_of_a_common_word_are_no_pairs(spark):
    """20,000 candidates and 20,000 rows of one seat share a word: 400 million pairs."""
    cands = spark.range(20_000).select("id", F.format_string("g%d Verran", F.col("id")).alias("name"), F.lit("N").alias("seat"), F.when(F.col("id") % 5 != 0, "TDP").alias("party"))
    rows = spark.range(20_000).select(F.lit("N").alias("seat"), F.col("id").alias("pos"), F.format_string("h%d Verran", F.col("id")).alias("name_line"), F.when(F.col("id") >= 3, "of TDP").when(F.col("id") == 1, "none").alias("party_line"))
    began = time.time()
    assert {(r.id, r.seat, r.pos) for r in linkage.link_filings_weak(rows, cands).collect()} == {(i, "N", 3) for i in range(20_000) if i % 5}
    assert time.time() - began < 20


def test_leftovers_of_large_seats(spark):
    """J4 over 20,000 contests and 30,000 candidates of one stem, of whom each contest takes one."""
    cands = spark.range(30_000).select("id", F.format_string("Cand %06d x", F.col("id")).alias("name"), F.lit("N").alias("constituency"))
    results = spark.range(20_000).select(F.col("id").alias("contest"), F.lit("N (ST)").alias("seat"), F.format_string("Hon Cand %06d X", F.when(F.col("id") < 19_990, F.col("id")).otherwise(F.col("id") + 50_000)).alias("winner"))
    began = time.time()
    rows = {(r.side, r.key): r.reason for r in linkage.unmatched(linkage.link_results(cands, results), cands).collect()}
    assert time.time() - began < 60
    assert rows == {("contest", str(k)): "ambiguous" for k in range(19_990, 20_000)} | {("candidate", str(k)): "no contest" for k in range(19_990, 30_000)}
