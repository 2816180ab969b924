"""Operators against sequential or hand-made results."""

import datetime as dt
import random

from pyspark.sql import functions as F

from hustings.operators import audits, cases, contests, engagement, linkage, news, pages
from hustings.sources import files, html


def test_contests(spark):
    rows = [(1, 0, "a", "p", 50), (1, 1, "b", "q", 50), (1, 2, "NOTA", "", 3), (1, 3, "Total", "", 110), (2, 0, "a", "p", 5), (2, 1, "NOTA", "", 3)]
    got = {r.contest: r for r in contests.contest_results(spark.createDataFrame(rows, "contest int, pos int, name string, party string, votes long")).collect()}
    assert (got[1].winner_name, got[1].runner_up_name, got[1].margin, got[1].polled, got[1].nota_votes) == ("a", "b", 0, 110, 3)
    assert got[2].polled == 8 and got[2].problem == "fewer than 2 candidates"


def test_ground_truth_keeps_the_first_of_equals_and_needs_more_than_the_threshold(spark):
    cands = spark.createDataFrame([(1, "Dr. Asha Verran", "NORTHVALE (SC)"), (2, "Quill", ""), (3, "Asha Verran", "SOUTH")], "id int, name string, constituency string")
    truth = spark.createDataFrame([(0, "Asha Verran", "NORTH", 9), (1, "asha verran", "NORTHVALE", 4), (2, "Asha Verren", "NORTHVALE", 5)], "pos int, name string, constituency string, cases int")
    got = {r.id: r for r in linkage.match_ground_truth(cands, truth).collect()}
    assert (got[1].pos, got[1].cases, got[1].score) == (0, 9, 1.0)
    assert got[2].pos is None and got[3].pos is None


def test_link_results(spark):
    cands = spark.createDataFrame([(1, "Asha", "N (SC)"), (2, "Bel", "N"), (3, "Cor", "S"), (4, "Dee", "T"), (5, "Dee X", "T (ST)")], "id int, name string, constituency string")
    res = spark.createDataFrame([(1, "N", "ASHA VERRAN"), (2, "N", "Be"), (3, "S", "x"), (4, "S", "y"), (5, "T", "DEE X"), (6, "U", "z")], "contest int, seat string, winner string")
    got = {r.contest: (r.target, r.reason) for r in linkage.link_results(cands, res).collect()}
    assert got == {1: (1, None), 2: (2, None), 3: (3, None), 4: (None, "used already"), 5: (None, "ambiguous"), 6: (None, "no candidate")}


def test_filings(spark):
    cands = spark.createDataFrame([(1, "K Asha Verran", None, "N", "TDP")], "id int, name string, alias string, seat string, party string")
    rows = [("N", 0, "Asha Verran Longword", "party : Telugu Desam", "accepted"), ("N", 1, "Asha Verran", "Jatiya Jana Sena", "accepted"), ("N", 2, "Asha V", "Telugu Desam", "rejected"), ("N", 3, "K. Verran", "Telugu Desam", "accepted")]
    got = linkage.link_filings(spark.createDataFrame(rows, "seat string, pos int, name_line string, party_line string, status string"), cands).collect()
    assert [(r.id, r.pos) for r in got] == [(1, 3)]


def test_cases(spark):
    answers = [("d", 4, '{"pending":[{"fir_no":"5/22","confidence":0.69},{"description":""}]}'), ("d", 5, '{"pending":[{"fir_no":"5/22","confidence":0.7}],"convictions":[]}'), ("e", 1, "no")]
    rows = cases.explode_cases(spark.createDataFrame(answers, "doc string, page int, response string"))
    got = sorted((r.page, r.needs_review, r.raw_text) for r in rows.collect())
    assert got == [(4, True, "FIR: 5/22 | Desc: "), (5, False, "FIR: 5/22 | Desc: ")]
    firsts = cases.dedupe_cases(rows.withColumn("pos", F.col("page") * 100 + F.col("pos")), "doc").collect()
    assert [r.page for r in firsts] == [4]


def _fold(events):
    state = {}
    for e in sorted(events, key=lambda e: (e[4], e[0])):
        if e[3] in engagement.REACTIONS:
            k = (e[1], e[2])
            state[k] = None if state.get(k) == e[3] else e[3]
    return state


def test_toggle_fold_and_deltas(spark):
    rng = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    events = [(i, f"u{rng.randrange(4)}", f"i{rng.randrange(3)}", rng.choice([*engagement.REACTIONS, "other"]), base + dt.timedelta(seconds=rng.randrange(40))) for i in range(400)]
    df = spark.createDataFrame(events, "event_id long, uid string, item_id string, reaction string, ts timestamp")
    want = _fold(events)
    assert {(r.uid, r.item_id): r.reaction for r in engagement.reaction_state(df).collect()} == want
    sums = {r.item_id: [r[k] for k in engagement.REACTIONS] for r in engagement.counter_sums(engagement.reaction_deltas(df)).collect()}
    for item, counts in sums.items():
        assert counts == [sum(1 for (_, i), s in want.items() if i == item and s == k) for k in engagement.REACTIONS]


def test_throttle(spark):
    rng = random.Random(4)
    base = dt.datetime(2024, 1, 1)
    events = [(f"u{rng.randrange(5)}", i, base + dt.timedelta(seconds=rng.randrange(300))) for i in range(300)]
    last, want = {}, {}
    for u, i, t in sorted(events, key=lambda e: (e[2], e[1])):
        want[i] = u not in last or (t - last[u]).total_seconds() > 10
        if want[i]:
            last[u] = t
    got = engagement.throttle(spark.createDataFrame(events, "uid string, event_id long, ts timestamp"), 10)
    assert {r.event_id: r.accepted for r in got.collect()} == want


def test_page_index(spark):
    texts = {
        "strict": ["(5) Pending cases FIR No 79/2023 (a) (b) (c)", "Cr.No.1/2020", "(6) Cases of conviction", "(7) That I give"],
        "loose_before_strict": ["Pending criminal cases", "(5) Pending", "x", "movable assets"],
        "none": ["a", "b"],
        "zero": ["(5) Pending", "Total number of pending criminal cases: 0"],
        "style3": ["(5) Pending Case 1 CASE-2", "Case 2", "convicted for the offences"],
        "annexure": ["(5) Pending as per separate as per separate as per separate annexure", "z", "ANNEXURE J - Legal Cases", "FIR 5/2021", "end", "FIR 6/2021"],
    }
    rows = [(d, i + 1, t, "text") for d, ts in texts.items() for i, t in enumerate(ts)]
    got = {r.doc: r for r in pages.page_index(spark.createDataFrame(rows, "doc string, page int, text string, method string")).collect()}
    s = got["strict"]
    assert (s.s5, s.s6, s.s7, s.pending_pages, s.conviction_pages, s.pending_hint) == (1, 3, 4, [1, 2], [3], 4)  # written with and without its label, a number counts twice
    b = got["loose_before_strict"]
    assert (b.s5, b.s5_how, b.s7, b.pending_pages) == (2, "header", 4, [2])
    assert got["none"].status == "headers_missed" and got["none"].pending_pages == []
    assert got["zero"].pending_pages == [] and got["zero"].stated_pending == 0
    assert (got["style3"].pending_style, got["style3"].pending_hint) == ("style_3", 2)
    assert got["annexure"].annexure_pages == [3, 4] and got["annexure"].pending_pages == [3, 4] and got["annexure"].from_annexure


def test_news(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 0, 0, 0, "A", "http://x/?utm_a=1", t), (1, 1, 0, 1, "A", "http://x/", t), (1, 0, 0, 2, "B", "http://y", None), (1, 0, 0, 3, "C", "http://z", t + dt.timedelta(1))]
    df = spark.createDataFrame(rows, "candidate_id int, query_pos int, lang_pos int, pos int, title string, url string, published_at timestamp")
    got = sorted(news.dedupe_and_cap(df, 2).collect(), key=lambda r: r.rank)
    assert [r.pos for r in got] == [3, 0]
    kept = news.merge_news(df, df.where("pos = 3"), spark.createDataFrame([(1,)], "candidate_id int"))
    assert [r.pos for r in kept.collect()] == [3]


def test_discover(spark):
    items = spark.createDataFrame([(1, "Verran speaks", "on water"), (2, "asha and bel", ""), (3, "nothing", None)], "item_id int, title string, snippet string")
    cands = spark.createDataFrame([(10, "Asha Verran"), (11, "Bel Asha"), (12, "Water Verran"), (13, "Cor")], "candidate_id int, name string")
    got = sorted((r.item_id, r.candidate_id) for r in news.discover(items, cands).collect())
    assert got == [(1, 10), (1, 12), (2, 10), (2, 11)]


def test_audits(spark):
    df = spark.createDataFrame([(1, {"a": "1", "b": "2"}, {"b": "3", "c": "4"})], "id int, a map<string,string>, b map<string,string>")
    assert audits.merge_maps(df, "a", "b").first().merged == {"a": "1", "b": "3", "c": "4"}
    assert audits.merge_maps(df, "a", "b", "fill").first().merged == {"a": "1", "b": "2", "c": "4"}
    done = spark.createDataFrame([("x", 1)], "doc string, stamp int")
    todo = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "doc string, stamp int")
    assert sorted((r.doc, r.stamp) for r in audits.todo(todo, done).collect()) == [("x", 2), ("y", 1)]


def test_html_tables(spark):
    page = "<table><tr><td>decoy</td></tr></table><table><tr><th>SN</th><th>Candidate</th><th>Party</th><th>E</th><th>P</th><th>Total Votes</th><th>%</th></tr><tr><td>1</td><td>Asha</td><td>P</td><td>1,200</td><td>-</td><td>1,200</td><td>60.5</td></tr><tr><td>short</td></tr></table>"
    facts = "<table><caption>2024 Northvale election (5,000)</caption><tr><th>Turnout</th><td>3,000</td><td>60.0</td></tr><tr><th>Registered electors</th><td>4,900</td></tr></table>"
    df = spark.createDataFrame([(1, page), (2, facts), (3, None)], "page_id long, html string")
    rows = html.vote_rows(html.html_table_rows(df, ["Candidate", "Total Votes"], 7)).collect()
    assert [(r.contest, r.name, r.votes, r.postal_votes, r.percent) for r in rows] == [(1, "Asha", 1200, 0, 60.5)]
    f = html.labelled_table_facts(df, "^2024").collect()
    assert [(r.page_id, r.electors, r.votes, r.votes_source, r.percent) for r in f] == [(2, 4900, 3000, "turnout", 60.0)]


def test_files(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"by_candidate": {"7": [{"title": "a"}, {"title": "b"}], "8": []}}')
    assert [(r.candidate_id, r.pos, r.title) for r in files.read_news(spark, str(tmp_path / "n.json")).collect()] == [("7", 0, "a"), ("7", 1, "b")]
    (tmp_path / "bad.json").write_text("{nope")
    assert files.read_news(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "e.csv").write_text("Year,Constituency_No,Electors\n2024,1,100\n2024,1,200\n2024,2,x\n2019,3,5\n")
    assert [(r.contest, r.electors) for r in files.read_electors_csv(spark, str(tmp_path / "e.csv"), 2024).collect()] == [(1, 100)]
    (tmp_path / "f.jsonl").write_text('{"id":1,"reason":"a","timestamp":"1"}\nbroken\n{"id":1,"reason":"b","timestamp":"2"}\n')
    assert [r.reason for r in files.consolidate_failures(spark, str(tmp_path / "f.jsonl")).collect()] == ["b"]
    (tmp_path / "x.xml").write_text('<rss><channel><item><title>T</title><link>http://a</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><source url="u">S</source></item><item><title>no link</title></item></channel></rss>')
    got = files.read_feed_items(spark, str(tmp_path / "x.xml")).collect()
    assert [(r.title, r.source, str(r.published_at)) for r in got] == [("T", "S", "2024-01-01 10:00:00")]
    import pytest

    df = spark.range(3)
    with pytest.raises(files.GateClosed):
        files.gated_write(df, df, str(tmp_path / "out"), "1")
    assert files.gated_write(df, df.limit(0), str(tmp_path / "out"), "1") == 0
    with pytest.raises(files.GateClosed):
        files.expect_count(df, "id", 4)


def test_containment_pairs(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    left, right = sorted({word(rng.randrange(0, 9)) for _ in range(60)}), sorted({word(rng.randrange(0, 5)) for _ in range(60)})
    got = linkage.containment_pairs(spark.createDataFrame([(x,) for x in left], "l string"), "l", spark.createDataFrame([(x,) for x in right], "r string"), "r").collect()
    want = sorted((x, y) for x in left for y in right if y in x or x in y)
    assert sorted((r.l, r.r) for r in got) == want


def test_report_rules(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        ("a", "o", "o", False, "open", t, 1), ("a", "o", "o", False, "withdrawn", t, 2), ("a", "o", "o", False, "open", t, 3),  # stays withdrawn
        ("b", "o", "o", False, "open", t, 1), ("b", "o", "x", False, "withdrawn", t, 2), ("b", "o", "x", None, "resolved", t, 3),  # somebody else's
        ("c", "o", "o", False, "open", t, 1), ("c", "o", "z", True, "resolved", t, 3), ("c", "o", "z", True, "open", t, 2),  # equal times go by event
        ("d", "o", "o", False, "resolved", t, 1),
    ]
    df = spark.createDataFrame(rows, "report_id string, owner string, uid string, is_admin boolean, status string, ts timestamp, event_id long")
    assert {r.report_id: r.status for r in engagement.report_state(df).collect()} == {"a": "withdrawn", "b": "open", "c": "resolved"}
    full = dict(uid="u", candidate_id="1", candidate_name="n", field="age", current_value="", suggestion="s", reason="r", status="open")
    cases_ = [
        ({}, None), ({"field": "social_media"}, None), ({"field": "party"}, "unknown field"), ({"field": None}, "unknown field"), ({"suggestion": "x" * 500}, None), ({"suggestion": "x" * 501}, "suggestion length"),
        ({"current_value": None}, "current_value length"), ({"reason": ""}, "reason length"), ({"reason": "x" * 1001}, "reason length"), ({"candidate_name": "x" * 201}, "candidate_name length"),
        ({"candidate_id": "x" * 65}, "candidate_id length"), ({"status": "withdrawn"}, "not open"), ({"uid": None}, "no owner"),
    ]
    columns = ", ".join(f"{c} string" for c in full)
    got = engagement.valid_reports(spark.createDataFrame([(i, *(full | change).values()) for i, (change, _) in enumerate(cases_)], f"i int, {columns}"))
    assert [r.problem for r in got.orderBy("i").collect()] == [want for _, want in cases_]


def test_disputed_values(spark):
    cands = spark.createDataFrame([(1, None, "farmer", "3", "", "1970-01-01", [("A", "x"), ("B", "y")], {"x": "a", "w": "", "y": "b"})], "id int, education string, profession string, criminal_cases string, age string, dob string, ministries array<struct<name:string,sector:string>>, social_media map<string,string>")
    fields = {"education": "", "profession": "farmer", "criminal_cases": "3", "age": "1970-01-01", "ministries": "A, B", "social_media": "a / b", "party": "", None: ""}
    got = linkage.report_context(spark.createDataFrame([(1, f) for f in fields] + [(2, "age")], "candidate_id int, field string"), cands).collect()
    assert {(r.candidate_id, r.field): r.disputed for r in got} == {**{(1, f): v for f, v in fields.items()}, (2, "age"): ""}


def test_cases_of_one_position_keep_the_first_stored(spark, tmp_path):
    """Lines of an order that share number, position and signature: the category is that of the first in the file, or in the first file."""
    from hustings.plans import facts

    day = dt.datetime(1996, 1, 1)
    line = lambda order, supplier: (order, 8, supplier, 1, 1.0, "N", day)
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp"
    rows = [line(k, s) for s in (302, 420, 171, 143, 9) for k in range(300)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/one/lineitem.parquet")
    for k, part in enumerate((rows[:300], rows[300:], rows[300:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/raw{k}")
    (tmp_path / "two" / "lineitem.parquet").mkdir(parents=True)
    for k in range(3):
        (file,) = (tmp_path / f"raw{k}").glob("*.parquet")
        (tmp_path / "two" / "lineitem.parquet" / f"part-{k}.parquet").write_bytes(file.read_bytes())
    for folder in ("one", "two"):
        shown = facts.n23_categories(spark, f"{tmp_path}/{folder}")
        assert {(r.candidate_id, r.category) for r in shown.collect()} == {(k, "Serious/Violent") for k in range(300)}
        assert "stored_row" in shown._jdf.queryExecution().analyzed().toString()
        assert all((r.serious, r.minor) == (1, 0) for r in facts.a2_category_counts(spark, f"{tmp_path}/{folder}").collect())
