"""Each stage of the pipeline against what its operator says, on a small table."""

import pytest

import corpus_pipeline as P

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    item = "what is the boiling point of pure water at sea level in the open air of spring"
    body = " ".join(f"word{i}" for i in range(80))
    docs = [
        (1, body, "en", "s", 1), (2, body + " more", "en", "s", 1), (3, "The answer: " + item + " is known to all of us", "en", "s", 1), (4, "12 34", "en", "s", 1), (5, None, None, None, None),
        (6, "a line that is shared by two\nown six and more of it", "en", "s", 1), (7, "a line that is shared by two\nown seven words are here", "en", "s", 1), (8, "ein anderer kleiner text", "de", "s", 1),
    ]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, table).cache()
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    assert set(seen["language_id"]) == {1, 2, 3, 6, 7, 8}
    assert seen["line_dedup"][7].text == "own seven words are here" and seen["line_dedup"][6].n_chars == len(seen["line_dedup"][6].text)
    assert set(seen["near_dedup"]) == {1, 3, 6, 7, 8}
    assert set(seen["decontamination"]) == {1, 6, 7, 8}
    assert set(seen["sentencepiece_sampling"]) == {1, 6, 7, 8}


def test_run_is_the_stages_one_after_another(spark, table):
    assert {r.doc_id for r in P.run(spark, table).collect()} == {1, 6, 7, 8}


CLASH = "doc_id long, text string, lang string, `row` int, n_lines int, n_dropped string, kept string, lang_pred string, score double, n_grams string, text_key int, hash int, item int, place int, band int, id int, label int, `set` int, n_chars long, `__id` int, ids int, rank int"


def test_stages_on_awkward_tables(spark, table):
    """Empty tables, columns that are called like an operator's own, nulls, repeats, and a text of some MB."""
    blank = [0] * 3 + ["x"] * 3 + [0.5, "y"] + [1] * 8
    long = " ".join(f"long{i % 50_000}" for i in range(400_000))
    line = "\nthis line stands in several of them"
    texts = [(1, "some words that are here to be read" + line), (2, None), (3, ""), (None, "words without an id" + line), (4, long), (4, long), (5, long + " end"), (6, "only a few more words" + line), (6, "only a few more words" + line)]
    row = lambda i, t: (i, t, "en", 7, 7, "x", "k", "l", 0.5, "g", *[1] * 8, len(t or ""), 1, 1, 1)
    docs = spark.createDataFrame([row(i, t) for i, t in texts], CLASH)
    want = {
        "language_id": [1, 4, 4, 5, 6, 6, None], "line_dedup": [1, 2, 3, 4, 4, 5, 6, 6, None], "near_dedup": [1, 2, 3, 4, 4, 6, 6, None], "decontamination": [1, 2, 3, 4, 4, 5, 6, 6, None],
    }
    for name, stage in P.STAGES:
        got = stage(spark, docs, table)
        if name in want:
            assert got.columns == docs.columns
            found = got.collect()
            assert sorted((r.doc_id for r in found), key=lambda x: (x is None, x or 0)) == want[name]
            assert all(r.row == 7 and r.kept == "k" and r.lang_pred == "l" for r in found)
            if name == "line_dedup":
                assert [r.text for r in found if r.doc_id in (1, 6)] == ["some words that are here to be read"] + ["only a few more words"] * 2 and [r.text for r in found if r.doc_id == 2] == [""]
        elif name == P.STAGES[-1][0]:
            assert {r.doc_id for r in got.select("doc_id").collect()} == {1, 2, 3, 4, 5, 6, None}
        assert stage(spark, docs.where("false"), table).count() == 0


def test_language_stage_rejects_what_is_in_no_language(spark, table):
    rng = __import__("numpy").random.default_rng(8)
    words = "the of and that with this from they would there their about which when people water other".split()
    texts = [(i, " ".join(rng.choice(words, 80))) for i in range(40)] + [(90, "zqxj " * 100), (91, "zqxj vw"), (92, "12 34 !!")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string")
    assert {r.doc_id for r in P.identify_language(spark, docs, table).collect()} == {*range(40), 91}


def test_run_against_brute_force(spark, tmp_path):
    """All stages one after another, by sequential code, on texts without slots."""
    import hashlib
    import random

    from test_operators import _line_brute, _near_brute, _windows_brute

    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("bdfgklmn") + rng.choice("aei") for _ in range(rng.randrange(2, 5))) for _ in range(400)]
    draw = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, draw(rng.randrange(6, 20))) for k in range(6)]
    shared, texts = [draw(9) for _ in range(3)], []
    for _ in range(30):
        lines = [draw(rng.randrange(4, 15)) for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.5:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(shared).upper())
        texts.append("\n".join(lines))
    for _ in range(8):  # near copies, each of one long line
        base = draw(80).split()
        for _ in range(rng.randrange(2, 5)):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    for k in range(8):  # whole and part items
        words = items[k % 6][1].split()
        texts.append(f"{draw(15)} {' '.join(words[rng.randrange(3) :])} {draw(15)}")
    texts += ["", None, "12 34 !", shared[0], " ".join(["zqxj"] * 120)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    spark.createDataFrame([(i, t, None if (t or "").startswith("zqxj") else "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "") and not t.startswith("zqxj")]
    kept = [(i, t) for i, _, _, t in _line_brute(kept)]
    firsts = {i for i, _, _, first in _near_brute(kept, 5, 80) if first}
    kept = [(i, t) for i, t in kept if i in firsts]
    leaked = {i for i, t in kept for _, x in items for found, total in [_windows_brute(t, x)] if found and found >= total / 2}
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept if i not in leaked}
    got = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text_sha256 for r in got} == want and leaked and len(firsts) < len(docs) - 10
    assert all(sorted(r.rank for r in got if r.doc_id == i) in ([0], [0, 1]) for i in want)
