"""Nearest vectors, turn repair and lexical search against sequential code, with every awkward case."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hustings.llm import lexical_search, turn_repair, vector_search

# ---- lexical search

DOCS = "doc_id long, text string, lang string, `row` int, block int, terms string, term int, score double, n string"
ITEMS = "item_id long, text string, `row` int, term int"


def _terms(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def _ranked(items, docs, top=10):
    held = [(i, Counter(_terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, c), size in zip(held, sizes, strict=True):
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * (25 + 75 * size * n // length)))
                for w in _terms(text) if c[w]
            )
            if score:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top])]
    return Counter(out)


def _found(spark, items, docs, **more):
    df = lexical_search.ranked_search(spark.createDataFrame([(i, t, 1, 1) for i, t in items], ITEMS), spark.createDataFrame([(i, t, "en", 1, 1, "x", 1, 0.5, "y") for i, t in docs], DOCS), **more)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def _corpus(n_docs=300, n_items=8, seed=5):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "Lo", "mi", "éü", "TU", "9x", "ß") for b in ("r", "s", "t", "na", "ve", "日本", "44")]
    weights = [1 / (k + 1) for k in range(len(words))]
    draw = lambda k: " ".join(rng.choices(words, weights, k=k))
    docs = [(i, draw(rng.randrange(1, 60))) for i in range(n_docs)]
    docs += [(500 + i, docs[7][1]) for i in range(40)]  # copies: ties by id
    docs += [(None, docs[3][1]), (None, None), (3, docs[3][1]), (3, docs[3][1]), (900, ""), (901, None), (902, " .-\t"), (903, draw(40_000)), (904, "w" * 200_000)]
    items = [(i, draw(rng.randrange(1, 25))) for i in range(n_items)] + [(50, docs[7][1]), (51, "nowhere"), (52, ""), (53, None), (None, draw(5)), (0, draw(9)), (54, "w" * 200_000)]
    return items, docs


def test_search_against_brute_force(spark, monkeypatch):
    items, docs = _corpus()
    want = _ranked(items, docs)
    assert want and _found(spark, items, docs) == want
    # Many blocks and bundles, and terms that are joined instead of being known beforehand.
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 40)
    monkeypatch.setattr(lexical_search, "BUNDLE_ITEMS", 3)
    monkeypatch.setattr(lexical_search, "KNOWN_TERMS", 0)
    assert _found(spark, items, docs) == want
    assert _found(spark, items, docs, top=3) == _ranked(items, docs, 3)


def test_pruning_lets_nothing_of_the_result_go(spark, monkeypatch):
    """Accumulators shrink between the owners; what they lose can't be in a result."""
    monkeypatch.setattr(lexical_search, "OWNERS", (0.05, 0.1, 0.3, 0.5, 1.0))
    items, docs = _corpus(n_docs=400, n_items=20, seed=9)
    assert _found(spark, items, docs) == _ranked(items, docs)


def test_search_of_empty_tables(spark):
    items, docs = _corpus(n_docs=9, n_items=1)
    assert not _found(spark, [], docs) and not _found(spark, items, []) and not _found(spark, [], [])
    assert not _found(spark, items, [(1, None), (2, "")])


# ---- turn repair


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        by = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if by == 1 else re.sub("[.!?]", "", text) if by == 2 else text
        out += [(conv, turn, "user" if by == 4 else role, text)] * (0 if by == 0 else 2 if by == 3 else 1)
    return out


def _repaired(rows):
    """By Dijkstra over (row, initials so far in short), the queue ordered by cost and audit."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    facts, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        facts.append((role, text, kind))
    legal = re.compile(r"(s?(ua)+)?")
    may_go_on = re.compile(r"s?(ua)*u?")
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, shape, said = heapq.heappop(queue)
        if i == len(facts) and legal.fullmatch(shape):
            break
        short = (i, len(shape) > 0, shape[-1:])
        if short in done:
            continue
        done.add(short)
        steps = [("I", i, "ua"[k], (f"{('user', 'assistant')[k]}:",), 2) for k in range(2)]
        if i < len(facts):
            role, text, kind = facts[i]
            steps.append(("D", i + 1, "", (), 3))
            if kind in ("", "truncated"):
                more = int(kind == "truncated")
                if role:
                    steps.append(("K", i + 1, role[0], (f"{role}:{text}",), more))
                steps += [("R", i + 1, r[0], (f"{r}:{text}",), 2 + more) for r in ("user", "assistant")]
        for op, j, x, line, price in steps:
            if may_go_on.fullmatch(shape + x):
                heapq.heappush(queue, (cost + price, audit + op, j, shape + x, said + line))
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = lambda k: sum(f[2] == k for f in facts)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(facts))
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def _conversations(seed=3, n=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", "  \n", "ß ends here?", "A longer answer. It goes on", "tab.\t", "last\n.", "…", "a.\x85"]
    rows = []
    for c in range(n):
        size = rng.choice([1, 2, 3, 4, 6, 8, 12]) if c else 90
        for t in range(size):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            role = rng.choice(["system", "tool", "", None, "User", "u", "assist"]) if rng.random() < 0.15 else role
            rows.append((c, t + (rng.random() < 0.1) if rng.random() < 0.95 else None, role, rng.choice(texts) if rng.random() < 0.97 else None))
    rows += [(None, 1, "user", "hello."), (None, 2, "assistant", "yes."), (None, None, "system", "be nice.")]
    rows += [(901, 0, "user", "same."), (901, 0, "user", "same."), (901, 0, "user", "same."), (901, 1, "assistant", "x" * 300_000 + ".")]
    rows += [(902, k, "user", "all of one kind.") for k in range(70)]
    dropped = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(dropped, 0, "user", "gone."), (7, 0, None, None)], dropped


CONV = "conv_id long, turn long, role string, text string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _check_repair(spark, rows):
    got = {r.conv_id: tuple(r[c] for c in COUNTS) for r in turn_repair.repaired(turn_repair.damaged(spark.createDataFrame(rows, CONV).repartition(3))).collect()}
    want = {c: _repaired([r for r in _damage(rows) if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want
    return got


def test_repair_against_brute_force(spark):
    rows, dropped = _conversations()
    got = _check_repair(spark, rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {e for r in got.values() for e in r[6]} == set("DIKR")
    assert turn_repair.repaired(turn_repair.damaged(spark.createDataFrame([], CONV))).count() == 0


def test_repair_in_parts_is_the_same(monkeypatch):
    """Searching parts of a conversation and joining the best ways gives what one search gives."""
    rng = random.Random(1)
    for part in (1, 2, 3, 5):
        monkeypatch.setattr(turn_repair, "PART", part)
        for _ in range(150):
            rows = [(0, t, rng.choice(["user", "assistant", "assistant", "system", "x"]), rng.choice(["one.", "two!", "cut", ""])) for t in range(rng.randrange(0, 12))]
            repair, seen = turn_repair._Repair(), set()
            for _, turn, role, text in rows:
                repair.add(turn, role, text, not text.strip(), text.strip()[-1:] not in (".", "!", "?"), (role, text) in seen)
                seen.add((role, text))
            assert tuple(repair.result()) == _repaired(rows), (part, rows)


def test_repair_of_a_long_conversation(spark):
    """A conversation of many thousand turns is searched in parts, whatever share of the rows it has."""
    rng = random.Random(2)
    rows = [(5, t, rng.choice(["user", "assistant"]), f"turn {t}" + rng.choice(["", "."])) for t in range(20_000)]
    (r,) = turn_repair.repaired(turn_repair.damaged(spark.createDataFrame(rows, CONV))).collect()
    hurt = _damage(rows)
    assert len(r.audit) - r.audit.count("I") == len(hurt) and r.audit.count("D") >= r.blank + r.duplicate
    assert r.cost == 3 * r.audit.count("D") + 2 * (r.audit.count("I") + r.audit.count("R")) + sum(
        e != "D" and not re.search(r"[.!?]\s*$", x[3]) for e, x in zip(r.audit.replace("I", ""), hurt, strict=True)
    )


# ---- nearest vectors


def _near(rows, queries, top):
    sound = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in {(i, tuple(v)) for i, v in sound if queries(i)}:
        own = False
        near = []
        for i, w in sound:
            if not own and i == q and tuple(w) == v:
                own = True
                continue
            if len(w) == len(v):
                near.append((float(np.sqrt(((w - np.array(v)) ** 2).sum())), i))
        out[q] = sorted(near)[:top]
    return out


def _answers(spark, rows, top=10, **more):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, `list` int, ids string").repartition(3)
    sound = vector_search.sound(df)
    out = {}
    for r in sorted(vector_search.nearest(sound.where(F.col("vec_id") % 50 == 0), sound, top, **more).collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def test_nearest_with_awkward_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)]
    rows += [(200 + i, rows[100][1]) for i in range(60)] + [(100, rows[100][1]), (260, rows[7][1])]  # copies, also of queries
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [math.nan] * 6), (304, [math.inf] + [1.0] * 5), (305, [None] + [1.0] * 5), (None, rows[3][1]), (350, [1.0, 2.0]), (351, [1.0, 2.5]), (400, [3.0] * 9)]
    got, want = _answers(spark, rows, prune=99.0), _near(rows, lambda i: i % 50 == 0, 10)
    assert {k: [i for _, i in v] for k, v in got.items()} == {k: [i for _, i in v] for k, v in want.items() if v}
    assert all(np.allclose([s for s, _ in got[k]], [s for s, _ in want[k]], rtol=1e-12, atol=0) for k in got)
    assert 300 not in got and got[350] == [(0.5, 351)] and 400 not in got
    assert _answers(spark, []) == {} and _answers(spark, [(50, [1.0])]) == {}


def test_recall_with_pruning(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "LIST", 32)
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 20)
    monkeypatch.setattr(vector_search, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(40, 16))
    rows = [(i, (middles[i % 40] + 0.4 * rng.normal(size=16)).tolist()) for i in range(3000)]
    got, want = _answers(spark, rows), _near(rows, lambda i: i % 50 == 0, 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    recall = sum(len({i for _, i in got[k]} & {i for _, i in want[k]}) for k in want) / (10 * len(want))
    assert recall >= 0.95


def test_graph_finds_what_looking_at_all_centres_finds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 24))
    centres = vector_search.balanced_centres(x, 256)
    assert centres.shape == (256, 24)
    found, far = vector_search.CentreGraph(centres).search(x[:500], vector_search.WIDTH, 1.03)
    d = np.sqrt(((x[:500, None] - centres[None]) ** 2).sum(-1))
    assert np.allclose(far[:, 0], d[np.arange(500), found[:, 0]]) and (found[:, 0] == d.argmin(1)).mean() > 0.98
    assert vector_search.balanced_centres(x[:1], 1).shape == (1, 24) and vector_search.CentreGraph(x[:1]).search(x[:3], 9, 2.0)[0].tolist() == [[0]] * 3
    sizes = {len(p) for p in np.array_split(np.arange(64), 8)}
    assert sizes == {8} and vector_search.balanced_centres(x[:64], 8).shape == (8, 24)


@pytest.mark.parametrize("name", ["op12_deepening_repair", "op13_pipelined_search"])
def test_has_sql(name):
    from hustings.llm import registry

    assert name in registry.oracle_sql()
