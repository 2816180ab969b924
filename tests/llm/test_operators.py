"""The text operators against brute force, on small tables with every awkward case."""

import hashlib
import io
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hustings.llm import decontaminate, jpeg, language_id, line_dedup, minhash, pii, sample_encode, sharding, suffix_dedup, suffix_groups, token_counts
from hustings.llm import shingles as S

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, start int, `row` int, shard int, word int"

LINE = "A line that many documents share, word for word."
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(6000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
TEXTS = [
    (1, "Hello world, this is a test of five words.\n" + LINE),
    (2, LINE + "\n" + LINE.upper() + " \nown line number two"),
    (3, ""), (4, None), (5, "   "), (6, "\n\n"), (7, "ab"), (8, LONG), (9, LONG), (10, LONG.replace("w5x5", "changed")),
    (11, "x" * 5000), (12, PASSAGE + " tail one of this"), (13, "head two here " + PASSAGE), (14, "äöü ß – ﬁ ① 😀 \t\x0b end"), (14, "äöü ß – ﬁ ① 😀 \t\x0b end"),
    (15, "mail a@b.example or c@d.example_e@f.example, ip 10.0.0.256 and 010.1.2.255, card 4111 1111 1111 1111, 4111111111111112, call +1 (389) 555-5010"),
    (16, "GB82 WEST 1234 5698 7654 32 is an iban"), (17, "the end of " + LINE), (None, LINE + "\nnull id"), (18, "1.2.3.4.5.6.7.8 a@@b.c d@e..f g@h.i.j " + "7" * 3000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "k", 1, 2, 3, 4) for i, t in TEXTS], COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_shards(docs, empty):
    got = sharding.byte_shards(docs, 4).collect()
    want = [len((t or "").encode()) + 16 for _, t in TEXTS]
    assert sorted(r["size"] for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.text_crc32 in {zlib.crc32((t or "").encode()) for i, t in TEXTS if i == r.doc_id}
    target = sum(want) / 4
    for s, part in by.items():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - target) <= 2 * max(want)
    order = [(r.text_crc32, r["size"]) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert sum(a != b for a, b in zip(order, order[1:])) <= len(set(order)) + 3  # equal texts stand together
    assert sharding.byte_shards(empty, 4).count() == 0


def test_shards_keep_equal_texts_together(spark):
    """Groups from single copies to nine tenths of a shard are whole, larger ones are cut, sizes are near equal."""
    rng = np.random.default_rng(12)
    letters = list("abcdefgh ")
    pool = ["".join(rng.choice(letters, int(n))) for n in rng.integers(20, 80, 3000)]
    size = lambda t: len(t.encode()) + 16
    texts, n_shards = list(enumerate(pool)), 5
    target = sum(map(size, pool)) / 2  # as large as all shards will be, nearly
    for k, part in enumerate((0.01, 0.05, 0.2, 0.5, 0.9)):
        text = f"copy {k} " + "x" * 20
        texts += [(10_000 * (k + 1) + i, text) for i in range(int(target * part / size(text)))]
    texts += [(900_000 + i, "hot " + "y" * 30) for i in range(int(1.3 * target / size("hot " + "y" * 30)))] + [(None, None), (None, None), (7, pool[7])]
    got = sharding.byte_shards(spark.createDataFrame(texts, "doc_id long, text string"), n_shards).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, size(t or ""), zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(n_shards) for k in range(sum(r.shard == s for r in got))]
    whole, by_text, loads = sum(r["size"] for r in got), defaultdict(list), Counter()
    for r in got:
        by_text[r.text_crc32, r["size"]].append(r.shard)
        loads[r.shard] += r["size"]
    for (_, n), shards in by_text.items():
        assert len(set(shards)) == 1 or n * len(shards) > whole / n_shards
    assert max(loads.values()) - min(loads.values()) <= 0.03 * whole / n_shards
    order = [(r.text_crc32, r["size"]) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert sum(a != b for a, b in zip(order, order[1:])) <= len(by_text) + n_shards


def _line_brute(texts):
    strip = " \t\n\v\f\r"
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda x: x.strip(strip).translate(low)
    where = defaultdict(set)
    rank = lambda i: -math.inf if i is None else i
    for i, t in texts:
        for x in (t or "").split("\n"):
            where[key(x)].add(rank(i))
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(where[key(x)]) > 1 and min(where[key(x)]) != rank(i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines(docs, empty):
    got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    assert rows(got, "doc_id", "n_lines", "n_dropped", "kept") == _line_brute(TEXTS)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert line_dedup.apply_bitmaps(empty, line_dedup.keep_bitmaps(empty)).count() == 0


def _pii_brute(text):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def fine(kind, m):
        d = [int(c) for c in re.sub("[^0-9]", "", m)]
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            twice = [sum(divmod(2 * c, 10)) for c in d[-2::-2]]
            return 14 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(twice)) % 10 == 0
        return kind != "phone" or 10 <= len(d) <= 15

    found = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(kinds.items()) for m in re.finditer(p, text) if fine(kind, m.group()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)


def test_pii(docs, empty):
    got = pii.digest(pii.find(docs))
    want = sorted(((i, hashlib.sha256(_pii_brute(t or "").encode()).hexdigest()) for i, t in TEXTS), key=repr)
    assert rows(got, "doc_id", "base_sha256") == want
    spans = {r.doc_id: r.spans for r in got.collect()}
    assert spans[16] == "iban:0:27" and "iban" not in spans[15]
    assert pii.digest(pii.find(empty)).count() == 0


def test_tokens(docs, empty, monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted(((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in TEXTS), key=repr)
    for share in (500_000, 20):  # also with most pre-tokens going through the join
        monkeypatch.setattr(token_counts, "HEAD_SHARE", share)
        assert rows(token_counts.token_counts(docs, MODEL), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(empty, MODEL).count() == 0


def test_media(docs, empty):
    got = jpeg.media_features(jpeg.store_texts(docs)).collect()
    for r in got:
        texts = [(t or "").encode() for i, t in TEXTS if i == r.doc_id]
        assert r.payload_sha256 in {hashlib.sha256(jpeg.payload_of(t)).hexdigest() for t in texts}
        assert r.payload_bytes % 576 == 0 and r.width == 192
        assert {(r.n_bytes, r.tail_crc32) for r in got if r.doc_id == 8} == {(len(LONG), zlib.crc32(jpeg.payload_of(LONG.encode())[-32:]))}
    files = {(r.doc_id, r.n_bytes): bytes(r.media) for r in jpeg.store_texts(docs).collect()}
    assert all((r.media_bytes, r.media_sha256) == (len(files[r.doc_id, r.n_bytes]), hashlib.sha256(files[r.doc_id, r.n_bytes]).hexdigest()) for r in got)
    assert len(got) == len(TEXTS)
    assert jpeg.media_features(jpeg.store_texts(empty)).count() == 0
    big = [jpeg.payload_of(bytes(range(256)) * 2000)]
    ((size, image),) = jpeg.thumbnails(jpeg.encode(big))[0]  # one image, as an ordinary reader takes it
    assert image.tobytes() == big[0] and size == (jpeg.UNIT * 8, len(big[0]) // jpeg.UNIT * 8)
    most = [jpeg.payload_of(bytes(5_000_000)), b"a" * jpeg.UNIT]
    assert [b"".join(x.tobytes() for _, x in f) for f in jpeg.thumbnails(jpeg.encode(most))] == most


def test_media_reads_ac_coefficients_and_subsampled_colour():
    """A hand-made file: 2x2 luminance, one block of each colour, with AC values to skip."""
    bits, lum = [], [10, -3, 0, 25]
    put = lambda code, n: bits.extend(int(b) for b in f"{code:0{n}b}") if n else None
    dc = jpeg.huffman_codes(jpeg.DC_LENGTHS, jpeg.DC_VALUES)
    ac_table = ((0, 3) + (0,) * 14, (0x00, 0x01, 0xF0))
    ac = jpeg.huffman_codes(*ac_table)

    def block(diff):
        size = abs(diff).bit_length()
        put(*dc[size])
        put(diff if diff >= 0 else diff + (1 << size) - 1, size)
        put(*ac[0xF0])  # sixteen zeros
        put(*ac[0x01])
        put(1, 1)
        put(*ac[0])

    last = 0
    for v in lum:
        block(v - last)
        last = v
    block(7)
    block(-7)
    bits += [1] * (-len(bits) % 8)
    scan = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    part = lambda kind, body: bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body
    media = (
        b"\xff\xd8" + part(0xE0, b"JFIF\0") + part(0xDB, bytes([0, 16] + [1] * 63)) + part(0xC0, bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        + part(0xC4, bytes([0, *jpeg.DC_LENGTHS, *jpeg.DC_VALUES])) + part(0xC4, bytes([0x10, *ac_table[0], *ac_table[1]])) + part(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    )
    ((size, image),) = jpeg.thumbnails([media])[0]
    assert size == (16, 16) and image.tolist() == [[128 + 2 * lum[0], 128 + 2 * lum[1]], [128 + 2 * lum[2], 128 + 2 * lum[3]]]
    assert io.BytesIO(media).read(2) == b"\xff\xd8"


def test_language(spark, empty):
    words = {"en": "the of and that with this from they would there", "de": "der die und nicht mit ein auch sich werden über", "fr": "le la et que les des une dans pour être"}
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(rng.choice(w.split(), 40)), lang) for i in range(120) for lang, w in [list(words.items())[i % 3]]]
    texts += [(200, None, "en"), (201, "123 !!", "en"), (202, "", None), (None, "the of and", "en")]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    held = language_id.held_out
    model = language_id.collect_model(language_id.prototypes(df.where(~held(df.doc_id))))
    got = language_id.predict(df, model).collect()
    truth = {i: lang for i, _, lang in texts}
    real = [r for r in got if r.doc_id is not None and r.doc_id < 200]
    assert all(r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1 for r in real)
    assert {r.doc_id: r.lang_pred for r in got if (r.doc_id or 0) >= 200} == {200: "und", 201: "und", 202: "und"}
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.where("doc_id is not null").select("doc_id", held(df.doc_id).alias("h")).collect())
    nothing = language_id.collect_model(language_id.prototypes(empty))
    assert nothing[0] == [] and {r.lang_pred for r in language_id.predict(df, nothing).collect()} == {"und"}


def test_language_against_brute_force(spark):
    base = np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (64, 512)).astype(int)

    def vector(text):
        symbols = []
        for ch in text.lower():
            s = (ord(ch) - 96 if "a" <= ch <= "z" else 27 + ord(ch) % 37) if ch.isalpha() else 0
            if s or not symbols or symbols[-1]:
                symbols.append(s)
        symbols = [0, *symbols, 0]
        total = np.zeros(512)
        for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
            if a or b or c:
                total += np.roll(base[a], 2) * np.roll(base[b], 1) * base[c]
        return total

    for text in ("The  sea, the SEA!", "über alles ñandú 12 a", "ab", " x "):
        codes, counts = language_id.grams(text)
        assert np.allclose(language_id.bundle(codes, counts), vector(text))
    rng = np.random.default_rng(5)
    words = [[f"{a}{b}{c}" for a in "bdfg" for b in v for c in "lmn"] for v in ("aeé", "oua", "iyo")]
    texts = [(i, " ".join(rng.choice(words[i % 3], 12)), f"l{i % 3}") for i in range(60)]
    model = language_id.collect_model(language_id.prototypes(spark.createDataFrame(texts, "doc_id long, text string, lang string")))
    sums = {k: sum(vector(t) for _, t, lang in texts if lang == k) for k in ("l0", "l1", "l2")}
    assert model[0] == list(sums) and np.allclose(model[1], [v / np.linalg.norm(v) for v in sums.values()], atol=1e-5)
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(texts, "doc_id long, text string, lang string"), model).collect()}
    for i, t, _ in texts:
        cosines = {k: v @ vector(t) / np.linalg.norm(v) / np.linalg.norm(vector(t)) for k, v in sums.items()}
        best = max(cosines, key=cosines.get)
        assert got[i].lang_pred == best and abs(got[i].score - cosines[best]) < 1e-4


def test_suffix_order():
    rng = np.random.default_rng(2)
    for _ in range(400):
        s = rng.integers(0, rng.integers(1, 9), rng.integers(0, 50)).tolist()
        assert suffix_groups.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def _spans_brute(texts, window):
    seen = Counter(t[p : p + window] for _, t in texts for p in range(len(t) - window + 1))
    out = []
    for i, t in texts:
        covered = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - window + 1):
            if seen[t[p : p + window]] > 1:
                covered[p : p + window] = True
        out.append((i, len(t), int(covered.sum()), int(np.count_nonzero(np.diff(covered.astype(int)) == 1) + covered[0]), bytes(b for b, c in zip(t, covered) if not c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [512, 2])
def test_repeated_spans(spark, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 2: nearly every group is split by longer seeds
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(rng.choice(list("abcdefg "), n))
    passage = noise(450)
    more = [(100 + i, noise(300) + passage[: 400 + 5 * i] + noise(250)) for i in range(10)] + [(200, noise(50) + passage + passage[7:] + noise(30))]
    texts = [(i, t) for i, t in TEXTS if i != 11] + more + [(300, "ab" * 700), (301, "zz" + "ab" * 300)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = suffix_dedup.remove_spans(df, suffix_dedup.repeated_spans(df))
    have = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()), key=repr)
    assert have == _spans_brute([(i, (t or "").encode()) for i, t in texts], 400)
    if hot == 512:
        assert suffix_dedup.remove_spans(empty, suffix_dedup.repeated_spans(empty)).count() == 0


def test_features_of_no_file(spark, docs):
    stored = jpeg.store_texts(docs.where("doc_id in (1, 7)"))
    some = stored.withColumn("media", F.when(F.col("doc_id") == 1, F.col("media")))
    got = {r.doc_id: r for r in jpeg.media_features(some).collect()}
    assert all(v is None for v in list(got[7])[2:]) and all(v is not None for v in list(got[1])[2:])
    assert jpeg.media_features(some.where("false")).count() == 0


def test_repeated_passages(spark, docs, empty):
    """Every run of 50 words that starts twice, and nothing else, also inside one text."""
    rng = np.random.default_rng(11)
    draw = lambda n: [f"v{x}" for x in rng.integers(0, 5000, n)]
    texts = list(TEXTS)
    for i in range(40):
        part = draw(int(rng.integers(45, 70)))
        for j in range(2 + i % 2):
            texts.append((1000 + 10 * i + j, " ".join(draw(int(rng.integers(0, 90))) + part + draw(int(rng.integers(0, 90))))))
    own = " ".join(draw(60))
    texts += [(2000, own + " . " + own), (2001, " ".join(draw(300))), (None, " ".join(draw(10)) + " " + PASSAGE), (None, " ".join(draw(60))), (2002, own.upper())]
    words = {(i, t): re.split("[ \t\n\v\f\r]+", (t or "").lower().strip(" \t\n\v\f\r")) for i, t in texts}
    places = defaultdict(list)
    for i, t in texts:  # a row that repeats id and text is a place of its own
        for p in range(len(words[i, t]) - 49):
            places[tuple(words[i, t][p : p + 50])].append((i, t, p))
    covered = defaultdict(set)
    for found in places.values():
        for i, t, p in found if len(found) > 1 else ():
            covered[i, t] |= set(range(p, p + 50))
    want = {k: sum(p - 1 not in c or (p not in c) for p in c) for k, c in covered.items()}
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    of = {r.hash: r.text for r in df.collect()}
    none = spark.createDataFrame([], "doc_id long, text_hash long")
    got = {(r.doc_id, of[r.text_hash]): r.n_passages for r in suffix_dedup.repeated_passages(df, none).collect()}
    assert set(got) == set(want) and len(got) > 40 and got[2000, own + " . " + own] == 2
    # Rows that lose bytes aren't asked about, but what they share with others counts.
    known = df.where("doc_id % 2 = 0").select("doc_id", F.col("hash").alias("text_hash"))
    some = {(r.doc_id, of[r.text_hash]) for r in suffix_dedup.repeated_passages(df, known).collect()}
    assert some == {k for k in want if k[0] is None or k[0] % 2}
    assert suffix_dedup.repeated_passages(empty, none).count() == 0


@pytest.mark.parametrize("hot", [512, 2])
def test_short_passages_are_told_from_clean_documents(spark, tmp_path, monkeypatch, hot):
    """Passages of over fifty words that are shorter than 400 bytes mark all their documents, and nothing else is marked."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 2: groups of words are split by longer seeds
    rng = np.random.default_rng(5)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 9999, n)]
    planted, long, clean = {}, {}, {i: " ".join(draw(30 + 5 * i)) for i in range(20)}
    for i in range(8):
        passage = draw(51 + i % 3)
        for j in range(2 + 2 * (i % 3)):
            planted[100 + 10 * i + j] = " ".join(draw(7 * j) + passage + draw(40 - 5 * j))
    shared = " ".join(draw(90))
    long |= {300: shared + " " + " ".join(draw(60)), 301: " ".join(draw(60)) + " " + shared}
    clean[400], clean[401] = (" ".join(draw(20) + x) for x in [draw(48)] * 2)  # two words too few
    spark.createDataFrame([*(planted | long | clean).items(), (500, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in suffix_dedup.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(planted) + len(long) + len(clean) + 1
    assert {i for i, r in got.items() if r.n_passages} == set(planted)
    assert all(got[i].n_removed == 0 and got[i].n_passages == 1 for i in planted)
    assert {i for i, r in got.items() if r.n_removed} == set(long)
    assert {i for i, r in got.items() if r.n_repeats} == set(planted) | set(long)


def _near_brute(texts, n, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(low)) if x]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and None not in (texts[i][0], texts[j][0]) and both * 100 >= percent * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = defaultdict(lambda: math.inf)
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[root(i)] = min(least[root(i)], d)
    return sorted(((d, len(s), None if d is None else least[root(i)], d is None or least[root(i)] == d) for i, ((d, _), s) in enumerate(zip(texts, sets, strict=True))), key=repr)


def test_near_duplicates(spark, docs, empty):
    rng = np.random.default_rng(3)
    base = [f"t{x}" for x in rng.integers(0, 400, 120)]
    texts = list(TEXTS)
    for i in range(60):  # one large group of copies that differ from each other at the limit
        own = list(base)
        for p in rng.integers(0, len(own), rng.integers(0, 7)):
            own[p] = f"n{rng.integers(0, 30)}"
        texts.append((100 + i, " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = minhash.near_duplicates(df, 4, 80)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == _near_brute(texts, 4, 80)
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_among_small_sets_that_share_most(spark):
    """Groups whose members have much in common with all others and are linked with few."""
    rng = np.random.default_rng(13)
    texts = []
    for g in range(6):
        base = [f"g{g}b{x}" for x in range(6 + 5 * g)]
        for i in range(50):
            own = list(base)
            for _ in range(int(rng.integers(0, 3 + g))):
                own.insert(int(rng.integers(0, len(own) + 1)) if rng.random() < 0.3 else len(own), f"n{rng.integers(0, 12)}")
            texts.append((g * 1000 + i, " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for n in (1, 3, 4):
        assert rows(minhash.near_duplicates(df, n, 80), "doc_id", "n_shingles", "component_id", "kept") == _near_brute(texts, n, 80)


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 1300, dtype=np.uint64)
    a, b = pool[:1000], pool[100:1100]
    sig = minhash.super_minhash(np.concatenate([a, b]), np.repeat([0, 1], 1000), 2, 512)
    assert abs((sig[0] == sig[1]).mean() - 900 / 1100) < 0.05
    one = minhash.super_minhash(a[:1], np.zeros(1, np.int64), 1, 64)
    assert (np.sort(one[0] >> np.uint64(40)) == np.arange(64)).all()  # a permutation: each level once


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.label for r in got} == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_components_of_few_edges_take_few_tasks(spark):
    """Edges of many tasks: as many tasks as the edges fill, and no round that deals all out again; the same groups in rounds."""
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 900, (700, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000)]
    up = {x: x for e in edges for x in e}
    for _ in range(len(up)):
        changed = [(max(up[a], up[b]), min(up[a], up[b])) for a, b in edges if up[a] != up[b]]
        if not changed:
            break
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    want = sorted((x, up[x]) for x in linked)
    rows = spark.createDataFrame(edges, "a long, b long").repartition(16)
    group = "components of few edges"
    spark.sparkContext.setJobGroup(group, group)
    found = minhash.components(rows).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    track = spark.sparkContext.statusTracker()
    stages = [track.getStageInfo(s) for j in track.getJobIdsForGroup(group) for s in track.getJobInfo(j).stageIds]
    assert sorted((r.id, r.label) for r in found) == want
    assert sum(s.numCompletedTasks for s in stages if s) <= 100
    assert sorted((r.id, r.label) for r in minhash.components(rows, per_task=100).collect()) == want
    assert minhash.components(rows.where("false")).count() == 0


def test_decontamination(spark, docs, empty):
    item = "A train leaves Paris at 9 and drives 120 km to Lyon while another leaves Lyon at 10 and meets it on the way"
    items = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, "what is the boiling point of pure water at sea level in the open air")], "item_id long, text string")
    texts = [
        (1, "Intro. " + item + " More."), (2, "So " + item.replace("Paris", "Rome").replace("Lyon", "Milan").replace("120", "75").replace("9", "8") + "!"),
        (3, "So " + item.replace("to Lyon", "to Milan") + "."), (4, "nothing of the kind is here at all, only other words"), (5, item.upper().lower()), (6, None), (None, item), (7, item), (7, item),
    ]
    found = decontaminate.matches(spark.createDataFrame(texts, "doc_id long, text string"), items)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert {(1, 1), (2, 1), (7, 1), (None, 1)} <= got and not {4, 6} & {d for d, _ in got}
    assert (3, 1) not in got  # one town is two: the slots contradict each other
    assert decontaminate.matches(empty, items).count() == 0 and decontaminate.matches(docs, empty.select("doc_id", "text").withColumnRenamed("doc_id", "item_id")).count() == 0


def test_decontamination_in_other_letter_case(spark, monkeypatch):
    item = "A train leaves Paris at 9 and drives 120 km to Lyon while Anna and Bert leave Nancy for Metz at 10 and meet Carla on the way"
    town = "Quiet Anna and Old Bert met Carla in Metz and Nancy near Lyon by Straße"
    items = spark.createDataFrame([(1, item), (2, town), (3, "THE RIVER RUNS ALONG THE OLD WALL OF THE TOWN")], "item_id long, text string")
    texts = [
        (1, "So " + item.upper() + " indeed"), (2, "so " + item.lower()), (3, "BEFORE IT " + town.upper()), (4, town.lower().swapcase()), (5, "It says the river runs along the old wall of the town."),
        (6, "ANOTHER TEXT IN UPPER CASE THAT HOLDS NONE OF THEM AT ALL"), (7, item.replace("120", "75").upper()), (8, item.replace("120", "9").upper()),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (7, 1)]
    assert rows(decontaminate.matches(docs, items), "doc_id", "item_id") == want
    assert {r.coverage for r in decontaminate.matches(docs, items).collect()} == {1.0}
    monkeypatch.setattr(decontaminate, "MOST_WINDOWS", 0)
    assert rows(decontaminate.matches(docs, items), "doc_id", "item_id") == want


def test_decontamination_names_that_start_sentences(spark):
    item = "Sarah buys 4 pens. Sarah sells 2 pens. Sarah keeps the rest."
    two = "Tom has 5 apples more than Ann. Tom gives 3 of his apples to Ann.\nHow many more apples has Tom now? The answer is a number."
    items = spark.createDataFrame([(1, item), (2, two)], "item_id long, text string")
    texts = [
        (1, item.replace("Sarah", "Emma")), (2, 'They ask: "' + item.replace("Sarah", "Emma") + '"'), (3, "So " + item.replace("Sarah", "Emma").replace("4", "9")),
        (4, two.replace("Tom", "Bob").replace("Ann", "Eve")), (5, two.replace("Tom", "Bob").replace("The answer", "An answer")), (6, "the answer is a number, the rest is not."),
        (7, "Sarah buys 4 pens. Emma sells 2 pens. Ann keeps the rest."),
    ]
    got = rows(decontaminate.matches(spark.createDataFrame(texts, "doc_id long, text string"), items), "doc_id", "item_id")
    assert got == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)]


def test_decontamination_holds_slots_across_inserted_words(spark):
    item = "A train leaves Paris at 9 and drives 120 km to Lyon while another leaves Lyon at 10 and meets it on the long way back"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    halves = lambda one, two: item.replace("to Lyon", f"to {one}").replace("while another", "while slowly another").replace("leaves Lyon", f"leaves {two}")
    docs = spark.createDataFrame([(1, "So " + halves("Milan", "Milan")), (2, "So " + halves("Milan", "Turin"))], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.matches(docs, items, coverage=0.01).collect()}
    assert got[1].coverage > 0.7
    assert got[2].n_found < 0.7 * got[1].n_found  # only the half that holds more


def _windows_brute(text, item):
    """Share of the item's windows that the text holds word for word at one distance, slots aside: for texts without slots."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    a, b = words(text), words(item)
    places = {p for p in range(len(b) - 4) for q in range(len(a) - 4) if a[q : q + 5] == b[p : p + 5]}
    return len(places), max(len(b) - 4, 0)


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(9)
    draw = lambda n: " ".join(f"w{chr(97 + x // 26)}{chr(97 + x % 26)}" for x in rng.integers(0, 300, n))
    items = [(k, draw(int(n))) for k, n in enumerate(rng.integers(3, 30, 20))]
    texts = []
    for d in range(60):
        words = items[d % 20][1].split()
        lo = int(rng.integers(0, max(len(words) // 2, 1)))
        part = words[lo : lo + int(rng.integers(3, 30))]
        for _ in range(int(rng.integers(0, 3))):
            part.insert(int(rng.integers(0, len(part) + 1)), "other")
        texts.append((d, draw(20) + " " + " ".join(part) + " " + draw(20)))
    want = set()
    for d, t in texts:
        for k, i in items:
            found, total = _windows_brute(t, i)
            if found and found >= total / 2:
                want.add((d, k, total, found))
    got = decontaminate.matches(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert set(rows(got, "doc_id", "item_id", "n_windows", "n_found")) == want and len(want) > 10


def test_decontamination_keeps_texts_of_one_id_apart(spark, tmp_path):
    item = "a train leaves Paris at 9 and drives far to Lyon while another leaves Lyon at 10 and meets it there"
    half, rest = item[:44], item[44:]
    texts = [
        (None, "So " + item), (None, "So " + item.replace("Lyon", "Milan")), (None, "a clean text without an id that stays"), (None, None),
        (7, "So " + item), (7, "another text of the same id stays"), (8, "So " + half), (8, " ".join(["So"] + ["word"] * len(half.split())) + rest),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert rows(decontaminate.matches(docs, items), "doc_id", "n_slots") == [(7, 4), (None, 4), (None, 4)]
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(i, t) for i, t in texts if i == 8 or not t or "train" not in t]
    assert rows(decontaminate.stage(spark, docs, str(tmp_path)), "doc_id", "text") == sorted(kept, key=repr)


def test_decontamination_by_shuffle_gives_the_same(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, PASSAGE), (2, LINE)], "item_id long, text string")
    want = rows(decontaminate.matches(docs, items), "doc_id", "item_id", "n_found")
    monkeypatch.setattr(decontaminate, "MOST_WINDOWS", 0)
    assert rows(decontaminate.matches(docs, items), "doc_id", "item_id", "n_found") == want and len(want) >= 4


def test_samples(spark, docs, empty):
    got = sample_encode.decode(sample_encode.sample_encodings(docs, MODEL, 3), MODEL).collect()
    texts = defaultdict(set)
    for i, t in TEXTS:
        texts[i].add(t or "")
    by = defaultdict(list)
    for r in got:
        assert r.text in texts[r.doc_id] and 0 <= r.inclusion <= 1 and r.log_inclusion <= 0 and r.n_pieces * 4 == len(r.ids)
        by[r.doc_id, r.text].append(r)
    for (i, text), found in by.items():
        copies = sum((j, t or "") == (i, text) for j, t in TEXTS)
        assert len({bytes(r.ids) for r in found}) * copies == len(found)  # distinct, and the same for equal rows
        if not text:
            assert [(r.n_pieces, r.inclusion) for r in found] == [(0, 1.0)]
        values = [r.perturbed for r in sorted(found, key=lambda r: r.rank)][:: max(copies, 1)]
        assert values == sorted(values, reverse=True)
    assert sample_encode.sample_encodings(empty, MODEL).count() == 0


def test_samples_of_one_very_long_word(monkeypatch):
    rng = np.random.default_rng(6)
    word = "".join(rng.choice(list("etaoinshr"), 3000))
    table = sample_encode.lattice(MODEL)
    take = lambda text: [(f[0].tolist(), f[1]) for f in sample_encode.top_k([text], np.array([5], np.uint64), table, 2)[0][0]]
    want = take(word)
    table.clear()
    monkeypatch.setattr(sample_encode, "ABREAST", 100)  # most of the word goes one by one
    got = take(word)
    assert [x[0] for x in got] == [x[0] for x in want] and all(math.isclose(x[1], y[1], rel_tol=1e-9) for x, y in zip(got, want))
    table.clear()
    began = time.process_time()
    (ids, _), _ = take(word * 100)
    assert sample_encode.spell(sample_encode.surfaces(MODEL), np.array(ids, "<i4").tobytes()) == word * 100
    assert time.process_time() - began < 60
    table.clear()


def test_lattices_share_the_ends_of_words(monkeypatch):
    table = sample_encode.lattice(MODEL)
    table.clear()
    words = [f" {a}{b}" for a in ("walk", "talk", "stalk", "chalk") for b in ("ing", "ed", "er", "s")]
    starts = table.states_of(words)
    ends = {w[i:] for w in words for i in range(len(w))}
    assert len(set(starts.tolist())) == len(words) and table.states == len(ends)  # a state for each character of each word before
    texts = ["".join(words), "ends of walking, \n\n \u2581 talk\u00e9 \U0001f600ing\x00 ", "", " ", "\n", "x" * 70 + "alking " + "y" * 70 + "alking"]
    points, sizes, lanes = sample_encode.split(texts)
    want = [token_counts.pre_tokens(t) for t in texts]
    assert lanes.tolist() == list(map(len, want)) and sizes.tolist() == [len(t) for row in want for t in row]
    assert "".join(map(chr, points.tolist())) == "".join(t for row in want for t in row).replace(" ", "\u2581")
    take = lambda: [[(f[0].tolist(), f[1], f[2]) for f in found] for found, _ in sample_encode.top_k(texts, np.arange(len(texts), dtype=np.uint64), table, 2)]
    beside = take()
    for bound, size in (("SHARED", 0), ("SHARED", 3), ("MOST_EDGES", -1)):  # nothing shared, short ends, tables made anew
        table.clear()
        monkeypatch.setattr(sample_encode, bound, size)
        assert take() == beside
    table.clear()


def test_samples_have_the_lattice_probabilities():
    table = sample_encode.lattice(MODEL)
    text = "their a"

    def ways(token):
        out, todo = [], [(int(table.states_of([token])[0]), (), 0.0)]
        while todo:
            state, path, log = todo.pop()
            if state < 0:
                out.append((path, log))
                continue
            for e in range(table.first[state], table.first[state + 1]):
                todo.append((int(table.target[e]), (*path, int(table.piece[e])), log + table.log[e]))
        return out

    every = {p + q: a + b for p, a in ways(" their") for q, b in ways(" a")}
    assert abs(sum(map(math.exp, every.values())) - 1) < 1e-9
    n = 20_000
    found = sample_encode.top_k([text] * n, S.mix(np.arange(n, dtype=np.uint64)), table, 3)
    first = Counter(tuple(f[0][0].tolist()) for f, _ in found)
    for way, log in every.items():
        assert abs(first[way] / n - math.exp(log)) < 0.015
    # Horvitz-Thompson: inclusion scores make the sampled mass come out as 1.
    mass = [sum(math.exp(log) / -math.expm1(-math.exp(log - after)) for _, log, _ in f) for f, after in found]
    assert abs(np.mean(mass) - 1) < 0.01
