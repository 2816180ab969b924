"""Remove long byte strings that occur more than once, by suffix order."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm import shingles as S
from hustings.llm.common import narrow, read, released, settled, shuffle_parts
from hustings.llm.suffix_groups import suffix_order



class Unit(NamedTuple):
    """What windows are made of: places that hold ``size`` bytes each."""

    size: int
    #: Places of the seed of a window, then of the longer seeds that split hot groups; the
    #: last is the window itself, at which every group has one member.
    seeds: tuple[int, ...]
    #: Places that make one symbol of the sorted string.
    block: int

    def places(self, content: bytes) -> np.ndarray:
        return np.frombuffer(content, np.uint8 if self.size == 1 else np.uint64)


#: Words to a passage, and to the stretches that are sampled of it.
PASSAGE, STRETCH = 50, 25
#: Windows of 400 bytes, and of 50 words that are written as a 64-bit hash each.
BYTES, WORDS = Unit(1, (128, 264, 332, 400), 16), Unit(8, (STRETCH, 33, 41, PASSAGE), 2)
#: Different contexts of a seed beyond which it is split by longer seeds.
HOT = 512
#: Symbols that are sorted as one string.
STRING = 60_000

PLACE = "doc_id long, text_hash long, lo int, hi int, seed long, context long"


def _least_places(h: np.ndarray, w: int) -> np.ndarray:
    """For each ``w`` hashes in a row the place of the least, the first of equals (by all but 9 bits)."""
    n, at = len(h) - w + 1, np.arange(len(h))
    # The end of one block of w and the front of the next.
    key = (h & np.uint64(~511 & (1 << 64) - 1)) | (at % w).astype(np.uint64)
    padded = np.concatenate([key, np.full((-len(h)) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    front = np.minimum.accumulate(padded, axis=1).ravel()[w - 1 : w - 1 + n]
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    p = np.arange(n)
    first = (back >> np.uint64(9)) <= (front >> np.uint64(9))
    low = np.uint64(511)
    return np.where(first, p // w * w + (back & low).astype(np.int64), (p + w - 1) // w * w + (front & low).astype(np.int64))


def windows_by_seed(data: np.ndarray, window: int, seed: int):
    """Runs of windows that share their seed: (seed hash, place of the seed, lo, hi, prefix).

    The seed of a window is its least ``seed``-byte substring by hash, the first of
    equals: it depends on nothing but the window's bytes, so equal windows have
    equal seeds at equal distances.  Windows lo..hi (inclusive) share one.
    """
    c = S.prefix_hashes(data)
    at = np.arange(len(data) - seed + 1)
    h = S.span_hashes(c, at, at + seed)
    place = _least_places(h, window - seed + 1)
    lo = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    hi = np.append(lo[1:], len(place)) - 1
    return h[place[lo]], place[lo], lo, hi, c


def _contexts(texts: DataFrame, window: int, unit: Unit) -> DataFrame:
    """A row for each run of windows of each text: its place, seed and whole content, hashed."""

    def cut(batches):
        for batch in batches:
            row, los, his, seeds, contexts = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                data = unit.places(text)
                if len(data) < window:
                    continue
                seed, place, lo, hi, c = windows_by_seed(data, window, unit.seeds[0])
                row.append(np.full(len(lo), i))
                los.append(lo)
                his.append(hi)
                seeds.append(seed)
                contexts.append(_content(c, lo, hi, place, window))
            if row:
                row = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (los, his)), *(pa.array(np.concatenate(x).view(np.int64)) for x in (seeds, contexts))],
                    ["doc_id", "text_hash", "lo", "hi", "seed", "context"],
                )

    return texts.select("doc_id", "text_hash", "text").mapInArrow(cut, PLACE)


def _content(c, lo, hi, place, window):
    """Hash of all that the windows lo..hi hold, and of where the seed is in them."""
    return S.mix(S.span_hashes(c, lo, hi + window) ^ S.mix((place - lo).astype(np.uint64) + S.BASE))


def _weighed(contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated, open): contexts that occur twice as they are, and those that share a seed only.

    ``open`` holds what can still repeat in part: contexts that occur once, and one
    copy of each repeated context of their seeds (``copies`` > 1), with ``kinds``,
    the number of different contexts of the seed.  Everything is counted by partial
    aggregates and joined back, so that no key gathers its rows.
    """
    # What is joined by a seed is written first: so no aggregation holds a seed's rows together, and a
    # hot seed's side can be split.
    again = settled(contexts.groupBy("seed").agg(F.sum("copies").alias("all")).where("`all` > 1").select("seed"))
    shared = settled(contexts.join(again, "seed", "left_semi"))
    mark = F.xxhash64("doc_id", "text_hash", "lo")
    kinds = settled(shared.groupBy("seed", "context").agg(F.sum("copies").alias("copies"), F.min(mark).alias("mark")))
    mixed = settled(kinds.groupBy("seed").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).where("kinds > 1 and least = 1"))
    rows = shared.drop("copies").join(kinds, ["seed", "context"])
    repeated = rows.where("copies > 1")
    open_rows = rows.where((F.col("copies") == 1) | (F.col("mark") == mark)).drop("mark").join(mixed.drop("least"), "seed")
    return repeated, open_rows


def _with_bytes(texts: DataFrame, rows: DataFrame, window: int, unit: Unit) -> DataFrame:
    """``rows`` with ``bytes``, the content of their windows, cut from the texts once."""
    wanted = rows.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_list(F.struct("lo", "hi", "seed", "copies", "kinds")).alias("wanted"))
    joined = texts.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))

    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, mark, text, spans in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for s in {(s["lo"], s["hi"], s["seed"], s["copies"], s["kinds"]) for s in spans}:
                    for column, x in zip(out, (doc, mark, *s, text[s[0] * unit.size : (s[1] + window) * unit.size]), strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "text_hash", "lo", "hi", "seed", "copies", "kinds", "bytes"])

    return joined.select("doc_id", "text_hash", "text", "wanted").mapInArrow(cut, "doc_id long, text_hash long, lo int, hi int, seed long, copies long, kinds long, bytes binary")


def repeated_windows(parts: list[tuple[bytes, int, int]], window: int, unit: Unit) -> list[np.ndarray]:
    """For contexts (bytes, place of the seed, copies): which of their windows occur again among them.

    Equal windows stand alike to their seed, so contexts are cut into blocks that
    are aligned to it, each block is a symbol, and the suffixes of all contexts in
    one string are sorted.  Neighbours that agree in as many blocks as any window
    must hold form intervals; inside them the windows that end in the blocks' gaps
    are compared by 64-bit hashes of their whole content.
    """
    width = unit.block
    need = (window - width + 1) // width
    starts, pieces, owner, begin = [], [], [], []
    data = unit.places(b"".join(p[0] for p in parts))
    size = np.array([len(p[0]) // unit.size for p in parts])
    at = 0
    for k, (length, (_, place, _)) in enumerate(zip(size.tolist(), parts, strict=True)):
        off = place % width
        n = (length - off) // width
        starts.append(at)
        begin.append(at + off + width * np.arange(n))
        pieces.append(n)
        owner.append(np.full(n, k))
        at += length
    starts, begin, owner = np.array(starts), np.concatenate(begin), np.concatenate(owner)
    c = S.prefix_hashes(data)
    _, ranks = np.unique(S.span_hashes(c, begin, begin + width), return_inverse=True)
    # One string; each context ends in a symbol of its own, which matches nothing.
    string = np.zeros(len(begin) + len(parts), np.int64)
    to = np.arange(len(begin)) + owner
    string[to] = ranks + len(parts)
    ends = np.cumsum(np.array(pieces) + 1) - 1
    string[ends] = np.arange(len(parts))
    order = np.array(suffix_order(string.tolist()), np.int64)
    padded = np.concatenate([string, np.full(need, -1)])
    agree = np.ones(len(order) - 1, bool)
    for k in range(need):
        agree &= padded[order[1:] + k] == padded[order[:-1] + k]
    inside = np.concatenate([[False], agree]) | np.concatenate([agree, [False]])
    back = np.full(len(string), -1)
    back[to] = np.arange(len(begin))
    block = back[order[inside]]
    who = owner[block]
    gap = np.arange(width)
    first = begin[block][:, None] - gap  # of the windows whose first whole block this is
    fits = (first >= starts[who][:, None]) & (first + window <= (starts + size)[who][:, None])
    first, who = first[fits], np.repeat(who, width)[fits.ravel()]
    copies = np.array([p[2] for p in parts])
    content = S.span_hashes(c, first, first + window)
    _, same = np.unique(content, return_inverse=True)
    total = np.bincount(same, copies[who]) if len(same) else np.zeros(0)
    again = total[same] > 1 if len(same) else np.zeros(0, bool)
    found = [np.zeros(max(n - window + 1, 0), bool) for n in size]
    for k, p in zip(who[again].tolist(), (first - starts[who])[again].tolist(), strict=True):
        found[k][p] = True
    return found


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _sorted_groups(rows: DataFrame, window: int, unit: Unit) -> DataFrame:
    """Spans of the windows of single contexts that occur again in their seed's group.

    Groups are bounded (``HOT`` contexts); a task streams past them in order of the
    seed and sorts as many at once as make a string of about ``STRING`` symbols.
    """

    def sort(batches):
        held: list = []
        symbols = 0

        def flush():
            out: list[list] = [[], [], [], []]
            found = repeated_windows([(r[3], _seed_place(r[3], window, unit), r[4]) for r in held], window, unit)
            for (doc, mark, lo, _, copies), flags in zip(held, found, strict=True):
                if copies == 1:
                    for a, b in _runs(flags):
                        for column, x in zip(out, (doc, mark, lo + a, lo + b - 1 + window), strict=True):
                            column.append(x)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "text_hash", "start", "stop"])

        last = None
        for batch in batches:
            for doc, mark, lo, seed, copies, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seed != last and symbols > STRING:
                    yield flush()
                    held, symbols = [], 0
                held.append((doc, mark, lo, content, copies))
                symbols += len(content) // (unit.size * unit.block) + 1
                last = seed
        if held:
            yield flush()

    dealt = rows.select("doc_id", "text_hash", "lo", "seed", "copies", "bytes").repartition(shuffle_parts(rows.sparkSession), "seed").sortWithinPartitions("seed")
    return dealt.mapInArrow(sort, "doc_id long, text_hash long, start int, stop int")


def _seed_place(content: bytes, window: int, unit: Unit) -> int:
    """Where the seed is that all windows of a context share."""
    return int(windows_by_seed(unit.places(content), window, unit.seeds[0])[1][0])


def _split(rows: DataFrame, window: int, unit: Unit, seed_size: int) -> DataFrame:
    """The contexts of hot groups cut anew, by longer seeds; they carry their bytes along."""

    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, mark, lo, copies, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seed, place, a, b, c = windows_by_seed(unit.places(content), window, seed_size)
                whole = _content(c, a, b, place, window).view(np.int64).tolist()
                for s, x, y, w in zip(seed.view(np.int64).tolist(), a.tolist(), b.tolist(), whole, strict=True):
                    for column, v in zip(out, (doc, mark, lo + x, lo + y, s, w, copies, content[x * unit.size : (y + window) * unit.size]), strict=True):
                        column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "text_hash", "lo", "hi", "seed", "context", "copies", "bytes"])

    return rows.select("doc_id", "text_hash", "lo", "copies", "bytes").mapInArrow(cut, f"{PLACE}, copies long, bytes binary")


def repeated_spans(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, spans: byte spans of each text that repeated strings cover.

    A byte is in a span if a string of ``window`` bytes around it also starts
    anywhere else, in the same text (overlaps count) or in another row's.  Spans may
    overlap or repeat.  Texts without repeats have no row, nor have null and empty
    ones; rows that repeat an id are apart by their text's hash; an empty table gives
    no rows.  A very long text is read whole, in one batch.

    Windows are grouped by a seed that their bytes decide.  Most repeats show as
    contexts (runs of windows with one seed) that are equal as a whole; the rest, at
    the edges of repeated passages, is cut from the texts and put in suffix order,
    seed by seed.  A seed with many different contexts is split by longer seeds
    until its groups are small, at the latest when the seed is the whole window.
    """
    texts = narrow(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return _spans(texts, window, BYTES)


def _spans(texts: DataFrame, window: int, unit: Unit) -> DataFrame:
    """``repeated_spans`` of texts that are written in ``unit``; places are counted in it."""
    contexts = settled(_contexts(texts, window, unit)).withColumn("copies", F.lit(1).cast("long"))
    repeated, rest = _weighed(contexts)
    spans = lambda rows: rows.select("doc_id", "text_hash", F.col("lo").alias("start"), (F.col("hi") + window).alias("stop"))
    found = spans(repeated)
    rest = settled(_with_bytes(texts, rest, window, unit))
    for seed_size in unit.seeds[1:]:
        found = found.union(_sorted_groups(rest.where(F.col("kinds") <= HOT), window, unit))
        hot = rest.where(F.col("kinds") > HOT)
        if hot.isEmpty():
            break
        again, rest = _weighed(settled(_split(hot, window, unit, seed_size)))
        found = found.union(spans(again))
        rest = settled(rest)
    return found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_bytes, n_removed, n_spans and ``kept`` (the remaining bytes) of every row.

    A null text is empty; rows that repeat an id and text have one result each; an
    empty table gives no rows.
    """
    texts = narrow(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    marks = spans.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "spans")
    joined = texts.join(marks.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")

    def cut(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data, runs = text.encode(), []
                for a, b in sorted((s["start"], s["stop"]) for s in found or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for column, x in zip(out, (len(data), len(data) - len(kept), len(runs), kept), strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["doc_id", "text_hash", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.select("doc_id", "text_hash", "text", "spans").mapInArrow(cut, "doc_id long, text_hash long, n_bytes long, n_removed long, n_spans long, kept binary")


def _sampled(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the stretches sampled of some texts' words: of each ``PASSAGE`` words in a row that with the least hash."""
    left = np.searchsorted(text, text, "right") - np.arange(len(words))  # words to the end of the text
    full = np.flatnonzero(left >= PASSAGE)
    if not len(full):
        return full, np.zeros(0, np.uint64)
    c = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * S.powers(len(words))[0], out=c[1:])
    h = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
    begin = np.flatnonzero(left >= STRETCH)
    h[begin] = S.span_hashes(c, begin, begin + STRETCH)
    place = np.unique(_least_places(h, PASSAGE - STRETCH + 1)[full])
    return place, h[place]


def repeated_passages(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_passages: maximal runs of a text that 50 words in a row cover which also start anywhere else.

    Passages of more than fifty words may be shorter than the window in which bytes are
    removed; these are they, judged in the same way: overlaps count, and so do repeats
    inside one text.  Words are lower-cased and split at white space.  Only rows that are
    not ``known`` (doc_id, text_hash: those that lose bytes anyway) are asked about;
    whatever they share a passage with is looked at in all.

    Where no sampled stretch of 25 words (one of each 50 in a row, picked by hash)
    occurs twice, nothing can repeat.  What lies around the others, up to 50 words from
    their beginnings, is written as one 64-bit hash a word and goes the way of
    ``repeated_spans``: the same seeds and suffix order decide, over words instead of
    bytes, and nothing but whole passages that are equal counts.

    Texts without repeated passages have no row, nor have null, empty and shorter ones;
    rows that repeat an id are apart by their text's hash; a very long text is read in
    one batch; an empty table gives no rows.
    """
    texts = narrow(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")

    def sample(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for part in S.chunks(texts):
                words, text = S.words(texts[part])
                place, h = _sampled(words, text)
                at.append(text[place] + part.start)
                found.append(h)
            row, h = np.concatenate(at), np.concatenate(found)
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            # Two of a text's equal stretches say that they repeat; said over and over, each of its words begins one.
            keep = np.ones(len(row), bool)
            keep[2:] = (row[2:] != row[:-2]) | (h[2:] != h[:-2])
            counts = np.bincount(row[keep], minlength=len(texts))
            some = pa.array(np.flatnonzero(counts))
            grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts[counts > 0])]).astype(np.int32)), pa.array(h[keep].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), grams], ["doc_id", "text_hash", "grams"])

    # A row for each text, with all its stretches, so that no text is dealt to say which rows are known.
    lost = known.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct().withColumn("lost", F.lit(True))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    sampled = texts.select("doc_id", "text_hash", "text").mapInArrow(sample, "doc_id long, text_hash long, grams array<long>")
    samples = settled(sampled.join(lost.hint("shuffle_hash"), same, "left").select("doc_id", "text_hash", "grams", "lost"))
    again = settled(samples.select(F.explode("grams").alias("gram"), "lost").groupBy("gram").agg(F.count("*").alias("n"), F.count("lost").alias("n_lost")).where("n > 1 and n_lost < n").select("gram"))
    grams = samples.select("doc_id", "text_hash", F.explode("grams").alias("gram"))
    wanted = settled(grams.join(again, "gram", "left_semi").groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_set("gram").alias("grams")))
    del sampled, samples, again, grams
    released(docs.sparkSession)
    asked = texts.join(wanted.hint("shuffle_hash"), same)

    def around(batches):
        for batch in batches:
            out = []
            for doc, mark, text, grams in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                words, owner = S.words([text.encode()])
                place, h = _sampled(words, owner)
                place = place[np.isin(h.view(np.int64), np.array(grams, np.int64))]
                pieces, stop = [np.zeros(0, np.uint64)], -1
                for lo, hi in zip(np.maximum(place - (PASSAGE - STRETCH), 0).tolist(), np.minimum(place + PASSAGE, len(words)).tolist(), strict=True):
                    if lo > stop >= 0:  # no passage runs from one stretch of the text into another
                        pieces.append(S.mix(np.array([hash((doc, mark, lo)) & (1 << 63) - 1], np.uint64)))
                    pieces.append(words[max(lo, stop) : hi])
                    stop = max(hi, stop)
                out.append(np.concatenate(pieces).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "text_hash", "words"])

    coded = settled(asked.select("doc_id", "text_hash", "text", "grams").mapInArrow(around, "doc_id long, text_hash long, words binary"))
    released(docs.sparkSession)
    spans = _spans(coded.select("doc_id", "text_hash", F.col("words").alias("text")), PASSAGE, WORDS)
    runs = F.aggregate(
        F.sort_array("spans"), F.struct(F.lit(0).alias("n"), F.lit(-1).alias("stop")),
        lambda s, x: F.struct((s["n"] + (x["start"] > s["stop"]).cast("int")).alias("n"), F.greatest(s["stop"], x["stop"]).alias("stop")), lambda s: s["n"],
    )
    return spans.select("doc_id", "text_hash", runs.cast("long").alias("n_passages")).join(lost, same, "left_anti")


def query(spark, sf_dir):
    """The columns of the contract, then ``n_passages`` and ``n_repeats``.

    ``n_passages`` counts the repeated passages of fifty words of documents that lose no
    byte (they are shorter than 400 bytes); ``n_repeats`` is the sum of it and
    ``n_spans``, so it is above 0 where a document holds a repeat of either measure.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # Written, so that the contexts can go before the passages are looked for.
    spans = settled(repeated_spans(docs))
    released(spark)
    kept = settled(remove_spans(docs, spans).select("doc_id", "text_hash", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))
    del spans
    released(spark)
    passages = repeated_passages(docs, kept.where("n_removed > 0")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "n_passages")
    both = kept.join(passages, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left").withColumn("n_passages", F.coalesce("n_passages", F.lit(0)))
    return both.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", (F.col("n_spans") + F.col("n_passages")).alias("n_repeats"))
