"""Language identification with hyperdimensional letter n-grams."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import narrow, read

#: Components of a vector, letters to an n-gram, and symbols (0: between words).
DIMENSION, GRAM, SYMBOLS = 512, 3, 64
#: Symbols of a-z; other letters share the rest by code point.
FIRST, LAST = ord("a"), ord("z")


@lru_cache(maxsize=4)
def letter_vectors(dimension: int = DIMENSION, seed: int = 7) -> np.ndarray:
    """GRAM x SYMBOLS x dimension: random signs, shifted once more for each place
    that a letter stands before the end of its n-gram."""
    base = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimension))
    return np.stack([np.roll(base, GRAM - 1 - place, axis=1) for place in range(GRAM)])


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint8)
    for low in range(0, 0x110000, 0x1000):
        for c in range(low, low + 0x1000):
            if chr(c).isalpha():
                table[c] = c - FIRST + 1 if FIRST <= c <= LAST else 27 + c % (SYMBOLS - 27)
    return table


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a text as numbers, and how often each occurs.

    Letters are lower-cased; a run of anything else is one gap, and n-grams that
    are all gaps don't exist.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _symbol_table()[points]
    symbols = symbols[(symbols != 0) | (np.concatenate([[1], symbols[:-1]]) != 0)] if len(symbols) else symbols
    if not symbols.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.concatenate([[0], symbols, [0]]).astype(np.int64)
    return np.unique((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], return_counts=True)


def bundle(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the bound vectors of the n-grams."""
    v = letter_vectors()
    bound = v[0][codes // (SYMBOLS * SYMBOLS)] * v[1][codes // SYMBOLS % SYMBOLS] * v[2][codes % SYMBOLS]
    return counts.astype(np.float32) @ bound.astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, vector: the bundle of all texts of a language (every row counts).

    A task adds up its n-gram counts by language and hands on one vector for each;
    those are as many as tasks and languages, whatever the rows are.  Rows with a
    null language teach nothing.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.col("lang").isNotNull())

    def learn(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, counts = grams(text)
                if lang not in sums:
                    sums[lang] = np.zeros(SYMBOLS**GRAM, np.int64)
                sums[lang][codes] += counts
        for lang, counted in sums.items():
            codes = np.flatnonzero(counted)
            total = np.zeros(DIMENSION)
            for at in range(0, len(codes), 8192):
                part = codes[at : at + 8192]
                total += bundle(part, counted[part])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSION), pa.array(range(DIMENSION), pa.int32()), pa.array(total.tolist(), pa.float64())], ["lang", "place", "value"])

    parts = rows.mapInArrow(learn, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    return parts.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("vector"))


def collect_model(protos: DataFrame) -> tuple[list[str], np.ndarray]:
    """Unit prototypes, a row for each language: as many as there are languages."""
    found = sorted(protos.collect(), key=lambda r: r.lang)
    matrix = np.array([r.vector for r in found], np.float32).reshape(len(found), DIMENSION)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return [r.lang for r in found], matrix / np.where(norms > 0, norms, 1)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", *extra: str, with_text: bool = False) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``n_grams`` for each row, and ``extra`` columns.

    The prediction is the language whose prototype has the largest cosine with the
    text's vector (ties: the first name); the score is that cosine, at least 0, and
    the margin its lead over the second.  Null texts, texts without letters, and all
    texts when nothing was learned are ``und`` with score 0.  Rows that repeat a text
    have one prediction; an empty table gives no rows; very long texts are counted
    whole, and bundled by their different n-grams, of which there are few.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = narrow(docs, id_col, text_col, *extra)
    others = [f.name for f in rows.schema if with_text or f.name != "text"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)

    def guess(batches):
        names, matrix = shared.value
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                codes, counts = grams(text)
                if not len(codes) or not names:
                    out.append(("und", 0.0, 0.0, int(counts.sum())))
                    continue
                vector = bundle(codes, counts)
                cosines = matrix @ vector / max(float(np.linalg.norm(vector)), 1e-9)
                best = int(np.argmax(cosines))
                second = float(np.max(np.delete(cosines, best), initial=-1.0))
                out.append((names[best], min(max(float(cosines[best]), 0.0), 1.0), float(cosines[best]) - second, int(counts.sum())))
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64())],
                [*others, "lang_pred", "score", "margin", "n_grams"],
            )

    return rows.mapInArrow(guess, f"{kinds}, lang_pred string, score double, margin double, n_grams long")


#: A text of this many n-grams or more is in no language that was learned if its score is below
#: such a share of what the texts that were held out from learning have in the middle (0.95 on the
#: tables here, where real texts begin at 0.45 and single words said over and over end at 0.34).
LONG, STRANGE = 200, 1 / 3


def strange_below(found: DataFrame, lang: str, id_col: str = "doc_id") -> float:
    """The score below which a long text is strange, from the held-out rows of ``found`` (see ``predict``) whose
    language was found: ``STRANGE`` of their median.  0 if there are none."""
    known = found.where(held_out(F.col(id_col)) & (F.col("n_grams") >= LONG) & (F.col("lang_pred") == F.col(lang)))
    middle = known.agg(F.percentile_approx("score", 0.5, 10_000).alias("m")).first().m
    return STRANGE * (middle or 0.0)


def stage(spark, docs, sf_dir):
    """Keep the documents in which a language is found.

    Texts without letters go (null and empty ones too), and texts of ``LONG`` n-grams
    or more that are as strange to every language as ``strange_below`` tells.  Shorter
    texts stay whatever their score, as a few words are like no prototype.  Very long
    texts are judged whole.  Rows that repeat a
    document share its fate, an empty table stays empty, columns can have any name.
    If nothing could be learned (no row has a language), all with letters stay.
    """
    model = collect_model(prototypes(docs.where(~held_out(F.col("doc_id")))))
    names = docs.columns
    places = {c: f"c{i}" for i, c in enumerate(names)}
    renamed = docs.toDF(*places.values())
    lang = places["lang"]
    bound = strange_below(predict(renamed.where(F.col(lang).isNotNull() & held_out(F.col(places["doc_id"]))), model, places["doc_id"], places["text"], lang), lang)
    found = predict(renamed, model, places["doc_id"], places["text"], *(p for c, p in places.items() if c not in ("doc_id", "text")), with_text=True)
    strange = (F.col("n_grams") >= LONG) & (F.col("score") < bound)
    kept = found.where((F.col("n_grams") > 0) & ~(strange & F.lit(bool(model[0]))))
    return kept.select(*(F.col(c if c in ("doc_id", "text") else p).alias(c) for c, p in places.items()))


def query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = collect_model(prototypes(docs.where(~held_out(F.col("doc_id")))))
    found = predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
