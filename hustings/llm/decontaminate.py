"""Benchmark decontamination by template windows and slot consistency."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import boxed, fits_broadcast, narrow, read, settled, unboxed

#: Words to a window, and the fewest of them that are words and not slots.
WINDOW, LITERALS = 5, 3
#: Share of a benchmark item's windows that a document must hold.
COVERAGE = 0.5
#: Most benchmark windows that are sent to every task; beyond it windows are joined by shuffle.
MOST_WINDOWS = 100_000
#: Private-use characters that mark the type of a slot.
NAME, UNIT, NUMBER = "\ue000", "\ue001", "\ue002"
#: Marks a capitalised word that may be a name or only begins a sentence.
START = "\ue003"
#: Units that count as slots behind a number (fixed values).
UNITS = (
    "mm", "cm", "m", "km", "g", "kg", "mg", "l", "ml", "s", "min", "h", "ms", "inch", "inches", "feet", "foot", "yards", "miles", "mile",
    "metres", "meters", "grams", "litres", "liters", "pounds", "ounces", "seconds", "minutes", "hours", "days", "weeks", "months", "years",
    "dollars", "euros", "cents", "percent", "degrees",
)

#: A capitalised word; behind a word or comma, so not at the start of a sentence, it is a name.
_CAPITAL = rf"\p{{Lu}}(?<![\p{{L}}\p{{N}}{UNIT}]\p{{Lu}})[\p{{L}}'-]*+"
_NAME = rf"{START}(?<=[\p{{L}}\p{{N}},;:] {START})"
_UNIT = rf"([0-9] ?)((?iu:{'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))}))(?![\p{{L}}\p{{N}}])"
_GAP = rf"[^\p{{L}}\p{{N}}{NAME}{UNIT}{START}]++"
_WORD = rf"[\p{{L}}\p{{N}}{NUMBER}]++"


def templates(docs: DataFrame) -> DataFrame:
    """Adds ``raw``, the words of ``text``, and the same words in each of ``READINGS``, with typed
    slots.  Words are lower-cased; punctuation and spacing don't count.  All four have one
    length; a text without words has one empty word.

    ``form`` has slots for names, units and numbers.  ``start`` has them also for capitalised
    words at the start of a sentence, line or quotation, which may be names.  ``plain`` doesn't
    look at letter case: it has slots for units and numbers only, so that a text in other case
    reads the same.
    """
    names = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", _UNIT, f"$1{UNIT}$2"), _CAPITAL, f"{START}$0"), _NAME, NAME)
    without = lambda c, *marks: functools.reduce(lambda x, m: F.replace(x, F.lit(m), F.lit("")), marks, c)
    words = lambda c: F.split(c, " ")
    marked, slots, named = F.col("marked"), F.col("slots"), F.col("named")
    return (
        docs.withColumn("marked", F.trim(F.regexp_replace(F.lower(F.upper(names)), _GAP, " ")))
        .withColumn("slots", F.regexp_replace(F.regexp_replace("marked", "[0-9]++", NUMBER), rf"{UNIT}\p{{L}}++", UNIT))
        .withColumn("named", F.regexp_replace("slots", f"{NAME}{_WORD}", NAME))
        .withColumn("raw", words(without(marked, NAME, UNIT, START)))
        .withColumn("form", words(without(named, START)))
        .withColumn("start", words(F.regexp_replace(named, rf"{START}(?:{_WORD}|{UNIT})++", NAME)))
        .withColumn("plain", words(without(slots, NAME, START)))
        .drop("marked", "slots", "named", "text")
    )


#: How a text is read; ``form`` comes first, it has a say in the others.
READINGS = ("form", "start", "plain")


def _at(words: Column | str) -> Column:
    """The window of ``words`` at ``place``."""
    return F.slice(words, F.col("place") + 1, WINDOW)


def _reading() -> Column:
    """The words in the reading that ``kind`` names.

    Kept short on purpose: a generated method of over 8000 bytes is never compiled.
    """
    return F.when(F.col("kind") == 0, F.col(READINGS[0])).when(F.col("kind") == 1, F.col(READINGS[1])).otherwise(F.col(READINGS[2]))


def _beside(words: Column) -> Column:
    """What stands before the window, backwards, and behind it: as many words as share a window with it."""
    place, n = F.col("place"), WINDOW - 1
    before = F.reverse(F.slice(words, F.greatest(place - n + 1, F.lit(1)), F.least(place, F.lit(n))))
    return F.array(before, F.slice(words, place + 1 + WINDOW, n))


def _pairs(item_raw: Column, item_form: Column, raw: Column, form: Column) -> Column:
    """Words of the item and of the text side by side, as far as their templates agree."""
    both = F.arrays_zip(item_raw.alias("theirs"), item_form.alias("item_form"), raw.alias("ours"), form.alias("form"))
    differ = F.array_position(F.transform(both, lambda z: F.coalesce(z["item_form"] == z["form"], F.lit(False))), False)
    return F.slice(both, 1, F.when(differ == 0, F.size(both)).otherwise(differ - 1).cast("int"))


def windows_of(rows: DataFrame, *others: str) -> DataFrame:
    """A row for each window and reading: place, kind (of ``READINGS``), hash, the readings and ``others``."""
    n = F.size("form")
    codes = F.when(n >= WINDOW, F.sequence(F.lit(0), (n - WINDOW) * len(READINGS) + len(READINGS) - 1)).otherwise(F.array().cast("array<int>"))
    at = rows.select(*others, "raw", *READINGS, F.explode(codes).alias("code"))
    at = at.select("*", F.expr(f"code div {len(READINGS)}").cast("int").alias("place"), (F.col("code") % len(READINGS)).alias("kind")).drop("code")
    return at.withColumn("hash", F.xxhash64(_at(_reading())))


def _is_slot(word: Column) -> Column:
    return word.rlike(f"[{NAME}{UNIT}{NUMBER}]")


def _usable(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: ~_is_slot(w))) >= LITERALS


def _cut() -> list[Column]:
    """The window at ``place`` and what stands beside it, as they are and in the reading that ``kind`` names."""
    return [_at("raw").alias("raw"), _at(_reading()).alias("form"), _beside(F.col("raw")).alias("raw_beside"), _beside(_reading()).alias("form_beside")]


def benchmark_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """hash, item, place, kind, raw, form, raw_beside, form_beside, usable, n_windows of each window with enough words in it.

    ``kind`` is the place of its reading in ``READINGS``, ``form`` its words there;
    ``usable`` has a bit for each reading in which this place has enough words, and
    ``n_windows`` the count of such places, by reading.
    """
    rows = windows_of(templates(narrow(items, item_col, text_col).withColumnRenamed("doc_id", "item")), "item")
    rows = rows.where((F.col("kind") == 0) | (_at(_reading()) != _at("form")))  # what two readings share counts once
    bits = sum((F.when(_usable(_at(x)), F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(READINGS)), F.lit(0))
    spread = rows.select("item", "place", "kind", "hash", *_cut(), bits.alias("usable"))
    counts = spread.groupBy("item").agg(
        F.array(*(F.countDistinct(F.when(F.col("usable").bitwiseAND(F.lit(1 << i)) > 0, F.col("place"))) for i in range(len(READINGS)))).alias("n_windows")
    )
    return spread.where(_usable(F.col("form"))).join(counts, "item").dropDuplicates(["item", "place", "kind", "hash"])


def _one_to_one(slots: Column) -> Column:
    n = F.size(slots)
    return (F.size(F.array_distinct(F.transform(slots, lambda s: s["theirs"]))) == n) & (F.size(F.array_distinct(F.transform(slots, lambda s: s["ours"]))) == n)


def matches(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows, n_found, coverage, n_slots of documents that hold an item.

    A document is an id with its text: rows without an id, or of one id, are apart where
    their texts differ.

    Windows of ``WINDOW`` words are joined by hash and then by the words, in each of
    ``READINGS``.  Windows at one distance (place in the document less place in the
    item) belong together; their slots must map one to one: a name, unit or number
    of the item stands for the same thing throughout, and different ones for
    different things.  Where the slots of ``form`` don't, the distance is left out;
    where those of another reading don't agree, this reading is.  The distance with most
    places comes first, and one whose slots contradict those before it stays out, so that
    words put in between can't give a slot two meanings.  Places that are left must cover
    the share ``coverage`` of the item's windows in one of the readings (the figures are
    those of the reading that is covered best).  Names changed in a text that has lost its
    letter case can't be seen as names.

    Null, empty and short texts match nothing, nor do items of fewer than
    ``WINDOW`` words.  Rows that repeat a document give one row for each item; where
    either table is empty there are no rows.  A very long text has three windows a word,
    read off one by one.
    """
    return _matches(docs, items, coverage, id_col, text_col).drop("text_key")


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _matches(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``matches`` returns, and ``text_key``, which tells texts of one id apart."""
    windows = settled(benchmark_windows(items))
    small = fits_broadcast(windows, MOST_WINDOWS)
    rows = templates(narrow(docs, id_col, text_col).withColumn("text_key", _text_key(F.col("text"))))
    found = windows_of(rows, "doc_id", "text_key")
    keys = ["doc_id", "text_key", "place", "kind", "hash"]
    theirs = windows.select("hash", "item", "usable", "n_windows", *(F.col(c).alias(f"item_{c}") for c in ("kind", "place", "raw", "form", "raw_beside", "form_beside")))
    # A broadcast table is looked up as windows are read off, and words are cut out of the few that
    # are found; a shuffle has to carry the words, and not the texts.
    if small:
        hits = found.join(F.broadcast(theirs), "hash").select(*keys, *theirs.columns[1:], *_cut())
    else:
        hits = found.select(*keys, *_cut()).join(theirs, "hash")
    hits = hits.where(F.col("form") == F.col("item_form"))
    # Pairs of what fills a slot in the item and in the document, also beside the window: words put
    # in elsewhere must not hide a slot that is there to see.
    sides = [_pairs(*(F.col(c)[k] for c in ("item_raw_beside", "item_form_beside", "raw_beside", "form_beside"))) for k in (0, 1)]
    filled = F.filter(F.concat(_pairs(*map(F.col, ("item_raw", "item_form", "raw", "form"))), *sides), lambda z: _is_slot(z["form"]))
    slots = F.transform(filled, lambda z: F.struct(z["theirs"].alias("theirs"), z["ours"].alias("ours")))
    apart = hits.select(
        "doc_id", "text_key", "item", "n_windows", F.struct("item_place", "usable").alias("at"), (F.col("place") - F.col("item_place")).alias("shift"), slots.alias("slots"),
        F.greatest("kind", "item_kind").alias("kind"),
    )
    aggs = []
    for k in range(len(READINGS)):
        mine = F.col("kind") == k
        aggs += [F.collect_set(F.when(mine, F.col("at"))).alias(f"places_{k}"), F.array_distinct(F.flatten(F.collect_set(F.when(mine, F.col("slots"))))).alias(f"slots_{k}")]
    readings = apart.groupBy("doc_id", "text_key", "item", "shift").agg(F.first("n_windows").alias("n_windows"), *aggs).where(_one_to_one(F.col("slots_0")))
    places, filling = F.col("places_0"), F.col("slots_0")
    for k in range(1, len(READINGS)):
        fits = _one_to_one(F.array_union(filling, F.col(f"slots_{k}")))
        places = F.when(fits, F.array_union(places, F.col(f"places_{k}"))).otherwise(places)
        filling = F.when(fits, F.array_union(filling, F.col(f"slots_{k}"))).otherwise(filling)
    # The distance that holds most comes first; those whose slots contradict what is held already stay out.
    state = lambda p, f: F.struct(p.alias("places"), f.alias("filling"))
    nothing = state(F.slice(F.col("parts")[0]["places"], 1, 0), F.slice(F.col("parts")[0]["filling"], 1, 0))

    def held(so_far: Column, part: Column) -> Column:
        both = F.array_union(so_far["filling"], part["filling"])
        return F.when(_one_to_one(both), state(F.array_union(so_far["places"], part["places"]), both)).otherwise(so_far)

    part = F.struct((-F.size("places")).alias("order"), "shift", "places", "filling")
    united = (
        readings.select("doc_id", "text_key", "item", "n_windows", "shift", places.alias("places"), filling.alias("filling"))
        .groupBy("doc_id", "text_key", "item")
        .agg(F.first("n_windows").alias("n_windows"), F.array_sort(F.collect_list(part)).alias("parts"))
        .withColumn("held", F.aggregate("parts", nothing, held))
        .select("doc_id", "text_key", "item", "n_windows", F.col("held.places").alias("places"), F.size("held.filling").alias("n_slots"))
    )

    def share(i: int) -> Column:
        total = F.get("n_windows", F.lit(i))
        n_found = F.size(F.filter("places", lambda p: p["usable"].bitwiseAND(F.lit(1 << i)) > 0)).cast("long")
        return F.struct(F.when(total > 0, n_found / total).otherwise(F.lit(0.0)).alias("coverage"), n_found.alias("n_found"), total.alias("n_windows"))

    best = united.select("doc_id", "text_key", F.col("item").alias("item_id"), F.array_max(F.array(*map(share, range(len(READINGS))))).alias("best"), "n_slots")
    return best.where((F.col("best.n_found") > 0) & (F.col("best.n_found") >= F.col("best.n_windows") * coverage)).select(
        "doc_id", "item_id", "best.n_windows", "best.n_found", "best.coverage", "n_slots", "text_key"
    )


def stage(spark, docs, sf_dir):
    """Documents that hold a benchmark item go; other texts of the same id, or without one, stay.

    Null, empty and short texts stay, as do all where the benchmark is empty; rows that
    repeat a document go or stay together; very long texts are searched whole; other
    columns can have any name.
    """
    leaked = _matches(docs, read(spark, sf_dir, "benchmark")).select("doc_id", "text_key").distinct()
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (_text_key(F.col("row.text")) == F.col("text_key"))
    return unboxed(boxed(docs).join(leaked, same, "left_anti"))


def query(spark, sf_dir):
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
