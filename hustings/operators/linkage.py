"""Record linkage: block, score, pick, guard, report."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hustings.functions import names as N
from hustings.functions.base import let
from hustings.operators.contests import percent
from hustings.operators.ratios import best_ratios


#: Rows, and bytes of them, up to which a side is sent to every task instead of being shuffled.
SMALL, SMALL_BYTES = 200_000, 32 << 20


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if it is proven to have at most ``most`` rows of ``SMALL_BYTES`` in all (as JSON)."""
    row = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    seen = df.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if seen.n <= most and seen.bytes <= SMALL_BYTES else df


def tasks(spark: SparkSession) -> int:
    """Tasks for work that is heavy for its bytes, where partitions must not be put together by size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def first_by(df: DataFrame, keys, *order, only: Column | None = None) -> DataFrame:
    """The first row of each key in the given order, of those for which ``only`` holds."""
    first = df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth = 1")
    return (first if only is None else first.where(F.when(F.col("__nth") == 1, only))).drop("__nth")


#: Characters of the stretches by which texts are looked up in others; shorter texts are looked up whole.
STRETCH = 6


def _stretches(c: Column, n: Column) -> Column:
    """Every stretch of ``n`` characters of a text, once each."""
    at = F.sequence(F.lit(1), F.length(c) - n + 1)
    return F.when(n == 0, F.array(F.lit(""))).when(F.length(c) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(c, i, n)))).otherwise(F.array().cast("array<string>"))


def containing(holders: DataFrame, held: DataFrame) -> DataFrame:
    """(holder, held): distinct texts of which the first holds the second; both sides have one column ``t``.

    What is held is looked up by that of its stretches that the fewest holders have, so
    texts that only begin alike, or share any common part, don't meet.  Stretches of
    holders are worked out only in the lengths that are looked up (seven at most).
    """
    held = held.where("t is not null").distinct().withColumn("n", F.least(F.length("t"), F.lit(STRETCH)))
    holders = holders.where("t is not null").distinct()
    sizes = [r.n for r in held.select("n").distinct().collect()]
    every = F.array(*map(F.lit, sizes)).cast("array<int>")
    spread = holders.select(F.col("t").alias("holder"), F.explode(F.flatten(F.transform(every, lambda n: _stretches(F.col("t"), n)))).alias("g"))
    frequent = spread.groupBy("g").agg(F.count("*").alias("n_holders"))
    asked = held.select(F.col("t").alias("held"), F.explode(_stretches(F.col("t"), F.col("n"))).alias("g"))
    rarest = asked.join(frequent, "g", "left").groupBy("held").agg(F.min(F.struct(F.coalesce("n_holders", F.lit(0)).alias("n"), F.col("g").alias("g"))).alias("least"))
    looked_up = rarest.where("least.n > 0").select("held", F.col("least.g").alias("g"))
    return looked_up.join(spread, "g").where(F.contains("holder", F.col("held"))).select("holder", "held")


def held_within(holders: DataFrame, held: DataFrame) -> DataFrame:
    """(stem, holder, held): texts of one ``stem`` of which the first holds the second.

    Both sides are distinct rows (stem, text) without empty texts.  What is held is
    looked up by that of its first, middle and last stretch that the fewest holders of
    its stem have; stretches of holders that nothing asks for go as early as they can.
    """
    asked = held.withColumn("n", F.least(F.length("held"), F.lit(STRETCH)))
    sizes = F.array(*map(F.lit, [r.n for r in asked.select("n").distinct().collect()])).cast("array<int>")
    last = F.length("held") - F.col("n") + 1
    some = F.array_distinct(F.transform(F.array(F.lit(1), F.floor((last + 1) / 2).cast("int"), last), lambda i: F.substring("held", i, F.col("n"))))
    looked = asked.select("stem", "held", F.explode(some).alias("g")).select(F.xxhash64("stem", "g").alias("h"), "stem", "held")
    spread = holders.select("stem", "holder", F.explode(F.flatten(F.transform(sizes, lambda n: _stretches(F.col("holder"), n)))).alias("g")).select(F.xxhash64("stem", "g").alias("h"), F.col("stem").alias("of"), "holder")
    spread = spread.join(small(looked.select("h").distinct(), 5 * SMALL), "h", "left_semi")
    frequent = spread.groupBy("h").agg(F.count("*").alias("n"))
    least = looked.join(frequent, "h").groupBy("stem", "held").agg(F.min(F.struct("n", "h")).alias("least"), F.count("*").alias("found"))
    # A stretch that no holder has leaves nothing to look up.
    wanted = least.join(asked.select("stem", "held", F.size(some).alias("all")), ["stem", "held"]).where("found = all").select("stem", "held", F.col("least.h").alias("h"))
    met = wanted.join(spread, "h").where((F.col("stem") == F.col("of")) & F.contains("holder", F.col("held")))
    return met.select("stem", "holder", "held").distinct()


def containment_pairs(left: DataFrame, l: str, right: DataFrame, r: str) -> DataFrame:  # noqa: E741
    """Pairs of rows of which one text holds the other, each pair once (an empty one is held by all)."""
    a, b = left.select(F.col(l).alias("t")), right.select(F.col(r).alias("t"))
    forward = containing(a, b).select(F.col("holder").alias("__l"), F.col("held").alias("__r"))
    backward = containing(b, a).select(F.col("held").alias("__l"), F.col("holder").alias("__r"))
    texts = forward.union(backward).distinct()
    return left.join(texts, F.col(l) == F.col("__l")).join(right, F.col(r) == F.col("__r")).select(*left.columns, *right.columns)


#: Letters whose counts bound a ratio; all others count together.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letter_counts(c: Column) -> Column:
    """How often each of ``LETTERS`` stands in a text, how many other characters, and all (a struct of numbers, so that sums of them are compiled)."""
    own = [F.length(c) - F.length(F.replace(c, F.lit(x))) for x in LETTERS]
    return F.struct(*(n.alias(f"n{k}") for k, n in enumerate(own)), (F.length(c) - sum(own[1:], own[0])).alias("other"), F.length(c).alias("all"))


def ratio_bound(a: Column, b: Column) -> Column:
    """No ratio is above twice the letters (``letter_counts``) that two texts have in common over all letters."""
    common = F.least(a["other"], b["other"])
    for k in range(len(LETTERS)):
        common = common + F.least(a[f"n{k}"], b[f"n{k}"])
    return 2 * common / F.nullif(a["all"] + b["all"], F.lit(0))


#: Names of one seat that meet in one task: candidates' and records'.
SEARCHED, SEARCHED_IN = 4096, 16384


def _best_of_block(above: float):
    """The best record name of each candidate name of one block of a seat, of equals the first record's."""

    def best(asked: pd.DataFrame, records: pd.DataFrame) -> pd.DataFrame:
        records = records.sort_values(["pos", "r_name"], ignore_index=True)
        at, ratio = best_ratios(asked["l_name"].tolist(), records["r_name"].tolist(), above) if len(asked) and len(records) else (np.empty(0, int), np.empty(0))
        hit = at >= 0
        won = records.iloc[at[hit]]
        return pd.DataFrame({"r_seat": won["r_seat"].to_numpy(), "l_name": asked["l_name"].to_numpy()[: len(at)][hit], "r_name": won["r_name"].to_numpy(), "pos": won["pos"].to_numpy(), "score": ratio[hit]})

    return best


def match_ground_truth(cands: DataFrame, truth: DataFrame, above: float = 0.70) -> DataFrame:
    """Best record of the same constituency for each candidate, or none.

    cands (id, name, constituency), truth (pos, name, constituency, cases).  Blocking
    is on pairs of distinct constituencies of which one contains the other.  Names that
    read alike are searched for once in each constituency of records, in blocks that
    are dealt out, so a large seat is spread over all tasks and no pair of names is a
    row anywhere (``ratios.py``).  Ties keep the first record.
    """
    spark = cands.sparkSession
    left = cands.where("id is not null").select("id", N.normalize_name("name").alias("l_name"), N.normalize_constituency("constituency").alias("l_seat")).where("l_name <> '' and l_seat <> ''")
    right = truth.select("pos", F.col("name").alias("truth_name"), N.normalize_name("name").alias("r_name"), N.normalize_constituency("constituency").alias("r_seat"), "cases").where("r_name <> ''")
    # Of records that read alike only the first can be the answer.
    records = right.groupBy("r_seat", "r_name").agg(F.min_by(F.struct("pos", "truth_name", "cases"), "pos").alias("record"))
    pairs = small(containment_pairs(left.select("l_seat").distinct(), "l_seat", right.select("r_seat").distinct(), "r_seat"))
    named = left.select("l_seat", "l_name").distinct().join(pairs, "l_seat")
    asked = named.select("r_seat", "l_name").distinct()
    blocks = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    sizes = small(
        asked.groupBy("r_seat").agg(F.count("*").alias("n_asked")).join(records.groupBy("r_seat").agg(F.count("*").alias("n_records")), "r_seat")
        .select("r_seat", blocks("n_asked", SEARCHED).alias("n_l"), blocks("n_records", SEARCHED_IN).alias("n_r"))
    )
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key, n = ["r_seat", "l_block", "r_block"], 4 * tasks(spark)
    l_blocks = asked.join(sizes, "r_seat").select("r_seat", "l_name", own("l_name", "n_l").alias("l_block"), every("n_r").alias("r_block")).repartition(n, *key)
    r_blocks = records.join(sizes, "r_seat").select("r_seat", "r_name", "record.pos", own("r_name", "n_r").alias("r_block"), every("n_l").alias("l_block")).repartition(n, *key)
    kind = right.schema["pos"].dataType.simpleString()
    found = l_blocks.groupBy(*key).cogroup(r_blocks.groupBy(*key)).applyInPandas(_best_of_block(above), f"r_seat string, l_name string, r_name string, pos {kind}, score double")
    # The best of a name in each constituency of records, then in all that its own one meets.
    first = F.min_by(F.struct("r_seat", "r_name", "score"), F.struct(-F.col("score"), F.col("pos"))).alias("won")
    best = named.join(found, ["r_seat", "l_name"]).groupBy("l_seat", "l_name").agg(first).select("l_seat", "l_name", "won.*").join(records, ["r_seat", "r_name"])
    of_id = left.join(best, ["l_seat", "l_name"]).groupBy("id").agg(F.min_by(F.struct("record", "score"), F.struct(-F.col("score"), F.col("record.pos"))).alias("won"))
    return cands.join(of_id.select("id", "won.record.*", F.round("won.score", 3).alias("score")), "id", "left")


def link_results(cands: DataFrame, results: DataFrame) -> DataFrame:
    """Results (contest, seat, winner) to candidates (id, pos, name, constituency).

    One candidate of the stem is taken; of several, the one whose name is in the
    winner's, or if none is, the one that the winner's name is in; it must be exactly
    one.  A candidate is taken once, by the first contest.  ``reason`` tells why a
    contest has none.  Winners meet only names of which one holds the other
    (``held_within``), so a stem's contests and candidates are no pairs.
    """
    left = results.select("contest", "seat", "winner", N.stem("seat").alias("stem"), N.alnum_key("winner").alias("w")).distinct()
    right = cands.select("id", N.stem("constituency").alias("stem"), N.alnum_key("name").alias("n"))
    seats = right.groupBy("stem").agg(F.count("id").alias("here"), F.min("id").alias("only"))
    named = right.where("n <> '' and id is not null").groupBy("stem", "n").agg(F.count("id").alias("k"), F.min("id").alias("id"))
    won = left.where("w <> ''").select("stem", "w").distinct()

    def met(holder: DataFrame, t: str, held: DataFrame, u: str, name: str) -> DataFrame:
        """How many candidates of a stem meet each winner's text, and the first of them."""
        pairs = held_within(holder.select("stem", F.col(t).alias("holder")), held.select("stem", F.col(u).alias("held")))
        texts = pairs.select("stem", F.col("holder").alias(t), F.col("held").alias(u))
        return texts.join(named, ["stem", "n"]).groupBy("stem", "w").agg(F.sum("k").alias(f"n_{name}"), F.min("id").alias(name))

    forward = met(won, "w", named, "n", "forward")
    # The other way round is asked only where no name stands in the winner's.
    reverse = met(named, "n", won.join(forward, ["stem", "w"], "left_anti"), "w", "reverse")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    picked = left.join(small(seats), "stem", "left").join(forward, ["stem", "w"], "left").join(reverse, ["stem", "w"], "left").select("contest", "seat", "winner", none("here"), "only", none("n_forward"), "forward", none("n_reverse"), "reverse")
    target = (
        F.when(F.col("here") == 1, F.col("only"))
        .when((F.col("here") > 1) & (F.col("n_forward") == 1), F.col("forward"))
        .when((F.col("here") > 1) & (F.col("n_forward") == 0) & (F.col("n_reverse") == 1), F.col("reverse"))
    )
    chosen = picked.select("contest", "seat", "winner", target.alias("target"), F.when(F.col("here") == 0, "no candidate").when(target.isNull(), "ambiguous").alias("reason"))
    return one_to_one(chosen)


def one_to_one(chosen: DataFrame, target: str = "target", order: str = "contest") -> DataFrame:
    """A target is used once, by the first row; later rows lose it and get a reason."""
    # Rows without a target are spread out by their own key instead of meeting as null.
    group = F.coalesce(F.col(target).cast("string"), F.concat(F.lit("-"), F.col(order).cast("string")))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order))
    late = F.col(target).isNotNull() & (F.col("__nth") > 1)
    return chosen.withColumn("__nth", nth).withColumns({"reason": F.when(late, "used already").otherwise(F.col("reason")), target: F.when(~late, F.col(target))}).drop("__nth")


def unmatched(linked: DataFrame, cands: DataFrame) -> DataFrame:
    """(side, key, reason) of contests and candidates that are left over."""
    contests = linked.where(F.col("target").isNull()).select(F.lit("contest").alias("side"), F.col("contest").cast("string").alias("key"), "reason")
    used = linked.where(F.col("target").isNotNull()).select(F.col("target").alias("id"))
    left = cands.join(used, "id", "left_anti").select(F.lit("candidate").alias("side"), F.col("id").cast("string").alias("key"), F.lit("no contest").alias("reason"))
    return contests.union(left)


def attach_previous(cands: DataFrame, previous: DataFrame, year: int) -> DataFrame:
    """The former winner and runner-up of each candidate's contest, and whether the winner is the same person.

    cands (contest, name), previous (contest, winner_name, winner_party, winner_votes, margin and, if it is there,
    runner_up_name, runner_up_party, runner_up_votes).  Two shared words of the cleaned names make the same person.
    """

    def words(c: str) -> Column:
        text = F.regexp_replace(F.col(c), r"(?i)\s+[S|D|W]/O\s+.*$", "")
        text = F.regexp_replace(F.lower(F.regexp_replace(text, r"\(.*?\)|@.*$", "")), r"[^a-z0-9\s]", "")
        return F.array_distinct(F.array_remove(F.split(F.trim(text), r"\s+"), ""))

    former = {"former_raw": F.col("winner_name"), "former_margin": F.col("margin"), "former_year": F.lit(year)}
    for role, out in (("winner", "former"), ("runner_up", "former_runner_up")):
        if f"{role}_name" in previous.columns:
            former |= {f"{out}_name": N.title_case(f"{role}_name"), f"{out}_party": N.party_short(f"{role}_party"), f"{out}_votes": F.col(f"{role}_votes")}
    joined = cands.join(previous.select("contest", *(c.alias(n) for n, c in former.items())), "contest", "left")
    again = F.coalesce(F.size(F.array_intersect(words("name"), words("former_raw"))) >= 2, F.lit(False))
    return joined.withColumn("reelected", again).drop("former_raw")


def attach_electors(cands: DataFrame, current: DataFrame, older: DataFrame) -> DataFrame:
    """Electors of the current year, else of the older one; turnout only for the current.

    cands (contest, polled, ...), both sources (contest, electors); 0 counts as missing.
    """
    fresh = current.where("electors > 0").select("contest", F.col("electors").alias("__new"))
    stale = older.where("electors > 0").select("contest", F.col("electors").alias("__old"))
    joined = cands.join(small(fresh), "contest", "left").join(small(stale), "contest", "left")
    return joined.withColumns({
        "electors": F.coalesce("__new", "__old"),
        "electors_source": F.when(F.col("__new").isNotNull(), "current").when(F.col("__old").isNotNull(), "older").otherwise("missing"),
        "turnout": F.when(F.col("__new").isNotNull(), percent(F.col("polled"), F.col("__new"))),
    }).drop("__new", "__old")


def cross_validate(web: DataFrame, official: DataFrame, slack: int = 50) -> DataFrame:
    """Web votes against official totals, with or without NOTA.  web (contest, votes),
    official (contest, polled, nota_votes)."""
    joined = web.join(official, "contest", "left")
    with_nota = F.abs(F.col("votes") - F.col("polled"))
    without = F.abs(F.col("votes") - (F.col("polled") - F.col("nota_votes")))
    note = (
        F.when(F.col("votes").isNull() | F.col("polled").isNull(), "not comparable")
        .when(with_nota <= slack, "matches")
        .when(without <= slack, "matches without NOTA")
        .otherwise(F.concat(F.lit("differs by "), F.least(with_nota, without).cast("string")))
    )
    return joined.withColumns({"valid": F.coalesce((with_nota <= slack) | (without <= slack), F.lit(False)), "note": note})


def apply_overrides(df: DataFrame, patches: DataFrame, value: str, key: Column, source: str = "source") -> DataFrame:
    """A manual value (key, ``value``) wins and changes the provenance to ``manual``."""
    manual = patches.select(F.col("key").alias("__key"), F.col(value).alias("__value"))
    joined = df.withColumn("__at", key).join(small(manual), F.col("__at") == F.col("__key"), "left")
    hit = F.col("__key").isNotNull()
    return joined.withColumns({value: F.when(hit, F.col("__value")).otherwise(F.col(value)), source: F.when(hit, "manual").otherwise(F.col(source))}).drop("__at", "__key", "__value")


def resolve_value(df: DataFrame, sources: list[tuple[str, str]], missing: str = "Not Found", value: str = "value") -> DataFrame:
    """The first source column that holds a value, and its name as the method."""
    good = lambda c: F.col(c).isNotNull() & (F.col(c) != missing) & (F.trim(c) != "")
    got, method = F.lit(missing), F.lit("failed")
    for c, label in reversed(sources):
        got, method = F.when(good(c), F.col(c)).otherwise(got), F.when(good(c), F.lit(label)).otherwise(method)
    return df.withColumns({value: got, "method": method})


def link_files(files: DataFrame, cands: DataFrame) -> DataFrame:
    """File (file) to candidate (id, pos, name): same key, else the first of which one key holds the other.

    The exact join takes nearly all; only what it leaves is looked up by containment.
    """
    left = files.select("file", F.lower(F.regexp_replace("file", r"\.pdf$", "")).alias("f"))
    right = cands.select("id", "pos", N.clean_key("name").alias("k")).where("k <> ''")
    # A key's last candidate answers to it exactly, its first one by containment.
    keyed = right.groupBy("k").agg(F.max_by("id", "pos").alias("last"), F.min_by("id", "pos").alias("id"), F.min("pos").alias("pos"))
    exact = left.join(keyed.select("last", "k"), F.col("f") == F.col("k")).select("file", F.col("last").alias("id"), F.lit("exact").alias("how"))
    rest = left.join(exact, "file", "left_anti")
    loose = containment_pairs(rest, "f", keyed.select("id", "pos", "k"), "k")
    return exact.union(loose.groupBy("file").agg(F.min_by("id", "pos").alias("id"), F.lit("contained").alias("how")))


#: Words of a filing row that are no part of a name (fixed values).
FILING_WORDS = (
    "party", "accepted", "telugu", "desam", "janasena", "independent", "congress", "yuvajana", "sramika", "rythu",
    "andhra", "pradesh", "national", "secular", "bharatiya", "janatha", "bahujan", "samaj", "status",
)


def by_length(words: Column) -> Column:
    """Words, the longest first, equal lengths by letter."""
    keyed = F.sort_array(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(keyed, lambda x: x["w"])


def token_score(target: Column, row: Column) -> Column:
    """(score, left): percent of a name's words that a row has, and the row's long words that the name hasn't.

    Words are given away one by one, those of the name longest first (equal lengths by
    letter; the original order of ties is not defined): a word takes its equal, else the
    first one still free of which one is the initial of the other.  No words, no score.
    """

    def give(state: Column, word: Column) -> Column:
        short = lambda w: ((F.length(w) == 1) & F.startswith(word, w)) | ((F.length(word) == 1) & F.startswith(w, word))
        taken = F.when(F.array_contains(row, word), word).otherwise(F.get(F.filter(state["free"], short), F.lit(0)))
        return F.struct(
            (state["hits"] + taken.isNotNull().cast("int")).alias("hits"),
            F.when(taken.isNull(), state["free"]).otherwise(F.array_remove(state["free"], F.coalesce(taken, F.lit("")))).alias("free"),
        )

    given = F.aggregate(by_length(target), F.struct(F.lit(0).alias("hits"), F.array_sort(row).alias("free")), give)
    foreign = lambda w: (F.length(w) > 3) & ~w.isin(*FILING_WORDS)
    none = (F.size(target) == 0) | (F.size(row) == 0)
    return let(given, lambda g: F.struct(
        F.when(none, F.lit(0.0)).otherwise(g["hits"] / F.size(target) * 100).alias("score"),
        F.when(none, F.lit(0)).otherwise(F.size(F.filter(g["free"], foreign))).alias("left"),
    ))


#: What a party's name holds in filings (fixed values).
FILING_PARTY = {"tdp": ("telugu desam",), "ysrcp": ("yuvajana", "ysr"), "bjp": ("bharatiya janata",), "jsp": ("janasena",), "inc": ("indian national congress",)}


def _first_shared(asked: Column, held: Column, key: Column) -> Column:
    """Whether ``key`` is the first of ``asked`` that ``held`` has: so pairs that share several meet once."""
    return F.get(F.filter(asked, lambda k: F.array_contains(held, k)), F.lit(0)) == key


def link_filings(rows: DataFrame, cands: DataFrame) -> DataFrame:
    """Filing rows (seat, pos, name_line, party_line, status) to candidates (id, name, alias, seat, party).

    Half of a name's words have to be in a row, so one of any half (and one more) is:
    rows and names of a seat meet by those words only, as they stand or as initials, and
    not each with each.  Names, rows and parties that read alike meet once in a seat,
    whoever bears them.
    """
    spark = cands.sparkSession
    squash = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\(.*?\)", ""), "[^a-zA-Z0-9]", ""))
    first = lambda w: F.substring(w, 1, 1)
    initial, starts = (lambda c: F.concat(F.lit("~"), c)), (lambda c: F.concat(F.lit("^"), c))
    listed = (
        rows.where(~F.lower(F.coalesce("status", F.lit(""))).rlike("rejected|withdrawn"))
        .select("seat", "pos", N.name_tokens("name_line").alias("row_words"), F.lower("party_line").alias("p_row"))
        .groupBy("seat", "row_words", "p_row").agg(F.min("pos").alias("pos"))  # of equal rows the first wins
    )
    wanted = cands.select("id", "seat", F.explode(F.array_compact(F.array("name", "alias"))).alias("who"), F.col("party").alias("p")).withColumn("words", N.name_tokens("who"))
    held = (
        listed.select("seat", "row_words").distinct()
        .withColumn("long", F.filter("row_words", lambda w: (F.length(w) > 3) & ~w.isin(*FILING_WORDS)))
        .withColumn("held", F.array_distinct(F.concat("row_words", F.transform(F.filter("row_words", lambda w: F.length(w) == 1), initial), F.transform("row_words", lambda w: starts(first(w))))))
        .withColumn("key", F.explode("held"))
    )
    asked = (
        wanted.select("seat", "words").distinct()
        .withColumn("initials", F.size(F.filter("words", lambda w: F.length(w) == 1)))
        .withColumn("probe", F.slice(by_length(F.col("words")), F.lit(1), F.floor(F.size("words") / 2).cast("int") + 1))
        .withColumn("asked", F.array_distinct(F.flatten(F.transform("probe", lambda w: F.concat(F.array(w, initial(first(w))), F.when(F.length(w) == 1, F.array(starts(w))).otherwise(F.array().cast("array<string>")))))))
        .withColumn("key", F.explode("asked"))
        .repartition(tasks(spark), "seat", "words", "key")
    )
    # Long words of a row are left over unless the name has them, or an initial for each.
    could = F.size(F.array_except("long", "words")) <= F.col("initials")
    met = held.join(asked, ["seat", "key"]).where(could & _first_shared(F.col("asked"), F.col("held"), F.col("key"))).select("words", "row_words")
    # What meets in several seats is scored once; who fits in a seat has met there.
    scored = met.distinct().repartition(tasks(spark), "words", "row_words").withColumn("s", F.explode(F.array(token_score(F.col("words"), F.col("row_words")))))  # exploded: the filter stays above
    fits = scored.where("s.score >= 50 and s.left = 0").select("words", "row_words", F.col("s.score").alias("score")).join(wanted.select("seat", "words").distinct(), "words")
    # Which parties fit which lines, once for each pair, null being one of them.
    lines, parties = listed.select("p_row").distinct(), wanted.select("p").distinct()
    known = F.lit(False)
    for code, signs in FILING_PARTY.items():
        known = known | ((squash(F.col("p")) == code) & F.col("p_row").rlike("|".join(signs)))
    judged = lines.crossJoin(small(parties)).withColumn("ps", token_score(N.name_tokens("p"), N.name_tokens("p_row")))
    same = ((F.col("ps.score") >= 50) & (F.col("ps.left") == 0)) | F.contains(squash(F.col("p_row")), squash(F.col("p"))) | known
    look_alike = F.contains(squash(F.col("p_row")), F.lit("jatiyajanasena")) & ~F.contains(squash(F.col("p")), F.lit("jatiya"))
    taken = judged.where(F.col("p_row").isNull() | (same & ~look_alike)).select(F.col("p_row").alias("line"), "p")
    by_party = listed.join(taken, F.col("p_row").eqNullSafe(F.col("line"))).groupBy("seat", "row_words", "p").agg(F.min("pos").alias("pos"))
    # The first row of each name and party of a seat, then of each candidate's names.
    order = F.min(F.struct("pos", (-F.col("score")).alias("less"))).alias("first")
    best = fits.join(by_party, ["seat", "row_words"]).groupBy("seat", "words", F.col("p").alias("of")).agg(order)
    own = wanted.join(best, ["seat", "words"]).where(F.col("p").eqNullSafe(F.col("of"))).groupBy("id", "seat").agg(F.min("first").alias("first"))
    return first_by(own, ["id"], F.asc("first")).select("id", "seat", "first.pos", (-F.col("first.less")).alias("score"))


def link_filings_weak(rows: DataFrame, cands: DataFrame) -> DataFrame:
    """One shared word of the name and the party's code in the party line will do.

    Lines and parties are judged once for each pair; of the rows of a seat that have a
    word and fit a party only the first is joined, so a candidate meets a row a word.
    """
    listed = (
        rows.select("seat", "pos", N.name_tokens("name_line").alias("a"), F.lower("party_line").alias("p_row")).where("p_row is not null")
        .groupBy("seat", "a", "p_row").agg(F.min("pos").alias("pos")).withColumn("key", F.explode("a"))
        .groupBy("seat", "key", "p_row").agg(F.min("pos").alias("pos"))
    )
    wanted = cands.select("id", "seat", N.name_tokens("name").alias("b"), F.lower("party").alias("p")).where("p is not null")
    fits = listed.select("p_row").distinct().crossJoin(small(wanted.select("p").distinct())).where(F.contains("p_row", F.col("p")))
    firsts = listed.join(fits, "p_row").groupBy("seat", "key", "p").agg(F.min("pos").alias("pos"))
    alike = wanted.select("seat", "b", "p").distinct().withColumn("key", F.explode("b"))
    best = alike.join(firsts, ["seat", "key", "p"]).groupBy("seat", "b", "p").agg(F.min("pos").alias("pos"))
    met = wanted.join(best, ["seat", "b", "p"])
    return met.groupBy("id").agg(F.min(F.struct("pos", "seat")).alias("first")).select("id", "first.seat", "first.pos")


def verify_identity(docs: DataFrame, cands: DataFrame) -> DataFrame:
    """Does a document's text (key, text) carry the expected name (key, name)?

    By the deponent line at the start, else by words of the name anywhere: two, or
    one of more than five letters.
    """
    text = N.clean_person_name("text")
    joined = docs.join(cands.select("key", "name"), "key").select("key", "name", text.alias("t"), F.array_distinct(F.array_remove(F.split(N.clean_person_name("name"), " "), "")).alias("words"))
    line = F.nullif(F.coalesce(F.nullif(F.regexp_extract("t", r"^(?:i|l)\s+([a-z\s]{3,100}?)\s+(?:son|daughter|wife|slo|dlo|wlo)\s+of", 1), F.lit("")), F.regexp_extract("t", r"deponent\s+([a-z\s]{3,100})", 1)), F.lit(""))
    joined = joined.withColumn("said", F.array_remove(F.split(F.coalesce(line, F.lit("")), r"\s+"), ""))
    near = F.filter("words", lambda p: F.array_contains("said", p) | F.exists("said", lambda f: (F.length(f) > 3) & (F.length(p) > 3) & (F.contains(f, p) | F.contains(p, f))))
    by_line = (F.size(near) >= 2) | ((F.size(near) == 1) & (F.length(F.get(near, F.lit(0))) > 4))
    anywhere = F.filter("words", lambda p: (F.length(p) >= 3) & F.contains("t", p))
    by_text = (F.size(anywhere) >= 2) | ((F.size(anywhere) == 1) & (F.length(F.get(anywhere, F.lit(0))) > 5))
    return joined.select("key", "name", (by_line | by_text).alias("verified"), F.when(by_line, "deponent").when(by_text, "text").otherwise("none").alias("how"))


def closest_option(keys: DataFrame, options: DataFrame) -> DataFrame:
    """Of the options that hold a key or are held by it, the nearest in length."""
    clean = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"\(.*?\)", ""), "[^a-zA-Z0-9]", ""))
    left = keys.select("key", clean(F.col("key")).alias("k"))
    # Of options that read alike only the first can be the answer.
    right = options.groupBy(clean(F.col("option")).alias("o")).agg(F.min_by("option", "pos").alias("option"), F.min("pos").alias("pos"))
    pairs = containment_pairs(left, "k", right, "o")
    return pairs.groupBy("key").agg(F.min_by("option", F.struct(F.abs(F.length("o") - F.length("k")), F.col("pos"))).alias("option"))


def missing_files(cands: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates without a stored document of their safe name."""
    return cands.withColumn("__f", F.concat(N.safe_name("name"), F.lit(".pdf"))).join(files.select(F.col("file").alias("__f")), "__f", "left_anti").drop("__f")


def attach_district(cands: DataFrame, dim: DataFrame) -> DataFrame:
    """District of a constituency; blank rows of the dimension don't count, the last of a key does."""
    table = first_by(dim.where("trim(constituency) <> '' and trim(district) <> ''").withColumn("__k", F.upper(F.trim("constituency"))), ["__k"], F.desc("pos"))
    return cands.withColumn("__k", F.upper("constituency")).join(small(table.select("__k", "district")), "__k", "left").drop("__k")


def lookup_seat(labels: DataFrame, cands: DataFrame) -> DataFrame:
    """Map label to candidate: equal, or equal without (SC)/(ST) on one side or both; the first wins."""
    bare = lambda c: F.trim(F.regexp_replace(F.upper(c), r"\s*\((?:SC|ST)\)\s*", ""))
    left = labels.select("label", F.upper(F.trim("label")).alias("u"), bare(F.col("label")).alias("b"))
    right = cands.select("id", "pos", F.upper(F.trim("constituency")).alias("cu"), bare(F.col("constituency")).alias("cb"))
    # The first candidate of each seat, so that a seat is one row in the joins, whatever it holds.
    firsts = {c: right.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("seat")).agg(F.min(F.struct("pos", "id")).alias("first")) for c in ("cu", "cb")}
    hits = [left.join(firsts[c], F.col(l) == F.col("seat")).select("label", F.lit(k).alias("rule"), "first.pos", "first.id") for k, (l, c) in enumerate((("u", "cu"), ("b", "cu"), ("u", "cb"), ("b", "cb")))]
    every = hits[0]
    for h in hits[1:]:
        every = every.union(h)
    return every.groupBy("label").agg(F.min(F.struct("rule", "pos", "id")).alias("first")).select("label", "first.id")


def report_context(reports: DataFrame, cands: DataFrame) -> DataFrame:
    """The value that a report disputes, as text; empty for other fields and unknown candidates.

    cands has education, profession, criminal_cases, age, dob, ministries (array of
    structs with name) and social_media (map).
    """
    full = lambda v: F.coalesce(v != "", F.lit(False))
    shown = {
        "education": F.col("education"), "profession": F.col("profession"), "criminal_cases": F.col("criminal_cases").cast("string"),
        "age": F.coalesce(F.nullif(F.col("age").cast("string"), F.lit("")), F.col("dob")),
        "ministries": F.array_join(F.transform("ministries", lambda m: m["name"]), ", "),
        "social_media": F.array_join(F.filter(F.map_values("social_media"), full), " / "),
    }
    values = cands.select(F.col("id").alias("candidate_id"), F.create_map(*(x for k, v in shown.items() for x in (F.lit(k), v))).alias("__v"))
    joined = reports.join(values, "candidate_id", "left")
    return joined.withColumn("disputed", F.coalesce(F.try_element_at("__v", F.col("field")), F.lit(""))).drop("__v")
