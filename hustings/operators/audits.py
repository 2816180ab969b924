"""Audits, summaries, listings and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions.numbers import case_count


def validation_rows(matched: DataFrame) -> DataFrame:
    """Rows with ``count`` (ours) and ``cases`` (truth, null if unmatched) and their ``diff`` and ``tag``."""
    diff = F.col("count") - F.col("cases")
    tag = F.when(F.col("cases").isNull(), "unmatched").when(diff == 0, "match").when(F.abs(diff) <= 2, "within_2").otherwise("diff")
    return matched.withColumns({"diff": diff, "tag": tag})


def validation_summary(rows: DataFrame) -> DataFrame:
    """A5: one row of totals."""
    diff = F.col("diff")
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(diff.isNotNull()).alias("matched"),
        F.count_if(diff == 0).alias("exact"),
        F.count_if(F.abs(diff) <= 2).alias("within_2"),
        F.count_if(diff != 0).alias("discrepancies"),
        F.count_if(diff > 0).alias("overcounts"),
        F.count_if(diff < 0).alias("undercounts"),
        F.count_if(diff.isNull()).alias("unmatched"),
    )


def top_gaps(rows: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest over- and undercounts."""
    over = rows.where("diff > 0").orderBy(F.desc("diff"), F.asc("id")).limit(n).withColumn("side", F.lit("over"))
    under = rows.where("diff < 0").orderBy(F.asc("diff"), F.asc("id")).limit(n).withColumn("side", F.lit("under"))
    return over.union(under)


def worklist(rows: DataFrame) -> DataFrame:
    """Rows with a gap, widest first (``place`` is left to the reader's limit)."""
    return rows.where("diff <> 0").orderBy(F.desc(F.abs("diff")), F.asc("id"))


def integrity_rows(df: DataFrame, rule: str = "digits") -> DataFrame:
    """Published count (text) against gathered rows."""
    published = case_count("criminal_cases", rule)
    return df.withColumns({"published": published, "mismatch": published != F.col("gathered")})


def integrity_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"), F.count_if("mismatch").alias("mismatches"), F.sum("published").alias("published"), F.sum("gathered").alias("gathered")
    )


def index_summary(index: DataFrame) -> DataFrame:
    """Documents by status, by extraction method, and by style, in one pass."""
    sets = index.groupingSets([[F.col("status")], [F.col("extraction_method")], [F.col("style")]], "status", "extraction_method", "style")
    kind = F.when(F.grouping("status") == 0, "status").when(F.grouping("extraction_method") == 0, "extraction_method").otherwise("style")
    return sets.agg(kind.alias("kind"), F.count("*").alias("documents"), F.count_if("fallback").alias("fallbacks")).select(
        "kind", F.coalesce("status", "extraction_method", "style", F.lit("none")).alias("value"), "documents", "fallbacks"
    )


def source_counts(df: DataFrame, source: str = "source") -> DataFrame:
    """Rows by source; null is missing."""
    return df.groupBy(F.coalesce(source, F.lit("missing")).alias("source")).agg(F.count("*").alias("rows"))


def coverage(df: DataFrame, filled: dict[str, Column]) -> DataFrame:
    """Share of rows for which each condition holds, four decimals."""
    share = lambda c: F.round(F.count_if(c).cast("decimal(20,0)") / F.nullif(F.count("*"), F.lit(0)), 4).cast("double")
    return df.agg(F.count("*").alias("total"), *(share(c).alias(k) for k, c in filled.items()))


def value_audit(df: DataFrame, c: str = "profession", missing: str = "Not Found") -> DataFrame:
    """A10: rows verified, not found, and missing, with percent."""
    value = F.trim(F.coalesce(c, F.lit("")))
    label = F.when(value == "", "missing").when(value == missing, "not_found").otherwise("verified")
    counts = df.groupBy(label.alias("label")).agg(F.count("*").alias("rows"))
    whole = F.sum("rows").over(Window.partitionBy())  # three rows at most
    return counts.withColumn("percent", F.round(F.col("rows").cast("decimal(20,0)") * 100 / whole, 2).cast("double"))


def extraction_audit(df: DataFrame, failures: DataFrame) -> DataFrame:
    """Candidates with a case, and those that failed with the reason."""
    return df.where("gathered > 0").select("id", F.lit("extracted").alias("state"), F.lit(None).cast("string").alias("reason")).union(failures.select("id", F.lit("failed"), "reason"))


def party_rollup(df: DataFrame) -> DataFrame:
    """Members and first and last id of each party (ids themselves only where a party is small)."""
    return df.groupBy("party").agg(F.count("*").alias("seats"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def party_ids(df: DataFrame) -> DataFrame:
    """The ids of each party as an array, in order."""
    return df.groupBy("party").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def district_rollup(df: DataFrame) -> DataFrame:
    """Members of each district."""
    return df.where(F.col("district").isNotNull()).groupBy("district").agg(F.count("*").alias("members"))


def compare_runs(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """By model: candidates, exact counts, sum of absolute gaps, seconds."""
    joined = runs.join(truth, "id").withColumn("gap", F.abs(F.col("count") - F.col("truth")))
    return joined.groupBy("model").agg(F.count("*").alias("candidates"), F.count_if(F.col("gap") == 0).alias("exact"), F.sum("gap").alias("gaps"), F.sum("seconds").alias("seconds"))


def progression(summaries: DataFrame) -> DataFrame:
    """Exact counts by round and their change (a round is a row: few)."""
    return summaries.withColumn("change", F.col("exact") - F.lag("exact").over(Window.orderBy("round")))


def doc_method(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """The method of all pages of a document, else mixed; empty without pages' methods."""
    return pages.groupBy(doc).agg(
        F.when(F.count("method") == 0, "empty").when(F.min("method") == F.max("method"), F.min("method")).otherwise("mixed").alias("extraction_method")
    )


# ---- filters and listings


def search(df: DataFrame, query: str) -> DataFrame:
    """every word of the query stands in name, constituency, role or a ministry."""
    text = F.lower(F.concat_ws(" ", "name", "constituency", "role", F.array_join(F.transform("ministries", lambda m: m["name"]), " ")))
    out = df
    for token in query.lower().split():
        out = out.where(F.contains(text, F.lit(token)))
    return out


#: Lower and upper count of each bucket (fixed values).
BUCKETS = {"0": (0, 0), "1-2": (1, 2), "3-5": (3, 5), "6+": (6, None)}


def facet_filter(df: DataFrame, parties=(), buckets=(), ministers_only: bool = False) -> DataFrame:
    """party in the set, case count in any of the buckets, ministers only."""
    out = df.where(F.col("party").isin(*parties)) if parties else df
    if buckets:
        n, any_ = case_count("criminal_cases", "leading"), F.lit(False)
        for b in buckets:
            low, high = BUCKETS[b]
            any_ = any_ | ((n >= low) & (n <= high if high is not None else F.lit(True)))
        out = out.where(any_)
    return out.where(F.coalesce(F.size("ministries"), F.lit(0)) > 0) if ministers_only else out


def any_field_search(df: DataFrame, query: str) -> DataFrame:
    """the query stands in any text field or ministry."""
    q = F.lit(query.lower())
    has = lambda c: F.coalesce(F.contains(F.lower(c), q), F.lit(False))
    return df.where(has("name") | has("constituency") | has("party") | F.coalesce(F.exists("ministries", lambda m: F.contains(F.lower(m["name"]), q)), F.lit(False)))


def bucket(df: DataFrame, n: int, m: int, ids=(), key: str = "id") -> DataFrame:
    """shard n of m by (id - 1) mod m, or the ids that are named."""
    if not 0 <= n < m:
        raise ValueError("shard n of m: 0 <= n < m")
    out = df.where(F.col(key).isin(*ids)) if ids else df
    return out.where(F.pmod(F.col(key) - 1, F.lit(m)) == n)


def todo(df: DataFrame, done: DataFrame, keys=("doc", "stamp"), forced: DataFrame | None = None) -> DataFrame:
    """rows not done at their stamp, and those that are forced."""
    left = df.join(done.select(*keys).distinct(), list(keys), "left_anti")
    if forced is None:
        return left
    again = df.join(forced.select(keys[0]).distinct(), keys[0], "left_semi").join(left.select(*keys), list(keys), "left_anti")
    return left.unionByName(again)


def quarantine_pages(df: DataFrame) -> DataFrame:
    """``reason`` why a result page can't be used, null if it can.

    df (asked, heading, has_table, n_rows, n_candidates).
    """
    reason = (
        F.when(F.col("heading").isNull(), "no heading")
        .when(F.col("heading") != F.col("asked"), "other contest")
        .when(~F.col("has_table"), "no table")
        .when(F.col("n_rows") < 2, "fewer than 2 rows")
        .when(F.col("n_candidates") < 2, "fewer than 2 candidates")
    )
    return df.withColumn("reason", reason)


#: Sort keys of listings by name.
SORTS = {
    "name": lambda: [F.asc("name")],
    "name_desc": lambda: [F.desc("name")],
    "cases": lambda: [F.desc(case_count("criminal_cases"))],
    "cases_asc": lambda: [F.asc(case_count("criminal_cases"))],
    "constituency": lambda: [F.asc("constituency")],
    "party": lambda: [F.asc("party"), F.asc("name")],
}


def list_sort(df: DataFrame, key: str, featured=(), limit: int | None = None) -> DataFrame:
    """Featured names first in their order, then one of ``SORTS``; ties by id."""
    order = [*SORTS[key](), F.asc("id")]
    if featured:
        place = F.array_position(F.array(*map(F.lit, featured)), F.col("name"))
        order.insert(0, F.asc(F.coalesce(F.nullif(place, F.lit(0)), F.lit(len(featured) + 1))))
    out = df.orderBy(*order)
    return out.limit(limit) if limit else out


def card_facts(df: DataFrame) -> DataFrame:
    """First ministry, number of others, birth date pending, has cases, clean."""
    n = case_count("criminal_cases")
    return df.withColumns({
        "primary_ministry": F.get(F.col("ministries"), F.lit(0))["name"],
        "other_ministries": F.greatest(F.coalesce(F.size("ministries"), F.lit(0)) - 1, F.lit(0)),
        "dob_pending": F.coalesce(F.startswith("dob", F.lit("Age:")), F.lit(True)),
        "has_cases": n > 0,
        "clean": n == 0,
    })


# ---- arrays and maps


def pages_to_process(index: DataFrame) -> DataFrame:
    """M4: pages of both sections, once each, in order."""
    return index.withColumn("pages", F.array_sort(F.array_union("pending_pages", "conviction_pages")))


def merge_maps(df: DataFrame, a: str, b: str, mode: str = "overwrite", out: str = "merged") -> DataFrame:
    """M5: entries of both maps; of a key in both, b's value (``overwrite``) or a's (``fill``)."""
    win, lose = (b, a) if mode == "overwrite" else (a, b)
    left = F.map_filter(lose, lambda k, _: ~F.map_contains_key(win, k))
    return df.withColumn(out, F.map_concat(left, F.col(win)))
