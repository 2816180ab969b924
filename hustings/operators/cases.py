"""Case facts: explode, dedup, count, reconcile, disclose."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions import cases as C
from hustings.operators.linkage import first_by


def explode_cases(answers: DataFrame, method: str = "model") -> DataFrame:
    """Case rows of model answers (doc, page, response), both buckets.

    A case needs a reference or a description; one of low confidence is flagged.
    """
    parsed = answers.select("doc", "page", C.lenient_json("response").alias("a"))

    def bucket(name: str) -> DataFrame:
        cases = F.coalesce(F.col(f"a.{name}"), F.array().cast(f"array<{C.CASE}>"))
        return parsed.select("doc", "page", F.lit(name).alias("bucket"), F.posexplode(cases).alias("pos", "c")).select("doc", "page", "bucket", "pos", "c.*")

    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return (
        bucket("pending").unionByName(bucket("convictions"))
        .where(has("fir_no") | has("description"))
        .withColumns({
            "method": F.lit(method),
            "raw_text": F.concat(F.lit("FIR: "), F.coalesce("fir_no", F.lit("")), F.lit(" | Desc: "), F.coalesce("description", F.lit(""))),
            "needs_review": F.coalesce(F.col("confidence") < C.REVIEW_BELOW, F.lit(False)),
        })
    )


def dedupe_cases(cases: DataFrame, owner: str = "candidate_id", then=()) -> DataFrame:
    """The first case of each (owner, bucket, signature), by position and the columns ``then``; cases without a signature go."""
    signed = cases.withColumn("signature", C.case_signature("fir_no", "sections", "raw_text"))
    # Asked only of first rows: a filter on the signature alone would move below the window and be
    # worked out once more there.
    return first_by(signed, [owner, "bucket", "signature"], F.asc("pos"), *map(F.asc, then), only=F.col("signature") != "")


def category_counts(cases: DataFrame, owner: str = "candidate_id") -> DataFrame:
    """A2: cases of each owner by category, zeros kept."""
    label = C.classify_sections(F.coalesce(F.nullif(F.col("sections"), F.lit("")), F.col("raw_text")))
    return (
        cases.withColumn("category", label)
        .groupBy(owner)
        .agg(*(F.count_if(F.col("category") == c).alias(k) for c, k in zip(C.CATEGORIES, ("serious", "corruption", "election", "political", "minor"), strict=True)))
    )


def reconcile_counts(df: DataFrame) -> DataFrame:
    """A3: the stated total (if above 0), else the header count (2 or more, and above what was
    extracted), else what was extracted; with its source."""
    stated = F.coalesce(F.col("abstract_count") > 0, F.lit(False))
    headers = F.coalesce((F.col("style3_count") >= 2) & (F.col("style3_count") > F.col("extracted_count")), F.lit(False))
    return df.withColumns({
        "num_criminal_cases": F.when(stated, F.col("abstract_count")).when(headers, F.col("style3_count")).otherwise(F.col("extracted_count")),
        "count_source": F.when(stated, "stated_total").when(headers, "case_headers").otherwise("extracted"),
    })


def style3_count(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """A4: distinct "CASE n" headers of a document; one alone doesn't count."""
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)(?<![0-9A-Za-z_])case\s+0*([0-9]{1,6})(?![0-9A-Za-z_])"), F.lit(1)), lambda x: x.cast("int"))
    counted = pages.select(doc, F.explode(numbers).alias("n")).groupBy(doc).agg(F.countDistinct("n").alias("style3_count"))
    return counted.where("style3_count >= 2")


def needs_review(df: DataFrame) -> DataFrame:
    """flagged cases of both arrays of a candidate, a row each."""
    part = lambda c, b: df.select("id", F.lit(b).alias("bucket"), F.posexplode(c).alias("pos", "case")).where("case.needs_review")
    return part("criminal_details_pending", "pending").unionByName(part("criminal_details_convictions", "convictions"))


def valid_cases(df: DataFrame) -> DataFrame:
    """F8: rows of which reference or description holds a value."""
    return df.where(~(C.is_invalid("fir_no") & C.is_invalid("description")))


def disclosure_rows(df: DataFrame, owner: str = "candidate_id") -> DataFrame:
    """``place`` of each valid case: pending by category (unknown last) and input order, then convictions."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, C.CATEGORIES)), F.col("category")), F.lit(0)), F.lit(99))
    pending = F.col("bucket") == "pending"
    order = Window.partitionBy(owner).orderBy(F.desc(pending), F.when(pending, rank), "pos")
    return valid_cases(df).withColumn("place", F.row_number().over(order))


def case_display(df: DataFrame) -> DataFrame:
    """Reference, sections and description as shown; rows without the first two go."""
    value = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("N/A"))
    raw = F.coalesce("raw_text", F.lit(""))
    parsed = (value("fir_no") == "N/A") & F.contains(raw, F.lit("FIR:")) & (F.col("bucket") == "pending")
    part = lambda i, label: F.trim(F.replace(F.get(F.split(raw, r"\|"), F.lit(i)), F.lit(label), F.lit("")))
    shown = df.select(
        "candidate_id", "bucket", "pos",
        F.when(parsed, part(0, "FIR:")).otherwise(value("fir_no")).alias("fir"),
        value("sections").alias("sections"),
        F.when(parsed & (value("description") == "N/A"), F.coalesce(part(1, "Desc:"), F.lit("N/A"))).otherwise(value("description")).alias("description"),
        F.when(F.col("bucket") == "pending", "Pending").otherwise("Convicted").alias("status"),
    )
    return shown.where("fir <> 'N/A' or sections <> 'N/A'")


def keep_best(previous: DataFrame, new: DataFrame, truth: DataFrame) -> DataFrame:
    """A candidate's new count replaces the old one only if it is strictly closer to the truth."""
    joined = truth.join(previous.select("id", F.col("count").alias("old")), "id", "left").join(new.select("id", F.col("count").alias("fresh")), "id", "left")
    gap = lambda c: F.abs(F.col(c) - F.col("truth"))
    better = F.coalesce(gap("fresh") < gap("old"), F.col("old").isNull())
    return joined.select("id", "truth", F.when(better, F.col("fresh")).otherwise(F.col("old")).alias("count"), better.alias("replaced"))


