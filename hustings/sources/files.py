"""Readers and writers with explicit schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.operators.linkage import first_by
from hustings.sources.shared import shared_folder

CASE = "struct<fir_no:string,description:string,sections:string,page:int,method:string,raw_text:string,category:string,confidence:double,needs_review:boolean>"
CANDIDATES = (
    "id int, name string, constituency string, party string, criminal_cases string, education string, dob string, image string, profession string, "
    "alias string, role string, ministries array<struct<name:string,sector:string>>, social_media map<string,string>, "
    "criminal_summary struct<num_criminal_cases:int,num_convictions:int,pending_by_category:map<string,int>,count_source:string,extracted_count:int,"
    "abstract_count:int,style3_count:int,source:string,extracted_at:string,status:string,reason:string>, "
    f"criminal_details_pending array<{CASE}>, criminal_details_convictions array<{CASE}>"
)
NEWS = "struct<title:string,url:string,source:string,published_at:string,snippet:string,lang:string,matched_query:string>"
FAILURES = "id int, name string, reason string, timestamp string"


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/hustings-{uuid.uuid4().hex}"


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """The master array of objects."""
    return spark.read.schema(CANDIDATES).json(path, multiLine=True)


def read_keyed(spark: SparkSession, path: str, value: str, field: str | None = None) -> DataFrame:
    """(key, value columns) of an object keyed by id; ``field`` names it inside an outer
    object.  A malformed or shapeless file gives no rows."""
    text = spark.read.text(path, wholetext=True)
    shape = f"map<string,{value}>"
    keyed = F.from_json("value", f"struct<`{field}`:{shape}>")[field] if field else F.from_json("value", shape)
    return text.select(F.explode(keyed).alias("key", "item"))


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """S2 for articles: a row for each item with its place."""
    keyed = read_keyed(spark, path, f"array<{NEWS}>", "by_candidate")
    return keyed.select(F.col("key").alias("candidate_id"), F.posexplode("item").alias("pos", "i")).select("candidate_id", "pos", "i.*")


def read_electors_csv(spark: SparkSession, path: str, year: int) -> DataFrame:
    """S3: (contest, electors) of one year; what is no positive number goes, the first row of a contest stays."""
    rows = spark.read.csv(path, header=True).withColumn("pos", F.monotonically_increasing_id())
    typed = rows.where(F.col("Year").try_cast("int") == year).select(
        F.col("Constituency_No").try_cast("int").alias("contest"), F.col("Electors").try_cast("long").alias("electors"), "pos"
    )
    return first_by(typed.where("contest > 0 and electors > 0"), ["contest"], F.asc("pos")).select("contest", "electors")


def consolidate_failures(spark: SparkSession, path: str) -> DataFrame:
    """The last failure of each id of an append log; malformed lines go.

    Of failures of one time the last by name and then by reason stays.
    """
    log = spark.read.schema(FAILURES).json(path, mode="DROPMALFORMED").where("id is not null")
    last = log.groupBy("id").agg(F.max(F.struct("timestamp", "name", "reason")).alias("last"))
    return last.select("id", "last.name", "last.reason", "last.timestamp")


ITEM = "title string, link string, description string, pubDate string, source struct<_VALUE:string,_url:string>"


def read_feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Feed items with title and link; the date as a UTC timestamp."""
    items = spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)
    when = F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w+, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    full = (F.coalesce(F.trim("title"), F.lit("")) != "") & (F.coalesce(F.trim("link"), F.lit("")) != "")
    return items.where(full).select("title", F.col("link").alias("url"), F.col("source._VALUE").alias("source"), when.alias("published_at"), F.col("description").alias("snippet"))


def file_sha1(spark: SparkSession, path: str) -> DataFrame:
    """Content hash and size of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha1("content").alias("sha1"))


class GateClosed(ValueError):
    """The result has problems and was not published."""


def gated_write(df: DataFrame, problems: DataFrame, path: str, version: str, dry_run: bool = False) -> int:
    """Publish ``df`` as a new version only if there are no problems; returns their number.

    A dry run writes nothing and only counts.
    """
    n = problems.count()
    if dry_run:
        return n
    if n:
        raise GateClosed(f"{n} rows have problems; nothing was written")
    df.write.mode("errorifexists").parquet(f"{path}/version={version}")
    return n


def expect_count(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` if it has exactly ``n`` different keys, else an error."""
    got = df.agg(F.countDistinct(key).alias("n")).first()["n"]
    if got != n:
        raise GateClosed(f"{n} different {key} expected, {got} found")
    return df


def nest_items(items: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """Items of each key as an array in order."""
    fields = [c for c in items.columns if c not in (key, order)]
    listed = F.sort_array(F.collect_list(F.struct(order, F.struct(*fields).alias("item"))))
    return items.groupBy(key).agg(F.transform(listed, lambda x: x["item"]).alias("items"))


def write_keyed(items: DataFrame, key: str, path: str, order: str = "pos") -> None:
    """One JSON line for each key with its items in order."""
    nest_items(items, key, order).write.mode("overwrite").json(path)


def quick_reference_lines(df: DataFrame) -> DataFrame:
    """One line of text for each candidate (id, name, party, constituency, votes)."""
    line = F.format_string("- [%s] **%s** (%s) — %s, %s votes", F.col("id").cast("string"), "name", "party", "constituency", F.format_number(F.col("votes"), 0))
    return df.select("id", line.alias("line"))
