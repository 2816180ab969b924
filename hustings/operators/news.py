"""Articles: dedup, caps, merges, feeds, relevance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hustings.functions import articles as A
from hustings.functions import names as N
from hustings.operators.linkage import first_by, small, tasks


def recent(df: DataFrame, now, days: int = 90, at: str = "published_at") -> DataFrame:
    """articles of the last ``days``; bad and missing dates go."""
    return df.where(F.try_to_timestamp(F.col(at).cast("string")) >= now - F.make_interval(days=F.lit(days)))


def dedupe_and_cap(items: DataFrame, cap: int = 25) -> DataFrame:
    """A candidate's articles, the first of each key, then the newest ``cap``.

    Dealt by candidate first, so that both windows share one exchange.
    """
    keyed = items.withColumn("key", A.dedupe_key("url", "title")).repartition("candidate_id")
    arrival = [F.asc("query_pos"), F.asc("lang_pos"), F.asc("pos")]
    firsts = first_by(keyed, ["candidate_id", "key"], *arrival)
    order = Window.partitionBy("candidate_id").orderBy(F.desc_nulls_last("published_at"), *arrival)
    return firsts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def append_distinct(old: DataFrame, new: DataFrame, keys=("name", "constituency")) -> DataFrame:
    """Old rows, then new ones of keys that are not there yet; the first of each."""
    both = old.withColumn("__source", F.lit(0)).unionByName(new.withColumn("__source", F.lit(1)))
    return first_by(both, list(keys), F.asc("__source"), F.asc("pos")).drop("__source")


def merge_news(old: DataFrame, fresh: DataFrame, refreshed: DataFrame) -> DataFrame:
    """M1: candidates that were fetched (``refreshed``) have their fresh rows only, also none."""
    return old.join(small(refreshed.select("candidate_id").distinct()), "candidate_id", "left_anti").unionByName(fresh.join(small(refreshed.select("candidate_id").distinct()), "candidate_id", "left_semi"))


#: Folders into which candidates' articles are dealt.
BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("candidate_id"), F.lit(buckets)).cast("int").alias("bucket")


def write_news(items: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """M1: articles in folders by candidate, each with a blank row, so that one without articles is a folder too."""
    spark = items.sparkSession
    kept = items.withColumn("bucket", _bucket(buckets))
    blank = spark.range(buckets).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in items.schema), F.col("id").cast("int").alias("bucket"))
    kept.unionByName(blank).repartition(F.col("bucket")).write.partitionBy("bucket").parquet(path)


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """Articles that ``write_news`` and ``refresh_news`` have written."""
    return spark.read.parquet(path).where("candidate_id is not null").drop("bucket")


def refresh_news(fresh: DataFrame, refreshed: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """M1 in place: articles of candidates that were fetched (``refreshed``) are replaced by their fresh ones, also by none.

    Only the folders of refreshed candidates are read and written (dynamic overwrite);
    all others keep their files.  The folders are replaced when all are written, so
    readers see either state of one, and a job that fails changes nothing.
    """
    spark = fresh.sparkSession
    ids = refreshed.select("candidate_id").where("candidate_id is not null").distinct()
    touched = [r.bucket for r in ids.select(_bucket(buckets)).distinct().collect()]  # at most as many as folders
    stored = spark.read.parquet(path)
    old = stored.where(F.col("bucket").isin(touched))
    stay = old.join(small(ids), "candidate_id", "left_anti")
    new = fresh.join(small(ids), "candidate_id", "left_semi").withColumn("bucket", _bucket(buckets)).select(*stored.columns)
    stay.select(*stored.columns).unionByName(new).repartition(F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def party_feed(news: DataFrame, cands: DataFrame, parties: list[str]) -> DataFrame:
    """M2: articles of the parties' members, the first of each link; blank links all stay.

    Joined by candidate and dealt by link: a party may hold most of the rows.
    """
    mine = news.join(small(cands.where(F.col("party").isin(parties)).select("candidate_id", "party")), "candidate_id")
    blank = F.coalesce(F.trim("url"), F.lit("")) == ""
    return first_by(mine.where(~blank), ["url"], F.asc("candidate_id"), F.asc("pos")).unionByName(mine.where(blank))


def merged_feed(a: DataFrame, b: DataFrame) -> DataFrame:
    """M3: both feeds, the first of each link (else of candidate and title), newest first by ``rank``."""
    both = a.withColumn("__source", F.lit(0)).unionByName(b.withColumn("__source", F.lit(1)), allowMissingColumns=True)
    key = F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.concat_ws(":", "candidate_id", "title"))
    return first_by(both.withColumn("__k", key), ["__k"], F.asc("__source"), F.asc("pos")).drop("__k", "__source")


def bookmark_feed(bookmarks: DataFrame, news: DataFrame) -> DataFrame:
    """Articles of bookmarked candidates, a row for each user and article."""
    return news.join(bookmarks.select("uid", "candidate_id").distinct(), "candidate_id")


def selected_first(df: DataFrame, ids: list, by: str = "candidate_id", uid: str = "uid") -> DataFrame:
    """``place`` of each of a user's rows: those of selected candidates first, newest first in both."""
    order = Window.partitionBy(uid).orderBy(F.desc(F.col(by).isin(ids)), F.desc_nulls_last("published_at"), F.asc("pos"))
    return df.withColumn("place", F.row_number().over(order))


def page_slice(df: DataFrame, page: int, size: int = 20, place: str = "place") -> DataFrame:
    """The rows of one page (from 1) of an ordered feed."""
    return df.where(F.col(place).between((page - 1) * size + 1, page * size))


def relevance(items: DataFrame, cands: DataFrame) -> DataFrame:
    """Why an article is in its candidate's feed; candidates that are unknown have none."""
    known = cands.select("candidate_id", F.col("name").alias("__n"), F.col("constituency").alias("__c"), N.party_aliases("party").alias("__a"), F.lit(True).alias("__known"))
    joined = items.join(small(known), "candidate_id", "left")
    kind = F.when(F.col("__known"), A.relevance_kind("title", "snippet", "__n", "__c", F.col("__a")))
    return joined.withColumn("kind", kind).drop("__n", "__c", "__a", "__known")


def discover(items: DataFrame, cands: DataFrame) -> DataFrame:
    """J21 the other way: (item_id, candidate_id) of articles in which a word of four letters or more of a name stands.

    items (item_id, title, snippet), cands (candidate_id, name).  Articles are reduced to
    words of names first, once each; what a common word brings after that is part of the
    result, and its share of the join is split up at run time.
    """
    return named_words(items, cands).join(_name_words(cands), "word").select("item_id", "candidate_id").distinct()


def _name_words(cands: DataFrame) -> DataFrame:
    who = F.regexp_replace(F.coalesce("name", F.lit("")), r"\s+[sSwWdD]/[oO]\s+.*$", "")
    words = F.array_distinct(F.filter(F.split(F.lower(who), "[^a-z0-9]+"), lambda w: F.length(w) >= 4))
    return cands.select("candidate_id", F.explode(words).alias("word")).distinct()


def named_words(items: DataFrame, cands: DataFrame) -> DataFrame:
    """(item_id, word): words of names in articles, once each."""
    text = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "title", "snippet")), "[^a-z0-9_]+"))
    return items.select("item_id", F.explode(text).alias("word")).join(_name_words(cands).select("word").distinct(), "word", "left_semi").distinct()


#: Articles that are looked through together, and the share of them from which a word's articles are kept as a row of flags.
BLOCK_ITEMS, FREQUENT = 32_768, 64


def _held_in_block(items: pa.Table, names: pa.Table) -> pa.Table:
    """(item_id, candidate_id, words): articles of one block that hold all words of a name.

    Each word's articles are a sorted list; a name's lists are met from the shortest on.
    """
    ids = items["item_id"].combine_chunks().dictionary_encode()
    words = items["words"].combine_chunks()
    flat = words.flatten().dictionary_encode()
    n_items, n_words = len(ids.dictionary), len(flat.dictionary)
    of = np.repeat(ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.value_lengths().to_numpy(zero_copy_only=False))
    met = np.sort(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_items + of)
    met = met[np.diff(met, prepend=-1) > 0]
    ends = np.searchsorted(met, np.arange(n_words + 1) * n_items)
    starts, sizes, at = ends[:-1].tolist(), np.diff(ends), (met % max(n_items, 1)).astype(np.int32)
    asked = names["words"].combine_chunks()
    codes = pc.index_in(asked.flatten(), value_set=flat.dictionary).fill_null(-1).to_numpy(zero_copy_only=False).tolist()
    lengths, size, flags = asked.value_lengths().to_numpy(zero_copy_only=False).tolist(), sizes.tolist(), {}
    found, who, first = [], [], 0
    for k, n in enumerate(lengths):
        own = codes[first : first + n]
        first += n
        if min(own) < 0:
            continue
        own.sort(key=size.__getitem__)
        hits = at[starts[own[0]] : starts[own[0]] + size[own[0]]]
        for w in own[1:]:
            if size[w] * FREQUENT > n_items:
                if w not in flags:
                    flags[w] = np.zeros(n_items, dtype=bool)
                    flags[w][at[starts[w] : starts[w] + size[w]]] = True
                hits = hits[flags[w][hits]]
            else:
                held = at[starts[w] : starts[w] + size[w]]
                hits = hits[held[np.minimum(np.searchsorted(held, hits), len(held) - 1)] == hits]
            if not len(hits):
                break
        else:
            found.append(hits)
            who.append(k)
    rows = np.repeat(np.array(who, dtype=np.int64), [len(x) for x in found])
    docs = np.concatenate([*found, np.empty(0, np.int32)])
    return pa.table({"item_id": ids.dictionary.take(pa.array(docs)), "candidate_id": names["candidate_id"].take(pa.array(rows)), "words": pa.array(np.array(lengths, dtype=np.int32)[rows])})


def discover_full_names(items: DataFrame, cands: DataFrame) -> DataFrame:
    """J21, strictly: (item_id, candidate_id, words) of articles that hold all words (four letters or more) of a name.

    Articles are dealt into blocks as their words, once each; every block meets all
    names, whose words' articles are intersected there.  So neither an article and a
    name that share a word, nor a word of an article, is a row anywhere; names are sent
    out once for each block.  ``item_id`` has to tell articles apart.
    """
    spark = items.sparkSession
    n = max(-(-items.count() // BLOCK_ITEMS), 1)
    text = F.filter(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "title", "snippet")), "[^a-z0-9_]+")), lambda w: F.length(w) >= 4)
    blocks = items.where("item_id is not null").select("item_id", text.alias("words"), F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int").alias("block"))
    own = _name_words(cands).groupBy("candidate_id").agg(F.collect_list("word").alias("words"))
    sent = own.select("candidate_id", "words", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((items, "item_id"), (cands, "candidate_id"))}
    parts = max(n, tasks(spark))
    met = blocks.repartition(parts, "block").groupBy("block").cogroup(sent.repartition(parts, "block").groupBy("block"))
    return met.applyInArrow(_held_in_block, f"item_id {kinds['item_id']}, candidate_id {kinds['candidate_id']}, words int")
