"""Lines that other documents hold already, as keep bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.llm.common import SPACE, ascii_lower, boxed, narrow, read, settled, shuffle_parts

#: Shares into which the copies of one line are pre-aggregated.
SALTS = 16
#: Where a null id stands in the order of documents.
NULL_PLACE = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n", -1)


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bitmaps of the lines that each document keeps.

    A line whose key has ``min_chars`` code points or more and occurs in two
    documents or more stays in the smallest ``doc_id`` only (there all its
    occurrences stay).  The result has a row for each different document that
    loses lines: ``doc_id``, ``text_hash``, and ``dropped``, an ordered array of
    (word, bits), the words of 64 lines that have a dropped line; all other words
    are "keep all".  So a bitmap takes no more than 16 bytes for a dropped line.

    Only 128-bit hashes, ids and positions are shuffled, never text.  Copies of a
    line are first reduced under ``SALTS`` salts, then hashes are range-partitioned
    with a secondary sort by document, and the first occurrence streams past.

    A null text is one empty line.  A null id is smaller than any other id.  Rows
    that repeat an id count as one document.  An empty table has no bitmaps; a very
    long text has as many rows as lines, whatever its length.
    """
    spark = docs.sparkSession
    # Used twice, and costlier to work out (every byte of text) than to keep (no text).
    rows = settled(
        narrow(docs, id_col, text_col)
        .withColumn("text_hash", F.xxhash64("text"))
        .select("doc_id", "text_hash", F.posexplode(_lines()).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.unhex(F.md5("key")).alias("key"))
    )
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_PLACE))
    seen = rows.groupBy("key", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    ordered = seen.repartitionByRange(shuffle_parts(spark), "key").sortWithinPartitions("key", "first")
    stream = Window.partitionBy("key").orderBy("first")
    firsts = (
        ordered.select(
            "key",
            "first",
            F.row_number().over(stream).alias("nth"),
            F.max("last").over(stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"),
        )
        .where((F.col("nth") == 1) & (F.col("first") < F.col("last")))
        .select("key", F.col("first").alias("owner"))
    )
    dropped = rows.join(firsts, "key").where(place != F.col("owner"))
    words = dropped.groupBy("doc_id", "text_hash", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits")
    )
    return words.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and the ``kept`` text.

    Every row and column of ``docs`` stays, but for columns with one of these three
    names, which give way; a text without a dropped line comes back unchanged (a
    null as the empty text).  An empty table stays empty.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    return _applied(docs, bitmaps, id_col, text_col).select(*(F.col(f"row.`{c}`") for c in own), "n_lines", "n_dropped", "kept")


def _applied(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (all columns), ``n_lines``, ``n_dropped`` and ``kept``."""
    marks = bitmaps.select(
        "doc_id",
        "text_hash",
        F.map_from_entries("dropped").alias("bits"),
        F.aggregate("dropped", F.lit(0), lambda a, x: a + F.bit_count(x["bits"])).cast("long").alias("n"),
    )
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    left = boxed(docs).withColumn("text", text).withColumn("own_hash", F.xxhash64("text"))
    joined = left.join(marks.hint("shuffle_hash"), F.col(f"row.`{id_col}`").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")), "left")

    def kept_line(_, i: Column) -> Column:
        word = F.coalesce(F.try_element_at("bits", F.shiftright(i, 6)), F.lit(0).cast("long"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(F.lit(63)))
        return word.bitwiseAND(bit) == 0

    lines = F.split("text", "\n", -1)
    return joined.select(
        "row",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("n").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, kept_line), "\n")).alias("kept"),
    )


def stage(spark, docs, sf_dir):
    """Lines that another document holds already go from the text; documents stay.

    Null texts become empty, ``n_chars`` follows the text; rows that repeat an id are
    one document, very long texts and lines count whole, an empty table stays empty,
    columns can have any name.
    """
    rows = _applied(docs, keep_bitmaps(docs), "doc_id", "text")
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, (o.owner IS NOT NULL AND o.owner <> k.doc_id) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
