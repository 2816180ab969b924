"""Ranked lexical search: item bundles pass through the owners of terms, one after another."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.llm.common import LOWER, UPPER, narrow, read, settled

#: Documents in a block and items in a bundle: what one visit holds at most.
BLOCK_DOCS, BUNDLE_ITEMS = 4096, 512
#: An owner has the terms that up to such a share of the documents hold, the last one all others.
OWNERS = (0.002, 0.02, 0.1, 1.0)
#: Item terms up to which (rows and bytes) tasks leave out all other terms as they count.
KNOWN_TERMS, KNOWN_BYTES = 200_000, 4 << 20
#: Terms are maximal runs of these.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Byte by byte: A-Z lower-cased, letters, digits and all bytes above 127 as they are, else a blank.
_PLAIN = bytes(
    ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256)
)
_COUNTED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int64()))])
_ASKED = pa.list_(pa.struct([("owner", pa.int32()), ("term_id", pa.int64()), ("weight", pa.int64()), ("bound", pa.int64())]))
_LONGS = pa.list_(pa.int64())
_BUNDLES = pa.schema([("block", pa.int32()), ("bundle", pa.int32()), ("item_row", pa.int64()), ("item_id", pa.int64()), ("terms", _ASKED), ("keys", _LONGS), ("ids", _LONGS), ("scores", _LONGS)])


def _terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def _counting(known):
    """A row for each document: its number of terms, and its terms (those of ``known``, if given) with their counts."""

    def count(batches):
        keep = None if known is None else known.value
        for batch in batches:
            n, sizes, terms, tfs = [], [0], [], []
            for text in batch.column("text").to_pylist():
                found = _terms(text)
                n.append(len(found))
                held = Counter(found if keep is None else filter(keep.__contains__, found))
                terms += held.keys()
                tfs += held.values()
                sizes.append(len(terms))
            offsets = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), *lists], schema=_COUNTED)

    return count


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and where each row's begin."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])


def _visit(stage: int, last: bool, top: int):
    """What the owner of ``stage`` does with the bundles of a block: adds what its terms bring.

    A document leaves an item's accumulator when all that is still to come can't lift it
    to the score that ``top`` others of the block have already.
    """

    def visit(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        if not bundles.num_rows:
            return _BUNDLES.empty_table()
        term, part = postings["term_id"].to_numpy(), postings["part"].to_numpy()
        order = np.argsort(term, kind="stable")
        term, part = term[order], part[order]
        keys, firsts, place = np.unique(postings["row"].to_numpy()[order], return_index=True, return_inverse=True)
        ids = postings["id"].to_numpy()[order][firsts]
        lists = bundles["terms"].combine_chunks().cast(_ASKED)
        asked, ask_at = _flat(lists)
        owner, asked_id, weight, bound = (asked.field(x).to_numpy() for x in ("owner", "term_id", "weight", "bound"))
        begin, end = np.searchsorted(term, asked_id, "left"), np.searchsorted(term, asked_id, "right")
        (old_keys, old_at), (old_ids, _), (old_scores, _) = ((x.to_numpy(), at) for x, at in (_flat(bundles[c]) for c in ("keys", "ids", "scores")))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(bundles.num_rows):
            own = slice(old_at[k], old_at[k + 1])
            score = np.zeros(len(keys), np.int64)
            for j in range(ask_at[k], ask_at[k + 1]):
                if owner[j] == stage and end[j] > begin[j]:
                    score[place[begin[j] : end[j]]] += weight[j] * part[begin[j] : end[j]]
            at = np.searchsorted(keys, old_keys[own])
            here = at < len(keys)
            here[here] = keys[at[here]] == old_keys[own][here]
            score[at[here]] += old_scores[own][here]
            new = np.flatnonzero(score)
            k_, i_, s_ = (np.concatenate(x) for x in ((keys[new], old_keys[own][~here]), (ids[new], old_ids[own][~here]), (score[new], old_scores[own][~here])))
            if len(s_) > top:
                if last:
                    best = np.lexsort((k_, i_, -s_))[:top]
                else:
                    to_come = bound[ask_at[k] : ask_at[k + 1]][owner[ask_at[k] : ask_at[k + 1]] > stage].sum()
                    best = s_ + to_come >= np.partition(s_, -top)[-top]
                k_, i_, s_ = k_[best], i_[best], s_[best]
            out.append((k_, i_, s_))
        at = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in out])]), pa.int32())
        acc = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([x[c] for x in out]), pa.int64())) for c in range(3)]
        return pa.Table.from_arrays([*(bundles[c] for c in _BUNDLES.names[:4]), lists, *acc], schema=_BUNDLES)

    return visit




def ranked_search(items: DataFrame, docs: DataFrame, top: int = 10, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ``top`` documents of highest score for each item: (item_id, rank, doc_id, score).

    Terms are dealt to owners by how many documents hold them, rare ones first.  A
    bundle is some items over a block of documents; it carries for each item a sparse
    accumulator (documents and scores so far) and passes through the owners one after
    another: each cogroups the bundles with its postings of the block and adds whole
    numbers.  So each posting is shuffled once, and what an accumulator holds is bounded
    by the block.  Documents that can't come under an item's first ``top`` of their
    block any more leave the accumulator, which changes no result; the last owner hands
    out ``top`` documents of a block, and a window ranks those of all blocks.

    Every row of ``docs`` is a document and every row of ``items`` an item, also those
    that repeat an id or have none (of equal scores, documents without an id come
    last).  Texts that are null or empty have no terms; very long ones count whole.
    Items without a term that a document holds, and empty tables, give no rows.
    """
    spark = docs.sparkSession
    rows = narrow(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()).select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = narrow(items, item_id, text).withColumn("item_row", F.monotonically_increasing_id()).select("item_row", F.col("doc_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), 0)).alias("term"))
    asked = settled(asked.groupBy("item_row", "item_id", "term").agg(F.count("*").alias("times")))
    words = asked.select("term").distinct()
    size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    known = None
    if size.n <= KNOWN_TERMS and size.bytes <= KNOWN_BYTES:
        known = spark.sparkContext.broadcast(frozenset(r.term.encode() for r in words.collect()))
    counted = settled(rows.mapInArrow(_counting(known), "row long, doc_id long, n long, terms array<string>, tfs array<long>"))
    total = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    n_docs, length = total.docs, max(total.length, 1)
    n_bundles = -(-asked.agg(F.count_distinct("item_row").alias("n")).first().n // BUNDLE_ITEMS)
    n_blocks = max(1, -(-n_docs // BLOCK_DOCS))

    fair = F.lit(25) + F.expr(f"(75 * n * {n_docs}L) div {length}L")
    held = counted.select("row", "doc_id", fair.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(
        "row", "doc_id", F.col("t.terms").alias("term"), F.expr("(1000000000 * t.tfs) div (1000 * t.tfs + 8 * m)").alias("part")
    )
    held = held if known is not None else held.join(words, "term", "left_semi")
    frequent = held.groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("most"))
    owner = F.lit(len(OWNERS) - 1)
    for k, share in reversed(list(enumerate(OWNERS[:-1]))):
        owner = F.when(F.col("df") <= share * n_docs, k).otherwise(owner)
    # The checkpoint fixes the numbers of the terms.
    terms = settled(frequent.select(
        "term", "most", owner.alias("owner"), F.monotonically_increasing_id().alias("term_id"),
        F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long").alias("idf"),
    ))
    weight = F.col("idf") * F.col("times")
    lists = asked.join(terms, "term").groupBy("item_row", "item_id").agg(
        F.collect_list(F.struct("owner", "term_id", weight.alias("weight"), (weight * F.col("most")).alias("bound"))).alias("terms")
    )
    asks, longs = "array<struct<owner: int, term_id: long, weight: long, bound: long>>", "array<long>"
    carried = f"block int, bundle int, item_row long, item_id long, terms {asks}, keys {longs}, ids {longs}, scores {longs}"
    none = F.array().cast(longs)
    bundles = lists.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.pmod(F.xxhash64("item_row"), F.lit(max(1, n_bundles))).cast("int").alias("bundle"),
        "item_row", "item_id", "terms", none.alias("keys"), none.alias("ids"), none.alias("scores"),
    )
    # Documents without an id have a negative key, and an id behind all others.
    at = (F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(max(1, n_bundles) - 1))).alias("bundle"))
    key = F.when(F.col("doc_id").isNull(), -F.col("row") - 1).otherwise(F.col("row"))
    postings = held.join(terms.select("term", "term_id", "owner"), "term").select(
        *at, "owner", "term_id", key.alias("row"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "part"
    )
    for stage in range(len(OWNERS)):
        own = postings.where(F.col("owner") == stage).drop("owner")
        bundles = bundles.groupBy("block", "bundle").cogroup(own.groupBy("block", "bundle")).applyInArrow(_visit(stage, stage == len(OWNERS) - 1, top), carried)
    found = bundles.select("item_row", "item_id", F.explode(F.arrays_zip("keys", "ids", "scores")).alias("x")).select("item_row", "item_id", "x.*").where("scores > 0")
    order = Window.partitionBy("item_row").orderBy(F.desc("scores"), F.asc("ids"), F.asc("keys"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", F.when(F.col("keys") >= 0, F.col("ids")).alias("doc_id"), F.col("scores").alias("score"))


def query(spark, sf_dir):
    return ranked_search(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))


_SPLIT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
ORACLE = f"""
WITH doc_terms AS (SELECT doc_id, unnest({_SPLIT}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM lengths),
df AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * max(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_SPLIT}) AS term FROM benchmark) GROUP BY ALL),
fair AS (SELECT doc_id, 25 + (75 * n * docs) // length AS m FROM lengths, whole),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN fair USING (doc_id) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
