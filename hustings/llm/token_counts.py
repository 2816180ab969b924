"""Token counts of whole texts without materialising ids."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import bounded_batches, read, settled, shuffle_parts

#: A pre-token is a run of blanks with the run of other characters behind it, or a
#: run of line feeds.  (U+2581 is how the vocabulary writes a blank.)
PRE_TOKEN = re.compile("[ ▁]*[^ ▁\n]+|[ ▁]+|\n+")
#: A pre-token is frequent if it is one of so many: there can't be more frequent ones than this number.
#: Longer ones than HEAD_CHARS never are, which bounds what every task gets.
HEAD_SHARE, HEAD_CHARS = 500_000, 256
#: Different pre-tokens that a task holds before it hands their counts on.
FLUSH = 800_000
#: Occurrences in a task from which a pre-token may be one of the most frequent ones.
OFTEN = 8
#: (document, pre-token) pairs that a task holds before it hands them on, token by token.
BLOCK = 1_000_000
#: Largest count that fits a packed place.
MOST_COUNT = (1 << 24) - 1


@lru_cache(maxsize=2)
def processor(model_file: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if "▁" in piece.lstrip("▁") or "\n" in piece:
            raise ValueError(f"piece {piece!r} joins two pre-tokens: their counts can't be added up")
    if sp.encode("ﬁ  x", out_type=str)[-1] != "▁x" or len(sp.encode(" ")) != 1:
        raise ValueError("the model rewrites white space or letters before it splits them")
    return sp


def pre_tokens(text: str) -> list[str]:
    """The encoder puts one blank before a text that isn't empty."""
    return PRE_TOKEN.findall(" " + text) if text else []


def count_pieces(sp, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token as they come out inside a text.

    The encoder's own blank in front stands for the token's first one; a token
    that follows a line feed is encoded behind one (a piece by itself).
    """
    blank = [t[0] in " ▁" for t in tokens]
    got = sp.encode([t[1:] if b else "\n" + t for t, b in zip(tokens, blank, strict=True)], num_threads=1)
    return [(len(ids) or 1) if b else len(ids) - 2 for ids, b in zip(got, blank, strict=True)]


def _often(batches):
    """Pre-tokens that are frequent in a task, with their counts there, and the count of all (null)."""
    counts: Counter[str] = Counter()

    def out():
        found = [(t, n) for t, n in counts.items() if n >= OFTEN and len(t) <= HEAD_CHARS] + [(None, counts.total())]
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["token", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(pre_tokens(text))
            if len(counts) > FLUSH:
                yield out()
                counts.clear()
    yield out()


def frequent_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """token, n: pre-tokens that are at least one of ``HEAD_SHARE`` of all.

    There can't be more than ``HEAD_SHARE`` of them, and as a share of the text they
    are as many in a large corpus as in a small one.  Which ones these are decides how
    much is joined, never what comes out.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = settled(texts.mapInArrow(_often, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")))
    total = counted.where("token is null").first()  # one number
    return counted.where(F.col("token").isNotNull() & (F.col("n") * HEAD_SHARE >= F.lit(total.n if total else 0)))


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text (null: empty, no tokens).

    Each different pre-token is encoded once.  Frequent ones (``HEAD_SHARE`` at most)
    are encoded first and go to every task, which adds their share up on the spot.
    Of all others a task hands on the documents they are in, a row for each pre-token
    of a block of documents.  Dealt and sorted by pre-token, all that belongs to one
    meets in one place, is encoded there once, and goes back to its documents as a
    product of counts.  Repeated rows count one by one; an empty table gives no rows;
    a very long text counts whole, its pre-tokens handed on block by block.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def encode(batches):
        for batch in batches:
            pieces = count_pieces(processor(model_file), batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, pa.int64())], ["token", "pieces"])

    often = frequent_tokens(docs, text_col).select("token").mapInArrow(encode, "token string, pieces long").collect()
    head = spark.sparkContext.broadcast({r.token: r.pieces for r in often})

    def per_document(batches):
        known, codes, held, places, base = head.value, {}, [], [], None

        def flush():
            """A row for each pre-token of the block: places (row less base) << 24 | count."""
            code = np.array(held, np.int32)
            order = np.argsort(code, kind="stable")
            offsets = np.searchsorted(code[order], np.arange(len(codes) + 1)).astype(np.int32)
            packed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(places, np.int64)[order]))
            return pa.RecordBatch.from_arrays([pa.array(list(codes), pa.string()), pa.array([base] * len(codes), pa.int64()), packed], ["token", "base", "packed"])

        for batch in batches:
            own = []
            for number, doc, size, text in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 0)), strict=True):
                total = 0
                base = number if base is None else base
                for token, n in Counter(pre_tokens(text)).items():
                    if (of := known.get(token)) is not None:
                        total += n * of
                    else:
                        held.append(codes.setdefault(token, len(codes)))
                        places.append((number - base) << 24 | min(n, MOST_COUNT))
                        while n > MOST_COUNT:
                            n -= MOST_COUNT
                            held.append(codes[token])
                            places.append((number - base) << 24 | min(n, MOST_COUNT))
                own.append([total, doc, size])
                if len(held) > BLOCK:
                    yield flush()
                    codes.clear()
                    held.clear()
                    places.clear()
                    base = None
            # One more row for each document with what is known of it already; its token is
            # no pre-token (a line feed and more) and differs by row.
            numbers = batch.column(1)
            names = pa.array([f"\n{x}" for x in numbers.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([names, numbers, pa.array(own, pa.list_(pa.int64()))], ["token", "base", "packed"])
        if held:
            yield flush()

    def weigh(batches):
        """row, n, doc_id, n_bytes of the places of sorted pre-tokens; one count for each pre-token."""
        sp, last, pieces = processor(model_file), None, 0
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            fresh = [t for t in dict.fromkeys(tokens) if t != last and not (t[0] == "\n" and t[1:2].isdigit())]
            counts = dict(zip(fresh, count_pieces(sp, fresh), strict=True)) if fresh else {}
            if last is not None:
                counts.setdefault(last, pieces)
            own = [t not in counts for t in tokens]
            rows, ns, docs_, sizes = [], [], [], []
            lists = batch.column(2)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for t, mine, b, x, y in zip(tokens, own, batch.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if mine:
                    total, doc, size = lists.values[x : x + 3].to_pylist()
                    rows.append(np.array([b]))
                    ns.append(np.array([total]))
                    docs_.append((len(rows) - 1, doc, size))
                else:
                    part = flat[x:y].astype(np.int64)
                    rows.append((part >> 24) + b)
                    ns.append((part & MOST_COUNT) * counts[t])
            if tokens and tokens[-1] in counts:
                last, pieces = tokens[-1], counts[tokens[-1]]
            starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(int)
            doc_ids, n_bytes = [None] * int(starts[-1]), [None] * int(starts[-1])
            for k, doc, size in docs_:
                doc_ids[starts[k]], n_bytes[starts[k]] = doc, size
            join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(join(rows)), pa.array(join(ns)), pa.array(doc_ids, pa.int64()), pa.array(n_bytes, pa.int64())], ["row", "n", "doc_id", "n_bytes"])

    texts = docs.select(
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
    ).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kept = texts.mapInArrow(per_document, "token string, base long, packed array<long>")
    sorted_ = kept.repartition(shuffle_parts(spark), "token").sortWithinPartitions("token")
    summed = (
        sorted_.mapInArrow(weigh, "row long, n long, doc_id long, n_bytes long")
        .groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    )
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark, sf_dir):
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
