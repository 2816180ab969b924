"""Approximate nearest neighbours: balanced posting lists behind a graph of their centres."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.llm.common import bounded_batches, read, settled

#: Vectors of which the centres are made (about so many, picked by hash), and the vectors a list aims at.
SAMPLE, LIST = 20_000, 128
#: A list is of 8 sample vectors at least, so there are 2,500 lists of a dimension at most.
LEAST = 8
#: Lists of a vector: the nearest, and up to so many in all that are at most so much further.
COPIES, BOUNDARY = 4, 1.03
#: A query reads the lists whose centres are at most so much further than the nearest (for
#: 51,000 vectors without clusters 107 of 256 lists, which hold 0.966 of the true neighbours).
PRUNE = 1.12
#: Links of a centre in the graph, centres where a search starts, and those of the best that it opens in any case.
LINKS, STARTS, OPENED = 16, 8, 24
#: Centres that a search holds for vectors and for queries (all of them, as there are no more).
WIDTH, QUERY_WIDTH = 32, 2500
#: Rows and queries of a list that one task compares; more are compared in blocks.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


def balanced_centres(x: np.ndarray, n_lists: int) -> np.ndarray:
    """Means of ``n_lists`` (rounded up to a power of two, at most so many rows) equal parts of ``x``.

    Each part is cut in two at the median along the line between its two-means centres,
    so that all parts have the same number of rows.
    """
    parts = [np.arange(len(x))]
    while len(parts) < n_lists and min(map(len, parts)) >= 2:
        halves = []
        for rows in parts:
            own = x[rows]
            # Two means from the mean and the row that is furthest from it.
            mean = own.mean(0)
            far = own[((own - mean) ** 2).sum(1).argmax()]
            a, b = far, 2 * mean - far
            for _ in range(6):
                near_a = ((own - a) ** 2).sum(1) <= ((own - b) ** 2).sum(1)
                if near_a.all() or not near_a.any():
                    break
                a, b = own[near_a].mean(0), own[~near_a].mean(0)
            order = np.argsort(own @ (b - a), kind="stable")
            half = len(rows) // 2
            halves += [rows[order[:half]], rows[order[half:]]]
        parts = halves
    return np.stack([x[rows].mean(0) for rows in parts])


class CentreGraph:
    """Centres with links to their nearest ones and some far ones, searched best first."""

    def __init__(self, centres: np.ndarray):
        self.centres = np.ascontiguousarray(centres, np.float64)
        n = len(centres)
        near = min(LINKS, n - 1)
        links = np.zeros((n, 0), np.int64)
        if near:
            norms = (self.centres**2).sum(1)
            rows = []
            for at in range(0, n, 512):
                d = norms[at : at + 512, None] + norms[None] - 2 * self.centres[at : at + 512] @ self.centres.T
                d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
                rows.append(np.argsort(d, axis=1, kind="stable")[:, :near])
            links, own = np.concatenate(rows), np.arange(n)
            # A ring and a long step keep all centres within reach of one another; what is linked already links to itself.
            for other in ((own + 1) % n, (own + max(1, n // 3)) % n):
                links = np.column_stack([links, np.where((links == other[:, None]).any(1), own, other)])
        self.links = links
        self.starts = np.unique(np.linspace(0, n - 1, min(STARTS, n)).astype(np.int64))

    def search(self, x: np.ndarray, width: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centres found of each row (-1: no more) and their distances, nearest first.

        Each row holds its ``width`` best centres so far and opens the nearest one that
        isn't open and is at most ``ratio`` times as far as the best one, until none is left.
        """
        n, width = len(x), min(width, len(self.centres))
        held = np.full((n, max(width, len(self.starts))), -1)
        far = np.full(held.shape, np.inf)
        held[:, : len(self.starts)] = self.starts
        far[:, : len(self.starts)] = np.sqrt(((self.centres[self.starts][None] - x[:, None]) ** 2).sum(-1))
        opened = np.zeros(held.shape, bool)
        going = np.arange(n)
        while len(going) and self.links.shape[1]:
            d = np.where(opened[going], np.inf, far[going])
            pick = d.argmin(1)
            # Some are opened in any case, so that a poor start finds its way.
            some = min(OPENED, far.shape[1]) - 1
            reach = np.maximum(ratio * far[going].min(1), np.partition(far[going], some, axis=1)[:, some])
            nearest_left = d[np.arange(len(going)), pick]
            go = np.isfinite(nearest_left) & (nearest_left <= reach)
            going, pick = going[go], pick[go]
            if not len(going):
                break
            opened[going, pick] = True
            new = self.links[held[going, pick]]
            new_far = np.sqrt(((self.centres[new] - x[going, None]) ** 2).sum(-1))
            known = (new[:, :, None] == held[going][:, None, :]).any(-1)
            new_far[known] = np.inf
            all_held, all_far = np.concatenate([held[going], new], 1), np.concatenate([far[going], new_far], 1)
            all_open = np.concatenate([opened[going], known], 1)
            best = np.argpartition(all_far, held.shape[1] - 1, axis=1)[:, : held.shape[1]]
            row = np.arange(len(going))[:, None]
            held[going], far[going], opened[going] = all_held[row, best], all_far[row, best], all_open[row, best]
        order = np.argsort(far, axis=1, kind="stable")
        row = np.arange(n)[:, None]
        held, far = held[row, order], far[row, order]
        return np.where(np.isfinite(far), held, -1)[:, :width], far[:, :width]


def _matrix(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of a column of vectors by dimension: their places and their values as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(size)
    return {int(d): (rows, flat[(ends[rows] - d)[:, None] + np.arange(d)]) for d in np.unique(size) for rows in [np.flatnonzero(size == d)]}


def _routing(graphs, width: int, copies: int, ratio: float, id_col: str, enough: int = 0, sizes=None):
    """Rows (id, dim, list, first) of vectors (id, vector): their lists by distance ratio; ``graphs`` is broadcast.

    Further lists follow, nearest first, until ``sizes`` (vectors of which a list is the
    first one, also broadcast) add up to ``enough``.
    """
    schema = pa.schema([(id_col, pa.int64()), ("dim", pa.int32()), ("list", pa.int32()), ("first", pa.bool_())])

    def rows_of(ids, dim, lists, first):
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), dim), pa.int32()), pa.array(lists, pa.int32()), pa.array(first)], schema=schema)

    def lists_of(x, dim):
        """Lists of each row, nearest first, and which of them are taken."""
        found, far = graphs.value[dim].search(x, width, ratio)
        good = (found >= 0) & (far <= ratio * far[:, :1])
        good[:, copies:] = False
        if enough:
            held = np.where(found >= 0, sizes.value[dim][found], 0)
            good |= (found >= 0) & (held.cumsum(1) - held < enough)
        return found, good, (held.sum(1) < enough if enough else np.zeros(len(x), bool))

    def route(batches):
        for batch in batches:
            ids = batch.column(id_col).to_numpy()
            for dim, (rows, x) in _matrix(batch.column("vector")).items():
                if dim not in graphs.value:  # too rare for the sample: one list
                    yield rows_of(ids[rows], dim, np.zeros(len(rows)), np.ones(len(rows), bool))
                    continue
                every = np.arange(len(graphs.value[dim].centres))
                for at in range(0, len(rows), 256):
                    found, good, short = lists_of(x[at : at + 256], dim)
                    which, place = np.nonzero(good & ~short[:, None])
                    yield rows_of(ids[rows[at + which]], dim, found[which, place], place == 0)
                    for k in np.flatnonzero(short):  # what the graph has found holds too few
                        yield rows_of(np.full(len(every), ids[rows[at + k]]), dim, every, every == found[k, 0])

    return route


def _fitting(n_sampled: int, n_vectors: int):
    def fit(batches):
        seen: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for dim, (_, x) in _matrix(batch.column("vector")).items():
                seen.setdefault(dim, []).append(x)
        for dim, parts in seen.items():
            x = np.concatenate(parts)
            x = x[np.lexsort(x.T)]
            wanted = min(len(x) // LEAST, round(len(x) / n_sampled * n_vectors / LIST))
            centres = balanced_centres(x, max(1, 1 << max(0, int(wanted).bit_length() - 1)))
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(centres), pa.int32()), pa.array(centres.tolist(), pa.list_(pa.float64()))], names=["dim", "centre"])

    return fit


def _comparing(top: int):
    """The ``top`` nearest rows of a block of a list for each of its queries."""
    schema = pa.schema([("query", pa.int64()), ("vector_row", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def compare(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return schema.empty_table()
        ((_, (q_at, q)),) = _matrix(queries["vector"]).items()
        ((_, (x_at, x)),) = _matrix(rows["vector"]).items()
        who, row = queries["query"].to_numpy()[q_at], rows["vector_row"].to_numpy()[x_at]
        ids = rows["ids"].combine_chunks()
        first = pa.compute.list_element(ids, 0).to_numpy()[x_at]
        keep, of, score = [], [], []
        for k in range(len(q)):
            d = np.sqrt(((x - q[k]) ** 2).sum(1))
            near = np.flatnonzero(d <= np.partition(d, top - 1)[top - 1]) if len(d) > top else np.arange(len(d))
            near = near[np.lexsort((first[near], d[near]))][:top]
            keep.append(near)
            of.append(np.full(len(near), who[k]))
            score.append(d[near])
        keep = np.concatenate(keep)
        return pa.Table.from_arrays([pa.array(np.concatenate(of)), pa.array(row[keep]), pa.array(np.concatenate(score)), ids.take(pa.array(x_at[keep])).cast(pa.list_(pa.int64()))], schema=schema)

    return compare


def sound(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part: with an id, and a vector that has only
    finite components and isn't zero."""
    v = F.col(vector)
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return rows.where(F.coalesce(good, F.lit(False)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector"))


def nearest(queries: DataFrame, candidates: DataFrame, top: int = 10, prune: float = PRUNE) -> DataFrame:
    """The ``top`` nearest rows of ``candidates`` for each of ``queries`` (both vec_id, vector; see ``sound``).

    Result (query_id, rank, vec_id, score): the Euclidean distance in double precision,
    ties to the smaller id.  A query's own row is no candidate of its own.

    Equal vectors become one row with their ``top + 1`` smallest ids, which is all that
    any answer can name, before anything is shuffled, so copies don't meet.  Centres are
    made of a sample (about 20,000 vectors by hash; the only thing that is fitted) as
    means of equal parts; every vector is put in the list of its nearest centre and, near
    a boundary, of up to three more.  A graph over the centres (at most 2,500 of a
    dimension, sent to all tasks) finds the lists of vectors and of queries; a query reads
    those whose centre is at most ``prune`` times as far as the nearest one, and further
    ones until they hold ``top`` other vectors.  Lists are
    compared in blocks of 4,096 rows and 1,024 queries, whole, so a large list is no
    large task.

    Vectors are near only to those of the same length; one of a length that the sample
    lacks is in the only list of its length.  Rows that repeat id and vector are
    candidates of one another; as queries they give one answer.  An id with several
    vectors asks once for each.  Empty tables give none.
    """
    spark = candidates.sparkSession
    bounded_batches(spark)
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    distinct = candidates.withColumn("nth", nth).where(F.col("nth") <= top + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # The checkpoint fixes the numbers of the rows.
    vectors = settled(distinct.withColumn("vector_row", F.monotonically_increasing_id()))
    n = vectors.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = settled(vectors.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 40)) < int(share * (1 << 40))).select("vector"))
    n_sampled = sample.count()
    fitted = sample.coalesce(1).mapInArrow(_fitting(max(1, n_sampled), n), "dim int, centre array<double>").collect()
    centres: dict[int, list] = {}
    for r in fitted:
        centres.setdefault(r.dim, []).append(r.centre)
    graphs = spark.sparkContext.broadcast({dim: CentreGraph(np.array(c)) for dim, c in centres.items()})

    asked = settled(queries.select("vector").distinct().select(F.monotonically_increasing_id().alias("query"), F.col("vector").alias("vector")))
    routed = "long, dim int, list int, first boolean"
    postings = settled(vectors.select("vector_row", "vector").mapInArrow(_routing(graphs, WIDTH, COPIES, BOUNDARY, "vector_row"), f"vector_row {routed}"))
    own = {dim: np.zeros(len(c), np.int64) for dim, c in centres.items()}
    for r in postings.where("first").groupBy("dim", "list").count().where(F.col("dim").isin(list(own))).collect():  # a row a list
        own[r.dim][r.list] = r["count"]
    probes = settled(asked.mapInArrow(_routing(graphs, QUERY_WIDTH, QUERY_WIDTH, prune, "query", top + 1, spark.sparkContext.broadcast(own)), f"query {routed}"))
    part = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    sizes = settled(
        postings.groupBy("dim", "list").agg(F.count("*").alias("rows")).join(probes.groupBy("dim", "list").agg(F.count("*").alias("asked")), ["dim", "list"])
        .select("dim", "list", part("rows", BLOCK_ROWS).alias("blocks"), part("asked", BLOCK_QUERIES).alias("q_blocks"))
    )
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
    key = ["dim", "list", "block", "q_block"]
    dealt_rows = postings.join(sizes, ["dim", "list"]).select("dim", "list", one("vector_row", "blocks").alias("block"), every("q_blocks").alias("q_block"), "vector_row").join(vectors, "vector_row")
    dealt_asked = probes.join(sizes, ["dim", "list"]).select("dim", "list", every("blocks").alias("block"), one("query", "q_blocks").alias("q_block"), "query").join(asked, "query")
    found = dealt_asked.groupBy(*key).cogroup(dealt_rows.groupBy(*key)).applyInArrow(_comparing(top + 1), "query long, vector_row long, score double, ids array<long>")
    # A vector of several lists is found several times.
    once = found.groupBy("query", "vector_row").agg(F.min("score").alias("score"), F.first("ids").alias("ids"))
    nearer = Window.partitionBy("query").orderBy("score", "vec_id")
    best = once.select("query", "score", F.explode("ids").alias("vec_id")).withColumn("nth", F.row_number().over(nearer)).where(F.col("nth") <= top + 1)
    answers = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found")).join(asked, "query").select("vector", "found")
    itself = F.array_position(F.col("found.vec_id"), F.col("vec_id"))
    others = F.slice(F.filter("found", lambda x, i: i + 1 != itself), 1, top)
    named = queries.distinct().join(answers, "vector").select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return named.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def query(spark, sf_dir):
    rows = sound(read(spark, sf_dir, "embeddings"))
    return nearest(rows.where(F.col("vec_id") % 100 == 0), rows)
