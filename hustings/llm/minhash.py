"""Near duplicates: SuperMinHash, banding, verification, union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.llm import shingles as S
from hustings.llm.common import boxed, narrow, read, released, settled, unboxed

#: 32 bands of 4: a pair of similarity 0.8 misses all bands once in 20 million times.
BANDS, ROWS = 32, 4


def super_minhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, m: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash signatures (n_sets x m) of sets of 64-bit elements.

    Each element draws one random permutation of the m places, a place a level, and
    offers level + fraction there; a place keeps its least offer.  All elements go
    through a level together, and a set stops when each of its places holds an offer
    below the next level, which no later level can beat.  Values are the level in
    the upper bits and 40 bits of fraction.
    """
    out = np.full((n_sets, m), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    earlier: list[np.ndarray] = []  # the swaps of the levels so far
    for level in range(m):
        if not len(elements):
            break
        draw = S.mix(elements + np.uint64((2 * level + 1) * int(S.STEP) & (1 << 64) - 1))
        swap = level + ((draw >> np.uint64(40)) % np.uint64(m - level)).astype(np.int64)
        place = swap.copy()
        for k in range(level - 1, -1, -1):  # what the swaps so far have left at that place
            np.copyto(place, k, where=earlier[k] == place)
        earlier.append(swap)
        value = np.uint64(level << 40) | (draw & np.uint64((1 << 40) - 1))
        np.minimum.at(flat, owner * m + place, value)
        going = out.max(axis=1) >= np.uint64((level + 1) << 40)
        stay = going[owner]
        kept = int(np.count_nonzero(stay))
        if kept < 0.7 * len(stay):
            elements, owner = elements[stay], owner[stay]
            earlier = [e[stay] for e in earlier]
    return out


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of each signature; different bands never share one by design."""
    held = np.broadcast_to(S.mix(np.arange(1, bands + 1, dtype=np.uint64) * S.STEP), (len(signatures), bands)).copy()
    parts = signatures.reshape(len(signatures), bands, rows)
    for k in range(rows):
        held = S.mix(held * S.STEP + parts[:, :, k])
    return held.view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set hash (two longs) and band hashes of every row."""

    def sign(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            size, one, two, keys = [], [], [], []
            for part in S.chunks(texts):
                held, cuts = S.shingle_sets(texts[part], n)
                count = np.diff(cuts)
                owner = np.repeat(np.arange(len(count)), count)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(held)])
                more = np.concatenate([np.zeros(1, np.uint64), np.cumsum(S.mix(held ^ S.BASE))])
                size.append(count)
                one.append((sums[cuts[1:]] - sums[cuts[:-1]]).view(np.int64))
                two.append((more[cuts[1:]] - more[cuts[:-1]]).view(np.int64))
                keys.append(band_hashes(super_minhash(held, owner, len(count), bands * rows), bands, rows))
            join = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), kind)
            flat = join([k.reshape(-1) for k in keys], pa.int64())
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), join(size, pa.int64()), join(one, pa.int64()), join(two, pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                ["doc_id", "n_shingles", "set_one", "set_two", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, set_one long, set_two long, bands array<long>")


def _with_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, set): the full shingle set, packed, of the documents whose id is asked for."""

    def pack(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            sets = []
            for part in S.chunks(texts):
                held, cuts = S.shingle_sets(texts[part], n)
                sets += [held[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    asked = docs.join(ids.select(F.col("id").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    # Rows that repeat an id have to give one row: the pairs are between ids.
    return asked.select("doc_id", "text").mapInArrow(pack, "id long, set binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, either): exact sizes of intersection and union of each pair's sets."""

    def compare(batches):
        for batch in batches:
            common, either = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # two ordered runs
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                common.append(same)
                either.append(len(both) - same)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(common, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "common", "either"])

    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long, common long, either long")


def _union_find(batches, roots: bool = False):
    """Reduce the edges of a task to (node, least node of its group in the task), with or without those least nodes themselves."""
    up: dict[int, int] = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    found = [(x, root(x)) for x in up]
    found = [x for x in found if roots or x[0] != x[1]]
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])


#: Edges to a task of union-find: a few MB, whatever the number of tasks that found them.
EDGES = 50_000


def components(edges: DataFrame, per_task: int = EDGES) -> DataFrame:
    """(id, label): the least id of the connected component of each id in ``edges`` (a, b).

    Union-find inside tasks shrinks the edges to forests, first where the edges are and
    then in as many tasks as they fill with ``per_task`` each.  Where that is more than one,
    large-star and small-star rounds over all edges join what tasks could not see, until
    nothing changes, which takes as many rounds as the square of the logarithm of the
    longest chain.  A round deals everything out several times, so few edges cost far more
    in rounds, by files and tasks, than by their bytes.
    Edges that repeat, or lead from an id to itself, change nothing; ids have no null;
    ids without an edge to another one have no row, and no edges give none.
    """
    stars = settled(edges.select("a", "b").where("a <> b").mapInArrow(_union_find, "a long, b long"))
    tasks = max(1, -(-stars.count() // per_task))
    released(edges.sparkSession)
    if tasks == 1:
        whole = stars.coalesce(1).mapInArrow(lambda batches: _union_find(batches, roots=True), "a long, b long")
        return whole.select(F.col("a").alias("id"), F.col("b").alias("label"))
    stars = settled(stars.coalesce(tasks).mapInArrow(_union_find, "a long, b long"))
    before = None
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = settled(small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        released(edges.sparkSession)
        after = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            return stars.select(F.col("a").alias("id"), F.col("b").alias("label")).union(stars.select(F.col("b").alias("id"), F.col("b").alias("label"))).distinct()
        before = after


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their sets
    of n-word shingles; a component is all that links reach, named by its least id.

    Equal sets are one class, represented by its least id.  Classes that share a
    band are candidates.  A bucket is compared with one member first, which takes as
    many pairs as members, then once more with the member that has most shingles in
    common with others.  Where the components so found still differ inside a bucket,
    its members are looked up by their rarest shingles (``_prefix_pairs``), which
    finds every link there is between components.  So no pair that shares a band is
    lost, and no group is spread out into its pairs.  Links are confirmed on the full sets.

    Null and empty texts have no shingles and are linked with nothing; a null id is
    linked with nothing; rows that repeat an id share its component; a very long text is
    one set, read whole; an empty table gives no rows.
    """
    texts = narrow(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = settled(signatures(texts, n, bands, rows))
    real = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    key = ["n_shingles", "set_one", "set_two"]
    classes = real.groupBy(*key).agg(F.min("doc_id").alias("id"))
    # The bands of a class are those of its least member (equal sets have equal ones).
    members = real.join(classes.select(F.col("id").alias("doc_id"), *key), ["doc_id", *key], "left_semi").dropDuplicates(["doc_id", *key])
    in_bands = members.select(F.explode("bands").alias("band"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    hubs = in_bands.groupBy("band").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1").select("band", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"))
    together = settled(in_bands.join(hubs, "band"))
    # Sizes that differ too much can't be similar enough, and need no texts.
    fair = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    stars = settled(together.where((F.col("id") != F.col("hub")) & fair).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    # Every class of a bucket may be asked for again; sets are packed once.
    sets = settled(_with_sets(texts, together.select("id"), n).dropDuplicates(["id"]))
    linked = F.col("common") * 100 >= F.col("either") * percent
    links = settled(verified(stars, sets).where(linked).select("a", "b"))
    labels = settled(components(links))
    del links
    for more in (_second_stars, _prefix_pairs):
        released(docs.sparkSession)  # full sets went through the exchanges so far
        rest = _mixed(together, labels, sets)
        if rest is None:
            break
        pairs = settled(more(rest, sets, percent).join(stars, ["a", "b"], "left_anti"))
        found = settled(verified(pairs, sets).where(linked).select("a", "b"))
        if not found.isEmpty():
            labels = settled(components(found.union(labels.select(F.col("id").alias("a"), F.col("label").alias("b")))))
        stars = stars.union(pairs)
    # A class takes the label of its component; its own id if it has no links.
    named = classes.join(labels, "id", "left").select(*key, F.coalesce("label", "id").alias("component_id"))
    # Classes without links or copies need no join partner: they are all of their rows.
    out = signed.join(named, key, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


#: Parts of a profile, and the number of documents from which a shingle is common.
PARTS, COMMON = 32, 64


def _mixed(together: DataFrame, labels: DataFrame, sets: DataFrame):
    """What is open after the comparisons so far: buckets whose members differ in label.

    Gives (band, id, n, label, profile).  A profile counts, by hash and by whether they
    are common, the shingles of a document that any other one here has.  Shingles
    that two documents share fall into the same parts of both profiles, so the sum of
    the lesser counts is an upper bound of their intersection, and a close one.  None
    if nothing is open.
    """
    rows = together.join(labels, "id", "left").select("band", "id", "n", F.coalesce("label", "id").alias("label"))
    mixed = rows.groupBy("band").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("band")
    rows = settled(rows.join(mixed, "band", "left_semi"))
    if rows.isEmpty():
        return None

    shingles = _shingles(sets, rows)
    known = shingles.groupBy("shingle").agg(F.count("*").alias("documents")).where("documents > 1")
    part = F.pmod(F.shiftright("shingle", 20), F.lit(PARTS)) + F.when(F.col("documents") >= COMMON, PARTS).otherwise(0)
    marked = shingles.join(known, "shingle").select("id", part.cast("int").alias("part"))
    profiles = marked.groupBy("id").agg(F.array(*(F.count_if(F.col("part") == k).cast("int") for k in range(2 * PARTS))).alias("profile"))
    return settled(rows.join(profiles, "id"))


def _shingles(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, shingle) of the documents in ``rows``."""

    def unpack(batches):
        for batch in batches:
            held = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(held)), [len(x) for x in held])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(held) if held else np.zeros(0, np.int64))], ["id", "shingle"])

    return sets.join(rows.select("id").distinct(), "id", "left_semi").mapInArrow(unpack, "id long, shingle long")


def _may_link(percent: int):
    """Whether sizes, then profiles, leave room for a link of the sides _a and _b."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    common = F.aggregate(F.zip_with("profile_a", "profile_b", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (common * 100 >= (n_a + n_b - common) * percent)


def _sides(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("band", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "label", "profile")))


def _second_stars(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each bucket's members with the one that has most in common with others."""
    shared = F.aggregate("profile", F.lit(0), lambda total, x: total + x)
    best = rows.groupBy("band").agg(F.max(F.struct(shared.alias("shared"), F.negative("id").alias("minus"))).alias("best"))
    hubs = rows.join(best, "band").where(F.col("id") == -F.col("best.minus"))
    pairs = _sides(rows, "b").join(_sides(hubs, "a"), "band").where((F.col("label_a") != F.col("label_b")) & _may_link(percent))
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _prefix_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels that can be linked: they share one of their rarest shingles.

    With its shingles ordered from rare to common, a document of n shingles shares with
    whatever it is linked to one of the first n - ceil(n * percent / 100) + 1.  Those are
    joined.  What stands behind a shared one bounds the intersection, and so which sizes
    a partner may have: the join is by size as well.  Shingles that no other document
    has take places but join nothing, so documents that differ in words of their own
    drop out.  Of a shingle's holders the most frequent label meets the others only.
    """
    shared = F.aggregate("profile", F.lit(0), lambda total, x: total + x)
    alive = rows.where(shared * 100 >= F.col("n") * percent)
    mixed = settled(alive.groupBy("band").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("band"))
    ids = settled(alive.join(mixed, "band", "left_semi").select("id", "n", "label").distinct())
    shingles = _shingles(sets, ids)
    known = settled(shingles.groupBy("shingle").agg(F.count("*").alias("documents")).where("documents > 1"))
    own = Window.partitionBy("id")
    # Rarest first; those that nobody else has come before all others.
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("documents", "shingle"))
    placed = shingles.join(known, "shingle").join(ids, "id").select("id", "n", "label", "shingle", place.alias("place"))
    least = F.expr(f"(n * {percent} + 99) div 100")
    rest = F.col("n") - F.col("place") + 1
    most = F.least(F.expr(f"n * 100 div {percent}"), F.floor(rest * (100 + percent) / percent) - F.col("n"))
    entries = settled(
        placed.withColumns({"low": least, "high": most}).where((F.col("place") <= F.col("n") - F.col("low") + 1) & (F.col("high") >= F.col("low"))).select("id", "n", "label", "shingle", "low", "high")
    )
    by_label = entries.groupBy("shingle", "label").agg(F.count("*").alias("holders"))
    tops = settled(by_label.groupBy("shingle").agg(F.max(F.struct("holders", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("shingle", F.col("top.label").alias("top")))
    step = lambda c: F.floor(F.log(F.col(c).cast("double")) / F.log(F.lit(1.1))).cast("int")  # noqa: E731  sizes within a tenth
    side = lambda df, x: df.select("shingle", "step", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "label", "low", "high")))
    few = entries.join(tops, "shingle").where(F.col("label") != F.col("top")).withColumn("step", F.explode(F.sequence(step("low"), step("high"))))
    every = entries.join(tops, "shingle", "left_semi").withColumn("step", step("n"))
    fits = F.col("n_b").between(F.col("low_a"), F.col("high_a")) & F.col("n_a").between(F.col("low_b"), F.col("high_b"))
    pairs = side(few, "a").join(side(every, "b"), ["shingle", "step"]).where((F.col("label_a") != F.col("label_b")) & fits)
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def stage(spark, docs, sf_dir):
    """One document of each group stays, the one with the least id.

    Null and empty texts stay, as do rows without an id; of rows that repeat an id
    that stays all stay; very long texts are compared whole; an empty table stays empty;
    columns can have any name.
    """
    groups = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    rows = boxed(docs)
    kept = rows.join(groups, F.col("row.doc_id").cast("long") == F.col("doc_id"), "left_semi")
    return unboxed(kept.union(rows.where(F.col("row.doc_id").isNull())))


def query(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"), n=4, percent=80)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x : x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i : array_to_string(ws[i:i+3], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS low FROM documents UNION SELECT u.b, r.low FROM r JOIN u ON u.a = r.id WHERE r.low < u.b),
m AS (SELECT id, min(low) AS component_id FROM r GROUP BY id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m ON m.id = n.doc_id
"""
