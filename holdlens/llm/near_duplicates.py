"""MinHash near-duplicate detection: one-permutation sketches, stars in banded buckets, exact confirmation.

1. Each text becomes the set of its word shingles; texts with one set form a class,
   and only classes go on. One permutation puts a set's hashes into equal bins; a bin's
   smallest hash is its value, and an empty bin takes the value of the first filled one
   in an order of its own, the same for all sets (optimal densification).
2. Bands of bins give bucket keys. In a bucket, members are compared with a centre
   only, never all with all. The centre is the member that meets most others in all
   its buckets, so a common ancestor of many variants is the centre of all of them.
3. Links are confirmed on the full sets. Members i, j that both link to their centre c are
   connected. If i doesn't, i and j can only link if they share enough of what
   sets them apart from c (shingles that they add, or lack): with R of c's shingles lacking in j
   and A added, more than (100 R + p A) / (100 + p) of these R + A for a threshold of p percent.
   So one of any R + A - that + 1 of them is shared, and a join of those with
   all that sets i apart finds every such pair, to be confirmed too. So a bucket loses no link.
   What only one member adds or lacks can't be shared and is left out, the rarest in the star are asked first, so
   stock edits meet seldom, and sets too small without what they alone add are no pair. Stars whose members are in one component already are done.
   Sets are sets of 64-bit hashes of shingles, on which links are confirmed.

A pair at exactly the threshold shares no bucket with probability
``(1 - 0.8 ** rows) ** bands``: 3e-6 for 32 bands of 5 bins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdlens.llm.cluster import cut
from holdlens.llm.components import connected_components
from holdlens.llm.words import SPACED, mix, shingles, steps, words

U = np.uint64


class Sketcher:
    """One-permutation sketches of sorted sets of 64-bit hashes."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(77)
        self.donors = np.argsort(rng.random((self.bins, self.bins)), axis=1)
        self.edges = np.array([(b << 64) // self.bins for b in range(self.bins)], np.uint64)
        self.codes = rng.integers(1, 2**63, (bands, rows), dtype=np.uint64) | U(1)

    def values(self, hashes: np.ndarray) -> np.ndarray:
        """The value of each bin of a set that isn't empty."""
        first = np.searchsorted(hashes, self.edges)
        filled = np.diff(first, append=len(hashes)) > 0
        out = hashes[np.minimum(first, len(hashes) - 1)]
        if not filled.all():
            empty = np.flatnonzero(~filled)
            order = self.donors[empty]
            out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(1)]]
        return out

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """A bucket key for each band."""
        parts = mix(self.values(hashes).reshape(self.bands, self.rows) * self.codes)
        return mix(parts.sum(1, dtype=np.uint64) + np.arange(1, self.bands + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)).view(np.int64)


def _sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    for a, b, data, offsets in steps(texts):
        w = words(data, offsets, SPACED)
        for i in range(b - a):
            yield shingles(w.hash[w.rows[i] : w.rows[i + 1]], shingle)


def _node(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """``(doc_id, n_shingles, node, keys)``; node: 16 bytes that stand for the set, null if it is empty."""

    def run(batches):
        sketcher = Sketcher(bands, rows)
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for s in _sets(batch.column("text"), shingle):
                sizes.append(len(s))
                nodes.append(_node(s) if len(s) else None)
                keys.append(sketcher.keys(s) if len(s) else None)
            if sizes:
                yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "node", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, node binary, keys array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``(node, hashes)`` of the nodes in ``wanted(node, doc_id)``."""

    def run(batches):
        for batch in batches:
            found = [(_node(s), s.tobytes()) for s in _sets(batch.column("text"), shingle) if len(s)]
            if found:
                yield pa.record_batch([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], ["node", "hashes"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # null ids can't be joined; the nodes tell which of their sets are wanted
    texts = texts.join(wanted.select("doc_id"), "doc_id").unionByName(texts.where("doc_id is null"))
    made = texts.mapInArrow(run, "node binary, hashes binary")
    # a doc_id that stands for several texts brings sets that nobody wants
    return made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in ``y``; both are sorted."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(left, "a").join(right, "b")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = int(_common(x, y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _against_centres(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b, main, linked, n, lacking, centre, shared, added, lacked)`` of member a and centre b, see the module.

    main: a's heaviest centre; n and centre: sizes of their sets; lacking: R; shared: what a partner must have in common of what sets
    a apart: added, what a has and b lacks, and lacked, the reverse. Where ``alone``, a is b's only member, and both are null.
    """

    def run(batches):
        for batch in batches:
            linked, sizes, more, less = [], [], [], []
            for x, y, alone in zip(batch.column("x"), batch.column("y"), batch.column("alone").to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                linked.append(_linked(x, y, percent))
                if alone:
                    sizes.append((len(x), 0, len(y), 0))
                    more.append(None)
                    less.append(None)
                    continue
                added, lacking = x[~_common(x, y)], y[~_common(y, x)]
                # a partner isn't linked with the centre and not much smaller than x
                shared = max((100 * len(lacking) + percent * len(added)) // (100 + percent) + 1, -(-percent * len(x) // 100) - len(y) + len(lacking))
                sizes.append((len(x), len(lacking), len(y), shared))
                more.append(added.view(np.int64))
                less.append(lacking.view(np.int64))
            if not linked:
                continue
            yield pa.record_batch([batch.column("a"), batch.column("b"), batch.column("main"), pa.array(linked, pa.bool_()), *(pa.array(z, pa.int64()) for z in zip(*sizes, strict=True)), pa.array(more, pa.list_(pa.int64())), pa.array(less, pa.list_(pa.int64()))], ["a", "b", "main", "linked", "n", "lacking", "centre", "shared", "added", "lacked"])

    made = _with_sets(pairs, sets).select("a", "b", "main", "alone", "x", "y")
    return made.mapInArrow(run, "a binary, b binary, main binary, linked boolean, n long, lacking long, centre long, shared long, added array<long>, lacked array<long>")


def _between_members(stars: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: pairs of members of a star that may be linked although their components ``comps`` aren't one yet."""
    stars = stars.where("added is not null").join(comps.select(F.col("node").alias("a"), F.col("label").alias("comp")), "a", "left").withColumn("comp", F.coalesce("comp", "a"))
    parted = cut(stars.groupBy("b").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("b"))
    stars = cut(stars.join(parted, "b", "left_semi"))
    tagged = F.concat(F.transform("added", lambda x: F.struct(F.lit(True).alias("adds"), x.alias("feature"))), F.transform("lacked", lambda x: F.struct(F.lit(False).alias("adds"), x.alias("feature"))))
    each = stars.select("b", "a", F.explode(tagged).alias("x")).select("b", "a", "x.*")
    times = each.groupBy("b", "adds", "feature").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    told = each.join(times, ["b", "adds", "feature"]).groupBy("b", "a").agg(F.sort_array(F.collect_list(F.struct("times", "adds", "feature"))).alias("told"))
    also = F.size(F.filter("told", lambda x: x["adds"]))
    members = cut(stars.drop("added", "lacked").join(told, ["b", "a"]).withColumn("most", F.col("centre") - F.col("lacking") + also))
    row = lambda side, *more: members.select("b", F.col("a").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("comp", "main", "linked", "n", "lacking", "most")), *more)
    apart = row("i", "centre", F.explode("told").alias("x")).where("not linked_i").select("*", "x.adds", "x.feature").drop("x", "linked_i")
    first = F.greatest(F.size("told") - F.col("shared") + 1, F.lit(0)).cast("int")
    spare = (F.size("told") - first).alias("spare")
    probe = row("j", spare, F.explode(F.slice("told", F.lit(1), first)).alias("x")).select("*", "x.adds", "x.feature").drop("x")
    # a pair with one main centre is looked at there only, where least sets them apart; one of two that aren't linked, from one side
    wanted = f"comp_i != comp_j and (main_i != main_j or b = main_i) and (linked_j or i < j) and (100 + {percent}) * least(most_i, most_j) >= {percent} * (n_i + n_j)"
    shared = probe.join(apart, ["b", "adds", "feature"]).where(wanted).groupBy("b", "i", "j", "n_i", "n_j", "lacking_i", "lacking_j", "centre", "spare").agg(F.count(F.lit(1)).alias("found"))
    needed = F.floor((percent * (F.col("n_i") + F.col("n_j")) + 99 + percent) / (100 + percent)) - F.col("centre") + F.col("lacking_i") + F.col("lacking_j")
    return shared.where(F.col("found") + F.col("spare") >= needed).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs(a, b)``, those with 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            keep = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_sets(pairs, sets).select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each row of ``docs(doc_id, text)``.

    Words are runs of anything but ASCII white space, A-Z as a-z. A null or blank text has
    an empty set, is linked with nothing and keeps its own doc_id. component_id is the smallest doc_id that
    links reach; null ids are passed over unless there are no others. Rows that
    repeat a doc_id with one text are one document; kept: doc_id equals component_id,
    null with null. Other columns are not read. An empty table gives an empty table.
    """
    known = cut(sketches(docs, shingle, bands, rows))
    nodes = known.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    members = nodes.select(F.explode("keys").alias("key"), "node", "doc_id")
    crowded = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut(members.join(crowded, "key"))
    met = cut(members.groupBy("node").agg(F.sum("size").alias("weight"), F.first("doc_id").alias("doc_id")))
    sets = cut(_full_sets(docs, met.select("node", "doc_id"), shingle))
    weighed = members.select("key", "node").join(met.select("node", "weight"), "node")
    centre = weighed.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top")).select("key", F.col("top.node").alias("b"), F.col("top.weight").alias("wb"))
    pairs = cut(members.select("key", F.col("node").alias("a")).join(centre, "key").where("a != b").select("a", "b", "wb").distinct())
    # cut, so that nothing but an exchange lies below joins by a centre and hot centres can be split there
    crowd = cut(pairs.groupBy("b").agg((F.count(F.lit(1)) == 1).alias("alone")))
    main = pairs.groupBy("a").agg(F.max_by("b", F.struct("wb", "b")).alias("main"))
    stars = cut(_against_centres(pairs.join(crowd, "b").join(main, "a"), sets, percent))
    links = stars.where("linked").select("a", "b")
    begun = connected_components(links)
    between = _between_members(stars, begun, percent)
    more = cut(_confirmed(between, sets, percent))
    labels = begun if more.isEmpty() else connected_components(links.unionByName(more))
    linked = nodes.select("node", "doc_id").join(labels, "node")
    least = cut(linked.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    linked = linked.join(least, "label").select("node", "component_id")
    named = nodes.select("node", "doc_id").join(linked, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = known.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The row of ``docs`` with each component's smallest doc_id, and those linked with nothing; the columns stay.

    Of rows with equal doc_id and text one stays, chosen by a hash of all its columns.
    """
    id_of = lambda c: (F.coalesce(F.col(c).cast("long"), F.lit(0)).alias("id"), F.col(c).isNull().alias("no_id"))
    kept = near_duplicates(docs, **options).where("kept").select(*id_of("doc_id")).distinct()
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *id_of("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    # equal rows meet where the join has put them
    place = F.row_number().over(Window.partitionBy("id", "no_id", "text_hash").orderBy(F.xxhash64("row")))
    return keyed.join(kept, ["id", "no_id"], "left_semi").withColumn("place", place).where("place = 1").select("row.*")
