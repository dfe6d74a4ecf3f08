"""Exact top-k lexical search of many queries at once, with the work that queries share done once.

Queries of a block are mined for term sets that several of them have: each is a list of terms, commonest first, and neighbours that
occur together in two or more queries become one symbol, again and again. The symbols are a graph whose inner nodes add two others. For a
step of documents each node is an accumulator, a score a document, made once from its two parts; a query adds what few symbols it has left.
Documents are read twice: once as texts, for counts and for postings of the queries' terms, and once as postings. Only each task's
best rows leave it.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdlens.llm.words import ALNUM, steps, words
from holdlens.sources.shared import written

TOP = 10
#: Terms of queries in one block, with repeats; it bounds what is broadcast. Further queries make further blocks.
BLOCK_TERMS = 1 << 16
#: Numbers in the accumulators of one step of documents.
STEP_CELLS = 1 << 22


@dataclass
class Plan:
    """Symbols below ``n_terms`` are terms; symbol ``n_terms + i`` adds the two of ``pairs[i]``. ``queries``: what each one adds."""

    n_terms: int
    pairs: list[tuple[int, int]]
    queries: list[list[int]]

    @property
    def size(self) -> int:
        return self.n_terms + len(self.pairs)


def share(queries: list[list[int]], n_terms: int) -> Plan:
    """A plan of ``queries``, sets of terms below ``n_terms``: neighbours that two or more have become symbols, until none are left."""
    often = Counter(t for q in queries for t in q)
    lists = [sorted(q, key=lambda t: (-often[t], t)) for q in queries]
    pairs: list[tuple[int, int]] = []
    while True:
        count = Counter(p for q in lists for p in zip(q, q[1:]))
        named: dict[tuple[int, int], int] = {}
        after = []
        for q in lists:
            out, i = [], 0
            while i < len(q):
                pair = tuple(q[i : i + 2])
                # the pair with the next one may be the better
                if count[pair] > 1 and count[pair] >= count[tuple(q[i + 1 : i + 3])]:
                    if pair not in named:
                        named[pair] = n_terms + len(pairs)
                        pairs.append(pair)
                    out.append(named[pair])
                    i += 2
                else:
                    out.append(q[i])
                    i += 1
            after.append(out)
        if not named:
            return Plan(n_terms, pairs, lists)
        lists = after


def accumulate(plan: Plan, terms: np.ndarray) -> np.ndarray:
    """Scores of each query and document from ``terms``, contributions of each term and document."""
    acc = np.empty((plan.size, terms.shape[1]), np.int64)
    acc[: plan.n_terms] = terms
    for i, (a, b) in enumerate(plan.pairs):
        np.add(acc[a], acc[b], out=acc[plan.n_terms + i])
    out = np.zeros((len(plan.queries), terms.shape[1]), np.int64)
    for i, q in enumerate(plan.queries):
        for symbol in q:
            out[i] += acc[symbol]
    return out


def _blocks(items: DataFrame, block_terms: int):
    """Lists of (item_id, sorted hashes of its terms), each of about ``block_terms`` hashes."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in steps(batch.column("text")):
                w = words(data, offsets, ALNUM)
                found = [np.unique(w.hash[w.rows[i] : w.rows[i + 1]]).view(np.int64) for i in range(b - a)]
                yield pa.record_batch([batch.column("item_id").slice(a, b - a), pa.array(found, pa.list_(pa.int64()))], ["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    found = items.select("item_id", F.col("text").cast("string")).mapInArrow(run, f"item_id {kind}, terms array<long>")
    whole = found.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    block, size = [], 0
    for r in whole.orderBy("item_id").toLocalIterator():
        if r.terms:
            block.append((r.item_id, np.sort(np.array(r.terms, np.int64).view(np.uint64))))
            size += len(r.terms)
        if size >= block_terms:
            yield block
            block, size = [], 0
    if block:
        yield block


def _postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``(doc_id, n, terms, tf)`` of each document with a term: all its terms counted, those of ``vocabulary`` by number."""
    present = np.zeros(1 << 16, bool)
    present[vocabulary & np.uint64(0xFFFF)] = True
    known = docs.sparkSession.sparkContext.broadcast((vocabulary, present))

    def run(batches):
        vocabulary, present = known.value
        for batch in batches:
            for a, b, data, offsets in steps(batch.column("text")):
                w = words(data, offsets, ALNUM)
                hit = np.flatnonzero(present[w.hash & np.uint64(0xFFFF)])
                at = np.minimum(np.searchsorted(vocabulary, w.hash[hit]), len(vocabulary) - 1)
                same = vocabulary[at] == w.hash[hit]
                row = np.searchsorted(w.rows, hit[same], side="right") - 1
                pair, tf = np.unique(row * len(vocabulary) + at[same], return_counts=True)
                ends = np.searchsorted(pair, np.arange(b - a + 1) * len(vocabulary)).astype(np.int32)
                n = np.diff(w.rows)
                of_row = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x, pa.int32()))  # noqa: B023, E731
                out = pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), of_row(pair % len(vocabulary)), of_row(tf)], ["doc_id", "n", "terms", "tf"])
                yield out.filter(pa.array(n > 0))

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")
    return written(found, "postings")


def _document_counts(postings: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term; a task's counts are one row a term."""

    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(df[at])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in postings.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.term] = r.df
    return out


class _Best:
    """The best documents of each query so far: higher scores first, then smaller ids, nulls last."""

    def __init__(self, queries: int, top: int):
        self.top = top
        self.score = [np.empty(0, np.int64)] * queries
        self.id = [np.empty(0, np.int64)] * queries
        self.null = [np.empty(0, bool)] * queries
        self.least = np.zeros(queries, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        hits = (scores > 0) & (scores >= self.least[:, None])
        for q in np.flatnonzero(hits.any(1)):
            at = np.flatnonzero(hits[q])
            s, i, z = np.append(self.score[q], scores[q, at]), np.append(self.id[q], ids[at]), np.append(self.null[q], null[at])
            order = np.lexsort((i, z, -s))[: self.top]
            self.score[q], self.id[q], self.null[q] = s[order], i[order], z[order]
            if len(order) == self.top:
                self.least[q] = s[order[-1]]


def _rank_block(docs: DataFrame, block: list, top: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = np.unique(np.concatenate([terms for _, terms in block]))
    postings = _postings(docs, vocabulary)
    totals = postings.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_all = totals.docs, totals.terms or 0
    df = _document_counts(postings, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    plan = share([[int(t) for t in np.searchsorted(vocabulary, terms) if df[t]] for _, terms in block], len(vocabulary))
    shared = spark.sparkContext.broadcast((plan, weight))

    def run(batches):
        plan, weight = shared.value
        best = _Best(len(plan.queries), top)
        rows = max(1, STEP_CELLS // (plan.size + len(plan.queries)))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                n = part.column("n").to_numpy()
                lists = part.column("terms")
                doc = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
                term, tf = lists.flatten().to_numpy(), part.column("tf").flatten().to_numpy().astype(np.int64)
                m = 100 - 90 + (90 * n * n_docs) // n_all
                terms = np.zeros((plan.n_terms, len(n)), np.int64)
                terms[term, doc] = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                ids = part.column("doc_id")
                best.add(accumulate(plan, terms), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        for q in range(len(plan.queries)):
            if len(best.score[q]):
                yield pa.record_batch([pa.array(np.full(len(best.score[q]), q, np.int64)), pa.array(best.id[q], pa.int64(), mask=best.null[q]), pa.array(best.score[q])], ["query", "doc_id", "score"])

    found = postings.mapInArrow(run, "query long, doc_id long, score long")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of ``docs(doc_id, text)`` for each of ``items(item_id, text)``.

    Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z as a-z; they are told apart by 64-bit hashes. A document's
    score is the sum over the item's distinct terms of their weight times their saturated count, in whole numbers. All documents are counted and ranked,
    rows that repeat apart; equal scores go by id, null ids last. Rows of one item id make one item. Documents and items
    without terms, and items whose terms no document has, give no rows; so do empty tables. Other columns are not read.
    """
    out = None
    for block in _blocks(items, block_terms):
        names = docs.sparkSession.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"query long, item_id {items.schema['item_id'].dataType.simpleString()}")
        ranked = _rank_block(docs, block, top).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        return items.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return out
