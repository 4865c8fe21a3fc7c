"""Ranked lexical search by MaxScore with bounds of term pairs.

Documents are indexed once, in shards of consecutive rows, without a shuffle:
a row of the index is one shard with its postings (impact of each term in each
document), and with intersection lists of chosen term pairs (joint impact of
both).  Every list keeps its maximum.  A query splits its terms into units,
pairs and single terms; a unit's bound is the best a document can get from it:
for a pair the joint maximum or the maximum of one of its terms, which is less
than the sum of both maxima wherever no document has both at their best.  Units
are sorted by bound; those whose bounds together stay below the score to beat
are not essential: no document is found through them, and they are looked up
only for documents that can still win.

The score to beat comes from a first pass over the short lists (partial sums
of real documents, so lower bounds) and rises while a task works.  Scores are
exact integers, and documents that tie with the last place are kept for the
final ranking.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.llm.common import kept

TOP = 20
#: Documents of one shard of the index.
SHARD_DOCS = 256
#: Terms of queries that are answered together; more queries than that go in further rounds, so what is sent to tasks is bounded.
ROUND_TERMS = 100_000
#: Lists up to this length take part in the first pass.
SHORT = 64
#: Bytes of one Arrow batch of texts or shards.
BATCH_BYTES = 4 << 20
#: Bytes of a row group of the index.  A shard is a row of about 1 MB; writers and readers hold a row group and its pages, whose
#: sizes Parquet looks at after 100 rows by default.
GROUP_BYTES = 8 << 20
_SEPARATORS = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256))
_FOLD = _SEPARATORS.lower()
_INDEX = "ids array<long>, term array<int>, start array<int>, doc array<int>, impact array<long>, top array<long>, pair array<int>, pair_start array<int>, pair_doc array<int>, joint array<long>, pair_top array<long>"


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and all beyond ASCII, in UTF-8, with A-Z lower-cased."""
    return text.translate(_FOLD).split()


def _utf8(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


@dataclass(frozen=True)
class Query:
    """One item: places of its terms in the vocabulary with their repeats."""

    item: int
    repeats: dict[int, int]


def _queries(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list[bytes], list[Query]]]:
    """Rounds of (vocabulary, queries), each of about :data:`ROUND_TERMS` terms."""
    rows = items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), _utf8(F.col(text_col)).alias("text")).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, terms, n = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for term, k in Counter(terms_of(t)).items():
                    ids.append(i)
                    terms.append(term)
                    n.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary()), pa.array(n, pa.int64())], ["item_id", "term", "n"])

    counted = rows.mapInArrow(count, "item_id long, term binary, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))
    counted = kept(counted, "search-items")
    rounds = max(1, math.ceil(counted.count() / ROUND_TERMS))
    for k in range(rounds):
        part = counted.filter(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == k).collect() if rounds > 1 else counted.collect()
        place = {t: j for j, t in enumerate(sorted({bytes(r["term"]) for r in part}))}
        found: dict[int, dict[int, int]] = defaultdict(dict)
        for r in part:
            found[r["item_id"]][place[bytes(r["term"])]] = r["n"]
        if found:
            yield list(place), [Query(i, found[i]) for i in sorted(found)]


def _counted(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[bytes]) -> DataFrame:
    """``(doc_id, n, term, tf)`` of every document with a term: its length and its counts of vocabulary terms."""
    place = {t: j for j, t in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, n, terms, tf = [], [], [], []
            for i in range(b.num_rows):
                words = terms_of(b.column(1)[i].as_py())
                if words:
                    own = Counter(map(place.get, words))
                    own.pop(None, None)
                    keep.append(i)
                    n.append(len(words))
                    terms.append(list(own))
                    tf.append(list(own.values()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int32())), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], ["doc_id", "n", "term", "tf"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _utf8(F.col(text_col)).alias("text"))
    return kept(rows.mapInArrow(count, "doc_id long, n long, term array<int>, tf array<long>"), "search-counts")


def chosen_pairs(queries: list[Query], weights: list[int]) -> list[tuple[int, int]]:
    """Pairs that get intersection lists: neighbours in the order of weights of each query's terms, lightest first.

    The lightest terms have the longest lists and stand first in the order of bounds, where a tighter one makes more of them inessential.
    """
    pairs = set()
    for q in queries:
        order = sorted((t for t in q.repeats if weights[t] > 0), key=lambda t: (weights[t], t))
        pairs.update(zip(order[::2], order[1::2], strict=False))
    return sorted(pairs)


def _index(counted: DataFrame, weights: list[int], docs: int, length: int, pairs: list[tuple[int, int]]) -> DataFrame:
    """The index, one row per shard."""
    heavy = np.array(weights, dtype=np.int64)
    partners = defaultdict(list)
    for p, (a, b) in enumerate(pairs):
        partners[a].append((p, b))

    def shard(ids: list, n: list[int], terms: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> tuple:
        m = np.array([75 + 25 * k * docs // length for k in n], dtype=np.int64)
        doc = np.repeat(np.arange(len(n), dtype=np.int32), sizes)
        impact = heavy[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
        live = impact > 0
        terms, doc, impact = terms[live], doc[live], impact[live]
        order = np.lexsort((doc, terms))
        terms, doc, impact = terms[order], doc[order], impact[order]
        term, start = np.unique(terms, return_index=True)
        ends = np.append(start, len(terms)).astype(np.int32)
        top = np.maximum.reduceat(impact, start) if len(start) else impact
        where = {t: i for i, t in enumerate(term.tolist())}
        kept_pairs, pair_start, pair_docs, joints = [], [0], [], []
        for t, i in where.items():
            for p, other in partners[t] if t in partners else ():
                j = where.get(other)
                if j is not None:
                    common, x, y = np.intersect1d(doc[ends[i] : ends[i + 1]], doc[ends[j] : ends[j + 1]], assume_unique=True, return_indices=True)
                    if len(common):
                        kept_pairs.append(p)
                        pair_docs.append(common)
                        joints.append(impact[ends[i] + x] + impact[ends[j] + y])
                        pair_start.append(pair_start[-1] + len(common))
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return (ids, term, ends, doc, impact, top, kept_pairs, pair_start, joined(pair_docs, np.int32), joined(joints, np.int64), [int(x.max()) for x in joints])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> pa.RecordBatch:
            t = table.combine_chunks()
            term = t.column("term").combine_chunks()
            row = shard(
                t.column("doc_id").to_pylist(), t.column("n").to_pylist(), term.flatten().to_numpy(zero_copy_only=False), t.column("tf").combine_chunks().flatten().to_numpy(zero_copy_only=False),
                np.diff(term.offsets.to_numpy()),
            )
            return pa.RecordBatch.from_arrays([pa.array([x if isinstance(x, list) else x.tolist()], pa.list_(k)) for x, k in zip(row, _KINDS, strict=True)], list(_NAMES))

        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= SHARD_DOCS:
                t = pa.Table.from_batches(held)
                yield flush(t.slice(0, SHARD_DOCS))
                held = t.slice(SHARD_DOCS).to_batches()
        if sum(x.num_rows for x in held):
            yield flush(pa.Table.from_batches(held))

    sizes = {"parquet.block.size": str(GROUP_BYTES), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}
    return kept(counted.mapInArrow(build, _INDEX), "search-index", **sizes)


_NAMES = tuple(x.split()[0] for x in _INDEX.split(", "))
_KINDS = tuple(pa.int64() if "long" in x else pa.int32() for x in _INDEX.split(", "))


class Shard:
    """A row of the index as arrays."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        get = {name: batch.column(i)[row].values for i, name in enumerate(_NAMES)}
        self.ids = get["ids"].to_pylist()
        a = {name: v.to_numpy(zero_copy_only=False) for name, v in get.items() if name != "ids"}
        self.doc, self.impact, self.start, self.top = a["doc"], a["impact"], a["start"], a["top"]
        self.pair_doc, self.joint, self.pair_start, self.pair_top = a["pair_doc"], a["joint"], a["pair_start"], a["pair_top"]
        self.term = {t: i for i, t in enumerate(a["term"].tolist())}
        self.pair = {p: i for i, p in enumerate(a["pair"].tolist())}

    def of_term(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        i = self.term[t]
        return self.doc[self.start[i] : self.start[i + 1]], self.impact[self.start[i] : self.start[i + 1]]

    def of_pair(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        i = self.pair[p]
        return self.pair_doc[self.pair_start[i] : self.pair_start[i + 1]], self.joint[self.pair_start[i] : self.pair_start[i + 1]]

    def best(self, t: int) -> int:
        return int(self.top[self.term[t]]) if t in self.term else 0

    def bound(self, unit: tuple, repeats: dict[int, int]) -> int:
        """The most a document of the shard gets from a unit ``(pair or None, term, ...)``."""
        pair, *terms = unit
        best = [repeats[t] * self.best(t) for t in terms]
        if pair is None or 0 in best:
            return sum(best)
        if pair not in self.pair:  # no document has both
            return max(best)
        a, b = terms
        both = min(repeats[a], repeats[b])
        spare = (repeats[a] - both) * self.best(a) + (repeats[b] - both) * self.best(b)
        return max(*best, min(sum(best), both * int(self.pair_top[self.pair[pair]]) + spare))


def units_of(query: Query, weights: list[int], number: dict[tuple[int, int], int]) -> list[tuple]:
    """The terms of a query as units: the pairs of :func:`chosen_pairs` and what is left."""
    order = sorted((t for t in query.repeats if weights[t] > 0), key=lambda t: (weights[t], t))
    units = [(number[a, b], a, b) for a, b in zip(order[::2], order[1::2], strict=False)]
    return units + ([(None, order[-1])] if len(order) % 2 else [])


def partial_scores(shard: Shard, query: Query, units: list[tuple]) -> np.ndarray:
    """Lower bounds of the scores of all documents, from the lists of at most :data:`SHORT` documents."""
    out = np.zeros(len(shard.ids), np.int64)
    for pair, *terms in units:
        long = 0
        for t in terms:
            if t in shard.term:
                doc, impact = shard.of_term(t)
                if len(doc) <= SHORT:
                    out[doc] += query.repeats[t] * impact
                else:
                    long += 1
        if pair in shard.pair and long == 2:
            doc, joint = shard.of_pair(pair)
            if len(doc) <= SHORT:
                out[doc] += min(query.repeats[t] for t in terms) * joint
    return out


def search_shard(shard: Shard, query: Query, units: list[tuple], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the shard with a score of at least ``least`` (and above 0), and these scores."""
    repeats = query.repeats
    bounds = [shard.bound(u, repeats) for u in units]
    order = [i for i in sorted(range(len(units)), key=bounds.__getitem__) if bounds[i]]
    rest, first = 0, 0  # units before ``first`` are not essential; ``rest`` is the sum of their bounds
    while first < len(order) and rest + bounds[order[first]] < least:
        rest += bounds[order[first]]
        first += 1
    score = np.zeros(len(shard.ids), np.int64)
    for i in order[first:]:
        for t in units[i][1:]:
            if t in shard.term:
                doc, impact = shard.of_term(t)
                score[doc] += repeats[t] * impact
    found = np.flatnonzero(score)
    for i in reversed(order[:first]):
        found = found[score[found] + rest >= least]
        if not len(found):
            break
        rest -= bounds[i]
        for t in units[i][1:]:
            if t in shard.term:
                doc, impact = shard.of_term(t)
                at = np.minimum(np.searchsorted(doc, found), len(doc) - 1)
                score[found] += np.where(doc[at] == found, repeats[t] * impact[at], 0)
    found = found[score[found] >= max(1, least)]
    return found, score[found]


def _leading(ids: list, docs: np.ndarray, scores: np.ndarray, held: list[tuple], top: int) -> list[tuple]:
    """The ``top`` of ``held`` and the new documents: (-score, id is null, id), best first."""
    if len(docs) > 4 * top:  # everything that ties with the last place stays in
        docs, scores = docs[keep := scores >= np.partition(scores, -top)[-top]], scores[keep]
    new = [(-s, ids[d] is None, ids[d] if ids[d] is not None else 0) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
    return sorted(held + new)[:top]


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``top`` documents of each item: ``item_id, rank, doc_id, score``.

    Every row of ``docs`` is a document, repeated ids and texts included; a null id
    ranks behind equal scores.  Null texts have no terms.  Repeated rows of ``items``
    count once, rows of one id with different texts are one item with the terms of
    all; null item ids have no result, and neither has an item whose terms occur in
    no document.  Terms in (nearly) all documents can weigh 0 and then add nothing.
    Empty tables give an empty one; further columns are not read.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    schema = "item_id long, doc_id long, score long"
    results = spark.createDataFrame([], schema)
    for vocabulary, queries in _queries(items, item_col, item_text):
        counted = _counted(docs, id_col, text_col, vocabulary)
        n, length = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = {r["term"]: r["count"] for r in counted.select(F.explode("term").alias("term")).groupBy("term").count().collect()}  # one row per query term
        weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) if t in holding else 0 for t in range(len(vocabulary))]
        pairs = chosen_pairs(queries, weights)
        number = {ab: p for p, ab in enumerate(pairs)}
        plans = [(q, u) for q in queries if (u := units_of(q, weights, number))]
        index = _index(counted, weights, n, length, pairs)

        def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
            for b in batches:
                for i in range(b.num_rows):
                    yield Shard(b, i)

        def out(found: dict[int, list[tuple]]) -> pa.RecordBatch:
            rows = [(i, None if absent else d, -s) for i, held in found.items() for s, absent, d in held]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["item_id", "doc_id", "score"])

        def first_pass(batches: Iterator[pa.RecordBatch], plans=plans) -> Iterator[pa.RecordBatch]:
            found: dict[int, list[tuple]] = {}
            for s in shards(batches):
                for q, units in plans:
                    score = partial_scores(s, q, units)
                    docs = np.flatnonzero(score)
                    if len(docs):
                        found[q.item] = _leading(s.ids, docs, score[docs], found.get(q.item, []), top)
            yield out(found)

        ranked = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        lowest = index.mapInArrow(first_pass, schema).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == top)
        least = {r["item_id"]: r["score"] for r in lowest.collect()}  # one row per query of the round

        def second_pass(batches: Iterator[pa.RecordBatch], plans=plans, least=least) -> Iterator[pa.RecordBatch]:
            found: dict[int, list[tuple]] = {}
            for s in shards(batches):
                for q, units in plans:
                    held = found.get(q.item, [])
                    bar = max(least.get(q.item, 0), -held[-1][0] if len(held) == top else 0)
                    docs, scores = search_shard(s, q, units, bar)
                    if len(docs):
                        found[q.item] = _leading(s.ids, docs, scores, held, top)
            yield out(found)

        results = results.unionByName(index.mapInArrow(second_pass, schema))
    ranked = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return results.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
