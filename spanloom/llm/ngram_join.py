"""Similarity join on n-gram sets by token-combination prefixes.

Tokens (hashed word shingles) are in one global order, rare ones first.  Two
sets with Jaccard similarity of at least 80 % differ from their intersection in
at most ``e = floor(0.2 * size)`` tokens each.  A prefix of a set is long enough
when the counts of its tokens by class, each less ``k - 1``, sum to ``e + 1``:
then the two prefixes share a combination of ``k`` tokens of some class.  Rare
tokens are one class with ``k = 1``; frequent tokens are spread over many
classes with ``k = 2``, so that a passage in very many texts is indexed by its
pairs and never by a single token.  The number of frequent classes goes with
the size band of a set; each set is indexed for its own band and the one below,
which holds every pair since sizes of linked sets differ by a quarter at most.

Sets that share a combination meet in a bucket.  Every bucket first links its
members to its smallest one and then to some chosen by hash, and only pairs of
one bucket that are then still in different components are all compared.  A pair is first held against the
bit maps of its sets (a bound that never loses a link) and then verified on the
full sets.  So a group of copies costs as many pairs as it has members, and no link
between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.llm.common import components, kept, superseded
from spanloom.llm.shingles import mix, overlap, set_hash, shingle_sets

CELLS = 1 << 20
#: A token counted this often (cells of a bounded table) is frequent.
FREQUENT = 32
#: Sets below this size are indexed by single tokens throughout.
SMALL = 16
#: Rows of a bucket that go to one task; larger buckets are salted.
BUCKET_ROWS = 4096
#: Further members of a bucket that each one is compared with before all others are.
HUBS = 6
#: Bucket keys that a set carries to tell which bucket gives a pair.
LOW = 8
#: Buckets up to this size are compared pair by pair, larger ones row by row against a table.
FEW = 24


def _slices(pdf: pd.DataFrame, rows: int = 2000) -> Iterator[pd.DataFrame]:
    for k in range(0, len(pdf), rows):
        yield pdf.iloc[k : k + rows]


def frequency_levels(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """Level of each cell of the token space: 0 rare, else 1 + log2(count / FREQUENT).

    Counts are of all texts: every batch adds the tokens that occur in three or
    more of its texts to the cells of a table of fixed size, and the cells are
    summed over the batches.  The table (1 MiB) orders tokens and has no part in
    what is linked.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(CELLS, dtype=np.int64)
        for pdf in batches:
            sets = [s for s in shingle_sets(pdf["text"].tolist(), words) if len(s)]
            if sets:
                token, n = np.unique(np.concatenate(sets), return_counts=True)
                keep = n >= 3
                np.add.at(cells, (token[keep] & np.uint64(CELLS - 1)).astype(np.int64), n[keep])
        found = np.flatnonzero(cells)
        yield pd.DataFrame({"cell": found.astype(np.int32), "n": cells[found]})

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "cell int, n long")
    rows = counted.groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT).toPandas()
    levels = np.zeros(CELLS, dtype=np.uint8)
    levels[rows["cell"].to_numpy()] = 1 + np.log2(rows["n"].to_numpy(np.float64) / FREQUENT).astype(np.uint8)
    return levels


def _band(n: int) -> int:
    return int(math.log(n) / math.log(1.25) + 1e-9)


def signatures(tokens: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, level) of one sorted token set: level 0 for rare tokens."""
    n = len(tokens)
    level = levels[(tokens & np.uint64(CELLS - 1)).astype(np.int64)]
    order = np.lexsort((tokens, level))
    tokens, level = tokens[order], level[order]
    e = n // 5
    rare = int((level == 0).sum())
    if rare >= e + 1:
        return mix(tokens[: e + 1]), np.zeros(e + 1, dtype=np.uint8)
    out, out_level = [mix(tokens[:rare])], [np.zeros(rare, dtype=np.uint8)]
    need = e + 1 - rare
    common, common_level = tokens[rare:], level[rare:]
    for band in {_band(n), max(0, _band(n) - 1)}:
        mark = np.uint64((band + 1) * 0x632BE59BD9B4E019 & (2**64 - 1))
        if 1.25 ** (band + 1) <= SMALL:
            out.append(mix(mix(common[:need]) ^ mark))
            out_level.append(common_level[:need])
            continue
        # pairs of tokens of the same class
        classes = np.uint64(max(1, int(1.25 ** (band + 1)) // 10))
        kind = mix(common + np.uint64(77)) % classes
        by_kind = np.argsort(kind, kind="stable")
        sorted_kind = kind[by_kind]
        first = np.r_[True, sorted_kind[1:] != sorted_kind[:-1]]
        gain = np.empty(len(common), dtype=np.int64)
        gain[by_kind] = ~first  # every token but the first of its class
        total = np.cumsum(gain)
        to = int(np.searchsorted(total, need)) + 1
        kept_, kept_level, kind = common[:to], common_level[:to], kind[:to]
        by_kind = np.argsort(kind, kind="stable")
        run, run_level, run_kind = kept_[by_kind], kept_level[by_kind], kind[by_kind]
        gap = 1
        while gap < len(run):
            same = run_kind[gap:] == run_kind[:-gap]
            if not same.any():
                break
            a, b = run[:-gap][same], run[gap:][same]
            out.append(mix(mix(a) * np.uint64(3) + mix(b) ^ mark))
            out_level.append(run_level[:-gap][same])
            gap += 1
    return np.concatenate(out), np.concatenate(out_level)


def _index(levels: np.ndarray, words: int):
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for pdf in _slices(whole):
                sig, cls, size, level, seen = [], [], [], [], set()
                for s in shingle_sets(pdf["text"].tolist(), words):
                    key = set_hash(s)
                    if not len(s) or key in seen:
                        continue
                    seen.add(key)
                    g, lv = signatures(s, levels)
                    sig.append(g)
                    level.append(lv)
                    cls.append(np.full(len(g), key, dtype=np.int64))
                    size.append(np.full(len(g), len(s), dtype=np.int32))
                if sig:
                    yield pd.DataFrame({"sig": np.concatenate(sig).view(np.int64), "level": np.concatenate(level).astype(np.int8), "cls": np.concatenate(cls), "size": np.concatenate(size)})

    return index


def _verify(percent: int, words: int):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[int, np.ndarray] | None = None
        for pdf in batches:
            out = []
            for a, text_a, b, s in zip(pdf["a"], pdf["text_a"], pdf["b"], shingle_sets(pdf["text_b"].tolist(), words), strict=True):
                if held is None or held[0] != a:
                    held = (a, next(shingle_sets([text_a], words)))
                both = overlap(held[1], s)
                if 100 * both >= percent * (len(held[1]) + len(s) - both):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return verify


def _of_class(words: int):
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            same = [set_hash(s) == c for s, c in zip(shingle_sets(pdf["text"].tolist(), words), pdf["cls"], strict=True)]
            yield pdf.loc[same, ["cls", "text"]]

    return check


def _linked(pairs: DataFrame, docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, percent: int, words: int) -> DataFrame:
    """Pairs (a, b) of classes that fulfil the similarity, on the whole texts of their smallest documents."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(reps.select("cls", "rep"), "cls")
    text = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    # an id that occurs with several texts: the text of the class is the one that hashes to it
    needed = kept(needed, "ngram-needed")
    texts = text.join(needed, "rep").select("cls", "text").mapInPandas(_of_class(words), "cls long, text string")
    texts = kept(texts.dropDuplicates(["cls"]), "ngram-texts")
    b = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
    a = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
    full = pairs.join(b, "b").join(a, "a").select("a", "text_a", "b", "text_b")
    links = kept(full.mapInPandas(_verify(percent, words), "a long, b long"), "ngram-links")
    superseded(needed, texts)
    return links


def bit_map(s: np.ndarray) -> bytes:
    """One bit per token modulo a power of two of two to four times the size."""
    bits = max(256, 1 << (2 * len(s) - 1).bit_length())
    out = np.zeros(bits, dtype=np.uint8)
    out[(mix(s ^ np.uint64(29)) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def may_link(a: bytes, n_a: int, b: bytes, n_b: int, percent: int) -> bool:
    """Whether two sets can fulfil the similarity: tokens of one that are surely not in the other are counted.

    The larger map is folded to the size of the smaller one; a bit of one set
    that the other lacks stands for at least one token.
    """
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    least = -(-percent * (n_a + n_b) // (100 + percent))
    return int(np.bitwise_count(x & ~y).sum()) <= n_a - least and int(np.bitwise_count(y & ~x).sum()) <= n_b - least


def _prune(percent: int):
    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fits = [may_link(*row, percent) for row in zip(pdf["bits_a"], pdf["n_a"], pdf["bits_b"], pdf["n_b"], strict=True)]
            yield pdf.loc[np.array(fits, dtype=bool), ["a", "b"]]

    return prune


def _possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs that their bit maps allow."""
    side = lambda k: reps.select(F.col("cls").alias(k), F.col("bits").alias(f"bits_{k}"), F.col("n").alias(f"n_{k}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "bits_a", "n_a", "bits_b", "n_b")
    return kept(full.mapInPandas(_prune(percent), "a long, b long"), "ngram-possible")


def _sizes_fit(x: Column, y: Column, percent: int) -> Column:
    return (x * 100 >= y * percent) & (y * 100 >= x * percent)


def _different(buckets: DataFrame) -> DataFrame:
    """Buckets with one of each set of members: texts with a passage in common share a bucket for each of its combinations.

    Sets are told apart by their size and 128 bits of hashes of their members, each of which comes once.
    """
    member = F.xxhash64("cls")
    sets = buckets.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(member).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
    return buckets.join(sets.groupBy("n", "x", "y").agg(F.min("sig").alias("sig")).select("sig"), "sig", "left_semi")


def _apart(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """(sig, cls, size, part) of buckets of three and more whose members are in several components by now."""
    reached = kept(components(links), "ngram-reached")
    found = buckets.join(reached.withColumnRenamed("node", "cls"), "cls", "left").select("sig", "cls", "size", F.coalesce("component", "cls").alias("part"))
    mixed = found.groupBy("sig").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("n")).filter("p <> q and n > 2").select("sig")
    return kept(found.join(mixed, "sig"), "ngram-apart")


def _fold(bits: np.ndarray) -> np.ndarray:
    return bits[:, : bits.shape[1] // 2] | bits[:, bits.shape[1] // 2 :]


def _fits(size: np.ndarray, i: int, to: int, x: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of the rows after ``i`` the bit maps allow."""
    least = -(-percent * (size[i] + size[i + 1 : to]) // (100 + percent))
    fits = np.bitwise_count(x & ~others).sum(axis=1, dtype=np.int64) <= size[i] - least
    return fits & (np.bitwise_count(others & ~x).sum(axis=1, dtype=np.int64) <= size[i + 1 : to] - least)


class _Buckets:
    """Rows of whole buckets, sorted by bucket, cell and size."""

    def __init__(self, pdf: pd.DataFrame, percent: int):
        self.percent = percent
        self.sig, self.cls, self.part, self.block = (pdf[c].to_numpy() for c in ("sig", "cls", "part", "block"))
        self.size, self.across = pdf["size"].to_numpy(np.int64), pdf["across"].to_numpy(bool)
        self.bits, self.low, self.key = pdf["bits"].to_list(), pdf["low"].to_list(), pdf["key"].to_numpy()
        self.whole: dict[int, int] = {}

    def _mine(self, i: int, j: int) -> bool:
        """Whether this bucket gives the pair: the smallest of the keys both carry does, if there is one."""
        common = set(self.low[i]).intersection(self.low[j])
        return not common or min(common) == self.key[i]

    def _as_int(self, i: int, width: int) -> int:
        """The bit map of a row, folded to ``width`` bytes."""
        found = self.whole.get(i)
        if found is None:
            found = self.whole[i] = int.from_bytes(self.bits[i], "little")
        n = len(self.bits[i])
        while n > width:
            n //= 2
            found = (found >> (8 * n)) | (found & ((1 << (8 * n)) - 1))
        return found

    def few(self, k: int, q: int) -> Iterator[tuple[int, int]]:
        size, part, percent = self.size[k:q].tolist(), self.part[k:q].tolist(), self.percent
        for i in range(q - k):
            width, x = len(self.bits[k + i]), self._as_int(k + i, len(self.bits[k + i]))
            for j in range(i + 1, q - k):
                if size[i] * 100 < size[j] * percent:
                    break
                if part[i] == part[j] or (self.across[k] and self.block[k + i] == self.block[k + j]):
                    continue
                y, least = self._as_int(k + j, width), -(-percent * (size[i] + size[j]) // (100 + percent))
                if (x & ~y).bit_count() <= size[i] - least and (y & ~x).bit_count() <= size[j] - least:
                    yield k + i, k + j

    def many(self, k: int, q: int) -> Iterator[tuple[int, int]]:
        size, part, block = self.size[k:q], self.part[k:q], self.block[k:q]
        maps = [np.frombuffer(x, dtype=np.uint64) for x in self.bits[k:q]]
        width = np.array([len(x) for x in maps])  # goes up with the size
        for w in np.unique(width):
            a, b, c = np.searchsorted(width, (w, w + 1, 2 * w + 1))
            table = np.stack(maps[a:b])
            if c > b:
                table = np.concatenate([table, _fold(np.stack(maps[b:c]))])
            for i in range(a, b):
                to = min(c, int(np.searchsorted(size, size[i] * 100 // self.percent, side="right")))
                if to > i + 1:
                    fits = (part[i + 1 : to] != part[i]) & (not self.across[k] or block[i + 1 : to] != block[i])
                    if fits.any():
                        fits &= _fits(size, i, to, table[i - a], table[i - a + 1 : to - a], self.percent)
                        for j in np.flatnonzero(fits).tolist():
                            yield k + i, k + i + 1 + j

    def pairs(self, k: int, q: int) -> Iterator[tuple[int, int]]:
        """Pairs of classes of different parts in one bucket that their bit maps allow."""
        for i, j in self.few(k, q) if q - k <= FEW else self.many(k, q):
            if self._mine(i, j):
                yield min(self.cls[i], self.cls[j]), max(self.cls[i], self.cls[j])


def _compare(percent: int):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            sig, cell = pdf["sig"].to_numpy(), pdf["cell"].to_numpy()
            ends = (np.flatnonzero((sig[1:] != sig[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist()
            whole, out, at = _Buckets(pdf, percent), [], 0
            for q in ends:
                out += whole.pairs(at, q)
                at = q
            rest = pdf.iloc[at:]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if rest is not None and len(rest):
            yield pd.DataFrame(list(_Buckets(rest, percent).pairs(0, len(rest))), columns=["a", "b"], dtype="int64")

    return compare


def _compared(apart: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different parts that share a bucket and that their bit maps allow.

    A bucket is compared inside one task and gives out only pairs that may link; one of
    more than ``BUCKET_ROWS`` rows is cut into blocks, and each cell of two
    blocks is a task's work of bounded size.
    """
    sizes = apart.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).cast("int").alias("s"))
    apart = apart.withColumn("key", F.col("sig"))  # whole: two buckets with one key would leave a pair to each other
    low = apart.groupBy("cls").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LOW).alias("low"))
    rows = apart.join(low.join(reps.select("cls", "bits"), "cls"), "cls").join(sizes, "sig")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cls"), "s").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    cell = F.least("block", "other") * F.col("s") + F.greatest("block", "other")
    rows = rows.select("sig", "cls", "size", "part", "bits", "low", "key", "block", (F.col("block") != F.col("other")).alias("across"), cell.cast("int").alias("cell"))
    dealt = rows.repartition("sig", "cell").sortWithinPartitions("sig", "cell", "size", "cls")
    return dealt.mapInPandas(_compare(percent), "a long, b long").distinct()


def classes_of(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, n_shingles, cls, bits) of every row; class 0 is the empty set."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, cls, bits = [], [], []
            for s in shingle_sets(pdf["text"].tolist(), words):
                n.append(len(s))
                cls.append(set_hash(s))
                bits.append(bit_map(s) if len(s) else b"")
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": n, "cls": cls, "bits": bits})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return kept(rows.mapInPandas(describe, "doc_id long, n_shingles long, cls long, bits binary"), "ngram-classes")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``(doc_id, n_shingles, component_id)``.

    Two documents link when ``100 * |A and B| >= percent * |A or B|`` of their
    shingle sets (``percent`` of 80 or more); ``component_id`` is the smallest id
    reachable by links.  Documents with equal sets are one class and are never
    compared.  Null or empty texts link with nothing.  A row with a null id has
    a null component and links with nothing; repeated rows give repeated results.
    Other columns are ignored.
    """
    if percent < 80:
        raise ValueError("the prefixes hold for 80 per cent and more")
    of = classes_of(docs, id_col, text_col, words)
    # each class by its smallest document
    reps = kept(of.filter("n_shingles > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.any_value("bits").alias("bits")), "ngram-reps")
    levels = frequency_levels(docs, text_col, words)

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"))
    sigs = rows.mapInPandas(_index(levels, words), "sig long, level byte, cls long, size int")
    # rows of a very frequent combination are dealt over salts, about BUCKET_ROWS each
    salts = F.greatest(F.lit(1), (F.pow(F.lit(2.0), F.col("level") - 1) * FREQUENT * 2 / BUCKET_ROWS).cast("int"))
    sigs = sigs.withColumn("salt", F.when(F.col("level") == 0, 0).otherwise(F.pmod(F.xxhash64("cls"), salts)).cast("int"))
    w = Window.partitionBy("sig", "salt")
    # copies in several batches give a class several times; a bucket holds it once
    first = sigs.withColumn("same", F.lag("cls").over(w.orderBy("cls"))).withColumn("hub", F.min("cls").over(w)).withColumn("last", F.max("cls").over(w))
    first = first.filter("same is null or same <> cls")
    salted = salts > 1
    every = kept(first.filter((F.col("hub") != F.col("last")) | salted).select("sig", "cls", "size", "hub", salted.alias("salted")), "ngram-all-buckets")
    buckets = kept(_different(every), "ngram-buckets")
    superseded(every)
    pairs = buckets.filter("cls <> hub").select("hub", "cls")
    # the smallest members of the salts of one combination
    tops = buckets.filter("salted").select("sig", "hub").distinct()
    top = tops.groupBy("sig").agg(F.min("hub").alias("top"))
    pairs = pairs.union(tops.join(top, "sig").filter("hub <> top").select(F.col("top").alias("hub"), F.col("hub").alias("cls")))
    pairs = kept(pairs.select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct(), "ngram-pairs")

    possible = _possible(pairs, reps, percent)
    links = _linked(possible, docs, reps, id_col, text_col, percent, words)
    # members that the smallest one didn't link try some others of their bucket, chosen by hash
    apart = _apart(buckets, links)
    hubs = apart.groupBy("sig").agg(F.array(*[F.min(F.struct(F.xxhash64("cls", F.lit(k)).alias("h"), "cls", "part")) for k in range(HUBS)]).alias("hubs"))
    near = F.filter("hubs", lambda h: (h["part"] != F.col("part")))
    tried = apart.join(hubs, "sig").select("cls", F.explode(F.transform(near, lambda h: h["cls"])).alias("hub"))
    tried = tried.select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b")).distinct()
    tried = _possible(tried.join(pairs, ["a", "b"], "left_anti"), reps, percent)
    links = links.union(_linked(tried, docs, reps, id_col, text_col, percent, words))
    # and whatever is still apart is compared with all of the other parts
    superseded(apart)
    apart = _apart(buckets, links)
    more = _compared(apart, reps, percent)
    more = kept(more.join(pairs.union(tried), ["a", "b"], "left_anti"), "ngram-more")
    superseded(apart, buckets, pairs, possible, tried)
    links = links.union(_linked(more, docs, reps, id_col, text_col, percent, words))

    left = reps.select(F.col("cls").alias("a"), F.col("rep").alias("ra"))
    right = reps.select(F.col("cls").alias("b"), F.col("rep").alias("rb"))
    edges = links.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    found = components(edges)
    label = reps.join(found, reps["rep"] == found["node"], "left").select("cls", F.coalesce("component", "rep").alias("component_id"))
    out = of.drop("bits").join(label, "cls", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` without near duplicates: of each component of ``join`` the smallest id stays.

    Rows with a null id all stay.  Several rows with one id count as one
    document: the one with the smallest text stays.
    """
    found = kept(join(docs.select(id_col, text_col), id_col, text_col, words, percent).filter("doc_id is not null"), "ngram-components")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__op_id")).distinct()
    again = found.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__op_id"))
    left = docs.join(kept(gone, "ngram-gone"), docs[id_col] == F.col("__op_id"), "left_anti")
    again = kept(again, "ngram-again")
    if again.isEmpty():
        return left
    once = left.join(again, left[id_col] == F.col("__op_id"), "left_anti")
    several = left.join(again, left[id_col] == F.col("__op_id"), "left_semi")
    w = Window.partitionBy(id_col).orderBy(text_col)
    return once.union(several.withColumn("__op_row", F.row_number().over(w)).filter("__op_row = 1").drop("__op_row"))
