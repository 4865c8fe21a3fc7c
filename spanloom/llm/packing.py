"""Best-fit packing by sums of squares.

Only narrow rows (id, piece, length) are packed, never ids of tokens.  Rows are
dealt at random into shards of bounded size; in each shard, pieces are placed
one by one, longest first, where the sum over all residual gaps of the squared
number of open bins with that gap becomes smallest.  Bins that stay too empty
are opened again and their pieces packed in a next round over fewer shards, so
the number of bins is close to the total length over the capacity at any size.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from spanloom.llm.common import kept

#: White space to Python's split() that is none to the tokenizer's pattern.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


#: Latin letters and then marks: such a word is two pieces at most and needs no normal form but lower case.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class WordIds:
    """Ids of whole texts, memoised by word: the tokenizer never merges across white space.

    Plain words go to the tokenizer's model directly, all others through the
    whole tokenizer; the ids are the same.  A full memo is emptied.
    """

    def __init__(self, path: str, limit: int = 600_000):
        self.tokenizer, self.limit, self.memo = Tokenizer.from_file(path), limit, {}
        self.model = self.tokenizer.model
        self.bytes = {chr(b): c for b, c in enumerate(byte_characters())}

    def _plain(self, letters: str, marks: str) -> bytes:
        letters = letters.lower()
        if not letters.isascii():
            letters = "".join([self.bytes[c] for c in letters.encode("utf-8").decode("latin-1")])
        ids = [t.id for t in self.model.tokenize(letters)]
        if marks:
            ids += [t.id for t in self.model.tokenize(marks)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _raw(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; new words are encoded in small batches."""
        memo = self.memo
        split = [None if any(c in t for c in _SEPARATORS) else t.split() for t in texts]
        if len(memo) > self.limit:
            memo.clear()
        new = []
        for w in set().union(*(w for w in split if w is not None)).difference(memo):
            plain = _PLAIN.match(w)
            if plain:
                memo[w] = self._plain(plain[1], plain[2])
            else:
                new.append(w)
        for k in range(0, len(new), 4000):
            part = new[k : k + 4000]
            for w, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                ids = e.ids
                memo[w] = struct.pack(f"<{len(ids)}I", *ids)
        return [self._raw(text) if words is None else b"".join([memo[w] for w in words]) for text, words in zip(texts, split, strict=True)]


_WORDS: dict[str, WordIds] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Every document as pieces of at most ``capacity`` ids: ``(<id>, piece, start, length, ids_crc32[, ids])``.

    A document is the tokenizer's ids without special tokens and then ``end_id``;
    a null or empty text is that id alone.  Only longer documents are cut.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        words = _WORDS.setdefault(tokenizer_path, None) or WordIds(tokenizer_path)
        _WORDS[tokenizer_path] = words
        end = struct.pack("<I", end_id)
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                some, rows = pdf.iloc[at : at + 256], []
                for ident, raw in zip(some["id"], words([t or "" for t in some["text"]]), strict=True):
                    raw += end
                    for k in range(0, len(raw), 4 * capacity):
                        part = raw[k : k + 4 * capacity]
                        rows.append((ident, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", "ids"])[columns]

    columns = ["id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; pieces are placed in the given order.

    Placing a piece of length ``s`` in a bin with gap ``g`` moves one bin from
    gap ``g`` to ``g - s`` and changes the sum of squares by
    ``2 * (n[g - s] - n[g]) + 2`` (full and untouched bins don't count).  Ties go
    to the tightest gap.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    where, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    big = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        if s == capacity:
            where[i], offset[i] = len(fill), 0
            fill.append(s)
            continue
        gaps = count[s:capacity]  # gap g = s + index
        after = count[: capacity - s].copy()
        after[0] = -1  # a full bin is no longer open: a perfect fit beats all else
        change = np.where(gaps > 0, 2 * (after - gaps) + 2, big)
        change[0] = 1 - 2 * gaps[0] if gaps[0] > 0 else big
        k = int(change.argmin()) if len(change) else 0
        fresh = 2 * int(count[capacity - s]) + 1
        if not len(change) or change[k] == big or change[k] > fresh:
            b, g = len(fill), capacity
            fill.append(0)
        else:
            g = s + k
            b = stacks[g].pop()
            count[g] -= 1
        where[i], offset[i] = b, fill[b]
        fill[b] += s
        if g > s:
            stacks[g - s].append(b)
            count[g - s] += 1
    return where, offset


def _pack_shards(rows: DataFrame, capacity: int, shards: int, salt: int, slack: int | None) -> DataFrame:
    """Bins of every shard; with ``slack``, pieces of bins with a larger gap have bin null."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "mark"], ascending=[False, True], kind="stable").reset_index(drop=True)
        where, offset = sum_of_squares(pdf["length"].to_numpy(np.int64), capacity)
        pdf["bin"], pdf["offset"] = where, offset
        pdf["bin"] = pdf["bin"].astype("Int64")
        if slack is not None:
            filled = np.bincount(where, weights=pdf["length"].to_numpy(np.float64))
            open_ = capacity - filled[where] > slack
            pdf.loc[open_, "bin"] = pd.NA
        return pdf

    schema = "shard long, mark long, length long, bin long, offset long"
    dealt = rows.select(F.pmod(F.xxhash64("mark", F.lit(salt)), F.lit(shards)).alias("shard"), "mark", "length")
    return dealt.groupBy("shard").applyInPandas(pack, schema)


def pack(pieces: DataFrame, capacity: int = 4096, shard_rows: int = 20_000, slack: int = 16, rounds: int = 3) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Every row is placed, repeated rows and null ids too; rows are told apart by a
    mark that is fixed once in a written table.  Shards hold about
    ``shard_rows`` rows whatever the size of the input, so a hot id or length is
    no hot task.  Bins of all but the last round with a gap of more than
    ``slack`` are packed again.  An empty table stays empty.  Columns named
    ``sequence_id`` or ``offset`` are replaced.
    """
    marked = kept(pieces.drop("sequence_id", "offset").withColumn("__op_mark", F.monotonically_increasing_id()), "pack-pieces")
    left = marked.select(F.col("__op_mark").alias("mark"), F.col("length").cast("long").alias("length"))
    done, base = None, 0
    for k in range(rounds):
        n = left.count()
        shards = max(1, math.ceil(n / shard_rows))
        last = shards == 1 or k == rounds - 1
        placed = kept(_pack_shards(left, capacity, shards, k, None if last else slack), "pack-round")
        full = placed.filter("bin is not null").select("mark", (F.lit(base) + F.col("bin") * shards + F.col("shard")).alias("sequence_id"), "offset")
        done = full if done is None else done.union(full)
        if last:
            break
        base += shards * (shard_rows * 4)
        left = placed.filter("bin is null").select("mark", "length")
    out = marked.join(done.withColumnRenamed("mark", "__op_mark"), "__op_mark")
    return out.drop("__op_mark")
