"""SentencePiece BPE by a table of last tokens.

For every prefix of a text the encoding of the prefix ends in exactly one
token, and that token alone is stored.  A token that matches at the end of a
prefix is the last one if and only if it and the last token of the remaining
prefix are compatible, that is, if the two texts put together encode to just
these two.  Ids are then recovered from the end of the table backwards.  The
work is linear in the text whatever its length.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"


class PieceModel:
    """Vocabulary of a BPE model with byte fallback, its automaton and pair tests.

    Only the model *file* is read with the library; encoding and decoding are
    done here.  ``limit`` bounds each memo: a full one is emptied, which costs
    time and changes nothing.
    """

    def __init__(self, path: str, limit: int = 600_000):
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.limit = m.bos_id(), m.eos_id(), limit
        self.text, self.byte_of, self.byte_id, self.rank = {}, {}, {}, {}
        self.control = set()
        self.automaton = ahocorasick.Automaton()
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_of[i] = int(piece[3:5], 16)
                self.byte_id[self.byte_of[i]] = i
            elif m.is_control(i):
                self.control.add(i)
            elif m.is_unknown(i):
                self.unknown = i
            elif m.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            else:
                self.text[i], self.rank[piece] = piece, (-m.get_score(i), i)
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.known = {c for c in self.rank if len(c) == 1}
        self.plain = {i: t.replace(SPACE, " ") for i, t in self.text.items()} | dict.fromkeys(self.control, "") | {self.unknown: " ⁇ "}
        self.plain |= {i: chr(b) for i, b in self.byte_of.items() if b < 128}
        self.head, self.tail = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        self.pairs: dict[int, bool] = {}
        self.spines: dict[int, list[tuple[str, float]]] = {}
        self.memo: dict[str, bytes] = {}

    def merge(self, text: str) -> list[int]:
        """Plain merging of a short text of known characters: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[x + y][0], k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.rank[x][1] for x in parts]

    def spine(self, token: int, right: bool) -> list[tuple[str, float]]:
        """Symbols at one edge of a token while its text is merged, each with the score rank of the merge that ends it."""
        key = token if right else ~token
        known = self.spines.get(key)
        if known is None:
            parts, known = list(self.text[token]), []
            while len(parts) > 1:
                at, k = min((self.rank[x + y][0], k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.rank)
                if k == (len(parts) - 2 if right else 0):
                    known.append((parts[-1 if right else 0], at))
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            known.append((parts[0], float("inf")))
            self.spines[key] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two texts put together encode to just these two tokens.

        They do unless some symbol at the right edge of the first and some at the
        left edge of the second would merge before either of them is merged inside
        its own token; among equal scores the merge further left comes first.
        """
        rank = self.rank
        inner = self.spine(right, False)
        for x, x_ends in self.spine(left, True):
            for y, y_ends in inner:
                both = rank.get(x + y)
                if both is not None and both[0] < x_ends and both[0] <= y_ends:
                    return False
        return True

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a text of known characters without inner word starts, by the table of last tokens."""
        n = len(chunk)
        if len(self.pairs) >= self.limit:
            self.pairs.clear()
        last, size, pairs = [None] * (n + 1), [0] * (n + 1), self.pairs
        last[0] = -1
        for end, (token, length) in self.automaton.iter(chunk):
            end += 1
            if last[end] is not None:
                continue
            before = last[end - length]
            if before is None:
                continue
            if before >= 0:
                key = before << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.compatible(before, token)
                if not fits:
                    continue
            last[end], size[end] = token, length
        out, at = [], n
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of any stretch that starts a word; a character that no piece holds ends a run and becomes its UTF-8 bytes."""
        if self.known.issuperset(chunk):
            return self.chunk_ids(chunk)
        out, at = [], 0
        for k, char in enumerate(chunk):
            if char not in self.known:
                if k > at:
                    out += self.chunk_ids(chunk[at:k])
                out += [self.byte_id[b] for b in char.encode("utf-8")]
                at = k + 1
        return out + (self.chunk_ids(chunk[at:]) if at < len(chunk) else [])

    def _raw(self, chunk: str) -> bytes:
        ids = self.encode_chunk(chunk)
        raw = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= 64:
            if len(self.memo) >= self.limit:
                self.memo.clear()
            self.memo[chunk] = raw
        return raw

    @staticmethod
    def chunks(text: str) -> Iterator[str]:
        """Stretches that no merge crosses: no piece has a word start after another character."""
        if not text:
            return
        first, *rest = text.replace(" ", SPACE).split(SPACE)
        run = SPACE
        if first:
            yield SPACE + first
            run = ""
        for word in rest:
            run += SPACE
            if word:
                # spaces in a row may merge with one another, and the last with the word
                yield run + word
                run = ""
        if run:
            yield run

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        get, make = self.memo.get, self._raw
        return self.head + b"".join([get(c) or make(c) for c in self.chunks(text)]) + self.tail

    def decode(self, ids: list[int]) -> str:
        """Text of a sequence: word starts become spaces, control pieces vanish, the space put before the first word too.

        Runs of byte pieces are read as UTF-8; a byte that starts no valid
        sequence becomes U+FFFD.
        """
        table = self.plain
        first = next((i for i in ids if i not in self.control), None)
        cut = first in self.text and self.text[first].startswith(SPACE)
        try:
            out = "".join([table[i] for i in ids])
        except KeyError:  # bytes of longer characters
            parts, run = [], bytearray()
            for i in ids:
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    parts.append(_utf8(bytes(run)))
                    run.clear()
                parts.append(table[i])
            out = "".join(parts) + (_utf8(bytes(run)) if run else "")
        return out[1:] if cut else out


def _utf8(raw: bytes) -> str:
    """Each byte that starts no valid sequence is one replacement character."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode("utf-8"))
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of a worker process, built once."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Token ids and decoded text of every row: ``(<id>, n_tokens, ids binary, ids_sha256, decoded, decoded_sha256)``.

    Null and empty texts have the begin and end id only and decode to the empty
    text.  Ids and rows may repeat or be null; other columns are ignored.  With
    ``with_ids=False`` the two payload columns are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(model_path)
        for pdf in batches:
            ids = [m.encode(t or "") for t in pdf["text"]]
            plain = [m.decode(struct.unpack(f"<{len(x) // 4}I", x)) for x in ids]
            out = {
                "id": pdf["id"], "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in plain],
            }
            if with_ids:
                out |= {"ids": ids, "decoded": plain}
            yield pd.DataFrame(out)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if with_ids else "")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, schema).withColumnRenamed("id", id_col)
