"""Tokens, packing, secrets, shingles, quality and language on small tables."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from spanloom.llm import language, ngram_join, packing, pieces, quality, secrets
from spanloom.llm.shingles import overlap, shingle_sets
from tests.llm.cases import LONG, documents, words

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
MODEL = pieces.PieceModel(PIECES)


def ids_of(text: str) -> list[int]:
    raw = MODEL.encode(text)
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


# --- pieces


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet=" ▁abeinrst\n\t漢é")))
def test_pieces_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    want = LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert ids_of(text) == want
    assert MODEL.decode(want) == LIBRARY.decode(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(3, 258), max_size=12))
def test_decoding_of_any_ids_equals_the_library(ids):
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


def test_a_full_memo_changes_nothing():
    small = pieces.PieceModel(PIECES, limit=3)
    for text in (" ".join(words(5, 200)), LONG[:5000], "x" * 3000):
        assert small.encode(text) == MODEL.encode(text)


def test_encoding_of_a_table(spark):
    docs = documents(spark)
    got = pieces.encode_texts(docs, PIECES).collect()
    assert len(got) == docs.count()
    for r, d in zip(sorted(got, key=str), sorted(got, key=str), strict=True):
        assert r.ids_sha256 == d.ids_sha256
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        want = LIBRARY.encode(text[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(want) and bytes(r.ids) == np.array(want, "<u4").tobytes()
        assert r.decoded == LIBRARY.decode(want) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert pieces.encode_texts(docs.limit(0), PIECES).count() == 0


# --- packing


def test_pieces_and_sequences(spark):
    docs = documents(spark)
    rows = packing.pack(packing.token_pieces(docs, WORDS, capacity=256), capacity=256, shard_rows=200).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 256 * r.piece and len(part) == r.length <= 256
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and bytes(r.ids) == np.array(part, "<u4").tobytes()
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 256
    least = -(-sum(r.length for r in rows) // 256)
    assert len({r.sequence_id for r in rows}) <= least * 1.03 + 2
    assert packing.pack(packing.token_pieces(docs.limit(0), WORDS)).count() == 0


def test_sum_of_squares_places_everything():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 101, 3000), np.full(50, 100), np.full(51, 50), np.ones(250, int), np.array([60, 50, 40, 30])):
        where, offset = packing.sum_of_squares(np.sort(lengths)[::-1], 100)
        lengths = np.sort(lengths)[::-1]
        total = np.bincount(where, weights=lengths)
        assert total.max() <= 100
        for b in range(len(total)):
            k = np.flatnonzero(where == b)
            assert sorted(zip(offset[k], lengths[k], strict=True))[0][0] == 0
            assert (np.sort(offset[k])[1:] == np.cumsum(lengths[k][np.argsort(offset[k])])[:-1]).all()
        assert len(total) <= -(-lengths.sum() // 100) * 1.03 + 1


def test_greedy_choice_is_the_smallest_sum_of_squares():
    rng = np.random.default_rng(2)
    lengths, capacity = rng.integers(1, 11, 200), 10
    where, _ = packing.sum_of_squares(lengths, capacity)
    gaps: dict[int, int] = {}

    def total(g):
        n = np.bincount([x for x in g.values() if 0 < x < capacity], minlength=capacity)
        return int((n**2).sum())

    for b, s in zip(where.tolist(), lengths.tolist(), strict=True):
        options = [total({**gaps, k: g - s}) for k, g in gaps.items() if g >= s] + [total({**gaps, len(gaps): capacity - s})]
        gaps[b] = gaps.get(b, capacity) - s
        assert total(gaps) == min(options)


def test_word_ids_with_separators():
    w, t = packing.WordIds(WORDS, limit=10), Tokenizer.from_file(WORDS)
    texts = ["a\x1cb c\x1d", "<|endoftext|> x<|startoftext|>y", "don't STOP 123 é́", "", "  x   y", "ⅷ½ ﬁ"]
    for text, raw in zip(texts, w(texts), strict=True):
        assert raw == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# --- secrets

KEY = "aB3dE5fG7hI9jK1lM2nO4pQ6"
TEXTS = [
    None, "", "no secret here", 'password = "abcdefghijkl" end', "PASSWD:short", "token: api_key=\"abcdefghijklmnop\"", "🙂 Api_Key='0123456789abcdef0123' x",
    "AKIAABCDEFGHIJKLMN and AKIA12", "AKIAKIAKIAKIAKIAKIA", "deadbeefdeadbeef", "deadbeefdeadbee", f"see {KEY}! and {KEY.lower()}", f"url /a/{KEY}/b/c", "EXAMPLEkey0EXAMPLEkey0EXAMPLEkey0",
    "4F3A9C21D8E7B6050F1E2D3C4B5A6978", "secret==" + "Q" * 30, "x" * 70_000 + " token=abcdefghijklmnopqrstuv", "password=aaaaaaaaaaaa,token=bbbbbbbbbbbb", "a1B" * 20_000,
]


def base_spans(s: str) -> str:
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(s) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", s) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", s) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def best_entropy(s: str, window: int) -> float:
    found = []
    for k in range(len(s) - window + 1):
        part = s[k : k + window]
        found.append(-sum(part.count(c) / window * np.log2(part.count(c) / window) for c in set(part)))
    return max(found)


def test_base_spans_and_added_ones(spark):
    docs = documents(spark, list(enumerate(TEXTS)))
    rows = {r.doc_id: r for r in secrets.digest(docs).collect()}
    for i, text in enumerate(TEXTS):
        want = base_spans(text or "")
        assert rows[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text
        assert [x for x in rows[i].spans.split(",") if x and not x.startswith("entropy")] == [x for x in want.split(",") if x]
    added = lambda i: [x for x in rows[i].spans.split(",") if x.startswith("entropy")]
    assert added(11) == ["entropy_token:4:28"] and added(14) == ["entropy_hex:0:32"]
    assert not added(12) and not added(13) and not added(18)
    assert secrets.digest(docs.limit(0)).count() == 0


def test_window_entropy_by_counting(spark):
    rng = random.Random(3)
    symbols = secrets.CLASSES[1][2]
    strings = ["".join(rng.choices(symbols[: rng.choice([2, 10, 67])], k=rng.randint(20, 80))) for _ in range(60)]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    for s, got in df.select("s", secrets.window_entropy(df["s"], symbols, 24)).collect():
        assert got is None if len(s) < 24 else abs(got - best_entropy(s, 24)) < 1e-9


def test_long_keys_paths_and_single_case(spark):
    rng = random.Random(5)
    keys = [base64.b64encode(rng.randbytes(n)).decode() for n in (64, 128, 256, 512) for _ in range(50)]
    pick = lambda symbols, n: "".join(rng.choices(symbols, k=n))
    low, up = "ghijklmnopqrstuvwxyz0123456789", "GHIJKLMNOPQRSTUVWXYZ0123456789"
    hooks = [f"https://hooks.chat.com/services/T{pick(up, 8)}/B{pick(up, 8)}/q9R{pick(low + up, 21)}" for _ in range(20)]
    single = [pick(symbols, 32) + "7" for symbols in (low, up) for _ in range(20)]
    letters = ["QwErTyUiOpAsDfGhJkLzXcVb12"]
    plain = [
        "src/main/java/FooBar/BazQux2/Widget-Factory_Impl3/index", "Some-Long_Chain-of-Words_and-More-Words2024", "com/watch/Very/Long/Address/Of/Pages/2024/03/Part2",
        "/usr/local/share/Fonts2/TrueType/DejaVu/sans", "ab-" * 20_000 + "Ab1", "Ab/" * 20_000 + "Ab1", "a/" * 20_000 + "A1",
    ]
    docs = documents(spark, list(enumerate(keys + hooks + single + letters + plain)))
    found = {r.doc_id: r.spans for r in secrets.digest(docs).collect()}
    secret = len(keys) + len(hooks) + len(single) + len(letters)
    assert [i for i in range(secret) if "entropy" not in found[i]] == []
    assert [plain[i - secret][:40] for i in range(secret, len(found)) if "entropy" in found[i]] == []


def test_redaction(spark):
    docs = documents(spark, list(enumerate(TEXTS)))
    rows = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert rows[0] is None and rows[1] == "" and rows[2] == TEXTS[2]
    assert rows[3] == "[REDACTED]\" end" and rows[17] == "[REDACTED],[REDACTED]" and rows[6] == "🙂 [REDACTED]' x"
    assert secrets.redact(docs).columns == docs.columns


# --- shingles


def plain_set(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_join(rows: list[tuple]) -> dict:
    sets = {i: plain_set(t) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_shingle_sets_of_many_texts():
    texts = [None, "", " \n", "a", "A  b\tC d", "a b c d e", "a b c d e f a b c d e", LONG, "é a b c d", "x\x1cy z w v u"]
    got = list(shingle_sets(texts))
    assert [len(s) for s in got] == [len(plain_set(t)) for t in texts]
    assert overlap(got[5], got[6]) == 1 and overlap(got[0], got[6]) == 0
    assert (next(shingle_sets(["a B c"])) == next(shingle_sets(["A\nb  c"]))).all()


def test_join_against_all_pairs(spark):
    rng = random.Random(4)
    passage = words(9, 60)
    rows = [(i, " ".join(words(100 + i, 40))) for i in range(30)]
    base = words(11, 120)
    for i in range(30, 110):  # a group of near copies, some on either side of the limit
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = "".join(rng.choices("xyz", k=6))
        rows.append((i, " ".join(copy)))
    rows += [(i, " ".join(passage + words(i, rng.randint(0, 16)))) for i in range(110, 170)]
    rows += [(i, " ".join(words(20, rng.randint(1, 9)))) for i in range(170, 190)]
    docs = documents(spark, rows)
    want = plain_join(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()} == want


@pytest.mark.parametrize("frequent,small,bucket", [(4, 16, 4096), (3, 2, 2), (4, 100, 3)])
def test_join_with_frequent_tokens(spark, monkeypatch, frequent, small, bucket):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BUCKET_ROWS", bucket)
    rng = random.Random(5)
    base = words(31, 90)
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = "".join(rng.choices("xyz", k=6))
        rows.append((i, " ".join(copy[: rng.randint(70, 90)])))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(documents(spark, rows)).collect()} == plain_join(rows)


def test_join_of_copies_in_several_batches(spark):
    # every text comes twice, in batches of its own: buckets {A, A, B} and {C, C, B} are different ones
    rows = []
    for g in range(20):
        base = words(500 + g, 120)
        for k in range(3):
            copy = list(base)
            copy[40 * k + 20] = f"other{g}{k}"
            rows.append((10 * g + k, " ".join(copy)))
    rows += [(i + 5, text) for i, text in rows]
    docs = documents(spark, rows).repartition(16, "doc_id")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()} == plain_join(rows)


def test_join_of_awkward_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ngram_join.join(docs).collect()
    assert len(got) == len(rows)
    want = plain_join(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] if r.doc_id is not None else r.component_id is None
    assert ngram_join.join(docs.limit(0)).count() == 0
    left = ngram_join.deduplicate(docs)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["None", *(str(i) for i, (_, c) in want.items() if c == i)])
    assert left.columns == docs.columns


# --- quality


def test_quality_learns_rules_and_scores_all(spark):
    rows = [(i, " ".join(words(i, 60)) if i % 3 else " ".join(x + "%%%" for x in words(i, 60))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(600)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, [*rows, (None, "x y"), (1000, None), (1001, ""), (1002, LONG), (1, rows[1][1])])
    got = quality.classify(docs, labels).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id is not None and r.doc_id < 600:
            assert r.predicted == int(r.doc_id % 3 > 0)
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_lasso_leaves_useless_rules_out():
    rng = np.random.default_rng(6)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x, y, names=("a", "b", "c", "d"))
    assert 0 < len(model.rules) < 60
    score = model.intercept + sum(w * r.holds(x) for r, w in zip(model.rules, model.weights, strict=True))
    assert ((score > 0) == (y > 0)).mean() > 0.98


# --- language


def test_code_books_keep_their_distance():
    for n in (2, 3, 4, 5, 9):
        book = language.code_book(n)
        apart = [(a != b).sum() for a, b in itertools.combinations(book, 2)]
        assert len(book) == n and min(apart) >= (1 if n == 2 else 2)


def test_languages(spark):
    sounds = {"aa": "ba la ma na".split(), "bb": "schu pfe zung eit".split(), "cc": "ção ñel ío que".split(), "dd": "ght wor the ing".split()}
    rng = random.Random(8)
    rows = []
    for i in range(400):
        lang = sorted(sounds)[i % 4]
        rows.append((i, " ".join("".join(rng.choices(sounds[lang], k=2)) for _ in range(30)), lang))
    rows += [(400, None, "aa"), (401, "", "bb"), (402, "12 345 !!", "aa"), (403, "bala mana " * 40_000, None), (None, "bala mana", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as held_out", "'x' as source")
    codes = language.learn(docs)
    assert codes.languages == ["aa", "bb", "cc", "dd"] and codes.book.shape == (4, 7)
    got = {r.doc_id: r for r in language.identify(docs, codes).collect()}
    for i in range(400):
        assert got[i].lang_pred == sorted(sounds)[i % 4] and 0.5 < got[i].score <= 1
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [got[i].lang_pred for i in (400, 401, 402, 403, None)] == ["und", "und", "und", "aa", "aa"] and got[None].held_out is False
    broken = codes.w.copy()
    broken[:, 0] *= -1  # one wrong bit doesn't change the answer
    codes.w = broken
    assert sum(r.lang_pred == sorted(sounds)[r.doc_id % 4] for r in language.identify(docs.filter("doc_id < 400"), codes).collect()) == 400
    nothing = language.learn(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    one = language.learn(docs.filter("lang = 'aa'"))
    assert {r.lang_pred for r in language.identify(docs.filter("doc_id < 8"), one).collect()} == {"aa"}


def test_secret_sql_has_the_rules_of_the_operator(spark):
    """The registered SQL on strings in which its four classes and the rules of segments matter."""
    import duckdb

    from spanloom.llm import oracle

    rng = random.Random(12)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pick = lambda symbols, n: "".join(rng.choices(symbols, k=n))
    strings = []
    for n in (24, 25, 31, 32, 33, 40, 64):
        for symbols in (upper + digits, lower + digits, "0123456789ABCDEF", "0123456789abcdef", upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_="):
            strings += [pick(symbols, n) for _ in range(3)]
    strings += [f"/{pick(lower, 4)}/{pick(lower, 5)}/{pick(upper + lower + digits, 30)}/{pick(lower, 4)}" for _ in range(6)]
    strings += [f"com/services/T{pick(upper + digits, 8)}/B{pick(upper + digits, 8)}/{pick(upper + lower + digits, 24)}" for _ in range(6)]
    strings += ["a" * 30 + "B1", "ab-cd-ef-gh-ij-kl-mn-op-qr-st-Uv12", "ab-cd-ef-gh-ij-kl-mn-op-qr-St-12", "Example" + pick(upper + lower + digits, 30), "sha256-" + pick(upper + lower + digits, 40)]
    strings += ["123e4567-E89b-12d3-a456-426614174000", "token = " + pick(upper + lower + digits, 11), "secret: " + pick(lower, 12), "AKIA" + pick(upper, 16), pick(lower, 30) + "1", "x/" * 20 + "Y1"]
    rng.shuffle(strings)
    rows = [(i, f"see {a}, {b}.\n{c}") for i, (a, b, c) in enumerate(zip(strings[::3], strings[1::3], strings[2::3]))] + [(1000, None), (1001, "")]
    want = secrets.digest(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = con.execute(oracle.OP8).fetchall()
    assert sorted(got) == sorted(tuple(r) for r in want)
    kinds = {k.split(":")[0] for r in got for k in r[5].split(",") if k}
    assert kinds == set(secrets.KINDS)
