import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pyroclast.llm import bpe, packing
from pyroclast.llm.arrays import flat, same, word_hash, words
from pyroclast.llm.wordcache import WordCache
from pyroclast.llm.queries import op7_bpe_round_trip, op9_packing, tokenizer
from tests.llm.conftest import ODD, sha, thue_morse

FOLDER = "/root/testdata/sf0.001"
BYTE, WORD = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def strange(seed, n=150):
    rng = random.Random(seed)
    bits = ["'s", "'re", "'", " ", "  ", "\n", "\t", " ", "　", "don't", "é", "日本", "🙂", "<|endoftext|>", "<|endoftext|", "12", "½", "!!!", "abc", "The", "́", "\r\n", "ﬁ", "\x00"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def round_trip(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False))


def test_digests_as_the_library(spark, odd, empty):
    t = library(BYTE)
    rows = [(1000 + i, x) for i, x in enumerate(strange(1))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, BYTE).collect()}
    assert got == {i: round_trip(t, x) for i, x in rows}
    got = sorted(tuple(r) for r in bpe.digests(odd, BYTE).collect())
    assert got == sorted((i, *round_trip(t, x)) for i, x, _ in ODD)
    assert bpe.digests(empty, BYTE).count() == 0


def test_round_trip(spark, odd):
    texts = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd, BYTE), BYTE).collect()}
    assert texts == {i: x or "" for i, x, _ in ODD}


def test_query_as_the_library(spark):
    t = library(BYTE)
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op7_bpe_round_trip(spark, FOLDER).collect()}
    assert got == {r.doc_id: round_trip(t, r.text) for r in rows}


def check_packing(pieces, ids):
    left = {}
    for r in pieces:
        own = next(x for x in ids[r.doc_id] if len(x) == r.doc_tokens)
        assert zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        left.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, all_ids in ids.items():
        assert sum(n for _, n in left[i]) == sum(map(len, all_ids))
    by = {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    totals = [sum(n for _, n in s) for s in by.values()]
    assert all(n == 2048 or n & (n - 1) == 0 for n in totals)


def test_packing(spark, odd, empty):
    t = library(WORD)
    rows = [(1000 + i, x) for i, x in enumerate(strange(2))] + [(i, x) for i, x, _ in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = {}
    for i, x in rows:
        ids.setdefault(i, []).append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4"))
    check_packing(packing.pack(df, WORD).collect(), ids)
    assert packing.pack(empty, WORD).count() == 0


def test_packing_query(spark):
    t = library(WORD)
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    ids = {r.doc_id: [np.array([*t.encode(r.text, add_special_tokens=False).ids, 1], "<u4")] for r in rows}
    check_packing(op9_packing(spark, FOLDER).collect(), ids)


def test_hilbert_curve_is_a_walk():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    order = np.argsort(packing.hilbert(cells, 3))
    assert sorted(packing.hilbert(cells, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_follows_is_bpe():
    v = bpe.vocabulary(BYTE)
    t = library(BYTE)
    rng = random.Random(9)
    for _ in range(300):
        word = "".join(rng.choice("abcdehinorst") for _ in range(rng.randint(1, 20)))
        ids, _ = v.encode_words([word.encode()])
        assert ids.tolist() == t.encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("total", [0, 1, 2047, 2048, 2049, 9999])
def test_edges(total):
    full, cuts = packing.edges(total, 2048)
    assert full == total // 2048 and cuts[0] == full * 2048 and cuts[-1] == total


@pytest.mark.parametrize("size", [1024, 2048])
def test_words_that_polynomials_confuse(size):
    texts = [f"x {w} y" for w in thue_morse(size)]
    for path, encode in ((BYTE, bpe.Vocabulary(BYTE).encode), (WORD, lambda d, o: packing.Tokens(WORD).encode(d, o, 1)[:2])):
        ids, count = encode(*flat(pa.array(texts)))
        want = [library(path).encode(t, add_special_tokens=False).ids + ([1] if path == WORD else []) for t in texts]
        assert [p.tolist() for p in np.split(ids, np.cumsum(count)[:-1])] == want


@pytest.mark.parametrize("hashed", [lambda d, a, b: np.zeros(len(a), np.uint64), lambda d, a, b: (b - a).astype(np.uint64)])
def test_words_of_equal_hashes(hashed):
    cache = WordCache(lambda raw: (np.array([x for w in raw for x in w], np.uint32), np.array([len(w) for w in raw], np.int64)), hashed=hashed)
    for text in ("one two three one four", "five two " + "x" * 3000 + " " + "y" * 3000, "abcdefgh abcdefgi", "one"):
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = words(data, np.array([0, len(data)]))
        ids, count, _ = cache.tokens(data, starts, ends)
        assert ids.tolist() == [b for w in text.encode().split() for b in w] and count.tolist() == [len(w) for w in text.split()]


def test_word_hashes_and_comparison():
    rng = random.Random(8)
    pool = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 3, 7, 8, 9, 16, 17, 1024, 1025, 1030]))) for _ in range(300)]
    data = np.frombuffer(" ".join(pool).encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]))
    h = word_hash(data, starts, ends)
    assert len(set(h.tolist())) == len(set(pool)) and len(set(zip(h.tolist(), pool, strict=True))) == len(set(pool))
    other = np.random.default_rng(1).permutation(len(pool))
    size = np.minimum(ends - starts, (ends - starts)[other])
    assert same(data, starts, data, starts[other], size).tolist() == [pool[i][:n] == pool[j][:n] for i, j, n in zip(range(len(pool)), other, size, strict=True)]


def test_tokenizers_that_keep_white_space_are_refused():
    with pytest.raises(ValueError, match="white space"):
        packing.Tokens(BYTE)
    assert packing.Tokens(WORD).lead == "<|"


def plain_and_odd():
    rng = random.Random(3)
    bits = [*packing.LETTERS, *"etaoin" * 20]
    plain = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) + rng.choice(["", "", ",", ".", "$$$", '!"', "</"]) for _ in range(9000)] + ["###", "&", "e", "É."]
    odd = ["don't", "a'", "été", "é", "12", "3rd", "a.b", "×", "÷", "日本", "Ã", "naïve1", "İ", "<|endoftext|>", "x<|endoftext|>", "end.</w>", "</w>", "\x00", "ß'ß"]
    return plain, odd


def test_kinds_of_words():
    plain, odd = plain_and_odd()
    letters, marks = set(packing.LETTERS), set(packing.MARKS)
    for w, n in zip(plain + odd, packing.pieces_of([w.encode() for w in plain + odd]).tolist(), strict=True):
        body = w.rstrip("".join(marks))
        assert n == (bool(body) + (body != w) if set(body) <= letters else 0), w
    assert packing.pieces_of([]).tolist() == []


@pytest.mark.parametrize("broken", [None, "opens", "every"])
def test_plain_words_need_no_special_token(broken, monkeypatch):
    plain, odd = plain_and_odd()
    marked, tokens = [], packing.Tokens(WORD)
    if broken:  # ids that don't show as many pieces as the words have
        tokens.closing[:] = broken == "every"
    monkeypatch.setattr(packing.Tokens, "_marked", lambda self, raw, old=packing.Tokens._marked: marked.extend(raw) or old(self, raw))
    mixed = random.Random(4).sample(plain + odd, len(plain + odd))
    ids, count = tokens._encode([w.encode() for w in mixed])
    t = library(WORD)
    assert [p.tolist() for p in np.split(ids, np.cumsum(count)[:-1])] == [t.encode(w, add_special_tokens=False).ids for w in mixed]
    if not broken:
        assert set(marked) <= {w.encode() for w in odd}


def test_cache_grows_and_is_emptied():
    limit = 50_000
    cache = WordCache(lambda raw: (np.array([len(w) for w in raw], np.uint32), np.ones(len(raw), np.int64)), limit)
    for a in (0, 20_000, 35_000, 60_000, 10_000):
        text = " ".join(f"w{i:0{5 + i % 9}}" for i in range(a, a + 25_000)).encode()
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = words(data, np.array([0, len(data)]))
        for _ in range(2):
            ids, count, _ = cache.tokens(data, starts, ends)
            assert np.array_equal(ids, ends - starts) and (count == 1).all()
        assert 25_000 <= cache.n <= limit and len(cache.slots) >= 2 * cache.n


def test_new_words_cost_little_more_than_the_library():
    """Words that are all new take little more than the tokenizer by itself takes for their text."""
    rng = random.Random(11)
    fresh = {"".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(6, 11))) + rng.choice(["", "", ",", "."]) for _ in range(60_000)}
    text = " ".join(sorted(fresh))
    t, column = library(WORD), pa.array([text])
    ratios = []
    for _ in range(3):
        tokens = packing.Tokens(WORD)  # its cache is empty
        began = time.process_time()
        want = t.encode(text, add_special_tokens=False).ids
        between = time.process_time()
        ids = tokens.encode(*flat(column), 1)[0]
        ratios.append((time.process_time() - between) / (between - began))
        assert ids.tolist() == [*want, 1]
    assert min(ratios) < 1.3, ratios
