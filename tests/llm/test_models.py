import zlib

import numpy as np
import pytest

from pyroclast.llm import language_id, quality
from pyroclast.llm.queries import _fold, op2_language_id, op4_quality

FOLDER = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = op2_language_id(spark, FOLDER).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_ppm_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([("abracadabra", "x"), ("abrakadabra bra", "x"), ("zzzy", "y")], "text string, lang string")
    m = language_id.fit(docs)
    p = np.exp2(-m.bits.reshape(-1, m.symbols, len(m.languages)).astype(float))
    many = np.ones(m.symbols)
    many[-1] = 256 - (m.symbols - 1)
    assert np.allclose((p * many[None, :, None]).sum(1), 1, atol=1e-4)


def test_every_context_is_kept(spark):
    """A language with little text keeps its contexts beside one with more contexts than any fixed budget."""
    rng = np.random.default_rng(2)
    many = ["".join(map(chr, rng.integers(97, 123, 4000))) for _ in range(10)] * 2
    rare = "ÞORPIÐ ER VIÐ ÁNA OG BÆRINN"
    m = language_id.fit(spark.createDataFrame([(t, "x") for t in many] + [(rare, "y")], "text string, lang string"))
    want = set()
    for lang, texts in (("x", many), ("y", [rare])):
        for t in texts:
            data = b"\n\n\n" + t.encode()
            want |= {(lang, k, int.from_bytes(data[i - k : i], "big")) for i in range(3, len(data)) for k in range(4)}
    assert len(want) > 16384
    assert {(r.lang, r.k, r.key) for r in m.table.where("escape").collect()} == want


def test_shards_score_as_one(spark, odd, monkeypatch):
    docs = spark.createDataFrame([("abracadabra", "x"), ("abrakadabra bra", "x"), ("zzzy abra", "y"), ("éàü 日本語", "y")], "text string, lang string")
    one = language_id.fit(docs)
    monkeypatch.setattr(language_id, "SHARD", 20)
    more = language_id.fit(docs)
    assert len(one.ranges) == 1 and len(more.ranges) > 3
    got, want = ([(r.doc_id, r.lang_pred, r.score, r.bits_per_byte or 0, r.n_bytes) for r in language_id.predict(odd, m).orderBy("doc_id").collect()] for m in (more, one))
    assert [(a[0], a[1], a[4]) for a in got] == [(a[0], a[1], a[4]) for a in want]
    assert np.allclose([a[2:4] for a in got], [a[2:4] for a in want])


def test_language_odd_rows(odd, empty, spark):
    m = language_id.fit(odd)
    got = {r.doc_id: r for r in language_id.predict(odd, m).collect()}
    assert {k for k, r in got.items() if r.lang_pred == "und"} == {0, 1, 2, 8}
    assert got[0].score == 0 and len(got) == 11
    assert language_id.fit(empty) is None
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.predict(empty, m).count() == 0
    kept = language_id.keep_known(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7, 9, 10}
    assert language_id.keep_known(empty).count() == 0


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = op4_quality(spark, FOLDER).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    assert all((r.predicted == 1) == (r.score >= 0.3) for r in rows)


def test_quality_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(4, 1), (5, 1), (9, 0), (10, 0), (1, 0), (3, None), (None, 1), (77, 1)], "doc_id long, quality int")
    m = quality.fit(odd, labels)
    rows = quality.score(odd, m).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert quality.fit(odd, labels.where("false")) is None
    assert {r.score for r in quality.score(odd, None).collect()} == {0.5}
    assert quality.score(empty, m).count() == 0


def test_fold_of_null_ids(spark):
    """A row without an id is in fold 0, so ``held_out`` is never null."""
    ids = spark.createDataFrame([(None,), (1,), (2,)], "doc_id long")
    for folds in (3, 5):
        got = {r.doc_id: r.f for r in ids.select("doc_id", _fold("doc_id", folds).alias("f")).collect()}
        assert got == {None: 0} | {i: zlib.crc32(str(i).encode()) % folds for i in (1, 2)}


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    m = quality.Model(0.3, rng.normal(size=quality.size_of(quality.STATS)).astype(np.float32), rng.normal(size=(quality.size_of(quality.STATS), quality.RANK)).astype(np.float32) * 0.1, None, None, None)
    place, value = np.array([3, 17, 90, 400]), rng.random(4).astype(np.float32)
    pairs = sum(m.factor[place[i]] @ m.factor[place[j]] * value[i] * value[j] for i in range(4) for j in range(i))
    want = 1 / (1 + np.exp(-(0.3 + (m.weight[place] * value).sum() + pairs)))
    assert quality._scores(m, 1, np.zeros(4, int), place, value)[0] == pytest.approx(want, rel=1e-4)


def plain_ppm(texts, text):
    """Bits of a text after the texts, by method C with exclusion, straight from its definition."""
    counts = {}
    for t in texts:
        data = b"\n\n\n" + t.encode()
        for i in range(3, len(data)):
            for k in range(4):
                own = counts.setdefault(data[i - k : i], {})
                own[data[i]] = own.get(data[i], 0) + 1

    def chance(context, byte):
        shorter = (lambda b: chance(context[1:], b)) if context else (lambda b: 1 / 256)
        seen = counts.get(context)
        if seen is None:
            return shorter(byte)
        n, d = sum(seen.values()), len(seen)
        if byte in seen:
            return seen[byte] / (n + d)
        return d / (n + d) * shorter(byte) / (1 - sum(shorter(s) for s in seen))

    data = b"\n\n\n" + text.encode()
    return -sum(np.log2(chance(data[i - 3 : i], data[i])) for i in range(3, len(data)))


def test_code_lengths_against_plain_ppm(spark):
    learned = {"x": ["abracadabra", "abrakadabra bra"], "y": ["zzzy abra", "éàü zz"]}
    m = language_id.fit(spark.createDataFrame([(t, lang) for lang, ts in learned.items() for t in ts], "text string, lang string"))
    for text in ("abra", "zzé abrac", "q", "brabra kadabra zzzzy"):
        data = np.frombuffer(text.encode(), np.uint8)
        got = language_id.code_lengths(m.shard(0), 2, data, np.array([0, len(data)]))[0]
        assert np.allclose(got, [plain_ppm(learned[lang], text) for lang in m.languages], rtol=1e-4)


def test_vectors_against_plain_counts():
    text = "the cat the Dog, 12 éa!\nline two the_end aaaaaaaaaaaaaaaaaaaa"
    data = np.frombuffer(text.encode(), np.uint8)
    row, place, value, stats = quality.vectors(data, np.array([0, len(data)]))
    words = text.encode().split()
    where = {w: int(quality.vectors(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[1][0]) for w in set(words)}
    counts = {}
    for w in words:
        counts[where[w]] = counts.get(where[w], 0) + 1
    norm = sum(np.log1p(n) ** 2 for n in counts.values()) ** 0.5
    assert set(row) == {0} and dict(zip(place.tolist(), value.tolist(), strict=True)) == pytest.approx({p: np.log1p(n) / norm for p, n in counts.items()}, rel=1e-5)
    size, raw = len(data), text.encode()
    share = lambda f: sum(f(chr(b)) for b in raw if b < 128) / size
    want = [np.log1p(size), np.log1p(len(words)), np.mean([len(w) for w in words]), share(str.isalpha), share(str.isdigit), share(str.isupper), share(lambda c: c in ".,;:!?")]
    assert stats[0, :7] == pytest.approx(want)
    assert stats[0, -5:] == pytest.approx([max(counts.values()) / len(words), sum(n * n for n in counts.values()) / len(words) ** 2, np.log1p(2), len(words) / 2, 1 / len(words)])


def test_training_against_plain_loops():
    rng = np.random.default_rng(3)
    docs = [(rng.choice(9, 4, replace=False), rng.random(4)) for _ in range(6)]
    y = np.array([1, 0, 1, 0, 1, 1], np.float32)
    size = quality.size_of(0)
    make = lambda: quality.Model(0.1, np.zeros(size, np.float32), np.random.default_rng(4).normal(0, 0.1, (size, quality.RANK)).astype(np.float32), None, None, None)
    m, slow = make(), make()
    quality._train(m, np.repeat(np.arange(6), 4), np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs]).astype(np.float32), y, 3, np.random.default_rng(5), batch=2)
    order, w, v, b = np.random.default_rng(5), slow.weight.astype(float), slow.factor.astype(float), 0.1
    gw, gv, gb = np.full(size, 1e-4), np.full(v.shape, 1e-4), 1e-4
    for _ in range(3):
        turn = order.permutation(6)
        for k in range(0, 6, 2):
            dw, dv, db = {}, {}, 0
            for i in turn[k : k + 2]:
                p, x = docs[i]
                z = b + sum(w[j] * t for j, t in zip(p, x)) + sum(v[p[a]] @ v[p[c]] * x[a] * x[c] for a in range(4) for c in range(a))
                g = 1 / (1 + np.exp(-z)) - y[i]
                db += g / 2
                for j, t in zip(p, x):
                    dw[j] = dw.get(j, 0) + g * t / 2
                    dv[j] = dv.get(j, 0) + g * t * (sum(v[q] * u for q, u in zip(p, x)) - v[j] * t) / 2
            before_w, before_v = w.copy(), v.copy()
            for j in dw:
                a, c = dw[j] + 2e-5 * before_w[j], dv[j] + 2e-5 * before_v[j]
                gw[j] += a**2
                gv[j] += c**2
                w[j] -= 0.08 * a / np.sqrt(gw[j])
                v[j] -= 0.04 * c / np.sqrt(gv[j])
            gb += db**2
            b -= 0.08 * db / gb**0.5
    assert np.allclose(m.weight[:9], w[:9], atol=1e-4) and np.allclose(m.factor[:9], v[:9], atol=1e-4) and m.bias == pytest.approx(b, abs=1e-4)


def test_metadata_columns(spark):
    rows = [(i, "same text", float(i % 2 * 1000) if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, views double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200) if i % 7], "doc_id long, quality int")
    m = quality.fit(df, labels, metadata=("views",))
    got = {r.doc_id: r.score for r in quality.score(df, m).collect()}
    assert min(got[i] for i in range(1, 200, 2) if i % 7) > max(got[i] for i in range(0, 200, 2) if i % 7)
    assert all(0 <= p <= 1 for p in got.values())
