"""Quality scores, importance resampling and phrases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import differences

from corroba.llm import phrases, quality, resampling
from corroba.llm.phrases import OP13_SQL, Shard, collocations, op13_phrases, parts
from corroba.llm.resampling import OP12_SQL, draw, op12_importance_resampling, resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- resampling -------------------------------------------------------------------------------------


def resampled(docs, target, longest=1, least=20, percent=10, buckets=10_000, seed=2024):
    """By plain recounting. docs: (doc_id, text)."""

    def features(text):
        w = WORDS.findall(lower(text))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)}
    rows = []
    for doc, text in docs:
        w, f = features(text)
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w)])
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    wanted = percent * len(order) // 100
    out, place = [], {}
    for k, r in enumerate(order, 1):
        place.setdefault(id(r), k if k <= wanted else None)
    for r in rows:
        out.append((*r[:4], place.get(id(r))))
    return out


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def test_resampling_against_sql(spark, sf_dir):
    assert differences(spark, sf_dir, op12_importance_resampling, OP12_SQL) == ({}, {})


@pytest.mark.parametrize("longest, percent, least", [(1, 50, 3), (2, 30, 5), (3, 100, 1), (1, 0, 1)])
def test_resampling_against_recounting(spark, longest, percent, least):
    rng = random.Random(longest)
    vocabulary = ["the", "Of", "ÄRGER", "x1", "née", "漢字", "rare%d" % longest]
    docs = [(i % 37, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 12)))) for i in range(90)]
    target = ["the of the", "née x1", None, ""]
    given = spark.createDataFrame(docs, "doc_id long, text string")
    found = resample(given, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, percent=percent, least_words=least)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted_rows(found.collect()) == sorted_rows(resampled(docs, target, longest, least, percent))


def test_resampling_of_odd_rows(spark, odd, nothing):
    target = spark.createDataFrame([("one two",)], "text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    for percent in (50, 100):
        found = resample(odd, target, least_words=1, percent=percent)
        assert sorted_rows(found.collect()) == sorted_rows(resampled(docs, ["one two"], 1, 1, percent))
    assert resample(odd, target.limit(0), least_words=0, percent=100).filter("rank IS NULL").count() == 0
    assert resample(nothing, target).count() == 0
    assert draw(odd, target, least_words=1, percent=100).columns == odd.columns


def test_repeated_rows_are_ranked_one_by_one(spark):
    """A row that a third of the table repeats is one row with a number until it is ranked."""
    docs = spark.range(3000).selectExpr("CASE WHEN id < 1000 THEN 7 ELSE id END AS doc_id", "'word here' AS text")
    found = resample(docs, docs.limit(1), least_words=1, percent=100)
    assert sorted(r["rank"] for r in found.collect()) == list(range(1, 3001))
    assert "functions=[partial_count" in found._jdf.queryExecution().executedPlan().toString()


def test_cutoff():
    assert resampling.cutoff([(5, 3), (9, 1), (1, 4)], 0) == []
    assert resampling.cutoff([(5, 3), (9, 1), (1, 4)], 4) == [(9, 0), (5, 1)]
    assert resampling.cutoff([(5, 3), (9, 1), (1, 4)], 5) == [(9, 0), (5, 1), (1, 4)]


# -- phrases ----------------------------------------------------------------------------------------


def mined(docs, least, longest=4, covered=80, reported=2000):
    f, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {x: n for x, n in f.items() if len(x[1]) > 1 and n >= least}
    gone = {(lang, w[i : i + k]) for (lang, w), n in candidates.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * n >= covered * f[lang, w[i : i + k]]}
    rows = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in gone:
            cut = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            rows.setdefault(lang, []).append((-cut[0], -a, " ".join(w).encode(), f[lang, w[: cut[1]]], f[lang, w[cut[1] :]]))
    return sorted((lang, k, p.decode(), -a, x, y, totals[lang], -s) for lang, found in rows.items() for k, (s, a, p, x, y) in enumerate(sorted(found)[:reported], 1))


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_phrases_against_sql(spark):
    assert differences(spark, "/root/testdata/sf0.01", op13_phrases, OP13_SQL) == ({}, {})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_phrases_against_recounting(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "é", "漢", "x\x1cy", "d\xa0e", "rare", "-"]
    gaps = [" ", " ", " ", " ", "\t", ", ", ".\n", "!", " ; "]
    docs = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(rng.randrange(0, 60)))) for _ in range(80)]
    given = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    found = sorted(tuple(r) for r in collocations(given, least=4).select(COLUMNS).collect())
    assert found == mined(docs, 4) and len(found) > 20
    assert sorted(tuple(r) for r in collocations(given, least=3, longest=3, covered=60, reported=5).select(COLUMNS).collect()) == mined(docs, 3, 3, 60, 5)
    assert sorted(tuple(r) for r in collocations(given, least=3, longest=2).select(COLUMNS).collect()) == mined(docs, 3, 2)


def test_phrases_of_odd_rows(spark, odd, nothing):
    docs = [(r.lang, r.text) for r in odd.collect()]
    assert sorted(tuple(r) for r in collocations(odd).select(COLUMNS).collect()) == mined(docs, 30)
    assert collocations(nothing).count() == 0


def test_texts_and_shards_may_be_cut_anywhere(monkeypatch):
    """Parts of a text share enough words that every phrase is counted once."""
    monkeypatch.setattr(phrases, "TEXT_BYTES", 5)
    rng = random.Random(4)
    text = "".join(rng.choice("abc") + rng.choice([" ", " ", ".", "\t", "  "]) for _ in range(400))
    for orders in (range(1, 2), range(2, 3), range(3, 5)):
        found, shard = Counter(), Shard()
        for k, (words, tail) in enumerate(parts(text.encode(), orders[-1])):
            shard.add("en", words, tail)
            if k % 7 == 6:
                batches, shard = list(shard.counts(orders)), Shard()
                for b in batches:
                    for p, n in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
                        found[p] += n
        for b in shard.counts(orders):
            for p, n in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
                found[p] += n
        want = Counter(" ".join(w[i : i + k]) for w in (re.findall("[^ \t]+", x) for x in text.split(".")) for k in orders for i in range(len(w) - k + 1))
        assert found == want


def test_a_full_bitmap_loses_nothing(spark):
    """Where every bit is set, all phrases are counted; only time is lost."""
    full = np.full(1 << (phrases.BITS - 3), 255, np.uint8)
    plain, marked = Shard(), Shard(full, full)
    for shard in (plain, marked):
        shard.add("en", [b"a", b"b", b"a", b"b", b"c", b"\xff", b"a", b"b"], 0)
    rows = lambda s: sorted((r["phrase"], r["n"]) for b in s.counts(range(3, 5)) for r in b.to_pylist())
    assert rows(plain) == rows(marked) == [("a b a", 1), ("a b a b", 1), ("a b c", 1), ("b a b", 1), ("b a b c", 1)]


# -- quality ----------------------------------------------------------------------------------------


def junk(rng, words):
    return " ".join(w + rng.choice(["%%%", "###", "&&&"]) for w in words)


def labelled(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 120))]
        good = i % 4 > 0
        rows.append((i, " ".join(words) + "." if good else junk(rng, words), int(good)))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    rows = labelled(400, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    return quality.fit(docs, labels, ~quality.held_out("id")), docs, labels


def test_quality_of_held_out_texts(spark, learned):
    network, _, _ = learned
    rows = labelled(200, 2)
    given = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = {r.doc_id: r for r in quality.score(given, network).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    assert sum(found[i].predicted == y for i, _, y in rows) >= 196


def test_scores_against_the_network_by_hand(learned):
    """Every chunk of a text counts, the last as the first, however it is cut into portions."""
    network, _, _ = learned
    filters, bias, dense, dense_bias, last, last_bias = (w.astype(np.float64) for w in network.weights)

    def by_hand(text):
        vectors = []
        for at in quality.starts_of(len(text)):
            codes = [*text[at : at + 261], *[256] * 261][:261]
            response = [sum(filters[w][codes[i + w]] for w in range(6)) for i in range(256)]
            peaks = np.maximum([np.max(response[k : k + 64], 0) + bias for k in range(0, 256, 64)], 0)
            vectors.append(np.concatenate([peaks.max(0), peaks.min(0)]))
        pooled = np.concatenate([np.max(vectors, 0), np.mean(vectors, 0), np.min(vectors, 0), [quality.size_feature(len(text))]])
        return 1 / (1 + np.exp(-(np.tanh(pooled @ dense + dense_bias) @ last + last_bias[0] + network.offset)))

    clean = " ".join(t for _, t, y in labelled(60, 3) if y)
    tail = " ".join(t for _, t, y in labelled(20, 4) if not y)
    texts = [x.encode() for x in ("", "x", "short text", clean, tail, clean + " " + tail, tail + " " + clean)]
    assert np.allclose(network.scores(texts), [by_hand(t) for t in texts], atol=2e-3)
    assert network.scores(texts[5:6])[0] < network.scores(texts[3:4])[0]  # for the end alone


def test_scores_do_not_depend_on_company(learned):
    network, _, _ = learned
    texts = [t.encode() for _, t, _ in labelled(50, 5)] + [b"", b"x", b"y" * 261, b"z" * 262, b"w" * 700_000]
    together = network.scores(texts)
    assert np.allclose(together, [network.scores([t])[0] for t in texts], atol=1e-6)


def test_chunks_cover_the_text():
    for size in (0, 1, 260, 261, 262, 485, 486, 5000):
        starts = quality.starts_of(size)
        seen = np.zeros(max(size, 1), bool)
        for s in starts:
            seen[s : s + 261] = True
        assert seen.all() and starts[-1] + 261 == max(size, 261) and (np.diff(starts) <= quality.STRIDE).all()


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    batch = [(rng.integers(97, 105, (n, 261)).astype(np.int16), 261 * n, y) for n, y in ((1, 0), (3, 1), (2, 0))]
    weights = [w.astype(np.float64) for w in quality._first_weights(rng)]

    def loss(ws):
        total = 0
        for c, n, y in batch:
            r = sum(ws[0][w][c[:, w : w + 256]] for w in range(quality.WIDTH)).reshape(len(c), 4, 64, -1).max(2) + ws[1]
            v = np.maximum(np.concatenate([r.max(1), r.min(1)], 1), 0)
            p = np.concatenate([v.max(0), v.mean(0), v.min(0), [quality.size_feature(n)]])
            z = np.tanh(p @ ws[2] + ws[3]) @ ws[4] + ws[5][0]
            total += np.log1p(np.exp(-z if y else z))
        return total / len(batch)

    found = quality._gradients(weights, batch)
    for k, w in enumerate(weights):
        for at in rng.permutation(np.argwhere(np.abs(found[k]) > 1e-4))[:6]:
            at, e = tuple(at), 1e-6
            up, down = [x.copy() for x in weights], [x.copy() for x in weights]
            up[k][at] += e
            down[k][at] -= e
            assert found[k][at] == pytest.approx((loss(up) - loss(down)) / (2 * e), rel=1e-3, abs=1e-7)


def test_quality_of_odd_rows(spark, odd, nothing, learned):
    network, docs, labels = learned
    rows = quality.score(odd, network).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add(round(r.score, 6))
    assert len(by_id[6]) == 1 and by_id[1] == by_id[2]
    assert quality.score(nothing, network).count() == 0
    everything = quality.F.lit(True)
    assert quality.fit(docs, labels.limit(0), everything) == 0.5
    assert quality.fit(docs, labels.filter("quality = 1"), everything) == 1.0
    assert quality.fit(docs.limit(0), labels, everything) == 0.5
    assert [r.predicted for r in quality.score(odd, 0.5).collect()] == [1] * odd.count()
    doubtful = labels.selectExpr("doc_id", "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 5 ELSE quality END AS quality").union(labels.limit(5))
    assert isinstance(quality.fit(docs, doubtful, everything, train_texts=30), quality.Network)


def test_quality_query_on_held_out_labels(spark):
    import duckdb

    sf_dir = "/root/testdata/sf0.1"
    found = {r.doc_id: r for r in quality.op11_quality(spark, sf_dir).collect()}
    told = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    asked = [(r.predicted, told[i]) for i, r in found.items() if r.held_out and i in told]
    low = [p for p, y in asked if not y]
    assert np.mean([p == y for p, y in asked]) > 0.97 and low.count(0) > 0.9 * len(low)
