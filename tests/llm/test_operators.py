"""Each operator against brute force, on small inputs with awkward rows."""

import hashlib
import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pointspan.llm import ann_forest, maxent_lm, mixing, quality_rules, sentencepiece_codec, sharding, simhash, toxicity, url_filter, warc
from pointspan.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, fp string, shard string, _text string"
rng = np.random.default_rng(5)


def sentence(n, words="the of and cat dog house tree river stone cloud über niño straße".split()):
    return " ".join(rng.choice(words, n))


@cache
def doc_rows():
    base = sentence(120)
    texts = [None, "", "   \n\t ", "a", "One Two", "one two three", "#### $$$$ ||||", "x" * 5000, base, base, base + " extra", base.upper(), sentence(20_000), "line one here\nline one here\nother\n\n", "\x00\x01 odd \u2028 text", *[sentence(int(n)) for n in rng.integers(40, 200, 60)]]
    rows = [(i, t, None if i % 11 == 3 else "en" if i % 3 else "de", None if i % 13 == 2 else f"s{i % 4}", None, "z", "k", "f", "sh", "t") for i, t in enumerate(texts)]
    return [*rows, rows[20], rows[20], (None, "no id at all here", "en", "s1", 1, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def label_rows(n=60):
    return [(i, None if i % 17 == 0 else int(i % 5 > 0), None if i % 19 == 0 else int(i % 7 == 0), "clash") for i in range(n)] + [(5, 0, 1, "twice"), (None, 1, 1, "x"), (99999, 1, 0, "x")]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(label_rows(), "doc_id long, quality int, toxic int, text string")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Quality rules


def base(text):
    w = words(text)
    shingles = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(shingles)
    covered = {i + k for i, s in enumerate(shingles) if seen[s] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, labels):
    found = quality_rules.quality_rules(docs, labels).collect()
    assert len(found) == len(doc_rows())
    want = Counter((r[0], *base(r[1])) for r in doc_rows())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_risk(spark):
    """Bad documents with symbols go, good ones stay, and too few labels choose no rule."""
    rows = [(i, " ".join(f"w{i * 100 + k}" + ("***" if i % 4 == 0 else "") for k in range(60)), "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    found = quality_rules.quality_rules(docs, labels).groupBy((F.col("doc_id") % 4 == 0).alias("bad")).agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()
    assert {r.bad: r.k for r in found} == {True: 0.0, False: 1.0}
    few = quality_rules.quality_rules(docs.limit(40), labels).filter("NOT kept AND NOT base_failed")
    assert few.count() == 0


def test_binomial_tail(spark):
    rows = [(0, 100), (1, 100), (3, 500), (20, 2000), (70, 100)]
    df = spark.createDataFrame(rows, "k long, n long").withColumn("p", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02))
    for r in df.collect():
        want = 1.0 if r.k > r.n * 0.02 else sum(math.comb(r.n, i) * 0.02**i * 0.98 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(want, rel=1e-9)


# Mixing


def water_fill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mixing(spark, docs):
    found = mixing.mixing(docs).collect()
    assert len(found) == len(doc_rows())
    sizes = defaultdict(int)
    for r in doc_rows():
        sizes[r[3]] += len(words(r[1]))
    target = water_fill(sizes)
    assert Counter((r.doc_id, r.size) for r in found) == Counter((r[0], len(words(r[1]))) for r in doc_rows())
    taken, most = defaultdict(int), defaultdict(int)
    for r in found:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s, t in target.items():
        assert abs(taken[s] - t) <= most[s]
    assert Counter(found) == Counter(mixing.mixing(docs.repartition(2)).collect())


def test_mixed_rows(spark, docs):
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    plan = Counter()
    for r in mixing.mixing(docs).collect():
        plan[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in rows.collect()) == +plan


# Sharding


def test_sharding(spark, docs):
    found = sharding.sharding(docs, 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in doc_rows())
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_evens_bytes_and_keeps_copies(spark):
    rows = [(i, "same text " * 12 if i % 3 == 0 else f"copy {i // 7} " * 10) for i in range(6000)]
    found = sharding.sharding(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    sums, places = Counter(), defaultdict(set)
    for r in found:
        sums[r.shard] += r.size
        places[r.text_crc32].add(r.shard)
    assert max(sums.values()) / min(sums.values()) < 1.1  # the hot text is split
    assert sum(len(p) > 1 for p in places.values()) <= 12  # other copies stay together


def test_sharding_plans_stay_small(spark):
    """More levels make more jobs, but neither longer plans nor broadcasts, all of which the driver would hold."""
    store = spark._jsparkSession.sharedState().statusStore()

    def plans(shards):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        before = {x.executionId() for x in map(store.executionsList().apply, range(store.executionsList().size()))}
        sharding.sharding(df, shards)  # all jobs of the tree; the result's own is left out
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.executionsList()
        return [x.physicalPlanDescription() for x in map(found.apply, range(found.size())) if x.executionId() not in before]

    df = spark.createDataFrame([(i, f"copy {i // 7} " * (i % 20)) for i in range(600)], "doc_id long, text string")
    few, many = plans(2), plans(16)
    assert len(many) > len(few) > 3
    assert not any("Broadcast" in p for p in many)
    assert max(map(len, many)) < 1.5 * max(map(len, few))


# SimHash


def brute_print(text):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, near=2):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= near:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, docs):
    own = docs.filter("doc_id IS NOT NULL")
    found = simhash.simhash(own).collect()
    prints = {r[0]: brute_print(r[1]) for r in doc_rows() if r[0] is not None}
    groups = brute_groups(prints)
    assert len(found) == own.count()
    for r in found:
        assert int(r.fingerprint, 16) == prints[r.doc_id] and len(r.fingerprint) == 16
        assert r.component_id == groups[r.doc_id]
    kept = simhash.keep_one(own).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(groups.values()))


@pytest.mark.parametrize("bucket", [512, 2])
def test_links_lose_nothing(spark, monkeypatch, bucket):
    """Dense near copies, by blocks and by the words between them."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    local = np.random.default_rng(bucket)
    prints = {int(x) for x in local.integers(0, 2**63, 40)}
    for x in list(prints):
        for _ in range(6):
            prints.add(x ^ (1 << int(local.integers(0, 63))) ^ (1 << int(local.integers(0, 63))))
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
    groups = brute_groups({x: x for x in prints})
    classes = defaultdict(set)
    for x in prints:
        classes[roots.get(x, x)].add(x)
    want = defaultdict(set)
    for x, g in groups.items():
        want[g].add(x)
    assert {frozenset(c) for c in classes.values()} == {frozenset(c) for c in want.values()}


def test_golay_keys_share():
    local = np.random.default_rng(1)
    a = local.integers(0, 2**63, 2000).astype(np.int64)
    b = a ^ (1 << local.integers(0, 63, 2000)) ^ (1 << local.integers(0, 63, 2000))
    keys = []
    for x in (a, b):
        k, rows = simhash.golay_keys(x)
        own = defaultdict(set)
        for key, row in zip(k, rows, strict=True):
            own[row].add(int(key))
        keys.append(own)
    assert all(keys[0][i] & keys[1][i] for i in range(2000))


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    assert {(r.node, r.root) for r in components(df).collect()} == {(i, 0) for i in range(301)} | {(1000, 1000), (1001, 1000)}


# Toxicity


def test_toxicity_accuracy(spark):
    local = np.random.default_rng(3)
    vocabulary = [f"w{i:03d}" for i in range(300)]
    rows, labelled = [], []
    for i in range(1500):
        bad = i % 6 == 0
        text = list(local.choice(vocabulary, 60))
        if bad:
            text[int(local.integers(60))] = str(local.choice(["zorgal", "zorgen", "IDIOT", "blemmish"]))
        rows.append((i, " ".join(text), "clash"))
        if i % 2 == 0:
            labelled.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame(labelled, "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == 1500
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    right = [r.predicted == (r.doc_id % 6 == 0) for r in found if r.held_out or r.doc_id % 2]
    assert sum(right) / len(right) > 0.97
    assert toxicity.keep_clean(docs, labels).count() == sum(r.predicted == 0 for r in found)


def test_toxicity_edges(spark, docs, none, labels):
    assert toxicity.toxicity(docs, labels).count() == len(doc_rows())
    assert toxicity.toxicity(none, labels).count() == 0
    scores = {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()}
    assert max(scores) < 1e-6


# Language model


def test_language_model(spark, docs):
    found = maxent_lm.maxent_lm(docs.filter("doc_id IS NOT NULL")).collect()
    rows = [r for r in doc_rows() if r[0] is not None]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for r in rows if not held(r[0]) for w in [*words(lower(r[1])), None])
    n, v = sum(counts.values()), len(counts)
    chance = lambda w: math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1)))
    want = Counter((r[0], held(r[0]), len(words(r[1])) + 1, sum(counts[w] > 0 for w in [*words(lower(r[1])), None]), n, round(sum(map(chance, [*words(lower(r[1])), None])), 5)) for r in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_language_model_learns_order(spark):
    """In texts that alternate two words, context must help beyond counts."""
    rows = [(i, "alpha beta " * 200) for i in range(40)]
    found = maxent_lm.maxent_lm(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").collect()
    assert found and all(r.score > r.base_score * 0.6 for r in found)


def small_model(counts, vocabulary=0):
    """A size, head names and odds for a few tokens and their counts (that of the end first)."""
    size = maxent_lm.Size(vocabulary)
    head = np.zeros(maxent_lm.HEAD)
    head[: len(counts)] = np.array(counts) + 0.5
    return size, maxent_lm.odds_of(size, head, np.full(1 << size.bits, 0.5))


def test_changes_are_added_by_teams(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "alpha beta " * 200) for i in range(60)], "doc_id long, text string").repartition(6)
    size, odds = small_model([60, 9000, 9000])
    start = np.zeros(size.total, dtype=np.float32)
    whole = maxent_lm.train_round(rows, [b"alpha", b"beta"], start, 0, size, odds)
    monkeypatch.setattr(maxent_lm, "TEAM", 2)
    assert np.abs(whole).max() > 0.05
    assert np.allclose(maxent_lm.train_round(rows, [b"alpha", b"beta"], start, 0, size, odds), whole, atol=2e-3)


def test_every_position_teaches(spark):
    # The end follows beta at the fourth position only, so only that one teaches what comes after beta.
    rows = spark.createDataFrame([(i, "alpha alpha beta") for i in range(40)], "doc_id long, text string").coalesce(1)
    size, odds = small_model([40, 80, 40])
    code = maxent_lm.Codes([b"alpha", b"beta"]).of([b"alpha", b"alpha", b"beta", None])
    one = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(maxent_lm.ROUNDS)) == 0).limit(1)
    change = maxent_lm.views(maxent_lm.train_round(one, [b"alpha", b"beta"], np.zeros(size.total, dtype=np.float32), 0, size, odds), size)
    before, skip = maxent_lm.context(code)
    for at in range(4):
        row = maxent_lm.rows_of(size, 0, np.zeros(1, dtype=np.int64), maxent_lm.contexts(before[at : at + 1], skip[at : at + 1]))[0][0]
        assert np.abs(change[0, 0, row]).max() > 0


def test_rare_words_are_words_of_the_model(spark):
    """Words beyond the commonest, alike in their count, are learned and told apart by their order."""
    common = " ".join(f"c{i} c{i}" for i in range(maxent_lm.HEAD))
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [(i, f"{common} " + "qa qb " * 2) for i in range(1000, 1040)] + [(held[0], "qa qb " * 20), (held[1], "qa qa qb qb " * 10)]
    found = {r.doc_id: r for r in maxent_lm.maxent_lm(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id < 1000").collect()}
    assert math.isclose(found[held[0]].base_score, found[held[1]].base_score)
    assert found[held[0]].score > found[held[1]].score + 1


def test_the_model_grows_with_the_vocabulary():
    small, large = maxent_lm.Size(10_000), maxent_lm.Size(100_000_000)
    assert large.bits > small.bits and large.levels > small.levels and large.row_bits > small.row_bits


@pytest.mark.parametrize("vocabulary", [0, 400_000, 20_000_000])
def test_chances_sum_to_one(vocabulary):
    """Over all head tokens and leaves after a rare context."""
    size, local = maxent_lm.Size(vocabulary), np.random.default_rng(0)
    w = maxent_lm.views(local.normal(0, 0.3, size.total).astype(np.float32), size)
    odds = maxent_lm.odds_of(size, local.random(maxent_lm.HEAD) * 100, local.random(1 << size.bits) + 0.5)
    code = np.concatenate([np.arange(1, maxent_lm.HEAD + 1), maxent_lm.HEAD + 1 + (np.arange(1 << size.bits) << (32 - size.bits))])
    before, skip = np.full(len(code), 500_000_000), np.full(len(code), 77)
    assert math.isclose(np.exp(maxent_lm.log_chances(size, w, odds, before, skip, code)).sum(), 1, rel_tol=1e-5)


def dense_logits(size, w, odds, level, node, before, skip):
    """The logits of a class's digits, one position at a time."""
    own = [np.array([x]) for x in (before, skip)]
    rows = maxent_lm.rows_of(size, level, np.array([node]), maxent_lm.contexts(*own))
    return odds[level][node].astype(np.float64) + sum(w[level, i, rows[i][0]].astype(np.float64) for i in range(3)), rows


def test_chances_and_a_step_against_brute_force():
    """Chances and one gradient step, against softmaxes that are worked out position by position in double precision."""
    local = np.random.default_rng(4)
    size = maxent_lm.Size(1000)
    w = maxent_lm.views(local.normal(0, 0.3, size.total).astype(np.float32), size)
    odds = maxent_lm.odds_of(size, local.random(maxent_lm.HEAD) + 0.1, local.random(1 << size.bits) + 0.5)
    code = np.where(local.random(60) < 0.5, local.integers(1, 40, 60), maxent_lm.HEAD + 1 + local.integers(0, 2**32, 60)).astype(np.int64)
    before, skip = maxent_lm.context(code, np.array([0, 25]))
    assert before[25] == skip[25] == skip[26] == 0 and before[26] == code[25]
    slope, want = np.zeros(w.shape), []
    for b, s, c in zip(before, skip, code, strict=True):
        total = 0.0
        for level in range(size.levels if c > maxent_lm.HEAD else 3):
            node, digit = (int(x[0]) for x in maxent_lm.place(size, level, np.array([c])))
            x, rows = dense_logits(size, w, odds, level, node, b, s)
            p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
            total += math.log(p[digit])
            for i in range(3):
                slope[level, i, rows[i][0]] += p - (np.arange(16) == digit)
        want.append(total)
    assert np.allclose(maxent_lm.log_chances(size, w, odds, before, skip, code), want, rtol=1e-4, atol=1e-4)
    stepped, past = w.copy(), np.zeros_like(w)
    maxent_lm.descend(size, stepped, past, odds, before, skip, code)
    assert np.allclose(past, slope**2, atol=1e-4)
    assert np.allclose(stepped, w - maxent_lm.RATE * slope / np.sqrt(slope**2 + maxent_lm.EASE), atol=1e-5)


def test_common_tokens(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "FREQUENT", 10)
    counts = spark.createDataFrame([(f"t{i}".encode(), 1 + 100 // (i + 1)) for i in range(60)], "token binary, c long")
    least, names, found = maxent_lm.common_tokens(counts)
    assert len(names) <= 10 and sorted(found.tolist(), reverse=True) == found.tolist() and names[0] == b"t0"
    assert counts.filter(F.col("c") >= least).count() == len(names)


def test_rare_tokens_are_joined(spark, monkeypatch, docs):
    own = docs.filter("doc_id IS NOT NULL")
    whole = sorted((r.doc_id, r.n_known, round(r.base_score, 6)) for r in maxent_lm.maxent_lm(own).collect())
    monkeypatch.setattr(maxent_lm, "FREQUENT", 5)
    assert sorted((r.doc_id, r.n_known, round(r.base_score, 6)) for r in maxent_lm.maxent_lm(own).collect()) == whole


# Nearest neighbours


def test_ann_recall(spark):
    local = np.random.default_rng(2)
    v = local.standard_normal((600, 16))
    v[100:140] = v[100]  # one vector, many times
    rows = [(i, [float(x) for x in r], "clash") for i, r in enumerate(v)]
    odd = [(1000, None, ""), (1001, [], ""), (1002, [0.0] * 16, ""), (1003, [float("nan")] * 16, ""), (1004, [None] * 16, ""), (1005, [1.0, 2.0], ""), (1020, [float("inf")] + [1.0] * 15, "")]
    found = ann_forest.ann_forest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank string"), k=10).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in range(0, 600, 20):
        exact = sorted((-float(np.sum(v[q] * v[i])), i) for i in range(600) if i != q)[:10]
        ids = [i for i, _ in got[q]]
        hit += len(set(ids) & {i for _, i in exact})
        assert len(ids) == 10 and q not in ids
        assert all(abs(s - float(v[q] @ v[i])) < 1e-9 for i, s in got[q])
    assert hit / 300 >= 0.9 and max(got) < 600
    hot = [i for i, _ in got[100] if 100 <= i < 140]
    assert hot and hot == list(range(101, 101 + len(hot)))  # ties: the smallest ids


# SentencePiece


def test_sentencepiece_parity(spark, docs):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    found = sentencepiece_codec.sentencepiece(docs, keep=("source",)).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.source) for r in found) == Counter((r[0], tuple(own.encode(r[1] or "")), r[3]) for r in doc_rows())
    assert all(r.n_tokens == len(r.ids) for r in found) and all(r.round_trip for r in found)


def unigram_model():
    """A model file made by hand: a few pieces, bytes for the rest."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(number, data):
        return varint(number << 3 | 2) + varint(len(data)) + data

    import struct

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]]
    pieces += [("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("c", -5.0, 1), ("ab", -5.0, 1), ("▁ab", -6.0, 1), ("abc", -6.5, 1), ("▁a", -5.5, 1)]
    body = b"".join(message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([k])) for p, s, k in pieces)
    return body + message(2, b"\x18\x01" + varint(35 << 3) + b"\x01") + message(3, b"\x18\x01\x20\x00\x28\x01")


def test_unigram_model():
    data = unigram_model()
    spec = sentencepiece_codec.parse_model(data)
    assert spec.model_type == sentencepiece_codec.UNIGRAM and spec.byte_fallback and not spec.squeeze and spec.dummy_prefix
    codec = sentencepiece_codec.Codec(data)
    codec.verify(data, ("abc ab a", "", "cab  abc", "é ab", "b", "abab cc"))


# URLs


def brute_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = lower(re.split(r"[/?#]", rest)[0])
        path = re.split(r"[?#]", rest[len(host) :])[0]
    fits = [(len(h + p), h + p, says) for h, p, says in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [None, "", "no scheme", "http://a.com", "https://A.Com/", "http://example.com/en/x?q=/fr/", "http://www.example.com/en/y#z", "http://WWW.EXAMPLE.com/de/", "ftp://net/es/", "http://b.net/fr/1.html", "http://xnet/fr/", "http://x.net:80/es/", "://com/", "http://u://com/", "http://a\nb.com/x", "http://a.com?x", "http://b.org/bad/1", "http://é.com/en/"]


def test_url_rules(spark, none):
    pages = spark.createDataFrame([(i, u, "<p>", "clash") for i, u in enumerate(URLS)] + [(None, "http://a.com/", None, None)] * 2, "page_id long, url string, html string, rule string")
    found = url_filter.url_filter(pages, pages.select("url", F.lit(None).cast("boolean").alias("bad"))).collect()
    assert len(found) == len(URLS) + 2
    assert url_filter.url_filter(pages.limit(0), pages.select("url", F.lit(True).alias("bad")).limit(0)).count() == 0
    for r in found:
        if r.page_id is not None:
            host, path, rule, says = brute_rule(URLS[r.page_id])
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, says or "allow")


def mined(labelled):
    return url_filter.mine(labelled.select(url_filter.tokens(F.col("url"), url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("tokens"), "bad"))


def test_url_mining(spark):
    rows = [(i, f"http://{'spam' if i % 5 == 0 else 'site'}{i % 3}.org/{'win' if i % 5 == 0 else 'news'}/{i}") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labelled = pages.filter("page_id < 300").withColumn("bad", F.col("page_id") % 5 == 0)
    found = url_filter.url_filter(pages, labelled).collect()
    assert all((r.verdict == "block") == (r.page_id % 5 == 0) for r in found)
    assert all(len(a) < 3 for a in mined(labelled))


def test_url_mining_against_brute_force(spark):
    """Rules are the minimal sets among all subsets of tokens with support, confidence and significance."""
    from itertools import combinations

    local = np.random.default_rng(8)
    kinds = ["k1", "k2", "k3", "k4"]
    rows = []
    for _ in range(800):
        own = sorted({str(x) for x in local.choice(kinds, 3)})
        rows.append((own, bool({"k1", "k2"} <= set(own) and local.random() < 0.9)))
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    n, base = len(rows), sum(b for _, b in rows) / len(rows)
    least = max(url_filter.LEAST_ROWS, math.ceil(url_filter.SUPPORT * n))
    counts = defaultdict(lambda: [0, 0])
    for own, bad in rows:
        for size in range(1, 5):
            for part in combinations(own, size):
                counts[frozenset(part)][0] += 1
                counts[frozenset(part)][1] += bad
    frequent = {s: c for s, c in counts.items() if c[0] >= least}
    sets = len(frequent) + sum(c[1] >= least for c in frequent.values()) + 1
    rules = []
    for s, (have, hits) in frequent.items():
        p = min(hits / have, 1 - 1e-9)
        if hits >= least and p >= url_filter.CONFIDENCE and p > base and have * (p * math.log(p / base) + (1 - p) * math.log((1 - p) / (1 - base))) > math.log(sets / url_filter.CHANCE):
            rules.append(s)
    minimal = {s for s in rules if not any(o < s for o in rules)}
    assert minimal == {frozenset({"k1", "k2"})} == set(url_filter.mine(df))


def test_url_with_many_tokens(spark):
    """Two keys mark bad urls, beside 13 others that are bad more often than each of the two."""
    others = lambda i: "".join(f"&k{j}" for j in range(14) if j != i // 6 % 14)
    rows = [(i, "http://a.org/?" + ("a&b" + others(i), "a", "a", "b", "b", "c" + others(i))[i % 6], i % 6 == 0) for i in range(840)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    found = url_filter.url_filter(pages, pages.filter("page_id < 420")).collect()
    assert all((r.verdict == "block") == (r.page_id % 6 == 0) for r in found)
    assert frozenset({"key=a", "key=b"}) in mined(pages)


def test_url_with_one_of_equal_tokens(spark):
    """Keys that the same labelled urls have make the same rules, so each of them blocks."""
    labelled = spark.createDataFrame([(f"http://a.org/?{'long&s&c' if i % 4 == 0 else 'c'}", i % 4 == 0) for i in range(200)], "url string, bad boolean")
    pages = spark.createDataFrame([(0, "http://b.org/?long"), (1, "http://b.org/?s"), (2, "http://b.org/?c"), (3, "http://b.org/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.url_filter(pages, labelled).collect()} == {0: "block", 1: "block", 2: "allow", 3: "allow"}


@pytest.mark.parametrize("seed", [1, 6])
def test_url_mining_of_many_tokens_against_brute_force(spark, seed):
    """All subsets of 14 tokens, with rows that have most of them; rules have up to seven."""
    local = np.random.default_rng(seed)
    kinds, n = 14, 1500
    has = local.random((n, kinds)) < local.uniform(0.5, 0.97, kinds)
    has[:, 5] &= has[:, 3]
    bad = local.random(n) < 0.03
    for size in (2, 3, 4):
        bad |= has[:, local.choice(kinds, size, replace=False)].all(1) & (local.random(n) < 0.95) & ~has[:, local.integers(kinds)]
        bad |= has[:, local.choice(kinds, 3, replace=False)].all(1) & (local.random(n) < 0.3)
    df = spark.createDataFrame([([f"t{j}" for j in np.flatnonzero(own)], bool(b)) for own, b in zip(has, bad)], "tokens array<string>, bad boolean")
    least, base = max(url_filter.LEAST_ROWS, math.ceil(url_filter.SUPPORT * n)), bad.mean()
    sets = [min(math.comb(kinds, k), sum(math.comb(int(c), k) for c in has.sum(1)) / least) for k in range(kinds + 1)]
    bars = np.maximum.accumulate([math.log(max(m, 1) * 2**k / url_filter.CHANCE) for k, m in enumerate(sets)])
    minimal = []
    for part in sorted(range(1, 1 << kinds), key=int.bit_count):
        own = [j for j in range(kinds) if part >> j & 1]
        if any(part & rule == rule for rule in minimal):
            continue
        rows = has[:, own].all(1)
        have, hits = int(rows.sum()), int((rows & bad).sum())
        if hits >= least and hits >= url_filter.CONFIDENCE * have and hits > base * have:
            odd = hits * math.log(hits / have / base) + (0 if hits == have else (have - hits) * math.log((1 - hits / have) / (1 - base)))
            if odd > bars[len(own)]:
                minimal.append(part)
    want = {frozenset(f"t{j}" for j in range(kinds) if rule >> j & 1) for rule in minimal}
    assert max(map(len, want)) > 3 and set(url_filter.mine(df)) == want


def test_url_tokens_cover_the_url(spark):
    url = "https://m.casino-win.example.com/a/b/c.html?page=2&ref=x;z=1#top"
    df = spark.createDataFrame([(url,), (None,), ("http://a.b/" + "y" * 500,)], "url string")
    own = [r.t for r in df.select(url_filter.tokens(F.col("url"), url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("t")).collect()]
    want = {"end=com", "end=m.casino-win.example.com", "label=casino-win", "word=casino", "word=win", "dir=a", "dir=b", "dir=c.html", "key=page", "key=ref", "key=z", "ext=html", "fragment", "scheme=https", "depth=3"}
    assert want <= set(own[0]) and own[1] == [] and any(t.startswith("dir=") and len(t) == 4 + 64 for t in own[2])


def test_page_labels(spark):
    """A page's text names its document, through tags and entities; words of hosts count as well."""
    docs = spark.createDataFrame([(1, "Bad text & more.\nSecond line"), (2, "A good text here"), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    page = lambda body: f"<html><nav>x</nav><article><h1>t</h1><p>{body}</p></article></html>"
    rows = [(10, "http://a.com/1", page("Bad text &amp; more.<br>Second <b>line</b>")), (11, "http://a.com/2", page("A good text here")), (12, "http://free-casino.com/", page("unknown")), (13, None, None)]
    found = {r.page_id: r.bad for r in url_filter.page_labels(spark.createDataFrame(rows, "page_id long, url string, html string"), docs, labels).collect()}
    assert found == {10: True, 11: False, 12: True, 13: False}


# WARC


def test_warc_round_trip(spark, tmp_path):
    hot = "<html>" + "hot " * 60
    rows = [(i, f"http://h/{i}\r\nX: y" if i % 5 == 0 else None if i % 7 == 0 else f"http://h/ü/{i}", hot if i % 3 == 0 else None if i % 11 == 0 else f"<p>{i // 2}</p>" * (1 + i % 40), "clash") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    first = {}
    for i, _, html, _ in rows:
        first.setdefault(html or "", i)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/a", shard_bytes=20_000, file_bytes=2_000)
    found = {r.page_id: r for r in warc.read_archives(manifest, payloads=True).collect()}
    assert len(found) == 400
    for i, url, html, _ in rows:
        data, r = (html or "").encode(), found[i]
        again = len(data) >= 100 and first[html] != i
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first[html]) if again else ("response", None))
        assert r.payload == (b"" if again else data) and r.url == warc.escaped(url)
    files = sorted(p.name for p in (tmp_path / "a").iterdir())
    assert len(files) > 3 and not any(f.startswith("_tmp") for f in files)
    warc.write_archives(pages.repartition(5), f"file://{tmp_path}/b", shard_bytes=20_000, file_bytes=2_000)
    same = lambda d: {p.name: p.read_bytes() for p in (tmp_path / d).iterdir()}
    assert same("a") == same("b")


def test_warc_shards_are_even(spark, tmp_path):
    """An outlier among the ids, and many rows without an id, make no large shard."""
    texts = [f"<p>{i}</p>" * 300 for i in range(300)]
    rows = [(i, "u", t) for i, t in enumerate(texts)] + [(1 << 60, "u", "far"), (-(1 << 62), "u", "low")] + [(None, "u", t + "x") for t in texts]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/a", shard_bytes=50_000, file_bytes=1 << 30)
    sizes = Counter()
    own = warc.plan_records(pages)[0]
    starts = warc.shard_starts(own, 50_000)
    for r in own.collect():
        sizes[np.searchsorted(np.array(starts), r.place, side="right")] += r.bytes + warc.HEADERS
    assert len(sizes) > 20 and max(sizes.values()) <= 2 * 50_000
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)


def test_warc_edges(spark):
    pages = spark.createDataFrame([(None, None, None), (None, "u", "x" * 200), (1, "u", "x" * 200), (1, "u", "x" * 200), (2, "u", "x" * 200)], "page_id long, url string, html string")
    found = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.warc(pages).collect())
    assert found == [(0, "response", 0), (0, "response", 0), (1, "response", 0), (1, "response", 0), (2, "revisit", 1)]
    assert warc.warc(pages.limit(0)).count() == 0


# All of them


@pytest.mark.parametrize("run", [lambda d, e: mixing.mixing(d), lambda d, e: mixing.mixed(d), lambda d, e: sharding.sharding(d), lambda d, e: simhash.simhash(d), lambda d, e: quality_rules.quality_rules(d, e), lambda d, e: maxent_lm.maxent_lm(d), lambda d, e: sentencepiece_codec.sentencepiece(d)])
def test_empty_tables(spark, none, labels, run):
    assert run(none, labels).count() == 0


@pytest.mark.parametrize("n, most", [(3000, 0.5), (16_000, 0.32)])
def test_ann_looks_at_a_part(n, most):
    """Recall of 0.9 on independent vectors, and the share of vectors looked at."""
    local = np.random.default_rng(6)
    v = local.standard_normal((n, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    looked, hit = [], 0
    queries = np.arange(0, n, n // 60)
    for i, found in ann_forest.Forest(v).candidates(v[queries]):
        scores = v @ v[queries[i]]
        hit += len(set(np.argsort(-scores)[1:21]) & set(found.tolist()))
        looked.append(len(found) / n)
    assert len(looked) == len(queries) and hit / (20 * len(queries)) >= 0.88 and np.mean(looked) < most


def test_empty_vectors(spark):
    assert ann_forest.ann_forest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


ODD = "doc_id long, text string, lang string, source string, _id long, _copies long, _row string, row string, whole string, _key double, rank long, s string, epochs long"


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, repeated ids with other texts, repeated rows, and columns named like the stages' own."""
    own = ("clash",)
    long_, other = sentence(3000), sentence(80)
    rows = [(1, sentence(90)), (1, sentence(95)), (2, other), (2, other), (None, sentence(70)), (None, sentence(75)), (None, None), (3, None), (4, ""), (5, long_), (6, other)]
    full = [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else "a", 7, 8, *own * 3, 0.5, 9, *own, 10) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, ODD)


def test_stages_lose_no_row(spark, odd_docs, labels, none):
    """keep_good drops what fails the base test, keep_clean nothing here, keep_one one of each group only, mixed what isn't drawn."""
    rows = odd_docs.collect()
    good = quality_rules.keep_good(odd_docs, labels)
    assert good.columns == odd_docs.columns
    assert Counter(good.collect()) == Counter(r for r in rows if len(words(r.text)) >= 50 and 2 * base(r.text)[4] <= len(words(r.text)))
    clean = toxicity.keep_clean(odd_docs, labels.limit(0))
    assert Counter(clean.collect()) == Counter(rows)
    one = simhash.keep_one(odd_docs).collect()
    prints = [brute_print(r.text) for r in rows]
    groups = brute_groups(dict(enumerate(prints)))
    assert len(one) == len(set(groups.values())) and not Counter(one) - Counter(rows)
    kept = Counter(brute_print(r.text) for r in one)
    for g in set(groups.values()):
        members = [i for i in groups if groups[i] == g]
        assert sum(kept[p] for p in {prints[i] for i in members}) == 1
        least = min((rows[i].doc_id is None, rows[i].doc_id or 0) for i in members)
        assert any((r.doc_id is None, r.doc_id or 0) == least and brute_print(r.text) in {prints[i] for i in members} for r in one)
    mix = mixing.mixed(odd_docs)
    assert mix.columns == odd_docs.columns
    plan = Counter()
    for r in mixing.mixing(odd_docs).collect():
        plan[r.doc_id, r.size] += r.copies
    assert Counter((r.doc_id, len(words(r.text))) for r in mix.collect()) == +plan
    codes = sentencepiece_codec.sentencepiece(odd_docs, keep=("source",))
    assert codes.count() == len(rows) and all(r.round_trip for r in codes.collect())
    empty = odd_docs.limit(0)
    for stage in (quality_rules.keep_good(empty, labels), toxicity.keep_clean(empty, labels), simhash.keep_one(empty), mixing.mixed(empty), sentencepiece_codec.sentencepiece(empty)):
        assert stage.count() == 0


def test_whole_rows_stay_out_of_python(spark, odd_docs, labels, monkeypatch):
    """What the dropping stages get back from Python is numbers and mined terms, and no wide row is sorted."""
    frame, back = type(odd_docs), []
    through = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda *a, **b: back.append(out := through(*a, **b)) or out)
    one = simhash.keep_one(odd_docs)
    clean = toxicity.keep_clean(odd_docs, labels)
    assert back and not [kind for out in back for _, kind in out.dtypes if "string" in kind]
    for stage in (one, clean):
        plan = stage._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "SortMergeJoin" not in plan
        assert stage.columns == odd_docs.columns and not Counter(stage.collect()) - Counter(odd_docs.collect())


def test_null_ids_are_held_out(spark, odd_docs, labels):
    assert all(r.held_out for r in toxicity.toxicity(odd_docs, labels).collect() if r.doc_id is None)


def test_long_texts_are_cut(monkeypatch):
    """A text cut before single spaces has the ids of the whole one, and words beyond the memo too."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    with open(sentencepiece_codec.MODEL, "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    text = sentence(4000) + "  two spaces " + sentence(500)
    monkeypatch.setattr(sentencepiece_codec, "MEMO_BYTES", 2000)
    monkeypatch.setattr(sentencepiece_codec, "LONG", 1000)
    codec.forget()
    assert list(codec.encode([text, "a b", text])) == [own.encode(text), own.encode("a b"), own.encode(text)]
    assert len(codec.known) < 20 and len(codec.parts(text)) > 5
    codec.plain = False
    codec.first = codec._build(True)
    assert next(iter(codec.encode([text]))) == own.encode(text)


def brute_cutoffs(rows, alpha, delta):
    """The path of cutoffs and its test for one pooled stratum, in plain Python; ``rows``: features by rule, good, lays."""
    names = [name for name, _, _ in quality_rules.RULES]
    grids = {name: quality_rules.cutoffs(top) for name, _, top in quality_rules.RULES}
    first = lambda r, name: next((i for i, c in enumerate(grids[name]) if r[0][name] >= c), quality_rules.STEPS)
    lay = [r for r in rows if r[1] and r[2]]
    deepest = {}
    for name in names:
        for share in (0.0, *quality_rules.SHARES):
            lost = [sum(first(r, name) <= i for r in lay) for i in range(quality_rules.STEPS)]
            deepest[name, share] = sum(c <= share * len(lay) for c in lost) - 1
    path = [{n: max(-1, deepest[n, 0.0] - m) for n in names} for m in range(quality_rules.MARGIN, -1, -1)] + [{n: deepest[n, s] for n in names} for s in quality_rules.SHARES]
    hit = lambda r, step: any(first(r, n) <= step[n] for n in names)
    tested = [r for r in rows if r[1] and not r[2]]
    passed = []
    for step in path:
        k = sum(hit(r, step) for r in tested)
        tail = sum(math.comb(len(tested), i) * alpha**i * (1 - alpha) ** (len(tested) - i) for i in range(k + 1))
        if k > len(tested) * alpha or tail > delta:
            break
        passed.append((sum(hit(r, step) for r in rows if not r[1]), step))
    best = max(b for b, _ in passed)
    step = next(s for b, s in passed if b == best)
    return {n: grids[n][step[n]] if step[n] >= 0 else None for n in names}


def test_cutoffs_against_brute_force(spark):
    local = np.random.default_rng(11)
    rows = []
    for i in range(1200):
        bad = i % 8 == 0
        n = int(local.integers(60, 120))
        rows.append((i, None, n, n * int(local.integers(3, 9)), int(local.integers(0, 4)) + (n // 3) * bad, 0, 0, 10, int(local.integers(0, 2)), int(local.integers(0, 30)), False, not bad))
    labelled = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_bangs long, n_capitals long, base_failed boolean, good boolean")
    lays = {r.doc_id: r.x for r in labelled.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(quality_rules.FOLDS)) == 0).alias("x")).collect()}
    names = labelled.columns
    value = lambda r, expr: (lambda o, u: r[names.index(o)] / r[names.index(u)] if r[names.index(u)] else 0.0)(*expr.split(" / "))
    plain = [({name: value(r, expr) for name, expr, _ in quality_rules.RULES}, r[-1], lays[r[0]]) for r in rows]
    want = brute_cutoffs(plain, quality_rules.ALPHA, quality_rules.DELTA)
    found = quality_rules.choose_cutoffs(labelled).collect()
    assert len(found) == 1 and found[0].key == "*"
    for name in want:
        assert found[0][name] == pytest.approx(want[name]) if want[name] is not None else found[0][name] is None


def test_pipeline(spark, sf):
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "toxicity", "SimHash near-dedup", "mixing sources", "SentencePiece"]
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns
        docs = spark.createDataFrame(kept.collect(), kept.schema)
        assert 0 < docs.count() <= before
        before = docs.count()
    own = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    assert len(set(brute_groups(own).values())) == len(own)  # no two that are linked are left
    last = corpus_pipeline.run(spark, sf)
    assert last.count() > 0 and set(last.columns) >= {"doc_id", "ids", "n_tokens"}
