import base64
import collections
import hashlib
import os
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("loomsieve.llm.scan")
from loomsieve.llm import chat, classifier, decontam, jaccard, license, packing, passages, quality_rules, scan, sharding, warc  # noqa: E402

SYL = "an ber cho dri el fo gu hi jo ka lem mi nor op qua ras tu vex wil zo".split()
DOCS = "doc_id long, text string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def prose(rng, n, vocabulary=4000):
    return " ".join(SYL[rng.randrange(20)] + SYL[(w := rng.randrange(vocabulary)) % 20] + SYL[w // 20 % 20] + ("" if rng.random() < 0.8 else ".\n"[rng.randrange(1) :]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Prose with copies, near copies, shared passages, junk, nulls, empties and one long text."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(1, 220)) for _ in range(120)]
    base = prose(rng, 200).split(" ")
    for k in range(14):
        t = list(base)
        for _ in range(k * 2):
            t[rng.randrange(len(t))] = "edit" + str(rng.randrange(9999))
        texts.append(" ".join(t))
    texts += [texts[3]] * 9 + [texts[3].upper(), None, "", "   \n\t", "one", "one", "ONE two", "é ü ñ — 漢字 x y z", prose(rng, 30000)]
    passage = prose(rng, 70)
    texts += [prose(rng, 60) + " " + passage + " " + prose(rng, 50) for _ in range(6)]
    texts += ["a a a a a a a a a b " * 30, "x\n\nx\n y\nx"]
    return [(i * 3, t) for i, t in enumerate(texts)]


def frame(spark, data, schema=DOCS):
    return spark.createDataFrame(data, schema).repartition(3)


# --- words ---


def test_words_and_windows(corpus):
    texts = [t for _, t in corpus]
    w = scan.Words(pa.array(texts))
    assert w.counts.tolist() == [len(spaced(t)) for t in texts]
    assert scan.Words(pa.array(texts), scan.ALNUM).counts.tolist() == [len(alnum(t)) for t in texts]
    h = w.hashes(fold_case=True)
    flat = [x for t in texts for x in spaced(lower(t))]
    assert len(set(h.tolist())) == len(set(flat)) and len(h) == len(flat)
    sliced = pa.array(["skip", *texts]).slice(1)
    assert (scan.Words(sliced).hashes(fold_case=True) == h).all()
    assert [c.num_rows for c in scan.chunks([pa.RecordBatch.from_pydict({"text": ["a" * 9, "b", "c" * 30]})], most=10)] == [2, 1]


# --- op2 ---


def brute_jaccard(data, percent=80):
    sets = []
    for _, t in data:
        w = spaced(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    near = collections.defaultdict(set)
    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                near[i].add(j)
                near[j].add(i)
    out = []
    for i, (doc, _) in enumerate(data):
        seen, todo = {i}, [i]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        out.append((doc, len(sets[i]), len(near[i]), min(data[k][0] for k in seen)))
    return sorted(out)


@pytest.mark.parametrize("hot", [32, 2])
def test_jaccard_is_exact(spark, corpus, hot):
    got = jaccard.near_duplicates(frame(spark, corpus), jaccard.JaccardConfig(hot=hot))
    assert sorted(map(tuple, got.collect())) == brute_jaccard(corpus)


def test_jaccard_repeated_rows_and_nothing(spark):
    data = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None)]
    assert sorted(map(tuple, jaccard.near_duplicates(frame(spark, data)).collect())) == [(1, 2, 1, 1), (1, 2, 1, 1), (2, 0, 0, 2)]
    assert jaccard.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(1, "q r s t u v", 5, "z"), (2, "q r s t u v", 6, "y")], "doc_id long, text string, class long, b string")
    assert [tuple(r) for r in jaccard.representatives(docs).collect()] == [(1, "q r s t u v", 5, "z")]


def test_jaccard_null_doc_id(spark):
    t = "a b c d e f g h i j k l m n o p q r s t"
    data = [(None, t), (2, t + " u"), (None, "x y z a b c"), (None, "x y z a b c"), (5, "lone text of some words here"), (-7, t + " u v")]
    got = sorted(map(tuple, jaccard.near_duplicates(frame(spark, data)).collect()), key=str)
    assert got == sorted([(None, 16, 2, -7), (2, 17, 2, -7), (-7, 18, 2, -7), (None, 2, 1, None), (None, 2, 1, None), (5, 2, 0, 5)], key=str)
    kept = sorted(map(tuple, jaccard.representatives(frame(spark, data)).collect()), key=str)
    assert kept == sorted([x for x in data if x[0] != 2], key=str)


def test_jaccard_of_a_family(spark):
    """Several hundred different near copies of one text, more than are listed pair by pair."""
    rng = random.Random(8)
    base = prose(rng, 120).split(" ")
    data = []
    for k in range(700):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = f"edit{rng.randrange(10**6)}"
        data.append((k, " ".join(t[: 120 - rng.randrange(12)])))
    assert sorted(map(tuple, jaccard.near_duplicates(frame(spark, data)).collect())) == brute_jaccard(data)


@pytest.mark.parametrize("sets, tokens", [(2500, 60), (2500, 1), (400, 200)])
def test_meetings_in_bounded_memory(sets, tokens):
    rng = np.random.default_rng(3)
    has = rng.random((sets, tokens)) < 0.9
    size = rng.integers(200, 330, sets)
    cls, tok = np.nonzero(has)
    # places so early that no pair is ruled out by them
    args = tok.astype(np.uint32), cls * 7 - 50, size[cls].astype(np.uint32), np.zeros(len(cls), np.uint32)
    total = np.zeros((sets, sets), np.int64)
    tracemalloc.start()
    for a, b, need, times in jaccard.meetings(*args, 80):
        assert 0 < len(a) <= 250_000 + sets and (a < b).all()
        i, j = (a + 50) // 7, (b + 50) // 7
        assert (need == 1 + np.minimum(size[i], size[j]) // 10).all()
        np.add.at(total, (i, j), times)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.triu(has.astype(np.int64) @ has.T.astype(np.int64), 1)
    near = np.maximum(size[:, None], size) <= np.minimum(size[:, None], size) * 100 // 80
    assert (total == want * near).all()
    assert peak < 120e6


def test_wanted_map_is_made_of_bits():
    """The largest map, that of the pairs of a large table: 32 MB, not a byte for each bit."""
    size, wide = 1 << 28, 1 << 18
    ids = np.random.default_rng(6).integers(-(1 << 63), 1 << 63, 20_000)
    batches = [pa.RecordBatch.from_pydict({"a": ids[k : k + 5000], "b": ids[k : k + 5000][::-1]}) for k in range(0, 20_000, 5000)]
    tracemalloc.start()
    whole = np.zeros(size // 8, np.uint8)
    for b in jaccard.bit_maps(batches, size, wide):
        for slot, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            whole[slot * wide // 8 : (slot + 1) * wide // 8] = np.frombuffer(m, np.uint8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    wanted = jaccard.Wanted(whole, size)
    assert wanted.holds(ids).all() and all(x in wanted for x in ids[:100].tolist())
    assert int(np.unpackbits(whole).sum()) <= len(ids)
    assert peak < 100e6


def test_prefixes_share_enough():
    rng = np.random.default_rng(1)
    none = np.zeros(0, np.uint32)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        s = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        drop = rng.random(len(s)) < rng.random() * 0.12
        t = np.union1d(s[~drop], rng.integers(0, 1 << 62, int(rng.integers(0, n // 10 + 1)), dtype=np.uint64))
        both = len(np.intersect1d(s, t))
        if not len(t) or 100 * both < 80 * (len(s) + len(t) - both):
            continue
        for order in range(3):
            a, b = (jaccard.prefix(x, order, none, none, 80) for x in (s, t))
            assert len(np.intersect1d(a, b)) >= jaccard.least_shared(min(len(s), len(t)))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    got = {r.node: r.label for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {k: got.get(k, k) for k in label} == label


# --- op6 ---


def brute_rules(t):
    t = t or ""
    w = spaced(t)
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if spaced(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark, corpus):
    data = corpus + [(9001, "x\ny\nx\n"), (9002, "\n\n x\n x"), (9003, "x"), (9003, "x"), (9004, "\n"), (9005, "<p>|#é\n<p>|#é")]
    got = quality_rules.judge(frame(spark, data), quality_rules.Rules()).collect()
    want = collections.Counter((i, *brute_rules(t)) for i, t in data)
    assert collections.Counter((r.doc_id, *[r[k] for k in quality_rules.COUNTS]) for r in got) == want
    for r in got:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)


def test_forest_finds_junk(spark):
    rng = random.Random(8)
    data, labels = [], []
    for i in range(700):
        bad = i % 8 == 0
        words = prose(rng, rng.randrange(30, 120)).split(" ")
        data.append((i, " ".join(w + rng.choice(["###", "%%%", "***"]) if bad else w for w in words)))
        labels.append((i, 0 if bad else 1))
    docs = frame(spark, data)
    rules = quality_rules.fit(docs, spark.createDataFrame(labels[:500], "doc_id long, quality int"))
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, rules).collect()}
    rest = range(500, 700)
    assert sum(got[i] for i in rest if i % 8 == 0) == 0
    assert np.mean([got[i] for i in rest if i % 8]) > 0.95
    kept = quality_rules.keep(docs.selectExpr("*", "doc_id features", "'k' quality"), rules)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in got if got[i]] or set(r.doc_id for r in kept.collect()) == {i for i in got if got[i]}


def test_rules_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.fit(frame(spark, [(1, "a b")]), none).forest is None
    assert quality_rules.judge(spark.createDataFrame([], DOCS), quality_rules.Rules()).count() == 0


# --- op1 ---


def brute_license(t):
    w = alnum(t)
    at, labels = [], set()
    for phrase, label in license.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license(spark, corpus):
    rng = random.Random(4)
    notes = {t[1]: t[0] for t in license.TEMPLATES}
    data = list(corpus)
    truth = {}
    for k, (note, label) in enumerate(notes.items()):
        data.append((5000 + k, prose(rng, 80) + "\n" + note.title() + ".\n" + prose(rng, 9)))
        truth[5000 + k] = label
    data += [(6000, "under-the MIT (license); under the mit license CC-BY-NC"), (6001, "mit license apache"), (6002, "under the mit"), (6003, "license " * 500)]
    got = {r.doc_id: r for r in license.scan_documents(frame(spark, data)).collect()}
    for i, t in data:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    for i, label in truth.items():
        assert label in got[i].labels.split(","), (label, got[i])
    assert all(got[i].labels == "" for i, _ in corpus)
    assert license.scan_documents(spark.createDataFrame([], DOCS)).count() == 0


# --- op3 ---


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, 35)) for k in range(30)] + [(90, None), (91, ""), (92, "two words"), (30, prose(rng, 35))]
    data, truth = [], set()
    for i in range(120):
        t = prose(rng, 150).split(" ")
        if i % 3 == 0:
            k = rng.randrange(30)
            copy = items[k][1].split(" ")
            for _ in range(rng.randrange(7)):  # edits
                copy[rng.randrange(len(copy))] = "changed"
            at = rng.randrange(len(t))
            t[at:at] = copy
            truth.add((i, k))
        data.append((i, " ".join(t)))
    data += [(500 + i, items[0][1]) for i in range(80)] + [(700, None), (701, ""), (702, "here are two words")]
    truth |= {(500 + i, 0) for i in range(80)}
    docs, bench = frame(spark, data), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.matches(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} - {(702, 92)} == truth
    blocks = decontam.matches(docs, bench, decontam.DecontamConfig(block=200))
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} - {(702, 92)} == truth
    clean = decontam.clean(docs.selectExpr("*", "doc_id item_id", "1 score"), bench)
    assert {r.doc_id for r in clean.collect()} - {702} == {i for i, _ in data} - {i for i, _ in truth} - {702} and "item_id" in clean.columns
    assert decontam.matches(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontam.matches(spark.createDataFrame([], DOCS), bench).count() == 0


@pytest.mark.parametrize("copies, edited", [(0, 100), (3, 100)])
def test_decontamination_of_a_frequent_edited_leak(spark, copies, edited):
    """Every fourth word replaced (score 0.75), in a third of the rows, with and without exact copies."""
    rng = random.Random(16)
    item = prose(rng, 40)
    leak = item.split()
    leak[3::4] = [f"changed{k}" for k in range(10)]
    leaks = [item] * copies + [" ".join(leak)] * edited
    data = [(i, f"{prose(rng, 30)} {t} {prose(rng, 30)}") for i, t in enumerate(leaks)]
    data += [(1000 + i, prose(rng, 100)) for i in range(200)]
    docs, bench = frame(spark, data), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontam.matches(docs, bench).collect()} == set(range(len(leaks)))
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {i for i, _ in data if i >= 1000}


def test_decontamination_short_items_and_null_ids(spark):
    rng = random.Random(26)
    item = prose(rng, 30)
    bench = spark.createDataFrame([(1, "Paris"), (2, "in the year 1984"), (None, item), (-1, prose(rng, 30)), (3, None)], "item_id long, text string")
    docs = frame(spark, [(1, "Paris was there in the year 1984"), (2, f"{prose(rng, 9)} {item} {prose(rng, 9)}"), (None, item), (3, None), (4, "")])
    got = sorted(((r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()), key=str)
    assert got == [(2, None), (None, None)]
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [1, 3, 4]


def test_smith_waterman_against_table():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 14)).astype(np.uint64)
        s = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                s[i, j] = max(0, s[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), s[i - 1, j] - 1, s[i, j - 1] - 1)
        matched, lo, hi = decontam.smith_waterman(a, b)
        assert (s.max() == 0) == (matched == 0) and hi - lo <= len(b)
        if s.max():
            assert s[:, hi].max() == s.max() and 2 * matched >= s.max()


# --- op7 ---


def test_minimizers_brute():
    rng = np.random.default_rng(2)
    h = scan.mix(rng.integers(0, 9, 400, dtype=np.uint64))
    first = np.array([0, 3, 100, 100, 107, 250, 400])
    all_, bounds = scan.windows(first, 4)
    at = all_[passages.minimizers(scan.gram_hashes(h, all_, 4), bounds, 6)]
    long = passages.long_grams(h, all_, 4)
    texts = [h[i : i + 4].tobytes() for i in all_]
    assert all((long[i] == long[j]) == (texts[i] == texts[j]) for i in range(0, len(texts), 3) for j in range(0, len(texts), 7))
    want = set()
    for a, b in zip(first[:-1], first[1:]):
        grams = [(int(scan.gram_hashes(h, np.array([i]), 4)[0]), i) for i in range(a, b - 3)]
        for i in range(max(1, len(grams) - 5) if grams else 0):
            want.add(min(grams[i : i + 6])[1])
    assert set(at.tolist()) == want


def brute_chain(seg, gap, reach):
    best = []
    for i, (x, y, n) in enumerate(seg):
        gains = [best[j] - gap * (x - (a + m) + y - (b + m)) for j, (a, b, m) in enumerate(seg[:i]) if a + m <= x and b + m <= y and x - a - m <= reach and y - b - m <= reach]
        best.append(n + max([0, *gains]))
    return max(best)


def test_chaining_against_quadratic():
    rng = np.random.default_rng(4)
    for case in range(1500):
        n = int(rng.integers(1, 14))
        wide = (120, 400)[case % 2]
        seg = np.stack([rng.integers(0, wide, n), rng.integers(0, wide, n), rng.integers(3, 15, n)], axis=1)
        seg = seg[np.lexsort((seg[:, 1], seg[:, 0]))]
        for reach in (passages.PassageConfig().reach, 7, 10**6):
            top = passages.chains(seg, 0.25, reach)
            assert sorted(map(tuple, np.concatenate(top))) == sorted(map(tuple, seg))
            path = top[0]
            score = path[:, 2].sum() - 0.25 * sum(path[k, 0] - path[k - 1, 0] - path[k - 1, 2] + path[k, 1] - path[k - 1, 1] - path[k - 1, 2] for k in range(1, len(path)))
            assert score == pytest.approx(brute_chain(seg.tolist(), 0.25, reach))


def repeats(texts, n=50):
    own = collections.defaultdict(set)
    for i, t in texts:
        w = spaced(lower(t))
        for k in range(len(w) - n + 1):
            own[tuple(w[k : k + n])].add(i)
    return [v for v in own.values() if len(v) > 1]


def test_passages(spark, corpus):
    data = corpus + [(9000, "so it goes " * 50), (9001, "it goes so " * 60), (9002, "goes " * 70 + "so it goes " * 40)]
    docs = frame(spark, data)
    found = passages.passages(docs).collect()
    must = set().union(*[v - {min(v)} for v in repeats(data)])
    got = {r.doc_id for r in found}
    assert must <= got
    plain = {i for k, (i, _) in enumerate(data) if k < 120 and k != 3} - must
    assert not plain & got
    texts = dict(data)
    for r in found:
        a, b = spaced(lower(texts[r.doc_id])), spaced(lower(texts[r.source_doc_id]))
        assert r.source_doc_id < r.doc_id and r.end_word - r.first_word == r.n_words >= 50
        x, y = a[r.first_word : r.end_word], b[r.source_first : r.source_end]
        if r.identity == 1.0:
            assert x == y
    out = passages.remove(docs.selectExpr("*", "'s' spans", "doc_id owner"), passages.passages(docs))
    rest = [(r.doc_id, r.text) for r in out.collect()]
    assert not repeats(rest)
    assert {i for i, _ in data} - {i for i, _ in rest} <= got
    left = dict(rest)
    assert all(left[i] == texts[i] for i in left if i not in got)


def test_passages_whatever_the_split_and_crowd(spark, corpus):
    rng = random.Random(31)
    shared = prose(rng, 60)
    data = corpus + [(8000 + i, f"{prose(rng, 30)} {shared} {prose(rng, 30)}") for i in range(40)]
    seen = []
    for parts, crowd in ((1, 64), (1, 10), (1, 2), (7, 5), (16, 64)):
        docs = spark.createDataFrame(random.Random(parts).sample(data, len(data)), DOCS).repartition(parts)
        seen.append(sorted(map(tuple, passages.passages(docs, passages.PassageConfig(crowd=crowd)).collect())))
    assert len(seen[0]) > 45 and all(x == seen[0] for x in seen)


@pytest.mark.parametrize("words, step, least", [(60, 6, 0.9), (60, 8, 0.95), (60, 10, 0.95), (100, 6, 0.95), (100, 8, 0.98)])
def test_edited_passages(spark, words, step, least):
    """Every ``step``-th word replaced: identity 0.83 to 0.9."""
    rng = random.Random(41)
    own = lambda n: " ".join(f"own{rng.randrange(10**9)}" for _ in range(n))
    data = []
    for k in range(150):
        t = prose(rng, words, 10**6).split(" ")
        edited = [own(1) if i % step == step - 1 else w for i, w in enumerate(t)]
        data += [(2 * k, f"{own(40)} {' '.join(t)} {own(40)}"), (2 * k + 1, f"{own(30)} {' '.join(edited)} {own(50)}")]
    found = passages.passages(frame(spark, data)).collect()
    assert all(r.doc_id == r.source_doc_id + 1 and 30 <= r.first_word and r.end_word <= 30 + words and r.identity >= 0.8 for r in found)
    assert len({r.doc_id for r in found}) >= least * 150
    print(words, step, len({r.doc_id for r in found}) / 150)


def test_passages_without_doc_id(spark):
    t = "one two three four five six seven eight nine ten " * 6
    docs = frame(spark, [(None, t), (None, t), (1, t)])
    assert passages.passages(docs).count() == 0
    assert sorted((r.doc_id or 0, r.text) for r in passages.remove(docs, passages.passages(docs)).collect()) == [(0, t), (0, t), (1, t)]


def test_passages_held_twice(spark):
    """The second copy, and one after a stray use of each of its grams, are found too."""
    rng = random.Random(17)
    own = lambda n: prose(rng, n, 10**6)
    once, stray = own(60), own(60)
    w = stray.split()
    grams = " ".join(" ".join(w[i : i + 6]) + " " + own(3) for i in range(0, 55))
    data = [(1, f"{own(30)} {once} {own(30)}"), (2, f"{own(40)} {once} {own(40)} {once} {own(30)}")]
    data += [(3, f"{grams} {own(30)} {stray} {own(9)}"), (4, f"{own(20)} {stray} {own(20)}")]
    data += [(5, f"{own(20)} {w[0]}x " + "same " * 300), (6, "same " * 200 + own(9))]
    spans = collections.defaultdict(set)
    for r in passages.passages(frame(spark, data)).collect():
        spans[r.doc_id] |= set(range(r.first_word, r.end_word))
    assert set(range(40, 100)) | set(range(140, 200)) <= spans[2]
    assert set(range(20, 80)) <= spans[4]
    assert set(range(200)) <= spans[6]


@pytest.mark.parametrize("one, two, between", [(60, 25, 30), (60, 25, 38), (60, 25, 45), (60, 60, 20), (60, 60, 35), (60, 60, 45), (60, 60, 55), (90, 25, 58)])
def test_passages_with_own_words_between(spark, one, two, between):
    rng = random.Random(18)
    own = lambda n: " ".join(f"own{rng.randrange(10**9)}" for _ in range(n))
    a, b = prose(rng, one), prose(rng, two)
    data = [(1, f"{own(40)} {a} {own(between)} {b} {own(40)}"), (2, f"{own(30)} {a} {own(between)} {b} {own(30)}")]
    docs = frame(spark, data)
    got = sorted((r.first_word, r.end_word) for r in passages.passages(docs).collect())
    first, second = (30, 30 + one), (30 + one + between, 30 + one + between + two)
    assert got == ([first, second] if two >= 50 else [first])
    left = {r.doc_id: r.text for r in passages.remove(docs, passages.passages(docs)).collect()}
    assert " ".join(data[1][1].split()[30 + one : 30 + one + between]) in left[2]


@pytest.mark.parametrize("crowd", [64, 2])
def test_passages_whose_seeds_have_other_owners(spark, crowd):
    """Smaller documents hold all seeds of the passage, but less than a passage each."""
    rng = random.Random(23)
    own = lambda n: " ".join(f"own{rng.randrange(10**9)}" for _ in range(n))
    data, want = [], set()
    for k in range(20):
        t = prose(rng, 50 + k, 10**6).split(" ")
        cuts = [t[i : i + 40] for i in range(0, len(t) - 29, 10)]
        data += [(100 * k + i, f"{own(20)} {' '.join(c)} {own(30)}") for i, c in enumerate(cuts)]
        data += [(100 * k + 50 + i, f"{own(30 + i)} {' '.join(t)} {own(20)}") for i in range(3)]
        want |= {(100 * k + 50 + i, 100 * k + 50, 30 + i, 80 + i + k) for i in (1, 2)}
    found = passages.passages(frame(spark, data), passages.PassageConfig(crowd=crowd)).collect()
    assert want <= {(r.doc_id, r.source_doc_id, r.first_word, r.end_word) for r in found}
    assert all(r.doc_id % 100 > 50 and r.source_doc_id % 100 >= 50 for r in found)


def test_passages_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert passages.passages(empty).count() == 0
    few = frame(spark, [(1, None), (2, ""), (3, "a b c"), (3, "a b c")])
    assert passages.passages(few).count() == 0
    assert passages.remove(few, passages.passages(few)).count() == 4


# --- op8 ---


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation(n):
    p = sharding.Permutation(n)
    out = p(np.arange(n))
    assert sorted(out.tolist()) == list(range(n)) and (p.inverse(out) == np.arange(n)).all()


def test_sharding(spark, corpus):
    data = corpus + [corpus[0]] * 3
    got = sharding.shard(frame(spark, data)).collect()
    size = lambda t: (t or "").encode()
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == collections.Counter((i, len(size(t)) + 8, zlib.crc32(size(t))) for i, t in data)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.shard(spark.createDataFrame(data[::-1], DOCS).repartition(5)).collect()
    key = lambda rows: sorted((r.doc_id, r.text_crc32, r.shard, r.slot) for r in rows)
    assert key(got) == key(again)
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0


# --- op10 ---


def test_warc(spark, tmp_path):
    rng = random.Random(7)
    html = [f"<html><head><title>{k}</title></head><body>{prose(rng, 60)}</body></html>" for k in range(150)]
    html += [html[0]] * 20 + ["", "", None, None, "é" * 5000]
    data = [(i, f"http://example.org/{i}\nx", h) for i, h in enumerate(html)] + [(900, None, html[5]), (900, None, html[5])]
    pages = frame(spark, data, "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    got = warc.archive(pages, folder).collect()
    top = {}
    for i, _, h in data:
        top[h or ""] = max(top.get(h or "", -1), i)
    want = collections.Counter()
    for i, _, h in data:
        raw = (h or "").encode()
        first = top[h or ""] == i
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else top[h or ""]] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    texts = {i: (h or "").encode() for i, _, h in data}
    seen = 0
    for name in os.listdir(folder):
        assert name.endswith(".warc.zst")
        for fields, body in warc.read_archive(f"{folder}/{name}"):
            seen += 1
            if fields["WARC-Type"] == "response":
                assert body == texts[int(fields["WARC-Record-ID"][10:-1])]
    assert seen == len(data)
    assert warc.archive(pages.where("false"), str(tmp_path / "e")).count() == 0


def test_warc_null_page_id(spark, tmp_path):
    data = [(None, "u", "<p>x</p>"), (-1, "u", "<p>x</p>"), (None, "u", "<p>y</p>"), (None, "v", "<p>y</p>"), (None, None, None)]
    got = warc.archive(frame(spark, data, "page_id long, url string, html string"), f"file://{tmp_path}/n").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str) == sorted(
        [(None, 8, "revisit", -1), (-1, 8, "response", None), (None, 8, "response", None), (None, 8, "response", None), (None, 0, "response", None)], key=str
    )


def test_warc_record_alone(tmp_path):
    records = [warc.record(i, "u", b"<p>%d</p>" % i * 50, "S", None) for i in range(300)]
    places = warc.write_archive(str(tmp_path / "a"), records)
    assert warc.read_record(str(tmp_path / "a"), *places[7])[1] == b"<p>7</p>" * 50
    small = warc.write_archive(str(tmp_path / "b"), records[:1])
    assert warc.read_record(str(tmp_path / "b"), *small[0])[1] == b"<p>0</p>" * 50


# --- op4 ---


def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.json")


def test_encoder():
    from tokenizers import Tokenizer

    path = vocabulary()
    t = Tokenizer.from_file(path)
    texts = [" a  b", "x <|endoftext|> y", "  lead", "tail  ", "a b   c", "a  b 　c", "don't 's it's  's", "\n\n a\n b \n", "", None, "é É  ñ ßa 1 2  ３", "a\x85 b \x1cc", "漢 字  漢字"]
    ids, bounds = packing.Encoder(path).encode(pa.array(texts))
    for k, s in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [*t.encode(s or "", add_special_tokens=False).ids, 0]


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    path = vocabulary()
    data = corpus + [corpus[4]] * 2
    got = packing.pack(frame(spark, data), packing.PackConfig(path)).collect()
    t = Tokenizer.from_file(path)
    want = collections.defaultdict(list)
    for i, x in data:
        want[i].append([*t.encode(x or "", add_special_tokens=False).ids, 0])
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, all_ids in want.items():
        ids = all_ids[0]
        assert sum(r.length for r in by[i]) == len(ids) * len(all_ids)
        for r in by[i]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        if len(all_ids) == 1:
            assert sorted(k for r in by[i] for k in range(r.start, r.start + r.length)) == list(range(len(ids)))
    short = 0
    for rows in seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        short += at < 1024
    assert short <= 1
    assert packing.pack(spark.createDataFrame([], DOCS), packing.PackConfig(path)).count() == 0


def test_walk_prefers_low_degree():
    one = lambda *x: np.array(x, dtype=np.int64)
    order = packing.walk(one(10, 11, 12, 13), one(10, 10), one(11, 12), one(1, 1), one(2, 2), one(1, 1))
    assert order == [[3], [1, 0, 2]]
    # the stronger link first, though its end has more links
    order = packing.walk(one(1, 2, 3, 4), one(1, 1, 2), one(2, 3, 4), one(3, 1, 1), one(2, 2, 2), one(2, 1, 1))
    assert order == [[2, 0, 1, 3]]


def brute_links(numbers):
    """(u, v) -> how many sketch values link them, from the whole table."""
    out = collections.Counter()
    for k in range(6):
        line = sorted((s[k], s[(k + 1) % 6], node) for node, s in numbers)
        for a, b in zip(line, line[1:]):
            if a[0] == b[0]:
                out[min(a[2], b[2]), max(a[2], b[2])] += 1
    return out


@pytest.mark.parametrize("block", [7, 40, 10**6])
def test_packing_paths_over_the_whole_graph(spark, block):
    """All links count, whatever the blocks and partitions: paths step along links only, no link is left
    between the ends of two paths, and there are about as many steps as in a walk over the whole."""
    rng = random.Random(23)
    texts = []
    for _ in range(40):
        base = prose(rng, 60).split(" ")
        for _ in range(rng.randrange(1, 9)):
            t = list(base)
            for _ in range(rng.randrange(25)):
                t[rng.randrange(60)] = f"own{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    texts += [texts[0]] * 30 + [None, "", "", "x"]
    data = [(i // 2, t) for i, t in enumerate(texts)]
    cfg = packing.PackConfig(vocabulary(), block=block)
    seen = []
    for parts in (1, 5):
        tokens = packing.tokenized(spark.createDataFrame(data, DOCS).repartition(parts), cfg)
        placed, links = packing.paths(tokens, cfg)
        numbers = [(r.node, tuple(r.sketch)) for r in packing.nodes(tokens).collect()]
        assert [s for _, s in sorted(numbers)] == sorted(s for _, s in numbers) and sorted(n for n, _ in numbers) == list(range(len(texts)))
        graph = brute_links(numbers)
        assert {(r.u, r.v): r.strength for r in links.collect()} == graph
        rows = sorted(map(tuple, placed.select("root", "off", "n", "node").collect()))
        assert sorted(r[3] for r in rows) == list(range(len(texts)))
        whole = collections.defaultdict(list)
        for root, off, n, node in rows:
            assert off == sum(m for m, _ in whole[root])
            whole[root].append((n, node))
        steps = 0
        ends = {}
        for root, path in whole.items():
            for (_, a), (_, b) in zip(path, path[1:]):
                assert (min(a, b), max(a, b)) in graph
                steps += 1
            ends[path[0][1]] = ends[path[-1][1]] = root
        assert not [e for e in graph if e[0] in ends and e[1] in ends and ends[e[0]] != ends[e[1]]]
        lk = links.toPandas()
        once = packing.walk(np.arange(len(texts)), *(lk[c].to_numpy() for c in ("u", "v", "strength", "du", "dv")))
        assert steps >= 0.95 * sum(len(p) - 1 for p in once) > 100
        seen.append((rows, sorted(tuple(r) for r in packing.pack(spark.createDataFrame(data, DOCS).repartition(parts), cfg).collect())))
    assert seen[0][0] == seen[1][0] and seen[0][1] == seen[1][1]


# --- op5 ---


def dialogues(n=60):
    rng = random.Random(9)
    out = []
    for c in range(n):
        for k in range(rng.randrange(1, 9)):
            role = "system" if k == 0 and c % 5 == 0 else ("user", "assistant")[k % 2]
            t = prose(rng, rng.randrange(5, 15)) + "?" if role == "user" else "\n".join(prose(rng, rng.randrange(20, 60)) for _ in range(rng.randrange(1, 5)))
            out.append((c, k, role, t))
    return out


CHAT = "conv_id long, turn long, role string, text string"


def whole(rows):
    """conv_id -> the canonical transcript."""
    out = collections.defaultdict(str)
    for r in sorted(rows, key=lambda r: (r.conv_id is not None, r.conv_id, r.turn is not None, r.turn, r.part)):
        out[r.conv_id] += r.rendered
    return out


def turns_of(text):
    """(role, body) of each turn of a canonical transcript."""
    assert re.fullmatch(r"(<\|(system|user|assistant)\|>\n((?!<\|).*\n)*<\|end\|>\n)*", text), text
    return [(m[1], chat.unescape(m[2])) for m in re.finditer(r"<\|(system|user|assistant)\|>\n(.*?)<\|end\|>\n", text, re.S)]


def test_chat_parsing(spark):
    """Turn boundaries and roles of held-out conversations from texts of several turns."""
    data = dialogues(160)
    marked = chat.with_markers(spark.createDataFrame(data, CHAT))
    model = chat.fit(marked.where("conv_id % 2 = 0"))
    raw = chat.joined(marked)
    assert raw.count() < len(data) / 3
    got = whole(chat.parse(raw, model).collect())
    texts = {(r.conv_id, r.turn): (r.role, r.text) for r in marked.collect()}
    found = right = true = with_mark = marks = 0
    for c in {c for c, *_ in data if c % 2}:
        want, told, at = set(), set(), 0
        for (_, _), (role, text) in sorted((k, v) for k, v in texts.items() if k[0] == c):
            want.add((at, role))
            if chat.marker_of(text)[0]:
                told.add((at, role))
            at += len(text.split("\n"))
        have, at = set(), 0
        for role, body in turns_of(got[c]):
            have.add((at, role))
            at += body.count("\n")
        found, right, true = found + len(have), right + len(have & want), true + len(want)
        with_mark, marks = with_mark + len(have & told), marks + len(told)
    # a quarter of the turns have no marker, and lines of their length may belong to either side
    print("precision", right / found, "recall", right / true, "with marker", with_mark / marks)
    assert right / found > 0.85 and right / true > 0.85 and with_mark / marks > 0.98


def test_chat_loses_nothing(spark):
    odd = ["A", "me", "You", "Answer", "Model: T-34 tank", "Customer > seller", "<|end|>", "<|user|> x <\\|end|>", "plain", "", "User: hi", "Assistant: yes\nUser: and?", "  indented: x", None]
    data = [(1, i, "user", t) for i, t in enumerate(odd)] + dialogues(30)[40:] + [(None, 0, "user", "hello?"), (2, None, None, "x"), (2, None, None, "x")]
    rows = spark.createDataFrame(data, CHAT)
    got = chat.parse(rows, chat.fit(chat.with_markers(spark.createDataFrame(dialogues(60), CHAT)))).collect()
    assert len(got) >= len(data)
    text = collections.defaultdict(list)
    for c, t, _, x in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or 0)):
        text[c] += (x or "").split("\n")
    for c, out in whole(got).items():
        lines = [x for _, body in turns_of(out) for x in body.split("\n")[:-1]]
        assert len(lines) == len(text[c])
        for a, b in zip(text[c], lines):
            assert a == b or (a.endswith(b) and chat.marker_of(a)[0] and a[chat.marker_of(a)[1] :] == b), (a, b)
    for t in odd:
        assert chat.unescape(chat.escape(t or "")) == (t or "") and "<|" not in chat.escape(t or "")
    assert chat.parse(rows.where("false"), chat.fit(rows)).count() == 0
    assert chat.parse(rows, chat.fit(rows.where("false"))).count() >= len(data)


def test_chat_doesnt_know_rows(spark):
    """The same transcript in rows of one turn, of several turns, and of one line."""
    data = dialogues(40)
    marked = chat.with_markers(spark.createDataFrame(data, CHAT))
    model = chat.fit(marked)
    lines = [(r.conv_id, 1000 * r.turn + i, x) for r in marked.collect() for i, x in enumerate(r.text.split("\n"))]
    one = whole(chat.parse(marked, model).collect())
    assert one == whole(chat.parse(chat.joined(marked), model).collect())
    assert one == whole(chat.parse(spark.createDataFrame(lines, "conv_id long, turn long, text string"), model).collect())


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(7)
    for _ in range(12):
        n = int(rng.integers(1, 6))
        count = lambda *s: rng.integers(0, 6, s).astype(float)
        m = chat.Hmm.from_counts(count(chat.STATES), count(chat.STATES, chat.STATES), count(chat.STATES, chat.OBSERVATIONS))
        obs = rng.integers(0, chat.OBSERVATIONS, n).tolist()

        def score(path):
            return m.start[path[0]] + sum(m.emit[s, o] for s, o in zip(path, obs)) + sum(m.step[a, b] for a, b in zip(path, path[1:]))

        best = max(map(score, itertools.product(range(chat.STATES), repeat=n)))
        path = m.decode(obs, None, None)
        assert score(path) == pytest.approx(best) and m.begin(obs).max() == pytest.approx(best)
        assert all(b % 2 == 0 or a // 2 == b // 2 for a, b in zip(path, path[1:])) and path[0] % 2 == 0


def test_split_conversation_equals_whole(spark):
    rows = spark.createDataFrame([(1, k, r, t) for k, (_, _, r, t) in enumerate(dialogues(120))] + [(0, 0, "user", "hi?"), (2, 0, "user", "ho?")], CHAT)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for parts in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        model = chat.fit(rows)
        out.append((sorted((r.conv_id, r.turn, r.part, r.opens, r.rendered) for r in chat.parse(rows, model).collect()), model.start.tolist(), model.step.tolist(), model.emit.tolist()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert out[0] == out[1]


# --- op9 ---


def test_classifier(spark):
    rng = random.Random(12)
    data, labels = [], []
    for i in range(1500):
        bad, toxic = i % 6 == 0, i % 7 == 3
        words = prose(rng, rng.randrange(20, 90), 600).split(" ")
        if toxic:
            for w in rng.sample(["nasty", "vile", "awful", "gross"], 3):
                words[rng.randrange(len(words))] = w
        data.append((i, " ".join(w + "%%%" if bad else w for w in words), "en" if i % 4 else None, "junk" if bad and i % 4 else f"s{i % 5}", len(words)))
        labels.append((i, 0 if bad else 1, int(toxic)))
    docs = frame(spark, data, "doc_id long, text string, lang string, source string, n_chars long")
    model = classifier.fit(docs, spark.createDataFrame(labels[:900], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in classifier.score(docs, model).collect()}
    rest = [i for i in range(900, 1500)]
    assert np.mean([got[i].kept for i in rest if i % 6 and i % 7 != 3]) > 0.93
    assert np.mean([got[i].kept for i in rest if i % 6 == 0 or i % 7 == 3]) < 0.1
    none = classifier.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r.kept for r in classifier.score(docs.limit(5), none).collect())
    odd = spark.createDataFrame([(1, None, 7), (2, "", 8)], "doc_id long, text string, kept int")
    assert classifier.score(odd, model).count() == 2 and classifier.score(docs.where("false"), model).count() == 0


def test_co_training_round_by_brute_force(spark):
    """One round and its steps over the stored pool equal the same done on whole matrices."""
    rng = random.Random(14)
    data, labels = [], []
    for i in range(700):
        bad = i % 3 == 0
        words = prose(rng, rng.randrange(20, 60), 300).split(" ")
        if bad:
            words[::4] = ["spam"] * len(words[::4])
        data.append((i, " ".join(words), "en", "junk" if bad and i % 2 else f"s{i % 4}", len(words)))
        labels.append((i, 0 if bad else 1, None))
    docs = frame(spark, data, "doc_id long, text string, lang string, source string, n_chars long")
    cfg = classifier.CoTrainConfig(rounds=1, steps=2, share=0.2, sure=0.6)
    ids = np.arange(300)
    y = np.array([q for _, q, _ in labels])
    texts = pa.array([t for _, t, *_ in data])
    w, bounds = classifier.word_ids(texts)
    _, stats = classifier.statistics(texts)
    slots = classifier.meta_rows(*[[r[k] for r in data] for k in (2, 3, 4)])
    take = lambda: classifier.Labelled(w[: bounds[300]], bounds[:301], stats[:300], slots[:300], y[:300], classifier.parts_of(ids), cfg)
    got, want = take(), take()
    pool = classifier.pool_features(classifier.selected(docs), [got], ids)
    classifier.co_train(pool, [got], cfg)
    h = want.head
    x = [m[300:] for m in (h.text_matrix(w, bounds, stats.astype("<f4").astype(float)), h.meta_matrix(slots))]
    pseudo = {}
    want.calibrate()
    for view, m in enumerate((h.text, h.meta)):
        z = np.floor((h.scales[view].logit(m.logit(x[view])[:, None]) + 30) * 100)
        order = np.sort(z)
        most = int(0.2 * len(z))
        limit = np.floor((np.log(0.6 / 0.4) + 30) * 100)
        up = [v for v in np.unique(z) if (z >= v).sum() <= most and v > limit]
        down = [v for v in np.unique(z) if (z <= v).sum() <= most and v < 6000 - limit]
        pseudo[1 - view] = (z >= min(up, default=9999), z <= max(down, default=-1))
        assert len(order) == 400
    before = [m.w.copy() for m in (h.text, h.meta)]
    for _ in range(2):
        for view, m in enumerate((h.text, h.meta)):
            one, zero = pseudo[view]
            on = np.flatnonzero(one | zero)
            xs = np.hstack([x[view][on], np.ones((len(on), 1))])
            z = np.clip(xs @ m.w, -30, 30)
            want.step(view, xs.T @ (classifier.sigmoid(z) - one[on]), -np.log(classifier.sigmoid(np.where(one[on], z, -z))).sum(), len(on))
    assert sum(a.sum() + b.sum() for a, b in pseudo.values()) > 50
    for a, b, c in zip((got.head.text, got.head.meta), (h.text, h.meta), before):
        np.testing.assert_allclose(a.w, b.w, rtol=1e-6, atol=1e-8)
        assert np.abs(a.w - c).max() > 1e-3
    # each view is calibrated on rows of its own
    head = got.finish(cfg, False)
    rows = np.flatnonzero(classifier.parts_of(ids) == classifier.CALIBRATE)
    for m, scale, xv in zip((head.text, head.meta), head.scales, got.x):
        p = classifier.sigmoid(scale.logit(m.logit(xv[rows])[:, None]))
        assert abs(p.mean() - y[rows].mean()) < 0.05


# --- pipeline ---


def test_pipeline_stages(spark, corpus, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(1)
    items = [(k, prose(rng, 35)) for k in range(5)]
    data = [(i, t, "en", "s", len(t or "")) for i, t in corpus] + [(7000 + k, prose(rng, 60) + " " + items[k % 5][1], "en", "s", 1) for k in range(10)]
    d = str(tmp_path / "in")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame(spark, data, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], d).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
        assert k == 4 or kept[-1].columns == docs.columns
    pairs = [[(r.doc_id, r.text) for r in x.collect()] for x in kept[:-1]]
    want = [i for i, t in pairs[0] if (c := brute_rules(t))[0] >= 20 and 100 * c[4] <= 30 * c[0]]
    assert sorted(i for i, _ in pairs[1]) == sorted(want)
    assert sorted(i for i, _ in pairs[2]) == sorted({r[3] for r in brute_jaccard(pairs[1])})
    assert not repeats(pairs[3])
    assert {i for i, _ in pairs[3]} - {i for i, _ in pairs[4]} == {i for i, _ in pairs[3] if i >= 7000}
    assert {r.doc_id for r in kept[5].collect()} == {i for i, _ in pairs[4]}
    assert corpus_pipeline.run(spark, d).count() == kept[5].count()


def test_pipeline_stages_of_nothing(spark, tmp_path):
    """Empty tables, and rows of which nothing but nulls is known."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    for name, rows in (("none", []), ("nulls", [(None, None, None, None, None)] * 3)):
        docs = spark.createDataFrame(rows, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, d)
            assert k == 4 or out.columns == docs.columns
            if k == 0:  # no words: the base rules reject them
                assert out.count() == 0
            else:
                assert out.count() == len(rows)
