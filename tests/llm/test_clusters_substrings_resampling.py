"""Clusters, substring dedup and resampling against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import TEXTS

from scorelake.llm import clustering, resample, substrings


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- centroid clustering ---

def lloyd(rows, k, rounds, seed=2):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted((brute.sha(f"{seed}:{'' if i is None else i}"), v) for i, v in kept)[:k]
    centres = [v for _, v in drawn]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for n in range(len(centres)):
            mine = [v for (_, v), (_, m) in zip(kept, own) if m == n]
            if mine:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    inertia = Counter()
    for d, n in own:
        inertia[n] += d
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), brute.sha(",".join(map(str, centres[n]))))
                   for (i, _), (d, n) in zip(kept, own)), key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(5)
    made = [[rng.gauss(k % 5, 0.3) for _ in range(64)] for k in range(60)]
    rows = [(k, v) for k, v in enumerate(made)]
    rows += [(100, None), (101, [1.0] * 63), (102, [1.0] * 63 + [None]), (103, [float("nan")] + [0.0] * 63),
             (104, [float("inf")] * 64), (105, []), (None, made[3]), (7, made[8]), (7, made[8]), (7, made[9]), (200, [0.0] * 64)]
    return rows


def vector_frame(spark, rows, extra="id"):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<double>, {extra} string, far int").repartition(3)


@pytest.mark.parametrize("k, rounds, pivots", [(6, 4, 3), (40, 2, 8), (100, 1, 2), (1, 1, 1)])
def test_clusters(spark, vectors, k, rounds, pivots):
    found = clustering.report(vector_frame(spark, vectors), k=k, rounds=rounds, pivots=pivots)
    assert rows_of(found) == lloyd(vectors, k, rounds)


def test_pivots_spare_distances(spark, vectors):
    """Well-parted groups: few of the twelve centroids are measured."""
    found, _ = clustering.cluster(vector_frame(spark, vectors[:60]), k=12, rounds=2)
    assert found.agg(F.avg("measured")).first()[0] < 6


def test_bounds_never_lose_the_nearest():
    rng = np.random.default_rng(3)
    v, c = rng.integers(-200, 200, (300, 8)), rng.integers(-200, 200, (20, 8))
    c[7], v[:50] = c[3], c[rng.integers(0, 20, 50)]
    pivots = clustering.far_apart(c, 5)
    far = np.sqrt(clustering._squares(v, pivots))
    found, best, _ = clustering.nearest(v, far, c, pivots)
    whole = clustering._squares(v, c)
    assert (found == whole.argmin(axis=1)).all() and (best == whole.min(axis=1)).all()


def test_no_vectors(spark, vectors):
    assert clustering.report(vector_frame(spark, vectors).where("false")).count() == 0
    assert clustering.report(vector_frame(spark, vectors[60:66])).columns == clustering.report(vector_frame(spark, vectors)).columns
    with pytest.raises(Exception, match="beyond"):
        clustering.report(vector_frame(spark, [(1, [1e9] * 64)])).collect()


# --- substring dedup ---

def deduped(rows, window):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            if i is not None:
                first[tuple(w[k:k + window])] = min(i, first.get(tuple(w[k:k + window]), i))
    out = []
    for i, w in texts:
        gone = {k + j for k in range(len(w) - window + 1) for j in range(window)
                if i is not None and first[tuple(w[k:k + window])] < i}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), brute.sha(b" ".join(kept))))
    return sorted(out, key=repr)


def document_frame(spark, rows, names=("id", "th", "owner", "a.b")):
    shape = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], shape).repartition(4)


def test_automaton_matches_plain_search():
    rng = random.Random(1)
    for _ in range(30):
        passages = [[rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(4)]
        held = {tuple(p[a:b]) for p in passages for a in range(len(p)) for b in range(a + 1, len(p) + 1)}
        text = [rng.randrange(4) for _ in range(25)]
        want = [max((n for n in range(1, k + 2) if tuple(text[k + 1 - n:k + 1]) in held), default=0) for k in range(len(text))]
        automaton = substrings.Automaton(passages)
        assert list(automaton.statistics(text)) == want
        covered = {j for k, n in enumerate(want) if n >= 3 for j in range(k + 1 - n, k + 1)}
        spans = automaton.spans(text, 3)
        assert {j for a, b in spans for j in range(a, b)} == covered
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    shared = [str(rng.randrange(50)).encode() for _ in range(30)]
    found = []
    for _ in range(5):
        words = [b"x%d" % rng.randrange(99) for _ in range(rng.randrange(40))] + shared + [b"y"] * rng.randrange(9)
        at = words.index(shared[0]) if words[words.index(shared[0]):][:30] == shared else len(words) - words[::-1].index(shared[-1]) - 30
        own, starts = substrings.anchors(words, 20, 4)
        each = np.repeat(own, np.diff([*starts, len(words) - 19]))
        found.append(each[at:at + 11].tolist())
    assert all(x == found[0] for x in found) and len(substrings.anchors(shared[:19], 20, 4)[0]) == 0


@pytest.mark.parametrize("window, gram, chunk, stream", [(5, 2, 7, 11), (6, 6, 1000, 1000), (4, 1, 3, 1_000_000), (2, 2, 5, 5)])
def test_random_texts_lose_repeated_windows(spark, window, gram, chunk, stream):
    rng = random.Random(window)
    words = ["a", "b", "c", "dd", "é", "e"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(4, 14))) for _ in range(6)]
    rows = []
    for k in range(70):
        parts = [" ".join(rng.choice(words) + str(rng.randrange(6)) for _ in range(rng.randrange(8)))
                 if rng.random() < 0.5 else rng.choice(passages) for _ in range(rng.randrange(6))]
        rows.append((rng.choice([None, k, k, k, 3]), "  ".join(parts)))
    rows += rows[:10] + [(900 + k, rows[5][1]) for k in range(30)]
    found = substrings.report(document_frame(spark, rows), window=window, gram=gram, chunk=chunk, stream=stream)
    assert rows_of(found) == deduped(rows, window)


def test_odd_texts_and_kept_texts(spark, docs, empty):
    assert rows_of(substrings.report(docs, window=5, gram=2)) == deduped(TEXTS, 5)
    assert rows_of(substrings.report(docs)) == deduped(TEXTS, 50)
    assert substrings.report(empty).count() == 0
    long = " ".join(f"w{k}" for k in range(120))
    rows = [(1, "start " + long), (2, "before\n" + long + " after"), (3, " ".join(long.split()[:49]))]
    result, kept = substrings.dedup(document_frame(spark, rows))
    assert {(r.id, r.n_removed) for r in result.collect()} == {(1, 0), (2, 120), (3, 0)}
    assert [(r.id, r.kept) for r in kept.collect()] == [(2, "before after")]


# --- importance resampling ---

def drawn(rows, target, longest, least, share=10, seed=2024, buckets=10_000):
    def own(text):
        words = brute.alnum_words(text)
        return words, [" ".join(words[k:k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]

    def bucket(x):
        return zlib.crc32(x.encode()) % buckets

    texts = [(i, *own(t)) for i, t in rows]
    s = Counter(bucket(x) for _, _, f in texts for x in f)
    t = Counter(bucket(x) for text in target for x in own(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in {*s, *t}}
    out = []
    for i, words, f in texts:
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) < least])
    able = sorted((x for x in out if not x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[2], x[1]))
    for rank, x in enumerate(able[:share * len(able) // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=repr)


@pytest.mark.parametrize("longest, head_size, least, share", [(1, 50_000, 20, 10), (1, 3, 2, 50), (2, 5, 2, 40), (3, 2, 1, 100)])
def test_resampling(spark, longest, head_size, least, share):
    rng = random.Random(9)
    rows = TEXTS + [(30 + k, " ".join(rng.choice(["The", "cat", "sat", "Été", "x9", "Σ"]) for _ in range(rng.randrange(40)))) for k in range(60)]
    target = [None, "", "the cat sat on the mat", "The CAT", "x9 x9 x9"]
    aim = spark.createDataFrame([(k, t, "x") for k, t in enumerate(target)], "item_id long, text string, raw string")
    found = resample.resample(document_frame(spark, rows, ("id", "raw", "out", "part")), aim, longest=longest, head_size=head_size,
                              least_words=least, share=share)
    assert rows_of(found) == drawn(rows, target, longest, least, share)


def test_resampling_of_nothing(spark, docs, empty):
    aim = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert resample.resample(empty, aim).count() == 0
    assert rows_of(resample.resample(docs, aim.where("false"))) == drawn(TEXTS, [], 1, 20)
