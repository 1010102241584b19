"""Periodic runs, quality rules and centroid clusters against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyframe.llm import centroid_clusters, ngram_ratio, periodic_runs, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- periodic runs


def plain_runs(w, least=12):
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            own = w[i : j + p]
            if size >= max(least, 2 * p) and not any(all(own[x] == own[x + q] for x in range(size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)


def repeating(rng):
    n, k = rng.choice([0, 1, 3, 12, 40, 130, 260, 300]), rng.choice([1, 2, 3, 60])
    w = [f"w{rng.randrange(k)}" for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n > 4 else 0):
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        for i in range(a + p, min(n, a + int(p * rng.uniform(2, 6)))):
            w[i] = w[i - p]
    if n > 20 and rng.random() < 0.3:
        w[rng.randrange(n)] = "odd"
    return rng.choice([" ", "\n", "\t ", "  "]).join(w)


def seeded(docs, **how):
    return periodic_runs.collapse(docs, seed=F.crc32(F.col("doc_id").cast("string").cast("binary")), **how)


def test_runs_equal_a_plain_search(spark):
    rng = random.Random(11)
    rows = [(i, repeating(rng)) for i in range(250)] + [(900, None), (901, ""), (None, "a b " * 20), (902, " \n "), (903, "x y " * 12), (903, "x y " * 12)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 10
    found = seeded(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed"]) for r in found)
    assert got == sorted((i is None, i or 0, *plain_collapse(i, t)) for i, t in rows)


def test_runs_of_a_long_text(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    for start, period, size in ((100, 1, 40), (1000, 37, 120), (20_000, 700, 5000), (30_000, 9000, 27_500)):
        for i in range(start + period, start + size):
            words[i] = words[i - period]
    row = seeded(spark.createDataFrame([(0, " ".join(words))], "doc_id long, text string")).first()
    assert {(37, 120), (700, 5000), (9000, 27_500)} <= {(r["period"], r["length"]) for r in row["runs"]} and len(row["runs"]) < 10
    ones = periodic_runs.collapse(spark.createDataFrame([("k", "again " * 100_000)], "key string, text string"), id="key").first()
    assert [tuple(r) for r in ones["runs"]] == [(0, 100_000, 1)] and ones["collapsed"] == "again"


def test_runs_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id string, text string, _id int, runs int, n_words int")
    assert periodic_runs.collapse(empty).collect() == []
    clash = spark.createDataFrame([("a", "x " * 30, 1, 2, 3)], "doc_id string, text string, _id int, runs int, n_words int")
    assert tuple(periodic_runs.collapse(clash).first())[:2] == ("a", 30)
    assert periodic_runs.collapse(clash).columns == ["doc_id", "n_words", "runs", "collapsed"]


# -- quality rules


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def plain_scores(rows, labels):
    """Mean drawn ratios by dictionaries of the n-grams themselves."""
    def shape(x):
        kind = "U" if x.isupper() and len(x) > 2 else "T" if x[0].isupper() else "l" if x[0].isalpha() else "o"
        return kind + re.sub(r"^.*[^\W_]", "", x)[-2:]

    def grams(text):
        w = WORD.findall(text or "")
        low = [re.sub(r"^[\W_]+|[\W_]+$", "", x.lower()) or x for x in w]
        form = [(shape(x), k > 0 and low[k - 1] == low[k]) for k, x in enumerate(w)]
        return [low, [(x,) for x in w], list(zip([None, *w], w)), list(zip([None, *form], form))]

    own = [grams(t) for _, t in rows]
    raw, target = collections.Counter(), collections.Counter()
    for (i, _), kinds in zip(rows, own):
        for g in kinds:
            raw.update(g)
            target.update(g * labels.get(i, 0))
    share = sum(len(k[0]) * labels.get(i, 0) for (i, _), k in zip(rows, own)) / max(1, sum(len(k[0]) for k in own))
    out = []
    for (i, _), kinds in zip(rows, own):
        means = []
        for g in kinds:
            total = 0.0
            for x, n in collections.Counter(g).items():
                e, c = (raw[x] - n) * share + 3, target[x] - n * labels.get(i, 0) + 3
                ratio = math.log(c / e)
                total += n * math.copysign(max(0.0, abs(ratio) - 3 * math.sqrt(1 / c + 1 / e)), ratio)
            means.append(total / max(1, len(g)))
        out.append(sum(means[:-1]) / 3 + min(0, means[-1]))
    return out


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    rows, labels = [], {}
    for i in range(n):
        bad = i % 8 == 0
        words = [rng.choice("the of and to in it that was for".split()) if rng.random() < 0.5 else f"word{rng.randrange(400)}" for _ in range(rng.randint(60, 140))]
        if bad:
            words = [rng.choice(["awful", "vile"]) if rng.random() < 0.1 else x for x in words]
        rows.append((i, "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12)) + rng.choice(["", ".", "!?"])))
        if i % 2 == 0:
            labels[i] = int(not bad)
    return rows, labels


def test_rules_equal_plain_counts_and_scores(spark):
    rows, labels = corpus()
    rows += [(1000, None), (1001, ""), (1002, "same line\nsame line\n \n \nother * | <x>"), (1003, "a b c a b c " * 30), (1004, "é ü ß " * 20), (1005, " ".join(f"u{i}" for i in range(49)) + "\rx"), (None, "of the " * 40)]
    frame = spark.createDataFrame([(i, 1 if x else 0, 0) for i, x in labels.items()], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), frame).collect()}
    for (i, text), score in zip(rows, plain_scores(rows, labels)):
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_counts(text), i
        assert r["score"] == pytest.approx(score, abs=1e-4), i
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.THRESHOLD)
    bad = [found[i]["kept"] for i in range(400) if i % 8 == 0]
    good = [found[i]["kept"] for i in range(400) if i % 8]
    assert sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.99 * len(good)


def test_verdicts_hold_for_documents_without_labels(spark):
    rows, labels = corpus(600, 8)
    frame = spark.createDataFrame([(i, x, 0) for i, x in labels.items()], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["kept"] for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string"), frame).collect()}
    rest = [i for i in found if i % 2]
    assert sum(found[i] for i in rest) >= 0.99 * len(rest)


def test_rules_of_odd_tables(spark):
    labels = spark.createDataFrame([], "doc_id string, quality int, toxic int")
    clash = spark.createDataFrame([("a", "w " * 60, 1, 2), ("b", " ".join(f"w{i}" for i in range(60)), 1, 2)], "doc_id string, text string, _label int, score int")
    assert {r["doc_id"]: (r["score"], r["kept"]) for r in quality_rules.judged(clash, labels).collect()} == {"a": (0.0, False), "b": (0.0, True)}
    assert quality_rules.judged(clash.limit(0), labels).collect() == []


def test_the_least_count_is_the_least_that_can_tell():
    telling = lambda m: math.log((m + 3) / 3) > 3 * math.sqrt(1 / (m + 3) + 1 / 3)
    assert telling(ngram_ratio.LEAST) and not any(map(telling, range(1, ngram_ratio.LEAST)))


# -- centroid clusters


def plain_clusters(rows, k=8, rounds=10):
    own = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(own, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j))
    for _ in range(rounds):
        at = [nearest(v) for _, v in own]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(own, at) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((i is None, i or 0, c, far(v, centroids[c]), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, v), c in zip(own, [nearest(v) for _, v in own]))


def got_clusters(df, **how):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"], r["centroid_sha256"]) for r in centroid_clusters.clustered(df, **how).collect())


def vectors(n, seed, grid=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 64))
    for i in range(n):
        v = centres[i % 6] + rng.normal(size=64) * rng.choice([0.2, 1.5])
        yield i, [float(round(x)) if grid else float(x) for x in v]


@pytest.mark.parametrize("grid", [False, True])
def test_clusters_equal_full_scans(spark, grid):
    rows = [*vectors(300, 1, grid), (300, None), (301, [1.0] * 63), (302, [None] + [1.0] * 63), (303, [float("nan")] + [1.0] * 63), (304, [float("-inf")] * 64), (305, [0.0] * 64), (306, []), (None, [0.5] * 64)]
    rows += rows[:20]  # repeated rows, and ties
    scans = []
    assert got_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), log=scans) == plain_clusters(rows)
    assert scans[0] == 322 and all(x < scans[0] / 2 for x in scans[-2:])


def test_few_equal_and_no_vectors(spark):
    few = [(i, [i / 7] * 64) for i in range(3)]
    assert got_clusters(spark.createDataFrame(few, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding")) == plain_clusters([(i, [float(np.float32(x)) for x in v]) for i, v in few])
    same = [(i, [0.25] * 64) for i in range(20)]
    assert got_clusters(spark.createDataFrame(same, "vec_id long, embedding array<double>")) == plain_clusters(same)
    assert got_clusters(spark.createDataFrame([], "vec_id long, embedding array<double>, v int, cluster int")) == []


def test_huge_components_and_clashing_names(spark):
    rows = [("a", [1e300] * 64, 1, 2), ("b", [-1e300] * 64, 1, 2), ("c", [0.0] * 64, 1, 2)]
    found = centroid_clusters.with_inertia(centroid_clusters.clustered(spark.createDataFrame(rows, "vec_id string, embedding array<double>, cluster int, upper int"))).collect()
    assert {r["vec_id"]: r["distance"] for r in found} == {"a": 0, "b": 0, "c": 0} and {r["inertia"] for r in found} == {0}
