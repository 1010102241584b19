"""Deduplication, decontamination, resampling, chats, search and archives against brute force."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rallyframe.llm import chat_format, decontamination, line_dedup, near_duplicates, ngram_ratio, quality, vector_search, warc
from rallyframe.llm.common import split_words

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti") for b in ("ba", "den", "fir", "gol", "hu", "jem", "kas", "lon", "mur", "nis")]
EXTRA = "class long, set string, _id long, host string, line string, key double, label int, _text string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, rows, names="doc_id long, text string, source string"):
    """Rows with extra columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(*r, 1, "s", 2, "h", "l", 0.5, 3, "t") for r in rows], f"{names}, {EXTRA}").repartition(3)


# -- near duplicates


def families(seed=0, n=12, copies=8):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = prose(rng, rng.choice([3, 8, 60, 200])).split()
        out.append(" ".join(base))
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            out.append("  ".join(own).upper() if rng.random() < 0.3 else " ".join(own))
    return out + ["", None, " \n", "one", "ONE", "one two", "two one"]


def brute_components(texts, width, threshold):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({65 + i: 97 + i for i in range(26)}))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and threshold[1] * len(a & b) >= threshold[0] * len(a | b):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return [len(s) for s in sets], root


@pytest.mark.parametrize(("width", "threshold", "tile"), [(3, (85, 100), None), (5, (80, 100), None), (3, (85, 100), 100)])
def test_components_equal_brute_force(spark, monkeypatch, width, threshold, tile):
    if tile:  # so that groups are cut into several
        monkeypatch.setattr(near_duplicates, "TILE", tile)
    texts = families()
    docs = table(spark, [(i, t, "s") for i, t in enumerate(texts)])
    found = {r["doc_id"]: r for r in near_duplicates.near_duplicates(docs, words=width, threshold=threshold).collect()}
    n, root = brute_components(texts, width, threshold)
    assert [found[i]["component_id"] for i in range(len(texts))] == root
    assert [found[i]["n_shingles"] for i in range(len(texts))] == n
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())


def test_a_family_over_many_tiles_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "TILE", 1500)
    rng = random.Random(31)
    base, texts = prose(rng, 120).split(), []
    for i in range(150):
        own = list(base)
        own[rng.randrange(len(own))] = f"x{i}"
        if i % 10 == 9:  # of the same lists, but too far from the rest
            own[20:60] = prose(rng, 40).split()
        texts.append(" ".join(own))
    docs = table(spark, [(i, t, "s") for i, t in enumerate(texts)])
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs, words=3, threshold=(85, 100)).collect()}
    assert [found[i] for i in range(150)] == brute_components(texts, 3, (85, 100))[1]


def test_near_duplicates_of_odd_rows(spark):
    text = prose(random.Random(1), 50)
    docs = table(spark, [(7, text, "s"), (7, text, "s"), (7, "another text altogether", "s"), (None, text, "s"), (3, text, "s")])
    found = sorted((r["doc_id"] or -1, r["component_id"]) for r in near_duplicates.near_duplicates(docs).collect())
    assert found == [(-1, 3), (3, 3), (7, 3), (7, 3), (7, 7)]
    assert near_duplicates.near_duplicates(docs.limit(0)).collect() == []
    kept = near_duplicates.without_near_duplicates(table(spark, [(i, t, "s") for i, t in enumerate(families())]))
    assert kept.columns[:3] == ["doc_id", "text", "source"] and len(kept.columns) == 11
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_components(families(), 5, (80, 100))[1]))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 200)]
    random.Random(3).shuffle(edges)
    found = {r["class"]: r["root"] for r in near_duplicates.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {101: 100, 200: 100}


# -- decontamination


def test_passages_are_found_despite_substitutions(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, n)) for i, n in enumerate([5, 15, 20, 40, 40])] + [(5, None), (6, "")]
    rows, wanted = [], set()
    for i in range(60):
        own = prose(rng, 80).split()
        if i % 3 == 0:
            k = rng.randrange(1, 5)
            passage = items[k][1].split()
            for at in range(4, len(passage), 9):  # one word of nine is another
                passage[at] = "X"
            at = rng.randrange(len(own))
            own[at:at] = [w.capitalize() + "," for w in passage]
            wanted.add((i, k))
        rows.append((i, " ".join(own), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (102, items[3][1], "s"), (102, items[3][1], "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(table(spark, rows), bench).collect()]
    assert set(found) == wanted | {(102, 3)} and found.count((102, 3)) == 2
    kept = decontamination.without_contaminated(table(spark, rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r[0] for r in rows} - {d for d, _ in wanted} - {102})
    assert len(kept.columns) == 11
    assert decontamination.contaminated(table(spark, rows), bench.limit(0)).collect() == []
    assert decontamination.contaminated(table(spark, rows).limit(0), bench).collect() == []


def test_every_accepted_pattern_of_substitutions_is_found():
    for n in range(1, 16):
        words = [f"w{k}" for k in range(n)]
        bench = decontamination.Benchmark([0], [" ".join(words)])
        over = min(n, decontamination.WINDOW)
        for k in range(4):
            gone = list(itertools.combinations(range(over), k))
            texts = ["x y " + " ".join("X" if i in g else w for i, w in enumerate(words)) + " z" for g in gone] + ["", "x " + " ".join(words[:-1])]
            found = sorted(bench.matches(*decontamination.word_hashes(pa.array(texts, pa.string()))))
            accepted = over - k >= decontamination.AGREE * over
            whole = [(t, 0, 2, n, n - k) for t in range(len(gone))] if accepted else []
            assert [x for x in found if x[0] < len(gone) and (accepted or n == over)] == whole, (n, k)


def test_parameters_that_masks_would_miss_are_errors(spark):
    decontamination.checked(13, 0.8)
    decontamination.checked(11, 0.5)
    decontamination.checked(16, 0.9)
    for window, agree in ((13, 0.6), (20, 0.7)):
        with pytest.raises(ValueError, match="masks"):
            decontamination.contaminated(table(spark, [(0, "a", "s")]), spark.createDataFrame([(0, "a")], "item_id long, text string"), window=window, agree=agree)


def test_short_items_are_found_in_tables(spark):
    rng = random.Random(8)
    items = [(0, "ka lo mi ne pu"), (1, "日本語"), (2, "ka lo"), (3, "ka lo mi ne pu ra so")]
    docs = [(0, prose(rng, 30) + " ka lo X ne pu " + prose(rng, 5), "s"), (1, "東京。日本語!", "s"), (2, "ka LO", "s"), (3, "ka X mi ne pu ra so", "s"), (4, "ka x lo mi", "s")]
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(0, 0), (0, 2), (1, 1), (2, 2), (3, 3), (3, 0)}


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, prose(rng, 20)) for i in range(8)]
    docs = table(spark, [(i, prose(rng, 10) + " " + items[i][1], "s") for i in range(8)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontamination.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 100)
    assert sorted(map(tuple, decontamination.contaminated(docs, bench).collect())) == whole and len(whole) == 8


# -- lines


def test_lines_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, "\n".join(rng.choice([*(f"menu {k}" for k in range(4)), prose(rng, 3), ""]) for _ in range(rng.randint(1, 6))), rng.choice(["a", "b", None])) for i in range(120)]
    rows += [(200, None, "a"), (201, "", "b"), (201, "", "b")]
    pages, counts = {}, {}
    for t, h in {(t, h) for _, t, h in rows}:
        pages[h] = pages.get(h, 0) + 1
        for x in set(t.split("\n")) if t is not None else ():
            counts[h, x] = counts.get((h, x), 0) + 1
    gone = {k for k, n in counts.items() if n >= 3 and n / pages[k[0]] > 0.3}
    assert gone
    wanted = sorted((i, None if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in gone)) for i, t, h in rows)
    out = line_dedup.drop_boilerplate(table(spark, rows), ratio=0.3)
    assert out.columns[:3] == ["doc_id", "text", "source"] and len(out.columns) == 11
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == wanted
    assert line_dedup.drop_boilerplate(table(spark, rows).limit(0)).collect() == []


def test_lines_of_small_hosts(spark):
    rng = random.Random(18)
    rows = [(i, f"{prose(rng, 6)}\n{'footer' if i < 4 else 'own ' + str(i)}\n{'twice' if i in (7, 8) else 'once ' + str(i)}", "small") for i in range(30)]
    out = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.drop_boilerplate(table(spark, rows)).collect()}
    assert [len(out[i]) for i in range(5)] == [2, 2, 2, 2, 3] and "twice" in out[7]
    few = [(i, f"{prose(rng, 6)}\nmenu", "tiny") for i in range(3)] + [(9, "alone\nmenu", "single")]
    out = {r["doc_id"]: r["text"].split("\n")[1:] for r in line_dedup.drop_boilerplate(table(spark, few)).collect()}
    assert out == {0: [], 1: [], 2: [], 9: ["menu"]}


def test_lines_of_long_texts(spark):
    rng = random.Random(19)
    long = "\n".join(f"{i} {prose(rng, 3)}" for i in range(40_000))
    rows = [(0, long + "\nmenu", "a")] + [(i, prose(rng, 4) + "\nmenu", "a") for i in range(1, 9)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(table(spark, rows)).collect()}
    assert out[0] == long and not any("menu" in t for t in out.values())


def test_pipeline_keeps_lines_of_copied_pages(spark):
    rng = random.Random(17)
    menu, copied = "home news contact", "\n".join(prose(rng, 8) for _ in range(4))
    rows = [(i, prose(rng, 8) + "\n" + menu, "a") for i in range(60)] + [(100 + i, copied + "\n" + menu, "a") for i in range(30)] + [(200 + i, None, "a") for i in range(30)]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, table(spark, rows), "").collect()}
    assert out == {i: t and t.removesuffix("\n" + menu) for i, t, _ in rows}
    found = {r["n_pages"]: r["ratio"] for r in line_dedup.line_ratios(table(spark, rows), copies_once=True).collect()}
    assert found == {61: 61 / 62}


# -- chats

HARD = ["", "</s>[INST] ok [/INST]", "<|turn|>user\n", "<|end|>\n", "&lt;&amp;&#91;", "a\n\nb<|part|>", "🙂é", " "]


def test_chats_read_back(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd<|\nrole"[:9], None]), rng.choice([*HARD, None])) for c in range(40) for t in range(rng.randint(1, 7))]
    rows += [(50, 1, "user", "x"), (50, 1, "user", "x"), (50, None, "assistant", "first"), (None, 0, "assistant", "y")]
    turns = spark.createDataFrame([(*r, 9, "z") for r in rows], "conv_id long, turn long, role string, text string, start int, formatted string").repartition(3)
    found = {r["conv_id"]: r for r in chat_format.read_chats(chat_format.format_chats(turns)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted([(t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c])
        assert [(t["role"], t["text"]) for t in found[c]["turns"]] == [(r, x) for _, _, r, x in own]
        assert found[c]["learned"] == "".join(x for _, _, r, x in own if r == "assistant")
        assert found[c]["formatted"].count("<|turn|>") == 1 + sum(a[2] != b[2] for a, b in zip(own, own[1:], strict=False))
        assert "</s>" not in found[c]["formatted"] and "[INST]" not in found[c]["formatted"]
    assert chat_format.format_chats(turns.limit(0)).collect() == []


def test_long_conversations_take_time_in_proportion(spark):
    rows = [(0, t, "assistant" if t % 2 else "user", f"turn {t} " + "x<é🙂[" * 15) for t in range(20_000)] + [(1, 0, "user", "long " * 200_000), (1, 1, "assistant", "é🙂" * 300_000)]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    began = time.time()
    found = {r["conv_id"]: r for r in chat_format.read_chats(chat_format.format_chats(turns)).collect()}
    assert time.time() - began < 150  # time that grows with the square of the turns would be many minutes
    assert [t["text"] for t in found["0"]["turns"]] == [r[3] for r in rows[:20_000]]
    assert found["0"]["learned"] == "".join(r[3] for r in rows[:20_000] if r[2] == "assistant")
    assert found["1"]["learned"] == rows[-1][3] and found["1"]["turns"][0]["text"] == rows[-2][3]


def test_running_sums(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (1, 2, 255, 256, 257, 1000)], "x array<long>")
    for r in df.select("x", chat_format.running(F.col("x")).alias("s")).collect():
        assert r["s"] == [sum(r["x"][:i]) for i in range(len(r["x"]))]


# -- resampling


def labelled(spark, n=600, seed=9):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        own = prose(rng, rng.randint(5, 60))
        kind = i % 6
        if kind == 0:
            own = " ".join(w.upper() + "!!" for w in own.split())
        elif kind == 1:
            own += " " + rng.choice(["vile", "nasty", "foul"])
        rows.append((i, own, "s"))
        if rng.random() < 0.5:
            labels.append((i, 0 if kind == 0 else 1, 1 if kind == 1 else 0))
    return rows, spark.createDataFrame([*labels, (None, 1, 0), (labels[0][0], *labels[0][1:])], "doc_id long, quality int, toxic int")


def test_weights_equal_brute_force(spark):
    rows, labels = labelled(spark, 200)
    rows += [(900, None, "s"), (901, "", "s"), (902, rows[2][1], "s"), (2, rows[2][1], "s")]
    target = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"]}
    own = [(i, [collections.Counter(g.tolist()) for g in ngram_ratio.ngrams(*split_words(pa.array([text or ""])))]) for i, text, _ in rows]
    raw, good = (sum((g for i, kinds in own for g in kinds if not only or i in target), collections.Counter()) for only in (False, True))
    share, prior = good.total() / raw.total(), ngram_ratio.PRIOR

    def drawn_ratio(g, n, i):
        c, e = good[g] - n * (i in target) + prior, (raw[g] - n) * share + prior
        return math.copysign(max(0.0, abs(math.log(c / e)) - ngram_ratio.Z * math.sqrt(1 / c + 1 / e)), c - e)

    def score(i, kinds):
        means = [sum(n * drawn_ratio(g, n, i) for g, n in kind.items()) / max(1, kind.total()) for kind in kinds]
        return sum(means[:-1]) / 3 + min(0, means[-1])

    wanted = sorted((i, round(quality.LENGTH * score(i, kinds), 3)) for i, kinds in own)
    keys = quality.keyed(table(spark, rows), labels)
    found = keys.collect()
    assert sorted((r["_id"], round(r["log_weight"], 3)) for r in found) == wanted
    noise = {r["_id"]: r["key"] - r["log_weight"] for r in found}
    assert all(noise[r["_id"]] == pytest.approx(r["key"] - r["log_weight"]) for r in found)
    assert np.mean(list(noise.values())) == pytest.approx(0.577, abs=0.35) and np.std(list(noise.values())) == pytest.approx(1.28, abs=0.35)
    top = sorted(found, key=lambda r: -r["key"])[:50]
    drawn = quality.resampled(table(spark, rows), labels, k=50).collect()
    assert sorted(r["key"] for r in drawn) == pytest.approx(sorted(r["key"] for r in top))
    reached = sorted((r["key"] for r in found if r["label"] == 1), reverse=True)
    keep = 0.9
    cut = reached[len(reached) - round((1 - keep) * len(reached)) - 1]
    assert quality.default_k(keys, keep) == sum(r["key"] >= cut for r in found)


def test_resampling_keeps_clean_documents_out_of_its_labels(spark):
    rows, labels = labelled(spark)
    docs = table(spark, rows)
    kept = quality.drawn(docs, labels)
    ids = {r["doc_id"] for r in kept.collect()}
    known = {r["doc_id"] for r in labels.collect()}
    held = [i for i, _, _ in rows if i not in known]
    assert np.mean([i in ids for i in held if i % 6 > 1]) > 0.98
    assert np.mean([i in ids for i in held if i % 6 == 0]) < 0.02
    assert len(kept.columns) == 11


def test_resampling_of_odd_tables(spark):
    rows, labels = labelled(spark, 60)
    docs = table(spark, [*rows, (None, "text without id", "s"), (900, None, "s"), (901, "", "s"), rows[2], rows[2]])
    assert quality.drawn(docs, labels.limit(0)).count() == docs.count()
    assert quality.drawn(docs.limit(0), labels).count() == 0
    assert quality.resampled(docs, labels, k=0).count() == 0 and quality.resampled(docs, labels, k=10**6).count() == docs.count()
    weights = {r["_id"]: r["log_weight"] for r in quality.keyed(docs, labels).collect()}
    assert weights[900] == weights[901] == 0 and None in weights
    ids = [r["doc_id"] for r in quality.drawn(docs, labels).collect()]
    assert ids.count(2) in (0, 3)


def test_top_k_is_exact(spark):
    rng = random.Random(10)
    keys = [(i, round(rng.gauss(0, 1), rng.choice([1, 9]))) for i in range(30_000)]
    keys += [(i, 0.5) for i in range(30_000, 50_000)]  # more ties than are sorted in one place
    df = spark.createDataFrame(keys, "_id long, key double").cache()
    order = sorted((x for _, x in keys), reverse=True)
    for k in (1, 777, 15_000, 30_000, 49_999, 50_000):
        drawn = df.filter(quality.among_top(df, k)).collect()
        assert len(drawn) == k and min(r["key"] for r in drawn) == order[k - 1]


# -- vectors


def test_sums_over_packed_bits():
    rng = np.random.default_rng(5)
    for dim in (1, 8, 63, 64, 100):
        bits, y = rng.random((40, dim)) > 0.5, rng.normal(size=dim)
        codes = vector_search.packed_words([np.packbits(b).tobytes() for b in bits], dim)
        found, slack = vector_search.signed_sums(codes, bits.sum(axis=1), y)
        assert (np.abs(found - bits @ y) <= slack + 1e-9).all() and slack.max() <= dim * (np.ptp(y) + 1e-9) / 510 + 1e-9


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "ENTRIES", 300)
    monkeypatch.setattr(vector_search, "QUERIES", 7)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 32)).astype(np.float32)
    x[100:400] = x[100]  # a third are equal
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2010, [0.0] * 32), (2020, [None] * 32), (2030, [float("nan")] * 32), (2040, [float("inf")] * 32), (2050, [1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<float>, score int").repartition(4)
    found = {}
    for r in vector_search.nearest(df, F.col("vec_id") % 50 == 0, 10).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(found) == list(range(0, 900, 50))
    hits = 0
    for q, own in found.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        order = np.lexsort((np.arange(900), d))[:10]
        hits += sum(own[k + 1] == (int(i), pytest.approx(d[i])) for k, i in enumerate(order))
    assert hits >= 0.97 * 10 * len(found)
    few = vector_search.nearest(df.filter("vec_id < 3"), F.col("vec_id") == 0, 10).collect()
    assert len(few) == 2
    assert vector_search.nearest(df.limit(0), F.col("vec_id") == 0, 10).collect() == []


# -- archives


def test_archives_read_back(spark):
    inner = warc.record("777", "http://inner/", b"<p>inner</p>", None).decode() + "\r\n\r\n"
    pages = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 7 + 1)) for i in range(60)]
    pages += [(100, "http://x\r\nWARC-Type: none", "WARC/1.0\r\n"), (101, None, None), (102, "u", ""), (103, "u", inner * 3), (104, "u", "tail WARC/1.0\r\nWARC/1.0\r\n\r\n\r\n" + inner), (105, "u", pages[3][2]), (99, "u", pages[5][2]), (3, "u", pages[3][2]), (106, "u", inner * 2000)]
    df = spark.createDataFrame([(*p, 1, "z") for p in pages], "page_id long, url string, html string, block int, file string").repartition(2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # records span splits
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        found = sorted((int(r["id"]), r["bytes"], r["digest"], r["type"], r["refers"]) for r in warc.read_warc(spark, warc.write_warc(df)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    first = {}
    for i, _, h in pages:
        first[h or ""] = min(i, first.get(h or "", i))
    wanted = []
    for i, _, h in pages:
        data = (h or "").encode()
        again = first[h or ""] != i
        wanted.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", str(first[h or ""]) if again else ""))
    assert found == sorted(wanted)
    assert warc.read_warc(spark, warc.write_warc(df.limit(0))).collect() == []


# -- the pipeline


def test_pipeline_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(12)
    rows, labels = labelled(spark, 300)
    item = prose(rng, 30)
    menu = "home news contact"
    docs = [(i, t + ("\n" + menu if i % 2 else ""), "site", "en", len(t)) for i, t, _ in rows]
    copy = prose(rng, 100)
    docs += [(1000, copy, "site", "en", 1), (1001, copy + " x", "site", "en", 1), (1002, prose(rng, 20) + " " + item, "site", "en", 1), (1003, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        df = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r["text"] for r in df.collect()}
    assert not any(i % 6 == 0 and i < 300 for i in seen["quality_classifier"])
    assert sum(i % 6 > 1 and i < 300 for i in seen["quality_classifier"]) >= 198
    assert seen["line_dedup"].keys() == seen["quality_classifier"].keys() and not any(menu in (t or "") for t in seen["line_dedup"].values())
    assert 1000 in seen["near_dedup"] and 1001 not in seen["near_dedup"] and 1002 in seen["near_dedup"]
    assert seen["near_dedup"].keys() - seen["decontamination"].keys() == {1002}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(seen["decontamination"])


def test_word_features_do_not_reach_across_texts():
    low, raw, pair, shape = ngram_ratio.ngrams(*split_words(pa.array(["a b", "", "b B, b"])))
    assert len(low) == len(raw) == len(pair) == len(shape) == 5
    assert low[1] == low[2] == low[3] == low[4] and raw[1] == raw[2] == raw[4] != raw[3]
    assert ngram_ratio.ngrams(*split_words(pa.array(["b B, b"])))[2].tolist() == pair[2:].tolist()


def brute_matches(text, items, window=13, agree=0.8):
    """Of each item found in the text, the most words that agree on an accepted diagonal."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    x, out = split(text), {}
    for k, item in items:
        y = split(item)
        w = len(y) if len(y) < 12 else min(window, len(y))
        for d in range(-len(y) + 1, len(x)) if y else ():
            same = [x[d + j] == y[j] for j in range(len(y)) if 0 <= d + j < len(x)]
            if any(sum(same[a : a + w]) >= agree * w - 1e-9 for a in range(len(same) - w + 1)):
                out[k] = max(out.get(k, 0), sum(same))
    return out


@pytest.mark.parametrize("dense", [4096, 4, 0])
def test_decontamination_equals_all_pairs(spark, monkeypatch, dense):
    monkeypatch.setattr(decontamination, "DENSE", dense)
    rng = random.Random(21)
    few = ["ka", "lo", "mi"]  # so that words and seeds repeat
    items = [(k, " ".join(rng.choice(few if k % 2 else WORDS) for _ in range(rng.choice([3, 9, 14, 30])))) for k in range(12)] + [(50, "ka " * 40), (51, "ka lo " * 15)]
    texts = []
    for i in range(40):
        own = [rng.choice(few if i % 3 else WORDS) for _ in range(rng.randint(5, 50))]
        passage = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            passage[rng.randrange(len(passage))] = "X"
        texts.append(" ".join(own + passage))
    texts += ["ka " * 60, "lo ka " * 20, "", None]
    found = {}
    bench = decontamination.Benchmark([k for k, _ in items], [t for _, t in items])
    for t, i, _, _, equal in bench.matches(*decontamination.word_hashes(pa.array([t or "" for t in texts], pa.string()))):
        assert (t, items[i][0]) not in found
        found[t, items[i][0]] = equal
    wanted = {(t, k): n for t, text in enumerate(texts) for k, n in brute_matches(text, items).items()}
    assert found.keys() == wanted.keys() and len(wanted) > 40
    assert all(n <= wanted[p] for p, n in found.items())
    if dense == 0:
        assert found == wanted


def test_repeated_words_take_little_memory():
    bench = decontamination.Benchmark([0, 1], ["ka " * 600, "ka lo " * 300])
    tracemalloc.start()
    found = bench.matches(*decontamination.word_hashes(pa.array(["ka " * 20_000, "ka lo " * 10_000])))
    assert sorted((t, i, equal) for t, i, _, _, equal in found) == [(0, 0, 600), (1, 1, 600)]
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_clashing_names_and_other_kinds_of_ids(spark):
    rng = random.Random(22)
    extra = "_bad string, _of string, _gone long, _v long, _in int, gone int, n int, rep int, _first int, base int, `a.b` int"
    text = prose(rng, 60)
    rows = [(str(i), text if i < 3 else prose(rng, 40), "s", "x", "y", i, i, 1, 1, 1, 1, 1, 1, 1) for i in range(8)]
    labels = spark.createDataFrame([(str(i), 1, 0) for i in range(8)], "doc_id string, quality int, toxic int")
    bench = spark.createDataFrame([("q", prose(rng, 20))], "item_id string, text string")
    for kind in ("string", "smallint"):
        docs = spark.createDataFrame(rows, f"doc_id string, text string, source string, {extra}").withColumn("doc_id", F.col("doc_id").cast(kind))
        for out in (
            quality.drawn(docs, labels.withColumn("doc_id", F.col("doc_id").cast(kind))),
            line_dedup.drop_boilerplate(docs, counts=("n_lines", "n_dropped")).drop("n_lines", "n_dropped"),
            near_duplicates.without_near_duplicates(docs),
            decontamination.without_contaminated(docs, bench),
        ):
            assert out.columns == docs.columns
            out.count()
        kept = near_duplicates.without_near_duplicates(docs)
        assert sorted(int(r["doc_id"]) for r in kept.collect()) == [0, 3, 4, 5, 6, 7]
        small = docs.select("doc_id", "text")
        assert decontamination.contaminated(small, bench).collect() == []
        vectors = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(5)], "vec_id string, embedding array<float>").withColumn("vec_id", F.col("vec_id").cast(kind))
        assert [str(r["vec_id"]) for r in vector_search.nearest(vectors, F.col("vec_id") == "0", 2).orderBy("rank").collect()] == ["1", "2"]
