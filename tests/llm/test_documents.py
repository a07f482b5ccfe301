import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from footfall.llm import html, jaccard, lm, quality, repeats, sharding, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def rng_text(seed, n, vocabulary=400):
    r = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in r.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def corpus():
    """Prose, exact and near copies, shared passages, hot lines, odd rows."""
    r = np.random.default_rng(5)
    passage = rng_text(900, 90)
    rows = []
    for i in range(120):
        text = rng_text(i, int(r.integers(30, 260)))
        if i % 6 == 0:
            text = text[: len(text) // 2] + "\n" + passage + "\n" + text[len(text) // 2 :]
        if i % 4 == 0:
            text = "Subscribe to our newsletter now\n" + text
        rows.append((i, text, f"host{i % 3}"))
    base = rng_text(500, 200).split()
    for k in range(60):  # near copies, some of them far from each other
        words = list(base)
        for p in np.random.default_rng(k).integers(0, 200, 1 + k % 9):
            words[p] = f"edit{k}x{p}"
        rows.append((1000 + k, " ".join(words), "host0"))
    rows += [(2000 + k, rng_text(3, 150), "host1") for k in range(25)]
    rows += [(3000, None, None), (3001, "", "host2"), (3002, " \n\t ", "host2"), (3003, "a b", None), (3004, "a b", "host1"), (3005, "z" * 1500, "host1"), (3006, "Straße ä" * 90, "host2"), (3007, "ab " * 400, None)]
    rows += [rows[0], rows[-1]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, 1, "c") for d, t, s in rows], "doc_id long, text string, source string, n int, kept string").repartition(7)


@pytest.mark.parametrize(("local", "hot"), [(jaccard.LOCAL_LINKS, jaccard.HOT_CLASSES), (0, 2), (jaccard.LOCAL_LINKS, 10_000)])
def test_jaccard_groups_match_brute_force(spark, corpus, local, hot):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, corpus), local=local, hot=hot).collect())
    sets = []
    for _, t, _ in corpus:
        w = WORDS.findall(lower(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(corpus)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(corpus)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(corpus):
        least[find(i)] = min(least.get(find(i), d), d)
    assert got == Counter((d, len(sets[i]), least[find(i)]) for i, (d, _, _) in enumerate(corpus))


def test_jaccard_without_links(spark, corpus):
    rows = [(i, rng_text(70 + i, 40 + i, 10_000), "h") for i in range(6)] + [(9, None, "h")]
    # a passage in all of them, too short to link any
    rows += [(20 + i, rng_text(3, 8) + " " + rng_text(90 + i, 60, 10_000), "h") for i in range(6)]
    got = jaccard.join(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(d, d) for d, _, _ in rows]
    assert jaccard.join(frame(spark, corpus).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [repeats.HOT_BYTES, 1500])
def test_repeats_match_brute_force(spark, corpus, hot):
    least = 120
    seen = Counter(t.encode()[i : i + least] for _, t, _ in corpus if t for i in range(len(t.encode()) - least + 1))
    want = Counter()
    for d, t, _ in corpus:
        raw = (t or "").encode()
        keep = bytearray(b"\1" * len(raw))
        for i in range(len(raw) - least + 1):
            if seen[raw[i : i + least]] > 1:
                keep[i : i + least] = bytes(least)
        spans = len(re.findall(rb"\0+", bytes(keep)))
        want[(d, len(raw), spans, hashlib.sha256(bytes(b for b, k in zip(raw, keep) if k)).hexdigest())] += 1
    out = repeats.dedup(frame(spark, corpus), least=least, carry=["n", "kept"], hot_bytes=hot)
    got = Counter((r._id, r._bytes, len(r._begins), hashlib.sha256(bytes(r._rest)).hexdigest()) for r in out.collect())
    assert got == want
    assert repeats.dedup(frame(spark, corpus).limit(0)).count() == 0


def test_merge_equals_one_sorted_transform():
    rng = np.random.default_rng(2)
    strings = [np.append(rng.integers(0, 3, rng.integers(0, 30)), 10 + i) for i in range(40)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    symbols = np.concatenate(strings)
    cuts = [0, 7, 20, 40]
    orders, transforms = [], []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        order, t = repeats.transform(symbols[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        orders.append(order + at[lo])
        transforms.append(t)
    for depth in (1, 2, 5, 8):
        follows, interval = repeats.merge(transforms, depth)
        places = np.concatenate(orders)[follows]
        end = np.searchsorted(at, places, side="right")
        prefix = [tuple(symbols[p : min(p + depth, at[e])]) for p, e in zip(places, end)]
        assert prefix == sorted(prefix)
        same = [i for i in range(1, len(prefix)) if prefix[i] == prefix[i - 1]]
        assert same == [i for i in range(1, len(interval)) if interval[i] == interval[i - 1]]


def test_line_frequency(spark, corpus):
    rows = [(5000 + i, f"{rng_text(i, 60)}\nShared  FOOTER line of the host\n{rng_text(700 + i, 60)}", "hostx") for i in range(40)]
    rows += [(6000 + i, "\n".join(["shared footer line of the host"] * 12 + [f"own words number {i} here"]), "hostx") for i in range(3)]
    rows += [(7000 + i, rng_text(42, 90), "hostx") for i in range(50)]  # copies do not make each other boilerplate
    got = {r.doc_id: r for r in quality.measure(frame(spark, corpus + rows)).collect()}
    for d, t, _ in corpus + rows:
        w = WORDS.findall(t or "")
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert all(got[5000 + i].removed_words == 6 and got[5000 + i].kept for i in range(40))
    assert all(not got[6000 + i].kept for i in range(3))
    assert all(got[7000 + i].kept for i in range(50))
    kept = quality.clean(frame(spark, corpus + rows)).collect()
    assert all("FOOTER" not in r.text for r in kept if r.doc_id >= 5000) and kept[0].__fields__ == ["doc_id", "text", "source", "n", "kept"]
    assert quality.measure(frame(spark, corpus).limit(0)).count() == 0


def test_shared_lines_count_by_document_whatever_else_they_hold(spark):
    rows = []
    for h in range(20):
        shared = [f"shared line {h} {k} of every page" for k in range(40)]
        rows += [(h * 1000 + i, "\n".join([*shared, f"own words {h} {i} and a few more"]), f"h{h}") for i in range(300)]
        rows += [(h * 1000 + 300 + i, shared[i], f"h{h}") for i in range(5)]
    got = quality.measure(frame(spark, rows)).collect()
    assert all(len(r.removed_lines) == (40 if r.doc_id % 1000 < 300 else 1) and not r.kept for r in got) and len(got) == len(rows)


def test_clean_judges_texts_where_they_lie(spark, monkeypatch):
    rows = [(i, f"{rng_text(i, 70)}\nthe host footer\n{'the other footer' if i % 2 else ''}", "ab"[i % 3 > 0]) for i in range(60)]
    rows += [(100, None, None), (101, "short", "a"), (102, "the host footer\n" * 20, "a"), (103, rng_text(103, 70), None)]
    docs = frame(spark, rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = quality.clean(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan
    want = Counter((i, "\n".join(x for x in t.split("\n") if "footer" not in x), s) for i, t, s in rows if s and i < 100) + Counter([rows[-1]])
    assert Counter((r.doc_id, r.text, r.source) for r in out.collect()) == want
    monkeypatch.setattr(quality, "BROADCAST_LINES", -1)
    assert Counter((r.doc_id, r.text, r.source) for r in quality.clean(docs).collect()) == want


def test_line_frequency_rows_of_one_id_are_judged_each(spark):
    prose = [(50 + i, f"{rng_text(i, 70)}\nthe host footer", "a") for i in range(30)]
    odd = [(1, prose[0][1], "a"), (1, prose[0][1], "b"), (1, prose[0][1], "a"), (1, rng_text(8, 60), "a"), (None, prose[1][1], "a"), (None, None, None), (2, "x " * (1 << 20), None)]
    docs = spark.createDataFrame([(d, t, s, 1, 2, "n", "w") for d, t, s in prose + odd], "doc_id long, text string, source string, row int, c int, host string, whole string")
    got = Counter((r.doc_id, r.host, r.n_words, r.removed_words) for r in quality.measure(docs).collect() if r.doc_id is None or r.doc_id < 50)
    assert got == {(1, "a", 73, 3): 2, (1, "b", 73, 0): 1, (1, "a", 60, 0): 1, (None, "a", 73, 3): 1, (None, None, 0, 0): 1, (2, None, 1 << 20, 0): 1}
    kept = quality.clean(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is None or r.doc_id < 50) == {1: 4, None: 1}


def test_shards_are_even_and_gapless(spark, corpus):
    rows = corpus + [(9000 + i, "copy of one text " * 20, "h") for i in range(150)]
    out = sharding.assign(frame(spark, rows), 4).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _, _ in rows)
    size = Counter()
    slots = {}
    for r in out:
        size[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 4
    biggest = max(len((t or "").encode()) + 1 for _, t, _ in rows)
    assert max(size.values()) - min(size.values()) <= 2 * biggest + sum(size.values()) / 100
    assert sharding.assign(frame(spark, corpus).limit(0)).count() == 0


def test_equal_texts_share_a_shard_where_they_fit(spark):
    r = np.random.default_rng(3)
    rows = [(i, rng_text(i, int(r.integers(5, 90))), "h") for i in range(1500)]
    rows += [(5000 + i, f"group {i % 40} " * (1 + i % 7), "h") for i in range(2000)] + [(9000 + i, "hot text " * 6, "h") for i in range(6000)]
    rows += [(None, None, None), (1, "same row", "h"), (1, "same row", "h"), (2, "", None)]
    out = sharding.assign(frame(spark, rows), 8).collect()
    size, shards, slots = Counter(), {}, {}
    for x in out:
        size[x.shard] += x["size"]
        shards.setdefault(x.key[:16], set()).add(x.shard)
        slots.setdefault(x.shard, []).append(x.slot)
    share = sum(size.values()) / 8
    group = Counter()
    for x in out:
        group[x.key[:16]] += x["size"]
    assert all(len(shards[k]) == 1 for k in group if group[k] <= share) and len(shards[max(group, key=group.get)]) > 1
    assert max(size.values()) - min(size.values()) < 0.02 * share and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(x.doc_id for x in out) == Counter(d for d, _, _ in rows)


def test_an_overfull_range_is_parted_in_every_round():
    row = lambda lo, hi: {"lo": lo, "hi": hi}
    a, b = "a" * 16, "b" * 16
    assert sharding._parted([], [], [row(a + "0" * 16, b + "0" * 16)]) == [b]
    assert sharding._parted([a], [], [row(a + "0" * 16, a + "f" * 16)]) == [a, a + "f" * 16]
    assert sharding._parted([a], [a + "5" * 16], [row(a + "0" * 16, b + "f" * 16)]) == [a, a + "~"]


def test_language_model(spark, corpus):
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*WORDS.findall(lower(t or "")), None]
    c = Counter(w for d, t, _ in corpus if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    rows = lm.score(frame(spark, corpus)).collect()
    texts = {d: t for d, t, _ in corpus}
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _, _ in corpus)
    for r in rows:
        w = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    assert sum(r.score for r in rows if r.doc_id < 1000) > sum(r.base_score for r in rows if r.doc_id < 1000)
    assert lm.score(frame(spark, corpus).limit(0)).count() == 0


@pytest.mark.parametrize("common", [0, 60, 1000])
def test_every_ngram_counts(spark, corpus, monkeypatch, common):
    monkeypatch.setattr(lm, "WORDS", common)
    corpus = [*corpus[:150], (3000, "", "s"), (3001, None, "s"), (3002, "alone", "s"), (3003, "Alone never met", "s"), *[(3010 + k, "w1 w2 never met", "s") for k in range(20)]]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*WORDS.findall(lower(t or "")), None]
    count, after = Counter(), {}
    for d, t, _ in corpus:
        w = tokens(t)
        for k in range(0 if held(d) else len(w)):
            for n in (0, 1, 2):
                if k >= n:
                    count[tuple(w[k - n : k + 1])] += 1
                    after.setdefault(tuple(w[k - n : k]), set()).add(w[k])
    total = sum(c for g, c in count.items() if len(g) == 1)
    distinct = len(after[()])

    def p(state, w):
        if not state:
            return (count[w,] + 1) / (total + distinct + 1)
        if state not in after:
            return p(state[1:], w)
        if w in after[state]:
            return (count[*state, w] - lm.DISCOUNT) / count[state]
        return lm.DISCOUNT * len(after[state]) / count[state] / (1 - sum(p(state[1:], x) for x in after[state])) * p(state[1:], w)

    rows = lm.score(frame(spark, corpus).repartition(3)).collect()
    texts = {d: t for d, t, _ in corpus}
    assert len(rows) == len(corpus) and any(r.held_out and r.n_known < r.n_tokens for r in rows)
    for r in rows:
        w = tokens(texts[r.doc_id])
        assert r.n_known == sum(count[x,] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(math.log10(p((), x)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(tuple(w[max(k - 2, 0) : k]), x)) for k, x in enumerate(w)))


def test_blocks_hold_many_ngrams_and_chunks_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    common = lm.Common(np.arange(1, 31, dtype=np.uint64) << np.uint64(50), np.arange(100, 70, -1))
    hashes = rng.integers(1, 60, 20000).astype(np.uint64) << np.uint64(50)
    w = common.names(hashes)
    before = [np.concatenate([np.full(k, lm.NONE), w])[: len(w)] for k in (2, 1)]
    rare = np.unique(w[w >= lm.TOP])
    place, part = (np.arange(len(w)) // 40 * 2 + rng.integers(0, 2, len(w))).astype(np.uint32), np.zeros(len(w), np.uint32)
    halves = [slice(1, 9000), slice(9000, None)]
    rows = [b for h in halves for b in lm._blocks(np.zeros(len(w[h]), np.uint64), 1, [x[h] for x in (*before, w)], place[h], part[h], rare, np.arange(len(rare)) + 1)]
    assert len(rows) == 2  # a row for each block, however many n-grams it has
    t = pa.table({c: pa.array(x) for c, x in zip(("n", "listed", "data"), list(zip(*rows))[1:])})
    back = [np.concatenate(x) for x in zip(*(b[:5] for b in lm._opened(t)))]
    key = lambda x: sorted(zip(*(y.tolist() for y in x)))
    assert key(back) == key([y[1:] for y in (*before, w, place, part)])
    sums = lambda: [np.frombuffer(x, np.float64) for *_, x in lm._weights(t, common, 3000)]
    (whole,) = sums()
    monkeypatch.setattr(lm, "CHUNK", 3000)
    assert len(sums()) == 7 and sum(x.sum() for x in sums()) == pytest.approx(whole.sum())


def test_automaton_weights_are_probabilities():
    rng = np.random.default_rng(1)
    n = 12
    words = np.sort(rng.integers(1, 1 << 62, n).astype(np.uint64))
    ids = rng.integers(0, n, 4000) * (rng.random(4000) < 0.7)
    counts = np.bincount(ids, minlength=n)
    pairs = Counter(zip(ids[:-1].tolist(), ids[1:].tolist()))
    triples = Counter(zip(ids[:-2].tolist(), ids[1:-1].tolist(), ids[2:].tolist()))
    keep2 = sorted((a * n + b, c) for (a, b), c in pairs.items() if c > 8)
    keep3 = sorted(((a * n + b) * n + d, c) for (a, b, d), c in triples.items() if c > 20)
    arrays = lambda x: (np.array([k for k, _ in x], np.uint64), np.array([c for _, c in x]))
    auto = lm.Automaton(words, counts, arrays(keep2), arrays(keep3), int(counts.sum()), n)
    for state in range(len(auto.back)):
        _, weight = auto.step(np.full(n, state), np.arange(n))
        rare = 1 - (10.0 ** auto.root[:n]).sum()  # what the root leaves to words never seen
        left = rare
        deep = state
        while deep:
            left *= 10.0 ** auto.back[deep]
            deep = auto.fail[deep]
        assert (10.0**weight).sum() + left == pytest.approx(1, abs=0.02)
    # lanes do not change what a single walk gives
    whole = auto.traverse(ids, np.array([0, 3000, 3000, 4000]))
    state, single = np.zeros(1, np.int64), []
    for k, i in enumerate(ids):
        if k == 3000:
            state = np.zeros(1, np.int64)
        state, w = auto.step(state, np.array([i]))
        single.append(w[0])
    assert np.allclose(whole, single)


def test_toxicity_leaves_little_on_disk(spark, monkeypatch):
    net, other = toxicity.Net(1), toxicity.Net(2)
    words = np.array([[3, 5], [9, toxicity.BUCKETS]])
    sent = [toxicity._sent(net, words, 10), toxicity._sent(other, words[:1], 30)]
    everything = toxicity._sent(net, np.arange(toxicity.BUCKETS), 10)
    assert everything.nbytes < 4.5 * toxicity.BUCKETS * toxicity.SIZE  # a float a number
    per = [toxicity._total(pa.concat_tables(t.slice(k, 1) for t in sent)) for k in (0, toxicity.SLICES)]
    met, value = (np.frombuffer(per[0].column(c)[0].as_py(), np.float64) for c in ("met", "value"))
    assert met.sum() == 90 and met[[3, 5, 9]].tolist() == [40, 40, 10]
    assert np.array_equal(value.reshape(-1, toxicity.SIZE)[3], net.embed[3].astype(float) * 10 + other.embed[3].astype(float) * 30)
    assert np.frombuffer(per[1].column("value")[0].as_py(), np.float64)[-1] == -2.0 * 40
    kept = []
    monkeypatch.setattr(toxicity, "stored", lambda df, own=toxicity.stored: kept.append(own(df)) or kept[-1])
    rows = [(i, f"plain {i} " + "the same words again " * 500 + "vexed" * (i % 2), "s") for i in range(60)]
    toxicity.fit(frame(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    (table,) = kept
    size = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent()
    size = size.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(size).getLength()
    assert table.count() > 30 and size < 0.2 * sum(len(r.s_text) for r in table.collect())


def test_toxicity_learns_and_carries_columns(spark):
    rng = np.random.default_rng(0)
    bad = ["grumble", "vexed", "schnarch"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        words = rng_text(i, 60, 300).split()
        if toxic:
            for p in rng.integers(0, 60, 2):
                words[p] = bad[i % 3] + "abcdefg"[i % 7]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    labels += [(901, 1, None), (None, 1, 1)]
    docs = frame(spark, rows + [(901, None, "s"), (902, "", None), (0, rows[0][1], "s")])
    net = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), positive=150, negative=300)
    out = toxicity.score(docs, net, keep=docs.columns).collect()
    assert len(out) == 903 and all(0 <= r._score <= 1 for r in out)
    heldout = [r for r in out if r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = sum((r._score >= toxicity.CUT) == (r.doc_id % 4 == 0) for r in heldout)
    assert right >= 0.97 * len(heldout)
    assert toxicity.score(docs.limit(0), net).count() == 0
    empty = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(docs, empty).count() == 903


def test_toxicity_learns_from_every_labelled_row_and_word(spark, monkeypatch):
    """Words that few rows have count however many others there are, groups average, and a long text trains as a whole."""
    monkeypatch.setattr(toxicity, "ROWS", 1500)
    rows = [(i, rng_text(i, 20, 300) + (f" rare{'abcdefghij'[i // 6 % 10] * 4}" if i % 6 == 0 else ""), "s") for i in range(6000)]
    rows += [(7001, " ".join(["filler"] * 3000 + ["hidden"] + ["filler"] * 3000), "s")]
    docs, labels = frame(spark, rows), spark.createDataFrame([(r[0], 1, int(r[0] % 6 == 0)) for r in rows], "doc_id long, quality int, toxic int")
    assert zlib.crc32(b"7001") % 3 != 1
    net = toxicity.fit(docs, labels)
    met = lambda w: net.embed[toxicity.features(pa.array([w]))[0][0, 0]].any()
    used = {w for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1 for w in r[1].split()}
    assert all(map(met, used)) and "hidden" in used
    held = [r for r in toxicity.score(docs, net, keep=docs.columns).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r._score >= toxicity.CUT) == (r.doc_id % 6 == 0) for r in held) >= 0.99 * len(held)


def test_toxicity_batches_do_not_change_scores():
    net = toxicity.Net()
    net.embed = np.random.default_rng(4).normal(0, 1, net.embed.shape).astype(np.float32)
    net.embed[toxicity.BUCKETS] = 0
    texts = ["a b c", "", "lone", None, "x y z w v u t", "a b c"]
    together = net.scores(*toxicity.features(pa.array(texts)))
    alone = [net.scores(*toxicity.features(pa.array([t], pa.string())))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav class=menu><ul><li><a href="/">Home</a></li></ul></nav><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>
{open}<h1>Title &amp; more</h1><p>First <b>bo</b>ld para&shy;graph {n}.<p>Second&nbsp;line<br>after   break {n}<div class="ad">Buy!</div>
<form><input value=x>Send</form><blockquote>quoted 1 &lt; 2 {n}</blockquote><!-- <p>hidden</p> -->{close}
<section id="comments"><article><p>I disagree {n}</p></article></section><aside>Related</aside><footer>&copy; site</footer></body></html>"""
TEXT = "Title & more First bold para­graph {n}. Second line after break {n} quoted 1 < 2 {n}"


def test_pages(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.format(open="<article class='post'>", close="</article>", n=i)) for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", PAGE.format(open="<div id=story>", close="</div>", n=i)) for i in range(12)]
    rows += [(200, None, PAGE.format(open="<main>", close="</main>", n=7)), (201, "x", None), (202, "http://c.example/", ""), (203, "http://c.example/2", "plain <b>te</b>xt"), (0, "https://a.example/0", rows[0][2])]
    pages = spark.createDataFrame([(p, u, h, "t") for p, u, h in rows], "page_id long, url string, html string, text string").repartition(3)
    got = sorted(((r.page_id, r.text) for r in html.extract(pages).collect()), key=str)
    want = [(i, TEXT.format(n=i)) for i in range(12)] + [(100 + i, TEXT.format(n=i).removeprefix("Title & more ").replace("Second line ", "")) for i in range(12)] + [(200, TEXT.format(n=7)), (201, ""), (202, ""), (203, "plain text"), (0, TEXT.format(n=0))]
    assert got == sorted(want, key=str)
    assert html.extract(pages.limit(0)).count() == 0


def counted(rows):
    """Tokens as counted: (token, parent, kind, pages, ones, chars)."""
    return [{"token": t, "parent": p, "kind": k, "pages": n, "ones": o, "chars": c, "depth": t, "main": False, "barred": False, "sig": 1} for t, p, k, n, o, c in rows]


def test_template_blocks_are_left_out():
    assert html.deduce(counted([(1, 0, 0, 9, 9, 90), (2, 1, 0, 9, 9, 90), (3, 2, 0, 9, 9, 85), (4, 2, 0, 9, 9, 5), (77, 0, 1, 9, 9, 0)]), 9) == (3, 3, [77])


def test_the_slot_needs_no_names(spark):
    page = "<html><body class='site'><nav class=menu><ul><li>Home {n}</li><li>News {n}</li></ul></nav><div class=ad>Buy {n}</div><article class='post x'><h2>Head {n}</h2><p>%s {n}</p></article><aside>Also {n}</aside><footer>&copy; us</footer></body></html>" % ("long text " * 30).strip()
    other = page
    for k, name in enumerate(["nav", "ul", "li", "div", "article", "h2", "aside", "footer", "site", "menu", "ad", "post"]):
        other = re.sub(rf"(</?|class='?){name}\b", rf"\1zz{k}", other)
    assert not re.search("article|nav|ad>|menu", other)
    rows = [(i, f"http://n.example/{i}", page.format(n=i)) for i in range(9)] + [(100 + i, f"http://r.example/{i}", other.format(n=i)) for i in range(9)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {b + i: f"Head {i} {('long text ' * 30).strip()} {i}" for b in (0, 100) for i in range(9)}


@pytest.mark.parametrize("part", ["<a b ", "<div>", "<a '\"", "<!x ", "<div></p>", "</div>", "<p \"", "<b class=ad>", "<script ", "&", "<"])
def test_broken_pages_take_linear_time(part):
    import time

    page = part * ((1 << 20) // len(part))
    began = time.process_time()
    html.parse(page)
    assert time.process_time() - began < 20


def test_tags_end_where_a_search_finds_the_end():
    r = np.random.default_rng(4)
    for k in range(300):
        page = "".join(r.choice(list("<>\"'a /"), 40))
        ends = html._ends(page)
        for at in range(len(page)):
            m = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^'\"<>]|\"[^\"]*\"|'[^']*')*)>").match(page, at)
            tag = html._TAG.match(page, at)
            if tag:
                mark = html._MARK.search(page, tag.end())
                assert (m is not None) == (mark is not None and ends[mark.start()] >= 0), page
                assert not m or m.end() - 1 == ends[mark.start()]


def test_classes_decide_the_slot_on_hosts_with_articles(spark):
    # a teaser in an article beside the text, and a layout class around the article that holds a listed word
    teaser = "<html><body><article><p>Teaser {n}</p></article><div class='story'><p>%s {n}</p></div></body></html>" % ("long text " * 20).strip()
    layout = "<html><body><div class='no-sidebar'><article><p>Whole text {n}</p><div class='ad'>Buy!</div></article></div><section id='comments'><p>no {n}</p></section></body></html>"
    rows = [(i, f"http://t.example/{i}", teaser.format(n=i)) for i in range(9)] + [(100 + i, f"http://l.example/{i}", layout.format(n=i)) for i in range(9)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("long text " * 20).strip() + f" {i}" for i in range(9)} | {100 + i: f"Whole text {i}" for i in range(9)}


def test_odd_pages_do_not_void_a_host_template(spark):
    whole = "<html><body><div class='top'>Site</div>{side}<div class='story'><p>Own text number {n} of this page</p></div></body></html>"
    side = "<div class='extra'>Read our other pages</div>"
    # one broken page, a sidebar on 18 of 20, pages without tokens; a host of two pages
    rows = [(i, f"http://o.example/{i}", whole.format(n=i, side=side if i > 1 else "")) for i in range(20)]
    rows += [(50, "http://o.example/x", "<p>error"), *[(60 + i, f"http://o.example/y{i}", h) for i, h in enumerate([None, "", " ", "<!-- -->"] * 10)]]
    rows += [(200 + i, f"http://two.example/{i}", "<html><body><p>Welcome to us</p><p>Page %d</p></body></html>" % i) for i in range(2)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i] == f"Own text number {i} of this page" for i in range(20)) and got[50] == "error"
    assert not any(got[60 + i] for i in range(40)) and [got[200], got[201]] == ["Page 0", "Page 1"]
    # a sidebar within the slot, on most pages
    tokens = counted([(1, 0, 0, 20, 20, 90), (2, 1, 0, 19, 19, 85), (8, 0, 1, 19, 19, 0), (9, 0, 1, 9, 9, 0)])
    assert html.deduce([t | {"sig": t["token"]} for t in tokens], 20) == (2, 2, [8])


def test_chroma_alignment(spark):
    from footfall.llm import chroma

    rng = np.random.default_rng(8)
    v = rng.uniform(-1, 1, 64).tolist()
    audio = chroma.samples_of(chroma.render(v))
    prints = chroma.fingerprint(chroma.wav(audio))
    late = chroma.fingerprint(chroma.wav(np.concatenate([np.zeros(8 * chroma.HOP), audio + rng.normal(0, 60, len(audio))])))
    assert chroma.bit_error(prints, late, 8) < 0.1 < chroma.bit_error(prints, late, 0)
    assert chroma.Block([1], [prints.astype("<u4").tobytes()]).best(2, late)[:2] == (1, -8)
    rows = [(i, rng.uniform(-1, 1, 64).tolist()) for i in range(30)] + [(100, v), (101, v), (102, None), (103, []), (104, [None, float("nan")])]
    vec = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {r.key: r for r in chroma.search(chroma.fingerprints(chroma.with_audio(vec)), F.col("key") % 100 == 0).collect()}
    assert out[101].class_id == 100 and len(out) == len(rows) and out[102].match_id is None
    broken = spark.createDataFrame([(1, b"RIFF"), (2, None), (3, b"x" * 50)], "key long, audio binary")
    assert [len(r.ints) for r in chroma.fingerprints(broken).collect()] == [0, 0, 0]


def test_chroma_recall_against_brute_force():
    from footfall.llm import chroma

    rng = np.random.default_rng(11)
    found, there, wrong = 0, 0, 0
    tracks = [chroma.samples_of(chroma.render(rng.uniform(-1, 1, 64).tolist())) for _ in range(25)]
    prints = [chroma.fingerprint(chroma.wav(x)) for x in tracks]
    queries = chroma.Block(list(range(25)), [p.astype("<u4").tobytes() for p in prints])
    for k, x in enumerate(tracks):
        for noise in (500, 2500, 4000, 6000):
            for late in (0, 700):
                y = chroma.fingerprint(chroma.wav(np.clip(np.concatenate([np.zeros(late), x]) + rng.normal(0, noise, len(x) + late), -32000, 32000)))
                got = {m[0] for m in queries.matches(-1, y)}
                for q in (k, (k + 7) % 25):
                    least = min(chroma.bit_error(y, prints[q], o) for o in range(-len(y) // 2, len(y) // 2))
                    there += least <= chroma.MOST_ERROR
                    found += least <= chroma.MOST_ERROR and q in got
                    wrong += least > chroma.MOST_ERROR and q in got
    assert there > 80 and found >= 0.9 * there and wrong == 0


@pytest.mark.parametrize("block", [4096, 2])
def test_chroma_reports_every_pair(spark, block):
    from footfall.llm import chroma

    rng = np.random.default_rng(3)
    v = rng.uniform(-1, 1, 64)
    rows = []
    for k in range(1, 6):  # five queries, each with a recording beside it: near copies of one vector
        for key in (100 * k, 100 * k + 1):
            near = v.copy()
            near[rng.integers(0, 64, 3)] = rng.uniform(-1, 1, 3)
            rows.append((key, near.tolist()))
    rows += [(602, rows[0][1]), (603, rng.uniform(-1, 1, 64).tolist())]
    vec = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = chroma.search(chroma.fingerprints(chroma.with_audio(vec)), F.col("key") % 100 == 0, block).collect()
    assert sorted(r.key for r in out if r.best) == sorted(k for k, _ in rows)
    prints = {k: chroma.fingerprint(chroma.render(x)) for k, x in rows if k != 602}
    want = {(k, q) for k in prints for q in range(100, 600, 100) if k != q and chroma.Block([q], [prints[q].astype("<u4").tobytes()]).best(k, prints[k])}
    got = [(r.class_id, r.match_id) for r in out if r.match_id is not None and r.key != 602]
    assert len(want) > 30 and set(got) == want and len(got) == len(want)
    best = {r.key: r.bit_error for r in out if r.best}
    assert all(r.bit_error >= best[r.key] for r in out if r.match_id is not None)
