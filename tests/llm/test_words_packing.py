import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from footfall.llm import packing, pieces, textops

ODD = ["", None, " ", "a", "one two", "\n\n x\t\ty \x0b z", "Ünï cödé ß wide  space", "it's   A  Test\r\nline", "x" * 3000, "a b " * 700, "<|endoftext|> 12,5 &&& ***"]


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def test_words_are_maximal_runs():
    w = textops.words(pa.array(ODD))
    got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [plain(t) for t in ODD]
    by_hash = {}
    for words, i in zip(got, range(len(ODD))):
        for word, h in zip(words, w.hash[w.first[i] : w.first[i + 1]]):
            assert by_hash.setdefault(word, h) == h
    assert len(set(by_hash.values())) == len(by_hash)


def test_shingles_match_tuples():
    texts = ODD + ["the same five words here", "the same five words here again", "the same", "the same"]
    w = textops.words(pa.array(texts))
    doc, key = textops.shingles(w, 5)
    want = []
    for t in texts:
        p = plain(t)
        want.append({tuple(p[i : i + 5]) for i in range(len(p) - 4)} if len(p) >= 5 else ({tuple(p)} if p else set()))
    assert [len(set(key[doc == i])) for i in range(len(texts))] == [len(s) for s in want]
    assert len(set(key)) == len(set().union(*want))


@pytest.fixture(scope="module")
def vocabulary():
    return packing.vocabulary()


def test_encoder_equals_whole_text_encoding(vocabulary):
    enc = packing.Encoder(vocabulary, kept=3)
    for _ in range(3):
        ids, at = enc.encode(pa.array(ODD))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == enc.plain([t or "" for t in ODD])


def test_best_fill_is_the_closest():
    rng = np.random.default_rng(3)
    for _ in range(60):
        cap = int(rng.integers(1, 60))
        supply = {int(k): int(rng.integers(0, 4)) for k in rng.integers(1, 40, 6)}
        got = packing.best_fill(cap, supply)
        assert all(0 < n <= supply[k] for k, n in got.items())
        sums = {0}
        for k, n in supply.items():
            sums = {s + k * j for s in sums for j in range(n + 1) if s + k * j <= cap}
        assert sum(k * n for k, n in got.items()) == max(sums)


def test_plan_uses_every_remainder_once():
    counts = {1000: 3, 700: 10, 300: 25, 24: 40, 1: 7, 1024: 2}
    patterns = packing.plan(counts, 1024)
    used = Counter()
    for p, times in patterns:
        assert sum(k * n for k, n in p.items()) <= 1024
        for k, n in p.items():
            used[k] += n * times
    assert dict(used) == counts


def test_pack_covers_every_id_once(spark, vocabulary):
    rows = [(i, t, "x") for i, t in enumerate(ODD * 4 + ["word " * 2500])] + [(None, "no id", "y"), (3, "a", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(5)
    out = packing.pack(docs, vocabulary, with_ids=True).collect()
    enc = packing.Encoder(vocabulary)
    want = Counter((r[0], tuple(enc.plain([r[1] or ""])[0] + [0])) for r in rows)
    whole = {}
    seqs = {}
    for r in out:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 1024
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole.setdefault((r.doc_id, r.start), []).append(tuple(r.ids))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(len(i) for (_, i), n in want.items() for _ in range(n)) == sum(r.length for r in out)
    for (doc, ids), n in want.items():
        if len(ids) <= 1024:
            assert whole[(doc, 0)].count(ids) == n
    assert packing.pack(docs.limit(0), vocabulary).count() == 0


def test_pieces_round_trip_and_best_score():
    model = pieces.Pieces(pieces.model_path())
    ids, at, score = model.encode(pa.array(ODD))
    data, off = model.decode(ids, at)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(off[:-1], off[1:])] == [t or "" for t in ODD]

    def brute(text):
        b = (" " + text).encode()
        best = [0.0] + [-1e18] * len(b)
        for i in range(1, len(b) + 1):
            best[i] = best[i - 1] + model.byte_score
            for k in range(1, min(i, model.longest) + 1):
                hit = model.known.get(b[i - k : i])
                if hit:
                    best[i] = max(best[i], best[i - k] + hit[1])
        return best[-1]

    for i, t in enumerate(ODD):
        assert (score[i] == 0 and not t) or score[i] == pytest.approx(brute(t), rel=1e-9)


def test_pieces_tables(spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(0, "twice", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    enc = pieces.encode(docs, pieces.model_path())
    back = Counter((r.doc_id, r.text) for r in pieces.decode(enc, pieces.model_path()).collect())
    assert back == Counter((i, t or "") for i, t, _ in rows)
    assert pieces.encode(docs.limit(0), pieces.model_path()).count() == 0
