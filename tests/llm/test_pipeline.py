import re

import pytest

from footfall.llm import toxicity

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decisions(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, seen[-1], DATA).cache()
        assert out.columns == docs.columns, name
        seen.append(out)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and len(ids[-1]) > 20
    assert ids[3] == ids[4]
    texts = {r.doc_id: r.text for r in seen[4].collect()}
    assert all(r.n_chars == len(r.text) for r in seen[4].collect())
    # nothing that long stands twice any more among what near-duplicate removal left
    whole = {r.doc_id: r.text for r in seen[3].collect()}
    assert all(len(texts[d]) <= len(whole[d]) for d in texts)
    net = toxicity.fit(seen[1], spark.read.parquet(f"{DATA}/labels.parquet"))
    assert ids[2] == {r.doc_id for r in toxicity.score(seen[1], net).filter(f"_score < {toxicity.CUT}").collect()}


def test_run_packs_what_is_left(spark):
    import corpus_pipeline as cp

    out = cp.run(spark, DATA)
    assert out.columns[0] == "doc_id" and out.count() > 20
    assert out.agg({"length": "max"}).first()[0] <= 1024
    assert re.match(r"\w+", cp.STAGES[0][0]) and len(cp.STAGES) == 5


def test_queries_have_the_contract_columns(spark):
    from footfall.llm import registry

    want = {
        "op2_": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op5_": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op6_": ["doc_id", "n_shingles", "component_id"],
        "op7_": ["page_id", "url", "text", "n_chars"],
        "op8_": ["doc_id", "held_out", "score", "predicted"],
        "op9_": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op10_": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    }
    names = [re.match(r"op(\d+)_", n)[1] for n in registry.QUERIES]
    assert sorted(map(int, names)) == list(range(1, 11))
    for name, run in registry.QUERIES.items():
        for start, columns in want.items():
            if name.startswith(start):
                assert run(spark, DATA).columns[: len(columns)] == columns


@pytest.mark.parametrize("name", ["op4_line_frequency"])
def test_sql_twin(spark, name):
    import duckdb

    from footfall.llm import registry

    got = sorted(map(str, (tuple(r) for r in registry.QUERIES[name](spark, DATA).collect())))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert got == sorted(map(str, c.execute(registry.ORACLES[name]).fetchall()))


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), k) for k, (d, t, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, _row long").repartition(3)


def test_near_duplicates_judge_rows_of_one_id_by_text(spark):
    import corpus_pipeline as cp

    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = prose(1).replace("w1x59", "other")
    rows = [(1, prose(1), "a"), (5, near, "a"), (1, prose(2), "a"), (9, prose(2), "a"), (7, prose(3), "b"), (7, prose(3), "b"), (None, prose(3), "b"), (None, prose(4), "b"), (None, prose(4), "b"), (3, None, None), (3, "", None), (4, None, None)]
    docs = _docs(spark, rows)
    out = cp.near_duplicates(spark, docs, DATA)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, prose(1)), (1, prose(2)), (7, prose(3)), (None, prose(4)), (3, None), (3, ""), (4, None)], key=str)
    assert cp.near_duplicates(spark, docs.limit(0), DATA).count() == 0


def test_stages_take_odd_rows(spark):
    import corpus_pipeline as cp

    passage = " ".join(f"shared{i}" for i in range(55))
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    rows = [(k, f"{prose(k)}\n{passage if k < 3 else ''}", "a") for k in range(12)] + [(None, prose(90), None), (0, prose(91), "a"), (0, prose(91), "a"), (20, None, "a"), (21, "", "a"), (22, "word " * 200_000, "a")]
    docs = _docs(spark, rows)
    for name, stage in cp.STAGES:
        for part in (docs, docs.limit(0)):
            out = stage(spark, part, DATA)
            assert name == "packing" or out.columns == docs.columns, name
            rows_out = out.collect()
            assert bool(rows_out) == (part is docs) or name == "packing", name
        if name == "repeat_removal":
            texts = {(r.doc_id, r._row): r.text for r in rows_out} or {(r.doc_id, r._row): r.text for r in stage(spark, docs, DATA).collect()}
            assert all("shared5 " not in (t or "") for t in texts.values()) and texts[20, 15] in (None, "") and len(texts) == len(rows)
