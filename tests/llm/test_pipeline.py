"""The pipeline's stages on one corpus whose outcome is known, and its queries' registration."""

import random

import pytest

from .conftest import prose

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def corpus(spark, docs, labels, tmp_path_factory):
    r = random.Random(6)
    base = [prose(150, i, 10**5) for i in range(40)]
    bad = []
    for i in range(40):
        w = prose(60, 700 + i, 10**5).split()
        w.insert(r.randrange(60), "idiot")
        bad.append(" ".join(w))
    item, passage = prose(30, 5000), prose(70, 5001)
    special = [base[3], base[4] + " extra", base[5][:400] + " " + item, prose(50, 6001, 10**5) + " " + passage, prose(55, 6002, 10**5) + " " + passage]
    root = tmp_path_factory.mktemp("tables")
    docs(base + bad + special).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{root}/documents.parquet")
    labels([(i, 1, int(i >= 40)) for i in range(80)]).write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), base, passage


def test_stages(spark, corpus, tmp_path):
    root, base, passage = corpus
    docs, after = spark.read.parquet(f"{root}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        stage(spark, docs, root).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = {n: {r.doc_id for r in rows} for n, rows in after.items()}
    assert ids["toxicity"] == {*range(40), *range(80, 85)}
    assert ids["near_duplicates"] == {*range(40), 82, 83, 84}
    text = {r.doc_id: r.text for r in after["suffix_dedup"]}
    assert set(text) == ids["near_duplicates"] and passage in text[83] and passage not in text[84] and len(text[84].split()) == 55
    assert all(text[i] == base[i] for i in range(40))
    assert ids["decontamination"] == set(text) - {82} == ids["packing"]
    assert sum(r.n_words for r in after["packing"]) == sum(len(r.text.split()) for r in after["decontamination"])
    assert sorted(map(repr, pipeline.run(spark, root).collect())) == sorted(map(repr, after["packing"]))


def test_near_copies_whose_bits_differ_everywhere(spark, docs):
    """The second stage drops the later of two texts at most 20 bits apart, though each 15 bits of the fingerprints differ in two or more."""
    import numpy as np
    import pyarrow as pa

    from gistline.llm import simhash

    r, texts = random.Random(21), []
    for i in range(3000):
        w = prose(150, 10_000 + i, 10**5).split()
        texts.append(" ".join(w))
        for k in r.sample(range(150), 17):
            w[k] = f"v{r.randrange(10**6)}"
        texts.append(" ".join(w))
    f = np.unpackbits(simhash.fingerprints(pa.array(texts))[0].view(np.uint8), axis=1, bitorder="little")
    apart = f[::2] != f[1::2]
    hard = np.flatnonzero((apart.sum(axis=1) <= 20) & (apart[:, :120].reshape(-1, 8, 15).sum(axis=2) >= 2).all(axis=1))
    some = [texts[2 * i + k] for i in hard.tolist() for k in (0, 1)]
    assert len(hard) >= 5
    assert {x.doc_id for x in pipeline.near_copies(spark, docs(some), "").collect()} == {*range(0, len(some), 2)}


def orders(matches, penalty):
    """All ways ("1" a match, "0" a substitution) in which the last so many matches of an overlap may stand."""
    out, todo = [], [("1", 1)]
    while todo:
        s, score = todo.pop()
        if s.count("1") == matches:
            out.append(s)
            continue
        todo += [("1" + s, score + 1)] + [("0" + s, score - penalty)] * (score > penalty)
    return out


def test_leaks_whatever_the_order_of_their_substitutions(spark, docs, tmp_path):
    """The fourth stage drops documents with 12 matching words of a long item in one stretch, wherever substitutions stand; one match less stays."""
    from gistline.llm import decontam

    item, some = prose(60, 8000, 10**6).split(), orders(decontam.LEAST, decontam.PENALTY)
    assert len(some) == 91 and "11111011101111" in some
    texts, stay = [], set()
    for i, s in enumerate(some):
        score = [sum(1 if c == "1" else -decontam.PENALTY for c in s[:k]) for k in range(len(s))]
        longer = "1" * -min(score) + s  # so that the stretch of greatest score begins no later
        for s in [longer] + ["0" + s[1:]] * (s == longer):
            stay |= {len(texts)} if s[0] == "0" else set()
            a = (i * 7) % (len(item) - len(s))
            w = [item[a + k] if c == "1" else f"sub{k}" for k, c in enumerate(s)]
            texts.append(" ".join([prose(i % 30, 8100 + i), *w, prose(i % 20, 8300 + i)]))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {x.doc_id for x in pipeline.leaks(spark, docs(texts), str(tmp_path)).collect()} == stay != set()


def odd_tables(spark, root, docs, labels, items):
    docs.write.parquet(f"{root}/documents.parquet")
    labels.write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages_on_odd_documents(spark, odd, labels, tmp_path):
    """Nulls, empty and long texts, equal rows, a missing doc_id, clashing names: every stage alone, and all."""
    item = prose(30, 77)
    some = odd.unionByName(odd.filter("doc_id = 13").selectExpr("18L doc_id", f"'{item}' text", "lang", "source", "n_chars", "key", "th", "starts", "row_key", "`a.b`"))
    root = odd_tables(spark, tmp_path, some, labels([(14, 1, 0), (18, 0, 0), (None, None, None), (13, 1, None)]), [(1, item), (2, None), (None, ""), (3, "yes")])
    docs = spark.read.parquet(f"{root}/documents.parquet")
    texts = [r.text for r in docs.collect()]
    one = lambda t: -1 if t is None else len(t)
    want = {"toxicity": sorted(map(one, texts)), "near_duplicates": None, "suffix_dedup": None, "decontamination": sorted(one(t) for t in texts if t != item), "packing": None}
    for name, stage in pipeline.STAGES:
        got = stage(spark, docs, root)
        if name == "packing":
            assert sum(r.n_words for r in got.collect()) == sum(len((t or "").split()) for t in texts)
            continue
        assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
        rows = got.collect()
        if want[name] is not None:
            assert sorted(one(r.text) for r in rows) == want[name]
        assert {None, "", "  \n", "one", "日本 語 text"} <= {r.text for r in rows}
        assert max(len(r.text or "") for r in rows) == max(len(t or "") for t in texts)
    near = [(r.doc_id, r.text) for r in pipeline.near_copies(spark, docs, root).collect()]
    assert len(near) == len(set(near)) and {i for i, _ in near} == {10, 11, 12, 13, 14, 16, 17, 18, None}
    cut = [r.doc_id for r in pipeline.repeats(spark, docs, root).collect()]
    assert 15 not in cut and cut.count(14) == 2
    packed = pipeline.run(spark, root).collect()
    assert {r.doc_id for r in packed if r.doc_id > 0} == {13, 14, 16, 17} and len({r.doc_id for r in packed if r.doc_id < 0}) == 1


def test_nothing_is_left_in_the_shared_folder(spark, odd, labels, tmp_path):
    from pathlib import Path

    from gistline.llm import shared

    shared.release(spark)
    root = odd_tables(spark, tmp_path, odd, labels([(14, 1, 0)]), [(1, prose(30, 77))])
    rows = pipeline.run(spark, root).collect()
    left = [p.name for p in Path(shared.shared_root(spark)[len("file://") :], "gistline").iterdir() if p.name.startswith("stage-")]
    assert rows and len(left) == 1 and left[0].startswith("stage-packing-") and shared.mark(spark) == 1
    shared.release(spark)
    assert shared.mark(spark) == 0


def test_empty_tables(spark, odd, labels, tmp_path):
    root = odd_tables(spark, tmp_path, odd.limit(0), labels([]), [])
    assert pipeline.run(spark, root).count() == 0
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, root)
        assert got.columns == docs.columns and got.count() == 0


def test_registered():
    import __spark_entry__ as e

    names = [q for q in e.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
