"""Files, settings, results, embedding, streaming, the entry module with and without its optional parts."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gistline.functions import instrument
from gistline.plans.compress import Options, batch
from gistline.sources import embedding, files
from gistline.streaming.compress import compress_stream

ROOT = Path(__file__).resolve().parents[1]


def test_batch_job(spark, tmp_path):
    (tmp_path / "m.csv").write_text('File Name,Query\nbook.txt," who is it? what, then?"\n')
    (tmp_path / "texts").mkdir()
    for k in range(1, 11):
        (tmp_path / f"texts/book_part{k}.txt").write_bytes(f"Part {k} begins here. Nobody knows who it is! 中文也有。".encode("gb18030" if k == 2 else "utf-8"))
    m = files.manifest(spark, str(tmp_path / "m.csv"))
    assert m.first().query == " who is it? what, then?"
    t = files.texts(spark, f"{tmp_path}/texts/*.txt")
    assert {r.encoding for r in t.collect()} == {"utf-8", "gb18030"} and all("中文" in r.text for r in t.collect())
    rows = batch(m, t.select("file_name", "text"), Options("bm25", max_length=60, topn=1, chunk_length=8), embed=embedding.embedder(embedding.hashed(16)))
    got = rows.collect()
    assert len(got) == 20 and {r["Query Term"] for r in got} == {"who is it", "what, then"}
    assert all(r["Similarity by TopN"] >= 0 for r in got)
    files.write_results(rows, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 20
    files.export_results(rows.limit(2), f"{tmp_path}/sub/out.json")
    assert [len(r) for r in json.loads((tmp_path / "sub/out.json").read_text())] == [1, 1]
    files.export_results(rows.limit(0), f"{tmp_path}/sub/none.json")
    assert json.loads((tmp_path / "sub/none.json").read_text()) == []


def test_decode():
    assert files.decode("é".encode("utf-16"))[1] == "é" and files.decode(b"\xff\xff\xff")[0] == "utf-8" and files.decode(b"") == ("utf-8", "")


def test_settings_and_stopwords(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("compressor_type: pos+tfidfrank\nlanguage: zh\ntopN: 3\ngraph:\n  edge_type: x\n  window_size: 9\n")
    o = files.settings(str(tmp_path / "c.yaml")).options()
    assert (o.method, o.topn, o.chunk_length, o.window) == ("pos+tfidfrank", 3, 128, 9)
    (tmp_path / "w.txt").write_text("the\n and \n\n")
    assert files.stopwords(spark, str(tmp_path / "w.txt")) == ("and", "the")
    with pytest.raises(TypeError):
        (tmp_path / "d.yaml").write_text("unknown: 1\n")
        files.settings(str(tmp_path / "d.yaml"))


def test_embedder_takes_ten_at_a_time(spark):
    def embed(texts):
        assert len(texts) <= 10
        return [[float(len(t))] for t in texts]

    d = spark.range(35).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t"))
    assert sorted(r[0][0] for r in d.select(embedding.embedder(embed)(F.col("t"))).collect()) == [float(i) for i in range(35)]


def test_instrument(spark, tmp_path):
    @instrument.timed
    def work():
        return 1

    work(), work()
    u = instrument.usage(instrument.calls(spark)).filter("func = 'work'").first()
    assert u["count"] == 2 and u.max_time <= u.total_time
    log = instrument.log_to(str(tmp_path / "log"), "t", False)
    log.info("hello")
    assert "hello" in next((tmp_path / "log").iterdir()).read_text()


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "One two three. Four five six."), (2, "")], "doc_id long, text string").write.parquet(src)
    q = compress_stream(spark.readStream.schema("doc_id long, text string").parquet(src), Options("tfidf", topn=1), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {(r.doc_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "ok"), (2, "empty")}


def test_entry_without_optional_parts(tmp_path):
    shutil.copytree(ROOT / "gistline", tmp_path / "gistline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_query' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=100)


def test_queries_match_sql_on_a_small_table(spark, tmp_path):
    import duckdb

    from gistline import oracle
    from gistline.queries import QUERIES

    docs = [(0, "Mr. A. said 3.14 is fine. OK? Yes; no, never! " * 12), (1, "word " * 80 + ", and more; words。再见！ok"), (2, "short")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "fine words."), (1, "never said")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    sql = oracle.oracle_sql()
    for name in ("segment_split", "chunk_pack", "bm25_query", "compress_tfidf", "select_skip", "pagerank_fixed", "highlight_html", "chunk_counts"):
        df = QUERIES[name](spark, str(tmp_path))
        cols = sorted(df.columns)
        want = db.sql(f"SELECT {', '.join(cols)} FROM ({sql[name]})").fetchall()
        assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, want)), name
