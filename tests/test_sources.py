import pytest
from pyspark.sql import functions as F

from fjordex.sources import loaders
from fjordex.streaming.incremental import stream_postings


def test_loaders(spark, tmp_path):
    files = {
        "a.txt": "first doc\tmeta one\trest\n\n   \nthe second\n third \n",
        "b.xml": "<r><doc> x <b>no</b> y</doc><doc>z</doc></r>",
        "c.csv": 'name,say\nada,"hi, ""you""\nthere"\nbob,\n',
        "d.tsv": "name\tsay\neve\tyo\n",
        "e.json": 'junk\n{"body": "j1", "url": "u"}\n{"body": "j2"}\n',
    }
    paths = []
    for n, t in files.items():
        (tmp_path / n).write_text(t)
        paths.append(str(tmp_path / n))
    rows = loaders.read_corpus(spark, paths, [{"src": n, "name": "forced"} if n == "d.tsv" else {"src": n} for n in files]).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(10))
    assert [(r.body, r.meta) for r in rows[:3]] == [("first doc", "meta one"), ("the second", None), ("third", None)]
    assert [r.body for r in rows[3:5]] == [" x   y", "z"] and rows[5].say == 'hi, "you"\nthere' and rows[7].name == "forced" and [r.body for r in rows[8:]] == ["j1", "j2"]
    kept = loaders.read_corpus(spark, paths[:1], pipeline=[lambda d: d.where(~F.col("body").contains("the"))])
    assert [(r.doc_id, r.body) for r in kept.orderBy("doc_id").collect()] == [(0, "first doc"), (1, "third")]
    with pytest.raises(ValueError):
        loaders.read_corpus(spark, [str(tmp_path / "x.pdf")])
    with pytest.raises(ValueError):
        loaders.read_corpus(spark, paths, [{}])


def test_split_merge_json(spark):
    d = spark.createDataFrame([(1, "Crime, Drama ,crime"), (2, None)], "doc_id long, genre string")
    s = loaders.split_by(d, "genre")
    assert sorted((r.doc_id, r.label) for r in s.collect()) == [(1, "crime"), (1, "drama"), (2, "")]
    assert loaders.merge(s).count() == 2
    assert {r.json for r in loaders.to_json(d).collect()} == {'{"document_id":1,"fields":{"genre":"Crime, Drama ,crime"}}', '{"document_id":2,"fields":{}}'}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, body string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, body string").parquet(str(tmp_path / "in"))
    stream_postings(stream, ["body"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted((r.term, r.doc_id, r.tf) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1, 2), ("b", 1, 1)]


def test_access_log(spark):
    from fjordex.operators import index, ranked

    d = spark.createDataFrame([(i, f"common {w}") for i, w in enumerate("red green blue red".split())], "doc_id long, body string")
    post = index.postings(d, ["body"]).cache()
    log = loaders.AccessLog()
    found = ranked.search(log.observe(post.where("term in ('red')"), "postings", "term"), "red", d.count(), hits=1)
    won = ranked.with_fields(found, d)
    rows = log.observe(won, "winners", "doc_id").collect()
    # only the postings of the query's term are read, and only winners are fetched
    assert [r.doc_id for r in rows] == [0] and log.rows("postings") >= 2 and log.history("postings") == {"red"} and log.history("winners") == {"0"} and log.rows("winners") == 1


def test_several_files_in_a_folder(spark, tmp_path):
    for n, text in (("b.xml", "<r><doc>three</doc></r>"), ("a.xml", "<r><doc>one</doc><doc>two</doc></r>")):
        (tmp_path / n).write_text(text)
    rows = loaders.read_corpus(spark, [f"{tmp_path}/*.xml"]).orderBy("doc_id").collect()
    assert [(r.doc_id, r.body) for r in rows] == [(0, "one"), (1, "two"), (2, "three")]


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from fjordex import session

    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(applicationId="other", getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        session.scratch_dir(SimpleNamespace(sparkContext=context))


def test_endpoint(spark):
    import json
    import threading
    from urllib.error import HTTPError
    from urllib.parse import quote
    from urllib.request import urlopen

    from fjordex.operators import index, ranked
    from fjordex.sources.endpoint import endpoint

    d = spark.createDataFrame([(1, "grå ulv"), (2, "ulv ulv")], "doc_id long, body string")
    post = index.postings(d, ["body"]).cache()

    def search(text):
        if text == "break":
            raise ValueError("broken")
        return ranked.with_fields(ranked.search(post, text, d.count(), ranked.by_frequency), d).orderBy(F.col("score").desc())

    server = endpoint(search)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_address[1]}"
        got = json.loads(urlopen(f"{at}/query?q={quote('ulv')}", timeout=60).read())
        assert [m["doc_id"] for m in got["matches"]] == [2, 1] and got["matches"][1]["body"] == "grå ulv" and got["duration"] > 0
        assert json.loads(urlopen(f"{at}/query?q=", timeout=60).read())["matches"] == []
        for path, status in (("/other", 404), ("/query?q=break", 500)):
            with pytest.raises(HTTPError) as e:
                urlopen(at + path, timeout=60)
            assert e.value.code == status
    finally:
        server.shutdown()


def test_workspace(spark):
    import os

    from fjordex import session

    outside = session.written(spark.range(3), "kept")
    with session.workspace(spark) as path:
        inside = session.written(spark.range(3), "dropped")
        assert inside.count() == 3 and os.listdir(path)
        session.forget(inside)
        assert not os.listdir(path)
        session.written(spark.range(3), "dropped")
    assert not os.path.exists(path) and outside.count() == 3
