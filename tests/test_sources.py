"""File scans, signatures, instance lists, caches and sinks in a temporary folder."""

import json

from pyspark.sql import functions as F

from quern.sources import corpus


def test_scan_and_filter(spark, tmp_path):
    for name, body in {"a/core.py": "x = 1\n" * 20, "tests/t.py": "y", "a/empty.py": "", "a/n.txt": "no", "big.py": "#" * 1_000_001, "b.py": "caf\u00e9\r\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(body.encode())
    files = corpus.scan_files(spark, str(tmp_path))
    assert [r["path"] for r in corpus.eligible_files(files).collect()] == ["a/core.py", "b.py"]
    assert tuple(corpus.filter_stats(files, corpus.count_listed(spark, str(tmp_path))).first()) == (5, 2, 1, 1, 1)
    assert {r["path"]: r["content"] for r in corpus.read_texts(files).collect()}["b.py"] == "caf\u00e9\n"
    assert [r["path"] for r in corpus.smoke_files(files, 1).collect()] == ["a/core.py"]
    one = corpus.signature(files, "v1").first()[0]
    assert len(one) == 16 and one == corpus.signature(files.repartition(3), "v1").first()[0] != corpus.signature(files, "v2").first()[0]


def test_instances(spark, tmp_path):
    rows = [{"instance_id": "i1", "repo": "o/r", "base_commit": "c1", "problem_statement": "p", "patch": "+++ b/x.py\n", "_split": "test"}, {"instance_id": "i2", "repo": "o/r", "base_commit": "c2", "issue": "q", "patch": None, "_split": "dev"}]
    (tmp_path / "d.json").write_text(json.dumps(rows))
    got = corpus.load_instances(spark, str(tmp_path / "d.json"))
    assert sorted((r["instance_id"], r["problem_statement"], r["gold_files"]) for r in got.collect()) == [("i1", "p", ["x.py"]), ("i2", "q", [])]
    assert corpus.load_instances(spark, str(tmp_path / "d.json"), "dev").count() == 1


def test_cache_and_sink(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert corpus.cached(spark, str(tmp_path / "c"), build).count() == 3
    assert built == [1]
    rows = spark.createDataFrame([("r1", 1), ("r2", 2)], "repo string, x int")
    corpus.write_results(rows, str(tmp_path / "out"))
    corpus.write_results(rows.filter("repo = 'r1'").withColumn("x", F.lit(9)), str(tmp_path / "out"))
    assert sorted((r["repo"], r["x"]) for r in spark.read.json(str(tmp_path / "out")).collect()) == [("r1", 9), ("r2", 2)]
