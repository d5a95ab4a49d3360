"""Literals: paths, patches, identifiers, generated lines, routes."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "out"),
    [("src/latest_news.py", True), ("src/test_utils/a.py", True), ("tests/x.py", True), ("a/b_test.py", True), ("contest_x.py", True), ("a/core.py", False), ("my/docs/a.py", True), ("a/.git/b.py", True), ("a/xgit/b.py", False), ("Tests/x.py", False), ("protest.py", False)],
)
def test_excluded(spark, path, out):
    assert one(spark, T.excluded(F.col("p")), p=path) is out


@pytest.mark.parametrize(("size", "kind"), [(0, "empty"), (1, "kept"), (1_000_000, "kept"), (1_000_001, "too_big")])
def test_file_class(spark, size, kind):
    assert one(spark, T.file_class(F.lit("a/core.py"), F.col("n")), n=size) == kind


@pytest.mark.parametrize(
    ("patch", "files"),
    [
        ("--- a/x.py\n+++ b/x.py\n", ["x.py"]),
        ("+++ b/x.py\n+++ b/y z.py\n+++ b/x.py\n", ["x.py", "y z.py"]),
        ("diff --git a/x.py b/x.py\n--- a/x.py\n+++ /dev/null\n", ["x.py"]),
        ("", []),
    ],
)
def test_gold_files(spark, patch, files):
    assert one(spark, T.gold_files(F.col("p")), p=patch) == files


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("models.CharField and FilePathField", ["models.CharField", "CharField", "FilePathField"]),
        ("LOCAL_FILE_DIR max_length", ["LOCAL_FILE_DIR", "max_length"]),
        ("use `os.path.join(a, b)`", ["os.path.join", "a", "b"]),
        ("class Foo: def bar(self)", ["Foo", "bar"]),
        ("self `self` args", []),
        ("HTTP ABC x", ["HTTP", "ABC"]),
        ("", []),
    ],
)
def test_identifiers(spark, text, found):
    assert one(spark, T.extract_identifiers(F.col("t")), t=text) == found


def test_generated_identifiers(spark):
    text = "- base64\n1. Field\nName -- comment\nThis is prose\nField\n   \n`quoted`"
    assert one(spark, T.generated_identifiers(F.col("t")), t=text) == ["base", "Field", "Name", "This", "quoted"]
    assert len(one(spark, T.generated_identifiers(F.col("t"), 3), t="\n".join(f"n{chr(97 + i)}" for i in range(9)))) == 3


@pytest.mark.parametrize(("text", "n", "level"), [("fix core.utils", 2, "g3"), ("fix it", 2, "g2"), ("word " * 120, 120, "g0"), ("core.utils " * 120, 120, "g2")])
def test_route(spark, text, n, level):
    assert one(spark, T.routed_level(F.col("t"), F.col("n")), t=text, n=n) == level


def test_decoding_and_paths(spark):
    raw = spark.createDataFrame([(bytearray(b"a\xff\r\nb\rc"),)], "c binary")
    assert raw.select(T.decoded(F.col("c"))).first()[0] == "a\ufffd\nb\nc"
    assert raw.select(T.byte_slice(F.col("c"), F.lit(4), F.lit(5))).first()[0] == "b"
    assert one(spark, T.path_stem(F.col("p")), p="a/b.c/d.tar.gz") == "d.tar"
    assert one(spark, T.path_stem(F.col("p")), p="a/.hidden") == ".hidden"
    assert one(spark, T.module_tail(F.col("p")), p="a.b.c") == "c"
    assert one(spark, T.repo_folder(F.col("p")), p="a/b") == "a__b"
