import pytest
from pyspark.sql import functions as F

from millrace.functions import allowances, text


@pytest.mark.parametrize(
    ("name", "words"),
    [
        ("Load_allOpenOrders", ["Load", "all", "Open", "Orders"]),
        ("XMLFeedReader7", ["XML", "Feed", "Reader", "7"]),
        ("@_ftpPort8080DNS_", ["ftp", "Port", "8080", "DNS"]),
        ("ÖlPreis", ["Öl", "Preis"]),
        ("IO", ["IO"]),
        ("__", []),
        ("", []),
        pytest.param("\U00010410\U00010438\U00010438Reader", ["\U00010410\U00010438\U00010438", "Reader"], marks=pytest.mark.xfail(reason="letters above U+FFFF follow Java's look-behind")),
    ],
)
def test_identifier_words(spark, name, words):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(text.identifier_words(F.col("n"))).first()[0] == words


@pytest.mark.parametrize(
    ("pattern", "path", "match"),
    [
        ("**/billing/*.kt", "billing/Tax.kt", True),
        ("**/billing/*.kt", "app\\billing\\Tax.kt", True),
        ("**/billing/*.kt", "billing/old/Tax.kt", False),
        ("**/billing/*.kt", "Billing/Tax.kt", False),
        ("app\\*.kt", "app/Main.kt", True),
        ("x?.kt", "x9.kt", True),
        ("x?.kt", "x/.kt", False),
        ("**DOUBLE**/*.kt", "other/Main.kt", False),
        ("v(2)[x].kt", "v(2)[x].kt", True),
        ("v[12].kt", "v1.kt", False),
        ("src/*", "src/a/b.proj", False),
        ("**", "one/two", True),
    ],
)
def test_globs(spark, pattern, path, match):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(text.matches_glob(F.col("p"), pattern)).first()[0] is match


def test_namespaces(spark):
    df = spark.createDataFrame([("A",), ("A.B",), ("AB",), ("",), (None,)], "n string")
    got = [r[0] for r in df.select(text.in_namespace(F.col("n"), "A.**")).collect()]
    assert got == [True, True, False, False, False]


def test_lines_and_columns_count_utf16(spark):
    df = spark.createDataFrame([("a\r\n😀b\rc", 0), ("a\r\n😀b\rc", 5), ("a\r\n😀b\rc", 7), ("", 0)], "t string, o int")
    got = [tuple(r[0]) for r in df.select(text.line_and_column(F.col("t"), F.col("o"))).collect()]
    assert got == [(1, 1), (2, 3), (3, 1), (1, 1)]


def test_constants_keep_null_and_text_apart(spark):
    df = spark.createDataFrame([("s", True, None), ("s", True, "null"), ("s", False, None), ("i", True, "1"), ("l", True, "1")], "t string, h boolean, v string")
    assert df.select(text.constant_key(F.col("t"), F.col("h"), F.col("v"))).distinct().count() == 5


def test_float_keys_tell_zeros_apart(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.5,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(text.float_key(F.col("x"))).collect()] == ["0.0", "-0.0", "1.5", "NaN"]


def test_length_prefixes_part_lists(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c")], "x string, y string")
    assert df.select(text.length_prefixed(F.col("x"), F.col("y"))).distinct().count() == 2


def test_templates_have_one_hole(spark):
    df = spark.createDataFrame([("a/1",), ("a/1/2",), ("a",)], "t string")
    assert [r[0] for r in df.select(text.template_key(F.col("t"))).collect()] == ["a/{}", None, None]


def test_member_paths(spark):
    df = spark.createDataFrame([("Items[0].Name",), ("A.",), ("A",)], "p string")
    assert [r[0] for r in df.select(text.member_path(F.col("p"))).collect()] == [["Items", "[0]", "Name"], None, ["A"]]


def test_allowances(spark):
    df = spark.createDataFrame([("// rule-allow A1, B2: because",), ("// rule-allow : x",), ("// rule-allow A1",), ("// something",), ("//  rule-allow A1, A1: y",)], "c string")
    got = [r[0] and tuple(r[0]) for r in df.select(allowances.parse_allowance(F.col("c"))).collect()]
    assert got[0] == (["A1", "B2"], "because", "")
    assert got[1][2] == "no rule is named" and got[2][2] == "no reason is given" and got[3] is None and got[4][2] == "a rule is named twice"
