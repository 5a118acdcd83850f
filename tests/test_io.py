"""Reader fixtures: client-dump TSV and windows-1252 CSV edge rows."""

import os

import pytest

from hearth.session import shared_path
from hearth.sources import io as IO


def _local(path):
    return path[len("file:"):] if path.startswith("file:") else path


def test_dump_tsv_null_word_lone_quote_and_escapes(spark):
    path = shared_path(spark, "tsv-fixture")
    os.makedirs(_local(path))
    with open(os.path.join(_local(path), "part.tsv"), "w", encoding="utf-8") as f:
        f.write("id\tname\tamount\n")
        f.write('1\tsays "hi\t10.5\n')
        f.write("2\tNULL\tNULL\n")
        f.write("3\ttab\\there\\\\x\t-1\n")
    rows = sorted(IO.read_dump_tsv(spark, path, "id long, name string, amount double").collect())
    assert rows[0].name == 'says "hi' and rows[0].amount == 10.5
    assert rows[1].name is None and rows[1].amount is None
    assert rows[2].name == "tab\there\\x"


def test_cp1252_csv(spark):
    path = shared_path(spark, "csv-fixture")
    os.makedirs(_local(path))
    with open(os.path.join(_local(path), "part.csv"), "wb") as f:
        f.write("id,label\n1,\"café \\\"noir\\\"\"\n2,plain\n".encode("cp1252"))
    rows = sorted(IO.read_flat_csv(spark, path, "id long, label string").collect())
    assert rows[0].label == 'café "noir"' and rows[1].label == "plain"


def test_keyed_tsv_null_marker(spark):
    path = shared_path(spark, "keyed-fixture")
    os.makedirs(_local(path))
    with open(os.path.join(_local(path), "part.txt"), "w") as f:
        f.write("1\t1970\n2\t\\N\n")
    rows = sorted(IO.read_keyed_tsv(spark, path, "id long, annee_naissance int").collect())
    assert rows[0].annee_naissance == 1970 and rows[1].annee_naissance is None


ODD = ["", "  pad  ", "a\rb", "a\nb", "a\r\nb", "a\tb", "back\\slash", "\\", "\\t", "\\\\n", "x\\", 'quo"te', '"',
       "a\u0001b", "NULL", "\\NULL", "null", "a\0b", "N", "é😀", "end\n", "a,b", "\\,", None]


def test_dump_is_lossless(spark):
    df = spark.createDataFrame([(i, t, None if i % 2 else i / 2) for i, t in enumerate(ODD)],
                               "id long, t string, x double")
    path = shared_path(spark, "tsv-lossless")
    IO.write_dump_tsv(df.repartition(3), path)
    back = IO.read_dump_tsv(spark, path, "id long, t string, x double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_flat_csv_keeps_line_ends_and_padding(spark):
    texts = [t for t in ODD if t is None or all(c not in t for c in "\0\u0001😀")]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    path = shared_path(spark, "csv-lossless")
    IO.write_flat_csv(df, path)
    back = IO.read_flat_csv(spark, path, "id long, t string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_extract_report(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, plateforme string")
    path = shared_path(spark, "extract")
    IO.write_dump_tsv(df, path)
    rows, report = IO.read_extract(spark, path, df.schema)
    assert rows.count() == 4
    assert {(r.platform, r.n_rows, r.n_columns) for r in report.collect()} == {("a", 2, 2), ("b", 1, 2), (None, 4, 2)}


def test_rows_equal_to_the_header_stay(spark, tmp_path):
    path = str(tmp_path / "one")
    df = spark.createDataFrame([("text",), ("other",), (None,), ("text",), ("",)], "text string")
    IO.write_dump_tsv(df.repartition(2), path)
    back = IO.read_dump_tsv(spark, path, "text string")
    assert sorted(str(r.text) for r in back.collect()) == ["", "None", "other", "text", "text"]


def test_characters_that_the_encoding_lacks_raise(spark, tmp_path):
    good = spark.createDataFrame([(1, "café œuvre")], "id long, t string")
    IO.write_flat_csv(good, str(tmp_path / "good"))
    assert IO.read_flat_csv(spark, str(tmp_path / "good"), "id long, t string").first().t == "café œuvre"
    bad = spark.createDataFrame([(1, "日本 ł")], "id long, t string")
    with pytest.raises(Exception, match="windows-1252"):
        IO.write_flat_csv(bad, str(tmp_path / "bad"))
