"""Uploads that are large, mixed, or not UTF-8."""

import json

from verity.sources import readers
from verity.sources.readers import LATIN_1, by_encoding, json_lines_files, read_csv, read_json_records, read_upload


def test_json_lines_are_never_one_string(spark, tmp_path, monkeypatch):
    """A file of JSON Lines of many splits is judged and read by many tasks; nothing reads it whole."""
    p = tmp_path / "big.json"
    with open(p, "w") as f:
        for i in range(40_000):
            f.write(json.dumps({"k": f"v{i}", "t": "} {\" [", "n": {"x": i}}) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        assert json_lines_files(spark, str(p)).collect()[0]["lines"]
        df = read_json_records(spark, str(p))
        assert df.rdd.getNumPartitions() > 5 and df.count() == 40_000 and df.columns == ["k", "n", "t"]
        assert readers.json_shapes(spark, str(p)) == {("lines", None): []}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_shapes_by_line(spark, tmp_path):
    texts = {"lines.json": '{"a": 1}\n\n  {"a": 2}\t\r\n', "one.json": '{"a": 1}', "array.json": '[\n{"a": 1},\n{"a": 2}\n]',
             "pretty.json": '{\n  "a": 1\n}', "blank.json": " \n\n", "two.json": '{"a": 1}\n{"a": 2} {"a": 3}'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = {r["file"].rsplit("/", 1)[1]: r["lines"] for r in json_lines_files(spark, str(tmp_path)).collect()}
    assert got == {"lines.json": True, "one.json": False, "array.json": False, "pretty.json": False, "two.json": False}


def test_each_file_by_its_own_encoding(spark, tmp_path):
    files = {"utf8 a%.csv": ("id,name,city\n1,José,中文\n2,\"a\nb\",Zürich\n", "utf-8"), "latin 1.csv": ("id,name,more\n3,José,Ménage\n4,Ann,\n", "latin-1"),
             "ascii.csv": ("id,name,city\n5,Bob,\n", "ascii")}
    for name, (text, charset) in files.items():
        (tmp_path / name).write_bytes(text.encode(charset))
    assert [f.rsplit("/", 1)[1] for f in by_encoding(spark, str(tmp_path))[LATIN_1]] == ["latin%201.csv"]
    rows = {r["id"]: (r["name"], r["city"], r["more"]) for r in read_upload(spark, str(tmp_path), fmt="csv").collect()}
    assert rows == {1: ("José", "中文", None), 2: ("a\nb", "Zürich", None), 3: ("José", None, "Ménage"), 4: ("Ann", None, None), 5: ("Bob", None, None)}


def test_one_file_and_a_chosen_encoding(spark, tmp_path):
    p = tmp_path / "l.tsv"
    p.write_bytes("name\tcity\nJosé\tMünchen\n".encode("latin-1"))
    assert read_upload(spark, str(p)).first()["city"] == "München"
    assert read_csv(spark, str(p), "\t", encoding="ISO-8859-1").first()["name"] == "José"
    q = tmp_path / "u.csv"
    q.write_text("name\nÃ©\n", encoding="utf-8")                  # valid UTF-8 is never taken for latin-1
    assert read_upload(spark, str(q)).first()["name"] == "Ã©"
