"""Exports on files of both kinds and all shapes."""

import json

import pytest

from skald.sources import exports


def test_csv_exports_of_any_delimiter_keep_their_order(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text('﻿Timestamp;Author;Content\n2024-01-15T10:00:00;Ann;"one; with\nlines ""q"""\n;Bob;two\n;;\nbad;Cid;three\n', encoding="utf-8")
    (tmp_path / "deep" / "b.csv").write_text("author\tcontent\tother\nx\ty\tz\n\tw\t\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("author,content,timestamp\n", encoding="utf-8")
    got = [(r.export, r.pos, r.author, r.content, str(r.ts)) for r in exports.read_csv_exports(spark, str(tmp_path)).orderBy("export", "pos").collect()]
    assert got == [("a", 0, "Ann", 'one; with\nlines "q"', "2024-01-15 10:00:00"), ("a", 1, "Bob", "two", "None"), ("a", 3, "Cid", "three", "None"), ("b", 0, "x", "y", "None"), ("b", 1, "", "w", "None")]


def test_json_exports_of_unknown_shape_fail(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"messages": [{"author": {"name": "Ann"}, "content": "hi", "timestamp": "2024-01-15T10:00:00Z"}, {"author": "Bob"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"content": "x"}]))
    (tmp_path / "d.csv").write_text("author,content\n,csv\n")
    got = {(r.export, r.pos, r.author, r.content) for r in exports.read_exports(spark, str(tmp_path), "Nobody").collect()}
    assert got == {("a", 0, "Ann", "hi"), ("a", 1, "Bob", ""), ("b", 0, "Nobody", "x"), ("d", 0, "Nobody", "csv")}
    (tmp_path / "c.json").write_text(json.dumps({"other": []}))
    assert exports.read_json_exports(spark, str(tmp_path), strict=False).count() == 3
    with pytest.raises(Exception, match="no messages in the export c"):
        exports.read_json_exports(spark, str(tmp_path)).collect()
