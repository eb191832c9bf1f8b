"""Sources read files of the documented shapes."""
import json

import pytest

from graftline.schemas import BOOK_ENTRY, LAB_RECORD, REGION_NOTE
from graftline.sources import html, records, tables, text


def test_records_keyed_and_bundles(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.json").write_text(json.dumps([{"id": "kent", "summary": "s", "local_varieties": ["x"]}, {"id": "york"}]))
    got = records.read_records(spark, str(tmp_path / "a"), REGION_NOTE).orderBy("id").collect()
    assert [r["id"] for r in got] == ["kent", "york"] and got[0]["file"] == "1.json" and got[1]["summary"] is None
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "hogg-1884.json").write_text(json.dumps({"_book": "meta", "gala": {"line": 3, "end": 9, "tags": ["sweet"], "note": None}}))
    (r,) = records.read_keyed(spark, str(tmp_path / "k"), BOOK_ENTRY).collect()
    assert (r["file"], r["id"], r["line"], r["end"], r["tags"]) == ("hogg-1884", "gala", 3, 9, ["sweet"])
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text(json.dumps({"_source": {"key": "abc", "title": "T"}, "records": {"gala": {"ssc": 12.5, "n": 2}}}))
    (tmp_path / "b" / "y.json").write_text(json.dumps({"records": {"fuji": {"ssc": 1.0}}}))
    (r,) = records.read_bundle(spark, str(tmp_path / "b"), LAB_RECORD).collect()
    assert (r["source"], r["id"], r["ssc"], r["n"]) == ("abc", "gala", 12.5, 2)


@pytest.fixture
def tiny_blocks(spark):
    """Files are cut into blocks of a few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def _awkward(i: int) -> dict:
    texts = ['plain', 'a, b, "c" {d} [e]', 'ends in a backslash \\\\', 'quote \\" comma, "', '{"not": "json"}, ', 'Grüße, 中文, ü', "", "x, " * 40, ",,,", '\\\\", {']
    return {"line": i, "end": i + 2, "tags": [texts[i % 10], "sweet, sharp"][: i % 3], "note": texts[(i * 7) % 10] or None}


@pytest.mark.parametrize("indent", [None, 1])
def test_keyed_records_in_blocks(spark, tmp_path, tiny_blocks, indent):
    want = {}
    for f in ("one", "two"):
        rows = {f"{f}, {i}": _awkward(i) for i in range(120)}
        want |= {(f, k): v for k, v in rows.items()}
        (tmp_path / f"{f}.json").write_text(json.dumps({"_meta": {"a": [1, {"b": ", "}]}, **rows, "_last": None}, indent=indent, ensure_ascii=f == "one"))
    (tmp_path / "none.json").write_text("{}")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = {(r["file"], r["id"]): {"line": r["line"], "end": r["end"], "tags": r["tags"], "note": r["note"]} for r in records.read_keyed(spark, str(tmp_path), BOOK_ENTRY).collect()}
    assert got == want


@pytest.mark.parametrize("first", [True, False])
def test_bundles_in_blocks(spark, tmp_path, tiny_blocks, first):
    source = {"key": "a, b", "title": 'T "x", {', "year": 1999}
    rows = {f"id {i}, {{": {"ssc": i / 2, "n": i} for i in range(150)}
    held = {"_source": source, "other": [1, [2, {"ssc": 3}]], "records": rows} if first else {"records": rows, "more": {"x": {"ssc": 1}}, "_source": source}
    (tmp_path / "x.json").write_text(json.dumps(held))
    (tmp_path / "y.json").write_text(json.dumps({"records": {"fuji": {"ssc": 1.0}}}))
    (tmp_path / "z.json").write_text(json.dumps({"_source": {"key": "empty"}, "records": {}}))
    (tmp_path / "n.json").write_text(json.dumps({"_source": {"key": "null"}, "records": None}))
    got = {(r["source"], r["title"], r["id"]): (r["ssc"], r["n"]) for r in records.read_bundle(spark, str(tmp_path), LAB_RECORD).collect()}
    assert got == {("a, b", 'T "x", {', k): (v["ssc"], v["n"]) for k, v in rows.items()}


def test_books_in_blocks(spark, tmp_path, tiny_blocks):
    books = {b: [f"line {i} of {b}" + "x" * (i % 50) if i % 7 else "" for i in range(n)] for b, n in (("long", 900), ("short", 3))}
    for b, lines in books.items():
        (tmp_path / f"{b}.txt").write_bytes(("\r\n" if b == "short" else "\n").join(lines).encode() + b"\n")
    read = text.read_book_lines(spark, str(tmp_path))
    assert {(r["book"], r["line_no"]): r["text"] for r in read.collect()} == {(b, i + 1): t for b, lines in books.items() for i, t in enumerate(lines)}


def test_delimited(spark, tmp_path):
    f = tmp_path / "panel.csv"
    f.write_text("﻿MUNQ,Accession Name\n1,Gala\n", encoding="utf-8")
    assert tables.read_csv_checked(spark, str(f), {1: "accession name"}).columns == ["MUNQ", "Accession Name"]
    with pytest.raises(ValueError):
        tables.read_csv_checked(spark, str(f), {1: "Harvest"})
    g = tmp_path / "e.csv"
    g.write_text("Sampstat;AcceName\n300;Gala; Fuji\n")
    assert tables.read_sniffed(spark, str(g), {"name": ["ACCENAME"], "status": ["SAMPSTAT"], "other": ["X"]}).collect()[0].asDict() == {"name": "Gala", "status": "300", "other": None}


def test_books_and_cards(spark, tmp_path):
    (tmp_path / "hogg.txt").write_bytes(b"one\r\ntwo\n\nfour")
    got = [tuple(r) for r in text.read_book_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [("hogg", 1, "one"), ("hogg", 2, "two"), ("hogg", 3, ""), ("hogg", 4, "four")]
    card = '<h3 class="text-lg b"> %s </h3><a href="applebyname/%s-id-1" type="button">'
    raw = (card % ("Königin", "konigin")).encode() + (card % ("Reine Clémence ’", "reine")).encode("cp1252")
    df = spark.createDataFrame([(bytearray(raw),)], "raw binary")
    assert {r["name"] for r in html.extract_cards(df).collect()} == {"Königin", "Reine Clémence ’"}


def test_wiki_rows(spark):
    lines = ["{|", "|-", "| '''[[Gala (apple)|Gala]]''' ({{aka}} [[Kidd]]'s, Royal or Tenroy)", "| x", "|-", "| Fuji apple<ref>y</ref>", "|-", "| (see Gala)", "|-", "|}"]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(lines)], "page string, line_no int, text string")
    got = {r["name"]: list(r["aka"]) for r in html.parse_wiki_list(df).collect()}
    assert got["Fuji"] == [] and len(got["Gala"]) == 3 and set(got) == {"Gala", "Fuji"}
