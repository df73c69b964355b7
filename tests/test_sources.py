import os

import pytest

from registry import sources
from tidemark.sources import detect, documents, sinks, tables


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_dialects(spark, tmp_path):
    put(tmp_path, "a.csv", "id;name;value\n1;x;2\n")
    put(tmp_path, "b.csv", "\nid,name\n1,\"a;b;c\"\n")
    put(tmp_path, "c.csv", "id\tnome\n1\tSão\n".encode("latin-1"))
    put(tmp_path, "d.csv", "\"x,y,z\"|b\n1|2\n")
    put(tmp_path, "e.csv", "single\n1\n")
    put(tmp_path, "f.txt", "ignored;here")
    found = {r["file"].rsplit("/", 1)[1]: r for r in detect.detect_dialect(spark, str(tmp_path), ".csv").collect()}
    assert {k: r["delimiter"] for k, r in found.items()} == {"a.csv": ";", "b.csv": ",", "c.csv": "\t", "d.csv": "|", "e.csv": ","}
    assert {k for k, r in found.items() if r["encoding"] == "iso-8859-1"} == {"c.csv"}
    assert found["a.csv"]["columns"] == 3 and found["e.csv"]["columns"] == 1


def test_invalid_byte_far_into_the_file(spark, tmp_path):
    put(tmp_path, "late.csv", b"a,b\n" + b"x,y\n" * 20_000 + "São,z\n".encode("latin-1"))
    assert detect.detect_encoding(spark, str(tmp_path)).first()["encoding"] == "iso-8859-1"


def test_tolerant_csv(spark, tmp_path):
    path = put(tmp_path, "m.csv", 'A,B,C\n1,2,3\n4,5,6,7\n8,9\n"x,y",1,2\n1,2,3,\n,,\n"q""r,s",2,x\n1,,\n')
    good, rejected = tables.scan_csv_tolerant(spark, path, "A string, B int, C int")
    assert sorted((tuple(r) for r in good.collect()), key=str) == sorted(
        [("1", 2, 3), ("8", 9, None), ("x,y", 1, 2), (None, None, None), ('q"r,s', 2, None), ("1", None, None)], key=str
    )
    assert sorted(r[0] for r in rejected.collect()) == ["1,2,3,", "4,5,6,7"]
    assert good.select("B").filter("B = 2").count() == 2


def test_csv_encodings_and_line_breaks(spark, tmp_path):
    latin = put(tmp_path, "l.csv", "nome;n\nJosé;1\n".encode("latin-1"))
    assert tables.scan_csv(spark, latin, "nome string, n int", sep=";", encoding="ISO-8859-1").first()["nome"] == "José"
    broken = put(tmp_path, "n.csv", 'a,b\n"x\ny",1\n')
    assert tables.scan_csv(spark, broken, "a string, b int", multi_line=True).first()["a"] == "x\ny"
    assert tables.scan(spark, broken, multi_line=True).schema["b"].dataType.simpleString() == "int"


def test_json_kinds(spark, tmp_path):
    array = put(tmp_path, "a.json", ' [{"id": 1, "name": "x"},\n {"id": 2, "name": "y"}]')
    lines = put(tmp_path, "l.jsonl", '{"id": 1}\n{"id": 2}\n{"id": 3}\n')
    df, kind = tables.scan_json(spark, array)
    assert (df.count(), kind) == (2, "json")
    df, kind = tables.scan_json(spark, lines)
    assert (df.count(), kind) == (3, "jsonl")


def test_readers_refuse_the_unknown(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported file extension"):
        tables.scan(spark, "x.xlsx")
    with pytest.raises(RuntimeError, match="Delta connector"):
        tables.scan(spark, str(tmp_path / "t.delta"))


def test_row_cap(spark):
    assert tables.row_cap_guard(spark.range(10), 10).count() == 10
    with pytest.raises(ValueError, match="more than 9"):
        tables.row_cap_guard(spark.range(10), 9)


def test_text_documents(spark, tmp_path):
    put(tmp_path, "a.txt", "olá mundo")
    put(tmp_path, "b.md", "café".encode("latin-1"))
    put(tmp_path, "blank.txt", " \n\t ")
    put(tmp_path, "c.pdf", "no")
    found = {r["filename"]: r["text"] for r in documents.scan_text_documents(spark, str(tmp_path)).collect()}
    assert found == {"a.txt": "olá mundo", "b.md": "café"}


def test_table_lines(frame):
    df = frame([(2, "b", None), (1, "a", 1.5)], "id int, name string, x double")
    lines = documents.table_to_lines(df, ["id"]).orderBy("position").collect()
    assert [r["line"] for r in lines] == ["id | name | x", "1 | a | 1.5", "2 | b | nan"]


def test_lines_of_the_right_arity(frame):
    rows = [("f", -1, "some_header,x"), ("f", 0, "too_many,a,b"), ("f", 1, "col_a,col_b"), ("f", 2, "1,2"), ("f", 7, "later_name,z"), ("h", 1, "only_header,x"), ("f", 3, " , "), ("f", 4, "1,2,3"), ("f", 5, "1"), ("f", 6, '"a,b",'), ("g", 1, "x1,y")]
    lines = frame(rows, "file string, at int, line string")
    found = {(r["file"], r["at"]): (r["a"], r["b"]) for r in tables.parse_delimited_lines(lines, ["a", "b"]).collect()}
    assert found == {("f", 2): ("1", "2"), ("f", 6): ("a,b", None), ("f", 7): ("later_name", "z"), ("g", 1): ("x1", "y")}


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_round_trip(frame, spark, tmp_path, kind):
    df = frame([(1, 'a "quoted", text', None), (2, None, 2.5)], "id int, s string, x double")
    path = sinks.write(df, str(tmp_path / f"out.{kind}"), kind)
    options = {} if kind == "parquet" else {"schema": df.schema}
    assert sorted(map(tuple, tables.scan(spark, path, **options).collect())) == sorted(map(tuple, df.collect()))


def test_file_order_keeps_the_last_line(spark, tmp_path):
    from tidemark.operators.reconcile import Options, key_columns, merge_duplicates

    put(tmp_path, "a.csv", "k,v\n" + "".join(f"k{i % 10},{i}\n" for i in range(1000)))
    put(tmp_path, "b.csv", "k,v\nk3,-1\n")
    df = tables.with_file_order(tables.scan_csv(spark, str(tmp_path), "k string, v double"))
    kept = merge_duplicates(key_columns(df, ["k"]), ["k"], ["v"], Options(order_by=["file_order"]))
    assert {r["k"]: r["v"] for r in kept.collect()} == {f"k{i}": -1.0 if i == 3 else 990.0 + i for i in range(10)}


def test_nothing_to_detect(spark, tmp_path):
    put(tmp_path, "a.txt", "x")
    with pytest.raises(Exception):
        tables.scan_csv_detected(spark, str(tmp_path))


def test_windows_text(spark, tmp_path):
    signs = "€ „quoted“ — naïve Œuvre"
    (tmp_path / "w.csv").write_bytes(f"k,v\n1,{signs}\n".encode("windows-1252"))
    (tmp_path / "l.csv").write_bytes("k,v\n2,naïve\n".encode("iso-8859-1"))
    found = {r["file"].rsplit("/", 1)[1]: r["encoding"] for r in detect.detect_encoding(spark, str(tmp_path)).collect()}
    assert found == {"w.csv": "windows-1252", "l.csv": "iso-8859-1"}
    rows = tables.scan_csv_detected(spark, str(tmp_path), "k int, v string").collect()
    assert {r["k"]: r["v"] for r in rows} == {1: signs, 2: "naïve"}


def test_marks_and_sixteen_bits(spark, tmp_path):
    text = "k,v\n1,naïve\n2,Ċ\n"
    for name, content in {"s.csv": text.encode("utf-8-sig"), "l.csv": text.encode("utf-16-le"), "b.csv": text.encode("utf-16-be"), "m.csv": text.encode("utf-16"), "u.csv": text.encode()}.items():
        put(tmp_path, name, content)
    found = {r["file"].rsplit("/", 1)[1]: r["encoding"] for r in detect.detect_encoding(spark, str(tmp_path)).collect()}
    assert found == {"s.csv": "utf-8", "l.csv": "utf-16le", "b.csv": "utf-16be", "m.csv": "utf-16le", "u.csv": "utf-8"}
    rows = tables.scan_csv(spark, str(tmp_path / "l.csv"), "k int, v string", encoding="utf-16le").collect()
    assert {r["k"]: r["v"] for r in rows} == {1: "naïve", 2: "Ċ"}
    with pytest.raises(Exception, match="read it with scan_csv"):
        tables.scan_csv_detected(spark, str(tmp_path), "k int, v string").collect()


def test_files_of_all_dialects_in_one_scan(spark, tmp_path):
    put(tmp_path, "a.csv", 'id,name,at,x,ok\n1,"a,b",2024-01-01 10:00:00,1.5,true\n\n2,"q""r",,2,false\n')
    put(tmp_path, "b.csv", "\n  \nid;name;at;x;ok\n3;São;2024-01-02 00:00:00;;true\n".encode("latin-1"))
    put(tmp_path, "c.csv", "id\tname\tat\tx\tok\n4\t€\t\t7\t\n".encode("windows-1252"))
    put(tmp_path, "d.csv", "id|name|at|x|ok\n5|a;b||8|\n".encode("utf-8-sig"))
    df = tables.scan_csv_detected(spark, str(tmp_path))
    assert df.dtypes == [("id", "int"), ("name", "string"), ("at", "timestamp"), ("x", "double"), ("ok", "boolean")]
    assert {r["id"]: (r["name"], r["x"], r["ok"]) for r in df.collect()} == {
        1: ("a,b", 1.5, True), 2: ('q"r', 2.0, False), 3: ("São", None, True), 4: ("€", 7.0, None), 5: ("a;b", 8.0, None)}
    # however many files there are, their names stay out of the plan
    assert "a.csv" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_encodings_are_found_without_sorting_the_lines(spark, tmp_path):
    put(tmp_path, "a.csv", "\n")
    put(tmp_path, "b.csv", b"\xff")
    put(tmp_path, "c.csv", b"\x00a\x00\n")
    found = detect.detect_encoding(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert {r["file"].rsplit("/", 1)[1]: r["encoding"] for r in found.collect()} == {"a.csv": "utf-8", "b.csv": "iso-8859-1", "c.csv": "utf-16be"}


def test_a_file_per_text_but_not_a_folder(spark, frame, tmp_path):
    path = f"{tmp_path}/texts"
    sinks.write_texts(frame([(i, f"é {i}") for i in range(300)] + [(7, "twice"), (400, None), (401, " ")], "doc_id long, text string"), path, "doc_id", "text")
    files = list((tmp_path / "texts").glob("*/*"))
    assert len(files) == 302 and len({f.parent for f in files}) == 1
    found = {r["filename"]: (r["size"], r["text"]) for r in documents.scan_text_documents(spark, path).collect()}
    assert len(found) == 300 and found["doc_id=12.txt"] == (6, "é 12\n")
    assert sorted(found["doc_id=7.txt"][1].splitlines()) == ["twice", "é 7"]


def test_files_of_one_encoding_lie_on_disk_at_a_time(spark, frame, tmp_path, monkeypatch):
    frame([(i, f"a text {i}", "en" if i % 2 else None) for i in range(20)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, found = [], detect.detect_encoding

    def watched(spark, path, suffix=None):
        own = os.path.dirname(path) if "encodings-" in os.path.basename(os.path.dirname(path)) else path
        seen.append((own, os.listdir(own.removeprefix("file:"))))
        return found(spark, path, suffix)

    monkeypatch.setattr(detect, "detect_encoding", watched)
    rows = sources.detect_encoding(spark, str(tmp_path)).collect()
    kinds = {"utf": "utf-8", "latin": "iso-8859-1", "windows": "windows-1252", "marked16": "utf-16be", "little16": "utf-16le", "marked": "utf-8"}
    assert sorted((r["folder"], r["lang"], r["encoding"]) for r in rows) == sorted((k, lang, e) for k, e in kinds.items() for lang in ("en", "__HIVE_DEFAULT_PARTITION__"))
    assert {len(names) for _, names in seen} == {1} and sorted(names[0] for _, names in seen) == sorted(kinds)
    assert os.listdir(seen[0][0].removeprefix("file:")) == []


def test_files_are_listed_by_tasks_as_spark_lists_them(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    for name in ("a.txt", "b.MD", "_hidden.txt", "_k=1.txt", ".dot.txt", "c.txt.gz", "d é%20.txt", "e.txt~", "doc_id=1.txt", "f.txt._COPYING_"):
        for folder in ("", "in/deep", "_gone", "k=1"):
            (tmp_path / "docs" / folder).mkdir(parents=True, exist_ok=True)
            (tmp_path / "docs" / folder / name).write_bytes(b"" if name == "b.MD" else f"{folder} é {name}".encode("latin-1" if folder else "utf-8"))
    (tmp_path / "docs" / "nothing.txt").symlink_to(tmp_path / "absent")
    (tmp_path / "docs" / "linked.txt").symlink_to(tmp_path / "docs" / "a.txt")
    by_spark = {tuple(r) for r in documents.scan_text_documents(spark, f"{tmp_path}/doc[s]").collect()}
    loaded, load = [], DataFrameReader.load
    monkeypatch.setattr(DataFrameReader, "load", lambda self, *a, **k: loaded.append(a) or load(self, *a, **k))
    for path in (f"{tmp_path}/docs", f"file:{tmp_path}/docs/", f"file://{tmp_path}/docs"):
        found = documents.scan_text_documents(spark, path).collect()
        assert {tuple(r) for r in found} == by_spark and len(found) == len(by_spark) > 12
    assert not loaded
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        documents.scan_text_documents(spark, f"{tmp_path}/absent").collect()


def test_a_folder_without_texts(spark, tmp_path):
    assert documents.scan_text_documents(spark, str(tmp_path)).collect() == []
    (tmp_path / "deep" / "deeper").mkdir(parents=True)
    assert documents.scan_text_documents(spark, str(tmp_path)).collect() == []
