from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from pathquery import CatalogError, QueryError
from pathquery.api import Engine
from pathquery.functions.content import encoding_of
from pathquery.functions.pinyin import matches
from pathquery.functions.text import ext_bucket, normalise_directory
from pathquery.operators import build, changes, search
from pathquery.plans import literals as L
from pathquery.plans.syntax import Term, parse
from pathquery.streaming.apply import SCHEMA, STATE, Catalogue

NOW = datetime(2026, 4, 22, 15, tzinfo=UTC)


def test_parser():
    b = parse("ext:txt readme").branches[0]
    assert b.exts == ("txt",) and b.terms == (Term("readme"),)
    assert parse("readme ext:txt").branches == parse("ext:txt readme").branches
    assert len(parse("ext:txt | ext:md").branches) == 2 and len(parse("a | ").branches) == 1
    assert parse("size:empty").branches[0].size == (0, 0)
    assert parse("size:>1mb size:<5mb").branches[0].size == (1 << 20, 5 << 20)
    assert parse("dm:>2026-04-21 x", NOW).branches[0].mtime == (1776729600, None)
    assert parse("folder: 149").branches[0].is_dir and parse("folder: 149").branches[0].terms == (Term("149"),)
    assert parse("don't | x").branches[0].terms == (Term("don't"),)
    assert parse('"a:b" !ext:txt').branches[0].negatives == ("ext:txt",)
    assert parse("d:\\work").branches[0].prefix == "\\work" and parse("d: x").branches[0].drive == "D"
    assert parse("a count:5 sort:size:desc").limit == 5


@pytest.mark.parametrize("text", ["notakey:blah", "size:x", "len:x", "da:today", "dm:never", "regex:(?=a)", "count:x", "sort:colour"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_literals():
    assert L.parse_date("yesterday", NOW) == (L.day_span("2026-04-21", UTC)[0], L.day_span("2026-04-21", UTC)[1])
    assert L.parse_date("lastmonth", NOW) == (L.day_span("2026-03", UTC))
    assert L.glob_to_regex("a*[!b]?.txt") == r"(?s)^a.*[^b].\.txt$"
    assert normalise_directory("C:/Windows/") == "c:\\windows" and normalise_directory("C:\\") is None
    assert (ext_bucket("pdf"), ext_bucket("yml"), ext_bucket("PDF")) == (21, 21, 117)
    assert encoding_of("añb".encode("utf-16-le")) == "utf-16-le" and encoding_of(b"\x00\x01" * 50) != "utf-8"


def test_pinyin(spark):
    assert matches("北京朝阳.txt", "beijing") == (0, 2) and matches("北京朝阳.txt", "bj") == (0, 2) and matches("北京朝阳.txt", "zhaoyang") == (2, 4)
    assert matches("zi串_中文.txt", "zichuan") == (0, 3) and matches("English.txt", "beijing") is None


RAW = [("C", 5, 0, "", 0, 0, 0, 16, True), ("C", 200, 5, "Windows", 0, 0, 0, 16, True), ("C", 201, 200, "System32", 0, 0, 0, 16, True), ("C", 10, 5, "vfcompat.dll", 100, 1, 1, 0, False), ("C", 11, 201, "vfcompat.dll", 200, 1, 1, 0, False), ("C", 12, 201, "A.PDF", 7, 1, 1, 0x21, False), ("C", 13, 201, "b.yml", 7, 1, 1, 0, False), ("D", 1, 0, "北京朝阳.txt", 1, 0, 0, 0, False)]


@pytest.fixture(scope="module")
def entries(spark):
    return build.stored(build.catalogue(spark.createDataFrame(RAW, build.RAW)), "test").cache()


def names(df):
    return sorted(r[0] for r in df.select("display_path").collect())


def test_catalogue_and_search(entries):
    find = lambda q, **o: names(search.hits(entries, q, **o))
    assert find("vfcompat") == ["C:\\vfcompat.dll", "C:\\windows\\system32\\vfcompat.dll"]
    assert find("ext:pdf") == ["C:\\windows\\system32\\A.PDF"] and find("attrib:ra") == find("ext:pdf")
    assert find("c:\\windows depth:2 folder:") == ["C:\\windows\\system32"] and find("parent:c:\\") == ["C:\\vfcompat.dll", "C:\\windows"]
    assert find("sizedupe:") == ["C:\\windows\\system32\\A.PDF", "C:\\windows\\system32\\b.yml"]
    assert find("beijing", pinyin=True) == ["D:\\北京朝阳.txt"] and find("beijing") == [] and find("bj;py | yml") == ["C:\\windows\\system32\\b.yml", "D:\\北京朝阳.txt"]
    page = search.search(entries, "vf compat sort:size:desc count:1").collect()
    assert [(r["size"], r.name_highlight) for r in page] == [(200, [[0, 8]])]
    e = Engine(entries)
    assert '"total": 2' in e.handle('{"type": "search", "query": "vfcompat"}') and '"error"' in e.handle('{"type": "search", "query": "x:y:"}'.replace("x:y:", "bad1:z"))


def test_save_load_exclude(entries, tmp_path):
    build.save(entries, f"file://{tmp_path}/c", ["C:/Windows/System32"])
    again, excluded = build.load(entries.sparkSession, f"file://{tmp_path}/c")
    assert again.count() == len(RAW) and build.exclude(again, excluded).filter("deleted").count() == 4


def test_cycle(spark):
    with pytest.raises(CatalogError):
        build.directory_paths(spark.createDataFrame([("C", 1, 2, "a", 0, 0, 0, 16, True), ("C", 2, 1, "b", 0, 0, 0, 16, True)], build.RAW))


def test_changes_and_stream(spark, tmp_path):
    kind = "volume string, usn long, journal_id long, op string, file_id long, parent_id long, name string, size long, mtime long, ctime long, attrs int, is_dir boolean"
    rows = [("C", 1, 1, "create", 7, 5, "a", 1, 1, 1, 0, False), ("C", 2, 1, "rename", 8, 5, "x", None, None, None, None, None), ("C", 3, 1, "modify", 7, None, None, 9, None, None, None, None), ("C", 4, 1, "delete", 7, None, None, None, None, None, None, None), ("C", 5, 1, "rename", 7, 5, "dead", None, None, None, None, None)]
    ev = spark.createDataFrame(rows, kind)
    state = spark.createDataFrame([], "volume string, file_id long, parent_id long, name string, size long, mtime long, ctime long, attrs int, is_dir boolean, deleted boolean")
    got = changes.apply_changes(state, ev).collect()
    assert [(r.file_id, r.name, r["size"], r.deleted) for r in got] == [(7, "a", 9, True)]
    c = Catalogue(f"file://{tmp_path}/s")
    c.write(state.select(STATE), spark.createDataFrame([("C", 1, 0)], "volume string, journal_id long, last_usn long"))
    ev.write.parquet(f"file://{tmp_path}/in")
    for i in range(2):  # the second pass replays the same events
        q = c.follow(spark.readStream.schema(kind).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/cp{i}")
        q.awaitTermination(120)
        assert q.exception() is None
        state, volumes = c.read(spark)
        assert [(r.file_id, r.deleted) for r in state.collect()] == [(7, True)] and volumes.first().last_usn == 5
    with pytest.raises(CatalogError):
        c.apply(ev.withColumn("journal_id", F.lit(2).cast("long")))


def test_versions_and_command_line(entries, tmp_path):
    import io
    import json

    from pathquery.__main__ import main

    spark, path = entries.sparkSession, f"file://{tmp_path}/v"
    for i in range(4):
        build.save(entries.limit(0) if i < 3 else entries, path)
        build.retire(spark, path, 2)
    assert build.versions(spark, path) == [3, 4] and len([x for x in (tmp_path / "v").iterdir() if x.name.startswith("snapshot")]) == 2
    out = io.StringIO()
    assert main([path, "search", "vfcompat", "--json"], spark, out) == 0 and {x["path"] for x in json.loads(out.getvalue())} == {"C:\\vfcompat.dll", "C:\\windows\\system32\\vfcompat.dll"}
    for args, want in ((["count", "vfcompat"], "2"), (["search", "ext:yml"], "b.yml"), (["status"], "directories"), (["watch", "ext:yml", "--interval", "0"], "b.yml")):
        out = io.StringIO()
        assert main([path, *args], spark, out, rounds=2) == 0 and want in out.getvalue() and out.getvalue().count("system32") <= 1
    assert main([path, "search", "bad1:z"], spark, out) == 2
    with pytest.raises(CatalogError):
        build.load(spark, f"file://{tmp_path}/nothing")


def test_stream_to_search(spark, tmp_path):
    """A directory that is moved takes what is below along; one that is excluded hides it; deltas are compacted."""
    kind = "volume string, usn long, journal_id long, op string, file_id long, parent_id long, name string, size long, mtime long, ctime long, attrs int, is_dir boolean"
    full = (0, 0, 0, 0)
    rows = [("C", 1, 1, "create", 3, 2, "f.txt", *full, False), ("C", 2, 1, "create", 2, 1, "B", *full, True), ("C", 3, 1, "create", 1, 0, "A", *full, True), ("C", 4, 1, "create", 9, 0, "Secret", *full, True), ("C", 5, 1, "create", 10, 9, "k.txt", *full, False), ("C", 6, 1, "rename", 2, 0, "Moved", *(None,) * 5), ("C", 7, 1, "create", 11, 9, "late.txt", *full, False), ("C", 8, 1, "rename", 3, 9, "f.txt", *(None,) * 5)]
    c = Catalogue(f"file://{tmp_path}/s", ["C:\\Secret"])
    c.COMPACT = 3
    c.write(spark.createDataFrame([], SCHEMA), spark.createDataFrame([("C", 1, 0)], "volume string, journal_id long, last_usn long"))
    seen = []
    for a, b in ((0, 5), (5, 6), (6, 8)):
        c.apply(spark.createDataFrame(rows[a:b], kind))
        e = Engine.load(spark, c.refresh(spark))
        seen.append(names(search.hits(e.entries, "")))
    assert seen == [["C:\\a", "C:\\a\\b", "C:\\a\\b\\f.txt"], ["C:\\a", "C:\\moved", "C:\\moved\\f.txt"], ["C:\\a", "C:\\moved"]]
    now = build.version(spark, c.path)
    assert now["deltas"] == [] and len(build.versions(spark, c.path)) <= c.KEEP


def test_binary_contents_and_marks(entries):
    spark = entries.sparkSession
    contents = spark.createDataFrame([("C", 10, "Hello Wörld".encode("utf-16")), ("C", 11, "hello".encode()), ("C", 12, b"\x00\x01hello" * 40), ("C", 13, None)], "volume string, file_id long, content binary")
    assert names(search.hits(entries, "content:HELLO", contents)) == ["C:\\vfcompat.dll", "C:\\windows\\system32\\vfcompat.dll"]
    marks = lambda q, **o: [r.name_highlight for r in search.search(entries, q, **o).collect()]
    assert marks("regex:^b\\.y") == [[[0, 3]]] and marks("bj", pinyin=True) == [[[0, 2]]]
    assert search.sort_of(6) == "size:d" and search.sort_of(8) == "name:d" and search.sort_of(99) == "name"


def test_client_requests(entries):
    ids = lambda *a, **o: [r.name for r in search.client_search(entries, *a, **o).collect()]
    assert ids("") == [] and ids("  ", 1) == []
    assert search.sort_of(0) == "name" and search.sort_of(14) == "modified:d"
    # the request's order wins over that of any branch; an open quote is a character
    assert ids('vfcompat "') == []
    up, down = ids("vfcompat sort:size | ext:yml", 0, 1), ids("vfcompat sort:size | ext:yml", 0, 2)
    assert sorted(up) == up and down == up[::-1] and len(up) == 3
    assert ids("^b\\.y", 1) == ["b.yml"] and ids("B.YML", 2) == [] and ids("yml", 4) == ["b.yml"]
    assert ids("", 0, 1, search.CLIENT_HITS, 10) == [] and ids("vfcompat", 0, 1, 1, 10) == ids("vfcompat")[1:]
    page = search.search(entries, "vfcompat")
    assert search.resorted(page, "path", True).first().path > search.resorted(page, "path").first().path
    assert {r.extension for r in search.form_rows(page).collect()} == {"dll"}


def test_volumes(spark, tmp_path):
    import json

    from pathquery.operators import volumes as V

    assert V.volume_list() == ["C:"] and V.volume_list(found=["E:", "D:"]) == ["D:", "E:"] and V.volume_list("X:", []) == ["X:"] and V.volume_list("X:") == ["X:"] and V.volume_list("X:", ["D:"]) == ["D:"]
    raw = lambda v, n: spark.createDataFrame([(v, i, 0, f"f{i}", 1, 0, 0, 0, False) for i in range(1, n + 1)], build.RAW)
    path = f"file://{tmp_path}/v"
    V.index_volumes(spark, lambda v: raw(v, 3), ["C", "D"], path)
    assert Engine.load(spark, path).count("") == 6 and not (tmp_path / "v" / "indexing.json").exists()

    def broken(v):
        if v == "D":
            raise OSError("not ready")
        return raw(v, 5)

    with pytest.raises(CatalogError, match="volume D"):
        V.index_volumes(spark, broken, ["C", "D"], path, threads=1)
    state = json.loads((tmp_path / "v" / "indexing.json").read_text())
    assert state["phase"] == "failed" and state["volumes_completed"] == 1 and state["entries_indexed"] == 5
    assert Engine.load(spark, path).count("") == 6
    links = raw("C", 2).withColumn("is_dir", F.lit(True)).withColumn("attrs", F.when(F.col("file_id") == 1, 0x410).otherwise(0x10))
    assert [r.file_id for r in V.reparse_directories(links).collect()] == [1]
    assert V.supplemented(raw("C", 2), raw("C", 4).union(raw("C", 4))).count() == 4
    assert [r.file_id for r in build.orphans(raw("C", 2).withColumn("parent_id", F.col("file_id") - 1)).collect()] == [2]
    assert build.deleted_share(build.catalogue(raw("C", 4), ["C:\\f1"])).first()[0] == 0.25


def test_journal_events(spark):
    """A file that comes from an unknown place is made by the new name of its rename; one that can't be read any more isn't."""
    from pathquery.operators import changes

    rows = [("C", 1, i, f, 0, n, r, 0, False) for i, f, n, r in ((1, 1, "old", 0x1000), (2, 1, "new", 0x2000), (3, 2, "gone", 0x100), (4, 1, "new", 0x2), (5, 3, "x", 0x1), (6, 4, "known", 0x4))]
    records = spark.createDataFrame(rows, "volume string, journal_id long, usn long, file_id long, parent_id long, name string, reason long, attrs int, is_dir boolean")
    read = spark.createDataFrame([("C", 1, 7, 8, 9)], "volume string, file_id long, size long, mtime long, ctime long")
    state = spark.createDataFrame([("C", 4, 0, "known", 5, 5, 5, 0, False, False)], SCHEMA)
    ev = changes.events(records, read)
    assert sorted((r.usn, r.op) for r in ev.collect()) == [(1, "rename"), (2, "create"), (4, "modify"), (6, "modify")]
    got = {r.file_id: (r.name, r["size"], r.mtime) for r in changes.apply_changes(state, ev).collect()}
    assert got == {1: ("new", 7, 8), 4: ("known", 5, 5)}
