import os
import time
import zipfile

import pytest

from tessera.operators import export
from tessera.plans import archived
from tessera.sources import archives, driver_tables, files, workspace


def exchanges(df):
    """The exchanges of the plan, as text."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line]


def test_files_of_a_folder_in_order(spark, tmp_path):
    want = {}
    for k in range(1, 60):
        folder = tmp_path / f"d{k % 7}"
        folder.mkdir(exist_ok=True)
        (folder / f"f {k:03d}").write_bytes(b"x" * k)
        want[str(folder / f"f {k:03d}")] = k
    found = files.scan(spark, str(tmp_path))
    assert not any("content" in e for e in exchanges(found))
    got = sorted((r.file_seq, "/" + r.path.removeprefix("file:").lstrip("/"), len(r.content)) for r in found.collect())
    assert got == [(i, p, want[p]) for i, p in enumerate(sorted(want))]
    paths = sorted(want, key=lambda p: -want[p])
    assert [(r.path, len(r.content)) for r in files.scan(spark, paths).orderBy("file_seq").collect()] == [(p, want[p]) for p in paths]


def test_numbers_over_many_ranges(spark):
    rows = spark.range(5000).selectExpr("hash(id) AS h", "id").repartition(7)
    got = files.numbered(rows, "h", "id").orderBy("file_seq").collect()
    assert [r.file_seq for r in got] == list(range(5000)) and [(r.h, r.id) for r in got] == sorted((r.h, r.id) for r in got)
    assert files.numbered(rows.limit(0), "h").count() == 0


def pack(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, content in members:
            z.writestr(name, content)


def read(spark, paths):
    found = archives.unzipped(files.named(spark, [str(p) for p in paths]))
    assert not any("content" in e for e in exchanges(found))
    return [(r.file_seq, r.path, bytes(r.content)) for r in found.orderBy("file_seq").collect()]


def test_archives_are_read_by_groups_of_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "GROUP_BYTES", 1000)
    first = [("a/", b""), *[(f"a/m{k}", os.urandom(300) + b"y" * k) for k in range(20)]]
    pack(tmp_path / "one.zip", first)
    pack(tmp_path / "two.ZIP", [("z", b"stored"), ("e", b"")], zipfile.ZIP_STORED)
    pack(tmp_path / "none.zip", [])
    want = [(n.rsplit("/", 1)[-1], c) for n, c in first[1:]] + [("z", b"stored"), ("e", b"")]
    got = read(spark, [tmp_path / "one.zip", tmp_path / "none.zip", tmp_path / "two.ZIP"])
    assert got == [(i, *w) for i, w in enumerate(want)]
    assert read(spark, [tmp_path / "none.zip"]) == []


def test_an_archive_beyond_the_size_of_a_value(spark, tmp_path):
    """Two members with 5 GB of nothing between them (a file with a hole), so places need ZIP64."""
    path = tmp_path / "large.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("first", b"before " * 100)
        z.start_dir = 5_000_000_000
        z.writestr("folder/second", b"after " * 100)
    assert path.stat().st_size > 5_000_000_000
    assert read(spark, [path]) == [(0, "first", b"before " * 100), (1, "second", b"after " * 100)]


def test_broken_archives_raise(spark, tmp_path):
    pack(tmp_path / "bad.zip", [("m", b"some content that will be changed")], zipfile.ZIP_STORED)
    data = bytearray((tmp_path / "bad.zip").read_bytes())
    data[35] ^= 1
    (tmp_path / "bad.zip").write_bytes(bytes(data))
    (tmp_path / "no.zip").write_bytes(b"no archive")
    for name, why in (("bad.zip", "broken"), ("no.zip", "not a zip file")):
        with pytest.raises(Exception, match=why):
            read(spark, [tmp_path / name])


def test_archives_are_written_as_files(spark, tmp_path):
    rows = [(f"s{k % 3}.zip", f"d/{k:02d}", bytes([k]) * k) for k in range(30)]
    done = archives.write_archives(spark.createDataFrame(rows, "archive string, path string, content binary").repartition(5), f"file://{tmp_path}/out").collect()
    assert sorted((r.archive, r.members) for r in done) == [("s0.zip", 10), ("s1.zip", 10), ("s2.zip", 10)]
    assert sorted(os.listdir(tmp_path / "out")) == ["s0.zip", "s1.zip", "s2.zip"]
    for r in done:
        with zipfile.ZipFile(tmp_path / "out" / r.archive) as z:
            assert z.testzip() is None and (tmp_path / "out" / r.archive).stat().st_size == r.bytes
            assert [(n, z.read(n)) for n in z.namelist()] == [(p, c) for a, p, c in rows if a == r.archive]


def test_groups_not_members_are_numbered(spark, tmp_path, monkeypatch):
    """A row stands for a part of a directory; bytes before an archive, folders between members, archives of several chunks and names in UTF-8."""
    monkeypatch.setattr(archives, "GROUP_BYTES", 1500)
    monkeypatch.setattr(archives, "CHUNK", 2)
    want = []
    for k in range(5):
        members = [(f"f{k}/", b""), *[(f"f{k}/{'ä' if m % 2 else 'a'}{m}", bytes([m]) * (m + k)) for m in range(40)]]
        pack(tmp_path / f"{k}.zip", members)
        (tmp_path / f"{k}.zip").write_bytes(b"before" * k + (tmp_path / f"{k}.zip").read_bytes())
        want += [(n.rsplit("/", 1)[-1], c) for n, c in members[1:]]
    paths = [tmp_path / f"{k}.zip" for k in range(5)]
    groups = archives.grouped(files.named(spark, [str(p) for p in paths])).collect()
    assert 5 < len(groups) < 20 and sum(g.members for g in groups) == 200
    assert read(spark, paths) == [(i, *w) for i, w in enumerate(want)]


def test_small_members_are_packed_with_small_tables(tmp_path):
    members = [(f"study/series/{k:06d}", b'{"series_uid": "%d", "number": %d}' % (k, k) * 4) for k in range(70_000)]
    own, plain, took = archives.Writer(open(tmp_path / "own.zip", "wb")), zipfile.ZipFile(tmp_path / "plain.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=6), []
    for put, some in ((plain.writestr, members[:20_000]), (own.add, members)):
        begin = time.perf_counter()
        for name, content in some:
            put(name, content)
        took.append((time.perf_counter() - begin) / len(some))
    plain.close()
    assert took[1] < took[0] / 2
    assert own.close() == (tmp_path / "own.zip").stat().st_size
    with zipfile.ZipFile(tmp_path / "own.zip") as z:  # more members than an end without ZIP64 can tell
        assert z.testzip() is None and z.namelist() == [n for n, _ in members] and z.read(members[-1][0]) == members[-1][1]


def test_members_beyond_four_gigabytes_are_written(spark, tmp_path):
    """At places that need ZIP64, in a file with a hole."""
    path, content = tmp_path / "far.zip", os.urandom(9000) * 2
    writer = archives.Writer(open(path, "wb"))
    writer.add("first", b"x" * 100)
    writer.stream.write(b"".join(writer.held))
    writer.held, writer.size, writer.at = [], 0, writer.stream.seek(5_000_000_000)
    writer.add("f/ö", content)
    assert writer.close() == path.stat().st_size > 5_000_000_000
    with zipfile.ZipFile(path) as z:
        assert z.namelist() == ["first", "f/ö"] and z.read("f/ö") == content
    assert read(spark, [path]) == [(0, "first", b"x" * 100), (1, "ö", content)]


def test_an_export_in_rounds_leaves_no_archives(spark, data, tmp_path, monkeypatch):
    """Written, read and deleted round by round: at no time do all archives lie in the folder, and at the end none does."""
    seen, write = [], archived.archives.write_archives
    monkeypatch.setattr(archived.archives, "write_archives", lambda members, folder: seen.append(sum(n.endswith(".zip") for _, _, names in os.walk(tmp_path) for n in names)) or write(members, folder))
    monkeypatch.setattr(archived, "ROUND_LINES", 2500)
    monkeypatch.setattr(workspace, "_within", f"file://{tmp_path}")
    found = archived.export_round_trip(spark, data)
    items = spark.read.parquet(f"{data}/lineitem.parquet")
    series = items.select("l_orderkey", "l_suppkey").distinct().count()
    assert found.count() == items.count() + 2 * series + spark.read.parquet(f"{data}/orders.parquet").count()
    assert seen == [0, 0, 0] and not any(n.endswith(".zip") for _, _, names in os.walk(tmp_path) for n in names)
    assert spark.conf.get(workspace.CLEANED, None) is None


def test_members_of_an_export_meet_where_they_are_dealt(spark, data):
    """Only the deals by the order's number shuffle, and the result is that of joins."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        catalog = driver_tables.exported(spark, data)
        found = export.entries(**catalog, by="number")
        dealt = [e for e in exchanges(found) if "orderkey" in e or "number" in e or "uid" in e]
        assert dealt and all("REPARTITION_BY_NUM" in e for e in dealt)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = export.entries(**{k: t.drop("number") for k, t in catalog.items()})
    assert found.count() == plain.count() and found.exceptAll(plain).count() == 0
