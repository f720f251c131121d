"""Trees listed by tasks: one for each folder, empty files kept."""

from reportlake.sources import files as S
from reportlake.sources import tree as T


def test_listing_and_reports(spark, tmp_path):
    files = {
        "p10/p1001/s1.txt": b"one\r\ntwo", "p10/p1002/s2.txt": b"", "p11/p1100/s 3.txt": "é {x}".encode(), "p11/p1100/note.txt": b"no report",
        "p11/s4.txt": b"too high", "other/p1/s5.txt": b"not in the tree", "s6.txt": b"in the root", "p12/p1/deep/s7.txt": b"too deep",
    }
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    (tmp_path / "p13").mkdir()
    for root in (str(tmp_path), f"file://{tmp_path}"):
        listed = T.tree_listing(spark, root, "p??", "s*.txt")
        rows = {r.path.split(str(tmp_path) + "/")[1]: r for r in listed.collect()}
        assert set(rows) == {n for n in files if n.startswith(("p1", "s")) and n.rsplit("/")[-1].startswith("s")}
        assert all(rows[n].length == len(files[n]) and rows[n].modified is not None for n in rows)
        # p10 to p13 and the root itself
        assert listed.rdd.getNumPartitions() == 5
        reports = {r.study: r.text for r in T.reports(spark, root).collect()}
        assert reports == {"s1": "one\ntwo", "s2": "", "s 3": "é {x}"}
    # the same files as the driver's own listing finds, and the empty one, which file sources skip
    mine = {r.path for r in T.tree_listing(spark, str(tmp_path)).collect()}
    theirs = {r.path for r in S.files(spark, str(tmp_path), content=False).collect()}
    assert {p.rsplit("/", 1)[-1] for p in mine ^ theirs} == {"s2.txt"} and theirs < mine
    assert [r.path.rsplit("/", 1)[-1] for r in S.first_files(T.tree_listing(spark, str(tmp_path), "p??", "s*.txt"), 2).collect()] == ["s1.txt", "s2.txt"]
    assert T.tree_listing(spark, str(tmp_path / "p13")).count() == 0


def test_visible_files_are_those_of_spark(spark, tmp_path):
    names = ["a.txt", "b{1}.txt", "c%20+[x].csv", ".hidden.txt", "_made.txt", "e.bin", "sub/f.txt", "sub/_tmp/g.txt", "sub/_k=1/h.txt", ".x/i.txt", "k=2/j.txt", "y._COPYING_", "flat/k.txt", "flat/x/l.txt"]
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(b"" if name == "a.txt" else b"body")
    (tmp_path / "a2.txt").write_bytes(b"x")
    for glob in ("*", "*.txt", "*.{txt,csv}", "[a-b]*", "[^a-b]*", "?.bin", "b\\{1*"):
        for root in (str(tmp_path), f"file://{tmp_path}/"):
            mine = T.visible_files(spark, root, glob).select("path", "length")
            assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, S.files(spark, root, glob, content=False).collect())), glob
    mine = T.visible_files(spark, f"{tmp_path}/flat", recursive=False).select("path", "length")
    assert list(map(tuple, mine.collect())) == list(map(tuple, S.files(spark, f"{tmp_path}/flat", recursive=False, content=False).collect()))
