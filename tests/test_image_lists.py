"""Lists of image files: bounded, content-free, and without the finished ones."""

from pyspark.sql import functions as F

from reportlake.operators import images as I
from reportlake.workloads.pixels import image_folder


def test_lists_are_bounded_and_whole(spark):
    sizes = [(f"f{i}", n) for i, n in enumerate([10] * 40 + [700, 900, 5000] + [0] * 30)]
    found = spark.createDataFrame(sizes, "path string, length long")
    lists = I.planned_lists(found, most_files=8, most_bytes=1000).collect()
    assert sorted((r.path, r.length) for r in lists) == sorted(sizes)
    for number in {r.list for r in lists}:
        mine = [r.length for r in lists if r.list == number]
        assert len(mine) <= 8 and sum(mine) - max(mine) < 1000
    assert I.planned_lists(found.limit(0)).count() == 0


def test_no_finished_file_is_opened(spark, data):
    root = image_folder(spark, data)
    listing = I.files(spark, root, content=False)
    key = F.regexp_extract("path", r"/([0-9]+)[^/]*$", 1).cast("int")
    finished = listing.filter(key % 4 == 0)
    done = {r.path for r in finished.collect()}
    opened, lists = set(), list(I.prepared_lists(spark, root, "covidx", 8, finished, most_files=200))
    for part in lists:
        opened |= {I.re.sub("^file:/+", "file:/", f) for f in part.inputFiles()}
    plain = {f.replace("%20", " ").replace("%25", "%").replace("%5B", "[").replace("%5D", "]") for f in opened}
    assert len(lists) > 1 and len(plain) == listing.count() - len(done) and not plain & done
    # folder rules and an empty folder
    assert I.wanted_files(spark, root, "chestxray14", finished).count() == listing.filter("path LIKE '%.png'").count()
    assert I.prepare_folder(spark, root, "covidx", 8, listing).count() == 0


def test_characters_of_patterns_are_names(spark, tmp_path):
    for name in ("a{b}.png", "c[d]?.png", "e*.png"):
        (tmp_path / name).write_bytes(b"no picture")
    rows = I.prepare_folder(spark, str(tmp_path), "padchest", 8).collect()
    assert sorted(r.path.rsplit("/", 1)[-1] for r in rows) == ["a{b}.png", "c[d]?.png", "e*.png"]
    assert {r.error for r in rows} == {"not an image file"}


def test_a_folder_of_many_lists_is_one_small_plan(spark, data):
    root = image_folder(spark, data)
    done = I.prepare_folder(spark, root, "covidx", 8, most_files=10)
    parts = I.prepared_lists(spark, root, "covidx", 8)
    whole = sorted(map(tuple, next(parts).collect()))
    assert sorted(map(tuple, done.collect())) == whole and next(parts, None) is None
    # a scan of what the lists wrote and two of the PNG files, not several for each of fifty lists
    assert done._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 4
