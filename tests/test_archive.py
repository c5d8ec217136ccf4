import glob
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from packloom.sources import archive


def rows(spark, n=40):
    r = spark.range(n).select((F.col("id") % 4).cast("string").alias("package"), F.concat(F.lit("d/m"), F.lpad(F.col("id").cast("string"), 3, "0"), F.when(F.col("id") % 3 == 0, "_d2l.xml").otherwise(".html")).alias("path"), F.encode(F.concat(F.lit("é"), F.repeat(F.col("id").cast("string"), 500)), "UTF-8").alias("content"))
    return r


def plain(df):
    return sorted((r.package, r.path, bytes(r.content)) for r in df.collect())


@pytest.mark.parametrize("size", [archive.PARTITION_BYTES, 50])
def test_round_trip(spark, tmp_path, size):
    want = rows(spark)
    archive.write_archives(want, str(tmp_path / "z"))
    assert sorted(os.listdir(tmp_path / "z")) == [f"{i}.zip" for i in range(4)]
    got = archive.read_archives(spark, f"file:{tmp_path}/z", partition_bytes=size)
    assert plain(got) == plain(want)
    assert (got.rdd.getNumPartitions() > 8) == (size == 50)
    with zipfile.ZipFile(tmp_path / "z/1.zip") as z:
        assert z.testzip() is None and z.namelist() == sorted(z.namelist())


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(200):
            z.writestr(f"m{i}", os.urandom(2000), zipfile.ZIP_STORED if i % 2 else zipfile.ZIP_DEFLATED)
        z.writestr("folder/", "")
    got = archive.read_archives(spark, str(tmp_path / "a.zip"), partition_bytes=20_000)
    tasks = got.select(F.spark_partition_id().alias("p"), "path").groupBy("p").count().collect()
    assert len(tasks) >= 20 and sum(r["count"] for r in tasks) == 200


def test_only_what_is_asked_for_is_inflated(spark, tmp_path):
    archive.write_archives(rows(spark), str(tmp_path))
    for f in glob.glob(f"{tmp_path}/*.zip"):  # break every member but the payloads
        with zipfile.ZipFile(f) as z:
            places = [i.header_offset for i in z.infolist() if not i.filename.endswith("_d2l.xml")]
        data = bytearray(open(f, "rb").read())
        for p in places:
            data[p : p + 4] = b"XXXX"
        open(f, "wb").write(data)
    want = plain(rows(spark).where(F.col("path").endswith("_d2l.xml")))
    for size in (archive.PARTITION_BYTES, 100):
        assert plain(archive.read_archives(spark, str(tmp_path), "*_d2l.xml", partition_bytes=size)) == want
        some = archive.read_archives(spark, str(tmp_path), "d/*3_d2l.xml", "[03]", size)
        assert [r[1] for r in plain(some)] == ["d/m003_d2l.xml"]
        with pytest.raises(Exception, match="no member"):
            archive.read_archives(spark, str(tmp_path), partition_bytes=size).count()
    assert archive.read_archives(spark, str(tmp_path), listing=True).where("path LIKE '%0.html' AND size > 0").count() == 2


def test_commit_and_abort(spark, tmp_path):
    path = str(tmp_path / "z")
    archive.write_archives(rows(spark, 4), path)
    with pytest.raises(Exception, match="there already"):
        archive.write_archives(rows(spark, 1), path, overwrite=False)
    before = plain(archive.read_archives(spark, path))
    with pytest.raises(Exception, match="no name"):
        archive.write_archives(rows(spark, 8).withColumn("package", F.when(F.col("package") == "2", "a/b").otherwise(F.col("package"))), path)
    assert plain(archive.read_archives(spark, path)) == before and not glob.glob(f"{path}/_temporary*")
    with pytest.raises(Exception, match="more than one task"):
        rows(spark, 40).repartition(4).sortWithinPartitions("package").write.format(archive.NAME).mode("append").save(str(tmp_path / "y"))
    with pytest.raises(Exception, match="stand together"):
        rows(spark, 40).coalesce(1).write.format(archive.NAME).mode("append").save(str(tmp_path / "y"))
    archive.write_archives(rows(spark, 2), path)
    assert sorted(os.listdir(path)) == ["0.zip", "1.zip"]


def test_edges(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    assert archive.read_archives(spark, str(tmp_path / "none")).count() == 0
    archive.write_archives(spark.createDataFrame([("a", "x", None), ("a", "x", b"2")], "package string, path string, content binary"), str(tmp_path / "z"))
    assert plain(archive.read_archives(spark, str(tmp_path / "z"))) == [("a", "x", b""), ("a", "x", b"2")]
    archive.write_archives(rows(spark).limit(0), str(tmp_path / "e"))
    assert glob.glob(f"{tmp_path}/e/*.zip") == []
    (tmp_path / "z/b.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="no archive"):
        archive.read_archives(spark, str(tmp_path / "z")).count()
