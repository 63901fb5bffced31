"""Terrain files, decal files and archives as formats: round trips over many files, failures that leave nothing."""

import os
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomill.sources import files, formats


@pytest.fixture
def pixels(spark):
    own = spark.range(5 * 64).select(F.concat(F.lit("t"), F.floor(F.col("id") / 64), F.when(F.col("id") >= 128, "/deep").otherwise("")).alias("file"), (F.col("id") % 8).alias("x"), (F.floor(F.col("id") / 8) % 8).alias("y"))
    own = own.withColumn("height", (F.hash("file", "x", "y") % 2000 + 2000) / 2.0).withColumn("material", F.pmod(F.hash("x", "y"), F.lit(3)).cast("long")).withColumn("is_hole", F.col("x") == F.col("y"))
    return own.withColumn("name", F.concat(F.lit("Gräs"), "material")).repartition(7)


def test_terrain_files_go_round(spark, pixels, tmp_path):
    formats.write_terrain(pixels, f"{tmp_path}/out", 2048.0)
    there = sorted(os.path.relpath(os.path.join(d, f), tmp_path) for d, _, fs in os.walk(tmp_path) for f in fs)
    assert there == ["out/t0.ter", "out/t1.ter", "out/t2/deep.ter", "out/t3/deep.ter", "out/t4/deep.ter"]
    df = spark.read.format("terrain").option("part_rows", "24").option("max_height", "2048").load(f"{tmp_path}/out")
    assert df.rdd.getNumPartitions() == 15
    got = {(r.file.split("/out/")[1].removesuffix(".ter"), r.x, r.y): r for r in df.collect()}
    want = pixels.collect()
    assert len(got) == len(want) == 320
    for r in want:
        o = got[r.file, r.x, r.y]
        assert o.is_hole == r.is_hole and abs(o.height - min(r.height, 2048.0)) <= 2048 / 65535 and o.height <= r.height + 1e-9
        assert (o.material, o.name) == ((0, None) if r.is_hole else (r.material, r.name))
    with open(f"{tmp_path}/out/t0.ter", "rb") as f:
        frame, names = files.decode_terrain(f.read(), 2048.0)
    assert len(frame) == 64 and set(names) == {"Gräs0", "Gräs1", "Gräs2"}


def test_failed_tasks_leave_no_file(spark, pixels, tmp_path):
    with pytest.raises(Exception, match="no square"):
        formats.write_terrain(pixels.filter("NOT (file = 't1' AND x = 3)"), f"{tmp_path}/bad")
    seen = lambda folder: [os.path.basename(f) for f in formats._files(f"{tmp_path}/{folder}", ".ter")] if os.path.exists(f"{tmp_path}/{folder}") else []
    assert seen("bad") == []
    formats.write_terrain(pixels.filter("file = 't0'"), f"{tmp_path}/kept")
    with pytest.raises(Exception, match="sort by file|two tasks|no square"):
        pixels.write.format("terrain").mode("append").save(f"{tmp_path}/kept")
    assert seen("kept") == ["t0.ter"]
    formats.write_terrain(pixels.filter("file = 't1'"), f"{tmp_path}/kept", mode="append")
    assert seen("kept") == ["t0.ter", "t1.ter"]
    formats.write_terrain(pixels.filter("file = 't1'"), f"{tmp_path}/kept")
    assert seen("kept") == ["t1.ter"]


def test_archives_go_round(spark, tmp_path):
    rows = [(f"a{i % 3}", f"dir/ü{i}.txt" if i % 2 else f"x{i}.dae", bytes([i]) * i) for i in range(20)]
    df = spark.createDataFrame(rows, "file string, entry string, content binary").repartition(5)
    formats.write_archives(df, str(tmp_path / "zips"))
    got = spark.read.format("archive").load(str(tmp_path / "zips"))
    assert got.rdd.getNumPartitions() == 20
    assert sorted((os.path.basename(r.file).removesuffix(".zip"), r.entry, bytes(r.content)) for r in got.collect()) == sorted(rows)
    assert {r.entry[-4:] for r in spark.read.format("archive").option("endings", ".dae,.png").load(str(tmp_path / "zips")).collect()} == {".dae"}


def test_archive_names_of_old_code_pages(tmp_path):
    for raw, want in (("Straße".encode("cp850"), "Straße"), ("Straße".encode(), "Straße"), (b"plain", "plain")):
        info = zipfile.ZipInfo(raw.decode("cp437"))
        info.flag_bits = 0
        assert formats.entry_name(info) == want


def test_decals_are_read_in_bands(spark, tmp_path):
    rows = np.zeros(8, formats.DECAL)
    rows["name"], rows["size"], rows["rect"], rows["priority"] = [0, 1, 1, 0, 2, 0, 0, 1], np.arange(8) + 0.5, np.arange(8), 9
    rows["position"] = np.arange(24).reshape(8, 3)
    names = ["crack", "löch", "line"]
    data = b"DECL" + bytes([5]) + struct.pack("<I", 3) + b"".join(bytes([len(n.encode())]) + n.encode() for n in names) + struct.pack("<I", 8) + rows.tobytes()
    (tmp_path / "main.decals").write_bytes(data)
    formats.register(spark)
    df = spark.read.format("decals").option("part_rows", "3").load(str(tmp_path))
    got = sorted(df.collect(), key=lambda r: r.uid)
    assert df.rdd.getNumPartitions() == 3 and [r.name for r in got] == [names[i] for i in rows["name"]]
    assert [list(r.position) for r in got] == np.arange(24).reshape(8, 3).tolist() and [r["size"] for r in got] == (np.arange(8) + 0.5).tolist()
