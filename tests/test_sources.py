import zipfile

import pandas as pd
import pytest

from geomill.operators import copying
from geomill.sources import files


@pytest.fixture
def tree(tmp_path):
    for name, text in {
        "a/items.level.json": '{"class":"TSStatic","__parent":"g","shapeName":"x.dae"}\n{"class":"Broken",\n{"class":"Prefab","__parent":"h","shapeName":null}\n',
        "a/script.cs": '%mat = "./art/rock.png";\n// none\n%b = "bare.dds";\nnew DecalData(road) {\n  material = "m1";\n  textureRect[0] = "0 0 1 1";\n  textureRect[1] = "1 1 2 2";\n};\nnew DecalData(lane) {\n material = "m2";\n};\n',
        "b/set.ini": "; note\n[part]\nlevel = west = coast\nlevel=east\nempty\n",
        "b/hm_heightmap.png": "x",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    return tmp_path


def test_list_files_leaves_out_skipped_names(spark, tree):
    got = {r.name: (r.ending, r.length > 0) for r in files.list_files(spark, str(tree)).collect()}
    assert set(got) == {"items.level.json", "script.cs", "set.ini"} and got["set.ini"] == (".ini", True)


def test_json_lines_keep_line_numbers(spark, tree):
    lines = files.text_lines(spark, str(tree / "a/items.level.json"))
    got = files.json_lines(lines, "class string, __parent string, shapeName string").orderBy("line_no").collect()
    assert [(r.line_no, r["class"], r.shapeName) for r in got] == [(1, "TSStatic", "x.dae"), (3, "Prefab", None)]
    left = files.without_lines(lines, spark.createDataFrame([(got[0].file, 1)], "file string, line_no int"))
    assert left.count() == lines.count() - 1


def test_scripts(spark, tree):
    lines = files.text_lines(spark, str(tree / "a/script.cs"))
    paths = [r.path for r in files.quoted_paths(lines).orderBy("line_no").limit(2).collect()]
    assert paths[0] == "art/rock.png" and paths[1].endswith("/a/bare.dds")
    assert [r.value for r in files.value_after(lines, "DecalData", "material").orderBy("line_no").collect()] == ["m1", "m2"]
    blocks = {r.name: r.properties for r in copying.script_blocks(lines, "file", "line_no", "line").collect()}
    assert blocks["road"] == {"material": ["m1"], "textureRect": ["0 0 1 1", "1 1 2 2"]} and blocks["lane"] == {"material": ["m2"]}


def test_key_values_and_logs(spark, tree):
    got = files.key_values(files.text_lines(spark, str(tree / "b/set.ini"))).collect()
    assert [(r.key, r.value) for r in got] == [("level", "east")]
    log = spark.createDataFrame([("f", 1, "Failed to load 'Art/x.png' here"), ("f", 2, "ok art/y.png"), ("f", 3, "missing texture|art/z.png")], "file string, line_no int, line string")
    there = spark.createDataFrame([("art/X.png",), ("art/y.png",)], "path string")
    assert [r.path for r in files.log_paths(log, ["failed to load", "missing texture"], there, "path").collect()] == ["Art/x.png"]
    plan = files.delete_plan(spark.createDataFrame([("ART/Y.PNG",), ("q",)], "path string"), there, "path")
    assert {(r.path, r.found) for r in plan.collect()} == {("ART/Y.PNG", True), ("q", False)}


def test_json_and_xml_objects(spark):
    text = spark.createDataFrame([("f", '{"a": {"name": "n1", "mapTo": "x"}, /* c */ "b": {"name": "n2"},}')], "file string, text string")
    assert {(r.key, r.name, r.mapTo) for r in files.object_map(text, "text", "name string, mapTo string").collect()} == {("a", "n1", "x"), ("b", "n2", None)}
    xml = spark.createDataFrame([("d", '<lib><material id="m-1" name="rock grey"><x/></material><material name="sand"/></lib>')], "file string, text string")
    assert {(r.id, r.name) for r in files.xml_materials(xml, "text").collect()} == {("m-1", "rock"), (None, "sand")}


def test_map_elements(spark):
    answer = """{"elements":[{"type":"way","id":1,"tags":{"highway":"primary"},"nodes":[1,2],"geometry":[{"lat":1,"lon":1},{"lat":2,"lon":2}]},
    {"type":"way","id":2,"tags":{"building":"yes"},"nodes":[1],"geometry":[{"lat":0,"lon":0},{"lat":0,"lon":1},{"lat":1,"lon":1},{"lat":0,"lon":0}]},
    {"type":"way","id":3,"geometry":[{"lat":0,"lon":0}]},{"type":"relation","id":4,"tags":{"type":"multipolygon"}},{"type":"node","id":5,"lat":1,"lon":1},
    {"type":"way","id":6,"tags":{"natural":"coastline"},"geometry":[{"lat":0,"lon":0},{"lat":0,"lon":1},{"lat":1,"lon":1},{"lat":0,"lon":0}]}]}"""
    got = files.osm_elements(spark.createDataFrame([(answer,)], "text string"), "text").withColumn("kind", files.geometry_type("tags", "geometry", "type")).collect()
    assert {r.id: r.kind for r in got} == {1: "line", 2: "polygon", 4: "polygon", 5: "point", 6: "line"}
    assert {r.id: r.nodes for r in got if r.type == "way"} == {1: [1, 2], 2: None, 6: None}


def test_terrain_round_trip(spark, tmp_path):
    pixels = pd.DataFrame([(x, y, 10.0, 1, False) for y in range(8) for x in range(8)], columns=["x", "y", "height", "material", "is_hole"])
    pixels.loc[(pixels.x == 1) & (pixels.y == 1), "height"] = 8.5
    pixels.loc[(pixels.x == 2) & (pixels.y == 2), "is_hole"] = True
    (tmp_path / "t.ter").write_bytes(files.encode_terrain(pixels, ["Material0", "Material1"], 512.0))
    got = files.read_terrain(spark, str(tmp_path / "t.ter"), 512.0).toPandas().sort_values(["y", "x"]).reset_index(drop=True)
    assert abs(got.height - pixels.height).max() < 0.01 and (got.is_hole == pixels.is_hole).all()
    assert (got.material == pixels.material.where(~pixels.is_hole, 0)).all()
    assert files.decode_terrain((tmp_path / "t.ter").read_bytes(), 512.0)[1] == ["Material0", "Material1"]
    with pytest.raises(ValueError):
        files.decode_terrain(b"\x08" + b"\0" * 20, 1.0)


def test_archives_points_and_writers(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("levels/a.json", "{}")
        z.writestr("levels/b.png", "p")
    assert [(r.entry, bytes(r.content)) for r in files.zip_entries(spark, str(tmp_path / "x.zip"), (".json",)).collect()] == [("levels/a.json", b"{}")]
    (tmp_path / "p.xyz").write_text("500000 5500000 12.5\nhead\n500001 5500001 13\n")
    points = files.xyz_points(spark, str(tmp_path / "p.xyz"))
    assert points.count() == 2 and files.likely_projection(points).first().epsg == 25832
    rows = spark.createDataFrame([("w", 1), ("e", 2)], "severity string, n int")
    files.write_json_lines(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    files.write_by(rows, ["severity"], str(tmp_path / "s"))
    assert {r.severity for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {"w", "e"}
