"""Readers and writers of level files on small trees."""

import json

from pyspark.sql import functions as F

from geomill.sources import levels


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_prefabs_reach_one_step(spark):
    texts = spark.createDataFrame(
        [
            ("/l/a.prefab", 'shapeName = "./tree.dae";\nmaterial = "mud";\nfilename = "levels/x/b.json";\n'),
            ("/l/x/b.json", '{"class":"TSStatic","shapeName":"art/b.dae"}\n{"class":"Prefab","filename":"levels/x/c.json"}\n'),
            ("/l/x/c.json", '{"shapeName":"deep.dae"}'),
            ("/l/bare.prefab", None),
        ],
        "file string, text string",
    )
    got = levels.prefab_assets(texts, spark.createDataFrame([("/l/a.prefab",), ("/l/none",)], "file string"), "/l")
    shapes = {(r.kind, r.value) for r in got.collect()}
    assert ("shape", "/l/tree.dae") in shapes and ("decal", "mud") in shapes and "deep.dae" not in {v for _, v in shapes}


def test_descriptors_and_level_information(spark):
    texts = spark.createDataFrame([("t.json", '{"materials":["a","b","a"],"datafile":"x/t.ter"}'), ("bad", "{"), ("none", None)], "file string, text string")
    materials, paths = levels.terrain_descriptors(texts, "/l")
    assert rows(materials) == [("t.json", "a"), ("t.json", "b")] and [r.path.endswith("x/t.ter") for r in paths.collect()] == [True]
    info = spark.createDataFrame([("i", '{"previews":["p.png"],"spawnPoints":[{"preview":"s.png"},{}],"minimap":[{"file":"m.png"}]}')], "file string, text string")
    assert sorted(r.kind for r in levels.level_files(info, "/l").collect()) == ["minimap", "preview", "spawn"]


def test_hierarchy_of_any_depth(spark):
    deep = {"class": "C0", "name": "n0"}
    for i in range(1, 300):
        deep = {"class": f"C{i}", "childs": [deep], **({"name": f"n{i}"} if i % 2 else {})}
    got = levels.hierarchy(spark.createDataFrame([("a", json.dumps(deep)), ("b", "{"), ("c", None)], "file string, text string")).orderBy("place").collect()
    assert len(got) == 300 and got[0]["class"] == "C299" and got[0].parent is None
    assert [r.parent for r in got[1:4]] == ["n299", "n299", "n297"]


def test_decals_by_name(spark):
    names = spark.createDataFrame([(0, "a"), (1, "b")], "name_index int, name string")
    cols = ["uid", "name_index", "rect", "size", "priority", "px", "py", "pz", "nx", "ny", "nz", "tx", "ty", "tz"]
    data = [(u, u % 2, *[float(u + i) for i in range(12)]) for u in (3, 0, 1, 2)]
    got = {r.name: r.instances for r in levels.decal_groups(names, spark.createDataFrame(data, cols)).collect()}
    assert [v[12] for v in got["a"]] == [0.0, 2.0] and [v[12] for v in got["b"]] == [1.0, 3.0] and len(got["a"][0]) == 13


def test_texture_sizes_and_paths(spark):
    texts = spark.createDataFrame([("m", '{"x":{"class":"Other"},"s":{"class":"TerrainMaterialTextureSet","baseTexSize":[1024,1024],"detailTexSize":[512,512]}}')], "file string, text string")
    assert rows(levels.texture_sizes(texts)) == [("m", 1024, 512, None)]
    docs = spark.createDataFrame([(1, '{"a":"old","old":["old",{"b":"older"}],"n":1}'), (2, None), (3, '"old"')], "k int, j string")
    got = {r.k: r.j and json.loads(r.j) for r in levels.replaced_strings(docs, "j", {"old": "new"}).collect()}
    assert got == {1: {"a": "new", "old": ["new", {"b": "older"}], "n": 1}, 2: None, 3: "new"}


def test_writers(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 2, 5.0), (1, 1, 4.0), (2, 1, 9.0)], "s int, i int, x double")
    docs = {r.s: json.loads(r.document) for r in levels.spline_documents(nodes, "s", "i", ["x"]).collect()}
    assert docs[1] == {"id": 1, "nodes": [{"x": 4.0}, {"x": 5.0}]}
    item = json.loads(levels.scene_items(spark.createDataFrame([("h", 1, 2, 3)], "name string, x int, y int, z int"), "art/").first().line)
    assert item["shapeName"] == "art/h.dae" and item["position"] == [1.0, 2.0, 3.0]
    features = spark.createDataFrame([("k1", 0.0, 1.0, 7), ("k1", 0.0, 1.0, 8), ("k2", 2.0, 3.0, 9)], "k string, lo double, hi double, id int")
    levels.write_cache(features, "k", ["lo", "hi"], str(tmp_path / "c"))
    index = levels.write_cache(features.filter("k = 'k2'").withColumn("id", F.lit(5)), "k", ["lo", "hi"], str(tmp_path / "c"))
    assert sorted((r.k, r.n) for r in index.collect()) == [("k1", 2), ("k2", 1)]
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "c" / "features")).collect()) == [5, 7, 8]
    pixels = spark.createDataFrame([("road", x, 0, 255) for x in (1, 2, 3, 7)], "layer string, x int, y int, alpha int")
    levels.write_layers(pixels, ["layer"], str(tmp_path / "l"))
    assert sorted((r.x0, r.x1) for r in spark.read.parquet(str(tmp_path / "l")).collect()) == [(1, 3), (7, 7)]
