import json

import pytest
from pyspark.sql import functions as F

from gridloom.errors import GridError
from gridloom.functions import attributes as at
from gridloom.meta import SpecBuilder
from gridloom.operators import imaging as im
from gridloom.operators.hierarchy import Group

AXES = [{"name": "y", "type": "space", "unit": "micrometer"}, {"name": "x", "type": "space", "unit": "micrometer"}]


@pytest.mark.parametrize("version", ["0.4", "0.5", "0.6"])
def test_image(spark, tmp_path, version):
    image = im.MultiscaleImage.create(str(tmp_path), AXES, "img", version)
    for k in range(2):
        spec = SpecBuilder(2 if version == "0.4" else 3).with_shape(16 >> k, 16 >> k).with_dtype("uint16").with_chunks(8, 8).build()
        image.create_level(f"s{k}", spec, [{"type": "scale", "scale": [1.0 + k, 1.0 + k]}])
    image.set_omero({"channels": [{"label": "green dye", "color": "12AB34", "window": {"min": 7}}], "unknown": 1})
    again = im.open_imaging(str(tmp_path))
    assert (again.version, again.axis_names(), again.level_count(), again.open_level(1).spec.shape) == (version, ["y", "x"], 2, (8, 8))
    assert again.entry()["datasets"][0]["transforms"] == [{"type": "scale", "scale": [1.0, 1.0]}] and again.omero["channels"][0]["label"] == "green dye"
    assert again.labels() == [] and again.bioformats_layout is None
    Group.create(str(tmp_path / "labels"), {"labels": ["grains"]} if version == "0.4" else {"ome": {"labels": ["grains"]}}, 2 if version == "0.4" else 3)
    im.MultiscaleImage.create(str(tmp_path / "labels" / "grains"), AXES, version=version)
    assert again.labels() == ["grains"] and again.open_label("grains").axis_names() == ["y", "x"]
    assert [tuple(r.scale) for r in again.levels(spark).orderBy("level").collect()] == [(1.0, 1.0), (2.0, 2.0)]


@pytest.mark.parametrize("version", ["0.4", "0.5", "0.6"])
def test_plate_and_well(spark, tmp_path, version):
    plate = im.Plate.create(str(tmp_path), ["A", "B"], ["1", "2"], ["A/1", "B/2"], "harvest", version, [{"id": 0}])
    im.Well.create(str(tmp_path / "A" / "1"), [{"path": "0", "acquisition": 0}], version)
    im.MultiscaleImage.create(str(tmp_path / "A" / "1" / "0"), AXES, version=version)
    again = im.open_imaging(str(tmp_path))
    assert again.document == plate.document and again.document["name"] == "harvest"
    assert again.open_well("A/1").open_image("0").axis_names() == ["y", "x"] and again.open_well("A/1").document["images"][0]["acquisition"] == 0
    assert sorted(map(tuple, again.wells(spark).collect())) == [("A/1", "A", "1", 0, 0), ("B/2", "B", "2", 1, 1)]


def test_scene(spark, tmp_path):
    ends = {"input": "field#physical", "output": {"name": "farm"}}
    both_ways = {"type": "bijection", "forward": {"type": "affine", "path": "./warps/up"}, "inverse": {"type": "affine", "name": "down", "path": "warps/down"}}
    scene = im.Scene.create(str(tmp_path), [{"name": "farm", "axes": AXES}], [
        {"type": "scale", "name": "plain", "input": "field#physical", "output": ".#farm", "scale": [3.0, 5.0]},
        {"type": "sequence", "name": "route", **ends, "transformations": [{"type": "rotation"}, both_ways]},
        {"type": "byDimension", "input": {"path": "lost", "name": "own"}, "output": ".#farm", "transformations": [{"input_axes": ["y"], "transformation": {"type": "identity", "output": "nowhere"}}]},
        {"type": "mapAxis", **ends, "transformation": {"type": "translation", "translation": [7.0, 9.0]}},
        {"type": "unheard", "name": "odd", "transformations": [{"type": "identity"}]},
    ])
    level = SpecBuilder().with_shape(12, 20).with_dtype("uint16").with_chunks(5, 6).build()
    im.MultiscaleImage.create(str(tmp_path / "field"), AXES, "stages", "0.6").create_level("fine", level, [{"type": "scale", "scale": [1.5, 2.5]}])
    Group.create(str(tmp_path / "barn"))
    scene = im.open_imaging(str(tmp_path))
    assert scene.images() == ["field"] and scene.open_image("./field").level_count() == 1
    nodes, edges, warnings = scene.graph(spark)
    assert sorted(map(tuple, nodes.collect())) == [(".#farm", ".", "farm", ["y", "x"]), ("field#physical", "field", "physical", ["y", "x"])]
    at = "field#physical"
    want = [
        ("plain", "scale", at, ".#farm", None), ("route", "sequence", at, ".#farm", None), ("route", "rotation", None, None, None), ("route", "bijection", None, None, None),
        ("route", "affine", None, None, "warps/up"), ("down", "affine", None, None, "warps/down"), (None, "byDimension", None, ".#farm", None), (None, "identity", None, None, None),
        (None, "mapAxis", at, ".#farm", None), (None, "translation", None, None, None), ("odd", "unheard", None, None, None), ("odd", "identity", None, None, None),
    ]
    assert [tuple(r)[1:] for r in edges.orderBy("position").collect()] == want
    assert sorted(map(tuple, warnings.collect())) == [(6, "input", "lost#own"), (7, "output", "nowhere")]
    assert scene.transforms_group().handle.exists("zarr.json")
    with pytest.raises(GridError):
        im.Scene.open(str(tmp_path / "field"))


def test_references_and_paths():
    assert [im.reference(r) for r in ("a#b", {"path": "p", "name": "n"}, {"path": "", "name": "n"}, {"name": "n"}, {"path": "p"}, None)] == ["a#b", "p#n", ".#n", ".#n", "p", None]
    assert [im.normal_path(p) for p in (" ./a/b ", "/a", "a\\b", "./warps/up")] == ["a/b", "a", "a/b", "warps/up"]
    t = {"type": "affine", "affine": [[1.0]], "input": "a"}
    assert im.own_transform(im.shared_transform(t), "a") == t and im.shared_transform({"type": "scale", "scale": [1], "input": "x"}) == {"type": "scale", "scale": [1]}


def test_attribute_functions(spark):
    doc = {"crop": "rye", "rows": 17, "yield": 6.25, "ripe": False, "mixed": [8, 1.5, "oats"], "plots": [4, 9, 16], "dry": [False, False, True], "soil": {"kind": "loam"}, "tools": [{"axe": 2}, {"saw": 5}]}
    df = spark.createDataFrame([(json.dumps(doc),)], "a string")
    a = F.col("a")
    one = lambda c: df.select(c).first()[0]
    assert (one(at.get_string(a, "crop")), one(at.get_int(a, "rows")), one(at.get_int(a, "yield")), one(at.get_double(a, "rows")), one(at.get_boolean(a, "ripe"))) == ("rye", 17, 6, 17.0, False)
    assert one(at.get_float(a, "yield")) == 6.25 and one(at.get_list(a, "mixed")) == ["8", "1.5", "oats"] and one(at.get_array(a, "plots", "bigint")) == [4, 9, 16]
    assert one(at.get_array(a, "dry", "boolean")) == [False, False, True] and one(at.get_string(a, "soil.kind")) == "loam" and json.loads(one(at.get_attributes(a, "soil"))) == {"kind": "loam"}
    assert one(at.get_int(a, "none")) is None
    for bad in (at.get_int(a, "crop"), at.get_boolean(a, "rows"), at.get_array(a, "mixed", "int"), at.get_list(a, "rows"), at.get_attributes(a, "plots")):
        with pytest.raises(Exception, match="is not of type"):
            one(bad)
    changed = json.loads(one(at.set_attribute(at.delete_attribute(a, "plots"), "new", F.lit('"x"'))))
    assert changed == {k: v for k, v in doc.items() if k != "plots"} | {"new": "x"}
