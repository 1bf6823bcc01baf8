import json
import os
import random
from pathlib import Path

import numpy as np
import pytest

from climaspark.sources import geojson as J
from climaspark.sources import tables
from climaspark.sources import tiles as T


@pytest.fixture()
def small_blocks(spark):
    """Files are cut into blocks of about a hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    kept = {n: spark.conf.get(n, None) for n in names}

    def cut(size):
        for n, v in zip(names, (size, 1, 1), strict=True):
            spark.conf.set(n, v)

    yield cut
    for n, v in kept.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def collection(n, seed=0, indent=None):
    rng = random.Random(seed)
    nasty = ['plain', 'a "quoted" {brace}', "back\\slash }", "}{][", "é日本 🎉", "\\\"}", "", "line\nbreak"]
    features = []
    for i in range(n):
        ring = [[round(rng.uniform(-9, 9), 3), round(rng.uniform(-9, 9), 3)] for _ in range(rng.choice([3, 4, 60]))]
        geometry = rng.choice([{"type": "Polygon", "coordinates": [ring]}, {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}, {"type": "Point", "coordinates": [1, 2]}, None])
        features.append({"type": "Feature", "id": i, "properties": {"name": f"{i} {rng.choice(nasty)}", "more": {"deep": [{"x": "]}"}]}}, "geometry": geometry})
    return json.dumps({"type": "FeatureCollection", "crs": {"properties": [{"name": "{"}]}, "bbox": [0, [1]], "features": features, "after": [{"type": "other"}], "note": "end }]"}, indent=indent, ensure_ascii=bool(seed % 2)), features


def plain(features):
    def polygons(g):
        if g is None or g["type"] == "Point":
            return None
        return [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"]

    return sorted((f["properties"]["name"], repr(polygons(f["geometry"]))) for f in features)


@pytest.mark.parametrize(("size", "indent"), [(60, None), (97, 1), (400, None), (10_000_000, None)])
def test_features_of_files_in_any_blocks(spark, small_blocks, tmp_path, size, indent):
    want = []
    for i in range(2):
        text, features = collection(40 - 30 * i, seed=size + i, indent=indent)
        (tmp_path / f"{i}.json").write_text(text + "\n")
        want += features
    (tmp_path / "2.json").write_text('{"type": "FeatureCollection", "features": []}')
    small_blocks(size)
    rows = tables.shapes(spark, str(tmp_path))
    got = sorted((r["name"], repr(r["geometry"])) for r in rows.collect())
    wanted = [(n, repr(eval(g, {}) if g == "None" else [[[[float(c) for c in p] for p in ring] for ring in polygon] for polygon in json.loads(g)])) for n, g in plain(want)]
    assert got == wanted
    if size < 100:
        assert J._pieces(spark, str(tmp_path)).select("file", "block").distinct().count() > 40


def test_strings_hide_their_brackets():
    clean, inside = J.outside('}", "a\\"[": [1, "{"', True)
    assert not inside and J.rise(clean) == 1 and len(clean) == 19
    assert J.outside("no end", True) == (" " * 6, True) and J.outside('x "open {', False)[1]


def test_tiles_are_written_and_only_those_of_a_box_opened(spark, tmp_path):
    rng = np.random.default_rng(0)
    z, x0, y0 = 10, 590, 550
    a = np.round(rng.uniform(-400, 4000, (20, 40)) * 256) / 256
    cells = spark.createDataFrame([(y0 * 16 + i, x0 * 16 + j, float(a[i, j])) for i in range(20) for j in range(40)], "row int, col int, elevation double")
    root = f"file://{tmp_path}/t"
    assert T.write_tiles(cells, root, z, 16) == 2 * 3
    assert sorted(str(p.relative_to(tmp_path)) for p in Path(tmp_path).rglob("*.png"))[0] == f"t/{z}/{x0}/{y0}.png"
    n = 2**z
    box = ((x0 + 1.2) / n * 360 - 180, -13.0, (x0 + 1.7) / n * 360 - 180, -13.0)
    xs, ys = T.tile_range(box, z)
    assert list(xs) == [x0 + 1] and len(ys) == 1
    # What isn't needed isn't even an image.
    for p in Path(tmp_path).rglob("*.png"):
        if p.parent.name != str(x0 + 1):
            p.write_bytes(b"no image")
    wide = (box[0], -14.0, box[2], -12.0)
    got = {(r["row"], r["col"]): r["elevation"] for r in T.elevations(spark, root, z, wide, 16).collect()}
    want = {(y0 * 16 + i, (x0 + 1) * 16 + j): float(a[i, 16 + j]) if i < 20 else 0.0 for i in range(32) for j in range(16) if y0 + i // 16 in T.tile_range(wide, z)[1]}
    assert got == want and len(got) in (256, 512)
    assert T.read_tiles(spark, root, z, (0.0, 0.0, 1.0, 1.0)).count() == 0 and os.path.isdir(tmp_path / "t")


def test_colours_of_elevations():
    got = T.coded(np.array([[0.0, 1.5, 300.0, np.nan, -32768.0]]))
    assert got[0].tolist() == [[128, 0, 0], [128, 1, 128], [129, 44, 0], [128, 0, 0], [0, 0, 0]]
