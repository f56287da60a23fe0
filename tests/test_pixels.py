import struct
import zlib

import numpy as np
import pytest

from kindred.functions import pixels as P
from kindred.operators import extract
from kindred.operators.space import FeatureSpace
from kindred.sources import files


def plain(color, n=32):
    return np.full((n, n, 3), color, np.uint8)


def png(rgb):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    lines = b"".join(b"\0" + r.tobytes() for r in rgb)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_hsv():
    assert P.hsv(plain((255, 0, 0)))[0, 0].tolist() == [0, 255, 255]
    assert P.hsv(plain((0, 255, 0)))[0, 0].tolist() == [60, 255, 255]
    assert P.hsv(plain((7, 7, 7)))[0, 0].tolist() == [0, 0, 7]


def test_color():
    full = np.ones((32, 32), bool)
    v = P.color(plain((200, 30, 40)), full)
    assert len(v) == 369 == sum(n for _, n in P.COLOR)
    assert v[:72].max() == 1 and v[:72].sum() == 1 and v[72:216].sum() == 9 and v[-6:-3].max() < 1e-9
    half = plain((255, 0, 0))
    half[:, 16:] = (0, 0, 255)
    grid = P.grid_histogram(P.hsv(half), full).reshape(9, 16)
    assert (grid[0] != grid[2]).any() and (grid[0] == grid[3]).all()
    assert P.color(plain((1, 2, 3)), np.zeros((32, 32), bool))[:72].sum() == 0


def test_shape():
    m = np.zeros((64, 64), bool)
    m[16:48, 24:40] = True
    r = P.region_measures(m)
    assert r[:4] == pytest.approx([512 / 4096, 2, 1, 1]) and r[8:] == pytest.approx([0, 0])
    assert P.width_profile(m).tolist() == [1] * 16
    assert len(P.shape(plain(0, 64), m)) == 113
    assert np.allclose(P.hu_moments(m)[0], P.hu_moments(m.T)[0])
    assert P.shape(plain(0, 64), np.zeros((64, 64), bool))[:10].tolist() == [0] * 10
    assert P.bounding_box(np.zeros((5, 6), bool)) == (0, 5, 0, 6)


def test_texture():
    stripes = plain(0, 64)
    stripes[:, ::8] = stripes[:, 1::8] = stripes[:, 2::8] = stripes[:, 3::8] = 255
    full = np.ones((64, 64), bool)
    e = P.edge_histogram(P.gray(stripes), full)
    assert e[0] == pytest.approx(1) and P.edge_histogram(P.gray(stripes.transpose(1, 0, 2)), full)[4] == pytest.approx(1)
    board = (np.indices((32, 32)).sum(0) % 2 * 255).astype(np.uint8)
    c = P.cooccurrence(board, np.ones((32, 32), bool))
    assert c[0] > 0.4 and P.cooccurrence(plain(9)[..., 0], np.ones((32, 32), bool))[0] == 0
    assert len(P.texture(stripes, full)) == 85
    assert P.binary_patterns(plain(5)[..., 0], np.ones((32, 32), bool), 8, 1)[8] == 1


def test_masks():
    m = np.zeros((20, 20), bool)
    m[4:16, 4:16] = True
    m[8:10, 8:10] = False
    assert P.fill_holes(m).sum() == 144
    m[0, 0] = True
    assert P.regions(m).max() == 2
    assert P.dilate(P.erode(np.ones((9, 9), bool))).all()


def test_background():
    x = plain((60, 90, 20))
    m = np.zeros((32, 32), bool)
    m[8:24, 8:24] = True
    out, mask = P.without_background(x, m)
    assert out[0, 0].tolist() == [255] * 3 and out[16, 16].tolist() == [60, 90, 20] and (mask == m).all()
    assert (P.overlay(x, m)[0, 0] == x[0, 0]).all()


def test_hash():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 255, (64, 64, 3)).astype(np.uint8)
    assert P.perceptual_hash(x) < 1 << 63
    assert (P.perceptual_hash(x) ^ P.perceptual_hash((x * 0.98).astype(np.uint8))).bit_count() <= 6


def test_extract(spark, tmp_path):
    x = plain((90, 200, 255), 40)
    x[10:35, 12:30] = (60, 90, 20)
    (tmp_path / "a.png").write_bytes(png(x))
    (tmp_path / "b.png").write_bytes(b"broken")
    got = extract.extract_features(files.read_images(spark, str(tmp_path)), size=48)
    r = got.collect()
    assert len(r) == 1 and len(r[0]["color"]) == 369 and len(r[0]["shape"]) == 113 and len(r[0]["texture"]) == 85
    assert {x["set_name"]: x["dim"] for x in extract.feature_rows(got).collect()} == {"color": 369, "shape": 113, "texture": 85}


def test_orientation():
    tiff = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 0x010F, 2, 1, 0) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0)
    body = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"
    assert P.orientation(jpeg) == 6 and P.orientation(jpeg[:12]) == 1 and P.orientation(b"") == 1 and P.orientation(png(plain(3))) == 1
    x = np.arange(6).reshape(2, 3)
    assert P.upright(x, 6).tolist() == np.rot90(x, -1).tolist() and P.upright(x, 8).tolist() == np.rot90(x).tolist()
    assert P.upright(x, 3).tolist() == np.rot90(x, 2).tolist() and P.upright(x, 5).tolist() == x.T.tolist() and P.upright(x, 1).tolist() == x.tolist()
    assert P.upright(x, 7).tolist() == np.rot90(x, 2).T.tolist() and P.upright(x, 2).tolist() == x[:, ::-1].tolist() and P.upright(x, 4).tolist() == x[::-1].tolist()


def test_pictures(spark, tmp_path):
    rng = np.random.default_rng(1)
    for name in "abcd":
        x = plain(rng.integers(120, 255, 3), 40)
        x[10:35, 12 : 24 + ord(name) % 7] = rng.integers(0, 120, 3)
        (tmp_path / f"{name}.png").write_bytes(png(x))
    (tmp_path / "e.png").write_bytes(b"broken")
    images = files.read_oriented(spark, str(tmp_path))
    assert {r["orientation"] for r in images.collect()} == {1}
    assert [r["path"][-5:] for r in files.unreadable_images(spark, str(tmp_path)).collect()] == ["e.png"]
    got = extract.extract_features(images, ("color", "shape"), 40, whiten=True).cache()
    manifest = spark.createDataFrame([(i, f"{n}.png") for i, n in enumerate("abcz")], "image_id long, filename string")
    items = extract.with_manifest(got, manifest)
    assert sorted(r["filename"] for r in items.collect()) == ["a.png", "b.png", "c.png"]
    out = str(tmp_path / "out")
    written = [r["file"] for r in extract.write_pictures(got, f"file://{out}").collect()]
    assert len(written) == 4 and files.read_images(spark, out).filter("width = 40").count() == 4
    flat = extract.normalised_images(images, 40).filter("path like '%a.png'").first()["picture"]
    assert bytes(flat) == P.png(P.normalise(extract.decoded(*files.read_images(spark, str(tmp_path / "a.png")).select("height", "width", "channels", "data").first()), 40))
    plain_items = extract.with_manifest(extract.extract_features(images, ("color", "shape"), 40), manifest)
    space = FeatureSpace(plain_items, {"color": "l1", "shape": "l2"}).fit()
    upload = files.save_upload(spark, (tmp_path / "b.png").read_bytes(), str(tmp_path), "upload.png")
    near = extract.query_by_image(space, files.read_images(spark, upload), 2, 40).collect()
    assert near[0]["filename"] == "b.png" and near[0]["distance"] < 1e-9 < near[1]["distance"]
    with pytest.raises(ValueError, match="decoded"):
        extract.query_by_image(space, files.read_images(spark, str(tmp_path / "e.png")))
