"""Images to feature rows, on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels
from .search import top_k
from .space import TOP_K, FeatureSpace


def decoded(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """The bytes of Spark's image source (BGR, BGRA or gray) as RGB."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, 2) if channels == 1 else x[..., 2::-1]


def foreground(rgb: np.ndarray, segment: Callable[[np.ndarray], np.ndarray] | None = None, least: float = 0.02) -> tuple[np.ndarray, str]:
    """A mask and how it was found: by `segment` if it is given and finds enough, else what isn't sky in a default box, else the box."""
    if segment is not None and (m := segment(rgb)).mean() >= least:
        return pixels.fill_holes(m), "semantic"
    box = pixels.default_box(rgb.shape[:2])
    m = pixels.clean(box & ~pixels.sky(rgb))
    return (m, "not_sky") if m.mean() >= least else (box, "default_rect")


def _pictures(images: DataFrame, size: int, make: Callable[[str, np.ndarray], dict], kind: str) -> DataFrame:
    """make(path, normalised RGB) of every row of images: path, height, width, channels, data and, if it is known, orientation."""
    turned = "orientation" in images.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, height, width, channels, data, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rgb = decoded(height, width, channels, data)
                    rgb = pixels.normalise(pixels.upright(rgb, turn[0] or 1) if turn else rgb, size)
                except (ValueError, TypeError):
                    continue
                yield pa.RecordBatch.from_pylist([make(path, rgb)])

    return images.select("path", "height", "width", "channels", "data", *(["orientation"] if turned else [])).mapInArrow(run, kind)


def extract_features(images: DataFrame, sets: tuple[str, ...] = ("color", "shape", "texture"), size: int = pixels.SIZE, *, segment: Callable[[np.ndarray], np.ndarray] | None = None, whiten: bool = False) -> DataFrame:
    """path, method, coverage, dx, dy, phash and an array per set. images: path, height, width, channels, data and, if it is known, orientation.

    With `whiten` features are taken from the image without its background, which comes as a PNG in column `picture`. Undecodable rows are
    left out; unreadable_images() names files.
    """

    def make(path: str, rgb: np.ndarray) -> dict:
        mask, method = foreground(rgb, segment)
        row = {"path": path, "method": method, "coverage": float(mask.mean()), "phash": pixels.perceptual_hash(rgb)}
        if whiten:
            rgb, mask = pixels.without_background(rgb, mask)
            row["picture"] = pixels.png(rgb)
        measures = pixels.region_measures(mask)
        row |= {"dx": float(measures[8]), "dy": float(measures[9])}
        return row | {s: pixels.EXTRACTORS[s](rgb, mask).tolist() for s in sets}

    names = ["path string", "method string", "coverage double", "dx double", "dy double", "phash long", *(["picture binary"] if whiten else []), *[f"{s} array<double>" for s in sets]]
    order = [n.split()[0] for n in names]
    return _pictures(images, size, lambda path, rgb: (lambda row: {n: row[n] for n in order})(make(path, rgb)), ", ".join(names))


def normalised_images(images: DataFrame, size: int = pixels.SIZE) -> DataFrame:
    """path and picture, the normalised image as a PNG file's bytes."""
    return _pictures(images, size, lambda path, rgb: {"path": path, "picture": pixels.png(rgb)}, "path string, picture binary")


def write_pictures(pictures: DataFrame, folder: str) -> DataFrame:
    """Writes each picture as a file named as its path's last part, .png, into a folder that executors share; path and file. Run again, it writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            paths, files = batch.column(0).to_pylist(), []
            for path, picture in zip(paths, batch.column(1).to_pylist(), strict=True):
                files.append(f"{root}/{path.rsplit('/', 1)[-1].rsplit('.', 1)[0]}.png")
                with fs.open_output_stream(files[-1]) as f:
                    f.write(picture)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(files, pa.string())], ["path", "file"])

    return pictures.select("path", "picture").mapInArrow(run, "path string, file string")


def with_manifest(extracted: DataFrame, manifest: DataFrame) -> DataFrame:
    """What was extracted beside the manifest's row of the same file name; images that the manifest lacks are left out."""
    return extracted.withColumn("filename", F.element_at(F.split("path", "/"), -1)).join(manifest, "filename")


def query_by_image(space: FeatureSpace, images: DataFrame, k: int = TOP_K, size: int = pixels.SIZE, *, segment=None, **options) -> DataFrame:
    """The items nearest to the one image of images, from pixels to results; an image that can't be decoded is an error.

    Sets that pixels don't give (embeddings of a network) are left out of the distance.
    """
    sets = tuple(s for s in space.sets if s in pixels.EXTRACTORS)
    row = extract_features(images, sets, size, segment=segment).first()
    if row is None:
        raise ValueError("the image can't be decoded")
    return top_k(space, {s: list(row[s]) for s in sets}, k, **options)


def feature_rows(extracted: DataFrame, sets: tuple[str, ...] = ("color", "shape", "texture")) -> DataFrame:
    """A row per image and set: path, set_name, dim, vector."""
    parts = F.array(*[F.struct(F.lit(s).alias("set_name"), F.size(s).alias("dim"), F.col(s).cast("array<float>").alias("vector")) for s in sets])
    return extracted.select("path", F.inline(parts))
