"""Acceptance rules of image records as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Genera by group, words that exclude a title, words that exclude a category, least side, range of width over height.
CONIFER = ["Pinus", "Picea", "Abies", "Larix", "Cedrus", "Cupressus", "Taxus", "Juniperus", "Sequoia", "Sequoiadendron", "Araucaria", "Thuja", "Metasequoia", "Taxodium", "Pseudotsuga", "Tsuga", "Cryptomeria"]
BROADLEAF = ["Quercus", "Betula", "Fagus", "Acer", "Tilia", "Salix", "Populus", "Juglans", "Alnus", "Fraxinus", "Platanus", "Ulmus", "Adansonia", "Ficus", "Eucalyptus", "Olea", "Castanea", "Aesculus", "Prunus", "Malus", "Pyrus", "Sorbus", "Carpinus", "Robinia", "Acacia", "Vachellia", "Magnolia", "Liriodendron", "Ginkgo", "Ceiba", "Delonix", "Tamarindus", "Mangifera", "Terminalia", "Morus", "Celtis", "Catalpa", "Paulownia", "Cercis", "Gleditsia", "Nothofagus", "Erythrina", "Jacaranda", "Schinus", "Ailanthus", "Zelkova", "Carya", "Liquidambar", "Cornus", "Crataegus", "Dracaena", "Bombax", "Samanea", "Albizia", "Faidherbia", "Balanites", "Ziziphus", "Ilex", "Arbutus", "Cinnamomum", "Camphora", "Lagerstroemia"]
PALM = ["Cocos", "Phoenix", "Washingtonia", "Roystonea", "Borassus", "Elaeis", "Arecaceae", "Hyphaene", "Syagrus"]
BAD_WORDS = ["map", "diagram", "leaf", "leaves", "bark", "trunk", "detail", "flower", "blossom", "fruit", "seed", "cone", "close", "macro", "stump", "plantation", "panorama", "forest", "avenue", "alley", "allee", "bonsai", "herbarium", "illustration", "drawing", "painting", "sketch", "nursery", "sapling", "seedling", "root", "timber", "log ", "interior", "aerial", "drone", "palm", "plaque", "sign", "sculpture", "statue", "graffiti", "engraving", "poster", "stamp", "coin", "book"]
BAD_CATEGORIES = ["in art", "drawing", "painting", "diagram", "aerial", "palm", "art of", "illustration", "plaque", "sculpture", "postcard", "stamps", "engraving", "bark", "leaves", "trunk", "detail", "flowers", "fruit", "cones", "book", "postage", "photomontage", "collage"]
MIN_SIDE = 640
ASPECT = (0.65, 1.6)
MIME = ("image/jpeg", "image/png")

GENUS_PATTERN = r"\b(" + "|".join(sorted([*CONIFER, *BROADLEAF, *PALM])) + r")\b"


def any_of(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def genera(title: Column, categories: Column) -> Column:
    """All mentions of known genera in the categories and the title."""
    return F.regexp_extract_all(F.concat_ws(" ", F.concat_ws(" ", categories), title), F.lit(GENUS_PATTERN), F.lit(1))


def main_genus(mentions: Column) -> Column:
    """The most frequent mention, the first in the alphabet among equals; '' without any."""
    counted = F.transform(F.array_distinct(mentions), lambda g: F.struct((-F.size(F.filter(mentions, lambda m: m == g))).alias("n"), g.alias("g")))
    return F.coalesce(F.get(F.array_sort(counted), F.lit(0))["g"], F.lit(""))


def group_of(genus: Column) -> Column:
    return F.when(F.coalesce(genus, F.lit("")) == "", "unknown").when(genus.isin(CONIFER), "conifer").when(genus.isin(PALM), "palm").otherwise("broadleaf")


def accept_reason(title: Column, mime: Column, width: Column, height: Column, categories: Column, known: Column | None = None) -> Column:
    """The first rule that fails, or 'ok'. known: whether there is any image information (else: whether mime is set)."""
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    group = group_of(main_genus(genera(title, categories)))
    return (
        F.when(~(mime.isNotNull() if known is None else known), "no-imageinfo")
        .when(~F.coalesce(mime.isin(*MIME), F.lit(False)), "mime")
        .when(F.least(w, h) < MIN_SIDE, "small")
        .when(~(w / F.nullif(h, F.lit(0))).between(*ASPECT), "aspect")
        .when(F.lower(title).rlike(any_of(BAD_WORDS)), "badword")
        .when(F.lower(F.concat_ws(" ", categories)).rlike(any_of(BAD_CATEGORIES)), "badcat")
        .when(group == "palm", "palm")
        .otherwise("ok")
    )


def source_priority(categories: Column) -> Column:
    """0 to 4 by the categories' names, case-sensitively; the first that holds."""
    joined = F.concat_ws(" | ", categories)
    return (
        F.when(joined.contains("Category:Solitary ") & ~F.replace(joined, F.lit("Solitary trees by"), F.lit("")).contains("Solitary trees"), 0)
        .when(joined.contains("Quality images of solitary trees"), 1)
        .when(joined.contains("Solitary trees"), 2)
        .when(joined.contains("named individual trees") | joined.contains("named specimens"), 3)
        .otherwise(4)
    )


def strip_html(text: Column, most: int = 120) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"<[^>]+>", "")), 1, most)


# Coverage and offset bounds of the quality gate, inclusive.
COVERAGE = (0.04, 0.90)
OFFSET = 0.30


def passes_gate(coverage: Column, dx: Column, dy: Column, method: Column) -> Column:
    return coverage.between(*COVERAGE) & (F.abs(dx) <= OFFSET) & (F.abs(dy) <= OFFSET) & (method != "default_rect")


def gate_reason(coverage: Column, dx: Column, dy: Column, method: Column) -> Column:
    """Null for rows that pass."""
    return F.when(passes_gate(coverage, dx, dy, method), F.lit(None)).when(method == "default_rect", "no-tree").when(~coverage.between(*COVERAGE), "coverage").otherwise("off-center")
