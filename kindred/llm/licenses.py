"""License scans: which known license texts a document holds, in DataFrame operations alone.

Words are runs of letters and digits, lower-cased; shingles are SHINGLE words. Shingles that no template has can't
add to a match, so only a document's template shingles, its hits, go on. Windows of a template class's width, overlapping by half, are
laid over them; a window's hits and a template meet if they agree in one of BANDS MinHash bands of one row
each. Any place of a template lies whole in one window. At a containment of 0.8 the chance that no band agrees is at most 0.2 ** BANDS
when the window holds no other template's shingles, and where all of it does, as in lists of licenses, at most 0.81 ** BANDS, or 1.4e-6, for templates
of some words and 2e-4 for those of three. What meets is compared shingle by shingle, and is a match if the window
has `least` of the template's distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read

SHINGLE = 3
BANDS = 64
LEAST = 0.8

#: Notices by which texts state their license, and the texts of some short licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _least(hashes: Column, band: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band))))


def _windows(hits: DataFrame, width: int) -> DataFrame:
    """Windows of 2 * width shingles that start at multiples of width and hold hits; a place of up to `width` words lies whole in one."""
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.array(F.floor(x["i"] / width), F.floor(x["i"] / width) - 1))))
    one = hits.select("doc_id", "hits", F.explode(starts).alias("s")).filter("s >= 0")
    inside = F.filter("hits", lambda x: (x["i"] >= F.col("s") * width) & (x["i"] < (F.col("s") + 2) * width))
    return one.select("doc_id", F.lit(width).alias("width"), inside.alias("inside"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, least: float = LEAST) -> DataFrame:
    """doc_id, license, first_word (the first in its best window that begins a shingle of the license), containment: a row per document and license found.

    Null and empty texts have no matches. Rows that repeat an id count as one document, whose best match is
    kept. Templates of fewer than SHINGLE words can't be found. No rows or no templates: no rows.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    hashes = lambda w: F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(F.col(w), (i + k).cast("int")) for k in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))
    known = spark.createDataFrame(list(templates.items()) or [("", "")], "license string, text string").select("license", words_of(F.col("text")).alias("w"))
    known = known.select("license", F.array_distinct(hashes("w")).alias("shingles"), F.size("w").alias("n_words"))
    # the templates are a parameter: as many rows as it has, brought to the driver to become literals
    rows = [r for r in known.collect() if r["shingles"]]
    kind = f"doc_id {dict(docs.dtypes)[id_col]}, license string, first_word int, containment double"
    if not rows:
        return spark.createDataFrame([], kind)
    vocabulary = sorted({h for r in rows for h in r["shingles"]})
    classes = sorted({1 << max(2, (r["n_words"] - 1).bit_length()) for r in rows})
    known = spark.createDataFrame([(r["license"], r["shingles"], 1 << max(2, (r["n_words"] - 1).bit_length())) for r in rows], "license string, shingles array<bigint>, width int")
    df = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("w"))
    df = df.select("doc_id", hashes("w").alias("h"))
    hit = lambda h, i: F.when(h.isin(vocabulary), F.struct(i.alias("i"), h.alias("h")))
    df = df.select("doc_id", F.filter(F.transform("h", hit), lambda x: x.isNotNull()).alias("hits"))
    # filtered once written: a filter on hits would go below the projections and evaluate them for each shingle
    hits = materialise(df, "license-hits").filter(F.size("hits") > 0)
    windows = [_windows(hits, width) for width in classes]
    df = windows[0]
    for other in windows[1:]:
        df = df.unionByName(other)
    own = F.array_distinct(F.transform("inside", lambda x: x["h"]))
    signature = lambda a: F.array(*[_least(a, b) for b in range(bands)])
    df = df.filter(F.size("inside") > 0).withColumn("own", own).select("doc_id", "width", "inside", F.monotonically_increasing_id().alias("window"), signature(F.col("own")).alias("signature"))
    df = materialise(df, "license-windows")
    banded = known.select("license", "shingles", "width", F.posexplode(signature(F.col("shingles"))).alias("band", "value"))
    found = df.select("doc_id", "width", "inside", "window", F.posexplode("signature").alias("band", "value"))
    found = found.join(F.broadcast(banded), ["width", "band", "value"]).dropDuplicates(["window", "license"])  # the templates' bands: a bounded table
    first = F.element_at(F.filter("inside", lambda x: F.array_contains("shingles", x["h"])), 1)["i"]
    found = found.select("doc_id", "license", first.alias("first_word"), (F.size(F.array_intersect(own, "shingles")) / F.size("shingles")).alias("containment")).filter(F.col("containment") >= least)
    best = F.max(F.struct("containment", (-F.col("first_word")).alias("early")))
    return found.groupBy("doc_id", "license").agg(best.alias("best")).select("doc_id", "license", (-F.col("best.early")).cast("int").alias("first_word"), F.col("best.containment").alias("containment"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
