"""License scans by MinHash bands over overlapping windows (DataFrame functions only).

Templates are short public notices (a parameter). Texts are lower-cased, words are runs of letters and
digits, shingles are five words (the whole text where it has fewer). A template matches a document that
holds 80% of its shingles or more.

Retrieval: a template of m shingles is cut at every offset into windows of L shingles, L the power of two
not above m / 4; documents are cut into windows of every such L with a stride of L / 2. Each window has
``bands`` MinHash values, one row a band, and a shared value makes (document, template) a candidate. A window
of similarity s is missed with probability (1 - s) ** bands; a matching document holds a window of similarity
0.6 or more, so 16 bands miss it with less than one in two million, and an unbroken run of 1.5 L shingles
holds a window equal to one of the template's, which always collides.

Verification: the exact containment of the template's shingles in those of the whole document.

Before any window is cut, documents are filtered by anchors: a set of words chosen for each template
such that more than 20% of its shingles have one of them. A text without any of them can't
hold 80% of the shingles, so the filter loses nothing.

Scale: text is scanned once; rows never meet other rows except the templates (bounded by their parameter),
so hot sources, lines or copies move no data.

Defined cases: null and wordless texts match nothing; a text repeated twice matches alike; several
templates may match one text, each giving a row; rows of one id, or without id, are scanned each for itself; a template at exactly the share
matches; texts are scanned whole, however long; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public notices: (template, text).
TEMPLATES = (
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("mit-notice", "Released under the MIT License."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("gpl-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
)
SHINGLE, CONTAINED, BANDS = 5, 0.8, 16
WORD = r"[\p{L}\p{N}]+"


def _plan(templates, k: int, contained: float) -> tuple[dict[int, list[str]], list[str]]:
    """Window sizes with their templates, and the anchor words. Words here are only used to choose anchors."""
    import re

    sizes: dict[int, list[str]] = {}
    anchors: set[str] = set()
    for name, text in templates:
        words = re.findall(r"[^\W_]+", text.lower())
        if not words:
            continue
        shingles = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}
        m, size = len(shingles), 1
        while size * 2 <= m // 4:
            size *= 2
        sizes.setdefault(size, []).append(name)
        # Long words first, as they are rare in prose, until the shingles without an anchor are fewer than a match needs.
        free = set(shingles)
        for word in sorted(set(words), key=lambda w: (-len(w), w)):
            if len(free) < contained * m:
                break
            anchors.add(word)
            free = {s for s in free if word not in s}
        assert len(free) < contained * m
    return sizes, sorted(anchors)


def _shingles(words: Column, k: int) -> Column:
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, k), " ")))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(many)


def _bands(shingles: Column, size: int, stride: int, bands: int) -> Column:
    """The MinHash values of all windows of ``size`` shingles, each hashed with its size and band."""
    if size == 1:  # one shingle is its own minimum under every hash
        return F.transform(shingles, lambda h: F.xxhash64(h, F.lit(1000)))
    last = F.greatest(F.size(shingles) - (size - stride), F.lit(1))

    def least(at: Column, b: int) -> Column:
        return F.array_min(F.transform(F.slice(shingles, at, size), lambda h: F.xxhash64(h, F.lit(b))))

    one = lambda at: F.array(*[F.xxhash64(least(at, b), F.lit(size * 1000 + b)) for b in range(bands)])
    return F.flatten(F.transform(F.sequence(F.lit(1), last, F.lit(stride)), one))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, contained: float = CONTAINED, bands: int = BANDS, k: int = SHINGLE) -> DataFrame:
    """doc_id, template, n_shared, n_template (shingles), containment: a row for every match.

    The templates' band values become literals of the plan: their number follows from ``templates`` alone.
    """
    spark = docs.sparkSession
    sizes, anchors = _plan(templates, k, contained)
    if not sizes:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit("").alias("template"), F.lit(0).cast("long").alias("n_shared"), F.lit(0).cast("long").alias("n_template"), F.lit(0.0).alias("containment")).where(F.lit(False))
    words = lambda c: F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    known = spark.createDataFrame(list(templates), "template string, body string").withColumn("words", words(F.lower("body"))).where(F.size("words") > 0)
    known = known.withColumn("parts", _shingles(F.col("words"), k)).withColumn("wanted", F.array_distinct("parts"))
    index: dict[str, list[int]] = {}
    for size, names in sizes.items():
        for row in known.where(F.col("template").isin(names)).select("template", _bands(F.col("parts"), size, 1, bands).alias("b")).collect():
            index[row["template"]] = sorted(set(row["b"]))
    among = lambda values: "IN (" + ", ".join(f"{v}L" if v > -(2**63) else "0L" for v in values) + ")"
    every = sorted({v for values in index.values() for v in values})
    def has_anchor(low: Column) -> Column:
        found = F.lit(False)
        for word in anchors:
            found = found | F.contains(low, F.lit(word))
        return found

    # No filter on computed columns: it would be pushed down and repeat them for every element.
    found = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.exists(F.array(F.lower("text")), has_anchor))
        .select("doc_id", words(F.lower("text")).alias("words")).select("doc_id", _shingles(F.col("words"), k).alias("parts"))
        .withColumn("keys", F.flatten(F.array(*[_bands(F.col("parts"), size, max(1, size // 2), bands) for size in sorted(sizes)])))
        .select("doc_id", "parts", F.expr(f"filter(keys, b -> b {among(every)})").alias("hits"))
    )
    names = F.array(*[F.when(F.expr(f"exists(hits, b -> b {among(values)})"), F.lit(name)) for name, values in sorted(index.items())])
    candidates = found.select("doc_id", F.array_distinct("parts").alias("parts"), F.explode(F.array_compact(names)).alias("template"))
    shared = F.size(F.array_intersect("parts", "wanted")).cast("long")
    total = F.size("wanted").cast("long")
    return (
        candidates.join(F.broadcast(known.select("template", "wanted")), "template")  # as many rows as templates
        .select("doc_id", "template", shared.alias("n_shared"), total.alias("n_template"), F.round(shared / total, 6).alias("containment"))
        .where(F.col("n_shared") >= F.lit(float(contained)) * F.col("n_template"))
    )
