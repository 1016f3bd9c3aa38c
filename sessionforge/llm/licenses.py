"""License scans in DataFrame operations only: which license notices occur in which documents.

Templates are short notices as sets of 5-word shingles, dealt into size classes (1, 2, 4, 8, ... shingles). For each
class a document's shingles are read in windows of two adjacent blocks of the class's size, so that every notice lies
whole in some window of like size. A window and a template that agree in any one of MINHASHES minima (bands of one
row) are a candidate: with a class of u, a template of more than u/2 shingles of which 0.8 are present agrees in a
minimum with probability 0.16 at least (0.5 for one shingle), and is missed by all 64 with 2e-5 at most, whole
notices with 1e-6 at most. Exact containment in the window decides.

A window without any shingle of a template can't agree in a minimum, so minima are taken only in windows around the
places where some template's shingle stands; no agreement is lost by that. Templates are a fixed list, which bounds
all that is broadcast.

Notices of a family differ in few words, so a sibling's notice holds much of a template. Templates of one license stand
together; of overlapping windows, a license goes whose shingles there all belong to another license that explains more
of the passage, or as much with no less containment: what can't be told from a sibling that isn't named is no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHINGLE, THRESHOLD, MINHASHES = 5, 0.8, 64
WORD = "[a-z0-9]+"
#: Public notices by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
_GNU = "{} free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."
#: Fixed values too: further families and versions. The SQL knows TEMPLATES alone.
SIBLINGS = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-notice": _GNU.format("This program is", ":", "Affero General Public License", ",", "3"),
    "BSD-2-Clause": _BSD.format(""),
    "BSD-3-Clause": _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "),
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-notice": _CC.format("Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-ND-4.0-notice": _CC.format("Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-SA-4.0-notice": _CC.format("Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-ND-4.0-notice": _CC.format("Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-notice": _CC.format("Attribution-ShareAlike"),
    "CC-BY-SA-3.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC0-1.0": "Licensed under CC0 1.0 Universal.",
    "CC0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-notice": _GNU.format("This program is", ";", "General Public License", ";", "2"),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-notice": _GNU.format("This library is", ";", "Lesser General Public License", ";", "2.1"),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-notice": _GNU.format("This library is", ":", "Lesser General Public License", ",", "3"),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def shingles(w: Column) -> Column:
    """Hashes of the 5-word shingles of a word array in order; of fewer words one, of all of them; none of none."""
    n = F.size(w)
    many = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))
    return F.when(n >= SHINGLE, many).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def shingles_of(text: Column) -> Column:
    """shingles(words(text)); the words are bound to a lambda's variable, so no rule of the optimizer repeats them."""
    return F.get(F.transform(F.array(words(text)), lambda w: shingles(w)), F.lit(0))


def minima(h: Column) -> Column:
    """The least value of an array under each of MINHASHES hash functions."""
    def least(j: int) -> Column:
        return F.array_min(F.transform(h, lambda x: F.xxhash64(x, F.lit(j))))

    return F.array(*map(least, range(MINHASHES)))


def windows(h: Column, places: Column, u: int) -> Column:
    """u, at (first shingle) and win (distinct shingles) of the windows of class u around the places."""
    block = F.transform(places, lambda p: F.floor(p / u).cast("int"))
    starts = F.array_distinct(F.filter(F.concat(block, F.transform(block, lambda b: b - 1)), lambda b: b >= 0))
    return F.transform(starts, lambda b: F.struct(F.lit(u).alias("u"), (b * u).alias("at"), F.array_distinct(F.slice(h, b * u + 1, 2 * u)).alias("win")))


def templates(spark: SparkSession, texts: dict[str, str]) -> list:
    """name, class and distinct shingles of each template: a few rows, on the driver."""
    rows = spark.createDataFrame(sorted(texts.items()), "license string, text string")
    rows = rows.withColumn("s", F.array_distinct(shingles_of(F.col("text")))).where(F.size("s") > 0)
    size = F.pow(F.lit(2), F.ceil(F.log2(F.size("s")))).cast("int")
    return rows.select("license", size.alias("u"), "s").collect()


def licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, containment, n_windows and first_word: a row for each document and template of which a window
    of the document holds `threshold` or more of the shingles, unless the passage is a sibling license's.

    first_word is where the first such window begins, in words from 0. Case and all characters but ASCII letters and
    digits don't count. Null, empty and wordless texts hold nothing; rows that repeat an id count together; a null id
    is a document of its own."""
    spark = docs.sparkSession
    known = templates(spark, TEMPLATES | SIBLINGS if texts is None else texts)
    if not known:
        return spark.createDataFrame([], "doc_id long, license string, containment double, n_windows long, first_word int")
    everything = F.array(*[F.lit(x).cast("bigint") for x in sorted({x for r in known for x in r["s"]})])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), shingles_of(F.col(text_col)).alias("h__")).where(F.arrays_overlap("h__", everything))
    places = F.filter(F.transform(F.col("h__"), lambda x, i: F.when(F.array_contains(everything, x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("p__", places)
    around = [windows(F.col("h__"), F.col("p__"), u) for u in sorted({r["u"] for r in known})]
    rows = rows.select("doc_id", F.xxhash64("h__").alias("row"), F.explode(F.concat(*around)).alias("x__")).select("doc_id", "row", "x__.u", "x__.at", "x__.win")
    bands = rows.select("doc_id", "row", "u", "at", "win", F.posexplode(minima(F.col("win"))).alias("band", "least"))
    kinds = spark.createDataFrame([(r["license"], r["u"], r["s"]) for r in known], "license string, u int, tset array<bigint>")
    index = kinds.select("license", "u", "tset", F.posexplode(minima(F.col("tset"))).alias("band", "least"))
    found = bands.join(F.broadcast(index), ["u", "band", "least"]).dropDuplicates(["doc_id", "row", "u", "at", "license", "win"])
    found = found.withColumn("shared", F.array_intersect("tset", "win")).withColumn("c", F.size("shared") / F.size("tset")).where(F.col("c") >= threshold)
    found = best(found.select("doc_id", "row", "u", "at", "license", "shared", "c"))
    return found.groupBy("doc_id", "license").agg(F.max("c").alias("containment"), F.sum("n").alias("n_windows"), F.min("at").alias("first_word"))


def best(found: DataFrame) -> DataFrame:
    """doc_id, license, c, n and at (greatest containment, windows, first place) by row and passage, a run of
    overlapping windows, of the licenses that no other license beats there."""
    text = Window.partitionBy("doc_id", "row").orderBy("at", "u")
    before = F.max(F.col("at") + 2 * F.col("u")).over(text.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.when(F.col("at") < before, 0).otherwise(1))
    found = found.withColumn("passage", F.sum("new").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    place = ["doc_id", "row", "passage"]
    each = found.groupBy(*place, "license").agg(F.array_distinct(F.flatten(F.collect_set("shared"))).alias("s"), F.max("c").alias("c"), F.count("*").alias("n"), F.min("at").alias("at"))
    family = F.regexp_replace("license", "-(notice|line)$", "")
    each = each.groupBy(*place, family.alias("family")).agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"), F.max("c").alias("c"), F.collect_list(F.struct("license", "c", "n", "at")).alias("own"))
    all_ = each.groupBy(*place).agg(F.collect_list(F.struct("family", "s", "c", "own")).alias("all"))

    def beaten(a: Column) -> Column:
        def beats(b: Column) -> Column:
            more = (F.size(b["s"]) > F.size(a["s"])) | (b["c"] >= a["c"])
            return (b["family"] != a["family"]) & more & (F.size(F.array_except(a["s"], b["s"])) == 0)

        return F.exists("all", beats)

    kept = all_.select("doc_id", F.explode(F.filter("all", lambda a: ~beaten(a))).alias("x"))
    return kept.select("doc_id", F.explode("x.own").alias("x")).select("doc_id", "x.license", "x.c", "x.n", "x.at")
