"""Licence scan: sparse TF-IDF cosine of header sentences and licence files to templates, and inheritance along directories. DataFrame only.

Units are the lines of every file, its sentences (which end at a stop before white space or at a line without letters and digits, so that a header
wrapped over several commented lines is one unit, and so is a notice at the end of a line of prose) and, for files whose name says so,
the whole text. A unit's vector has term frequency times log((1 + N) / (1 + df)) + 1, with document frequencies of the templates' terms
over all files; terms that no template has count with the largest weight. Templates have weights of the same kind.

Prefix filter: for each template, the heaviest terms are taken until the rest is lighter than the template's least cosine. By the
Cauchy-Schwarz inequality a unit without any of them stays below the threshold, so only units with one of these few words are exploded
and joined with the templates' terms, and of these only units of whose vector the templates' words are a large enough part. This loses nothing.

A tag whose line is an expression (OR, AND, WITH an exception) of known names gives the expression. A bare reservation of rights inside a
sentence counts only in a text with a copyright notice, and never against a licence that the file inherits.

A file's own licence is that of its best unit: by the template's strength first (a tag, or the clause that tells two licences apart, before a
sentence of a licence's text, before a short notice, before a bare reservation of rights), then by cosine. A file without one inherits from
the nearest directory above it (its own first) that has a licence file with a licence, found by joining the exploded ancestors of
distinct directories.

Defined results: null and empty texts have no licence of their own; a null key is a key like any other; a null path stands in the root;
rows of one key and path are one file; ties go to the first template, then the least unit, and among a directory's licence files to the
strongest, the best score, the first path and the least key; repeated rows get equal results; an empty table gives an empty one; the other
columns don't matter.
"""

from __future__ import annotations

from math import log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolith.llm.common import written

#: A unit's cosine from which on it carries a template's licence; short notices that differ in one word need more, and a tag must fit but for rounding.
LEAST, LEAST_POINTER, LEAST_TAG = 0.6, 0.9, 0.99
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"
#: What separates sentences: a stop and white space, or a line without letters and digits.
SENTENCE_END = r"[.!?][\x20\x09-\x0D]+|\n[^A-Za-z0-9\n]*\n"
RESERVED, SHORT_NOTICE, SENTENCE, DECIDING = range(4)


class Template(NamedTuple):
    license: str
    text: str
    strength: int = SENTENCE
    least: float = LEAST


# Names, usual notices, headers and telling sentences of public licences.
TAGS = (
    "MIT", "Apache-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "Zlib", "BSL-1.0", "EPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense",
)
TEMPLATES: tuple[Template, ...] = (
    Template("MIT", "Released under the MIT License.", SHORT_NOTICE),
    Template("MIT", "Licensed under the MIT License.", SHORT_NOTICE),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", SHORT_NOTICE),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    Template("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    Template("GPL-2.0", "Licensed under the GNU General Public License, version 2.", SHORT_NOTICE),
    Template("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    Template("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    Template("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", SHORT_NOTICE),
    Template("GPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License, version 3 or later.", SHORT_NOTICE),
    Template("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    Template("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    Template("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    Template("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3.", SHORT_NOTICE),
    Template("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    Template("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3.", SHORT_NOTICE),
    Template("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    Template("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", SHORT_NOTICE),
    Template("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", DECIDING),
    Template("BSD-3-Clause", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.", DECIDING),
    Template("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", SHORT_NOTICE),
    Template("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", SHORT_NOTICE),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    Template("MPL-2.0", "Mozilla Public License Version 2.0"),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", SHORT_NOTICE),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", SHORT_NOTICE),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", SHORT_NOTICE),
    Template("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal.", SHORT_NOTICE),
    Template("Unlicense", "This is free and unencumbered software released into the public domain."),
    Template("MIT", "This project is licensed under the MIT License, see the LICENSE file for details.", SHORT_NOTICE, LEAST_POINTER),
    Template("MIT", "This project is licensed under the MIT license, see LICENSE for details", SHORT_NOTICE, LEAST_POINTER),
    Template("Apache-2.0", "This project is licensed under the Apache License 2.0, see the LICENSE file for details.", SHORT_NOTICE, LEAST_POINTER),
    Template("BSD-3-Clause", "This project is licensed under the BSD 3-Clause License, see the LICENSE file for details.", SHORT_NOTICE, LEAST_POINTER),
    Template("ISC", "Licensed under the ISC License.", SHORT_NOTICE, LEAST_POINTER),
    Template("Zlib", "Licensed under the zlib License.", SHORT_NOTICE, LEAST_POINTER),
    Template("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    Template("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    Template("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    Template("EPL-2.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v20.html"),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", SHORT_NOTICE, LEAST_POINTER),
    Template("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", SHORT_NOTICE, LEAST_POINTER),
    Template("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", SHORT_NOTICE, LEAST_POINTER),
    Template("Proprietary", "All rights reserved.", RESERVED),
    *(Template(t.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {t}", DECIDING, LEAST_TAG) for t in TAGS),
)

#: A tag's expression of two names or more, what it may hold beside names, and the names that are known.
EXPRESSION = r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9.+-]+\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)+)"
EXCEPTION, BETWEEN, LATER = r"[ \t]+WITH[ \t]+[A-Za-z0-9.-]+", r"[ \t()]+", r"-only|-or-later"
#: What makes a reservation inside a sentence a notice.
COPYRIGHT = r"(?i)copyright|\(c\)|©"


def terms_of(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def split_terms(text: str) -> list[str]:
    """terms_of for a template."""
    return [w for w in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split() if w]


def template_weights(templates: tuple[Template, ...], idf: dict[str, float]) -> list[dict[str, float]]:
    """Each template's vector of unit length."""
    found = []
    for t in templates:
        words = split_terms(t.text)
        raw = {w: words.count(w) * idf[w] for w in sorted(set(words))}
        norm = sum(x * x for x in raw.values()) ** 0.5
        found.append({w: x / norm for w, x in raw.items()})
    return found


def prefix_terms(weights: list[dict[str, float]], leasts: list[float]) -> list[str]:
    """For each vector its heaviest terms, until what is left is lighter than its least cosine."""
    chosen: set[str] = set()
    for vector, least in zip(weights, leasts, strict=True):
        left = 1.0
        for w, x in sorted(vector.items(), key=lambda item: (-item[1], item[0])):
            if left < least * least * (1 - 1e-9):
                break
            chosen.add(w)
            left -= x * x
    return sorted(chosen)


def may_match(w: Column, idf: dict[str, float], rarest: float, least: float) -> Column:
    """Whether a unit's words leave room for a cosine of `least`: the part of its vector that templates have must be that much of its length.

    By the Cauchy-Schwarz inequality no cosine exceeds that share. The squares of the other words' counts add up to at least their number
    squared by their distinct number, so long prose around a few of the templates' words is left out by one pass over its words.
    """
    vocabulary = sorted(idf)
    of = F.create_map(*(F.lit(v) for item in sorted(idf.items()) for v in item))
    shared, other = F.filter(w, lambda x: x.isin(vocabulary)), F.filter(w, lambda x: ~x.isin(vocabulary))
    squares = lambda own: F.aggregate(F.array_distinct(own), F.lit(0.0), lambda s, t: s + F.pow(F.size(F.filter(own, lambda x: x == t)) * F.element_at(of, t), F.lit(2.0)))
    rest = lambda far: F.pow(F.size(far).cast("double"), F.lit(2.0)) / F.greatest(F.size(F.array_distinct(far)), F.lit(1)) * (rarest * rarest)
    part = (least - 1e-6) ** 2  # scores are rounded to six places
    return F.exists(F.array(F.struct(shared.alias("own"), other.alias("far"))), lambda p: (1 - part) * squares(p["own"]) >= part * rest(p["far"]))


def own_licenses(files: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text", path: str = "path", key: str = "doc_id") -> DataFrame:
    """(key, path, license, score, strength, unit) of the files with a licence of their own.

    unit is the line from 0, -1 for the whole file, or -2, -3, ... for sentences. Rows of one key and path are one file.
    """
    spark = files.sparkSession
    vocabulary = sorted({w for t in templates for w in split_terms(t.text)})
    # Document frequencies of the vocabulary: as many rows as the templates have terms reach the driver.
    own = files.select(F.array_distinct(F.filter(terms_of(F.col(text)), lambda w: w.isin(vocabulary))).alias("w"))
    # A null stands for the file itself, so that one pass counts both.
    df = {r[0]: r[1] for r in own.select(F.explode(F.concat(F.col("w"), F.array(F.lit(None).cast("string")))).alias("w")).groupBy("w").count().collect()}
    n_files = df.get(None, 0)
    rarest = log(1 + n_files) + 1
    idf = {w: rarest - log(1 + df.get(w, 0)) for w in vocabulary}
    weights = template_weights(templates, idf)
    keys = prefix_terms(weights, [t.least for t in templates])

    def has_key(t: Column) -> Column:
        return F.exists(terms_of(t), lambda w: w.isin(keys))

    # A struct holds the key, so that a null key is equal to itself in joins.
    lines = files.where(has_key(F.col(text))).select(F.struct(F.col(key).alias("v")).alias("key"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.col(text).alias("text"))
    whole = F.when(F.col("path").rlike(LICENSE_FILE), F.array(F.struct(F.lit(-1).alias("unit"), F.col("text").alias("t")))).otherwise(F.array().cast("array<struct<unit:int,t:string>>"))
    by_line = F.transform(F.split("text", "\n"), lambda t, i: F.struct(i.alias("unit"), t.alias("t")))
    by_sentence = F.transform(F.split("text", SENTENCE_END), lambda t, i: F.struct((-2 - i).alias("unit"), t.alias("t")))
    each = F.concat(whole, by_line, by_sentence)
    noted, expression = F.col("text").rlike(COPYRIGHT).alias("noted"), F.when(F.col("u.unit") >= 0, F.regexp_extract("u.t", EXPRESSION, 1)).otherwise("").alias("expression")
    units = lines.select("key", "path", noted, F.explode(F.filter(each, lambda u: has_key(u["t"]))).alias("u")).select("key", "path", "noted", "u.unit", terms_of(F.col("u.t")).alias("w"), expression)
    units = units.where((F.col("expression") != "") | F.exists(F.array("w"), lambda w: may_match(w, idf, rarest, min(t.least for t in templates))))
    # Copies of a unit are compared once: its words go by their digest, and its places are joined to what the digest scored.
    units = written(units.withColumn("said", F.unhex(F.sha2(F.array_join("w", " "), 256))))
    tf = units.groupBy("said").agg(F.first("w").alias("w")).select("said", F.explode("w").alias("term")).groupBy("said", "term").agg(F.count(F.lit(1)).alias("tf"))
    # The templates' terms, each in one row with its weight in every template, so that a unit has as many rows as terms.
    known_terms = F.broadcast(spark.createDataFrame([(w, x, [v.get(w, 0.0) for v in weights]) for w, x in sorted(idf.items())], "term string, idf double, shares array<double>"))
    weighted = tf.join(known_terms, "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(rarest)))
    norm, parts = F.sqrt(F.sum(F.col("x") * F.col("x"))), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("x", "shares")))
    vectors = weighted.groupBy("said").agg(norm.alias("norm"), parts.alias("parts"))
    dots = F.aggregate("parts", F.array_repeat(F.lit(0.0), len(templates)), lambda sums, part: F.zip_with(sums, part["shares"], lambda s, share: s + part["x"] * share))
    names, strengths, leasts = (F.lit([t[k] for t in templates]) for k in (0, 2, 3))
    fit = lambda dot, k: F.struct((-F.get(strengths, k)).alias("weakest"), (-F.round(dot / F.col("norm"), 6)).alias("worst"), k.alias("template"), F.get(names, k).alias("license"))
    scored = vectors.select("said", F.filter(F.transform(dots, fit), lambda f: -f["worst"] >= F.get(leasts, f["template"])).alias("fits"))
    # The best template of a text, and the best that isn't a bare reservation.
    fits = written(scored.select("said", F.array_min("fits").alias("any"), F.array_min(F.filter("fits", lambda f: f["weakest"] < -RESERVED)).alias("firm")).where(F.col("any").isNotNull()))
    places = units.select("key", "path", "noted", "unit", "said").join(fits, "said").withColumn("fit", F.when((F.col("unit") >= -1) | F.col("noted"), F.col("any")).otherwise(F.col("firm")))
    scored = places.where(F.col("fit").isNotNull()).select("key", "path", "unit", "fit.template", (-F.col("fit.worst")).alias("score"), (-F.col("fit.weakest")).alias("strength"), "fit.license")
    known = sorted({t.removesuffix("-only").removesuffix("-or-later") for t in TAGS})
    name = F.regexp_replace("expression", LATER, "")
    parts = F.split(F.regexp_replace(name, EXCEPTION, ""), BETWEEN)
    tagged = units.where(F.col("expression") != "").where(F.forall(parts, lambda x: x.isin("", "AND", "OR", *known)))
    tagged = tagged.select("key", "path", "unit", F.lit(-1).alias("template"), F.lit(1.0).alias("score"), F.lit(DECIDING).alias("strength"), name.alias("license"))
    best = scored.unionByName(tagged).groupBy("key", "path").agg(F.min(F.struct((-F.col("strength")).alias("weakest"), (-F.col("score")).alias("worst"), "template", "unit", "license")).alias("b"))
    return best.select(F.col("key.v").alias(key), F.col("path").alias(path), "b.license", (-F.col("b.worst")).alias("score"), (-F.col("b.weakest")).alias("strength"), "b.unit")


def directory_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors_of(directory: Column) -> Column:
    """The directory and all above it, nearest first, the root as the empty string."""
    parts = F.array_remove(F.split(directory, "/"), "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda up: F.struct(up.alias("up"), F.array_join(F.slice(parts, 1, F.size(parts) - up), "/").alias("above")))


def scan(files: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text", path: str = "path", key: str = "doc_id") -> DataFrame:
    """(key, path, own_license, own_score, license, origin, up) for each row.

    origin is own, inherited or none; up is how many directories above the file's own the licence was found, null if not inherited.
    """
    named = files.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(path), F.lit("")).alias("path"))
    own = written(own_licenses(named, templates, "text", "path", "key").withColumn("key", F.struct(F.col("key").alias("v"))))
    by_directory = (
        own.where(F.col("path").rlike(LICENSE_FILE))
        .groupBy(_tidy(directory_of(F.col("path"))).alias("above"))
        .agg(F.min(F.struct((-F.col("strength")).alias("weakest"), (-F.col("score")).alias("worst"), "path", "key", "license")).alias("b"))
        .select("above", F.col("b.license").alias("inherited"), (-F.col("b.weakest")).alias("above_strength"))
    )
    directories = named.select(_tidy(directory_of(F.col("path"))).alias("directory")).distinct()
    above = directories.select("directory", F.explode(ancestors_of(F.col("directory"))).alias("a")).select("directory", "a.up", "a.above")
    nearest = above.join(by_directory, "above").groupBy("directory").agg(F.min(F.struct("up", "inherited", "above_strength")).alias("near")).select("directory", "near.*")
    rows = named.select(F.struct(F.col("key").alias("v")).alias("key"), "path", _tidy(directory_of(F.col("path"))).alias("directory"))
    mine = own.select("key", "path", F.col("license").alias("own_license"), F.col("score").alias("own_score"), "strength")
    joined = rows.join(mine, ["key", "path"], "left").join(nearest, "directory", "left")
    yields = F.coalesce((F.col("strength") == RESERVED) & (F.col("above_strength") > RESERVED), F.lit(False))
    joined = joined.withColumns({c: F.when(~yields, F.col(c)) for c in ("own_license", "own_score")})
    origin = F.when(F.col("own_license").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return joined.select(
        F.col("key.v").alias(key), F.col("path").alias(path), "own_license", "own_score", F.coalesce("own_license", "inherited").alias("license"), origin.alias("origin"), F.when(origin == "inherited", F.col("up")).alias("up")
    )


def _tidy(directory: Column) -> Column:
    return F.array_join(F.array_remove(F.split(directory, "/"), ""), "/")
