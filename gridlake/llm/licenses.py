"""License scans with DataFrame functions only.

Lines that hold a license cue are compared with license templates by the cosine of their TF-IDF vectors.  A text's best
line above ``LEAST`` names its license.  Runs of 2 to ``LONGEST`` lines around a cue, joined, are compared as well, so that wrapped headers
count; comment marks are no terms.  An SPDX line names its license by identifier.  Files without one inherit from the licence file in their nearest ancestor directory, by joins on directory paths.

Templates are fixed and few, so their weights stand in the plan as literals; nothing is exploded per word.  Directories
are made distinct before they are joined, so a directory with a third of the files costs one row there.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.6
#: The notices that name a license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause notice": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause notice": "Released under the BSD 2-Clause License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "ISC notice": "Released under the ISC License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
CUE = "(?i)licen[cs]|permission is hereby granted|permission to use, copy, modify|redistribution and use in source|free and unencumbered software"
#: A cue that may be wrapped over lines.
WRAPPED_CUE = CUE.replace(" ", r"\W+")
LONGEST = 6
#: Templates have up to 200 characters; a longer run than this has too many other words to come near one.
RUN_CHARS = 1200
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([^\r\n]+)"
#: Identifiers of one license besides its name.
IDENTIFIERS = {f"{name.lower()}{form}": name for name in ("GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0") for form in ("-only", "-or-later", "+")}
LICENCE_FILE = "(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"


def terms(text: str) -> list[str]:
    return re.findall("[a-z]+|[0-9]+", text.lower())


def weights() -> tuple[dict[str, float], float, dict[str, dict[str, float]]]:
    """Inverse document frequency of template terms and of any other term, and each template's unit vector."""
    counts = {k: Counter(terms(v)) for k, v in TEMPLATES.items()}
    frequency = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in frequency.items()}
    vectors = {}
    for name, c in counts.items():
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        vectors[name] = {t: n * idf[t] / norm for t, n in c.items()}
    return idf, math.log(1 + len(counts)) + 1, vectors


def best_match(line: Column) -> Column:
    """struct(score, name) of the template nearest to a line."""
    idf, other, vectors = weights()
    known = F.create_map(*[F.lit(x) for t, w in idf.items() for x in (t, w)])
    words = F.regexp_extract_all(F.lower(line), F.lit("[a-z]+|[0-9]+"), F.lit(0))
    # (term, count, weight) of the line
    counted = F.transform(F.array_distinct(words), lambda t: F.struct(t.alias("t"), (F.size(F.filter(words, lambda x: x == t)) * F.coalesce(known[t], F.lit(other))).alias("w")))

    def dot(found: Column, vector: dict[str, float]) -> Column:
        weight = F.create_map(*[F.lit(x) for t, w in vector.items() for x in (t, w)])
        return F.aggregate(found, F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(weight[x["t"]], F.lit(0.0)))

    def scored(found: Column) -> Column:
        norm = F.sqrt(F.aggregate(found, F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
        one = [F.struct(F.round(F.when(norm > 0, dot(found, v) / norm).otherwise(0.0), 6).alias("score"), F.lit(name.removesuffix(" notice")).alias("name")) for name, v in vectors.items()]
        return F.array_max(F.array(*one))

    return F.transform(F.array(counted), scored)[0]


def runs(text: Column) -> Column:
    """Joined runs of lines that hold a cue, also one that is wrapped."""

    def of(lines: Column) -> Column:
        joined = lambda start, n: F.array_join(F.slice(lines, start, n), " ")
        cued = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: joined(i, F.lit(2)).rlike(WRAPPED_CUE))
        starts = F.array_distinct(F.flatten(F.transform(cued, lambda i: F.sequence(F.greatest(F.lit(1), i - LONGEST + 1), F.least(F.size(lines), i + 1)))))
        found = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), F.lit(LONGEST)), lambda n: joined(i, n))))
        return F.filter(F.array_distinct(found), lambda x: (F.length(x) <= RUN_CHARS) & x.rlike(WRAPPED_CUE))

    return F.transform(F.array(F.split(text, "\n")), of)[0]


def identified(text: Column) -> Column:
    """struct(score, name) for each SPDX line: the first license of its expression that has a template."""
    known = {k.removesuffix(" notice").lower(): k.removesuffix(" notice") for k in TEMPLATES} | IDENTIFIERS
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    ids = lambda x: F.transform(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9.+-]+"), F.lit(0)), lambda i: names[i])
    first = F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), lambda x: F.get(F.filter(ids(x), lambda i: i.isNotNull()), F.lit(0)))
    return F.transform(F.filter(first, lambda i: i.isNotNull()), lambda i: F.struct(F.lit(1.0).alias("score"), i.alias("name")))


def scan(files: DataFrame, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row per row of ``files``: id, path, ``own_license``, ``own_score``, ``license``, ``inherited_from``.

    ``license`` is the own one, else that of the licence file (by name) in the nearest directory at or above the file's;
    several licence files in a directory: the highest score, then the first name.  ``inherited_from`` is that directory (``""`` is the top).  A null text has no own license,
    a null path has no directory and inherits nothing.  Licenses that tie in a text: the last by name.  Repeated rows give repeated results, very long texts are
    scanned whole, an empty table gives an empty result, and further columns of any name are ignored.
    """
    f = files.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{path_col}`").alias("path"), F.col(f"`{text_col}`").alias("text"))
    lines = F.concat(F.filter(F.split("text", "\n"), lambda x: x.rlike(CUE)), runs(F.col("text")))
    found = F.concat(F.transform(F.array_distinct(lines), best_match), identified(F.col("text")))
    best = F.when(F.col("text").rlike(WRAPPED_CUE), F.array_max(found))
    own = f.select("id", "path", best.alias("best")).select("id", "path", F.when(F.col("best.score") >= least, F.col("best.name")).alias("own_license"), F.coalesce(F.col("best.score"), F.lit(0.0)).alias("own_score"))
    own = own.withColumn("dir", F.when(F.col("path").isNotNull(), F.regexp_replace("path", "/?[^/]*$", "")))

    declared = own.where(F.col("path").rlike(LICENCE_FILE) & F.col("own_license").isNotNull()).groupBy("dir")
    declared = declared.agg(F.max(F.col("own_score")).alias("top"), F.min_by("own_license", F.struct(-F.col("own_score"), "own_license")).alias("found")).select(F.col("dir").alias("above"), "found")
    dirs = own.where("dir is not null").select("dir").distinct()
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    upward = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("above"))
    nearest = upward.join(declared, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "found")).alias("at")).select("dir", "at.above", "at.found")
    joined = own.join(nearest, "dir", "left")
    return joined.select("id", "path", "own_license", "own_score", F.coalesce("own_license", "found").alias("license"), F.when(F.col("own_license").isNull(), F.col("above")).alias("inherited_from"))
