"""License scans: sparse TF-IDF cosine against templates, then inheritance along paths. Column expressions alone."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, lookup

#: For each license the statements that headers use, and openings of its text for licence files.
TEMPLATES = {
    "0BSD": ("BSD Zero Clause License", "SPDX-License-Identifier: 0BSD"),
    "AGPL-3.0": (
        "GNU Affero General Public License Version 3, 19 November 2007",
        "Licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License",
        "Apache License Version 2.0, January 2004 terms and conditions for use, reproduction, and distribution",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License",
        "BSD 2-Clause Simplified License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License",
        "BSD 3-Clause New or Revised License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0-1.0": ("Released under CC0 1.0 Universal, public domain dedication", "Licensed under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"),
    "EPL-2.0": (
        "Eclipse Public License version 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version",
        "GNU General Public License Version 2, June 1991",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "GNU General Public License Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "ISC": (
        "ISC License",
        "Licensed under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "SPDX-License-Identifier: ISC",
    ),
    "LGPL-2.1": (
        "GNU Lesser General Public License Version 2.1, February 1999",
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "LGPL-3.0": (
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "Licensed under the GNU Lesser General Public License, version 3",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "MIT": (
        "Released under the MIT License",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "Proprietary": ("All rights reserved", "Copyright. All rights reserved. Unauthorized copying of this file is prohibited"),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
        "Released under the Unlicense",
        "SPDX-License-Identifier: Unlicense",
    ),
    "Zlib": (
        "The zlib License",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        "SPDX-License-Identifier: Zlib",
    ),
}
#: What must stand in a statement before it counts for a license, and what must not, over its words with blanks between.
#: Templates of one family differ by a word or two; these are those words. ``third`` and ``second`` stand for clauses of the
#: BSD licenses that the whole text has.
_TWO, _THREE = r"\b(version|v|l?gpl) 2\b|\bl?(gpl)?v2\b", r"\b(version|v|[al]?gpl) 3\b|\b([al]?gpl)?v3\b"
_OTHER_GPL = "lesser|library general|affero|lgpl|agpl"
TELLS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "0BSD": ((r"zero clause|\b0bsd\b",), ()),
    "AGPL-3.0": (("affero|agpl", _THREE), ()),
    "Apache-2.0": (("apache", r"\b2 0\b|version 2\b|\bv2\b"), ()),
    "BSD-2-Clause": ((r"\b2 clause|redistribution.* #second",), (r"\b3 clause", "redistribution.* #third")),
    "BSD-3-Clause": ((r"\b3 clause|redistribution.* #third",), (r"\b2 clause",)),
    "CC-BY-4.0": ((r"\bcc by\b|attribution", r"\b4 0\b"), (r"\b(nc|sa|nd)\b|non ?commercial|share ?alike|no ?deriv",)),
    "CC-BY-NC-4.0": ((r"\bnc\b|non ?commercial", r"\b4 0\b"), (r"\b(sa|nd)\b|share ?alike|no ?deriv",)),
    "CC-BY-SA-4.0": ((r"\bsa\b|share ?alike", r"\b4 0\b"), (r"\b(nc|nd)\b|non ?commercial|no ?deriv",)),
    "CC0-1.0": ((r"\bcc0\b",), ()),
    "EPL-2.0": (("eclipse|epl", r"\b2 0\b|version 2\b|\bv2\b"), ()),
    "GPL-2.0": (("general public|gpl", _TWO), (_OTHER_GPL,)),
    "GPL-3.0": (("general public|gpl", _THREE), (_OTHER_GPL,)),
    "ISC": ((r"\bisc\b|provided that the above copyright notice",), ()),
    "LGPL-2.1": (("lesser|lgpl", r"\b2 1\b"), ("affero",)),
    "LGPL-3.0": (("lesser|lgpl", _THREE), ("affero",)),
    "MIT": ((r"\bmit\b|free of charge",), ()),
    "MPL-2.0": ((r"mozilla|\bmpl\b", r"\b2 0\b|version 2\b|\bv2\b"), ()),
    "Proprietary": (("rights reserved|unauthorized copying",), ()),
    "Unlicense": (("unencumbered|unlicense|sell or distribute",), ()),
    "Zlib": ((r"\bzlib\b|liable for any damages",), ()),
}
#: The BSD clauses in a whole text, whatever stands between words at the ends of lines.
SECOND_CLAUSE, THIRD_CLAUSE = "binary[^a-z0-9]+form[^a-z0-9]+must[^a-z0-9]+reproduce", "endorse[^a-z0-9]+or[^a-z0-9]+promote"
#: Stands beside many licenses, so that it counts only where no other is stated.
WEAKEST = "Proprietary"
#: Lines that a statement may be wrapped over.
WRAPPED = 6
#: Names of files whose license holds for their directory.
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([-._][^/]*)?$"
SIMILAR = 0.7


def tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def words(text: Column) -> Column:
    """The same for a column; null has none."""
    return F.array_remove(F.split(F.coalesce(F.lower(text), F.lit("")), r"[^a-z0-9]+"), "")


def vocabulary() -> list[str]:
    return sorted({t for group in TEMPLATES.values() for line in group for t in tokens(line)})


def constant(value, kind: str) -> Column:
    """A literal of a nested type, which the optimizer reads once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def literal(terms) -> Column:
    return constant(list(terms), "array<string>")


def term_frequencies(docs: DataFrame, text: str) -> tuple[int, dict[str, int]]:
    """Documents, and documents with each word of the templates, over whole texts of all of them."""
    found = F.array_intersect(words(F.col(text)), literal(vocabulary()))
    rows = docs.select(F.explode(F.array_append(found, F.lit(""))).alias("w")).groupBy("w").count().collect()
    counts = {r["w"]: r["count"] for r in rows}  # at most as many rows as the templates have words
    return counts.pop("", 0), counts


class Vectors:
    """idf of the templates' words, unit vectors of the templates, and what shows that a text is like none of them.

    By Cauchy's inequality a text is similar to a template only if the words they share carry at least similar^2 of the
    template's squared weights. A template's lightest words fall short of that even all together; the others are its
    anchors, and a text without an anchor of any template needs no look at all.
    """

    def __init__(self, total: int, found: dict[str, int], similar: float):
        self.total, self.similar = total, similar
        self.idf = {t: math.log((1 + total) / (1 + found.get(t, 0))) + 1 for t in vocabulary()}
        self.templates: list[tuple[str, dict[str, float]]] = []
        for name, group in TEMPLATES.items():
            for line in group:
                own = {t: tokens(line).count(t) * self.idf[t] for t in tokens(line)}
                norm = math.sqrt(sum(x * x for x in own.values()))
                self.templates.append((name, {t: x / norm for t, x in own.items()}))
        self.least = similar * similar - 1e-9
        self.anchors: set[str] = set()
        for _, own in self.templates:
            carried = 0.0
            for t, x in sorted(own.items(), key=lambda item: (item[1], item[0])):
                carried += x * x
                if carried >= self.least:
                    self.anchors.add(t)

    def covered(self, present: Column) -> Column:
        """Whether a set of words of the templates carries enough of one template."""
        n = len(self.templates)
        squares = constant({t: [own.get(t, 0.0) ** 2 for _, own in self.templates] for t in self.idf}, "map<string,array<double>>")
        nothing = constant([0.0] * n, "array<double>")
        return F.array_max(F.aggregate(present, nothing, lambda a, t: F.zip_with(a, F.element_at(squares, t), lambda x, y: x + y))) >= self.least

    def best(self, bag: Column, clauses: Column) -> Column:
        """struct(rank, score, place) of the template most similar to an array of words, of those that the words tell apart
        (``TELLS``); null if none reaches ``similar``. ``place`` counts down in order of name, so that ties go to the first.
        Words that no template has carry the idf of a word in no document."""
        rare = math.log(1 + self.total) + 1
        weights = constant(self.idf, "map<string,double>")
        known = literal(self.idf)
        many = lambda w, t: (F.size(w) - F.size(F.array_remove(w, t))).cast("double")
        place = {name: -i for i, name in enumerate(sorted(TEMPLATES))}
        table = constant([{"place": place[name], "v": own} for name, own in self.templates], "array<struct<place:int,v:map<string,double>>>")
        # the square of a count is the sum of the odd numbers up to it: one pass over the sorted words, however many
        first = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(0.0).alias("all"))
        step = lambda a, t, n: F.struct(t.alias("t"), n.alias("n"), (a["all"] + 2 * n - 1).alias("all"))

        def weighed(w: Column) -> Column:
            pairs = F.transform(F.array_intersect(w, known), lambda t: F.struct(t.alias("t"), (many(w, t) * F.element_at(weights, t)).alias("x")))
            others = F.aggregate(F.array_sort(F.filter(w, lambda t: ~F.array_contains(known, t))), first, lambda a, t: step(a, t, F.when(a["t"] == t, a["n"] + 1).otherwise(F.lit(1))), lambda a: a["all"])
            return F.struct(pairs.alias("pairs"), (others * rare * rare).alias("others"), F.concat(F.array_join(w, " "), clauses).alias("said"))

        def scored(p: Column) -> Column:
            norm = F.sqrt(F.aggregate(p["pairs"], F.lit(0.0), lambda a, x: a + x["x"] * x["x"]) + p["others"])
            dot = lambda own: F.aggregate(p["pairs"], F.lit(0.0), lambda a, x: a + x["x"] * F.coalesce(F.element_at(own["v"], x["t"]), F.lit(0.0)))
            near = F.filter(F.transform(table, lambda own: F.struct(F.round(dot(own) / norm, 9).alias("score"), own["place"].alias("place"))), lambda x: x["score"] >= self.similar)
            rank = lambda x: F.when(x["place"] == place[WEAKEST], 0).otherwise(1)
            return F.array_max(F.transform(F.filter(near, lambda x: told(x["place"], p["said"])), lambda x: F.struct(rank(x).alias("rank"), x["score"].alias("score"), x["place"].alias("place"))))

        def told(at: Column, said: Column) -> Column:
            out = F.lit(False)
            for name, (needs, nevers) in TELLS.items():
                fits = F.lit(True)
                for x in needs:
                    fits = fits & said.rlike(x)
                for x in nevers:
                    fits = fits & ~said.rlike(x)
                out = F.when(at == place[name], fits).otherwise(out)
            return out

        return F.get(F.transform(F.transform(F.array(bag), weighed), scored), 0)


def stated(docs: DataFrame, path: str = "path", text: str = "text", similar: float = SIMILAR, top: str = "top", own: str = "own") -> DataFrame:
    """All columns of docs and ``top``, ``own``: score and license of the most similar lines or text, null below ``similar``.

    Every run of up to WRAPPED lines is a candidate, and so is a licence file's whole text. Documents and runs that can't
    be similar to any template by the words they share with it are left out before anything is scored. A template counts
    only if the words that tell its license from its relatives stand in the run, and WEAKEST only where nothing else does.
    """
    v = Vectors(*term_frequencies(docs, text), similar)
    known, anchors = literal(v.idf), literal(sorted(v.anchors))
    is_file = F.coalesce(F.col(path).rlike(FILE_NAME), F.lit(False))
    [present, bags, best] = free([*docs.columns, top, own], "present", "bags", "best")
    possible = lambda p: F.when(F.arrays_overlap(p, anchors), v.covered(p)).otherwise(False)
    marked = docs.withColumn(present, F.array_intersect(words(F.col(text)), known))

    weights = constant(v.idf, "map<string,double>")
    rare = (math.log(1 + v.total) + 1) ** 2

    def size_of(x: Column) -> Column:
        """struct(q, o): the length of a line's words that templates have, and a bound from below for the square of the others'."""
        many = lambda t: (F.size(x["w"]) - F.size(F.array_remove(x["w"], t))).cast("double")
        step = lambda a, t: F.struct((a["q"] + F.pow(many(t) * F.element_at(weights, t), F.lit(2))).alias("q"), (a["n"] + many(t)).alias("n"))
        return F.aggregate(x["p"], F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("n")), step, lambda a: F.struct(F.sqrt(a["q"]).alias("q"), ((F.size(x["w"]) - a["n"]) * rare).alias("o")))

    def runs(lines: Column) -> Column:
        """Words of every run of lines that begins with a word of the templates and may be similar to one.

        Such a run has a line with an anchor. Of a run whose lines have q and o the words that templates have are no longer
        than the sum of all q, and the others no shorter than the root of the sum of all o; where even that falls short of
        ``similar``, as beside a line of prose, the run isn't looked at.
        """
        mine = F.transform(F.transform(lines, lambda w: F.struct(w.alias("w"), F.array_intersect(w, F.col(present)).alias("p"))), lambda x: F.struct(x["w"].alias("w"), x["p"].alias("p"), F.arrays_overlap(x["p"], anchors).alias("a")))

        def sized(rows: Column) -> Column:
            near = lambda i: F.exists(F.slice(rows, F.greatest(i + 2 - WRAPPED, F.lit(1)), 2 * WRAPPED - 1), lambda y: y["a"])
            return F.transform(rows, lambda x, i: F.struct(x["w"].alias("w"), x["p"].alias("p"), x["a"].alias("a"), F.when(near(i), size_of(x)).alias("size")))

        def of(rows: Column) -> Column:
            held = lambda i, n: F.array_distinct(F.flatten(F.transform(F.slice(rows, i + 1, n), lambda x: x["p"])))

            def reaches(i: Column, n: Column) -> Column:
                whole = F.aggregate(
                    F.slice(rows, i + 1, n), F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("o"), F.lit(False).alias("a")),
                    lambda a, x: F.struct((a["q"] + x["size"]["q"]).alias("q"), (a["o"] + x["size"]["o"]).alias("o"), (a["a"] | x["a"]).alias("a")),
                    lambda a: a["a"] & (a["q"] * a["q"] * (1 - v.least) >= v.least * a["o"] * (1 - 1e-9)),
                )
                return F.coalesce(whole, F.lit(False))

            starts = F.filter(F.transform(rows, lambda x, i: F.when((F.size(x["p"]) > 0) & F.exists(F.slice(rows, i + 1, WRAPPED), lambda y: y["a"]), i)), lambda i: i.isNotNull())
            one = lambda i, n: F.when(F.when(reaches(i, n), possible(held(i, n))).otherwise(False), F.flatten(F.transform(F.slice(rows, i + 1, n), lambda x: x["w"])))
            some = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.lit(WRAPPED)), lambda n: one(i, n))))
            return F.array_distinct(F.filter(some, lambda w: w.isNotNull()))

        return F.get(F.transform(F.transform(F.array(mine), sized), of), 0)

    lines = F.transform(F.split(F.col(text), "\n", -1), words)
    empty = F.array().cast("array<array<string>>")
    marked = marked.withColumn(bags, F.when(possible(F.col(present)), F.concat(F.get(F.transform(F.array(lines), runs), 0), F.when(is_file, F.array(words(F.col(text)))).otherwise(empty))))
    low = F.lower(F.col(text))
    clauses = F.concat(F.when(low.rlike(SECOND_CLAUSE), " #second").otherwise(""), F.when(low.rlike(THIRD_CLAUSE), " #third").otherwise(""))
    found = F.get(F.transform(F.array(clauses), lambda c: F.array_max(F.transform(F.col(bags), lambda w: v.best(w, c)))), 0)
    marked = marked.withColumn(best, F.when(F.size(bags) > 0, found))
    return marked.select(*docs.columns, F.col(best)["score"].alias(top), F.element_at(literal(sorted(TEMPLATES)), 1 - F.col(best)["place"]).alias(own))


def inherit(marked: DataFrame, total: int, path: str = "path", top: str = "top", own: str = "own") -> DataFrame:
    """Columns of docs and the result, from what ``stated`` returns; ``marked`` is read several times, its text not."""
    columns = [c for c in marked.columns if c not in (top, own)]
    names = ("license", "license_score", "license_from", "inherited_from")
    folder, need, rule, rule_dir, files, depth, best = free([*marked.columns, *names], "folder", "need", "rule", "rule_dir", "files", "depth", "best")
    parent = F.when(F.col(path).contains("/"), F.regexp_replace(F.col(path), r"/[^/]*$", "")).otherwise(F.when(F.col(path).isNotNull(), ""))
    marked = marked.withColumn(folder, parent)
    is_file = F.coalesce(F.col(path).rlike(FILE_NAME), F.lit(False))
    rules = marked.where(is_file & F.col(own).isNotNull()).groupBy(F.col(folder).alias(rule_dir)).agg(F.min(own).alias(rule))
    # distinct directories of documents, with all their ancestors, meet the rules; the longest wins
    dirs = marked.where(F.col(own).isNull() & F.col(folder).isNotNull()).groupBy(folder).agg(F.count("*").alias(files))
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    steps = dirs.select(folder, files, F.posexplode(F.array_distinct(above)).alias(depth, rule_dir))
    nearest = steps.join(rules, rule_dir).groupBy(folder, files).agg(F.max(F.struct(depth, rule_dir, rule)).alias(best))
    nearest = nearest.select(F.col(folder).alias(need), files, F.col(best)[rule].alias(rule), F.col(best)[rule_dir].alias(rule_dir))
    out = lookup(marked.withColumn(need, F.when(F.col(own).isNull(), F.col(folder))), nearest, need, files, total)
    kind = F.when(F.col(own).isNotNull(), F.when(is_file, "file").otherwise("header")).when(F.col(rule).isNotNull(), "inherited")
    return out.select(*columns, F.coalesce(own, rule).alias("license"), F.col(top).alias("license_score"), kind.alias("license_from"), F.col(rule_dir).alias("inherited_from"))


def scan(docs: DataFrame, path: str = "path", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """All columns of docs and license, license_score, license_from (header, file, inherited or null), inherited_from.

    Every run of up to ``WRAPPED`` lines of the whole text that begins with a word of a template is compared with the
    templates, and so is the whole text of a file named like a licence file; the document's license is the one of its
    most similar run, if the cosine reaches ``similar`` and the run has the words that tell the license from its relatives
    (versions, "lesser", "affero", clauses); without them it has none. Reserved rights count where nothing else is stated. A licence file gives its license to its directory. Documents
    without a license of their own take that of the nearest directory above, by equi-joins of directories: one row for
    each distinct directory, not for each document.

    Null text: no license of its own. Null path: nothing inherited. Ties: the license first in order of name, and for
    two licence files of one directory likewise. Long texts are scanned whole; repeated rows alike. Empty tables stay
    empty. Columns of docs named like a result are dropped first.
    """
    names = ("license", "license_score", "license_from", "inherited_from")
    docs = docs.select(*[c for c in docs.columns if c.lower() not in names])
    top, own = free(docs.columns, "top", "own")
    return inherit(stated(docs, path, text, similar, top, own), docs.count(), path, top, own)
