"""License notices by the Dice coefficient over word bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, free_name

#: Wordings of common license notices. Fixed values.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "All-rights-reserved": "All rights reserved.",
}


def words_in(text: str) -> list[str]:
    """Normalised words of a template, as ``words`` takes them from a column."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split()


def bigrams_in(text: str) -> list[str]:
    w = words_in(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and characters beyond ASCII."""
    low = F.translate(text, UPPER, LOWER)
    return F.filter(F.split(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " "), lambda w: w != "")


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, text: str = "text") -> DataFrame:
    """Add n_licenses, license, dice and matches to each document, from its lines and the text as a whole.

    A unit (a line, or the whole text) matches a template when 2 * common / (size + size) of their distinct word bigrams is
    ``least`` or more. Only a unit whose size lies between least / (2 - least) and (2 - least) / least of a template's can
    match it, so most lines are dropped by a word count before any bigram is built. ``matches`` lists (license, dice,
    line), line from 0 and -1 for the whole text; ``license`` is the best of them, ties to the smaller name. Row-local, native.

    A null or empty text, and a unit of fewer than two words, matches nothing: n_licenses 0, license and dice null.
    Repeated rows are treated alike; other columns stay, and columns of the four names are replaced.
    """
    bags = {name: bigrams_in(t) for name, t in (NOTICES if templates is None else templates).items()}
    bags = {name: b for name, b in sorted(bags.items()) if b}
    kind = "array<struct<license:string,dice:double,line:int>>"
    if not bags:
        return docs.withColumns({"n_licenses": F.lit(0), "license": F.lit(None).cast("string"), "dice": F.lit(None).cast("double"), "matches": F.array().cast(kind)})
    low, high = least / (2 - least), (2 - least) / least
    sizes = [len(b) for b in bags.values()]
    floor = min(sizes) * low + 1 - 1e-9  # a unit of n words has n - 1 bigrams at most
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.transform(F.split(body, "\n"), lambda x, i: F.struct(x.alias("s"), i.cast("int").alias("line")))
    # a unit holds two characters for each word but one at least; a line far too short is no unit
    lines = F.filter(lines, lambda u: F.length(u["s"]) >= 2 * floor - 1)
    many = F.size(F.split(body, "\n")) > 1
    units = F.concat(lines, F.when(many, F.array(F.struct(body.alias("s"), F.lit(-1).alias("line")))).otherwise(F.array().cast("array<struct<s:string,line:int>>")))
    units = F.transform(units, lambda u: F.struct(words(u["s"]).alias("w"), u["line"].alias("line")))
    # distinct bigrams may be fewer than words, so only the floor is tested on words
    units = F.filter(units, lambda u: F.size(u["w"]) >= floor)

    def pairs(w: Column) -> Column:
        return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))

    held, top = free_name(docs, "_bigrams", "_best")
    bigrams = F.transform(units, lambda u: F.struct(pairs(u["w"]).alias("b"), u["line"].alias("line")))
    bigrams = F.filter(bigrams, lambda u: (F.size(u["b"]) >= min(sizes) * low - 1e-9) & (F.size(u["b"]) <= max(sizes) * high + 1e-9))

    def against(name: str, bag: list[str]) -> Column:
        near = F.filter(F.col(held), lambda u: (F.size(u["b"]) >= len(bag) * low - 1e-9) & (F.size(u["b"]) <= len(bag) * high + 1e-9))
        scored = F.transform(
            near,
            lambda u: F.struct(
                F.lit(name).alias("license"),
                (F.lit(2.0) * F.size(F.array_intersect(u["b"], F.array(*map(F.lit, bag)))) / (F.size(u["b"]) + F.lit(len(bag)))).alias("dice"),
                u["line"].alias("line"),
            ),
        )
        return F.filter(scored, lambda m: m["dice"] >= least)

    # a column of its own: the bigrams are built once, each template looks at the few units that are left
    hit = docs.withColumn(held, bigrams).withColumn("matches", F.concat(*[against(n, b) for n, b in bags.items()])).drop(held)
    best = F.reduce(
        F.col("matches"),
        F.struct(F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("dice")),
        lambda a, m: F.when(a["dice"].isNull() | (m["dice"] > a["dice"]), F.struct(m["license"].alias("license"), m["dice"].alias("dice"))).otherwise(a),
    )
    hit = hit.withColumn("n_licenses", F.size("matches")).withColumn(top, best)
    return hit.withColumns({"license": F.col(f"{top}.license"), "dice": F.col(f"{top}.dice")}).drop(top)
