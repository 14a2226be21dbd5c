"""License scans: passages against licence templates by the Dice coefficient over word bigrams.

Only DataFrame functions.  Texts are normalised (A-Z lower-cased, all but letters and digits parted),
and every line, every paragraph of several lines and every text of several paragraphs is a passage.
Two sets can reach a Dice coefficient t only if their sizes differ by a factor of at most (2 - t) / t;
so each template is listed under the sizes it can match, and an equi join on the size of a passage
finds its candidates.  A passage that matches shares so many bigrams with a template that it holds one of a
few words or bigrams of it: texts and passages without any of these are left out before bigrams are made,
which loses no match.  Templates are few and go to every task; documents are not shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TEMPLATES = 2000
SHORT = 4  # letters a word must have to be looked for alone

# Notices of public licences, as they are commonly stated.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.",
            "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
                   "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
                "later version."),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met:"),
    "ISC": ("Licensed under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def normalised(text: Column) -> Column:
    """Lower-cased letters and digits; anything between becomes one space, line breaks stay."""
    return F.lower(F.regexp_replace(text, r"[^a-zA-Z0-9\n]+", " "))


def bigrams(passage: Column) -> Column:
    """The distinct word bigrams of a normalised passage."""
    def pairs(words):
        return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
                          F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))

    return F.array_distinct(let(F.split(F.trim(F.regexp_replace(passage, "[ \n]+", " ")), " "), pairs))


def markers(templates: Mapping[str, tuple[str, ...]], least: float) -> list[str]:
    """Words and bigrams of which every passage with a Dice coefficient of ``least`` or more holds one.

    Of a template's g bigrams such a passage shares at least g * least / (2 - least), since it has no
    fewer bigrams than it shares.  So of its words, longest first, as many are taken as it needs for their
    bigrams to be more than a passage can lack.  Of words shorter than ``SHORT``, which many texts hold as
    parts of other words, the bigrams are taken themselves.
    """
    out: set[str] = set()
    for texts in templates.values():
        for text in texts:
            found = re.findall("[a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER)))
            grams = set(zip(found, found[1:]))
            may_lack = len(grams) - math.ceil(len(grams) * least / (2 - least) - 1e-9)
            words = sorted({w for w in found if len(w) >= SHORT}, key=lambda w: (-len(w), w))
            covered: set[tuple[str, str]] = set()
            for chosen in [*((w,) for w in words), *sorted(grams, key=lambda g: (-len("".join(g)), g))]:
                if len(covered) > may_lack:
                    break
                more = {g for g in grams if (chosen[0] in g if len(chosen) == 1 else chosen == g)}
                if more - covered:
                    out.add(" ".join(chosen))
                    covered |= more
    return sorted(w for w in out if not any(v != w and v in w for v in out))  # a word that holds another one is found with it


def marked(text: Column, words: list[str]) -> Column:
    """Whether a text, in any case, holds one of the words or bigrams."""
    hit = F.exists(F.array(F.lower(text)), lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words if " " not in w], F.lit(False)))
    pairs = "|".join("[^a-zA-Z0-9]+".join(w.split(" ")) for w in words if " " in w)
    return hit | text.rlike(f"(?i)(?:{pairs})") if pairs else hit


def template_table(spark: SparkSession, templates: Mapping[str, tuple[str, ...]], least: float) -> DataFrame:
    """(size, license, template, grams): a template once under every passage size it can match."""
    flat = [(name, k, text) for name, texts in templates.items() for k, text in enumerate(texts)]
    if len(flat) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("license"), F.lit(k).alias("template"), F.lit(t).alias("text")) for n, k, t in flat]))
    grams = spark.range(1).select(rows.alias("r")).select("r.license", "r.template", bigrams(normalised(F.col("r.text"))).alias("grams"))
    ratio = (2 - least) / least
    low, high = F.ceil(F.size("grams") / F.lit(ratio) - 1e-9), F.floor(F.size("grams") * F.lit(ratio) + 1e-9)
    return grams.filter(F.size("grams") > 0).select(F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("size"), "license", "template", "grams")


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.8,
         templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """(id, part, place, license, template, dice): each passage that matches, with its best template.

    ``part`` is line, paragraph or text; ``place`` counts from 0 within the document.  Of equal
    coefficients the first licence by name and its first template win.  Null and empty texts and
    passages of one word match nothing.  Every row is a document of its own, also those that repeat an id
    or have none; other columns are neither needed nor returned.
    """
    table = F.broadcast(template_table(docs.sparkSession, templates, least))
    words = markers(templates, least)
    likely = docs.select(F.col(id).alias("id"), F.col(text).alias("body")).filter(marked(F.col("body"), words))
    plain = likely.select(F.monotonically_increasing_id().alias("row"), "id", normalised(F.col("body")).alias("t"))

    def passages(kind, pieces):
        return F.transform(pieces, lambda p, i: F.struct(F.lit(kind).alias("part"), i.cast("long").alias("place"), p.alias("passage")))

    def longer(paragraphs):
        several = F.filter(passages("paragraph", paragraphs), lambda p: F.contains(p["passage"], F.lit("\n")))
        return F.concat(several, F.when(F.size(paragraphs) > 1, passages("text", F.array("t"))).otherwise(passages("text", F.array().cast("array<string>"))))

    every = F.concat(passages("line", F.split("t", "\n")), let(F.split("t", "\n *\n[ \n]*"), longer))
    parts = plain.select("row", "id", F.explode(F.filter(every, lambda p: marked(p["passage"], words))).alias("p"))
    # all bigrams are made inside the generator, so that no filter of the join on their number makes them again
    made = F.explode(F.array(F.struct("p.part", "p.place", bigrams(F.col("p.passage")).alias("own")))).alias("p")
    sized = parts.select("row", "id", made).select("row", "id", "p.part", "p.place", "p.own", F.size("p.own").alias("size"))
    dice = 2.0 * F.size(F.array_intersect("own", "grams")) / (F.col("size") + F.size("grams"))
    found = sized.join(table, "size").select("row", "id", "part", "place", "license", "template", dice.alias("dice")).filter(F.col("dice") >= least)
    best = found.groupBy("row", "id", "part", "place").agg(F.min(F.struct((-F.col("dice")).alias("d"), "license", "template")).alias("b"))
    return best.select(F.col("id").alias(id), "part", "place", "b.license", "b.template", (-F.col("b.d")).alias("dice"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def scan_sql(least: float = 0.8) -> str:
    """The same over the table ``documents`` with every passage against every template."""
    flat = ", ".join(f"({_text(n)}, {k}, {_text(t)})" for n, texts in TEMPLATES.items() for k, t in enumerate(texts))
    norm = f"regexp_replace(translate({{0}}, '{_UPPER}', '{_LOWER}'), '[^a-z0-9\\n]+', ' ', 'g')"
    words = "string_split(trim(regexp_replace({0}, '[ \\n]+', ' ', 'g'), ' '), ' ')"
    return f"""WITH t AS (SELECT license, template, {words.format(norm.format('text'))} AS w
  FROM (VALUES {flat}) AS v(license, template, text)),
 d AS (SELECT row_number() OVER () AS row, doc_id, {norm.format('text')} AS t FROM documents WHERE text IS NOT NULL),
 para AS (SELECT row, doc_id, t, regexp_split_to_array(t, '\\n *\\n[ \\n]*') AS ps FROM d),
 p AS (SELECT row, doc_id, 'line' AS part, unnest(range(len(string_split(t, chr(10))))) AS place, unnest(string_split(t, chr(10))) AS passage FROM d
  UNION ALL SELECT * FROM (SELECT row, doc_id, 'paragraph' AS part, unnest(range(len(ps))) AS place, unnest(ps) AS passage FROM para)
   WHERE contains(passage, chr(10))
  UNION ALL SELECT row, doc_id, 'text', 0, t FROM para WHERE len(ps) > 1),
 pw AS (SELECT row, doc_id, part, place, {words.format('passage')} AS w FROM p),
 pg AS (SELECT row, doc_id, part, place, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM pw),
 tg AS (SELECT license, template, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS h FROM t),
 m AS (SELECT row, doc_id, part, place, license, template, 2.0 * len(list_intersect(g, h)) / (len(g) + len(h)) AS dice
  FROM pg JOIN tg ON len(g) BETWEEN len(h) / 3.0 AND len(h) * 3.0)
 SELECT doc_id, part, place, license, CAST(template AS INTEGER) AS template, CAST(dice AS DOUBLE) AS dice FROM m WHERE dice >= {least}
 QUALIFY row_number() OVER (PARTITION BY row, part, place ORDER BY dice DESC, license, template) = 1"""
