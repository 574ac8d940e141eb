"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences; those that may belong to a licence are
normalised and looked up among known licence sentences. The identifiers found,
in order, are matched against rules: each rule is a sequence of identifiers, is
tried in its turn, and uses up what it matched.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import fresh, quoted

# Licence sentences in normal form (lower case, letters and digits only) and their identifiers.
SENTENCES = {
    "all rights reserved": "reserved",
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-ref",
    "you may not use this file except in compliance with the license": "apache2-use",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "this work is licensed under the gnu general public license version 2": "gpl2-ref",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-ref",
    "licensed under cc by 4 0": "ccby4-ref",
    "licensed under cc by sa 4 0": "ccbysa4-ref",
    "licensed under cc by nc 4 0": "ccbync4-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4-ref",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-ref",
    "this is free and unencumbered software released into the public domain": "unlicense-ref",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-ref",
}

# What a sentence like "this software is licensed under the ..." ends with.
TITLES = {
    "mit license": "mit-ref",
    "isc license": "isc-ref",
    "apache license": "apache2-ref",
    "apache license 2 0": "apache2-ref",
    "apache license version 2 0": "apache2-ref",
    "apache 2 0 license": "apache2-ref",
    "bsd 2 clause license": "bsd2-ref",
    "bsd 3 clause license": "bsd3-ref",
    "gnu general public license version 2": "gpl2-ref",
    "gnu general public license version 3": "gpl3-ref",
    "gnu lesser general public license version 2 1": "lgpl21-ref",
    "gnu lesser general public license version 3": "lgpl3-ref",
    "gnu affero general public license version 3": "agpl3-ref",
    "mozilla public license 2 0": "mpl2-ref",
    "mozilla public license version 2 0": "mpl2-ref",
    "eclipse public license 2 0": "epl2-ref",
    "eclipse public license version 2 0": "epl2-ref",
    "unlicense": "unlicense-ref",
}
SENTENCES |= {f"licensed under the {title}": identifier for title, identifier in TITLES.items()}

# A sentence that is not known as it is may be known in this form: without its subject, with one verb and one spelling.
FORMS = [
    (r"\blicence\b", "license"),
    (r"^(this|the) (software|project|program|work|file|code|library|package|source code|repository) is ", ""),
    (r"^(also )?(released|distributed|made available|available|provided|licensed) under (the )?(terms of )?(the )?", "licensed under the "),
]

# The same sentences as the official notices have them: joined, or with another address.
NOTICES = {
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache2-ref,apache2-use",
    "you may obtain a copy of the license at": "apache2-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache2-copy",
}

# The rules in their order; the earlier and longer go first.
RULES = [
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-warranty", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-warranty", "gpl-see"]),
    ("Apache-2.0", ["apache2-ref", "apache2-use", "apache2-copy", "apache2-asis", "apache2-see"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("AGPL-3.0-or-later", ["agpl3-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-later"]),
    ("LGPL-2.1-or-later", ["lgpl21-later"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-3.0-only", ["gpl3-ref"]),
    ("GPL-2.0-only", ["gpl2-ref"]),
    ("Apache-2.0", ["apache2-ref"]),
    ("MIT", ["mit-ref"]),
    ("MPL-2.0", ["mpl2-ref"]),
    ("CC-BY-4.0", ["ccby4-ref"]),
    ("CC-BY-SA-4.0", ["ccbysa4-ref"]),
    ("CC-BY-NC-4.0", ["ccbync4-ref"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("All-Rights-Reserved", ["reserved"]),
    ("BSD-3-Clause", ["bsd3-ref"]),
    ("BSD-2-Clause", ["bsd2-ref"]),
    ("ISC", ["isc-ref"]),
    ("LGPL-2.1-only", ["lgpl21-ref"]),
    ("LGPL-3.0-only", ["lgpl3-ref"]),
    ("AGPL-3.0-only", ["agpl3-ref"]),
    ("EPL-2.0", ["epl2-ref"]),
    ("Unlicense", ["unlicense-ref"]),
]

# A tag names its licence itself.
TAG = "spdx license identifier"
TAGS = {name: f"spdx-{name.lower()}" for name, _ in RULES if name != "All-Rights-Reserved"}
SENTENCES |= {f"{TAG} {name.lower().replace('-', ' ').replace('.', ' ')}": identifier for name, identifier in TAGS.items()}
RULES += [(name, [identifier]) for name, identifier in TAGS.items()]

# One of these is in every known sentence.
KEYWORDS = [
    "licen", "rights reserved", "redistribut", "permission", "warranties", "warranty", "waived", "permitted", "unencumbered",
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "\x01"  # stands between sentences
BARRIER = ",|,"  # takes the place of what a rule used up, and keeps apart what stood on its sides
# for the SQL: a sentence ends at a full stop and a blank, at an empty line, and where a new line starts with a capital
TAG_LINE = r"((?i:SPDX-License-Identifier)[ \t]*:[^\n]*)\n"
ENDS = [(TAG_LINE, 1), (r"([.!?])[ \t\r\n]+", 1), (r"\n[ \t\r]*\n", 0), (r"\n([ \t/*#;-]*[A-Z])", 2)]


def _wrapped() -> str:
    """A line end within a known sentence: the words around it follow each other there."""
    before: dict[str, set[str]] = {}
    for sentence in (*SENTENCES, *NOTICES):
        words = sentence.split()
        for first, second in zip(words, words[1:]):
            before.setdefault(second, set()).add(first)
    pairs = [rf"(?=[ \t/*#;-]*{second}\b)(?<=\b(?:{'|'.join(sorted(firsts))})[^a-zA-Z0-9\n]{{0,8}}\n)" for second, firsts in sorted(before.items())]
    return rf"(?i)\n(?:{'|'.join(pairs)})"


# The ends as they are in real notices, in their order: "v. 2.0" goes on, an address belongs to what stands
# above it, and a line that is wrapped within a known sentence goes on even before a capital.
CUTS = [
    (TAG_LINE, "$1" + MARK),
    (r"((?<!\b[vV])[.!?])[ \t\r\n]+", "$1" + MARK),
    (r"\n[ \t\r]*\n(?![ \t\r\n]*https?://)", MARK),
    (_wrapped(), " "),
    (r"\n([ \t/*#;-]*[A-Z])", MARK + "$1"),
]


def _mentions(text: Column) -> Column:
    found = F.lit(False)
    for word in KEYWORDS:
        found = found | F.contains(text, F.lit(word))
    return found


def _key(ids: list[str]) -> str:
    return "," + "".join(f"{i}," for i in ids)


def sentences(text: Column) -> Column:
    for pattern, to in CUTS:
        text = F.regexp_replace(text, pattern, to)
    return F.split(text, MARK, -1)


def with_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``sentence_ids`` in order, ``licenses`` by rule order, and ``n_unknown``; such columns are replaced.

    All are about the whole text. A sentence that speaks of a licence but is not
    known counts as unknown and stands between those around it. A null or empty
    text has empty strings and 0. Repeated rows are judged alike, each on its own.
    """
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable({**SENTENCES, **NOTICES}.items())])
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_key(ids)).alias("ids")) for name, ids in RULES])
    empty = F.array().cast("array<string>")

    def identify(sentence: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))
        form = plain
        for pattern, to in FORMS:
            form = F.regexp_replace(form, pattern, to)
        return F.coalesce(F.try_element_at(known, plain), F.try_element_at(known, form), F.lit("unknown"))

    def apply(state: Column, rule: Column) -> Column:
        fits = F.contains(state["left"], rule["ids"])
        left = F.when(fits, F.replace(state["left"], rule["ids"], F.lit(BARRIER))).otherwise(state["left"])
        found = F.when(fits & ~F.array_contains(state["found"], rule["name"]), F.array_append(state["found"], rule["name"]))
        return F.struct(left.alias("left"), F.coalesce(found, state["found"]).alias("found"))

    own_ids, own_found = fresh(docs, "own_ids", "own_found")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # few texts mention a licence, and only those are cut into sentences
    candidates = F.filter(sentences(text), lambda s: _mentions(F.translate(s, UPPER, LOWER)))
    ids = F.when(_mentions(F.translate(text, UPPER, LOWER)), F.transform(candidates, identify)).otherwise(empty)
    start = F.struct(F.concat(F.lit(","), F.concat_ws(",", own_ids), F.lit(",")).alias("left"), empty.alias("found"))
    found = F.when(F.size(own_ids) > 0, F.aggregate(rules, start, apply)["found"]).otherwise(empty)
    made = ["sentence_ids", "licenses", "n_unknown"]
    kept = [c for c in docs.columns if c.lower() not in made]
    return docs.withColumn(own_ids, ids).withColumn(own_found, found).select(
        *quoted(*kept),
        F.concat_ws(",", own_ids).alias("sentence_ids"),
        F.concat_ws(",", own_found).alias("licenses"),
        F.size(F.filter(own_ids, lambda i: i == "unknown")).cast("bigint").alias("n_unknown"),
    )


def oracle() -> str:
    """The same in DuckDB for notices whose sentences are not wrapped before capitals: one step per rule."""
    mark = "chr(1)"
    text = "coalesce(text, '')"
    for pattern, group in ENDS:
        to = {0: mark, 1: rf"'\1' || {mark}", 2: rf"{mark} || '\1'"}[group]
        pattern = pattern.replace("\n", "\\n")
        text = f"regexp_replace({text}, '{pattern}', {to}, 'g')"

    def mentions(column: str) -> str:
        return "(" + " OR ".join(f"contains(translate({column}, '{UPPER}', '{LOWER}'), '{w}')" for w in KEYWORDS) + ")"

    plain = f"trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    cases = " ".join(f"WHEN '{s}' THEN '{i}'" for s, i in SENTENCES.items())
    form = plain
    for pattern, to in FORMS:
        form = f"regexp_replace({form}, '{pattern}', '{to}')"
    steps, last = [], "start"
    for number, (name, ids) in enumerate(RULES):
        fits = f"contains(rest, '{_key(ids)}')"
        steps.append(
            f"s{number} AS (SELECT doc_id, ids, CASE WHEN {fits} THEN replace(rest, '{_key(ids)}', '{BARRIER}') ELSE rest END AS rest, "
            f"CASE WHEN {fits} AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found "
            f"FROM {last})"
        )
        last = f"s{number}"
    return f"""
WITH cut AS (
  SELECT doc_id, CASE WHEN {mentions("text")} THEN
    list_filter(string_split({text}, {mark}), lambda s: {mentions("s")}) ELSE [] END AS parts FROM documents),
named AS (
  SELECT doc_id, list_transform(parts, lambda s: coalesce(CASE {plain} {cases} END, CASE {form} {cases} END, 'unknown')) AS ids FROM cut),
start AS (
  SELECT doc_id, ids, ',' || array_to_string(ids, ',') || ',' AS rest, []::VARCHAR[] AS found FROM named),
{", ".join(steps)}
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(found, ',') AS licenses,
  len(list_filter(ids, lambda i: i = 'unknown'))::BIGINT AS n_unknown
FROM {last}"""
