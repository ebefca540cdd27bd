"""License scans by sentence rules: known sentences become identifiers, ordered identifiers become licences.

DataFrame functions only.  The sentences and rules are small fixed tables, so
they are broadcast.  A sentence may be wrapped over lines; every line of it is
looked up by itself as well, so that titles without a full stop count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm.common import ascii_lower, require

#: Creative Commons: short name and the words of the long one.
CC = (
    ("by", "attribution"),
    ("by-sa", "attribution sharealike"),
    ("by-nc", "attribution noncommercial"),
    ("by-nd", "attribution noderivatives"),
    ("by-nc-sa", "attribution noncommercial sharealike"),
    ("by-nc-nd", "attribution noncommercial noderivatives"),
)
#: Identifier, licence and the names by which notice lines call it.
NAMED = (
    ("mit-name", "MIT", ("the mit license",)),
    ("apache2-name", "Apache-2.0", ("the apache license version 2 0", "the apache license 2 0", "the apache 2 0 license")),
    ("gpl3-name", "GPL-3.0", ("the gnu general public license version 3", "the gnu general public license v3 0", "the gnu gpl v3", "the gpl v3")),
    ("gpl2-name", "GPL-2.0", ("the gnu general public license version 2", "the gnu general public license v2 0", "the gnu gpl v2", "the gpl v2")),
    ("lgpl3-name", "LGPL-3.0", ("the gnu lesser general public license version 3", "the gnu lgpl v3", "the lgpl v3")),
    ("lgpl21-name", "LGPL-2.1", ("the gnu lesser general public license version 2 1", "the gnu lgpl v2 1", "the lgpl v2 1")),
    ("mpl2-name", "MPL-2.0", ("the mozilla public license version 2 0", "the mozilla public license 2 0", "the mpl 2 0")),
    ("isc-name", "ISC", ("the isc license",)),
    ("bsd2-name", "BSD-2-Clause", ("the bsd 2 clause license", "the 2 clause bsd license", "the simplified bsd license")),
    ("bsd3-name", "BSD-3-Clause", ("the bsd 3 clause license", "the 3 clause bsd license", "the new bsd license")),
    ("cc0-name", "CC0-1.0", ("cc0 1 0", "cc0 1 0 universal", "the creative commons cc0 1 0 universal license")),
    *(
        (
            f"cc-{short}-name" if v == 4 else f"cc-{short}-{v}-name",
            f"CC-{short.upper()}-{v}.0",
            tuple(
                f"{the}{name}"
                for name in (f"cc {short.replace('-', ' ')} {v} 0", f"creative commons {words} {v} 0 {kind} license", f"creative commons {words} {v} 0 {kind}", f"creative commons {words} {v} 0 license")
                for the in (("", "a ", "the ") if name.startswith("creative") else ("", "the "))
            ),
        )
        for v, kind in ((4, "international"), (3, "unported"))
        for short, long in CC
        for words in (long if v == 4 else long.replace("noderivatives", "noderivs"),)
    ),
)
STARTS = ("licensed under", "released under", "distributed under", "available under", *(f"this {x} is {how} under" for x in ("work", "project", "software", "document") for how in ("licensed", "released", "distributed")))
TERMS = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation"
LATER = "either version {} of the license or at your option any later version"
#: Identifier and normalised wording of licence sentences.
SENTENCES = (
    ("mit-name", "released under the mit license"),
    ("mit-name", "licensed under the mit license"),
    ("mit-name", "this project is licensed under the mit license"),
    ("mit-title", "the mit license"),
    ("mit-title", "mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache2-name", "licensed under the apache license version 2 0"),
    ("apache2-name", "licensed under the apache license version 2 0 the license"),
    ("apache2-limit", "you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at"),
    ("gpl3-name", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-name", "licensed under the gnu general public license version 3"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("cc-by-name", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-name", "licensed under cc by 4 0"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-name", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-free", f"{TERMS} {LATER}".format("general public license", "3")),
    ("gpl2-free", f"{TERMS} {LATER}".format("general public license", "2")),
    ("lgpl3-free", f"{TERMS} {LATER}".format("lesser general public license", "3")),
    ("lgpl21-free", f"{TERMS} {LATER}".format("lesser general public license", "2 1")),
    ("gpl-terms", TERMS.format("general public license")),
    ("lgpl-terms", TERMS.format("lesser general public license")),
    ("gnu-later-2", LATER.format("2")),
    ("gnu-later-21", LATER.format("2 1")),
    ("gnu-later-3", LATER.format("3")),
    ("gpl2-only", "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("lgpl-hope", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("mpl2-form", "this source code form is subject to the terms of the mozilla public license v"),
    ("mpl2-form", "this source code form is subject to the terms of the mozilla public license version 2 0"),
    ("mpl2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("mpl2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("isc-title", "isc license"),
    ("isc-title", "the isc license"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    *((i, f"{start} {name}") for i, _, names in NAMED for name in names for start in STARTS),
)
SENTENCES = tuple(dict.fromkeys(SENTENCES))
#: Rule, licence, and the identifiers that must occur in this order, other text between them allowed.
RULES = (
    ("mit-notice-line", "MIT", ("mit-name",)),
    ("mit-title-and-grant", "MIT", ("mit-title", "mit-grant")),
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "as-is")),
    ("apache-notice-line", "Apache-2.0", ("apache2-name",)),
    ("apache-header", "Apache-2.0", ("apache2-name", "apache2-limit", "apache2-copy")),
    ("gpl-notice-line", "GPL-3.0", ("gpl3-name",)),
    ("gpl-header", "GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("cc-by-notice-line", "CC-BY-4.0", ("cc-by-name",)),
    ("bsd-2-text", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("bsd-3-text", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("gpl-2-header", "GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("gpl-2-split-header", "GPL-2.0-or-later", ("gpl-terms", "gnu-later-2")),
    ("gpl-2-only-header", "GPL-2.0-only", ("gpl2-only",)),
    ("gpl-3-split-header", "GPL-3.0-or-later", ("gpl-terms", "gnu-later-3")),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", ("lgpl21-free",)),
    ("lgpl-2.1-split-header", "LGPL-2.1-or-later", ("lgpl-terms", "gnu-later-21")),
    ("lgpl-3-header", "LGPL-3.0-or-later", ("lgpl3-free",)),
    ("lgpl-3-split-header", "LGPL-3.0-or-later", ("lgpl-terms", "gnu-later-3")),
    ("mpl-header", "MPL-2.0", ("mpl2-form",)),
    ("isc-text", "ISC", ("isc-grant",)),
    *((f"{i.removesuffix('-name')}-notice-line", name, (i,)) for i, name, _ in NAMED if i not in ("mit-name", "apache2-name", "gpl3-name", "cc-by-name")),
)
#: A sentence ends at a line's end, or at . ! ? ; : before white space or the end.
BREAK = r"[.!?;:]+(?:[\x09-\x0D\x20]+|\z)|[\x0A\x0D]+"
#: A wrapped sentence ends at the same marks, or at a line of nothing but white space and comment marks.
STOP = r"[.!?;:]+(?:[\x09-\x0D\x20]+|\z)|\x0A[\x09\x0B-\x0D\x20*#/%>|-]*\x0A|\x0D[\x09\x0B\x0C\x20*#/%>|-]*\x0D"
LINE = r"[\x0A\x0D]+"
OTHER = r"[^a-z0-9]+"


def sentences(text: Column) -> Column:
    """The normalised sentences of a text in their order, a wrapped one before each of its lines.

    Normalised is a-z and 0-9 in lower case, single spaces between runs of them.
    """
    plain = lambda s: F.trim(F.regexp_replace(s, OTHER, " "))

    def of(sentence: Column) -> Column:
        whole, lines = plain(sentence), F.transform(F.split(sentence, LINE, -1), plain)
        return F.when(F.array_contains(lines, whole), lines).otherwise(F.concat(F.array(whole), lines))

    return F.flatten(F.transform(F.split(ascii_lower(text), STOP, -1), of))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    known: tuple[tuple[str, str], ...] = SENTENCES,
    rules: tuple[tuple[str, str, tuple[str, ...]], ...] = RULES,
) -> DataFrame:
    """Licences of every row that has one: (doc_id, sentence_ids, rules, licenses), the last two sorted.

    A rule matches where its identifiers occur in their order among the
    document's identifiers.  Null and empty texts have no sentences; rows
    without a match are left out; rows that repeat an id with the same text
    count once, with another text apart; null ids are kept; extra columns are
    left out; an empty table gives an empty one.
    """
    require(docs, id_col, text_col)
    table = docs.sparkSession.createDataFrame(list(known), "sentence_id string, sentence string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("code"), F.posexplode(sentences(F.col(text_col))).alias("at", "sentence")
    )
    found = rows.join(F.broadcast(table), "sentence").groupBy("doc_id", "code").agg(F.array_sort(F.collect_set(F.struct("at", "sentence_id"))).alias("s"))
    ids = found.select("doc_id", F.col("s.sentence_id").alias("sentence_ids"))

    def matches(wanted: tuple[str, ...]) -> Column:
        """Whether `wanted` is a subsequence: each identifier is looked for behind the one before."""
        at = F.aggregate(
            F.col("sentence_ids"),
            F.lit(0),
            lambda done, s: F.when((done < len(wanted)) & (F.get(F.array(*map(F.lit, wanted)), done) == s), done + 1).otherwise(done),
        )
        return at == len(wanted)

    hit = F.array_compact(F.array(*(F.when(matches(w), F.struct(F.lit(r).alias("rule"), F.lit(name).alias("license"))) for r, name, w in rules)))
    return ids.select("doc_id", "sentence_ids", hit.alias("hit")).where(F.size("hit") > 0).select(
        "doc_id", "sentence_ids", F.array_sort("hit.rule").alias("rules"), F.array_sort(F.array_distinct("hit.license")).alias("licenses")
    )


def values(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The built-in sentences and rules as tables."""
    return (
        spark.createDataFrame(list(SENTENCES), "sentence_id string, sentence string"),
        spark.createDataFrame([(r, n, list(w)) for r, n, w in RULES], "rule string, license string, sentence_ids array<string>"),
    )
