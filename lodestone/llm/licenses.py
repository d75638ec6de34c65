"""Licence scan by ordered signature rules, in DataFrame functions only.

A text is lower-cased (A-Z) and reduced to its words with one space between. Hundreds of rules, each a regular expression
with a keyword, look for licence phrases; a rule's expression runs only on texts that hold its keyword. Each match is an
interval of words. A match within another that is longer, or as long and of higher priority, is suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let

#: Label, expression of the name, keyword (fixed values; names as their licences write them, in words).
FAMILIES = [
    ("mit", "mit", "mit"), ("apache", "apache(?: software)?", "apache"), ("gpl", "(?:gnu )?general public", "general public"), ("agpl", "(?:gnu )?affero general public", "affero"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public", "general public"), ("fdl", "(?:gnu )?free documentation", "documentation"), ("bsd", "(?:new |modified |simplified |original )?bsd", "bsd"), ("bsd-2", "(?:2|two) clause bsd", "clause"),
    ("bsd-3", "(?:3|three) clause bsd", "clause"), ("bsd-2", "bsd (?:2|two) clause", "clause"), ("bsd-3", "bsd (?:3|three) clause", "clause"), ("isc", "isc", "isc"), ("mpl", "mozilla public", "mozilla"),
    ("epl", "eclipse public", "eclipse"), ("cddl", "common development and distribution", "common development"), ("cpl", "common public", "common public"), ("eupl", "european union public", "european union"),
    ("artistic", "artistic", "artistic"), ("zlib", "zlib", "zlib"), ("boost", "boost(?: software)?", "boost"), ("wtfpl", "do what the fuck you want to public", "want to public"), ("unlicense", "unlicense", "unlicense"),
    ("openssl", "openssl", "openssl"), ("php", "php", "php"), ("python", "python(?: software foundation)?", "python"), ("ruby", "ruby", "ruby"), ("postgresql", "postgresql", "postgresql"), ("odbl", "open (?:data commons )?database", "database"),
    ("ofl", "(?:sil )?open font", "open font"), ("osl", "open software", "open software"), ("afl", "academic free", "academic free"), ("ncsa", "(?:university of illinois )?ncsa", "ncsa"), ("ms-pl", "microsoft public", "microsoft"),
    ("ms-rl", "microsoft reciprocal", "reciprocal"), ("apsl", "apple public source", "apple"), ("ipl", "ibm public", "ibm"), ("qpl", "q public", "q public"), ("lppl", "latex project public", "latex"), ("x11", "x11", "x11"),
    ("mulan", "mulan permissive software", "mulan"), ("bsl", "business source", "business source"), ("sspl", "server side public", "server side"), ("elastic", "elastic", "elastic"), ("cc", "creative commons(?: attribution)?", "creative commons"),
]
#: Expression around a name, priority (the smaller wins), confidence.
FORMS = [
    ("licen[sc]ed under (?:the |an |a )?(?:terms of the )?{} licen[sc]e", 1, 1.0),
    ("(?:released|distributed|available|published|provided|redistribute it) under (?:the |an |a )?(?:terms of the )?{} licen[sc]e", 2, 0.95),
    ("under (?:the )?terms (?:and conditions )?of (?:the |an |a )?{} licen[sc]e", 3, 0.95),
    ("(?:this|the|a copy of the) {} licen[sc]e", 4, 0.9),
    ("{} licen[sc]es?", 5, 0.85),
    ("licen[sc]e {}", 7, 0.6),
]
#: Rules that stand alone: label, expression, keyword, priority, confidence.
SINGLE = [
    ("gpl-3", "gnu general public license (?:version |v )?3", "general public", 1, 1.0), ("gpl-2", "gnu general public license (?:version |v )?2", "general public", 1, 1.0), ("apache-2", "apache license (?:version |v )?2(?: 0)?", "apache", 1, 1.0),
    ("mpl-2", "mozilla public license (?:version |v )?2(?: 0)?", "mozilla", 1, 1.0), ("cc-by", "cc by(?: [1-4](?: [05])?)?", "cc by", 3, 0.9), ("cc-by-sa", "cc by sa(?: [1-4](?: [05])?)?", "cc by", 2, 0.95), ("cc-by-nc", "cc by nc(?: [1-4](?: [05])?)?", "cc by", 2, 0.95),
    ("cc-by-nd", "cc by nd(?: [1-4](?: [05])?)?", "cc by", 2, 0.95), ("cc-by-nc-sa", "cc by nc sa(?: [1-4](?: [05])?)?", "cc by", 1, 1.0), ("cc-by-nc-nd", "cc by nc nd(?: [1-4](?: [05])?)?", "cc by", 1, 1.0), ("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0", 2, 0.95),
    ("all-rights-reserved", "all rights reserved", "rights reserved", 4, 0.8), ("public-domain", "(?:released into |dedicated to |in )?the public domain", "public domain", 4, 0.7), ("copyright", "copyright(?: c)? (?:19|20)[0-9]{{2}}", "copyright", 6, 0.5),
    ("proprietary", "proprietary and confidential", "proprietary", 3, 0.9), ("no-warranty", "without warranty of any kind", "warranty", 6, 0.4), ("spdx", "spdx licen[sc]e identifier", "spdx", 8, 0.5),
]
#: Identifiers after "SPDX-License-Identifier:", in words: label and expression.
SPDX = [
    ("mit", "mit"), ("apache-2", "apache 2 0"), ("gpl-2", "gpl 2 0(?: only| or later)?"), ("gpl-3", "gpl 3 0(?: only| or later)?"), ("lgpl", "lgpl (?:2 [01]|3 0)(?: only| or later)?"), ("agpl", "agpl 3 0(?: only| or later)?"),
    ("fdl", "gfdl 1 [123](?: only| or later)?"), ("bsd-2", "bsd 2 clause"), ("bsd-3", "bsd 3 clause"), ("isc", "isc"), ("mpl-2", "mpl 2 0"), ("epl", "epl [12] 0"), ("cddl", "cddl 1 [01]"), ("cpl", "cpl 1 0"), ("eupl", "eupl 1 [12]"),
    ("artistic", "artistic [12] 0"), ("zlib", "zlib"), ("boost", "bsl 1 0"), ("wtfpl", "wtfpl"), ("unlicense", "unlicense"), ("openssl", "openssl"), ("php", "php 3 01?"), ("python", "(?:psf|python) 2 0"), ("ruby", "ruby"), ("postgresql", "postgresql"),
    ("odbl", "odbl 1 0"), ("ofl", "ofl 1 1"), ("osl", "osl 3 0"), ("afl", "afl 3 0"), ("ncsa", "ncsa"), ("ms-pl", "ms pl"), ("ms-rl", "ms rl"), ("apsl", "apsl 2 0"), ("ipl", "ipl 1 0"), ("qpl", "qpl 1 0"), ("lppl", "lppl 1 3c?"),
    ("x11", "x11"), ("mulan", "mulanpsl 2 0"), ("bsl", "busl 1 1"), ("sspl", "sspl 1 0"), ("elastic", "elastic 2 0"), ("cc0", "cc0 1 0"), ("cc-by", "cc by [1-4] [05]"), ("cc-by-sa", "cc by sa [1-4] [05]"), ("cc-by-nc", "cc by nc [1-4] [05]"),
    ("cc-by-nd", "cc by nd [1-4] [05]"), ("cc-by-nc-sa", "cc by nc sa [1-4] [05]"), ("cc-by-nc-nd", "cc by nc nd [1-4] [05]"),
]
#: Sentences that stand in licences and their notices, in words: label, expression, keyword, priority, confidence.
SIGNATURES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission", 1, 1.0), ("mit", "the above copyright notice and this permission notice shall be included in all copies", "copyright notice", 2, 0.9),
    ("mit", "the software is provided as is without warranty of any kind express or implied", "warranty", 3, 0.8), ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission", 1, 1.0),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that", "redistribution", 2, 0.95), ("bsd-3", "neither the name of (?:the )?[^ ]+(?: [^ ]+)*? nor the names of its contributors may be used", "neither the name", 1, 1.0),
    ("bsd-2", "redistributions of source code must retain the above copyright notice this list of conditions", "redistributions", 3, 0.8), ("apache-2", "you may not use this file except in compliance with the licen[sc]e", "compliance with", 1, 1.0),
    ("apache-2", "distributed on an as is basis without warranties or conditions of any kind", "warranties", 2, 0.95), ("apache-2", "www apache org licenses license 2 0", "apache", 1, 1.0), ("apache", "licensed to the apache software foundation asf under one or more contributor license agreements", "apache", 1, 1.0),
    ("gpl", "this program is free software you can redistribute it and or modify", "free software", 2, 0.9), ("gpl-2", "either version 2 of the licen[sc]e or at your option any later version", "version 2", 1, 1.0), ("gpl-3", "either version 3 of the licen[sc]e or at your option any later version", "version 3", 1, 1.0),
    ("gpl", "you should have received a copy of the gnu general public license", "general public", 2, 0.9), ("lgpl", "you should have received a copy of the gnu lesser general public license", "lesser general", 1, 1.0), ("agpl", "you should have received a copy of the gnu affero general public license", "affero", 1, 1.0),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla", 1, 1.0), ("mpl", "the contents of this file are subject to the mozilla public license", "mozilla", 2, 0.95), ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse", 1, 1.0),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "common development", 1, 1.0), ("eupl", "licensed under the eupl", "eupl", 1, 1.0), ("artistic", "the intent of this document is to state the conditions under which a package may be copied", "intent of this document", 1, 1.0),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "in no event", 1, 1.0), ("zlib", "the origin of this software must not be misrepresented", "misrepresented", 2, 0.9), ("boost", "boost software license version 1 0", "boost", 1, 1.0),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", "verbatim", 2, 0.9), ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 1, 1.0),
    ("openssl", "this product includes software developed by the openssl project", "openssl", 1, 1.0), ("php", "this product includes php software", "php", 1, 1.0), ("python", "psf license agreement for python", "python", 1, 1.0), ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee", "documentation for any", 1, 1.0),
    ("odbl", "this data is made available under the open database license", "open database", 1, 1.0), ("ofl", "this font software is licensed under the sil open font license", "open font", 1, 1.0), ("osl", "licensed under the open software license version 3 0", "open software", 1, 1.0), ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with", "deal with", 2, 0.8),
    ("lppl", "this work may be distributed and or modified under the conditions of the latex project public license", "latex", 1, 1.0), ("x11", "except as contained in this notice the name of the x consortium shall not be used", "x consortium", 1, 1.0), ("bsl", "change date change license additional use grant", "change license", 2, 0.9),
    ("sspl", "if you make the functionality of the program or a modified version available to third parties as a service", "as a service", 1, 1.0), ("elastic", "you may not provide the software to third parties as a hosted or managed service", "managed service", 1, 1.0),
    ("cc0", "to the extent possible under law [^ ]+(?: [^ ]+)*? has waived all copyright", "waived", 1, 1.0), ("cc", "this work is licensed under a creative commons", "creative commons", 2, 0.95), ("cc", "creativecommons org licenses", "creativecommons", 2, 0.9), ("cc0", "creativecommons org publicdomain zero", "creativecommons", 1, 1.0),
    ("cc-by", "creativecommons org licenses by [1-4]", "creativecommons", 1, 1.0), ("cc-by-sa", "creativecommons org licenses by sa", "creativecommons", 1, 1.0), ("cc-by-nc", "creativecommons org licenses by nc [1-4]", "creativecommons", 1, 1.0), ("cc-by-nd", "creativecommons org licenses by nd", "creativecommons", 1, 1.0),
    ("public-domain", "no rights reserved", "rights reserved", 3, 0.8), ("public-domain", "this work is in the public domain", "public domain", 2, 0.9), ("proprietary", "unauthori[sz]ed copying of this file via any medium is strictly prohibited", "unauthori", 1, 1.0), ("proprietary", "this software is the confidential and proprietary information of", "proprietary", 1, 1.0),
    ("proprietary", "may not be reproduced distributed or transmitted in any form", "may not be reproduced", 3, 0.8), ("proprietary", "for internal use only", "internal use", 5, 0.5),
]
#: The base phrases, by label.
BASE = {"apache": ("apache", "license"), "gpl": ("general", "public", "license"), "mit": ("mit", "license")}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def rules() -> list[tuple[str, str, str, int, float]]:
    """Label, expression on spaced words, keyword, priority, confidence of every rule, in order."""
    made = [(label, form.format(name), word, priority, sure) for form, priority, sure in FORMS for label, name, word in FAMILIES]
    made += [(label, x.format(), word, priority, sure) for label, x, word, priority, sure in SINGLE]
    made += [(label, f"spdx licen[sc]e identifier {x}", "spdx", 1, 1.0) for label, x in SPDX] + SIGNATURES
    # Any other licence: "licensed under" before none of the names known.
    known = "|".join(sorted({name for _, name, _ in FAMILIES} | {"cc"}))
    made.append(("other", f"licen[sc]ed under(?! (?:the |an? )?(?:terms of the )?(?:{known})(?: |$))", "under", 9, 0.3))
    return sorted(made, key=lambda r: r[3])


def _phrase_starts(words: Column) -> Column:
    """The (start, label) of each place where a base phrase's words stand in a row."""

    def starts(label: str, phrase: tuple[str, ...]) -> Column:
        here = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _all([F.get(words, i + j) == w for j, w in enumerate(phrase)]))
        return F.transform(here, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

    return F.concat(*[starts(label, phrase) for label, phrase in BASE.items()])


def _all(conditions: list[Column]) -> Column:
    out = F.coalesce(conditions[-1], F.lit(False))
    for c in reversed(conditions[:-1]):
        out = F.when(c, out).otherwise(F.lit(False))
    return out


def _matches(spaced: Column, rule: Column) -> Column:
    """Intervals of words that a rule's expression matches: from the texts between matches and of them, in turn."""
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))

    def placed(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,priority:int,label:string,sure:double>>").alias("out"))
        between = F.split(spaced, rule["expression"], -1)

        def step(s: Column, i: Column) -> Column:
            first = s["at"] + spaces(F.get(between, i))
            past = first + spaces(F.get(found, i))
            one = F.struct(first.alias("start"), past.alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["sure"].alias("sure"))
            return F.struct(past.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda s: s["out"])

    none = F.array().cast("array<struct<start:int,end:int,priority:int,label:string,sure:double>>")
    found = F.regexp_extract_all(spaced, rule["expression"], F.lit(0))
    return F.when(F.contains(spaced, rule["keyword"]), let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))).otherwise(none)


def _resolved(found: Column) -> Column:
    """found without the intervals that lie in a better one."""
    better = lambda a, b: (
        (a["start"] <= b["start"])
        & (a["end"] >= b["end"])
        & ((a["end"] - a["start"] > b["end"] - b["start"]) | (a["priority"] < b["priority"]) | ((a["priority"] == b["priority"]) & (a["label"] < b["label"])))
    )
    return F.filter(found, lambda b: ~F.exists(found, lambda a: better(a, b)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections for each row of docs.

    Base places are all counted, whatever the rules find; labels holds both. A null or empty text has no words. Rows don't
    depend on each other, so equal rows and ids change nothing; texts may be of any length that a row holds.
    """
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(f" (?:{x})(?= )").alias("expression"), F.lit(f" {word}").alias("keyword"), F.lit(priority).alias("priority"), F.lit(sure).alias("sure")) for label, x, word, priority, sure in rules()])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    small = F.lower(text)
    gate = F.lit(False)
    # Every rule and base phrase holds one of these.
    for word in ("licen", "copyright", "proprietary", "warrant", "creativecommons", "permission", "free", "misrepresent", "verbatim"):
        gate = gate | F.contains(small, F.lit(word))
    gate = gate | small.rlike("spdx|rights[^a-z0-9]+reserved|public[^a-z0-9]+domain|cc0|cc[^a-z0-9]+by|redistributi|unauthori|reproduced|internal[^a-z0-9]+use|x[^a-z0-9]+consortium|openssl|php[^a-z0-9]+software|service|intent")

    def looked(words: Column) -> Column:
        spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        found = let(spaced, lambda s: let(F.flatten(F.transform(table, lambda r: _matches(s, r))), _resolved))
        return F.struct(F.when(F.size(words) > 0, _phrase_starts(words)).alias("base"), found.alias("found"))

    words = F.filter(F.split(F.translate(text, UPPER, LOWER), NOT_WORD), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.when(gate, let(words, looked)).alias("_r"))
    starts = F.transform("_r.base", lambda x: x["start"])
    base_labels = F.coalesce(F.array_distinct(F.transform("_r.base", lambda x: x["label"])), F.array().cast("array<string>"))
    labels = F.array_union(base_labels, F.coalesce(F.transform("_r.found", lambda x: x["label"]), F.array().cast("array<string>")))
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("_r.base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(labels), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("_r.found", lambda x: x["sure"])), F.lit(0.0)).alias("score"),
        F.coalesce("_r.found", F.array().cast("array<struct<start:int,end:int,priority:int,label:string,sure:double>>")).alias("detections"),
    )
