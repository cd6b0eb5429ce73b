"""License scans by sentence rules (DataFrame operations only).

A text is cut into sentences, each is normalised, and known licence sentences become identifiers; a licence rule is an ordered
sequence of identifiers, and a rule is met where its identifiers follow one another in the document's sequence of known
sentences (other sentences may stand between). Longer rules come first: a rule is not reported where a rule that contains it is.

A notice (`licensed under …`, an SPDX tag, a `license:` field) may name several licences and ends at a dash, a bracket or an address;
it gives one identifier for each name in NAMED_LICENSES. A sentence that is known as a whole is never taken apart.

Published headers and full texts are known by the pieces that the cut leaves of them (HEADERS), wrapped, indented or in comments.

All work is row by row: there is no shuffle, and the tables of sentences and rules are fixed values.

Defined cases: null and empty texts have no sentences and no licences; sentences repeat freely; repeated rows are scanned row by
row; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm.common import table

# Sentences of public licence texts and notices, normalised (lower case, runs of other characters as one blank).
SENTENCES = {
    "mit.notice": "released under the mit license",
    "mit.notice2": "licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache2.notice": "licensed under the apache license version 2 0",
    "apache2.comply": "you may not use this file except in compliance with the license",
    "apache2.copy": "you may obtain a copy of the license at",
    "apache2.asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3.notice": "this work is licensed under the gnu general public license version 3",
    "gpl2.notice": "this work is licensed under the gnu general public license version 2",
    "gpl.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl3.notice": "this work is licensed under the gnu lesser general public license version 3",
    "agpl3.notice": "this work is licensed under the gnu affero general public license version 3",
    "ccbync4.notice": "licensed under cc by nc 4 0",
    "ccby4.notice": "licensed under cc by 4 0",
    "ccbysa4.notice": "licensed under cc by sa 4 0",
    "ccby4.work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4.work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc0.work": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "bsd.redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2.notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense.free": "this is free and unencumbered software released into the public domain",
    "proprietary.all": "all rights reserved",
}

# Licence, kind, and the sequences of sentence identifiers that show it.
RULES = (
    ("MIT", "permissive", (("mit.notice",), ("mit.notice2",), ("mit.grant", "mit.keep"), ("mit.grant", "mit.keep", "mit.asis"))),
    ("Apache-2.0", "permissive", (("apache2.notice",), ("apache2.notice", "apache2.comply", "apache2.copy", "apache2.asis"))),
    ("GPL-3.0", "copyleft", (("gpl3.notice",), ("gpl.free", "gpl.hope"))),
    ("GPL-2.0", "copyleft", (("gpl2.notice",),)),
    ("LGPL-3.0", "copyleft", (("lgpl3.notice",),)),
    ("AGPL-3.0", "copyleft", (("agpl3.notice",),)),
    ("CC-BY-NC-4.0", "non-commercial", (("ccbync4.notice",),)),
    ("CC-BY-4.0", "permissive", (("ccby4.notice",), ("ccby4.work",))),
    ("CC-BY-SA-4.0", "copyleft", (("ccbysa4.notice",), ("ccbysa4.work",))),
    ("CC0-1.0", "permissive", (("cc0.work",),)),
    ("BSD-3-Clause", "permissive", (("bsd.redistribute", "bsd.source", "bsd.binary", "bsd.endorse"),)),
    ("BSD-2-Clause", "permissive", (("bsd.redistribute", "bsd.source", "bsd.binary"),)),
    ("ISC", "permissive", (("isc.grant",),)),
    ("MPL-2.0", "copyleft", (("mpl2.notice",),)),
    ("Unlicense", "permissive", (("unlicense.free",),)),
    ("All-Rights-Reserved", "proprietary", (("proprietary.all",),)),
    ("LGPL-2.1", "copyleft", (("lgpl21.notice",),)),
    ("EPL-2.0", "copyleft", (("epl2.notice",),)),
    ("CC-BY-SA-3.0", "copyleft", (("ccbysa3.notice",),)),
    ("CC-BY-SA", "copyleft", (("ccbysa.notice",),)),
)

_FSF = "you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by the free software foundation "
_LATER = "either version {1} of the license or at your option any later version"

# Pieces of published headers and of the titles of full texts, as the cut leaves them. The SQL has the notices above only.
HEADERS = {
    "apache2.header": "licensed under the apache license version 2 0 the license",
    "apache2.asf": "the asf licenses this file to you under the apache license version 2 0 the license",
    "apache2.title": "apache license version 2 0 january 2004 http www apache org licenses",
    "apache2.title2": "apache license version 2 0 january 2004 https www apache org licenses",
    "apache2.title3": "apache license version 2 0 january 2004",
    "gpl3.later": (_FSF + _LATER).format("", "3"),
    "gpl3.only": (_FSF + "version 3 of the license").format(""),
    "gpl3.title": "gnu general public license version 3 29 june 2007",
    "gpl2.later": (_FSF + _LATER).format("", "2"),
    "gpl2.only": (_FSF + "version 2 of the license").format(""),
    "gpl2.only2": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl2.title": "gnu general public license version 2 june 1991",
    "gpl.useful": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl.implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd3.notice": "licensed under the bsd 3 clause license",
    "bsd2.notice": "licensed under the bsd 2 clause license",
    "isc.notice": "licensed under the isc license",
    "unlicense.notice": "licensed under the unlicense",
    "cc0.notice": "licensed under cc0 1 0",
    "lgpl21.notice": "licensed under the gnu lesser general public license version 2 1",
    "epl2.notice": "licensed under the eclipse public license 2 0",
    "ccbysa3.notice": "licensed under cc by sa 3 0",
    "ccbysa.notice": "licensed under the creative commons attribution sharealike license",
    "lgpl21.later": (_FSF + _LATER).format("lesser ", "2 1"),
    "lgpl21.only": (_FSF + "version 2 1 of the license").format("lesser "),
    "lgpl21.title": "gnu lesser general public license version 2 1 february 1999",
    "epl2.title": "eclipse public license v 2 0",
    "epl2.terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "lgpl3.later": (_FSF + _LATER).format("lesser ", "3"),
    "lgpl3.title": "gnu lesser general public license version 3 29 june 2007",
    "agpl3.later": (_FSF + _LATER).format("affero ", "3"),
    "agpl3.title": "gnu affero general public license version 3 19 november 2007",
    "ccbync4.work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "ccbync4.title": "creative commons attribution noncommercial 4 0 international public license",
    "ccby4.title": "creative commons attribution 4 0 international public license",
    "ccbysa4.title": "creative commons attribution sharealike 4 0 international public license",
    "cc0.title": "cc0 1 0 universal",
    "bsd.author": "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "isc.grant2": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2.title": "mozilla public license version 2 0",
}

# Further sequences of the licences in RULES.
HEADER_RULES = {
    "Apache-2.0": (("apache2.header",), ("apache2.asf",), ("apache2.title",), ("apache2.title2",), ("apache2.title3",)),
    "GPL-3.0": (("gpl3.later",), ("gpl3.only",), ("gpl3.title",)),
    "GPL-2.0": (("gpl2.later",), ("gpl2.only",), ("gpl2.only2",), ("gpl2.title",)),
    "LGPL-3.0": (("lgpl3.later",), ("lgpl3.title",)),
    "LGPL-2.1": (("lgpl21.later",), ("lgpl21.only",), ("lgpl21.title",)),
    "EPL-2.0": (("epl2.title",), ("epl2.terms",)),
    "BSD-2-Clause": (("bsd2.notice",),),
    "Unlicense": (("unlicense.notice",),),
    "AGPL-3.0": (("agpl3.later",), ("agpl3.title",)),
    "CC-BY-NC-4.0": (("ccbync4.work",), ("ccbync4.title",)),
    "CC-BY-4.0": (("ccby4.title",),),
    "CC-BY-SA-4.0": (("ccbysa4.title",),),
    "CC0-1.0": (("cc0.title",), ("cc0.notice",)),
    "BSD-3-Clause": (("bsd3.notice",), ("bsd.redistribute", "bsd.source", "bsd.binary", "bsd.author"),),
    "ISC": (("isc.grant2",), ("isc.notice",)),
    "MPL-2.0": (("mpl2.title",),),
}

# How a notice may open; it then counts as one that starts with "licensed under".
OPENING = (
    "^(?:(?:(?:this|the|our|all) )?(?:file|project|software|code|source code|program|package|library|repository|work|data|dataset|text|content|documentation|module|plugin|tool)s? (?:is|are) (?:also |dual )?)?"
    "(?:licensed|released|distributed|made available|available) under (?:the terms of )?"
)
# What follows such an opening.
NOTICES = {
    "mit": "mit.notice2", "mit license": "mit.notice2", "an mit license": "mit.notice2", "the mit license": "mit.notice2", "the apache license version 2 0": "apache2.notice", "the apache license 2 0": "apache2.notice",
    "the apache 2 0 license": "apache2.notice", "apache 2 0": "apache2.notice", "the gnu general public license version 3": "gpl3.notice", "the gnu general public license v3 0": "gpl3.notice",
    "the gnu general public license version 2": "gpl2.notice", "the gnu lesser general public license version 3": "lgpl3.notice", "the gnu affero general public license version 3": "agpl3.notice",
    "a creative commons attribution 4 0 international license": "ccby4.work", "a creative commons attribution sharealike 4 0 international license": "ccbysa4.work",
    "cc by 4 0": "ccby4.notice", "cc by sa 4 0": "ccbysa4.notice", "cc by nc 4 0": "ccbync4.notice",
}

# Names of licences in notices and identifiers, without article, `license` at their end, and versions that may follow.
NAMED_LICENSES = {
    "mit": "mit.notice2", "expat": "mit.notice2", "apache 2 0": "apache2.notice", "apache license version 2 0": "apache2.notice", "apache license 2 0": "apache2.notice", "apache version 2 0": "apache2.notice", "apache license v2 0": "apache2.notice", "apache v2": "apache2.notice", "apache2": "apache2.notice",
    "gpl 3 0": "gpl3.notice", "gpl v3": "gpl3.notice", "gplv3": "gpl3.notice", "gnu gpl v3": "gpl3.notice", "gnu gplv3": "gpl3.notice", "gnu gpl version 3": "gpl3.notice", "gnu general public license version 3": "gpl3.notice", "gnu general public license v3": "gpl3.notice", "gnu general public license v3 0": "gpl3.notice", "gpl 3 0 only": "gpl3.notice",
    "gpl 2 0": "gpl2.notice", "gpl v2": "gpl2.notice", "gplv2": "gpl2.notice", "gnu gpl v2": "gpl2.notice", "gnu gplv2": "gpl2.notice", "gnu gpl version 2": "gpl2.notice", "gnu general public license version 2": "gpl2.notice", "gnu general public license v2": "gpl2.notice", "gnu general public license v2 0": "gpl2.notice", "gpl 2 0 only": "gpl2.notice",
    "lgpl 2 1": "lgpl21.notice", "lgplv2 1": "lgpl21.notice", "gnu lesser general public license version 2 1": "lgpl21.notice", "gnu lesser general public license v2 1": "lgpl21.notice", "lgpl 2 1 only": "lgpl21.notice", "gnu lgpl version 2 1": "lgpl21.notice",
    "lgpl 3 0": "lgpl3.notice", "lgplv3": "lgpl3.notice", "gnu lesser general public license version 3": "lgpl3.notice", "gnu lesser general public license v3 0": "lgpl3.notice", "lgpl 3 0 only": "lgpl3.notice",
    "agpl 3 0": "agpl3.notice", "agplv3": "agpl3.notice", "gnu affero general public license version 3": "agpl3.notice", "gnu affero general public license v3 0": "agpl3.notice", "gnu agplv3": "agpl3.notice", "agpl 3 0 only": "agpl3.notice",
    "bsd 3 clause": "bsd3.notice", "3 clause bsd": "bsd3.notice", "new bsd": "bsd3.notice", "modified bsd": "bsd3.notice", "bsd 2 clause": "bsd2.notice", "2 clause bsd": "bsd2.notice", "simplified bsd": "bsd2.notice", "isc": "isc.notice",
    "mpl 2 0": "mpl2.notice", "mozilla public license 2 0": "mpl2.notice", "mozilla public license version 2 0": "mpl2.notice", "mozilla public license v2 0": "mpl2.notice", "epl 2 0": "epl2.notice", "eclipse public license 2 0": "epl2.notice", "eclipse public license version 2 0": "epl2.notice", "eclipse public license v2 0": "epl2.notice",
    "unlicense": "unlicense.notice", "cc0 1 0": "cc0.notice", "cc0": "cc0.notice", "cc by 4 0": "ccby4.notice", "cc by sa 4 0": "ccbysa4.notice", "cc by nc 4 0": "ccbync4.notice", "cc by sa 3 0": "ccbysa3.notice", "cc by sa": "ccbysa.notice",
    "creative commons attribution 4 0 international": "ccby4.work", "creative commons attribution sharealike 4 0 international": "ccbysa4.work", "creative commons attribution sharealike 4 0": "ccbysa4.work", "creative commons attribution sharealike 3 0": "ccbysa3.notice", "creative commons attribution sharealike 3 0 unported": "ccbysa3.notice", "creative commons attribution sharealike": "ccbysa.notice",
}
#: What stands around a name in a notice.
AROUND = "^(?:either |of |the |an |a |terms )+| (?:at your option|at your choice|as well)$"
LICENSE_END = " licen[cs]e$"

#: Normalised sentence -> identifier. The SQL has SENTENCES only.
KNOWN = (
    {f"{n} license": i for n, i in NAMED_LICENSES.items() if n != "mit"} | {f"licensed under {n}": i for n, i in NAMED_LICENSES.items()} | {f"licensed under {notice}": i for notice, i in NOTICES.items()}
    | {s: i for i, s in HEADERS.items()} | {s: i for i, s in SENTENCES.items()}
)

#: Within a document, this rule gives way to those after it.
YIELDS = {"BSD-2-Clause": ("BSD-3-Clause",)}

#: A sentence ends at a closing mark before a blank or the end, or at the end of a line.
SENTENCE_END = r"[.!?;:]+(?=\s|$)|\n+"


#: Leaders of comments, quotes and lists at the start of a line, and what closes a comment at its end.
LEADER = r"(?m)^[ \t]*(?:(?:/\*+|\*+/|\*+|//+!?|#+|--+|;+|%+|>+|<!--+|\"{3}|'{3}|\(\*|dnl(?=[ \t]|$))[ \t]*)?(?:[-*\u2022][ \t]+|\(?(?:[0-9]{1,2}|[a-z])\)[ \t]+)?"
CLOSER = r"(?m)(?<![ \t])[ \t]*(?:\*+/|--+>|[ \t][*#]+|\*\)|\"{3}|'{3})?[ \t]*$"
#: The end of a line within a sentence: what stands before it closes no sentence, what stands after it opens no item of a list
#: and, unless a word or comma stands before, no notice.
WRAP = r"([a-z,](?=\n[a-z(])|[a-z0-9,)\"'\u201d/-](?=\n(?!(?:licensed|released) under |this work is |all rights )(?:[a-z(\"'<\u201c]|[0-9](?![0-9]*[.)][ \t]))))\n"
#: Marks that close no sentence: 'v. 2.0', those of the GNU notices before the version, and 'Inc.' in the last BSD condition.
INNER = r"(?<![a-z])(v)\.\s+(?=[0-9])|\.\s+(?=nor\s+the\s+names\s+of\s)|(foundation);\s+(?=(?:either\s+)?version\s+[0-9])"
#: The holder's own name in the last condition of the BSD licence.
NAMED = r"^neither the name of .{1,300}? nor the names of (?:its|his|her|their|the|any) contributors may be used"


#: A line that names the licence: an identifier tag, a field of a manifest.
TAGGED = r"(?m)(?:\bspdx-license-identifier[ \t]*:|^[\"']?licen[cs]e[\"']?[ \t]*:)[ \t]*([^\n]*)$"
#: Where a notice, but not a sentence, may end: at a dash, a bracket, an address, or before the reservation of rights.
ASIDE = r" [-–—]+ | ?[()|] ?|,? (?=https?://)|, (?=all rights reserved)"


def _marked(text: Column) -> Column:
    """Normalised sentences of a text, in order, with a bar at each ASIDE."""
    low = F.regexp_replace(F.lower(text), "\r\n?", "\n")
    low = F.regexp_replace(F.regexp_replace(low, LEADER, ""), CLOSER, "")
    low = F.regexp_replace(low, TAGGED, "\nlicensed under $1.\n")
    low = F.regexp_replace(F.regexp_replace(low, WRAP, "$1 "), INNER, "$1$2 ")
    cut = F.split(low, SENTENCE_END)
    return F.transform(cut, lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\s+", " "), ASIDE, "|"), r"[^a-z0-9|]+", " ")))


def _plain(marked: Column) -> Column:
    holder = "neither the name of the copyright holder nor the names of its contributors may be used"
    s = F.trim(F.regexp_replace(marked, r"[ |]+", " "))
    return F.when(s.startswith("neither the name of"), F.regexp_replace(s, NAMED, holder)).otherwise(s)


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, in order. Comment leaders and indents go, and lines that wrap within a sentence are joined first."""
    return F.transform(_marked(text), _plain)


def _named(marked: Column) -> Column:
    """What a notice names, each as a notice of its own: `licensed under either of a or b (see c)` gives a and b."""
    head = F.trim(F.regexp_replace(F.trim(F.split_part(marked, F.lit("|"), F.lit(1))), OPENING, ""))
    bare = lambda n: F.regexp_replace(F.regexp_replace(F.trim(n), AROUND, ""), LICENSE_END, "")
    return F.transform(F.split(head, " (?:or|and) "), lambda n: F.concat(F.lit("licensed under "), bare(n)))


#: Words, or parts of a word, one of which every known sentence holds; texts without any are not cut into sentences. No blank
#: stands inside, so however a sentence is wrapped or spaced, its word is found.
HINTS = ("licen", "permi", "redistribut", "warrant", "copyright", "rights", "domain", "neither", "gnu", "endorse", "universal", "released", "distributed", "available")
HINT = "(?i)" + "|".join(HINTS)


def found(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    number = F.create_map(*(F.lit(x) for s, i in KNOWN.items() for x in (s, i)))
    known = list(KNOWN)

    def read(marked: Column) -> Column:
        plain = _plain(marked)
        whole = F.regexp_replace(plain, OPENING, "licensed under ")
        opens = marked.rlike(OPENING)
        return (
            F.when(plain.isin(known), F.array(plain)).when(opens & whole.isin(known), F.array(whole)).when(opens, _named(marked))
            .when(F.contains(marked, F.lit("|")), F.transform(F.split(marked, r"\|"), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))
        )

    kept = F.filter(F.flatten(F.transform(_marked(text), read)), lambda s: s.isin(known))
    ids = F.transform(kept, lambda s: number[s])
    return F.when(text.rlike(HINT), ids).otherwise(F.array().cast("array<string>"))


def _further(seq: tuple[str, ...]):
    names = F.array(*map(F.lit, seq))
    return lambda k, x: F.when(F.get(names, k) == x, k + 1).otherwise(k)


def _met(ids: Column, sequences: tuple[tuple[str, ...], ...]) -> Column:
    """Whether one of the sequences occurs in order; others may stand between. A pass over the identifiers counts how many of the
    sequence have been met, so the work is linear in them."""
    single = [seq[0] for seq in sequences if len(seq) == 1]
    out = F.exists(ids, lambda x: x.isin(single)) if single else F.lit(False)
    for seq in sequences:
        if len(seq) > 1:
            out = out | (F.aggregate(ids, F.lit(0), _further(seq)) == len(seq))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sentence_ids, licenses (sorted), kinds (sorted) and n_sentences for every row of docs."""
    rows = docs.select(F.col(id_col), found(F.coalesce(F.col(text_col), F.lit(""))).alias("sentence_ids"))
    met = {name: _met(F.col("sentence_ids"), (*seqs, *HEADER_RULES.get(name, ()))) for name, _, seqs in RULES}
    for name, others in YIELDS.items():
        for other in others:
            met[name] = met[name] & ~met[other]
    some = F.size("sentence_ids") > 0
    pick = lambda values: F.when(some, F.array_sort(F.array_distinct(F.filter(F.array(*values), lambda x: x.isNotNull())))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        id_col, "sentence_ids", pick([F.when(met[n], F.lit(n)) for n, _, _ in RULES]).alias("licenses"),
        pick([F.when(met[n], F.lit(k)) for n, k, _ in RULES]).alias("kinds"), F.size("sentence_ids").cast("long").alias("n_sentences"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("kinds", ",").alias("kinds"), "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"))


def _sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for i, s in SENTENCES.items())
    pattern = lambda seqs: "|".join(".*".join(f" {x.replace('.', '[.]')} " for x in q) for q in seqs)
    met = {n: f"regexp_matches(line, '{pattern(q)}')" for n, _, q in RULES}
    for name, others in YIELDS.items():
        met[name] = " AND ".join([met[name], *(f"NOT {met[o]}" for o in others)])
    lists = lambda pairs: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {met[n]} THEN '{v}' END" for n, v in pairs) + "], lambda x: x IS NOT NULL))), ',')"
    return rf"""
WITH k(s, i) AS (VALUES {known}),
d AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '([a-z,])\n([a-z(])', '\1 \2', 'g') AS t FROM documents),
c AS (SELECT doc_id, string_split_regex(regexp_replace(t, '[.!?;:]+(\s|$)', chr(10), 'g'), '\n+') AS parts FROM d),
e AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS n, parts FROM c),
f AS (SELECT doc_id, n, trim(regexp_replace(parts[n], '[^a-z0-9]+', ' ', 'g')) AS s FROM e),
g AS (SELECT doc_id, list(i ORDER BY n) AS ids FROM f JOIN k USING (s) GROUP BY doc_id),
h AS (SELECT documents.doc_id, coalesce(ids, []::VARCHAR[]) AS ids FROM documents LEFT JOIN g USING (doc_id)),
l AS (SELECT doc_id, ids, ' ' || array_to_string(ids, '  ') || ' ' AS line FROM h)
SELECT doc_id, {lists([(n, n) for n, _, _ in RULES])} AS licenses, {lists([(n, k) for n, k, _ in RULES])} AS kinds,
       len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids FROM l"""


ORACLE_SQL = {"op9_licenses": _sql()}
QUERIES = {"op9_licenses": op9_licenses}
