"""License scans by sentence rules, in DataFrame functions only.

Each sentence of a text is normalised; known licence sentences become identifiers, all others drop out; the sequence of
identifiers is matched against ordered rules. A rule is a run of identifiers that together state a licence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushspan.llm.common import let

#: Names by which notices refer to licences, after normalisation.
NAMES = {
    "MIT": ["mit license", "mit licence"],
    "Apache-2.0": ["apache license version 2.0", "apache license 2.0", "apache 2.0 license"],
    "GPL-2.0": ["gnu general public license version 2", "gnu gpl version 2", "gpl v2"],
    "GPL-3.0": ["gnu general public license version 3", "gnu gpl version 3", "gpl v3"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl v3"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agpl v3"],
    "MPL-2.0": ["mozilla public license version 2.0", "mozilla public license 2.0"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "new bsd license"],
    "ISC": ["isc license"],
    "CC0-1.0": ["cc0 1.0", "creative commons zero v1.0 universal"],
    "CC-BY-4.0": ["cc by 4.0", "creative commons attribution 4.0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4.0", "creative commons attribution sharealike 4.0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4.0", "creative commons attribution noderivatives 4.0 international license"],
}
#: Openings of such notices.
OPENINGS = ["licensed under", "released under", "distributed under", "this work is licensed under", "this software is licensed under", "this project is licensed under", "this file is licensed under"]
#: Sentences of full texts, normalised.
SENTENCES = {
    "reserved": "all rights reserved",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-under": "licensed under the apache license version 2.0 the license",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Ordered rules over full texts; longer ones first.
TEXT_RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("Apache-2.0", ["apache-under", "apache-use"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl-form"]),
    ("Unlicense", ["unlicense"]),
    ("all-rights-reserved", ["reserved"]),
]


def sentence_table() -> dict[str, str]:
    """Normalised sentence -> identifier. Notices are built from openings and names, with and without "the"."""
    table = {text: name for name, text in SENTENCES.items()}
    for licence, names in NAMES.items():
        for name in names:
            for opening in OPENINGS:
                table[f"{opening} {name}"] = table[f"{opening} the {name}"] = f"notice-{licence}"
    return table


def rules() -> list[tuple[str, list[str]]]:
    return [*TEXT_RULES, *((licence, [f"notice-{licence}"]) for licence in NAMES)]


#: Marks between words: the end of a sentence, a line's end, a semicolon.
END, LINE, PART = "|", "/", ";"


def marked(text: Column) -> Column:
    """Lower case words of letters, digits and inner points with a blank before and after each; between them marks: END for
    . ! ? and blank lines, LINE for other line ends, PART for semicolons."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9.!?;\n]+", " ")
    lines = F.regexp_replace(F.regexp_replace(plain, r" ?\n(?: ?\n)+ ?", f" {END} "), r" ?\n ?", f" {LINE} ")
    ends = F.regexp_replace(lines, r"[.!?]+(?= |;|$)", f" {END} ")
    return F.regexp_replace(F.concat(F.lit(f" {END} "), F.regexp_replace(ends, ";", f" {PART} "), F.lit(f" {END} ")), " +", " ")


def pattern(table: dict[str, str]) -> str:
    """Known sentences between marks; a sentence may itself go over line ends and semicolons. Longer ones are tried first."""
    between = f"(?: [{LINE}{PART}])* "
    known = "|".join(between.join(w.replace(".", r"\.") for w in s.split()) for s in sorted(table, key=lambda s: (-len(s), s)))
    return f"(?<=[{END}{LINE}{PART}] )({known})(?= [{END}{LINE}{PART}])"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licences, n_known) for every row of docs (doc_id, text); other columns are ignored.

    sentence_ids: identifiers of known sentences in order, comma-joined; licences: those whose rule's identifiers follow
    each other in it, in the order of the rules, comma-joined; both empty strings if there is none. A null text is
    scanned as an empty one. Sentences end at . ! ? and blank lines; a known one is also found between line ends or
    semicolons, and over them, so that wrapped notices count. One pass without a shuffle: rows stay where they are, whatever their length or number.
    """
    table, ruled = sentence_table(), rules()
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    plain = lambda s: F.regexp_replace(s, f" [{LINE}{PART}](?= )", "")
    found = F.transform(F.regexp_extract_all(marked(F.col("text")), F.lit(pattern(table)), 1), lambda s: F.element_at(known, plain(s)))
    every = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f",{','.join(ids)},").alias("ids")) for name, ids in ruled])

    def matched(row: Column) -> Column:
        names = F.transform(F.filter(every, lambda r: F.contains(F.concat(F.lit(","), row, F.lit(",")), r["ids"])), lambda r: r["name"])
        return F.struct(row.alias("ids"), F.when(row == "", "").otherwise(F.array_join(F.array_distinct(names), ",")).alias("licences"))

    own = docs.select("doc_id", let(found, lambda ids: F.struct(F.size(ids).cast("long").alias("n"), let(F.array_join(ids, ","), matched).alias("m"))).alias("s"))
    return own.select("doc_id", F.col("s.m.ids").alias("sentence_ids"), F.col("s.m.licences").alias("licences"), F.col("s.n").alias("n_known"))


def oracle() -> str:
    """The same in SQL."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in sentence_table().items())
    ruled = ", ".join(f"({k}, '{name}', ',{','.join(ids)},')" for k, (name, ids) in enumerate(rules()))
    return rf"""
WITH known(sentence, id) AS (VALUES {known}), rules(k, name, ids) AS (VALUES {ruled}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9.!?\n]+', ' ', 'g') AS plain FROM documents),
s AS (SELECT r, unnest(regexp_split_to_array(plain, '[.!?]+(?: |\n|$)|\n')) AS sentence, generate_subscripts(regexp_split_to_array(plain, '[.!?]+(?: |\n|$)|\n'), 1) AS pos FROM d),
q AS (SELECT r, string_agg(id, ',' ORDER BY pos) AS ids, count(*) AS n FROM s JOIN known ON trim(s.sentence) = known.sentence GROUP BY r),
m AS (SELECT r, name, min(k) AS k FROM q JOIN rules ON contains(',' || q.ids || ',', rules.ids) GROUP BY r, name),
l AS (SELECT r, string_agg(name, ',' ORDER BY k) AS licences FROM m GROUP BY r)
SELECT d.doc_id, coalesce(q.ids, '') AS sentence_ids, coalesce(l.licences, '') AS licences, coalesce(q.n, 0)::BIGINT AS n_known
FROM d LEFT JOIN q USING (r) LEFT JOIN l USING (r)
"""
