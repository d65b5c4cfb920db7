"""License scans by sentence rules.

Lines lose their comment marks and list markers, wrapped lines are joined, and the text is cut into sentences after . ! ? : ;
with white space, at blank lines and around lines that are a known sentence by themselves. A sentence is normalised (ASCII
lower case, runs of anything but ASCII letters and digits become one space). Known normalised sentences have identifiers, some
with a gap that any words fill; every other sentence has identifier 0. The document's identifier sequence is then rewritten by
the licence rules in their order: each rule is a sequence of identifiers with at most ``GAP`` unknown sentences between two of
them, and a sentence used by one rule is no longer there for later ones. Everything is column expressions: one pass, no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unknown sentences that may stand between two members of a rule.
GAP = 2
SPACE = r"[\x09-\x0D\x20]"
OTHER = r"[^\x09-\x0D\x20]"
#: Marks at the start and the end of a line: of comments, then of a list.
MARKS = rf"^{SPACE}*(?:(?://+!?|/\*+|\*+/?|#+!?|--+|;+|%+|>+|dnl|REM|<!--){SPACE}*)?(?:(?:\(?[0-9]{{1,2}}[.)]|\(?[a-z][.)]|[*-]){SPACE}+)?|(?:\*/|-->){SPACE}*$"
#: A sentence ends after two characters, a mark and what closes quotes or brackets; 'v. 2' goes on.
ENDS = rf"({OTHER}{OTHER}[.!?:;][\"')\]]*){SPACE}+"
SPDX = r"SPDX-License-Identifier:"

#: Sentences of published licences, normalised; * is a gap of any words.
TEXTS = {
    "mit-grant": "* permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-0-grant": "* permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit-notice": "the above copyright notice and this permission notice * shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind *",
    "mit-liability": "in no event shall * be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "x11-names": "except as contained in this notice the name of * shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization *",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-names": "neither the name of * may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-file": "you may not use this file except in compliance with the license",
    "apache-asf": "* licenses this file to you under the apache license version 2 0 the license",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-title": "apache license version 2 0 january 2004 *",
    "isc-grant": "* permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-old": "* permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "* permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software *",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "mpl-header": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at *",
    "mpl-title": "mozilla public license version 2 0",
    "epl-header": "this program and the accompanying materials are made available under the terms of the eclipse public license * 2 0 *",
    "boost-header": "distributed under the boost software license version 1 0",
    "boost-title": "boost software license version 1 0 august 17th 2003",
    "cc0-title": "* cc0 1 0 universal *",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "free-software": "* is free software",
    "classpath-linking": "linking this library statically or dynamically with other modules is making a combined work based on this library",
    "classpath-exception": "as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an executable regardless of the license terms of these independent modules *",
    "gcc-exception": "under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception version 3 1 as published by the free software foundation",
    "public-domain": "this work is released into the public domain",
    "reserved": "all rights reserved",
}
#: Licence names in notes, normalised.
NAMES = {
    "the mit license": "MIT", "the isc license": "ISC", "the bsd 2 clause license": "BSD-2-Clause", "the bsd 3 clause license": "BSD-3-Clause",
    "the apache license version 2 0": "Apache-2.0", "the apache license 2 0": "Apache-2.0", "the apache 2 0 license": "Apache-2.0",
    "the gnu general public license version 2": "GPL-2.0", "the gnu general public license v2 0": "GPL-2.0",
    "the gnu general public license version 3": "GPL-3.0", "the gnu general public license v3 0": "GPL-3.0",
    "the gnu lesser general public license version 2 1": "LGPL-2.1", "the gnu lesser general public license version 3": "LGPL-3.0",
    "the gnu affero general public license version 3": "AGPL-3.0", "the mozilla public license version 2 0": "MPL-2.0", "the mozilla public license 2 0": "MPL-2.0",
    "cc by 4 0": "CC-BY-4.0", "cc by sa 4 0": "CC-BY-SA-4.0", "cc by nc 4 0": "CC-BY-NC-4.0", "cc0 1 0": "CC0-1.0",
}
#: How notes begin.
NOTES = ["licensed under", "released under", "distributed under", "this project is licensed under", "this software is licensed under", "this work is licensed under", "this file is licensed under"]
#: Licences of the Free Software Foundation with their versions and, for each, what follows the title.
FSF = {
    ("gnu general public license", "GPL"): {"1": "february 1989", "2": "june 1991", "3": "29 june 2007"},
    ("gnu library general public license", "LGPL"): {"2": "june 1991"},
    ("gnu lesser general public license", "LGPL"): {"2 1": "february 1999", "3": "29 june 2007"},
    ("gnu affero general public license", "AGPL"): {"3": "19 november 2007"},
}
TERMS = "you can redistribute it and or modify it under the terms of the {} as published by the free software foundation"
#: SPDX identifiers.
IDENTIFIERS = """0BSD AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0
    Classpath-exception-2.0 EPL-2.0 GCC-exception-3.1 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only
    LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LLVM-exception MIT MIT-0 MPL-2.0 Unlicense Zlib""".split()
#: Rules of the sentences above in order; longer ones stand before those they contain.
LONG = [
    ("BSD-4-Clause", "bsd-grant bsd-source bsd-binary bsd-advertising bsd-names"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-names bsd-warranty"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-names"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary bsd-warranty"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary"),
    ("X11", "mit-grant mit-notice as-is mit-liability x11-names"),
    ("MIT", "mit-grant mit-notice as-is mit-liability"),
    ("MIT", "mit-grant mit-notice as-is"),
    ("MIT", "mit-grant mit-notice"),
    ("MIT-0", "mit-0-grant as-is"),
    ("Apache-2.0", "apache-asf apache-file"),
    ("Apache-2.0", "apache-header apache-file"),
    ("ISC", "isc-grant isc-warranty"),
    ("ISC", "isc-grant-old isc-warranty"),
    ("0BSD", "0bsd-grant isc-warranty"),
    ("Zlib", "zlib-warranty zlib-grant"),
    ("MPL-2.0", "mpl-header mpl-copy"),
    ("Classpath-exception-2.0", "classpath-linking classpath-exception"),
]
SHORT = {
    "mit-0-grant": "MIT-0", "apache-asf": "Apache-2.0", "apache-header": "Apache-2.0", "apache-title": "Apache-2.0", "isc-grant": "ISC", "isc-grant-old": "ISC", "0bsd-grant": "0BSD",
    "zlib-grant": "Zlib", "unlicense": "Unlicense", "mpl-header": "MPL-2.0", "mpl-title": "MPL-2.0", "epl-header": "EPL-2.0", "boost-header": "BSL-1.0", "boost-title": "BSL-1.0",
    "cc0-title": "CC0-1.0", "cc-by": "CC-BY-4.0", "cc-by-sa": "CC-BY-SA-4.0", "cc-by-nc": "CC-BY-NC-4.0", "classpath-exception": "Classpath-exception-2.0", "gcc-exception": "GCC-exception-3.1",
    "public-domain": "Public-Domain", "reserved": "Proprietary",
}


def plain(text: str) -> str:
    """A sentence as the columns below normalise it."""
    return re.sub("[^a-z0-9]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)).strip(" ")


def rule_base() -> tuple[list[str], list[tuple[str, tuple[int, ...]]]]:
    """(sentences, rules): a sentence's identifier is its place in the list, from 1; rules are names with identifiers."""
    texts = dict(TEXTS)
    long, short = list(LONG), dict(SHORT)
    for (title, name), versions in FSF.items():
        key = title.replace(" ", "-")
        terms = TERMS.format(title)
        texts[f"{key}-terms"] = terms
        for v, date in versions.items():
            number = v.replace(" ", ".") if " " in v else f"{v}.0"
            spdx, at = f"{name}-{number}", f"{key}-{number}"
            later = f"either version {v} of the license or at your option any later version"
            texts[f"later-{number}"] = later
            texts |= {f"{at}-later": f"{terms} {later}", f"{at}-only": f"{terms} version {v} of the license", f"{at}-bare": f"{terms} version {v}", f"{at}-title": f"{title} version {v} {date} *"}
            long += [(f"{spdx}-or-later", f"free-software {key}-terms later-{number}"), (f"{spdx}-or-later", f"free-software {at}-later"), (f"{spdx}-only", f"free-software {at}-only"), (f"{spdx}-only", f"free-software {at}-bare")]
            short |= {f"{at}-later": f"{spdx}-or-later", f"{at}-only": f"{spdx}-only", f"{at}-bare": f"{spdx}-only", f"{at}-title": spdx}
    for note in NOTES:
        for k, name in NAMES.items():
            texts[f"{note} {k}"] = f"{note} {k}"
            texts[f"{note} {k} see"] = f"{note} {k} see the license *"
            short |= {f"{note} {k}": name, f"{note} {k} see": name}
    for s in IDENTIFIERS:
        texts[f"spdx {s}"] = f"spdx license identifier {plain(s)}"
        short[f"spdx {s}"] = s
    place = {k: n for n, k in enumerate(texts, 1)}
    rules = [(name, tuple(place[k] for k in keys.split())) for name, keys in long]
    return list(texts.values()), rules + [(name, (place[k],)) for k, name in short.items()]


SENTENCES, RULES = rule_base()
#: Every known sentence has one of these in a word; texts and sentences without them are not looked at further.
KEYS = r"(?i)licen[sc]|cc0|rights reserved|public{0}domain|free{0}software|redistrib|permission|provided{0}as|provided{0}by|warrant|liable|name{0}of|advertising|mpl|linking|special{0}exception|gpl|either{0}version|cc{0}by"


def _keys(between: str) -> str:
    return KEYS.replace("rights reserved", "rights{0}reserved").replace("{0}", between)


IN_TEXT, IN_SENTENCE = _keys(r"[^a-z0-9]+"), _keys(" ")


def _gapped(sentence: str) -> str:
    """A sentence with gaps as a pattern of the whole normalised sentence; gaps are runs of one class, so depth stays constant."""
    out = sentence.replace(" * ", "(?: [a-z0-9 ]+)? ")
    out = f"(?:[a-z0-9 ]+ )?{out[2:]}" if out.startswith("* ") else out
    return f"^{out[:-2]}(?: [a-z0-9 ]+)?$" if out.endswith(" *") else f"^{out}$"


def _rule_pattern(rule: tuple[int, ...], reserved: int) -> str:
    """A rule over the sequence; one of several sentences takes a copyright line's 'all rights reserved' before it along."""
    unknown = f"(?:<0>){{0,{GAP}}}"
    before = f"(?:<{reserved}>{unknown})?" if reserved and len(rule) > 1 else ""
    return before + unknown.join(f"<{i}>" for i in rule)


def _rules(sentences: list[str], rules: list) -> tuple[list[tuple[str, str]], dict[int, str]]:
    """Patterns of the rules of several sentences in order, and the names of single sentences that no such rule took."""
    reserved = sentences.index(TEXTS["reserved"]) + 1 if TEXTS["reserved"] in sentences else 0
    single = {rule[0]: name for name, rule in reversed(rules) if len(rule) == 1}
    return [(name, _rule_pattern(rule, reserved)) for name, rule in rules if len(rule) > 1], single


def licences(docs: DataFrame, sentences: list[str] = SENTENCES, rules: list = RULES) -> DataFrame:
    """(doc_id, sentence_ids, licences, n_licences) for each row of ``docs``.

    Rules of several sentences come first, in their order; rules of one sentence name those that are left.
    ``sentence_ids``: known identifiers in text order, comma-joined; ``licences``: names of the matched rules in text order,
    comma-joined, repeats included. Null and empty texts have none. Repeated rows are reported each; an empty table gives an
    empty result. Sentences given beside the default ones must hold one of ``KEYS``.
    """
    known = F.create_map(*[F.lit(x) for k, s in enumerate(sentences, 1) if "*" not in s for x in (s, k)])
    gapped = [(k, _gapped(s)) for k, s in enumerate(sentences, 1) if "*" in s]

    def normal(s: Column) -> Column:
        return F.trim(F.regexp_replace(F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))

    def ident(s: Column) -> Column:
        found = F.try_element_at(known, s)
        by_gap = F.lit(0)
        for k, pattern in reversed(gapped):
            by_gap = F.when(s.rlike(pattern), k).otherwise(by_gap)
        return F.when(s.rlike(IN_SENTENCE), F.coalesce(found, by_gap)).otherwise(0)

    may = F.coalesce(F.col("text").rlike(IN_TEXT), F.lit(False))
    lines = F.transform(F.split("text", r"\r\n|\r|\n"), lambda x: F.regexp_replace(F.regexp_replace(x, SPDX, "SPDX-License-Identifier"), MARKS, ""))
    spdx = lambda x: F.concat(F.lit("\n\n"), F.regexp_replace(x, rf"{SPACE}+(?:AND|OR|WITH){SPACE}+", "\n\nSPDX-License-Identifier "), F.lit("\n\n"))
    alone = lambda x: F.when(F.contains(x, F.lit("SPDX-License-Identifier")), spdx(x)).when(ident(normal(x)) > 0, F.concat(F.lit("\n\n"), x, F.lit("\n\n"))).otherwise(x)
    marked = F.regexp_replace(F.array_join(F.transform(lines, alone), "\n"), ENDS, "$1\n\n")
    ids = F.when(may, F.filter(F.transform(F.filter(F.transform(F.split(marked, "\n\n+"), normal), lambda s: s != ""), ident), lambda i: i >= 0)).otherwise(F.array().cast("array<int>"))
    out = docs.select("doc_id", ids.alias("_ids"))
    match = F.array_join(F.transform("_ids", lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), "")
    several, single = _rules(sentences, rules)
    for name, pattern in several:
        match = F.regexp_replace(match, pattern, f"[{name}]")
    known_ids = F.filter("_ids", lambda i: i > 0)
    alone_names = F.create_map(*[F.lit(x) for i, name in single.items() for x in (f"<{i}>", f"[{name}]")])
    left = F.transform(F.regexp_extract_all(match, F.lit(r"<[0-9]+>|\[[^\]]+\]"), F.lit(0)), lambda x: F.when(F.startswith(x, F.lit("[")), x).otherwise(F.try_element_at(alone_names, x)))
    names = F.transform(F.filter(left, lambda x: x.isNotNull()), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    names = F.when(F.size(known_ids) > 0, names).otherwise(F.array().cast("array<string>"))
    found = out.select("doc_id", known_ids.alias("_known"), names.alias("_names"))
    return found.select("doc_id", F.array_join(F.col("_known").cast("array<string>"), ",").alias("sentence_ids"), F.array_join("_names", ",").alias("licences"), F.size("_names").cast("long").alias("n_licences"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    match = "array_to_string(list_transform(ids, lambda i: '<' || i || '>'), '')"
    several, single = _rules(SENTENCES, RULES)
    for name, pattern in several:
        match = f"regexp_replace({match}, '{pattern}', '[{name}]', 'g')"
    alone = "map([" + ", ".join(f"'<{i}>'" for i in single) + "], [" + ", ".join(f"'[{n}]'" for n in single.values()) + "])"
    exact = "map([" + ", ".join(f"'{s}'" for s in SENTENCES if "*" not in s) + "], [" + ", ".join(str(k) for k, s in enumerate(SENTENCES, 1) if "*" not in s) + "])"
    gapped = " ".join(f"WHEN regexp_matches(s, '{_gapped(s)}') THEN {k}" for k, s in enumerate(SENTENCES, 1) if "*" in s)
    quoted = {k: v.replace("'", "''") for k, v in {"marks": MARKS, "ends": ENDS}.items()}
    return f"""
        WITH documents_ AS (SELECT doc_id, row_number() OVER () AS row, CASE WHEN regexp_matches(text, '{IN_TEXT}') THEN text END AS text FROM documents),
        lines AS (
            SELECT row, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT row, list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'),
                lambda x: regexp_replace(regexp_replace(x, '{SPDX}', 'SPDX-License-Identifier', 'g'), '{quoted["marks"]}', '', 'g')) AS l FROM documents_ WHERE text IS NOT NULL)
        ),
        known AS (SELECT {exact} AS known),
        plain AS (SELECT row, n, line, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' ') AS s FROM lines),
        alone AS (
            SELECT row, n, CASE WHEN contains(line, 'SPDX-License-Identifier') THEN chr(10) || chr(10) || regexp_replace(line, '{SPACE}+(?:AND|OR|WITH){SPACE}+', chr(10) || chr(10) || 'SPDX-License-Identifier ', 'g') || chr(10) || chr(10)
                WHEN regexp_matches(s, '{IN_SENTENCE}') AND coalesce(known[s], CASE {gapped} ELSE 0 END) > 0 THEN chr(10) || chr(10) || line || chr(10) || chr(10) ELSE line END AS line
            FROM plain, known
        ),
        marked AS (SELECT row, regexp_replace(string_agg(line, chr(10) ORDER BY n), '{quoted["ends"]}', '\\1' || chr(10) || chr(10), 'g') AS text FROM alone GROUP BY row),
        cut AS (SELECT row, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT row, regexp_split_to_array(text, '\\n\\n+') AS l FROM marked)),
        sentences AS (SELECT row, n, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' ') AS s FROM cut),
        numbered AS (SELECT row, list(CASE WHEN regexp_matches(s, '{IN_SENTENCE}') THEN coalesce(known[s], CASE {gapped} ELSE 0 END) ELSE 0 END ORDER BY n) AS ids FROM sentences, known WHERE s <> '' GROUP BY row),
        matched AS (SELECT row, regexp_extract_all({match}, '<[0-9]+>|\\[[^\\]]+\\]') AS marks FROM numbered),
        m AS (
            SELECT doc_id, list_filter(coalesce(ids, []), lambda i: i > 0) AS known,
                list_filter(list_transform(marks, lambda x: CASE WHEN x[1] = '[' THEN x[2:-2] ELSE {alone}[x][2:-2] END), lambda x: x IS NOT NULL) AS names
            FROM documents_ LEFT JOIN numbered USING (row) LEFT JOIN matched USING (row)
        )
        SELECT doc_id, array_to_string(known, ',') AS sentence_ids, coalesce(array_to_string(names, ','), '') AS licences, coalesce(CAST(len(names) AS BIGINT), 0) AS n_licences FROM m
    """
