"""Licence scans by sentence rules, in DataFrame functions.

Texts are cut into sentences at ``.``, ``!`` or ``?`` before white space and at
blank lines (a line without ASCII letters or digits is blank, so comment marks
don't matter); a single newline is a space, so wrapped licences read like
unwrapped ones.  Sentences are normalised (ASCII letters lower case, everything
but a-z and 0-9 one space, a statement's opening such as "this work is licensed
under the" becomes "under"), and a table maps known licence sentences to
identifiers.  The table is made by the same cut and normalisation from wordings
of the licences; slots are sentences with a name in them, known by their head
and tail.  A sentence that is not known is looked up line by line, for
statements that stand on a line of their own without a full stop.  A document's
identifiers, in order, are matched against ordered licence rules; a rule
matches where its identifiers stand next to each other in that sequence,
whatever other sentences lie between.  A reservation of all rights is
``Proprietary`` where no other rule matches.

Scale: a pass without a shuffle; the tables are constants of the plan, and the
expressions are linear in the text (no run is scanned from more than one place).

Edge cases: null or empty texts have no sentence and no licence; a sentence may
come several times, and each occurrence is in the sequence; repeated rows are
scanned alike; whole texts count, at any length; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrylens.llm.common import table

_CUT = r"""[.!?]["')\]]*(?:[ \t\n\r\f]|\z)|\n[^a-z0-9\n]*\n"""
_OPENING = "^(this [a-z]+ is )?(licensed|released|distributed|made available|available) under (the terms of )?(an? |the )?"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# fixed values: wordings of licences and of their notices
WORDINGS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.""",
    "BSD-4-Clause": """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product
includes software developed by the organization.
4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.""",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Apache-2.0": "You may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which
is available at https://www.eclipse.org/legal/epl-2.0/""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all
subject to the following:""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to
this software to the public domain worldwide. This software is distributed without any warranty.""",
}
# fixed values: names by which a statement ("licensed under ...") means a licence
NAMES = {
    "MIT": ("MIT license", "MIT"), "ISC": ("ISC license", "ISC"), "Zlib": ("zlib license",), "Unlicense": ("Unlicense",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause license", "2-Clause BSD license", "simplified BSD license"),
    "BSD-3-Clause": ("BSD 3-Clause license", "3-Clause BSD license", "new BSD license", "modified BSD license"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "EPL 2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC0-1.0": ("CC0 1.0", "Creative Commons CC0 1.0 Universal license", "Creative Commons Zero license"),
}
# fixed values: what the families of notices and statements are made of
GNU = (("GPL", "General Public License", ("2.0", "3.0")), ("LGPL", "Lesser General Public License", ("2.1", "3.0")), ("AGPL", "Affero General Public License", ("3.0",)))
CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
      ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
CC_VERSIONS = (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))


def short_sentences(text: str) -> list[str]:
    """The normalised sentences of a short text, as ``sentences`` makes them."""
    plain = (" ".join(re.findall("[a-z0-9]+", s)) for s in re.split(_CUT.replace(r"\z", r"\Z"), text.lower()))
    return [re.sub(_OPENING, "under ", s) for s in plain if s]


def _one(text: str) -> str:
    return short_sentences(text)[0]


def _tables() -> tuple[dict[str, str], list[tuple[str, str, str]], list[tuple[str, str]]]:
    """Known sentences, slots (head, tail, identifier) and rules (licence, identifiers)."""
    known: dict[str, str] = {_one("All rights reserved."): "reserved"}
    apache = "under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
    known[_one(f"Licensed {apache}")] = "Apache-2.0.grant"
    slots = [
        ("", _one(apache), "Apache-2.0.grant"),
        (_one("Neither the name of"), _one("may be used to endorse or promote products derived from this software without specific prior written permission"), "BSD.names"),
        (_one("All advertising materials mentioning features or use of this software must display the following acknowledgement"), "", "BSD.advertising"),
        (_one("This software is provided by"), _one("and fitness for a particular purpose are disclaimed"), "BSD.disclaimer"),
    ]
    rules = [("Apache-2.0", "Apache-2.0.grant")]

    def named(licence: str, name: str) -> None:
        known.setdefault(_one(f"Licensed under the {name}"), f"{licence}.name")

    for licence, names in NAMES.items():
        for name in names:
            named(licence, name)
    for code, form in CC:
        for version, kind in CC_VERSIONS:
            for name in (f"CC {code} {version}", f"Creative Commons {form} {version} license", f"Creative Commons {form} {version} {kind} license"):
                named(f"CC-{code}-{version}", name)
    for code, form, versions in GNU:
        known[_one(f"See the GNU {form} for more details.")] = f"{code}.see"
        for version in versions:
            short = version.removesuffix(".0")
            for name in (f"GNU {form}, version {short}", f"GNU {form} v{short}", f"GNU {code} version {short}", f"GNU {code} v{short}", f"{code} version {short}", f"{code}v{short}", f"{code}-{version}"):
                named(f"{code}-{version}", name)
            grant = f"is free software; you can redistribute it and/or modify it under the terms of the GNU {form} as published by the Free Software Foundation"
            for after, choice in (("or-later", f", either version {short} of the License, or (at your option) any later version"), ("or-later", f"; either version {short}, or (at your option) any later version"),
                                  ("only", f", version {short} of the License"), ("only", f"; version {short} of the License only"), ("only", f", version {short}")):
                licence = f"{code}-{version}-{after}"
                slots.append(("", _one(grant + choice), f"{licence}.grant"))
                rules.append((licence, f"{licence}.grant GNU.warranty {code}.see"))
    for what in ("program", "library", "software", "file"):
        known[_one(f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.")] = "GNU.warranty"
    rules += [(name.removesuffix(".name"), name) for name in dict.fromkeys(known.values()) if name.endswith(".name")]
    for licence, wording in WORDINGS.items():
        parts = [s for s in short_sentences(wording) if re.search("[a-z]", s)]
        for k, s in enumerate(parts, 1):
            if s not in known and _slot(slots, s) is None:
                known[s] = f"{licence}.{k}"
        rules.append((licence, " ".join(known.get(s) or _slot(slots, s) for s in parts)))
    for licence in dict.fromkeys(name for name, _ in rules):
        known.setdefault(_one(f"SPDX-License-Identifier: {licence}"), f"{licence}.spdx")
        rules.append((licence, f"{licence}.spdx"))
    return known, slots, list(dict.fromkeys(rules))


def _slot(slots: list[tuple[str, str, str]], s: str) -> str | None:
    return next((name for head, tail, name in slots if s.startswith(head) and s.endswith(tail)), None)


SENTENCES, SLOTS, RULES = _tables()


def _normalised(raw: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(raw, "[^a-z0-9]+", " ")), _OPENING, "under ")


def sentences(text: Column) -> Column:
    """The sentences of a text as structs (raw, plain), empty ones left out."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _CUT, -1)
    return F.filter(F.transform(parts, lambda s: F.struct(s.alias("raw"), _normalised(s).alias("plain"))), lambda s: s["plain"] != "")


def _identified(plain: Column) -> Column:
    """The identifier of a normalised sentence, null if it is not known."""
    known = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))
    out = F.when(plain.isin(*SENTENCES), known[plain])
    for head, tail, name in SLOTS:
        out = out.when(F.startswith(plain, F.lit(head)) & F.endswith(plain, F.lit(tail)), F.lit(name))
    return out


def identifiers(found: Column) -> Column:
    """The identifiers of the known sentences, in order; a sentence that is not
    known gives those of its lines."""
    def of(s: Column) -> Column:
        lines = F.when(F.contains(s["raw"], F.lit("\n")), F.transform(F.split(s["raw"], "\n", -1), lambda x: _normalised(x))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.when(s["id"].isNotNull(), F.array(s["id"])).otherwise(F.array_compact(F.transform(lines, _identified)))

    whole = F.transform(found, lambda s: F.struct(s["raw"].alias("raw"), _identified(s["plain"]).alias("id")))
    return F.flatten(F.transform(whole, of))


def scan(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_sentences, sentence_ids, licences,
    n_licences; lists are joined by commas, licences are sorted."""
    rows = docs.select("doc_id", sentences(F.col("text")).alias("s"))
    rows = rows.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), identifiers(F.col("s")).alias("ids"))
    rows = rows.withColumn("line", F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" ")))
    matched = F.array_distinct(F.array_compact(F.array(*(F.when(F.contains("line", F.lit(f" {rule} ")), F.lit(name)) for name, rule in RULES))))
    rows = rows.withColumn("found", F.when(F.size("ids") > 0, F.array_sort(matched)).otherwise(F.expr("cast(array() as array<string>)")))
    found = F.when((F.size("found") == 0) & F.array_contains("ids", "reserved"), F.array(F.lit("Proprietary"))).otherwise(F.col("found"))
    return rows.select("doc_id", "n_sentences", F.array_join("ids", ",").alias("sentence_ids"), F.array_join(found, ",").alias("licences"), F.size(found).cast("bigint").alias("n_licences"))


def op4_license_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    rules = ", ".join(f"('{n}', ' {r} ')" for n, r in RULES)
    slots = " ".join(f"WHEN starts_with(plain, '{head}') AND ends_with(plain, '{tail}') THEN '{name}'" for head, tail, name in SLOTS)
    quoted = _CUT.replace("'", "''")
    plain = f"regexp_replace(trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')), '{_OPENING}', 'under ')"
    return rf"""
WITH known(plain, known_id) AS (VALUES {known}), rules(licence, rule) AS (VALUES {rules}),
docs AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{quoted}') AS parts FROM documents),
cut AS (SELECT row_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS place FROM docs),
clean AS (SELECT *, {plain} AS plain FROM cut),
whole AS (SELECT c.*, coalesce(k.known_id, CASE {slots} END) AS id FROM clean c LEFT JOIN known k USING (plain) WHERE c.plain <> ''),
lines AS (SELECT row_id, place, unnest(string_split(raw, chr(10))) AS raw, generate_subscripts(string_split(raw, chr(10)), 1) AS line
          FROM whole WHERE id IS NULL AND contains(raw, chr(10))),
clean_lines AS (SELECT *, {plain} AS plain FROM lines),
line_ids AS (SELECT c.row_id, c.place, c.line, coalesce(k.known_id, CASE {slots} END) AS id FROM clean_lines c LEFT JOIN known k USING (plain)),
ids AS (SELECT row_id, place, 0 AS line, id FROM whole WHERE id IS NOT NULL UNION ALL SELECT row_id, place, line, id FROM line_ids WHERE id IS NOT NULL),
listed AS (SELECT row_id, string_agg(id, ',' ORDER BY place, line) AS sentence_ids FROM ids GROUP BY row_id),
counted AS (SELECT row_id, count(*) AS n_sentences FROM whole GROUP BY row_id),
matched AS (SELECT l.row_id, string_agg(DISTINCT r.licence, ',' ORDER BY r.licence) AS licences, count(DISTINCT r.licence) AS n_licences
            FROM listed l JOIN rules r ON contains(' ' || replace(l.sentence_ids, ',', ' ') || ' ', r.rule) GROUP BY l.row_id),
reserved AS (SELECT l.row_id FROM listed l ANTI JOIN matched m USING (row_id) WHERE contains(',' || l.sentence_ids || ',', ',reserved,'))
SELECT d.doc_id, coalesce(c.n_sentences, 0) AS n_sentences, coalesce(l.sentence_ids, '') AS sentence_ids,
       coalesce(m.licences, CASE WHEN r.row_id IS NOT NULL THEN 'Proprietary' END, '') AS licences, coalesce(m.n_licences, CASE WHEN r.row_id IS NOT NULL THEN 1 END, 0) AS n_licences
FROM docs d LEFT JOIN counted c USING (row_id) LEFT JOIN listed l USING (row_id) LEFT JOIN matched m USING (row_id) LEFT JOIN reserved r USING (row_id)"""


OP4_SQL = _sql()
