"""Licence scan by sentence rules, as DataFrame functions.

A text is cut into sentences, each is normalised and looked up among known
licence sentences.  The identifiers found, in text order, are matched against
ordered rules: a rule is a sequence of sentence identifiers that must appear in
that order, with nothing but unknown sentences between them.

* Comment marks and bullets at the beginning of lines go, so a notice in a
  source header reads like the notice alone.
* A sentence ends at a blank line, at ``. ! ? : ;`` followed by white space, and
  before a line that opens like a known sentence (its first nine words: several
  go on alike for eight).
  Other line ends are wrapping.  Where a wrapped sentence is unknown as a whole,
  its lines are looked up one by one (a one-line tag below a heading).
* Normalising: lower case, runs of anything but ``a-z0-9`` become one space,
  list markers go, the name of a holder becomes a fixed word (``HOLDERS``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-tag",
    "licensed under the mit license": "mit-tag",
    "licensed under the apache license version 2 0": "apache-2.0-tag",
    "licensed under the apache license version 2 0 the license": "apache-2.0-notice-1",
    "you may not use this file except in compliance with the license": "apache-2.0-notice-2",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2.0-notice-3",
    "you may obtain a copy of the license at": "apache-2.0-copy",
    "http www apache org licenses license 2 0": "apache-2.0-url",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
    "without warranties or conditions of any kind either express or implied": "apache-2.0-basis",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-tag",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0-tag",
    "this program is free software": "gpl-notice-1",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice-2",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-tag",
    "licensed under cc by 4 0": "cc-by-4.0-tag",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0-tag",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0-tag",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0-tag",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4.0-tag",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
    "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
    "to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied": "mit-warranty",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
    "the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that "
    "the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
    "warranties of merchantability and fitness": "isc-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
    "the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission": "bsd-endorse",
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
    "written permission": "bsd-endorse",
    "this software is provided by holder as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-2.0-terms",
    "this source code form is subject to the terms of the mozilla public license version 2 0": "mpl-2.0-terms",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2.0-copy",
    "this is free and unencumbered software released into the public domain": "unlicense-public",
    "all rights reserved": "all-rights-reserved",
}
#: Licence families of the free software notices, and names that tags may state.
FAMILIES = [("GPL", "gnu general public license", ["2", "3"]), ("LGPL", "gnu lesser general public license", ["2.1", "3"]),
            ("AGPL", "gnu affero general public license", ["3"])]
SPDX = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0",
        "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense"]
#: Rules as (licence, sentence identifiers in order).
RULES = [
    ("MIT", ["mit-tag"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("Apache-2.0", ["apache-2.0-tag"]),
    ("Apache-2.0", ["apache-2.0-notice-1", "apache-2.0-notice-2", "apache-2.0-notice-3"]),
    ("Apache-2.0", ["apache-2.0-notice-1", "apache-2.0-notice-2", "apache-2.0-copy", "apache-2.0-url"]),
    ("GPL-3.0", ["gpl-3.0-tag"]),
    ("GPL-2.0", ["gpl-2.0-tag"]),
    ("GPL", ["gpl-notice-1", "gpl-notice-2"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0-tag"]),
    ("CC-BY-4.0", ["cc-by-4.0-tag"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0-tag"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("MPL-2.0", ["mpl-2.0-terms", "mpl-2.0-copy"]),
    ("Unlicense", ["unlicense-public"]),
    ("proprietary", ["all-rights-reserved"]),
]


def _plain(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


for _family, _words, _versions in FAMILIES:  # the notice of the family, each version alone or with later ones
    for _version in _versions:
        _name = f"{_family}-{_version if '.' in _version else _version + '.0'}"
        _terms = f"you can redistribute it and/or modify it under the terms of the {_words} as published by the Free Software Foundation"
        for _tail in (f", either version {_version} of the License, or (at your option) any later version", f", version {_version} of the License",
                      f"; either version {_version} of the License, or (at your option) any later version", f", version {_version}"):
            if not _tail.startswith(";"):
                SENTENCES[_plain(_terms + _tail)] = f"{_name.lower()}-terms"
            else:  # cut behind the semicolon: the family and the version are sentences of their own
                SENTENCES[_plain(_terms)] = f"{_family.lower()}-terms"
                SENTENCES[_plain(_tail)] = f"version-{_version}-or-later"
        RULES += [(_name, ["gpl-notice-1", f"{_name.lower()}-terms"]), (_name, ["gpl-notice-1", f"{_family.lower()}-terms", f"version-{_version}-or-later"])]
for _name in SPDX:
    for _suffix in ("", "-only", "-or-later"):
        SENTENCES[_plain(f"SPDX-License-Identifier {_name}{_suffix}")] = f"spdx-{_name.lower()}"
    RULES.append((_name, [f"spdx-{_name.lower()}"]))

#: A licence sentence holds one of these; other sentences need not be normalised.
HINT = r"licen[cs]e|permission|copyright|redistribut|warrant|free[ \t\n]+software|rights[ \t\n]+reserved|mozilla|public[ \t\n]+domain"
#: Words by which a line is known to open a sentence.
OPENING = 9
#: Ends a sentence; a text that holds it is cut there.
BREAK = "\x01"
#: Normalised wordings that name a holder, a project or an address -> the known sentence's own words.
HOLDERS = [
    ("^neither the name of .* nor the names of its contributors", "neither the name of holder nor the names of its contributors"),
    ("^neither the name of .* nor the names of the contributors", "neither the name of holder nor the names of its contributors"),
    ("^this software is provided by .* as is and any express", "this software is provided by holder as is and any express"),
    ("^.* is free software$", "this program is free software"),
    ("https", "http"),
    ("^(?:[0-9]{1,2}|[a-h]|i{1,3}) ", ""),
]


def _cuts(sentences: dict[str, str]) -> list[tuple[str, str]]:
    """Replacements that cut a lower-case text: pattern and what stands for it (``$1`` the group)."""
    opens = sorted({"[^a-z0-9]+".join(s.split()[:OPENING]) for s in sentences})
    return [
        ("\r\n?", "\n"),
        ("\n[ \t*#;%>/!<|-]+", "\n"),
        ("\n\n+", BREAK),
        ("spdx-license-identifier:", "spdx-license-identifier"),
        ("([.!?:;][\"')]*)[ \t\n]+", "$1" + BREAK),
        ("\n([^a-z0-9\n]*(?:" + "|".join(opens) + "))", BREAK + "$1"),
    ]


def _known(text: Column, sentences: dict[str, str]) -> Column:
    """Identifiers of the known sentences, in text order."""
    body = F.concat(F.lit("\n"), F.lower(text))
    for pattern, to in _cuts(sentences):
        body = F.regexp_replace(body, pattern, to)
    table = F.create_map(*[F.lit(x) for kv in sentences.items() for x in kv])

    def named(part: Column) -> Column:
        plain = F.trim(F.regexp_replace(part, "[^a-z0-9]+", " "))
        for pattern, to in HOLDERS:
            plain = F.regexp_replace(plain, pattern, to)
        return F.element_at(table, plain)

    likely = F.filter(F.split(body, BREAK), lambda s: s.rlike(HINT))
    whole = F.transform(likely, lambda s: F.struct(s.alias("s"), named(s).alias("id")))
    ids = F.transform(whole, lambda t: F.when(t["id"].isNotNull() | ~F.contains(t["s"], F.lit("\n")), F.array(t["id"]))
                      .otherwise(F.transform(F.split(t["s"], "\n"), named)))
    return F.filter(F.flatten(ids), lambda i: i.isNotNull())


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """``doc_id, n_sentences, sentence_ids, licenses, license`` of every row.

    ``licenses``: names of the rules matched, sorted, comma-joined; a rule that
    matches only inside the place of a longer one is not named.  ``license`` is the
    one whose rule matches first in the text (ties: the longer rule, then the
    name), null without a match.  Null and empty texts match nothing.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    ids = F.when(F.lower(text).rlike(HINT), _known(text, sentences)).otherwise(F.array().cast("array<string>"))
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), ids.alias("ids"))
    joined = F.concat(F.lit(","), F.concat_ws(",", "ids"), F.lit(","))
    src = src.withColumn("joined", joined)
    found = F.array(*[
        F.struct(F.instr("joined", "," + ",".join(seq) + ",").alias("at"), F.lit(-len(seq)).alias("size"), F.lit(name).alias("name"),
                 F.lit(len(",".join(seq))).alias("span"))
        for name, seq in rules])
    src = src.withColumn("hits", F.when(F.size("ids") > 0, F.array_sort(F.filter(found, lambda r: r["at"] > 0))))
    inside = lambda r, o: (o["span"] > r["span"]) & (o["at"] <= r["at"]) & (o["at"] + o["span"] >= r["at"] + r["span"])
    src = src.withColumn("hits", F.coalesce(
        F.filter("hits", lambda r: ~F.exists("hits", lambda o: inside(r, o))), F.filter(found, lambda r: F.lit(False))))
    return src.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.concat_ws(",", "ids").alias("sentence_ids"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("hits", lambda r: r["name"])))).alias("licenses"),
        F.get(F.col("hits"), 0)["name"].alias("license"))


def oracle_sql() -> str:
    """The same for DuckDB."""
    def quote(s: str) -> str:
        escapes = {"\n": "chr(10)", "\t": "chr(9)", "\r": "chr(13)", BREAK: "chr(1)"}
        parts = re.split("([\n\t\r\x01])", s.replace("'", "''"))
        return " || ".join(escapes.get(p, f"'{p}'") for p in parts if p) or "''"

    def replaced(expr: str, steps: list[tuple[str, str]]) -> str:
        for pattern, to in steps:
            expr = f"regexp_replace({expr}, {quote(pattern)}, {quote(to.replace('$1', chr(92) + '1'))}, 'g')"
        return expr

    keys, values = ", ".join(map(quote, SENTENCES)), ", ".join(map(quote, SENTENCES.values()))
    rules = ",\n    ".join(
        f"{{'at': strpos(joined, {quote(',' + ','.join(seq) + ',')}), 'size': {-len(seq)}, 'name': {quote(name)}, 'span': {len(','.join(seq))}}}"
        for name, seq in RULES)
    return f"""
WITH cut AS (
  SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), {quote(HINT)})
    THEN list_filter(string_split({replaced("chr(10) || lower(coalesce(text, ''))", _cuts(SENTENCES))}, chr(1)),
                     lambda s: regexp_matches(s, {quote(HINT)})) ELSE [] END AS l
  FROM documents
), part AS (  -- a sentence whole (line 0), and each of its lines
  SELECT doc_id, pos, e.line AS line, e.body AS body FROM (
    SELECT doc_id, s.pos AS pos, unnest(list_concat([{{'line': CAST(0 AS BIGINT), 'body': s.body}}],
        list_transform(string_split(s.body, chr(10)), lambda t, i: {{'line': CAST(i AS BIGINT), 'body': t}}))) AS e
    FROM (SELECT doc_id, unnest(list_transform(l, lambda t, i: {{'pos': i, 'body': t}})) AS s FROM cut))
), plain AS (
  SELECT doc_id, pos, line, {replaced("trim(regexp_replace(body, '[^a-z0-9]+', ' ', 'g'))", HOLDERS)} AS p FROM part
), known AS (
  SELECT unnest([{keys}]) AS p, unnest([{values}]) AS id
), found AS (
  SELECT doc_id, pos, line, id, max(CASE WHEN line = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pos) AS whole
  FROM plain JOIN known USING (p)
), named AS (
  SELECT c.doc_id, coalesce(i.ids, []) AS ids FROM cut c
  LEFT JOIN (SELECT doc_id, list(id ORDER BY pos, line) AS ids FROM found WHERE whole = 0 OR line = 0 GROUP BY doc_id) i USING (doc_id)
), joined AS (
  SELECT doc_id, ids, ',' || array_to_string(ids, ',') || ',' AS joined FROM named
), hit AS (
  SELECT doc_id, ids, list_sort(list_filter([
    {rules}], lambda r: r.at > 0)) AS hits FROM joined
), best AS (
  SELECT doc_id, ids, list_filter(hits, lambda r: len(list_filter(hits, lambda o: o.span > r.span AND o.at <= r.at AND o.at + o.span >= r.at + r.span)) = 0) AS hits FROM hit
)
SELECT doc_id, len(ids) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
       array_to_string(list_sort(list_distinct(list_transform(hits, lambda r: r.name))), ',') AS licenses,
       list_extract(hits, 1).name AS license
FROM best"""
