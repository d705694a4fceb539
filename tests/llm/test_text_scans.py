import hashlib
import random
import re
import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

from ticklake.llm import html_extract, langid, license_scan, secret_scan

from .conftest import words

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found)


def joined(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_texts():
    rng = random.Random(11)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    parts = [lambda: f"password={hexes(16)}", lambda: f'Token = "{hexes(40)}"', lambda: f"AKIA{upper(16)}", lambda: f"AKIA{upper(12)}", lambda: hexes(24),
             lambda: hexes(23), lambda: "secret: token = abcdefgh", lambda: "api_key: 'short'", lambda: f"APIKEY={mixed(30)}", lambda: "é🙂ß", lambda: "token=",
             lambda: "password password=123456", lambda: f"AKIAAKIA{upper(20)}", lambda: "aaaa" * 8]
    texts = []
    for _ in range(150):
        t = words(rng, 20, 500)
        for _ in range(rng.randrange(4)):
            t.insert(rng.randrange(len(t)), rng.choice(parts)())
        texts.append(rng.choice([" ", "", "\n"]).join(t))
    return texts + ["", None, "password=" + "x" * 100_000, "no secrets " * 30_000 + "token=abcdef1"], mixed


def test_base_spans_equal_python_s(docs_of):
    texts, _ = secret_texts()
    docs = docs_of(texts)
    for r in secret_scan.scan(docs, secret_scan.fit(docs)).collect():
        want = base(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in want) for k in range(3)]
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert [s for s in spans if s[0] != "markov"] == [s.split(":") for s in joined(want).split(",") if s]
        assert len([s for s in spans if s[0] == "markov"]) == r["n_markov"]


def test_markov_models_tell_random_from_ordinary(docs_of):
    texts, mixed = secret_texts()
    docs = docs_of(texts)
    model = secret_scan.fit(docs)
    ordinary = ["internationalization_of_configurations", "getUserAccountManagerFactoryBean", "this-is-a-long-hyphenated-word"]
    plain = " ".join(f"The {o} was here and there in the internationalisation manager of the account." for o in ordinary * 20)
    # ordinary identifiers are learned from the words around known secrets
    learn = docs_of([*(t or "" for t in texts), *[f"{plain} password=abcdef123456 {plain}"] * 20])
    model = secret_scan.fit(learn)
    random_ones = [mixed(32) for _ in range(40)]
    got = secret_scan.scan(docs_of(random_ones + ordinary), model).orderBy("doc_id").collect()
    assert sum(r["n_markov"] for r in got[:40]) >= 38
    assert sum(r["n_markov"] for r in got[40:]) == 0


ORDINARY = ["12345678901234567890", "20240115/20240116/20240117", "the/quick/brown/fox/jumped/over", "1234567890123456789012345678901234567890",
            "getUserAccountManagerFactoryBean", "MAXIMUM_NUMBER_OF_CONNECTIONS", "2024-01-15T10-20-30/2024-01-16", "this-is-a-long-hyphenated-word",
            "usr/local/share/applications/settings", "internationalization_of_configurations", "=" * 60, "-" * 40, "_" * 30, "Donaudampfschifffahrtsgesellschaft",
            "314159265358979323846264338327950288", "version-12/release-2024-10-04/build-1771", "THE/QUICK/BROWN/FOX/JUMPED/OVER", "AAAAAAAAAAAAAAAAAAAAAAAAAAAA"]


def test_a_corpus_without_marks_still_finds_random_strings_and_leaves_the_rest(docs_of):
    _, mixed = secret_texts()
    rng = random.Random(4)
    texts = [" ".join(words(rng, 30, 400)) for _ in range(150)]
    for i in range(50):
        texts[i] = f"{texts[i]} {mixed(32)} {texts[i]}"
    for i, o in enumerate(ORDINARY):
        texts[60 + i] = f"{texts[60 + i]} {o} {texts[60 + i]}"
    docs = docs_of(texts)
    got = {r["doc_id"]: r for r in secret_scan.scan(docs, secret_scan.fit(docs)).collect()}
    assert all(r["n_assign"] == 0 and r["n_access"] == 0 for r in got.values())
    assert sum(got[i]["n_markov"] > 0 for i in range(50)) >= 48
    wrong = [texts[i][-60:] if i < 60 else ORDINARY[i - 60] for i in range(50, 150) if got[i]["n_markov"] and i < 60 + len(ORDINARY)]
    assert not wrong and not sum(got[i]["n_markov"] for i in range(60 + len(ORDINARY), 150))


def test_repeated_rows_are_each_scanned(docs_of):
    docs = docs_of(["token=abcdef123"]).union(docs_of(["token=abcdef123"]))
    assert [r["n_assign"] for r in secret_scan.scan(docs, secret_scan.fit(docs)).collect()] == [1, 1]


def test_redaction(docs_of):
    texts = ["a password=abcdef12 b AKIA" + "A" * 16 + " c", "token = " + "0123456789abcdef" * 3 + " end", "plain é", "", None]
    docs = docs_of(texts).withColumn("spans", F.lit(1))
    out = [r["redacted"] for r in secret_scan.redact(docs, secret_scan.fit(docs)).orderBy("doc_id").collect()]
    assert out == ["a [assign] b [access] c", "[assign] end", "plain é", "", ""]
    assert secret_scan.scan(docs.where("false"), secret_scan.fit(docs.where("false"))).count() == 0


SAMPLES = {
    "en": "the and of to in is that it was for on are with as his they at be this from have or by one had not but what all were when".split(),
    "fr": "le la les des une est dans que pour pas sur qui avec plus par ce sont être ont cette aux même été faire très aussi où".split(),
    "de": "der die und das nicht ist ein zu sich mit auf für von dem als auch es an werden aus er hat dass sie nach wird bei einer".split(),
}


def language_docs(spark, n=240, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SAMPLES))
        text = " ".join(rng.choice(SAMPLES[lang]) for _ in range(rng.randrange(8, 120)))
        rows.append((i, text, lang, "s", len(text)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows


def test_language_held_out_accuracy(spark):
    import zlib
    docs, rows = language_docs(spark)
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {r[0] for r in held} == {i for i, r in got.items() if r["held_out"]}
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_mixtures_and_edges(spark):
    docs, rows = language_docs(spark)
    model = langid.fit(docs)
    en, fr = (" ".join(SAMPLES[k] * 12) for k in ("en", "fr"))
    odd = spark.createDataFrame(
        [(1, en + " " + " ".join(SAMPLES["fr"] * 4), 7), (2, None, 7), (3, "", 7), (4, "123 !? 🙂", 7), (5, "é", 7), (None, fr, 7), (6, en.upper(), 7),
         (6, en.upper(), 7), (7, fr * 300, 7)], "doc_id long, text string, lang_pred int")
    got = langid.predict(odd, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 9
    assert by[1]["lang_pred"] == "en" and 0.6 < by[1]["score"] < 0.9  # a quarter is French
    assert [by[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and by[2]["score"] == 0
    assert by[5]["lang_pred"] in SAMPLES and by[None]["lang_pred"] == "fr" and not by[None]["held_out"]
    assert by[6]["lang_pred"] == "en" and by[7]["lang_pred"] == "fr"
    empty = langid.fit(docs.where("false"))
    assert {r["lang_pred"] for r in langid.predict(odd, empty).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).count() == 0


def test_language_never_reads_the_label_of_what_it_predicts(spark):
    docs, _ = language_docs(spark)
    model = langid.fit(docs)
    a = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")), model).collect()}
    assert a == b


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="page">
<header><div>Site name</div></header><nav><ul><li><a href="/">Home</a><li><a href="/x">About us</a></ul></nav>
<div class="cookie-notice">We use cookies. <a href="#">More</a></div><!-- <p>gone</p> -->
<main><article><h1>A &amp; B</h1><p>First   <b>bold</b>
paragraph &eacute;.<p>Second<br>one.</p><ul><li>point one<li>point <a href="#">two</a></ul><form><label>Name</label><input></form>
<div class="ad">Buy now</div><aside>Read also</aside><section id="comments"><p>Nice article, thanks!</p></section></article></main>
<div class="sidebar"><p>Popular</p></div><footer>&copy; 2020</footer>"""


def test_html_extraction(spark):
    pages = [(1, "u1", PAGE), (2, "u2", None), (3, "u3", ""), (4, "u4", "<p>unclosed"), (4, "u4", "<p>unclosed"), (None, None, "<script>x</script>"),
             (6, "u6", "<article><p>" + "word " * 50_000 + "</article>"), (7, "u7", "<article>a</nav></div><p>b < c</article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_extract.extract(df).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == 8
    assert by[1][2] == "A & B\nFirst bold paragraph é.\nSecond one.\npoint one\npoint two"
    assert by[2][2:] == ("", 0) and by[3][2:] == ("", 0) and by[None][2] == ""
    assert by[6][2] == ("word " * 50_000).strip() and by[7][2] == "a\nb < c"
    assert all(r[3] == len(r[2]) for r in got)
    assert html_extract.extract(df.where("false")).count() == 0


STORY = "<h1>Title of it</h1>" + "".join(f"<p>Paragraph {i} tells a part of the story in a sentence of some length.</p>" for i in range(6))
TOLD = "Title of it\n" + "\n".join(f"Paragraph {i} tells a part of the story in a sentence of some length." for i in range(6))
MENU = '<nav class="main-nav"><a href="/">Home</a> <a href="/b">Blog</a></nav>'
LAYOUTS = {
    "state on body": f'<body class="has-sidebar no-comments">{MENU}<article>{STORY}</article><footer>x</footer>',
    "state on a wrapper": f'<div id="page" class="with-header">{MENU}<article>{STORY}</article></div>',
    "name on main": f'{MENU}<main class="legal-content">{STORY}</main><div class="site-footer">Imprint</div>',
    "wrapper named like a frame": f'<div class="sidebar-right layout">{MENU}<article>{STORY}</article></div><div class="cookie-notice">We use cookies.</div>',
    "widget wrapper and a real sidebar": f'<div class="widget"><main>{STORY}</main></div><div class="sidebar"><p>Popular now</p></div>',
    "own header": f'<header><div>Site name</div></header><article><header>{STORY[:20]}</header>{STORY[20:]}</article>',
    "teasers in a related box": f'<article>{STORY}</article><div class="related"><article><p>Another story</p></article></div>',
    "advert inside": f'<article>{STORY}<div class="ad-slot">Buy now</div><div class="share social">Tweet</div></article>',
    "talk after": f'<article>{STORY}</article><div id="comments"><p>Nice, thanks a lot for this.</p><div class="reply">Same here.</div></div>',
    "a notice on top": f'<div class="alert" role="alert">Please log in</div><div class="entry-content">{STORY}</div>',
}


@pytest.mark.parametrize("layout", list(LAYOUTS))
def test_whole_pages_of_many_layouts(layout):
    assert html_extract.main_text(f"<!DOCTYPE html><html><head><title>T</title></head>{LAYOUTS[layout]}</html>") == TOLD


def test_the_tree_fits_its_table():
    assert all(html_extract.decide(html_extract.tree(), r[:-1]) == bool(r[-1]) for r in html_extract.LABELLED)


# The notices as their owners publish them.
MIT = """MIT License

Copyright (c) 2021 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""
BSD3 = """Copyright 2008 Some Company Inc. All rights kept.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of Some Company Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY SOME COMPANY AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
BSD2 = BSD3[:BSD3.index("3. Neither")] + BSD3[BSD3.index("THIS SOFTWARE"):]
APACHE = """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    https://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
LGPL = GPL2.replace("This program", "This library").replace("General", "Lesser General").replace("version 2", "version 2.1")
AGPL = GPL3.replace("This program is free", "Thing is free").replace("General", "Affero General")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Copyright (c) 2019, Some Body

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
NOTICES = {"MIT": MIT, "BSD-3-Clause": BSD3, "BSD-2-Clause": BSD2, "Apache-2.0": APACHE, "GPL-3.0": GPL3, "GPL-2.0": GPL2, "LGPL-2.1": LGPL, "AGPL-3.0": AGPL,
           "MPL-2.0": MPL, "ISC": ISC}


def laid_out(notice, width, mark):
    """Every paragraph wrapped, every line behind a comment mark."""
    paragraphs = [textwrap.wrap(p.strip(), width, break_long_words=False, break_on_hyphens=False) if width else [p] for p in notice.split("\n\n")]
    lines = [line for i, p in enumerate(paragraphs) for line in ([""] if i else []) + p]
    body = "\n".join((mark + line).rstrip(" ") for line in lines)
    return {"": body, " * ": "/*\n" + body + "\n */\nint main() { return 0; }"}.get(mark, body + "\n\nx = 1\n")


def license_texts():
    texts, want = [], []
    for name, notice in NOTICES.items():
        for width in (0, 30, 60, 72, 79, 100):
            for mark in ("", " * ", "# ", "// "):
                for text in (laid_out(notice, width, mark), "Some words before\nand after a title\n\n" + laid_out(notice, width, mark).replace("\n", "\r\n")):
                    texts.append(text)
                    want.append(name)
    for name, notice in NOTICES.items():  # a heading and a copyright line without blank lines around them
        texts.append("The Licence\nCopyright (c) 2020 A. Body\n" + laid_out(notice[notice.index("\n\n") + 2:] if notice[:4] in ("MIT ", "Copy") else notice, 70, ""))
        want.append(name)
    texts += [f"// SPDX-License-Identifier: {n}\n#include <x>" for n in ("MIT", "GPL-2.0-only", "LGPL-2.1-or-later", "Apache-2.0")]
    want += ["MIT", "GPL-2.0", "LGPL-2.1", "Apache-2.0"]
    return texts, want


def test_whole_notices_in_any_layout(docs_of):
    texts, want = license_texts()
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(docs_of(texts)).collect()}
    wrong = [(want[i], got[i], t) for i, t in enumerate(texts) if got[i] != want[i]]
    assert not wrong, (len(wrong), wrong[0])


def test_license_sql_twin(docs_of):
    texts = license_texts()[0] + ["Intro\nReleased under the MIT License\nand more", "", None, "the licence\n\n\n" * 2000, "licen\u0001se.\t Licensed under CC BY 4.0\rx"]
    docs = docs_of(texts)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(license_scan.oracle_sql()).df().sort_values("doc_id").reset_index(drop=True)
    got = license_scan.scan(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    for c in want.columns:
        assert got[c].astype(object).where(got[c].notna(), None).tolist() == want[c].astype(object).where(want[c].notna(), None).tolist(), c


def test_license_rules(spark, docs_of):
    texts = ["Intro.\nReleased under the MIT License.", "This work is licensed under the GNU General Public License, version 3.\nx", "LICENSED under  cc by-nc 4.0!",
             "Licensed under the Apache License, Version 2.0. All rights reserved.", "The license of the thing.", "", None,
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.\n"
             "Some words. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.\n"
             'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.',
             "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software."]
    got = {r["doc_id"]: (r["license"], r["licenses"], r["n_sentences"]) for r in license_scan.scan(docs_of(texts).withColumn("ids", F.lit(1))).collect()}
    assert got[0] == ("MIT", "MIT", 1) and got[1][0] == "GPL-3.0" and got[2][0] == "CC-BY-NC-4.0"
    assert got[3] == ("Apache-2.0", "Apache-2.0,proprietary", 2)
    assert got[4] == (None, "", 0) and got[5] == (None, "", 0) and got[6] == (None, "", 0)
    assert got[7] == ("MIT", "MIT", 3) and got[8] == (None, "", 1)


@pytest.mark.parametrize("scan", [license_scan.scan])
def test_license_empty(docs_of, scan):
    assert scan(docs_of([]).where("false")).count() == 0
