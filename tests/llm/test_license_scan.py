import random
import re

import regex

from terrace.llm import license_scan

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS."""
CASES = {
    1: ("Some prose.\nReleased under the MIT License.\nMore prose.", ["MIT"], 0),
    2: (APACHE, ["Apache-2.0"], 1),
    3: ("This work is licensed under the GNU General Public License, version 3. Also Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0", "GPL-3.0"], 0),
    4: ("It is licensed to nobody. The licence is odd!", [], 2),
    5: ("Nothing of the kind.", [], 0),
    6: (None, [], 0),
    7: ("", [], 0),
    8: ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published; either version 3 of the License, or (at your option) any later version.", ["GPL-3.0-or-later"], 0),
    9: ("Licensed under CC BY 4.0. " * 2000, ["CC-BY-4.0"], 0),
    10: ("Released under the MIT License. Released under the MIT License.", ["MIT"], 0),
}


def test_cases(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()] + [(None, CASES[1][0])], "doc_id long, text string").selectExpr("*", "1 AS licenses", "2 AS r")
    got = {r.doc_id: (list(r.licenses), r.n_unmatched) for r in license_scan.scan(df).collect()}
    assert got.pop(None) == (["MIT"], 0)
    assert got == {k: (v[1], v[2]) for k, v in CASES.items()}
    assert license_scan.scan(df.limit(0)).count() == 0


def test_every_known_sentence_has_a_trigger():
    for _, phrase in license_scan.SENTENCES:
        assert re.search(license_scan.TRIGGER, phrase)


def test_rules_use_known_identifiers():
    known = {k for k, _ in license_scan.SENTENCES}
    assert all(i in known for _, ids in license_scan.RULES for i in ids)


def normalised(text):
    """The sentences of a text, word for word as the docstring says."""
    text = regex.sub(r"https?://\S+", " ", text)
    parts = regex.split(r"(?<=[.!?;])(?<!\b[vV]\.)\s+|\n\s*\n", text)
    clean = [regex.sub(r"\.+(?=\s|$)", "", regex.sub(r"[^\p{L}\p{N}.]+", " ", p.lower())).strip(" ") for p in parts]
    return [c for c in clean if c]


def brute(text):
    ids = []
    for s in normalised(text or ""):
        found = next((k for k, p in license_scan.SENTENCES if f" {p} " in f" {s} "), None)
        if found or re.search(r"\blicen[cs]ed?\b", s):
            ids.append(found or "UNKNOWN")
    rest, names = "".join(f"<{i}>" for i in ids), set()
    for name, wanted in license_scan.RULES:
        if (w := "".join(f"<{i}>" for i in wanted)) in rest:
            names.add(name)
            rest = rest.replace(w, "")
    return sorted(names), ids, rest.count("<")


MPL = """ * This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
GPL3 = """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
//
// This program is distributed in the hope that it will be useful,
// but WITHOUT ANY WARRANTY; without even the implied warranty of
// MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
// GNU General Public License for more details."""
LGPL21 = GPL3.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")


def test_standard_notices(spark):
    cases = {"MPL-2.0": MPL, "GPL-3.0-or-later": GPL3, "LGPL-2.1-or-later": LGPL21, "Proprietary": "Copyright (c) 1999 X. All rights\nreserved", "Public-Domain": "# This work is in the public\n# domain.", "CC-BY-SA-3.0": "Text is available under CC-BY-SA 3.0 here."}
    df = spark.createDataFrame(list(enumerate(cases.values())), "doc_id long, text string")
    got = {r.doc_id: list(r.licenses) for r in license_scan.scan(df).collect()}
    assert [got[i] for i in range(len(cases))] == [[name] for name in cases]


def test_a_wrapped_notice_of_every_rule_and_brute_force(spark):
    rng = random.Random(2)
    phrase = {}
    for key, text in license_scan.SENTENCES:
        phrase.setdefault(key, []).append(text)

    def notice(ids):
        text = " ".join((rng.choice(phrase[i]) + ".").capitalize() for i in ids).replace(" v 2.0", " v. 2.0").replace(" v 1.0", " v. 1.0")
        words, lines = text.split(" "), []
        while words:
            n = rng.randrange(4, 12)
            lines.append(" * " + " ".join(words[:n]))
            words = words[n:]
        return "\n".join(lines)

    rules = [notice(ids) for _, ids in license_scan.RULES]
    mixed = ["Some words of prose. " + "\n\n".join(rng.sample(rules, 3)) + "\n\nIt is licensed somehow; see https://a.b/license.html for that!" for _ in range(60)]
    docs = list(enumerate([*rules, *mixed, "license " * 50, "No such thing", "v. 2. License v. x", "\u0130 LICENSED", ""]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (list(r.licenses), list(r.sentence_ids), r.n_unmatched) for r in license_scan.scan(df).collect()}
    assert got == {i: brute(t) for i, t in docs}
    names = [name for name, _ in license_scan.RULES]
    assert [names[i] in got[i][0] for i in range(len(names))] == [True] * len(names)
