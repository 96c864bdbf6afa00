"""Exact dedup, decontamination, licences, line dedup and chat formatting on small tables."""

import hashlib
import re
import textwrap
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from shelfmark.llm import chat, decontaminate, exact_dedup, licenses, line_dedup

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def fold(text):
    return (text or "").translate(UPPER)


def test_exact_dedup(messy):
    rows = messy.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[fold(r.text)].append(r.doc_id)
    got = exact_dedup.report(messy).collect()
    want = Counter()
    for r in rows:
        ids = [i for i in groups[fold(r.text)] if i is not None]
        keep = max(ids) if ids else None
        want[(r.doc_id, keep, len(groups[fold(r.text)]), r.doc_id == keep, hashlib.sha256(fold(r.text).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want
    kept = exact_dedup.keep_last(messy)
    assert kept.columns == messy.columns
    # The empty text of row 4 stands for both NULL texts; the text without an id has one row.
    assert sorted((r.doc_id or 0, fold(r.text)) for r in kept.collect()) == sorted(
        (max((i for i in ids if i), default=0), text) for text, ids in groups.items())


def test_keep_last_with_null_repeated_and_shared_ids(spark):
    rows = [(1, "dup"), (1, "only once"), (5, "DUP"), (None, "unique"), (None, "dup"), (7, "x"), (7, "x"), (7, "X"),
            (None, "no id"), (None, "NO id"), (8, None), (None, "")]
    got = exact_dedup.keep_last(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, fold(r.text)) for r in got) == [
        (0, "no id"), (0, "unique"), (1, "only once"), (5, "dup"), (7, "x"), (8, "")]


def test_exact_dedup_without_valid_identifiers(spark, monkeypatch):
    """Texts whose chunks share a hash are compared as a whole."""
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: real(F.lit(1)))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.report(df).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_chunks_join_to_the_text(spark, messy, prose):
    rows = messy.select("text", F.array_join(exact_dedup.chunks(F.col("text"), 16, 64), "").alias("t")).filter("text is not null")
    assert all(r.text == r.t for r in rows.collect())
    # An insertion at the front leaves later chunks as they are.
    text = " ".join(prose(i, 3 + i * 7 % 11) + "." for i in range(300))
    df = spark.createDataFrame([(text,), ("something new. " + text,)], "text string")
    a, b = (set(r[0]) for r in df.select(exact_dedup.chunks(F.col("text"), 64, 256)).collect())
    assert len(a & b) > len(a) / 2


def scan_by_hand(rows, items):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))

    out = Counter()
    for r in rows:
        w, hit, names = words(r.text), set(), set()
        for item in items:
            v = words(item.text)
            n = min(10, len(v))
            windows = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    names.add(item.item_id)
        # An item without id is counted as hit but has no name to report.
        listed = sorted(str(x) for x in names if x is not None)
        digest = hashlib.sha256(",".join(listed).encode()).hexdigest()
        out[(r.doc_id, len(w), len(hit), len(listed), digest, bool(hit))] += 1
    return out


def test_decontaminate(messy, benchmark, monkeypatch):
    rows, items = messy.collect(), benchmark.collect()
    want = scan_by_hand(rows, items)
    assert Counter(tuple(r) for r in decontaminate.report(messy, benchmark).collect()) == want
    # More windows than fit one broadcast are taken in parts.
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 3)
    assert Counter(tuple(r) for r in decontaminate.report(messy, benchmark).collect()) == want
    clean = decontaminate.remove_documents(messy, benchmark)
    assert clean.columns == messy.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == ["10", "3", "4", "5", "8", "9", "None"]
    assert Counter(tuple(r) for r in decontaminate.report(messy, benchmark.limit(0)).collect()) == scan_by_hand(rows, [])
    assert decontaminate.report(messy.limit(0), benchmark).collect() == []


def test_decontaminate_spans(messy, benchmark, prose):
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(messy, benchmark).collect()}
    words = prose(7, 60).split()
    assert cut[6] == f"{prose(1, 40)} {' '.join(words[:5] + words[25:])} {prose(2, 40)}"
    assert cut[1] == "The on the mat and looked.\nMenu" and cut[3] is None and cut[8].startswith("word0 and")


def test_licenses(spark):
    texts = {
        1: "Intro.\nReleased under the MIT License. More",
        2: "All rights reserved.\nLicensed under CC BY-NC 4.0.",
        3: None, 4: "", 5: "nothing to see", 6: "ALL RIGHTS  RESERVED",
        7: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
           "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
           "later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
           "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        8: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
           "the Software.",
        9: "Released under the MIT License.\nReleased under the MIT License.",
    }
    df = spark.createDataFrame([(k, v, "z") for k, v in texts.items()], "doc_id long, text string, licence string")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.report(df).collect()}
    assert got[1] == ("MIT", 1, "") and got[2] == ("CC-BY-NC-4.0,All-Rights-Reserved", 2, "")
    assert got[3] == got[4] == got[5] == ("", 0, "") and got[6] == ("All-Rights-Reserved", 1, "")
    # A colon ends a sentence only before a blank; the notice is cut there, so the first half is not known.
    assert got[7][0] in ("GPL-3.0-or-later", "") and got[8] == ("", 1, "mit-keep")
    assert got[9][:2] == ("MIT", 2)
    rows, name = licenses.scan(df)
    assert name == "licence_1" and rows.columns == [*df.columns, name]
    assert licenses.report(df.limit(0)).collect() == []


MIT = (
    "MIT License\n\nCopyright (c) 2020 Someone\n\n",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
    "of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.",
    "You should have received a copy of the GNU General Public License along with this program.",
)
MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
)
APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
    "License. You may obtain a copy of the License at",
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS '
    'IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
)
BSD = (
    "Copyright (c) 2020, Someone",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE '
    "DISCLAIMED.",
)
WHOLE = {
    "MIT": (MIT, "MIT", 4), "GPL": (GPL, "GPL-3.0-or-later", 2), "MPL": (MPL, "MPL-2.0", 1), "Apache": (APACHE, "Apache-2.0", 5),
    "BSD-3": (BSD, "BSD-3-Clause", 4), "BSD-2": (BSD[:4] + BSD[5:], "BSD-2-Clause", 3),
    "named": (tuple(p.replace("the copyright holder nor", "Some Company, Inc. nor") for p in BSD), "BSD-3-Clause", 4),
    "braces": (tuple(re.sub(r"^(\d)\.", r" (\1)", p) for p in BSD), "BSD-3-Clause", 4),
    "stars": (tuple(re.sub(r"^(\d)\.", " *", p) for p in BSD), "BSD-3-Clause", 4),
}


def test_whole_licences(spark):
    """Whole licences: unwrapped, wrapped at several widths, in comments, with blank lines between and without."""
    rows, want = [], {}
    for name, (paragraphs, licence, n) in WHOLE.items():
        for width in (50, 70, 80, 5000):
            for between in ("\n\n", "\n", "\r\n \r\n"):
                for before in ("", " * ", "# "):
                    lines = [textwrap.wrap(p, width) for p in paragraphs]
                    text = between.join("\n".join(before + x for x in p) for p in lines)
                    want[len(rows)] = (name, width, between, before, licence, n, "")
                    rows.append((len(rows), "Some words first.\n" + text + "\nLast words.\n"))
    got = licenses.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r for r in got if (r.licences, r.n_sentences, r.unexplained) != want[r.doc_id][4:]] == []


def test_line_dedup(spark, messy):
    rows = [(i, f"Menu\nown line {i}\n\nMenu ", "h", "x") for i in range(20)]
    rows += [(100 + i, f"own {i}\nrare" if i < 2 else f"own {i}", "g", "x") for i in range(40)]
    rows += [(200, None, "h", None), (201, "", None, None), (202, "Menu", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, dropped string")
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(df).collect()}
    assert got[3] == "own line 3\n" and got[100] == "own 0\nrare" and got[200] is None and got[201] == "" and got[202] == "Menu"
    assert line_dedup.drop_lines(df).columns == df.columns
    report = {r.doc_id: (r.n_lines, r.n_kept) for r in line_dedup.report(df).collect()}
    assert report[3] == (4, 2) and report[200] == (0, 0) and report[201] == (1, 1)
    assert line_dedup.drop_lines(messy).count() == messy.count()
    assert line_dedup.report(messy.limit(0)).collect() == []


def test_chat(spark):
    turns = [
        (1, True, 0, "system", "S"), (1, True, 1, "user", "Q"), (1, True, 2, "assistant", "good"),
        (1, False, 0, "system", "S"), (1, False, 1, "user", "Q"), (1, False, 2, "assistant", "bad"), (1, False, 2, "assistant", "bad"),
        (2, True, 0, "user", "same"), (2, False, 0, "user", "same"),
        (3, True, 0, None, None), (3, False, None, "user", ""), (3, False, 1, "assistant", "more"),
        (4, True, 0, "user", "alone"), (None, True, 0, "user", "lost"),
    ]
    df = spark.createDataFrame(turns, "pair long, good boolean, turn long, role string, text string")
    sides = chat.conversations(df, F.col("pair"), F.col("good"))
    got = {r.pair_id: r for r in chat.format_pairs(sides).collect()}
    assert got[1].n_shared == 2 and got[1].prompt == "<|system|>\nS<|end|>\n<|user|>\nQ<|end|>\n"
    assert [tuple(s) for s in got[1].chosen] == [("<|assistant|>\n", 0), ("good<|end|>\n", 1)]
    assert [tuple(s) for s in got[1].rejected] == [("<|assistant|>\n", 0), ("bad<|end|>\n", 1)]
    assert got[2].chosen == got[2].rejected == [] and got[3].n_shared == 1 and got[3].chosen == [] and len(got[3].rejected) == 2
    assert sorted(got) == [1, 2, 3] and [r.pair_id for r in chat.unpaired(sides).collect()] == [4]
    assert chat.format_pairs(sides.limit(0)).collect() == []


def test_pairs_of_wide_and_negative_ids(spark):
    wide = 1 << 60
    rows = [(wide + c, 0, "user", f"q{c // 2}") for c in range(4)] + [(wide + c, 1, "assistant", f"a{c}") for c in range(4)]
    rows += [(-2, 0, "user", "n"), (-1, 0, "user", "n")]
    got = {r.pair_id: (r.prompt.count("q0"), r.prompt.count("q1"), "a0" in r.chosen, "a3" in r.rejected)
           for r in chat.report(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got == {wide // 2: (1, 0, True, False), wide // 2 + 1: (0, 1, False, True), -1: (0, 0, False, False)}


def test_line_ratio_decides_at_every_size_of_a_host(spark):
    rows = []
    for n, shared in ((2, 2), (9, 9), (50, 9), (50, 2), (200, 11), (200, 10)):
        rows += [(len(rows) + i, ("banner\n" if i < shared else "") + f"own {n} {shared} {i}", f"h{n}/{shared}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = {r[0]: r[1] for r in line_dedup.drop_lines(df).filter("text LIKE 'banner%'").groupBy("source").count().collect()}
    assert left == {"h50/2": 2, "h200/10": 10}  # 4 % and 5 % are not above the ratio
