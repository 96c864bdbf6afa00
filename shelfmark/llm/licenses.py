"""Licence recognition by sentences and ordered rules.

A text is cut into pieces at line ends and sentence marks; each is normalised
(lower case, everything but ``a-z0-9`` is one blank). Known licence sentences
are looked up in whole pieces, of which a sentence may take several: neither
wrapped lines nor marks inside a sentence part it. The text becomes a sequence of
identifiers, with ``-`` where other pieces stand between; empty pieces and the
numbers of lists are not counted. Rules are tried in order, the more demanding
ones first: a rule holds if its identifiers occur next to each other, and takes
them out of the sequence. Identifiers that no rule takes are reported.

Edge cases. NULL, empty and licence-free texts have no sentence and no licence.
A ``*`` in a known sentence stands for one to twelve words (a holder's name).
A licence given twice is named once. Rows that repeat, rows without id and an
empty table are treated like any others. Other columns, whatever their names,
are kept by ``scan``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.base import let
from shelfmark.llm.common import fresh

# Sentences of public licences and licence notices, normalised.
SENTENCES = {
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files the software to deal in the software without restriction including "
                 "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                 "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                 "the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial "
                "portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited "
             "to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "no-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other "
                    "liability whether in an action of contract tort or otherwise arising from out of or in connection "
                    "with the software or the use or other dealings in the software",
    "apache-licensed": "licensed under the apache license version 2 0",
    "apache-the": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is "
                    "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl2-work": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                "public license as published by the free software foundation either version 3 of the license or at your "
                "option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the "
                "implied warranty of merchantability or fitness for a particular purpose",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted "
                          "provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the "
                  "following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
                  "following disclaimer in the documentation and or other materials provided with the distribution",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "reserved": "all rights reserved",
}

# Parts of whole licences that come between those above.
CLAUSES = {
    "apache-url": "http www apache org licenses license 2 0",
    "apache-urls": "https www apache org licenses license 2 0",
    "bsd-endorse": "neither the name of * nor the names of its contributors may be used to endorse or promote products "
                   "derived from this software without specific prior written permission",
}

# Licence and the identifiers that prove it, in the order in which they are tried.
RULES = (
    ("MIT", "mit-grant mit-keep as-is no-liability"),
    ("MIT", "mit-grant mit-keep as-is"),
    ("MIT", "mit-released"),
    ("MIT", "mit-licensed"),
    ("Apache-2.0", "apache-the apache-comply apache-obtain apache-as-is"),
    ("Apache-2.0", "apache-the apache-comply"),
    ("Apache-2.0", "apache-the"),
    ("Apache-2.0", "apache-licensed"),
    ("GPL-3.0-or-later", "gpl-free gpl-hope"),
    ("GPL-3.0-or-later", "gpl-free"),
    ("GPL-3.0", "gpl3-work"),
    ("GPL-2.0", "gpl2-work"),
    ("BSD-2-Clause", "bsd-redistribution bsd-source bsd-binary"),
    ("CC-BY-NC-4.0", "cc-by-nc"),
    ("CC-BY-SA-4.0", "cc-by-sa"),
    ("CC-BY-4.0", "cc-by"),
    ("MPL-2.0", "mpl"),
    ("All-Rights-Reserved", "reserved"),
)


# Rules of whole licences, tried before the others.
WHOLE_RULES = (
    ("Apache-2.0", "apache-the apache-comply apache-obtain apache-url apache-as-is"),
    ("Apache-2.0", "apache-the apache-comply apache-obtain apache-urls apache-as-is"),
    ("BSD-3-Clause", "bsd-redistribution bsd-source bsd-binary bsd-endorse"),
)

# Number or letter of a list at the start of a line, and a piece that is nothing else.
_MARKER, _NUMBER = r"(?m)^([^a-z0-9\n]*(?:[0-9]{1,2}|[a-z]))\)", "^(?:[0-9]{1,2}|[a-z])$"


def _cut(text: Column) -> Column:
    """``| piece | piece |``: the normalised pieces of a text that are not empty."""
    marked = F.regexp_replace(F.translate(F.lower(text), "|@", "  "), _MARKER, "$1\n")
    marked = F.regexp_replace(F.regexp_replace(marked, r"\n|[.!?:;]\s", "|"), "[^a-z0-9|]+", " ")
    return F.concat(F.lit("| "), F.btrim(F.regexp_replace(marked, r"[ |]*\|[ |]*", " | "), F.lit(" |")), F.lit(" |"))


def _pattern(sentence: str) -> str:
    """Whole pieces that make up a sentence, cut anywhere between its words."""
    words = [r"[a-z0-9]+(?:(?: \|)? [a-z0-9]+){0,11}?" if w == "*" else w for w in sentence.split()]
    return r"\| " + r"(?: \|)? ".join(words) + r"(?= \|)"


def sentence_ids(text: Column, sentences: dict[str, str]) -> Column:
    """Identifiers of a text's sentences in order, ``-`` for each other piece; NULL if no sentence is known."""
    plain = {name: " ".join(re.sub("[^a-z0-9*]+", " ", s.lower()).split()) for name, s in sentences.items()}
    # The longer ones first, so that none takes a piece of another.
    known = F.array(*[F.struct(
        F.lit(f" {max(s.split('*'), key=len).strip()} ").alias("part"), F.lit(_pattern(s)).alias("pattern"),
        F.lit(f"| @{name}").alias("id")) for name, s in sorted(plain.items(), key=lambda x: -len(x[1]))])
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))
    # Most texts do not have the words of any sentence; only the others are cut.
    found = let(words, lambda w: F.filter(known, lambda k: F.contains(w, k["part"])))

    def named(cut: Column, wanted: Column) -> Column:
        return F.aggregate(wanted, cut, lambda state, k: F.regexp_replace(state, k["pattern"], k["id"]))

    def listed(pieces: Column) -> Column:
        kept = F.filter(F.split(pieces, r" ?\| ?"), lambda x: (x != "") & ~x.rlike(_NUMBER))
        return F.transform(kept, lambda x: F.when(F.startswith(x, F.lit("@")), F.substr(x, F.lit(2))).otherwise("-"))

    return let(found, lambda f: F.when(F.size(f) > 0, let(named(_cut(text), f), listed)))


def _doubled(ids: Column) -> Column:
    """`` a  b ``: every identifier with blanks of its own, so that a rule's text matches whole ones."""
    return F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))


def apply_rules(ids: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Struct of ``licences`` (in rule order) and ``rest`` (identifiers no rule took)."""
    steps = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(rule.split()) + " ").alias("ids")) for name, rule in rules])
    start = F.struct(F.array().cast("array<string>").alias("licences"), _doubled(ids).alias("rest"))
    done = F.aggregate(steps, start, lambda state, r: F.when(
        F.contains(state["rest"], r["ids"]),
        F.struct(F.array_union(state["licences"], F.array(r["name"])).alias("licences"),
                 F.replace(state["rest"], r["ids"], F.lit(" - ")).alias("rest")),
    ).otherwise(state))
    return let(done, lambda d: F.struct(
        d["licences"].alias("licences"),
        F.filter(F.split(d["rest"], " +"), lambda x: (x != "") & (x != "-")).alias("rest")))


def scan(docs: DataFrame, sentences: dict[str, str] | None = None,
         rules: tuple[tuple[str, str], ...] = WHOLE_RULES + RULES) -> tuple[DataFrame, str]:
    """(documents with a struct of ``ids, licences, rest``, the struct's name).

    ``ids`` are the known sentences in order, with one ``-`` for any others
    between them.
    """
    name, raw = fresh(docs, "licence"), fresh(docs, "_ids")
    rows = docs.withColumn(raw, sentence_ids(F.col("text"), sentences or SENTENCES | CLAUSES))
    runs = F.filter(F.col(raw), lambda x, i: (x != "-") | (i == 0) | (F.get(F.col(raw), i - 1) != "-"))
    # Most texts have no licence sentence at all; only the others are worked on.
    hit = F.exists(F.col(raw), lambda x: x != "-")
    found = F.when(hit, let(runs, lambda r: let(apply_rules(r, rules), lambda d: F.struct(
        F.filter(r, lambda x: x != "-").alias("ids"), d["licences"].alias("licences"), d["rest"].alias("rest")))))
    return rows.withColumn(name, found).drop(raw), name


def report(docs: DataFrame) -> DataFrame:
    """Licences of every document, how many licence sentences it has, and those no rule explains."""
    rows, name = scan(docs)
    found = F.col(name)
    return rows.select(
        "doc_id", F.coalesce(F.array_join(found["licences"], ","), F.lit("")).alias("licences"),
        F.when(found.isNull(), 0).otherwise(F.size(found["ids"])).cast("long").alias("n_sentences"),
        F.coalesce(F.array_join(found["rest"], ","), F.lit("")).alias("unexplained"))
