"""Licence scans by sentence rules.

Texts are cut into sentences, sentences are normalised, known ones are mapped to identifiers, and the sequence of
identifiers of a text is matched against ordered rules: a rule holds where its identifiers follow each other in order, with
at most ``gap`` other sentences between two. All of it is native expressions over one row at a time: nothing is shuffled.

A text is read twice. The first reading ends sentences at line ends, too, and gives one-line notices. Licences are usually
wrapped, often in comments, so the second takes a line end, with the comment leader after it, as a space; sentences end at
punctuation or blank lines. A rule holds if it does in either reading. SPDX lines name their licences themselves. Sentences
are made and looked up only in texts that hold one of a few words, of which every known sentence has one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: normalised licence sentences (identifier, sentence); a trailing * stands for any rest
SENTENCES = (
    ("apache2-line", "licensed under the apache license version 2 0"),
    ("apache2-compliance", "you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at*"),
    ("apache2-asis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis*"),
    ("apache2-grant", "licensed under the apache license version 2 0 the license"),
    ("mit-line", "released under the mit license"),
    ("mit-line", "licensed under the mit license"),
    ("mit-line", "this project is licensed under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files*"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-asis", "the software is provided as is without warranty of any kind*"),
    ("gpl3-line", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-line", "licensed under the gnu general public license version 3"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license*"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty*"),
    ("gpl-copy", "you should have received a copy of the gnu general public license along with this program*"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted*"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice*"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice*"),
    ("bsd-endorse", "neither the name of*"),
    ("bsd-asis", "this software is provided by the copyright holders and contributors as is*"),
    ("ccbync4-line", "licensed under cc by nc 4 0"),
    ("ccby4-line", "licensed under cc by 4 0"),
    ("ccbysa4-line", "licensed under cc by sa 4 0"),
    ("cc0-line", "licensed under cc0 1 0"),
    ("mpl2-line", "this source code form is subject to the terms of the mozilla public license v 2 0*"),
    ("mpl2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at*"),
    ("mpl2-title", "mozilla public license version 2 0*"),
    ("mpl2-contributor", "contributor means each individual or legal entity that creates contributes to the creation of or owns covered software"),
    ("apache2-title", "apache license version 2 0*"),
    ("apache2-terms", "terms and conditions for use reproduction and distribution*"),
    ("gpl-title", "gnu general public license version 2*"),
    ("gpl2-copies", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl2-copies", "franklin street fifth floor boston ma 02110 1301 usa everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl2-copies", "temple place suite 330 boston ma 02111 1307 usa everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl2-copies", "copyright c 1989 1991 free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa everyone is permitted*"),
    ("gpl2-copies", "https fsf org everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl2-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2*"),
    ("gpl2-free", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2*"),
    ("gpl3-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3*"),
    ("gpl3-free", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3*"),
    ("gpl3-title", "gnu general public license version 3*"),
    ("lgpl2-title", "gnu lesser general public license version 2 1*"),
    ("lgpl3-title", "gnu lesser general public license version 3*"),
    ("lgpl-free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license*"),
    ("lgpl-hope", "this library is distributed in the hope that it will be useful but without any warranty*"),
    ("lgpl-copy", "you should have received a copy of the gnu lesser general public license along with this library*"),
    ("agpl3-title", "gnu affero general public license version 3*"),
    ("agpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license*"),
    ("agpl-copy", "you should have received a copy of the gnu affero general public license along with this program*"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-asis", "the software is provided as is and the author disclaims all warranties*"),
    ("unlicense-domain", "this is free and unencumbered software released into the public domain"),
    ("unlicense-anyone", "anyone is free to copy modify publish use compile sell or distribute this software*"),
    ("epl2-line", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0*"),
    ("epl2-line", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0*"),
    ("zlib-asis", "this software is provided as is without any express or implied warranty"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely*"),
    ("bsl-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license*"),
    ("wtfpl-title", "do what the fuck you want to public license*"),
    ("spdx-line", "spdx license identifier*"),
)
# fixed values: ordered rules (licence, identifiers)
RULES = (
    ("Apache-2.0", ("apache2-line",)),
    ("Apache-2.0", ("apache2-grant",)),
    ("Apache-2.0", ("apache2-compliance", "apache2-copy", "apache2-asis")),
    ("MIT", ("mit-line",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("GPL-3.0", ("gpl3-line",)),
    ("GPL", ("gpl-free", "gpl-hope", "gpl-copy")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis")),
    ("CC-BY-NC-4.0", ("ccbync4-line",)),
    ("CC-BY-4.0", ("ccby4-line",)),
    ("CC-BY-SA-4.0", ("ccbysa4-line",)),
    ("CC0-1.0", ("cc0-line",)),
    ("MPL-2.0", ("mpl2-line",)),
    ("MPL-2.0", ("mpl2-title", "mpl2-contributor")),
    ("Apache-2.0", ("apache2-title", "apache2-terms")),
    ("GPL-2.0", ("gpl-title", "gpl2-copies")),
    ("GPL-3.0", ("gpl3-title", "gpl2-copies")),
    ("LGPL-2.1", ("lgpl2-title", "gpl2-copies")),
    ("LGPL-3.0", ("lgpl3-title", "gpl2-copies")),
    ("AGPL-3.0", ("agpl3-title", "gpl2-copies")),
    ("GPL-2.0", ("gpl2-free", "gpl-hope")),
    ("GPL-3.0", ("gpl3-free", "gpl-hope")),
    ("LGPL", ("lgpl-free", "lgpl-hope", "lgpl-copy")),
    ("AGPL-3.0", ("agpl-free", "gpl-hope", "agpl-copy")),
    ("ISC", ("isc-grant", "isc-asis")),
    ("Unlicense", ("unlicense-domain", "unlicense-anyone")),
    ("EPL-2.0", ("epl2-line",)),
    ("Zlib", ("zlib-asis", "zlib-grant")),
    ("BSL-1.0", ("bsl-grant",)),
    ("WTFPL", ("wtfpl-title",)),
)
SENTENCE_END = r"\n|[.;:!?](?=[ \t\r\n]|\z)"
NOT_WORD = r"[^a-z0-9]+"
LEADERS = r"(?m)^[ \t]*+(?:(?:/\*++|\*++/?|//++|#++|;++|--++>?|%++|>++|<!--|\(\*|REM\b|dnl\b)[ \t]*+)++"
WRAPPED_END = r"\n[ \t\r]*+\n\s*+|[.;:!?](?=[ \t\r\n]|\z)"
# lines that end where they end, whatever follows: holders and SPDX lines
LONE_LINE = r"(?mi)^([ \t]*+(?:copyright[ \t]++(?:\(c\)|\u00a9|[0-9]{4})|\(c\)|\u00a9|SPDX-)[^\n]*+)$"
LIST_MARK = r"^(?:[0-9]{1,2}|[a-z])(?: |\z)"
SPDX_NAME = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
_SPDX_TERM = rf"\(*{SPDX_NAME}(?:[ \t]+WITH[ \t]+{SPDX_NAME})?\)*"
SPDX = rf"SPDX-License-Identifier:[ \t]*({_SPDX_TERM}(?:[ \t]+(?:AND|OR)[ \t]+{_SPDX_TERM})*)"
# fixed values: SPDX names of what RULES call otherwise; all other names stand for themselves
SPDX_NAMES = {f"{n}{end}": n for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for end in ("-ONLY", "-OR-LATER", "+")}


def normalised(sentence: Column) -> Column:
    """Lower case, runs of anything but ASCII letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(sentence), NOT_WORD, " "))


def anchors(sentences) -> list[str]:
    """Words, as few as a greedy choice gives, of which every known sentence holds one: a text without any of them holds no known sentence."""
    left, chosen = {s for _, s in sentences}, []
    whole = lambda s: s.split(" ") if not s.endswith("*") else s.split(" ")[:-1] or [s[:-1]]  # noqa: E731  what follows a start may go on in its last word
    while left:
        words = sorted({w for s in left for w in whole(s)}, key=lambda w: (len(w) < 7, -sum(w in s for s in left), w))
        chosen.append(words[0])
        left = {s for s in left if words[0] not in s}
    return chosen


def longest_first(sentences) -> list[tuple[str, str]]:
    return sorted(sentences, key=lambda x: -len(x[1]))


def _identifier(sentence: Column, sentences) -> Column:
    """The identifier of a known sentence: an equal one's, or else that of the longest start of it."""
    exact = {s: i for i, s in sentences if not s.endswith("*")}
    known = F.create_map(*[F.lit(x) for pair in exact.items() for x in pair])
    starts = [F.when(sentence.startswith(s[:-1]), F.lit(i)) for i, s in longest_first(sentences) if s.endswith("*")]
    return F.coalesce(F.try_element_at(known, sentence), *starts)


def _holds(spots: Column, rule: tuple[str, ...], gap: int) -> Column:
    """Whether the rule's identifiers follow each other within ``spots``, an ordered array of (pos, id)."""
    # state: positions up to which each length of the rule has been matched last
    start = F.array(*[F.lit(None).cast("int") for _ in rule])

    def step(state, spot):
        cells = []
        for k, name in enumerate(rule):
            before = F.lit(True) if k == 0 else state[k - 1].isNotNull() & (spot["pos"] - state[k - 1] <= gap + 1) & (spot["pos"] > state[k - 1])
            cells.append(F.when((spot["id"] == name) & before, spot["pos"]).otherwise(state[k]))
        # a complete match stays
        cells[-1] = F.coalesce(state[len(rule) - 1], cells[-1])
        return F.array(*cells)

    if len(rule) == 1:
        return F.exists(spots, lambda s: s["id"] == rule[0])
    return F.aggregate(spots, start, step, lambda s: s[len(rule) - 1].isNotNull())


def _wrapped(text: Column) -> Column:
    """Normalised sentences of the second reading, without list marks."""
    plain = F.regexp_replace(F.regexp_replace(text, LEADERS, ""), LONE_LINE, "\n$1\n\n")
    cut = F.transform(F.split(plain, WRAPPED_END), lambda s: F.regexp_replace(normalised(s), LIST_MARK, ""))
    return F.filter(cut, lambda s: s != "")


def _spdx(text: Column, rules) -> Column:
    """The licences that SPDX lines name, without operators and the exceptions after WITH."""
    values = F.regexp_extract_all(text, F.lit(SPDX), F.lit(1))
    names = F.flatten(F.transform(values, lambda v: F.regexp_extract_all(F.regexp_replace(v, r"[ \t]WITH[ \t]+[^ \t)]+", ""), F.lit(SPDX_NAME), F.lit(0))))
    names = F.filter(names, lambda n: ~n.isin("AND", "OR", "NONE", "NOASSERTION"))
    known = F.create_map(*[F.lit(x) for pair in ({n.upper(): n for n, _ in rules} | SPDX_NAMES).items() for x in pair])
    return F.transform(names, lambda n: F.coalesce(F.try_element_at(known, F.upper(n)), n))


def scan_licences(
    docs: DataFrame, sentences=SENTENCES, rules=RULES, gap: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_known, sentence_ids (in order), licences (sorted, each once).

    Sentences end at a line end or at one of . ; : ! ? before white space, and count if they hold a letter or digit. Null and
    empty texts have none; repeated rows each get a row; texts of any length are scanned whole; an empty table gives an
    empty result; further columns are ignored. Where two rules hold for overlapping sentences, both are named. Counts and
    sentence_ids are those of the first reading; licences are those of both readings and of SPDX lines.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    told = reduce(Column.__or__, [F.col("low").contains(word) for word in anchors(sentences)])
    none = F.array().cast("array<string>")
    cut = F.filter(F.transform(F.split("text", SENTENCE_END), lambda s: normalised(s)), lambda s: s != "")
    pieces = rows.withColumn("told", told).select(
        "doc_id",
        F.size(F.filter(F.split("low", SENTENCE_END), lambda s: s.rlike("[a-z0-9]"))).cast("long").alias("n_sentences"),
        F.when(F.col("told"), cut).otherwise(none).alias("sentences"),
        F.when(F.col("told"), _wrapped(F.col("text"))).otherwise(none).alias("wrapped"),
        F.when(F.col("text").contains("SPDX-License-Identifier"), _spdx(F.col("text"), rules)).otherwise(none).alias("spdx"),
    )
    spots_of = lambda ids: F.filter(
        F.transform(ids, lambda x, i: F.struct(i.cast("int").alias("pos"), x.alias("id"))), lambda x: x["id"].isNotNull()
    )
    # a known sentence may hold a colon or semicolon: what does not stand alone is tried with the next
    joined = F.transform("wrapped", lambda s, i: F.coalesce(_identifier(s, sentences), _identifier(F.concat_ws(" ", s, F.get("wrapped", i + 1)), sentences)))
    spotted = pieces.select(
        "doc_id",
        "n_sentences",
        spots_of(F.transform("sentences", lambda s: _identifier(s, sentences))).alias("spots"),
        spots_of(joined).alias("wrapped"),
        "spdx",
    )
    found = [F.when(_holds(F.col("spots"), rule, gap) | _holds(F.col("wrapped"), rule, gap), F.lit(name)) for name, rule in rules]
    return spotted.select(
        "doc_id",
        "n_sentences",
        F.size("spots").cast("long").alias("n_known"),
        F.transform("spots", lambda s: s["id"]).alias("sentence_ids"),
        F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*found)), "spdx"))).alias("licences"),
    )
