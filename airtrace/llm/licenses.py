"""Licence scan by sentence rules.

A text is reduced to its lower-case words with the breaks between them: sentence
ends and line ends. A known sentence starts and ends at a break and becomes its
identifier; line ends (and signs, as of comments) may also lie inside it, so
hard-wrapped notices are found like those on one line. The full stop of ``v. 2``
is no break, the colon after the conditions' heading is one. Licence rules are
ordered sequences of identifiers; a rule fits where its identifiers follow each
other among the known sentences, and a fit inside a longer fitting rule is left
out. Everything is one projection: no shuffle, no join, no Python.

Defined results: null or empty texts have no sentences and no licence; repeated
rows each get a result; a repeated sentence counts at every place; rules of equal
text cannot exist (names are unique by sequence); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence notices and texts, normalised, with their identifiers; wordings of one sentence share one.
SENTENCES = {
    "licensed under the apache license version 2 0": 1,
    "you may not use this file except in compliance with the license": 2,
    "you may obtain a copy of the license at http www apache org licenses license 2 0": 3,
    "released under the mit license": 4,
    "permission is hereby granted free of charge to any person obtaining a copy of this software": 5,
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": 6,
    "the software is provided as is without warranty of any kind express or implied": 7,
    "this work is licensed under the gnu general public license version 3": 8,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": 9,
    "this program is distributed in the hope that it will be useful but without any warranty": 10,
    "see the gnu general public license for more details": 11,
    "see the gnu lesser general public license for more details": 12,
    "licensed under cc by nc 4 0": 13,
    "licensed under cc by 4 0": 14,
    "licensed under cc by sa 4 0": 15,
    "this work is licensed under a creative commons attribution 4 0 international license": 16,
    "all rights reserved": 17,
    "redistribution and use in source and binary forms with or without modification are permitted": 18,
    "redistributions of source code must retain the above copyright notice": 19,
    "redistributions in binary form must reproduce the above copyright notice": 20,
    "this source code form is subject to the terms of the mozilla public license v 2 0": 21,
    "this is free and unencumbered software released into the public domain": 22,
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": 23,
    "licensed under the mit license": 24,
    "no part of this publication may be reproduced without permission": 25,
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": 5,
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": 7,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": 30,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": 31,
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": 10,
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": 10,
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": 18,
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": 19,
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": 20,
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": 23,
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": 23,
    "you may obtain a copy of the license at https www apache org licenses license 2 0": 3,
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": 26,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": 27,
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": 32,
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": 28,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": 33,
    "see the gnu affero general public license for more details": 34,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": 35,
    "this program is free software you can redistribute it and or modify it under the terms of version 2 of the gnu general public license as published by the free software foundation": 35,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license": 35,
    "distributed under the boost software license version 1 0": 36,
    "boost software license version 1 0 august 17th 2003": 37,
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": 38,
    "this software is provided as is without any express or implied warranty": 39,
    "in no event will the authors be held liable for any damages arising from the use of this software": 40,
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": 41,
    "apache license version 2 0 january 2004": 42,
    "terms and conditions for use reproduction and distribution": 43,
    "gnu general public license version 3 29 june 2007": 44,
    "gnu general public license version 2 june 1991": 45,
    "gnu lesser general public license version 3 29 june 2007": 46,
    "gnu lesser general public license version 2 1 february 1999": 47,
    "gnu affero general public license version 3 19 november 2007": 48,
    "mozilla public license version 2 0": 49,
    "eclipse public license v 2 0": 50,
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": 51,
    "cc0 1 0 universal": 52,
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": 27,
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": 29,
}
#: Rule name, licence, kind, identifiers in order.
RULES = [
    ("apache-notice", "Apache-2.0", "permissive", [1]),
    ("apache-header", "Apache-2.0", "permissive", [1, 2, 3]),
    ("apache-short-header", "Apache-2.0", "permissive", [1, 2]),
    ("mit-notice", "MIT", "permissive", [4]),
    ("mit-reference", "MIT", "permissive", [24]),
    ("mit-text", "MIT", "permissive", [5, 6, 7]),
    ("mit-grant", "MIT", "permissive", [5, 6]),
    ("gpl3-notice", "GPL-3.0", "copyleft", [8]),
    ("gpl-header", "GPL", "copyleft", [9, 10, 11]),
    ("gpl-short-header", "GPL", "copyleft", [9]),
    ("lgpl-header", "LGPL", "copyleft", [9, 10, 12]),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", "noncommercial", [13]),
    ("cc-by-notice", "CC-BY-4.0", "permissive", [14]),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", "copyleft", [15]),
    ("cc-by-long-notice", "CC-BY-4.0", "permissive", [16]),
    ("reserved", "proprietary", "reserved", [17]),
    ("reserved-publication", "proprietary", "reserved", [17, 25]),
    ("bsd2-text", "BSD-2-Clause", "permissive", [18, 19, 20]),
    ("mpl-header", "MPL-2.0", "copyleft", [21]),
    ("unlicense-text", "Unlicense", "permissive", [22]),
    ("isc-grant", "ISC", "permissive", [23]),
    ("isc-text", "ISC", "permissive", [23, 7]),
    ("apache-header", "Apache-2.0", "permissive", [26, 3]),
    ("apache-short-header", "Apache-2.0", "permissive", [26]),
    ("lgpl-header", "LGPL", "copyleft", [27, 10, 12]),
    ("lgpl-short-header", "LGPL", "copyleft", [27]),
    ("isc-text", "ISC", "permissive", [23, 28]),
    ("bsd3-text", "BSD-3-Clause", "permissive", [18, 19, 20, 29]),
    ("gpl-header", "GPL", "copyleft", [30, 10, 11]),
    ("gpl-short-header", "GPL", "copyleft", [30]),
    ("gpl-header", "GPL", "copyleft", [31, 10, 11]),
    ("gpl-short-header", "GPL", "copyleft", [31]),
    ("lgpl-header", "LGPL", "copyleft", [30, 10, 12]),
    ("lgpl-header", "LGPL", "copyleft", [31, 10, 12]),
    ("lgpl-header", "LGPL", "copyleft", [32, 10, 12]),
    ("lgpl-short-header", "LGPL", "copyleft", [32]),
    ("agpl-header", "AGPL", "copyleft", [33, 10, 34]),
    ("agpl-short-header", "AGPL", "copyleft", [33]),
    ("gpl2-only-header", "GPL", "copyleft", [35, 10, 11]),
    ("gpl2-only-short-header", "GPL", "copyleft", [35]),
    ("boost-notice", "BSL-1.0", "permissive", [36]),
    ("boost-title", "BSL-1.0", "permissive", [37]),
    ("boost-grant", "BSL-1.0", "permissive", [38]),
    ("boost-text", "BSL-1.0", "permissive", [37, 38]),
    ("zlib-grant", "Zlib", "permissive", [41]),
    ("zlib-text", "Zlib", "permissive", [39, 40, 41]),
    ("apache-title", "Apache-2.0", "permissive", [42]),
    ("apache-text", "Apache-2.0", "permissive", [42, 43]),
    ("gpl3-title", "GPL-3.0", "copyleft", [44]),
    ("gpl2-title", "GPL-2.0", "copyleft", [45]),
    ("lgpl3-title", "LGPL-3.0", "copyleft", [46]),
    ("lgpl21-title", "LGPL-2.1", "copyleft", [47]),
    ("agpl3-title", "AGPL-3.0", "copyleft", [48]),
    ("mpl-title", "MPL-2.0", "copyleft", [49]),
    ("epl-title", "EPL-2.0", "copyleft", [50]),
    ("epl-header", "EPL-2.0", "copyleft", [51]),
    ("cc0-title", "CC0-1.0", "permissive", [52]),
]
#: Identifiers of the public list of licences that a tag line may name.
TAGS = {
    "permissive": "0BSD AFL-3.0 Apache-1.1 Apache-2.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC0-1.0 CC-BY-3.0 CC-BY-4.0 "
    "ECL-2.0 FTL HPND ISC MIT MIT-0 MS-PL NCSA OFL-1.1 OpenSSL PHP-3.01 PostgreSQL PSF-2.0 Ruby Unicode-DFS-2016 Unlicense UPL-1.0 W3C WTFPL X11 Zlib",
    "copyleft": "AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CECILL-2.1 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later "
    "GPL-2.0-only GPL-2.0-or-later GPL-2.0 GPL-3.0-only GPL-3.0-or-later GPL-3.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-2.1 "
    "LGPL-3.0-only LGPL-3.0-or-later LGPL-3.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-RL ODbL-1.0 OSL-3.0",
    "noncommercial": "CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 PolyForm-Noncommercial-1.0.0",
    "noderivatives": "CC-BY-ND-3.0 CC-BY-ND-4.0",
}
#: Words of the terms of the Creative Commons licences.
TERMS = {"by": "attribution", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
#: What the first sentence of a rule says about version and later versions, where the licence's name does not.
EXPRESSIONS = {
    27: "LGPL-3.0-or-later", 30: "GPL-3.0-or-later", 31: "GPL-2.0-or-later", 32: "LGPL-2.1-or-later", 33: "AGPL-3.0-or-later", 35: "GPL-2.0-only",
}


def _tagged() -> None:
    """Add a sentence and a rule for every tag line, and for every notice that names a Creative Commons licence by its terms."""
    for kind, names in TAGS.items():
        for name in names.split():
            at = max(SENTENCES.values()) + 1
            SENTENCES["spdx license identifier " + re.sub(r"[^a-z0-9]+", " ", name.lower())] = at
            RULES.append(("tag-" + name.lower(), name, kind, [at]))
    for kind, name in [(k, n) for k, names in TAGS.items() for n in names.split() if re.fullmatch("CC-BY(-[A-Z]+)*-4.0", n)]:
        terms = name.lower().split("-")[1:-1]
        short, long = " ".join(terms), " ".join(TERMS[t] for t in terms)
        known = SENTENCES.get(f"licensed under cc {short} 4 0")
        at = known or max(SENTENCES.values()) + 1
        if not known:
            RULES.append((f"cc-{'-'.join(terms)}-notice", name, kind, [at]))
        for sentence in (f"licensed under cc {short} 4 0", f"this work is licensed under cc {short} 4 0", f"this work is licensed under a creative commons {long} 4 0 international license"):
            SENTENCES.setdefault(sentence, at)


_tagged()
#: In order: the plus sign of a tag line is spelled out, abbreviations before a number lose their full stop, the heading of a list of conditions and the address of a
#: licence end a sentence, a grant starts one (all for texts on one line), sentence ends become "|", and other signs
#: become blanks. Line ends stay.
REDUCE = [
    (r"\|", " "), (r"(spdx-license-identifier:[^\n]*\p{N})\+", "$1-or-later"), (r"\b(v|ver|vers|no)\.(?=[\x20\x09-\x0D]+\p{N})", "$1"), (r"(following conditions|following restrictions|conditions are met)[\x20\x09-\x0D]*:", "$1|"),
    (r"(/licenses/license-2\.0)(?=[\x20\x09-\x0D])", "$1|"), (r"[\x20\x09-\x0D](permission is hereby granted, free|permission to use, copy|redistribution and use in source)", "|$1"),
    (r"[.!?]+(?:[\x20\x09-\x0D]+|\z)", "|"), (r"[^\p{L}\p{N}|\n ]+", " "),
]


def expression(licence: str, ids: list[int]) -> str:
    """The licence with its version and whether later versions count, as far as the rule's first sentence tells."""
    return EXPRESSIONS.get(ids[0], licence)


def _sequence(ids) -> str:
    return "," + "".join(f"{i}," for i in ids)


def reduced(text: Column) -> Column:
    """Lower-case words of letters and digits with blanks or breaks ("|" and line ends) between them."""
    out = F.lower(text)
    for pattern, by in REDUCE:
        out = F.regexp_replace(out, pattern, by)
    return out


def telling_words(sentences: dict[str, int]) -> list[str]:
    """A few words of which every sentence has one; a text without them has no known sentence."""
    left, words = sorted(sentences), []
    while left:
        count = Counter(w for s in left for w in set(s.split(" ")))
        words.append(min(count, key=lambda w: (-count[w] * (len(w) > 4), w)))
        left = [s for s in left if words[-1] not in s.split(" ")]
    return words


def wordings(sentences: dict[str, int]) -> str:
    """One pattern for all sentences as a tree of their words, so a place in a text is compared with shared beginnings once."""
    tree: dict = {}
    for s in sentences:
        node = tree
        for word in s.split(" "):
            node = node.setdefault(word, {})
        node[""] = {}

    def below(node: dict) -> str:
        """What follows a word: nothing, or a gap and the rest; the longest wording first."""
        rest = [word + below(child) for word, child in sorted(node.items()) if word]
        if not rest:
            return ""
        one = r"[ \n]+" + (rest[0] if len(rest) == 1 else f"(?:{'|'.join(rest)})")
        return f"(?:{one})?" if "" in node else one

    return "(?:" + "|".join(word + below(child) for word, child in sorted(tree.items())) + ")"


def recognised(text: Column, sentences: dict[str, int]) -> Column:
    """Array of (position, id) of the known sentences of a text, in order; the position counts the sentences and lines before."""
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    shortest = min(map(len, sentences))
    # The longest wording first, so that a sentence wins over its own beginning; else one line or sentence as it is.
    pattern = rf"(?<![^|\n])(?: *+{wordings(sentences)} *+(?![^|\n])|[^|\n]*+)(?:[|\n]|\z)"
    hopeful = F.when(reduce(or_, [F.contains(F.lower(text), F.lit(w)) for w in telling_words(sentences)]), text)
    cut = F.regexp_extract_all(reduced(F.coalesce(hopeful, F.lit(""))), F.lit(pattern), F.lit(0))

    def look_up(sentence, i):
        plain = F.trim(F.regexp_replace(sentence, r"[ |\n]+", " "))
        # Membership is a hash set of literals; the map is searched for known sentences alone.
        return F.struct(i.alias("position"), F.when((F.char_length(sentence) >= shortest) & plain.isin(*sentences), F.try_element_at(known, plain)).alias("id"))

    return F.filter(F.transform(cut, look_up), lambda x: x["id"].isNotNull())


def scan(docs: DataFrame, sentences: dict[str, int] = SENTENCES, rules: list = RULES) -> DataFrame:
    """Per row: ``doc_id``, ``sentences`` (position, id), ``rules``, ``licences`` and ``kinds`` that fit, and ``expressions`` with versions."""
    found = docs.select("doc_id", recognised(F.col("text").cast("string"), sentences).alias("sentences"))
    ids = F.array_join(F.transform("sentences", lambda x: x["id"].cast("string")), ",")
    chained = found.withColumn("_ids", F.when(F.size("sentences") > 0, F.concat(F.lit(","), ids, F.lit(","))).otherwise(","))
    table = [F.struct(F.lit(n).alias("rule"), F.lit(lic).alias("licence"), F.lit(kind).alias("kind"), F.lit(_sequence(seq)).alias("ids"), F.lit(expression(lic, seq)).alias("expression")) for n, lic, kind, seq in rules]
    fits = F.when(F.col("_ids") != ",", F.filter(F.array(*table), lambda r: F.contains(F.col("_ids"), r["ids"])))
    marked = chained.withColumn("_fits", F.coalesce(fits, F.slice(F.array(*table), 1, 0)))

    def widest(r):
        return ~F.exists("_fits", lambda o: (F.char_length(o["ids"]) > F.char_length(r["ids"])) & F.contains(o["ids"], r["ids"]))

    best = marked.withColumn("_fits", F.filter("_fits", widest))
    return best.select(
        "doc_id", "sentences", F.col("_fits.rule").alias("rules"),
        F.array_distinct("_fits.licence").alias("licences"), F.array_distinct("_fits.kind").alias("kinds"),
        F.array_distinct("_fits.expression").alias("expressions"),
    )
