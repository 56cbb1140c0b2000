"""Licence scans by sentence rules.

Sentences are normalised and mapped to the identifiers of known licence sentences; the
sequence of a text's identifiers is then matched against licence rules, in order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeloom.llm.common import body

# Words of which a licence sentence has at least one (normalised text).
KEYWORDS = (
    "licen[cs]e|copyright|permission|redistribut|warrant|spdx|creative commons|public domain|"
    "all rights reserved|free software|cc by|cc0|as is|endorse or promote|advertising materials|"
    r"copy of the mpl|copy of the gnu|attribution-noncommercial|attribution-noderiv|"
    r"attribution-sharealike|attribution 4\.0|\(c\) [12]|©"
)

# What may stand between two parts of one statement: text that names no other licence.
_GAP = r"[^\x02]"
# Identifier and pattern of what licence sentences say (normalised text).  Earlier
# ones take the text they match; a sentence has all identifiers found in it, in order of place.
SENTENCES = [
    ("MITgrant", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MITnotice", r"the above copyright notice and this permission notice (shall|must) be included"),
    ("ISCgrant", r"permission to use, copy, modify,? and(/or)? distribute this software for any purpose"),
    ("BSDgrant", r"redistribution and use in source and binary forms, with or without modification"),
    ("BSDsource", r"redistributions of source code must retain the above copyright notice"),
    ("BSDbinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BSDadvert", r"all advertising materials mentioning features or use of this software"),
    ("BSDendorse", rf"neither the names? of {_GAP}{{1,200}}? (may|nor) {_GAP}{{0,200}}?be used to endorse or promote"),
    ("AsIs", rf"(software|work) is (provided|distributed) {_GAP}{{0,60}}as is\b"),
    ("Apache2basis", r"distributed under the licen[cs]e is distributed on an .?as is.? basis"),
    ("Apache2limits", r"see the licen[cs]e for the specific language governing permissions"),
    ("Apache2comply", r"you may not use this file except in compliance with the licen[cs]e"),
    ("Apache2obtain", r"you may obtain a copy of the licen[cs]e at"),
    ("Apache2ref", r"apache licen[cs]e,? \(?(version |v\.? ?)?2\.0"),
    ("AGPL3later", rf"gnu affero general public licen[cs]e{_GAP}{{0,80}}version 3{_GAP}{{0,60}}any later version"),
    ("AGPL3ref", rf"gnu affero general public licen[cs]e{_GAP}{{0,80}}version 3"),
    ("LGPL3later", rf"gnu lesser general public licen[cs]e{_GAP}{{0,80}}version 3{_GAP}{{0,60}}any later version"),
    ("LGPL3ref", rf"gnu lesser general public licen[cs]e{_GAP}{{0,80}}version 3"),
    ("LGPL21later", rf"gnu (lesser|library) general public licen[cs]e{_GAP}{{0,80}}version 2{_GAP}{{0,60}}any later version"),
    ("LGPL21ref", rf"gnu (lesser|library) general public licen[cs]e{_GAP}{{0,80}}version 2"),
    ("GPL3later", rf"gnu general public licen[cs]e{_GAP}{{0,80}}version 3{_GAP}{{0,60}}any later version"),
    ("GPL2later", rf"gnu general public licen[cs]e{_GAP}{{0,80}}version 2{_GAP}{{0,60}}any later version"),
    ("GPL3ref", rf"gnu general public licen[cs]e{_GAP}{{0,80}}version 3"),
    ("GPL2ref", rf"gnu general public licen[cs]e{_GAP}{{0,80}}version 2"),
    ("GPLwarranty", r"without any warranty; without even the implied warranty"),
    ("GPLcopy", r"you should have received a copy of the gnu"),
    ("MPL2ref", r"mozilla public licen[cs]e,? (version |v\.? ?)2\.0"),
    ("MPL2copy", r"if a copy of the mpl was not distributed with this file"),
    ("CCBYNCSA4", r"(cc by-nc-sa|attribution-noncommercial-sharealike) 4\.0"),
    ("CCBYNCND4", r"(cc by-nc-nd|attribution-noncommercial-noderiv[a-z]*) 4\.0"),
    ("CCBYNC4", r"(cc by-nc|attribution-noncommercial) 4\.0"),
    ("CCBYND4", r"(cc by-nd|attribution-noderiv[a-z]*) 4\.0"),
    ("CCBYSA4", r"(cc by-sa|attribution-sharealike) 4\.0"),
    ("CCBY4", r"(cc by|attribution) 4\.0"),
    ("CC0", r"(\bcc0\b|creative commons zero)"),
    ("Unlicense", r"this is free and unencumbered software released into the public domain"),
    ("PublicDomain", r"(placed|released|dedicated) (in|into|to) the public domain"),
    ("BSD4ref", r"(4-clause bsd|bsd 4-clause)( licen[cs]e)?"),
    ("BSD3ref", r"(3-clause bsd|bsd 3-clause)( licen[cs]e)?"),
    ("BSD2ref", r"(2-clause bsd|bsd 2-clause)( licen[cs]e)?"),
    ("ISCref", r"(under|of|and|or|either) (the )?(terms of )?(the )?isc licen[cs]e"),
    ("MITref", r"(under|of|and|or|either) (the )?(terms of )?(the )?(mit|expat) licen[cs]e"),
    ("AllRights", r"all rights reserved"),
    ("Copyright", r"^ ?(copyright|\(c\)|©)"),
]

# Licence and the sequence of identifiers that states it.  Whole texts stand
# before references, longer sequences before the shorter ones they contain; what a rule
# has matched is used up, with the copyright lines ahead of it.
_RULES = [
    ("MIT", "<MITgrant>(<MITnotice>)?(<AsIs>)?"),
    ("BSD-4-Clause", "<BSDgrant>(<BSDsource>)?(<BSDbinary>)?<BSDadvert>(<BSDendorse>)?(<AsIs>)?"),
    ("BSD-3-Clause", "<BSDgrant>(<BSDsource>)?(<BSDbinary>)?<BSDendorse>(<AsIs>)?"),
    ("BSD-2-Clause", "<BSDgrant>(<BSDsource>)?(<BSDbinary>)?(<AsIs>)?"),
    ("ISC", "<ISCgrant>(<AsIs>)?"),
    (
        "Apache-2.0",
        "<Apache2ref>(<Apache2comply>)?(<Apache2obtain>)?(<Apache2ref>)?(<Apache2basis>)?(<Apache2limits>)?",
    ),
    ("AGPL-3.0-or-later", "<AGPL3later>(<GPLwarranty>)?(<GPLcopy>)?"),
    ("AGPL-3.0", "<AGPL3ref>(<GPLwarranty>)?(<GPLcopy>)?"),
    ("LGPL-3.0-or-later", "<LGPL3later>(<GPLwarranty>)?(<GPLcopy>)?"),
    ("LGPL-3.0", "<LGPL3ref>(<GPLwarranty>)?(<GPLcopy>)?"),
    ("LGPL-2.1-or-later", "<LGPL21later>(<GPLwarranty>)?(<GPLcopy>)?"),
    ("LGPL-2.1", "<LGPL21ref>(<GPLwarranty>)?(<GPLcopy>)?"),
    ("GPL-3.0-or-later", "<GPL3later>(<GPLwarranty>)?(<GPLcopy>)?"),
    ("GPL-2.0-or-later", "<GPL2later>(<GPLwarranty>)?(<GPLcopy>)?"),
    ("GPL-3.0", "<GPL3ref>(<GPLwarranty>)?(<GPLcopy>)?"),
    ("GPL-2.0", "<GPL2ref>(<GPLwarranty>)?(<GPLcopy>)?"),
    ("MPL-2.0", "<MPL2ref>(<MPL2copy>)?"),
    ("MIT", "<MITref>"),
    ("BSD-4-Clause", "<BSD4ref>"),
    ("BSD-3-Clause", "<BSD3ref>"),
    ("BSD-2-Clause", "<BSD2ref>"),
    ("ISC", "<ISCref>"),
    ("CC-BY-NC-SA-4.0", "<CCBYNCSA4>"),
    ("CC-BY-NC-ND-4.0", "<CCBYNCND4>"),
    ("CC-BY-NC-4.0", "<CCBYNC4>"),
    ("CC-BY-ND-4.0", "<CCBYND4>"),
    ("CC-BY-SA-4.0", "<CCBYSA4>"),
    ("CC-BY-4.0", "<CCBY4>"),
    ("CC0-1.0", "<CC0>"),
    ("Unlicense", "<Unlicense>"),
    ("Public-Domain", "<PublicDomain>"),
]
NOTICES = "(<Copyright>|<AllRights>)*"
# Every licence with a name in SPDX is also stated by its tag.
SPDX_NAMES = list(dict.fromkeys(name for name, _ in _RULES if name != "Public-Domain"))
RULES = [
    *[(name, f"{NOTICES}({pattern})") for name, pattern in _RULES],
    *[(name, f"{NOTICES}<spdx {re.escape(name.lower())}>") for name in SPDX_NAMES],
    ("All-Rights-Reserved", "(<Copyright>)*<AllRights>"),
]

# Marks that begin comment lines and quote licence texts, and those this module puts in.
MARKS = "*#/\\\"'`\x01\x02\x03"
SPDX_TAG = "spdx-license-identifier:"
_SPDX_ID = r"[( ]*[a-z0-9][a-z0-9.+-]*[)]*"
# A tag and the expression after it, licences joined by and, or, with.
SPDX = rf"{SPDX_TAG}({_SPDX_ID}( (and|or|with){_SPDX_ID})*)"
SPDX_WORD = "[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]"
# Words of an expression that are no licence, and older ways to write some names.
SPDX_NO_ID = "^(and|or|with)$|exception"
SPDX_OLDER = [(r"\+$", "-or-later"), ("-only$", "")]
ANY_SENTENCE = "|".join(f"({pattern})" for _, pattern in SENTENCES)


def sentences(text: Column) -> Column:
    """The normalised sentences with a keyword, in order.

    Lower case (A-Z and letters beyond), comment marks away, white space to single spaces;
    a sentence ends at ``.``, ``!``, ``?`` or ``:`` before white space, and at a line's end
    after such a mark, before an empty line or after an SPDX tag.  The ``.`` of ``v. 2.0`` and the
    ``:`` of a tag end none, and ``and/or`` keeps its stroke.
    """
    clean = F.translate(F.lower(text), MARKS, "")
    tagged = F.regexp_replace(clean, rf"({SPDX_TAG}[^\n]*)\n", "$1\u0001")
    blocks = F.regexp_replace(tagged, r"[ \t\r]*\n([ \t\r]*\n)+", "\u0001")
    flat = F.regexp_replace(blocks, r"[ \t\r\n\x0B\f]+", " ")
    flat = F.regexp_replace(flat, r"\bv\. (\d)", "v.$1")
    flat = F.regexp_replace(flat, r"\bandor\b", "and/or")
    cut = F.split(F.regexp_replace(flat, r"([.!?]) ", "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s.rlike(KEYWORDS))


def _tags(sentence: Column) -> Column:
    """The identifiers of a sentence's SPDX tags, in order."""
    words = F.flatten(
        F.transform(
            F.regexp_extract_all(sentence, F.lit(SPDX), F.lit(1)),
            lambda e: F.regexp_extract_all(e, F.lit(SPDX_WORD), F.lit(0)),
        )
    )

    def named(word: Column) -> Column:
        for old, new in SPDX_OLDER:
            word = F.regexp_replace(word, old, new)
        known = [n.lower() for n in SPDX_NAMES]
        return F.when(word.isin(known), F.concat(F.lit("<spdx "), word, F.lit(">"))).otherwise("<SpdxOther>")

    return F.transform(F.filter(words, lambda w: ~w.rlike(SPDX_NO_ID)), named)


def identify(sentence: Column) -> Column:
    """All identifiers of a normalised sentence in order of place, those of SPDX tags last;
    ``<Unknown>`` if there are none.

    Each pattern puts its identifier in the place of what it matches, so that no later one
    matches there again.
    """
    marked = F.regexp_replace(sentence, SPDX, " ")
    for name, pattern in SENTENCES:
        marked = F.regexp_replace(marked, pattern, f"\x02{name}\x03")
    said = F.transform(
        F.regexp_extract_all(marked, F.lit("\x02([A-Za-z0-9]+)\x03"), F.lit(1)),
        lambda name: F.concat(F.lit("<"), name, F.lit(">")),
    )
    said = F.when(sentence.rlike(ANY_SENTENCE), said).otherwise(F.array().cast("array<string>"))
    tags = F.when(sentence.contains(SPDX_TAG), _tags(sentence)).otherwise(F.array().cast("array<string>"))
    found = F.array_join(F.concat(said, tags), "")
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("<Unknown>"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``sentence_ids``, ``licenses`` and ``n_unknown``.

    ``sentence_ids`` is the sequence of identifiers, each in angle brackets; ``licenses``
    the licences stated, in the order in which the rules first name them, comma-separated;
    ``n_unknown`` counts sentences that speak of licences but are not known, and SPDX tags of
    licences without a rule.  Copyright lines, ``all rights reserved`` included, belong to the
    licence that follows them; only without one do they state a licence.  Texts that state none, null and empty ones give empty strings and 0.  Repeated rows stay as they
    are; other columns are not looked at.

    One pass over each text, no shuffle; only texts with a keyword are cut into sentences.
    """
    text = body(text_col)
    candidate = F.lower(text).rlike(KEYWORDS)
    rows = docs.select(
        F.col(id_col),
        F.when(candidate, F.array_join(F.transform(sentences(text), identify), ""))
        .otherwise("")
        .alias("sentence_ids"),
    )
    # Each rule puts the licence's name in the place of what it matches.
    marked = F.col("sentence_ids")
    for name, pattern in RULES:
        marked = F.regexp_replace(marked, pattern, f"\x02{name}\x03")
    names = F.array(*[F.lit(n) for n in dict.fromkeys(name for name, _ in RULES)])
    stated = F.array_intersect(names, F.regexp_extract_all(marked, F.lit("\x02([^\x03]+)\x03"), F.lit(1)))
    return rows.select(
        id_col,
        "sentence_ids",
        F.when(F.col("sentence_ids") == "", "").otherwise(F.array_join(stated, ",")).alias("licenses"),
        F.regexp_count("sentence_ids", F.lit("<Unknown>|<SpdxOther>")).cast("long").alias("n_unknown"),
    )
