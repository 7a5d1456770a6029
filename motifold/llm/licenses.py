"""Licence recognition by sentences, with DataFrame functions only.

A text is normalised: lower case, letters and digits, single blanks, a mark between sentences and one for a
line break within a sentence. A sentence begins at a line's start or behind another one, and ends at a line's
end or before another one, so marks of comments, indented and wrapped lines change nothing. Sentences that are
known are mapped to their identifiers, and the sequence of identifiers is matched against ordered rules. A
rule replaces the identifiers that it takes, so later rules see what is left. Everything is computed within a
row, in time linear in the text: no shuffle, and any key can be as hot as it likes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .common import pick

# Licence sentences are patterns over lower-case letters, digits and single blanks; * is any run
# of words of up to 600 characters, + one within the line. A whole sentence has to match.
THE = "(this (work|software|file|program|project|code|package|library|document|repository|module|script|text|data) is |the (work|software|code|text|data) is |it is |all code is |content is |)"
UNDER = "((dual )?licen[sc]ed|released|distributed|made available|available|provided|published|shared) under (the |terms of the |the terms of the |a |an |)"
VERSION = "( version| v|v)? ?"
LATER = "( or( at your option)?( any)? (later|newer)( version)?)"
#: For each identifier that stands for a licence by its name: the licence and the name.
NAMED = [
    ("apache2", "Apache-2.0", f"(apache|asl)( software)?( license| licence)?{VERSION}2( 0)?( of the)?( the)?( license| licence)?"),
    ("apache11", "Apache-1.1", f"apache( software)? license{VERSION}1 1"),
    ("mit", "MIT", "(mit( x11)?|expat|x11)( license| licence)?"),
    ("gpl3plus", "GPL-3.0-or-later", f"(gnu )?(gpl|general public license){VERSION}3( 0)?{LATER}"),
    ("gpl3", "GPL-3.0", f"(gnu )?(gpl|general public license){VERSION}3( 0)?( only)?"),
    ("gpl2plus", "GPL-2.0-or-later", f"(gnu )?(gpl|general public license){VERSION}2( 0)?{LATER}"),
    ("gpl2", "GPL-2.0", f"(gnu )?(gpl|general public license){VERSION}2( 0)?( only)?"),
    ("gpl", "GPL", "(gnu )?(gpl|general public license)"),
    ("lgpl3plus", "LGPL-3.0-or-later", f"(gnu )?(lgpl|lesser general public license){VERSION}3( 0)?{LATER}"),
    ("lgpl3", "LGPL-3.0", f"(gnu )?(lgpl|lesser general public license){VERSION}3( 0)?( only)?"),
    ("lgpl21plus", "LGPL-2.1-or-later", f"(gnu )?(lgpl|lesser general public license){VERSION}2 1{LATER}"),
    ("lgpl21", "LGPL-2.1", f"(gnu )?(lgpl|lesser general public license){VERSION}2 1( only)?"),
    ("lgpl2plus", "LGPL-2.0-or-later", f"(gnu )?(lgpl|(library|lesser) general public license){VERSION}2( 0)?{LATER}"),
    ("lgpl2", "LGPL-2.0", f"(gnu )?(lgpl|(library|lesser) general public license){VERSION}2( 0)?( only)?"),
    ("lgpl", "LGPL", "(gnu )?(lgpl|lesser general public license)"),
    ("agpl3plus", "AGPL-3.0-or-later", f"(gnu )?(agpl|affero general public license|affero gpl){VERSION}3( 0)?{LATER}"),
    ("agpl3", "AGPL-3.0", f"(gnu )?(agpl|affero general public license|affero gpl){VERSION}3( 0)?( only)?"),
    ("mpl2", "MPL-2.0", f"(mpl|mozilla public license){VERSION}2( 0)?"),
    ("mpl11", "MPL-1.1", f"(mpl|mozilla public license){VERSION}1 1"),
    ("epl2", "EPL-2.0", f"(epl|eclipse public license){VERSION}2( 0)?"),
    ("epl1", "EPL-1.0", f"(epl|eclipse public license){VERSION}1( 0)?"),
    ("eupl12", "EUPL-1.2", f"(eupl|european union public licen[sc]e){VERSION}1 2"),
    ("artistic2", "Artistic-2.0", f"artistic license{VERSION}2( 0)?"),
    ("boost", "BSL-1.0", f"(boost software license|bsl){VERSION}(1( 0)?)?"),
    ("zlib", "Zlib", "zlib( libpng)?( license| licence)"),
    ("unlicense", "Unlicense", "unlicense( license)?"),
    ("wtfpl", "WTFPL", "(wtfpl|do what the fuck you want to public license)( version 2| v2)?"),
    ("ofl11", "OFL-1.1", f"(sil )?(ofl|open font license){VERSION}(1 1)?"),
    ("postgresql", "PostgreSQL", "postgresql licen[sc]e"),
    ("python2", "PSF-2.0", f"(psf|python software foundation|python)( license)?{VERSION}2( 0)?( license)?"),
    ("ccbyncsa4", "CC-BY-NC-SA-4.0", "(cc|creative commons) (by nc sa|attribution non ?commercial share ?alike)( license)? 4 0( international)?( public)?( license)?"),
    ("ccbyncnd4", "CC-BY-NC-ND-4.0", "(cc|creative commons) (by nc nd|attribution non ?commercial no ?deriv(ative)?s)( license)? 4 0( international)?( public)?( license)?"),
    ("ccbync4", "CC-BY-NC-4.0", "(cc|creative commons) (by nc|attribution non ?commercial)( license)? 4 0( international)?( public)?( license)?"),
    ("ccbynd4", "CC-BY-ND-4.0", "(cc|creative commons) (by nd|attribution no ?deriv(ative)?s)( license)? 4 0( international)?( public)?( license)?"),
    ("ccbysa4", "CC-BY-SA-4.0", "(cc|creative commons) (by sa|attribution share ?alike)( license)? 4 0( international)?( public)?( license)?"),
    ("ccbysa3", "CC-BY-SA-3.0", "(cc|creative commons) (by sa|attribution share ?alike)( license)? 3 0( unported)?( license)?"),
    ("ccby4", "CC-BY-4.0", "(cc|creative commons) (by|attribution)( license)? 4 0( international)?( public)?( license)?"),
    ("ccby3", "CC-BY-3.0", "(cc|creative commons) (by|attribution)( license)? 3 0( unported)?( license)?"),
    ("cc0", "CC0-1.0", "(cc0|cc zero|creative commons zero|creative commons cc0)( v?1 0)?( universal)?( license)?"),
    ("bsd3", "BSD-3-Clause", "((new|modified|revised) bsd|bsd 3 clause|3 clause bsd|bsd 3)( new| revised)?( or revised)?( license)?"),
    ("bsd2", "BSD-2-Clause", "((simplified|freebsd) bsd|bsd 2 clause|2 clause bsd|bsd 2)( simplified)?( license)?"),
    ("bsd", "BSD", "bsd( style)?( license)?"),
    ("isc", "ISC", "isc( license)?"),
]
NOTICE = "(([a-z0-9]{1,40} ){1,4}is free software )?you can redistribute it and or modify it under the terms of the gnu %sgeneral public license as published by the free software foundation"
#: Identifiers of sentences of notices and of the licences' own texts.
OTHER = [
    ("copyright", "(c )?(copyright|copyrights)( c)?+"),
    ("rights", "all rights reserved"),
    ("mitgrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files*"),
    ("mitnotice", "the above copyright notice and this permission notice( including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("zlibasis", "this software is provided as is without any express or implied warranty"),
    ("asis", "(the|this) software is provided( by*)? as is*warrant*"),
    ("liable", "in no event (shall|will)*be (held )?liable( for any*)?"),
    ("bsdgrant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsdsource", "(1 )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsdbinary", "(2 )?redistributions in binary form must reproduce the above copyright notice*"),
    ("bsdname", "(3 )?neither the name of*may be used to endorse or promote products*"),
    ("iscgrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted( provided*)?"),
    ("apachelimit", "you may not use this file except in compliance with the license"),
    ("apachecopy", "you may obtain a copy of the license at*"),
    ("apachetext", "apache license version 2 0 january 2004( http www apache org licenses)?*"),
    ("gplnotice", NOTICE % ""),
    ("lgplnotice", NOTICE % "(lesser|library) "),
    ("agplnotice", NOTICE % "affero "),
    ("gplnotice3plus", NOTICE % "" + " either version 3 of the license or at your option any later version"),
    ("gplnotice2plus", NOTICE % "" + " either version 2 of the license or at your option any later version"),
    ("lgplnotice3plus", NOTICE % "lesser " + " either version 3 of the license or at your option any later version"),
    ("lgplnotice21plus", NOTICE % "lesser " + " either version 2 1 of the license or at your option any later version"),
    ("agplnotice3plus", NOTICE % "affero " + " either version 3 of the license or at your option any later version"),
    ("v2plus", "either version 2 of the license or at your option any later version"),
    ("v21plus", "either version 2 1 of the license or at your option any later version"),
    ("v3plus", "either version 3 of the license or at your option any later version"),
    ("v2only", "version 2 of the license( only)?"),
    ("v3only", "version 3 of the license( only)?"),
    ("gpltext3", "gnu general public license version 3 29 june 2007"),
    ("gpltext2", "gnu general public license version 2 june 1991"),
    ("lgpltext3", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpltext21", "gnu lesser general public license version 2 1 february 1999"),
    ("agpltext3", "gnu affero general public license version 3 19 november 2007"),
    ("gnucopies", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("mpltext2", "mozilla public license version 2 0"),
    ("mplform", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mplcopy", "if a copy of the mpl was not distributed with this file you can obtain one at*"),
    ("epltext2", "eclipse public license v 2 0"),
    ("boosttext", "boost software license version 1 0 17 ?(th)? august( 17th)? 2003"),
    ("boosttext2", "boost software license version 1 0 august 17th 2003"),
    ("artistictext2", "the artistic license 2 0"),
    ("unlicensetext", "this is free and unencumbered software released into the public domain"),
    ("zlibgrant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("wtfpltext", "do what the fuck you want to public license version 2 december 2004"),
    ("cctext", "creative commons (legal code|corporation creative commons is not a law firm*)"),
    ("publicdomain", f"{THE}(dedicated to|released into|in) the public domain"),
    ("placeddomain", "this (work|software|file|code) (has been|is) placed in the public domain"),
]
#: A whole sentence that names a licence: one of these, then the name; or a heading.
LEADS = f"({THE}{UNDER}|(project |software |code |the )?licen[sc]e( is| type| identifier)? )"
HEADINGS = "(the )?(((mit|isc|zlib|postgresql|bsd|(new|modified|revised|simplified) bsd|bsd [23] clause|[23] clause bsd|boost software) license|unlicense)|(apache|mozilla public|eclipse public|gnu (lesser |affero )?general public) license( version)? v?[0-9]( [0-9])?)"

# Identifiers of the SPDX list.
SPDX = """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0
CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only
GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1
MPL-2.0 MS-PL NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 Ruby Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1""".split()  # fmt: skip

# Ordered rules over sequences of identifiers, each written with a comma behind it.
# A sequence can be broken by copyright lines, which are taken away first.
RULES = [
    ("MIT", "(mit,)?mitgrant,mitnotice,(asis,)?(liable,)?"),
    ("BSD-3-Clause", "(bsd3,|bsd,)?bsdgrant,bsdsource,bsdbinary,bsdname,(asis,)?(liable,)?"),
    ("BSD-2-Clause", "(bsd2,|bsd,)?bsdgrant,bsdsource,bsdbinary,(asis,)?(liable,)?"),
    ("ISC", "(isc,)?iscgrant,(asis,)?(liable,)?"),
    ("Zlib", "(zlib,)?zlibasis,(liable,)?zlibgrant,"),
    ("Apache-2.0", "(apachetext,)?apache2,(apachelimit,)?(apachecopy,)?"),
    ("Apache-2.0", "apachetext,"),
    ("GPL-3.0-or-later", "(gplnotice3plus,|gplnotice,v3plus,)"),
    ("GPL-2.0-or-later", "(gplnotice2plus,|gplnotice,v2plus,)"),
    ("GPL-3.0", "gplnotice,v3only,"),
    ("GPL-2.0", "gplnotice,v2only,"),
    ("GPL", "gplnotice,"),
    ("LGPL-3.0-or-later", "(lgplnotice3plus,|lgplnotice,v3plus,)"),
    ("LGPL-2.1-or-later", "(lgplnotice21plus,|lgplnotice,v21plus,)"),
    ("LGPL-2.0-or-later", "lgplnotice,v2plus,"),
    ("LGPL", "lgplnotice,"),
    ("AGPL-3.0-or-later", "(agplnotice3plus,|agplnotice,v3plus,)"),
    ("GPL-3.0", "gpltext3,(gnucopies,)?"),
    ("GPL-2.0", "gpltext2,(gnucopies,)?"),
    ("LGPL-3.0", "lgpltext3,(gnucopies,)?"),
    ("LGPL-2.1", "lgpltext21,(gnucopies,)?"),
    ("AGPL-3.0", "agpltext3,(gnucopies,)?"),
    ("MPL-2.0", "mplform,(mplcopy,)?"),
    ("MPL-2.0", "mpltext2,"),
    ("EPL-2.0", "epltext2,"),
    ("BSL-1.0", "(boosttext,|boosttext2,)"),
    ("Artistic-2.0", "artistictext2,"),
    ("Unlicense", "(unlicense,)?unlicensetext,"),
    ("WTFPL", "wtfpltext,"),
    ("MIT", "mit,(asis,)?"),
    *((spdx, f"{name},") for name, spdx, _ in NAMED if name not in ("mit", "apache2")),
    ("Public-Domain", "(publicdomain,|placeddomain,)"),
]

#: What a run of words can be.
RUN, IN_LINE = "[a-z0-9 L]{0,600}", "[a-z0-9 ]{0,300}"
#: Of ASCII: all but small letters, digits and a new line; the same without Z; without Z and a blank; without Z and L, but with a new line; and without a blank.
MARK, MARK_Z, MARK_ZB = r"[\x00-\x09\x0b-/:-`{-\x7f]", r"[\x00-\x09\x0b-/:-Y\[-`{-\x7f]", r"[\x00-\x09\x0b-\x1f!-/:-Y\[-`{-\x7f]"
GAP, INK = r"[\x00-/:-KM-Y\[-`{-\x7f]", r"[\x00-\x1f!-/:-KM-Y\[-`{-\x7f]"
#: What normalises a lower-case text. Z stands between sentences, L for a line break within one.
#: A run of 64 marks ends a sentence; it bounds what is looked at again.
STEPS = [
    (r"[\x{80}-\x{10ffff}]+", "_"), (r"\r\n?", "\n"), (r"([0-9])\+", r"\1 or later"), (r"\bv\.[ \t]*([0-9])", r"v \1"), (f"{MARK}{{64,}}", ". "), (f"[.;:!?]{MARK}*\n", "Z"), (f"\n{MARK_Z}*\n", "Z"),
    (f"[.;!?]{MARK_ZB}*[ \t]", "Z"), (r"\n", "L"), (f"{INK}{GAP}*| {GAP}+", " "), (r" ?[ZL]*Z[ ZL]*", "ZZ"), (r" ?L[L ]*", "LL"),
]
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of bracketed identifiers: those that no rule needs, and an empty sequence.
IGNORED = r"\[(copyright|rights|cctext|)\]"


def _pattern(sentence: str) -> str:
    """Over a normalised text: a blank can be a line break, and a run of words takes no mark of a sentence's end."""
    parts = re.split(r"(\*|\+)", sentence.replace("(", "(?:"))
    return "".join({"*": RUN, "+": IN_LINE}.get(x) or x.replace(" ", "(?: |LL)") for x in parts)


#: (identifier, pattern), the first that matches counts; `EVERY` finds the sentences, by the same patterns.
SENTENCES = [*((n, _pattern(p)) for n, p in OTHER), *((n, _pattern(f"({LEADS}|(the )?){p}")) for n, _, p in NAMED)]
#: What names licences by SPDX's identifiers.
DECLARED = _pattern("spdx licen[sc]e identifier ") + "[a-z0-9 ]{1,300}"
IDENTIFIERS = {re.sub("[^a-z0-9]+", " ", n.lower()): n for n in sorted(SPDX, key=lambda x: (-len(x), x))}
EVERY = f"[ZL]({DECLARED}|{'|'.join(_pattern(p) for _, p in OTHER)}|{_pattern(LEADS)}(?:{'|'.join(_pattern(p) for _, _, p in NAMED)})|{_pattern(HEADINGS)})[ZL]"
ONE_SPDX = rf"\b({'|'.join(IDENTIFIERS)})\b"

#: Each pattern asks for one of these, as the tests derive from the patterns, so a text without any has no known sentence.
HINT = "licen|under|spdx|copyright|rights|permission|liable|redistribution|endorse|distributed|domain|warrant|commons"


def bracketed(rule: str) -> str:
    """A rule as a pattern over identifiers that stand in brackets."""
    return re.sub(r"(\w+),", r"\[\1\]", rule.replace("(", "(?:"))


def normalised(text: Column) -> Column:
    out = F.translate(text, CAPITALS, SMALL)
    for pattern, new in STEPS:
        out = F.regexp_replace(out, pattern, new.replace("\\", "$"))
    return F.concat(F.lit("Z"), F.trim(out), F.lit("Z"))


def _ids(sentence: Column) -> Column:
    """The identifiers of a known sentence: one, or `=` and a licence for each that is declared."""
    one = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        one = F.when(sentence.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(one)
    names = F.create_map(*(F.lit(x) for kv in IDENTIFIERS.items() for x in kv))
    declared = F.transform(F.regexp_extract_all(F.substring(sentence, 24, 10_000), F.lit(ONE_SPDX), F.lit(1)), lambda x: F.concat(F.lit("="), F.element_at(names, x)))
    declared = F.when(F.size(declared) > 0, declared).otherwise(F.array(F.lit("spdx")))
    return F.when(sentence.rlike(f"^{DECLARED}$"), declared).otherwise(F.array(one))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids (comma-joined, in order; a declared licence is `=` and its
    name), licenses (as the text has them, comma-joined, repeats included) and n_left (identifiers that no rule took).

    Texts that are null or empty have zeros and empty strings; each row gives a row; other columns are ignored.
    """
    hinted = F.when(F.col("text").rlike(f"(?i){HINT}"), F.col("text")).otherwise("")
    sentences = F.when(F.length(hinted) > 0, F.regexp_extract_all(normalised(hinted), F.lit(EVERY), F.lit(1))).otherwise(F.array().cast("array<string>"))
    found = pick(docs, "doc_id", "text").select("doc_id", sentences.alias("s"))
    found = found.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.array_join(F.flatten(F.transform("s", _ids)), ",").alias("sentence_ids"))
    left = F.concat(F.lit("["), F.replace("sentence_ids", F.lit(","), F.lit("][")), F.lit("]"))
    left = F.regexp_replace(F.regexp_replace(left, IGNORED, ""), r"\[=([^\]]+)\]", "<$1>")
    for name, pattern in RULES:
        left = F.regexp_replace(left, bracketed(pattern), f"<{name}>")
    left = F.when(F.col("n_sentences") > 0, left).otherwise("")
    done = found.select("doc_id", "n_sentences", "sentence_ids", left.alias("left"))
    taken = F.regexp_extract_all("left", F.lit("<([^>]+)>"), F.lit(1))
    rest = F.regexp_extract_all("left", F.lit(r"\["), F.lit(0))
    return done.select("doc_id", "n_sentences", "sentence_ids", F.array_join(taken, ",").alias("licenses"), F.size(rest).cast("bigint").alias("n_left"))


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """The same in DuckDB's SQL."""
    ids = " ".join(f"WHEN regexp_full_match(s, '{p}') THEN ['{n}']" for n, p in SENTENCES)
    text = f"translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}')"
    for pattern, new in STEPS:
        text = f"regexp_replace({text}, '{pattern}', '{new.replace(chr(10), chr(92) + 'n') if new != chr(10) else chr(10)}', 'g')"
    names = ", ".join(f"'{k}': '{v}'" for k, v in IDENTIFIERS.items())
    left = f"regexp_replace(regexp_replace('[' || replace(sentence_ids, ',', '][') || ']', '{IGNORED}', '', 'g'), '\\[=([^\\]]+)\\]', '<\\1>', 'g')"
    for name, pattern in RULES:
        left = f"regexp_replace({left}, '{bracketed(pattern)}', '<{name}>', 'g')"
    return rf"""
WITH found AS MATERIALIZED (SELECT doc_id, regexp_extract_all('Z' || trim({text}) || 'Z', '{EVERY}', 1) AS l FROM documents),
each AS (SELECT doc_id, l, list_transform(l, lambda s: CASE WHEN regexp_full_match(s, '{DECLARED}') THEN
  CASE WHEN len(regexp_extract_all(s[24:], '{ONE_SPDX}', 1)) > 0 THEN list_transform(regexp_extract_all(s[24:], '{ONE_SPDX}', 1), lambda x: '=' || (MAP {{{names}}})[x]) ELSE ['spdx'] END {ids} END) AS ids FROM found),
seq AS MATERIALIZED (SELECT doc_id, CAST(len(l) AS BIGINT) AS n_sentences, coalesce(array_to_string(flatten(ids), ','), '') AS sentence_ids FROM each),
done AS (SELECT *, CASE WHEN n_sentences > 0 THEN {left} ELSE '' END AS l FROM seq)
SELECT doc_id, n_sentences, sentence_ids, array_to_string(regexp_extract_all(l, '<([^>]+)>', 1), ',') AS licenses,
  CAST(len(regexp_extract_all(l, '\[')) AS BIGINT) AS n_left FROM done"""
