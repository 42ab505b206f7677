"""License scan by ordered signature rules.

A text that holds a word of any keyword becomes a row of lower-case words. Words with a rule's keywords are tried
against the rule, a regular expression over the words. Of overlapping detections the one of higher priority stays; of
equal ones the one that begins first, and of those the longer, in which the others are contained or which cuts into them.
Base phrases are always reported.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .spans import NO_SPANS, bind, places
from .url_filter import LOWER, UPPER

#: Runs of characters that separate words once A-Z is lower case, and one such character in the original text.
GAP, SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Base phrases and their labels: fixed values.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Licenses of one version: label and the phrases that name it.
NAMED = [
    ("mit", "(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit license"), ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "isc license"), ("isc", "permission to use copy modify and or distribute this software for any purpose"), ("zlib", "zlib license"), ("zlib", "this software is provided as is without any express or implied warranty"),
    ("unlicense", "this is free and unencumbered software released into the public domain"), ("unlicense", "the unlicense"), ("cc0-1.0", "cc0(?: 1 0)?"), ("cc0-1.0", "creative commons zero"), ("wtfpl", "do what the fuck you want to public license"),
    ("beerware", "beer ?ware license"), ("ofl-1.1", "sil open font license"), ("boost-1.0", "boost software license"), ("postgresql", "postgresql license"), ("python-2.0", "python software foundation license"), ("php-3.0", "php license"), ("ruby", "ruby license"),
    ("ncsa", "university of illinois ncsa open source license"), ("openssl", "openssl license"), ("vim", "vim license"), ("x11", "x11 license"), ("mit", "mit x11 licen[cs]e"), ("bsl-1.1", "business source license"), ("sspl-1.0", "server side public license"), ("elastic-2.0", "elastic license"),
    ("proprietary", "all rights reserved"), ("public-domain", "(?:placed|released|dedicated) (?:in|into|to) the public domain"),
]
#: Names that say a license but no version, or a license that goes by several names: label and the phrases.
FAMILIES = [
    ("gpl", "gnu gpl"), ("gpl", "gpl licen[cs]ed?"), ("gpl", "gnu public licen[cs]e"), ("lgpl", "gnu lgpl"), ("lgpl", "lgpl licen[cs]ed?"), ("lgpl", "(?:lesser|library) general public licen[cs]e"), ("agpl", "gnu agpl"), ("agpl", "agpl licen[cs]ed?"), ("agpl", "affero general public licen[cs]e"),
    ("mit", "mit licen[cs]ed"), ("mit", "mit expat licen[cs]e"), ("mit", "expat licen[cs]e"), ("mit", "mit style licen[cs]e"), ("mit-0", "mit no attribution"), ("apache", "apache licen[cs]ed"), ("apache", "apache software licen[cs]e"),
    ("bsd", "bsd licen[cs]ed"), ("bsd", "bsd style licen[cs]e"), ("bsd", "bsd type licen[cs]e"), ("bsd-3-clause", "(?:new|revised|modified) bsd licen[cs]e"), ("bsd-2-clause", "(?:simplified|freebsd) bsd licen[cs]e"), ("bsd-2-clause", "freebsd licen[cs]e"), ("bsd-4-clause", "original bsd licen[cs]e"), ("0bsd", "0bsd"), ("0bsd", "bsd zero clause licen[cs]e"),
    ("mpl", "mozilla public licen[cs]e"), ("mpl", "mpl licen[cs]ed?"), ("epl", "eclipse public licen[cs]e"), ("cddl", "common development and distribution licen[cs]e"), ("eupl", "european union public licen[cs]e"), ("artistic", "artistic licen[cs]e"), ("gfdl", "gnu free documentation licen[cs]e"), ("afl", "academic free licen[cs]e"), ("osl", "open software licen[cs]e"),
    ("ofl-1.1", "open font licen[cs]e"), ("unlicense", "unlicen[cs]e"), ("unlicense", "unlicen[cs]ed into the public domain"), ("wtfpl", "wtfpl"), ("zlib", "zlib libpng licen[cs]e"), ("libpng", "libpng licen[cs]e"), ("isc", "isc licen[cs]ed"), ("isc", "internet systems consortium licen[cs]e"), ("python-2.0", "psf licen[cs]e"),
    ("boost-1.0", "boost licen[cs]e"), ("cc", "creative commons licen[cs]e"), ("ms-pl", "microsoft public licen[cs]e"), ("ms-rl", "microsoft reciprocal licen[cs]e"), ("odbl-1.0", "open database licen[cs]e"), ("odc-by-1.0", "open data commons attribution licen[cs]e"), ("pddl-1.0", "public domain dedication and licen[cs]e"),
    ("upl-1.0", "universal permissive licen[cs]e"), ("mulanpsl-2.0", "mulan psl v2"), ("mulanpsl-2.0", "mulan permissive software licen[cs]e"), ("ecl-2.0", "educational community licen[cs]e"), ("cpal-1.0", "common public attribution licen[cs]e"), ("cpl-1.0", "common public licen[cs]e"), ("ipl-1.0", "ibm public licen[cs]e"), ("qpl-1.0", "q public licen[cs]e"),
    ("npl", "netscape public licen[cs]e"), ("spl-1.0", "sun public licen[cs]e"), ("json", "json licen[cs]e"), ("imagemagick", "imagemagick licen[cs]e"), ("curl", "curl licen[cs]e"), ("ijg", "independent jpeg group licen[cs]e"), ("icu", "icu licen[cs]e"), ("unicode", "unicode licen[cs]e"), ("w3c", "w3c software (?:notice and )?licen[cs]e"), ("zpl", "zope public licen[cs]e"),
    ("tcl", "tcl tk licen[cs]e"), ("hpnd", "historical permission notice and disclaimer"), ("blueoak-1.0.0", "blue oak model licen[cs]e"), ("polyform", "polyform (?:noncommercial|shield|small business|strict) licen[cs]e"), ("commons-clause", "commons clause"), ("proprietary", "proprietary and confidential"), ("proprietary", "commercial licen[cs]e agreement"), ("proprietary", "end user licen[cs]e agreement"),
    ("openrail", "openrail"), ("openrail", "responsible ai licen[cs]e"), ("llama", "llama [234] community licen[cs]e"), ("nasa-1.3", "nasa open source agreement"), ("sleepycat", "sleepycat licen[cs]e"), ("cecill", "cecill(?: [abc12])? licen[cs]e"), ("lppl", "latex project public licen[cs]e"), ("apsl", "apple public source licen[cs]e"), ("rpl", "reciprocal public licen[cs]e"),
]
#: Short identifiers of the public list of licenses, as files and manifests name them: fixed values.
IDENTIFIERS = """
0BSD AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0
Artistic-1.0-Perl Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC0-1.0 CDDL-1.0 CDDL-1.1
CDLA-Permissive-2.0 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 curl ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.0 EUPL-1.1 EUPL-1.2 GFDL-1.1 GFDL-1.2 GFDL-1.3 GFDL-1.3-only GFDL-1.3-or-later
GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IJG ImageMagick IPL-1.0 ISC JSON LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later
LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later libpng-2.0 LPL-1.02 LPPL-1.3c MirOS MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0
NASA-1.3 NCSA NPL-1.1 NTP ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1 OLDAP-2.8 OpenSSL OSL-1.0 OSL-2.0 OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 RPL-1.5 Ruby Sleepycat
SSPL-1.0 TCL Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.0 ZPL-2.1
"""
#: Identifiers that go by another label here, and words too common to name a license without "identifier" before them.
OTHER_LABELS = {"bsl-1.0": "boost-1.0", "busl-1.1": "bsl-1.1", "psf-2.0": "python-2.0"}
COMMON = {"curl", "json", "ruby", "tcl", "vim", "ntp", "w3c", "icu", "ijg"}
#: Sentences of license texts and notices: label and words.
TEXTS = [
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1.0", "the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to"),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
]
#: Notices of a family: label, what is licensed, name of the license, versions.
NOTICES = [("gpl", "program", "general public license", ["2", "3"]), ("lgpl", "library", "lesser general public license", ["2.1", "3"]), ("agpl", "program", "affero general public license", ["3"])]
#: Families whose rules are built from versions: label, keyword, names, versions.
VERSIONED = [
    ("gpl", "general public license", "(?:gnu )?general public license", ["1", "2", "3"]), ("gpl", "gpl", "(?:gnu )?gpl", ["1", "2", "3"]),
    ("lgpl", "lesser general public license", "(?:gnu )?lesser general public license", ["2", "2.1", "3"]), ("lgpl", "lgpl", "(?:gnu )?lgpl", ["2", "2.1", "3"]), ("lgpl", "library general public license", "(?:gnu )?library general public license", ["2"]),
    ("agpl", "affero general public license", "(?:gnu )?affero general public license", ["1", "3"]), ("agpl", "agpl", "(?:gnu )?agpl", ["1", "3"]), ("gfdl", "free documentation license", "(?:gnu )?free documentation license", ["1.1", "1.2", "1.3"]),
    ("apache", "apache license", "apache license", ["1.0", "1.1", "2.0"]), ("apache", "apache", "apache", ["2.0"]), ("mpl", "mozilla public license", "mozilla public license", ["1.0", "1.1", "2.0"]), ("mpl", "mpl", "mpl", ["1.0", "1.1", "2.0"]),
    ("epl", "eclipse public license", "eclipse public license", ["1.0", "2.0"]), ("cddl", "common development and distribution license", "common development and distribution license", ["1.0", "1.1"]), ("eupl", "european union public licen", "european union public licen[cs]e", ["1.0", "1.1", "1.2"]),
    ("afl", "academic free license", "academic free license", ["1.1", "1.2", "2.0", "2.1", "3.0"]), ("artistic", "artistic license", "artistic license", ["1.0", "2.0"]), ("osl", "open software license", "open software license", ["1.0", "1.1", "2.0", "2.1", "3.0"]),
]
CREATIVE = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"]
CREATIVE_LONG = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
CREATIVE_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
BSD_CLAUSES = {"0": "zero", "1": "one", "2": "two", "3": "three", "4": "four"}
HIGH, MIDDLE, LOW = 3, 2, 1
CONFIDENCE = {HIGH: 1.0, MIDDLE: 0.8, LOW: 0.6}


def _literal(phrase: str) -> str:
    """The longest part of a phrase that stands in every text it fits."""
    plain, depth, parts = "", 0, []
    for i, c in enumerate(phrase):
        depth += (c == "(") - (c == ")")
        kept = not depth and (c.isalnum() or c == " ") and phrase[i + 1 : i + 2] != "?"
        plain = plain + c if kept else ""
        parts.append(plain)
    return max(parts, key=len).strip()


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, pattern, priority), in order; patterns are over words with a space before and after.

    Text that a rule fits holds its keyword; where the keyword has several parts, all of them.
    """
    out = [(label, _literal(phrase), phrase, MIDDLE) for label, phrase in NAMED]
    out += [(label, _literal(phrase), phrase, HIGH) for label, phrase in TEXTS]
    out += [(label, _literal(phrase), phrase, LOW) for label, phrase in FAMILIES]
    for name in IDENTIFIERS.lower().split():
        label, words = OTHER_LABELS.get(name, name), name.replace("-", " ").replace(".", " ")
        out.append((label, f"spdx license identifier & {words}", f"spdx license identifier {words}", HIGH))
        if name not in COMMON:
            out.append((label, f"licen & {words}", f"licen[cs]e(?:d under)?(?: the)? {words}", MIDDLE))
    for family, work, name, versions in NOTICES:
        for v in versions:
            terms = f"it under the terms of the gnu {name} as published by the free software foundation"
            notice = f"this {work} is free software you can redistribute it and or modify {terms} either version {v.replace('.', ' ')} of the license or (?:at your option )?any later version"
            out.append((f"{family}-{v if '.' in v else v + '.0'}-or-later", f"the terms of the gnu {name} as published", notice, HIGH))
    for label, keyword, name, versions in VERSIONED:
        for v in versions:
            spaced = v.replace(".", " ")
            plain = spaced.removesuffix(" 0") + "(?: 0)?" if v.endswith(".0") or "." not in v else spaced
            full = f"{label}-{v if '.' in v else v + '.0'}"
            out.append((full, keyword, f"{name}(?: version| v)? ?v?{plain}", MIDDLE))
            out.append((full + "-or-later", keyword, f"{name}(?: version| v)? ?v?{plain} or (?:later|(?:at your option )?any later version)", HIGH))
            out.append((full + "-only", keyword, f"{name}(?: version| v)? ?v?{plain} only", HIGH))
    for kind in CREATIVE:
        long_name = " ".join(CREATIVE_LONG[x] for x in kind.split())
        for v in CREATIVE_VERSIONS:
            label, spaced = f"cc-{kind.replace(' ', '-')}-{v}", v.replace(".", " ")
            out.append((label, "cc by", f"cc {kind} {spaced}", HIGH))
            out.append((label, "creative commons", f"creative commons {long_name} {spaced}(?: international| unported| generic)?(?: license)?", HIGH))
        out.append((f"cc-{kind.replace(' ', '-')}", "cc by", f"cc {kind}", MIDDLE if " " in kind else LOW))
    for n, word in BSD_CLAUSES.items():
        out.append((f"bsd-{n}-clause" if n != "0" else "0bsd", "clause", f"(?:bsd (?:{n}|{word}) clause|(?:{n}|{word}) clause bsd)(?: license)?", MIDDLE))
    out.append(("bsd", "bsd license", "bsd license", LOW))
    return out


def keywords() -> list[str]:
    """What words must hold one of for any rule or base phrase to fit; keywords that hold another one are left out."""
    every = {keyword.split(" & ")[0] for _, keyword, _, _ in rules()} | {phrase for phrase, _ in PHRASES}
    return sorted(k for k in every if not any(o != k and o in k for o in every))


def gate_words() -> list[str]:
    """Few single words of which any text that some rule or base phrase fits holds one, whatever separates its words."""
    left = {k: {w for w in k.split() if len(w) > 5} or {max(k.split(), key=len)} for k in keywords() if not k.startswith(SHORT)}
    out = []
    while left:
        covers = lambda w: sum(any(w in x for x in k.split()) for k in left)
        out.append(max(sorted(set().union(*left.values())), key=covers))
        left = {k: words for k, words in left.items() if not any(out[-1] in x for x in k.split())}
    return out


#: A keyword too short to look for alone, and what a lower-case text with it or a longer word of its family holds.
SHORT, SHORT_PATTERN = "cc", r"cc(?:0|[\x00-\x2F\x3A-\x60\x7B-\x7F]+by)"


def _may_fit(text: Column) -> Column:
    """Whether a text may hold a rule's words. Lower case of all letters, not only A-Z, lets a few more texts through."""
    return bind(F.lower(text), lambda t: reduce(or_, [t.contains(w) for w in gate_words()]) | t.rlike(SHORT_PATTERN))


def _words(text: Column) -> Column:
    """Lower-case words, one space before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, " ")), F.lit(" "))


def _place(words: Column, at: Column) -> Column:
    """Number of words before a place in ``words``."""
    before = F.substring(words, F.lit(1), at)
    return (F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))).cast("long")


def _bounded(pattern: str) -> str:
    return rf"(?<= )(?:{pattern})(?= )"


def fitting(words: str) -> Column:
    """array<int>: numbers of the rules that fit a column of words. A rule's pattern is a constant, compiled once, and tried where its keyword occurs.

    Rules hold neither quotes nor backslashes, so the expression is written as text, which is quicker to build.
    """
    by_keyword: dict[str, list[str]] = {}
    for i, (_, keyword, pattern, _) in enumerate(rules()):
        by_keyword.setdefault(keyword, []).append(f"CASE WHEN {words} RLIKE ' (?:{pattern}) ' THEN {i} END")
    holds = lambda k: " AND ".join(f"contains({words}, '{part}')" for part in k.split(" & "))
    tried = [f"CASE WHEN {holds(k)} THEN array_compact(array({', '.join(own)})) ELSE CAST(array() AS array<int>) END" for k, own in by_keyword.items()]
    return F.expr(f"concat({', '.join(tried)})")


def detections(words: Column, numbers: Column) -> Column:
    """array<struct<start, end, label, priority>> of all places of the rules with these numbers, in code points of ``words``."""
    rows = ", ".join(f"named_struct('label', '{a}', 'pattern', '{_bounded(c)}', 'priority', {d})" for a, _, c, d in rules())
    table = F.expr(f"array({rows})")
    one = lambda r: F.transform(places(words, r["pattern"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), r["label"].alias("label"), r["priority"].alias("priority")))
    return F.flatten(F.transform(numbers, lambda i: one(F.get(table, i))))


def unsuppressed(found: Column) -> Column:
    """Labels and priorities that remain after suppression, by a sweep over starts.

    Detections that start no later come first (of equal starts the longer, then the higher priority). One that overlaps
    an earlier one of at least its priority goes, and earlier ones of lower priority that it overlaps go. Of those that
    stay so far at most one of each priority reaches beyond the sweep; it is pending until the sweep has passed its end.
    """
    order = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("last"), (-d["priority"]).alias("minus"), d["label"].alias("label"))))
    state = "struct<pending:array<struct<end:int,label:string>>,kept:array<struct<label:string,priority:int>>>"
    nobody = F.struct(F.lit(-1).alias("end"), F.lit(None).cast("string").alias("label"))
    none = F.struct(F.array(*[nobody] * HIGH).alias("pending"), F.array().alias("kept")).cast(state)

    def step(s: Column, d: Column) -> Column:
        priority, end = -d["minus"], -d["last"]
        blocked = F.exists(F.slice(s["pending"], priority, F.lit(HIGH) - priority + 1), lambda x: x["end"] > d["start"])
        before = F.get(s["pending"], priority - 1)["label"]
        passed = F.when(before.isNull(), F.array().cast("array<struct<label:string,priority:int>>")).otherwise(F.array(F.struct(before.alias("label"), priority.alias("priority"))))
        own = F.struct(end.alias("end"), d["label"].alias("label"))
        pending = F.transform(s["pending"], lambda x, i: F.when(i + 1 == priority, own).when((i + 1 < priority) & (x["end"] > d["start"]), nobody).otherwise(x))
        return F.when(blocked, s).otherwise(F.struct(pending.alias("pending"), F.array_union(s["kept"], passed).alias("kept")).cast(state))

    def done(s: Column) -> Column:
        last = F.transform(s["pending"], lambda x, i: F.struct(x["label"].alias("label"), (i + 1).alias("priority")))
        return F.array_union(s["kept"], F.filter(last, lambda x: x["label"].isNotNull()))

    return F.aggregate(order, none, step, done)


#: A plus after a version says "or later"; it is a separator elsewhere.
PLUS = r"([0-9])\+(?![0-9A-Za-z+])"
OUTPUTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns with n_words, n_base, first_word, last_word, base_labels, labels and score (such ones are replaced).

    A null text has no words. Repeated rows come out as often as they occur; an empty table gives an empty result.
    The score is the confidence of the best detection, 0 without any.
    """
    own = [c for c in docs.columns if c.lower() not in OUTPUTS]
    whole = F.coalesce(common.col(text).cast("string"), F.lit(""))
    held = docs.select(F.struct(*[common.col(c) for c in own]).alias("row") if own else F.lit(None).alias("row"), whole.alias("whole"))
    held = held.select("row", "whole", common.count_runs(F.col("whole"), SEPARATOR).alias("n_words"), F.when(_may_fit(F.col("whole")), _words(F.col("whole"))).alias("all"))
    hint = reduce(or_, [F.col("all").contains(k) for k in keywords()])
    held = held.select("row", "whole", "n_words", F.when(hint, F.col("all")).alias("words"))
    plus = F.when(F.col("whole").contains("+"), _words(F.regexp_replace("whole", PLUS, "$1 or later "))).otherwise(F.col("words"))
    held = held.select("row", "n_words", "words", F.when(F.col("words").isNotNull(), plus).alias("spoken"))
    words, spoken = F.col("words"), F.col("spoken")
    base = F.array(*[F.struct(F.lit(label).alias("label"), F.when(words.contains(f" {phrase} "), places(words, F.lit(_bounded(phrase)))).otherwise(F.array().cast(NO_SPANS)).alias("at")) for phrase, label in PHRASES])
    held = held.withColumns({"base": F.when(words.isNotNull(), F.filter(base, lambda b: F.size(b["at"]) > 0)), "numbers": F.when(words.isNotNull(), fitting("spoken"))})
    held = held.withColumn("more", F.when(F.size("numbers") > 0, unsuppressed(detections(spoken, F.col("numbers")))))
    places_ = F.flatten(F.transform(F.col("base"), lambda b: b["at"]))
    at = lambda pick: _place(words, pick(F.transform(places_, lambda m: m["start"]))) - 1  # noqa: E731  the first space stands before word 0
    labels = F.coalesce(F.transform("base", lambda b: b["label"]), F.array().cast("array<string>"))
    more = F.coalesce(F.transform("more", lambda d: d["label"]), F.array().cast("array<string>"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.array_max(F.transform("more", lambda d: d["priority"]))
    score = F.when(best == HIGH, CONFIDENCE[HIGH]).when(best == MIDDLE, CONFIDENCE[MIDDLE]).when(best == LOW, CONFIDENCE[LOW]).otherwise(0.0)
    score = F.greatest(score, F.when(F.size(labels) > 0, CONFIDENCE[MIDDLE]).otherwise(0.0))
    made = held.select("row", "n_words", F.coalesce(F.size(places_), F.lit(0)).cast("long").alias("n_base"), at(F.array_min).alias("first_word"), at(F.array_max).alias("last_word"), joined(labels).alias("base_labels"), joined(F.concat(labels, more)).alias("labels"), score.alias("score"))
    return made.select(*[F.col("row")[c].alias(c) for c in own], *OUTPUTS)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
