"""License scans by ordered signature rules. Native: DataFrame functions only.

A rule is a regular expression over a text's words (joined by single spaces), anchored at the word
it begins with. Two prefilters gate the rules: a text must hold one of the GATE stems, and a
rule is tried only at words that are its keyword. Each match is an interval of words. A detection is dropped
if one of the same or a higher priority (a smaller number) contains it, the earlier rule standing for equal
intervals, or if one of a higher priority overlaps it; detections of base phrases always stay.

Defined results: null texts are empty; no detection gives an empty label list and score 0; a rule sees
HORIZON words from its keyword on, more than the longest rule spans; extra columns pass through, whatever their
names, but for those that scan_licenses() makes, which are replaced.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidline.llm.common import byte_text, column, kept_columns, save, words_of

MADE = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
#: Words that a rule sees from its keyword on.
HORIZON = 32
#: Between words, after A-Z are lower-cased.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A text without any of these, after A-Z are lower-cased, matches no rule and no base phrase: stems that suffice, and
#: stems for which the expressions behind them decide.
STEMS = ("licen", "copyright", "copyleft", "rights", "warrant", "spdx", "gnu", "gpl", "cc0", "commons", "redistribut", "permission", "permitted", "wtfpl", "noncommercial", "reproduced", "proprietary", "confidential", "unauthorized", "bsd", "royalty", "as-is", "liable", "liability", "infring", "trademark", "attribution", "disclaim", "source code form", "derivative work", "cddl", "sspl", "mulan")
MAYBE = {
    "pl": f"(?<![a-z0-9])[me]pl(?:{_GAP})?v?(?:{_GAP})?\\d",
    "cc": f"cc{_GAP}(?:by|zero)",
    "domain": f"public{_GAP}domain|unencumbered",
    "only": f"use{_GAP}only",
    "foundation": f"software{_GAP}foundation",
    "as": f"(?:provided|distributed){_GAP}(?:on{_GAP}an{_GAP})?as{_GAP}is",
    "fuck": f"what{_GAP}the{_GAP}fuck",
    "derivative": f"derivative{_GAP}works?",
    "source": f"source{_GAP}code{_GAP}form|altered{_GAP}source",
    "tort": f"contract{_GAP}tort",
    "advertising": f"advertising{_GAP}materials",
    "verbatim": f"verbatim{_GAP}copies",
    "perl": f"as{_GAP}perl{_GAP}itself",
    "font": f"font{_GAP}(?:software|name)",
    "product": f"this{_GAP}product{_GAP}includes",
    "consortium": f"x{_GAP}consortium",
    "third": f"third{_GAP}parties{_GAP}as{_GAP}a",
    "grant": f"additional{_GAP}use{_GAP}grant",
    "commercial": f"for{_GAP}commercial{_GAP}(?:purposes|use)",
    "remix": f"remix{_GAP}transform",
    "invariant": f"invariant{_GAP}sections",
    "evil": f"good{_GAP}not{_GAP}evil",
    "risk": f"entire{_GAP}risk{_GAP}as",
    "damage": f"possibility{_GAP}of{_GAP}such{_GAP}damage",
    "option": f"at{_GAP}your{_GAP}option",
}
#: Base phrases: (words, label).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def signature_rules() -> list[tuple[int, int, int, str, str, str]]:
    """(rule, priority, confidence in percent, keyword, regular expression, label), in order. Priority 1 binds most.

    The families below are written by hand; their versions, forms of address and variants follow by rule.
    """
    rules: list[tuple[int, int, str, str, str]] = []
    add = lambda priority, sure, label, *patterns: rules.extend((priority, sure, p.split(" ")[0], p, label) for p in patterns)
    v = r"(?: version| v)?"
    # Families known by a title and, at times, a version.
    named = {
        "apache": ("apache(?: software)? license", ("1 0", "1 1", "2 0")),
        "mpl": ("mozilla public license", ("1 0", "1 1", "2 0")),
        "epl": ("eclipse public license", ("1 0", "2 0")),
        "cddl": ("common development and distribution license", ("1 0", "1 1")),
        "eupl": ("european union public licen[cs]e", ("1 0", "1 1", "1 2")),
        "artistic": ("artistic license", ("1 0", "2 0")),
        "afl": ("academic free license", ("2 1", "3 0")),
        "osl": ("open software license", ("1 0", "2 1", "3 0")),
        "ofl": ("sil open font license", ("1 0", "1 1")),
        "bsl": ("boost software license", ("1 0",)),
        "lppl": ("latex project public license", ("1 0", "1 2", "1 3c")),
        "zpl": ("zope public license", ("1 1", "2 0", "2 1")),
        "cpl": ("common public license", ("1 0",)),
        "ms-pl": ("microsoft public license", ()),
        "ms-rl": ("microsoft reciprocal license", ()),
        "python": ("python software foundation license", ("2",)),
        "php": ("php license", ("3 0", "3 01")),
        "openssl": ("openssl license", ()),
        "zlib": ("zlib(?: libpng)? license", ()),
        "isc": ("isc license", ()),
        "mit": ("mit license", ()),
        "ncsa": ("university of illinois ncsa open source license", ()),
        "w3c": ("w3c software(?: notice and)? license", ()),
        "x11": ("x11 license", ()),
        "unlicense": ("unlicense", ()),
        "odbl": ("open(?: data commons)? database license", ("1 0",)),
        "odc-by": ("open data commons attribution license", ("1 0",)),
        "pddl": ("public domain dedication and license", ("1 0",)),
        "gfdl": ("gnu free documentation license", ("1 1", "1 2", "1 3")),
        "agpl": ("gnu affero general public license", ("1", "3", "3 0")),
        "lgpl": ("gnu (?:lesser|library) general public license", ("2", "2 1", "3", "3 0")),
        "gpl": ("gnu general public license", ("1", "2", "2 0", "3", "3 0")),
        "sspl": ("server side public license", ("1",)),
        "busl": ("business source license", ("1 1",)),
        "elastic": ("elastic license", ("2 0",)),
    }
    for label, (title, versions) in named.items():
        for x in versions:
            add(1, 98, f"{label}-{x.replace(' ', '.')}", f"{title}{v} {x}")
        add(3, 90, label, title)
    # Creative Commons: every variant, written short and in words.
    parts = {"by": "attribution", "nc": "noncommercial", "nd": "no ?deriv(?:ative)?s", "sa": "share ?alike"}
    for variant in ("by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by"):
        label = "cc-" + variant.replace(" ", "-")
        words = " ".join(parts[x].replace("noncommercial", "non ?commercial") for x in variant.split(" "))
        for x in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            add(1, 98, f"{label}-{x.replace(' ', '.')}", f"cc {variant}{v} {x}")
        add(3, 90, label, f"cc {variant}", f"creative commons {words}", f"creativecommons org licenses {variant}")
    add(1, 97, "cc0-1.0", "cc0 1 0", "cc0 universal", "creativecommons org publicdomain zero")
    add(3, 90, "cc0", "cc0", "cc zero")
    # Identifiers in file headers.
    for name in ("mit", "isc", "zlib", "unlicense", "wtfpl", "0bsd"):
        add(1, 99, name, f"spdx license identifier {name}")
    for name, versions in {"apache": ("2 0",), "bsd": ("2 clause", "3 clause"), "gpl": ("2 0", "3 0"), "lgpl": ("2 1", "3 0"), "agpl": ("3 0",), "mpl": ("2 0",), "epl": ("2 0",), "cc0": ("1 0",)}.items():
        for x in versions:
            add(1, 99, f"{name}-{x.replace(' ', '.')}", f"spdx license identifier {name} {x}(?: only| or later)?")
    # Short names.
    for name, versions in {"gpl": ("2", "3"), "lgpl": ("2 1", "3"), "agpl": ("3",), "mpl": ("1 1", "2 0"), "epl": ("1 0", "2 0")}.items():
        for x in versions:
            add(2, 90, f"{name}-{x.replace(' ', '.')}", f"{name} {x}", f"{name}v{x.split(' ')[0]}", f"{name} v{x}")
    # BSD.
    for number, word in (("2", "two"), ("3", "three"), ("4", "four")):
        add(1, 96, f"bsd-{number}-clause", f"bsd {number} clause(?: license)?", f"{word} clause bsd(?: license)?", f"{number} clause bsd(?: license)?")
    add(3, 88, "bsd", "bsd(?: style)? licen[cs]e", "new bsd license", "modified bsd license", "simplified bsd license")
    # Passages of the licenses themselves.
    add(2, 92, "mit", "permission is hereby granted free of charge to any person obtaining a copy", "to deal in the software without restriction including without limitation the rights", "the above copyright notice and this permission notice shall be included in all copies", "in no event shall the authors or copyright holders be liable for any claim", "whether in an action of contract tort or otherwise arising from out of or in connection with the software")
    add(2, 92, "isc", "permission to use copy modify and or distribute this software for any purpose", "provided that the above copyright notice and this permission notice appear in all copies", "the author disclaims all warranties with regard to this software")
    add(2, 90, "bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice", "neither the name of the copyright holder nor the names of its contributors may be used", "this software is provided by the copyright holders and contributors as is")
    add(1, 93, "bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement")
    add(2, 92, "zlib", "this software is provided as is without any express or implied warranty in no event", "altered source versions must be plainly marked as such and must not be misrepresented")
    add(2, 90, "unlicense", "this is free and unencumbered software released into the public domain", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate")
    add(2, 90, "wtfpl", "do what the fuck you want to public license", "wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document")
    add(2, 93, "apache", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual", "worldwide non exclusive no charge royalty free irrevocable copyright license", "worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license", "you may obtain a copy of the license at", "unless required by applicable law or agreed to in writing software distributed under the license", "distributed on an as is basis without warranties or conditions of any kind")
    add(2, 93, "gpl", "this program is free software you can redistribute it and or modify it", "free software foundation either version [123]", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "you should have received a copy of the gnu general public license along with", "this program is distributed in the hope that it will be useful but without any warranty", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", "the licenses for most software are designed to take away your freedom to share and change it", "you may convey verbatim copies of the program s source code", "the gnu general public license is a free copyleft license", "gplv[123](?: or later)?", "gpl [123](?: 0)? or later", "gnu gpl(?: v| version)? ?[123]?")
    add(1, 94, "lgpl", "this library is free software you can redistribute it and or modify it", "you should have received a copy of the gnu lesser general public license along with", "gnu lgpl(?: v| version)? ?[23]?")
    add(1, 94, "agpl", "remote network interaction use with the gnu general public license", "you should have received a copy of the gnu affero general public license along with", "gnu agpl(?: v| version)? ?3?")
    add(2, 93, "mpl", "this source code form is subject to the terms of the mozilla public license", "the contents of this file are subject to the mozilla public license", "incompatible with secondary licenses")
    add(2, 92, "epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "the accompanying program is provided under the terms of this eclipse public license")
    add(2, 92, "cddl", "the contents of this file are subject to the terms of the common development and distribution license", "cddl(?: v| version)? 1 [01]", "cddl v1 [01]")
    add(2, 92, "artistic", "perl artistic license", "the same terms as perl itself")
    add(2, 92, "ofl", "this font software is licensed under the sil open font license", "neither the font software nor any of its individual components in original or modified versions may be sold by itself", "with reserved font name")
    add(2, 91, "bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy", "must be included in all copies of the software in whole or in part and all derivative works", "distributed under the boost software license")
    add(2, 91, "python", "psf hereby grants licensee a nonexclusive royalty free", "psf license agreement for python", "beopen com license agreement for python", "cnri license agreement for python")
    add(2, 91, "php", "products derived from this software may not be called php nor may php appear without prior written permission", "this product includes php software freely available from")
    add(2, 91, "openssl", "this product includes software developed by the openssl project", "the names openssl toolkit and openssl project must not be used without prior written permission", "this product includes cryptographic software written by eric young")
    add(2, 91, "x11", "permission to use copy modify distribute and sell this software and its documentation for any purpose", "except as contained in this notice the name of the x consortium shall not be used in advertising")
    add(2, 90, "ncsa", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers", "the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission")
    add(2, 90, "w3c", "permission to copy modify and distribute this work with or without modification for any purpose and without fee", "liability trademark and document use rules")
    add(2, 90, "ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", "if you distribute any portion of the software in source code form you may do so only under this license")
    add(2, 90, "sspl", "if you make the functionality of the program or a modified version available to third parties as a service", "sspl(?: v| version)? 1", "sspl v1")
    add(2, 90, "busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "change license", "additional use grant")
    add(2, 90, "elastic", "you may not provide the software to third parties as a hosted or managed service", "elastic license")
    add(2, 90, "cc0", "the person who associated a work with this deed has dedicated the work to the public domain", "to the extent possible under law the author has waived all copyright and related", "no copyright has been asserted", "creative commons zero")
    add(2, 89, "cc-by", "this work is licensed under a creative commons attribution", "creative commons attribution international public license", "you must give appropriate credit provide a link to the license and indicate if changes were made")
    add(2, 89, "cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license", "share alike license", "sharealike license")
    add(2, 89, "cc-by-nc", "you may not use the material for commercial purposes")
    add(2, 89, "cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material")
    add(2, 89, "gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "with no invariant sections no front cover texts and no back cover texts")
    add(2, 88, "odbl", "this database is made available under the open database license", "any rights in individual contents of the database are licensed under the database contents license")
    add(2, 88, "llama", "llama(?: [234])? community license")
    add(2, 88, "openrail", "(?:bigscience |creativeml )?open rail m license", "bigscience rail license")
    add(2, 88, "beerware", "beerware license", "beer ware license")
    add(2, 88, "json", "the software shall be used for good not evil")
    add(2, 88, "postgresql", "postgresql license")
    add(2, 88, "vim", "vim license", "vim charityware license")
    add(2, 88, "hpnd", "historical permission notice and disclaimer")
    add(2, 88, "eupl", "licensed under the eupl(?: v| version)? ?1 [012]")
    add(2, 88, "cecill", "cecill(?: b| c)? (?:free software )?license")
    add(2, 88, "mulan", "mulan psl(?: v)? ?2", "mulan permissive software license")
    add(2, 88, "upl", "universal permissive license")
    add(2, 88, "blueoak", "blue oak model license")
    add(2, 88, "anti-996", "anti 996 license")
    add(2, 88, "polyform", "polyform (?:noncommercial|shield|strict|perimeter|small business) license")
    add(2, 88, "commons-clause", "commons clause license condition", "commons clause")
    add(2, 88, "open-government", "open government licen[cs]e")
    add(3, 75, "warranty-disclaimer", "without warrant(?:y|ies) of any kind", "without warranties or conditions of any kind", "without any warranty", "the software is provided as is", "there is no warranty for the program to the extent permitted by applicable law", "the entire risk as to the quality and performance of the program is with you", "including but not limited to the (?:implied )?warranties of merchantability", "any express or implied warranties", "disclaims? (?:all|any) (?:implied )?warrant(?:y|ies)", "disclaimer of warranty")
    add(3, 75, "liability-limit", "limitation of liability", "in no event shall the author(?:s)? be liable", "in no event will any copyright holder be liable", "shall not be liable for any (?:direct|indirect|incidental|special|consequential) damages", "even if advised of the possibility of such damage")
    # Ownership and restrictions.
    add(4, 80, "public-domain", "public domain", "dedicated to the public domain", "released into the public domain", "placed in the public domain")
    add(4, 70, "copyright", r"copyright (?:c )?(?:19|20)\d\d", r"copyright c", r"copyrighted (?:material|work)", "copyright holder", "copyright owner", "copyright infringement", "copyright notice", "protected by copyright", "under copyright")
    add(4, 70, "trademark", "registered trademarks? of", "are trademarks? of their respective owners", "is a (?:registered )?trademark of")
    add(4, 70, "copyleft", "copyleft", "strong copyleft", "weak copyleft")
    add(3, 80, "reserved", "some rights reserved", "no rights reserved", "all rights are reserved", "moral rights (?:have been|are) asserted")
    add(4, 75, "proprietary", "proprietary and confidential", "confidential and proprietary", "may not be reproduced", "not for redistribution", "redistribution is prohibited", "redistribution prohibited", "unauthorized copying", "unauthorized (?:use|reproduction|distribution)", "no part of this (?:publication|work|document|book) may be reproduced", "permission is required", "with permission of the copyright (?:holder|owner)", "by permission of the copyright (?:holder|owner)", "without (?:the )?(?:express |prior )?written permission", "reproduced with permission", "used (?:here )?with permission", "reprinted by permission", "strictly prohibited without permission", "proprietary information of", "trade secrets? and confidential")
    add(4, 75, "noncommercial", "for non ?commercial use only", "non commercial use only", "noncommercial use only", "for personal use only", "for research use only", "noncommercial purposes only", "for educational use only", "for internal use only", "for evaluation use only", "for editorial use only", "not for commercial use")
    add(4, 72, "dual-license", "dual licen[cs]ed?", "dual licensing", "triple licensed", "commercial license")
    add(4, 72, "or-later", "at your option any later version")
    add(5, 50, "unspecified", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:[^ ]+ ){0,5}?licen[cs]e", "licensed under", "license agreement", "end user license agreement", "this license", "open source license", "free license", "licence agreement", "subject to license", "under license from", "license terms", "license file", "see license", "licensed to", "software license", "license fee", "license key", "license header", "license text", "permissive license", "free software license", "public license", "royalty free")
    # The order of rules decides between equal intervals. A rule that begins with alternatives is tried at each of them.
    spread = [(p, sure, first, pattern, label) for p, sure, _, pattern, label in rules for first in keywords(pattern)]
    return [(i, *rule) for i, rule in enumerate(spread)]


def keywords(pattern: str) -> list[str]:
    """The words that a pattern may begin with."""
    group = re.match(r"\(\?:([^()]*)\)(\??)", pattern)
    if group:
        rest = pattern[group.end() :]
        found = [w for alternative in group.group(1).split("|") for w in ([alternative.strip().split(" ")[0]] if alternative.strip() else [])]
        if not group.group(1).endswith(" ") and not group.group(2) and not rest.startswith((" ", ")")):
            found = [w + tail for w in found for tail in keywords(rest)]
        return found + (keywords(rest) if group.group(2) else [])
    word = pattern.split(" ")[0]
    options = [word]
    while any("(?:" in o or re.search(r"\?|\[", o) for o in options):
        grown = []
        for o in options:
            if m := re.search(r"\(\?:([^()]*)\)\?", o):
                grown += [o[: m.start()] + x + o[m.end() :] for x in ("", *m.group(1).split("|"))]
            elif m := re.search(r"\(\?:([^()]*)\)", o):
                grown += [o[: m.start()] + x + o[m.end() :] for x in m.group(1).split("|")]
            elif m := re.search(r"\[([a-z0-9]+)\]", o):
                grown += [o[: m.start()] + x + o[m.end() :] for x in m.group(1)]
            elif m := re.search(r"([a-z])\?", o):
                grown += [o[: m.start()] + x + o[m.end() :] for x in ("", m.group(1))]
            elif "(?:" in o:  # an option that goes on behind the word
                grown.append(o.split("(?:")[0])
            else:
                grown.append(o.replace("?", ""))
        options = list(dict.fromkeys(grown))
    return options


def rules_table(spark: SparkSession) -> DataFrame:
    """The rules as a table of some hundred rows: small by construction, so it may be broadcast."""
    rows = [(rule, priority, sure, keyword, rf"^(?:{pattern})(?= |$)", label, False) for rule, priority, sure, keyword, pattern, label in signature_rules()]
    rows += [(10_000 + i, 0, 100, phrase.split(" ")[0], rf"^{phrase}(?= |$)", label, True) for i, (phrase, label) in enumerate(BASE)]
    return spark.createDataFrame(rows, "rule int, priority int, sure int, keyword string, pattern string, label string, base boolean")


def gate(text: Column) -> Column:
    """Whether a lower-cased text may match anything: plain searches for stems, and expressions only where a stem asks for them."""
    any_of = lambda tests: reduce(lambda x, y: x | y, tests)
    sure = any_of([F.contains(text, F.lit(s)) for s in STEMS])
    return sure | any_of([F.contains(text, F.lit(stem)) & text.rlike(pattern) for stem, pattern in MAYBE.items()])


def detections(docs: DataFrame, text_col: str = "text", row_col: str = "row") -> DataFrame:
    """(row, start, end, label, priority, sure, base) of what stays after suppression; words are counted from 0, end is exclusive."""
    rules = rules_table(docs.sparkSession)
    keywords = F.lit(sorted({x[3] for x in signature_rules()} | {p.split(" ")[0] for p, _ in BASE}))
    gated = docs.where(F.col(text_col).isNotNull() & gate(byte_text(F.col(text_col)))).select(F.col(row_col).alias("row"), words_of(F.col(text_col)).alias("w"))
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_contains(keywords, F.get("w", i)))
    places = gated.where(F.size("w") > 0).select("row", F.explode(F.transform(at, lambda i: F.struct(i.alias("start"), F.get("w", i).alias("keyword"), F.array_join(F.slice("w", i + 1, HORIZON), " ").alias("near")))).alias("p")).select("row", "p.*")
    tried = places.join(F.broadcast(rules), "keyword").withColumn("match", F.expr("regexp_extract(near, pattern, 0)")).where("match <> ''")
    found = save(tried.select("row", "start", (F.col("start") + F.size(F.split("match", " "))).alias("end"), "rule", "label", "priority", "sure", "base"), "license-hits")
    # Whatever contains an interval begins no later and reaches at least as far, and comes first in the order of starts, the
    # longer first; so one running maximum of ends for each priority tells of containment. An overlap is an earlier start that reaches
    # beyond this one's, or a next start before this one's end.
    order = Window.partitionBy("row").orderBy("start", F.col("end").desc(), "priority", "rule")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    grades = range(1, max(x[1] for x in signature_rules()) + 1)
    at = lambda p: F.col("priority") <= p
    swept = found.where("not base").withColumns({f"end{p}": F.max(F.when(at(p), F.col("end"))).over(before) for p in grades} | {f"start{p}": F.min(F.when(at(p), F.col("start"))).over(after) for p in grades})
    of = lambda name, less: reduce(lambda c, p: c.when(F.col("priority") == p, F.col(f"{name}{p - less}") if p > less else F.lit(None)), grades, F.when(F.lit(False), None))
    contained = F.coalesce(of("end", 0) >= F.col("end"), F.lit(False))
    crossed = F.coalesce(of("end", 1) > F.col("start"), F.lit(False)) | F.coalesce(of("start", 1) < F.col("end"), F.lit(False))
    columns = ["row", "start", "end", "label", "priority", "sure", "base"]
    return swept.where(~contained & ~crossed).select(*columns).union(found.where("base").select(*columns))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without their text, with n_words, n_base, first_word, last_word, base_labels, labels, score (the surest detection's)."""
    rest = kept_columns(docs, text_col, *MADE)
    text = column(text_col)
    count = F.regexp_count(F.coalesce(byte_text(text), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long")
    rows = save(docs.select(F.monotonically_increasing_id().alias("row"), *[column(c).alias(f"k{i}") for i, c in enumerate(rest)], count.alias("n_words"), F.when(gate(byte_text(text)), text).alias("gated")), "license-rows")
    hits = detections(rows.where("gated is not null"), "gated")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.when(F.col("base"), F.col("start"))
    per = hits.groupBy("row").agg(F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"), joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), (F.max("sure") / F.lit(100.0)).alias("score"))
    found = rows.drop("gated").join(per, "row", "left").fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0})
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(rest)], *MADE)
