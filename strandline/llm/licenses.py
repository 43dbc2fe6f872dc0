"""License scans by ordered signature rules, in DataFrame expressions only.

A text is reduced to its words. Rules are regular expressions over those words, made for each license
family in order of how much they say. A row is looked at only if it holds a stem that every rule needs,
and a rule only runs on a row that holds the rule's own keyword. Detections are intervals of words; one
that lies inside another of higher priority, or of equal priority and longer, is suppressed. All of it
happens inside the row, so a scan needs no shuffle.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names under which licenses are known. Each entry: label, keyword, names over lower-case words.
# Every text that one of the names matches holds the keyword. Order of names settles ties.
FAMILIES: list[tuple[str, str, list[str]]] = [
    ("mit", "mit", [r"mit license", r"mit licence", r"mit x11 license", r"x11 mit license"]),
    ("mit", "expat", [r"expat license"]),
    ("apache", "apache", [r"apache license", r"apache licence", r"apache software license"]),
    ("apache", "asl 2 0", [r"asl 2 0"]),
    ("apache", "apache", [r"apache 2 0"]),
    ("gpl", "general public", [r"general public license", r"gnu general public license", r"gnu general public licence"]),
    ("gpl", "gpl", [r"gnu gpl", r"gplv[123]", r"gpl v[123]", r"gpl [123] 0"]),
    ("lgpl", "lesser", [r"gnu lesser general public license", r"lesser general public license"]),
    ("lgpl", "library general", [r"gnu library general public license", r"library general public license"]),
    ("lgpl", "lgpl", [r"gnu lgpl", r"lgplv?[23](?: 1)?", r"lgpl v[23]"]),
    ("agpl", "affero", [r"gnu affero general public license", r"affero general public license"]),
    ("agpl", "agpl", [r"gnu agpl", r"agplv?3", r"agpl v3"]),
    ("bsd", "bsd", [r"bsd license", r"bsd licence", r"[234] clause bsd(?: license)?", r"bsd [0234] clause(?: license)?", r"new bsd license", r"modified bsd license", r"simplified bsd license", r"free bsd license"]),
    ("isc", "isc", [r"isc license", r"isc licence"]),
    ("isc", "internet systems consortium", [r"internet systems consortium license"]),
    ("mpl", "mozilla", [r"mozilla public license", r"mozilla public licence"]),
    ("mpl", "mpl", [r"mplv?[12](?: [01])?", r"mpl v2"]),
    ("epl", "eclipse", [r"eclipse public license", r"eclipse distribution license"]),
    ("cddl", "development and distribution", [r"common development and distribution license"]),
    ("cpl", "common public", [r"common public license", r"common public attribution license"]),
    ("eupl", "european union", [r"european union public licen[cs]e"]),
    ("cecill", "cecill", [r"cecill(?: [abc])?(?: free software)? license", r"licence cecill"]),
    ("zlib", "zlib", [r"zlib license", r"zlib libpng license"]),
    ("libpng", "libpng", [r"libpng license"]),
    ("boost", "boost", [r"boost software license", r"boost license"]),
    ("artistic", "artistic", [r"artistic license", r"perl artistic license", r"clarified artistic license"]),
    ("psf", "python", [r"python software foundation license", r"python license"]),
    ("php", "php", [r"php license"]),
    ("ruby", "ruby", [r"ruby license"]),
    ("postgresql", "postgresql", [r"postgresql licen[cs]e"]),
    ("openssl", "openssl", [r"openssl license", r"openssl ssleay license"]),
    ("ofl", "open font", [r"sil open font license", r"open font license"]),
    ("unlicense", "unlicense", [r"the unlicense", r"unlicense"]),
    ("wtfpl", "what the", [r"do what the \w+ you want to public license"]),
    ("ms-pl", "microsoft", [r"microsoft public license", r"microsoft reciprocal license"]),
    ("osl", "open software", [r"open software license"]),
    ("afl", "academic", [r"academic free license"]),
    ("ncsa", "ncsa", [r"university of illinois ncsa open source license", r"ncsa open source license"]),
    ("w3c", "w3c", [r"w3c software(?: notice and)? license", r"w3c document license"]),
    ("odbl", "open database", [r"open database license", r"open data commons open database license"]),
    ("pddl", "public domain dedication", [r"public domain dedication and license", r"cc0 public domain dedication"]),
    ("cc0", "cc0", [r"cc0 license"]),
    ("cc0", "creative commons zero", [r"creative commons zero(?: license)?"]),
    ("cc0", "cc0", [r"cc0 1 0(?: universal)?"]),
    ("cc-by", "creative commons", [r"creative commons attribution license", r"creative commons attribution [1234] [05](?: international| unported)?(?: license)?"]),
    ("cc-by", "cc by", [r"cc by license"]),
    ("cc-by-sa", "creative commons", [r"creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported)?(?: license)?"]),
    ("cc-by-nc", "creative commons", [r"creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported)?(?: license)?"]),
    ("cc-by-nd", "creative commons", [r"creative commons attribution no ?deriv(?:s|atives)(?: [1234] [05])?(?: international| unported)?(?: license)?"]),
    ("cc", "creative commons", [r"creative commons license", r"creative commons licence"]),
    ("gfdl", "free documentation", [r"gnu free documentation license", r"free documentation license"]),
    ("ogl", "open government", [r"open government licen[cs]e"]),
    ("ijg", "independent jpeg", [r"independent jpeg group license"]),
    ("ftl", "freetype", [r"freetype license", r"freetype project license"]),
    ("vim", "vim", [r"vim license"]),
    ("curl", "curl", [r"curl license"]),
    ("beerware", "beer", [r"beer ?ware license"]),
    ("zpl", "zope", [r"zope public license"]),
    ("sleepycat", "sleepycat", [r"sleepycat license"]),
    ("qpl", "q public", [r"q public license"]),
    ("nasa", "nasa", [r"nasa open source agreement license", r"nasa open source license"]),
    ("blueoak", "blue oak", [r"blue oak model license"]),
    ("mulan", "mulan", [r"mulan permissive software license", r"mulan public license"]),
    ("sspl", "server side", [r"server side public license"]),
    ("busl", "business source", [r"business source license"]),
    ("elastic", "elastic", [r"elastic license"]),
    ("polyform", "polyform", [r"polyform (?:non ?commercial|small business|strict|shield) license"]),
    ("rail", "responsible ai", [r"responsible ai license"]),
    ("rail", "rail", [r"open ?rail m? ?license"]),
]
# Sentences that a notice puts around a name, from the most to the least telling. Priority, confidence, pattern.
NOTICES: list[tuple[int, float, str]] = [
    (4, 1.0, r"(?:licensed|released|distributed|published|available|provided|made available) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:a |an )?{name}(?:,? ?(?:version|v) ?\d+(?: \d+)*)?"),
    (3, 0.95, r"{name} (?:version|v) ?\d+(?: \d+)*(?: or (?:any )?later(?: version)?)?"),
    (2, 0.9, r"(?:the )?{name} (?:applies|text|terms|agreement|file|header|notice|conditions)"),
    (1, 0.8, r"{name}"),
]
# Phrases of license texts and rights notices that stand alone. Label, keyword, priority, confidence, pattern.
PHRASES: list[tuple[str, str, int, float, str]] = [
    ("mit", "permission is hereby granted", 5, 1.0, r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "sublicense", 4, 0.95, r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "this permission notice shall be included", 5, 0.95, r"(?:the above copyright notice and )?this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "mit licensed", 2, 0.8, r"mit licensed"),
    ("bsd", "redistribution and use", 5, 1.0, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source", 4, 0.9, r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form", 4, 0.9, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "without specific prior written permission", 4, 0.9, r"(?:may not be used )?to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "bsd style", 2, 0.8, r"bsd style (?:license|licence)"),
    ("bsd", "bsd licensed", 2, 0.8, r"bsd licensed"),
    ("isc", "permission to use", 5, 0.95, r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc", "provided that the above copyright notice and this permission", 4, 0.9, r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("hpnd", "permission to use", 4, 0.85, r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("ntp", "permission to use", 4, 0.85, r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee"),
    ("apache", "you may not use this file", 5, 1.0, r"you may not use this file except in compliance with the license"),
    ("apache", "you may obtain a copy of the license", 4, 0.95, r"you may obtain a copy of the license at"),
    ("apache", "contributor license", 3, 0.8, r"(?:one or more )?contributor license agreements"),
    ("apache", "to you under the apache", 5, 1.0, r"licenses this file to you under the apache"),
    ("apache", "governing permissions and limitations", 4, 0.9, r"specific language governing permissions and limitations under the license"),
    ("apache", "apache licensed", 2, 0.8, r"apache licensed"),
    ("gpl", "redistribute it and or modify", 5, 0.95, r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "copy of the gnu general public", 4, 0.95, r"you should have received a copy of the gnu general public license"),
    ("gpl", "everyone is permitted to copy and distribute verbatim", 4, 0.9, r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", "gpl licensed", 2, 0.8, r"gpl licensed"),
    ("gpl", "gpl compatible", 1, 0.6, r"gpl compatible"),
    ("lgpl", "redistribute it and or modify", 5, 0.95, r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "copy of the gnu lesser", 4, 0.95, r"you should have received a copy of the gnu lesser general public license"),
    ("lgpl", "lgpl licensed", 2, 0.8, r"lgpl licensed"),
    ("agpl", "redistribute it and or modify", 5, 0.95, r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl", "copy of the gnu affero", 4, 0.95, r"you should have received a copy of the gnu affero general public license"),
    ("agpl", "agpl licensed", 2, 0.8, r"agpl licensed"),
    ("mpl", "this source code form is subject", 5, 1.0, r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "incompatible with secondary licenses", 4, 0.9, r"incompatible with secondary licenses"),
    ("mpl", "mpl licensed", 2, 0.8, r"mpl licensed"),
    ("epl", "made available under the terms of the eclipse", 5, 1.0, r"(?:this program and the accompanying materials are )?made available under the terms of the eclipse public license"),
    ("epl", "spdx license identifier epl", 5, 1.0, r"spdx license identifier epl \d 0"),
    ("cddl", "subject to the terms of the common development", 5, 1.0, r"subject to the terms of the common development and distribution license"),
    ("cpl", "subject to the terms of the common public", 5, 1.0, r"subject to the terms of the common public license"),
    ("eupl", "licensed under the eupl", 5, 1.0, r"licensed under the eupl(?: version \d+ \d+)?"),
    ("cecill", "governed by the cecill", 5, 1.0, r"governed by the cecill(?: [abc])? license"),
    ("zlib", "altered source versions", 5, 1.0, r"altered source versions must be plainly marked as such"),
    ("zlib", "permission is granted to anyone to use this software", 5, 0.95, r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("boost", "distributed under the boost", 5, 1.0, r"distributed under the boost software license"),
    ("boost", "person or organization obtaining a copy", 5, 0.95, r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("artistic", "same terms as perl", 4, 0.9, r"(?:licensed |available |redistributed )?under the same terms as perl(?: itself)?(?: license)?"),
    ("psf", "psf license agreement", 5, 1.0, r"psf license agreement(?: for python)?"),
    ("psf", "python software foundation", 2, 0.7, r"licensed to the python software foundation"),
    ("php", "subject to version", 4, 0.9, r"subject to version \d(?: \d+)? of the php license"),
    ("unlicense", "released into the public domain", 5, 0.95, r"free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify", 4, 0.9, r"anyone is free to copy modify publish use compile sell or distribute this software(?: for any purpose)?"),
    ("wtfpl", "wtfpl", 4, 0.9, r"wtfpl(?: license)?"),
    ("ofl", "this font software is licensed", 5, 1.0, r"this font software is licensed under the sil open font license"),
    ("ofl", "reserved font name", 3, 0.8, r"(?:with )?reserved font names?"),
    ("ms-pl", "this license governs use", 4, 0.9, r"this license governs use of the accompanying software"),
    ("ms-eula", "microsoft software license terms", 4, 0.9, r"microsoft software license terms"),
    ("eula", "end user licen", 3, 0.8, r"end user licen[cs]e agreement"),
    ("eula", "by installing", 2, 0.7, r"by installing (?:copying or otherwise using )?(?:the|this) software you agree to be bound by the terms of this licen[cs]e"),
    ("cc0", "waived all copyright", 5, 0.95, r"(?:has )?waived all copyright and related or neighbou?ring rights(?: to this work)?"),
    ("cc0", "no rights reserved", 2, 0.8, r"no rights reserved"),
    ("cc-by", "cc by", 3, 0.9, r"cc by [1234] [05]"),
    ("cc-by-sa", "cc by sa", 4, 0.9, r"cc by sa(?: [1234] [05])?"),
    ("cc-by-nc", "cc by nc", 4, 0.9, r"cc by nc(?: [1234] [05])?"),
    ("cc-by-nd", "cc by nd", 4, 0.9, r"cc by nd(?: [1234] [05])?"),
    ("cc-by-nc-sa", "cc by nc sa", 5, 0.95, r"cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-nd", "cc by nc nd", 5, 0.95, r"cc by nc nd(?: [1234] [05])?"),
    ("cc-by", "licensed under a creative commons", 4, 0.95, r"(?:this work is )?licensed under a creative commons attribution(?: [1234] [05])?(?: international| unported)? licen[cs]e"),
    ("cc-by-sa", "share alike", 3, 0.85, r"creative commons share alike(?: license)?"),
    ("gfdl", "permission is granted to copy distribute", 5, 0.95, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "no invariant sections", 3, 0.85, r"with no invariant sections"),
    ("odbl", "odbl", 3, 0.85, r"odbl(?: license)?"),
    ("ogl", "contains public sector information licensed", 5, 1.0, r"contains public sector information licensed under the open government licen[cs]e"),
    ("busl", "change license", 3, 0.8, r"change license(?: means)?"),
    ("elastic", "dual licensed under the elastic", 4, 0.9, r"dual licensed under the elastic license"),
    ("sspl", "sspl", 3, 0.85, r"sspl(?: license)?"),
    ("llama", "llama", 4, 0.9, r"llama \d(?: \d)? community license(?: agreement)?"),
    ("rail", "use based restrictions", 3, 0.8, r"use based restrictions (?:as )?(?:referenced|set forth) in (?:paragraph \d+|attachment a)"),
    ("public-domain", "public domain", 1, 0.7, r"(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", 1, 0.7, r"(?:this|the) (?:work|file|software|document|text) is in the public domain"),
    ("public-domain", "public domain mark", 2, 0.8, r"public domain mark(?: 1 0)?"),
    ("dual", "dual licensed", 2, 0.7, r"dual licensed under"),
    ("dual", "at your option", 2, 0.7, r"(?:either )?licen[cs]e at your option"),
    ("spdx", "spdx", 2, 0.9, r"spdx license identifier \w+(?: \d+)*"),
    ("all-permissive", "are permitted in any medium", 4, 0.9, r"copying and distribution of this file with or without modification are permitted in any medium"),
    ("non-commercial", "non commercial", 2, 0.7, r"licensed for (?:personal )?non commercial use(?: only)?"),
    ("no-license", "no license is granted", 2, 0.7, r"no license is granted"),
    ("proprietary", "all rights reserved", 1, 0.5, r"all rights reserved"),
    ("proprietary", "may not be reproduced", 2, 0.7, r"may not be reproduced (?:or (?:distributed|transmitted) )?(?:in whole or in part )?without (?:the )?(?:prior )?(?:express )?(?:written )?permission"),
    ("proprietary", "reproduction in whole or in part", 2, 0.7, r"reproduction in whole or in part without (?:written )?permission is prohibited"),
    ("proprietary", "confidential and proprietary", 1, 0.5, r"confidential and proprietary"),
    ("proprietary", "unauthorized copying", 2, 0.7, r"unauthorized copying of this file(?: via any medium)? is strictly prohibited"),
]
#: Words one of which stands in every text that any rule can match.
STEMS = ["licen", "mit", "apache", "gpl", "permission", "redistribut", "public domain", "rights reserved", "altered source", "sublicense", "you may not use", "spdx", "cc0", "bsd", "asl 2", "mpl", "creative commons", "openrail", "verbatim", "same terms as perl", "anyone is free", "reserved font name", "waived all", "no rights", "cc by", "invariant sections", "odbl", "sspl", "wtfpl", "use based restrictions", "are permitted", "may not be reproduced", "confidential and", "unauthorized copying"]
#: Base phrases and their labels.
BASE: list[tuple[str, str]] = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Priorities run from 1 to this.
LEVELS = 5
#: Characters between words, A-Z counting as word characters.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def rules() -> list[tuple[str, str, int, float, str]]:
    """All rules in order of priority: label, keyword, priority, confidence, pattern over words parted by single blanks."""
    out = list(PHRASES)
    for label, keyword, names in FAMILIES:
        for priority, confidence, notice in NOTICES:
            out += [(label, keyword, priority, confidence, notice.replace("{name}", name)) for name in names]
    return sorted(out, key=lambda r: -r[2])


def _words(x: str) -> str:
    """SQL for the number of words of a string of words parted by single blanks."""
    return f"if(trim({x}) = '', 0, length(trim({x})) - length(replace(trim({x}), ' ', '')) + 1)"


#: Matches of a rule, or of a text, that are summed up together: sums up to a match are those of whole blocks and of a part of its own.
_BLOCK = 64


def _block_start(k: str) -> str:
    """SQL for the place (from 1) of the first match in the block of match k (from 0)."""
    return f"cast(({k} div {_BLOCK}) * {_BLOCK} as int) + 1"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bound(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row, however often later expressions read them."""
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", row.alias("_row")).select(*df.columns, *[F.col(f"_row.{n}").alias(n) for n in columns])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased; a null text has none.
    Base places are where a base phrase's words stand consecutively; they are never suppressed. detections
    are what suppression leaves (first word, word after the last, priority, rule, label, confidence); score is the
    highest confidence among them, 0 if there are none. Repeated rows give repeated rows.
    """
    spaced = F.regexp_replace(F.concat(F.lit(" "), F.coalesce(F.col(text), F.lit("")), F.lit(" ")), _GAP, " ")
    rows = _bound(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), spaced_once=spaced).drop("text")
    rows = _bound(rows, lowered=F.lower("spaced_once"))
    gate = F.lit(False)
    for stem in STEMS:
        gate = gate | F.col("lowered").contains(stem)
    # words are parted, preceded and followed by one blank each
    blanks = F.octet_length("spaced_once") - F.octet_length(F.replace("spaced_once", F.lit(" "), F.lit("")))
    rows = _bound(rows, n_words=(blanks - 1).cast("long"), gated=gate).drop("lowered")
    # only rows that pass are lower-cased as asked (A-Z alone) and scanned
    rows = _bound(rows, words=F.when(F.col("gated"), F.translate("spaced_once", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).drop("spaced_once", "gated")
    base = "(?<= )(?:" + "|".join(p for p, _ in BASE) + ")(?= )"
    rows = _bound(rows, found=F.when(F.col("words").rlike(base), F.expr(f"regexp_extract_all(words, {_quoted(base)}, 0)")), between=F.when(F.col("words").rlike(base), F.split("words", base, -1)))
    one = lambda c: F.expr(_words(c)).cast("long")
    rows = rows.withColumns({
        "n_base": F.coalesce(F.size("found"), F.lit(0)).cast("long"),
        "first_word": F.when(F.col("found").isNotNull(), one("between[0]")),
        "last_word": F.when(F.col("found").isNotNull(), F.col("n_words") - one("element_at(between, -1)") - one("element_at(found, -1)")),
        "base": F.coalesce(F.array_compact(F.array(*[F.when(F.array_contains("found", p), F.lit(label)) for p, label in BASE])), F.array().cast("array<string>")),
    })
    listed = [{"rule": i, "label": label, "keyword": keyword, "priority": priority, "confidence": confidence, "pattern": f"(?<= )(?:{pattern})(?= )"} for i, (label, keyword, priority, confidence, pattern) in enumerate(rules())]
    table = F.from_json(F.lit(json.dumps(listed)), "array<struct<rule:int,label:string,keyword:string,priority:int,confidence:double,pattern:string>>")
    rows = _bound(rows, picked=F.when(F.col("words").isNotNull(), F.filter(table, lambda r: F.contains("words", r["keyword"]) & F.regexp_like("words", r["pattern"]))))
    added = "(a, x) -> a + x"
    # words before a match: those of the blocks of matches before its own, and of the matches before it in its block
    place = f"offs[k div {_BLOCK}] + aggregate(slice(steps, {_block_start('k')}, k % {_BLOCK}), 0, {added}) + c.w[k]"
    places = f"""flatten(transform(coalesce(picked, array()), r ->
        flatten(transform(array(named_struct('m', regexp_extract_all(words, r.pattern, 0), 'p', split(words, r.pattern, -1))), b ->
        flatten(transform(array(named_struct('v', transform(b.m, x -> {_words('x')}), 'w', transform(slice(b.p, 1, size(b.m)), x -> {_words('x')}))), c ->
        flatten(transform(array(zip_with(c.v, c.w, (x, y) -> x + y)), steps ->
        flatten(transform(array(transform(sequence(0, (size(steps) - 1) div {_BLOCK}), i -> aggregate(slice(steps, cast(i * {_BLOCK} as int) + 1, {_BLOCK}), 0, {added}))), sums ->
        flatten(transform(array(transform(sums, (x, i) -> aggregate(slice(sums, 1, i), 0, {added}))), offs ->
          zip_with(transform(c.v, (v, k) -> {place}), c.v, (f, v) -> named_struct('first', f, 'after', f + v, 'priority', r.priority, 'rule', r.rule, 'label', r.label, 'confidence', r.confidence))))))))))))))"""
    rows = _bound(rows, places=F.when(F.size(F.coalesce("picked", F.array())) > 0, F.expr(places)))
    order = "(x, y) -> case when x.first <> y.first then x.first - y.first when x.after <> y.after then y.after - x.after when x.priority <> y.priority then y.priority - x.priority else x.rule - y.rule end"
    rows = _bound(rows, placed=F.expr(f"array_sort(places, {order})"))
    # a match is left unless one before it, of its priority or a higher one, reaches as far
    levels = "array(" + ", ".join(map(str, range(1, LEVELS + 1))) + ")"
    farthest = lambda list_, level: f"coalesce(array_max(transform(filter({list_}, y -> y.priority >= {level}), y -> y.after)), -1)"
    rows = _bound(rows, blocks=F.expr(f"transform(sequence(0, (size(placed) - 1) div {_BLOCK}), i -> transform({levels}, p -> {farthest(f'slice(placed, cast(i * {_BLOCK} as int) + 1, {_BLOCK})', 'p')}))"))
    rows = _bound(rows, reach=F.expr(f"transform(blocks, (x, i) -> transform({levels}, p -> coalesce(array_max(transform(slice(blocks, 1, i), t -> t[p - 1])), -1)))"))
    before = farthest(f"slice(placed, {_block_start('k')}, k % {_BLOCK})", "x.priority")
    left = F.expr(f"filter(placed, (x, k) -> greatest(reach[k div {_BLOCK}][x.priority - 1], {before}) < x.after)")
    kind = "array<struct<first:int,after:int,priority:int,rule:int,label:string,confidence:double>>"
    rows = _bound(rows, detections=F.when(F.col("placed").isNotNull(), left).otherwise(F.expr(f"cast(array() as {kind})")))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return rows.select(F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(F.concat("base", F.transform("detections", lambda d: d["label"]))).alias("labels"), F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"), "detections")


def brute_force(text: str | None) -> dict:
    """The same for one text in plain Python, for tests."""
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(table))
    line = " " + " ".join(words) + " "
    places = []
    for phrase, label in BASE:
        parts = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(parts)] == parts]
    found = []
    for i, (label, _, priority, confidence, pattern) in enumerate(rules()):
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", line, re.A):
            first = line[: m.start()].count(" ") - 1
            found.append((first, first + len(m[0].split()), priority, i, label, confidence))
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and b[2] >= a[2] and (b[2] > a[2] or (b[0], b[1]) != (a[0], a[1]) or b[3] < a[3])
    kept = [a for a in found if not any(b is not a and inside(a, b) for b in found)]
    return {"n_words": len(words), "n_base": len(places), "first_word": min((k for k, _ in places), default=None), "last_word": max((k for k, _ in places), default=None), "base_labels": ",".join(sorted({x for _, x in places})), "labels": ",".join(sorted({x for _, x in places} | {x[4] for x in kept})), "score": max((x[5] for x in kept), default=0.0)}
