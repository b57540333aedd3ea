"""Op 3: license scans with ordered signature rules, in DataFrame functions only.

Hundreds of regular expressions over a text's words, each gated by a keyword, have a priority: identifiers come first, then clauses of
license texts and names in a frame that grants a license, then names alone. Where detections overlap, one that lies inside another of the
same or a better priority is suppressed. Three base phrases are always counted and labelled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Fixed values of the contract: phrases and labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label | keyword | expression of the license's name over lower-case words joined by single spaces. Each match contains the keyword: a
#: label whose names have no word in common has several rows.
NAMES = r"""
agpl-3.0 | affero | (?:gnu )?affero general public license(?: v(?:ersion)? ?3(?: 0)?| 3(?: 0)?)?
apache-1.1 | apache | apache(?: software)? license(?: v| version| v ersion)? ?1 1
apache-2.0 | apache | apache(?: software)? license(?: v| version)? ?2(?: 0)?
apache | apache | apache(?: software)? license
artistic-1.0 | artistic | artistic license 1(?: 0)?
artistic-2.0 | artistic | artistic license 2(?: 0)?
beerware | beer | beer ?ware license
boost-1.0 | boost | boost software license(?: version)?(?: 1 0)?
bsd-2-clause | bsd | (?:simplified bsd license|bsd 2 clause(?: license)?|two clause bsd license)
bsd-3-clause | bsd | (?:(?:new|modified|revised) bsd license|bsd 3 clause(?: license)?|three clause bsd license)
bsd-4-clause | bsd | (?:original bsd license|bsd 4 clause(?: license)?|four clause bsd license)
bsd | bsd | bsd(?: style)? license
0bsd | bsd | (?:zero clause bsd license|0bsd license)
cc-by-1.0 | cc by | cc by(?: license)? 1 0
cc-by-1.0 | commons | creative commons attribution(?: license)? 1 0
cc-by-2.0 | cc by | cc by(?: license)? 2 0
cc-by-2.0 | commons | creative commons attribution(?: license)? 2 0
cc-by-3.0 | cc by | cc by(?: license)? 3 0
cc-by-3.0 | commons | creative commons attribution(?: license)? 3 0
cc-by-4.0 | cc by | cc by(?: international)?(?: license)? 4 0
cc-by-4.0 | commons | creative commons attribution(?: international)?(?: license)? 4 0
cc-by-sa-3.0 | cc by | cc by sa(?: license)? 3 0
cc-by-sa-3.0 | commons | creative commons attribution sharealike(?: license)? 3 0
cc-by-sa-4.0 | cc by | cc by sa(?: license)? 4 0
cc-by-sa-4.0 | commons | creative commons attribution sharealike(?: license)? 4 0
cc-by-nc-3.0 | cc by | cc by nc(?: license)? 3 0
cc-by-nc-3.0 | commons | creative commons attribution noncommercial(?: license)? 3 0
cc-by-nc-4.0 | cc by | cc by nc(?: license)? 4 0
cc-by-nc-4.0 | commons | creative commons attribution noncommercial(?: license)? 4 0
cc-by-nd-4.0 | cc by | cc by nd(?: license)? 4 0
cc-by-nd-4.0 | commons | creative commons attribution noderivatives(?: license)? 4 0
cc-by-nc-sa-4.0 | cc by | cc by nc sa(?: license)? 4 0
cc-by-nc-sa-4.0 | commons | creative commons attribution noncommercial sharealike(?: license)? 4 0
cc-by-nc-nd-4.0 | cc by | cc by nc nd(?: license)? 4 0
cc-by-nc-nd-4.0 | commons | creative commons attribution noncommercial noderivatives(?: license)? 4 0
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | commons | creative commons zero(?: universal)?
creative-commons | commons | creative commons(?: license)?
cddl-1.0 | distribution | common development and distribution license(?: 1 0)?
cecill-2.1 | cecill | cecill(?: free software)? license(?: agreement)?(?: v?2 1)?
cpl-1.0 | common | common public license(?: 1 0)?
ecl-2.0 | educational | educational community license(?: 2 0)?
epl-1.0 | eclipse | eclipse public license(?: v| version)? ?1(?: 0)?
epl-2.0 | eclipse | eclipse public license(?: v| version)? ?2(?: 0)?
epl | eclipse | eclipse public license
eupl-1.2 | european | european union public licen[cs]e(?: v| version)?(?: ?1 2)?
gfdl-1.3 | documentation | (?:gnu )?free documentation license(?: version 1 [123])?
gpl-1.0 | general | (?:gnu )?general public license(?: v| version)? ?1(?: 0)?
gpl-2.0 | general | (?:gnu )?general public license(?: v| version)? ?2(?: 0)?
gpl-3.0 | general | (?:gnu )?general public license(?: v| version)? ?3(?: 0)?
gpl | general | (?:gnu )?general public license
isc | isc | isc license
lgpl-2.1 | lesser | (?:gnu )?lesser general public license(?: v| version)? ?2 1
lgpl-3.0 | lesser | (?:gnu )?lesser general public license(?: v| version)? ?3(?: 0)?
lgpl | lesser | (?:gnu )?lesser general public license
lgpl-2.0 | library | (?:gnu )?library general public license(?: v| version)?(?: ?2(?: 0)?)?
mit | mit | (?:the )?mit license
mit-0 | mit | mit no attribution(?: license)?
mpl-1.1 | mozilla | mozilla public license(?: v| version)? ?1 1
mpl-2.0 | mozilla | mozilla public license(?: v| version)? ?2(?: 0)?
mpl | mozilla | mozilla public license
ms-pl | microsoft | microsoft public license
ms-rl | microsoft | microsoft reciprocal license
ncsa | ncsa | (?:university of illinois )?ncsa open source license
odbl-1.0 | database | open (?:data commons open )?database license(?: v?1 0)?
ofl-1.1 | font | (?:sil )?open font license(?: 1 1)?
openssl | openssl | openssl license
osl-3.0 | open | open software license(?: v| version)?(?: ?3 0)?
postgresql | postgresql | postgresql license
psf-2.0 | python | python software foundation license(?: 2)?
ruby | ruby | ruby license
unicode | unicode | unicode license agreement
unlicense | unlicense | (?:the )?unlicense
vim | vim | vim license
w3c | w3c | w3c software(?: notice and)? license
wtfpl | wtfpl | wtfpl
wtfpl | what | do what the fuck you want to public license
zlib | zlib | (?:zlib(?: libpng)? license)
zpl-2.1 | zope | zope public license(?: 2 1)?
public-domain | domain | (?:released into|placed in|in|to) the public domain
proprietary | rights | all rights reserved
"""

#: label | keyword | clause of the license's own text, over the same words. Each match contains the keyword.
CLAUSES = r"""
mit | hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | without restriction | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
mit | infringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non ?infringement
isc | without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | disclaims all | the author disclaims all warranties with regard to this software
bsd | source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions of source code | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | endorse or promote | neither the names? of (?:\S{1,60} ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote products
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | merchantability | any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
apache-2.0 | obtain a copy | you may (?:not use this file except in compliance with the license you may )?obtain a copy of the license at https? www apache org licenses license 2 0
apache-2.0 | applicable law | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | not use this file | you may not use this file except in compliance with the license
apache-2.0 | each contributor | grant of (?:copyright|patent) license subject to the terms and conditions of this license each contributor hereby grants to you
apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation
gpl-2.0 | free software | (?:this program|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
gpl-3.0 | free software | (?:this program|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
gpl | useful but without | (?:this program|it) is distributed in the hope that it will be useful but without any warranty
gpl | gnu general public | you should have received a copy of the gnu general public license along with
lgpl-2.1 | free software | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-3.0 | free software | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3
lgpl | gnu lesser | you should have received a copy of the gnu lesser general public license along with
lgpl-2.0 | gnu library | you should have received a copy of the gnu library general public license along with
agpl-3.0 | gnu affero | (?:you should have received a copy of|under the terms of) the gnu affero general public license
agpl-3.0 | remotely through | users interacting with it remotely through a computer network
gfdl-1.3 | free documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-1.1 | contents of this file | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | source code form | this source code form is subject to the terms of the mozilla public license v 2 0
epl-1.0 | made available under | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | made available under | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version )?2 0
cddl-1.0 | contents of this file | the contents of this file are subject to the terms of the common development and distribution license
zlib | express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | plainly marked | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
boost-1.0 | hereby granted | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | dedicate any and all | we dedicate any and all copyright interest in the software to the public domain
cc0-1.0 | extent possible under law | to the extent possible under law (?:\S{1,60} ){1,12}waived all copyright and related or neighboring rights
cc-by-4.0 | creativecommons | creativecommons org licenses by 4 0
cc-by-sa-4.0 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-nc-4.0 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-3.0 | creativecommons | creativecommons org licenses by 3 0
cc-by-sa-3.0 | creativecommons | creativecommons org licenses by sa 3 0
cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
wtfpl | verbatim or modified | everyone is permitted to copy and distribute verbatim or modified copies of this license document
gpl | changing it is not allowed | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
artistic-2.0 | standard version | you may distribute verbatim copies of the source form of the standard version of this package
artistic-1.0 | standard version | you may make and give away verbatim copies of the source form of the standard version of this package
ofl-1.1 | reserved font | reserved font names?
ofl-1.1 | font software | the font software may be sold as part of a larger software package but no copy of one or more of the original typefaces may be sold by itself
openssl | openssl project | this product includes software developed by the openssl project for use in the openssl toolkit
postgresql | written agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
psf-2.0 | psf hereby | subject to the terms and conditions of this license agreement psf hereby grants licensee a nonexclusive royalty free world wide license
ncsa | deal with the software | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software
ms-pl | accompanying software | this license governs use of the accompanying software if you use the software you accept this license
w3c | obtaining using | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply
vim | maintainer | you must make your changes available to the maintainer when distributing a modified vim
odbl-1.0 | open database license | this database is made available under the open database license
eupl-1.2 | licensed under the eupl | licensed under the eupl
beerware | buy me a beer | you can buy me a beer in return
public-domain | no copyright | (?:there is|has|with) no copyright
proprietary | without prior written | (?:reproduction|distribution|copying) (?:\S{1,60} ){0,8}without prior written (?:permission|consent)
proprietary | confidential and proprietary | confidential and proprietary
"""

#: priority (0 is best) | weight | frame around a name.
FRAMES = [
    (0, 1.0, "spdx license identifier {}"),
    (1, 0.95, "(?:is |are |be )?(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?{}"),
    (1, 0.9, "(?:subject to|governed by|in accordance with|terms of|copy of|see) (?:the )?{}"),
    (2, 0.8, "{}"),
]
CLAUSE = (1, 0.95)  # priority and weight of a clause
MATCH_CHARS, MATCH_WORDS = 2000, 64  # no rule matches more


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, expression, priority, weight): each name in each frame, each label as an SPDX identifier, and each clause."""
    out = []
    for line in NAMES.strip().splitlines():
        label, keyword, name = (x.strip() for x in line.split(" | "))
        for priority, weight, frame in FRAMES:
            name_or_id = "(?:" + label.replace(".", " ").replace("-", " ") + ")(?: only| or later)?" if priority == 0 else f"(?:{name})"
            out.append((label, "spdx" if priority == 0 else keyword, "(?<= )" + frame.format(name_or_id) + "(?= )", priority, weight))
    for line in CLAUSES.strip().splitlines():
        label, keyword, clause = (x.strip() for x in line.split(" | "))
        out.append((label, keyword, f"(?<= )(?:{clause})(?= )", *CLAUSE))
    return list(dict.fromkeys(out))  # labels of several rows have one identifier


_INSIDE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # a word's characters before lowering
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_PHRASES = "|".join(f"{_GAP}+".join(p.split()) for p in BASE)
_HERE = rf"(?i)(?<={_GAP})(?=(?:{_PHRASES})(?!{_INSIDE}))"


#: Every name in NAMES, in any frame, has one of these, and every clause its keyword; each begins where a word begins.
_ANCHORS = ["(?:un)?licen[cs]e", "spdx", "0?bsd", "cc0", "wtfpl", "public domain", "rights reserved", "creative commons", "cc by", "want to public", "mit no"]


def _gate() -> str:
    """An expression for texts that have anything that some rule needs."""
    phrases = {*_ANCHORS, *(line.split(" | ")[1].strip() for line in CLAUSES.strip().splitlines())} - {"infringement"} | {"(?:non)?infringement"}
    return rf"(?i)(?<!{_INSIDE})(?:" + "|".join(f"{_GAP}+".join(p.split()) for p in sorted(phrases)) + ")"


def _count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{_INSIDE}+")).cast("long")


def _places(text: Column, pattern: Column | str) -> Column:
    """The pieces of text, cut before each place where the pattern stands (text begins with a gap, so never before all)."""
    return F.split(text, pattern if isinstance(pattern, Column) else F.lit(pattern), -1)


def _begins(pieces: Column, phrase: str) -> Column:
    expression = "(?i)^" + f"{_GAP}+".join(phrase.split())
    return F.exists(pieces, lambda p: p.rlike(expression))


def detections(texts: DataFrame, spark: SparkSession) -> DataFrame:
    """For texts (row, text): row, label, weight of every detection that no other one suppresses."""
    listed = rules()
    none = F.expr("cast(array() as array<int>)")

    def matching(keyword: str) -> Column:
        """Numbers of a keyword's rules that match, by literal patterns: first the keyword, then all its rules as one, then each."""
        mine = [(i, r[2]) for i, r in enumerate(listed) if r[1] == keyword]
        each = F.array_compact(F.array(*[F.when(F.col("norm").rlike(rule), F.lit(i)) for i, rule in mine]))
        return F.when(F.contains("norm", F.lit(keyword)) & F.col("norm").rlike("|".join(f"(?:{rule})" for _, rule in mine)), each).otherwise(none)

    table = spark.createDataFrame([(i, *r) for i, r in enumerate(listed)], "id int, label string, keyword string, rule string, priority int, weight double").drop("keyword")
    norm = F.concat(F.lit(" "), F.lower(F.array_join(F.regexp_extract_all("text", F.lit(f"({_INSIDE}+)"), 1), " ")), F.lit(" "))
    found = texts.select("row", norm.alias("norm")).select("row", "norm", F.explode(F.concat(*map(matching, sorted({r[1] for r in listed})))).alias("id"))
    # a fixed table of rules, a few hundred rows; only rules that match come here
    cut = found.join(F.broadcast(table), "id").select("row", "label", "rule", "priority", "weight", _places(F.col("norm"), F.expr("concat('(?=', rule, ')')")).alias("pieces"))
    # a match begins a piece and may go on into the next ones, each of which has a word at least
    heads = F.transform(F.col("pieces"), lambda p, k: F.struct(F.length(p).alias("size"), F.when(k > 0, F.substring(F.array_join(F.slice(F.col("short"), k + 1, F.lit(MATCH_WORDS)), ""), 1, MATCH_CHARS)).alias("head")))
    cut = cut.withColumn("short", F.transform("pieces", lambda p: F.substring(p, 1, MATCH_CHARS)))
    heads = cut.select("row", "label", "rule", "priority", "weight", F.posexplode(heads).alias("k", "x")).select("row", "label", "rule", "priority", "weight", "k", "x.*")
    before = W.Window.partitionBy("row", "rule", "label").orderBy("k").rowsBetween(W.Window.unboundedPreceding, -1)
    spans = heads.withColumn("start", F.sum("size").over(before) + 1).where("k > 0")
    spans = spans.select("row", "label", "priority", "weight", "start", (F.col("start") + F.length(F.expr("regexp_extract(concat(' ', head, ' '), rule, 0)"))).alias("end"))
    order = W.Window.partitionBy("row").orderBy("start", F.desc("end"), "priority", "label").rowsBetween(W.Window.unboundedPreceding, -1)
    levels = sorted({r[3] for r in listed})
    covered = reduce(lambda c, p: c.when(F.col("priority") == p, F.max(F.when(F.col("priority") <= p, F.col("end"))).over(order)), levels[1:], F.when(F.col("priority") == levels[0], F.max(F.when(F.col("priority") <= levels[0], F.col("end"))).over(order)))
    return spans.withColumn("covered", covered).where("covered is null or covered < end").select("row", "label", "weight")


def license_scan(docs: DataFrame) -> DataFrame:
    """For docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lowered. A base place is where a phrase's words stand consecutively;
    n_base counts all, first_word and last_word are the smallest and largest word number they start at (null without any). labels adds
    the signature rules' own to base_labels. score is the largest weight of a detection, 0.85 for a base place, 0 without either.
    Null text counts as empty: zeros, nulls, empty labels. Every row gives one row, repeated ids too; other columns are dropped. A text of
    any length is scanned whole, equal ones once.
    An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_words", _count(F.col("text")))
    hit = F.col("text").rlike(_gate())
    pieces = _places(F.concat(F.lit(" "), F.col("text")), _HERE)
    lean = rows.select("doc_id", "n_words", F.when(hit, F.sha2("text", 256)).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("row"), F.when(hit, pieces).alias("pieces"))
    base = lean.select(
        "doc_id", "n_words", "row", F.coalesce(F.size("pieces") - 1, F.lit(0)).cast("long").alias("n_base"),
        F.when(F.size("pieces") > 1, _count(F.element_at("pieces", 1))).alias("first_word"),
        F.when(F.size("pieces") > 1, F.col("n_words") - _count(F.element_at("pieces", -1))).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*[F.when(_begins(F.slice("pieces", 2, F.greatest(F.size("pieces") - 1, F.lit(0))), phrase), F.lit(label)) for phrase, label in BASE.items()]))).alias("base"),
    )
    texts = rows.where(hit).groupBy(F.sha2("text", 256).alias("row")).agg(F.first("text").alias("text"))
    found = detections(texts, docs.sparkSession).groupBy("row").agg(F.collect_set("label").alias("own"), F.max("weight").alias("weight"))
    none = F.expr("cast(array() as array<string>)")
    out = base.join(found, "row", "left").withColumn("base", F.coalesce("base", none))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("own", none))), ",").alias("labels"),
        F.greatest(F.coalesce("weight", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.85).otherwise(0.0)).alias("score"),
    )
