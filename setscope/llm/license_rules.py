"""Rules of the license scan: what a license is called, how a file says that it is under it, and where it is found.

Every rule is a regular expression over normalised text: lower-case words joined by single spaces, so ``GPL-2.0`` reads
``gpl 2 0``. A rule needs one of its keywords, one of which starts at a word in every text that it matches. Each line below is

    label | keywords | names | short forms | places

with keywords split by semicolons, where names are what prose calls it, short forms are what tags and headers use, and places are words of its address. Rules are made
from a line's parts as FORMS says; a part is itself a hand-written expression, with alternatives after semicolons.
"""

from __future__ import annotations

import re
from typing import NamedTuple

FAMILIES = """
gpl-1.0 | gpl ;general public | gnu general public license v(?:ersion)? ?1(?: 0)? | gpl ?v?1(?: 0)?(?: only| or later)? | gnu org licenses (?:old licenses )?gpl 1 0
gpl-2.0 | gpl ;general public | gnu general public license v(?:ersion)? ?2(?: 0)?(?! 1) | gpl ?v?2(?: 0)?(?: only)? | gnu org licenses (?:old licenses )?gpl 2 0
gpl-2.0+ | gpl ;general public | gnu general public license(?: as published by the free software foundation)? (?:either )?version 2(?: of the license)? or (?:at your option )?any later version | gpl ?v?2(?: 0)? or later | gnu org licenses gpl 2 0 plus
gpl-3.0 | gpl ;general public | gnu general public license v(?:ersion)? ?3(?: 0)? | gpl ?v?3(?: 0)?(?: only)? | gnu org licenses gpl 3 0
gpl-3.0+ | gpl ;general public | gnu general public license(?: as published by the free software foundation)? (?:either )?version 3(?: of the license)? or (?:at your option )?any later version | gpl ?v?3(?: 0)? or later | gnu org licenses gpl 3 0 plus
gpl | gpl ;general public | gnu (?:general public license|gpl) ;the general public license of gnu | gpl | gnu org licenses gpl(?: html| txt)? ;gnu org copyleft gpl
lgpl-2.0 | lgpl ;library general public | gnu library general public license(?: version 2)? | lgpl ?v?2(?: 0)? | gnu org licenses (?:old licenses )?lgpl 2 0
lgpl-2.1 | lgpl ;lesser general public | gnu lesser general public license v(?:ersion)? ?2 1 | lgpl ?v?2 1(?: only| or later)? | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | lgpl ;lesser general public | gnu lesser general public license v(?:ersion)? ?3(?: 0)? | lgpl ?v?3(?: 0)?(?: only| or later)? | gnu org licenses lgpl 3 0
lgpl | lgpl ;lesser general public | gnu lesser general public license | lgpl | gnu org licenses lgpl
agpl-3.0 | agpl ;affero | gnu affero general public license(?: v(?:ersion)? ?3(?: 0)?)? | agpl ?v?3(?: 0)?(?: only| or later)? | gnu org licenses agpl
fdl-1.3 | fdl ;gfdl ;free documentation | gnu free documentation license(?: v(?:ersion)? ?1 [123])? | g?fdl ?v?1 [123] | gnu org licenses fdl
apache-1.1 | apache | apache software license v(?:ersion)? ?1 [01] | apache 1 [01] | apache org licenses license 1 [01]
apache-2.0 | apache | apache license v(?:ersion)? ?2(?: 0)? ;apache software license v(?:ersion)? ?2(?: 0)? | apache ?v?2(?: 0)? ;asl ?2 0 apache | apache org licenses license 2 0
apache | apache | apache (?:software )?license | apache licen[cs]ed? | apache org licenses
mit | mit ;expat | mit license ;the mit licence ;expat license ;mit style license | mit ;expat | opensource org licenses mit ;mit license org
mit-0 | mit | mit no attribution(?: license)? | mit 0 | opensource org licenses mit 0
bsd-2-clause | bsd ;freebsd | bsd 2 clause(?: simplified| freebsd)?(?: license)? ;two clause bsd license ;simplified bsd license ;freebsd license | bsd 2 clause | opensource org licenses bsd 2 clause ;freebsd org copyright freebsd license
bsd-3-clause | bsd | bsd 3 clause(?: new| revised)?(?: license)? ;three clause bsd license ;(?:new|modified|revised) bsd license | bsd 3 clause | opensource org licenses bsd 3 clause
bsd-4-clause | bsd | (?:original|four clause|4 clause) bsd license | bsd 4 clause | bsd original license text
bsd-zero | bsd ;0bsd ;free public license | zero clause bsd(?: license)? ;free public license 1 0 0 | 0bsd ;bsd 0 clause | opensource org licenses 0bsd
bsd | bsd | bsd(?: style| type)? licen[cs]e ;berkeley software distribution license bsd | bsd licen[cs]ed | opensource org licenses bsd license
isc | isc | isc license ;internet systems consortium isc license | isc | opensource org licenses isc
mpl-1.1 | mpl ;mozilla | mozilla public license v(?:ersion)? ?1 [01] | mpl ?v?1 [01] | mozilla org mpl mpl 1 1
mpl-2.0 | mpl ;mozilla | mozilla public license v(?:ersion)? ?2(?: 0)? | mpl ?v?2(?: 0)? | mozilla org mpl 2 0
mpl | mpl ;mozilla | mozilla public license | mpl | mozilla org mpl
epl-1.0 | epl ;eclipse | eclipse public license (?:v(?:ersion)? ?)?1(?: 0)? | epl ?v?1(?: 0)? | eclipse org legal epl v10
epl-2.0 | epl ;eclipse | eclipse public license (?:v(?:ersion)? ?)?2(?: 0)? | epl ?v?2(?: 0)? | eclipse org legal epl (?:v20|2 0)
cddl | cddl ;common development | common development and distribution license(?: version 1 [01])? | cddl(?: 1 [01])? | opensource org licenses cddl
cpl-1.0 | cpl ;common public | common public license(?: version 1 0)? | cpl 1 0 | opensource org licenses cpl1 0 cpl
artistic-1.0 | artistic | artistic license(?: version)? 1 0 | artistic 1 0 | opensource org licenses artistic license 1
artistic-2.0 | artistic | artistic license(?: version)? 2 0 | artistic 2 0 | opensource org licenses artistic license 2
artistic | artistic | perl artistic license ;the artistic license | artistic licen[cs]ed | dev perl org licenses artistic
zlib | zlib | zlib license ;zlib libpng license | zlib | opensource org licenses zlib
libpng | libpng | libpng license(?: version 2)? | libpng(?: 2 0)? | libpng org pub png src libpng license
boost | boost ;bsl | boost software license(?: version 1 0)? | bsl 1 0 ;boost 1 0 | boost org license
unlicense | unlicense | the unlicense | unlicense | unlicense org
wtfpl | wtfpl ;want to public | do what the f\\w+ you want to public license | wtfpl(?: v?2)? | wtfpl net
psf | psf ;python software | python software foundation license(?: version 2)? | psf(?: 2 0)? | python org psf license
python-2.0 | python | python license(?: version)? 2(?: 0)? ;license agreement for python 2 | python 2 0 | python org download releases license
php-3.01 | php | php license(?: version 3(?: 0)?1?)? | php 3 0?1 | php net license
ruby | ruby | ruby license ;the license of ruby | ruby licen[cs]ed | ruby lang org license
postgresql | postgresql | postgresql licen[cs]e | postgresql licen[cs]ed | postgresql org about licence
openssl | openssl | openssl license ;dual openssl ssleay license | openssl licen[cs]ed | openssl org source license
w3c | w3c | w3c software (?:notice and )?license ;w3c document license | w3c 20\\d\\d ;w3c licen[cs]ed | w3 org consortium legal w3c
ofl-1.1 | open font ;ofl | sil open font license(?: version 1 [01])? | ofl 1 [01] | scripts sil org ofl
eupl | eupl ;european union public | european union public licen[cs]e(?: v(?:ersion)? ?1 [012])? | eupl(?: 1 [012])? | joinup ec europa eu eupl
cecill | cecill | cecill (?:free software )?license(?: v?2)? | cecill(?: [bc]| 2 [01])? | cecill info licences
ms-pl | ms pl ;microsoft public | microsoft public license | ms pl | opensource org licenses ms pl
ms-rl | ms rl ;microsoft reciprocal | microsoft reciprocal license | ms rl | opensource org licenses ms rl
upl-1.0 | upl ;universal permissive | universal permissive license(?: v1 0)? | upl 1 0 | oss oracle com licenses upl
afl-3.0 | afl ;academic free | academic free license(?: v(?:ersion)? ?[123] [012])? | afl ?v?[123] [012] | opensource org licenses afl
osl-3.0 | osl ;open software license | open software license(?: v(?:ersion)? ?[123] [01])? | osl ?v?[123] [01] | opensource org licenses osl
sspl | sspl ;server side public | server side public license(?: v(?:ersion)? ?1)? | sspl(?: 1 0)? | mongodb com licensing server side public license
busl | busl ;business source | business source license(?: 1 1)? | busl 1 1 | mariadb com bsl11 busl
elastic-2.0 | elastic | elastic license(?: v?2(?: 0)?)? | elastic 2 0 | elastic co licensing elastic license
cc0-1.0 | cc0 | cc0 1 0 universal ;creative commons cc0 ;cc0 public domain dedication | cc0(?: 1 0)? | creativecommons org publicdomain zero cc0
cc-by-4.0 | cc by ;creative ;by 4 | creative commons attribution 4 0(?: international)?(?: public license)? | cc by 4 0 | creativecommons org licenses by 4 0
cc-by-3.0 | cc by ;creative ;by 3 | creative commons attribution 3 0(?: unported)?(?: license)? | cc by 3 0 | creativecommons org licenses by 3 0
cc-by-sa | cc by ;creative ;by sa | creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported)? | cc by sa(?: [1234] [05])? | creativecommons org licenses by sa
cc-by-nc | cc by ;creative ;by nc | creative commons attribution non ?commercial(?: [1234] [05])? | cc by nc(?: [1234] [05])? | creativecommons org licenses by nc
cc-by-nd | cc by ;creative ;by nd | creative commons attribution no ?deriv(?:ative|s|atives)(?: works)?(?: [1234] [05])? | cc by nd(?: [1234] [05])? | creativecommons org licenses by nd
cc-by-nc-sa | cc by ;creative ;by nc | creative commons attribution non ?commercial share ?alike(?: [1234] [05])? | cc by nc sa(?: [1234] [05])? | creativecommons org licenses by nc sa
cc-by-nc-nd | cc by ;creative ;by nc | creative commons attribution non ?commercial no ?deriv(?:ative|s|atives)(?: works)?(?: [1234] [05])? | cc by nc nd(?: [1234] [05])? | creativecommons org licenses by nc nd
cc-by | cc by ;creative | creative commons attribution(?: license)? | cc by | creativecommons org licenses by creative
odbl | odbl ;open database | open database license(?: odbl)?(?: v?1 0)? | odbl(?: 1 0)? | opendatacommons org licenses odbl
openrail | openrail | (?:bigscience )?(?:creativeml )?open ?rail(?: ?m)? license openrail | openrail(?: ?m)? | openrail licenses page
vim | vim | vim license ;the vim charityware license | vim licen[cs]ed | vimhelp org license vim
ncsa | ncsa | university of illinois ncsa open source license ;ncsa open source license | ncsa | opensource org licenses ncsa
icu | icu ;unicode | icu license ;unicode license agreement ;unicode data files and software license | icu licen[cs]ed ;unicode dfs 20\\d\\d | unicode org copyright
bluebeam-gpl-font | font exception | gpl with font exception ;general public license with font exception | gpl 2 0 with font exception | gnu org licenses gpl faq font exception
classpath-exception | classpath | gnu general public license version 2 with (?:the )?classpath exception | gpl 2 0(?: only| or later)? with classpath exception 2 0 | openjdk org legal gplv2 ce classpath
"""

#: Parts of a family's line, how a rule says it, priority (the smaller, the stronger) and weight. {} is the part.
FORMS = (
    ("short", r"\bspdx licen[cs]e identifier {}\b", 10, 1.0),
    ("names", r"\b(?:licen[cs]ed|released|distributed|available|made available|provided)(?: to you)? under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}\b", 20, 0.95),
    ("short", r"\b(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?{}\b", 25, 0.9),
    ("places", r"\b(?:https? )?(?:www )?{}\b", 30, 0.85),
    ("short", r"\blicen[cs]e(?:s|d)?(?: is| type| name)? {}\b", 40, 0.8),
    ("names", r"\b{}\b", 50, 0.7),
    ("short", r"\b{} licen[cs]e[ds]?\b", 60, 0.6),
)

#: Rules that stand alone: label, keyword, expression, priority, weight.
SINGLE = (
    ("mit", "free of charge", r"\bpermission is hereby granted free of charge to any person obtaining a copy of this software\b", 5, 1.0),
    ("isc", "with or without fee", r"\bpermission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted\b", 5, 1.0),
    ("bsd", "redistribution and use", r"\bredistribution and use in source and binary forms with or without modification are permitted\b", 6, 0.95),
    ("bsd-3-clause", "endorse or promote", r"\bneither the name of (?:\w+ ){1,12}nor the names of its contributors may be used to endorse or promote\b", 5, 1.0),
    ("bsd-4-clause", "advertising materials", r"\ball advertising materials mentioning features or use of this software must display\b", 5, 1.0),
    ("zlib", "any express or implied warranty", r"\bthis software is provided as is without any express or implied warranty in no event will the authors\b", 5, 1.0),
    ("boost", "copy of the software and accompanying", r"\bto any person or organization obtaining a copy of the software and accompanying documentation\b", 5, 1.0),
    ("unlicense", "unencumbered software", r"\bthis is free and unencumbered software released into the public domain\b", 5, 1.0),
    ("gpl", "free software you can redistribute", r"\bfree software you can redistribute it and or modify it under the terms of the gnu general public license\b", 5, 1.0),
    ("lgpl", "free software you can redistribute", r"\bfree software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license\b", 5, 1.0),
    ("agpl-3.0", "free software you can redistribute", r"\bfree software you can redistribute it and or modify it under the terms of the gnu affero general public license\b", 5, 1.0),
    ("mpl-2.0", "source code form is subject", r"\bthis source code form is subject to the terms of the mozilla public license v 2 0\b", 5, 1.0),
    ("apache-2.0", "except in compliance with the license", r"\byou may not use this file except in compliance with the license\b", 6, 0.9),
    ("public-domain", "public domain", r"\b(?:released|placed|dedicated|is) (?:in|into|to) the public domain\b", 30, 0.8),
    ("proprietary", "all rights reserved", r"\b(?:proprietary and confidential )?all rights reserved\b", 90, 0.3),
    ("proprietary", "proprietary", r"\bproprietary (?:software )?licen[cs]e\b", 60, 0.6),
    ("unknown-license", "see license", r"\bsee (?:the )?license (?:file|txt|md)?(?: for (?:more )?(?:details|information|terms))?\b", 95, 0.2),
)


class Rule(NamedTuple):
    name: str
    label: str
    keywords: tuple[str, ...]
    pattern: str
    priority: int
    weight: float


def _alternatives(part: str) -> str:
    found = [p.strip().replace("\\\\", "\\") for p in part.split(";")]
    return found[0] if len(found) == 1 else "(?:" + "|".join(found) + ")"


def rules() -> list[Rule]:
    """All rules, strongest first. A short form of letters alone counts only beside a word that says it is a license."""
    out = []
    for line in FAMILIES.strip().splitlines():
        label, keyword, names, short, places = _parts(line)
        part = {"names": names, "short": short, "places": places}
        gates = tuple(k.strip() for k in keyword.split(";"))
        for i, (which, form, priority, weight) in enumerate(FORMS):
            pattern = form.replace("{}", _alternatives(part[which]))
            out.append(Rule(f"{label}#{i}", label, gates, pattern, priority, weight))
    for i, (label, keyword, pattern, priority, weight) in enumerate(SINGLE):
        out.append(Rule(f"{label}!{i}", label, (keyword,), pattern, priority, weight))
    return sorted(out, key=lambda r: (r.priority, r.name))


def _parts(line: str) -> list[str]:
    """Parts of a line in which bars also stand inside expressions: cut at bars with a space on both sides."""
    return [p.strip() for p in re.split(r"\s\|\s", line)]
