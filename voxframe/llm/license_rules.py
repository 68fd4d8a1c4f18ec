"""Signature rules of the license scan.

Rules read the text's words, lower-cased and joined by single spaces.  A line is
``label | priority | confidence | keyword | pattern``; the keyword is a literal
that any match must contain.  Priority 1 is a license's own wording or identifier,
2 a name with a version, 3 a name, 4 a general statement.  Two families whose
members differ by kind and version alone are built from parameters.
"""

from __future__ import annotations

NOTICES = r"""
mit | 1 | 0.98 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit | 2 | 0.95 | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 1 | 0.97 | spdx | spdx license identifier mit
mit | 3 | 0.9 | mit licen | (?:under|by|the|a|use|terms of)(?: the)? mit licen[sc]e
mit | 3 | 0.85 | mit licen | mit licen[sc]ed?
mit | 3 | 0.85 | licen | licen[sc]ed? (?:mit|under mit|as mit)
mit | 3 | 0.85 | expat | expat licen[sc]e
mit | 3 | 0.9 | opensource org | opensource org licenses mit(?: license)?
mit-0 | 1 | 0.97 | mit 0 | spdx license identifier mit 0
mit-0 | 2 | 0.9 | no attribution | mit no attribution(?: licen[sc]e)?
x11 | 3 | 0.8 | x11 licen | x11 licen[sc]e
bsd-2 | 1 | 0.97 | bsd 2 | spdx license identifier bsd 2 clause(?: \S+)?
bsd-2 | 2 | 0.93 | bsd | (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[sc]e)?
bsd-3 | 1 | 0.97 | bsd 3 | spdx license identifier bsd 3 clause(?: \S+)?
bsd-3 | 2 | 0.93 | bsd | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[sc]e)?
bsd-3 | 1 | 0.96 | endorse or promote | neither the name of .{1,120}? nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software
bsd-4 | 2 | 0.93 | bsd | (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[sc]e)?
bsd-4 | 1 | 0.96 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-0 | 2 | 0.93 | bsd | (?:bsd 0 clause|0bsd|zero clause bsd|bsd zero clause)(?: licen[sc]e)?
bsd | 3 | 0.8 | bsd | bsd(?: style)? licen[sc]ed?
bsd | 2 | 0.9 | redistributi | redistribution and use in source and binary forms with or without modification are permitted
isc | 1 | 0.97 | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 1 | 0.97 | spdx | spdx license identifier isc
isc | 3 | 0.85 | isc licen | isc licen[sc]ed?
apache-1 | 2 | 0.93 | apache | apache(?: software)? licen[sc]e(?: version| v)? 1(?: [01])?
apache-2 | 1 | 0.97 | spdx | spdx license identifier apache 2 0
apache-2 | 1 | 0.97 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | 2 | 0.95 | apache | apache(?: software)?(?: public)? licen[sc]e(?: version| v)? 2(?: 0)?
apache-2 | 2 | 0.93 | apache | apache(?: v)? 2(?: 0)?(?: licen[sc]ed?)?
apache-2 | 2 | 0.95 | apache org licenses | apache org licenses license 2 0(?: txt| html)?
apache-2 | 2 | 0.9 | asl | asl 2(?: 0)?
apache | 3 | 0.75 | apache licen | apache licen[sc]ed?
gpl | 3 | 0.8 | general public licen | gnu general public licen[sc]e
gpl | 3 | 0.75 | gpl | (?:gnu )?gpl(?: licen[sc]ed?)?
gpl | 3 | 0.8 | gnu org | gnu org licenses gpl(?: html| txt)?
lgpl | 3 | 0.8 | general public licen | (?:gnu )?(?:lesser|library) general public licen[sc]e
lgpl | 3 | 0.75 | lgpl | (?:gnu )?lgpl(?: licen[sc]ed?)?
agpl | 3 | 0.8 | general public licen | (?:gnu )?affero general public licen[sc]e
agpl | 3 | 0.75 | agpl | (?:gnu )?agpl(?: licen[sc]ed?)?
gfdl | 3 | 0.85 | documentation licen | gnu free documentation licen[sc]e(?: version)?(?: 1(?: [1-3])?)?
gfdl | 3 | 0.8 | gfdl | gfdl(?: 1 [1-3])?
gpl-classpath | 2 | 0.9 | classpath | (?:gnu )?classpath exception
gpl-linking | 2 | 0.85 | linking exception | (?:gpl|lgpl|gnu)? ?(?:with )?(?:static |dynamic )?linking exception
mpl-1.0 | 2 | 0.93 | mozilla | mozilla public licen[sc]e(?: version| v)? 1 0
mpl-1.1 | 2 | 0.93 | mozilla | mozilla public licen[sc]e(?: version| v)? 1 1
mpl-2.0 | 2 | 0.95 | mozilla | mozilla public licen[sc]e(?: version| v)? 2(?: 0)?
mpl-2.0 | 1 | 0.97 | mozilla | subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file
mpl-2.0 | 1 | 0.97 | spdx | spdx license identifier mpl 2 0(?: no copyleft exception)?
mpl-2.0 | 2 | 0.9 | mpl | mpl(?: v)? 2(?: 0)?
mpl | 3 | 0.75 | mozilla | mozilla public licen[sc]e
epl-1.0 | 2 | 0.93 | eclipse | eclipse public licen[sc]e(?: version| v)? 1(?: 0)?
epl-2.0 | 2 | 0.93 | eclipse | eclipse public licen[sc]e(?: version| v)? 2(?: 0)?
epl-2.0 | 1 | 0.97 | spdx | spdx license identifier epl 2 0
epl | 3 | 0.75 | eclipse | eclipse public licen[sc]e
edl | 3 | 0.85 | eclipse | eclipse distribution licen[sc]e(?: v)?(?: 1 0)?
cpl-1.0 | 2 | 0.9 | common public | common public licen[sc]e(?: version)?(?: 1(?: 0)?)?
cddl-1.0 | 2 | 0.9 | common development | common development and distribution licen[sc]e(?: version)?(?: 1(?: 0)?)?
cddl-1.1 | 2 | 0.93 | common development | common development and distribution licen[sc]e(?: version)? 1 1
cddl | 3 | 0.75 | cddl | cddl(?: 1 [01])?
cpal-1.0 | 2 | 0.9 | common public attribution | common public attribution licen[sc]e(?: version)?(?: 1(?: 0)?)?
eupl-1.1 | 2 | 0.93 | european union | european union public licen[sc]e(?: v| version)? 1 1
eupl-1.2 | 2 | 0.93 | european union | european union public licen[sc]e(?: v| version)? 1 2
eupl | 3 | 0.75 | eupl | eupl(?: 1 [012])?
artistic-1.0 | 2 | 0.9 | artistic | artistic licen[sc]e(?: version| v)? 1(?: 0)?
artistic-2.0 | 2 | 0.93 | artistic | artistic licen[sc]e(?: version| v)? 2(?: 0)?
artistic | 3 | 0.75 | artistic | (?:perl )?artistic licen[sc]e
perl | 2 | 0.9 | perl | (?:under|on) the same terms as perl(?: 5)?(?: itself)?
zlib | 1 | 0.96 | as is without any | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib | 3 | 0.85 | zlib | zlib(?: libpng)? licen[sc]e
libpng | 3 | 0.85 | png | (?:libpng|png reference library) licen[sc]e(?: version 2)?
boost-1.0 | 2 | 0.95 | boost | boost software licen[sc]e(?: version| v)?(?: 1(?: 0)?)?
boost-1.0 | 1 | 0.97 | spdx | spdx license identifier bsl 1 0
busl-1.1 | 2 | 0.95 | business source | business source licen[sc]e(?: version)?(?: 1(?: [01])?)?
busl-1.1 | 1 | 0.97 | spdx | spdx license identifier busl 1 1
sspl-1 | 2 | 0.95 | server side | server side public licen[sc]e(?: version| v)?(?: 1(?: 0)?)?
elastic-2 | 2 | 0.95 | elastic | elastic licen[sc]e(?: version)?(?: 2(?: 0)?)?
commons-clause | 2 | 0.93 | commons clause | commons clause(?: licen[sc]e condition)?(?: v 1 0)?
polyform | 2 | 0.9 | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter|free trial)(?: licen[sc]e)?(?: 1 0 0)?
openrail | 2 | 0.9 | rail | (?:big ?science |creativeml )?open ?rail(?: [ms]{1,2})?(?: licen[sc]e)?
rail | 3 | 0.8 | responsible ai | responsible ai licen[sc]es?
llama | 2 | 0.9 | community licen | llama [2-4](?: [0-9])? community licen[sc]e(?: agreement)?
gemma | 2 | 0.85 | gemma | gemma (?:terms of use|licen[sc]e)
unlicense | 1 | 0.97 | public domain | this is free and unencumbered software released into the public domain
unlicense | 3 | 0.9 | unlicense | the unlicense
unlicense | 1 | 0.97 | unlicense | spdx license identifier unlicense
wtfpl | 2 | 0.93 | what the fuck | do what the fuck you want to public licen[sc]e(?: version)?(?: 2)?
wtfpl | 3 | 0.9 | wtfpl | wtfpl(?: v)?(?: 2)?
beerware | 2 | 0.9 | beer | beer ?ware(?: licen[sc]e)?(?: revision 42)?
cc0-1.0 | 2 | 0.93 | cc0 | cc0(?: v)? ?1 0(?: universal)?
cc0-1.0 | 2 | 0.93 | creative commons | creative commons(?: cc0| zero)(?: v)?(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0 | 2 | 0.93 | publicdomain zero | creativecommons org publicdomain zero 1 0
cc0 | 3 | 0.85 | cc0 | cc0(?: licen[sc]ed?)?
cc-pdm | 2 | 0.9 | public domain mark | (?:creative commons )?public domain mark(?: 1 0)?
cc | 4 | 0.6 | creative commons | creative commons(?: licen[sc]ed?)?
cc-by-nc | 3 | 0.85 | cc by nc | cc by nc
odbl-1.0 | 2 | 0.93 | open database | open database licen[sc]e(?: version| v)?(?: 1(?: 0)?)?
odbl-1.0 | 3 | 0.85 | odbl | odbl(?: 1 0)?
odc-by-1.0 | 2 | 0.93 | attribution licen | open data commons attribution licen[sc]e(?: v)?(?: 1 0)?
odc-by-1.0 | 3 | 0.85 | odc by | odc by(?: 1 0)?
pddl-1.0 | 2 | 0.93 | dedication | (?:open data commons )?public domain dedication and licen[sc]e(?: v)?(?: 1 0)?
cdla-permissive | 2 | 0.93 | community data | community data licen[sc]e agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing | 2 | 0.93 | community data | community data licen[sc]e agreement sharing(?: version)?(?: 1 0)?
ogl-uk | 2 | 0.9 | open government | open government licen[sc]e(?: v)?(?: ?[123](?: 0)?)?
etalab | 2 | 0.9 | licence ouverte | licence ouverte(?: open licence)?(?: version)?(?: [12] 0)?
dl-de | 2 | 0.9 | datenlizenz | datenlizenz deutschland (?:namensnennung|zero)(?: version)? 2 0
ofl-1.1 | 2 | 0.95 | open font | (?:sil )?open font licen[sc]e(?: version| v)?(?: 1 [01])?
ofl-1.1 | 1 | 0.97 | spdx | spdx license identifier ofl 1 1(?: \S+)?
psf-2 | 2 | 0.9 | python software | python software foundation licen[sc]e(?: version)?(?: 2)?
python-2 | 2 | 0.85 | python licen | python licen[sc]e(?: 2(?: 0)?)?
php-3 | 2 | 0.9 | php licen | php licen[sc]e(?: version| v)?(?: 3(?: 01?)?)?
ruby | 2 | 0.85 | ruby | ruby licen[sc]e
ruby | 2 | 0.85 | ruby | (?:under|on) the same terms as ruby(?: itself)?
tcl | 3 | 0.8 | tcl | tcl(?: tk)? licen[sc]e
vim | 3 | 0.8 | vim licen | vim licen[sc]e
postgresql | 3 | 0.85 | postgresql | postgresql licen[sc]e
openssl | 3 | 0.85 | openssl | openssl(?: ssleay)?(?: combined)? licen[sc]e
sleepycat | 3 | 0.85 | sleepycat | sleepycat(?: public)? licen[sc]e
ncsa | 3 | 0.85 | ncsa | (?:university of illinois )?(?:uiuc )?ncsa(?: open source)? licen[sc]e
curl | 3 | 0.8 | curl licen | curl licen[sc]e
icu | 3 | 0.8 | icu licen | icu licen[sc]e
unicode | 3 | 0.85 | unicode | unicode(?: dfs| inc)? licen[sc]e(?: agreement)?(?: v 3)?
w3c | 3 | 0.85 | w3c | w3c(?: software)?(?: notice and)? licen[sc]e
upl-1.0 | 2 | 0.9 | universal permissive | universal permissive licen[sc]e(?: v| version)?(?: 1 0)?
ms-pl | 2 | 0.9 | microsoft | microsoft public licen[sc]e
ms-rl | 2 | 0.9 | microsoft | microsoft reciprocal licen[sc]e
apsl-2 | 2 | 0.9 | apple | apple public source licen[sc]e(?: version)?(?: [12] [0-2])?
ipl-1 | 2 | 0.9 | ibm | ibm public licen[sc]e(?: version| v)?(?: 1 0)?
npl | 2 | 0.9 | netscape | netscape public licen[sc]e(?: version| v)?(?: 1 [01])?
qpl | 2 | 0.9 | q public | q public licen[sc]e(?: version)?(?: 1 0)?
spl | 2 | 0.9 | sun public | sun public licen[sc]e(?: v)?(?: 1 0)?
osl-3 | 2 | 0.9 | open software | open software licen[sc]e(?: version| v)?(?: 3(?: 0)?)?
afl-3 | 2 | 0.9 | academic free | academic free licen[sc]e(?: version| v)?(?: [123](?: [01])?)?
ecl-2 | 2 | 0.9 | educational community | educational community licen[sc]e(?: version)?(?: 2 0)?
lppl | 2 | 0.9 | latex | latex project public licen[sc]e(?: v| version)?(?: 1 [0-3])?
cecill | 2 | 0.9 | cecill | cecill(?: [bc])?(?: licen[sc]e)?(?: 2 [01])?
mulan-psl-2 | 2 | 0.9 | mulan | mulan (?:psl|permissive software licen[sc]e)(?: v| version)?(?: [12])?
blueoak-1 | 2 | 0.9 | blue oak | blue oak model licen[sc]e(?: 1 0 0)?
hippocratic | 2 | 0.9 | hippocratic | hippocratic licen[sc]e(?: version)?(?: [123] [01])?
json | 2 | 0.9 | good not evil | the software shall be used for good not evil
open-game | 3 | 0.85 | open game | open game licen[sc]e(?: version)?(?: 1 0a?)?
free-art | 3 | 0.85 | free art | free art licen[sc]e(?: 1 [0-3])?
arxiv | 3 | 0.8 | arxiv | arxiv(?: org)?(?: perpetual)?(?: non ?exclusive)? (?:distribution )?licen[sc]e
proprietary | 4 | 0.6 | rights reserved | all rights reserved
proprietary | 3 | 0.8 | proprietary | proprietary(?: and confidential)?(?: software)? licen[sc]e
proprietary | 2 | 0.85 | confidential | proprietary and confidential
proprietary | 3 | 0.75 | end user licen | end user licen[sc]e agreement
proprietary | 2 | 0.85 | may not be | may not be (?:reproduced|copied|redistributed|published|broadcast)(?: \S+){0,12} without (?:the )?(?:prior |express |written )+permission
non-commercial | 3 | 0.75 | commercial | (?:for )?non ?commercial (?:use|purposes?)(?: only)?
research-only | 3 | 0.75 | only | (?:for )?(?:academic|research)(?: and (?:academic|research))? (?:use|purposes?) only
public-domain | 3 | 0.8 | public domain | (?:in|into|to) the public domain
public-domain | 4 | 0.6 | public domain | public domain
copyleft | 4 | 0.5 | copyleft | copyleft
open-source | 4 | 0.5 | licen | open source licen[sc]ed?
generic-license | 4 | 0.4 | licen | licen[sc]ed under the terms of
generic-license | 4 | 0.4 | licen | (?:see|read) the licen[sc]e(?: file)?(?: for (?:more )?details)?
copyright | 4 | 0.4 | copyright | copyright(?: c)?(?: [12][0-9]{3})+
copyright | 4 | 0.4 | droits r | tous droits réservés
copyright | 4 | 0.4 | derechos | todos los derechos reservados
copyright | 4 | 0.4 | alle rechte | alle rechte vorbehalten
spdx | 4 | 0.5 | spdx | spdx license identifier
"""

CC_KINDS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s?", "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
GNU_KINDS = {"gpl": ("general public", ("1", "2", "3")), "lgpl": ("(?:lesser|library) general public", ("2", "2.1", "3")), "agpl": ("affero general public", ("1", "3"))}

#: Any match of any rule contains one of these stems; a text without them is not scanned.
STEMS = (
    "licen", "lizenz", "gpl", " cc ", " cc0", "creative", "publicdomain", "public domain", "copyright", "copyleft", "redistribution", "rights reserved",
    "permission", "spdx", "proprietary", "apache", " mpl", "bsd", " asl 2", "cddl", "eupl", "wtfpl", "beer", "odbl", "odc by", "gfdl", "cecill", "mulan psl",
    "non commercial", "noncommercial", "use only", "purpose only", "purposes only", "express or implied", "endorse or promote", "advertising materials",
    "linking exception", "classpath exception", "same terms as", "openrail", "open rail", "gemma terms", "polyform", "good not evil", "derechos reservados",
    "droits réservés", "alle rechte", "commons clause", "attribution",
)


def rules() -> list[dict]:
    """All rules in order: id, label, priority, confidence, keyword, pattern."""
    found = [[x.strip() for x in line.split(" | ", 4)] for line in NOTICES.strip().splitlines()]
    for kind, name in CC_KINDS.items():
        short = kind.replace("-", " ")
        for version in CC_VERSIONS:
            v = version.replace(".", " ")
            found.append([f"cc-{kind}-{version}", "2", "0.95", f"cc {short}", rf"cc {short}(?: version| v)? {v}(?: international| unported| generic| deed)?"])
            found.append([f"cc-{kind}-{version}", "2", "0.95", "creativecommons", rf"creativecommons org licenses {short} {v}(?: legalcode| deed)?(?: \w\w)?"])
            found.append([f"cc-{kind}-{version}", "2", "0.95", "attribution", rf"(?:creative commons )?{name}(?: version| v)? {v}(?: international| unported| generic)?(?: licen[sc]e)?"])
        found.append([f"cc-{kind}", "3", "0.85", f"cc {short}", rf"cc {short}"])
        found.append([f"cc-{kind}", "3", "0.85", "creative commons", rf"creative commons {name}"])
    for kind, (name, versions) in GNU_KINDS.items():
        for version in versions:
            v = version.replace(".", " ") + ("" if "." in version else "(?: 0)?")
            found.append([f"{kind}-{version}", "2", "0.95", "public licen", rf"(?:gnu )?{name} licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? {v}"])
            found.append([f"{kind}-{version}", "2", "0.92", kind, rf"(?:gnu )?{kind} ?(?:version |v ?)?{v}"])
            found.append([f"{kind}-{version}-or-later", "1", "0.97", "later", rf"(?:gnu )?(?:{name} licen[sc]e(?: as published by the free software foundation)?(?: either)?|{kind})(?: version| v)? ?{v}(?: of the licen[sc]e)? or (?:at your option )?(?:any )?later(?: version)?"])
            found.append([f"{kind}-{version}-only", "1", "0.97", "only", rf"(?:gnu )?(?:{name} licen[sc]e|{kind})(?: version| v)? ?{v} only"])
    return [{"id": i, "label": label, "priority": int(p), "confidence": float(c), "keyword": k, "pattern": f" (?:{pattern})(?= )"} for i, (label, p, c, k, pattern) in enumerate(found)]
