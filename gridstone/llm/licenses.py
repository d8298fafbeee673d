"""License scans by ordered signature rules.

A text is lower-cased (A-Z), its words joined by one space. Rules are hand-written
regular expressions over that line, in sections by priority; a rule runs only on texts
that hold all its keywords, which one pass a keyword over a whole chunk of texts
finds. Detections are ordered by section, then length, then place; one that lies within the
interval of an earlier one is suppressed, so the plain name inside a fuller notice does
not count again. Places of the base phrases are never suppressed.

Edge cases: a null or empty text has no words and no labels; labels without a
detection are the empty string, first_word and last_word then null; equal rows
get equal results; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridstone.llm import kernel as K
from gridstone.llm.common import bound_arrow, text_rows

#: Phrases whose places are always reported, with their labels: fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: The signatures, in order of priority by section: label | regular expression over lower-case words with one space between.
#: Written by hand; the first section that holds a place wins it.
SIGNATURES = r"""
# identifiers in file headers
0bsd | spdx license identifier 0bsd
afl-3.0 | spdx license identifier afl 3 0
agpl-3.0-only | spdx license identifier agpl 3 0 only
agpl-3.0-or-later | spdx license identifier agpl 3 0 or later
agpl-3.0 | spdx license identifier agpl 3 0
apache-1.1 | spdx license identifier apache 1 1
apache-2.0 with llvm-exception | spdx license identifier apache 2 0 with llvm exception
apache-2.0 | spdx license identifier apache 2 0
artistic-2.0 | spdx license identifier artistic 2 0
blueoak-1.0.0 | spdx license identifier blueoak 1 0 0
bsd-2-clause | spdx license identifier bsd 2 clause
bsd-3-clause-clear | spdx license identifier bsd 3 clause clear
bsd-3-clause | spdx license identifier bsd 3 clause
bsd-4-clause | spdx license identifier bsd 4 clause
bsl-1.0 | spdx license identifier bsl 1 0
cc-by-4.0 | spdx license identifier cc by 4 0
cc-by-sa-4.0 | spdx license identifier cc by sa 4 0
cc0-1.0 | spdx license identifier cc0 1 0
cddl-1.0 | spdx license identifier cddl 1 0
cecill-2.1 | spdx license identifier cecill 2 1
ecl-2.0 | spdx license identifier ecl 2 0
epl-1.0 | spdx license identifier epl 1 0
epl-2.0 | spdx license identifier epl 2 0
eupl-1.2 | spdx license identifier eupl 1 2
gpl-2.0 with classpath-exception | spdx license identifier gpl 2 0(?: only| or later)? with classpath exception 2 0
gpl-2.0 with syscall-note | spdx license identifier gpl 2 0(?: only| or later)? with linux syscall note
gpl-2.0-only | spdx license identifier gpl 2 0 only
gpl-2.0-or-later | spdx license identifier gpl 2 0 or later
gpl-2.0 | spdx license identifier gpl 2 0
gpl-3.0-only | spdx license identifier gpl 3 0 only
gpl-3.0-or-later | spdx license identifier gpl 3 0 or later
gpl-3.0 | spdx license identifier gpl 3 0
isc | spdx license identifier isc
lgpl-2.1-only | spdx license identifier lgpl 2 1 only
lgpl-2.1-or-later | spdx license identifier lgpl 2 1 or later
lgpl-2.1 | spdx license identifier lgpl 2 1
lgpl-3.0-only | spdx license identifier lgpl 3 0 only
lgpl-3.0-or-later | spdx license identifier lgpl 3 0 or later
lgpl-3.0 | spdx license identifier lgpl 3 0
mit-0 | spdx license identifier mit 0
mit | spdx license identifier mit
mpl-2.0 | spdx license identifier mpl 2 0
ms-pl | spdx license identifier ms pl
mulan-2.0 | spdx license identifier mulanpsl 2 0
ncsa | spdx license identifier ncsa
odbl-1.0 | spdx license identifier odbl 1 0
ofl-1.1 | spdx license identifier ofl 1 1
osl-3.0 | spdx license identifier osl 3 0
postgresql | spdx license identifier postgresql
psf-2.0 | spdx license identifier (?:psf|python) 2 0
unlicense | spdx license identifier unlicense
upl-1.0 | spdx license identifier upl 1 0
wtfpl | spdx license identifier wtfpl
zlib | spdx license identifier zlib
zpl-2.1 | spdx license identifier zpl 2 1
# grants and notices that only one license has
mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit-0 | permission is hereby granted free of charge to any person obtaining a copy of this software to deal in the software without restriction
x11 | except as contained in this notice the name of the x consortium shall not be used
isc | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
bsd | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | neither the name of [a-z0-9 ]{1,60} nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-3-clause-clear | no express or implied licenses to any party s patent rights are granted by this license
bsd-2-clause-patent | subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights
apache-2.0 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2.0 | terms and conditions for use reproduction and distribution 1 definitions
apache-1.1 | this product includes software developed by the apache software foundation
gpl-2.0-or-later | under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
gpl-3.0-or-later | under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
gpl-2.0-only | under the terms of the gnu general public license version 2 as published by the free software foundation
gpl-3.0-only | under the terms of the gnu general public license version 3 as published by the free software foundation
gpl | this program is free software you can redistribute it and or modify it
gpl | this program is distributed in the hope that it will be useful but without any warranty
gpl | you should have received a copy of the gnu general public license along with this program
gpl-3.0 | gnu general public license version 3 29 june 2007
gpl-2.0 | gnu general public license version 2 june 1991
lgpl-2.1-or-later | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version
lgpl-3.0-or-later | under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
lgpl-2.0-or-later | under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or
lgpl | this library is free software you can redistribute it and or modify it
lgpl | you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)
agpl-3.0-or-later | under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
agpl-3.0 | gnu affero general public license version 3 19 november 2007
agpl | you should have received a copy of the gnu affero general public license along with this program
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl-1.3 | gnu free documentation license version 1 3
gfdl-1.2 | gnu free documentation license version 1 2
gpl with classpath-exception | as a special exception the copyright holders of this library give you permission to link this library with independent modules
gpl with autoconf-exception | as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script
gpl with bison-exception | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
gpl with gcc-exception | under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception
mpl-2.0 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0-no-copyleft | this source code form is incompatible with secondary licenses as defined by the mozilla public license
npl-1.1 | the contents of this file are subject to the netscape public license version 1 1
epl-2.0 | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
epl-1.0 | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
cddl-1.0 | the contents of this file are subject to the terms of the common development and distribution license
cpl-1.0 | this program and the accompanying materials are made available under the terms of the common public license v1 0
ipl-1.0 | this program is provided under the terms of the ibm public license
bsl-1.0 | distributed under the boost software license version 1 0
bsl-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | the origin of this software must not be misrepresented you must not claim that you wrote the original software
unlicense | this is free and unencumbered software released into the public domain
unlicense | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | you just do what the fuck you want to
cc0-1.0 | the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0 | to the extent possible under law [a-z0-9 ]{1,60} has waived all copyright and related or neighboring rights
ofl-1.1 | this font software is licensed under the sil open font license version 1 1
ncsa | to deal with the software without restriction including without limitation the rights to use copy modify merge publish
openssl | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | this product includes cryptographic software written by eric young
php-3.01 | this source file is subject to version 3 01 of the php license
php-3.0 | this source file is subject to version 3 0 of the php license
zend-2.0 | this source file is subject to version 2 00 of the zend license
psf-2.0 | python software foundation license version 2
cnri-python | cnri license agreement for python
artistic-2.0 | the artistic license 2 0
artistic-1.0-perl | same terms as (?:the )?perl (?:5 (?:programming language )?)?(?:system )?itself
ruby | you can redistribute it and or modify it under either the terms of the gpl
vim | vim is charityware
postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
libpng | the png reference library is supplied as is
ijg | this software is based in part on the work of the independent jpeg group
freetype | portions of this software are copyright [a-z0-9 ]{0,20}the freetype project
curl | except as contained in this notice the name of a copyright holder shall not be used in advertising
json | the software shall be used for good not evil
beerware | the beer ?ware license revision 42
w3c | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply
unicode | unicode inc license agreement data files and software
icu | icu license icu 1 8 1 and later
ms-pl | this license governs use of the accompanying software if you use the software you accept this license microsoft public license
bzip2-1.0.6 | this program bzip2 the associated library libbzip2 and all documentation are copyright
sqlite | the author disclaims copyright to this source code in place of a legal notice here is a blessing
ecl-2.0 | licensed under the educational community license version 2 0
osl-3.0 | licensed under the open software license version 3 0
afl-3.0 | licensed under the academic free license version 3 0
eupl-1.2 | licensed under the eupl version 1 2
cecill-2.1 | ce logiciel est (?:un programme informatique |)regi par la licence cecill
mulan-2.0 | is licensed under mulan psl v2
elastic-2.0 | licensed under the elastic license 2 0
sspl-1.0 | under the terms of the server side public license version 1
busl-1.1 | business source license 1 1
commons-clause | commons clause license condition v1 0
polyform-nc-1.0.0 | polyform noncommercial license 1 0 0
openrail-m | openrail m
openrail-m | open rail m
llama-2 | llama 2 community license agreement
odbl-1.0 | this database is made available under the open database license
odc-by-1.0 | this database is made available under the open data commons attribution license
pddl-1.0 | made available under the public domain dedication and license
cdla-permissive-2.0 | community data license agreement permissive version 2 0
cdla-sharing-1.0 | community data license agreement sharing version 1 0
ogl-uk-3.0 | contains public sector information licensed under the open government licence v3 0
etalab-2.0 | licence ouverte 2 0
dl-de-by-2.0 | datenlizenz deutschland namensnennung version 2 0
us-government | this is a work of the (?:us|u s|united states) government and is not subject to copyright protection
# creative commons, the longer names first
cc-by-nc-nd-4.0 | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: work)? 4 0
cc-by-nc-sa-4.0 | creative commons attribution non ?commercial share ?alike 4 0
cc-by-nc-4.0 | creative commons attribution non ?commercial 4 0
cc-by-nd-4.0 | creative commons attribution no ?deriv(?:ative)?s 4 0
cc-by-sa-4.0 | creative commons attribution share ?alike 4 0
cc-by-4.0 | creative commons attribution 4 0
cc-by-nc-nd-3.0 | creative commons attribution non ?commercial no ?deriv(?:ative)?s 3 0
cc-by-nc-sa-3.0 | creative commons attribution non ?commercial share ?alike 3 0
cc-by-nc-3.0 | creative commons attribution non ?commercial 3 0
cc-by-sa-3.0 | creative commons attribution share ?alike 3 0
cc-by-3.0 | creative commons attribution 3 0
cc-by-nc-nd-4.0 | cc by nc nd 4 0
cc-by-nc-sa-4.0 | cc by nc sa 4 0
cc-by-nc-4.0 | cc by nc 4 0
cc-by-nd-4.0 | cc by nd 4 0
cc-by-sa-4.0 | cc by sa 4 0
cc-by-4.0 | cc by 4 0
cc-by-nc-sa-3.0 | cc by nc sa 3 0
cc-by-sa-3.0 | cc by sa 3 0
cc-by-3.0 | cc by 3 0
cc-by-sa-2.5 | cc by sa 2 5
cc-by-2.0 | cc by 2 0
cc-by-nc-nd | cc by nc nd
cc-by-nc-sa | cc by nc sa
cc-by-nd | cc by nd
cc-by-sa | cc by sa
cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nc-sa | creative commons attribution non ?commercial share ?alike
cc-by-nc | creative commons attribution non ?commercial
cc-by-nd | creative commons attribution no ?deriv(?:ative)?s
cc-by-sa | creative commons attribution share ?alike
cc-by | creative commons attribution
cc0-1.0 | cc0 1 0
cc0 | creative commons zero
cc-by-sa | lizenz creative commons namensnennung weitergabe unter gleichen bedingungen
cc-by-nc | creative commons namensnennung nicht kommerziell
cc-by-sa | licence creative commons attribution partage dans les memes conditions
cc-by | licencia creative commons (?:atribucion|reconocimiento)
# sentences that name a license
mit | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e
mit | (?:licensed|released|distributed|available) under (?:the )?expat licen[sc]e
apache-2.0 | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?apache (?:software )?licen[sc]e (?:version |v)?2 ?0
apache-2.0 | (?:licensed|released|distributed|available) under (?:the )?apache 2 0
gpl-3.0 | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[sc]e) (?:version |v)?3
gpl-2.0 | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[sc]e) (?:version |v)?2
gpl | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[sc]e)
lgpl-3.0 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lgpl|lesser general public licen[sc]e) (?:version |v)?3
lgpl-2.1 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lgpl|lesser general public licen[sc]e) (?:version |v)?2 1
lgpl | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lgpl|lesser general public licen[sc]e)
agpl | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:agpl|affero general public licen[sc]e)
bsd-3-clause | (?:licensed|released|distributed|available) under (?:the )?(?:3|three) clause bsd licen[sc]e
bsd-2-clause | (?:licensed|released|distributed|available) under (?:the )?(?:2|two) clause bsd licen[sc]e
bsd | (?:licensed|released|distributed|available) under (?:the |a )?bsd (?:style )?licen[sc]e
mpl-2.0 | (?:licensed|released|distributed|available) under (?:the )?mozilla public licen[sc]e (?:version |v)?2 0
mpl | (?:licensed|released|distributed|available) under (?:the )?mozilla public licen[sc]e
isc | (?:licensed|released|distributed|available) under (?:the )?isc licen[sc]e
epl | (?:licensed|released|distributed|available) under (?:the )?eclipse public licen[sc]e
unlicense | (?:licensed|released|distributed|available) under (?:the )?unlicense
public-domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | this work is in the public domain
mit | veroffentlicht unter der mit lizenz
mit | unter der mit lizenz
gpl | unter der gnu general public license
apache-2.0 | unter der apache lizenz version 2 0
mit | sous (?:la )?licence mit
gpl | sous (?:la )?licence gnu gpl
mit | bajo (?:la )?licencia mit
gpl | bajo (?:la )?licencia gpl
apache-2.0 | bajo (?:la )?licencia apache (?:version )?2 0
# names and versions alone
apache-2.0 | apache licen[sc]e (?:version |v)?2 0
apache-1.1 | apache (?:software )?licen[sc]e (?:version |v)?1 1
apache | apache (?:software )?licen[sc]e
mit | the mit licen[sc]e
mit | mit licen[sc]e
gpl-3.0-or-later | gpl ?v?3 0? ?or later
gpl-2.0-or-later | gpl ?v?2 0? ?or later
gpl-3.0 | (?:gnu )?gpl (?:version |v)?3
gpl-2.0 | (?:gnu )?gpl (?:version |v)?2
gpl-3.0 | gplv3
gpl-2.0 | gplv2
lgpl-3.0 | (?:gnu )?lgpl (?:version |v)?3
lgpl-2.1 | (?:gnu )?lgpl (?:version |v)?2 1
lgpl-3.0 | lgplv3
lgpl-2.1 | lgplv2 1
agpl-3.0 | (?:gnu )?agpl (?:version |v)?3
agpl-3.0 | agplv3
lgpl-3.0 | gnu lesser general public licen[sc]e (?:version |v)?3
lgpl-2.1 | gnu lesser general public licen[sc]e (?:version |v)?2 1
agpl-3.0 | gnu affero general public licen[sc]e (?:version |v)?3
gpl-3.0 | gnu general public licen[sc]e (?:version |v)?3
gpl-2.0 | gnu general public licen[sc]e (?:version |v)?2
lgpl | gnu (?:lesser|library) general public licen[sc]e
agpl | gnu affero general public licen[sc]e
gpl | gnu general public licen[sc]e
gfdl | gnu free documentation licen[sc]e
bsd-3-clause | (?:new|revised|modified|3 clause) bsd licen[sc]e
bsd-2-clause | (?:simplified|freebsd|2 clause) bsd licen[sc]e
bsd-4-clause | (?:original|4 clause) bsd licen[sc]e
bsd | bsd licen[sc]e
isc | isc licen[sc]e
mpl-2.0 | mozilla public licen[sc]e (?:version |v)?2 0
mpl-1.1 | mozilla public licen[sc]e (?:version |v)?1 1
mpl | mozilla public licen[sc]e
epl-2.0 | eclipse public licen[sc]e (?:version |v)?2 0
epl | eclipse public licen[sc]e
eupl | european union public licen[sc]e
cddl | common development and distribution licen[sc]e
artistic | artistic licen[sc]e
bsl-1.0 | boost software licen[sc]e
zlib | zlib (?:libpng )?licen[sc]e
wtfpl | do what the fuck you want to public licen[sc]e
ofl | (?:sil )?open font licen[sc]e
psf | python software foundation licen[sc]e
php | php licen[sc]e
ms-pl | microsoft public licen[sc]e
ms-rl | microsoft reciprocal licen[sc]e
odbl | open database licen[sc]e
postgresql | postgresql licen[sc]e
zpl | zope public licen[sc]e
ncsa | university of illinois ncsa open source licen[sc]e
upl-1.0 | universal permissive licen[sc]e
qpl | q public licen[sc]e
nasa-1.3 | nasa open source agreement
intel | intel open source licen[sc]e
sun-sissl | sun industry standards source licen[sc]e
lppl | latex project public licen[sc]e
cpal-1.0 | common public attribution licen[sc]e
rpl-1.5 | reciprocal public licen[sc]e
nosl | netizen open source licen[sc]e
watcom-1.0 | sybase open watcom public licen[sc]e
apsl-2.0 | apple public source licen[sc]e
ogl | open government licen[sc]e
# claims without a grant
proprietary | proprietary and confidential
proprietary | unauthorized copying of this file via any medium is strictly prohibited
proprietary | no part of this (?:publication|book|work|document) may be reproduced
non-commercial | for non ?commercial (?:use|purposes) only
non-commercial | free for personal use
research-only | for (?:academic|research) (?:use|purposes) only
all-rights-reserved | all rights reserved
all-rights-reserved | alle rechte vorbehalten
all-rights-reserved | tous droits reserves
all-rights-reserved | todos los derechos reservados
"""
#: How far a section's detections are trusted, by its number; the base phrases come first and are trusted fully.
TRUST = [1.0, 0.97, 0.9, 0.9, 0.8, 0.5]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    #: Sections in order, 0 for the base phrases; within a section the longer detection goes first.
    section: int
    trust: float
    #: Words of a base phrase, whose places all count.
    words: int = 0


def keywords_of(pattern: str) -> tuple[str, ...]:
    """The words that every text of the pattern holds: those outside its groups, classes and options; of many the three longest."""
    group = r"\(\?:((?:[^()]|\([^()]*\))*)\)\??"
    # a group that brings its space with it leaves the words beside it whole
    bare = re.sub(group, lambda m: " " if all(x.endswith(" ") for x in m[1].split("|")) or all(x.startswith(" ") for x in m[1].split("|")) else "|", pattern)
    bare = re.sub(r"\[[^]]*\](?:\{[^}]*\})?|\S*\?\S*", "|", bare)
    sure = [w for w in re.findall(r"(?:^|(?<= ))[a-z0-9]{2,}(?= |$)", bare)]
    return tuple(f" {w} " for w in sorted(dict.fromkeys(sure), key=lambda w: (-len(w), w))[:3])


def _rules() -> list[Rule]:
    out = [Rule(label, re.compile(f"(?= {p} )"), tuple(f" {w} " for w in p.split()), 0, 1.0, len(p.split())) for p, label in BASE.items()]
    section = 0
    for line in SIGNATURES.strip().splitlines():
        if line.startswith("#"):
            section += 1
            continue
        label, pattern = line.split(" | ")
        out.append(Rule(label, re.compile(f" {pattern}(?= )"), keywords_of(pattern), section, TRUST[section - 1]))
    return out


RULES = _rules()
KEYWORDS = sorted({k for r in RULES for k in r.keywords})


def line_of(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts as one line of words with a space between and around; where each text's part starts; numbers of words."""
    lower = data + 32 * K.in_class(data, (65, 90)).astype(np.uint8)
    word = ~K.in_class(data, (0, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
    starts, ends, first = K.runs(word, offsets)
    size = ends - starts + 1
    line = K.gather(np.append(lower, np.uint8(32)), starts, size)
    to = np.cumsum(size)
    line[to - 1] = 32
    at = np.concatenate([[0], to])[first]
    # a second space stands between two texts, so that no phrase runs across
    out = np.full(len(line) + len(offsets), 32, np.uint8)
    out[np.arange(len(line)) + 1 + np.repeat(np.arange(len(offsets) - 1), np.diff(at))] = line
    return out.tobytes(), at + np.arange(len(offsets)), np.diff(first)


def kept_of(found: list[tuple[Rule, int, int]]) -> list[tuple[Rule, int, int]]:
    """Detections, in order, without those that lie within one that goes before.

    One that goes before is of an earlier section, or of the same one and longer, or as long and further left, or first in
    the list of rules. What is kept has no member within another that goes before it; those that start at or before a place
    are searched by their greatest end, section by section, so the work grows with n log n."""
    order = sorted(range(len(found)), key=lambda i: (found[i][0].section, found[i][1] - found[i][2], found[i][1], found[i][0].label, i))
    starts = sorted({a for _, a, _ in found})
    place = {a: i for i, a in enumerate(starts)}
    most = [0] * (len(starts) + 1)  # the greatest end among those kept that start at or before a place: a binary indexed tree
    kept = []
    for i in order:
        r, a, b = found[i]
        k, reach = place[a] + 1, 0
        while k:
            reach = max(reach, most[k])
            k &= k - 1
        if reach >= b:
            continue
        kept.append(found[i])
        k = place[a] + 1
        while k <= len(starts):
            most[k] = max(most[k], b)
            k += k & -k
    return kept


def detect(line: str, held: set[str]) -> list[tuple[Rule, int, int]]:
    """Detections that none before them contains. The line has a space at both ends."""
    found = [(r, m.start(), m.end()) for r in RULES if held.issuperset(r.keywords) for m in r.pattern.finditer(line)]
    return kept_of([(r, a, a + len(" ".join(k.strip() for k in r.keywords)) + 1 if r.words else b) for r, a, b in found])


def scan_text(line: str, held: set[str]) -> dict | None:
    found = detect(line, held)
    if not found:
        return None
    # the numbers of words before places, from one count over the line
    spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 32)
    word = lambda at: int(np.searchsorted(spaces, at))
    base = sorted((word(a), r.label) for r, a, b in found if r.words)
    miss = 1.0
    for r, _, _ in found:
        miss *= 1 - 0.97 * r.trust
    return {
        "n_base": len(base),
        "first_word": base[0][0] if base else None,
        "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(sorted({x for _, x in base})),
        "labels": ",".join(sorted({r.label for r, _, _ in found})),
        "score": round(1 - miss, 6),
        "spans": [{"label": r.label, "first": word(a), "words": word(b) - word(a)} for r, a, b in found],
    }


FIELDS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))),
    ]
)
NOTHING = {"n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the detections' spans in words."""
    bound_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches):
            line, at, n_words = line_of(*K.buffer(K.column(b, "text")))
            held: dict[int, set[str]] = {}
            for keyword in KEYWORDS:
                k = keyword.encode()
                i = line.find(k)
                while i >= 0:
                    d = int(np.searchsorted(at, i, side="right")) - 1
                    held.setdefault(d, set()).add(keyword)
                    i = line.find(k, int(at[d + 1]) if d + 1 < len(at) else len(line))
            rows = [NOTHING] * b.num_rows
            for d, words in held.items():
                text = line[at[d] : at[d + 1]].decode("utf-8", "replace") + " "
                rows[d] = scan_text(text, words) or NOTHING
            columns = [K.column(b, "doc_id"), pa.array(n_words.astype(np.int64))]
            columns += [pa.array([r[f.name] for r in rows], f.type) for f in list(FIELDS)[2:]]
            yield pa.RecordBatch.from_arrays(columns, schema=FIELDS)

    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,words:long>>"
    return text_rows(docs).mapInArrow(run, kinds)


def report(docs: DataFrame) -> DataFrame:
    """What op2 returns."""
    return scan(docs).drop("spans")
