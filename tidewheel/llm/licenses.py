"""License scans by ordered signature rules, in SQL functions only.

A text becomes its words (A-Z lower-cased). A keyword prefilter on the raw text lets most texts pass by. The
words of the others are numbered and joined ("0#under 1#the 2#mit"), so that a match tells its place by itself;
long texts are taken in chunks of CHUNK words, with REACH more on both sides, which is more than any signature
is long: what may contain a detection is in its chunk. Signatures share keywords; those of a keyword run only
where it occurs, each a literal regular expression over whole words, at every place where it may begin.

A detection is suppressed if another one's interval contains its own and that one comes first: a smaller
priority number, then a longer interval, then the earlier rule. What stays gives the labels, and the greatest
confidence is the score. Base phrases are rules that keep their labels whatever contains them.

Everything is one row-wise expression: no shuffle, no Python, nothing kept between rows. Time and memory are
linear in a text's length; within a chunk, detections are compared with one another.

Rows: null and empty texts have no words, places or labels (first_word and last_word null, labels empty,
score 0); long texts are scanned whole; repeated rows are each reported; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower, table


class Rule(NamedTuple):
    label: str
    keywords: tuple[str, ...]
    pattern: str
    priority: int
    confidence: float
    base: bool = False


#: Words of a chunk, and how far a signature may reach.
CHUNK, REACH = 512, 64
#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Confidence of each priority.
CONFIDENCE = {0: 0.9, 1: 0.99, 2: 0.95, 3: 0.9, 4: 0.8, 5: 0.7, 6: 0.6, 7: 0.5, 8: 0.4, 9: 0.3}
#: Fragments that signatures share.
FRAGMENTS = {
    "v": "(?: version| v| ver)?",
    "lic": "licen[cs]e",
    "under": "(?:licensed|released|distributed|redistributed|published|available|provided|covered|use|used|shared|offered) (?:for use )?(?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?",
    "spdx": "spdx license identifier",
    "or": "(?: or(?: at your option)?(?: any)? later(?: version)?)?",
    "see": "(?:see the|governed by the|subject to the|the terms of the|accompanying|bound by the) ",
}
#: Ordered signatures: label, priority, keywords (one of them is in whatever matches), pattern over words.
#: 1 tags, 2 license texts and grants, 3 headers and grants by name, 4 names with versions, 5 names, 6 to 9 notices.
SIGNATURES = """
mit | 1 | spdx | {spdx} mit(?! 0)
mit | 2 | granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 2 | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 2 | sublicense | rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | 3 | mit,expat | {under}(?:mit|mit x11|x11 mit|expat|expat mit)(?: {lic})?
mit | 4 | mit | (?:the )?mit(?: expat| x11)? {lic}
mit | 5 | mit | {lic} mit
mit | 4 | opensource | opensource org licenses mit
mit-0 | 1 | spdx | {spdx} mit 0
mit-0 | 4 | mit | mit (?:no attribution|0)(?: {lic})?
mit-0 | 3 | mit | {under}mit (?:no attribution|0)(?: {lic})?
x11 | 1 | spdx | {spdx} x11
x11 | 4 | x11 | x11 {lic}
isc | 1 | spdx | {spdx} isc
isc | 2 | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 3 | isc | {under}isc(?: {lic})?
isc | 4 | isc | isc {lic}
0bsd | 1 | spdx | {spdx} 0bsd
0bsd | 4 | 0bsd,zero | (?:0bsd|zero clause bsd|bsd zero clause)(?: {lic})?
bsd-2 | 1 | spdx | {spdx} bsd 2 clause
bsd-2 | 3 | bsd | {under}(?:simplified|freebsd|2 clause|two clause) bsd(?: {lic})?
bsd-2 | 3 | bsd | {under}bsd (?:2|two) clause(?: {lic})?
bsd-2 | 4 | bsd | (?:simplified|freebsd|2 clause|two clause) bsd(?: {lic})?
bsd-2 | 4 | bsd | bsd (?:2|two) clause(?: {lic})?
bsd-3 | 1 | spdx | {spdx} bsd 3 clause
bsd-3 | 2 | endorse | neither the name of (?:[^ ]+ ){{1,12}}nor the names of (?:its|their|any|other) (?:[^ ]+ ){{0,3}}may be used to endorse or promote products derived from this software
bsd-3 | 3 | bsd | {under}(?:new|revised|modified|3 clause|three clause) bsd(?: {lic})?
bsd-3 | 3 | bsd | {under}bsd (?:3|three) clause(?: {lic})?
bsd-3 | 4 | bsd | (?:new|revised|modified|3 clause|three clause) bsd(?: {lic})?
bsd-3 | 4 | bsd | bsd (?:3|three) clause(?: {lic})?
bsd-4 | 1 | spdx | {spdx} bsd 4 clause
bsd-4 | 2 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-4 | 4 | bsd | (?:original|4 clause|four clause) bsd(?: {lic})?
bsd-4 | 4 | bsd | bsd (?:4|four) clause(?: {lic})?
bsd | 2 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | 3 | bsd | {under}bsd(?: style)?(?: {lic})?
bsd | 5 | bsd | bsd(?: style)? {lic}
bsd | 5 | bsd | {lic} bsd
apache-1.0 | 1 | spdx | {spdx} apache 1 0
apache-1.1 | 1 | spdx | {spdx} apache 1 1
apache-1.1 | 3 | apache | {under}apache(?: software)? {lic}{v} 1 1
apache-1.1 | 4 | apache | apache(?: software)? {lic}{v} 1 1
apache-2 | 1 | spdx | {spdx} apache 2 0
apache-2 | 2 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | 2 | reproduction | terms and conditions for use reproduction and distribution
apache-2 | 3 | apache | {under}apache(?: software)?(?: {lic})?{v} 2(?: 0)?
apache-2 | 4 | apache | apache(?: software)?(?: {lic})?{v} 2(?: 0)?
apache-2 | 4 | asl | asl 2 0
apache-2 | 4 | apache | apache org licenses license 2 0
apache-2 | 5 | apache2 | {lic} apache2
apache | 3 | apache | {under}apache(?: software)? {lic}
apache | 5 | apache | apache(?: software)? {lic}
gpl-1 | 1 | spdx | {spdx} gpl 1 0(?: only| or later)?
gpl-1 | 4 | general | gnu general public {lic}{v} 1(?: 0)?
gpl-2 | 1 | spdx | {spdx} gpl 2 0(?: only| or later)?
gpl-2 | 2 | general | under the terms of the gnu general public license as published by the free software foundation either version 2 of the license
gpl-2 | 3 | general | {under}gnu general public {lic}{v} 2(?: 0)?{or}
gpl-2 | 3 | gpl | {under}(?:gnu )?gpl{v} 2(?: 0)?
gpl-2 | 3 | gplv2 | {under}(?:gnu )?gplv2
gpl-2 | 4 | general | gnu general public {lic}{v} 2(?: 0)?{or}
gpl-2 | 4 | gpl | gnu gpl{v} 2(?: 0)?
gpl-2 | 5 | gplv2 | (?:gnu )?gplv2
gpl-3 | 1 | spdx | {spdx} gpl 3 0(?: only| or later)?
gpl-3 | 2 | general | under the terms of the gnu general public license as published by the free software foundation either version 3 of the license
gpl-3 | 2 | general | this is free software and you are welcome to redistribute it under certain conditions (?:[^ ]+ ){{0,8}}general public license
gpl-3 | 3 | general | {under}gnu general public {lic}{v} 3(?: 0)?{or}
gpl-3 | 3 | gpl | {under}(?:gnu )?gpl{v} 3(?: 0)?
gpl-3 | 3 | gplv3 | {under}(?:gnu )?gplv3
gpl-3 | 4 | general | gnu general public {lic}{v} 3(?: 0)?{or}
gpl-3 | 4 | gpl | gnu gpl{v} 3(?: 0)?
gpl-3 | 5 | gplv3 | (?:gnu )?gplv3
gpl | 2 | general | you should have received a copy of the gnu general public license along with this program
gpl | 2 | fitness | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
gpl | 3 | general | {under}(?:gnu )?general public {lic}
gpl | 3 | gpl | {under}(?:gnu )?gpl(?: {lic})?
gpl | 4 | general | gnu general public {lic}
gpl | 5 | gpl | gnu gpl
gpl | 5 | gpl | gpl {lic}
lgpl-2 | 1 | spdx | {spdx} lgpl 2 0(?: only| or later)?
lgpl-2 | 4 | library | gnu library general public {lic}{v} 2(?: 0)?
lgpl-2.1 | 1 | spdx | {spdx} lgpl 2 1(?: only| or later)?
lgpl-2.1 | 2 | lesser | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license
lgpl-2.1 | 4 | lesser | gnu lesser general public {lic}{v} 2 1
lgpl-2.1 | 5 | lgpl | (?:gnu )?lgpl{v} 2 1
lgpl-3 | 1 | spdx | {spdx} lgpl 3 0(?: only| or later)?
lgpl-3 | 4 | lesser | gnu lesser general public {lic}{v} 3(?: 0)?
lgpl-3 | 5 | lgpl | (?:gnu )?lgpl{v} 3(?: 0)?
lgpl | 3 | lesser | {under}gnu lesser general public {lic}
lgpl | 3 | lgpl | {under}(?:gnu )?lgpl(?:v2|v3)?
lgpl | 4 | lesser | gnu lesser general public {lic}
lgpl | 4 | library | gnu library general public {lic}
lgpl | 5 | lgpl | lgpl {lic}
agpl-3 | 1 | spdx | {spdx} agpl 3 0(?: only| or later)?
agpl-3 | 2 | remotely | all users interacting with it remotely through a computer network
agpl-3 | 4 | affero | gnu affero general public {lic}{v} 3(?: 0)?
agpl-3 | 5 | agplv3 | (?:gnu )?agplv3
agpl | 3 | affero | {under}(?:gnu )?affero general public {lic}
agpl | 3 | agpl | {under}(?:gnu )?agpl
agpl | 4 | affero | (?:gnu )?affero general public {lic}
gfdl-1.1 | 1 | spdx | {spdx} gfdl 1 1(?: only| or later)?
gfdl-1.2 | 1 | spdx | {spdx} gfdl 1 2(?: only| or later)?
gfdl-1.2 | 4 | documentation | gnu free documentation {lic}{v} 1 2
gfdl-1.3 | 1 | spdx | {spdx} gfdl 1 3(?: only| or later)?
gfdl-1.3 | 4 | documentation | gnu free documentation {lic}{v} 1 3
gfdl | 2 | invariant | with no invariant sections no front cover texts and no back cover texts
gfdl | 3 | documentation | {under}gnu free documentation {lic}
gfdl | 4 | documentation | gnu free documentation {lic}
mpl-1.1 | 1 | spdx | {spdx} mpl 1 1
mpl-1.1 | 2 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1 | 4 | mozilla | mozilla public {lic}{v} 1 1
mpl-2 | 1 | spdx | {spdx} mpl 2 0
mpl-2 | 2 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 | 4 | mozilla | mozilla public {lic}{v} 2(?: 0)?
mpl-2 | 5 | mpl | mpl{v} 2 0
mpl | 3 | mozilla | {under}mozilla public {lic}
mpl | 4 | mozilla | mozilla public {lic}
epl-1 | 1 | spdx | {spdx} epl 1 0
epl-1 | 4 | eclipse | eclipse public {lic}{v} 1(?: 0)?
epl-2 | 1 | spdx | {spdx} epl 2 0
epl-2 | 4 | eclipse | eclipse public {lic}{v} 2(?: 0)?
epl | 2 | accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license
epl | 5 | eclipse | eclipse public {lic}
edl-1 | 4 | eclipse | eclipse distribution {lic}{v} 1 0
cddl-1 | 1 | spdx | {spdx} cddl 1 [01]
cddl-1 | 2 | development | subject to the terms of the common development and distribution license
cddl-1 | 4 | development | common development and distribution {lic}(?:{v} 1(?: [01])?)?
cddl-1 | 5 | cddl | (?:{under}|{lic} )cddl
cpl-1 | 1 | spdx | {spdx} cpl 1 0
cpl-1 | 4 | common | common public {lic}(?:{v} 1(?: 0)?)?
cpal-1 | 1 | spdx | {spdx} cpal 1 0
cpal-1 | 4 | attribution | common public attribution {lic}(?:{v} 1(?: 0)?)?
ipl-1 | 1 | spdx | {spdx} ipl 1 0
ipl-1 | 4 | ibm | ibm public {lic}(?:{v} 1(?: 0)?)?
cc-by | 1 | spdx | {spdx} cc by [1-4] [05]
cc-by | 3 | cc | {under}cc by(?: [1-4] [05])?(?: {lic})?
cc-by | 4 | creative | creative commons attribution(?: [1-4] [05])?(?: international| generic| unported)?(?: {lic})?
cc-by | 4 | creativecommons | creativecommons org licenses by(?: [1-4] [05])?
cc-by | 5 | cc | cc by [1-4] [05]
cc-by-sa | 1 | spdx | {spdx} cc by sa [1-4] [05]
cc-by-sa | 3 | cc | {under}cc by sa(?: [1-4] [05])?(?: {lic})?
cc-by-sa | 4 | creative | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| generic| unported)?(?: {lic})?
cc-by-sa | 4 | creativecommons | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-sa | 5 | cc | cc by sa
cc-by-nc | 1 | spdx | {spdx} cc by nc [1-4] [05]
cc-by-nc | 3 | cc | {under}cc by nc(?: [1-4] [05])?(?: {lic})?
cc-by-nc | 4 | creative | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| generic| unported)?(?: {lic})?
cc-by-nc | 4 | creativecommons | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd | 1 | spdx | {spdx} cc by nd [1-4] [05]
cc-by-nd | 3 | cc | {under}cc by nd(?: [1-4] [05])?(?: {lic})?
cc-by-nd | 4 | creative | creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])?
cc-by-nd | 5 | cc | cc by nd
cc-by-nc-sa | 1 | spdx | {spdx} cc by nc sa [1-4] [05]
cc-by-nc-sa | 3 | cc | {under}cc by nc sa(?: [1-4] [05])?(?: {lic})?
cc-by-nc-sa | 4 | creative | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc-sa | 4 | creativecommons | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-sa | 5 | cc | cc by nc sa
cc-by-nc-nd | 1 | spdx | {spdx} cc by nc nd [1-4] [05]
cc-by-nc-nd | 3 | cc | {under}cc by nc nd(?: [1-4] [05])?(?: {lic})?
cc-by-nc-nd | 4 | creative | creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] [05])?
cc-by-nc-nd | 5 | cc | cc by nc nd
cc0 | 1 | spdx | {spdx} cc0 1 0
cc0 | 3 | cc0 | {under}cc0(?: 1 0)?(?: universal)?
cc0 | 2 | waived | has waived all copyright and related or neighboring rights
cc0 | 4 | creative | creative commons (?:zero|0|cc0)(?: 1 0)?(?: universal)?
cc0 | 4 | creativecommons | creativecommons org publicdomain zero(?: 1 0)?
cc0 | 5 | cc0 | cc0 1 0
cc-pdm | 4 | creativecommons | creativecommons org publicdomain mark 1 0
cc-sampling | 4 | creative | creative commons sampling plus(?: 1 0)?
public-domain | 2 | domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain | 4 | domain | (?:is|are|work of|lies) in the public domain
public-domain | 5 | domain | (?:in|into|to) the public domain
unlicense | 1 | spdx | {spdx} unlicense
unlicense | 2 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 3 | unlicense | {under}unlicense
unlicense | 5 | unlicense | (?:the|{lic}) unlicense
wtfpl | 1 | spdx | {spdx} wtfpl
wtfpl | 2 | fuck | you just do what the fuck you want to
wtfpl | 3 | fuck | {under}do what the fuck you want to public {lic}
wtfpl | 3 | wtfpl | {under}wtfpl
wtfpl | 4 | fuck | do what the fuck you want to public {lic}
wtfpl | 5 | wtfpl | {lic} wtfpl
zlib | 1 | spdx | {spdx} zlib
zlib | 2 | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 3 | zlib | {under}zlib(?: libpng)?(?: {lic})?
zlib | 4 | zlib | zlib(?: libpng)? {lic}
libpng | 1 | spdx | {spdx} libpng(?: 2 0)?
libpng | 4 | libpng | libpng {lic}
bzip2 | 1 | spdx | {spdx} bzip2 1 0 [56]
curl | 1 | spdx | {spdx} curl
artistic-1 | 1 | spdx | {spdx} artistic 1 0(?: perl| cl8)?
artistic-1 | 4 | artistic | artistic {lic}{v} 1(?: 0)?
artistic-2 | 1 | spdx | {spdx} artistic 2 0
artistic-2 | 4 | artistic | artistic {lic}{v} 2(?: 0)?
artistic | 2 | perl | you can redistribute it and or modify it under the same terms as perl itself
artistic | 3 | artistic | {under}(?:perl )?artistic {lic}
artistic | 5 | artistic | artistic {lic}
bsl-1 | 1 | spdx | {spdx} bsl 1 0
bsl-1 | 3 | boost | (?:distributed|licensed|released) under the boost software {lic}(?:{v} 1(?: 0)?)?
bsl-1 | 4 | boost | boost software {lic}(?:{v} 1(?: 0)?)?
busl-1.1 | 1 | spdx | {spdx} busl 1 1
busl-1.1 | 3 | business | {under}business source {lic}(?:{v} 1 1)?
busl-1.1 | 4 | business | business source {lic}(?:{v} 1 1)?
sspl-1 | 1 | spdx | {spdx} sspl 1 0
sspl-1 | 4 | server | server side public {lic}(?:{v} 1(?: 0)?)?
elastic-2 | 1 | spdx | {spdx} elastic 2 0
elastic-2 | 4 | elastic | elastic {lic}(?:{v} 2(?: 0)?)?
polyform-noncommercial | 4 | polyform | polyform noncommercial {lic}(?: 1 0 0)?
polyform-small-business | 4 | polyform | polyform small business {lic}(?: 1 0 0)?
commons-clause | 4 | clause | commons clause(?: {lic} condition)?(?:{v} 1 0)
eupl-1.1 | 1 | spdx | {spdx} eupl 1 1
eupl-1.1 | 4 | european | european union public licen[cs]e{v} 1 1
eupl-1.2 | 1 | spdx | {spdx} eupl 1 2
eupl-1.2 | 4 | european | european union public licen[cs]e{v} 1 2
eupl | 5 | european | european union public licen[cs]e
cecill-2.1 | 1 | spdx | {spdx} cecill 2 1
cecill | 4 | cecill | (?:{under}|{lic} )cecill
ofl-1.1 | 1 | spdx | {spdx} ofl 1 1
ofl-1.1 | 2 | font | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | 4 | font | sil open font {lic}(?:{v} 1 1)?
odbl-1 | 1 | spdx | {spdx} odbl 1 0
odbl-1 | 3 | database | {under}open (?:data commons open )?database {lic}
odbl-1 | 4 | database | open (?:data commons open )?database {lic}
odc-by-1 | 1 | spdx | {spdx} odc by 1 0
odc-by-1 | 4 | attribution | open data commons attribution {lic}
pddl-1 | 1 | spdx | {spdx} pddl 1 0
pddl-1 | 4 | dedication | public domain dedication and {lic}
cdla-permissive | 1 | spdx | {spdx} cdla permissive [12] 0
cdla-permissive | 4 | community | community data {lic} agreement permissive
cdla-sharing | 1 | spdx | {spdx} cdla sharing 1 0
cdla-sharing | 4 | community | community data {lic} agreement sharing
ogl-uk | 4 | government | open government {lic}{v} [123](?: 0)?
ogl-uk | 5 | government | open government {lic}
etalab-2 | 4 | ouverte | licence ouverte(?: open licence)?(?:{v} 2 0)?
python-2 | 1 | spdx | {spdx} (?:python|psf) 2 0
python-2 | 3 | psf,python | {under}(?:psf|python software foundation|python) {lic}
python-2 | 4 | psf,python | (?:psf|python software foundation) {lic}
php-3 | 1 | spdx | {spdx} php 3 0(?:1)?
php-3 | 4 | php | php {lic}{v} 3(?: 0| 01)?
ruby | 1 | spdx | {spdx} ruby
ruby | 4 | ruby | ruby {lic}
ruby | 3 | ruby | (?:under the same terms as|licensed like) ruby
vim | 1 | spdx | {spdx} vim
vim | 4 | vim | vim {lic}
postgresql | 1 | spdx | {spdx} postgresql
postgresql | 2 | fee | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
postgresql | 4 | postgresql | postgresql {lic}
openssl | 1 | spdx | {spdx} openssl
openssl | 2 | openssl | this product includes software developed by the openssl project
openssl | 4 | openssl | openssl {lic}
tcl | 1 | spdx | {spdx} tcl
ntp | 1 | spdx | {spdx} ntp
hpnd | 1 | spdx | {spdx} hpnd
hpnd | 2 | fee | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
ms-pl | 1 | spdx | {spdx} ms pl
ms-pl | 4 | microsoft | microsoft public {lic}
ms-rl | 1 | spdx | {spdx} ms rl
ms-rl | 4 | microsoft | microsoft reciprocal {lic}
osl-3 | 1 | spdx | {spdx} osl 3 0
osl-3 | 4 | open | open software {lic}{v} 3(?: 0)?
afl-3 | 1 | spdx | {spdx} afl 3 0
afl-3 | 4 | academic | academic free {lic}{v} 3(?: 0)?
ncsa | 1 | spdx | {spdx} ncsa
ncsa | 4 | illinois | university of illinois(?: ncsa)? open source {lic}
ecl-2 | 1 | spdx | {spdx} ecl 2 0
ecl-2 | 4 | educational | educational community {lic}(?:{v} 2(?: 0)?)?
upl-1 | 1 | spdx | {spdx} upl 1 0
upl-1 | 4 | universal | universal permissive {lic}(?:{v} 1(?: 0)?)?
qpl-1 | 1 | spdx | {spdx} qpl 1 0
qpl-1 | 4 | public | q public {lic}
sgi-b-2 | 4 | sgi | sgi free software {lic} b(?:{v} 2 0)?
w3c | 1 | spdx | {spdx} w3c
w3c | 4 | w3c | w3c software(?: notice and)? {lic}
unicode | 4 | unicode | unicode(?: terms of use|(?: inc)? {lic} agreement| {lic} v3)
intel | 4 | intel | intel (?:open source|simplified software) {lic}
nvidia | 4 | nvidia | nvidia (?:software|source code|open model) {lic}
json | 2 | evil | the software shall be used for good not evil
json | 1 | spdx | {spdx} json
beerware | 2 | beer | you can buy me a beer in return
beerware | 4 | beer | beer ?ware {lic}
rail | 3 | responsible,rail | {under}(?:bigscience |creativeml |bigcode )?(?:open ?rail(?: m)?|(?:open )?responsible ai {lic})
rail | 4 | responsible,rail | (?:(?:open )?responsible ai {lic}|{lic} openrail(?: m)?|openrail(?: m)? {lic})
llama-community | 4 | llama | llama(?: 2| 3| 3 [123])? community {lic}(?: agreement)?
gemma | 4 | gemma | gemma terms of use
mulan-2 | 1 | spdx | {spdx} mulanpsl 2 0
mulan-2 | 4 | mulan | mulan psl(?: v2|{v} 2)
anti-996 | 4 | anti | anti 996 {lic}
proprietary | 2 | proprietary | (?:this|the) (?:software|file|document|material) is (?:the )?(?:confidential and )?proprietary(?: and confidential)?
proprietary | 2 | unauthorized | unauthorized (?:copying|reproduction|use|distribution)(?: or (?:copying|reproduction|use|distribution))? of this (?:file|software|document|work|publication|material)
proprietary | 2 | reproduced,copied | (?:may|can) not be (?:reproduced|copied)(?: or (?:distributed|transmitted))?(?: [^ ]+){{0,8}} without (?:the )?(?:prior |express |written ){{1,3}}(?:consent|permission)
proprietary | 4 | eula | end user {lic} agreement eula
eula | 5 | agreement | end user {lic} agreement
no-warranty | 7 | warrant | (?:provided|distributed) (?:on an )?as is(?: basis)? without (?:any )?warrant(?:y|ies)
no-warranty | 7 | warranties | without warranties or conditions of any kind
no-warranty | 7 | merchantability | implied warranties of merchantability(?: and fitness for a particular purpose)?
all-rights-reserved | 6 | reserved | all rights reserved
some-rights-reserved | 6 | reserved | some rights reserved
copyright-notice | 8 | copyright | copyright (?:c |©)?(?:19|20)[0-9]{{2}}(?: (?:19|20)[0-9]{{2}}){{0,20}}
copyright-notice | 9 | copyright | copyright (?:c )?(?:the |by )?(?:authors|contributors|holders)
license-mention | 9 | licen | (?:this|the) (?:work|software|text|file|content|document) is (?:licensed|licenced)
license-mention | 9 | licen | {see}(?:file )?{lic}(?: file)?(?: for (?:more )?details)?
"""


def _signature(line: str) -> Rule:
    label, priority, keywords, pattern = (x.strip() for x in line.split(" | ", 3))
    return Rule(label, tuple(keywords.split(",")), pattern.format(**FRAGMENTS), int(priority), CONFIDENCE[int(priority)])


def rules() -> list[Rule]:
    """Base phrases first, then the signatures; this is their order."""
    base = [Rule(label, (phrase.split()[-2],), phrase, 0, CONFIDENCE[0], True) for phrase, label in BASE]
    return base + [_signature(line) for line in SIGNATURES.strip().splitlines()]


#: Negated sets of several ranges are many times slower in Java than the ranges that are left.
_GAP, _WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
#: The prefilter: whatever a rule matches holds one of these strings (in lower case), or a short name that stands alone.
STEMS = ("licen", "copyright", "reserved", "warrant", "permission", "permitted", "redistribut", "gpl", "cddl", "cecill", "bsd", "apache", "zlib", "cc0", "wtfpl", "fuck", "perl", "ruby", "copied", "expat", "terms", "evil", "beer", "rail", "domain", "spdx", "proprietary", "unauthorized", "reproduc", "clause", "mulan", "unencumbered", "remotely", "invariant", "endorse", "advertising", "misrepresented", "opensource", "openssl", "neighboring", "creative", "x11")
SHORT = rf"(?:^|{_GAP})(?:[mM](?:[iI][tT]|[pP][lL])|[iI][sS][cC]|[aA][sS][lL]|[cC][cC]{_GAP}+[bB][yY])(?:$|{_GAP})"


def may_hold(text: Column, low: Column, stems: tuple[str, ...] = STEMS, short: str = SHORT) -> Column:
    """Whether a text passes the prefilter. low: the text in lower case."""
    found = F.rlike(text, F.lit(short))
    for stem in stems:
        found = found | F.contains(low, F.lit(stem))
    return found


def normal_words(text: Column) -> Column:
    """The words of a text as an array, empty where there is none."""
    joined = F.trim(F.regexp_replace(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def _chunks(words: Column, chunk: int) -> Column:
    """Numbered words, joined, of each chunk and REACH words around it: (number, text)."""

    def one(c: Column) -> Column:
        start = F.greatest(c * chunk - REACH, F.lit(0))
        some = F.slice(words, start + 1, F.least(F.size(words), c * chunk + chunk + REACH) - start)
        said = F.transform(some, lambda w, i: F.concat((start + i).cast("string"), F.lit("#"), w))
        return F.struct(c.alias("c"), F.concat(F.lit(" "), F.array_join(said, " "), F.lit(" #")).alias("text"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / F.lit(chunk)).cast("int")), one)


def _numbered(pattern: str) -> str:
    """A rule's pattern over numbered words, at every place where one begins."""
    return r" (?=([0-9]+#" + f"(?:{pattern})".replace("[^ ]", "[^%]").replace(" ?", "%?").replace(" ", " [0-9]+#").replace("%?", "(?: [0-9]+#)?").replace("[^%]", "[^ ]") + ") )"


def _detections(text: Column, given: list[Rule]) -> Column:
    """All detections in a chunk: array of struct(rule, start, end)."""
    groups: dict[tuple[str, ...], list[tuple[int, Rule]]] = {}
    for i, r in enumerate(given):
        groups.setdefault(r.keywords, []).append((i, r))

    def found(i: int, r: Rule) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(_numbered(r.pattern)), F.lit(1)), lambda m: F.struct(F.lit(i).alias("rule"), m.alias("match")))

    live = []
    for keywords, own in groups.items():
        has = F.contains(text, F.lit(keywords[0]))
        for k in keywords[1:]:
            has = has | F.contains(text, F.lit(k))
        live.append(F.when(has, F.concat(*[found(i, r) for i, r in own])))
    number = lambda m, at: F.substring_index(F.substring_index(m, " ", at), "#", 1).cast("int")
    return F.transform(F.flatten(F.filter(F.array(*live), lambda x: x.isNotNull())), lambda d: F.struct(d["rule"].alias("rule"), number(d["match"], 1).alias("start"), (number(d["match"], -1) + 1).alias("end")))


def _described(found: Column, given: list[Rule]) -> Column:
    """Detections with what their rules say."""
    fields = {n: F.array(*[F.lit(getattr(r, n)) for r in given]) for n in ("label", "priority", "confidence", "base")}
    return F.transform(found, lambda d: F.struct(*[F.get(values, d["rule"]).alias(n) for n, values in fields.items()], d["rule"].alias("rule"), d["start"].cast("bigint").alias("start"), d["end"].cast("bigint").alias("end")))


def unsuppressed(found: Column) -> Column:
    """The detections that no other one which comes first contains."""

    def first(e: Column, d: Column) -> Column:
        within = (e["start"] <= d["start"]) & (d["end"] <= e["end"])
        longer, same = (e["end"] - e["start"]) > (d["end"] - d["start"]), (e["end"] - e["start"]) == (d["end"] - d["start"])
        return within & ((e["priority"] < d["priority"]) | ((e["priority"] == d["priority"]) & (longer | (same & (e["rule"] < d["rule"])))))

    return F.filter(found, lambda d: ~F.exists(found, lambda e: first(e, d)))


def scan_licenses(docs: DataFrame, given: list[Rule] | None = None, stems: tuple[str, ...] = STEMS, short: str = SHORT, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, base (detections of base phrases) and kept (detections that aren't suppressed)."""
    given = given or rules()
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.lower(text).alias("low"))
    words = low.select("doc_id", F.regexp_count("text", F.lit(_WORD + "+")).cast("bigint").alias("n_words"), F.when(may_hold(F.col("text"), F.col("low"), stems, short), normal_words(F.col("text"))).alias("words"))
    chunks = words.select("doc_id", "n_words", F.when(F.size("words") > 0, _chunks(F.col("words"), chunk)).alias("chunks"))
    found = chunks.select("doc_id", "n_words", F.transform("chunks", lambda c: F.struct(c["c"].alias("c"), _detections(c["text"], given).alias("found"))).alias("chunks"))
    told = found.select("doc_id", "n_words", F.transform(F.filter("chunks", lambda c: F.size(c["found"]) > 0), lambda c: F.struct(c["c"].alias("c"), _described(c["found"], given).alias("found"))).alias("chunks"))
    own = lambda c, part: F.filter(part, lambda d: F.floor(d["start"] / F.lit(chunk)) == c["c"])
    kept = F.coalesce(F.flatten(F.transform("chunks", lambda c: own(c, unsuppressed(c["found"])))), F.array().cast(_NONE))
    base = F.coalesce(F.flatten(F.transform("chunks", lambda c: own(c, F.filter(c["found"], lambda d: d["base"])))), F.array().cast(_NONE))
    return told.select("doc_id", "n_words", base.alias("base"), kept.alias("kept"))


_NONE = "array<struct<label:string,priority:int,confidence:double,base:boolean,rule:int,start:bigint,end:bigint>>"


def query_of(docs: DataFrame) -> DataFrame:
    """The scan's digest: counts and places of base phrases, labels and score of every row."""
    found = scan_licenses(docs)
    labels = lambda c: F.transform(c, lambda d: d["label"])
    joined = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    starts = F.transform("base", lambda d: d["start"])
    best = F.array_max(F.transform(F.concat("base", "kept"), lambda d: d["confidence"]))
    return found.select("doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(labels(F.col("base"))).alias("base_labels"), joined(F.concat(labels(F.col("base")), labels(F.col("kept")))).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_of(table(spark, sf_dir, "documents"))
