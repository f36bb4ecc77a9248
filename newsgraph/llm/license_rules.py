"""Signatures of licences, written by hand: label | priority | keywords | pattern.

A pattern is matched on text in ASCII lower case; a space in it stands for any white space, and ``~`` for a short gap
of white space, punctuation, ``the`` or ``version``.  A rule is tried where one of its keywords
(between commas; a space is any white space) occurs, so each alternative of its pattern must hold one.  Priorities: 95
full text or exact identifier, 85 notice, 75 name with version, 60 name, 40 mention, 20 weak hint.
"""

RULES = r"""
spdx-tag | 20 | spdx | spdx-license-identifier
apache-2.0 | 95 | spdx | spdx-license-identifier: \(?apache-2\.0
apache-2.0 | 85 | apache | licensed under (?:the )?apache license,? (?:version )?2(?:\.0)?
apache-2.0 | 75 | apache | apache (?:software )?license,?~2(?:\.0)?
apache-2.0 | 75 | apache | apache-2(?:\.0)?\b
apache-2.0 | 85 | apache | www\.apache\.org/licenses/license-2\.0
apache-2.0 | 60 | asl | \basl 2\.0\b
apache-1.1 | 75 | apache | apache (?:software )?license,?~1\.1
apache-1.0 | 75 | apache | apache (?:software )?license,?~1\.0
apache | 40 | apache | apache (?:software )?licen[sc]ed?
mit | 95 | spdx | spdx-license-identifier: \(?mit\b
mit | 95 | permission | permission is hereby granted, free of charge, to any person obtaining a copy of this software
mit | 85 | mit | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?mit(?:/x11)? licen[sc]e
mit | 75 | mit | \bthe mit licen[sc]e(?: \(mit\))?
mit | 60 | mit | \bmit(?:/x11)?[ -]licen[sc]ed?
mit | 75 | opensource.org | opensource\.org/licenses?/mit
mit | 60 | expat | \bexpat licen[sc]e
mit-0 | 75 | mit-0 | \bmit-0\b
mit-0 | 75 | attribution | mit no attribution
x11 | 60 | x11 | \bx11 licen[sc]e
x11 | 75 | consortium | except as contained in this notice, the name of the x consortium
isc | 95 | spdx | spdx-license-identifier: \(?isc\b
isc | 95 | permission | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
isc | 75 | isc | (?:licensed|released|available) under (?:the )?isc licen[sc]e
isc | 60 | isc | \bisc licen[sc]e
0bsd | 75 | 0bsd | \b0bsd\b
0bsd | 75 | zero-clause | (?:bsd )?zero-clause (?:bsd )?licen[sc]e
bsd-2-clause | 95 | spdx | spdx-license-identifier: \(?bsd-2-clause
bsd-2-clause | 75 | bsd | bsd[ -](?:2|two)[ -]clause
bsd-2-clause | 75 | bsd | (?:2|two)[ -]clause bsd
bsd-2-clause | 75 | simplified, freebsd | (?:simplified|freebsd) (?:bsd )?licen[sc]e
bsd-3-clause | 95 | spdx | spdx-license-identifier: \(?bsd-3-clause
bsd-3-clause | 75 | bsd | bsd[ -](?:3|three)[ -]clause
bsd-3-clause | 75 | bsd | (?:3|three)[ -]clause bsd
bsd-3-clause | 75 | bsd | (?:new|modified|revised) bsd licen[sc]e
bsd-3-clause | 85 | endorse | may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | 75 | bsd | bsd[ -](?:4|four)[ -]clause
bsd-4-clause | 75 | bsd | (?:4|four)[ -]clause bsd
bsd-4-clause | 85 | advertising | all advertising materials mentioning features or use of this software must display
bsd | 85 | redistribution | redistribution and use in source and binary forms, with or without modification, are permitted
bsd | 60 | bsd | \bbsd(?:-style)? licen[sc]ed?
bsd-source-code | 75 | bsd | bsd source code attribution
gpl-1.0 | 75 | gpl | \bgpl[ -]?v?1(?:\.0)?\b
gpl-2.0 | 95 | spdx | spdx-license-identifier: \(?gpl-2\.0
gpl-2.0 | 85 | general | gnu general public licen[sc]e,?~(?:2|two)\b(?:\.0)?
gpl-2.0 | 75 | gpl | \b(?:gnu )?gpl,?~v?2(?:\.0)?(?:\+|-only|-or-later)?\b
gpl-2.0 | 75 | gplv2 | \bgplv2\+?
gpl-2.0 | 75 | gpl-2.0 | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3.0 | 95 | spdx | spdx-license-identifier: \(?gpl-3\.0
gpl-3.0 | 85 | general | gnu general public licen[sc]e,?~(?:3|three)\b(?:\.0)?
gpl-3.0 | 75 | gpl | \b(?:gnu )?gpl,?~v?3(?:\.0)?(?:\+|-only|-or-later)?\b
gpl-3.0 | 75 | gplv3 | \bgplv3\+?
gpl-3.0 | 75 | gpl-3.0 | gnu\.org/licenses/gpl-3\.0
gpl | 85 | redistribute | you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e
gpl | 85 | free software | this program is free software[;:,]? you can redistribute it
gpl | 60 | general public | gnu general public licen[sc]e
gpl | 40 | general public | general public licen[sc]e
gpl | 40 | gpl | (?:licensed|released|distributed) under (?:the )?(?:gnu )?gpl\b
gpl-or-later | 60 | later | either version \d(?:\.\d)? of the license, or \(at your option\) any later version
gpl-classpath | 75 | classpath | (?:with|and) (?:the )?classpath exception
gpl-linking | 60 | exception | (?:special|linking) exception,? the copyright holders? (?:give|grant)s? you permission to link
gpl-font | 60 | font | (?:with|and) (?:the )?font exception
gcc-exception | 75 | gcc | gcc runtime library exception
lgpl-2.0 | 75 | library general | gnu library general public licen[sc]e
lgpl-2.1 | 95 | spdx | spdx-license-identifier: \(?lgpl-2\.1
lgpl-2.1 | 85 | lesser | gnu lesser general public licen[sc]e,?~2\.1
lgpl-2.1 | 75 | lgpl | \blgpl,?~v?2(?:\.1)?\b
lgpl-3.0 | 95 | spdx | spdx-license-identifier: \(?lgpl-3\.0
lgpl-3.0 | 85 | lesser | gnu lesser general public licen[sc]e,?~3(?:\.0)?
lgpl-3.0 | 75 | lgpl | \blgpl,?~v?3(?:\.0)?\b
lgpl | 60 | lesser | gnu lesser general public licen[sc]e
lgpl | 40 | lgpl | \blgpl\b
agpl-3.0 | 95 | spdx | spdx-license-identifier: \(?agpl-3\.0
agpl-3.0 | 85 | affero | gnu affero general public licen[sc]e,?~3(?:\.0)?
agpl-3.0 | 75 | agpl | \bagpl,?~v?3(?:\.0)?\b
agpl-1.0 | 75 | affero | affero general public licen[sc]e,?~1(?:\.0)?
agpl | 60 | affero | (?:gnu )?affero general public licen[sc]e
agpl | 40 | agpl | \bagpl\b
sspl-1.0 | 75 | server side | server side public licen[sc]e
sspl-1.0 | 60 | sspl | \bsspl(?:-1\.0)?\b
gfdl-1.3 | 85 | free documentation | gnu free documentation licen[sc]e,?~1\.3
gfdl-1.2 | 85 | free documentation | gnu free documentation licen[sc]e,?~1\.2
gfdl-1.1 | 85 | free documentation | gnu free documentation licen[sc]e,?~1\.1
gfdl | 60 | free documentation | gnu free documentation licen[sc]e
gfdl | 60 | gfdl | \bgfdl\b
gfdl | 60 | invariant | with no invariant sections, (?:with )?no front-cover texts
mpl-2.0 | 95 | spdx | spdx-license-identifier: \(?mpl-2\.0
mpl-2.0 | 85 | mozilla | mozilla public licen[sc]e,?~(?:v\. ?)?2(?:\.0)?
mpl-2.0 | 75 | mpl | \bmpl[ -]?v?2(?:\.0)?\b
mpl-2.0 | 75 | mozilla.org | mozilla\.org/mpl/2\.0
mpl-1.1 | 85 | mozilla | mozilla public licen[sc]e,?~1\.1
mpl-1.1 | 75 | mpl | \bmpl[ -]?v?1\.1\b
mpl-1.0 | 85 | mozilla | mozilla public licen[sc]e,?~1\.0
mpl | 60 | mozilla | mozilla public licen[sc]e
npl | 60 | netscape | netscape public licen[sc]e
epl-2.0 | 95 | spdx | spdx-license-identifier: \(?epl-2\.0
epl-2.0 | 85 | eclipse | eclipse public licen[sc]e,?~(?:v\. ?)?2(?:\.0)?
epl-1.0 | 85 | eclipse | eclipse public licen[sc]e,?~(?:v\. ?)?1(?:\.0)?
epl | 60 | eclipse | eclipse public licen[sc]e
epl-2.0 | 75 | eclipse.org | eclipse\.org/legal/epl-2\.0
epl-1.0 | 75 | eclipse.org | eclipse\.org/legal/epl-v10
edl-1.0 | 75 | eclipse | eclipse distribution licen[sc]e
cddl-1.1 | 85 | cddl | \bcddl[ -]?v?1\.1
cddl-1.0 | 85 | cddl | \bcddl[ -]?v?1\.0
cddl-1.0 | 75 | development and distribution | common development and distribution licen[sc]e
cpl-1.0 | 60 | common public | common public licen[sc]e
ipl-1.0 | 60 | ibm | ibm public licen[sc]e
eupl-1.2 | 85 | european union | european union public licen[sc]e,?~1\.2
eupl-1.1 | 85 | european union | european union public licen[sc]e,?~1\.1
eupl | 60 | european union | european union public licen[sc]e
eupl | 60 | eupl | \beupl\b
osl-3.0 | 75 | open software | open software licen[sc]e,?~3\.0
osl-2.1 | 75 | open software | open software licen[sc]e,?~2\.1
osl | 60 | open software | open software licen[sc]e
afl-3.0 | 75 | academic | academic free licen[sc]e,?~3\.0
afl-2.1 | 75 | academic | academic free licen[sc]e,?~2\.1
afl | 60 | academic | academic free licen[sc]e
artistic-2.0 | 75 | artistic | artistic licen[sc]e,?~2\.0
artistic-1.0 | 75 | artistic | artistic licen[sc]e,?~1\.0
artistic | 60 | artistic | artistic licen[sc]e
perl | 60 | perl | (?:under )?the same terms as perl(?: itself)?
ruby | 60 | ruby | \bruby(?:'s)? licen[sc]e
psf-2.0 | 75 | python | python software foundation licen[sc]e
psf-2.0 | 60 | psf | \bpsf licen[sc]e
cnri-python | 60 | cnri | cnri (?:open source )?(?:python )?licen[sc]e
php-3.01 | 75 | php | php licen[sc]e,?~3\.01
php-3.0 | 75 | php | php licen[sc]e,?~3\.0\b
php | 60 | php | \bphp licen[sc]e
zend-2.0 | 60 | zend | zend engine licen[sc]e
zlib | 95 | spdx | spdx-license-identifier: \(?zlib\b
zlib | 75 | zlib | \bzlib(?:/libpng)? licen[sc]e
zlib | 95 | origin | the origin of this software must not be misrepresented
libpng | 60 | libpng | \blibpng licen[sc]e
libtiff | 60 | libtiff | \blibtiff licen[sc]e
ijg | 60 | jpeg | independent jpeg group(?:'s)? licen[sc]e
bsl-1.0 | 95 | spdx | spdx-license-identifier: \(?bsl-1\.0
bsl-1.0 | 85 | boost | boost software licen[sc]e,?~1\.0
bsl-1.0 | 60 | boost | boost software licen[sc]e
bsl-1.0 | 75 | boost.org | boost\.org/license_1_0\.txt
busl-1.1 | 75 | business source | business source licen[sc]e,?~1\.1
busl | 60 | business source | business source licen[sc]e
elastic-2.0 | 75 | elastic | elastic licen[sc]e,?~(?:v)?2(?:\.0)?
elastic | 60 | elastic | elastic licen[sc]e
commons-clause | 75 | commons clause | commons clause(?: licen[sc]e)?(?: condition)?
polyform-noncommercial | 75 | polyform | polyform noncommercial licen[sc]e
polyform-shield | 75 | polyform | polyform shield licen[sc]e
polyform-small-business | 75 | polyform | polyform small business licen[sc]e
confluent | 60 | confluent | confluent community licen[sc]e
redis-source | 60 | redis | redis source available licen[sc]e
timescale | 60 | timescale | timescale licen[sc]e
unlicense | 95 | spdx | spdx-license-identifier: \(?unlicense
unlicense | 95 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 75 | unlicense | \bthe unlicense\b
unlicense | 75 | unlicense.org | unlicense\.org
wtfpl | 75 | wtfpl, you want to public | \bwtfpl\b|do what the f\S{2,4} you want to public licen[sc]e
beerware | 75 | beer | \bbeer-?ware licen[sc]e
cc0-1.0 | 95 | spdx | spdx-license-identifier: \(?cc0-1\.0
cc0-1.0 | 85 | publicdomain | creativecommons\.org/publicdomain/zero/1\.0
cc0-1.0 | 75 | cc0 | \bcc0(?:[ -]1\.0)?(?: universal)?\b
cc-pdm-1.0 | 75 | publicdomain | creativecommons\.org/publicdomain/mark/1\.0
cc-pdm-1.0 | 60 | public domain mark | public domain mark 1\.0
cc-by-nc-nd | 85 | creative | creative commons attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s?(?: works)?(?: \d\.\d)?
cc-by-nc-sa | 85 | creative | creative commons attribution[ -]non-?commercial[ -]share-?alike(?: \d\.\d)?
cc-by-nc | 85 | creative | creative commons attribution[ -]non-?commercial(?: \d\.\d)?
cc-by-nd | 85 | creative | creative commons attribution[ -]no-?deriv(?:ative)?s?(?: works)?(?: \d\.\d)?
cc-by-sa | 85 | creative | creative commons attribution[ -]share-?alike(?: \d\.\d)?
cc-by | 75 | creative | creative commons attribution(?: \d\.\d)?
cc-by-nc-nd | 80 | by-nc-nd | \bcc[ -]by-nc-nd(?:[ -]\d(?:\.\d)?)?\b
cc-by-nc-sa | 80 | by-nc-sa | \bcc[ -]by-nc-sa(?:[ -]\d(?:\.\d)?)?\b
cc-by-nc | 75 | by-nc | \bcc[ -]by-nc(?:[ -]\d(?:\.\d)?)?\b
cc-by-nd | 80 | by-nd | \bcc[ -]by-nd(?:[ -]\d(?:\.\d)?)?\b
cc-by-sa | 80 | by-sa | \bcc[ -]by-sa(?:[ -]\d(?:\.\d)?)?\b
cc-by-4.0 | 75 | cc | \bcc[ -]by[ -]4(?:\.0)?\b
cc-by-3.0 | 75 | cc | \bcc[ -]by[ -]3(?:\.0)?\b
cc-by-2.5 | 75 | cc | \bcc[ -]by[ -]2\.5\b
cc-by-2.0 | 75 | cc | \bcc[ -]by[ -]2(?:\.0)?\b
cc-by | 60 | cc | \bcc[ -]by\b
cc-by-nc-nd | 85 | creativecommons | creativecommons\.org/licenses/by-nc-nd/
cc-by-nc-sa | 85 | creativecommons | creativecommons\.org/licenses/by-nc-sa/
cc-by-nc | 85 | creativecommons | creativecommons\.org/licenses/by-nc/
cc-by-nd | 85 | creativecommons | creativecommons\.org/licenses/by-nd/
cc-by-sa | 85 | creativecommons | creativecommons\.org/licenses/by-sa/
cc-by-4.0 | 85 | creativecommons | creativecommons\.org/licenses/by/4\.0
cc-by-3.0 | 85 | creativecommons | creativecommons\.org/licenses/by/3\.0
cc-by | 80 | creativecommons | creativecommons\.org/licenses/by/
creative-commons | 40 | creative | creative commons(?: licen[sc]e)?
odbl-1.0 | 75 | database | open (?:data commons )?open database licen[sc]e
odbl-1.0 | 75 | database | open database licen[sc]e
odbl-1.0 | 60 | odbl | \bodbl\b
odc-by-1.0 | 75 | open data commons | open data commons attribution licen[sc]e
odc-by-1.0 | 60 | odc-by | \bodc-by\b
pddl-1.0 | 75 | public domain dedication | public domain dedication (?:and|&) licen[sc]e
pddl-1.0 | 60 | pddl | \bpddl\b
cdla-permissive | 75 | community data | community data licen[sc]e agreement.{0,3}permissive
cdla-sharing | 75 | community data | community data licen[sc]e agreement.{0,3}sharing
ogl-uk-3.0 | 75 | open government | open government licen[sc]e,?~(?:v)?3(?:\.0)?
ogl-uk | 60 | open government | open government licen[sc]e
etalab-2.0 | 60 | licence ouverte, etalab | licence ouverte|etalab[ -]2\.0
dl-de-by-2.0 | 60 | datenlizenz | datenlizenz deutschland
nlod | 60 | norwegian | norwegian licen[sc]e for open government data
ofl-1.1 | 95 | spdx | spdx-license-identifier: \(?ofl-1\.1
ofl-1.1 | 85 | font | sil open font licen[sc]e,?~1\.1
ofl-1.1 | 60 | font | (?:sil )?open font licen[sc]e
ofl-1.1 | 75 | scripts.sil.org | scripts\.sil\.org/ofl
bitstream-vera | 60 | bitstream | bitstream vera (?:fonts )?(?:copyright|licen[sc]e)
ubuntu-font | 60 | ubuntu | ubuntu font licen[sc]e
ipa-font | 60 | ipa | ipa font licen[sc]e
ms-pl | 75 | microsoft | microsoft public licen[sc]e
ms-pl | 60 | ms-pl | \bms-pl\b
ms-rl | 75 | microsoft | microsoft reciprocal licen[sc]e
ms-rl | 60 | ms-rl | \bms-rl\b
ms-eula | 60 | microsoft | microsoft software licen[sc]e terms
apsl-2.0 | 75 | apple | apple public source licen[sc]e
apple-sample | 60 | apple | apple sample (?:source )?code licen[sc]e
oracle-bcl | 60 | oracle | oracle binary code licen[sc]e
oracle-nftc | 60 | oracle | oracle no-fee terms and conditions
upl-1.0 | 75 | universal permissive | universal permissive licen[sc]e
sun-bcl | 60 | sun microsystems | sun microsystems,? inc\.? binary code licen[sc]e
sissl | 60 | sun industry | sun industry standards source licen[sc]e
intel-simplified | 60 | intel | intel simplified software licen[sc]e
nvidia-eula | 60 | nvidia | nvidia (?:software )?licen[sc]e agreement
cuda-eula | 60 | cuda | cuda toolkit end user licen[sc]e
ncsa | 75 | ncsa | university of illinois/ncsa open source licen[sc]e
ncsa | 60 | ncsa | \bncsa licen[sc]e
ecl-2.0 | 75 | educational | educational community licen[sc]e
nasa-1.3 | 60 | nasa | nasa open source agreement
lppl-1.3c | 75 | latex | latex project public licen[sc]e,?~1\.3c?
lppl | 60 | latex | latex project public licen[sc]e
lppl | 60 | lppl | \blppl\b
tcl | 60 | tcl | \btcl/tk licen[sc]e
vim | 60 | vim | \bvim licen[sc]e
sleepycat | 60 | sleepycat | sleepycat licen[sc]e
postgresql | 75 | postgresql | postgresql licen[sc]e
sqlite-blessing | 75 | good and not evil | may you do good and not evil
curl | 60 | curl | \bcurl licen[sc]e
openssl | 75 | openssl | \bopenssl licen[sc]e
openssl | 85 | openssl | this product includes software developed by the openssl project
ssleay | 60 | ssleay | original ssleay licen[sc]e
openldap-2.8 | 60 | openldap | openldap public licen[sc]e
w3c | 60 | w3c | w3c(?:\(r\))? software (?:notice and )?licen[sc]e
unicode-dfs | 60 | unicode | unicode(?:,? inc\.?)? licen[sc]e agreement
icu | 60 | icu | \bicu licen[sc]e
hpnd | 60 | historical permission | historical permission notice and disclaimer
naist | 60 | naist | \bnaist licen[sc]e
mulan-psl-2.0 | 75 | mulan | mulan (?:permissive software licen[sc]e|psl),?~(?:v)?2
mulan-psl | 60 | mulan | mulan (?:permissive software licen[sc]e|psl)
cecill-2.1 | 75 | cecill | \bcecill[ -](?:v)?2\.1
cecill-b | 75 | cecill | \bcecill-b\b
cecill-c | 75 | cecill | \bcecill-c\b
cecill | 60 | cecill | \bcecill\b
cpal-1.0 | 60 | common public attribution | common public attribution licen[sc]e
qpl-1.0 | 60 | q public | \bq public licen[sc]e
rpl-1.5 | 60 | reciprocal public | reciprocal public licen[sc]e
simple-2.0 | 60 | simple public | simple public licen[sc]e
blueoak-1.0.0 | 75 | blue oak | blue oak model licen[sc]e
json | 75 | evil | the software shall be used for good, not evil
llama2 | 75 | llama 2 | llama 2 community licen[sc]e
llama3 | 75 | llama 3 | llama 3(?:\.\d)? community licen[sc]e
openrail-m | 75 | rail | \b(?:creativeml )?open ?rail(?:\+\+)?-m\b
rail | 60 | responsible ai | responsible ai licen[sc]e
gemma | 60 | gemma | gemma terms of use
public-domain | 75 | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 40 | public domain | \bin the public domain
copyright-notice | 40 | copyright | copyright (?:\(c\) |© ?)?(?:19|20)\d\d
copyright-notice | 40 | (c) | \(c\) (?:copyright )?(?:19|20)\d\d
copyright-notice | 40 | © | © ?(?:19|20)\d\d
reserved | 60 | all rights | all rights reserved
reserved | 40 | alle rechte | alle rechte vorbehalten
reserved | 40 | tous droits | tous droits r[eé]serv[eé]s
reserved | 40 | derechos | todos los derechos reservados
proprietary | 75 | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | 75 | copying of this file | unauthori[sz]ed copying of this file
proprietary | 60 | proprietary | proprietary licen[sc]e
proprietary | 60 | licence agreement, license agreement, eula | end[ -]user licen[sc]e agreement(?: \(eula\))?|\beula\b
no-redistribution | 75 | redistribut | (?:may not be|not for) redistribut(?:ed|ion)
no-redistribution | 75 | prior written | may not be reproduced[^.]{0,80} without (?:the )?(?:express )?prior written
non-commercial | 60 | commercial | (?:for )?non-?commercial (?:use|purposes) only
research-only | 60 | research | for (?:academic )?research (?:use|purposes) only
evaluation-only | 60 | evaluation | for evaluation (?:use|purposes) only
shareware | 40 | shareware | \bthis (?:program|software) is shareware
freeware | 40 | freeware | \bthis (?:program|software) is freeware
dual-licence | 40 | dual | dual[ -]licen[sc]ed
see-licence | 20 | licen | see (?:the )?(?:accompanying )?(?:file )?licen[sc]e(?:\.txt|\.md)? (?:file )?for (?:more )?(?:details|information)
as-is | 40 | as is | (?:is )?provided [“"']?as is[”"']?,? without warranty of any kind
unknown-licence | 20 | licen | (?:licensed|released|distributed) under (?:the )?(?:terms of )?[^.\n]{1,60}licen[sc]e
"""
