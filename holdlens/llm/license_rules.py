"""Signature rules of license scanning, written for what licenses and notices say.

A line has label, priority, score, a keyword that every match contains, and a regex over text in which A-Z is a-z and
white space between words, line breaks and comment marks at a line's start included, is one space.
"""

from __future__ import annotations

RULES = r"""
apache-2.0 | 100 | 1.0 | spdx-license-identifier: apache | spdx-license-identifier: apache-2\.0
apache-2.0 | 90 | 0.98 | apache license | licen[sc]ed under the apache license,? version 2(?:\.0)?
apache-2.0 | 70 | 0.9 | apache | apache (?:software )?(?:public )?licen[sc]e,? ?\(?(?:version |ver\.? |v\.? ?)?2(?:\.0)?
apache-2.0 | 65 | 0.85 | apache | apache[- ](?:v\.? ?)?2(?:\.0)?(?: licen[sc]ed?)?
apache-2.0 | 90 | 0.98 | apache.org | (?:https?://)?(?:www\.)?apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
apache-2.0 | 85 | 0.95 | contributor hereby grants to you | each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable
apache-1.1 | 100 | 1.0 | spdx-license-identifier: apache | spdx-license-identifier: apache-1\.1
apache-1.1 | 70 | 0.9 | apache | apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?1\.1
apache-1.0 | 70 | 0.9 | apache | apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?1\.0
apache-1.1 | 80 | 0.9 | developed by the apache software foundation | this product includes software developed by the apache software foundation
apache | 30 | 0.6 | apache | apache (?:software )?(?:public )?licen[sc]e
mit | 100 | 1.0 | spdx-license-identifier: mit | spdx-license-identifier: mit
mit-0 | 101 | 1.0 | spdx-license-identifier: mit-0 | spdx-license-identifier: mit-0
mit | 90 | 0.95 | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
permissive-mit-text | 80 | 0.9 | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy
mit | 85 | 0.95 | substantial portions of the software | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 60 | 0.9 | mit | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of the )?mit(?: licen[sc]e)?
mit | 50 | 0.8 | mit | the mit licen[sc]e \(mit\)
mit | 30 | 0.7 | mit | mit licen[sc]ed?
mit | 70 | 0.9 | opensource.org/licenses/mit | (?:https?://)?(?:www\.)?opensource\.org/licenses/mit(?:-license)?(?:\.php|\.html)?
mit | 40 | 0.6 | expat | expat licen[sc]e
x11 | 60 | 0.85 | x11 | (?:mit[/ -])?x11 licen[sc]e
x11 | 80 | 0.9 | x consortium | except as contained in this notice, the name of the x consortium shall not be used in advertising
bsd-2-clause | 100 | 1.0 | spdx-license-identifier: bsd-2 | spdx-license-identifier: bsd-2-clause
bsd-3-clause | 100 | 1.0 | spdx-license-identifier: bsd-3 | spdx-license-identifier: bsd-3-clause
bsd-4-clause | 100 | 1.0 | spdx-license-identifier: bsd-4 | spdx-license-identifier: bsd-4-clause
0bsd | 100 | 1.0 | spdx-license-identifier: 0bsd | spdx-license-identifier: 0bsd
bsd-2-clause | 70 | 0.9 | bsd | (?:simplified bsd|freebsd|bsd[- ]2[- ]clause|2[- ]clause bsd|two[- ]clause bsd)(?: licen[sc]e)?
bsd-3-clause | 70 | 0.9 | bsd | (?:(?:new|modified|revised) bsd|bsd[- ]3[- ]clause|3[- ]clause bsd|three[- ]clause bsd)(?: licen[sc]e)?
bsd-4-clause | 70 | 0.9 | bsd | (?:original bsd|old bsd|bsd[- ]4[- ]clause|4[- ]clause bsd|four[- ]clause bsd)(?: licen[sc]e)?
0bsd | 60 | 0.85 | bsd | (?:zero|0)[- ]clause bsd(?: licen[sc]e)?
bsd | 50 | 0.85 | bsd | (?:use of this source code is|this software is|licen[sc]ed|released|distributed) (?:governed by|licensed under|under) (?:a|the) bsd[- ]style licen[sc]e
bsd | 30 | 0.65 | bsd | bsd(?:[- ]style)? licen[sc]ed?
permissive-bsd-text | 80 | 0.95 | redistribution and use | redistribution and use in source and binary forms, with or without modification
bsd-3-clause | 85 | 0.95 | specific prior | neither the name (?:of|"?the) .{1,80}? nor the names of (?:its|any) contributors may be used to endorse or promote products derived from this software without specific prior
bsd-4-clause | 85 | 0.95 | mentioning features or use of this software | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
isc | 100 | 1.0 | spdx-license-identifier: isc | spdx-license-identifier: isc
isc | 90 | 0.95 | permission to use, copy, modify | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
isc | 50 | 0.8 | isc | isc(?:[- ]style)? licen[sc]e
hpnd | 80 | 0.85 | in supporting documentation | that both that copyright notice and this permission notice appear in supporting documentation
zlib | 100 | 1.0 | spdx-license-identifier: zlib | spdx-license-identifier: zlib
zlib | 90 | 0.95 | altered source versions | altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
zlib | 50 | 0.8 | zlib | zlib(?:/libpng)? licen[sc]e
libpng | 55 | 0.8 | libpng | libpng licen[sc]e(?: version 2)?
unlicense | 100 | 1.0 | spdx-license-identifier: unlicense | spdx-license-identifier: unlicense
unlicense | 90 | 0.95 | free and unencumbered software | this is free and unencumbered software released into the public domain
unlicense | 50 | 0.8 | unlicense | (?:the unlicense|unlicense\.org)
wtfpl | 100 | 1.0 | spdx-license-identifier: wtfpl | spdx-license-identifier: wtfpl
wtfpl | 60 | 0.85 | wtfpl | wtfpl(?:,? (?:version |v)?2)?
wtfpl | 80 | 0.9 | what the | do what the f(?:uck|\*+k?) you want to public licen[sc]e
bsl-1.0 | 100 | 1.0 | spdx-license-identifier: bsl | spdx-license-identifier: bsl-1\.0
bsl-1.0 | 80 | 0.95 | boost software | boost software licen[sc]e(?:,? ?-? (?:version |v\.? ?)?1\.0)?
busl-1.1 | 100 | 1.0 | spdx-license-identifier: busl | spdx-license-identifier: busl-1\.1
busl-1.1 | 70 | 0.9 | business source | business source licen[sc]e(?:,? (?:version |v)?1\.1)?
artistic-1.0 | 100 | 1.0 | spdx-license-identifier: artistic | spdx-license-identifier: artistic-1\.0(?:-perl)?
artistic-2.0 | 100 | 1.0 | spdx-license-identifier: artistic | spdx-license-identifier: artistic-2\.0
artistic-2.0 | 70 | 0.9 | artistic | artistic licen[sc]e,? \(?(?:version |v\.? ?)?2(?:\.0)?
artistic-1.0 | 70 | 0.9 | artistic | artistic licen[sc]e,? \(?(?:version |v\.? ?)?1(?:\.0)?
artistic | 40 | 0.7 | artistic | (?:clarified )?artistic licen[sc]e
perl | 60 | 0.8 | same terms as perl | (?:under|on) the same terms as perl(?: itself)?
python-2.0 | 70 | 0.9 | python | python(?: software foundation)? licen[sc]e,? (?:agreement )?(?:version |v\.? ?)?2(?:\.0)?
psf | 50 | 0.8 | python software foundation | python software foundation licen[sc]e
python-2.0 | 80 | 0.9 | psf hereby grants | psf hereby grants licensee a nonexclusive, royalty-free, world-wide license
openssl | 100 | 1.0 | spdx-license-identifier: openssl | spdx-license-identifier: openssl
openssl | 85 | 0.95 | openssl project for use | developed by the openssl project for use in the openssl toolkit
openssl | 50 | 0.8 | openssl | openssl licen[sc]e
ssleay | 60 | 0.85 | eric young | eric young \(eay@cryptsoft\.com\)
postgresql | 60 | 0.85 | postgresql | postgresql licen[sc]e
postgresql | 80 | 0.9 | without a | permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a
ncsa | 60 | 0.85 | ncsa | (?:university of illinois/)?ncsa(?: open source)? licen[sc]e
gpl-2.0-only | 101 | 1.0 | spdx-license-identifier: gpl | spdx-license-identifier: gpl-2\.0-only
gpl-2.0-or-later | 101 | 1.0 | spdx-license-identifier: gpl | spdx-license-identifier: gpl-2\.0(?:-or-later|\+)
gpl-2.0 | 100 | 1.0 | spdx-license-identifier: gpl | spdx-license-identifier: gpl-2\.0
gpl-3.0-only | 101 | 1.0 | spdx-license-identifier: gpl | spdx-license-identifier: gpl-3\.0-only
gpl-3.0-or-later | 101 | 1.0 | spdx-license-identifier: gpl | spdx-license-identifier: gpl-3\.0(?:-or-later|\+)
gpl-3.0 | 100 | 1.0 | spdx-license-identifier: gpl | spdx-license-identifier: gpl-3\.0
gpl-2.0-or-later | 95 | 0.98 | general public license | gnu general public license as published by the free software foundation[,;] either version 2 of the license,? or \(at your option\) any later version
gpl-3.0-or-later | 95 | 0.98 | general public license | gnu general public license as published by the free software foundation[,;] either version 3 of the license,? or \(at your option\) any later version
gpl-2.0-only | 94 | 0.95 | general public license | gnu general public license,? version 2,? as published by the free software foundation
gpl-3.0-only | 94 | 0.95 | general public license | gnu general public license,? version 3,? as published by the free software foundation
gpl-3.0 | 75 | 0.9 | general public | (?:gnu )?general public licen[sc]e,? ?\(?(?:gpl\)?,? ?)?(?:version |ver\.? |v\.? ?)?3(?:\.0)?
gpl-2.0 | 75 | 0.9 | general public | (?:gnu )?general public licen[sc]e,? ?\(?(?:gpl\)?,? ?)?(?:version |ver\.? |v\.? ?)?2(?:\.0)?
gpl-1.0 | 75 | 0.9 | general public | (?:gnu )?general public licen[sc]e,? ?\(?(?:version |ver\.? |v\.? ?)?1(?:\.0)?
gpl | 45 | 0.7 | general public | gnu general public licen[sc]e
gpl | 31 | 0.6 | general public | general public licen[sc]e
gpl-3.0 | 65 | 0.85 | gpl | (?:gnu )?gpl[- ]?(?:version |v\.? ?)?3(?:\.0)?\+?
gpl-2.0 | 65 | 0.85 | gpl | (?:gnu )?gpl[- ]?(?:version |v\.? ?)?2(?:\.0)?\+?
gpl | 40 | 0.6 | gpl | (?:gnu gpl|gpl[- ]licen[sc]ed|under the gpl)
gpl | 85 | 0.9 | gnu.org/licenses/gpl | (?:https?://)?(?:www\.)?gnu\.org/licenses/gpl(?:-[123]\.0)?(?:\.html|\.txt)?
gpl | 80 | 0.85 | received a copy of the gnu general public | you should have received a copy of the gnu general public license
gpl-with-classpath-exception | 90 | 0.95 | linking this library | linking this library statically or dynamically with other modules is making a combined work
gpl-with-classpath-exception | 70 | 0.85 | classpath exception | (?:gpl|general public license)[ a-z0-9.,-]{0,20}with (?:the )?classpath exception
lgpl-2.1-or-later | 101 | 1.0 | spdx-license-identifier: lgpl | spdx-license-identifier: lgpl-2\.1(?:-or-later|\+)
lgpl-2.1 | 100 | 1.0 | spdx-license-identifier: lgpl | spdx-license-identifier: lgpl-2\.1(?:-only)?
lgpl-3.0-or-later | 101 | 1.0 | spdx-license-identifier: lgpl | spdx-license-identifier: lgpl-3\.0(?:-or-later|\+)
lgpl-3.0 | 100 | 1.0 | spdx-license-identifier: lgpl | spdx-license-identifier: lgpl-3\.0(?:-only)?
lgpl-2.1-or-later | 95 | 0.98 | lesser general public license | gnu lesser general public license as published by the free software foundation[,;] either version 2\.1 of the license,? or \(at your option\) any later version
lgpl-3.0-or-later | 95 | 0.98 | lesser general public license | gnu lesser general public license as published by the free software foundation[,;] either version 3 of the license,? or \(at your option\) any later version
lgpl-3.0 | 76 | 0.9 | lesser general public | (?:gnu )?lesser general public licen[sc]e,? ?\(?(?:lgpl\)?,? ?)?(?:version |ver\.? |v\.? ?)?3(?:\.0)?
lgpl-2.1 | 76 | 0.9 | lesser general public | (?:gnu )?lesser general public licen[sc]e,? ?\(?(?:lgpl\)?,? ?)?(?:version |ver\.? |v\.? ?)?2\.1
lgpl-2.0 | 76 | 0.9 | library general public | (?:gnu )?library general public licen[sc]e(?:,? ?\(?(?:version |ver\.? |v\.? ?)?2(?:\.0)?)?
lgpl | 46 | 0.7 | lesser general public | (?:gnu )?lesser general public licen[sc]e
lgpl-3.0 | 66 | 0.85 | lgpl | (?:gnu )?lgpl[- ]?(?:version |v\.? ?)?3(?:\.0)?\+?
lgpl-2.1 | 66 | 0.85 | lgpl | (?:gnu )?lgpl[- ]?(?:version |v\.? ?)?2\.1\+?
lgpl | 41 | 0.6 | lgpl | (?:gnu lgpl|lgpl[- ]licen[sc]ed|under the lgpl)
agpl-3.0 | 100 | 1.0 | spdx-license-identifier: agpl | spdx-license-identifier: agpl-3\.0(?:-only|-or-later|\+)?
agpl-3.0 | 77 | 0.9 | affero general public | (?:gnu )?affero general public licen[sc]e,? ?\(?(?:agpl\)?,? ?)?(?:version |ver\.? |v\.? ?)?3(?:\.0)?
agpl-1.0 | 77 | 0.9 | affero general public | affero general public licen[sc]e,? ?(?:version |v\.? ?)?1(?:\.0)?
agpl | 47 | 0.7 | affero | (?:gnu )?affero (?:general )?(?:public )?licen[sc]e
agpl-3.0 | 66 | 0.85 | agpl | (?:gnu )?agpl[- ]?(?:version |v\.? ?)?3(?:\.0)?\+?
sspl-1.0 | 70 | 0.9 | server side public | server side public licen[sc]e(?:,? (?:version |v)?1)?
gfdl-1.1 | 75 | 0.9 | free documentation | (?:gnu )?free documentation licen[sc]e,? (?:version |v\.? ?)1\.1
gfdl-1.2 | 75 | 0.9 | free documentation | (?:gnu )?free documentation licen[sc]e,? (?:version |v\.? ?)1\.2
gfdl-1.3 | 75 | 0.9 | free documentation | (?:gnu )?free documentation licen[sc]e,? (?:version |v\.? ?)1\.3
gfdl | 45 | 0.7 | free documentation | (?:gnu )?free documentation licen[sc]e
gfdl | 85 | 0.9 | no invariant sections | with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts
mpl-2.0 | 100 | 1.0 | spdx-license-identifier: mpl | spdx-license-identifier: mpl-2\.0
mpl-1.1 | 100 | 1.0 | spdx-license-identifier: mpl | spdx-license-identifier: mpl-1\.1
mpl-2.0 | 92 | 0.98 | mozilla public license | this source code form is subject to the terms of the mozilla public license, v\. ?2\.0
mpl-1.1 | 92 | 0.98 | mozilla public license | the contents of this file are subject to the mozilla public license version 1\.1
mpl-2.0 | 75 | 0.9 | mozilla public | mozilla public licen[sc]e,? ?\(?(?:mpl\)?,? ?)?(?:version |v\.? ?)?2(?:\.0)?
mpl-1.1 | 75 | 0.9 | mozilla public | mozilla public licen[sc]e,? ?\(?(?:mpl\)?,? ?)?(?:version |v\.? ?)?1\.1
mpl-1.0 | 75 | 0.9 | mozilla public | mozilla public licen[sc]e,? ?\(?(?:mpl\)?,? ?)?(?:version |v\.? ?)?1\.0
mpl | 45 | 0.7 | mozilla public | mozilla public licen[sc]e
mpl-2.0 | 85 | 0.95 | mozilla.org/mpl/2.0 | (?:https?://)?(?:www\.)?mozilla\.org/mpl/2\.0/?
epl-2.0 | 100 | 1.0 | spdx-license-identifier: epl | spdx-license-identifier: epl-2\.0
epl-1.0 | 100 | 1.0 | spdx-license-identifier: epl | spdx-license-identifier: epl-1\.0
epl-2.0 | 75 | 0.9 | eclipse public | eclipse public licen[sc]e,? ?-? ?(?:version |v\.? ?)?2(?:\.0)?
epl-1.0 | 75 | 0.9 | eclipse public | eclipse public licen[sc]e,? ?-? ?(?:version |v\.? ?)?1(?:\.0)?
epl | 45 | 0.7 | eclipse public | eclipse public licen[sc]e
edl-1.0 | 75 | 0.9 | eclipse distribution | eclipse distribution licen[sc]e,? ?-? ?(?:version |v\.? ?)?1(?:\.0)?
cddl-1.1 | 75 | 0.9 | common development and distribution | common development and distribution licen[sc]e,? ?\(?(?:cddl\)?,? ?)?(?:version |v\.? ?)?1\.1
cddl-1.0 | 75 | 0.9 | common development and distribution | common development and distribution licen[sc]e,? ?\(?(?:cddl\)?,? ?)?(?:version |v\.? ?)?1\.0
cddl | 45 | 0.7 | common development and distribution | common development and distribution licen[sc]e
cddl-1.0 | 100 | 1.0 | spdx-license-identifier: cddl | spdx-license-identifier: cddl-1\.0
cpl-1.0 | 70 | 0.9 | common public | common public licen[sc]e,? ?-? ?(?:version |v\.? ?)?1(?:\.0)?
cpl | 44 | 0.7 | common public | common public licen[sc]e
cpal-1.0 | 70 | 0.9 | common public attribution | common public attribution licen[sc]e(?:,? (?:version |v)?1\.0)?
ipl-1.0 | 70 | 0.9 | ibm public | ibm public licen[sc]e(?:,? (?:version |v)?1(?:\.0)?)?
eupl-1.2 | 100 | 1.0 | spdx-license-identifier: eupl | spdx-license-identifier: eupl-1\.2
eupl-1.2 | 75 | 0.9 | european union public | european union public licen[sc]e,? ?\(?(?:eupl\)?,? ?)?(?:version |v\.? ?)?1\.2
eupl-1.1 | 75 | 0.9 | european union public | european union public licen[sc]e,? ?\(?(?:eupl\)?,? ?)?(?:version |v\.? ?)?1\.1
eupl | 45 | 0.7 | european union public | european union public licen[sc]e
eupl | 60 | 0.8 | eupl | licen[sc]ed under the eupl
osl-3.0 | 75 | 0.9 | open software | open software licen[sc]e,? ?\(?"?(?:osl"?\)?,? ?)?(?:version |v\.? ?)?3(?:\.0)?
osl-2.1 | 75 | 0.9 | open software | open software licen[sc]e,? ?(?:version |v\.? ?)?2\.1
osl | 45 | 0.7 | open software | open software licen[sc]e
afl-3.0 | 75 | 0.9 | academic free | academic free licen[sc]e,? ?\(?"?(?:afl"?\)?,? ?)?(?:version |v\.? ?)?3(?:\.0)?
afl-2.1 | 75 | 0.9 | academic free | academic free licen[sc]e,? ?(?:version |v\.? ?)?2\.1
afl | 45 | 0.7 | academic free | academic free licen[sc]e
ecl-2.0 | 70 | 0.9 | educational community | educational community licen[sc]e(?:,? (?:version |v)?2\.0)?
ms-pl | 60 | 0.85 | microsoft public | microsoft public licen[sc]e(?: \(ms-pl\))?
ms-rl | 60 | 0.85 | microsoft reciprocal | microsoft reciprocal licen[sc]e(?: \(ms-rl\))?
ms-pl | 100 | 1.0 | spdx-license-identifier: ms-pl | spdx-license-identifier: ms-pl
apsl-2.0 | 70 | 0.9 | apple public source | apple public source licen[sc]e(?:,? (?:version |v)?2\.0)?
npl-1.1 | 70 | 0.9 | netscape public | netscape public licen[sc]e(?:,? (?:version |v)?1\.[01])?
sun-bcl | 70 | 0.9 | sun microsystems | sun microsystems, inc\. binary code licen[sc]e agreement
oracle-otn | 60 | 0.8 | oracle technology network | oracle technology network licen[sc]e agreement
nasa-1.3 | 70 | 0.9 | nasa open source | nasa open source agreement(?:,? (?:version |v)?1\.3)?
upl-1.0 | 70 | 0.9 | universal permissive | universal permissive licen[sc]e(?:,? (?:version |v)?1\.0)?
blueoak-1.0.0 | 70 | 0.9 | blue oak model | blue oak model licen[sc]e(?: 1\.0\.0)?
mulan-psl-2.0 | 70 | 0.9 | mulan | mulan (?:permissive software license|psl),? ?(?:version |v)?2
cecill-2.1 | 70 | 0.9 | cecill | cecill(?: free software)?(?: licen[sc]e)?(?: agreement)?,? ?(?:version |v)?2\.1
cecill | 50 | 0.8 | cecill | cecill(?:-[bc])?(?: free software)? licen[sc]e
ofl-1.1 | 100 | 1.0 | spdx-license-identifier: ofl | spdx-license-identifier: ofl-1\.1
ofl-1.1 | 75 | 0.9 | open font | (?:sil )?open font licen[sc]e,? ?\(?(?:ofl\)?,? ?)?(?:version |v\.? ?)?1\.1
ofl | 45 | 0.7 | open font | (?:sil )?open font licen[sc]e
ofl | 85 | 0.9 | reserved font name | with reserved font name
lppl-1.3c | 70 | 0.9 | latex project public | latex project public licen[sc]e(?:,? (?:either )?(?:version |v)?1\.3c?)?
ijg | 70 | 0.9 | independent jpeg group | this software is based in part on the work of the independent jpeg group
vim | 50 | 0.8 | vim | vim licen[sc]e
ruby | 50 | 0.8 | ruby | (?:ruby's|ruby) licen[sc]e
php-3.01 | 70 | 0.9 | php | php licen[sc]e,? (?:version |v)?3\.0?1
php | 45 | 0.7 | php | php licen[sc]e
zpl-2.1 | 70 | 0.9 | zope public | zope public licen[sc]e(?: \(zpl\))?(?:,? (?:version |v)?2\.1)?
w3c | 60 | 0.85 | w3c | w3c(?:\(r\))? software (?:notice and )?licen[sc]e
unicode | 60 | 0.85 | unicode | unicode,? inc\.? licen[sc]e agreement
ietf-trust | 60 | 0.8 | ietf trust | subject to bcp 78 and the ietf trust's legal provisions
elastic-2.0 | 70 | 0.9 | elastic license | elastic license,? (?:version |v)?2(?:\.0)?
polyform-noncommercial | 70 | 0.9 | polyform | polyform noncommercial licen[sc]e(?: 1\.0\.0)?
commons-clause | 70 | 0.9 | commons clause | commons clause(?:" license condition| licen[sc]e condition)?
hippocratic | 60 | 0.85 | hippocratic | hippocratic licen[sc]e
json | 70 | 0.9 | good, not evil | the software shall be used for good, not evil
beerware | 70 | 0.9 | beer | (?:the )?beer-?ware licen[sc]e
openrail | 60 | 0.85 | openrail | (?:bigscience |creativeml )?openrail(?:-m|\+\+-m)?(?: licen[sc]e)?
llama-community | 60 | 0.85 | community license | llama [0-9.]* ?community license(?: agreement)?
cc0-1.0 | 100 | 1.0 | spdx-license-identifier: cc0 | spdx-license-identifier: cc0-1\.0
cc0-1.0 | 75 | 0.9 | cc0 | (?:creative commons )?cc0(?:[- ]1\.0)?(?: universal)?(?: public domain dedication)?
cc0-1.0 | 86 | 0.95 | creativecommons.org/publicdomain/zero | (?:https?://)?creativecommons\.org/publicdomain/zero/1\.0/?
cc-pdm | 80 | 0.9 | creativecommons.org/publicdomain/mark | (?:https?://)?creativecommons\.org/publicdomain/mark/1\.0/?
cc-by-4.0 | 100 | 1.0 | spdx-license-identifier: cc-by | spdx-license-identifier: cc-by-4\.0
cc-by-sa-4.0 | 100 | 1.0 | spdx-license-identifier: cc-by | spdx-license-identifier: cc-by-sa-4\.0
cc-by-4.0 | 75 | 0.9 | cc | cc[- ]by[- ]4(?:\.0)?
cc-by-3.0 | 75 | 0.9 | cc | cc[- ]by[- ]3(?:\.0)?
cc-by-2.0 | 75 | 0.9 | cc | cc[- ]by[- ]2\.[05]
cc-by-sa-4.0 | 76 | 0.9 | cc | cc[- ]by[- ]sa[- ]4(?:\.0)?
cc-by-sa-3.0 | 76 | 0.9 | cc | cc[- ]by[- ]sa[- ]3(?:\.0)?
cc-by-nc-4.0 | 76 | 0.9 | cc | cc[- ]by[- ]nc[- ]4(?:\.0)?
cc-by-nc-3.0 | 76 | 0.9 | cc | cc[- ]by[- ]nc[- ]3(?:\.0)?
cc-by-nd-4.0 | 76 | 0.9 | cc | cc[- ]by[- ]nd[- ]4(?:\.0)?
cc-by-nc-sa-4.0 | 77 | 0.9 | cc | cc[- ]by[- ]nc[- ]sa[- ]4(?:\.0)?
cc-by-nc-sa-3.0 | 77 | 0.9 | cc | cc[- ]by[- ]nc[- ]sa[- ]3(?:\.0)?
cc-by-nc-nd-4.0 | 77 | 0.9 | cc | cc[- ]by[- ]nc[- ]nd[- ]4(?:\.0)?
cc-by-nc-sa | 38 | 0.6 | cc | cc[- ]by[- ]nc[- ]sa
cc-by-nc-nd | 38 | 0.6 | cc | cc[- ]by[- ]nc[- ]nd
cc-by-sa | 37 | 0.6 | cc | cc[- ]by[- ]sa
cc-by-nc | 37 | 0.6 | cc | cc[- ]by[- ]nc
cc-by-nd | 37 | 0.6 | cc | cc[- ]by[- ]nd
cc-by | 35 | 0.6 | cc | cc[- ]by
cc-by-4.0 | 71 | 0.9 | creative commons | creative commons attribution(?:-only)? 4\.0(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-3.0 | 71 | 0.9 | creative commons | creative commons attribution(?:-only)? 3\.0(?: unported)?(?: licen[sc]e)?
cc-by-2.0 | 71 | 0.9 | creative commons | creative commons attribution(?:-only)? 2\.[05](?: generic)?(?: licen[sc]e)?
cc-by-sa-4.0 | 72 | 0.9 | creative commons | creative commons attribution[- ]share[- ]?alike 4\.0(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-sa-3.0 | 72 | 0.9 | creative commons | creative commons attribution[- ]share[- ]?alike(?: licen[sc]e)?,? ?(?:version )?3\.0(?: unported)?(?: licen[sc]e)?
cc-by-nc-4.0 | 72 | 0.9 | creative commons | creative commons attribution[- ]non[- ]?commercial 4\.0(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-nc-3.0 | 72 | 0.9 | creative commons | creative commons attribution[- ]non[- ]?commercial 3\.0(?: unported)?(?: licen[sc]e)?
cc-by-nd-4.0 | 72 | 0.9 | creative commons | creative commons attribution[- ]no[- ]?deriv(?:ative)?s? 4\.0(?: international)?(?: licen[sc]e)?
cc-by-nc-sa-4.0 | 73 | 0.9 | creative commons | creative commons attribution[- ]non[- ]?commercial[- ]share[- ]?alike 4\.0(?: international)?(?: licen[sc]e)?
cc-by-nc-nd-4.0 | 73 | 0.9 | creative commons | creative commons attribution[- ]non[- ]?commercial[- ]no[- ]?deriv(?:ative)?s? 4\.0(?: international)?(?: licen[sc]e)?
cc-by-sa | 44 | 0.7 | creative commons | creative commons attribution[- ]share[- ]?alike(?: licen[sc]e)?
cc-by-nc | 44 | 0.7 | creative commons | creative commons attribution[- ]non[- ]?commercial(?: licen[sc]e)?
cc-by | 42 | 0.7 | creative commons | creative commons attribution(?: licen[sc]e)?
creative-commons | 25 | 0.5 | creative commons | creative commons(?: licen[sc]es?)?
cc-by | 86 | 0.95 | creativecommons.org/licenses/by/ | (?:https?://)?creativecommons\.org/licenses/by/[1-4]\.[05]/?
cc-by-sa | 86 | 0.95 | creativecommons.org/licenses/by-sa | (?:https?://)?creativecommons\.org/licenses/by-sa/[1-4]\.[05]/?
cc-by-nc | 86 | 0.95 | creativecommons.org/licenses/by-nc/ | (?:https?://)?creativecommons\.org/licenses/by-nc/[1-4]\.[05]/?
cc-by-nd | 86 | 0.95 | creativecommons.org/licenses/by-nd | (?:https?://)?creativecommons\.org/licenses/by-nd/[1-4]\.[05]/?
cc-by-nc-sa | 86 | 0.95 | creativecommons.org/licenses/by-nc-sa | (?:https?://)?creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]/?
cc-by-nc-nd | 86 | 0.95 | creativecommons.org/licenses/by-nc-nd | (?:https?://)?creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]/?
odbl-1.0 | 75 | 0.9 | open database | open database licen[sc]e(?: \(odbl\))?(?:,? (?:version |v)?1\.0)?
odc-by-1.0 | 75 | 0.9 | open data commons attribution | open data commons attribution licen[sc]e(?:,? (?:version |v)?1\.0)?
pddl-1.0 | 78 | 0.9 | public domain dedication | open data commons public domain dedication (?:and|&) licen[sc]e(?: \(pddl\))?(?:,? (?:version |v)?1\.0)?
ogl-uk-3.0 | 70 | 0.9 | open government licence | open government licence(?: v(?:ersion )?3\.0)?
cdla-permissive-2.0 | 70 | 0.9 | community data license agreement | community data license agreement,? ?-? ?permissive,? ?-? ?(?:version )?2\.0
cdla-sharing-1.0 | 70 | 0.9 | community data license agreement | community data license agreement,? ?-? ?sharing,? ?-? ?(?:version )?1\.0
public-domain | 60 | 0.85 | public domain | (?:released|placed|dedicated|donated) (?:in|into|to) the public domain
public-domain | 50 | 0.8 | public domain | (?:is|are|in|under) (?:in )?(?:the )?public domain
us-government-work | 60 | 0.8 | united states government | (?:a work|works) of the united states government
fair-use | 30 | 0.4 | fair use | (?:under|constitutes|considered) (?:a )?["']?fair use
non-commercial | 50 | 0.7 | commercial | (?:for non-?commercial (?:use|purposes) only|not for commercial use)
research-only | 50 | 0.7 | research | (?:for (?:academic )?research (?:use|purposes) only|for academic research purposes only)
evaluation-only | 50 | 0.7 | evaluation | for (?:internal )?evaluation (?:use|purposes) only
proprietary | 40 | 0.7 | proprietary and confidential | proprietary and confidential
proprietary | 40 | 0.7 | confidential and proprietary | confidential and proprietary
proprietary | 40 | 0.6 | permission | (?:may not|not to|must not) be (?:copied|reproduced|redistributed|distributed|republished) without (?:(?:prior|express) )*(?:written )?permission
proprietary | 40 | 0.6 | permission | no part of this (?:publication|book|work|document) may be reproduced[a-z ,]{0,80} without (?:the )?(?:prior )?(?:written )?permission
proprietary | 45 | 0.7 | unauthorized copying of this file | unauthorized copying of this file, via any medium,? is strictly prohibited
proprietary | 40 | 0.6 | licensed, not sold | (?:this|the) software is licensed, not sold
end-user-license | 45 | 0.7 | license agreement | end[- ]user license agreement
warranty-disclaimer | 35 | 0.5 | warranty of any kind | provided "as is",? without warranty of any kind
warranty-disclaimer | 35 | 0.5 | implied warrant | without even the implied warranty of merchantability
copyright | 20 | 0.3 | copyright | copyright (?:\(c\)|\xc2\xa9|[0-9]{4})
copyright | 20 | 0.3 | (c) | \(c\) (?:copyright )?[12][0-9]{3}
reserved | 10 | 0.4 | rights reserved | all rights reserved
reserved-in-part | 12 | 0.4 | rights reserved | some rights reserved
no-rights-reserved | 12 | 0.5 | rights reserved | no rights reserved
"""


def lines() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, score, keyword, regex) of each rule."""
    out = []
    for line in RULES.strip().splitlines():
        label, priority, score, keyword, pattern = line.split(" | ", 4)
        out.append((label, int(priority), float(score), keyword, pattern))
    return out
