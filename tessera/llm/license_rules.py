"""Signatures of licences, written over the words of a text: lower case, one space between words, "2.0" is "2 0".

A line is: label | words that every match holds | pattern. ``<v2>`` is a version in any spelling, ``<~3>`` up to three
words, ``<under>`` the usual ways to say "under the", ``<tag>`` the machine-readable tag. Classes come with their
priority; within a class an earlier line goes first.
"""

from __future__ import annotations

TAGS = """
agpl-3.0-or-later | spdx agpl later | <tag> agpl 3 0 or later
lgpl-2.0-or-later | spdx lgpl later | <tag> lgpl 2 0 or later
lgpl-2.1-or-later | spdx lgpl later | <tag> lgpl 2 1 or later
lgpl-3.0-or-later | spdx lgpl later | <tag> lgpl 3 0 or later
gpl-1.0-or-later | spdx gpl later | <tag> gpl 1 0 or later
gpl-2.0-or-later | spdx gpl later | <tag> gpl 2 0 or later
gpl-3.0-or-later | spdx gpl later | <tag> gpl 3 0 or later
mit-0 | spdx mit 0 | <tag> mit 0
agpl-3.0-only | spdx agpl | <tag> agpl 3 0(?: only)?
agpl-1.0 | spdx agpl 1 | <tag> agpl 1 0(?: only| or later)?
lgpl-2.0-only | spdx lgpl 2 | <tag> lgpl 2 0(?: only)?
lgpl-2.1-only | spdx lgpl 2 | <tag> lgpl 2 1(?: only)?
lgpl-3.0-only | spdx lgpl 3 | <tag> lgpl 3 0(?: only)?
gpl-1.0-only | spdx gpl 1 | <tag> gpl 1 0(?: only)?
gpl-2.0-only | spdx gpl 2 | <tag> gpl 2 0(?: only)?
gpl-3.0-only | spdx gpl 3 | <tag> gpl 3 0(?: only)?
gfdl | spdx gfdl | <tag> gfdl 1 [123](?: only| or later)?
apache-1.0 | spdx apache 1 | <tag> apache 1 0
apache-1.1 | spdx apache 1 | <tag> apache 1 1
apache-2.0 | spdx apache 2 | <tag> apache 2 0
mit | spdx mit | <tag> mit
isc | spdx isc | <tag> isc
0bsd | spdx 0bsd | <tag> 0bsd
bsd-1-clause | spdx bsd clause 1 | <tag> bsd 1 clause
bsd-2-clause | spdx bsd clause 2 | <tag> bsd 2 clause
bsd-3-clause | spdx bsd clause 3 | <tag> bsd 3 clause
bsd-4-clause | spdx bsd clause 4 | <tag> bsd 4 clause
mpl-1.1 | spdx mpl 1 | <tag> mpl 1 1
mpl-2.0 | spdx mpl 2 | <tag> mpl 2 0
epl-1.0 | spdx epl 1 | <tag> epl 1 0
epl-2.0 | spdx epl 2 | <tag> epl 2 0
cddl-1.0 | spdx cddl | <tag> cddl 1 0
eupl-1.2 | spdx eupl 2 | <tag> eupl 1 2
cc0-1.0 | spdx cc0 | <tag> cc0 1 0
cc-by-4.0 | spdx cc by 4 | <tag> cc by 4 0
cc-by-sa-4.0 | spdx cc by sa 4 | <tag> cc by sa 4 0
cc-by-nc-4.0 | spdx cc by nc 4 | <tag> cc by nc 4 0
cc-by-nd-4.0 | spdx cc by nd 4 | <tag> cc by nd 4 0
cc-by-nc-sa-4.0 | spdx cc by nc sa 4 | <tag> cc by nc sa 4 0
cc-by-nc-nd-4.0 | spdx cc by nc nd 4 | <tag> cc by nc nd 4 0
unlicense | spdx unlicense | <tag> unlicense
wtfpl | spdx wtfpl | <tag> wtfpl
zlib | spdx zlib | <tag> zlib
bsl-1.0 | spdx bsl | <tag> bsl 1 0
artistic-2.0 | spdx artistic 2 | <tag> artistic 2 0
ofl-1.1 | spdx ofl | <tag> ofl 1 1
ms-pl | spdx ms pl | <tag> ms pl
python-2.0 | spdx python | <tag> python 2 0
psf-2.0 | spdx psf | <tag> psf 2 0
postgresql | spdx postgresql | <tag> postgresql
ncsa | spdx ncsa | <tag> ncsa
"""

NOTICES = """
agpl-3.0-or-later | gnu affero later | <under> gnu affero general public license<~12> <v3> (?:of the license )?or (?:at your option )?any later(?: version)?
agpl-3.0 | gnu affero | <under> gnu affero general public license <v3>
agpl | affero | <under> (?:gnu )?affero general public license
lgpl-2.1-or-later | gnu lesser later | <under> gnu lesser general public license<~12> <v2.1> (?:of the license )?or (?:at your option )?any later(?: version)?
lgpl-3.0-or-later | gnu lesser later | <under> gnu lesser general public license<~12> <v3> (?:of the license )?or (?:at your option )?any later(?: version)?
lgpl-2.1 | gnu lesser | <under> gnu lesser general public license <v2.1>
lgpl-3.0 | gnu lesser | <under> gnu lesser general public license <v3>
lgpl-2.0-or-later | gnu library later | <under> gnu library general public license<~12> <v2> (?:of the license )?or (?:at your option )?any later(?: version)?
lgpl-2.0 | gnu library | <under> gnu library general public license <v2>
lgpl | gnu lesser | <under> gnu lesser general public license
gpl-2.0-or-later | gnu general later | <under> gnu general public license<~12> <v2> (?:of the license )?or (?:at your option )?any later(?: version)?
gpl-3.0-or-later | gnu general later | <under> gnu general public license<~12> <v3> (?:of the license )?or (?:at your option )?any later(?: version)?
gpl-2.0-only | gnu general only | <under> gnu general public license <v2> only
gpl-3.0-only | gnu general only | <under> gnu general public license <v3> only
gpl-1.0 | gnu general | <under> gnu general public license <v1>
gpl-2.0 | gnu general | <under> gnu general public license <v2>
gpl-3.0 | gnu general | <under> gnu general public license <v3>
gpl | gnu general | <under> gnu general public license
gpl-2.0 | gpl | <under> (?:gnu )?gpl <v2>
gpl-2.0 | gplv2 | <under> (?:gnu )?gplv2
gpl-3.0 | gpl | <under> (?:gnu )?gpl <v3>
gpl-3.0 | gplv3 | <under> (?:gnu )?gplv3
gpl | gpl | <under> (?:gnu )?gpl
gfdl | gnu free documentation | <under> gnu free documentation license(?: <v1.[123]>)?
apache-1.0 | apache | <under> apache (?:software )?license <v1>
apache-1.1 | apache | <under> apache (?:software )?license <v1.1>
apache-2.0 | apache | <under> apache (?:software )?license <v2>
apache | apache | <under> apache (?:software )?license
mit | license mit | <under> mit (?:open source )?license
mit | licence mit | <under> mit (?:open source )?licence
mit | expat | <under> expat licen[cs]e
x11 | x11 | <under> (?:mit )?x11 licen[cs]e
isc | isc | <under> isc licen[cs]e
bsd-2-clause | bsd clause | <under> (?:2|two) clause (?:simplified )?bsd licen[cs]e
bsd-2-clause | bsd simplified | <under> simplified bsd licen[cs]e
bsd-3-clause | bsd clause | <under> (?:3|three) clause bsd licen[cs]e
bsd-3-clause | bsd new | <under> new bsd licen[cs]e
bsd-3-clause | bsd modified | <under> modified bsd licen[cs]e
bsd-4-clause | bsd original | <under> original bsd licen[cs]e
bsd | bsd | <under> bsd(?: style| type)? licen[cs]e
mpl-1.0 | mozilla | <under> mozilla public licen[cs]e <v1>
mpl-1.1 | mozilla | <under> mozilla public licen[cs]e <v1.1>
mpl-2.0 | mozilla | <under> mozilla public licen[cs]e <v2>
mpl | mozilla | <under> mozilla public licen[cs]e
epl-1.0 | eclipse | <under> eclipse public licen[cs]e <v1>
epl-2.0 | eclipse | <under> eclipse public licen[cs]e <v2>
cddl-1.0 | cddl | <under> cddl(?: <v1>)?
cddl-1.0 | development common distribution | <under> common development and distribution licen[cs]e(?: <v1>)?
eupl | european union public | <under> european union public licen[cs]e(?: <v1.[12]>)?
artistic-2.0 | artistic | <under> artistic licen[cs]e <v2>
artistic-1.0 | artistic | <under> artistic licen[cs]e(?: <v1>)?
perl | perl same terms | (?:under the )?same terms as perl(?: itself)?
ruby | ruby same terms | (?:under the )?same terms as ruby(?: itself)?
bsl-1.0 | boost | <under> boost software licen[cs]e(?: <v1>)?
zlib | zlib | <under> zlib(?: libpng)? licen[cs]e
unlicense | unlicense | <under> unlicense
wtfpl | wtfpl | <under> wtfpl
ofl-1.1 | sil open font | <under> sil open font licen[cs]e(?: <v1.1>)?
ms-pl | microsoft public | <under> microsoft public licen[cs]e
ms-rl | microsoft reciprocal | <under> microsoft reciprocal licen[cs]e
python | python software foundation | <under> python software foundation licen[cs]e(?: <v2>)?
php-3.01 | php | <under> php licen[cs]e(?: <v3.01>)?
postgresql | postgresql | <under> postgresql licen[cs]e
openssl | openssl | <under> openssl(?: and ssleay)? licen[cs]e
cecill | cecill | <under> cecill(?: [abc])?(?: licen[cs]e)?(?: <v2(?:.1)?>)?
cc-by-nc-nd-4.0 | cc by nc nd 4 | <under> (?:creative commons )?cc by nc nd 4 0
cc-by-nc-sa-4.0 | cc by nc sa 4 | <under> (?:creative commons )?cc by nc sa 4 0
cc-by-nc-4.0 | cc by nc 4 | <under> (?:creative commons )?cc by nc 4 0
cc-by-nd-4.0 | cc by nd 4 | <under> (?:creative commons )?cc by nd 4 0
cc-by-sa-4.0 | cc by sa 4 | <under> (?:creative commons )?cc by sa 4 0
cc-by-sa-3.0 | cc by sa 3 | <under> (?:creative commons )?cc by sa 3 0
cc-by-4.0 | cc by 4 | <under> (?:creative commons )?cc by 4 0
cc-by-3.0 | cc by 3 | <under> (?:creative commons )?cc by 3 0
cc-by-nc-nd | creative commons noncommercial | <under> creative commons attribution noncommercial no ?deriv(?:s|atives|ative works)(?: [1-4] 0)?(?: international| unported)?
cc-by-nc-nd | creative commons non commercial | <under> creative commons attribution non commercial no ?deriv(?:s|atives|ative works)(?: [1-4] 0)?(?: international| unported)?
cc-by-nc-sa | creative commons noncommercial | <under> creative commons attribution noncommercial share ?alike(?: [1-4] 0)?(?: international| unported)?
cc-by-nc-sa | creative commons non commercial | <under> creative commons attribution non commercial share ?alike(?: [1-4] 0)?(?: international| unported)?
cc-by-nc | creative commons noncommercial | <under> creative commons attribution noncommercial(?: [1-4] 0)?(?: international| unported)?
cc-by-nc | creative commons non commercial | <under> creative commons attribution non commercial(?: [1-4] 0)?(?: international| unported)?
cc-by-nd | creative commons attribution | <under> creative commons attribution no ?deriv(?:s|atives|ative works)(?: [1-4] 0)?(?: international| unported)?
cc-by-sa | creative commons attribution | <under> creative commons attribution share ?alike(?: [1-4] 0)?(?: international| unported)?
cc-by | creative commons attribution | <under> creative commons attribution(?: [1-4] 0)?(?: international| unported)?
cc0-1.0 | cc0 | <under> cc0(?: 1 0)?(?: universal)?
"""

TEXTS = """
mit | permission hereby granted charge | permission is hereby granted free of charge to any person obtaining a copy of this (?:software|font software) and associated documentation files
mit | substantial portions copyright | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
warranty-disclaimer | warranty software provided | the software is provided as is without warranty of any kind express or implied
isc | permission hereby granted fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
postgresql | permission fee distribute documentation | permission to use copy modify and distribute this software and its documentation for any purpose without fee
bsd | redistribution binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | redistributions binary reproduce | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | endorse promote | neither the name of<~10> nor the names of(?: its)? contributors may be used to endorse or promote products
bsd-4-clause | advertising materials acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
apache-2.0 | apache compliance | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-1.1 | apache developed | this product includes software developed by the apache software foundation
gpl | gnu redistribute general | you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | gnu redistribute lesser | you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl-2.0 | gnu redistribute library | you can redistribute it and or modify it under the terms of the gnu library general public license
agpl | gnu redistribute affero | you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl | freedom licenses | the licenses for most software are designed to take away your freedom to share and change it
gpl | gnu received general | you should have received a copy of the gnu general public license
lgpl | gnu received lesser | you should have received a copy of the gnu lesser general public license
agpl | gnu received affero | you should have received a copy of the gnu affero general public license
gfdl | gnu permission documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0 | mozilla source | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla contents | the contents of this file are subject to the mozilla public license(?: version)? 1 1
cddl-1.0 | development contents | the contents of this file are subject to the terms of the common development and distribution license
epl | eclipse accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license
unlicense | unencumbered domain | this is free and unencumbered software released into the public domain
wtfpl | fuck | you just do what the fuck you want to
zlib | altered versions | altered source versions must be plainly marked as such
bsl-1.0 | organization permission | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
ofl-1.1 | sil font licensed | this font software is licensed under the sil open font license
artistic-1.0 | artistic control | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
ncsa | ncsa illinois | university of illinois ncsa open source license
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
php | php freely | this product includes php software freely available from
cc-by-sa | remix contributions | if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nc | commercial purposes material | you may not use the material for commercial purposes
cc-by-nd | remix distribute modified | if you remix transform or build upon the material you may not distribute the modified material
cc-by | credit appropriate changes | you must give appropriate credit provide a link to the license and indicate if changes were made
cc0-1.0 | waived copyright | has waived all copyright and related or neighboring rights
json | evil good | the software shall be used for good not evil
beerware | beer | you can buy me a beer in return
"""

LINKS = """
apache-2.0 | apache licenses 2 | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-1.1 | apache licenses 1 | (?:https? )?(?:www )?apache org licenses license 1 1(?: txt| html)?
gpl-2.0 | gnu licenses gpl 2 | (?:https? )?(?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html)?
gpl-3.0 | gnu licenses gpl 3 | (?:https? )?(?:www )?gnu org licenses gpl 3 0(?: txt| html)?
gpl | gnu org gpl | (?:https? )?(?:www )?gnu org (?:licenses|copyleft) gpl(?: txt| html)?
lgpl-2.1 | gnu licenses lgpl 2 | (?:https? )?(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: txt| html)?
lgpl-3.0 | gnu licenses lgpl 3 | (?:https? )?(?:www )?gnu org licenses lgpl 3 0(?: txt| html)?
agpl-3.0 | gnu licenses agpl 3 | (?:https? )?(?:www )?gnu org licenses agpl 3 0(?: txt| html)?
gfdl | gnu licenses fdl | (?:https? )?(?:www )?gnu org licenses fdl(?: 1 [123])?(?: txt| html)?
mit | opensource licenses mit | (?:https? )?(?:www )?opensource org licenses mit(?: license)?(?: php)?
bsd-2-clause | opensource licenses bsd 2 | (?:https? )?(?:www )?opensource org licenses bsd 2 clause
bsd-3-clause | opensource licenses bsd 3 | (?:https? )?(?:www )?opensource org licenses bsd 3 clause
isc | opensource licenses isc | (?:https? )?(?:www )?opensource org licenses isc
artistic | opensource licenses artistic | (?:https? )?(?:www )?opensource org licenses artistic license(?: [12] 0)?
mpl-2.0 | mozilla mpl 2 | (?:https? )?(?:www )?mozilla org (?:en us )?mpl 2 0
mpl-1.1 | mozilla mpl 1 | (?:https? )?(?:www )?mozilla org (?:en us )?mpl (?:mpl )?1 1(?: html| txt)?
epl-1.0 | eclipse legal epl v10 | (?:https? )?(?:www )?eclipse org legal epl v10(?: html)?
epl-2.0 | eclipse legal epl | (?:https? )?(?:www )?eclipse org legal epl (?:v20|2 0)(?: html)?
bsl-1.0 | boost license | (?:https? )?(?:www )?boost org license 1 0(?: txt)?
unlicense | unlicense | (?:https? )?(?:www )?unlicense org
wtfpl | wtfpl | (?:https? )?(?:www )?wtfpl net
ofl-1.1 | ofl scripts sil | (?:https? )?(?:www )?scripts sil org ofl
zlib | zlib license | (?:https? )?(?:www )?zlib net zlib license(?: html)?
cc0-1.0 | creativecommons publicdomain zero | (?:https? )?(?:www )?creativecommons org publicdomain zero 1 0
public-domain | creativecommons publicdomain mark | (?:https? )?(?:www )?creativecommons org publicdomain mark 1 0
cc-by-nc-nd-4.0 | creativecommons by nc nd 4 | (?:https? )?(?:www )?creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-3.0 | creativecommons by nc nd 3 | (?:https? )?(?:www )?creativecommons org licenses by nc nd 3 0
cc-by-nc-sa-4.0 | creativecommons by nc sa 4 | (?:https? )?(?:www )?creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3.0 | creativecommons by nc sa 3 | (?:https? )?(?:www )?creativecommons org licenses by nc sa 3 0
cc-by-nc-4.0 | creativecommons by nc 4 | (?:https? )?(?:www )?creativecommons org licenses by nc 4 0
cc-by-nc-3.0 | creativecommons by nc 3 | (?:https? )?(?:www )?creativecommons org licenses by nc 3 0
cc-by-nd-4.0 | creativecommons by nd 4 | (?:https? )?(?:www )?creativecommons org licenses by nd 4 0
cc-by-sa-4.0 | creativecommons by sa 4 | (?:https? )?(?:www )?creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons by sa 3 | (?:https? )?(?:www )?creativecommons org licenses by sa 3 0
cc-by-4.0 | creativecommons by 4 | (?:https? )?(?:www )?creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons by 3 | (?:https? )?(?:www )?creativecommons org licenses by 3 0
"""

VERSIONS = """
agpl-3.0 | affero | (?:gnu )?affero general public licen[cs]e <v3>
lgpl-2.1 | gnu lesser | gnu lesser general public licen[cs]e <v2.1>
lgpl-3.0 | gnu lesser | gnu lesser general public licen[cs]e <v3>
lgpl-2.0 | gnu library | gnu library general public licen[cs]e <v2>
gpl-1.0 | gnu general | gnu general public licen[cs]e <v1>
gpl-2.0 | gnu general | gnu general public licen[cs]e <v2>
gpl-3.0 | gnu general | gnu general public licen[cs]e <v3>
apache-2.0 | apache | apache (?:software )?licen[cs]e <v2>
apache-1.1 | apache | apache (?:software )?licen[cs]e <v1.1>
mpl-2.0 | mozilla | mozilla public licen[cs]e <v2>
mpl-1.1 | mozilla | mozilla public licen[cs]e <v1.1>
epl-1.0 | eclipse | eclipse public licen[cs]e <v1>
epl-2.0 | eclipse | eclipse public licen[cs]e <v2>
eupl-1.1 | eupl | eupl <v1.1>
eupl-1.2 | eupl | eupl <v1.2>
artistic-2.0 | artistic | artistic licen[cs]e <v2>
gpl-2.0 | gpl | (?:gnu )?gpl <v2>
gpl-2.0 | gplv2 | (?:gnu )?gplv2
gpl-3.0 | gpl | (?:gnu )?gpl <v3>
gpl-3.0 | gplv3 | (?:gnu )?gplv3
lgpl-2.1 | lgpl | (?:gnu )?lgpl <v2.1>
lgpl-2.1 | lgplv2 | (?:gnu )?lgplv2(?: 1)?
lgpl-3.0 | lgpl | (?:gnu )?lgpl <v3>
lgpl-3.0 | lgplv3 | (?:gnu )?lgplv3
agpl-3.0 | agpl | (?:gnu )?agpl <v3>
agpl-3.0 | agplv3 | (?:gnu )?agplv3
bsd-2-clause | bsd clause | bsd (?:2|two) clause
bsd-3-clause | bsd clause | bsd (?:3|three) clause
bsd-4-clause | bsd clause | bsd (?:4|four) clause
bsd-2-clause | freebsd | freebsd licen[cs]e
cc-by-nc-nd-4.0 | cc by nc nd 4 | cc by nc nd 4 0
cc-by-nc-sa-4.0 | cc by nc sa 4 | cc by nc sa 4 0
cc-by-nc-4.0 | cc by nc 4 | cc by nc 4 0
cc-by-nd-4.0 | cc by nd 4 | cc by nd 4 0
cc-by-sa-4.0 | cc by sa 4 | cc by sa 4 0
cc-by-sa-3.0 | cc by sa 3 | cc by sa 3 0
cc-by-4.0 | cc by 4 | cc by 4 0
cc-by-3.0 | cc by 3 | cc by 3 0
"""

NAMES = """
agpl | affero | (?:gnu )?affero general public licen[cs]e
lgpl | gnu lesser | gnu lesser general public licen[cs]e
lgpl | gnu library | gnu library general public licen[cs]e
gfdl | gnu free documentation | gnu free documentation licen[cs]e
mpl | mozilla | mozilla public licen[cs]e
epl | eclipse | eclipse public licen[cs]e
cpl-1.0 | common public | common public licen[cs]e(?: <v1>)?
cddl | development common distribution | common development and distribution licen[cs]e
eupl | european union public | european union public licen[cs]e
isc | isc | isc licen[cs]e
x11 | x11 | x11 licen[cs]e
bsd | bsd | bsd(?: style| type)? licen[cs]e
bsl-1.0 | boost | boost software licen[cs]e
zlib | zlib | zlib(?: libpng)? licen[cs]e
artistic | artistic | artistic licen[cs]e
ofl-1.1 | font open | (?:sil )?open font licen[cs]e
ms-pl | microsoft public | microsoft public licen[cs]e
ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e
python | python | python(?: software foundation)? licen[cs]e
php | php | php licen[cs]e
ruby | ruby | ruby licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
openssl | openssl | openssl licen[cs]e
w3c | w3c | w3c software(?: notice and)? licen[cs]e
qpl-1.0 | q public | q public licen[cs]e
ipl-1.0 | ibm public | ibm public licen[cs]e
apsl | apple public source | apple public source licen[cs]e
osl-3.0 | open software | open software licen[cs]e(?: <v3>)?
afl-3.0 | academic free | academic free licen[cs]e(?: <v3>)?
vim | vim | vim licen[cs]e
cc-by-nc-nd | cc by nc nd | cc by nc nd
cc-by-nc-sa | cc by nc sa | cc by nc sa
cc-by-nc | cc by nc | cc by nc
cc-by-nd | cc by nd | cc by nd
cc-by-sa | cc by sa | cc by sa
creative-commons | creative commons | creative commons licen[cs]e
odbl | open database | open database licen[cs]e
public-domain | domain public | (?:in|into|to|is|as) (?:the )?public domain
"""

SHORT = """
gpl | gpl | (?:gnu )?gpl
lgpl | lgpl | (?:gnu )?lgpl
agpl | agpl | (?:gnu )?agpl
cc0-1.0 | cc0 | cc0
eupl | eupl | eupl
cecill | cecill | cecill
wtfpl | wtfpl | wtfpl
unlicense | unlicense | unlicense
gpl-2.0-with-exception | classpath exception | classpath exception
dual-licensed | dual licensed | dual licensed
"""

CLUES = """
proprietary | proprietary confidential | proprietary and confidential
proprietary | property licensed | licensed materials? property of
rights-reserved | reserved rights | all rights reserved
copyright-notice | copyright c | copyright c (?:19|20)[0-9]{2}
"""

#: Phrases whose every place counts, whatever else is found there.
BASE = """
gpl | gnu general public license | gnu general public license
apache | apache license | apache license
cc-by | cc by | cc by
mit | license mit | mit license
"""

#: (priority, lines); a priority is also the strength of the evidence in hundredths.
CLASSES = [(100, TAGS), (95, TEXTS), (90, NOTICES), (80, LINKS), (70, VERSIONS), (55, NAMES), (30, SHORT), (10, CLUES)]
BASE_PRIORITY = 60
