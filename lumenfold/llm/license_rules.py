"""The signature rules of ``licenses``, in order of priority.

Each line: label | weight of the evidence | keywords, all of which every match holds | pattern. Patterns are regular
expressions over the words of a text (lower-cased runs of letters and digits, joined by one space) and use only words,
spaces, (?:...), | and ?; W stands for any one word. The classes go from the surest to the weakest; within a
class an earlier rule goes before a later one.
"""

from __future__ import annotations

#: Identifiers: tags that name one license.
IDENTIFIERS = """
agpl-3.0 | 1.0 | spdx agpl | spdx license identifier agpl 3 0(?: only| or later)?
lgpl-2.1 | 1.0 | spdx lgpl | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | 1.0 | spdx lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.0 | 1.0 | spdx lgpl | spdx license identifier lgpl 2 0(?: only| or later)?
gpl-2.0 | 1.0 | spdx gpl | spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0 | 1.0 | spdx gpl | spdx license identifier gpl 3 0(?: only| or later)?
gpl-1.0 | 1.0 | spdx gpl | spdx license identifier gpl 1 0(?: only| or later)?
apache-2.0 | 1.0 | spdx apache | spdx license identifier apache 2 0
apache-1.1 | 1.0 | spdx apache | spdx license identifier apache 1 1
mit-0 | 1.0 | spdx mit | spdx license identifier mit 0
mit | 1.0 | spdx mit | spdx license identifier mit
bsd-2-clause | 1.0 | spdx bsd | spdx license identifier bsd 2 clause
bsd-3-clause | 1.0 | spdx bsd | spdx license identifier bsd 3 clause
bsd-4-clause | 1.0 | spdx bsd | spdx license identifier bsd 4 clause
0bsd | 1.0 | spdx 0bsd | spdx license identifier 0bsd
isc | 1.0 | spdx isc | spdx license identifier isc
mpl-1.1 | 1.0 | spdx mpl | spdx license identifier mpl 1 1
mpl-2.0 | 1.0 | spdx mpl | spdx license identifier mpl 2 0
epl-1.0 | 1.0 | spdx epl | spdx license identifier epl 1 0
epl-2.0 | 1.0 | spdx epl | spdx license identifier epl 2 0
eupl-1.1 | 1.0 | spdx eupl | spdx license identifier eupl 1 1
eupl-1.2 | 1.0 | spdx eupl | spdx license identifier eupl 1 2
cddl-1.0 | 1.0 | spdx cddl | spdx license identifier cddl 1 0
cddl-1.1 | 1.0 | spdx cddl | spdx license identifier cddl 1 1
bsl-1.0 | 1.0 | spdx bsl | spdx license identifier bsl 1 0
busl-1.1 | 1.0 | spdx busl | spdx license identifier busl 1 1
cc0-1.0 | 1.0 | spdx cc0 | spdx license identifier cc0 1 0
cc-by-3.0 | 1.0 | spdx cc | spdx license identifier cc by 3 0
cc-by-4.0 | 1.0 | spdx cc | spdx license identifier cc by 4 0
cc-by-sa-4.0 | 1.0 | spdx cc | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | 1.0 | spdx cc | spdx license identifier cc by nc 4 0
zlib | 1.0 | spdx zlib | spdx license identifier zlib
unlicense | 1.0 | spdx unlicense | spdx license identifier unlicense
wtfpl | 1.0 | spdx wtfpl | spdx license identifier wtfpl
artistic-2.0 | 1.0 | spdx artistic | spdx license identifier artistic 2 0
postgresql | 1.0 | spdx postgresql | spdx license identifier postgresql
python-2.0 | 1.0 | spdx python | spdx license identifier python 2 0
ofl-1.1 | 1.0 | spdx ofl | spdx license identifier ofl 1 1
odbl-1.0 | 1.0 | spdx odbl | spdx license identifier odbl 1 0
apache-2.0 | 1.0 | apache org licenses | (?:www )?apache org licenses license 2 0(?: txt| html)?
mit | 1.0 | opensource org mit | opensource org licenses? mit(?: license)?(?: php)?
bsd-3-clause | 1.0 | opensource org bsd | opensource org licenses? bsd 3 clause
bsd-2-clause | 1.0 | opensource org bsd | opensource org licenses? bsd 2 clause
mpl-2.0 | 1.0 | mozilla org mpl | mozilla org (?:en us )?mpl 2 0
gpl-3.0 | 1.0 | gnu org licenses gpl | gnu org licenses gpl 3 0(?: html| txt| en html)?
gpl-2.0 | 1.0 | gnu org licenses gpl | gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt| en html)?
lgpl-3.0 | 1.0 | gnu org licenses lgpl | gnu org licenses lgpl 3 0(?: html| txt| en html)?
agpl-3.0 | 1.0 | gnu org licenses agpl | gnu org licenses agpl 3 0(?: html| txt| en html)?
cc-by-4.0 | 1.0 | creativecommons org by | creativecommons org licenses by 4 0
cc-by-3.0 | 1.0 | creativecommons org by | creativecommons org licenses by 3 0
cc-by-2.0 | 1.0 | creativecommons org by | creativecommons org licenses by 2 0
cc-by-sa-4.0 | 1.0 | creativecommons org sa | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | 1.0 | creativecommons org sa | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | 1.0 | creativecommons org nc | creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | 1.0 | creativecommons org nc | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | 1.0 | creativecommons org nd | creativecommons org licenses by nc nd 4 0
cc-by-nd-4.0 | 1.0 | creativecommons org nd | creativecommons org licenses by nd 4 0
cc0-1.0 | 1.0 | creativecommons org publicdomain | creativecommons org publicdomain zero 1 0
public-domain | 0.9 | creativecommons org publicdomain | creativecommons org publicdomain mark 1 0
unlicense | 1.0 | unlicense org | unlicense org
"""

#: Notices: sentences of the license texts and of their grants.
NOTICES = """
mit | 0.95 | permission granted charge software | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 0.9 | copyright permission notice portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions
isc | 0.95 | permission granted purpose fee | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
bsd | 0.9 | redistribution binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 0.9 | neither contributors endorse | neither the name of (?:the )?W(?: W)?(?: W)? nor the names of its contributors may be used to endorse
bsd-4-clause | 0.95 | advertising materials acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd | 0.7 | redistributions binary form | redistributions in binary form must reproduce the above copyright notice
bsd | 0.7 | redistributions source code | redistributions of source code must retain the above copyright notice
apache-2.0 | 0.95 | licensed apache version | licensed under the apache license version 2 0(?: the license)?
apache-2.0 | 0.9 | file compliance license | you may not use this file except in compliance with the license
gpl-3.0 | 0.95 | redistribute gnu version | redistribute it and or modify it under the terms of the gnu general public license version 3
gpl-2.0 | 0.95 | redistribute gnu version | redistribute it and or modify it under the terms of the gnu general public license version 2
gpl | 0.9 | redistribute gnu | redistribute it and or modify it under the terms of the gnu general public license
lgpl | 0.9 | redistribute gnu lesser | redistribute it and or modify it under the terms of the gnu lesser general public license
agpl-3.0 | 0.9 | redistribute gnu affero | redistribute it and or modify it under the terms of the gnu affero general public license
gpl | 0.8 | received gnu copy | you should have received a copy of the gnu general public license
lgpl | 0.8 | received gnu lesser | you should have received a copy of the gnu lesser general public license
agpl-3.0 | 0.8 | received gnu affero | you should have received a copy of the gnu affero general public license
mpl-2.0 | 0.95 | source mozilla subject | this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
mpl-1.1 | 0.9 | contents mozilla subject | the contents of this file are subject to the mozilla public license version 1 1
epl-2.0 | 0.95 | available eclipse terms | made available under the terms of the eclipse public license (?:v|version )?2 0
epl-1.0 | 0.95 | available eclipse terms | made available under the terms of the eclipse public license (?:v|version )?1 0
bsl-1.0 | 0.95 | distributed boost software | distributed under the boost software license version 1 0
zlib | 0.9 | provided implied warranty | this software is provided as is without any express or implied warranty in no event
zlib | 0.9 | altered source misrepresented | altered source versions must be plainly marked as such and must not be misrepresented
unlicense | 0.95 | unencumbered public domain | this is free and unencumbered software released into the public domain
cc0-1.0 | 0.95 | waived copyright related rights | has waived all copyright and related (?:or|and) neighboring rights
ofl-1.1 | 0.95 | font licensed sil | this font software is licensed under the sil open font license version 1 1
wtfpl | 0.95 | fuck want public | do what the fuck you want to public license
artistic | 0.9 | perl same terms | under the same terms as perl itself
python-2.0 | 0.9 | python agreement psf | this license agreement is between the python software foundation psf
beerware | 0.95 | buy beer return | you can buy me a beer in return
json | 0.95 | software good evil | the software shall be used for good not evil
cc-by-4.0 | 0.95 | licensed creative attribution | licensed under (?:a|the) creative commons attribution 4 0 international license
cc-by-sa-4.0 | 0.95 | licensed creative sharealike | licensed under (?:a|the) creative commons attribution sharealike 4 0 international license
cc-by-nc-4.0 | 0.95 | licensed creative noncommercial | licensed under (?:a|the) creative commons attribution noncommercial 4 0 international license
cc-by-sa-3.0 | 0.95 | licensed creative sharealike | licensed under (?:a|the) creative commons attribution sharealike 3 0(?: unported)? license
gfdl | 0.95 | terms gnu documentation | under the terms of the gnu free documentation license
proprietary | 0.8 | confidential proprietary unauthorized | unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential
"""

#: Names with a version or variant.
VERSIONS = """
agpl-3.0 | 0.85 | gnu affero version | gnu affero general public license version 3(?: 0)?
agpl-3.0 | 0.85 | agpl | agpl (?:v|version )?3(?: 0)?
agpl-3.0 | 0.85 | agplv3 | agplv3
lgpl-3.0 | 0.85 | gnu lesser version | gnu lesser general public license version 3(?: 0)?
lgpl-2.1 | 0.85 | gnu lesser version | gnu lesser general public license version 2 1
lgpl-2.0 | 0.85 | gnu library version | gnu library general public license version 2(?: 0)?
lgpl-3.0 | 0.85 | lgpl | lgpl (?:v|version )?3(?: 0)?
lgpl-2.1 | 0.85 | lgpl | lgpl (?:v|version )?2 1
lgpl-3.0 | 0.85 | lgplv3 | lgplv3
lgpl-2.1 | 0.85 | lgplv2 | lgplv2 1
gpl-3.0 | 0.85 | gnu general license version | gnu general public license (?:as published by the free software foundation )?version 3(?: 0)?(?: or later)?
gpl-2.0 | 0.85 | gnu general license version | gnu general public license (?:as published by the free software foundation )?version 2(?: 0)?(?: or later)?
gpl-1.0 | 0.85 | gnu general license version | gnu general public license version 1(?: 0)?
gpl-3.0 | 0.85 | gnu general license v3 | gnu general public license v3(?: 0)?
gpl-2.0 | 0.85 | gnu general license v2 | gnu general public license v2(?: 0)?
gpl-3.0 | 0.85 | gpl | gpl (?:v|version )?3(?: 0)?
gpl-2.0 | 0.85 | gpl | gpl (?:v|version )?2(?: 0)?
gpl-3.0 | 0.85 | gplv3 | (?:gnu )?gplv3
gpl-2.0 | 0.85 | gplv2 | (?:gnu )?gplv2
apache-2.0 | 0.85 | apache license | apache (?:software )?license (?:version |v )?2(?: 0)?
apache-1.1 | 0.85 | apache license | apache (?:software )?license (?:version |v )?1 1
apache-1.0 | 0.85 | apache license | apache (?:software )?license (?:version |v )?1 0
apache-2.0 | 0.8 | apache | apache (?:v )?2 0
apache-2.0 | 0.85 | asl | asl 2 0
bsd-2-clause | 0.85 | bsd clause | bsd 2 clause(?: license)?
bsd-3-clause | 0.85 | bsd clause | bsd 3 clause(?: license)?
bsd-4-clause | 0.85 | bsd clause | bsd 4 clause(?: license)?
bsd-2-clause | 0.85 | clause bsd | (?:2|two) clause bsd(?: license)?
bsd-3-clause | 0.85 | clause bsd | (?:3|three) clause bsd(?: license)?
bsd-4-clause | 0.85 | clause bsd | (?:4|four) clause bsd(?: license)?
bsd-2-clause | 0.85 | simplified bsd | simplified bsd license
bsd-2-clause | 0.8 | freebsd license | freebsd license
bsd-3-clause | 0.85 | modified bsd | modified bsd license
bsd-3-clause | 0.85 | new bsd | new bsd license
bsd-3-clause | 0.85 | revised bsd | revised bsd license
bsd-4-clause | 0.85 | original bsd | original bsd license
mpl-2.0 | 0.85 | mozilla license | mozilla public license (?:version |v )?2 0
mpl-1.1 | 0.85 | mozilla license | mozilla public license (?:version |v )?1 1
mpl-1.0 | 0.85 | mozilla license | mozilla public license (?:version |v )?1 0
mpl-2.0 | 0.8 | mpl | mpl (?:v|version )?2 0
mpl-1.1 | 0.8 | mpl | mpl (?:v|version )?1 1
epl-2.0 | 0.85 | eclipse license | eclipse public license (?:version |v )?2 0
epl-1.0 | 0.85 | eclipse license | eclipse public license (?:version |v )?1 0
epl-2.0 | 0.8 | epl | epl (?:v|version )?2 0
epl-1.0 | 0.8 | epl | epl (?:v|version )?1 0
eupl-1.2 | 0.85 | european union licence | european union public licence (?:version |v )?1 2
eupl-1.1 | 0.85 | european union licence | european union public licence (?:version |v )?1 1
eupl-1.2 | 0.85 | eupl | eupl (?:v|version )?1 2
cddl-1.0 | 0.85 | cddl | cddl (?:v|version )?1 0
cddl-1.1 | 0.85 | cddl | cddl (?:v|version )?1 1
cddl-1.0 | 0.85 | common development license | common development and distribution license version 1 0
busl-1.1 | 0.85 | business source license | business source license (?:version )?1 1
artistic-2.0 | 0.85 | artistic license | artistic license (?:version )?2 0
artistic-1.0 | 0.85 | artistic license | artistic license (?:version )?1 0
osl-3.0 | 0.85 | open software license | open software license (?:version |v )?3 0
afl-3.0 | 0.85 | academic free license | academic free license (?:version |v )?3 0
ofl-1.1 | 0.85 | sil font license | sil open font license (?:version )?1 1
gfdl-1.3 | 0.85 | gnu documentation version | gnu free documentation license version 1 3
gfdl-1.2 | 0.85 | gnu documentation version | gnu free documentation license version 1 2
odbl-1.0 | 0.85 | open database license | open database license (?:v|version )?1 0
cc-by-nc-nd-4.0 | 0.85 | cc by nd | cc by nc nd 4 0
cc-by-nc-nd-3.0 | 0.85 | cc by nd | cc by nc nd 3 0
cc-by-nc-nd | 0.8 | cc by nd | cc by nc nd
cc-by-nc-sa-4.0 | 0.85 | cc by sa | cc by nc sa 4 0
cc-by-nc-sa-3.0 | 0.85 | cc by sa | cc by nc sa 3 0
cc-by-nc-sa | 0.8 | cc by sa | cc by nc sa
cc-by-nc-4.0 | 0.85 | cc by nc | cc by nc 4(?: 0)?
cc-by-nc-3.0 | 0.85 | cc by nc | cc by nc 3(?: 0)?
cc-by-nc-2.0 | 0.85 | cc by nc | cc by nc 2(?: 0)?
cc-by-nc | 0.8 | cc by nc | cc by nc
cc-by-nd-4.0 | 0.85 | cc by nd | cc by nd 4 0
cc-by-nd-3.0 | 0.85 | cc by nd | cc by nd 3 0
cc-by-nd | 0.8 | cc by nd | cc by nd
cc-by-sa-4.0 | 0.85 | cc by sa | cc by sa 4(?: 0)?
cc-by-sa-3.0 | 0.85 | cc by sa | cc by sa 3(?: 0)?
cc-by-sa-2.0 | 0.85 | cc by sa | cc by sa 2(?: 0)?
cc-by-sa | 0.8 | cc by sa | cc by sa
cc-by-4.0 | 0.85 | cc by | cc by 4(?: 0)?
cc-by-3.0 | 0.85 | cc by | cc by 3(?: 0)?
cc-by-2.5 | 0.85 | cc by | cc by 2 5
cc-by-2.0 | 0.85 | cc by | cc by 2 0
cc-by-nc-nd-4.0 | 0.85 | creative commons noderivatives | creative commons attribution noncommercial noderivatives 4 0
cc-by-nc-sa-4.0 | 0.85 | creative commons sharealike | creative commons attribution noncommercial sharealike 4 0
cc-by-nc-4.0 | 0.85 | creative commons noncommercial | creative commons attribution noncommercial 4 0
cc-by-nc | 0.8 | creative commons noncommercial | creative commons attribution noncommercial
cc-by-nc | 0.8 | creative commons non commercial | creative commons attribution non commercial
cc-by-sa-4.0 | 0.85 | creative commons sharealike | creative commons attribution sharealike 4 0
cc-by-sa-3.0 | 0.85 | creative commons sharealike | creative commons attribution sharealike 3 0
cc-by-sa | 0.8 | creative commons sharealike | creative commons attribution sharealike
cc-by-sa | 0.8 | creative commons share alike | creative commons attribution share alike
cc-by-nd | 0.8 | creative commons noderivatives | creative commons attribution noderivatives
cc-by-4.0 | 0.85 | creative commons attribution | creative commons attribution 4 0
cc-by-3.0 | 0.85 | creative commons attribution | creative commons attribution 3 0
cc0-1.0 | 0.85 | cc0 | cc0 1 0(?: universal)?
"""

#: Names alone.
NAMES = """
agpl | 0.7 | gnu affero license | gnu affero general public license
agpl | 0.6 | agpl | agpl
lgpl | 0.7 | gnu lesser license | gnu lesser general public license
lgpl | 0.7 | gnu library license | gnu library general public license
lgpl | 0.6 | lgpl | lgpl
gpl | 0.7 | gnu general license | gnu general public license
gpl | 0.6 | gnu gpl | gnu gpl
gpl | 0.5 | gpl | gpl
apache | 0.7 | apache license | apache (?:software )?license
bsd | 0.7 | bsd license | bsd (?:style )?license
mit-0 | 0.7 | mit attribution | mit no attribution
mit | 0.7 | mit license | mit license
mit | 0.7 | expat license | expat license
x11 | 0.7 | x11 license | x11 license
isc | 0.7 | isc license | isc license
mpl | 0.7 | mozilla license | mozilla public license
epl | 0.7 | eclipse license | eclipse public license
eupl | 0.7 | european union licence | european union public licence
cddl | 0.7 | common development license | common development and distribution license
cpl | 0.7 | common public license | common public license
bsl-1.0 | 0.7 | boost software license | boost software license
busl | 0.7 | business source license | business source license
sspl | 0.7 | server side license | server side public license
elastic | 0.7 | elastic license | elastic license
zlib | 0.7 | zlib license | zlib (?:libpng )?license
libpng | 0.7 | libpng license | libpng license
openssl | 0.7 | openssl license | openssl license
postgresql | 0.7 | postgresql license | postgresql license
python | 0.7 | python license | python (?:software foundation )?license
php | 0.7 | php license | php license
ruby | 0.7 | ruby license | ruby license
perl | 0.6 | perl license | perl license
artistic | 0.7 | artistic license | artistic license
ncsa | 0.7 | ncsa license | ncsa (?:open source )?license
w3c | 0.7 | w3c license | w3c (?:software )?license
unicode | 0.7 | unicode license | unicode (?:data files and software )?license
curl | 0.7 | curl license | curl license
vim | 0.7 | vim license | vim license
ms-pl | 0.7 | microsoft public license | microsoft public license
ms-rl | 0.7 | microsoft reciprocal license | microsoft reciprocal license
osl | 0.7 | open software license | open software license
afl | 0.7 | academic free license | academic free license
ofl | 0.7 | open font license | (?:sil )?open font license
gfdl | 0.7 | gnu documentation license | gnu free documentation license
fal | 0.7 | free art license | free art license
odbl | 0.7 | open database license | open database license
odc-by | 0.7 | open data commons attribution | open data commons attribution license
pddl | 0.7 | public domain dedication | public domain dedication and license
cc0 | 0.7 | cc0 | cc0
cc-by | 0.6 | cc by | cc by
cc | 0.6 | creative commons | creative commons(?: license)?
ogl | 0.7 | open government licence | open government licence
openrail | 0.7 | openrail | (?:creativeml )?openrail(?: m)?
llama | 0.7 | llama community license | llama(?: W)? community license(?: agreement)?
unlicense | 0.7 | unlicense | (?:the )?unlicense
wtfpl | 0.7 | wtfpl | wtfpl
beerware | 0.7 | beerware | beerware
"""

#: Hints: wording that speaks of rights without naming a license.
HINTS = """
public-domain | 0.6 | public domain | (?:released|dedicated|placed|is) (?:into|to|in) the public domain
public-domain | 0.5 | public domain | public domain
all-rights-reserved | 0.6 | all rights reserved | all rights reserved
copyleft | 0.4 | copyleft | copyleft
proprietary | 0.4 | proprietary license | proprietary (?:software )?license
commercial | 0.4 | commercial license | commercial license
non-commercial | 0.5 | non commercial only | (?:for )?non commercial use only
non-commercial | 0.5 | noncommercial only | (?:for )?noncommercial use only
evaluation | 0.5 | evaluation purposes only | (?:for )?evaluation purposes only
royalty-free | 0.4 | royalty free license | royalty free license
dual | 0.5 | dual licensed under | dual licensed under
eula | 0.5 | end user license agreement | end user license agreement
open-source | 0.3 | open source license | open source license
permissive | 0.3 | permissive license | permissive (?:open source |free software )?license
"""

CLASSES = (IDENTIFIERS, NOTICES, VERSIONS, NAMES, HINTS)
