"""Signature rules for licence texts, in order of priority within each label.

Each line: label | keyword | regex. Texts are lower-cased and their words
joined by single spaces before, so punctuation never stands in a regex. A rule
is tried only where its keyword occurs. A leading ``!`` marks an exact grant or
header (priority 3), ``?`` a weak hint (priority 1); the rest have priority 2.
"""

from __future__ import annotations

TEXT = r"""
! mit | mit license | (?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?mit license
! mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | mit license | (?:the )?mit license
mit | expat | expat license
? mit | mit | license mit
! mit-0 | mit no attribution | mit no attribution license
mit-0 | mit 0 | mit 0 license
! x11 | x11 license | (?:under|the) (?:the )?x11 license
x11 | x consortium | (?:the )?name of the x consortium shall not be used in advertising
! isc | isc license | (?:under|the) (?:the )?isc license
! isc | permission to use copy modify and | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
? isc | isc | license isc
! 0bsd | zero clause bsd | zero clause bsd license
0bsd | 0bsd | 0bsd
! bsd-3-clause | neither the name of | neither the names? of .{1,80} may be used to endorse or promote products
! bsd-3-clause | bsd | (?:3|three) clause bsd(?: license)?
bsd-3-clause | bsd 3 clause | bsd 3 clause(?: license)?
bsd-3-clause | new bsd | new bsd license
bsd-3-clause | revised bsd | revised bsd license
bsd-3-clause | modified bsd | modified bsd license
! bsd-2-clause | bsd | (?:2|two) clause bsd(?: license)?
bsd-2-clause | bsd 2 clause | bsd 2 clause(?: license)?
bsd-2-clause | simplified bsd | simplified bsd license
bsd-2-clause | freebsd license | freebsd license
! bsd-4-clause | all advertising materials | all advertising materials mentioning features or use of this software must display
bsd-4-clause | bsd 4 clause | bsd 4 clause(?: license)?
bsd-4-clause | original bsd | original bsd license
bsd-3-clause-clear | clear bsd | clear bsd license
bsd-1-clause | bsd 1 clause | bsd 1 clause(?: license)?
bsd-2-clause-patent | bsd | bsd (?:2 clause plus )?patent(?: license)?
bsd | redistribution and use in source | redistribution and use in source and binary forms with or without modification are permitted
bsd | bsd style | bsd style license
? bsd | bsd license | bsd license
? bsd | license bsd | license bsd
! apache-2 | apache license version 2 | licensed under the apache license version 2(?: 0)?
! apache-2 | apache org licenses license 2 | apache org licenses license 2 0
apache-2 | apache license version 2 | apache license version 2(?: 0)?
apache-2 | apache 2 | apache 2(?: 0)?(?: license)?
apache-2 | apache license 2 | apache license 2(?: 0)?
apache-1.1 | apache | apache (?:software )?license (?:version )?1 1
apache-1.0 | apache | apache (?:software )?license (?:version )?1 0
? apache | apache license | apache (?:software )?license
! gpl-3.0 | gnu general public license | licensed under the (?:terms of the )?gnu general public license version 3(?: 0)?
gpl-3.0 | gnu general public license | gnu general public license (?:as published by .{1,60} )?(?:either )?(?:version|v) 3(?: 0)?
gpl-3.0 | gpl | gpl ?(?:version |v)?3(?: 0)?
gpl-3.0 | gplv3 | gplv3
! gpl-3.0-or-later | gnu general public license | gnu general public license .{0,80}version 3 .{0,40}or at your option any later version
gpl-3.0-or-later | gpl 3 0 or later | gpl 3 0 or later
gpl-3.0-only | gpl 3 0 only | gpl 3 0 only
! gpl-2.0 | gnu general public license | licensed under the (?:terms of the )?gnu general public license version 2(?: 0)?
gpl-2.0 | gnu general public license | gnu general public license (?:as published by .{1,60} )?(?:either )?(?:version|v) 2(?: 0)?
gpl-2.0 | gpl | gpl ?(?:version |v)?2(?: 0)?
gpl-2.0 | gplv2 | gplv2
! gpl-2.0-or-later | gnu general public license | gnu general public license .{0,80}version 2 .{0,40}or at your option any later version
gpl-2.0-or-later | gpl 2 0 or later | gpl 2 0 or later
gpl-2.0-only | gpl 2 0 only | gpl 2 0 only
gpl-2.0-classpath | classpath exception | (?:with )?classpath exception
gpl-1.0 | gnu general public license | gnu general public license version 1(?: 0)?
gpl | gnu general public license | gnu general public license
? gpl | gnu gpl | gnu gpl
? gpl | gpl | gpl (?:licensed|license)
! lgpl-3.0 | lesser general public license | lesser general public license .{0,60}version 3(?: 0)?
lgpl-3.0 | lgpl | lgpl ?(?:version |v)?3(?: 0)?
lgpl-3.0 | lgplv3 | lgplv3
! lgpl-2.1 | lesser general public license | lesser general public license .{0,60}version 2 1
lgpl-2.1 | lgpl | lgpl ?(?:version |v)?2 1
! lgpl-2.0 | library general public license | (?:gnu )?library general public license .{0,60}version 2(?: 0)?
lgpl-2.0 | lgpl 2 0 | lgpl 2 0
lgpl | lesser general public license | (?:gnu )?lesser general public license
lgpl | library general public license | (?:gnu )?library general public license
? lgpl | gnu lgpl | gnu lgpl
! agpl-3.0 | affero general public license | affero general public license .{0,60}version 3(?: 0)?
agpl-3.0 | agpl | agpl ?(?:version |v)?3(?: 0)?
agpl-3.0 | agplv3 | agplv3
agpl-1.0 | affero | affero general public license version 1(?: 0)?
agpl | affero general public license | (?:gnu )?affero general public license
! gfdl-1.3 | free documentation license | free documentation license .{0,40}version 1 3
gfdl-1.2 | free documentation license | free documentation license .{0,40}version 1 2
gfdl-1.1 | free documentation license | free documentation license .{0,40}version 1 1
gfdl | free documentation license | (?:gnu )?free documentation license
? gfdl | gfdl | gfdl
! mpl-2.0 | mozilla public license | subject to the terms of the mozilla public license (?:v|version )?2(?: 0)?
mpl-2.0 | mozilla public license | mozilla public license (?:v|version )?2(?: 0)?
mpl-2.0 | mpl | mpl (?:v|version )?2(?: 0)?
mpl-1.1 | mozilla public license | mozilla public license (?:v|version )?1 1
mpl-1.0 | mozilla public license | mozilla public license (?:v|version )?1 0
mpl | mozilla public license | mozilla public license
! epl-2.0 | eclipse public license | eclipse public license (?:v|version )?2(?: 0)?
epl-2.0 | epl 2 0 | epl 2 0
epl-1.0 | eclipse public license | eclipse public license (?:v|version )?1(?: 0)?
epl-1.0 | epl 1 0 | epl 1 0
epl | eclipse public license | eclipse public license
edl-1.0 | eclipse distribution license | eclipse distribution license(?: (?:v|version )?1(?: 0)?)?
! cddl-1.1 | common development and distribution license | common development and distribution license .{0,20}1 1
cddl-1.0 | common development and distribution license | common development and distribution license .{0,20}1 0
cddl-1.0 | cddl | cddl(?: (?:v|version )?1 0)?
cddl | common development and distribution license | common development and distribution license
cpl-1.0 | common public license | common public license(?: (?:v|version )?1 0)?
ipl-1.0 | ibm public license | ibm public license(?: (?:v|version )?1 0)?
cpal-1.0 | common public attribution license | common public attribution license(?: (?:v|version )?1 0)?
! cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike
! cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
! cc-by-nc | creative commons | creative commons attribution non ?commercial
! cc-by-sa | creative commons | creative commons attribution share ?alike
! cc-by-nd | creative commons | creative commons attribution no ?deriv(?:ative)?s?
cc-by | creative commons attribution | creative commons attribution
! cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa 4 0
! cc-by-nc-sa-3.0 | cc by nc sa | cc by nc sa 3 0
cc-by-nc-sa | cc by nc sa | cc by nc sa
! cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd 4 0
! cc-by-nc-nd-3.0 | cc by nc nd | cc by nc nd 3 0
cc-by-nc-nd | cc by nc nd | cc by nc nd
! cc-by-nc-4.0 | cc by nc | cc by nc 4 0
! cc-by-nc-3.0 | cc by nc | cc by nc 3 0
! cc-by-nc-2.0 | cc by nc | cc by nc 2 0
cc-by-nc | cc by nc | cc by nc
! cc-by-sa-4.0 | cc by sa | cc by sa 4 0
! cc-by-sa-3.0 | cc by sa | cc by sa 3 0
! cc-by-sa-2.0 | cc by sa | cc by sa 2 [05]
cc-by-sa | cc by sa | cc by sa
! cc-by-nd-4.0 | cc by nd | cc by nd 4 0
! cc-by-nd-3.0 | cc by nd | cc by nd 3 0
cc-by-nd | cc by nd | cc by nd
! cc-by-4.0 | cc by | cc by 4 0
! cc-by-3.0 | cc by | cc by 3 0
! cc-by-2.0 | cc by | cc by 2 [05]
? cc-by | cc by | cc by
! cc0-1.0 | cc0 | cc0 1 0(?: universal)?
cc0-1.0 | cc0 | cc0
cc0-1.0 | creative commons zero | creative commons zero
! cc-by-4.0 | creativecommons org | creativecommons org licenses by 4 0
! cc-by-3.0 | creativecommons org | creativecommons org licenses by 3 0
! cc-by-sa-4.0 | creativecommons org | creativecommons org licenses by sa 4 0
! cc-by-sa-3.0 | creativecommons org | creativecommons org licenses by sa 3 0
! cc-by-nc-4.0 | creativecommons org | creativecommons org licenses by nc 4 0
! cc-by-nc-sa-4.0 | creativecommons org | creativecommons org licenses by nc sa 4 0
! cc-by-nc-nd-4.0 | creativecommons org | creativecommons org licenses by nc nd 4 0
! cc0-1.0 | creativecommons org | creativecommons org publicdomain zero 1 0
cc-pdm | creativecommons org | creativecommons org publicdomain mark 1 0
? creative-commons | creative commons | creative commons(?: license)?
! unlicense | unencumbered software | this is free and unencumbered software released into the public domain
unlicense | unlicense | the unlicense
unlicense | unlicense | unlicense org
! wtfpl | what the fuck | do what the fuck you want to public license
wtfpl | wtfpl | wtfpl
! public-domain | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | public domain | (?:is|are) in the public domain
? public-domain | public domain | public domain
! zlib | zlib license | (?:under|the) (?:the )?zlib license
! zlib | altered source versions | altered source versions must be plainly marked as such
zlib | zlib libpng | zlib libpng license
libpng | libpng license | libpng license
libpng-2.0 | png reference library license | png reference library license version 2
! bsl-1.0 | boost software license | (?:distributed )?under the boost software license version 1(?: 0)?
bsl-1.0 | boost software license | boost software license(?: version)?(?: 1(?: 0)?)?
! busl-1.1 | business source license | business source license(?: version)? 1 1
busl | business source license | business source license
busl-1.1 | busl 1 1 | busl 1 1
! elastic-2.0 | elastic license | elastic license (?:v|version )?2(?: 0)?
elastic | elastic license | elastic license
! sspl-1.0 | server side public license | server side public license(?: (?:v|version )?1)?
sspl-1.0 | sspl | sspl(?: 1 0)?
! polyform-nc | polyform noncommercial | polyform noncommercial license(?: 1 0 0)?
polyform-strict | polyform strict | polyform strict license
polyform-shield | polyform shield | polyform shield license
polyform-small-business | polyform small business | polyform small business license
! eupl-1.2 | european union public licence | european union public licence .{0,20}1 2
eupl-1.1 | european union public licence | european union public licence .{0,20}1 1
eupl | european union public licence | european union public licence
eupl-1.2 | eupl 1 2 | eupl 1 2
? eupl | eupl | eupl
! artistic-2.0 | artistic license | artistic license (?:v|version )?2(?: 0)?
artistic-1.0 | artistic license | artistic license (?:v|version )?1(?: 0)?
artistic | artistic license | artistic license
perl | same terms as perl | same terms as perl(?: itself)?
! psf-2.0 | python software foundation license | python software foundation license(?: version 2)?
psf-2.0 | psf license | psf license
python-2.0 | python license | python license(?: 2 0)?
ruby | ruby license | ruby license
php-3.01 | php license | php license .{0,10}3 01
php-3.0 | php license | php license .{0,10}3 0
php | php license | php license
postgresql | postgresql license | postgresql license
openssl | openssl license | openssl license
openssl | openssl toolkit | software developed by the openssl project for use in the openssl toolkit
ssleay | ssleay | ssleay license
curl | curl license | curl license
icu | icu license | icu license
unicode-dfs | unicode | unicode license agreement data files and software
unicode-3.0 | unicode license | unicode license v3
ncsa | university of illinois | university of illinois ncsa open source license
ncsa | ncsa | ncsa open source license
! ofl-1.1 | open font license | sil open font license(?: version)? 1 1
ofl | open font license | (?:sil )?open font license
ofl-1.1 | ofl 1 1 | ofl 1 1
ubuntu-font | ubuntu font licen | ubuntu font licen[cs]e
bitstream-vera | bitstream vera | bitstream vera (?:fonts )?(?:license|copyright)
! odbl-1.0 | open database license | open database license(?: .{0,10}1 0)?
odbl-1.0 | odbl | odbl(?: 1 0)?
odc-by-1.0 | open data commons attribution | open data commons attribution license
odc-by-1.0 | odc by | odc by(?: 1 0)?
pddl-1.0 | public domain dedication and license | public domain dedication and license
pddl-1.0 | pddl | pddl(?: 1 0)?
cdla-permissive-2.0 | community data license agreement | community data license agreement permissive(?: version)? 2(?: 0)?
cdla-permissive-1.0 | community data license agreement | community data license agreement permissive(?: version)? 1(?: 0)?
cdla-sharing-1.0 | community data license agreement | community data license agreement sharing
ogl-uk-3.0 | open government licence | open government licence .{0,10}3 0
ogl-uk-2.0 | open government licence | open government licence .{0,10}2 0
ogl-uk | open government licence | open government licence
etalab-2.0 | licence ouverte | licence ouverte(?: open licence)?(?: 2 0)?
dl-de-by-2.0 | datenlizenz deutschland | datenlizenz deutschland namensnennung
dl-de-zero-2.0 | datenlizenz deutschland | datenlizenz deutschland zero
cecill-2.1 | cecill | cecill (?:v|version )?2 1
cecill-b | cecill b | cecill b
cecill-c | cecill c | cecill c
cecill | cecill | cecill(?: license)?
ms-pl | microsoft public license | microsoft public license
ms-rl | microsoft reciprocal license | microsoft reciprocal license
ms-pl | ms pl | ms pl
apsl-2.0 | apple public source license | apple public source license(?: .{0,10}2 0)?
nasa-1.3 | nasa open source agreement | nasa open source agreement(?: .{0,10}1 3)?
afl-3.0 | academic free license | academic free license .{0,10}3(?: 0)?
afl | academic free license | academic free license
osl-3.0 | open software license | open software license .{0,10}3(?: 0)?
osl | open software license | open software license
qpl-1.0 | q public license | q public license
sleepycat | sleepycat license | sleepycat license
vim | vim license | vim license
w3c | w3c software | w3c software (?:notice and )?license
watcom-1.0 | sybase open watcom | sybase open watcom public license
mulan-psl-2.0 | mulan psl | mulan psl (?:v|version )?2
mulan-psl-2.0 | mulan permissive software license | mulan permissive software license (?:v|version )?2
blueoak-1.0.0 | blue oak model license | blue oak model license(?: 1 0 0)?
upl-1.0 | universal permissive license | universal permissive license(?: .{0,10}1 0)?
fair | fair license | fair license
ecl-2.0 | educational community license | educational community license(?: .{0,10}2 0)?
json | shall be used for good | the software shall be used for good not evil
jpl-image | jpl image use policy | jpl image use policy
beerware | beer ware | beer ware license
beerware | beerware | beerware license
hippocratic-2.1 | hippocratic license | hippocratic license(?: .{0,10}2 1)?
rail-m | openrail m | (?:creativeml )?openrail m(?: license)?
rail | responsible ai license | responsible ai license
llama-2 | llama 2 community license | llama 2 community license(?: agreement)?
commons-clause | commons clause | commons clause (?:license )?condition
proprietary | all rights reserved | (?:proprietary and confidential .{0,40})?all rights reserved
proprietary | proprietary and confidential | proprietary and confidential
? unknown-license | licensed under | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?\S+(?: \S+)? licen[cs]e
"""


def rules() -> list[tuple[int, str, int, str, str]]:
    """(number, label, priority, keyword, regex) of every rule."""
    out = []
    for line in TEXT.strip().splitlines():
        mark, rest = (line[0], line[1:]) if line[0] in "!?" else ("", line)
        label, keyword, regex = (x.strip() for x in rest.split("|", 2))
        out.append((len(out), label, {"!": 3, "": 2, "?": 1}[mark], keyword, regex))
    return out
