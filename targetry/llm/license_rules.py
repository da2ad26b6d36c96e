"""Signature rules written by hand, in order: sentences that are peculiar to a license or a family of licenses.

Fixed values: what the licenses' public texts say. Words are lower-cased, without punctuation, joined by single spaces.
Each line: label | keyword (words that every match holds) | pattern | priority | confidence.
"""

from __future__ import annotations

from collections.abc import Iterator

WRITTEN = r"""
mit | permission | permission is hereby granted free of charge to any person obtaining a copy | 5 | 1.0
mit | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software | 6 | 1.0
mit | merge publish | (?:without limitation the rights )?to use copy modify merge publish distribute sublicense and or sell copies | 5 | 0.9
mit-0 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided | 8 | 1.0
mit-advertising | advertising | except as contained in this notice the name of [a-z0-9 ]{1,80} shall not be used in advertising or otherwise to promote the sale | 6 | 1.0
x11 | x consortium | (?:name of the )?x consortium shall not be used in advertising | 7 | 1.0
mit-modern | permission | permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute this software | 6 | 1.0
hpnd | permission | permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose(?: and without fee)? is hereby granted | 6 | 1.0
isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | 6 | 1.0
isc | permission | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted | 6 | 1.0
0bsd | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is | 7 | 1.0
isc | warranties | the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness | 4 | 0.8
bsd | redistribution | redistribution and use in source and binary forms(?: with or without modification)? are permitted provided that | 5 | 1.0
bsd | redistributions | redistributions of source code must retain the above copyright notice | 5 | 0.9
bsd | redistributions | redistributions in binary form must reproduce the above copyright notice | 5 | 0.9
bsd-3-clause | endorse | neither the name of [a-z0-9 ]{1,80} nor the names of its contributors may be used to endorse or promote products | 7 | 1.0
bsd-3-clause | endorse | the names? of [a-z0-9 ]{1,60} may not be used to endorse or promote products derived from this software | 6 | 0.9
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment | 8 | 1.0
bsd-4-clause | product includes | this product includes software developed by the university of california(?: berkeley)? and its contributors | 8 | 1.0
bsd-protection | official policies | the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies | 5 | 0.8
bsd-clear | patent | no express or implied licenses to any party s patent rights are granted by this license | 7 | 1.0
bsd-nuclear | nuclear | you acknowledge that this software is not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility | 7 | 1.0
bsd | exemplary | in no event shall the (?:copyright holders?|regents|authors?)(?: or contributors)? be liable for any direct indirect incidental special exemplary or consequential damages | 4 | 0.7
apache | apache | licensed to the apache software foundation asf under one or more contributor license agreements | 7 | 1.0
apache-2.0 | apache | you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 | 8 | 1.0
apache-2.0 | apache | http www apache org licenses license 2 0(?: (?:txt|html))? | 6 | 0.9
apache-2.0 | perpetual | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license | 7 | 1.0
apache-2.0 | perpetual | perpetual worldwide non exclusive no charge royalty free irrevocable (?:except as stated in this section )?patent license | 7 | 1.0
apache-2.0 | definitions | terms and conditions for use reproduction and distribution 1 definitions | 7 | 1.0
apache-2.0 | warranties | distributed on an as is basis without warranties or conditions of any kind either express or implied | 4 | 0.8
apache-1.1 | apache | the names apache and apache software foundation must not be used to endorse or promote products | 8 | 1.0
apache-1.1 | apache | this product includes software developed by the apache software foundation | 6 | 0.8
apache-1.0 | apache | this product includes software developed by the apache group for use in the apache http server project | 8 | 1.0
gpl | gnu | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license | 6 | 1.0
gpl-2-or-later | gnu | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version | 8 | 1.0
gpl-3-or-later | gnu | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version | 8 | 1.0
gpl-2 | gnu | gnu general public license(?: version 2)? as published by the free software foundation version 2(?: of the license)?(?! or) | 7 | 0.9
gpl-2 | gnu | gnu general public license version 2 june 1991 | 8 | 1.0
gpl-3 | gnu | gnu general public license version 3 29 june 2007 | 8 | 1.0
gpl-1 | gnu | gnu general public license version 1 february 1989 | 8 | 1.0
gpl | gnu | you should have received a copy of the gnu general public license along with this (?:program|software|file) | 6 | 1.0
gpl | freedom | the licenses for most software are designed to take away your freedom to share and change it | 6 | 1.0
gpl-3 | propagate | to propagate a work means to do anything with it that without permission would make you directly or secondarily liable | 7 | 1.0
gpl-3 | consumer product | a user product is either 1 a consumer product | 6 | 0.8
gpl-classpath | special exception | as a special exception the copyright holders of this (?:library|program) give you permission to link this | 8 | 1.0
gpl-classpath | classpath | (?:with|subject to) the classpath exception | 7 | 1.0
gpl-bison | bison | as a special exception you may create a larger work that contains part or all of the bison parser skeleton | 8 | 1.0
gpl-autoconf | autoconf | configuration script generated by autoconf you may include it under the same distribution terms | 8 | 1.0
gpl-gcc-exception | gcc runtime | gcc runtime library exception(?: version 3 1)? | 7 | 1.0
gpl-linking | linking exception | gpl (?:v?[23] )?with (?:a )?linking exception | 7 | 0.9
gpl-font | font exception | gpl (?:v?[23] )?with font exception | 7 | 0.9
lgpl | gnu | gnu (?:lesser|library) general public license as published by the free software foundation | 7 | 1.0
lgpl-2.1-or-later | gnu | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version | 9 | 1.0
lgpl-3-or-later | gnu | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version | 9 | 1.0
lgpl-2-or-later | gnu | gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version | 9 | 1.0
lgpl-2.1 | gnu | gnu lesser general public license version 2 1 february 1999 | 9 | 1.0
lgpl-3 | gnu | gnu lesser general public license version 3 29 june 2007 | 9 | 1.0
lgpl-2 | gnu | gnu library general public license version 2 june 1991 | 9 | 1.0
lgpl | combined work | a combined work is a work produced by combining or linking an application with the library | 7 | 1.0
agpl-3 | gnu | gnu affero general public license version 3 19 november 2007 | 9 | 1.0
agpl-3-or-later | gnu | gnu affero general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version | 9 | 1.0
agpl | affero | you should have received a copy of the gnu affero general public license along with this program | 8 | 1.0
agpl | remotely through | interacting with it remotely through a computer network | 6 | 0.9
gfdl | gnu | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license | 8 | 1.0
gfdl-no-invariants | invariant sections | with no invariant sections no front cover texts and no back cover texts | 7 | 1.0
fsf-all-permissive | royalty | copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved | 8 | 1.0
fsf-unlimited | unlimited permission | the free software foundation gives unlimited permission to copy and or distribute it with or without modifications | 8 | 1.0
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0 | 8 | 1.0
mpl-2.0 | mozilla | if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0 | 8 | 1.0
mpl-2.0 | secondary licenses | this source code form is incompatible with secondary licenses | 7 | 1.0
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1 | 8 | 1.0
mpl-1.0 | mozilla | the contents of this file are subject to the mozilla public license version 1 0 | 8 | 1.0
mpl | governing rights | software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations | 6 | 0.9
npl | netscape | the contents of this file are subject to the netscape public license | 8 | 1.0
epl-2.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 | 8 | 1.0
epl-1.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 | 8 | 1.0
epl | recipient | any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement | 6 | 0.8
cpl-1.0 | common public | the accompanying program is provided under the terms of this common public license | 8 | 1.0
ipl-1.0 | ibm | the accompanying program is provided under the terms of this ibm public license | 8 | 1.0
cddl | common development | the contents of this file are subject to the terms of the common development and distribution license | 8 | 1.0
cddl | covered software | covered software is provided under this license on an as is basis without warranty of any kind | 7 | 0.9
eupl | eupl | licensed under the eupl(?: version 1 [012])?(?: or as soon (?:they|as they) will be approved by the european commission subsequent versions)? | 7 | 1.0
eupl | european | european union public licence(?: v(?:ersion)? ?1 [012])? | 6 | 1.0
osl-3.0 | licensed under | licensed under the open software license version 3 0 | 8 | 1.0
afl-3.0 | licensed under | licensed under the academic free license version 3 0 | 8 | 1.0
artistic-2.0 | verbatim copies | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package | 8 | 1.0
artistic-1.0 | package | the intent of this document is to state the conditions under which a package may be copied | 7 | 1.0
perl | perl | (?:same|this library is free software you can redistribute it and or modify it under the same) terms as perl(?: itself)? | 7 | 1.0
perl | artistic | you may distribute under the terms of either the gnu general public license or the artistic license | 7 | 1.0
ruby | bsdl | you can redistribute it and or modify it under either the terms of the 2 clause bsdl | 7 | 1.0
psf | python | python software foundation license(?: version 2)? | 6 | 1.0
psf | psf | psf is making python available to licensee on an as is basis | 8 | 1.0
cnri-python | national research | this license agreement is between the corporation for national research initiatives | 8 | 1.0
beopen | beopen | beopen(?: com)? (?:python )?open source license agreement | 8 | 1.0
php-3.01 | php | this source file is subject to version 3 01 of the php license | 8 | 1.0
php-3.0 | php | this source file is subject to version 3 0 of the php license | 8 | 1.0
php | php | this product includes php software freely available from | 7 | 1.0
zend | zend | zend engine license(?: version 2 00)? | 7 | 1.0
zlib | altered source | altered source versions must be plainly marked as such and must not be misrepresented as being the original software | 7 | 1.0
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software | 7 | 1.0
zlib | express or implied | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages | 5 | 0.8
libpng | libpng | this copy of the libpng notices is provided for your convenience | 8 | 1.0
libtiff | silicon graphics | the names of sam leffler and silicon graphics may not be used in any advertising | 8 | 1.0
ijg | independent jpeg | this software is based in part on the work of the independent jpeg group | 8 | 1.0
bzip2 | bzip2 | this program bzip2 the associated library libbzip2 and all documentation are copyright | 8 | 1.0
curl | stenberg | copyright (?:c )?(?:[0-9]{4} )+daniel stenberg | 7 | 0.9
bsl-1.0 | boost | distributed under the boost software license version 1 0 | 8 | 1.0
bsl-1.0 | machine executable | unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor | 8 | 1.0
bsl-1.0 | boost | http www boost org license 1 0 txt | 7 | 1.0
unlicense | unencumbered | this is free and unencumbered software released into the public domain | 8 | 1.0
unlicense | unlicense | for more information please refer to https? unlicense org | 7 | 1.0
wtfpl | fuck | you just do what the fuck you want to | 8 | 1.0
beerware | in return | if we meet some day and you think this stuff is worth it you can buy me a beer in return | 8 | 1.0
beerware | beer ware | the beer ware license(?: revision 42)? | 7 | 1.0
cc0 | waived | has waived all copyright and related or neighboring rights | 7 | 1.0
cc0 | cc0 | cc0 1 0 universal | 6 | 1.0
cc0 | zero | creativecommons org publicdomain zero 1 0 | 7 | 1.0
public-domain | public domain | this (?:file|code|software|work|program) (?:is|has been)(?: hereby)? (?:placed |released |put )?(?:in|into) the public domain | 6 | 1.0
public-domain | disclaims copyright | the authors? (?:hereby )?disclaims copyright to this source code | 6 | 1.0
public-domain | disclaims copyright | the authors? disclaims copyright to this source code in place of a legal notice here is a blessing | 8 | 1.0
public-domain | public domain | public domain mark 1 0 | 6 | 1.0
public-domain | government | this (?:software|work) was (?:produced|prepared|developed) by (?:employees? of )?the (?:u s|united states|us) government | 6 | 0.8
public-domain | title 17 | pursuant to title 17 section 105 of the united states code | 7 | 1.0
cc-by-4.0 | creativecommons | creativecommons org licenses by 4 0 | 7 | 1.0
cc-by-3.0 | creativecommons | creativecommons org licenses by 3 0 | 7 | 1.0
cc-by-2.0 | creativecommons | creativecommons org licenses by 2 0 | 7 | 1.0
cc-by-sa-4.0 | creativecommons | creativecommons org licenses by sa 4 0 | 7 | 1.0
cc-by-sa-3.0 | creativecommons | creativecommons org licenses by sa 3 0 | 7 | 1.0
cc-by-sa-2.5 | creativecommons | creativecommons org licenses by sa 2 5 | 7 | 1.0
cc-by-nc-4.0 | creativecommons | creativecommons org licenses by nc 4 0 | 7 | 1.0
cc-by-nc-3.0 | creativecommons | creativecommons org licenses by nc 3 0 | 7 | 1.0
cc-by-nc-sa-4.0 | creativecommons | creativecommons org licenses by nc sa 4 0 | 7 | 1.0
cc-by-nc-sa-3.0 | creativecommons | creativecommons org licenses by nc sa 3 0 | 7 | 1.0
cc-by-nd-4.0 | creativecommons | creativecommons org licenses by nd 4 0 | 7 | 1.0
cc-by-nc-nd-4.0 | creativecommons | creativecommons org licenses by nc nd 4 0 | 7 | 1.0
cc-by-nc-nd-3.0 | creativecommons | creativecommons org licenses by nc nd 3 0 | 7 | 1.0
cc-sampling | sampling | creative commons sampling plus(?: 1 0)? | 7 | 1.0
cc-by | appropriate credit | you must give appropriate credit provide a link to the license and indicate if changes were made | 6 | 0.9
cc-by-sa | remix | if you remix transform or build upon the material you must distribute your contributions under the same license as the original | 7 | 1.0
cc-by-nc | commercial purposes | you may not use the material for commercial purposes | 5 | 0.7
cc-by-nd | remix | if you remix transform or build upon the material you may not distribute the modified material | 7 | 1.0
ofl-1.1 | font software | this font software is licensed under the sil open font license version 1 1 | 8 | 1.0
ofl-1.1 | font software | the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself | 8 | 1.0
ofl-1.1 | reserved font | with reserved font name | 6 | 0.9
ubuntu-font | ubuntu font | ubuntu font licen[cs]e(?: version 1 0)? | 8 | 1.0
bitstream-vera | bitstream | bitstream vera is a trademark of bitstream inc | 8 | 1.0
upl-1.0 | lrgrwrks | any piece of software and or hardware listed in the lrgrwrks txt file | 8 | 1.0
upl-1.0 | universal permissive | the universal permissive license upl version 1 0 | 8 | 1.0
ncsa | ncsa | university of illinois ncsa open source license | 7 | 1.0
ncsa | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers | 6 | 0.9
llvm-exception | llvm | apache license v2 0 with llvm exceptions | 9 | 1.0
ms-pl | microsoft | microsoft public license ms pl | 8 | 1.0
ms-rl | microsoft | microsoft reciprocal license ms rl | 8 | 1.0
ms-pl | contributor grants | each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution prepare derivative works | 6 | 0.9
ms-eula | microsoft | microsoft software license terms | 6 | 0.8
qpl-1.0 | q public | the q public license version 1 0 | 7 | 1.0
sspl-1 | server side | server side public license version 1 october 16 2018 | 9 | 1.0
sspl-1 | third parties | making the functionality of the program or modified version available to third parties as a service | 8 | 1.0
elastic-2.0 | hosted or managed | you may not provide the software to third parties as a hosted or managed service | 8 | 1.0
elastic | elastic | licensed under the elastic license(?: 2 0)?(?: and the server side public license v 1)? | 7 | 1.0
busl-1.1 | change date | effective on the change date or the fourth anniversary of the first publicly available distribution | 8 | 1.0
busl-1.1 | additional use | additional use grant | 5 | 0.7
commons-clause | commons clause | commons clause license condition v1 0 | 8 | 1.0
polyform | polyform | polyform (?:noncommercial|perimeter|shield|small business|strict|free trial|internal use) license(?: 1 0 0)? | 8 | 1.0
hippocratic | hippocratic | hippocratic license(?: version)?(?: [123] [01])? | 7 | 1.0
json | good not evil | the software shall be used for good not evil | 9 | 1.0
odbl-1.0 | opendatacommons | opendatacommons org licenses odbl(?: 1 0)? | 8 | 1.0
odc-by-1.0 | opendatacommons | opendatacommons org licenses by(?: 1 0)? | 8 | 1.0
pddl-1.0 | opendatacommons | opendatacommons org licenses pddl(?: 1 0)? | 8 | 1.0
odbl-1.0 | database | this database is made available under the open database license | 8 | 1.0
cdla-permissive | data license | community data license agreement permissive(?: version [12] 0)? | 8 | 1.0
cdla-sharing | data license | community data license agreement sharing(?: version 1 0)? | 8 | 1.0
ogl-uk | open government | contains public sector information licensed under the open government licen[cs]e(?: v[123] 0)? | 8 | 1.0
ogl-uk | open government | open government licen[cs]e(?: v(?:ersion)? ?[123] 0)? | 6 | 0.9
etalab | etalab | (?:licence ouverte|open licence) etalab | 7 | 1.0
cecill-2.1 | cecill | ce logiciel est regi par la licence cecill | 7 | 1.0
cecill | cecill | governed by the cecill(?: [abc])? license under french law and abiding by the rules of distribution of free software | 8 | 1.0
postgresql | written agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted | 7 | 0.9
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit | 8 | 1.0
ssleay | eric young | this product includes cryptographic software written by eric young | 8 | 1.0
openldap | openldap | the openldap public license(?: version 2 [0-9])? | 8 | 1.0
sleepycat | redistributions | redistributions in any form must be accompanied by information on how to obtain complete source code for the db software | 9 | 1.0
vim | vim | there are no restrictions on distributing unmodified copies of vim except that they must include this license text | 8 | 1.0
w3c | licensee | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms | 7 | 0.9
w3c | w3c | w3c software (?:notice and )?(?:document )?license | 7 | 1.0
unicode | unicode | unicode license agreement data files and software | 8 | 1.0
unicode | unicode | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files | 9 | 1.0
icu | icu | icu license icu 1 8 1 and later | 8 | 1.0
ietf | ietf | this document is subject to bcp 78 and the ietf trust s legal provisions relating to ietf documents | 8 | 1.0
zpl-2.1 | zope | zope public license zpl version 2 1 | 8 | 1.0
oracle-bcl | oracle | oracle binary code license agreement for the java se platform products | 8 | 1.0
otn | oracle technology | oracle technology network license agreement | 8 | 1.0
apsl-2.0 | apple | this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license version 2 0 | 9 | 1.0
nvidia | nvidia | nvidia (?:software|source code|cuda toolkit)(?: end user)? license agreement | 7 | 0.9
llama-2 | llama | llama 2 community license agreement | 8 | 1.0
llama-3 | llama | (?:meta )?llama 3(?: [123])? community license agreement | 8 | 1.0
gemma | gemma | gemma terms of use | 7 | 0.9
openrail | rail | (?:bigscience |creativeml )?open rail(?: m)?(?: license)?(?: v(?:ersion)? ?[01] [01])? | 7 | 0.9
openrail | openrail | (?:bigscience |creativeml )?openrail(?: m)?(?: license)?(?: v(?:ersion)? ?[01] [01])? | 7 | 0.9
mulan-2 | 第2版 | 木兰宽松许可证 第2版 | 8 | 1.0
mulan-2 | mulan | mulan psl v2 you can use this software according to the terms and conditions of the mulan psl v2 | 9 | 1.0
blueoak-1.0.0 | blue oak | blue oak model license(?: version)?(?: 1 0 0)? | 8 | 1.0
parity | parity | (?:the )?parity public license(?: [67] 0 0)? | 7 | 1.0
zero-clause | zero clause | (?:bsd zero clause|zero clause bsd)(?: license)? | 7 | 1.0
dual | dual | dual licensed under (?:the )?(?:mit|apache|gpl|bsd)[a-z0-9 ]{0,40} | 5 | 0.8
either | at your option | licensed under either of apache license version 2 0[a-z0-9 ]{0,60} or mit license[a-z0-9 ]{0,60} at your option | 9 | 1.0
proprietary | proprietary | (?:this software is |these materials are |contains )?(?:confidential and proprietary|proprietary and confidential)(?: information)? | 4 | 0.8
proprietary | unauthorized | unauthorized copying of this file via any medium is strictly prohibited | 6 | 1.0
proprietary | written permission | no part of this (?:publication|document|book|work) may be reproduced[a-z0-9 ]{0,120} without (?:the )?(?:prior )?written permission | 5 | 0.9
proprietary | trade | contains (?:valuable )?trade secrets? of | 4 | 0.7
evaluation | evaluation | for (?:internal )?evaluation purposes only | 3 | 0.5
non-commercial | commercial | for non commercial (?:use|purposes) only | 4 | 0.7
non-commercial | noncommercial | for noncommercial (?:use|purposes) only | 4 | 0.7
personal-use | personal | for (?:your )?personal (?:and )?non ?commercial use(?: only)? | 4 | 0.7
academic | academic | for academic (?:and|or) (?:non ?profit )?research (?:use|purposes)(?: only)? | 4 | 0.7
eula | end user | end user licen[cs]e agreement | 4 | 0.7
notice | permission notice | this permission notice shall be included | 2 | 0.4
no-warranty | warranty | without warranty of any kind | 1 | 0.4
no-warranty | warranty | there is no warranty for the program to the extent permitted by applicable law | 4 | 0.7
no-warranty | merchantability | warranty of merchantability or fitness for a particular purpose | 3 | 0.5
all-rights-reserved | rights reserved | all rights reserved | 1 | 0.6
some-rights-reserved | rights reserved | some rights reserved | 2 | 0.6
no-rights-reserved | rights reserved | no rights reserved | 3 | 0.8
public-domain | public domain | (?:released |dedicated |placed )?(?:in|into|to) the public domain | 2 | 0.9
mit | permission | permission is hereby granted free of charge to any person obtaining a copy | 3 | 1.0
isc | permission | permission to use copy modify and or distribute this software for any purpose | 3 | 1.0
bsd | redistribution | redistribution and use in source and binary forms(?: with or without modification)? | 3 | 1.0
copyright | copyright | copyright(?: c)? (?:19|20)[0-9]{2} | 1 | 0.5
cc0 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)? | 2 | 0.9
cc0 | creative commons | creative commons zero | 2 | 0.9
copyleft | copyleft | copyleft | 1 | 0.4
"""  # noqa: RUF001


def written() -> Iterator[tuple[str, str, str, int, float]]:
    """label, keyword, pattern, priority, confidence."""
    for line in WRITTEN.strip().splitlines():
        parts = line.split(" | ")
        label, keyword, pattern = parts[0], parts[1], " | ".join(parts[2:-2])
        yield label, keyword, pattern, int(parts[-2]), float(parts[-1])
