"""The licence rules: names, sentence forms, and single clauses, each with its gate word.

A rule is (label, priority, score, keyword, pattern); patterns meet text whose ASCII capitals are
already small. The gate word is a plain substring that every match contains, so a rule is tried
only where its word occurs. Priorities rank forms: a tag over a grant, a grant over a clause, a clause
over a bare name.
"""

from __future__ import annotations

_V = r"(?:,?\s*(?:version|ver\.?|v\.?)?\s*"

#: Fixed values: (label, keyword, pattern of the name).
NAMES: list[tuple[str, str, str]] = [
    ("0bsd", "bsd", r"(?:0bsd|zero[- ]clause bsd(?: license)?)"),
    ("afl-3.0", "academic free", r"academic free license" + _V + r"3(?:\.0)?)?"),
    ("agpl-1.0", "affero", r"affero general public license" + _V + r"1(?:\.0)?)"),
    ("agpl-3.0", "affero", r"(?:gnu\s+)?affero general public license" + _V + r"3(?:\.0)?)"),
    ("agpl", "agpl", r"\bagpl(?:[- ]?v?3(?:\.0)?)?\b"),
    ("apache-1.0", "apache", r"apache (?:software )?license" + _V + r"1\.0)"),
    ("apache-1.1", "apache", r"apache (?:software )?license" + _V + r"1\.1)"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?" + _V + r"2(?:\.0)?)"),
    ("apache", "apache", r"apache (?:software )?license"),
    ("apsl-2.0", "apple public", r"apple public source license" + _V + r"2(?:\.0)?)?"),
    ("artistic-1.0", "artistic", r"artistic license" + _V + r"1(?:\.0)?)"),
    ("artistic-2.0", "artistic", r"artistic license" + _V + r"2(?:\.0)?)"),
    ("artistic", "artistic", r"artistic license"),
    ("beerware", "beer", r"beer-?ware license"),
    ("blueoak-1.0.0", "blue oak", r"blue oak model license(?:\s*1\.0\.0)?"),
    ("bsd-1-clause", "bsd", r"bsd[- ]1[- ]clause(?: license)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd[- ]2[- ]clause|simplified bsd|freebsd)(?: license)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd[- ]3[- ]clause|new bsd|modified bsd|revised bsd)(?: license)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd[- ]4[- ]clause|original bsd)(?: license)?"),
    ("bsd", "bsd", r"\bbsd(?:-style)? licen[cs]e"),
    ("bsl-1.0", "boost", r"boost software license" + _V + r"1(?:\.0)?)?"),
    ("busl-1.1", "business source", r"business source license" + _V + r"1\.1)?"),
    ("cc0-1.0", "cc0", r"\bcc0(?:[- ]1\.0)?\b"),
    ("cc-by-1.0", "cc", r"\bcc[- ]by[- ]1\.0"),
    ("cc-by-2.0", "cc", r"\bcc[- ]by[- ]2\.0"),
    ("cc-by-2.5", "cc", r"\bcc[- ]by[- ]2\.5"),
    ("cc-by-3.0", "cc", r"\bcc[- ]by[- ]3\.0"),
    ("cc-by-4.0", "cc", r"\bcc[- ]by[- ]4\.0"),
    ("cc-by-sa-2.0", "cc", r"\bcc[- ]by[- ]sa[- ]2\.0"),
    ("cc-by-sa-2.5", "cc", r"\bcc[- ]by[- ]sa[- ]2\.5"),
    ("cc-by-sa-3.0", "cc", r"\bcc[- ]by[- ]sa[- ]3\.0"),
    ("cc-by-sa-4.0", "cc", r"\bcc[- ]by[- ]sa[- ]4\.0"),
    ("cc-by-nc-2.0", "cc", r"\bcc[- ]by[- ]nc[- ]2\.0"),
    ("cc-by-nc-3.0", "cc", r"\bcc[- ]by[- ]nc[- ]3\.0"),
    ("cc-by-nc-4.0", "cc", r"\bcc[- ]by[- ]nc[- ]4\.0"),
    ("cc-by-nd-3.0", "cc", r"\bcc[- ]by[- ]nd[- ]3\.0"),
    ("cc-by-nd-4.0", "cc", r"\bcc[- ]by[- ]nd[- ]4\.0"),
    ("cc-by-nc-sa-3.0", "cc", r"\bcc[- ]by[- ]nc[- ]sa[- ]3\.0"),
    ("cc-by-nc-sa-4.0", "cc", r"\bcc[- ]by[- ]nc[- ]sa[- ]4\.0"),
    ("cc-by-nc-nd-3.0", "cc", r"\bcc[- ]by[- ]nc[- ]nd[- ]3\.0"),
    ("cc-by-nc-nd-4.0", "cc", r"\bcc[- ]by[- ]nc[- ]nd[- ]4\.0"),
    ("cc", "creative commons", r"creative commons(?: attribution)?(?:[- ](?:sharealike|noncommercial|noderiv(?:ative)?s))*(?: \d\.\d)?(?: international)?(?: license)?"),
    ("cddl-1.0", "common development", r"common development and distribution license" + _V + r"1(?:\.0)?)?"),
    ("cecill", "cecill", r"\bcecill(?:-[abc])?\b"),
    ("cpal-1.0", "common public attribution", r"common public attribution license" + _V + r"1(?:\.0)?)?"),
    ("cpl-1.0", "common public", r"common public license" + _V + r"1(?:\.0)?)?"),
    ("ecl-2.0", "educational community", r"educational community license" + _V + r"2(?:\.0)?)?"),
    ("epl-1.0", "eclipse", r"eclipse public license" + _V + r"1(?:\.0)?)"),
    ("epl-2.0", "eclipse", r"eclipse public license" + _V + r"2(?:\.0)?)"),
    ("epl", "eclipse", r"eclipse public license"),
    ("eupl-1.1", "european union", r"european union public licen[cs]e" + _V + r"1\.1)"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e" + _V + r"1\.2)?"),
    ("fsl", "functional source", r"functional source license"),
    ("gfdl-1.3", "free documentation", r"(?:gnu )?free documentation license" + _V + r"1\.[123])?"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public license" + _V + r"1(?:\.0)?)"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public license" + _V + r"2(?:\.0)?)"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public license" + _V + r"3(?:\.0)?)"),
    ("gpl", "general public", r"(?:gnu )?general public license"),
    ("gpl-2.0", "gpl", r"\bgpl[- ]?v?2(?:\.0)?(?:-only|-or-later|\+)?"),
    ("gpl-3.0", "gpl", r"\bgpl[- ]?v?3(?:\.0)?(?:-only|-or-later|\+)?"),
    ("hippocratic", "hippocratic", r"hippocratic license(?:\s*[23]\.\d)?"),
    ("ibm-pl", "ibm public", r"ibm public license"),
    ("imagemagick", "imagemagick", r"imagemagick license"),
    ("intel", "intel open", r"intel open source license"),
    ("isc", "isc", r"\bisc license"),
    ("lgpl-2.0", "general public", r"(?:gnu )?library general public license" + _V + r"2(?:\.0)?)?"),
    ("lgpl-2.1", "general public", r"(?:gnu )?lesser general public license" + _V + r"2\.1)"),
    ("lgpl-3.0", "general public", r"(?:gnu )?lesser general public license" + _V + r"3(?:\.0)?)"),
    ("lgpl", "general public", r"(?:gnu )?lesser general public license"),
    ("lgpl", "lgpl", r"\blgpl(?:[- ]?v?[23](?:\.[01])?)?(?:-only|-or-later|\+)?"),
    ("llama", "llama", r"llama \d(?:\.\d)? community license"),
    ("lppl-1.3c", "latex project", r"latex project public license" + _V + r"1\.3c?)?"),
    ("mit-0", "mit", r"\bmit (?:no attribution|-0|0)(?: license)?"),
    ("mit", "mit", r"\b(?:expat|mit)(?:/x11)?\s+licen[cs]e"),
    ("mpl-1.1", "mozilla", r"mozilla public license" + _V + r"1\.1)"),
    ("mpl-2.0", "mozilla", r"mozilla public license" + _V + r"2(?:\.0)?)"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license"),
    ("mulanpsl-2.0", "mulan", r"mulan permissive software license" + _V + r"2)?"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source license"),
    ("odbl", "open database", r"open database license" + _V + r"1(?:\.0)?)?"),
    ("odc-by", "open data commons", r"open data commons attribution license" + _V + r"1(?:\.0)?)?"),
    ("ofl-1.1", "open font", r"(?:sil )?open font license" + _V + r"1\.1)?"),
    ("openrail", "rail", r"(?:bigscience |creativeml )?open ?rail(?:[-+]{1,2}m)?(?: license)?"),
    ("openssl", "openssl", r"openssl license"),
    ("osl-3.0", "open software", r"open software license" + _V + r"3(?:\.0)?)?"),
    ("php-3.01", "php", r"\bphp license" + _V + r"3(?:\.01?)?)?"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("psf-2.0", "python software", r"python software foundation license" + _V + r"2(?:\.0)?)?"),
    ("qpl-1.0", "q public", r"\bq public license" + _V + r"1(?:\.0)?)?"),
    ("ruby", "ruby", r"ruby license"),
    ("sspl-1.0", "server side", r"server side public license" + _V + r"1(?:\.0)?)?"),
    ("unlicense", "unlicense", r"\bunlicense\b"),
    ("upl-1.0", "universal permissive", r"universal permissive license" + _V + r"1(?:\.0)?)?"),
    ("vim", "vim", r"\bvim license"),
    ("w3c", "w3c", r"w3c (?:software )?(?:notice and )?license"),
    ("wtfpl", "wtf", r"(?:\bwtfpl\b|do what the f\w* you want to public license)"),
    ("x11", "x11", r"\bx11 license"),
    ("zlib", "zlib", r"zlib(?:/libpng)? license"),
    ("zpl-2.1", "zope", r"zope public license" + _V + r"2\.1)?"),
]

#: Clauses that name no licence, (label, priority, score, keyword, pattern).
CLAUSES: list[tuple[str, int, float, str, str]] = [
    ("mit", 60, 0.9, "free of charge", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("mit", 55, 0.8, "copies or substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("isc", 60, 0.9, "permission to use", r"permission to use, copy, modify,? and/?(?:or)? distribute this software for any purpose with or without fee"),
    ("bsd", 55, 0.8, "redistribution", r"redistribution and use in source and binary forms,? with or without modification,? are permitted"),
    ("bsd-2-clause", 50, 0.7, "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", 60, 0.85, "endorse", r"neither the name of [^.\n]{1,120} nor the names of its contributors may be used to endorse"),
    ("bsd-4-clause", 60, 0.85, "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", 60, 0.9, "compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", 55, 0.8, "limitations under", r"see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", 60, 0.9, "free software", r"this (?:program|library|file) is free software[;:,] you can redistribute it and/or modify it"),
    ("gpl", 50, 0.7, "free software foundation", r"as published by the free software foundation"),
    ("gpl", 50, 0.6, "hope that it will be useful", r"distributed in the hope that it will be useful,? but without any warranty"),
    ("mpl-2.0", 60, 0.9, "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", 60, 0.9, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", 45, 0.7, "public domain", r"(?:released|placed|dedicated|in)(?:\s+\w+){0,2}\s+(?:to|into|in|the)\s+(?:the\s+)?public domain"),
    ("public-domain", 45, 0.6, "public domain", r"public domain dedication"),
    ("zlib", 60, 0.9, "express or implied", r"this software is provided 'as-is',? without any express or implied warranty"),
    ("zlib", 55, 0.8, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("bsl-1.0", 60, 0.9, "machine-executable", r"machine-executable object code generated by a source language processor"),
    ("wtfpl", 60, 0.9, "do what the", r"you just do what the f\w* you want to"),
    ("ofl-1.1", 60, 0.85, "font software", r"the font software may be modified, altered, or added to"),
    ("cc", 60, 0.9, "creativecommons.org", r"creativecommons\.org/licenses/[a-z-]+/\d\.\d"),
    ("cc0-1.0", 65, 0.9, "creativecommons.org", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("apache-2.0", 65, 0.9, "apache.org", r"apache\.org/licenses/license-2\.0"),
    ("gpl", 65, 0.85, "gnu.org", r"gnu\.org/(?:licenses|copyleft)/gpl[^\s]*"),
    ("lgpl", 66, 0.85, "gnu.org", r"gnu\.org/(?:licenses|copyleft)/lgpl[^\s]*"),
    ("agpl", 66, 0.85, "gnu.org", r"gnu\.org/licenses/agpl[^\s]*"),
    ("mit", 65, 0.9, "opensource.org", r"opensource\.org/licenses/mit\b"),
    ("bsd-3-clause", 65, 0.9, "opensource.org", r"opensource\.org/licenses/bsd-3-clause"),
    ("mpl-2.0", 65, 0.9, "mozilla.org", r"mozilla\.org/mpl/2\.0"),
    ("proprietary", 45, 0.8, "all rights reserved", r"all rights reserved\.?"),
    ("proprietary", 50, 0.8, "proprietary", r"proprietary (?:and|&) confidential"),
    ("proprietary", 45, 0.7, "without the prior", r"without the prior (?:express )?written (?:consent|permission)"),
    ("commercial", 45, 0.7, "commercial license", r"(?:a|under)(?: the)? commercial license"),
    ("non-commercial", 45, 0.7, "commercial", r"(?:for|to) non-?commercial (?:use|purposes?)(?: only)?"),
    ("copyright", 20, 0.5, "copyright", r"copyright (?:\(c\)|©)?\s*(?:19|20)\d\d(?:\s*[-,]\s*(?:19|20)?\d\d)*"),
    ("copyright", 15, 0.4, "©", r"©\s*(?:19|20)\d\d"),
    ("copyleft", 20, 0.5, "copyleft", r"\bcopyleft\b"),
    ("licensed", 5, 0.3, "licensed under", r"licensed under"),
    ("licensed", 5, 0.3, "licence", r"\blicence[ds]?\b"),
    ("gpl-2.0", 62, 0.9, "version 2 of the license", r"either version 2 of the license,? or \(at your option\) any later version"),
    ("gpl-3.0", 62, 0.9, "version 3 of the license", r"either version 3 of the license,? or \(at your option\) any later version"),
    ("lgpl-2.1", 62, 0.9, "version 2.1 of the license", r"either version 2\.1 of the license,? or \(at your option\) any later version"),
    ("gpl", 52, 0.7, "received a copy of the gnu", r"you should have received a copy of the gnu general public license along with"),
    ("lgpl", 53, 0.7, "received a copy of the gnu", r"you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("agpl", 53, 0.7, "received a copy of the gnu", r"you should have received a copy of the gnu affero general public license along with"),
    ("gpl", 48, 0.6, "temple place", r"59 temple place,? suite 330,? boston"),
    ("gpl", 48, 0.6, "franklin st", r"51 franklin st(?:reet|\.)?,? fifth floor,? boston"),
    ("gpl-2.0", 58, 0.85, "june 1991", r"gnu general public license version 2,? june 1991"),
    ("gpl-3.0", 58, 0.85, "29 june 2007", r"gnu general public license version 3,? 29 june 2007"),
    ("agpl-3.0", 58, 0.85, "19 november 2007", r"gnu affero general public license version 3,? 19 november 2007"),
    ("lgpl-2.1", 58, 0.85, "february 1999", r"gnu lesser general public license version 2\.1,? february 1999"),
    ("gpl", 47, 0.6, "freedom to share", r"licenses for most software are designed to take away your freedom to share and change it"),
    ("agpl", 57, 0.8, "interacting with it remotely", r"users interacting with it remotely through a computer network"),
    ("classpath-exception", 68, 0.9, "special exception", r"as a special exception,? the copyright holders? of this library give you permission to link"),
    ("gcc-exception", 68, 0.9, "runtime library exception", r"gcc runtime library exception(?:,? version 3\.1)?"),
    ("autoconf-exception", 68, 0.85, "special exception", r"as a special exception to the gnu general public license,? if you distribute this file as part of a program that contains a configuration script"),
    ("bison-exception", 68, 0.85, "special exception", r"as a special exception,? you may create a larger work that contains part or all of the bison parser skeleton"),
    ("linking-exception", 67, 0.8, "special exception", r"as a special exception,? (?:you may|permission is granted to) link"),
    ("syscall-note", 68, 0.9, "user programs that use kernel", r"does \*?not\*? cover user programs that use kernel services by normal system calls"),
    ("llvm-exception", 68, 0.9, "llvm", r"apache license v2\.0 with llvm exceptions?"),
    ("llvm-exception", 69, 0.9, "llvm-exception", r"apache-2\.0 with llvm-exception"),
    ("openssl-exception", 68, 0.85, "openssl", r"permission to link (?:the code of )?(?:this|portions of this) program with the openssl library"),
    ("font-exception", 68, 0.85, "embed this font", r"if you create a document which uses this font,? and embed this font"),
    ("mit-or-apache", 72, 0.95, "apache", r"licensed under either of\s+(?:the )?apache license"),
    ("mit-or-apache", 92, 1.0, "spdx-license", r"spdx-license-identifier:\s*\(?(?:mit or apache-2\.0|apache-2\.0 or mit)\)?"),
    ("gpl-or-mit", 92, 1.0, "spdx-license", r"spdx-license-identifier:\s*\(?(?:gpl-2\.0(?:-only|-or-later)? or mit|mit or gpl-2\.0(?:-only|-or-later)?)\)?"),
    ("gpl-or-bsd", 92, 1.0, "spdx-license", r"spdx-license-identifier:\s*\(?gpl-2\.0(?:-only|-or-later)? or bsd-[23]-clause\)?"),
    ("dual-licensed", 46, 0.6, "dual", r"\bdual(?:ly)?[- ]licensed\b"),
    ("multi-licensed", 46, 0.6, "tri-licen", r"\btri-licen[cs]ed?\b"),
    ("mpl-1.1", 62, 0.9, "mozilla public license version", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-2.0", 55, 0.8, "incompatible with secondary", r"incompatible with secondary licenses"),
    ("mpl-2.0", 57, 0.85, "obtain one at", r"if a copy of the mpl was not distributed with this file,? you can obtain one at"),
    ("epl", 62, 0.9, "eclipse public", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl-1.0", 62, 0.9, "common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("apache-2.0", 62, 0.9, "contributor license agreements", r"licensed to the [\w ]{3,60} under one or more contributor license agreements"),
    ("apache-2.0", 54, 0.8, "as is", r"distributed on an \"?as is\"? basis,? without warranties or conditions of any kind"),
    ("apache-2.0", 58, 0.85, "january 2004", r"apache license,? version 2\.0,? january 2004"),
    ("apache-2.0", 50, 0.7, "grant of patent license", r"grant of patent license\. subject to the terms and conditions"),
    ("apache-1.1", 58, 0.85, "acknowledgment", r"this product includes software developed by the apache software foundation"),
    ("bsd", 50, 0.7, "copyright holders and contributors", r"this software is provided by the copyright holders and contributors \"?as is\"?"),
    ("bsd-2-clause", 51, 0.7, "binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 59, 0.85, "endorse or promote", r"the names? of (?:the|its) (?:copyright holders?|contributors?) may not be used to endorse or promote"),
    ("bsd-4-clause", 59, 0.85, "this product includes software", r"this product includes software developed by the (?:university of california|regents of the university)"),
    ("bsd-3-clause-clear", 60, 0.85, "patent rights are granted", r"no express or implied licenses to any party's patent rights are granted"),
    ("bsd-source-code", 50, 0.7, "use of this source code", r"use of this source code is governed by a bsd-style license"),
    ("mit", 57, 0.85, "use of this source code", r"use of this source code is governed by an? mit-style license"),
    ("mit", 54, 0.75, "without limitation the rights", r"without limitation the rights to use,? copy,? modify,? merge,? publish,? distribute"),
    ("mit", 50, 0.7, "in an action of contract", r"whether in an action of contract,? tort or otherwise,? arising from"),
    ("mit-0", 61, 0.85, "without restriction", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files[^.]{0,80}without restriction"),
    ("isc", 56, 0.8, "the author disclaims all", r"the software is provided \"?as is\"? and the author disclaims all warranties"),
    ("hpnd", 56, 0.8, "documentation for any purpose", r"permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose"),
    ("x11", 57, 0.8, "x consortium", r"except as contained in this notice,? the name of the x consortium shall not be used"),
    ("zlib", 54, 0.75, "altered source versions", r"altered source versions must be plainly marked as such"),
    ("zlib", 53, 0.75, "may not be removed or altered", r"this notice may not be removed or altered from any source distribution"),
    ("bsl-1.0", 55, 0.8, "boost.org", r"boost\.org/license_1_0\.txt"),
    ("unlicense", 65, 0.9, "unlicense.org", r"unlicense\.org"),
    ("ofl-1.1", 65, 0.9, "scripts.sil.org", r"scripts\.sil\.org/ofl"),
    ("epl", 65, 0.85, "eclipse.org", r"eclipse\.org/legal/epl-v[12]0"),
    ("isc", 65, 0.9, "opensource.org", r"opensource\.org/licenses/isc\b"),
    ("bsd-2-clause", 65, 0.9, "opensource.org", r"opensource\.org/licenses/bsd-2-clause"),
    ("apache-2.0", 65, 0.9, "opensource.org", r"opensource\.org/licenses/apache-2\.0"),
    ("cddl-1.0", 65, 0.9, "opensource.org", r"opensource\.org/licenses/cddl-?1"),
    ("artistic-2.0", 58, 0.8, "artistic license", r"everyone is permitted to copy and distribute verbatim copies of this license document,? but changing it is not allowed"),
    ("perl", 58, 0.85, "same terms as perl", r"(?:under )?the same terms as perl(?: 5)?(?: itself)?"),
    ("ruby", 58, 0.85, "same terms as ruby", r"(?:under )?the same terms as ruby(?: itself)?"),
    ("postgresql", 57, 0.8, "written agreement is hereby", r"without fee,? and without a written agreement is hereby granted"),
    ("openldap", 58, 0.85, "openldap", r"openldap public license(?:,? version 2\.8)?"),
    ("json", 60, 0.9, "for good, not evil", r"the software shall be used for good,? not evil"),
    ("beerware", 58, 0.85, "buy me a beer", r"you can buy me a beer in return"),
    ("commons-clause", 60, 0.9, "commons clause", r"commons clause\W{1,3}license condition"),
    ("elastic-2.0", 60, 0.9, "elastic license", r"elastic license(?: v?2(?:\.0)?)?"),
    ("polyform", 60, 0.9, "polyform", r"polyform (?:noncommercial|small business|perimeter|shield|strict) license"),
    ("cc-by-4.0", 62, 0.9, "attribution 4.0", r"creative commons attribution 4\.0 international"),
    ("cc-by-sa-4.0", 63, 0.9, "sharealike 4.0", r"creative commons attribution-sharealike 4\.0 international"),
    ("cc-by-nc-4.0", 63, 0.9, "noncommercial 4.0", r"creative commons attribution-noncommercial 4\.0 international"),
    ("cc0-1.0", 61, 0.85, "waived all copyright", r"(?:has )?waived all copyright and related or neighboring rights"),
    ("public-domain", 46, 0.7, "no copyright", r"(?:no copyright is claimed|this work has no copyright)"),
    ("us-government", 46, 0.7, "government work", r"(?:is a )?(?:work of the )?u\.?s\.? government works?"),
    ("proprietary", 52, 0.8, "trade secret", r"(?:contains|constitutes?) (?:confidential information and )?trade secrets? of"),
    ("proprietary", 52, 0.8, "unauthorized copying", r"unauthorized copying of this file,? via any medium,? is strictly prohibited"),
    ("proprietary", 51, 0.75, "internal use only", r"for internal use only"),
    ("evaluation", 46, 0.7, "evaluation", r"for evaluation purposes only"),
    ("eula", 46, 0.7, "end user license", r"end[- ]user license agreement"),
    ("no-warranty", 10, 0.3, "warranty", r"without (?:any )?warranty of any kind"),
    ("no-liability", 10, 0.3, "be liable", r"in no event shall (?:the )?(?:authors?|copyright holders?|copyright owners?)[\w ]{0,40} be liable"),
    ("copyright", 18, 0.45, "copr.", r"\bcopr\.\s*(?:19|20)\d\d"),
    ("copyright", 19, 0.5, "filecopyrighttext", r"spdx-filecopyrighttext:\s*(?:19|20)\d\d"),
    ("license-file", 15, 0.4, "license", r"see (?:the )?(?:accompanying )?(?:license|copying|notice)(?:\.txt|\.md)? (?:file )?for (?:details|terms|more information)"),
    ("license-file", 15, 0.4, "license", r"license that can be found in the license file"),
]

_GRANT = r"(?:licensed|released|distributed|available|published|provided|shared|issued)\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?(?:gnu\s+)?"
_TAG = r"spdx-license-identifier:\s*"

#: Plain substrings of the lower-cased text; every text that a rule or a base phrase matches holds one.
GATE = ["licen", "spdx", "copyleft", "copyright", "©", "public domain", "free software", "all rights", "proprietary", "commercial", "gpl", "cc-by", "cc by", "cc0", "cecill", "rail", "wtf", "permission", "redistribution", "advertising materials", "free of charge", "hope that it will", "'as-is'", "misrepresented", "machine-executable", "do what the", "font software", "without the prior", "apache", "bsd", "creative commons", ".org/", "endorse", "released under", "mit no attribution", "mit-0", "mit 0", "special exception", "temple place", "franklin st", "runtime library exception", "kernel services", "embed this font", "remotely through", "terms as perl", "terms as ruby", "good, not evil", "me a beer", "trade secret", "unauthorized copying", "internal use only", "evaluation purposes", "warrant", "be liable", "government work", "this product includes", "provided by the copyright", "source versions", "source distribution", "without limitation", "action of contract", "the author disclaims", "without fee", "contained in this notice", "of the mpl", "copr."]


def rules() -> list[tuple[str, int, float, str, str]]:
    """All rules in order: tag and grant forms and the bare form of every name, then the clauses."""
    out: list[tuple[str, int, float, str, str]] = []
    for label, word, name in NAMES:
        out.append((label, 90, 1.0, "spdx-license", _TAG + label.replace(".", r"\.") + r"(?:-only|-or-later)?(?![\w.-])"))
    for label, word, name in NAMES:
        specific = 1 if label[-1].isdigit() or "-" in label else 0
        out.append((label, 70 + specific, 0.95, word, _GRANT + name))
        out.append((label, 40 + specific, 0.75, word, name))
    return list(dict.fromkeys(out)) + CLAUSES
