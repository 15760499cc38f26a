"""Licence scan: ordered signature rules behind a keyword gate.

Rules are regular expressions over a text's words (lower case, one blank between words). A rule runs only
if the text holds the rule's keyword. Every match is a detection: an interval of words with a priority.
Of overlapping detections, one that lies inside another of higher priority (or of equal priority and
greater length) is suppressed; equal intervals of equal priority go to the earlier rule. Detections of
the base phrases are never suppressed.

No shuffle: a scan and a map. Edge cases: null and empty texts have no words and no detections; repeated
rows and null ids are scanned like any others; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import binary_list, per_batch, schema_with, texts_of
from .words import WORD_BYTES, chunks, join_bytes, runs

_SEPARATORS = bytes(0x20 if not WORD_BYTES[i] and not 0x41 <= i <= 0x5A else i for i in range(256))

#: Phrases that count wherever their words stand one behind the other, and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

_V = r"(?: version)?(?: v)?"
_GNU = r"(?:gnu )?"
#: label, keyword, the licence's name as people write it (a pattern over words)
NAMES = [
    ("mit", "mit", r"mit(?: style)?"),
    ("mit", "expat", r"expat(?: style)?"),
    ("mit", "x11", r"x11(?: style)?"),
    ("mit-0", "mit", r"mit (?:no attribution|0)"),
    ("apache-2", "apache", rf"apache(?: software)?(?: license)?{_V} 2(?: 0)?"),
    ("apache-1.1", "apache", rf"apache(?: software)?(?: license)?{_V} 1 1"),
    ("apache-1", "apache", rf"apache(?: software)?(?: license)?{_V} 1 0"),
    ("gpl-3", "general public", rf"{_GNU}general public license{_V} 3(?: 0)?"),
    ("gpl-2", "general public", rf"{_GNU}general public license{_V} 2(?: 0)?"),
    ("gpl-1", "general public", rf"{_GNU}general public license{_V} 1(?: 0)?"),
    ("gpl", "general public", rf"{_GNU}general public license"),
    ("gpl-3", "gpl", rf"{_GNU}gpl(?:v3|{_V} 3)(?: 0)?(?: only| or later)?"),
    ("gpl-2", "gpl", rf"{_GNU}gpl(?:v2|{_V} 2)(?: 0)?(?: only| or later)?"),
    ("gpl", "gpl", rf"{_GNU}gpl"),
    ("lgpl-3", "lesser general", rf"{_GNU}lesser general public license{_V} 3(?: 0)?"),
    ("lgpl-2.1", "lesser general", rf"{_GNU}lesser general public license{_V} 2 1"),
    ("lgpl-2", "library general", rf"{_GNU}library general public license{_V} 2(?: 0)?"),
    ("lgpl", "lesser general", rf"{_GNU}lesser general public license"),
    ("lgpl-3", "lgpl", rf"{_GNU}lgpl(?:v3|{_V} 3)(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", rf"{_GNU}lgpl(?:v2|{_V} 2)(?: 1)(?: only| or later)?"),
    ("lgpl", "lgpl", rf"{_GNU}lgpl"),
    ("agpl-3", "affero", rf"{_GNU}affero general public license{_V} 3(?: 0)?"),
    ("agpl", "affero", rf"{_GNU}affero general public license"),
    ("agpl-3", "agpl", rf"{_GNU}agpl(?:v3|{_V} 3)(?: 0)?(?: only| or later)?"),
    ("gfdl", "documentation", rf"{_GNU}free documentation license(?:{_V} 1 [123])?"),
    ("bsd-0", "bsd", r"(?:bsd zero clause|0bsd|zero clause bsd)"),
    ("bsd-2", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|3 clause bsd|(?:new|modified|revised) bsd)"),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd", "bsd", r"bsd(?: style)?"),
    ("isc", "isc", r"isc"),
    ("mpl-2", "mozilla", rf"mozilla public license{_V} 2(?: 0)?"),
    ("mpl-1.1", "mozilla", rf"mozilla public license{_V} 1 1"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("mpl-2", "mpl", rf"mpl{_V} 2(?: 0)?"),
    ("epl-2", "eclipse", rf"eclipse public license{_V} 2(?: 0)?"),
    ("epl-1", "eclipse", rf"eclipse public license{_V} 1(?: 0)?"),
    ("edl-1", "eclipse", rf"eclipse distribution license{_V} 1(?: 0)?"),
    ("cddl-1", "development and distribution", r"common development and distribution license(?:(?: version)? 1 [01])?"),
    ("cpl-1", "common public", rf"common public license(?:{_V} 1(?: 0)?)?"),
    ("eupl-1.2", "european union", rf"european union public licen[cs]e(?:{_V} 1 2)?"),
    ("artistic-2", "artistic", rf"artistic license{_V} 2(?: 0)?"),
    ("artistic-1", "artistic", rf"artistic license(?:{_V} 1(?: 0)?)?"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("libpng", "libpng", r"libpng"),
    ("bsl-1", "boost", rf"boost software license(?:{_V} 1(?: 0)?)?"),
    ("busl-1.1", "business source", rf"business source license(?:{_V} 1 1)?"),
    ("sspl-1", "server side", rf"server side public license(?:{_V} 1)?"),
    ("elastic-2", "elastic", rf"elastic license(?:{_V} 2(?: 0)?)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("python-2", "python software", rf"python software foundation license(?:{_V} 2)?"),
    ("ruby", "ruby", r"ruby"),
    ("php-3", "php", rf"php license(?:{_V} 3(?: 0[01])?)?"),
    ("postgresql", "postgresql", r"postgresql"),
    ("openssl", "openssl", r"openssl"),
    ("ms-pl", "microsoft public", r"microsoft public license"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal license"),
    ("ofl-1.1", "open font", rf"(?:sil )?open font license(?:{_V} 1 [01])?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("upl-1", "universal permissive", r"universal permissive license(?: v 1 0)?"),
    ("osl-3", "open software license", rf"open software license(?:{_V} 3(?: 0)?)?"),
    ("afl-3", "academic free", rf"academic free license(?:{_V} 3(?: 0)?)?"),
    ("qpl-1", "q public", r"q public license(?: 1 0)?"),
    ("cecill-2.1", "cecill", r"cecill(?: 2 1)?"),
    ("odbl-1", "open database", r"open database license(?: 1 0)?"),
    ("odc-by-1", "open data commons", r"open data commons attribution license(?: 1 0)?"),
    ("pddl-1", "public domain dedication", r"public domain dedication and license"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?"),
    ("llama-community", "community license", r"llama [0-9]+(?: [0-9]+)? community license"),
    ("cc0-1", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
]
#: Creative Commons: label suffix, letters, words; unfolded over the versions by ``rules``.
CREATIVE = [
    ("by", r"by", r"attribution"),
    ("by-sa", r"by sa", r"attribution share ?alike"),
    ("by-nd", r"by nd", r"attribution no ?deriv(?:ative|atives|s)(?: works)?"),
    ("by-nc", r"by nc", r"attribution non ?commercial"),
    ("by-nc-sa", r"by nc sa", r"attribution non ?commercial share ?alike"),
    ("by-nc-nd", r"by nc nd", r"attribution non ?commercial no ?deriv(?:ative|atives|s)(?: works)?"),
]
VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
#: Passages of licence texts: label, keyword, pattern.
PASSAGES = [
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "endorse or promote", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2", "apache org licenses", r"(?:https? )?(?:www )?apache org licenses license 2 0"),
    ("apache-2", "compliance with the license", r"you may not use this file except in compliance with the license"),
    ("gpl", "redistribute it", r"redistribute it and or modify it"),
    ("gpl", "free software foundation", r"published by the free software foundation"),
    ("gpl", "gnu org licenses", r"gnu org licenses gpl"),
    ("mpl-2", "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("bsl-1", "boost", r"boost org license 1 0"),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public license"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|in to|to) the public domain"),
    ("all-rights-reserved", "rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"(?:confidential and proprietary|proprietary and confidential|proprietary license)"),
    ("non-commercial", "commercial", r"for non ?commercial (?:use|purposes) only"),
    ("creative-commons", "creativecommons", r"creativecommons org licenses"),
    ("mit", "this permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "without restriction", r"to deal in the software without restriction including without limitation the rights to use"),
    ("mit", "sublicense and or sell", r"rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "noninfringement", r"software is provided as is without warranty of any kind express or implied .{1,90}? noninfringement"),
    ("mit-0", "permission is hereby", r"permission is hereby granted .{1,260}? and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used .{1,60}? without prior written authorization"),
    ("hpnd", "without fee is hereby granted", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("hpnd", "advertising or publicity", r"not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("isc", "author disclaims", r"software is provided as is and the author disclaims all warranties with regard to this software"),
    ("bsd-0", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", "source code must retain", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd", "and contributors as is", r"this software is provided by the copyright holders? and contributors as is and any express or implied warranties"),
    ("bsd", "this list of conditions", r"retain the above copyright notice unmodified this list of conditions"),
    ("bsd-3", "specific prior written", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4", "product includes software", r"acknowledge?ment this product includes software developed by"),
    ("bsd-2-patent", "patent license", r"subject to the terms and conditions of this license each copyright holder and contributor hereby grants .{1,120}? patent license"),
    ("bsd-clear", "patent", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-protection", "ordinary bsd", r"this license is a modification of the ordinary bsd license"),
    ("apache-2", "required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "language governing permissions", r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "notice file", r"see the notice file distributed with this work for additional information regarding copyright ownership"),
    ("apache-2", "contributor license agreements", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", "grant of copyright license", r"grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("apache-2", "grant of patent license", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("apache-2", "prominent notices", r"you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-2", "submission of contributions", r"submission of contributions unless you explicitly state otherwise any contribution intentionally submitted"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation http www apache org"),
    ("apache-1.1", "nor may apache", r"products derived from this software may not be called apache nor may apache appear in their name"),
    ("apache-1", "apache group", r"this product includes software developed by the apache group for use in the apache http server project"),
    ("gpl", "in the hope that", r"distributed in the hope that it will be useful but without any warranty without even the implied warranty"),
    ("gpl", "received a copy of the gnu", r"you should have received a copy of the gnu general public license"),
    ("gpl", "write to the free software", r"write to the free software foundation inc"),
    ("gpl", "at your option", r"either version [0-9]+ (?:of the license )?or at your option any later version"),
    ("gpl-2", "version 2 of the license", r"foundation either version 2 of the license"),
    ("gpl-2", "version 2", r"under the terms of the gnu general public license version 2 (?:only|as published by the free software foundation)"),
    ("gpl-3", "version 3 of the license", r"foundation either version 3 of the license"),
    ("gpl-3", "copyleft license for software", r"gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3", "anti circumvention", r"protecting users legal rights from anti circumvention law no covered work shall be deemed"),
    ("gpl-3", "corresponding source", r"conveying non source forms you may convey a covered work in object code form .{1,120}? corresponding source"),
    ("gpl-2", "licenses for most software", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2", "interactively when run", r"if the modified program normally reads commands interactively when run .{1,400}? copyright notice and a notice that there is no warranty|reads commands interactively when run you must cause it when started running .{1,80}? to print or display an announcement including an appropriate copyright"),
    ("gpl-classpath", "special exception", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gpl-gcc-exception", "runtime library exception", r"gcc runtime library exception"),
    ("gpl-bison-exception", "bison", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton and distribute that work"),
    ("gpl-autoconf-exception", "configuration script", r"if you distribute this file as part of a program that contains a configuration script generated by autoconf"),
    ("gpl-openssl-exception", "openssl", r"special exception .{1,120}? permission to link .{1,80}? with the openssl"),
    ("lgpl", "received a copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public license"),
    ("lgpl-2", "gnu library", r"you should have received a copy of the gnu library general public license"),
    ("lgpl-2.1", "version 2 1 of the license", r"foundation either version 2 1 of the license"),
    ("lgpl", "the library", r"work that uses the library .{1,60}? falls outside the scope of this license"),
    ("lgpl-3", "incorporates the terms", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("agpl", "received a copy of the gnu affero", r"you should have received a copy of the gnu affero general public license"),
    ("agpl-3", "remotely through a computer", r"must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "front cover texts", r"with no invariant sections no front cover texts and no back cover texts .{1,80}? license"),
    ("mpl-2", "copy of the mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2", "incompatible with secondary", r"this source code form is incompatible with secondary licenses"),
    ("mpl-1.1", "mozilla", r"contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.1", "rights and limitations", r"see the license for the specific language governing rights and limitations under the license"),
    ("mpl-tri", "alternatively the contents", r"alternatively the contents of this file may be used under the terms of either the gnu general public license"),
    ("npl-1.1", "netscape", r"contents of this file are subject to the netscape public license"),
    ("epl-1", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("epl", "this eclipse public license", r"accompanying program is provided under the terms of this eclipse public license"),
    ("epl", "recipient s acceptance", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cddl-1", "development and distribution", r"contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1", "cddl header", r"when distributing covered code include this cddl header notice in each file"),
    ("cpl-1", "common public license", r"accompanying program is provided under the terms of this common public license"),
    ("ipl-1", "ibm public license", r"accompanying program is provided under the terms of this ibm public license"),
    ("eupl", "european", r"this european union public licen[cs]e (?:the eupl )?applies to the work"),
    ("eupl-1.1", "eupl", r"licensed under the eupl version 1 1 or as soon they will be approved"),
    ("artistic-1", "artistic control", r"copyright holder maintains some semblance of artistic control over the development of the package .{0,200}?(?:rights|users of the package)"),
    ("artistic-2", "artistic", r"everyone is permitted to copy and distribute verbatim copies of this license document .{1,120}? artistic"),
    ("perl", "as perl", r"(?:free software you can redistribute it|is licensed|distributed) .{0,60}?(?:under )?the same terms as perl(?: 5)? itself"),
    ("zlib", "held liable", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "commercial applications", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib", "misrepresented", r"origin of this software must not be misrepresented you must not claim that you wrote the original software .{0,300}?source"),
    ("bsl-1", "boost", r"distributed under the boost software license version 1 0 see accompanying file"),
    ("bsl-1", "machine executable object", r"machine executable object code generated by a source language processor"),
    ("busl-1.1", "change date", r"effective on the change date .{1,200}? licensor hereby grants you rights under the terms of the change license"),
    ("busl-1.1", "additional use grant", r"additional use grant .{1,120}? (?:licensed work|change date)"),
    ("sspl-1", "functionality of the program", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "commons clause", r"commons clause license condition|the license does not grant to you the right to sell the software .{0,80}?commons clause"),
    ("polyform-nc", "polyform", r"polyform noncommercial license"),
    ("polyform-sb", "polyform", r"polyform small business license"),
    ("unlicense", "benefit of the public", r"we make this dedication for the benefit of the public at large"),
    ("unlicense", "jurisdictions that recognize", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest .{0,60}?public domain"),
    ("wtfpl", "verbatim or modified", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("cc0-1", "waive", r"to the extent possible under law .{1,120}? waived all copyright and related or neighboring rights"),
    ("cc0-1", "affirmer", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives .{1,120}? rights"),
    ("creative-commons", "creative commons corporation", r"creative commons corporation is not a law firm and does not provide legal services"),
    ("creative-commons", "license ccpl", r"work as defined below is provided under the terms of this creative commons public license ccpl"),
    ("cc-by-4.0", "creative commons", r"creative commons attribution 4 0 international public license"),
    ("cc-by-sa-4.0", "creative commons", r"creative commons attribution sharealike 4 0 international public license"),
    ("cc-by-nc-4.0", "creative commons", r"creative commons attribution noncommercial 4 0 international public license"),
    ("public-domain", "dedicated to the public domain", r"has been dedicated to the public domain by"),
    ("public-domain", "not subject to copyright", r"(?:is|are) in the public domain and (?:is|are) not subject to copyright"),
    ("us-government", "united states code", r"pursuant to title 17 section 105 of the united states code this software is not subject to copyright protection and is in the public domain"),
    ("ogl-uk-3", "open government", r"contains public sector information licensed under the open government licen[cs]e"),
    ("odbl-1", "open database license", r"this .{1,60}? is made available under the open database license"),
    ("odbl-1", "database contents license", r"rights in individual contents of the database are licensed under the database contents license"),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "eric young", r"this product includes cryptographic software written by eric young"),
    ("php-3", "includes php", r"this product includes php (?:software )?freely available from"),
    ("python-2", "python software foundation", r"this license agreement is between the python software foundation psf and the individual or organization"),
    ("python-cwi", "stichting mathematisch", r"stichting mathematisch centrum .{1,120}? permission to use copy modify and distribute this software"),
    ("ruby", "2 clause bsdl", r"you can redistribute it and or modify it under either the terms of the 2 clause bsdl"),
    ("postgresql", "university of california", r"in no event shall the university of california be liable to any party .{1,400}? (?:license|documentation)"),
    ("tcl", "hereby grant permission", r"authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("ms-pl", "accompanying software", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("ofl-1.1", "open font license", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", "reserved font name", r"no modified version of the font software may use the reserved font name s? .{0,120}?permission"),
    ("unicode", "unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("icu", "provided that the above", r"provided that the above copyright notice s and this permission notice appear in all copies of the software"),
    ("curl", "without fee", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ijg", "independent jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("ijg", "or portions thereof", r"permission is hereby granted to use copy modify and distribute this software or portions thereof for any purpose without fee subject to these conditions"),
    ("libpng", "png reference library", r"the png reference library is supplied as is"),
    ("libpng", "or portions hereof", r"permission is hereby granted to use copy modify and distribute this source code or portions hereof for any purpose"),
    ("ftl", "freetype", r"freetype project is distributed in several archive packages|freetype licen[cs]e"),
    ("json", "good not evil", r"(?:licen[cs]e|permission) .{0,900}?software shall be used for good not evil|shall be used for good not evil the software is provided"),
    ("vim", "vim", r"there are no restrictions on distributing unmodified copies of vim except that they must include this license text"),
    ("beerware", "beer", r"as long as you retain this notice you can do whatever you want with this stuff .{0,120}?buy me a beer in return .{0,20}?|beer ?ware license"),
    ("openrail", "use based restrictions", r"use based restrictions .{1,120}? (?:license|model)"),
    ("llama-community", "llama materials", r"by clicking i accept below or by using or distributing any portion or element of the llama materials you agree"),
    ("gemma", "gemma terms", r"gemma is provided under and subject to the gemma terms of use"),
    ("proprietary", "prohibited", r"(?:reproduction|distribution|use) .{0,80}?without (?:the )?(?:express|prior) written (?:consent|permission) .{0,40}?is (?:strictly )?prohibited"),
    ("proprietary", "trade secret", r"contains (?:confidential|proprietary) (?:information )?and trade secrets? .{0,80}?(?:rights|permission|licen[cs]e)"),
    ("eula", "end user", r"end user licen[cs]e agreement"),
    ("eula", "by installing", r"by installing .{1,80}? you agree to be bound by the terms of this (?:licen[cs]e|agreement)(?: agreement)?"),
    ("evaluation", "evaluation", r"for evaluation purposes only .{0,60}?licen[cs]e|evaluation licen[cs]e agreement"),
    ("educational", "purposes only", r"for (?:educational|academic|research) purposes only"),
    ("educational", "use only", r"for (?:educational|academic|research) use only"),
]
_GRANT = r"(?:licen[sc]ed|released|distributed|available|provided|published|covered|redistributed|offered) (?:under|by)(?: the)?(?: terms of)?(?: the)?(?: conditions of the)? "


class Rule(NamedTuple):
    label: str
    keyword: bytes
    pattern: bytes
    priority: int
    confidence: float


class Detection(NamedTuple):
    start: int  # in words
    past: int
    label: str
    priority: int
    confidence: float
    rule: int
    base: bool


@functools.lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: base phrases, tags, grants, texts' passages, then names alone."""
    out = [Rule(label, phrase.split()[0].encode(), phrase.encode(), 100, 1.0) for phrase, label in BASE]
    names = [(label, key, name) for label, key, name in NAMES]
    for suffix, letters, words in CREATIVE:
        for version in VERSIONS:
            names.append((f"cc-{suffix}-{version.replace(' ', '.')}", "cc", rf"cc {letters} {version}"))
            names.append((f"cc-{suffix}-{version.replace(' ', '.')}", "creative commons", rf"creative commons {words}(?: international| unported)? {version}"))
        names.append((f"cc-{suffix}", "cc", rf"cc {letters}"))
        names.append((f"cc-{suffix}", "creative commons", rf"creative commons {words}"))
    for label, key, name in names:
        out.append(Rule(label, b"spdx", rf"spdx license identifier {name}(?: only| or later)?".encode(), 90, 1.0))
    for label, key, name in names:
        out.append(Rule(label, key.encode(), (_GRANT + name + r"(?: licen[sc]e)?").encode(), 80, 0.95))
    for label, key, pattern in PASSAGES:
        out.append(Rule(label, key.encode(), pattern.encode(), 70, 0.9))
    for label, key, name in names:
        ends = "" if "license" in name or label.startswith(("cc", "wtfpl", "unlicense")) else r" licen[sc]e"
        out.append(Rule(label, key.encode(), (name + ends).encode(), 50 + 5 * (label[-1].isdigit()), 0.7))
    return tuple(out)


#: One of these is part of whatever a rule matches: texts without any are done.
_GATE = [b"licen", b"gpl", b"spdx", b"permission", b"redistribution", b"endorse", b"advertising", b"compliance", b"foundation",
         b"source", b"domain", b"public", b"rights", b"proprietary", b"commercial", b"commons", b"wtfpl", b"openrail",
         b"gnu", b"boost", b"unencumbered", b"mozilla", b"released", b"distributed", b"available", b"provided", b"published",
         b"covered", b"offered", b"apache", b"redistribute", b"consortium", b"list of conditions", b"includes software", b"prominent",
         b"contribution", b"later version", b"when run", b"exception", b"configuration script", b"remotely", b"artistic", b"change date",
         b"managed service", b"openssl", b"cryptographic", b"california", b"beer", b"restrictions", b"llama", b"prohibited", b"agreement",
         b"purposes only", b"use only", b"jpeg", b"reference library"]
_CC = re.compile(rb"(?<![0-9a-z\x80-\xff])cc(?:0|[^0-9a-z\x80-\xff]+by)(?![0-9a-z\x80-\xff])")


@functools.lru_cache(maxsize=None)
def _compiled(i: int) -> re.Pattern:
    # the blank in front is part of the match: with it a rule's first letters are looked for directly
    return re.compile(rb" (" + rules()[i].pattern + rb")(?= )")


@functools.lru_cache(maxsize=1)
def _by_keyword() -> dict[bytes, list[int]]:
    table: dict[bytes, list[int]] = {}
    for i, rule in enumerate(rules()):
        table.setdefault(rule.keyword, []).append(i)
    return table


def gated(low: bytes) -> bool:
    return any(k in low for k in _GATE) or (b"cc" in low and _CC.search(low) is not None)


def suppress(found: list[Detection]) -> list[Detection]:
    """Drop what lies inside a stronger detection; of exact ties the earlier rule stays. Taken from the strongest to the
    weakest; the farthest end of what is kept, up to any start, stands in a tree of prefix maxima."""
    place = {s: i for i, s in enumerate(sorted({d.start for d in found}), start=1)}
    farthest = [-1] * (len(place) + 1)
    kept: list[Detection] = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.past, d.rule, d.start)):
        i, reach = place[d.start], -1
        while i:
            reach = max(reach, farthest[i])
            i -= i & -i
        if d.base or reach < d.past:
            kept.append(d)
            i = place[d.start]
            while i < len(farthest):
                farthest[i] = max(farthest[i], d.past)
                i += i & -i
    return sorted(kept)


def scan_text(low: bytes) -> list[Detection]:
    """Detections in a lower-cased text."""
    if not gated(low):
        return []
    text = b" " + b" ".join(low.translate(_SEPARATORS).split()) + b" "
    found, blanks = [], np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 0x20)
    for keyword, numbers in _by_keyword().items():
        if keyword in text:
            for i in numbers:
                rule = rules()[i]
                for m in _compiled(i).finditer(text):
                    start = int(blanks.searchsorted(m.start()))
                    found.append(Detection(start, start + m[1].count(b" ") + 1, rule.label, rule.priority,
                                           rule.confidence, i, i < len(BASE)))
    return suppress(found)


_SPAN = "struct<first:bigint,past:bigint,label:string,priority:int,confidence:double,rule:int,base:boolean>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, and spans: what was detected, in words from 0 (``past`` is behind the last)."""
    rows = texts_of(docs, id_col, text_col)
    span = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64()), ("label", pa.string()), ("priority", pa.int32()),
                               ("confidence", pa.float64()), ("rule", pa.int32()), ("base", pa.bool_())]))

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = binary_list(batch["text"])
        counts, spans = [], []
        for start, end in chunks(texts, 2 << 20):
            data, bounds = join_bytes(texts[start:end])
            first, _ = runs(WORD_BYTES[data])
            counts.append(np.diff(np.searchsorted(first, bounds)))
            low = data.tobytes()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                spans.append([dict(zip(("first", "past", "label", "priority", "confidence", "rule", "base"), d))
                              for d in scan_text(low[a:b])])
        return {"doc_id": batch["doc_id"], "n_words": pa.array(np.concatenate(counts).astype(np.int64)), "spans": pa.array(spans, span)}

    return rows.mapInArrow(per_batch(work, ["doc_id", "n_words", "spans"]),
                           schema_with(rows, f"n_words bigint, spans array<{_SPAN}>"))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns: base places and labels, all labels, and the best confidence."""
    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first"])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["confidence"])), F.lit(0.0)).alias("score"))
