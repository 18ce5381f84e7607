"""Signatures of licence texts and notices: sentences that stand in them word for word."""

from __future__ import annotations

L = "licen[sc]e"
C = "licen[sc]ed"

# Priority, label, confidence, keywords that must all occur, pattern over words in lower case.
PASSAGES = [
    # MIT, X11 and their variants.
    (1, "mit", 0.95, ("permission", "free of charge"), r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?"),
    (1, "mit", 0.9, ("without restriction",), r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"),
    (1, "mit", 0.85, ("substantial portions",), r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (2, "permissive-warranty", 0.6, ("as is", "noninfringement"), r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    (2, "permissive-warranty", 0.6, ("authors or copyright holders",), r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    (1, "mit-0", 0.9, ("permission", "mit no attribution"), rf"mit no attribution(?: {L})?"),
    (1, "x11", 0.9, ("x consortium",), r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    (1, "expat", 0.85, ("expat",), rf"expat {L}"),
    (1, "mit", 0.9, ("file mit",), rf"(?:see|read) the file mit {L}(?: txt)?"),
    (1, "mit", 0.9, ("mit style",), rf"mit style {L}"),
    # ISC, zlib, Boost and other short ones.
    (1, "isc", 0.9, ("permission to use copy modify",), r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (1, "isc", 0.85, ("author disclaims all warranties",), r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    (1, "0bsd", 0.9, ("zero clause",), rf"(?:bsd )?zero clause(?: bsd)?(?: {L})?"),
    (1, "hpnd", 0.85, ("without fee",), r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    (1, "zlib", 0.9, ("origin of this software",), r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    (1, "zlib", 0.9, ("altered source versions",), r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    (1, "zlib", 0.8, ("held liable for any damages arising",), r"in no event will the authors be held liable for any damages arising from the use of this software"),
    (1, "boost-1.0", 0.95, ("boost software",), rf"boost software {L}(?: version 1 0)?"),
    (1, "boost-1.0", 0.9, ("machine executable object code",), r"unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    (1, "postgresql", 0.9, ("without a written agreement",), r"without fee and without a written agreement is hereby granted provided that the above copyright notice"),
    (1, "ncsa", 0.9, ("university of illinois",), rf"university of illinois ncsa open source {L}"),
    (1, "ncsa", 0.85, ("with the software without restriction",), r"to deal with the software without restriction"),
    (1, "curl", 0.85, ("curl",), rf"curl {L}"),
    (1, "libpng", 0.9, ("libpng",), rf"(?:the )?libpng {L}|png reference library {L}"),
    (1, "wtfpl", 0.95, ("do what the fuck",), rf"do what the fuck you want to(?: public {L})?"),
    (1, "beerware", 0.9, ("beer",), r"you can buy me a beer in return"),
    (1, "ijg", 0.85, ("independent jpeg group",), r"this software is based in part on the work of the independent jpeg group"),
    (1, "json", 0.9, ("for good not evil",), r"the software shall be used for good not evil"),
    (1, "vim", 0.85, ("vim",), rf"vim {L}"),
    (1, "ftl", 0.9, ("freetype",), rf"(?:the )?freetype (?:project )?{L}"),
    (1, "icu", 0.85, ("icu",), rf"icu {L}"),
    (1, "unicode", 0.85, ("unicode",), rf"unicode {L}(?: agreement)?|unicode inc {L} agreement"),
    (1, "tcl", 0.8, ("tcl tk",), rf"tcl tk {L}"),
    (1, "zpl", 0.9, ("zope public",), rf"zope public {L}"),
    # BSD.
    (1, "bsd", 0.9, ("redistribution and use",), r"redistribution and use in source and binary forms with or without modification are permitted"),
    (1, "bsd", 0.85, ("redistributions of source code",), r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (1, "bsd", 0.85, ("redistributions in binary form",), r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    (0, "bsd-3-clause", 0.95, ("endorse or promote",), r"neither the name of (?:the |its )?(?:\S+ ){1,12}?nor the names of (?:its |the )?contributors may be used to endorse or promote products"),
    (0, "bsd-4-clause", 0.95, ("advertising materials",), r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (1, "bsd", 0.8, ("bsd style",), rf"bsd style {L}"),
    (0, "bsd-2-clause", 0.95, ("simplified bsd",), rf"simplified bsd {L}"),
    (0, "bsd-3-clause", 0.95, ("new bsd",), rf"(?:new|revised|modified) bsd {L}"),
    (2, "permissive-warranty", 0.6, ("copyright holders and contributors",), r"this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    (2, "permissive-warranty", 0.6, ("regents and contributors",), r"this software is provided by the regents and contributors as is"),
    # Apache.
    (0, "apache-2.0", 0.95, ("apache", "version 2 0"), rf"{C} under the apache {L} version 2 0"),
    (0, "apache-2.0", 0.9, ("except in compliance",), rf"you may not use this file except in compliance with the {L}"),
    (0, "apache-2.0", 0.95, ("apache org",), rf"(?:http|https) www apache org {L}s {L} 2 0"),
    (1, "apache", 0.8, ("as is basis",), rf"software distributed under the {L} is distributed on an as is basis without warranties or conditions of any kind"),
    (0, "apache-2.0", 0.9, ("perpetual worldwide", "contributor"), rf"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright {L}"),
    (0, "apache-2.0", 0.85, ("notice text file",), r"if the work includes a notice text file as part of its distribution"),
    (0, "apache-1.1", 0.9, ("apache software foundation",), r"this product includes software developed by the apache software foundation"),
    (1, "apache", 0.8, ("contributor license agreements",), r"to the apache software foundation asf under one or more contributor license agreements"),
    # GNU.
    (1, "gpl", 0.95, ("free software", "redistribute it"), r"this (?:program|library|file|software|package) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    (1, "gpl", 0.85, ("free software", "redistribute it"), r"this program is free software you can redistribute it and or modify it"),
    (1, "lgpl", 0.95, ("free software", "lesser general public"), r"free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    (1, "lgpl", 0.95, ("library general public",), r"gnu library general public license"),
    (1, "agpl", 0.95, ("affero",), r"free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    (0, "gpl-2.0", 0.95, ("version 2",), r"gnu general public license as published by the free software foundation either version 2 of the license"),
    (0, "gpl-3.0", 0.95, ("version 3",), r"gnu general public license as published by the free software foundation either version 3 of the license"),
    (0, "gpl-2.0", 0.9, ("version 2 only",), r"gnu general public license version 2 only"),
    (1, "gpl", 0.8, ("without any warranty",), r"distributed in the hope that it will be useful but without any warranty without even the implied warranty of"),
    (1, "gpl", 0.85, ("received a copy of the gnu",), r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license along with"),
    (1, "gpl", 0.8, ("51 franklin",), r"free software foundation inc 51 franklin st(?:reet)?"),
    (1, "gpl", 0.8, ("59 temple place",), r"free software foundation inc 59 temple place"),
    (1, "gpl", 0.85, ("freedom to share and change",), r"(?:are|is) designed to take away your freedom to share and change"),
    (1, "gpl", 0.85, ("copyleft",), r"is a free copyleft license for software and other kinds of works"),
    (1, "agpl", 0.9, ("remote network interaction",), r"remote network interaction use with the gnu general public license"),
    (1, "gpl-exception", 0.8, ("special exception",), r"as a special exception (?:the copyright holders|you may|if you link)"),
    (1, "classpath-exception", 0.95, ("classpath",), r"(?:gnu )?classpath exception"),
    (1, "gfdl", 0.95, ("free documentation",), r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    (1, "gfdl", 0.85, ("invariant sections",), r"with no invariant sections(?: with)? no front cover texts(?: and(?: with)? no back cover texts)?"),
    # Weak copyleft and others with a steward.
    (0, "mpl-2.0", 0.95, ("mozilla public",), r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    (0, "mpl-2.0", 0.9, ("mozilla org mpl",), r"(?:http|https) mozilla org mpl 2 0"),
    (0, "mpl-1.1", 0.9, ("mozilla public", "contents of this file"), r"the contents of this file are subject to the mozilla public license version 1 1"),
    (1, "mpl", 0.8, ("covered software",), r"a contributor version that is covered software|all distribution of covered software in source code form"),
    (0, "epl-1.0", 0.95, ("eclipse public", "v1 0"), r"eclipse public license v1 0 which accompanies this distribution"),
    (0, "epl-2.0", 0.95, ("eclipse public", "2 0"), r"terms of the eclipse public license (?:v )?2 0(?: which accompanies this distribution)?"),
    (1, "cddl", 0.95, ("common development and distribution",), r"subject to the terms of the common development and distribution license"),
    (1, "cpl", 0.9, ("common public",), rf"common public {L}(?: version 1 0| v1 0)?"),
    (1, "artistic", 0.9, ("artistic license",), r"(?:under the (?:terms of the )?|the )(?:perl |clarified )?artistic license"),
    (1, "artistic", 0.85, ("same terms as perl",), r"(?:redistribute it and or )?modify it under the same terms as perl(?: itself)?"),
    (1, "ofl", 0.95, ("sil open font",), rf"(?:this font software is {C} under the )?sil open font {L}(?: version 1 1)?"),
    (1, "ofl", 0.85, ("reserved font name",), r"with reserved font name"),
    (1, "eupl", 0.95, ("european union public",), rf"european union public {L}|{C} under the eupl"),
    (1, "cecill", 0.95, ("cecill",), rf"governed by the cecill(?: [bc])? {L}|cecill free software {L}"),
    (1, "ms-pl", 0.95, ("microsoft public",), rf"microsoft public {L}"),
    (1, "ms-rl", 0.95, ("microsoft reciprocal",), rf"microsoft reciprocal {L}"),
    (1, "psf", 0.95, ("python software foundation",), rf"python software foundation {L}|psf {L} agreement"),
    (1, "openssl", 0.9, ("openssl",), r"this product includes software developed by the openssl project"),
    (1, "ssleay", 0.9, ("eric young",), r"this product includes cryptographic software written by eric young"),
    (1, "openldap", 0.9, ("openldap public",), rf"openldap public {L}"),
    (1, "ruby", 0.85, ("ruby",), rf"{C} under (?:the )?(?:same terms as )?ruby|ruby s {L}"),
    (1, "php", 0.9, ("php license",), r"subject to version \d \d+ of the php license|php license version \d \d+"),
    (1, "w3c", 0.9, ("w3c",), rf"w3c software (?:notice and|and document) {L}"),
    (1, "osl", 0.9, ("open software license",), r"open software license(?: version| v)? ?\d \d"),
    (1, "afl", 0.9, ("academic free",), rf"academic free {L}(?: version| v)? ?\d \d"),
    (1, "qpl", 0.9, ("q public",), rf"q public {L}"),
    (1, "sleepycat", 0.9, ("sleepycat",), rf"sleepycat {L}"),
    # Data and content.
    (1, "odbl", 0.95, ("open database",), rf"open database {L}|open data commons open database"),
    (1, "odc-by", 0.9, ("open data commons attribution",), rf"open data commons attribution {L}"),
    (1, "pddl", 0.9, ("public domain dedication",), r"(?:open data commons )?public domain dedication and licen[sc]e"),
    (1, "cc0", 0.95, ("cc0",), r"cc0(?: 1 0)?(?: universal)?"),
    (1, "cc0", 0.95, ("creative commons", "zero"), r"creative commons zero(?: license)?"),
    (1, "cc0", 0.9, ("waived all copyright",), r"has waived all copyright and related or neighboring rights"),
    (1, "cc", 0.8, ("creative commons",), rf"this work is {C} under a creative commons"),
    (1, "cc", 0.75, ("creativecommons org",), rf"(?:http|https) creativecommons org {L}s"),
    (1, "cc", 0.75, ("appropriate credit",), r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    (1, "cc-sa", 0.75, ("same license as the original",), r"you must distribute your contributions under the same license as the original"),
    (1, "cc-nc", 0.75, ("commercial purposes",), r"you may not use the material for commercial purposes"),
    (1, "cc-nd", 0.75, ("modified material",), r"you may not distribute the modified material"),
    (1, "ogl", 0.9, ("open government",), rf"open government {L}(?: v(?:ersion)? ?\d 0)?"),
    (1, "unlicense", 0.95, ("unencumbered",), r"this is free and unencumbered software released into the public domain"),
    (1, "unlicense", 0.85, ("copy modify publish use compile",), r"anyone is free to copy modify publish use compile sell or distribute this software"),
    (1, "public-domain", 0.9, ("public domain",), r"(?:dedicated to|released into|released to|placed in|dedicate (?:any and )?all copyright interest in \S+ \S+ to) the public domain"),
    (1, "public-domain", 0.85, ("public domain",), r"(?:this (?:work|file|software|text|image|document|code) is|is hereby|is now) in the public domain"),
    (2, "public-domain", 0.7, ("public domain mark",), r"public domain mark(?: 1 0)?"),
    # Source that may be read but not freely used.
    (1, "busl", 0.95, ("business source",), rf"business source {L}(?: 1 1)?"),
    (1, "sspl", 0.95, ("server side public",), rf"server side public {L}"),
    (1, "elastic", 0.95, ("elastic license",), r"(?:subject to the|under the|the) elastic license(?: 2 0| v2)?"),
    (1, "polyform", 0.9, ("polyform",), rf"polyform (?:noncommercial|strict|shield|small business|perimeter|free trial|internal use) {L}"),
    (1, "commons-clause", 0.95, ("commons clause",), r"commons clause (?:license )?(?:condition|restriction)"),
    # Reservations and notices of owners.
    (2, "reserved", 0.8, ("rights reserved",), r"(?:all|some|no) rights reserved"),
    (2, "reserved", 0.8, ("droits",), r"tous droits r\S* ?serv\S*"),
    (2, "reserved", 0.8, ("rechte vorbehalten",), r"alle rechte vorbehalten"),
    (2, "reserved", 0.8, ("derechos reservados",), r"todos los derechos reservados"),
    (2, "reserved", 0.8, ("diritti riservati",), r"tutti i diritti (?:sono )?riservati"),
    (2, "reserved", 0.8, ("direitos reservados",), r"todos os direitos reservados"),
    (2, "reserved", 0.8, ("rechten voorbehouden",), r"alle rechten voorbehouden"),
    (2, "reserved", 0.75, ("no part of this",), r"no part of this (?:publication|book|document|work) may be (?:reproduced|copied)"),
    (2, "reserved", 0.75, ("written permission",), r"without (?:the )?(?:express |prior )+written permission (?:of|from) the (?:publisher|copyright (?:owner|holder)|author)"),
    (2, "proprietary", 0.8, ("confidential", "proprietary"), r"(?:confidential and proprietary|proprietary and confidential)(?: information)?"),
    (2, "proprietary", 0.7, ("unauthorized",), r"unauthorized (?:copying|reproduction|distribution|use)(?: or \w+)? (?:of this \w+ )?is (?:strictly )?prohibited"),
    (2, "proprietary", 0.8, ("trade secrets",), r"contains (?:the )?(?:confidential |proprietary |valuable )*(?:information and )?trade secrets of"),
    (2, "proprietary", 0.8, ("end user license",), r"end user license agreement"),
    (2, "proprietary", 0.75, ("limited", "non transferable"), rf"(?:a )?limited non exclusive non transferable {L}"),
    (2, "proprietary", 0.75, ("reverse engineer",), r"(?:may not|shall not|agree not to|must not) (?:\S+ ){0,6}reverse engineer"),
    (2, "proprietary", 0.7, ("licensed not sold",), r"(?:software|product) is licensed not sold"),
    (2, "proprietary", 0.75, ("personal", "non commercial"), r"for (?:your )?personal (?:and )?non ?commercial use only"),
    (3, "copyright", 0.5, ("copyright",), r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*"),
    (4, "licence-mention", 0.3, ("licensed under",), r"licensed under the terms of"),
    (4, "licence-mention", 0.3, ("license file",), r"see (?:the )?(?:accompanying |included )?license file"),
    (4, "licence-mention", 0.3, ("license for the specific language",), r"see the license for the specific language governing permissions"),
]
