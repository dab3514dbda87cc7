"""License scans by ordered signature rules, with DataFrame functions only.

A text is first reduced to its words with single spaces between them; rules are regular
expressions over that form. Every rule names a keyword that each of its matches contains: only
texts with a keyword meet the rules, and each text only the rules whose keyword it contains.
Overlapping detections are resolved by priority and containment: a span inside another span of
higher priority, or of the same priority and greater length, is suppressed.

There is no shuffle: everything is a projection of a row.

Defined cases: null text: empty, no words and no labels; equal spans of one priority: the rule
that stands first wins; equal rows each keep their row; an empty table gives no rows; other
columns pass through :func:`scan_licenses` only if asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.llm.running import running

# Base phrases and labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Labels, a keyword in every form of the name, and the forms of the name as words.
NAMES = [
    ("agpl-3", "affero", "gnu affero general public license(?: version| v)? ?3"),
    ("agpl-3", "agpl", "agpl ?v?3"),
    ("gpl-3", "general public", "(?:gnu )?general public license(?: version| v)? ?3"),
    ("gpl-3", "gpl", "gpl ?v?3"),
    ("gpl-2", "general public", "(?:gnu )?general public license(?: version| v)? ?2"),
    ("gpl-2", "gpl", "gpl ?v?2"),
    ("gpl", "general public", "(?:gnu )?general public license"),
    ("lgpl-3", "lesser", "(?:gnu )?lesser general public license(?: version| v)? ?3"),
    ("lgpl-3", "lgpl", "lgpl ?v?3"),
    ("lgpl-2.1", "lesser", "(?:gnu )?lesser general public license(?: version| v)? ?2 ?1"),
    ("lgpl-2.1", "lgpl", "lgpl ?v?2 ?1"),
    ("apache-2", "apache", "apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version| v)? ?1 1"),
    ("mit", " mit ", "(?:mit|mit x11)"),
    ("mit", " expat ", "expat"),
    ("isc", " isc ", "isc"),
    ("bsd-2", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd)"),
    ("bsd-4", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("mpl-2", "mozilla", "mozilla public license(?: version| v)? ?2(?: 0)?"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)? ?1 1"),
    ("epl-2", "eclipse", "eclipse public license(?: version| v)? ?2(?: 0)?"),
    ("epl-1", "eclipse", "eclipse public license(?: version| v)? ?1(?: 0)?"),
    ("eupl-1.2", "european union", "european union public licen[cs]e(?: version| v)? ?1 2"),
    ("cddl-1", "cddl", "cddl(?: version| v)? ?1(?: 0)?"),
    ("cpl-1", "common public", "common public license(?: version| v)? ?1(?: 0)?"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc by", "cc by nc nd(?: \\d 0)?"),
    ("cc-by-nc-sa", "cc by", "cc by nc sa(?: \\d 0)?"),
    ("cc-by-nc", "cc by", "cc by nc(?: \\d 0)?"),
    ("cc-by-nd", "cc by", "cc by nd(?: \\d 0)?"),
    ("cc-by-sa", "cc by", "cc by sa(?: \\d 0)?"),
    ("cc-by", "cc by", "cc by(?: \\d 0)?"),
    ("cc-by", "creative commons", "creative commons attribution(?: \\d 0)?"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike(?: \\d 0)?"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial(?: \\d 0)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("boost-1", "boost", "boost software(?: license)?(?: version| v)? ?1(?: 0)?"),
    ("artistic-2", "artistic", "artistic(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("python-2", "python software", "python software foundation(?: license)?"),
    ("postgresql", "postgresql", "postgresql"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("ofl-1.1", "open font", "(?:sil )?open font license(?: version| v)? ?1 1"),
    ("ms-pl", "microsoft public", "microsoft public license"),
    ("osl-3", "open software", "open software license(?: version| v)? ?3(?: 0)?"),
    ("odbl", "open database", "open database license"),
    ("proprietary", "all rights", "all rights reserved"),
]

# How notices speak of a license, most certain first; {} is the name.
FORMS = [
    (6, 1.0, "spdx license identifier {}"),
    (5, 0.95, "(?:is |are )?(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?"),
    (4, 0.85, "subject to (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?"),
    (4, 0.85, "under (?:the )?(?:terms of )?(?:the )?{} licen[cs]e"),
    (3, 0.7, "{} licen[cs]ed?"),
    (2, 0.6, "licen[cs]e {}"),
]


# Signatures written by hand: labels, keywords and patterns over words, as above. SPDX short
# ids have the priority and certainty of the first form; the others' are on the scale of FORMS.
SPDX_IDS = [
    ("agpl-3", "agpl 3 0", "agpl 3 0(?: only| or later)?"),
    ("gpl-3", "gpl 3 0", "gpl 3 0(?: only| or later)?"),
    ("gpl-2", "gpl 2 0", "gpl 2 0(?: only| or later)?"),
    ("gpl", "gpl 1 0", "gpl 1 0(?: only| or later)?"),
    ("lgpl-3", "lgpl 3 0", "lgpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl 2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-2", "lgpl 2 0", "lgpl 2 0(?: only| or later)?"),
    ("apache-2", "apache 2 0", "apache 2 0"),
    ("apache-1.1", "apache 1 1", "apache 1 1"),
    ("apache-1", "apache 1 0", "apache 1 0"),
    ("mit", " mit ", "mit"),
    ("mit-0", "mit 0", "mit 0"),
    ("isc", " isc ", "isc"),
    ("0bsd", "0bsd", "0bsd"),
    ("bsd-1", "bsd 1 clause", "bsd 1 clause"),
    ("bsd-2", "bsd 2 clause", "bsd 2 clause(?: patent| views)?"),
    ("bsd-3", "bsd 3 clause", "bsd 3 clause(?: clear| lbnl| attribution)?"),
    ("bsd-4", "bsd 4 clause", "bsd 4 clause(?: uc)?"),
    ("mpl-2", "mpl 2 0", "mpl 2 0(?: no copyleft exception)?"),
    ("mpl-1.1", "mpl 1 1", "mpl 1 1"),
    ("mpl-1", "mpl 1 0", "mpl 1 0"),
    ("epl-2", "epl 2 0", "epl 2 0"),
    ("epl-1", "epl 1 0", "epl 1 0"),
    ("eupl-1.2", "eupl 1 2", "eupl 1 2"),
    ("eupl-1.1", "eupl 1 1", "eupl 1 1"),
    ("cddl-1", "cddl 1 0", "cddl 1 0"),
    ("cddl-1.1", "cddl 1 1", "cddl 1 1"),
    ("cpl-1", "cpl 1 0", "cpl 1 0"),
    ("cc0", "cc0 1 0", "cc0 1 0"),
    ("cc-by", "cc by", "cc by \\d \\d"),
    ("cc-by-sa", "cc by sa", "cc by sa \\d \\d"),
    ("cc-by-nd", "cc by nd", "cc by nd \\d \\d"),
    ("cc-by-nc", "cc by nc", "cc by nc \\d \\d"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa \\d \\d"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd \\d \\d"),
    ("unlicense", "unlicense", "unlicense"),
    ("zlib", "zlib", "zlib(?: acknowledgement)?"),
    ("boost-1", "bsl 1 0", "bsl 1 0"),
    ("busl-1.1", "busl 1 1", "busl 1 1"),
    ("artistic-2", "artistic 2 0", "artistic 2 0"),
    ("artistic-1", "artistic 1 0", "artistic 1 0(?: perl| cl8)?"),
    ("python-2", "python 2 0", "python 2 0(?: 1)?"),
    ("python-2", "psf 2 0", "psf 2 0"),
    ("postgresql", "postgresql", "postgresql"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("ofl-1.1", "ofl 1 1", "ofl 1 1(?: rfn| no rfn)?"),
    ("ms-pl", "ms pl", "ms pl"),
    ("ms-rl", "ms rl", "ms rl"),
    ("osl-3", "osl 3 0", "osl 3 0"),
    ("afl-3", "afl 3 0", "afl 3 0"),
    ("odbl", "odbl 1 0", "odbl 1 0"),
    ("ncsa", "ncsa", "ncsa"),
    ("x11", " x11 ", "x11"),
    ("openssl", "openssl", "openssl"),
    ("sspl-1", "sspl 1 0", "sspl 1 0"),
    ("upl-1", "upl 1 0", "upl 1 0"),
    ("ecl-2", "ecl 2 0", "ecl 2 0"),
    ("vim", " vim ", "vim"),
    ("ruby", " ruby ", "ruby"),
    ("php-3.01", "php 3 01", "php 3 01"),
]
#: An operand of an SPDX expression begins after this sign, which no word holds.
OPERAND = "\x01"
#: What stands before the last operand: any number of operands of up to twelve words, each with its connective.
SPDX_CHAIN = "^(?:(?:(?!(?:and|or) )[^ ]+ ){1,12}+(?:and|or) )*+"

UNVERSIONED = [
    ("bsd", 2, 0.5, " bsd ", "bsd(?: style)? licen[cs]ed?"),
    ("bsd", 2, 0.5, "berkeley software", "berkeley software distribution licen[cs]e"),
    ("bsd", 4, 0.8, " bsd ", "under (?:the )?(?:terms of )?(?:the |a )?bsd(?: style)? licen[cs]e"),
    ("lgpl", 2, 0.5, "lgpl", "lgpl"),
    ("lgpl", 3, 0.6, "lesser general", "(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl", 3, 0.6, "library general", "(?:gnu )?library general public licen[cs]e"),
    ("gpl", 1, 0.5, "gpl", "(?:gnu )?gpl"),
    ("agpl", 2, 0.5, "agpl", "agpl"),
    ("agpl", 3, 0.6, "affero general", "(?:gnu )?affero general public licen[cs]e"),
    ("apache", 1, 0.5, "apache", "apache(?: software)? licen[cs]ed?"),
    ("mpl", 1, 0.5, "mozilla public", "mozilla public licen[cs]e"),
    ("epl", 1, 0.5, "eclipse public", "eclipse public licen[cs]e"),
    ("eupl", 1, 0.5, "european union public", "european union public licen[cs]e"),
    ("cddl", 1, 0.5, "common development and", "common development and distribution licen[cs]e"),
    ("cpl", 1, 0.5, "common public", "common public licen[cs]e"),
    ("boost", 1, 0.5, "boost software", "boost software licen[cs]e"),
    ("artistic", 1, 0.5, "artistic", "(?:the |perl )?artistic licen[cs]e"),
    ("ofl", 1, 0.5, "open font", "(?:sil )?open font licen[cs]e"),
    ("osl", 1, 0.5, "open software", "open software licen[cs]e"),
    ("mit", 2, 0.6, " expat ", "expat licen[cs]e"),
    ("cc0", 2, 0.6, "no rights reserved", "no rights reserved"),
    ("public-domain", 2, 0.6, "public domain", "(?:released|dedicated|placed|is|are) (?:in|into|to|in to) the public domain"),
]

VERSIONED = [
    ("apache-2", 3, 0.7, "apache", "apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("apache-1.1", 3, 0.7, "apache", "apache(?: software)? licen[cs]e(?: version| v)? ?1 1"),
    ("gpl-3", 3, 0.7, "gpl", "(?:gnu )?gpl(?: version| v)? ?3(?: 0)?"),
    ("gpl-2", 3, 0.7, "gpl", "(?:gnu )?gpl(?: version| v)? ?2(?: 0)?"),
    ("lgpl-3", 3, 0.7, "lgpl", "(?:gnu )?lgpl(?: version| v)? ?3(?: 0)?"),
    ("lgpl-2.1", 3, 0.7, "lgpl", "(?:gnu )?lgpl(?: version| v)? ?2 1"),
    ("agpl-3", 3, 0.7, "agpl", "(?:gnu )?agpl(?: version| v)? ?3(?: 0)?"),
    ("eupl-1.2", 3, 0.7, "european union public", "european union public licen[cs]e(?: version| v)? ?1 2"),
    ("cddl-1", 3, 0.7, "common development and", "common development and distribution licen[cs]e(?: cddl)?(?: version| v)? ?1(?: 0)?"),
    ("boost-1", 3, 0.7, "boost software", "boost software licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("artistic-2", 3, 0.7, "artistic", "artistic licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("ofl-1.1", 3, 0.7, "open font", "(?:sil )?open font licen[cs]e(?: version| v)? ?1 1"),
    ("osl-3", 3, 0.7, "open software", "open software licen[cs]e(?: version| v)? ?3(?: 0)?"),
]

BODIES = [
    ("mit", 5, 0.95, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 3, 0.8, "permission is hereby granted", "permission is hereby granted(?: free of charge)?"),
    ("mit", 4, 0.85, "the above copyright notice and this permission notice", "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("boost-1", 6, 0.95, "obtaining a copy of the software and accompanying", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("ofl-1.1", 6, 0.95, "obtaining a copy of the font", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("isc", 5, 0.95, "permission to use copy modify and", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?: provided that)?"),
    ("postgresql", 6, 0.95, "without a written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", 3, 0.8, "redistribution and use in source and binary", "redistribution and use in source and binary forms(?: of \\S+)? with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd", 2, 0.7, "redistribution and use in source and binary", "redistribution and use in source and binary forms"),
    ("bsd-2", 3, 0.75, "redistributions in binary form must", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3", 5, 0.9, "endorse or promote products", "(?:neither the names? of (?:\\S+ ){1,24}nor the names of (?:its|their|the|any) (?:\\S+ ){0,4}contributors may be used|the names? of (?:\\S+ ){1,24}may not be used) to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4", 5, 0.9, "all advertising materials mentioning features", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2", 5, 0.95, "you may not use this file except in compliance", "you may not use this file except in compliance with the license(?: you may obtain a copy of the license at (?:https? )?www apache org licenses license 2 0)?"),
    ("apache-2", 5, 0.95, "apache org licenses license 2 0", "www apache org licenses license 2 0"),
    ("apache-2", 4, 0.9, "terms and conditions for use reproduction", "terms and conditions for use reproduction and distribution"),
    ("apache-1.1", 5, 0.9, "developed by the apache software foundation", "this product includes software developed by the apache software foundation"),
    ("gpl", 4, 0.85, "you can redistribute it and or modify", "(?:is free software )?you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3", 5, 0.95, "copyleft license for software and other kinds", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2", 5, 0.95, "the licenses for most software are designed", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2", 5, 0.9, "either version 2 of the license", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", 5, 0.9, "either version 3 of the license", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl", 5, 0.85, "terms of the gnu lesser general", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl-2.1", 6, 0.9, "either version 2 1 of the license", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3", 6, 0.9, "either version 3 of the license", "gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2", 6, 0.9, "either version 2 of the license", "gnu (?:lesser|library) general public license as published by the free software foundation either version 2 of the license"),
    ("agpl-3", 6, 0.9, "either version 3 of the license", "gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3", 6, 0.95, "ensure cooperation with the community", "specifically designed to ensure cooperation with the community in the case of network server software"),
    ("mpl-2", 6, 0.95, "subject to the terms of the mozilla public", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", 6, 0.9, "contents of this file are subject to the mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2", 6, 0.9, "eclipse public license", "made available under the terms of the eclipse public license(?: v)? 2 0"),
    ("epl-1", 6, 0.9, "eclipse public license", "made available under the terms of the eclipse public license v1 0"),
    ("cddl-1", 5, 0.9, "common development and distribution", "subject to the terms of the common development and distribution license"),
    ("unlicense", 6, 0.95, "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("zlib", 5, 0.95, "the origin of this software must not", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("wtfpl", 5, 0.95, "do what the fuck you want to", "do what the fuck you want to public license"),
    ("cc0", 5, 0.9, "waived all copyright and related", "waived all copyright and related or neighboring rights"),
    ("artistic-2", 5, 0.9, "the terms under which a given", "the terms under which a given free software package may be copied modified and or redistributed"),
    ("ms-pl", 5, 0.9, "this license governs use of the accompanying", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("python-2", 5, 0.9, "between the python software foundation", "this license agreement is between the python software foundation"),
]

# Sentences of further licenses' texts, exceptions and notices.
TEXTS = [
    ("mit-0", 6, 0.9, "deal in the software without restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("mit", 4, 0.85, "deal in the software without restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("x11", 6, 0.9, "except as contained in this notice", "except as contained in this notice the names? of (?:\\S+ ){1,24}shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("hpnd", 5, 0.85, "copy modify and distribute this software and its documentation", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee|with or without fee|without fee) is hereby granted"),
    ("hpnd", 4, 0.8, "used in advertising or publicity pertaining", "not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("ntp", 6, 0.85, "makes no representations about the suitability this software", "makes no representations about the suitability this software for any purpose"),
    ("0bsd", 6, 0.9, "permission to use copy modify and or distribute", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("isc", 4, 0.8, "disclaims all warranties with regard", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("bsd", 3, 0.75, "this software is provided by", "this software is provided by (?:the )?(?:\\S+ ){1,24}as is and any express or implied warranties including but not limited to"),
    ("bsd", 3, 0.75, "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-1", 2, 0.6, "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice"),
    ("bsd-2-patent", 6, 0.9, "royalty free irrevocable", "subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("bsd-3-clear", 6, 0.9, "no express or implied licenses to any party", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-views", 5, 0.8, "views and conclusions contained in the software", "the views and conclusions contained in the software and documentation are those of the authors"),
    ("ncsa", 6, 0.9, "to deal with the software without restriction", "to deal with the software without restriction"),
    ("zlib", 4, 0.85, "altered source versions must be", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", 6, 0.9, "png reference library", "(?:the )?png reference library(?: version \\d)? is supplied as is"),
    ("libtiff", 6, 0.9, "copy modify distribute and sell this software", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("curl", 6, 0.85, "this permission notice appear in all copies", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("ijg", 6, 0.9, "independent jpeg group", "this software is based in part on the work of the independent jpeg group"),
    ("ftl", 6, 0.9, "freetype", "(?:portions of this software are copyright (?:\\S+ ){0,12}the freetype project|the freetype project license)"),
    ("bzip2", 6, 0.85, "product documentation would be appreciated", "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 3 altered"),
    ("info-zip", 6, 0.9, "info zip license", "info zip license"),
    ("imagemagick", 6, 0.9, "imagemagick license", "imagemagick license"),
    ("openssl", 6, 0.9, "openssl project for use in the openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 6, 0.9, "cryptographic software written by eric young", "this product includes cryptographic software written by eric young"),
    ("json", 6, 0.95, "software shall be used for good", "the software shall be used for good not evil"),
    ("beerware", 6, 0.95, "buy me a beer", "(?:if we meet some day and you think this stuff is worth it )?you can buy me a beer in return"),
    ("beerware", 4, 0.8, "ware license", "(?:the )?beer ?ware license"),
    ("unlicense", 5, 0.9, "anyone is free to copy modify", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", 5, 0.9, "you just do what the fuck", "you just do what the fuck you want to"),
    ("public-domain", 4, 0.85, "hereby release", "(?:i|we|the authors?) hereby release this (?:code|software|work|file) (?:in|into|to) the public domain"),
    ("public-domain", 4, 0.85, "disclaims copyright to this source", "the author disclaims copyright to this source code"),
    ("public-domain", 3, 0.7, "work of the united states government", "is a work of the united states government"),
    ("gfdl-1.3", 6, 0.95, "gnu free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3"),
    ("gfdl-1.2", 6, 0.95, "gnu free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2"),
    ("gfdl", 4, 0.8, "free documentation license", "(?:gnu )?free documentation license"),
    ("gpl", 5, 0.85, "received a copy of the gnu general public license", "you should have received a copy of the gnu general public license along with this (?:program|software|library|file|package)"),
    ("lgpl", 5, 0.85, "received a copy of the gnu lesser general public license", "you should have received a copy of the gnu lesser general public license along with this (?:program|software|library|file|package)"),
    ("agpl", 5, 0.85, "received a copy of the gnu affero general public license", "you should have received a copy of the gnu affero general public license along with this (?:program|software|library|file|package)"),
    ("gpl", 3, 0.7, "fitness for a particular purpose see the gnu", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", 3, 0.75, "fitness for a particular purpose see the gnu", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    ("gpl-3", 4, 0.85, "propagate or modify a covered work", "you may not propagate or modify a covered work except as expressly provided under this license"),
    ("gpl-3", 4, 0.85, "convey a covered work", "you may convey a covered work in object code form under the terms of sections 4 and 5"),
    ("gpl-2", 4, 0.85, "cause any work that you distribute", "you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program"),
    ("gpl-2-only", 6, 0.9, "version 2 as published by the free software foundation", "gnu general public license version 2 as published by the free software foundation"),
    ("gpl-1", 6, 0.9, "either version 1 or", "gnu general public license as published by the free software foundation either version 1 or (?:at your option )?any later version"),
    ("classpath-exception-2", 6, 0.95, "linking this library statically or dynamically", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("classpath-exception-2", 5, 0.9, "classpath exception", "(?:with|subject to) the classpath exception"),
    ("gcc-exception-3.1", 6, 0.95, "gcc runtime library exception", "gcc runtime library exception(?: version 3 1)?"),
    ("bison-exception-2.2", 6, 0.95, "part or all of the bison parser skeleton", "you may create a larger work that contains part or all of the bison parser skeleton"),
    ("autoconf-exception", 6, 0.95, "configuration script generated by autoconf", "as part of a program that contains a configuration script generated by autoconf"),
    ("font-exception-2", 6, 0.95, "embed this font or unaltered portions", "if you create a document which uses this font and embed this font or unaltered portions of this font into the document"),
    ("linux-syscall-note", 6, 0.95, "user programs that use kernel services", "this copyright does not cover user programs that use kernel services by normal system calls"),
    ("openssl-exception", 6, 0.9, "link the code of portions of this program with the openssl", "permission to link the code of portions of this program with the openssl library"),
    ("llvm-exception", 6, 0.95, "llvm exceptions", "apache license v2 0 with llvm exceptions"),
    ("apache-2", 4, 0.85, "distributed under the license is distributed on an as is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", 4, 0.85, "licensed to the apache software foundation", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", 4, 0.8, "derivative works that you distribute all copyright", "you must retain in the source form of any derivative works that you distribute all copyright patent trademark and attribution notices"),
    ("apache-1", 5, 0.85, "developed by the apache group", "this product includes software developed by the apache group for use in the apache http server project"),
    ("mpl-2", 5, 0.9, "incompatible with secondary licenses", "incompatible with secondary licenses as defined by the mozilla public license v 2 0"),
    ("mpl-2", 5, 0.9, "mozilla org mpl 2 0", "you can obtain one at (?:https? )?(?:www )?mozilla org mpl 2 0"),
    ("mpl-1", 6, 0.9, "contents of this file are subject to the mozilla", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("npl-1.1", 6, 0.9, "netscape public license", "(?:the contents of this file are subject to the )?netscape public license(?: version)? 1 1"),
    ("epl-2", 5, 0.9, "eclipse org legal epl 2 0", "(?:www )?eclipse org legal epl 2 0"),
    ("epl-1", 5, 0.9, "eclipse org legal epl v10", "(?:www )?eclipse org legal epl v10(?: html)?"),
    ("edl-1", 5, 0.9, "eclipse distribution license", "eclipse distribution license(?: v| version)? ?1 0"),
    ("cddl-1", 5, 0.9, "contents of this file are subject to the terms of the common development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("ipl-1", 5, 0.9, "ibm public license", "ibm public license(?: version| v)? ?1 0"),
    ("cpl-1", 5, 0.9, "under the terms of this common public license", "the accompanying program is provided under the terms of this common public license"),
    ("apsl-2", 5, 0.9, "apple public source license", "apple public source license(?: version)? 2 0"),
    ("qpl-1", 5, 0.9, "q public license", "q public license(?: version)? 1 0"),
    ("sleepycat", 6, 0.9, "sleepycat", "(?:the )?sleepycat (?:software|license)"),
    ("php-3.01", 5, 0.9, "php license", "subject to version 3 01 of the php license"),
    ("php-3", 5, 0.9, "php license", "subject to version 3 0 of the php license"),
    ("zpl-2.1", 5, 0.9, "zope public license", "zope public license zpl version 2 1"),
    ("cnri-python", 6, 0.9, "corporation for national research initiatives", "this license agreement is between the corporation for national research initiatives"),
    ("ruby", 5, 0.85, "same terms as ruby", "(?:distributed|licensed|redistribute it|released) under the same terms as ruby"),
    ("perl", 5, 0.85, "same terms as perl", "under the same terms as perl(?: itself)?"),
    ("artistic-1", 5, 0.85, "artistic control over the development", "the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("vim", 6, 0.9, "vim license", "vim license"),
    ("lppl-1.3c", 5, 0.9, "latex project public license", "under the conditions of the latex project public license either version 1 3"),
    ("lppl", 4, 0.8, "latex project public license", "latex project public license"),
    ("cecill-2.1", 5, 0.9, "cecill", "cecill(?: free software license agreement)?(?: version)? 2 1"),
    ("cecill-b", 5, 0.9, "cecill b", "cecill b(?: license)?"),
    ("cecill-c", 5, 0.9, "cecill c", "cecill c(?: license)?"),
    ("eupl-1.2", 5, 0.9, "eupl", "licensed under the eupl(?: version)?(?: v)? ?1 2"),
    ("mulanpsl-2", 5, 0.9, "mulan psl", "mulan psl v2"),
    ("ms-rl", 5, 0.9, "microsoft reciprocal license", "microsoft reciprocal license"),
    ("upl-1", 5, 0.9, "universal permissive license", "universal permissive license(?: upl)?(?: version| v)? ?1 0"),
    ("ecl-2", 5, 0.9, "educational community license", "educational community license(?: version)? 2 0"),
    ("afl-3", 5, 0.9, "academic free license", "academic free license(?: version)? 3 0"),
    ("rpl-1.5", 5, 0.9, "reciprocal public license", "reciprocal public license(?: version)? 1 5"),
    ("nasa-1.3", 5, 0.9, "nasa open source agreement", "nasa open source agreement(?: version)? 1 3"),
    ("w3c", 5, 0.9, "w3c software", "w3c software (?:and document )?(?:notice and )?license"),
    ("unicode", 5, 0.9, "unicode data files", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("bitstream-vera", 5, 0.9, "bitstream vera", "bitstream vera is a trademark of bitstream inc"),
    ("ofl-1.1", 4, 0.85, "reserved font name", "with reserved font names?"),
    ("sspl-1", 5, 0.9, "server side public license", "server side public license(?: version| v)? ?1?"),
    ("busl-1.1", 5, 0.9, "business source license", "business source license(?: version)? ?(?:1 1)?"),
    ("elastic-2", 5, 0.9, "elastic license", "elastic license(?: version| v)? ?2(?: 0)?"),
    ("commons-clause", 5, 0.9, "commons clause", "commons clause(?: license condition)?"),
    ("confluent-1", 5, 0.9, "confluent community license", "confluent community license(?: agreement)?(?: version 1 0)?"),
    ("polyform-nc-1", 5, 0.9, "polyform noncommercial license", "polyform noncommercial license(?: 1 0 0)?"),
    ("polyform-sb-1", 5, 0.9, "polyform small business license", "polyform small business license(?: 1 0 0)?"),
    ("hippocratic", 5, 0.9, "hippocratic license", "hippocratic license"),
    ("openrail", 5, 0.9, "rail", "(?:bigscience |creativeml )?open ?rail(?: m| plus plus m)?(?: license)?"),
    ("community-model", 5, 0.85, "community license agreement", "(?:llama \\d )?community license agreement"),
    ("odbl", 5, 0.9, "open data commons open database", "open data commons open database license"),
    ("odc-by", 5, 0.9, "open data commons attribution", "open data commons attribution license"),
    ("pddl-1", 5, 0.9, "public domain dedication and license", "(?:open data commons )?public domain dedication and license"),
    ("ogl-uk-3", 5, 0.9, "open government licence", "open government licence(?: v| version)? ?3(?: 0)?"),
    ("etalab-2", 5, 0.9, "licence ouverte", "licence ouverte(?: v| version)? ?2 ?0?"),
    ("dl-de-by-2", 5, 0.9, "datenlizenz deutschland", "datenlizenz deutschland namensnennung(?: version)? 2 0"),
    ("cc0", 5, 0.9, "creativecommons org publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", 4, 0.85, "creativecommons org licenses by", "creativecommons org licenses by \\d \\d"),
    ("cc-by-sa", 5, 0.9, "creativecommons org licenses by sa", "creativecommons org licenses by sa \\d \\d"),
    ("cc-by-nd", 5, 0.9, "creativecommons org licenses by nd", "creativecommons org licenses by nd \\d \\d"),
    ("cc-by-nc", 5, 0.9, "creativecommons org licenses by nc", "creativecommons org licenses by nc \\d \\d"),
    ("cc-by-nc-sa", 5, 0.9, "creativecommons org licenses by nc sa", "creativecommons org licenses by nc sa \\d \\d"),
    ("cc-by-nc-nd", 5, 0.9, "creativecommons org licenses by nc nd", "creativecommons org licenses by nc nd \\d \\d"),
    ("cc-by-nc-nd", 5, 0.9, "creative commons attribution noncommercial no", "creative commons attribution noncommercial no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa", 5, 0.9, "creative commons attribution noncommercial share", "creative commons attribution noncommercial share ?alike"),
    ("proprietary", 4, 0.85, "unauthorized copying of this", "unauthorized copying of this (?:file|software|program|document)(?: via any medium)? is strictly prohibited"),
    ("proprietary", 4, 0.85, "proprietary and confidential", "(?:this software is )?proprietary and confidential"),
    ("proprietary", 3, 0.75, "without the prior written permission", "no part of this (?:publication|book|work|document|software) may be reproduced (?:\\S+ ){0,30}without the prior written permission"),
    ("proprietary", 3, 0.75, "may not be reproduced or", "may not be reproduced or (?:re)?distributed without (?:the )?(?:express |prior )?written (?:permission|consent)"),
    ("proprietary", 3, 0.7, "licensed not sold", "(?:the|this) software is licensed not sold"),
]


def by_hand() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, certainty, keyword, pattern) of the signatures written by hand."""
    out = [(label, 6, 1.0, keyword, f"(?<={OPERAND}){x}(?= )") for label, keyword, x in SPDX_IDS]
    return out + [(label, p, c, keyword, f"(?<= )(?:{x})(?= )") for label, p, c, keyword, x in UNVERSIONED + VERSIONED + BODIES + TEXTS]


def rules() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, certainty, keyword, pattern): every name in every form, then the signatures
    written by hand. Patterns begin after a space and end before one; a name that says "license"
    itself needs no more."""
    out = []
    for label, keyword, name in NAMES:
        for priority, certainty, form in FORMS:
            if "public license" in name and "licen" in form and priority in (3,):
                form = "{}"
            out.append((label, priority, certainty, keyword, f"(?<= ){form.format('(?:' + name + ')')}(?= )"))
    return out + by_hand()


#: Pieces of many keywords: a text without one is not asked for the keywords that hold it.
GATES = ["license", "permission", "copyright", "software", "warrant"]


def gate(keyword: str, pattern: str) -> str:
    """What a text must hold for a rule's keyword to be looked for."""
    return SPDX_HEAD if OPERAND in pattern else next((g for g in GATES if g in keyword), keyword)


#: All that is no word: ASCII but letters and digits.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The head of SPDX lines, which all texts with an SPDX id hold.
SPDX_HEAD = " spdx license identifier "


def plain(text: Column) -> Column:
    """Words in lower case with one space before, between and after."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), SEPARATOR, " ")


def spaces(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def places(words: Column, pattern: Column) -> Column:
    """Array of (first, n) in words for the matches of ``pattern``, left to right."""
    pieces = F.split(words, pattern, -1)
    found = F.regexp_extract_all(words, pattern, F.lit(0))
    # Spaces up to a match, less the one before the text, number its first word.
    parts = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(spaces(p).alias("gap"), (spaces(m) + 1).alias("n")))
    return running(parts, F.lit(0).cast("bigint"), "struct<first:bigint,n:bigint>", lambda at, x: (
        at + x["gap"] + x["n"] - 1, F.struct((at + x["gap"] - 1).alias("first"), x["n"].alias("n"))))


def operands(words: Column) -> Column:
    """``words`` with ``OPERAND`` before every operand of every SPDX expression."""
    pieces = F.split(words, SPDX_HEAD, -1)

    def marked(piece: Column, i: Column) -> Column:
        chain = F.regexp_extract(piece, SPDX_CHAIN, 0)
        rest = F.substr(piece, F.char_length(chain) + 1)
        return F.when(i == 0, piece).otherwise(F.concat(F.lit(OPERAND), F.regexp_replace(chain, "(?<= )(and|or) ", f"$1 {OPERAND}"), rest))
    return F.when(F.contains(words, F.lit(SPDX_HEAD)), F.array_join(F.transform(pieces, marked), SPDX_HEAD)).otherwise(words)


def scan_licenses(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and: n_words; base (array of label, first, n: all places of base phrases, which may
    overlap); found (array of label, priority, certainty, first, n: the rules' spans that nothing
    suppresses); labels; score (the certainty of the surest span, 0 to 1)."""
    rows = documents.select(*keep, plain(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_words"))
    rows = rows.withColumn("_operands", operands(F.col("_words")))
    words = F.col("_words")
    span = "array<struct<label:string,priority:int,certainty:double,rule:int,first:bigint,n:bigint>>"
    held: dict[str, list] = {}
    for i, (a, p, c, k, x) in enumerate(rules()):
        rule = F.struct(F.lit(a).alias("label"), F.lit(p).alias("priority"), F.lit(c).alias("certainty"), F.lit(k).alias("keyword"), F.lit(x).alias("pattern"), F.lit(i).alias("rule"), F.lit(OPERAND in x).alias("spdx"))
        held.setdefault(gate(k, x), []).append(rule)
    # Each gate is looked for once, whatever the number of its rules; a rule's own keyword only in
    # texts that hold its gate (an SPDX line, for the SPDX ids).
    table = F.array(*(F.struct(F.lit(k).alias("keyword"), F.array(*r).alias("rules")) for k, r in held.items()))
    hits = F.flatten(F.transform(
        F.flatten(F.transform(F.filter(table, lambda r: F.contains(words, r["keyword"])), lambda r: F.filter(r["rules"], lambda x: F.contains(words, x["keyword"])))),
        lambda r: F.transform(places(F.when(r["spdx"], F.col("_operands")).otherwise(words), r["pattern"]), lambda s: F.struct(r["label"].alias("label"), r["priority"].alias("priority"), r["certainty"].alias("certainty"), r["rule"].alias("rule"), s["first"].alias("first"), s["n"].alias("n"))),
    ))

    def outranks(a: Column, b: Column) -> Column:
        inside = (a["first"] <= b["first"]) & (a["first"] + a["n"] >= b["first"] + b["n"])
        higher = (a["priority"] > b["priority"]) | ((a["priority"] == b["priority"]) & ((a["n"] > b["n"]) | ((a["n"] == b["n"]) & (a["rule"] < b["rule"]))))
        return inside & higher

    # A span stands after all that hold it: by first word, then length and rank. What outranks it is
    # then among the kept spans that reach its first word, few at any place.
    in_order = F.array_sort(F.transform("_hits", lambda x: F.struct(
        x["first"].alias("first"), (-x["n"]).alias("less"), (-x["priority"]).alias("low"), x["rule"].alias("rule"), x.alias("x"))))

    def step(open_: Column, item: Column) -> tuple[Column, Column]:
        x = item["x"]
        kept = ~F.exists(open_, lambda a: outranks(a, x))
        near = F.filter(open_, lambda a: a["first"] + a["n"] > x["first"])
        return F.when(kept, F.concat(near, F.array(x))).otherwise(open_), F.when(kept, x)

    rows = rows.withColumn("_hits", hits.cast(span))
    swept = running(in_order, F.array().cast(span), span[len("array<"):-1], step)
    rows = rows.withColumn("found", F.when(F.size("_hits") > 1, F.filter(swept, lambda x: x.isNotNull())).otherwise(F.col("_hits")))
    base = F.concat(*(
        F.when(F.contains(words, F.lit(f" {phrase} ")), F.transform(
            # A look-ahead leaves the words to later matches, so places may overlap.
            places(words, F.lit(f" (?={phrase} )")), lambda s: F.struct(F.lit(label).alias("label"), (s["first"] + 1).alias("first"), F.lit(len(phrase.split())).cast("bigint").alias("n"))))
        .otherwise(F.array().cast("array<struct<label:string,first:bigint,n:bigint>>"))
        for phrase, label in BASE
    ))
    rows = rows.withColumn("base", base).withColumn("n_words", spaces(words) - 1)
    rows = rows.withColumn("labels", F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda b: b["label"]), F.transform("found", lambda b: b["label"])))))
    sure = F.coalesce(F.array_max(F.transform("found", lambda b: b["certainty"])), F.lit(0.0))
    rows = rows.withColumn("score", F.greatest(sure, F.when(F.size("base") > 0, F.lit(0.6)).otherwise(F.lit(0.0))))
    return rows.drop("_words", "_operands", "_hits")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents, whole texts."""
    rows = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["first"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
