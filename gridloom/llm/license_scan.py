"""License detection by ordered signature rules, with DataFrame functions only.

A table of regular expressions over normalised words is gated by substrings: a
document is searched only for rules whose form's words it holds and whose name's
text, derived from the name's pattern, stands in every match.  Rules are ordered
by priority (identifier, grant, license name, bare name).  Of overlapping
detections one that lies within another of the same or a higher priority is
suppressed; of equal intervals the earlier rule stays.

Text is lower-cased for A-Z and cut into words of digits, a-z and everything
outside ASCII; each word is written between two spaces of its own, so that
expressions of whole words need no look-around.

Detections are found and suppressed in time linear in a text's length (up to a
square root of the number of detections): places come from the index of markers
among the words, suppression from one sorted pass with running ends.

Defined cases: a null text is empty and has no words and detections; a very long
text is searched whole; a null id stays null; equal intervals of several rules
keep the first rule's, and equal scores count once; repeated rows are scanned one
by one; an empty table gives an empty result.  Only the id and text columns are
read, so other columns can't clash.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrow import text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels, fixed by the contract.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label, keyword (gates the SQL's rules; the query takes ``held_text``), and the names' word patterns; ``~`` marks an optional word.
FAMILIES = (
    ("mit", "mit", ("mit", "expat", "mit expat")),
    ("apache", "apache", ("apache", "apache software", "apache ~version 2 ~0", "asl 2 0")),
    ("gpl", "general public license", ("~gnu general public",)),
    ("gpl", "gpl", ("~gnu gpl", "gplv[123]", "gpl ~v ~version [123] ~0")),
    ("lgpl", "lesser general", ("~gnu lesser general public", "~gnu library general public")),
    ("lgpl", "lgpl", ("~gnu lgpl", "lgplv[23]", "lgpl ~version [23] ~[01]")),
    ("agpl", "affero", ("~gnu affero general public", "affero gpl")),
    ("agpl", "agpl", ("~gnu agpl", "agplv3", "agpl ~version 3 ~0")),
    ("bsd", "bsd", ("bsd", "[234] clause bsd", "bsd [234] clause", "new bsd", "modified bsd", "simplified bsd")),
    ("isc", "isc", ("isc", "internet systems consortium")),
    ("mpl", "mozilla", ("mozilla public", "mozilla public ~license ~version [12] [01]")),
    ("mpl", "mpl", ("mpl ~version [12] [01]",)),
    ("epl", "eclipse", ("eclipse public", "eclipse distribution")),
    ("cddl", "cddl", ("cddl", "cddl ~version 1 [01]")),
    ("cc-by", "cc by", ("cc by", "cc by [1234] [05]")),
    ("cc-by-sa", "cc by sa", ("cc by sa", "cc by sa [1234] [05]")),
    ("cc-by-nc", "cc by nc", ("cc by nc", "cc by nc [1234] [05]", "cc by nc sa", "cc by nc nd")),
    ("cc-by-nd", "cc by nd", ("cc by nd", "cc by nd [1234] [05]")),
    ("cc0", "cc0", ("cc0", "cc0 1 0")),
    ("cc", "creative commons", ("creative commons ~attribution", "creative commons attribution ~share ~alike", "creative commons zero")),
    ("unlicense", "unlicense", ("unlicense", "the unlicense")),
    ("zlib", "zlib", ("zlib", "zlib libpng")),
    ("boost", "boost", ("boost software", "bsl 1 0")),
    ("artistic", "artistic", ("artistic", "artistic 2 0", "clarified artistic")),
    ("wtfpl", "wtfpl", ("wtfpl",)),
    ("python", "python", ("python software foundation", "psf")),
    ("postgresql", "postgresql", ("postgresql",)),
    ("openssl", "openssl", ("openssl",)),
    ("eupl", "european union public", ("european union public",)),
    ("ofl", "open font", ("sil open font", "open font")),
    ("odbl", "open database", ("open database", "open data commons open database")),
    ("public-domain", "public domain", ("public domain",)),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
)
#: Priority, confidence, words that a text must hold, and words around a family's name (N).
FORMS = (
    (1, 1.0, "spdx license identifier", "spdx license identifier N"),
    # Further members of an SPDX expression; of a lower priority, so that a longer match leaves the members before it.
    (2, 1.0, "spdx license identifier", "spdx license identifier ~* ~* ~* ~* ~* ~* ~* ~* or N"),
    (2, 1.0, "spdx license identifier", "spdx license identifier ~* ~* ~* ~* ~* ~* ~* ~* and N"),
    (2, 0.95, "licensed under", "licensed under ~the ~terms ~of ~the N ~license"),
    *((2, 0.95, f"{verb} under", f"{verb} under ~the ~terms ~of ~the N ~license") for verb in ("released", "distributed", "available", "published", "provided", "redistributed")),
    (2, 0.9, "subject to", "subject to ~the ~terms ~of ~the N ~license"),
    (3, 0.8, "license", "N license ~version ~[1234] ~[05]"),
    (3, 0.8, "licence", "N licence"),
)
#: Names distinctive enough to count alone.
BARE = frozenset("gpl lgpl agpl cc-by cc-by-sa cc-by-nc cc-by-nd cc0 unlicense wtfpl public-domain proprietary mpl cddl".split())

#: Signatures written by hand: priority, confidence, label, identifier (SPDX's where there is one), and words; ``~*`` is any word or none.
WRITTEN = (
    # Grants and conditions in the licenses' own texts.
    (2, 1.0, "mit", "MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (2, 1.0, "mit", "MIT", "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    (2, 0.95, "mit", "MIT", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (2, 0.9, "mit", "MIT-0", "mit no attribution"),
    (2, 1.0, "isc", "ISC", "permission to use copy modify and ~or distribute this software for any purpose with or without fee is hereby granted"),
    (2, 0.95, "isc", "ISC", "the software is provided as is and ~the ~author ~isc disclaims all warranties with regard to this software"),
    (2, 0.9, "hpnd", "HPND", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    (2, 1.0, "bsd", "BSD-2-Clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (2, 0.95, "bsd", "BSD-2-Clause", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (2, 0.95, "bsd", "BSD-2-Clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    (2, 0.95, "bsd", "BSD-3-Clause", "neither the name of ~the ~* ~* ~* ~* ~* nor the names of its contributors may be used to endorse or promote products derived from this software"),
    (2, 0.95, "bsd", "BSD-4-Clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    (2, 0.9, "bsd", "0BSD", "zero clause bsd"),
    (2, 0.9, "bsd", "0BSD", "bsd zero clause"),
    (2, 0.9, "bsd", "0BSD", "0bsd"),
    (2, 1.0, "apache", "Apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    (2, 0.9, "apache", "", "you may not use this file except in compliance with the license"),
    (2, 0.95, "apache", "Apache-2.0", "apache org licenses license 2 0"),
    (2, 0.95, "apache", "Apache-1.1", "apache org licenses license 1 1"),
    (2, 0.95, "apache", "Apache-2.0", "apache license version 2 0 january 2004"),
    (2, 0.95, "apache", "Apache-1.1", "apache software license version 1 1"),
    (2, 0.95, "apache", "Apache-1.0", "apache software license version 1 0"),
    (2, 0.9, "apache", "Apache-2.0", "apache 2 0 licensed"),
    (2, 0.9, "apache", "Apache-2.0 WITH LLVM-exception", "apache ~license ~version 2 0 with llvm exceptions"),
    (2, 0.9, "apache", "Apache-2.0 WITH LLVM-exception", "apache 2 0 with llvm exception"),
    # The GNU family: notices, versions, "or later" and exceptions.
    (2, 1.0, "gpl", "GPL", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    (2, 1.0, "gpl", "GPL-1.0-or-later", "gnu general public license as published by the free software foundation either version 1 ~of ~the ~license or ~at ~your ~option any later version"),
    (2, 1.0, "gpl", "GPL-2.0-or-later", "gnu general public license as published by the free software foundation either version 2 ~of ~the ~license or ~at ~your ~option any later version"),
    (2, 1.0, "gpl", "GPL-3.0-or-later", "gnu general public license as published by the free software foundation either version 3 ~of ~the ~license or ~at ~your ~option any later version"),
    (2, 1.0, "gpl", "GPL-2.0-only", "gnu general public license version 2 only"),
    (2, 1.0, "gpl", "GPL-3.0-only", "gnu general public license version 3 only"),
    (2, 1.0, "gpl", "GPL-2.0-only", "gnu general public license version 2 as published by the free software foundation"),
    (2, 1.0, "gpl", "GPL-3.0-only", "gnu general public license version 3 as published by the free software foundation"),
    (2, 0.95, "gpl", "GPL-2.0-or-later", "gnu general public license ~v ~version 2 ~0 or ~any later"),
    (2, 0.95, "gpl", "GPL-3.0-or-later", "gnu general public license ~v ~version 3 ~0 or ~any later"),
    (2, 0.95, "gpl", "GPL-2.0-only", "gnu general public license version 2 june 1991"),
    (2, 0.95, "gpl", "GPL-3.0-only", "gnu general public license version 3 29 june 2007"),
    (2, 0.95, "gpl", "GPL-2.0-only", "gpl 2 0 only"),
    (2, 0.95, "gpl", "GPL-2.0-or-later", "gpl 2 0 or later"),
    (2, 0.95, "gpl", "GPL-3.0-only", "gpl 3 0 only"),
    (2, 0.95, "gpl", "GPL-3.0-or-later", "gpl 3 0 or later"),
    (2, 0.95, "gpl", "GPL-2.0-or-later", "gplv2 or ~any later"),
    (2, 0.95, "gpl", "GPL-3.0-or-later", "gplv3 or ~any later"),
    (2, 0.9, "gpl", "GPL-2.0-or-later", "gpl v2 or ~any later"),
    (2, 0.9, "gpl", "GPL-3.0-or-later", "gpl v3 or ~any later"),
    (2, 0.9, "gpl", "GPL-2.0-only", "gnu org licenses gpl 2 0"),
    (2, 0.9, "gpl", "GPL-3.0-only", "gnu org licenses gpl 3 0"),
    (2, 0.9, "gpl", "GPL", "you should have received a copy of the gnu general public license"),
    (2, 0.95, "gpl", "GPL-2.0-only WITH Classpath-exception-2.0", "gpl ~* ~* ~* ~* with ~the classpath exception"),
    (2, 0.95, "gpl", "GPL-2.0-only WITH Classpath-exception-2.0", "as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an executable"),
    (2, 0.95, "gpl", "GPL-3.0-or-later WITH GCC-exception-3.1", "gcc runtime library exception version 3 1"),
    (2, 0.95, "gpl", "GPL-2.0-only WITH Linux-syscall-note", "with linux syscall note"),
    (2, 0.9, "gpl", "GPL WITH Bison-exception-2.2", "special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    (2, 0.9, "gpl", "GPL WITH Autoconf-exception-3.0", "this special exception to the gpl applies to versions of autoconf"),
    (2, 0.9, "gpl", "GPL WITH Font-exception-2.0", "as a special exception if you create a document which uses this font"),
    (2, 1.0, "lgpl", "LGPL", "this library is free software you can redistribute it and or modify it under the terms of the gnu ~lesser ~library general public license"),
    (2, 1.0, "lgpl", "LGPL-2.1-or-later", "gnu lesser general public license as published by the free software foundation either version 2 1 ~of ~the ~license or ~at ~your ~option any later version"),
    (2, 1.0, "lgpl", "LGPL-3.0-or-later", "gnu lesser general public license as published by the free software foundation either version 3 ~of ~the ~license or ~at ~your ~option any later version"),
    (2, 1.0, "lgpl", "LGPL-2.0-or-later", "gnu library general public license as published by the free software foundation either version 2 ~of ~the ~license or ~at ~your ~option any later version"),
    (2, 0.95, "lgpl", "LGPL-2.1-only", "gnu lesser general public license version 2 1 february 1999"),
    (2, 0.95, "lgpl", "LGPL-2.1-only", "lgpl 2 1 only"),
    (2, 0.95, "lgpl", "LGPL-2.1-or-later", "lgpl 2 1 or later"),
    (2, 0.95, "lgpl", "LGPL-3.0-only", "lgpl 3 0 only"),
    (2, 0.95, "lgpl", "LGPL-3.0-or-later", "lgpl 3 0 or later"),
    (2, 0.9, "lgpl", "LGPL-2.1-only", "gnu org licenses lgpl 2 1"),
    (2, 0.9, "lgpl", "LGPL-3.0-only", "gnu org licenses lgpl 3 0"),
    (2, 1.0, "agpl", "AGPL-3.0-or-later", "gnu affero general public license as published by the free software foundation either version 3 ~of ~the ~license or ~at ~your ~option any later version"),
    (2, 0.95, "agpl", "AGPL-3.0-only", "gnu affero general public license version 3 19 november 2007"),
    (2, 0.95, "agpl", "AGPL-3.0-only", "agpl 3 0 only"),
    (2, 0.95, "agpl", "AGPL-3.0-or-later", "agpl 3 0 or later"),
    (2, 0.9, "agpl", "AGPL-3.0-only", "gnu org licenses agpl 3 0"),
    (2, 0.9, "gfdl", "GFDL", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    (3, 0.8, "gfdl", "GFDL", "gnu free documentation license"),
    (3, 0.8, "gfdl", "GFDL-1.3-only", "gnu free documentation license version 1 3"),
    (3, 0.8, "gfdl", "GFDL-1.2-only", "gnu free documentation license version 1 2"),
    # Weak copyleft and foundations.
    (2, 1.0, "mpl", "MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (2, 0.95, "mpl", "MPL-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    (2, 0.95, "mpl", "MPL-2.0", "mozilla org mpl 2 0"),
    (2, 0.9, "mpl", "MPL-2.0", "mozilla public license version 2 0"),
    (2, 0.9, "mpl", "MPL-1.1", "mozilla public license version 1 1"),
    (2, 1.0, "epl", "EPL-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license ~v ~version 2 0"),
    (2, 1.0, "epl", "EPL-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    (2, 0.95, "epl", "EPL-2.0", "eclipse org legal epl 2 0"),
    (2, 0.95, "epl", "EPL-1.0", "eclipse org legal epl v10"),
    (2, 0.95, "edl", "BSD-3-Clause", "eclipse org org documents edl v10"),
    (2, 1.0, "cddl", "CDDL-1.0", "the contents of this file are subject to the terms of the common development and distribution license"),
    (3, 0.8, "cddl", "CDDL-1.0", "common development and distribution license"),
    (3, 0.8, "cpl", "CPL-1.0", "common public license ~v ~version 1 0"),
    (3, 0.8, "ipl", "IPL-1.0", "ibm public license ~v ~version 1 0"),
    (3, 0.8, "cpal", "CPAL-1.0", "common public attribution license"),
    (3, 0.8, "osl", "OSL-3.0", "open software license ~v ~version 3 0"),
    (3, 0.8, "afl", "AFL-3.0", "academic free license ~v ~version 3 0"),
    (3, 0.8, "eupl", "EUPL-1.2", "european union public licence ~v ~version 1 2"),
    (3, 0.8, "eupl", "EUPL-1.1", "european union public licence ~v ~version 1 1"),
    (2, 0.95, "eupl", "EUPL", "licensed under the eupl"),
    (3, 0.8, "cecill", "CECILL-2.1", "cecill free software license agreement"),
    (2, 0.9, "cecill", "CECILL-2.1", "governed by the cecill license under french law"),
    (3, 0.8, "ms-pl", "MS-PL", "microsoft public license"),
    (3, 0.8, "ms-rl", "MS-RL", "microsoft reciprocal license"),
    (3, 0.8, "upl", "UPL-1.0", "universal permissive license"),
    (3, 0.8, "ecl", "ECL-2.0", "educational community license"),
    (3, 0.8, "qpl", "QPL-1.0", "q public license ~version 1 0"),
    (3, 0.8, "apsl", "APSL-2.0", "apple public source license"),
    (3, 0.8, "sissl", "SISSL", "sun industry standards source license"),
    (3, 0.8, "lppl", "LPPL-1.3c", "latex project public license"),
    (2, 0.95, "lppl", "LPPL-1.3c", "may be distributed and or modified under the conditions of the latex project public license"),
    (3, 0.8, "ncsa", "NCSA", "university of illinois ncsa open source license"),
    (3, 0.8, "mulan", "MulanPSL-2.0", "mulan permissive software license ~v2"),
    (3, 0.8, "bluoak", "BlueOak-1.0.0", "blue oak model license"),
    (3, 0.8, "vim", "Vim", "vim license"),
    (3, 0.8, "ruby", "Ruby", "ruby license"),
    (3, 0.8, "php", "PHP-3.01", "php license ~version 3 01"),
    (2, 0.9, "php", "PHP-3.01", "this product includes php software freely available from"),
    (3, 0.8, "zpl", "ZPL-2.1", "zope public license"),
    (3, 0.8, "w3c", "W3C", "w3c software notice and license"),
    (3, 0.8, "unicode", "Unicode-3.0", "unicode license ~agreement ~v3"),
    (3, 0.8, "icu", "ICU", "icu license"),
    (3, 0.8, "x11", "X11", "x11 license"),
    (3, 0.8, "curl", "curl", "curl license"),
    (3, 0.8, "libpng", "libpng-2.0", "png reference library license"),
    (3, 0.8, "ijg", "IJG", "independent jpeg group s software"),
    (3, 0.8, "freetype", "FTL", "freetype project license"),
    (3, 0.8, "imagemagick", "ImageMagick", "imagemagick license"),
    (3, 0.8, "beerware", "Beerware", "beer ware license"),
    # Permissive notices.
    (2, 1.0, "zlib", "Zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    (2, 0.95, "zlib", "Zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    (2, 1.0, "boost", "BSL-1.0", "distributed under the boost software license version 1 0"),
    (2, 0.95, "boost", "BSL-1.0", "boost org license 1 0 txt"),
    (2, 0.95, "boost", "BSL-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    (2, 1.0, "unlicense", "Unlicense", "this is free and unencumbered software released into the public domain"),
    (2, 0.95, "unlicense", "Unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    (2, 0.95, "wtfpl", "WTFPL", "do what the fuck you want to public license"),
    (2, 0.95, "artistic", "Artistic-2.0", "the artistic license 2 0"),
    (2, 0.95, "artistic", "Artistic-1.0-Perl", "under the same terms as perl itself"),
    (2, 0.9, "python", "PSF-2.0", "psf license agreement for python"),
    (2, 0.9, "python", "Python-2.0", "python software foundation license version 2"),
    (2, 0.9, "postgresql", "PostgreSQL", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    (2, 0.9, "openssl", "OpenSSL", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    (2, 0.9, "openssl", "SSLeay", "this product includes cryptographic software written by eric young"),
    # Content licenses.
    (2, 1.0, "cc-by", "CC-BY-4.0", "creative commons attribution 4 0 international"),
    (2, 1.0, "cc-by-sa", "CC-BY-SA-4.0", "creative commons attribution sharealike 4 0 international"),
    (2, 1.0, "cc-by-nc", "CC-BY-NC-4.0", "creative commons attribution noncommercial 4 0 international"),
    (2, 1.0, "cc-by-nd", "CC-BY-ND-4.0", "creative commons attribution noderivatives 4 0 international"),
    (2, 1.0, "cc-by-nc", "CC-BY-NC-SA-4.0", "creative commons attribution noncommercial sharealike 4 0 international"),
    (2, 1.0, "cc-by-nc", "CC-BY-NC-ND-4.0", "creative commons attribution noncommercial noderivatives 4 0 international"),
    (2, 0.95, "cc-by-sa", "CC-BY-SA-3.0", "creative commons attribution sharealike 3 0 ~unported ~license"),
    (2, 0.95, "cc-by", "CC-BY-3.0", "creative commons attribution 3 0 ~unported ~license"),
    (2, 0.95, "cc-by", "CC-BY-4.0", "creativecommons org licenses by 4 0"),
    (2, 0.95, "cc-by", "CC-BY-3.0", "creativecommons org licenses by 3 0"),
    (2, 0.95, "cc-by-sa", "CC-BY-SA-4.0", "creativecommons org licenses by sa 4 0"),
    (2, 0.95, "cc-by-sa", "CC-BY-SA-3.0", "creativecommons org licenses by sa 3 0"),
    (2, 0.95, "cc-by-nc", "CC-BY-NC-4.0", "creativecommons org licenses by nc 4 0"),
    (2, 0.95, "cc-by-nc", "CC-BY-NC-SA-4.0", "creativecommons org licenses by nc sa 4 0"),
    (2, 0.95, "cc-by-nc", "CC-BY-NC-ND-4.0", "creativecommons org licenses by nc nd 4 0"),
    (2, 0.95, "cc-by-nd", "CC-BY-ND-4.0", "creativecommons org licenses by nd 4 0"),
    (2, 1.0, "cc0", "CC0-1.0", "creativecommons org publicdomain zero 1 0"),
    (2, 1.0, "cc0", "CC0-1.0", "cc0 1 0 universal"),
    (2, 0.95, "cc0", "CC0-1.0", "to the extent possible under law ~* ~* ~* ~* ~* has waived all copyright and related or neighboring rights"),
    (2, 0.95, "ofl", "OFL-1.1", "this font software is licensed under the sil open font license version 1 1"),
    (2, 0.95, "odbl", "ODbL-1.0", "opendatacommons org licenses odbl"),
    (2, 0.95, "odc-by", "ODC-By-1.0", "open data commons attribution license"),
    (2, 0.95, "pddl", "PDDL-1.0", "open data commons public domain dedication"),
    (2, 0.95, "cdla", "CDLA-Permissive-2.0", "community data license agreement permissive"),
    (2, 0.95, "ogl", "OGL-UK-3.0", "open government licence ~v3 ~0"),
    # Source-available, model and closed terms.
    (3, 0.9, "sspl", "SSPL-1.0", "server side public license"),
    (3, 0.9, "busl", "BUSL-1.1", "business source license ~1 ~1"),
    (3, 0.9, "elastic", "Elastic-2.0", "elastic license 2 0"),
    (3, 0.9, "commons-clause", "", "commons clause license condition"),
    (3, 0.9, "polyform", "PolyForm-Noncommercial-1.0.0", "polyform noncommercial license"),
    (3, 0.9, "polyform", "PolyForm-Small-Business-1.0.0", "polyform small business license"),
    (3, 0.9, "openrail", "", "responsible ai license"),
    (3, 0.9, "openrail", "", "creativeml open rail ~m"),
    (3, 0.9, "json", "JSON", "the software shall be used for good not evil"),
    (2, 0.9, "proprietary", "", "unauthorized copying of this file via any medium is strictly prohibited"),
    (2, 0.9, "proprietary", "", "proprietary and confidential"),
    (2, 0.8, "proprietary", "", "may not be reproduced or transmitted in any form ~* ~* ~* ~* without ~the ~prior written permission"),
    (2, 0.8, "proprietary", "", "end user license agreement"),
    (2, 0.95, "public-domain", "", "released into the public domain"),
    (2, 0.95, "public-domain", "", "dedicated to the public domain"),
    (2, 0.95, "public-domain", "", "work of the united states government"),
)

@dataclass(frozen=True)
class Signature:
    """``form`` and ``name`` are texts that stand in every match; they gate the search for ``regex``."""

    order: int
    priority: int
    confidence: float
    label: str
    spdx: str
    form: str
    name: str
    regex: str


def word_regex(words: str) -> str:
    """Words, optional ones marked by ``~`` (``~*``: any word), as an expression over normalised text."""
    return "".join(f"(?: {'[^ ]+' if w == '~*' else w[1:]} )?" if w[0] == "~" else f" {w} " for w in words.replace("(", "(?:").split())


def keyword_text(words: str) -> str:
    return "".join(f" {w} " for w in words.split())


def held_text(words: str) -> str:
    """The longest text that stands in every match of ``word_regex(words)``: no optional word and no class of characters."""
    runs = [""]
    for w in words.split():
        first, *rest = ("", "") if w[0] == "~" else re.split(r"\[[^]]*\]", f" {w} ")
        runs[-1] += first
        runs += rest
    return max(runs, key=len)


def signatures() -> tuple[Signature, ...]:
    """The rules by priority, written ones first, then those of the families' names in the forms; some hundreds."""
    found = [(priority, confidence, label, spdx, held_text(words), held_text(words), word_regex(words)) for priority, confidence, label, spdx, words in WRITTEN]
    found += [(priority, confidence, label, "", keyword_text(held), held_text(name), word_regex(form.replace("N", name))) for priority, confidence, held, form in FORMS for label, _, names in FAMILIES for name in names]
    found += [(4, 0.6, label, "", held_text(name), held_text(name), word_regex(name)) for label, _, names in FAMILIES if label in BARE for name in names]
    return tuple(Signature(k, *x) for k, x in enumerate(sorted(found, key=lambda x: x[0])))


def gate_words(rules: tuple[Signature, ...]) -> list[str]:
    """Words of which a text must hold one, as a substring, to match any rule or base phrase: each rule's longest, or one that few other texts have."""
    rare = ("licens", "licenc", "gpl", "cc0")
    longest = lambda text: next((part for part in rare if part in text), max(text.split(), key=len))
    words = {longest(s.form) for s in rules} | {longest(p) for p, _ in BASE}
    return sorted(w for w in words if not any(o != w and o in w for o in words))


def normalised(text: Column) -> Column:
    """Each word between two spaces of its own; empty without words."""
    words = F.btrim(F.regexp_replace(F.translate(text, UPPER, LOWER), NOT_WORD, "  "))
    return F.when(F.length(words) == 0, F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, " ", ""))


#: A mark around each match; it is no word's character.
MARK = "\x01"
#: Detections that one inner pass of the suppression takes.
CHUNK = 256
HIT = "struct<start:bigint,back:bigint,order:int,end:bigint,priority:int,label:string,confidence:double,spdx:string>"
DETECTION = "struct<start:bigint,end:bigint,priority:int,order:int,label:string,confidence:double,spdx:string>"


def _occurrences(norm: Column, rule: Column) -> Column:
    """Detections of a rule: start and end in words.

    Matches are put between marks, which stand as words of their own; the k-th
    mark has k marks before it, so its index less k is a place in words.
    """
    marked = F.split(F.btrim(F.regexp_replace(norm, rule["regex"], F.lit(f" {MARK} $0 {MARK} "))), "  ", -1)
    at = F.filter(F.transform(marked, lambda w, i: F.when(w == MARK, i)), lambda i: i.isNotNull())
    place = F.transform(at, lambda i, k: (i - k).cast("bigint"))
    hit = lambda a, b: F.struct(
        a.alias("start"), (-b).alias("back"), rule["order"].alias("order"), b.alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["confidence"].alias("confidence"), rule["spdx"].alias("spdx")
    )
    return _let(place, lambda p: F.zip_with(F.filter(p, lambda x, i: i % 2 == 0), F.filter(p, lambda x, i: i % 2 == 1), hit))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _uncovered(hits: Column) -> Column:
    """Sorted detections without those that lie within another of the same or a higher priority, and of equal intervals the first only.

    In order of start, longest first, a detection is covered if an earlier
    interval of its priority or a higher one ends no sooner; the greatest ends
    by priority are all that is carried.  Results are gathered chunk by chunk,
    so that no long array is copied for each detection.
    """
    tops = ("m1", "m2", "m3", "m4")
    first = F.struct(F.lit(-1).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("end"), *[F.lit(-1).cast("bigint").alias(m) for m in tops])
    none = F.array().cast(f"array<{DETECTION}>")

    def step(acc, h):
        state = acc["state"]
        top = F.when(h["priority"] == 1, state["m1"]).when(h["priority"] == 2, state["m2"]).when(h["priority"] == 3, state["m3"]).otherwise(state["m4"])
        keeps = ((h["start"] != state["start"]) | (h["end"] != state["end"])) & (top < h["end"])
        kept = F.array(F.struct(h["start"].alias("start"), h["end"].alias("end"), h["priority"].alias("priority"), h["order"].alias("order"), h["label"].alias("label"), h["confidence"].alias("confidence"), h["spdx"].alias("spdx")))
        ends = [F.when(h["priority"] <= k, F.greatest(state[m], h["end"])).otherwise(state[m]).alias(m) for k, m in enumerate(tops, 1)]
        return F.struct(F.struct(h["start"].alias("start"), h["end"].alias("end"), *ends).alias("state"), F.when(keeps, F.concat(acc["out"], kept)).otherwise(acc["out"]).alias("out"))

    def chunk(acc, at):
        done = F.aggregate(F.slice(hits, at + 1, CHUNK), F.struct(acc["state"].alias("state"), none.alias("out")), step)
        return _let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    start = F.struct(first.alias("state"), F.array().cast(f"array<array<{DETECTION}>>").alias("out"))
    return F.when(F.size(hits) > 0, F.flatten(F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1, F.lit(CHUNK)), start, chunk)["out"])).otherwise(none)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Signature, ...] | None = None) -> DataFrame:
    """Base places and detections of each document.

    Returns the id, n_words, n_base, first_word, last_word (bigint), base_labels,
    labels (distinct, sorted, comma-joined), score (the greatest confidence of a
    detection, 0 to 1), identifiers (as labels, of the detections that tell a
    license's version, "or later" or exception) and detections, an array of start,
    end (words), priority, order, label, confidence and spdx.
    """
    rules = signatures() if rules is None else rules
    # One literal: the optimiser folds it, so it is built once and not row by row.  Rules stand under the form that gates them.
    fields = ("order", "priority", "confidence", "label", "spdx", "name", "regex")
    by_form: dict[str, list[dict]] = {}
    for s in rules:
        by_form.setdefault(s.form, []).append({f: getattr(s, f) for f in fields})
    listed = [{"form": form, "rules": own} for form, own in by_form.items()]
    table = F.from_json(F.lit(json.dumps(listed)), "array<struct<form:string,rules:array<struct<order:int,priority:int,confidence:double,label:string,spdx:string,name:string,regex:string>>>>")
    docs = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    # Plain substring tests decide which texts are normalised and searched at all.
    parted = docs.select("_id", "_t", F.lower("_t").alias("_low"), F.split("_t", NOT_WORD_ANY_CASE, -1).alias("_w"))
    ends = F.when(F.get("_w", F.lit(0)) == "", 1).otherwise(0) + F.when((F.size("_w") > 1) & (F.element_at("_w", -1) == ""), 1).otherwise(0)
    held = reduce(lambda x, y: x | y, [F.contains("_low", F.lit(k)) for k in gate_words(rules)])
    gated = parted.select("_id", (F.size("_w") - ends).cast("bigint").alias("n_words"), F.when(held, normalised(F.col("_t"))).alias("_n"))
    # Where a phrase's words stand: the words before the first place and after the last one.
    pieces = gated.select("*", *[F.split("_n", keyword_text(p), -1).alias(f"_p{i}") for i, (p, _) in enumerate(BASE)])
    counted = pieces.select(
        "_id",
        "n_words",
        "_n",
        *[(F.size(f"_p{i}") - 1).cast("bigint").alias(f"_c{i}") for i in range(len(BASE))],
        *[(_spaces(F.get(f"_p{i}", F.lit(0))) / 2).cast("bigint").alias(f"_f{i}") for i in range(len(BASE))],
        *[(F.col("n_words") - (_spaces(F.element_at(f"_p{i}", -1)) / 2).cast("bigint") - len(p.split())).alias(f"_l{i}") for i, (p, _) in enumerate(BASE)],
    )
    has = lambda i: F.col(f"_c{i}") > 0
    none = F.array().cast(f"array<{HIT}>")
    gates = F.flatten(F.transform(F.filter(table, lambda f: F.contains(F.col("_n"), f["form"])), lambda f: F.filter(f["rules"], lambda r: F.contains(F.col("_n"), r["name"]))))
    hits = F.flatten(F.transform(gates, lambda r: _occurrences(F.col("_n"), r)))
    numbers = range(len(BASE))
    found = counted.select(
        "_id",
        "n_words",
        F.coalesce(sum((F.col(f"_c{i}") for i in numbers), F.lit(0)), F.lit(0)).cast("bigint").alias("n_base"),
        F.least(*[F.when(has(i), F.col(f"_f{i}")) for i in numbers]).alias("first_word"),
        F.greatest(*[F.when(has(i), F.col(f"_l{i}")) for i in numbers]).alias("last_word"),
        F.array_compact(F.array(*[F.when(has(i), F.lit(label)) for i, (_, label) in enumerate(BASE)])).alias("_base"),
        F.when(F.col("_n").isNull(), none).otherwise(F.array_sort(hits)).alias("_hits"),
    )

    kept = found.select("_id", "n_words", "n_base", "first_word", "last_word", "_base", _uncovered(F.col("_hits")).alias("detections"))
    return kept.select(
        F.col("_id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_base", F.transform("detections", lambda h: h["label"])))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda h: h["confidence"])), F.when(F.size("_base") > 0, F.lit(0.5)), F.lit(0.0)).alias("score"),
        F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("detections", lambda h: h["spdx"]), lambda x: x != ""))), ",").alias("identifiers"),
        "detections",
    )
