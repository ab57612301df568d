"""Signature rules for license notices.

Rules are regular expressions over a text's words, in lower case, with a space on both sides
of each word; patterns are written with single spaces. Rules of a higher priority win where
detections overlap. Families that differ in name and version only are built from templates.
"""

from __future__ import annotations

from dataclasses import dataclass

EXACT, NOTICE, NAME, HINT = 1, 2, 3, 4
CERTAINTY = {EXACT: 0.98, NOTICE: 0.9, NAME: 0.75, HINT: 0.5}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str  # beginnings of words, split by |, one of which every match of the pattern holds
    pattern: str
    priority: int


# (label, keyword, pattern, priority)
WRITTEN = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software", EXACT),
    ("mit", "mit licen", "(?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?mit license", NOTICE),
    ("mit", "mit licen", "mit licen[cs]ed?", NAME),
    ("mit", "mit licen", "the mit licen[cs]e mit", NAME),
    ("mit", "expat", "expat licen[cs]e", NAME),
    ("mit-0", "mit no", "mit no attribution", NAME),
    ("mit-0", "mit 0", "mit 0", NAME),
    ("x11", "x11", "x11 licen[cs]e", NAME),
    ("as-is", "warranty", "the software is provided as is without warranty of any kind", NOTICE),
    ("as-is", "without warrant|without any warrant", "(?:as is|as available) (?:basis )?without (?:any )?warrant(?:y|ies)", HINT),
    ("isc", "isc", "isc licen[cs]e", NAME),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", EXACT),
    ("hpnd", "permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose", EXACT),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", EXACT),
    ("bsd", "bsd", "bsd (?:style )?licen[cs]e", NAME),
    ("bsd", "berkeley", "berkeley software distribution", NAME),
    ("bsd-3-clause", "neither the name", "neither the name of [^.]{1,120} may be used to endorse or promote products", EXACT),
    ("bsd-3-clause", "bsd", "(?:new|revised|modified) bsd licen[cs]e", NAME),
    ("bsd-2-clause", "simplified bsd|simplified licen|freebsd", "(?:simplified|freebsd) (?:bsd )?licen[cs]e", NAME),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software", EXACT),
    ("apache", "apache", "licensed under the apache licen[cs]e", NOTICE),
    ("apache", "apache", "apache (?:software )?licen[cs]e", NAME),
    ("apache-2.0", "apache", "www apache org licenses license 2 0", EXACT),
    ("apache-2.0", "apache", "licensed under the apache license version 2 0(?: the license)?", EXACT),
    ("apache-2.0", "limitations", "see the license for the specific language governing permissions and limitations under the license", NOTICE),
    ("gpl", "gpl", "gnu gpl", NAME),
    ("gpl", "gpl", "gpl(?:ed| licen[cs]ed?)", NAME),
    ("gpl-2.0", "gplv2", "gplv2(?: 0)?", NAME),
    ("gpl-3.0", "gplv3", "gplv3(?: 0)?", NAME),
    ("gpl", "gnu", "gnu general public licen[cs]e", NAME),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it", NOTICE),
    ("gpl", "gnu", "you should have received a copy of the gnu general public license", EXACT),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", NAME),
    ("lgpl", "gnu", "you should have received a copy of the gnu lesser general public license", EXACT),
    ("agpl", "agpl", "(?:gnu )?agpl", NAME),
    ("agpl", "affero", "affero general public licen[cs]e", NAME),
    ("gfdl", "gfdl", "(?:gnu )?gfdl", NAME),
    ("gfdl", "documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", EXACT),
    ("copyleft", "copyleft", "copyleft", HINT),
    ("mpl", "mozilla", "mozilla public licen[cs]e", NAME),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", EXACT),
    ("epl", "eclipse", "eclipse public licen[cs]e", NAME),
    ("epl", "eclipse", "eclipse distribution licen[cs]e", NAME),
    ("cddl", "cddl", "cddl(?: 1 [01])?", NAME),
    ("cddl", "development and distribution", "common development and distribution licen[cs]e", NAME),
    ("cpl", "common public", "common public licen[cs]e", NAME),
    ("ipl", "ibm public", "ibm public licen[cs]e", NAME),
    ("artistic", "artistic", "artistic licen[cs]e", NAME),
    ("artistic-2.0", "artistic", "artistic licen[cs]e (?:version )?2 0", EXACT),
    ("perl", "perl", "under the same terms as perl itself", NOTICE),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", NAME),
    ("zlib", "altered source", "altered source versions must be plainly marked as such", EXACT),
    ("libpng", "libpng", "libpng licen[cs]e", NAME),
    ("bsl-1.0", "boost", "boost software licen[cs]e(?: version 1 0)?", NAME),
    ("unlicense", "unlicense", "the unlicense", NAME),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain", EXACT),
    ("public-domain", "public domain", "(?:released|placed|dedicated|put) (?:in|into|to) the public domain", NOTICE),
    ("public-domain", "public domain", "(?:is|are|in the) public domain", HINT),
    ("wtfpl", "wtfpl", "wtfpl", NAME),
    ("wtfpl", "do what the", "do what the f[a-z]{3} you want to public licen[cs]e", EXACT),
    ("beerware", "beerware", "beerware", NAME),
    ("beerware", "beer", "you can buy me a beer in return", EXACT),
    ("psf", "python", "python software foundation licen[cs]e", NAME),
    ("ruby", "ruby", "ruby licen[cs]e", NAME),
    ("ruby", "ruby", "same terms as ruby", NOTICE),
    ("php", "php", "php licen[cs]e(?: version 3 0[01]?)?", NAME),
    ("postgresql", "postgresql", "postgresql licen[cs]e", NAME),
    ("vim", "vim", "vim licen[cs]e", NAME),
    ("curl", "curl", "curl licen[cs]e", NAME),
    ("openssl", "openssl", "(?:dual )?openssl(?: ssleay)? licen[cs]e", NAME),
    ("openssl", "openssl", "this product includes software developed by the openssl project", EXACT),
    ("tcl", "tcl", "tcl tk licen[cs]e", NAME),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[cs]e", NAME),
    ("w3c", "w3c", "w3c (?:software|document)(?: notice and)? licen[cs]e", NAME),
    ("sleepycat", "sleepycat", "sleepycat licen[cs]e", NAME),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", NAME),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", NAME),
    ("ofl-1.1", "open font", "sil open font licen[cs]e(?: version)?(?: 1 1)?", NAME),
    ("ofl-1.1", "reserved font", "reserved font name", NOTICE),
    ("lppl", "latex project", "latex project public licen[cs]e", NAME),
    ("lppl", "lppl", "lppl", NAME),
    ("odbl", "open database", "open database licen[cs]e", NAME),
    ("odbl", "odbl", "odbl(?: 1 0)?", NAME),
    ("odc-by", "open data commons", "open data commons attribution licen[cs]e", NAME),
    ("pddl", "open data commons", "open data commons public domain dedication(?: and licen[cs]e)?", NAME),
    ("cdla", "community data", "community data licen[cs]e agreement", NAME),
    ("sspl", "server side", "server side public licen[cs]e", NAME),
    ("busl", "business source", "business source licen[cs]e", NAME),
    ("elastic", "elastic", "elastic licen[cs]e", NAME),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict)(?: licen[cs]e)?", NAME),
    ("commons-clause", "commons clause", "commons clause(?: license condition)?", NAME),
    ("openrail", "openrail|open rail", "(?:bigscience |creativeml )?open ?rail(?: [ms])?", NAME),
    ("openrail", "responsible ai", "responsible ai licen[cs]e", NAME),
    ("upl", "universal permissive", "universal permissive licen[cs]e", NAME),
    ("json", "good not evil", "the software shall be used for good not evil", EXACT),
    ("blueoak", "blue oak", "blue oak model licen[cs]e", NAME),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", NAME),
    ("cc0", "public domain", "cc0 1 0 universal public domain dedication", EXACT),
    ("cc", "creative commons", "creative commons(?: licen[cs]e)?", NAME),
    ("cc", "creative commons", "(?:licensed|available|released) under (?:a|the) creative commons", NOTICE),
    ("ogl", "open government", "open government licen[cs]e(?: v?[123](?: 0)?)?", NAME),
    ("etalab", "licence ouverte", "licence ouverte(?: open licence)?(?: etalab)?", NAME),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", NOTICE),
    ("copyright", "copyright", "copyright", HINT),
    ("reserved", "all rights", "all rights reserved", NOTICE),
    ("reserved", "rights reserved", "(?:some|no) rights reserved", NAME),
    ("reserved", "droits", "tous droits r[eé]serv[eé]s", NOTICE),
    ("reserved", "rechte", "alle rechte vorbehalten", NOTICE),
    ("reserved", "derechos", "todos los derechos reservados", NOTICE),
    ("proprietary", "reproduced", "no part of this (?:publication|book|document|work) may be reproduced", EXACT),
    ("proprietary", "proprietary", "proprietary and confidential", NOTICE),
    ("proprietary", "confidential", "confidential and proprietary", NOTICE),
    ("proprietary", "strictly prohibited", "(?:unauthorized )?(?:copying|reproduction|redistribution) (?:of this file )?(?:is )?strictly prohibited", NOTICE),
    ("proprietary", "written permission", "without (?:the )?(?:express |prior )?written permission", NOTICE),
    ("proprietary", "end user", "end user licen[cs]e agreement", NAME),
    ("proprietary", "eula", "eula", HINT),
    ("permission", "permission", "(?:used|reprinted|reproduced) (?:with|by) permission", NOTICE),
    ("noncommercial", "for non", "for non ?commercial (?:use|purposes)(?: only)?", NOTICE),
    ("noncommercial", "commercial", "not for commercial use", NOTICE),
    ("terms", "terms of", "subject to (?:our |the )?terms of (?:use|service)", HINT),
    ("license-text", "terms and conditions for", "terms and conditions for use reproduction and distribution", NOTICE),
    ("license-hint", "licensed", "(?:dual )?licensed under", HINT),
    ("license-hint", "see licen|see the licen|see file licen|see the file licen", "see (?:the )?(?:file )?licen[cs]e(?: txt| md)?", HINT),
    ("license-hint", "license file|licence file", "licen[cs]e file in the (?:project )?root", HINT),
)

# (label, keyword, name pattern, versions)
VERSIONED = (
    ("gpl", "general public", "(?:gnu )?general public licen[cs]e", ("1 0", "1", "2 0", "2", "3 0", "3")),
    ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public licen[cs]e", ("2 0", "2", "2 1", "3 0", "3")),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", ("1 0", "1", "3 0", "3")),
    ("gfdl", "documentation license", "(?:gnu )?free documentation license", ("1 1", "1 2", "1 3")),
    ("gpl", "gpl", "gpl", ("1", "1 0", "2", "2 0", "3", "3 0")),
    ("lgpl", "lgpl", "lgpl", ("2", "2 0", "2 1", "3", "3 0")),
    ("agpl", "agpl", "agpl", ("1", "1 0", "3", "3 0")),
    ("apache", "apache", "apache(?: software)?(?: licen[cs]e)?", ("1 0", "1 1", "2 0", "2")),
    ("mpl", "mozilla", "mozilla public licen[cs]e", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public licen[cs]e", ("1 0", "2 0")),
    ("eupl", "european union", "european union public licen[cs]e", ("1 0", "1 1", "1 2")),
    ("afl", "academic free", "academic free licen[cs]e", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("osl", "open software", "open software licen[cs]e", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("cecill", "cecill", "cecill", ("1 0", "1 1", "2 0", "2 1")),
    ("artistic", "artistic", "artistic licen[cs]e", ("1 0", "2 0")),
    ("zpl", "zope", "zope public licen[cs]e", ("1 1", "2 0", "2 1")),
    ("python", "python", "python licen[cs]e", ("2 0", "2 1", "3 0")),
    ("apsl", "apple public", "apple public source licen[cs]e", ("1 0", "1 1", "1 2", "2 0")),
    ("llama", "llama", "llama community licen[cs]e", ("2", "3", "3 1", "3 2")),
)
BSD_CLAUSES = {"0": "(?:0|zero)", "1": "(?:1|one)", "2": "(?:2|two)", "3": "(?:3|three)", "4": "(?:4|four)"}
CC_PARTS = {
    "by": ("by", "attribution"),
    "by-sa": ("by sa", "attribution share ?alike"),
    "by-nc": ("by nc", "attribution non ?commercial"),
    "by-nd": ("by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    "by-nc-sa": ("by nc sa", "attribution non ?commercial share ?alike"),
    "by-nc-nd": ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
SPDX = ("mit", "apache 2 0", "gpl 2 0", "gpl 3 0", "lgpl 2 1", "lgpl 3 0", "agpl 3 0", "bsd 2 clause", "bsd 3 clause", "mpl 2 0", "isc", "unlicense", "cc0 1 0", "epl 2 0", "zlib")

# The phrases of the base, in the order of their labels.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def rules() -> list[Rule]:
    out = [Rule(*row) for row in WRITTEN]
    for label, keyword, name, versions in VERSIONED:
        for version in versions:
            number = version.replace(" ", ".")
            own = f"{label}-{number if '.' in number else number + '.0'}"
            stated = f"{name},? (?:version |v ?)?{version}".replace(",?", "")
            out.append(Rule(f"{own}-or-later", keyword, f"{stated}(?: of the license)? or (?:at your option )?(?:any )?later(?: version)?", EXACT))
            out.append(Rule(own, keyword, stated, NOTICE))
    for n, word in BSD_CLAUSES.items():
        out.append(Rule(f"bsd-{n}-clause", "clause", f"(?:bsd {word} clause|{word} clause bsd)(?: licen[cs]e)?", NOTICE))
    for part, (short, long) in CC_PARTS.items():
        out.append(Rule(f"cc-{part}", "cc by", f"cc {short}", NAME))
        out.append(Rule(f"cc-{part}", "creative commons", f"creative commons {long}", NAME))
        for version in CC_VERSIONS:
            own = f"cc-{part}-{version.replace(' ', '.')}"
            out.append(Rule(own, "cc by", f"cc {short} {version}", EXACT))
            out.append(Rule(own, "creative commons", f"creative commons {long} {version}(?: international| unported| generic)?(?: licen[cs]e)?", EXACT))
    out += [Rule(f"spdx-{s.replace(' ', '-')}", "spdx", f"spdx license identifier {s}", EXACT) for s in SPDX]
    return out
