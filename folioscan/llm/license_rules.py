"""Signature rules of licence detection: families of names and versions, each in several wordings.

Patterns read normalised words: lower case, one blank between words, so "GPLv2.0" reads "gplv2 0". A rule's keyword
must stand in the text before its pattern is tried. A lower rank goes first where detections overlap.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Phrases that always count, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Family:
    label: str
    keyword: str
    name: str
    versions: tuple[str, ...] = ()
    tag: str = ""


#: Hand-written names; versions as they are written in labels.
FAMILIES = (
    Family("gpl", "gpl", r"(?:gnu )?gpl", ("1.0", "2.0", "3.0")),
    Family("gpl", "general public", r"(?:gnu )?general public licen[cs]e", ("1.0", "2.0", "3.0")),
    Family("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2.0", "2.1", "3.0")),
    Family("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", ("2.0", "2.1", "3.0")),
    Family("agpl", "agpl", r"(?:gnu )?agpl", ("1.0", "3.0")),
    Family("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", ("1.0", "3.0")),
    Family("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e", ("1.1", "1.2", "1.3")),
    Family("apache", "apache", r"apache(?: software)? licen[cs]e", ("1.0", "1.1", "2.0")),
    Family("apache", "asl", r"asl", ("1.1", "2.0")),
    Family("mit", "mit", r"(?:the )?mit(?: x11| expat)? licen[cs]e"),
    Family("mit", "expat", r"expat licen[cs]e"),
    Family("x11", "x11", r"x11 licen[cs]e"),
    Family("isc", "isc", r"isc licen[cs]e"),
    Family("bsd-2-clause", "bsd", r"(?:simplified|freebsd|(?:2|two) clause) bsd(?: licen[cs]e)?|bsd (?:2|two) clause(?: licen[cs]e)?", tag="bsd 2 clause"),
    Family("bsd-3-clause", "bsd", r"(?:new|revised|modified|(?:3|three) clause) bsd(?: licen[cs]e)?|bsd (?:3|three) clause(?: licen[cs]e)?", tag="bsd 3 clause"),
    Family("bsd-4-clause", "bsd", r"(?:original|old|(?:4|four) clause) bsd(?: licen[cs]e)?|bsd (?:4|four) clause(?: licen[cs]e)?", tag="bsd 4 clause"),
    Family("bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
    Family("mpl", "mozilla", r"mozilla public licen[cs]e", ("1.0", "1.1", "2.0")),
    Family("mpl", "mpl", r"mpl", ("1.0", "1.1", "2.0")),
    Family("epl", "eclipse", r"eclipse public licen[cs]e", ("1.0", "2.0")),
    Family("epl", "epl", r"epl", ("1.0", "2.0")),
    Family("cddl", "common development", r"common development and distribution licen[cs]e", ("1.0", "1.1")),
    Family("cddl", "cddl", r"cddl", ("1.0", "1.1")),
    Family("cpl", "common public", r"common public licen[cs]e", ("1.0",)),
    Family("eupl", "eupl", r"eupl", ("1.0", "1.1", "1.2")),
    Family("eupl", "european union public", r"european union public licen[cs]e", ("1.0", "1.1", "1.2")),
    Family("cecill", "cecill", r"cecill(?: free software)?(?: licen[cs]e)?", ("1.0", "2.0", "2.1")),
    Family("artistic", "artistic", r"artistic licen[cs]e", ("1.0", "2.0")),
    Family("afl", "academic free", r"academic free licen[cs]e", ("2.1", "3.0")),
    Family("osl", "open software", r"open software licen[cs]e", ("2.1", "3.0")),
    Family("ofl", "open font", r"(?:sil )?open font licen[cs]e", ("1.0", "1.1")),
    Family("odbl", "odbl", r"odbl", ("1.0",)),
    Family("odbl", "open database", r"open database licen[cs]e(?: odbl)?", ("1.0",)),
    Family("odc-by", "odc by", r"odc by", ("1.0",)),
    Family("odc-by", "open data commons", r"open data commons attribution licen[cs]e", ("1.0",)),
    Family("pddl", "pddl", r"pddl", ("1.0",)),
    Family("bsl", "boost", r"boost software licen[cs]e", ("1.0",)),
    Family("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    Family("psf", "python software", r"python software foundation licen[cs]e", ("2.0",)),
    Family("psf", "psf", r"psf licen[cs]e", ("2.0",)),
    Family("php", "php", r"php licen[cs]e", ("3.0", "3.01")),
    Family("ruby", "ruby", r"ruby licen[cs]e"),
    Family("postgresql", "postgresql", r"postgresql licen[cs]e"),
    Family("openssl", "openssl", r"openssl licen[cs]e"),
    Family("vim", "vim", r"vim licen[cs]e"),
    Family("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    Family("ms-pl", "microsoft public", r"microsoft public licen[cs]e"),
    Family("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e"),
    Family("wtfpl", "wtfpl", r"wtfpl", ("2.0",)),
    Family("unlicense", "unlicense", r"unlicense"),
    Family("cc0", "cc0", r"(?:creative commons )?cc0(?: universal)?", ("1.0",)),
    Family("cc-by-nc-nd", "by nc nd", r"(?:creative commons |cc )by nc nd", ("2.0", "3.0", "4.0")),
    Family("cc-by-nc-sa", "by nc sa", r"(?:creative commons |cc )by nc sa", ("2.0", "3.0", "4.0")),
    Family("cc-by-nc", "by nc", r"(?:creative commons |cc )by nc", ("2.0", "3.0", "4.0")),
    Family("cc-by-nd", "by nd", r"(?:creative commons |cc )by nd", ("2.0", "3.0", "4.0")),
    Family("cc-by-sa", "by sa", r"(?:creative commons |cc )by sa", ("2.0", "3.0", "4.0")),
    Family("cc-by", "cc by", r"cc by", ("2.0", "2.5", "3.0", "4.0")),
    Family("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike", ("3.0", "4.0")),
    Family("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial", ("3.0", "4.0")),
    Family("cc-by-sa", "creative commons", r"creative commons attribution share ?alike", ("3.0", "4.0")),
    Family("cc-by", "creative commons", r"creative commons attribution", ("3.0", "4.0")),
    Family("public-domain", "public domain", r"(?:dedicated to|placed in|released into) the public domain"),
    Family("proprietary", "rights reserved", r"all rights reserved"),
)

#: Hand-written passages of licence texts, headings and addresses, as normalised words: label, keyword, pattern, weight.
#: A passage that several licences share has the label of their family.
SIGNATURES = (
    ("mit", "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.95),
    ("mit", "above copyright notice and this permission", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", 0.95),
    ("isc", "permission to use copy modify and", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 0.95),
    ("0bsd", "permission to use copy modify and", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)", 0.95),
    ("bsd", "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.9),
    ("bsd-3-clause", "to endorse or promote products", r"neither the name (?:of )?(?:[^ ]+ ){1,30}may be used to endorse or promote products derived from this software without specific prior written permission", 0.95),
    ("bsd-4-clause", "all advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.95),
    ("apache-2.0", "you may not use this file except", r"you may not use this file except in compliance with the license(?: you may obtain a copy of the license at https? (?:www )?apache org licenses license 2 0)?", 0.7),
    ("apache-2.0", "terms and conditions for use reproduction", r"terms and conditions for use reproduction and distribution 1 definitions license shall mean", 0.95),
    ("gpl", "free software you can redistribute it", r"(?:is|are) free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 0.95),
    ("lgpl", "free software you can redistribute it", r"(?:is|are) free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", 0.95),
    ("agpl", "free software you can redistribute it", r"(?:is|are) free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e", 0.95),
    ("gfdl", "permission is granted to copy distribute", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", 0.95),
    ("mpl-2.0", "this source code form is subject", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", 1.0),
    ("mpl-1.1", "the contents of this file are subject", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1", 1.0),
    ("epl-2.0", "are made available under the terms of the eclipse", r"are made available under the terms of the eclipse public licen[cs]e(?: v| version)? ?2 0", 1.0),
    ("zlib", "provided as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", 0.95),
    ("bsl-1.0", "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 0.95),
    ("unlicense", "free and unencumbered software", r"this is free and unencumbered software released into the public domain", 0.95),
    ("wtfpl", "you just do what", r"you just do what the fuck you want to", 0.95),
    ("ofl-1.1", "this font software is licensed under", r"this font software is licensed under the sil open font licen[cs]e version 1 1", 1.0),
    ("cc0-1.0", "the person who associated a work", r"the person who associated a work with this deed has dedicated the work to the public domain", 0.95),
    ("mit", "opensource org", r"opensource org licen[cs]es? mit(?: licen[cs]e)?", 0.95),
    ("isc", "opensource org", r"opensource org licen[cs]es? isc(?: licen[cs]e)?", 0.95),
    ("bsd-2-clause", "opensource org", r"opensource org licen[cs]es? bsd(?: licen[cs]e)? 2 clause", 0.95),
    ("bsd-3-clause", "opensource org", r"opensource org licen[cs]es? bsd(?: licen[cs]e)? 3 clause", 0.95),
    ("apache-2.0", "apache org", r"apache org licen[cs]es license 2 0", 1.0),
    ("apache-2.0", "opensource org", r"opensource org licen[cs]es? apache(?: license)? 2 0", 1.0),
    ("gpl", "gnu org", r"gnu org (?:licen[cs]es|copyleft) gpl", 0.9),
    ("gpl-2.0", "gnu org", r"gnu org licen[cs]es old licenses gpl 2 0", 1.0),
    ("gpl-3.0", "gnu org", r"gnu org licen[cs]es gpl 3 0", 1.0),
    ("lgpl", "gnu org", r"gnu org (?:licen[cs]es|copyleft) (?:lgpl|lesser)", 0.9),
    ("lgpl-2.1", "gnu org", r"gnu org licen[cs]es old licenses lgpl 2 1", 1.0),
    ("lgpl-3.0", "gnu org", r"gnu org licen[cs]es lgpl 3 0", 1.0),
    ("agpl-3.0", "gnu org", r"gnu org licen[cs]es agpl(?: 3 0)?", 1.0),
    ("gfdl", "gnu org", r"gnu org (?:licen[cs]es|copyleft) fdl", 0.9),
    ("mpl-2.0", "mozilla org", r"mozilla org (?:en us )?mpl 2 0", 1.0),
    ("epl-2.0", "eclipse org", r"eclipse org legal epl v?2 ?0", 1.0),
    ("bsl-1.0", "boost org", r"boost org license 1 0", 1.0),
    ("unlicense", "unlicense org", r"unlicense org", 0.95),
    ("wtfpl", "wtfpl net", r"wtfpl net", 0.95),
    ("ofl", "scripts sil org", r"scripts sil org ofl", 0.95),
    ("odbl", "opendatacommons org", r"opendatacommons org licen[cs]es odbl", 0.95),
    ("odc-by", "opendatacommons org", r"opendatacommons org licen[cs]es by", 0.95),
    ("pddl", "opendatacommons org", r"opendatacommons org licen[cs]es pddl", 0.95),
    ("cc0-1.0", "creativecommons org", r"creativecommons org publicdomain zero 1 0", 1.0),
    ("public-domain", "creativecommons org", r"creativecommons org publicdomain mark 1 0", 0.95),
)
#: Addresses of Creative Commons licences, one rule per kind and version.
CC_KINDS, CC_VERSIONS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"), ("1.0", "2.0", "2.5", "3.0", "4.0")

#: No rule matches words in which none of these stands: most names hold "licen", the others are listed.
GATES = (
    "licen", "gpl", " asl", "bsd", " mpl", " epl", "cddl", "eupl", "cecill", "odbl", "odc by", "pddl", "wtfpl", "cc0", "cc by",
    "creative commons", "public domain", "rights reserved", "spdx", "permission", "redistribution", "all advertising materials",
    "express or implied warranty", "you just do what", "gnu org", "mozilla org", "eclipse org", "scripts sil org", "creativecommons org",
)

NOTICE = r"(?:licen[cs]ed|released|distributed|published|available|provided|covered) (?:under|by)(?: the)?(?: terms? of)?(?: the)? "


@dataclass(frozen=True)
class Rule:
    rank: int
    label: str
    keyword: str
    pattern: str
    weight: float
    base: str = ""


def worded(version: str) -> str:
    """A version as words: an optional "version" or "v" before it, a final zero may be missing."""
    major, _, minor = version.partition(".")
    rest = rf"(?: {minor})?" if minor == "0" else rf" {minor}"
    return rf"(?: licen[cs]e)?(?: version| v| ver)?(?: |v| v){major}{rest}"


def rules() -> list[Rule]:
    """All rules in the order of their rank: tags, notices with a version, notices, names with a version, names, base phrases. Signatures go first."""
    kinds: dict[str, list[tuple[str, str, str, float, str]]] = {k: [] for k in ("signature", "tag", "notice", "bare notice", "versioned", "name", "base")}
    kinds["signature"] = [(*row, "") for row in SIGNATURES]
    for kind in CC_KINDS:
        for v in CC_VERSIONS:
            kinds["signature"].append((f"cc-{kind.replace(' ', '-')}-{v}", "creativecommons org", f"creativecommons org licen[cs]es {kind} {v.replace('.', ' ')}", 1.0, ""))
    for f in FAMILIES:
        name = f"(?:{f.name})"
        kinds["tag"].append((f.label, "spdx", f"spdx license identifier {f.tag or f.label.replace('-', ' ')}(?: only| or later)?", 0.95, ""))
        for v in f.versions:
            full = f"{f.label}-{v}"
            kinds["tag"].append((full, "spdx", f"spdx license identifier {f.label.replace('-', ' ')} {v.replace('.', ' ')}(?: only| or later)?", 1.0, ""))
            kinds["notice"].append((full, f.keyword, NOTICE + name + worded(v), 0.98, ""))
            kinds["versioned"].append((full, f.keyword, name + worded(v), 0.85, ""))
        kinds["bare notice"].append((f.label, f.keyword, NOTICE + name, 0.9, ""))
        kinds["name"].append((f.label, f.keyword, name, 0.6, ""))
    for phrase, label in BASE.items():
        kinds["base"].append((label, phrase.split()[-2], phrase, 0.55, label))
    found, seen = [], set()
    for rows in kinds.values():
        for label, keyword, pattern, weight, base in rows:
            if (pattern, base) not in seen:
                seen.add((pattern, base))
                found.append(Rule(len(found), label, keyword, pattern, weight, base))
    return found
