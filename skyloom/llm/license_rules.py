"""Signature rules for licenses: regexes over words joined by single blanks, a-z in lower case.

A rule has a label (empty: it only hides others), a rank (less is stronger), a weight from 0 to 1, its regex and its keywords, one
of which every match holds. Patterns are of bounded length (at most REACH bytes), so a match lies near its keyword.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Bytes that no match is longer than.
REACH = 600
#: Ranks: what hides others, tags and texts, notices, fields and addresses, names.
HIDE, TEXT, NOTICE, FIELD, NAME = range(5)


@dataclass(frozen=True)
class Rule:
    label: str
    rank: int
    weight: float
    pattern: str
    keywords: tuple[str, ...]


L = "licen[cs]e"
#: What may follow a version.
ON = "(?: only| or(?: at your option)?(?: any)? later(?: version)?)?"


def _v(number: str) -> str:
    """A version: v3, version 3, 3 0 and the like."""
    return f" (?:version |ver |v ?)?{number}(?: 0)?{ON}"


#: The names that a license goes by: label, pattern, keywords.
NAMES: list[tuple[str, str, tuple[str, ...]]] = [
    # permissive
    ("mit", f"mit(?: x11| expat)? {L}|expat {L}|x11 {L}", ("mit licen", "x11 licen", "expat licen")),
    ("mit-0", f"mit no attribution(?: {L})?", ("mit no attribution",)),
    ("apache-2", f"apache(?: software)? {L}(?: version| v)? ?2(?: 0)?|apache 2(?: 0)?(?: {L})?|asl 2 0", ("apache licen", "apache software licen", "apache 2", "asl 2 0")),
    ("apache-1-1", f"apache(?: software)? {L}(?: version| v)? ?1 1", ("apache licen", "apache software licen")),
    ("apache", f"apache(?: software)? {L}", ("apache licen", "apache software licen")),
    ("bsd-2-clause", f"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: {L})?", ("bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd")),
    ("bsd-3-clause", f"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: {L})?", ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd")),
    ("bsd-4-clause", f"(?:bsd 4 clause|4 clause bsd|original bsd)(?: {L})?", ("bsd 4 clause", "4 clause bsd", "original bsd")),
    ("bsd", f"(?:berkeley software distribution|bsd)(?: style)? {L}", ("bsd licen", "bsd style licen", "berkeley software distribution")),
    ("0bsd", f"(?:0bsd|bsd zero clause|zero clause bsd)(?: {L})?", ("0bsd", "bsd zero clause", "zero clause bsd")),
    ("isc", f"isc {L}", ("isc licen",)),
    ("zlib", f"zlib(?: libpng)? {L}", ("zlib licen", "zlib libpng licen")),
    ("libpng", f"libpng {L}(?: version 2)?", ("libpng licen",)),
    ("boost-1", f"boost software {L}(?: version)?(?: 1(?: 0)?)?", ("boost software licen",)),
    ("unlicense", f"the unlicense|unlicense {L}", ("unlicense",)),
    ("wtfpl", "wtfpl(?: version| v)? ?2|wtfpl", ("wtfpl",)),
    ("postgresql", f"postgresql {L}", ("postgresql licen",)),
    ("python-2", f"(?:python software foundation|psf) {L}(?: version| v)?(?: ?2)?", ("python software foundation licen", "psf licen")),
    ("ncsa", f"(?:ncsa|university of illinois(?: ncsa)?) open source {L}", ("ncsa open source licen", "illinois open source licen")),
    ("artistic-2", f"artistic {L}(?: version| v)? ?2(?: 0)?", ("artistic licen",)),
    ("artistic-1", f"artistic {L}(?: version| v)? ?1(?: 0)?|perl artistic {L}", ("artistic licen",)),
    ("artistic", f"artistic {L}", ("artistic licen",)),
    ("php-3", f"php {L}(?: version| v)? ?3(?: 0[01]?)?|php {L}", ("php licen",)),
    ("openssl", f"openssl {L}", ("openssl licen",)),
    ("ruby", f"ruby {L}", ("ruby licen",)),
    ("vim", f"vim {L}", ("vim licen",)),
    ("w3c", f"w3c(?: software(?: notice)?(?: and(?: document)?)?)? {L}", ("w3c licen", "w3c software")),
    ("curl", f"curl {L}", ("curl licen",)),
    ("ms-pl", f"microsoft public {L}|ms pl", ("microsoft public licen", "ms pl")),
    ("blueoak-1", f"blue oak model {L}(?: 1 0 0)?", ("blue oak model licen",)),
    ("upl-1", f"universal permissive {L}(?: v(?:ersion)? ?1 0)?", ("universal permissive licen",)),
    ("afl-3", f"academic free {L}(?: v(?:ersion)? ?3(?: 0)?)?", ("academic free licen",)),
    ("ecl-2", f"educational community {L}(?: v(?:ersion)? ?2 0)?", ("educational community licen",)),
    # weak and strong copyleft
    ("gpl-1", f"(?:(?:gnu )?general public {L}|(?:gnu )?gpl){_v('1')}|gplv1", ("general public licen", "gpl")),
    ("gpl-2", f"(?:(?:gnu )?general public {L}|(?:gnu )?gpl){_v('2')}|gplv2", ("general public licen", "gpl")),
    ("gpl-3", f"(?:(?:gnu )?general public {L}|(?:gnu )?gpl){_v('3')}|gplv3", ("general public licen", "gpl")),
    ("gpl", f"(?:gnu )?general public {L}|gnu gpl", ("general public licen", "gnu gpl")),
    ("lgpl-2-1", f"(?:(?:gnu )?lesser general public {L}|(?:gnu )?lgpl) (?:version |ver |v ?)?2 1{ON}|lgplv2 1", ("lesser general public licen", "lgpl")),
    ("lgpl-2", f"(?:(?:gnu )?(?:lesser|library) general public {L}|(?:gnu )?lgpl){_v('2')}|lgplv2", ("lesser general public licen", "library general public licen", "lgpl")),
    ("lgpl-3", f"(?:(?:gnu )?lesser general public {L}|(?:gnu )?lgpl){_v('3')}|lgplv3", ("lesser general public licen", "lgpl")),
    ("lgpl", f"(?:gnu )?(?:lesser|library) general public {L}|gnu lgpl", ("lesser general public licen", "library general public licen", "gnu lgpl")),
    ("agpl-3", f"(?:(?:gnu )?affero general public {L}|(?:gnu )?agpl){_v('3')}|agplv3", ("affero general public licen", "agpl")),
    ("agpl", f"(?:gnu )?affero general public {L}|gnu agpl", ("affero general public licen", "gnu agpl")),
    ("gfdl-1-3", f"(?:(?:gnu )?free documentation {L}|gfdl) (?:version |v ?)?1 3{ON}", ("free documentation licen", "gfdl")),
    ("gfdl-1-2", f"(?:(?:gnu )?free documentation {L}|gfdl) (?:version |v ?)?1 2{ON}", ("free documentation licen", "gfdl")),
    ("gfdl", f"(?:gnu )?free documentation {L}|gfdl", ("free documentation licen", "gfdl")),
    ("mpl-2", f"(?:mozilla public {L}|mpl) (?:version |v ?)?2(?: 0)?", ("mozilla public licen", "mpl ")),
    ("mpl-1-1", f"(?:mozilla public {L}|mpl) (?:version |v ?)?1 1", ("mozilla public licen", "mpl ")),
    ("mpl", f"mozilla public {L}", ("mozilla public licen",)),
    ("epl-2", f"(?:eclipse public {L}|epl) (?:version |v ?)?2(?: 0)?", ("eclipse public licen", "epl ")),
    ("epl-1", f"(?:eclipse public {L}|epl) (?:version |v ?)?1(?: 0)?", ("eclipse public licen", "epl ")),
    ("epl", f"eclipse public {L}", ("eclipse public licen",)),
    ("cddl-1", f"common development and distribution {L}(?: (?:version |v ?)?1(?: [01])?)?|cddl (?:version |v ?)?1(?: [01])?", ("common development and distribution licen", "cddl ")),
    ("cpl-1", f"common public {L}(?: (?:version |v ?)?1(?: 0)?)?", ("common public licen",)),
    ("eupl-1-2", f"(?:european union public {L}|eupl) (?:version |v ?)?1 2", ("european union public licen", "eupl ")),
    ("eupl", f"european union public {L}", ("european union public licen",)),
    ("osl-3", f"open software {L}(?: (?:version |v ?)?3(?: 0)?)?", ("open software licen",)),
    ("ipl-1", f"ibm public {L}(?: (?:version |v ?)?1(?: 0)?)?", ("ibm public licen",)),
    ("qpl-1", f"q public {L}(?: (?:version |v ?)?1(?: 0)?)?", ("q public licen",)),
    ("sleepycat", f"sleepycat {L}", ("sleepycat licen",)),
    ("ms-rl", f"microsoft reciprocal {L}", ("microsoft reciprocal licen",)),
    ("cecill", f"cecill(?: (?:free software )?{L})?(?: (?:version |v ?)?2(?: [01])?)?", ("cecill",)),
    # works and data
    ("cc0", "cc0(?: 1 0)?(?: universal)?|creative commons zero|cc zero", ("cc0", "creative commons zero", "cc zero")),
    ("cc-by-nc-nd", "(?:cc by|creative commons attribution) (?:nc|non ?commercial) (?:nd|no ?deriv(?:ative|ativ|)(?:e?s| works)?)(?: [1-4] [05])?", ("cc by n", "creative commons attribution n")),
    ("cc-by-nc-sa", "(?:cc by|creative commons attribution) (?:nc|non ?commercial) (?:sa|share ?alike)(?: [1-4] [05])?", ("cc by n", "creative commons attribution n")),
    ("cc-by-nc", "(?:cc by|creative commons attribution) (?:nc|non ?commercial)(?: [1-4] [05])?", ("cc by n", "creative commons attribution n")),
    ("cc-by-nd", "(?:cc by|creative commons attribution) (?:nd|no ?deriv(?:ative|)s)(?: [1-4] [05])?", ("cc by n", "creative commons attribution n")),
    ("cc-by-sa", "(?:cc by|creative commons attribution) (?:sa|share ?alike)(?: [1-4] [05])?", ("cc by s", "creative commons attribution s")),
    ("cc-by", f"cc by [1-4] [05]|creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: {L})?", ("cc by ", "creative commons attribution")),
    ("cc", f"creative commons {L}", ("creative commons licen",)),
    ("odbl-1", f"open (?:data commons )?(?:open )?database {L}|odbl(?: (?:v ?)?1(?: 0)?)?", ("database licen", "odbl")),
    ("odc-by-1", f"(?:open data commons )?attribution {L}(?: odc by)?(?: (?:v ?)?1 0)?|odc by", ("attribution licen", "odc by")),
    ("pddl-1", f"(?:open data commons )?public domain dedication and {L}|pddl", ("public domain dedication and licen", "pddl")),
    ("ogl-uk-3", f"open government {L}(?: (?:version |v ?)?3(?: 0)?)?", ("open government licen",)),
    ("ofl-1-1", f"sil open font {L}(?: (?:version |v ?)?1 1)?|ofl 1 1", ("sil open font licen", "ofl 1 1")),
    ("lal-1-3", f"free art {L}(?: 1 3)?", ("free art licen",)),
    ("cdla-permissive", f"community data {L} agreement permissive", ("community data licen",)),
    ("cdla-sharing", f"community data {L} agreement sharing", ("community data licen",)),
    ("rail", f"(?:open )?rail(?: [ms])? {L}|(?:bigscience|creativeml) open rail m(?: {L})?", ("rail licen", "rail m", "rail s licen")),
    # not open
    ("sspl-1", f"server side public {L}(?: (?:version |v ?)?1)?|sspl", ("server side public licen", "sspl")),
    ("bsl-1-1", f"business source {L}(?: (?:version |v ?)?1 1)?", ("business source licen",)),
    ("elastic-2", f"elastic {L}(?: (?:version |v ?)?2(?: 0)?)?", ("elastic licen",)),
    ("commons-clause", f"commons clause(?: {L} condition)?(?: v(?:ersion)? ?1 0)?", ("commons clause",)),
    ("polyform-nc-1", f"polyform non ?commercial {L}(?: 1 0 0)?", ("polyform",)),
    ("proprietary", f"proprietary {L}|commercial {L} agreement|end user {L} agreement|eula", ("proprietary licen", "commercial licen", "end user licen", "eula")),
]

#: Identifiers that may stand behind a tag, as words.
TAGS: list[tuple[str, str]] = [
    ("mit", "mit"), ("mit-0", "mit 0"), ("apache-2", "apache 2 0"), ("apache-1-1", "apache 1 1"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"),
    ("bsd-4-clause", "bsd 4 clause"), ("0bsd", "0bsd"), ("isc", "isc"), ("zlib", "zlib"), ("boost-1", "bsl 1 0"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"),
    ("postgresql", "postgresql"), ("python-2", "(?:psf|python) 2 0"), ("ncsa", "ncsa"), ("artistic-2", "artistic 2 0"), ("artistic-1", "artistic 1 0"), ("php-3", "php 3 0[01]?"),
    ("openssl", "openssl"), ("ms-pl", "ms pl"), ("ms-rl", "ms rl"), ("upl-1", "upl 1 0"), ("afl-3", "afl 3 0"), ("ecl-2", "ecl 2 0"),
    ("gpl-1", "gpl 1 0(?: only| or later)?"), ("gpl-2", "gpl 2 0(?: only| or later)?"), ("gpl-3", "gpl 3 0(?: only| or later)?"), ("lgpl-2", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2-1", "lgpl 2 1(?: only| or later)?"), ("lgpl-3", "lgpl 3 0(?: only| or later)?"), ("agpl-3", "agpl 3 0(?: only| or later)?"), ("gfdl-1-2", "gfdl 1 2(?: only| or later)?"),
    ("gfdl-1-3", "gfdl 1 3(?: only| or later)?"), ("mpl-2", "mpl 2 0"), ("mpl-1-1", "mpl 1 1"), ("epl-1", "epl 1 0"), ("epl-2", "epl 2 0"), ("cddl-1", "cddl 1 [01]"),
    ("eupl-1-2", "eupl 1 2"), ("osl-3", "osl 3 0"), ("cc0", "cc0 1 0"), ("cc-by", "cc by [1-4] [05]"), ("cc-by-sa", "cc by sa [1-4] [05]"), ("cc-by-nc", "cc by nc [1-4] [05]"),
    ("cc-by-nd", "cc by nd [1-4] [05]"), ("cc-by-nc-sa", "cc by nc sa [1-4] [05]"), ("cc-by-nc-nd", "cc by nc nd [1-4] [05]"), ("odbl-1", "odbl 1 0"), ("odc-by-1", "odc by 1 0"),
    ("pddl-1", "pddl 1 0"), ("ofl-1-1", "ofl 1 1"), ("sspl-1", "sspl 1 0"), ("bsl-1-1", "busl 1 1"), ("elastic-2", "elastic 2 0"),
]

#: Addresses, as words.
ADDRESSES: list[tuple[str, str]] = [
    ("mit", "opensource org licenses mit(?: license)?"), ("mit", "choosealicense com licenses mit"), ("apache-2", "apache org licenses license 2 0"), ("apache-2", "opensource org licenses apache 2 0"),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause"), ("bsd-3-clause", "opensource org licenses bsd 3 clause"), ("isc", "opensource org licenses isc"), ("boost-1", "boost org license 1 0"),
    ("unlicense", "unlicense org"), ("gpl-2", "gnu org licenses (?:old licenses )?gpl 2 0"), ("gpl-3", "gnu org licenses gpl 3 0"), ("gpl", "gnu org (?:licenses|copyleft) gpl"),
    ("lgpl-2-1", "gnu org licenses (?:old licenses )?lgpl 2 1"), ("lgpl-3", "gnu org licenses lgpl 3 0"), ("lgpl", "gnu org (?:licenses|copyleft) lgpl"), ("agpl-3", "gnu org licenses agpl 3 0"),
    ("gfdl", "gnu org (?:licenses|copyleft) fdl"), ("mpl-2", "mozilla org (?:en us )?mpl 2 0"), ("mpl-1-1", "mozilla org (?:en us )?mpl 1 1"), ("epl-2", "eclipse org legal epl 2 0"), ("epl-1", "eclipse org legal epl v10"),
    ("cc0", "creativecommons org publicdomain zero 1 0"), ("cc-by", "creativecommons org licenses by [1-4] [05]"), ("cc-by-sa", "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons org licenses by nc [1-4] [05]"), ("cc-by-nd", "creativecommons org licenses by nd [1-4] [05]"), ("cc-by-nc-sa", "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd [1-4] [05]"), ("odbl-1", "opendatacommons org licenses odbl"), ("odc-by-1", "opendatacommons org licenses by"), ("pddl-1", "opendatacommons org licenses pddl"),
    ("ofl-1-1", "scripts sil org ofl"), ("sspl-1", "mongodb com licensing server side public license"), ("elastic-2", "elastic co licensing elastic license"),
]

#: Sentences that only a license's own text has: label, pattern, keyword.
SENTENCES: list[tuple[str, str, str]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?", "hereby granted free of charge"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", "included in all copies or substantial"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "this software for any purpose with or without fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "use in source and binary forms"),
    ("bsd-3-clause", "neither the name of (?:[a-z0-9]{1,30} ){1,12}nor the names of its contributors may be used", "nor the names of its contributors"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", "all advertising materials mentioning"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "in no event will the authors be held liable"),
    ("zlib", "altered source versions must be plainly marked as such", "altered source versions must be plainly"),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy", "any person or organization obtaining a copy"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed", "agreed to in writing software distributed under"),
    ("apache-2", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable", "hereby grants to you a perpetual worldwide"),
    ("apache-2", "you may not use this file except in compliance with the license", "this file except in compliance"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("wtfpl", "you just do what the fuck you want to", "just do what the fuck you want"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "under the terms of the gnu general public"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document", "verbatim copies of this license document"),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works", "free copyleft license for software"),
    ("gpl-2", "the licenses for most software are designed to take away your freedom to share and change it", "designed to take away your freedom"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "this library is free software"),
    ("agpl-3", "specifically designed to ensure cooperation with the community in the case of network server software", "in the case of network server software"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license(?: v(?:ersion)? ?2 0)?", "source code form is subject to the terms"),
    ("mpl-1-1", "the contents of this file are subject to the mozilla public license version 1 1", "subject to the mozilla public license version 1 1"),
    ("epl", "the accompanying program is provided under the terms of this eclipse public license", "terms of this eclipse public license"),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license", "terms of the common development and distribution"),
    ("artistic-2", "this license establishes the terms under which a given free software package may be copied", "a given free software package may be copied"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", "dedicated the work to the public domain"),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made", "give appropriate credit provide a link"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license", "distribute your contributions under the same license"),
    ("cc-by-nc", "you may not use the material for commercial purposes", "use the material for commercial purposes"),
    ("ofl-1-1", "this font software is licensed under the sil open font license(?: version 1 1)?", "this font software is licensed"),
    ("ogl-uk-3", "contains public sector information licensed under the open government licence(?: v3 0)?", "contains public sector information"),
    ("python-2", "psf hereby grants licensee a nonexclusive royalty free world wide license", "hereby grants licensee a nonexclusive"),
    ("public-domain", "(?:released|dedicated|placed|put)(?: in| into| to) the public domain", "the public domain"),
    ("public-domain", "(?:this work|this file|the text|it) is in the public domain", "in the public domain"),
    ("all-rights-reserved", "(?:copyright )?all rights reserved", "all rights reserved"),
    ("proprietary", "unauthorized (?:copying|use|reproduction|distribution)(?: or distribution)? (?:of this (?:file|material|software|document) )?(?:via any medium )?is strictly prohibited", "is strictly prohibited"),
    ("proprietary", "(?:confidential and proprietary|proprietary and confidential)", "confidential"),
    ("non-commercial", "(?:for|free for) (?:personal and )?non ?commercial use only", "commercial use only"),
    ("no-training", "may not be used (?:to train|for training|for the training of) (?:machine learning|artificial intelligence|ai|language)(?: models?)?", "may not be used"),
]

#: Licenses that are spoken of but not granted.
_DENIED = "(?:no longer|never|not)(?: be| been| being)? (?:licen[cs]ed|released|distributed|available|published|covered)(?: by| under)(?: the)?"
_BESIDE = "(?:in)?compatible with(?: the)?"
_GRANT = "(?:licen[cs]ed|released|distributed|available|published|provided|covered|governed|shared|offered|redistributed)(?: to you)? (?:by|under|with)(?: the)?(?: terms(?: and conditions)? of)?(?: the| a| an)?"
_FIELD = "(?:licen[cs]e|licensing|rights)(?: type| name| is| s)?(?: the)?"


def all_rules() -> list[Rule]:
    """All rules in their order: of two equal matches the earlier one stands."""
    out = [Rule("", HIDE, 0.0, f"(?:{lead}) (?:{name})", keys) for lead in (_DENIED, _BESIDE) for _, name, keys in NAMES]
    out += [Rule(label, TEXT, 0.99, f"spdx {L} identifier (?:{tag})", ("spdx license identifier", "spdx licence identifier")) for label, tag in TAGS]
    out += [Rule(label, TEXT, 0.95, sentence, (key,)) for label, sentence, key in SENTENCES]
    out += [Rule(label, NOTICE, 0.9, f"{_GRANT} (?:{name})", keys) for label, name, keys in NAMES]
    out += [Rule(label, FIELD, 0.8, f"{_FIELD} (?:{name})", keys) for label, name, keys in NAMES]
    out += [Rule(label, FIELD, 0.85, f"(?:https? )?(?:www )?(?:{place})(?: html?| txt| php)?", (_literal(place),)) for label, place in ADDRESSES]
    return out + [Rule(label, NAME, 0.5, name, keys) for label, name, keys in NAMES]


def _literal(pattern: str) -> str:
    """The pattern's literal beginning, as far as its first bracket."""
    return pattern.split("(")[0].split("[")[0].rstrip()
