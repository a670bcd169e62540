"""Signature rules of the licence scan.

A rule is (label, priority, keyword, pattern).  Patterns are matched on a text's words, lower-cased and joined by single
spaces, from word start to word end; the keyword, which each match contains at a word's start, decides whether the
pattern is tried.
Priority 1: an exact licence with its version; 2: a licence by name; 3: a hint (notices and references).
"""

from __future__ import annotations

V = r"(?:version |v |v)?"
THE = r"(?:the )?"
OR_LATER = r"(?: (?:or (?:\S+ )?(?:any )?later(?: version)?|and later|or newer))"


def _num(version: str) -> str:
    """'2.0' as words: '2 0', and '2' alone where the rest is zero."""
    major, _, minor = version.partition(".")
    return f"{major} {minor}" if minor and minor != "0" else f"{major}(?: 0)?"


def _creative_commons() -> list:
    parts = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative|ativ)?s?(?: works)?"}
    rules = []
    for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        short = kind.replace("-", " ")
        full = " ".join(parts[k] for k in kind.split("-"))
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            rules.append((f"cc-{kind}-{version}", 1, "cc by", f"cc {short} {_num(version)}(?: (?:international|unported|generic))?"))
            rules.append((f"cc-{kind}-{version}", 1, "creative commons", f"creative commons {full} {_num(version)}(?: (?:international|unported|generic))?(?: (?:public )?licen[cs]e)?"))
            rules.append((f"cc-{kind}-{version}", 1, "creativecommons", f"creativecommons org licenses {short} {_num(version)}"))
        rules.append((f"cc-{kind}", 2, "cc by", f"cc {short}(?: licen[cs]e)?"))
        rules.append((f"cc-{kind}", 2, "creative commons", f"creative commons {full}(?: (?:public )?licen[cs]e)?"))
    return rules


def _gnu() -> list:
    rules = []
    families = {
        "gpl": ("general public", "gpl", ("1.0", "2.0", "3.0")),
        "lgpl": ("(?:lesser|library) general public", "lgpl", ("2.0", "2.1", "3.0")),
        "agpl": ("affero general public", "agpl", ("1.0", "3.0")),
        "gfdl": ("free documentation", "gfdl", ("1.1", "1.2", "1.3")),
    }
    for label, (words, short, versions) in families.items():
        full = f"(?:gnu )?{words} licen[cs]e"
        key = "free documentation" if label == "gfdl" else "general public"
        for version in versions:
            n = _num(version)
            rules.append((f"{label}-{version}-or-later", 1, key, f"{full}(?: \\(?{short}\\)?)? {V}{n}{OR_LATER}"))
            rules.append((f"{label}-{version}", 1, key, f"{full}(?: {short})? {V}{n}"))
            rules.append((f"{label}-{version}", 1, key, f"version {n} of {THE}{full}"))
            rules.append((f"{label}-{version}-or-later", 1, short, f"(?:gnu )?{short} ?{V}{n}{OR_LATER}"))
            rules.append((f"{label}-{version}", 1, short, f"(?:gnu )?{short} ?{V}{n}"))
        rules.append((label, 2, key, full))
        rules.append((label, 2, short, f"gnu {short}|{short} licen[cs]ed?|licen[cs]ed? under {THE}{short}"))
    return rules


def _versioned() -> list:
    """Names with their versions: label, words, short form ('' if it is a common word), versions."""
    families = [
        ("apache", "apache (?:software )?licen[cs]e", "apache", ("1.0", "1.1", "2.0")),
        ("mpl", "mozilla public licen[cs]e", "mpl", ("1.0", "1.1", "2.0")),
        ("epl", "eclipse public licen[cs]e", "epl", ("1.0", "2.0")),
        ("cddl", "common development and distribution licen[cs]e", "cddl", ("1.0", "1.1")),
        ("eupl", "european union public licen[cs]e", "eupl", ("1.0", "1.1", "1.2")),
        ("afl", "academic free licen[cs]e", "afl", ("1.1", "1.2", "2.0", "2.1", "3.0")),
        ("osl", "open software licen[cs]e", "osl", ("1.0", "2.0", "2.1", "3.0")),
        ("artistic", "artistic licen[cs]e", "", ("1.0", "2.0")),
        ("bsl", "boost software licen[cs]e", "", ("1.0",)),
        ("cecill", "cecill(?: free software)? licen[cs]e(?: agreement)?", "cecill", ("1.0", "1.1", "2.0", "2.1")),
        ("cpl", "common public licen[cs]e", "cpl", ("1.0",)),
        ("ecl", "educational community licen[cs]e", "ecl", ("1.0", "2.0")),
        ("lppl", "latex project public licen[cs]e", "lppl", ("1.0", "1.1", "1.2", "1.3")),
        ("ofl", "sil open font licen[cs]e", "ofl", ("1.0", "1.1")),
        ("php", "php licen[cs]e", "", ("3.0", "3.1")),
        ("python", "python software foundation licen[cs]e", "psf", ("2.0",)),
        ("zpl", "zope public licen[cs]e", "zpl", ("1.1", "2.0", "2.1")),
        ("qpl", "q public licen[cs]e", "qpl", ("1.0",)),
        ("odbl", "open database licen[cs]e", "odbl", ("1.0",)),
        ("odc-by", "open data commons attribution licen[cs]e", "", ("1.0",)),
        ("nposl", "non profit open software licen[cs]e", "", ("3.0",)),
        ("ogl", "open government licen[cs]e", "", ("1.0", "2.0", "3.0")),
        ("busl", "business source licen[cs]e", "busl", ("1.1",)),
        ("sspl", "server side public licen[cs]e", "sspl", ("1.0",)),
        ("elastic", "elastic licen[cs]e", "", ("1.0", "2.0")),
    ]
    rules = []
    for label, words, short, versions in families:
        key = words.split("(")[0].split(" licen")[0].split(" ")[0] if not words.startswith("q ") else "q public"
        for version in versions:
            rules.append((f"{label}-{version}", 1, key, f"{words} {V}{_num(version)}"))
            if short:
                rules.append((f"{label}-{version}", 1, short, f"{short} {V}{_num(version)}"))
        rules.append((label, 2, key, words))
        if short:
            rules.append((label, 2, short, f"{short} licen[cs]ed?|licen[cs]ed? under {THE}{short}"))
    return rules


#: Licences without versions, by their names and by sentences of their texts.
SIGNATURES = [
    ("mit", 2, "mit license", "(?:the )?mit license"),
    ("mit", 2, "mit licence", "(?:the )?mit licence"),
    ("mit", 2, "expat", "expat licen[cs]e"),
    ("mit", 1, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-0", 1, "mit no attribution", "mit no attribution(?: licen[cs]e)?"),
    ("isc", 2, "isc licen", "isc licen[cs]e"),
    ("isc", 1, "permission to use copy modify", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-2-clause", 1, "bsd", "(?:2|two) clause bsd(?: licen[cs]e)?|bsd (?:2|two) clause(?: licen[cs]e)?|simplified bsd licen[cs]e"),
    ("bsd-2-clause", 1, "freebsd licen", "freebsd licen[cs]e"),
    ("bsd-3-clause", 1, "bsd", "(?:3|three) clause bsd(?: licen[cs]e)?|bsd (?:3|three) clause(?: licen[cs]e)?|(?:new|modified|revised) bsd licen[cs]e"),
    ("bsd-4-clause", 1, "bsd", "(?:4|four) clause bsd(?: licen[cs]e)?|bsd (?:4|four) clause(?: licen[cs]e)?|original bsd licen[cs]e"),
    ("0bsd", 1, "bsd", "(?:0|zero) clause bsd(?: licen[cs]e)?|bsd (?:0|zero) clause(?: licen[cs]e)?"),
    ("0bsd", 1, "0bsd", "0bsd"),
    ("bsd", 2, "bsd", "bsd (?:style )?licen[cs]e"),
    ("bsd", 1, "redistribution and use in source", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 1, "endorse or promote", r"neither the names? of (?:\S+ ){1,12}may be used to endorse or promote products"),
    ("cc0-1.0", 1, "cc0", "cc0(?: 1(?: 0)?)?(?: universal)?(?: licen[cs]e)?"),
    ("cc0-1.0", 1, "creative commons", "creative commons zero(?: v?1(?: 0)?)?(?: universal)?"),
    ("creative-commons", 3, "creative commons", "creative commons(?: licen[cs]es?)?"),
    ("unlicense", 1, "unlicense", "(?:the )?unlicense"),
    ("unlicense", 1, "released into the public domain", "free and unencumbered software released into the public domain"),
    ("public-domain", 2, "public domain", "(?:released |placed |dedicated )?(?:in|into|to) the public domain|public domain dedication"),
    ("public-domain", 3, "public domain", "public domain"),
    ("wtfpl", 1, "wtfpl", "wtfpl"),
    ("wtfpl", 1, "do what the", r"do what the \S+ you want to public licen[cs]e"),
    ("zlib", 2, "zlib licen", "(?:the )?zlib licen[cs]e"),
    ("zlib", 2, "zlib libpng", "(?:the )?zlib libpng licen[cs]e"),
    ("zlib", 1, "in no event will the authors", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("libpng", 2, "libpng licen", "libpng licen[cs]e"),
    ("openssl", 2, "openssl licen", "openssl licen[cs]e"),
    ("json", 1, "used for good", "(?:the )?software shall be used for good not evil"),
    ("beerware", 1, "beer", "beer ?ware licen[cs]e(?: revision 42)?"),
    ("vim", 2, "vim licen", "vim licen[cs]e"),
    ("ruby", 2, "ruby licen", "(?:the )?ruby licen[cs]e"),
    ("perl", 2, "perl", "same terms as perl(?: itself)?|perl licen[cs]e"),
    ("postgresql", 2, "postgresql licen", "postgresql licen[cs]e"),
    ("ncsa", 2, "ncsa", "(?:university of illinois )?ncsa open source licen[cs]e"),
    ("mulan", 1, "mulan", "mulan (?:psl|permissive software licen[cs]e)(?: v?[12])?"),
    ("blueoak-1.0.0", 1, "blue oak", "blue oak model licen[cs]e(?: 1(?: 0 0)?)?"),
    ("x11", 2, "x11", "x11 licen[cs]e"),
    ("ms-pl", 1, "microsoft", "microsoft public licen[cs]e"),
    ("ms-pl", 1, "ms pl", "ms pl"),
    ("ms-rl", 1, "microsoft", "microsoft reciprocal licen[cs]e"),
    ("ms-rl", 1, "ms rl", "ms rl"),
    ("apache-2.0", 1, "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance"),
    ("apache-2.0", 1, "apache org licenses", "(?:www )?apache org licenses license 2 0"),
    ("gpl", 1, "free software you can redistribute", r"free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", 3, "gnu org", "(?:www )?gnu org (?:licenses|copyleft)(?: gpl)?"),
    ("copyleft", 3, "copyleft", "copyleft"),
    ("mit", 3, "opensource org", "opensource org licenses mit"),
    ("bsd", 3, "opensource org", r"opensource org licenses bsd(?: \d clause)?"),
    ("open-source", 3, "open source", "open source licen[cs]e"),
    ("proprietary", 2, "proprietary", "proprietary and confidential|confidential and proprietary|proprietary licen[cs]e"),
    ("proprietary", 2, "unauthorized", "unauthorized (?:copying|reproduction|use|distribution)(?: \\S+){0,8} (?:is )?(?:strictly )?prohibited"),
    ("proprietary", 2, "without the prior", "without the prior (?:written )?(?:permission|consent)"),
    ("proprietary", 2, "no part of this", "no part of this (?:publication|work|document|book|website|site) may be (?:reproduced|copied|distributed)"),
    ("eula", 2, "end user licen", "end user licen[cs]e agreement"),
    ("non-commercial", 3, "commercial use", "(?:for )?non commercial use(?: only)?|no commercial use"),
    ("copyright", 3, "copyright", r"copyright(?: c)?(?: \d{4}){1,2}(?: (?:by|present))?"),
    ("copyright", 3, "copyright", "copyright(?: holders?| notice| owners?)?"),
    ("copyright", 3, "©", r"©(?: \d{4}){0,2}"),
    ("licensed", 3, "licensed under", r"(?:is )?licensed under(?: the)?"),
    ("licensed", 3, "released under", r"(?:is )?released under(?: the)?"),
    ("licensed", 3, "distributed under", r"(?:is )?distributed under(?: the)?(?: terms)?"),
    ("licensed", 3, "terms of the", r"under the terms of the \S+ licen[cs]e"),
    ("no-warranty", 3, "without warrant", "without warrant(?:y|ies) of any kind"),
    ("no-warranty", 3, "as is", "provided as is|on an as is basis"),
    ("lizenz", 3, "lizenziert", "lizenziert unter(?: der| den| dem)?"),
    ("reserved", 2, "rechte vorbehalten", "alle rechte vorbehalten"),
    ("licence-fr", 3, "sous licence", "(?:publié |distribué |mis à disposition )?sous licence"),
    ("licence-fr", 3, "sous la licence", "(?:publié |distribué |mis à disposition )?sous la licence"),
    ("reserved", 2, "droits", "tous droits réservés"),
    ("licencia", 3, "licencia", "(?:publicado |distribuido )?bajo (?:la |una )?licencia"),
    ("reserved", 2, "derechos", "todos los derechos reservados"),
    ("public-domain", 2, "dominio público", "(?:de )?dominio público"),
    ("public-domain", 2, "domaine public", "(?:dans le )?domaine public"),
    ("public-domain", 2, "gemeinfrei", "gemeinfrei"),
    ("etalab-2.0", 1, "licence ouverte", "licence ouverte(?: etalab)?(?: (?:version )?2(?: 0)?)?"),
    ("reserved", 2, "all rights reserved", "all rights reserved"),
]


def _spdx() -> list:
    """The identifier lines of source files, for the usual identifiers."""
    usual = ["mit", "isc", "apache 2 0", "bsd 2 clause", "bsd 3 clause", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later",
             "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0 only", "agpl 3 0 only", "mpl 2 0", "epl 2 0", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "unlicense", "0bsd", "zlib", "bsl 1 0"]
    rules = [("spdx-" + words.replace(" ", "-"), 1, "spdx", f"spdx license identifier {words}") for words in usual]
    return [*rules, ("spdx", 3, "spdx", r"spdx license identifier \S+")]


def rules() -> list[tuple[str, int, str, str]]:
    """All rules in order; of equal claims the earlier rule stands."""
    return [*_spdx(), *_creative_commons(), *_gnu(), *_versioned(), *SIGNATURES]
