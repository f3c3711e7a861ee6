"""Signature rules for license texts, in order: tags, grants and clauses, names, general mentions.

Patterns are matched against words (digits, a-z, letters outside ASCII) with one
space between, whole words only. They use groups, `?`, `|`, classes and counted
repeats alone, so that any regex engine reads them alike. A rule has keywords, of
which each of its matches holds one at least as a word.
"""

from __future__ import annotations

from dataclasses import dataclass

TAG, GRANT, NAME, MENTION = range(4)
WEIGHTS = (1.0, 0.9, 0.6, 0.3)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    weight: float
    keywords: tuple[str, ...]
    pattern: str
    base: bool = False


LICENSE = "licen[cs]es?"
VERSION = "(?:v ?|ver |version )?"

# The phrases every scan reports, with their labels.
BASE = (
    ("under the mit license", "mit", "mit"),
    ("apache license version 2", "apache-2", "apache"),
    ("cc by nc", "cc-by-nc", "cc"),
)

# Licenses without versions; label, keywords, words of the tag, name.
SINGLE = (
    ("mit", "mit expat", "mit", "(?:mit|expat|mit x11) LICENSE"),
    ("mit-0", "mit", "mit 0", "mit no attribution(?: LICENSE)?"),
    ("isc", "isc", "isc", "isc LICENSE"),
    ("x11", "x11", "x11", "x11 LICENSE"),
    ("0bsd", "0bsd bsd", "0bsd", "(?:0bsd|zero clause bsd)(?: LICENSE)?"),
    ("bsd-2-clause", "bsd freebsd", "bsd 2 clause", "(?:bsd 2 clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: LICENSE)?"),
    ("bsd-3-clause", "bsd", "bsd 3 clause", "(?:bsd 3 clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?: LICENSE)?"),
    ("bsd-4-clause", "bsd", "bsd 4 clause", "(?:bsd 4 clause|(?:4|four) clause bsd|(?:original|old) bsd)(?: LICENSE)?"),
    ("bsd", "bsd", "bsd", "bsd(?: style| type)? LICENSE"),
    ("zlib", "zlib libpng", "zlib", "(?:zlib|zlib libpng|libpng) LICENSE"),
    ("bsl-1.0", "boost bsl", "bsl 1 0", "boost software LICENSE(?: VERSION1(?: 0)?)?"),
    ("unlicense", "unlicense", "unlicense", "(?:the unlicense|unlicense org)"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("postgresql", "postgresql", "postgresql", "postgresql LICENSE"),
    ("psf-2.0", "python psf", "psf 2 0", "(?:python software foundation|psf|python) LICENSE(?: VERSION2(?: 0)?)?"),
    ("ruby", "ruby", "ruby", "ruby LICENSE"),
    ("openssl", "openssl ssleay", "openssl", "(?:openssl|ssleay) LICENSE"),
    ("ofl-1.1", "ofl sil font", "ofl 1 1", "(?:sil )?(?:open font|ofl) LICENSE(?: VERSION1 1)?"),
    ("ncsa", "ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? LICENSE"),
    ("ms-pl", "microsoft ms", "ms pl", "(?:microsoft public LICENSE|ms pl)"),
    ("ms-rl", "microsoft ms", "ms rl", "(?:microsoft reciprocal LICENSE|ms rl)"),
    ("vim", "vim", "vim", "vim LICENSE"),
    ("w3c", "w3c", "w3c", "w3c (?:software )?(?:notice and )?(?:document )?LICENSE"),
    ("upl-1.0", "upl universal", "upl 1 0", "(?:universal permissive|upl) LICENSE(?: VERSION1(?: 0)?)?"),
    ("sleepycat", "sleepycat", "sleepycat", "sleepycat LICENSE"),
    ("curl", "curl", "curl", "curl LICENSE"),
    ("beerware", "beerware beer", "beerware", "(?:beerware|beer ware) LICENSE"),
    ("json", "json", "json", "json LICENSE"),
    ("cecill-b", "cecill", "cecill b", "cecill b"),
    ("cecill-c", "cecill", "cecill c", "cecill c"),
    ("cc0-1.0", "cc0", "cc0 1 0", "cc0(?: 1 0)?(?: universal)?"),
    ("pddl-1.0", "pddl dedication", "pddl 1 0", "(?:pddl|public domain dedication and LICENSE)(?: 1 0)?"),
    ("odc-by-1.0", "odc", "odc by 1 0", "odc by(?: 1 0)?"),
)

# Licenses with versions; stem and short name, a word of every long name, long name, versions.
VERSIONED = (
    ("apache", "apache", "apache(?: software)? LICENSE", "1.0 1.1 2.0"),
    ("gpl", "general", "(?:gnu )?general public LICENSE", "1.0 2.0 3.0"),
    ("lgpl", "general", "(?:gnu )?(?:lesser|library) general public LICENSE", "2.0 2.1 3.0"),
    ("agpl", "affero", "(?:gnu )?affero general public LICENSE", "1.0 3.0"),
    ("gfdl", "documentation", "(?:gnu )?free documentation LICENSE", "1.1 1.2 1.3"),
    ("mpl", "mozilla", "mozilla public LICENSE", "1.0 1.1 2.0"),
    ("epl", "eclipse", "eclipse public LICENSE", "1.0 2.0"),
    ("eupl", "european", "european union public LICENSE", "1.0 1.1 1.2"),
    ("cddl", "development", "common development and distribution LICENSE", "1.0 1.1"),
    ("cpl", "common", "common public LICENSE", "1.0"),
    ("osl", "open", "open software LICENSE", "1.0 2.0 2.1 3.0"),
    ("afl", "academic", "academic free LICENSE", "1.1 2.0 2.1 3.0"),
    ("artistic", "artistic", "artistic LICENSE", "1.0 2.0"),
    ("php", "php", "php LICENSE", "3.0 3.01"),
    ("zpl", "zope", "zope public LICENSE", "1.1 2.0 2.1"),
    ("lppl", "latex", "latex project public LICENSE", "1.0 1.2 1.3c"),
    ("odbl", "database", "open (?:data commons open )?database LICENSE", "1.0"),
    ("sspl", "server", "server side public LICENSE", "1.0"),
    ("busl", "business", "business source LICENSE", "1.1"),
    ("elastic", "elastic", "elastic LICENSE", "2.0"),
    ("qpl", "public", "q public LICENSE", "1.0"),
    ("cecill", "cecill", "cecill(?: free software)? LICENSE(?: agreement)?", "1.0 2.0 2.1"),
)
#: Stems whose notices often allow later versions too.
LATER = ("gpl", "lgpl", "agpl", "gfdl")
CC_PARTS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
CC_LONG = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial"}

# Sentences that license texts begin with or are known by; label, keyword, pattern.
CLAUSES = (
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "neither the name of (?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public LICENSE"),
    ("lgpl", "redistribute", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public LICENSE"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the LICENSE"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public LICENSE v 2 0"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unencumbered", "free and unencumbered software"),
    ("bsl-1.0", "boost", "distributed under the boost software LICENSE"),
    ("cc0-1.0", "waived", "(?:has|have) waived all copyright and related or neighboring rights"),
    ("public-domain", "domain", "(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
    ("public-domain", "domain", "(?:is|are) in the public domain"),
    ("proprietary", "confidential", "(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|distribution|use)(?: of this (?:file|software|document|work))?"),
)

# Mentions that name no license.
MENTIONS = (
    ("all-rights-reserved", "reserved", "all rights reserved"),
    ("unnamed-license", "licensed released distributed published", "(?:licensed|released|distributed|published) under (?:[^ ]+ ){1,5}?LICENSE"),
    ("unnamed-license", "license licence licenses licences", "see the (?:accompanying )?(?:LICENSE|licen[cs]e) file"),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"),
)

TERMS = "(?:under|by|subject to|pursuant to|per)(?: the)?(?: terms)?(?: and conditions)?(?: of)?(?: the| an?)?"
LINKS = "(?:opensource org LICENSE|spdx org LICENSE|choosealicense com LICENSE|www gnu org LICENSE|gnu org LICENSE)"


def _filled(pattern: str) -> str:
    return pattern.replace("VERSION", VERSION).replace("LICENSE", LICENSE)


def _forms(label: str, keywords: tuple[str, ...], tag: str, name: str) -> list[Rule]:
    """The tag, grant, link and name rules of one license."""
    made = (
        ("tag", TAG, f"spdx LICENSE identifier {tag}"),
        ("grant", GRANT, f"{TERMS} {name}"),
        ("link", GRANT, f"{LINKS} {tag}"),
        ("name", NAME, name),
    )
    return [Rule(f"{label}:{form}", label, rank, WEIGHTS[rank], keywords, _filled(pattern)) for form, rank, pattern in made]


def _number(version: str) -> str:
    return (version.removesuffix(".0") + "(?: 0)?" if version.endswith(".0") else version).replace(".", " ")


def _versions() -> list[Rule]:
    out = []
    for stem, word, long, versions in VERSIONED:
        keywords = tuple(dict.fromkeys((stem, word, *(f"{stem}v{v[0]}" for v in versions.split()), *(f"{stem}{v[0]}" for v in versions.split()))))
        for version in versions.split():
            tag = f"{stem} {version.replace('.', ' ')}"
            number = _number(version)
            name = f"(?:{stem} (?:LICENSE )?VERSION{number}|{stem}v?{number}|{long} VERSION{number})"
            out += _forms(f"{stem}-{version}", keywords, f"{tag}(?: only)?", name)
            if stem in LATER:
                out += _forms(f"{stem}-{version}-or-later", keywords, f"{tag} or later", f"{name}(?: of the LICENSE)? or(?: at your option)?(?: any)? later")
    return out


def _creative() -> list[Rule]:
    out = []
    for parts in CC_PARTS:
        long = " ".join(CC_LONG[p] for p in parts.split())
        for version in CC_VERSIONS:
            number = _number(version)
            name = f"(?:cc {parts} VERSION{number}|creative commons {long}(?: LICENSE)? VERSION{number})"
            out += _forms(f"cc-{parts.replace(' ', '-')}-{version}", ("cc", "creative"), f"cc {parts} {version.replace('.', ' ')}", name)
        out.append(Rule(f"cc-{parts.replace(' ', '-')}:name", f"cc-{parts.replace(' ', '-')}", NAME, WEIGHTS[NAME], ("cc", "creative"), _filled(f"(?:cc {parts}|creative commons {long})")))
    return out


def rules() -> list[Rule]:
    """Every rule, base phrases first; a rule's place is its order among rules of equal priority."""
    out = [Rule(f"{label}:base", label, TAG, WEIGHTS[TAG], (keyword,), phrase, True) for phrase, label, keyword in BASE]
    for label, keywords, tag, name in SINGLE:
        out += _forms(label, tuple(keywords.split()), tag, name)
    out += _versions() + _creative()
    for kind, rank, table in (("clause", GRANT, CLAUSES), ("mention", MENTION, MENTIONS)):
        out += [Rule(f"{label}:{kind}{k}", label, rank, WEIGHTS[rank], tuple(keywords.split()), _filled(pattern)) for k, (label, keywords, pattern) in enumerate(table)]
    return out
