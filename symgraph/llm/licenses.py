"""License scans: ordered signature rules with keyword gates and containment suppression.

A text becomes its words (A-Z lower-cased; ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) with single spaces
between. Each rule is a regular expression over that, gated by keywords, derived from it, of which the
text must hold one, with a priority. A detection inside an interval that a detection of the same or a higher priority covers is
suppressed (of equal intervals with equal priority the first rule's stays); the labels of the others
remain. Base phrases are found at all their places, whatever the rules say.

Defined cases: null and empty texts have no words and no labels; texts are scanned whole, whatever
their length; repeated rows are scanned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

SPDX, EXACT, URL, GRANT, NAME = 5, 4, 3, 2, 1
CONFIDENCE = {SPDX: 1.0, EXACT: 0.95, URL: 0.9, GRANT: 0.8, NAME: 0.6}


#: Bytes of a keyword that are sought first.
START = 4


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    pattern: str


#: Families with versions: label, full names (alternatives part at ||), versions, path of its web address ({v} is the version).
VERSIONED = [
    ("gpl", r"(?:gnu )?general public licen[cs]e||gnu gpl", ["1.0", "2.0", "3.0"], r"gnu org licenses (?:old licenses )?gpl {v}"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e||gnu lgpl", ["2.0", "2.1", "3.0"], r"gnu org licenses (?:old licenses )?lgpl {v}"),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e||gnu agpl", ["1.0", "3.0"], r"gnu org licenses agpl {v}"),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e", ["1.1", "1.2", "1.3"], r"gnu org licenses (?:old licenses )?fdl {v}"),
    ("apache", r"apache (?:software )?licen[cs]e", ["1.0", "1.1", "2.0"], r"apache org licenses license {v}"),
    ("mpl", r"mozilla public licen[cs]e", ["1.0", "1.1", "2.0"], r"mozilla org (?:en us )?mpl {v}"),
    ("epl", r"eclipse public licen[cs]e", ["1.0", "2.0"], r"eclipse org (?:org )?(?:legal|documents) epl {v}"),
    ("cddl", r"common development and distribution licen[cs]e", ["1.0", "1.1"], r"opensource org licenses cddl {v}"),
    ("osl", r"open software licen[cs]e", ["1.0", "2.0", "2.1", "3.0"], r"opensource org licenses osl {v}"),
    ("afl", r"academic free licen[cs]e", ["1.1", "1.2", "2.0", "2.1", "3.0"], r"opensource org licenses afl {v}"),
    ("artistic", r"artistic licen[cs]e", ["1.0", "2.0"], r"opensource org licenses artistic {v}"),
    ("eupl", r"european union public licen[cs]e", ["1.0", "1.1", "1.2"], r"joinup ec europa eu licen[cs]e eupl {v}"),
    ("ecl", r"educational community licen[cs]e", ["1.0", "2.0"], r"opensource org licenses ecl {v}"),
    ("lppl", r"latex project public licen[cs]e", ["1.0", "1.1", "1.2", "1.3"], r"latex project org lppl lppl {v}"),
    ("zpl", r"zope public licen[cs]e", ["1.1", "2.0", "2.1"], r"opensource org licenses zpl {v}"),
    ("cpl", r"common public licen[cs]e", ["1.0"], r"opensource org licenses cpl {v}"),
    ("apsl", r"apple public source licen[cs]e", ["1.0", "1.1", "1.2", "2.0"], r"opensource apple com license apsl {v}"),
    ("ofl", r"(?:sil )?open font licen[cs]e", ["1.0", "1.1"], r"scripts sil org ofl {v}"),
    ("bsl", r"boost software licen[cs]e", ["1.0"], r"boost org license {v}"),
    ("busl", r"business source licen[cs]e", ["1.1"], r"mariadb com bsl {v}"),
    ("odc-by", r"open data commons attribution licen[cs]e", ["1.0"], r"opendatacommons org licenses by {v}"),
    ("odbl", r"open (?:data commons open )?database licen[cs]e", ["1.0"], r"opendatacommons org licenses odbl {v}"),
    ("cecill", r"cecill (?:free software )?licen[cs]e", ["1.0", "1.1", "2.0", "2.1"], r"cecill info licences licence cecill v{v}"),
]
#: Families without versions: label, its identifiers, names, path of its web address.
PLAIN = [
    ("mit", r"mit", r"mit licen[cs]e|expat licen[cs]e", r"opensource org licenses? mit"),
    ("mit-0", r"mit 0", r"mit no attribution", r"opensource org licenses? mit 0"),
    ("x11", r"x11", r"x11 licen[cs]e|x consortium licen[cs]e", r"x org licenses? x11"),
    ("isc", r"isc", r"isc licen[cs]e", r"opensource org licenses? isc"),
    ("0bsd", r"0bsd", r"zero clause bsd", r"opensource org licenses? 0bsd"),
    ("bsd-2-clause", r"bsd 2 clause", r"(?:2|two) clause bsd|simplified bsd|freebsd licen[cs]e", r"opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", r"bsd 3 clause", r"(?:3|three) clause bsd|(?:new|modified|revised) bsd", r"opensource org licenses? bsd 3 clause"),
    ("bsd-4-clause", r"bsd 4 clause", r"(?:4|four) clause bsd|original bsd", r"spdx org licenses bsd 4 clause"),
    ("bsd", r"bsd", r"bsd (?:style )?licen[cs]e|berkeley software distribution", r"opensource org licenses? bsd license"),
    ("zlib", r"zlib", r"zlib(?: libpng)? licen[cs]e", r"opensource org licenses? zlib"),
    ("unlicense", r"unlicense", r"the unlicen[cs]e", r"unlicense org"),
    ("wtfpl", r"wtfpl", r"do what the fuck you want to public licen[cs]e", r"wtfpl net"),
    ("ncsa", r"ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", r"opensource org licenses? ncsa"),
    ("postgresql", r"postgresql", r"postgresql licen[cs]e", r"opensource org licenses? postgresql"),
    ("python", r"psf 2 0|python 2 0", r"python software foundation licen[cs]e|python licen[cs]e", r"python org psf license"),
    ("php", r"php 3 0(?:1)?", r"php licen[cs]e", r"php net license"),
    ("ruby", r"ruby", r"ruby licen[cs]e", r"ruby lang org en about license"),
    ("openssl", r"openssl", r"openssl licen[cs]e", r"openssl org source license"),
    ("curl", r"curl", r"curl licen[cs]e", r"curl se docs copyright"),
    ("vim", r"vim", r"vim licen[cs]e", r"vimhelp org uganda"),
    ("beerware", r"beerware", r"beer ?ware licen[cs]e", r"people freebsd org phk"),
    ("public-domain", r"public domain", r"(?:in|into|to) the public domain", r"creativecommons org publicdomain mark 1 0"),
    ("cc0", r"cc0 1 0|cc0", r"cc0 1 0 universal|creative commons zero|cc0 licen[cs]e", r"creativecommons org publicdomain zero 1 0"),
    ("proprietary", r"licenseref proprietary", r"proprietary and confidential|confidential and proprietary|all rights reserved (?:unauthori[sz]ed|no part)", r"example com eula"),
]
_FREE = r"permission is hereby granted free of charge to any person"
_GNU = r"(?:this|[a-z0-9]+) (?:program|library|file|software) is free software you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by the free software foundation"
#: Sentences of the licenses' own texts and headers: label, pattern.
TEXTS = [
    ("mit", _FREE + r" obtaining a copy of this software and associated documentation files(?: the software)?(?: to deal in the software without restriction)?"),
    ("ncsa", _FREE + r" obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("bsl-1.0", _FREE + r" or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", r"(?:neither the names? of|the names? of) (?:[^ ]+ ){1,16}(?:may not|may) be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("apache-2.0", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", r"apache license version 2 0 january 2004"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:version |v ?)?2 0"),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:version |v ?)?1 0"),
    ("cddl-1.0", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license version 1 1"),
    ("artistic-2.0", r"the artistic license 2 0 copyright"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("x11", r"except as contained in this notice the names? of the x consortium shall not be used in advertising"),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|reproduction) of this (?:file|software) via any medium is strictly prohibited"),
    *[(f"{k}-{v}", _GNU.format(x) + rf" (?:either )?version {v[0]}(?: {v[2]})?(?: of the license)?") for k, x, vs in (("gpl", "", ("1.0", "2.0", "3.0")), ("lgpl", "(?:lesser|library) ", ("2.0", "2.1", "3.0")), ("agpl", "affero ", ("3.0",))) for v in vs],
]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
CC_TERMS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
CC_KINDS = ["by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"]

GRANTS = r"(?:licen[cs]ed|released|distributed|available|published) (?:to you )?under (?:the )?(?:terms of )?(?:the )?"
VERSION = r"(?: (?:licen[cs]e )?(?:version|v))? ?"


def _words(version: str) -> str:
    major, _, minor = version.partition(".")
    return rf"v?{major}(?: {minor})?" if minor == "0" else rf"v?{major} {minor}"


def _strings(tree, most: int = 16) -> list[str] | None:
    """All strings that a parsed pattern matches, if it has at most ``most``."""
    out = [""]
    for op, x in tree:
        if op is _parser.LITERAL:
            some = [chr(x)]
        elif op is _parser.IN and all(k is _parser.LITERAL for k, _ in x):
            some = [chr(c) for _, c in x]
        elif op is _parser.SUBPATTERN:
            some = _strings(x[3])
        elif op is _parser.BRANCH:
            parts = [_strings(t) for t in x[1]]
            some = None if None in parts else sum(parts, [])
        elif op is _parser.MAX_REPEAT and x[:2] == (0, 1):
            some = _strings(x[2])
            some = some and ["", *some]
        else:
            some = None
        if some is None or len(out) * len(some) > most:
            return None
        out = [a + b for a in out for b in some]
    return out


def _needed(tree) -> list[str]:
    """Strings of which whatever the parsed pattern matches holds at least one ([""]: none is known)."""
    runs, found = [""], []
    for item in tree:
        some = _strings([item])
        if some is not None and len(runs) * len(some) <= 16:
            runs = [a + b for a in runs for b in some]
            continue
        found.append(runs)
        runs = some or [""]
        if some is None and item[0] is _parser.SUBPATTERN:
            found.append(_needed(item[1][3]))
        elif some is None and item[0] is _parser.BRANCH:
            found.append([x for t in item[1][1] for x in _needed(t)])
    return max([*found, runs], key=lambda x: (min(min(map(len, x)), 6), -len(x)))


def keywords(rule: Rule) -> tuple[bytes, ...]:
    """The rule's gate, from its own pattern: it matches no text that holds none of these."""
    found = set(_needed(_parser.parse(f" (?:{rule.pattern}) ")))
    return tuple(sorted(x.encode() for x in found if not any(y in x for y in found - {x})))


def build_rules() -> list[Rule]:
    """All rules in their order. Families, versions and forms multiply to some hundred."""
    out = []
    for label, names, versions, url in VERSIONED:
        short, names = label.replace("-", " "), names.split("||")
        every = "|".join(names)
        for v in versions:
            w = _words(v)
            later = r"(?:(?: only)|(?: or (?:\(?at your option )?(?:any )?later(?: version)?))?"
            dotted = v.replace(".", " ")
            out.append(Rule(f"{label}-{v}", SPDX, rf"spdx licen[cs]e identifier {short} {dotted}(?: only| or later)?"))
            out.append(Rule(f"{label}-{v}", EXACT, rf"{short} ?{w}(?: only| or later)?"))
            out += [Rule(f"{label}-{v}", EXACT, rf"{x}{VERSION}{w}{later}") for x in names]
            out.append(Rule(f"{label}-{v}", URL, url.format(v=dotted)))
        out.append(Rule(label, GRANT, rf"{GRANTS}(?:{every}|{short})"))
        out += [Rule(label, NAME, x) for x in names]
    for label, ids, names, url in PLAIN:
        out.append(Rule(label, SPDX, rf"spdx licen[cs]e identifier (?:{ids})"))
        out.append(Rule(label, URL, url))
        out.append(Rule(label, GRANT, rf"{GRANTS}(?:{names}|(?:{ids}) licen[cs]e)"))
        out.append(Rule(label, NAME, rf"(?:{names})"))
    out += [Rule(label, EXACT, pattern) for label, pattern in TEXTS]
    for kind in CC_KINDS:
        label = "cc-" + kind.replace(" ", "-")
        full = " ".join(CC_TERMS[x] for x in kind.split())
        for v in CC_VERSIONS:
            w = _words(v)
            out.append(Rule(f"{label}-{v}", SPDX, rf"spdx licen[cs]e identifier cc {kind} {v.replace('.', ' ')}"))
            out.append(Rule(f"{label}-{v}", EXACT, rf"cc {kind}(?: licen[cs]e)? {w}"))
            out.append(Rule(f"{label}-{v}", EXACT, rf"creative commons {full}(?: licen[cs]e)? ?{w}(?: (?:international|unported|generic))?"))
            out.append(Rule(f"{label}-{v}", URL, rf"creativecommons org licenses {kind} {v.replace('.', ' ')}"))
        out.append(Rule(label, NAME, rf"creative commons {full}"))
        out.append(Rule(label, NAME, rf"cc {kind}"))
    return out


class Scanner:
    def __init__(self, rules: list[Rule] | None = None):
        rules = build_rules() if rules is None else rules
        self.by_keywords: dict[tuple[bytes, ...], list[tuple[Rule, int, re.Pattern]]] = {}
        for at, r in enumerate(rules):
            self.by_keywords.setdefault(keywords(r), []).append((r, at, re.compile(rf"(?<= )(?:{r.pattern})(?= )".encode())))
        #: The keywords by their first bytes, which are few: most texts fail these.
        self.by_starts: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = {}
        for words in self.by_keywords:
            self.by_starts.setdefault(tuple(sorted({w[:START] for w in words})), []).append(words)
        lower = bytearray(range(256))
        for c in range(256):
            if 65 <= c <= 90:
                lower[c] = c + 32
            elif c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F:
                lower[c] = 32
        self.table = bytes(lower)

    def normalize(self, text: str) -> tuple[bytes, int]:
        """The words with a space before and after each, and their number."""
        words = text.encode("utf-8", "surrogatepass").translate(self.table).split(b" ")
        words = [w for w in words if w]
        return b" " + b" ".join(words) + b" ", len(words)

    def detections(self, norm: bytes) -> list[tuple[int, int, Rule]]:
        """What remains of all matches: (start, end, rule), byte offsets in ``norm``."""
        found = []
        for starts, gates in self.by_starts.items():
            if any(w in norm for w in starts):
                for words in gates:
                    if any(w in norm for w in words):
                        for r, at, pattern in self.by_keywords[words]:
                            found += [(m.start(), m.end(), -r.priority, at, r) for m in pattern.finditer(norm)]
        found.sort(key=lambda x: (x[0], -x[1], x[2], x[3]))
        reach: dict[int, int] = {}
        out = []
        for start, end, _, _, r in found:
            if all(to < end for p, to in reach.items() if p >= r.priority):
                out.append((start, end, r))
            reach[r.priority] = max(end, reach.get(r.priority, 0))
        # A longer interval that starts earlier was seen before; one of higher priority with the same
        # start and end sorts first; so nothing that covers a detection comes after it.
        return out

    def scan(self, text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
        norm, n = self.normalize(text)
        places, labels = [], set()
        for phrase, label in BASE.items():
            key = f" {phrase} ".encode()
            at = norm.find(key)
            while at >= 0:
                places.append(at)
                labels.add(label)
                at = norm.find(key, at + 1)
        found = self.detections(norm)
        score = max([0.6 * bool(places), *(CONFIDENCE[r.priority] for _, _, r in found)])
        first = last = None
        if places:
            first, last = norm.count(b" ", 0, min(places)), norm.count(b" ", 0, max(places))
        base = ",".join(sorted(labels))
        return n, len(places), first, last, base, ",".join(sorted(labels | {r.label for _, _, r in found})), score


_worker: dict = {}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = _worker.setdefault("scanner", None) or _worker.update(scanner=Scanner()) or _worker["scanner"]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    for b in batches:
        rows = [scanner.scan(t.as_py() or "") for t in b.column("text")]
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``; no shuffle."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op2_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
