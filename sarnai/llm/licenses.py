"""License scan by conditional compression.

A candidate block is a sentence, of a line or of a paragraph, that holds three neighbouring words of a template, or a cue word. A paragraph is
neighbouring lines, without their comment marks, up to a line that holds no word; so a notice may be wrapped or stand on a line without a full stop
among others. A block is compressed alone and with each template as zstandard raw dictionary; the templates are ranked by the share of the size that the dictionary saves. The
first ``RANKED`` are then compared word by word, and the one with the fewest differences (of several, the longest) is confirmed if these
are at most ``MOST_DIFFERENT`` of the template's words and none of them is a number or a word that names a license (``NAMING``), also among the
``AFTER`` words that follow the match; the exact differences are reported. So versions and variants of one license, which share
their wording, part on the words that differ.

Longer blocks are also read in overlapping windows of the ``WINDOWS`` sizes, for long and short templates, so a notice inside an endless line
is still met whole. Where matches overlap, the one with the smallest share of differing words stays, then that with
the most words, then a whole sentence, then the shortest block; so a notice is reported once. The clauses of BSD licenses are alike but
for the third: a notice of them becomes BSD-3-Clause, or Apache-1.1, if a clause that only those have follows within ``NEAR`` characters.

Null and empty texts have no block. Rows without an id are scanned like others, repeated rows give repeated notices, an empty table gives
none, and other columns are not read.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from functools import lru_cache

import ahocorasick
import zstandard as zstd
from pyspark.sql import DataFrame

from sarnai.llm.common import map_columns


def _gnu() -> dict[str, list[str]]:
    """Headers, short forms and titles of the GNU licenses, which differ in name and version only."""
    made: dict[str, list[str]] = {}
    for short, name, version, dated, things in (
        ("GPL", "General", "2", "June 1991", ("program", "file", "software")), ("GPL", "General", "3", "29 June 2007", ("program", "file", "software")),
        ("LGPL", "Library General", "2", "June 1991", ("library",)), ("LGPL", "Lesser General", "2.1", "February 1999", ("library", "program")),
        ("LGPL", "Lesser General", "3", "29 June 2007", ("library", "program")), ("AGPL", "Affero General", "3", "19 November 2007", ("program", "file")),
    ):
        full, spdx = f"GNU {name} Public License", f"{short}-{version if '.' in version else version + '.0'}"
        only, later = made.setdefault(f"{spdx}-only", []), made.setdefault(f"{spdx}-or-later", [])
        for thing in things:
            start = f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the {full}"
            only.append(f"{start} version {version} as published by the Free Software Foundation.")
            later.append(f"{start} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.")
        only.append(f"This work is licensed under the {full}, version {version}.")
        later += [f"This work is licensed under the {full}, version {version} {tail}." for tail in ("or any later version", "or (at your option) any later version", "or later")]
        made.setdefault(spdx, []).append(f"{full} Version {version}, {dated}")
    return made


def _creative_commons() -> dict[str, list[str]]:
    made = {}
    for code in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for version, kind, derived in (("3.0", "Unported", "NoDerivs"), ("4.0", "International", "NoDerivatives")):
            long = "-".join({"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": derived}[c] for c in code.split("-"))
            made[f"CC-{code}-{version}"] = [
                f"Licensed under CC {code} {version}.", f"This work is licensed under a Creative Commons {long} {version} {kind} License.", f"Creative Commons {long} {version} {kind}",
            ]
    return made


def _named() -> dict[str, list[str]]:
    """Short notices that only name a license."""
    names = {
        "MIT": "MIT", "ISC": "ISC", "BSD-2-Clause": "BSD 2-Clause", "BSD-3-Clause": "BSD 3-Clause", "Zlib": "zlib", "BSL-1.0": "Boost Software", "Artistic-1.0": "Artistic License 1.0",
        "Artistic-2.0": "Artistic License 2.0", "Artistic": "Artistic", "Apache-1.0": "Apache License, Version 1.0", "Apache-1.1": "Apache License, Version 1.1",
        "Apache-2.0": "Apache License, Version 2.0", "MPL-1.1": "Mozilla Public License, Version 1.1", "MPL-2.0": "Mozilla Public License, Version 2.0",
        "EPL-1.0": "Eclipse Public License, Version 1.0", "EPL-2.0": "Eclipse Public License, Version 2.0", "Unlicense": "Unlicense",
    }
    return {k: [f"{verb} under the {n if 'License' in n or n == 'Unlicense' else n + ' License'}." for verb in ("Released", "Licensed")] for k, n in names.items()}


# Sentences of public license texts.
DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY {} ''AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
LIABILITY = "IN NO EVENT SHALL {} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
HOLDERS = "THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
TEXTS = {
    "Apache-1.1": [
        "The end-user documentation included with the redistribution, if any, must include the following acknowledgment:",
        "Products derived from this software may not be called \"Apache\", nor may \"Apache\" appear in their name, without prior written permission of the Apache Software Foundation.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Apache License Version 2.0, January 2004",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        DISCLAIMER.format(HOLDERS),
        LIABILITY.format("THE COPYRIGHT OWNER OR CONTRIBUTORS"),
    ],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "CC0-1.0": ["Released into the public domain under CC0 1.0.", "CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-1.1": [
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ],
}
TEMPLATES: dict[str, list[str]] = {}
for _made in (_gnu(), _creative_commons(), _named(), TEXTS):
    for _name, _texts in _made.items():
        TEMPLATES.setdefault(_name, []).extend(t for t in _texts if t not in TEMPLATES.get(_name, []))
# Words that tell licenses, or grants under one, apart.
NAMING = frozenset(
    "affero apache artistic attribution boost bsd by cc cc0 clause commercial creative eclipse gnu gpl international isc later lesser lgpl library mit mozilla mpl "
    "nc nd noncommercial noderivatives noderivs only sa sharealike unlicense unported zlib".split()
)
AFTER, NEAR = 4, 2500
# Words of a cue may be parted by a line end and comment marks.
_GAP = r"\W+(?:(?:dnl|rem)\s+)?"
CUE = rf"(?i)licen[sc]e|permission{_GAP}(?:is|to)|redistribution{_GAP}and{_GAP}use|public{_GAP}domain|\bCC0?[ -]?(?:BY|1\.0)"
# RANKED: above the number of headers of the GNU licenses, which share nearly all of their words.
RANKED, MOST_DIFFERENT, LEAST_SAVED = 28, 0.25, 0.1
BLOCK = 1200  # characters
WINDOWS = (1200, 400, 160)  # each step is half a window; the longest template has under 600 characters
COLUMNS = "doc_id long, start long, length long, license string, template long, saved double, n_different long, exact boolean, differences string"
# Neither 'v. 2.0' nor the colon of the GPL-3.0 header ends a sentence.
_SENTENCE = re.compile(r"[^\n]*?(?:(?:(?<!\b[vV])\.|(?<!free software):|[!?])(?=\s)|(?=\n)|\Z)")
_WORD = re.compile(r"\w+(?:[.\-/]\w+)*")
_CUE = re.compile(CUE)
_MARK = re.compile(r"(?i)\s*(?:(?:[*#/;%!|>+~='\"-]+|<!--|\(\*|\.\\\"|(?:dnl|rem|@c)(?=\s))\s*)*")
_END = re.compile(r"(?:\s|[*#/|]|-->)*\Z")


def _lines(text: str, begin: int, end: int) -> list[tuple[int, str]]:
    """(start, text) of the lines of text[begin:end] without comment marks."""
    out = []
    for line in text[begin:end].split("\n"):
        skip = _MARK.match(line).end()
        out.append((begin + skip, line[skip : max(skip, _END.search(line).start())]))
        begin += len(line) + 1
    return out


def _paragraph(text: str, begin: int, end: int) -> tuple[int, int]:
    """The range of whole lines around text[begin:end], up to lines that hold no word."""
    begin = text.rfind("\n", 0, begin) + 1
    while begin and _WORD.search(text, above := text.rfind("\n", 0, begin - 1) + 1, begin):
        begin = above
    end = text.find("\n", end)
    while end >= 0:
        below = text.find("\n", end + 1)
        if not _WORD.search(text, end, len(text) if below < 0 else below):
            break
        end = below
    return begin, len(text) if end < 0 else end


@lru_cache(1)
def _phrases() -> ahocorasick.Automaton:
    """Three neighbouring words of a template, as they stand in it, in small letters."""
    made = ahocorasick.Automaton()
    for texts in TEMPLATES.values():
        for t in texts:
            words = t.lower().split()
            for i in range(len(words) - 2):
                made.add_word(phrase := " ".join(words[i : i + 3]), len(phrase))
    made.make_automaton()
    return made


def _lower(text: str) -> str:
    """Small letters, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(d := c.lower()) != 1 else d for c in text)


def _signs(text: str) -> list[tuple[int, int]]:
    """Where template phrases and cue words stand, in order."""
    return sorted([(end + 1 - n, end + 1) for end, n in _phrases().iter(_lower(text))] + [m.span() for m in _CUE.finditer(text)])


def _signed(text: str) -> bool:
    return next(_phrases().iter(_lower(text)), None) is not None or _CUE.search(text) is not None


def _sentences(text: str, begin: int, end: int) -> list[tuple[int, str, bool]]:
    """(start, text, whether a window) of sentences with a sign, and of the windows with a sign of long ones."""
    out = []
    for s in _SENTENCE.finditer(text, begin, end):
        block = s[0].strip()
        if not block or not _signed(block):
            continue
        at = s.start() + len(s[0]) - len(s[0].lstrip())
        if len(block) <= BLOCK:
            out.append((at, block, False))
        for size in WINDOWS:
            if len(block) > size:
                pieces = ((i, block[i : i + size]) for i in range(0, len(block) - size // 2, size // 2))
                out += [(at + i, piece, True) for i, piece in pieces if _signed(piece)]
    return out


def candidate_blocks(text: str) -> list[tuple[int, str, bool, list[tuple[int, int]]]]:
    """(start, text, whether a window, [(place in the block, place in the text) of each line]) of the blocks with a sign."""
    out, done = [], 0
    for first_sign, last_sign in _signs(text):
        if first_sign < done:
            continue
        begin, end = _paragraph(text, first_sign, last_sign)
        out += [(at, block, window, [(0, at)]) for at, block, window in _sentences(text, begin, end)]
        lines, at = _lines(text, begin, end), 0
        if len(lines) > 1:
            parts, begins = [line if re.search(r"\w-\Z", line) else line + " " for _, line in lines], []  # a word wrapped at its hyphen
            for part in parts:
                begins.append(at)
                at += len(part)
            joined = "".join(parts).rstrip()
            for at, block, window in _sentences(joined, 0, len(joined)):
                first, last = bisect_right(begins, at) - 1, bisect_right(begins, at + len(block) - 1) - 1
                if first < last:  # else it is a sentence of one line
                    places = [(max(0, b - at), o + max(0, at - b)) for b, (o, _) in zip(begins[first : last + 1], lines[first : last + 1], strict=True)]
                    out.append((places[0][1], block, window, places))
        done = end
    return out


@lru_cache(1)
def _compressors() -> tuple:
    params = zstd.ZstdCompressionParameters.from_level(
        19, source_size=BLOCK, dict_size=1024, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    made = []
    for name, texts in TEMPLATES.items():
        for i, t in enumerate(texts):
            used = zstd.ZstdCompressionDict(t.lower().encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
            made.append((name, i, _WORD.findall(t.lower()), zstd.ZstdCompressor(dict_data=used, compression_params=params)))
    return zstd.ZstdCompressor(compression_params=params), made


def _naming(word: str) -> bool:
    return any(part in NAMING or part[:1].isdigit() for part in re.split(r"[-/]", word))


def differences(words: list[str], template: list[str]) -> tuple[int, str, int, int, bool]:
    """Words that differ, and how: -template +text; the range of words from the first equal one to the last; whether a differing word
    names a license. Text before and after the template's wording is no difference, but may name another."""
    ops = difflib.SequenceMatcher(None, template, words, autojunk=False).get_opcodes()
    n, out, naming = 0, [], False
    for k, (op, a, b, c, d) in enumerate(ops):
        if op == "equal":
            continue
        outer = k in (0, len(ops) - 1)
        if not (op == "insert" and outer):
            n += min(max(b - a, d - c), b - a) if outer else max(b - a, d - c)
            out.append(" ".join([*(f"-{w}" for w in template[a:b]), *(f"+{w}" for w in words[c:d])]))
            naming = naming or any(map(_naming, template[a:b])) or (not outer and any(map(_naming, words[c:d])))
    equal = [(c, d) for op, _, _, c, d in ops if op == "equal"] or [(0, len(words))]
    return n, "; ".join(out), equal[0][0], equal[-1][1], naming


def identify(block: str) -> tuple | None:
    """(license, template, share saved, words that differ, exact, differences, words of the template, begin and
    end of the match) of the confirmed winner."""
    plain, templates = _compressors()
    raw = block.lower().encode()
    alone = len(plain.compress(raw))
    ranked = sorted(((1 - len(c.compress(raw)) / alone, name, i, words) for name, i, words, c in templates), key=lambda r: (-r[0], r[1], r[2]))[:RANKED]
    met = list(_WORD.finditer(block))
    words, found = [m[0].lower() for m in met], None
    for saved, name, i, template in ranked:
        if saved < LEAST_SAVED:
            break
        n, how, first, last, naming = differences(words, template)
        naming = naming or any(map(_names_after, words[last : last + AFTER]))
        if n <= MOST_DIFFERENT * len(template) and not naming:
            row = (n, -len(template), -saved, name, i, how, first, last)
            found = row if found is None or row < found else found
    if found is None:
        return None
    n, size, saved, name, i, how, first, last = found
    return name, i, -saved, n, n == 0, how, -size, met[first].start(), met[last - 1].end()


def _names_after(word: str) -> bool:
    """Whether a word right after a match changes what was granted."""
    return word in ("later", "only") or bool({"nc", "nd", "sa"} & set(re.split(r"[-/]", word)))


def _place(places: list[tuple[int, int]], at: int) -> int:
    """Place in the text of a character of a block."""
    here, there = places[bisect_right(places, at, key=lambda p: p[0]) - 1]
    return there + at - here


def notices(text: str, known: dict) -> list[tuple]:
    """(start, length, license, template, saved, n_different, exact, differences) of the notices of a text."""
    found = {}
    for at, block, window, places in candidate_blocks(text):
        if block not in known:
            known[block] = identify(block)
        if known[block]:
            *row, size, begin, end = known[block]
            length = _place(places, len(block) - 1) + 1 - at
            found[at, length] = (row[3] / size, row[3] - size, window, length, at), (_place(places, begin), _place(places, end - 1)), row
    kept, taken = [], []
    for (_, _, _, length, at), (begin, end), row in sorted(found.values(), key=lambda f: f[0]):
        k = bisect_right(taken, (begin, end))
        if (k and taken[k - 1][1] >= begin) or (k < len(taken) and taken[k][0] <= end):
            continue
        taken.insert(k, (begin, end))
        kept.append((at, length, *row))
    return _resolved(sorted(kept))


def _resolved(rows: list[tuple]) -> list[tuple]:
    """Notices of clauses that several BSD licenses share, under the name that a clause after them tells."""
    telling = [(r[0], r[2]) for r in rows if r[2] in ("BSD-3-Clause", "Apache-1.1")]
    out = []
    for r in rows:
        if r[2] == "BSD":
            near = [(abs(at - r[0]), name) for at, name in telling if abs(at - r[0]) <= NEAR]
            r = (*r[:2], min(near)[1] if near else "BSD-2-Clause", *r[3:])
        out.append(r)
    return out


def scan_licenses(documents: DataFrame) -> DataFrame:
    """A row per license notice found: where it stands, which license, how it differs from the template."""

    def make():
        names = [c.split()[0] for c in COLUMNS.split(", ")]

        def step(ids, texts):
            rows, known = [], {}
            for doc, text in zip(ids.to_pylist(), texts.to_pylist(), strict=True):
                if not text:
                    continue
                rows += [(doc, *row) for row in notices(text, known)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            return {name: list(c) for name, c in zip(names, columns, strict=True)}

        return step

    return map_columns(documents, ["doc_id", "text"], make, COLUMNS)
