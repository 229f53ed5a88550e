"""License scans by conditional compression.

Blocks of a text that speak of licences are compressed with zstandard, plainly and with each
template as a raw dictionary.  A template that a block repeats makes it much smaller; templates
are ranked by that reduction.  The best ones are confirmed by wording: a notice of the template
is aligned with the block word by word, its marks (names and versions) must stand there
exactly, and the words that differ may be few; they are returned.

A block is a run of words in which each lies no farther from a trigger than the longest notice
and its differing words reach; line breaks and signs only part words.  So a notice is in one block
however its lines are wrapped.  Blocks longer than ``BLOCK`` words are cut with an overlap of twice
the longest notice; of what is found in two cuts, the place with fewer differing words counts.
Every template whose marks stand in a block is tried.  Null texts count as empty, documents without
a licence have zero findings; a null doc_id stays null, repeated rows are each scanned, further
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import hands, mapped, record

# Share of a notice's words that may be replaced, words of a block.
DIFFERING = 0.12
BLOCK = 600

# Public licence notices.  For each licence the notices, and the marks of which one must stand word for word.
TEMPLATES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "MIT": ((
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so"), ("mit", "free of charge to any person")),
    "Apache-2.0": ((
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
        ("apache license version 2 0", "apache 2 0", "apache license 2 0")),
    "GPL-3.0": ((
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."), ("general public license version 3", "gpl 3 0", "version 3 of the license")),
    "GPL-2.0": ((
        "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version."), ("general public license version 2", "gpl 2 0", "version 2 of the license")),
    "LGPL": (("This library is licensed under the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-3.0-or-later", "SPDX-License-Identifier: LGPL-2.1-only"),
             ("lesser general public license", "lgpl")),
    "BSD": ((
        "Licensed under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "Released under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
        ("bsd", "redistribution and use in source and binary forms")),
    "MPL-2.0": (("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0",
                 "Licensed under the Mozilla Public License, version 2.0."), ("mozilla public license", "mpl 2 0")),
    "ISC": (("Released under the ISC License.", "SPDX-License-Identifier: ISC",
             "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
             "this permission notice appear in all copies."), ("isc", "for any purpose with or without fee")),
    "CC-BY-NC-4.0": (("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
                     ("cc by nc 4 0", "attribution noncommercial 4 0")),
    "CC-BY-SA-4.0": (("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
                     ("cc by sa 4 0", "attribution sharealike 4 0")),
    "CC-BY-4.0": (("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("cc by 4 0", "commons attribution 4 0")),
    "CC0-1.0": (("Released under CC0 1.0.", "Dedicated to the public domain under CC0 1.0 Universal."), ("cc0 1 0", "cc0")),
    "Unlicense": (("This is free and unencumbered software released into the public domain.",), ("unencumbered software released into the public domain",)),
    "Proprietary": (("All rights reserved.", "Copyright. All rights reserved."), ("all rights reserved",)),
}

_TRIGGER = re.compile(r"licen[cs]|copyright|all[\W_]+rights[\W_]+reserved|spdx|permission|redistribut|public[\W_]+domain|creative[\W_]+commons|\bCC[\W_]?(?:BY|0)", re.I)
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@dataclass(frozen=True)
class Template:
    name: str
    notices: tuple[tuple[str, ...], ...]
    marks: tuple[tuple[str, ...], ...]
    compressor: object


@lru_cache(maxsize=1)
def templates() -> tuple[tuple[Template, ...], object]:
    """The prepared templates and a plain compressor, once a worker."""
    import zstandard

    out = []
    for name, (notices, marks) in TEMPLATES.items():
        raw = zstandard.ZstdCompressionDict(" ".join(words("\n".join(notices))).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append(Template(name, tuple(tuple(words(n)) for n in notices), tuple(tuple(m.split()) for m in marks),
                            zstandard.ZstdCompressor(level=9, dict_data=raw, write_content_size=False)))
    return tuple(out), zstandard.ZstdCompressor(level=9, write_content_size=False)


@lru_cache(maxsize=1)
def longest() -> int:
    """Words of the longest notice."""
    return max(len(n) for t in templates()[0] for n in t.notices)


def blocks(text: str, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First word and end of the candidate blocks, of a text whose words lie at ``places``."""
    starts, reach = [a for a, _ in places], longest() + int(2 * DIFFERING * longest())
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        i = bisect_right(starts, m.start()) - 1
        first, last = max(0, i - reach), min(len(places), i + reach + 1)
        if out and first <= out[-1][1]:
            out[-1][1] = last
        else:
            out.append([first, last])
    return [cut for a, b in out for cut in _cut(a, b)]


def _cut(start: int, end: int) -> list[tuple[int, int]]:
    overlap = 2 * longest()
    if end - start <= BLOCK:
        return [(start, end)]
    return [(i, min(i + BLOCK, end)) for i in range(start, end - overlap, BLOCK - overlap)]


def ranked(block: list[str]) -> list[tuple[int, Template]]:
    """Templates whose marks stand in the block, by the bytes that the block loses with them at hand."""
    prepared, plain = templates()
    able = [t for t in prepared if any(_at(block, m) for m in t.marks)]
    if not able:
        return []
    raw = " ".join(block).encode()
    size = len(plain.compress(raw))
    return sorted(((size - len(t.compressor.compress(raw)), t) for t in able), key=lambda f: (-f[0], f[1].name))


def _at(block: list[str], mark: tuple[str, ...]) -> list[int]:
    """Where the words of a mark stand."""
    n, out, i = len(mark), [], -1
    try:
        while True:
            i = block.index(mark[0], i + 1)
            if tuple(block[i:i + n]) == mark:
                out.append(i)
    except ValueError:
        return out


def confirmed(block: list[str], template: Template) -> tuple[int, int, list[str]] | None:
    """First and last word of the notice in the block, and the wording that differs; none if no notice stands there."""
    best = None
    places = {m: _at(block, m) for m in template.marks}
    for notice in template.notices:
        lead = SequenceMatcher(None, block, notice, autojunk=False).find_longest_match()
        # The longest common run, and each mark, fix where the notice would lie.
        firsts = {max(0, lead.a - lead.b)} if lead.size else set()
        firsts |= {max(0, i - k) for m, found in places.items() for k in _at(list(notice), m) for i in found}
        for first in sorted(firsts):
            part = block[first:first + len(notice)]
            if not any(_at(part, m) for m in template.marks):
                continue
            steps = [s for s in SequenceMatcher(None, part, notice, autojunk=False).get_opcodes() if s[0] != "equal"]
            differ = [f"-{w}" for _, _, _, c, d in steps for w in notice[c:d]] + [f"+{w}" for _, a, b, _, _ in steps for w in part[a:b]]
            if len(differ) > 2 * DIFFERING * len(notice):
                continue
            case = (-len(notice) + len(differ), first, first + len(part), differ)
            if best is None or case[:2] < best[:2]:
                best = case
    return best[1:] if best else None


@dataclass(frozen=True)
class Finding:
    license: str
    start: int
    end: int
    saved: int
    differences: str


def scan(text: str | None) -> list[Finding]:
    """The licences of a whole text in order, each place once."""
    text = text or ""
    if not _TRIGGER.search(text):
        return []
    every = [m.span() for m in _WORD.finditer(text)]
    found: list[tuple[int, int, Finding]] = []
    for cut, (start, end) in enumerate(blocks(text, every)):
        places = every[start:end]
        left = [text[a:b].lower() for a, b in places]
        while True:  # several notices may stand in one block
            hit = next(((saved, t, c) for saved, t in ranked(left) if (c := confirmed(left, t))), None)
            if hit is None:
                break
            saved, template, (first, last, differ) = hit
            found.append((len(differ), cut, Finding(template.name, places[first][0], places[last - 1][1], saved, " ".join(differ))))
            left[first:last] = [""] * (last - first)  # taken; what is left is looked at again
    out: list[tuple[int, Finding]] = []
    for _, cut, f in sorted(found, key=lambda x: (x[0], x[1])):
        if all(c == cut or f.end <= o.start or o.end <= f.start for c, o in out):  # else another cut has it
            out.append((cut, f))
    return sorted((f for _, f in out), key=lambda f: (f.start, f.license, f.end))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_licenses, licenses, spans, differences`` of every row.

    ``licenses`` holds the distinct names, sorted; ``spans`` a ``name:start:end`` (code points) for
    each finding; ``differences`` the differing words of each finding, joined by a bar.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_licenses", pa.int64()), ("licenses", pa.string()), ("spans", pa.string()), ("differences", pa.string())])

    def run(batches):
        for batch in hands(batches):
            found = [scan(t) for t in batch.column("text").to_pylist()]
            yield record(schema, doc_id=batch.column("doc_id"), n_licenses=[len(f) for f in found], licenses=[",".join(sorted({x.license for x in f})) for f in found],
                         spans=[",".join(f"{x.license}:{x.start}:{x.end}" for x in f) for f in found], differences=["|".join(x.differences for x in f) for f in found])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_licenses long, licenses string, spans string, differences string")
