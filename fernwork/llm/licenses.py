"""Licences of files: TF-IDF cosine of headers and licence files to templates, then the nearest licensed directory's.

* Of every file's whole text, these are notices: each line that speaks of a licence, each run of neighbouring such
  lines, alone and with the one or two lines around it (a version often stands there), each run of paragraphs that
  speak of one; of a licence file (by its name) the whole text is one as well. Notices and templates become sparse
  TF-IDF vectors over the templates' terms; a term that no template has adds to a notice's length. The template
  with the highest cosine of at least `least` names the file's licence. Templates are full texts of licences (folder
  licence_texts) and usual notices; a notice template only matches where its version and its qualifiers
  (noncommercial, lesser, ...) are those of the notice. Names without a version, and "All rights reserved", count
  only where nothing else matches.
* An SPDX-License-Identifier line names the licence itself, whatever it is; its cosine is 1. Its `-only`, `-or-later`
  and `+` are left out, as templates don't tell them apart.
* A file without a licence notice of its own takes the licence of the nearest directory above it that holds a licence
  file. A file whose notice matches no template is "unknown": it has no licence and inherits none.
  Directories are made distinct first and meet licensed directories by their ancestors' paths; files then meet
  their directory. Both sides are stored tables, so hot directories are split by adaptive execution.

Defined results: a null or empty text has no licence of its own; a null path inherits nothing; rows are kept one to
one, repeated rows included; several licence files in one directory: the smallest path counts; equal cosines: the
first template by name; an empty table gives an empty table; other columns are ignored but for the id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwork.llm.common import ship, small_join, stored

#: Usual notices of public licences.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache": ("Licensed under the Apache License.",),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "Artistic-2.0": ("This program is licensed under the Artistic License 2.0.",),
    "BSD": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "Licensed under the Simplified BSD License."),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Licensed under the New BSD License."),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "CC0-1.0": ("Licensed under CC0 1.0.", "This work is released under the Creative Commons CC0 1.0 Universal Public Domain Dedication.", "https://creativecommons.org/publicdomain/zero/1.0/"),
    "CDDL-1.0": ("The contents of this file are subject to the terms of the Common Development and Distribution License (CDDL), Version 1.0.",),
    "EPL-1.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",),
    "EUPL-1.2": ("Licensed under the European Union Public Licence (EUPL), Version 1.2.",),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    "MIT": ("Released under the MIT License.", "MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Proprietary": ("Copyright. All rights reserved.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "http://unlicense.org"),
    "WTFPL": ("Licensed under the WTFPL.", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    "Zlib": ("Released under the zlib License.", "Licensed under the zlib/libpng License."),
}
#: The GNU licences: name, short name, what they call the work, versions.
_GNU = (("", "GPL", "program", ("1", "2", "3")), ("Affero ", "AGPL", "program", ("1", "3")), ("Lesser ", "LGPL", "library", ("2.1", "3")), ("Library ", "LGPL", "library", ("2",)))
for _kind, _short, _work, _versions in _GNU:
    for _v in (None, *_versions):
        _name = _short if _v is None else f"{_short}-{_v}" if "." in _v else f"{_short}-{_v}.0"
        _full, _with = f"GNU {_kind}General Public License", f", version {_v}" if _v else ""
        NOTICES[_name] = (
            *NOTICES.get(_name, ()), f"This {_work} is licensed under the {_full}{_with}.", f"Licensed under the {_full}{_with}.", f"Licensed under the {_short}{' v' + _v if _v else ''}.",
            f"This {_work} is free software: you can redistribute it and/or modify it under the terms of the {_full} as published by the Free Software Foundation" + (f", either version {_v} of the License, or (at your option) any later version." if _v else "."),
        )
#: Creative Commons: qualifiers and versions.
for _kind, _full in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items():
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        NOTICES[f"CC-{_kind}-{_v}"] = (
            f"Licensed under CC {_kind} {_v}.", f"This work is licensed under a Creative Commons {_full} {_v} International License.", f"This work is licensed under a Creative Commons {_full} {_v} Unported License.",
            f"Creative Commons {_full} {_v}", f"https://creativecommons.org/licenses/{_kind.lower()}/{_v}/",
        )
#: Names that say less than another match would.
WEAK = frozenset(("Proprietary", "Apache", "BSD", "GPL", "LGPL", "AGPL"))


def full_texts() -> dict[str, str]:
    # executors read them inside the zip file that ship() sends
    folder = resources.files(__package__).joinpath("licence_texts")
    texts = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
    # AGPL-3.0 is the text of GPL-3.0 under its own name, but for section 13
    before, section, after = re.split(r"(?s)(  13\. Use with the GNU Affero.*?)(?=  14\. Revised)", texts["GPL-3.0"].replace("GNU GENERAL", "GNU AFFERO GENERAL"), maxsplit=1)
    own = "13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge.\n"
    change = lambda t: t.replace("GNU General Public License", "GNU Affero General Public License")
    return {**texts, "AGPL-3.0": change(before) + own + change(after)}


TEMPLATES = {name: (*NOTICES.get(name, ()), *((full,) if full else ())) for texts in [full_texts()] for name in sorted({*NOTICES, *texts}) for full in [texts.get(name)]}
LICENCE_FILE = r"^(un)?licen[cs]e([.-].*)?$|^copying([.-].*)?$|^copyright([.-].*)?$"
_SPEAKS = re.compile(r"licen[cs]|copyright|all rights reserved|permission (?:is (?:hereby )?granted|is hereby|to use)|redistributi?on|spdx|public domain|creative ?commons|\bcc[ -](?:by|0)|\bcc0\b|\b[al]?gpl|\bwtfpl|provided .{0,3}as[ -]is|free software", re.I)
#: What only a notice says: other mentions of a licence don't stand for one.
_NOTICE = re.compile(
    r"spdx-licen[cs]e-identifier|licen[cs]ed\s+(?:\w+\s+){0,4}under|\b(?:released|distributed|available|provided|redistributed?|published|covered|governed|subject)\b[^.\n]{0,40}\b(?:under|by|to)\b[^.\n]{0,80}\blicen[cs]e|under\s+the\s+terms\s+(?:and\s+conditions\s+)?of"
    r"|permission\s+(?:is\s+(?:hereby\s+)?granted|to\s+use)|redistribution\s+and\s+use|all\s+rights\s+reserved|(?:in|into|to)\s+the\s+public\s+domain|creativecommons\.org|\bcreative\s+commons\s+\w+|\blicen[cs]e\s*[:=]\s*\S|\blicen[cs]e,?\s+(?:version|v\.?)\s*\d|\bcc[ -]by\b|\bcc0\b",
    re.I,
)
_SPDX = re.compile(r"spdx-licen[cs]e-identifier:[ \t]*([A-Za-z0-9.+() \t:-]+)", re.I)
_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_VERSION = re.compile(r"[0-9]+(?:\.[0-9]+)*")
#: One spelling of terms that are written in several ways.
_SPELLINGS = ((re.compile(r"licence"), "license"), (re.compile(r"library general public"), "lesser general public"), (re.compile(r"non-commercial"), "noncommercial"), (re.compile(r"share[- ]alike"), "sharealike"), (re.compile(r"no-?derivs|no[- ]derivatives|no-?derivative works"), "noderivatives"))
_QUALIFIERS = frozenset("noncommercial sharealike noderivatives nc sa nd affero lesser agpl lgpl".split())
#: Terms up to which a template is a notice, whose version and qualifiers must agree.
_SHORT = 100


class Matcher:
    def __init__(self, templates: dict[str, tuple[str, ...]]):
        terms = [(name, Counter(self.terms(text))) for name, texts in sorted(templates.items()) for text in texts]
        df = Counter(t for _, c in terms for t in c)
        self.idf = {t: math.log((1 + len(terms)) / (1 + n)) + 1 for t, n in df.items()}
        self.other = math.log(1 + len(terms)) + 1
        self.names = [name for name, _ in terms]
        self.versions = [frozenset(t for t in c if _VERSION.fullmatch(t)) if c.total() <= _SHORT else None for _, c in terms]
        self.qualifiers = [_QUALIFIERS & c.keys() for _, c in terms]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for k, (_, c) in enumerate(terms):
            for t, x in self.unit(c).items():
                self.postings.setdefault(t, []).append((k, x))
        self.known = {name.lower(): name for name in self.names}
        self.seen: dict[str, tuple[float, str | None]] = {}

    @staticmethod
    def terms(text: str) -> list[str]:
        text = text.lower()
        for pattern, spelling in _SPELLINGS:
            text = pattern.sub(spelling, text)
        found = (t[1:] if t[0] == "v" and t[1:2].isdigit() else t for t in _TERM.findall(text))
        return [t[:-2] if t.endswith(".0") else t for t in found]

    def unit(self, count: Counter) -> dict[str, float]:
        v = {t: (1 + math.log(n)) * self.idf.get(t, self.other) for t, n in count.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / size for t, x in v.items()}

    def agrees(self, k: int, v: dict[str, float]) -> bool:
        """Whether a notice template's version and qualifiers are those of the text."""
        return self.versions[k] is None or self.versions[k] <= v.keys() and self.qualifiers[k] == _QUALIFIERS & v.keys()

    def best(self, text: str, least: float) -> tuple[float, str | None]:
        v = self.unit(Counter(self.terms(text)))
        cosines: dict[int, float] = {}
        for t, x in v.items():
            for k, y in self.postings.get(t, ()):
                cosines[k] = cosines.get(k, 0.0) + x * y
        found = (0.0, None)
        for k in sorted(k for k, x in cosines.items() if x >= least - 1e-12):
            weak = self.names[k] in WEAK
            if (found[1] is None or (not weak, cosines[k]) > (found[1] not in WEAK, found[0] + 1e-12)) and self.agrees(k, v):
                found = (cosines[k], self.names[k])
        return found

    def notices(self, text: str, whole: bool) -> Iterator[str]:
        if whole:
            yield text
        if not _SPEAKS.search(text):
            return
        lines = text.split("\n")
        at = [k for k, line in enumerate(lines) if _SPEAKS.search(line)]
        yield from (lines[k] for k in at)
        first = 0
        for k in range(len(at)):
            if k + 1 < len(at) and at[k + 1] == at[k] + 1:
                continue
            a, b = at[first], at[k] + 1
            first = k + 1
            for around in range(3):
                if around or b - a > 1:
                    yield "\n".join(lines[max(a - around, 0) : b + around])
        # paragraphs end at lines without letters or digits
        paragraphs, start = [], None
        for k, line in enumerate([*lines, ""]):
            if _TERM.search(line.lower()):
                start = k if start is None else start
            elif start is not None:
                paragraphs.append((start, k))
                start = None
        speaking, run = set(at), None
        for a, b in [*paragraphs, (len(lines), len(lines))]:
            if any(k in speaking for k in range(a, b)):
                yield "\n".join(lines[a:b])
                run = (a if run is None else run[0], b, 1 if run is None else run[2] + 1)
            else:
                if run and run[2] > 1:
                    yield "\n".join(lines[run[0] : run[1]])
                run = None
        if at and at[-1] - at[0] > 1:
            yield "\n".join(lines[at[0] : at[-1] + 1])

    def tagged(self, text: str) -> str | None:
        """The licence that an SPDX identifier names, as an expression if it has several."""
        if not (m := _SPDX.search(text)):
            return None
        names = []
        for x in re.findall(r"[()]|[^\s()]+", m[1]):
            if x.upper() in ("OR", "AND", "WITH") or x in "()":
                names.append(x.upper())
                continue
            x = re.sub(r"(-only|-or-later|\+)$", "", x)
            names.append(self.known.get(x.lower(), x))
            if len(names) > 1 and names[-2] not in ("OR", "AND", "WITH", "("):
                names.pop()  # what follows the expression
                break
        return re.sub(r"\( | \)", lambda p: p[0].strip(), " ".join(names)) or None

    def licence(self, text: str | None, whole: bool, least: float) -> tuple[str | None, float | None, bool]:
        """The text's licence, its cosine, and whether the text has a notice that matches none."""
        text = text or ""
        if name := self.tagged(text):
            return name, 1.0, False
        found: tuple[float, str | None] = (0.0, None)
        for x in self.notices(text, whole):
            if len(x) > 2000:
                new = self.best(x, least)
            else:
                if (new := self.seen.get(x)) is None:
                    if len(self.seen) > 10_000:
                        self.seen.clear()
                    new = self.seen[x] = self.best(x, least)
            if new[1] and (found[1] is None or (new[1] not in WEAK, new[0]) > (found[1] not in WEAK, found[0])):
                found = new
        return (found[1], found[0], False) if found[1] else (None, None, bool(_NOTICE.search(text)))


def scan(files: DataFrame, path: Column | str = "path", id_col: str = "path", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None, least: float = 0.6) -> DataFrame:
    """Per row: id, path, licence, cosine (of an own licence), found ("own", "inherited", "unknown" or "none"), from_path (of the licence file)."""
    ship(files.sparkSession)
    at = files[path] if isinstance(path, str) else path
    rows = files.select(files[id_col].alias("id"), at.cast("string").alias("path"), files[text_col].cast("string").alias("text"))
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    rows = rows.withColumn("whole", F.coalesce(name.rlike(LICENCE_FILE), F.lit(False)))
    chosen = dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(chosen)
        for batch in batches:
            got = [matcher.licence(t.as_py(), w.as_py(), least) for t, w in zip(batch.column("text"), batch.column("whole"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "path", "whole")), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.bool_())], names=["id", "path", "whole", "own", "cosine", "unknown"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, path string, whole boolean, own string, cosine double, unknown boolean")
    found = stored(found.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")))
    licensed = stored(found.where("whole AND own IS NOT NULL AND dir IS NOT NULL").groupBy("dir").agg(F.min(F.struct("path", "own")).alias("l")))
    # a directory's ancestors: itself, and each shorter path down to the root ""
    parts = F.split("of", "/")
    ups = F.when(F.col("of") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    dirs = stored(found.where("dir IS NOT NULL AND own IS NULL AND NOT unknown").select(F.col("dir").alias("of")).distinct())
    spread = dirs.select("of", F.posexplode(ups).alias("depth", "dir"))
    nearest = stored(small_join(spread, licensed, ["dir"]).groupBy("of").agg(F.max(F.struct("depth", "l")).alias("m")).select(F.col("of").alias("dir"), F.col("m.l").alias("l")))
    out = small_join(found, nearest, ["dir"], "left")
    own = F.col("own").isNotNull()
    heir = ~own & ~F.col("unknown")
    return out.select(
        F.col("id").alias(id_col), *([F.col("path").alias("path")] if id_col != "path" else []), F.coalesce("own", F.when(heir, F.col("l.own"))).alias("licence"), "cosine",
        F.when(own, "own").when(F.col("unknown"), "unknown").when(F.col("l").isNotNull(), "inherited").otherwise("none").alias("found"), F.when(heir, F.col("l.path")).alias("from_path"),
    )
