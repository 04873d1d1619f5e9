"""License scans with inheritance by directory (operator 1).

Every line of every text is compared with license templates: sparse TF-IDF
vectors, cosine.  Term counts come from all lines of the corpus; only terms of
templates are counted, any other term weighs as much as the rarest.  A line that
shares too little of every template's weight for the cosine to reach the bound
is passed over before its vector is built (Cauchy-Schwarz, so nothing is lost).

Texts are also searched by windows of as many words as a template has: over line
ends, where a wrapped notice counts if it is closer than every single line, and
inside long lines if no line is close enough.

A file whose whole text is close to a template, or to the full text of a short
license, is a licence file of its directory, and so is one that begins as the
full text of a long license does.  A file without a header of its own takes the license of the nearest
directory above it that has a licence file: directories, once each, are joined
to their ancestors by path, then files to directories.

Defined results: null text is the empty text, without license; null ids and
repeated rows are carried along; null paths have no directory and inherit
nothing; of several licence files in a directory the closest counts, ties go to
the smaller path; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged
from .common import whole_text
from .decontam import words_of

#: Cosine of a header line, and of a whole text that counts as a licence file.
HEADER, FILE = 0.6, 0.5
#: Cosine of a text's first words to those of a long license, and words that may stand before them.
OPENING, BEFORE = 0.8, 12

# Customary notices of public licenses.
TEMPLATES = {
    "MIT": ("released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    "Apache-2.0": ("licensed under the apache license version 2 0", "you may not use this file except in compliance with the apache license version 2 0"),
    "GPL-3.0": ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3 or later as published by the free software foundation"),
    "GPL-2.0": ("licensed under the gnu general public license version 2",),
    "LGPL-3.0": ("licensed under the gnu lesser general public license version 3",),
    "AGPL-3.0": ("licensed under the gnu affero general public license version 3",),
    "MPL-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "BSD-3-Clause": ("redistribution and use in source and binary forms with or without modification are permitted", "licensed under the bsd 3 clause license"),
    "ISC": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "Unlicense": ("this is free and unencumbered software released into the public domain",),
    "CC-BY-4.0": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("licensed under cc by sa 4 0",),
    "CC-BY-NC-4.0": ("licensed under cc by nc 4 0",),
    "CC0-1.0": ("dedicated to the public domain under cc0 1 0 universal",),
}


_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_VERBATIM = "free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"
_NO_FIRM = "creative commons corporation creative commons is not a law firm and does not provide legal services or legal advice"

# Short licenses in full.
FULL = {
    "MIT": ("mit license copyright c permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _WARRANTY,),
    "BSD-3-Clause": ("bsd 3 clause license copyright c all rights reserved redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",),
    "ISC": ("isc license copyright c permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",),
    "Unlicense": ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law " + _WARRANTY,),
}
# How the full texts of long licenses begin.
OPENINGS = {
    "Apache-2.0": ("apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution 1 definitions",),
    "GPL-3.0": ("gnu general public license version 3 29 june 2007 copyright c 2007 " + _VERBATIM,),
    "GPL-2.0": ("gnu general public license version 2 june 1991 copyright c 1989 1991 " + _VERBATIM,),
    "LGPL-3.0": ("gnu lesser general public license version 3 29 june 2007 copyright c 2007 " + _VERBATIM,),
    "AGPL-3.0": ("gnu affero general public license version 3 19 november 2007 copyright c 2007 " + _VERBATIM,),
    "MPL-2.0": ("mozilla public license version 2 0 1 definitions 1 1 contributor means each individual or legal entity that creates contributes to the creation of or owns covered software",),
    "CC-BY-4.0": ("attribution 4 0 international " + _NO_FIRM,),
    "CC-BY-SA-4.0": ("attribution sharealike 4 0 international " + _NO_FIRM,),
    "CC-BY-NC-4.0": ("attribution noncommercial 4 0 international " + _NO_FIRM,),
    "CC0-1.0": ("creative commons legal code cc0 1 0 universal creative commons corporation is not a law firm and does not provide legal services",),
}


def _vocabulary(templates: dict) -> frozenset[bytes]:
    return frozenset(w for forms in templates.values() for form in forms for w in words_of(form.encode()))


def _lines(text: bytes) -> list[list[bytes]]:
    return [words for line in text.split(b"\n") if (words := words_of(line))]


def _counter(vocabulary: frozenset[bytes]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines that hold each term, added up for the task; the empty term counts all lines."""
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                for words in _lines(text):
                    seen[b""] += 1
                    seen.update(vocabulary.intersection(words))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    return count


class Matcher:
    """Unit vectors of the templates, for given line counts."""

    def __init__(self, templates: dict, held: dict[bytes, int], total: int) -> None:
        self.rarest = math.log(1 + max(total, 1)) + 1
        self.idf = {w: math.log((1 + total) / (1 + held.get(w, 0))) + 1 for w in _vocabulary(templates)}
        self.forms = [(name, self._unit(words_of(form.encode()))) for name in sorted(templates) for form in templates[name]]
        self.sizes = [len(words_of(form.encode())) for name in sorted(templates) for form in templates[name]]
        self.vocabulary = frozenset(self.idf)

    def _unit(self, words: list[bytes]) -> dict[bytes, float]:
        raw = {w: n * self.idf.get(w, self.rarest) for w, n in Counter(words).items()}
        size = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / size for w, x in raw.items()}

    def best(self, words: list[bytes], least: float) -> tuple[str | None, float]:
        """Closest template and cosine, if at least ``least``; ties go to the first name."""
        shared = self.vocabulary.intersection(words)
        if not shared:
            return None, 0.0
        # A cosine is at most the length of the template's part on the shared terms.
        near = [(name, form) for name, form in self.forms if sum(x * x for w, x in form.items() if w in shared) >= least * least]
        if not near:
            return None, 0.0
        own = self._unit(words)
        score, _, name = max((sum(x * own.get(w, 0.0) for w, x in form.items()), -i, name) for i, (name, form) in enumerate(near))
        return (name, min(score, 1.0)) if score >= least else (None, 0.0)


    def window(self, words: list[bytes], least: float, line_of: np.ndarray | None = None) -> tuple[str | None, float, int]:
        """As ``best``, of all runs of as many words as a template has, with ``line_of`` those over line ends only; and where the run begins."""
        shared = self.vocabulary.intersection(words)
        best = (0.0, 0, None, 0)
        for i, (name, form) in enumerate(self.forms):
            if sum(x * x for w, x in form.items() if w in shared) < least * least:
                continue
            n, held, weight = self.sizes[i], Counter(), 0.0
            for end, word in enumerate(words):
                if word in form:
                    held[word] += 1
                    weight += form[word] ** 2 * (held[word] == 1)
                if end >= n and (gone := words[end - n]) in form:
                    held[gone] -= 1
                    weight -= form[gone] ** 2 * (held[gone] == 0)
                if weight >= least * least - 1e-9 and word in form:
                    start = max(end - n + 1, 0)
                    if line_of is not None and line_of[start] == line_of[end]:
                        continue
                    own = self._unit(words[start : end + 1])
                    best = max(best, (sum(x * own.get(w, 0.0) for w, x in form.items()), -i, name, start), key=lambda b: b[:2])
        return (best[2], min(best[0], 1.0), best[3]) if best[0] >= least else (None, 0.0, 0)


def _scanner(matcher: Matcher, full: Matcher, openings: Matcher, header: float, whole: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                best, line, every = (None, 0.0), None, []
                for i, part in enumerate(text.split(b"\n")):
                    words = words_of(part)
                    every.append(words)
                    found = matcher.best(words, header) if words else (None, 0.0)
                    if found[1] > best[1]:
                        best, line = found, i
                flat = [w for words in every for w in words]
                line_of = np.repeat(np.arange(len(every)), [len(words) for words in every])
                found = matcher.window(flat, max(header, best[1]), None if line is None else line_of)
                if found[1] > best[1]:
                    best, line = found[:2], int(line_of[found[2]])
                begun = openings.window(flat[: max(openings.sizes, default=0) + BEFORE], OPENING)
                if begun[0]:
                    best, line = (None, 0.0), None  # titles of a full text are no notice, and may be closer to another license's
                as_file = begun[:2] if begun[0] else max((matcher.best(flat, whole), full.best(flat, whole)), key=lambda f: f[1])
                out.append((*best, line, *as_file))
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int32(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "path", "header", "header_score", "line", "file", "file_score"])

    return scan


def scan(files: DataFrame, path: Column, templates: dict = TEMPLATES, header: float = HEADER, whole: float = FILE) -> DataFrame:
    """(doc_id, path, header, header_score, line, file, file_score) of every row."""
    texts = files.select(F.col("doc_id").cast("long").alias("doc_id"), path.cast("string").alias("path"), whole_text().alias("text"))
    counted = texts.select("path", "text").mapInArrow(_counter(_vocabulary(templates) | _vocabulary(FULL) | _vocabulary(OPENINGS)), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    held = {r["term"].encode(): r["n"] for r in counted.collect()}  # one row per term of the templates
    matchers = [Matcher(x, held, held.get(b"", 0)) for x in (templates, FULL, OPENINGS)]
    return texts.mapInArrow(
        _scanner(*matchers, header, whole),
        "doc_id long, path string, header string, header_score double, line int, file string, file_score double",
    )


def directory(path: str) -> Column:
    """The path without its last part; empty at the top."""
    return F.regexp_replace(F.col(path), r"/?[^/]*$", "")


def inherited(scanned: DataFrame) -> DataFrame:
    """(doc_id, path, license, via, score, from_directory): own header, else the nearest directory's license.

    ``via`` is header, file, inherited, or null without a license.
    """
    rows = scanned.withColumn("home", directory("path"))
    licensed = (
        rows.where("file is not null and path is not null")
        .groupBy("home")
        .agg(F.min_by(F.struct("file", "file_score"), F.struct(-F.col("file_score"), F.col("path"))).alias("best"))
        .select(F.col("home").alias("above"), "best")
    )
    parts = F.split("home", "/", -1)
    homes = rows.where("path is not null").select("home").distinct()
    # Every directory with all above it, the top (the empty path) included; as deep as its path has parts.
    above = homes.select(
        "home", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))).alias("above")
    )
    nearest = (
        above.join(licensed, "above")
        .groupBy("home")
        .agg(F.max_by(F.struct("above", "best"), F.length("above")).alias("found"))
    )
    joined = rows.join(nearest, "home", "left")
    own = F.col("header").isNotNull()
    as_file = F.col("file").isNotNull()
    return joined.select(
        "doc_id", "path",
        F.coalesce("header", "file", "found.best.file").alias("license"),
        F.when(own, "header").when(as_file, "file").when(F.col("found").isNotNull(), "inherited").alias("via"),
        F.when(own, F.col("header_score")).when(as_file, F.col("file_score")).otherwise(F.col("found.best.file_score")).alias("score"),
        F.when(~own & ~as_file, F.col("found.above")).alias("from_directory"),
    )
