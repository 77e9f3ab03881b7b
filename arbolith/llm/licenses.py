"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

A text is cut into units: lines, and sentences within lines. A unit with a cue (CUES) may belong to a notice. Segments to score are
each such unit, it with its neighbours, so that wrapped notices are whole, and header blocks: all neighbouring units that hold a cue
or of which half the words are words of notices. Of a licence file (LICENSE, COPYING, NOTICE and the like, by its base name) the whole
text is a segment too. Terms are runs of a-z and 0-9 and weigh tf * idf, idf = ln((N + 1) / (df + 1)) + 1 over all N files with
terms, df counted for every term. Templates are short notices, standard headers and whole licence texts. A file has the license of
its most similar segment if the cosine is `least` or more.

A text of which no segment is that similar may still name a license, in a field (SPDX-License-Identifier, "license": in a package's
description, a heading) or a mention ("licensed under the"). The words after such a MARKER, up to the first that is in no license's
name, are a run; its beginnings are scored by the same cosine against license names. A name counts at `least_name`, and if its numbers
are the template's; of a run's best the longest counts, and a name that leaves the license open (UNCLEAR) gives none. So of an
expression the first license counts.

A directory has the license of its licence file: of the licence files
directly in it that have a license, the one with the smallest id (null last), then path. Files without a license of their own
inherit that of the nearest directory that has one, from their own up to the root "".

Scale: DataFrame functions only. One pass cuts segments, which are few, and leaves them with ids, paths and hashes in the shared
folder; another counts terms, combined before their shuffle. Texts themselves are never shuffled. Segments of equal texts are scored
once, as sparse vectors joined to the term counts; the template matrix, whose size the templates bound, is broadcast. Runs are scored
once each, however many files hold them. Ancestors are
looked up once a directory, not once a file.

Null or empty texts have no segments. Null paths have no directory and inherit nothing. Rows that
repeat get the same answer. Ties go to the license first by name.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Sequence
from functools import reduce
from importlib.resources import files as resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbolith.llm.common import bounded_join, saved, skew_join, text_or_empty, wide_hash

#: The customary short notices of common licenses.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Names of licenses by their identifier, and their version (None: names without one).
NAMES = (
    ("0BSD", None, ("0BSD", "BSD Zero Clause", "Zero-Clause BSD")),
    ("AGPL-3.0", "3.0", ("AGPL", "GNU AGPL", "GNU Affero General Public License", "Affero General Public License")),
    ("Apache-2.0", "2.0", ("Apache", "Apache License", "Apache Software License", "ASL")),
    ("Artistic-2.0", "2.0", ("Artistic", "Artistic License")),
    ("BSD-2-Clause", None, ("BSD-2-Clause", "2-Clause BSD", "BSD Two Clause", "Two-Clause BSD", "Simplified BSD", "FreeBSD")),
    ("BSD-3-Clause", None, ("BSD-3-Clause", "3-Clause BSD", "BSD Three Clause", "Three-Clause BSD", "New BSD", "Modified BSD")),
    ("BSL-1.0", "1.0", ("BSL", "Boost", "Boost Software License")),
    ("CC-BY-4.0", "4.0", ("CC BY", "Creative Commons Attribution", "Creative Commons Attribution International")),
    ("CC-BY-NC-4.0", "4.0", ("CC BY-NC", "Creative Commons Attribution-NonCommercial", "Creative Commons Attribution-NonCommercial International")),
    ("CC-BY-NC-ND-4.0", "4.0", ("CC BY-NC-ND", "Creative Commons Attribution-NonCommercial-NoDerivatives", "Creative Commons Attribution-NonCommercial-NoDerivatives International")),
    ("CC-BY-NC-SA-4.0", "4.0", ("CC BY-NC-SA", "Creative Commons Attribution-NonCommercial-ShareAlike", "Creative Commons Attribution-NonCommercial-ShareAlike International")),
    ("CC-BY-ND-4.0", "4.0", ("CC BY-ND", "Creative Commons Attribution-NoDerivatives", "Creative Commons Attribution-NoDerivatives International")),
    ("CC-BY-SA-4.0", "4.0", ("CC BY-SA", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution-ShareAlike International")),
    ("CC0-1.0", "1.0", ("CC0", "Creative Commons Zero", "Creative Commons CC0", "CC0 Universal")),
    ("EPL-1.0", "1.0", ("EPL", "Eclipse Public License")),
    ("EPL-2.0", "2.0", ("EPL", "Eclipse Public License")),
    ("EUPL-1.2", "1.2", ("EUPL", "European Union Public Licence")),
    ("GPL-2.0", "2.0", ("GPL", "GNU GPL", "GNU General Public License", "General Public License")),
    ("GPL-3.0", "3.0", ("GPL", "GNU GPL", "GNU General Public License", "General Public License")),
    ("ISC", None, ("ISC",)),
    ("LGPL-2.1", "2.1", ("LGPL", "GNU LGPL", "GNU Lesser General Public License", "Lesser General Public License")),
    ("LGPL-3.0", "3.0", ("LGPL", "GNU LGPL", "GNU Lesser General Public License", "Lesser General Public License")),
    ("MIT", None, ("MIT", "Expat", "MIT/X11")),
    ("MPL-2.0", "2.0", ("MPL", "Mozilla Public License")),
    ("NCSA", None, ("NCSA", "University of Illinois/NCSA Open Source")),
    ("PostgreSQL", None, ("PostgreSQL",)),
    ("Unlicense", None, ("Unlicense", "The Unlicense")),
    ("WTFPL", None, ("WTFPL", "Do What The F*ck You Want To Public License")),
    ("Zlib", None, ("zlib", "zlib/libpng")),
)
#: Names that leave open which license is meant.
UNCLEAR = ("BSD", "BSD-style", "GNU", "Creative Commons", "Apache", "GPL", "LGPL", "AGPL", "Public License", "Open Source")
#: What a license's name comes after, in lower case.
GAP = "[^a-z0-9]{1,9}"
MARKER = (
    r"(?:licen[sc]es?(?:[ _-]?(?:identifier|expression))?[\"']?[ \t]*(?:=>|[:=]|[\r\n])[^a-z0-9]*(?:osi approved[^a-z0-9]*)?"
    rf"|(?:licen[sc]ed|released|distributed|available|provided|published|covered){GAP}under{GAP})"
    rf"(?:(?:the{GAP})?terms{GAP}(?:and{GAP}conditions{GAP})?of{GAP})?(?:the{GAP})?"
)
#: What a notice can't do without.
CUES = ("licen", "copyright", "permission", "redistribut", "warrant", "spdx", "public domain")
CUE = "|".join(CUES)
#: Base names of licence files, lower-cased.
LICENCE_FILE = r"^((un)?licen[sc]e|copying|notice|copyright)([^a-z].*)?$"
#: Texts of up to this many words are notices; their words make a unit part of a header block.
NOTICE_WORDS = 300
BREAK = "\x01"


def templates() -> list[tuple[str, str]]:
    """(license, text): the short notices, then the standard headers and whole texts in the folder of templates."""
    folder = sorted(resources("arbolith.llm").joinpath("templates").iterdir(), key=lambda f: f.name)
    texts = [(f.name.removesuffix(".txt").removesuffix(".header"), f.read_text(encoding="utf-8")) for f in folder if f.name.endswith(".txt")]
    return [*NOTICES, *texts]


def terms_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def license_names() -> list[tuple[str, str]]:
    """(license, terms of a name): each name with the customary ways to write its version, of GNU's also what may follow; "" for unclear ones."""
    found = {("", " ".join(terms_of(name + more))) for name in UNCLEAR for more in ("", " license")}
    for license, version, names in NAMES:
        ends = [""]
        if version:
            short = [version, *([version[:-2]] if version.endswith(".0") else [])]
            ends = [f"{before}{v}" for v in short for before in (" ", " v", "v", " version ", " license ", " license v", " license version ")]
        after = ("", " license", " only", " or later", " or any later version") if "GPL" in license else ("", " license", " public domain dedication")
        whole = {name + end + more for name in names for end in ends for more in after}
        found |= {(license, " ".join(sorted(terms_of(w)))) for w in whole if w.lower().count("licen") < 2}  # their order has no weight
    return sorted(found)


def name_words(names: Sequence[tuple[str, str]]) -> list[str]:
    return sorted({t for _, name in names for t in name.split()})


def notice_words(known: Sequence[tuple[str, str]]) -> list[str]:
    return sorted({t for _, text in known if len(terms := terms_of(text)) <= NOTICE_WORDS for t in terms})


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(text, "[^a-z0-9]+"), "")


def segments(low: Column, whole: Column, words: Sequence[str], share: float) -> list[tuple[str, Column]]:
    """Columns, each from those before it, that end with `segs`: the segments of a lower-cased text."""
    has_cue = reduce(Column.__or__, (F.contains(low, F.lit(c)) for c in CUES))
    cut = F.split(F.regexp_replace(low, r"([.!?;])[ \t]+", "$1\n"), "\n")
    units, places = F.col("_units"), F.col("_places")

    def header(unit: Column) -> Column:
        own = _terms(unit)
        return unit.rlike(CUE) | (F.size(F.filter(own, lambda w: w.isin(list(words)))) >= F.size(own) * share)

    marked = F.array_join(F.transform(units, lambda u: F.when(header(u), u).otherwise(F.lit(BREAK))), "\n")
    before = lambda p: F.greatest(p - 1, F.lit(1))
    near = lambda p: F.array(
        *(F.array_join(F.slice(units, start, n), "\n") for start, n in ((p, 1), (p, 2), (before(p), 2), (before(p), 3)))
    )
    none = F.array().cast("array<string>")
    return [
        ("_units", F.when(has_cue, F.filter(cut, lambda u: u.rlike("[a-z0-9]")))),
        ("_places", F.when(F.size(units) > 0, F.filter(F.sequence(F.lit(1), F.size(units)), lambda p: F.get(units, p - 1).rlike(CUE)))),
        ("_blocks", F.when(F.size(places) > 0, F.filter(F.split(marked, BREAK), lambda b: b.rlike(CUE)))),
        (
            "segs",
            F.array_distinct(
                F.concat(
                    F.coalesce(F.col("_blocks"), none),
                    F.coalesce(F.flatten(F.transform(places, near)), none),
                    F.when(whole, F.array(low)).otherwise(none),
                )
            ),
        ),
    ]


def runs(low: Column, names: Sequence[tuple[str, str]]) -> Column:
    """The words after each marker of a lower-cased text, up to the first that is in no name; distinct, none empty."""
    vocabulary, most = name_words(names), max(len(name.split()) for _, name in names)
    has_cue = reduce(Column.__or__, (F.contains(low, F.lit(c)) for c in CUES))
    pieces = F.split(low, MARKER)

    def run(piece: Column) -> Column:
        own = F.slice(_terms(piece), 1, most)
        ends = F.filter(F.sequence(F.lit(0), F.size(own)), lambda n: F.forall(F.slice(own, F.lit(1), n), lambda w: w.isin(vocabulary)))
        return F.array_join(F.slice(own, F.lit(1), F.array_max(ends)), " ")

    after = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.when(has_cue, F.array_distinct(F.array_remove(F.transform(after, run), "")))


def named_licenses(found: DataFrame, names: Sequence[tuple[str, str]], counts: DataFrame, total: int, idf: dict[str, float], least: float) -> DataFrame:
    """run, license and cosine of the distinct runs in `found` that name a license."""
    numbers = lambda terms: " ".join(sorted(t for t in terms if re.search("[0-9]", t)))
    rows = []
    for k, (license, name) in enumerate(names):
        own = {t: n * idf[t] for t, n in Counter(name.split()).items()}
        length = math.sqrt(sum(w * w for w in own.values()))
        rows += [(t, k, license, numbers(name.split()), w / length) for t, w in own.items()]
    known = found.sparkSession.createDataFrame(rows, "term string, name int, license string, numbers string, weight double")
    n_words = F.size(F.split("run", " "))
    own = F.slice(F.split("run", " "), F.lit(1), F.col("n"))
    begun = found.select("run", F.explode(F.sequence(F.lit(1), n_words)).alias("n")).select("run", "n", own.alias("own"))
    digits = F.array_join(F.array_sort(F.filter("own", lambda t: t.rlike("[0-9]"))), " ")
    tf = begun.select("run", "n", digits.alias("numbers"), F.explode("own").alias("term")).groupBy("run", "n", "numbers", "term").agg(F.count(F.lit(1)).alias("tf"))
    words = tf.join(F.broadcast(counts), "term").withColumn("w", F.col("tf") * (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1))
    vectors = words.groupBy("run", "n", "numbers").agg(F.sum(F.col("w") * F.col("w")).alias("norm"), F.collect_list(F.struct("term", "w")).alias("v"))
    each = vectors.select("run", "n", "numbers", "norm", F.inline("v")).join(F.broadcast(known), ["term", "numbers"])
    scored = each.groupBy("run", "n", "norm", "name", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    best = F.min(F.struct((-F.round(F.col("dot") / F.sqrt("norm"), 4)).alias("below"), (-F.col("n")).alias("shorter"), "license")).alias("b")
    return (
        scored.groupBy("run")
        .agg(best)
        .filter((F.col("b.below") <= -least) & (F.col("b.license") != ""))
        .select("run", F.col("b.license").alias("license"), (-F.col("b.below")).alias("cosine"))
    )


def template_matrix(known: Sequence[tuple[str, str]], total: int, found: dict[str, int]) -> tuple[list[tuple], list[tuple[str, float]]]:
    """Rows (term, weight in each template) and (license, length) of each template."""
    idf = lambda t: math.log((total + 1) / (found.get(t, 0) + 1)) + 1
    rows: defaultdict[str, list[float]] = defaultdict(lambda: [0.0] * len(known))
    lengths = []
    for k, (name, text) in enumerate(known):
        own = {t: n * idf(t) for t, n in Counter(terms_of(text)).items()}
        for t, w in own.items():
            rows[t][k] = w
        lengths.append((name, math.sqrt(sum(w * w for w in own.values()))))
    return [(t, *w) for t, w in sorted(rows.items())], lengths


def own_licenses(
    segs: DataFrame, texts: DataFrame, known: Sequence[tuple[str, str]], least: float, names: Sequence[tuple[str, str]], least_name: float
) -> DataFrame:
    """t1, t2, whole, own_license and cosine of the texts that have a license.

    `segs` has t1, t2, whole, segs and runs; `texts` has one row a file, its lower-cased text.
    """
    spark = segs.sparkSession
    own = _terms(F.col("text"))
    each = F.when(F.size(own) > 0, F.concat(F.array(F.lit("")), F.array_distinct(own)))  # "" counts the files
    counts = saved(texts.select(F.explode(each).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    vocabulary = sorted({t for _, text in known for t in terms_of(text)} | set(name_words(names)))
    found = {r.term: r.df for r in counts.filter(F.col("term").isin(["", *vocabulary])).collect()}  # no more than the templates' terms
    total = found.pop("", 0)
    rows, lengths = template_matrix(known, total, found)
    weights = [f"w{k}" for k in range(len(known))]
    matrix = spark.createDataFrame(rows, T.StructType([T.StructField("term", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in weights)]))
    tf = (
        segs.groupBy("t1", "t2", "whole")
        .agg(F.first("segs").alias("segs"))
        .select("t1", "t2", "whole", F.posexplode("segs").alias("k", "seg"))
        .select("t1", "t2", "whole", "k", F.explode(_terms(F.col("seg"))).alias("term"))
        .groupBy("t1", "t2", "whole", "k", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    weight = F.col("tf") * (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1)
    sums = (
        skew_join(tf, counts, ["term"], "inner")
        .withColumn("w", weight)
        .join(F.broadcast(matrix), "term", "left")
        .groupBy("t1", "t2", "whole", "k")
        .agg(F.sum(F.col("w") * F.col("w")).alias("norm"), *(F.sum(F.col("w") * F.col(n)).alias(n) for n in weights))
    )
    cosine = lambda n, length: -F.round(F.coalesce(F.col(n), F.lit(0.0)) / (F.lit(length) * F.sqrt("norm")), 4)
    scores = [F.struct(cosine(n, length).alias("below"), F.lit(name).alias("license")) for n, (name, length) in zip(weights, lengths)]
    alike = (
        sums.select("t1", "t2", "whole", F.array_min(F.array(*scores)).alias("b"))
        .filter(F.col("b.below") <= -least)
        .select("t1", "t2", "whole", F.lit(0).alias("named"), "b.below", "b.license")
    )
    idf = {t: math.log((total + 1) / (found.get(t, 0) + 1)) + 1 for t in name_words(names)}
    held = segs.select("t1", "t2", "whole", F.explode("runs").alias("run"))
    of_names = counts.filter(F.col("term").isin(name_words(names)))
    named = saved(named_licenses(held.select("run").distinct(), names, of_names, total, idf, least_name))
    mentioned = bounded_join(held, named, ["run"], "inner").select(
        "t1", "t2", "whole", F.lit(1).alias("named"), (-F.col("cosine")).alias("below"), "license"
    )
    return (
        alike.unionByName(mentioned)
        .groupBy("t1", "t2", "whole")
        .agg(F.min(F.struct("named", "below", "license")).alias("b"))
        .select("t1", "t2", "whole", F.col("b.license").alias("own_license"), (-F.col("b.below")).alias("cosine"))
    )


def license_scan(
    files: DataFrame,
    id_col: str = "doc_id",
    path_col: str = "path",
    text_col: str = "text",
    known: Sequence[tuple[str, str]] | None = None,
    share: float = 0.5,
    least: float = 0.7,
    names: Sequence[tuple[str, str]] | None = None,
    least_name: float = 0.9,
) -> DataFrame:
    """One row per input row: `id_col`, path, own_license, cosine (of its best segment or name, null if it has no license), license
    (own, else the nearest directory's) and license_dir (the directory it is inherited from, null for an own one)."""
    known = templates() if known is None else list(known)
    names = license_names() if names is None else list(names)
    path = F.col(path_col).cast("string")
    rows = files.select(F.col(id_col).alias("id"), path.alias("path"), text_or_empty(text_col).alias("text"))
    cut = rows.select(
        "id",
        "path",
        F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"),
        F.coalesce(F.lower(F.element_at(F.split("path", "/"), -1)).rlike(LICENCE_FILE), F.lit(False)).alias("whole"),
        *wide_hash(F.col("text"), "t"),
        F.lower("text").alias("low"),
    )
    for name, column in segments(F.col("low"), F.col("whole"), notice_words(known), share):
        cut = cut.withColumn(name, column)
    slim = saved(cut.select("id", "path", "dir", "whole", "t1", "t2", "segs", runs(F.col("low"), names).alias("runs")))
    texts = rows.select(F.lower("text").alias("text"))
    own = own_licenses(slim.filter((F.size("segs") > 0) | (F.size("runs") > 0)).select("t1", "t2", "whole", "segs", "runs"), texts, known, least, names, least_name)
    placed = slim.drop("segs", "runs")
    mine = skew_join(placed, own, ["t1", "t2", "whole"], "left").drop("t1", "t2")
    of_dir = (
        mine.filter("whole and own_license is not null and dir is not null")
        .groupBy(F.col("dir").alias("license_dir"))
        .agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "path", "own_license")).alias("f"))
        .select("license_dir", F.col("f.own_license").alias("dir_license"))
    )
    parts = F.split("dir", "/")
    above = F.array_distinct(
        F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))  # the root "" first
    )
    inherited = (
        skew_join(
            placed.filter("dir is not null").select("dir").distinct().select("dir", F.explode(above).alias("license_dir")),
            of_dir,
            ["license_dir"],
            "inner",
        )
        .groupBy("dir")
        .agg(F.max(F.struct(F.length("license_dir").alias("n"), "license_dir", "dir_license")).alias("n"))
        .select("dir", "n.license_dir", "n.dir_license")
    )
    return skew_join(mine, inherited, ["dir"], "left").select(
        F.col("id").alias(id_col),
        "path",
        "own_license",
        "cosine",
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("license_dir")).alias("license_dir"),
    )
