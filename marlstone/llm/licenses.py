"""License scans: TF-IDF cosine of headers and license files to templates, then inheritance.

Weights are (1 + ln tf) * idf, with idf from the templates; a word that no template has weighs as
the rarest. Both searches are exact for what they define.

Headers: a template's anchors are its two rarest words. At each occurrence of one in a text, the
words around it as wide as the template (within and across lines) are a window, and the window's
cosine to the template is computed inside its row. A window matches at ``threshold`` if it also
shares three fifths of the template's distinct words, so that one rare word alone doesn't match.

License files: the whole text's cosine to whole license texts, for texts that could reach ``whole``
by the share that the license texts' words have in them (``could_reach``, an upper bound that is
taken inside the row), so no text is left out that reaches it. A file that reaches it has that license; other files have
the license of their best header (ties: the longer template, then the name).

Inheritance: a file is a license file of its folder if it reaches ``whole``, if its path says so
(LICENSE, COPYING, ...) and it has a license, or if its matching windows cover at least ``cover`` of
its words. A file without a license of its own takes that of the deepest ancestor folder with one.
Folders are resolved first, one row a folder, by joining each folder's ancestors with the licensed
folders; files then join their folder, so a file never stands for its ancestors. Several license
files in a folder: those whose path says so first, then the best cosine, then name.

Templates are few and fixed, so they are broadcast. Null path: scanned, but neither gives nor
inherits. Null or empty text: no license. Repeated rows: each returned. An empty table gives an
empty table. Columns that aren't named aren't carried.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from importlib import resources

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import quoted, settle

# Headers, opening lines and titles of public licenses.
HEADERS = {
    "AGPL-3.0": [
        "licensed under the gnu affero general public license version 3",
        "gnu affero general public license version 3",
        "gnu affero general public license version 3 19 november 2007",
        "gnu affero general public license as published by the free software foundation either version 3 of the license",
    ],
    "Apache-2.0": [
        "licensed under the apache license version 2.0",
        "apache license version 2.0 january 2004",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0",
    ],
    "Artistic-1.0": ["the artistic license preamble", "licensed under the artistic license"],
    "BSD-2-Clause": ["licensed under the bsd 2 clause license", "bsd 2 clause license", "simplified bsd license"],
    "BSD-3-Clause": [
        "redistribution and use in source and binary forms with or without modification are permitted",
        "licensed under the bsd 3 clause license",
        "bsd 3 clause license",
        "use of this source code is governed by a bsd style license that can be found in the license file",
    ],
    "CC-BY-4.0": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"],
    "CC-BY-NC-4.0": ["licensed under cc by nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 international license"],
    "CC-BY-SA-4.0": ["licensed under cc by sa 4.0", "licensed under a creative commons attribution sharealike 4.0 international license"],
    "CC0-1.0": ["cc0 1.0 universal", "released under the cc0 1.0 universal public domain dedication"],
    "GPL-1.0": ["gnu general public license version 1", "gnu general public license version 1 february 1989"],
    "GPL-2.0": [
        "licensed under the gnu general public license version 2",
        "gnu general public license version 2",
        "gnu general public license version 2 june 1991",
        "gnu general public license as published by the free software foundation either version 2 of the license",
    ],
    "GPL-3.0": [
        "licensed under the gnu general public license version 3",
        "gnu general public license version 3",
        "gnu general public license version 3 29 june 2007",
        "gnu general public license as published by the free software foundation either version 3 of the license",
    ],
    "ISC": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "licensed under the isc license", "isc license"],
    "LGPL-2.0": ["gnu library general public license version 2", "gnu library general public license version 2 june 1991", "gnu library general public license as published by the free software foundation either version 2 of the license"],
    "LGPL-2.1": [
        "licensed under the gnu lesser general public license version 2.1",
        "gnu lesser general public license version 2.1",
        "gnu lesser general public license version 2.1 february 1999",
        "gnu lesser general public license as published by the free software foundation either version 2.1 of the license",
    ],
    "LGPL-3.0": [
        "licensed under the gnu lesser general public license version 3",
        "gnu lesser general public license version 3",
        "gnu lesser general public license version 3 29 june 2007",
        "gnu lesser general public license as published by the free software foundation either version 3 of the license",
    ],
    "MIT": [
        "released under the mit license",
        "licensed under the mit license",
        "the mit license mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ],
    "MPL-1.1": ["the contents of this file are subject to the mozilla public license version 1.1", "mozilla public license version 1.1"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "mozilla public license version 2.0"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense"],
    "Zlib": ["licensed under the zlib license"],
}

#: Words that make no anchor and count as present in every text.
PLAIN = frozenset("a an and any are as at be by can file for from in is it license may not of on or that the this to use version with you".split())
#: Anchors of a template.
_ANCHORS = 2

_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"


def short_forms(name: str) -> list[str]:
    """The machine-readable tags of a license identifier."""
    return [f"spdx license identifier {name}"]


@lru_cache(maxsize=1)
def license_texts() -> dict[str, str]:
    """Whole license texts by identifier; the affero text differs from the general one by its name."""
    folder = resources.files("marlstone.llm").joinpath("license_texts")
    found = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}
    return found | {"AGPL-3.0": re.sub(r"(?i)\bgnu general\b", "GNU Affero General", found["GPL-3.0"])}


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


@dataclass(frozen=True)
class Model:
    """Unit TF-IDF vectors of (name, text) templates."""

    names: list[str]
    words: list[list[str]]
    vectors: list[dict[str, float]]
    idf: dict[str, float]
    unknown: float  # idf of a word that no template has


def compile_templates(templates: list[tuple[str, str]]) -> Model:
    """The vectors of templates, in order of name and text."""
    some = sorted(templates)
    words = [words_of(text) for _, text in some]
    df = Counter(w for ws in words for w in set(ws))
    idf = {w: math.log(1 + len(some) / n) for w, n in df.items()}
    vectors = []
    for ws in words:
        raw = {w: (1 + math.log(n)) * idf[w] for w, n in Counter(ws).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        vectors.append({w: v / norm for w, v in sorted(raw.items())})
    return Model([name for name, _ in some], words, vectors, idf, math.log(1 + len(some)))


def header_model(headers: dict[str, list[str]] | None = None) -> Model:
    given = HEADERS if headers is None else headers
    return compile_templates([(name, t) for name, some in given.items() for t in [*some, *short_forms(name)]])


def anchors(model: Model) -> list[tuple[int, str, int]]:
    """(template, word, offset): each template's rarest words that aren't plain, and where they stand first."""
    out = []
    for k, ws in enumerate(model.words):
        some = sorted({w for w in ws if w not in PLAIN and not w.isdigit()}, key=lambda w: (-model.idf[w], ws.index(w)))
        out += [(k, w, ws.index(w)) for w in some[:_ANCHORS] or ws[:1]]
    return out


def could_reach(model: Model, whole: float) -> str:
    """SQL on ``ws`` (a text's words) and ``known`` (those that the model has): false only where
    the text can't reach ``whole`` with any template.

    The cosine is at most the root of the share that known words make of the text's squared
    length. A distinct unknown word adds at least unknown ** 2 to it. What known words add, the sum of
    ((1 + ln tf) * idf) ** 2, is at most 4 / e for each occurrence times the greatest idf ** 2 of
    its kind: words of half the templates or more, and rarer ones.
    """
    half = math.log(3)
    rare = [w for w, v in model.idf.items() if v > half]
    inside = f"({half**2!r}D * (size(known) - rare) + {max(model.idf.values(), default=0.0) ** 2!r}D * rare)".replace("rare", f"size(filter(known, w -> w in ({_listed(rare)})))")
    return f"{model.unknown**2 * whole**2!r}D * (size(array_distinct(ws)) - size(array_distinct(known))) <= {4 / math.e * (1 - whole**2) + 1e-9!r}D * {inside}"


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def scan(files: DataFrame, id_col: str, path_col: str, text_col: str, headers: dict[str, list[str]] | None = None, texts: dict[str, str] | None = None, threshold: float = 0.7, whole: float = 0.8, cover: float = 0.5) -> DataFrame:
    """(id, path, license, cosine, is_license_file) of every file; license is null where none is found."""
    spark = files.sparkSession
    short, long = header_model(headers), compile_templates(sorted((license_texts() if texts is None else texts).items()))
    at = anchors(short)
    before = max(offset for _, _, offset in at)
    after = max(len(short.words[k]) - offset for k, _, offset in at)

    files = files.select(quoted(id_col).alias("id"), quoted(path_col).cast("string").alias("path"), F.lower(F.coalesce(quoted(text_col).cast("string"), F.lit(""))).alias("text"))
    rows = files.select(F.monotonically_increasing_id().alias("uid"), "id", "path", F.filter(F.split("text", "[^a-z0-9]+"), lambda w: w != "").alias("ws"))
    places = f"filter(transform(ws, (w, i) -> if(w in ({_listed({w for _, w, _ in at})}), i, -1)), i -> i >= 0)"
    near = f"transform(places, i -> named_struct('at', i, 'word', ws[i], 'from', greatest(i - {before}, 0), 'near', slice(ws, greatest(i - {before}, 0) + 1, {before + after})))"
    rows = rows.withColumn("known", F.expr(f"filter(ws, w -> w in ({_listed(long.idf)}))" if long.idf else "filter(ws, w -> false)"))
    likely = f"size(known) > 0 and {could_reach(long, whole)}" if long.idf else "false"
    rows = rows.withColumn("places", F.expr(places))
    table = settle(rows.select("uid", "id", "path", F.size("ws").alias("n_words"), F.expr(near).alias("spots"), F.expr(f"if({likely}, ws, null)").alias("ws")), "licenses")

    # Headers: one window for each anchor that stands in a text and each template of the anchor.
    known = [(short.names[k], k, word, offset, len(short.words[k]), short.vectors[k]) for k, word, offset in at]
    templates = F.broadcast(spark.createDataFrame(known, "license string, template int, word string, offset int, size int, vector map<string,double>"))
    idf = "map(" + ", ".join(f"'{w}', {v!r}D" for w, v in sorted(short.idf.items())) + ")"
    spots = table.select("uid", F.explode("spots").alias("s")).select("uid", "s.at", "s.word", "s.from", "s.near").join(templates, "word")
    spots = spots.withColumn("start", F.expr("greatest(at - offset, 0)")).withColumn("win", F.expr("slice(near, start - from + 1, at - offset + size - start)"))
    spots = spots.withColumn("own", F.array_distinct("win"))
    spots = spots.withColumn("weights", F.expr(f"transform(own, w -> (1 + ln(size(filter(win, x -> x = w)))) * coalesce(try_element_at({idf}, w), {short.unknown!r}D))"))
    dot = "aggregate(zip_with(own, weights, (w, v) -> v * coalesce(try_element_at(vector, w), 0D)), 0D, (s, x) -> s + x)"
    norm = "sqrt(aggregate(weights, 0D, (s, x) -> s + x * x))"
    shared = "5 * size(filter(own, w -> map_contains_key(vector, w))) >= 3 * size(vector)"
    spots = spots.where(shared).select("uid", "license", "size", F.struct("start", F.size("win").alias("n")).alias("span"), F.expr(f"round({dot} / {norm}, 9)").alias("cosine"))
    order = F.struct((-F.col("cosine")).alias("c"), (-F.col("size")).alias("s"), "license")
    found = spots.where(F.col("cosine") >= threshold).groupBy("uid").agg(F.min_by(F.struct("license", "cosine"), order).alias("m"), F.collect_set("span").alias("spans"))
    found = found.select(F.col("uid").alias("of"), "m", F.expr("size(array_distinct(flatten(transform(spans, x -> sequence(x.start, x.start + x.n - 1)))))").alias("covered"))

    # License files: whole texts that hold enough of the templates' words.
    vectors = [(name, w, v) for name, vector in zip(long.names, long.vectors) for w, v in vector.items()]
    weights = spark.createDataFrame([(w, v) for w, v in long.idf.items()], "word string, idf double")
    counted = table.where("ws is not null").select("uid", F.explode("ws").alias("word")).groupBy("uid", "word").agg(F.count("*").alias("tf"))
    counted = counted.join(F.broadcast(weights), "word", "left").select("uid", "word", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(long.unknown))).alias("v"))
    counted = settle(counted, "licenses-words")
    norms = counted.groupBy("uid").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = counted.join(F.broadcast(spark.createDataFrame(vectors, "license string, word string, part double")), "word").groupBy("uid", "license").agg(F.sum(F.col("v") * F.col("part")).alias("dot"))
    alike = dots.join(norms.hint("merge"), "uid").select("uid", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine")).where(F.col("cosine") >= whole)
    best = F.min_by(F.struct("license", "cosine"), F.struct((-F.col("cosine")).alias("c"), "license"))
    alike = alike.groupBy("uid").agg(best.alias("f")).select(F.col("uid").alias("of_file"), "f")

    rows = table.drop("spots", "ws").join(found, table["uid"] == found["of"], "left").join(alike, table["uid"] == alike["of_file"], "left")
    named = F.coalesce(F.col("path").rlike(_FILE), F.lit(False))
    told = F.coalesce("f", "m")
    gives = F.col("f").isNotNull() | named | (F.coalesce("covered", F.lit(0)) >= cover * F.col("n_words"))
    return rows.select("id", "path", told["license"].alias("license"), told["cosine"].alias("cosine"), (told.isNotNull() & F.col("path").isNotNull() & gives).alias("is_license_file"))


def inherit(scanned: DataFrame) -> DataFrame:
    """scanned with ``effective`` license, ``how`` (own, inherited, none) and ``from_folder``."""
    scanned = settle(scanned.withColumn("folder", F.regexp_replace("path", "/?[^/]*$", "")), "licenses-scanned")
    best = F.min_by("license", F.struct((~F.col("path").rlike(_FILE)).alias("n"), (-F.col("cosine")).alias("c"), "license"))
    givers = settle(scanned.where("is_license_file").groupBy(F.col("folder").alias("giver")).agg(best.alias("given")), "licenses-givers")
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above")))
    above = F.when(F.col("folder") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above")))).otherwise(above)
    asking = scanned.where("license is null and path is not null").select("folder").distinct().select("folder", F.explode(above).alias("at"))
    asking = settle(asking.select("folder", "at.depth", "at.above"), "licenses-folders")
    # Written tables on both sides: neither is broadcast by a wrong estimate, and a hot key can be split.
    got = asking.join(givers.hint("merge"), asking["above"] == givers["giver"]).groupBy("folder").agg(F.max_by(F.struct("giver", "given"), "depth").alias("from"))
    got = settle(got.select(F.col("folder").alias("of"), "from"), "licenses-given")
    rows = scanned.join(got.hint("merge"), F.when(F.col("license").isNull(), F.col("folder")) == got["of"], "left")
    return rows.select(
        "id",
        "path",
        "license",
        "cosine",
        "is_license_file",
        F.coalesce("license", "from.given").alias("effective"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("from").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.col("from.giver").alias("from_folder"),
    )
