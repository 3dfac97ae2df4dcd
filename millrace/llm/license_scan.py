"""License scans by a positional index of rare words, in DataFrame expressions alone.

A template is a passage of a licence or of its notice with mandatory key phrases; longer texts are several passages.
Of each key phrase the ``ANCHORS`` words of highest inverse document frequency, counted over all texts, are indexed
with their positions in the template; a place that verifies has every key phrase whole, so none lacks them. In a file
the index words are looked up; each occurrence of one proposes the place where a template that holds it there would
start, and the proposals of a template's index words are intersected by that place. What is left is verified: every
key phrase must be in place, and the share of the template's words in place is the place's score. A template's label
stands from a score of ``LEAST`` on; the file's score is the highest of any template. The fixed base phrases are found
in the same way, by their rarest word, and must match whole.

Everything but the one count of document frequencies is a projection: no shuffle, and a file without index words
costs no more than its split into words. Null texts are empty: no words, no labels, a score of 0. Repeated rows have
the same labels; words of equal frequency are ranked by themselves, which changes the cost and not the result.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import others

LEAST, ANCHORS = 0.6, 2

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label, wording, key phrases of public licences' notices and texts, passage by passage.
TEMPLATES = [
    ("mit", "released under the mit license", ["the mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", ["to deal in the software without restriction"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["in compliance with the license", "apache org licenses license 2 0"]),
    ("apache-2", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form", ["each contributor hereby grants to you a perpetual worldwide", "copyright license to reproduce"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["under the terms of the gnu general public license", "version 3 of the license"]),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["under the terms of the gnu general public license", "version 2 of the license"]),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu affero general public license", "version 3 of the license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", ["copy of the mpl was not distributed with this file"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license 2 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", ["to the extent possible under law", "related and neighboring rights"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce"]),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["neither the name of", "endorse or promote products derived from this software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", ["this permission notice appear in all copies"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["without any express or implied warranty", "in no event will the authors be held liable"]),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", ["the origin of this software must not be misrepresented"]),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["any person or organization obtaining a copy"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["anyone is free to copy modify publish use compile sell or distribute this software"]),
]

FIELDS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def word_array(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z in lower case."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _strings(values) -> Column:
    """The words as an array, which the optimizer folds to a constant."""
    return F.split(F.lit(" ".join(values)), " ")


def _vocabulary(templates) -> list[str]:
    """The words that may be indexed: those of key phrases."""
    return sorted({w for _, _, keys in templates for key in keys for w in key.split()} | {w for phrase in BASE for w in phrase.split()})


def document_frequencies(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> dict[str, int]:
    """In how many texts each word of the key phrases occurs; one row a word reaches the driver."""
    words = _vocabulary(templates)
    found = docs.select(F.explode(F.array_intersect(word_array(F.col(text)), _strings(words))).alias("w"))
    return dict.fromkeys(words, 0) | {r.w: r.n for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}


def _place(wanted: list[str], phrase: list[str]) -> int:
    return next(j for j in range(len(wanted)) if wanted[j : j + len(phrase)] == phrase)


def _standing(words: Column, start: Column, wanted: list[str]) -> Column:
    """How many of the wanted words stand at their places from ``start`` on."""
    return F.size(F.filter(_strings(wanted), lambda w, j: F.coalesce(F.get(words, start + j) == w, F.lit(False))))


def license_scan(docs: DataFrame, frequencies: dict[str, int], templates=TEMPLATES, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the base phrases' places and labels and the templates' labels and score."""
    keep = others(docs.columns if keep is None else keep, FIELDS)
    rare = lambda ws, n: sorted(set(ws), key=lambda w: (frequencies.get(w, 0), w))[:n]
    plans = []
    for label, wording, keys in templates:
        wanted = wording.split()
        anchors: list[int] = []
        for key in map(str.split, keys):
            at = _place(wanted, key)
            # Of a word that stands twice in the template, the file has each; its first place is enough.
            own = {wanted[j]: j for j in reversed(range(at, at + len(key)))}
            anchors += [own[w] for w in rare(key, ANCHORS)]
        plans.append((label, wanted, keys, anchors))
    phrase_anchor = {phrase: rare(phrase.split(), 1)[0] for phrase in BASE}
    index = sorted({wanted[j] for _, wanted, _, anchors in plans for j in anchors} | set(phrase_anchor.values()))
    none = F.array().cast("array<struct<w:string,at:int>>")

    words = F.col("_words")
    hit = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda x: x["w"].isin(index))
    df = docs.select(*[F.col(f"`{c}`") for c in keep], word_array(F.col(f"`{text}`")).alias("_words"))
    df = df.withColumn("_hits", F.when(F.arrays_overlap(words, _strings(index)), hit).otherwise(none))

    def proposed(word: str, place: int) -> Column:
        """Where a wording that has the word at the place would start."""
        return F.transform(F.filter("_hits", lambda x: x["w"] == word), lambda x: x["at"] - place)

    def whole(starts: Column, wanted: list[str]) -> Column:
        return F.filter(starts, lambda s: _standing(words, s, wanted) == len(wanted))

    def score(wanted: list[str], keys: list[str]):
        def at(s: Column) -> Column:
            in_place = F.lit(True)
            for key in map(str.split, keys):
                in_place = in_place & (_standing(words, s + _place(wanted, key), key) == len(key))
            return F.when(in_place, _standing(words, s, wanted) / F.lit(float(len(wanted)))).otherwise(F.lit(0.0))

        return at

    places, found = {}, {}
    for k, (phrase, anchor) in enumerate(phrase_anchor.items()):
        wanted = phrase.split()
        places[phrase] = f"_base{k}"
        found[f"_base{k}"] = whole(proposed(anchor, wanted.index(anchor)), wanted)
    scores = [f"_score{k}" for k in range(len(plans))]
    for name, (_, wanted, keys, anchors) in zip(scores, plans, strict=True):
        starts = reduce(F.array_intersect, [proposed(wanted[j], j) for j in anchors])
        best = F.coalesce(F.array_max(F.transform(starts, score(wanted, keys))), F.lit(0.0))
        found[name] = F.when(F.size("_hits") > 0, best).otherwise(F.lit(0.0))
    df = df.withColumns(found)

    every = F.flatten(F.array(*[F.col(c) for c in places.values()]))
    base = lambda: [F.when(F.size(c) > 0, F.lit(BASE[p])) for p, c in places.items()]
    method = [F.when(F.col(c) >= LEAST, F.lit(plans[k][0])) for k, c in enumerate(scores)]
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")
    return df.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("_words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        joined(base()).alias("base_labels"),
        joined(base() + method).alias("labels"),
        F.greatest(*[F.col(c) for c in scores]).alias("score"),
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return license_scan(docs, document_frequencies(docs), keep=["doc_id"])
