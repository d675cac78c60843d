"""License scans with a positional rare-token index.

A file is reduced to the places of its licence words.  The index maps the rarest
key words of each notice below, by document counts over the whole corpus, to
their places; each hit votes for a notice and the place where that notice would
begin, and votes that agree are one alignment.  An alignment with the votes of all
its notice's rarest words counts if the other key words stand at their places too,
so every notice whose key phrase is there is found, whatever else is.  Beside that,
the base phrases are found wherever their words stand in a row.  DataFrame
expressions only; nothing but word counts is shuffled.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.columns import ascii_lower, let, placed
from weftline.session import materialize, spread

#: The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Customary notices as their stewards publish them, each with its label and the key phrase that must be there.
NOTICES = [
    ("agpl", "GNU Affero General Public License", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("all-rights-reserved", "All rights reserved", "All rights reserved"),
    ("apache-2.0", "Apache License Version 2 0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Apache License Version 2 0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "CC BY NC", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "Creative Commons Attribution 4 0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-2.0", "General Public License version 2", "under the terms of the GNU General Public License, version 2"),
    ("gpl-3.0", "General Public License version 3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "GNU General Public License as published", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "purpose with or without fee is hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "MIT License", "Released under the MIT License"),
    ("mit", "Permission is hereby granted free of charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "Mozilla Public License", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "unencumbered software released into the public domain", "This is free and unencumbered software released into the public domain"),
]
#: Function words are not in the index.
PLAIN = {"a", "and", "any", "are", "as", "is", "in", "into", "it", "of", "or", "that", "the", "this", "to", "with"}
#: The votes an alignment needs, one from each of so many rarest key words of its notice.
VOTES = 2

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _terms(text: str) -> list[tuple[int, str]]:
    """(place, word) of the indexed words of a notice or phrase."""
    return [(i, w) for i, w in enumerate(re.findall(r"[0-9a-z]+", text.lower())) if w not in PLAIN]


def _templates() -> list[tuple[str, list[tuple[int, str]], list[tuple[int, str]]]]:
    """(label, indexed words, key words), places within the notice."""
    out = []
    for label, key, text in NOTICES:
        whole, wanted = re.findall(r"[0-9a-z]+", text.lower()), re.findall(r"[0-9a-z]+", key.lower())
        at = next(i for i in range(len(whole)) if whole[i : i + len(wanted)] == wanted)
        out.append((label, _terms(text), [(at + i, w) for i, w in _terms(key)]))
    return out


TEMPLATES = _templates()
VOCABULARY = sorted({w for _, terms, _ in TEMPLATES for _, w in terms} | {w for p in PHRASES for w in p.split()})


def file_words(text: Column) -> Column:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` runs after A-Z are in lower case."""
    whole = F.coalesce(text, F.lit(""))
    # lower() differs from the ASCII rule in ASCII results for these two letters alone
    small = F.when(whole.rlike("[İK]"), ascii_lower(whole)).otherwise(F.lower(whole))
    return F.array_remove(F.split(small, _BREAK), "")


def phrase_places(hits: Column, phrase: str) -> Column:
    """Where the words of a phrase stand in a row; all of them are indexed, so they are neighbours among the hits."""
    ws = phrase.split()

    def starts(j: Column) -> Column:
        same = F.get(hits, j)["w"] == ws[0]
        for k, w in enumerate(ws[1:], 1):
            same &= (F.get(hits, j + k)["w"] == w) & (F.get(hits, j + k)["i"] == F.get(hits, j)["i"] + k)
        return F.coalesce(same, F.lit(False))

    places = F.filter(F.sequence(F.lit(0), F.size(hits) - 1), starts)
    return F.when(F.size(hits) < len(ws), F.array().cast("array<int>")).otherwise(F.transform(places, lambda j: F.get(hits, j)["i"]))


def _struct_array(rows: list[tuple[int, str]]) -> str:
    return "array(" + ",".join(f"named_struct('p',{p},'w','{w}')" for p, w in rows) + ")"


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with n_words, the base places and every alignment that counts.

    ``base``: array of (label, place); ``found``: array of (label, place, votes, share of
    the notice's words that stand at their places).
    """
    ws = file_words(F.col("text"))
    hits = let(ws, lambda x: F.struct(F.size(x).alias("n"), F.filter(F.transform(x, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: h["w"].isin(VOCABULARY)).alias("hits")))
    held = materialize(spread(docs.select(*dict.fromkeys([*keep, "text"]))).select(*keep, hits.alias("_f")).select(*keep, F.col("_f.n").cast("long").alias("n_words"), F.col("_f.hits").alias("hits")), "licences")

    counts = held.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w")).groupBy("w").count()
    seen = {r["w"]: r["count"] for r in counts.collect()}  # a row a word of the vocabulary at most
    total = held.count()
    idf = {w: math.log((total + 1) / (seen.get(w, 0) + 1)) for w in VOCABULARY}
    rarest = [(t, p, w) for t, (_, _, key) in enumerate(TEMPLATES) for p, w in sorted(key, key=lambda k: (-idf[k[1]], k))[:VOTES]]  # of equal ones the first in the notice

    anchors = sorted({w for _, _, w in rarest})
    postings = F.expr("map(" + ",".join(f"'{w}',array(" + ",".join(f"named_struct('t',{t},'p',{p})" for t, p, x in rarest if x == w) + ")" for w in anchors) + ")")
    labels = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    bodies = F.expr("array(" + ",".join(_struct_array(terms) for _, terms, _ in TEMPLATES) + ")")
    keys = F.expr("array(" + ",".join(_struct_array(key) for _, _, key in TEMPLATES) + ")")

    col = F.col("hits")
    cast_votes = F.array_sort(F.flatten(F.transform(F.filter(col, lambda h: h["w"].isin(anchors)), lambda h: F.transform(postings[h["w"]], lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("o"))))))
    # equal votes are neighbours: a vote that ends a run of two or more is an alignment
    runs = let(cast_votes, lambda v: F.filter(F.transform(v, lambda x, i: F.when((x == F.get(v, i - 1)) & ~(x.eqNullSafe(F.get(v, i + 1))), x)), lambda x: x.isNotNull()))
    kind = "array<struct<label:string,place:int,share:double>>"

    def aligned(words: Column) -> Column:
        there = lambda a: lambda k: F.coalesce(F.get(words, a["o"] + k["p"]) == k["w"], F.lit(False))
        good = F.filter(runs, lambda a: F.forall(keys[a["t"]], there(a)))
        return F.transform(good, lambda a: F.struct(labels[a["t"]].alias("label"), a["o"].alias("place"), (F.size(F.filter(bodies[a["t"]], there(a))) / F.size(bodies[a["t"]])).alias("share")))

    by_place = placed(col, lambda h: h["w"], lambda h: h["i"], "string")
    found = F.when(F.size(col) < VOTES, F.array().cast(kind)).when(F.size(runs) == 0, F.array().cast(kind)).otherwise(let(by_place, aligned))
    return held.select(*keep, "n_words", _base(col).alias("base"), found.alias("found"))


def _base(hits: Column) -> Column:
    return F.array_sort(F.concat(*[F.transform(phrase_places(hits, p), _labelled(label)) for p, label in PHRASES.items()]))


def _labelled(label: str):
    return lambda i: F.struct(i.alias("place"), F.lit(label).alias("label"))


def license_documents(docs: DataFrame) -> DataFrame:
    """The digest of the scan of every row of ``docs``.

    ``score`` is 1 with a base label, else the largest share of a notice that was
    found, 0 without any label.  Nulls: a null text is empty, has no words and no
    labels; a null doc_id is kept.  Equal rows get equal results.  An empty table
    gives no rows.  Of ``docs`` only doc_id and text are read.
    """
    found = scan(docs, ["doc_id"])
    named = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    share = F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.get("base", F.lit(0))["place"].cast("long").alias("first_word"),
        F.when(F.size("base") > 0, F.element_at("base", -1)["place"]).cast("long").alias("last_word"),
        joined(named(F.col("base"))).alias("base_labels"),
        joined(F.concat(named(F.col("base")), named(F.col("found")))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )
