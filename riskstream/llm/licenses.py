"""License notices by an exact set-similarity join with templates, and the places of license names.

A text's words are cut into overlapping blocks, for each template of blocks twice as long as it at least (a power of two of
words, ``sizes``), one starting in the middle of the other: so each passage as long as the template lies in one block. A
block holds a template if ``100 * |block and template| >= containment * |template|`` for their sets of words.

The join finds every such pair. Words of templates are ordered by their number in the whole corpus, rarest first, and a set
is the sorted list of its words' ranks. If two sets have ``need`` words in common, the first of them is among the template's
first ``|template| - need + 1`` and among the block's first ``|block| - need + 1`` (prefix filter); a block needs ``need`` words
of templates at all (length filter); and from the place of the first common word on, both must have ``need`` words left
(positional filter). Words outside all templates are in no intersection, so blocks are kept without them. The pairs that are
left are counted in full. Templates are a parameter and their index is joined by broadcast, at most ``MOST`` words of them.

Defined results: a null or empty text has no words and no labels, score 0; repeated rows each have their result; equal
containments are one score; an empty table gives no rows; templates without words match nothing; other columns are ignored.
Texts are read whole, in stretches of ``STRETCH`` characters, so that the words of a very long one are never all held.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskstream.llm.common import materialize, ship_package, slices

CONTAINMENT = 80  # percent of a template's words
MOST = 1_000_000  # words of all templates
STRETCH = 1 << 20
SMALLEST = 16  # words of a block

#: Names of licenses: each place of one counts.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices and grants as licenses ask for them. Fixed values, public texts.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
            "later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_GAP = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]")
_SCANNED = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, "
            "blocks array<struct<size:int,start:bigint,ranks:array<int>>>")


def words(text: str) -> Iterator[list[str]]:
    """The words of a text, lower-cased, stretch by stretch."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, min(len(text), at + STRETCH))
        end = gap.start() if gap else len(text)
        yield _WORD.findall(text[at:end].translate(_UPPER))
        at = end


def _words(text: str) -> list[str]:
    return [w for part in words(text) for w in part]


def block_size(n_words: int) -> int:
    """Words of the blocks for a template of ``n_words``: a power of two, twice as many at least."""
    return max(SMALLEST, 1 << (2 * n_words - 1).bit_length())


def templates_of(templates: list[tuple[str, str]], containment: int) -> list[dict]:
    """label, set of words, block size and the words needed of each template that has words."""
    out = []
    for i, (label, text) in enumerate(templates):
        w = _words(text)
        if w:
            out.append({"no": i, "label": label, "words": sorted(set(w)), "size": block_size(len(w)),
                        "need": max(1, -(-containment * len(set(w)) // 100))})
    if sum(len(t["words"]) for t in out) > MOST:
        raise ValueError(f"more than {MOST} words in the templates")
    return out


def frequencies(docs: DataFrame, wanted: set[str]) -> dict[str, int]:
    """How often each word of ``wanted`` stands in all texts. The wanted words bound what a task sends and the driver gets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in slices(batches, 4 << 20):
            for text in b.column("text"):
                for part in words(text.as_py() or ""):
                    total.update(w for w in part if w in wanted)
        yield pa.RecordBatch.from_pydict({"word": list(total), "n": pa.array(list(total.values()), pa.int64())},
                                         pa.schema([("word", pa.string()), ("n", pa.int64())]))

    ship_package(docs.sparkSession)
    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def blocks_of(places: np.ndarray, ranks: np.ndarray, n_words: int, size: int, least: int) -> list[dict]:
    """The blocks of ``size`` words with ``least`` distinct ranks or more; ``places`` are the words that have the ``ranks``."""
    half = size // 2
    n = max(1, -(-n_words // half) - 1)
    of = places // half
    counts = np.bincount(of, minlength=n + 1)
    out = []
    for b in np.flatnonzero(counts[:n] + counts[1:n + 1] >= least):
        distinct = np.unique(ranks[np.searchsorted(of, b):np.searchsorted(of, b + 1, side="right")])
        if len(distinct) >= least:
            out.append({"size": size, "start": int(b) * half, "ranks": distinct.tolist()})
    return out


def _scan(rank: dict[str, int], sizes: dict[int, tuple[list[int], int]], phrases: dict[str, str]):
    """Per text its words, the places of phrases and the blocks that pass the length filter."""
    named = [(tuple(_words(p)), label) for p, label in phrases.items()]
    firsts: dict[str, list] = {}
    for p, label in named:
        firsts.setdefault(p[0], []).append((p, label))
    longest = max((len(p) for p, _ in named), default=1)
    member = {}
    for size, (inside, least) in sizes.items():
        member[size] = (np.isin(np.arange(len(rank)), inside), least)

    def one(text: str) -> tuple:
        n, found, places, ranks, tail = 0, [], [], [], []
        for part in words(text):
            joined = tail + part
            for i, w in enumerate(joined):
                for p, label in firsts.get(w, ()):
                    if i + len(p) > len(tail) and tuple(joined[i:i + len(p)]) == p:
                        found.append((n - len(tail) + i, label))
            for i, w in enumerate(part):
                r = rank.get(w)
                if r is not None:
                    places.append(n + i)
                    ranks.append(r)
            n += len(part)
            tail = joined[len(joined) - longest + 1:] if longest > 1 else []
        at, of, blocks = np.array(places, np.int64), np.array(ranks, np.int64), []
        for size, (inside, least) in member.items():
            if len(of) >= least:
                keep = inside[of]
                blocks += blocks_of(at[keep], of[keep], n, size, least)
        starts = [f[0] for f in found]
        return n, len(found), min(starts, default=None), max(starts, default=None), sorted({f[1] for f in found}), blocks

    names = [c.split()[0] for c in _SCANNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.struct([("size", pa.int32()), ("start", pa.int64()), ("ranks", pa.list_(pa.int32()))])
        schema = pa.schema([*[(c, pa.int64()) for c in names[:5]], ("base", pa.list_(pa.string())), ("blocks", pa.list_(block))])
        for b in slices(batches, 4 << 20):
            results = [one(t.as_py() or "") for t in b.column("text")]
            columns = [b.column("doc_id"), *([r[i] for r in results] for i in range(6))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type)
                                              for c, f in zip(columns, schema)], schema=schema)

    return run


def _index(spark: SparkSession, templates: list[dict], rank: dict[str, int]) -> DataFrame:
    """The prefix words of every template, with what the filters need."""
    rows = []
    for t in templates:
        ranks = sorted(rank[w] for w in t["words"])
        for i in range(len(ranks) - t["need"] + 1):
            rows.append((t["no"], t["label"], t["size"], ranks[i], i, len(ranks), t["need"], ranks))
    return spark.createDataFrame(rows, "no int, label string, t_size int, t_rank int, t_at int, t_words int, need int, t_ranks array<int>")


def scanned(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: int = CONTAINMENT) -> tuple[DataFrame, DataFrame]:
    """The written scan of ``docs`` (doc_id, text), a row a document with its number ``row``, and its matches: every block that
    holds a template (row, doc_id, label, no, start, end, overlap, containment); start and end are words, end exclusive."""
    spark = docs.sparkSession
    ship_package(spark)
    kinds = templates_of(templates, containment)
    wanted = {w for t in kinds for w in t["words"]}
    uses = frequencies(docs, wanted)
    rank = {w: i for i, w in enumerate(sorted(wanted, key=lambda w: (uses.get(w, 0), w)))}
    sizes = {}
    for t in kinds:
        inside, least = sizes.get(t["size"], ([], t["need"]))
        sizes[t["size"]] = (inside + [rank[w] for w in t["words"]], min(least, t["need"]))
    scan = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(rank, sizes, phrases), _SCANNED)
    scan = materialize(scan.withColumn("row", F.monotonically_increasing_id()), "licenses-scan")
    blocks = scan.select("row", "doc_id", "n_words", F.explode("blocks").alias("b"))
    places = blocks.select("row", "doc_id", "n_words", "b.size", "b.start", "b.ranks", F.posexplode("b.ranks").alias("at", "rank"))
    hits = places.join(F.broadcast(_index(spark, kinds, rank)), (F.col("rank") == F.col("t_rank")) & (F.col("size") == F.col("t_size")))
    n = F.size("ranks")
    hits = hits.where((n >= F.col("need")) & (F.col("at") <= n - F.col("need"))  # length filter, the block's prefix
                      & (1 + F.least(n - F.col("at") - 1, F.col("t_words") - F.col("t_at") - 1) >= F.col("need")))
    common = F.array_intersect("ranks", "t_ranks")
    hits = hits.withColumn("common", common).where((F.col("common")[0] == F.col("rank")) & (F.size("common") >= F.col("need")))
    return scan, hits.select("row", "doc_id", "label", "no", "start", F.least(F.col("start") + F.col("size"), "n_words").alias("end"),
                             F.size("common").alias("overlap"), (F.size("common") / F.col("t_words")).alias("containment"))


def labelled(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: int = CONTAINMENT) -> DataFrame:
    """Per document its words, the places of license names and all labels; the score is 1 with a name, else the largest
    containment of a template that is reached, else 0."""
    scan, matches = scanned(docs, templates, phrases, containment)
    best = matches.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    joined = scan.drop("blocks").join(best, "row", "left")
    both = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
                         F.array_join(both, ",").alias("labels"),
                         F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
