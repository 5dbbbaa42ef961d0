"""License scans by diagonal voting, in DataFrame functions only.

Every rolling word 3-gram of every whole text is hashed and joined to the hashed 3-grams of the
templates (a constant table of a few hundred rows, hence broadcast). A match of document position p
and template position t votes for the diagonal p - t; the three words are compared, so no vote rests
on a hash. Votes are pre-aggregated by document, template and diagonal before the only shuffle, to
the set of template positions that voted: a 3-gram that a text repeats counts once.

Neighbouring diagonals (words put in or left out) are merged: those so few words apart that edits
can explain it. Let a template have n words and k = n / 8, rounded down. Each edit spoils three
3-grams at most, so merged diagonals on which fewer than n - 2 - 3k different 3-grams voted cannot
hold the template and are passed over. Other spans are verified in order: a template is found where
a run of words that starts within s = min(k, 3) words of the diagonal, and is at most s words longer
or shorter than the template, is no more than k word edits from it. Words are compared as one
character each, so the edit distance is Spark's own. Where runs found for different labels overlap,
such as those of two versions of a license, the ones with the fewest edits count.

Defined results: a null text has no words; a null doc_id is a document of its own text; repeated
rows give repeated, equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandforge.llm.common import ascii_words

K = 3
#: A template of n words is found within n // EDIT_SHARE word edits, at most MAX_SHIFT words off a diagonal.
EDIT_SHARE = 8
MAX_SHIFT = 3
#: Code of a word that the template does not have, and the one before its first word's.
_OTHER, _FIRST = 1, 1

#: Phrases whose every place is reported (label, words).
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Public license notices, as normalised words (label, words).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "this project is licensed under the terms of the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl-3", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)

_SENTINEL = 0  # the hash that stands for "this row exists"; hits are compared word by word anyway


def edits(n: int) -> int:
    """Word edits within which a template of n words is found."""
    return n // EDIT_SHARE


def shift(n: int) -> int:
    """How far from a diagonal, and how much longer or shorter, a run may be."""
    return min(edits(n), MAX_SHIFT)


def template_table(spark: SparkSession, base=BASE_PHRASES, templates=TEMPLATES) -> DataFrame:
    """tid, label, is_base, tw (words), known (different words), code (a character a word): a constant relation."""
    rows = []
    for i, (label, text) in enumerate((*base, *templates)):
        words = text.split(" ")
        known = list(dict.fromkeys(words))
        if len(known) > 250 or len(words) < K:
            raise ValueError(f"a template has {K} words or more, and 250 different ones at most: {text[:60]!r}")
        code = "".join(chr(_FIRST + 1 + known.index(w)) for w in words)
        values = {"tid": i, "label": label, "is_base": i < len(base), "edits": edits(len(words)), "shift": shift(len(words)), "code": code}
        rows.append(F.struct(*[F.lit(v).alias(k) for k, v in values.items()], F.array(*map(F.lit, words)).alias("tw"), F.array(*map(F.lit, known)).alias("known")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def _coded(words: Column, known: Column) -> Column:
    """Words as one character each."""
    return F.array_join(F.transform(words, lambda w: F.char(F.when(F.array_contains(known, w), F.array_position(known, w) + _FIRST).otherwise(_OTHER))), "")


def diagonals(docs: DataFrame, base=BASE_PHRASES, templates=TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What voted, by document, template and diagonal; each document also has one row of tid -1.

    Columns: doc_id, text_hash, n_words, tid, diag, votes, places (template positions that voted, each
    once) and near (the document's words around the diagonal, a character each, from word near_at on).
    """
    meta = template_table(docs.sparkSession, base, templates)
    gram = lambda w, i: (F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    grams = (
        meta.select("tid", "known", "shift", F.size("tw").alias("n"), "tw", F.posexplode(F.sequence(F.lit(0), F.size("tw") - K)).alias("tpos", "at"))
        .select("tid", "known", "shift", "n", "tpos", *[x.alias(f"t{k}") for k, x in enumerate(gram(F.col("tw"), F.col("at")))])
        .withColumn("hash", F.xxhash64("t0", "t1", "t2"))
    )
    nothing = F.lit(None).cast("string")
    sentinel = docs.sparkSession.range(1).select(
        F.lit(-1).alias("tid"), F.lit(None).cast("array<string>").alias("known"), F.lit(0).alias("shift"), F.lit(0).alias("n"),
        F.lit(0).alias("tpos"), *[nothing.alias(f"t{k}") for k in range(K)], F.lit(_SENTINEL).cast("long").alias("hash"),
    )
    words = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), ascii_words(F.col(text)).alias("words"))
    hashes = F.concat(
        F.array(F.lit(_SENTINEL).cast("long")),
        F.transform("words", lambda w, i: F.xxhash64(w, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2))),
    )
    places = words.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), "words", F.posexplode(hashes).alias("at", "hash"))
    at = F.col("at") - 1
    same = (F.col("at") == 0) & (F.col("tid") == -1)
    for k in range(K):
        found = F.get("words", at + k) == F.col(f"t{k}")
        verified = found if k == 0 else verified & found
    hits = places.join(F.broadcast(grams.unionByName(sentinel)), "hash").where(same | ((F.col("at") > 0) & (F.col("tid") >= 0) & verified))
    diag = F.when(F.col("tid") >= 0, at - F.col("tpos")).otherwise(0)
    near_at = F.greatest(diag - F.col("shift"), F.lit(0))
    near = F.when(F.col("tid") >= 0, _coded(F.slice("words", near_at + 1, F.greatest(diag + F.col("n") + 2 * F.col("shift") - near_at, F.lit(0))), F.col("known")))
    hits = hits.select("doc_id", "text_hash", "n_words", "tid", diag.cast("long").alias("diag"), "tpos", near_at.alias("near_at"), near.alias("near"))
    return hits.groupBy("doc_id", "text_hash", "n_words", "tid", "diag").agg(
        F.count(F.lit(1)).alias("votes"), F.collect_set("tpos").alias("places"), F.first("near").alias("near"), F.first("near_at").alias("near_at")
    )


def license_spans(docs: DataFrame, base=BASE_PHRASES, templates=TEMPLATES, **columns) -> DataFrame:
    """One row per document, template and diagonal: what the merged diagonals around it cover and whether the template is there.

    Columns: doc_id, text_hash, n_words, rows, tid, label, is_base, diag, exact (all its words stand
    there), coverage (share of the template's 3-grams that voted on this and neighbouring diagonals),
    distance (word edits; null: it is not found), n (its words), beaten (a template of another label that
    overlaps has fewer edits). Documents keep a row of tid -1. ``rows`` is how many
    equal rows the input has.
    """
    votes = diagonals(docs, base, templates, **columns)
    per_doc = Window.partitionBy("doc_id", "text_hash")
    votes = votes.withColumn("rows", F.max(F.when(F.col("tid") == -1, F.col("votes"))).over(per_doc))
    meta = template_table(docs.sparkSession, base, templates).select("tid", "label", "is_base", "edits", "shift", "code", F.size("tw").alias("n"))
    found = votes.join(F.broadcast(meta), "tid", "left")
    # all diagonals that edits, and a start off the diagonal, can move votes to
    far = max(edits(len(t.split())) + shift(len(t.split())) for _, t in (*base, *templates))
    around = Window.partitionBy("doc_id", "text_hash", "tid").orderBy("diag").rangeBetween(-far, far)
    neighbours = F.filter(F.collect_list(F.struct("diag", "places")).over(around), lambda x: F.abs(x["diag"] - F.col("diag")) <= F.col("edits") + F.col("shift"))
    grams = F.col("n") - (K - 1)
    found = found.withColumn("covered", F.size(F.array_distinct(F.flatten(F.transform(neighbours, lambda x: x["places"])))))

    def distance(begin: Column, longer: Column) -> Column:
        start = F.col("diag") + begin
        run = F.substring("near", (start - F.col("near_at") + 1).cast("int"), (F.col("n") + longer).cast("int"))
        return F.when(start >= 0, F.levenshtein(run, F.col("code")))

    either = F.sequence(-F.col("shift"), F.col("shift"))
    least = F.array_min(F.flatten(F.transform(either, lambda a: F.transform(either, lambda b: distance(a, b)))))
    possible = (F.col("tid") >= 0) & (F.col("covered") >= grams - K * F.col("edits"))
    found = found.withColumn("least", F.when(possible, least)).withColumn("distance", F.when(F.col("least") <= F.col("edits"), F.col("least")))
    longest = max(len(t.split()) for _, t in (*base, *templates))
    near = Window.partitionBy("doc_id", "text_hash").orderBy("diag").rangeBetween(-longest, longest)
    runs = F.collect_list(F.when(F.col("distance").isNotNull(), F.struct("diag", "n", "distance", "label"))).over(near)
    overlap = lambda x: (x["diag"] < F.col("diag") + F.col("n")) & (F.col("diag") < x["diag"] + x["n"])
    beaten = F.exists(runs, lambda x: overlap(x) & (x["label"] != F.col("label")) & (x["distance"] < F.col("distance")))
    return found.select(
        "doc_id", "text_hash", "n_words", "rows", "tid", "label", F.coalesce("is_base", F.lit(False)).alias("is_base"), "diag",
        F.coalesce(F.size("places") == grams, F.lit(False)).alias("exact"),
        F.coalesce(F.col("covered") / grams, F.lit(0.0)).alias("coverage"),
        "distance", "n", F.coalesce(beaten, F.lit(False)).alias("beaten"),
    )


def license_scan(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the best of all templates: the share of words that are in place where one is found, or the
    share of 3-grams that merged diagonals cover (0: none).
    """
    spans = license_spans(docs, **options)
    base = F.col("is_base") & F.col("exact")
    added = ~F.col("is_base") & F.col("distance").isNotNull() & ~F.col("beaten")
    joined = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    return (
        spans.groupBy("doc_id", "text_hash", "n_words", "rows")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("diag"))).alias("first_word"),
            F.max(F.when(base, F.col("diag"))).alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined(F.when(base | added, F.col("label"))).alias("labels"),
            F.max(F.greatest("coverage", F.when(F.col("distance").isNotNull(), 1 - F.col("distance") / F.col("n")))).alias("score"),
        )
        .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_copy"))
        .drop("_copy")
    )
