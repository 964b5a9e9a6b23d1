"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are windows of ``BLOCK`` words at every ``STRIDE`` words of a text, so
that any stretch of STRIDE words lies within one block. A block matches a
template when it holds at least ``threshold`` of the template's distinct
tokens. The tokens of the templates are ordered by their frequency over all
documents, rarest first: a match must hold one of the first |T| - o + 1 of
them (prefix filter, o the tokens needed), a block needs o tokens at least
(length filter), and after the i-th token of the order has been found as the
first one, |T| - i + 1 remain and must be enough (positional filter). What passes is
counted exactly.

On top of these stand the base labels: phrases whose words stand
consecutively, looked for around their rarest word; the place of a phrase is the
number of words before it.

Defined results: a null or empty text has 0 words, no places, empty label
strings and score 0; overlapping templates all give their label; other columns
are ignored; repeated rows are rows of their own; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word; everything else separates words.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"

#: Base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Statements of well-known licenses and the labels they give.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "licensed under a creative commons attribution noncommercial license": "cc-by-nc",
    "licensed under a creative commons attribution sharealike license": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

THRESHOLD = 0.8
BLOCK, STRIDE = 64, 32


def _lower(text: Column) -> Column:
    # past A-Z, lower() only touches letters that no template or phrase has (and the Kelvin sign, a k)
    return F.lower(F.coalesce(text, F.lit("")))


def _parts(text: Column) -> Column:
    """The words of ``text`` in their order; the first and the last may be empty."""
    return F.split(_lower(text), f"{NOT_WORD}+")


def token_frequencies(df: DataFrame, tokens: list[str]) -> dict[str, int]:
    """Documents that hold each of the given tokens, over all documents; the result has a row per token at most."""
    kept = F.array_distinct(F.filter(_parts(F.col("text")), lambda w: w.isin(tokens)))
    rows = df.select(F.explode(kept).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


def scan(
    df: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    One pass over a text finds the places of prefix tokens and of each phrase's rarest
    word; only blocks around the former are formed, of template tokens alone, and
    what the length filter leaves of them meets the templates.
    """
    sets = {t: sorted(set(t.split())) for t in templates}
    if any(len(s) > STRIDE for s in sets.values()):
        raise ValueError("a template has more tokens than a block is sure to hold")
    tokens = sorted({w for s in sets.values() for w in s})
    often = token_frequencies(df, sorted({*tokens, *(w for p in phrases for w in p.split())}))
    rarity = lambda w: (often.get(w, 0), w)
    ordered = {t: sorted(s, key=rarity) for t, s in sets.items()}
    needed = {t: -int((1e-9 - threshold * len(s)) // 1) for t, s in ordered.items()}
    prefixes = {t: s[: len(s) - needed[t] + 1] for t, s in ordered.items()}
    rare = sorted({w for p in prefixes.values() for w in p})
    keys = {p: min(p.split(), key=rarity) for p in phrases}

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), _parts(F.col("text")).alias("w"))
    before = (F.element_at("w", 1) == "").cast("int")  # empty parts before the first word
    after = ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).isin(sorted({*rare, *keys.values()})))
    rows = rows.withColumns({"n_words": (F.size("w") - before - after).cast("long"), "before": before, "at": at})

    # blocks that hold a prefix token (prefix filter): of its place, the block begun last and the one before
    hits = F.filter("at", lambda i: F.get("w", i).isin(rare))
    near = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array(*[F.floor((i - F.col("before")) / STRIDE) - k for k in range(BLOCK // STRIDE)]))))
    begun = F.filter(near, lambda b: b >= 0)
    block = lambda b: F.slice("w", (b * STRIDE + F.col("before") + 1).cast("int"), F.lit(BLOCK))
    held = F.transform(begun, lambda b: F.array_distinct(F.filter(block(b), lambda w: w.isin(tokens))))
    least = min(needed.values())
    rows = rows.withColumn("blocks", F.filter(held, lambda b: F.size(b) >= least))  # length filter

    def best(template: str) -> Column:
        """The largest containment of the template in a block, where it meets the threshold; else 0."""
        of, o = ordered[template], needed[template]

        def containment(b: Column) -> Column:
            first = F.coalesce(*[F.when(F.array_contains(b, w), F.lit(i)) for i, w in enumerate(prefixes[template])])
            passes = (F.size(b) >= o) & first.isNotNull() & (len(of) - first >= o)
            both = F.size(F.array_intersect(b, F.array(*map(F.lit, of))))
            return F.when(passes & (both >= o), both / F.lit(len(of))).otherwise(0.0)

        found = F.coalesce(F.array_max(F.transform("blocks", containment)), F.lit(0.0))
        return F.when(F.size("blocks") > 0, found).otherwise(0.0)

    def places(phrase: str) -> Column:
        """Where the phrase begins, as numbers of words before it."""
        words, key = phrase.split(), phrase.split().index(keys[phrase])

        def stands(i: Column) -> Column:
            found = F.get("w", i) == words[key]
            for k, word in enumerate(words):
                found = found & (F.get("w", i + (k - key)) == word)
            return found

        return F.transform(F.filter("at", stands), lambda i: i - key - F.col("before"))

    rows = rows.withColumns({f"s{k}": best(t) for k, t in enumerate(templates)} | {f"p{k}": places(p) for k, p in enumerate(phrases)})
    all_places = F.concat(*[F.col(f"p{k}") for k in range(len(phrases))])
    names = [F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())]
    more = [F.when(F.col(f"s{k}") > 0, F.lit(label)) for k, label in enumerate(templates.values())]
    join = lambda cols: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*cols)))), ",")
    rows = rows.withColumn("places", all_places)
    score = F.greatest(F.when(F.size("places") > 0, F.lit(1.0)).otherwise(0.0), *[F.col(f"s{k}") for k in range(len(templates))])
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"), join(names).alias("base_labels"), join([*names, *more]).alias("labels"), score.alias("score"),
    )
