"""Follow-up queries from the rows of a result list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that no phrase holds, and more that none begins with.
STOP = (
    "the and for with from that this are was were has have had you your its our not but can will into via using use how what when why who "
    "which about also more most than then them they"
).split()
LEAD = (
    "before after during within without across around against between onto over under per than above below plus minus like unlike according based "
    "called named using used made makes getting got has have had is are was were be been being its their there here when where then so if as of in "
    "on at to by or and but nor"
).split()
WORD = r"[A-Za-z][A-Za-z0-9'+-]{2,}"
#: The word that a token ends in, and the one that it begins with.
LAST, FIRST = r"(?:^|[^A-Za-z0-9'+-])[0-9'+-]*([A-Za-z][A-Za-z0-9'+-]{2,})$", r"^([A-Za-z][A-Za-z0-9'+-]{2,})"


def phrases(text: Column) -> Column:
    """Pairs of words, none of STOP, with nothing but white space between them, as an array of 'a b', distinct."""
    tokens = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\f\r]+")
    ends = F.transform(tokens, lambda t: F.regexp_extract(t, LAST, 1))
    starts = F.slice(F.transform(tokens, lambda t: F.regexp_extract(t, FIRST, 1)), 2, F.size(tokens))
    real = lambda w: (w != "") & ~w.isin(STOP)
    pairs = F.zip_with(F.slice(ends, 1, F.size(tokens) - 1), starts, lambda a, b: F.when(real(a) & real(b), F.concat_ws(" ", a, b)))
    return F.array_distinct(F.array_compact(pairs))


def related(rows: DataFrame, key: str, domain: str, fields: list[str], queries: DataFrame, query: str, n: int = 6) -> DataFrame:
    """key, phrases: up to n phrases that two domains or more use, those of most domains first; keys without one have no row.

    Left out: phrases that begin with a word of LEAD or one on -ing, that say nothing beyond the query, that hold it or lie in it, and
    those whose two words the phrases before have. n phrases have 2n words, so at most (2n)^2 phrases are passed over before n are
    kept: only the first n + (2n)^2 of a key are walked through, which loses none. A phrase counts once a domain and field, in any
    row, so repeated rows change nothing; ties go by code point; null texts have no phrases.
    """
    said = F.explode(F.array_distinct(F.flatten(F.array(*[phrases(F.col(f)) for f in fields]))))
    counted = rows.select(key, domain, said.alias("phrase")).distinct().groupBy(key, "phrase").agg(F.count("*").alias("domains")).where("domains >= 2")
    lead = F.substring_index("phrase", " ", 1)
    q = F.lower(query)
    known = F.regexp_extract_all(q, F.lit(f"({WORD})"), 1)
    new = F.exists(F.split("phrase", " "), lambda w: ~F.array_contains(known, w))
    apart = ~F.contains(q, F.col("phrase")) & ~F.contains(F.col("phrase"), q)
    fit = counted.where(~lead.isin(LEAD + STOP) & ~lead.endswith("ing")).join(queries.select(key, query), key).where(new & apart)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("domains"), "phrase"))
    first = fit.withColumn("place", place).where(F.col("place") <= n + (2 * n) ** 2)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "phrase"))), lambda x: x["phrase"])
    none = F.array().cast("array<string>")

    def step(kept: Column, phrase: Column) -> Column:
        words = F.array_distinct(F.split(phrase, " "))
        seen = F.split(F.array_join(kept, " "), " ")
        return F.when((F.size(kept) < n) & (F.size(F.array_intersect(words, seen)) < 2), F.concat(kept, F.array(phrase))).otherwise(kept)

    return first.groupBy(key).agg(ordered.alias("all")).select(key, F.aggregate("all", none, step).alias("phrases"))
