"""Shape, legibility and tokens of text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ideographs, kana and hangul: scripts that are written without spaces.
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}]"
STRUCTURAL = r"^\s*([#\-*+>|]|```|~~~|\d+[.)]\s)"
FENCE = r"^\s*(```|~~~)"
SENTENCE = r"[.!?。！？]"

# Words that carry no meaning of their own, for query terms and for claims.
QUERY_STOP = (
    "the and for with from that this are was were has have had you your its our not but can will into via using use how what when why who "
    "which about also more most than then them they"
).split()
CLAIM_STOP = (
    "the a an is are was were be been being of to in on at for from by with as that this these those it its and or but if then than so such "
    "into over under about which who what when where why how not no their there they we you he she his her our your has have had do does did "
    "can could will would should may might must also more most"
).split()
# What wrongly decoded text shows.
MISDECODED = ["Ã©", "â€", "Ã¼", "Ã¤", "Ã¶", "ï¿½"]


def misdecode_score(text: Column) -> Column:
    """Replacement characters and marks of wrong decoding."""
    found = [F.floor((F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m)) for m in ["�", *MISDECODED]]
    return sum(found[1:], found[0]).cast("int")


def decode_damage(text: Column) -> Column:
    """Marks of wrong decoding and private-use characters."""
    return misdecode_score(text) + F.regexp_count(text, F.lit(r"[\x{E000}-\x{F8FF}]"))


def charset_in_doubt(text: Column) -> Column:
    hard = text.contains("�") | text.rlike(r"[\x{E000}-\x{F8FF}]")
    return hard | ((misdecode_score(text) >= 2) & (misdecode_score(text) * 50 >= F.length(text)))


def approx_tokens(text: Column) -> Column:
    """Ideographs and a quarter of all other characters, rounded half to even."""
    cjk = F.regexp_count(text, F.lit(CJK))
    return (cjk + F.bround((F.length(text) - cjk) / 4)).cast("int")


def lines(text: Column) -> Column:
    """Non-blank lines, trimmed."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def line_shape(text: Column) -> Column:
    """struct(lines, label_share, mean_length, prose): how far the lines are labels or sentences."""
    all_lines = lines(text)
    shown = F.transform(all_lines, lambda x: F.regexp_replace(x, r"\]\([^)]*\)", ""))
    n = F.size(all_lines)
    labels = F.size(F.filter(shown, lambda x: (F.length(x) <= 24) & ~x.rlike(SENTENCE)))
    prose = F.size(F.filter(shown, lambda x: (F.length(x) >= 8) & x.rlike(SENTENCE)))
    total = F.aggregate(all_lines, F.lit(0), lambda s, x: s + F.length(x))
    per = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    return F.struct(n.alias("lines"), per(labels).alias("label_share"), per(total).alias("mean_length"), prose.alias("prose"))


def substance(shape: Column, text: Column) -> Column:
    """'nav_only' where the lines are labels without a sentence, 'ok', or '' where they are too few to tell."""
    sentence = (shape["prose"] > 0) | text.rlike("[。！？；…]")
    menu = (shape["lines"] >= 4) & (shape["label_share"] >= 0.8) & (shape["mean_length"] <= 8) & ~sentence
    return F.when(menu, "nav_only").when(shape["lines"] < 4, "").otherwise("ok")


def is_prose(text: Column) -> Column:
    """200 characters or more, with a sentence mark per 100."""
    marks = F.regexp_count(text, F.lit(r"[。！？；]|[.!?](\s|$)"))
    return (F.length(text) >= 200) & (marks * 100 >= F.length(text))


def encoded_runs(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9+/=]{40,})"), F.lit(1))
    return F.filter(runs, lambda x: x.rlike("[A-Z]") & x.rlike("[a-z]") & x.rlike("[0-9]"))


def obfuscation(text: Column) -> Column:
    """struct(hex_runs, encoded, markers, mean_length, long_share, mixed_share, obfuscated)."""
    hex_runs = F.size(F.regexp_extract_all(text, F.lit(r"([0-9a-fA-F]{24,})"), F.lit(1)))
    low = F.lower(text)
    markers = F.size(F.filter(F.array(*map(F.lit, ["_0x", "arg1=", "getrender", "string.fromcharcode"])), lambda m: low.contains(m)))
    escapes = text.rlike(r"\\x[0-9a-fA-F]{2}\\x[0-9a-fA-F]{2}")
    tokens = F.regexp_extract_all(text, F.lit("([A-Za-z]{2,})"), F.lit(1))
    n = F.size(tokens)
    mean = F.aggregate(tokens, F.lit(0), lambda s, x: s + F.length(x)) / F.greatest(n, F.lit(1))
    share = lambda f: F.size(F.filter(tokens, f)) / F.greatest(n, F.lit(1))
    long_share, mixed = share(lambda x: F.length(x) >= 12), share(lambda x: x.rlike("[a-z]") & x.rlike("[A-Z]"))
    evidence = (hex_runs > 0) | (F.size(encoded_runs(text)) > 0) | (markers > 0) | escapes
    illegible = ((mean >= 9.0) & (mixed >= 0.15)) | ((long_share >= 0.25) & (mixed >= 0.35))
    return F.struct(
        hex_runs.alias("hex_runs"), F.size(encoded_runs(text)).alias("encoded"), markers.alias("markers"),
        F.round(mean, 6).alias("mean_length"), F.round(long_share, 6).alias("long_share"), F.round(mixed, 6).alias("mixed_share"),
        ((F.length(text) >= 1000) & evidence & (n >= 30) & illegible).alias("obfuscated"),
    )


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits: words of two characters or more, and pairs of characters of unspaced scripts."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(rf"({CJK}+|(?:(?!{CJK})[\p{{L}}\p{{N}}])+)"), F.lit(1))

    def cut(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(run) - 1)), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(f"^{CJK}"), pairs).when(F.length(run) >= 2, F.array(run)).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(runs, cut))


def word_tokens(text: Column) -> Column:
    """``tokens`` of texts without unspaced scripts, in one pattern."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]{2,})"), F.lit(1))


def query_runs(text: Column) -> Column:
    return F.array_distinct(word_tokens(text))


def query_terms(text: Column) -> Column:
    """Distinct Latin words of three characters or more that are no stop words, and pairs of ideographs."""
    latin = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9'+-]{2,})"), F.lit(1)), F.lower)
    kept = F.filter(latin, lambda x: ~x.isin(QUERY_STOP))
    runs = F.regexp_extract_all(text, F.lit(f"({CJK}+)"), F.lit(1))
    pairs = F.flatten(
        F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda i: F.substring(r, i, F.lit(2))))
    )
    return F.array_distinct(F.concat(kept, pairs))


def claim_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{2,})"), F.lit(1))
    return F.filter(words, lambda x: ~x.isin(CLAIM_STOP))


def clean(text: Column) -> Column:
    """Without addresses and marks of markup, white space collapsed."""
    text = F.regexp_replace(F.regexp_replace(text, r"https?://\S+", " "), r"[*_`#>|\[\]()]+", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sentences(text: Column) -> Column:
    """Sentences of 20 to 400 characters, no questions, line by line."""
    marked = F.regexp_replace(clean(text), r"([。！？!?；;])", "$1\u0001")
    marked = F.regexp_replace(marked, r"\.\s+", ".\u0001")
    pieces = F.transform(F.split(marked, "\u0001"), lambda x: F.trim(x))
    kept = F.filter(pieces, lambda x: (F.length(x) >= 20) & ~x.rlike("[?？]$"))
    return F.transform(kept, lambda x: F.substring(x, 1, 400))


def title_key(title: Column) -> Column:
    """The head of a title before its site's name, letters and digits only, lower case."""
    head = F.element_at(F.split(title, r"\s+[|–—-]\s+", 2), 1)
    return F.lower(F.regexp_replace(head, r"[^\p{L}\p{N}]+", ""))


def furniture_key(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(line), r"\s+", " "), r"\d+", "#"))
