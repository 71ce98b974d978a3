"""Operator 10: quality rules by distribution divergence, in DataFrame operations only.

Each document has two histograms, one of character classes and one of the common words of its language. The
references are the sums of the histograms of all documents with the same language. A document fails when the
Jensen-Shannon distance (base 2, so 0 to 1) of either histogram to its reference is over its limit plus a slack
that falls with the root of the number of words, as the distance of a good short text does; documents
under a minimum of words, or whose language has too few words for a reference, aren't judged by distance.
Base rules come first: fewer than ``min_words`` words, or too many words in repeated eight-word windows.

Defined results: a null text has no words and fails the base rules; a null language is a language of its own;
rows are judged one by one, so repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import stored

# Common words by language, and the character classes.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "on", "by", "are", "this", "from", "at"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "pas", "avec"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo"],
}
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACE, SYMBOLS = " \t\n\u000b\f\r", "#*$%&|<>"
CLASSES = [LOWER, LOWER.upper(), "0123456789", SPACE, ".,;:'\"-()", SYMBOLS, "!?"]

WINDOW = 8


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _count_in(column: str, chars: str) -> Column:
    return (F.length(column) - F.length(F.expr(f"translate({column}, {_sql(chars)}, '')"))).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """The document's counts and its two histograms."""
    text = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    trimmed = f"trim(BOTH {_sql(SPACE)} FROM text)"
    words = f"if({trimmed} = '', cast(array() as array<string>), split({trimmed}, '[\\\\x20\\\\x09-\\\\x0D]+'))"
    # A lambda over a one-element array binds a value once.
    # Hashes of runs of 2, 4 and 8 words, each from two of the half before; what runs over the end is cut off.
    double = lambda x, k: f"transform(array({x}), c -> zip_with(c, slice(c, {k + 1}, greatest(size(c), 1)), (a, b) -> xxhash64(a, b)))[0]"
    runs = double(double(double("transform(words, w -> xxhash64(w))", 1), 2), 4)
    windows = f"if(size(words) < {WINDOW}, cast(array() as array<bigint>), slice({runs}, 1, greatest(size(words) - {WINDOW - 1}, 0)))"
    # Starts of windows that occur twice, from the windows sorted by hash and place.
    places = """transform(array(sort_array(transform(h, (x, i) -> struct(x, i)))), s ->
        sort_array(array_compact(transform(s, (e, k) -> if((k > 0 and s[greatest(k - 1, 0)].x = e.x) or (k + 1 < size(s) and s[least(k + 1, size(s) - 1)].x = e.x), e.i, null)))))[0]"""
    covered = f"""transform(array({places}), p -> aggregate(transform(p, (a, k) -> if(k + 1 < size(p), least({WINDOW}, p[least(k + 1, size(p) - 1)] - a), {WINDOW})), 0L, (s, a) -> s + a))[0]"""
    repeated = f"transform(array({windows}), h -> if(size(array_distinct(h)) = size(h), 0L, {covered}))[0]"
    lines = f"filter(split(text, '\n', -1), l -> trim(BOTH {_sql(SPACE)} FROM l) != '')"
    dup_lines = f"transform(array({lines}), l -> cast(size(l) - size(array_distinct(l)) as bigint))[0]"
    common = "case " + " ".join(f"when lang = {_sql(lang)} then array({', '.join(map(_sql, listed))})" for lang, listed in COMMON_WORDS.items())
    common += f" else array({', '.join(map(_sql, COMMON_WORDS['en']))}) end"
    bare = "split(lower(text), '[\\\\x20\\\\x09-\\\\x0D.,;:!?]+')"
    # The first number is that of all words, the others are those of each common word.
    counted = f"transform(array({bare}), b -> concat(array(cast(size(b) as bigint)), transform({common}, w -> cast(size(b) - size(array_remove(b, w)) as bigint))))[0]"
    # Most characters are in lower case: they are counted by what is left without them, the rest in what is left.
    rows = text.select(
        "doc_id",
        "lang",
        F.expr(words).alias("words"),
        F.expr(counted).alias("counted"),
        F.expr(dup_lines).alias("n_dup_lines"),
        F.length("text").cast("long").alias("n_chars"),
        F.regexp_replace("text", "[a-z]+", "").alias("rest"),
    )
    rows = rows.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        "n_dup_lines",
        F.expr(repeated).alias("n_repeat_words"),
        "n_chars",
        F.array(F.col("n_chars") - F.length("rest"), *(_count_in("rest", c) for c in CLASSES[1:])).alias("named_chars"),
        "counted",
    )
    spaces, symbols = (CLASSES.index(c) for c in (SPACE, SYMBOLS))
    rows = rows.withColumn("word_chars", F.col("n_chars") - F.col("named_chars")[spaces]).withColumn("n_symbols", F.col("named_chars")[symbols])
    rows = rows.withColumn("named_words", F.expr("slice(counted, 2, size(counted) - 1)")).withColumn("n_bare", F.col("counted")[0])
    other = lambda total, named: F.concat(named, F.array(F.expr(f"{total} - aggregate({named}, 0L, (s, x) -> s + x)")))
    rows = rows.withColumn("chars", other("n_chars", "named_chars")).withColumn("common", other("n_bare", "named_words"))
    return rows.drop("named_chars", "named_words", "n_chars", "n_bare", "counted")


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two arrays of counts; 0 if one is empty."""
    total = "aggregate({0}, 0D, (s, x) -> s + x)"
    part = "if(a > 0, a * log2(2 * a / (a + b)), 0D) + if(b > 0, b * log2(2 * b / (a + b)), 0D)"
    terms = f"zip_with(transform({p}, x -> x / {total.format(p)}), transform({q}, x -> x / {total.format(q)}), (a, b) -> {part})"
    return f"if({total.format(p)} > 0 and {total.format(q)} > 0, sqrt(greatest(0D, aggregate({terms}, 0D, (s, x) -> s + x) / 2)), 0D)"


def judge(
    docs: DataFrame, min_words: int = 20, repeat_percent: int = 30, guard_words: int = 20, reference_words: int = 1000, char_limit: float = 0.2, word_limit: float = 0.17, char_slack: float = 0.8, word_slack: float = 1.3
) -> DataFrame:
    """Per document row: its counts, distances to its language's references and verdicts."""
    rows = stored(features(docs), "features")
    width = {"chars": len(CLASSES) + 1, "common": max(map(len, COMMON_WORDS.values())) + 1}
    sums = [F.array(*(F.sum(F.col(c)[k]) for k in range(n))).alias(f"{c}_reference") for c, n in width.items()]
    reference = rows.groupBy("lang").agg(*sums, F.sum("n_words").alias("reference_words"))
    rows = rows.join(reference, "lang")
    for kind in width:
        rows = rows.withColumn(f"{kind}_distance", F.expr(_distance(kind, f"{kind}_reference")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    judged = (F.col("n_words") >= guard_words) & (F.col("reference_words") >= reference_words)
    noise = 1 / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    far = judged & ((F.col("chars_distance") > char_limit + char_slack * noise) | (F.col("common_distance") > word_limit + word_slack * noise))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
