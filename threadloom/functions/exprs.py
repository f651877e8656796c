"""Column expressions shared by the plans. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x where x is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def ratio(n: str | Column, d: str | Column) -> Column:
    """n / d; 0/0 is 1 and n/0 is 0."""
    n, d = col(n), col(d)
    return F.when(d == 0, F.when(n == 0, 1.0).otherwise(0.0)).otherwise(n / d)


def harmonic(p: str | Column, r: str | Column) -> Column:
    """The harmonic mean of two scores, 0 if both are 0."""
    p, r = col(p), col(r)
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def mean(x: str | Column) -> Column:
    """The average; 0 over nothing."""
    return F.coalesce(F.avg(col(x)), F.lit(0.0))


def set_scores(both: str | Column, human: str | Column, model: str | Column) -> dict[str, Column]:
    """precision, recall, f1, jaccard from the sizes of an intersection and its two sets."""
    both, human, model = col(both), col(human), col(model)
    p, r = ratio(both, model), ratio(both, human)
    return {"precision": p, "recall": r, "f1": harmonic(p, r), "jaccard": ratio(both, human + model - both)}


def strip(x: str | Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def squash(x: str | Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def blank_null(x: str | Column) -> Column:
    """Null for a text of white space only; otherwise the text as it is."""
    return F.when(strip(x) != "", col(x))


def name(x: str | Column) -> Column:
    """A name as it stands, trimmed; null if nothing is left."""
    return F.nullif(strip(x), F.lit(""))


def snake(x: str | Column) -> Column:
    """A name in small letters, trimmed, with blanks and hyphens as underscores; null if nothing is left."""
    y = F.translate(F.lower(strip(x)), " -", "__")
    return F.when(y != "", y)


def first_sentence(x: str | Column) -> Column:
    """The squashed text up to the first full stop, question or exclamation mark before a blank or the end; else all of it."""
    return let(squash(x), lambda s: let(F.regexp_extract(s, r"^(.+?[.?!])(?:\s|$)", 1), lambda hit: F.when(hit != "", hit).otherwise(s)))


def clean_summary(x: str | Column, fallback: str | Column) -> Column:
    """Squashed, freed of blanks, dashes and colons at the ends, at most 220 characters; longer ones are cut at 217 plus dots."""
    s = F.regexp_replace(F.regexp_replace(col(x), r"(?U)\s+", " "), r"^[ \-:\n\t]+|[ \-:\n\t]+$", "")
    cut = lambda t: F.when(F.char_length(t) <= 220, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, 217), r"(?U)\s+$", ""), F.lit("...")))
    return let(s, lambda t: F.when(t == "", fallback if isinstance(fallback, Column) else F.lit(fallback)).otherwise(cut(t)))


def truncate(x: str | Column, limit: int) -> Column:
    """Squashed text of at most `limit` characters, the last three of which are dots if it was cut."""
    short = lambda s: F.concat(F.regexp_replace(F.substring(s, 1, limit - 3), r"(?U)\s+$", ""), F.lit("..."))
    return let(squash(x), lambda s: F.when(F.char_length(s) <= limit, s).otherwise(short(s)))


def lines(x: str | Column) -> Column:
    """The stripped lines that hold something."""
    return F.filter(F.transform(F.split(col(x), r"\R"), strip), lambda s: s != "")


def search_tokens(x: str | Column) -> Column:
    """Identifiers of two and more characters and runs of digits, in small letters, in order."""
    return F.regexp_extract_all(F.lower(col(x)), F.lit(r"([A-Za-z_][A-Za-z0-9_]+|\d+)"), F.lit(1))


# ---------------------------------------------------------------- similarity of phrases


def phrase(x: str | Column) -> Column:
    """Small letters and digits, everything else as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(x)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def _tokens(p: Column) -> Column:
    return F.array_distinct(F.filter(F.split(p, " "), lambda t: t != ""))


def _trigrams(p: Column) -> Column:
    padded = F.concat(F.lit(" "), p, F.lit(" "))
    # one pass over the text; a substring per place would read it from the start each time
    return F.when(p == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.regexp_extract_all(padded, F.lit(r"(?s)(?=(.{3}))"), F.lit(1))))


def similarities(a: str | Column, b: str | Column) -> dict[str, Column]:
    """token_f1, token_jaccard, token_containment and char_ngram_jaccard of two normalised phrases; 1 if both are empty, 0 if one is."""
    a, b = col(a), col(b)

    def over(sets: Callable[[Column], Column], score: Callable[[Column, Column, Column], Column]) -> Column:
        """The score from the sizes of the common part and of the two sets."""
        sizes = let(F.struct(sets(a).alias("x"), sets(b).alias("y")), lambda s: F.struct(F.size(F.array_intersect(s["x"], s["y"])).alias("n"), F.size(s["x"]).alias("a"), F.size(s["y"]).alias("b")))
        return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(let(sizes, lambda s: score(s["n"], s["a"], s["b"])))

    return {
        "token_f1": over(_tokens, lambda n, x, y: harmonic(n / y, n / x)),
        "token_jaccard": over(_tokens, lambda n, x, y: n / (x + y - n)),
        "token_containment": over(_tokens, lambda n, x, y: n / F.least(x, y)),
        "char_ngram_jaccard": over(_trigrams, lambda n, x, y: n / (x + y - n)),
    }


def logistic_score(raw: str | Column, mode: str = "sigmoid", clip_min: float = 0.0, temperature: float = 2.0, bias: float = 0.0) -> Column:
    """A raw score kept, floored at clip_min, or put through a logistic curve whose argument is held within +-60."""
    raw = col(raw)
    if mode == "raw":
        return raw
    if mode == "clip":
        return F.greatest(raw, F.lit(clip_min))
    if mode != "sigmoid":
        raise ValueError(f"unknown mode {mode!r}")
    return 1 / (1 + F.exp(-F.least(F.greatest((raw - bias) / max(temperature, 1e-6), F.lit(-60.0)), F.lit(60.0))))


def quantise(x: str | Column, step: float, most: float) -> Column:
    """The nearest multiple of step, halves to even, within 0 and most."""
    return F.least(F.greatest(F.bround(col(x) / step) * step, F.lit(0.0)), F.lit(float(most)))


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
