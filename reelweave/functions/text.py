"""Title text: cleaning, normalising, brackets, look-alike bigrams.

Functions taking a ``Column`` use it once.  Functions that need a value more
than once are ``DataFrame -> DataFrame`` stages, so that Catalyst keeps the
value as one projected column instead of repeating the expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelweave import fixed_values as fv
from reelweave.functions import regex as rx


def normalize_media_type(col: Column) -> Column:
    """``series`` for the known series words, ``movie`` for anything else."""
    return F.when(F.lower(rx.trim_space(col)).isin(fv.SERIES_TYPES), F.lit("series")).otherwise(F.lit("movie"))


def _soften_punctuation(col: Column) -> Column:
    s = F.regexp_replace(col, "&", "and")
    s = rx.replace(s, fv.BRACKETS, " ")
    s = rx.replace(s, fv.SPACED_PUNCT, " ")
    return rx.replace(s, fv.SUFFIX_PUNCT, "$1")


def clean_title_text(col: Column) -> Column:
    """Title without brackets, loose punctuation or an orphaned metadata tail."""
    s = rx.replace(_soften_punctuation(col), fv.ORPHAN_TAIL)
    s = rx.replace(s, fv.TRAILING_PUNCT)
    s = rx.trim_space(rx.collapse_space(s))
    for article in fv.TRAILING_ARTICLES:
        s = F.regexp_replace(s, rf"(?is)^[ ]*(.*?)[ ]*, {article}\z", f"{article} $1")
    return s


def normalize_title(col: Column) -> Column:
    """Form of a title used for comparing: lower case, one leading article dropped."""
    s = rx.trim_space(rx.collapse_space(_soften_punctuation(col)))
    s = F.regexp_replace(F.lower(s), rf"^(?:{'|'.join(fv.LEADING_ARTICLES)}) ", "")
    return rx.trim_space(s)


def normalize_titles(df: DataFrame, title_col: str, out: str = "norm_title") -> DataFrame:
    return df.withColumn(out, normalize_title(F.coalesce(F.col(title_col), F.lit(""))))


def identity_title(col: Column) -> Column:
    """Title part of an identity key: separators to spaces, lower case."""
    s = F.regexp_replace(F.regexp_replace(col, "&", "and"), r"[()\[\]\-_]", " ")
    return rx.trim_space(rx.collapse_space(F.lower(s)))


def strip_year_artifact(col: Column) -> Column:
    """First bracketed four-digit group removed, rest trimmed; untouched when there is none."""
    pattern = r"(?s)^(.*?)[(\[][0-9]{4}[)\]](.*)\z"
    removed = rx.trim_space(F.regexp_replace(col, pattern, "$1$2"))
    return F.when(F.regexp_like(col, F.lit(pattern)), removed).otherwise(col)


_METADATA_BLOCK = "(?i)(?:" + rx.any_of(fv.BRACKET_TOKENS) + ")|" + rx.to_java(fv.SIZE_TEXT).replace("(?i)", "")


def strip_bracket_metadata(col: Column) -> Column:
    """Bracketed spans, nested to any depth, that hold a metadata token or a size removed.

    One pass over the brackets and the runs between them with a stack of open
    spans: each has its text as read and as kept.  Any closing bracket closes
    the last open one; what is never closed stays.  Only the first
    ``BRACKET_PAIRS`` spans to close are judged.  Pass a plain column: it is
    read more than once.
    """
    empty = F.lit("")

    def frame(opening: Column, raw: Column, kept: Column) -> Column:
        return F.struct(opening.alias("opening"), raw.alias("raw"), kept.alias("kept"))

    def append(stack: Column, raw: Column, kept: Column) -> Column:
        top = F.element_at(stack, -1)
        return F.concat(F.slice(stack, F.lit(1), F.size(stack) - 1), F.array(frame(top["opening"], F.concat(top["raw"], raw), F.concat(top["kept"], kept))))

    def step(acc: Column, token: Column) -> Column:
        stack, pairs = acc["stack"], acc["pairs"]
        top = F.element_at(stack, -1)
        closes = token.isin(")", "]") & (F.size(stack) > 1)
        judged = (pairs < fv.BRACKET_PAIRS) & F.regexp_like(top["raw"], F.lit(_METADATA_BLOCK))
        whole = F.concat(top["opening"], top["raw"], token)
        left = F.when(judged, empty).otherwise(F.concat(top["opening"], top["kept"], token))
        after = (F.when(token.isin("(", "["), F.concat(stack, F.array(frame(token, empty, empty))))
                 .when(closes, append(F.slice(stack, F.lit(1), F.size(stack) - 1), whole, left))
                 .otherwise(append(stack, token, token)))
        return F.struct(after.alias("stack"), (pairs + closes.cast("int")).alias("pairs"))

    tokens = F.regexp_extract_all(col, F.lit(r"(?s)[()\[\]]|[^()\[\]]+"), F.lit(0))
    start = F.struct(F.array(frame(empty, empty, empty)).alias("stack"), F.lit(0).alias("pairs"))
    stack = F.aggregate(tokens, start, step)["stack"]
    stripped = F.aggregate(stack, empty, lambda acc, f: F.concat(acc, f["opening"], f["kept"]))
    return F.when(F.regexp_like(col, F.lit(r"[(\[]")), stripped).otherwise(col)


_FOLD_FROM = "".join(fv.FOLDED_LETTERS.values())
_FOLD_TO = "".join(base * len(letters) for base, letters in fv.FOLDED_LETTERS.items())


def plain_spaces(col: Column) -> Column:
    """Non-breaking and zero-width spaces as plain spaces."""
    return F.regexp_replace(col, "\u00a0|&nbsp;|\u200b", " ")


def canonical_episode_token(col: Column) -> Column:
    """``S01 EP (05)`` and friends written as ``S01E05``."""
    return rx.replace(col, fv.EPISODE_TOKEN, "$1E$2")


def sanitize_name(col: Column, fold: bool = True) -> Column:
    s = canonical_episode_token(plain_spaces(col))
    if fold:
        s = F.translate(s, _FOLD_FROM, _FOLD_TO)
    s = F.regexp_replace(s, r"[^\x00-\x7F]", " ")
    s = rx.replace(rx.replace(s, fv.URL_OR_MAIL, " "), fv.NOISY_BRACKET, " ")
    return F.btrim(rx.collapse_space(s), F.lit(fv.EDGE_CHARS))


def sanitize_names(df: DataFrame, name_col: str, out: str = "clean_name", fold: bool = True) -> DataFrame:
    return df.withColumn(out, sanitize_name(F.col(name_col), fold))


def is_metadata_word(col: Column) -> Column:
    return F.lower(col).isin(fv.METADATA_WORDS)


def validation_error(title_col: str, year_col: str | None) -> Column:
    """Name of the first failing title rule, null when the title is valid."""
    title = F.coalesce(F.col(title_col), F.lit(""))
    words = F.filter(F.split(F.lower(title), rx.UNICODE_SPACE + "+"), lambda w: w != "")
    n_meta = F.size(F.filter(words, lambda w: w.isin(fv.METADATA_WORDS)))
    rule = (F.when(rx.trim_space(title) == "", F.lit(fv.INVALID_EMPTY))
            .when(n_meta * 2 > F.size(words), F.lit(fv.INVALID_METADATA)))
    if year_col:
        year = F.coalesce(F.col(year_col), F.lit(0))
        rule = rule.when((year != 0) & ~year.between(fv.YEAR_MIN, fv.YEAR_MAX), F.lit(fv.INVALID_YEAR))
    return rule


def validate_titles(df: DataFrame, title_col: str = "clean_title", year_col: str | None = "year") -> DataFrame:
    return (df.withColumn("validation_error", validation_error(title_col, year_col))
            .withColumn("is_valid", F.col("validation_error").isNull()))


def natural_sort_key(col: Column) -> Column:
    """Sort key that is case-insensitive and reads digit runs, of any length, as numbers: the length goes first."""
    runs = F.regexp_extract_all(F.lower(col), F.lit(r"(\d+|\D+)"), F.lit(1))
    plain = F.transform(runs, lambda r: F.regexp_replace(r, r"^0+(?=\d)", ""))
    sized = F.transform(plain, lambda r: F.when(
        F.regexp_like(r, F.lit(r"^\d")), F.concat(F.lpad(F.length(r).cast("string"), 10, "0"), r)).otherwise(r))
    return F.array_join(sized, "")


def filter_noise_words(df: DataFrame, title_col: str, out: str = "plain_title") -> DataFrame:
    """Lower-cased title without junk and stop words; cleaned original when nothing is left."""
    s = rx.collapse_space(F.lower(F.col(title_col)))
    s = rx.replace(rx.replace(s, fv.SIZE_GLUED, " "), fv.CHANNEL_TEXT, " ")
    s = F.regexp_replace(s, r"[()\[\]\-+/*!?,&]", " ")
    s = F.regexp_replace(s, r"(?<!\d)[.:]|[.:](?!\d)", " ")
    part_pattern = "|".join(fv.JUNK_PARTS)
    words = F.filter(F.split(s, rx.UNICODE_SPACE + "+"), lambda w: (w != "")
                     & ~w.isin(fv.JUNK_WORDS + fv.STOP_WORDS)
                     & ~F.endswith(w, F.lit("kbps"))
                     & ~F.regexp_like(w, F.lit(part_pattern)))
    original = rx.replace(rx.trim_space(F.col(title_col)), fv.PREFIX_WWW)
    original = rx.replace(rx.replace(original, fv.URL_OR_MAIL, " "), fv.NOISY_BRACKET, " ")
    original = F.btrim(rx.replace(rx.collapse_space(original), fv.YEAR_LOOSE), F.lit(fv.EDGE_CHARS))

    def capitalized(ws: Column) -> Column:
        return F.array_join(F.transform(ws, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")

    def split_words(c: Column) -> Column:
        return F.filter(F.split(c, rx.UNICODE_SPACE + "+"), lambda w: w != "")

    return (df.withColumn("_noise_words", words)
            .withColumn("_noise_original", original)
            .withColumn(out, F.when(F.size("_noise_words") > 0, capitalized(F.col("_noise_words")))
                        .when(F.col("_noise_original") != "", capitalized(split_words(F.col("_noise_original"))))
                        .otherwise(capitalized(split_words(F.col(title_col)))))
            .drop("_noise_words", "_noise_original"))


# --- look-alike bigrams ------------------------------------------------------

def _look_alike_codes(ch: Column) -> Column:
    """Code points a character may stand for, itself included."""
    by_class: dict[str, list[str]] = {}
    for key, members in fv.LOOK_ALIKES.items():
        by_class.setdefault(members, []).append(key)
    out = None
    for members, keys in by_class.items():
        codes = F.array(*[F.lit(ord(m)) for m in members])
        cond = ch.isin(keys)
        out = F.when(cond, codes) if out is None else out.when(cond, codes)
    return out.otherwise(F.array(F.ascii(ch)))


def look_alikes(norm: Column) -> Column:
    """Per character of a normalised title, the codes it may stand for."""
    return F.transform(F.split(norm, ""), _look_alike_codes)


def bigrams_of(codes: Column) -> Column:
    """Distinct adjacent code pairs packed into ints; pass a plain column."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(codes) - 2), lambda i: F.flatten(F.transform(
        F.get(codes, i), lambda a: F.transform(
            F.get(codes, i + 1), lambda b: F.shiftleft(a, 16).bitwiseOR(b)))))
    return F.when(F.size(codes) > 1, F.array_distinct(F.flatten(pairs))).otherwise(F.array().cast("array<int>"))


def add_bigrams(df: DataFrame, norm_col: str, out: str = "bigrams") -> DataFrame:
    return (df.withColumn("_codes", look_alikes(F.col(norm_col)))
            .withColumn(out, bigrams_of(F.col("_codes"))).drop("_codes"))


def dice(a: str, b: str, bigrams_a: str, bigrams_b: str) -> Column:
    """Dice similarity of two titles from their bigram sets; equal titles give 1."""
    return dice_of(F.col(a), F.col(b), F.col(bigrams_a), F.col(bigrams_b))


def dice_of(a: Column, b: Column, bigrams_a: Column, bigrams_b: Column) -> Column:
    shared = F.size(F.array_intersect(bigrams_a, bigrams_b))
    total = F.size(bigrams_a) + F.size(bigrams_b)
    return (F.when(a == b, F.lit(1.0))
            .when((F.size(bigrams_a) == 0) | (F.size(bigrams_b) == 0), F.lit(0.0))
            .otherwise(F.lit(2.0) * shared.cast("double") / total.cast("double")))


def add_dice(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Dice of two title columns of one row."""
    df = add_bigrams(add_bigrams(df, a, "_bigrams_a"), b, "_bigrams_b")
    return df.withColumn(out, dice(a, b, "_bigrams_a", "_bigrams_b")).drop("_bigrams_a", "_bigrams_b")


def year_score(year_a: Column, year_b: Column) -> Column:
    diff = F.abs(year_a - year_b)
    known = (F.coalesce(year_a, F.lit(0)) > 0) & (F.coalesce(year_b, F.lit(0)) > 0)
    return (F.when(~known, F.lit(fv.YEAR_UNKNOWN))
            .when(diff == 0, F.lit(fv.YEAR_EQUAL))
            .when(diff == 1, F.lit(fv.YEAR_NEAR))
            .when(diff <= 3, F.lit(fv.YEAR_CLOSE))
            .otherwise(F.lit(0.0)))


def title_score(similarity: Column, year_a: Column, year_b: Column) -> Column:
    return F.when(similarity < fv.DICE_FLOOR, similarity * fv.TITLE_WEIGHT).otherwise(
        year_score(year_a, year_b) + similarity * fv.TITLE_WEIGHT)
