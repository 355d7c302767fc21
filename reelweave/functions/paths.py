"""File paths inside a download to season and episode numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelweave import fixed_values as fv
from reelweave.functions import regex as rx
from reelweave.functions import text as tx


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)  # a pattern at the end would be tried from every character


def _reading(season, episode=0, end=None, pack=False) -> Column:
    """One rule's result; ``end`` is given by range rules only."""
    zero = F.lit(0)
    as_col = (lambda v: F.lit(v) if isinstance(v, int) else v)
    return F.struct(as_col(season).cast("int").alias("season"), as_col(episode).cast("int").alias("episode"),
                    (as_col(episode) if end is not None else zero).cast("int").alias("episode_start"),
                    (end if end is not None else zero).cast("int").alias("episode_end"), F.lit(pack).alias("is_pack"))


def _not_year(n: Column) -> Column:
    return ~n.between(fv.YEAR_MIN, fv.YEAR_MAX)


def path_reading(name: Column, fallback: Column) -> Column:
    """First rule that fits, in order of trust; ``name`` is a prepared file name column."""
    def num(pattern: str, group: int) -> Column:
        return rx.to_int(rx.extract(name, pattern, group))

    def when_matched(pattern: str, result: Column, also: Column | None = None) -> Column:
        cond = rx.matches(name, pattern)
        return F.when(cond if also is None else cond & also, result)

    def full_range(pattern: str) -> Column:
        return when_matched(pattern, _reading(num(pattern, 1), num(pattern, 2), num(pattern, 3), True),
                            rx.extract(name, pattern, 3) != "")

    def pair(pattern: str) -> Column:
        return when_matched(pattern, _reading(num(pattern, 1), num(pattern, 2)))

    lo, hi = num(fv.PATH_RANGE, 1), num(fv.PATH_RANGE, 2)
    named_season = F.coalesce(num(fv.PATH_SEASON, 1), fallback)
    numbers = F.filter(F.transform(rx.extract_all(name, fv.PATH_NUMBER), rx.to_int), _not_year)
    return F.coalesce(
        full_range(fv.PATH_S_E_RANGE),
        full_range(fv.PATH_S_DOT_E),
        full_range(fv.PATH_N_X_N),
        when_matched(fv.PATH_RANGE, _reading(named_season, lo, hi, True), (lo <= hi) & _not_year(lo) & _not_year(hi)),
        when_matched(fv.PATH_S_TO_S, _reading(num(fv.PATH_S_TO_S, 1), pack=True)),
        when_matched(fv.PATH_SEASON_TO, _reading(num(fv.PATH_SEASON_TO, 1), pack=True)),
        pair(fv.PATH_S_E),
        pair(fv.PATH_S_DOT_E),
        pair(fv.PATH_N_X_N),
        pair(fv.PATH_LOOSE_S_E),
        pair(fv.PATH_LOOSE_S_EP),
        when_matched(fv.PATH_EP, _reading(fallback, num(fv.PATH_EP, 1)), _not_year(num(fv.PATH_EP, 1))),
        F.when(F.size(numbers) > 0, _reading(fallback, F.get(numbers, 0))),
        _reading(fallback),
    )


def _prepared(path: Column) -> Column:
    return tx.canonical_episode_token(tx.plain_spaces(file_name(path)))


def parse_file_paths(df: DataFrame, path_col: str, fallback_season: Column | int, prefix: str = "") -> DataFrame:
    fallback = F.lit(fallback_season) if isinstance(fallback_season, int) else fallback_season
    df = df.withColumn("_file", _prepared(F.col(path_col)))
    df = df.withColumn("_p", path_reading(F.col("_file"), fallback))
    return df.withColumns({f"{prefix}{f}": F.col(f"_p.{f}") for f in (
        "season", "episode", "episode_start", "episode_end", "is_pack")}).drop("_file", "_p")


def parse_path_twice(df: DataFrame, path_col: str, fallback_season: int, plain: str, canonical: str) -> DataFrame:
    """Season and episode as the path is written (prefix ``plain``) and with its episode tokens made canonical first (``canonical``).

    Where both give one file name it is read once.
    """
    fallback = F.lit(fallback_season)
    df = df.withColumns({"_file": _prepared(F.col(path_col)), "_again": _prepared(tx.canonical_episode_token(F.col(path_col)))})
    df = df.withColumn("_p", path_reading(F.col("_file"), fallback))
    df = df.withColumn("_q", F.when(F.col("_file") == F.col("_again"), F.col("_p")).otherwise(path_reading(F.col("_again"), fallback)))
    return df.withColumns({f"{prefix}{f}": F.col(f"{c}.{f}") for prefix, c in ((plain, "_p"), (canonical, "_q")) for f in (
        "season", "episode")}).drop("_file", "_again", "_p", "_q")


def is_video(path: Column, suffixes=None) -> Column:
    return F.regexp_like(F.lower(path), F.lit(rf"\.(?:{'|'.join(suffixes or fv.VIDEO_SUFFIXES)})\z"))


def is_extra(path: Column, words=None) -> Column:
    return F.regexp_like(F.lower(path), F.lit("|".join(words or fv.EXTRA_WORDS)))


# the range pattern with the decimal points around its numbers captured; the
# added alternatives are zero-width and complete, so the matches stay the same
_MARKED_RANGE = (
    r"(?i)\b(?:e|ep|episode)?\s*(?:(?<=(\d\.))|(?<!\d\.))(\d+)\s*(?:-|to)\s*(?:e|ep|episode)?\s*(\d+)\b"
    r"(?:(?=(\.\d))|(?!\.\d))"
)


def number_ranges(path: Column) -> Column:
    """Ends ``lo`` and ``hi`` of every number range in the file name whose numbers touch no decimal point."""
    name = file_name(path)
    before, lo, hi, after = (rx.extract_all(name, _MARKED_RANGE, g) for g in (1, 2, 3, 4))
    ranges = F.arrays_zip(before.alias("before"), lo.alias("lo"), hi.alias("hi"), after.alias("after"))
    whole = F.filter(ranges, lambda r: (r["before"] == "") & (r["after"] == ""))
    read = F.transform(whole, lambda r: F.struct(rx.to_int(r["lo"]).alias("lo"), rx.to_int(r["hi"]).alias("hi")))
    return F.when(~rx.matches(name, r"(?i)\d\s*(?:-|to)"), F.array().cast("array<struct<lo:int,hi:int>>")).otherwise(read)


def in_ranges(ranges: Column, number: Column) -> Column:
    return F.exists(ranges, lambda r: F.coalesce((r["lo"] <= number) & (number <= r["hi"]), F.lit(False)))


def covers_episode(path: Column, episode: Column) -> Column:
    """True when a number range in the file name holds the episode.

    Numbers that touch a decimal point do not count.
    """
    return in_ranges(number_ranges(path), episode)
