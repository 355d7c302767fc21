"""Release names to typed attributes, one projection per stage.

``parse_releases`` adds its columns with a prefix so a table can carry the
attributes of a listing and of a link name side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelweave import fixed_values as fv
from reelweave.functions import regex as rx
from reelweave.functions import text as tx

_BOUNDARY = "(?i)(?:" + "|".join(fv.BOUNDARIES) + ")"

ATTRIBUTES = [
    "clean_title", "year", "remainder", "source", "resolution", "modifier", "quality", "languages",
    "primary_language", "release_group", "is_imax", "is_extended", "is_directors_cut", "is_unrated",
    "is_remastered", "edition", "special_tags", "video_codec", "audio_codec", "audio_channels",
    "season", "first_episode", "last_episode", "episode_count", "episode_start", "episode_end",
    "is_season_pack", "validation_error", "is_valid",
]


def strip_prefixes(col: Column) -> Column:
    """Leading site names removed."""
    for pattern in (fv.PREFIX_BRACKETED_SITE, fv.PREFIX_DOMAIN, fv.PREFIX_SITE_NAME):
        col = rx.replace(col, pattern)
    return rx.trim_space(col)


def title_year(col: Column) -> Column:
    """Year text from a bracketed year (or range), else from a bare range, else null."""
    return F.coalesce(rx.non_empty(rx.extract(col, fv.YEAR_BRACKETED)), rx.non_empty(rx.extract(col, fv.YEAR_BARE_RANGE)))


def add_title_parts(df: DataFrame, title_col: str, out_title: str, out_year: str, out_rest: str) -> DataFrame:
    """Clean title, year and the remainder that holds the metadata."""
    work, year, at = F.col("_work"), F.col("_year_text"), F.col("_cut")
    df = df.withColumn("_work", strip_prefixes(F.coalesce(F.col(title_col), F.lit(""))))
    df = df.withColumn("_year_text", title_year(work))
    # 0-based start of the (bracketed) year, when it does not open the name
    digits_at = F.instr(work, year)
    bracketed = F.substr(work, digits_at - 1, F.lit(1)).isin("(", "[") & (digits_at > 1)
    year_at = digits_at - 1 - F.when(bracketed, 1).otherwise(0)
    meta_at = rx.position(work, _BOUNDARY) - 1
    df = df.withColumn("_cut", F.when(year_at > 0, year_at).when(meta_at > 0, meta_at).otherwise(F.lit(0)))
    head = F.when(at > 0, F.substr(work, F.lit(1), at)).otherwise(work)
    head = rx.trim_space(F.regexp_replace(F.regexp_replace(head, r"\(\z", ""), r"\[\z", ""))
    df = df.withColumn("_head", head).withColumn(
        out_rest, F.when(at > 0, F.substr(work, at + 1)).otherwise(F.lit("")))
    df = df.withColumn(out_title, tx.clean_title_text(tx.strip_bracket_metadata(F.col("_head"))))
    return df.withColumn(out_year, F.coalesce(rx.to_int(year), F.lit(0))).drop("_work", "_year_text", "_cut", "_head")


def quality_columns(text: Column) -> dict[str, Column]:
    """Source, resolution and the modifier the source implies."""
    return {
        "source": rx.first_rule(text, fv.SOURCES),
        "resolution": rx.first_rule(text, fv.RESOLUTIONS),
        "_source_modifier": rx.first_rule(text, [(p, m) for p, _, m in fv.SOURCES]),
    }


def modifier(text: Column, from_source: Column) -> Column:
    """Dynamic-range words override or extend the modifier the source gave."""
    return (F.when(rx.matches(text, fv.MOD_DV_HDR10), F.lit("DV HDR10"))
            .when(rx.matches(text, fv.MOD_DOLBY_VISION), F.trim(F.concat(from_source, F.lit(" DV"))))
            .when(rx.matches(text, fv.MOD_HDR10PLUS), F.lit("HDR10Plus"))
            .when(rx.matches(text, fv.MOD_HDR10), F.lit("HDR10"))
            .when(rx.matches(text, fv.MOD_HDR) & (from_source == ""), F.lit("HDR"))
            .otherwise(from_source))


def quality_text(source: Column, resolution: Column, mod: Column) -> Column:
    both = F.concat(source, F.lit("-"), resolution, F.when(mod != "", F.concat(F.lit(" "), mod)).otherwise(F.lit("")))
    return (F.when((source != "") & (resolution != ""), both)
            .when(resolution != "", resolution)
            .when(source != "", source)
            .otherwise(F.lit("Unknown")))


def languages(text: Column) -> Column:
    """Sorted language codes named in a text, ``[en]`` when none is."""
    rules = sorted(fv.LANGUAGES + [(fv.LANGUAGE_MULTI, "multi")], key=lambda r: r[1])
    found = F.filter(F.array(*[F.when(rx.matches(text, p), F.lit(code)) for p, code in rules]), lambda c: c.isNotNull())
    return found


def with_default_language(found: Column) -> Column:
    return F.when(F.size(found) == 0, F.array(F.lit("en"))).otherwise(found)


def primary_language(text: Column) -> Column:
    return rx.first_rule(text, fv.LANGUAGES, "en")


def forum_language(text: Column) -> Column:
    return rx.first_rule(text, fv.FORUM_LANGUAGES, "")


def detect_languages(df: DataFrame, title_col: str) -> DataFrame:
    title = F.col(title_col)
    return (df.withColumn("_found", languages(title))
            .withColumn("languages", with_default_language(F.col("_found")))
            .withColumn("primary_language", primary_language(title))
            .withColumn("forum_language", forum_language(title)).drop("_found"))


def release_group(text: Column) -> Column:
    trailing = rx.extract(text, fv.GROUP_TRAILING)
    return F.when((trailing != "") & ~tx.is_metadata_word(trailing), trailing).otherwise(rx.extract(text, fv.GROUP_LEADING))


def special_tags(text: Column) -> Column:
    return F.filter(F.array(*[F.when(rx.matches(text, p), F.lit(tag)) for p, tag in fv.SPECIAL_TAGS]),
                    lambda c: c.isNotNull())


# inside a loose range that is found, what stands in front is not looked at again
_LOOSE_INSIDE = fv.LOOSE_RANGE.replace(r"\b", "^", 1)


def add_readings(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Struct of season and episode bounds read from one text, null where the text is.

    ``lo``/``hi`` bound the episodes; a daily date adds its month after them.
    Every pattern runs once over the text; the parts of what it finds are read
    from the find.
    """
    text = F.col(text_col)
    df = df.withColumns({
        "_season": rx.to_int(rx.extract(text, fv.SEASON)),
        "_range": rx.extract(text, fv.EPISODE_RANGE, 0),
        "_single": rx.to_int(rx.extract(text, fv.EPISODE_SINGLE)),
        "_date": rx.extract(text, fv.DAILY_DATE, 0),
        "_bare": rx.to_int(rx.extract(text, fv.BARE_EPISODE)),
    })

    def parts(found: Column, pattern: str) -> list[Column]:
        return [F.when(found != "", rx.to_int(rx.extract(found, pattern, g))) for g in (1, 2)]

    df = df.withColumns(dict(zip(("_lo", "_hi", "_century", "_month"), [*parts(F.col("_range"), fv.EPISODE_RANGE), *parts(F.col("_date"), fv.DAILY_DATE)])))
    in_range = F.coalesce(F.col("_lo") <= F.col("_hi"), F.lit(False))
    df = df.withColumn("_loose_text", F.when(~in_range, text))
    loose = F.get(F.filter(
        F.transform(rx.extract_all(F.col("_loose_text"), fv.LOOSE_RANGE, 0),
                    lambda m: F.struct(rx.to_int(rx.extract(m, _LOOSE_INSIDE, 1)).alias("lo"), rx.to_int(rx.extract(m, _LOOSE_INSIDE, 2)).alias("hi"))),
        lambda r: (r["lo"] < fv.LOOSE_RANGE_LIMIT) & (r["hi"] < fv.LOOSE_RANGE_LIMIT) & (r["lo"] <= r["hi"])), 0)
    return df.withColumn("_loose", loose).withColumn(out, F.when(text.isNotNull(), F.struct(
        F.when(F.col("_season") > 0, F.col("_season")).otherwise(F.lit(1)).alias("season"),
        F.struct(F.col("_lo").alias("lo"), F.col("_hi").alias("hi")).alias("explicit"),
        F.col("_loose").alias("loose"), F.col("_single").alias("single"), F.col("_century").alias("century"),
        F.col("_month").alias("month"), F.col("_bare").alias("bare"),
    ))).drop("_season", "_range", "_single", "_date", "_bare", "_lo", "_hi", "_century", "_month", "_loose_text", "_loose")


def episode_summary(e: Column) -> Column:
    """Bounds, count and pack flag from the readings of ``episodes``."""
    one = F.coalesce(e["single"], F.when(e["month"].isNull(), e["bare"]))
    in_range = F.coalesce(e["explicit"]["lo"] <= e["explicit"]["hi"], F.lit(False))
    lo = F.when(in_range, e["explicit"]["lo"]).when(e["loose"].isNotNull(), e["loose"]["lo"]).otherwise(one)
    hi = F.when(in_range, e["explicit"]["hi"]).when(e["loose"].isNotNull(), e["loose"]["hi"]).otherwise(one)
    count = F.when(lo.isNull(), 0).otherwise(hi - lo + 1) + F.when(e["month"].isNotNull(), 1).otherwise(0)
    return F.struct(
        F.coalesce(e["century"], e["season"]).alias("season"),
        F.coalesce(lo, e["month"]).alias("first_episode"),
        F.coalesce(e["month"], hi).alias("last_episode"),
        count.cast("int").alias("episode_count"),
        F.coalesce(e["month"], lo, F.lit(0)).alias("episode_start"),
        F.coalesce(e["month"], hi, F.lit(0)).alias("episode_end"),
        (count == 0).alias("is_season_pack"),
    )


def add_episodes(df: DataFrame, rest_col: str, raw_col: str, type_col: str) -> DataFrame:
    """Episode fields from the remainder; a series without any is read again from the raw name."""
    kind = F.lower(F.coalesce(F.col(type_col), F.lit("")))
    df = df.withColumn("_kind", kind).withColumn("_episode_text", F.when(F.col("_kind") != "movie", F.coalesce(F.col(rest_col), F.lit(""))))
    df = add_readings(df, "_episode_text", "_read")
    df = df.withColumn("_episodes", F.when(F.col("_kind") != "movie", episode_summary(F.col("_read"))))
    again = (F.col("_kind") == "series") & (F.col("_episodes.episode_count") == 0)
    df = df.withColumn("_episode_text", F.when(again, F.coalesce(F.col(raw_col), F.lit(""))))
    df = add_readings(df, "_episode_text", "_again")
    df = df.withColumn("_episodes", F.when(F.col("_again").isNotNull(), episode_summary(F.col("_again")))
                       .otherwise(F.col("_episodes")))
    return df.drop("_kind", "_episode_text", "_read", "_again")


def parse_releases(df: DataFrame, title_col: str, type_col: str, prefix: str = "") -> DataFrame:
    """Typed attributes of a release name; every output column carries ``prefix``."""
    rest = f"{prefix}remainder"
    df = add_title_parts(df, title_col, f"{prefix}clean_title", f"{prefix}year", rest)
    text = F.col(rest)
    df = df.withColumns({f"{prefix}{k}" if not k.startswith("_") else k: c for k, c in quality_columns(text).items()})
    df = df.withColumns({
        f"{prefix}modifier": modifier(text, F.col("_source_modifier")),
        "_languages": languages(text),
        f"{prefix}primary_language": primary_language(F.coalesce(F.col(title_col), F.lit(""))),
        f"{prefix}release_group": release_group(text),
    })
    df = df.withColumns({
        f"{prefix}quality": quality_text(
            F.col(f"{prefix}source"), F.col(f"{prefix}resolution"), F.col(f"{prefix}modifier")),
        f"{prefix}languages": with_default_language(F.col("_languages")),
        f"{prefix}video_codec": rx.first_rule(text, fv.VIDEO_CODECS),
        f"{prefix}audio_codec": rx.first_rule(text, fv.AUDIO_CODECS),
        f"{prefix}audio_channels": rx.first_rule(text, fv.AUDIO_CHANNELS),
        f"{prefix}special_tags": special_tags(text),
        **{f"{prefix}{flag}": rx.matches(text, p) for p, flag, _ in fv.EDITIONS},
    }).drop("_source_modifier", "_languages")
    df = df.withColumn(f"{prefix}edition", F.concat_ws(
        " ", *[F.when(F.col(f"{prefix}{flag}"), F.lit(label)) for _, flag, label in fv.EDITIONS]))
    df = add_episodes(df, rest, title_col, type_col)
    e = F.col("_episodes")
    df = df.withColumns({
        f"{prefix}season": F.coalesce(e["season"], F.lit(0)),
        f"{prefix}first_episode": e["first_episode"],
        f"{prefix}last_episode": e["last_episode"],
        f"{prefix}episode_count": F.coalesce(e["episode_count"], F.lit(0)),
        f"{prefix}episode_start": F.coalesce(e["episode_start"], F.lit(0)),
        f"{prefix}episode_end": F.coalesce(e["episode_end"], F.lit(0)),
        f"{prefix}is_season_pack": F.coalesce(e["is_season_pack"], F.lit(False)),
        f"{prefix}validation_error": tx.validation_error(f"{prefix}clean_title", f"{prefix}year"),
    }).drop("_episodes")
    return df.withColumn(f"{prefix}is_valid", F.col(f"{prefix}validation_error").isNull())


def parse_distinct(df: DataFrame, title_col: str, type_col: str, prefix: str = "") -> DataFrame:
    """``parse_releases`` on the distinct (name, type) pairs, joined back.

    Links repeat few names very often, so the patterns run once a name; popular
    names are left to the skew join.
    """
    spark = df.sparkSession
    name, kind = F.coalesce(F.col(title_col), F.lit("")), F.lower(F.coalesce(F.col(type_col), F.lit("")))
    df = df.withColumns({"_parse_name": name, "_parse_kind": kind})
    # a fixed number of partitions: few bytes, but much work each
    names = df.select("_parse_name", "_parse_kind").distinct().repartition(4 * spark.sparkContext.defaultParallelism, "_parse_name", "_parse_kind")
    parsed = parse_releases(names, "_parse_name", "_parse_kind", prefix=prefix)
    return df.join(parsed, ["_parse_name", "_parse_kind"]).drop("_parse_name", "_parse_kind")


def quality_from_height(col: Column) -> Column:
    out = None
    for height, name in fv.HEIGHT_QUALITY.items():
        out = F.when(col == height, name) if out is None else out.when(col == height, name)
    return out.otherwise("sd")


def quality_from_text(col: Column) -> Column:
    text = F.lower(F.coalesce(col, F.lit("")))
    out = None
    for marks, name in fv.TEXT_QUALITY:
        cond = F.regexp_like(text, F.lit("|".join(marks)))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("sd")


def rule_tags(df: DataFrame, title_col: str, rules=None, group: str = "quality") -> DataFrame:
    """Names of the matching rules of a group and the first of them."""
    rules = fv.RULE_TAGS if rules is None else rules
    hits = [F.when(rx.matches(F.col(title_col), p), F.lit(name)) for _, g, name, p in rules if g == group]
    tags = F.filter(F.array(*hits), lambda t: t.isNotNull()) if hits else F.array().cast("array<string>")
    return df.withColumn("rule_tags", tags).withColumn("rule_tag", F.get(F.col("rule_tags"), 0))
