"""Identity keys of a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelweave import fixed_values as fv
from reelweave.functions import regex as rx
from reelweave.functions import release as rel
from reelweave.functions import text as tx

DEFAULT_ORIGIN = "https://forum.example.com"


def topic_id(url: Column) -> Column:
    return rx.extract(url, fv.TOPIC_ID)


def canonical_url(url: Column, default_origin: str = DEFAULT_ORIGIN) -> Column:
    """Topic URL in one fixed shape; a URL without topic id stays as it is."""
    shape = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]+)"  # as lenient about the host's letters and the rest as the web is
    scheme, host = F.regexp_extract(url, shape, 1), F.regexp_extract(url, shape, 2)
    origin = F.when(host != "", F.concat(F.lower(scheme), F.lit("://"), host)).otherwise(F.lit(default_origin))
    return F.when(topic_id(url) == "", url).otherwise(
        F.concat(origin, F.lit("/index.php?/forums/topic/"), topic_id(url), F.lit("-a/")))


def identity_key(topic: Column, kind: Column, year: Column, clean: Column, raw: Column) -> Column:
    """Text whose hash identifies a listing: its topic, else type, year and title."""
    title = tx.identity_title(F.coalesce(rx.non_empty(clean), raw))
    return F.when(topic != "", F.concat(F.lit("topic_"), topic)).otherwise(F.concat_ws(
        "_", F.coalesce(rx.non_empty(F.lower(kind)), F.lit("movie")),
        F.when((clean != "") & (year != 0), year.cast("string")), title))


def add_identity_keys(df: DataFrame, title_col: str = "raw_title", url_col: str = "url", type_col: str = "type",
                      default_origin: str = DEFAULT_ORIGIN) -> DataFrame:
    df = df.withColumn("_url", F.coalesce(F.col(url_col), F.lit("")))
    df = df.withColumn("topic_id", topic_id(F.col("_url")))
    # the title is read only where there is no topic
    df = df.withColumn("_needs", F.when(F.col("topic_id") == "", F.col(title_col)))
    df = rel.add_title_parts(df, "_needs", "_key_title", "_key_year", "_key_rest")
    key = identity_key(F.col("topic_id"), F.coalesce(F.col(type_col), F.lit("")), F.col("_key_year"),
                       F.col("_key_title"), F.coalesce(F.col(title_col), F.lit("")))
    return df.withColumns({
        "canonical_url": canonical_url(F.col("_url"), default_origin),
        "thread_hash": F.sha2(key, 256),
    }).drop("_url", "_needs", "_key_title", "_key_year", "_key_rest")


def add_legacy_hashes(df: DataFrame, title_col: str, links_col: str) -> DataFrame:
    """Hashes earlier releases used: title with sorted links, and the plain title."""
    title = F.coalesce(F.col(title_col), F.lit(""))
    return df.withColumns({
        "hash_v0": F.sha2(F.concat(title, F.array_join(F.sort_array(F.col(links_col)), "")), 256),
        "hash_v1": F.sha2(F.lower(rx.trim_space(rx.collapse_space(title))), 256),
    })
