"""Entity tables: scans, tolerant reads, legacy import, versioned writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from reelweave import fixed_values as fv
from reelweave.functions import identity as idn
from reelweave.functions import links as ln
from reelweave.functions import release as rel
from reelweave.operators import merge as mg
from reelweave.operators import ranking as rk
from reelweave.schemas import ENTITIES, FILE
from reelweave.session import materialize


def read_entity(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.schema(ENTITIES[name]).parquet(path)


def read_tolerant(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the raw text of those that do not."""
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    # read as text: the reader of JSON files gives no rows that are only broken
    rows = spark.read.text(path).select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return rows.filter("r._corrupt IS NULL AND r IS NOT NULL").select("r.*").drop("_corrupt"), rows.filter("r._corrupt IS NOT NULL").select(F.col("value").alias("raw"))


def choose_load_mode(index: DataFrame, force: bool = False) -> str:
    """``incremental`` once more than 50 catalogued rows are linked, unless forced."""
    rows = index.filter((F.col("status") == fv.LINKED) & (F.coalesce("catalog", F.lit("")) != "")).limit(51).count()
    return "incremental" if rows > 50 and not force else "full"


def import_legacy_threads(rows: DataFrame, default_origin: str = idn.DEFAULT_ORIGIN) -> DataFrame:
    """Legacy threads (links as a list or its JSON text) with fresh titles, stripped links and identity keys."""
    links = F.from_json("magnet_uris", "array<string>") if rows.schema["magnet_uris"].dataType == StringType() else F.col("magnet_uris")
    links = F.coalesce(links, F.array().cast("array<string>"))
    df = idn.add_identity_keys(rows.drop("thread_hash"), default_origin=default_origin)
    df = rel.add_title_parts(df, "raw_title", "_title", "_year", "_rest")
    return df.withColumns({"clean_title": F.col("_title"), "magnet_uris": F.array_distinct(ln.stripped_links(links)), "url": F.col("canonical_url")}).drop(
        "_title", "_year", "_rest", "canonical_url", "topic_id")


#: Legacy name, name here, key, columns that hold JSON text with their types.
LEGACY = (
    ("threads", "threads", ["thread_hash"], {"magnet_uris": "array<string>"}),
    ("tmdb_metadata", "tmdb_metadata", ["tmdb_id"], {}),
    ("streams", "streams", ["tmdb_id", "infohash"], {}),
    ("failed_threads", "failed_threads", ["thread_hash"], {}),
    ("debrid_torrents", "download_cache", ["infohash"], {"files": f"array<{FILE.simpleString()}>", "links": "array<string>"}),
    ("debrid_cache_locks", "locks", ["infohash"], {}),
    ("magnet_cache", "link_cache", ["infohash"], {}),
    ("torbox_id_map", "provider_ids", ["torrent_id"], {}),
)
_LATEST = ("updated_at", "last_checked", "last_attempt", "created_at")


def _decoded(rows: DataFrame, json: dict[str, str], keyless: Column) -> DataFrame:
    """JSON columns read, ``_fault`` naming the first that can't be or a lacking key; blank text is an empty list.

    ``_text`` is the row as it came, where it has a fault.
    """
    text = F.to_json(F.struct(*rows.columns))
    fault = F.lit(None).cast("string")
    for name, kind in json.items():
        value = F.from_json(F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("[]")), kind, {"mode": "PERMISSIVE"})
        rows = rows.withColumn(f"_{name}", value)
        fault = F.coalesce(fault, F.when(F.col(f"_{name}").isNull(), F.lit(f"{name} is no list")))
    rows = rows.withColumn("_fault", F.coalesce(fault, F.when(keyless, F.lit("no key"))))
    rows = rows.withColumn("_text", F.when(F.col("_fault").isNotNull(), text))
    return rows.withColumns({name: F.col(f"_{name}") for name in json}).drop(*[f"_{name}" for name in json])


def import_legacy(tables: dict[str, DataFrame], default_origin: str = idn.DEFAULT_ORIGIN) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """The tables of an earlier store under their names here; rows that can't be read; and a report that adds up.

    Threads get their new keys, rows of one key are folded in the order of their
    ids, and references to a thread's old key follow it.  Elsewhere the latest
    row of a key counts.  Quarantined rows carry table, key, fault and the row as
    text.  Report: table_name, source_rows, quarantined, folded, target_rows, agrees.
    """
    out: dict[str, DataFrame] = {}
    bad = report = None
    moved = None
    for legacy, name, key, json in LEGACY:
        if legacy not in tables:
            continue
        source = tables[legacy]
        keyless = F.lit(False)
        for k in key:
            keyless = keyless | (F.coalesce(F.col(k).cast("string"), F.lit("")) == "")
        # a row is kept as text only where it can't be read
        rows = materialize(_decoded(source, json, keyless), f"legacy-{name}")
        wrong = rows.filter("_fault IS NOT NULL").select(F.lit(name).alias("table_name"), F.concat_ws("/", *key).alias("key"), F.col("_fault").alias("fault"), F.col("_text").alias("raw"))
        good = rows.filter("_fault IS NULL").drop("_fault", "_text")
        if name == "threads":
            keyed = import_legacy_threads(good.withColumn("_old_hash", F.col("thread_hash")), default_origin)
            keyed = materialize(keyed, "legacy-keyed")
            moved = keyed.groupBy(F.col("_old_hash").alias("thread_hash")).agg(F.max("thread_hash").alias("_new_hash"))
            scalars = [c for c in keyed.columns if c not in ("thread_hash", "url", "magnet_uris", "_old_hash")]
            target = mg.fold_batch(keyed, "id", scalars).withColumn("magnet_uris", F.coalesce("magnet_uris", F.array().cast("array<string>")))
        else:
            if name == "failed_threads" and moved is not None:
                good = good.join(moved, "thread_hash", "left").withColumn("thread_hash", F.coalesce("_new_hash", "thread_hash")).drop("_new_hash")
            if name == "link_cache":
                good = good.withColumn("magnet", ln.stripped_link(F.col("magnet"), ln.infohash(F.col("magnet")), ln.display_name(F.col("magnet"))))
            order = [c for c in _LATEST if c in good.columns] or [c for c in good.columns if c not in key]
            target = rk.latest_by_key(good, key, order, fold=[k for k in key if k == "infohash"])
        out[name] = materialize(target, f"imported-{name}")
        counts = rows.agg(F.count("*").alias("source_rows"), F.count("_fault").alias("quarantined"))
        counts = counts.select(F.lit(name).alias("table_name"), "*").withColumn("target_rows", out[name].agg(F.count("*")).scalar())
        bad = wrong if bad is None else bad.unionByName(wrong)
        report = counts if report is None else report.unionByName(counts)
    folded = F.col("source_rows") - F.col("quarantined") - F.col("target_rows")
    return out, bad, report.withColumn("folded", folded).withColumn("agrees", F.col("folded") >= 0)
