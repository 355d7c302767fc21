"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is the set of its pieces' 64-bit digests; a piece is a line or
sentence, long ones cut after about ``PIECE`` characters at a word's end.  A
sketch has three tables of cells; a digest goes to one cell of each and is
added to its count and xored into its key and check.  The sketch of one
version minus that of another holds only the digests in which they differ:
where a cell is left with one, it can be read, and taken out of its other
cells, until all are recovered.  A difference that can't be peeled is tried
again with ``LARGER`` times the cells.  Likeness is 1 - differing / all
digests of both (1 for two texts without any).

``fingerprint`` is the sketch with ``CELLS`` cells a table, written out in
hexadecimal.  Cells that are zero take no room in the larger sketches.
Everything is DataFrame functions; a document's cells are added up where the
document is, without another shuffle of them.

Defined results: a null or empty text has no pieces; rows of equal doc_id
follow one another with the greater text first; rows without doc_id come last,
and the next document of the last is the first.  A single row is its own
next.  Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelweave.llm.folders import Folder

PIECE = 40
CELLS = 8
ROOM = 64
LARGER = 16
ROUNDS = 4
ROW = 4
#: A task adds up the cells of a bucket or a few; it should hold them in memory.
ROWS_A_BUCKET = 500
MOST_BUCKETS = 4_096
_PATTERN = r"[^\n.!?]{1,%d}[^\s.!?]*[\s.!?]*|[\s.!?]+" % PIECE


def pieces(text: Column) -> Column:
    """Distinct digests of the pieces of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_PATTERN), F.lit(0)), lambda p: F.xxhash64(p)))


def _place(j: Column, digest: Column, cells: Column) -> Column:
    return F.pmod(F.xxhash64(j, digest), cells)


def _check(digest: Column) -> Column:
    return F.xxhash64(F.lit(99), digest)


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, rn (which name a row), doc_id, text, next_text: the text of the next row in descending order of doc_id."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    wanted = min(MOST_BUCKETS, max(1, n // ROWS_A_BUCKET))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / wanted for k in range(1, wanted)], 20_000)).first()[0] if wanted > 1 else []
    cuts = sorted(set(cuts or []))
    width = max(1, int(len(cuts) ** 0.5))
    heads = F.array(*[F.lit(c).cast("bigint") for c in cuts[::width]]) if cuts else None
    if cuts:
        every = F.array(*[F.lit(c).cast("bigint") for c in cuts])
        coarse = F.size(F.filter(heads, lambda c: c < F.col("doc_id")))
        fine = F.size(F.filter(F.slice(every, F.greatest(coarse - 1, F.lit(0)) * width + 1, F.lit(width)), lambda c: c < F.col("doc_id")))
        bucket = F.coalesce(F.when(coarse == 0, 0).otherwise((coarse - 1) * width + fine), F.lit(-1))
    else:
        bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    placed = docs.withColumn("bucket", bucket.cast("int"))
    # the first row of each bucket is also the last guest of the bucket before it in this order
    first = placed.groupBy("bucket").agg(F.max(F.struct("doc_id", "text")).alias("r"))
    there = sorted(r["bucket"] for r in first.select("bucket").collect())  # at most MOST_BUCKETS + 1 numbers
    if not there:
        return placed.select("bucket", F.lit(1).alias("rn"), "doc_id", "text", F.lit("").alias("next_text"))
    host = dict(zip(there, [*there[1:], there[0]], strict=True))
    move = F.element_at(F.create_map(*[F.lit(x) for pair in host.items() for x in pair]), F.col("bucket"))
    guests = first.select(move.alias("bucket"), "r.doc_id", "r.text", F.lit(True).alias("guest"))
    rows = placed.select("bucket", "doc_id", "text", F.lit(False).alias("guest")).unionByName(guests).repartition(2 * len(there), "bucket")
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    seen = rows.withColumn("rn", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    return seen.filter(~F.col("guest")).select("bucket", "rn", "doc_id", "text", "next_text")


def _versions(docs: DataFrame) -> DataFrame:
    n = F.length("text").cast("bigint")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = with_next(docs).withColumn("n_chars", n)
    return rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)))


#: Which sketches a version goes to, and its sign there: 0 text - edited, 1 text - next, 2 and 3 the fingerprints;
#: version 3 stands for the row itself and brings what is kept of it, so that the texts are read once.
_USES = {0: ((0, 1), (1, 1), (2, 1)), 1: ((0, -1), (3, 1)), 2: ((1, -1),), 3: ((ROW, 1),)}


def _cells(rows: DataFrame, room: int) -> DataFrame:
    """Cells of each row's sketches: bucket, rn, kind, both (digests of both sides), at (table and cell), about (for ``ROW``), n, key, check."""
    about = F.struct("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    taken = rows.select("bucket", "rn", about.alias("about"), pieces(F.col("text")).alias("own"), pieces(F.col("edited")).alias("changed"), pieces(F.col("next_text")).alias("after"))
    sized = taken.withColumn("both", F.array(F.size("own") + F.size("changed"), F.size("own") + F.size("after"), F.lit(0), F.lit(0), F.lit(0)))
    each = sized.select("bucket", "rn", "both", "about", F.posexplode(F.array("own", "changed", "after", F.array(F.lit(0).cast("bigint")))).alias("version", "digests"))
    each = each.select("bucket", "rn", "both", F.when(F.col("version") == 3, F.col("about")).alias("about"), "version", F.explode("digests").alias("digest"))
    uses = F.lit(None)
    for version, kinds in _USES.items():
        uses = F.when(F.col("version") == version, F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("sign")) for k, s in kinds])).otherwise(uses)
    used = each.withColumn("use", F.explode(uses)).select("bucket", "rn", "about", "digest", F.col("use.kind").alias("kind"), F.col("use.sign").alias("sign"), F.get("both", F.col("use.kind")).alias("both"))
    spread = used.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    at = F.col("j") * _size(F.col("kind"), F.col("both"), room) + _place(F.col("j"), F.col("digest"), _size(F.col("kind"), F.col("both"), room))
    placed = spread.select("bucket", "rn", "about", "kind", "both", at.alias("at"), "sign", "digest", _check(F.col("digest")).alias("c"))
    return placed.groupBy("bucket", "rn", "kind", "both", "at", "about").agg(F.sum("sign").alias("n"), F.bit_xor("digest").alias("key"), F.bit_xor("c").alias("check"))


def _size(kind: Column, both: Column, room: int) -> Column:
    """Cells of a table."""
    return F.when(kind >= 2, F.lit(CELLS)).otherwise(both * room).cast("bigint")


def _peeled(cells: DataFrame, room: int) -> DataFrame:
    """For each row and kind: differing digests, digests of both sides, whether all were recovered; or the fingerprint."""
    pure = (F.abs("n") == 1) & (F.col("check") == _check(F.col("key")))
    zero = (F.col("n") == 0) & (F.col("key") == 0) & (F.col("check") == 0)

    def tail(x: Column, digits: int) -> Column:
        return F.lower(F.substring(F.concat(F.lit("0" * digits), F.hex(x)), -digits, digits))

    written = F.concat(F.lower(F.lpad(F.hex("at"), 2, "0")), F.lit(":"), tail(F.col("n"), 4), tail(F.col("key"), 16), tail(F.col("check"), 8))
    differs = F.col("kind") < 2
    first = differs & (F.col("at") < _size(F.col("kind"), F.col("both"), room))  # the first table has every digest once
    met = cells.groupBy("bucket", "rn", "kind", "both").agg(
        F.bit_xor(F.when(first, F.col("key"))).alias("all_keys"), F.bit_xor(F.when(first, F.col("check"))).alias("all_checks"), F.sum(F.when(first, F.col("n"))).alias("all_n"),
        F.collect_set(F.when(differs & pure, F.struct("key", "n"))).alias("found"),
        F.collect_list(F.when(differs & ~pure & ~zero, F.struct("at", "n", "key", "check"))).alias("rest"),
        F.array_join(F.sort_array(F.collect_list(F.when(~differs, written))), ",").alias("text"), F.max("about").alias("about"))
    size = _size(F.col("kind"), F.col("both"), room)

    def take_out(acc: Column) -> Column:
        """Take the digests found last out of the cells that weren't pure, and read those that now are."""
        def less(c: Column) -> Column:
            j = F.floor(c["at"] / size).cast("int")
            here = F.filter(acc["new"], lambda f: j * size + _place(j, f["key"], size) == c["at"])
            return F.struct(
                c["at"].alias("at"), (c["n"] - F.aggregate(here, F.lit(0).cast("bigint"), lambda a, f: a + f["n"])).alias("n"),
                F.aggregate(here, c["key"], lambda a, f: a.bitwiseXOR(f["key"])).alias("key"), F.aggregate(here, c["check"], lambda a, f: a.bitwiseXOR(_check(f["key"]))).alias("check"))

        left = F.filter(F.transform(acc["rest"], less), lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0))
        is_pure = lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _check(c["key"]))
        new = F.array_distinct(F.transform(F.filter(left, is_pure), lambda c: F.struct(c["key"].alias("key"), c["n"].alias("n"))))
        return F.struct(F.filter(left, lambda c: ~is_pure(c)).alias("rest"), new.alias("new"), (acc["total"] + F.size(new)).alias("total"))

    start = F.struct(F.col("rest").alias("rest"), F.col("found").alias("new"), F.size("found").alias("total"))
    # where the digests read at once account for the whole first table, nothing is left to peel
    sums = F.aggregate("found", F.struct(F.lit(0).cast("bigint").alias("keys"), F.lit(0).cast("bigint").alias("checks"), F.lit(0).cast("bigint").alias("n")),
                       lambda a, f: F.struct(a["keys"].bitwiseXOR(f["key"]).alias("keys"), a["checks"].bitwiseXOR(_check(f["key"])).alias("checks"), (a["n"] + f["n"]).alias("n")))
    none = F.lit(0).cast("bigint")
    complete = sums == F.struct(F.coalesce("all_keys", none).alias("keys"), F.coalesce("all_checks", none).alias("checks"), F.coalesce("all_n", none).alias("n"))
    peeled = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda acc, _: F.when((F.size(acc["rest"]) > 0) & (F.size(acc["new"]) > 0), take_out(acc)).otherwise(acc))
    end = F.when(complete, F.struct(F.size("found").alias("total"), F.lit(True).alias("whole"))).otherwise(
        F.transform(F.array(peeled), lambda e: F.struct(e["total"].alias("total"), (F.size(e["rest"]) == 0).alias("whole")))[0])
    return met.withColumn("end", end).select("bucket", "rn", "kind", "both", F.col("end.total").alias("differ"), F.col("end.whole").alias("whole"), "text", "about")


def likenesses(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text is the text whose last third is replaced by as much of the next document's beginning.
    """
    folder = Folder(docs.sparkSession, "fingerprint")
    rows = _versions(docs)
    done = folder.write(_peeled(_cells(rows, ROOM), ROOM), "sketches")
    room, failed = ROOM, done.filter("NOT whole").select("bucket", "rn").distinct()
    done = done.filter("whole")
    while not failed.isEmpty():
        room *= LARGER
        again = _peeled(_cells(rows.join(failed, ["bucket", "rn"], "left_semi"), room), room)
        fresh = folder.write(again.join(done.select("bucket", "rn", "kind"), ["bucket", "rn", "kind"], "left_anti"), "again")
        done = done.unionByName(fresh.filter("whole"))
        failed = fresh.filter("NOT whole").select("bucket", "rn").distinct()
    kinds = done.groupBy("bucket", "rn").agg(
        F.max("about").alias("about"), *[F.max(F.when(F.col("kind") == k, 1 - F.col("differ") / F.col("both"))).alias(f"near{k}") for k in (0, 1)],
        *[F.max(F.when(F.col("kind") == k, F.col("text"))).alias(f"print{k}") for k in (2, 3)])
    nothing = F.lit("")
    return kinds.select(
        "about.doc_id", "about.n_chars", "about.edited_sha256", F.coalesce("print2", nothing).alias("fingerprint"), F.coalesce("print3", nothing).alias("edited_fingerprint"),
        F.coalesce("near0", F.lit(1.0)).alias("near_edited"), F.coalesce("near1", F.lit(1.0)).alias("near_next"))
