"""What several operators share: written tables, held-out folds, Arrow text buffers and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
BROADCAST_BYTES = 48 << 20
HOT_SHARE = 1000
#: Links that one task joins into components (16 MB of numbers); more go through rounds.
FEW_LINKS = 1 << 20
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. One of our own only on a local master: a cluster without a shared one is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="nubla-"))
        if not own:
            _delete_at_end(spark, sc.getCheckpointDir())
    return sc.getCheckpointDir()


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the application ends: results that are read lazily need it until then."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder, which goes when the application ends, and read it again. What was
    shuffled for it goes at once, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    folder, before = f"{shared_dir(spark)}/nubla-{uuid.uuid4().hex}", spark.conf.get(CLEAN, None)
    _delete_at_end(spark, folder)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(f"{folder}/{name}")
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def fits(df: DataFrame, *parts: str, row: int = 100, part: int = 40, chars: tuple[str, ...] = (), most: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` takes ``most`` bytes at most: ``row`` bytes a row, ``part`` bytes for each element of its array columns
    ``parts``, and four for each character of its text columns ``chars``. Counts it, so give a written table."""
    sizes = sum((F.coalesce(F.sum(F.size(p)), F.lit(0)) for p in parts), F.lit(0))
    texts = sum((F.coalesce(F.sum(F.length(c)), F.lit(0)) for c in chars), F.lit(0))
    rows, items, letters = df.agg(F.count("*"), sizes, texts).first()
    return rows * row + items * part + letters * 4 <= most


def small(df: DataFrame, *parts: str, **how) -> DataFrame:
    """``df`` to be broadcast if it ``fits``, else as it is."""
    return F.broadcast(df) if fits(df, *parts, **how) else df


def join_counted(many: DataFrame, one: DataFrame, on: list[str], total: int, fit: str = "true") -> DataFrame:
    """``many`` joined with ``one``, which has a row for each key with ``n``, its number of rows in ``many`` (``total`` in all).

    Keys with more than one in ``HOT_SHARE`` of all rows, of which there are fewer than ``HOT_SHARE``, are broadcast, so no
    task gets all rows of such a key; the others meet by a shuffle. fit: what else a broadcast row must satisfy.
    """
    test = F.coalesce((F.col("n") > total // HOT_SHARE) & F.expr(fit), F.lit(False))
    hot = F.broadcast(one.filter(test))
    rest = many.join(F.broadcast(one.filter(test).select(*on)), on, "left_anti").join(one.filter(~test), on)
    return many.join(hot, on).unionByName(rest)


def new_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column is called so (names don't tell case apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as ``select`` and ``col`` take it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with names that any function takes, to be named again with ``toDF``."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 3 is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def within(rows: DataFrame, by: str, place: Column, size: Column, most_rows: int, most_size: int) -> DataFrame:
    """The first ``most_rows`` rows of each value of ``by`` in the order of ``place``, of ``most_size`` in all and one more at
    most. Give few rows: a value's rows are sorted together."""
    names, order = rows.columns, Window.partitionBy(by).orderBy(place)
    rows = rows.withColumn("_nth", F.row_number().over(order)).withColumn("_before", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size)
    return rows.filter((F.col("_nth") <= most_rows) & (F.col("_before") < most_size)).select(*names)


def sampled(rows: DataFrame, by: str, key: str, per_value: int, most_rows: int, size: Column | None = None, most_size: int = 1) -> DataFrame:
    """Up to ``per_value`` rows for each value of ``by``, chosen by a hash of ``key``: fewer of each where there are so many
    values that this would exceed ``most_rows``, or a value's share of ``most_size`` in the sum of ``size``, yet one of each
    value at least. Counts all rows first."""
    counts = table(rows.groupBy(by).agg(F.count("*").alias("_n")), "counts")
    values = max(1, counts.count())
    each = max(1, min(per_value, most_rows // values))
    grain = 1 << 30
    share = F.least(F.lit(grain), F.floor((F.lit(2.0 * each) + 20) * grain / F.col("_n")) + 1)
    hashed = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(grain))
    some = rows.join(small(counts), by).filter(hashed < share).drop("_n")
    order = F.struct(hashed, F.col(key))
    return within(some, by, order, F.lit(0) if size is None else size, each, max(1, most_size // values))


def release() -> None:
    """Give memory that a task no longer uses back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def byte_slices(text: pa.Array, most: int):
    """Ranges of rows of at most ``most`` bytes of text (or one longer row)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(text):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, to
        at = to


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls."""
    text = text.cast(pa.large_string())
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (three xor-shift-multiply rounds)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of ``n`` nodes under the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):  # the labels' own nodes, too, so that long paths take few rounds
            np.minimum.at(new, x, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label


def _joined(batches):
    """Rows (id, component) of all links of a task."""
    found = [np.stack([b.column(c).to_numpy() for c in ("u", "v")]) for b in batches]
    if found:
        ids, at = np.unique(np.concatenate(found, axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[local_components(len(ids), a, b)])], ["id", "component"])
    release()


def components(edges: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """Connected components of the links (a long, b long): rows (id, component), the smallest reachable id.

    Up to ``few`` links are one task's work, as rounds of Spark jobs over few rows cost the driver more memory than they
    spare a task. More go through alternating large-star and small-star rounds, until every node hangs on one root directly;
    each round is a grouped minimum and a join, in which hot centres are broadcast. Nodes without links do not appear.
    """
    links = table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while (n := links.count()) > few:
        if not _unsettled(links):
            roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_counted(both.filter("v > u"), low, ["u"], 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        down = join_counted(large, low, ["u"], 2 * n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = table(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
    return table(links.repartition(1).mapInArrow(_joined, "id long, component long"), "components")


def _unsettled(links: DataFrame) -> bool:
    """Whether some node has two parents, or is a parent and a child."""
    ends = links.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    bad = ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or (up = 1 and down > 0)")
    return not bad.isEmpty()
