"""Near-duplicate documents by BagMinHash over multisets of five-word shingles.

Every (shingle, dyadic range of its weight) has a Poisson process of points, seeded by its hash, with a rate as large as
the range; a point has a time, a place in the range found by halving it, and a component of the signature. It counts if
its place is below the shingle's weight, and each component keeps its earliest time: equal components then estimate the
weighted Jaccard similarity without bias. Points later than the latest kept time can't matter, so few are made.

Texts with one multiset form a class; representatives whose signatures agree in a whole band are linked to the smallest
of that bucket, and what these links connect is a group of candidates. In each group every text is compared exactly, by
multiset overlap, with every text it isn't connected to yet:

1. A group is one task's work, or is split into blocks by size and hash. Each block gets the group's first text, too, and
   is compared within itself. A text moves once.
2. Only texts that are not in their group's largest component then are left: these, in blocks, meet all blocks of the
   group whose texts are near enough in size to reach the threshold. Texts already connected are not compared.

Only a spanning set of links leaves a task.

Words are runs of letters and digits of the lower-cased text (every character outside ASCII counts as a letter). A text
of one to four words is one shingle; one without words is the class of its exact text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubla.llm.common import U64, byte_slices, components, join_counted, mix64, new_name, release, small, table, text_bytes

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 6
BLOCK_DOCS, BLOCK_WORDS = 1024, 150_000
STEP, GOLD = U64(0x9E3779B97F4A7C15 | 1), U64(0xD1B54A32D192ED03)
INVERSE = U64(pow(int(STEP), -1, 1 << 64))
LETTER = np.array([chr(i).isalnum() or i >= 128 for i in range(256)])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles, by row and hash, and the number of words of each row.

    text: without nulls. The hash of a word is that of its bytes wherever it stands, from one running sum over all of them.
    """
    data, offsets = text_bytes(pc.utf8_lower(text))
    n, rows = len(data), len(text)
    letter = LETTER[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    start = letter & (begins[:n] | ~np.concatenate([[False], letter[:-1]]))
    end = letter & (begins[1:] | ~np.concatenate([letter[1:], [False]]))
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    power = _powers(STEP, n)
    total = np.concatenate([[U64(0)], np.cumsum((data.astype(U64) + U64(1)) * power, dtype=U64)])
    word = mix64((total[e] - total[s]) * _powers(INVERSE, n)[s] + (e - s).astype(U64)) if len(s) else np.zeros(0, U64)
    row = np.searchsorted(offsets, s, side="right") - 1
    words = np.bincount(row, minlength=rows)
    padded = np.concatenate([word, np.zeros(WORDS, U64)])
    owner = np.concatenate([row, np.full(WORDS, -1)])
    sums = np.zeros(len(word), U64)
    for i, factor in enumerate(_powers(GOLD, WORDS + 1)[1:]):
        sums += np.where(owner[i : i + len(word)] == row, padded[i : i + len(word)] * factor, U64(0))
    nth = np.arange(len(row)) - (np.cumsum(words) - words)[row]
    fit = (nth == 0) | (nth + WORDS <= words[row])
    row, value = row[fit], mix64(sums[fit])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(first)
    return row[at], value[at], np.diff(np.append(at, len(row))), words


def signatures(row: np.ndarray, value: np.ndarray, count: np.ndarray, rows: int, size: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures (rows, size) as times; infinite for rows without shingles."""
    items = [(row, mix64(value), np.zeros(len(row), np.int64), np.ones(len(row), np.int64), count)]
    low = 1
    while (more := np.flatnonzero(count > low)).size:
        items.append((row[more], mix64(value[more] + _powers(GOLD, low + 1)[-1]), np.full(len(more), low), np.full(len(more), low), count[more]))
        low *= 2
    owner, seed, low, width, weight = (np.concatenate(x) for x in zip(*items, strict=True))
    out = np.full((rows, size), np.inf)
    flat, time, latest = out.reshape(-1), np.zeros(len(owner)), np.full(rows, np.inf)
    while len(owner):
        seed = seed + STEP
        h = mix64(seed)
        time = time - np.log1p(-(h >> U64(11)).astype(np.float64) * 2.0**-53) / width
        fit = time < latest[owner]
        if not fit.all():
            owner, seed, low, width, weight, time, h = owner[fit], seed[fit], low[fit], width[fit], weight[fit], time[fit], h[fit]
        h = mix64(h ^ GOLD)
        place = low + ((h >> U64(32)) * width.astype(U64) >> U64(32)).astype(np.int64)
        inside = place < weight
        part = ((h & U64(0xFFFFFFFF)) * U64(size) >> U64(32)).astype(np.int64)
        np.minimum.at(flat, (owner * size + part)[inside], time[inside])
        latest = out.max(1)
    return out


def _sketch(batch: pa.RecordBatch):
    """(words, c1, c2, bands) of a batch's texts: the class is a 128-bit hash of the multiset."""
    text = pc.fill_null(batch.column("text"), "")
    parts = []
    for a, b in byte_slices(text, 1 << 20):
        own = text.slice(a, b - a)
        row, value, count, words = shingles(own)
        n = b - a
        marks = []
        for salt in (U64(0x2545F4914F6CDD1D), U64(0x632BE59BD9B4E019)):
            sums = np.zeros(n, U64)
            np.add.at(sums, row, mix64(value * salt + count.astype(U64)))
            for i in np.flatnonzero(words == 0):
                raw = np.frombuffer(own[int(i)].as_py().encode("utf-8", "surrogatepass"), np.uint8).astype(U64)
                sums[i] = mix64(np.array([((raw + U64(1)) * _powers(salt, len(raw))).sum(dtype=U64) ^ salt]))[0]
            marks.append(sums.view(np.int64))
        bits = signatures(row, value, count, n).view(U64).reshape(n, BANDS, ROWS)
        keys = mix64((bits * _powers(GOLD, ROWS + 1)[1:]).sum(2, dtype=U64) + np.arange(1, BANDS + 1).astype(U64) * STEP).view(np.int64)
        keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
        parts.append((pa.array(words.astype(np.int64)), *map(pa.array, marks), pc.if_else(pa.array(words > 0), keys, pa.scalar(None, pa.list_(pa.int64())))))
    return parts


def _sketches(batches):
    for batch in batches:
        at = 0
        for part in _sketch(batch):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part[0])), *part], ["doc_id", "words", "c1", "c2", "bands"])
            at += len(part[0])
    release()


def _united(label: np.ndarray, linked: np.ndarray) -> np.ndarray:
    met = np.unique(label[linked])
    return np.where(np.isin(label, met), met[0], label) if len(met) > 1 else label


class _Bags:
    """Multisets of shingles by row, and their overlap with one of them."""

    def __init__(self, row: np.ndarray, value: np.ndarray, count: np.ndarray, rows: int):
        self.code, self.count, self.starts = np.unique(value, return_inverse=True)[1], count, np.searchsorted(row, np.arange(rows + 1))
        self.total, self.weight = np.bincount(row, count, rows), np.zeros(self.code.max(initial=-1) + 1)

    def near(self, x: int, low: int, high: int, threshold: float) -> np.ndarray:
        """Which of the rows from ``low`` to ``high`` reach the threshold with row ``x``."""
        own, first, last = slice(self.starts[x], self.starts[x + 1]), self.starts[low], self.starts[high]
        self.weight[self.code[own]] = self.count[own]
        sums = np.concatenate([[0.0], np.cumsum(np.minimum(self.weight[self.code[first:last]], self.count[first:last]))])
        both = np.diff(sums[self.starts[low : high + 1] - first])
        self.weight[self.code[own]] = 0
        total = self.total[low:high]
        return (both >= threshold * (self.total[x] + total - both) * (1 - 1e-12)) & (total > 0)


def connect(row: np.ndarray, value: np.ndarray, count: np.ndarray, label: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Components of texts whose multiset overlap reaches the threshold: each one's smallest row.

    label: the same for rows that are connected already, the smallest of them. A text is compared with all others until all
    outside the largest component have been.
    """
    rows = len(label)
    bags, waiting = _Bags(row, value, count, rows), np.ones(rows, bool)
    while waiting.any():
        largest = np.bincount(label, minlength=rows).argmax() if not waiting.all() else -1
        rest = np.flatnonzero(waiting & (label != largest))
        if not len(rest):
            break
        x = rest[0]
        waiting[x] = False
        linked = bags.near(x, 0, rows, threshold)
        linked[x] = True
        label = _united(label, linked)
    return label


def _ordered(group: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """Rows of a group by side (if any) and rep."""
    rep = group.column("rep").to_numpy()
    side = group.column("side").to_numpy() if "side" in group.column_names else np.zeros(len(rep), np.int32)
    order = np.lexsort((rep, side))
    return rep[order], group.take(pa.array(order))


def _within(threshold: float):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rep, group = _ordered(group)
        low = rep[connect(*shingles(group.column("text").combine_chunks())[:3], np.searchsorted(rep, rep), threshold)]
        return pa.table({"a": rep[rep != low], "b": low[rep != low]})

    return run


def _across(threshold: float):
    """Each text of side 0 with those of side 1 that have another label."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rep, group = _ordered(group)
        bags, n = _Bags(*shingles(group.column("text").combine_chunks())[:3], len(rep)), len(rep)
        left = int((group.column("side").to_numpy() == 0).sum())
        label = np.unique(group.column("label").to_numpy(), return_inverse=True)[1]
        links = []
        for x in range(left):
            if (label[left:] != label[x]).any():
                linked = np.flatnonzero(bags.near(x, left, n, threshold) & (label[left:] != label[x])) + left
                for y in linked:
                    if label[y] != label[x]:
                        links.append((rep[x], rep[y]))
                        label[label == label[y]] = label[x]
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _verified(met: DataFrame, members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The links (a, b) of at least ``threshold`` inside the groups that the pairs ``met`` connect: a spanning set of them.

    members: (rep, words); texts: (rep, text).
    """
    groups = components(met).select(F.col("id").alias("rep"), F.col("component").alias("g"))
    total = F.greatest(F.col("words") - (WORDS - 1), F.lit(1))
    sized = members.join(groups, "rep").withColumn("c", F.floor(F.log(total) / max(1e-6, float(np.log(1 / threshold)) * (1 + 1e-9))).cast("int"))
    sized = table(sized, "sized")
    count = lambda: F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("words") / BLOCK_WORDS)).cast("int")
    whole = table(sized.groupBy("g").agg(count().alias("all"), F.min("rep").alias("anchor")), "groups")
    split = table(sized.groupBy("g", "c").agg(count().alias("blocks")).join(small(whole.filter("all > 1")), "g"), "blocks")
    blocks, several = small(split), small(whole.filter("all > 1"))
    large = sized.join(blocks, ["g", "c"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    large = table(large.select("g", "c", "block", "rep", "words", "anchor"), "large")
    anchors = large.filter("rep = anchor").select("g", F.col("c").alias("own"), "rep").join(split.select("g", "c", "blocks"), "g").filter("abs(c - own) <= 1")
    anchors = anchors.select("g", "c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep")
    alone = sized.join(several.select("g"), "g", "left_anti").select("g", F.lit(-1).alias("c"), F.lit(0).alias("block"), "rep")
    placed = table(alone.unionByName(large.select("g", "c", "block", "rep")).unionByName(anchors), "placed")
    found = table(texts.join(small(placed), "rep").select("g", "c", "block", "rep", "text").groupBy("g", "c", "block").applyInArrow(_within(threshold), "a long, b long"), "within")
    if large.isEmpty():
        return found
    label = components(found).withColumnRenamed("id", "rep")
    large = table(large.join(label, "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component"), "labelled")
    sizes = large.groupBy("g", "label").agg(F.count("*").alias("n")).groupBy("g").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    open_ = table(large.join(small(table(sizes, "largest")), "g").filter("label <> largest").drop("largest"), "open")
    if open_.isEmpty():
        return found
    open_blocks = table(open_.groupBy("g", "c").agg(count().alias("opens")).withColumnRenamed("c", "oc"), "open_blocks")
    near = F.abs(F.col("c") - F.col("oc")) <= 1
    own = open_.withColumnRenamed("c", "oc").join(small(open_blocks), ["g", "oc"]).withColumn("ob", F.pmod(F.xxhash64("rep"), F.col("opens")).cast("int"))
    own = own.drop("block").join(small(split.select("g", "c", "blocks")), "g").filter(near).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    other = large.join(small(open_blocks), "g").filter(near).withColumn("ob", F.explode(F.sequence(F.lit(0), F.col("opens") - 1)))
    task = ["g", "oc", "ob", "c", "block"]
    sides = [df.select(*task, "rep", "label", F.lit(side).alias("side")) for side, df in enumerate((own, other))]
    meeting = table(sides[0].unionByName(sides[1]), "meeting")
    more = texts.join(small(meeting), "rep").select(*task, "rep", "label", "side", "text").groupBy(*task).applyInArrow(_across(threshold), "a long, b long")
    return found.unionByName(table(more, "across"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, class_id, copies, component_id, kept), one for each row of ``docs``.

    class_id: the smallest id of the texts with the same shingles, ``copies`` in number; component_id: the smallest id
    that links of at least ``threshold`` reach. A null text is an empty one. Rows that share a doc_id are one document, near
    to all that one of its texts is near to; rows without one are not compared and kept. A very long text is one row's work:
    its shingles take some 45 bytes for each byte of it. Other columns are not read; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.filter("doc_id is not null")
    sketch = table(known.mapInArrow(_sketches, "doc_id long, words long, c1 long, c2 long, bands array<long>"), "sketches")
    reps = table(sketch.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    own = F.when(F.col("doc_id") == F.col("rep"), F.col("bands"))
    total = sketch.count()
    members = table(join_counted(sketch, reps.withColumn("n", F.col("copies")), ["c1", "c2"], total).select("doc_id", "rep", "copies", "words", own.alias("bands")), "members")
    banded = members.filter("bands is not null").select("rep", F.explode("bands").alias("band"))
    lowest = banded.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("n")).filter("low < high").select("band", "low", "n")
    met = join_counted(banded, table(lowest, "buckets"), ["band"], BANDS * total).filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
    texts = known.select(F.col("doc_id").alias("rep"), F.coalesce("text", F.lit("")).alias("text"))
    if not members.groupBy("doc_id").count().filter("count > 1").isEmpty():
        texts = texts.distinct()
    linked = components(_verified(met, members.filter("bands is not null").select("rep", "words").distinct(), texts, threshold))
    done = members.join(linked.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    done = done.select("doc_id", F.col("rep").alias("class_id"), "copies", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    none = F.lit(None).cast("long")
    rest = docs.filter("doc_id is null").select("doc_id", none.alias("class_id"), F.lit(1).cast("long").alias("copies"), none.alias("component_id"), F.lit(True).alias("kept"))
    return done.unionByName(rest)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one of smallest id, once (any one of the rows that
    repeat it). All columns stay, whatever they are called; rows without an id stay; an empty table gives an empty result."""
    found = table(near_duplicates(docs, threshold).filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n")), "found")
    fits = lambda df: small(df, row=32)
    own = new_name(docs, "_named")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(own))
    again = found.filter("doc_id = component_id and n > 1").select(F.col("doc_id").alias(own))
    left = docs.join(fits(gone), F.col("doc_id") == F.col(own), "left_anti")
    if again.isEmpty():
        return left
    repeats = left.join(fits(again), F.col("doc_id") == F.col(own), "left_semi").dropDuplicates(["doc_id"])
    return left.join(fits(again), F.col("doc_id") == F.col(own), "left_anti").unionByName(repeats)


def op10_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
