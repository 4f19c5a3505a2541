"""Phrases mined by contiguous pattern growth (in the manner of PrefixSpan) and scored by how their parts hold together.

1. Words are counted by language, and hashed word pairs, too. What is too rare can't be part of a phrase; a Bloom filter of
   the frequent pairs (``FILTER_BITS`` at most) tells the tasks. Its false positives, and it says yes to nearly all where
   there are more frequent pairs than it can hold, cost work and change no count.
2. An occurrence pointer is a frequent word with the up to three words that follow it in its piece, as far as pairs are
   frequent. Equal ones of a batch are one row with their number. They go to the task of their prefix, which grows it depth
   first: it counts the words that follow, projects the pointers onto each frequent one, and goes on with that.
3. A prefix is one word; two words where that word is frequent beyond ``HOT_ROWS`` occurrences or a ``HOT_SHARE``-th of all.
   Where such a pair is, too, its pointers are counted by partial sums and no task gets them all. So a task's group has at
   most ``HOT_ROWS`` rows however large the table is, and all its occurrences are in it.
4. Scores, and what lies inside longer phrases, are joins and grouped maxima on frequent phrases, and the first ranks are
   found in two steps, so no language is sorted in one task.

Counts are exact: hashes only choose tasks and leave out what is too rare.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nubla.llm.common import U64, byte_slices, mix64, release, small, table, text_bytes

LEAST = 30
LONGEST = 4
FIRST = 2000
COVER = 80
SCALE = 2_000_000
HOT_ROWS, HOT_SHARE = 1_000_000, 2000
FILTER_BITS = 1 << 28
SLICE = 1 << 20
GROUP_ROWS = 1 << 16
SALTS = 64
STEP = U64(0x9E3779B97F4A7C15 | 1)
INVERSE = U64(pow(int(STEP), -1, 1 << 64))
PROBES = mix64(np.arange(1, 5))
WORD, BLANK, BREAK = range(3)


def _kinds() -> np.ndarray:
    table_ = np.full(256, WORD, np.uint8)
    table_[[0x09, 0x20]] = BLANK
    table_[list(b".,;:!?")] = BREAK
    table_[0x0A:0x0E] = BREAK
    return table_


KINDS = _kinds()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words_of(text: pa.Array, lang: pa.Array):
    """(dictionary of words, its hashes, code of each word, its piece's number, code of its language, languages), in order.

    text and lang: without nulls. Letters A to Z are lower-cased; a piece ends at a mark, a line's end and a text's end.
    """
    data, offsets = text_bytes(text)
    data = LOWER[data]
    kind = KINDS[data]
    n = len(data)
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    word = kind == WORD
    s = np.flatnonzero(word & (begins[:n] | ~np.concatenate([[False], word[:-1]])))
    e = np.flatnonzero(word & (begins[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    row = np.searchsorted(offsets, s, side="right") - 1
    piece = np.cumsum(kind == BREAK, dtype=np.int32)[s] + row if len(s) else np.zeros(0, np.int64)
    bounds = np.append(np.column_stack([s, e]).ravel(), n).astype(np.int64)
    every = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    coded = every.take(pa.array(np.arange(len(s)) * 2)).dictionary_encode()
    langs = lang.dictionary_encode()
    return coded.dictionary, hashes(coded.dictionary), coded.indices.to_numpy(), piece, langs.indices.to_numpy()[row], langs.dictionary


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of texts' bytes."""
    data, offsets = text_bytes(words)
    power = np.full(len(data), STEP, U64)
    power[:1] = 1
    back = np.full(len(data) + 1, INVERSE, U64)
    back[0] = 1
    total = np.concatenate([[U64(0)], np.cumsum((data.astype(U64) + U64(1)) * np.multiply.accumulate(power), dtype=U64)])
    return mix64((total[offsets[1:]] - total[offsets[:-1]]) * np.multiply.accumulate(back)[offsets[:-1]] + np.diff(offsets).astype(U64))


def pair_keys(first: np.ndarray, second: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """32-bit keys of word pairs in a language, as int64."""
    return (mix64(first * STEP + second + (lang ^ INVERSE) * U64(3)) >> U64(32)).astype(np.int64)


def word_keys(word: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return (mix64(word + (lang ^ INVERSE) * U64(3)) >> U64(1)).astype(np.int64)


def _slices(batch: pa.RecordBatch):
    text = pc.fill_null(batch.column("text"), "")
    lang = batch.column("lang")
    for a, b in byte_slices(text, SLICE):
        yield words_of(text.slice(a, b - a), lang.slice(a, b - a))


def _weighed(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their weights (their numbers)."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights, len(found)).astype(np.int64)


def _counts(batches):
    """Rows (lang, word, key, n): words; pairs by key alone; and each language's words in all (neither)."""
    names = ["lang", "word", "key", "n"]
    for batch in batches:
        for words, hashed, code, piece, lang, langs in _slices(batch):
            if not len(code):
                continue
            lang_hash = hashes(langs)
            own, n = _weighed(lang.astype(np.int64) * len(words) + code)
            of, word = own // len(words), own % len(words)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(of)).cast(pa.string()), words.take(pa.array(word)).cast(pa.string()), pa.array(word_keys(hashed[word], lang_hash[of])), pa.array(n)], names)
            of, n = _weighed(lang)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(of)).cast(pa.string()), pa.nulls(len(of), pa.string()), pa.nulls(len(of), pa.int64()), pa.array(n)], names)
            next_to = np.flatnonzero(piece[1:] == piece[:-1])
            key, n = _weighed(pair_keys(hashed[code[next_to]], hashed[code[next_to + 1]], lang_hash[lang[next_to]]))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.string()), pa.nulls(len(key), pa.string()), pa.array(key), pa.array(n)], names)
    release()


class Filter:
    """A Bloom filter of a table's column ``key``, of 16 bits for each key but ``most`` in all. Tasks make the bits, the
    driver gets the cells of 64 that hold any: ``most`` / 64 rows at the utmost."""

    def __init__(self, keys: DataFrame, most: int = FILTER_BITS):
        self.size, n = 64, keys.count()
        while self.size < min(most, 16 * n):
            self.size *= 2
        self.cells = np.zeros(self.size // 64, U64)

        def marked(batches):
            for batch in batches:
                for at in self._places(batch.column("key").to_numpy()):
                    yield pa.RecordBatch.from_arrays([pa.array((at >> U64(6)).astype(np.int64)), pa.array((U64(1) << (at & U64(63))).view(np.int64))], ["cell", "bits"])

        made = keys.mapInArrow(marked, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.cells[made.column("cell").to_numpy()] = made.column("bits").to_numpy().view(U64)

    def _places(self, keys: np.ndarray) -> list[np.ndarray]:
        return [mix64(keys.view(U64) ^ salt) & U64(self.size - 1) for salt in PROBES]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._places(keys):
            out &= (self.cells[at >> U64(6)] >> (at & U64(63))) & U64(1) == 1
        return out


def _pointers(frequent: Filter, hot_words: Filter, hot_pairs: Filter):
    """Rows (task, lang, head, words, n): head: how many words choose the task; words: up to ``LONGEST``, joined by newlines."""

    def run(batches):
        names = ["task", "lang", "head", "words", "n"]
        for batch in batches:
            for words, hashed, code, piece, lang, langs in _slices(batch):
                if len(code) < 2:
                    continue
                lang_hash = hashes(langs)
                key = pair_keys(hashed[code[:-1]], hashed[code[1:]], lang_hash[lang[:-1]])
                goes = np.append((piece[1:] == piece[:-1]) & frequent.holds(key), False)
                at = np.flatnonzero(goes)
                matrix = np.full((len(at), LONGEST), -1, np.int32)
                matrix[:, 0], matrix[:, 1] = code[at], code[at + 1]
                on = goes[at + 1]
                for j in range(2, LONGEST):
                    matrix[on, j] = code[at[on] + j]
                    on = on & goes[np.minimum(at + j, len(goes) - 1)]
                one = hot_words.holds(word_keys(hashed[code[at]], lang_hash[lang[at]]))
                head = np.where(one, np.where(hot_pairs.holds(key[at]), 0, 2), 1)
                rows = pa.table({"lang": lang[at], "head": head.astype(np.int8), **{f"w{j}": matrix[:, j] for j in range(LONGEST)}})
                rows = rows.group_by(rows.column_names).aggregate([([], "count_all")])
                of, head = rows.column("lang").to_numpy(), rows.column("head").to_numpy()
                codes = [rows.column(f"w{j}").to_numpy() for j in range(LONGEST)]
                task = mix64(lang_hash[of] + hashed[codes[0]] * STEP + np.where(head == 2, hashed[codes[1]], U64(0)) * INVERSE).view(np.int64)
                parts = [words.take(pa.array(c, mask=c < 0)) for c in codes]
                joined = pc.binary_join_element_wise(*parts, pa.scalar("\n", pa.large_string()), null_handling="skip").cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(task), langs.take(pa.array(of)).cast(pa.string()), pa.array(head.astype(np.int32)), joined, rows.column("count_all").combine_chunks().cast(pa.int64())], names)
        release()

    return run


def grow(prefix: tuple[int, ...], pointers: np.ndarray, codes: np.ndarray, n: np.ndarray, least: int, emit) -> None:
    """Depth first: each word that follows ``prefix`` at least ``least`` times makes a longer one, grown on its pointers.

    codes: (pointers, words) with -1 after the last; n: how many occurrences a pointer stands for.
    """
    if len(prefix) == codes.shape[1] or not len(pointers):
        return
    following = codes[pointers, len(prefix)]
    order = np.argsort(following, kind="stable")
    following, pointers = following[order], pointers[order]
    edges = np.flatnonzero(np.append(True, following[1:] != following[:-1]))
    totals = np.add.reduceat(n[pointers], edges)
    for i in np.flatnonzero((totals >= least) & (following[edges] >= 0)):
        longer = (*prefix, int(following[edges[i]]))
        emit(longer, int(totals[i]))
        grow(longer, pointers[edges[i] : edges[i + 1] if i + 1 < len(edges) else len(following)], codes, n, least, emit)


def _mine(least: int):
    """Phrases (lang, words, a) of the pointers of whole tasks; a task's rows come together."""

    def mined(rows: pa.Table) -> pa.RecordBatch:
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        split = pc.split_pattern(rows.column("words").combine_chunks(), "\n")
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        codes = np.full((len(sizes), LONGEST), -1, np.int32)
        codes[np.arange(LONGEST) < sizes[:, None]] = coded.indices.to_numpy()
        n, head, task = (rows.column(c).to_numpy() for c in ("n", "head", "task"))
        lang = langs.indices.to_numpy()
        # A task's number is a hash: rows of different prefixes that share one are told apart here.
        second = np.where(head == 2, codes[:, 1], -1)
        order = np.lexsort((second, codes[:, 0], lang, head, task))
        same = np.stack([task, lang, codes[:, 0], second, head])[:, order]
        edges = np.append(np.flatnonzero(np.append(True, (same[:, 1:] != same[:, :-1]).any(0))), len(order))
        found, counts, of = [], [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            pointers = order[a:b]
            total = int(n[pointers].sum())
            if total < least:
                continue
            first = pointers[0]
            prefix = tuple(int(c) for c in codes[first, : head[first]])
            before = len(found)
            if len(prefix) == 2:
                found.append(prefix)
                counts.append(total)
            grow(prefix, pointers, codes, n, least, lambda p, t: (found.append(p), counts.append(t)))
            of += [lang[first]] * (len(found) - before)
        matrix = np.full((len(found), LONGEST), -1, np.int32)
        for i, p in enumerate(found):
            matrix[i, : len(p)] = p
        parts = [coded.dictionary.take(pa.array(matrix[:, j], mask=matrix[:, j] < 0)) for j in range(LONGEST)]
        joined = pc.binary_join_element_wise(*parts, pa.scalar("\n", coded.dictionary.type), null_handling="skip")
        return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(of, pa.int32())), joined, pa.array(counts, pa.int64())], ["lang", "words", "a"])

    def run(batches):
        waiting, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column("task").to_numpy()
            if waiting and waiting[-1].column("task")[-1].as_py() != task[0] and rows > GROUP_ROWS:
                yield mined(pa.Table.from_batches(waiting))
                waiting, rows = [], 0
            waiting.append(batch)
            rows += batch.num_rows
            if rows > GROUP_ROWS and task[0] != task[-1]:
                last = int(np.flatnonzero(task != task[-1])[-1]) + 1  # rows before the last task's
                yield mined(pa.Table.from_batches([*waiting[:-1], batch.slice(0, last)]))
                waiting, rows = [batch.slice(last)], batch.num_rows - last
        if rows:
            yield mined(pa.Table.from_batches(waiting))
        release()

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(rows (lang, words, a): words and phrases of up to ``LONGEST`` words that occur at least ``least`` times, words
    joined by newlines, which no word holds; rows (lang, n): each language's words).

    docs: text and lang; a null text is empty, a null lang is ``und``.
    """
    docs = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    counted = docs.mapInArrow(_counts, "lang string, word string, key long, n long")
    counted = counted.groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))
    counted = table(counted.filter((F.col("n") >= least) | F.col("key").isNull()), "counts")
    sizes = counted.filter("key is null").select("lang", "n")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = max(least, min(HOT_ROWS, total // HOT_SHARE))
    words, pairs = counted.filter("word is not null"), counted.filter("word is null and key is not null")
    filters = [Filter(df.select("key")) for df in (pairs, words.filter(f"n > {hot}"), pairs.filter(f"n > {hot}"))]
    made = table(docs.mapInArrow(_pointers(*filters), "task long, lang string, head int, words string, n long").groupBy("task", "lang", "head", "words").agg(F.sum("n").alias("n")), "pointers")
    tasks = made.filter("head > 0").repartition("task").sortWithinPartitions("task")
    grown = tasks.mapInArrow(_mine(least), "lang string, words string, a long")
    split = F.split("words", "\n")
    begun = F.transform(F.sequence(F.lit(2), F.size("parts")), lambda k: F.array_join(F.slice("parts", 1, k), "\n"))
    hottest = made.filter("head = 0").select("lang", split.alias("parts"), "n").select("lang", F.explode(begun).alias("words"), "n")
    hottest = hottest.groupBy("lang", "words").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    alone = words.select("lang", F.col("word").alias("words"), F.col("n").alias("a"))
    return table(grown.unionByName(hottest).unionByName(alone), "frequent"), sizes


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, cover: int = COVER) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases of two to four words.

    A phrase occurs ``a`` times, at least ``least``; of its cuts into two parts, which occur l and r times, the one of least
    score floor(2,000,000 a / (l + r)) counts, of equal ones that of the shorter first part. Phrases go that lie within a
    longer one which occurs at least ``cover`` hundredths as often, whether that goes itself or not. n: the language's
    words. Order: score and a descending, then the phrase's UTF-8 bytes.

    Null texts are empty ones, null languages ``und``; repeated rows count as often as they occur; a very long text is one
    row's work. Languages without a phrase have no row; other columns are not read; an empty table gives an empty result.
    """
    found, sizes = frequent_phrases(docs, least)
    parts = F.split("words", "\n")
    long = found.select("lang", "words", "a", parts.alias("parts")).filter("size(parts) >= 2")
    cut = long.select("lang", "words", "a", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"))
    joined = lambda start, size: F.array_join(F.slice("parts", start, size), "\n")
    cut = table(cut.select("lang", "words", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("parts") - F.col("k")).alias("right")), "cuts")
    known = small(found.select("lang", "words", "a"), row=200)
    left, right = (known.select("lang", F.col("words").alias(side), F.col("a").alias(c)) for side, c in (("left", "l"), ("right", "r")))
    exact = F.expr(f"cast((cast(a as decimal(20, 0)) * {SCALE}) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as long)")
    scored = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", exact)
    scored = scored.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "words", "a", "best.score", "best.l", "best.r")
    place = F.flatten(F.transform(F.sequence(F.lit(2), F.size("parts") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.size("parts") - size + 1), lambda at: F.array_join(F.slice("parts", at, size), "\n"))))
    inside = long.filter("size(parts) > 2").select("lang", F.explode(place).alias("words"), "a").groupBy("lang", "words").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(25, 0)")
    left_ = scored.join(inside, ["lang", "words"], "left").filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * cover))
    left_ = left_.withColumn("phrase", F.translate("words", "\n", " ")).drop("words", "longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = left_.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= first)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = rf"""
with piece as (
  select coalesce(lang, 'und') as lang, row_number() over () as p, words from (
    select lang, list_filter(regexp_split_to_array(x, '[ \t]+'), lambda w: w <> '') as words from (
      select lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as x from documents))),
gram as (
  select lang, k, words[i : i + k - 1] as g, count(*)::bigint as a
  from (select lang, words, unnest(range(1, len(words) + 1)) as i from piece) t, range(1, {LONGEST + 1}) u(k) where i + k - 1 <= len(words) group by all),
size as (select lang, sum(len(words))::bigint as n from piece group by 1),
long as (select * from gram where k >= 2 and a >= {LEAST}),
cut as (
  select c.lang, c.g, c.a, j, x.a as l, y.a as r, ({SCALE}::hugeint * c.a // (x.a::hugeint + y.a))::bigint as score
  from (select *, unnest(range(1, k)) as j from long) c join gram x on x.lang = c.lang and x.g = c.g[1 : j] join gram y on y.lang = c.lang and y.g = c.g[j + 1 : c.k]),
best as (select * from cut qualify row_number() over (partition by lang, g order by score, j) = 1),
inside as (
  select lang, g[i : i + s - 1] as g, max(a) as longer
  from (select lang, g, a, k, s, unnest(range(1, k - s + 2)) as i from (select *, unnest(range(2, k)) as s from long where k > 2)) group by 1, 2),
ranked as (
  select b.*, array_to_string(b.g, ' ') as phrase from best b left join inside i on i.lang = b.lang and i.g = b.g where i.g is null or i.longer::hugeint * 100 < b.a::hugeint * {COVER}),
placed as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from ranked)
select lang, rank, phrase, a, l, r, n, score from placed join size using (lang) where rank <= {FIRST}
"""
