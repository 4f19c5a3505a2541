"""Removal of repeated multi-line chunks whose boundaries follow from the content.

Blank lines aside, a hash of each line feeds a rolling (cyclic polynomial) hash over ``WINDOW`` lines, and a chunk ends
where that is 0 modulo ``DIVISOR``. So every boundary follows from the lines before it, and an insertion moves only those
near it. Chunks of two lines or more with ``LEAST`` words, and lines of ``LONG`` words, that repeat by hash are compared
byte by byte; the first occurrence (smallest doc_id, then digest of the text, then position) stays, later ones go.

A repeated chunk is extended to its neighbours: two neighbouring lines that stood together before are linked, and a run of
linked lines goes with the chunk in it. As a short passage may hold no whole chunk, a run of ``RUN`` words goes without
one, too; a shorter run without a chunk, such as an ordinary pair of lines, stays. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nubla.llm.common import join_counted, new_name, quoted, small, table

WINDOW = 2
DIVISOR = 2
LEAST = 20
RUN = 30
LONG = 50
LAST = (1 << 63) - 1


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long")


def _words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: a plain column could be computed anew for every element."""
    return F.transform(F.array(value), body)[0]


def _full(text: Column) -> Column:
    """array<struct<i, line>>: the lines that aren't blank, with their numbers from 1."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct((i + 1).alias("i"), x.alias("line"))), lambda s: F.trim(s["line"]) != "")


def _ends(hashes: Column) -> Column:
    """The places of the lines that end a chunk."""

    def ends(i: Column) -> Column:
        rolled = F.element_at(hashes, i)
        for back in range(1, WINDOW):
            before = F.try_element_at(hashes, F.when(i > back, i - back).otherwise(F.size(hashes) + 1))
            rolled = rolled.bitwiseXOR(F.coalesce(F.shiftright(before, back), F.lit(0)))
        return (rolled % DIVISOR == 0) | (i == F.size(hashes))

    return F.filter(F.sequence(F.lit(1), F.size(hashes)), ends)


def _places(lines: Column) -> Column:
    """array<struct<a, b, sure>>: from which to which of its lines each piece of a document reaches; sure: whether it goes by
    itself where it repeats (chunks and long lines), or links lines (pairs)."""

    def pieces(cuts: Column, words: Column) -> Column:
        place = lambda a, b, sure: F.struct(a.alias("a"), b.alias("b"), F.lit(sure).alias("sure"))
        begin = lambda k: F.when(k == 0, F.lit(1)).otherwise(F.element_at(cuts, F.greatest(k, F.lit(1))) + 1)
        size = lambda p: F.aggregate(F.slice(words, p["a"], p["b"] - p["a"] + 1), F.lit(0), lambda n, w: n + w)
        chunks = F.filter(F.transform(cuts, lambda e, k: place(begin(k), e, True)), lambda p: (p["b"] > p["a"]) & (size(p) >= LEAST))
        numbers = F.sequence(F.lit(1), F.size(words))
        alone = F.transform(F.filter(numbers, lambda i: F.element_at(words, i) >= LONG), lambda i: place(i, i, True))
        pairs = F.transform(F.filter(numbers, lambda i: i > 1), lambda i: place(i - 1, i, False))
        return F.concat(chunks, alone, pairs)

    texts = F.transform(lines, lambda s: s["line"])
    found = _let(F.transform(texts, _line_hash), lambda hashes: _let(_ends(hashes), lambda cuts: _let(F.transform(texts, _words), lambda words: pieces(cuts, words))))
    return F.when(F.size(lines) > 0, found).otherwise(F.from_json(F.lit("[]"), "array<struct<a:int,b:int,sure:boolean>>"))


def _text(lines: Column, a: Column, b: Column) -> Column:
    return F.array_join(F.transform(F.slice(lines, a, b - a + 1), lambda s: s["line"]), "\n")


def _key() -> Column:
    """A row's key: its id (``LAST`` where it has none) and its text's digest."""
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key().alias("key"), "text").filter("text is not null")


def repeated(docs: DataFrame) -> DataFrame:
    """Rows (key, runs): array<struct<first, last, sure>> of the runs of lines in a document that occurred before, by their
    numbers from 1; sure: whether a run holds a chunk or long line that did."""
    keyed = _keyed(docs)
    hashed = _let(_full(F.col("text")), lambda lines: F.transform(_places(lines), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), p["sure"].alias("sure"), F.xxhash64(_text(lines, p["a"], p["b"])).alias("h"))))
    narrow = table(keyed.select("key", F.inline(hashed)), "pieces")
    places = {"id": F.col("key.id"), "text": F.xxhash64("key.digest"), "a": F.col("a")}
    spread = [f(c).alias(f"{n}_{name}") for name, c in places.items() for n, f in (("low", F.min), ("high", F.max))]
    # In two places at least: rows that are equal in id and text are one place.
    twice = narrow.groupBy("h").agg(F.count("*").alias("n"), *spread).filter(" or ".join(f"low_{p} < high_{p}" for p in places))
    twice = table(twice.select("h", "n"), "twice")
    marked = table(join_counted(narrow, twice, ["h"], narrow.count()).groupBy("key").agg(F.collect_set(F.struct("a", "b", "sure", "h")).alias("marks")), "marks")
    marked = marked.select(F.col("key").alias("_key"), "marks")
    texts = keyed.join(small(marked, "marks"), F.col("key") == F.col("_key"))
    piece = lambda lines, m: _text(lines, m["a"], m["b"])
    spans = _let(_full(F.col("text")), lambda lines: F.transform("marks", lambda m: F.struct(m["h"].alias("h"), m["sure"].alias("sure"), F.element_at(lines, m["a"])["i"].alias("first"), F.element_at(lines, m["b"])["i"].alias("last"), piece(lines, m).alias("piece"))))
    digest = F.unhex(F.sha2(F.col("piece").cast("binary"), 256))
    found = table(texts.select("key", F.inline(spans)).withColumn("digest", digest), "repeats")
    place = F.struct("key", "first")
    # The pieces are compared as they are; their digests only lead from the first place back to the others.
    stays = found.groupBy("h", "piece").agg(F.min(place).alias("stays"), F.max(place).alias("last_place"), F.count("*").alias("n")).filter("stays < last_place")
    stays = table(stays.select("h", digest.alias("digest"), "stays", "n"), "stays")
    narrow_found = found.select("key", "first", "last", "sure", "h", "digest")
    gone = join_counted(narrow_found, stays, ["h", "digest"], found.count()).filter(place != F.col("stays")).select("key", "first", "last", "sure")
    by = Window.partitionBy("key").orderBy("first", "last")
    begins = F.col("first") > F.coalesce(F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = gone.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("key", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("sure").alias("sure"))
    return runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "last", "sure"))).alias("runs"))


def _merged(spans: Column) -> Column:
    """Sorted ranges, of which neither end ever falls, with those that touch or overlap made one."""
    gap = lambda v, i: F.element_at(v, i + 1)["first"] > F.element_at(v, i)["last"] + 1
    firsts = lambda v: F.filter(v, lambda s, i: F.when(i == 0, True).otherwise(gap(v, F.greatest(i, F.lit(1)))))
    lasts = lambda v: F.filter(v, lambda s, i: F.when(i + 1 == F.size(v), True).otherwise(gap(v, F.least(i + 1, F.size(v) - 1))))
    return _let(spans, lambda v: F.zip_with(firsts(v), lasts(v), lambda x, y: F.struct(x["first"].alias("first"), y["last"].alias("last"))))


def _going(lines: Column, runs: Column) -> Column:
    """The runs that go, as ranges that don't touch: those with a chunk or long line, or of ``RUN`` words."""
    size = lambda r: F.aggregate(F.slice(lines, r["first"], r["last"] - r["first"] + 1), F.lit(0), lambda n, x: n + F.when(F.trim(x) != "", _words(x)).otherwise(0))
    return _merged(F.filter(runs, lambda r: r["sure"] | (size(r) >= RUN)))


def _without(lines: Column, spans: Column) -> Column:
    """The lines outside of some ranges, joined."""
    after = lambda k: F.when(k == 0, F.lit(1)).otherwise(F.element_at(spans, F.greatest(k, F.lit(1)))["last"] + 1)
    ahead = F.transform(spans, lambda s, k: F.slice(lines, after(k), s["first"] - after(k)))
    tail = F.slice(lines, F.element_at(spans, -1)["last"] + 1, F.size(lines))
    return F.array_join(F.flatten(F.concat(ahead, F.array(tail))), "\n")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated pieces cut out of ``text``, and two columns more at the end: ``_lines``, how many there were,
    and ``_removed``, array<struct<first, last>> of what went (null where nothing did); with more underscores where a name
    is taken.

    Null texts stay null and empty ones empty; a document of which all lines go keeps its row with an empty text. Rows are
    told apart by doc_id and text, so null or repeated ids are documents of their own; rows equal in both are one document,
    and each keeps what that keeps. A very long text is handled within its row, in time and memory that grow with its length.
    Other columns pass through, whatever they are called. An empty table gives an empty result.
    """
    gone = table(repeated(docs), "removed")
    own, other, found, lines = (new_name(docs, n) for n in ("_id", "_gone", "_removed", "_lines"))
    gone = gone.select(F.col("key").alias(other), F.col("runs").alias(found))
    joined = docs.withColumn(own, F.when(F.col("text").isNotNull(), _key())).join(small(gone, found), F.col(own) == F.col(other), "left").drop(own, other)
    some = F.col(found).isNotNull() & F.col("text").isNotNull()
    going = F.when(some, _let(F.split("text", "\n", -1), lambda split: _going(split, F.col(found))))
    joined = joined.withColumn(found, F.when(F.size(going) > 0, going))
    # The ranges are named once more, so that they are made once and not for each of them.
    left = _let(F.col(found), lambda ranges: _let(F.split("text", "\n", -1), lambda split: _without(split, ranges)))
    text = F.when(F.col(found).isNull(), F.col("text")).otherwise(left)
    counted = joined.withColumn(lines, F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))).withColumn("text", text)
    return counted.select(*map(quoted, docs.columns), lines, found)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: lines, lines removed, the ranges removed, and the text that stays."""
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    spans = F.array_join(F.transform("_removed", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",")
    count = F.aggregate("_removed", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.col("_lines"))
    return done.select("doc_id", lines.cast("long").alias("n_lines"), F.coalesce(count, F.lit(0)).cast("long").alias("n_removed"), F.coalesce(spans, F.lit("")).alias("removed"), "text")


ORACLE_SQL = f"""
with doc as (
  select row_number() over (order by id, digest) as key, * from (
    select distinct coalesce(doc_id, {LAST}) as id, md5(text) as digest, string_split(text, chr(10)) as lines from documents where text is not null)),
line as (select key, i, lines[i] as l from doc, unnest(range(1, len(lines) + 1)) u(i)),
hashed as (
  select *, ('0x' || substr(md5(l), 1, 15))::bigint as h, length(l) - length(replace(l, ' ', '')) + 1 as words from line where trim(l) <> ''),
cuts as (
  select *, xor(h, coalesce(lag(h) over w, 0) >> 1) % {DIVISOR} = 0 as cut, lag(i) over w as before, lag(l) over w as l_before from hashed window w as (partition by key order by i)),
part as (
  select *, coalesce(sum(case when cut then 1 else 0 end) over (partition by key order by i rows between unbounded preceding and 1 preceding), 0) as c from cuts),
piece as (
  select key, min(i) as first, max(i) as last, true as sure, string_agg(l, chr(10) order by i) as t from part group by key, c having count(*) >= 2 and sum(words) >= {LEAST}
  union all
  select key, i, i, true, l from part where words >= {LONG}
  union all
  select key, before, i, false, l_before || chr(10) || l from part where before is not null),
gone as (select * from (select *, rank() over (partition by t order by key, first) as r from piece) where r > 1),
begun as (
  select *, first > coalesce(max(last) over (partition by key order by first, last rows between unbounded preceding and 1 preceding), 0) as begins from gone),
numbered as (select *, sum(case when begins then 1 else 0 end) over (partition by key order by first, last rows unbounded preceding) as run from begun),
runs as (select key, run, min(first) as first, max(last) as last, bool_or(sure) as sure from numbered group by key, run),
sized as (select r.key, r.first, r.last, r.sure, sum(h.words) as words from runs r join hashed h on h.key = r.key and h.i between r.first and r.last group by all),
lost as (select distinct key, unnest(range(first, last + 1)) as i from sized where sure or words >= {RUN}),
island as (select key, min(i) as first, max(i) as last from (select *, i - row_number() over (partition by key order by i) as g from lost) group by key, g),
spans as (select key, string_agg(first || '-' || last, ',' order by first) as removed, sum(last - first + 1)::bigint as n from island group by key),
kept as (select key, string_agg(l, chr(10) order by i) as t from line where key in (select key from spans) and (key, i) not in (select key, i from lost) group by key)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines, coalesce(s.n, 0)::bigint as n_removed, coalesce(s.removed, '') as removed,
  case when s.key is null then d.text else coalesce(k.t, '') end as text
from documents d left join doc x on x.id = coalesce(d.doc_id, {LAST}) and x.digest = md5(d.text) left join spans s on s.key = x.key left join kept k on k.key = x.key
"""
