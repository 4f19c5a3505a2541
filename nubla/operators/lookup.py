"""Dictionaries as tables: any number of names and places, joined with the notes' word sequences.

The entries stay a table (kind, entry), never collected: the words of a note, alone and in sequences as long as entries
have, meet them by an equi-join on the lower-cased words, and what a join finds is compared as it stands, marks between the
words and word edges included. Each note gets what concerns it in one column, ``KNOWN``, from which ``detect`` and ``score``
take it instead of an alternation or a list. So plans don't grow with the entries. An entry is found as whole words; one in
a plan's list also inside a longer word, where an accented letter is its neighbour and edges are ASCII ones.

The entries are broadcast up to ``BROADCAST_BYTES``, and meet the sequences by a shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nubla.functions.regex import let_sql, matches_sql, quoted, running_sql
from nubla.functions.text import ACCENTED, PLAIN, normalize

KNOWN = "_known"
TOKEN = r"[\p{L}\p{N}]+"
GIVEN = ("women", "men", "unisex")
PLACES = ("cities", "provinces", "regions")
KINDS = (*GIVEN, "surnames", *PLACES, "hospitals", "districts")
#: Words behind a given name that can belong to it: three names with two particles each, and one to see its edge.
AHEAD = 10
#: Runs at an entry's start by which ``split_hits`` joins, and behind them by which it leaves out what can't fit.
KEY, BEHIND = 3, 12
BROADCAST_BYTES = 48 << 20
WORD = {"ascii": "^[A-Za-z0-9_]$", "unicode": r"^[\p{L}\p{N}_]$"}
HIT = "struct<start:int,end:int,kind:string,word:string,match:string,ahead:string>"


def prepared(entries: DataFrame) -> DataFrame:
    """Rows (kind, key, size, lead, core, tail): an entry's words lower-cased, how many they are, and the entry from its first
    word to its last, with what stands before and after them.

    Places get a second entry without marks where that differs. A single word that is a given name or surname has a row more
    by which it is recognised whatever its case and accents: of kind ``=given`` or ``=surname``, its key begins with ``=``.
    Blank and null entries, and entries without a letter or digit, are left out; repeated ones count once.
    """
    own = entries.select(F.col("kind").cast("string").alias("kind"), F.trim(F.col("entry").cast("string")).alias("entry")).filter("entry <> ''").filter(F.col("kind").isin(*KINDS))
    bare = own.filter(F.col("kind").isin(*PLACES)).select(F.lit("unaccented").alias("kind"), normalize(F.col("entry")).alias("bare"), "entry").filter("bare <> lower(entry)")
    every = own.unionByName(bare.select("kind", F.col("bare").alias("entry"))).distinct().withColumn("found", F.expr(matches_sql("entry", TOKEN))).filter("size(found) > 0")
    first, last = "found[0].start", "found[size(found) - 1].`end`"
    whole = every.select(
        "kind",
        F.expr("lower(array_join(transform(found, t -> t.match), ' '))").alias("key"),
        F.expr("size(found)").alias("size"),
        F.expr(f"substring(entry, 1, {first})").alias("lead"),
        F.expr(f"substring(entry, {first} + 1, {last} - {first})").alias("core"),
        F.expr(f"substring(entry, {last} + 1, length(entry))").alias("tail"),
    )
    none = F.lit("")
    kind = F.when(F.col("kind") == "surnames", "=surname").when(F.col("kind").isin("women", "men"), "=given")
    words = every.filter("size(found) = 1 and found[0].match = entry").select(kind.alias("kind"), F.concat(F.lit("="), normalize(F.col("entry"))).alias("key"), F.lit(1).alias("size"), none.alias("lead"), none.alias("core"), none.alias("tail"))
    return whole.unionByName(words.filter("kind is not null").distinct())


def sequences(text: str, sizes: list[int], lead: int, tail: int) -> str:
    """SQL of the word sequences of the SQL ``text``, of each of ``sizes``: array<struct<key, start, end, raw, pre, post,
    ahead>>; pre and post: the ``lead`` + 1 characters before and the ``tail`` + 1 after it."""
    piece = lambda at, n: f"array_join(slice(pieces, {at}, {n}), '')"
    last = "(i + n - 1)"
    raw = piece("2 * i + 2", "2 * n - 1")
    pre = f"right(concat(if(i > 0, found[greatest(i - 1, 0)].match, ''), gaps[i]), {lead + 1})"
    post = f"left(concat(gaps[i + n], if(i + n < size(found), found[least(i + n, size(found) - 1)].match, '')), {tail + 1})"
    ahead = f"if(t.match rlike '^[A-ZÁÉÍÓÚÑ]', {piece('2 * (i + n) + 1', 2 * AHEAD)}, '')"
    one = f"named_struct('key', lower(array_join(transform(slice(found, i + 1, n), x -> x.match), ' ')), 'start', t.start, 'end', found[{last}].`end`, 'raw', {raw}, 'pre', {pre}, 'post', {post}, 'ahead', {ahead})"
    own = f"transform(filter(array({', '.join(map(str, sizes))}), n -> i + n <= size(found)), n -> {one})"
    word = f"named_struct('key', concat('=', lower(translate(w, {quoted(ACCENTED)}, {quoted(PLAIN)}))), 'start', -1, 'end', -1, 'raw', '', 'pre', '', 'post', '', 'ahead', '')"
    words = f"transform(array_distinct(transform(found, t -> t.match)), w -> {word})"
    every = f"concat(flatten(transform(found, (t, i) -> {own})), {words})"
    pieces = "flatten(transform(gaps, (g, i) -> if(i < size(found), array(g, found[least(i, size(found) - 1)].match), array(g))))"
    none = "from_json('[]', 'array<struct<key:string,start:int,end:int,raw:string,pre:string,post:string,ahead:string>>')"
    some = let_sql("gaps", f"split({text}, {quoted(TOKEN)}, -1)", let_sql("pieces", pieces, every))
    return let_sql("found", matches_sql(text, TOKEN), f"if(size(found) > 0, {some}, {none})")


def _fits(boundary: str) -> Column:
    """Whether a joined sequence is the entry as it stands, with a word edge at both ends."""
    folded = ~F.col("kind").isin(*GIVEN)
    same = lambda a, b: F.when(folded, F.lower(a) == F.lower(b)).otherwise(a == b)
    ahead, behind = F.length("lead"), F.length("tail")
    word = lambda c: F.coalesce(c, F.lit("")).rlike(WORD[boundary])
    before = F.when(F.length("pre") > ahead, F.substring(F.col("pre"), F.length("pre") - ahead, F.lit(1)))
    after = F.when(F.length("post") > behind, F.substring(F.col("post"), behind + 1, F.lit(1)))
    whole = F.concat("lead", "raw", "tail")
    # What follows a given name is another pattern's, which begins with white space.
    ends = ~folded | (word(after) != word(F.right(whole, F.lit(1))))
    edges = (word(before) != word(F.left(whole, F.lit(1)))) & ends
    text = same(F.col("raw"), F.col("core")) & same(F.right("pre", ahead), F.col("lead")) & same(F.left("post", behind), F.col("tail"))
    return F.col("kind").startswith("=") | (text & edges)


def hits(notes: DataFrame, entries: DataFrame, key: str, text: str = "text", boundary: str = "ascii") -> DataFrame:
    """Rows (``key``, start, end, kind, word, match, ahead): every place of every entry in ``text``, those inside of others
    included; and, with start -1, the words of a note that are names (``word``, without case and accents)."""
    known = prepared(entries)
    n, size, lead, tail, sizes = known.agg(F.count("*"), F.coalesce(F.sum(F.length("core") + F.length("key")), F.lit(0)), F.coalesce(F.max(F.length("lead")), F.lit(0)), F.coalesce(F.max(F.length("tail")), F.lit(0)), F.array_sort(F.collect_set("size"))).first()
    known = F.broadcast(known.drop("size")) if 200 * n + 4 * size <= BROADCAST_BYTES else known.drop("size")
    value = f"coalesce(`{text}`, '')"
    found = notes.select(F.col(f"`{key}`").alias(key), F.expr(f"inline({sequences(value, sizes or [1], lead, tail)})").alias("key_", "start", "end", "raw", "pre", "post", "ahead"))
    joined = found.join(known, F.col("key_") == F.col("key")).filter(_fits(boundary))
    begin, end = F.col("start") - F.length("lead"), F.col("end") + F.length("tail")
    word = F.when(F.col("kind").startswith("="), F.substring(F.col("key"), F.lit(2), F.length("key")))
    match = F.concat(F.right("pre", F.length("lead")), "raw", F.left("post", F.length("tail")))
    return joined.select(key, begin.alias("start"), end.alias("end"), "kind", F.coalesce(word, F.lit("")).alias("word"), match.alias("match"), F.when(F.col("kind").isin(*GIVEN), F.col("ahead")).otherwise("").alias("ahead"))


def lowered(text: str) -> str:
    """SQL of the SQL ``text`` in lower case, character by character, so that offsets stay."""
    return f"lower(translate({text}, 'İΣ', 'iσ'))"


def split_hits(notes: DataFrame, entries: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows (``key``, start, end, entry, match): where each of ``entries`` (a column ``entry``) stands in ``text`` whatever its
    case, by splitting the text at it, so that places of one entry don't overlap; with an edge of ASCII words at both ends.

    Such places are whole runs of ASCII word characters and of others: sequences of as many of these as entries begin with
    (``KEY`` at most) find each note's entries by an equi-join, and the note is split at those only.
    """
    pieces = lambda value: f"regexp_extract_all({value}, '[a-z0-9_]+|[^a-z0-9_]+', 0)"
    joined = lambda at, n: f"array_join(slice(pieces, {at}, {n}), '')"
    known = entries.select(F.expr(lowered("cast(entry as string)")).alias("entry")).filter("entry <> ''").distinct()
    known = known.withColumn("pieces", F.expr(pieces("entry"))).select("entry", F.expr("size(pieces)").alias("size"), F.expr(joined(1, KEY)).alias("key_"), F.expr(joined(KEY + 1, BEHIND)).alias("rest_"))
    n, size, sizes, longest = known.agg(F.count("*"), F.coalesce(F.sum(F.length("entry") + F.length("key_") + F.length("rest_")), F.lit(0)), F.array_sort(F.collect_set(F.least("size", F.lit(KEY)))), F.coalesce(F.max("size"), F.lit(0))).first()
    known = known.drop("size")
    known = F.broadcast(known) if 200 * n + 4 * size <= BROADCAST_BYTES else known
    value = lowered(f"`{text}`")
    # What is found by the first pieces is compared with those that follow; the split tells what is there.
    ahead = lambda n: joined(f"i + {n}", min(longest - KEY, BEHIND)) if n == KEY < longest else "''"
    some = [f"transform(sequence(1, greatest(size(pieces) - {n - 1}, 1)), i -> named_struct('key', {joined('i', n)}, 'ahead', {ahead(n)}))" for n in sizes or [1]]
    found = notes.filter(f"`{text}` <> ''").select(F.col(f"`{key}`").alias("note_"), F.expr(f"inline({let_sql('pieces', pieces(value), 'concat(' + ', '.join(some) + ')')})").alias("key_", "ahead_"))
    fits = F.col("ahead_").startswith(F.col("rest_")) | F.col("rest_").startswith(F.col("ahead_"))
    named = found.join(known, "key_").filter(fits).groupBy("note_").agg(F.collect_set("entry").alias("entries_"))
    own = notes.join(named, F.col(f"`{key}`").eqNullSafe(F.col("note_"))).select(F.col(f"`{key}`").alias("note_"), F.col(f"`{text}`").alias("text_"), F.expr(value).alias("low_"), "entries_")
    # As in ``matches_sql``, with the entry as pattern.
    pattern = r"concat('\\Q', replace(entry, '\\E', '\\E\\\\E\\Q'), '\\E')"
    at = "ends[i] + length(gaps[i])"
    before = "if(gaps[i] <> '', right(gaps[i], 1), if(i > 0, right(entry, 1), ''))"
    after = "if(get(gaps, i + 1) <> '', left(get(gaps, i + 1), 1), if(i + 2 < size(gaps), left(entry, 1), ''))"
    edge = lambda a, b: f"({a} rlike '[a-z0-9_]') <> ({b} rlike '[a-z0-9_]')"
    kept = f"filter(sequence(0, size(gaps) - 1), i -> i + 1 < size(gaps) and {edge(before, 'left(entry, 1)')} and {edge(after, 'right(entry, 1)')})"
    spans = f"transform({kept}, i -> named_struct('start', {at}, 'end', {at} + length(entry), 'entry', entry))"
    located = let_sql("sizes", "transform(gaps, g -> length(g) + length(entry))", let_sql("ends", running_sql("sizes"), spans))
    placed = own.select("note_", "text_", F.expr(f"inline(flatten(transform(entries_, entry -> {let_sql('gaps', f'split(low_, {pattern}, -1)', located)})))"))
    return placed.select(F.col("note_").alias(key), "start", "end", "entry", F.expr("substring(text_, start + 1, `end` - start)").alias("match"))


def looked_up(notes: DataFrame, entries: DataFrame, text: str = "text", boundary: str = "ascii") -> DataFrame:
    """``notes`` with ``KNOWN``: the hits of each note.

    Notes are told apart by their text, so equal ones have equal hits and no id is needed; a null text has none. Not for
    streams, as hits are grouped: use it in ``foreachBatch``.
    """
    digest = F.unhex(F.md5(F.col(f"`{text}`").cast("binary")))
    own = hits(notes.select(digest.alias("_digest"), F.col(f"`{text}`").alias("_text")).filter("_text is not null"), entries, "_digest", "_text", boundary)
    found = own.groupBy("_digest").agg(F.array_sort(F.collect_set(F.struct("start", "end", "kind", "word", "match", "ahead"))).alias(KNOWN))
    joined = notes.withColumn("_own", digest).join(found, F.col("_own") == F.col("_digest"), "left").drop("_own", "_digest")
    return joined.withColumn(KNOWN, F.coalesce(F.col(KNOWN), F.from_json(F.lit("[]"), f"array<{HIT}>")))


def leftmost_sql(spans: str) -> str:
    """SQL of the leftmost longest of the SQL array ``spans`` that don't overlap, as a regular expression finds them."""
    ordered = f"transform(array_sort(transform({spans}, s -> named_struct('start', s.start, 'size', -s.rank, 'span', s))), k -> k.span)"
    step = "if(s.start >= done.last, named_struct('kept', concat(done.kept, array(s)), 'last', s.`end`), done)"
    return let_sql("sorted", ordered, f"aggregate(sorted, named_struct('kept', filter(sorted, s -> false), 'last', 0), (done, s) -> {step}, done -> done.kept)")


def matches_of(kinds: tuple[str, ...], behind: str = "") -> str:
    """SQL of array<struct<start, end, rank, match>>: the notes' places of entries of some kinds, as ``matches_sql`` would
    give them; with ``behind``, a Java pattern, those that it follows, with what it matches."""
    own = f"filter({KNOWN}, k -> k.kind in ({', '.join(map(quoted, kinds))}))"
    if not behind:
        return leftmost_sql(f"transform({own}, k -> named_struct('start', k.start, 'end', k.`end`, 'rank', k.`end`, 'match', k.match))")
    more = f"regexp_extract(k.ahead, {quoted('^' + behind)}, 0)"
    longer = f"transform({own}, k -> {let_sql('more', more, "named_struct('start', k.start, 'end', k.`end` + length(more), 'rank', if(more = '', -1, k.`end`), 'match', concat(k.match, more))")})"
    return leftmost_sql(f"filter({longer}, s -> s.rank >= 0)")


def word_in(word: str, *kinds: str) -> str:
    """SQL: whether the SQL ``word``, without case and accents, is one of the note's names."""
    return f"exists({KNOWN}, k -> k.kind in ({', '.join(map(quoted, kinds))}) and k.word = {word})"
