"""Span detection: note text -> array<struct<start, end, type, subtype, text, confidence, rule>>.

The expressions are written as SQL: as columns they would take some 80,000 calls to the JVM, which is most of a small job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubla.functions.regex import among, clusters_sql, java, let_sql, matches_sql, quoted
from nubla.functions.text import ACCENTED, PLAIN
from nubla.operators import rules as R
from nubla.operators.dictionaries import Dictionaries, plain
from nubla.operators.lookup import KNOWN, looked_up, matches_of, word_in


def _trimmed(text: str) -> str:
    return f"regexp_replace({text}, {quoted(r'^\s+|\s+$')}, '')"


def _until(tokens: str, stops: str) -> str:
    """The tokens before the first one for which ``stops``, a SQL condition on ``w`` and ``i``, holds."""
    stop = f"array_position(transform({tokens}, (w, i) -> {stops}), true)"
    return let_sql("stop", f"int({stop})", f"if(stop > 0, slice({tokens}, 1, stop - 1), {tokens})")


def _clean_professional(text: str, words: Dictionaries) -> str:
    """Title and name up to the first word that isn't one; empty unless a word is a known name, or there are two."""
    bare = f"lower(translate(w, {quoted(ACCENTED)}, {quoted(PLAIN)}))"
    known = word_in(bare, "=given", "=surname") if words.table else f"{bare} in {among(plain(w) for w in [*words.women, *words.men, *words.surnames])}"
    fit = f"size(kept) >= 2 or exists(kept, w -> {known})"
    done = f"if(size(kept) > 0 and ({fit}), concat(title, array_join(kept, ' ')), '')"
    named = let_sql("tokens", f"split(substring({text}, length(title) + 1, length({text})), {quoted(r'\s+')})", let_sql("kept", _until("tokens", f"lower(w) in {among(R.NOT_PROFESSIONAL)}"), done))
    return let_sql("title", f"regexp_extract({text}, {quoted('^' + java(R.TITLES, True))}, 0)", named)


def _clean_patient(text: str) -> str:
    """A name of two words at least: particles in lower case, initials left out, cut at the first word that isn't a name."""
    particle = f"lower(w) in {among(R.NAME_PARTICLES)}"
    name = f"(w rlike {quoted(f'^{R.NAME}$')} and lower(w) not in {among(R.NOT_PATIENT + R.NOT_SURNAME)})"
    bare = f"transform(split({_trimmed(text)}, {quoted(r'\s+')}), w -> regexp_replace(w, '[^A-Za-zÁÉÍÓÚÑáéíóúñ]', ''))"
    bare = f"filter({bare}, w -> w <> '' and not w rlike {quoted(f'^{R.CAPITAL}$')})"
    joined = f"array_join(transform(kept, w -> if({particle}, lower(w), w)), ' ')"
    joined = f"regexp_replace({joined}, {quoted('( (' + '|'.join(R.NAME_PARTICLES) + '))+$')}, '')"
    done = f"if(size(filter(kept, w -> not {particle})) >= 2, {joined}, '')"
    return let_sql("tokens", bare, let_sql("kept", _until("tokens", f"not ({name} or ({particle} and i > 0))"), done))


def _clean(rule: R.Rule, text: str, words: Dictionaries) -> str:
    """SQL of the span's text after what its rule checks; empty if it doesn't hold. text: a name."""
    if rule.check == "postal":
        return f"if(int(substring({text}, -5, 5)) between 1000 and 52999, {text}, '')"
    if rule.check == "calendar":
        number = lambda i: f"int(regexp_extract({text}, {quoted(r'^(\d+)[/\-](\d+)')}, {i}))"
        return f"if({number(1)} between 1 and 31 and {number(2)} between 1 and 12 and not {text} rlike {quoted(R.SCALE)}, {text}, '')"
    if rule.check in ("hospital", "centre"):
        out, least, ends = text, 8, "true"
        for pattern in R.PLACE_CUTS if rule.check == "hospital" else [r"\s+(?:en|con|por|para)\s+.*\z"]:
            out = _trimmed(f"regexp_replace({out}, {quoted('(?iu)' + pattern)}, '')")
        if rule.check == "hospital":
            least, ends = 10, f"not cut rlike {quoted(r'(?iu)\s+(de|del|el|la)\z')}"
        return let_sql("cut", out, f"if(length(cut) >= {least} and {ends}, cut, '')")
    if rule.check == "professional":
        return _clean_professional(text, words)
    if rule.check == "patient":
        return let_sql("name", _clean_patient(text), f"if(lower(regexp_extract(name, {quoted(r'^\S*')}, 0)) in {among(R.NOT_PATIENT)}, '', name)")
    if rule.check == "labelled":
        return _clean_patient(text)
    if rule.check == "relative":
        return f"if(length({text}) >= 3 and lower({text}) not in {among(R.NOT_RELATIVE)} and {text} rlike {quoted(f'^{R.CAPITAL}')}, {text}, '')"
    if rule.check == "named_block":
        return f"if(regexp_extract({text}, {quoted(r'\(([^)]+)\)')}, 1) rlike {quoted(R.NAME)}, {text}, '')"
    return text


def find(text: str, rule: R.Rule, number: int = 0, words: Dictionaries | None = None, boundary: str = "ascii") -> str:
    """SQL of the spans of one rule in the SQL ``text``, without the checks against other rules' spans."""
    lead = java(f"^(?:{rule.lead})", rule.ignore_case, boundary) if rule.lead else ""
    body = "substring(m.match, lead + 1, length(m.match))"
    body = f"regexp_replace({body}, {quoted(r'\s+$')}, '')" if rule.trim else body
    start = "m.start + lead"
    span = f"named_struct('start', {start}, 'end', {start} + length(t), 'type', {quoted(rule.type)}, 'subtype', {quoted(rule.subtype)}, 'text', t, 'confidence', {rule.confidence}D, 'rule', {number})"
    cleaned = let_sql("b", body, let_sql("t", _clean(rule, "b", words or Dictionaries()), span))
    size = f"length(regexp_extract(m.match, {quoted(lead)}, 0))" if lead else "0"
    if words and words.table and rule.kinds:
        matches = matches_of(rule.kinds, java(rule.behind, rule.ignore_case, boundary) if rule.behind else "")
    else:
        matches = matches_sql(text, java(rule.lead + rule.body, rule.ignore_case, boundary))
    found = f"transform({matches}, m -> {let_sql('lead', size, cleaned)})"
    found = f"filter({found}, s -> length(s.text) >= {max(1, rule.least)})"
    if rule.around:
        left, right, cue = rule.around
        ahead = f"substring({text}, greatest(s.start - {left}, 0) + 1, least(s.start, {left}))"
        around = f"concat({ahead}, s.text, substring({text}, s.`end` + 1, {right}))"
        found = f"filter({found}, s -> {around} rlike {quoted('(?iu)' + cue)})"
    return found


def detect(notes: DataFrame, words: Dictionaries | None = None, text: str = "text", boundary: str = "ascii", only: set[str] | None = None) -> DataFrame:
    """``notes`` with ``candidates``: the spans of all rules (or those named), overlaps included, by start.

    Partial dates and years don't repeat what an earlier date holds, and a name with an age nothing that an earlier
    relative touches. A null text has no candidates. With dictionaries in a table, ``notes`` get their hits first, unless
    they have them.
    """
    words = words or Dictionaries()
    if words.table and KNOWN not in notes.columns:
        return detect(looked_up(notes, words.table, text, boundary), words, text, boundary, only).drop(KNOWN)
    every = [(i, r, f"_{r.name}") for i, r in enumerate(R.rules(words)) if not only or r.name in only]
    value = f"coalesce(`{text}`, '')"
    out = notes.withColumns({name: F.expr(find(value, r, i, words, boundary)) for i, r, name in every})
    names = [name for _, _, name in every]
    out = out.withColumn("candidates", F.expr(f"concat({', '.join(names)})")).drop(*names)
    # What an earlier span bars: the rules that look at others, and which ones these are.
    clash = {"uncontained": ("FECHA", "o.start <= s.start and o.`end` >= s.`end`"), "free": ("familiar", "o.start < s.`end` and s.start < o.`end`")}
    tests = []
    for check, (kind, test) in clash.items():
        own, others = ([str(i) for i, r, _ in every if fits(r)] for fits in (lambda r: r.check == check, lambda r: kind in (r.type, r.subtype)))  # noqa: B023
        if own:
            tests.append(f"not (s.rule in ({', '.join(own)}) and exists(group, o -> o.rule in ({', '.join(others)}) and o.rule < s.rule and {test}))")
    if tests:
        out = out.withColumn("candidates", F.expr(f"flatten(transform({clusters_sql('candidates')}, group -> filter(group, s -> {' and '.join(tests)})))"))
    return out
