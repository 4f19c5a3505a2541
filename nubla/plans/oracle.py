"""DuckDB SQL that computes what the note operators compute, from the same rules; it checks the registered queries.

Each step is a common table expression over rows of spans; ``chain(last)`` gives all that a step needs.
"""

from __future__ import annotations

from nubla.functions.dates import MONTHS
from nubla.functions.text import ACCENTED, PLAIN
from nubla.operators import rules as R
from nubla.operators import score as S
from nubla.operators import substitute as T
from nubla.operators.dictionaries import Dictionaries, plain

WORDS = Dictionaries()
RULES = R.rules(WORDS)
AS_OF = "date '2026-01-01'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def among(words) -> str:
    return "(" + ", ".join(q(w) for w in sorted(set(words))) + ")"


def rx(value: str, pattern: str, ignore_case: bool = True) -> str:
    return f"regexp_matches({value}, {q(pattern.replace('$', chr(92) + 'z'))}, {q('i' if ignore_case else 'c')})"


def trim(value: str) -> str:
    return f"regexp_replace({value}, '^\\s+|\\s+$', '', 'g')"


def norm(value: str) -> str:
    return f"lower(translate({value}, {q(ACCENTED)}, {q(PLAIN)}))"


def _number(values: str) -> str:
    return f"coalesce(list_position({values}, true), 0)"


def _clean(rule: R.Rule, t: str) -> str:
    """The SQL of a rule's check: the span's text, or an empty one."""
    cut = lambda tokens, stop: f"list_slice({tokens}, 1, case when {stop} > 0 then {stop} - 1 else len({tokens}) end)"
    if rule.check == "postal":
        return f"case when cast(right({t}, 5) as int) between 1000 and 52999 then {t} else '' end"
    if rule.check == "calendar":
        part = lambda i: f"cast(regexp_extract({t}, '^(\\d+)[/\\-](\\d+)', {i}) as int)"
        return f"case when {part(1)} between 1 and 31 and {part(2)} between 1 and 12 and not regexp_matches({t}, {q(R.SCALE)}) then {t} else '' end"
    if rule.check in ("hospital", "centre"):
        cuts = R.PLACE_CUTS if rule.check == "hospital" else [r"\s+(?:en|con|por|para)\s+.*\z"]
        out = t
        for pattern in cuts:
            out = trim(f"regexp_replace({out}, {q(pattern)}, '', 'gi')")
        fit = f"length({out}) >= 10 and not {rx(out, '[[:space:]]+(de|del|el|la)$')}" if rule.check == "hospital" else f"length({out}) >= 8"
        return f"case when {fit} then {out} else '' end"
    if rule.check == "professional":
        title = f"regexp_extract({t}, {q('^' + R.TITLES)}, 0, 'i')"
        tokens = f"regexp_split_to_array(substr({t}, length({title}) + 1), '\\s+')"
        kept = cut(tokens, _number(f"list_transform({tokens}, lambda w: lower(w) in {among(R.NOT_PROFESSIONAL)})"))
        known = among(plain(w) for w in [*WORDS.women, *WORDS.men, *WORDS.surnames])
        fit = f"len({kept}) >= 2 or len(list_filter({kept}, lambda w: {norm('w')} in {known})) > 0"
        return f"case when len({kept}) > 0 and ({fit}) then {title} || array_to_string({kept}, ' ') else '' end"
    if rule.check in ("patient", "labelled"):
        particle = f"lower(w) in {among(R.NAME_PARTICLES)}"
        name = f"(regexp_full_match(w, {q(R.NAME)}) and lower(w) not in {among(R.NOT_PATIENT + R.NOT_SURNAME)})"
        bare = f"list_filter(list_transform(regexp_split_to_array({trim(t)}, '\\s+'), lambda w: regexp_replace(w, '[^A-Za-zÁÉÍÓÚÑáéíóúñ]', '', 'g')), lambda w: w <> '' and not regexp_full_match(w, {q(R.CAPITAL)}))"
        stop = _number(f"list_transform({bare}, lambda w, i: not ({name} or ({particle} and i > 1)))")
        kept = cut(bare, stop)
        joined = f"regexp_replace(array_to_string(list_transform({kept}, lambda w: case when {particle} then lower(w) else w end), ' '), {q('( (' + '|'.join(R.NAME_PARTICLES) + '))+$')}, '')"
        out = f"case when len(list_filter({kept}, lambda w: not {particle})) >= 2 then {joined} else '' end"
        return f"case when lower(split_part({out}, ' ', 1)) in {among(R.NOT_PATIENT)} then '' else {out} end" if rule.check == "patient" else out
    if rule.check == "relative":
        return f"case when length({t}) >= 3 and lower({t}) not in {among(R.NOT_RELATIVE)} and regexp_matches({t}, '^{R.CAPITAL}') then {t} else '' end"
    if rule.check == "named_block":
        return f"case when regexp_matches(regexp_extract({t}, '\\(([^)]+)\\)', 1), {q(R.NAME)}) then {t} else '' end"
    return t


def rule_sql(rule: R.Rule, number: int) -> str:
    """Rows (note_id, rule, span_start, span_end, type, subtype, span_text, confidence) of one rule, without others' checks."""
    pattern = rule.lead + rule.body
    flag = q("i" if rule.ignore_case else "c")
    lead = f"length(regexp_extract(m[i], {q('^(?:' + rule.lead + ')')}, 0, {flag}))" if rule.lead else "0"
    body = f"regexp_replace(b, '\\s+$', '')" if rule.trim else "b"
    near = ""
    if rule.around:
        left, right, cue = rule.around
        near = f" and regexp_matches(substr(text, greatest(s - {left}, 0) + 1, least(s, {left})) || t || substr(text, s + length(t) + 1, {right}), {q(cue)}, 'i')"
    return f"""
select note_id, {number} as rule, s::int as span_start, (s + length(t))::int as span_end, {q(rule.type)} as type, {q(rule.subtype)} as subtype, t as span_text, {rule.confidence}e0 as confidence
from (select note_id, text, s, {_clean(rule, 'b')} as t
  from (select note_id, text, s0::bigint as s, {body} as b
    from (select note_id, text, l + coalesce(list_sum(list_transform(g[1:i], lambda v: length(v))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) as s0, substr(m[i], l + 1) as b
      from (select *, {lead} as l from (select note_id, text, regexp_extract_all(text, {q(pattern)}, 0, {flag}) as m, regexp_split_to_array(text, {q(pattern)}, {flag}) as g from notes), unnest(range(1, len(m) + 1)) as u(i)))))
where length(t) >= {max(1, rule.least)}{near}"""


def candidates(only: set[str] | None = None) -> str:
    """CTEs up to ``cand``: the spans of all rules, or of those named."""
    out, dates, relatives = [], [], []
    for i, r in enumerate(RULES):
        if only and r.name not in only:
            continue
        sql = rule_sql(r, i)
        if r.check == "uncontained" and dates:
            earlier = " union all ".join(f"select * from r{j}" for j in dates)
            sql = f"select * from ({sql}) c where not exists (select 1 from ({earlier}) e where e.note_id = c.note_id and e.span_start <= c.span_start and e.span_end >= c.span_end)"
        if r.check == "free" and relatives:
            earlier = " union all ".join(f"select * from r{j}" for j in relatives)
            sql = f"select * from ({sql}) c where not exists (select 1 from ({earlier}) e where e.note_id = c.note_id and e.span_start < c.span_end and c.span_start < e.span_end)"
        out.append(f"r{i} as ({sql})")
        dates += [i] * (r.type == "FECHA")
        relatives += [i] * (r.subtype == "familiar")
    numbers = [x.split(" ")[0] for x in out]
    return ",\n".join(out) + ",\ncand as (" + " union all ".join(f"select * from {n}" for n in numbers) + ")"


RESOLVED = """
ranked as (
  select *, row_number() over (partition by note_id order by case when type = 'UBICACION' then 3 when type = 'IDENTIFICADOR' or subtype = 'familiar' then 2 when type = 'SOSPECHOSO' or subtype = 'profesional' then 1 else 0 end desc,
    confidence desc, span_end - span_start desc, rule, span_start) as rk from cand),
packed(note_id, rk, ok, kept) as (
  select note_id, rk, true, [{'s': span_start, 'e': span_end}] from ranked where rk = 1
  union all
  select r.note_id, r.rk, len(list_filter(p.kept, lambda k: k.s < r.span_end and r.span_start < k.e)) = 0,
    case when len(list_filter(p.kept, lambda k: k.s < r.span_end and r.span_start < k.e)) = 0 then list_append(p.kept, {'s': r.span_start, 'e': r.span_end}) else p.kept end
  from packed p join ranked r on r.note_id = p.note_id and r.rk = p.rk + 1),
resolved as (select r.* from ranked r join packed p on p.note_id = r.note_id and p.rk = r.rk where p.ok)"""


def _part(condition: str, value: float) -> str:
    return f"case when {condition} then {value}e0 else 0e0 end"


def _sum(parts: list[str]) -> str:
    return "(" + " + ".join(parts) + ")"


def _clamp(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


def scored() -> str:
    given = among(plain(w) for w in [*WORDS.women, *WORDS.men])
    surnames = among(plain(w) for w in WORDS.surnames)
    first, surname = f"{norm('tokens[1]')} in {given}", f"len(list_filter(tokens[2:], lambda w: {norm('w')} in {surnames})) > 0"
    shape = f"len(tokens) between 2 and 4 and len(list_filter(tokens, lambda w: not regexp_full_match(w, {q(R.NAME)}))) = 0"
    professional, label = rx("ahead", S.PROFESSIONAL_CUE), rx("ahead", S.LABEL_CUE)
    patient = _sum([_part(first, 0.3), _part(surname, 0.25), _part(shape, 0.2), _part(professional, 0.3), _part(rx("ahead", S.PATIENT_CUE), 0.25), _part(label, 0.35), _part(f"lower(tokens[1]) in {among(S.COMMON_WORDS)}", -0.3), _part(f"len(tokens) = 1 and not {professional} and not {label}", -0.2)])
    expert = _sum(["0.3e0", _part(first, 0.3), _part(surname, 0.25), _part("len(tokens) >= 2", 0.15), _part(f"lower(tokens[1]) in {among(S.SPECIALTIES)}", -0.4)])
    weight = lambda cues: "case " + " ".join(f"when {rx('ahead', p)} then {w}e0" for p, w in cues) + " else 0e0 end"
    compound = lambda t: rx(t, S.COMPOUND)
    two_words = "array_to_string(tokens[1:2], ' ')"
    structure = f"case when len(tokens) = 3 then 0.15e0 when len(tokens) = 2 then 0.1e0 when len(tokens) = 1 then -0.1e0 when {compound(two_words)} then 0.2e0 else 0e0 end"
    next_word = "lower(regexp_extract(" + trim("behind") + ", '^\\S*', 0))"
    short = " or ".join(f"contains(span_text, {q(k)})" for k in S.SHORT_NAMES)
    moved = f"{weight(S.POSITIVE)} + {weight(S.NEGATIVE)} - {_part(f'{next_word} in {among(S.NEXT_WORDS)}', 0.3)} + {structure} + {_part(compound('span_text'), 0.15)} + {_part(short, 0.1)} - {_part(rx('ahead || span_text || behind', S.MEDICATION), 0.3)}"
    context = lambda left, right: f"substr(n.text, greatest(span_start - {left}, 0) + 1, least(span_start, {left})) as ahead, substr(n.text, span_end + 1, {right}) as behind"
    return f"""
scored as (
  select note_id, rule, span_start, span_end, type, subtype, span_text, case when type = 'NOMBRE' and subtype <> 'familiar' then score else confidence end as confidence,
    case when type = 'NOMBRE' and subtype <> 'familiar' then case when score >= {S.HIGH}e0 then 'ANONIMIZAR' when score >= {S.MEDIUM}e0 then 'ANONIMIZAR_CON_REVISION' when score >= {S.LOW}e0 then 'REVISION_MANUAL' else 'NO_ANONIMIZAR' end else 'ANONIMIZAR' end as recommendation
  from (select *, {_clamp(f"case when subtype = 'profesional' then {expert} else {patient} end")} as score
    from (select r.*, regexp_split_to_array(span_text, '\\s+') as tokens, {context(50, 30)} from resolved r join notes n using (note_id)))),
adjusted as (
  select note_id, rule, span_start, span_end, type, subtype, span_text, recommendation,
    case when type <> 'NOMBRE' then confidence when {rx('span_text', '|'.join(S.EPONYMS))} then 0e0 else {_clamp(f'confidence + ({moved})')} end as confidence
  from (select r.*, regexp_split_to_array(span_text, '\\s+') as tokens, {context(60, 40)} from scored r join notes n using (note_id)))"""


def kept(strict: bool) -> str:
    limit = f"case when type = 'SOSPECHOSO' then {S.STRICT_ODD}e0 else {S.STRICT}e0 end" if strict else f"{S.THRESHOLD}e0"
    return f"""
kept as (select * from adjusted where confidence >= {limit}),
discarded as (select * from adjusted where not confidence >= {limit})"""


def _make(year: str, month: str, day: str) -> str:
    return f"cast(make_date({year}, 1, 1) + to_months(cast({month} as int) - 1) as date) + (cast({day} as int) - 1)"


def note_day(t: str) -> str:
    words = r"^(\d{1,2})\s+de\s+(" + "|".join(MONTHS) + r")\s+(?:de\s+)?(\d{4})$"
    number = r"^(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})$"
    part = lambda p, i, f="c": f"try_cast(regexp_extract({t}, {q(p)}, {i}, '{f}') as int)"
    months = "[" + ", ".join(q(m) for m in MONTHS) + "]"
    year = f"case when length(regexp_extract({t}, {q(number)}, 3)) = 2 then case when {part(number, 3)} > 50 then 1900 + {part(number, 3)} else 2000 + {part(number, 3)} end else {part(number, 3)} end"
    month = f"list_position({months}, lower(regexp_extract({t}, {q(words)}, 2, 'i')))"
    return f"""case when regexp_matches({t}, '^\\d{{4}}$') then make_date(try_cast({t} as int), 1, 1)
    when {rx(t, words)} then {_make(part(words, 3, 'i'), month, part(words, 1, 'i'))}
    when regexp_matches({t}, {q(number)}) then {_make(year, part(number, 2), part(number, 1))} end"""


def relative(d: str) -> str:
    r = lambda n, u: f"cast(floor({n} / {u}e0 + 0.5e0) as int)"
    return f"""case when {d} = 0 then 'hoy' when {d} = 1 then 'hace 1 día' when {d} = -1 then 'mañana'
    when {d} > 0 and {d} < 7 then 'hace ' || {d} || ' días' when {d} > 0 and {d} < 30 then 'hace ' || {r(d, 7)} || ' semanas'
    when {d} > 0 and {d} < 365 then 'hace ' || {r(d, 30)} || ' meses' when {d} > 0 then 'hace ' || {r(d, 365)} || ' años'
    when {d} > -7 then 'en ' || -({d}) || ' días' when {d} > -30 then 'en ' || {r(f'-({d})', 7)} || ' semanas'
    when {d} > -365 then 'en ' || {r(f'-({d})', 30)} || ' meses' else 'en ' || {r(f'-({d})', 365)} || ' años' end"""


def since(d: str) -> str:
    r = lambda u: f"cast(floor({d} / {u}e0 + 0.5e0) as int)"
    many = lambda u, one, more: f"{r(u)} || case when {r(u)} > 1 then '{more}' else '{one}' end || ' después de'"
    return f"""case when {d} = 0 then 'mismo día que' when {d} = 1 then '1 día después de' when {d} < 7 then {d} || ' días después de'
    when {d} < 30 then {many(7, ' semana', ' semanas')} when {d} < 365 then {many(30, ' mes', ' meses')} else {many(365, ' año', ' años')} end"""


def professional_key(t: str) -> str:
    return trim(f"regexp_replace(regexp_replace({trim(f'lower({t})')}, {q(T.TITLE)}, '', 'i'), '\\s+', ' ', 'g')")


def relative_key(t: str) -> str:
    return "case " + " ".join(f"when contains(lower({t}), {q(r)}) then {q(r)}" for r in R.RELATIONS) + f" else {trim(f'lower({t})')} end"


def centre_key(t: str) -> str:
    out = trim(f"lower({t})")
    for old, new in ((r"\s+(período|periodo|médico|medico)\s*\z", ""), (r"^h\.\s*u\.\s*", "hospital universitario "), (r"^h\.\s*", "hospital "), (r"\s+de\s+día\s*", " "), (r"\s+", " ")):
        out = f"regexp_replace({out}, {q(old)}, {q(new)}, 'g')"
    out = trim(out)
    return f"case when regexp_matches({out}, {q(T.CENTRE_NAME)}) then {trim(f'regexp_extract({out}, {q(T.CENTRE_NAME)}, 1)')} else {out} end"


def gender(t: str) -> str:
    first = f"lower(split_part({t}, ' ', 1))"
    return f"case when {first} in {among(T.FEMININE_SHORT)} then 'F' when ends_with({first}, 'a') then case when {first} in {among(T.MASCULINE_IN_A)} then 'M' else 'F' end when {first} in {among(T.FEMININE)} then 'F' else 'M' end"


def _folded(name: str, source: str, key: str, same: str) -> str:
    """Numbers by a fold over a note's keys, from its end: the first earlier key that is the same, else the next number.

    same: a condition on ``a`` (the new key) and ``x.k`` (an earlier one).
    """
    found = f"coalesce((list_filter(p.known, lambda x: x.k = c.k))[1].n, (list_filter(p.known, lambda x: {same}))[1].n, coalesce(list_max(list_transform(p.known, lambda x: x.n)), 0) + 1)"
    return f"""
{name}_keys as (select note_id, k, row_number() over (partition by note_id order by span_start desc) as i from (select note_id, span_start, {key} as k from kept where {source})),
{name}_fold(note_id, i, k, n, known) as (
  select note_id, i, k, 1, [{{'k': k, 'n': 1}}] from {name}_keys where i = 1
  union all
  select c.note_id, c.i, c.k, {found}, list_append(p.known, {{'k': c.k, 'n': {found}}}) from {name}_fold p join {name}_keys c on c.note_id = p.note_id and c.i = p.i + 1),
{name} as (select note_id, k, min_by(n, i) as n from {name}_fold group by 1, 2)"""


def _same_professional() -> str:
    x, y = "string_split(c.k, ' ')", "string_split(x.k, ' ')"
    short, long = f"(case when len({x}) <= len({y}) then {x} else {y} end)", f"(case when len({x}) <= len({y}) then {y} else {x} end)"
    rest = lambda t: f"(case when len({t}) > 1 then {t}[2:] else {t} end)"
    common = f"len(list_filter({rest(long)}, lambda w: list_contains({rest(short)}, w)))"
    return f"c.k = x.k or ends_with(array_to_string({long}, ' '), array_to_string({short}, ' ')) or (len({short}) = 1 and list_contains({long}, {short}[1])) or ({common} = len({rest(short)}) and {common} > 0)"


def labelled(strict: bool) -> str:
    dated = "(type = 'FECHA' and (subtype in ('fecha_completa', 'ano') or regexp_matches(span_text, '^\\d{1,2}[/\\-]')))"
    distinct = lambda name, source, key: f"\n{name} as (select note_id, k, row_number() over (partition by note_id order by last desc) as n from (select note_id, {key} as k, max(span_start) as last from kept where {source} group by 1, 2))"
    centre = "'Centro Sanitario'" if strict else "'Centro ' || chr(64 + ce.n::int)"
    city = "'Zona Geografica'" if strict else "'Ciudad ' || chr(64 + ci.n::int)"
    odd = "'[dato_sensible]'" if strict else "case " + " ".join(f"when subtype = {q(k)} then {q(v)}" for k, v in T.ODD_LABELS.items()) + " else 'dato cuasi-identificador' end"
    return ",".join(
        [
            _folded("professionals", f"subtype = 'profesional' and length({professional_key('span_text')}) >= 3", professional_key("span_text"), _same_professional()),
            distinct("relatives", "subtype = 'familiar'", relative_key("span_text")),
            _folded("centres", "type = 'UBICACION' and subtype = 'hospital'", centre_key("span_text"), "contains(c.k, x.k) or contains(x.k, c.k)"),
            distinct("cities", "type = 'UBICACION' and subtype <> 'hospital'", trim("lower(span_text)")),
            f"""
days as (select note_id, k, day, min(span_start) as first from (select note_id, span_start, {trim('span_text')} as k, {note_day(trim('span_text'))} as day from kept where {dated}) where day is not null group by all),
numbered_days as (select *, row_number() over w as n, lag(day) over w as before from days window w as (partition by note_id order by day, first)),
visits as (select note_id, k, 'Visita ' || n || ' (' || case when n = 1 then {relative(f"date_diff('day', day, {AS_OF})")} else {since("date_diff('day', before, day)")} || ' Visita ' || (n - 1) end || ')' as label from numbered_days)""",
            f"""
labelled as (
  select s.*, case when type = 'IDENTIFICADOR' then ''
    when subtype = 'profesional' then case when length({professional_key('span_text')}) < 3 then '' else 'Profesional Sanitario ' || pr.n end
    when subtype = 'familiar' then 'Familiar ' || re.n
    when type = 'NOMBRE' then case when {gender('span_text')} = 'F' then 'Paciente Mujer' else 'Paciente Hombre' end
    when {dated} then coalesce(vi.label, span_text)
    when type = 'UBICACION' and subtype = 'hospital' then {centre}
    when type = 'UBICACION' then {city}
    when type = 'SOSPECHOSO' then {odd} else span_text end as transformed
  from kept s
  left join professionals pr on pr.note_id = s.note_id and subtype = 'profesional' and pr.k = {professional_key('span_text')}
  left join relatives re on re.note_id = s.note_id and subtype = 'familiar' and re.k = {relative_key('span_text')}
  left join centres ce on ce.note_id = s.note_id and subtype = 'hospital' and ce.k = {centre_key('span_text')}
  left join cities ci on ci.note_id = s.note_id and type = 'UBICACION' and ci.k = {trim('lower(span_text)')}
  left join visits vi on vi.note_id = s.note_id and type = 'FECHA' and vi.k = {trim('span_text')})""",
            """
pieces as (select note_id, span_start, span_end, transformed, coalesce(lag(span_end) over (partition by note_id order by span_start), 0) as from_ from labelled),
processed as (
  select n.note_id, coalesce(p.head, '') || substr(n.text, coalesce(p.last, 0) + 1) as processed, coalesce(p.n, 0) as n_entities
  from notes n left join (select note_id, string_agg(substr(text, from_ + 1, span_start - from_) || transformed, '' order by span_start) as head, max(span_end) as last, count(*) as n from pieces join notes using (note_id) group by 1) p using (note_id))""",
        ]
    )


def chain(notes: str, to: str, select: str, strict: bool = False, only: set[str] | None = None) -> str:
    """SQL of ``select`` over the CTEs up to ``to``: cand, resolved, scored, kept or labelled."""
    steps = {"cand": candidates(only), "resolved": RESOLVED, "scored": scored(), "kept": kept(strict), "labelled": labelled(strict)}
    parts = ",\n".join(list(steps.values())[: list(steps).index(to) + 1])
    for name in ("cand", "ranked", "resolved", "scored", "adjusted", "kept", "professionals", "centres", "days", "visits", "labelled", "pieces"):
        parts = parts.replace(f"\n{name} as (", f"\n{name} as materialized (")
    return f"with recursive notes as materialized ({notes}),\n{parts}\n{select}"
