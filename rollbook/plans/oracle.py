"""The registered queries in DuckDB's SQL, with rules and weights of its own; patterns and word lists, which are fixed values, come from the functions, so a wrong one shows in the tests' cases and not here."""

from __future__ import annotations

from rollbook.functions import confidence as K
from rollbook.functions import mapping as M
from rollbook.functions import support as H
from rollbook.functions import text as X
from rollbook.functions import validation as V
from rollbook.schema import COUNT_FIELDS, CRITICAL, FIELDS, IMPORTANT, TEXT_FIELDS, field_class
from rollbook.sources.fixtures import LINES_SQL, LOG_SQL, RECORDS_SQL

# Fixed values, written out here again: what the scores' fields weigh, and a postcode.
WEIGHTS = {
    "council": 3.0, "reference": 3.0, "hmo_address": 3.0, "licence_start": 2.0, "licence_expiry": 2.0, "max_occupancy": 2.0, "hmo_manager_name": 1.0, "hmo_manager_address": 1.0, "licence_holder_name": 1.0,
    "licence_holder_address": 1.0, "number_of_households": 1.0, "number_of_shared_kitchens": 1.0, "number_of_shared_bathrooms": 1.0, "number_of_shared_toilets": 1.0, "number_of_storeys": 1.0,
}
VALIDATOR_WEIGHTS = WEIGHTS | {"hmo_manager_name": 1.5, "hmo_manager_address": 1.5, "licence_holder_name": 1.5, "licence_holder_address": 1.5}
_POSTCODE = r"[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}"
NUMBERS = ("max_occupancy", *COUNT_FIELDS, "number_of_storeys")
REC = f"with rec as ({RECORDS_SQL})"


_LETTER = "A-Za-zÀ-ÖØ-öø-ʯͰ-῿぀-퟿"
_TOKEN = rf"[{_LETTER}]+(?:[''’-][{_LETTER}]+)*|[0-9]+(?:[/.,:-][0-9]+)*|[^ \t\n\x0b\f\r{_LETTER}0-9]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def blank(x: str) -> str:
    return f"({x} is null or {strip(x)} = '')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def case(*pairs: tuple[str, object], other: object = "null") -> str:
    return "case " + " ".join(f"when {a} then {b}" for a, b in pairs) + f" else {other} end"


def listed(xs: list[str]) -> str:
    return f"list_filter([{', '.join(f'cast({x} as varchar)' for x in xs)}], lambda x: x is not null)"


def score(f: str) -> str:
    s, low = strip(f), f"lower({strip(f)})"
    if f == "council":
        return case((blank(f), 0.0), (f"length({s}) < 3", 0.3), (has(low, "council|borough|city|district|county"), 0.9), other=0.7)
    if f == "reference":
        return case((blank(f), 0.0), (has(f"upper({s})", r"^[A-Z]{2,5}\d+$"), 0.95), (has(s, r"^\d{2,4}[/-]\w+[/-]?\d*$"), 0.9), (has(s, r"^\d{3,}$"), 0.8), (has(f"upper({s})", r"^[A-Z0-9/-]{3,}$"), 0.6), other=0.4)
    if "address" in f:
        parts = f"0.5::double + {case((has(f'upper({s})', _POSTCODE), '0.3::double'), other='0')} + {case((has(low, 'street|road|avenue|lane|drive|close|way|place'), '0.15::double'), other='0')} + {case((has(s, r'^\d'), '0.05::double'), other='0')}"
        return case((blank(f), 0.0), (f"length({s}) < 10", 0.3), other=f"least({parts}, 1.0)")
    if f.startswith("licence_") and "name" not in f:
        shapes = r"^\d{2}/\d{2}/\d{4}$|^\d{2}-\d{2}-\d{4}$|^\d{1,2}/\d{1,2}/\d{4}$"
        return case((blank(f), 0.0), (has(s, r"^\d{4}-\d{2}-\d{2}$"), 0.95), (has(s, shapes), 0.8), (has(s, r"\d{4}"), 0.4), other=0.1)
    if "name" in f:
        plain = has(s, r"^[A-Za-z\s\-'.]+$")
        return case((blank(f), 0.0), (f"length({s}) < 2", 0.2), (f"{plain} and {has(s, chr(92) + 's')}", 0.9), (plain, 0.7), (has(s, "[A-Za-z]"), 0.5), other=0.2)
    if f == "max_occupancy":
        return case((f"{f} < 0", 0.0), (f"{f} = 0", 0.2), (f"{f} <= 50", 0.9), other=0.6)
    if f == "number_of_storeys":
        return case((f"{f} < 0", 0.0), (f"{f} = 0", 0.2), (f"{f} <= 10", 0.9), other=0.5)
    return case((f"{f} < 0", 0.0), (f"{f} = 0", 0.6), (f"{f} <= 20", 0.9), other=0.6)


ERRORS = listed(
    [case((blank("council"), q("Council field is empty")), (f"length({strip('council')}) < 3", q("Council name too short"))), case((blank("reference"), q("Reference field is empty")))]
    + [case((f"{f} < 0", q(f"{f} cannot be negative")), *([(f"{f} = 0", q(f"{f} should not be zero"))] if f in ("max_occupancy", "number_of_storeys") else [])) for f in NUMBERS]
)
OVERALL = "(" + " + ".join(f"cast(s_{f} as double) * {WEIGHTS[f]}" for f in FIELDS) + f") / {sum(WEIGHTS.values())}"
SCORED = f"{REC}, sc0 as (select *, {', '.join(f'cast({score(f)} as double) as s_{f}' for f in FIELDS)}, {ERRORS} as errors from rec), sc1 as (select *, {OVERALL} as overall from sc0), sc as (select *, overall < 0.7 or len(errors) > 0 as flagged from sc1)"


_SCORED_TAIL = SCORED.removeprefix(f"{REC}, ")


def parsed(f: str) -> str:
    s = strip(f)

    def by(p: str, y: int, m: int, d: int, short: bool = False) -> str:
        g = lambda i: f"regexp_extract({s}, {q(p)}, {i})"
        year = f"(case when try_cast({g(y)} as int) < 69 then '20' else '19' end || {g(y)})" if short else g(y)
        return f"case when {has(s, p)} then try_cast({year} || '-' || lpad({g(m)}, 2, '0') || '-' || lpad({g(d)}, 2, '0') as date) end"

    return "coalesce(" + ", ".join([
        by(r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 1, 2, 3), by(r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 2, 1), by(r"^(\d{1,2})-(\d{1,2})-(\d{4})$", 3, 2, 1),
        by(r"^(\d{1,2})/(\d{1,2})/(\d{2})$", 3, 2, 1, True), by(r"^(\d{1,2})-(\d{1,2})-(\d{2})$", 3, 2, 1, True), by(r"^(\d{4})/(\d{1,2})/(\d{1,2})$", 1, 2, 3), by(r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 1, 2),
    ]) + ")"


def rule(f: str) -> tuple[str, list[str], list[str], str | None]:
    """score, errors, warnings, suggestion"""
    s, low = strip(f), f"lower({strip(f)})"
    if f == "council":
        usual, short = has(low, "|".join(V.COUNCIL_WORDS)), f"length({s}) < 3"
        return (
            case((blank(f), 0.0), (short, 0.2), (usual, 0.95), (f"length({s}) >= 5", 0.7), other=0.5),
            [case((blank(f), q("Council field is required")), (short, q("Council name is too short")))],
            [case((f"{blank(f)} or {short} or {usual}", "null"), (f"length({s}) >= 5", q("Council name doesn't match typical patterns")), other=q("Council name may be incomplete"))],
            None,
        )
    if f == "reference":
        known = has(f"upper({s})", "|".join(V.REFERENCES))
        return (case((blank(f), 0.0), (known, 0.9), other=0.3), [case((blank(f), q("License reference is required")), (f"not {known}", q("License reference format is invalid")))], [], f"not {blank(f)} and not {known}")
    if "address" in f:
        parts = f"0.5::double + {case((has(low, '|'.join(V.STREET_WORDS)), '0.15::double'), other='0')} + {case((has(s, r'^\d'), '0.05::double'), other='0')}"
        sc = case((blank(f), 0.0), (f"length({s}) < 10", 0.3), other=parts)
        rest = [(f"length({s}) < 10", q(f"{f} appears incomplete"))]
        missing = q(f"{f} missing valid UK postcode")
        if f == "hmo_address":
            return sc, [case((blank(f), q("HMO address is required")))], [case((blank(f), "null"), *rest, other=missing)], None
        return sc, [], [case((blank(f), q(f"{f} is empty")), *rest, other=missing)], None
    if f.startswith("licence_") and "name" not in f:
        d = parsed(f)
        far = f"{d} > date '2003-08-01'" if f == "licence_start" else f"{d} < date '1991-08-01'"
        text = "License start date is far in the future" if f == "licence_start" else "License expiry date is very old"
        iso = f"{has(s, r'^\d{4}-\d{1,2}-\d{1,2}$')} and {d} is not null"
        return (
            case((blank(f), 0.0), (f"{d} is null", 0.2), (far, 0.6 if f == "licence_start" else 0.5), (iso, 0.95), other=0.85),
            [case((blank(f), q(f"{f} is required")), (f"{d} is null", q(f"{f} has invalid date format")))],
            [case((f"not {blank(f)} and {far}", q(text)))],
            f"not {blank(f)} and {d} is null",
        )
    if "name" in f:
        plain, two = has(s, r"^[A-Za-z\s\-'.]+$"), has(s, r"\s")
        return (
            case((blank(f), 0.0), (f"length({s}) < 2", 0.2), (f"{plain} and {two}", 0.9), (plain, 0.7), (has(s, "[A-Za-z]"), 0.5), other=0.2),
            [],
            [case((blank(f), q(f"{f} is empty")), (f"length({s}) < 2", q(f"{f} is too short")), (f"{plain} and {two}", "null"), (plain, q(f"{f} may be incomplete (single name)")), (has(s, "[A-Za-z]"), q(f"{f} contains unusual characters")), other=q(f"{f} doesn't appear to be a valid name"))],
            None,
        )
    if f == "max_occupancy":
        return case((f"{f} <= 0", 0.0), (f"{f} > 100", 0.6), (f"{f} > 50", 0.7), other=0.9), [case((f"{f} <= 0", q("Maximum occupancy must be greater than 0")))], [case((f"{f} > 100", q("Maximum occupancy is unusually high")), (f"{f} > 50", q("Maximum occupancy is high for typical HMO")))], None
    if f == "number_of_storeys":
        return case((f"{f} <= 0", 0.0), (f"{f} > 20", 0.5), (f"{f} > 10", 0.7), other=0.9), [case((f"{f} <= 0", q("Number of storeys must be greater than 0")))], [case((f"{f} > 20", q("Number of storeys is unusually high for HMO")), (f"{f} > 10", q("Number of storeys is high for typical HMO")))], None
    return case((f"{f} < 0", 0.0), (f"{f} = 0", 0.6), (f"{f} > 50", 0.6), other=0.9), [case((f"{f} < 0", q(f"{f} cannot be negative")))], [case((f"{f} > 50", q(f"{f} is unusually high")))], None


_RULES = {f: rule(f) for f in FIELDS}
_YEARS = f"date_diff('day', {parsed('licence_start')}, {parsed('licence_expiry')}) / 365.25"
_V_ERRORS = listed([e for r in _RULES.values() for e in r[1]] + [case((f"{parsed('licence_expiry')} <= {parsed('licence_start')}", q("License expiry date must be after start date")))])
_V_WARNINGS = listed(
    [w for r in _RULES.values() for w in r[2]]
    + [
        case((f"{_YEARS} > 10", q("License duration is unusually long")), (f"{_YEARS} < 0.5", q("License duration is very short"))),
        case(("max_occupancy > 0 and number_of_shared_bathrooms > 0 and max_occupancy > 10 * number_of_shared_bathrooms", q("High occupancy to bathroom ratio"))),
        case(("max_occupancy > 0 and number_of_shared_kitchens > 0 and max_occupancy > 15 * number_of_shared_kitchens", q("High occupancy to kitchen ratio"))),
        case(("number_of_households > 0 and max_occupancy > 0 and number_of_households > max_occupancy", q("Number of households exceeds maximum occupancy"))),
    ]
)
_V_SCORE = "(" + " + ".join(f"cast({r[0]} as double) * {VALIDATOR_WEIGHTS[f]}" for f, r in _RULES.items()) + f") / {sum(VALIDATOR_WEIGHTS.values())}"
_V_SUGGEST = " + ".join(f"cast({r[3]} as int)" for r in _RULES.values() if r[3])
CHECKED = f"{SCORED}, ck0 as (select *, {_V_SCORE} as v_score, {_V_ERRORS} as v_errors, {_V_WARNINGS} as v_warnings, {_V_SUGGEST} as n_suggestions from sc), ck as (select *, len(list_filter(v_errors, lambda e: regexp_matches(lower(e), 'critical|required'))) = 0 as v_valid from ck0)"


def filled(f: str) -> str:
    return f"not {blank(f)}" if f in TEXT_FIELDS else f"{f} is not null and {f} <> 0"


def named(column: str, f: str) -> str:
    return f"len(list_filter({column}, lambda m: contains(lower(m), {q(f.replace('_', ' '))})))"


def long(source: str, extra: str = "") -> str:
    """A row for each record and field."""
    return " union all ".join(f"select {q(f)} as field, {filled(f)} as filled, s_{f} as score{extra.format(e=named('v_errors', f), w=named('v_warnings', f)) if extra else ''} from {source}" for f in FIELDS)


def level(a: str, r: str, e: str) -> str:
    def of(c: tuple, p: tuple) -> str:
        good, fair = f"{a} >= {c[1]} and {r} >= {p[1]}", f"{a} >= {c[2]} and {r} >= {p[2]}"
        return case((f"{e} > 0 and {good}", q("acceptable")), (f"{e} > 0 and {fair}", q("poor")), (f"{e} > 0", q("critical")), (f"{a} >= {c[0]} and {r} >= {p[0]}", q("excellent")), (good, q("good")), (fair, q("acceptable")), (f"{a} >= 0.5 and {r} >= 0.3", q("poor")), other=q("critical"))

    ins = lambda xs: "field in (" + ", ".join(map(q, xs)) + ")"
    return case((ins(CRITICAL), of((0.9, 0.8, 0.7), (0.95, 0.85, 0.70))), (ins(IMPORTANT), of((0.85, 0.75, 0.65), (0.90, 0.80, 0.65))), other=of((0.80, 0.70, 0.60), (0.85, 0.70, 0.50)))


_METRICS = f"m as (select field, count(*) as total, count(*) filter (filled) as populated, avg(score) as a, min(score) as lo, max(score) as hi, cast(sum(e) as bigint) as n_errors, cast(sum(w) as bigint) as n_warnings from ({long('ck', ', {e} as e, {w} as w')}) group by field), mm as (select *, {level('a', '(populated / total)', 'n_errors')} as level from m)"
_REASON = "array_to_string(" + listed(
    [case(("v_score < 0.7", "'Low overall confidence (' || printf('%.2f', v_score) || ')'")), case(("len(v_errors) > 0", "'Validation errors (' || len(v_errors) || ')'"))]
    + [case((f"s_{f} < 0.5", f"{q(f'Critical field ' + chr(39) + f + chr(39) + ' low confidence (')} || printf('%.2f', s_{f}) || ')'")) for f in CRITICAL]
    + [case((blank(f), q(f"Critical field '{f}' is empty"))) for f in CRITICAL]
) + ", '; ')"

# --- text -----------------------------------------------------------------------------------------------------------------
LINES = f"{REC}, li as ({LINES_SQL})"
DOCS = f"{LINES}, dd as (select doc, string_agg(line, chr(10) order by pos) as text from li group by doc)"


def every(x: str, *patterns: str) -> str:
    """All matches' first groups, pattern by pattern; a leading (?i) becomes the option."""
    parts = []
    for p in patterns:
        i = p.startswith("(?i)")
        parts.append(f"regexp_extract_all({x}, {q(p[4:] if i else p)}, 1{', ' + q('i') if i else ''})")
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


_BASIC = {
    "potential_references": f"list_sort(list_distinct({every('text', *X.BASIC_REFERENCES)}))", "potential_addresses": f"({every('text', X.BASIC_ADDRESS)})[1:10]",
    "potential_dates": f"list_sort(list_distinct({every('text', *X.BASIC_DATES)}))", "potential_numbers": every("text", *X.BASIC_NUMBERS),
}
_CAP = "lambda w: upper(w[1:1]) || lower(w[2:])"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def nice_name(x: str) -> str:
    return f"array_to_string(list_transform({words(x)}, lambda w: array_to_string(list_transform(string_split(w, chr(39)), lambda v: upper(v[1:1]) || lower(v[2:])), chr(39))), ' ')"


def nice_address(x: str) -> str:
    out = rf"regexp_replace({strip(x)}, '\s+', ' ', 'g')"
    for a, b in X.ABBREVIATIONS.items():
        out = rf"regexp_replace({out}, '\b{a}\b', '{b}', 'gi')"
    return f"array_to_string(list_transform({words(out)}, {_CAP}), ' ')"


def is_name(x: str) -> str:
    return rf"(len({words(x)}) >= 2 and len(list_filter({words(x)}, lambda w: not regexp_matches(w, '^\p{{Lu}}'))) = 0 and not regexp_matches({x}, '\d'))"


def iso(x: str, compat: bool) -> str:
    g = lambda p, i: f"lpad(regexp_extract({x}, {q(p)}, {i}), 2, '0')"
    a, b = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
    y = f"regexp_extract({x}, {q(a)}, 1)"
    first, second = f"try_cast({y} || '-' || {g(a, 2)} || '-' || {g(a, 3)} as date)", f"try_cast({y} || '-' || {g(a, 3)} || '-' || {g(a, 2)} as date)"
    y2 = f"regexp_extract({x}, {q(b)}, 3)"
    made = f"case when {has(x, a)} then coalesce({second if compat else first}, {first if compat else second}) when {has(x, b)} then coalesce(try_cast({y2} || '-' || {g(b, 2)} || '-' || {g(b, 1)} as date), try_cast({y2} || '-' || {g(b, 1)} || '-' || {g(b, 2)} as date)) end"
    return f"case when year({made}) between 1900 and 2100 then cast({made} as varchar) end"


def dates(x: str, compat: bool) -> str:
    return f"list_filter(list_transform({every(x, *X.DATES)}, lambda d: {iso('d', compat)}), lambda d: d is not null)"


_REFS = "list_transform(list_filter(list_transform({all}, lambda r: case when contains(r, ':') then {cut} else r end), lambda c: length(c) >= 4 and regexp_matches(c, '[A-Za-z0-9]') and not (regexp_matches(c, '^(\\p{{L}}+|\\d+)$') and length(c) < 6)), lambda c: upper(c))".format(all=every("text", *X.REFERENCES), cut=strip("regexp_replace(r, '^[^:]*:', '')"))
_KNOWN = f"list_filter({every('line', *X.NAMES)}, lambda n: {is_name('n')})"
_LIKELY = f"list_filter({every('line', X.CAPITALIZED)}, lambda n: not list_contains(known, n) and not regexp_matches(lower(n), {q('|'.join(X.NO_NAMES))}) and {is_name('n')})"


# --- audit ----------------------------------------------------------------------------------------------------------------
LOG = f"with log as ({LOG_SQL})"
_LEAD = "case action when 'flagged' then 'pending' when 'assigned' then 'in_review' when 'approved' then 'approved' when 'rejected' then 'rejected' end"
STATE = f"""{LOG}, st as (select record_id, max(session_id) as session_id,
  coalesce(arg_max({_LEAD}, (ts, event_id)) filter ({_LEAD} is not null), 'pending') as status,
  arg_max(reviewer, (ts, event_id)) filter (action = 'assigned') as reviewer, min(ts) as flagged_at,
  max(ts) filter (action = 'assigned') as started, max(ts) filter (action in ('approved', 'rejected')) as completed,
  count(*) filter (action = 'updated') as corrections, arg_max(confidence, (ts, event_id)) as confidence, count(*) as events, arg_min(reason, (ts, event_id)) as reason
  from log group by record_id)"""
SESSIONS = """s0 as (select o_orderkey % 7 as k, min(o_orderdate) as uploaded, max(o_orderdate) as latest, count(*) as n_records from orders group by 1),
ss as (select 'S' || k as session_id, uploaded, n_records, (['completed', 'processing', 'failed'])[k % 3 + 1] as status, case when k % 3 <> 1 then latest end as finished from s0)"""
_STATUSES = ("pending", "in_review", "approved", "rejected", "needs_revision")


def doubles(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in cols)


def _format(f: str, kind: str, default: str | None) -> str:
    s = strip(f"cast({f} as varchar)")
    if default is not None:
        s = f"case when {blank(f) if f in TEXT_FIELDS else f'coalesce({f}, 0) = 0'} then {q(default)} else {s} end"
    return s


def _mapping_error(m: M.Mapping) -> str:
    f, n = m.source, m.name
    tests = []
    for r, v in m.rules.items():
        if r == "min_length":
            tests.append((f"length({f}) < {v}", q(f"'{n}' must be at least {v} characters")))
        elif r == "date_format":
            tests.append((f"not {has(f, M.DATE_SHAPES[v])}", q(f"'{n}' must match date format {v}")))
        elif r == "min_value":
            tests.append((f"{f} < {v}", q(f"'{n}' must be at least {v}")))
        elif r == "max_value":
            tests.append((f"{f} > {v}", q(f"'{n}' must be no more than {v}")))
    empty = q(f"Required field '{n}' is empty") if m.required else "null"
    return case((blank(f"cast({f} as varchar)"), empty), *tests)


def _context(kind: str, context: str) -> float:
    if not context:
        return 0.5
    hits = sum(k in context.lower() for k in K.KEYWORDS.get(kind, ()))
    return (0.3, 0.7)[hits] if hits < 2 else 0.9


def _k_parts(f: str, context: str) -> dict[str, tuple[float, object]]:
    """Weight and value of each factor but consistency, which is 0."""
    kind, x = K.field_type(f), f"cast({f} as varchar)"
    n, none = f"length({strip(x)})", f"coalesce({x}, '') = ''"
    pats = [(has(x, p), s) for p, s in K.PATTERNS.get(kind, ())] + ([(has(x, r"^\d+$"), 0.8)] if kind == "numeric" else [])
    form = {
        "date": ([(has(x, r"^(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})$"), 0.9)], 0.3), "numeric": ([(has(x, r"^\d+$"), 0.9), (has(x, r"^\d+\.\d+$"), 0.8)], 0.2),
        "person": ([(has(x, r"^[A-Z][a-z]+\s+[A-Z][a-z]+"), 0.8)], 0.5), "address": ([(f"{has(x, chr(92) + 'd')} and length({x}) > 10", 0.8)], 0.5),
    }.get(kind, ([], 0.6))
    if kind in K.LENGTHS:
        (a, b, s), (c, d, t), other = K.LENGTHS[kind]
        size = ([(f"{n} between {a} and {b}", s), (f"{n} between {c} and {d}", t)], other)
    else:
        size = ([(f"{n} between 1 and 5", 0.9)], 0.5) if kind == "numeric" else ([(f"{n} < 2", 0.2), (f"{n} > 200", 0.3)], 0.7)
    return {"pattern": (0.25, case((none, 0.0), *pats, other=0.4)), "context": (0.20, _context(kind, context)), "format": (0.20, case((none, 0.0), *form[0], other=form[1])), "length": (0.10, case((none, 0.0), *size[0], other=size[1])), "method": (0.10, 0.9)}


def _k(f: str, context: str) -> str:
    return "least(greatest(" + " + ".join(f"cast({v} as double) * {w}" for w, v in _k_parts(f, context).values()) + ", 0.0), 1.0)"


_K_CONTEXT = {"council": "Council: ", "reference": "Licence reference no ", "hmo_address": "Property address: ", "licence_start": "Start date ", "hmo_manager_name": "HMO manager: ", "max_occupancy": ""}
_KIND = case((has("lower(line)", "council|authority|borough"), q("council")), (has("lower(line)", "hmo|reference|licence"), q("reference")), (has("lower(line)", "address|property"), q("hmo_address")), (has("lower(line)", "manager|holder"), q("hmo_manager_name")), (has("lower(line)", "occupancy|persons"), q("max_occupancy")))


def line_records(source: str) -> str:
    last = ", ".join(f"arg_max(line, pos) filter (kind = {q(k)}) as {k}" for k in ("council", "reference", "hmo_address", "hmo_manager_name", "max_occupancy"))
    return rf"""l0 as (select doc, pos, {strip('line')} as line from {source}), l1 as (select doc, pos, line, {_KIND} as kind from l0 where line <> ''),
l2 as (select *, sum(case when kind = 'council' then 1 else 0 end) over (partition by doc order by pos) as grp from l1 where kind is not null and (kind <> 'max_occupancy' or regexp_matches(line, '\d'))),
l3 as (select doc, grp, {last} from l2 group by doc, grp),
lr as (select doc, cast(row_number() over (partition by doc order by grp) - 1 as int) as i, council, reference, hmo_address, hmo_manager_name, try_cast(regexp_extract(max_occupancy, '(\d+)', 1) as int) as max_occupancy from l3)"""


_FOUND = {n: f"len({e})" for n, e in _BASIC.items()}


def _found(n: str, base: float, start: float) -> str:
    return f"round(case when {n} > 0 then least(0.9::double, {n} * 0.2::double + {start}::double) * {base}::double * least(1.0, l / 1000) else 0.0 end, 6)"


def _export_error(m: M.Mapping) -> str:
    """Of an export check: what counts as empty isn't checked further."""
    return f"case when not ({filled(m.source)}) then {q(f'Required field {chr(39)}{m.name}{chr(39)} is empty') if m.required else 'null'} else {_mapping_error(m)} end"


_EXPORT_ERRORS = "ee as (select * from (" + " union all ".join(f"select record_id, {i} as nth, {q(m.source)} as field, {_export_error(m)} as error from rec" for i, m in enumerate(M.preset("standard"))) + ") where error is not null)"
# Fixed values, written out here again: thresholds of a document's report, the rule set, user presets.
_THRESHOLDS = {
    "council": 0.75, "reference": 0.80, "hmo_address": 0.70, "licence_start": 0.85, "licence_expiry": 0.85, "max_occupancy": 0.80, "hmo_manager_name": 0.65, "hmo_manager_address": 0.70, "licence_holder_name": 0.65,
    "licence_holder_address": 0.70, "number_of_households": 0.80, "number_of_shared_kitchens": 0.80, "number_of_shared_bathrooms": 0.80, "number_of_shared_toilets": 0.80, "number_of_storeys": 0.80,
}
_RULER = (
    ("LICENSE_REF", r"(?:^|\s)([A-Z]{2,4}/\d{4,6})(?:\s|$)", "c"), ("LICENSE_REF", r"(?:^|\s)(\d{4,8})(?:\s|$)", "c"),
    ("COUNCIL", r"(?:^|\s)(east  lindsey  district  council|central  bedfordshire  council|dacorum  borough  council|fife  council)(?:\s|$)", "i"),
    ("HMO_TERM", r"(?:^|\s)(hmo  manager|hmo|house  in  multiple  occupation|licence  holder|maximum  occupancy|max  occupancy)(?:\s|$)", "i"),
    ("DATE_PATTERN", r"(?:^|\s)(\S*?(?:\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}|\d{4}-\d{1,2}-\d{1,2})\S*)", "c"),
    ("POSTCODE", r"(?:^|\s)([A-Z]{1,2}\d[A-Z\d]?\d[A-Z]{2})(?:\s|$)", "c"),
)
_RULER_SCORE = "case when label in ('LICENSE_REF', 'POSTCODE') then 0.9::double when label = 'DATE_PATTERN' then 0.85::double else 0.7::double end * case when length(regexp_replace(x, '  ', ' ', 'g')) < 3 then 0.8::double when length(regexp_replace(x, '  ', ' ', 'g')) > 50 then 0.9::double else 1.0::double end"
_FIVE = ("council", "reference", "hmo_address", "licence_start", "licence_expiry")
_UI = (("default", FIELDS, (0.8, 0.6, 0.4), _FIVE[:3]), ("minimal", _FIVE, (0.7, 0.5, 0.3), _FIVE[:3]), ("comprehensive", FIELDS, (0.9, 0.7, 0.5), _FIVE))


def _document(kind: str, base: float, start: float) -> str:
    quality = "least(1.0::double, l / 1000)"
    one = {n: f"case when {n} > 0 then least(0.9::double, {n} * 0.2::double + {start}::double) * {base}::double * {quality} else 0 end" for n in _FOUND}
    tables = "case when t > 0 then 0.95::double else 0 end" if kind == "docx" else f"case when t > 0 then least(0.95::double, acc * {base}::double) else 0 end"
    whole = f"({' + '.join(one.values())} + {tables} + {base}::double * {quality}{' + 0.98::double + 3 * 0.95::double' if kind == 'docx' else ''}) / {10 if kind == 'docx' else 6}"
    return f"round({one['potential_references']}, 6) as {kind}_potential_references, round({tables}, 6) as {kind}_tables, round({base}::double * {quality}, 6) as {kind}_full_text, round({whole}, 3) as {kind}_average"


def _pair(a: str, k: int) -> str:
    one = f"{a}[1]" if k == 1 else "null"
    return f"coalesce(case when len({a}) >= 2 then {a}[2 * i + {k}] when i = 0 then {one} end, '')"


def _distinct(xs: str) -> str:
    """In the order of their first places."""
    return f"list_filter(list_transform(range(1, len({xs}) + 1), lambda p: case when list_position({xs}, ({xs})[p]) = p then ({xs})[p] end), lambda x: x is not null)"


DEFAULT_REFERENCE, DEFAULT_NUMBER = "none", "1"
_NEEDS_OCR = rf"(text is null or length({strip('text')}) < 100 or length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) / length(text) < 0.1)"

SQL: dict[str, str] = {
    "c08_council_summary": f"{SCORED} select council, count(*) as n, round(avg(overall), 6) as mean_overall, count(*) filter (flagged) as n_flagged from sc group by council",
    "c01_record_scores": f"{SCORED} select record_id, {doubles(*[f's_{f}' for f in FIELDS], 'overall')}, array_to_string(errors, '|') as errors, flagged from sc",
    "c12_extraction_confidence": f"{REC}, k as (select record_id, {', '.join(f'{_k(f, c)} as k_{f}' for f, c in _K_CONTEXT.items())} from rec) select record_id, {doubles(*[f'k_{f}' for f in _K_CONTEXT])}, {', '.join(f'k_{f} < {K.THRESHOLDS[K.field_type(f)]} as low_{f}' for f in _K_CONTEXT)} from k",
    "c10_found_confidence": f"{DOCS}, f as (select doc, length(text) as l, {', '.join(f'{e} as {n}' for n, e in _FOUND.items())} from dd) select doc, {', '.join(f'{_found(n, 0.8, 0.3)} as {n}' for n in _FOUND)}, {_found('potential_dates', 0.9, 0.4)} as word_dates from f",
    "v12_validation": f"{CHECKED} select record_id, round(v_score, 6) as v_score, v_valid, array_to_string(v_errors, '|') as v_errors, array_to_string(v_warnings, '|') as v_warnings, n_suggestions from ck",
    "a01_field_metrics": f"{CHECKED}, {_METRICS} select field, total, populated, round(a, 6) as avg_confidence, lo as min_confidence, round(hi, 6) as max_confidence, n_errors, n_warnings, level from mm",
    "a04_session_quality": f"""{CHECKED}, s as (select session_id, count(*) as total, count(*) filter (v_valid) as valid, count(*) filter ({_REASON} <> '') as flagged, avg(v_score) as confidence from ck group by session_id)
select session_id, total, valid, flagged, round(confidence, 6) as confidence, {case(*[(f'confidence >= {c} and valid / total >= {v}', q(n)) for c, v, n in ((0.9, 0.95, 'excellent'), (0.8, 0.85, 'good'), (0.7, 0.7, 'acceptable'), (0.5, 0.5, 'poor'))], other=q('critical'))} as level from s""",
    "a05_flag_reasons": f"{CHECKED}, r as (select record_id, {_REASON} as reason from ck) select * from r where reason <> ''",
    "a06_field_statistics": f"{SCORED} select field, count(*) filter (filled) as populated, round(count(*) filter (filled) / count(*), 6) as rate, round(avg(score), 6) as avg_confidence, min(score) as min_confidence, round(max(score), 6) as max_confidence, round(coalesce(stddev_samp(score), 0), 6) as std_confidence from ({long('sc')}) group by field",
    "a06_distribution": f"""{SCORED}, o as (select overall as v, row_number() over (order by overall) - 1 as k, count(*) over () as n from sc),
p as (select max(v) filter (k = case when n < 4 then 0 else n // 4 end) as q1, max(v) filter (k = case when n < 4 then n - 1 else 3 * n // 4 end) as q3, median(v) as median from o)
select round(avg(overall), 6) as mean, round(coalesce(stddev_samp(overall), 0), 6) as std, round(min(overall), 6) as min, round(max(overall), 6) as max,
round(any_value(p.median), 6) as median, round(any_value(p.q1), 6) as q1, round(any_value(p.q3), 6) as q3 from sc, p""",
    "a07_quartiles": f"""{SCORED}, o as (select overall as v, row_number() over (order by overall) - 1 as k, count(*) over () as n from sc)
select max(n) as n, round(max(v) filter (k = case when n < 4 then 0 else n // 4 end), 6) as q1, round((max(v) filter (k = (n - 1) // 2) + max(v) filter (k = n // 2)) / 2, 6) as q2, round(max(v) filter (k = case when n < 4 then n - 1 else 3 * n // 4 end), 6) as q3 from o""",
    "a08_completeness": f"{REC}, w as (select {', '.join(f'avg(cast({filled(f)} as int)) as r_{f}' for f in FIELDS)} from rec) select {', '.join('round((' + ' + '.join(f'r_{f}' for f in FIELDS if field_class(f) == k) + f') / {sum(field_class(f) == k for f in FIELDS)}, 6) as {k}_avg' for k in ('critical', 'important', 'optional'))} from w",
    "a08_record_completeness": f"{REC}, x as (select ({' + '.join(f'cast({filled(f)} as int)' for f in FIELDS)}) / {len(FIELDS)} as x from rec) select round(avg(x), 6) as mean, round(min(x), 6) as min, round(max(x), 6) as max, round(coalesce(stddev_samp(x), 0), 6) as std from x",
    "a09_error_counts": f"{CHECKED} select message, count(*) as n from (select unnest(v_errors) as message from ck) group by message",
    "a09_warning_counts": f"{CHECKED} select message, count(*) as n from (select unnest(v_warnings) as message from ck) group by message",
    "a10_recommendations": f"""{CHECKED}, {_METRICS},
each as (select case when level in ('poor', 'critical') then 'Critical field ''' || field || ''' has ' || level || ' quality. Consider improving extraction methods or manual review.' else 'Critical field ''' || field || ''' is only populated in ' || printf('%.1f%%', 100.0 * populated / total) || ' of records. Review document parsing for this field.' end as advice
  from mm where field in ('council', 'reference', 'hmo_address') and (level in ('poor', 'critical') or populated / total < 0.8)),
top as (select message, count(*) as n from (select unnest(v_errors) as message from ck) group by message order by n desc, message limit 1),
low as (select count(*) filter (a < 0.6) as k, avg(populated / total) filter (field in ('council', 'reference', 'hmo_address')) as c from mm)
select advice from each union all select 'Most common error: ''' || message || ''' (' || n || ' occurrences). Focus on resolving this issue first.' from top
union all select 'Low completeness in critical fields. Consider improving document preprocessing or using alternative extraction methods.' from low where c < 0.7
union all select k || ' fields have low confidence scores. Consider retraining extraction models or improving validation rules.' from low where k > 5""",
    "a12_top_messages": f"""{CHECKED}, e as (select 'error' as kind, message, count(*) as n from (select unnest(v_errors) as message from ck) group by message order by n desc, message limit 5),
w as (select 'warning' as kind, message, count(*) as n from (select unnest(v_warnings) as message from ck) group by message order by n desc, message limit 5) select * from e union all select * from w""",
    "a12_validation_summary": f"{CHECKED} select count(*) as total, count(*) filter (v_valid) as valid, count(*) filter (not v_valid) as invalid, round(count(*) filter (v_valid) / count(*), 6) as rate, round(avg(v_score), 6) as confidence from ck",
    "a13_session_metrics": f"{SCORED}, {SESSIONS}, sm as (select session_id, count(*) as total, count(*) filter (overall >= 0.7) as confident, count(*) filter (flagged) as flagged, round(avg(overall), 6) as average, {', '.join(f'round(100.0 * count(*) filter ({filled(f)}) / count(*), 6) as pct_{f}' for f in FIELDS)} from sc group by session_id) select sm.*, coalesce((epoch_us(finished) - epoch_us(uploaded)) / 1000000, 0) as processing_seconds from sm left join ss using (session_id)",
    "a14_export_checks": f"{REC} " + " union all ".join(f"select {q(m.source)} as field, count(*) as n, count(*) filter (not ({filled(m.source)})) as n_empty, count(*) filter ({_export_error(m)} is not null) as n_errors from rec" for m in M.preset("standard")),
    "a14_export_summary": f"{REC}, e as (select {' + '.join(f'cast({_export_error(m)} is not null as int)' for m in M.preset('standard'))} as k from rec) select count(*) as total, count(*) filter (k = 0) as valid, count(*) filter (k > 0) as invalid, cast(sum(k) as bigint) as errors from e",
    "a14_record_errors": f"{REC}, {_EXPORT_ERRORS} select record_id, field, error from ee",
    "a16_ensemble": f"""{SCORED}, r as (select record_id, council as value, s_council as c from sc union all select record_id, upper(council), 0.6::double from sc union all select record_id, council, 0.5::double from sc),
g as (select record_id, count(*) as n, count(distinct value) as d, sum(c) as t, sum(c * c) as s, max((c, value)) as best from r group by record_id)
select record_id, best[2] as value, round(least(s / t + case when d = 1 then 0.1 when d * 2 <= n then 0.05 else -0.05 end, 1.0), 6) as confidence, n from g""",
    "a17_confidence_report": f"{SCORED} select field, round(avg(score), 6) as avg_confidence, min(score) as min_confidence, round(max(score), 6) as max_confidence, round(coalesce(stddev_samp(score), 0), 6) as std_confidence, case when avg(score) < 0.7 then 'Overall confidence is low. Consider using additional extraction methods.' end as advice from ({long('sc')}) group by field",
    "a18_session_audit": f"{STATE} select session_id, count(*) as total, {', '.join(f'count(*) filter (status = {q(s)}) as n_{s}' for s in _STATUSES)}, round(avg((epoch_us(completed) - epoch_us(started)) / 3600000000), 6) as review_hours, cast(sum(corrections) as bigint) as corrections, round(count(*) filter (status = 'approved') / count(*), 6) as completion from st group by session_id",
    "a19_audit_statistics": f"{STATE} select status, count(*) as n from st group by status",
    "a20_reviewers": f"{STATE} select reviewer, count(*) as assigned, count(*) filter (status in ('approved', 'rejected')) as completed, count(*) filter (status = 'approved') as approved, count(*) filter (status = 'rejected') as rejected from st where reviewer is not null group by reviewer",
    "a20_corrected_fields": f"{REC} select * from (" + " union all ".join(f"select {q(f)} as field, count(*) filter ({f} <> upper({f})) as n from rec" for f in ("council", "reference", "licence_holder_name")) + ") where n > 0",
    "a22_status_histogram": f"{STATE} select s as status, count(st.record_id) as n from (select unnest([{', '.join(map(q, _STATUSES))}]) as s) left join st on st.status = s group by s",
    "a24_performance": """with op as (select event_type as operation, value / 10 as seconds, user_id % 300 + 20.5::double as mb, event_id % 13 <> 0 as good from events),
ops as (select * from op union all select 'all', seconds, mb, good from op)
select operation, count(*) as total, round(count(*) filter (good) / count(*), 6) as success_rate, round(avg(seconds), 6) as mean_seconds, round(min(seconds), 6) as min_seconds, round(max(seconds), 6) as max_seconds,
round(avg(mb), 6) as mean_mb, round(max(mb), 6) as max_mb from ops group by operation""",
    "a24_last_operations": "select event_id as operation_id, event_type as operation, ts as began, round(value / 10, 6) as seconds, user_id % 300 + 20.5::double as memory_mb, event_id % 13 <> 0 as success from events order by ts desc, event_id desc limit 10",
    "a26_buckets": f"{SCORED}, b as (select case when m >= 0.8 then 'high' when m >= 0.6 then 'medium' else 'low' end as bucket from (select ({' + '.join(f's_{f}' for f in FIELDS)}) / {len(FIELDS)} as m from sc)) select bucket, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from b group by bucket",
    "a27_field_quality": f"{SCORED} select field, round(avg(score), 6) as mean, round(min(score), 6) as least, round(max(score), 6) as most, count(*) as n from ({long('sc')}) group by field",
    "a28_data_statistics": f"{REC} " + " union all ".join(f"select {q(f)} as field, round(count(*) filter (cast({f} as varchar) <> '') / count(*), 6) as completion, count(distinct {f}) as n_unique from rec" for f in FIELDS),
    "a30_editor_status": f"{SCORED} select case when overall >= 0.8 then 'excellent' when overall >= 0.6 then 'good' when overall >= 0.4 then 'warning' else 'error' end as status, count(*) as n from sc group by 1",
    "a31_processing_stats": f"""with f as (select doc_id, text, coalesce(length(text), 0) as l, {', '.join(f'coalesce({e}, 0) as {n}' for n, e in _FOUND.items())} from documents),
g as (select *, {', '.join(f'case when {n} > 0 then least(0.9::double, {n} * 0.2::double + 0.3::double) * 0.8::double * least(1.0, l / 1000) else 0 end as s_{n}' for n in _FOUND)}, 0.8::double * least(1.0, l / 1000) as s_full_text from f),
h as (select *, list_filter([{', '.join(f"case when round(s_{n}, 9) < 0.7 then '{n}' end" for n in (*_FOUND, 'full_text'))}], lambda x: x is not null) as low from g)
select doc_id, cast(l as int) as text_length, {' + '.join(f'cast({n} > 0 as int)' for n in _FOUND)} as fields_extracted, {_NEEDS_OCR} as ocr_used,
round(({' + '.join(f's_{n}' for n in (*_FOUND, 'full_text'))}) / 5, 3) as average_confidence, coalesce(array_to_string(low, ','), '') as flagged_fields, len(low) as fields_flagged from h""",
    "x01_basic_data": f"{DOCS} select doc, {', '.join(f'array_to_string({e}, {q(chr(124))}) as {n}' for n, e in _BASIC.items())} from dd",
    "x05_dates": f"{REC}, t as (select record_id, concat_ws(' to ', licence_start, licence_expiry) as body from rec) select record_id, array_to_string({dates('body', False)}, '|') as dates, array_to_string({dates('body', True)}, '|') as compat_dates from t",
    "x06_references": f"{DOCS}, r as (select doc, {_REFS} as refs from dd), u as (select doc, refs, list_filter(list_transform(range(1, len(refs) + 1), lambda i: case when list_position(refs, refs[i]) = i then refs[i] end), lambda x: x is not null) as d from r) select doc, array_to_string(refs, '|') as refs, array_to_string(d, '|') as distinct_refs from u",
    "x08_names": f"{LINES}, k as (select doc, pos, line, {_KNOWN} as known from li), n as (select doc, pos, known, {_LIKELY} as new from k) select doc, pos, {nice_name('x')} as name, 0.8::double as confidence from (select doc, pos, unnest(known) as x from n) union all select doc, pos, {nice_name('x')}, 0.6::double from (select doc, pos, unnest(new) as x from n)",
    "x16_fallback": f"{LINES} " + " union all ".join(f"select doc, pos, {q(k)} as kind, unnest({every('line', p)}) as entity, {s}::double as confidence from li" for k, p, s in X.FALLBACK),
    "r02_line_records": f"""{LINES}, {line_records('li')} select *, doc || '_' || i as record_id, '{{"council":0.5,"reference":0.5,"hmo_address":0.5,"hmo_manager_name":0.5,"max_occupancy":0.5}}' as scores, 'simple_pattern_matching' as extraction_method, true as needs_review from lr""",
    "r03_with_default": f"with ln as (select doc_id as doc, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents), {line_records('ln')} select doc_id as doc, coalesce(i, 0) as i, case when i is null then 'Unknown Council' else council end as council, i is null as is_default, case when i is null then 'Basic extraction - manual review recommended' end as extraction_note, doc_id || '_' || coalesce(i, 0) as record_id, true as needs_review from documents left join lr on doc = doc_id",
    "e01_mapping_errors": f"{REC} select record_id, {', '.join(f'{_mapping_error(m)} as e_{m.source}' for m in M.preset('detailed'))} from rec",
    "e04_export_rows": f"{REC} select record_id, {', '.join(f'{_format(m.source, m.kind, {1: DEFAULT_REFERENCE, 5: DEFAULT_NUMBER}.get(i))} as {m.source}' for i, m in enumerate(M.preset('compact')))} from rec",
    "s15_needs_ocr": f"select doc_id, {_NEEDS_OCR} as needs_ocr, cast(greatest(1, ({' + '.join(f'len(regexp_extract_all(lower(coalesce(text, {chr(39) * 2})), {q(k)}))' for k in X.KEYWORDS)}) // 5) as int) as estimated_records from documents",
    "s01_file_checks": rf"""with p as (select page_id, url || (['.pdf', '.DOCX', '.doc', '.txt'])[page_id % 4 + 1] as path, length(html) * (page_id % 11) * 9000 as n from pages), s as (select *, lower(regexp_extract(path, '(\.[^./]+)$', 1)) as x from p)
select page_id, case x when '.pdf' then 'pdf' when '.docx' then 'docx' else 'unknown' end as type, case when n > {H.MAX_BYTES} then 'file too large' when n = 0 then 'file is empty' when x not in ('.pdf', '.docx', '.doc') then 'unsupported file type' end as message,
case when n > {H.MAX_BYTES} then 'error: over 100 MB' when n > {H.WARN_BYTES} then 'warning: large' when n < 1024 then 'warning: small' else 'ok' end as warning, left(regexp_replace(translate(path, '<>:"/\|?*', '_________'), '\s+', '_', 'g'), 100) as safe from s""",
    "s25_csv_lines": f"{REC} select record_id, concat_ws(',', {', '.join(f'replace(replace(replace(coalesce(cast({c} as varchar), {chr(39) * 2}), {q(chr(44))}, {q(chr(59))}), chr(10), {q(chr(32))}), chr(13), {chr(39) * 2})' for c in ('council', 'reference', 'hmo_address', 'licence_start', 'licence_expiry', 'max_occupancy', 'hmo_manager_name', 'licence_holder_name'))}, '', '') as line from rec",
    "s26_download_rows": f"{SCORED} select council, reference, printf('%.3f', s_council) as council_confidence, printf('%.3f', s_reference) as reference_confidence, printf('%.3f', s_hmo_address) as hmo_address_confidence from sc where flagged",
    "j01_sessions_flagged": f"{STATE}, {SESSIONS}, top as (select * from ss order by uploaded desc, session_id limit 5) select session_id, uploaded, flagged from top join (select session_id, count(*) as flagged from st group by session_id) using (session_id)",
    "j02_sessions_completed": f"{STATE}, {SESSIONS} select * from ss where session_id in (select session_id from st where status in ('approved', 'rejected'))",
    "j03_trail": f"{STATE} select record_id, status, ts, event_id, action, log.reviewer from st join log using (record_id)",
    "j05_reviewed_export": f"{STATE}, rec as ({RECORDS_SQL}) select record_id, council, reference from rec where record_id in (select record_id from st where status = 'approved')",
    "j07_orphans": f"{REC} select record_id, session_id from rec where session_id >= 'S5'",
    "w02_recent_each": f"{LOG}, n as (select record_id, event_id, row_number() over (partition by record_id order by ts desc, event_id desc) as nth from log) select record_id, event_id, cast(nth as int) as nth from n where nth <= 3",
    "w04_latest": f"{LOG} select record_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(action, (ts, event_id)) as action from log group by record_id",
    "w06_sliding": f"{LOG} select event_id, reviewer, round(avg(confidence) over (partition by reviewer order by ts, event_id rows between 99 preceding and current row), 6) as moving from log",
    "o04_review_list": f"{STATE} select record_id, status, round(confidence, 6) as confidence, corrections from st where status = 'approved' and confidence between 10 and 60",
    "o07_recent": f"{LOG} select event_id, record_id, action, reviewer from log order by ts desc, event_id desc limit 10",
    "o09_retained": "select o_orderkey from orders where o_orderdate >= timestamp '2001-07-02'",
    "st07_review_state": f"{STATE} select record_id, session_id, status, reviewer, corrections, round(confidence, 6) as confidence, events from st",
    # event by event: a recursive fold that cancels only what is pending at that moment
    "st02_job_states": """with recursive e as (select 'J' || (event_id % 1999) as job_id, case event_type when 'signup' then 'enqueue' when 'view' then 'start' when 'purchase' then 'finish' when 'error' then 'fail' else 'cancel' end as action,
  case when event_id % 3 > 0 then cast(user_id % 200 - 40 as int) end as progress, ts from events),
n as (select *, row_number() over (partition by job_id order by ts, list_position(['enqueue', 'start', 'finish', 'fail', 'cancel'], action), progress nulls first) as k, count(*) over (partition by job_id) as last from e),
fold as (select job_id, cast(0 as bigint) as k, cast(null as varchar) as status, 0 as progress from n where k = 1
  union all select n.job_id, n.k, case action when 'enqueue' then 'pending' when 'start' then 'processing' when 'finish' then 'completed' when 'fail' then 'failed' else case when status = 'pending' then 'cancelled' else status end end, case when n.progress is null then fold.progress when n.progress < 0 then 0 when n.progress > 100 then 100 else n.progress end
  from fold join n on n.job_id = fold.job_id and n.k = fold.k + 1)
select fold.job_id, status, fold.progress from fold join n on n.job_id = fold.job_id and n.k = fold.k where fold.k = n.last and status is not null""",
    "st01_hourly": "select date_trunc('hour', ts) as hour, case event_type when 'signup' then 'enqueue' when 'view' then 'start' when 'purchase' then 'finish' when 'error' then 'fail' else 'cancel' end as action, count(*) as n from events group by 1, 2",
    "h01_error_classes": "select (['file_too_large', 'unsupported_format', 'corrupted_file', 'pdf_extraction_failed', 'ocr_failed', 'no_text_extracted', 'nlp_model_unavailable', 'entity_extraction_failed', 'memory_error', 'disk_space_error', 'database_error', 'validation_failed', 'unknown_error'])[event_id % 13 + 1] as class, count(*) as n from events group by 1",
    "h05_large_files": "select o_orderkey, m > 50 as chunked, round(least(10.0, m / 10), 6) as chunk_mb, m > 20 as watch_memory, m > 100 as disk_cache, m > 30 as concurrent, case when m > 100 then 1024 when m > 50 then 1536 else 2048 end as memory_limit_mb, case when m > 100 then 5 when m > 50 then 10 else 20 end as batch_size from (select o_orderkey, o_totalprice / 1000 as m from orders)",
    "t01_headers": f"{REC}, h as (select record_id, unnest([council, reference, hmo_address, licence_holder_name]) as x from rec) select record_id, sum(cast(trim(x) <> '' and (regexp_matches(lower(x), 'name|address|date|reference|licence|license') or (upper(x) = x and lower(x) <> x and length(x) > 2) or regexp_matches(x, '[:#]') or (regexp_matches(x, '^[\\p{{L}} ]+$') and len({words('x')}) <= 3)) as int)) * 2 > 4 as is_header from h group by record_id",
    "a15_report_lines": f"""{REC}, {_EXPORT_ERRORS},
t as (select count(*) as total, (select count(distinct record_id) from ee) as bad, (select count(*) from ee) as errors from rec),
f as ({" union all ".join(f"select {i} as nth, {q(m.name)} as name, 100.0::double * count(*) filter (not ({filled(m.source)})) / count(*) as a, 100.0::double * count(*) filter ({_export_error(m)} is not null) / count(*) as b from rec" for i, m in enumerate(M.preset("standard")))}),
l as (select row_number() over (order by record_id, nth) as k, record_id, error from ee order by record_id, nth limit 20)
select 0 as pos, 'CSV Export Validation Report' as line union all select 1, '==============================' union all select 2, 'Total Records: ' || total from t
union all select 3, 'Valid Records: ' || (total - bad) from t union all select 4, 'Invalid Records: ' || bad from t union all select 5, ''
union all select 10, 'Validation Errors:' from t where errors > 0 union all select 11, '------------------' from t where errors > 0
union all select cast(k as int) + 11, '  \u2022 Record ' || record_id || ': ' || error from l union all select 90, '  ... and ' || (errors - 20) || ' more errors' from t where errors > 20
union all select 91, '' from t where errors > 0 union all select 95, 'Field Statistics:' union all select 96, '-----------------'
union all select nth + 101, printf('  %s: %.1f%% empty, %.1f%% errors', name, a, b) from f""",
    "a21_database_stats": f"{STATE}, rec as ({RECORDS_SQL}) select (select count(distinct session_id) from rec) as sessions, (select count(*) from rec) as records, count(*) as flagged, count(*) filter (status in ('approved', 'rejected')) as reviewed from st",
    "a25_hit_rate": f"{LOG} select count(*) as requests, count(*) filter (action = 'approved') as hits, round(count(*) filter (action = 'approved') / count(*), 6) as rate from log",
    "j04_session_records": f"{REC}, {SESSIONS} select session_id, n_records, record_id, reference from ss join rec using (session_id)",
    "w03_record_index": f"{REC} select record_id, session_id, cast(row_number() over (partition by session_id order by record_id) - 1 as int) as place from rec",
    "o01_sessions": f"with {SESSIONS} select * from ss order by uploaded desc, session_id limit 4",
    "o05_preview": f"{SCORED} select record_id, council, reference from sc where overall >= 0.85 order by record_id limit 50",
    "o10_entity_union": f"{DOCS}, r as (select doc, {_REFS} as a, {every('text', X.FALLBACK[1][1])} as b from dd), u as (select doc, a, b, list_filter(list_transform(range(1, len(a) + 1), lambda i: case when list_position(a, a[i]) = i and not list_contains(b, a[i]) then a[i] end), lambda x: x is not null) as d from r) select doc, array_to_string(list_concat(a, b), '|') as bag, array_to_string(d, '|') as only_first from u",
    "a17_document_report": f"""{SCORED}, s0 as (select record_id, [{', '.join(f's_{f}' for f in FIELDS)}] as s, {listed([f"case when s_{f} < {b} then {q(f)} end" for f, b in _THRESHOLDS.items()])} as low from sc)
select record_id, 15 as n, round(list_avg(s), 6) as mean, round(list_median(s), 6) as median, round(list_min(s), 6) as least, round(list_max(s), 6) as most, round(list_stddev_samp(s), 6) as std, array_to_string(low, '|') as flagged_fields,
case when len(low) = 0 then 'All fields meet confidence thresholds. No manual review required.' when len(low) > 7.5 then 'More than 50% of fields flagged. Consider reviewing source document quality.' else len(low) || ' fields flagged for manual review.' end
|| case when round(list_avg(s), 12) < 0.7 then '|Overall confidence is low. Consider using additional extraction methods.' else '' end as advice from s0""",
    "a20_report": f"{STATE} select count(*) as total, {', '.join(f'count(*) filter (status = {q(x)}) as n_{x}' for x in _STATUSES)}, round(count(*) filter (status in ('approved', 'rejected')) / count(*), 6) as completion_rate, cast(sum(corrections) as bigint) as total_corrections, count(*) filter (corrections > 0) as records_with_corrections from st",
    "a20_reasons": f"{STATE} select reason, count(*) as n from st group by reason order by n desc, reason limit 5",
    "a21_session_counts": f"with {SESSIONS} select status, count(*) as sessions, cast(sum(n_records) as bigint) as records from ss group by status",
    "a30_edit_summary": f"""{SCORED}, e as (select record_id, [{', '.join(f's_{f}' for f in FIELDS)}] as s, 1 + {' + '.join(f"cast({f} <> upper({f}) as int)" for f in TEXT_FIELDS)} as changed from sc)
select record_id, cast(changed as int) as changed, round(list_avg(s), 6) as average, cast(len(list_filter(s, lambda x: x >= 0.8)) as int) as n_excellent, cast(len(list_filter(s, lambda x: x >= 0.6 and x < 0.8)) as int) as n_good,
cast(len(list_filter(s, lambda x: x >= 0.4 and x < 0.6)) as int) as n_warning, cast(len(list_filter(s, lambda x: x < 0.4)) as int) as n_error from e""",
    "c10_document_confidence": f"""{DOCS}, f as (select doc, length(text) as l, doc % 3 as t, case when doc % 2 = 0 then doc % 7 / 7 else 0.8 end as acc, {', '.join(f'{e} as {n}' for n, e in _FOUND.items())} from dd) select doc, """ + ", ".join(_document(*x) for x in (("pdf", 0.8, 0.3), ("ocr", 0.6, 0.3), ("docx", 0.9, 0.4))) + " from f",
    "x03_addresses": f"""{LINES}, s as (select doc, pos, unnest({every('line', X.STREET)}) as x from li),
p as (select doc, pos, line, {every('line', X.POSTCODE_LINE)} as codes from li), c as (select doc, pos, line, codes[1] as code, instr(line, codes[1]) as o from p where len(codes) = 1 and length({strip("left(line, instr(line, codes[1]) - 1)")}) > 10)
select doc, pos, {nice_address('x')} as address, 0.8::double as confidence from s union all select doc, pos, {nice_address("line[greatest(1, o - 100):o + length(code) - 1]")}, 0.9::double from c""",
    # white space is doubled first, so that neighbours don't share what bounds them
    "x12_ruler": f"""{LINES}, d as (select doc, pos, regexp_replace(line, '\\s', '  ', 'g') as line from li), e as (""" + " union all ".join(f"select doc, pos, {q(label)} as label, unnest(regexp_extract_all(line, {q(p)}, 1, {q(o)})) as x from d" for label, p, o in _RULER) + f""")
select doc, pos, label, regexp_replace(x, '  ', ' ', 'g') as entity, round(({_RULER_SCORE}), 6) as confidence from e""",
    "x14_entities": f"""{LINES}, d as (select doc, pos, regexp_replace(line, '\\s', '  ', 'g') as line from li), e as (""" + " union all ".join(f"select doc, pos, {q('DATE' if label == 'DATE_PATTERN' else label)} as label, unnest(regexp_extract_all(line, {q(p)}, 1, {q(o)})) as x, 0.9::double as confidence from d" for label, p, o in _RULER if label in ("LICENSE_REF", "DATE_PATTERN")) + " union all " + " union all ".join(f"select doc, pos, {q(label)}, unnest(list_transform({every('line', p)}, lambda t: {strip('t')})), {score}::double from li" for label, p, score in X.ENTITY_PATTERNS) + ") select doc, pos, label, x as entity, confidence from e",
    "r01_entity_records": f"""{DOCS}, k0 as (select doc, text, {every('text', *X.NAMES)} as known0, {every('text', X.CAPITALIZED)} as caps from dd),
k as (select doc, text, caps, list_filter(known0, lambda n: {is_name('n')}) as known from k0),
a as (select doc, {every('text', X.FALLBACK[0][1])} as cs, {_distinct(_REFS)} as rs, {every('text', X.STREET)} as ads, {dates('text', False)} as ds, {every('text', X.BASIC_NUMBERS[2])} as os,
  list_transform(list_concat(known, list_filter(caps, lambda n: not list_contains(known, n) and not regexp_matches(lower(n), {q('|'.join(X.NO_NAMES))}) and {is_name('n')})), lambda n: {nice_name('n')}) as ns from k),
r as (select *, unnest(range(cast(greatest(len(cs), len(rs), len(ads), 1) as int))) as i from a)
select doc, cast(i as int) as i, coalesce(cs[i + 1], '') as council, coalesce(rs[i + 1], '') as reference, coalesce(ads[i + 1], '') as hmo_address, {_pair('ds', 1)} as licence_start, {_pair('ds', 2)} as licence_expiry,
{_pair('ns', 1)} as hmo_manager_name, {_pair('ns', 2)} as licence_holder_name, coalesce(try_cast(os[i + 1] as int), 0) as max_occupancy from r where coalesce(cs[i + 1], '') <> '' or coalesce(rs[i + 1], '') <> '' or coalesce(ads[i + 1], '') <> ''""",
    "r05_json_round_trip": f"{SCORED} select record_id, {', '.join(FIELDS)}, s_council as council_score, array_to_string(errors, '|') as errors from sc",
    "e07_presets": f"{SCORED} " + " union all ".join(f"select {q(n)} as preset, record_id, concat_ws('|', {', '.join(f'cast({f} as varchar)' for f in fields)}) as shown, case when overall >= {hi} then 'high' when overall >= {mid} then 'medium' else 'low' end as level, overall < {flag} or {' or '.join(blank(f) for f in need)} as needs_review from sc" for n, fields, (hi, mid, flag), need in _UI),
    "h07_stored_names": """with n as (select page_id, regexp_replace(replace(url, '/', '?') || repeat('x', cast(page_id % 3 * 150 as int)) || '.pdf', '[<>:"|?*\\\\]', '_', 'g') as x from pages) select page_id, case when length(x) > 255 then left(x, 251) || '.pdf' else x end as stored from n""",
    "h08_safe_paths": "select page_id, ([true, false, false, true, false, false, true])[page_id % 7 + 1] as safe from pages",
    # full stops of abbreviations are set aside, then the breaks are marked, as this engine's patterns can't look around
    "x11_sentences": rf"""with d as (select doc_id, coalesce(text, '') as text from documents),
a as (select doc_id, text, regexp_replace(text, '\b(Mr|Mrs|Ms|Dr|St|No|Rd|Ave|Ref|Ltd|Co|approx|max|min)\.', '\1' || chr(1), 'g') as x from d),
b as (select doc_id, text, regexp_replace(regexp_replace(x, '([.!?])[ \t\x0b\f\r]+([A-Z0-9"''(\[À-Þ])', '\1' || chr(2) || '\2', 'g'), '[ \t\x0b\f\r]*\n[ \t\x0b\f\r\n]*', chr(2), 'g') as x from a),
c as (select doc_id, list_filter(list_transform(string_split(replace(x, chr(1), '.'), chr(2)), lambda s: regexp_replace(s, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')), lambda s: s <> '') as s,
  regexp_extract_all(text, '{_TOKEN}') as t from b)
select doc_id, len(s) as sentences, len(t) as tokens, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) as longest, md5(coalesce(array_to_string(s, '|'), '')) as sentence_md5, md5(coalesce(array_to_string(t, '|'), '')) as token_md5 from c""",
    "h04_cache_kept": """with e as (select md5(cast(event_id as varchar)) as key, ts, cast(trunc(abs(value) * 100) as bigint) as bytes from events where ts > timestamp '2024-01-29' and ts <= timestamp '2024-01-30'),
r as (select key, bytes, sum(bytes) over (order by date_trunc('minute', ts) desc, key desc rows unbounded preceding) as run, sum(bytes) over () as whole from e)
select key, bytes from r where whole <= 400000 or run <= 320000""",
    "a17_field_analysis": f"{REC} " + " union all ".join(
        f"select record_id, {q(f)} as field, round({_k(f, c)}, 6) as confidence_score, {_THRESHOLDS[f]}::double as threshold, {_k(f, c)} >= {_THRESHOLDS[f]} as above_threshold, 'regex_pattern' as extraction_method, {', '.join(f'cast({v} as double) as {k}_factor' for k, (_, v) in _k_parts(f, c).items())}, 0.0::double as consistency_factor from rec"
        for f, c in _K_CONTEXT.items()
    ),
    "h03_service_health": """with c as (select 'service_' || (user_id % 40) as name, user_id % 40 as k, ts, case when event_type <> 'error' then value > 20 end as healthy from events),
n as (select *, row_number() over (partition by name order by ts desc, coalesce(cast(healthy as int), -1) desc) as nth from c)
select name, case when healthy then 'healthy' when not healthy then 'unhealthy' else 'error' end as status, ts as last_check, case when healthy then name when k % 3 = 0 then 'fallback_' || k end as use from n where nth = 1""",
    "h10_memory": "select o_custkey, round(1000 / 1024, 6) as batch_memory_mb, round(n / 1024, 6) as total_memory_mb, least(1000, greatest(100, n // 10)) as recommended_batch_size from (select o_custkey, count(*) * 100 as n from orders group by o_custkey)",
    "h12_upload_advice": f"""with d as (select doc_id, text, coalesce(length(text), 0) as n, len(regexp_extract_all(lower(coalesce(text, '')), 'licence|license')) // 5 as r from documents)
select doc_id, concat_ws('|', case when n / 500 > 50 then 'Consider splitting large documents for faster processing' end, case when {_NEEDS_OCR} then 'Document appears to be scanned. OCR processing will be used, which may take longer' end,
case when r = 0 then 'No HMO-related content detected. Please verify this is the correct document type' end, case when doc_id % 2 = 0 and n // 100 > 20 then 'Large PDF detected. Consider using DOCX format for better processing speed' end) as advice from d""",
    "r04_penalty": f"{SCORED} select record_id, " + ", ".join(f"round(s_{f} * case when session_id in ('S0', 'S3', 'S6') then 0.7::double else 1 end, 6) as {f}" for f in ("council", "reference", "hmo_address")) + " from sc",
    "r06_table_records": """select p_brand as doc, cast(row_number() over (partition by p_brand order by p_partkey) - 1 as int) as i, p_name as name, case when p_partkey % 4 >= 1 then p_type else '' end as type, case when p_partkey % 4 >= 2 then cast(p_size as varchar) else '' end as size from part""",
    "st09_downloads": """with e as (select *, user_id % 500 as token from events), k as (select token, min(ts) as created from e where event_type = 'signup' group by token),
v as (select event_id, token, ts, created, (select count(*) from e u where u.event_type = 'click' and u.token = e.token and u.ts >= created and u.ts < e.ts) as downloads from e left join k using (token) where event_type = 'view')
select event_id, downloads, case when created is null or created > ts then 'Invalid download token' when ts > created + interval 7 days then 'Download link has expired' when downloads >= 10 then 'Download limit exceeded' when token % 9 = 0 then 'File no longer available' else '' end as problem from v""",
    "s28_audited_export": f"""{STATE}, rec as ({RECORDS_SQL}), {_SCORED_TAIL} select {', '.join(f'sc.{f}' for f in FIELDS)}, {', '.join(f'round(sc.s_{f}, 6) as {f}_confidence' for f in FIELDS)}, sc.record_id as audit_record_id, st.reason as audit_flag_reason,
st.status as audit_review_status, coalesce(st.reviewer, '') as audit_reviewer, st.completed as audit_review_completed, st.corrections as audit_corrections_made from sc join st on st.record_id = sc.record_id where st.status in ('approved', 'rejected')""",
    "a11_report_json": f"""{CHECKED}, {_METRICS}, v as (select count(*) as total, count(*) filter (v_valid) as valid, count(*) filter (not v_valid) as invalid, round(count(*) filter (v_valid) / count(*), 6) as rate, round(avg(v_score), 6) as confidence from ck),
e as (select 'error' as kind, message, count(*) as n from (select unnest(v_errors) as message from ck) group by message order by n desc, message limit 5),
w as (select 'warning' as kind, message, count(*) as n from (select unnest(v_warnings) as message from ck) group by message order by n desc, message limit 5)
select 'totals' as part, cast(to_json({{'total': total, 'valid': valid, 'invalid': invalid, 'rate': rate, 'confidence': confidence}}) as varchar) as body from v
union all select 'field', cast(to_json({{'field': field, 'total': total, 'populated': populated, 'avg_confidence': round(a, 6), 'min_confidence': cast(lo as double), 'max_confidence': round(cast(hi as double), 6), 'n_errors': n_errors, 'n_warnings': n_warnings, 'level': level}}) as varchar) from mm
union all select 'message', cast(to_json({{'kind': kind, 'message': message, 'n': n}}) as varchar) from (select * from e union all select * from w)""",
    "a11_report_summary": f"""{CHECKED}, v as (select count(*) as total, count(*) filter (v_valid) as valid, avg(v_score) as c from ck), e as (select message, count(*) as n from (select unnest(v_errors) as message from ck) group by message order by n desc, message limit 5)
select 0 as pos, 'Records: ' || total as line from v union all select 1, 'Valid: ' || valid || printf(' (%.1f%%)', 100.0 * valid / total) from v union all select 2, printf('Confidence: %.2f', c) from v
union all select cast(row_number() over (order by n desc, message) as int) + 2, message || ': ' || n from e""",
    "h03_system_status": """with s as (select event_type <> 'error' and count(*) filter (value < 10) * 3 < count(*) as good from events group by event_type)
select case when count(*) filter (good) = count(*) then 'healthy' when count(*) filter (good) > 0 then 'degraded' else 'critical' end as overall_health, count(*) as total_services, count(*) filter (good) as healthy_services from s""",
    "h13_efficiency": f"""{STATE}, c as (select record_id, arg_max(confidence, (ts, event_id)) - arg_min(confidence, (ts, event_id)) as rise from log group by record_id),
h as (select st.*, rise, (epoch_us(completed) - epoch_us(started)) / 3600000000 as hours from st left join c using (record_id))
select round(coalesce(count(*) filter (status in ('approved', 'rejected') and hours > 0) / sum(hours) filter (status in ('approved', 'rejected') and hours > 0), 0), 6) as records_per_hour, round(sum(corrections) / count(*), 6) as corrections_per_record,
round(coalesce(count(*) filter (status = 'approved' and corrections = 0) / count(*) filter (status = 'approved'), 0), 6) as first_pass_rate, round(avg(rise), 6) as confidence_rise from h""",
    "o02_sessions_by_status": f"with {SESSIONS} select session_id, status from ss where status = 'completed'",
    "o04_by_reason": f"{STATE} select record_id, status, reason, round(confidence, 6) as confidence from st where reason = 'reason 3' and confidence >= 0",
    "o08_newest": "select event_id, ts from events order by ts desc, event_id limit 25",
}
