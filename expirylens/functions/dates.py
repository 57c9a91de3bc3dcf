"""The date grammar: named patterns, span extraction and calendar checks.

The grammar is written as Spark SQL text, so one parse in the JVM builds the whole expression.

Every pattern is applied with one regexp_replace that wraps each hit as
``MARK year SEP month SEP day SEP whole-hit MARK``. Splitting at MARK gives text and hits in turn,
so offsets, components and the hit itself come out of a single scan per pattern. Cheap flags
(a separator, a blank, four digits in a row, ...) decide which patterns are tried on a text at
all, and only patterns that hit anything reach the array functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from expirylens.functions.text import (CONFUSION_FROM, CONFUSION_SPAN, CONFUSION_TO, WS_CHARS, zfill)

MARK, SEP_CH = "\u0001", "\u0002"

# The building blocks and shapes of the grammar. All white space is turned into
# plain blanks before matching.
_S, _SS = " *", " +"
_SEP = r" *[.\-/:,] *"
_HEAD = r"(?<!\d)(?<!\d[.\-/:,])"
_LOT = r"(?=[A-Za-z0-9]*[A-Za-z])"
_YEAR = r"(\d{2,4})"     # three digits use up their text, but are no year
_MONTHS = (r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|"
           r"sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?")
MONTH_ABBREVIATIONS = "janfebmaraprmayjunjulaugsepoctnovdec"

# What a text must hold before a pattern is tried: SQL conditions on the text ``t`` and on its
# outline ``o``, in which every digit is 9, every separator a dot, and blanks are gone. All are
# necessary conditions of the patterns that name them, and all are plain substring searches but one.
_OUTLINE = "translate(t, '0123456789.-/:, ', '9999999999.....')"
FLAGS = {
    "month": "contains(t, '월')",
    "blank": "contains(t, ' ')",
    "two_parts": "contains(o, '9.9')",
    "three_parts": "(contains(o, '9.9.9') OR contains(o, '9.99.9'))",
    "year_first": "contains(o, '9999.9')",
    "year_last": "contains(o, '9.9999')",
    "year4_md4": "contains(o, '9999.9999')",
    "year4": "contains(o, '9999')",
    "digits6": "contains(o, '999999')",
    "letter": "t rlike '[A-Za-z]'",
    "name": "(t rlike '[A-Za-z]' AND t rlike '(?i)jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec')",
}


@dataclass(frozen=True)
class DatePattern:
    name: str
    regex: str
    year: str            # replacement text for the component: "$n" or "" when it has none
    month: str
    day: str
    reliability: float
    needs: tuple[str, ...]
    day_first: bool = False
    month_names: bool = False
    partial: bool = False
    in_joined_lines: bool = True


# The grammar in matching order, with the reliability used in scoring.
PATTERNS: tuple[DatePattern, ...] = (
    DatePattern("ymd_korean", rf"(?<!\d){_YEAR}{_S}년{_S}(\d{{1,2}}){_S}월{_S}(\d{{1,2}}){_S}일?",
                "$1", "$2", "$3", 1.00, ("month",)),
    DatePattern("ymd_separated", rf"{_HEAD}{_YEAR}{_SEP}(\d{{1,2}}){_SEP}(\d{{1,2}})(?!\d)",
                "$1", "$2", "$3", 1.00, ("three_parts",)),
    DatePattern("ymd_lot_attached", rf"{_HEAD}(20\d{{2}}){_SEP}(\d{{1,2}}){_SEP}(\d{{1,2}}){_LOT}",
                "$1", "$2", "$3", 0.96, ("three_parts", "year_first", "letter")),
    DatePattern("ymd_spaced", rf"(?<!\d)(\d{{4}}){_SS}(\d{{1,2}}){_SS}(\d{{1,2}})(?!\d)",
                "$1", "$2", "$3", 0.88, ("blank", "year4")),
    DatePattern("ymd_mixed_compact", rf"(?<![\d.\-/,])(\d{{4}}){_S}[.\-/,]{_S}(\d{{2}})(\d{{2}})(?!\d)",
                "$1", "$2", "$3", 0.84, ("year4_md4",)),
    DatePattern("ym_korean", rf"(?<!\d){_YEAR}{_S}년{_S}(\d{{1,2}}){_S}월(?!{_S}\d)",
                "$1", "$2", "", 0.78, ("month",)),
    DatePattern("ym_separated", rf"(?<![\d.\-/:,])(\d{{4}}){_SEP}(\d{{1,2}})(?!\d|{_SEP}\d)",
                "$1", "$2", "", 0.74, ("year_first",)),
    DatePattern("dmy_separated", rf"{_HEAD}(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}{_YEAR}(?!\d)",
                "$3", "$2", "$1", 0.92, ("three_parts",), day_first=True),
    DatePattern("dmy_lot_attached", rf"{_HEAD}(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}(20\d{{2}}){_LOT}",
                "$3", "$2", "$1", 0.92, ("three_parts", "year_last", "letter"), day_first=True),
    DatePattern("dmy_spaced", rf"(?<!\d)(\d{{1,2}}){_SS}(\d{{1,2}}){_SS}{_YEAR}(?!\d)",
                "$3", "$2", "$1", 0.86, ("blank",), day_first=True),
    DatePattern("my_separated", rf"(?<![\d.\-/:,])(\d{{1,2}}){_SEP}(\d{{4}})(?!\d)",
                "$2", "$1", "", 0.72, ("year_last",), day_first=True),
    DatePattern("mdy_separated",
                rf"{_HEAD}(0?[1-9]|1[0-2]){_SEP}(1[3-9]|2\d|3[01]){_SEP}{_YEAR}(?!\d)",
                "$3", "$1", "$2", 0.90, ("three_parts",), day_first=True, in_joined_lines=False),
    DatePattern("mdy_month_name",
                rf"(?i)(?<![A-Za-z0-9])({_MONTHS}){_S}[.\-/,]?{_S}(\d{{1,2}})"
                rf"(?:{_S}[.\-/,]+{_S}|{_SS}){_YEAR}(?!\d)",
                "$3", "$1", "$2", 0.95, ("name",), month_names=True),
    DatePattern("dmy_month_name",
                rf"(?i)(?<![A-Za-z0-9])(\d{{1,2}}){_S}[.\-/,]?{_S}({_MONTHS})"
                rf"(?:{_S}[.\-/,]?{_S}){_YEAR}(?!\d)",
                "$3", "$2", "$1", 0.92, ("name",), day_first=True, month_names=True),
    DatePattern("ymd_compact", r"(?<!\d)(\d{8}|\d{6})(?!\d)", "$1", "", "", 0.90, ("digits6",)),
    DatePattern("md_korean", rf"(?<![\d년])(\d{{1,2}}){_S}월{_S}(\d{{1,2}}){_S}일?",
                "", "$1", "$2", 0.72, ("month",), partial=True),
    DatePattern("md_separated", rf"(?<![\d.\-/,])(\d{{1,2}}){_SEP}(\d{{1,2}})(?!\d)",
                "", "$1", "$2", 0.70, ("two_parts",), partial=True),
)
PATTERN_BY_NAME = {p.name: p for p in PATTERNS}
DEFAULT_RELIABILITY = 0.5

# Two-digit years before this are read as a swapped day when the last part looks
# like a plausible year.
SWAP_YEAR_BELOW, SWAP_YEAR_MIN, SWAP_YEAR_MAX = 18, 18, 35


def enabled_patterns(day_first: bool, month_names: bool, joined: bool = False) -> list[tuple[int, DatePattern]]:
    return [(i, p) for i, p in enumerate(PATTERNS)
            if (day_first or not p.day_first) and (month_names or not p.month_names)
            and (p.in_joined_lines or not joined)]


def calendar_valid(year: Column, month: Column, day: Column) -> Column:
    """True for a real date; a missing day passes, a missing year is checked as a leap year.

    Works on string or integer columns; anything that is not a number gives false.
    """
    y = F.nullif(year.cast("string"), F.lit(""))
    text = F.concat_ws("-", F.coalesce(zfill(y, 4), F.lit("2000")), zfill(month.cast("string"), 2),
                       F.coalesce(zfill(day.cast("string"), 2), F.lit("01")))
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull() & ~(
        F.coalesce(y.try_cast("int") == 0, F.lit(False)) & day.isNotNull())


# --- SQL text of the grammar ---------------------------------------------------------------------

def _str(s: str) -> str:
    """SQL literal that keeps backslashes and control characters as they are."""
    assert "'" not in s
    return f"r'{s}'"


def trim_sql(x: str) -> str:
    return f"btrim({x}, {_str(WS_CHARS)})"


def trimmed_sql(x: str) -> str:
    """As trim_sql, for a cheap ``x``; text between visible ASCII characters or Hangul syllables is taken as it is."""
    visible = lambda c: f"(ascii({c}) BETWEEN 33 AND 126 OR ascii({c}) BETWEEN 44032 AND 55203)"
    return f"CASE WHEN {visible(x)} AND {visible(f'substring({x}, -1, 1)')} THEN {x} ELSE {trim_sql(x)} END"


def corrected_sql(x: str) -> str:
    """Confusion-corrected text of an SQL expression (see text.correct_numeric_confusions)."""
    marked = f"regexp_replace({x}, {_str(CONFUSION_SPAN)}, '{MARK}$0{MARK}')"
    return (f"CASE WHEN {x} rlike '[OoIil|]' THEN array_join(transform(split({marked}, '{MARK}', -1), "
            f"(s, i) -> IF(i % 2 = 1, translate(s, '{CONFUSION_FROM}', '{CONFUSION_TO}'), s)), '') "
            f"ELSE {x} END")


def blanked_sql(x: str) -> str:
    """Every kind of white space as a plain blank, position by position; marks are neutralised."""
    other = "".join(c for c in WS_CHARS if c != " ")
    return f"translate({x}, {_str(other + MARK + SEP_CH)}, '{' ' * len(other)}\u0003\u0003')"


def _hits_sql(patterns: list[tuple[int, DatePattern]], whole: bool = False) -> str:
    """array<struct<ord, pattern, marked>> of the patterns that hit column ``t``."""
    items = []
    for i, p in patterns:
        regex = p.regex
        if whole:
            flag, body = ("(?i)", regex[4:]) if regex.startswith("(?i)") else ("", regex)
            regex = rf"{flag}\A(?:{body})\z"
        template = MARK + SEP_CH.join((p.year, p.month, p.day, "$0")) + MARK
        mark = f"regexp_replace(t, {_str(regex)}, '{template}')"
        if not whole:
            mark = f"CASE WHEN {' AND '.join('f_' + n for n in p.needs)} THEN {mark} END"
        items.append(f"named_struct('ord', {i}, 'pattern', '{p.name}', 'marked', {mark})")
    return f"filter(array({', '.join(items)}), h -> contains(h.marked, '{MARK}'))"


def _valid_sql(r: str) -> str:
    """Calendar check of padded components. Comparisons only: a failing cast costs an exception."""
    leap = f"(CAST({r}.year AS int) % 4 = 0 AND (CAST({r}.year AS int) % 100 <> 0 OR CAST({r}.year AS int) % 400 = 0))"
    last = (f"CASE WHEN {r}.month IN ('04', '06', '09', '11') THEN '30' WHEN {r}.month <> '02' THEN '31' "
            f"WHEN {r}.year IS NULL OR {leap} THEN '29' ELSE '28' END")
    return (f"coalesce({r}.month BETWEEN '01' AND '12' AND ({r}.day IS NULL OR "
            f"(NOT {r}.year <=> '0000' AND {r}.day BETWEEN '01' AND {last})), false)")


def _spans_sql(hits: str, text: str, day_first: bool) -> str:
    """array<struct<start, neg_len, ord, seq, pattern, raw_text, year, month, day, valid>>."""
    def ymd(y: str, m: str, d: str) -> str:
        return f"named_struct('year', {y}, 'month', {m}, 'day', {d})"

    parts = (f"transform({hits}, h -> named_struct('ord', h.ord, 'pattern', h.pattern, 'parts', "
             f"transform(split(h.marked, '{MARK}', -1), s -> split(s, '{SEP_CH}', -1))))")
    found = (f"filter(flatten(transform({parts}, h -> transform(sequence(1, size(h.parts) - 2, 2), (i, k) -> named_struct("
             "'start', aggregate(slice(h.parts, 1, i), 0, (a, x) -> a + length(element_at(x, -1))), "
             "'neg_len', -length(h.parts[i][3]), 'ord', h.ord, 'seq', k, 'pattern', h.pattern, "
             "'y', h.parts[i][0], 'm', h.parts[i][1], 'd', h.parts[i][2], 'raw', h.parts[i][3])))), s -> length(s.y) <> 3)")
    # the reading the shape names
    month = (f"CASE WHEN endswith(s.pattern, 'month_name') THEN CAST(CAST((instr('{MONTH_ABBREVIATIONS}', "
             "lower(substring(s.m, 1, 3))) + 2) / 3 AS int) AS string) ELSE s.m END")
    plain = ymd("CASE WHEN length(s.y) = 2 THEN concat('20', s.y) ELSE nullif(s.y, '') END",
                f"lpad({month}, 2, '0')", "lpad(nullif(s.d, ''), 2, '0')")
    compact8 = ymd("substring(s.y, 1, 4)", "substring(s.y, 5, 2)", "substring(s.y, 7, 2)")
    compact6 = ymd("concat('20', substring(s.y, 1, 2))", "substring(s.y, 3, 2)", "substring(s.y, 5, 2)")
    main = (f"CASE WHEN s.pattern <> 'ymd_compact' THEN {plain} WHEN length(s.y) = 8 THEN {compact8} "
            f"ELSE {compact6} END")
    keep = ("'start', s.start, 'neg_len', s.neg_len, 'ord', s.ord, 'seq', s.seq, 'pattern', s.pattern, "
            f"'raw_text', {trim_sql(f'substring({text}, s.start + 1, -s.neg_len)')}")
    out = ("'start', s.start, 'neg_len', s.neg_len, 'ord', s.ord, 'seq', s.seq, 'pattern', s.pattern, "
           "'raw_text', s.raw_text, 'year', {r}.year, 'month', {r}.month, 'day', {r}.day, 'valid', {ok}")
    if not day_first:
        read = f"transform({found}, s -> named_struct({keep}, 'r', {main}))"
        return f"transform({read}, s -> named_struct({out.format(r='s.r', ok=_valid_sql('s.r'))}))"
    # day-first alternatives: eight digits reversed replace an invalid reading, a plausible swap of
    # day and year always wins
    reversed8 = ymd("substring(s.y, 5, 4)", "substring(s.y, 3, 2)", "substring(s.y, 1, 2)")
    swap = ("startswith(s.pattern, 'ymd') AND length(s.y) = 2 AND "
            f"(CAST(s.y AS int) < {SWAP_YEAR_BELOW} OR (contains(s.raw, '/') AND CAST(s.y AS int) > 12)) AND "
            f"CAST(s.d AS int) BETWEEN {SWAP_YEAR_MIN} AND {SWAP_YEAR_MAX}")
    other = (f"CASE WHEN s.pattern = 'ymd_compact' AND length(s.y) = 8 THEN {reversed8} WHEN {swap} THEN "
             + ymd("concat('20', s.d)", "lpad(s.m, 2, '0')", "s.y") + " END")
    read = f"transform({found}, s -> named_struct({keep}, 'r', {main}, 'o', {other}))"
    checked = (f"transform({read}, s -> named_struct('s', s, 'ok', {_valid_sql('s.r')}, "
               f"'o_ok', s.o IS NOT NULL AND {_valid_sql('s.o')}))")
    chosen = (f"transform({checked}, c -> named_struct('s', c.s, 'ok', c.ok OR c.o_ok, 'r', "
              "CASE WHEN c.o_ok AND (NOT c.ok OR c.s.pattern <> 'ymd_compact') THEN c.s.o ELSE c.s.r END))")
    final = out.replace("s.", "c.s.").format(r="c.r", ok="c.ok")
    return f"transform({chosen}, c -> named_struct({final}))"


_NO_OVERLAP = ("filter(__part, p -> NOT exists(__full, f -> p.start < f.start - f.neg_len "
               "AND f.start < p.start - p.neg_len))")
# first of equal (components, pattern); nulls are equal
_FIRST_PER_KEY = ("CASE WHEN size(__spans) < 2 THEN __spans ELSE filter(__spans, (s, i) -> array_position("
                  "transform(__spans, q -> named_struct('y', q.year, 'm', q.month, 'd', q.day, 'p', q.pattern)), "
                  "named_struct('y', s.year, 'm', s.month, 'd', s.day, 'p', s.pattern)) = i + 1) END")


def _marked(df: DataFrame, text: str, keep: list[str], enabled: list[tuple[int, DatePattern]]) -> DataFrame:
    """The corrected text and the hits of the full and the partial patterns."""
    full = [(i, p) for i, p in enabled if not p.partial]
    part = [(i, p) for i, p in enabled if p.partial]
    return (df.selectExpr(*keep, f"{text} AS __raw")
            .selectExpr(*keep, f"{corrected_sql('__raw')} AS __text")
            .selectExpr(*keep, "__text", f"{blanked_sql('__text')} AS t")
            .selectExpr(*keep, "__text", "t", f"{_OUTLINE} AS o")
            .selectExpr(*keep, "__text", "t", *[f"{sql} AS f_{n}" for n, sql in FLAGS.items()])
            .selectExpr(*keep, "__text", f"{_hits_sql(full)} AS __full", f"{_hits_sql(part)} AS __part"))


def explode_spans(df: DataFrame, text: str, keep: list[str], day_first: bool, month_names: bool,
                  joined: bool = False, keep_invalid: bool = False, as_array: bool = False) -> DataFrame:
    """Find the date candidates of the SQL expression ``text``, in order.

    One row per candidate with columns ``pos`` and ``s``, or with ``as_array`` one row per text
    with the array ``spans``. Nothing filters on a computed column here: the optimizer would push
    such a filter below the projection and evaluate the whole grammar a second time.
    """
    enabled = enabled_patterns(day_first, month_names, joined)
    # start, longest first, pattern order; the joined pass keeps pattern order
    spans = "__spans" if joined else "array_sort(__spans)"
    if not keep_invalid:
        spans = f"filter({spans}, s -> s.valid)"
    out = (_marked(df, text, keep, enabled)
           .selectExpr(*keep, f"{_spans_sql('__full', '__text', day_first)} AS __full",
                       f"{_spans_sql('__part', '__text', False)} AS __part")
           .selectExpr(*keep, f"concat(__full, CASE WHEN size(__part) = 0 THEN __part ELSE {_NO_OVERLAP} END) AS __spans")
           .selectExpr(*keep, f"{spans} AS __spans"))
    if as_array:
        kept = f"filter(array(named_struct('spans', {_FIRST_PER_KEY})), q -> size(q.spans) > 0)"
        return out.selectExpr(*keep, f"explode({kept}) AS q").selectExpr(*keep, "q.spans AS spans")
    return out.selectExpr(*keep, f"posexplode({_FIRST_PER_KEY}) AS (pos, s)")


# The settings of the two parser flags (day first, month names); setting j has bit 1 << j.
FLAG_PAIRS = ((False, False), (True, False), (False, True), (True, True))


def annotated_spans(df: DataFrame, text: str, keep: list[str], joined: bool = False, keep_invalid: bool = False) -> DataFrame:
    """The candidates of the SQL expression ``text`` under all four settings of the parser flags, from one run of the grammar.

    One row per text that has any, with the array ``spans``. Each span has the mask ``flags`` of the settings under which it
    survives, and in ``places`` its position from 1 among the candidates of each setting (0: none). Overlap, order and
    repetition rules are applied for each setting, as a shape that one setting adds may push out a partial date of another.
    A span that day-first reading turns around is there once for each reading.
    """
    enabled = enabled_patterns(True, True, joined)
    by_setting, survivors = [], []
    for j, (day_first, month_names) in enumerate(FLAG_PAIRS):
        orders = ", ".join(str(i) for i, _ in enabled_patterns(day_first, month_names, joined))
        full = f"filter(__full_{int(day_first)}, f -> f.ord IN ({orders}))"
        apart = _NO_OVERLAP.replace("__full", full)
        every = f"concat({full}, CASE WHEN size(__part) = 0 THEN __part ELSE {apart} END)"
        if not joined:
            every = f"array_sort({every})"
        by_setting.append(f"{every if keep_invalid else f'filter({every}, s -> s.valid)'} AS __of_{j}")
        survivors.append(f"{_FIRST_PER_KEY.replace('__spans', f'__of_{j}')} AS __of_{j}")
    settings = [f"__of_{j}" for j in range(len(FLAG_PAIRS))]
    merged = settings[0]
    for name in settings[1:]:
        merged = f"array_union({merged}, {name})"
    fields = ", ".join(f"'{n}', s.{n}" for n in ("raw_text", "year", "month", "day", "valid", "pattern"))
    places = ", ".join(f"CAST(array_position({name}, s) AS int)" for name in settings)
    placed = f"transform({merged}, s -> named_struct({fields}, 'places', array({places})))"
    mask = " + ".join(f"IF(s.places[{j}] > 0, {1 << j}, 0)" for j in range(len(settings)))
    fields += ", 'places', s.places"
    out = (_marked(df, text, keep, enabled)
           .selectExpr(*keep, f"{_spans_sql('__full', '__text', False)} AS __full_0",
                       f"{_spans_sql('__full', '__text', True)} AS __full_1", f"{_spans_sql('__part', '__text', False)} AS __part")
           .selectExpr(*keep, *by_setting).selectExpr(*keep, *survivors).selectExpr(*keep, f"{placed} AS __placed")
           .selectExpr(*keep, f"transform(__placed, s -> named_struct({fields}, 'flags', {mask})) AS __spans"))
    return (out.selectExpr(*keep, "explode(filter(array(named_struct('spans', __spans)), q -> size(q.spans) > 0)) AS q")
            .selectExpr(*keep, "q.spans AS spans"))


@lru_cache(maxsize=None)
def _parse_sql(text: str, pattern: str, day_first: bool, month_names: bool, pattern_column: bool) -> str:
    patterns = enabled_patterns(day_first, month_names)
    if pattern and not pattern_column:
        patterns = sorted(patterns, key=lambda ip: ip[1].name != pattern)
    spans = _spans_sql(_hits_sql(patterns, whole=True), "t0", day_first)
    first, label = "get(spans, 0)", "get(spans, 0).pattern"
    if pattern_column:
        first = f"coalesce(get(filter(spans, s -> s.pattern = {pattern}), 0), get(spans, 0))"
        label = f"coalesce(nullif({pattern}, ''), get(spans, 0).pattern)"
    elif pattern:
        label = f"'{pattern}'"
    # one-element transforms name the intermediate values
    return (f"CASE WHEN {text} rlike '[0-9OoIil|]' THEN get(filter("
            f"transform(transform(transform(transform(array({trim_sql(text)}), r0 -> {corrected_sql('r0')}), "
            f"t0 -> named_struct('t0', t0, 't', {blanked_sql('t0')})), "
            f"w -> named_struct('t0', w.t0, 'spans', {spans.replace('regexp_replace(t,', 'regexp_replace(w.t,').replace('substring(t0,', 'substring(w.t0,')})), "
            f"w -> named_struct('s', {first.replace('spans', 'w.spans')}, 'label', {label.replace('spans', 'w.spans')}, 't0', w.t0)), "
            "w -> w.s IS NOT NULL), 0) END")


def parse_date_text(text: str, pattern: str = "", day_first: bool = False, month_names: bool = False,
                    pattern_column: bool = False) -> Column:
    """Parse an isolated date string, given as a column name or SQL expression.

    Returns struct<raw_text, year, month, day, calendar_valid, pattern>, null when no shape fits.
    A requested pattern (a name, or with ``pattern_column`` the column holding it) is tried first,
    and its name is kept even when another shape matched.
    """
    p = F.expr(_parse_sql(text, pattern, day_first, month_names, pattern_column))
    return F.when(p.isNotNull(), F.struct(
        p.t0.alias("raw_text"), p.s.year.alias("year"), p.s.month.alias("month"), p.s.day.alias("day"),
        p.s.valid.alias("calendar_valid"), p.label.alias("pattern")))


def parsed_texts(texts: DataFrame, text: str = "text", day_first: bool = False, month_names: bool = False) -> DataFrame:
    """(text, p) for each different value of the column that can be read as a date, ``p`` as in ``parse_date_text``.

    The grammar runs once for each text; rows get their reading by a join, as texts repeat.
    """
    known = texts.select(text).filter(F.col(text).rlike("[0-9OoIil|]")).distinct()
    read = known.select(text, F.explode(F.array(parse_date_text(text, "", day_first, month_names))).alias("p"))
    return read.filter("p IS NOT NULL")


# Fixed value: the label vocabulary, including the two older spellings of a missing part.
LABEL_SHAPE = r"(?i)\A(\d{4}|NONE)-(\d{2})-(\d{2}|None)\z"


@lru_cache(maxsize=None)
def final_date_sql(text: str) -> str:
    """SQL of parse_final_date; strict labels take one cheap regex and no trim, only other texts the grammar."""
    t = trim_sql(f"coalesce({text}, '')")
    loose = _parse_sql(text, "", False, False, False)
    strict = lambda x: (f"WHEN {x} rlike {_str(LABEL_SHAPE)} THEN named_struct("  # noqa: E731
                        f"'year', CASE WHEN upper(substring({x}, 1, 4)) <> 'NONE' THEN substring({x}, 1, 4) END, "
                        f"'month', substring({x}, 6, 2), "
                        f"'day', CASE WHEN lower(substring({x}, 9, 4)) <> 'none' THEN substring({x}, 9, 2) END) ")
    return (f"CASE {strict(text)}"
            f"WHEN {t} = '' OR upper({t}) = 'NONE' THEN NULL "
            f"{strict(t)}"
            f"ELSE get(transform(filter(array({loose}), p -> p.s.valid), "
            "p -> named_struct('year', p.s.year, 'month', p.s.month, 'day', p.s.day)), 0) END")


def parse_final_date(text: str) -> Column:
    """Label or prediction text to struct<year, month, day>; null for NONE and unreadable text."""
    return F.expr(final_date_sql(text))


def candidate_key(year: Column, month: Column, day: Column, valid: Column) -> Column:
    return F.when(valid & month.isNotNull(), F.struct(
        year.alias("year"), zfill(month, 2).alias("month"), zfill(day, 2).alias("day")))


def candidate_final_date(year: Column, month: Column, day: Column, valid: Column,
                         year_missing: str = "NoNE", day_missing: str = "None") -> Column:
    return F.when(valid & month.isNotNull(), F.concat_ws(
        "-", F.coalesce(year, F.lit(year_missing)), zfill(month, 2),
        F.coalesce(zfill(day, 2), F.lit(day_missing))))


def prediction_matches(predicted: str, target: str) -> Column:
    """Equal strings or equal parsed dates; two unreadable values are equal as well."""
    return F.expr(f"coalesce({predicted} = {target}, false) OR "
                  f"({final_date_sql(predicted)}) <=> ({final_date_sql(target)})")


def prediction_matches_readable(predicted: str, target: str) -> Column:
    """Equal strings, or equal parsed dates where the target can be read."""
    return F.expr(f"coalesce({predicted} = {target}, false) OR coalesce("
                  f"({final_date_sql(predicted)}) = ({final_date_sql(target)}), false)")


# --- looser readers used by the recogniser reports -----------------------------------------------

def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, zfill(month.cast("int").cast("string"), 2),
                       zfill(day.cast("int").cast("string"), 2))


# The loose shapes.
_OPT_YMD4 = r"(?<!\d)(\d{4})[^\d]?(\d{1,2})[^\d]?(\d{1,2})(?!\d)"
_OPT_DMY4 = r"(?<!\d)(\d{1,2})[^\d]?(\d{1,2})[^\d]?(\d{4})(?!\d)"
_OPT_YMD2 = r"(?<!\d)(\d{2})[^\d]?(\d{1,2})[^\d]?(\d{1,2})(?!\d)"
_SIMPLE_YMD4 = r"(\d{4})[^\d]?(\d{1,2})[^\d]?(\d{1,2})"
_SIMPLE_YMD2 = r"(\d{2})[^\d]?(\d{1,2})[^\d]?(\d{1,2})"
_Y_MONTH_D = r"(?i)(?<!\d)(\d{4})[^A-Za-z0-9]*([\p{L}\p{N}_]+)[^A-Za-z0-9]*(\d{1,2})(?!\d)"
_D_MONTH_Y = rf"(?i)(?<!\d)(\d{{1,2}})[^A-Za-z0-9]*({_MONTHS})[^A-Za-z0-9]*(\d{{4}})(?!\d)"
_KOREAN_YMD = r"(?<!\d)(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일?"


def _all_readings(text: Column, regex: str, y: int, m: int, d: int, century: str = "") -> Column:
    spans = F.transform(F.split(F.regexp_replace(
        text, F.lit(regex), F.lit(f"{MARK}${y}{SEP_CH}${m}{SEP_CH}${d}{MARK}")), MARK, -1),
        lambda s, i: F.when(i % 2 == 1, F.split(s, SEP_CH, -1)))
    return F.transform(F.filter(spans, lambda s: s.isNotNull()), lambda s: F.struct(
        F.concat(F.lit(century), F.get(s, F.lit(0))).alias("y"),
        F.get(s, F.lit(1)).alias("m"), F.get(s, F.lit(2)).alias("d")))


def normalized_options(c: Column) -> Column:
    """All y-m-d, d-m-y and two-digit-year readings of a text, without a calendar check."""
    t = F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(""))
    readings = F.concat(_all_readings(t, _OPT_YMD4, 1, 2, 3), _all_readings(t, _OPT_DMY4, 3, 2, 1),
                        _all_readings(t, _OPT_YMD2, 1, 2, 3, "20"))
    return F.array_distinct(F.transform(readings, lambda r: _iso(r.y, r.m, r.d)))


def normalize_simple(c: Column) -> Column:
    """First four-digit-year reading, else first two-digit-year reading, unchecked."""
    t = F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(""))

    def reading(regex: str, century: str) -> Column:
        g = [F.regexp_extract(t, regex, i) for i in (1, 2, 3)]
        return F.when(t.rlike(regex), _iso(F.concat(F.lit(century), g[0]), g[1], g[2]))
    return F.coalesce(reading(_SIMPLE_YMD4, ""), reading(_SIMPLE_YMD2, "20"))


def normalize_validated(c: Column) -> Column:
    """First reading, over five shapes in order, that is a real date."""
    t = F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(""))

    def month_number(name: Column) -> Column:
        key = F.lower(F.substring(name, 1, 3))
        pos = F.instr(F.lit(MONTH_ABBREVIATIONS), key)
        return F.when((F.length(key) == 3) & (pos % 3 == 1), ((pos + 2) / 3).cast("int").cast("string"))

    def first_named(regex: str, y: int, m: int, d: int) -> Column:
        named = F.transform(_all_readings(t, regex, y, m, d), lambda r: F.struct(
            r.y.alias("y"), month_number(r.m).alias("m"), r.d.alias("d")))
        ok = F.filter(named, lambda r: r.m.isNotNull() & calendar_valid(r.y, r.m, r.d))
        r = F.get(ok, F.lit(0))
        return F.when(r.isNotNull(), _iso(r.y, r.m, r.d))

    def first_match(regex: str, century: str = "") -> Column:
        y, m, d = (F.regexp_extract(t, regex, i) for i in (1, 2, 3))
        y = F.concat(F.lit(century), y)
        return F.when(t.rlike(regex) & calendar_valid(y, m, d), _iso(y, m, d))

    return F.coalesce(first_named(_Y_MONTH_D, 1, 2, 3), first_named(_D_MONTH_Y, 3, 2, 1),
                      first_match(_KOREAN_YMD), first_match(_SIMPLE_YMD4), first_match(_SIMPLE_YMD2, "20"))
