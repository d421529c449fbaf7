"""Names, spellings and formats of texts as columns: Unicode folding, slugs, cases, numbers, dates and the tone of a label."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _class(points: list[int]) -> str:
    """Code points as a character class of Java's regular expressions. Its ranges are halved again and again behind their bounds, so a letter is held against the logarithm of
    their number and not against all of them."""
    runs: list[list[int]] = []
    for p in points:
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])

    def tree(runs: list[list[int]]) -> str:
        if len(runs) <= 2:
            return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]"
        half = len(runs) // 2
        return rf"[\x{{{runs[0][0]:x}}}-\x{{{runs[-1][1]:x}}}&&[{tree(runs[:half])}{tree(runs[half:])}]]"

    return tree(runs)


@cache
def _folds() -> tuple[str, str, dict[str, str], str]:
    """From Unicode's compatibility decompositions without combining marks: letters that fold to one character and those characters, letters that fold to several with
    what they fold to, and the combining marks as a character class."""
    one_from, one_to, many, marks = [], [], {}, []
    for p in range(0x80, sys.maxunicode + 1):
        c = chr(p)
        if 0xD800 <= p <= 0xDFFF:
            continue
        if unicodedata.combining(c):
            marks.append(p)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain == c or 0xAC00 <= p <= 0xD7A3:  # syllables of Hangul fold to letters that no name is compared by
            continue
        if len(plain) == 1:
            one_from.append(c)
            one_to.append(plain)
        else:
            many[c] = plain
    return "".join(one_from), "".join(one_to), many, _class(marks)


@cache
def _pieces() -> tuple[str, str]:
    """Letters that fold to several as a character class, and a pattern of the pieces of a text: one such letter, or all up to the next."""
    many = set(map(ord, _folds()[2]))
    return _class(sorted(many)), f"{_class(sorted(many))}|{_class([p for p in range(sys.maxunicode + 1) if p not in many])}+"


def plain(c: Column) -> Column:
    """Compatibility decomposition without combining marks: é to e, ﬁ to fi, ² to 2, ½ to 1⁄2. Syllables of Hangul stay as they are. Single letters are translated
    all at once; texts with letters that fold to several are cut at these. Texts of ASCII alone are left as they are."""
    one_from, one_to, many, marks = _folds()
    seldom, pieces = _pieces()
    folds = F.translate(F.regexp_replace(c, marks, ""), one_from, one_to)
    # a table of some thousand letters is searched only for pieces of one letter
    table = F.from_json(F.lit(_as_json(many)), "map<string,string>")
    parts = F.transform(F.regexp_extract_all(folds, F.lit(pieces), F.lit(0)), lambda x: F.when(F.length(x) == 1, F.coalesce(F.try_element_at(table, x), x)).otherwise(x))
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.when(folds.rlike(seldom), F.array_join(parts, "")).otherwise(folds))


def _as_json(m: dict[str, str]) -> str:
    import json

    return json.dumps(m, ensure_ascii=False)


def folded(c: Column) -> Column:
    """A name as it is compared: plain lower-case letters and digits, `&` as and, bounds such as `under 24`, `<24` and `less than 24` as lt24, everything else one space."""
    c = F.replace(F.lower(plain(c)), F.lit("&"), F.lit(" and "))
    for pattern, to in (("[®™©]", ""), (r"(?:under|less\s+than|below)\s*(\d)", "lt$1"), (r"[<≤]\s*(\d)", "lt$1"), (r"(?:over|greater\s+than|above)\s*(\d)", "gt$1"), (r"[>≥]\s*(\d)", "gt$1"), ("[^a-z0-9]+", " ")):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def squashed(c: Column) -> Column:
    """A folded name without its spaces."""
    return F.replace(folded(c), F.lit(" "), F.lit(""))


def slug(c: Column) -> Column:
    """Lower case, `&` as and, everything but letters and digits as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def camel_to_snake(c: Column) -> Column:
    """dailyDosage to daily_dosage."""
    return snake(F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])", "_"))


def snake(c: Column) -> Column:
    """Lower case, runs of underscores as one, none at the ends; words in mixed case are not split."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, "__+", "_")), "^_+|_+$", "")


def title_case(c: Column) -> Column:
    """months_old and MonthsOld to Months Old: only first letters are raised."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " "), r"\s+", " "))
    # a word also begins behind a sign
    parts = F.regexp_extract_all(words, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def number_text(x: Column, decimals: Column | int | None = None) -> Column:
    """A number with thousands separated and its decimals: as many as given, else none for whole numbers, 1 from 100 on, 2 from 1 on, 3 below. A dash stands for what is
    not finite; null stays null."""
    x = x.cast("double")
    size = F.abs(x)
    places = F.when(x == F.floor(x), 0).when(size >= 100, 1).when(size >= 1, 2).otherwise(3)
    if decimals is not None:
        places = F.coalesce(decimals if isinstance(decimals, Column) else F.lit(decimals), places)
    out = F.lit("—")
    for n in range(9):
        # halves are rounded away from zero on the decimal that a number prints as
        shown = F.format_number(F.round(x.cast("decimal(38,12)"), n), n)
        out = F.when(F.isnan(x) | (size == float("inf")), F.lit("—")).when(places == n, shown).otherwise(out)
    return F.when(x.isNotNull(), out)


def date_text(ms: Column) -> Column:
    """Epoch milliseconds as a day, such as Sep 1, 2026, in UTC; a dash where it is not finite."""
    ok = ~F.isnan(ms.cast("double")) & (F.abs(ms) <= 8.64e15)
    days = F.floor(F.when(ok, ms) / 86_400_000).cast("int")
    day = F.date_add(F.lit("1970-01-01").cast("date"), days)
    return F.when(ms.isNotNull(), F.when(ok, F.date_format(day, "MMM d, yyyy")).otherwise("—"))


def range_text(low: Column, high: Column) -> Column:
    """A band's bounds: one number, low–high, ≥ low, ≤ high, or nothing."""
    say = lambda x: F.regexp_replace(x.cast("double").cast("string"), r"\.0$", "")
    both = F.when(low == high, say(low)).otherwise(F.concat(say(low), F.lit("–"), say(high)))
    return F.when(low.isNotNull() & high.isNotNull(), both).when(low.isNotNull(), F.concat(F.lit("≥ "), say(low))).when(high.isNotNull(), F.concat(F.lit("≤ "), say(high))).otherwise("")


#: Words that tell a label's tone, the gravest first.
TONES = {
    "bad": "high|severe|critical|very high|obese|profound|urgent|administer|likely|class c",
    "caution": "intermediate|moderate|borderline|possible|caution|elevated|overweight|class b",
    "good": "low|normal|none|not required|no stunting|no wasting|mild|minimal|negative|unlikely|class a",
}


def tone(label: Column) -> Column:
    """bad, caution, good or neutral, by the words of a label."""
    out = F.lit("neutral")
    for name, words in reversed(TONES.items()):
        out = F.when(F.coalesce(label, F.lit("")).rlike(rf"(?i)\b(?:{words})\b"), F.lit(name)).otherwise(out)
    return out
