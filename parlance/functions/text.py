"""Text, date, number and label functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters that are folded to ASCII, and what they become.
FOLD_FROM, FOLD_TO = "çğıöşüâîû’“”–— ", "cgiosuaiu'\"\"-- "
# Upper-case letters of name keys, and what they become.
NAME_FROM, NAME_TO = "ÇĞİÖŞÜÂÎÛI", "CGIOSUAIUI"
# Month names after folding.
MONTHS = ["ocak", "subat", "mart", "nisan", "mayis", "haziran", "temmuz", "agustos", "eylul", "ekim", "kasim", "aralik"]
# Speech prefixes that aren't part of a name.
NAME_PREFIXES = [".*?grubu adina", ".*?şahsi adina", ".*?sahsi adina", "hukumet adina", "komisyon adina", "sözcüsü", "sozcusu"]


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode compatibility form; Spark has none built in, so texts beyond ASCII take an Arrow function."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)


def fold(text: Column) -> Column:
    lower = F.replace(F.lower(text), F.lit("i̇"), F.lit("i"))
    return F.translate(lower, FOLD_FROM, FOLD_TO)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_text(text: Column) -> Column:
    """NFKC, lower case, Turkish letters and typographic signs folded, only word characters, spaces, - and . left."""
    return squeeze(F.regexp_replace(fold(nfkc(text)), r"(?U)[^\w\s\-.]", " "))


def normalize_light(text: Column) -> Column:
    return F.translate(F.replace(F.lower(text), F.lit("i̇"), F.lit("i")), "âîû", "aiu")


def normalize_name_key(text: Column) -> Column:
    t = F.lower(F.translate(F.translate(F.upper(F.coalesce(text, F.lit(""))), NAME_FROM, NAME_TO), ".,'", "   "))
    t = F.replace(F.replace(t, F.lit("cuneyit"), F.lit("cuneyt")), F.lit("feramuz"), F.lit("feramus"))
    for old, new in ((r"(?U)\bmemet\b", "mehmet"), (r"(?U)\bmehmed\b", "mehmet"), (r"(?U)\batila\b", "atilla"), *((p, "") for p in NAME_PREFIXES)):
        t = F.regexp_replace(t, old, new)
    return squeeze(t)


def slug_event(text: Column) -> Column:
    """Folded, with every space, slash and dash an underscore of its own."""
    return F.translate(F.lower(F.translate(text, "ıİşŞğĞüÜöÖçÇ", "iissgguuoocc")), " /-", "___")


def slug_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_text(text), "[^a-z0-9]+", "_"), "_+", "_"), F.lit("_"))


def slug_series(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold(nfkc(text)), "[^a-z0-9]+", "_"), F.lit("_"))


def count_words(normal: Column) -> Column:
    return F.regexp_count(normal, F.lit("[a-z]+"))


def tokens(text: Column, least: int = 2, stop: list[str] | None = None) -> Column:
    """Words of the Turkish alphabet with at least ``least`` letters, repetitions kept, without stopwords."""
    found = F.regexp_extract_all(normalize_light(text), F.lit(f"[a-zçğıöşüâîû]{{{least},}}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(stop)) if stop else found


def pattern_hits(text: Column, patterns: list[str]) -> Column:
    """Matches summed over the patterns, each counted alone: one word may count several times."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(text, F.lit(p))
    return total


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, wherever the body uses it, lambdas included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column, block: int = 128) -> Column:
    """Running sums of an array of integers, in blocks: a single pass would copy its result at each element."""
    number = lambda x: x.cast("bigint")
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    def sums(a: Column, start: Column) -> Column:
        zero = F.struct(start.alias("s"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(a, zero, lambda acc, x: F.struct((acc.s + x).alias("s"), F.concat(acc.a, F.array(acc.s + x)).alias("a")), lambda acc: acc.a)

    def joined(blocks: Column) -> Column:
        ends = sums(F.transform(blocks, total), F.lit(0).cast("bigint"))
        return F.flatten(F.zip_with(blocks, ends, lambda a, end: sums(a, end - total(a))))

    firsts = lambda a: F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(block))
    cut = lambda a: F.transform(firsts(a), lambda i: F.slice(a, i, F.lit(block)))
    return let(F.transform(numbers, number), lambda a: let(cut(a), joined))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, match) of non-overlapping matches, starts in characters from 0; linear in the matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(hits: Column) -> Column:
        before = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        ends = running_sums(F.zip_with(before, hits, lambda x, m: F.length(x) + F.length(m)))
        return F.zip_with(hits, ends, lambda m, end: F.struct((end - F.length(m)).cast("int").alias("start"), m.alias("match")))

    return let(found, placed)


#: Characters of a block of a text in which windows are looked up.
BLOCK = 1024


def windows(text: Column, pattern: str, radius: int) -> Column:
    """The text around every match, cut at both ends of the text; overlapping windows all stay.

    A window is taken from the two blocks of the text that hold it, so a match far behind in a long text
    costs no more than one at its start; a match longer than a block is taken from the text itself.
    """

    def around(t: Column, blocks: Column):
        def window(m: Column) -> Column:
            first, n = F.greatest(m.start - radius, F.lit(0)), F.least(m.start, F.lit(radius)) + F.length(m.match) + radius
            at = F.floor(first / BLOCK).cast("int")
            both = F.concat(F.get(blocks, at), F.coalesce(F.get(blocks, at + 1), F.lit("")))
            return F.when(n <= BLOCK, F.substring(both, (first % BLOCK + 1).cast("int"), n)).otherwise(F.substring(t, first + 1, n))

        return window

    cut = lambda t: F.transform(F.sequence(F.lit(0), F.floor(F.length(t) / BLOCK).cast("int")), lambda k: F.substring(t, k * BLOCK + 1, F.lit(BLOCK)))
    none = F.array().cast("array<string>")
    found = lambda t: lambda hits: F.when(F.size(hits) == 0, none).otherwise(let(cut(t), lambda blocks: F.transform(hits, around(t, blocks))))
    return let(text, lambda t: let(matches(t, pattern), found(t)))


def parse_local_date(raw: Column) -> Column:
    """M.YYYY, D.M.YYYY, D<month name>YYYY or <month name>YYYY (first day); anything else is null."""
    text = F.replace(normalize_text(F.regexp_replace(F.replace(raw, F.lit(" "), F.lit(" ")), r"\s+", "")), F.lit(" "), F.lit(""))
    compact = F.replace(text, F.lit("."), F.lit(""))
    number = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, str(i + 1))])
    part = lambda t, p, g: F.nullif(F.regexp_extract(t, p, g), F.lit(""))
    date = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m, d), "y-M-d")
    named = lambda g, p: number[part(compact, p, g)]
    month_year, day = r"^(\d{1,2})\.(\d{4})$", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
    day_name, name = r"^(\d{1,2})([a-z]+)(\d{4})$", r"^([a-z]+)(\d{4})$"
    return F.coalesce(
        F.when(text.rlike(month_year), date(part(text, month_year, 2), part(text, month_year, 1), F.lit("1"))),
        F.when(text.rlike(day), date(part(text, day, 3), part(text, day, 2), part(text, day, 1))),
        F.when(compact.rlike(day_name) & named(2, day_name).isNotNull(), date(part(compact, day_name, 3), named(2, day_name), part(compact, day_name, 1))),
        F.when(compact.rlike(name) & named(1, name).isNotNull(), date(part(compact, name, 2), named(1, name), F.lit("1"))),
    )


def parse_date_mixed(raw: Column) -> Column:
    """dd-mm-yyyy, yyyy-mm (first day), yyyy-mm-dd, else day first."""
    t = F.trim(raw)
    return F.coalesce(
        F.when(t.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.try_to_date(t, "dd-MM-yyyy")),
        F.when(t.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(t, F.lit("-01")), "yyyy-MM-dd")),
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")),
        F.when(t.rlike(r"^\d{1,2}[./]\d{1,2}[./]\d{4}$"), F.try_to_date(F.translate(t, "./", "--"), "d-M-yyyy")),
    )


def to_number(raw: Column) -> Column:
    """Decimal comma; null when it is no number."""
    return F.replace(raw, F.lit(","), F.lit(".")).try_cast("double")


def to_count(raw: Column) -> Column:
    """Thousands dots removed."""
    return F.replace(raw, F.lit("."), F.lit("")).try_cast("bigint")


def to_rate(raw: Column) -> Column:
    """Rates above 1000 are given in millionths."""
    x = to_number(raw)
    return F.when(x > 1000, x / 1_000_000).otherwise(x)


def month_diff(a: Column, b: Column) -> Column:
    return (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)


def safe_divide(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def recode(value: Column, table: dict[str, str]) -> Column:
    """Dictionary recode; what isn't in the table stays."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[value], value)


def first_match(text: Column, table: list[tuple[str, str]]) -> Column:
    """The value of the first key that the upper-cased text contains; null when none."""
    out = F.lit(None).cast("string")
    for key, value in reversed(table):
        out = F.when(F.contains(F.upper(text), F.lit(key)), value).otherwise(out)
    return out


def clean_cell(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, r"\[\d+\]", ""))


def range_label(value: Column, ranges: list[tuple[int, int, str]], none: str = "Bilinmiyor", bad: str = "Hata") -> Column:
    """Label of the inclusive range that holds an integer."""
    x = value.try_cast("bigint")
    out = F.lit(none)
    for lo, hi, name in reversed(ranges):
        out = F.when(x.between(lo, hi), name).otherwise(out)
    return F.when(x.isNull(), bad).otherwise(out)


def speaker_confidence(line: Column) -> Column:
    """Share of upper-case letters, 0 with fewer than three letters."""
    letters, small = F.regexp_count(line, F.lit(r"\p{L}")), F.regexp_count(line, F.lit(r"\p{Ll}"))
    return F.when(letters < 3, 0.0).otherwise((letters - small) / F.nullif(letters, F.lit(0)))


def fuzzy_name(a: Column, b: Column) -> Column:
    """At least two words in common and one name's words all in the other."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    both = F.size(F.array_intersect(x, y))
    return (both >= 2) & ((both == F.size(x)) | (both == F.size(y)))
