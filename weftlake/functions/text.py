"""Text functions, all Column to Column with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[ \t\n\f\r]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_WS}+|{_WS}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return trimmed(F.regexp_replace(c, rf"{_WS}+", " "))


def clean_metadata(c: Column) -> Column:
    """Runs of spaces first, then each newline and tab becomes a space, so double spaces may stay."""
    return trimmed(F.regexp_replace(F.regexp_replace(c, " +", " "), r"[\n\t]", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>?|>", "")


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def decode_entities(c: Column) -> Column:
    """Eight character references; &amp; comes last, so nothing is decoded twice."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def ended_references(c: Column) -> Column:
    """HTML in which an ampersand that begins no reference with a semicolon is written as &amp;, so that a parser leaves it as it stands."""
    return F.regexp_replace(c, "&(?!#?[A-Za-z0-9]+;)", "&amp;")


def byte_prefix(c: Column, n: int) -> Column:
    """The longest prefix of at most n bytes that ends between characters."""
    raw = F.substring(F.encode(c, "UTF-8"), 1, n)
    return F.when(F.octet_length(c) <= n, c).otherwise(F.left(c, F.length(F.regexp_replace(F.decode(raw, "ISO-8859-1"), r"[\x80-\xBF]", "")) - F.when(F.octet_length(F.left(c, F.length(F.regexp_replace(F.decode(raw, "ISO-8859-1"), r"[\x80-\xBF]", "")))) > n, 1).otherwise(0)))


def truncate_at_word(c: Column, n: int) -> Column:
    """At most n bytes, cut back to the last space if that is past the middle, and an ellipsis."""
    cut = byte_prefix(c, n)
    upto = F.regexp_extract(cut, r"(?s)^(.*) ", 1)
    kept = F.when(F.contains(cut, F.lit(" ")) & (F.octet_length(upto) > n // 2), upto).otherwise(cut)
    return F.when(F.octet_length(c) <= n, c).otherwise(F.concat(kept, F.lit("...")))


def truncate(c: Column, n: int) -> Column:
    """At most n characters, the last three of them an ellipsis."""
    return F.when(F.length(c) <= n, c).otherwise(F.left(c, F.lit(n)) if n <= 3 else F.concat(F.left(c, F.lit(n - 3)), F.lit("...")))


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, r"\x1b[^A-Za-z]*[A-Za-z]", "")


def indent(c: Column, n: int) -> Column:
    """Spaces before every non-empty line."""
    return F.regexp_replace(c, r"(?m)^(?=.)", " " * n)


def rule(width: int, char: str = "─") -> Column:
    return F.repeat(F.lit(char), F.lit(width))


def title_case(c: Column) -> Column:
    """The first letter of each word is upper case, the others stay as they are."""
    parts = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_']+|[^\p{L}\p{N}_']+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1_000_000))), "")


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def is_numbered(c: Column) -> Column:
    t = trimmed(c)
    return (F.octet_length(t) >= 3) & t.rlike(r"^[0-9]+\. ")


def contains_latex(c: Column) -> Column:
    return c.rlike(r"\\\[|\\\]|\$\$|\\\(|\\\)|(?<!\\)\$")


def occurrences(c: Column, needle: str) -> Column:
    """How often needle stands in the text, case-insensitive and not overlapping."""
    low = F.lower(c)
    return ((F.length(low) - F.length(F.replace(low, F.lit(needle.lower()), F.lit("")))) / len(needle)).cast("long") if needle else F.lit(0).cast("long")


def ascii_words(c: Column, least: int) -> Column:
    """Runs of ASCII letters of at least that many, lower-cased; other letters split words."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1)), lambda w: F.length(w) >= least)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def reading_time(words: Column) -> Column:
    minutes = F.floor(words / 200)
    return F.when(minutes < 1, "< 1 min read").otherwise(F.concat(minutes.cast("string"), F.lit(" min read")))


def format_count(n: Column) -> Column:
    """Thousands with k, millions with M, to one decimal. Rounding is that of the binary value, ties to even: its bits
    are scaled to an integer and compared with the midpoint exactly. Counts up to 10**12."""

    def scaled(unit: int) -> Column:
        tenth = unit // 10
        q, r = F.floor(n / tenth), F.pmod(n, F.lit(tenth))
        value = n.cast("double") / unit
        power = F.when(value < 1024, F.lit(2.0**52)).otherwise(F.lit(2.0**42))
        bits, middle = (value * power).cast("long").cast("decimal(38,0)") * 20, power.cast("long").cast("decimal(38,0)") * (q * 2 + 1)
        up = (r * 2 > tenth) | ((r * 2 == tenth) & ((bits > middle) | ((bits == middle) & (F.pmod(q, F.lit(2)) == 1))))
        t = q + F.when(up, 1).otherwise(0)
        return F.concat(F.floor(t / 10).cast("string"), F.lit("."), F.pmod(t, F.lit(10)).cast("string"))

    return F.when(n >= 1_000_000, F.concat(scaled(1_000_000), F.lit("M"))).when(n >= 1000, F.concat(scaled(1000), F.lit("k"))).otherwise(n.cast("string"))


def guid_of(c: Column) -> Column:
    """The first eight bytes of SHA-256, in hex; '' stays ''."""
    return F.when(c == "", "").otherwise(F.left(F.sha2(c, 256), F.lit(16)))


def is_blank(c: Column) -> Column:
    return trimmed(c) == ""


def is_box_line(c: Column) -> Column:
    """Mostly box-drawing characters, at least three bytes."""
    t = trimmed(c)
    drawn = F.length(F.regexp_replace(t, "[^─│┌┐└┘├┤┬┴┼═║╔╗╚╝╠╣╦╩╬]", ""))
    return (F.octet_length(t) >= 3) & (drawn * 2 > F.length(t))


def is_rule_line(c: Column) -> Column:
    """At least three bytes, mostly one of the rule characters."""
    t = trimmed(c)
    head = F.left(t, F.lit(1))
    same = F.length(t) - F.length(F.replace(t, head, F.lit("")))
    return (F.octet_length(t) >= 3) & head.isin("═", "─", "━", "-", "=") & (same * 10 > F.length(t) * 8)
