"""Colours and dates, all Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named colours, and date layouts in the order in which they are tried.
NAMED = {
    "white": "#ffffff", "black": "#000000", "red": "#ff0000", "green": "#00ff00", "blue": "#0000ff", "yellow": "#ffff00", "orange": "#ffa500", "purple": "#800080", "gray": "#808080",
    "grey": "#808080", "silver": "#c0c0c0", "maroon": "#800000", "navy": "#000080", "teal": "#008080", "aqua": "#00ffff", "fuchsia": "#ff00ff", "lime": "#00ff00", "olive": "#808000",
}
LAYOUTS = ["dd MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def normal_colour(c: Column) -> Column:
    """#rrggbb of a hex or named colour; '' if it is neither."""
    t = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    long = F.regexp_replace(t, r"^#(.)(.)(.)$", "#$1$1$2$2$3$3")
    return F.when(F.startswith(t, F.lit("#")), F.when(F.length(t).isin(4, 7), long).otherwise("")).otherwise(F.coalesce(F.try_element_at(names, t), F.lit("")))


def rgb(c: Column) -> Column:
    """struct(r, g, b, ok) of three or six hex digits, with or without #."""
    bare = F.regexp_replace(c, "^#", "")
    six = F.when(F.length(bare) == 3, F.regexp_replace(bare, "^(.)(.)(.)$", "$1$1$2$2$3$3")).otherwise(bare)
    ok = six.rlike("^[0-9a-fA-F]{6}$")
    part = lambda at: F.when(ok, F.conv(F.substring(six, at, 2), 16, 10).cast("smallint")).otherwise(F.lit(0).cast("smallint"))
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), F.coalesce(ok, F.lit(False)).alias("ok"))


def usable_accent(c: Column) -> Column:
    """Neither nearly black nor nearly white."""
    v = rgb(c)
    return v["ok"] & F.floor((v["r"].cast("int") + v["g"].cast("int") + v["b"].cast("int")) / 3).between(15, 240)


def feed_date(c: Column) -> Column:
    """The time that a feed's date means, by the first layout that fits; null if none does. A weekday is not checked, a zone name counts as UTC."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"^[A-Za-z]{3}, ", ""), r" [A-Z]{3,4}$", " +0000")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in LAYOUTS])


def short_date(c: Column) -> Column:
    """'Jan 2, 2006' of an ISO date at the text's start; other texts stay."""
    months = F.array(*[F.lit(m) for m in MONTHS])
    head = F.left(c, F.lit(10))
    fits = head.rlike("^[^-]{4}-(0[1-9]|1[0-2])-[^-]{2}$")
    month = F.when(fits, F.element_at(months, F.substring(head, 6, 2).try_cast("int")))
    return F.when(fits, F.concat(month, F.lit(" "), F.regexp_replace(F.substring(head, 9, 2), "^0", ""), F.lit(", "), F.left(head, F.lit(4)))).otherwise(c)


def relative_time(then: Column, now: Column) -> Column:
    """How long ago, in words up to a day, else month and day. One unit is written as a plural too ("1 hours ago"): that form is part of the format."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 60)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, ago(minutes, "minutes")).when(minutes < 1440, ago(F.floor(minutes / 60), "hours")).otherwise(F.date_format(then, "MMM d"))


def item_date(published: Column, author: Column) -> Column:
    day = F.coalesce(F.date_format(published, "MMM d, yyyy"), F.lit(""))
    return F.concat_ws(" · ", F.nullif(day, F.lit("")), F.nullif(author, F.lit("")))
