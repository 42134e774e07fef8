"""Case and accent folding as plain column expressions (JVM side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: accent folding map ------------------------------------
# One-to-one characters (position i of FOLD_FROM maps to position i of FOLD_TO).
FOLD_FROM = ("ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
             "ĀāĂăĄąĆćĈĉĊċČčĎďĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĨĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľ"
             "ŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽž"
             "ØøĐđŁłĦħıŦŧ")
FOLD_TO = ("AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
           "AaAaAaCcCcCcCcDdEeEeEeEeEeGgGgGgGgHhIiIiIiIiIJjKkLlLlLl"
           "NnNnNnOoOoOoRrRrRrSsSsSsSsTtTtUuUuUuUuUuUuWwYyYZzZzZz"
           "OoDdLlHhiTt")
# Characters that expand to two letters, applied in this order after the map.
FOLD_EXPAND = [("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe")]
# --------------------------------------------------------------------------

assert len(FOLD_FROM) == len(FOLD_TO)


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Strip accents, keep case (the ``unaccent`` of the reference)."""
    out = F.translate(col_(c), FOLD_FROM, FOLD_TO)
    for src, dst in FOLD_EXPAND:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


def name_key(c: Column | str) -> Column:
    """Case-insensitive comparison key (stands in for CITEXT equality)."""
    return F.lower(col_(c))


def like_literal(c: Column | str) -> Column:
    """Escape ``\\ % _`` so a user string matches only itself under LIKE."""
    x = col_(c)
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    x = F.replace(x, F.lit("%"), F.lit("\\%"))
    return F.replace(x, F.lit("_"), F.lit("\\_"))


def fold_sql(expr: str) -> str:
    """The same fold as a SQL expression string (for DuckDB oracle SQL)."""
    out = f"translate({expr}, '{FOLD_FROM}', '{FOLD_TO}')"
    for src, dst in FOLD_EXPAND:
        out = f"replace({out}, '{src}', '{dst}')"
    return out
