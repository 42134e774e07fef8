"""Name search, input normalisation and the brand A-Z index.

Matching is accent- and case-insensitive substring search with the user's
``%`` and ``_`` live as wildcards: ``fold(name) ILIKE '%' || fold(q) || '%'``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import positions, top_k
from ..functions.text import fold, like_literal
from ..model import INDEX_LETTERS, SEARCH_RESULTS_PER_KIND, Catalog
from ..plans.materialize import materialize
from ..sources.tables import read_parquet_if_present

def normalize_queries(queries: DataFrame, min_chars: int = 1) -> DataFrame:
    """Trim surrounding white space; drop inputs shorter than ``min_chars``."""
    q = F.regexp_replace(F.col("q"), r"^\s+|\s+$", "")
    return (queries.select("query_id", q.alias("q"))
            .filter(F.length("q") >= F.lit(min_chars)))


def searchable_names(catalog: Catalog) -> DataFrame:
    """(kind, name, name_id, fname) over tags, brands and base items."""
    return (catalog.tag.select(F.lit("tags").alias("kind"), "name", F.col("tag_id").cast("long").alias("name_id"))
            .unionByName(catalog.brand.select(F.lit("brands").alias("kind"), "name",
                                              F.col("brand_id").cast("long").alias("name_id")))
            .unionByName(catalog.base_item.select(F.lit("items").alias("kind"), "name",
                                                  F.col("base_item_id").cast("long").alias("name_id")))
            .withColumn("fname", fold("name")))


def like_pattern(text):
    """A user's wildcard text as a LIKE pattern: a backslash keeps its meaning
    before backslash, %, and _, and is dropped before anything else."""
    return F.regexp_replace(text, r"(?s)(\\[\\%_])|\\(.)", "$1$2")


def _grams(text, n):
    """The ``n``-letter grams of a string column (empty if shorter)."""
    size = F.length(text)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr(text, i, F.lit(n)))) \
        .otherwise(F.array().cast("array<string>"))


def _pattern_grams(pats: DataFrame) -> DataFrame:
    """(p, gram): grams of the literal runs of each pattern, three letters long
    or as long as the run."""
    runs = pats.select("p", F.explode(F.regexp_extract_all("contains", F.lit(r"((?:\\[\\%_]|[^\\%_])+)"), F.lit(1))).alias("run"))
    run = F.lower(F.regexp_replace("run", r"(?s)\\(.)", "$1"))
    runs = runs.select("p", run.alias("run"))
    sizes = [F.when(F.length("run") == n, _grams(F.col("run"), n)) for n in (1, 2)]
    return runs.select("p", F.explode(F.coalesce(*sizes, _grams(F.col("run"), 3))).alias("gram")).distinct()


def _letters(fname):
    """All one- to three-letter grams of a folded name, each once."""
    return F.array_distinct(F.concat(*[_grams(F.lower(fname), n) for n in (1, 2, 3)]))


class Names:
    """Where the search finds names: here straight from the rows
    (kind, name, name_id, fname); only grams that are asked for leave the explode."""

    def __init__(self, names: DataFrame):
        self._names = names
        self._groups = names.select("kind", "fname").distinct()

    def postings(self, grams: DataFrame) -> DataFrame:
        """(gram, kind, fname) of the distinct names that hold each gram of ``grams``."""
        every = self._groups.select("kind", "fname", F.explode(_letters("fname")).alias("gram"))
        return materialize(every.join(grams.select("gram").distinct(), "gram", "left_semi"))

    def frequencies(self, grams: DataFrame, postings: DataFrame) -> DataFrame:
        """(gram, _df) of those grams."""
        return postings.groupBy("gram").agg(F.count(F.lit(1)).alias("_df"))

    def firsts(self, k: int) -> DataFrame:
        """(kind, size, fname): the first ``k`` distinct names of every length."""
        sized = self._groups.select("kind", "fname", F.length("fname").alias("size"))
        return top_k(sized, ["kind", "size"], [F.col("fname").asc()], k, rank_col="_f").drop("_f")

    def rows(self, groups: DataFrame) -> DataFrame:
        """(kind, name, name_id, fname) of the asked (kind, fname)."""
        return self._names.join(groups.select("kind", "fname").distinct(), ["kind", "fname"], "left_semi")


class NameIndex(Names):
    """The same from postings that are kept: written once, extended by new names.

    Every build or extension is a part of its own: distinct names with their
    grams, divided by a hash of the gram, and name rows, divided by a hash of the
    folded name. A search reads the divisions of the grams and names it asks
    for, so its reading follows the patterns, not the catalogue. A name that an
    earlier part holds already is not posted again.
    """

    DIVISIONS = 64
    FIRSTS = 32  # names kept per kind and length for patterns of wildcards alone

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")

    def _division(self, col: str):
        return F.pmod(F.xxhash64(col), F.lit(self.DIVISIONS)).cast("int")

    def _read(self, table: str, schema: str) -> DataFrame:
        found = read_parquet_if_present(self._spark, f"{self._path}/{table}")
        return self._spark.createDataFrame([], schema) if found is None else found

    def _asked(self, table: str, schema: str, col: str, wanted: DataFrame) -> DataFrame:
        """Rows of the wanted values, from their divisions only."""
        divisions = [r[0] for r in wanted.select(self._division(col).alias("d")).distinct().collect()]  # at most DIVISIONS numbers
        return self._read(table, schema).filter(F.col("division").isin(divisions)).drop("part", "division")

    def extend(self, names: DataFrame) -> int:
        """Add name rows (kind, name, name_id, fname); returns the number of the new part."""
        marks = self._read("done", "part int")
        part = (marks.agg(F.max("part")).first()[0] or 0) + 1
        folder = lambda table: f"{self._path}/{table}/part={part}"
        by = lambda df, col, table: df.withColumn("division", self._division(col)).write.mode("overwrite").partitionBy(
            "division").parquet(folder(table))
        names = materialize(names.select("kind", "name", "name_id", "fname"))
        groups = names.select("kind", "fname").distinct()
        held = self._asked("names", NAME_ROWS, "fname", groups).select("kind", "fname").distinct()
        fresh = materialize(groups.join(held, ["kind", "fname"], "left_anti"))
        by(names, "fname", "names")
        posted = fresh.select(F.explode(_letters("fname")).alias("gram"), "kind", "fname")
        by(posted, "gram", "postings")
        by(posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "frequencies")
        Names.firsts(_Groups(fresh), self.FIRSTS).write.mode("overwrite").parquet(folder("firsts"))
        self._spark.range(1).write.mode("overwrite").parquet(folder("done"))  # last: the part is whole
        return part

    def postings(self, grams: DataFrame) -> DataFrame:
        return self._asked("postings", "gram string, kind string, fname string, division int", "gram", grams).join(
            grams.select("gram").distinct(), "gram", "left_semi")

    def frequencies(self, grams: DataFrame, postings: DataFrame) -> DataFrame:
        kept = self._asked("frequencies", "gram string, n long, division int", "gram", grams)
        return kept.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("_df"))

    def firsts(self, k: int) -> DataFrame:
        if k > self.FIRSTS:
            return Names.firsts(_Groups(self._read("names", NAME_ROWS).select("kind", "fname").distinct()), k)
        kept = self._read("firsts", "kind string, size int, fname string").select("kind", "size", "fname")
        return top_k(kept, ["kind", "size"], [F.col("fname").asc()], k, rank_col="_f").drop("_f")

    def rows(self, groups: DataFrame) -> DataFrame:
        return self._asked("names", NAME_ROWS, "fname", groups).join(groups.select("kind", "fname").distinct(), ["kind", "fname"], "left_semi")


NAME_ROWS = "kind string, name string, name_id long, fname string, division int"


class _Groups(Names):
    """Distinct names only."""

    def __init__(self, groups: DataFrame):
        self._groups = groups


def _gram_hits(grams: DataFrame, pats: DataFrame, names: Names) -> DataFrame:
    """(p, kind, fname): every literal run of a pattern occurs in any name it
    matches, so the names that hold the pattern's rarest gram are the
    candidates, checked with ILIKE. A pattern with a gram that no name holds has none."""
    postings = names.postings(grams)
    freq = names.frequencies(grams, postings)
    rarest = (grams.join(freq, "gram", "left").groupBy("p")
              .agg(F.min_by("gram", F.struct(F.coalesce("_df", F.lit(0)).alias("_df"), F.col("gram"))).alias("gram")).join(pats, "p"))
    return (rarest.join(postings, "gram").filter(F.ilike("fname", F.col("contains"), F.lit("\\")))
            .select("p", "kind", "fname"))


def _wildcard_hits(pats: DataFrame, names: Names, k: int) -> DataFrame:
    """(p, kind, fname) of patterns of wildcards alone. Such a pattern asks for
    names of at least as many letters as it has underscores, so equal counts
    share an answer: the first k names among the first k of every length."""
    wild = pats.withColumn("least", F.length(F.regexp_replace("contains", "[^_]", "")))
    firsts = materialize(names.firsts(k))
    longest = int(firsts.agg(F.max("size")).first()[0] or 0)
    reach = (wild.select("least").distinct().filter(F.col("least") <= longest)
             .select("least", F.explode(F.sequence(F.col("least"), F.lit(longest))).alias("size")))
    answers = top_k(reach.join(firsts, "size"), ["least", "kind"], [F.col("fname").asc()], k, rank_col="_f")
    return wild.join(answers, "least").select("p", "kind", "fname")


def search_names(queries: DataFrame, catalog: Catalog | None, k: int = SEARCH_RESULTS_PER_KIND,
                 literal: bool = False, index: NameIndex | None = None) -> DataFrame:
    """U8: up to k names per (query, kind): prefix hits first, then folded name.

    Output (query_id, kind, rank, name). Duplicate names are kept; NULL input
    matches nothing, empty input matches everything. ``%``, ``_`` and the
    backslash act as in the reference (a last backslash makes the closing
    wildcard literal); with ``literal`` they stand for themselves.

    Plan: distinct folded patterns meet distinct folded names per kind through
    the pattern's rarest gram (equi-joins); patterns of wildcards alone
    collapse to one class per number of underscores. Each (pattern, kind)
    keeps k names (partial WindowGroupLimit), names expand to their first k
    rows, and queries join back on the pattern. With ``index`` the names and
    grams come from its kept postings instead of the catalogue.
    """
    q = fold("q")
    qs = queries.filter(F.col("q").isNotNull()).select("query_id", (like_literal(q) if literal else q).alias("p"))
    pats = materialize(qs.select("p").distinct().select(
        "p", like_pattern(F.concat(F.lit("%"), "p", F.lit("%"))).alias("contains"),
        like_pattern(F.concat("p", F.lit("%"))).alias("starts")))
    names = Names(searchable_names(catalog)) if index is None else index
    grams = materialize(_pattern_grams(pats))
    hits = _gram_hits(grams, pats, names).unionByName(
        _wildcard_hits(pats.join(grams.select("p").distinct(), "p", "left_anti"), names, k))
    flag = F.when(F.ilike("fname", F.col("starts"), F.lit("\\")), 0).otherwise(1)
    hits = hits.join(pats.select("p", "starts"), "p").withColumn("_prefix", flag).drop("starts")
    order = [F.col("_prefix").asc(), F.col("fname").asc()]
    top_groups = materialize(top_k(hits, ["p", "kind"], order, k, rank_col="_g").drop("_g"))
    by_row = [F.col("name").asc(), F.col("name_id").asc()]
    first_rows = top_k(names.rows(top_groups), ["kind", "fname"], by_row, k, rank_col="_r").drop("_r")
    expanded = top_groups.join(first_rows, ["kind", "fname"])
    per_pattern = top_k(expanded, ["p", "kind"], order + by_row, k)
    return qs.join(per_pattern, "p").select("query_id", "kind", "rank", "name")


def _initial(fname):
    first = F.substring(fname, 1, 1)
    return F.when(first.rlike("^[0-9]"), F.lit("#")).otherwise(F.upper(first))


def brand_index(brand: DataFrame) -> DataFrame:
    """(initial, rank, name) -- brands grouped by the upper-cased first
    letter of the folded name (digits -> '#'), ordered by folded name.

    Ranks come from a range-partitioned sort, so a crowded initial is never
    gathered into one task.
    """
    b = brand.select("brand_id", "name", fold("name").alias("fname")) \
        .withColumn("initial", _initial(F.col("fname")))
    ranked = positions(b, ["initial"], ["fname", "name", "brand_id"], pos_col="rank")
    return ranked.select("initial", "rank", "name")


def brand_index_letters(brand: DataFrame) -> DataFrame:
    """The page's 27 letters in order, each with its brands by rank:
    (letter_order, initial, n_brands, rank, name); a letter without brands is
    one row with NULL rank and name."""
    spark = brand.sparkSession
    letters = spark.createDataFrame([(i, s) for i, s in enumerate(INDEX_LETTERS)],
                                    "letter_order int, initial string")
    index = brand_index(brand)
    # the last rank of an initial is its number of brands
    counts = index.groupBy("initial").agg(F.max("rank").alias("n_brands"))
    # 27 fixed letters and at most as many counts: a bounded broadcast
    counted = letters.join(counts, "initial", "left").select(
        "letter_order", "initial", F.coalesce("n_brands", F.lit(0)).cast("long").alias("n_brands"))
    shown = index.join(F.broadcast(counted), "initial").select("letter_order", "initial", "n_brands", "rank", "name")
    empty = counted.filter(F.col("n_brands") == 0).select(
        "*", F.lit(None).cast("long").alias("rank"), F.lit(None).cast("string").alias("name"))
    return shown.unionByName(empty)
