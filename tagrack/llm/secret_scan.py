"""Secrets in texts: fixed patterns, and character Markov models for the rest.

The base spans come from three patterns. Beside them, every run of
``LEAST_LENGTH`` and more characters that a key may hold (letters, digits and
``+ / _ . = -``) is scored by two first-order character models, one of random strings and
one of ordinary identifiers. A run consists of pieces, letters and digits
or one sign each. A span is a stretch of pieces in which the log-likelihood ratio
favours randomness: its sum must pass ``LEAST_SUM``, so the shorter the stretch the
clearer it must be, and its mean per transition ``LEAST_RATIO``. So a key is found
within a path or behind a name and ``=``, without them. A stretch ends where the sum
falls to 0, or by ``LEAST_SUM`` under its peak. Both models are trained from
labelled samples of the corpus: values and keys that the base patterns found are the random
strings; the runs of all texts outside them that occur ``LEAST_TIMES`` and more, or
hold no letter (numbers rarely recur), are the ordinary identifiers, but for those with a
long part that mixes letters and digits: a secret that no base pattern found must not
speak for itself.

DataFrame and SQL functions only. Positions are code points: pieces between
matches (split) and matches (extract all) alternate, so their lengths add up to
the starts.

Defined cases. A null or empty text has no spans, empty span text and the hash
of the empty string. Texts are read whole. Without a base span in the corpus there
is no model of random strings and only base spans are given. Rows with null or
repeated ids are scanned each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from json import dumps
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

# (kind, pattern, group whose length counts, least length), in the order of kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
# A pattern that a text must hold for a kind to be possible, cheaper than the kind's own.
POSSIBLE = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
RUN = r"[A-Za-z0-9+/_.=-]+"
PIECE = r"[A-Za-z0-9]+|[+/_.=-]"
LEAST_LENGTH = 8  # of a run that is judged
LONG_RUN = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % LEAST_LENGTH
# a part that mixes letters and digits: no sample of ordinary identifiers
MIXED = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{16,}"
SMOOTH = 0.5
LEAN = 20
LEAST_RATIO = 1.0  # nats per transition
LEAST_TIMES = 2
LEAST_SUM = 15.0  # nats of a stretch: outweighs some three million ordinary ones to a secret
ALPHABET = 128
MATCHES = 128  # in one block


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _characters(ascii_text: Column) -> Column:
    """Its characters as an array: an index finds the n-th at once, a substring counts to it."""
    return F.split(ascii_text, "")


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost matches, in code points.

    Starts are running sums of lengths, taken block by block, so that no array
    is copied once per match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern)
    size = lambda x: F.length(x["g"]) + F.length(x["v"])
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def spans(block: Column, begin: Column) -> Column:
        step = lambda acc, x: F.struct(
            (acc["at"] + size(x)).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["g"])).alias("start"), (acc["at"] + size(x)).alias("end"),
                                                  x["v"].alias("value")))).alias("out"))
        return F.aggregate(block, F.struct(begin.alias("at"), none.alias("out")), step)["out"]

    def begins(blocks: Column) -> Column:
        step = lambda acc, block: F.struct(
            (acc["at"] + F.aggregate(block, F.lit(0), lambda n, x: n + size(x))).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]

    def long(zipped: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / MATCHES).cast("int")),
                             lambda b: F.slice(zipped, b * MATCHES + 1, F.lit(MATCHES)))
        return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, begins(bs), spans)))

    zipped = _let(found, lambda f: F.arrays_zip(f.alias("v"), F.slice(between, F.lit(1), F.size(f)).alias("g")))
    return _let(zipped, lambda z: F.when(F.size(z) <= MATCHES, spans(z, F.lit(0))).otherwise(long(z)))


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind with the secret itself as ``value``; failing matches are dropped."""
    all_ = matches(text, pattern)
    if group:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        all_ = F.zip_with(all_, values, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))
    kept = F.filter(all_, lambda s: F.length(s["value"]) >= least)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(POSSIBLE[kind]), kept).otherwise(none)


def base_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, one array of spans per kind, and the runs to judge; written, so
    whole texts are read once."""
    t = F.col("t")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    rows = rows.select("doc_id", *[_spans(t, *k).alias(k[0]) for k in KINDS], matches(t, LONG_RUN).alias("runs"))
    return written(rows, "secret_spans")


def _pairs(strings: DataFrame, least_times: int = 1) -> DataFrame:
    """Counts of neighbouring ASCII characters of column ``s``: (a, b, n). Equal
    strings are counted before they are taken apart; rarer ones with a letter are left out."""
    two = strings.where("length(s) > 1 and s rlike '^[\\\\x01-\\\\x7f]+$'").groupBy("s").agg(F.count("*").alias("times"))
    two = two.where((F.col("times") >= least_times) | ~F.col("s").rlike("[A-Za-z]"))
    pairs = _let(_characters(F.col("s")), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.struct(
        F.ascii(c[i]).alias("a"), F.ascii(c[i + 1]).alias("b"))))
    return two.select("times", F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(
        F.sum("times").alias("n"))


def log_probabilities(counts: dict[tuple[int, int], int]) -> list[float]:
    """log P(b | a) of an ASCII matrix, row after row; a row leans on the
    frequencies of single characters as if it had seen ``LEAN`` of them."""
    chars = range(ALPHABET)
    single = [sum(counts.get((a, b), 0) for a in chars) + SMOOTH for b in chars]
    total = sum(single)
    out = []
    for a in chars:
        seen = sum(counts.get((a, b), 0) for b in chars)
        out += [log((counts.get((a, b), 0) + LEAN * single[b] / total) / (seen + LEAN)) for b in chars]
    return out


def train(spans: DataFrame, docs: DataFrame, text_col: str = "text") -> list[float] | None:
    """Log-likelihood ratio of every transition, random against ordinary; at most
    128 x 128 numbers. None without a random sample."""
    secrets = spans.select(F.explode(F.concat(*[F.col(k[0]) for k in KINDS])).alias("x")).select(F.col("x.value").alias("s"))
    random = {(r["a"], r["b"]): r["n"] for r in _pairs(secrets).collect()}
    if not random:
        return None
    plain = text_or_empty(text_col)
    for kind, pattern in [*[(k[0], k[1]) for k in KINDS[:2]], ("hex", POSSIBLE["hex"] + "[0-9a-f]*")]:
        plain = F.when(plain.rlike(POSSIBLE[kind]), F.regexp_replace(plain, pattern, " ")).otherwise(plain)
    runs = docs.select(F.explode(F.regexp_extract_all(plain, F.lit(RUN), F.lit(0))).alias("s"))
    words = runs.where((F.length("s") < 16) | ~F.col("s").rlike(MIXED))
    ordinary = {(r["a"], r["b"]): r["n"] for r in _pairs(words, LEAST_TIMES).collect()}
    return [x - y for x, y in zip(log_probabilities(random), log_probabilities(ordinary), strict=True)]


def stretches(run: Column, table: str = "llr") -> Column:
    """array<struct<start, end>> of the parts of an ASCII run that the models hold for random.

    One pass over the pieces that opens a stretch, follows its sum and closes it at
    its peak. Runs whose favourable pieces together stay under ``LEAST_SUM`` hold none."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    of = lambda a, b: F.element_at(F.col(table), F.ascii(a) * ALPHABET + F.ascii(b) + 1)
    inner = lambda c: F.when(F.size(c) < 2, 0.0).otherwise(F.aggregate(
        F.sequence(F.lit(0), F.size(c) - 2), F.lit(0.0), lambda a, i: a + of(c[i], c[i + 1])))
    scored = lambda ps: F.transform(ps, lambda p, i: F.struct(
        F.length(p).alias("n"), F.when(i == 0, 0.0).otherwise(of(F.substring(ps[i - 1], -1, 1), p)).alias("join"),
        _let(_characters(p), inner).alias("inner")))

    def with_last(acc: Column, out: Column) -> Column:
        random = (acc["peak"] > LEAST_SUM) & (acc["peak"] > LEAST_RATIO * (acc["end"] - acc["start"] - 1))
        return F.when(random, F.concat(out, F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(out)

    def step(acc: Column, x: Column) -> Column:
        now, here = acc["sum"] + x["join"] + x["inner"], acc["at"] + x["n"]
        over = (acc["sum"] <= 0) | (now <= 0) | (acc["peak"] - now > LEAST_SUM)  # the piece opens a stretch of its own
        full = over & (F.size(acc["out"]) >= MATCHES)  # filled blocks go aside, so none is copied again and again
        out = F.when(full, none).otherwise(acc["out"])
        return F.struct(
            here.alias("at"), F.when(over, acc["at"]).otherwise(acc["start"]).alias("start"), F.when(over, x["inner"]).otherwise(now).alias("sum"),
            F.when(over, x["inner"]).otherwise(F.greatest(acc["peak"], now)).alias("peak"),
            F.when(over | (now > acc["peak"]), here).otherwise(acc["end"]).alias("end"),
            F.when(over, with_last(acc, out)).otherwise(acc["out"]).alias("out"),
            F.when(full, F.concat(acc["done"], F.array(acc["out"]))).otherwise(acc["done"]).alias("done"))

    def walk(pieces: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"), F.lit(0).alias("end"),
                         none.alias("out"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("done"))
        return F.aggregate(pieces, first, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(with_last(acc, acc["out"])))))

    def judged(pieces: Column) -> Column:
        hope = F.aggregate(pieces, F.lit(0.0), lambda a, x: a + F.greatest(x["join"], F.lit(0.0)) + F.greatest(x["inner"], F.lit(0.0)))
        return F.when(hope > LEAST_SUM, walk(pieces)).otherwise(none)

    return _let(_let(F.regexp_extract_all(run, F.lit(PIECE), F.lit(0)), scored), judged)


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, base and spans (arrays of kind, start, end, value)."""
    spans = base_spans(docs, text_col, id_col)
    llr = train(spans, docs, text_col)
    named = lambda col, i, kind: F.transform(col, lambda s: F.struct(
        s["start"].alias("start"), F.lit(i).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    base = F.concat(*[named(F.col(k[0]), i, k[0]) for i, k in enumerate(KINDS)])
    spans = spans.withColumn("base", F.array_sort(base))
    markov = F.col("base")
    if llr is not None:
        spans = spans.withColumn("llr", F.from_json(F.lit(dumps(llr)), "array<double>"))  # folded to a constant
        inside = lambda r: F.exists("base", lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"]))
        meets = lambda x: F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        placed = lambda r: F.transform(stretches(r["value"]), lambda x: F.struct(
            (r["start"] + x["start"]).alias("start"), (r["start"] + x["end"]).alias("end"),
            r["value"].substr(x["start"] + 1, x["end"] - x["start"]).alias("value")))
        odd = F.filter(F.flatten(F.transform(F.filter("runs", lambda r: ~inside(r)), placed)), lambda x: ~meets(x))
        markov = F.array_sort(F.concat("base", named(odd, len(KINDS), "markov")))
    return spans.select("doc_id", "base", markov.alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", *[count(k[0]) for k in KINDS],
                             F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
