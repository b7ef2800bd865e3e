"""Line dedup by winnowing: delete later copies of runs of lines, in DataFrame operations only.

Lines are compared trimmed; blank ones don't count. Each window of `run` lines selects its smallest line hash (the
rightmost of equal ones) as a fingerprint, so every run of that length has one that both of its copies select. Only the
selected fingerprints are kept, one row for each of their places, and those that stand at two places or more go on. In
the documents that hold one, matches are extended both ways from it: the windows that selected it, on either side, are
compared as wholes, and a window that also stands earlier is deleted, which for longer runs joins up. So a line goes
exactly if it lies in a run of `run` or more lines that also stands earlier, in order of id and place. No pairs are
formed: each window hash keeps its earliest place.

With `words`, runs of fewer lines count too if they hold more than so many words: such a run is a window and a
fingerprint of its own. The pipeline and the query op10_line_dedup do so with LONG, so passages of over 50 words go on
however many lines they stand. Short common lines are left alone.

Edge cases: null and empty texts have no lines; documents without an id are left as they are; rows that repeat an id
and a text count as one document; of texts under one id the order is that of their hash. The first copy always stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import aside, cut

RUN = 3
#: Runs of fewer lines than RUN go from more than so many words on.
LONG = 50
BLANKS = " \t\r\x0b\x0c"
#: Deleted lines are broadcast up to so many numbers; beyond it texts are shuffled to them.
BROADCAST_LINES = 2_000_000


def _lines(text: Column, count: bool = False) -> Column:
    """(line number, hash, number of words if they count) of each line that isn't blank."""
    trimmed = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("line"), F.trim(x, F.lit(BLANKS)).alias("x")))
    n = lambda y: [F.regexp_count(y["x"], F.lit(f"[^{BLANKS}]+")).alias("n")] if count else []
    return F.transform(F.filter(trimmed, lambda y: y["x"] != ""), lambda y: F.struct(y["line"].alias("line"), F.xxhash64(y["x"]).alias("h"), *n(y)))


def _items(docs: DataFrame, id_col: str, text: str, count: bool) -> DataFrame:
    held = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull())
    return held.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k"), _lines(F.col(text), count).alias("items"))


def fingerprints(docs: DataFrame, run: int = RUN, id_col="doc_id", text="text", words: int | None = None) -> DataFrame:
    """(id, k, run, at, f): a row for each place that a window selects. k: hash of the text, at: number among the lines that aren't blank."""
    items = _items(docs, id_col, text, words is not None)
    selected = F.array_distinct(_starts(run, lambda s: _least(F.col("items"), s, run)))
    marks = [F.transform(selected, lambda m: F.struct(F.lit(run).alias("run"), (-m["p"]).alias("at"), m["h"].alias("f")))]

    def alone(n: int) -> Column:
        return F.transform(_long(n, words), lambda s: F.struct(F.lit(n).alias("run"), s.alias("at"), _window(F.col("items"), s, n)["w1"].alias("f")))

    marks += [alone(n) for n in range(1, run if words is not None else 1)]
    none = F.expr("cast(array() as array<struct<run:int,at:int,f:bigint>>)")
    return items.select("id", "k", F.explode(F.concat(*(F.coalesce(m, none) for m in marks))).alias("m")).select("id", "k", "m.*")


def around(docs: DataFrame, held: DataFrame, run: int = RUN, id_col="doc_id", text="text", words: int | None = None) -> DataFrame:
    """(id, k, s, lo, hi, w1, w2): the windows that selected the places in held: (id, k, places of run and at)."""
    total = held.agg(F.sum(F.size("places") + 4)).first()[0] or 0
    held = held.select(F.col("id").alias("_id"), F.col("k").alias("_k"), "places")
    items = _items(docs, id_col, text, False)
    near = items.join(F.broadcast(held) if total <= BROADCAST_LINES else held, (F.col("id") == F.col("_id")) & (F.col("k") == F.col("_k")))

    def both_ways(at: Column) -> Column:
        """The windows with the place in them that selected it."""
        starts = F.sequence(F.greatest(F.lit(0), at - (run - 1)), F.least(at, F.size("items") - run))
        own = F.filter(starts, lambda s: _least(F.col("items"), s, run)["p"] == -at)
        return F.transform(own, lambda s: F.struct(s.alias("s"), _window(F.col("items"), s, run).alias("x")))

    def single(n: int) -> Column:
        own = F.filter("places", lambda p: p["run"] == n)
        return F.transform(own, lambda p: F.struct(p["at"].alias("s"), _window(F.col("items"), p["at"], n).alias("x")))

    found = [F.flatten(F.transform(F.filter("places", lambda p: p["run"] == run), lambda p: both_ways(p["at"])))]
    found += [single(n) for n in range(1, run if words is not None else 1)]
    return near.select("id", "k", F.explode(F.concat(*found)).alias("y")).select("id", "k", "y.s", "y.x.lo", "y.x.hi", "y.x.w1", "y.x.w2")


def _long(run: int, words: int) -> Column:
    """Where windows of run lines with more than so many words start."""
    items = F.col("items")
    return F.filter(_starts(run, lambda s: s), lambda s: sum(F.get(items, s + k)["n"] for k in range(run)) > words)


def _starts(run: int, made) -> Column:
    return F.when(F.size("items") >= run, F.transform(F.sequence(F.lit(0), F.size("items") - run), made))


def _least(items: Column, s: Column, run: int) -> Column:
    """The smallest hash of the window at s, and less its place."""
    own = [F.struct(F.get(items, s + j)["h"].alias("h"), (-(s + j)).alias("p")) for j in range(run)]
    return F.least(*own) if run > 1 else own[0]


def _window(items: Column, s: Column, run: int) -> Column:
    hs = [F.get(items, s + j)["h"] for j in range(run)]
    return F.struct(F.get(items, s)["line"].alias("lo"), F.get(items, s + (run - 1))["line"].alias("hi"), F.xxhash64(*hs).alias("w1"), F.xxhash64(F.lit(run), *hs).alias("w2"))


def repeated(docs: DataFrame, run: int = RUN, id_col="doc_id", text="text", words: int | None = None) -> DataFrame:
    """(id, k, gone): for each document with later copies of runs, the sorted numbers of the lines to delete."""
    marks = cut(fingerprints(docs, run, id_col, text, words))
    # Tables are cut before a join, so that both of its sides are plain shuffles, which Spark can split where a key is hot.
    common = cut(marks.groupBy("f").agg(F.count("*").alias("places")).where("places >= 2").select("f"))
    held = cut(cut(marks.join(common, "f")).groupBy("id", "k").agg(F.collect_set(F.struct("run", "at")).alias("places")))
    near = cut(around(docs, held, run, id_col, text, words))
    first = cut(
        near.groupBy("w1", "w2").agg(F.min(F.struct("id", "k", "s")).alias("first"), F.count("*").alias("n")).where("n >= 2").select("w1", "w2", "first")
    )
    later = near.join(first, ["w1", "w2"]).where(F.struct("id", "k", "s") > F.col("first"))
    lines = later.select("id", "k", F.explode(F.sequence("lo", "hi")).alias("line"))
    return lines.groupBy("id", "k").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def clean(docs: DataFrame, run: int = RUN, id_col="doc_id", text="text", into="text", gone="_gone", words: int | None = None) -> DataFrame:
    """docs with `gone` (numbers of the deleted lines, or null) and the text without them in `into`; other columns stay, whatever their names."""
    found = cut(repeated(docs, run, id_col, text, words))
    total = found.agg(F.sum(F.size("gone") + 4)).first()[0] or 0
    side = (F.broadcast(found) if total <= BROADCAST_LINES else found).select(F.col("id").alias("_id"), F.col("k").alias("_k"), F.col("gone").alias("_g"))
    named, where = aside(docs)
    own = F.col(where[text])
    joined = named.join(side, (F.col(where[id_col]) == F.col("_id")) & (F.xxhash64(own) == F.col("_k")), "left")
    lines = F.split(own, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_g"))
    cleaned = F.when(F.col("_g").isNull(), own).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    out = {c: F.col(k) for c, k in where.items()} | {into: cleaned, gone: F.col("_g")}
    return joined.select(*(x.alias(c) for c, x in out.items()))


def remove_repeats(docs: DataFrame, run: int = RUN, words: int | None = LONG) -> DataFrame:
    """The documents with later copies of runs deleted from their texts and n_chars counted anew. A document of which nothing is left goes."""
    named, where = aside(docs)
    text = where["text"]
    out = clean(named, run, where["doc_id"], text, text, "_gone", words)
    out = out.where(F.col("_gone").isNull() | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in where:
        n = where["n_chars"]
        out = out.withColumn(n, F.when(F.col("_gone").isNull(), F.col(n)).otherwise(F.char_length(text).cast(named.schema[n].dataType)))
    return out.select(*named.columns).toDF(*docs.columns)
