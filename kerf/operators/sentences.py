"""Sentences and packed sentences: generators and folds without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerf.functions import sizing

MARK, HELD, END = "\u0001", "\u0001\u0002", "\u0001\u0003"
#: A sentence ends at blank lines, and at white space after . ! or ? before a capital, a quote or a bracket.
BREAK = r"(\n{2,}|(?<=[!?.])\s+(?=[\[(\"'A-Z]))"


def cut(text: Column, pattern: str, kept: str) -> Column:
    """A text cut behind ``kept`` of each match; the pieces that aren't empty, which joined give it back.

    Cuts are marked by a control character.  A text that has it, which is rare, is cut with its own ones held apart.
    """

    def pieces(t: Column, mark: str) -> Column:
        return F.filter(F.split(F.regexp_replace(t, pattern, kept + mark), mark), lambda s: s != "")

    held = F.transform(pieces(F.replace(text, F.lit(MARK), F.lit(HELD)), END), lambda s: F.replace(s, F.lit(HELD), F.lit(MARK)))
    return F.when(F.contains(text, F.lit(MARK)), held).otherwise(pieces(text, MARK))


def split(text: Column | str) -> Column:
    """The sentences of a text, which joined give it back."""
    return cut(F.col(text) if isinstance(text, str) else text, BREAK, "$1")


def rows_of(df: DataFrame, items: Column, *names: str) -> DataFrame:
    """The rows of ``df`` with (position, item) of each item of an array.

    The outer generator, whose rows without an item are passed over behind it, keeps the optimizer from copying the array's whole
    expression into a filter on its size, where it would be computed again.
    """
    return df.select("*", F.posexplode_outer(items).alias(*names)).where(F.col(names[0]).isNotNull())


def sentences(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pos, sentence, char_start, byte_start) of every sentence; null texts have none.

    Offsets are summed within the array, so nothing is shuffled or sorted.
    """
    pieces = split(text)
    start = F.struct(F.lit(0).alias("c"), F.lit(0).alias("b"), F.array().cast("array<struct<s:string,c:int,b:int>>").alias("out"))

    def step(acc, s):
        item = F.struct(s.alias("s"), acc["c"].alias("c"), acc["b"].alias("b"))
        return F.struct((acc["c"] + F.length(s)).alias("c"), (acc["b"] + F.octet_length(s)).alias("b"), F.array_append(acc["out"], item).alias("out"))

    placed = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    rows = rows_of(docs.select(id_col, placed.alias("__x")), F.col("__x"), "pos", "x")
    return rows.select(id_col, "pos", F.col("x.s").alias("sentence"), F.col("x.c").alias("char_start"), F.col("x.b").alias("byte_start"))


def pack(pieces: Column, max_size: int, unit: str = "chars", min_size: int = 0) -> Column:
    """Greedy windows over an array of texts: each holds what fits in ``max_size``; a piece that is larger stands alone.

    Windows under ``min_size`` then take in the next one, or at the end join the one before, whatever the sum.
    """
    kind = "struct<t:string,n:int>"
    sized = F.transform(pieces, lambda s: F.struct(s.alias("t"), sizing.size_of(s, unit).alias("n")))
    none = F.array().cast(f"array<{kind}>")

    # The open window is kept beside the closed ones, so that a step adds to a list and never rebuilds it.
    start = F.struct(none.alias("done"), F.lit("").alias("t"), F.lit(0).alias("n"))

    def fold(acc, s):
        fits = acc["n"] + s["n"] <= max_size
        closed = F.when(acc["t"] == "", acc["done"]).otherwise(F.array_append(acc["done"], F.struct(acc["t"].alias("t"), acc["n"].alias("n"))))
        return F.when((acc["t"] == "") | fits, F.struct(acc["done"].alias("done"), F.concat(acc["t"], s["t"]).alias("t"), (acc["n"] + s["n"]).alias("n"))).otherwise(
            F.struct(closed.alias("done"), s["t"].alias("t"), s["n"].alias("n"))
        )

    def finish(acc):
        return F.when(acc["t"] == "", acc["done"]).otherwise(F.array_append(acc["done"], F.struct(acc["t"].alias("t"), acc["n"].alias("n"))))

    windows = F.aggregate(sized, start, fold, finish)
    if min_size > 0:

        def merge(acc, s):
            return F.when(
                (acc["t"] != "") & (acc["n"] >= min_size),
                F.struct(F.array_append(acc["done"], F.struct(acc["t"].alias("t"), acc["n"].alias("n"))).alias("done"), s["t"].alias("t"), s["n"].alias("n")),
            ).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["t"], s["t"]).alias("t"), (acc["n"] + s["n"]).alias("n")))

        def end(acc):
            n = F.size(acc["done"])
            last = F.try_element_at(acc["done"], F.lit(-1))
            joined = F.struct(F.concat(last["t"], acc["t"]).alias("t"), (last["n"] + acc["n"]).alias("n"))
            alone = F.array_append(acc["done"], F.struct(acc["t"].alias("t"), acc["n"].alias("n")))
            return F.when(acc["t"] == "", acc["done"]).when((acc["n"] >= min_size) | (n == 0), alone).otherwise(F.array_append(F.slice(acc["done"], 1, n - 1), joined))

        windows = F.aggregate(windows, start, merge, end)
    return F.transform(windows, lambda w: w["t"])


def placed_windows(windows: Column) -> Column:
    """Array of (t, bs, be, ls, le): texts that joined are the document, with their ranges of bytes and lines."""
    kind = "struct<t:string,bs:int,be:int,ls:int,le:int>"
    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("l"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc, t):
        newlines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
        b, after = acc["b"] + F.octet_length(t), acc["l"] + newlines
        last = after - F.when(F.endswith(t, F.lit("\n")), 1).otherwise(0)
        item = F.struct(t.alias("t"), acc["b"].alias("bs"), b.alias("be"), acc["l"].alias("ls"), F.greatest(last, acc["l"]).alias("le"))
        return F.struct(b.alias("b"), after.alias("l"), F.array_append(acc["out"], item).alias("out"))

    return F.aggregate(windows, start, step, lambda acc: acc["out"])


def chunk_rows(docs: DataFrame, windows: Column, id_col: str = "doc_id", path: Column | None = None, keep: tuple[str, ...] = (), before: bool = False) -> DataFrame:
    """Chunk rows of an array of texts that joined are the document: ranges, counts and stable ids, with no shuffle.

    With ``before`` each has the text of the chunk before, null for the first.
    """
    path = F.col(id_col).cast("string") if path is None else path
    rows = docs.select(id_col, *keep, path.alias("filepath"), placed_windows(windows).alias("__w"))
    rows = rows_of(rows, F.col("__w"), "index", "x").withColumn("total_chunks", F.size("__w"))
    text = F.col("x.t")
    return rows.select(
        id_col, *keep, "filepath", text.alias("text"), "total_chunks", "index",
        *(F.col(f"x.{short}").alias(name) for short, name in (("ls", "line_start"), ("le", "line_end"), ("bs", "byte_start"), ("be", "byte_end"))),
        sizing.nws_bytes(text).alias("nws_count"), sizing.n_chars(text).alias("char_count"), sizing.n_words(text).alias("token_count"),
        sizing.stable_id("filepath", "index", "x.bs", "x.be").alias("stable_id"),
        *([F.get("__w", F.col("index") - 1)["t"].alias("before")] if before else []),
    )
