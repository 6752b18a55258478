"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame functions alone.

A text is the set of digests of its paragraphs: lines, cut from their start into blocks of at most `BLOCK` characters. A
sketch has three tables of `w` cells, `w` a power of two by the text's own number of digests; each digest goes to one cell
of each, and a cell keeps the count of its digests, their exclusive or and that of their check digests. The sketches of two
versions are subtracted cell by cell, the larger folded to the size of the smaller, which cancels what both hold; then
peeling takes digests out of cells that hold one, until nothing is left. If it gets stuck, both sketches are built anew four
times as large. What is peeled are the paragraph digests of either side alone, and their number gives the likeness (size of
the intersection over that of the union).

Cells are kept sparse, as arrays of (cell, count, digests, checks), so that building and peeling cost in proportion to the
number of digests; no text or paragraph is shuffled for them, and all of a pair happens in its row.

Null texts are empty; an empty text has no paragraphs, and two empty texts are alike (1). Repeated rows get the same
result. Rows with equal ids are ordered by a digest of their texts; a null id comes last. A table of one document is its own
next. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squallbars.llm.common import ranked, written

BLOCK = 128
LEAST_CELLS = 8
TABLES = 3
SIZES = 10
ROUNDS = 60
FOUND = "struct<one:array<bigint>,other:array<bigint>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, by an aggregate of nothing, which unlike a transform copies no results."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def long(x: int) -> Column:
    return F.lit(x).cast("long")


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    blocks = F.regexp_extract_all(text, F.lit("[^\\n]{1,%d}" % BLOCK), F.lit(0))
    return F.array_distinct(F.transform(blocks, lambda x: F.xxhash64(x)))


def own_cells(digests: Column) -> Column:
    """Cells of each table of a set's own sketch: the least power of two that is not below the number of its digests."""
    return F.pow(F.lit(2.0), F.length(F.bin(F.greatest(F.size(digests), F.lit(LEAST_CELLS)).cast("long") - 1))).cast("long")


def entries(digests: Column, w: Column, sign: int) -> Column:
    """What each digest adds to its cell of every table."""

    def cell(digest: Column, table: int, check: Column) -> Column:
        return F.struct((long(table) * w + F.pmod(F.xxhash64(digest, F.lit(table)), w)).alias("c"), long(sign).alias("n"), digest.alias("k"), check.alias("h"))

    return F.flatten(F.transform(digests, lambda x: bound(F.xxhash64(x, F.lit("check")), lambda h: F.array(*(cell(x, t, h) for t in range(TABLES))))))


def combined(parts: Column) -> Column:
    """Entries of one cell added up; cells with nothing left go."""
    zero = F.struct(long(0).alias("c"), long(0).alias("n"), long(0).alias("k"), long(0).alias("h"))

    def added(acc: Column, e: Column) -> Column:
        return F.struct(e["c"].alias("c"), (acc["n"] + e["n"]).alias("n"), acc["k"].bitwiseXOR(e["k"]).alias("k"), acc["h"].bitwiseXOR(e["h"]).alias("h"))

    def cells(ordered: Column) -> Column:
        # Runs are read by position: slicing would copy the whole array for each.
        at = F.sequence(F.lit(0), F.size(ordered) - 1)
        starts = F.filter(at, lambda i: (i == 0) | (F.get(ordered, i)["c"] != F.get(ordered, i - 1)["c"]))

        def run(starts: Column, first: Column, j: Column) -> Column:
            last = F.coalesce(F.get(starts, j + 1), F.size(ordered)) - 1
            return F.when(last == first, F.get(ordered, first)).otherwise(F.aggregate(F.sequence(first, last), zero, lambda acc, i: added(acc, F.get(ordered, i))))

        return bound(starts, lambda s: F.filter(F.transform(s, lambda a, j: run(s, a, j)), lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["h"] != 0)))

    return bound(parts, lambda p: F.when(F.size(p) == 0, p).otherwise(bound(F.sort_array(p), cells)))


def sketch(digests: Column, w: Column) -> Column:
    return combined(entries(digests, w, 1))


def folded(cells: Column, w: Column, to: Column) -> Column:
    """A sketch with `w` cells a table as the one with `to` cells, both powers of two: cells of equal remainders added up."""
    moved = F.transform(cells, lambda c: F.struct((F.floor(c["c"] / w) * to + c["c"] % w % to).cast("long").alias("c"), c["n"].alias("n"), c["k"].alias("k"), c["h"].alias("h")))
    return F.when(w == to, cells).otherwise(combined(moved))


def difference(one: Column, other: Column) -> Column:
    """One sketch less another of the same size."""
    negative = F.transform(other, lambda c: F.struct(c["c"].alias("c"), (-c["n"]).alias("n"), c["k"].alias("k"), c["h"].alias("h")))
    return combined(F.concat(one, negative))


def peeled(cells: Column, w: Column) -> Column:
    """(one, other): the digests of either side in a difference; null where peeling gets stuck."""

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["h"] == F.xxhash64(c["k"], F.lit("check"))))

        def digests(found: Column, sign: int) -> Column:
            return F.array_distinct(F.transform(F.filter(found, lambda c: c["n"] == sign), lambda c: c["k"]))

        def taken(found: Column) -> Column:
            left = combined(F.concat(state["cells"], entries(found["one"], w, -1), entries(found["other"], w, 1)))
            return F.struct(left.alias("cells"), F.concat(state["one"], found["one"]).alias("one"), F.concat(state["other"], found["other"]).alias("other"), F.lit(True).alias("on"))

        stuck = F.struct(state["cells"].alias("cells"), state["one"].alias("one"), state["other"].alias("other"), F.lit(False).alias("on"))
        next_ = bound(pure, lambda p: F.when(F.size(p) == 0, stuck).otherwise(bound(F.struct(digests(p, 1).alias("one"), digests(p, -1).alias("other")), taken)))
        return F.when(state["on"], next_).otherwise(state)

    none = F.array().cast("array<bigint>")
    start = F.struct(cells.alias("cells"), none.alias("one"), none.alias("other"), F.lit(True).alias("on"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step,
                       lambda s: F.when(F.size(s["cells"]) == 0, F.struct(s["one"].alias("one"), s["other"].alias("other"))))


def differing(one: Column, other: Column, first: Column, w: Column) -> Column:
    """(w, found): the digests that one of two sets holds alone, by side, and the size of the sketches that gave them.

    `first` is the difference of the sets' own sketches with `w` cells a table. Where it gets stuck, both are built anew four
    times as large, up to 4^(SIZES - 1) times; two sets that no size parts are compared themselves.
    """

    def attempt(state: Column, k: Column) -> Column:
        larger = (w * F.pow(F.lit(4.0), k)).cast("long")
        cells = F.when(k == 0, first).otherwise(combined(F.concat(entries(one, larger, 1), entries(other, larger, -1))))
        return F.when(state["found"].isNotNull(), state).otherwise(F.struct(larger.alias("w"), peeled(cells, larger).alias("found")))

    def whole(s: Column) -> Column:
        exact = F.struct(F.array_except(one, other).alias("one"), F.array_except(other, one).alias("other"))
        return F.struct(s["w"].alias("w"), F.coalesce(s["found"], exact).alias("found"))

    start = F.struct(long(0).alias("w"), F.lit(None).cast(FOUND).alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(SIZES - 1)), start, attempt, whole)


def compared(one: str, other: str) -> Column:
    """(w, found) of two sets from their columns (w, n, cells), the larger sketch folded to the size of the smaller."""
    a, b = F.col(f"{one}_print"), F.col(f"{other}_print")
    return bound(F.least(a["w"], b["w"]), lambda w: differing(
        F.col(one), F.col(other), difference(folded(a["cells"], a["w"], w), folded(b["cells"], b["w"], w)), w))


def likeness(one: Column, other: Column, found: Column) -> Column:
    """Size of the intersection over that of the union, by the numbers of digests of two fingerprints and of those that differ."""
    total, differ = one["n"] + other["n"], F.size(found["one"]) + F.size(found["other"])
    return F.when(total == 0, F.lit(1.0)).otherwise((total - differ) / (total + differ))


def fingerprint(digests: Column) -> Column:
    """(w, n, cells): a set's own sketch, its cells a table and its number of digests."""
    return bound(own_cells(digests), lambda w: F.struct(w.alias("w"), F.size(digests).alias("n"), sketch(digests, w).alias("cells")))


def shown(printed: Column) -> Column:
    """A fingerprint as text: cells a table, number of digests, and for each cell its number, count, digests and checks."""
    cells = F.transform(printed["cells"], lambda c: F.concat_ws(":", F.hex(c["c"]), c["n"].cast("string"), F.hex(c["k"]), F.hex(c["h"])))
    return F.concat_ws(";", printed["w"].cast("string"), printed["n"].cast("string"), F.array_join(cells, ","))


def neighbours(rows: DataFrame) -> DataFrame:
    """(provider, consumer, consumer_n): for each row key the one before it in descending order of ids, cyclically."""
    order = written(ranked(rows.select("row", "id", "n_chars").distinct(), F.col("id").desc_nulls_last(), F.col("row")).select("row", "n_chars", "position"), "order")
    count = order.count()
    before = order.select(F.col("row").alias("consumer"), F.col("n_chars").alias("consumer_n"), F.pmod(F.col("position") + 1, F.lit(max(1, count))).alias("_at"))
    return order.join(before, F.col("position") == F.col("_at")).select(F.col("row").alias("provider"), "consumer", "consumer_n")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, ...) of every row.

    The edited text has the last half of the code points replaced by the first as many of the next document. Peeling's
    results follow: `cells` and `next_cells` are the sizes that gave them, `removed` and `added` the digests that only the text
    or only the edited text holds, `own_only` and `next_only` those of the text and the next document.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    # Rows are known by 128 bits of their id and text, in one column, so that one dealing serves the join and what follows.
    row = F.concat(F.hex(F.xxhash64(F.col(id), value)), F.lit("-"), F.hex(F.xxhash64(value, F.col(id), F.lit("row"))))
    rows = docs.select(F.col(id).alias("id"), value.alias("text"), row.alias("row"), F.char_length(value).cast("long").alias("n_chars"))
    links = written(neighbours(rows), "neighbours")
    half = lambda n: F.floor(n / 2).cast("int")
    texts = rows.select("row", "id", "text")
    given = (texts.join(links, F.col("row") == F.col("provider")).dropDuplicates(["row"])
             .select("consumer", F.col("id").alias("next_id"), F.substring("text", F.lit(1), half(F.col("consumer_n"))).alias("tail"), paragraphs(F.col("text")).alias("following")))
    pairs = (texts.join(given, F.col("row") == F.col("consumer")).withColumn("n_chars", F.char_length("text").cast("long"))
             .withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half(F.col("n_chars"))).cast("int")), "tail")))
    sets = pairs.select("id", "next_id", "n_chars", "edited", paragraphs(F.col("text")).alias("own"), paragraphs(F.col("edited")).alias("changed"), "following")
    prints = sets.select("*", *(fingerprint(F.col(c)).alias(f"{c}_print") for c in ("own", "changed", "following")))
    own, changed, following = (F.col(f"{c}_print") for c in ("own", "changed", "following"))
    found = prints.select("id", "n_chars", "edited", "next_id", "own_print", "changed_print", "following_print",
                          compared("own", "changed").alias("edit"), compared("own", "following").alias("next"))
    return found.select(
        F.col("id").alias(id), "n_chars", "edited", shown(own).alias("fingerprint"), shown(changed).alias("edited_fingerprint"),
        likeness(own, changed, F.col("edit.found")).alias("near_edited"), likeness(own, following, F.col("next.found")).alias("near_next"), "next_id",
        F.col("edit.w").alias("cells"), F.col("edit.found.one").alias("removed"), F.col("edit.found.other").alias("added"),
        F.col("next.w").alias("next_cells"), F.col("next.found.one").alias("own_only"), F.col("next.found.other").alias("next_only"))
