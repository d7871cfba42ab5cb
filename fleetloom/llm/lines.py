"""Repeated and nearly repeated lines across documents, by MinHash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.functions.durable import durable
from fleetloom.llm.alike import alike_links
from fleetloom.llm.common import document_key, text_or_empty
from fleetloom.llm.components import components

# Lines are compared by their shingles of SHINGLE characters; signatures are made of those of MARK, of which
# unrelated prose shares fewer. A band has the EACH smallest hashes of one of BANDS draws.
SHINGLE, MARK, BANDS, EACH = 5, 7, 12, 4
# Sets of MARK shingles up to SMALL are drawn from whole, those from LARGE on part by part, those between both ways.
SMALL, LARGE = 60, 38
# Sets of so few shingles differ by one at most if they are alike.
TINY = 15


def at_characters(line: Column, width: int = SHINGLE) -> Column:
    """The set of the line's shingles at every character, each as a hash of 64 bits; a shorter line is one shingle.

    Cut from four bytes a character, so that a place is found without counting from the start of the line.
    """

    def cut(wide: Column) -> Column:
        last = F.greatest((F.octet_length(wide) / 4).cast("int") - width, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.substring(wide, 4 * i + 1, F.lit(4 * width))))

    # As the variable of a transform the wide form is made once, not once a shingle.
    return F.array_distinct(F.get(F.transform(F.array(F.encode(line, "UTF-32")), cut), F.lit(0)))


def _drawn(hashes: Column, each: int, kind: str) -> Column:
    """Bands of the smallest hashes of the whole set, by another order of the hashes in each."""
    smallest = lambda b: F.slice(F.sort_array(F.transform(hashes, lambda h: F.xxhash64(h, b))), 1, each)
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.lit(kind), b, smallest(b)))


def _parted(held: Column) -> Column:
    """Bands of the smallest hashes in each part of the hashes' range: sixteenths, of which as many are used as there are bands.

    ``held`` is sorted, so a part is a run.
    """
    part = lambda h: F.shiftright(h, 60)

    def band(h: Column, i: Column) -> Column:
        first = (part(h) < BANDS - 8) & ((i == 0) | (part(F.get(held, i - 1)) != part(h)))
        rest = [F.when(part(F.get(held, i + n)) == part(h), F.get(held, i + n)) for n in range(1, EACH)]
        return F.when(first, F.xxhash64(F.lit("parted"), h, *rest))

    return F.array_compact(F.transform(held, band))


def with_bands(lines: DataFrame) -> DataFrame:
    """The lines with ``bands``: hashes of which similar lines are likely to share one.

    For a draw, two sets of similarity s have their smallest hashes in common with a probability of about s to the power of their number.
    Lines of similarity 0.8 by 5 characters have at least about 0.73 by 7 (single characters changed far apart), and
    share one of 12 bands of four with about 0.99. Two sets that are alike are in one of the families together, as
    their sizes differ by a quarter at most.
    """
    none = F.array().cast("array<bigint>")
    # Sorted outside of any lambda, where hashes are sorted as plain numbers.
    marked = lines.withColumn("marks", F.sort_array(at_characters(F.col("line"), MARK)))
    marks, short = F.col("marks"), F.col("few")
    # Long lines have few shingles only if they repeat themselves.
    few = F.when((F.length("line") <= 2 * TINY) | (F.size(marks) <= 2 * TINY), at_characters(F.col("line")))
    tiny = F.when(F.size(short) <= TINY, _drawn(short, 2, "tiny"))
    whole = F.when((F.size(marks) <= SMALL) & (F.coalesce(F.size(short), F.lit(TINY)) >= TINY * 2 // 3), _drawn(marks, EACH, "whole"))
    parted = F.when(F.size(marks) >= LARGE, _parted(marks))
    bands = F.array_distinct(F.concat(*[F.coalesce(c, none) for c in (tiny, whole, parted)]))
    return marked.withColumn("few", few).withColumn("bands", bands).drop("marks", "few")


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``at, line_id, short, line`` for every line with a character that is no white space.

    ``at`` is where the line stands; it sorts by document id (none last), text and place. ``line_id`` is 128 bits
    of the line's SHA-256, ``short`` 64 bits of it.
    """
    placed = docs.select(
        F.col(id_col).isNull().alias("no_id"),
        F.col(id_col).alias("id"),
        F.xxhash64(text_or_empty(text_col)).alias("text_hash"),
        F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("place", "line"),
    ).where(F.col("line").rlike(r"\S"))
    digest = F.unhex(F.sha2("line", 256))
    return placed.select(
        F.struct("no_id", "id", "text_hash", "place").alias("at"), F.substring(digest, 1, 16).alias("line_id"), "line"
    ).withColumn("short", F.conv(F.hex(F.substring("line_id", 1, 7)), 16, 10).cast("long"))


def line_groups(docs: DataFrame, similar: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``line_id, first`` of every line that occurs more than once or is like another: where its group first stands.

    Equal lines are one, combined before the shuffle. Of distinct lines, those that share a band are candidates; they are compared
    by their sets of 5-character shingles at every character, and what is alike is joined by distributed union-find. A
    line that many others are compared with is a hot key of a join whose other side has it once. The lines of
    one band meet in one task, as two numbers each, which may spill.
    """
    lines = lines_of(docs, id_col, text_col)
    distinct = durable(
        with_bands(lines.select("line_id", "short", "at", "line"))
        .groupBy("line_id", "short")
        .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.first("bands").alias("bands"))
    )
    banded = distinct.select("short", F.explode("bands").alias("band"))
    held = F.count(F.lit(1)).over(Window.partitionBy("band"))
    members = durable(banded.withColumn("held", held).where("held > 1").drop("held"))
    texts = durable(
        lines.select("line_id", "short", "line")
        .join(members.select("short").distinct(), "short", "left_semi")
        .groupBy(F.col("line_id").alias("unit"), "short")
        .agg(F.first("line").alias("text"))
    )
    joined = components(alike_links(members, texts, at_characters, similar))
    # Lines that occur once and are like no other are most of all lines; they leave before the groups are looked at.
    hung = durable(
        distinct.join(joined, distinct["line_id"] == joined["node"], "left")
        .where((F.col("n") > 1) | F.col("root").isNotNull())
        .select("line_id", "first", "root")
    )
    first = hung.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("first").alias("of_group"))
    return hung.join(first, "root", "left").select("line_id", F.coalesce("of_group", "first").alias("first"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``key, text_hash, dropped``: the places (from 0) of the lines of a document that stand elsewhere already.

    Of each group of equal or similar lines the first stays: the one of the smallest document id, then by
    text and place. Documents that lose nothing are not listed. Lines of white space are never dropped.
    """
    groups = durable(line_groups(docs, id_col=id_col, text_col=text_col, **settings))
    lost = lines_of(docs, id_col, text_col).select("line_id", "at").join(groups, "line_id").where(F.col("at") != F.col("first"))
    key, _ = document_key("id", "id")
    return (
        lost.select(F.col("at.id").alias("id"), F.col("at.text_hash").alias("text_hash"), F.col("at.place").alias("place"))
        .groupBy(key.alias("key"), "text_hash")
        .agg(F.array_sort(F.collect_set("place")).alias("dropped"))
    )


def _repeated_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, text_hash, copies`` of the rows that share id and text with others, counted in the tasks first."""
    counted = docs.groupBy(*document_key(id_col, text_col)).agg(F.count(F.lit(1)).alias("copies"))
    return durable(counted.where("copies > 1"))


def _with_lines(text: Column) -> Column:
    """Places of the lines with a character that is no white space."""
    lines = F.split(text, "\n")
    placed = F.transform(lines, lambda line, place: F.when(line.rlike(r"\S"), place))
    return F.array_compact(placed)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``doc_id, n_lines, n_dropped, dropped`` for every row. NULL texts count as empty: one line, of nothing.

    Of rows that share id and text, or text if they have no id, one is the document and the others lose all
    their lines. Without documents there are no rows.
    """
    lost = durable(repeated_lines(docs, id_col, text_col, **settings))
    several = _repeated_rows(docs, id_col, text_col)
    keys = ["key", "text_hash"]
    text = text_or_empty(text_col)
    n_lines = F.size(F.split(text, "\n")).cast("long").alias("n_lines")
    rows = docs.select(F.col(id_col).alias("doc_id"), *document_key(id_col, text_col), n_lines)
    once = rows.join(several, keys, "left_anti").unionByName(_one_of_each(docs, several, id_col, text_col).select(*rows.columns))
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    kept = once.join(lost, keys, "left").select("doc_id", "n_lines", dropped.alias("dropped"))
    # All copies but one, counted out in two steps, so that no array is as long as there are copies.
    other = _one_of_each(docs, several, id_col, text_col).join(several, keys).where("copies > 1")
    step = 10_000
    outer = other.select("doc_id", "n_lines", "places", "copies", F.explode(F.expr(f"sequence(0, (copies - 2) div {step})")).alias("at"))
    counted = F.expr(f"sequence(1, least({step}, copies - 1 - at * {step}))")
    copies = outer.select("doc_id", "n_lines", F.col("places").alias("dropped"), F.explode(counted).alias("copy")).drop("copy")
    return kept.unionByName(copies).select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def _one_of_each(docs: DataFrame, several: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, key, text_hash, n_lines, places`` once for each id and text that several rows share."""
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), *document_key(id_col, text_col),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"), _with_lines(text).alias("places"),
    )
    keys = ["key", "text_hash"]
    firsts = [F.first(c).alias(c) for c in ("doc_id", "n_lines", "places")]
    return rows.join(several.select(*keys), keys, "left_semi").groupBy(*keys).agg(*firsts)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents without the lines that stand elsewhere already, in the columns they came with.

    Documents that lose nothing are as they were, NULL texts too. One that loses every line that is not
    white space is gone: all it says stands elsewhere. Of rows that share id and text, or text if they have no
    id, one stays, unless they have no line to lose.
    """
    lost = durable(repeated_lines(docs, id_col, text_col, **settings))
    lost = lost.select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash"), F.col("dropped").alias("_dropped"))
    several = _repeated_rows(docs, id_col, text_col).select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash"))
    key, text_hash = document_key(id_col, text_col)
    packed = docs.select(F.struct("*").alias("_row"), key.alias("_key"), text_hash.alias("_hash"))
    keys, says = ["_key", "_hash"], F.coalesce(F.col("_row")[text_col].rlike(r"\S"), F.lit(False))
    repeated = packed.where(says).join(several, keys, "left_semi").groupBy(*keys).agg(F.first("_row").alias("_row"))
    silent = packed.where(~says)
    once = packed.where(says).join(several, keys, "left_anti").unionByName(repeated.select(*packed.columns)).unionByName(silent)
    met = once.join(lost, keys, "left")
    text = F.col("_row")[text_col]
    left = F.filter(F.split(text, "\n"), lambda _, place: ~F.array_contains("_dropped", place))
    kept = met.select("_row", "_dropped", F.when(F.col("_dropped").isNull(), text).otherwise(F.array_join(left, "\n")).alias("_text"))
    kept = kept.where(F.col("_dropped").isNull() | F.col("_text").rlike(r"\S"))
    return kept.select(*[F.col("_text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
