"""Benchmark passages in documents: a prefix-filtered join of shingles, verified over whole windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.functions.durable import durable
from fleetloom.llm.common import document_key, lower_ascii, text_or_empty

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Windows of the benchmark whose shingles are broadcast, at most about 11 of some 30 bytes each.
BLOCK = 200_000


def words_of(text_col: str = "text") -> Column:
    return F.regexp_extract_all(lower_ascii(text_or_empty(text_col)), F.lit(WORDS), F.lit(0))


def item_windows(items: DataFrame, width: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, window, size``: every run of ``width`` words of every item; a shorter item is one window.

    A window is its words with spaces between, which no word contains. Items without words have none.
    """
    split = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(text_col).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    cut = F.transform(starts, lambda at: F.array_join(F.slice("words", at, width), " "))
    return split.where(F.size("words") > 0).select(
        "item", F.explode(cut).alias("window"), F.least(F.size("words"), F.lit(width)).alias("size")
    )


def _run(words: Column, at: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(words, at + 1, length), " ")


def _window_parts(windows: DataFrame, shingle: int) -> DataFrame:
    """``window, size, length, offset, shingle`` of all shingles; a window shorter than a shingle is one itself."""
    length = F.least("size", F.lit(shingle))
    at = windows.select("window", "size", length.alias("length"), F.explode(F.sequence(F.lit(0), F.col("size") - length)).alias("offset"))
    return at.withColumn("shingle", _run(F.split("window", " "), F.col("offset"), F.col("length")))


def _shingles_of(words: Column, lengths: list[int]) -> Column:
    """``place, n_words, shingle`` of all shingles of a text; one at place -1, with no words, stands for the text.

    The words are the variable of a transform: they are made once a text, and no shingle carries them.
    """

    def taken(held: Column, at: Column, shown: Column) -> Column:
        return F.struct(at.alias("place"), F.size(held).cast("long").alias("n_words"), shown.alias("shingle"))

    def of_length(held: Column, length: int) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(held) - length, F.lit(0)))
        # Word by word: a slice would copy the whole array each time.
        run = lambda at: F.concat_ws(" ", *[F.get(held, at + i) for i in range(length)])
        return F.when(F.size(held) >= length, F.transform(places, lambda at: taken(held, at, run(at))))

    def of(held: Column) -> Column:
        text = F.array(taken(held, F.lit(-1), F.lit("")))
        return F.concat(text, *[F.coalesce(of_length(held, n), F.slice(text, 1, 0)) for n in lengths])

    return F.get(F.transform(F.array(words), of), F.lit(0))


def sought_shingles(docs: DataFrame, parts: DataFrame, few: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, key, text_hash, n_words, place, shingle`` wherever a document has a shingle of ``parts``, and at place -1 of each row.

    The texts are read and cut to words here and nowhere else. ``few`` says that the shingles are few enough to be sent
    to all tasks; otherwise those of the documents are shuffled to them.
    """
    lengths = sorted(r[0] for r in parts.select("length").distinct().collect())
    mark = docs.sparkSession.createDataFrame([("",)], "shingle STRING")
    sought = parts.select("shingle").distinct().unionByName(mark)
    cut = docs.select(
        F.col(id_col).alias("id"), *document_key(id_col, text_col), _shingles_of(words_of(text_col), lengths).alias("every")
    )
    # An outer generator has no filter inferred for it that would cut the texts a second time.
    placed = cut.select("id", "key", "text_hash", F.explode_outer("every").alias("at"))
    placed = placed.select("id", "key", "text_hash", "at.n_words", "at.place", "at.shingle")
    return placed.join(F.broadcast(sought) if few else sought, "shingle")


def occurrences(shingled: DataFrame, parts: DataFrame, few: bool) -> DataFrame:
    """``key, text_hash, n_words, start, size, window`` for every place where a document has a window.

    A document that contains a window has all its shingles, so it is enough to look for one: the prefix of a set
    join at full overlap. Shingles are counted over all documents, and the rarest of each window is taken; a
    window with a shingle that occurs nowhere is out. Where a document has the shingle, the window must lie
    within the document at that place. Then the words are compared: shingles that cover the
    window, one after the other, must stand at their places.
    """
    of_document = ["key", "text_hash", "n_words"]
    placed = shingled.where("place >= 0").select(*of_document, "place", "shingle")
    times = placed.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"))
    ranked = parts.join(durable(times), "shingle", "left")
    of_window = Window.partitionBy("window").orderBy(F.col("times").asc_nulls_first(), "offset")
    prefix = durable(
        ranked.withColumn("number", F.row_number().over(of_window))
        .where((F.col("number") == 1) & F.col("times").isNotNull())
        .select("shingle", "window", "size", "length", "offset")
    )
    start = F.col("place") - F.col("offset")
    candidates = (
        placed.join(F.broadcast(prefix) if few else prefix, "shingle")
        .where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        .select(*of_document, start.alias("start"), "size", "length", "window")
        .distinct()
    )
    # Offsets 0, one shingle on, two on, and so on, and the last one that fits: together these are all words.
    steps = F.sequence(F.lit(0), F.ceil(F.col("size") / F.col("length")).cast("int") - 1)
    covering = F.transform(steps, lambda i: F.least(i * F.col("length"), F.col("size") - F.col("length")))
    whole = ["start", "size", "window"]
    needed = candidates.select(*of_document, *whole, F.size(steps).alias("needed"), "length", F.explode_outer(covering).alias("offset"))
    needed = needed.select(
        *of_document, *whole, "needed",
        (F.col("start") + F.col("offset")).alias("place"),
        _run(F.split("window", " "), F.col("offset"), F.col("length")).alias("shingle"),
    )
    held = needed.join(placed.distinct(), [*of_document, "place", "shingle"])
    agreed = held.groupBy(*of_document, *whole, "needed").agg(F.count(F.lit(1)).alias("held"))
    return agreed.where("held = needed").select(*of_document, *whole)


def covered(spans: Column) -> Column:
    """How many places a sorted array of (start, end) covers."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def add(so_far: Column, span: Column) -> Column:
        fresh = F.greatest(span["end"] - F.greatest(span["start"], so_far["end"]), F.lit(0))
        return F.struct(
            F.greatest(so_far["end"], span["end"]).alias("end"), (so_far["total"] + fresh).cast("long").alias("total")
        )

    return F.aggregate(spans, zero, add, lambda done: done["total"])


def document_hits(
    docs: DataFrame,
    items: DataFrame,
    width: int = 13,
    shingle: int = 3,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """``id, key, text_hash, n_words`` of every row, and ``key, text_hash, n_words, n_hit, items`` of documents with a window.

    With at most ``block`` windows their shingles are sent to all tasks, which has a fixed bound; with more, the
    shingles of the documents are shuffled to them. The result is the same.
    """
    windows = durable(item_windows(items, width, item_id_col, item_text_col))
    distinct = windows.select("window", "size").distinct()
    few = distinct.count() <= block
    parts = durable(_window_parts(distinct, shingle))
    shingled = durable(sought_shingles(docs, parts, few, id_col, text_col))
    found = durable(occurrences(shingled, parts, few))
    of_document = ["key", "text_hash", "n_words"]
    hits = found.groupBy(*of_document).agg(
        covered(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))).alias("n_hit")
    )
    named = (
        found.select(*of_document, "window")
        .distinct()
        .join(windows.select("window", "item").distinct(), "window")
        .groupBy(*of_document)
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return shingled.where("place < 0").select("id", *of_document), durable(hits.join(named, of_document))


def contamination(docs: DataFrame, items: DataFrame, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``doc_id, n_words, n_hit, items, contaminated`` for every row of the documents.

    A word is hit if it lies in an occurrence of a window; a document is contaminated if at least one word in
    ``one_in`` is. Repeated rows of one id and text get the same result each. NULL texts have no words; NULL
    item ids are the item ''. Without items nothing is hit; without documents there are no rows.
    """
    rows, hits = document_hits(docs, items, id_col=id_col, text_col=text_col, **settings)
    joined = rows.join(hits.drop("n_words"), ["key", "text_hash"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text", **settings
) -> DataFrame:
    """The documents that are not contaminated, in the columns they came with."""
    _, hits = document_hits(docs, items, id_col=id_col, text_col=text_col, **settings)
    bad = hits.where(F.col("n_hit") * one_in >= F.col("n_words")).select(
        F.col("key").alias("_key"), F.col("text_hash").alias("_hash")
    )
    key, text_hash = document_key(id_col, text_col)
    packed = docs.select(F.struct("*").alias("_row"), key.alias("_key"), text_hash.alias("_hash"))
    return packed.join(bad, ["_key", "_hash"], "left_anti").select("_row.*")
