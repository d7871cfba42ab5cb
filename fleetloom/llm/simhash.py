"""Near-duplicate documents by SimHash, compared bit plane by bit plane."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.functions.durable import durable
from fleetloom.llm.alike import alike_links
from fleetloom.llm.common import WORD, document_key, lower_ascii, text_or_empty
from fleetloom.llm.components import components

BITS = 64
SEED = 42
# Hashes that are unpacked at once, and (fingerprint, block) pairs that are compared at once.
HASHES, PAIRS = 1 << 16, 1 << 17
# Fingerprints of a bucket that meet in one task; larger buckets are cut into parts of this size.
CROWD = 1 << 13


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of the whole text, repeats included, in pieces; none without words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    shown = max(1, len(tokens) - words + 1)
    last = ends[min(words, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, shown, HASHES):
        cut = zip(starts[at : min(at + HASHES, shown)].tolist(), last[at : at + HASHES].tolist(), strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in cut], dtype="<u8")


def fingerprint_from(pieces: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half the hashes."""
    set_in, shown = np.zeros(BITS, dtype=np.int64), 0
    for hashes in pieces:
        set_in += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        shown += len(hashes)
    bits = np.packbits(2 * set_in > shown, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint_of(text: str | None, words: int = 4) -> int:
    """SimHash of the whole text as an unsigned number; NULL and texts without words have 0."""
    return fingerprint_from(shingle_hashes(text, words))


def fingerprint(text: Column, words: int = 4) -> Column:
    """The fingerprint as a signed 64-bit number."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return simhash(text)


def written(mark: Column) -> Column:
    return F.lpad(F.lower(F.hex(mark)), 16, "0")


def bit_planes(marks: np.ndarray) -> np.ndarray:
    """Vertical form of blocks of 64 fingerprints: word ``[p, b]`` has bit ``p`` of the 64 of block ``b``."""
    blocks = marks.reshape(-1, 64)
    bits = np.unpackbits(np.ascontiguousarray(blocks).view(np.uint8).reshape(len(blocks), 64, 8), axis=2, bitorder="little")
    lanes = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(lanes).view("<u8").reshape(BITS, len(blocks))


def within(queries: np.ndarray, block_of: np.ndarray, planes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a fingerprint and a block, the lanes of the block within ``radius`` differing bits.

    Returns the numbers of the pairs that have any, and a word of lanes for each. Three planes at a time go
    through a carry-save adder into vertical counters of three bits; a lane that exceeds the radius
    stays out, and a pair leaves once all its lanes are out.
    """
    if not 0 <= radius <= 4:
        raise ValueError("the counters hold a radius of 0 to 4")
    alive = np.arange(len(queries))
    zero = np.uint64(0)
    ones, twos, fours, out = (np.zeros(len(queries), dtype=np.uint64) for _ in range(4))

    def differing(p: int) -> np.ndarray:
        if p >= BITS:
            return np.zeros(len(alive), dtype=np.uint64)
        return planes[p, block_of] ^ (zero - ((queries >> np.uint64(p)) & np.uint64(1)))

    for p in range(0, BITS, 3):
        x, y, z = differing(p), differing(p + 1), differing(p + 2)
        u = x ^ y
        add, carry = u ^ z, (x & y) | (u & z)
        low = ones & add
        ones = ones ^ add
        v = carry ^ low
        high = (twos & v) | (carry & low)
        twos = twos ^ v
        out = out | (fours & high)
        fours = fours ^ high
        out = out | above(ones, twos, fours, radius)
        if p % 6 == 3:
            left = np.flatnonzero(~out)
            if len(left) < 0.8 * len(alive):
                alive, queries, block_of = alive[left], queries[left], block_of[left]
                ones, twos, fours, out = ones[left], twos[left], fours[left], out[left]
            if not len(alive):
                break
    hit = np.flatnonzero(~out)
    return alive[hit], ~out[hit]


def above(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count, 0 to 7, is above the radius."""
    if radius == 4:
        return fours & (ones | twos)
    if radius == 3:
        return fours
    if radius == 2:
        return fours | (twos & ones)
    if radius == 1:
        return fours | twos
    return fours | twos | ones


def linked(marks: np.ndarray, cells: np.ndarray, sides: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest that connects what is linked within each cell: pairs of places in ``marks``.

    Rows come sorted by cell. In a cell all of whose rows have side 0, all are compared with all;
    otherwise those of side 0 with those of side 1. Links are merged as they are found, so that a group
    of near copies leaves one link per member, however many pairs it has.
    """
    size = len(marks)
    firsts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    lengths = np.diff(np.r_[firsts, size])
    root = np.arange(size)
    one_sided = np.add.reduceat(sides, firsts) == 0
    block_rows, block_cell = [], []
    # Lanes without a row have place -1.
    for first, length, alone in zip(firsts.tolist(), lengths.tolist(), one_sided.tolist(), strict=True):
        rows = np.arange(first, first + length)
        if not alone:
            rows = rows[sides[rows] == 1]
        count = -(-len(rows) // 64)
        lanes = np.full(count * 64, -1)
        lanes[: len(rows)] = rows
        block_rows.append(lanes)
        block_cell.append((first, length, alone, count))
    lanes = np.concatenate(block_rows).reshape(-1, 64)
    planes = bit_planes(np.where(lanes >= 0, marks[lanes], 0))
    start = 0
    waiting_q, waiting_b, held = [], [], 0

    def compare() -> None:
        q, b = np.concatenate(waiting_q), np.concatenate(waiting_b)
        for at in range(0, len(q), PAIRS):
            qs, bs = q[at : at + PAIRS], b[at : at + PAIRS]
            pair, words = within(marks[qs], bs, planes, radius)
            for part in range(0, len(pair), PAIRS // 16):
                chosen, word = pair[part : part + PAIRS // 16], words[part : part + PAIRS // 16]
                bits = np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
                row, lane = np.nonzero(bits)
                one, other = qs[chosen[row]], lanes[bs[chosen[row]], lane]
                real = (other >= 0) & (other != one)
                merge(root, one[real], other[real])

    for first, length, alone, count in block_cell:
        rows = np.arange(first, first + length)
        if alone:
            # Each row with its own block and those after it: every pair once.
            own = (rows - first) // 64
            repeat = count - own
            waiting_q.append(np.repeat(rows, repeat))
            waiting_b.append(start + np.repeat(own, repeat) + _places(repeat))
        else:
            rows = rows[sides[rows] == 0]
            waiting_q.append(np.repeat(rows, count))
            waiting_b.append(start + np.tile(np.arange(count), len(rows)))
        start += count
        held += len(waiting_q[-1])
        if held >= PAIRS:
            compare()
            waiting_q, waiting_b, held = [], [], 0
    if held:
        compare()
    moved = np.flatnonzero(root != np.arange(size))
    return moved, root[moved]


def _places(repeat: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    total = int(repeat.sum())
    return np.arange(total) - np.repeat(np.cumsum(repeat) - repeat, repeat)


def merge(root: np.ndarray, one: np.ndarray, other: np.ndarray) -> None:
    """Join the sets of the linked places; ``root`` then has the smallest place of every set."""
    while len(one):
        a, b = root[one], root[other]
        apart = a != b
        one, other, a, b = one[apart], other[apart], a[apart], b[apart]
        if len(one):
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                shorter = root[root]
                if np.array_equal(shorter, root):
                    break
                root[:] = shorter


def _bounds(blocks: int) -> list[tuple[int, int]]:
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return list(zip(edges, edges[1:], strict=False))


def bucket_keys(count: int, radius: int, crowd: int) -> list[list[tuple[int, int]]]:
    """Which bits the keys of the tables have, so that any two fingerprints within the radius agree on one.

    Cut into n parts, two such fingerprints agree on n - radius of them at least: each choice of that many
    parts is a table. More parts make longer keys, for which there are more tables; there are as few as
    keep the usual bucket under a quarter of ``crowd``.
    """
    for parts in range(radius + 1, radius + 5):
        same = parts - radius
        tables = [list(c) for c in combinations(_bounds(parts), same)]
        least = min(sum(b - a for a, b in t) for t in tables)
        if count / 2**least <= crowd / 4 or parts == radius + 4:
            return tables
    raise AssertionError


def near_links(marks: DataFrame, radius: int = 4, crowd: int = CROWD) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints (column ``mark``) within the radius, and no others.

    Fingerprints that agree on a key meet in a bucket. A bucket of more than ``crowd`` is cut into parts
    by a hash, and each pair of parts is a cell of its own, so no task gets more than two parts and the
    comparisons of a hot bucket are spread out.
    """
    keys = bucket_keys(marks.count(), radius, crowd)

    def key(number: int, bits: list[tuple[int, int]]) -> Column:
        cut = [F.shiftrightunsigned("mark", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in bits]
        joined, shift = F.lit(0).cast("long"), 0
        for bits_of, (a, b) in zip(cut, bits, strict=True):
            joined, shift = joined.bitwiseOR(F.shiftleft(bits_of, shift)), shift + b - a
        return F.struct(F.lit(number).alias("table"), joined.alias("key"))

    placed = marks.select("mark", F.explode(F.array(*[key(i, bits) for i, bits in enumerate(keys)])).alias("at")).select("mark", "at.*")
    crowded = (
        placed.groupBy("table", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > crowd)
        .select("table", "key", F.ceil(F.col("n") / crowd).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64(F.lit(7), F.col("mark")), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    cells = (
        placed.join(crowded, ["table", "key"], "left")
        .withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(part))
        .withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(others)))
        .select(
            "table",
            "key",
            F.least("part", "other").alias("low"),
            F.greatest("part", "other").alias("high"),
            (F.col("part") > F.col("other")).cast("int").alias("side"),
            "mark",
        )
    )
    cell = ["table", "key", "low", "high"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, rows = [], 0

        def links(frame: pd.DataFrame) -> pd.DataFrame:
            marks = frame["mark"].to_numpy().view(np.uint64)
            places = frame[cell].to_numpy()
            numbers = np.cumsum(np.r_[False, (places[1:] != places[:-1]).any(axis=1)])
            a, b = linked(marks, numbers, frame["side"].to_numpy(), radius)
            return pd.DataFrame({"a": marks[a].view(np.int64), "b": marks[b].view(np.int64)})

        for batch in batches:
            kept.append(batch)
            rows += len(batch)
            if rows >= PAIRS // 2:
                frame = pd.concat(kept, ignore_index=True)
                # The last cell may go on in the next batch.
                whole = (frame[cell] != frame[cell].iloc[-1]).any(axis=1)
                kept, rows = [frame[~whole]], int((~whole).sum())
                if whole.any():
                    yield links(frame[whole])
        if rows:
            yield links(pd.concat(kept, ignore_index=True))

    spread = cells.repartition(*cell).sortWithinPartitions(*cell, "side")
    return spread.mapInPandas(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, crowd: int = CROWD
) -> DataFrame:
    """Which documents are near copies: ``doc_id, key, text_hash, mark, root, component_id``, one row per input row.

    Fingerprints within ``radius`` bits link, and a component is all that links reach. Only distinct
    fingerprints are compared, so copies cost nothing. ``root`` is the component's smallest fingerprint, and
    ``component_id`` its smallest document id; it is NULL if no document of the component has one. NULL and
    wordless texts have fingerprint 0 and link like others. Other columns are ignored.
    """
    mark = fingerprint(F.col(text_col), words).alias("mark")
    marked = durable(docs.select(F.col(id_col).alias("doc_id"), *document_key(id_col, text_col), mark))
    distinct = durable(marked.groupBy("mark").agg(F.min("doc_id").alias("least")))
    hung = components(near_links(distinct.select("mark"), radius, crowd))
    rooted = distinct.join(hung, distinct["mark"] == hung["node"], "left").select(
        "mark", "least", F.coalesce("root", "mark").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_mark = durable(rooted.select("mark", "root").join(least, "root"))
    return marked.join(of_mark, "mark").select("doc_id", "key", "text_hash", "mark", "root", "component_id")


def bands_of(hashes: np.ndarray, bands: int = 12, each: int = 4, small: int = 60, large: int = 38) -> list[int]:
    """Signed hashes of which sets that are alike are likely to share one.

    A band is of the ``each`` smallest hashes: of the whole set in another order each, for sets of up to
    ``small``; of a sixteenth of the hashes' range, for sets from ``large`` on. Sets of similarity 0.8 differ in size by a
    quarter at most, so both are in one of the two, and share one of 12 bands with a probability of 1 - (1 - 0.8^4)^12 or so.
    """
    held, found = np.unique(hashes), []
    if len(held) <= small:
        for band in range(bands):
            order = (held ^ np.uint64(0xA24BAED4963EE407 * (band + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9FB21C651E98DF25)
            order = (order ^ (order >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            found.append(xxhash.xxh64_intdigest(np.sort(order)[:each].tobytes(), band))
    if len(held) >= large:
        edges = np.searchsorted(held, np.arange(bands + 1, dtype=np.uint64) << np.uint64(60))
        for band, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)):
            if a < b:
                found.append(xxhash.xxh64_intdigest(held[a : min(a + each, b)].tobytes(), bands + band))
    return [x - (1 << 64) if x >> 63 else x for x in found]


def signature(text: Column, words: int = 5) -> Column:
    """The fingerprint of a text (``mark``) and its ``bands``."""

    @F.pandas_udf("mark long, bands array<long>")
    def sign(texts: pd.Series) -> pd.DataFrame:
        marks, bands = [], []
        for text in texts:
            pieces = list(shingle_hashes(text, words))
            marks.append(fingerprint_from(pieces))
            bands.append(bands_of(np.concatenate(pieces)) if pieces else [])
        return pd.DataFrame({"mark": np.array(marks, dtype=np.uint64).view(np.int64), "bands": bands})

    return sign(text)


def word_shingles(text: Column, words: int = 5) -> Column:
    """The set of the text's shingles of words, as hashes of 64 bits; fewer words are one shingle."""

    def cut(held: Column) -> Column:
        last = F.greatest(F.size(held) - words, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda at: F.xxhash64(*[F.get(held, at + i) for i in range(words)]))

    said = F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))
    return F.array_distinct(F.get(F.transform(F.array(said), cut), F.lit(0)))


def alike_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similar: tuple[int, int] = (4, 5), most: int = 24,
    radius: int = 4, crowd: int = CROWD,
) -> DataFrame:
    """Which documents are alike: ``doc_id, key, text_hash, root, component_id``, one row per input row.

    Documents link if the similarity of their sets of 5-word shingles is at least 0.8, exactly. Texts of the same
    words are one and only distinct ones are compared: those whose fingerprints link within ``radius`` bits as in
    :func:`near_duplicates`, and those that share a band, if their fingerprints differ in at most ``most`` of 64 bits.
    At a similarity of 0.8 these differ in about 10 bits, in more than 24 hardly ever; unrelated ones in 32.
    ``component_id`` is the smallest document id of a group. NULL and wordless texts are alike.
    """
    said = F.regexp_extract_all(lower_ascii(text_or_empty(text_col)), F.lit(WORD), F.lit(0))
    unit = F.substring(F.unhex(F.sha2(F.array_join(said, " "), 256)), 1, 16)
    rows = docs.select(F.col(id_col).alias("doc_id"), *document_key(id_col, text_col), unit.alias("unit"), signature(F.col(text_col), words).alias("sign"))
    marked = durable(rows.select("doc_id", "key", "text_hash", "unit", "sign.*"))
    short = F.conv(F.hex(F.substring("unit", 1, 7)), 16, 10).cast("long").alias("short")
    distinct = durable(marked.groupBy("unit").agg(F.first("mark").alias("mark"), F.first("bands").alias("bands"), F.min("doc_id").alias("least")))
    # What fingerprints link is a band of its own: its texts are compared like those of any other.
    hung = components(near_links(distinct.select("mark").distinct(), radius, crowd))
    near = distinct.join(hung, distinct["mark"] == hung["node"], "left").select(short, F.xxhash64(F.lit("mark"), F.coalesce("root", "mark")).alias("band"))
    banded = distinct.select(short, F.explode("bands").alias("band")).unionByName(near)
    held = F.count(F.lit(1)).over(Window.partitionBy("band"))
    members = durable(banded.withColumn("held", held).where("held > 1").drop("held"))
    # One text for each unit that shares a band: the one whose hash is the smallest.
    wanted = distinct.select("unit", "mark", short).join(members.select("short").distinct(), "short", "left_semi")
    named = marked.groupBy("unit").agg(F.min(F.struct("key", "text_hash")).alias("at")).join(wanted, "unit").select("unit", "mark", "short", "at.*")
    texts = docs.select(*document_key(id_col, text_col), text_or_empty(text_col).alias("text")).join(named, ["key", "text_hash"])
    texts = durable(texts.groupBy("unit", "short").agg(F.first("mark").alias("mark"), F.first("text").alias("text")))
    hung = components(alike_links(members, texts, lambda text: word_shingles(text, words), similar, most))
    rooted = distinct.join(hung, distinct["unit"] == hung["node"], "left").select("unit", "least", F.coalesce("root", "unit").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_unit = durable(rooted.select("unit", "root").join(least, "root"))
    return marked.join(of_unit, "unit").select("doc_id", "key", "text_hash", "root", "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[..., DataFrame] | None = None, **settings
) -> DataFrame:
    """One row of each group of near copies, that of the smallest id, in the columns it came with.

    ``find`` says which are near copies: :func:`near_duplicates`, or :func:`alike_documents`.

    Of a group without ids, and of rows that repeat an id, one stays as well: the choice depends on the
    rows alone.
    """
    found = durable((find or near_duplicates)(docs, id_col, text_col, **settings))
    best = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.min(F.struct("key", "text_hash")).alias("best")
    )
    times = found.groupBy("key", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    keepers = durable(best.select("best.*").join(times, ["key", "text_hash"])).select(
        F.col("key").alias("_key"), F.col("text_hash").alias("_hash"), F.col("times").alias("_times")
    )
    key, text_hash = document_key(id_col, text_col)
    packed = docs.select(F.struct("*").alias("_row"), key.alias("_key"), text_hash.alias("_hash"))
    kept = packed.join(keepers, ["_key", "_hash"])
    repeated = keepers.where("_times > 1")
    if not repeated.isEmpty():
        # Equal rows of one id: few, or the ids are no ids. The first by content stays.
        rank = F.row_number().over(Window.partitionBy("_key", "_hash").orderBy(F.xxhash64("_row")))
        first = kept.where("_times > 1").withColumn("_rank", rank).where("_rank = 1").drop("_rank")
        kept = kept.where("_times = 1").unionByName(first)
    return kept.select("_row.*")
