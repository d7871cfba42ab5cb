"""Scores of a class-based language model (Brown classes found by exchange)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.durable import discard, durable

# No word is empty, so the empty one stands for the end of a text.
END = b""
# Symbols are what is clustered: the end, what has no symbol of its own, endings, frequent words.
END_SYMBOL, REST_SYMBOL = 0, 1
# Distinct words that a task counts before it hands them on.
HELD = 1 << 20
# Neighbours of symbols that are handed on at once.
NEIGHBOURS = 1 << 18


def tokens_of(text: str | None) -> list[bytes]:
    """Words of the whole text with A-Z in lower case, and the end. NULL counts as empty."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    words.append(END)
    return words


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n`` over all texts, the end included. Tasks add up what they read, a shuffle adds up the tasks."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[bytes] = Counter()

        def handed() -> pd.DataFrame:
            words = [w.decode("utf-8", "replace") for w in found]
            return pd.DataFrame({"word": words, "n": np.fromiter(found.values(), dtype=np.int64, count=len(found))})

        for batch in batches:
            for text in batch["text"]:
                found.update(tokens_of(text))
                if len(found) > HELD:
                    yield handed()
                    found.clear()
        if found:
            yield handed()

    counted = texts.select(F.col(text_col).alias("text")).mapInPandas(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Symbols:
    """Words known by number (``head``, most frequent first), of which the first ``own`` have a symbol each, as
    have ``endings``; every other word has the symbol of its ending."""

    head: list[bytes]
    own: int
    endings: list[bytes]
    ending_bytes: int = 3

    def __post_init__(self):
        self.count = 2 + len(self.endings) + self.own
        self.number = {w: i for i, w in enumerate(self.head)}
        self.of_ending = {e: 2 + i for i, e in enumerate(self.endings)}
        self.of_head = np.array([self._symbol(i, w) for i, w in enumerate(self.head)], dtype=np.int64).reshape(-1)

    def __getstate__(self) -> dict:
        # Words have no space: they travel as one string, and are numbered again where they arrive.
        return {k: v for k, v in self.__dict__.items() if k not in ("head", "number")} | {"packed": b" ".join(self.head), "any": bool(self.head)}

    def __setstate__(self, state: dict) -> None:
        packed, some = state.pop("packed"), state.pop("any")
        self.__dict__.update(state)
        self.head = packed.split(b" ") if some else []
        self.number = {w: i for i, w in enumerate(self.head)}

    def _symbol(self, place: int, word: bytes) -> int:
        if word == END:
            return END_SYMBOL
        return 2 + len(self.endings) + place if place < self.own else self.of_tail(word)

    def of_tail(self, word: bytes) -> int:
        return self.of_ending.get(word[-self.ending_bytes :], REST_SYMBOL)

    def of_tokens(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1 for words that have none) and symbol of every token."""
        get = self.number.get
        numbers = np.array([get(w, -1) for w in tokens], dtype=np.int64)
        symbols = self.of_head[numbers] if len(self.head) else np.zeros(len(numbers), dtype=np.int64)
        tail = np.flatnonzero(numbers < 0)
        symbols[tail] = [self.of_tail(tokens[i]) for i in tail]
        return numbers, symbols


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of the largest ``n``, ties by ``word``.

    How many words have a count, by its six leading bits, says from which count on all are in; only those of the next
    few counts are put in order. Otherwise each task would hand ``most`` words to the driver.
    """
    cut = "greatest(length(bin(n)) - 6, 0)"
    floor = F.expr(f"shiftleft(shiftright(n, {cut}), {cut})")
    least, left = None, most
    for bound, words in sorted(counts.groupBy(floor.alias("bound")).count().collect(), reverse=True):
        if words > left:
            break
        least, left = bound, left - words
    else:
        return counts
    above = counts.where(F.col("n") >= least) if least is not None else counts.limit(0)
    return above.unionByName(counts.where(floor == bound).orderBy(F.desc("n"), "word").limit(left))


def choose_symbols(counts: DataFrame, head: int, own: int, endings: int, ending_bytes: int = 3) -> tuple[Symbols, np.ndarray]:
    """Symbols by counts over the whole training text, and the counts of the head words.

    The driver gets the ``head`` most frequent words, as one string, and the ``endings`` most frequent endings of others.
    """
    chosen = durable(most_frequent(counts, head))
    held = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word")))
    packed = chosen.agg(held.alias("held"), F.count(F.lit(1)).alias("rows"))
    found = packed.select(F.concat_ws(" ", "held.word").alias("words"), F.col("held.n").alias("n"), "rows").toArrow()
    discard(chosen)
    words = found["words"][0].as_py().encode().split(b" ") if found["rows"][0].as_py() else []
    times = -found["n"].chunk(0).values.to_numpy().astype(np.float64)
    named = counts.sparkSession.createDataFrame([(w.decode(),) for w in words[:own]], "word string")
    # The end always has a number and a symbol.
    if END not in words:
        words, times = [END, *words], np.r_[0.0, times]
    # As bytes, like the tasks cut them.
    ending = F.expr(f"right(hex(cast(word as binary)), {2 * ending_bytes})")
    common = (
        counts.join(F.broadcast(named), "word", "left_anti")
        .groupBy(ending.alias("ending"))
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "ending")
        .limit(endings)
        .collect()
    )
    kept = [bytes.fromhex(r.ending) for r in common if r.ending]
    return Symbols(words, min(own, len(words)), kept, ending_bytes), times


def pair_counts(texts: DataFrame, symbols: Symbols, text_col: str = "text") -> DataFrame:
    """``a, b, n``: how often each symbol follows each, over all texts; texts begin after an end."""
    size = symbols.count

    def counted(tokens: list[bytes]) -> pd.DataFrame:
        _, kinds = symbols.of_tokens(tokens)
        pairs, n = np.unique(kinds[:-1] * size + kinds[1:], return_counts=True)
        return pd.DataFrame({"a": pairs // size, "b": pairs % size, "n": n})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [END]
        for batch in batches:
            for text in batch["text"]:
                found.extend(tokens_of(text))
                if len(found) > HELD:
                    yield counted(found)
                    found = [END]
        yield counted(found)

    rows = texts.select(F.col(text_col).alias("text")).mapInPandas(count, "a int, b int, n long")
    return rows.groupBy("a", "b").agg(F.sum("n").alias("n"))


def between(pairs: DataFrame, of: np.ndarray, size: int) -> np.ndarray:
    """How often each of ``size`` classes follows each; ``of`` is the class of every symbol."""
    of = of.astype(np.int32)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size)
        for batch in batches:
            a, b, n = (batch[c].to_numpy() for c in ("a", "b", "n"))
            cells = of[a].astype(np.int64) * size + of[b]
            if len(cells) < len(table):
                cells, place = np.unique(cells, return_inverse=True)
                table[cells] += np.bincount(place, weights=n, minlength=len(cells))
            else:
                table += np.bincount(cells, weights=n, minlength=len(table))
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(table[cells].astype(np.int64))], names=["cell", "n"])

    found = pairs.select("a", "b", "n").mapInArrow(add, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(size * size)
    matrix[found["cell"].to_numpy()] = found["n"].to_numpy()
    return matrix.reshape(size, size)


def neighbours(pairs: DataFrame, half: int) -> DataFrame:
    """``symbol, held``: each symbol of one half (by hash) with the ``other`` symbols beside it and how often, ``n``.

    ``other`` is twice its number, one more if it stands after the symbol. A symbol has at most two entries for each other,
    however frequent it is.
    """
    sides = [
        pairs.select(F.col(symbol).alias("symbol"), (F.col(other) * 2 + side).alias("other"), "n")
        for side, (symbol, other) in enumerate((("b", "a"), ("a", "b")))
    ]
    mine = (F.col("symbol") != END_SYMBOL) & (F.pmod(F.xxhash64("symbol"), F.lit(2)) == half)
    dealt = sides[0].unionByName(sides[1]).where(mine).repartition("symbol").sortWithinPartitions("symbol")
    kind = pa.struct([("other", pa.int32()), ("n", pa.int64())])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0

        def packed(symbol: np.ndarray, other: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            firsts = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
            held = pa.StructArray.from_arrays([pa.array(other, pa.int32()), pa.array(n, pa.int64())], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[firsts, len(symbol)].astype(np.int32)), held)
            return pa.RecordBatch.from_arrays([pa.array(symbol[firsts], pa.int32()), lists], names=["symbol", "held"])

        for batch in batches:
            waiting.append([batch[c].to_numpy() for c in ("symbol", "other", "n")])
            rows += batch.num_rows
            if rows >= NEIGHBOURS:
                whole = [np.concatenate(c) for c in zip(*waiting, strict=True)]
                # The last symbol may go on in the next batch.
                cut = int(np.searchsorted(whole[0], whole[0][-1]))
                if cut:
                    yield packed(*[c[:cut] for c in whole])
                waiting, rows = [[c[cut:] for c in whole]], len(whole[0]) - cut
        if rows:
            yield packed(*[np.concatenate(c) for c in zip(*waiting, strict=True)])

    return dealt.mapInArrow(together, "symbol int, held array<struct<other: int, n: long>>")


def _weight(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 6) -> np.ndarray:
    """Class of every symbol by exchange: one after the other, symbols go where the likelihood of the class
    bigrams gains most, until a sweep moves none. The end keeps class 0 to itself."""
    size = len(bigrams)
    of = np.zeros(size, dtype=np.int64)
    frequency = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = [s for s in np.argsort(-frequency, kind="stable") if s != END_SYMBOL]
    for place, symbol in enumerate(order):
        of[symbol] = 1 + place % classes
    member = np.zeros((size, classes + 1))
    member[np.arange(size), of] = 1
    before, after = bigrams.T @ member, bigrams @ member  # [symbol, class]: counts of the class before, after it
    between = member.T @ after
    for _ in range(sweeps):
        moved = 0
        for w in order:
            old = of[w]
            into, out, own = before[w].copy(), after[w].copy(), bigrams[w, w]
            into[old] -= own
            out[old] -= own  # now without the symbol's bigrams with itself
            between[:, old] -= into
            between[old, :] -= out
            between[old, old] -= own
            columns = _weight(between + into[:, None]) - _weight(between)  # [class before, class tried]
            rows = _weight(between + out[None, :]) - _weight(between)  # [class tried, class after]
            at = np.diagonal(between)
            gain = columns.sum(axis=0) + rows.sum(axis=1)
            gain += -np.diagonal(columns) - np.diagonal(rows) + _weight(at + into + out + own) - _weight(at)
            comes, goes = between.sum(axis=0), between.sum(axis=1)
            gain -= _weight(comes + into.sum() + own) - _weight(comes) + _weight(goes + out.sum() + own) - _weight(goes)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            between[:, new] += into
            between[new, :] += out
            between[new, new] += own
            if new != old:
                moved += 1
                of[w] = new
                before[:, old] -= bigrams[w]
                before[:, new] += bigrams[w]
                after[:, old] -= bigrams[:, w]
                after[:, new] += bigrams[:, w]
        if not moved:
            break
    return of


def likelihood(table: np.ndarray) -> float:
    """Mean log probability of a class transition and of its second word's class, up to what no class changes."""
    whole = _weight(table).sum() - _weight(table.sum(axis=0)).sum() - _weight(table.sum(axis=1)).sum()
    return float(whole / max(table.sum(), 1.0))


def better_classes(pairs: DataFrame, of: np.ndarray, table: np.ndarray, half: int, held: DataFrame | None = None) -> pd.DataFrame:
    """``symbol, class`` of symbols of one half (by hash) whose class's exchange for another raises the likelihood.

    ``held`` are the :func:`neighbours` of that half, which stay the same over all rounds; so a round shuffles nothing. Of
    them come the counts of the classes before and after each symbol: at most two a class, however frequent it
    is. All symbols are tried against the same table of class transitions, each without its own part in its own class's counts.
    """
    held = neighbours(pairs, half) if held is None else held
    size, of = len(table), of.astype(np.int32)
    tables, sums = (table, table.T.copy()), (table.sum(axis=0), table.sum(axis=1))

    def better(symbols: np.ndarray, seen: np.ndarray) -> pd.DataFrame:
        old, rows = of[symbols], np.arange(len(symbols))
        gain = np.zeros((len(symbols), size))
        for side in (0, 1):
            whose, neighbour = np.nonzero(seen[:, side])
            n, counts = seen[whose, side, neighbour], tables[side][neighbour]
            change = _weight(counts + n[:, None]) - _weight(counts)
            now = counts[np.arange(len(n)), old[whose]]
            change[np.arange(len(n)), old[whose]] = _weight(now) - _weight(np.maximum(now - n, 0))
            have, first = np.unique(whose, return_index=True)
            if len(have):
                gain[have] += np.add.reduceat(change, first, axis=0)
            total = seen[:, side].sum(axis=1)
            shared = _weight(sums[side][None, :] + total[:, None]) - _weight(sums[side])
            now = sums[side][old]
            shared[rows, old] = _weight(now) - _weight(np.maximum(now - total, 0))
            gain -= shared
        gain[:, 0] = -np.inf
        new = gain.argmax(axis=1)
        moves = gain[rows, new] > gain[rows, old] + 1e-9
        return pd.DataFrame({"symbol": symbols[moves], "class": new[moves]}).astype("int32")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                beside = part["held"].flatten()
                other, n = beside.field(0).to_numpy(), beside.field(1).to_numpy()
                row = np.repeat(np.arange(part.num_rows), part["held"].value_lengths().to_numpy())
                cells = (row * 2 + (other & 1)) * size + of[other >> 1]
                seen = np.bincount(cells, weights=n, minlength=part.num_rows * 2 * size).reshape(-1, 2, size)
                yield pa.RecordBatch.from_pandas(better(part["symbol"].to_numpy(), seen), preserve_index=False)

    return held.mapInArrow(choose, "symbol int, class int").toArrow().to_pandas()


def spread_exchange(pairs: DataFrame, of: np.ndarray, classes: int, least_gain: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """Exchange of all symbols by rounds of Spark jobs, from given classes: classes, and their table of transitions.

    A round moves the symbols of one half at once. A round that does not raise the likelihood is taken back; when neither
    half raises it by ``least_gain`` a token, the exchange ends. So it ends by itself: the likelihood has a bound.
    """
    if not 0 < classes < 128:
        raise ValueError("1 to 127 classes")
    table = between(pairs, of, classes + 1)
    best, half, poor = likelihood(table), 0, 0
    halves = [durable(neighbours(pairs, half)) for half in (0, 1)]
    while poor < 2:
        moved = better_classes(pairs, of, table, half, halves[half])
        tried = of.copy()
        tried[moved["symbol"].to_numpy(dtype=np.int64)] = moved["class"].to_numpy(dtype=np.int64)
        following = between(pairs, tried, classes + 1) if len(moved) else table
        now = likelihood(following)
        poor = 0 if now >= best + least_gain else poor + 1
        if now > best:
            of, table, best = tried, following, now
        half = 1 - half
    for held in halves:
        discard(held)
    return of, table


@dataclass
class ClassModel:
    """Class transitions and word emissions, and the plain word frequencies to compare with."""

    symbols: Symbols
    class_of: np.ndarray  # by symbol
    transition: np.ndarray  # log10, [class before, class]
    class_words: np.ndarray  # training tokens by class
    class_types: np.ndarray  # distinct training words by class
    head_counts: np.ndarray
    train_tokens: int
    train_types: int
    added: float = 0.1

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 probability of words by their training counts, add-0.1."""
        return np.log10((counts + 0.1) / (self.train_tokens + 0.1 * (self.train_types + 1)))

    def emission(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 probability of words within their classes; each class has room for one unknown word, but the end."""
        room = self.class_words[classes] + self.added * (self.class_types[classes] + 1)
        return np.where(classes == 0, 0.0, np.log10((counts + self.added) / room))


def transitions(table: np.ndarray, pull: float = 5.0) -> np.ndarray:
    """log10 probability of each class after each; pulled to the class's share of all as if seen ``pull`` times."""
    share = (table.sum(axis=0) + 0.5) / (table.sum() + 0.5 * len(table))
    return np.log10((table + pull * share) / (table.sum(axis=1, keepdims=True) + pull))


def fit(
    training: DataFrame,
    text_col: str = "text",
    head: int = 100_000,
    own: int = 600,
    endings: int = 400,
    classes: int = 64,
    least: int = 5,
    counts: DataFrame | None = None,
) -> tuple[ClassModel, DataFrame]:
    """The model and the table of word counts, both over all training texts.

    Counts of words, pairs and classes cover everything. Of the ``head`` most frequent words each that occurs ``least`` times
    has a class by its own neighbours, so what is learned grows with the corpus; other words share the class of their
    ending, known or not. The exchange begins on the driver, with the ``own`` most frequent words and the
    ``endings`` most frequent endings of all others, and goes on over all words of the head in Spark jobs. The driver
    has a class per word of the head and tables of classes.
    """
    counts = durable(word_counts(training, text_col)) if counts is None else counts
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    seeds, head_counts = choose_symbols(counts, head, own, endings)
    frequent = int((head_counts >= least).sum())
    symbols = Symbols(seeds.head, max(seeds.own, frequent), seeds.endings, seeds.ending_bytes)
    pairs = durable(pair_counts(training, symbols, text_col))
    # Seeds are numbered like symbols; a word of the head that is no seed begins with the class of its ending.
    seed_of = np.arange(symbols.count)
    seed_of[seeds.count :] = [seeds.of_tail(w) for w in symbols.head[seeds.own : symbols.own]]
    started = exchange(between(pairs, seed_of, seeds.count), classes)
    class_of, table = spread_exchange(pairs, started[seed_of], classes)
    discard(pairs)

    def by_class(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, distinct = np.zeros(classes + 1, dtype=np.int64), np.zeros(classes + 1, dtype=np.int64)
        for batch in batches:
            _, kinds = symbols.of_tokens([w.encode() for w in batch["word"]])
            words += np.bincount(class_of[kinds], weights=batch["n"], minlength=classes + 1).astype(np.int64)
            distinct += np.bincount(class_of[kinds], minlength=classes + 1)
        yield pd.DataFrame({"class": np.arange(classes + 1), "words": words, "types": distinct})

    summed = counts.mapInPandas(by_class, "class int, words long, types long").groupBy("class").agg(F.sum("words"), F.sum("types"))
    class_words, class_types = np.zeros(classes + 1), np.zeros(classes + 1)
    for number, words, distinct in summed.collect():
        class_words[number], class_types[number] = words, distinct
    model = ClassModel(
        symbols, class_of, transitions(table), class_words, class_types, head_counts, int(total), int(types)
    )
    return model, counts


def score(docs: DataFrame, model: ClassModel, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score``, one row per input row.

    The classes of a text's words follow from the words alone, so transitions are summed where the text is
    read, as are the words of the head. Other words leave as (row, word, class, times) and meet the
    table of counts by a join; such words are rare by definition, so no key of that join is hot.
    NULL texts count as empty and have the end only. Other columns are ignored.
    """
    symbols = model.symbols

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 40
        head_class = model.class_of[symbols.of_head]
        head_base = model.base(model.head_counts)
        head_emission = model.emission(model.head_counts, head_class)
        head_known = model.head_counts > 0
        for batch in batches:
            rows, words, kinds, times, sums = [], [], [], [], []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                tokens = tokens_of(text)
                numbers, symbol = symbols.of_tokens(tokens)
                of = model.class_of[symbol]
                known = numbers[numbers >= 0]
                sums.append(
                    (
                        row,
                        doc,
                        len(tokens),
                        int(head_known[known].sum()),
                        float(head_base[known].sum()),
                        float(model.transition[np.r_[0, of[:-1]], of].sum() + head_emission[known].sum()),
                    )
                )
                tail = np.flatnonzero(numbers < 0)
                for (word, kind), n in Counter((tokens[i], of[i]) for i in tail.tolist()).items():
                    rows.append(row)
                    words.append(word.decode("utf-8", "replace"))
                    kinds.append(kind)
                    times.append(n)
                row += 1
            whole = pd.DataFrame(sums, columns=["row", "doc_id", "n_tokens", "n_known", "base_score", "score"])
            whole["doc_id"] = whole["doc_id"].astype(object).where(whole["doc_id"].notna(), None)
            yield whole.assign(word=None, **{"class": None, "times": None})[columns]
            if rows:
                part = pd.DataFrame({"row": rows, "word": words, "class": kinds, "times": times})
                yield part.assign(doc_id=None, n_tokens=None, n_known=None, base_score=None, score=None)[columns]

    kind = docs.schema[id_col].dataType.simpleString()
    columns = ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "word", "class", "times"]
    schema = "row long, doc_id string, n_tokens long, n_known long, base_score double, score double, word string, class int, times long"
    plain = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    both = durable(plain.mapInPandas(read, schema))
    room = F.array(*[F.lit(float(n + model.added * (t + 1))) for n, t in zip(model.class_words, model.class_types, strict=True)])
    n = F.coalesce("n", F.lit(0))
    base = F.log10((n + 0.1) / (model.train_tokens + 0.1 * (model.train_types + 1)))
    emitted = F.log10((n + model.added) / F.get(room, F.col("class")))
    of_tail = (
        both.where(F.col("word").isNotNull())
        .select("row", "word", "class", "times")
        .join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known"),
            F.sum(F.col("times") * base).alias("base"),
            F.sum(F.col("times") * emitted).alias("emitted"),
        )
    )
    whole = both.where(F.col("word").isNull()).join(of_tail, "row", "left")
    nothing = F.lit(0)
    return whole.select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", nothing)).alias("n_known"),
        (F.col("base_score") + F.coalesce("base", nothing)).alias("base_score"),
        (F.col("score") + F.coalesce("emitted", nothing)).alias("score"),
    )
