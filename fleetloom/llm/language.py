"""Language identification by compression against one dictionary per language."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"


def fit_dictionaries(
    training: DataFrame,
    docs_per_language: int = 400,
    chars_per_doc: int = 2000,
    dictionary_bytes: int = 1 << 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> dict[str, bytes]:
    """Raw-content dictionaries by language, the language with most training rows first.

    The fit uses a bounded sample: of each language at most ``docs_per_language`` texts, picked by a
    hash of their id, at most ``chars_per_doc`` characters from the middle of each, cut to
    ``dictionary_bytes`` in all. The driver holds that much per language. Rows without text or
    language teach nothing.
    """
    known = training.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = known.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").collect()
    if not sizes:
        return {}
    # About twice the sample passes its language's threshold on the hash; the driver keeps the smallest.
    draw = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    limits = [F.lit(x) for lang, n in sizes for x in (lang, int(min(1.0, (2 * docs_per_language + 50) / n) * (1 << 30)))]
    length = F.length(text_col)
    start = F.greatest((length - chars_per_doc) / 2, F.lit(0)).cast("int") + 1
    drawn = (
        known.where(draw < F.create_map(*limits)[F.col(lang_col)])
        .select(F.col(lang_col), draw.alias("draw"), F.col(id_col), F.substring(text_col, start, chars_per_doc))
        .orderBy("draw", id_col)
        .limit(len(sizes) * (4 * docs_per_language + 100))
        .collect()
    )
    texts: dict[str, list[str]] = {lang: [] for lang, _ in sizes}
    for lang, _, _, text in drawn:
        texts[lang].append(text)
    return {
        lang: "\n".join(found[:docs_per_language]).lower().encode()[:dictionary_bytes] for lang, found in texts.items()
    }


def _compressors(dictionaries: dict[str, bytes], level: int) -> list[zstandard.ZstdCompressor]:
    made = []
    for content in dictionaries.values():
        # An empty dictionary is no dictionary: such a language learned only from empty texts.
        raw = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=level)
        made.append(
            zstandard.ZstdCompressor(
                level=level, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False
            )
        )
    return made


def classifier(
    dictionaries: dict[str, bytes],
    level: int = 6,
    close_level: int = 19,
    block_bytes: int = 4096,
    narrow: float = 0.01,
) -> Callable[[str | None], tuple[str, float, bool]]:
    """A function from a text to (language, score, rejected).

    The whole text is compressed block by block with each dictionary, so that it is the dictionary
    and not the text before it that helps. The smallest sum of sizes wins. Where the two best are
    closer than ``narrow`` (a share of the size), the text is compressed once more by the slower
    ``close_level``; margins still narrow are rejected: the best guess is returned and marked. Ties
    go to the language with more training rows. The score is 0.5 at a tie and nears 1 with the margin.
    """
    langs = list(dictionaries)
    fast, close = _compressors(dictionaries, level), []

    def sizes(data: bytes, compressors) -> list[int]:
        return [sum(len(c.compress(data[i : i + block_bytes])) for i in range(0, len(data), block_bytes)) for c in compressors]

    def classify(text: str | None) -> tuple[str, float, bool]:
        if not langs or text is None or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        data = text.lower().encode("utf-8", "replace")
        found = sizes(data, fast)
        best, second = (sorted(found) + [2 * found[0]])[:2]
        margin = (second - best) / second
        if margin < narrow:
            if not close:
                close.extend(_compressors(dictionaries, close_level))
            found = [a + b for a, b in zip(found, sizes(data, close), strict=True)]
            best, second = sorted(found)[:2]
            margin = (second - best) / second
        return langs[found.index(best)], 0.5 + 0.5 * min(1.0, 10 * margin), margin < narrow

    return classify


def identify_language(text: Column, dictionaries: dict[str, bytes], **settings) -> Column:
    """Struct of language, score (0 to 1) and whether the margin was too narrow to be trusted.

    Only the text is an input. A text that is NULL or has no letter is ``und`` with score 0, as is
    any text if nothing was learned.
    """

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classify = classifier(dictionaries, **settings)
        for texts in batches:
            yield pd.DataFrame([classify(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return identify(text)
