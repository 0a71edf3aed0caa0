"""Language identification by compression.

Learning takes, per language, slices of ``slice_chars`` characters of up to ``docs_per_language`` training
documents (those with the least seeded hash of the id, so the choice does not depend on partitioning) and joins
them into a raw-content zstandard dictionary of at most ``dictionary_bytes``.  That bound is the whole model's:
languages x dictionary_bytes, sent to the executors.

Prediction lower-cases the whole text, cuts it into pieces of ``piece_bytes`` and compresses each with every
dictionary; the language with the smallest sum wins.  ``score`` is by how much of the second smallest sum the
smallest is less, from 0 to 1; a text is rejected when that margin is below ``min_margin``.

Defined results: a text that is null or has no letter is ``und`` with score 0, and rejected.  Equal sizes go to
the language with more training documents, then to the smaller name, and are rejected for their margin of 0.
Without training documents every text is ``und``; with one language only, all others win with score 1.  Rows are
independent; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busguard.llm.common import col, free_name, give_back, text_or_empty

DOCS_PER_LANGUAGE = 220
SLICE_CHARS = 500
DICTIONARY_BYTES = 110_000
LEVEL = 9
PIECE_BYTES = 4096
MIN_MARGIN = 0.0005
MAX_LANGUAGES = 1000
UNDETERMINED = "und"
PAD = b"\n" * 256  # costs all languages the same few bytes; without it zstandard stores short texts uncompressed

PREDICTED = "lang string, score double, rejected boolean"


def is_held_out(id: Column) -> Column:
    """Documents that learning must not see; null ids are neither learnt from nor held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(train: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
          docs_per_language: int = DOCS_PER_LANGUAGE, slice_chars: int = SLICE_CHARS,
          dictionary_bytes: int = DICTIONARY_BYTES, max_languages: int = MAX_LANGUAGES,
          seed: int = 5) -> list[tuple[str, bytes]]:
    """(language, dictionary) pairs, the language with the most training documents first.

    The model holds at most ``max_languages`` dictionaries of ``dictionary_bytes``; more languages raise a ValueError."""
    body = F.lower(col(train, text))
    rows = train.select(col(train, lang).alias("lang"), body.alias("body"), col(train, id).alias("id"),
                        F.xxhash64(F.lit(seed), col(train, id).cast("string"), F.lit("order")).alias("order"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("body").rlike(r"\p{L}") & F.col("id").isNotNull())
    counts = rows.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages")
    if not counts:
        return []
    # of the hash range, the share that holds four times the documents wanted: small groups, whatever the table's size
    share = F.create_map(*(F.lit(x) for r in counts
                           for x in (r["lang"], min(1.0, (4 * docs_per_language + 100) / r["count"]))))
    unit = (F.col("order") / F.lit(2.0 ** 64)) + F.lit(0.5)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "id", "body"))
    start = F.pmod(F.xxhash64(F.col("order")), F.greatest(F.length("body") - slice_chars, F.lit(1))).cast("int") + 1
    picked = (rows.filter(unit <= share[F.col("lang")])
              .select("lang", "order", "id", F.substring("body", start, F.lit(slice_chars)).alias("body"))
              .withColumn("place", place).filter(F.col("place") <= docs_per_language)
              .orderBy("lang", "place").collect())
    size = {r["lang"]: r["count"] for r in counts}
    parts: dict[str, list[str]] = {}
    for r in picked:
        parts.setdefault(r["lang"], []).append(r["body"])
    model = [(name, "\n".join(texts).encode()[:dictionary_bytes]) for name, texts in parts.items()]
    return sorted(model, key=lambda m: (-size[m[0]], m[0]))


class Classifier:
    """Compressors of all languages; see the module text."""

    def __init__(self, model: list[tuple[str, bytes]], level: int = LEVEL, piece_bytes: int = PIECE_BYTES,
                 min_margin: float = MIN_MARGIN):
        import zstandard
        self.piece_bytes, self.min_margin = piece_bytes, min_margin
        self.compressors = []
        for name, content in model:
            options = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0,
                                                                     write_dict_id=0)
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.compressors.append((name, zstandard.ZstdCompressor(dict_data=dictionary, compression_params=options)))

    def predict(self, text: str) -> tuple[str, float, bool]:
        if not self.compressors or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        raw = text.lower().encode()
        pieces = [raw[i:i + self.piece_bytes] + PAD for i in range(0, len(raw), self.piece_bytes)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for _, c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.compressors[0][0], 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / second
        return self.compressors[best][0], margin, margin < self.min_margin


def identify(docs: DataFrame, model: list[tuple[str, bytes]], text: str = "text", level: int = LEVEL,
             piece_bytes: int = PIECE_BYTES, min_margin: float = MIN_MARGIN, lang_as: str = "lang_pred",
             score_as: str = "score", rejected_as: str = "rejected") -> DataFrame:
    """``docs`` with the predicted language of each text, its margin, and whether the text is rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(sent.value, level, piece_bytes, min_margin)
        for batch in batches:
            yield pd.DataFrame([classifier.predict(t) for t in batch], columns=["lang", "score", "rejected"])
        del classifier
        give_back()

    res = free_name(docs, "language")
    out = docs.withColumn(res, run(text_or_empty(col(docs, text))))
    return out.withColumns({lang_as: F.col(res)["lang"], score_as: F.col(res)["score"],
                            rejected_as: F.col(res)["rejected"]}).drop(res)
