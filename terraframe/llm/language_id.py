"""Language identification by compression.

A language's model is a raw-content zstandard dictionary: plain text of that
language. A text is cut into blocks; each block is compressed once with every
dictionary, and the language with the smallest total wins. If the runner-up is
within ``margin`` of the winner, the text is rejected.

Plan: one bounded, seeded sample for the dictionaries (an aggregate and one
filtered scan), then a scan with an Arrow map. Nothing is shuffled by language.
"""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import by_row, id_bucket, table

#: Bound of the sample: documents read per language, each whole. A language's dictionary is their text and nothing else.
SAMPLE_DOCS = 256
#: Bytes compressed at a time. Whole texts are scored, block by block: beyond a few KB a text's own past serves it better than any dictionary.
BLOCK_BYTES = 2048
#: Relative gap between the two smallest sizes under which a prediction is rejected.
MARGIN = 0.004
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalised(text: str) -> bytes:
    """Lower-case letters, anything else as one space."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def train(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", seed: int = 42, sample: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """A dictionary for each language of ``docs``, those with most documents first, from at most ``sample`` documents of each, by seeded hash of ``order``.

    ``sample`` is the one bound: the sampled documents are taken whole, however long, and a dictionary holds all of them. It
    also bounds the driver's memory, to so many documents a language. Rows with a null text or language, or
    without letters, are left out; repeated rows are drawn like any other. The languages are a
    catalogue: a dictionary each is held by the driver and sent to the workers. An empty table gives no dictionary.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return {}
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2 * sample / n)))])
    draw = F.xxhash64(F.col(order).cast("string"), F.lit(seed))
    # on average twice the bound remains; the rest goes by rank, texts behind
    drawn = rows.where(F.pmod(draw, F.lit(1 << 20)) < share[F.col(lang)] * (1 << 20)).select(F.col(lang).alias("lang"), draw.alias("h"), F.col(text).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text"), "text"))
    by: dict[str, list] = {}
    for r in drawn.withColumn("rank", rank).where(F.col("rank") <= sample).select("lang", "rank", "text").toLocalIterator():
        by.setdefault(r.lang, []).append((r.rank, normalised(r.text)))
    return {k: b"\n".join(t for _, t in sorted(v)) for k, v in sorted(by.items(), key=lambda x: (-counts[x[0]], x[0]))}


def compressors(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, raw in dictionaries.items():
        if len(raw) >= 8:
            # matches reach back over the whole dictionary
            window = min(zstandard.WINDOWLOG_MAX, max(zstandard.WINDOWLOG_MIN, (len(raw) + 2 * BLOCK_BYTES).bit_length()))
            params = zstandard.ZstdCompressionParameters.from_level(5, min_match=4, window_log=window, write_content_size=False, write_checksum=False, write_dict_id=False)
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            out.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=params)))
    return out


def classify(text: str | None, langs, margin: float = MARGIN) -> tuple[str, float, bool]:
    """(language, score, rejected). Score: gap / (gap + margin), so 0.5 at the rejection margin; ties, which go to the language that comes first, have score 0 and are rejected at any length."""
    b = normalised(text or "")
    if not b or not langs:
        return UNKNOWN, 0.0, not b
    # word ends count at the text's ends too
    b = b" " + b + b" "
    # the last block takes up to twice the size, so that no scrap of a few bytes decides
    cuts = [*range(0, max(1, len(b) - BLOCK_BYTES + 1), BLOCK_BYTES), len(b)] if len(b) >= BLOCK_BYTES else [0, len(b)]
    blocks = [b[i:j] for i, j in zip(cuts, cuts[1:], strict=False) if j > i]
    sizes = sorted((sum(len(c.compress(x)) for x in blocks), i) for i, (_, c) in enumerate(langs))
    best = langs[sizes[0][1]][0]
    if len(sizes) == 1:
        return best, 1.0, False
    gap = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return best, gap / (gap + margin), gap < margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Adds ``lang_pred``, ``lang_score`` and ``lang_rejected`` to every row.

    A text that is null or has no letter gets ``und``, score 0, rejected. If there is no dictionary, all
    text gets ``und`` and score 0, and none with a letter is rejected. Texts of any length are compressed whole, in
    blocks; repeated rows and equal texts get equal values. Columns of these three names are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")

    def row():
        langs = compressors(dictionaries)
        return lambda t: classify(t, langs, margin)

    return by_row(docs, row, [text], "lang_pred string, lang_score double, lang_rejected boolean")


def learned(docs: DataFrame) -> dict[str, bytes]:
    return train(docs.where(id_bucket("doc_id", 4) != 2))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = learned(docs)
    found = identify(docs.select("doc_id", "text", (id_bucket("doc_id", 4) == 2).alias("held_out")), dictionaries)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


QUERIES = {"op10_language_id": op10_language_id}
