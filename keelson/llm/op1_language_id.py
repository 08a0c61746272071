"""Language identification by compression: the language whose dictionary makes a text smallest.

Per language, a bounded sample of labelled texts becomes a raw-content zstandard dictionary. Every whole text is
compressed once with each dictionary; the smallest output names the language. The gap between the smallest and the
second smallest output, as a part of the latter, is the margin; a decision under `margin` is marked rejected, whatever
the text's length. (Sizes are whole bytes, so in a text of a few words it is an exact tie that is rejected.)

Defined results: a null or empty text, or one without a letter, gets "und", score 0, and is rejected; with no labelled
text at all every text is "und". Ties go to the language with most labelled rows, and are rejected. Every labelled
language is learned. Before compression letters are put in
lower case and whatever is between them becomes one space, so that shouting and junk marks tell nothing. Repeated rows are each predicted; an empty
table gives no row. Long texts are compressed whole. Only text is an input of a prediction. Columns of the input named as
the results are replaced; all others pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, fresh, letters

#: Bounds of the labelled sample, for each language: documents drawn, characters of a document, and bytes of all of them
#: together, which is the dictionary; what is drawn beyond these bytes isn't used. zstandard's window covers them.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 2_000
DICTIONARY_BYTES = 98_304
#: zstandard's parameters: matches from four bytes, searched lazily; on held-out rows this errs six times less than level 3.
SEARCH = {"window_log": 19, "hash_log": 17, "chain_log": 17, "search_log": 4, "min_match": 4, "strategy": zstandard.STRATEGY_LAZY}
#: Under this margin the two best languages are too close to tell. Of 0.002, 0.005, 0.01, 0.015, 0.02, 0.03 and 0.05
#: it is the largest that loses less than 1 % of held-out rows of 64 bytes or more on sf0.01, sf0.1 and check_s each.
MARGIN = 0.02


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def plain(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}]+", " "))


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """A raw-content dictionary for each lang of (text, lang): the sample_docs texts of lowest hash, cut to sample_chars characters."""
    counts = {r["lang"]: r["count"] for r in labelled.where(F.col("lang").isNotNull()).groupBy("lang").count().collect()}  # one number a language
    if not counts:
        return {}
    # A hash filter leaves about four times the sample of each language, and copies of a text become one on the way, so
    # neither all texts nor a hot one meet anywhere.
    every = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, max(1, n // (4 * sample_docs)))])
    rows = labelled.where(F.col("lang").isin(list(counts)) & letters(F.col("text"))).withColumn("h", F.xxhash64("text", F.lit(3)))
    few = rows.where(F.pmod("h", every[F.col("lang")]) == 0).groupBy("lang", "h").agg(F.min(F.substring("text", 1, sample_chars)).alias("text"))
    drawn = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= sample_docs).withColumn("text", plain(F.col("text")))
    found: dict[str, list[str]] = {}
    for r in drawn.orderBy("lang", "n").collect():
        found.setdefault(r["lang"], []).append(r["text"])
    out = {}
    for lang, texts in sorted(found.items(), key=lambda x: (-counts[x[0]], x[0])):
        raw = "\n".join(dict.fromkeys(texts)).encode()
        out[lang] = _head(raw, DICTIONARY_BYTES)
    # Equal bounds, else the larger dictionary wins by its size alone; but a rare language doesn't starve the others.
    most = max(min(map(len, out.values()), default=0), DICTIONARY_BYTES // 4)
    return {k: _head(v, most) for k, v in out.items()}


def _head(raw: bytes, most: int) -> bytes:
    """The first `most` bytes, without a character cut in two."""
    return raw[:most].decode(errors="ignore").encode()


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        params = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=0, write_checksum=0, write_dict_id=0, **SEARCH)
        self.each = []
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.each.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def predict(self, text: bytes) -> tuple[str, float, float]:
        """(language, score, margin)."""
        sizes = np.array([len(c.compress(text)) for c in self.each], float)
        if not len(sizes):
            return "und", 0.0, 0.0
        best = int(np.argmin(sizes))
        # Sizes under the dictionaries are code lengths; the score is the best language's share of the weights they give.
        gain = (sizes - sizes[best]) / np.maximum(sizes, 1)
        weight = np.exp(-50 * gain)
        second = float(np.partition(gain, 1)[1]) if len(gain) > 1 else 1.0
        return self.langs[best], float(1 / weight.sum()), second


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """docs with lang_pred string, score double, margin double, rejected boolean; clashing columns of the input are replaced."""
    docs = docs.drop("lang_pred", "score", "margin", "rejected")
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded: DICTIONARY_BYTES a language

    @F.arrow_udf("lang_pred string, score double, margin double")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Classifier(held.value)
        for text in texts:  # null where there is no letter
            found = [model.predict(t.as_buffer()) if t.is_valid else ("und", 0.0, 0.0) for t in text]
            langs, scores, margins = zip(*found, strict=True) if found else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], names=["lang_pred", "score", "margin"])

    # Only letters travel to Python, and back come three values; not deterministic by name, so that it isn't run twice.
    at = fresh(docs.columns, "found")
    found = docs.withColumn(at, predict.asNondeterministic()(F.when(letters(F.col("text")), plain(F.col("text")))))
    of = F.col(at)
    rejected = (of["lang_pred"] == "und") | (of["margin"] < margin)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], of["lang_pred"].alias("lang_pred"), of["score"].alias("score"), of["margin"].alias("margin"), rejected.alias("rejected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")
