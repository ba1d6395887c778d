"""Language identification by compression: zstandard with a raw-content dictionary for each language; the smallest wins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import arrow_map, slices, texts

#: Bytes that hold no letter in UTF-8, as spaces.
SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass(frozen=True)
class LanguageModel:
    """dictionaries: language -> bytes of sampled text. level, chunk: of the compressor, and the bytes it gets at once,
    so that the dictionary tells in every part of a long text. min_margin: below it a prediction is rejected, after
    a second look at fine_level, whose matches may be of three bytes."""

    dictionaries: dict[str, bytes]
    level: int = 5
    fine_level: int = 13
    chunk: int = 16384
    min_margin: float = 0.005


def letters_only(text: str) -> bytes:
    """Lower case, UTF-8, each run of ASCII other than letters one space."""
    return b" ".join(text.lower().encode().translate(SPACED).split())


def fit_languages(docs: DataFrame, dictionary_bytes: int = 65536, docs_per_language: int = 256, excerpt_chars: int = 512, **settings) -> LanguageModel:
    """A dictionary for each language from a sample of labelled documents, which the parameters bound for each language.

    docs: doc_id, text, lang; rows without a text, a lang or a letter don't count. The sample takes the documents of
    least hash of doc_id in each language, up to docs_per_language, and of each an excerpt of up to excerpt_chars that
    begins at a place drawn by that hash from the whole text; of the excerpts, one after the other, the last
    dictionary_bytes. The same rows give the same model however they are partitioned. All languages are learned, however
    rare. No rows: a model without languages.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("lang"), F.col("text").alias("text")).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel({}, **settings)
    space = 1 << 30
    limits = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(space, -(-space * 4 * docs_per_language // n))))])
    key = F.pmod(F.xxhash64("id"), F.lit(space))
    drawn = rows.where(F.col("lang").isin(*counts) & (key < F.element_at(limits, F.col("lang"))))
    begin = F.pmod(F.xxhash64(F.lit("begin"), "id"), F.greatest(F.lit(1), F.length("text") - excerpt_chars + 1).cast("long")).cast("int") + 1
    drawn = drawn.select("lang", F.struct(key.alias("key"), F.substr("text", begin, F.lit(excerpt_chars)).alias("text")).alias("drawn"))
    taken = drawn.groupBy("lang").agg(F.slice(F.array_distinct(F.sort_array(F.collect_list("drawn"))), 1, docs_per_language).alias("drawn"))
    found = {}
    for r in taken.orderBy("lang").collect():
        content = b" ".join(x for d in r["drawn"] if (x := letters_only(d["text"])))[-dictionary_bytes:]
        if len(content) >= 8:
            found[r["lang"]] = content
    return LanguageModel(found, **settings)


def compressors(model: LanguageModel) -> dict:
    """language -> (compressor, the same for a second look)."""
    import zstandard

    bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    settings = [zstandard.ZstdCompressionParameters.from_level(model.level, **bare), zstandard.ZstdCompressionParameters.from_level(model.fine_level, min_match=3, **bare)]
    out = {}
    for lang, content in sorted(model.dictionaries.items()):
        both = []
        for parameters in settings:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=parameters)
            both.append(zstandard.ZstdCompressor(dict_data=data, compression_params=parameters))
        out[lang] = tuple(both)
    return out


def judge(text: str, languages: dict, model: LanguageModel) -> tuple[str, float, bool]:
    """(language, score, rejected). score: the share by which the best is smaller than the second, 1 with one language."""
    data = letters_only(text)
    if not any(c.isalpha() for c in text[:64]) and not any(c.isalpha() for c in text) or not languages:
        return "und", 0.0, True
    parts = [data[i : i + model.chunk] for i in range(0, len(data), model.chunk)]
    sizes = dict.fromkeys(languages, 0)
    for look in (0, 1):
        for lang, both in languages.items():
            sizes[lang] += sum(len(both[look].compress(p)) for p in parts)
        order = sorted((n, lang) for lang, n in sizes.items())
        margin = 1.0 if len(order) == 1 else 1 - order[0][0] / max(1, order[1][0])
        if margin >= model.min_margin:
            break
    return order[0][1], margin, margin < model.min_margin


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", whole_row: bool = False) -> DataFrame:
    """id, lang_pred, score (0 to 1), rejected; if asked, also row, a struct of all columns.

    The whole text is compressed with each language's dictionary and the smallest size wins, ties by name. Where the
    margin to the second is under min_margin, sizes at a finer level are added; rejected is set where it still is, and with `und`: for a null text, one without a letter, or a
    model without languages (score 0). Each row is judged alone, so repeated rows agree; an empty table gives no rows.
    Other columns are neither read nor returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = compressors(model)
        for batch in slices(batches, "text"):
            lang, score, rejected = zip(*(judge(x, languages, model) for x in texts(batch, "text")), strict=True)
            out = {"id": batch.column("id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected, pa.bool_())}
            yield pa.RecordBatch.from_pydict(out | ({"row": batch.column("row")} if whole_row else {}))

    kind = docs.schema[id_col].dataType.simpleString()
    row = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if whole_row else []
    schema = f"id {kind}, lang_pred string, score double, rejected boolean" + f", row {docs.schema.simpleString()}" * whole_row
    return arrow_map(docs, [F.col(id_col).alias("id"), F.col(text_col).alias("text"), *row], schema, run).withColumnRenamed("id", id_col)
