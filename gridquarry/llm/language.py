"""Language identification with language-bitmask n-gram filters: bit-sliced Bloom filters, popcounts, false-positive correction."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import held_out, map_texts, stage

UNKNOWN = "und"
#: Bound of what is learned: texts of each language, by hash of the id.
SAMPLE_TEXTS = 4000
#: An n-gram belongs to a language if it stands in this share of its sampled texts, and in two at least.
SHARE = 0.001
#: Hash functions of the filter, its cells for each n-gram of a language, and the bits of a hash that each function takes.
HASHES, PER_GRAM, BITS = 3, 16, 21


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text of each, whether each text has a letter): 3- and 4-grams of lower-cased letters; all else counts as one
    boundary sign, which stands only at an n-gram's ends."""
    padded = "\0" + "\0".join(texts) + "\0"
    lowered = padded.lower()
    if len(lowered) != len(padded):  # a few capitals have longer small forms; texts must keep their places
        lowered = "".join(c if len(c.lower()) != 1 else c.lower() for c in padded)
    codes = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    signs = np.where(letter, codes, 0).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths + 1) - lengths
    of = np.repeat(np.arange(len(texts)), lengths + 1)  # each text with the boundary before it
    out, where = [], []
    with np.errstate(over="ignore"):
        for n in (3, 4):
            inner = letter[1 : len(signs) - n + 2].copy()
            for j in range(2, n - 1):
                inner &= letter[j : len(signs) - n + 1 + j]
            at = np.flatnonzero(inner)
            code = np.zeros(len(at), np.uint64)
            for j in range(n):
                code = code * np.uint64(1_114_112) + signs[at + j]
            out.append(arrays.mix(code + np.uint64(n)))
            where.append(of[np.minimum(at + 1, len(of) - 1)])
    counts = np.concatenate([[0], np.cumsum(letter)])
    return np.concatenate(out), np.concatenate(where), counts[starts + lengths] > counts[starts]


@dataclass
class LanguageFilters:
    """languages; cells: for each cell the bits of all languages that set it, 64 languages a column; false_positives by language."""

    languages: list[str]
    cells: np.ndarray
    false_positives: np.ndarray

    def places(self, hashes: np.ndarray) -> list[np.ndarray]:
        return [((hashes >> np.uint64(BITS * h)) % np.uint64(len(self.cells))).astype(np.int64) for h in range(HASHES)]

    @classmethod
    def build(cls, languages: list[str], hashes: np.ndarray, language: np.ndarray) -> LanguageFilters:
        """The filter of n-grams (hashes, language: its number). Cells are as many as the largest language asks for."""
        most = int(np.bincount(language, minlength=1).max()) if len(language) else 0
        size = 1 << min(BITS, max(16, (PER_GRAM * most).bit_length()))
        found = cls(languages, np.zeros((size, max(1, -(-len(languages) // 64))), np.uint64), np.zeros(len(languages)))
        for at in found.places(hashes):
            np.bitwise_or.at(found.cells, (at, language // 64), np.uint64(1) << (language % 64).astype(np.uint64))
        fill = np.array([((found.cells[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
        found.false_positives = fill**HASHES
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language of each text, and the share of its n-grams that the language holds, false positives taken off."""
        hashes, of, has_letter = grams([x or "" for x in texts])
        n = np.bincount(of, minlength=len(texts)).astype(float)
        share = np.zeros((len(self.languages), len(texts)))
        places = self.places(hashes)
        for column in range(self.cells.shape[1]):
            own = self.cells[:, column]
            mask = own[places[0]]
            for at in places[1:]:
                mask &= own[at]
            for k in range(64 * column, min(64 * column + 64, len(self.languages))):
                hits = np.bincount(of[(mask >> np.uint64(k % 64)) & np.uint64(1) == 1], minlength=len(texts))
                p = self.false_positives[k]
                share[k] = np.clip((hits - n * p) / np.maximum(n * (1 - p), 1e-9), 0, 1)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = share.argmax(0)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, has_letter, strict=True)], np.where(has_letter, share.max(0), 0.0)


def learn_languages(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_texts: int = SAMPLE_TEXTS, share: float = SHARE) -> LanguageFilters:
    """Filters from labelled texts: a bounded sample (about sample_texts of each language, by hash of the id). A language's
    filter holds every n-gram that stands in the share of its sampled texts, and in two at least (in one, if there is only
    one), whatever other languages hold it too. Null or blank labels and null texts teach nothing."""
    known = df.where(F.col(lang_col).isNotNull() & (F.trim(lang_col) != "") & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")
    )
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    languages = list(sizes)
    if not languages:
        return LanguageFilters.build([], np.zeros(0, np.uint64), np.zeros(0, np.int64))
    span = 1 << 30
    limit = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(span, span * sample_texts // n))])
    sample = known.where(F.pmod(F.xxhash64("id", F.lit("language")), F.lit(span)) < limit[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in arrays.blocks(batch):
                hashes, of, _ = grams([x or "" for x in block.column("text").to_pylist()])
                names = block.column("lang").dictionary_encode()
                lang = names.indices.to_numpy()[of]
                own, once = names.indices.to_numpy(), arrays.distinct_pairs(of, hashes)  # each n-gram once a text
                for k, name in enumerate(names.dictionary.to_pylist()):
                    gram, n = np.unique(hashes[once][lang[once] == k], return_counts=True)
                    gram, n = [None, *gram.view(np.int64).tolist()], [int((own == k).sum()), *n.tolist()]  # null: texts
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counted = map_texts(sample.select("lang", "text"), count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = stage(counted, "grams")
    texts = counted.where("gram IS NULL").select("lang", F.col("n").alias("texts"))
    often = counted.where("gram IS NOT NULL").join(F.broadcast(texts), "lang").where(F.col("n") >= F.least(F.col("texts"), F.greatest(F.lit(2), F.lit(share) * F.col("texts"))))
    rows = often.select("lang", "gram").collect()  # of a bounded sample, and n-grams of several texts only
    index = {lang: k for k, lang in enumerate(languages)}
    return LanguageFilters.build(languages, np.array([r["gram"] for r in rows], np.int64).view(np.uint64), np.array([index[r["lang"]] for r in rows], np.int64))


def identify(df: DataFrame, filters: LanguageFilters, text_col: str = "text") -> DataFrame:
    """df's rows in struct "record", lang_pred and score (0 to 1). Whole texts are read. Texts that are null or have no letter are
    "und" with score 0; ties go to the language with more labelled texts. Equal texts get equal answers."""
    shared = df.sparkSession.sparkContext.broadcast(filters)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in arrays.blocks(batch):
                lang, score = shared.value.predict(block.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([block.column("record"), pa.array(lang, pa.string()), pa.array(score)], ["record", "lang_pred", "score"])

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"), F.col(text_col).alias("text"))
    return map_texts(rows, predict, f"record {rows.schema['record'].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(df: DataFrame, least: float = 0.1, **columns) -> DataFrame:
    """df without texts that have no letter (null and empty ones too), or of whose n-grams a share below least belongs to the
    best language; in df's own columns, which may have any names. Repeated rows fare alike; an empty table gives an empty
    one, and without labelled texts nothing is identified."""
    filters = learn_languages(df.where(~held_out(F.col(columns.get("id_col", "doc_id")))), **columns)
    return identify(df, filters, columns.get("text_col", "text")).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("record.*")


def op2_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = learn_languages(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), filters)
    return found.select(F.col("record.doc_id").alias("doc_id"), held_out(F.col("record.doc_id")).alias("held_out"), "lang_pred", "score")
