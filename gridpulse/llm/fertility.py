"""Quality rules by tokeniser fertility.

Two public vocabularies are the measure. What a vocabulary was fitted to, it writes in few tokens: characters per token fall when words
are broken by symbols, when the language isn't what it says, or in keys and dumps; the share of byte-fallback tokens rises with characters
outside the vocabulary; the entropy of the token distribution falls in lists and repetitions. Each language (else the text's main script) has a
band for each figure; a document outside a band is rejected. Figures of short texts scatter, so a band widens by ``slack / sqrt(tokens)``.
"""
from __future__ import annotations

import base64
import math
import unicodedata
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import run_folder, schema
from .encoding import PIECE_BPE, encoder, slices, vocabulary_path, words_of

MULTI_BPE = "byte_bpe_multi_50k.tiktoken"
WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: language or script: lowest and highest characters per token, highest byte-fallback share, lowest entropy over log2(tokens).
BANDS = {
    "en": (2.05, 9.0, 0.10, 0.40), "de": (2.07, 9.0, 0.10, 0.40), "fr": (1.88, 9.0, 0.10, 0.40), "es": (1.90, 9.0, 0.10, 0.40),
    "LATIN": (1.50, 9.0, 0.20, 0.35), "CYRILLIC": (1.00, 9.0, 0.20, 0.35), "GREEK": (0.60, 9.0, 0.30, 0.35), "ARABIC": (0.60, 9.0, 0.30, 0.35),
    "HEBREW": (0.60, 9.0, 0.30, 0.35), "CJK": (0.25, 6.0, 0.60, 0.35), "HIRAGANA": (0.25, 6.0, 0.60, 0.35), "HANGUL": (0.25, 6.0, 0.70, 0.35),
    "": (0.20, 9.0, 0.90, 0.30),
}
SLACK = 2.0


def main_script(text: str) -> str:
    """The script of most letters (first word of their Unicode names); empty if there is none."""
    counts: dict[str, int] = {}
    for char in set(text):
        if char.isalpha():
            script = unicodedata.name(char, "").split(" ")[0]
            counts[script] = counts.get(script, 0) + text.count(char)
    return max(sorted(counts), key=counts.get, default="")


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text, first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes: dict[str, int] = {}
    ranks = np.fromiter((codes.setdefault(w, len(codes)) for w in words), "i8", len(words))
    key, size = ranks[:n], len(codes)
    total = size
    for i in range(1, window):
        if total > (1 << 62) // size:  # too many for one number: windows so far get ranks
            key = np.unique(key, return_inverse=True)[1].astype("i8")
            total = int(key.max()) + 1
        key = key * size + ranks[i:n + i]
        total *= size
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = (counts[inverse] > 1).astype("i8")
    cover = np.zeros(len(words) + 1, "i8")
    cover[:n] += twice
    cover[window:window + n] -= twice
    return int((np.cumsum(cover) > 0).sum())


def base_figures(text: str, words: list[str]) -> tuple:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def entropy(ids: np.ndarray) -> float:
    """Bits per token of the token distribution."""
    if not len(ids):
        return 0.0
    p = np.bincount(ids)
    p = p[p > 0] / len(ids)
    return float(-(p * np.log2(p)).sum()) + 0.0


def verdict(band: tuple, slack: float, n: int, per_token: float, bytes_share: float, bits: float) -> str | None:
    """The band that the figures leave, or None."""
    low, high, most_bytes, least_bits = band
    wider = slack / math.sqrt(max(1, n))
    if per_token < low - wider:
        return "few_chars_per_token"
    if per_token > high + wider:
        return "many_chars_per_token"
    if bytes_share > most_bytes + wider:
        return "byte_fallback"
    if bits < (least_bits - wider) * math.log2(max(2, n)):
        return "low_entropy"
    return None


_MULTI: dict = {}


def _multi(folder: str | None):
    if folder not in _MULTI:
        import public_tokenizers
        import tiktoken
        with open(vocabulary_path(MULTI_BPE, folder), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _MULTI[folder] = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _MULTI[folder]


FIGURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, "
           "byte_share double, token_entropy double, base_failed boolean, reason string, kept boolean")


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str | None = "lang", bands: dict | None = None,
            slack: float = SLACK, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, tokenizers: str | None = None,
            with_row: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base figures, n_tokens (multilingual vocabulary), chars_per_token (by it), byte_share and token_entropy
    (byte-fallback vocabulary, word by word), base_failed, reason (base, or the band left; null if kept) and kept; ``with_row`` adds the row itself as a struct.

    A null or empty text has no words and fails the base rule; a language that is null, unknown or not there falls back on the text's script.
    Repeated rows get equal figures each; ids may be null; an empty table gives no row. Other columns are not read.
    """
    lang = F.col(language_column).cast("string") if language_column and language_column in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).cast("string").alias("t"), lang.alias("l"))
    bands, out_schema = BANDS if bands is None else bands, schema(f"doc_id long, {FIGURES}")
    if with_row:
        rows = docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).cast("string").alias("t"), lang.alias("l"), F.struct(*docs.columns).alias("row"))
        out_schema = out_schema.add("row", rows.schema["row"].dataType)

    def measured(batches):
        import pyarrow as pa
        pieces, multi = encoder(PIECE_BPE, tokenizers), _multi(tokenizers)
        first = pieces.pieces.piece_to_id("<0x00>")
        for batch in chain.from_iterable(slices(b, 1) for b in batches):
            texts = [t.as_py() or "" for t in batch.column(1)]
            words, out = [words_of(t) for t in texts], []
            for t, w, l, raw in zip(texts, words, batch.column(2).to_pylist(), pieces.encode_words(words)):
                base = base_figures(t, w)
                ids = np.frombuffer(raw, "<u4")
                n = len(multi.encode_ordinary(t))
                per_token = base[1] / n if n else 0.0
                share = float(((ids >= first) & (ids < first + 256)).mean()) if len(ids) else 0.0
                bits = entropy(ids)
                failed = base[0] < min_words or 100 * base[4] > max_repeat_percent * base[0]
                reason = "base" if failed else verdict(bands[l] if l in bands else bands.get(main_script(t), bands[""]), slack, n, per_token, share, bits)
                out.append((*base, n, per_token, share, bits, failed, reason, reason is None))
            kinds = [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.bool_(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds)), *batch.columns[3:]],
                                             names=["doc_id", *(x.split(" ")[0] for x in FIGURES.split(", ")), *batch.schema.names[3:]])

    return rows.mapInArrow(measured, out_schema)


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and the fertility verdict of all documents."""
    run_folder(spark, "fertility")
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
