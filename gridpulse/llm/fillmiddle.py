"""Fill-in-the-middle documents, cut at line borders by a learned rank index.

The ends of a text's lines, a growing series of offsets, are fitted by straight segments: as long as some slope keeps every offset within the error
bound, the segment goes on. The index stores start, offset and slope of each segment and, for each line, the residual of its prediction in one byte. A cut
at line r predicts its offset from r's segment and corrects it by r's residual, so it is exact.

A document is rearranged as ``<P>`` prefix ``<S>`` suffix ``<M>`` middle (psm) or ``<S>`` suffix ``<P>`` prefix ``<M>`` middle (spm); number and order are
drawn from a hash of its id, so a task that runs again gives the same rows.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import run_folder, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Seed, documents in a hundred that are rearranged, and of those the ones in spm order.
SEED, RATE, SPM_RATE = 7, 100, 50
#: A prediction is off by so many code points at most; residuals fit into a signed byte.
ERROR = 100
#: Lines of a segment at most, and binary places of a slope: together they keep the slope's own rounding below one code point.
LONGEST, PLACES = 1 << 16, 20
#: Characters of text in a batch that goes back to Spark.
BATCH_CHARS = 8_000_000

_MARKERS = re.compile(f"{PREFIX}|{SUFFIX}|{MIDDLE}")


def line_ends(text: str) -> np.ndarray:
    """Offsets in code points: 0 and the end of each line, the newline being its last character."""
    if not text:
        return np.zeros(1, "<i8")
    ends = np.cumsum([0, *(len(line) + 1 for line in text.split("\n"))], dtype="<i8")
    return ends[:-1] if text[-1] == "\n" else np.minimum(ends, len(text))


class RankIndex:
    """Rank -> offset of a growing series of offsets."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        if not 0 <= error <= 126:
            raise ValueError("the error bound must leave residuals in a signed byte")
        points, n, at = offsets.tolist(), len(offsets), 0
        starts, slopes = [], []
        while at < n:
            low, high, base, k = 0.0, float("inf"), points[at], at + 1
            while k < n and k - at < LONGEST:
                rise, run = points[k] - base, k - at
                least, most = max(low, (rise - error) / run), min(high, (rise + error) / run)
                if least > most:
                    break
                low, high, k = least, most, k + 1
            starts.append(at)
            slopes.append(round((low + high) / 2 * (1 << PLACES)) if k > at + 1 else 0)
            at = k
        self.starts, self.slopes = np.array(starts, "<i8"), np.array(slopes, "<i8")
        self.bases = offsets[self.starts]
        off = offsets - self.predict(np.arange(n))
        self.residuals = off.astype("i1")
        if (self.residuals != off).any():
            raise ArithmeticError("a residual beyond the error bound")

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.starts, ranks, "right") - 1
        return self.bases[segment] + (self.slopes[segment] * (ranks - self.starts[segment]) >> PLACES)

    def offsets(self, ranks) -> list[int]:
        """Exact offsets of some ranks: prediction and stored residual."""
        ranks = np.asarray(ranks)
        return (self.predict(ranks) + self.residuals[ranks]).tolist()


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers of a document; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def arrange(doc_id: int | None, text: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """(lines, form, code points of the prefix and of the middle, output)."""
    index = RankIndex(line_ends(text))
    n, (h1, h2, h3, h4) = len(index.residuals) - 1, draws(doc_id, seed)
    if not text or h3 % 100 >= rate or _MARKERS.search(text):
        return n, "plain", None, None, text
    first, second = index.offsets(sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < spm_rate:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    Cuts lie at line ends, a line being ``[^\\n]*\\n|[^\\n]+``. Empty texts and texts that hold a marker stay plain, so that every output can be
    taken apart again. A null text counts as empty; a null id draws from the seed alone; rows with equal ids draw equal numbers; an empty table gives
    no row; other columns are not read.
    """
    run_folder(docs.sparkSession, "fillmiddle")

    def fill(batches) -> Iterator:
        import pyarrow as pa
        kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

        def frame(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], schema=kinds)

        for batch in batches:
            rows, chars = [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                rows.append((i, *arrange(i, text, seed, rate, spm_rate)))
                chars += len(text)
                if chars > BATCH_CHARS:
                    yield frame(rows)
                    rows, chars = [], 0
            if rows:
                yield frame(rows)

    rows = docs.select(F.col(id_column).cast("long").alias("i"), text_of(text_column).alias("t"))
    return rows.mapInArrow(fill, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text an output was made of."""
    parts = F.split(output, _MARKERS.pattern, -1)
    return (F.when(form == "psm", F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2)))
            .when(form == "spm", F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))).otherwise(output))


def op13_fillmiddle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rearranged: the digests of the outputs and of the texts rebuilt from them."""
    done = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))
