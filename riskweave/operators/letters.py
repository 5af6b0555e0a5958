"""A model of letter pairs, fitted on texts, that tells language from noise: it ranks the shifts of a shifted text, and finds carriers whose letters spell something.

``fit`` counts pairs of neighbouring letters a-z inside words over all texts (map-side, 676 groups whatever the input), so what reaches the driver is
bounded by the alphabet. Scores are whole numbers, 256 to a bit, so they are the same in every order of summing.

Defined results: null and texts without two neighbouring letters have no shift and no score; very long texts are read whole; of equal
shifts the smallest counts; without any text all pairs are equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import read_numbers

LETTERS = "abcdefghijklmnopqrstuvwxyz"
UNIT = 256
#: Bits a pair by which a shifted reading must be likelier than the written one, and pairs that a text must have.
MARGIN, PAIRS = 1.0, 8
#: Bits by which letters must be likelier as a word than as letters drawn one by one, and letters that a carrier must have.
SPELLS, CARRIER = 10.0, 5
SHIFTED = "struct<text:string,shift:int,pairs:long,written:long,score:long,digits:string>"
SPELLED = "struct<word:string,bits:long>"
MIRROR = 26


@dataclass(frozen=True)
class Letters:
    """pairs[a][b] is the score of b after a, alone[b] that of b by itself."""

    pairs: tuple[tuple[int, ...], ...]
    alone: tuple[int, ...]


def pairs_of(text: Column) -> Column:
    """All pairs of neighbouring letters of a folded text."""
    return F.regexp_extract_all(text, F.lit("(?=([a-z][a-z]))"), F.lit(1))


def scores(counts: np.ndarray) -> np.ndarray:
    """Scores of a row of counts, each raised by one."""
    return np.rint(UNIT * np.log2((counts + 1) / (counts.sum() + counts.size))).astype(np.int64)


def fit(texts: DataFrame, column: str) -> Letters:
    """The model of a column of folded texts, whole, all rows. Each Arrow batch gives one row for each of its different pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros(676, np.int64)
            for t in batch.column(0).to_pylist():
                counts += pair_counts(t)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["pair", "n"])

    found = texts.select(column).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # at most 676 rows
    counts = np.zeros((26, 26), np.int64)
    for pair, n in found:
        counts[divmod(pair, 26)] = n
    return Letters(tuple(tuple(scores(row).tolist()) for row in counts), tuple(scores(counts.sum(axis=0)).tolist()))


def codes_of(text: str) -> np.ndarray:
    """Letters as 0 to 25, all else as -1."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) - ord("a")
    return np.where((points >= 0) & (points < 26), points, -1)


def pair_counts(text: str | None) -> np.ndarray:
    """How often each of the 676 pairs of neighbouring letters stands in a folded text."""
    codes = codes_of(text) if text else np.zeros(0, np.int64)
    a, b = codes[:-1], codes[1:]
    return np.bincount((a * 26 + b)[(a >= 0) & (b >= 0)], minlength=676) if codes.size > 1 else np.zeros(676, np.int64)


def readings(model: np.ndarray) -> np.ndarray:
    """For each shift (26: the mirrored alphabet) the scores of written pairs once read back, 27 x 676."""
    at = np.arange(26)
    back = [*((at - k) % 26 for k in range(26)), 25 - at]
    return np.stack([model[b][:, b].ravel() for b in back])


def moved(text: str, shift: int) -> str:
    """A text read back from a shift."""
    turned = LETTERS[::-1] if shift == MIRROR else LETTERS[-shift % 26 :] + LETTERS[: -shift % 26]
    return text.translate(str.maketrans(LETTERS, turned))


def unshifted(texts: Column, model: Letters, digits: bool = True) -> Column:
    """struct<text, shift, pairs, written, score, digits> of folded texts: the likeliest reading, its shift, the number of pairs, the scores as written and as
    read, and the reading's digits with number words read (null if they are not asked for)."""
    table = readings(np.array(model.pairs))

    def read(column: pd.Series) -> pd.DataFrame:
        rows = []
        for t in column:
            counts = pair_counts(t)
            total = table @ counts
            if not counts.any():
                rows.append((None, None, 0, None, None, None))
                continue
            k = int(total.argmax())
            plain = moved(t, k)
            said = "".join(c for c in read_numbers(plain)[0] if c in "0123456789") if k and digits else None
            rows.append((plain, k, int(counts.sum()), int(total[0]), int(total[k]), said))
        return pd.DataFrame(rows, columns=["text", "shift", "pairs", "written", "score", "digits"], dtype=object)

    return F.pandas_udf(read, SHIFTED)(texts)


def surely(read: Column) -> Column:
    """Whether a reading of unshifted() has enough pairs and is likelier than the written text by MARGIN bits a pair."""
    return (read["shift"] > 0) & (read["pairs"] >= PAIRS) & (read["score"] - read["written"] >= read["pairs"] * int(MARGIN * UNIT))


def spelling(carriers: Column, model: Letters) -> Column:
    """struct<word, bits>: of an array of texts whose letters might spell something the one that is likeliest as a word (bits in 1/256), of at least
    CARRIER letters; of equal ones the first."""
    pairs, alone = np.array(model.pairs), np.array(model.alone)

    def read(column: pd.Series) -> pd.DataFrame:
        rows = []
        for words in column:
            best = (None, None)
            for w in words if words is not None else ():
                codes = codes_of(w) if w else np.zeros(0, np.int64)
                codes = codes[codes >= 0]
                if codes.size >= CARRIER:
                    bits = int((pairs[codes[:-1], codes[1:]] - alone[codes[1:]]).sum())
                    if best[1] is None or bits > best[1]:
                        best = ("".join(LETTERS[c] for c in codes), bits)
            rows.append(best)
        return pd.DataFrame(rows, columns=["word", "bits"], dtype=object)

    return F.pandas_udf(read, SPELLED)(carriers)


def spells(read: Column) -> Column:
    return F.coalesce(read["bits"] >= int(SPELLS * UNIT), F.lit(False))
