"""Token counts by the whole-token shortcut.

The normalised text is cut where no merge can cross: the cuts are proved on the vocabulary when it is loaded. Vocabulary
strings that are proved to encode alone as one token are counted by one lookup; only the other chunks are merged,
each distinct one once per task and memory of recent ones, all of a step together.

Scale: one pass over the documents without a shuffle; a worker holds the vocabulary (fixed size) and at most ``REMEMBERED``
chunk counts between steps.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows and null ids keep their rows; an empty table gives
no rows; a very long text is counted whole; malformed UTF-8 counts as U+FFFD; further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_batches, quoted, steps, table, utf8
from .piece_model import BETWEEN_TASKS, SPACE, Memory, PieceModel, compiled

REMEMBERED = 300_000


class Counter:
    def __init__(self, model: PieceModel):
        self.model, self.alone = model, {p.replace(SPACE, " "): 1 for p in [*model.whole(), *model.whole_pieces]}
        self.memory, self.sizes = Memory(REMEMBERED), np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        """Counts of the new chunks: one for a whole token; the rest are merged."""
        numbers, sizes, alone = self.memory.numbers, self.sizes, self.alone
        parts = [self.model.fine(c) if c not in alone else [c] for c in new]
        known = {p: alone.get(p) or (int(sizes[numbers[p]]) if numbers.get(p, len(sizes)) < len(sizes) else None) for p in set().union(*parts)}
        rest = [p for p, n in known.items() if n is None]
        for part, ids in zip(rest, self.model.merged([p.replace(" ", SPACE) for p in rest]), strict=True):
            known[part] = sum(1 if i >= 0 else -i for i in ids)
        self.sizes = np.append(sizes, np.array([sum(map(known.__getitem__, cut)) for cut in parts], np.int64))

    def forget(self, most: int | None = None) -> None:
        keep = self.memory.cleared(most)
        if keep is not None:
            self.sizes = self.sizes[keep]

    def counts(self, texts: list[str]) -> np.ndarray:
        self.forget()
        numbers, ends, new = self.memory.numbered(self.model.cut(self.model.normalised(t)) for t in texts)
        self.learn(new)
        return np.diff(np.concatenate([[0], np.cumsum(self.sizes[numbers])])[ends])


_counters: dict[bytes, Counter] = {}


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; model_file is read on the driver."""
    with open(model_file, "rb") as f:
        raw = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if raw not in _counters:
            _counters[raw] = Counter(compiled(raw))
        counter = _counters[raw]
        for batch in batches:
            data, at = utf8(batch.column(1))
            n = np.zeros(len(batch), np.int64)
            for a, b in steps(at):
                n[a:b] = counter.counts([data[at[i] : at[i + 1]].tobytes().decode(errors="replace") for i in range(a, b)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        counter.forget(BETWEEN_TASKS)

    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    return in_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
