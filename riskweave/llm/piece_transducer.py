"""SentencePiece encoding and decoding with a weighted finite-state transducer.

Three machines are compiled from the model file: the normaliser (rewrite rules of the character map, white space, dummy prefix,
user-defined pieces that stay as they are), the pieces (a trie whose final states emit an id) and byte fallback (an arc for
each unknown character that emits its bytes). The normaliser is deterministic, so its composition with an input is one string;
that string composed with the others gives a lattice over its positions, and the encoding is the lattice's shortest path in the tropical semiring (minimum of
sums). For a unigram model an arc weighs minus its piece's score. A BPE model's scores are merge priorities, not weights, so there
an arc weighs 1 and the composition has one more machine, an acceptor of piece pairs: (u, v) is accepted with weight 0 if merging
the text of u v gives u, v, and else with infinite weight. A sequence of pieces whose neighbours are all accepted is
the merge result and no other such sequence exists, so the shortest path is the library's encoding.

Many inputs are composed at once: inputs are cut where no piece can cross, the distinct new ones of a step are advanced
position by position with array operations, and recent results are remembered.

Scale: one pass without a shuffle; a worker holds the machines (fixed size), between steps the results of at most ``REMEMBERED``
chunks and ``MOST_PAIRS`` judged pairs.

Defined results: null and empty texts have no ids; decoding gives back the normalised text, with U+2581 as a space; repeated rows
and null ids keep their rows; an empty table gives no rows; a very long text is encoded whole; malformed UTF-8 counts as
U+FFFD; further columns are not read, whatever their names. Models with pieces that end in U+2581 by rule, unescaped spaces,
unused pieces or without byte fallback are refused (ValueError).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_batches, quoted, steps, table, utf8
from .piece_model import BETWEEN_TASKS, BPE, BYTE, LONG, NORMAL, SPACE, USER, Memory, PieceModel, compiled

REMEMBERED, MOST_PAIRS = 400_000, 1_000_000
#: Text bytes of one step: larger steps have more chunks in common.
STEP = 4_000_000
START = -1


class Transducer:
    def __init__(self, model: PieceModel):
        self.model = model
        self.unknown = len(model.pieces)  # the output of a byte fallback arc
        self.bpe = model.kind == BPE
        self.weight = np.ones(self.unknown + 1)
        if not self.bpe:
            scores = [model.scores[i] for p, i in model.ids.items() if p not in model.user]
            self.weight[:-1] = -np.array(model.scores)
            self.weight[-1] = 10 - min(scores)
            for piece, i in model.user.items():  # a bonus makes the shortest path take them
                self.weight[i] = 0.1 - len(piece.encode()) * max(scores)
        # of a BPE model, only pieces that merging gives
        self.arcs_of = model.whole() if self.bpe else model.ids
        self._trie()
        self.pair_keys, self.pair_ok, self.pair_of = np.zeros(0, np.int64), np.zeros(0, bool), {}
        self.memory = Memory(REMEMBERED)
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        kinds = zip(model.pieces, model.kinds, strict=True)
        output = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k in (NORMAL, USER) else b"" for p, k in kinds]
        self.output = np.frombuffer(b"".join(output), np.uint8)
        self.output_size = np.array([len(x) for x in output])
        self.output_at = np.cumsum(self.output_size) - self.output_size

    def _trie(self) -> None:
        steps_of: dict[tuple[int, int], int] = {}
        final = [-1]
        for piece, i in self.arcs_of.items():
            node = 0
            for c in piece:
                key = node, ord(c)
                if key not in steps_of:
                    steps_of[key] = len(final)
                    final.append(-1)
                node = steps_of[key]
            final[node] = i
        keys = np.array([a << 21 | c for a, c in steps_of], np.int64)
        by = np.argsort(keys)
        self.arcs, self.targets, self.final = keys[by], np.array(list(steps_of.values()))[by], np.array(final)
        self.longest = max(map(len, self.arcs_of))

    def follow(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node behind the arc of each character; -1 if there is none."""
        key = node << 21 | char
        at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
        return np.where(self.arcs[at] == key, self.targets[at], -1)

    def accepted(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the acceptor lets the pieces of each pair be neighbours; byte fallback and the start always may."""
        free = (left == START) | (left == self.unknown) | (right == self.unknown)
        key = np.where(free, -1, left << 32 | right)
        at = np.searchsorted(self.pair_keys, key)
        held = np.zeros(len(key), bool)
        if len(self.pair_keys):
            held = self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] == key
        new = np.unique(key[~held & ~free])
        if len(new):
            pairs = [(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in new]
            merged = self.model.merged([self.model.pieces[a] + self.model.pieces[b] for a, b in pairs])
            ok = np.array([m == list(p) for m, p in zip(merged, pairs, strict=True)], bool)
            at = np.searchsorted(self.pair_keys, new)
            self.pair_keys, self.pair_ok = np.insert(self.pair_keys, at, new), np.insert(self.pair_ok, at, ok)
        out = free.copy()
        if not free.all():
            out[~free] = self.pair_ok[np.searchsorted(self.pair_keys, key[~free])]
        return out

    def shortest_paths(self, inputs: list[str]) -> list[list[int]]:
        """The outputs of each input's shortest path; inputs are not empty and have ``LONG`` characters at most."""
        order, flat, bounds = self.composed(inputs)
        out: list[list[int]] = [[] for _ in inputs]
        for k, i in enumerate(order):
            out[i] = flat[bounds[k] : bounds[k + 1]].tolist()
        return out

    def composed(self, inputs: list[str]) -> tuple[list[int], np.ndarray, list[int]]:
        """All shortest paths, one after the other: the inputs' order, the outputs, and where each input's begin and end."""
        order = sorted(range(len(inputs)), key=lambda i: -len(inputs[i]))
        size = np.array([len(inputs[i]) for i in order])
        chars = np.frombuffer("".join(inputs[i] for i in order).encode("utf-32-le"), np.uint32).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        row = start + np.arange(len(size))  # an input has one more position than characters
        cost = np.full(len(chars) + len(size), np.inf)
        last, back = np.full(len(cost), START), np.zeros(len(cost), np.int64)
        cost[row] = 0
        for i in range(int(size[0])):
            own = np.arange(np.searchsorted(-size, -i, side="left"))
            node = np.zeros(len(own), np.int64)
            for j in range(i, min(i + self.longest, int(size[0]))):
                on = size[own] > j
                own, node = own[on], self.follow(node[on], chars[start[own[on]] + j])
                if j == i:
                    lone = self.final[node] < 0
                    lone |= node < 0
                    self.relax(cost, last, back, row[own[lone]], i, j + 1, np.full(int(lone.sum()), self.unknown))
                own, node = own[node >= 0], node[node >= 0]
                if not len(own):
                    break
                piece = self.final[node]
                self.relax(cost, last, back, row[own[piece >= 0]], i, j + 1, piece[piece >= 0])
        return order, *self.traced(size, row, last, back)

    def relax(self, cost, last, back, row, i: int, j: int, piece) -> None:
        if not len(row):
            return
        new = cost[row + i] + self.weight[piece]
        better = np.flatnonzero(new < cost[row + j])
        if self.bpe and len(better):
            better = better[self.accepted(last[row[better] + i], piece[better])]
        to = row[better] + j
        cost[to], last[to], back[to] = new[better], piece[better], i

    def traced(self, size, row, last, back) -> tuple[np.ndarray, list[int]]:
        at, alive = size.copy(), np.arange(len(size))
        owners, pieces = [], []
        while len(alive):
            place = row[alive] + at[alive]
            owners.append(alive)
            pieces.append(last[place])
            at[alive] = back[place]
            alive = alive[at[alive] > 0]
        owner, piece = np.concatenate(owners[::-1]), np.concatenate(pieces[::-1])
        by = np.argsort(owner, kind="stable")
        return piece[by], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))]).tolist()

    def shortest_path(self, text: str) -> list[int]:
        """The same for one input of any length."""
        ids, most = self.arcs_of, self.longest
        cost, last, back = [0.0] + [np.inf] * len(text), [START] * (len(text) + 1), [0] * (len(text) + 1)
        pair = self.model_pairs
        for i in range(len(text)):
            found = [(j, ids[text[i:j]]) for j in range(i + 1, min(i + most, len(text)) + 1) if text[i:j] in ids]
            if text[i] not in ids:
                found.append((i + 1, self.unknown))
            for j, piece in found:
                new = cost[i] + self.weight[piece]
                if new < cost[j] and (not self.bpe or pair(last[i], piece)):
                    cost[j], last[j], back[j] = new, piece, i
        out, j = [], len(text)
        while j:
            out.append(last[j])
            j = back[j]
        return out[::-1]

    def model_pairs(self, left: int, right: int) -> bool:
        if START in (left,) or self.unknown in (left, right):
            return True
        if (left, right) not in self.pair_of:
            self.pair_of[left, right] = bool(self.accepted(np.array([left]), np.array([right]))[0])
        return self.pair_of[left, right]

    def ids_of(self, text: str, path: list[int]) -> bytes:
        """The ids of a path: its pieces, and the bytes of each unknown character."""
        out, at = [], 0
        for i in path:
            if i == self.unknown:
                out += [self.model.bytes[b] for b in text[at].encode()]
                at += 1
            else:
                out.append(i)
                at += len(self.model.pieces[i])
        return np.array(out, "<i4").tobytes()

    def paths(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of each part, as little-endian 32-bit numbers."""
        out: dict[str, bytes] = {}
        forms = [p.replace(" ", SPACE) for p in parts]
        short = [f for f in forms if len(f) <= LONG]
        if short:
            order, flat, bounds = self.composed(short)
            whole, hard = flat.astype("<i4").tobytes(), {k for k in np.searchsorted(bounds, np.flatnonzero(flat == self.unknown), side="right") - 1}
            for k, i in enumerate(order):
                a, b = bounds[k], bounds[k + 1]
                out[short[i]] = whole[4 * a : 4 * b] if k not in hard else self.ids_of(short[i], flat[a:b].tolist())
        return {p: out[f] if f in out else self.ids_of(f, self.shortest_path(f)) for p, f in zip(parts, forms, strict=True)}

    def learn(self, new: list[str]) -> None:
        if len(self.pair_keys) > MOST_PAIRS:
            self.pair_keys, self.pair_ok, self.pair_of = self.pair_keys[:0], self.pair_ok[:0], {}
        numbers, held, frozen = self.memory.numbers, len(self.size), self.model.whole_pieces
        cut = [self.model.fine(c) for c in new]
        known = {}
        for part in set().union(*cut):
            n = numbers.get(part, held)
            if part in frozen:
                known[part] = np.array([frozen[part]], "<i4").tobytes()
            elif n < held:
                known[part] = self.flat[self.start[n] : self.start[n] + self.size[n]].astype("<i4").tobytes()
            else:
                known[part] = None
        known |= self.paths([p for p, ids in known.items() if ids is None])
        ids = [b"".join(map(known.__getitem__, parts)) for parts in cut]
        size = np.array([len(x) // 4 for x in ids], np.int64)
        self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.flat = np.append(self.flat, np.frombuffer(b"".join(ids), "<i4"))

    def gathered(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the chunks with these numbers, one after the other."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[numbers] - ends + size, size)]

    def forget(self, most: int | None = None) -> None:
        keep = self.memory.cleared(most)
        if keep is not None:
            flat, size = self.gathered(keep), self.size[keep]
            self.flat, self.start, self.size = flat, np.cumsum(size) - size, size

    def encode_normal(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some normalised texts, one after the other, and where each one's begin (and the end)."""
        self.forget()
        numbers, ends, new = self.memory.numbered(map(self.model.cut, texts))
        self.learn(new)
        return self.gathered(numbers), np.concatenate([[0], np.cumsum(self.size[numbers])])[ends]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, at = self.encode_normal(map(self.model.normalised, texts))
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def emitted(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for, one after the other."""
        size = self.output_size[ids]
        ends = np.cumsum(size)
        return self.output[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.output_at[ids] - ends + size, size)]

    def decode(self, ids: np.ndarray) -> str:
        text = self.emitted(ids).tobytes().decode(errors="replace")
        own = self.model.normalised
        return text.lstrip(" ") if own.trim else text.removeprefix(own.prefix)

    def gives_back(self, ids: np.ndarray, at: np.ndarray, normal: list[str]) -> list[bool]:
        """Whether each normalised text is what its ids stand for."""
        ends = np.concatenate([[0], np.cumsum(self.output_size[ids])])[at].tolist()
        whole = self.emitted(ids).tobytes()
        return [whole[a:b] == t.encode() for a, b, t in zip(ends[:-1], ends[1:], normal, strict=True)]


_machines: dict[bytes, Transducer] = {}


def machine(raw: bytes) -> Transducer:
    if raw not in _machines:
        _machines[raw] = Transducer(compiled(raw))
    return _machines[raw]


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) for each row; with digest, instead of ids their SHA-1 (as little-endian 32-bit numbers) and whether decoding them gives the text back."""
    raw = read_file(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = machine(raw)
        for batch in batches:
            data, at = utf8(batch.column(1))
            for a, b in steps(at, STEP):
                normal = [tool.model.normalised(data[at[i] : at[i + 1]].tobytes().decode(errors="replace")) for i in range(a, b)]
                ids, cuts = tool.encode_normal(normal)
                n = pa.array(np.diff(cuts))
                ids_of = batch.column(0).slice(a, b - a)
                if digest:
                    same = tool.gives_back(ids, cuts, normal)
                    sums = [hashlib.sha1(ids[x:y].astype("<i4").tobytes()).hexdigest() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([ids_of, n, pa.array(sums, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha1", "round_trip"])
                else:
                    values = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([ids_of, n, values], ["doc_id", "n_tokens", "ids"])
        tool.forget(BETWEEN_TASKS)

    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_batches(rows, run, f"doc_id {kind}, n_tokens long, " + ("ids_sha1 string, round_trip boolean" if digest else "ids array<int>"))


def decoded(rows: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) for each row of ids."""
    raw = read_file(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = machine(raw)
        for batch in batches:
            texts = [None if x is None else tool.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = rows.select(quoted(id_col).alias("doc_id"), quoted(ids_col).alias("ids"))
    return in_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def op9_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
