"""What the two tokenizer operators share: a sentencepiece file's normaliser and vocabulary, a memory of recent chunks, and merging many strings at once."""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
ENDED = re.compile(r"(.*[^\W_])[^\w\s]+$")
#: Longer chunks are merged with a heap, one by one.
LONG = 64
#: Characters of the chunks that a worker remembers.
MOST_CHARS = 16_000_000
#: Chunks that are kept between tasks: a worker that goes on to other work must not hold more.
BETWEEN_TASKS = 40_000
RUN = re.compile("  +")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of a serialised protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = number() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[i : i + n]
            i += n


class Numbered(dict):
    """Numbers of strings in the order in which they are first met."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Memory:
    """The chunks of recent texts by number, so that each is worked out once. When there are more than ``most``, or more than
    ``MOST_CHARS`` characters of them, those that were rarely met since the last time go."""

    def __init__(self, most: int):
        self.most, self.numbers, self.uses, self.chars = most, Numbered(), np.zeros(0, np.int64), 0

    def numbered(self, texts: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The numbers of the chunks of some texts, where each text's begin (and the end), and the chunks that are new."""
        known, get = len(self.numbers), self.numbers.__getitem__
        flat, ends = array("i"), [0]
        for chunks in texts:
            flat.extend(map(get, chunks))
            ends.append(len(flat))
        numbers = np.array(flat, np.int32)
        uses = np.bincount(numbers, minlength=len(self.numbers))
        uses[:known] += self.uses
        self.uses = uses
        new = list(islice(self.numbers, known, None))
        self.chars += sum(map(len, new))
        return numbers, np.array(ends), new

    def cleared(self, most: int | None = None) -> np.ndarray | None:
        """To be called between steps: the numbers that stay, in their new order, if some go. With ``most``, at most half of it stay."""
        if len(self.numbers) <= (most or self.most) and self.chars <= MOST_CHARS:
            return None
        keys = list(self.numbers)
        size = np.array([len(k) for k in keys])
        least = 2
        while True:
            keep = np.flatnonzero(self.uses >= least)
            if len(keep) <= (most or self.most) // 2 and size[keep].sum() <= MOST_CHARS // 2:
                break
            least *= 2
        self.numbers = Numbered((keys[k], i) for i, k in enumerate(keep.tolist()))
        self.uses, self.chars = np.zeros(len(keep), np.int64), int(size[keep].sum())
        return keep


def charsmap_rules(blob: bytes) -> dict[str, str]:
    """The rewrite rules of a precompiled character map: a double-array trie of UTF-8 sources, and their targets."""
    (n,) = struct.unpack_from("<I", blob)
    units, targets = np.frombuffer(blob, "<u4", n // 4, 4).tolist(), blob[4 + n :]
    jump = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    out, todo = {}, [(jump(units[0]), b"")]
    while todo:
        at, key = todo.pop()
        for c in range(1, 256):
            if (at ^ c) < len(units) and units[at ^ c] & 0x800000FF == c:
                unit = units[at ^ c]
                below = at ^ c ^ jump(unit)
                todo.append((below, key + bytes([c])))
                if unit >> 8 & 1:
                    start = units[below] & 0x7FFFFFFF
                    out[(key + bytes([c])).decode()] = targets[start : targets.index(b"\0", start)].decode()
    return out


class Normaliser:
    """The normaliser's machine. At each place it takes the longest user-defined piece, which stays as it is, or else the
    longest rule's source, which becomes its target, or else one character; where ``trim`` is set, spaces at the ends and all
    but one of a run go; ``prefix`` puts a space first. Results are in the space form: a space stands for U+2581."""

    def __init__(self, rules: dict[str, str], user: list[str], prefix: bool, trim: bool):
        self.prefix, self.trim, self.rules, self.user = " " * prefix, trim, rules, set(user)
        longer = {k[0] for k in [*rules, *user] if len(k) > 1} | {k for k in user if len(k) == 1}
        self.single = {ord(k): v for k, v in rules.items() if len(k) == 1 and k not in longer}
        keys = [*sorted(self.user, key=len, reverse=True), *sorted((k for k in rules if len(k) > 1 or k in longer), key=len, reverse=True)]
        self.pattern = re.compile("|".join(map(re.escape, keys))) if keys else None
        self.plain = not rules and not user and not trim

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """What the text becomes, part by part, and whether a part is a user-defined piece."""
        at = 0
        for found in self.pattern.finditer(text) if self.pattern else ():
            if found.start() > at:
                yield text[at : found.start()].translate(self.single), False
            yield (found[0], True) if found[0] in self.user else (self.rules[found[0]], False)
            at = found.end()
        yield text[at:].translate(self.single), False

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if not self.plain:
            out, after_space = [], True
            for part, whole in self.parts(text):
                if self.trim:
                    part = part.lstrip(" ") if after_space else part
                    part = part if whole else RUN.sub(" ", part)
                    after_space = part.endswith(" ") if part else after_space
                out.append(part)
            text = "".join(out)
            text = text.rstrip(f" {SPACE}") if self.trim else text
            if not text:
                return ""
        return (self.prefix + text).replace(SPACE, " ")


class PieceModel:
    """Pieces, scores and kinds by id, the model's kind and its normaliser."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, charsmap = UNIGRAM, b""
        prefix = trim = escape = True
        suffix = False
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                self.kind, suffix = spec.get(3, UNIGRAM), bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(_fields(value))
                charsmap, prefix, trim, escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if suffix or not escape or UNUSED in self.kinds or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only BPE and unigram models with escaped spaces before words and no unused pieces")
        of = lambda *kinds: {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in kinds}
        self.user = of(USER)
        # a user-defined piece of a BPE model is never merged; in a unigram model it is a piece like others
        self.ids = of(NORMAL) if self.kind == BPE else of(NORMAL, USER)
        self.bytes = {int(p[3:5], 16): i for p, i in of(BYTE).items()}
        if len(self.bytes) != 256:
            raise ValueError("only models with byte fallback")
        self.normalised = Normaliser(charsmap_rules(charsmap) if charsmap else {}, list(self.user), prefix, trim)
        whole = sorted((p.replace(SPACE, " ") for p in self.user), key=len, reverse=True) if self.kind == BPE else []
        self.whole_pieces = {p.replace(SPACE, " "): i for p, i in self.user.items()} if self.kind == BPE else {}
        self.frozen = re.compile("(" + "|".join(map(re.escape, whole)) + ")") if whole else None
        self._merges()
        self._splitter()

    def _merges(self) -> None:
        """All pairs of pieces (single characters included) that join to a piece, with the order of the joins."""
        order = {s: r for r, s in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        keys, ranks, results = [], [], []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(order[self.scores[i]])
                    results.append(i)
        by = np.argsort(keys)
        self.merge_keys = np.array(keys, np.int64)[by]
        self.merge_ranks = np.array(ranks, np.int64)[by]
        self.merge_results = np.array(results, np.int64)[by]
        self.merge_of = dict(zip(keys, zip(ranks, results, strict=True), strict=True))

    def _splitter(self) -> None:
        """Cuts only where no piece has the two characters side by side, so that no merge crosses a cut."""
        self.pairs = {pair for p in self.ids for pair in zip(p, p[1:], strict=False)}
        if any(b == SPACE != a for a, b in self.pairs) or any("\n" in p for p in self.ids):
            self.chunks = re.compile("(?s).+")
        else:
            self.chunks = re.compile(" *[^ \n]+| +|\n+")

    def cut(self, text: str) -> list[str]:
        """The chunks of a normalised text."""
        if self.frozen is None:
            return self.chunks.findall(text)
        return [c for i, part in enumerate(self.frozen.split(text)) for c in ([part] if i % 2 else self.chunks.findall(part))]

    def fine(self, chunk: str) -> list[str]:
        """A chunk cut between a word and the marks that end it, if no piece has the two characters side by side."""
        found = ENDED.match(chunk)
        if found is None or chunk in self.whole_pieces:
            return [chunk]
        at = found.end(1)
        return [chunk[:at], chunk[at:]] if (chunk[at - 1], chunk[at]) not in self.pairs else [chunk]

    def units(self, chunk: str) -> list[int]:
        """One id per character; an unknown character is minus the number of its bytes."""
        return [self.ids[c] if c in self.ids else -len(c.encode()) for c in chunk]

    def whole(self) -> dict[str, int]:
        """The pieces that encode alone as one token, with their ids: proved by merging each of them."""
        alone = list(self.ids)
        return {p: self.ids[p] for p, got in zip(alone, self.merged(alone), strict=True) if got == [self.ids[p]]}

    def merged(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk, as merging the best pair again and again gives them (leftmost of equals)."""
        out: list[list[int] | None] = [None] * len(chunks)
        short = [i for i, c in enumerate(chunks) if len(c) <= LONG]
        for i, c in enumerate(chunks):
            if len(c) > LONG:
                out[i] = self._by_heap(self.units(c))
        if short:
            flat, bounds = self._by_rounds([chunks[i] for i in short])
            flat_list = flat.tolist()
            for k, i in enumerate(short):
                out[i] = flat_list[bounds[k] : bounds[k + 1]]
        return out

    def _by_rounds(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All chunks at once: each round merges the best pair of every chunk that still has one."""
        lengths = np.array([len(c) for c in chunks])
        get = self.ids.get
        flat = np.array([get(c, -1) if c in self.ids else -len(c.encode()) for c in "".join(chunks)], np.int64)
        owner = np.repeat(np.arange(len(chunks)), lengths)
        done_sym, done_owner = [], []
        while len(flat):
            key = flat[:-1] << 32 | (flat[1:] & 0xFFFFFFFF)
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            hit = np.flatnonzero((self.merge_keys[at] == key) & (owner[:-1] == owner[1:]) & (flat[:-1] >= 0) & (flat[1:] >= 0))
            if not len(hit):
                break
            own = owner[hit]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best = np.minimum.reduceat(self.merge_ranks[at[hit]] << 32 | hit, starts) & 0xFFFFFFFF
            flat[best] = self.merge_results[at[best]]
            keep = np.ones(len(flat), bool)
            keep[best + 1] = False
            going = np.zeros(len(chunks), bool)
            going[own[starts]] = True
            active = going[owner]
            done_sym.append(flat[keep & ~active])
            done_owner.append(owner[keep & ~active])
            flat, owner = flat[keep & active], owner[keep & active]
        done_sym.append(flat)
        done_owner.append(owner)
        sym, own = np.concatenate(done_sym), np.concatenate(done_owner)
        by = np.argsort(own, kind="stable")
        return sym[by], np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(chunks)))])

    def _by_heap(self, units: list[int]) -> list[int]:
        after = list(range(1, len(units) + 1))
        before = list(range(-1, len(units) - 1))
        find = self.merge_of.get

        def pair(i: int, j: int) -> tuple[int, int, int, int, int] | None:
            if i < 0 or j >= len(units) or units[i] < 0 or units[j] < 0:
                return None
            got = find(units[i] << 32 | units[j])
            return (got[0], i, j, units[i], units[j]) if got else None

        heap = [x for i in range(len(units) - 1) if (x := pair(i, i + 1))]
        heapify(heap)
        gone = [False] * len(units)
        while heap:
            _, i, j, a, b = heappop(heap)
            if gone[i] or gone[j] or units[i] != a or units[j] != b or after[i] != j:
                continue
            units[i] = find(a << 32 | b)[1]
            gone[j] = True
            after[i] = after[j]
            if after[j] < len(units):
                before[after[j]] = i
            for x in (pair(before[i], i), pair(i, after[i])):
                if x:
                    heappush(heap, x)
        return [u for u, g in zip(units, gone, strict=True) if not g]


@lru_cache(maxsize=2)
def compiled(raw: bytes) -> PieceModel:
    """The model of a file's bytes, made once in each Python worker."""
    return PieceModel(raw)
