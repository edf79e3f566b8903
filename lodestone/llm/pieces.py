"""SentencePiece encoding and decoding, by a forward pass that words share along their common prefixes.

A text is normalised by the model and cut into marked words: runs of the space mark with the characters after them, and line
feeds where no piece holds one; no piece crosses such a cut. The distinct new words of a slice of texts are sorted into a trie, which is
walked down from the root, a depth at a time: a prefix that words share is one node, and its forward state is found once, from the
states above it. The pieces that end at a node come from a second trie, of the pieces read backwards.

The state of a node depends on the kind of model. For a unigram model it is the best score of the characters so far (Viterbi).
The scores of a BPE model are merge ranks, whose best sum isn't what its merges give; there the state is the last piece of the
prefix's own encoding. Encodings of prefixes are prefixes of encodings, and a piece may follow another if merging the two
strings gives the two pieces, so a single piece ends at each position: the pass gives what the merges give, exactly.

Characters without a piece become byte pieces (or the unknown piece where the model has none) and nothing merges with them.

Defined results: a null text counts as empty; an empty text has no pieces and decodes to the empty text; a space mark in a text
can't be told from a space and decodes to one; repeated rows are encoded alike; an empty table gives an empty table; a word of any
length is encoded whole; columns beyond text and those asked for aren't looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType


MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words whose ids a task remembers, pairs of pieces likewise, and characters of texts that it encodes at once.
REMEMBERED = 100_000
PAIRS = 500_000
SLICE = 1 << 20
#: Longer words walk their own path, a character at a time.
LONG = 48
_MULT = np.uint64(0x9E3779B97F4A7C15)


class _Table:
    """Numbers (not negative) by keys (not negative), looked up by the array."""

    def __init__(self, bits: int = 12) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out, todo, at = np.full(len(keys), -1, dtype=np.int32), np.arange(len(keys)), self._slots(keys)
        while len(todo):
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (there >= 0)
            todo, at = todo[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Of distinct keys that aren't there yet."""
        if 2 * (self.n + len(keys)) > 1 << self.bits:
            old, own = self.keys >= 0, (self.keys, self.values)
            self.__init__(max(self.bits + 1, int(3 * (old.sum() + len(keys))).bit_length()))
            self.put(own[0][old], own[1][old])
        self.n += len(keys)
        at = self._slots(keys)
        while len(keys):
            first = np.zeros(len(keys), dtype=bool)
            first[np.unique(at, return_index=True)[1]] = True
            placed = first & (self.keys[at] < 0)
            self.keys[at[placed]], self.values[at[placed]] = keys[placed], values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)


class Pieces:
    """The pieces of a model with their scores, and the forward pass over sorted words. Pieces go by their place in a list of their own."""

    def __init__(self, scores: dict[str, tuple[int, float]], kind: str, byte_ids: list[int] | None, unknown: int) -> None:
        self.scores, self.kind, self.byte_ids, self.unknown = scores, kind, byte_ids, unknown
        self.strings = list(scores)
        self.ids = np.array([scores[x][0] for x in self.strings], dtype=np.int32)
        self.rated = np.array([scores[x][1] for x in self.strings], dtype=np.float64)
        self.sizes = np.array([len(x) for x in self.strings], dtype=np.int64)
        self.longest = int(self.sizes.max(initial=1))
        self.least = min((s for _, s in scores.values()), default=0.0) - 10
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for k, x in enumerate(self.strings):
            node = 0
            for c in reversed(x):
                node = nodes.setdefault((node, ord(c)), len(nodes) + 1)
            ends[node] = k
        self.ending = np.full(len(nodes) + 1, -1, dtype=np.int32)
        self.ending[list(ends)] = list(ends.values())
        self.backwards = _Table()
        self.backwards.put(np.array([(a << 21) | c for a, c in nodes], dtype=np.int64), np.array(list(nodes.values()), dtype=np.int32))
        self.pairs = _Table()

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: the best pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            ranked = [(-self.scores[a + b][1], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores]
            if not ranked:
                return parts
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def follows(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether pieces may stand after others (-1: at the start, or after a character without a piece)."""
        keys = (last.astype(np.int64) + 1) * len(self.strings) + piece
        found = self.pairs.get(keys)
        if (found < 0).any():
            new = np.unique(keys[found < 0])
            if self.pairs.n > PAIRS:
                self.pairs = _Table()
                new = np.unique(keys)
            before, after = [*self.strings, ""], self.strings
            pairs = [(before[k // len(after) - 1], after[k % len(after)]) for k in new.tolist()]
            self.pairs.put(new, np.array([self.merged(a + b) == ([a, b] if a else [b]) for a, b in pairs], dtype=np.int32))
            found = self.pairs.get(keys)
        return found == 1

    def _step(self, chars: np.ndarray, at: np.ndarray, end: int, words: np.ndarray, last: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states (last piece, score) of nodes at depth end: chars up to at, of words. last, best: the states by depth and word."""
        node, own, found = np.zeros(len(at), dtype=np.int64), np.arange(len(at)), []
        for size in range(1, min(end, self.longest) + 1):
            node = self.backwards.get((node << 21) | chars[at[own] - size + 1]).astype(np.int64)
            own, node = own[node >= 0], node[node >= 0]
            if not len(own):
                break
            piece = self.ending[node]
            found.append((size, own[piece >= 0], piece[piece >= 0]))
        state, score = np.full(len(at), -1, dtype=np.int32), best[end - 1, words] + self.least
        for size, own, piece in reversed(found):
            if self.kind == "bpe":
                free = state[own] < 0
                own, piece = own[free], piece[free]
                good = self.follows(last[end - size, words[own]], piece)
                state[own[good]] = piece[good]
            else:
                new = best[end - size, words[own]] + self.rated[piece]
                good = (new > score[own]) | (state[own] < 0)
                state[own[good]], score[own[good]] = piece[good], new[good]
        return state, score

    def _walk(self, words: list[str]) -> list[np.ndarray]:
        """The states' pieces of each of the sorted words from its end to its begin, in three arrays: word, place from the end, piece."""
        sizes = np.array(list(map(len, words)), dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        depth = int(sizes.max())
        last, best = np.full((depth + 1, len(words)), -1, dtype=np.int32), np.zeros((depth + 1, len(words)))
        live, tied = np.arange(len(words)), np.arange(1, len(words))
        for end in range(1, depth + 1):
            live = live[sizes[live] >= end]
            tied = tied[(sizes[tied] >= end) & (sizes[tied - 1] >= end)]
            tied = tied[chars[begins[tied] + end - 1] == chars[begins[tied - 1] + end - 1]]
            fresh = np.zeros(len(words), dtype=bool)
            fresh[live] = True
            fresh[tied] = False
            new = np.flatnonzero(fresh)
            last[end, new], best[end, new] = self._step(chars, begins[new] + end - 1, end, new, last, best)
            if len(tied):  # a node's words stand side by side, the first of them with its state
                of = np.maximum.accumulate(np.where(fresh, np.arange(len(words)), 0))[tied]
                last[end, tied], best[end, tied] = last[end, of], best[end, of]
        place, own, step, out = sizes.copy(), np.arange(len(words)), 0, []
        while len(own := own[place[own] > 0]):
            piece = last[place[own], own]
            out.append((own, np.full(len(own), step), piece))
            place[own] -= np.where(piece >= 0, self.sizes[piece], 1)
            step += 1
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def _long(self, word: str) -> list[int]:
        """The places of the pieces of one word, -1 for characters without one."""
        chars = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        window = self.longest + 1
        last, best = np.full((window + 1, 1), -1, dtype=np.int32), np.zeros((window + 1, 1))
        states, zero = [], np.zeros(1, dtype=np.int64)
        for end in range(1, len(word) + 1):
            depth = min(end, window)
            if end > window:  # only as many states as a piece is long are looked back at
                last[:-1], best[:-1] = last[1:], best[1:]
            state, score = self._step(chars, zero + end - 1, depth, zero, last, best)
            last[depth], best[depth] = state, score
            states.append(int(state[0]))
        out, end = [], len(word)
        while end:
            out.append(states[end - 1])
            end -= self.sizes[out[-1]] if out[-1] >= 0 else 1
        return out[::-1]

    def encode_sorted(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words (distinct, not empty, in ascending order) one after another, and how many each has."""
        short = [x for x in words if len(x) <= LONG]
        pieces: list = [None] * len(words)
        if short:
            word, step, piece = self._walk(short)
            n = np.bincount(word, minlength=len(short))
            flat = np.empty(len(piece), dtype=np.int32)
            flat[(np.cumsum(n) - 1)[word] - step] = piece
        if len(short) < len(words):
            parts = iter(np.split(flat, np.cumsum(n)[:-1])) if short else iter(())
            pieces = [next(parts) if len(x) <= LONG else np.array(self._long(x), dtype=np.int32) for x in words]
            n, flat = np.array([len(x) for x in pieces]), np.concatenate(pieces)
        odd = np.flatnonzero(flat < 0)
        ids = self.ids[flat]
        if not len(odd):
            return ids, n
        begin = np.cumsum(np.where(flat >= 0, self.sizes[flat], 1))
        text, word = "".join(words), np.repeat(np.arange(len(words)), n)
        places = [[self.byte_ids[x] for x in text[begin[i] - 1].encode()] if self.byte_ids else [self.unknown] for i in odd.tolist()]
        times = np.ones(len(flat), dtype=np.int64)
        times[odd] = [len(x) for x in places]
        out = np.repeat(ids, times)
        out[np.repeat(flat < 0, times)] = list(chain.from_iterable(places))
        return out, np.bincount(word, weights=times, minlength=len(words)).astype(np.int64)


class Codec:
    """A model: whole texts to ids and back."""

    def __init__(self, model: bytes, kind: str = "bpe") -> None:
        self.processor = p = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(p.get_piece_size())
        special = lambda i: p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)
        scores = {p.id_to_piece(i): (i, p.get_score(i)) for i in ids if not special(i)}
        byte_ids = {int(p.id_to_piece(i)[3:5], 16): i for i in ids if p.is_byte(i)}
        self.pieces = Pieces(scores, kind, [byte_ids[x] for x in range(256)] if len(byte_ids) == 256 else None, p.unk_id())
        crossing = any(MARK in x.lstrip(MARK) for x in scores)
        ends = "" if any("\n" in x for x in scores) else "\n"
        self.words = re.compile("(?s).+" if crossing else f"{MARK}*[^{MARK}{ends}]+|{MARK}+" + (f"|{ends}" if ends else ""))
        self.known: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        self.strings = [b"" if special(i) and not p.is_byte(i) else bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace(MARK, " ").encode() for i in ids]
        self.strings[p.unk_id()] = " ⁇ ".encode()
        self.prefix = p.normalize("a").startswith(MARK)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.words.findall(self.processor.normalize(x)) if x else [] for x in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.flat, self.sizes = {}, self.flat[:0], self.sizes[:0]
        new = sorted(set(chain.from_iterable(split)).difference(self.known))
        if new:
            ids, sizes = self.pieces.encode_sorted(new)
            self.known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.flat, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, sizes])
        counts = list(map(len, split))
        word = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=sum(counts))
        n = self.sizes[word]
        ends = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(n)])
        begin = (np.cumsum(self.sizes) - self.sizes)[word]
        out = self.flat[np.repeat(begin - ends[:-1], n) + np.arange(ends[-1])]
        return np.split(out, ends[np.cumsum(counts)[:-1]]) if texts else []

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.strings.__getitem__, ids.tolist())).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(model: bytes, kind: str) -> Codec:
    """The codec of a model, made once in a process."""
    key = (hashlib.sha256(model).hexdigest(), kind)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model, kind)
    return _CODECS[key]


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    held, size, begin = [], 0, 0
    for i, x in enumerate(texts):
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size >= SLICE:
            yield begin, held
            held, size, begin = [], 0, i + 1
    if held:
        yield begin, held


def encode(docs: DataFrame, keep: list[str] | None = None, model: str = MODEL, kind: str = "bpe") -> DataFrame:
    """keep (doc_id) of every document with _ids, _decoded_sha256 (of the ids decoded again) and _exact, whether that is the text.

    model is a path on the driver; the file's bytes (a fixed vocabulary) go to the tasks.
    """
    keep = keep or ["doc_id"]
    data = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data.value, kind)
        for batch in batches:
            for begin, texts in _slices(batch.column("_text")):
                ids = own.encode(texts)
                back = [own.decode(x) for x in ids]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                kept = batch.slice(begin, len(texts))
                columns = [kept.column(i) for i in range(len(keep))]
                columns += [
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]),
                    pa.array([x == y.replace(MARK, " ") for x, y in zip(back, texts, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f"_k{i}" for i in range(len(keep))), "_ids", "_decoded_sha256", "_exact"])

    df = docs.select(*[docs[k].alias(f"_k{i}") for i, k in enumerate(keep)], docs["text"].alias("_text"))
    added = {"_ids": ArrayType(IntegerType()), "_decoded_sha256": StringType(), "_exact": BooleanType()}
    schema = StructType([x for x in df.schema if x.name != "_text"] + [StructField(k, v) for k, v in added.items()])
    return df.mapInArrow(run, schema).withColumnsRenamed({f"_k{i}": k for i, k in enumerate(keep)})
