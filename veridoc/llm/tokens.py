"""Token ids of whole texts by a tokenizers file, with the ids of repeated chunks looked up."""

from __future__ import annotations

import os
import re

import numpy as np

from .common import held
from .shingles import LOWER_VALUES, mix, span_hashes, word_bounds

#: What each byte counts as in a chunk's hash where case is kept; a space, which parts chunks, as nothing.
BYTE_VALUES = np.where(np.arange(256) == 32, 0, np.arange(256) + 1).astype(np.uint64)
#: A word of Latin-1 letters and the ASCII signs after it: one piece each in either vocabulary.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*&%$#|()]*)")
#: The byte alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: b for b in _PRINTED} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


def byte_decoded(tok) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; those of an added token are its content's."""
    added = tok.get_added_tokens_decoder()
    back = {chr(v): k for k, v in _ALPHABET.items()}
    shown = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())]
    return [s.encode() if i in added else bytes(back[c] for c in s) for i, s in enumerate(shown)]


class Known:
    """Numbers of 64-bit hashes, in two tables of slots; a hash whose slots are both taken displaces one."""

    def __init__(self, bits: int = 20):
        self.shifts = np.uint64(64 - bits), np.uint64(44 - bits)
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros((2, 1 << bits), np.uint64)
        self.numbers = np.full((2, 1 << bits), -1, np.int32)

    def _slots(self, hashes: np.ndarray, k: int) -> np.ndarray:
        return ((hashes >> self.shifts[k]) & self.mask).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        slots = self._slots(hashes, 0)
        out = np.where(self.keys[0][slots] == hashes, self.numbers[0][slots], -1)
        rest = np.flatnonzero(out < 0)
        slots = self._slots(hashes[rest], 1)
        out[rest] = np.where(self.keys[1][slots] == hashes[rest], self.numbers[1][slots], -1)
        return out

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        for k in (0, 1):
            slots = self._slots(hashes, k)
            free = self.numbers[k][slots] < 0 if k == 0 else np.ones(len(slots), bool)
            self.keys[k][slots[free]], self.numbers[k][slots[free]] = hashes[free], numbers[free]
            missing = self.keys[k][slots] != hashes
            hashes, numbers = hashes[missing], numbers[missing]


class IdLists:
    """Lists of ids by number, one after another in one array."""

    def __init__(self):
        self.starts, self.lens, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)
        self.count = self.used = 0

    def add_flat(self, flat: np.ndarray, lens: np.ndarray) -> None:
        n, k = self.count, len(lens)
        while n + k > len(self.starts):
            self.starts, self.lens = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lens))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.starts[n : n + k], self.lens[n : n + k] = self.used + np.cumsum(lens) - lens, lens
        self.flat[self.used : self.used + len(flat)] = flat
        self.count, self.used = n + k, self.used + len(flat)

    def at(self, numbers: np.ndarray) -> np.ndarray:
        """The lists of these numbers in turn; a negative length counts as 0."""
        lens = np.maximum(self.lens[numbers], 0)
        ends = np.cumsum(lens)
        return self.flat[np.repeat(self.starts[numbers] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)]


class ChunkEncoder:
    """Encodes texts chunk by chunk, where a chunk is a run between single spaces.

    Neither vocabulary's pre-tokenizer lets a piece span a space that stands between two
    other characters, so the ids of a text are those of its chunks in turn. `keeps_space`
    says whether a chunk is encoded with the space in front of it and in its own case, or
    without and in lower case. With spaces kept, a text in which a space stands next to other
    white space or at an end is encoded in one call instead; without, chunks end at any ASCII
    white space. Chunks are known by a 64-bit hash of their bytes; the library is asked once
    for each new one. The table of known chunks starts anew at `max_chunks`.

    Added tokens that stand in a text are text, or, with `takes_added`, themselves, as is the
    library's default; a text that may hold one is encoded in one call then.
    """

    def __init__(self, path: str, keeps_space: bool, max_chunks: int = 800_000, takes_added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not takes_added
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()] if takes_added else []
        self.keeps_space = keeps_space
        self.max_chunks = max_chunks
        self._clear()

    def _clear(self) -> None:
        self.known, self.ids = Known(), IdLists()
        self.pieces: dict[str, int] = {}
        self.piece_ids = IdLists()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokenized pieces in turn, and how many each has; the file's model takes them in its byte alphabet."""
        new = list(set(pieces).difference(self.pieces))
        if new:
            shown = "\0".join(new).encode().decode("latin-1").translate(_ALPHABET).split(chr(_ALPHABET[0]))
            tokenize, ids, lens = self.tok.model.tokenize, [], []
            for x in shown:
                found = tokenize(x)
                ids += [t.id for t in found]
                lens.append(len(found))
            self.pieces.update(zip(new, range(self.piece_ids.count, self.piece_ids.count + len(new))))
            self.piece_ids.add_flat(np.array(ids, np.int32), np.array(lens))
        at = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
        return self.piece_ids.at(at), self.piece_ids.lens[at]

    def _learn(self, chunks: list[str], heads: list[bool]) -> np.ndarray:
        """Numbers of new chunks; `heads` are the first of a text, without a space in front."""
        pieces: list[str] = []
        counts, other = np.zeros(len(chunks), np.int64), []
        keeps, match = self.keeps_space, _SIMPLE.fullmatch
        for i, c in enumerate(chunks):
            before = len(pieces)
            if m := match(c):
                word, tail = m.groups()
                pieces.append(word.lower() if not keeps else word if heads[i] else " " + word)
                if tail:
                    pieces.append(tail)
            elif keeps and c.count("\n") == 1 and all(both := [match(x) for x in c.split("\n")]):
                (word, tail), (second, end) = both[0].groups(), both[1].groups()
                pieces += [x for x in (word if heads[i] else " " + word, tail, "\n", second, end) if x]
            else:
                other.append(i)
            counts[i] = len(pieces) - before
        flat, sizes = self._of_pieces(pieces)
        stops = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        lens = np.diff(stops)
        first = self.ids.count
        if other:  # by the library as they are
            asked = [chunks[i] if heads[i] or not keeps else " " + chunks[i] for i in other]
            found = self._ids(asked)
            lens[other] = list(map(len, found))
            into = np.zeros(len(chunks), bool)
            into[other] = True
            joined = np.zeros(int(lens.sum()), np.int32)
            mine = np.repeat(into, lens)
            joined[~mine] = flat
            joined[mine] = [i for ids in found for i in ids]
            flat = joined
        self.ids.add_flat(flat, lens)
        if keeps:  # a chunk that is empty or has white space at an end: its text is encoded whole
            for i in other:
                c = chunks[i]
                if not c or c[-1].isspace() or (c[0].isspace() and not heads[i]):
                    self.ids.lens[first + i] = -1
        return np.arange(first, first + len(chunks), dtype=np.int32)

    def chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks in turn, none of them the first of a text, and how many each has; -1 where its text has to be encoded whole."""
        if self.ids.count > self.max_chunks:
            self._clear()
        numbers = self._learn(chunks, [False] * len(chunks))
        return self.ids.at(numbers), self.ids.lens[numbers]

    def _chunks(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The joined bytes, the bounds of its chunks, and where each text's chunks start among them."""
        data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
        begins = np.cumsum(sizes) - sizes
        if self.keeps_space:
            ends = np.flatnonzero(data == 32)
            starts = np.concatenate([[0], ends[:-1] + 1])
        else:
            starts, ends = word_bounds(data)
        return data, starts, ends, np.append(np.searchsorted(starts, begins), len(starts))

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """The number of every chunk; new ones are learned."""
        hashes = span_hashes(data, starts, ends, BYTE_VALUES if self.keeps_space else LOWER_VALUES)
        head = np.zeros(len(hashes), bool)
        if self.keeps_space:
            head[firsts] = True
            hashes[head] = mix(hashes[head])
        numbers = self.known.find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new, first, where = np.unique(hashes[missing], return_index=True, return_inverse=True)
            at, raw = missing[first], data.tobytes()
            learned = self._learn([raw[i:j].decode() for i, j in zip(starts[at].tolist(), ends[at].tolist())], head[at].tolist())
            self.known.add(new, learned)
            numbers[missing] = learned[where]
        return numbers

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """An int32 array of ids for each text; a null text counts as empty."""
        if self.ids.count > self.max_chunks:
            self._clear()
        whole = {i for i, t in enumerate(texts) if t and any(a in t for a in self.added)}
        data, starts, ends, bounds = self._chunks([b"" if i in whole or not t else t.encode() for i, t in enumerate(texts)])
        if len(starts):
            at = self._numbers(data, starts, ends, bounds[:-1])
            lens = self.ids.lens[at]
            whole.update((np.searchsorted(bounds, np.flatnonzero(lens < 0), "right") - 1).tolist())
            ids = self.ids.at(at)
            cuts = np.concatenate([[0], np.cumsum(np.maximum(lens, 0))])[bounds].tolist()
        else:
            ids, cuts = np.zeros(0, np.int32), [0] * (len(texts) + 1)
        out = [ids[i:j] for i, j in zip(cuts, cuts[1:])]
        again = sorted(i for i in whole if texts[i])
        for i, found in zip(again, self._ids([texts[i] for i in again])):
            out[i] = np.array(found, np.int32)
        for i in whole.difference(again):
            out[i] = np.zeros(0, np.int32)
        return out


def encoder(path: str, keeps_space: bool) -> ChunkEncoder:
    """This worker's encoder of a file, kept from task to task."""
    return held(("encoder", path, keeps_space), lambda: ChunkEncoder(path, keeps_space, takes_added=True))


def batches_of(texts: list[str | None], most: int = 2_000_000):
    """Bounds of slices of `texts` of about `most` characters each."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
