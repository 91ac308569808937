"""Encoding of whole texts by a public tokenizer, cut at safe boundaries.

A byte-level BPE tokenizer first splits a text with a fixed pattern in which
white space only ever begins a piece. So a cut between a character that isn't
white space and a space never goes through a token, and the ids of a text are
those of its cells in order. Texts are cut at every such place; what has white
space of another kind (two spaces, a line feed before a space, white space at an
end of the text) stays together as one cell. Equal cells are encoded once for
each Python worker; when the store of cells is full, half of it goes, which costs
time only. Library calls are made of about equal numbers of UTF-8 bytes.
"""

from __future__ import annotations

import array
import itertools
import json
import re
from functools import lru_cache

import numpy as np

#: UTF-8 bytes that one library call encodes: of texts that are not cut, and of new cells.
CALL_BYTES = 1 << 20
CELL_BYTES = 1 << 18
#: UTF-8 bytes of texts whose new cells are gathered before a call.
RUN_BYTES = 4 << 20
#: Cells that a worker remembers (about 200 bytes each), and their longest.
MAX_CELLS = 1_400_000
MAX_LENGTH = 64

_ODD = re.compile(r"\s ")
#: A white-space character and a space, in ASCII.
_ODD_ASCII = tuple(c + " " for c in " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")


def _cut_is_safe(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = spec.get("added_tokens") or []
    return bool(plain and not spec.get("normalizer")) and not any(
        any(c.isspace() for c in t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added
    )


class Library:
    """One tokenizer file: ``.json`` by tokenizers, ``.model`` by sentencepiece."""

    def __init__(self, path: str):
        self.path, self._opens = path, None
        if path.endswith(".model"):
            import sentencepiece

            self._piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.safe = False
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._piece = None
            self._tok = Tokenizer.from_file(path)
            self._tok.no_truncation()
            self._tok.no_padding()
            with open(path, encoding="utf-8") as f:
                self.safe = _cut_is_safe(json.load(f))

    def opens(self) -> np.ndarray:
        """Which ids are tokens that begin with a space."""
        if self._opens is None:
            self._opens = np.zeros(self._tok.get_vocab_size(with_added_tokens=True), bool)
            for token, i in self._tok.get_vocab(with_added_tokens=False).items():
                self._opens[i] = token.startswith("\u0120")
        return self._opens

    def ids(self, texts: list[str]) -> list[list[int]]:
        if self._piece is not None:
            return self._piece.encode(texts, num_threads=1) if texts else []
        return [e.ids for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def lengths(self, texts: list[str]) -> list[int]:
        if self._piece is not None:
            return [len(x) for x in self.ids(texts)]
        return [len(e) for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def library(path: str) -> Library:
    return Library(path)


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def by_bytes(texts: list[str], most: int = CALL_BYTES):
    """Lists of texts of about ``most`` UTF-8 bytes each; a longer text is alone."""
    held, size = [], 0
    for t in texts:
        n = n_bytes(t)
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += n
    if held:
        yield held


def cells(text: str) -> tuple[list[str], set[int]]:
    """The parts between the spaces of ``text`` that follow a character that isn't
    white space, and which of the parts (but the first) hold other white space
    at which the tokenizer may look ahead."""
    parts = text.split(" ")
    if not (text[:1].isspace() or text[-1:].isspace() or (any([x in text for x in _ODD_ASCII]) if text.isascii() else _ODD.search(text))):
        return parts, set()
    out, odd, closed = [], set(), False
    held: list[str] = []
    for p in parts:
        if closed:
            out.append(" ".join(held))
            held = []
        held.append(p)
        closed = bool(p) and not p[-1].isspace()
        if len(held) > 1 or not closed or p[0].isspace():
            odd.add(len(out))
    out.append(" ".join(held))
    odd.discard(0)
    return out, odd


def _gaps(values: list) -> list[int]:
    """Where ``values`` has None."""
    out, k, find = [], -1, values.index
    try:
        while True:
            k = find(None, k + 1)
            out.append(k)
    except ValueError:
        return out


class Encoder:
    """Maps whole texts to their ids (as bytes) or to their number of ids.

    New cells of a run of texts go to the library as one text. Each of them
    begins with a space, and a space begins no other token, so the ids of a cell
    run from one such token to the next.
    """

    def __init__(self, path: str, count: bool):
        self.lib, self.count = library(path), count
        self._first: dict[str, object] = {}  # cells that begin a text
        self._next: dict[str, object] = {}  # cells after a space, without it

    def _whole(self, values):
        return sum(values) if self.count else b"".join(values)

    def _alone(self, texts: list[str]) -> list:
        """Values of texts that are not cut."""
        out = []
        for batch in by_bytes(texts):
            out += self.lib.lengths(batch) if self.count else [array.array("I", x).tobytes() for x in self.lib.ids(batch)]
        return out

    def _joined(self, parts: list[str]) -> list:
        """Values of cells that follow a space and have no odd white space."""
        out = []
        for batch in by_bytes(parts, CELL_BYTES):
            ids = np.array(self.lib.ids([" " + " ".join(batch)])[0], np.uint32)
            start = np.flatnonzero(self.lib.opens()[ids])
            if len(start) != len(batch):  # can't be, by what is said above
                out += self._alone([" " + p for p in batch])
                continue
            end = np.append(start[1:], len(ids))
            if self.count:
                out += (end - start).tolist()
            else:
                raw = ids.astype("<u4").tobytes()
                out += [raw[a:b] for a, b in zip((4 * start).tolist(), (4 * end).tolist())]
        return out

    @staticmethod
    def _learn(store: dict, need: set, values) -> None:
        new = [x for x in need if x not in store]
        if len(store) + len(new) > MAX_CELLS:
            # cells that came first are the frequent ones, as a rule: the later half goes
            known = [x for x in need if x in store]
            for x in list(itertools.islice(reversed(store), len(store) // 2)):
                del store[x]
            new += [x for x in known if x not in store]
        store.update(zip(new, values(new)))

    def encode(self, texts: list[str]) -> list:
        """The values of ``texts``, in order."""
        return [v for run in by_bytes(texts, RUN_BYTES) for v in self._run(run)]

    def _run(self, texts: list[str]) -> list:
        if not self.lib.safe:
            return self._alone(texts)
        split = [cells(t) for t in texts]
        heads = {s[0] for s, _ in split}
        self._learn(self._first, {h for h in heads if len(h) <= MAX_LENGTH}, self._alone)
        long = [h for h in heads if len(h) > MAX_LENGTH]
        first = dict(zip(long, self._alone(long)))
        get, known, parts, alone, waiting = self._next.get, self._first, set(), set(), []
        out = [None] * len(texts)
        for i, (s, odd) in enumerate(split):
            values = list(map(get, s))
            values[0] = known[s[0]] if len(s[0]) <= MAX_LENGTH else first[s[0]]
            if odd:
                alone.update([s[k] for k in odd])
                for k in odd:
                    values[k] = None
            if None in values:
                gaps = _gaps(values)
                parts.update([s[k] for k in gaps if k not in odd] if odd else [s[k] for k in gaps])
                waiting.append((i, values, gaps, odd))
            else:
                out[i] = self._whole(values)
        long = [p for p in parts if len(p) > MAX_LENGTH]
        parts.difference_update(long)
        long += alone
        once = dict(zip(long, self._alone([" " + p for p in long])))
        self._learn(self._next, parts, self._joined)
        store = self._next
        for i, values, gaps, odd in waiting:
            s = split[i][0]
            for k in gaps:
                values[k] = once[s[k]] if k in odd or len(s[k]) > MAX_LENGTH else store[s[k]]
            out[i] = self._whole(values)
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> Encoder:
    return Encoder(path, True)


@lru_cache(maxsize=4)
def packer(path: str) -> Encoder:
    """Whole texts to their ids as little-endian unsigned 32-bit integers."""
    return Encoder(path, False)
