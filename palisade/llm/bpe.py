"""BPE encoding and decoding by an index of pair occurrences.

All new words of a batch are laid out in one array of symbols. An index maps
each pair that has a merge to all its positions there. Ranks that are active
(have positions) are applied in ascending order, each to all its positions from
left to right, and the lists of the pairs that a merge makes with its
neighbours are extended; pairs that a merge has broken are seen by comparing
the symbols at their positions. For the vocabularies meant here each merge's
parts come from merges of lower rank (checked on loading), so a merge never
makes a pair of a lower rank than its own, and applying a rank to all words at
once gives what merging word by word gives.

Words and chunks of up to ``MAX_LENGTH`` characters are kept from batch to batch,
up to ``MAX_BYTES`` each; a full store is emptied, which costs time only. Longer
ones are worked on and forgotten. At most ``MAX_SYMBOLS`` symbols (or one word) are
laid out at once.
"""

from __future__ import annotations

import array
import heapq
import json
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame

#: White space for this pattern language; Python's ``split`` also takes U+001C to U+001F.
_CONTROL = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Characters of words and chunks that are kept, and bytes that each store may take.
MAX_LENGTH = 64
MAX_BYTES = 160 << 20
#: Symbols of words that are encoded at once.
MAX_SYMBOLS = 2_000_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies:
    itself if it is visible, else the next of U+0100, U+0101, ..."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [""] * 256, 0x100
    for b in range(256):
        if b in visible:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


@lru_cache(maxsize=1)
def _classes() -> dict[str, str]:
    """The inside of a class for letters and for numbers, by Python's own tables:
    those of the regex module know letters that the library doesn't yet."""
    ranges: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(0x110000):
        r = ranges.get(unicodedata.category(chr(c))[0])
        if r is not None:
            if r and r[-1][1] == c - 1:
                r[-1][1] = c
            else:
                r.append([c, c])
    return {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in r) for k, r in ranges.items()}


def compiled(pattern: str):
    """``pattern`` with its classes written out."""
    import regex

    for k, inside in _classes().items():
        pattern = pattern.replace(f"[\\p{{{k}}}]", f"[{inside}]").replace(f"\\p{{{k}}}", inside)
    return regex.compile(pattern)


class Bpe:
    """A tokenizer file of the kind: NFC, white space, lower case; a pattern whose
    matches are the words; byte letters; merges with an end-of-word suffix."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, norm = spec["model"], spec["pre_tokenizer"], spec["normalizer"]
        kinds = [n["type"] for n in norm["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre["pretokenizers"]] != ["Split", "ByteLevel"] or spec["decoder"] or spec["post_processor"] or model["unk_token"]:
            raise ValueError("a tokenizer of another kind")
        self.suffix = model["end_of_word_suffix"] or ""
        self.pattern = compiled(pre["pretokenizers"][0]["pattern"]["Regex"])
        self.space = regex.compile(r"\s+")
        vocab = model["vocab"]
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in special.items()})
        self.special = special
        self.find_special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.suffix] for c in letters]
        #: (left, right) as one number -> (rank, merged)
        self.shift = max(self.tokens) + 1
        self.merges: dict[int, tuple[int, int]] = {}
        made: dict[int, int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            if made.get(a, -1) >= rank or made.get(b, -1) >= rank:
                raise ValueError("a merge whose parts have a higher rank")
            made.setdefault(c, rank)
            self.merges.setdefault(a * self.shift + b, (rank, c))
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            if max(made.get(vocab[a], -1), made.get(vocab[b], -1)) >= rank:
                raise ValueError("a merge whose parts have a higher rank")
        self._words: dict[str, array.array] = {}
        self._chunks: dict[str, tuple[bytes, str]] = {}
        self._words_size = self._chunks_size = 0

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, all words of a run of ``MAX_SYMBOLS`` at once."""
        out, held, size = [], [], 0
        for w in words:
            if held and size + 4 * len(w) > MAX_SYMBOLS:
                out += self._encode_run(held)
                held, size = [], 0
            held.append(w)
            size += len(w) if w.isascii() else 4 * len(w)
        return out + self._encode_run(held) if held else out

    def _encode_run(self, words: list[str]) -> list[list[int]]:
        merges, shift = self.merges, self.shift
        sym: list[int] = []
        ends: list[int] = []
        inner, last = self.inner, self.last
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            sym.extend([inner[b] for b in raw[:-1]])
            if raw:
                sym.append(last[raw[-1]])
            ends.append(len(sym))
            sym.append(-1)  # between words; no pair with it has a merge
        n = len(sym)
        # a word beyond the bound: 4 bytes a number instead of some 36
        kind = (lambda x: list(x)) if n <= 2 * MAX_SYMBOLS else (lambda x: array.array("i", x))
        sym = kind(sym)
        nxt = kind(range(1, n + 1))
        prv = kind(range(-1, n - 1))
        index: dict = {}
        for i in range(n - 1):
            a, b = sym[i], sym[i + 1]
            if a >= 0 and b >= 0:
                pair = a * shift + b
                if pair in merges:
                    if pair in index:
                        index[pair].append(i)
                    else:
                        index[pair] = kind((i,))
        active = [(merges[p][0], p) for p in index]
        heapq.heapify(active)
        while active:
            _, pair = heapq.heappop(active)
            where = sorted(index.pop(pair))
            a, b = divmod(pair, shift)
            c = merges[pair][1]
            for i in where:
                if sym[i] != a:
                    continue
                j = nxt[i]
                if j >= n or sym[j] != b:
                    continue
                sym[i], sym[j] = c, -2
                k = nxt[i] = nxt[j]
                if k < n:
                    prv[k] = i
                    if sym[k] >= 0:
                        p = c * shift + sym[k]
                        m = merges.get(p)
                        if m is not None:
                            if p in index:
                                index[p].append(i)
                            else:
                                index[p] = kind((i,))
                                heapq.heappush(active, (m[0], p))
                h = prv[i]
                if h >= 0 and sym[h] >= 0:
                    p = sym[h] * shift + c
                    m = merges.get(p)
                    if m is not None:
                        if p in index:
                            index[p].append(h)
                        else:
                            index[p] = kind((h,))
                            heapq.heappush(active, (m[0], p))
        out, i = [], 0
        for e in ends:
            out.append([s for s in sym[i:e] if s >= 0])
            i = e + 1
        return out

    def _learn(self, chunks: list[str]) -> dict[str, tuple[bytes, str]]:
        """Ids and decoded text of chunks (texts without white space, normalised):
        those of short chunks are kept, all are given back."""
        parts = [self.pattern.findall(c) for c in chunks]
        words = self._words
        need = {w for p in parts for w in p}
        if self._words_size > MAX_BYTES:
            words.clear()
            self._words_size = 0
        new = [w for w in need if w not in words]
        once = dict(zip(new, self.encode_words(new)))
        for w in new:
            if len(w) <= MAX_LENGTH:
                words[w] = array.array("I", once[w])
                self._words_size += 250 + len(w) + 4 * len(once[w])
        if self._chunks_size > MAX_BYTES:
            self._chunks.clear()
            self._chunks_size = 0
        out = {}
        for c, p in zip(chunks, parts):
            ids = array.array("I")
            for w in p:
                ids.extend(words[w] if len(w) <= MAX_LENGTH else once[w])
            out[c] = value = (ids.tobytes(), self.decode(ids))
            if len(c) <= MAX_LENGTH:
                self._chunks[c] = value
                self._chunks_size += 350 + len(c) + len(value[0]) + 2 * len(value[1])
        return out

    def decode(self, ids) -> str:
        """As the library without a decoder: the tokens, a space between them."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")  # lower case letter by letter
        text = text.lower()
        if any(c in text for c in _CONTROL):
            return [c for c in self.space.split(text) if c]
        return text.split()

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids (little-endian unsigned 32-bit) and its decoded text."""
        split = []
        for t in texts:
            if self.find_special is None or "<|" not in t:
                split.append(self._split(t))
                continue
            parts, at = [], 0
            for m in self.find_special.finditer(t):
                parts += self._split(t[at : m.start()])
                parts.append(self.special[m.group()])
                at = m.end()
            split.append(parts + self._split(t[at:]))
        out = []
        known = self._chunks
        get = known.get
        values = [list(map(get, s)) for s in split]
        new = self._learn(list({c for s, v in zip(split, values) if None in v for c, x in zip(s, v) if x is None and not isinstance(c, int)}))
        for s, found in zip(split, values):
            if None in found:
                found = [x if x is not None else (c.to_bytes(4, "little"), self.tokens[c]) if isinstance(c, int) else new[c] for c, x in zip(s, found)]
            out.append((b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[0]])))
        return out


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def _texts(column, most: int = 1 << 20):
    """Runs of a column's texts of about ``most`` characters; null is empty."""
    held, size = [], 0
    for t in column:
        t = t.as_py() or ""
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_decode(docs: DataFrame, tokenizer: str, keep_text: bool = False) -> DataFrame:
    """A row per document: doc_id, n_tokens, ids_sha256 and decoded_sha256, and
    with ``keep_text`` also ``ids`` and ``decoded`` themselves.

    Null and empty texts have no ids and decode to the empty text. Very long texts
    and very long words are encoded whole. Repeated rows and null ids stay, a row each; other columns are not read.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        model = bpe(tokenizer)
        for b in batches:
            at = 0
            for texts in _texts(b.column(1)):
                found = model.encode(texts)
                columns = [
                    b.column(0).slice(at, len(texts)),
                    pa.array([len(i) // 4 for i, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i, _ in found]),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for _, t in found]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_text:
                    columns += [pa.array([list(array.array("I", i)) for i, _ in found], pa.list_(pa.int32())), pa.array([t for _, t in found])]
                    names += ["ids", "decoded"]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_text
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, schema)
