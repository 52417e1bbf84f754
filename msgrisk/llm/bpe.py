"""Byte-pair encoding of whole texts, equal to that of the tokenizers library.

Two facts keep it fast. A match of the splitting pattern never runs from a visible
character into white space, so a text falls into independent chunks; the ids of a
chunk can be looked up and are computed once per worker. And what has common
characters only goes through tiktoken with the ranks of the same vocabulary; all
else is left to the tokenizers library itself.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed values of the two public vocabularies: splitting patterns and ids of bytes.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

CHUNK = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
VISIBLE = re.compile(f"[^{SPACES}]+")
# Where a single space is not the whole gap between two visible characters.
ODD_GAP = re.compile(f"[{SPACES}] | [{SPACES}]| \\Z")
# What str.split takes for white space and the vocabularies may not, and the reverse.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Characters on which every Unicode version and both libraries agree.
COMMON = re.compile("[\t-\r -~\u00a1-\u012f\u0132-\u017f]*")

CACHED = 200_000  # chunks kept per worker
CACHED_CHARS = 64  # longer chunks are computed each time
LEAF = 4096  # characters of one unsplit run that are encoded at once
AHEAD = 4  # characters behind a match that can change its end


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def packed(ids) -> bytes:
    if isinstance(ids, list):
        made = array("I", ids)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()
    return ids.astype("<u4").tobytes()


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches ``values[starts[i] : starts[i] + counts[i]]`` one after the other."""
    ends = np.cumsum(counts)
    shift = np.repeat(starts - (ends - counts), counts)
    return values[shift + np.arange(len(shift))]


def distinct_words(texts: list[str], pattern: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of some texts, each word's number in order, and words per text."""
    lists = pa.array(texts, pa.large_string())
    lists = pc.split_pattern(lists, pattern) if pattern else pc.ascii_split_whitespace(lists)
    words = lists.flatten().dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    numbers = words.indices.to_numpy(zero_copy_only=False)
    return words.dictionary.to_pylist(), numbers, pc.list_value_length(lists).to_numpy()


def per_text(ids: np.ndarray, starts, counts, numbers, words_per_text) -> list[bytes]:
    """Ids of each text, from those of its words."""
    flat = gather(ids, starts[numbers], counts[numbers])
    of_words = np.append(0, np.cumsum(counts[numbers]))
    ends = of_words[np.cumsum(words_per_text)]
    return [flat[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]), ends)]


class Cache(dict):
    """Ids of chunks; emptied when full, so its memory is bounded."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, chunk: str) -> bytes:
        found = self.compute(chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = found
        return found


def quiet_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@dataclass
class Part:
    """An encoded stretch of text: where its matches end, in characters and ids."""

    text: str
    ends: np.ndarray
    counts: np.ndarray
    ids: np.ndarray


class ByteBpe:
    """Encoder and decoder of a byte-level vocabulary with the pattern above."""

    def __init__(self, path: str):
        import tiktoken

        self.tokenizer = quiet_tokenizer(path)
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        plain = {t: i for t, i in data["model"]["vocab"].items() if t not in self.special}
        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in plain.items()}
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        make = lambda pattern: tiktoken.Encoding(
            "given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.split_encoder, self.run_encoder = make(BYTE_PATTERN), make(r"[\s\S]+")
        self.marks = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.chunks = Cache(self._chunk)
        self.spaced = Cache(lambda word: self._chunk(" " + word))
        self.lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, raw in self.bytes_of.items():
            self.lengths[i] = len(raw)
        self.starts = np.cumsum(self.lengths) - self.lengths
        joined = b"".join(self.bytes_of.get(i, b"") for i in range(len(self.lengths)))
        self.letters = np.frombuffer(joined, np.uint8)

    # -- whole texts -------------------------------------------------------

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if COMMON.fullmatch(text) and not self.marks.search(text):
            return packed(self.split_encoder.encode_ordinary(text))
        if not ODD_GAP.search(text):
            first, *rest = text.split(" ")
            return self.chunks[first] + b"".join(map(self.spaced.__getitem__, rest))
        return b"".join(map(self.chunks.__getitem__, CHUNK.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        """Text of ids in UTF-8; broken sequences become U+FFFD."""
        numbers = np.frombuffer(ids, "<u4")
        joined = gather(self.letters, self.starts[numbers], self.lengths[numbers]).tobytes()
        try:
            joined.decode()
            return joined
        except UnicodeDecodeError:
            return joined.decode("utf-8", "replace").encode()

    def _chunk(self, chunk: str) -> bytes:
        if len(chunk) > LEAF and not self.marks.search(chunk):
            return packed(self.part(chunk).ids)
        if COMMON.fullmatch(chunk) and not self.marks.search(chunk):
            return packed(self.split_encoder.encode_ordinary(chunk))
        return packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    # -- tree concatenation ------------------------------------------------

    def splits(self, text: str) -> np.ndarray:
        """Ends of the pattern's matches, by the tokenizers library's own splitter."""
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return np.array([end for _, (_, end) in found], np.int64)

    def run(self, text: str) -> np.ndarray:
        """Ids of one match, however long: a tree of halves."""
        if len(text) <= LEAF:
            return np.array(self.run_encoder.encode_ordinary(text), np.uint32)
        middle = len(text) // 2
        return self.join_runs(self.run(text[:middle]), self.run(text[middle:]))

    def join_runs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of two neighbouring stretches of one match.

        A sequence of ids is the encoding of its bytes if and only if each pair of
        neighbours is. So a window around the join settles it as soon as the
        window's outermost ids are those that the two sides have there.
        """
        size = 8
        while True:
            a = self._on_character(left, max(0, len(left) - size), -1)
            b = self._on_character(right, min(len(right), size), 1)
            window = self.run_encoder.encode_ordinary(
                self._bytes(left[a:]).decode() + self._bytes(right[:b]).decode()
            )
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return np.concatenate([left[:a], np.array(window, np.uint32), right[b:]])
            size *= 2

    def _bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def _on_character(self, ids: np.ndarray, at: int, step: int) -> int:
        """The next position whose id starts with the first byte of a character."""
        while 0 < at < len(ids) and self.bytes_of[int(ids[at])][0] & 0xC0 == 0x80:
            at += step
        return at

    def part(self, text: str) -> Part:
        """Encode a stretch that is cut anywhere and holds no special token."""
        ends = self.splits(text)
        runs = [self.run(text[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
        counts = np.cumsum([len(r) for r in runs], dtype=np.int64)
        ids = np.concatenate(runs) if runs else np.array([], np.uint32)
        return Part(text, ends, counts, ids.astype(np.uint32))

    def join(self, a: Part, b: Part) -> Part:
        """The encoding of two neighbouring stretches as one text.

        Matches of ``a`` that end well before the join stand. From there the text
        is split again, over a window that grows until it shares an end with ``b``.
        """
        if not len(a.text) or not len(b.text):
            return a if len(a.text) else b
        kept = int(np.searchsorted(a.ends, len(a.text) - AHEAD, "right"))
        start = int(a.ends[kept - 1]) if kept else 0
        before, reach = len(a.text) - start, 64
        while True:
            reach = min(reach, len(b.text))
            window = a.text[start:] + b.text[:reach]
            ends = self.splits(window)
            last = len(window) if reach == len(b.text) else len(window) - AHEAD
            good = ends[(ends >= before) & (ends <= last)]
            shared = good[np.isin(good - before, np.append(b.ends, 0))]
            if len(shared):
                break
            reach *= 4
        stop = int(shared[0])
        ends = ends[ends <= stop]
        dropped = int(np.searchsorted(b.ends, stop - before, "right"))
        runs = []
        for x, y in zip([0, *ends[:-1]], ends):
            if y - x > LEAF and x < before < y:
                runs.append(self._across(a, start + int(x), b, int(y) - before))
            else:
                runs.append(self.run(window[x:y]))
        base = int(a.counts[kept - 1]) if kept else 0
        gone = int(b.counts[dropped - 1]) if dropped else 0
        counts = base + np.cumsum([len(r) for r in runs], dtype=np.int64)
        middle = int(counts[-1]) if len(counts) else base
        return Part(
            a.text + b.text,
            np.concatenate([a.ends[:kept], start + ends, len(a.text) + b.ends[dropped:]]),
            np.concatenate([a.counts[:kept], counts, middle + b.counts[dropped:] - gone]),
            np.concatenate([a.ids[:base], *runs, b.ids[gone:]]).astype(np.uint32),
        )

    def _across(self, a: Part, start: int, b: Part, stop: int) -> np.ndarray:
        """A long match over the join, from what both sides have of it."""
        left = int(np.searchsorted(a.ends, start, "right"))
        same = start == (int(a.ends[left - 1]) if left else 0)
        if same and left == len(a.ends) - 1 and len(b.ends) and int(b.ends[0]) == stop:
            first = int(a.counts[left - 1]) if left else 0
            return self.join_runs(a.ids[first:], b.ids[: int(b.counts[0])])
        return self.run(a.text[start:] + b.text[:stop])

    def tree(self, parts: list[Part]) -> Part:
        """Join neighbours pairwise until one part is left."""
        while len(parts) > 1:
            pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
            parts = [self.join(*p) if len(p) == 2 else p[0] for p in pairs]
        return parts[0]


class WordBpe:
    """Encoder of a vocabulary with word ends, lower case and no white space.

    For tiktoken a word end is one more byte, which merges with the byte before it
    ahead of all else: the ids of single closing bytes are below those of all merges.
    """

    END = "\x00"

    def __init__(self, path: str):
        import regex
        import tiktoken

        self.tokenizer = quiet_tokenizer(path)
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        alphabet = byte_alphabet()
        special = {t["content"] for t in data["added_tokens"]}
        suffix = data["model"]["end_of_word_suffix"]
        ranks = {}
        for token, i in data["model"]["vocab"].items():
            if token not in special:
                body, end = (token[: -len(suffix)], b"\0") if token.endswith(suffix) else (token, b"")
                raw = bytes(map(alphabet.__getitem__, body)) + end
                if raw != b"\0" or not end:
                    ranks.setdefault(raw, i)
        ranks[b"\0"] = max(ranks.values()) + 1000  # never left over, but must have a rank
        self.encoder = tiktoken.Encoding(
            "given", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}
        )
        self.closing = np.zeros(ranks[b"\0"] + 1, bool)
        for raw, i in ranks.items():
            self.closing[i] = raw.endswith(b"\0")
        self.pieces = regex.compile(WORD_PATTERN)
        self.marks = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.chunks = Cache(self._chunk)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        words = VISIBLE.findall(text) if ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, words))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text; a word that many share is computed once."""
        easy = [bool(COMMON.fullmatch(t)) and not self.marks.search(t) for t in texts]
        found = iter(self._words([t.lower() for t, e in zip(texts, easy) if e]) if any(easy) else [])
        return [next(found) if e else self.encode(t) for t, e in zip(texts, easy)]

    def _words(self, texts: list[str]) -> list[bytes]:
        words, numbers, lengths = distinct_words(texts, None)
        pieces = [self.pieces.findall(w) for w in words]
        joined = "".join(p + self.END for some in pieces for p in some)
        ids = np.array(self.encoder.encode_ordinary(joined), "<u4")
        stops = np.append(0, np.flatnonzero(self.closing[ids]) + 1)
        of_words = np.append(0, np.cumsum([len(p) for p in pieces], dtype=np.int64))
        starts = stops[of_words[:-1]]
        return per_text(ids, starts, stops[of_words[1:]] - starts, numbers, lengths)

    def _chunk(self, chunk: str) -> bytes:
        if COMMON.fullmatch(chunk) and not self.marks.search(chunk):
            ended = self.END.join(self.pieces.findall(chunk.lower())) + self.END
            return packed(self.encoder.encode_ordinary(ended))
        return packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
