"""Merge-rank piece encoding by a prefix table, and decoding.

Every prefix of a text has one last token in its encoding. The table keeps that token for each prefix: all vocabulary
pieces that end at a place come from an Aho-Corasick automaton, and a piece is the last one exactly if it is compatible
with the last token of the prefix before it, that is, if merging the two pieces' characters in rank order leaves just
these two. Ids are then recovered from the end of the text backwards. Characters outside the vocabulary stand alone and
become byte pieces.

Before the table is built a text is cut where no piece can reach across: before the space mark that follows another
character, and before line ends. Cuts are independent, so a bounded per-worker cache of cuts makes common words cheap; a long cut runs in
time linear in its length and is not cached.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from rhoscape.llm.common import CACHES, Generations, map_batches, texts

MARK = "▁"
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: Entries of a cache generation, of which there are two.
CACHE_ENTRIES = 160_000
CACHED_CHARS = 48
PAIRS = 400_000
#: Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes):
    """Field numbers and values of a serialised message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """A merge-rank piece vocabulary read from its model file."""

    def __init__(self, path: str) -> None:
        import struct

        import ahocorasick

        self.pieces: list[str] = []
        self.types: list[int] = []
        scores: list[float] = []
        self.dummy_prefix, self.squeeze, self.escape, charsmap, kind = True, True, True, b"", 1
        with open(path, "rb") as f:
            message = f.read()
        for number, value in _fields(message):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.types.append(piece.get(3, NORMAL))
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                charsmap = spec.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if kind != 2 or charsmap or self.squeeze or not self.escape or not self.dummy_prefix:
            raise ValueError("only merge-rank models with identity normalisation and a dummy prefix are supported")
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        for i, (piece, type_) in enumerate(zip(self.pieces, self.types)):
            if type_ == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
            elif type_ == NORMAL:
                self.ids[piece] = i
            elif type_ in (USER_DEFINED, UNUSED):
                raise ValueError("user-defined and unused pieces are not supported")
        self.rank = {i: r for r, i in enumerate(sorted(self.ids.values(), key=lambda i: (-scores[i], i)))}
        # No piece may cross a cut.
        self.cuttable = not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.ids)
        # Punctuation that no piece has after a letter; what ends in it is cut there.
        self.enders = {c for c in ".,!?;:" if not any(p[k - 1].isalpha() for p in self.ids for k in range(1, len(p)) if p[k] == c)}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            parts = self._merge(list(piece))
            if parts == [piece]:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        #: What a piece shows, None where the neighbours matter (byte pieces) or nothing ordinary is shown.
        self.shown = [p.replace(MARK, " ") if t == NORMAL else None for p, t in zip(self.pieces, self.types)]
        self.names = [str(i) for i in range(len(self.pieces))]

    def _merge(self, parts: list[str]) -> list[str]:
        """Pieces left when neighbours are merged in rank order, the leftmost first among equals."""
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.rank[i] < best):
                    best, at = self.rank[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the characters of two pieces, merged together, leave just the two."""
        key = left << 20 | right
        found = self.pairs.get(key)
        if found is None:
            a, b = self.pieces[left], self.pieces[right]
            found = self._merge(list(a + b)) == [a, b]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def encode_part(self, part: str) -> list[int]:
        """Ids of one cut."""
        n = len(part)
        last: list[int] = [-1] * (n + 1)  # -1: the prefix ends in a character without a piece, or is empty
        size = [1] * (n + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (i, length) in self.automaton.iter(part):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - length]
            if before < 0:
                # Nothing merges across a character without a piece; the place itself must be reachable.
                last[end], size[end] = i, length
                continue
            fit = pairs.get(before << 20 | i)
            if fit if fit is not None else compatible(before, i):
                last[end], size[end] = i, length
        out: list[int] = []
        at = n
        while at:
            if last[at] >= 0:
                out.append(last[at])
                at -= size[at]
            else:
                at -= 1
                out.extend(self.byte_ids[b] for b in reversed(part[at].encode()))
        out.reverse()
        return out

    def cut(self, text: str) -> list[str]:
        """Names of the independent parts of the normalised text; part() gives their text.

        Most words stand between single spaces, and their name is the word itself, without its space mark.
        """
        if not text:
            return []
        if not self.cuttable:
            return [MARK + text.replace(" ", MARK)]
        words = text.split(" ")
        if "" in words or MARK in text:
            return re.split(f"(?<=[^{MARK}])(?={MARK})", MARK + text.replace(" ", MARK))
        if "\n" in text:
            out = []
            for word in words:
                if "\n" in word:
                    first, *rest = word.split("\n")
                    out.append(first or MARK)
                    out += ["\n" + line for line in rest]
                else:
                    out.append(word)
            return out
        return words

    @staticmethod
    def part(name: str) -> str:
        return name if name[0] in MARK + "\n" else MARK + name

    def encode(self, text: str) -> list[int]:
        return [i for name in self.cut(text) for i in self.encode_part(self.part(name))]

    def decode_part(self, ids: list[int]) -> str:
        """Text of ids without regard to the dummy prefix; runs of byte pieces are read as UTF-8."""
        plain = [self.shown[i] for i in ids]
        if None not in plain:
            return "".join(plain)
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if self.types[i] == BYTE:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            if self.types[i] == NORMAL:
                out.append(self.shown[i])
            elif self.types[i] == UNKNOWN:
                out.append(" ⁇ ")
        if run:
            out.append(run.decode(errors="replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_part(ids)
        return text[1:] if text.startswith(" ") else text


_models: dict[str, tuple[PieceModel, Generations]] = {}


def load(path: str) -> tuple[PieceModel, Generations]:
    """The model of a file and its cache of cuts, once in each process."""
    if path not in _models:
        _models[path] = (PieceModel(path), Generations(CACHE_ENTRIES))
    return _models[path]


CACHES[__name__] = _models.clear


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Rows of doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of docs.

    Null and empty texts have no tokens and the digests of the empty text; a null doc_id stays null; repeated rows
    each give a row; other columns are ignored; an empty table gives no rows. A space mark that a text itself has is
    decoded as a space, as the library does.
    """

    def make():
        model, cache = load(path)
        names, enders = model.names, model.enders

        def shown(ids: list[int]) -> tuple[str, int, str]:
            return ",".join([names[i] for i in ids]), len(ids), model.decode_part(ids)

        ends = {c: shown(model.encode_part(c)) for c in enders}

        def entry(name: str) -> tuple[str, int, str]:
            made = cache.find(name)
            if made is None:
                if name[-1] in enders and name[-2:-1].isalpha():
                    word, end = entry(name[:-1]), ends[name[-1]]
                    made = (f"{word[0]},{end[0]}", word[1] + end[1], word[2] + end[2])
                else:
                    made = shown(model.encode_part(model.part(name)))
                if len(name) <= CACHED_CHARS:
                    cache.put(name, made)
            return made

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, encoded, decoded = [], [], []
            for text in texts(batch):
                get = cache.new.get
                ids, sizes, parts = zip(*[get(p) or entry(p) for p in model.cut(text)]) if text else ((), (), ())
                counts.append(sum(sizes))
                encoded.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                back = "".join(parts)
                decoded.append(hashlib.sha256((back[1:] if back.startswith(" ") else back).encode()).hexdigest())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return step

    return map_batches(docs.select("doc_id", "text"), make, SCHEMA)
