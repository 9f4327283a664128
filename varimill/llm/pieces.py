"""SentencePiece encoding and decoding for merge-type (BPE) models.

Exact encoding without a merge queue: walk the text with the longest vocabulary
match at each place (Aho-Corasick), accept a token only if re-merging it together
with its left neighbour gives back just the two, otherwise try the next shorter
match; when none is left, mark the place as failed in a bitfield and go back one
token. A token sequence whose neighbours all agree is the one merging gives.

No piece of the supported models goes from a letter on to a word mark, so words
are independent; each distinct word is encoded once per process and remembered.

Null texts are taken as empty; an empty text has only the begin and end ids.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from varimill.llm.frames import map_arrays, process_cache
from varimill.llm.words import chunks

MARK = "▁"
CACHED_WORDS = 300_000  # in each of two generations of a process's cache
CACHED_CHARS = 64
CHUNK = 4 << 20  # bytes of text encoded at once: a step of all its words costs a few calls


@dataclass(frozen=True)
class PieceModel:
    """What a model file says, as plain data that can be sent to executors."""

    name: str
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: frozenset[int]
    bytes_first: int
    begin: int
    end: int

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Read a model file. Raises ValueError for a kind that is not supported."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        norm, kinds = proto.normalizer_spec, [p.type for p in proto.pieces]
        piece = pb.ModelProto.SentencePiece
        supported = (
            proto.trainer_spec.model_type == pb.TrainerSpec.BPE
            and proto.trainer_spec.byte_fallback
            and not proto.trainer_spec.treat_whitespace_as_suffix
            and not norm.precompiled_charsmap
            and norm.add_dummy_prefix
            and norm.escape_whitespaces
            and not norm.remove_extra_whitespaces
            and piece.USER_DEFINED not in kinds
            and piece.UNUSED not in kinds
            and kinds.count(piece.BYTE) == 256
        )
        pieces = tuple(p.piece for p in proto.pieces)
        if not supported or any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("not a byte-fallback merge model with word marks in front")
        return cls(
            path,
            pieces,
            tuple(p.score for p in proto.pieces),
            frozenset(i for i, k in enumerate(kinds) if k == piece.NORMAL),
            kinds.index(piece.BYTE),
            proto.trainer_spec.bos_id,
            proto.trainer_spec.eos_id,
        )


class PieceCodec:
    """Encodes and decodes with one model."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.ids = {model.pieces[i]: i for i in model.normal}
        self.rank = {p: model.scores[i] for p, i in self.ids.items()}
        # A piece that merging never reaches from its own letters is no candidate.
        self.reached = {p for p in self.ids if self.merge(p) == [p]}
        self.finder = ahocorasick.Automaton()
        for p in self.reached:
            self.finder.add_word(p, p)
        self.finder.make_automaton()
        self.shorter: dict[str, str] = {}
        self.agree: dict[str, dict[str, bool]] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.first, self.last = (np.array([i], "<u4").tobytes() for i in (model.begin, model.end))
        spelled = [
            p.replace(MARK, " ").encode() if i in model.normal else b""
            for i, p in enumerate(model.pieces)
        ]
        for b in range(256):
            spelled[model.bytes_first + b] = bytes([b])
        self.sizes = np.array([len(x) for x in spelled])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.walk = _Walk(self)

    def merge(self, text: str) -> list[str]:
        """Merge the neighbours with the best score, leftmost first, to the end."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _agree(self, left: str, right: str) -> bool:
        known = self.merge(left + right) == [left, right]
        self.agree.setdefault(left, {})[right] = known
        return known

    def _shorter(self, token: str) -> str | None:
        """The next shorter piece at the same place, a single character last."""
        if len(token) == 1:
            return None
        known = self.shorter.get(token)
        if known is None:
            known = next(
                (token[:n] for n in range(len(token) - 1, 1, -1) if token[:n] in self.reached),
                token[0],
            )
            self.shorter[token] = known
        return known

    def split(self, text: str) -> list[str]:
        """Text with word marks to its tokens; unknown characters stand alone."""
        n = len(text)
        longest = list(text)
        for end, piece in self.finder.iter(text):
            longest[end - len(piece) + 1] = piece
        tokens: list[str] = []
        failed = bytearray(n + 1)
        at, token, left, partners = 0, longest[0] if n else None, None, {}
        while token is not None:
            while True:
                end = at + len(token)
                if not failed[end]:
                    fits = True if left is None else partners.get(token)
                    if fits is None:
                        fits = self._agree(left, token)
                    if fits:
                        tokens.append(token)
                        at, left = end, token
                        partners = self.agree.setdefault(left, {})
                        token = longest[at] if at < n else None
                        break
                shorter = self._shorter(token)
                if shorter is None:
                    failed[at] = 1
                    token = tokens.pop()
                    at -= len(token)
                    left = tokens[-1] if tokens else None
                    partners = self.agree.setdefault(left, {}) if tokens else {}
                    break
                token = shorter
        return tokens

    def _ids(self, tokens: list[str]) -> list[int]:
        found = []
        for token in tokens:
            known = self.ids.get(token)
            if known is None:
                found += [self.model.bytes_first + b for b in token.encode()]
            else:
                found.append(known)
        return found

    def decode(self, ids: np.ndarray) -> str:
        """Ids to text: control ids vanish, byte ids are put together, the mark
        before the first word goes."""
        sizes = self.sizes[ids]
        shown = np.flatnonzero(sizes)
        total = int(sizes.sum())
        # Place in the spellings of each output byte: the start of its id, then on.
        ends = np.cumsum(sizes)
        take = np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(total)
        text = self.letters[take].tobytes().decode("utf-8", "replace")
        marked = len(shown) and self.model.pieces[ids[shown[0]]].startswith(MARK)
        return text[1:] if marked else text

    def _segment(self, text: str) -> bytes:
        return np.array(self._ids(self.split(text)), "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """A word as ``_cut`` gives it: behind a mark, or behind a line end."""
        if word[:1] == "\n":
            return np.array(self._ids(["\n"]), "<u4").tobytes() + self._segment(word[1:])
        return self._segment(MARK + word)

    @staticmethod
    def _cut(text: str) -> list[str]:
        # A line end is no piece and joins nothing, so what follows starts anew.
        return text.replace(MARK, " ").replace("\n", " \n").split(" ")

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Words among which spaces stand in a row: a run of marks is one segment."""
        made, run = [], 0
        for word in words:
            if not word:
                run += 1
            elif word[0] == "\n":
                made += [self._segment(MARK * run)] * (run > 0) + [self.words[word]]
                run = 0
            else:
                made.append(self._segment(MARK * (run + 1) + word) if run else self.words[word])
                run = 0
        return made + [self._segment(MARK * run)] * (run > 0)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with begin and end id."""
        cut = [self._cut(x) if x else [] for x in texts]
        words = set(chain.from_iterable(cut))
        words.discard("")
        if len(self.words) >= CACHED_WORDS:
            self.older, self.words = self.words, {}
        missing = words.difference(self.words)
        for word in missing.intersection(self.older):
            self.words[word] = self.older[word]
        missing.difference_update(self.older)
        self.words.update(self.walk.encode(missing))
        for word in missing.difference(self.words):
            self.words[word] = self._word(word)
        known = self.words.__getitem__
        made = [
            b"".join([self.first, *(self._spaced(w) if "" in w else map(known, w)), self.last])
            for w in cut
        ]
        for word in words:
            if len(word) > CACHED_CHARS:
                del self.words[word]
        return made


class _Pairs:
    """Neighbours that are known to agree or not, in a hash table of two places a pair;
    those that find both taken are in a dictionary."""

    def __init__(self, bits: int = 18) -> None:
        self.n = 0
        self._empty(bits)

    def _empty(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.full((2, 1 << bits), -1, np.int64)
        self.fits = np.zeros((2, 1 << bits), np.int8)
        self.others: dict[int, int] = {}

    def _place(self, pairs: np.ndarray, turn: int) -> np.ndarray:
        spread = pairs.astype(np.uint64) * np.uint64((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)[turn])
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, pairs: np.ndarray) -> np.ndarray:
        """1 for a pair that agrees, 0 for one that does not, -1 for an unknown one."""
        place = self._place(pairs, 0)
        out = np.where(self.keys[0, place] == pairs, self.fits[0, place], np.int8(-1))
        left = np.flatnonzero(out < 0)
        if len(left):
            place = self._place(pairs[left], 1)
            out[left] = np.where(self.keys[1, place] == pairs[left], self.fits[1, place], np.int8(-1))
            if self.others:
                left = left[out[left] < 0]
                out[left] = [self.others.get(p, -1) for p in pairs[left].tolist()]
        return out

    def add(self, pairs: np.ndarray, fits: list[bool]) -> None:
        """Pairs that are not known yet, each once."""
        self.n += len(pairs)
        fits = np.array(fits, np.int8)
        if self.n > 1 << self.bits - 1:
            held = self.keys[self.keys >= 0], self.fits[self.keys >= 0]
            others = np.array(list(self.others), np.int64), np.array(list(self.others.values()), np.int8)
            pairs, fits = (np.concatenate(x) for x in zip((pairs, fits), held, others, strict=True))
            self._empty(self.bits + 1)
        for turn in range(2):
            place = self._place(pairs, turn)
            free = self.keys[turn, place] < 0
            self.keys[turn, place[free]], self.fits[turn, place[free]] = pairs[free], fits[free]
            # Of several at one place the last has stayed.
            left = self.keys[turn, place] != pairs
            pairs, fits = pairs[left], fits[left]
        self.others.update(zip(pairs.tolist(), fits.tolist(), strict=True))


class _Walk:
    """The same backtracking over many words in step, as array operations.

    Takes words of common characters of at most 60 places; the codec encodes
    the others one by one.
    """

    LETTERS = 127
    PLACES = 62

    def __init__(self, codec: PieceCodec) -> None:
        self.codec = codec
        counts = Counter(chain.from_iterable(codec.reached))
        letters = [c for c, _ in counts.most_common() if c in codec.ids][: self.LETTERS]
        self.letter = np.zeros(0x110000, np.uint8)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        pieces = codec.model.pieces
        self.size = np.array([len(p) for p in pieces])
        # A trie as a table: next node of (node, letter); node 0 is dead, 1 the root.
        table, self.final = [[0] * (len(letters) + 1) for _ in range(2)], [-1, -1]
        of = {c: i + 1 for i, c in enumerate(letters)}
        usable = [p for p in codec.reached if all(c in of for c in p)]
        for piece in usable:
            node = 1
            for c in piece:
                if not table[node][of[c]]:
                    table[node][of[c]] = len(table)
                    table.append([0] * (len(letters) + 1))
                    self.final.append(-1)
                node = table[node][of[c]]
            self.final[node] = codec.ids[piece]
        self.table, self.final = np.array(table, np.int32), np.array(self.final, np.int32)
        self.shorter = np.full(len(pieces), -1, np.int32)
        for piece in usable:
            shorter = codec._shorter(piece)
            if shorter is not None:
                self.shorter[codec.ids[piece]] = codec.ids[shorter]
        self.known = _Pairs()

    def _longest(self, letters: np.ndarray) -> np.ndarray:
        """Id of the longest piece that starts at each place."""
        found = np.full(len(letters), -1, np.int32)
        at, node = np.arange(len(letters)), np.ones(len(letters), np.int32)
        depth = 0
        while len(at):
            node = self.table[node, letters[at + depth]]
            live = node > 0
            at, node = at[live], node[live]
            final = self.final[node]
            found[at[final >= 0]] = final[final >= 0]
            depth += 1
        return found

    def _agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left.astype(np.int64) << 32 | right
        fits = self.known.get(pairs)
        unknown = fits < 0
        if unknown.any():
            new = np.unique(pairs[unknown])
            pieces, agree = self.codec.model.pieces, self.codec._agree
            self.known.add(new, [agree(pieces[p >> 32], pieces[p & 0xFFFFFFFF]) for p in new.tolist()])
            fits[unknown] = self.known.get(pairs[unknown])
        return fits > 0

    def encode(self, words: Iterable[str]) -> dict[str, bytes]:
        words = [w for w in words if len(w) < self.PLACES - 1 and w != "\n"]
        if not words:
            return {}
        parts = [w[1:] if w[0] == "\n" else MARK + w for w in words]
        joined = "\0".join(parts) + "\0"
        letters = self.letter[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        sizes = np.array([len(x) for x in parts])
        starts = np.cumsum(sizes + 1) - sizes - 1
        common = np.add.reduceat(letters == 0, starts) == 1  # the zero behind the word only
        longest = self._longest(np.append(letters, 0))
        active = np.flatnonzero(common)
        at, depth = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        stack = np.zeros((len(words), self.PLACES + 1), np.int32)  # the first place stays 0
        failed = np.zeros(len(words), np.int64)
        token = longest[starts]
        while len(active):
            t, left = token[active], stack[active, depth[active]]
            end = at[active] + self.size[t]
            good = (failed[active] >> end & 1) == 0
            inner = good & (depth[active] > 0)
            good[inner] = self._agree(left[inner], t[inner])
            done, end = active[good], end[good]
            depth[done] += 1
            stack[done, depth[done]] = t[good]
            at[done] = end
            more = end < sizes[done]
            token[done[more]] = longest[starts[done[more]] + end[more]]
            bad = active[~good]
            shorter = self.shorter[token[bad]]
            token[bad] = shorter
            back = bad[shorter < 0]
            failed[back] |= 1 << at[back]
            token[back] = stack[back, depth[back]]
            at[back] -= self.size[token[back]]
            depth[back] -= 1
            active = np.concatenate([done[more], bad])
        ends = np.cumsum(np.where(common, depth, 0))
        cells = (np.arange(self.PLACES) < depth[:, None]) & common[:, None]
        raw = stack[:, 1:][cells].astype("<u4").tobytes()
        bounds = np.concatenate([[0], ends * 4]).tolist()
        new_line = np.array(self.codec._ids(["\n"]), "<u4").tobytes()
        return {
            w: (new_line if w[0] == "\n" else b"") + raw[bounds[i] : bounds[i + 1]]
            for i, w in enumerate(words)
            if common[i]
        }


def _codec(model: PieceModel) -> PieceCodec:
    cache = process_cache("piece_codecs")
    if model.name not in cache:
        cache[model.name] = PieceCodec(model)
    return cache[model.name]


def encode_decode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Add ``piece_ids`` (little-endian 32-bit ids in one binary), ``n_tokens`` and
    ``decoded`` to every row. Columns of these names are replaced.

    One pass without a shuffle; the model is read once, in the driver, and sent
    along as data of fixed size.
    """
    model = docs.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))

    def make(column: pa.Array) -> list[pa.Array]:
        codec = _codec(model.value)
        made = []
        for low, high, _, _ in chunks(column, CHUNK):
            made += codec.encode_all(column[low:high].to_pylist())
        return [
            pa.array(made, pa.binary()),
            pa.array([len(m) // 4 for m in made], pa.int64()),
            pa.array([codec.decode(np.frombuffer(m, "<u4")) for m in made], pa.string()),
        ]

    fields = [
        T.StructField("piece_ids", T.BinaryType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("decoded", T.StringType()),
    ]
    return map_arrays(docs, [text], fields, make)
