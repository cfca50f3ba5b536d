"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The texts of a block are cut into segments across which the vocabulary has no
piece: a segment starts where a space follows something else, and at characters
that occur in no piece.  Segments not seen before by the worker are encoded
together: their symbols lie in one flat array; each round takes, in every
segment at once, the leftmost pair of least rank (the highest score, as the
library's agenda does), merges it, compacts the array and ranks the two pairs
that changed.  Segments leave the array when no pair of theirs is a piece.
Characters that are no piece become byte pieces.

Segments above ``LONG`` symbols, as of texts without spaces, merge in the same
rounds but in many places at once.  A pair that nothing of lower rank precedes or
follows within ``reach`` symbols, the length of the longest piece, is merged
before any of its neighbours in the leftmost-least order too: whatever would
consume one of its symbols first would have to be a piece that spans the reach.
Pairs of the same rank in a row merge alternately from its first.  Where a pair
would make one of no higher rank with its neighbours, pairs of its rank behind it
wait for the next round.  Such segments are first cut between characters that are
neighbours in no piece.

Decoding gathers the bytes of all ids of a block through one piece table; a
leading space is dropped, as the encoder has put it there.

A null text is encoded like an empty one: no ids, and an empty decoded text.
Rows are independent: null or repeated ids, repeated rows and further columns,
whatever their names, do not matter.  Memory follows the longest text.  The
model's tables (bounded by the vocabulary) are broadcast.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import blocks, ranges, sliding_min

LONG, CACHE = 2048, 200_000
_SPACE = "▁"
_NO = np.int64(1 << 40)


class PieceTables:
    """What the rounds need of a BPE model: characters, pairs with ranks, piece bytes."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = schema.ModelProto.SentencePiece
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with an identity normaliser are supported")
        if any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.UNUSED)}
        self.n = len(model.pieces)
        self.surface = [p.piece.replace(_SPACE, " ").encode() if p.type in (kinds.NORMAL, kinds.UNUSED) else b"" for p in model.pieces]
        self.byte_ids = np.full(256, -1, np.int64)
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.surface[self.unknown] = spec.unk_surface.encode()
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.surface[i] = bytes([int(p.piece[1:-1], 16)])
        self.fallback = bool(spec.byte_fallback)

        # Symbols below n are pieces; from n on, characters that occur in pieces without being one.
        symbols = dict(ids)
        for piece in ids:
            for c in piece:
                symbols.setdefault(c, self.n + len(symbols) - len(ids))
        self.size = self.n + len(symbols) - len(ids)
        self.extra = ["".join(c for c, s in symbols.items() if s == i) for i in range(self.n, self.size)]
        singles = sorted((ord(c), s) for c, s in symbols.items() if len(c) == 1)
        self.codes = np.array([c for c, _ in singles], np.int64)
        self.code_symbol = np.array([s for _, s in singles], np.int64)
        scores = sorted({model.pieces[i].score for i in ids.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        pairs = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = (rank[model.pieces[i].score], i)
        keys = sorted(pairs)
        self.pair = np.array(keys, np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in keys], np.int64)
        self.pair_to = np.array([pairs[k][1] for k in keys], np.int64)
        # Symbols none of whose pairs ranks at or before the pair that makes them.
        made = np.full(self.size, -1, np.int64)
        np.maximum.at(made, self.pair_to, self.pair_rank)
        least = np.full(self.size, _NO)
        np.minimum.at(least, self.pair // self.size, self.pair_rank)
        np.minimum.at(least, self.pair % self.size, self.pair_rank)
        self.settled = least > made
        self.reach = max(len(piece) for piece in ids)
        near = {ord(a) << 21 | ord(b) for piece in ids for a, b in zip(piece, piece[1:], strict=False)}
        self.neighbours = np.array(sorted(near), np.int64)
        inner = {c for piece in ids if len(piece) > 1 for c in piece}
        crossing = any(_SPACE in piece.lstrip(_SPACE) for piece in ids)
        alone = "".join(c for c in "\n\t" if c not in inner)
        self.pattern = "(?s).+" if crossing else f" *[^ {alone}]+| +|[{alone}]" if alone else " *[^ ]+| +"


class PieceCodec:
    """Encoder and decoder over a model's tables; keeps segments it has met."""

    def __init__(self, tables: PieceTables):
        self.t = tables
        self.split = re.compile(tables.pattern).findall
        self.surface_bytes = np.frombuffer(b"".join(tables.surface), np.uint8)
        self.surface_length = np.array([len(x) for x in tables.surface], np.int64)
        self.surface_start = np.append(0, np.cumsum(self.surface_length))[:-1]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.start, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.t.size + right
        at = np.minimum(np.searchsorted(self.t.pair, key), len(self.t.pair) - 1)
        ok = (self.t.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.t.pair_rank[at], _NO), self.t.pair_to[at]

    def _symbols(self, text: str) -> np.ndarray:
        """Symbols of a text's characters (-1 - code point where there is none)."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        code[code == 0x20] = ord(_SPACE)
        at = np.minimum(np.searchsorted(self.t.codes, code), len(self.t.codes) - 1)
        return np.where(self.t.codes[at] == code, self.t.code_symbol[at], -1 - code)

    def _cuts(self, text: str) -> np.ndarray:
        """Which characters of a text can follow the one before them inside no piece."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        code[code == 0x20] = ord(_SPACE)
        key = code[:-1] << 21 | code[1:]
        at = np.minimum(np.searchsorted(self.t.neighbours, key), len(self.t.neighbours) - 1)
        return np.append(False, self.t.neighbours[at] != key)

    def _first_of_segment(self, segment: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The leftmost pair of least rank of each segment."""
        head = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        least = np.minimum.reduceat(rank, head)
        hit = np.flatnonzero(rank == np.repeat(least, np.diff(np.append(head, len(rank)))))
        return hit[np.append(True, segment[hit[1:]] != segment[hit[:-1]])]

    def _first_in_reach(self, symbol: np.ndarray, rank: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Pairs that no pair within reach can prevent."""
        reach, n = self.t.reach, len(rank)

        def around(values):
            least = sliding_min(np.concatenate([np.full(reach, _NO), values, np.full(reach, _NO)]), reach)
            return least[:n], least[reach + 1 : reach + 1 + n]

        before, after = around(rank)
        free = (rank < _NO) & (before >= rank) & (after >= rank)
        row = np.append(False, rank[1:] == rank[:-1])
        first = np.maximum.accumulate(np.where(row, 0, np.arange(n)))
        free &= ((np.arange(n) - first) & 1 == 0) & (before[first] >= rank)
        loud = self._loud(symbol, rank, to, np.flatnonzero((after == rank) & (rank < _NO) & ~self.t.settled[to]))
        if len(loud):
            noise = np.full(n, _NO)
            noise[loud] = rank[loud]
            count = np.cumsum(np.append(0, noise < _NO))
            noise, _ = around(noise)
            free &= (noise[first] > rank) & (noise > rank) & (count[first] == count[:-1])
        return np.flatnonzero(free)

    def _loud(self, symbol: np.ndarray, rank: np.ndarray, to: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the pairs ``at`` might make, with a neighbour as it is or as merged alike, a pair of no higher rank."""
        if not len(at):
            return at
        left = np.concatenate([[-1], symbol])[at]
        right = np.append(symbol, [-1, -1])[at + 2]
        alike = np.concatenate([[_NO, _NO], rank, [_NO, _NO]])
        merged = np.concatenate([[-1, -1], to, [-1, -1]])
        both = [(left, to[at]), (to[at], right)]
        both.append((np.where(alike[at] == rank[at], merged[at], -1), to[at]))
        both.append((to[at], np.where(alike[at + 4] == rank[at], merged[at + 4], -1)))
        return at[np.minimum.reduce([self._rank(x, y)[0] for x, y in both]) <= rank[at]]

    def _rounds(self, symbol: np.ndarray, segment: np.ndarray, local: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair remains; symbols and their segments, segments ascending.

        A round merges the first pair of each segment, or if ``local`` all that are first in their reach.
        """
        done_symbol, done_segment = [], []
        rank = np.full(len(symbol), _NO)
        to = np.zeros(len(symbol), np.int64)
        inside = np.flatnonzero(segment[1:] == segment[:-1])
        rank[inside], to[inside] = self._rank(symbol[inside], symbol[inside + 1])
        while len(symbol):
            head = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            size = np.diff(np.append(head, len(symbol)))
            live = np.repeat(np.minimum.reduceat(rank, head) < _NO, size)
            if not live.all():
                done_symbol.append(symbol[~live])
                done_segment.append(segment[~live])
                symbol, segment, rank, to = symbol[live], segment[live], rank[live], to[live]
                if not len(symbol):
                    break
            hit = self._first_in_reach(symbol, rank, to) if local else self._first_of_segment(segment, rank)
            symbol[hit] = to[hit]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))
            symbol, segment, rank, to = symbol[keep], segment[keep], rank[keep], to[keep]
            changed = np.unique(np.concatenate([hit, hit[hit > 0] - 1]))
            nxt = np.minimum(changed + 1, len(symbol) - 1)
            within = (nxt > changed) & (segment[nxt] == segment[changed])
            rank[changed] = _NO
            changed, nxt = changed[within], nxt[within]
            rank[changed], to[changed] = self._rank(symbol[changed], symbol[nxt])
        if not done_symbol:
            return symbol, segment
        symbol, segment = np.concatenate(done_symbol), np.concatenate(done_segment)
        order = np.argsort(segment, kind="stable")
        return symbol[order], segment[order]

    def _long(self, text: str) -> np.ndarray:
        """Symbols of one long segment."""
        part = np.cumsum(self._cuts(text))
        few = np.bincount(part) <= LONG
        symbol, short = self._symbols(text), few[part]
        out = [self._rounds(symbol[short], part[short]), self._rounds(symbol[~short], part[~short], local=True)]
        symbol, part = (np.concatenate(x) for x in zip(*out, strict=True))
        return symbol[np.argsort(part, kind="stable")]

    def _spell(self, symbol: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace symbols that are no piece by byte pieces or the unknown id."""
        odd = np.flatnonzero((symbol < 0) | (symbol >= self.t.n))
        if not len(odd):
            return symbol, segment
        parts, lengths, where = [], np.ones(len(symbol), np.int64), np.zeros(len(symbol), bool)
        for i in odd:
            s = int(symbol[i])
            char = chr(-1 - s) if s < 0 else self.t.extra[s - self.t.n]
            parts.append(self.t.byte_ids[list(char.encode())] if self.t.fallback else np.array([self.t.unknown]))
            lengths[i], where[i] = len(parts[-1]), True
        out = np.repeat(symbol, lengths)
        out[np.repeat(where, lengths)] = np.concatenate(parts)
        return out, np.repeat(segment, lengths)

    def learn(self, segments: list[str]) -> None:
        """Encode segments not known yet and keep their ids."""
        flat, numbers, lengths, long_ = [], [], [], []
        for i, s in enumerate(segments):
            if len(s) > LONG:
                long_.append(i)
            else:
                flat.append(s)
                numbers.append(i)
                lengths.append(len(s))
        symbol, segment = self._rounds(self._symbols("".join(flat)), np.repeat(np.array(numbers, np.int64), lengths))
        for i in long_:
            one = self._long(segments[i])
            symbol, segment = np.concatenate([symbol, one]), np.concatenate([segment, np.full(len(one), i)])
        if long_:
            order = np.argsort(segment, kind="stable")
            symbol, segment = symbol[order], segment[order]
        symbol, segment = self._spell(symbol, segment)
        length = np.bincount(segment, minlength=len(segments))
        self.start = np.concatenate([self.start, len(self.ids) + np.append(0, np.cumsum(length))[:-1]])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, symbol.astype(np.int32)])
        base = len(self.known)
        self.known.update((s, base + i) for i, s in enumerate(segments))

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and row offsets."""
        cut, counts = [], []
        for text in texts:
            if text:
                text = text.replace(_SPACE, " ")
                own = self.split(" " + text if self.t.prefix else text)
                cut += own
                counts.append(len(own))
            else:
                counts.append(0)
        if len(self.known) > CACHE:
            self.forget()
        new = list(dict.fromkeys(s for s in cut if s not in self.known))
        if new:
            self.learn(new)
        code = np.fromiter(map(self.known.__getitem__, cut), np.int64, len(cut))
        ids = self.ids[ranges(self.start[code], self.length[code])]
        total = np.append(0, np.cumsum(self.length[code]))
        return ids, total[np.append(0, np.cumsum(counts)).astype(np.int64)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Texts of rows of ids, as bytes."""
        length = self.surface_length[ids]
        raw = self.surface_bytes[ranges(self.surface_start[ids], length)].tobytes()
        at = np.append(0, np.cumsum(length))[offsets].tolist()
        out = []
        for i in range(len(at) - 1):
            text = raw[at[i] : at[i + 1]]
            out.append(text[1:] if self.t.prefix and text[:1] == b" " else text)
        return out


def _run(shared):
    def run(batches):
        codec = PieceCodec(shared.value)
        for block in blocks(batches):
            texts = block.column(block.schema.get_field_index("text")).to_pylist()
            ids, offsets = codec.encode(texts)
            decoded = codec.decode(ids, offsets)
            yield pa.record_batch(
                [
                    block.column(block.schema.get_field_index("doc_id")),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                    pa.array([x.decode("utf-8", "replace") for x in decoded]),
                ],
                ["doc_id", "ids", "decoded"],
            )

    return run


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, decoded`` for each row of ``docs(doc_id, text)``."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(PieceTables(model_path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_run(shared), f"doc_id {kind}, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encode_decode(docs, default_model()))
