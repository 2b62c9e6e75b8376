"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Compile.  The normaliser (a space to its mark, and a mark put before the text), the pieces (a trie of arcs
from characters to ids) and byte fallback (a character without a piece becomes its UTF-8 bytes) are composed
once into one transducer: an arc that reads the mark in a piece reads a space as well.  Encode.  Composing it
with an input gives an acyclic lattice over the places of the input; the shortest path in the tropical
semiring is the encoding.  Decode runs backwards.

Weights.  In a unigram model an arc weighs its piece's negative score.  A merge (BPE) model has no path
weights; its encoding is the one path on which all neighbouring pieces are stable, that is, merging the
characters of the two pieces yields these two pieces again.  So pairs are composed in as arcs of weight 0
(stable) or infinity (not), found on demand by undoing the merges next to the border from the last to the
first; each place of the lattice is then reached by exactly one finite path, and the result equals that of
merging the whole text.

No piece may hold the white-space mark after another character (checked when compiling), so no path that
is shortest crosses a mark in mid-piece: inputs split at marks, and the segments' paths are remembered as
packed ids (two generations of `_REMEMBER` entries, so frequent ones stay).

Null or empty text: no ids.  Null doc_id stays.  Other columns are ignored.  A white-space mark (U+2581)
in the input decodes to a space, as in the model's own library.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_SEGMENT = re.compile(f"[ {MARK}]+[^ {MARK}]*|[^ {MARK}]+")
_REMEMBER = 300_000
_loaded: dict[str, PieceTransducer] = {}


class PieceTransducer:
    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], merges: bool, prefix: bool = True, unknown_cost: float = 10.0) -> None:
        """kinds: normal, byte, control, unknown or unused for each piece."""
        self.pieces, self.scores, self.kinds, self.merges, self.prefix = pieces, scores, kinds, merges, prefix
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "normal"}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "byte"}
        self.unknown = kinds.index("unknown") if "unknown" in kinds else 0
        lowest = min((scores[i] for i in self.ids.values()), default=0.0)
        self.unknown_cost = unknown_cost - lowest
        self.trie: dict = {}
        for piece, i in self.ids.items():
            if re.search(f"[^{MARK}]{MARK}", piece):
                raise ValueError(f"piece {piece!r} holds white space after other characters")
            node = self.trie
            for c in piece:
                below = node.setdefault(c, {})
                if c == MARK:
                    node[" "] = below  # the normaliser's arc, composed in
                node = below
            node[""] = i
        self.texts = [self._text(p, k) for p, k in zip(pieces, kinds, strict=True)]
        self._pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._paths: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    @staticmethod
    def _text(piece: str, kind: str) -> bytes:
        """What an id decodes to."""
        if kind == "byte":
            return bytes([int(piece[3:5], 16)])
        return piece.replace(MARK, " ").encode() if kind == "normal" else " ⁇ ".encode() if kind == "unknown" else b""

    @classmethod
    def load(cls, path: str) -> PieceTransducer:
        if path not in _loaded:
            from sentencepiece import sentencepiece_model_pb2 as proto

            model = proto.ModelProto()
            with open(path, "rb") as data:
                model.ParseFromString(data.read())
            if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.escape_whitespaces:
                raise ValueError("only the identity normaliser with escaped white space is compiled here")
            if model.trainer_spec.model_type not in (1, 2):
                raise ValueError("only unigram and BPE models are compiled here")
            kinds = {1: "normal", 2: "unknown", 3: "control", 4: "normal", 5: "unused", 6: "byte"}
            _loaded[path] = cls([p.piece for p in model.pieces], [p.score for p in model.pieces], [kinds[p.type] for p in model.pieces], model.trainer_spec.model_type == 2, model.normalizer_spec.add_dummy_prefix)
        return _loaded[path]

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = min(((-self.scores[i], at) for at in range(len(parts) - 1) if (i := self.ids.get(parts[at] + parts[at + 1])) is not None), default=None)
            if best is None:
                return parts
            at = best[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _split(self, i: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes piece i, None for a single character."""
        if i not in self._halves:
            parts = list(self.pieces[i])
            while len(parts) > 2:
                at = min((-self.scores[j], k) for k in range(len(parts) - 1) if (j := self.ids.get(parts[k] + parts[k + 1])) is not None)[1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[i] = (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 else None
        return self._halves[i]

    def _holds(self, x: int, y: int) -> bool:
        """Whether merging the characters of pieces x and y gives these two again.

        Going back in time, the later of the two pieces at the border is undone; a merge across the border
        that has its turn before the one undone would have come first."""
        pieces, scores, ids = self.pieces, self.scores, self.ids
        limit, left = float("-inf"), True  # left: equal scores, the undone merge comes first
        while True:
            c = ids.get(pieces[x] + pieces[y])
            if c is not None and (scores[c] > limit or (scores[c] == limit and not left)):
                return False
            one, two = self._split(x), self._split(y)
            if one is None and two is None:
                return True
            if two is None or (one is not None and scores[x] < scores[y]):
                limit, left, x = scores[x], True, one[1]
            else:
                limit, left, y = scores[y], False, two[0]

    def _stable(self, a: int, b: int) -> bool:
        key = a * len(self.pieces) + b
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) > 2 * _REMEMBER:
                self._pairs.clear()
            found = self._pairs[key] = self._holds(a, b)
        return found

    def shortest_path(self, segment: str) -> list[int]:
        """Output ids of the shortest path through the lattice of a segment."""
        n = len(segment)
        cost, back = [0.0] + [float("inf")] * n, [(-1, -1)] * (n + 1)
        trie, merges, pairs, size = self.trie, self.merges, self._pairs, len(self.pieces)
        for at in range(n):
            here = cost[at]
            if here == float("inf"):
                continue
            before, node, end = back[at][1], trie, at
            while end < n and (node := node.get(segment[end])) is not None:
                end += 1
                i = node.get("")
                if i is not None:
                    if merges:
                        if here >= cost[end]:
                            continue
                        if before >= 0:
                            holds = pairs.get(before * size + i)
                            if not (self._stable(before, i) if holds is None else holds):
                                continue
                        cost[end], back[end] = here, (at, i)
                    elif here - self.scores[i] < cost[end]:
                        cost[end], back[end] = here - self.scores[i], (at, i)
            if "" not in trie.get(segment[at], ()) and here + self.unknown_cost < cost[at + 1]:
                cost[at + 1], back[at + 1] = here + self.unknown_cost, (at, -1)
        out: list[int] = []
        end = n
        while end:
            at, i = back[end]
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(segment[at:end].replace(" ", MARK).encode("utf-8", "replace"))]
            else:
                out.append(self.unknown)
            end = at
        out.reverse()
        return out

    def _path(self, segment: str) -> bytes:
        """Packed ids of a segment that is not among the newer ones."""
        path = self._older.get(segment)
        if path is None:
            path = np.array(self.shortest_path(segment), "<i4").tobytes()
        if len(segment) < 64:
            if len(self._paths) > _REMEMBER:
                self._older, self._paths = self._paths, {}
            self._paths[segment] = path
        return path

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        segments = _SEGMENT.findall((MARK if self.prefix else "") + text)
        get, other = self._paths.get, self._path
        return b"".join([get(x) or other(x) for x in segments])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def decoded(self, ids: Iterable[int]) -> bytes:
        texts = self.texts
        out = b"".join([texts[i] for i in ids])
        return out[1:] if self.prefix and out[:1] == b" " else out

    def decode(self, ids: Iterable[int]) -> str:
        return self.decoded(ids).decode("utf-8", "replace")


def model_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def encode_pieces(documents: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip (decoding gives the text again), and the ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = PieceTransducer.load(model_path(path))
        for batch in batches:
            for piece in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                packed = [fst.packed(t) for t in texts]
                ids = np.frombuffer(b"".join(packed), "<i4").astype(np.int32)
                ends = np.cumsum([0] + [len(x) // 4 for x in packed])
                same = [fst.decoded(ids[a:b].tolist()) == t.encode("utf-8", "replace") for a, b, t in zip(ends[:-1], ends[1:], texts, strict=True)]
                columns = [piece.column("doc_id"), pa.array(np.diff(ends)), pa.array([zlib.crc32(x) for x in packed], pa.int64()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_ids", "ids_crc32", "round_trip"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text out of doc_id, ids (null ids: empty text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = PieceTransducer.load(model_path(path))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fst.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
