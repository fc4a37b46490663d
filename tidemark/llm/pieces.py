"""SentencePiece encoding and decoding on numpy batches of words.

Words of equal length advance together. For a unigram model a batched Viterbi pass probes the sorted keys
of all pieces with substring hashes and keeps the best-scored one that ends at each place. A BPE model's
pieces can't be found by a best path, since its encoding is the outcome of ordered merges; there, adjacent
pieces probe the sorted keys of all pairs, and each step merges the best-scored pair of every word at once.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, read

SPACE = "▁"
#: Longer words are merged one by one, in time that grows little faster than their length.
LONG = 64
REMEMBERED = 200_000
BATCH = 1 << 15
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
_UNIGRAM, _BPE = 1, 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: How far an unknown character scores below the worst piece, as the format defines it.
_UNKNOWN_PENALTY = 10.0


def _codes(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1).astype(np.int64)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of each row's first k code points, k from 0 on; any substring's hash follows from two."""
    out = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * _BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
    return out


class PieceModel:
    """A SentencePiece model of type unigram or BPE with the identity normaliser and byte fallback."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        kinds = [p.type for p in proto.pieces]
        texts = [p.piece for p in proto.pieces]
        if spec.model_type not in (_UNIGRAM, _BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with the identity normaliser are supported")
        normal = [i for i, k in enumerate(kinds) if k == _NORMAL]
        if set(kinds) - {_NORMAL, _UNKNOWN, _BYTE, 3} or kinds.count(_BYTE) != 256 or any(SPACE in texts[i].lstrip(SPACE) for i in normal):
            raise ValueError("user-defined or unused pieces, inner spaces and models without byte fallback aren't supported")
        self.type, self.prefix = spec.model_type, norm.add_dummy_prefix
        self.ids = {texts[i]: i for i in normal}
        self.scores = np.array([p.score for p in proto.pieces], dtype=np.float32)
        self.byte_ids = np.array([texts.index(f"<0x{b:02X}>") for b in range(256)])
        shown = [t.replace(SPACE, " ").encode() if k == _NORMAL else bytes([int(t[3:5], 16)]) if k == _BYTE else b"" for t, k in zip(texts, kinds, strict=True)]
        self.shown = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.shown_sizes = np.array([len(b) for b in shown], dtype=np.int64)
        self.shown_starts = np.cumsum(self.shown_sizes) - self.shown_sizes
        alone = "".join(c for c in "\n\t\r" if not any(c in t for t in self.ids))
        self.units = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._keys()
        self.known: dict[str, int] = {}
        self._forget()

    def _keys(self) -> None:
        """Sorted keys: of pairs that merge, with their pieces, or of all pieces by hash."""
        if self.type == _BPE:
            pairs = {(self.ids[t[:k]] << 32) | self.ids[t[k:]]: i for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids}
            self.keys = np.array(sorted(pairs), dtype=np.int64)
            self.made = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
            return
        self.longest = max(map(len, self.ids))
        table = []
        for size in range(1, self.longest + 1):
            own = sorted(t for t in self.ids if len(t) == size)
            codes = _codes(own) if own else np.zeros((0, size), dtype=np.int64)
            hashed = _hashes(codes)[:, -1]
            if len(np.unique(hashed)) != len(own):
                raise ValueError("two pieces share a key")
            order = np.argsort(hashed)
            table.append((hashed[order], codes[order], np.array([self.ids[t] for t in own], dtype=np.int64)[order]))
        self.table = table

    def _forget(self) -> None:
        self.known.clear()
        self.pool = np.zeros(0, dtype=np.int32)
        self.starts, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _bytes(self, char: str) -> list[int]:
        return self.byte_ids[list(char.encode())].tolist()

    def _probe(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair makes, and its score; -1 and the least score where it makes none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (left >= 0) & (right >= 0) & (self.keys[at] == key)
        made = np.where(found, self.made[at], -1)
        return made, np.where(found, self.scores[made], -np.inf)

    def _merged(self, words: list[str]) -> list[list[int]]:
        """BPE of words of one length: of equal scores the leftmost pair merges first."""
        get = self.ids.get
        ids = np.array([[get(c, -1) for c in w] for w in words], dtype=np.int64)
        out: list[list[int]] = [[] for _ in words]
        rows = np.arange(len(words))
        made, score = self._probe(ids[:, :-1], ids[:, 1:])
        while True:
            best = np.argmax(score, axis=1) if score.shape[1] else np.zeros(len(rows), dtype=np.int64)
            live = score[np.arange(len(rows)), best] > -np.inf if score.shape[1] else np.zeros(len(rows), dtype=bool)
            for r, row in zip(rows[~live].tolist(), ids[~live].tolist(), strict=True):
                out[r] = row
            rows, ids, made, score, best = rows[live], ids[live], made[live], score[live], best[live]
            if not len(rows):
                return [self._spelled(w, o) for w, o in zip(words, out, strict=True)]
            n, width = ids.shape
            every = np.arange(n)
            ids[every, best] = made[every, best]
            at = np.arange(width - 1)[None, :]
            ids = np.take_along_axis(ids, at + (at > best[:, None]), axis=1)
            at = np.arange(width - 2)[None, :]
            shift = at + (at >= best[:, None])
            made, score = np.take_along_axis(made, shift, axis=1), np.take_along_axis(score, shift, axis=1)
            for side in (best - 1, best):
                ok = np.flatnonzero((side >= 0) & (side < width - 2))
                made[ok, side[ok]], score[ok, side[ok]] = self._probe(ids[ok, side[ok]], ids[ok, side[ok] + 1])

    def _spelled(self, word: str, ids: list[int]) -> list[int]:
        """ids with the bytes of unknown characters in the places of -1."""
        if -1 not in ids:
            return ids
        chars = iter(c for c in word if c not in self.ids)
        return [i for x in ids for i in (self._bytes(next(chars)) if x < 0 else [x])]

    def _merged_long(self, word: str) -> list[int]:
        """BPE of one word by a heap of pairs."""
        ids = [self.ids.get(c, -1) for c in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        pairs = {int(k): int(m) for k, m in zip(self.keys, self.made, strict=True)} if not hasattr(self, "pairs") else self.pairs
        self.pairs = pairs
        heap: list[tuple[float, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(ids)
            if i >= 0 and j < len(ids) and ids[i] >= 0 and ids[j] >= 0 and (m := pairs.get((ids[i] << 32) | ids[j])) is not None:
                heapq.heappush(heap, (-float(self.scores[m]), i, ids[i], ids[j], m))

        for i in range(len(ids) - 1):
            offer(i)
        gone = bytearray(len(ids))
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= len(ids) or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = m, 1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return self._spelled(word, [x for x, g in zip(ids, gone, strict=True) if not g])

    def _best(self, words: list[str]) -> list[list[int]]:
        """Unigram Viterbi of words of one length; of equal scores the path whose last piece is longest."""
        codes = _codes(words)
        hashed = _hashes(codes)
        n, width = codes.shape
        unknown = self.scores[list(self.ids.values())].min() - _UNKNOWN_PENALTY
        value = np.full((n, width + 1), -np.inf, dtype=np.float32)
        value[:, 0] = 0
        size_at, piece_at = np.zeros((n, width + 1), dtype=np.int64), np.full((n, width + 1), -1)
        for end in range(1, width + 1):
            for size in range(min(end, self.longest), 0, -1):
                keys, wanted, ids = self.table[size - 1]
                start = end - size
                with np.errstate(over="ignore"):
                    own = hashed[:, end] - hashed[:, start] * _power(size)
                piece = np.full(n, -1)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    hit = np.flatnonzero(keys[at] == own)
                    hit = hit[(wanted[at[hit]] == codes[hit, start:end]).all(axis=1)]
                    piece[hit] = ids[at[hit]]
                score = np.where(piece >= 0, self.scores[piece], unknown if size == 1 else -np.inf)
                total = value[:, start] + score
                better = total > value[:, end]
                value[better, end], size_at[better, end], piece_at[better, end] = total[better], size, piece[better]
        out = []
        for row, word in enumerate(words):
            ids, end = [], width
            while end:
                piece, size = int(piece_at[row, end]), int(size_at[row, end])
                ids[:0] = [piece] if piece >= 0 else self._bytes(word[end - 1])
                end -= size
            out.append(ids)
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of words that hold no piece boundary's neighbours but their own."""
        out: list[list[int]] = [[] for _ in words]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else ():
            size = int(sizes[group[0]])
            step = max(1, BATCH // size)
            for k in range(0, len(group), step):
                part = group[k : k + step].tolist()
                own = [words[i] for i in part]
                if self.type == _UNIGRAM:
                    made = self._best(own)
                else:
                    made = [self._merged_long(w) for w in own] if size > LONG else self._merged(own)
                for i, ids in zip(part, made, strict=True):
                    out[i] = ids
        return out

    def _learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self._forget()
            fresh = list(words)
        if fresh:
            made = self.encode_words(fresh)
            sizes = np.array([len(m) for m in made], dtype=np.int64)
            flat = np.array([i for m in made for i in m], dtype=np.int32)
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.starts = np.r_[self.starts, len(self.pool) + np.cumsum(sizes) - sizes]
            self.sizes, self.pool = np.r_[self.sizes, sizes], np.r_[self.pool, flat]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the offsets of each text's ids."""
        units = [self.units.findall((SPACE if self.prefix else "") + t.replace(" ", SPACE)) if t else [] for t in texts]
        self._learn(set().union(*units))
        known = self.known
        which = np.array([known[u] for own in units for u in own], dtype=np.int64)
        sizes = self.sizes[which]
        ends = np.r_[0, np.cumsum(sizes)]
        flat = self.pool[np.repeat(self.starts[which] - ends[:-1], sizes) + np.arange(ends[-1])]
        return flat, ends[np.r_[0, np.cumsum([len(own) for own in units])].astype(np.int64)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids; the space that encoding puts first is taken off again.

        Bytes that form no UTF-8 become U+FFFD; unknown and control ids are left out.
        """
        sizes = self.shown_sizes[ids]
        ends = np.r_[0, np.cumsum(sizes)]
        flat = self.shown[np.repeat(self.shown_starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        bounds = ends[offsets].tolist()
        out = []
        for start, end in zip(bounds, bounds[1:], strict=False):
            raw = flat[start:end]
            out.append((raw[1:] if self.prefix and raw[:1] == b" " else raw).decode(errors="replace"))
        return out


def _power(size: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), size, 1 << 64))


_MODELS: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    """The worker's own model, made once."""
    if path not in _MODELS:
        with open(path, "rb") as f:
            _MODELS[path] = PieceModel(f.read())
    return _MODELS[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, round_trip of each row, by itself, without a shuffle.

    ids are the library's, without begin or end. round_trip: decoding gives the text again; it fails only
    for texts that hold the space symbol itself. A null text is treated as empty, with no ids; null ids of
    rows and repeated rows stay; an empty table gives no rows; other columns are ignored. path is a model
    file that every executor has.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                found = part["text"].to_pylist()
                ids, offsets = model.encode(found)
                same = [a == b for a, b in zip(model.decode(ids, offsets), found, strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part["doc_id"], "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)), "n_tokens": pa.array(np.diff(offsets), pa.int64()), "round_trip": pa.array(same, pa.bool_())}
                )

    return rows.mapInArrow(made, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>, n_tokens long, round_trip boolean")


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id and the text of each row's ids; null ids give a null text."""
    picked = rows.select(F.col(id_col).alias("doc_id"), F.col("ids"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            lists = batch["ids"].to_pylist()
            offsets = np.r_[0, np.cumsum([len(x or ()) for x in lists])].astype(np.int64)
            found = model.decode(np.array([i for x in lists for i in x or ()], dtype=np.int64), offsets)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "text": pa.array([None if x is None else t for x, t in zip(lists, found, strict=True)], pa.string())})

    return picked.mapInArrow(made, f"doc_id {dict(picked.dtypes)['doc_id']}, text string")


def op10_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded under piece_bpe_32k.model and decoded again."""
    import public_tokenizers

    return encoded(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
