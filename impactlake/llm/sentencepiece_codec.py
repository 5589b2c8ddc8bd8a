"""SentencePiece encoding and decoding in numpy.

Words of one length are encoded together. Prefix sums of a polynomial hash give the hash of each
substring of a whole matrix of words; sorted keys of the pieces answer, by binary search, which
substrings are pieces. A unigram model takes the best path: for each end position the maximum over
the piece lengths is taken for all words at once, and backpointers keep the choice (Viterbi).

A BPE model's ids are not those of a best path over its scores (its scores only rank merges), so for
such a model the same tables drive merges instead: in each round every word of the matrix merges its
best adjacent pair, found by a maximum over the row, until no pair is a piece. Both give the ids of
the public library. Characters outside the vocabulary become byte pieces, or the unknown piece where
the model has none.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, give_back, mix64, slices

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A word runs from a space (or several) to the next; no piece crosses such a border.
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Leading bits of a hash that name its bucket among the piece keys; few buckets hold more than one key.
BUCKET_BITS = 18
#: Longer words are merged one at a time with a heap, as a matrix round costs their length.
MATRIX_CHARS = 48
#: Words kept with their ids between batches; the cache is emptied beyond that.
CACHE_WORDS = 200_000


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)


class Codec:
    """One model's tables. `kind` is 'unigram' or 'bpe', as the model says unless it is given."""

    def __init__(self, path: str = DEFAULT_MODEL, kind: str | None = None, data: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        if data is None:
            with open(path, "rb") as f:
                data = f.read()
        model.ParseFromString(data)
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or not spec.escape_whitespaces:
            raise ValueError("only models with the identity normaliser and escaped white space are supported")
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.kind = kind or {1: "unigram", 2: "bpe"}[model.trainer_spec.model_type]
        self.pieces = [p.piece for p in model.pieces]
        normal = [i for i, p in enumerate(model.pieces) if p.type in (1, 4)]
        if any(SPACE in p.lstrip(SPACE) for p in (self.pieces[i] for i in normal)):
            raise ValueError("a piece has a space inside or after its text")
        self.unk = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.byte_ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_of = np.full(len(self.pieces), -1, np.int64)
        for piece, i in self.byte_ids.items():
            self.byte_of[i] = int(piece[1:-1], 16)
        self.control = {i for i, p in enumerate(model.pieces) if p.type == 3}
        self.score_of = {self.pieces[i]: (model.pieces[i].score, i) for i in normal}
        self.longest = max((len(self.pieces[i]) for i in normal), default=1)
        keys = np.empty(len(normal), np.uint64)
        by_len: dict[int, list[int]] = {}
        for k, i in enumerate(normal):
            by_len.setdefault(len(self.pieces[i]), []).append(k)
        for n, ks in by_len.items():
            codes = np.array([[ord(c) for c in self.pieces[normal[k]]] for k in ks], np.uint64)
            keys[ks] = self._hash(self._prefix(codes), 0, n)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one hash")
        slots = np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64)
        starts = np.searchsorted(self.keys >> np.uint64(64 - BUCKET_BITS), slots)
        self._end, self._shared = starts[1:], np.diff(starts) > 1
        self._start = np.minimum(starts[:-1], max(len(normal) - 1, 0))
        self.ids = np.array(normal, np.int32)[order]
        self.scores = np.array([model.pieces[i].score for i in normal], np.float64)[order]
        self.unk_score = (self.scores.min() if len(normal) else 0.0) - 10.0
        self.forget()

    # Hashes of substrings -------------------------------------------------------------------
    @staticmethod
    def _prefix(codes: np.ndarray) -> np.ndarray:
        """Row-wise prefix hashes; column j covers the first j characters."""
        n, width = codes.shape
        out = np.zeros((n, width + 1), np.uint64)
        for j in range(width):
            out[:, j + 1] = out[:, j] * _BASE + mix64(codes[:, j] + np.uint64(1))
        return out

    @staticmethod
    def _hash(prefix: np.ndarray, start: int, end: int) -> np.ndarray:
        return mix64(prefix[:, end] - prefix[:, start] * np.uint64(pow(int(_BASE), end - start, 1 << 64)))

    def _probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position among the sorted piece keys, and whether the key is there."""
        slot = (keys >> np.uint64(64 - BUCKET_BITS)).view(np.int64)
        at = self._start[slot]
        there = self.keys[at] == keys
        rest = np.flatnonzero(~there & self._shared[slot])
        while len(rest):
            at[rest] += 1
            there[rest] = hit = self.keys[at[rest]] == keys[rest]
            rest = rest[~hit]
            rest = rest[at[rest] + 1 < self._end[slot[rest]]]
        return at, there

    # Words ------------------------------------------------------------------------------------
    def _spell(self, text: str) -> list[int]:
        """Ids of one character that is no piece."""
        if not self.byte_ids:
            return [self.unk]
        return [self.byte_ids[f"<0x{b:02X}>"] for b in text.encode("utf-8", "surrogatepass")]

    def _emit(self, word: str, spans: list[tuple[int, int]]) -> tuple[int, ...]:
        ids: list[int] = []
        unknown = False
        for a, b in spans:
            found = self.score_of.get(word[a:b])
            if found:
                ids.append(found[1])
            elif self.byte_ids or not unknown:  # adjacent unknown characters share one id
                ids += [i for c in word[a:b] for i in self._spell(c)]
            unknown = not found
        return tuple(ids)

    def viterbi(self, words: list[str]) -> list[tuple[int, ...]]:
        """Best paths of words of one length, which advance together."""
        width = len(words[0])
        prefix = self._prefix(_codes(words))
        best = np.full((len(words), width + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((len(words), width + 1), np.int64)
        for end in range(1, width + 1):
            starts = range(max(0, end - self.longest), end)
            gains = np.full((len(words), len(starts)), -np.inf)
            for k, start in enumerate(starts):
                at, there = self._probe(self._hash(prefix, start, end))
                gains[:, k] = np.where(there, best[:, start] + self.scores[at], -np.inf)
                if start == end - 1:
                    gains[:, k] = np.where(there, gains[:, k], best[:, start] + self.unk_score)
            pick = gains.argmax(axis=1)
            best[:, end] = gains[np.arange(len(words)), pick]
            back[:, end] = starts[0] + pick
        out = []
        for row, word in zip(back.tolist(), words, strict=True):
            spans, end = [], width
            while end:
                spans.append((row[end], end))
                end = row[end]
            out.append(self._emit(word, spans[::-1]))
        return out

    def merges(self, words: list[str]) -> list[tuple[int, ...]]:
        """BPE of words of one length: each round merges the best adjacent pair of every word."""
        n, width = len(words), len(words[0])
        prefix = self._prefix(_codes(words))
        powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(width + 1)], np.uint64)
        rows = np.arange(n)
        # Symbol borders: next_border[i, a] is the end of the symbol that starts at a.
        ends = np.tile(np.arange(1, width + 2), (n, 1))
        starts_here = np.ones((n, width + 1), bool)
        previous = np.tile(np.arange(-1, width), (n, 1))

        def gain(r: np.ndarray, a: np.ndarray) -> np.ndarray:
            """Score of merging the symbol at a with the one after it."""
            out = np.full(len(r), -np.inf)
            mid = ends[r, a]
            ok = mid < width
            r, a, mid = r[ok], a[ok], mid[ok]
            end = ends[r, mid]
            keys = mix64(prefix[r, end] - prefix[r, a] * powers[end - a])
            at, there = self._probe(keys)
            out[np.flatnonzero(ok)] = np.where(there, self.scores[at], -np.inf)
            return out

        gains = np.full((n, width), -np.inf)
        for a in range(width - 1):
            at, there = self._probe(self._hash(prefix, a, a + 2))
            gains[:, a] = np.where(there, self.scores[at], -np.inf)
        live = rows
        while len(live):
            at = gains[live].argmax(axis=1)
            going = gains[live, at] > -np.inf
            live, at = live[going], at[going]
            if not len(live):
                break
            mid = ends[live, at]
            end = ends[live, mid]
            ends[live, at] = end
            starts_here[live, mid] = False
            gains[live, mid] = -np.inf
            inside = end < width
            previous[live[inside], end[inside]] = at[inside]
            gains[live, at] = gain(live, at)
            before = previous[live, at]
            has = before >= 0
            gains[live[has], before[has]] = gain(live[has], before[has])
        row, start = np.nonzero(starts_here[:, :width])
        end = ends[row, start]
        at, there = self._probe(mix64(prefix[row, end] - prefix[row, start] * powers[end - start]))
        ids = self.ids[at].tolist()
        border = np.searchsorted(row, np.arange(n + 1)).tolist()
        out = [tuple(ids[a:b]) for a, b in zip(border, border[1:])]
        for i in np.unique(row[~there]).tolist():
            s = slice(border[i], border[i + 1])
            out[i] = self._emit(words[i], list(zip(start[s].tolist(), end[s].tolist())))
        return out

    def _merge_long(self, word: str) -> tuple[int, ...]:
        """BPE of one long word with a heap of pairs."""
        n = len(word)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int]] = []

        def push(a: int) -> None:
            if a >= 0 and end[a] < n:
                b = end[end[a]]
                if b - a <= self.longest and (found := self.score_of.get(word[a:b])):
                    heapq.heappush(heap, (-found[0], a, b))

        for a in range(n):
            push(a)
        while heap:
            _, a, b = heapq.heappop(heap)
            if not alive[a] or end[a] >= n or end[end[a]] != b:
                continue
            alive[end[a]] = False
            end[a] = b
            if b < n:
                before[b] = a
            push(a)
            push(before[a])
        cuts = [a for a in range(n) if alive[a]] + [n]
        return self._emit(word, list(zip(cuts, cuts[1:])))

    def _path_long(self, word: str) -> tuple[int, ...]:
        return self.viterbi([word])[0]

    def words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each of the (distinct) words."""
        by_len: dict[int, list[str]] = {}
        for w in words:
            by_len.setdefault(len(w), []).append(w)
        out: dict[str, tuple[int, ...]] = {}
        for n, group in by_len.items():
            if n > MATRIX_CHARS:
                out.update((w, self._merge_long(w) if self.kind == "bpe" else self._path_long(w)) for w in group)
                continue
            together = self.merges if self.kind == "bpe" else self.viterbi
            step = max(1, 400_000 // n)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                out.update(zip(part, together(part)))
        return [out[w] for w in words]

    def _learn(self, new: list[str]) -> None:
        """Adds words to the cache: `cache` has a word's number, `_size` and `_first` its ids' place in `_flat`."""
        ids = self.words(new)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.cache.update(zip(new, range(len(self.cache), len(self.cache) + len(new))))
        self._first = np.concatenate([self._first, len(self._flat) + np.cumsum(sizes) - sizes])
        self._size = np.concatenate([self._size, sizes])
        self._flat = np.concatenate([self._flat, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))])

    # Texts --------------------------------------------------------------------------------------
    def normalize(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        text = text.replace(" ", SPACE)
        return SPACE + text if self.dummy and text else text

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, and where each text's begin (one more entry ends the last)."""
        split = [_WORDS.findall(self.normalize(t)) for t in texts]
        kinds = {w for ws in split for w in ws}
        new = list(kinds.difference(self.cache))
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.forget()
            new = list(kinds)
        if new:
            self._learn(new)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        word = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        sizes = self._size[word]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self._flat[np.repeat(self._first[word] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]

    def forget(self) -> None:
        self.cache: dict[str, int] = {}
        self._flat, self._first, self._size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        ids, at = self.encode_flat(texts)
        return np.split(ids, at[1:-1]) if texts else []

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids) -> str:
        """Text of ids; control ids say nothing, byte runs that are no UTF-8 become U+FFFD for each byte."""
        parts: list[str] = []
        run = bytearray()

        def flush() -> None:
            if not run:
                return
            rest = bytes(run)
            run.clear()
            while rest:
                try:
                    parts.append(rest.decode("utf-8"))
                    return
                except UnicodeDecodeError as e:
                    parts.append(rest[: e.start].decode("utf-8") + "�")
                    rest = rest[e.start + 1 :]

        pieces, byte_of = self.pieces, self._bytes
        for i in ids:
            b = byte_of[i]
            if b >= 0:
                run.append(b)
                continue
            if run:
                flush()
            if i == self.unk:
                parts.append(" ⁇ ")
            elif i not in self.control:
                parts.append(pieces[i])
        flush()
        text = "".join(parts).replace(SPACE, " ")
        return text[1:] if self.dummy and text[:1] == " " else text

    def decode_flat(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """decode() of texts whose ids stand end to end, where each one's begin in at (one more entry ends the last).

        Pieces are joined as bytes. As pieces are whole characters, the bytes of a text are UTF-8 only where each of its byte runs is; other texts go one by one.
        """
        said, plain = self._said
        n = len(self.pieces)
        pick = ids.astype(np.int64)
        first = at[:-1][at[:-1] < at[1:]]
        single = np.zeros(len(at) - 1, bool)  # what their first id says depends on the ids after it
        single[at[:-1] < at[1:]] = ~plain[ids[first]]
        if self.dummy:
            pick[first] += n
        joined = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), said.take(pa.array(pick))), b"")
        try:
            texts = joined.cast(pa.string())
        except pa.ArrowInvalid:
            single[:] = True
        if single.any():
            own = [self.decode(ids[a:b].tolist()) if alone else None for a, b, alone in zip(at.tolist(), at[1:].tolist(), single)]
            texts = pa.array(own, pa.string()) if single.all() else pa.compute.if_else(pa.array(single), pa.array(own, pa.string()), texts)
        return pa.compute.replace_substring(texts, SPACE, " ") if (self.byte_of[ids] >= 0x80).any() else texts

    @property
    def _said(self) -> tuple[pa.Array, np.ndarray]:
        """What each id says in bytes, then what each says at a text's start, where a dummy space goes; and which say that whatever follows."""
        if not hasattr(self, "_said_table"):
            texts = [b"" if i in self.control else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
            texts[self.unk] = " ⁇ ".encode()
            for i in self.byte_ids.values():
                texts[i] = bytes([self.byte_of[i]])
            plain = np.array([bool(t) for t in texts]) & (self.byte_of < 0x80)
            self._said_table = pa.array(texts + [t.removeprefix(b" ") for t in texts], pa.binary()), plain
        return self._said_table

    @property
    def _bytes(self) -> list[int]:
        if not hasattr(self, "_byte_list"):
            self._byte_list = self.byte_of.tolist()
        return self._byte_list


@lru_cache(maxsize=2)
def codec(path: str, kind: str | None = None) -> Codec:
    """One codec for each Python worker."""
    return Codec(path, kind)


#: Characters that one worker holds at a time; a longer text stands alone.
BATCH_CHARS = 700_000


def encode(docs: DataFrame, text_col: str = "text", model: str = DEFAULT_MODEL, kind: str | None = None, decode_too: bool = True, keep: list[str] | None = None) -> DataFrame:
    """The rows with `input_ids` array<int>, `n_tokens` and, with decode_too, `decoded` (clashing names get underscores in front).

    A null text gives null ids, null tokens and a null decoded text; an empty one no ids and 0. Decoding returns the text
    itself but that U+2581, which stands for a space, comes back as one. Repeated rows are encoded alike; an
    empty table gives an empty one. keep names the columns to carry along (all of them by default).
    """
    keep = docs.columns if keep is None else keep
    base = docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text_col])])
    name = fresh(docs.select(*[f"`{c}`" for c in keep]) if keep else docs.limit(0).select(), "input_ids", "n_tokens", "decoded")
    fields = [base.schema[c] for c in keep]
    fields += [T.StructField(name["input_ids"], T.ArrayType(T.IntegerType(), True)), T.StructField(name["n_tokens"], T.LongType())]
    if decode_too:
        fields.append(T.StructField(name["decoded"], T.StringType()))
    schema = T.StructType(fields)

    def run(batches):
        c = codec(model, kind)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for s in slices(sizes, BATCH_CHARS):
                part = batch.slice(s.start, s.stop - s.start)
                raw = texts.slice(s.start, s.stop - s.start).to_pylist()
                values, at = c.encode_flat([t or "" for t in raw])
                nulls = np.array([t is None for t in raw])
                mask = {"mask": pa.array(nulls)} if nulls.any() else {}
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, pa.int32()), **mask)
                columns = [part.column(part.schema.get_field_index(k)) for k in keep]
                columns += [lists, pa.array(np.diff(at), pa.int64(), mask=nulls)]
                if decode_too:
                    decoded = c.decode_flat(values, at)
                    columns.append(pa.compute.if_else(pa.array(nulls), pa.scalar(None, pa.string()), decoded) if nulls.any() else decoded)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        c.forget()
        give_back()

    return base.mapInArrow(run, schema)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole text and whether decoding them gives the text back."""
    from pyspark.sql import functions as F

    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, keep=["doc_id", "text"])
    return out.select("doc_id", "n_tokens", "input_ids", (F.col("decoded").eqNullSafe(F.replace("text", F.lit(SPACE), F.lit(" ")))).alias("round_trip"))
