"""Byte-level BPE by speculation and verification, and decoding.

A text is cut into pretokens by the vocabulary's pattern, with array operations over its bytes.  Each distinct pretoken
is first cut greedily, always taking the longest token (an Aho-Corasick automaton over all of them at once).  A cut is
the BPE result exactly when every adjacent pair of tokens would stay apart if its two tokens were encoded alone; that
test runs on all pairs together.  Only pretokens with a failing pair are merged exactly: short ones all together, long
ones (over LONG bytes) each with a heap of its pairs, in time of the order of n log n.

Rows: a null text encodes as the empty text (no ids, digest of the empty string); repeated rows repeat; the special
token's string inside a text is that token; texts of any length are read whole, further columns are ignored, and an
empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, table
from .textcols import slices, utf8

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def class_table() -> bytes:
    """The class of every code point, compressed, as the tokenizers library's own pattern has it (its tables may be of
    another Unicode version than Python's): a character is of the class whose sample it stays together with."""
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False, use_regex=True)
    out = np.full(0x110000, OTHER, np.uint8)
    assigned = [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)]
    for first in range(0, len(assigned), 1 << 14):
        points = assigned[first : first + (1 << 14)]
        starts = np.zeros(9 * len(points), bool)
        starts[[at for _, (at, _) in cut.pre_tokenize_str("".join([f"a{c} 1{c} !{c} " for c in map(chr, points)]))]] = True
        parted = starts.reshape(-1, 9)[:, [1, 4, 7]]
        out[points] = np.select([~parted[:, 0], ~parted[:, 1], ~parted[:, 2]], [LETTER, NUMBER, OTHER], SPACE)
    return zlib.compress(out.tobytes())


@functools.lru_cache(maxsize=2)
def _classes(table: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(table), np.uint8)


def _byte_classes(data: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class of each byte's character (of UTF-8 text)."""
    out = classes[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        d = data.astype(np.uint32, copy=False) if len(lead) > len(data) // 4 else data
        first = d[lead].astype(np.uint32)
        more = [d[np.minimum(lead + k, len(data) - 1)].astype(np.uint32) & 0x3F for k in (1, 2, 3)]
        point = np.where(first < 0xE0, (first & 0x1F) << 6 | more[0], np.where(first < 0xF0, (first & 15) << 12 | more[0] << 6 | more[1], (first & 7) << 18 | more[0] << 12 | more[1] << 6 | more[2]))
        kind = classes[np.minimum(point, 0x10FFFF)]
        out[lead] = kind
        for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            some = first >= least
            out[np.minimum(lead[some] + k, len(data) - 1)] = kind[some]
    return out


def pretoken_starts(data: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte positions where pretokens start.  bounds: ascending starts of the texts, and the end of the last one."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _byte_classes(data, classes)
    head = np.zeros(n + 1, bool)  # a text starts here
    head[bounds] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= head[:-1]
    # The last space character before other text parts from the whitespace before it; a plain space joins what follows
    space = kind == SPACE
    last = np.zeros(n, bool)  # last byte of a whitespace run that other text follows
    last[:-1] = space[:-1] & ~space[1:] & ~head[1:-1]
    at = np.flatnonzero(last)
    lead = at.copy()  # first byte of that character
    for _ in range(3):
        back = (data[lead] & 0xC0) == 0x80
        lead[back] -= 1
    start[lead] = True
    plain = at[data[at] == 32]
    start[plain + 1] = False
    # Contractions: an apostrophe that stands alone and starts a match
    mark = np.flatnonzero((data == 39) & start)
    if len(mark):
        mark = mark[mark + 1 < n]
        mark = mark[(kind[mark + 1] == LETTER) & ~head[mark + 1]]
        one, two = data[mark + 1], data[np.minimum(mark + 2, n - 1)]
        second = (mark + 2 < n) & ~head[np.minimum(mark + 2, n)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = second & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
        start[mark[short | long] + 1] = False
        for cut in (mark[short] + 2, mark[long & ~short] + 3):
            start[cut[cut < n]] = True
    return np.flatnonzero(start)


class _Pairs:
    """Merged id of a pair of ids, or -1, for whole arrays of pairs."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = left.astype(np.int64) << 20 | right
        self.tables, rest = [], np.arange(len(keys))
        for bits, factor in ((20, 0x9E3779B97F4A7C15), (17, 0xC2B2AE3D27D4EB4F), (12, 0x165667B19E3779F9), (12, 0xD6E8FEB86659FD93), (12, 0xA0761D6478BD642F)):
            slot = self._slot(keys[rest], bits, factor)
            key, value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
            key[slot], value[slot] = keys[rest], merged[rest]
            rest = rest[key[slot] != keys[rest]]
            self.tables.append((bits, factor, key, value))
            if not len(rest):
                break
        if len(rest):
            raise ValueError("merge table too dense")

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, factor: int) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(factor) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        out = np.full(len(keys), -1, np.int32)
        for bits, factor, key, value in self.tables:
            slot = self._slot(keys, bits, factor)
            hit = key[slot] == keys
            out[hit] = value[slot[hit]]
        return out


class Bpe:
    """Encoder and decoder of one vocabulary file (tokenizers JSON of byte-level BPE, in which ids follow merge ranks)."""

    CACHED = 150_000  # pretokens a worker remembers
    LONG = 256  # bytes of a pretoken that is merged by a heap, and never remembered

    def __init__(self, path: str, classes: bytes):
        self.classes = _classes(classes)
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        vocab = j["model"]["vocab"]
        to_byte = _byte_alphabet()
        self.special = {t["content"].encode(): t["id"] for t in j["added_tokens"]}
        size = max(max(vocab.values()), *self.special.values(), 0) + 1
        self.tokens: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.tokens[i] = bytes(to_byte[c] for c in word)
        for word, i in self.special.items():
            self.tokens[i] = word
        merges = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int32) for k in (0, 1))
        merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        if (np.diff(merged) <= 0).any():
            raise ValueError("ids must follow the merges' ranks")
        self.pair = _Pairs(left, right, merged)
        self.left, self.right = np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32)
        self.left[merged], self.right[merged] = left, right
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.byte_id = np.zeros(256, np.int32)
        self.ordinary = sorted(set(vocab.values()))
        for i in self.ordinary:
            if len(self.tokens[i]) == 1:
                self.byte_id[self.tokens[i][0]] = i
        self.token_bytes = pa.array(self.tokens, pa.large_binary())
        self.decimals = pa.array([b"%d," % i for i in range(size)], pa.large_binary())
        self.cache: dict[bytes, bytes] = {}

    @functools.cached_property
    def automaton(self):
        """All ordinary tokens; only encoders need it."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for i in self.ordinary:
            out.add_word(self.tokens[i].decode("latin-1"), i)
        out.make_automaton()
        return out

    def compatible(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether each pair of ids stays apart when its bytes are encoded alone.

        Walks back through the merges that made the two tokens, the latest first: at each step the tokens that met at
        the border then must not have had a merge of an earlier rank than the one undone."""
        ok = np.ones(len(one), bool)
        at = np.arange(len(one))
        a, b = one.astype(np.int32), two.astype(np.int32)
        limit = np.full(len(one), np.iinfo(np.int32).max, np.int32)
        while len(at):
            joined = self.pair(a, b)
            bad = (joined >= 0) & (joined < limit)
            ok[at[bad]] = False
            split_a, split_b = self.right[a] != a, self.left[b] != b
            go = ~bad & (split_a | split_b)
            at, a, b, limit, split_a, split_b = (x[go] for x in (at, a, b, limit, split_a, split_b))
            # Undo the later merge; of two equal ids the right one came later, as merging goes from left to right
            undo_a = split_a & (~split_b | (a > b))
            limit = np.where(undo_a, a, b + 1).astype(np.int32)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def _merge_exactly(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): BPE of all words together, the lowest-ranked pair of every word in each round."""
        none = np.iinfo(np.int32).max
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_ids, done_word = [], []
        while len(ids):
            rank = np.full(len(ids), none, np.int32)
            rank[:-1] = np.where(word[:-1] == word[1:], self.pair(ids[:-1], ids[1:]), -1) if len(ids) > 1 else -1
            rank[rank < 0] = none
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.r_[heads, len(ids)])
            least = np.repeat(best, sizes)
            if (over := least == none).any():
                done_ids.append(ids[over])
                done_word.append(word[over])
                ids, word, rank, least = (x[~over] for x in (ids, word, rank, least))
            take = rank == least
            # of overlapping pairs (the same id in a run) every second one merges, from the left
            chain = np.flatnonzero(take[1:] & take[:-1]) + 1
            for k in chain.tolist():
                if take[k - 1]:
                    take[k] = False
            ids = np.where(take, rank, ids)
            gone = np.zeros(len(ids), bool)
            gone[1:] = take[:-1]
            ids, word = ids[~gone], word[~gone]
        ids, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_ids, done_word))
        order = np.argsort(word, kind="stable")
        return ids[order].astype(np.int32), np.searchsorted(word[order], np.arange(len(words)), side="right")

    def _merge_long(self, word: bytes) -> np.ndarray:
        """BPE of one long word: the lowest-ranked pair first, of equal ranks the leftmost, over linked places."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)]
        n = len(ids)
        first = self.pair(ids[:-1], ids[1:])
        told = np.flatnonzero(first >= 0)
        heap = list(zip(first[told].tolist(), told.tolist()))
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}
        one, two = np.zeros(1, np.int32), np.zeros(1, np.int32)

        def rank(a: int, b: int) -> int:
            found = known.get((a, b))
            if found is None:
                one[0], two[0] = a, b
                found = known[a, b] = int(self.pair(one, two)[0])
            return found

        ids, after, before, alive = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
        while heap:
            merged, at = heapq.heappop(heap)
            end = after[at] if alive[at] else n
            if end == n or rank(ids[at], ids[end]) != merged:
                continue  # one of the two has changed since
            ids[at], alive[end], after[at] = merged, 0, after[end]
            if after[end] < n:
                before[after[end]] = at
                if (new := rank(merged, ids[after[end]])) >= 0:
                    heapq.heappush(heap, (new, at))
            if before[at] >= 0 and (new := rank(ids[before[at]], merged)) >= 0:
                heapq.heappush(heap, (new, before[at]))
        return np.array(ids, np.int32)[np.frombuffer(alive, np.uint8) > 0]

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): BPE of all words, by the way that fits their lengths."""
        long = [k for k, w in enumerate(words) if len(w) > self.LONG]
        if not long:
            return self._merge_exactly(words)
        ids, ends = self._merge_exactly([w for w in words if len(w) <= self.LONG])
        short = iter(np.split(ids, ends[:-1]) if len(ends) else ())
        parts = [self._merge_long(w) if len(w) > self.LONG else next(short) for w in words]
        return np.concatenate(parts).astype(np.int32), np.cumsum([len(x) for x in parts])

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all pretokens, one after another, and where each one's end."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        found = list(self.automaton.iter_long("Ā".join([w.decode("latin-1") for w in words])))
        ends, ids = (np.array(x, np.int64) for x in zip(*found))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word_start = np.cumsum(sizes + 1) - sizes - 1
        word = np.searchsorted(word_start, ends, side="right") - 1
        first = np.r_[True, word[1:] != word[:-1]]
        good = np.ones(len(words), bool)
        began = ends + 1 - self.length[ids]
        gap = np.where(first, began != word_start[word], began != np.r_[0, ends[:-1]] + 1)
        good[word[gap]] = False
        good[np.bincount(word, self.length[ids], len(words)) != sizes] = False
        inner = np.flatnonzero(~first)
        pairs, back = np.unique(ids[inner - 1] << 20 | ids[inner], return_inverse=True)
        apart = self.compatible(pairs >> 20, pairs & 0xFFFFF)[back]
        good[word[inner[~apart]]] = False
        counts = np.bincount(word, minlength=len(words))
        failing = np.flatnonzero(~good)
        if not len(failing):
            return ids.astype(np.int32), np.cumsum(counts)
        exact, exact_ends = self._merged([words[k] for k in failing.tolist()])
        counts[failing] = np.diff(exact_ends, prepend=0)
        out_ends = np.cumsum(counts)
        out = np.empty(out_ends[-1], np.int32)
        owner = np.repeat(np.arange(len(words)), counts)
        out[good[owner]] = ids[good[word]]
        out[~good[owner]] = exact
        return out, out_ends

    def _split_special(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Bounds of the stretches between special tokens, and the special tokens' places (start: id)."""
        body, places, bounds = data.tobytes(), {}, [offsets]
        for word, i in self.special.items():
            at = body.find(word)
            while at >= 0:
                end = at + len(word)
                if np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, end, side="left"):
                    places[at] = i
                    bounds.append(np.array([at, end]))
                    at = body.find(word, end)
                else:
                    at = body.find(word, at + 1)
        return np.unique(np.concatenate(bounds)), places

    def encode_batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of the texts data[offsets[i]:offsets[i + 1]]; ends has a leading 0."""
        bounds, special = self._split_special(data, offsets)
        starts = pretoken_starts(data, bounds, self.classes)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if special:  # what the pattern finds inside a special token is not cut
            at = np.array(sorted(special))
            lengths = np.array([len(self.tokens[special[k]]) for k in at.tolist()])
            inside = np.searchsorted(at, starts, side="right") - 1
            starts = starts[(inside < 0) | (starts == at[inside]) | (starts >= at[inside] + lengths[inside])]
        ends = np.r_[starts, len(data)].astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
        which, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        flat, flat_start, counts = self._ids_of(words)
        if special:
            which = which.astype(np.int64)
            where = np.searchsorted(starts, at)
            which[where] = len(words) + np.arange(len(at))
            flat_start = np.r_[flat_start, len(flat) + np.arange(len(at))]
            flat = np.r_[flat, np.array([special[k] for k in at.tolist()], np.int32)]
            counts = np.r_[counts, np.ones(len(at), np.int64)]
        many = counts[which]
        total = np.r_[0, np.cumsum(many)]
        ids = flat[np.repeat(flat_start[which] - total[:-1], many) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]

    def _ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, counts) of distinct pretokens, those seen before from the worker's bounded cache."""
        cache = self.cache
        new = [w for w in words if w not in cache]
        if new:
            if len(cache) > self.CACHED:
                cache.clear()
                new = words
            ids, ends = self.encode_words(new)
            whole, ends = ids.astype(np.int32).tobytes(), (4 * ends).tolist()
            told = {w: whole[a:b] for w, a, b in zip(new, [0, *ends[:-1]], ends)}
            cache.update((w, x) for w, x in told.items() if len(w) <= self.LONG)
            parts = [cache[w] if len(w) <= self.LONG else told[w] for w in words]
        else:
            parts = [cache[w] for w in words]
        counts = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        return np.frombuffer(b"".join(parts), np.int32), np.cumsum(counts) - counts, counts

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of the id lists ids[ends[i]:ends[i + 1]]; bytes that are no UTF-8 become replacement characters."""
        body = self.token_bytes.take(pa.array(ids))
        data, _ = utf8(body)
        places = np.r_[0, np.cumsum(self.length[ids])][ends].tolist()
        whole = data.tobytes()
        return [whole[a:b].decode("utf-8", errors="replace") for a, b in zip(places[:-1], places[1:])]

    def id_digests(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """SHA-256 of each id list as decimals joined by commas."""
        texts = self.decimals.take(pa.array(ids))
        data, offsets = utf8(texts)
        whole, places = memoryview(data.tobytes()), offsets[ends].tolist()
        return [hashlib.sha256(whole[a : max(a, b - 1)]).hexdigest() for a, b in zip(places[:-1], places[1:])]


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: visible Latin-1 for itself, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def bpe(path: str, classes: bytes) -> Bpe:
    """One encoder a Python worker and vocabulary."""
    return Bpe(path, classes)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): each text's token ids."""
    path, classes = path or vocabulary_path(), class_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, classes)
        for batch in slices(batches, "text"):
            ids, ends = coder.encode_batch(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], [id_col, "ids"])

    return bounded_batches(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{id_col} long, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, text): texts of token ids, and the ids' digest."""
    path, classes = path or vocabulary_path(), class_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, classes)
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy()[ends[0] : ends[-1]]
            ends = ends - ends[0]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(ends)), pa.array(coder.id_digests(ids, ends)), pa.array(coder.decode_batch(ids, ends))], [id_col, "n_tokens", "ids_sha256", "text"])

    return bounded_batches(df).select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, text string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = decode(encode(table(spark, sf_dir, "documents")))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"))


QUERIES = {"op6_bpe": op6_bpe}
ORACLES: dict[str, str] = {}
