"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The library's own BPE joins, again and again, the adjacent pair whose joined piece scores best, the leftmost
first. Pieces never span certain adjacencies (a pair of characters that stands in no piece), so a text falls
into words that merge independently. All distinct words of an Arrow batch lie in one flat numpy symbol array;
a round finds the best pair rank of every word (a segmented minimum), joins the leftmost such pair in all words
at once and compacts the arrays, until no word has a pair left. Where no piece that ranks better contains the
joined piece at an end, joining cannot make a better pair, and every leftmost non-overlapping occurrence of the
pair in a word joins in the same round, as the library would do one by one. So does every other pair, however poor its rank,
whose place in the library's order cannot matter: no piece that ranks as well or better could take one of its symbols
first, whatever its neighbours have grown to by then, nor contain the joined piece beside what they are. So the rounds of a
long word do not grow with its length, but with how far such pairs hang together.

Defined results: null counts as empty and gives the begin and end ids alone; texts are encoded whole; extra
columns of the input are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from convoweave.llm.rows import slices
from convoweave.session import table

SPACE = "▁"  # what the model has for a space
CACHED_WORDS = 100_000  # of a task; its cache is emptied when it is full
FAR = np.iinfo(np.int64).max


class PieceModel:
    """The vocabulary of a BPE model file with byte fallback, as numpy tables.

    `path` must be readable where the tasks run, like any library file. Only the identity normaliser with a dummy
    prefix and kept white space is supported; other models raise ValueError.
    """

    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        if library.encode("a  b", out_type=str) != [*library.encode("a", out_type=str), SPACE, *library.encode("b", out_type=str)]:
            raise ValueError("only models that keep white space and add a dummy prefix are supported")
        n = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(n)]
        special = [library.is_control(i) or library.is_unknown(i) for i in range(n)]
        self.bos, self.eos = library.bos_id(), library.eos_id()
        byte = [library.is_byte(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.uint32)
        for i in np.flatnonzero(byte):
            self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        self.byte_of = {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.silent = {i for i in range(n) if library.is_control(i)}
        self.pieces[library.unk_id()] = " \u2047 "  # what the library decodes it to
        words = {p: i for i, p in enumerate(self.pieces) if not special[i] and not byte[i]}
        # Characters of pieces that are no pieces themselves get ids from n on.
        self.symbols = words | {c: n + k for k, c in enumerate(sorted({c for p in words for c in p} - words.keys()))}
        rank = {p: r for r, (_, _, p) in enumerate(sorted((-library.get_score(i), i, p) for p, i in words.items()))}
        beside = {p[k : k + 2] for p in words for k in range(len(p) - 1)}
        self.symbol_of = np.full(0x110000, -1, np.int64)
        for c in (c for c in self.symbols if len(c) == 1):
            self.symbol_of[ord(c)] = self.symbols[c]
        self.beside_keys = np.array(sorted(self.symbols[b[0]] << 32 | self.symbols[b[1]] for b in beside), np.int64)
        apart = not any(b[0] != SPACE and b[1] == SPACE or "\n" in b for b in beside)
        self.word_of = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+" if apart else "(?s).+")
        pairs, unsafe, grown = [], set(), ({}, {})
        for p, i in words.items():
            for k in range(1, len(p)):
                left, right = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if left is not None and right is not None:
                    pairs.append((left << 32 | right, rank[p], i))
                    # What a pair has to fear: its left symbol as the end of a longer one, its right as the beginning.
                    ends = ((0, self.symbols.get(p[j:k]), right) for j in range(1, k))
                    begins = ((1, left, self.symbols.get(p[k:j])) for j in range(k + 1, len(p)))
                    for side, a, b in chain(ends, begins):
                        if a is not None and b is not None and grown[side].get(a << 32 | b, FAR) > rank[p]:
                            grown[side][a << 32 | b] = rank[p]
                unsafe.update(q for q in (p[:k], p[k:]) if rank.get(q, -1) > rank[p])
        pairs.sort()
        self.pair_keys, self.pair_ranks, self.pair_ids = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.grown_keys, self.grown_ranks = [], []
        for known in grown:
            keys = np.fromiter(known.keys(), np.int64, len(known))
            order = np.argsort(keys)
            self.grown_keys.append(keys[order])
            self.grown_ranks.append(np.fromiter(known.values(), np.int64, len(known))[order])
        self.safe = np.ones(len(words), bool)
        self.safe[[rank[p] for p in unsafe]] = False
        self.id_of_rank = np.zeros(len(words), np.int64)
        self.id_of_rank[list(rank.values())] = [words[p] for p in rank]
        self.n = n

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's joined piece; FAR where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], FAR)

    def beats(self, rank: np.ndarray, left: np.ndarray, right: np.ndarray, side: int, equal: bool = False) -> np.ndarray:
        """Whether ranks are better than that of each pair, now and with its left (side 0) or right symbol grown; a symbol
        of -2 is none. equal: as good is enough."""
        key, keys = left << 32 | right, self.grown_keys[side]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        other = np.minimum(np.where(keys[at] == key, self.grown_ranks[side][at], FAR), self.ranks(left, right))
        return (left == -2) | (right == -2) | (rank < other) | (equal & (rank == other))

    def alone(self, at: np.ndarray, symbol: np.ndarray, segment: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Of places of pairs, those that can be joined at once wherever the library's order has them."""
        rank, joined = pair[at], self.id_of_rank[pair[at]]
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(symbol) - 1)
        left = np.where((at > 0) & (segment[before] == segment[at]), symbol[before], -2)
        right = np.where((at + 2 < len(symbol)) & (segment[after] == segment[at]), symbol[after], -2)
        good = self.beats(rank, left, symbol[at], 0) & self.beats(rank, symbol[at + 1], right, 1, equal=True)
        at, rank, joined, left, right = (x[good] for x in (at, rank, joined, left, right))
        return at[self.beats(rank, left, joined, 0) & self.beats(rank, joined, right, 1)]

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers, by merge rounds over all words at once."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbol = self.symbol_of[chars]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        apart = ~found_in(self.beside_keys, symbol[:-1] << 32 | symbol[1:])
        apart[ends[:-1] - 1] = True
        segment = np.cumsum(np.r_[False, apart])  # merges stay inside words, and inside what a piece can span
        first = np.arange(len(chars))  # the character at which a symbol starts
        pair = np.r_[self.ranks(symbol[:-1], symbol[1:]), FAR]
        pair[:-1][apart] = FAR
        done = []
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            best = np.repeat(np.minimum.reduceat(pair, starts), np.diff(np.r_[starts, len(symbol)]))
            ended = best == FAR
            if ended.any():
                done.append((first[ended], symbol[ended]))
                symbol, segment, first, pair, best = (x[~ended] for x in (symbol, segment, first, pair, best))
                if not len(symbol):
                    break
            hit = np.flatnonzero(pair == best)
            # Of touching hits every second one counts, from the left; of unsafe ones a segment's first only.
            new = np.r_[True, segment[hit[1:]] != segment[hit[:-1]]]
            run = np.flatnonzero(new | np.r_[True, np.diff(hit) != 1])
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
            hit = hit[np.where(self.safe[best[hit]], place % 2 == 0, new)]
            others = np.flatnonzero((pair != FAR) & (pair != best) & (pair < np.r_[FAR, pair[:-1]]) & (pair <= np.r_[pair[1:], FAR]))
            if len(others):
                hit = np.sort(np.r_[hit, self.alone(others, symbol, segment, pair)])
            rank = pair[hit]
            symbol[hit] = self.id_of_rank[rank]
            stays = np.ones(len(symbol), bool)
            stays[hit + 1] = False
            hit -= np.arange(len(hit))  # one symbol has gone for each hit before
            symbol, segment, first, pair = symbol[stays], segment[stays], first[stays], pair[stays]
            for at in (hit, hit[hit > 0] - 1):  # only pairs beside a join change
                after = np.minimum(at + 1, len(symbol) - 1)
                pair[at] = np.where((after > at) & (segment[at] == segment[after]), self.ranks(symbol[at], symbol[after]), FAR)
        first, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(first)
        first, symbol = first[order], symbol[order]
        strange = np.flatnonzero((symbol < 0) | (symbol >= self.n))
        if len(strange):  # characters that the vocabulary lacks become their bytes
            raw = [self.byte_ids[list(chr(c).encode())] for c in chars[first[strange]].tolist()]
            size = np.ones(len(symbol), np.int64)
            size[strange] = list(map(len, raw))
            first, symbol = np.repeat(first, size), np.repeat(symbol, size)
            symbol[(symbol < 0) | (symbol >= self.n)] = np.concatenate(raw)
        ids = symbol.astype("<u4").tobytes()
        at = [0, *(4 * np.searchsorted(first, ends)).tolist()]
        return [ids[a:z] for a, z in zip(at, at[1:], strict=False)]

    def split(self, text: str) -> list[str]:
        """Words of a text that has no spaces but SPACE, cut where no piece can lie across; joined they are the text."""
        return self.word_of.findall(text)

    def encode_batch(self, texts: Iterable[str | None], known: dict[str, bytes] | None = None) -> Iterator[bytes]:
        """The ids of each text with begin and end ids. known: the words that a task has met, with their ids."""
        begin, end = (np.array([x], "<u4").tobytes() for x in (self.bos, self.eos))
        words = [self.split(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        known = {} if known is None else known
        if len(known) > CACHED_WORDS:
            known.clear()
        new = list(set(chain.from_iterable(words)).difference(known))
        if new:
            known.update(zip(new, self.merge(new), strict=True))
        for x in words:
            yield begin + b"".join(map(known.__getitem__, x)) + end

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: byte pieces join to UTF-8, each byte that fits nowhere gives U+FFFD, the dummy prefix goes."""
        out, raw, pieces, byte_of, silent = [], b"", self.pieces, self.byte_of, self.silent
        for i in ids:
            if i in byte_of:
                raw += byte_of[i]
                continue
            if raw:
                out.append(from_bytes(raw))
                raw = b""
            if i not in silent:
                out.append(pieces[i])
        if raw:
            out.append(from_bytes(raw))
        text = "".join(out)
        return text.removeprefix(SPACE).replace(SPACE, " ")


def found_in(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


codecs.register_error("each byte", lambda e: ("\ufffd", e.start + 1))


def from_bytes(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for every byte that belongs to no character."""
    return raw.decode("utf-8", "each byte")


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and the ids of each row's text, as binary little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = load(model_path), {}
        for b in slices(batches):
            column = pa.array(model.encode_batch(b.column("_text").to_pylist(), known), pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), column], [*keep, ids])

    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = source.select(*keep).schema.add(ids, "binary")
    return source.mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str, ids: str = "ids", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and the text that each row's ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for b in slices(batches):
            column = pa.array((model.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column(ids).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), column], [*keep, text])

    source = rows.select(*keep, ids)
    return source.mapInArrow(run, source.select(*keep).schema.add(text, "string"))


def token_digests(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_tokens, ids_sha256 and decoded_sha256: the round trip of every whole text, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = load(model_path), {}
        for b in slices(batches):
            n, encoded, decoded = [], [], []
            for x in model.encode_batch(b.column("_text").to_pylist(), known):
                n.append(len(x) // 4)
                encoded.append(hashlib.sha256(x).hexdigest())
                decoded.append(hashlib.sha256(model.decode(np.frombuffer(x, "<u4").tolist()).encode()).hexdigest())
            columns = [pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *columns], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = source.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return source.mapInArrow(run, schema)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` encoded and decoded with the 32k BPE model."""
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
