"""BPE encoding and decoding: a segment tree over the ranks of adjacent pairs.

The leaves of a word's tree are its symbol positions, each with the merge rank of the pair that
starts there (joined with the position, so that equal ranks fall to the left); an inner node holds
the smaller of its two children. The root is the next merge. A merge changes three leaves, and each
change climbs one path to the root. Many short words are worked on at once, their trees being the
rows of one array; a long word gets a tree of its own, so its cost is n log n.

The vocabulary file is a parameter and is read by every task. Texts are split as the file's
normaliser and splitter say: added tokens first, NFC, lower case character by character, letters,
single digits, runs of other signs; white space is dropped. Ids are decoded by joining their tokens
with one space (the file names no decoder). A null text gives no ids, as an empty one does; repeated
rows are encoded each for itself; memory follows the Arrow batch, the longest text and a cache bounded in bytes.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from driftlane.llm.base import bound, table
from driftlane.llm.words import give_back

#: Bytes of words, and of runs between white space, that a worker remembers, and of the longest one.
WORDS, RUNS, LONGEST = 48 << 20, 24 << 20, 1 << 10
#: Words of up to so many bytes share one array of trees.
TOGETHER = 64
NO_PAIR = np.int32(2**31 - 1)

#: White space as the splitter takes it; str.split() takes \\x1c-\\x1f besides.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Signs beyond Latin are normalised and split by the library, whose Unicode tables may be of another version.
ODD = regex.compile(r"[^\x00-\u024f]")
SEPARATORS = regex.compile(r"[\x1c-\x1f]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (c for c in range(256) if c not in plain)
    names = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class Memory:
    """What was worked out lately, in two generations: entries not asked for again go with the older one."""

    def __init__(self, most: int):
        self.most, self.size, self.new, self.old = most // 2, 0, {}, {}

    def add(self, key, ids: bytes) -> None:
        size = 200 + 2 * len(ids)  # the key is about as long; objects and slots take some 200
        if size > LONGEST:
            return
        if self.size + size > self.most:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[key] = ids
        self.size += size

    def known(self, keys: set) -> dict:
        out = {}
        for key in keys:
            ids = self.new.get(key)
            if ids is None and (ids := self.old.get(key)) is not None:
                self.add(key, ids)
            if ids is not None:
                out[key] = ids
        return out


class Encoder:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.added_pattern = regex.compile("|".join(sorted(map(regex.escape, self.added), key=len, reverse=True))) if self.added else None
        names = byte_characters()
        self.inner = np.array([vocab[c] for c in names], np.int64)
        self.final = np.array([vocab[c + suffix] for c in names], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.most = np.int32(len(pairs))
        self.rank_of = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        self.byte_of = {c: b for b, c in enumerate(names)}
        self.library = Tokenizer.from_file(path)
        self.words, self.runs = Memory(WORDS), Memory(RUNS)

    def split(self, run: str) -> list[str]:
        """Words of a run without added tokens and white space."""
        if not ODD.search(run):
            return PIECES.findall(unicodedata.normalize("NFC", run).lower())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(run))
        return [bytes(self.byte_of[c] for c in piece).decode() for piece, _ in pieces]

    def text_runs(self, text: str) -> list[str | int]:
        """The text's runs between white space, and the ids of added tokens that stand between them."""
        if self.added_pattern is None or not self.added_pattern.search(text):
            return [text] if SEPARATORS.search(text) else text.split()
        out, at = [], 0
        for hit in self.added_pattern.finditer(text):
            out += [*self.text_runs(text[at:hit.start()]), self.added[hit.group()]]
            at = hit.end()
        return out + self.text_runs(text[at:])

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == keys), self.ranks[at], NO_PAIR).astype(np.int32)

    def merge_many(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of words of at most ``width`` bytes (a power of two), all trees side by side."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbol = np.full((n, width + 1), -1, np.int32)
        row = np.repeat(np.arange(n), sizes)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbol[row, column] = self.inner[flat]
        last = flat[np.cumsum(sizes) - 1]
        symbol[np.arange(n), sizes - 1] = self.final[last]
        after = np.broadcast_to(np.arange(1, width + 2, dtype=np.int32), (n, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int32), (n, width + 1)).copy()
        place = np.arange(width, dtype=np.int32)
        tree = np.full((n, 2 * width), NO_PAIR, np.int32)
        ranks = self._pair_ranks(symbol[:, :-1], symbol[:, 1:])
        tree[:, width:] = np.where(ranks < NO_PAIR, np.minimum(ranks, self.most) * width + place, NO_PAIR)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level = half
        rows = np.flatnonzero(tree[:, 1] < NO_PAIR)
        while len(rows):
            root = tree[rows, 1]
            at = root % width
            gone = after[rows, at]
            nxt = np.minimum(after[rows, gone], width)
            new = self.merged[root // width]
            symbol[rows, at] = new
            symbol[rows, gone] = -1
            after[rows, at] = nxt
            before[rows, nxt] = at
            prev = before[rows, at]
            ranks = self._pair_ranks(new, symbol[rows, nxt])
            leaf = [(at, np.where(ranks < NO_PAIR, np.minimum(ranks, self.most) * width + at, NO_PAIR)), (gone, np.full(len(rows), NO_PAIR))]
            has = prev >= 0
            ranks = self._pair_ranks(symbol[rows, np.maximum(prev, 0)], new)
            # without a left neighbour the same leaf is set once more
            leaf.append((np.where(has, prev, gone), np.where(has & (ranks < NO_PAIR), np.minimum(ranks, self.most) * width + prev, NO_PAIR)))
            for position, value in leaf:
                tree[rows, width + position] = value
            for position, _ in leaf:
                node = (width + position) >> 1
                while node[0]:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node >>= 1
            rows = rows[tree[rows, 1] < NO_PAIR]
        keep = symbol >= 0
        return np.split(symbol[keep], np.cumsum(keep.sum(1))[:-1])

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word of any length."""
        symbol = self.inner[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbol)
        symbol[-1] = int(self.final[word[-1]])
        width = 1 << (n - 1).bit_length()
        none = 1 << 62
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(i: int) -> int:
            j = after[i]
            rank = self.rank_of.get(symbol[i] << 32 | symbol[j]) if j < n else None
            return none if rank is None else rank * width + i

        tree = [none] * (2 * width)
        for i in range(n):
            tree[width + i] = leaf(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            symbol[at], symbol[gone] = int(self.merged[rank]), -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            tree[width + gone] = none
            changed = [gone, at]
            tree[width + at] = leaf(at)
            if before[at] >= 0:
                tree[width + before[at]] = leaf(before[at])
                changed.append(before[at])
            for i in changed:
                node = (width + i) >> 1
                while node:
                    tree[node] = min(tree[2 * node], tree[2 * node + 1])
                    node >>= 1
        return np.array([s for s in symbol if s >= 0], np.int64)

    def _word_ids(self, words: set[str]) -> dict[str, bytes]:
        known = self.words.known(words)
        by_width: dict[int, list[str]] = {}
        for word in words - known.keys():
            by_width.setdefault(max(2, 1 << (len(word.encode()) - 1).bit_length()), []).append(word)
        for width, group in by_width.items():
            if width > TOGETHER:
                ids = [self.merge_long(w.encode()) for w in group]
            else:
                ids = [x for k in range(0, len(group), 20_000) for x in self.merge_many([w.encode() for w in group[k:k + 20_000]], width)]
            for word, own in zip(group, ids):
                known[word] = own.astype("<u4").tobytes()
                self.words.add(word, known[word])
        return known

    def ids_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of every text as little-endian bytes."""
        runs = [self.text_runs(t) for t in texts]
        wanted = set().union(*runs)
        found = self.runs.known(wanted)
        new = {r: [r] if isinstance(r, int) else self.split(r) for r in wanted - found.keys()}
        known = self._word_ids({w for words in new.values() for w in words if isinstance(w, str)})
        for run, words in new.items():
            found[run] = b"".join([w.to_bytes(4, "little") if isinstance(w, int) else known[w] for w in words])
            self.runs.add(run, found[run])
        for own in runs:
            yield b"".join([found[r] for r in own])

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, int, str]]:
        """Ids as little-endian bytes, their number, and the decoded text, of every text."""
        for ids in self.ids_batch(texts):
            yield ids, len(ids) // 4, self.decode(np.frombuffer(ids, "<u4").tolist())

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(next(self.ids_batch([text or ""])), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a file, read once by each Python worker."""
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _small_lists(texts: list[str], characters: int = 2_000_000) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > characters:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    yield part


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), n_tokens of every row."""
    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [np.frombuffer(b, "<u4").astype(np.int32) for part in _small_lists(frame["text"].fillna("").tolist()) for b in encoder(path).ids_batch(part)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": out, "n_tokens": pd.Series([len(o) for o in out], dtype="int64")})
            give_back()

    return documents.select("doc_id", "text").mapInPandas(encode, "doc_id long, ids array<int>, n_tokens long")


def encoding_digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; neither ids nor texts leave the task."""
    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                for part in _small_lists(frame["text"].fillna("").tolist()) for ids, n, text in encoder(path).encode_batch(part)
            ]
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            yield out.assign(doc_id=frame["doc_id"].to_numpy(dtype=object, na_value=None))

    return documents.select("doc_id", "text").mapInPandas(digest, "n_tokens long, ids_sha256 string, decoded_sha256 string, doc_id long").select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@bound("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), default_vocabulary())
