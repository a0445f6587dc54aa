"""Token counts of a byte-level BPE vocabulary with word ends: merges of whole batches of words by rank, in arrays."""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

VOCABULARY = "word_bpe_49k.json"
#: Texts of more characters are handled in parts, cut before white space.
PIECE = 1 << 20
#: Pre-tokens of more bytes are merged through linked places instead of by shrinking arrays.
LONG = 256
#: Characters of words whose counts a worker keeps; beyond that it starts anew.
CACHE_CHARS = 16_000_000
SEPARATORS = re.compile("[\x1c-\x1f]")
NONE = np.iinfo(np.int64).max

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes are themselves, the others follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merge table of a vocabulary, and the number of symbols that survive it.

    Symbols are numbered: 0 to 255 the bytes, 256 to 511 the bytes at a word's end, then one for each merge's result.
    """

    def __init__(self, merges: list, word_end: str):
        letters = byte_characters()
        ids = {c: b for c, b in letters.items()} | {c + word_end: 256 + b for c, b in letters.items()}
        left, right, made = (np.zeros(len(merges), np.int64) for _ in range(3))
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            left[rank], right[rank] = ids[a], ids[b]
            made[rank] = ids.setdefault(a + b, len(ids))
        self.base = len(ids)
        keys = left * self.base + right
        self.keys, first = np.unique(keys, return_index=True)
        self.ranks = first.astype(np.int64)
        self.made, self.twin = made, left == right
        # A merge whose result takes part in a merge of lower rank must not be applied to all its places at once.
        earliest = np.full(self.base, NONE)
        np.minimum.at(earliest, left, np.arange(len(merges)))
        np.minimum.at(earliest, right, np.arange(len(merges)))
        self.careful = earliest[made] <= np.arange(len(merges))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NONE."""
        keys = left * self.base + right
        if not len(self.keys):
            return np.full(len(keys), NONE)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word (not empty), all words together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        for chosen, how in ((sizes <= LONG, self._shrink), (sizes > LONG, self._linked)):
            at = np.flatnonzero(chosen)
            if len(at):
                symbols = np.frombuffer(b"".join(words[i] for i in at), np.uint8).astype(np.int64)
                symbols[np.cumsum(sizes[at]) - 1] += 256
                out[at] = how(symbols, sizes[at])
        return out

    def _shrink(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ragged rows: in each round every row applies its lowest-ranked pair wherever it has it; rows without a pair leave."""
        out, row = np.zeros(len(sizes), np.int64), np.repeat(np.arange(len(sizes)), sizes)
        while len(symbols):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            rank = np.full(len(symbols), NONE)
            inside = np.flatnonzero(row[:-1] == row[1:])
            rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
            lengths = np.diff(first, append=len(symbols))
            best = np.repeat(np.minimum.reduceat(rank, first), lengths)
            ended = best == NONE
            if ended.any():
                out[row[first[ended[first]]]] = lengths[ended[first]]
                symbols, row, rank, best = symbols[~ended], row[~ended], rank[~ended], best[~ended]
            at = self._apart(np.flatnonzero((rank == best) & (rank < NONE)), rank, row)
            if not len(at):
                continue
            symbols[at] = self.made[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, row = symbols[stay], row[stay]
        return out

    def _apart(self, at: np.ndarray, rank: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Of the places (ascending) where a row has its pair: those that are merged, from the left and without overlap."""
        if not len(at):
            return at
        own = row[at]
        if self.twin[rank[at]].any():  # a run of overlapping places: every other one
            starts = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(own, prepend=-1) != 0))
            at = at[(np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))) % 2 == 0]
            own = row[at]
        later = np.diff(own, prepend=-1) == 0
        return at[~(later & self.careful[rank[at]])]

    def _linked(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Long rows: each round takes the lowest rank of all and touches only the places that have it."""
        n, row = len(symbols), np.repeat(np.arange(len(sizes)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)
        after[ends - 1], before[ends - sizes] = -1, -1
        now = np.full(n, NONE)  # the rank of the pair that begins here
        inside = np.flatnonzero(after >= 0)
        now[inside] = self.rank(symbols[inside], symbols[after[inside]])
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def push(at: np.ndarray) -> None:
            at = at[now[at] < NONE]
            at = at[np.argsort(now[at], kind="stable")]
            starts = np.flatnonzero(np.diff(now[at], prepend=-1))
            for group in np.split(at, starts[1:]) if len(at) else ():
                rank = int(now[group[0]])
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(queue, rank)
                waiting[rank].append(group)

        push(inside)
        while queue:
            rank = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[alive[at] & (now[at] == rank)]
            if not len(at):
                continue
            if self.careful[rank]:
                push(at[1:])
                at = at[:1]
            elif self.twin[rank]:
                starts = np.flatnonzero(np.concatenate([[True], after[at[:-1]] != at[1:]]))
                at = at[(np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))) % 2 == 0]
            gone = after[at]
            symbols[at] = self.made[rank]
            alive[gone], now[gone] = False, NONE
            after[at] = after[gone]
            on = after[at] >= 0
            before[after[at[on]]] = at[on]
            touched = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
            now[touched] = NONE
            inner = touched[after[touched] >= 0]
            now[inner] = self.rank(symbols[inner], symbols[after[inner]])
            push(inner)
        return np.bincount(row[alive], minlength=len(sizes))


class Counting:
    """Token counts of texts as the tokenizers library gives them for one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as source:
            told = json.load(source)
        model, added = told["model"], told["added_tokens"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in added):
            raise ValueError(f"{path}: only byte-level BPE without unknown tokens, and added tokens that are plain strings, can be counted")
        library = Tokenizer.from_file(path)
        if library.normalizer is None or library.pre_tokenizer is None:
            raise ValueError(f"{path}: no rules for normalising or splitting texts")
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        if self.normalize("a\n\t b") != "a b" or self.split(" a  b ") != [("a", (1, 2)), ("b", (4, 5))]:
            raise ValueError(f"{path}: only vocabularies that drop white space can be counted word by word")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.merges = Merges(model["merges"], model.get("end_of_word_suffix") or "")
        self.letters = byte_characters()
        self.known: dict[str, int] = {}
        self.held = 0

    def learn(self, words: list[str]) -> None:
        """Put the counts of words (without white space) that are not known yet into ``known``."""
        joined = self.normalize(" ".join(words))
        parts = self.split(joined)
        sizes = np.fromiter(map(len, joined.split(" ")), np.int64)
        if len(sizes) != len(words):
            raise ValueError("the vocabulary's normalisation makes or drops white space within words")
        ends = np.cumsum(sizes + 1)
        owner = np.searchsorted(ends, np.fromiter((at for _, (at, _) in parts), np.int64, len(parts)), side="right")
        place: dict[str, int] = {}
        kind = np.fromiter((place.setdefault(p, len(place)) for p, _ in parts), np.int64, len(parts))
        counts = self.merges.count([bytes(map(self.letters.__getitem__, p)) for p in place])
        self.known.update(zip(words, np.bincount(owner, counts[kind], len(words)).astype(np.int64).tolist()))
        self.held += int(ends[-1]) + 8 * len(words)

    def pieces(self, text: str) -> Iterator[str]:
        """Parts of a text, cut before ASCII white space, which no match and no composed character crosses."""
        start = 0
        while len(text) - start > PIECE:
            cut = max(text.rfind(c, start + 1, start + PIECE) for c in " \n\t\r")
            if cut < 0:
                later = [p for c in " \n\t\r" if (p := text.find(c, start + PIECE)) >= 0]
                if not later:
                    break
                cut = min(later)
            yield text[start:cut]
            start = cut
        yield text[start:]

    def words(self, text: str) -> tuple[Counter, int]:
        """The words of a part of a text with their numbers, and the number of special tokens in it."""
        plain = [text] if self.special is None else self.special.split(text)
        # str.split() knows the vocabulary's white space, and four separators that to the vocabulary are none.
        parted = (self.normalize(part).split(" ") if SEPARATORS.search(part) else part.split() for part in plain)
        found = Counter(itertools.chain.from_iterable(parted))
        found.pop("", None)
        return found, len(plain) - 1

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; the words that are new in all of them are merged together."""
        out = [0] * len(texts)
        waiting: list[tuple[int, Counter]] = []
        size = 0
        for i, text in enumerate(texts):
            for piece in self.pieces(text or ""):
                found, special = self.words(piece)
                out[i] += special
                waiting.append((i, found))
                size += len(piece)
                if size > PIECE:
                    self._settle(waiting, out)
                    waiting, size = [], 0
        self._settle(waiting, out)
        return out

    def _settle(self, waiting: list[tuple[int, Counter]], out: list[int]) -> None:
        if self.held > CACHE_CHARS:
            self.known.clear()
            self.held = 0
        fresh = list(dict.fromkeys(w for _, found in waiting for w in found if w not in self.known))
        if fresh:
            self.learn(fresh)
        for i, found in waiting:
            out[i] += sum(map(operator.mul, found.values(), map(self.known.__getitem__, found)))


@functools.lru_cache(maxsize=2)
def counting(path: str) -> Counting:
    """The counter of a vocabulary file; one per Python worker."""
    return Counting(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every whole text.

    ``path`` names a tokenizers file of a byte-level BPE with word ends, on every machine; the counts are those of the
    library without added special tokens, truncation or padding. Strings of special tokens inside a text are one token
    each, the library's default. A null or empty text has no bytes and no tokens; a null doc_id stays null; repeated
    rows give repeated rows; other columns are left out.
    """
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)

    @tidy
    def run(batches):
        counter = counting(path)
        for batch in batches:
            sizes, tokens = [], []
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                sizes += [len((t or "").encode()) for t in texts]
                tokens += counter.counts(texts)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
