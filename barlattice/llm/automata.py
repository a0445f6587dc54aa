"""Removal of repeated word windows by suffix automata of reference passages.

Passages around repeated anchors are the references. A shard is a bounded number of passages, whole
gram groups where these are small; its suffix automaton keeps, for each state, where its strings end
first. Passages then stream through the automaton: the matching statistics say, for every window,
where the same words start first in the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import Plan, batch_spots, columns_hash, full_windows, is_hot, pack, repeated_spans, scramble, span_parcels, unpack, word_bounds, word_tokens
from .common import text_buffer, tidy

SPAN = 20
PLAN = Plan(SPAN, 8)
#: Passages gathered by a task before it settles them among themselves.
RUN = 200_000
#: Words new to an automaton after which it is full (a word makes one or two states of some 400 bytes).
SHARD = 60_000


class SuffixAutomaton:
    """All substrings of the passages added; passages are added in the order of their places."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.first: list[tuple[int, int]] = [(-1, -1)]  # (passage, end) of the first occurrence

    def _state(self, edges: dict, link: int, length: int, first: tuple[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def add(self, number: int, words: list) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for end, word in enumerate(words, 1):
            known = nexts[last].get(word)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            state = -1 if known is not None else self._state({}, 0, length[last] + 1, (number, end))
            at = last
            while at >= 0 and word not in nexts[at]:
                nexts[at][word] = state
                at = link[at]
            if at >= 0:
                old = nexts[at][word]
                if length[old] == length[at] + 1:
                    suffix = old
                else:
                    suffix = self._state(dict(nexts[old]), link[old], length[at] + 1, self.first[old])
                    while at >= 0 and nexts[at].get(word) == old:
                        nexts[at][word] = suffix
                        at = link[at]
                    link[old] = suffix
                if state >= 0:
                    link[state] = suffix
                else:
                    state = suffix
            last = state

    def first_starts(self, words: list, span: int) -> Iterator[tuple[int, int, int]]:
        """(end, passage, end there) for each window of ``span`` words that some passage holds."""
        nexts, link, length = self.next, self.link, self.length
        state, matched = 0, 0
        for end, word in enumerate(words, 1):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            step = nexts[state].get(word)
            if step is None:
                continue
            state, matched = step, matched + 1
            if matched >= span:
                at = state
                while length[link[at]] >= span:
                    at = link[at]
                yield end, *self.first[at]


def word_passages(batches: Iterator[pa.RecordBatch], plan: Plan, buckets: int, hot: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Distinct passages for each gram bucket (kind 0), and spans settled within the task (kind 1)."""
    held, size = [], 0

    def settle():
        marks, grams, far_right, far_left, doc, spot, left, right = (np.concatenate([h[i] for h in held]) for i in range(8))
        texts = [t for h in held for t in h[8]]
        order = np.lexsort((spot, doc, marks))
        fresh = np.r_[True, marks[order][1:] != marks[order][:-1]]
        for i in np.flatnonzero(~fresh).tolist():  # equal hashes: equal words?
            x, y = order[i - 1], order[i]
            fresh[i] = texts[x] != texts[y] or left[x] != left[y]
        later = order[~fresh]
        near, far = full_windows(left[later], right[later], plan)
        whole = near <= far
        yield from span_parcels(doc[later][whole], (spot[later] - far)[whole], (spot[later] - near + plan.span)[whole], buckets, 1)
        item = order[fresh]
        # A hot gram's passages go by more of what windows hold: those that reach far right, those that reach far left.
        warm = is_hot(grams[item], buckets, hot)
        after, before = item[warm & (right[item] >= plan.span - plan.half)], item[warm & (left[item] > plan.half)]
        which = np.concatenate([item[~warm], after, before])
        role = np.repeat(np.array([0, 1, 2], np.uint8), [int((~warm).sum()), len(after), len(before)])
        key = np.concatenate([grams[item[~warm]], far_right[after], far_left[before]])
        home = (key % np.uint64(buckets)).astype(np.int64)
        sequence = np.lexsort((marks[which], key, home))
        edges = np.searchsorted(home[sequence], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            chosen = sequence[edges[b] : edges[b + 1]]
            mine = which[chosen]
            yield 0, int(b), pack(key[chosen], doc[mine], spot[mine].astype(np.uint32), left[mine].astype(np.uint8), role[chosen], b"\n".join([texts[i] for i in mine.tolist()]))

    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        ids, owners, spots = batch_spots(batch)
        for a in range(0, len(owners), RUN):
            o, s = owners[a : a + RUN], spots[a : a + RUN]
            i, j = int(o[0]), int(o[-1]) + 1
            low = offsets[i]
            part = data[low : offsets[j]]
            starts, ends, firsts = word_bounds(part, offsets[i : j + 1] - low)
            tokens, _ = word_tokens(part, offsets[i : j + 1] - low)
            at = firsts[o - i] + s
            left = np.minimum(plan.left, s)
            right = np.minimum(plan.span, firsts[o - i + 1] - at)
            marks = scramble((left * 256 + right).astype(np.uint64))
            column = np.arange(-plan.left, plan.span)
            for c in column.tolist():
                within = (c >= -left) & (c < right)
                marks = scramble(marks * np.uint64(3) + np.where(within, tokens[np.clip(at + c, 0, len(tokens) - 1)], np.uint64(0)))
            def token(c):
                return tokens[np.clip(at + c, 0, len(tokens) - 1)]

            grams = columns_hash([token(c) for c in range(plan.gram)])
            far_right = columns_hash([np.full(len(at), 1, np.uint64), grams, *(token(c) for c in range(plan.gram, plan.span - plan.half))])
            far_left = columns_hash([np.full(len(at), 2, np.uint64), grams, *(token(-c - 1) for c in range(plan.half + 1))])
            raw = part.tobytes()
            texts = [raw[x:y] for x, y in zip(starts[at - left].tolist(), ends[at + right - 1].tolist())]
            texts = [b" ".join(t.split()) for t in texts]
            held.append((marks, grams, far_right, far_left, ids[o], s, left, right, texts))
            size += len(o)
            if size >= RUN:
                yield from settle()
                held, size = [], 0
    if held:
        yield from settle()


def match_parcels(blobs: list[bytes], plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc_id, start, end) of the windows of one gram bucket that start earlier as well."""
    seen = [unpack(b) for b in blobs]
    grams, doc, spot, left, role = (np.concatenate([x[i] for x in seen]) for i in range(5))
    doc, spot, left = doc.astype(np.int64), spot.astype(np.int64), left.astype(np.int64)
    texts = [t for x in seen for t in x[5].split(b"\n")]
    rank = np.lexsort((spot, doc, grams)).tolist()
    owner, start, end = [], [], []
    group: list[int] = []
    shard: list[tuple[int, list[bytes]]] = []
    waiting = 0

    def stream(references: list[tuple[int, list[bytes]]]) -> None:
        """Match the passages against the automata of all: a passage against those that begin no later."""
        begin = 0
        while begin < len(references):
            automaton, end = SuffixAutomaton(), begin
            while end < len(references) and len(automaton.link) <= SHARD:
                automaton.add(end, references[end][1])
                end += 1
            match(automaton, references, begin)
            begin = end

    def match(automaton: SuffixAutomaton, references: list[tuple[int, list[bytes]]], begin: int) -> None:
        for i, words in references[begin:]:
            base = int(spot[i] - left[i])
            for stop, number, there in automaton.first_starts(words, plan.span):
                r = references[number][0]
                at = base + stop - plan.span
                if role[i] and (role[i] == 1) != (int(spot[i]) - at <= plan.half):
                    continue  # the other copy of this passage sees to this window
                if (int(doc[r]), int(spot[r] - left[r]) + there - plan.span) < (int(doc[i]), at):
                    owner.append(int(doc[i]))
                    start.append(at)
                    end.append(at + plan.span)

    def close_shard() -> None:
        nonlocal waiting
        if shard:
            shard.sort(key=lambda x: (doc[x[0]], spot[x[0]]))
            stream(shard)
            shard.clear()
        waiting = 0

    def close_group() -> None:
        """Passages of one gram, first places first: equal ones are settled, the others matched."""
        nonlocal waiting
        distinct: list[tuple[int, list[bytes]]] = []
        known: set[tuple] = set()
        for i in group:
            key = (int(left[i]), texts[i])
            words = texts[i].split(b" ")
            if key in known:
                right = len(words) - int(left[i])
                near, far = max(0, plan.span - right), min(plan.left, int(left[i]))
                near, far = (max(near, plan.half + 1) if role[i] == 2 else near), (min(far, plan.half) if role[i] == 1 else far)
                if near <= far:
                    owner.append(int(doc[i]))
                    start.append(int(spot[i]) - far)
                    end.append(int(spot[i]) - near + plan.span)
            else:
                known.add(key)
                distinct.append((i, words))
        if len(distinct) > 1:
            words = sum(len(w) for _, w in distinct)
            if waiting + words > SHARD // 4:
                close_shard()
            if words > SHARD // 4:
                stream(distinct)
            else:
                shard.extend(distinct)
                waiting += words
        group.clear()

    for i in rank:
        if group and grams[group[-1]] != grams[i]:
            close_group()
        group.append(i)
    if group:
        close_group()
    close_shard()
    return np.array(owner, np.int64), np.array(start, np.int64), np.array(end, np.int64)


def deduplicate(docs: DataFrame, span: int = SPAN, with_text: bool = False) -> DataFrame:
    """Remove each word covered by a window of ``span`` words that also starts earlier.

    Earlier is a smaller doc_id, or an earlier start in the same document. Windows are judged on the
    input, not on what is left. Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words
    joined by one space); with ``with_text`` also ``kept``, that text. Null, empty and wordless texts
    have no words. A row with a null doc_id is not compared and stays whole. doc_id is taken as a key;
    repeated rows count as one document and get the same result each. Empty tables give empty
    results.
    """
    plan = PLAN if span == SPAN else Plan(span, max(1, span // 2))

    @tidy
    def cut_out(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            marks, edges = text_buffer(batch.column(2))
            raw = marks.tobytes()
            rows = []
            for i in range(batch.num_rows):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                spans = np.frombuffer(raw[edges[i] : edges[i + 1]], "<u4").reshape(-1, 2).tolist()
                parts, at = [], 0
                for a, b in spans:
                    parts += words[at:a]
                    at = b
                parts += words[at:]
                kept = b" ".join(parts)
                rows.append((len(words), len(words) - len(parts), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            columns = list(zip(*rows)) or [()] * 4
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns[:3], (pa.int64(), pa.int64(), pa.string())))]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(columns[3], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    found = repeated_spans(docs.select("doc_id", "text"), plan, word_tokens, word_passages, match_parcels)
    return found.mapInArrow(cut_out, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))
