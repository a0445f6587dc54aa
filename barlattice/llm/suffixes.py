"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

The suffixes that start at repeated anchors are sorted in each task and leave as front-coded runs:
each suffix without the prefix that it shares with the one before it. Where runs of the same grams
meet, a loser tree merges them; it compares common-prefix lengths first and bytes only from there on,
so no known prefix is read twice. The merged order with its prefix lengths tells, for each window
around an anchor, which windows are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .anchors import BYTES, Plan, batch_spots, byte_tokens, columns_hash, full_windows, is_hot, pack, repeated_spans, scramble, span_parcels, unpack
from .common import spread, text_buffer, tidy

SPAN = 50
#: 24 bytes choose the anchor: about 7 anchors in 100 bytes.
PLAN = Plan(SPAN, 24)
#: Suffixes that a task gathers into one sorted run.
RUN = 450_000


def passages(data: np.ndarray, begin: np.ndarray, at: np.ndarray, end: np.ndarray, plan: Plan):
    """The bytes from each anchor on, and those before it, last byte first, padded with zeros; and their lengths."""
    right = np.minimum(plan.span, end - at)
    left = np.minimum(plan.left, at - begin)
    forth = data[np.minimum(at[:, None] + np.arange(plan.span), len(data) - 1)]
    forth[np.arange(plan.span) >= right[:, None]] = 0
    back = data[np.maximum(at[:, None] - 1 - np.arange(plan.left), 0)]
    back[np.arange(plan.left) >= left[:, None]] = 0
    return forth, back, right, left


def as_words(rows: np.ndarray) -> list[np.ndarray]:
    """Columns of big-endian integers whose order is that of the rows' bytes."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return list(padded.view(">u8").astype(np.uint64).T)


def shared(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How long a prefix each row shares with the one before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    return out


def sorted_runs(batches: Iterator[pa.RecordBatch], plan: Plan, buckets: int, hot: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Front-coded runs for each gram bucket (kind 0), and spans settled within the task (kind 1)."""
    held, size = [], 0

    def settle():
        forth, back, right, left, doc, spot = (np.concatenate(c) for c in zip(*held))
        words = as_words(forth) + as_words(back) + [right.astype(np.uint64) * np.uint64(256) + left.astype(np.uint64)]
        mark = np.zeros(len(doc), np.uint64)
        for w in words:
            mark = scramble(mark * np.uint64(3) + w)
        order = np.lexsort((spot, doc, mark))
        fresh = np.r_[True, np.any([w[order][1:] != w[order][:-1] for w in words], axis=0)]
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        least = doc[order][head]
        later = order[doc[order] > least]
        near, far = full_windows(left[later], right[later], plan)
        whole = near <= far
        yield from span_parcels(doc[later][whole], (spot[later] - far)[whole], (spot[later] - near + plan.span)[whole], buckets, 1)
        # A passage stays once, with the places where the first document has it.
        stay = doc[order] == least
        group = (np.cumsum(fresh) - 1)[stay]
        places, counts = spot[order][stay], np.bincount(group)
        first = np.cumsum(counts) - counts
        item = order[fresh]
        keys = [w[item] for w in words]
        sort = np.lexsort([doc[item], *keys[::-1]])
        item, counts, first = item[sort], counts[sort], first[sort]
        gram = columns_hash([BYTES[forth[item, c]] for c in range(plan.gram)])
        warm = is_hot(gram, buckets, hot)
        # A hot gram's passages go by more of what windows hold: those that reach far right, those that reach far left.
        after = np.flatnonzero(warm & (right[item] >= plan.span - plan.half))
        before_ = np.flatnonzero(warm & (left[item] > plan.half))
        far_right = columns_hash([BYTES[forth[item[after], c]] for c in range(plan.span - plan.half)])
        far_left = columns_hash([gram[before_], *(BYTES[back[item[before_], c]] for c in range(plan.half + 1))])
        plain = np.flatnonzero(~warm)
        which = np.concatenate([plain, after, before_])
        role = np.repeat(np.array([0, 1, 2], np.uint8), [len(plain), len(after), len(before_)])
        home = (np.concatenate([gram[plain], far_right, far_left]) % np.uint64(buckets)).astype(np.int64)
        sequence = np.lexsort((role, which, home))
        edges = np.searchsorted(home[sequence], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            chosen = sequence[edges[b] : edges[b + 1]]
            mine = which[chosen]
            rows, r = forth[item[mine]], right[item[mine]]
            known = shared(rows, r)
            column = np.arange(plan.span)
            new = rows[(column >= known[:, None]) & (column < r[:, None])]
            old = back[item[mine]]
            before = old[np.arange(plan.left) < left[item[mine]][:, None]]
            where = places[spread(first[mine], counts[mine])]
            yield 0, int(b), pack(known.astype(np.uint8), r.astype(np.uint8), left[item[mine]].astype(np.uint8), new, before, doc[item[mine]], counts[mine].astype(np.uint32), where.astype(np.uint32), role[chosen])

    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        ids, owners, spots = batch_spots(batch)
        for a in range(0, len(owners), RUN):
            o, s = owners[a : a + RUN], spots[a : a + RUN]
            at = offsets[o] + s
            held.append((*passages(data, offsets[o], at, offsets[o + 1], plan), ids[o], s))
            size += len(o)
            if size >= RUN:
                yield from settle()
                held, size = [], 0
    if held:
        yield from settle()


def decode_run(known: np.ndarray, right: np.ndarray, new: np.ndarray) -> list[bytes]:
    """The suffixes of a front-coded run."""
    out, before, at, raw = [], b"", 0, new.tobytes()
    for k, n in zip(known.tolist(), right.tolist()):
        before = before[:k] + raw[at : at + n - k]
        at += n - k
        out.append(before)
    return out


def merge(strings: list[list[bytes]], known: list[list[int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs with a loser tree that remembers common prefixes.

    ``known[r][i]`` is the prefix length that string i of run r shares with string i - 1. Returns
    (run, place) in merged order and the prefix length each string shares with the one before it.
    Every player carries the length of its common prefix with the last winner: a longer one wins
    unseen, and equals are compared from that length on.
    """
    count = len(strings)
    at, ends = [0] * count, [len(s) for s in strings]
    lcp = [0 if e else -1 for e in ends]
    now: list[bytes | None] = [s[0] if s else None for s in strings]

    def play(r: int, s: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows its common prefix with the winner."""
        x, y = lcp[r], lcp[s]
        if x != y:
            return (r, s) if x > y else (s, r)
        if x < 0:
            return r, s
        a, b = now[r], now[s]
        if a == b:
            first, second = (r, s) if r < s else (s, r)
            lcp[second] = len(a)
            return first, second
        top = min(len(a), len(b))
        while x < top and a[x] == b[x]:
            x += 1
        if x == top:
            smaller = len(a) < len(b)
        else:
            smaller = a[x] < b[x]
        if smaller:
            lcp[s] = x
            return r, s
        lcp[r] = x
        return s, r

    if count == 1:
        return [(0, i) for i in range(ends[0])], list(known[0])
    losers = [0] * count
    winners = [0] * count + list(range(count))
    for node in range(count - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    order: list[tuple[int, int]] = []
    lengths: list[int] = []
    while lcp[best] >= 0:
        i = at[best]
        order.append((best, i))
        lengths.append(lcp[best])
        i += 1
        at[best] = i
        if i < ends[best]:
            now[best] = strings[best][i]
            lcp[best] = known[best][i]
        else:
            now[best] = None
            lcp[best] = -1
        node = (best + count) >> 1
        while node:
            s = losers[node]
            x, y = lcp[best], lcp[s]
            if x < y:
                losers[node], best = best, s
            elif x == y and x >= 0:
                best, losers[node] = play(best, s)
            node >>= 1
    return order, lengths


def equal_windows(known: np.ndarray, right: np.ndarray, back: np.ndarray, left: np.ndarray, doc: np.ndarray, role: np.ndarray, plan: Plan) -> np.ndarray:
    """For each suffix in merged order and each distance from window start to anchor: does a smaller doc_id have this window?

    Windows at distance o are equal where suffixes share ``span - o`` bytes, which the merged prefix
    lengths tell, and the o bytes before the anchors are the same, which the same lengths over the
    sorted left sides tell.
    """
    n = len(known)
    order = np.lexsort([left, *as_words(back)[::-1]])
    same_left = shared(back[order], left[order])
    by_doc = np.argsort(doc, kind="stable")
    repeated = np.zeros((n, plan.left + 1), bool)
    to_left = np.empty(n, np.int64)
    for o in range(plan.left + 1):
        need = plan.span - o
        to_right = np.cumsum(known < need)
        to_left[order] = np.cumsum(same_left < o)
        key = to_right * (n + 1) + to_left
        asked = (role[by_doc] == 0) | (role[by_doc] == (1 if o <= plan.half else 2))
        fits = by_doc[(left[by_doc] >= o) & (right[by_doc] >= need) & asked]
        sort = fits[np.argsort(key[fits], kind="stable")]
        if not len(sort):
            continue
        k = key[sort]
        head = np.maximum.accumulate(np.where(np.r_[True, k[1:] != k[:-1]], np.arange(len(sort)), 0))
        repeated[sort, o] = doc[sort] > doc[sort][head]
    return repeated


def merge_parcels(blobs: list[bytes], plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc_id, start, end) of the windows of one gram bucket that a smaller doc_id has too."""
    runs_of = [unpack(b) for b in blobs]
    order, lengths = merge([decode_run(x[0], x[1], x[3]) for x in runs_of], [x[0].tolist() for x in runs_of])
    base = np.cumsum([0] + [len(x[0]) for x in runs_of])
    pair = np.array(order, np.int64).reshape(-1, 2)
    place = base[pair[:, 0]] + pair[:, 1]
    known = np.array(lengths, np.int64)
    # Suffixes that share a gram with none beside them repeat nothing.
    close = known >= plan.gram
    use = np.flatnonzero(close | np.r_[close[1:], False])
    empty = np.zeros(0, np.int64)
    if not len(use):
        return empty, empty, empty
    known = np.where(close[use], known[use], 0)
    right, left, doc, counts = (np.concatenate([x[i] for x in runs_of]).astype(np.int64) for i in (1, 2, 5, 6))
    before, where = (np.concatenate([x[i] for x in runs_of]) for i in (4, 7))
    role = np.concatenate([x[8] for x in runs_of])
    begin, first = np.cumsum(left) - left, np.cumsum(counts) - counts
    place = place[use]
    back = np.zeros((len(place), plan.left), np.uint8)
    back[np.arange(plan.left) < left[place][:, None]] = before[spread(begin[place], left[place])]
    found = equal_windows(known, right[place], back, left[place], doc[place], role[place], plan)
    edge = np.zeros((len(place), 1), bool)
    step = np.diff(np.concatenate([edge, found, edge], axis=1).astype(np.int8), axis=1)
    row, near = np.nonzero(step == 1)
    far = np.nonzero(step == -1)[1] - 1
    item = place[row]
    times = counts[item]
    spot = where[spread(first[item], times)].astype(np.int64)
    near, far, owner = np.repeat(near, times), np.repeat(far, times), np.repeat(doc[item], times)
    return owner, spot - far, spot - near + plan.span


def removed_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, text, ``__spans`` (the byte spans to remove) and a carried ``__row``."""
    plan = PLAN if span == SPAN else Plan(span, max(1, span // 2))
    return repeated_spans(docs, plan, byte_tokens, sorted_runs, merge_parcels)


def kept_parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """Length, number of spans and what stays of each text of a batch (doc_id, text, spans)."""
    data, offsets = text_buffer(batch.column(1))
    marks, edges = text_buffer(batch.column(2))
    raw = marks.tobytes()
    for i in range(batch.num_rows):
        text = data[offsets[i] : offsets[i + 1]]
        spans = np.frombuffer(raw[edges[i] : edges[i + 1]], "<u4").reshape(-1, 2).tolist()
        parts, at = [], 0
        for a, b in spans:
            parts.append(text[at:a].tobytes())
            at = b
        parts.append(text[at:].tobytes())
        yield len(text), len(spans), b"".join(parts)


def deduplicate(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Remove each byte covered by a ``span``-byte string that also starts in a document of a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256. Strings are
    judged on the input and overlap freely. Null and empty texts have no bytes; texts shorter than
    ``span`` stay whole. A row with a null doc_id is not compared and stays whole. doc_id is taken as
    a key: repeated rows hold the same text, so none has a smaller doc_id, and all stay or lose
    alike. Empty tables give empty results.
    """

    @tidy
    def digest(batches):
        for batch in batches:
            rows = [(n, n - len(kept), spans, hashlib.sha256(kept).hexdigest()) for n, spans, kept in kept_parts(batch)]
            columns = list(zip(*rows)) or [()] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed_spans(docs.select("doc_id", "text"), span).mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``docs``, all columns, with repeated strings cut out of ``text``.

    Documents that lose everything stay, with an empty text; a null text becomes an empty one. A cut
    inside a character leaves bytes that are no UTF-8; these are dropped from the text.
    """
    rest = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("__row")
    inputs = docs.select("doc_id", "text", row)

    @tidy
    def texts(batches):
        for batch in batches:
            kept = [x.decode("utf-8", "ignore") for _, _, x in kept_parts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), batch.column(3)], names=["text", "__row"])

    schema = StructType([StructField("text", StringType()), StructField("__row", inputs.schema["__row"].dataType)])
    out = removed_spans(inputs, span).mapInArrow(texts, schema)
    return out.select(*[F.col("text") if c == "text" else F.col("__row")[f"c{rest.index(c)}"].alias(c) for c in docs.columns])
