"""Suffix-array dedup: removes every byte covered by a 100-byte string that also starts earlier in the corpus.

A suffix array of a whole corpus fits no machine, so suffixes are dealt to shards by content:

1. Of each 100-byte window the 32-byte gram of smallest hash is an anchor. Equal windows have the same anchor at the same
   place, so they meet under its hash. What surrounds an anchor (every window with it) is its context, of 168 bytes at most.
2. Contexts are named by hash and dealt by anchor, packed. A context that repeats is covered everywhere but at its first
   place; an anchor with one context is done. Only anchors with different contexts go on, one place per context.
3. Shards of such contexts are sorted: suffixes are classified (S, L, leftmost smaller), the leftmost-smaller substrings are
   sorted by inducing and named, the reduced string is sorted by names of ever longer runs of names, and the shard's array is
   induced from it in two linear passes, a character bucket at a time on whole arrays. Permuted common prefixes tell which
   neighbours share 100 bytes; of each such class all but the earliest start are covered.
4. An anchor of more than ``HOT`` places (found on a sample; it decides the way, never a result) would overfill a shard.
   Its contexts are dealt by their own names instead, and the windows of what is left by theirs: equal ones still meet.
   Each batch sends on its first place per name only, as its later places are covered already.
5. The covered spans of a document meet in its row and are cut out.

Defined results: null is an empty text; texts of under 100 bytes keep everything; repeated rows of one document are the
same document and get equal results; rows without doc_id count as one last document; an empty table gives an empty result;
further columns are carried along, columns named like the results are replaced. Nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from specmill.llm import shared

WIDTH, GRAM = 100, 32
BEFORE = WIDTH - GRAM
#: Text bytes whose anchors share a bucket, and context bytes of one shard.
BUCKET_BYTES, SHARD_BYTES = 12 << 20, 2 << 20
#: Places of an anchor whose contexts would fill a shard; share of the rows on which they are counted.
HOT, SAMPLE = SHARD_BYTES // (BEFORE + WIDTH), 1 / 16
#: Added to ``before`` of a place that an earlier one of its batch covers.
_LATE = 128
_PLACE = np.dtype([("anchor", "<u8"), ("pos", "<i4"), ("before", "u1"), ("after", "u1")])


# -- the suffix array of a shard -------------------------------------------------------------------------------------

def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S); ``t`` ends with a unique smallest character."""
    change = np.flatnonzero(t[:-1] != t[1:])
    following = np.searchsorted(change, np.arange(len(t) - 1))
    s = np.ones(len(t), bool)
    s[:-1] = (t[:-1] < t[1:])[change[following]]
    return s


def _put(sa: np.ndarray, at: np.ndarray, t: np.ndarray, suffixes: np.ndarray, step: int) -> None:
    """Appends suffixes, in order, to the front (step 1) or back (step -1) of what their buckets still have free."""
    c = t[suffixes]
    order = np.argsort(c, kind="stable")
    c, suffixes = c[order], suffixes[order]
    count = np.bincount(c, minlength=len(at))
    rank = np.arange(len(c)) - np.repeat(np.cumsum(count) - count, count)
    sa[at[c] + step * rank] = suffixes
    at += step * count


def induce(t: np.ndarray, s: np.ndarray, sigma: int, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones in order: L suffixes forward, then S suffixes backward."""
    count = np.bincount(t, minlength=sigma)
    ends = np.cumsum(count)
    starts = ends - count
    sa = np.full(len(t), -1, np.int32)
    tail = ends - 1
    _put(sa, tail, t, lms[::-1], -1)
    lms_from = tail + 1
    head = starts.copy()
    for c in np.flatnonzero(count):
        done = starts[c]
        while done < head[c]:  # a run of one character induces within its own bucket, round by round
            upto = head[c]
            before = sa[done:upto] - 1
            before = before[before >= 0]
            _put(sa, head, t, before[~s[before]], 1)
            done = upto
        before = sa[lms_from[c]:ends[c]] - 1
        before = before[before >= 0]
        _put(sa, head, t, before[~s[before]], 1)
    tail = ends - 1
    for c in np.flatnonzero(count)[::-1]:
        done = ends[c] - 1
        while done > tail[c]:
            upto = tail[c]
            before = sa[upto + 1:done + 1][::-1] - 1
            before = before[before >= 0]
            _put(sa, tail, t, before[s[before]], -1)
            done = upto
        before = sa[starts[c]:head[c]][::-1] - 1
        before = before[before >= 0]
        _put(sa, tail, t, before[s[before]], -1)
        if c == t[-1]:
            sa[starts[c]] = len(t) - 1
    return sa


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names: runs of names are named again, twice as long each time, where still equal."""
    n = len(names)
    rank = names.astype(np.int64)
    length = 1
    open_ = np.arange(n)
    while True:
        counts = np.bincount(rank, minlength=n)
        open_ = open_[counts[rank[open_]] > 1]
        if not len(open_):
            return np.argsort(rank, kind="stable")
        if length == 1:  # ranks are the number of smaller names
            below = np.cumsum(counts) - counts
            rank = below[rank]
        after = np.full(len(open_), -1, np.int64)
        inside = open_ + length < n
        after[inside] = rank[open_[inside] + length]
        order = np.lexsort((after, rank[open_]))
        who, r, a = open_[order], rank[open_][order], after[order]
        new_group = np.concatenate([[True], r[1:] != r[:-1]])
        fresh = new_group | np.concatenate([[True], a[1:] != a[:-1]])
        place = np.arange(len(who))
        group_at = np.maximum.accumulate(np.where(new_group, place, 0))
        fresh_at = np.maximum.accumulate(np.where(fresh, place, 0))
        rank[who] = r + fresh_at - group_at
        length *= 2


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array by induced sorting; ``t`` holds characters below ``sigma`` and ends with a unique 0."""
    s = classify(t)
    lms = np.flatnonzero(s & ~np.concatenate([[True], s[:-1]])).astype(np.int32)
    if not len(lms):
        return induce(t, s, sigma, lms)
    sa = induce(t, s, sigma, lms)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    by_substring = sa[is_lms[sa]]
    number = np.zeros(len(t), np.int64)
    number[lms] = np.arange(len(lms))
    end = np.append(lms[1:] + 1, len(t))[number[by_substring]]
    named = _span_hashes(t).of(by_substring.astype(np.int64), end.astype(np.int64))
    names = np.empty(len(lms), np.int64)
    names[number[by_substring]] = np.cumsum(np.concatenate([[0], named[1:] != named[:-1]]))
    return induce(t, s, sigma, lms[_sorted_names(names)])


def _span_hashes(t: np.ndarray) -> shared.Spans:
    """Spans of characters below 257: the 257th is told apart by its place value."""
    spans = shared.Spans(np.minimum(t, 255).astype(np.uint8))
    if len(t) and int(t.max()) > 255:
        high = np.cumsum((t > 255).astype(np.uint64) * shared.mixed(np.uint64(977) + np.zeros(1, np.uint64))[0] * shared.powers(shared._BASE, len(t)), dtype=np.uint64)
        spans.sums[1:] += high
    return spans


def covered_windows(texts: list[bytes], doc: np.ndarray, start: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each context the starts (within it) of windows that also start earlier; ``start`` is its place in document ``doc``."""
    size = np.array([len(x) for x in texts])
    first = np.cumsum(size + 1) - size - 1
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    t = raw.astype(np.int32) + 2
    t[first + size] = 1  # between contexts
    t = np.append(t, 0)
    sa = suffix_array(t, 258)
    owner = np.repeat(np.arange(len(texts)), size + 1)
    whole = np.arange(len(raw)) + WIDTH <= (first + size)[owner]
    sa = sa[sa < len(raw)]
    sa = sa[whole[sa]].astype(np.int64)
    if not len(sa):
        return []
    # permuted common prefixes as far as they matter: in text order, whether a suffix shares WIDTH bytes with the one before it
    window = shared.Spans(raw)
    before = np.full(len(raw), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    places = np.flatnonzero(before >= 0)
    plcp = np.zeros(len(raw), bool)
    plcp[places] = window.of(places, places + WIDTH) == window.of(before[places], before[places] + WIDTH)
    new = ~plcp[sa]
    _, doc_rank = np.unique(doc, return_inverse=True)
    key = (doc_rank[owner[sa]].astype(np.int64) << 32) + start[owner[sa]] + sa - first[owner[sa]]
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(key, np.flatnonzero(new))
    late = np.sort(sa[key > least[group]])
    cut = np.flatnonzero(np.diff(owner[late])) + 1 if len(late) else []
    return [(int(owner[p[0]]), p - first[owner[p[0]]]) for p in np.split(late, cut) if len(p)]


# -- anchors and contexts --------------------------------------------------------------------------------------------

def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, shared.Spans]:
    """Places of anchors (in the buffer), their texts' numbers, and span hashes of the buffer."""
    spans = shared.Spans(raw)
    n = len(raw)
    if n < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), spans
    least = (spans.sums[GRAM:] - spans.sums[:-GRAM]) * spans.back[:n - GRAM + 1] * np.uint64(0xFF51AFD7ED558CCD)
    least &= np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(len(least), dtype=np.uint64)
    reach = 1
    while reach * 2 <= BEFORE + 1:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < BEFORE + 1:
        least = np.minimum(least[:reach - BEFORE - 1], least[BEFORE + 1 - reach:])
    step = np.zeros(n + 1, np.int32)  # windows that lie in one text
    long_ = np.flatnonzero(np.diff(offsets) >= WIDTH)
    np.add.at(step, offsets[long_], 1)
    np.add.at(step, offsets[long_ + 1] - WIDTH + 1, -1)
    inside = np.cumsum(step[:len(least)]) > 0
    at = least[inside] & np.uint64(0xFFFFFFFF)
    at = np.unique(at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at).astype(np.int64)
    return at, np.searchsorted(offsets, at, side="right") - 1, spans


def _packed_rows(bucket: np.ndarray, columns: dict[str, np.ndarray], extra=None) -> dict[str, list]:
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], {k: v[order] for k, v in columns.items()}
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    out = {"bucket": [int(bucket[s]) for s in edge]} | {k: [] for k in columns}
    for s, e in zip(edge, [*edge[1:], len(bucket)], strict=len(bucket) > 0):
        for k, v in columns.items():
            out[k].append(v[s:e].tobytes())
    return out


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(shared.row_key(doc_id, text).alias("k"), F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("doc"), F.col(text).alias("text"))


def hot_anchors(docs: DataFrame) -> np.ndarray:
    """Hashes, sorted, of the anchors that have more than ``HOT`` places by a sample; at most as many as places / HOT."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.by_bytes(batches, 0):
            at, _, spans = anchors(*shared.text_bytes(b.column(0)))
            anchor, n = np.unique(spans.of(at, at + GRAM), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shared.signed(anchor)), pa.array(n.astype(np.int64))], names=["anchor", "n"])
    counted = docs.sample(SAMPLE, seed=7) if SAMPLE < 1 else docs
    counted = counted.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") > HOT * SAMPLE).select("anchor").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def _among(x: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``listed``."""
    return listed[np.minimum(np.searchsorted(listed, x), len(listed) - 1)] == x if len(listed) else np.zeros(len(x), bool)


def _later(name: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which places have an earlier one of the same name; a repeated row of the first document is no later place."""
    order = np.lexsort((pos, doc, name))
    name, doc, pos = name[order], doc[order], pos[order]
    new = np.concatenate([[True], name[1:] != name[:-1]]) if len(name) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(name)), 0))
    out = np.zeros(len(name), bool)
    out[order] = (doc != doc[head]) | (pos != pos[head])
    return out


def _once(*columns: np.ndarray) -> np.ndarray:
    """True for one of all equal places: repeated rows send theirs on once a batch."""
    order = np.lexsort(columns)
    out = np.ones(len(order), bool)
    out[order[1:]] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    return out


def anchored(docs: DataFrame, buckets: int, hot) -> DataFrame:
    """Anchors by bucket, packed: anchor, context name, row key, document, place, reach to either side.

    ``hot`` (broadcast) are the anchors whose contexts are dealt by name; what is late already is dealt by row.
    """
    names = ("anchor", "ctx", "k", "doc", "pos", "before", "after")
    schema = pa.schema([("bucket", pa.int64())] + [(c, pa.binary()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.by_bytes(batches, 2):
            raw, offsets = shared.text_bytes(b.column(2))
            at, which, spans = anchors(raw, offsets)
            before = np.minimum(at - offsets[which], BEFORE)
            after = np.minimum(offsets[which + 1] - at, WIDTH)
            anchor = spans.of(at, at + GRAM)
            ctx = shared.mixed(spans.of(at - before, at + after) + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            k, doc, pos = shared.longs(b.column(0))[which], shared.longs(b.column(1))[which], at - offsets[which]
            many = np.flatnonzero(_among(anchor, hot.value))
            use = np.ones(len(at), bool)
            use[many] = _once(ctx[many], k[many], pos[many])
            anchor, ctx, k, doc, pos, before, after = (x[use] for x in (anchor, ctx, k, doc, pos, before, after))
            dealt, many = anchor.copy(), np.flatnonzero(_among(anchor, hot.value))
            late = many[_later(ctx[many], doc[many], pos[many])]
            dealt[many] = ctx[many]
            dealt[late] = shared.mixed(k[late].view(np.uint64))
            before[late] += _LATE
            yield pa.RecordBatch.from_pydict(_packed_rows(_bucket(dealt, buckets), {
                "anchor": anchor, "ctx": ctx, "k": k, "doc": doc,
                "pos": pos.astype(np.int32), "before": before.astype(np.uint8), "after": after.astype(np.uint8)}), schema=schema)
    return docs.mapInArrow(run, "bucket long, anchor binary, ctx binary, k binary, doc binary, pos binary, before binary, after binary")


_FOUND = pa.schema([("k", pa.int64()), ("cover", pa.binary()), ("ask", pa.binary()), ("asked", pa.int64())])


def _by_row(k_cover: np.ndarray, spans: np.ndarray, k_ask: np.ndarray, asks: np.ndarray) -> pa.Table:
    """One row per row key: its covered spans (pairs of int32) and the places whose contexts are wanted."""
    oc, oa = np.argsort(k_cover, kind="stable"), np.argsort(k_ask, kind="stable")
    k_cover, spans, k_ask, asks = k_cover[oc], np.ascontiguousarray(spans[oc], np.int32), k_ask[oa], asks[oa]
    keys = np.union1d(k_cover, k_ask)
    cs, ce = np.searchsorted(k_cover, keys), np.searchsorted(k_cover, keys, side="right")
    s, e = np.searchsorted(k_ask, keys), np.searchsorted(k_ask, keys, side="right")
    return pa.table({"k": pa.array(keys.astype(np.int64)), "cover": pa.array([spans[a:b].tobytes() for a, b in zip(cs, ce, strict=True)], pa.binary()),
                     "ask": pa.array([asks[a:b].tobytes() for a, b in zip(s, e, strict=True)], pa.binary()), "asked": pa.array((e - s).astype(np.int64))}, schema=_FOUND)


def _joined(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)


def repeated(rows: DataFrame, hot) -> DataFrame:
    """k, cover, ask, asked: spans of repeated contexts, and one place per context of anchors that have several or are hot."""
    def run(t: pa.Table) -> pa.Table:
        anchor, ctx = _joined(t, "anchor", np.uint64), _joined(t, "ctx", np.uint64)
        sure = np.flatnonzero(_joined(t, "before", np.uint8) >= _LATE)
        k_sure, pos, after = (_joined(t, c, d)[sure] for c, d in (("k", np.int64), ("pos", np.int32), ("after", np.uint8)))
        sure_spans = np.stack([pos - (_joined(t, "before", np.uint8)[sure] - _LATE), pos + after], 1)
        order = np.argsort(anchor, kind="stable")
        order = order[_joined(t, "before", np.uint8)[order] < _LATE]
        same = anchor[order][1:] == anchor[order][:-1]
        if len(order):  # anchors that occur once are done, except if their other contexts are elsewhere
            order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]]) | _among(anchor[order], hot.value)]
        k, doc, pos = (_joined(t, c, d)[order] for c, d in (("k", np.int64), ("doc", np.int64), ("pos", np.int32)))
        before, after = _joined(t, "before", np.uint8)[order], _joined(t, "after", np.uint8)[order]
        anchor, ctx = anchor[order], ctx[order]
        order = np.lexsort((pos, doc, ctx, anchor))
        k, doc, pos, before, after, anchor, ctx = (x[order] for x in (k, doc, pos, before, after, anchor, ctx))
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, bool)
        new_ctx = new_anchor | np.concatenate([[True], ctx[1:] != ctx[:-1]]) if len(anchor) else new_anchor
        group = np.cumsum(new_ctx) - 1
        head = np.flatnonzero(new_ctx)[group] if len(group) else group
        late = (doc != doc[head]) | (pos != pos[head])  # a repeated row of the first document is no later place
        spans = np.stack([pos - before.astype(np.int32), pos + after.astype(np.int32)], 1)[late]
        family = np.cumsum(new_anchor) - 1
        several = np.bincount(family[new_ctx], minlength=family[-1] + 1 if len(family) else 0)[family] > 1 if len(family) else new_ctx
        ask = new_ctx & (several | _among(anchor, hot.value))
        asks = np.zeros(int(ask.sum()), _PLACE)
        for c, v in (("anchor", anchor), ("pos", pos), ("before", before), ("after", after)):
            asks[c] = v[ask]
        return _by_row(np.concatenate([k[late], k_sure]), np.concatenate([spans, sure_spans]), k[ask], asks)
    return rows.groupBy("bucket").applyInArrow(run, "k long, cover binary, ask binary, asked long")


def contexts(asked: DataFrame, shards: int, hot) -> DataFrame:
    """Contexts by shard of their anchor, packed, but those of hot ones. ``asked``: k, doc, text, asks (array of binary)."""
    names = ("anchor", "k", "doc", "start", "size")
    schema = pa.schema([("bucket", pa.int64())] + [(c, pa.binary()) for c in (*names, "bytes")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in shared.by_bytes(batches, 2):
            for s in range(0, whole.num_rows, 500):
                b = whole.slice(s, 500)
                raw, offsets = shared.text_bytes(b.column(2))
                asks = [np.frombuffer(b"".join(x), _PLACE) for x in b.column(3).to_pylist()]
                which = np.repeat(np.arange(len(asks)), [len(x) for x in asks])
                all_ = np.concatenate(asks) if asks else np.zeros(0, _PLACE)
                cold = ~_among(all_["anchor"], hot.value)
                which, all_ = which[cold], all_[cold]
                start = all_["pos"].astype(np.int64) - all_["before"]
                size = all_["before"].astype(np.int64) + all_["after"]
                bucket = _bucket(all_["anchor"], shards)
                order = np.argsort(bucket, kind="stable")
                which, start, size, bucket, anchor = which[order], start[order], size[order], bucket[order], all_["anchor"][order]
                out = _packed_rows(bucket, {"anchor": anchor, "k": shared.longs(b.column(0))[which], "doc": shared.longs(b.column(1))[which], "start": start.astype(np.int64), "size": size.astype(np.int32)})
                ends = np.cumsum(size)
                index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[which] + start - (ends - size), size)
                body = raw[index]
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
                cut = [0, *ends[edge[1:] - 1], len(body)] if len(edge) else [0]
                out["bytes"] = [body[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_pydict(out, schema=schema)
    return asked.select("k", "doc", "text", "asks").mapInArrow(run, "bucket long, anchor binary, k binary, doc binary, start binary, size binary, bytes binary")


def sorted_shards(rows: DataFrame) -> DataFrame:
    """k, cover: spans of windows that a shard's suffix array shows to start earlier too."""
    def run(t: pa.Table) -> pa.Table:
        k, doc, start = _joined(t, "k", np.int64), _joined(t, "doc", np.int64), _joined(t, "start", np.int64)
        ends = np.cumsum(_joined(t, "size", np.int32))
        body = b"".join(t.column("bytes").to_pylist())
        texts = [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        keys, spans = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int32)]
        for i, at in covered_windows(texts, doc, start):
            edge = np.flatnonzero(np.diff(at) > WIDTH) + 1
            first, last = at[np.concatenate([[0], edge])], at[np.concatenate([edge - 1, [len(at) - 1]])]
            spans.append(np.stack([start[i] + first, start[i] + last + WIDTH], 1).astype(np.int32))
            keys.append(np.full(len(first), k[i]))
        return _by_row(np.concatenate(keys), np.concatenate(spans), np.zeros(0, np.int64), np.zeros(0, _PLACE)).select(["k", "cover"])
    return rows.groupBy("bucket").applyInArrow(run, "k long, cover binary")


def hot_windows(asked: DataFrame, buckets: int, hot) -> DataFrame:
    """Windows of the contexts of hot anchors by bucket of their own name, packed; those that are late already by row.

    ``start`` of what is late already is inverted.
    """
    names = ("name", "k", "doc", "start")
    schema = pa.schema([("bucket", pa.int64())] + [(c, pa.binary()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.by_bytes(batches, 2):
            raw, offsets = shared.text_bytes(b.column(2))
            spans, at, known = shared.Spans(raw), [], set()
            for row, (key, asks) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)):
                own = np.frombuffer(b"" if key in known else b"".join(asks), _PLACE)
                known.add(key)
                own = own[_among(own["anchor"], hot.value)]
                first = own["pos"].astype(np.int64) - own["before"]
                count = np.maximum(own["before"].astype(np.int64) + own["after"] - WIDTH + 1, 0)
                ends = np.cumsum(count)
                starts = np.arange(count.sum()) + np.repeat(first - (ends - count), count)
                at.append(np.unique(starts) + offsets[row])
            which = np.repeat(np.arange(len(at)), [len(x) for x in at])
            at = np.concatenate([np.zeros(0, np.int64), *at])
            name, start = spans.of(at, at + WIDTH), at - offsets[which]
            k, doc = shared.longs(b.column(0))[which], shared.longs(b.column(1))[which]
            late = _later(name, doc, start)
            dealt = np.where(late, shared.mixed(k.view(np.uint64)), name)
            yield pa.RecordBatch.from_pydict(_packed_rows(_bucket(dealt, buckets), {"name": name, "k": k, "doc": doc, "start": np.where(late, ~start, start)}), schema=schema)
    return asked.select("k", "doc", "text", "asks").mapInArrow(run, "bucket long, name binary, k binary, doc binary, start binary")


def met_windows(rows: DataFrame) -> DataFrame:
    """k, cover: spans of windows of hot anchors that also start earlier."""
    def run(t: pa.Table) -> pa.Table:
        name, k, doc, start = _joined(t, "name", np.uint64), _joined(t, "k", np.int64), _joined(t, "doc", np.int64), _joined(t, "start", np.int64)
        late, open_ = start < 0, np.flatnonzero(start >= 0)
        late[open_[_later(name[open_], doc[open_], start[open_])]] = True
        k, start = k[late], np.where(start < 0, ~start, start)[late]
        order = np.lexsort((start, k))
        k, start = k[order], start[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (np.diff(start) > WIDTH)]) if len(k) else np.zeros(0, bool)
        last = np.concatenate([new[1:], [True]]) if len(k) else new
        return _by_row(k[new], np.stack([start[new], start[last] + WIDTH], 1), np.zeros(0, np.int64), np.zeros(0, _PLACE)).select(["k", "cover"])
    return rows.groupBy("bucket").applyInArrow(run, "k long, cover binary")


@shared.apart("doc_id", "text")
def annotate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte runs), and ``kept`` (bytes) on demand."""
    spark = docs.sparkSession
    folder = shared.shared_folder(spark)
    keyed = _keyed(docs, doc_id, text)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    hot = spark.sparkContext.broadcast(hot_anchors(keyed))
    found = shared.written(repeated(anchored(keyed, max(16, -(-total // BUCKET_BYTES)), hot), hot), folder, "found")
    asks = found.where("asked > 0").groupBy("k").agg(F.collect_list("ask").alias("asks"))
    wanted = (found.agg(F.sum("asked")).first()[0] or 0) * (BEFORE + WIDTH)
    asked = keyed.join(asks, "k")
    more = shared.written(sorted_shards(contexts(asked, max(16, -(-wanted // SHARD_BYTES)), hot)), folder, "sorted")
    if len(hot.value):  # a context has up to 69 windows of 32 bytes each here, about 13 times its own size
        more = more.union(shared.written(met_windows(hot_windows(asked, max(16, -(-wanted * 13 // BUCKET_BYTES)), hot)), folder, "windows"))
    covers = found.select("k", "cover").union(more).where(F.length("cover") > 0).groupBy("k").agg(F.collect_list("cover").alias("_cover"))
    dropped = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")
    carried = [c for c in docs.columns if c not in dropped]
    rows = docs.select(*carried, F.col(text).alias("_text"), shared.row_key(doc_id, text).alias("k")).join(covers, "k", "left").drop("k")
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>" + ", kept binary" * keep_text
    kinds = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.by_bytes(batches, len(carried)):
            raw, offsets = shared.text_bytes(b.column(len(carried)))
            out = []
            for i, covers_ in enumerate(b.column(b.schema.get_field_index("_cover")).to_pylist()):
                body = raw[offsets[i]:offsets[i + 1]]
                runs = _merged(np.frombuffer(b"".join(covers_ or []), np.int32).reshape(-1, 2))
                gone = np.zeros(len(body) + 1, np.int32)
                np.add.at(gone, runs[:, 0], 1)
                np.add.at(gone, runs[:, 1], -1)
                kept = body[np.cumsum(gone[:-1]) == 0].tobytes() if len(runs) else body.tobytes()
                out.append((len(body), len(body) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": int(s), "end": int(e)} for s, e in runs], kept))
            cols = [pa.array([o[j] for o in out], kind) for j, (_, kind) in enumerate(kinds)] + [pa.array([o[5] for o in out], pa.binary())] * keep_text
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in carried] + cols, names=[*carried, *[n for n, _ in kinds], *["kept"] * keep_text])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in carried)
    return rows.mapInArrow(cut, f"{schema}, {fields}")


def _merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of the union of spans; runs that touch are one."""
    if not len(spans):
        return spans.astype(np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")].astype(np.int64)
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[first, 0], reach[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(spans) - 1]])]], 1)


def query(spark, sf_dir: str) -> DataFrame:
    rows = annotate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
