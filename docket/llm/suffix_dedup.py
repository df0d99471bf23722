"""Removal of byte strings that occur more than once, by suffix arrays over shards.

A window is a string of ``length`` bytes at some place of some text; every byte of a window that also starts anywhere else
goes.  Windows are found in four steps, none of which compares all shards with all others:

1. *Anchors.*  The anchor of a window is its gram (about a third of it) with the smallest hash, so equal windows have
   equal anchor grams at the same offset.  Neighbouring windows with the same anchor form a context: the bytes from the first of
   them to the end of the last.  One narrow row per context is range-sorted by (gram, context hash), which splits a gram
   however often it occurs.  Contexts next to an equal one are repeated as a whole; one whose gram has no other context holds no repeat.
2. *Shards.*  What is left (different contexts of one gram, one of each) is cut into shards of bounded size and
   fetched from the texts.
3. *Suffix arrays.*  A shard's contexts are sorted by Larsson-Sadakane refinement, Kasai's scan gives the common prefixes,
   and windows that share ``length`` bytes with a neighbour are repeated.
4. *Merge.*  Grams that were cut between shards: every shard hands over each of their distinct windows once, as a
   sorted run of 128-bit digests that binary search cuts into ranges of bounded size; in a range, binary search
   finds the windows of one run in the others.

Any cut of a context or a gram only moves work from step 1 to 3 or from 3 to 4, never changes the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.common import discard, materialise, slices, tidy
from docket.llm.hashing import M1, mix, signed

BLOCK = 1 << 20  # window starts handled at once
SHARD_BYTES = 1 << 20  # context bytes of a shard; its last gram may add as many again
MERGE_ROWS = 100_000  # window digests of a merge range, at most so many on average
#: A window in a run: digest, text, place, whether it still needs an answer.
WINDOW = np.dtype([("f1", "<u8"), ("f2", "<u8"), ("id", "<i8"), ("th", "<i8"), ("s", "<i4"), ("open", "?")])

ANCHORS = "id bigint, th bigint, lo int, hi int, gram bigint, ctx bigint"
SUSPECTS = "id bigint, th bigint, lo int, hi int, shard bigint, known boolean, cut boolean"
CONTEXTS = "shard bigint, id bigint, th bigint, lo int, known boolean, cut boolean, body binary"
FOUND = "id bigint, th bigint, s int, e int, range bigint, run binary"


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without NULLs, and the offsets of its values."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def gram_hashes(body: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from every place, by doubling."""
    part, size, out, done = mix(body.astype(np.uint64) + np.uint64(M1)), 1, None, 0
    while True:
        if gram & size:
            if out is None:
                out = part
            else:
                n = len(out) - size
                out = out[:n] + part[done:done + n] * np.uint64(pow(M1, done, 1 << 64))
            done += size
        if done == gram:
            return mix(out)
        n = len(part) - size
        part, size = part[:n] + part[size:] * np.uint64(pow(M1, size, 1 << 64)), 2 * size


def window_minima(v: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every ``w`` neighbouring values, from prefix and suffix minima of blocks."""
    n = len(v) - w + 1
    grid = np.concatenate([v, np.full(-len(v) % w, np.iinfo(v.dtype).max, dtype=v.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[w - 1:w - 1 + n])


def contexts(body: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple]:
    """(text, first, last, gram hash) of every context: windows first..last of a text with the same anchor; places count in ``body``."""
    low32 = np.uint64(0xFFFFFFFF)
    for s in range(0, len(body) - length + 1, BLOCK):
        part = body[s:s + BLOCK + length - 1]
        h = gram_hashes(part, gram)
        least = window_minima((h & ~low32) | np.arange(len(h), dtype=np.uint64), length - gram + 1)  # ties to the first place
        at = np.arange(s, s + len(least))
        text = np.searchsorted(offsets, at, side="right") - 1
        inside = np.flatnonzero(offsets[text + 1] - at >= length)
        if not len(inside):
            continue
        anchor, text = (least[inside] & low32).astype(np.int64), text[inside]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(text) != 0) | (np.diff(inside) != 1)]))
        last = np.append(new[1:], len(inside)) - 1
        yield text[new], inside[new] + s, inside[last] + s, signed(h[anchor[new]])


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b):
                body, offsets = text_buffer(piece.column("text"))
                view = memoryview(body)
                for text, first, last, h in contexts(body, offsets, length, gram):
                    ctx = np.fromiter((xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(first.tolist(), (last + length).tolist())), np.uint64, len(first))
                    at = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("id").take(at), piece.column("th").take(at), pa.array((first - offsets[text]).astype(np.int32)),
                         pa.array((last - offsets[text]).astype(np.int32)), pa.array(h), pa.array(signed(ctx))], [f.split()[0] for f in ANCHORS.split(", ")])

    return run


class _Shards:
    """Deals the contexts that a task keeps to shards; a gram that is not known to be whole in one shard is marked as cut."""

    def __init__(self, length: int, limit: int):
        self.limit = limit
        self.length, self.base, self.number = length, TaskContext.get().partitionId() << 32, 0
        self.bytes, self.first, self.cut = 0, True, False
        self.gram, self.held, self.held_bytes = None, [], 0

    def _flush(self, cut: bool, out: list) -> None:
        out += [(*r, self.base | self.number, cut) for r in self.held]
        self.bytes += self.held_bytes
        self.held, self.held_bytes = [], 0
        if self.bytes >= self.limit:
            self.number, self.bytes = self.number + 1, 0

    def add(self, gram: int, row: tuple, out: list) -> None:
        if gram != self.gram:
            self.end(out, last=False)
            self.first, self.gram, self.cut = self.gram is None, gram, False
        self.held.append(row)
        self.held_bytes += row[3] - row[2] + self.length
        if self.held_bytes >= self.limit:  # too large for one shard
            self.cut = True
            self._flush(True, out)

    def end(self, out: list, last: bool = True) -> None:
        """The gram is complete, or (``last``) goes on in the next task for all that is known here."""
        self._flush(self.cut or self.first or last, out)


def _suspects(length: int, limit: int):
    """Sorted context rows -> whole repeats (no shard) and contexts whose gram has different ones (shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, held = _Shards(length, limit), None
        earlier_last, seen_last, first_gram = False, False, None

        def out(part: dict, keep: np.ndarray, rows: list) -> pa.RecordBatch:
            whole = {k: v[keep] for k, v in part.items()}
            r = list(zip(*rows)) if rows else [()] * 7
            arrays = [pa.concat_arrays([pa.array(whole[k], t), pa.array(r[i], t)]) for i, (k, t) in enumerate(
                (("id", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())))]
            n = int(keep.sum())
            arrays += [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(r[5], pa.int64())]), pa.concat_arrays([pa.array(np.ones(n, bool)), pa.array(r[4], pa.bool_())]),
                       pa.concat_arrays([pa.array(np.zeros(n, bool)), pa.array(r[6], pa.bool_())])]
            return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SUSPECTS.split(", ")])

        def decide(part: dict, gram_goes_on: bool, ctx_goes_on: bool) -> pa.RecordBatch:
            """``part``: rows from where the last part ended; what follows its last row is told by the flags."""
            nonlocal earlier_last, seen_last, first_gram, held
            gram, ctx = part["gram"], part["ctx"]
            n = len(gram)
            if first_gram is None:
                first_gram = int(gram[0])
            same_gram = np.concatenate([[held is not None and held[0] == gram[0]], gram[1:] == gram[:-1]])
            same = same_gram & np.concatenate([[held is not None and held[1] == ctx[0]], ctx[1:] == ctx[:-1]])
            nxt = np.append(same[1:], ctx_goes_on)
            nxt_gram = np.append(same_gram[1:], gram_goes_on)
            # another context of the gram came before: it holds from the context's first row on
            start = np.maximum.accumulate(np.where(~same, np.arange(n), -1))
            earlier = np.where(start >= 0, same_gram[np.maximum(start, 0)], earlier_last) | (gram == first_gram)
            repeated = same | nxt
            last = ~nxt
            other = last & (earlier | nxt_gram)
            rows: list = []
            at = np.flatnonzero(other)
            for g, *r in zip(gram[at].tolist(), *[part[k][at].tolist() for k in ("id", "th", "lo", "hi")], repeated[at].tolist()):
                shards.add(g, tuple(r), rows)
            earlier_last, held = bool(earlier[-1]), (int(gram[-1]), int(ctx[-1]))
            return out(part, repeated & ~other, rows)

        kept = None
        names = ("id", "th", "lo", "hi", "gram", "ctx")
        for b in batches:
            if not b.num_rows:
                continue
            now = {k: b.column(k).to_numpy(zero_copy_only=False) for k in names}
            if kept is not None:
                goes = kept["gram"][-1] == now["gram"][0]
                yield decide(kept, goes, goes and kept["ctx"][-1] == now["ctx"][0])
            kept = now
        if kept is not None:
            yield decide(kept, True, False)  # the gram may go on in the next task
            rest: list = []
            shards.end(rest)
            empty = {k: np.zeros(0, np.int64) for k in names}
            yield out(empty, np.zeros(0, bool), rest)

    return run


def _fetch(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b):
                body, offsets = text_buffer(piece.column("text"))
                want = piece.column("want")
                sizes = np.diff(np.asarray(want.offsets))
                flat = want.flatten()
                part = dict(zip(("lo", "hi", "shard", "known", "cut"), flat.flatten()))
                at = np.repeat(np.arange(piece.num_rows), sizes)
                lo = part["lo"].to_numpy(zero_copy_only=False) + offsets[at]
                hi = part["hi"].to_numpy(zero_copy_only=False) + offsets[at] + length
                raw, step = body.tobytes(), 2000
                for s in range(0, len(at), step):
                    e = min(s + step, len(at))
                    rows = pa.array(at[s:e])
                    yield pa.RecordBatch.from_arrays(
                        [part["shard"].slice(s, e - s), piece.column("id").take(rows), piece.column("th").take(rows), part["lo"].slice(s, e - s),
                         part["known"].slice(s, e - s), part["cut"].slice(s, e - s),
                         pa.array([raw[x:y] for x, y in zip(lo[s:e].tolist(), hi[s:e].tolist())], pa.binary())], [f.split()[0] for f in CONTEXTS.split(", ")])

    return run


def suffix_array(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of the symbols ``t`` (0..256) by Larsson-Sadakane: only groups that are not yet sorted are refined, their depth doubles."""
    n, h = len(t), 7  # seven symbols of nine bits to begin with
    padded = np.concatenate([t.astype(np.int64) + 1, np.zeros(h, np.int64)])  # the end is smaller than any symbol
    key = np.zeros(n, np.int64)
    for j in range(h):
        key = key << 9 | padded[j:j + n]
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    at = np.arange(n)  # places of the suffix array whose groups are refined next
    key = key[sa]
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(at) else np.zeros(0, bool)
        start = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[sa[at]] = start  # a group's rank is its first place
        alone = new & np.append(new[1:], True)
        at = at[~alone]
        if not len(at):
            return sa, rank
        pos = sa[at]
        ahead = np.where(pos + h < n, rank[np.minimum(pos + h, n - 1)] + 1, 0)
        key = rank[pos] * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        sa[at], key = pos[order], key[order]
        h *= 2


def common_prefixes(t: np.ndarray, sa: np.ndarray, rank: np.ndarray, first: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    """Kasai: for the places first..end-1 of every stretch, the symbols shared with the suffix before in the array, up to
    ``limit``; the stretches advance side by side.  Other places get 0."""
    out = np.zeros(len(t), np.int64)
    before = np.full(len(t), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.append(t, np.full(limit + 1, -1, dtype=np.int64))
    live = first < end
    i, stop, h = first[live].copy(), end[live], np.zeros(int(live.sum()), np.int64)
    while len(i):
        j = before[i]
        grows = (j >= 0) & (h < limit) & (padded[i + h] == padded[j + h])
        h[grows] += 1
        done = ~grows
        out[i[done]] = h[done]
        i[done] += 1
        h[done] = np.maximum(h[done] - 1, 0)
        if (i >= stop).any():
            live = i < stop
            i, stop, h = i[live], stop[live], h[live]
    return out


def repeats(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the given contexts: (context, place in it, repeated among them, class); equal windows share a class."""
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    t = np.frombuffer(b"\0".join(bodies) + b"\0", dtype=np.uint8).astype(np.int64) + 1
    t[first + sizes] = 0  # ends of contexts
    sa, rank = suffix_array(t)
    n_windows = np.maximum(sizes - length + 1, 0)
    shared = common_prefixes(t, sa, rank, first, first + n_windows, length)
    joins = shared[sa] >= length  # with the suffix before
    again = np.empty(len(t), bool)
    again[sa] = joins | np.append(joins[1:], False)
    kind = np.empty(len(t), np.int64)
    kind[sa] = np.cumsum(~joins)
    context = np.repeat(np.arange(len(bodies)), n_windows)
    place = np.arange(len(context)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    where = first[context] + place
    return context, place, again[where], kind[where]


def _sort_shard(length: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        bodies = table.column("body").to_pylist()
        col = {k: table.column(k).to_numpy() for k in ("id", "th", "lo", "known", "cut")}
        context, place, again, kind = repeats(bodies, length)
        at = col["lo"][context] + place
        hit = np.flatnonzero(again & ~col["known"][context])
        new = np.flatnonzero(np.concatenate([[True], (np.diff(context[hit]) != 0) | (np.diff(at[hit]) != 1)])) if len(hit) else hit
        last = np.append(new[1:], len(hit))[:len(new)] - 1
        cut = np.flatnonzero(col["cut"][context])
        cut = cut[np.unique(kind[cut], return_index=True)[1]]  # each distinct window once
        digests = [xxhash.xxh3_128_digest(bodies[c][p:p + length]) for c, p in zip(context[cut].tolist(), place[cut].tolist())]
        mine, windows = context[cut], np.empty(len(cut), WINDOW)
        both = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
        windows["f1"], windows["f2"], windows["id"], windows["th"] = both[:, 0], both[:, 1], col["id"][mine], col["th"][mine]
        windows["s"], windows["open"] = at[cut], ~(again[cut] | col["known"][mine])
        windows = windows[np.lexsort((windows["f2"], windows["f1"]))]
        ranges, runs = _cut_run(windows, bits)
        found, none = context[hit[new]], len(ranges)
        arrays = [pa.concat_arrays([pa.array(x, t), pa.nulls(none, t)]) for x, t in (
            (col["id"][found], pa.int64()), (col["th"][found], pa.int64()), (at[hit[new]], pa.int32()), (at[hit[last]], pa.int32()))]
        arrays += [pa.concat_arrays([pa.nulls(len(new), pa.int64()), pa.array(ranges, pa.int64())]),
                   pa.concat_arrays([pa.nulls(len(new), pa.binary()), pa.array(runs, pa.binary())])]
        return pa.Table.from_arrays(arrays, [x.split()[0] for x in FOUND.split(", ")])

    return run


def _cut_run(windows: np.ndarray, bits: int) -> tuple[list[int], list[bytes]]:
    """A sorted run cut at the borders of the 2^bits ranges of digests: the ranges that it reaches and its parts."""
    if not len(windows):
        return [], []
    reached = np.unique(windows["f1"] >> np.uint64(64 - bits)) if bits else np.zeros(1, np.uint64)
    starts = np.searchsorted(windows["f1"], reached << np.uint64(64 - bits) if bits else reached)
    return reached.astype(np.int64).tolist(), [windows[x:y].tobytes() for x, y in zip(starts, [*starts[1:], len(windows)])]


def _merge(table: pa.Table) -> pa.Table:
    """The runs of a range: windows that binary search finds in the run of another shard (a run holds a window once)."""
    runs = [np.frombuffer(r, WINDOW) for r in table.column("run").to_pylist()]
    merged = np.sort(np.concatenate([r["f1"] for r in runs]))
    twice = np.concatenate([r[np.searchsorted(merged, r["f1"], "right") - np.searchsorted(merged, r["f1"], "left") > 1] for r in runs])
    twice = twice[np.lexsort((twice["f2"], twice["f1"]))]
    same = (twice["f1"][1:] == twice["f1"][:-1]) & (twice["f2"][1:] == twice["f2"][:-1])
    again = twice[(np.append(same, False) | np.concatenate([[False], same]))[:len(twice)] & twice["open"]]
    again = again[np.lexsort((again["s"], again["th"], again["id"]))]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(again["th"]) != 0) | (np.diff(again["id"]) != 0) | (np.diff(again["s"]) != 1)])) if len(again) else np.zeros(0, int)
    last = np.append(new[1:], len(again))[:len(new)] - 1
    return pa.table({"id": again["id"][new], "th": again["th"][new], "s": again["s"][new], "e": again["s"][last]})


def _keep(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("s", pa.int64()), ("e", pa.int64())])
        for b in batches:
            for piece in slices(b):
                body, offsets = text_buffer(piece.column("text"))
                raw, kept, spans = body.tobytes(), [], []
                for k, found in enumerate(piece.column("found").to_pylist()):
                    x, y = int(offsets[k]), int(offsets[k + 1])
                    if not found:
                        kept.append(raw[x:y])
                        spans.append([])
                        continue
                    s, e = (np.array([f[i] for f in found], dtype=np.int64) for i in ("s", "e"))
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order] + length)
                    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                    s, e = s[new], e[np.append(new[1:], len(e)) - 1]
                    edges = [0, *np.stack([s, e], axis=1).reshape(-1).tolist(), y - x]
                    kept.append(b"".join(raw[x + p:x + q] for p, q in zip(edges[::2], edges[1::2])))
                    spans.append([{"s": p, "e": q} for p, q in zip(s.tolist(), e.tolist())])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(offsets)), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
                                                 ["doc_id", "n_bytes", "spans", "kept"])

    return run


def dedup_substrings(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text",
                     shard_bytes: int = SHARD_BYTES, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` per row: the removed byte runs [s, e) and the bytes that stay.

    A byte goes when some ``length``-byte string over it also starts at another place, in the same or another text;
    overlapping places count, and all strings are judged on the input.  Texts are their UTF-8 bytes (a cut may fall inside a character,
    so ``kept`` is binary); strings never reach over the end of a text.  A NULL text counts as empty; empty and short texts lose
    nothing.  Rows with equal ids and texts are different rows, each a copy of the other; NULL ids are kept.  Other columns
    are ignored; an empty table gives an empty result.  Very long texts are handled in blocks and only need to fit into an Arrow batch.
    """
    if length < 1:
        raise ValueError("length must be positive")
    gram = max(1, length * 8 // 25)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("doc_id", "text").alias("th"), "text")
    long = rows.filter(F.octet_length("text") >= length)
    anchors = materialise(long.select("id", "th", "text").mapInArrow(tidy(_anchors(length, gram)), ANCHORS), "anchors")
    order = ["gram", "ctx", "id", "th", "lo"]
    suspects = materialise(anchors.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_suspects(length, shard_bytes), SUSPECTS), "suspects")
    discard(anchors)
    want = suspects.filter("shard IS NOT NULL").groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi", "shard", "known", "cut")).alias("want"))
    bodies = long.select("id", "th", "text").join(want, ["id", "th"]).mapInArrow(tidy(_fetch(length)), CONTEXTS)
    windows = suspects.filter("cut").agg(F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1), F.lit(0))).first()[0]
    bits = min(62, max(0, (windows // merge_rows).bit_length()))
    found = materialise(bodies.groupBy("shard").applyInArrow(_sort_shard(length, bits), FOUND), "repeats")
    merged = found.filter("range IS NOT NULL").groupBy("range").applyInArrow(_merge, "id bigint, th bigint, s int, e int")
    spans = (suspects.filter("known").select("id", "th", F.col("lo").alias("s"), F.col("hi").alias("e"))
             .unionByName(found.filter("range IS NULL").select("id", "th", "s", "e")).unionByName(merged))
    spans = materialise(spans.groupBy("id", "th").agg(F.collect_list(F.struct("s", "e")).alias("found")), "spans")
    discard(suspects, found)
    return rows.join(spans, ["id", "th"], "left").select("doc_id", "text", "found").mapInArrow(
        tidy(_keep(length)), "doc_id bigint, n_bytes bigint, spans array<struct<s:bigint,e:bigint>>, kept binary")
