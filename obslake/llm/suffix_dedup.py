"""Suffix-array dedup: maximal repeats of a corpus of byte strings.

Each byte covered by a `length`-byte string that also starts in a document with a
smaller id is removed.  Matches never cross documents; strings are judged on the
input.

Method.  The windows of `length` bytes are cut into segments, runs of consecutive
windows with one minimizer (the least hash of the 16-byte grams inside).  Equal
windows have equal minimizers, so all occurrences of a repeat meet in the bucket
of their minimizer, where the segments' suffixes stand in an enhanced suffix array:
sorted, with the common prefixes of neighbours.  A stack scan finds the common-prefix
intervals whose suffixes have unequal left extensions: the maximal repeats, each with
all its occurrences.  A repeat is removed from every occurrence in a document after
the first one.

1. Each block tells its minimizers, one entry each: how many distinct segments it
   has of it, and the hash of one.  Their bucket knows then whether a minimizer has
   one segment only (its array is that segment, its one interval the whole of it),
   several, or more than `hot` of them.
2. Blocks send their segments to the bucket of the minimizer: a segment that stands
   for several equal ones goes once a block and weighs as many as it stands for.  The
   bytes go with it only where a minimizer has unequal segments to be sorted.
3. A hot minimizer (the edges of a passage that very many documents share) is split by
   the first `length` bytes of its suffixes: each window is a segment of its own, in
   the bucket of its own hash, sent once a block.  So no bucket gathers more than `hot`
   segments of a minimizer, or an entry a block of a window.
4. The bucket answers each block with the spans of its segments that repeat.

Segments are named by two 64-bit hashes of the minimizer and of their bytes, 96 bits
of them between blocks; unequal segments are compared byte by byte.

Edge cases: null text is empty; texts under `length` bytes lose nothing; very long
texts are read whole, in a block of their own size; rows with one id count as one
document for "smaller id", and each gets a row of its own, so that equal rows with
one id all keep their bytes; extra columns pass through; a result column replaces an
input column of its name; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import blocks as B
from .common import extended, none_of, sha256, with_columns
from .substring_dedup import _first_of
from .text import _R, BYTE, chunks, column_bytes, mix, powers

GRAM = 16
DIVERSE = -1
HOT = 4096
SCANNED = 1 << 16
SEGMENT = np.dtype([("v", "<u8"), ("s", "<u8"), ("doc", "<u4"), ("run", "<u4"), ("size", "u1"), ("at", "u1"), ("how", "u1")])
#: how an item was sent: its bytes are there; other documents of its block have it too; it is a window of a hot minimizer
TEXT, OTHERS, WINDOW = 1, 2, 4
#: what an answer is about: the earliest document of the block that has the segment; the later ones; a window
FIRST, LATER, HOT_WINDOW = 0, 1, 2
CUT = np.dtype([("run", "<u4"), ("first", "u1"), ("last", "u1"), ("kind", "u1")])
OCCURS = np.dtype([("group", "<u8"), ("run", "<u4"), ("at", "u1"), ("size", "u1"), ("kind", "u1")])


class Runs:
    """Segments of a block: first byte, number of windows, minimizer, hash of the bytes, document."""

    def __init__(self, buf, offsets, doc_of_row, length):
        wide = length - GRAM + 1
        parts = [[], [], [], [], []]
        for a, b in chunks(offsets):
            lo, hi = offsets[a], offsets[b]
            if hi - lo < length:
                continue
            x = buf[lo:hi]
            total = np.zeros(len(x) + 1, np.uint64)
            up, down = powers(_R, len(x) + 1)
            np.cumsum(BYTE[x] * up[:-1], out=total[1:])
            least = mix((total[GRAM:] - total[:-GRAM]) * down[: len(x) - GRAM + 1])
            have = 1
            while have * 2 <= wide:
                least = np.minimum(least[:-have], least[have:])
                have *= 2
            if have < wide:
                least = np.minimum(least[: len(least) - (wide - have)], least[wide - have :])
            size = np.diff(offsets[a : b + 1])
            ends = np.repeat(offsets[a + 1 : b + 1] - lo, size)
            at = np.flatnonzero(np.arange(len(least)) + length <= ends[: len(least)])
            if not len(at):
                continue
            m = least[at]
            new = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)]))
            count = np.diff(np.concatenate([new, [len(at)]]))
            pieces = -(-count // wide)
            piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.repeat(at[new], pieces) + piece * wide
            n = np.minimum(np.repeat(count, pieces) - piece * wide, wide)
            span = n + length - 1
            row = np.searchsorted(offsets[a : b + 1] - lo, start, "right") - 1 + a
            for p, y in zip(parts, (start + lo, n, np.repeat(m[new], pieces), mix((total[start + span] - total[start]) * down[start] + span.astype(np.uint64)), doc_of_row[row])):
                p.append(y)
        cat = lambda p, t: np.concatenate(p) if p else np.zeros(0, t)
        self.start, self.n, self.value, self.hash, self.doc = (cat(p, t) for p, t in zip(parts, (np.int64, np.int64, np.uint64, np.uint64, np.int64)))
        self.first, self.number, self.counts = _first_of(mix(self.value ^ (self.hash << np.uint64(1))))
        self.home = self.doc[self.first]  # of each distinct segment: the first document that has it
        self.others = np.zeros(len(self.first), bool)
        self.others[self.number[self.doc > self.home[self.number]]] = True


def _window_hashes(texts: np.ndarray, length: int):
    """Two hashes of each window of `length` bytes of the rows of a byte matrix."""
    up, down = powers(_R, texts.shape[1] + 1)
    total = np.zeros((len(texts), texts.shape[1] + 1), np.uint64)
    np.cumsum(BYTE[texts] * up[:-1], axis=1, out=total[:, 1:])
    one = (total[:, length:] - total[:, :-length]) * down[: texts.shape[1] - length + 1]
    return mix(one + np.uint64(length)), mix(one ^ np.uint64(0xA24BAED4963EE407))


def _by_value(value: np.ndarray):
    """The distinct minimizers of a block's segments: values, the minimizer of each segment, and their numbers of segments."""
    return np.unique(value, return_inverse=True, return_counts=True)


def maximal_repeats(common, left):
    """Stack scan of an enhanced suffix array.

    common[i]: length of the common prefix of suffixes i-1 and i (0 if under the least length; common[0] = 0);
    left[i]: the byte before suffix i, DIVERSE at the start of a segment.  Returns [(length, first, last + 1)] of
    the intervals whose left extensions differ.
    """
    out, stack = [], []
    for i in range(1, len(common) + 1):
        now = common[i] if i < len(common) else 0
        first, code = i - 1, left[i - 1]
        while stack and stack[-1][0] > now:
            size, first, c = stack.pop()
            code = c if c == code else DIVERSE
            if code == DIVERSE:
                out.append((size, first, i))
        if now:
            if stack and stack[-1][0] == now:
                if stack[-1][2] != code:
                    stack[-1][2] = DIVERSE
            else:
                stack.append([now, first, code])
    return out


def repeats_of(texts: np.ndarray, sizes: np.ndarray, length: int):
    """Maximal repeats of at least `length` bytes among distinct segments (rows of a byte matrix, padded with 0).

    Returns (size, group) a repeat and (group, segment, offset) an occurrence, as arrays.
    """
    n, width = texts.shape
    windows = sizes.astype(np.int64) - length + 1
    seg = np.repeat(np.arange(n), windows)
    off = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    padded = np.zeros((n, 2 * width), np.uint8)
    padded[:, :width] = texts
    flat = padded.reshape(-1)
    suffixes = np.lib.stride_tricks.sliding_window_view(flat, width)
    rows = np.ascontiguousarray(suffixes[seg * 2 * width + off])
    order = np.argsort(rows.view(f"S{width}").reshape(-1), kind="stable")
    rows, seg, off = rows[order], seg[order], off[order]
    common = np.zeros(len(rows), np.int64)
    left_of = np.where(off > 0, flat[np.maximum(seg * 2 * width + off - 1, 0)].astype(np.int64), DIVERSE)
    for a in range(1, len(rows), 1 << 16):
        z = min(len(rows), a + (1 << 16))
        differ = rows[a:z] != rows[a - 1 : z - 1]
        common[a:z] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    room = sizes[seg] - off
    common[1:] = np.minimum(common[1:], np.minimum(room[1:], room[:-1]))
    common[common < length] = 0
    near = np.flatnonzero((common > 0) | np.concatenate([common[1:] > 0, [False]]))  # the others are alone
    seg, off = seg[near], off[near]
    found = maximal_repeats(common[near].tolist(), left_of[near].tolist())
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    size, first, last = np.array(found, np.int64).T
    many = last - first
    group = np.repeat(np.arange(len(size)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    return size, group, seg[at], off[at]


def _expand(first, counts):
    """first[i], first[i]+1, ... counts[i] of each, end to end."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)


def _groups_of(items: np.ndarray, texts: np.ndarray, length: int):
    """The distinct segments of a bucket and their maximal repeats.

    Returns (first item, number of each item, and for the repeats among unequal segments: hash of the bytes, size; group, segment, offset of each occurrence).
    A minimizer with one segment has one repeat, the whole of it, which needs no sorting.
    """
    first, number, _ = _first_of(mix(items["v"] ^ (items["s"] << np.uint64(1))))
    with_text = np.flatnonzero(items["how"] & TEXT)
    row = np.full(len(first), -1, np.int64)
    row[number[with_text]] = np.arange(len(with_text))
    sorted_ = np.flatnonzero(row >= 0)
    sorted_ = sorted_[np.argsort(items["v"][first[sorted_]], kind="stable")]
    sizes = items["size"][first[sorted_]].astype(np.int64)
    ends, parts, groups, a = np.cumsum(sizes - length + 1), [], 0, 0
    v = items["v"][first[sorted_]]
    while a < len(sorted_):  # whole minimizers, about SCANNED suffixes at a time
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SCANNED)))
        z = int(np.searchsorted(v, v[min(z, len(v)) - 1], "right"))
        size, group, seg, off = repeats_of(texts[row[sorted_[a:z]]], sizes[a:z], length)
        total = np.zeros((z - a, texts.shape[1] + 1), np.uint64)
        up, down = powers(_R, texts.shape[1] + 1)
        np.cumsum(BYTE[texts[row[sorted_[a:z]]]] * up[:-1], axis=1, out=total[:, 1:])
        lead = np.searchsorted(group, np.arange(len(size)))
        i, o = seg[lead], off[lead]
        names = mix((total[i, o + size] - total[i, o]) * down[o] + size.astype(np.uint64))
        parts.append((names, size, group + groups, sorted_[a:z][seg], off))
        groups, a = groups + len(size), z
    none = np.zeros(0, np.int64)
    return first, number, *(np.concatenate(x) if parts else none for x in (zip(*parts) if parts else [()] * 5))


def _exchanged(df: DataFrame, id_col: str, text_col: str, length: int, block_bytes: int | None, hot: int, told_by):
    """The blocks, their runs, and the buckets' answers (told_by: a bucket's items, texts and blocks to packed answers)."""
    if not GRAM < length <= 128:
        raise ValueError(f"length must be over {GRAM} and at most 128 bytes")
    cuts = B.cut_points(df, id_col, text_col, block_bytes)
    n, width = cuts.buckets, 2 * length - GRAM
    blocked = B.dealt(df, id_col, cuts)

    def runs_of(table):
        table = B.ordered(table, id_col, text_col)
        buf, off = column_bytes(table.column(text_col))
        _, doc = np.unique(B.ids_of(table, id_col), return_inverse=True)
        return table, buf, off, Runs(buf, off, doc, length)

    def texts_of(buf, runs, which):
        """The bytes of runs, in rows of one width padded with 0."""
        padded = np.concatenate([buf, np.zeros(width, np.uint8)])
        texts = padded[runs.start[which][:, None] + np.arange(width)] if len(which) else np.zeros((0, width), np.uint8)
        texts[np.arange(width) >= (runs.n[which] + length - 1)[:, None]] = 0
        return texts

    def send_minimizers(table):
        block = table.column(B.BLOCK)[0].as_py()
        runs = runs_of(table)[3]
        values, which, many = _by_value(runs.value[runs.first])
        one = np.zeros(len(values), np.uint64)
        one[which] = runs.hash[runs.first]
        return B.scatter(block, B.bucket_of(values, n), n, B.low48(values), B.low48(one), np.minimum(many, 65535).astype("<u2")).cast(B.ENTRY_ARROW)

    def compare(table):
        """Code 1: the minimizer has one segment, in several blocks. Code 2: it has unequal segments. Code 3: more than `hot` of them."""
        bucket = B.number_of(table, n)
        raw, lens = B.blob(table, "a")
        v, s, counts = B.from48(raw), B.from48(B.blob(table, "b")[0]), lens // 6
        many = np.frombuffer(bytes(B.blob(table, "c")[0]), "<u2").astype(np.int64)
        block = np.repeat(table.column(B.BLOCK).to_numpy(), counts)
        place = _expand(np.zeros(len(counts), np.int64), counts).astype(np.uint32)
        order = np.argsort(v, kind="stable")
        same = v[order][1:] == v[order][:-1]
        hit = order[np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (many[order] > 1)] if len(v) else order
        if not len(hit):
            return B.empty(B.ANSWER_ARROW)
        starts = np.flatnonzero(np.concatenate([[True], v[hit][1:] != v[hit][:-1]]))
        size = np.diff(np.concatenate([starts, [len(hit)]]))
        total = np.add.reduceat(many[hit], starts)
        alike = (np.minimum.reduceat(s[hit], starts) == np.maximum.reduceat(s[hit], starts)) & (total == size)
        code = np.repeat(np.where(alike, 1, np.where(total > hot, 3, 2)), size).astype(np.uint8)
        return B.answers(bucket, block[hit], place[hit], code)

    def send_segments(table, replies):
        if not len(table):
            return B.empty(B.ENTRY_ARROW)
        block = table.column(B.BLOCK)[0].as_py()
        _, buf, _, runs = runs_of(table)
        values, which, _ = _by_value(runs.value[runs.first])
        order, bounds = B.entry_index(values, B.bucket_of(values, n), n)
        at, told = B.answered(replies, order, bounds, {"a": np.uint32, "b": np.uint8})
        code = np.zeros(len(values), np.uint8)
        code[at] = told
        code = code[which]
        sent = np.flatnonzero((code == 1) | (code == 2) | ((code == 0) & runs.others))
        run = runs.first[sent]
        items = np.zeros(len(sent), SEGMENT)
        items["v"], items["s"], items["doc"], items["run"] = runs.value[run], runs.hash[run], runs.doc[run], run
        items["size"], items["how"] = runs.n[run] + length - 1, TEXT * (code[sent] == 2) + OTHERS * runs.others[sent]
        split = np.flatnonzero(code == 3)
        hot_items = np.concatenate([np.zeros(0, SEGMENT), *(windows_of(buf, runs, split[a : a + 4096])[0] for a in range(0, len(split), 4096))])
        if len(hot_items):  # once a block: by its first document
            by = np.lexsort((hot_items["doc"], hot_items["s"], hot_items["v"]))
            hot_items = hot_items[by]
            new = np.concatenate([[True], (hot_items["v"][1:] != hot_items["v"][:-1]) | (hot_items["s"][1:] != hot_items["s"][:-1])])
            last = np.concatenate([np.flatnonzero(new)[1:], [len(hot_items)]]) - 1
            more = (hot_items["doc"][last] > hot_items["doc"][new]) | np.logical_or.reduceat((hot_items["how"] & OTHERS) > 0, np.flatnonzero(new))
            hot_items = hot_items[new]
            hot_items["how"] |= (OTHERS * more).astype(np.uint8)
        every = np.concatenate([items, hot_items])
        parts = [(B.bucket_of(every["v"], n), every), (B.bucket_of(items["v"], n)[code[sent] == 2], texts_of(buf, runs, run[code[sent] == 2]))]
        if len(split):  # which segments were split goes on to the block itself
            parts.append((np.full(len(split), block % n), runs.first[split].astype("<u4")))
        return B.scatter_each(block, n, *parts)

    def windows_of(buf, runs, which):
        """The windows of distinct segments as items of their own, and the segment of each."""
        run = runs.first[which]
        one, two = _window_hashes(texts_of(buf, runs, run), length)
        seg = np.repeat(np.arange(len(which)), runs.n[run])
        at = _expand(np.zeros(len(which), np.int64), runs.n[run])
        items = np.zeros(len(seg), SEGMENT)
        items["v"], items["s"], items["doc"], items["run"] = one[seg, at], two[seg, at], runs.doc[run[seg]], run[seg]
        items["size"], items["at"], items["how"] = length, at, WINDOW
        items["how"] |= (OTHERS * runs.others[which[seg]]).astype(np.uint8)
        return items, which[seg]

    def scan(table):
        bucket = B.number_of(table, n)
        raw, lens = B.blob(table, "a")
        items = np.frombuffer(bytes(raw), SEGMENT)
        texts = np.frombuffer(bytes(B.blob(table, "b")[0]), np.uint8).reshape(-1, width)
        block = np.repeat(table.column(B.BLOCK).to_numpy(), lens // SEGMENT.itemsize)
        out = [told_by(bucket, items, texts, block)] if len(items) else []
        split, lens = B.blob(table, "c")
        if len(split):
            runs = np.frombuffer(bytes(split), "<u4")
            told = B.answers(bucket, np.repeat(table.column(B.BLOCK).to_numpy(), lens // 4), runs)
            out.append(pa.table([told.column(B.BLOCK), told.column("bucket"), pa.nulls(len(told), pa.binary()), pa.nulls(len(told), pa.binary()), told.column("a")], schema=B.ANSWER_ARROW))
        return pa.concat_tables(out) if out else B.empty(B.ANSWER_ARROW)

    told = B.by_bucket(B.per_block(blocked, send_minimizers, B.ENTRY), cuts, compare)
    return blocked, runs_of, windows_of, B.by_bucket(B.with_answers(blocked, told, send_segments, B.ENTRY), cuts, scan)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, block_bytes: int | None = None, digest: bool = False, hot: int = HOT) -> DataFrame:
    """df with n_bytes, n_removed, n_spans, the removed spans ([start, end) in bytes) and the kept bytes; with digest, kept_sha256 in place of those two."""

    def cuts_of(bucket, items, texts, block):
        place = (block.astype(np.int64) << 32) | items["doc"]
        first, number, _, size, group, seg, off = _groups_of(items, texts, length)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, number, place)
        windows = items["size"][first].astype(np.int64) - length + 1
        base = np.cumsum(windows) - windows
        earliest = np.repeat(least, windows)
        if len(size):
            low = np.full(len(size), np.iinfo(np.int64).max)
            np.minimum.at(low, group, least[seg])
            many = size[group] - length + 1
            np.minimum.at(earliest, _expand(base[seg] + off, many), np.repeat(low[group], many))
        many = windows[number]
        gone = earliest[_expand(base[number], many)] < np.repeat(place, many)
        edge = np.cumsum(many) - many  # first window of each entry
        before = np.concatenate([[False], gone[:-1]])
        before[edge] = False
        after = np.concatenate([gone[1:], [False]])
        after[edge[1:] - 1] = False
        up, down = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after)
        owner = np.searchsorted(edge, up, "right") - 1
        cuts = np.zeros(len(up), CUT)
        cuts["run"], cuts["first"], cuts["last"] = items["run"][owner], up - edge[owner] + items["at"][owner], down - edge[owner] + items["at"][owner]
        cuts["kind"] = np.where(items["how"][owner] & WINDOW, HOT_WINDOW, FIRST)
        later = np.flatnonzero((items["how"] & (OTHERS | WINDOW)) == OTHERS)  # in later documents of its block: the whole segment
        rest = np.zeros(len(later), CUT)
        rest["run"], rest["last"], rest["kind"] = items["run"][later], windows[number[later]] - 1, LATER
        return B.answers(bucket, np.concatenate([block[owner], block[later]]), np.concatenate([cuts, rest]))

    blocked, runs_of, windows_of, told = _exchanged(df, id_col, text_col, length, block_bytes, hot, cuts_of)
    if digest:
        out = extended(df.schema, n_bytes="long", n_removed="long", n_spans="long", kept_sha256="string")
    else:
        spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
        out = extended(df.schema, n_bytes="long", n_removed="long", n_spans="long", spans=spans, kept="binary")

    def cut(table, replies):
        if not len(table):
            return none_of(out)
        table, buf, off, runs = runs_of(table)
        delta = np.zeros(len(buf) + 1, np.int64)

        def remove(at, first, last):
            np.add.at(delta, runs.start[at] + first, 1)
            np.add.at(delta, runs.start[at] + last + length, -1)

        cuts = np.frombuffer(bytes(B.blob(replies, "a")[0]), CUT)
        is_home = runs.doc == runs.home[runs.number]
        for kind, whose in ((FIRST, is_home), (LATER, ~is_home)):
            mine = cuts[cuts["kind"] == kind]
            if not len(mine):
                continue
            which = np.flatnonzero(whose)
            which = which[np.argsort(runs.number[which], kind="stable")]
            bounds = np.searchsorted(runs.number[which], np.arange(len(runs.first) + 1))
            g = runs.number[mine["run"]]
            many = bounds[g + 1] - bounds[g]
            remove(which[_expand(bounds[g], many)], np.repeat(mine["first"].astype(np.int64), many), np.repeat(mine["last"].astype(np.int64), many))
        split = np.frombuffer(bytes(B.blob(replies, "c")[0]), "<u4").astype(np.int64)
        if len(split):  # windows of split segments, in all runs of the block that have them
            segments = np.unique(runs.number[split])
            parts = [windows_of(buf, runs, segments[a : a + 4096]) for a in range(0, len(segments), 4096)]
            items, seg = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            first, number, _ = _first_of(mix(items["v"] ^ (items["s"] << np.uint64(1))))
            home = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(home, number, items["doc"].astype(np.int64))
            start_of = np.searchsorted(seg, np.arange(len(runs.first) + 1))  # windows of each distinct segment
            earlier = np.zeros(len(first), bool)
            hot_cuts = cuts[cuts["kind"] == HOT_WINDOW]
            earlier[number[start_of[runs.number[hot_cuts["run"]]] + hot_cuts["first"]]] = True
            which = np.flatnonzero(np.isin(runs.number, segments))
            many = runs.n[which]
            window, at = number[_expand(start_of[runs.number[which]], many)], _expand(np.zeros(len(which), np.int64), many)
            run = np.repeat(which, many)
            gone = earlier[window] | (runs.doc[run] > home[window])
            remove(run[gone], at[gone], at[gone])
        gone = np.cumsum(delta[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        lost = total[off[1:]] - total[off[:-1]]
        up = gone.copy()
        up[1:] &= ~gone[:-1]
        inner = off[:-1][off[:-1] < len(buf)]
        up[inner] = gone[inner]
        total = np.concatenate([[0], np.cumsum(up)])
        spans = total[off[1:]] - total[off[:-1]]
        kept = [buf[a:b].tobytes() if not k else buf[a:b][~gone[a:b]].tobytes() for a, b, k in zip(off[:-1], off[1:], lost)]
        more = {"n_bytes": pa.array(np.diff(off), pa.int64()), "n_removed": pa.array(lost, pa.int64()), "n_spans": pa.array(spans, pa.int64())}
        if digest:
            more["kept_sha256"] = pa.array([sha256(k) for k in kept], pa.string())
        else:
            down = gone.copy()
            down[:-1] &= ~gone[1:]
            last = off[1:][off[1:] > 0] - 1
            down[last] = gone[last]
            s, e = np.flatnonzero(up), np.flatnonzero(down) + 1
            row = np.searchsorted(off, s, "right") - 1
            items = pa.StructArray.from_arrays([pa.array(s - off[row]), pa.array(e - off[row])], names=["start", "end"])
            more["spans"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(s, off).astype(np.int32)), items)
            more["kept"] = pa.array(kept, pa.binary())
        return with_columns(table.drop_columns([B.BLOCK]), **more)

    return B.with_answers(blocked, told, cut, out)


def repeat_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, block_bytes: int | None = None, hot: int = HOT) -> DataFrame:
    """The maximal repeat groups that lie in more than one document: (repeat, size, id_col, start), a row an occurrence.

    repeat: a hash that names the group, size: its bytes, start: the occurrence's first byte.  A repeat is maximal inside
    the segments of its minimizer; one that is longer shows as groups that follow on each other (those of a hot minimizer
    have `length` bytes).  Every window that lies in two documents is covered in all its occurrences.  Groups are rows, so
    a group of any size is spread over the blocks of its documents.
    """

    def groups_of(bucket, items, texts, block):
        first, number, name, size, group, seg, off = _groups_of(items, texts, length)
        place = (block.astype(np.int64) << 32) | items["doc"]
        low, high = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), -1)
        np.minimum.at(low, number, place)
        np.maximum.at(high, number, place)
        others = np.zeros(len(first), bool)
        others[number[(items["how"] & OTHERS) > 0]] = True
        # a segment that stands in several documents is a group; so is a repeat among unequal ones
        least, most, more = np.full(len(size), np.iinfo(np.int64).max), np.full(len(size), -1), np.zeros(len(size), bool)
        np.minimum.at(least, group, low[seg])
        np.maximum.at(most, group, high[seg])
        np.logical_or.at(more, group, others[seg])
        good = (least < most) | more
        own = np.flatnonzero((low < high) | others)
        whole = np.arange(len(first))[own]
        segs = np.concatenate([whole, seg[good[group]]])
        at = np.concatenate([np.zeros(len(whole), np.int64), off[good[group]]])
        sizes = np.concatenate([items["size"][first[whole]].astype(np.int64), size[group[good[group]]]])
        lead = items[first[whole]]
        names = np.concatenate([np.where(lead["how"] & WINDOW, lead["v"], lead["s"]), name[group[good[group]]]]).astype(np.uint64)
        by = np.argsort(number, kind="stable")
        bounds = np.searchsorted(number[by], np.arange(len(first) + 1))
        many = np.diff(bounds)[segs]
        item = by[_expand(bounds[segs], many)]
        out = np.zeros(len(item), OCCURS)
        out["group"], out["run"] = np.repeat(names, many), items["run"][item]
        out["at"], out["size"] = np.repeat(at, many) + items["at"][item], np.repeat(sizes, many)
        out["kind"] = np.where(items["how"][item] & WINDOW, HOT_WINDOW, FIRST)
        return B.answers(bucket, block[item], out)

    blocked, runs_of, windows_of, told = _exchanged(df, id_col, text_col, length, block_bytes, hot, groups_of)
    id_type = df.schema[id_col].dataType
    out_type = T.StructType([T.StructField("repeat", T.LongType()), T.StructField("size", T.LongType()), T.StructField(id_col, id_type), T.StructField("start", T.LongType())])

    def occurrences(table, replies):
        found = np.frombuffer(bytes(B.blob(replies, "a")[0]), OCCURS)
        if not len(table) or not len(found):
            return none_of(out_type)
        table, _, off, runs = runs_of(table)
        buf = column_bytes(table.column(text_col))[0]
        plain = found[found["kind"] == FIRST]
        by = np.argsort(runs.number, kind="stable")
        bounds = np.searchsorted(runs.number[by], np.arange(len(runs.first) + 1))
        g = runs.number[plain["run"]]
        many = bounds[g + 1] - bounds[g]
        run = by[_expand(bounds[g], many)]
        start, name, size = runs.start[run] + np.repeat(plain["at"].astype(np.int64), many), np.repeat(plain["group"], many), np.repeat(plain["size"].astype(np.int64), many)
        split = np.frombuffer(bytes(B.blob(replies, "c")[0]), "<u4").astype(np.int64)
        if len(split):
            segments = np.unique(runs.number[split])
            parts = [windows_of(buf, runs, segments[a : a + 4096]) for a in range(0, len(segments), 4096)]
            items, seg = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            first, number, _ = _first_of(mix(items["v"] ^ (items["s"] << np.uint64(1))))
            start_of = np.searchsorted(seg, np.arange(len(runs.first) + 1))
            hot_found, named = found[found["kind"] == HOT_WINDOW], np.zeros(len(first), np.uint64)
            named[number[start_of[runs.number[hot_found["run"]]] + hot_found["at"]]] = hot_found["group"]
            which = np.flatnonzero(np.isin(runs.number, segments))
            many = runs.n[which]
            window, at, run = number[_expand(start_of[runs.number[which]], many)], _expand(np.zeros(len(which), np.int64), many), np.repeat(which, many)
            ok = named[window] > 0
            start, name, size = np.concatenate([start, runs.start[run[ok]] + at[ok]]), np.concatenate([name, named[window[ok]]]), np.concatenate([size, np.full(int(ok.sum()), length)])
        once = np.unique(np.stack([name, start.astype(np.uint64), size.astype(np.uint64)]), axis=1)
        name, start, size = once[0].copy(), once[1].astype(np.int64), once[2].astype(np.int64)
        row = np.searchsorted(off, start, "right") - 1
        return pa.table([pa.array(name.view(np.int64)), pa.array(size, pa.int64()), table.column(id_col).take(pa.array(row)), pa.array(start - off[row], pa.int64())], names=["repeat", "size", id_col, "start"])

    return B.with_answers(blocked, told, occurrences, out_type)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: per document n_bytes, n_removed, n_spans and the digest of the kept bytes."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, digest=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
