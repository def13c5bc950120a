"""Exact removal of repeated passages with a sparse suffix array, sorted by deep-shallow sorting.

Every window of WIDTH bytes contains an anchor: the GRAM bytes with the smallest hash in it. Equal
windows have their anchor at the same place, so it is enough to sort the suffixes around anchors.
Three exchanges of packed rows (see ``blocks``) do that:

1. Blocks of documents send their anchors' hashes; the answer says which occur in two documents.
2. For these, blocks send the bytes around them with the smallest document that holds them. A range
   sorts them; where an anchor has different surroundings, it sorts the suffixes of all windows
   too. Runs whose common prefix is a whole window have one smallest document, which is the answer.
3. Blocks mark the windows whose smallest document is smaller than their own, and cut them out.

Deep-shallow sorting: multikey quicksort, with eight bytes as a character, down to a shallow depth;
groups that are still equal there are put in order by blind tries, which keep of their strings
only branching depths and bytes. All groups of a range go down their tries together.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm import blocks
from casework.llm.arrow import flat, integers
from casework.llm.words import mixed

#: Bytes of a passage, of an anchor, and on either side of an anchor in windows that contain it.
WIDTH, GRAM = 50, 24
SIDE = WIDTH - GRAM
#: Bytes of documents in a block, windows hashed at once, surroundings compared at once in a block.
BLOCK_BYTES, PIECE, CHUNK = 6 << 20, 1 << 18, 1 << 15
#: Characters of eight bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 3
_LETTER = np.random.default_rng(50).integers(1, 1 << 63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
NOBODY = np.iinfo(np.int64).max


# Sorting.

def _runs(new):
    """Number of the run each place belongs to, from where runs begin."""
    return np.cumsum(new) - 1


def deep_shallow(strings, shallow=SHALLOW):
    """Order of equally long strings, rows of big-endian 8-byte characters, and who equals the one before."""
    n, width = strings.shape
    order = np.arange(n)
    new = np.zeros(n, bool)
    new[:1] = True
    # Multikey quicksort: sort by one character, go on with the next only where it is equal.
    open_ = np.arange(n) if n > 1 else np.zeros(0, np.int64)
    for depth in range(min(shallow, width)):
        if not len(open_):
            break
        run = _runs(new)[open_]
        character = strings[order[open_], depth]
        if depth:
            by = np.lexsort((character, run))
        else:
            by = np.argsort(character)
        order[open_] = order[open_][by]
        character = character[by]
        begins = np.r_[True, (character[1:] != character[:-1]) | (run[1:] != run[:-1])]
        new[open_] |= begins
        alone = new & np.r_[new[1:], True]
        open_ = np.flatnonzero(~alone)
    if len(open_) and width > shallow:
        _blind_tries(strings, order, new, open_, shallow)
    return order, ~new


def _blind_tries(strings, order, new, open_, depth):
    """Put in order what is equal down to ``depth``: along the path of a group's first string, each
    other string hangs at a branching depth and byte; strings that hang together are a group again."""
    width = strings.shape[1]
    while len(open_):
        members, run = order[open_], _runs(new)[open_]
        first = np.r_[True, run[1:] != run[:-1]]
        leader = members[np.flatnonzero(first)][np.cumsum(first) - 1]
        branch = np.full(len(members), width, np.int64)
        undecided = np.arange(len(members))
        for d in range(depth, width):
            differ = strings[members[undecided], d] != strings[leader[undecided], d]
            branch[undecided[differ]] = d
            undecided = undecided[~differ]
            if not len(undecided):
                break
        at = np.minimum(branch, width - 1)
        own, its = strings[members, at], strings[leader, at]
        gap = (own ^ its).byteswap().view(np.uint8).reshape(-1, 8) != 0
        skip = at * 8 + np.argmax(gap, axis=1)
        byte = (own >> ((7 - skip % 8) * 8).astype(np.uint64)) & np.uint64(255)
        side = np.where(branch == width, 1, np.where(own < its, 0, 2)).astype(np.uint64)
        # Smaller strings come first, those that leave the path early before all; greater ones mirror that.
        depth_key = np.where(side == 0, skip, np.where(side == 2, 1023 - skip, 0)).astype(np.uint64)
        byte = np.where(side == 1, 0, byte).astype(np.uint64)
        hang = (side << np.uint64(18)) | (depth_key << np.uint64(8)) | byte
        key = (run.astype(np.uint64) << np.uint64(20)) | hang
        by = np.argsort(key, kind="stable")
        order[open_] = members[by]
        key, side = key[by], side[by]
        new_here = np.r_[True, key[1:] != key[:-1]]
        new[open_] |= new_here
        # Equal strings are done, and so is what hangs alone.
        last = np.r_[new_here[1:], True]
        open_ = open_[~(new_here & last) & (side != 1)]


def characters(rows):
    """Byte rows, a multiple of eight long, as big-endian numbers."""
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def equal_runs(rows, *least):
    """Distinct byte rows in sorted order, the place of each row among them, and least values of each."""
    order, same = deep_shallow(characters(rows))
    place = np.empty(len(rows), np.int64)
    place[order] = _runs(~same)
    first = np.flatnonzero(~same)
    return rows[order[first]], place, [np.minimum.reduceat(x[order], first) if len(first) else x for x in least]


# Anchors.

def _slide(values, width, pick):
    """``pick`` (minimum or maximum) over every ``width`` values in a row."""
    out, have = values, 1
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


class Anchors:
    """Anchors of a block: place, hash, and which of the windows around it have it as anchor (bits)."""

    def __init__(self, data, offsets):
        self.data, self.offsets = data, offsets
        n = len(data)
        edge = np.zeros(n + 1, np.int8)
        long = np.diff(offsets) >= WIDTH
        np.add.at(edge, offsets[:-1][long], 1)
        np.add.at(edge, offsets[1:][long] - WIDTH + 1, -1)
        valid = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
        places, hashes, bits = [], [], []
        for start in range(0, n, PIECE):
            ok = valid[start : start + PIECE]
            if not ok.any():
                continue
            part = data[start : start + PIECE + WIDTH - 1]
            ok = ok[: max(0, len(part) - WIDTH + 1)]
            h = self._grams(part)
            least = np.where(ok, _slide(h, SIDE + 1, np.minimum)[: len(ok)], np.uint64(0))
            wide = np.zeros(len(ok) + 2 * SIDE, np.uint64)
            wide[SIDE : SIDE + len(ok)] = least
            at = np.flatnonzero(_slide(wide, SIDE + 1, np.maximum) == h[: len(ok) + SIDE])
            mine = np.zeros(len(at), np.uint32)
            for i in range(SIDE + 1):  # the window that begins i bytes before
                mine |= (wide[at + SIDE - i] == h[at]).astype(np.uint32) << np.uint32(i)
            places.append(at + start)
            hashes.append(h[at])
            bits.append(mine)
        if not places:
            self.place, self.hash, self.bits = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
            return
        place, hash_, bits = map(np.concatenate, (places, hashes, bits))
        order = np.argsort(place, kind="stable")  # pieces overlap
        first = np.flatnonzero(np.r_[True, np.diff(place[order]) > 0])
        self.place, self.hash = place[order][first], hash_[order][first]
        self.bits = np.bitwise_or.reduceat(bits[order], first)

    @staticmethod
    def _grams(part):
        """Hashes of the GRAM bytes at every place, none of them 0."""
        one = _LETTER[part]
        size, steps = 1, {1: one}
        power = lambda n: np.uint64(pow(int(_BASE), n, 1 << 64))
        while 2 * size <= GRAM:
            last = steps[size]
            steps[2 * size] = last[:-size] * power(size) + last[size:]
            size *= 2
        rest = GRAM - size
        h = steps[size]
        return mixed(h[: len(h) - rest] * power(rest) + steps[rest][size:]) | np.uint64(1)

    def owner(self, chosen):
        """Number of the document of chosen anchors."""
        return np.searchsorted(self.offsets, self.place[chosen], side="right") - 1

    def surroundings(self, chosen):
        """Rows of 80 bytes: anchor, what follows, what precedes (backwards), bits. Outside is 0."""
        place, doc = self.place[chosen], self.owner(chosen)
        out = np.zeros((len(chosen), 80), np.uint8)
        steps = np.concatenate([np.arange(WIDTH), -1 - np.arange(SIDE)])
        at = place[:, None] + steps
        inside = (at >= self.offsets[doc][:, None]) & (at < self.offsets[doc + 1][:, None])
        out[:, :76] = np.where(inside, self.data[np.clip(at, 0, max(0, len(self.data) - 1))], 0)
        out[:, 76:] = self.bits[chosen].astype(">u4").view(np.uint8).reshape(-1, 4)
        return out


# The three exchanges.

def _bits_of(total):
    """Bits of a hash that are sent: enough that few anchors look repeated by chance."""
    return min(62, math.ceil(math.log2(max(total, 2))) + 12)


def _split(keys, n, bits):
    return blocks.ranges(keys << np.uint64(64 - bits), n)


def _block(table):
    table = table.sort_by([("_id", "ascending")])
    data, offsets = flat(table.column("_text"))
    return integers(table.column("_id")), Anchors(np.ascontiguousarray(data), offsets)


def _sent_keys(anchors, bits):
    key = anchors.hash >> np.uint64(64 - bits)
    return blocks.distinct(key)


def _send_anchors(n, bits):
    kinds = {"_block": pa.int32(), "_range": pa.int32(), "_keys": pa.binary(), "_twice": pa.binary()}

    def run(table):
        out = {k: [] for k in kinds}
        if table.num_rows:
            ids, anchors = _block(table)
            known, place, _ = _sent_keys(anchors, bits)
            doc = ids[anchors.owner(np.arange(len(anchors.place)))]
            low, high = np.full(len(known), NOBODY), np.full(len(known), np.iinfo(np.int64).min)
            np.minimum.at(low, place, doc)
            np.maximum.at(high, place, doc)
            edges = _split(known, n, bits)
            for r in range(n):
                part = known[edges[r] : edges[r + 1]]
                if len(part):
                    out["_block"].append(table.column("_block")[0].as_py())
                    out["_range"].append(r)
                    out["_keys"].append(blocks.pack(np.r_[part[:1], np.diff(part)]))
                    out["_twice"].append(np.packbits((low < high)[edges[r] : edges[r + 1]]).tobytes())
        return blocks.table(out, kinds)

    return run


def _answer_anchors(table):
    """Which of a block's anchors occur in two documents of any blocks."""
    keys = [np.cumsum(blocks.unpack(k).astype(np.uint64), dtype=np.uint64) for k in blocks.binary(table.column("_keys"))]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(k)) for t, k in zip(blocks.binary(table.column("_twice")), keys)]
    _, place, (count,) = blocks.distinct(np.concatenate(keys), 1 + np.concatenate(twice).astype(np.int64))
    again = count[place] > 1
    out, at = [], 0
    for k in keys:
        out.append(np.packbits(again[at : at + len(k)]).tobytes())
        at += len(k)
    return pa.table({
        "_block": table.column("_block"), "_range": table.column("_range"), "_kind": pa.array(np.zeros(len(out), np.int32)),
        "_one": pa.array([b"%d" % len(k) for k in keys], pa.binary()), "_two": pa.array(out, pa.binary()),
    })


class _Repeats:
    """Anchors of a block that occur in two documents, and their distinct surroundings."""

    def __init__(self, table, answers, bits):
        self.ids, self.anchors = _block(table)
        known, place, _ = _sent_keys(self.anchors, bits)
        flags = np.zeros(len(known), bool)
        at = 0
        answers = answers.sort_by([("_range", "ascending")])
        for size, found in zip(blocks.binary(answers.column("_one")), blocks.binary(answers.column("_two"))):
            flags[at : at + int(size)] = np.unpackbits(np.frombuffer(found, np.uint8), count=int(size)).astype(bool)
            at += int(size)
        self.chosen = np.flatnonzero(flags[place])
        self.doc = self.ids[self.anchors.owner(self.chosen)]
        # Chunk by chunk, so that the many equal surroundings of a text that repeats itself take no room.
        rows, least, places, total = [], [], [], 0
        for start in range(0, len(self.chosen), CHUNK):
            part = slice(start, start + CHUNK)
            some, place, (low,) = equal_runs(self.anchors.surroundings(self.chosen[part]), self.doc[part])
            rows.append(some)
            least.append(low)
            places.append(place + total)
            total += len(some)
        if total:
            self.rows, place, (self.least,) = equal_runs(np.concatenate(rows), np.concatenate(least))
            self.place = place[np.concatenate(places)]
        else:
            self.rows, self.least, self.place = np.zeros((0, 80), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def edges(self, n):
        """Rows are sorted by their anchor; a range takes those whose anchor's hash falls into it."""
        spread = Anchors._grams(self.rows[:, :GRAM].ravel())[::GRAM] if len(self.rows) else np.zeros(0, np.uint64)
        of = (mixed(spread) % np.uint64(n)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        return order, np.searchsorted(of[order], np.arange(n + 1))


def _send_surroundings(n, bits):
    kinds = {"_block": pa.int32(), "_range": pa.int32(), "_rows": pa.binary(), "_least": pa.binary()}

    def run(left, right):
        out = {k: [] for k in kinds}
        if left.num_rows and right.num_rows:
            found = _Repeats(left, right, bits)
            order, edges = found.edges(n)
            for r in range(n):
                own = order[edges[r] : edges[r + 1]]
                if len(own):
                    out["_block"].append(left.column("_block")[0].as_py())
                    out["_range"].append(r)
                    out["_rows"].append(blocks.pack(found.rows[own].ravel()))
                    out["_least"].append(blocks.pack(found.least[own]))
        return blocks.table(out, kinds)

    return run


def smallest(rows, least):
    """Of every distinct row of surroundings and each of its windows, the smallest document that holds it.

    Returns one document for each row, and for rows whose anchor has other surroundings as well a
    matrix of one for each window (with the numbers of these rows)."""
    anchor = characters(rows[:, :GRAM])
    differ = np.r_[True, (anchor[1:] != anchor[:-1]).any(axis=1)] if len(rows) else np.zeros(0, bool)
    alone = differ & np.r_[differ[1:], True]
    several = np.flatnonzero(~alone)
    found = np.full((len(several), SIDE + 1), NOBODY)
    part = rows[several]
    bits = np.ascontiguousarray(part[:, 76:]).view(">u4").ravel().astype(np.uint32)
    line = np.concatenate([part[:, 75:WIDTH - 1:-1], part[:, :WIDTH]], axis=1)  # preceding, anchor, following
    which, shift = np.nonzero((bits[:, None] >> np.arange(SIDE + 1, dtype=np.uint32)) & 1)
    windows = np.zeros((len(which), 56), np.uint8)
    for i in range(SIDE + 1):
        own = np.flatnonzero(shift == i)
        windows[own, :WIDTH] = line[which[own], SIDE - i : SIDE - i + WIDTH]
    if len(which):
        _, place, (low,) = equal_runs(windows, least[several][which])
        found[which, shift] = low[place]
    return several, found


def _answer_surroundings(table):
    parts = [blocks.unpack(r).reshape(-1, 80) for r in blocks.binary(table.column("_rows"))]
    least = [blocks.unpack(x) for x in blocks.binary(table.column("_least"))]
    rows, place, (low,) = equal_runs(np.concatenate(parts), np.concatenate(least))
    several, windows = smallest(rows, low)
    index = np.full(len(rows), -1)
    index[several] = np.arange(len(several))
    one, two, at = [], [], 0
    for p in parts:
        own = place[at : at + len(p)]
        at += len(p)
        one.append(blocks.pack(low[own]))
        mixed_rows = index[own]
        two.append(blocks.pack(np.r_[windows[mixed_rows[mixed_rows >= 0]].ravel(), np.flatnonzero(mixed_rows >= 0)]))
    return pa.table({
        "_block": table.column("_block"), "_range": table.column("_range"), "_kind": pa.array(np.ones(len(one), np.int32)),
        "_one": pa.array(one, pa.binary()), "_two": pa.array(two, pa.binary()),
    })


def _cut(n, bits):
    kinds = {"_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "_spans": pa.list_(pa.int64()), "_kept": pa.binary()}

    def run(left, right):
        out = {k: [] for k in kinds}
        if not left.num_rows:
            return blocks.table(out, kinds)

        anchors_of = right.filter(pc.equal(right.column("_kind"), 0))
        found = _Repeats(left, anchors_of, bits)
        data, offsets = found.anchors.data, found.anchors.offsets
        change = np.zeros(len(data) + 1, np.int32)
        if len(found.chosen):
            order, edges = found.edges(n)
            one = np.full(len(found.rows), NOBODY)
            windows = np.zeros((0, SIDE + 1), np.int64)
            index = np.full(len(found.rows), -1)
            answers = right.filter(pc.equal(right.column("_kind"), 1)).sort_by([("_range", "ascending")])
            parts, total = [], 0
            for r, low, more in zip(answers.column("_range").to_pylist(), blocks.binary(answers.column("_one")), blocks.binary(answers.column("_two"))):
                own = order[edges[r] : edges[r + 1]]
                one[own] = blocks.unpack(low)
                more = blocks.unpack(more)
                m = len(more) // (SIDE + 2)
                parts.append(more[: m * (SIDE + 1)].reshape(m, SIDE + 1))
                index[own[more[m * (SIDE + 1) :]]] = total + np.arange(m)
                total += m
            windows = np.concatenate(parts) if parts else windows
            for start in range(0, len(found.chosen), CHUNK):
                part = slice(start, start + CHUNK)
                row, place = found.place[part], found.anchors.place[found.chosen[part]]
                bits_, doc = found.anchors.bits[found.chosen[part]], found.doc[part]
                low = np.repeat(one[row][:, None], SIDE + 1, axis=1)
                several = np.flatnonzero(index[row] >= 0)
                low[several] = windows[index[row[several]]]
                hit = (low < doc[:, None]) & ((bits_[:, None] >> np.arange(SIDE + 1, dtype=np.uint32)) & 1).astype(bool)
                which, back = np.nonzero(hit)
                begins = place[which] - back
                np.add.at(change, begins, 1)
                np.add.at(change, begins + WIDTH, -1)
        gone = np.cumsum(change[:-1]) > 0
        sums = np.r_[0, np.cumsum(gone)]
        for i in range(len(offsets) - 1):
            a, b = int(offsets[i]), int(offsets[i + 1])
            removed = int(sums[b] - sums[a])
            spans, kept = [], data[a:b]
            if removed:
                own = gone[a:b]
                turns = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
                spans, kept = turns.tolist(), data[a:b][~own]
            out["_id"].append(int(found.ids[i]))
            out["n_bytes"].append(b - a)
            out["n_removed"].append(removed)
            out["_spans"].append(spans)
            out["_kept"].append(kept.tobytes())
        return blocks.table(out, kinds)

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of every text without passages of documents with smaller ids.

    Returns id, ``n_bytes``, ``n_removed``, ``spans`` (begin and end of each removed run, in
    bytes, in turn) and ``kept`` (the remaining bytes). A byte goes if a string of WIDTH bytes that
    covers it starts in a document with a smaller id too; texts are judged as they came. Null
    texts count as empty. Rows that repeat an id are judged against smaller ids only, and those
    without an id come after all others. Texts shorter than WIDTH stay whole.
    """
    rows, n = blocks.dealt(docs, id_col, text_col, block_bytes=BLOCK_BYTES)
    bits = _bits_of(n * BLOCK_BYTES)
    own = rows.groupBy("_block")
    answer = "_block int, _range int, _kind int, _one binary, _two binary"
    anchors = (
        own.applyInArrow(_send_anchors(n, bits), "_block int, _range int, _keys binary, _twice binary")
        .groupBy("_range").applyInArrow(_answer_anchors, answer).repartition(n, "_block")
    )
    sent = own.cogroup(anchors.groupBy("_block")).applyInArrow(
        _send_surroundings(n, bits), "_block int, _range int, _rows binary, _least binary"
    )
    found = sent.groupBy("_range").applyInArrow(_answer_surroundings, answer)
    cut = own.cogroup(anchors.unionByName(found).groupBy("_block")).applyInArrow(
        _cut(n, bits), "_id long, n_bytes long, n_removed long, _spans array<long>, _kept binary"
    )
    nobody = F.when(F.col("_id") != F.lit(NOBODY), F.col("_id"))
    return cut.select(nobody.alias(id_col), "n_bytes", "n_removed", F.col("_spans").alias("spans"), F.col("_kept").alias("kept"))
