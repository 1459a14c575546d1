"""Operator 6: removal of repeated byte strings by suffix arrays.

Every string of `window` bytes has an anchor: of the `gram`-byte strings in it
the one with the least hash, the leftmost of equal ones. Equal strings have equal
anchors at equal places, so repeats can be sought among the contexts of an
anchor: the bytes of the successive strings that have it.

1. Texts are packed into compressed blocks, written once, bucketed by the unit
   of blocks that a task handles; later steps read them in place, without a shuffle.
2. Hashes of the blocks' anchors meet by hash; back go two bits for each anchor:
   whether it stands in several documents, and whether it is hot. What a unit and a
   part have for each other, here and below, is one row, and units, parts and shares
   grow with the corpus as far as memory goes, as each such row has its cost.
3. The contexts of repeated anchors meet by anchor, each distinct one of a block
   once. An enhanced suffix array of a share of the contexts is scanned for
   common-prefix intervals of `window` bytes or more; those with different bytes
   ahead are the maximal repeats, with all occurrences. Of a hot anchor every
   string of its own goes to the task of the string's hash, so that contexts that
   differ are spread and equal ones meet once a block.
4. Spans that an earlier document holds go back to the blocks and are cut out.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.llm import kernels as K
from siftgrain.llm.store import drop_table, freed, shared_folder, small_batches, write_table
from siftgrain.llm.suffix_array import maximal_repeats

#: Bytes of an anchor.
GRAM = 20
#: Text bytes of a block; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Text bytes of a block that are hashed at a time: so few that their hashes stay in a core's cache.
PIECE_BYTES = 1 << 15
#: Blocks of a unit: the less, and with so many input partitions for each block of a unit up to the more.
UNIT, MOST_UNIT, UNIT_PARTITIONS = 2, 8, 32
#: Anchors that one task compares, context bytes of one share, and those that one suffix array is built of.
ANCHORS, SHARE_BYTES, CONTEXT_BYTES = 250_000, 2 << 20, 1 << 19
#: Parts and shares beyond which these sizes grow instead, and how many times.
SPREAD, GROWTH = 256, 8
#: Distinct contexts of a hot anchor, summed over the blocks, at least; as many times more as parts have grown.
HOT_CONTEXTS = 1024
#: Contexts that are counted in a block at most.
MOST_CONTEXTS = 30_000
#: Bytes that a unit gathers for the others before it packs them.
GATHERED_BYTES = 64 << 20
#: Buckets of the table of blocks, at most.
MOST_BUCKETS = 20_000
_U64 = np.uint64


def _squeezed(x: np.ndarray | bytes) -> bytes:
    raw = x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes()
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _full(x: bytes, kind) -> np.ndarray:
    n = struct.unpack_from("<q", x)[0]
    return np.frombuffer(pa.decompress(memoryview(x)[8:], n, codec="zstd", asbytes=True), kind)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one dimension as one compressed string."""
    raws = [_planes(x).tobytes() if x.dtype.itemsize == 8 else np.ascontiguousarray(x).tobytes() for x in arrays]
    return _squeezed(b"".join([struct.pack(f"<{len(raws)}q", *map(len, raws)), *raws]))


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of one weight together: the high ones of small values, and of steps between sorted ones, are zero."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T)


def _unpacked(x: bytes, *kinds) -> list[np.ndarray]:
    raw = _full(x, np.uint8)
    at, out = 8 * len(kinds), []
    for n, kind in zip(raw[:at].view(np.int64).tolist(), kinds, strict=True):
        own = raw[at : at + n]
        out.append(own.reshape(8, -1).T.copy().view(kind).ravel() if np.dtype(kind).itemsize == 8 else np.frombuffer(own.tobytes(), kind))
        at += n
    return out


def _parts(total: int, each: int) -> int:
    """Parts of `each`, or if those are more than SPREAD of up to GROWTH times as much."""
    return max(1, min(SPREAD, total // each), -(-total // (GROWTH * each)))


def _anchors(data: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first, last) of the anchors of a block: the strings that begin at first..last have the anchor.

    A long text is taken in pieces; an anchor whose strings two pieces hold comes twice, with the strings of each.
    """
    parts = []
    for i, j in K.chunks(at[:-1], at[1:], PIECE_BYTES):
        for begin in range(at[i], at[j], PIECE_BYTES) if j == i + 1 else (at[i],):
            end = min(at[j], begin + PIECE_BYTES + window - 1) if j == i + 1 else at[j]
            own = np.array([0, end - begin]) if j == i + 1 else at[i : j + 1] - begin
            h, row, first, last = _piece(data[begin:end], own, window, gram)
            parts.append((h, row + i, first + begin, last + begin))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else _piece(data, at, window, gram)


def _piece(data: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    n = len(data) - window + 1
    if n <= 0:
        return none.astype(_U64), none, none, none
    h = K.rolling_hash(data, gram)
    # the upper bits of a hash with its place below them: the least is the least hash, and the leftmost of equal ones
    low = _U64((1 << len(h).bit_length()) - 1)
    least, size, wide = h & ~low, 1, window - gram + 1
    least |= np.arange(len(h), dtype=_U64)
    while size * 2 <= wide:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if wide > size:
        least = np.minimum(least[:n], least[wide - size : wide - size + n])
    # strings that don't reach beyond their row; between those of two rows stand others
    rows = np.flatnonzero(np.diff(at) >= window)
    if not len(rows):
        return none.astype(_U64), none, none, none
    edge = np.zeros(n + 1, np.int8)
    edge[at[rows]] += 1
    edge[at[rows + 1] - window + 1] -= 1
    whole = np.cumsum(edge[:n], dtype=np.int8).view(bool)
    same = whole[1:] & whole[:-1]
    same &= least[1:] == least[:-1]
    new, old = whole.copy(), whole.copy()
    new[1:] &= ~same
    old[:-1] &= ~same
    first, last = np.flatnonzero(new), np.flatnonzero(old)
    row = np.searchsorted(at, first, side="right") - 1
    # a least hash is a small one; mixed, anchors spread evenly over the parts
    return K.mix(h[(least[first] & low).astype(np.int64)]), row, first, last


def _pack(docs: DataFrame, blocks_of_unit: int = UNIT) -> DataFrame:
    """(id long, text, carried struct) as blocks: (unit, block, ids, ends, body, carried)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, start, end = K.text_bytes(batch.column(1))
            for i, j in K.chunks(start, end, BLOCK_BYTES):
                own, at = K.gather(data, start[i:j], end[i:j])
                ids = batch.column(0).slice(i, j - i)
                columns = [
                    pa.array([task << 32 | block // blocks_of_unit]),
                    pa.array([block], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), ids),
                    pa.array([at[1:].tolist()], pa.list_(pa.int64())),
                    pa.array([_squeezed(own)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(2).slice(i, j - i)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["unit", "block", "ids", "ends", "body", "carried"])
                block += 1

    kind = docs.schema["carried"].dataType.simpleString()
    return docs.mapInArrow(run, f"unit long, block int, ids array<long>, ends array<long>, body binary, carried array<{kind}>")


def _block(ends, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    return _full(body, np.uint8), np.concatenate([[0], np.asarray(ends, np.int64)])


def _by_hash(h: np.ndarray, row: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes by part and hash, whether each stands in several rows, where each part begins, and each anchor's place among them."""
    distinct, back = np.unique(h, return_inverse=True)
    low = np.full(len(distinct), np.iinfo(np.int64).max)
    high = np.full(len(distinct), -1)
    np.minimum.at(low, back, row)
    np.maximum.at(high, back, row)
    own = ((distinct >> _U64(32)) * _U64(parts)) >> _U64(32)  # grows with the hash
    return distinct, low < high, np.searchsorted(own, np.arange(parts + 1)), back


def _different(data: np.ndarray, back: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """How many distinct contexts each of a block's anchors has."""
    out = np.ones(int(back.max()) + 1 if len(back) else 0, np.int64)
    some = np.flatnonzero(np.bincount(back, minlength=len(out))[back] > 1)
    text = K.span_hash(data, first[some], last[some] + window)
    order = np.lexsort((text, back[some]))
    own, text = back[some][order], text[order]
    more = np.flatnonzero((own[1:] == own[:-1]) & (text[1:] != text[:-1])) + 1
    np.add.at(out, own[more], 1)
    return out


def _announcements(rows: Iterable[dict], window: int, gram: int, parts: int) -> Iterator[dict]:
    """For each unit of the blocks and each part one row: the blocks' distinct anchor hashes, and how many contexts each has."""
    unit, gathered, size = None, [], 0

    def told() -> Iterator[dict]:
        edges = np.stack([at for _, at, *_ in gathered])
        for p in np.flatnonzero((np.diff(edges) > 0).any(0)).tolist():
            own = [(block, at[p], at[p + 1], *rest) for block, at, *rest in gathered if at[p + 1] > at[p]]
            hashes, several, contexts = (np.concatenate([x[k][x[1] : x[2]] for x in own]) for k in (3, 4, 5))
            body = _packed(np.diff(hashes, prepend=_U64(0)), contexts, np.packbits(several))
            yield {"part": p, "unit": unit, "blocks": [x[0] for x in own], "sizes": [int(x[2] - x[1]) for x in own], "body": body}

    for r in rows:
        if gathered and (r["unit"] != unit or size > GATHERED_BYTES):
            yield from told()
            gathered, size = [], 0
        unit = r["unit"]
        data, ends = _block(r["ends"], r["body"])
        h, row, first, last = _anchors(data, ends, window, gram)
        distinct, several, at, back = _by_hash(h, row, parts)
        contexts = np.minimum(_different(data, back, first, last, window), MOST_CONTEXTS).astype(np.int16)
        if len(distinct):
            gathered.append((r["block"], at, distinct, several, contexts))
            size += 11 * len(distinct)
    if gathered:
        yield from told()


_ANNOUNCED = "part int, unit long, blocks array<int>, sizes array<int>, body binary"
_ANSWERS = "unit long, part int, blocks array<int>, sizes array<int>, found binary, hot binary, repeated long"


def _batched(rows: Iterable[dict], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows with a column body as batches of about `most` bytes."""
    own, size = [], 0
    for r in rows:
        own.append(r)
        size += len(r["body"])
        if size >= most:
            yield pa.RecordBatch.from_pylist(own, schema=schema)
            own, size = [], 0
    if own:
        yield pa.RecordBatch.from_pylist(own, schema=schema)


def _announce(blocks: DataFrame, window: int, gram: int, parts: int) -> DataFrame:
    """The announcements of all blocks; a unit of which the reading task has only some blocks gives more rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.settle()
        rows = (b.slice(k, 1).select(["unit", "block", "ends", "body"]).to_pylist()[0] for b in batches for k in range(b.num_rows))
        yield from _batched(_announcements(rows, window, gram, parts), _schema(_ANNOUNCED))

    return blocks.mapInArrow(run, _ANNOUNCED)


def _met(announced: DataFrame, hot_contexts: int) -> DataFrame:
    """Two bits for each announced hash, and how many are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.settle()
        by_part: dict[int, list[dict]] = {}
        for b in batches:
            for r in b.to_pylist():
                by_part.setdefault(r["part"], []).append(r)
        for part in sorted(by_part):
            yield pa.RecordBatch.from_pylist(_answered(by_part.pop(part), hot_contexts), schema=_schema(_ANSWERS))
            K.settle()

    return announced.mapInArrow(run, _ANSWERS)


def _answered(own: list[dict], hot_contexts: int) -> list[dict]:
    """The answers to the announcements of one part."""
    hashes, contexts, several = [], [], []
    for r in own:
        steps, n, bits = _unpacked(r["body"], _U64, np.int16, np.uint8)
        hashes.append(np.cumsum(steps))
        contexts.append(n)
        several.append(np.unpackbits(bits, count=len(n)))
    ends = np.cumsum([len(h) for h in hashes])
    all_ = np.concatenate(hashes)
    order = np.argsort(all_, kind="stable")
    ordered = all_[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(ordered)))
    again = (n > 1) | (np.maximum.reduceat(np.concatenate(several)[order], at) > 0)
    group = np.cumsum(new) - 1
    found, hot = np.zeros(len(all_), bool), np.zeros(len(all_), bool)
    found[order], hot[order] = again[group], (np.add.reduceat(np.concatenate(contexts)[order].astype(np.int64), at) >= hot_contexts)[group]
    out = []
    for r, a, b in zip(own, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        if found[a:b].any():
            out.append({k: r[k] for k in ("unit", "part", "blocks", "sizes")} | {"found": np.packbits(found[a:b]).tobytes(), "hot": np.packbits(hot[a:b]).tobytes(), "repeated": int(found[a:b].sum())})
    return out


_CONTEXTS = "share int, unit long, body binary"
#: What a row of contexts holds: the contexts' keys, sizes, numbers of occurrences and bytes; the occurrences' places (block and row), starts and ids.
_HELD = (_U64, np.int16, np.int32, np.uint8, np.int64, np.int32, np.int64)


def _block_answers(answers: Iterable[dict]) -> dict[int, list[tuple[int, np.ndarray, np.ndarray]]]:
    """(part, found, hot) by block."""
    out: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for x in answers:
        n = sum(x["sizes"])
        found, hot = (np.unpackbits(np.frombuffer(x[k], np.uint8), count=n).astype(bool) for k in ("found", "hot"))
        at = 0
        for block, size in zip(x["blocks"], x["sizes"], strict=True):
            out.setdefault(block, []).append((x["part"], found[at : at + size], hot[at : at + size]))
            at += size
    return out


def _unit_contexts(rows: Iterable[dict], answers: Iterable[dict], window: int, gram: int, parts: int, shares: int) -> Iterator[dict]:
    """The contexts of a unit's repeated anchors: for each share one row, or more where they are many bytes."""
    by_block = _block_answers(answers)
    gathered: dict[int, list[tuple[np.ndarray, ...]]] = {}
    size, unit = 0, None

    def told() -> Iterator[dict]:
        for share in sorted(gathered):
            held = [np.concatenate(x) for x in zip(*gathered.pop(share), strict=True)]
            held[-1] = np.diff(held[-1], prepend=0)
            yield {"share": share, "unit": unit, "body": _packed(*held)}

    for r in rows:
        unit = r["unit"]
        for share, own in _contexts(r, by_block.get(r["block"], []), window, gram, parts, shares):
            gathered.setdefault(share, []).append(own)
            size += sum(x.nbytes for x in own)
        if size > GATHERED_BYTES:
            yield from told()
            size = 0
    yield from told()


def _contexts(r: dict, answers: list[tuple[int, np.ndarray, np.ndarray]], window: int, gram: int, parts: int, shares: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """The contexts of a block's repeated anchors, by share; each distinct one once, with its occurrences."""
    if not answers:
        return
    data, at = _block(r["ends"], r["body"])
    ids = np.array([np.iinfo(np.int64).min if i is None else i for i in r["ids"]], np.int64)
    h, row, first, last = _anchors(data, at, window, gram)
    distinct, _, where, back = _by_hash(h, row, parts)
    found, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
    for part, own_found, own_hot in answers:
        found[where[part] : where[part + 1]] = own_found
        hot[where[part] : where[part + 1]] = own_hot
    known = np.array([i is not None for i in r["ids"]], bool)
    take = found[back] & known[row] if len(h) else np.zeros(0, bool)
    own_hot = hot[back][take] if len(h) else take
    h, row, first, last = h[take], row[take], first[take], last[take]
    # the strings of hot anchors one by one
    n = (last - first + 1)[own_hot]
    starts = np.repeat(first[own_hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    hot_row = np.repeat(row[own_hot], n)
    key = np.concatenate([h[~own_hot], K.span_hash(data, starts, starts + window)])
    row = np.concatenate([row[~own_hot], hot_row])
    begin = np.concatenate([first[~own_hot], starts])
    end = np.concatenate([last[~own_hot], starts]) + window
    if not len(key):
        return
    text = K.distinct_spans(data, begin, end)[1]
    order = np.lexsort((ids[row], text, key))
    key, row, begin, end, text = key[order], row[order], begin[order], end[order], text[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(key)))
    share = ((K.mix(key[head]) >> _U64(32)) * _U64(shares)) >> _U64(32)
    by_share = np.argsort(share, kind="stable")
    edges = np.searchsorted(share[by_share], np.arange(shares + 1))
    for s in np.flatnonzero(np.diff(edges)).tolist():
        own = by_share[edges[s] : edges[s + 1]]
        heads = head[own]
        many = np.repeat(heads - (np.cumsum(count[own]) - count[own]), count[own]) + np.arange(count[own].sum())
        body, _ = K.gather(data, begin[heads], end[heads])
        yield s, (key[heads], (end - begin)[heads].astype(np.int16), count[own].astype(np.int32), body, r["block"] << 32 | row[many], (begin - at[row])[many].astype(np.int32), ids[row[many]])


def _spans(rows: list[dict], window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(unit, place, start, end) of the bytes that an earlier document holds, for the contexts of one share."""
    held = [_unpacked(r["body"], *_HELD) for r in rows]
    key, size, count, body, place, start = (np.concatenate([x[k] for x in held]) for k in range(6))
    doc = np.concatenate([np.cumsum(x[6]) for x in held])
    source = np.repeat(np.arange(len(rows)), [len(x[2]) for x in held])
    del held
    size, count, start = size.astype(np.int64), count.astype(np.int64), start.astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    text = K.distinct_spans(body, at[:-1], at[1:])[1]
    # equal contexts of different blocks are one
    order = np.lexsort((text, key))
    new_key = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    new = new_key | np.concatenate([[True], text[order][1:] != text[order][:-1]])
    one = np.zeros(len(order), np.int64)
    one[order] = np.cumsum(new) - 1
    sample = order[new]
    least = np.full(len(sample), np.iinfo(np.int64).max)
    np.minimum.at(least, np.repeat(one, count), doc)
    group = np.cumsum(new_key[new]) - 1
    alone = np.bincount(group)[group] == 1
    # a context with several occurrences is a repeat as it is; those that share a key are searched for the maximal repeats among them
    parts = [(np.arange(len(sample)), np.zeros(len(sample), np.int64), size[sample], least)]
    rest = np.flatnonzero(~alone)
    begin = 0
    edges = np.flatnonzero(np.diff(group[rest], prepend=-1)) if len(rest) else rest
    total = np.concatenate([[0], np.cumsum(size[sample][rest])])
    while begin < len(rest):
        stop = int(np.searchsorted(total, total[begin] + CONTEXT_BYTES, side="right")) - 1
        stop = len(rest) if stop >= len(rest) else max(begin + 1, stop)
        later = edges[edges >= stop]  # whole keys together
        stop = int(later[0]) if stop < len(rest) and len(later) else len(rest)
        own = rest[begin:stop]
        own = own[_sharing(body, at, sample[own], window)]
        if len(own):
            parts.append(_repeats(body, at, sample[own], own, least[own], window))
        begin = stop
    context, offset, length, by = (np.concatenate(x) for x in zip(*parts, strict=True))
    # each occurrence with the spans of its context
    order = np.argsort(context, kind="stable")
    context, offset, length, by = context[order], offset[order], length[order], by[order]
    from_, to = np.searchsorted(context, np.repeat(one, count)), np.searchsorted(context, np.repeat(one, count), side="right")
    owner = np.repeat(source, count)
    for k in range(0, len(doc), 1 << 18):
        a, b = from_[k : k + (1 << 18)], to[k : k + (1 << 18)]
        n = b - a
        occ = np.repeat(np.arange(len(n)), n) + k
        span = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        keep = by[span] < doc[occ]
        occ, span = occ[keep], span[keep]
        begins = np.flatnonzero(np.diff(owner[occ], prepend=-1))  # occurrences are in order of their rows
        for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(occ)], strict=False):
            o, x = occ[i:j], span[i:j]
            yield rows[owner[o[0]]]["unit"], place[o], start[o] + offset[x], start[o] + offset[x] + length[x]


def _sharing(body: np.ndarray, at: np.ndarray, sample: np.ndarray, window: int) -> np.ndarray:
    """Which of the contexts have a string that stands twice among them; the others need no suffix array."""
    own, own_at = K.gather(body, at[sample], at[sample + 1])
    n = np.diff(own_at) - window + 1
    which = np.repeat(np.arange(len(n)), n)
    start = np.arange(n.sum()) + np.repeat(own_at[:-1] - (np.cumsum(n) - n), n)
    h = K.rolling_hash(own, window)[start]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(n), bool)
    out[which[order[1:][same]]] = out[which[order[:-1][same]]] = True
    return out


def _repeats(body: np.ndarray, at: np.ndarray, sample: np.ndarray, name: np.ndarray, least: np.ndarray, window: int):
    """(context, offset, length, least document) of the maximal repeats among distinct contexts."""
    own, own_at = K.gather(body, at[sample], at[sample + 1])
    size = np.diff(own_at)
    # a value of its own class behind each context keeps repeats inside
    wide = np.zeros(len(own) + len(size), np.int64)
    which = np.repeat(np.arange(len(size)), size)
    wide[np.arange(len(own)) + which] = own + 1
    begins = own_at[:-1] + np.arange(len(size))
    edge = np.zeros(len(wide), bool)
    edge[begins] = True
    context = np.repeat(np.arange(len(size)), size + 1)
    # suffixes that begin within a string's length of the end hold no string
    order, first, last, length = maximal_repeats(_closed(wide, begins + size), window, int(size.max()), edge)
    n = last - first + 1
    low = np.minimum.reduceat(np.append(least[context[order]], np.iinfo(np.int64).max), np.stack([first, last + 1], 1).ravel())[::2] if len(first) else first
    where = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    return name[context[where]], where - begins[context[where]], np.repeat(length, n), np.repeat(low, n)


def _closed(wide: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The values with a different one, above all bytes, at each end."""
    out = wide.copy()
    out[ends] = 300 + np.arange(len(ends))
    return out


def _grouped(spans) -> pa.Table:
    """(unit, cuts) rows of merged spans."""
    gathered: dict[int, list[np.ndarray]] = {}
    for unit, place, a, b in spans:
        if len(place):
            gathered.setdefault(unit, []).append(np.stack([place, a, b], 1).astype(np.int64))
    out = [(t, _packed(*_union(np.concatenate(x)).T)) for t, x in gathered.items()]
    cols = list(zip(*out, strict=True)) or [(), ()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary()), strict=True)], names=["unit", "cuts"])


def _union(x: np.ndarray) -> np.ndarray:
    """(place, start, end) spans by place with those that meet or overlap as one."""
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    lift = np.cumsum(np.diff(x[:, 0], prepend=x[:1, 0]) != 0) * (1 << 40)
    reach = np.maximum.accumulate(x[:, 2] + lift)
    new = np.concatenate([[True], x[1:, 1] + lift[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return np.stack([x[at, 0], x[at, 1], reach[np.append(at[1:], len(x)) - 1] - lift[at]], 1)


def _unit_cuts(cuts: list[bytes]) -> dict[int, np.ndarray]:
    """Merged (row, start, end) spans by block."""
    if not cuts:
        return {}
    x = _union(np.concatenate([np.stack(_unpacked(c, np.int64, np.int64, np.int64), 1) for c in cuts]))
    block = x[:, 0] >> 32
    x[:, 0] &= (1 << 32) - 1
    at = np.flatnonzero(np.diff(block, prepend=-1))
    return {int(block[i]): x[i:j] for i, j in zip(at.tolist(), [*at[1:].tolist(), len(x)], strict=True)}


def _cut(r: dict, carried: pa.Array, x: np.ndarray | None, whole_chars: bool) -> pa.RecordBatch:
    """(id, n_bytes, spans, kept, carried) of a block's rows."""
    data, at = _block(r["ends"], r["body"])
    n = len(at) - 1
    x = np.zeros((0, 3), np.int64) if x is None else x
    counts = np.bincount(x[:, 0], minlength=n)
    gone = np.zeros(len(data) + 1, np.int8)
    gone[at[x[:, 0]] + x[:, 1]] += 1
    np.subtract.at(gone, at[x[:, 0]] + x[:, 2], 1)
    stay = np.cumsum(gone[:-1]) == 0
    if whole_chars and len(data):  # a character of which a byte stays, stays
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        stay = np.repeat(np.logical_or.reduceat(stay, begins), np.diff(np.append(begins, len(data))))
    kept_at = np.concatenate([[0], np.cumsum(stay)])[at].astype(np.int32)
    kept = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(kept_at), pa.py_buffer(np.ascontiguousarray(data[stay]))])
    spans = pa.StructArray.from_arrays([pa.array(x[:, 1]), pa.array(x[:, 2])], names=["start", "end"])
    span_at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(np.diff(at)), pa.ListArray.from_arrays(span_at, spans), kept, carried], names=["id", "n_bytes", "spans", "kept", "carried"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, hot_contexts: int = HOT_CONTEXTS, carry: tuple[str, ...] = (), whole_chars: bool = False, derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """For each row of df: id, n_bytes, spans array<struct<start, end>> and kept binary.

    spans are the maximal runs of bytes that lie in a string of `window` UTF-8
    bytes which also stands in a row with a smaller id; kept is the rest. A null
    text is empty; a text shorter than the window is kept whole. Rows with the
    same id don't count as earlier than each other; a row with a null id is
    kept whole and removes nothing. Matches never cross rows. Ids are whole
    numbers; other columns are not looked at; an empty table gives an empty
    result. carry: columns of df that come along. derive: what is made of the
    result before it is written, where not all of it is wanted. hot_contexts
    changes the cost only.
    """
    small_batches(df.sparkSession)
    spark = df.sparkSession
    gram = min(GRAM, window)
    name = f"siftgrain_blocks_{uuid.uuid4().hex}"
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("none"), *carry).alias("carried"))
    read_parts = docs.rdd.getNumPartitions()
    packed = _pack(docs, min(MOST_UNIT, max(UNIT, read_parts // UNIT_PARTITIONS)))
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), read_parts))
    place = f"{shared_folder(spark)}/siftgrain/{name}"
    packed.write.format("parquet").bucketBy(buckets, "unit").sortBy("unit").option("path", place).saveAsTable(name)
    blocks = spark.table(name)
    size = blocks.agg(F.sum(F.element_at("ends", -1)), F.count("*")).first()
    n_anchors = int((size[0] or 0) * 2 // (window - gram + 2))
    n_parts = _parts(n_anchors, ANCHORS)
    hot_contexts *= max(1, n_anchors // n_parts // ANCHORS)

    announced = _announce(blocks, window, gram, n_parts)
    spread = announced.repartition(max(n_parts, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))), "part")
    answers, answers_path = write_table(_met(spread, hot_contexts), "anchors")
    freed(spark)
    repeated = answers.agg(F.sum("repeated")).first()[0] or 0
    shares = _parts(int(repeated * (window + (window - gram) // 2)), SHARE_BYTES)

    def each(left: pa.Table) -> Iterator[tuple[dict, pa.RecordBatch]]:
        """Each row, and the batch that it is, without what is only carried."""
        at = left.column_names.index("carried")
        for b in left.to_batches():
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                yield one.select([n for n in one.schema.names if n != "carried"]).to_pylist()[0], one.column(at)

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        K.settle()
        parts = list(_unit_contexts((r for r, _ in each(left)), right.to_pylist(), window, gram, n_parts, shares))
        return pa.Table.from_pylist(parts, schema=_schema(_CONTEXTS))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.settle()
        by_share: dict[int, list[dict]] = {}
        for b in batches:
            for r in b.to_pylist():
                by_share.setdefault(r["share"], []).append(r)
        for share in sorted(by_share):
            yield from _grouped(_spans(by_share.pop(share), window)).to_batches()

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        K.settle()
        by_block, out = _unit_cuts(right.column("cuts").to_pylist()), []
        for r, carried in each(left):
            out.append(_cut(r, carried.flatten(), by_block.get(r["block"]), whole_chars))
        return pa.Table.from_batches(out)

    carried = docs.schema["carried"].dataType.simpleString()
    found = blocks.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(contexts, _CONTEXTS)
    shared = found.repartition(max(shares, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))), "share")
    cuts, cuts_path = write_table(shared.mapInArrow(spans, "unit long, cuts binary"), "cuts")
    freed(spark)
    out = blocks.groupBy("unit").cogroup(cuts.groupBy("unit")).applyInArrow(cut, f"id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary, carried {carried}")
    out = out.select(F.col("id").alias(id_col), "n_bytes", "spans", "kept", *[F.col(f"carried.{c}") for c in carry])
    out, _ = write_table(derive(out) if derive else out, "repeats")
    spark.sql(f"DROP TABLE {name}")
    for path in (place, answers_path, cuts_path):
        drop_table(spark, path)
    return out


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: bytes of all documents that lie in a 50-byte string of an earlier document, removed."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    digest = lambda out: out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), derive=digest)


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN f USING (s) WHERE first < doc_id),
run AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, k),
piece AS (SELECT doc_id, k, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS lo, a AS hi FROM span UNION ALL SELECT doc_id, 1e9::BIGINT, max(b), 1e9::BIGINT FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY k) AS x FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM span GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(x, h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
