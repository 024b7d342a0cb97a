"""Substring dedup over words by recompression.

Removes each word covered by a window of 50 words that also starts in a document with a smaller id; judged on the
input. Every round renames runs of one symbol, and then pairs whose left symbol falls in one half of the names and
whose right symbol in the other; a name is a hash of what it stands for, so all tasks give equal strings equal
names without talking to each other. With each symbol goes the stretch of words that decided its making: a window
that holds the stretch has the symbol, wherever it stands. A window's anchor is its leftmost symbol of the highest
level whose stretch it holds. Documents that share anchors share long repeats, which Spark finds by grouping
(``_repeats``); windows whose surroundings differ are compared word by word.

Null and empty texts have no words. Rows with the same id never remove each other's words; each gives a row. Rows
with a null id are left whole and remove nothing. A very long text is looked at alone. An empty table gives an empty
result. Columns other than the named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as T
from ._repeats import WINDOW, copies, gone, repeated_spans, squeezed, texts, with_twins

#: Rounds of recompression. The stretch of a symbol of the fifth is about 30 words, so windows of 50 hold some.
LEVELS = 5
_FAR = 1 << 40


def recompress(name: np.ndarray, row: np.ndarray, levels: int = LEVELS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(name, stretch start, stretch end) of the symbols of every level, the words themselves first. A symbol that a
    document's edge helped to make has a stretch without end."""
    start = np.arange(len(name))
    end = start + 1
    out = [(name, start, end)]
    for level in range(levels):
        if not len(name):
            break
        # runs: a symbol and its neighbours decide where a run stops
        joined = (name[1:] == name[:-1]) & (row[1:] == row[:-1])
        head = np.flatnonzero(np.concatenate(([True], ~joined)))
        last = np.append(head[1:], len(name)) - 1
        length = last - head + 1
        before = np.where((head > 0) & (row[np.maximum(head - 1, 0)] == row[head]), start[np.maximum(head - 1, 0)], -_FAR)
        nxt = np.minimum(last + 1, len(name) - 1)
        after = np.where((last + 1 < len(name)) & (row[nxt] == row[head]), end[nxt], _FAR)
        name = np.where(length > 1, T.mix(name[head] ^ T.mix(length.astype(np.uint64))), name[head])
        row, start, end = row[head], np.minimum(before, start[head]), np.maximum(after, end[last])
        # pairs: left names with an even hash, right names with an odd one
        left = (T.mix(name + np.uint64(level + 1)) & np.uint64(1)) == 0
        near = np.append(row[1:] == row[:-1], False)
        pair = left & np.append(~left[1:], False) & near
        second = np.concatenate(([False], pair[:-1]))
        reach_end = np.where(near, np.append(end[1:], _FAR), _FAR)
        reach_start = np.where(np.concatenate(([False], near[:-1])), np.concatenate(([-_FAR], start[:-1])), -_FAR)
        new_end = np.where(left, np.maximum(end, reach_end), end)
        new_start = np.where(left, start, np.minimum(start, reach_start))
        partner = np.append(name[1:], np.uint64(0))
        name = np.where(pair, T.mix(name * T.BASE + T.mix(partner)), name)
        keep = ~second
        name, row, start, end = name[keep], row[keep], new_start[keep], new_end[keep]
        out.append((name, start, end))
    return out


def regions(buf: np.ndarray, off: np.ndarray, seed: int = 0) -> tuple[np.ndarray, ...]:
    """Regions of windows with the same anchor symbol."""
    begin, stop, row = T.words(buf, off)
    word = T.mix(T.word_hashes(buf, begin, stop) ^ np.uint64(seed))
    n = len(word)
    at = np.arange(max(0, n - WINDOW + 1))
    at = at[row[at] == row[at + WINDOW - 1]] if len(at) else at
    prefix = T.Prefix(word)
    first_word = np.searchsorted(row, np.arange(len(off) - 1))
    chosen = np.full(len(at), -1, dtype=np.int64)
    key, place, stop_at = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    symbols = recompress(word, row)
    for level in range(len(symbols) - 1, -1, -1):
        todo = np.flatnonzero(chosen < 0)
        if not len(todo):
            break
        name, start, end = symbols[level]
        real = (start >= 0) & (end < _FAR)
        name, start, end = name[real], start[real], end[real]
        if not len(name):
            continue
        k = np.searchsorted(start, at[todo])
        held = (k < len(start)) & (end[np.minimum(k, len(end) - 1)] <= at[todo] + WINDOW)
        k, todo = k[held], todo[held]
        chosen[todo] = level * (n + 1) + k
        key[todo] = T.mix(prefix.of(start[k], end[k]) ^ T.mix(name[k] + np.uint64(level)))
        place[todo], stop_at[todo] = start[k], end[k]
    head = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)))) if len(at) else at
    count = np.diff(np.append(head, len(at)))
    first = at[head]
    content = T.mix(prefix.of(first, first + count + WINDOW - 1) ^ T.mix((count * 64 + place[head] - first).astype(np.uint64)))
    place, stop_at = place[head], stop_at[head]
    half = (WINDOW - (stop_at - place)) // 2
    sides = [T.mix(prefix.of(np.maximum(place - half, 0), stop_at)), T.mix(prefix.of(place, np.minimum(place + WINDOW - half, n)))]
    return row[first], first - first_word[row[first]], count, key[head], content, place - first, *sides, half


def cut_out(text: np.ndarray, first: np.ndarray, count: np.ndarray) -> list[bytes]:
    words = text.tobytes().split()
    return [b" ".join(words[a : a + n + WINDOW - 1]) for a, n in zip(first.tolist(), count.tolist())]


def part(content: bytes, first: int, count: int) -> bytes:
    return b" ".join(content.split(b" ")[first : first + count + WINDOW - 1])


def repeated(key: np.ndarray, doc: np.ndarray, count: np.ndarray, lead: np.ndarray, contents: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, first word, end) of the windows of open regions that a smaller document with the same anchor has."""
    stop = np.cumsum(size).tolist()
    begin = [0, *stop[:-1]]
    which, at = [], []
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.diff(key[order], prepend=key[order][0] - 1)).tolist()
    for a, b in zip(edge, [*edge[1:], len(order)]):
        least: dict[bytes, int] = {}
        seen = []
        for r in order[a:b].tolist():
            body = contents[begin[r] : stop[r]]
            gaps = [-1, *np.flatnonzero(np.frombuffer(body, np.uint8) == 0x20).tolist(), len(body)]
            for k in range(int(count[r])):
                window = body[gaps[k] + 1 : gaps[k + WINDOW]]
                d = int(doc[r])
                if least.setdefault(window, d) > d:
                    least[window] = d
                seen.append((r, k, window))
        for r, k, window in seen:
            if doc[r] > least[window]:
                which.append(r), at.append(k)
    where = np.array(at, dtype=np.int64)
    return np.array(which, dtype=np.int64), where, where + WINDOW


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), verify: bool = False, seed: int = 0) -> DataFrame:
    """(id_col, text, kept, n_words, n_removed, *carry) of every row; kept is the other words, joined by one space.

    verify: compare the words of whole regions, too, which moves the contents of all repeats; else those are settled by
    64-bit hashes of their contents at equal anchors. seed changes all hashes.
    """
    source = with_twins(docs, id_col, text_col, carry)
    small = squeezed(source)
    spans = repeated_spans(source, partial(regions, seed=seed), cut_out, part, repeated, verify=verify, small=small, again=None if verify else copies(source))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed, whole = batch.column(2), texts(batch)
            kept, total, removed = [], [], []
            for r, raw in enumerate(whole):
                words = raw.split()
                a, b = gone(listed[r], len(words))
                edges = [0, *np.stack((a, b), 1).reshape(-1).tolist(), len(words)]
                kept.append(b" ".join([w for p, q in zip(edges[::2], edges[1::2]) for w in words[p:q]]).decode())
                total.append(len(words))
                removed.append(int((b - a).sum()))
            found = [pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode() for x in whole], pa.string()), *found, *batch.columns[3:]], names)

    extra = [f"c{k}" for k in range(len(carry))]
    names = [id_col, "text", "kept", "n_words", "n_removed", *carry]
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    joined = small.join(spans, ["at", "twin"], "left").select("doc_id", "text", "spans", *extra)
    return joined.mapInArrow(T.released(apply), f"`{id_col}` long, text string, kept string, n_words long, n_removed long{kinds}")
