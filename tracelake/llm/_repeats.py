"""Windows that also start in a document with a smaller id, found without comparing pairs of documents.

Both substring operators work on windows of 50 units (bytes, words). Each window picks one anchor inside itself
by a rule that looks at nothing but its content, so equal windows pick equal anchors at equal places.
Neighbouring windows with the same anchor occurrence form a region. Texts that equal a smaller document's are told by a
128-bit digest first: they are repeats as a whole, and nothing more is sent for them. Of the others:

1. Each task sends, to the shard of the anchor's hash, one small record a region: hashes of the anchor, of the
   region's whole content and of the anchor with half of what a window has besides, to its left and to its right;
   document and place. Of equal regions of a task only the least document's goes out.
2. A shard knows the least document of each region; the others are repeats as a whole. Of the rest, windows with
   at least half of their surplus left of the anchor can only repeat where another document has the same left half,
   the others only where one has the same right half. Windows that pass stay open.
3. The answers meet the texts by document. Open windows are compared exactly, first with the others of the same task;
   what no smaller document of the task has goes on, by anchor, with its content, and is compared over all tasks.
   With ``verify``, the contents of whole repeats go the same way and must equal a smaller document's, or the job ends
   with an error: then two contents have the same hash.

Hot passages are combined in the task that reads them before anything is shuffled, so a shard gets one record
for each task and region, and one content for each task and open window. Where a hot passage ends, its anchor has open
windows in every document that has the passage: the windows of an anchor with more than ``HOT`` of them are dealt one by
one, by the hash of what they hold, so that they spread over all shards and only equal ones meet. The small record (some
20 bytes) of the region there still goes to the anchor's shard from each of these documents. The texts are shuffled once,
each compressed; cutting the spans out uses the same shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import shards

WINDOW = 50
#: Open windows (with ``verify``, regions to be verified as well) from which on those of one anchor are dealt by content.
HOT = 1 << 13
#: Bytes of text whose regions are combined and dealt together, so that records of many shards do not get short.
BLOCK = 4 << 20
#: So many ids of several rows are looked up by value; with more of them all rows are told apart by their texts.
SEVERAL = 10_000
#: Stands for the span from a text's first unit to its last.
WHOLE = -1
_SHARD = "shard int, blob binary"
_FOUND = "at long, twin long, key long, span long"
_SETTLED = "at long, twin long, span long"
_BODIES = "shard int, blob binary, body binary"

#: rows (document of the chunk), first window, windows, anchor hash, region hash, units from the first window to the
#: anchor, hash of the anchor and what is left of it, of it and what is right of it (where a window holds that), and
#: from how many units left of its anchor on a window counts as left, of all regions of a chunk.
Regions = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]


def _spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 32) | end.astype(np.int64)


def _batches(shard: list[int], blob: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(blob, pa.binary())], ["shard", "blob"])


def _found(doc: np.ndarray, twin: np.ndarray, span: np.ndarray, key: np.ndarray | None = None) -> pa.Table:
    keys = pa.nulls(len(doc), pa.int64()) if key is None else pa.array(key.astype(np.int64))
    return pa.table({"at": pa.array(doc.astype(np.int64)), "twin": pa.array(twin.astype(np.int64)), "key": keys, "span": pa.array(span)})


def _joined(doc: np.ndarray, twin: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, twin, span) with the overlapping and touching spans of each row made one."""
    order = np.lexsort((start, twin, doc))
    doc, twin, start, end = doc[order], twin[order], start[order], end[order]
    row = _runs(doc, twin) if len(doc) else doc
    reach = np.maximum.accumulate(end + (row << 33)) - (row << 33) if len(doc) else end
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
    last = np.append(new[1:], True)[: len(new)]
    return doc[new], twin[new], _spans(start[new], reach[last])


def _deal(shard: np.ndarray, rows: tuple[np.ndarray, dict[str, np.ndarray]] | None = None, **arrays: np.ndarray) -> pa.RecordBatch:
    """One packed record for each shard; order within a shard is kept. rows: the number of each entry's row, and columns of
    the rows, of which a record holds those of its entries once."""
    order = np.argsort(shard, kind="stable")
    edge = np.flatnonzero(np.diff(shard[order], prepend=-1))
    blobs = []
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)]):
        o, more = order[a:b], {}
        if rows is not None:
            used, which = np.unique(rows[0][o], return_inverse=True)
            more = {"who_d": which, **{k: v[used] for k, v in rows[1].items()}}
        blobs.append(T.pack(**{k: v[o] for k, v in arrays.items()}, **more))
    return _batches(shard[order][edge].tolist(), blobs)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """The number of each row's run of equal keys; rows with equal keys are side by side."""
    new = np.zeros(len(keys[0]), dtype=bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _blocks(raw: list[bytes], regions: Regions) -> Iterator[list[np.ndarray]]:
    """The regions of texts, those of BLOCK bytes at a time."""
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    raw.clear()
    held, size = [], 0
    for i, j in T.slices(off):
        row, *facts = regions(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        held, size = [*held, (i + row, *facts)], size + off[j] - off[i]
        if size >= BLOCK or j == len(off) - 1:
            yield [np.concatenate(x) for x in zip(*held)]
            held, size = [], 0


def _send(small: DataFrame, regions: Regions, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            ids, twins = batch.column("doc_id").to_numpy(), batch.column("twin").to_numpy()
            for row, first, count, anchor, content, lead, left, right, half in _blocks(texts(batch), regions):
                if not len(row):
                    continue
                doc, twin = ids[row], twins[row]
                order = np.lexsort((doc, content, anchor))
                group = _runs(anchor[order], content[order])
                head = np.flatnonzero(np.diff(group, prepend=-1))
                own = np.zeros(len(row), dtype=bool)
                own[order] = doc[order] == doc[order][head][group]
                rest = ~own
                if rest.any():  # known here: a smaller document of this task has the whole region
                    d, t, span = _joined(doc[rest], twin[rest], first[rest], first[rest] + count[rest] + WINDOW - 1)
                    yield _deal((T.mix(d.astype(np.uint64)) % np.uint64(n)).astype(np.int64), doc_d=d, twin=t, span_d=span)
                at = np.flatnonzero(own)
                at = at[np.argsort(doc[at], kind="stable")]
                # sides that no window of the region holds are not looked at; 24 bits of an anchor besides its shard
                left, right = np.where(lead >= half, left, 0), np.where(lead - count < half - 1, right, 0)
                yield _deal(
                    (anchor[at] % np.uint64(n)).astype(np.int64), (row[at], {"doc_d": ids, "twin": twins}), anchor=(anchor[at] >> np.uint64(40)).astype(np.uint32), content=content[at],
                    left=left[at].astype(np.uint16), right=right[at].astype(np.uint16), half=half[at].astype(np.uint8),
                    first_d=first[at], count=count[at].astype(np.uint16), lead=lead[at].astype(np.uint8),
                )

    return small.mapInArrow(T.released(run), _SHARD)


def _shared(doc: np.ndarray, among: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Which of the rows marked in ``among`` have their keys in common with a marked row of another document."""
    out = np.zeros(len(doc), dtype=bool)
    where = np.flatnonzero(among)
    if len(where):
        where = where[np.lexsort([k[where] for k in keys])]
        group = _runs(*[k[where] for k in keys])
        head = np.flatnonzero(np.diff(group, prepend=-1))
        d = doc[where]
        out[where] = (np.minimum.reduceat(d, head) < np.maximum.reduceat(d, head))[group]
    return out


#: Marks of a lead: the region is to be equal to that of a smaller document, or is the one that others are to equal.
_MEMBER, _HEAD = 1 << 15, 1 << 14
#: Mark of a lead: the region's anchor has more than HOT open windows.
_MANY = 1 << 13


def _meet(table: pa.Table, verify: bool, hot: int) -> pa.Table:
    """One shard: spans of whole repeats (key null), and the open windows of least documents (key: their anchor). To verify,
    whole repeats and the regions that they repeat are asked for as well."""
    parts = [T.unpack(b.as_py()) for b in table.column("blob")]
    out = [_found(*[np.concatenate([p[k] for p in parts if "span_d" in p]) for k in ("doc_d", "twin", "span_d")])] if any("span_d" in p for p in parts) else []
    parts = [p | {"doc_d": p["doc_d"][p["who_d"]], "twin": p["twin"][p["who_d"]]} for p in parts if "anchor" in p]
    if parts:
        names = ("anchor", "content", "left", "right", "half", "doc_d", "twin", "first_d", "count", "lead")
        columns = [np.concatenate([p[k] for p in parts]) for k in names]
        order = np.lexsort((columns[5], columns[1], columns[0]))
        anchor, content, left, right, half, doc, twin, first, count, lead = (x[order] for x in columns)
        half, count, lead = (x.astype(np.int64) for x in (half, count, lead))
        group = _runs(anchor, content)
        whole = doc > doc[np.flatnonzero(np.diff(group, prepend=-1))][group]
        key = anchor.astype(np.int64) | (int(table.column("shard")[0].as_py()) << 32)
        checked = (np.bincount(group, whole)[group] > 0) & verify
        by_left = _shared(doc, ~whole & (lead >= half), left, anchor)
        by_right = _shared(doc, ~whole & (lead - count < half - 1), right, anchor)
        turn = np.clip(lead - half + 1, 0, count)  # windows before this one are left
        low, high = np.where(by_left, 0, turn), np.where(by_right, count, turn)
        some = (by_left | by_right) & (low < high)
        place = _runs(anchor)
        many = np.where((np.bincount(place, np.where(some, high - low, 0)) + np.bincount(place, checked))[place] > hot, _MANY, 0)
        if verify:
            c = np.flatnonzero(checked)
            out.append(_found(doc[c], twin[c], _spans(first[c], ((lead[c] | many[c] | np.where(whole[c], _MEMBER, _HEAD)) << 16) | count[c]), key[c]))
        else:
            out.append(_found(doc[whole], twin[whole], _spans(first[whole], first[whole] + count[whole] + WINDOW - 1)))
        o = np.flatnonzero(some)
        span = _spans(first[o] + low[o], ((lead[o] - low[o] | many[o]) << 16) | (high[o] - low[o]))
        out.append(_found(doc[o], twin[o], span, key[o]))
    return pa.concat_tables(out)


def _again(key: np.ndarray, doc: np.ndarray, lead: np.ndarray, body: list[bytes]) -> np.ndarray:
    """Which regions have the content, at the same distance from the same anchor, of one in a smaller document."""
    rows = list(zip(key.tolist(), lead.tolist(), body))
    least: dict[tuple[int, int, bytes], int] = {}
    for row, d in zip(rows, doc.tolist()):
        least[row] = min(d, least.get(row, d))
    return doc > np.fromiter((least[row] for row in rows), np.int64, len(rows))


def _compare(table: pa.Table, repeated: Callable) -> pa.Table:
    """One shard: the spans that tasks settled, and those of its open windows that a smaller document has too."""
    parts = [T.unpack(b.as_py()) for b in table.column("blob")]
    done = [p for p in parts if "span_d" in p]
    doc, twin, span = ([p[k] for p in done] for k in ("doc_d", "twin", "span_d"))
    spread = zstandard.ZstdDecompressor()
    parts = [(p, spread.decompress(x.as_py())) for p, x in zip(parts, table.column("body")) if "key" in p]
    if parts:
        key, d, t, first, count, lead = (np.concatenate([p[k] for p, _ in parts]) for k in ("key", "doc_d", "twin", "first_d", "count", "lead"))
        size, kind = (np.concatenate([p[k] for p, _ in parts]).astype(np.int64) for k in ("size", "kind"))
        count, lead, body, end = count.astype(np.int64), lead.astype(np.int64), b"".join([x for _, x in parts]), np.cumsum(size)
        cut = lambda at: [body[a:b] for a, b in zip((end - size)[at].tolist(), end[at].tolist())]
        c, o = np.flatnonzero(kind), np.flatnonzero(kind == 0)
        again = _again(key[c], d[c], lead[c], cut(c))
        if not again[kind[c] == _MEMBER].all():
            raise RuntimeError("different contents have the same hash; run again with another seed")
        w = c[again]
        found = [(d[w], t[w], first[w], first[w] + count[w] + WINDOW - 1)]
        if len(o):
            which, a, b = repeated(key[o], d[o], count[o], lead[o], b"".join(cut(o)) if len(c) else body, size[o])
            which = o[which]
            found.append((d[which], t[which], first[which] + a, first[which] + b))
        for f in found:
            for x, y in zip((doc, twin, span), _joined(*f)):
                x.append(y)
    doc, twin, span = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (doc, twin, span))
    return pa.table({"at": pa.array(doc), "twin": pa.array(twin), "span": pa.array(span)})


def squeezed(source: DataFrame) -> DataFrame:
    """``source`` with each text compressed; ``texts`` has them back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            buf, off = T.column(batch, "text")
            blobs = pa.array([squeeze.compress(buf[a:b]) for a, b in zip(off.tolist(), off[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([blobs if c == "text" else x for c, x in zip(batch.schema.names, batch.columns)], batch.schema.names)

    schema = ", ".join(f"{f.name} {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in source.schema)
    out = source.mapInArrow(T.released(run), schema)
    # keys that can't be null: joins put no filter between them and the shuffle, which is one for all joins then
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("at", "twin")})


def texts(batch: pa.RecordBatch) -> list[bytes]:
    spread = zstandard.ZstdDecompressor()
    return [spread.decompress(x) for x in batch.column("text").to_pylist()]


def copies(source: DataFrame) -> DataFrame:
    """(at, twin) of the rows of ``source`` (by with_twins) with the text of a document with a smaller id. No task gets all
    copies of a text: the least of each digest are taken away from all rows, by row."""
    rows = source.filter("doc_id is not null").select("at", "twin", F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("digest"))
    least = rows.groupBy("digest").agg(F.min(F.struct("at", "twin")).alias("m")).select("m.at", "m.twin")
    return rows.select("at", "twin").join(least, ["at", "twin"], "left_anti")


def opened(source: DataFrame, regions: Regions, cut_out: Callable, part: Callable, repeated: Callable, verify: bool = False, hot: int = HOT, small: DataFrame | None = None, again: DataFrame | None = None) -> DataFrame:
    """What has to be compared over all tasks, and what tasks have settled, as packed records for shards."""
    n = shards(source.sparkSession, source.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    # all columns and rows of small wherever it is joined, so that its texts are shuffled once for all
    small = squeezed(source) if small is None else small
    heads = small if again is None else small.join(again, ["at", "twin"], "left_anti")
    found = _send(heads, regions, n).groupBy("shard").applyInArrow(lambda t: _meet(t, verify, hot), _FOUND)
    asked = found.groupBy("at", "twin").agg(F.collect_list(F.struct("key", "span")).alias("asked"))
    def dealt(shard: np.ndarray, body: list[bytes] | None = None, **arrays: np.ndarray) -> pa.RecordBatch:
        batch = _deal(shard, **arrays)
        if body is None:
            bodies = pa.nulls(batch.num_rows, pa.binary())
        else:
            order = np.argsort(shard, kind="stable")
            edge = np.append(np.flatnonzero(np.diff(shard[order], prepend=-1)), len(order)).tolist()
            squeeze = zstandard.ZstdCompressor(level=1)
            bodies = pa.array([squeeze.compress(b"".join([body[k] for k in order[a:b].tolist()])) for a, b in zip(edge, edge[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns, bodies], ["shard", "blob", "body"])

    def settled(doc: np.ndarray, twin: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        doc, twin, span = _joined(doc, twin, start, end)
        return dealt((T.mix(doc.astype(np.uint64)) % np.uint64(n)).astype(np.int64), doc_d=doc, twin=twin, span_d=span)

    def onward(key: np.ndarray, doc: np.ndarray, twin: np.ndarray, first: np.ndarray, count: np.ndarray, lead: np.ndarray, kind: np.ndarray, many: np.ndarray, body: list[bytes]) -> pa.RecordBatch:
        size = np.fromiter(map(len, body), np.int64, len(body))
        where = key.astype(np.uint64)
        for k in np.flatnonzero(many).tolist():
            where[k] ^= np.uint64(xxhash.xxh3_64_intdigest(body[k]))
        numbers = {"count": count.astype(np.uint16), "lead": lead.astype(np.uint8), "kind": kind.astype(np.uint16), "size": size.astype(np.uint32)}
        return dealt((T.mix(where) % np.uint64(n)).astype(np.int64), body, key=key, doc_d=doc, twin=twin, first_d=first, **numbers)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, twins = batch.column("at").to_numpy(), batch.column("twin").to_numpy()
            raw = texts(batch)
            asks = batch.column("asked")
            values, edge = asks.flatten(), asks.offsets.to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(edge))
            open_, key, span = values.field("key").is_valid().to_numpy(zero_copy_only=False), values.field("key").fill_null(0).to_numpy(), values.field("span").to_numpy()
            whole = ~open_
            yield settled(ids[row[whole]], twins[row[whole]], span[whole] >> 32, span[whole] & 0xFFFFFFFF)
            row, key, span = row[open_], key[open_], span[open_]
            if not len(row):
                continue
            first, lead, count = span >> 32, (span >> 16) & 0xFFFF, span & 0xFFFF
            body: list[bytes] = []
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            for r in np.unique(row).tolist():
                a, b = edge[r], edge[r + 1]
                body += cut_out(np.frombuffer(raw[r], np.uint8), first[a:b], count[a:b])
            kind, many, lead = lead & (_MEMBER | _HEAD), lead & _MANY, lead & (_MANY - 1)
            c = np.flatnonzero(kind)
            if len(c):
                again = _again(key[c], ids[row[c]], lead[c], [body[k] for k in c.tolist()])
                w, c = c[again], c[~again]
                yield settled(ids[row[w]], twins[row[w]], first[w], first[w] + count[w] + WINDOW - 1)
                yield onward(key[c], ids[row[c]], twins[row[c]], first[c], count[c], lead[c], kind[c], many[c], [body[k] for k in c.tolist()])
                o = np.flatnonzero(kind == 0)
                row, key, first, lead, count, many, body = row[o], key[o], first[o], lead[o], count[o], many[o], [body[k] for k in o.tolist()]
                if not len(o):
                    continue
            size = np.fromiter(map(len, body), np.int64, len(body))
            which, a, b = repeated(key, ids[row], count, lead, b"".join(body), size)
            yield settled(ids[row[which]], twins[row[which]], first[which] + a, first[which] + b)
            # the other windows go on: as runs, or one by one where their anchor has many
            left = np.ones(int(count.sum()), dtype=bool)
            left[(np.cumsum(count) - count)[which] + a] = False
            region = np.repeat(np.arange(len(row)), count)
            step = np.arange(len(region)) - np.repeat(np.cumsum(count) - count, count)
            live = np.flatnonzero(left)
            head = np.flatnonzero(np.concatenate(([True], (np.diff(live) != 1) | (np.diff(region[live]) != 0) | (many[region[live[1:]]] > 0)))) if len(live) else live
            run, region, step = np.diff(np.append(head, len(live))), region[live[head]], step[live[head]]
            body = [body[k] if r == m else part(body[k], s, r) for k, s, r, m in zip(region.tolist(), step.tolist(), run.tolist(), count[region].tolist())]
            yield onward(key[region], ids[row[region]], twins[row[region]], first[region] + step, run, lead[region] - step, np.zeros(len(region), np.int64), many[region], body)

    met = small.join(asked, ["at", "twin"]).select(*source.columns, "asked")
    return met.mapInArrow(T.released(fetch), _BODIES)


def repeated_spans(source: DataFrame, regions: Regions, cut_out: Callable, part: Callable, repeated: Callable, verify: bool = False, hot: int = HOT, small: DataFrame | None = None, again: DataFrame | None = None) -> DataFrame:
    """(at, twin, spans) of the rows of ``source`` (by with_twins) that have repeats. small: ``source``, squeezed. again: the rows
    that are copies of others; they get the span WHOLE.

    cut_out(text bytes, first, windows) gives the contents of regions, part(content, first, windows) a content's part for
    some of its windows; repeated(key, doc, count, lead, contents, sizes) gives the regions' numbers and, in units from
    each region's first, the spans that repeat. hot changes where work is done, not what is found.
    """
    spans = opened(source, regions, cut_out, part, repeated, verify, hot, small, again).groupBy("shard").applyInArrow(lambda t: _compare(t, repeated), _SETTLED)
    if again is not None:
        spans = spans.unionByName(again.withColumn("span", F.lit(WHOLE).cast("long")))
    return spans.groupBy("at", "twin").agg(F.collect_list("span").alias("spans"))


def merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans as one: (starts, ends), in order."""
    spans = np.sort(spans)
    start, end = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    new = np.concatenate(([True], start[1:] > end[:-1])) if len(spans) else np.zeros(0, bool)
    last = np.concatenate((new[1:], [True])) if len(spans) else new
    return start[new], end[last]


def gone(listed: pa.Scalar, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of what the listed spans remove of a text of n units."""
    x = listed.values.to_numpy() if listed.values is not None else np.zeros(0, np.int64)
    if (x == WHOLE).any():
        x = _spans(np.zeros(1), np.full(1, n)) if n >= WINDOW else x[:0]
    return merged(x)


def with_twins(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(at, twin, doc_id, text, c0, c1, ...): at, the id (0 for a null one), and twin, a 64-bit hash of the text, tell rows
    apart unless both id and text are the same; the columns of ``carry`` follow under neutral names. Where an id is of one row
    its twin is 0, which packs to nothing."""
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    several = docs.groupBy(doc_id.alias("at")).agg(F.count("*").alias("n")).filter("n > 1 and at is not null")
    again = [r["at"] for r in several.limit(SEVERAL + 1).collect()]
    apart = F.lit(True) if len(again) > SEVERAL else doc_id.isNull() | doc_id.isin(again)
    twin = F.when(apart, F.xxhash64(text, doc_id.isNull())).otherwise(F.lit(0).cast("long"))
    key = [F.coalesce(doc_id, F.lit(0).cast("long")).alias("at"), twin.alias("twin")]
    return docs.select(*key, doc_id.alias("doc_id"), text.alias("text"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)])
