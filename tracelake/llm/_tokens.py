"""Ids of a tokenizer for whole texts, worked out once per distinct unit of a task.

A unit is white space and the characters after it (``_text.pre_chunks``): the pre-tokenizers used here never
match across its start, so a text's ids are its units' ids one after another.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np

from . import _text as T

#: Units a worker remembers, and the longest one it keeps; others are worked out again.
KEPT_UNITS, KEPT_BYTES = 400_000, 64
#: Units that go to a byte-level tokenizer as one text.
JOINED = 256


class Units:
    """encode: a list of distinct units to one value each. The values of known units are kept, up to a bound."""

    def __init__(self, encode: Callable[[list[bytes]], list]):
        self.encode, self.known = encode, {}

    def of(self, units: list[bytes]) -> list:
        known = self.known
        got = list(map(known.get, units))
        new = {u for u, v in zip(units, got) if v is None}
        if new:
            order = list(new)
            fresh = dict(zip(order, self.encode(order)))
            got = [fresh[u] if v is None else v for u, v in zip(units, got)]
            if len(known) + len(fresh) > KEPT_UNITS:
                known.clear()
            known.update((u, v) for u, v in fresh.items() if len(u) <= KEPT_BYTES)
        return got


def _joinable(unit: str) -> bool:
    """Whether a unit's ids stay the same when other such units stand before and after it."""
    return unit[0] in " \t\n\r\x0b\x0c" and not unit[-1].isspace()


def id_bytes(tokenizer) -> Units:
    """Ids as little-endian unsigned 32-bit integers, by a byte-level tokenizers.Tokenizer.

    Many units go to the library as one text; the ids are cut apart where the bytes they stand for add up.
    """
    vocab = tokenizer.get_vocab()
    size = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
    for token, i in vocab.items():
        size[i] = len(token)  # one character a byte

    def encode(units: list[bytes]) -> list[bytes]:
        texts = [u.decode() for u in units]
        together = [k for k, t in enumerate(texts) if t and _joinable(t)]
        groups = [together[k : k + JOINED] for k in range(0, len(together), JOINED)]
        groups += [[k] for k in sorted(set(range(len(units))) - set(together))]
        out = [b""] * len(units)
        for group, got in zip(groups, tokenizer.encode_batch_fast(["".join(texts[k] for k in g) for g in groups], add_special_tokens=False)):
            ids = np.array(got.ids, dtype="<u4")
            at = np.searchsorted(np.cumsum(size[ids]), np.cumsum([len(units[k]) for k in group]), "left") + 1 if len(ids) else [0] * len(group)
            raw, a = ids.tobytes(), 0
            for k, b in zip(group, at):
                out[k] = raw[4 * a : 4 * b]
                a = b
        return out

    return Units(encode)


def distinct(buf: np.ndarray, start: np.ndarray, skip: np.ndarray | int = 0) -> tuple[list[bytes], np.ndarray]:
    """(distinct units, each unit's number among them), by 64-bit hashes of the units of one chunk.
    skip: bytes at each unit's front that are left off."""
    end = np.append(start[1:], len(buf))
    raw, front = buf.tobytes(), start + skip
    first, which = T.number(T.hashes(buf, front, end))
    return [raw[a:b] for a, b in zip(front[first].tolist(), end[first].tolist())], which


def of_rows(buf: np.ndarray, off: np.ndarray, units: Units) -> Iterator[np.ndarray]:
    """The ids of every row."""
    for i, j in T.slices(off):
        part, rows = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        start = T.pre_chunks(part, rows)
        parts, which = distinct(part, start)
        values = units.of(parts)
        flat = np.frombuffer(b"".join(values), "<u4")
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        size = sizes[which]
        done = np.concatenate(([0], np.cumsum(size)))
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - done[:-1], size) + np.arange(done[-1])]
        first = done[np.searchsorted(start, rows)].tolist()
        for a, b in zip(first, first[1:]):
            yield ids[a:b]


def from_file(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def from_ranks(ranks: dict[bytes, int], pattern: str):
    """A byte-level BPE tokenizer with the ids of a rank table.

    Ranks say which joined pair comes first, whatever its halves are; so each way of cutting a token
    into two tokens becomes a merge, ordered by the token's rank and then by the length of its left part.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    char = byte_characters()
    name = {t: "".join(char[b] for b in t) for t in ranks}
    merges = [(name[t[:k]], name[t[k:]]) for t in sorted(ranks, key=ranks.get) if len(t) > 1 for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    tokenizer = Tokenizer(models.BPE(vocab={name[t]: i for t, i in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tokenizer
