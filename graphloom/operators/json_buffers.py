"""JSON texts as flat arrays: all values of a batch of texts, found on the texts' Arrow buffer.

No text is parsed by itself.  Whole-buffer kernels find quotes, brackets and separators, number the
depth of each, look up the container around each token, and check the grammar by the place that a
token has among its siblings.  Texts that break it come out as having no root.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE, _OTHER, _OPEN, _CLOSE, _COMMA, _COLON = range(6)
_CLASS = np.full(256, _OTHER, np.int8)
_CLASS[[32, 9, 10, 13]] = _SPACE
_CLASS[[123, 91]] = _OPEN
_CLASS[[125, 93]] = _CLOSE
_CLASS[44], _CLASS[58] = _COMMA, _COLON
#: Kinds of values.
OBJECT, LIST, STRING, PLAIN = 0, 1, 2, 3
_PLAIN = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity)$"
_ESCAPED = r'^(?:[^\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*$'


def slices(data: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts between ordered places that don't overlap, without copying them one by one."""
    if not len(starts):
        return pa.array([], pa.string())
    offsets = np.empty(2 * len(starts), np.int64)
    offsets[0::2], offsets[1::2] = starts, ends
    every = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return every.take(pa.array(np.arange(0, len(offsets) - 1, 2))).cast(pa.string())


def decoded(raw: pa.Array) -> pa.Array:
    """String contents with their escapes replaced: those that have any are decoded together."""
    hit = np.flatnonzero(pc.match_substring(raw, "\\").to_numpy(zero_copy_only=False))
    if not len(hit):
        return raw
    values = json.loads('["' + '","'.join(raw.take(pa.array(hit)).to_pylist()) + '"]')
    values = [v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for v in values]
    mask = np.zeros(len(raw), bool)
    mask[hit] = True
    return pc.replace_with_mask(raw, pa.array(mask), pa.array(values, pa.string()))


def _last_before(groups: np.ndarray, places: np.ndarray, marks: np.ndarray, mark_groups: np.ndarray) -> np.ndarray:
    """For each place the last mark of its group before it, -1 without one; marks and places are token numbers."""
    if not len(marks):
        return np.full(len(places), -1)
    order = np.lexsort((marks, mark_groups))
    span = np.int64(max(places.max(initial=0), marks.max(initial=0)) + 1)
    keys = mark_groups[order] * span + marks[order]
    at = np.searchsorted(keys, groups * span + places, side="left") - 1
    found = np.where(at >= 0, order[np.maximum(at, 0)], -1)
    return np.where((found >= 0) & (mark_groups[found] == groups), marks[found], -1)


class Values:
    """kind, parent, key, start, end of each value; roots: the value of each text, -1 without one.

    parent: the value around it, -1 for a text's own; key: its name in an object, null elsewhere.
    Values of one parent follow each other in their order; of values with one key the last is kept.
    """

    def __init__(self, texts: list[bytes]):
        self.data = data = b"\n".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1] if len(texts) else np.zeros(0, np.int64)
        b = np.frombuffer(data, np.uint8)
        n = len(b)
        place = np.arange(n)
        # quotes that no odd run of backslashes stands before
        other = np.maximum.accumulate(np.where(b != 92, place, -1)) if n else place
        quote = np.flatnonzero(b == 34)
        before = np.where(quote > 0, quote - 1 - other[np.maximum(quote - 1, 0)], 0)
        quote = quote[before % 2 == 0]
        text_of_quote = np.searchsorted(begin, quote, side="right") - 1
        first = np.searchsorted(quote, begin)
        odd = (np.arange(len(quote)) - first[text_of_quote]) % 2 if len(quote) else np.zeros(0, np.int64)
        broken = np.zeros(len(texts), bool)
        broken[np.flatnonzero(np.diff(np.append(first, len(quote))) % 2)] = True
        # inside a string from an even quote up to the odd one behind it
        ok = ~broken[text_of_quote] if len(quote) else np.zeros(0, bool)
        opens, closes = quote[ok & (odd == 0)], quote[ok & (odd == 1)]
        edge = np.zeros(n + 1, np.int8)
        edge[opens] += 1
        edge[closes + 1] -= 1
        inside = np.cumsum(edge[:n]) > 0
        kind = np.where(inside, _SPACE, _CLASS[b])
        plain = kind == _OTHER
        starts_plain = np.flatnonzero(plain & ~np.concatenate([[False], plain[:-1]]))
        ends_plain = np.flatnonzero(plain & ~np.concatenate([plain[1:], [False]])) + 1
        marks = np.flatnonzero((kind >= _OPEN))
        # all tokens in order
        start = np.concatenate([marks, opens, starts_plain])
        end = np.concatenate([marks + 1, closes + 1, ends_plain])
        cls = np.concatenate([kind[marks], np.full(len(opens), 10, np.int8), np.full(len(starts_plain), 11, np.int8)])
        order = np.argsort(start, kind="stable")
        start, end, cls = start[order], end[order], cls[order]
        text = np.searchsorted(begin, start, side="right") - 1
        step = (cls == _OPEN).astype(np.int64) - (cls == _CLOSE)
        depth = np.cumsum(step)
        head = np.searchsorted(text, np.arange(len(texts)))
        base = np.concatenate([[0], depth])[head]
        depth = depth - base[text]
        level = np.where(cls == _OPEN, depth - 1, depth)
        last = np.append(head[1:], len(start)) - 1
        some = last >= head
        broken[~some] = True
        broken[some] |= depth[last[some]] != 0
        broken[text[level < 0]] = True
        token = np.arange(len(start))
        wide = np.int64(level.max(initial=0) + 3)
        group = text * wide + level + 1
        is_open = cls == _OPEN
        parent = _last_before(group, token, token[is_open], group[is_open] + 1)
        shut = np.flatnonzero(cls == _CLOSE)
        mate = _last_before(group[shut], shut, token[is_open], group[is_open])
        bad = (mate < 0) | (b[start[np.maximum(mate, 0)]] + 2 != b[start[shut]]) if len(shut) else np.zeros(0, bool)
        broken[text[shut[bad]]] = True
        finish = end.copy()
        finish[mate[~bad]] = end[shut[~bad]]
        # the place of each token among its siblings says what it must be
        seq = np.flatnonzero(cls != _CLOSE)
        seq = seq[np.lexsort((seq, parent[seq] + (parent[seq] < 0) * (-1 - text[seq])))]
        owner = np.where(parent[seq] >= 0, parent[seq], -1 - text[seq])
        fresh = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(seq) else np.zeros(0, bool)
        begins = np.flatnonzero(fresh)
        size = np.diff(np.append(begins, len(seq)))
        rank = np.arange(len(seq)) - np.repeat(begins, size)
        in_object = (owner >= 0) & (b[start[np.maximum(owner, 0)]] == 123) if len(seq) else fresh
        c = cls[seq]
        value = (c == _OPEN) | (c >= 10)
        r4 = rank % 4
        right = np.where(in_object, np.choose(r4, [c == 10, c == _COLON, value, c == _COMMA]), np.where(owner < 0, value & (rank == 0), np.where(rank % 2 == 0, value, c == _COMMA)))
        broken[text[seq[~right.astype(bool)]]] = True
        tail = begins + size - 1
        unended = np.where(in_object[begins], size % 4 != 3, (owner[begins] >= 0) & (size % 2 == 0))
        broken[text[seq[tail[unended]]]] = True
        rooted = np.zeros(len(texts), bool)
        rooted[text[seq[owner < 0]]] = True
        broken |= ~rooted
        is_plain, is_text = np.flatnonzero(cls == 11), np.flatnonzero(cls == 10)
        wrong = ~pc.match_substring_regex(slices(data, start[is_plain], end[is_plain]), _PLAIN).to_numpy(zero_copy_only=False)
        broken[text[is_plain[wrong]]] = True
        raw = slices(data, start[is_text] + 1, end[is_text] - 1)
        wrong = ~pc.match_substring_regex(raw, _ESCAPED).to_numpy(zero_copy_only=False)
        broken[text[is_text[wrong]]] = True
        # values of whole texts
        held = value & np.where(in_object, r4 == 2, True) & ~broken[text[seq]]
        rows = np.flatnonzero(held)
        tok = seq[rows]
        number = np.full(len(start), -1)
        name = np.where(in_object[rows], seq[np.maximum(rows - 2, 0)], -1)
        spot = np.full(len(start), -1)
        spot[is_text] = np.arange(len(is_text))
        keys = decoded(raw.take(pa.array(np.where(name >= 0, spot[np.maximum(name, 0)], 0), mask=name < 0))) if len(is_text) else pa.nulls(len(rows), pa.string())
        # of equal names in one object the last holds
        ids = pc.fill_null(pc.dictionary_encode(keys).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        own = owner[rows]
        last_of = np.lexsort((rows, ids, own))
        again = np.zeros(len(rows), bool)
        if len(rows) > 1:
            a, z = last_of[:-1], last_of[1:]
            again[a[(own[a] == own[z]) & (ids[a] == ids[z]) & (ids[a] >= 0)]] = True
        keep = np.flatnonzero(~again)
        tok, own = tok[keep], own[keep]
        self.keys = keys.take(pa.array(keep))
        number[tok] = np.arange(len(tok))
        self.parent = np.where(own >= 0, number[np.maximum(own, 0)], -1)
        lost = (own >= 0) & (self.parent < 0)  # below a value that another took the place of
        self.lost = lost
        self.start, self.end = start[tok], finish[tok]
        self.kind = np.where(cls[tok] == 10, STRING, np.where(cls[tok] == 11, PLAIN, np.where(b[start[tok]] == 123, OBJECT, LIST)))
        self.roots = np.full(len(texts), -1)
        self.roots[-1 - own[own < 0]] = np.flatnonzero(own < 0)
        self.strings = spot[tok]
        self.raw = raw
        # children of each value as lists: offsets over values ordered by parent
        kids = np.flatnonzero(self.parent >= 0)
        kids = kids[np.argsort(self.parent[kids], kind="stable")]
        offsets = np.searchsorted(self.parent[kids], np.arange(len(tok) + 1))
        self.children = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(kids, pa.int64()))

    def __len__(self) -> int:
        return len(self.kind)

    def text_of(self, rows: np.ndarray) -> pa.Array:
        """The contents of string values."""
        return decoded(self.raw.take(pa.array(self.strings[rows])))

    def source_of(self, row: int) -> bytes:
        return self.data[self.start[row] : self.end[row]]


class Forest:
    """The values of texts and of the JSON texts that their strings hold, in one numbering.

    ``opened`` leads from each value to what it counts as: a string that holds JSON to the value held.
    """

    def __init__(self, texts: list[bytes], depth: int = 16):
        self.parts: list[Values] = []
        self.begin: list[int] = []
        n, fresh, held = 0, texts, None
        opened = np.zeros(0, np.int64)
        for _ in range(depth + 1):
            v = Values(fresh)
            self.parts.append(v)
            self.begin.append(n)
            opened = np.concatenate([opened, n + np.arange(len(v))])
            if held is None:
                self.roots = v.roots
            else:
                good = v.roots >= 0
                opened[held[good]] = n + v.roots[good]
            strings = np.flatnonzero(v.kind == STRING)
            inner = pc.utf8_trim_whitespace(v.text_of(strings))
            some = np.flatnonzero(pc.match_substring_regex(inner, r'^[\[{"]').to_numpy(zero_copy_only=False)) if len(strings) else strings
            held = n + strings[some]
            n += len(v)
            fresh = [t.encode() for t in inner.take(pa.array(some)).to_pylist()] if len(some) else []
            if not fresh:
                break
        cat = lambda f: np.concatenate([f(p, b) for p, b in zip(self.parts, self.begin)])
        self.kind = cat(lambda p, b: p.kind)
        self.parent = cat(lambda p, b: np.where(p.parent >= 0, p.parent + b, -1))
        self.keys = pa.concat_arrays([p.keys for p in self.parts])
        self.children = pa.concat_arrays([pa.LargeListArray.from_arrays(p.children.offsets, pc.add(p.children.values, pa.scalar(b, pa.int64()))) for p, b in zip(self.parts, self.begin)])
        while True:  # JSON in JSON in JSON
            again = opened[opened]
            if (again == opened).all():
                break
            opened = again
        self.opened = opened

    def field(self, name: str) -> np.ndarray:
        """For each object the value of that name, -1 without one."""
        rows = np.flatnonzero(pc.fill_null(pc.equal(self.keys, name), False).to_numpy(zero_copy_only=False))
        out = np.full(len(self.kind), -1)
        rows = rows[self.parent[rows] >= 0]
        out[self.parent[rows]] = rows
        return out

    def _by_part(self, rows: np.ndarray, read) -> pa.Array:
        """read(part, its rows) of all rows, in their order."""
        part = np.searchsorted(self.begin, rows, side="right") - 1
        found, order = [], []
        for i, p in enumerate(self.parts):
            mine = np.flatnonzero(part == i)
            if len(mine):
                found.append(read(p, rows[mine] - self.begin[i]))
                order.append(mine)
        if not found:
            return pa.array([], pa.string())
        back = np.argsort(np.concatenate(order), kind="stable")
        return pa.concat_arrays(found).take(pa.array(back))

    def strings(self, rows: np.ndarray) -> pa.Array:
        return self._by_part(rows, lambda p, r: p.text_of(r))

    def written(self, rows: np.ndarray) -> pa.Array:
        """Plain values as they are written."""

        def read(p: Values, r: np.ndarray) -> pa.Array:
            one, where = np.unique(r, return_inverse=True)
            return slices(p.data, p.start[one], p.end[one]).take(pa.array(where))

        return self._by_part(rows, read)

    def whole(self, rows: np.ndarray) -> list:
        """Objects and lists as Python values."""
        part = np.searchsorted(self.begin, rows, side="right") - 1
        return [json.loads(self.parts[p].source_of(r - self.begin[p])) for p, r in zip(part.tolist(), rows.tolist())]

    def texts(self, rows: np.ndarray, plain, nested) -> pa.Array:
        """Values as text, null for rows below 0: strings as they are, whole numbers as written, others by ``plain`` and ``nested``."""
        out = np.full(len(rows), None, object)
        kind = np.where(rows >= 0, self.kind[np.maximum(rows, 0)], -1) if len(self.kind) else np.full(len(rows), -1)
        at = np.flatnonzero(kind == STRING)
        out[at] = self.strings(rows[at]).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(kind == PLAIN)
        if len(at):
            raw = self.written(rows[at])
            out[at] = raw.to_numpy(zero_copy_only=False)
            odd = at[~pc.match_substring_regex(raw, "^(?:0|-?[1-9][0-9]*)$").to_numpy(zero_copy_only=False)]
            out[odd] = [plain(json.loads(x)) for x in out[odd]]
        at = np.flatnonzero((kind == OBJECT) | (kind == LIST))
        if len(at):
            out[at] = [nested(x) for x in self.whole(rows[at])]
        return pa.array(out, pa.string())
