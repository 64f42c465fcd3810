"""The events of many plain documents at once, by array operations.

Plain are documents of ASCII without namespaces, comments, CDATA, instructions, declarations or a bare '>', whose
tags are closed in order and written as ``<name a="x" b="y">``. ``plain`` tells them apart; all others, and with
them whatever is wrong, are left to the tokenizer. Both make the same events.
"""

from __future__ import annotations

from collections.abc import Collection

import numpy as np
import pyarrow as pa

from ..config import EVENT_TYPES, ParserConfig

#: Deeper documents go through the tokenizer: each level costs a pass over the tags.
DEEPEST = 24
_START, _END, _TEXT, _SPACE, _FIRST, _LAST = (EVENT_TYPES.index(k) for k in ("start_element", "end_element", "characters", "space", "start_document", "end_document"))


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
_NAME_START, _NO_NAME = _table(_LETTERS), ~_table(_LETTERS + b"0123456789.-")
_BLANK, _STRANGE = _table(b" \t\r\n"), ~_table(bytes(range(32, 128)) + b"\t\r\n")


def pieces(data: pa.Buffer, lo: np.ndarray, hi: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The bytes lo..hi, in ascending order and apart from each other, as an array."""
    n = len(lo)
    ends = np.empty(2 * n + 1, np.int32)
    ends[0:-1:2], ends[1::2] = lo, hi
    ends[-1] = hi[-1] if n else 0
    both = pa.Array.from_buffers(kind, 2 * n, [None, pa.py_buffer(ends), data])
    return both.take(pa.array(np.arange(0, 2 * n, 2)))


class Plain:
    """The plain documents among ``docs`` (binary): ``owners`` are their places, ``rest`` those of the others."""

    def __init__(self, docs: pa.Array, config: ParserConfig):
        self.config = config
        off = np.frombuffer(docs.buffers()[1], np.int32)[docs.offset : docs.offset + len(docs) + 1]
        whole = docs.buffers()[2] or pa.py_buffer(b"")
        self.buffer = whole.slice(int(off[0]), int(off[-1] - off[0]))
        self.data, self.off = np.frombuffer(self.buffer, np.uint8), off.astype(np.int64) - int(off[0])
        self.bad = np.zeros(len(docs), bool)
        if config.mode != "xml" or config.scopes or docs.null_count:
            self.bad[:] = True
        if not self.bad.all():
            self._tags()
        self.owners, self.rest = np.flatnonzero(~self.bad), np.flatnonzero(self.bad)
        if len(self.owners):
            self._layout()

    def _drop(self, wrong: np.ndarray) -> None:
        """Leave out the documents of tags that are wrong."""
        if wrong.any():
            self.bad[self.doc[wrong]] = True
            keep = ~self.bad[self.doc]
            for k in ("lt", "gt", "doc", "end", "name", "stop", "own"):
                if k in self.__dict__:
                    setattr(self, k, getattr(self, k)[keep])

    def _tags(self) -> None:
        data, off = self.data, self.off
        strange = np.flatnonzero(_STRANGE[data])
        self.bad[np.searchsorted(off, strange, "right") - 1] = True
        lt, gt = np.flatnonzero(data == 60), np.flatnonzero(data == 62)
        n_lt, n_gt = np.diff(np.searchsorted(lt, off)), np.diff(np.searchsorted(gt, off))
        self.bad |= (n_lt != n_gt) | (n_lt == 0)
        self.lt, self.gt = lt[np.repeat(~self.bad, n_lt)], gt[np.repeat(~self.bad, n_gt)]
        self.doc = np.repeat(np.arange(len(n_lt)), np.where(self.bad, 0, n_lt))
        wrong = self.lt > self.gt
        wrong[1:] |= self.lt[1:] < self.gt[:-1]
        wrong |= self.gt - self.lt < 2
        self._drop(wrong)
        # names, and what follows them
        no_name = _NO_NAME[data]
        stops, rank = np.flatnonzero(no_name), np.cumsum(no_name, dtype=np.int32)
        self.end = data[self.lt + 1] == 47
        self.name = self.lt + 1 + self.end
        wrong = ~_NAME_START[data[self.name]]
        self._drop(wrong)
        self.stop = stops[rank[self.name]]
        self.own = (data[self.gt - 1] == 47) & ~self.end
        self._drop(np.where(self.end, self.stop != self.gt, self.stop > self.gt))
        self._attributes(stops, rank)
        if self.bad.all():
            return
        self._nesting()

    def _quotes(self) -> tuple[np.ndarray, np.ndarray]:
        q = np.flatnonzero(self.data == 34)
        t = np.searchsorted(self.lt, q, "right") - 1
        inside = (t >= 0) & (q < self.gt[t]) if len(self.lt) else np.zeros(len(q), bool)
        return q[inside], t[inside]

    def _attributes(self, stops: np.ndarray, rank: np.ndarray) -> None:
        data = self.data
        q, t = self._quotes()
        n = np.bincount(t, minlength=len(self.lt))
        wrong = (n % 2 == 1) | self.end & (n > 0) | ~self.end & (n == 0) & (self.stop != self.gt - self.own)
        if wrong.any():
            self._drop(wrong)
            q, t = self._quotes()
        while True:
            opens, closes, t = q[::2], q[1::2], t[::2]
            first = np.ones(len(t), bool)
            first[1:] = t[1:] != t[:-1]
            before = np.empty(len(t), np.int64)
            before[first] = self.stop[t[first]]
            rest = np.flatnonzero(~first)
            before[rest] = closes[rest - 1] + 1
            last = np.ones(len(t), bool)
            last[:-1] = first[1:]
            key = before + 1
            ok = (data[before] == 32) & (data[opens - 1] == 61) & (opens - 1 > key)
            key = np.where(ok, key, 0)
            ok &= _NAME_START[data[key]]
            key = np.where(ok, key, 0)
            ok[ok] = stops[rank[key[ok]]] == opens[ok] - 1
            ok &= ~last | (closes + 1 == self.gt[t] - self.own[t])
            if ok.all():
                codes, names = _encoded(pieces(self.buffer, key, opens - 1, pa.string()))
                ok &= np.array([x != "xmlns" for x in names], bool)[codes] if names else ok
                most = int(np.bincount(t).max()) if len(t) else 0
                for k in range(1, most):
                    ok[k:] &= (t[k:] != t[:-k]) | (codes[k:] != codes[:-k])
            if ok.all():
                break
            wrong = np.zeros(len(self.lt), bool)
            wrong[t[~ok]] = True
            self._drop(wrong)
            q, t = self._quotes()
        self.attr_tag, self.attr_codes, self.attr_names, self.opens, self.closes = t, codes, names, opens, closes

    def _nesting(self) -> None:
        """Depth of each tag, the start that each end closes and the element each stands in; documents whose tags
        don't match are found here, and the rest is done again without them."""
        while len(self.lt):
            codes, self.names = _encoded(pieces(self.buffer, self.name, self.stop, pa.string()))
            step = np.where(self.end, -1, np.where(self.own, 0, 1))
            sums = np.bincount(self.doc, weights=step, minlength=len(self.bad))
            wrong = sums[self.doc] != 0
            if not wrong.any():
                level = np.cumsum(step)
                wrong = level < 0
                depth = level + (self.end | self.own)
                wrong |= depth > DEEPEST
            if not wrong.any():
                at = np.arange(len(self.lt))
                opens = ~self.end & ~self.own
                inside = np.full(len(at), -1)  # the start that a tag stands in, or that it closes
                outer = np.full(len(at), -1)
                path = np.zeros(len(at), np.int64)
                paths: list[list[str]] = [[]]
                above = None
                for d in range(1, int(depth.max()) + 1):
                    here = depth == d
                    last = np.maximum.accumulate(np.where(opens & here, at, -1))
                    ends, starts = np.flatnonzero(here & self.end), np.flatnonzero(here & ~self.end)
                    inside[ends] = last[ends]
                    if above is not None:
                        inside[starts] = above[starts]
                    over = path[inside[starts]] if d > 1 else np.zeros(len(starts), np.int64)
                    keys, found = np.unique(over * len(self.names) + codes[starts], return_inverse=True)
                    path[starts] = found + len(paths)
                    paths += [[*paths[k // len(self.names)], self.names[k % len(self.names)]] for k in keys.tolist()]
                    path[ends] = path[last[ends]]
                    outer[starts], outer[ends] = inside[starts], inside[last[ends]]
                    above = last
                wrong = self.end & (codes != codes[inside])
            if not wrong.any():
                self.codes, self.depth, self.inside, self.outer, self.path, self.paths = codes, depth, inside, outer, path, paths
                break
            self.bad[self.doc[wrong]] = True
            keep = ~self.bad[self.doc]
            new = np.cumsum(keep) - 1
            kept = keep[self.attr_tag]
            self.attr_tag, self.attr_codes, self.opens, self.closes = new[self.attr_tag[kept]], self.attr_codes[kept], self.opens[kept], self.closes[kept]
            self._drop(wrong)

    def _layout(self) -> None:
        """Where each event stands: text before a tag, the tag, the end of one that closes itself; markers."""
        first = np.ones(len(self.doc), bool)
        first[1:] = self.doc[1:] != self.doc[:-1]
        starts, place = np.flatnonzero(first), np.cumsum(first) - 1
        lo = np.empty(len(first), np.int64)
        lo[1:] = self.gt[:-1] + 1
        lo[starts] = self.off[self.owners]
        gap = self.lt > lo
        tail_lo, tail_hi = self.gt[np.append(starts[1:], len(first)) - 1] + 1, self.off[self.owners + 1]
        tail, m = tail_hi > tail_lo, int(self.config.markers)
        count = gap + 1 + self.own
        before = np.cumsum(count) - count
        self.sizes = np.add.reduceat(count, starts) + tail + 2 * m
        base = np.cumsum(self.sizes) - self.sizes
        slot = base[place] + m + before - before[starts][place] + gap
        n = int(self.sizes.sum())
        kind = np.empty(n, np.int8)
        tag = np.full(n, -1)  # the tag of an event; of text, the tag behind it
        kind[slot], tag[slot] = np.where(self.end, _END, _START), np.arange(len(first))
        own = np.flatnonzero(self.own)
        kind[slot[own] + 1], tag[slot[own] + 1] = _END, own
        texts = np.flatnonzero(gap)
        ends = (base + self.sizes - 1 - m)[tail]
        kind[ends], kind[slot[texts] - 1], tag[slot[texts] - 1] = _TEXT, _TEXT, texts
        if m:
            kind[base], kind[base + self.sizes - 1] = _FIRST, _LAST
        lows, highs = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lows[slot[texts] - 1], highs[slot[texts] - 1] = lo[texts], self.lt[texts]
        lows[ends], highs[ends] = tail_lo[tail], tail_hi[tail]
        written = np.cumsum(~_BLANK[self.data], dtype=np.int32)
        is_text = np.flatnonzero(kind == _TEXT)
        blank = _BLANK[self.data[lows[is_text]]] & (written[lows[is_text]] == written[highs[is_text] - 1])
        kind[is_text[blank]] = _SPACE
        self.kind, self.tag, self.slot, self.lows, self.highs, self.base = kind, tag, slot, lows, highs, base
        off = [EVENT_TYPES.index(k) for k in self.config.disable]
        self.rows = np.flatnonzero(~np.isin(kind, off)) if off else None
        self.events_of = self.sizes if self.rows is None else np.bincount(np.repeat(np.arange(len(base)), self.sizes)[self.rows], minlength=len(base))

    def _at(self, x: np.ndarray) -> np.ndarray:
        return x if self.rows is None else x[self.rows]

    def columns(self, names: Collection[str], types: dict[str, pa.DataType]) -> dict[str, pa.Array]:
        """The columns with these names, of the events that the configuration asks for."""
        n, out = len(self.kind), {}
        kind, tag = self._at(self.kind), self._at(self.tag)
        is_tag, is_start = (kind == _START) | (kind == _END), kind == _START
        is_text = (kind == _TEXT) | (kind == _SPACE)
        element = is_tag | is_text
        doc_base = np.repeat(self.base, self.sizes)
        seq = self._at(np.arange(n) - doc_base)
        ints = lambda v, null, k: pa.array(v, types[k], mask=null)
        closed = (kind == _END) & self.own[tag] if len(tag) else tag  # the end of an element that closes itself
        for k in names:
            if k == "seq":
                out[k] = pa.array(seq, types[k])
            elif k == "event_type":
                out[k] = pa.array(EVENT_TYPES, pa.string()).take(pa.array(kind))
            elif k in ("name", "local"):
                out[k] = pa.array(self.names, pa.string()).take(pa.array(self.codes[tag], mask=~is_tag))
            elif k == "prefix":
                out[k] = pa.array([""], pa.string()).take(pa.array(np.zeros(len(kind), np.int8), mask=~is_tag))
            elif k == "content":
                at = np.flatnonzero(is_text)
                places = np.cumsum(is_text) - 1
                out[k] = pieces(self.buffer, self._at(self.lows)[at], self._at(self.highs)[at], pa.string()).take(pa.array(places, mask=~is_text))
            elif k in ("line", "line_start", "pos"):
                if self.config.positions == "none" or self.config.positions == "line_only" and k != "line":
                    out[k] = pa.nulls(len(kind), types[k])
                    continue
                at = np.where(is_text, self._at(self.lows), self.lt[tag] + 1 + ((kind == _END) & ~closed))
                origin = self._at(np.repeat(self.off[self.owners], self.sizes))
                if k == "pos":
                    out[k] = ints(at - origin, ~element, k)
                    continue
                breaks = np.flatnonzero(self.data == 10)
                over, own = np.searchsorted(breaks, at), np.searchsorted(breaks, origin)
                if k == "line":
                    out[k] = ints(over - own + 1, ~element, k)
                else:
                    out[k] = ints(np.where(over > own, breaks[over - 1] + 1 - origin, 0) if len(breaks) else np.zeros(len(kind), np.int64), ~element, k)
            elif k == "depth":
                depth = np.where(is_text, self._text_depth(tag), self.depth[tag])
                out[k] = ints(depth, ~element, k)
            elif k in ("elem_id", "parent_id"):
                own, around = self._owners(kind, tag, is_text, closed)
                at = own if k == "elem_id" else around
                at = np.where(element, at, -1)
                place = self.slot[at] - self._at(doc_base)
                out[k] = ints(place, at < 0, k)
            elif k == "path":
                held, _ = self._owners(kind, tag, is_text, closed)
                out[k] = pa.array(self.paths, types[k]).take(pa.array(np.where(held < 0, 0, self.path[held]), mask=~element))
            elif k == "attrs":
                count = np.bincount(self.attr_tag, minlength=len(self.lt))
                first = np.cumsum(count) - count
                # tags come in order, so the attributes of the starts that are kept do too
                ends = np.where(is_start, count[tag], 0)
                if len(self.attr_tag) != ends.sum():
                    own = np.flatnonzero(np.isin(self.attr_tag, tag[is_start]))
                else:
                    own = np.arange(len(first[:0]) + len(self.attr_tag))
                names_ = pa.array(self.attr_names, pa.string()).take(pa.array(self.attr_codes[own]))
                none = pa.nulls(len(own), pa.string())
                empty = pa.array([""], pa.string()).take(pa.array(np.zeros(len(own), np.int8)))
                value = pieces(self.buffer, self.opens[own] + 1, self.closes[own], pa.string())
                both = pa.StructArray.from_arrays([names_, value, empty, names_, none], fields=list(types[k].value_type))
                out[k] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(ends)), pa.int32()), both, type=types[k], mask=pa.array(~is_start))
            else:
                out[k] = pa.nulls(len(kind), types[k])
        return out

    def _text_depth(self, tag: np.ndarray) -> np.ndarray:
        """Text stands before its tag: in the element that this closes, or in the one that this is opened in."""
        return np.where(tag < 0, 0, self.depth[tag] - ~self.end[tag])

    def _owners(self, kind, tag, is_text, closed) -> tuple[np.ndarray, np.ndarray]:
        """For each event the start tag it belongs to and the one around it, or -1."""
        inside = np.where(tag < 0, -1, self.inside[tag])
        own = np.where(is_text, inside, np.where((kind == _START) | closed, tag, inside))
        return own, np.where(is_text, inside, self.outer[tag])


def _encoded(values: pa.Array) -> tuple[np.ndarray, list[str]]:
    d = values.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary.to_pylist()
