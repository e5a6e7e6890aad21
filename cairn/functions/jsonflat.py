"""Nested JSON texts of an Arrow array into flat rows, by kernels over the array's buffers.

The value buffer of a whole batch is classified byte by byte at once.  Brackets outside
strings become containers; their levels are a running sum, the list positions of their
elements are counts between separators (list offsets), and the container around each is
found per level (parent indexes).  Keys and paths then go down level by level with
vectorised ``take`` and join kernels.  No row is parsed by itself.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STRUCT = np.zeros(256, bool)
_STRUCT[[ord(c) for c in "{}[],:"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in " \t\n\r"]] = True
_ESCAPED = np.zeros(256, bool)
_ESCAPED[[ord(c) for c in '"\\/bfnrtu']] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_OPENS = np.zeros(256, bool)
_OPENS[[ord("{"), ord("[")]] = True
_CLOSES = np.zeros(256, bool)
_CLOSES[[ord("}"), ord("]")]] = True
_SCALAR = r"^[ \t\n\r]*(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)[ \t\n\r]*$"


def _spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans (rising, not overlapping) as a binary array over ``buf``, without a copy."""
    if not len(start):
        return pa.array([], pa.binary())
    flat = np.empty(2 * len(start), np.int32)
    flat[0::2], flat[1::2] = start, end
    every = pa.Array.from_buffers(pa.binary(), len(flat) - 1, [None, pa.py_buffer(flat), pa.py_buffer(buf)])
    return every.take(pa.array(np.arange(0, len(flat) - 1, 2)))


def _unquote(texts: pa.Array) -> pa.Array:
    """JSON strings, quotes included, as what they say; those with escapes are decoded by one call for all."""
    plain = pc.utf8_slice_codeunits(texts, 1, -1)
    odd = pc.match_substring(texts, "\\")
    if not len(texts) or not pc.any(odd).as_py():
        return plain
    said = json.loads("[" + ",".join(texts.filter(odd).to_pylist()) + "]", strict=False)
    return pc.replace_with_mask(plain, odd, pa.array([x.encode("utf-8", "replace").decode() for x in said], pa.string()))


class Flat:
    """Containers of a batch of JSON texts, and the rows made from them."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.string()) if texts.type != pa.string() else texts
        n = len(texts)
        off = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
        data = texts.buffers()[2] if n else None
        base = off[0]
        b = np.frombuffer(data, np.uint8, int(off[-1] - base), int(base)) if data is not None and off[-1] > base else np.zeros(0, np.uint8)
        self.b, self.n, self.off = b, n, off - base
        self.null = np.asarray(texts.is_null()) if n else np.zeros(0, bool)
        self.bad = np.zeros(n, bool)
        self._tokens()
        self._grammar()
        self._containers()

    def _row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, "right") - 1

    def _tokens(self) -> None:
        b, off = self.b, self.off
        quote = b == 34
        slash = np.flatnonzero(b == 92)
        if len(slash):
            row = self._row(slash)
            fresh = np.ones(len(slash), bool)
            fresh[1:] = (np.diff(slash) != 1) | (row[1:] != row[:-1])
            nth = np.arange(len(slash)) - np.maximum.accumulate(np.where(fresh, np.arange(len(slash)), 0))
            start = slash[nth % 2 == 0]
            row = row[nth % 2 == 0]
            inside = start + 1 < off[row + 1]
            self.bad[row[~inside]] = True
            start, row = start[inside], row[inside]
            quote[start + 1] = False
            self.escapes = (start, row)
        else:
            self.escapes = (slash, slash)
        self.q = np.flatnonzero(quote)
        count = np.concatenate([[0], np.cumsum(quote, dtype=np.int32)])
        self.qcount = count
        at_row = count[off]
        self.bad |= (at_row[1:] - at_row[:-1]) % 2 == 1
        parity = (count[1:] - np.repeat(at_row[:-1], np.diff(off))) & 1
        instr = parity.astype(bool)
        control = np.flatnonzero(instr & (b < 32))
        self.bad[self._row(control)] = True
        token = _STRUCT[b] & ~instr
        self.bare = np.concatenate([[0], np.cumsum(~instr & ~token & ~quote & ~_BLANK[b], dtype=np.int32)])
        pos = np.flatnonzero(token)
        self.pos, self.tok, self.row = pos, b[pos], self._row(pos)
        start, row = self.escapes
        if len(start):
            nxt = b[start + 1]
            wrong = ~_ESCAPED[nxt] | ~instr[start]
            u = start[nxt == 117]
            if len(u):
                ru = row[nxt == 117]
                ok = u + 5 < off[ru + 1]
                for k in (2, 3, 4, 5):
                    ok &= _HEX[b[np.minimum(u + k, len(b) - 1)]]
                self.bad[ru[~ok]] = True
            self.bad[row[wrong]] = True

    def _grammar(self) -> None:
        """Marks the rows that aren't one valid JSON value; a scalar alone holds no objects and is left out too."""
        opens, closes = _OPENS[self.tok], _CLOSES[self.tok]
        run = np.cumsum(opens.astype(np.int32) - closes)
        ends = np.searchsorted(self.row, np.arange(self.n + 1))
        before = np.concatenate([[0], run])[ends[:-1]]
        after = np.concatenate([[0], run])[ends[1:]]
        self.bad |= (after != before) | (ends[1:] == ends[:-1]) | self.null
        depth = run - before[self.row]
        low = depth < 0
        last = np.zeros(len(depth), bool)
        some = ends[1:] > ends[:-1]
        last[ends[1:][some] - 1] = True
        low |= (depth == 0) & ~last
        self.bad[self.row[low]] = True
        good = ~self.bad[self.row]
        self.pos, self.tok, self.row, depth = self.pos[good], self.tok[good], self.row[good], depth[good]
        opens, closes = _OPENS[self.tok], _CLOSES[self.tok]
        self.opens, self.level = opens, np.where(closes, depth, depth - 1)
        n = len(self.pos)
        order = np.argsort(self.level, kind="stable")
        held = np.maximum.accumulate(np.where(opens[order], np.arange(n), 0)) if n else order
        self.cont = np.empty(n, np.int64)
        self.cont[order] = order[held]
        match = self.tok[self.cont]
        wrong = closes & (self.tok - match != 2)  # "}" and "]" lie two above "{" and "["
        first = np.ones(n, bool)
        first[1:] = self.row[1:] != self.row[:-1]
        left = np.where(first, self.off[self.row], np.concatenate([[0], self.pos[:-1] + 1]))
        bare = self.bare[self.pos] - self.bare[left]
        quotes = self.qcount[self.pos] - self.qcount[left]
        empty, string = (bare == 0) & (quotes == 0), (bare == 0) & (quotes == 2)
        maybe = np.flatnonzero((bare > 0) & (quotes == 0))
        value = string.copy()
        if len(maybe):
            value[maybe] = np.asarray(pc.match_substring_regex(_spans(self.b, left[maybe], self.pos[maybe]), _SCALAR))
        prev = np.concatenate([[0], self.tok[:-1]])
        prev[first] = 0
        inobj = match == ord("{")
        comma, colon = self.tok == ord(","), self.tok == ord(":")
        p_open, p_list, p_close, p_colon, p_comma = (prev == ord("{")), (prev == ord("[")), _CLOSES[prev], prev == ord(":"), prev == ord(",")
        # An open token lies in the container of the token before it.
        where_obj = np.concatenate([[False], inobj[:-1]]) if n else inobj
        ok = np.select(
            [first, p_open, p_list, p_close, p_colon, p_comma & where_obj, p_comma],
            [
                opens & empty,
                ((self.tok == ord("}")) & empty) | (colon & string),
                ((self.tok == ord("]")) & (empty | value)) | (comma & value) | (opens & empty),
                (comma | closes) & empty,
                ((comma | closes) & value) | (opens & empty),
                colon & string,
                (comma & value) | ((self.tok == ord("]")) & value) | (opens & empty),
            ],
            False,
        )
        self.bad[self.row[wrong | ~ok]] = True
        ends = np.searchsorted(self.row, np.arange(self.n + 1))
        some = np.flatnonzero(ends[1:] > ends[:-1])
        tail, stop = self.pos[ends[1:][some] - 1] + 1, self.off[some + 1]
        self.bad[some[(self.bare[stop] > self.bare[tail]) | (self.qcount[stop] > self.qcount[tail])]] = True
        self.string = string

    def _containers(self) -> None:
        """Parent, list position and key of each container, by level."""
        good = ~self.bad[self.row]
        at = np.flatnonzero(self.opens & good)
        self.at = at  # token of each container
        m = len(at)
        place = np.full(len(self.pos) + 1, -1, np.int64)
        place[at] = np.arange(m)
        level = self.level[at]
        parent, index = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
        commas = np.flatnonzero((self.tok == ord(",")) & good)
        clevel = self.level[commas]
        self.levels = []
        upper = None
        for k in range(int(level.max()) + 1 if m else 0):
            mine = np.flatnonzero(level == k)
            if upper is not None:
                p = upper[np.searchsorted(at[upper], at[mine]) - 1]
                parent[mine] = p
                c = commas[clevel == k - 1]
                index[mine] = np.searchsorted(c, at[mine]) - np.searchsorted(c, at[p])
            self.levels.append(mine)
            upper = mine
        self.parent, self.index = parent, index
        self.is_obj = self.tok[at] == ord("{")
        inobj = (parent >= 0) & self.is_obj[np.maximum(parent, 0)]
        self.keyed = inobj
        self.key = self._keys(at[inobj] - 1)
        self.keyrank = np.cumsum(inobj) - 1
        self.crow = self.row[at]
        self.place = place

    def _keyspan(self, colon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.q, self.pos[colon]) - 1
        return self.q[k - 1] + 1, self.q[k]

    def _keys(self, colon: np.ndarray) -> pa.Array:
        s, e = self._keyspan(colon) if len(colon) else (colon, colon)
        return _unquote(_spans(self.b, s - 1, e + 1).cast(pa.string()))

    def colons(self) -> tuple[np.ndarray, np.ndarray]:
        """The token of each key of a valid text, and the container it lies in."""
        colon = np.flatnonzero(self.tok == ord(":"))
        colon = colon[~self.bad[self.row[colon]]]
        return colon, self.place[self.cont[colon]]

    def values(self, colon: np.ndarray) -> pa.Array:
        """What follows each of these tokens (rising): strings decoded, others as written, null for null."""
        out = pa.nulls(len(colon), pa.string())
        opens = self.opens[colon + 1] if len(colon) else np.zeros(0, bool)
        flat = np.flatnonzero(~opens)
        if len(flat):
            raw = pc.utf8_trim(_spans(self.b, self.pos[colon[flat]] + 1, self.pos[colon[flat] + 1]).cast(pa.string()), " \t\n\r")
            quoted = pc.starts_with(raw, '"')
            said = pc.replace_with_mask(raw, quoted, _unquote(raw.filter(quoted)))
            said = pc.if_else(pc.and_(pc.invert(quoted), pc.equal(raw, "null")), pa.scalar(None, pa.string()), said)
            out = pc.replace_with_mask(out, pa.array(~opens), said)
        if opens.any():
            out = pc.replace_with_mask(out, pa.array(opens), self.texts(self.place[colon[opens] + 1]))
        return out

    def texts(self, which: np.ndarray) -> pa.Array:
        """The JSON of these containers; containers of one level don't overlap, so a level is one span array."""
        start, end, level = self.pos[self.at[which]], self.close_of(which), self.level[self.at[which]]
        order = np.lexsort((start, level))
        cut = np.flatnonzero(np.diff(level[order])) + 1
        parts = [_spans(self.b, start[x], end[x]) for x in np.split(order, cut) if len(x)]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return pa.concat_arrays(parts).take(pa.array(back)).cast(pa.string()) if parts else pa.array([], pa.string())

    def fields(self, owners: np.ndarray, names: tuple[str, ...]) -> dict[str, pa.Array]:
        """The value of each name in each of these objects (rising), null where it is missing; of repeated keys the last."""
        slot = np.full(len(self.at), -1, np.int64)
        slot[owners] = np.arange(len(owners))
        colon, owner = self.colons()
        mine = slot[owner] >= 0
        colon, owner = colon[mine], owner[mine]
        keys = self._keys(colon)
        out = {}
        for n in names:
            hit = np.flatnonzero(np.asarray(pc.equal(keys, n))) if len(keys) else np.zeros(0, np.int64)
            at = np.full(len(owners), -1, np.int64)
            at[slot[owner[hit]]] = np.arange(len(hit))
            out[n] = self.values(colon[hit]).take(pa.array(at, mask=at < 0))
        return out

    def close_of(self, which: np.ndarray) -> np.ndarray:
        """The byte after each container."""
        closes = np.flatnonzero(_CLOSES[self.tok])
        end = np.empty(len(self.pos), np.int64)
        end[self.cont[closes]] = self.pos[closes] + 1
        return end[self.at[which]]


def heads(texts: pa.Array, names: tuple[str, ...], inner: str, counters: tuple[str, ...]) -> dict[str, pa.Array | np.ndarray]:
    """One row per text that is a valid object or list: row, ``names`` of the object and ``counters`` of its object ``inner``."""
    f = Flat(texts)
    top = np.flatnonzero(f.level[f.at] == 0)
    sub = np.flatnonzero(f.keyed & f.is_obj & (f.level[f.at] == 1))
    sub = sub[np.asarray(pc.equal(f.key.take(pa.array(f.keyrank[sub])), inner))] if len(sub) else sub
    at = np.full(len(f.at), -1, np.int64)
    at[f.parent[sub]] = np.arange(len(sub))
    at = pa.array(at[top], mask=at[top] < 0)
    below = f.fields(sub, counters)
    return {"row": f.crow[top]} | f.fields(top, names) | {c: x.take(at) for c, x in below.items()}


def flatten(texts: pa.Array, messages: bool = True, json_too: bool = False, names: tuple[str, ...] = ()) -> dict[str, pa.Array | np.ndarray]:
    """Rows for the objects that are list elements at any depth: row, path, parent_path, block, json and ``names``.

    ``names`` are fields of content elements; a ``content`` that is a string says it as ``text``.

    ``messages`` treats texts as messages: where the ``content`` of the text or of an
    element of a ``content`` list is a string or an object it counts as a list of one, and
    where the ``input`` of such an element is a string it counts as the object it encodes.
    Texts that aren't valid JSON give no rows.
    """
    f = Flat(texts)
    m = len(f.at)
    path = np.full(m, None, object)
    path, around = pa.nulls(m, pa.string()), pa.nulls(m, pa.string())
    emitted, context, in_content = np.zeros(m, bool), np.zeros(m, bool), np.zeros(m, bool)
    is_content = np.zeros(m, bool)
    if m and messages:
        is_content[f.keyed] = np.asarray(pc.equal(f.key, "content"))
    join = lambda *x: pc.binary_join_element_wise(*x, "")
    done, parts_p, parts_a = [], [], []
    where = np.full(m, -1, np.int64)  # place in the concatenated levels
    upto = 0
    for k, mine in enumerate(f.levels):
        if k == 0:
            context[mine] = f.is_obj[mine] & messages
            p = pa.array([""] * len(mine), pa.string())
            a = p
        else:
            up = f.parent[mine]
            last_p, last_a = parts_p[-1], parts_a[-1]
            at = pa.array(where[up] - (upto - len(last_p)))
            pp, pa_ = last_p.take(at), last_a.take(at)
            keyed = f.keyed[mine]
            keys = f.key.take(pa.array(np.maximum(f.keyrank[mine], 0))) if len(f.key) else pa.array([""] * len(mine), pa.string())
            single = keyed & is_content[mine] & context[up] & f.is_obj[mine]
            in_content[mine] = keyed & is_content[mine] & context[up] & ~f.is_obj[mine]
            idx = join(pa.array(["["] * len(mine)), pa.array(f.index[mine]).cast(pa.string()), pa.array(["]"] * len(mine)))
            dot = pc.if_else(pc.equal(pp, ""), "", ".")
            tail = pc.if_else(pa.array(single), "[0]", "")
            p = pc.if_else(pa.array(keyed), join(pp, dot, keys, tail), join(pp, idx))
            emitted[mine] = single | (~keyed & f.is_obj[mine])
            context[mine] = single | (~keyed & f.is_obj[mine] & in_content[up])
            a = pa_
        where[mine] = upto + np.arange(len(mine))
        upto += len(mine)
        parts_p.append(p)
        # What lies in an emitted object has it around; the object itself keeps what is around it.
        parts_a.append(pc.if_else(pa.array(emitted[mine]), p, a))
        done.append(a)
    rows, paths, parents, texts_, lists = [], [], [], [], []
    named: dict[str, list[pa.Array]] = {n: [] for n in names}

    def add(got: dict[str, pa.Array], n: int) -> None:
        for name, x in named.items():
            x.append(got.get(name, pa.nulls(n, pa.string())))

    if m:
        all_p, all_in, all_a = pa.concat_arrays(parts_p), pa.concat_arrays(parts_a), pa.concat_arrays(done)
        sel = np.flatnonzero(emitted)
        at = pa.array(where[sel])
        rows.append(f.crow[sel])
        paths.append(all_p.take(at))
        parents.append(all_a.take(at))
        lists.append(in_content[np.maximum(f.parent[sel], 0)] | (f.keyed[sel] & is_content[sel]))
        if json_too:
            texts_.append(f.texts(sel))
        if names:
            add(f.fields(sel, names), len(sel))
    if m and messages and context.any():
        colon, owner = f.colons()
        inside = f.string[colon + 1] & context[owner]
        colon, owner = colon[inside], owner[inside]
        keys = f._keys(colon)
        base, ring = all_p.take(pa.array(where[owner])), all_in.take(pa.array(where[owner]))
        quote = lambda w: np.searchsorted(f.q, f.pos[colon[w]])
        raw = lambda w: _spans(f.b, f.q[quote(w)], f.q[quote(w) + 1] + 1).cast(pa.string())
        one = np.flatnonzero(np.asarray(pc.equal(keys, "content")))
        if len(one):
            b, r = base.take(pa.array(one)), ring.take(pa.array(one))
            rows.append(f.crow[owner[one]])
            paths.append(join(b, pc.if_else(pc.equal(b, ""), "content[0]", ".content[0]")))
            parents.append(r)
            lists.append(np.ones(len(one), bool))
            if json_too:
                texts_.append(raw(one))
            if names:
                add({"text": _unquote(raw(one))}, len(one))
        top = f.parent[owner] < 0
        coded = np.flatnonzero(np.asarray(pc.equal(keys, "input")) & ~top)
        if len(coded):
            said = _unquote(raw(coded))
            said = pc.if_else(pc.starts_with(pc.utf8_ltrim(said, " \t\n\r"), "{"), said, pa.scalar(None, pa.string()))
            inner = flatten(said, False, json_too)
            src = coded[inner["row"]]
            b, r = base.take(pa.array(src)), ring.take(pa.array(src))
            pre = join(b, pc.if_else(pc.equal(b, ""), "input.", ".input."))
            rows.append(f.crow[owner[src]])
            paths.append(join(pre, inner["path"]))
            parents.append(pc.if_else(pc.equal(inner["parent_path"], ""), r, join(pre, inner["parent_path"])))
            lists.append(np.zeros(len(src), bool))
            if json_too:
                texts_.append(inner["json"])
            if names:
                add({}, len(src))
    cat = lambda x: pa.concat_arrays(x) if x else pa.array([], pa.string())
    out = {"row": np.concatenate(rows) if rows else np.zeros(0, np.int64), "path": cat(paths), "parent_path": cat(parents), "block": np.concatenate(lists) if lists else np.zeros(0, bool), "valid": ~f.bad}
    if json_too:
        out["json"] = cat(texts_)
    return out | {n: cat(x) for n, x in named.items()}
