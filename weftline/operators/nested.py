"""Nested records to related flat tables, by path-value-ordinal triples.

Each record's text is read once by a streaming tokenizer; no record is decoded into a tree. Every leaf becomes a triple: its path, its value and
the entry of its nearest repeated ancestor it belongs to (the ordinal, which leads through the ancestors' entries to all positions above).
Triples are held grouped by repeated ancestor; each group is then pivoted into one table, whose columns are the group's paths and the paths
of the ancestors above it, which its entries reach by their parent links. A record lies in one row, so grouping and pivoting are local to the Arrow
batch and nothing is shuffled. :func:`triples` gives the triples themselves for records whose paths aren't known, :func:`flat_table` one table and
:func:`flat_tables` several from one pass.

Defined results:
* null text, an empty text or text that isn't valid JSON (also ``NaN``/``Infinity`` tokens, and nesting deeper than
  Python's stack) gives no rows and is not listed anywhere;
* a repeated node that holds an object instead of a list is a list of one (ordinal 0); null entries count as positions
  and give a row without values only where ``keep_empty`` is set;
* text that holds JSON text (encoded twice) is read again; an object that only wraps the list is unwrapped;
* a list or object where a leaf is asked for gives null there; numbers asked for as text come out as they are written;
* equal records repeated give equal rows again; a member given twice holds its last value;
* the key columns are carried as they are; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\Z")
ROWS_OUT = 65_536
KINDS = {"string": (T.StringType(), pa.string()), "double": (T.DoubleType(), pa.float64()), "long": (T.LongType(), pa.int64()), "int": (T.IntegerType(), pa.int32())}

# JSON's tokens; possessive repeats keep damaged texts linear
_W = r"[ \t\n\r]*+"
_S = r'[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+'
_N = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][-+]?[0-9]++)?+"
_MEMBER = rf'"{_S}"{_W}:{_W}(?:"{_S}"|{_N}|true|false|null)'
_FLAT = re.compile(rf"{_W}\{{{_W}((?:{_MEMBER}(?:{_W},{_W}{_MEMBER})*+)?+){_W}\}}{_W}([,\]])").match
_PAIRS = re.compile(rf'"({_S})"{_W}:{_W}(?:"({_S})"|({_N})|(true|false|null))').findall
_ATOM = re.compile(rf'(?:"({_S})"|({_N})|(true|false|null)){_W}').match
_KEY = re.compile(rf'{_W}"({_S})"{_W}:{_W}').match
_LEAF = re.compile(rf'{_W}"({_S})"{_W}:{_W}(?:"({_S})"|({_N})|(true|false|null)){_W}([,}}])').match
_SPACE = re.compile(_W).match
TEXT, NUMERIC, WORD = "str", "number", "word"


@dataclass(frozen=True)
class Field:
    """One leaf. ``path`` is dotted from the record's root; ``[]`` ends every repeated step, as in ``[].result[].rtt``."""

    name: str
    path: str
    kind: str = "string"


@dataclass(frozen=True)
class Table:
    """A table of one repeated ancestor: ``ancestor`` ends with ``[]``; ``ordinals`` names the position columns, one for each ``[]`` in it."""

    name: str
    ancestor: str
    fields: tuple[Field, ...]
    ordinals: tuple[str, ...]


class _Bad(ValueError):
    """The text isn't JSON."""


class _Twice(ValueError):
    """A member is given twice."""


def _plain(raw: str) -> str:
    return json.loads(f'"{raw}"') if "\\" in raw else raw


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8") if not text.isascii() else text


def convert(text: str, token: str, kind: str):
    """A leaf in its column's type: numbers from numbers or their text, text from any leaf; else null."""
    if kind == "string":
        return None if token is WORD and text == "null" else text
    if token is WORD or (token is TEXT and not NUMBER.match(text)):
        return None
    if kind == "double":
        value = float(text)
        return value if value - value == 0 else None
    bare = text.strip()
    try:
        value = int(bare) if bare.lstrip("+-").isdigit() else float(bare)
        if value != value // 1:
            return None
        value = int(value)
    except (ValueError, OverflowError):
        return None
    limit = 1 << (31 if kind == "int" else 63)
    return value if -limit <= value < limit else None


def _steps(path: str) -> list[str]:
    """``[].result[].rtt`` as ``['[]', 'result', '[]', 'rtt']``."""
    return [x for x in re.split(r"(\[\])|\.", path) if x]


class Group:
    """The entries of one repeated ancestor: the position of each in its list and its parent's entry."""

    def __init__(self, up: Group | None):
        self.up, self.pos, self.parent = up, [], []


class Leaf:
    """The triples of one path: the entry of its repeated ancestor, the value and, for unknown paths, its kind of token."""

    def __init__(self, path: str, kind: str | None):
        self.path, self.kind, self.at, self.value, self.token = path, kind, [], [], []


class Node(dict):
    """A step of the paths: its members by name, the node of its entries and what is kept there."""

    def __init__(self, path: str, group: Group):
        super().__init__()
        self.path, self.group, self.entry, self.leaf, self.entered = path, group, None, None, None


class Triples:
    """Reads texts into triples, grouped by repeated ancestor.

    With ``paths`` given as (path, kind), only these are kept and what a path says is repeated is read as a list; without, every path is.
    """

    def __init__(self, paths: list[tuple[str, str | None]] | None, wrapper: str | None = None, keep_empty: bool = False):
        self.known, self.wrapper, self.keep_empty = paths is not None, wrapper, keep_empty
        self.records = Group(None)
        self.groups: dict[str, Group] = {"": self.records}
        self.leaves: dict[str, Leaf] = {}
        self.lists = [self.records.pos, self.records.parent]
        self.root = Node("", self.records)
        for path, kind in paths or ():
            node = self.root
            for s in _steps(path):
                node = self._entry(node) if s == "[]" else self._member(node, s)
            if kind:
                self._leaf(node, kind)

    def _member(self, node: Node, name: str) -> Node:
        if name not in node:
            node[name] = Node(f"{node.path}.{name}" if node.path else name, node.group)
        return node[name]

    def _entry(self, node: Node) -> Node:
        if node.entry is None:
            group = Group(node.group)
            node.entry = Node(node.path + "[]", group)
            node.entry.entered = group
            self.groups[node.entry.path] = group
            self.lists += [group.pos, group.parent]
        return node.entry

    def _leaf(self, node: Node, kind: str | None) -> Leaf:
        if node.leaf is None:
            node.leaf = self.leaves[node.path] = Leaf(node.path, kind)
            self.lists += [node.leaf.at, node.leaf.value, node.leaf.token]
        return node.leaf

    def add(self, text: str | None, row: int) -> None:
        """One record's triples; none if the text isn't valid."""
        if not text:
            return
        held = [len(x) for x in self.lists]
        self.records.pos.append(row)
        self.records.parent.append(0)
        try:
            at = _SPACE(text).end()
            if self.wrapper and text[at : at + 1] in ("{", '"'):
                text = self._unwrapped(text)
            self._read(text, self.root)
        except (_Bad, RecursionError):
            self._back(held)

    def clear(self) -> None:
        for x in self.lists:
            x.clear()

    def _back(self, held: list[int]) -> None:
        for i, x in enumerate(self.lists):
            del x[held[i] if i < len(held) else 0 :]

    def _unwrapped(self, text: str) -> str:
        """The text of the list that an object only wraps; few records are objects, so these are looked at as a whole first."""
        try:
            value = json.loads(text)
            while isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
                value = json.loads(value)
        except (ValueError, RecursionError):
            return text  # the tokenizer says what is wrong with it
        inner = value.get(self.wrapper) if isinstance(value, dict) else None
        if isinstance(inner, (list, str)) and not any(k != self.wrapper and not isinstance(v, (dict, list)) for k, v in value.items()):
            if isinstance(inner, str):
                try:
                    inner = json.loads(inner)
                except (ValueError, RecursionError):
                    return text
            if isinstance(inner, list) and any(isinstance(x, dict) and self.wrapper in x for x in inner):
                return json.dumps(inner)
        return text

    def _read(self, text: str, node: Node) -> None:
        """A whole text at a node. With a member given twice the text is written anew with the last values, and read again."""
        held = [len(x) for x in self.lists]
        try:
            end = self._value(text, _SPACE(text).end(), node)
        except _Twice:
            self._back(held)
            try:
                text = json.dumps(json.loads(text, parse_constant=_refuse))
            except ValueError:
                raise _Bad from None
            end = self._value(text, 0, node)
        if end != len(text):
            raise _Bad

    def _value(self, text: str, pos: int, node: Node | None) -> int:
        """Reads a value and the blanks after it; gives where it ends."""
        c = text[pos : pos + 1]
        if c == "[":
            return self._list(text, pos + 1, node)
        if c == "{":
            if self.known and node is not None and node.entry is not None:  # an object where a list is meant: a list of one
                node = self._enter(node.entry, 0)
            return self._object(text, pos + 1, node)
        m = _ATOM(text, pos)
        if m is None:
            raise _Bad
        if node is not None:
            s, n, w = m.groups()
            self._keep(node, s if s is not None else n or w, TEXT if s is not None else NUMERIC if n else WORD)
        return m.end()

    def _keep(self, node: Node, text: str, token: str) -> None:
        if token is TEXT:
            text = _plain(text)
            if self.known and node.entry is not None:
                if text.lstrip()[:1] in ("[", "{"):
                    held = [len(x) for x in self.lists]
                    try:
                        self._read(text, node)
                    except _Bad:
                        self._back(held)
                return
            if node is self.root and text.lstrip()[:1] in ("[", "{"):
                self._read(text, node)
                return
        leaf = node.leaf if self.known else self._leaf(node, None)
        if leaf is None:
            return
        leaf.at.append(len(node.group.pos) - 1)
        if self.known:
            leaf.value.append(convert(text, token, leaf.kind))
        else:
            leaf.value.append(None if text == "null" and token is WORD else text)
            leaf.token.append({TEXT: "str", WORD: "NoneType" if text == "null" else "bool"}.get(token) or ("float" if set(text) & set(".eE") else "int"))

    def _enter(self, entry: Node, i: int) -> Node:
        group = entry.entered
        group.parent.append(len(group.up.pos) - 1)
        group.pos.append(i)
        return entry

    def _list(self, text: str, pos: int, node: Node | None) -> int:
        entry = None if node is None else node.entry if self.known else self._entry(node)
        pos = _SPACE(text, pos).end()
        if text[pos : pos + 1] == "]":
            return _SPACE(text, pos + 1).end()
        i = 0
        while True:
            m = _FLAT(text, pos)
            if m is not None:
                leaves, c = m.groups()
                pos = m.end()
                if entry is not None:
                    self._enter(entry, i)
                    self._members(leaves, entry)
            else:
                pos = _SPACE(text, pos).end()
                at = entry
                if entry is not None:
                    if self.known and not self.keep_empty and text.startswith("null", pos):
                        at = None
                    else:
                        self._enter(entry, i)
                pos = self._object(text, pos + 1, at) if text.startswith("{", pos) else self._value(text, pos, at)
                c = text[pos : pos + 1]
                pos += 1
            if c == "]":
                return _SPACE(text, pos).end()
            if c != ",":
                raise _Bad
            i += 1

    def _members(self, text: str, node: Node) -> None:
        """The members of an object that holds leaves only."""
        pairs = _PAIRS(text)
        if "\\" in text:
            pairs = [(_plain(k), *rest) for k, *rest in pairs]
        if not self.known:
            if len({p[0] for p in pairs}) < len(pairs):
                raise _Twice
            for k, s, n, w in pairs:
                self._keep(self._member(node, k), n or w or s, NUMERIC if n else WORD if w else TEXT)
            return
        here, get = len(node.group.pos) - 1, node.get
        for k, s, n, w in pairs:
            child = get(k)
            if child is None:
                continue
            leaf = child.leaf
            if leaf is None or child.entry is not None:
                self._keep(child, n or w or s, NUMERIC if n else WORD if w else TEXT)
            elif n and leaf.kind == "double":
                value = float(n)
                leaf.at.append(here)
                leaf.value.append(value if value - value == 0 else None)
            elif not n and not w and leaf.kind == "string":
                leaf.at.append(here)
                leaf.value.append(_plain(s) if "\\" in s else s)
            else:
                self._keep(child, n or w or s, NUMERIC if n else WORD if w else TEXT)

    def _object(self, text: str, pos: int, node: Node | None) -> int:
        pos = _SPACE(text, pos).end()
        if text[pos : pos + 1] == "}":
            return _SPACE(text, pos + 1).end()
        seen = set()
        while True:
            m, leaf = _LEAF(text, pos), True
            if m is not None:
                k, s, n, w, c = m.groups()
                pos = m.end()
            else:
                m, leaf = _KEY(text, pos), False
                if m is None:
                    raise _Bad
                k = m.group(1)
            if "\\" in k:
                k = _plain(k)
            if k in seen:
                raise _Twice
            seen.add(k)
            child = None if node is None else node.get(k) if self.known else self._member(node, k)
            if leaf:
                if child is not None:
                    self._keep(child, s if s is not None else n or w, TEXT if s is not None else NUMERIC if n else WORD)
            else:
                pos = self._value(text, m.end(), child)
                c = text[pos : pos + 1]
                pos += 1
            if c == "}":
                return _SPACE(text, pos).end()
            if c != ",":
                raise _Bad

    def entries(self, ancestor: str) -> list[tuple[str, np.ndarray]]:
        """For each repeated ancestor from the record down to ``ancestor``: which entry of it each entry of ``ancestor`` lies in."""
        group, at, out = self.groups[ancestor], np.arange(len(self.groups[ancestor].pos)), []
        while group is not None:
            out.append((group, at))
            at = np.array(group.parent, np.int64)[at] if group.up is not None else at
            group = group.up
        return out[::-1]

    def column(self, path: str, at: np.ndarray) -> pa.Array:
        """The pivot of one path: its value for each entry in ``at`` of its repeated ancestor; the last one counts."""
        leaf = self.leaves[path]
        values = [None if x is None else _clean(x) for x in leaf.value] if leaf.kind == "string" else leaf.value
        size = int(at.max()) + 1 if len(at) else 0
        where = np.full(max(size, max(leaf.at, default=-1) + 1), -1, np.int64)
        where[np.array(leaf.at, np.int64)] = np.arange(len(leaf.at))
        where = where[at]
        return pa.array(values, KINDS[leaf.kind][1]).take(pa.array(where, mask=where < 0))


def _refuse(token: str):
    raise ValueError(token)


def _repeated(path: str) -> str:
    """The nearest repeated ancestor of a path, or the record."""
    return path[: path.rfind("[]") + 2] if "[]" in path else ""


def _check(keys: list[str], tables: list[Table]) -> None:
    for t in tables:
        steps = _steps(t.ancestor)
        if not steps or steps[-1] != "[]" or steps.count("[]") != len(t.ordinals):
            raise ValueError("ancestor must end with [] and have one ordinal name for each []")
        for f in t.fields:
            if not (t.ancestor + ".").startswith(_repeated(f.path)) or _repeated(f.path) not in {t.ancestor[: i + 2] for i in range(len(t.ancestor)) if t.ancestor.startswith("[]", i)} | {""}:
                raise ValueError(f"{f.path} isn't below {t.ancestor} or an ancestor of it")
        clash = {*keys} & ({*t.ordinals} | {f.name for f in t.fields})
        if clash:
            raise ValueError(f"names clash with the keys: {sorted(clash)}")


def _pivots(df: DataFrame, keys: list[str], text: str, tables: list[Table], tag: str | None, wrapper: str | None, keep_empty: bool) -> DataFrame:
    _check(keys, tables)
    kinds: dict[str, str] = {}
    for t in tables:
        for f in t.fields:
            if kinds.setdefault(f.name, f.kind) != f.kind:
                raise ValueError(f"{f.name} has two types")
    if tag is not None and tag in {*keys, *kinds, *(o for t in tables for o in t.ordinals)}:
        raise ValueError(f"names clash with the tag: {tag}")
    ordinals = list(dict.fromkeys(o for t in tables for o in t.ordinals))
    columns = [(o, "int") for o in ordinals] + list(kinds.items())
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType(([T.StructField(tag, T.StringType())] if tag else []) + key_fields + [T.StructField(n, KINDS[k][0]) for n, k in columns])
    paths = [(t.ancestor, None) for t in tables] + [(f.path, f.kind) for t in tables for f in t.fields]
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Triples(paths, wrapper, keep_empty)
        for batch in batches:
            texts = batch.column(n_keys)

            def flush(batch=batch) -> Iterator[pa.RecordBatch]:
                for t in tables:
                    chain = store.entries(t.ancestor)
                    n = len(chain[-1][0].pos)
                    if not n:
                        continue
                    record = pa.array(np.array(store.records.pos, np.int64)[chain[0][1]])
                    made = {o: pa.array(np.array(g.pos, np.int32)[at]) for o, (g, at) in zip(t.ordinals, chain[1:], strict=True)}
                    level = {id(g): at for g, at in chain}
                    made |= {f.name: store.column(f.path, level[id(store.groups[_repeated(f.path)])]) for f in t.fields}
                    arrays = [pa.array([t.name] * n, pa.string())] if tag else []
                    arrays += [batch.column(c).take(record) for c in range(n_keys)]
                    arrays += [made[c] if c in made else pa.nulls(n, KINDS[k][1]) for c, k in columns]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
                store.clear()

            for row in range(batch.num_rows):
                store.add(texts[row].as_py(), row)
                if max(len(g.pos) for g in store.groups.values()) >= ROWS_OUT:
                    yield from flush()
            yield from flush()

    return df.select(*[F.col(k) for k in keys], F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def flat_table(df: DataFrame, keys: list[str], text: str, ancestor: str, fields: list[Field], ordinals: list[str], wrapper: str | None = None, keep_empty: bool = False) -> DataFrame:
    """The table of one repeated ancestor: keys, ordinals, fields.

    ``fields`` may lie in the ancestor itself or in any repeated ancestor above it (then the value repeats: the parent-child link is the prefix of the ordinals).
    """
    return _pivots(df, keys, text, [Table("", ancestor, tuple(fields), tuple(ordinals))], None, wrapper, keep_empty)


def flat_tables(df: DataFrame, keys: list[str], text: str, tables: list[Table], tag: str = "table", wrapper: str | None = None, keep_empty: bool = False) -> DataFrame:
    """Several tables from one pass: rows of (tag, keys, all ordinals, all fields); columns that a table hasn't got are null in its rows.

    A child's row links to its parent's by the keys and the ordinals they share.
    """
    return _pivots(df, keys, text, tables, tag, wrapper, keep_empty)


def triples(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Every leaf of every record as (keys, path, ordinals, value, kind): for records whose paths aren't known.

    ``path`` is written as in :class:`Field`, ``ordinals`` has the position at each ``[]`` of it.
    """
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType([*key_fields, T.StructField("path", T.StringType()), T.StructField("ordinals", T.ArrayType(T.IntegerType())), T.StructField("value", T.StringType()), T.StructField("kind", T.StringType())])
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            store, texts = Triples(None), batch.column(n_keys)

            def flush(store: Triples, batch=batch) -> Iterator[pa.RecordBatch]:
                for path, leaf in store.leaves.items():
                    if not leaf.at:
                        continue
                    chain, mine = store.entries(_repeated(path)), np.array(leaf.at, np.int64)
                    record = pa.array(np.array(store.records.pos, np.int64)[chain[0][1][mine]])
                    depth = len(chain) - 1
                    places = np.stack([np.array(g.pos, np.int32)[at[mine]] for g, at in chain[1:]], 1).ravel() if depth else np.empty(0, np.int32)
                    arrays = [batch.column(c).take(record) for c in range(n_keys)]
                    arrays += [pa.array([_clean(path)] * len(mine), pa.string()), pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1, dtype=np.int32) * depth), pa.array(places, pa.int32()))]
                    arrays += [pa.array([None if x is None else _clean(x) for x in leaf.value], pa.string()), pa.array(leaf.token, pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

            for row in range(batch.num_rows):
                store.add(texts[row].as_py(), row)
                if sum(len(leaf.at) for leaf in store.leaves.values()) >= ROWS_OUT:
                    yield from flush(store)
                    store = Triples(None)
            yield from flush(store)

    return df.select(*[F.col(k) for k in keys], F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
