"""JSON documents as a Spark data source that cuts one large document.

``json_elements`` (Spark's Python Data Source interface) plans byte ranges of the
files below a path and reads the objects that open in each range. A range that
starts in the middle of a document must know whether it is inside a text, how
deep, and under which keys. Three reads of the same ranges find that out, none
of which holds a document:

* ``scan``: a range as if it began outside a text and as if inside: parity of
  its quotes and change of depth for both. Escapes are settled by looking back
  over the backslashes before the range.
* ``keys``: with text state and depth known, the last keys and the number of
  elements since.
* ``elements``: with everything known, the elements themselves, each in the
  range that holds its first byte.

Between the reads the driver folds one small row a range. Malformed documents
fail the read: texts or brackets left open, too many closed, anything but one
comma between elements, and elements that ``from_json`` refuses.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 32 << 20
_TOKEN = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\]"]', re.S)
_REST = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_SPACE = re.compile(rb"\s*")
_ESCAPE = re.compile(rb"\\.?", re.S)
_SCHEMAS = {
    "scan": "file STRING, start BIGINT, odd BOOLEAN, outside INT, inside INT, low_outside INT, low_inside INT",
    "keys": "file STRING, start BIGINT, k1 STRING, k2 STRING, listed BOOLEAN, n BIGINT",
    "elements": "key STRING, pos BIGINT, element STRING",
}


def _file_system(path: str):
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int):
        self.file, self.start, self.stop = file, start, stop


def _lowest(text: bytes) -> tuple[int, int]:
    """Change of depth over a text without quoted parts, and its lowest point."""
    depth = low = 0
    for run in re.findall(rb"[{\[]+|[}\]]+", text):
        depth += len(run) if run[:1] in b"{[" else -len(run)
        low = min(low, depth)
    return depth, low


class _Text:
    """A range of a file that grows when a token goes on behind it."""

    def __init__(self, file, start: int, stop: int):
        self.file, self.end, self.buffer = file, stop - start, b""
        self.at = start
        self.more(stop - start)

    def more(self, size: int = 0) -> bool:
        """Read on, as much again as there is; False at the end of the file."""
        self.file.seek(self.at)
        got = self.file.read(size or max(1 << 16, len(self.buffer)))
        self.at += len(got)
        self.buffer += got
        return bool(got)

    def behind_text(self, escaped: bool) -> int:
        """The place behind the text that the range begins in."""
        while (m := _REST.match(self.buffer, int(escaped))) is None:
            if not self.more():
                raise ValueError("a text is left open")
        return m.end()

    def tokens(self, begin: int):
        """(first, past, byte or key or None) from ``begin``: brackets as their
        byte, object keys as text, other texts as None."""
        while True:
            m = _TOKEN.search(self.buffer, begin)
            if m is None:
                if not self.more():
                    return
                continue
            what, past = m.group(), m.end()
            if what == b'"':
                if not self.more():
                    raise ValueError("a text is left open")
                begin = m.start()
                continue
            if len(what) > 1:
                after = _SPACE.match(self.buffer, past).end()
                if after == len(self.buffer) and self.more():
                    begin = m.start()
                    continue
                key = self.buffer[after:after + 1] == b":"
                yield m.start(), past, (json.loads(what) if key else None)
            else:
                yield m.start(), past, what
            begin = past


def _elements(text: _Text, state: dict, target: int, name: str | None):
    """(key, pos, bytes) of the elements that open in the range. They lie in a
    list at depth ``target``: the document itself, or under ``name`` and a key."""
    depth, k1, k2, listed, pos = (state[k] for k in ("depth", "k1", "k2", "listed", "pos"))
    start = last = None  # of the element now open; (end of what came before, what may follow)
    wanted = lambda: listed and (name is None or (k1 == name and k2 is not None))

    def check(first):
        if last and text.buffer[last[0]:first].strip() != last[1]:
            raise ValueError("elements must be objects with one comma between them")

    for first, past, what in text.tokens(text.behind_text(state["escaped"]) if state["text"] else 0):
        if first >= text.end and start is None:
            return
        if what in (b"{", b"["):
            if depth == target - 1:
                listed, pos, last = what == b"[", 0, (past, b"")
            elif depth == target and wanted():
                check(first)
                if what != b"{":
                    raise ValueError("elements must be objects with one comma between them")
                start = first
            depth += 1
        elif what in (b"}", b"]"):
            depth -= 1
            if depth == target and wanted():
                if start is not None:
                    yield k2, pos, text.buffer[start:past]
                    pos += 1
                start, last = None, (past, b",")
            elif depth == target - 1 and wanted() and last:
                last = (last[0], b"")
                check(first)
        elif what is not None and depth == 1:
            k1, k2 = what, None
        elif what is not None and depth == 2 and start is None:
            k2 = what


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.stage = options["path"], options.get("stage", "elements")
        self.size = int(options.get("rangebytes", RANGE_BYTES))
        self.name = options.get("name") or None
        self.states = json.loads(options.get("states", "{}"))

    def partitions(self):
        from pyarrow import fs
        system, path = _file_system(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = [f for f in files if f.is_file and f.size and f.base_name[0] not in "._"]
        return [Range(f.path, at, min(f.size, at + self.size)) for f in sorted(files, key=lambda f: f.path)
                for at in range(0, f.size, self.size)] or [Range("", 0, 0)]

    def read(self, part):
        if not part.file:
            return
        with _file_system(self.path)[0].open_input_file(part.file) as file:
            escaped = self._escaped(file, part.start)
            if self.stage == "scan":
                file.seek(part.start)
                plain = _ESCAPE.sub(b"", file.read(part.stop - part.start)[1 if escaped else 0:])
                pieces = plain.split(b'"')
                outside, inside = _lowest(b"".join(pieces[::2])), _lowest(b"".join(pieces[1::2]))
                yield part.file, part.start, len(pieces) % 2 == 0, outside[0], inside[0], outside[1], inside[1]
                return
            state = dict(self.states[part.file][str(part.start)], escaped=escaped)
            target = 3 if self.name else 1
            text = _Text(file, part.start, part.stop)
            if self.stage == "keys":
                yield (part.file, part.start, *self._keys(text, state, target))
                return
            for key, pos, element in _elements(text, state, target, self.name):
                yield key, state["base"] + pos, element.decode()

    @staticmethod
    def _escaped(file, start: int) -> bool:
        """Is the byte at ``start`` behind an odd number of backslashes?"""
        count, step = 0, 256
        while start > count:
            size = min(step, start - count)
            file.seek(start - count - size)
            block = file.read(size)
            tail = len(block) - len(block.rstrip(b"\\"))
            count += tail
            if tail < size:
                break
        return count % 2 == 1

    def _keys(self, text: _Text, state: dict, target: int):
        """The last keys seen, whether a list opened at the target depth is
        what the elements lie in (null: none opened), and the objects that
        opened at the target depth since."""
        k1 = k2 = listed = None
        n, depth = 0, state["depth"]
        for first, past, what in text.tokens(text.behind_text(state["escaped"]) if state["text"] else 0):
            if first >= text.end:
                break
            if what in (b"{", b"["):
                if depth == target - 1:
                    listed, n = what == b"[", 0
                n += depth == target and what == b"{"
                depth += 1
            elif what in (b"}", b"]"):
                depth -= 1
            elif what is not None and self.name is not None:
                if depth == 1:
                    k1, k2 = what, None
                elif depth == 2:
                    k2 = what
        return k1, k2, listed, n


class JsonElements(DataSource):
    @classmethod
    def name(cls):
        return "json_elements"

    def schema(self):
        return _SCHEMAS[self.options.get("stage", "elements")]

    def reader(self, schema):
        return _Reader(dict(self.options))


def depth_states(rows) -> dict:
    """file: start: whether each range begins inside a text, and how deep; from
    the ``scan`` rows in order."""
    states: dict = {}
    file, inside, depth = None, False, 0

    def ended():
        if file is not None and (inside or depth):
            raise ValueError(f"{file}: a text or bracket is left open")

    for r in rows:
        if r["file"] != file:
            ended()
            file, inside, depth = r["file"], False, 0
        states.setdefault(file, {})[str(r["start"])] = {"text": inside, "depth": depth}
        if depth + (r["low_inside"] if inside else r["low_outside"]) < 0:
            raise ValueError(f"{file}: more brackets closed than opened")
        depth += r["inside"] if inside else r["outside"]
        inside ^= r["odd"]
    ended()
    return states


def key_states(rows, states: dict, name: str | None) -> dict:
    """``states`` with the keys and places each range begins at, from the
    ``keys`` rows in order."""
    file, base, total = None, 0, 0
    for r in rows:
        if r["file"] != file:
            file, k1, k2, listed, pos, base = r["file"], None, None, False, 0, total
            if name is None and r["listed"] is not True:
                raise ValueError(f"{file}: an array was expected")
        states[file][str(r["start"])] |= {"k1": k1, "k2": k2, "listed": listed, "pos": pos,
                                          "base": 0 if name else base}
        if r["k1"] is not None:
            k1, k2 = r["k1"], r["k2"]
        elif r["k2"] is not None:
            k2 = r["k2"]
        listed, pos = (listed, pos + r["n"]) if r["listed"] is None else (r["listed"], r["n"])
        total += r["n"]
    return states


def read_elements(spark: SparkSession, path: str, name: str | None = None,
                  range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(key, pos, element) of the documents below ``path``. Without ``name``: the
    objects of a top-level array, ``pos`` counting on from file to file, key
    null. With it: those of {name: {key: [element, ...]}}, ``pos`` their place
    under the key; a value of another shape has no elements."""
    spark.dataSource.register(JsonElements)

    def source(stage, states):
        return (spark.read.format("json_elements").option("path", path).option("stage", stage)
                .option("name", name or "").option("rangebytes", str(range_bytes))
                .option("states", json.dumps(states)).load())

    states = depth_states(source("scan", {}).orderBy("file", "start").collect())  # one small row a range
    states = key_states(source("keys", states).orderBy("file", "start").collect(), states, name)
    return source("elements", states)
