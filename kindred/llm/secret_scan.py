"""Secrets in texts, also inside nested encodings.

A worklist holds layers of a text. The first layer is the text; each layer is scanned, then unwrapped: percent
escapes and Unicode, octal and character escapes are undone over the whole layer, runs that are base64 of text or of compressed
text become layers of their own. This goes on until no new layer appears (the fixpoint). A layer whose text was seen before at
the same place of the document is not taken again, so cycles end: places do not grow inwards, and unwrapping never
lengthens a text except by decompression. The same text at another place is a layer of its own.

Base64 is decoded at all four offsets of a run, since a run may begin with a path or a name that is glued to the code, and
compressed members are looked for anywhere in the bytes. A decoded layer goes on only if it has the beginnings of a
secret or of another layer.

Every layer knows from which span of the original text its stretches come, so that what is found in an
inner layer is reported by code points of the original text: for base64 the whole run. The map has an entry for each
escape that was undone, not for each character.

Defined cases: null texts are empty; empty texts have no spans; a text is scanned whole, whatever its length; equal
rows give equal results; a null doc_id is carried along; columns other than doc_id and text are ignored, whatever their names
(``redacted_documents`` keeps them); an empty table gives an empty result. Base64 goes on over line ends between full lines;
bytes that are not UTF-8 are scanned as
Latin-1; members that follow each other in a compressed file are one layer. A compressed layer of more than ``max_layer``
bytes is scanned in pieces of that size that overlap by a quarter, and counted in ``oversized``; only an encoded run inside it
that is longer than the overlap can be cut. ``layers`` counts layers that read as text (by their first 65,536 characters) or
have a secret; it decides nothing.
"""

from __future__ import annotations

import binascii
import bz2
import lzma
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

# The patterns of the three kinds, in their order, and the least length of what they must match.
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

MAX_LAYER = 64 << 20

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(HEX[:-1] + "{24,}")  # a run is maximal, so runs that are too short need not be found
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"(?P<units>(?:\\u[0-9A-Fa-f]{4})+|(?:%u[0-9A-Fa-f]{4})+)|\\(?:u\{(?P<braced>[0-9A-Fa-f]{1,6})\}|U(?P<wide>[0-9A-Fa-f]{8})"
    r"|x(?P<byte>[0-9A-Fa-f]{2})|(?P<octal>[0-3][0-7]{2}))|&#(?:x(?P<hex>[0-9A-Fa-f]{1,6})|(?P<decimal>[0-9]{1,7}));"
)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}"
)
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_KINDS = ("assign", "access", "hex")
_STANDARD = str.maketrans("-_", "+/")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind), by start and then kind; leftmost matches that do not overlap within a kind."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(s, e, _KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


class Layer:
    """A text and the spans of the original text that its stretches come from.

    Stretch i begins at ``starts[i]`` of the text and at ``lows[i]`` of the original; it is a copy if ``highs[i]`` is None, else
    all its characters come from the whole span up to ``highs[i]``. Stretches are in the order of the original.
    """

    def __init__(
        self, text: str, path: tuple[str, ...], starts: list[int] | None = None, lows: list[int] | None = None,
        highs: list[int | None] | None = None,
    ):
        self.text, self.path = text, path
        self.starts, self.lows, self.highs = starts or [0], lows or [0], highs or [None]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.starts, start) - 1, bisect_left(self.starts, end) - 1
        low = self.lows[i] + (start - self.starts[i] if self.highs[i] is None else 0)
        high = self.highs[j]
        return low, self.lows[j] + end - self.starts[j] if high is None else high

    def replaced(self, pieces: list[tuple[int, int, str]], step: str) -> Layer:
        """The layer with each span (start, end) replaced by a text; its characters come from the whole span."""
        out, starts, lows, highs, size, at = [], [], [], [], 0, 0
        for start, end, text in [*pieces, (len(self.text), len(self.text), "")]:
            if at < start:
                i = bisect_right(self.starts, at) - 1
                while i < len(self.starts) and self.starts[i] < start:
                    skip = max(at - self.starts[i], 0)
                    starts.append(size + self.starts[i] + skip - at)
                    lows.append(self.lows[i] + (skip if self.highs[i] is None else 0))
                    highs.append(self.highs[i])
                    i += 1
                out.append(self.text[at:start])
                size += start - at
            if text:
                low, high = self.origin(start, end)
                starts.append(size)
                lows.append(low)
                highs.append(high)
                out.append(text)
                size += len(text)
            at = end
        return Layer("".join(out), (*self.path, step), starts, lows, highs)


def _text(data: bytes) -> tuple[str, bool]:
    """Bytes as text (Latin-1 if they are not UTF-8: the patterns are ASCII), and whether it reads as text."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1"), False
    head = text[:65536]
    return text, len(text) >= 8 and sum(c.isprintable() or c in "\t\n\r" for c in head) >= 0.95 * len(head)


_PACKED = {
    b"\x1f\x8b": ("gzip", lambda: zlib.decompressobj(31)), b"x": ("zlib", zlib.decompressobj),
    b"BZh": ("bzip2", bz2.BZ2Decompressor), b"\xfd7zXZ": ("xz", lzma.LZMADecompressor),
}
_MAGIC = re.compile(rb"\x1f\x8b(?=\x08)|x(?=[\x01\x5e\x9c\xda])|BZh(?=[1-9](?:1AY&SY|\x17rE8P\x90))|\xfd7zXZ(?=\x00)")
#: the beginnings of a secret or of a layer further in
_LIVE = re.compile(
    rb"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|[0-9a-f]{24}|[A-Za-z0-9+/_-]{16}|%[0-9A-Fa-fu]|\\[uUx0-3]|&#"
)
_STEP = 1 << 16


def _unpacked(data: bytes, make: Callable, rest: list[bytes]) -> Iterator[bytes]:
    """The decompressed chunks of one member; ``rest`` gets what follows it, or all data if they are no such member."""
    engine, at = make(), 0
    try:
        while at < len(data) and not engine.eof:
            todo = data[at : at + _STEP]
            at += len(todo)
            while True:
                out = engine.decompress(todo, _STEP)
                if out:
                    yield out
                todo = getattr(engine, "unconsumed_tail", b"")
                if engine.eof or not out and not todo:
                    break
    except (zlib.error, OSError, lzma.LZMAError, ValueError, EOFError):
        rest.append(data)
        return
    rest.append(data[at - len(engine.unused_data):] if engine.eof else b"")


def _pieces(chunks: Iterator[bytes], limit: int, over: list[int]) -> Iterator[bytes]:
    """The chunks as one layer or, beyond ``limit`` bytes, as pieces of that size that overlap by a quarter."""
    held, long = bytearray(), False
    for chunk in chunks:
        held += chunk
        while len(held) > limit:
            over[0] += not long
            long = True
            yield bytes(held[:limit])
            del held[: max(limit - limit // 4, 1)]
    if held:
        yield bytes(held)


Inner = tuple[str, tuple[str, ...], bool]


def _decoded(run: str, path: tuple[str, ...], limit: int, over: list[int]) -> Iterator[Inner]:
    """The layers in a base64 run: text, path, whether it reads as text. Members of a compressed file are one layer."""
    body = run.rstrip("=").translate(_STANDARD)
    for offset in range(4):
        code = body[offset:]
        code = code[: len(code) - (len(code) % 4 == 1)]
        data = binascii.a2b_base64(code + "=" * (-len(code) % 4))
        at = 0
        while m := _MAGIC.search(data, at):
            magic, (name, make) = m.group(), _PACKED[m.group()]
            rest = [data[m.start():]]

            def members() -> Iterator[bytes]:
                while rest[-1].startswith(magic):
                    before = rest.pop()
                    yield from _unpacked(before, make, rest)
                    if rest[-1] is before:
                        return

            for piece in _pieces(members(), limit, over):
                yield (t := _text(piece))[0], (*path, f"base64+{name}"), t[1]
            at = max(len(data) - len(rest[-1]), m.start() + 1)
        if len(data) >= 8 and _LIVE.search(data):
            yield (t := _text(data))[0], (*path, "base64"), t[1]


def _runs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, run) of the base64 runs: those inside a line, and those that go on over full lines of equal length
    and, perhaps, a shorter last one. The first line may have something before the run."""
    for m in _BASE64.finditer(text):
        yield m.start(), m.end(), m.group()
    for m in _WRAPPED.finditer(text) if "\n" in text else ():
        lines = [(x.start() + m.start(), x.end() + m.start()) for x in _LINE.finditer(m.group())]
        wide = [len(text[a:b].rstrip("=")) for a, b in lines]
        i = 0
        while i < len(lines):
            j = i
            while j + 1 < len(lines) and wide[j + 1] == wide[i]:
                j += 1
            ends = [j] + [j + 1] * (j + 1 < len(lines) and wide[j + 1] < wide[i])
            head = m.start() > 0 and text[m.start() - 1] != "\n" and "-----" not in text[slice(*lines[0])]
            for first in [i] + [0] * (i == 1 and head):
                for last in ends:
                    if last > first and wide[i] >= 16:
                        a, b = lines[first][0], lines[last][1]
                        yield a, b, "".join(text[s:e] for s, e in lines[first : last + 1])
            i = j + 1


def _escape_text(m: re.Match) -> str:
    whole = m.group()
    try:
        if units := m["units"]:
            return bytes.fromhex(units.replace(units[:2], "")).decode("utf-16-be")
        code = next(
            int(m[name], base) for name, base in (("braced", 16), ("wide", 16), ("byte", 16), ("octal", 8), ("hex", 16), ("decimal", 10)) if m[name]
        )
        return chr(code) if not 0xD800 <= code < 0xE000 else whole
    except (UnicodeDecodeError, ValueError, OverflowError):
        return whole


def _percent_text(m: re.Match) -> str:
    return bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "replace")


_WHOLE = (("url", ("%",), _PERCENT, _percent_text), ("unicode", ("\\", "&#", "%u"), _ESCAPE, _escape_text))


def unwrapped(layer: Layer) -> list[Layer]:
    """The whole layer one step further in."""
    text, out = layer.text, []
    for step, signs, rule, undo in _WHOLE:
        if any(x in text for x in signs):
            pieces = [(m.start(), m.end(), d) for m in rule.finditer(text) if (d := undo(m)) != m.group()]
            if pieces:
                out.append(layer.replaced(pieces, step))
    return out


def _inside(text: str, path: tuple[str, ...], limit: int, over: list[int]) -> Iterator[Inner]:
    """The layers one step further in where all characters have the same place, the last ones first."""
    for _, _, run in reversed(list(_runs(text))):
        yield from _decoded(run, path, limit, over)
    for step, signs, rule, undo in reversed(_WHOLE):
        if any(x in text for x in signs) and (inner := rule.sub(undo, text)) != text:
            yield inner, (*path, step), True


def _run_hits(run: str, limit: int) -> tuple[dict[str, tuple[str, ...]], int, int]:
    """What is anywhere in a base64 run: kinds with their path, layers taken, oversized layers.

    A layer that does not read as text counts as taken only if something is found in it. Long layers are kept as
    digests, so that memory holds a chain of layers, not all of them.
    """
    hits, seen, taken, over = {}, set(), 0, [0]
    stack = [_decoded(run, (), limit, over)]
    while stack:
        new = next(stack[-1], None)
        if new is None:
            stack.pop()
            continue
        text, path, readable = new
        key = text if len(text) < 4096 else xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
        if key in seen:
            continue
        seen.add(key)
        kinds = {x[2] for x in base_spans(text)}
        taken += bool(readable or kinds)
        for kind in kinds:
            hits.setdefault(kind, path)
        stack.append(_inside(text, path, limit, over))
    return hits, taken, over[0]


def scan(text: str, limit: int = MAX_LAYER) -> tuple[list[Span], list[tuple[int, int, str, str]], int, int]:
    """Base spans; spans (start, end, kind, layer) that only inner layers show; layers taken; oversized layers."""
    base = base_spans(text)
    known, added = set(base), {}
    seen, work, taken, oversized = {(text, 0, len(text))}, [Layer(text, ())], 0, 0
    runs: dict[str, tuple] = {}  # equal runs are decoded once
    places = set()
    while work:
        layer = work.pop()
        taken += 1
        if layer.path:
            for s, e, kind in base_spans(layer.text):
                a, b = layer.origin(s, e)
                if (a, b, kind) not in known:
                    added.setdefault((a, b, kind), ">".join(layer.path))
        for s, e, run in _runs(layer.text):
            place = (run, *layer.origin(s, e))
            if place in places:
                continue
            places.add(place)
            if run not in runs:
                runs[run] = _run_hits(run, limit)
            hits, layers, too_long = runs[run]
            taken, oversized = taken + layers, oversized + too_long
            for kind, path in hits.items():
                if (*place[1:], kind) not in known:
                    added.setdefault((*place[1:], kind), ">".join((*layer.path, *path)))
        for new in unwrapped(layer):
            place = (new.text, *new.origin(0, len(new.text))) if new.text else None
            if place and place not in seen:
                seen.add(place)
                work.append(new)
    order = {k: i for i, k in enumerate(_KINDS)}
    extra = sorted(((*k, v) for k, v in added.items()), key=lambda x: (x[0], order[x[2]], x[1], x[3]))
    return base, extra, taken, oversized


def redact(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """The text with the union of the spans replaced, one mask for each run."""
    out, at = [], 0
    runs: list[list[int]] = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    for s, e in runs:
        out += [text[at:s], mask]
        at = e
    return "".join([*out, text[at:]])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layer", pa.string())])


def scan_secrets(docs: DataFrame, mask: str = "[SECRET]", max_layer: int = MAX_LAYER) -> DataFrame:
    """For rows (doc_id, text): doc_id, spans (array of kind, start, end, layer; layer "" in the text itself) by start and
    then kind, redacted text, layers, oversized. Row-local: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                spans, texts, layers, over = [], [], [], []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    base, extra, taken, too_long = scan(text, max_layer)
                    found = sorted(
                        [*((*x, "") for x in base), *extra], key=lambda x: (x[0], _KINDS.index(x[2]), x[3] != "", x[1], x[3])
                    )
                    spans.append([{"kind": k, "start": s, "end": e, "layer": p} for s, e, k, p in found])
                    texts.append(redact(text, [(x["start"], x["end"]) for x in spans[-1]], mask))
                    layers.append(taken)
                    over.append(too_long)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(spans, pa.list_(_SPAN)), pa.array(texts, pa.string()),
                     pa.array(layers, pa.int32()), pa.array(over, pa.int32())],
                    names=["doc_id", "spans", "redacted", "layers", "oversized"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,layer:string>>, redacted string,"
        " layers int, oversized int",
    )


def redacted_documents(docs: DataFrame, mask: str = "[SECRET]", max_layer: int = MAX_LAYER) -> DataFrame:
    """The same rows and columns with secrets masked in text and, where there is such a column, n_chars counted anew.

    A null text stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names = batch.schema.get_field_index("text"), batch.schema.names
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                texts = []
                for text in part.column(at).to_pylist():
                    if text:
                        base, extra, _, _ = scan(text, max_layer)
                        text = redact(text, [x[:2] for x in base] + [x[:2] for x in extra], mask)
                    texts.append(text)
                columns = list(part.columns)
                columns[at] = pa.array(texts, pa.string())
                if "n_chars" in names:
                    i = names.index("n_chars")
                    sizes = [None if t is None else len(t) for t in texts]
                    columns[i] = pa.array(sizes, pa.int64()).cast(columns[i].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
