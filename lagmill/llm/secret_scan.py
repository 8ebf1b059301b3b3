"""Secret scans: patterns over the text and over every layer that decoding uncovers, with spans mapped back."""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, tee
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
#: The patterns of the contract. Letters of the key words match in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_LONG_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: Escapes of a character, however often their backslash or ampersand was escaped again. A run of backslashes is entered at its start only.
_ESCAPE = re.compile(
    r"(?:(?<!\\)\\++|%)u([0-9A-Fa-f]{4})|(?<!\\)\\++(?:u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))|&(?:amp;)*+#(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));")
_BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Blocks of lines in one alphabet, and their lines; line breaks may be written as in a string literal, and lines be indented or quoted. A run is
#: entered at its start and left at its end only, so that time grows with the text's length.
_BREAK = r"[ \t]*(?:\r?\n|\r|(?:\\r)?\\n)[ \t>#*]*"
_BASE64_BLOCKS = [(re.compile(f"(?<![{a}])[{a}]{{16,}}+(?:{_BREAK}[{a}]++)+={{0,2}}"), re.compile(_BREAK)) for a in ("A-Za-z0-9+/", "A-Za-z0-9_-")]
_PERCENT_PACKED = re.compile(r"(?:%1f%8b|(?:x|%78)(?:%01|%5e|\^|%9c|%da)|(?:B|%42)(?:Z|%5a)(?:h|%68))(?:%[0-9a-f]{2}|[\w.~!*'()/$,:;@+^-])*", re.IGNORECASE | re.ASCII)
#: How compressed data begin, looked for behind other bytes.
_PACKED_INSIDE = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|BZh[1-9]1AY&SY|\x78[\x01\x5e\x9c\xda]")
#: Content of compressed data is unpacked in pieces and scanned in windows of so many bytes with a margin of their neighbours, so that memory is
#: bounded and nothing is left out; a match longer than the margin at a window's end is marked in `cut`.
PIECE, WINDOW, MARGIN = 1 << 20, 4 << 20, 1 << 16
#: Bytes behind such a beginning that must unpack before the rest is tried.
PEEK = 512


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the leftmost non-overlapping matches of each kind that are long enough. For access and hex, whose matches are
    maximal runs, asking for the length in the pattern gives the same matches."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in _LONG_ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _LONG_HEX.finditer(text)]
    return out


def _substituted(text: str, spans: list[tuple[int, int, str, list[int]]]) -> tuple[str, np.ndarray, np.ndarray]:
    """The text with each (start, end, new, offsets) replaced, and for every new character where it starts and ends in the old text."""
    parts, starts, ends, at = [], [], [], 0
    for s, e, new, offsets in spans:
        plain = np.arange(at, s, dtype=np.int64)
        edge = np.array(offsets, np.int64) + s
        parts += [text[at:s], new]
        starts += [plain, edge[:-1]]
        ends += [plain + 1, edge[1:]]
        at = e
    plain = np.arange(at, len(text), dtype=np.int64)
    return "".join([*parts, text[at:]]), np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1])


def _url_layer(text: str):
    spans = []
    for m in _URL_RUN.finditer(text):
        data = bytes.fromhex(m[0].replace("%", ""))
        try:
            new = data.decode()
            widths = [len(c.encode()) for c in new]
        except UnicodeDecodeError:
            new, widths = data.decode("latin-1"), [1] * len(data)
        spans.append((m.start(), m.end(), new, [0, *(3 * np.cumsum(widths)).tolist()]))
    return _substituted(text, spans) if spans else None


def _escape_layer(text: str):
    spans = []
    for m in _ESCAPE.finditer(text):
        code = int(m[6]) if m[6] else int(m[1] or m[2] or m[3] or m[4] or m[5], 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            spans.append((m.start(), m.end(), chr(code), [0, m.end() - m.start()]))
    return _substituted(text, spans) if spans else None


def _decoder(head: bytes):
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 1 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj(15)
    return bz2.BZ2Decompressor() if head[:3] == b"BZh" else None


def _opens(head: bytes) -> bool:
    """Whether the first bytes of data behind others may be compressed ones: copies and unpacks a few of them only."""
    try:
        d = _decoder(head)
        return d is not None and (d.decompress(head) is not None)
    except (zlib.error, OSError, ValueError):
        return False


def _members(pieces: Iterator[bytes], cut: list[bool]) -> Iterator[bytes]:
    """The content of all members of compressed pieces, then the bytes behind them. cut gets an item if a member is damaged or has no end."""
    data = b""
    while True:
        while len(data) < 3 and (more := next(pieces, b"")):
            data = (data + more).lstrip(b"\0")
        if (d := _decoder(data)) is None:
            break
        while not d.eof:
            try:
                out = d.decompress(data, PIECE)
            except (zlib.error, OSError, ValueError):
                cut.append(True)
                return
            if out:
                yield out
            data = getattr(d, "unconsumed_tail", b"")
            if not (d.eof or data or out and not getattr(d, "needs_input", False)):
                if not (data := next(pieces, b"")):
                    cut.append(True)
                    return
        data = d.unused_data.lstrip(b"\0")
    yield from filter(None, chain([data], pieces))


def _unpacked(data: bytes) -> tuple[Iterator[bytes], int, list[bool]]:
    """Pieces of the content, how often it was unpacked, and a list that holds an item once a part was found unreadable. Nothing is
    held but a piece a level. Data that unpack to their own beginning are left there."""
    pieces, levels, cut, met = iter([data]), 0, [], set()
    while True:
        head = next(pieces, b"")
        while len(head) < 3 and (more := next(pieces, b"")):
            head += more
        pieces, mark = chain([head], pieces), hashlib.blake2b(head).digest()
        if _decoder(head) is None or mark in met:
            return filter(None, pieces), levels, cut
        met.add(mark)
        pieces, packed = tee(pieces)
        missing: list[bool] = []
        inner = _members(packed, missing)
        if not (first := next(inner, b"")):  # only looked compressed
            return filter(None, pieces), levels, cut
        pieces, levels = chain([first], _closing(inner, missing, cut)), levels + 1


def _closing(inner: Iterator[bytes], missing: list[bool], cut: list[bool]) -> Iterator[bytes]:
    yield from inner
    cut += missing


def _windows(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, int, int, int, bool]]:
    """(bytes, offset, lo, hi, last): content in windows with a margin on either side; lo to hi are a window's own bytes."""
    data, offset, lo = bytearray(), 0, 0
    for piece in pieces:
        data += piece
        while len(data) > lo + WINDOW + MARGIN:
            yield bytes(data[: lo + WINDOW + MARGIN]), offset, lo, lo + WINDOW, False
            drop = lo + WINDOW - MARGIN
            del data[:drop]
            offset, lo = offset + drop, MARGIN
    yield bytes(data), offset, lo, len(data) + 1, True


def _readings(data: bytes, whole: bool) -> Iterator[tuple[str, int]]:
    """(text, bytes a character) of every way to read the bytes; whatever no way can read becomes a replacement character."""
    try:
        yield (data.decode() if whole else data.decode("latin-1")), 1
    except UnicodeDecodeError:
        yield data.decode("latin-1"), 1
    if b"\0" in data:  # little endian at odd offsets is big endian at even ones
        for kind in ("<u2", ">u2", "<u4", ">u4"):
            size = int(kind[-1])
            a = np.frombuffer(data[: len(data) // size * size], kind)
            yield np.where(a < 256, a, 0xFFFD).astype("<u2").tobytes().decode("utf-16-le"), size


def _base64_runs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, characters) of runs in one line, of blocks of lines, and of the lines of a block that have one width and the shorter one behind."""
    for m in _BASE64_RUN.finditer(text):
        yield m.start(), m.end(), m[0]
    for pattern, between in _BASE64_BLOCKS:
        for m in pattern.finditer(text):
            breaks = [x.span() for x in between.finditer(text, m.start(), m.end())]
            edge = m.end() - (len(m[0]) - len(m[0].rstrip("=")))
            lines = list(zip([m.start(), *(e for _, e in breaks)], [*(s for s, _ in breaks), edge], strict=True))
            groups, at = {(0, len(lines))}, 0
            while at < len(lines):
                width, to = lines[at][1] - lines[at][0], at + 1
                while to < len(lines) and lines[to][1] - lines[to][0] == width:
                    to += 1
                to += to < len(lines) and lines[to][1] - lines[to][0] < width
                groups.add((at, to))
                at = to
            for i, j in sorted(groups):
                if j - i > 1:
                    yield lines[i][0], m.end() if j == len(lines) else lines[j - 1][1], "".join(text[s:e] for s, e in lines[i:j])


def _packed_layers(text: str):
    """(start, end, inner text, via, cut, offset, lo, hi, last) of all that base64 runs and compressed percent-encoded runs hold, window by window:
    lo to hi are the window's own characters."""

    def layers(start: int, end: int, data: bytes, via: str, least: int):
        pieces, levels, cut = _unpacked(data)
        if levels >= least:
            for window, offset, lo, hi, last in _windows(pieces):
                for inner, size in _readings(window, last and not offset):
                    yield start, end, inner, "+".join(filter(None, [via, *["unpack"] * levels])), cut, (offset, size), lo // size, -(-hi // size), last

    for start, end, run in _base64_runs(text):
        run = run.rstrip("=").replace("-", "+").replace("_", "/")
        # What stands before the encoded part, a path or a slash, shifts it: all four alignments are read, of which the right one shows it.
        for skip in range(4):
            part = run[skip : len(run) - ((len(run) - skip) % 4 == 1)]
            if len(part) < 2:
                continue
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            yield from layers(start, end, data, "base64", 0)
            inside = iter(()) if _decoder(data) else _PACKED_INSIDE.finditer(data)
            for m in inside:  # the first that unpacks takes all members behind it
                if not _opens(data[m.start() : m.start() + PEEK]):
                    continue
                behind = layers(start, end, data[m.start() :], "base64", 1)
                if (first := next(behind, None)) is not None:
                    yield first
                    yield from behind
                    break
    for m in _PERCENT_PACKED.finditer(text) if "%" in text else ():
        yield from layers(m.start(), m.end(), unquote_to_bytes(m[0]), "url", 1)
        if "+" in m[0]:
            yield from layers(m.start(), m.end(), unquote_to_bytes(m[0].replace("+", " ")), "url", 1)


def _any(cut: list) -> bool:
    return any(x is True or x is not True and _any(x) for x in cut)


def find_secrets(text: str | None) -> list[tuple[str, int, int, str, str, bool]]:
    """(kind, start, end, via, secret, cut) of all secrets of a text: code points of the text, end exclusive; via is empty for matches in
    the text itself and else names the decodings that uncovered the match; their span is what encodes the match.

    A stack holds layers still to come. Each is scanned once; URL and Unicode escapes give the whole layer decoded, every base64 run or block of lines gives
    its content, unpacked while compressed, in windows. cut: a part of what was unpacked could not be read. A layer met before at the same place is not entered again, so the list ends. A layer's path holds the spans of the runs
    around it; matches are told apart by path, offsets in the innermost run and secret, so that several in one run are all returned.
    """
    text = text or ""
    found: dict[tuple, tuple[str, list]] = {}
    blocks: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    work = [iter([(text, None, None, (), "", [], 0, len(text) + 1, None)])]
    seen = set()
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        layer, starts, ends, path, via, cut, lo, hi, stop = layer
        mark = (hashlib.blake2b(layer.encode(errors="surrogatepass"), digest_size=16).digest(), path)
        if mark in seen:
            continue
        seen.add(mark)

        def at(s: int, e: int, starts=starts, ends=ends) -> tuple[int, int]:
            return (s, e) if starts is None else (int(starts[s]), int(ends[e - 1]))

        for kind, s, e in base_spans(layer):
            place = at(s, e)
            if lo <= place[0] < hi:
                found.setdefault((kind, path, *place, layer[s:e]), (via, cut if stop is None or place[1] < stop else [True]))
        for name, decode in (("unicode", _escape_layer), ("url", _url_layer)):
            if (got := decode(layer) if ("%" in layer if name == "url" else any(x in layer for x in ("\\", "&#", "&amp;", "%u"))) else None) is not None:
                new, s, e = got
                origin = (s, e) if starts is None else (starts[s], ends[e - 1])
                work.append(iter([(new, *origin, path, f"{via}>{name}".lstrip(">"), cut, lo, hi, stop)]))

        def packed(layer=layer, at=at, path=path, via=via, cut=cut, lo=lo, hi=hi, stop=stop):
            for s, e, inner, how, was_cut, where, low, high, last in _packed_layers(layer):
                place = at(s, e)
                if lo <= place[0] < hi:
                    over = [cut, was_cut, [True] if stop is not None and place[1] >= stop else []]
                    yield inner, None, None, (*path, (*place, *where)), f"{via}>{how}".lstrip(">"), over, low, high, None if last else len(inner)

        work.append(packed())
    order = {k: i for i, k in enumerate(KINDS)}
    spans = [(kind, *(path[0][:2] if path else (s, e)), via, secret, _any(cut)) for (kind, path, s, e, secret), (via, cut) in found.items()]
    # What lies in one line of a block was also met in the block: the narrower finding stays.
    for x in spans:
        if x[3]:
            blocks[x[0], x[4]].append(x[1:3])
    inside = lambda x: any(x[1] <= s and e <= x[2] and (s, e) != x[1:3] for s, e in set(blocks.get((x[0], x[4]), ())))
    spans = [x for x in spans if not x[3] or not inside(x)]
    return sorted(spans, key=lambda x: (x[1], order[x[0]], x[2]))


FINDINGS = "array<struct<kind:string,start:bigint,end:bigint,via:string,secret:string,cut:boolean>>"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id and findings, the array of find_secrets() in order of start and kind.

    Null and empty texts have no findings. Repeated rows are scanned alike, null ids are kept, an empty table gives no rows, other
    columns are ignored. Very long texts are scanned whole.
    """

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("kind", "start", "end", "via", "secret", "cut")
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
    out_type = pa.list_(pa.struct(list(zip(names, types, strict=True))))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(names, x, strict=True)) for x in find_secrets(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, out_type)], names=["doc_id", "findings"])

    return docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {kind}, findings {FINDINGS}")


def secret_digests(docs: DataFrame) -> DataFrame:
    """scan_secrets() with n_assign, n_access, n_hex, base_sha256, spans, and cut: whether a part of what encloses a finding could not be read."""
    base = F.filter("findings", lambda x: x["via"] == "")
    count = lambda k: F.size(F.filter("findings", lambda x: (x["via"] == "") & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scan_secrets(docs).select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"), F.exists("findings", lambda x: x["cut"]).alias("cut"))
