"""The single-file archive's bytes: a 128-byte header, a table of sections, sections, a SHA-256 and optional signatures.

All numbers are little-endian. Limits on sizes are checked before anything is decompressed.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import os
import pickle
import struct
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

MAGIC, MAJOR = 0x01415A4F, 1
METADATA, MIME, ENTRIES, PATHS, TITLES, CONTENT, REDIRECTS, CHROME, SIGNATURES, DICTIONARY, SEARCH_TITLE, SEARCH_BODY = 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13
NAMES = {1: "METADATA", 2: "MIME_TABLE", 3: "ENTRY_TABLE", 4: "PATH_INDEX", 5: "TITLE_INDEX", 6: "CONTENT", 7: "REDIRECT_TABLE", 9: "CHROME", 10: "SIGNATURES", 11: "ZSTD_DICT", 12: "SEARCH_TITLE", 13: "SEARCH_BODY"}
REDIRECT_BIT, HAS_SEARCH, HAS_SIGNATURES = 1 << 31, 1, 4
FIXED_MIME = ("text/html", "text/css", "application/javascript")
NONE, ZSTD, ZSTD_DICT, BROTLI = range(4)
_HEADER, _SECTION, _CHUNK = struct.Struct("<IHH16sIIQQQIII60x"), struct.Struct("<IIQQQB3xI8x32s"), struct.Struct("<IQQIB3x")
RESTART, NO_TOKEN = 64, 0xFFFF
NOWHERE = -1  # chunk of content that another part stores


class FormatError(ValueError):
    """The file breaks the format."""


class BadMagic(FormatError):
    pass


class UnsupportedVersion(FormatError):
    pass


class LimitExceeded(FormatError):
    pass


class ChecksumMismatch(FormatError):
    pass


@dataclass(frozen=True)
class Limits:
    section: int = 1 << 30
    blob: int = 256 << 20
    value: int = 16 << 20


@dataclass(frozen=True)
class Header:
    uuid: bytes
    section_count: int
    entry_count: int
    content_size: int
    table_offset: int
    checksum_offset: int
    flags: int = 0
    redirect_count: int = 0
    front_count: int = 0
    major: int = MAJOR
    minor: int = 0

    def pack(self) -> bytes:
        return _HEADER.pack(MAGIC, self.major, self.minor, self.uuid, self.section_count, self.entry_count, self.content_size, self.table_offset, self.checksum_offset, self.flags, self.redirect_count, self.front_count)


def parse_header(data: bytes) -> Header:
    if len(data) < 128:
        raise FormatError("shorter than a header")
    magic, major, minor, uuid, sections, entries, size, table, checksum, flags, redirects, front = _HEADER.unpack_from(data)
    if magic != MAGIC:
        raise BadMagic(f"magic is {magic:#x}")
    if major > MAJOR:
        raise UnsupportedVersion(f"version {major}")
    return Header(uuid, sections, entries, size, table, checksum, flags, redirects, front, major, minor)


@dataclass(frozen=True)
class Section:
    kind: int
    flags: int
    offset: int
    compressed_size: int
    uncompressed_size: int
    compression: int
    dict_id: int
    sha256: bytes

    def pack(self) -> bytes:
        return _SECTION.pack(self.kind, self.flags, self.offset, self.compressed_size, self.uncompressed_size, self.compression, self.dict_id, self.sha256)


def parse_sections(data: bytes, count: int) -> list[Section]:
    if len(data) < 80 * count:
        raise FormatError("section table is cut off")
    return [Section(*_SECTION.unpack_from(data, 80 * i)) for i in range(count)]


def compress(data: bytes, level: int = 6, dictionary=None) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level, dict_data=dictionary).compress(data)


def decompress(data: bytes, codec: int, dictionaries: dict[int, bytes] | None = None, dict_id: int = 0, most: int = Limits.section) -> bytes:
    import zstandard

    if codec == NONE:
        if len(data) > most:
            raise LimitExceeded("section or chunk is too large")
        return data
    if codec == BROTLI:
        raise FormatError("no brotli module")
    if codec not in (ZSTD, ZSTD_DICT):
        raise FormatError(f"unknown compression {codec}")
    known = None
    if codec == ZSTD_DICT:
        if dict_id not in (dictionaries or {}):
            raise FormatError(f"no dictionary {dict_id}")
        known = zstandard.ZstdCompressionDict(dictionaries[dict_id])
    try:
        out = zstandard.ZstdDecompressor(dict_data=known).stream_reader(io.BytesIO(data)).read(most + 1)
    except zstandard.ZstdError as e:
        raise FormatError(f"damaged data: {e}") from e
    if len(out) > most:
        raise LimitExceeded("section or chunk is too large")
    return out


class _Reader:
    """Reads numbers and strings, and complains where the data end early."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise FormatError("data end early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little")

    def varint(self) -> int:
        value = shift = 0
        while True:
            b = self.number(1)
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7
            if shift > 63:
                raise FormatError("a number is too long")


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def parse_metadata(data: bytes, most: int = Limits.value) -> dict[str, bytes]:
    r, out = _Reader(data), {}
    for _ in range(r.number(4)):
        key = r.take(r.number(2)).decode()
        size = r.number(4)
        if size > most:
            raise LimitExceeded(f"value of {key}")
        if key in out:
            raise FormatError(f"key {key} occurs twice")
        out[key] = r.take(size)
    return out


def pack_metadata(pairs: dict[str, bytes]) -> bytes:
    out = [len(pairs).to_bytes(4, "little")]
    for key, value in sorted(pairs.items()):
        k = key.encode()
        out += [len(k).to_bytes(2, "little"), k, len(value).to_bytes(4, "little"), value]
    return b"".join(out)


def parse_mime(data: bytes) -> list[str]:
    r = _Reader(data)
    out = [r.take(r.number(2)).decode() for _ in range(r.number(2))]
    if len(out) >= 3 and tuple(out[:3]) != FIXED_MIME:
        raise FormatError("the first MIME types are fixed")
    return out


def pack_mime(types: list[str]) -> bytes:
    return len(types).to_bytes(2, "little") + b"".join(len(t.encode()).to_bytes(2, "little") + t.encode() for t in types)


@dataclass(frozen=True)
class Record:
    kind: int
    front: bool
    mime: int
    chunk: int
    offset: int
    size: int
    hash: bytes

    def pack(self) -> bytes:
        return bytes([self.kind | self.front << 4]) + varint(self.mime) + varint(self.chunk) + varint(self.offset) + varint(self.size) + self.hash


def parse_entries(data: bytes, strict: bool = True) -> list[Record | None]:
    """Records by id; damaged ones are None unless strict."""
    r = _Reader(data)
    count, base = r.number(4), r.number(4)
    if count >= REDIRECT_BIT or 8 + 4 * count > len(data):
        raise FormatError("more entries than there can be")
    places, out = struct.unpack_from(f"<{count}I", data, 8), []
    for place in places:
        try:
            e = _Reader(data, base + place)
            head = e.number(1)
            out.append(Record(head & 15, bool(head & 16), e.varint(), e.varint(), e.varint(), e.varint(), e.take(8)))
        except FormatError:
            if strict:
                raise
            out.append(None)
    return out


def entry_columns(data: bytes, strict: bool = True) -> dict[str, np.ndarray]:
    """Records as arrays by id (front, mime, chunk, offset, size, hash), which takes a tenth of the memory; ok is false for damaged ones unless strict."""
    r = _Reader(data)
    count, base = r.number(4), r.number(4)
    if count >= REDIRECT_BIT or 8 + 4 * count > len(data):
        raise FormatError("more entries than there can be")
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(64, np.uint8))
    at = base + np.frombuffer(data, "<u4", count, 8).astype(np.int64)
    ok = at < len(data)
    at[~ok] = 0
    out = {"front": raw[at] & 16 > 0}
    at = at + 1
    for name in ("mime", "chunk", "offset", "size"):
        value, more = np.zeros(count, np.uint64), np.ones(count, bool)
        for shift in range(0, 70, 7):
            b = np.where(more, raw[np.minimum(at, len(data))], 0)
            value |= (b & 127).astype(np.uint64) << np.uint64(shift)
            at += more
            more &= b > 127
        ok &= ~more
        out[name] = value.astype(np.int64)
    ok &= at + 8 <= len(data)
    out["hash"] = raw[np.minimum(at, len(data))[:, None] + np.arange(8)]
    if strict and not ok.all():
        raise FormatError("data end early")
    return out | {"ok": ok}


def pack_entries(columns: list[dict[str, np.ndarray]]) -> bytes:
    """The table of records, from arrays front, mime, chunk, offset, size and hash of one stretch of ids after another."""
    rows, sizes = [], []
    for c in columns:
        n = len(c["size"])
        cells, used = [(c["front"].astype(np.uint8) << 4)[:, None]], [np.ones((n, 1), bool)]
        for name in ("mime", "chunk", "offset", "size"):
            v = c[name].astype(np.uint64)
            v = np.stack([v >> np.uint64(shift) for shift in range(0, 63, 7)], axis=1)
            more = np.append(v[:, 1:] > 0, np.zeros((n, 1), bool), axis=1)
            cells.append((v & np.uint64(127)).astype(np.uint8) | more.astype(np.uint8) << 7)
            used.append(np.append(np.ones((n, 1), bool), more[:, :-1], axis=1))
        cells.append(c["hash"].reshape(n, 8))
        used.append(np.ones((n, 8), bool))
        used = np.concatenate(used, axis=1)
        rows.append(np.concatenate(cells, axis=1)[used].tobytes())
        sizes.append(used.sum(axis=1))
    places = np.cumsum(np.concatenate([[0], *sizes])).astype("<u4")[:-1]
    return struct.pack("<II", len(places), 8 + 4 * len(places)) + places.tobytes() + b"".join(rows)


def parse_redirects(data: bytes) -> list[tuple[int, int]]:
    """Flags and target of each redirect."""
    r = _Reader(data)
    return [(r.number(1), r.number(4)) for _ in range(r.number(4))]


def pack_redirects(rows: list[tuple[int, int]]) -> bytes:
    return len(rows).to_bytes(4, "little") + b"".join(struct.pack("<BI", f, t) for f, t in rows)


def parse_index(data: bytes) -> list[tuple[str, int]]:
    """Keys and ids of a front-coded index, in order."""
    return list(index_keys(data))


def index_keys(data: bytes, wanted=None) -> Iterator[tuple[str, int]]:
    """The same one by one; wanted: a function of an id, keys of others are left out."""
    r = _Reader(data)
    if r.take(4) != b"1XDI":
        raise FormatError("not an index")
    count, restart, blocks, tokens, _ = (r.number(4) for _ in range(5))
    if not restart or blocks * 4 > len(data):
        raise FormatError("index header")
    r.take(4 * blocks)
    table = [r.take(r.number(2)) for _ in range(tokens)]
    last = b""
    for i in range(count):
        entry = r.number(4)
        shared = r.number(2) if i % restart else 0
        if shared > len(last):
            raise FormatError("prefix is longer than the key before")
        key = [last[:shared]]
        for _ in range(r.number(1)):
            t = r.number(2)
            if t != NO_TOKEN:
                if t >= len(table):
                    raise FormatError("unknown token")
                key.append(table[t])
            key.append(r.take(r.number(2)))
        last = b"".join(key)
        if wanted is None or wanted(entry):
            yield last.decode(), entry


def _tokens(keys: Iterable[bytes], freq: dict[bytes, int], delimiter: bytes = b"/") -> None:
    for k in keys:
        for p in k.split(delimiter)[:-1]:
            freq[p + delimiter] = freq.get(p + delimiter, 0) + 1


def pack_index(keys: list[tuple[str, int]], least: int = 3) -> bytes:
    """Front coding in blocks of 64; parts met at least three times go to the token table."""
    rows, freq = sorted((k.encode(), i) for k, i in keys), {}
    _tokens((k for k, _ in rows), freq)
    return pack_sorted(rows, len(rows), freq, least)


def pack_sorted(rows: Iterable[tuple[bytes, int]], n: int, freq: dict[bytes, int], least: int = 3, delimiter: bytes = b"/") -> bytes:
    """The same of n keys that come in order, with the counts of their parts."""
    table = sorted((t for t, n in freq.items() if n >= least), key=lambda t: (-freq[t], t))[: NO_TOKEN - 1]
    number = {t: i for i, t in enumerate(table)}
    strings = b"".join(len(t).to_bytes(2, "little") + t for t in table)
    body, starts, last = bytearray(), [], b""
    blocks = -(-n // RESTART)
    base = 24 + 4 * blocks + len(strings)
    for i, (k, entry) in enumerate(rows):
        body_at = len(body)
        shared = 0
        if i % RESTART == 0:
            starts.append(base + body_at)
            body += struct.pack("<I", entry)
        else:
            most = min(len(k), len(last), 0xFFFF)
            if k[:most] == last[:most]:
                shared = most
            else:
                while k[shared] == last[shared]:
                    shared += 1
            body += struct.pack("<IH", entry, shared)
        parts = k[shared:].split(delimiter)
        parts = [p + delimiter for p in parts[:-1]] + [parts[-1]]
        pieces: list[tuple[int, bytes]] = []
        for p in parts:
            if p in number and p != b"":
                pieces.append((number[p], b""))
            elif pieces:
                pieces[-1] = (pieces[-1][0], pieces[-1][1] + p)
            else:
                pieces.append((NO_TOKEN, p))
        if len(pieces) > 255:
            head = pieces[:254]
            rest = b"".join((table[t] if t != NO_TOKEN else b"") + x for t, x in pieces[254:])
            pieces = [*head, (NO_TOKEN, rest)]
        body.append(len(pieces))
        for t, x in pieces:
            body += struct.pack("<HH", t, len(x)) + x
        last = k
    return b"1XDI" + struct.pack("<5I", n, RESTART, blocks, len(table), len(strings)) + struct.pack(f"<{len(starts)}I", *starts) + strings + bytes(body)


@dataclass(frozen=True)
class Chunk:
    id: int
    offset: int
    size: int
    dict_id: int
    compression: int


def parse_chunks(data: bytes) -> tuple[list[Chunk], int]:
    """Chunk descriptors, and where chunk data begin."""
    count = int.from_bytes(data[:4], "little")
    if 4 + _CHUNK.size * count > len(data):
        raise FormatError("chunk table is cut off")
    out = [Chunk(*_CHUNK.unpack_from(data, 4 + _CHUNK.size * i)) for i in range(count)]
    if any(a.id >= b.id for a, b in zip(out, out[1:])):
        raise FormatError("chunks are out of order")
    return out, 4 + _CHUNK.size * count


def pack_chunks(rows: list[tuple[int, bytes, int, int]]) -> bytes:
    """id, data, dict_id and compression of each."""
    at, table = 0, [len(rows).to_bytes(4, "little")]
    for i, data, d, c in rows:
        table.append(_CHUNK.pack(i, at, len(data), d, c))
        at += len(data)
    return b"".join(table) + b"".join(x[1] for x in rows)


def parse_bitmap(data: bytes) -> list[int]:
    """Ids of a portable roaring bitmap."""
    r = _Reader(data)
    cookie = r.number(4)
    runs = b""
    if cookie & 0xFFFF == 12347:
        count = (cookie >> 16) + 1
        runs = r.take((count + 7) // 8)
    elif cookie == 12346:
        count = r.number(4)
    else:
        raise FormatError("not a bitmap")
    heads = [(r.number(2), r.number(2) + 1) for _ in range(count)]
    if not runs or count >= 4:
        r.take(4 * count)
    out = []
    for i, (high, n) in enumerate(heads):
        base = high << 16
        if runs and runs[i // 8] >> i % 8 & 1:
            for _ in range(r.number(2)):
                start, more = r.number(2), r.number(2)
                out.extend(range(base + start, base + start + more + 1))
        elif n <= 4096:
            out.extend(base + x for x in struct.unpack(f"<{n}H", r.take(2 * n)))
        else:
            bits = np.unpackbits(np.frombuffer(r.take(8192), np.uint8), bitorder="little")
            out.extend((base + np.flatnonzero(bits)).tolist())
    return out


def pack_bitmap(ids) -> bytes:
    ids = np.unique(np.asarray(ids, np.int64))
    highs, first = np.unique(ids >> 16, return_index=True)
    bodies, heads = [], []
    for high, low in zip(highs.tolist(), np.split((ids & 0xFFFF).astype("<u2"), first[1:])):
        heads.append(struct.pack("<HH", high, len(low) - 1))
        if len(low) > 4096:
            bits = np.zeros(65536, np.uint8)
            bits[low] = 1
            bodies.append(np.packbits(bits, bitorder="little").tobytes())
        else:
            bodies.append(low.tobytes())
    head = struct.pack("<II", 12346, len(heads)) + b"".join(heads)
    places = len(head) + 4 * len(heads) + np.cumsum([0, *map(len, bodies)])[:-1]
    return head + places.astype("<u4").tobytes() + b"".join(bodies)


def stream_postings(f, wanted=None) -> Iterator[tuple[int, list[int]]]:
    """gram and ids from an open stream of an index, list by list; wanted: a set of grams, the lists of others are skipped."""
    head = f.read(16)
    version, _, count, _ = struct.unpack_from("<4I", head) if len(head) == 16 else (0, 0, 0, 0)
    table = f.read(12 * count) if version == 1 else b""
    if version != 1 or len(table) < 12 * count:
        raise FormatError("not an index of grams")
    at = 16 + 12 * count
    rows = [(*struct.unpack_from("<II", table, 12 * i + 4), int.from_bytes(table[12 * i : 12 * i + 3], "big")) for i in range(count)]
    for place, size, gram in sorted(rows):
        if wanted is None or gram in wanted:
            if place < at:
                raise FormatError("postings overlap")
            while at < place:
                if not (skipped := len(f.read(min(place - at, 1 << 20)))):
                    raise FormatError("postings are cut off")
                at += skipped
            data = f.read(size)
            at += size
            if len(data) < size:
                raise FormatError("postings are cut off")
            yield gram, parse_bitmap(data)


def parse_postings(data: bytes) -> tuple[int, int, dict[int, list[int]]]:
    """Flags, number of documents, and ids by gram."""
    version, flags, count, docs = struct.unpack_from("<4I", data) if len(data) >= 16 else (0, 0, 0, 0)
    if version != 1 or 16 + 12 * count > len(data):
        raise FormatError("not an index of grams")
    out = {}
    for i in range(count):
        gram = int.from_bytes(data[16 + 12 * i : 19 + 12 * i], "big")
        at, size = struct.unpack_from("<II", data, 20 + 12 * i)
        if at + size > len(data):
            raise FormatError("postings are cut off")
        out[gram] = parse_bitmap(data[at : at + size])
    return flags, docs, out


def content_hash(data: bytes) -> bytes:
    import xxhash

    return xxhash.xxh64_intdigest(data).to_bytes(8, "little")


class FileRanges:
    """A file's bytes by slices: only what is asked for is read."""

    def __init__(self, f):
        self._f = f
        f.seek(0, 2)
        self._size = f.tell()

    def __len__(self) -> int:
        return self._size

    def __getitem__(self, part: slice) -> bytes:
        first, past, _ = part.indices(self._size)
        self._f.seek(first)
        return self._f.read(max(0, past - first))


class _Stretch:
    """A stretch of a file to read from, a part at a time."""

    def __init__(self, data, at: int, past: int):
        self._data, self._at, self._past = data, at, past

    def read(self, n: int = -1) -> bytes:
        first, self._at = self._at, self._past if n < 0 else min(self._past, self._at + n)
        return self._data[first : self._at]


@dataclass
class Archive:
    """A file, as bytes or FileRanges. Header, section table and metadata are read at once, each other section when it is first asked for, and chunks one by one."""

    data: bytes | FileRanges
    limits: Limits = field(default_factory=Limits)
    strict: bool = True

    def __post_init__(self):
        d = self.data
        self.header = parse_header(d[:128])
        h = self.header
        if h.table_offset + 80 * h.section_count > len(d) or h.checksum_offset + 32 > len(d):
            raise FormatError("the file is cut off")
        self.sections = parse_sections(d[h.table_offset : h.table_offset + 80 * h.section_count], h.section_count)
        for s in self.sections:
            if s.offset + s.compressed_size > h.checksum_offset:
                raise FormatError("a section lies outside the file")
        self.metadata = parse_metadata(self._one(METADATA, bytes(4)), self.limits.value)
        self._open: dict[int, bytes] = {}

    def _one(self, kind: int, empty: bytes) -> bytes:
        return self.load(s) if (s := self.section(kind)) else empty

    @cached_property
    def dictionaries(self) -> dict[int, bytes]:
        out = {}
        for s in self.sections:
            if s.kind == DICTIONARY:
                raw = decompress(self.raw(s), s.compression, {}, 0, self.limits.section)
                out[int.from_bytes(raw[:4], "little")] = raw[4:]
        return out

    @cached_property
    def mime(self) -> list[str]:
        return parse_mime(self._one(MIME, bytes(2)))

    @cached_property
    def entries(self) -> list[Record | None]:
        return parse_entries(self._one(ENTRIES, struct.pack("<II", 0, 8)), self.strict)

    @cached_property
    def columns(self) -> dict[str, np.ndarray]:
        return entry_columns(self._one(ENTRIES, struct.pack("<II", 0, 8)), self.strict)

    def keys(self, kind: int, wanted) -> dict[int, str]:
        """Paths or titles of the wanted ids alone."""
        return {i: k for k, i in index_keys(self._one(kind, b""), wanted)} if self.section(kind) else {}

    def stream(self, s: Section):
        """A section's content as a stream."""
        import zstandard

        if s.compression == NONE:
            return io.BytesIO(self.raw(s))
        if s.compression != ZSTD:
            return io.BytesIO(self.load(s))
        return zstandard.ZstdDecompressor().stream_reader(_Stretch(self.data, s.offset, s.offset + s.compressed_size))

    @cached_property
    def redirects(self) -> list[tuple[int, int]]:
        return parse_redirects(self._one(REDIRECTS, bytes(4)))

    @cached_property
    def paths(self) -> dict[int, str]:
        return {i: k for k, i in parse_index(self._one(PATHS, b""))} if self.section(PATHS) else {}

    @cached_property
    def titles(self) -> dict[int, str]:
        return {i: k for k, i in parse_index(self._one(TITLES, b""))} if self.section(TITLES) else {}

    @cached_property
    def _chunks(self) -> tuple[list[Chunk], int]:
        s = self.section(CONTENT)
        if s is None:
            return [], 4
        count = int.from_bytes(self.data[s.offset : s.offset + 4], "little")
        return parse_chunks(self.data[s.offset : s.offset + min(s.compressed_size, 4 + _CHUNK.size * count)])

    @property
    def chunks(self) -> list[Chunk]:
        return self._chunks[0]

    @cached_property
    def _chunk_by_id(self) -> dict[int, Chunk]:
        return {c.id: c for c in self.chunks}

    def section(self, kind: int) -> Section | None:
        return next((s for s in self.sections if s.kind == kind), None)

    def raw(self, s: Section) -> bytes:
        return self.data[s.offset : s.offset + s.compressed_size]

    def load(self, s: Section) -> bytes:
        if s.uncompressed_size > self.limits.section:
            raise LimitExceeded(NAMES.get(s.kind, str(s.kind)))
        return decompress(self.raw(s), s.compression, self.dictionaries if s.compression == ZSTD_DICT else {}, s.dict_id, self.limits.section)

    def packed_chunk(self, c: Chunk) -> bytes:
        s = self.section(CONTENT)
        first = self._chunks[1] + c.offset
        if first + c.size > s.compressed_size:
            raise FormatError("a chunk is cut off")
        return self.data[s.offset + first : s.offset + first + c.size]

    def chunk(self, number: int) -> bytes:
        if number not in self._open:
            c = self._chunk_by_id.get(number)
            if c is None:
                raise FormatError(f"no chunk {number}")
            if len(self._open) >= 8:
                self._open.pop(next(iter(self._open)))
            self._open[number] = decompress(self.packed_chunk(c), c.compression, self.dictionaries if c.compression == ZSTD_DICT else {}, c.dict_id, self.limits.section)
        return self._open[number]

    def chunk_size(self, c: Chunk) -> int:
        """Bytes of a chunk's content, from its frame's header where that tells it."""
        import zstandard

        if c.compression == NONE:
            return c.size
        try:
            size = zstandard.frame_content_size(self.packed_chunk(c)[:18])
        except zstandard.ZstdError as e:
            raise FormatError(f"damaged data: {e}") from e
        return size if size >= 0 else len(self.chunk(c.id))

    def blob(self, r: Record) -> bytes:
        if r.size > self.limits.blob:
            raise LimitExceeded("blob")
        data = self.chunk(r.chunk)
        if r.offset + r.size > len(data):
            raise FormatError("a blob lies outside its chunk")
        return data[r.offset : r.offset + r.size]

    def digest(self, first: int, past: int) -> bytes:
        """SHA-256 of a stretch of the file, a few MB at a time."""
        h = hashlib.sha256()
        for at in range(first, past, 4 << 20):
            h.update(self.data[at : min(past, at + (4 << 20))])
        return h.digest()

    def verify(self, tiers: tuple[str, ...] = ("file", "section", "entry"), k: int = 0, n: int = 1):
        """tier, name, expected, computed of the file, each section and each entry; only the tiers asked for are read. With n, the k-th of n parts: entries by their chunks, all else in the first."""
        end = self.header.checksum_offset
        tiers = tuple(t for t in tiers if t == "entry" or k == 0)
        if "file" in tiers:
            yield "file", "", self.data[end : end + 32], self.digest(0, end)
        for s in self.sections if "section" in tiers else ():
            yield "section", NAMES.get(s.kind, str(s.kind)), s.sha256, self.digest(s.offset, s.offset + s.compressed_size)
        if "entry" in tiers:
            c = self.columns
            mine = np.flatnonzero(c["chunk"] % n == k)
            for i in mine[np.argsort(c["chunk"][mine], kind="stable")].tolist():
                if not c["ok"][i]:
                    yield "entry", str(i), b"", b"damaged"
                else:
                    r = self.record(i)
                    try:
                        yield "entry", str(i), r.hash, content_hash(self.blob(r))
                    except FormatError as e:
                        yield "entry", str(i), r.hash, str(e).encode()

    def record(self, i: int) -> Record:
        c = self.columns
        return Record(0, bool(c["front"][i]), int(c["mime"][i]), int(c["chunk"][i]), int(c["offset"][i]), int(c["size"][i]), c["hash"][i].tobytes())

    def check(self) -> None:
        """Raises if the file's or a section's digest is wrong."""
        for tier, name, expected, computed in self.verify(("file", "section")):
            if expected != computed:
                raise ChecksumMismatch(f"{tier} {name}".strip())

    def docs(self, kind: int) -> int | None:
        """Entries that a search index covers; None without the index."""
        s = self.section(kind)
        return struct.unpack_from("<4I", self.stream(s).read(16))[3] if s else None

    def pruned(self) -> dict[str, list[int]]:
        """Grams that the writer left out of its indexes, by index."""
        raw = self.metadata.get(PRUNED_KEY)
        if not raw:
            return {}
        found = json.loads(raw)
        return {k: [int(g) for g in v] for k, v in found.items()}

    def signatures(self) -> list[tuple[bytes, bytes, int]]:
        """Public key, signature and key id of each record behind the checksum."""
        if not self.header.flags & HAS_SIGNATURES:
            return []
        r = _Reader(self.data[self.header.checksum_offset + 32 : len(self.data)])
        out = []
        for _ in range(r.number(4)):
            out.append((r.take(32), r.take(64), r.number(4)))
            r.take(28)
        return out


#: Metadata key under which a writer records the grams it pruned, so a search can leave them out of its count.
PRUNED_KEY = "search_pruned"


def chunk_key(mime: str, size: int) -> str:
    """The group content is packed with, as the column function of this name gives it."""
    bare = mime.split(";")[0].strip(" ")
    group = {"text/html": "html", "text/css": "css", "application/javascript": "js", "text/javascript": "js", "image/svg+xml": "svg"}.get(bare) or ("image" if bare.startswith("image/") else "other")
    return group if group == "image" or size >= 4096 else f"{group}-small"


class Builder:
    """Builds an archive, or a part of one, entry by entry. Finished chunks go to a temporary file; in memory stay the open chunks (one a key), records, keys and grams."""

    def __init__(self, metadata: dict[str, bytes] = {}, *, uuid: bytes | None = None, level: int = 6, chunk_bytes: int = 4 << 20, search: bool = True, prune: float = 0.5, prune_least: int | None = None, dictionaries: dict[str, tuple[int, bytes]] | None = None, secrets: list[bytes] | tuple = (), spool=None):  # noqa: B006
        self.metadata, self.uuid, self.level, self.chunk_bytes, self.search, self.prune, self.prune_least = dict(metadata), uuid or os.urandom(16), level, chunk_bytes, search, prune, prune_least
        self.dictionaries, self.secrets = dictionaries or {}, list(secrets)
        self._known: dict[bytes, tuple] = {}
        self._number: dict[str, int] = {}
        self._rows: list[tuple] = []  # front, MIME type, chunk, offset, size, hash
        self._keys: dict[int, list[tuple[bytes, int]]] = {PATHS: [], TITLES: []}
        self._redirects: list[tuple[int, int]] = []
        self._led: dict[int, list[tuple[bytes, int]]] = {PATHS: [], TITLES: []}
        self._open: dict[str, list] = {}  # number, parts, bytes
        self._chunks: dict[int, tuple[int, int, int, int]] = {}  # place in the spool, size, dictionary, compression
        self._spool = spool or tempfile.TemporaryFile()
        self._count = self.content_bytes = self._front = self._docs = 0
        self._grams: dict[str, list] = {"title": [], "body": []}
        self._cjk = {"title": False, "body": False}
        self._digests: dict[int, bytes] = {}

    def _close(self, key: str) -> None:
        import zstandard

        number, parts, _ = self._open.pop(key)
        data = b"".join(parts)
        d = self.dictionaries.get(key)
        small = data if key == "image" else compress(data, self.level, zstandard.ZstdCompressionDict(d[1]) if d else None)
        if key == "image" and len(packed := compress(data, 1)) < len(data):
            small, codec = packed, ZSTD
        else:
            codec = NONE if key == "image" else ZSTD_DICT if d else ZSTD
        self._spool.seek(0, 2)
        self._chunks[number] = (self._spool.tell(), len(small), d[0] if d and codec == ZSTD_DICT else 0, codec)
        self._spool.write(small)

    def add(self, path: str, title: str, kind: str, content: bytes, front: bool, elsewhere: set | None = None, shared: set | None = None) -> int:
        """Adds an entry and returns its id. elsewhere: digests whose content another part stores; shared: digests that other parts may refer to."""
        entry = len(self._rows)
        digest = hashlib.sha256(content).digest()  # 64 bits would trust chance
        if shared and digest in shared:
            self._digests[entry] = digest
        same = self._known.get(digest)
        if same is None and elsewhere and digest in elsewhere:
            same = self._known[digest] = (NOWHERE, 0, len(content), content_hash(content))
        if same is None:
            key = chunk_key(kind, len(content))
            if key not in self._open:
                self._open[key] = [self._count, [], 0]
                self._count += 1
            open_ = self._open[key]
            same = self._known[digest] = (open_[0], open_[2], len(content), content_hash(content))
            open_[1].append(content)
            open_[2] += len(content)
            if open_[2] >= self.chunk_bytes:
                self._close(key)
        self._rows.append((front, self._number.setdefault(kind, len(self._number)), *same))
        self._keys[PATHS].append((path.encode(), entry))
        self._keys[TITLES].append((title.encode(), entry))
        self.content_bytes += len(content)
        self._front += front
        if front and self.search:
            self._index(entry, path, title, kind, content)
        return entry

    def _index(self, entry: int, path: str, title: str, kind: str, content: bytes) -> None:
        from corvane.functions import text as T

        self._docs += 1
        body = content.decode("utf-8", "replace")
        for idx, texts in (("title", [title]), ("body", [f"{title} {path}", T.visible_text(body) if "html" in kind else body])):
            self._grams[idx].append((entry, np.unique(np.concatenate([T.grams(t) for t in texts])) if len(texts) > 1 else T.grams(title)))
            self._cjk[idx] |= any(T.has_cjk(t) for t in texts)

    def redirect(self, path: str, title: str, target: int, front: bool = False) -> int:
        """Adds a redirect to an entry's id, or to another redirect's, and returns its own."""
        number = len(self._redirects) | REDIRECT_BIT
        self._redirects.append((int(front), target))
        self._led[PATHS].append((path.encode(), number))
        self._led[TITLES].append((title.encode(), number))
        return number

    def part(self, ids=None) -> dict:
        """What was added, as arrays; ids: numbers to keep with the rows."""
        for key in list(self._open):
            self._close(key)
        front, mime, chunk, offset, size, hashes = zip(*self._rows) if self._rows else [()] * 6
        out = {"front": np.array(front, bool), "mime": np.array(mime, np.int64), "chunk": np.array(chunk, np.int64), "offset": np.array(offset, np.int64), "size": np.array(size, np.int64), "hash": np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)}
        out |= {"types": list(self._number), "chunks": [v for _, v in sorted(self._chunks.items())], "content_bytes": self.content_bytes, "fronts": self._front, "docs": self._docs, "cjk": self._cjk, "digests": self._digests, "ids": None if ids is None else np.array(ids, np.int64)}
        for kind in (PATHS, TITLES):
            keys, freq = sorted(self._keys[kind]), {}
            _tokens((k for k, _ in keys), freq)
            out[kind] = (b"".join(k for k, _ in keys), np.cumsum([0, *(len(k) for k, _ in keys)]), np.array([i for _, i in keys], np.int64), freq)
        for idx, rows in self._grams.items():
            gram = np.concatenate([g for _, g in rows]) if rows else np.zeros(0, np.int32)
            order = np.argsort(gram, kind="stable")
            entry = np.repeat(np.array([e for e, _ in rows], np.uint32), [len(g) for _, g in rows])[order] if rows else np.zeros(0, np.uint32)
            distinct, first = np.unique(gram[order], return_index=True)
            out[idx] = (distinct, np.append(first, len(order)), entry.astype(np.uint16) if len(self._rows) <= 65536 else entry)
        return out

    def save(self, path: str, ids) -> None:
        """Keeps a part under path, with its lists of entries in files of their own; the spool holds its chunks."""
        made = self.part(ids)
        for idx in ("title", "body"):
            np.save(f"{path}.{idx}.npy", made[idx][2])
            made[idx] = made[idx][:2]
        with open(f"{path}.part", "wb") as f:
            pickle.dump(made, f)

    def write(self, out) -> int:
        """Writes the archive to a file open for writing and returns its size."""
        if self._rows:
            return self.join([(self.part(), self._spool)], out)
        return self.join([], out)

    def _postings(self, parts: list[dict], starts: list[int], idx: str, docs: int) -> tuple[list[int], object]:
        """Grams that are pruned, and the index in a temporary file. Lists are joined gram by gram."""
        n = np.array([len(p[idx][0]) for p in parts], np.int64)
        gram = np.concatenate([p[idx][0] for p in parts]) if parts else np.zeros(0, np.int32)
        part, place = np.repeat(np.arange(len(parts)), n), np.concatenate([np.arange(k) for k in n]) if parts else n
        order = np.argsort(gram, kind="stable")
        cuts = np.flatnonzero(np.diff(gram[order])) + 1
        table, gone, at, lists = [], [], 0, tempfile.TemporaryFile()
        for group in np.split(order, cuts) if len(order) else ():
            ids = []
            for k, i in zip(part[group].tolist(), place[group].tolist()):
                _, first, entry = parts[k][idx]
                ids.append(entry[first[i] : first[i + 1]].astype(np.int64) + starts[k])
            ids = np.concatenate(ids)
            g = int(gram[group[0]])
            if self.prune_least is not None and len(ids) >= self.prune_least and len(ids) >= self.prune * docs:
                gone.append(g)
                continue
            b = pack_bitmap(ids)
            table.append((g, at, len(b)))
            at += len(b)
            lists.write(b)
        base = 16 + 12 * len(table)
        if base + at >= 1 << 32:
            raise LimitExceeded(f"the {idx} index is larger than the format allows")
        head = struct.pack("<4I", 1, int(any(p["cjk"][idx] for p in parts)), len(table), docs) + b"".join(g.to_bytes(3, "big") + b"\0" + struct.pack("<II", base + a, k) for g, a, k in table)
        return gone, self._spooled(head, lists, at)

    def _spooled(self, head: bytes, lists, size: int) -> tuple:
        """A section from a head and a file: its bytes in a file, their number, the content's and the codec."""
        import zstandard

        body, whole = tempfile.TemporaryFile(), len(head) + size
        lists.seek(0)
        with zstandard.ZstdCompressor(level=self.level).stream_writer(body, size=whole, closefd=False) as z:
            z.write(head)
            while block := lists.read(1 << 20):
                z.write(block)
        if (small := body.tell()) < whole:
            lists.close()
            return body, small, whole, ZSTD
        body.seek(0)
        body.truncate()
        body.write(head)
        lists.seek(0)
        while block := lists.read(1 << 20):
            body.write(block)
        return body, whole, whole, NONE

    def join(self, parts: list[tuple[dict, object]], out) -> int:
        """Writes an archive of parts in the order of their ids, each with a file of its chunks; chunks and lists are passed through, so memory holds records and keys only."""
        spools, parts = [f for _, f in parts], [p for p, _ in parts]
        starts, count, chunks, numbers, places = [], 0, [], {m: i for i, m in enumerate(FIXED_MIME)}, {}
        for k, p in enumerate(parts):
            starts.append(count)
            p["mime"] = np.array([numbers.setdefault(m, len(numbers)) for m in p["types"]], np.int64)[p["mime"]]
            p["chunk"] = np.where(p["chunk"] == NOWHERE, NOWHERE, p["chunk"] + len(chunks))
            chunks += [(k, *c) for c in p["chunks"]]
            for i, digest in p["digests"].items():
                if digest not in places and p["chunk"][i] != NOWHERE:
                    places[digest] = (p["chunk"][i], p["offset"][i])
                p["chunk"][i], p["offset"][i] = places[digest]
            count += len(p["size"])
        docs = sum(p["docs"] for p in parts)
        made: list[tuple[int, bytes | tuple | None]] = [(MIME, pack_mime(list(numbers))), (ENTRIES, pack_entries(parts))]
        for kind in (PATHS, TITLES):
            freq: dict[bytes, int] = {}
            for p in parts:
                for t, n in p[kind][3].items():
                    freq[t] = freq.get(t, 0) + n
            _tokens((k for k, _ in self._led[kind]), freq)
            made.append((kind, pack_sorted(heapq.merge(*map(_keys, [p[kind] for p in parts], starts), sorted(self._led[kind])), count + len(self._redirects), freq)))
            for p in parts:
                p[kind] = None
        made.append((CONTENT, None))
        if self._redirects:
            made.append((REDIRECTS, pack_redirects(self._redirects)))
        made += [(DICTIONARY, i.to_bytes(4, "little") + d) for i, d in self.dictionaries.values()]
        if self.search:
            pruned = {}
            for kind, idx in ((SEARCH_TITLE, "title"), (SEARCH_BODY, "body")):
                gone, spooled = self._postings(parts, starts, idx, docs)
                if gone:
                    pruned[idx] = gone
                made.append((kind, spooled))
            if pruned:
                self.metadata[PRUNED_KEY] = json.dumps(pruned).encode()
        made.insert(0, (METADATA, pack_metadata(self.metadata)))
        at, rows = 0, [len(chunks).to_bytes(4, "little")]
        for number, (_, _, size, dictionary, codec) in enumerate(chunks):
            rows.append(_CHUNK.pack(number, at, size, dictionary, codec))
            at += size
        chunk_table, content_bytes = b"".join(rows), at

        def content():
            yield chunk_table
            for k, place, size, *_ in chunks:
                spools[k].seek(place)
                yield spools[k].read(size)

        def blocks(body):
            if body is None:
                yield from content()
            elif isinstance(body, bytes):
                yield body
            else:
                body.seek(0)
                while block := body.read(1 << 20):
                    yield block

        at, table, bodies = 128 + 80 * len(made), [], []
        for kind, raw in made:
            codec, body = NONE, raw
            if raw is None:
                size = whole = len(chunk_table) + content_bytes
            elif isinstance(raw, tuple):
                body, size, whole, codec = raw
            else:
                if kind != DICTIONARY and len(raw) >= 256 and len(small := compress(raw, self.level)) < len(raw):
                    body, codec = small, ZSTD
                size, whole = len(body), len(raw)
            h = hashlib.sha256()
            for block in blocks(body):
                h.update(block)
            table.append(Section(kind, 0, at, size, whole, codec, 0, h.digest()))
            bodies.append(body)
            at += size
        flags = (HAS_SEARCH if self.search else 0) | (HAS_SIGNATURES if self.secrets else 0)
        fronts = sum(p["fronts"] for p in parts) + sum(f for f, _ in self._redirects)
        header = Header(self.uuid, len(made), count, sum(p["content_bytes"] for p in parts), 128, at, flags, len(self._redirects), fronts)
        digest, size = hashlib.sha256(), 0

        def put(data: bytes):
            nonlocal size
            digest.update(data)
            size += len(data)
            out.write(data)

        put(header.pack() + b"".join(s.pack() for s in table))
        for body in bodies:
            for block in blocks(body):
                put(block)
        tail = digest.digest()
        if self.secrets:
            from corvane.functions.ed25519 import public_key, sign

            tail += len(self.secrets).to_bytes(4, "little")
            for number, secret in enumerate(self.secrets, 1):
                tail += public_key(secret) + sign(secret, digest.digest()) + number.to_bytes(4, "little") + bytes(28)
        out.write(tail)
        self._spool.close()
        return size + len(tail)


def _keys(keys: tuple, start: int) -> Iterator[tuple[bytes, int]]:
    """A part's keys in order, with the archive's ids."""
    text, ends, ids, _ = keys
    for k, i in enumerate(ids.tolist()):
        yield text[ends[k] : ends[k + 1]], i + start


def load_part(path: str) -> dict:
    """A part that was kept; its lists of entries stay in their files."""
    with open(f"{path}.part", "rb") as f:
        made = pickle.load(f)
    for idx in ("title", "body"):
        made[idx] = (*made[idx], np.load(f"{path}.{idx}.npy", mmap_mode="r"))
    return made


def build(metadata: dict[str, bytes], entries: list[tuple[str, str, str, bytes, bool]], redirects: list[tuple[str, str, int, bool]] = (), *, secret: bytes | None = None, **options) -> bytes:
    """A whole archive in memory. entries: path, title, MIME type, content, front; in id order. redirects: path, title, target, front. Options as Builder's."""
    made = Builder(metadata, secrets=[secret] if secret else options.pop("secrets", ()), **options)
    for e in entries:
        made.add(*e)
    for r in redirects:
        made.redirect(*r)
    out = io.BytesIO()
    made.write(out)
    return out.getvalue()
