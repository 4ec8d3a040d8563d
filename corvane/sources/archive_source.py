"""Spark data source ``content-archive`` over archive files, and the writer of one file an archive.

Options: ``table`` (archives, metadata, mime, sections, entries, redirects, chunks, content, postings, pruned, verify, signatures), ``mode`` (FAILFAST or
PERMISSIVE: damaged entry records are skipped), ``damaged`` (fail or skip: files and blobs that can't be read are left out, with a warning), ``verify`` (true: the file's and its sections'
digests are checked before anything is read), ``tiers`` (of the table verify: file, section, entry), ``recursive``, ``suffix``, and the limits ``max_section``,
``max_blob`` and ``max_value``. The path may be a file, a folder or a pattern on a file system all executors see. The
tables content, entries and verify are read in a task for each 64 MB of a file, each for its own chunks, and postings in one an index; all others in one a file. A task reads the parts of a file that its table
needs. Filters on archive, entry_id, path, mime_type and gram choose the files, entries, chunks and lists that are read.
"""

from __future__ import annotations

import glob
import os
import re
import shutil
import uuid
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from corvane.session import cut
from corvane.sources import archive_format as A

SCHEMAS = {
    "archives": "archive string, uuid string, major int, minor int, flags long, entry_count long, redirect_count long, front_count long, content_size long, file_size long, section_count int, title_docs long, body_docs long",
    "metadata": "archive string, key string, value binary",
    "mime": "archive string, mime_index int, mime_type string",
    "sections": "archive string, idx int, type int, type_name string, offset long, compressed_size long, uncompressed_size long, compression int, dict_id long, sha256 string",
    "entries": "archive string, entry_id long, path string, title string, mime_type string, is_front boolean, chunk_id long, blob_offset long, size long, content_hash string",
    "redirects": "archive string, redirect_id long, path string, title string, is_front boolean, target_id long",
    "chunks": "archive string, chunk_id long, compression int, dict_id long, compressed_size long, size long",
    "content": "archive string, entry_id long, path string, title string, mime_type string, is_front boolean, size long, content binary",
    "postings": "archive string, idx string, gram int, entry_id long",
    "pruned": "archive string, idx string, gram int",
    "verify": "archive string, tier string, name string, expected string, computed string, ok boolean",
    "signatures": "archive string, nth int, public_key string, key_id long, valid boolean",
}
#: Bytes of a file for each task that reads it.
_SPLIT = 64 << 20
#: Bytes of content of a part that a task packs at once.
_PART = 32 << 20
INDEXES = ("title", "body")


class _Part(InputPartition):
    def __init__(self, file: str, k: int, n: int):
        self.file, self.k, self.n = file, k, n


def find(path: str, suffix: str = "", recursive: bool = False) -> list[str]:
    """Files under a path, in order and each once; links to folders aren't followed."""
    path = re.sub("^file:(//)?", "", path)
    if os.path.isfile(path):
        return [os.path.abspath(path)]
    if os.path.isdir(path):
        walk = os.walk(path) if recursive else [next(os.walk(path))]
        found = [os.path.join(d, f) for d, _, files in walk for f in files]
    else:
        found = [f for f in glob.glob(path, recursive=recursive) if os.path.isfile(f)]
    return sorted({os.path.abspath(f) for f in found if f.endswith(suffix) and not os.path.basename(f).startswith(("_", "."))})


def slug_of(file: str) -> str:
    """File name without suffix and trailing dated parts."""
    return re.sub(r"(?<=.)(_[0-9][^_]{3,})+$", "", os.path.basename(file).rpartition(".")[0] or os.path.basename(file))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self._table = options.get("table", "entries").lower()
        self._strict = options.get("mode", "FAILFAST").upper() != "PERMISSIVE"
        self._limits = A.Limits(int(options.get("max_section", A.Limits.section)), int(options.get("max_blob", A.Limits.blob)), int(options.get("max_value", A.Limits.value)))
        self._files = find(options["path"], options.get("suffix", ""), str(options.get("recursive", "false")).lower() == "true")
        self._skip = options.get("damaged", "fail").lower() == "skip"
        self._check = str(options.get("verify", "false")).lower() == "true"
        self._tiers = tuple(x.strip() for x in options.get("tiers", "file,section,entry").split(","))
        self._wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        """Equality and IN on archive, entry_id, path, mime_type and gram choose files, entries and so chunks, and lists to read; Spark still applies every filter."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in ("archive", "entry_id", "path", "mime_type", "gram"):
                name = f.attribute[0]
                self._wanted[name] = self._wanted[name] & values if name in self._wanted else values
            yield f

    def _is_wanted(self, name: str, value) -> bool:
        return name not in self._wanted or value in self._wanted[name]

    def partitions(self):
        files = [f for f in self._files if self._is_wanted("archive", slug_of(f))]
        return [_Part(f, k, n) for f in files for n in [self._splits(f)] for k in range(n)]

    def _splits(self, file: str) -> int:
        if self._table == "postings":
            return 2
        if self._table not in ("content", "entries", "verify") or self._wanted.keys() & {"entry_id", "path"}:
            return 1  # small, or a few entries
        return 1 + os.path.getsize(file) // _SPLIT

    def read(self, part) -> Iterator[tuple]:
        if part is None:  # no file is wanted
            return
        name = slug_of(part.file)
        try:
            with open(part.file, "rb") as f:
                a = A.Archive(A.FileRanges(f), self._limits, self._strict)
                if self._check:
                    a.check()
                rows = ((name, *row) for row in getattr(self, f"_{self._table}")(a, part))
                yield from list(rows) if self._skip and self._table not in ("content", "postings") else rows
        except (A.FormatError, OSError) as e:
            if not self._skip:
                raise
            warnings.warn(f"{part.file} is left out: {e}", stacklevel=1)

    def _archives(self, a, part):
        h = a.header
        yield a.header.uuid.hex(), h.major, h.minor, h.flags, h.entry_count, h.redirect_count, h.front_count, h.content_size, len(a.data), h.section_count, a.docs(A.SEARCH_TITLE), a.docs(A.SEARCH_BODY)

    def _metadata(self, a, part):
        yield from a.metadata.items()

    def _mime(self, a, part):
        yield from enumerate(a.mime)

    def _sections(self, a, part):
        for i, s in enumerate(a.sections):
            yield i, s.kind, A.NAMES.get(s.kind, f"UNKNOWN_{s.kind}"), s.offset, s.compressed_size, s.uncompressed_size, s.compression, s.dict_id, s.sha256.hex()

    def _rows(self, a, part):
        """The part's entries by chunk, so each chunk is read and decompressed once; only their keys are kept."""
        import numpy as np

        c = a.columns
        mine = c["ok"] & (c["chunk"] % part.n == part.k)
        if "entry_id" in self._wanted:
            asked = np.zeros(len(mine), bool)
            asked[[i for i in self._wanted["entry_id"] if i is not None and 0 <= i < len(mine)]] = True
            mine &= asked
        wanted = lambda i: i < len(mine) and mine[i]
        paths, titles = a.keys(A.PATHS, wanted), a.keys(A.TITLES, wanted)
        ids = np.flatnonzero(mine)
        for i in ids[np.argsort(c["chunk"][ids], kind="stable")].tolist():
            r = a.record(i)
            if r.mime >= len(a.mime):
                if self._strict:
                    raise A.FormatError(f"entry {i} has MIME type {r.mime}")
                continue
            path, mime = paths.get(i, ""), a.mime[r.mime]
            if self._is_wanted("path", path) and self._is_wanted("mime_type", mime):
                yield i, r, path, titles.get(i, ""), mime

    def _entries(self, a, part):
        for i, r, path, title, mime in self._rows(a, part):
            yield i, path, title, mime, r.front, r.chunk, r.offset, r.size, r.hash.hex()

    def _redirects(self, a, part):
        led = lambda i: i >= A.REDIRECT_BIT
        paths, titles = a.keys(A.PATHS, led), a.keys(A.TITLES, led)
        for i, (flags, target) in enumerate(a.redirects):
            tagged = i | A.REDIRECT_BIT
            yield tagged, paths.get(tagged, ""), titles.get(tagged, ""), bool(flags & 1), target

    def _chunks(self, a, part):
        for c in a.chunks:
            yield c.id, c.compression, c.dict_id, c.size, a.chunk_size(c)

    def _content(self, a, part):
        for i, r, path, title, mime in self._rows(a, part):
            try:
                blob = a.blob(r)
            except A.FormatError:
                if self._skip:
                    continue
                raise
            yield i, path, title, mime, r.front, r.size, blob

    def _postings(self, a, part):
        s = a.section((A.SEARCH_TITLE, A.SEARCH_BODY)[part.k])
        if s:
            for gram, ids in A.stream_postings(a.stream(s), self._wanted.get("gram")):
                for i in ids:
                    yield INDEXES[part.k], gram, i

    def _pruned(self, a, part):
        for idx, grams in a.pruned().items():
            for gram in grams:
                yield idx, gram

    def _verify(self, a, part):
        for tier, name, expected, computed in a.verify(self._tiers, part.k, part.n):
            yield tier, name, expected.hex(), computed.hex(), expected == computed

    def _signatures(self, a, part):
        from corvane.functions.ed25519 import verify

        digest = a.data[a.header.checksum_offset : a.header.checksum_offset + 32]
        for i, (key, signature, number) in enumerate(a.signatures()):
            yield i, key.hex(), number, verify(key, digest, signature)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls):
        return "content-archive"

    def schema(self):
        table = self.options.get("table", "entries").lower()
        if table not in SCHEMAS:
            raise ValueError(f"no table {table}; there are {', '.join(SCHEMAS)}")
        return SCHEMAS[table]

    def reader(self, schema):
        return _Reader(dict(self.options))


def read_archives(spark: SparkSession, path: str, table: str = "entries", **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("content-archive").options(table=table, **options).load(path)


def write_archives(entries: DataFrame, out: str, suffix: str = ".car", metadata: DataFrame | None = None, redirects: DataFrame | None = None, strict: bool = False, **options) -> DataFrame:
    """Writes a file for each archive and returns archive, file and bytes.

    Tasks of all executors compress and index stretches of ids, which they keep as parts of 32 MB of content in the folder ``.parts-...`` beside the files; digests are compared over an archive before,
    so content is stored once. The parts are removed when the files are written, which is done when this returns. An archive is one file, so one task joins its parts, archives side by side: compressed chunks and lists of ids are passed through, not held.
    entries: archive, entry_id, path, title, mime_type, is_front, content; entries are numbered anew in the order of entry_id.
    metadata: archive, key, value; required keys that an archive lacks get defaults, or with ``strict`` fail the write, as a key that occurs twice always does.
    redirects: archive, redirect_id, path, target_id (an entry_id or a redirect_id of the archive), title and is_front if there; one whose target isn't there fails the write.
    Options as the builder's (search, prune, chunk_bytes, level, secrets, ...).
    """
    folder = re.sub("^file:(//)?", "", out)
    work = f"{folder}/.parts-{uuid.uuid4().hex}"
    os.makedirs(work, exist_ok=True)
    spark = entries.sparkSession
    null = lambda kind: F.lit(None).cast(kind)
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    rows = entries.select("archive", F.col("entry_id").alias("id"), F.lit(1).alias("kind"), "path", "title", "mime_type", "is_front", content.alias("content"))
    digests = entries.select("archive", F.col("entry_id").alias("id"), F.unhex(F.sha2(content, 256)).alias("digest"))
    copies = digests.groupBy("archive", "digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # before each entry whose content others have too: its digest, and whether it's the first
    marks = digests.join(copies, ["archive", "digest"]).select("archive", "id", F.lit(0).alias("kind"), null("string").alias("path"), null("string").alias("title"), null("string").alias("mime_type"), (F.col("id") == F.col("first")).alias("is_front"), F.col("digest").alias("content"))
    building = {k: v for k, v in options.items() if k not in ("secrets", "prune", "prune_least", "uuid")}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = {"made": None}

        def close():
            if state["made"] is None:
                return []
            made, path = state["made"], state["path"]
            made.save(path, state["ids"])
            state["spool"].close()
            state["made"] = None
            return [(state["archive"], state["ids"][0], state["nth"], path)]

        mark, first, nth = None, True, 0
        for b in batches:
            done = []
            for archive, i, kind, path, title, mime, front, content in b.itertuples(index=False):
                if kind == 0:
                    if mark is None or mark[:2] != (archive, i):
                        mark = (archive, i, {}, set())
                    mark[2][bytes(content)] = bool(front)
                    continue
                if state["made"] is not None and (state["archive"] != archive or state["made"].content_bytes >= _PART or len(state["ids"]) >= 65536):
                    done += close()
                if state["made"] is None:
                    at, nth = f"{work}/{uuid.uuid4().hex}", nth + 1
                    state |= {"archive": archive, "path": at, "ids": [], "nth": nth, "spool": open(f"{at}.chunks", "w+b")}
                    state["made"] = A.Builder(spool=state["spool"], **building)
                known = mark[2] if mark is not None and mark[:2] == (archive, i) else {}
                state["made"].add(path or "", title or "", mime or "application/octet-stream", bytes(content), front is not None and front == front and bool(front), {d for d, own in known.items() if not own}, set(known))
                state["ids"].append(int(i))
            if done:
                yield pd.DataFrame(done, columns=["archive", "id", "nth", "path"])
        if done := close():
            yield pd.DataFrame(done, columns=["archive", "id", "nth", "path"])

    packed = rows.unionByName(marks).repartitionByRange("archive", "id").sortWithinPartitions("archive", "id", "kind").mapInPandas(pack, "archive string, id long, nth int, path string")
    columns = ("archive", "kind", "id", "nth", "path", "title", "is_front", "content", "target")
    rows = cut(packed).select("archive", F.lit(1).alias("kind"), "id", "nth", "path", null("string").alias("title"), null("boolean").alias("is_front"), null("binary").alias("content"), null("long").alias("target"))
    if metadata is not None:
        rows = rows.unionByName(metadata.select("archive", F.lit(0).alias("kind"), null("long").alias("id"), null("int").alias("nth"), F.col("key").alias("path"), null("string").alias("title"), null("boolean").alias("is_front"), F.col("value").cast("binary").alias("content"), null("long").alias("target")))
    if redirects is not None:
        own = lambda c, kind: F.col(c) if c in redirects.columns else null(kind)
        rows = rows.unionByName(redirects.select("archive", F.lit(2).alias("kind"), F.col("redirect_id").alias("id"), null("int").alias("nth"), "path", own("title", "string").alias("title"), own("is_front", "boolean").alias("is_front"), null("binary").alias("content"), F.col("target_id").alias("target")))

    def finish(name: str, made: A.Builder, paths: list, waiting: list) -> tuple:
        import numpy as np
        from pyspark import TaskContext

        lacking = [k for k in ("title", "language", "creator", "date", "source") if not made.metadata.get(k, b"").strip()]
        if strict and lacking:
            raise ValueError(f"archive {name} lacks metadata: {', '.join(lacking)}")
        defaults = {"title": name, "language": "und", "creator": "unknown", "date": "1970-01-01", "source": name}
        made.metadata |= {k: defaults[k].encode() for k in lacking}
        parts = [A.load_part(p) for p in paths]
        ids = np.concatenate([np.zeros(0, np.int64), *(p["ids"] for p in parts)])  # in order, as the parts are
        redirect_ids = {i: k | A.REDIRECT_BIT for k, (i, *_) in enumerate(waiting)}
        for _, path, title, target, front in waiting:
            at = int(np.searchsorted(ids, target, "right")) - 1
            goal = at if at >= 0 and ids[at] == target else redirect_ids.get(target)
            if goal is None:
                raise ValueError(f"redirect {path} of archive {name} leads to {target}, which isn't there")
            made.redirect(path, title, goal, front)
        os.makedirs(folder, exist_ok=True)
        own, final = f"{folder}/.{name}-{TaskContext.get().taskAttemptId()}", f"{folder}/{name}{suffix}"
        spools = [open(f"{p}.chunks", "rb") for p in paths]
        with open(own, "wb") as f:
            size = made.join(list(zip(parts, spools)), f)
        for f in spools:
            f.close()
        os.replace(own, final)
        return name, final, size

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, made, paths, waiting = None, None, [], []
        for b in batches:
            done = []
            for archive, kind, i, _, path, title, front, content, target in b.itertuples(index=False):
                if archive != name or made is None:
                    if made is not None:
                        done.append(finish(name, made, paths, waiting))
                    name, paths, waiting = archive, [], []
                    made = A.Builder(uuid=A.hashlib.md5((name or "").encode()).digest(), **options)
                if kind == 0:
                    if path in made.metadata:
                        raise ValueError(f"archive {name} has metadata {path} twice")
                    made.metadata[path] = b"" if content is None else bytes(content)
                elif kind == 1:
                    paths.append(path)
                else:
                    waiting.append((int(i), path or "", title or "", int(target), front is not None and front == front and bool(front)))
            if done:
                yield pd.DataFrame(done, columns=["archive", "file", "bytes"])
        if made is not None:
            yield pd.DataFrame([finish(name, made, paths, waiting)], columns=["archive", "file", "bytes"])

    # a fixed number of tasks: there are few rows, which would be put together, but each stands for much work
    n = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        return cut(rows.select(*columns).repartition(n, "archive").sortWithinPartitions("archive", "kind", "id", "nth").mapInPandas(stream, "archive string, file string, bytes long"))
    finally:
        shutil.rmtree(work, ignore_errors=True)
