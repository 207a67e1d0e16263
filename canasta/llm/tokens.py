"""Token ids as Arrow files of equal-length sequences.

A data set is a folder of file pairs, numbered in the order of the ids:

* ``NNNNNN.arrow``: the ids of its documents end to end, cut into sequences of ``length``. Columns
  ``ids`` (fixed-size list of uint16, or uint32 for large vocabularies), ``mask`` (fixed-size list of
  bool, false on the padding after the last id) and ``ends`` (fixed-size list of bool, true on the last
  id of a document). Every batch has ``BATCH`` sequences, the last one of a file possibly fewer, so
  sequence i lies in batch i // BATCH and a memory-mapped file yields it without a copy.
* ``NNNNNN.docs.arrow``: ``doc_id`` of each document in order, with its first position in the file.

Documents are ordered by id, then text; null ids come first. A null text is an empty one: it
has the end id alone. Repeated rows are written as often as they occur. An empty table gives no file.
"""

from __future__ import annotations

import posixpath
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canasta.llm.shared import folder, small_batches, written
from canasta.llm.words import chunks, texts_of

LENGTH = 2048
#: Sequences of a record batch.
BATCH = 128
#: Pieces whose ids a worker remembers.
REMEMBERED = 1_000_000
#: Bytes of text that are encoded at once; a longer text alone.
TOGETHER = 100_000

#: Texts by which a vocabulary is tried for sure borders of pieces.
TRIALS = [
    "The quick brown fox, it's 12345 km away; isn't it? Yes!",
    "a b  c   d\te\n f\n\ng\r\nh ",
    "naïve façade – “quoted” … über größe ñandú, x.y:z!",
    "CamelCase snake_case 3.14 1,000 a1b2 $5 #tag @me http://a.b/c?d=e",
    "漢字 かな 한글 😀 end. Next line,\nnew? word!\nend",
]

MANIFEST = "part int, n_docs long, n_tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"

#: A blank between two characters that are no white space: a sure border of two pieces.
#: Marks that end a piece of their own after a letter or digit.
_MARKS = ".,;:!?"
_SURE = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct piece encoded once.

    The vocabulary's pattern always begins a new piece at a blank between two characters that are no
    white space, and no merge crosses pieces. Texts are cut there, and the ids of a text are those of
    its pieces in order. New pieces are encoded together, a line each: a line break between two of them
    is one id of its own. Whether a vocabulary cuts so is tried on ``TRIALS``; with one that does not, whole
    texts are encoded.

    Strings of special tokens become their ids, as the library does it; texts that hold one are encoded
    whole. With ``special_as_text`` they are ordinary text.
    """

    def __init__(self, path: str, end_id: int, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.type).tobytes()
        self.line = self._ids("\n")[0]
        #: Ids of pieces at the beginning of a text or line, and of those after a blank (not part of the key).
        self.first: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.cuts = self._cuts_hold()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)

    def _remembered(self, part: str) -> bytes | None:
        return self.known.get(part[1:]) if part[:1] == " " else self.first.get(part)

    def _encoded(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of ``pieces``. They are cut further at single line breaks and before the marks after a
        letter or digit, where no token crosses; parts are remembered, and of the pieces the earliest."""
        parts, new = {}, set()
        for piece in pieces:
            own, lines = [], [piece]
            if "\n" in piece:
                lines = piece.split("\n")
                if any(not x or x != x.strip() for x in (lines[0].removeprefix(" "), *lines[1:])):
                    lines = [piece]
            for line in lines:
                core = line.rstrip(_MARKS)
                if len(core) < len(line) and core[-1:].isalnum():
                    own += ["\n", core, line[len(core) :]] if own else [core, line[len(core) :]]
                else:
                    own += ["\n", line] if own else [line]
            parts[piece] = own
            new.update(own)
        have = {x: self._remembered(x) for x in new}
        new = [x for x, ids in have.items() if ids is None]
        plain = [x for x in new if x.split() == [x[x[:1] == " " :]]]
        ids = self._ids("\n".join(plain))
        ends = np.flatnonzero(ids == self.line).tolist()
        raw, width = ids.tobytes(), self.type.itemsize
        spans = zip([0, *(e + 1 for e in ends)], [*ends, len(ids)], strict=True)
        fresh = dict(zip(plain, (raw[a * width : b * width] for a, b in spans), strict=True)) if plain else {}
        have |= fresh
        have |= {x: self._ids(x).tobytes() for x in new if x not in fresh}
        if len(self.known) + len(self.first) + len(fresh) <= REMEMBERED:
            self.known.update((x[1:], i) for x, i in fresh.items() if x[:1] == " ")
            self.first.update((x, i) for x, i in fresh.items() if x[:1] != " ")
        out = {p: have[own[0]] if len(own) == 1 else b"".join([have[x] for x in own]) for p, own in parts.items()}
        if len(self.known) + len(out) <= REMEMBERED // 3:
            self.known.update((p[1:], i) for p, i in out.items() if p[:1] == " " and p[1:] and p[1:] == p[1:].strip())
        return out

    def _cuts_hold(self) -> bool:
        whole = [self._ids(t).tobytes() for t in TRIALS]
        try:
            return self._cut(TRIALS) == whole
        except (ValueError, KeyError):  # a line of its own is not even an id of its own
            return False

    def _is_whole(self, text: str | None) -> bool:
        return bool(text) and (not self.cuts or self.added is not None and self.added.search(text) is not None)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        whole = {i: self._ids(t).tobytes() for i, t in enumerate(texts) if self._is_whole(t)}
        found = self._cut([None if i in whole else t for i, t in enumerate(texts)])
        return [np.frombuffer(whole.get(i, ids) + self.end, self.type) for i, ids in enumerate(found)]

    def _cut(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts without special tokens, by pieces."""
        get, cut, found, new = self.known.get, [], [], set()
        for text in texts:
            pieces = text.split(" ") if text else []
            ids = list(map(get, pieces))
            missing = {p for p, i in zip(pieces, ids, strict=True) if i is None} if None in ids else ()
            if any(not p or p != p.strip() for p in missing) or not all(pieces[:1]):
                pieces = _SURE.split(text)
                ids = list(map(get, pieces))
                missing = {p for p, i in zip(pieces, ids, strict=True) if i is None}
            if pieces:
                new.add(pieces[0])
                new.update(map(" ".__add__, missing))
            cut.append(pieces)
            found.append(ids)
        fresh = self._encoded(new)
        for pieces, ids in zip(cut, found, strict=True):
            if pieces:
                if None in ids:
                    ids[:] = [fresh[" " + p] if i is None else i for p, i in zip(pieces, ids, strict=True)]
                ids[0] = fresh[pieces[0]]
        return [b"".join(ids) for ids in found]


_encoders: dict[tuple, Encoder] = {}


def _encoder(*options) -> Encoder:
    if options not in _encoders:
        _encoders[options] = Encoder(*options)
    return _encoders[options]


def _by_parts(encode: Encoder, texts: pa.Array):
    """Ids of ``texts``, a few at a time: the lists of their pieces take far more memory than the texts."""
    for at, end in chunks(texts_of(texts)[1], TOGETHER):
        yield from encode(texts.slice(at, end - at).to_pylist())


class _Sequences:
    """Writes ids as sequences to one file."""

    def __init__(self, sink, kind: np.dtype, length: int):
        lists = lambda t: pa.list_(t, length)
        self.schema = pa.schema(
            [("ids", lists(pa.from_numpy_dtype(kind))), ("mask", lists(pa.bool_())), ("ends", lists(pa.bool_()))]
        )
        self.out = pa.ipc.new_file(sink, self.schema)
        self.kind, self.length, self.room = kind, length, length * BATCH
        self.ids, self.ends, self.waiting = [], [], 0

    def add(self, ids: np.ndarray):
        ends = np.zeros(len(ids), bool)
        ends[-1] = True
        self.ids.append(ids)
        self.ends.append(ends)
        self.waiting += len(ids)
        if self.waiting >= self.room:
            self._flush(self.waiting // self.room * self.room)

    def _flush(self, take: int):
        ids, ends = np.concatenate(self.ids), np.concatenate(self.ends)
        self.ids, self.ends, self.waiting = [ids[take:]], [ends[take:]], len(ids) - take
        for at in range(0, take, self.room):
            self._batch(ids[at : min(take, at + self.room)], ends[at : min(take, at + self.room)])

    def _batch(self, ids, ends):
        pad = -len(ids) % self.length
        mask = np.repeat([True, False], [len(ids), pad])
        columns = [np.append(ids, np.zeros(pad, self.kind)), mask, np.append(ends, np.zeros(pad, bool))]
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(c), self.length) for c in columns]
        self.out.write_batch(pa.record_batch(arrays, schema=self.schema))

    def close(self):
        if self.waiting:
            self._flush(self.waiting)
        self.out.close()


def _store(uri: str):
    return pa.fs.FileSystem.from_uri(uri)


def write_sequences(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 0,
    length: int = LENGTH,
    doc_id: str = "doc_id",
    text: str = "text",
    special_as_text: bool = False,
) -> DataFrame:
    """Encodes ``docs`` and writes the data set to ``path``; returns its manifest, one row per file pair.

    The ids are range partitioned, so each task writes one file pair of its range. A task writes under a
    name of its attempt and renames at the end: a repeated task replaces its pair by the same bytes.
    ``tokenizer`` is the vocabulary's path, which each executor can read.
    """

    def write(batches):
        context = TaskContext.get()
        fs, base = _store(path)
        fs.create_dir(base, recursive=True)
        encode = _encoder(tokenizer, end_id, special_as_text)
        name = posixpath.join(base, f"{context.partitionId():06d}")
        attempt = f".{context.taskAttemptId()}"
        names, starts, at, out = [], [], 0, None
        with fs.open_output_stream(f"{name}.arrow{attempt}") as sink:
            out = _Sequences(sink, encode.type, length)
            for batch in batches:
                names += batch.column(0).to_pylist()
                for ids in _by_parts(encode, batch.column(1)):
                    starts.append(at)
                    at += len(ids)
                    out.add(ids)
            out.close()
        if not names:
            fs.delete_file(f"{name}.arrow{attempt}")
            return
        index = pa.table({"doc_id": pa.array(names, pa.int64()), "start": pa.array(starts, pa.int64())})
        with fs.open_output_stream(f"{name}.docs.arrow{attempt}") as sink, pa.ipc.new_file(sink, index.schema) as f:
            f.write_table(index)
        for kind in ("arrow", "docs.arrow"):
            fs.move(f"{name}.{kind}{attempt}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([context.partitionId()], pa.int32()),
                "n_docs": pa.array([len(names)], pa.int64()),
                "n_tokens": pa.array([at], pa.int64()),
            }
        )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(write, MANIFEST), "manifest")


def open_sequences(path: str, part: int):
    """A reader of one file; mapped into memory where the file is local."""
    fs, base = _store(path)
    name = posixpath.join(base, f"{part:06d}.arrow")
    local = isinstance(fs, pa.fs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(name) if local else fs.open_input_file(name))


def sequence(path: str, part: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a view of the file where it is mapped) and mask of one sequence."""
    row = open_sequences(path, part).get_batch(number // BATCH).slice(number % BATCH, 1)
    ids = row.column("ids").flatten().to_numpy(zero_copy_only=True)
    return ids, row.column("mask").flatten().to_numpy(zero_copy_only=False)


def read_documents(manifest: DataFrame, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start over the whole data set, n_tokens, ids_crc32."""

    def read(batches):
        _encoders.clear()  # the files are written; workers live on with what they remember
        fs, base = _store(path)
        for batch in batches:
            for part, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(posixpath.join(base, f"{part:06d}.docs.arrow")) as f:
                    names = pa.ipc.open_file(f).read_all().column("doc_id").combine_chunks()
                sums, borders, crc, passed = [], [0], 0, 0
                reader = open_sequences(path, part)
                for i in range(reader.num_record_batches):
                    rows = reader.get_batch(i)
                    mask = rows.column("mask").flatten().to_numpy(zero_copy_only=False)
                    ids = rows.column("ids").flatten().to_numpy(zero_copy_only=True)[: int(mask.sum())]
                    ids = ids.astype("<u4", copy=False)
                    ends = np.flatnonzero(rows.column("ends").flatten().to_numpy(zero_copy_only=False)) + 1
                    at = 0
                    for end in ends.tolist():
                        sums.append(zlib.crc32(ids[at:end], crc))
                        at, crc = end, 0
                    crc = zlib.crc32(ids[at:], crc)
                    borders += (ends + passed).tolist()
                    passed += len(ids)
                border = np.array(borders, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(border[:-1] + before), pa.array(np.diff(border)), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = max(1, manifest.count())
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("before")
    return manifest.select("part", before).repartition(files).mapInArrow(read, DOCUMENTS)


def encoded_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes ``docs`` to a fresh folder of the shared one and reads the files back."""
    path = folder(docs.sparkSession, "sequences")
    manifest = write_sequences(docs, path, tokenizer, **options)
    return read_documents(manifest, path)
