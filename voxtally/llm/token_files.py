"""Token ids as flat unsigned-integer files with 64-bit document offsets.

Documents are put in ascending order of their id (null first, then by text) by a range exchange that also spreads
ties, and each partition writes its ids to `part-N.bin` and its index to `part-N.idx`, both little-endian:

* `part-N.bin`: the ids of its documents one after another, each document closed by the end id; unsigned 16-bit where
  the vocabulary fits, else unsigned 32-bit.
* `part-N.idx`: n + 1 signed 64-bit offsets (in ids) into `part-N.bin`, then n document ids (64-bit), then n bytes
  that are 1 where the document has an id and 0 where it is null.
* `manifest.json`: unit, end id and, for each part, documents, ids and the base, which is the number of ids in all
  parts before it. Bases are prefix sums over one count for each partition.

Files are written under a name of their own and renamed when complete; a task that runs again writes the same bytes.
On a local shared folder files are memory-mapped; another store is read by pyarrow's file systems.

A text is cut where a single space stands before a character that isn't white space. Byte-level pre-tokenisers of this
family always end a piece there, so the parts can be encoded by the library once and remembered. A text whose white space is
only single spaces and line feeds is cut at the line feeds too, which are pieces of their own there.

Null text counts as empty and yields only the end id. Repeated rows are documents of their own. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import re
import string
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm.common import arrow_schema, kept_in_worker, map_arrow

#: Distinct text parts whose ids a worker remembers: those that came again, and the newest of those that came once. About
#: 200 bytes each.
REMEMBERED, NEW = 400_000, 300_000
#: Longer parts are encoded each time.
LONGEST_REMEMBERED = 64
#: Documents that are encoded together.
TOGETHER = 500

#: Byte-level vocabularies write printable bytes as the same character and the others, in order, as U+0100 and up.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
BYTE_FORMS = [chr(b) if b in _PRINTABLE else chr(0x100 + _OTHERS.index(b)) for b in range(256)]
SPACE = BYTE_FORMS[0x20]
BYTE_FORMS[0x0A] = " "  # here the line feed parts words
BYTE_FORMS = "".join(BYTE_FORMS)
#: Marks that are taken off the end of a word. Each run of them is one piece for the pre-tokeniser.
MARKS = string.punctuation
LINE = "\n"

#: Where white space is more than single spaces or line feeds between other characters (for Arrow's regular expressions, whose own
#: class of white space is ASCII alone; with the separators U+001C to U+001F, which Python counts as white space).
_ODD_SPACE = (
    r"[\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
)
_CUT = re.compile(r" (?=\S)")


def _strings(texts: pa.Array) -> list[str]:
    """As to_pylist, several times as fast."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Whole texts to bytes of ids with the tokenizers library."""

    def __init__(self, path: str, end_id: int = 0):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.unit = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.unit).tobytes()
        self.opens = np.zeros(size, bool)  # by id: whether it begins with a space
        for i in range(size):
            token = self.tokenizer.id_to_token(i)
            self.opens[i] = token is not None and token.startswith(SPACE)
        self.tails: dict[str, bytes] = {}
        self.line = self._ids([LINE])[0]
        self.words = Tokenizer(self.tokenizer.model)  # the same model, not a copy
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.unit).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters alone, each after a space. Such a word is one piece for the pre-tokeniser, so all
        are put into byte form here and given to the library's model in one call."""
        spelled, _ = codecs.charmap_decode("\n".join([" " + w for w in words]).encode(), "strict", BYTE_FORMS)
        ids = np.array(self.words.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, self.unit)
        starts = np.flatnonzero(self.opens[ids]) * self.unit.itemsize
        data = ids.tobytes()
        return [data[i:j] for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(data)], strict=True)]

    def _remember(self, known: dict[str, bytes], found: dict[str, bytes]) -> None:
        if len(known) < REMEMBERED:
            known.update((p, b) for p, b in found.items() if len(p) <= LONGEST_REMEMBERED)

    def _tail(self, marks: str) -> bytes:
        got = self.tails.get(marks)
        if got is None:
            got = self._ids([marks])[0]
            if len(marks) <= LONGEST_REMEMBERED and len(self.tails) < REMEMBERED // 10:
                self.tails[marks] = got
        return got

    def _later(self, parts: Iterable[str]) -> dict[str, bytes]:
        """The ids of parts that follow a space. Marks after a word of letters are a piece of their own, and so is a single line
        feed before one (in texts that were cut at those too)."""
        later, new = self.later, self.new
        fresh, simple, lines, others = {}, [], [], []
        for p in parts:
            w = p if p.isalpha() else p.rstrip(MARKS)
            if w.isalpha():
                simple.append((p, w))
                if w not in later and w not in new:
                    fresh[w] = b""
            elif w[:1] == LINE and w[1:].isalpha():
                lines.append((p, w))
            else:
                others.append(p)
        fresh = dict(zip(fresh, self._word_ids(list(fresh)), strict=True)) if fresh else fresh
        found = {}
        for p, w in simple:
            ids = fresh.get(w) or later.get(w) or new[w]
            found[p] = ids if len(w) == len(p) else ids + self._tail(p[len(w) :])
        if lines:
            heads = self._heads([w[1:] for _, w in lines])
            for p, w in lines:
                found[p] = self.line + heads[w[1:]] + (b"" if len(w) == len(p) else self._tail(p[len(w) :]))
        if others:
            found.update(zip(others, self._ids([p if p[:1] == LINE else " " + p for p in others]), strict=True))
        if len(new) > NEW:
            new.clear()
        new.update(fresh)
        self._remember(new, found)
        return found

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids and the end id. Arrow cuts the texts and finds the distinct parts, which are looked up or encoded once;
        put back in their places, their ids are the texts' ids one after another."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        lists = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), LINE, " " + LINE), " ")
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        parts = lists.flatten().dictionary_encode()
        ids = pa.array(self._found(_strings(parts.dictionary)), pa.large_binary()).take(parts.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, "i8")[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, "i8")
        data = memoryview(data) if data is not None else memoryview(b"")
        heads = _strings(lists.flatten().take(pa.array(bounds[:-1]))) if len(lists) else []
        first = self._heads(heads)
        places = ends[bounds].tolist() if len(heads) else []
        out = []
        for k, head in enumerate(heads):
            # the first part's place holds what it would be after a space
            out.append(first[head] + bytes(data[ends[bounds[k] + 1] : places[k + 1]]) + self.end)
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self._spaced(texts[k].as_py())
        return out

    def _found(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts."""
        got = list(map(self.later.get, parts))
        new, again, missing = self.new, {}, {}
        for i in [i for i, b in enumerate(got) if b is None]:
            p = parts[i]
            if p in new:
                got[i] = again[p] = new[p]
            else:
                missing[p] = i
        self._remember(self.later, again)
        if missing:
            found = self._later(missing)
            for p, i in missing.items():
                got[i] = found[p]
        return got

    def _heads(self, heads: list[str]) -> dict[str, bytes]:
        missing = list({h for h in heads if h not in self.first})
        found = dict(zip(missing, self._ids(missing), strict=True))
        self._remember(self.first, found)
        return {h: found[h] if h in found else self.first[h] for h in heads}

    def _spaced(self, text: str) -> bytes:
        """A text in which white space follows a space."""
        head, *rest = _CUT.split(text)
        places = {p: i for i, p in enumerate(dict.fromkeys(rest))}
        ids = self._found(list(places))
        return self._heads([head])[head] + b"".join([ids[places[p]] for p in rest]) + self.end


def encoder(path: str, end_id: int) -> Encoder:
    """The worker's own, with what it remembers from earlier tasks."""
    return kept_in_worker(("encoder", path, end_id), lambda: Encoder(path, end_id))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Write the files of `docs` to `out_dir` and return the manifest, whose size grows with the number of partitions."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    schema = "part int, n_docs long, n_tokens long"
    out = arrow_schema(spark, schema)
    _make_dir(out_dir)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path, end_id)
        part = TaskContext.get().partitionId()
        store, at = _store(out_dir)
        own = f"{at}/_writing-{uuid.uuid4().hex}"
        lengths: list[int] = []
        ids: list[int | None] = []
        with store.open_output_stream(f"{own}.bin") as stream:
            for batch in batches:
                for start in range(0, batch.num_rows, TOGETHER):
                    part_of = batch.slice(start, TOGETHER)
                    for coded in coder.encode_all(part_of.column(1)):
                        stream.write(coded)
                        lengths.append(len(coded) // coder.unit.itemsize)
                    ids.extend(part_of.column(0).to_pylist())
        offsets = np.zeros(len(lengths) + 1, "<i8")
        np.cumsum(lengths, out=offsets[1:])
        with store.open_output_stream(f"{own}.idx") as stream:
            stream.write(offsets.tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes() + bytes(i is not None for i in ids))
        for kind in ("bin", "idx"):
            store.move(f"{own}.{kind}", f"{at}/part-{part:06d}.{kind}")
        yield pa.RecordBatch.from_pylist([{"part": part, "n_docs": len(ids), "n_tokens": int(offsets[-1])}], schema=out)

    parts = sorted(map_arrow(ordered.select("doc_id", "text"), write, schema).collect())
    base, listed = 0, []
    for p in parts:
        listed.append({"part": p.part, "n_docs": p.n_docs, "n_tokens": p.n_tokens, "base": base})
        base += p.n_tokens
    manifest = {"unit": Encoder(tokenizer_path, end_id).unit.str, "end_id": end_id, "n_tokens": base, "parts": listed}
    store, at = _store(out_dir)
    with store.open_output_stream(f"{at}/manifest.json") as stream:
        stream.write(json.dumps(manifest).encode())
    return manifest


def _make_dir(out_dir: str) -> None:
    store, at = _store(out_dir)
    store.create_dir(at, recursive=True)


def read_manifest(out_dir: str) -> dict:
    store, at = _store(out_dir)
    with store.open_input_stream(f"{at}/manifest.json") as stream:
        return json.loads(stream.read())


def _mapped(store: fs.FileSystem, path: str, kind: np.dtype | str) -> np.ndarray:
    if store.get_file_info(path).size == 0:
        return np.zeros(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    with store.open_input_stream(path) as stream:
        return np.frombuffer(stream.read(), kind)


def open_part(out_dir: str, part: int, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets, document ids and their validity of one part, memory-mapped where the store allows it."""
    store, at = _store(out_dir)
    ids = _mapped(store, f"{at}/part-{part:06d}.bin", np.dtype(unit))
    index = _mapped(store, f"{at}/part-{part:06d}.idx", "u1")
    n = (len(index) - 8) // 17
    return ids, index[: 8 * (n + 1)].view("<i8"), index[8 * (n + 1) : 8 * (2 * n + 1)].view("<i8"), index[8 * (2 * n + 1) :]


def read_token_files(spark: SparkSession, out_dir: str, with_ids: bool = False) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens (with the end
    id), ids_crc32 (of its ids as little-endian unsigned 32-bit integers) and, if asked for, the ids."""
    manifest = read_manifest(out_dir)
    bases = {p["part"]: p["base"] for p in manifest["parts"]}
    unit = manifest["unit"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    out = arrow_schema(spark, schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                if part not in bases:
                    continue
                ids, offsets, doc_ids, valid = open_part(out_dir, part, unit)
                for at in range(0, len(doc_ids), 2000):
                    span = range(at, min(at + 2000, len(doc_ids)))
                    found = [np.asarray(ids[offsets[i] : offsets[i + 1]]).astype("<u4") for i in span]
                    columns = [[int(doc_ids[i]) if valid[i] else None for i in span], [bases[part] + int(offsets[i]) for i in span], [len(x) for x in found], [zlib.crc32(x) for x in found]]
                    if with_ids:
                        columns.append([x.tolist() for x in found])
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    n = max(bases, default=0) + 1
    return map_arrow(spark.range(0, n, 1, n), read, schema)
