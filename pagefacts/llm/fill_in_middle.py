"""Fill-in-middle transformation by secondary-sort assembly.

A document is cut into units (a word with the white space before it; white space at the end is one
more), and two cuts drawn from a hash of its doc_id make a prefix, a middle and a suffix. The scan
emits the sections as pieces of up to 4,096 units, keyed by document and position in the output.
One shuffle brings the pieces of a document together and sorts them by position (``repartition`` and
``sortWithinPartitions``, the DataFrame form of repartitionAndSortWithinPartitions), so outputs stream
through incremental digests: a task holds one piece, never a document. To check that nothing is
lost, the output is split at its markers again, its pieces are sorted back within the same partition, and the
restored text streams through a second digest.

Documents that stay as they are need no assembly: the scan takes their digest, and only narrow rows travel.

Defined cases: a null text is an empty one, with no units and the form plain; a null doc_id hashes like
an empty one; a text that holds a marker stays plain; rows equal in doc_id and text are assembled once and
counted, and give a row each; a unit of any length is cut into pieces of up to 1 MiB; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts.llm.texts import row_key

# Section marks, in the order of the sections in the text.
MARKS = {"P": b"<P>", "M": b"<M>", "S": b"<S>"}
# Order of the sections in the output.
FORMS = {"psm": "PSM", "spm": "SPM"}
UNITS = 4096
PIECE_BYTES = 1 << 20
# Bytes that a Python worker takes on, and hands back, at a time, besides Spark's own batches.
BATCH_BYTES = 1 << 22

_FACTS = "form string, n bigint, prefix_chars bigint, middle_chars bigint"
_PIECES = "a bigint, b bigint, doc_id {kind}, " + _FACTS + ", pos bigint, chunk binary, plain_sha256 string"
_PLACED = "a bigint, b bigint, doc_id {kind}, " + _FACTS + ", place bigint, chunk binary, output_sha256 string, rows bigint"
_REPORT = "doc_id {kind}, " + _FACTS + ", output_sha256 string, restored_sha256 string"
# A section's pieces stand in a range of places of their own.
_SECTION = 1 << 56


def _drawn(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from a hash of the seed and the document's id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def _form(text: Column, h3: Column, h4: Column, rate: int, spm: int) -> Column:
    marked = F.lit(False)
    for mark in MARKS.values():
        marked = marked | F.contains(text, F.lit(mark.decode()))
    plain = (text == "") | marked | (h3 % 100 >= rate)
    return F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")


class _Rows:
    """Collects rows into record batches of a bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.held = schema, [], 0

    def add(self, row: tuple, held: int = 0) -> bool:
        """True if a batch is due."""
        self.rows.append(row)
        self.held += held + 200
        return self.held >= BATCH_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[] for _ in self.schema]
        arrays = [pa.array(c, field.type) for c, field in zip(columns, self.schema)]
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _facts(id_type: pa.DataType, *columns: tuple[str, pa.DataType]) -> pa.Schema:
    facts = [("form", pa.string()), ("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
    return pa.schema([("doc_id", id_type), *facts, *columns])


def _keyed(id_type: pa.DataType, *columns: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("a", pa.int64()), ("b", pa.int64()), *_facts(id_type, *columns)])


def _in_slices(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """Rows of up to ``BATCH_BYTES`` in the named column together, and never none."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, before = 0, 0
    while at < batch.num_rows:
        upto = max(int(np.searchsorted(ends, before + BATCH_BYTES, side="right")), at + 1)
        yield batch.slice(at, upto - at)
        at, before = upto, int(ends[upto - 1])


def _unit_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where runs of characters that are not white space end; ``ends`` are the ends of texts that are not empty."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    stops = np.empty(len(data), dtype=bool)
    stops[:-1] = space[1:]
    stops[ends - 1] = True
    return np.flatnonzero(stops & ~space) + 1


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _cut(plain_texts: bool, units: int):
    """Documents to pieces; ``plain_texts`` says whether plain documents travel whole or as a digest."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in (some for whole in batches for some in _in_slices(whole, "text")):
            out = out or _Rows(
                _keyed(
                    batch.schema.field("doc_id").type,
                    ("pos", pa.int64()), ("chunk", pa.binary()), ("plain_sha256", pa.string()),
                )
            )
            column = batch.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            buffer = column.buffers()[2]
            data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.empty(0, np.uint8)
            data = data[offsets[0] : offsets[-1]]
            starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
            unit_ends = _unit_ends(data, ends[ends > starts])
            first = np.searchsorted(unit_ends, starts, side="right").tolist()
            beyond = np.searchsorted(unit_ends, ends, side="right").tolist()
            others = [batch.column(c).to_pylist() for c in ("a", "b", "doc_id", "form", "h1", "h2")]
            for start, end, low, high, a, b, doc_id, form, h1, h2 in zip(
                starts.tolist(), ends.tolist(), first, beyond, *others
            ):
                words = high - low
                n = words + int(end > start and (not words or int(unit_ends[high - 1]) < end))
                text = data[start:end]
                if form == "plain":
                    facts = (a, b, doc_id, form, n, None, None)
                    digest = hashlib.sha256(text).hexdigest()
                    spans = range(0, len(text) if plain_texts else 1, PIECE_BYTES)
                    for at in spans or (0,):
                        chunk = text[at : at + PIECE_BYTES].tobytes() if plain_texts else None
                        if out.add((*facts, at, chunk, digest), len(chunk or b"")):
                            yield out.batch()
                    continue
                cuts = [0, *sorted((h1 % (n + 1), h2 % (n + 1))), n]
                # After so many units stands this byte.
                at = [start if not k else int(unit_ends[low + k - 1]) if k <= words else end for k in cuts]
                sections = dict(zip(MARKS, zip(cuts[:-1], cuts[1:], at[:-1], at[1:])))
                facts = (a, b, doc_id, form, n, _chars(data[at[0] : at[1]]), _chars(data[at[1] : at[2]]))
                pos = 0
                for name in FORMS[form]:
                    from_unit, to_unit, from_byte, to_byte = sections[name]
                    whole = unit_ends[low + from_unit + units - 1 : low + min(to_unit, words) : units].tolist()
                    bounds = [from_byte, *whole, to_byte]
                    pieces = [MARKS[name]] + [
                        data[i : min(i + PIECE_BYTES, to)].tobytes()
                        for since, to in zip(bounds, bounds[1:])
                        for i in range(since, to, PIECE_BYTES)
                    ]
                    for chunk in pieces:
                        if out.add((*facts, pos, chunk, None), len(chunk)):
                            yield out.batch()
                        pos += len(chunk)
        if out:
            yield out.batch()

    return task


def pieces(
    docs: DataFrame, *, seed: int = 42, rate: int = 50, spm: int = 80, units: int = UNITS, plain_texts: bool = True
) -> DataFrame:
    """The outputs in pieces: key (a, b), facts, pos (the byte of the output where the piece starts) and chunk.

    ``rate`` per cent of the documents are transformed, ``spm`` per cent of these with the suffix first. A
    piece has up to ``units`` units.
    """
    text = F.coalesce("text", F.lit(""))
    h1, h2, h3, h4 = _drawn(F.col("doc_id"), seed)
    rows = docs.select(
        row_key(F.col("doc_id"), text).alias("key"), "doc_id", text.alias("text"),
        _form(text, h3, h4, rate, spm).alias("form"), h1.alias("h1"), h2.alias("h2"),
    ).select("key.*", "doc_id", "text", "form", "h1", "h2")
    return rows.mapInArrow(_cut(plain_texts, units), _PIECES.format(kind=docs.schema["doc_id"].dataType.simpleString()))


def assembled(parts: DataFrame) -> DataFrame:
    """Pieces in output order: one shuffle, in which every document's pieces are sorted by position."""
    return parts.repartition("a", "b").sortWithinPartitions("a", "b", "pos")


class _Stream:
    """Rows of sorted batches one by one, and the type of doc_id once there is a row."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches, self.id_type = batches, None

    def __iter__(self) -> Iterator[tuple]:
        for batch in self.batches:
            self.id_type = batch.schema.field("doc_id").type
            yield from zip(*(column.to_pylist() for column in batch.columns))


class _Sections:
    """Splits an output that arrives in chunks at its marks; a mark may be spread over chunks."""

    def __init__(self, form: str):
        self.marks = [MARKS[name] for name in FORMS[form]]
        ranks = {name: rank for rank, name in enumerate(MARKS)}
        self.bases = [ranks[name] * _SECTION for name in FORMS[form]]
        self.passed, self.sent, self.rest = 0, 0, b""

    def split(self, chunk: bytes, last: bool = False) -> Iterator[tuple[int, bytes]]:
        """(place in the text, bytes); places grow within a section and from section to section."""
        held = self.rest + chunk
        while self.passed < len(self.marks) and (at := held.find(self.marks[self.passed])) >= 0:
            yield from self._send(held[:at])
            held = held[at + len(self.marks[self.passed]) :]
            self.passed, self.sent = self.passed + 1, 0
        keep = 0 if last or self.passed == len(self.marks) else min(len(held), len(self.marks[self.passed]) - 1)
        self.rest = held[len(held) - keep :]
        yield from self._send(held[: len(held) - keep])

    def _send(self, part: bytes) -> Iterator[tuple[int, bytes]]:
        if part:
            yield self.bases[self.passed - 1] + self.sent, part
            self.sent += len(part)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Assembled pieces to output digests, and to the output's parts with their place in the text.

    A document's digest stands in a row of place -1, with the number of its rows.
    """
    out = key = None

    def close() -> Iterator[pa.RecordBatch]:
        for place, part in sections.split(b"", last=True) if sections else ():
            if out.add((*facts, place, part, None, None), len(part)):
                yield out.batch()
        if out.add((*facts, -1, None, plain or digest.hexdigest(), rows)):
            yield out.batch()

    stream = _Stream(batches)
    for *these, pos, chunk, sha256 in stream:
        if these[:2] != key:
            if key is not None:
                yield from close()
            else:
                out = _Rows(_keyed(stream.id_type, *_PLACED_COLUMNS))
            key, facts, plain, digest, rows, upto = these[:2], these, sha256, hashlib.sha256(), 0, -1
            sections = _Sections(these[3]) if these[3] in FORMS else None
        rows += pos == 0
        if pos <= upto or chunk is None:
            continue  # a repeated row's piece, or a plain document's digest
        upto = pos
        if sections:
            digest.update(chunk)
            for place, part in sections.split(chunk):
                if out.add((*facts, place, part, None, None), len(part)):
                    yield out.batch()
    if key is not None:
        yield from close()
        yield out.batch()


_PLACED_COLUMNS = (
    ("place", pa.int64()), ("chunk", pa.binary()), ("output_sha256", pa.string()), ("rows", pa.int64()),
)


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by place to digests of the restored texts, one row for every row of the document."""
    out = key = None

    def close() -> Iterator[pa.RecordBatch]:
        restored = output if form == "plain" else digest.hexdigest()
        for _ in range(rows):
            if out.add((*facts, output, restored)):
                yield out.batch()

    stream = _Stream(batches)
    for a, b, *these, place, chunk, sha256, n_rows in stream:
        if (a, b) != key:
            if key is not None:
                yield from close()
            else:
                out = _Rows(_facts(stream.id_type, ("output_sha256", pa.string()), ("restored_sha256", pa.string())))
            key, facts, form, output, rows, digest = (a, b), these, these[1], sha256, n_rows, hashlib.sha256()
        if chunk is not None:
            digest.update(chunk)
    if key is not None:
        yield from close()
        yield out.batch()


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, facts, and the digests of output and restored text, one row per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = assembled(pieces(docs, plain_texts=False, **options))
    placed = parts.mapInArrow(_digested, _PLACED.format(kind=kind)).sortWithinPartitions("a", "b", "place")
    return placed.mapInArrow(_restored, _REPORT.format(kind=kind))


def transform(docs: DataFrame, **options) -> DataFrame:
    """doc_id, facts, output: the text of every document as the transformation writes it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return assembled(pieces(docs, **options)).mapInArrow(_joined, f"doc_id {kind}, {_FACTS}, output string")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Assembled pieces to outputs; a task holds one document."""
    out = key = None

    def close() -> Iterator[pa.RecordBatch]:
        output = b"".join(parts).decode()
        for _ in range(rows):
            if out.add((*facts, output), len(output)):
                yield out.batch()

    stream = _Stream(batches)
    for a, b, *these, pos, chunk, _ in stream:
        if (a, b) != key:
            if key is not None:
                yield from close()
            else:
                out = _Rows(_facts(stream.id_type, ("output", pa.string())))
            key, facts, parts, rows, upto = (a, b), these, [], 0, -1
        rows += pos == 0
        if pos > upto:
            parts.append(chunk)
            upto = pos
    if key is not None:
        yield from close()
        yield out.batch()


def report_sql(seed: int = 42, rate: int = 50, spm: int = 80) -> str:
    """The rows of ``report`` as DuckDB SQL."""
    space = r"[\x20\x09-\x0D]"
    units = rf"{space}*[^\x20\x09-\x0D]+|{space}+"
    return rf"""
    WITH hashed AS (
      SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    drawn AS (
      SELECT doc_id, text, regexp_extract_all(text, '{units}') AS units,
        ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
        ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM hashed),
    cuts AS (
      SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS c1,
        greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS c2,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
          OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
    sections AS (
      SELECT *, array_to_string(units[1:c1], '') AS p, array_to_string(units[c1 + 1:c2], '') AS m,
        array_to_string(units[c2 + 1:n], '') AS s FROM cuts)
    SELECT doc_id, n::BIGINT AS n, form,
      CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
      sha256(text) AS restored_sha256
    FROM sections"""
