r"""Chat formatting by columnar byte assembly.

A turn is ``### role: text</turn>`` and a line end. Inside roles and texts a backslash goes before
every backslash, every ``#`` that starts ``### `` and every ``<`` that starts ``</turn>`` (and in
roles before colons and line ends), so that the marks of turns can't be forged and everything can
be read back. For a batch of turns, the lengths of all segments, their cumulative offsets and the
place of each byte are computed in numpy, and headers and contents are copied into one buffer that
becomes the Arrow column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.session import written

START, COLON, END = b"### ", b": ", b"</turn>\n"
#: A conversation of up to so many bytes of text is one row, a longer one several parts.
PART = 4 << 20

FORMATTED = (
    "conv_id long, bucket long, part long, n_turns long, formatted string,"
    " loss array<struct<start: int, length: int>>"
)


# --- bytes ------------------------------------------------------------------------------------


def _content(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and the length of each value; null is empty."""
    values = values.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], "<i8")[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, np.diff(offsets)


def _starts(raw: np.ndarray, ends: np.ndarray, mark: bytes) -> np.ndarray:
    """Where a mark starts that lies within one value; ``ends`` has the end of each byte's value."""
    n = len(raw) - len(mark) + 1
    if n <= 0:
        return np.zeros(len(raw), bool)
    found = np.ones(n, bool)
    for i, c in enumerate(mark):
        found &= raw[i : i + n] == c
    found &= np.arange(n) + len(mark) <= ends[:n]
    return np.concatenate([found, np.zeros(len(raw) - n, bool)])


def escaped(values: pa.Array, role: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values with escapes, and the new length of each."""
    raw, lengths = _content(values)
    stops = np.cumsum(lengths)
    ends = np.repeat(stops, lengths)
    marked = (raw == ord("\\")) | _starts(raw, ends, START) | _starts(raw, ends, END[:-1])
    if role:
        marked |= (raw == ord(":")) | (raw == ord("\n"))
    place = np.arange(len(raw)) + np.cumsum(marked)
    out = np.full(len(raw) + int(marked.sum()), ord("\\"), np.uint8)
    out[place] = raw
    before = np.concatenate([[0], np.cumsum(marked)])
    return out, lengths + before[stops] - before[stops - lengths]


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> None:
    """Copy values that lie in a row in ``data`` to their places ``at`` in the buffer."""
    source = np.cumsum(lengths) - lengths
    out[np.repeat(at - source, lengths) + np.arange(len(data))] = data


def assemble(roles: pa.Array, texts: pa.Array, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns; the byte offsets of turns, and start and end of each content.

    The last two are counted in code points from the buffer's start, for ``trained`` turns.
    """
    role, role_n = escaped(roles, role=True)
    text, text_n = escaped(texts)
    fixed = len(START) + len(COLON) + len(END)
    sizes = role_n + text_n + fixed
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(offsets[-1], np.uint8)
    at = offsets[:-1]
    for mark, where in ((START, at), (COLON, at + len(START) + role_n), (END, offsets[1:] - len(END))):
        for i, c in enumerate(mark):
            out[where + i] = c
    _scatter(out, at + len(START), role, role_n)
    content = at + len(START) + role_n + len(COLON)
    _scatter(out, content, text, text_n)
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    return out, offsets, points[content[trained]], points[content[trained] + text_n[trained]]


# --- formatting -------------------------------------------------------------------------------


def _formatter(trained_role: str):
    names = ["conv_id", "bucket", "part", "n_turns", "formatted", "loss"]
    span = pa.struct([("start", pa.int32()), ("length", pa.int32())])

    def made(table: pa.Table, cuts: np.ndarray, first_part: int) -> pa.RecordBatch:
        """One row for each stretch of turns between cuts."""
        turns = table.combine_chunks()
        column = {n: turns.column(n).chunk(0) for n in table.column_names}
        trained = np.array(column["role"].fill_null("").to_pylist(), object) == trained_role
        out, offsets, start, end = assemble(column["role"], column["text"], trained)
        rows = offsets[cuts]
        text = pa.Array.from_buffers(
            pa.string(), len(cuts) - 1, [None, pa.py_buffer(rows.astype("<i4").tobytes()), pa.py_buffer(out)]
        )
        points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])[rows]
        of = np.searchsorted(cuts, np.flatnonzero(trained), "right") - 1
        spans = pa.StructArray.from_arrays(
            [pa.array((start - points[of]).astype(np.int32)), pa.array((end - start).astype(np.int32))], fields=list(span)
        )
        where = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(cuts) - 1))]).astype(np.int32)
        part = np.zeros(len(cuts) - 1, np.int64)
        part[0] = first_part
        return pa.RecordBatch.from_arrays(
            [
                column["conv_id"].take(pa.array(cuts[:-1])),
                column["bucket"].take(pa.array(cuts[:-1])),
                pa.array(part),
                pa.array(np.diff(cuts).astype(np.int64)),
                text,
                pa.ListArray.from_arrays(pa.array(where), spans),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Turns of a conversation that may go on, and the number of its next part. Numbers only
        # order the parts of one conversation and bucket; they needn't start at 0.
        carry, part = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            table = pa.concat_tables([carry, table]).combine_chunks() if carry is not None else table
            keys = list(zip(table.column("conv_id").to_pylist(), table.column("bucket").to_pylist()))
            cuts = np.array([0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])])
            last = int(cuts[-1])
            if last:
                yield made(table.slice(0, last), cuts, part)
                part = 0
            carry = table.slice(last)
            if carry.nbytes > PART:
                yield made(carry, np.array([0, carry.num_rows]), part)
                carry, part = None, part + 1
        if carry is not None and carry.num_rows:
            yield made(carry, np.array([0, carry.num_rows]), part)

    return run


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, bucket, part, n_turns, formatted, loss) of turns (conv_id, turn, role, text).

    loss has the spans, in code points of ``formatted``, of the contents of ``trained_role``.
    Turns are in order of turn (nulls first), then role and text. Null roles and texts are empty;
    null ids are one conversation. Other columns are ignored. A conversation of up to ``PART``
    bytes is one row. A longer one has several, in order of bucket and part: its turns are dealt
    into buckets by turn number, so that one with a large share of all turns is spread.
    """
    own = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32)
    large = written(
        own.groupBy("conv_id")
        .agg(size.alias("bytes"), F.min("turn").alias("low"), F.max("turn").alias("high"))
        .where(F.col("bytes") > PART)
        .select(
            F.col("conv_id").alias("large_id"),
            "low",
            F.ceil((F.col("high") - F.col("low") + 1) / F.ceil(F.col("bytes") / PART)).alias("width"),
        ),
        "long-conversations",
    )
    dealt = own.join(large, F.col("conv_id").eqNullSafe(F.col("large_id")) & F.col("width").isNotNull(), "left").select(
        "conv_id", "turn", "role", "text",
        F.coalesce(F.floor((F.col("turn") - F.col("low")) / F.col("width")), F.lit(0)).cast("long").alias("bucket"),
    )
    return (
        dealt.repartition("conv_id", "bucket")
        .sortWithinPartitions("conv_id", "bucket", "turn", "role", "text")
        .mapInArrow(_formatter(trained_role), FORMATTED)
    )


# --- reading back -----------------------------------------------------------------------------

_TURN = re.compile(r"### ((?:[^\\:\n]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted text; an error if it is not one."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted parts.

    n_turns; turns_sha256 of role, line end, text, line end of each turn; loss_chars and
    loss_sha256 of all text under the loss spans without escapes; formatted_chars. A hash needs
    a conversation's parts in order, so they meet in one task, as a stream.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def closed(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        def row() -> tuple:
            i, n, turns, chars, loss, size = now
            return i, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for b in batches:
            out = []
            for i, text, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if now is None or now[0] != i:
                    if now is not None:
                        out.append(row())
                    now = [i, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content in parse(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                for s in loss:
                    plain = unescape(text[s["start"] : s["start"] + s["length"]])
                    now[3] += len(plain)
                    now[4].update(plain.encode("utf-8", "surrogatepass"))
                now[5] += len(text)
            if out:
                yield closed(out)
        if now is not None:
            yield closed([row()])

    return (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "bucket", "part")
        .mapInArrow(
            run,
            "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
            " formatted_chars long",
        )
    )
