r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its
context and only that reply is trainable. Written out, the examples of a
conversation repeat its beginning again and again, so their size grows with the
square of its turns. ``expand`` therefore stores each turn once: a conversation
is a list of segments, a trainable segment ends with one assistant reply, and
the example of that reply is the concatenation of all segments up to its own.
``examples`` writes them out in full, one after the other, and ``read_examples`` reads such a table back; ``read_back`` does
the same from the segments.

Template of a turn (:data:`TURN`): ``### role: text</turn>`` and a newline. In texts
and roles a backslash becomes ``\\``, ``###`` becomes ``\#\#\#``, ``</turn>`` becomes
``<\/turn>`` (and ``:`` in a role ``\:``), so no control string is left inside a text
and :func:`unescape` gives the text back exactly.

Defined results: a null text or role counts as empty. Rows go by turn (nulls
first), then role, then text, so ties and repeated rows have a fixed order; all of them
stay. A conversation without assistant turns has segments but no example. Rows
with a null conversation id form one conversation. An empty table gives an empty
result. A task holds one batch of turns and one segment (of at most
``segment_chars`` plus one turn), never a whole conversation.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.session import checkpoint_dir

from .common import only

TURN = "### {role}: {text}</turn>\n"
PARSE = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.S)
SEGMENT = "segment long, start long, text string, loss_start long, loss_end long, trainable boolean"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\#\\#\\#").replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", target_role: str = "assistant", segment_chars: int = 1 << 16) -> DataFrame:
    """Segments (conv, segment, start, text, loss_start, loss_end, trainable).

    ``start`` is the segment's offset in its conversation (all counts are code
    points). A trainable segment is one example: the text of all segments up to it, with
    the loss on the escaped reply in [loss_start, loss_end) of that text.
    Segments of a conversation lie in order in one partition.
    """
    src = only(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col) \
        .withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})

    def run(batches: Iterator):
        import pyarrow as pa
        schema = pa.schema([("conv", conv_type[0]), ("segment", pa.int64()), ("start", pa.int64()), ("text", pa.string()),
                            ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("trainable", pa.bool_())]) if conv_type else None
        conv, segment, start, text, size = object(), 0, 0, [], 0
        for b in batches:
            if schema is None:
                conv_type.append(b.schema.field("conv").type)
                schema = pa.schema([("conv", conv_type[0]), ("segment", pa.int64()), ("start", pa.int64()), ("text", pa.string()),
                                    ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("trainable", pa.bool_())])
            out = []
            for c, role, said in zip(*(b.column(x).to_pylist() for x in ("conv", "role", "text"))):
                if c != conv:
                    if text:
                        out.append((conv, segment, start, "".join(text), None, None, False))
                    conv, segment, start, text, size = c, 0, 0, [], 0
                body = escape(said)
                turn = TURN.format(role=escape(role).replace(":", "\\:"), text=body)
                text.append(turn)
                size += len(turn)
                if role == target_role or size >= segment_chars:
                    at = start + size - len("</turn>\n")
                    loss = (at - len(body), at, True) if role == target_role else (None, None, False)
                    out.append((c, segment, start, "".join(text), *loss))
                    segment, start, text, size = segment + 1, start + size, [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)
        if text:
            out = [(conv, segment, start, "".join(text), None, None, False)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)

    conv_type: list = []
    return src.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text") \
        .mapInArrow(run, f"conv {src.schema['conv'].dataType.simpleString()}, {SEGMENT}")


def examples(segments: DataFrame, batch_chars: int = 1 << 22) -> DataFrame:
    """(conv, example, text, loss_start, loss_end, last): every example in full, from ``expand``'s rows.

    Turns after the last reply (all turns, where there is none) are in no example; they leave as a context-only row
    without a loss, so that nothing of a conversation is lost. ``last`` marks the row that holds the whole conversation. A task holds the
    conversation so far and about ``batch_chars`` of rows.
    """
    def run(batches: Iterator):
        import pyarrow as pa
        names = ["conv", "example", "text", "loss_start", "loss_end", "last"]
        conv, text, n, kept, rest, out, size = object(), "", 0, None, False, [], 0
        kind = None

        def batch():
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

        def done() -> list:
            """The rows that are due at a conversation's end."""
            if rest:
                return [*([(*kept, False)] if kept else []), (conv, n, text, None, None, True)]
            return [(*kept, True)] if kept else []

        for b in batches:
            kind = b.schema.field("conv").type
            for c, own, lo, hi, trainable in zip(*(b.column(x).to_pylist() for x in ("conv", "text", "loss_start", "loss_end", "trainable"))):
                if c != conv:
                    out += done()
                    conv, text, n, kept, rest = c, "", 0, None, False
                text, rest = text + own, not trainable
                if trainable:
                    if kept:
                        out.append((*kept, False))
                    kept = (c, n, text, lo, hi)
                    n += 1
                    size += len(text)
                if size >= batch_chars and out:
                    yield batch()
                    out, size = [], 0
        out += done()
        if out:
            yield batch()

    return segments.mapInArrow(run, f"conv {segments.schema['conv'].dataType.simpleString()}, "
                                    "example long, text string, loss_start long, loss_end long, last boolean")


def write_examples(segments: DataFrame) -> DataFrame:
    """:func:`examples` written in the shared folder and read from it; zstd finds the openings that a conversation's rows repeat."""
    path = f"{checkpoint_dir(segments.sparkSession).rstrip('/')}/tables/examples-{uuid.uuid4().hex}"
    examples(segments).write.option("compression", "zstd").parquet(path)
    return segments.sparkSession.read.parquet(path)


def render(segments: DataFrame) -> DataFrame:
    """(conv, example, text, loss_start, loss_end): the trainable rows of :func:`examples`."""
    return examples(segments).where("loss_start is not null").drop("last")


def read_examples(written: DataFrame) -> DataFrame:
    """One row per conversation, read back from its written examples (rows of :func:`examples`): its turns from the row that holds them
    all, the text under the loss masks example by example, and sizes.

    A first pass parses each example on its own and keeps its reply; only replies are brought together by conversation, in
    order, and hashed as they stream by.
    """
    conv_type = written.schema["conv"].dataType.simpleString()

    def parse(batches: Iterator):
        import pyarrow as pa
        names = ["conv", "example", "reply", "chars", "n_turns", "turns_sha256"]
        for b in batches:
            out = []
            for example, text, lo, hi, last in zip(*(b.column(x).to_pylist() for x in ("example", "text", "loss_start", "loss_end", "last"))):
                reply, n, turns = None, None, None
                if lo is not None:
                    if text[hi:] != "</turn>\n":
                        raise ValueError("an example does not end with its reply")
                    reply = unescape(text[lo:hi])
                if last:
                    n, at, digest = 0, 0, hashlib.sha256()
                    while at < len(text):
                        m = PARSE.match(text, at)
                        if m is None:
                            raise ValueError(f"not in the template at {at}")
                        digest.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                        n, at = n + 1, m.end()
                    turns = digest.hexdigest()
                out.append((example, reply, len(text), n, turns))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("conv"), *(pa.array(x, t) for x, t in zip(columns, types))], names=names)

    def digest(batches: Iterator):
        import pyarrow as pa
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "example_chars"]
        conv, state, kind, out = object(), None, None, []

        def batch():
            types = [kind, pa.int64(), pa.string(), *[pa.int64(), pa.string()], *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

        def row() -> tuple:
            n, turns, chars, loss, size, count, total = state
            return conv, n, turns, chars, loss.hexdigest(), size, count, total

        for b in batches:
            kind = b.schema.field("conv").type
            for c, reply, chars, n, turns in zip(*(b.column(x).to_pylist() for x in ("conv", "reply", "chars", "n_turns", "turns_sha256"))):
                if c != conv:
                    if state:
                        out.append(row())
                    conv, state = c, [None, None, 0, hashlib.sha256(), None, 0, 0]
                if reply is not None:
                    state[2] += len(reply)
                    state[3].update(reply.encode())
                    state[5] += 1
                    state[6] += chars
                if turns is not None:
                    state[0], state[1], state[4] = n, turns, chars
            if out:
                yield batch()
                out = []
        if state:
            out.append(row())
            yield batch()

    replies = written.mapInArrow(parse, f"conv {conv_type}, example long, reply string, chars long, n_turns long, turns_sha256 string")
    return replies.repartition("conv").sortWithinPartitions("conv", "example").mapInArrow(
        digest, f"conv {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
                "n_examples long, example_chars long")


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted text alone: its turns, the text under
    the loss masks, and sizes. ``example_chars`` is the length of all its examples in full."""
    def run(batches: Iterator):
        import pyarrow as pa
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "example_chars"]
        conv, state, kind = object(), None, None

        def row():
            n, turns, chars, loss, size, examples, total = state
            vals = [conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, examples, total]
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(vals, types)], names=names)

        for b in batches:
            kind, done = b.schema.field("conv").type, []
            for c, text, start, lo, hi, trainable in zip(*(b.column(x).to_pylist() for x in (
                    "conv", "text", "start", "loss_start", "loss_end", "trainable"))):
                if c != conv:
                    if state:
                        done.append(row())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                at = 0
                while at < len(text):
                    m = PARSE.match(text, at)
                    if m is None:
                        raise ValueError(f"not in the template at {start + at} of conversation {c}")
                    state[0] += 1
                    state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    at = m.end()
                if trainable:
                    reply = unescape(text[lo - start:hi - start])
                    state[2] += len(reply)
                    state[3].update(reply.encode())
                    state[5] += 1
                    state[6] += start + len(text)
                state[4] += len(text)
            if done:
                yield from done
        if state:
            yield row()

    return segments.mapInArrow(run, f"conv {segments.schema['conv'].dataType.simpleString()}, n_turns long, turns_sha256 string, "
                                    "loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, example_chars long")
