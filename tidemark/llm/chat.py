r"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: `open` begins a message with a role, `delta` appends to it, `edit` replaces its text and
`regenerate` drops what was streamed so far. Logs are partitioned by conversation and sorted by message and sequence number
(an external sort), and a task folds them as a stream: it holds one message at a time, however long a conversation is. Each folded
message is rendered at once as `### role: text</turn>` and a line end, so a conversation's formatted text is its messages' in
order. `#`, `<` and `\` inside roles and texts (and `:` in roles) get a `\` before them, which makes the control strings
impossible inside texts and is undone exactly. The loss mask spans assistants' escaped texts.

Defined results: null text and null role are empty; messages of equal turn are ordered by role and text, and repeated rows are
messages each; a null conversation id is a conversation; events before their message's `open` apply to it with an empty role; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, slices, table

HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
_CONTROL, _ESCAPED = re.compile(r"[\\#<]"), re.compile(r"\\(.)", re.S)
_ROLE = re.compile(r"[\\#<:]")
_MESSAGE = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.S)


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted message and the span of its text."""
    head = HEAD + escape(role, _ROLE) + MIDDLE
    body = escape(text)
    return head + body + TAIL, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each message of a formatted text."""
    return [(unescape(a), unescape(b)) for a, b in _MESSAGE.findall(formatted)]


def conversation_log(rows: DataFrame) -> DataFrame:
    """The event log of finished conversations (conv_id, turn, role, text), as a streaming chat service would have written it:
    texts arrive in two deltas; of every third turn a first draft was regenerated, of another third the text was edited."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    half = (F.length(text) / 2).cast("int")
    event = lambda seq, kind, value: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), value.alias("value"))
    deltas = [event(4, "delta", F.substring(text, F.lit(1), half)), event(5, "delta", F.substring(text, half + 1, F.length(text)))]
    start, which = event(0, "open", role), F.coalesce(F.pmod("turn", F.lit(3)), F.lit(0))
    log = F.when(which == 1, F.array(start, event(1, "delta", F.substring(text, F.lit(1), half + 1)), event(2, "regenerate", F.lit("")), *deltas)).when(which == 2, F.array(start, event(1, "delta", F.lit("draft")), event(3, "edit", text))).otherwise(F.array(start, *deltas))
    tied = Window.partitionBy("conv_id", "turn").orderBy(role, text)
    ranked = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").withColumn("message", F.row_number().over(tied))
    return ranked.select("conv_id", "turn", "message", F.explode(log).alias("e")).select("conv_id", "turn", "message", "e.*")


def format_log(log: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_start, loss_end) per message, in order within each partition; loss bounds are null for messages
    that carry no loss. log: conv_id, turn, message (its number within the turn), seq, kind, value."""

    def run(batches):
        key, role, parts = None, "", []

        def done(out):
            if key is not None:
                text, a, b = render(role, "".join(parts))
                loss = role == "assistant"
                out.append((key[0], text, a if loss else None, b if loss else None))

        for b in slices(batches):
            out = []
            for conv, message, kind, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (conv, message) != key:
                    done(out)
                    key, role, parts = (conv, message), "", []
                if kind == "open":
                    role = value
                elif kind == "delta":
                    parts.append(value)
                else:
                    parts = [value] if kind == "edit" else []
            yield _batch(out, b.schema.field(0).type)
        if key is not None:
            out = []
            done(out)
            yield _batch(out, b.schema.field(0).type)

    ship(log.sparkSession)
    kind = log.schema["conv_id"].dataType.simpleString()
    dealt = log.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "message", "seq")
    rows = dealt.select("conv_id", F.concat_ws("/", F.coalesce(F.col("turn").cast("string"), F.lit("")), F.col("message").cast("string")).alias("message"), "kind", F.coalesce("value", F.lit("")).alias("value"))
    return rows.mapInArrow(run, f"conv_id {kind}, formatted string, loss_start long, loss_end long")


def _batch(rows, id_type):
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (id_type, pa.string(), pa.int64(), pa.int64()), strict=True)], ["conv_id", "formatted", "loss_start", "loss_end"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, state = object(), None

        def batch(found, id_type):
            columns = list(zip(*found, strict=True)) or [[]] * 6
            kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        close = lambda: (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        for b in slices(batches):
            found = []
            for conv, text, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or conv != now:
                    if state:
                        found.append(close())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                if start is not None:
                    said = unescape(text[start:end])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            yield batch(found, b.schema.field(0).type)
        if state:
            yield batch([close()], b.schema.field(0).type)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "\\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    return read_back(format_log(conversation_log(rows.unionByName(probe))))
