"""Chat formatting from event logs.

A log row is an event of a message of a conversation: ``start`` (its role),
``delta`` (text to append), ``edit`` (text that replaces what is there),
``regenerate`` (drop what is there; deltas begin anew) or ``rewind`` (an edit
that also drops every later message that began before it). Events are
partitioned by message, sorted and folded into final messages; these are sorted
by their first event inside their conversation, rendered in a stream, and can
be read back from the rendered text alone. No step holds a conversation: a fold
holds one message, rendering one part, reading back one part and two hashers.

A turn is rendered as ``### role``, a line feed, the text, ``</turn>`` and a
line feed. In texts and roles a backslash goes before every backslash, ``###``
and ``</turn>``; in roles a line feed becomes backslash and ``n``. Null texts
and roles are empty. An event that comes again (equal in all of its columns, as
logs that are delivered at least once have it) counts once; of messages without a
``start`` the role is empty. Events with a null conversation form a conversation;
null order values come first; an empty log has no conversations.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD, TAIL = "### ", "</turn>"
#: a part is given out when it has so many characters; a message is never cut
PART_CHARS = 1 << 18
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_ESCAPED_ROLE = re.compile(r"\\(\\|###|</turn>|n)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> str:
    return f"{HEAD}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{TAIL}\n"


def parse(formatted: str):
    """(role, text) of every turn of a rendered text."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        role = _ESCAPED_ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], formatted[at + len(HEAD) : line])
        end = line
        while True:
            end = formatted.index(TAIL, end + 1)
            slashes = end
            while slashes > line + 1 and formatted[slashes - 1] == "\\":
                slashes -= 1
            if (end - slashes) % 2 == 0:
                break
        yield role, unescape(formatted[line + 1 : end])
        at = end + len(TAIL) + 1


def _tuple(values: list) -> list[tuple]:
    return [tuple((v is not None, v if v is not None else 0) for v in row) for row in zip(*values)]


def _fold(state: list, kind: str, role: str | None, text: str | None, order: list) -> None:
    """state: first event's order, role, pieces of text, order of the last rewind."""
    if kind == "start":
        state[1] = role or ""
    elif kind == "delta":
        state[2].append(text or "")
    elif kind in ("edit", "rewind"):
        state[2][:] = [text or ""]
        if kind == "rewind":
            state[3] = order
    elif kind == "regenerate":
        state[2].clear()
    else:
        raise ValueError(f"unknown kind of event: {kind}")


def messages(events: DataFrame, order: list[str]) -> DataFrame:
    """Final messages of a log with conv_id, message, kind, role, text and the order columns (compared in turn)."""
    cols = ["conv_id", "message", *order]
    rows = events.select(*cols, "kind", "role", "text").repartition("conv_id", "message").sortWithinPartitions(*cols, "kind", "role", "text")
    of = {f.name: f.dataType for f in events.schema.fields}
    schema = T.StructType(
        [T.StructField("conv_id", of["conv_id"])]
        + [T.StructField(f"first_{c}", of[c]) for c in order]
        + [T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
        + [T.StructField(f"rewound_{c}", of[c]) for c in order]
        + [T.StructField("rewound", T.BooleanType())]
    )
    n = len(order)

    def run(batches):
        now, state, done, arrow, before = None, None, [], None, None

        def out():
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, arrow)], names=schema.names)

        def close():
            done.append([now[0], *state[0], state[1], "".join(state[2]), *(state[3] or [None] * n), state[3] is not None])

        for b in batches:
            types = b.schema.types
            arrow = [types[0], *types[2 : 2 + n], pa.string(), pa.string(), *types[2 : 2 + n], pa.bool_()]
            columns = [c.to_pylist() for c in b.columns]
            for values in zip(*columns):
                if values == before:
                    continue
                before = values
                key, at = values[:2], list(values[2 : 2 + n])
                if key != now or state is None:
                    if state is not None:
                        close()
                    now, state = key, [at, "", [], None]
                _fold(state, *values[2 + n :], at)
            if len(done) >= 1000:
                yield out()
                done = []
        if state is not None:
            close()
        if done:
            yield out()

    return rows.mapInArrow(run, schema)


def formatted(events: DataFrame, order: list[str]) -> DataFrame:
    """Rendered conversations as parts: conv_id, part (0, 1, ...), formatted. A conversation's parts are neighbours, in order."""
    first, rewound = [f"first_{c}" for c in order], [f"rewound_{c}" for c in order]
    rows = messages(events, order).select("conv_id", *first, *rewound, "rewound", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", *first)
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("part", T.LongType()), T.StructField("formatted", T.StringType())])
    n = len(order)

    def run(batches):
        now, part, held, size, cut, kind, begun = None, 0, [], 0, None, None, False

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([part], pa.int64()), pa.array(["".join(held)], pa.string())], names=schema.names)

        for b in batches:
            kind = b.schema.types[0]
            columns = [c.to_pylist() for c in b.columns]
            orders, cuts = _tuple(columns[1 : 1 + n]), _tuple(columns[1 + n : 1 + 2 * n])
            for conv, at, until, has, role, text in zip(columns[0], orders, cuts, *columns[1 + 2 * n :]):
                if conv != now or not begun:
                    if held:
                        yield out()
                    now, part, held, size, cut, begun = conv, 0, [], 0, None, True
                if cut is not None and at < cut:
                    continue
                if has and (cut is None or until > cut):
                    cut = until
                held.append(render(role, text))
                size += len(held[-1])
                if size >= PART_CHARS:
                    yield out()
                    part, held, size = part + 1, [], 0
        if held:
            yield out()

    return rows.mapInArrow(run, schema)


def read_back(parts: DataFrame) -> DataFrame:
    """Of parts in their order: counts and digests per conversation, from the rendered text alone."""
    schema = T.StructType(
        [parts.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]
    )

    def run(batches):
        now, begun, kind, done = None, False, None, []
        turns = loss = n = chars = total = None

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], names=schema.names)

        for b in batches:
            kind = b.schema.types[0]
            for conv, _, text in zip(*(c.to_pylist() for c in b.columns)):
                if conv != now or not begun:
                    if begun:
                        done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), total))
                    now, begun, turns, loss, n, chars, total = conv, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                total += len(text)
                for role, said in parse(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    if role == "assistant":
                        chars += len(said)
                        loss.update(said.encode("utf-8", "surrogatepass"))
            if len(done) >= 1000:
                yield out()
                done = []
        if begun:
            done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), total))
        if done:
            yield out()

    return parts.mapInArrow(run, schema)


#: characters that a delta of a log made from finished rows carries
DELTA_CHARS = 4096
ORDER = ["turn", "role_order", "tie", "row", "step"]


def as_events(conversations: DataFrame) -> DataFrame:
    """The log of finished rows: a start and deltas for each, in order of turn, then role, then the text's sha256."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.sha2(F.encode(text, "UTF-8"), 256).alias("tie"), F.monotonically_increasing_id().alias("row"))
    steps = F.sequence(F.lit(0), F.ceil(F.length("text") / DELTA_CHARS).cast("int"))
    rows = rows.select("*", F.explode(steps).alias("step"))
    return rows.select(
        "conv_id",
        F.col("row").alias("message"),
        "turn",
        F.col("role").alias("role_order"),
        "tie",
        "row",
        "step",
        F.when(F.col("step") == 0, "start").otherwise("delta").alias("kind"),
        F.when(F.col("step") == 0, F.col("role")).alias("role"),
        F.when(F.col("step") > 0, F.substring("text", (F.col("step") - 1) * DELTA_CHARS + 1, F.lit(DELTA_CHARS))).alias("text"),
    )
