"""Chat formatting by event-sourced reconstruction: logs of streamed, edited and regenerated messages become training text.

A log has events (conv_id, seq, kind, message, role, text). `message` is the place of a message in its conversation and

* `open` begins the message (again), with its role and no text,
* `delta` adds text to it,
* `edit` replaces its text and leaves later messages alone,
* `regenerate` takes back the message and all that come after it, and opens it again.

Logs are partitioned by conversation and range of SLICE sequence numbers, sorted by sequence and folded as a stream. A fold
ends after HELD characters and leaves a patch for each message that it touched, so that its memory is bounded and a
conversation that holds a third of all events is spread over tasks. Folding is associative: the patches of a message are
put together in the order of their folds, without those that a later fold took back. Of the take-backs only those that
reach messages of earlier folds go on to the patches.

`render` marks turns by a template in Column functions, one row a turn, with the loss mask over the text of the assistant.
Control strings inside texts and roles get a backslash behind their first character, which `unescape` takes out again;
other texts stay as they are. `read_back` parses what was rendered, turn by turn, and hashes it as a sorted stream: SHA-256
can't be split, so a conversation's rendered turns pass through one task, but one batch of them is held at a time.

Rows: null roles and texts are empty. Events with a null seq or message or an unknown kind are left out; of events that share
conv_id and seq (delivered twice) the first by kind, message, role and text counts. Deltas and edits of messages that aren't
open (late ones, of what was taken back) do nothing. A null conv_id is a conversation of its own. Conversations without
messages and empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.llm.common import bound_batches, cut, read
from tallygrid.llm.turns import ordered

KINDS = ("open", "delta", "edit", "regenerate")
#: Sequence numbers that are folded in one task, and characters that a fold holds.
SLICE, HELD = 1 << 16, 1 << 22
#: What opens and closes a turn of a role; other roles are written out between the marks of OTHER.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("[OUT] ", "</s>")}
OTHER = ("[ROLE] ", " [TEXT] ", "</s>")
#: Control strings: first character, backslashes that an escaped one has behind it, the rest.
_REST = r"/?(?:INST|SYS)\]|(?:OUT|ROLE|TEXT)\]|/?s>"
_PATCH = "conv_id long, message long, at long, opened boolean, reset boolean, role string, text string, back long"


def escape(text: str | Column) -> Column:
    """Text in which no control string is left; a text without any is unchanged."""
    return F.regexp_replace(text, rf"([\[<])(\\*)({_REST})", r"$1\\$2$3")


_ESCAPED = re.compile(rf"([\[<])\\(\\*)({_REST})")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text


class Fold:
    """Patches of a run of events of one conversation: for each message whether it was opened or reset and what was added."""

    def __init__(self, conv_id: int | None, at: int):
        self.conv_id, self.at, self.held, self.back = conv_id, at, 0, None
        self.messages: dict[int, list] = {}  # opened, reset, role, pieces

    def add(self, kind: str, message: int, role: str, text: str) -> None:
        self.held += len(text)
        if kind == "regenerate":
            self.back = message if self.back is None else min(self.back, message)
            for m in [m for m in self.messages if m >= message]:
                del self.messages[m]
        if kind in ("open", "regenerate"):
            self.messages[message] = [True, True, role, []]
            return
        own = self.messages.setdefault(message, [False, False, None, []])
        if kind == "edit":
            own[1], own[3] = True, []
        own[3].append(text)

    def rows(self) -> list[tuple]:
        """A row for each message, and one without a message for the lowest message that was taken back."""
        out = [(self.conv_id, m, self.at, opened, reset, role, "".join(text), None) for m, (opened, reset, role, text) in self.messages.items()]
        return out if self.back is None else [*out, (self.conv_id, None, self.at, False, False, None, None, self.back)]


def _folder(held: int):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in _PATCH.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Events sorted by conversation, slice and seq."""
        now, key, last = None, None, None
        table = lambda rows: pa.record_batch([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=names)
        for batch in batches:
            out: list[tuple] = []
            for conv_id, part, seq, kind, message, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and (key != (conv_id, part) or now.held >= held and seq != last):
                    out += now.rows()
                    now = None
                if now is None:
                    now = Fold(conv_id, seq)
                elif seq == last:
                    continue
                key, last = (conv_id, part), seq
                now.add(kind, message, role, text)
                if len(out) >= 1024:
                    yield table(out)
                    out = []
            yield table(out)
        if now is not None:
            yield table(now.rows())

    return fold


def messages(log: DataFrame, slice_size: int = SLICE, held: int = HELD) -> DataFrame:
    """(conv_id, message, role, text): what is left of each conversation when its log has been folded."""
    bound_batches(log.sparkSession)
    blank = lambda c: F.expr(f"coalesce(cast({c} as string), '')").alias(c)
    events = log.where(F.col("seq").isNotNull() & F.col("message").isNotNull() & F.col("kind").isin(*KINDS))
    events = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.expr(f"cast(floor(seq / {slice_size}) as long)").alias("part"), F.col("seq").cast("long").alias("seq"), "kind", F.col("message").cast("long").alias("message"), blank("role"), blank("text"))
    events = events.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "seq", "kind", "message", "role", "text")
    patches = cut(events.mapInArrow(_folder(held), _PATCH))
    # a fold's take-back matters to others if an earlier fold of the conversation has a message at or behind it
    folds = patches.groupBy("conv_id", "at").agg(F.max("message").alias("top"), F.min("back").alias("back"))
    earlier = F.max("top").over(W.partitionBy("conv_id").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    backs = folds.withColumn("earlier", earlier).where("back <= earlier").groupBy(F.col("conv_id").alias("of")).agg(F.collect_list(F.struct("at", "back")).alias("backs"))
    found = patches.where("message is not null").groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(F.struct("at", "opened", "reset", "role", "text"))).alias("all"))
    found = found.join(backs.hint("merge"), F.col("conv_id").eqNullSafe(F.col("of")), "left")
    found = found.withColumn("since", F.expr("array_max(transform(filter(backs, x -> x.back <= message), x -> x.at))"))
    found = found.withColumn("all", F.expr("if(since is null, all, filter(all, x -> x.at >= since))"))
    found = found.withColumn("open_at", F.expr("array_max(transform(filter(all, x -> x.opened), x -> x.at))")).where("open_at is not null")
    found = found.withColumn("text_at", F.expr("array_max(transform(filter(all, x -> x.reset and x.at >= open_at), x -> x.at))"))
    return found.select(
        "conv_id", "message", F.expr("filter(all, x -> x.at = open_at)[0].role").alias("role"), F.expr("array_join(transform(filter(all, x -> x.at >= text_at), x -> x.text), '')").alias("text")
    )


def render(found: DataFrame) -> DataFrame:
    """(conv_id, message, formatted, loss_start, loss_end): turns in the template; offsets count code points, null without loss."""
    known = F.col("role").isin(*MARKS)
    before = F.concat(F.lit(OTHER[0]), escape("role"), F.lit(OTHER[1]))
    after = F.lit(OTHER[2])
    for role, (a, b) in MARKS.items():
        before, after = F.when(F.col("role") == role, F.lit(a)).otherwise(before), F.when(F.col("role") == role, F.lit(b)).otherwise(after)
    rows = found.select("conv_id", "message", "role", F.when(known, before).otherwise(before).alias("before"), escape("text").alias("body"), after.alias("after"))
    start = F.when(F.col("role") == "assistant", F.char_length("before"))
    return rows.select("conv_id", "message", F.concat("before", "body", "after").alias("formatted"), start.alias("loss_start"), (start + F.char_length("body")).alias("loss_end"))


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one rendered turn."""
    for role, (a, b) in MARKS.items():
        if formatted.startswith(a) and formatted.find(b, len(a)) == len(formatted) - len(b):
            return role, unescape(formatted[len(a) : -len(b)])
    a, b, c = OTHER
    middle = formatted.find(b, len(a))
    if formatted.startswith(a) and middle >= 0 and formatted.find(c, middle + len(b)) == len(formatted) - len(c):
        return unescape(formatted[len(a) : middle]), unescape(formatted[middle + len(b) : -len(c)])
    raise ValueError(f"not a turn of the template: {formatted[:80]!r}")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by conversation and message."""
    key, turns, loss, counts = None, None, None, [0, 0, 0]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    done = lambda: (key, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2])
    table = lambda rows: pa.record_batch([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=names)
    for batch in batches:
        out = []
        for conv_id, _, formatted, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if turns is None or conv_id != key:
                if turns is not None:
                    out.append(done())
                key, turns, loss, counts = conv_id, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            role, text = parse_turn(formatted)
            turns.update(f"{role}\n{text}\n".encode())
            counts[0] += 1
            counts[2] += len(formatted)
            if start is not None:
                masked = unescape(formatted[start:end])
                counts[1] += len(masked)
                loss.update(masked.encode())
        yield table(out)
    if turns is not None:
        yield table([done()])


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, from its rendered turns."""
    bound_batches(rendered.sparkSession)
    rows = rendered.select("conv_id", "message", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "message")
    return rows.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def write_chats(rendered: DataFrame, path: str) -> None:
    """Rendered turns as Parquet, in ranges of conversations, a conversation's turns in order."""
    keys = [F.col("conv_id").asc_nulls_first(), "message"]
    rendered.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)


def event_log(conversations: DataFrame) -> DataFrame:
    """The log from which rows (conv_id, turn, role, text) may have come: texts streamed in up to 16 deltas.

    By a hash of the text, one message in four was first something else: an assistant's is regenerated after the user has
    already answered it, others are edited. One event in nine was delivered twice.
    """
    own = F.xxhash64("role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.expr(f"coalesce(cast({c} as string), '') as {c}") for c in ("role", "text")))
    rows = ordered(rows.withColumn("own", own), F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("own"))
    rows = rows.withColumns({"size": F.expr("greatest(200L, cast(ceil(char_length(text) / 16) as long))"), "m": F.expr("2 * at"), "kind": F.expr("if(pmod(own, 4) > 0, 'plain', if(role = 'assistant', 'regenerate', 'edit'))")})
    rows = rows.withColumn("pieces", F.expr("if(text = '', array(''), transform(sequence(0L, (char_length(text) - 1) div size), i -> substring(text, int(i * size + 1), int(size))))"))
    event = lambda kind, m, role, text: f"named_struct('kind', '{kind}', 'message', {m}, 'role', {role}, 'text', {text})"
    draft, nobody = "concat('draft ', reverse(substring(text, 1, 40)))", "cast(null as string)"
    streamed = f"transform(pieces, x -> {event('delta', 'm', nobody, 'x')})"
    events = f"""case kind
      when 'plain' then concat(array({event("open", "m", "role", "''")}), {streamed})
      when 'edit' then concat(array({event("open", "m", "role", "''")}, {event("delta", "m", nobody, draft)}, {event("edit", "m", nobody, "pieces[0]")}), slice({streamed}, 2, 64))
      else concat(array({event("open", "m", "role", "''")}, {event("delta", "m", nobody, draft)}, {event("open", "m + 1", "'user'", "''")}, {event("delta", "m + 1", nobody, draft)}, {event("regenerate", "m", "role", "''")}), {streamed})
    end"""
    rows = rows.select("conv_id", "at", F.posexplode(F.expr(events)).alias("i", "e"))
    rows = rows.select("conv_id", F.expr("at * 64 + i").alias("seq"), "e.*")
    return rows.withColumn("_times", F.explode(F.expr("sequence(1, if(pmod(seq, 9) = 0, 2, 1))"))).drop("_times")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_back(render(messages(event_log(rows.unionByName(more)))))


#: The rows as they are: an escaped control string is one character longer.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[\[<]\\*(/?(INST|SYS)\]|(OUT|ROLE|TEXT)\]|/?s>)')) AS body,
    CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 10
      ELSE 19 + length(role) + len(regexp_extract_all(role, '[\[<]\\*(/?(INST|SYS)\]|(OUT|ROLE|TEXT)\]|/?s>)')) END AS marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + marks) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
