"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, and that reply
as the only trainable text.  The contexts of a conversation are prefixes of one another, so their
characters are stored once: examples() explodes a conversation into one row an example, with the
turns that the example adds to the one before, the span that is trained on, and the length and the
SHA-256 of the example's whole text.  Written out, examples would grow with the square of a
conversation; expand() writes them, and what it writes has those digests.  conversation_digests()
reads what is written, so it does cost that square.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bound_batches

#: Turns without a reply that one row of examples() holds at most; rows and characters of a batch.
TURNS_A_ROW = 256
BATCH = 500
BATCH_CHARS = 4 << 20
#: What opens and closes a turn, by role, and what opens a conversation.  All control strings begin with < or [.
START = "<s>"
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}
OTHER = ("<<ROLE ", ">>", "<</ROLE>>")
#: Reversible escapes: after them a text holds neither < nor [, so no control string.
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"))
_BACK = {"\\": "\\", "l": "<", "b": "[", "g": ">"}


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S) if "\\" in text else text


def segment(role: Column, text: Column) -> Column:
    """A turn between its marks.  A role without marks of its own is named, escaped, in the opening mark (there > is \\g too)."""
    out = F.concat(F.lit(OTHER[0]), F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit(OTHER[1]), escape(text), F.lit(OTHER[2]))
    for name, (before, after) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(before), escape(text), F.lit(after))).otherwise(out)
    return out


def parse_segment(formatted: str) -> tuple[str, str, int, int]:
    """(role, text, begin, end) of a formatted turn; the escaped text is formatted[begin:end]."""
    if formatted.startswith(OTHER[0]):
        named = formatted.index(OTHER[1])
        role = unescape(formatted[len(OTHER[0]) : named])
        begin, end = named + len(OTHER[1]), len(formatted) - len(OTHER[2])
    else:
        role, (before, after) = next((r, m) for r, m in MARKS.items() if formatted.startswith(m[0]) and formatted.endswith(m[1]))
        begin, end = len(before), len(formatted) - len(after)
    return role, unescape(formatted[begin:end]), begin, end


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each turn formatted, and conversations in order within partitions: conv_id, turn, segment.

    Null text and null role are empty strings.  Turns of a conversation are in the order of turn
    (null first); equal turn numbers are in the order of role and text, and rows that repeat are
    turns of their own.  Rows whose conv_id is null are one conversation.  Other columns are
    dropped; an empty table gives an empty one.  The sort spills, so a huge conversation needs no
    memory.
    """
    bound_batches(turns.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    plain = turns.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    ordered = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "turn", segment(F.col("role"), F.col("text")).alias("segment"))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int | None, str, bool]]:
    """(conv_id, turn, segment, first of its conversation) row by row."""
    last: object = batches
    for batch in batches:
        for conv, turn, formatted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            yield conv, turn, formatted, last is batches or conv != last
            last = conv


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most `size` rows and about BATCH_CHARS characters."""
    held: list[tuple] = []
    chars = 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) if isinstance(x, str) else sum(map(len, x)) if isinstance(x, list) else 0 for x in row)
        if len(held) == size or chars > BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def examples(formatted: DataFrame) -> DataFrame:
    """format_turns() exploded: a row for each assistant turn, which is the example that ends with it.

    conv_id, example (from 0; null for turns after the last reply, which no example has), turns (the
    segments that this example adds to the one before), n_turns (of the whole example), n_chars and
    text_sha256 (of the whole example's text: START and all segments up to this reply), loss_start
    and loss_end (the only trainable span, places in that text).  Rows are in order.  The digest of a
    prefix is the state that the next one goes on from, so each character is hashed once.
    """
    ddl = "conv_id bigint, example bigint, turns array<string>, n_turns bigint, n_chars bigint, text_sha256 string, loss_start bigint, loss_end bigint"
    schema = arrow_schema(formatted.sparkSession, ddl)

    def rows(batches):
        conv, example, added, n, size, state = None, 0, [], 0, 0, hashlib.sha256()
        for next_conv, _, text, first in _conversations(batches):
            if first:
                if added:
                    yield conv, None, added, n, size, state.hexdigest(), None, None
                conv, example, added, n, size, state = next_conv, 0, [], 0, len(START), hashlib.sha256(START.encode())
            role, _, begin, end = parse_segment(text)
            added.append(text)
            state.update(text.encode())
            n, size = n + 1, size + len(text)
            if role == "assistant":
                yield conv, example, added, n, size, state.hexdigest(), size - len(text) + begin, size - len(text) + end
                example, added = example + 1, []
            elif len(added) == TURNS_A_ROW:  # context that goes on: a row without an example, so that no row grows with a conversation
                yield conv, None, added, n, size, state.hexdigest(), None, None
                added = []
        if added:
            yield conv, None, added, n, size, state.hexdigest(), None, None

    return formatted.mapInArrow(lambda batches: _batched(rows(batches), schema), ddl)


def expand(stored: DataFrame) -> DataFrame:
    """The examples of examples() in full: conv_id, example, text, loss_start, loss_end.

    Their characters grow with the square of a conversation's length; they are made one at a time
    from the running prefix and never gathered.  stored must be as examples() gives it.
    """
    return written(stored).filter("example IS NOT NULL")


def written(stored: DataFrame) -> DataFrame:
    """expand(), and behind each conversation's examples the turns that none has: rows whose example is null, with the text of some of those."""
    ddl = "conv_id bigint, example bigint, text string, loss_start bigint, loss_end bigint"
    schema = arrow_schema(stored.sparkSession, ddl)

    def rows(batches):
        prefix, rest, last = START, [], batches
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("conv_id", "turns", "example", "loss_start", "loss_end")]
            for conv, turns, example, a, b in zip(*cols, strict=True):
                if last is batches or conv != last:
                    yield from ((last, None, text, None, None) for text in rest)
                    prefix, rest, last = START, [], conv
                rest.append("".join(turns))
                if example is not None:
                    prefix, rest = prefix + "".join(rest), []
                    yield conv, example, prefix, a, b
        yield from ((last, None, text, None, None) for text in rest)

    return stored.mapInArrow(lambda batches: _batched(rows(batches), schema), ddl)


#: A turn in an example's text; escaped texts and roles hold no < and no [, and a role no > either.
_SEGMENT = re.compile(r"<<SYS>>[^<\[]*<</SYS>>|\[INST\] [^<\[]* \[/INST\]|<<ROLE [^<\[>]*>>[^<\[]*<</ROLE>>| [^<\[]*</s>")


def split_turns(text: str, at: int = 0) -> Iterator[str]:
    """The formatted turns of a text from a place on, which they must fill."""
    while at < len(text):
        found = _SEGMENT.match(text, at)
        if found is None:
            raise ValueError("no turn begins at this place of an example's text")
        yield found[0]
        at = found.end()


def conversation_digests(stored: DataFrame) -> DataFrame:
    """What is read back from the written examples (written()), by conversation.

    conv_id, n_turns, n_examples; turns_sha256 of role, line feed, text, line feed for each turn;
    loss_chars and loss_sha256 of all text under the loss masks, unescaped; formatted_chars of all
    examples' texts together; examples_sha256 of all examples' texts' SHA-256, in order.  Each example
    is written out and read whole: lengths and digests are those of its text, its masked text is cut
    from it, and the turns that it adds to the one before, which it must begin with, are told apart in
    it.  Rows are streamed in order, and one example is held at a time.
    """
    ddl = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint, examples_sha256 string"
    schema = arrow_schema(stored.sparkSession, ddl)

    def rows(batches):
        last: object = batches
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("conv_id", "example", "text", "loss_start", "loss_end")]
            for conv, example, text, a, b in zip(*cols, strict=True):
                if last is batches or conv != last:
                    if last is not batches:
                        yield last, n, all_turns.hexdigest(), chars, loss.hexdigest(), total, count, texts.hexdigest()
                    last, n, chars, total, count, before = conv, 0, 0, 0, 0, START
                    all_turns, loss, texts = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
                if example is not None and not text.startswith(before):
                    raise ValueError("an example doesn't begin with the one before")
                for turn in split_turns(text, 0 if example is None else len(before)):
                    role, plain, _, _ = parse_segment(turn)
                    all_turns.update(f"{role}\n{plain}\n".encode())
                    n += 1
                if example is not None:
                    trained = unescape(text[a:b])
                    loss.update(trained.encode())
                    texts.update(hashlib.sha256(text.encode()).hexdigest().encode())
                    chars, total, count, before = chars + len(trained), total + len(text), count + 1, text
        if last is not batches:
            yield last, n, all_turns.hexdigest(), chars, loss.hexdigest(), total, count, texts.hexdigest()

    return written(stored).mapInArrow(lambda batches: _batched(rows(batches), schema), ddl)


#: DuckDB SQL for the digests of the table conversations and conversation -1.  It writes every example's text out.
DIGEST_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), safe AS (
    SELECT *, replace(replace(replace(text, '\', '\\'), '<', '\l'), '[', '\b') AS t,
        replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '[', '\b'), '>', '\g') AS r FROM turns
), formatted AS (
    SELECT *, CASE role WHEN 'system' THEN '<<SYS>>' || t || '<</SYS>>' WHEN 'user' THEN '[INST] ' || t || ' [/INST]' WHEN 'assistant' THEN ' ' || t || '</s>'
        ELSE '<<ROLE ' || r || '>>' || t || '<</ROLE>>' END AS segment FROM safe
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM formatted
), expanded AS (
    SELECT e.conv_id, e.k, e.text, '<s>' || (SELECT string_agg(p.segment, '' ORDER BY p.k) FROM numbered p WHERE p.conv_id IS NOT DISTINCT FROM e.conv_id AND p.k <= e.k) AS example
    FROM numbered e WHERE e.role = 'assistant'
), replies AS (
    SELECT conv_id, sum(length(text)) AS loss_chars, sha256(string_agg(text, '' ORDER BY k)) AS loss_sha256, sum(length(example)) AS formatted_chars,
        count(*) AS n_examples, sha256(string_agg(sha256(example), '' ORDER BY k)) AS examples_sha256 FROM expanded GROUP BY conv_id
), told AS (
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256 FROM numbered GROUP BY conv_id
)
SELECT t.conv_id, n_turns, turns_sha256, CAST(coalesce(loss_chars, 0) AS BIGINT) AS loss_chars, coalesce(loss_sha256, sha256('')) AS loss_sha256,
    CAST(coalesce(formatted_chars, 0) AS BIGINT) AS formatted_chars, coalesce(n_examples, 0) AS n_examples, coalesce(examples_sha256, sha256('')) AS examples_sha256
FROM told t LEFT JOIN replies r ON r.conv_id IS NOT DISTINCT FROM t.conv_id
"""
