"""Chat formatting at the level of token ids.

Each turn becomes a segment of ids: reserved ids that no text can produce mark its start, its role, its text and its end;
role and text are encoded separately, and the reserved ids are spliced in between. A turn's loss mask is the prefix sum of
marks, +1 where an assistant's text starts and -1 where it ends.

Control strings inside texts are escaped too, so that the printed form is as unambiguous as the ids: a backslash is put
between the first character and the rest of every control string, and one more where backslashes already stand there.
Taking one away restores the text.

A conversation is the sequence of its segments. Segments are rows, so a conversation of any length is never held by one
task; its digests are folded over its rows in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.packing import fast_of, ids_of, original_of

#: ids after the vocabulary's 50,257 entries, and how they are printed
RESERVED = {"<|turn|>": 50_300, "<|text|>": 50_301, "<|end|>": 50_302}
TURN, TEXT, END = RESERVED.values()
PRINTED = {i: s for s, i in RESERVED.items()}
#: control strings of this and other templates, as first character and rest
_CONTROL = re.compile(r"([<\[])(\\*)(?=/?s>|/?INST\]|</?SYS>>|\|[A-Za-z_]+\|>)")
_ESCAPED = re.compile(r"([<\[]\\*)\\(?=/?s>|/?INST\]|</?SYS>>|\|[A-Za-z_]+\|>)")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segment(role: str, text: str, tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of a turn."""
    head, body = ids_of(escape(role), tokenizer), ids_of(escape(text), tokenizer)
    ids = np.concatenate([[TURN], head, [TEXT], body, [END]]).astype(np.int64)
    marks = np.zeros(len(ids) + 1, np.int64)
    if role == "assistant":
        start = len(head) + 2
        marks[start] += 1
        marks[start + len(body)] -= 1
    return ids, np.cumsum(marks)[:-1]


def decode(ids: np.ndarray, tokenizer: str) -> str:
    fast, _ = fast_of(tokenizer)
    if not len(ids):
        return ""
    return fast.decode(ids.tolist(), errors="strict") if fast else original_of(tokenizer).decode(ids.tolist(), skip_special_tokens=False)


def printed(ids: np.ndarray, tokenizer: str) -> str:
    """The segment as a string, reserved ids in their printed form."""
    out, at = [], 0
    for k in np.flatnonzero(ids >= TURN):
        out += [decode(ids[at:k], tokenizer), PRINTED[int(ids[k])]]
        at = k + 1
    return "".join(out) + decode(ids[at:], tokenizer)


def read_back(ids: np.ndarray, mask: np.ndarray, tokenizer: str) -> tuple[str, str, str]:
    """(role, text, text under the loss mask) of a segment, from its ids and mask alone."""
    a, b, c = (int(np.flatnonzero(ids == x)[0]) for x in (TURN, TEXT, END))
    role, text = unescape(decode(ids[a + 1 : b], tokenizer)), unescape(decode(ids[b + 1 : c], tokenizer))
    return role, text, unescape(decode(ids[mask > 0], tokenizer))


SEGMENTS = "conv_id long, turn long, ids array<int>, loss_mask array<int>"


def format_turns(turns: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, turn, ids and loss_mask of every turn.

    Null role or text is empty; null conv_id and turn stay null. Repeated rows and equal turns are formatted each for
    itself. An empty table gives an empty result; other columns are left out. A very long text is one segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                c = b.slice(k, 1000)
                got = [segment(r, t, tokenizer) for r, t in zip(c.column(2).to_pylist(), c.column(3).to_pylist())]
                lists = [pa.array([g[i] for g in got], pa.list_(pa.int32())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), *lists], ["conv_id", "turn", "ids", "loss_mask"])

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, SEGMENTS)


SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def summaries(segments: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation, read back from its segments in order of turn (null first; equal turns by role and text).

    Segments are read back where they lie; what is shuffled is each turn's role and text. The fold keeps one conversation's
    running digests and nothing else, so a conversation with a third of all rows needs no more memory than any other.
    """
    read = "conv_id long, turn long, role string, text string, loss string, formatted long, tokens long, masked long"

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                c = b.slice(k, 1000)
                rows = []
                for ids, mask in zip(c.column(2), c.column(3)):
                    i, m = ids.values.to_numpy(), mask.values.to_numpy()
                    role, text, loss = read_back(i, m, tokenizer)
                    # an assistant's text is under the mask whole, so it is sent once
                    rows.append((role, None if loss == text and text else text, loss, len(printed(i, tokenizer)), len(i), int(m.sum())))
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], ["conv_id", "turn", "role", "text", "loss", "formatted", "tokens", "masked"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SUMMARY.split(", ")]
        kinds = [pa.string() if f.endswith("string") else pa.int64() for f in SUMMARY.split(", ")]
        now, out, started = None, [], False

        def flush():
            rows = [(c, n, t.hexdigest(), k, d.hexdigest(), f, w, m) for c, n, t, k, d, f, w, m in out]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

        for b in batches:
            for conv, role, text, loss, chars, tokens, masked in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6, 7))):
                if not started or now[0] != conv:
                    if len(out) >= 1000:
                        yield flush()
                        out = []
                    now, started = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0], True
                    out.append(now)
                now[1] += 1
                now[2].update(f"{role}\n{loss if text is None else text}\n".encode("utf-8", "surrogatepass"))
                now[3] += len(loss)
                now[4].update(loss.encode("utf-8", "surrogatepass"))
                now[5] += chars
                now[6] += tokens
                now[7] += masked
        if out:
            yield flush()

    rows = segments.select("conv_id", "turn", "ids", "loss_mask").mapInArrow(back, read)
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", F.coalesce("text", "loss"), "loss")
    return dealt.mapInArrow(fold, SUMMARY)
