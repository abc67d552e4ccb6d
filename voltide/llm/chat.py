"""Chat formatting: segments are encoded apart, reserved ids spliced in, loss masks come from prefix sums."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltide.llm.blocks import text_blocks
from voltide.llm.wordbpe import tokenizer_path

# Reserved ids after the 50,257 of the byte-level vocabulary, and how they are shown.
START, BODY, END = 50257, 50258, 50259
SHOWN = {START: "<|im_start|>", BODY: "\n", END: "<|im_end|>\n"}
LOSS_ROLE = "assistant"
_LIBRARY: dict[str, object] = {}


def tokenizer(path: str):
    """The byte-level tokenizer, kept between the tasks of a Python worker. Its special tokens' strings are ordinary text."""
    if path not in _LIBRARY:
        from tokenizers import Tokenizer

        tk = Tokenizer.from_file(path)
        tk.encode_special_tokens = True
        tk.no_truncation()
        tk.no_padding()
        _LIBRARY[path] = tk
    return _LIBRARY[path]


def escape(text: str) -> str:
    r"""No control string is left: `<|` becomes `<\|`, `<\|` becomes `<\\|`, and so on."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def format_chats(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """Turns as token ids with a template, and where a conversation's loss applies.

    General: the project keeps no conversations. conversations: conv_id, turn, role, text; other columns are ignored.
    Returns a row per turn: conv_id, turn, ids (start id, role, body id, text, end id), start (ids of the conversation
    before the turn), loss_from and loss_to (the ids under the loss mask: the text of assistant turns). The mask of a
    conversation is 1 from start + loss_from to start + loss_to of its turns; loss_mask() spells it out.

    Role and text are encoded apart as ordinary text, so that their content never gives a reserved id, and escaped, so
    that the shown form holds no control string from content either. Only a window sum of lengths needs a conversation
    together; encoding comes before the shuffle. Turns are ordered by (turn, role, text); NULL role and text count as
    empty, NULL turns come first, rows with a NULL conv_id form a conversation. Repeated rows stay. Empty in, empty out.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = tokenizer(path)
        for b, texts in text_blocks(batches, "text"):
            roles = [r or "" for r in b.column(2).to_pylist()]
            known = {r: tk.encode(escape(r), add_special_tokens=False).ids for r in set(roles)}
            ids, loss_from, loss_to = [], [], []
            for r, e in zip(roles, tk.encode_batch_fast([escape(t) for t in texts], add_special_tokens=False)):
                head = [START, *known[r], BODY]
                ids.append([*head, *e.ids, END])
                loss_from.append(len(head))
                loss_to.append(len(ids[-1]) - 1 if r == LOSS_ROLE else len(head))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), b.column(3), pa.array(ids, pa.list_(pa.int32())), pa.array(loss_from, pa.int32()), pa.array(loss_to, pa.int32())],
                ["conv_id", "turn", "role", "text", "ids", "loss_from", "loss_to"])

    d = conversations.select("conv_id", "turn", "role", "text")
    kinds = dict(d.dtypes)
    d = d.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role {kinds['role']}, text string, ids array<int>, loss_from int, loss_to int")
    d = d.select("conv_id", "turn", F.struct("turn", "role", F.sha2("text", 256)).alias("_place"), "ids", "loss_from", "loss_to")
    w = Window.partitionBy("conv_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("start", F.coalesce(F.sum(F.size("ids").cast("long")).over(w), F.lit(0).cast("long"))).drop("_place")


def loss_mask(length: int, starts: list[int], ends: list[int]) -> np.ndarray:
    """0/1 per id, by a prefix sum over +1 at starts and -1 at ends."""
    steps = np.zeros(length + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1])


def read_back(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """What the ids of format_chats say, per conversation, with one turn in memory at a time.

    Returns conv_id, n_turns, turns_sha256 (role, newline, text, newline per turn), loss_chars and loss_sha256 (the
    text under the loss mask, unescaped), formatted_chars (of the shown form)."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = tokenizer(path)
        now, open_ = None, False
        turns = loss = None
        done: list[list] = [[], [], [], [], [], []]

        def close() -> None:
            for col, v in zip(done, (now, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2])):
                col.append(v)

        def flush(kind) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(done[0], kind), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string()), pa.array(done[3], pa.int64()),
                 pa.array(done[4], pa.string()), pa.array(done[5], pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            for col in done:
                col.clear()
            return out

        kind = None
        for big in batches:
            kind = big.schema.field(0).type
            for at in range(0, big.num_rows, 1000):
                b = big.slice(at, 1000)
                segments, spans = [], []
                for ids, a, z in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    body = ids.index(BODY)
                    mask = loss_mask(len(ids), [a], [z])
                    segments += [ids[1:body], ids[body + 1 : -1], [i for i, m in zip(ids, mask) if m]]
                    spans.append((SHOWN[ids[0]], SHOWN[ids[body]], SHOWN[ids[-1]]))
                shown = tk.decode_batch(segments, skip_special_tokens=False)
                for k, conv in enumerate(b.column(0).to_pylist()):
                    role, text, learned = shown[3 * k : 3 * k + 3]
                    if not open_ or conv != now:
                        if open_:
                            close()
                        now, open_, turns, loss, counts = conv, True, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                    counts[0] += 1
                    turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    learned = unescape(learned)
                    loss.update(learned.encode())
                    counts[1] += len(learned)
                    counts[2] += len(role) + len(text) + sum(map(len, spans[k]))
            if len(done[0]) >= 5000:
                yield flush(kind)
        if open_:
            close()
        if done[0]:
            yield flush(kind)

    d = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "start").select("conv_id", "ids", "loss_from", "loss_to")
    return d.mapInArrow(run, f"conv_id {dict(d.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
